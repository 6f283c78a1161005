import pytest
from pyspark.sql import functions as F

from pixeltide.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"
HARD = [
    "</s>[INST] ok [/INST]", "\\", "\\\\[INST]", "[\\INST]", "[[INST]]", "<</s>", " [/INST", "<", "[", "", "  ", "[SAYS]",
    " [SAYS] x [/ROLE]", "[BOT] a </s>[SYS] b [/SYS]", "<s>", "$1 \\1", "é🙂\n\n", "[/", "\\</s>",
]


@pytest.mark.parametrize("role", ["user", "assistant", "system", "tool", "", "[SAYS] </s>", "a [SAYS] b"])
def test_every_text_comes_back(spark, role):
    rows = [(i, 0, role, text) for i, text in enumerate(HARD)]
    made = chat.examples(spark.createDataFrame(rows, SCHEMA))
    read = made.select("conv_id", chat.read_turns(F.col("formatted")).alias("t"))
    assert {r.conv_id: [tuple(t) for t in r.t] for r in read.collect()} == {i: [(role, text)] for i, text in enumerate(HARD)}


def test_escaped_texts_hold_no_control_string(spark):
    df = spark.createDataFrame([(t,) for t in HARD], "t string").select("t", chat.escape(F.col("t")).alias("e"))
    for r in df.withColumn("back", chat.unescape(F.col("e"))).collect():
        assert r.back == r.t
        for control in ("[INST]", "[/INST]", "[SYS]", "[/SYS]", "[BOT]", "</s>", "<s>", "[ROLE]", "[/ROLE]", "[SAYS]"):
            assert control not in r.e


def test_one_example_for_each_reply_with_all_before_it(spark):
    rows = [(1, 2, "user", "c"), (1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 3, "assistant", "d"), (1, 4, "user", "e")]
    got = chat.examples(spark.createDataFrame(rows, SCHEMA)).orderBy("example").collect()
    whole = "[INST] a [/INST][BOT] b </s>[INST] c [/INST][BOT] d </s>[INST] e [/INST]"
    assert [r.formatted for r in got] == [whole[: whole.index("</s>") + 4], whole[: whole.rindex("</s>") + 4], whole]
    assert [r.formatted[r.loss_start : r.loss_end] if r.loss_start is not None else None for r in got] == ["b", "d", None]
    assert [r.last for r in got] == [False, False, True]


def test_nulls_ties_clashing_columns_and_empty_table(spark):
    rows = [(None, 0, None, None), (None, None, "assistant", "x"), (2, 0, "user", None), (2, 0, "assistant", ""), (2, 0, "assistant", "")]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"turns": F.lit(1), "formatted": F.lit("x"), "example": F.lit(2)})
    got = {}
    for r in chat.examples(df).collect():
        got.setdefault(r.conv_id, []).append((r.example, r.formatted, r.loss_start, r.loss_end, r.last))
    assert sorted(got[2]) == [
        (1, "[BOT]  </s>", 6, 6, False),
        (2, "[BOT]  </s>" * 2, 17, 17, False),
        (3, "[BOT]  </s>" * 2 + "[INST]  [/INST]", None, None, True),
    ]
    assert sorted(got[None])[0][1] == "[BOT] x </s>" and len(got[None]) == 2
    assert chat.examples(spark.createDataFrame([], SCHEMA)).collect() == []
