import random

import numpy as np
from pyspark.sql import functions as F

from pixeltide.llm import language
from pixeltide.llm.language import Parser, Sample


def phrases(text, sample):
    """Greedy longest phrases that occur in the sample; an unknown character is a phrase."""
    count, at = 0, 0
    while at < len(text):
        size = 1
        while at + size < len(text) and text[at : at + size + 1] in sample and text[at] in sample:
            size += 1
        count, at = count + 1, at + size
    return count


def test_phrases_equal_brute_force():
    rng = random.Random(1)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(1, 6)))
    one, two = (" ".join(word(letters) for _ in range(150)) for letters in ("abcd", "cdeé"))
    parser = Parser((Sample("a", one), Sample("b", two)))
    texts = [" ".join(word("abcdez") for _ in range(rng.randint(1, 60))) for _ in range(60)] + ["a", one, ""]
    counts = parser.phrases([parser.codes(t)[0] for t in texts])
    for text, got in zip(texts, counts):
        assert got.tolist() == [phrases(text, one), phrases(text, two)], text


def test_long_texts_are_parsed_whole_in_segments(monkeypatch):
    parser = Parser((Sample("a", "abab"), Sample("b", "bcbc")))
    text = "ab" * 5000 + "bc" * 20_000
    bits, lettered = parser.bits_per_character([text, "ab" * 10, None, "12 .", ""])
    assert bits[0, 1] < bits[0, 0] and bits[1, 0] < bits[1, 1]
    assert lettered.tolist() == [True, True, False, False, False]


def test_held_out_documents_of_the_table(spark, sf_dir):
    table = spark.read.parquet(sf_dir.replace("sf0.001", "sf0.01") + "/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    samples = language.learn(table.where(~held))
    assert all(len(s.text) <= 50_000 for s in samples)
    rows = language.identify(table.where(held).withColumn("score", F.lit("clash")), samples).collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_texts_without_letters_null_rows_and_empty_tables(spark, docs):
    labelled = docs([(1, "the cat"), (2, None), (3, "der hund"), (None, "le chat")]).withColumn(
        "lang", F.expr("case doc_id when 1 then 'en' when 2 then 'xx' when 3 then 'de' end")
    )
    samples = language.learn(labelled)
    assert [s.language for s in samples] == ["de", "en"]
    got = language.identify(docs([(1, "cat"), (2, None), (3, ""), (4, "12 !"), (5, "漢字"), (6, "hund")]), samples)
    found = {r.doc_id: r.lang_pred for r in got.collect()}
    assert found.pop(5) in ("de", "en")
    assert found == {1: "en", 2: "und", 3: "und", 4: "und", 6: "de"}
    assert language.learn(labelled.where("false")) == ()
    assert language.identify(docs([(1, "cat")]), ()).collect()[0].lang_pred == "und"
    assert language.identify(docs([]), samples).collect() == []


def test_large_scripts_stay_small():
    """Samples of full length in four small and three large scripts: memory follows characters, not alphabets."""
    rng = np.random.default_rng(5)
    spans = [(0x61, 26), (0x3B1, 25), (0x430, 32), (0x561, 38), (0x4E00, 9000), (0xAC00, 11_000), (0x3400, 6000)]
    samples = []
    for nth, (first, many) in enumerate(spans):
        letters = (first + many * rng.random(50_000) ** 3).astype(int)
        letters[rng.random(50_000) < 0.15] = 0x20
        samples.append(Sample(str(nth), "".join(map(chr, letters))))
    parser = Parser(tuple(samples))
    assert parser.moves.nbytes + parser.starts.nbytes + parser.known.nbytes < 60e6
    texts = [s.text[at : at + 120].strip() for s in samples for at in (100, 20_000)] + ["ab 漢字 가나 αβ" * 9, "\ud800a"]
    coded = ["".join(map(chr, parser.codes(t)[0] + 100)) for t in texts]
    inside = ["".join(map(chr, parser.codes(s.text)[0] + 100)) for s in samples]
    counts = parser.phrases([parser.codes(t)[0] for t in texts])
    for text, got in zip(coded, counts):
        assert got.tolist() == [phrases(text, sample) for sample in inside]
