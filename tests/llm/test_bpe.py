import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pixeltide.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
PIECES = [
    "a", "the", " ", "  ", "\n", "é", "ß", "1", "²", "'s", "'ll", "'", "!", "<|endoftext|>", "\x1c", "\x85", "\xa0",
    "漢字", "🙂", "́", "Ⅷ", "٣", "_", "-", "\x00", " ", "aaaa", "\r\n",
]


def samples():
    rng = random.Random(5)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 30))) for _ in range(1500)]
    texts += ["".join(rng.choice("aeth") for _ in range(rng.randint(1, 60))) for _ in range(500)]
    texts += ["".join(chr(rng.randint(1, 0x2FFF)) for _ in range(20)) for _ in range(300)]
    return texts + ["x" * 5000, "a" * 999, " " * 3000, ""]


def test_words_join_to_the_text():
    for text in samples():
        assert "".join(bpe.words_of(text)) == text


def test_ids_are_those_of_the_library_and_decode_to_the_text(spark, docs):
    texts = samples()
    df = docs([*enumerate(texts), (-1, None)]).withColumn("ids", bpe.encode(F.col("text"), PATH))
    rows = {r.doc_id: r for r in df.withColumn("back", bpe.decode(F.col("ids"), PATH)).collect()}
    wanted = Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)
    for i, (text, encoded) in enumerate(zip(texts, wanted)):
        assert np.frombuffer(rows[i].ids, "<u4").tolist() == encoded.ids, repr(text)
        assert rows[i].back == text
    assert rows[-1].ids is None and rows[-1].back is None


def test_every_token_spells_itself():
    known = bpe.vocabulary(PATH)
    for token in list(known.by_text.values())[::97]:
        assert b"".join(known.tokens[i] for i in known.encode_word(known.tokens[token])) == known.tokens[token]


def test_neighbours_that_would_merge_are_not_compatible():
    known = bpe.vocabulary(PATH)
    for (left, right), _ in list(known.joined.items())[::501]:
        assert not known.compatible(left, right)


def test_bytes_that_are_no_text_and_empty_table(spark, docs):
    known = bpe.vocabulary(PATH)
    first_byte = known.by_text["é".encode().decode("latin-1")[0]]
    ids = np.array([first_byte], "<u4").tobytes()
    assert spark.createDataFrame([(ids,)], "ids binary").select(bpe.decode(F.col("ids"), PATH)).first()[0] == "�"
    assert docs([]).select(bpe.encode(F.col("text"), PATH)).collect() == []
    with pytest.raises(Exception, match="IndexError"):
        bad = np.array([10**6], "<u4").tobytes()
        spark.createDataFrame([(bad,)], "ids binary").select(bpe.decode(F.col("ids"), PATH)).collect()
