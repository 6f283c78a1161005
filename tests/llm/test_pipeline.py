"""Stages of the pipeline on small tables whose result is known."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixeltide.llm import near_dedup

corpus_pipeline = pytest.importorskip("corpus_pipeline")

SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType())]
    + [T.StructField(c, T.StringType()) for c in ("text", "lang", "source")]
    + [T.StructField("n_chars", T.LongType())]
)


def documents(spark, rows):
    """A table of documents from (doc_id, text) or (doc_id, text, lang)."""
    full = [(i, text, *(lang or [None]), "s", len(text or "")) for i, text, *lang in rows]
    return spark.createDataFrame(full, SCHEMA)


def kept(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_language_stage_keeps_lettered_texts_if_nothing_can_be_learned(spark, sf_dir):
    rows = [(k, f"plain text number {k}") for k in range(10)]
    rows += [(20, None), (21, ""), (22, "12 34 !"), (23, "漢字"), (None, "a row without id")]
    got = corpus_pipeline.identify_language(spark, documents(spark, rows), sf_dir)
    wanted = [(i, text, None) for i, text in rows if i not in (20, 21, 22)]
    assert kept(got, "doc_id", "text", "lang") == sorted(wanted, key=repr)
    # The only language is that of a held-out row, which teaches nothing but keeps its language.
    held = spark.range(100).where(F.crc32(F.col("id").cast("string")) % 5 == 0).first().id
    one = documents(spark, [(held, "the cat", "en"), (1000, "12", None)])
    assert kept(corpus_pipeline.identify_language(spark, one, sf_dir), "doc_id", "lang") == [(held, "en")]


def test_language_stage_keeps_texts_of_a_language_called_und(spark, sf_dir):
    rows = [(k, "the cat and the dog", "und") for k in range(10)] + [(20, "12", "und")]
    got = corpus_pipeline.identify_language(spark, documents(spark, rows), sf_dir)
    assert kept(got, "doc_id", "lang") == [(k, "und") for k in range(10)]


A, X, Y = "a b c d e f g", "x one two three four five six", "y one two three four five six"


@pytest.mark.parametrize(
    "rows, wanted",
    [
        ([(3, Y), (5, X), (5, Y), (8, X)], [(3, Y), (5, X)]),
        ([(5, A), (5, X), (8, X)], [(5, A), (5, X)]),  # the copy's first is not the least text of its id
        ([(5, X), (5, X + " x"), (5, X), (8, X), (4, A), (4, "")], [(4, ""), (4, A), (5, X)]),
        ([(3, X), (5, X), (5, X), (7, None), (7, None), (7, Y)], [(3, X), (7, None), (7, Y)]),
        ([(2, X), (2, X), (None, X), (None, X), (1, Y)], [(1, Y), (2, X), (None, X), (None, X)]),
        ([(9, X), (5, X), (6, Y), (None, Y)], [(5, X), (6, Y), (None, Y)]),
        ([], []),
    ],
)
def test_dedup_stage_of_rows_that_share_an_id(spark, sf_dir, rows, wanted):
    got = corpus_pipeline.drop_near_duplicates(spark, documents(spark, rows), sf_dir)
    assert got.columns == list(corpus_pipeline.COLUMNS)
    assert kept(got, "doc_id", "text") == sorted(wanted, key=repr)


def sets_of(text):
    words = (text or "").split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def firsts(rows):
    """Rows that stay, by comparing all (doc_id, text): the least of each component, and rows without id."""
    nodes = sorted({r for r in rows if r[0] is not None}, key=lambda r: (r[0], r[1] or ""))
    sets, top = [sets_of(t) for _, t in nodes], list(range(len(nodes)))

    def root(k):
        return k if top[k] == k else root(top[k])

    for j, s in enumerate(sets):
        for i, r in enumerate(sets[:j]):
            if s and r and 100 * len(s & r) >= 75 * len(s | r):
                a, b = sorted((root(i), root(j)))
                top[b] = a
    return [n for k, n in enumerate(nodes) if root(k) == k] + [r for r in rows if r[0] is None]


def test_dedup_stage_equals_brute_force_on_shared_ids(spark, sf_dir):
    rng = random.Random(5)
    base = [[f"w{rng.randrange(900)}" for _ in range(60)] for _ in range(6)]
    rows = []
    for _ in range(120):
        words = list(rng.choice(base))
        for _ in range(rng.randrange(3)):
            words[rng.randrange(60)] = f"v{rng.randrange(5)}"
        rows.append((rng.choice([None, *range(40)]), " ".join(words)))
    rows += [(k, " ".join(f"alone{k}-{i}" for i in range(9))) for k in range(10)]
    got = corpus_pipeline.drop_near_duplicates(spark, documents(spark, rows), sf_dir)
    assert kept(got, "doc_id", "text") == sorted(firsts(rows), key=repr)


def test_rows_that_share_an_id_have_one_component(spark, docs):
    rows = [(3, Y), (5, X), (5, Y), (5, ""), (8, X), (9, A), (7, A), (9, None), (None, X)]
    got = near_dedup.near_duplicates(docs(rows))
    assert kept(got.where("doc_id is not null"), "doc_id", "component_id", "kept") == sorted(
        [(3, 3, True)] + [(5, 3, False)] * 3 + [(8, 3, False), (7, 7, True)] + [(9, 7, False)] * 2
    )
    assert kept(got.where("doc_id is null"), "component_id", "kept") == [(None, True)]
