import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from pixeltide.llm import quality


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(1)
    bounds = np.array([0, 1, 6, 9])
    lean, pairs = rng.normal(size=9) * 2, rng.normal(size=(2, 2))
    good, expected = quality.marginals(lean, pairs, bounds)
    wanted, counts = np.zeros(9), np.zeros((2, 2))
    for a, b in zip(bounds[:-1], bounds[1:]):
        total, own, cross = 0.0, np.zeros(b - a), np.zeros((2, 2))
        for labels in itertools.product((0, 1), repeat=b - a):
            y = np.array(labels)
            w = np.exp((lean[a:b] * y).sum() + sum(pairs[i, j] for i, j in zip(y[:-1], y[1:])))
            total += w
            own += w * y
            for i, j in zip(y[:-1], y[1:]):
                cross[i, j] += w
        wanted[a:b] = own / total
        counts += cross / total
    assert np.allclose(good, wanted) and np.allclose(expected, counts)


def test_lines_cover_the_text():
    texts = ["", "a", "a\n", "\n\nb", "x\ny\nz", None, "last"]
    raw, bounds = quality.bytes_of(pa.array(texts, pa.string()))
    starts, ends, of_row = quality.lines_of(raw, bounds)
    lines = [bytes(raw[a:b]).decode() for a, b in zip(starts, ends)]
    assert [lines[a:b] for a, b in zip(of_row[:-1], of_row[1:])] == [(t or "").split("\n") for t in texts]


def test_long_chains_do_not_underflow():
    good, _ = quality.marginals(np.full(50_000, 30.0), np.array([[3.0, -3.0], [-3.0, 3.0]]), np.array([0, 50_000]))
    assert np.isfinite(good).all() and good.min() > 0.99


def test_held_out_documents_of_the_table(spark, sf_dir):
    folder = sf_dir.replace("sf0.001", "sf0.01")
    table, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    field = quality.learn(table, labels.where(~held))
    scored = table.where(held).join(labels, "doc_id").select("quality", quality.score(F.col("text"), field).alias("score"))
    rows = scored.collect()
    assert np.mean([(r.score >= 0.3) == r.quality for r in rows]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_nulls_empty_texts_clashing_columns_and_no_labels(spark, docs):
    table = docs([(1, None), (2, ""), (3, "Fine words here."), (3, "Fine words here."), (None, "a\n" * 3000)])
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (None, 0), (3, None)], "doc_id long, quality int")
    for known in (labels, labels.where("false")):
        field = quality.learn(table.withColumns({"id": F.lit(1), "label": F.lit(2)}), known)
        got = table.select("doc_id", quality.score(F.col("text"), field).alias("score")).collect()
        assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
        by = {r.doc_id: r.score for r in got}
        assert by[1] == by[2]
    assert {r.score for r in got} == {0.5}
    assert docs([]).select(quality.score(F.col("text"), field)).collect() == []
