"""Hard negatives against all scores computed one by one."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixeltide.llm import hard_negatives as hn

SCHEMA = T.StructType(
    [T.StructField("vec_id", T.LongType()), T.StructField("label", T.IntegerType()), T.StructField("embedding", T.ArrayType(T.DoubleType()))]
)
LOWEST, HIGHEST = -(2**63), 2**63 - 1


def brute(rows, anchors, positives=5, negatives=3):
    known = set()
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) or not math.isfinite(x * 256) for x in v):
            continue
        known.add((i, label, tuple(math.floor(256 * x) for x in v)))
    out = []
    for a in known:
        if a[0] not in anchors:
            continue
        scored = sorted((-max(LOWEST, min(HIGHEST, sum(x * y for x, y in zip(a[2], c[2])))), c[0], c[1]) for c in known if c[0] != a[0])
        for s, i, _ in [c for c in scored if c[2] == a[1]][:positives]:
            fits = [(n, j) for n, j, label in scored if label != a[1] and 50 * -s <= 100 * -n <= 95 * -s][:negatives]
            out += [(a[0], i, rank, j, -s, -n) for rank, (n, j) in enumerate(fits, 1)]
    return sorted(out)


def found(spark, rows, anchors, **more):
    table = spark.createDataFrame(rows, SCHEMA)
    ids = spark.createDataFrame([(i,) for i in anchors], "vec_id long")
    return sorted(map(tuple, hn.hard_negatives(table, ids, **more).collect()))


def clustered(seed, n, width=8, labels=4):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(5)]
    rows = []
    for i in range(n):
        size = rng.choice([0.2, 1, 1, 3])
        rows.append((i, rng.randrange(labels), [size * (c + rng.gauss(0, 0.4)) for c in rng.choice(centres)]))
    return rows


ODD = [
    (None, 1, [1.0] * 8), (1001, None, [1.0] * 8), (1002, 1, None), (1003, 1, [1.0, None]), (1004, 2, [math.nan] * 8), (1005, 2, [math.inf]),
    (1006, 0, []), (1007, 0, [0.0] * 8), (1008, 1, [1.0, 2.0]), (1009, 1, [1e305] * 8), (1010, 3, [-0.001] * 8),
]


@pytest.mark.parametrize("seed, rows, group, block", [(1, 300, 4096, 64), (2, 400, 40, 8)])
def test_equal_to_brute_force(spark, monkeypatch, seed, rows, group, block):
    monkeypatch.setattr(hn, "GROUP_ROWS", group)
    monkeypatch.setattr(hn, "BLOCK_ROWS", block)
    monkeypatch.setattr(hn, "CHUNK", 7)
    rows = clustered(seed, rows) + ODD
    rows += rows[:30]  # repeated rows count once
    anchors = [*range(0, 300, 11), 1006, 1007, 1008, 1010, 5000]
    assert found(spark, rows, anchors) == brute(rows, set(anchors)) != []


def test_ties_go_to_smaller_ids(spark):
    rows = [(i, i % 3, [1.0, 0.5 + (i // 6) / 4]) for i in range(48)]
    anchors = {0, 7, 40}
    assert found(spark, rows, anchors) == brute(rows, anchors) != []


def test_scores_beyond_exact_floats(spark):
    rng = random.Random(9)
    # Codes of about 2**28, whose products differ by less than a 64-bit float tells.
    rows = [(i, i % 3, [2.0**20 * (0.4 + i / 100) + rng.random() for _ in range(4)]) for i in range(60)]
    rows += [(90 + i, i % 3, [1e30 * (i + 1), -1e30, 3.0, 1.0]) for i in range(6)]
    anchors = {0, 10, 20, 91, 94}
    assert found(spark, rows, anchors) == brute(rows, anchors) != []


def test_bounds_hold_every_score():
    rng = np.random.default_rng(3)
    for scale in (1.0, 1e6):
        x = np.floor(rng.normal(size=(80, 6)) * 256 * scale)
        x[0] = 0
        x[2] = x[1]
        directions = hn.directions_of(x, 4)
        shell = hn.Shell.of(hn.angles_to(x, directions).astype(np.float32).astype(float), hn.norms_of(x))
        lower, upper = hn.score_bounds(shell[:, None], shell[None])
        scores = x @ x.T
        scores = np.clip(scores, float(LOWEST), float(HIGHEST))
        assert (lower <= scores).all() and (scores <= upper).all()


def test_most_rows_are_not_scored():
    rows = [r for r in clustered(5, 3000, labels=2)]
    x = np.floor(np.array([r[2] for r in rows]) * 256)
    directions = hn.directions_of(x)
    angles = hn.angles_to(x, directions).astype(np.float32)
    table = {
        "codes": [r.tobytes() for r in x], "vec_id": np.arange(3000), "label": np.array([r[1] for r in rows]),
        "angles": list(angles), "norm": hn.norms_of(x), "cell": np.zeros(3000, np.int32),
    }
    built = hn._group(8, len(directions))((pa.scalar(0, pa.int32()), pa.scalar(0, pa.int64())), pa.table(table)).to_pylist()[0]
    group = hn.Group(built, 8, len(directions))
    asked = [
        {"anchor": k, "vec_id": k, "label": rows[k][1], "cell": 0, "codes": x[k].tobytes(), "angles": angles[k],
         "windows": [{"place": 0, "least": LOWEST, "most": HIGHEST}]}
        for k in range(40)
    ]
    group.search(hn.Anchors(asked, 8, len(directions)), True, True, 5)
    assert group.scored < 0.5 * 40 * 1500


def test_empty_tables_clashes_and_arguments(spark):
    assert found(spark, [], [1]) == [] == found(spark, clustered(1, 20), [])
    assert found(spark, ODD[:6], [1001]) == []
    rows = clustered(4, 60)
    table = spark.createDataFrame(rows, SCHEMA).select(F.col("vec_id").alias("score"), F.col("label").alias("anchor"), F.col("embedding").alias("vector"), F.lit(1).alias("vec_id"), F.lit("q").alias("cell"))
    ids = table.where("score in (0, 7)").select("score")
    got = hn.hard_negatives(table, ids, id_col="score", label_col="anchor", vector_col="vector")
    assert sorted(map(tuple, got.collect())) == brute(rows, {0, 7}) != []
    with pytest.raises(ValueError):
        hn.hard_negatives(table, ids, percent=(60, 50))
