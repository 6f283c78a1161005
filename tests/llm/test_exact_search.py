import numpy as np
import pytest

from pixeltide.llm import exact_search
from pixeltide.sources.shared_folder import stored

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, queries, k=5):
    codes = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            codes[i] = np.floor(np.array(v, np.float32).astype(float) * 256).astype(int)
    out = []
    for q in sorted(set(queries) & set(codes)):
        scores = []
        for i, c in codes.items():
            n = min(len(c), len(codes[q]))
            if i != q:
                scores.append((-int(c[:n] @ codes[q][:n]), i))
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return out


def search(df, condition, k=5):
    return sorted(tuple(r) for r in exact_search.top_k(df, df.where(condition), k).collect())


@pytest.mark.parametrize("group_rows", [40, 4096])
def test_equals_brute_force(spark, monkeypatch, group_rows):
    monkeypatch.setattr(exact_search, "GROUP_ROWS", group_rows)
    monkeypatch.setattr(exact_search, "BLOCK_ROWS", 8)
    monkeypatch.setattr(exact_search, "CHUNK", 20)
    rng = np.random.default_rng(2)
    centre = rng.normal(size=(5, 12))
    vectors = [(i, (centre[i % 5] + 0.2 * rng.normal(size=12)).astype(np.float32).tolist()) for i in range(500)]
    vectors += [(i, [0.5] * 12) for i in range(500, 560)]  # ties beyond the fifth place
    df = spark.createDataFrame(vectors, SCHEMA)
    queries = [i for i, _ in vectors if i % 7 == 0]
    assert search(df, "vec_id % 7 = 0") == brute(vectors, queries)


def test_unfit_vectors_short_vectors_and_few_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, -1.0]), (1, None), (2, [nan, 1.0]), (3, [1.0, None]), (4, [inf, 0.0]),
        (5, [0.5]), (6, []), (None, [1.0, 1.0]), (7, [-0.001, 0.0]),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    assert search(df, "true") == brute(rows, range(8))
    assert search(df, "vec_id = 0") == [(0, 1, 5, 32768), (0, 2, 6, 0), (0, 3, 7, -256)]
    assert search(df.where("vec_id = 0"), "true") == []
    assert search(df.where("vec_id = 1"), "true") == []
    assert search(df.where("false"), "true") == []


def test_large_components_are_scored_exactly(spark, monkeypatch):
    """Sums that 64-bit floats would round, beyond a long, and components of every size beside one another."""
    monkeypatch.setattr(exact_search, "GROUP_ROWS", 12)
    monkeypatch.setattr(exact_search, "BLOCK_ROWS", 4)
    rng = np.random.default_rng(6)
    big = [(i, [float(rng.integers(2**21, 2**22)) * s for s in (1, -1, 1)]) for i in range(40)]
    small = [(i, rng.normal(size=3).astype(np.float32).tolist()) for i in range(40, 80)]
    rows = big + small + [(80, [1e9, 1.0, 0.0]), (81, [-1e9, 1.0, 1e-3]), (82, [3e38, 3e38, 0.0]), (83, [3e38, -3e38, 1.0])]
    df = spark.createDataFrame(rows, SCHEMA)
    code = {i: [int(np.floor(float(np.float32(x)) * 256)) for x in v] for i, v in rows}
    expected = []
    for q in sorted(code):
        scores = [(-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(code[q], c)))), i) for i, c in code.items() if i != q]
        expected += [(q, rank, i, -s) for rank, (s, i) in enumerate(sorted(scores)[:5], 1)]
    assert search(df, "true") == expected


def test_groups_are_skipped_and_walked_by_falling_bound(spark, monkeypatch):
    """Queries meet the extremes of groups on several shelves, and few groups are sent a query."""
    monkeypatch.setattr(exact_search, "GROUP_ROWS", 20)
    monkeypatch.setattr(exact_search, "SHELF", 4)
    written = {}
    monkeypatch.setattr(exact_search, "stored", lambda df, name: written.setdefault(name, []).append(stored(df, name)) or written[name][-1])
    rng = np.random.default_rng(7)
    centre = 4 * rng.normal(size=(12, 6))
    rows = [(i, (centre[i % 12] + 0.1 * rng.normal(size=6)).astype(np.float32).tolist()) for i in range(600)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert search(df, "vec_id % 5 = 0") == brute(rows, range(0, 600, 5))
    groups = written["index"][0].count()
    assert written["shelves"][0].count() == -(-groups // 4) > 1
    sent = sum(len(r.queries) for due in written["visits"] for r in due.collect())
    assert 0 < sent < 120 * groups / 3


def test_blocks_are_skipped(spark):
    """With tight clusters, most blocks are never scored."""
    rng = np.random.default_rng(4)
    x = np.repeat(rng.normal(size=(16, 8)) * 100, 64, 0) + rng.normal(size=(1024, 8))
    blocks = exact_search._blocks(np.floor(x))
    order = np.concatenate(blocks)
    x = np.floor(x)[order]
    row = {
        "ids": order.astype(np.int64).tobytes(),
        "codes": x.tobytes(),
        "sizes": np.array([len(b) for b in blocks], np.int64).tobytes(),
        "high": np.stack([p.max(0) for p in np.split(x, len(blocks))]).tobytes(),
        "low": np.stack([p.min(0) for p in np.split(x, len(blocks))]).tobytes(),
    }
    group = exact_search.Group(row, 8)
    scored = []

    class Counted(np.ndarray):
        def __getitem__(self, key):
            if isinstance(key, slice):
                scored.append(key)
            return np.asarray(self)[key]

    group.x = group.x.view(Counted)
    at, found, score = group.search(np.array([-1]), x[:1], np.array([exact_search.LOWEST]), 5)
    assert sorted(score.tolist(), reverse=True) == sorted((x @ x[0]).astype(int).tolist(), reverse=True)[:5]
    assert len(scored) <= len(blocks) / 2
