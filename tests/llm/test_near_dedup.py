import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixeltide.llm import near_dedup
from pixeltide.llm.components import components
from pixeltide.llm.shingles import band_keys, min_max


def shingles(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", lowered)
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def brute(rows):
    """{doc_id: (shingles, component)} by comparing all documents that share a shingle."""
    sets = {i: shingles(t) for i, t in rows}
    where, parent = defaultdict(list), {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in sets.items():
        common = Counter(j for x in s for j in where[x])
        for j, n in common.items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
        for x in s:
            where[x].append(i)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return words


def test_equals_brute_force_on_copies_chains_and_lookalikes(spark, docs, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 20_000)  # so that groups need several blocks
    rng = random.Random(3)
    base = [f"w{rng.randrange(5000)}" for _ in range(200)]
    texts = [" ".join(base)] * 20
    texts += [" ".join(edited(rng, base, rng.randrange(1, 12))) for _ in range(120)]  # around the threshold
    chain = base[:]
    for _ in range(30):  # each is near the one before, the ends are far apart
        chain = edited(rng, chain, 3)
        texts.append(" ".join(chain))
    texts += [" ".join(base[:100] + [f"x{rng.randrange(9999)}" for _ in range(100)]) for _ in range(40)]
    texts += ["", None, "one", "ONE", "one two three", "One\ttwo\nthree", "é É", "long " * 30000, "   "]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    got = result(near_dedup.near_duplicates(docs(rows)))
    assert got == brute(rows)
    assert len({c for _, c in got.values()}) > 20


def test_whole_tables_equal_brute_force(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()]
    assert result(near_dedup.near_duplicates(table)) == brute(rows)


def test_nulls_repeated_rows_extra_columns_and_empty_tables(spark, docs):
    text = "a b c d e f g"
    df = docs([(3, text), (3, text), (1, text), (None, text), (None, None), (9, None)])
    df = df.withColumns({"component_id": F.lit("x"), "kept": F.lit(1), "rep": F.lit(2), "hub": F.lit(3)})
    got = near_dedup.near_duplicates(df)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    rows = sorted((tuple(r) for r in got.collect()), key=repr)
    assert rows == sorted(
        [(3, 3, 1, False)] * 2 + [(1, 3, 1, True), (None, 3, None, True), (None, 0, None, True), (9, 0, 9, True)], key=repr
    )
    assert near_dedup.near_duplicates(docs([])).collect() == []


def test_signature_values_agree_as_often_as_the_sets_are_alike():
    rng = np.random.default_rng(1)
    agree = []
    for _ in range(60):
        x = rng.integers(0, 2**63, 400).astype(np.uint64)
        one, two = x[:350], x[50:]  # similarity 300 / 400
        a, b = min_max(one, 80), min_max(two, 80)
        agree.append(np.mean([a[0] == b[0], a[1] == b[1]]))
    assert np.mean(agree) == pytest.approx(0.75, abs=0.02)
    low, high = min_max(one, 80)
    assert len(set(band_keys(low, high, 4).tolist())) == 40


def test_components_of_long_paths_stars_and_nothing(spark):
    path = [(i, i + 1) for i in range(100, 160)]
    star = [(500, i) for i in range(501, 540)] + [(7, 539)]
    links = spark.createDataFrame([*path, *star, (3, 3), (100, 101)], "a long, b long")
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 7 for i in (7, *range(500, 540))}}
    assert components(links.where("a < 0")).collect() == []
