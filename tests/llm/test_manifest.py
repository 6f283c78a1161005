"""Manifest and proofs against a plain Merkle tree."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixeltide.llm import manifest

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("lang", T.StringType()), T.StructField("text", T.StringType())])


def sha(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return sha("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row)


def climb(level):
    """Root, and for every leaf the siblings on its way."""
    paths, at = [[] for _ in level], list(range(len(level)))
    while len(level) > 1:
        for k, i in enumerate(at):
            run = level[i // 8 * 8 : i // 8 * 8 + 8]
            paths[k] += run[: i % 8] + run[i % 8 + 1 :]
            at[k] = i // 8
        level = [sha(level[i : i + 8]) for i in range(0, len(level), 8)]
    return level[0], paths


def plain(rows):
    """Sorted (doc_id, leaf, proof), root."""
    langs = sorted({r[1] for r in rows}, key=lambda v: (v is not None, (v or "").encode()))
    trees, out = [], []
    for lang in langs:
        own = sorted((r for r in rows if r[1] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees.append((own, *climb([leaf_of(r) for r in own])))
    root, above = climb([t[1] for t in trees])
    for (own, _, paths), more in zip(trees, above):
        out += [(r[0], leaf_of(r), "".join(p + more)) for r, p in zip(own, paths)]
    return sorted(out, key=repr), root


def rows_of(sizes):
    made = [(100 * k + i * 7 % 97 + 1000 * (i // 97), lang, f"Text {i} {lang}") for k, (lang, n) in enumerate(sizes.items()) for i in range(n)]
    return made + made[:2] + [(None, "en", None), (None, "en", ""), (3, None, "é" * 50_000)]


@pytest.mark.parametrize("sizes, part", [({"en": 1}, 4096), ({"en": 600, "de": 9, "fr": 8, "ö": 1, "z": 65}, 50), ({f"l{i}": 1 + i % 3 for i in range(70)}, 16)])
def test_proofs_equal_a_plain_tree(spark, monkeypatch, sizes, part):
    monkeypatch.setattr(manifest, "PART", part)
    rows = rows_of(sizes)
    table = spark.createDataFrame(rows, SCHEMA).repartition(5)
    claimed = F.when(F.col("doc_id") % 3 == 0, F.sha2(F.lit("x"), 256)).otherwise(manifest.leaf_digest([F.col(c) for c in table.columns]))
    known = manifest.manifest(table, table.columns, claimed=claimed)
    wanted, root = plain(rows)
    assert known.root == root and known.many == known.trees.count()
    proved = manifest.multiproofs(known.leaves, known.nodes, known.many)
    places = [F.col(c) for c in ("tree", "idx", "size")]
    for name in ("leaf", "claimed"):
        proved = proved.withColumn(f"{name}_root", manifest.fold(F.col(name), *places, known.many, F.col("proof")))
    found = proved.collect()
    assert sorted(((r.key, r.leaf, r.proof) for r in found), key=repr) == wanted
    assert all(r.leaf_root == root for r in found)
    assert all((r.claimed_root == root) == (r.claimed == r.leaf) for r in found)
    # Proofs of some leaves only are the same.
    some = manifest.multiproofs(known.leaves.where("position % 5 = 1"), known.nodes, known.many).collect()
    whole = {r.position: r.proof for r in found}
    assert some and all(whole[r.position] == r.proof for r in some)


def test_only_missing_nodes_are_asked_for():
    asked = {level: nodes.tolist() for level, nodes in manifest.missing_nodes(np.arange(64, 128), 600)}
    assert asked == {0: [], 1: [], 2: [0, *range(2, 8)], 3: [1]}
    assert {level: n.tolist() for level, n in manifest.missing_nodes(np.array([3, 3]), 9)} == {0: [0, 1, 2, 4, 5, 6, 7], 1: [1]}
    assert list(manifest.missing_nodes(np.array([0]), 1)) == []


def test_tampering_is_seen_at_every_place(spark):
    leaves = [sha([str(i)]) for i in range(20)]
    root, paths = climb(leaves)
    for i, leaf in enumerate(leaves):
        proof = "".join(paths[i])
        assert manifest.folded_root(leaf, 0, i, 20, 1, proof) == root
        assert manifest.folded_root(leaf, 0, (i + 1) % 20, 20, 1, proof) != root
        assert manifest.folded_root(leaf, 0, i, 20, 1, proof[:-64]) is None or len(proof) < 64
        assert manifest.folded_root(leaf, 0, i, 20, 1, "0" * 64 + proof[64:]) != root


def test_empty_table_and_clashing_columns(spark):
    empty = manifest.manifest(spark.createDataFrame([], SCHEMA), SCHEMA.fieldNames())
    assert empty.root is None and empty.many == 0 and empty.nodes.count() == 0
    assert manifest.multiproofs(empty.leaves, empty.nodes, empty.many).count() == 0
    rows = [(1, "a", "x"), (2, "a", "y")]
    table = spark.createDataFrame(rows, SCHEMA)
    for name in ("key", "group", "leaf", "tree", "idx", "size", "position", "first", "_at", "level"):
        table = table.withColumn(name, F.lit("q"))
    assert manifest.manifest(table, SCHEMA.fieldNames()).root == plain(rows)[1]
