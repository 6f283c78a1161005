"""Merkle manifest of a table, and proofs of its rows by octopus multiproofs.

Manifest. A row's leaf is the hash of its columns. The leaves of a group (a
language, say) lie in order of their key and form a tree: every ``FAN``
consecutive nodes of a level have one node above them, until a single one, the
subroot, is left. The subroots, ordered by group, are the leaves of the top
tree, whose last node is the root. A node has the coordinates (tree, level,
idx); trees are numbered by group, the top tree is number -1.

Order. Rows are ranged and sorted by (group, key, leaf) and numbered within
their partition; only the number of rows of each partition is cumulated, so no
group is ever in one task, however many rows it has.

Proofs. Consecutive leaves are dealt into parts of at most ``PART`` leaves. A
part works out which coordinates its leaves' paths need and it cannot derive:
per level, the members of the runs its known nodes lie in, without those nodes.
That minimal union of missing nodes is fetched once, by one join for all parts.
The part then derives all interior nodes it shares between leaves, once each,
and expands them to a proof for each leaf without any further data. A part that
has whole subtrees fetches a few nodes on its borders and above them only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixeltide.sources.shared_folder import stored

#: Children of a node; levels built from one shuffle; leaves of a part that proves its leaves together.
FAN, LEVELS, PART = 8, 4, 4096
#: Number of the tree over the subroots.
TOP = -1


class Manifest(NamedTuple):
    """Written tables of a manifest, its root (None for an empty table) and number of trees.

    ``leaves``: key, group, leaf, claimed, position, tree, idx, size (leaves of
    the tree). ``trees``: tree, group, size, subroot. ``nodes``: tree, level,
    idx, digest of every node, leaves and root included.
    """

    leaves: DataFrame
    trees: DataFrame
    nodes: DataFrame
    root: str | None
    many: int


def leaf_digest(columns: Sequence[Column]) -> Column:
    """Hash of a row: the SHA-256 of its values, each ``-`` if null, else byte count, ``:`` and the value as text."""
    told = []
    for c in columns:
        text = c.cast("string")
        told.append(F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text), F.lit(":"), text)))
    return F.sha2(F.concat(*told), 256)


def with_position(rows: DataFrame, *order: str) -> DataFrame:
    """``rows``, written, plus ``position``: their number from 0 by ``order``, nulls first. Equal rows may swap places."""
    by = [F.asc_nulls_first(c) for c in order]
    ranged = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    ranged = stored(ranged.withColumn("_at", F.monotonically_increasing_id()), "ordered")
    ranged = ranged.withColumn("_part", F.shiftright("_at", 33))
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_rows"))
    # One row per partition, so this order holds few rows.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = stored(counts.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_base")), "bases")
    within = F.col("_at") - F.shiftleft("_part", 33)
    return ranged.join(bases, "_part").withColumn("position", F.col("_base") + within).drop("_at", "_part", "_base")


def _height(size: Column) -> Column:
    """Levels above the leaves of a tree of ``size`` leaves."""
    return sum((F.when(size > FAN**level, 1).otherwise(0) for level in range(1, 21)), F.when(size > 1, 1).otherwise(0))


def _above(nodes: str) -> Column:
    """Digests of the level above an array of digests."""
    runs = F.sequence(F.lit(0), F.expr(f"cast((size({nodes}) - 1) div {FAN} as int)"))
    return F.transform(runs, lambda i: F.sha2(F.array_join(F.slice(nodes, i * FAN + 1, FAN), ""), 256))


def _built(base: DataFrame, level: int) -> DataFrame:
    """The ``LEVELS`` levels above ``base(tree, idx, digest, size, many)``, nodes of one level: tree, level, idx, digest, size.

    ``many`` is the number of nodes the tree has on that level. One shuffle
    brings the nodes under one node of the last level together.
    """
    wide = FAN**LEVELS
    rows = base.groupBy("tree", F.expr(f"idx div {wide}").alias("block")).agg(
        F.first("size").alias("size"),
        F.first("many").alias("many"),
        F.transform(F.array_sort(F.collect_list(F.struct("idx", "digest"))), lambda n: n["digest"]).alias("level0"),
    )
    none = F.expr("cast(array() as array<struct<level:int,idx:bigint,digest:string>>)")

    def placed(up: int) -> Column:
        first = F.col("block") * FAN ** (LEVELS - up)
        nodes = F.transform(
            f"level{up}", lambda d, i: F.struct(F.lit(level + up).alias("level"), (first + i).alias("idx"), d.alias("digest"))
        )
        return F.when(F.col("many") > FAN ** (up - 1), nodes).otherwise(none)

    for up in range(1, LEVELS + 1):
        rows = rows.withColumn(f"level{up}", _above(f"level{up - 1}"))
    found = [placed(up) for up in range(1, LEVELS + 1)]
    return rows.select("tree", "size", F.explode(F.flatten(F.array(*found))).alias("node")).select(
        "tree", "node.level", "node.idx", "node.digest", "size"
    )


def build(leaves: DataFrame) -> DataFrame:
    """All nodes (tree, level, idx, digest, size) over ``leaves(tree, idx, digest, size)``, written; level 0 are the leaves."""
    leaves = leaves.select("tree", F.lit(0).alias("level"), "idx", "digest", "size")
    most = leaves.agg(F.max("size")).first()[0] or 0
    nodes, base, level = leaves, leaves, 0
    while most > FAN**level:
        under = F.ceil(F.col("size") / F.lit(float(FAN**level))).cast("long")
        base = base.where(F.col("size") > FAN**level).withColumn("many", under)
        built = stored(_built(base, level), "nodes")
        nodes = nodes.unionByName(built)
        level += LEVELS
        base = built.where(F.col("level") == level)
    return nodes


def manifest(
    rows: DataFrame, columns: Sequence[str], key_col: str = "doc_id", group_col: str = "lang", claimed: Column | None = None
) -> Manifest:
    """The manifest of ``rows``: a leaf for each row, a tree for each value of ``group_col``.

    ``columns`` are hashed, in their order, as ``leaf_digest`` says. Leaves
    ascend by ``key_col``, rows without key first, rows of one key by their
    leaf; repeated rows have leaves of their own. A null group is a group, the
    first one. ``claimed`` is the digest somebody states for a row, kept with
    its leaf (default: the leaf). Other columns of ``rows`` play no part. An
    empty table has no tree and no root.
    """
    leaf = leaf_digest([F.col(c) for c in columns])
    known = rows.select(
        F.col(key_col).alias("key"),
        F.col(group_col).alias("group"),
        leaf.alias("leaf"),
        (leaf if claimed is None else claimed).alias("claimed"),
    )
    leaves = stored(with_position(known, "group", "key", "leaf"), "leaves")
    trees = leaves.groupBy("group").agg(F.min("position").alias("first"), F.count("*").alias("size"))
    trees = stored(with_position(trees, "group").withColumnRenamed("position", "tree"), "trees")
    same = leaves["group"].eqNullSafe(trees["group"])
    placed = leaves.join(trees, same).select(
        "key", leaves["group"], "leaf", "claimed", "position", "tree", (F.col("position") - F.col("first")).alias("idx"), "size"
    )
    placed = stored(placed, "placed")
    nodes = build(placed.select("tree", "idx", F.col("leaf").alias("digest"), "size"))
    subroots = nodes.where(F.col("level") == _height(F.col("size"))).select("tree", F.col("digest").alias("subroot"))
    trees = stored(trees.select("tree", "group", "size").join(subroots, "tree"), "subroots")
    many = trees.count()
    top = build(trees.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("idx"), F.col("subroot").alias("digest"), F.lit(many).cast("long").alias("size")))
    last = top.where(F.col("level") == _height(F.col("size"))).first()
    nodes = nodes.unionByName(top).select("tree", "level", "idx", "digest")
    return Manifest(placed, trees, nodes, last["digest"] if last else None, many)


def _levels(size: int) -> Iterator[tuple[int, int]]:
    """(level, nodes on it) of a tree, the last node's level left out."""
    level = 0
    while size > 1:
        yield level, size
        level, size = level + 1, -(-size // FAN)


def missing_nodes(known: np.ndarray, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(level, idx) of the nodes that proofs of the leaves ``known`` of one tree need and cannot derive from them."""
    known = np.unique(known)
    for level, many in _levels(size):
        runs = np.unique(known // FAN)
        members = (runs[:, None] * FAN + np.arange(FAN)).ravel()
        yield level, np.setdiff1d(members[members < many], known, assume_unique=True)
        known = runs


def siblings(known: dict[int, str], size: int, fetched: dict[int, dict[int, str]]) -> tuple[str, list[dict[int, str]]]:
    """Root of a tree, and for each level the joined sibling digests of every node on a path of ``known``.

    ``fetched`` holds, by level, what ``missing_nodes`` names. Every interior node is derived once.
    """
    beside = []
    for level, many in _levels(size):
        have = known | fetched.get(level, {})
        own, above = {}, {}
        for run in {i // FAN for i in known}:
            first = run * FAN
            digests = [have[i] for i in range(first, min(first + FAN, many))]
            above[run] = hashlib.sha256("".join(digests).encode()).hexdigest()
            for i in range(len(digests)):
                if first + i in known:
                    own[first + i] = "".join(digests[:i] + digests[i + 1 :])
        beside.append(own)
        known = above
    (root,) = known.values()
    return root, beside


def _path(beside: list[dict[int, str]], above: str) -> dict[int, str]:
    """Proof of every leaf: its siblings level by level, then ``above``."""
    proofs: dict[int, str] = {}
    for level, own in reversed(list(enumerate(beside))):
        proofs = {i: s + (proofs[i // FAN] if level + 1 < len(beside) else above) for i, s in own.items()}
    return proofs


def _by_tree(rows: pa.Table) -> Iterator[tuple[int, int, np.ndarray]]:
    """(tree, size, rows) of every tree in a part."""
    tree, size = rows["tree"].to_numpy(), rows["size"].to_numpy()
    for t in np.unique(tree):
        at = np.flatnonzero(tree == t)
        yield int(t), int(size[at[0]]), at


def _missing(many: int):
    def missing(key: tuple, rows: pa.Table) -> pa.Table:
        idx, wanted = rows["idx"].to_numpy(), []
        for tree, size, at in _by_tree(rows):
            wanted += [(tree, level, nodes) for level, nodes in missing_nodes(idx[at], size)]
        trees = np.unique(rows["tree"].to_numpy())
        wanted += [(TOP, level, nodes) for level, nodes in missing_nodes(trees, many)]
        sizes = [len(nodes) for _, _, nodes in wanted]
        place = np.concatenate([nodes for _, _, nodes in wanted] or [np.zeros(0, np.int64)])
        return pa.table(
            {
                "part": pa.array(np.full(len(place), key[0].as_py(), np.int64)),
                "tree": pa.array(np.repeat(np.array([t for t, _, _ in wanted], np.int64), sizes)),
                "level": pa.array(np.repeat(np.array([v for _, v, _ in wanted], np.int32), sizes)),
                "idx": pa.array(place.astype(np.int64)),
            }
        )

    return missing


def _expanded(many: int):
    def expand(key: tuple, rows: pa.Table, fetched: pa.Table) -> pa.Table:
        nodes: dict[int, dict[int, dict[int, str]]] = {}
        for tree, level, i, digest in zip(*(fetched[c].to_pylist() for c in ("tree", "level", "idx", "digest"))):
            nodes.setdefault(tree, {}).setdefault(level, {})[i] = digest
        idx, leaf, proofs, subroots, paths = rows["idx"].to_pylist(), rows["leaf"].to_pylist(), [""] * len(rows), {}, {}
        for tree, size, at in _by_tree(rows):
            subroots[tree], paths[tree] = siblings({idx[k]: leaf[k] for k in at}, size, nodes.get(tree, {}))
        _, beside = siblings(subroots, many, nodes.get(TOP, {}))
        above = _path(beside, "")
        for tree, _, at in _by_tree(rows):
            found = _path(paths[tree], above.get(tree, ""))
            for k in at:
                proofs[k] = found.get(idx[k], above.get(tree, ""))
        return rows.append_column("proof", pa.array(proofs, pa.string())).drop_columns(["part"])

    return expand


def multiproofs(wanted: DataFrame, nodes: DataFrame, many: int) -> DataFrame:
    """``wanted`` (leaves of a manifest, all or any) plus ``proof``: the siblings' digests level by level, joined.

    Level 0 comes first, then up to the subroot and on to the root; within a
    level, siblings stand from left to right. ``nodes`` and ``many`` are the
    manifest's.
    """
    dealt = wanted.withColumn("part", F.expr(f"position div {PART}"))
    requests = dealt.select("part", "tree", "idx", "size").groupBy("part").applyInArrow(
        _missing(many), "part long, tree long, level int, idx long"
    )
    fetched = requests.join(nodes, ["tree", "level", "idx"])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in wanted.schema) + ", proof string"
    return dealt.groupBy("part").cogroup(fetched.groupBy("part")).applyInArrow(_expanded(many), schema)


def folded_root(leaf: str, tree: int, idx: int, size: int, many: int, proof: str) -> str | None:
    """The root that a leaf's digest and its proof lead to; None if the proof has not the length its place asks for."""
    at, step = 0, len(leaf)
    for place, leaves in ((idx, size), (tree, many)):
        for _, nodes in _levels(leaves):
            others = min(FAN, nodes - place // FAN * FAN) - 1
            side = proof[at : at + others * step]
            cut = place % FAN * step
            leaf = hashlib.sha256((side[:cut] + leaf + side[cut:]).encode()).hexdigest()
            at, place = at + others * step, place // FAN
    return leaf if at == len(proof) else None


def fold(leaf: Column, tree: Column, idx: Column, size: Column, many: int, proof: Column) -> Column:
    """Column form of ``folded_root``; null for null."""

    @F.arrow_udf("string")
    def roots(*columns: pa.Array) -> pa.Array:
        rows = zip(*(c.to_pylist() for c in columns))
        return pa.array(
            [None if None in row else folded_root(*row[:4], many, row[4]) for row in rows], pa.string()
        )

    return roots(leaf, tree, idx, size, proof)
