"""Exact top-k search by inner product, block at a time.

Vectors are turned into integers and dealt into groups: near vectors first (the
nearest of a few centres fitted on a bounded sample), then by hash, so groups
have a bounded size. Inside a group the vectors are cut into blocks, halving
along the widest dimension until a block has at most ``BLOCK_ROWS`` rows. A
group is one row: its vectors block by block (the forward index), and per block
and for the whole group the maximum and minimum of every dimension.

A query's bound for a block or group is the sum, over dimensions, of its
component times the maximum (or minimum, for a negative component). A query
first searches the group it lies in, which gives it a k-th score to start from.
The extremes of all other groups, ``SHELF`` groups a row, then meet the queries:
only a group whose bound reaches the query's k-th score is sent that query.
The ``FIRST`` groups of the greatest bounds go first and raise the k-th score,
the rest follow. Inside a group blocks are taken by falling bound and scored in
full; as soon as the bound is below the k-th score, the rest is skipped. Equal
bounds are scored, so ties are right. Skipping never changes the result.

Components are whole numbers in 64-bit floats. Where sums of products may leave
the range in which these are exact, bounds are widened and scores are computed
in Python's integers; a score beyond a long counts as the long's limit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixeltide.llm.hard_negatives import EXACT, HIGHEST, LOWEST, matrix, scores_of
from pixeltide.sources.shared_folder import stored

#: Rows of a block; rows a group is meant to have; queries searched together.
BLOCK_ROWS, GROUP_ROWS, CHUNK = 64, 4096, 2048
#: Centres, and vectors they are fitted on.
CENTRES, SAMPLED = 32, 4096
#: Components are cut to this where only the choice of a centre depends on them.
FARTHEST = 1e100
#: Groups whose extremes lie in one row, and groups of a shelf that a query visits before the others.
SHELF, FIRST = 256, 2
#: Place of a result that is not there yet.
NOBODY = np.iinfo(np.int64).max


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """vec_id, codes: floor(scale * x) of each component as 64-bit floats; unfit vectors are left out."""

    def quantise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, codes = [], []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1)):
                if i is None or not v.is_valid or v.values.null_count:
                    continue
                with np.errstate(over="ignore", invalid="ignore"):
                    x = np.floor(v.values.to_numpy(zero_copy_only=False).astype(np.float64) * scale)
                if np.isfinite(x).all():
                    ids.append(i)
                    codes.append((x + 0.0).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(codes, pa.binary())], names=["vec_id", "codes"])

    return vectors.select(F.col(id_col).cast("long"), vector_col).mapInArrow(quantise, "vec_id long, codes binary")


def centres_of(sample: np.ndarray, many: int = CENTRES, rounds: int = 8) -> np.ndarray:
    """Centres of a sample by a few rounds of Lloyd's method; any centres give the right result."""
    sample = np.clip(sample, -FARTHEST, FARTHEST)
    centres = sample[:: max(1, len(sample) // many)][:many].copy()
    for _ in range(rounds if len(sample) else 0):
        nearest = (sample @ centres.T - (centres**2).sum(1) / 2).argmax(1)
        for c in range(len(centres)):
            if (nearest == c).any():
                centres[c] = sample[nearest == c].mean(0)
    return centres


def _blocks(x: np.ndarray) -> list[np.ndarray]:
    """Row numbers of the blocks of a group."""
    done, todo = [], [np.arange(len(x))]
    while todo:
        rows = todo.pop()
        if len(rows) <= BLOCK_ROWS:
            done.append(rows)
            continue
        part = x[rows]
        order = part[:, (part.max(0) - part.min(0)).argmax()].argsort(kind="stable")
        todo += [rows[order[len(rows) // 2 :]], rows[order[: len(rows) // 2]]]
    return done


def _group(width: int):
    def build(key: tuple, rows: pa.Table) -> pa.Table:
        x, ids = matrix(rows["codes"].to_pylist(), width), rows["vec_id"].to_numpy()
        blocks = _blocks(x)
        order, sizes = np.concatenate(blocks), np.array([len(b) for b in blocks], np.int64)
        high = np.stack([x[b].max(0) for b in blocks])
        low = np.stack([x[b].min(0) for b in blocks])
        return pa.table(
            {
                "group": pa.array([key[0].as_py()], pa.int64()),
                "ids": [ids[order].tobytes()],
                "codes": [x[order].tobytes()],
                "sizes": [sizes.tobytes()],
                "high": [high.tobytes()],
                "low": [low.tobytes()],
                "highest": [high.max(0).tobytes()],
                "lowest": [low.min(0).tobytes()],
            }
        )

    return build


def bounds_of(queries: np.ndarray, high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Greatest possible score [query, set] within the extremes of sets, and the greatest sum of absolute products."""
    with np.errstate(over="ignore", invalid="ignore"):
        bound = np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T
        most = np.abs(queries) @ np.maximum(np.abs(high), np.abs(low)).T
        wide = np.where(most < EXACT, 0, most * 1e-9 + 1)  # far more than what rounding loses
        bound = bound + wide
    bound = np.where(np.isnan(bound) | np.isnan(most), np.inf, bound)
    return np.clip(bound, float(LOWEST), float(HIGHEST)), np.where(np.isnan(most), np.inf, most)  # as scores are


class Queries:
    """Queries of one row: ids, codes, and the least score a result must have."""

    def __init__(self, rows: list[dict], width: int):
        self.ids = np.array([q["vec_id"] for q in rows], np.int64)
        self.x = matrix([q["codes"] for q in rows], width)
        self.floor = np.array([LOWEST if q["floor"] is None else q["floor"] for q in rows], np.int64)


class Group:
    """A group of vectors, read from its row."""

    def __init__(self, row: dict, width: int):
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.x = np.frombuffer(row["codes"]).reshape(-1, width)
        self.bounds = np.concatenate([[0], np.cumsum(np.frombuffer(row["sizes"], np.int64))])
        self.high, self.low = (np.frombuffer(row[c]).reshape(-1, width) for c in ("high", "low"))

    def search(self, ids: np.ndarray, queries: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of the query, vec_id, score) of each query's best k here that reach its ``floor``."""
        bound, most = bounds_of(queries, self.high, self.low)
        order = np.argsort(-bound, axis=1, kind="stable")
        best = np.full((len(queries), k), LOWEST)
        best_id = np.full((len(queries), k), NOBODY)
        least = floor.copy()
        for nth in range(order.shape[1]):
            block = order[:, nth]
            going = np.flatnonzero(bound[np.arange(len(queries)), block] >= least.astype(float))
            if not len(going):
                break
            going = going[np.argsort(block[going], kind="stable")]
            cuts = np.flatnonzero(np.diff(block[going], prepend=-1, append=-1))
            for a, b in zip(cuts[:-1], cuts[1:]):
                rows, at = going[a:b], block[going[a]]
                lo, hi = self.bounds[at], self.bounds[at + 1]
                scores = scores_of(queries[rows], self.x[lo:hi], most[rows, at].max())
                found = np.broadcast_to(self.ids[lo:hi], scores.shape)
                own = found == ids[rows, None]
                scores, found = np.where(own, LOWEST, scores), np.where(own, NOBODY, found)
                scores, found = np.concatenate([best[rows], scores], 1), np.concatenate([best_id[rows], found], 1)
                # ~ turns the order of integers round without leaving their range.
                top = np.lexsort((found, ~scores), axis=1)[:, :k]
                best[rows], best_id[rows] = np.take_along_axis(scores, top, 1), np.take_along_axis(found, top, 1)
            least = np.where(best_id[:, -1] != NOBODY, np.maximum(least, best[:, -1]), least)
        row, rank = np.nonzero((best_id != NOBODY) & (best >= floor[:, None]))
        return row, best_id[row, rank], best[row, rank]


def top_k(
    vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256,
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` vectors with the greatest integer inner product to each query.

    ``queries`` are rows of ``vectors`` (the same columns); a query does not find
    itself. Components count as floor(scale * x); ties go to the smaller vec_id.
    Vectors that are null, without id, or hold null or non-finite components (also
    after scaling) take no part; any finite component does. Missing components of shorter vectors are zeros. All (fewer
    than ``k``) are returned if there are no more.
    """
    spark = vectors.sparkSession
    codes = stored(quantised(vectors, id_col, vector_col, scale), "codes")
    width = codes.agg(F.max(F.length("codes"))).first()[0]
    schema = "query_id long, rank int, vec_id long, score long"
    width = max(1, (width or 0) // 8)
    sample = codes.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLED).select("codes")
    centres = centres_of(matrix([r[0] for r in sample.collect()], width))
    if not len(centres):
        return spark.createDataFrame([], schema)

    @F.arrow_udf("int")
    def cell(batch: pa.Array) -> pa.Array:
        x = np.clip(matrix(batch.to_pylist(), width), -FARTHEST, FARTHEST)
        return pa.array((x @ centres.T - (centres**2).sum(1) / 2).argmax(1).astype(np.int32))

    celled = stored(codes.withColumn("cell", cell("codes")), "cells")
    parts = {r["cell"]: -(-r["count"] // GROUP_ROWS) for r in celled.groupBy("cell").count().collect()}
    firsts, groups = {}, 0
    for c, n in sorted(parts.items()):
        firsts[c], groups = groups, groups + n
    as_map = lambda d: F.create_map(*(F.lit(x).cast("long") for pair in d.items() for x in pair))
    at = F.col("cell").cast("long")
    group = F.element_at(as_map(firsts), at) + F.pmod(F.xxhash64("vec_id"), F.element_at(as_map(parts), at))
    dealt = celled.select(group.alias("group"), "vec_id", "codes")
    index = dealt.groupBy("group").applyInArrow(
        _group(width),
        "group long, ids binary, codes binary, sizes binary, high binary, low binary, highest binary, lowest binary",
    )
    index = stored(index, "index")
    asked = dealt.join(queries.select(F.col(id_col).cast("long").alias("vec_id")).distinct(), "vec_id", "left_semi")
    asked = stored(asked.withColumnRenamed("group", "home"), "asked")
    chunks = max(1, -(-asked.count() // CHUNK))
    chunk = F.pmod(F.xxhash64("vec_id"), F.lit(chunks)).alias("chunk")
    in_rows = F.collect_list(F.struct("vec_id", "codes", "floor", "home")).alias("queries")
    sent = "group long, queries array<struct<vec_id: long, codes: binary, floor: long, home: long>>"

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                here = Queries(row["queries"], width)
                at, found, score = Group(row, width).search(here.ids, here.x, here.floor, k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(here.ids[at]), pa.array(found), pa.array(score)], names=["query_id", "vec_id", "score"]
                )

    def visits(first: bool):
        """The groups of a shelf that a query is sent to: the ``FIRST`` of the greatest bounds, or the others."""

        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    asking = batch.column("queries").slice(i, 1).flatten()
                    row = batch.select(["groups"]).slice(i, 1).to_pylist()[0]
                    here = Queries(asking.to_pylist(), width)
                    shelf = np.array([g["group"] for g in row["groups"]], np.int64)
                    high, low = (matrix([g[c] for g in row["groups"]], width) for c in ("highest", "lowest"))
                    home = shelf == np.array(asking.field("home").to_numpy(), np.int64)[:, None]
                    bound, _ = bounds_of(here.x, high, low)
                    rank = np.argsort(np.argsort(np.where(home, np.inf, -bound), axis=1, kind="stable"), axis=1)
                    due = (rank < FIRST if first else rank >= FIRST) & ~home & (bound >= here.floor.astype(float)[:, None])
                    for g in np.flatnonzero(due.any(0)).tolist():
                        part = asking.take(pa.array(np.flatnonzero(due[:, g])))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([int(shelf[g])]), pa.ListArray.from_arrays([0, len(part)], part)], names=["group", "queries"]
                        )

        return choose

    def with_floor(hits: DataFrame) -> DataFrame:
        """The queries with their k-th best score so far, null for fewer results."""
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        kth = hits.withColumn("rank", rank).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor"))
        return asked.join(kth, "vec_id", "left").select("vec_id", "codes", "floor", "home")

    hits = "query_id long, vec_id long, score long"
    free = asked.select("vec_id", "codes", F.lit(None).cast("long").alias("floor"), "home", chunk)
    own = free.groupBy(F.col("home").alias("group"), "chunk").agg(in_rows).drop("chunk")
    found = stored(index.join(own, "group").mapInArrow(search, hits), "hits")
    shelf = F.expr(f"group div {SHELF}").alias("shelf")
    shelves = index.groupBy(shelf).agg(F.collect_list(F.struct("group", "highest", "lowest")).alias("groups"))
    shelves = stored(shelves, "shelves")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit((groups - 1) // SHELF).cast("long"))).alias("shelf")
    for first in (True, False):
        waiting = with_floor(found).groupBy(chunk).agg(in_rows).select("queries", every)
        meeting = waiting.join(shelves, "shelf").select("queries", "groups")
        due = stored(meeting.mapInArrow(visits(first), sent), "visits")
        found = stored(found.unionByName(index.join(due, "group").mapInArrow(search, hits)), "hits")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    ranked = found.withColumn("rank", rank).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
