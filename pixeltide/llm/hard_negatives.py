"""Hard-negative mining by angular triangle filtering.

Vectors become integers. Each stores its norm and its angles to a few reference
directions (fitted on a bounded sample; any directions give the right result).
For an anchor with angle p and a vector with angle t to one direction, the angle
between the two is at least |p - t| and at most p + t and 2 pi - p - t. The
tightest of these over all directions is an interval of the cosine; times the
norms it is an interval the score must lie in. Angles are widened by ``SLACK``
and scores by a part in 10**9 and 1, so rounding never cuts off a score.

Rows are dealt into groups of one nearest direction, of bounded size, and
inside into blocks, halved by label, then along the widest angle. An anchor
looks for scores in windows: any score for its positives, a share of the
positive's score for the negatives. Group, block and row are dropped in turn if
their interval misses all its windows, or lies below what those hold already.
What is left is scored in integers. Anchors first visit the groups of their own
direction, which gives them scores to start from elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from pixeltide.sources.shared_folder import stored

#: Rows of a block; rows a group is meant to have; anchors that visit a group together.
BLOCK_ROWS, GROUP_ROWS, CHUNK = 64, 4096, 1024
#: Reference directions, vectors they are fitted on, and rounds.
DIRECTIONS, SAMPLED, ROUNDS = 16, 4096, 8
#: Radians by which angles are widened: they are stored in 32 bits, and an arc cosine near 0 errs by some 1e-7.
SLACK = 1e-5
#: Sums of products below this are exact in 64-bit floats.
EXACT = 2.0**53
LOWEST, HIGHEST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def quantised(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id, label, codes of ``vectors(vec_id, label, vector)``: floor(scale * x) as 64-bit floats; unfit rows are left out."""

    def quantise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, codes = [], []
            for row, v in enumerate(batch.column(2)):
                if not v.is_valid or v.values.null_count:
                    continue
                with np.errstate(over="ignore", invalid="ignore"):
                    x = np.floor(v.values.to_numpy(zero_copy_only=False).astype(np.float64) * scale)
                if np.isfinite(x).all():
                    kept.append(row)
                    codes.append((x + 0.0).tobytes())
            rows = pa.array(kept, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(codes, pa.binary())], names=["vec_id", "label", "codes"]
            )

    known = vectors.where("vec_id is not null and label is not null")
    return known.mapInArrow(quantise, "vec_id long, label long, codes binary")


def matrix(codes: list[bytes], width: int) -> np.ndarray:
    """Rows of codes; shorter vectors are filled with zeros."""
    out = np.zeros((len(codes), width))
    for row, c in zip(out, codes):
        x = np.frombuffer(c)
        row[: len(x)] = x
    return out


def norms_of(x: np.ndarray) -> np.ndarray:
    """Lengths of rows, without overflow of their squares."""
    most = np.abs(x).max(axis=1, initial=0)
    return most * np.sqrt(((x / np.where(most > 0, most, 1)[:, None]) ** 2).sum(1))


def _unit(x: np.ndarray) -> np.ndarray:
    most = np.abs(x).max(axis=1, initial=0)
    x = x / np.where(most > 0, most, 1)[:, None]
    size = np.sqrt((x**2).sum(1))
    return x / np.where(size > 0, size, 1)[:, None]


def directions_of(sample: np.ndarray, many: int = DIRECTIONS) -> np.ndarray:
    """Unit vectors in the middle of the sample's clusters."""
    unit = _unit(sample)
    unit = unit[(unit**2).sum(1) > 0]
    found = unit[:: max(1, len(unit) // many)][:many].copy()
    for _ in range(ROUNDS if len(found) else 0):
        nearest = (unit @ found.T).argmax(1)
        found = _unit(np.stack([unit[nearest == c].sum(0) if (nearest == c).any() else found[c] for c in range(len(found))]))
    return found[(found**2).sum(1) > 0.5]


def angles_to(x: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """Angles of rows to unit directions; of a zero row, right angles."""
    return np.arccos(np.clip(_unit(x) @ directions.T, -1, 1))


class Shell:
    """Ranges of angles [set, direction] and norms [set] that sets of vectors lie in; a single vector is a set too."""

    def __init__(self, low: np.ndarray, high: np.ndarray, short: np.ndarray, long: np.ndarray):
        self.low, self.high, self.short, self.long = low, high, short, long

    def __getitem__(self, at) -> Shell:
        return Shell(self.low[at], self.high[at], self.short[at], self.long[at])

    @classmethod
    def of(cls, angles: np.ndarray, norms: np.ndarray) -> Shell:
        return cls(angles, angles, norms, norms)


def score_bounds(one: Shell, two: Shell) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score between the sets of two shells, whose arrays are broadcast against each other."""
    near, far = 0.0, np.pi
    for r in range(one.low.shape[-1]):
        a, b, c, d = one.low[..., r], one.high[..., r], two.low[..., r], two.high[..., r]
        near = np.maximum(near, np.maximum(c - b, a - d))
        far = np.minimum(far, np.where(b + d <= np.pi, b + d, np.where(a + c >= np.pi, 2 * np.pi - a - c, np.pi)))
    with np.errstate(over="ignore", invalid="ignore"):
        most, least = np.cos(np.maximum(near - SLACK, 0)), np.cos(np.minimum(far + SLACK, np.pi))
        small, big = one.short * two.short, one.long * two.long
        upper, lower = np.where(most >= 0, big, small) * most, np.where(least >= 0, small, big) * least
        upper, lower = upper + np.abs(upper) * 1e-9 + 1, lower - np.abs(lower) * 1e-9 - 1
    lower, upper = np.where(np.isnan(lower), -np.inf, lower), np.where(np.isnan(upper), np.inf, upper)
    return np.clip(lower, float(LOWEST), float(HIGHEST)), np.clip(upper, float(LOWEST), float(HIGHEST))  # as scores are


def scores_of(one: np.ndarray, two: np.ndarray, most: float) -> np.ndarray:
    """Exact inner products of rows of integers; ``most`` bounds them. Beyond a long they count as its limits."""
    if most < EXACT:
        return (one @ two.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    return np.clip(whole(one) @ whole(two).T, LOWEST, HIGHEST).astype(np.int64)


def _blocks(angles: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
    """Row numbers of the blocks of a group: of one label, unless labels are rarer than blocks are long."""
    done, todo = [], [np.arange(len(angles))]
    while todo:
        rows = todo.pop()
        if len(rows) <= BLOCK_ROWS:
            done.append(rows)
            continue
        part, cut = angles[rows], len(rows) // 2
        if labels[rows].min() < labels[rows].max():
            order = labels[rows].argsort(kind="stable")
            borders = np.flatnonzero(np.diff(labels[rows][order])) + 1
            cut = borders[np.abs(borders - cut).argmin()]
        else:
            order = part[:, (part.max(0) - part.min(0)).argmax()].argsort(kind="stable")
        todo += [rows[order[cut:]], rows[order[:cut]]]
    return done


def _group(width: int, many: int):
    def build(key: tuple, rows: pa.Table) -> pa.Table:
        x, ids, labels = matrix(rows["codes"].to_pylist(), width), rows["vec_id"].to_numpy(), rows["label"].to_numpy()
        angles, norms = np.array(rows["angles"].to_pylist(), np.float32).reshape(-1, many), rows["norm"].to_numpy()
        blocks = _blocks(angles, labels)
        order, sizes = np.concatenate(blocks), np.array([len(b) for b in blocks], np.int64)
        small = np.abs(x).max(initial=0) < 2**31
        return pa.table(
            {
                "cell": pa.array([key[0].as_py()], pa.int32()),
                "salt": pa.array([key[1].as_py()], pa.int64()),
                "ids": [ids[order].tobytes()],
                "labels": [labels[order].tobytes()],
                "codes": [(x[order].astype(np.int32) if small else x[order]).tobytes()],
                "small": [bool(small)],
                "sizes": [sizes.tobytes()],
                "angles": [angles[order].tobytes()],
                "norms": [norms[order].tobytes()],
                "low": pa.array([angles.min(0)], pa.list_(pa.float32())),
                "high": pa.array([angles.max(0)], pa.list_(pa.float32())),
                "short": [norms.min()],
                "long": [norms.max()],
            }
        )

    return build


INDEX = (
    "cell int, salt long, ids binary, labels binary, codes binary, small boolean, sizes binary, angles binary, norms binary, "
    "low array<float>, high array<float>, short double, long double"
)


class Anchors:
    """Anchors that visit groups together, and their windows.

    Window w belongs to anchor ``owner[w]`` and takes scores from ``least[w]`` to ``most[w]``.
    """

    def __init__(self, asked: list[dict], width: int, many: int):
        windows = [(n, w) for n, a in enumerate(asked) for w in a["windows"]]
        whole = lambda values: np.array(values, np.int64)
        self.anchor, self.place = whole([asked[n]["anchor"] for n, _ in windows]), np.array([w["place"] for _, w in windows], np.int32)
        self.owner, self.least, self.most = whole([n for n, _ in windows]), whole([w["least"] for _, w in windows]), whole([w["most"] for _, w in windows])
        self.ids, self.labels, self.cells = (whole([a[c] for a in asked]) for c in ("vec_id", "label", "cell"))
        self.x = matrix([a["codes"] for a in asked], width)
        self.shell = Shell.of(np.array([a["angles"] for a in asked], np.float64).reshape(-1, many), norms_of(self.x))


class Group:
    """Vectors of one direction, read from their group's row."""

    def __init__(self, row: dict, width: int, many: int):
        self.cell = row["cell"]
        self.ids, self.labels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
        self.x = np.frombuffer(row["codes"], np.int32 if row["small"] else np.float64).reshape(-1, width).astype(np.float64)
        angles, norms = np.frombuffer(row["angles"], np.float32).reshape(-1, many).astype(np.float64), np.frombuffer(row["norms"])
        self.rows = Shell.of(angles, norms)
        self.bounds = np.concatenate([[0], np.cumsum(np.frombuffer(row["sizes"], np.int64))])
        cuts = self.bounds[:-1]
        self.blocks = Shell(*(f.reduceat(v, cuts) for v in (angles, norms) for f in (np.minimum, np.maximum)))
        self.low_label, self.high_label = np.minimum.reduceat(self.labels, cuts), np.maximum.reduceat(self.labels, cuts)
        self.scored = 0

    def search(self, asked: Anchors, same: bool, near: bool, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, vec_id, score) of the best ``k`` scores of every window.

        With ``same``, rows with the anchor's label are looked at, else those
        with another; with ``near``, anchors of the group's direction look, else the others.
        """
        lower, upper = score_bounds(asked.shell[:, None], self.blocks[None])
        label = asked.labels[:, None]
        if same:
            alive = (self.low_label <= label) & (label <= self.high_label)
        else:
            alive = (self.low_label != label) | (self.high_label != label)
        alive &= ((asked.cells == self.cell) == near)[:, None]
        upper = np.where(alive, upper, -np.inf)
        owner, most, reach = asked.owner, asked.most, asked.least.copy()
        alive = alive[owner]
        best, best_id = np.full((len(owner), k), LOWEST), np.full((len(owner), k), HIGHEST)
        held = np.zeros(len(owner), np.int64)
        for block in np.argsort(-upper.max(0, initial=-np.inf), kind="stable"):
            going = np.flatnonzero(alive[:, block] & (upper[owner, block] >= reach) & (lower[owner, block] <= most))
            anchors, mine = np.unique(owner[going], return_inverse=True)
            rows = np.arange(self.bounds[block], self.bounds[block + 1])
            low, high = score_bounds(asked.shell[anchors][:, None], self.rows[rows][None])
            fit = (self.labels[rows] == label[anchors]) == same
            fit &= self.ids[rows] != asked.ids[anchors, None]
            may = fit[mine] & (high[mine] >= reach[going, None]) & (low[mine] <= most[going, None])
            some, any_row = may.any(1), may.any(0)
            if not some.any():
                continue
            going, rows, may = going[some], rows[any_row], may[some][:, any_row]
            anchors, mine = np.unique(owner[going], return_inverse=True)
            bound = float(asked.shell.long[anchors].max() * self.rows.long[rows].max())
            score = scores_of(asked.x[anchors], self.x[rows], bound)
            self.scored += score.size
            score = score[mine]
            fits = may & (score >= reach[going, None]) & (score <= most[going, None])
            new = fits.any(1)
            going, score, fits = going[new], score[new], fits[new]
            found = np.where(fits, self.ids[rows], HIGHEST)
            score = np.concatenate([best[going], np.where(fits, score, LOWEST)], 1)
            found = np.concatenate([best_id[going], found], 1)
            top = np.lexsort((found, ~score), axis=1)[:, :k]  # ~ turns the order around without overflow
            best[going], best_id[going] = np.take_along_axis(score, top, 1), np.take_along_axis(found, top, 1)
            held[going] = np.minimum(held[going] + fits.sum(1), k)
            full = going[held[going] == k]
            reach[full] = np.maximum(reach[full], best[full, -1])  # an equal score may still win by its id
        window, rank = np.nonzero(np.arange(k) < held[:, None])
        return window, best_id[window, rank], best[window, rank]


@F.arrow_udf(BooleanType())
def _overlap(
    low: pa.Array, high: pa.Array, short: pa.Array, long: pa.Array, least: pa.Array, most: pa.Array,
    low2: pa.Array, high2: pa.Array, short2: pa.Array, long2: pa.Array,
) -> pa.Array:
    """Whether some score between two sets may lie in [least, most]."""
    shells = []
    for a, b, c, d in ((low, high, short, long), (low2, high2, short2, long2)):
        angles = (np.array(v.to_pylist(), np.float64).reshape(len(v), -1) for v in (a, b))
        shells.append(Shell(*angles, c.to_numpy(), d.to_numpy()))
    lower, upper = score_bounds(*shells)
    return pa.array((upper >= least.to_numpy()) & (lower <= most.to_numpy()))


def _chunked(rows: DataFrame, size: int, name: str, within_cell: bool) -> DataFrame:
    """``rows`` plus a number ``name`` that about ``size`` rows share, of each cell or in the order of cells."""
    counts = rows.groupBy("cell").agg(F.count("*").alias("_rows"))  # a row for each direction
    before = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
    part = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) / float(1 << 20) * F.col("_rows")
    if not within_cell:
        part = part + F.col("_before")
    return rows.join(F.broadcast(counts), "cell").withColumn(name, F.floor(part / size)).drop("_rows", "_before")


def _visits(index: DataFrame, anchors: DataFrame, windows: DataFrame, same: bool, near: bool, k: int, shape: tuple[int, int]) -> DataFrame:
    """anchor, place, vec_id, score: best ``k`` rows of every window of ``windows(anchor, place, least, most)``, group by group."""
    width, many = shape
    per_anchor = windows.groupBy("anchor").agg(
        F.collect_list(F.struct("place", "least", "most")).alias("windows"), F.min("least").alias("least"), F.max("most").alias("most")
    )
    asked = _chunked(anchors.join(per_anchor, "anchor"), CHUNK, "chunk", False)
    at = lambda f: F.array(*(f(F.col("angles")[r]) for r in range(many)))
    chunks = asked.groupBy("chunk").agg(
        F.collect_list(F.struct("anchor", "vec_id", "label", "cell", "codes", "angles", "windows")).alias("asked"),
        F.collect_set("cell").alias("cells"),
        at(F.min).alias("low_"), at(F.max).alias("high_"), F.min("norm").alias("short_"), F.max("norm").alias("long_"),
        F.min("least").alias("least_"), F.max("most").alias("most_"),
    )
    chunks = stored(chunks, "chunks")
    every = F.sequence(F.lit(0), F.lit(many - 1))
    to = F.col("cells") if near else F.when(F.size("cells") == 1, F.array_except(every, "cells")).otherwise(every)
    pairs = chunks.drop("asked").withColumn("cell", F.explode(to)).join(
        index.select("cell", "salt", "low", "high", "short", "long"), "cell"
    )
    pairs = pairs.where(_overlap("low_", "high_", "short_", "long_", "least_", "most_", "low", "high", "short", "long"))
    pairs = stored(pairs.select("cell", "salt", "chunk"), "pairs")
    met = pairs.join(chunks.select("chunk", "asked"), "chunk").join(index.drop("low", "high", "short", "long"), ["cell", "salt"])

    def search(key: tuple, rows: pa.Table) -> pa.Table:
        (row,) = rows.to_pylist()
        anchors = Anchors(row["asked"], width, many)
        window, found, score = Group(row, width, many).search(anchors, same, near, k)
        return pa.table(
            {"anchor": anchors.anchor[window], "place": anchors.place[window], "vec_id": found, "score": score}
        )

    # One pair at a time, so a task holds one group and one chunk however many it is dealt.
    return met.groupBy("cell", "salt", "chunk").applyInArrow(search, "anchor long, place int, vec_id long, score long")


def _best(index: DataFrame, anchors: DataFrame, windows: DataFrame, same: bool, k: int, shape: tuple[int, int]) -> DataFrame:
    """anchor, place, rank, vec_id, score: the best ``k`` rows of every window."""
    near = stored(_visits(index, anchors, windows, same, True, k, shape), "near")
    kth = near.groupBy("anchor", "place").agg(F.count("*").alias("_held"), F.min("score").alias("_kth"))
    raised = F.when(F.col("_held") >= k, F.greatest("least", "_kth")).otherwise(F.col("least"))
    left = windows.join(kth, ["anchor", "place"], "left").withColumn("least", raised)
    far = _visits(index, anchors, left, same, False, k, shape)
    rank = F.row_number().over(Window.partitionBy("anchor", "place").orderBy(F.desc("score"), "vec_id"))
    return near.unionByName(far).withColumn("rank", rank).where(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 3, percent: tuple[int, int] = (50, 95),
    scale: int = 256, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of every anchor, positive and negative.

    Scores are inner products of floor(scale * x); higher ones come first, ties
    by the smaller id. An anchor's positives are the first rows of its label
    with another id. For each of them, the negatives are the first rows of
    other labels with percent[0] * p <= 100 * score <= percent[1] * p, where p
    is the positive's score; no such row, no result row.

    ``anchors`` holds the ids of the rows to mine for. Rows without id or
    label, and vectors that are null or hold a null or a component that is not
    finite (or not when scaled), take no part. Missing components of shorter
    vectors are zeros. Rows equal in id, label and integers count once; rows of
    one id that differ are rows of their own, none of them the other's positive.
    Scores beyond a long count as its limits. Other columns play no part.
    """
    if not 0 <= percent[0] <= percent[1] <= 100:
        raise ValueError(f"percent must rise within 0 to 100: {percent}")
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    known = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("vector")
    )
    codes = stored(quantised(known, scale).dropDuplicates(), "codes")
    longest = codes.agg(F.max(F.length("codes"))).first()[0]
    if longest is None:
        return vectors.sparkSession.createDataFrame([], schema)
    width = max(longest // 8, 1)
    sample = codes.orderBy(F.xxhash64("vec_id"), "vec_id", "codes").limit(SAMPLED).select("codes")
    directions = directions_of(matrix([r[0] for r in sample.collect()], width))
    directions = directions if len(directions) else np.eye(1, width)
    shape = width, len(directions)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(2).to_pylist(), width)
            angles = angles_to(x, directions)
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array(angles.argmin(1).astype(np.int32)),
                    pa.array(list(angles.astype(np.float32)), pa.list_(pa.float32())),
                    pa.array(norms_of(x)),
                ],
                names=["vec_id", "label", "codes", "cell", "angles", "norm"],
            )

    measured = codes.mapInArrow(measure, "vec_id long, label long, codes binary, cell int, angles array<float>, norm double")
    measured = stored(measured, "measured")
    dealt = _chunked(measured, GROUP_ROWS, "salt", True)
    index = stored(dealt.groupBy("cell", "salt").applyInArrow(_group(*shape), INDEX), "index")
    wanted = anchors.select(F.col(id_col).cast("long").alias("vec_id")).distinct()
    asked = stored(
        measured.join(wanted, "vec_id", "left_semi").withColumn("anchor", F.monotonically_increasing_id()), "anchors"
    )
    any_score = asked.select("anchor", F.lit(0).alias("place"), F.lit(LOWEST).alias("least"), F.lit(HIGHEST).alias("most"))
    found = _best(index, asked, any_score, True, positives, shape)
    found = stored(found.select("anchor", F.col("rank").cast("int").alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    share = lambda p: F.col("positive_score").cast("decimal(20,0)") * F.lit(Decimal(p) / 100)
    windows = found.select("anchor", "place", F.ceil(share(percent[0])).cast("long").alias("least"), F.floor(share(percent[1])).cast("long").alias("most"))
    windows = stored(windows.where("least <= most"), "windows")
    mined = _best(index, asked, windows, False, negatives, shape)
    return mined.join(found, ["anchor", "place"]).join(asked.select("anchor", F.col("vec_id").alias("anchor_id")), "anchor").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
