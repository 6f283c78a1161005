"""Near-duplicate groups by Min-Max hashing.

1. Each text becomes the set of its distinct word shingles and a signature:
   the least and the greatest value under every permutation, so half as many
   hash evaluations as values. Texts with equal sets form a class; only the
   class with its smallest doc_id goes on.
2. The signature is cut into ``BANDS`` bands of ``ROWS`` values. Documents that
   share a band meet in a bucket; each is paired with the bucket's smallest
   document only (its hub), never with all others. A pair at similarity 0.75
   shares no band with a chance of (1 - 0.75**4)**40 = 2.5e-7, at 0.8 of 1e-9.
3. Pairs with a hub are confirmed on the full sets, and confirmed links joined
   to components. A group of copies is settled by this, at one pair a document.
4. What met the same hub but lies in different components is compared in
   full: the hub's documents are dealt into blocks of bounded size, those of
   one large component apart from the rest, and every pair of blocks that may
   hold a new link is one small task, which counts common shingles of all its
   pairs by a matrix product and returns only links. Nothing is capped, and
   since every pair that shares a bucket shares that bucket's hub, none is left
   out.
5. Components of all links give the result.

The cost of 4 grows with the documents that look alike but are not linked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from pixeltide.llm.components import components
from pixeltide.llm.shingles import band_keys, min_max, set_keys, shingle_sets
from pixeltide.llm.workers import bytes_of, slices
from pixeltide.sources.shared_folder import stored

#: Values of a band, and bands; half as many permutations as values.
ROWS, BANDS = 4, 40
#: Largest sum of (shingles + ROW_WEIGHT) of a block.
BLOCK, ROW_WEIGHT = 300_000, 600
#: Ids up to which the list of documents to be compared is sent to all executors (at most 64 MB).
SENT_IDS = 2_000_000
#: Shingles counted at once by the matrix product.
COLUMNS = 8192


def _texts(batch: pa.RecordBatch) -> pa.Array:
    return batch.column(1)


def signatures(docs: DataFrame, words: int = 5) -> DataFrame:
    """doc_id, n_shingles, set_a, set_b (equal for equal sets), bands of ``docs(doc_id, text)``."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in slices(_texts(batch)):
                sets = shingle_sets(*bytes_of(texts), words)
                keys = set_keys(sets).view(np.int64)
                bands = np.zeros((len(sets), BANDS), np.int64)
                for i, s in enumerate(sets):
                    if len(s):
                        bands[i] = band_keys(*min_max(s, ROWS * BANDS // 2), ROWS).view(np.int64)
                offsets = pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(start, len(sets)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(np.ascontiguousarray(keys[:, 0])),
                        pa.array(np.ascontiguousarray(keys[:, 1])),
                        pa.ListArray.from_arrays(offsets, pa.array(bands.ravel())),
                    ],
                    names=["doc_id", "n_shingles", "set_a", "set_b", "bands"],
                )

    return docs.mapInArrow(sign, "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>")


def full_sets(docs: DataFrame, words: int = 5) -> DataFrame:
    """id and whole shingle set (binary, sorted 64-bit hashes) of ``docs(doc_id, text)``."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in slices(_texts(batch)):
                sets = shingle_sets(*bytes_of(texts), words)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, len(sets)), pa.array([s.tobytes() for s in sets], pa.binary())],
                    names=["id", "shingles"],
                )

    return docs.mapInArrow(make, "id long, shingles binary")


@F.arrow_udf(LongType())
def common(one: pa.Array, two: pa.Array) -> pa.Array:
    """Number of shingles in both sets."""
    return pa.array(
        [
            np.intersect1d(np.frombuffer(a.as_py(), np.uint64), np.frombuffer(b.as_py(), np.uint64), True).size
            for a, b in zip(one, two)
        ],
        pa.int64(),
    )


def is_link(shared, one, two, percent: int):
    """100 * intersection >= percent * union; of numbers, arrays or columns."""
    return shared * 100 >= (one + two - shared) * percent


def _links_between(percent: int):
    def links(key: tuple, rows: pa.Table) -> pa.Table:
        sets = [np.frombuffer(s, np.uint64) for s in rows["shingles"].to_pylist()]
        ids, label = rows["rep"].to_numpy(), rows["label"].to_numpy()
        side, size = rows["second"].to_numpy().astype(bool), np.array([len(s) for s in sets])
        left, right = np.flatnonzero(~side), np.flatnonzero(side)
        if not len(right):  # a block with itself
            right = left
        a, b = left[:, None], right[None, :]
        open_ = (label[a] != label[b]) & (ids[a] != ids[b])
        open_ &= np.minimum(size[a], size[b]) * 100 >= np.maximum(size[a], size[b]) * percent
        found = np.zeros((0, 2), np.int64)
        if open_.any():
            values, place = np.unique(np.concatenate(sets), return_inverse=True)
            owner = np.repeat(np.arange(len(sets)), size)
            order = np.argsort(place, kind="stable")
            place, owner = place[order], owner[order]
            shared = np.zeros(open_.shape, np.float64)
            for start in range(0, len(values), COLUMNS):
                lo, hi = np.searchsorted(place, (start, start + COLUMNS))
                has = np.zeros((len(sets), min(COLUMNS, len(values) - start)), np.float32)
                has[owner[lo:hi], place[lo:hi] - start] = 1
                shared += has[left] @ has[right].T
            hit = open_ & is_link(shared.astype(np.int64), size[a], size[b], percent)
            i, j = np.nonzero(hit)
            found = np.stack([ids[left[i]], ids[right[j]]], 1)
        return pa.table({"a": found[:, 0].astype(np.int64), "b": found[:, 1].astype(np.int64)})

    return links


def _dealt(groups: DataFrame) -> DataFrame:
    """(hub, first, second, rep, label, second?) rows of every pair of blocks that may hold a link."""
    weight = F.col("n") + ROW_WEIGHT
    labels = groups.groupBy("hub", "label").agg(F.sum(weight).alias("weight"))
    small = F.col("weight") < BLOCK
    pool = labels.where(small).groupBy("hub").agg(F.ceil(F.sum("weight") / BLOCK).alias("slots"))
    labels = (
        labels.join(pool.withColumnRenamed("slots", "pool"), "hub", "left")
        .select(
            "hub",
            "label",
            F.when(small, F.lit(None).cast("long")).otherwise(F.col("label")).alias("alone"),
            F.when(small, F.col("pool")).otherwise(F.ceil(F.col("weight") / BLOCK)).alias("slots"),
        )
    )
    # A label of the pool stays in one block; a large one is dealt by document.
    rows = groups.join(labels, ["hub", "label"]).select(
        "hub", "rep", "label", "alone",
        F.struct("alone", F.pmod(F.xxhash64(F.when(F.isnull("alone"), F.col("label")).otherwise(F.col("rep"))), "slots")).alias("block"),
    )
    blocks = rows.select("hub", "alone", "block").distinct()
    blocks = blocks.select("hub", "alone", F.xxhash64("hub", F.to_json("block")).alias("block"))
    rows = rows.select("hub", "rep", "label", F.xxhash64("hub", F.to_json("block")).alias("block"))
    other = blocks.select("hub", F.col("alone").alias("alone2"), F.col("block").alias("block2"))
    pairs = blocks.join(other, "hub").where(
        "block <= block2 and not (alone is not null and alone2 is not null and alone = alone2)"
    )
    sides = pairs.select("hub", F.col("block").alias("first"), F.col("block2").alias("last"), F.expr(
        "explode(case when block = block2 then array(named_struct('block', block, 'second', false)) "
        "else array(named_struct('block', block, 'second', false), named_struct('block', block2, 'second', true)) end)"
    ).alias("side"))
    return sides.select("hub", "first", "last", "side.block", "side.second").join(rows, ["hub", "block"])


def near_duplicates(
    docs: DataFrame, percent: int = 75, words: int = 5, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of ``docs``.

    Two documents are linked if 100 * |intersection| >= ``percent`` * |union|
    of their sets of ``words``-word shingles (words are ``[^ \\t-\\r]+`` with
    A-Z as a-z). component_id is the smallest doc_id that links reach, kept
    says that it is the row's own. Null and empty texts have no shingles and
    no links. Rows that share a doc_id count as one document with several
    texts: what is linked to any of them is in its component, and all its rows
    have one component_id. A row without doc_id takes no part: component_id null, kept true.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = stored(signatures(docs, words), "signatures")
    classes = (
        signed.where("n_shingles > 0").groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep")).where("rep is not null")
    )
    # Written, so that the joins below are dealt anew and a class of very many copies is split among tasks.
    classes = stored(classes, "classes")
    members = signed.select("doc_id", "n_shingles", "set_a", "set_b").join(classes, ["set_a", "set_b"], "left")
    chosen = signed.join(classes, ["set_a", "set_b"]).where("doc_id = rep")
    banded = chosen.select("rep", F.explode("bands").alias("key"))
    hubs = banded.groupBy("key").agg(F.min("rep").alias("hub"), F.max("rep").alias("last")).where("hub < last")
    hubs = stored(hubs, "hubs")
    met = banded.join(hubs, "key").where("rep <> hub").select("hub", "rep").distinct()
    met = stored(met, "met")

    wanted = stored(met.select(F.col("hub").alias("doc_id")).union(met.select("rep")).distinct(), "wanted")
    many = wanted.count() > SENT_IDS
    sets = stored(full_sets(docs.join(wanted if many else F.broadcast(wanted), "doc_id", "left_semi"), words), "sets")
    sized = (F.length("shingles") / 8).cast("long")
    one = sets.select(F.col("id").alias("hub"), F.col("shingles").alias("s1"))
    two = sets.select(F.col("id").alias("rep"), F.col("shingles").alias("s2"))
    confirmed = (
        met.join(two, "rep")
        .join(one, "hub")
        .select("hub", "rep", F.length("s1") / 8, F.length("s2") / 8, common("s1", "s2"))
        .toDF("a", "b", "n1", "n2", "shared")
        .where(is_link(F.col("shared"), F.col("n1"), F.col("n2"), percent))
        .select("a", "b")
    )
    # A document with several texts may be in several classes; it links them.
    several = stored(signed.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select("doc_id"), "several")
    if several.limit(1).count():
        own = members.where("rep <> doc_id").join(several, "doc_id", "left_semi").select("doc_id", "rep").distinct()
        confirmed = confirmed.union(own)
    confirmed = stored(confirmed, "links")
    labels = stored(components(confirmed), "labels")

    size = sets.groupBy("id").agg(F.max(sized).alias("n")).withColumnRenamed("id", "rep")
    groups = (
        met.union(met.select("hub", "hub").distinct())
        .toDF("hub", "rep")
        .join(size, "rep")
        .join(labels.withColumnRenamed("node", "rep"), "rep", "left")
        .select("hub", "rep", "n", F.coalesce("component", "rep").alias("label"))
    )
    groups = stored(groups, "groups")
    unsettled = (
        groups.groupBy("hub")
        .agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("rows"))
        .where("low < high and rows > 2")  # of two rows, the only pair is settled
        .select("hub")
    )
    # Both written: the join is split or sent, however many rows a hub has, and what follows is dealt by hub and label.
    unsettled = stored(unsettled, "unsettled")
    dealt = _dealt(stored(groups.join(unsettled, "hub", "left_semi"), "open"))
    more = (
        dealt.join(sets.withColumnRenamed("id", "rep"), "rep")
        .select("hub", "first", "last", "second", "rep", "label", "shingles")
        .groupBy("hub", "first", "last")
        .applyInArrow(_links_between(percent), "a long, b long")
    )
    more = stored(more, "links")
    if more.limit(1).count():
        labels = stored(components(confirmed.union(more)), "labels")
    found = members.withColumn("rep", F.coalesce("rep", "doc_id"))
    found = found.join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    component = F.coalesce("component", "rep")
    return found.select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNotNull(), component).alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )
