"""N-gram Jaccard self-join by rare-first prefix filtering, and the components of its links.

1. Each text becomes the set of its distinct word n-grams; equal sets are one
   class, told apart by two hashes, of which the smallest doc_id goes on. The
   same pass counts n-grams in ``BUCKETS`` hash buckets; buckets of all
   documents added up tell rare n-grams from common ones. The counts are the
   only thing sent to all tasks (8 MB, whatever the corpus).
2. A set's n-grams are put in one order for all, rare ones first. Two sets that
   share ``percent`` of their union share an n-gram among the first
   n - ceil(percent * n) + 1 of each (the prefix), so only prefixes are joined.
   Each prefix n-gram knows its position, and how the rest of the set behind it
   (the suffix) is dealt over ``PARTS`` parts.
3. Sets that share a prefix n-gram are candidates if they pass three filters:
   length (the smaller has percent of the larger), position (what may still be
   shared from here on suffices), suffix (sets with such different suffixes
   differ in too many n-grams). Candidates are made distinct, so a pair that
   shares many n-grams is verified once, on full sets.
4. A frequent n-gram must not give all pairs of its sets. So in a few rounds the
   sets of an n-gram are paired with a single one of them, drawn anew each
   round; what these verified links join is one component, whose sets need not
   be compared any more. Copies of one text are settled by this, at a pair a
   document and round.
5. What is left, n-grams whose sets lie in different components, is joined in
   full: sets are keyed by n-gram and class of length, frequent keys cut into
   blocks of bounded size, and pairs of blocks are joined by an equi-join whose
   conditions are the filters. Sets of one component are not paired. Nothing is
   capped, so every link between components is found.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from pixeltide.llm.components import components
from pixeltide.llm.shingles import set_keys, shingle_sets
from pixeltide.llm.workers import bytes_of, slices
from pixeltide.sources.shared_folder import stored

#: Buckets in which n-grams are counted.
BUCKET_BITS = 20
BUCKETS = 1 << BUCKET_BITS
#: Parts of a suffix; counts beyond 255 count as 255, which only weakens the filter.
PARTS = 16
#: Rounds in which an n-gram's sets meet one of them.
ROUNDS = 3
#: Sets of a block in the full join.
BLOCK = 2000


def buckets_of(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def sized_sets(docs: DataFrame, words: int) -> DataFrame:
    """Rows of ``docs(doc_id, text)`` as doc_id, n, set_a, set_b; and rows (n, bucket) with a task's counts, where bucket is not null."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n", "set_a", "set_b", "bucket"]
        counts = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for start, texts in slices(batch.column(1)):
                found = shingle_sets(*bytes_of(texts), words)
                both = set_keys(found).view(np.int64)
                counts += np.bincount(buckets_of(np.concatenate(found)), minlength=BUCKETS)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(start, len(found)),
                        pa.array([len(s) for s in found], pa.int64()),
                        pa.array(np.ascontiguousarray(both[:, 0])),
                        pa.array(np.ascontiguousarray(both[:, 1])),
                        pa.nulls(len(found), pa.int64()),
                    ],
                    names=names,
                )
        used = np.flatnonzero(counts)
        none = pa.nulls(len(used), pa.int64())
        yield pa.RecordBatch.from_arrays([none, pa.array(counts[used]), none, none, pa.array(used)], names=names)

    return docs.mapInArrow(sets, "doc_id long, n long, set_a long, set_b long, bucket long")


def prefix_length(n: int, percent: int) -> int:
    """N-grams of a set of ``n`` of which a linked set must share one."""
    return n - -(-n * percent // 100) + 1


def rare_first(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A set's n-grams by count, then value: one order for all sets."""
    return grams[np.argsort(counts[buckets_of(grams)], kind="stable")]


def suffixes(ordered: np.ndarray, prefix: int) -> np.ndarray:
    """[position, part]: how the n-grams behind each position of the prefix are dealt over the parts."""
    part = (ordered & np.uint64(PARTS - 1)).astype(np.int64)
    whole = np.bincount(part, minlength=PARTS)
    before = np.cumsum(part[:prefix, None] == np.arange(PARTS), axis=0)
    return np.minimum(whole - before, 255).astype(np.uint8)


def prefixes(docs: DataFrame, counts: np.ndarray, percent: int, words: int) -> DataFrame:
    """doc_id, n, set_a, set_b, grams (the prefix), behind_0, behind_1 (16 counts of a byte for each) of texts with words."""

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in slices(batch.column(1)):
                found = shingle_sets(*bytes_of(texts), words)
                both = set_keys(found).view(np.int64)
                some = [i for i, s in enumerate(found) if len(s)]
                grams, behind = [], []
                for i in some:
                    prefix = prefix_length(len(found[i]), percent)
                    ordered = rare_first(found[i], counts)
                    grams.append(ordered[:prefix].view(np.int64))
                    behind.append(suffixes(ordered, prefix).view(np.int64))
                kept, longs = pa.array(some, pa.int64()), pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(start, len(found)).take(kept),
                        pa.array([len(found[i]) for i in some], pa.int64()),
                        pa.array(both[some, 0]),
                        pa.array(both[some, 1]),
                        pa.array(grams, longs),
                        *(pa.array([np.ascontiguousarray(x[:, half]) for x in behind], longs) for half in (0, 1)),
                    ],
                    names=["doc_id", "n", "set_a", "set_b", "grams", "behind_0", "behind_1"],
                )

    longs = "array<long>"
    return docs.mapInArrow(
        take, f"doc_id long, n long, set_a long, set_b long, grams {longs}, behind_0 {longs}, behind_1 {longs}"
    )


def full_sets(docs: DataFrame, words: int) -> DataFrame:
    """id, grams (binary, sorted 64-bit hashes) of ``docs(doc_id, text)``."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in slices(batch.column(1)):
                found = shingle_sets(*bytes_of(texts), words)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, len(found)), pa.array([s.tobytes() for s in found], pa.binary())], names=["id", "grams"]
                )

    return docs.mapInArrow(make, "id long, grams binary")


def shared_by(one: bytes, two: bytes) -> int:
    """N-grams in both of two sets."""
    a, b = np.frombuffer(one, np.uint64), np.frombuffer(two, np.uint64)
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum()) if len(b) else 0


@F.arrow_udf(LongType())
def shared(one: pa.Array, two: pa.Array) -> pa.Array:
    """N-grams in both of two sets."""
    return pa.array([shared_by(a.as_py(), b.as_py()) for a, b in zip(one, two)], pa.int64())


def may_link(a: str, b: str, percent: int) -> str:
    """The three filters, for rows with n, position, behind_0 and behind_1 under the names ``a`` and ``b``.

    They hold for a linked pair at the first n-gram it shares: no n-gram before
    it is shared, so all that is shared is this one and part of the suffixes.
    """
    needed = f"({percent} * ({a}.n + {b}.n) + {99 + percent}) div {100 + percent}"
    left = f"({a}.n - {a}.position)", f"({b}.n - {b}.position)"
    bytes_ = [
        f"abs((shiftrightunsigned({a}.behind_{half}, {8 * k}) & 255) - (shiftrightunsigned({b}.behind_{half}, {8 * k}) & 255))"
        for half in (0, 1)
        for k in range(8)
    ]
    return (
        f"least({a}.n, {b}.n) * 100 >= greatest({a}.n, {b}.n) * {percent} "
        f"and 1 + least({left[0]}, {left[1]}) >= {needed} "
        f"and {' + '.join(bytes_)} <= {left[0]} + {left[1]} - 2 * ({needed} - 1)"
    )


MEMBER = ("gram", "rep", "n", "position", "behind_0", "behind_1")


def _labelled(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Rows of ``members`` whose n-gram's sets lie in different components, with their component ``label``."""
    if labels is None:
        return members.withColumn("label", F.col("rep"))
    named = members.join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    named = named.select(*MEMBER, F.coalesce("component", "rep").alias("label"))
    apart = named.groupBy("gram").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
    return stored(named.join(apart.select("gram"), "gram", "left_semi"), "open")


def _with_hub(open_: DataFrame, turn: int, percent: int) -> DataFrame:
    """(a, b): one set of every n-gram with all others that pass the filters and lie in another component."""
    mask = F.lit((0, -1, 0x5555555555555555)[turn % 3])  # another order of the ids in every round
    hubs = open_.groupBy("gram").agg(F.min(F.col("rep").bitwiseXOR(mask)).bitwiseXOR(mask).alias("rep"))
    hubs = open_.join(hubs, ["gram", "rep"]).alias("h")
    met = hubs.join(open_.alias("m"), F.expr(f"h.gram = m.gram and h.label <> m.label and {may_link('h', 'm', percent)}"))
    return met.selectExpr("least(h.rep, m.rep) as a", "greatest(h.rep, m.rep) as b").distinct()


def _in_full(open_: DataFrame, percent: int) -> DataFrame:
    """(a, b): all pairs of sets of one n-gram that pass the filters and lie in different components.

    A block holds sets of one n-gram and class of length, and of one component
    if that has many of them; a class is as wide as linked lengths may differ.
    """
    width = math.log(100 / percent) * (1 + 1e-6) if percent < 100 else 1e-6
    rows = open_.withColumn("class", F.floor(F.log(F.col("n").cast("double")) / width))
    key = ["gram", "class"]
    sizes = rows.groupBy(*key, "label").agg(F.count("*").alias("size"))
    big = F.col("size") >= BLOCK
    pools = sizes.where(~big).groupBy(*key).agg(F.sum("size").alias("pool"))
    sizes = sizes.join(pools, key, "left").select(
        *key, "label", F.when(big, F.col("label")).alias("alone"), F.ceil(F.when(big, F.col("size")).otherwise(F.col("pool")) / BLOCK).alias("many")
    )
    number = F.pmod(F.xxhash64(F.when(F.col("alone").isNull(), F.col("label")).otherwise(F.col("rep"))), F.col("many"))
    dealt = stored(rows.join(sizes, [*key, "label"]).withColumn("number", number).drop("many"), "dealt")
    blocks = dealt.select(*key, "alone", "number").distinct()
    place = lambda side: F.struct(*(F.col(f"{side}.{c}") for c in ("class", "alone", "number")))
    one, two = blocks.alias("one"), blocks.alias("two")
    near = "one.gram = two.gram and two.class - one.class between -1 and 1 and not coalesce(one.alone = two.alone, false)"
    pairs = one.join(two, F.expr(near)).select(F.col("one.gram").alias("gram"), place("one").alias("block"), place("two").alias("block2"))
    pairs = pairs.where("block <= block2")
    at = F.struct("class", "alone", "number")
    rows = dealt.select(*MEMBER, "label", at.alias("place"))
    left = pairs.alias("p").join(rows.alias("a"), F.expr("p.gram = a.gram and p.block <=> a.place"))
    left = left.select("a.*", "p.block2").alias("a")
    met = left.join(
        rows.alias("b"),
        F.expr(
            "a.gram = b.gram and a.block2 <=> b.place and a.label <> b.label "
            f"and (a.rep < b.rep or a.place <> b.place) and {may_link('a', 'b', percent)}"
        ),
    )
    return met.selectExpr("least(a.rep, b.rep) as a", "greatest(a.rep, b.rep) as b").distinct()


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs that are links, each compared once on full sets."""
    one = sets.select(F.col("id").alias("a"), F.col("grams").alias("s1"))
    two = sets.select(F.col("id").alias("b"), F.col("grams").alias("s2"))
    size = (F.length("s1") + F.length("s2")) / 8
    common = shared("s1", "s2")
    both = pairs.join(one, "a").join(two, "b").select("a", "b", size.alias("size"), common.alias("shared"))
    return both.where(F.col("shared") * 100 >= (F.col("size") - F.col("shared")) * percent).select("a", "b")


def similar_documents(
    docs: DataFrame, percent: int = 85, words: int = 4, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_shingles, component_id: one row for each row of ``docs``.

    Two documents are linked if 100 * |intersection| >= ``percent`` * |union| of
    their sets of ``words``-word n-grams (words are ``[^ \\t-\\r]+`` with A-Z as
    a-z; fewer words are one n-gram). component_id is the smallest doc_id that
    links reach. Null and empty texts, and texts of white space, have no n-grams
    and no links. Rows that share a doc_id are one document with several texts:
    what is linked to any of them is in its component. A row without doc_id
    takes no part, its component_id is null. Other columns play no part.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sized = stored(sized_sets(docs, words), "sized")
    known = sized.where("bucket is null")
    told = sized.where("bucket is not null").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(BUCKETS, np.int32)
    counts[told["bucket"].to_numpy()] = np.minimum(told["n"].to_numpy(), 2**31 - 1)
    classes = known.where("n > 0").groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep")).where("rep is not null")
    # Written, so that joins with it are dealt anew and a class of very many copies is split among tasks.
    classes = stored(classes, "classes")

    taken = prefixes(docs, counts, percent, words)
    firsts = classes.withColumnRenamed("rep", "doc_id")
    taken = stored(taken.join(firsts, ["doc_id", "set_a", "set_b"], "left_semi"), "prefixes")
    often = taken.select(F.explode("grams").alias("gram")).groupBy("gram").count().where("count > 1").select("gram")
    entry = F.posexplode(F.arrays_zip("grams", "behind_0", "behind_1")).alias("at", "entry")
    members = taken.select(F.col("doc_id").alias("rep"), "n", entry).select(
        F.col("entry.grams").alias("gram"), "rep", "n", (F.col("at") + 1).alias("position"), "entry.behind_0", "entry.behind_1"
    )
    members = stored(members.join(often, "gram", "left_semi"), "members")

    belongs = known.join(classes, ["set_a", "set_b"], "left").select("doc_id", "n", "rep")
    several = stored(known.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select("doc_id"), "several")
    own = belongs.where("rep <> doc_id").join(several, "doc_id", "left_semi").select("doc_id", "rep").distinct().toDF("a", "b")
    links, labels, sets = own, None, None
    if several.limit(1).count():
        labels = stored(components(links), "labels")
    for turn in range(ROUNDS + 1):
        open_ = _labelled(members, labels)
        pairs = _with_hub(open_, turn, percent) if turn < ROUNDS else _in_full(open_, percent)
        pairs = stored(pairs, "pairs")
        wanted = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
        if sets is not None:
            wanted = wanted.join(sets.select(F.col("id").alias("doc_id")), "doc_id", "left_anti")
        more = stored(full_sets(docs.join(wanted, "doc_id", "left_semi"), words), "sets")
        sets = more if sets is None else sets.unionByName(more)
        found = stored(_verified(pairs, sets, percent), "links")
        links = links.unionByName(found)
        if found.limit(1).count():
            labels = stored(components(links), "labels")
    whole = belongs.withColumn("rep", F.coalesce("rep", "doc_id"))
    if labels is None:
        whole = whole.withColumn("component", F.lit(None).cast("long"))
    else:
        whole = whole.join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    return whole.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep")).alias("component_id"),
    )
