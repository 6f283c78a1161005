"""WARC archives of pages, and the audit of replicas by Merkle trees.

An archive is a folder ``file=N`` per WARC file, written by Spark's text writer;
records end with an empty line, so the writer's separator completes them. The
reader unpacks all gzip members of a file, follows Content-Length, byte for
byte, and goes on at the next record header where a record is broken. Bytes
that belong to no record (before, between or behind them, or what no longer
unpacks) are leaves too, without an id: every byte lies under the root.

The tree of a file has its records, by offset, as leaves. The nodes above cover
ranges of offsets, 64 KiB wide on the first level and 16 times as wide on each
next one; the root covers the file. A node's digest covers the places and
digests of its children in order. Two replicas are compared by their roots;
of roots that differ the children are compared, and so on, so only branches
with damage are read again, down to the records.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pixeltide.sources.shared_folder import stored

BLANK_LINE = "\r\n\r\n"
#: Bytes of a range on the first level, how much wider the next is, and levels below the root.
RANGE, FAN, LEVELS = 1 << 16, 16, 4

_START = re.compile(rb"WARC/1\.[01]\r\n")
_LENGTH = re.compile(rb"\r\nContent-Length: *(\d+)", re.IGNORECASE)
_ID = re.compile(rb"\r\nWARC-Record-ID: *<?([^>\r\n]*)", re.IGNORECASE)


def record(record_id: Column, url: Column, content: Column, date: str) -> Column:
    """Text of a WARC resource record without the empty line that ends it. Nulls are empty."""
    line = lambda c: F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"[\r\n]", " ")
    body = F.coalesce(content, F.lit(""))
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <"), line(record_id),
        F.lit(f">\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), line(url),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"),
        F.lit(BLANK_LINE), body,
    )


def write_warc(records: DataFrame, path: str) -> None:
    """Write ``records(file, place, record)`` as gzipped WARC files, in the order of ``place`` within each file.

    A file is written by one task, so choose ``file`` for files of some 100 MB at most.
    """
    dealt = records.repartition("file").sortWithinPartitions("file", "place", "record")
    dealt.select("file", "record").write.partitionBy("file").option("lineSep", BLANK_LINE).option(
        "compression", "gzip"
    ).text(path)


def records_of(data: bytes) -> Iterator[tuple[int, bytes, bytes]]:
    """(offset, id, bytes) of the records of an archive's content, headers included, closing lines not.

    Other bytes come with an empty id. Only the empty lines that close a whole record are in no leaf.
    """
    at = 0
    while at < len(data):
        found = _START.search(data, at)
        start = found.start() if found else len(data)
        if start > at:  # no record's
            yield at, b"", data[at:start]
        if found is None:
            return
        head = data.find(b"\r\n\r\n", start)
        header = data[start : head if head >= 0 else len(data)]
        length, record_id = _LENGTH.search(header), _ID.search(header)
        if head < 0 or length is None:
            end = len(data)
        else:
            end = head + 4 + int(length.group(1))
        whole = data[end : end + 4] == b"\r\n\r\n"
        if not whole:  # broken: up to the next header
            following = _START.search(data, start + 1)
            end = following.start() if following else len(data)
        yield start, record_id.group(1) if record_id else b"", data[start:end]
        at = end + 4 * whole


def unpacked(data: bytes) -> bytes:
    """The content of a file: all of its gzip members one after the other; what does not unpack stays as it is."""
    out = []
    while data[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        try:
            out.append(member.decompress(data))
        except zlib.error:
            break
        out.append(member.flush())
        data = member.unused_data
    return b"".join([*out, data])


def read_leaves(spark: SparkSession, path: str) -> DataFrame:
    """file, offset, length, record_id, digest of every record in an archive; offsets are those of the unpacked file.

    A file is unpacked and read by one task, which holds it. An empty file has no rows.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(*batch.columns):
                data = unpacked(content.as_py())
                rows = [
                    (file.as_py(), at, len(r), i.decode("utf-8", "replace"), hashlib.sha256(r).hexdigest())
                    for at, i, r in records_of(data)
                ]
                yield pa.RecordBatch.from_pylist(
                    [dict(zip(names, r)) for r in rows],
                    pa.schema([("file", pa.int64()), ("offset", pa.int64()), ("length", pa.int64()), ("record_id", pa.string()), ("digest", pa.string())]),
                )

    names = ("file", "offset", "length", "record_id", "digest")
    files = spark.read.format("binaryFile").load(path).select(F.col("file").cast("long").alias("file"), "content")
    return files.mapInArrow(parse, "file long, offset long, length long, record_id string, digest string")


def trees(leaves: DataFrame) -> list[DataFrame]:
    """Levels (file, at, digest) of the trees over ``leaves(file, offset, digest, ...)``, from the roots down to the ranges."""
    below = leaves.select("file", F.col("offset").alias("at"), "digest")
    levels = []
    for level in range(LEVELS + 1):
        up = F.lit(0).cast("long") if level == LEVELS else F.expr(f"at div {RANGE if level == 0 else FAN}")
        child = F.struct("at", "digest")
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(child)), lambda c: F.concat_ws(":", c["at"], c["digest"])), ",")
        below = below.groupBy("file", up.alias("at")).agg(F.sha2(joined, 256).alias("digest"))
        below = stored(below.select("file", "at", "digest"), "tree")
        levels.append(below)
    return levels[::-1]


def _differing(one: DataFrame, two: DataFrame) -> DataFrame:
    """Nodes of two levels whose digests differ or that one side lacks."""
    side = lambda df, n: df.select("file", "at", F.col("digest").alias(f"digest_{n}"))
    return side(one, 1).join(side(two, 2), ["file", "at"], "full_outer").where("not digest_1 <=> digest_2")


def audit(one: DataFrame, two: DataFrame) -> DataFrame:
    """Records that differ between two replicas.

    ``one`` and ``two`` are written tables as of ``read_leaves``. Result: file,
    offset, record_id, length, digest (of the first replica, or of the second
    where the first has no such record), found (digest in the second; null if
    it has none, or if only it has the record). Equal replicas give no rows.
    After a record that grew, shrank or went missing all others have moved:
    within the branches that differ, records are matched by file, id and digest
    first, so those that merely moved are left out, then by file and id.
    Records of one id are matched in the order of their offsets.
    """
    first, second = trees(one), trees(two)
    open_ = _differing(first[0], second[0]).select("file", "at")
    for level in range(1, LEVELS + 1):
        up = F.lit(0).cast("long") if level == 1 else F.expr(f"at div {FAN}")
        parents = stored(open_.toDF("file", "up"), "open")
        one_level, two_level = (
            t[level].withColumn("up", up).join(parents, ["file", "up"], "left_semi") for t in (first, second)
        )
        open_ = _differing(one_level, two_level).select("file", "at")
    parents = stored(open_.toDF("file", "up"), "open")
    first, second = (
        t.withColumn("up", F.expr(f"offset div {RANGE}")).join(parents, ["file", "up"], "left_semi").drop("up") for t in (one, two)
    )
    apart = []
    key = ["file", "record_id", "digest"]
    sides = [_numbered(side, *key) for side in (first, second)]
    for side, other in (sides, sides[::-1]):
        left = side.join(other.select(*key, "nth"), [*key, "nth"], "left_anti").drop("nth")
        apart.append(stored(_numbered(left, "file", "record_id"), "apart"))
    names = ("offset", "length", "digest")
    a, b = (df.select("file", "record_id", "nth", *(F.col(c).alias(f"{c}_{n}") for c in names)) for n, df in enumerate(apart, 1))
    found = a.join(b, ["file", "record_id", "nth"], "full_outer")
    either = [F.coalesce(f"{c}_1", f"{c}_2").alias(c) for c in names]
    return found.select(
        "file", either[0], "record_id", *either[1:], F.when(F.col("digest_1").isNotNull(), F.col("digest_2")).alias("found")
    )


def _numbered(leaves: DataFrame, *key: str) -> DataFrame:
    """``leaves`` plus ``nth``: their number among those of one key, by offset."""
    return leaves.withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy("offset")))
