"""Best-fit packing of documents into sequences, planned over the histogram of lengths.

Documents become token pieces of at most ``width`` tokens. Only the number of
pieces of each length reaches the driver: at most ``width`` rows, however many
documents there are. Best-fit decreasing then runs over those counts: all
sequences with the same room left form one group, and pieces of one length
fill a group in one step. The plan is a list of slots, each "ranks a to b of
length L go to these sequences at this offset"; a piece finds its slot by its
rank among the pieces of its length.

Size of the plan: a length adds at most three groups, and a group that is
filled has less than half its room left, so with ``width`` 2048 there are
never more than 3 * 2048 * 11 slots (about 3 MB). That is why the plan may be
broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pixeltide.llm.bpe import WordIds
from pixeltide.llm.words import encode_texts, merges
from pixeltide.llm.workers import slices
from pixeltide.sources.shared_folder import stored

#: As ``bpe.REMEMBERED``; less, since packing follows other stages in the same workers.
REMEMBERED = 150_000
#: Bytes of text encoded together.
SLICE = 1_000_000


class Slot(NamedTuple):
    """Pieces of ``length`` with ranks ``rank`` to ``rank + pieces - 1``: ``each`` to a sequence."""

    length: int
    rank: int
    pieces: int
    sequence: int
    each: int
    offset: int


def plan_sequences(histogram: dict[int, int], width: int) -> list[Slot]:
    """Best-fit decreasing over ``{length: pieces}``; the number of sequences is the plan's last one plus 1."""
    if any(not 0 < length <= width for length in histogram):
        raise ValueError("every piece needs a length from 1 to the width of a sequence")
    groups: dict[int, list[tuple[int, int]]] = {}  # by room left: (first sequence, sequences)
    slots: list[Slot] = []
    used = 0
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            room = min((r for r in groups if r >= length), default=0)
            if not room:
                room, new = width, -(-left // (width // length))
                groups[width] = [(used, new)]
                used += new
            first, many = groups[room].pop()
            each = room // length
            filled = min(many, left // each)
            if filled:
                slots.append(Slot(length, rank, filled * each, first, each, width - room))
                groups.setdefault(room - each * length, []).append((first, filled))
                rank, left = rank + filled * each, left - filled * each
            first, many = first + filled, many - filled
            if many and left:  # the last pieces of this length half fill one sequence
                slots.append(Slot(length, rank, left, first, each, width - room))
                groups.setdefault(room - left * length, []).append((first, 1))
                first, many, left = first + 1, many - 1, 0
            if many:
                groups[room].append((first, many))
            groups = {r: g for r, g in groups.items() if g and r}
    return slots


@lru_cache(maxsize=2)
def _tokenizer(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def _word_ids(path: str) -> tuple[WordIds, dict[str, int]]:
    """Memory of words, and special tokens; the library takes its memory only when a word asks for it."""
    return WordIds(lambda word: _tokenizer(path).encode(word, add_special_tokens=False).ids, REMEMBERED), merges(path).special


def cuts(tokens: int, width: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document; only the first may be shorter than ``width``."""
    first = tokens % width or width
    return [(0, min(first, tokens)), *((start, width) for start in range(first, tokens, width))]


def token_pieces(
    docs: DataFrame, path: str, width: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Pieces of every document's token ids and ``end_id``: doc_id, piece, start, length, ids (little-endian 32-bit).

    Whole texts, null as empty; an empty text is its end id alone. Each distinct
    word of a batch is encoded once, see ``words``; the tokenizers library does
    what is rare, remembered per worker, since it is slow on whole texts.
    """
    end = end_id.to_bytes(4, "little")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, special = _word_ids(path)
        for batch in batches:
            types = (batch.column(0).type, pa.int32(), pa.int64(), pa.int64(), pa.binary())
            for first, texts in slices(batch.column(1), SLICE):
                out: tuple[list, ...] = ([], [], [], [], [])
                encoded = encode_texts([t or "" for t in texts.to_pylist()], merges(path), known, special)
                for doc_id, ids in zip(batch.column(0).slice(first, len(texts)).to_pylist(), encoded):
                    ids += end
                    for k, (start, length) in enumerate(cuts(len(ids) // 4, width)):
                        for column, value in zip(out, (doc_id, k, start, length, ids[4 * start : 4 * (start + length)])):
                            column.append(value)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(out, types)], names=["doc_id", "piece", "start", "length", "ids"]
                )

    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(pieces, f"doc_id {kind}, piece int, start long, length long, ids binary")


def place(pieces: DataFrame, width: int = 2048, key: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """``pieces`` (with a ``length``) plus sequence_id and offset.

    Reads ``pieces`` twice, so give it a written table. Ranks within a length
    are counted per (length, bucket of the key), so a length that most pieces
    share is still spread over many tasks; pieces with equal keys may swap
    places, which changes nothing but which of them goes first.
    """
    spark = pieces.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = pieces.withColumn("_bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)))
    counts = dealt.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    counts = stored(counts, "piece-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    slots = spark.createDataFrame(
        plan_sequences(histogram, width),
        "_length long, _rank long, _pieces long, _sequence long, _each long, _offset long",
    )
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy("length", "_bucket").orderBy(*key)
    ranked = (
        dealt.withColumn("_at", F.row_number().over(within) - 1)
        .join(bases, ["length", "_bucket"])
        .withColumn("_at", F.col("_at") + F.col("_base"))
    )
    found = ranked.join(
        F.broadcast(slots),
        (F.col("length") == F.col("_length"))
        & (F.col("_at") >= F.col("_rank"))
        & (F.col("_at") < F.col("_rank") + F.col("_pieces")),
    )
    return found.withColumn("_nth", F.col("_at") - F.col("_rank")).select(
        *(c for c in pieces.columns if c not in ("sequence_id", "offset")),
        F.expr("_sequence + _nth div _each").alias("sequence_id"),
        F.expr("_offset + _nth % _each * length").alias("offset"),
    )


def pack(
    docs: DataFrame, path: str, width: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Where every piece of every document goes, without the ids but with their CRC-32.

    An empty table gives no rows. Repeated doc_ids are packed as documents of their own.
    """
    pieces = token_pieces(docs, path, width, end_id, id_col, text_col)
    known = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return place(stored(known, "pieces"), width, ("doc_id", "piece", "ids_crc32"))
