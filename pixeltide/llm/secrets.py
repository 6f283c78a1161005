"""Secrets in texts: three fixed patterns, and windows of high entropy.

DataFrame expressions only. A pattern's matches and the texts between them
alternate, so their lengths give every match's place; places count code points.

The entropy scan looks at candidate strings, runs of at least ``window``
characters of the base64 alphabet. Of each it takes the class, the narrowest
of hex digits, letters and digits, and base64, and slides a window over it. The
window's Shannon entropy follows from the sum of c * log2(c) over the counts c
of its characters. The counts and the sum are kept while the window moves: the
character that leaves takes one off its count, the one that enters adds one,
and the sum changes by their terms. A step costs as much as a candidate has
different characters, so a candidate's cost grows with its length.

The allow list knows whole candidates (UUIDs, words joined by hyphens) and
words of documentation. Such a word cuts the candidate: what lies before and
after it is judged by itself, so the word hides no secret beside it. A candidate
is reported if a piece with a digit and a letter has a window that reaches the
threshold of the piece's class.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds of the base scan in their order, with pattern, measured group and least length.
BASE = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]+", 0, 16),
)

#: Candidates that are no secrets: UUIDs, and four or more short words joined by hyphens, underscores or slashes,
#: as patterns that all have to match and patterns that must not.
UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
JOINED = (r"^[a-z0-9][a-z0-9_/-]*[a-z0-9]$", r"[-_/][^-_/]*[-_/][^-_/]*[-_/]")
NOT_JOINED = (r"[a-z0-9]{13}", r"[-_/]{2}")

#: Words of documentation; a window that holds one is no secret.
DOCUMENTATION = r"(?i)(example|sample|placeholder|changeme|your[-_]|x{6,}|0123456789|abcdefghij)"

#: One character or short pattern repeated.
REPEATED = r"^(.{1,8})\1+$"


class Entropy(NamedTuple):
    """Window length, and least bits per character by class."""

    window: int = 20
    hex: float = 3.0
    alnum: float = 3.6
    base64: float = 3.8


def _spans(text: Column, pattern: str, group: int, least: int) -> Column:
    """Array of (start, end) of the matches of ``pattern`` whose ``group`` has ``least`` characters or more."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    sizes = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.length) if group else F.transform(found, F.length)
    parts = F.arrays_zip(
        F.transform(F.split(text, pattern, -1), F.length).alias("gap"),
        F.transform(found, F.length).alias("hit"),
        sizes.alias("size"),
    )
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("spans"))

    def add(state: Column, part: Column) -> Column:
        begin = state["at"] + part["gap"]
        end = begin + F.coalesce(part["hit"], F.lit(0))
        span = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return F.struct(
            end.alias("at"),
            F.when(part["size"] >= least, F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"),
        )

    return F.aggregate(parts, start, add, lambda s: s["spans"])


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def window_entropy(value: Column, window: int) -> Column:
    """The greatest Shannon entropy, in bits a character, of any window of ``value``; null if it is shorter."""
    terms = F.array(*(F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 1)))

    def scan(codes: Column) -> Column:
        """The least sum of terms of a window of ``codes``, the numbers of the characters from 0 on."""
        moves = F.greatest(F.size(codes) - window, F.lit(0))
        head = F.slice(codes, 1, window)
        counts = F.transform(
            F.sequence(F.lit(0), F.array_max(codes)), lambda k: F.size(F.filter(head, lambda c: c == k))
        )
        first = _let(counts, lambda n: _let(F.aggregate(n, F.lit(0.0), lambda total, c: total + terms[c]), lambda total: F.struct(
            n.alias("counts"), total.alias("sum"), total.alias("least"))))
        pairs = F.arrays_zip(
            F.slice(codes, F.lit(1), moves).alias("out"), F.slice(codes, F.lit(window + 1), moves).alias("into")
        )

        def move(state: Column, pair: Column) -> Column:
            left, came = state["counts"][pair["out"]], state["counts"][pair["into"]]
            change = terms[left - 1] - terms[left] + terms[came + 1] - terms[came]
            counts = F.transform(
                state["counts"],
                lambda c, k: F.when(k == pair["out"], c - 1).when(k == pair["into"], c + 1).otherwise(c),
            )
            moved = lambda total: F.struct(
                counts.alias("counts"), total.alias("sum"), F.least(state["least"], total).alias("least")
            )
            return F.when(pair["out"] == pair["into"], state).otherwise(_let(state["sum"] + change, moved))

        return F.aggregate(pairs, first, move, lambda s: s["least"])

    def coded(letters: Column) -> Column:
        return _let(
            F.array_distinct(letters),
            lambda known: F.transform(letters, lambda c: F.array_position(known, c).cast("int") - 1),
        )

    least = _let(F.split(value, ""), lambda letters: _let(coded(letters), scan))
    return F.when(F.length(value) >= window, F.log2(F.lit(float(window))) - least / window)


def _known(value: Column) -> Column:
    """Whether the allow list knows the whole candidate."""
    joined = F.lit(True)
    for pattern in JOINED:
        joined = joined & value.rlike(pattern)
    for pattern in NOT_JOINED:
        joined = joined & ~value.rlike(pattern)
    return value.rlike(UUID) | joined


def _suspicious(value: Column, limits: Entropy) -> Column:
    """Whether a candidate is not known and has a piece with a window of high entropy for the piece's class."""

    def high(piece: Column) -> Column:
        threshold = (
            F.when(piece.rlike("^[0-9a-fA-F]+$"), limits.hex)
            .when(piece.rlike("^[0-9A-Za-z]+$"), limits.alnum)
            .otherwise(limits.base64)
        )
        judged = (F.length(piece) >= limits.window) & piece.rlike("[0-9]") & piece.rlike("[A-Za-z]") & ~piece.rlike(REPEATED)
        return F.when(judged, window_entropy(piece, limits.window) >= threshold).otherwise(F.lit(False))

    pieces = F.split(F.regexp_replace(value, DOCUMENTATION, " "), " ")
    return F.when(_known(value), F.lit(False)).otherwise(F.exists(pieces, high))


def _entropy_spans(text: Column, limits: Entropy) -> Column:
    pattern = rf"[A-Za-z0-9+/_=-]{{{limits.window},}}"
    # Every match is long enough, so spans and matches go together.
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.array_compact(
        F.zip_with(_spans(text, pattern, 0, limits.window), hits, lambda s, hit: F.when(_suspicious(hit, limits), s))
    )


def _ranked(spans: Column, rank: int) -> Column:
    return F.transform(
        spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("kind"), s["end"].alias("end"))
    )


def find_secrets(docs: DataFrame, limits: Entropy = Entropy(), text_col: str = "text", into: str = "secrets") -> DataFrame:
    """``docs`` plus ``into``: array of (start, end, kind) by start, then kind in the order assign, access, hex, entropy.

    start and end count code points, end exclusive. A null text is empty. A
    column called ``into`` is replaced. Spans of different kinds may overlap; entropy
    spans are added to the base ones and never take one away.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    kinds = [(name, _spans(text, pattern, group, least), pattern) for name, pattern, group, least in BASE]
    kinds.append(("entropy", _entropy_spans(text, limits), rf"[A-Za-z0-9+/_=-]{{{limits.window},}}"))
    none = F.expr("cast(array() as array<struct<start:int,kind:int,end:int>>)")
    each = []
    for rank, (_, spans, pattern) in enumerate(kinds):
        each.append(F.when(text.rlike(pattern), _ranked(spans, rank)).otherwise(none))
    by_start = F.array_sort(F.concat(*each))
    names = F.array(*(F.lit(name) for name, _, _ in kinds))
    named = F.transform(
        by_start,
        lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.element_at(names, s["kind"] + 1).alias("kind")),
    )
    return docs.withColumn(into, named)


def spans_text(spans: Column) -> Column:
    """kind:start:end of every span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


#: Characters of a text's blocks, of which ``mask`` takes the ones that a gap touches.
BLOCK = 1024


def mask(text: Column, spans: Column, by: str = "[SECRET]") -> Column:
    """``text`` with every stretch that spans cover replaced by ``by``; overlapping spans are one stretch.

    Spans come by start, as ``find_secrets`` gives them. A null text stays null,
    a text without spans stays as it is. The text is cut into blocks once, and what
    lies between stretches is taken from its own blocks, so that many spans in a
    long text do not each walk the text from its beginning.
    """

    def cut(blocks: Column) -> Column:
        def between(start: Column, length: Column) -> Column:
            first = F.floor(start / BLOCK).cast("int")
            last = F.floor((start + length) / BLOCK).cast("int")
            near = F.array_join(F.slice(blocks, first + 1, last - first + 1), "")
            return F.substr(near, start - first * BLOCK + 1, length)

        def step(state: Column, s: Column) -> Column:
            ahead = s["start"] >= state["at"]
            gap = between(state["at"], F.greatest(s["start"] - state["at"], F.lit(0)))
            return F.struct(
                F.when(ahead, F.concat(state["parts"], F.array(gap, F.lit(by)))).otherwise(state["parts"]).alias("parts"),
                F.greatest(state["at"], s["end"]).alias("at"),
            )

        start = F.struct(F.expr("cast(array() as array<string>)").alias("parts"), F.lit(0).alias("at"))
        rest = lambda s: F.concat(s["parts"], F.array(between(s["at"], F.length(text) - s["at"])))
        return F.array_join(F.aggregate(spans, start, step, rest), "")

    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    return F.when(F.size(spans) > 0, _let(blocks, cut)).otherwise(text)
