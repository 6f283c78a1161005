"""Merkle fingerprints of documents.

A text is a tree: pieces of sentences (at most 4 words, and of longer ones than
``LONG`` characters the parts between content-defined cuts, so lines without
spaces are cut too) make paragraphs (lines), paragraphs make sections, sections make the root. A section ends at an empty
line or at a paragraph whose digest begins with one of 32 in 256 bytes, so an
inserted paragraph moves no section borders but those around it. A leaf's
digest covers its bytes, an inner node's the digests below, so equal roots mean
equal texts, and two trees differ only along the branches that were edited.

A fingerprint is text: the root in full, then the sections with the first
digits of every digest below,

    root:section>paragraph=leafleaf,paragraph=leaf;section>...

so likeness and the place of edits follow from two fingerprints alone.
"""

from __future__ import annotations

import re
from collections import Counter
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType

_PARAGRAPH = re.compile(r"[^\n]*\n|[^\n]+")
_SENTENCE = re.compile(r"\s*(?:\S*[^\s.!?]\s+){0,3}\S*\s*")
#: Hex digits of a digest inside a fingerprint.
DIGITS = 8
#: First bytes of a paragraph's digest that end a section, of 256.
SECTION_ENDS = 32
#: Characters from which a piece is cut, characters a cut depends on, and least distance of cuts; one place of 32 is a cut.
LONG, WINDOW, APART = 128, 4, 8


def _node(children: list[bytes], level: bytes) -> bytes:
    return blake2b(level + b"".join(children), digest_size=16).digest()


def _cut(piece: str) -> list[str]:
    """Parts of a long piece, cut where its last ``WINDOW`` characters say so, so that edits move no cuts but those near them."""
    points = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    mixed = np.zeros(len(points) - WINDOW + 1, np.uint64)
    for k in range(WINDOW):
        mixed = mixed * np.uint64(1_000_003) + points[k : k + len(mixed)]
    marks = np.flatnonzero(mixed * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(59) == 0) + WINDOW
    cuts = [0]
    for mark in marks.tolist():
        if mark - cuts[-1] >= APART:
            cuts.append(mark)
    return [part for a, b in zip(cuts, [*cuts[1:], len(piece)]) if (part := piece[a:b])]


def _pieces(paragraph: str) -> list[str]:
    pieces = [s for s in _SENTENCE.findall(paragraph) if s]
    if len(paragraph) <= LONG:
        return pieces
    return [part for s in pieces for part in ([s] if len(s) <= LONG else _cut(s))]


def fingerprint_of(text: str) -> str:
    """The fingerprint of a text."""
    sections, section, shown = [], [], []
    out = []
    half = DIGITS // 2
    for paragraph in _PARAGRAPH.findall(text):
        leaves = [blake2b(b"\0" + s.encode("utf-8", "surrogatepass"), digest_size=16).digest() for s in _pieces(paragraph)]
        digest = _node(leaves, b"\1")
        section.append(digest)
        shown.append(digest[:half].hex() + "=" + "".join(x[:half].hex() for x in leaves))
        if paragraph == "\n" or digest[0] < SECTION_ENDS:
            sections.append(_node(section, b"\2"))
            out.append(sections[-1][:half].hex() + ">" + ",".join(shown))
            section, shown = [], []
    if section:
        sections.append(_node(section, b"\2"))
        out.append(sections[-1][:half].hex() + ">" + ",".join(shown))
    return _node(sections, b"\3").hex() + ":" + ";".join(out)


def _sections(fingerprint: str) -> list[str]:
    body = fingerprint.partition(":")[2]
    return body.split(";") if body else []


def _paragraphs(section: str) -> list[str]:
    return section.partition(">")[2].split(",")


def _leaves(paragraph: str) -> list[str]:
    body = paragraph.partition("=")[2]
    return [body[k : k + DIGITS] for k in range(0, len(body), DIGITS)]


def likeness_of(one: str, two: str) -> float:
    """2 * common leaves / all leaves of both trees; 1 only for equal roots.

    Sections and paragraphs that both trees have are counted without looking below them.
    """
    if one.partition(":")[0] == two.partition(":")[0]:
        return 1.0
    size = common = 0
    left, right = Counter(_sections(one)), Counter(_sections(two))
    for below in (_paragraphs, _leaves):
        shared = left & right
        for node, n in shared.items():
            leaves = (len(node) - node.count(">") * (DIGITS + 1) - node.count(",") - node.count("=") * (DIGITS + 1)) // DIGITS
            common += n * leaves
            size += 2 * n * leaves
        left, right = (
            Counter(x for node, n in (tree - shared).items() for x in below(node) * n) for tree in (left, right)
        )
    size += left.total() + right.total()
    common += (left & right).total()
    return min(2 * common / size if size else 0.0, 1.0 - 1.0 / (1 + size))


def edits_between(one: str, two: str) -> list[str]:
    """Places in ``two`` that differ, as section.paragraph.sentence from 0.

    Compares the roots, then only branches whose digests ``one`` lacks.
    """
    if one.partition(":")[0] == two.partition(":")[0]:
        return []
    sections = set(_sections(one))
    paragraphs = {p for s in sections for p in _paragraphs(s)}
    leaves = {x for p in paragraphs for x in _leaves(p)}
    return [
        f"{i}.{j}.{k}"
        for i, s in enumerate(_sections(two)) if s not in sections
        for j, p in enumerate(_paragraphs(s)) if p not in paragraphs
        for k, x in enumerate(_leaves(p)) if x not in leaves
    ]


def fingerprint(text: Column) -> Column:
    """Fingerprint of a text column; a null text is an empty one. Equal texts have equal fingerprints."""

    @F.arrow_udf(StringType())
    def prints(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint_of(t.as_py() or "") for t in texts], pa.string())

    return prints(text)


def likeness(one: Column, two: Column) -> Column:
    """Likeness 0 to 1 of two fingerprint columns; null if either is."""

    @F.arrow_udf(DoubleType())
    def like(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([likeness_of(x.as_py(), y.as_py()) if x.is_valid and y.is_valid else None for x, y in zip(a, b)], pa.float64())

    return like(one, two)


def edits(one: Column, two: Column) -> Column:
    """Places that differ between two fingerprint columns; null if either is."""

    @F.arrow_udf(ArrayType(StringType()))
    def places(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([edits_between(x.as_py(), y.as_py()) if x.is_valid and y.is_valid else None for x, y in zip(a, b)], pa.list_(pa.string()))

    return places(one, two)


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = 2000, ranges: int = 10_000) -> DataFrame:
    """doc_id, text, next_text: each text with that of the next row by falling id; the last row's next is the first.

    Rows are dealt into ranges of ids of about ``rows`` rows (larger ones beyond
    ``ranges`` ranges), whose upper bounds are ids of the table, and the row at
    a bound is copied to the range above it, so that no range needs another one
    and texts are shuffled once. Equal ids are ordered by text; rows without id
    come last; a null text is empty.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    count = docs.where("doc_id is not null").count()
    n = min(ranges, max(1, -(-count // rows)))
    shares = ",".join(repr((k + 1) / n) for k in range(n))
    bounds = docs.agg(F.expr(f"percentile_approx(doc_id, array({shares}))")).first()[0] or []
    bounds = sorted(set(bounds)) or [0]

    @F.arrow_udf("array<int>")
    def ranges_of(ids: pa.Array) -> pa.Array:
        at = pa.array(bounds, pa.int64()).to_numpy()
        places = at.searchsorted(ids.fill_null(int(at[0])).to_numpy()).tolist()
        known = {b: (k + 1) % len(bounds) for k, b in enumerate(bounds)}
        return pa.array([[p, known[i]] if i in known else [p] for i, p in zip(ids.to_pylist(), places)], pa.list_(pa.int32()))

    dealt = docs.select("doc_id", "text", F.posexplode(ranges_of("doc_id")).alias("copy", "range"))
    order = Window.partitionBy("range").orderBy("copy", F.desc_nulls_last("doc_id"), "text")
    following = F.coalesce(F.lead("text").over(order), F.lit(""))
    return dealt.select("doc_id", "text", "copy", following.alias("next_text")).where("copy = 0").drop("copy")
