"""Language identification by cross-parsing.

Every language has a labelled sample. A text is parsed against each sample:
from left to right, take the longest phrase that occurs anywhere in the sample,
then start anew. A text in the sample's language needs few phrases. The number
of phrases times the bits that name a place in the sample, per character,
estimates the cross entropy; the language with the least wins.

A suffix automaton of each sample finds longest phrases in one step a
character. The automata of all languages lie in one table of moves that holds
edges only, so many segments of many texts are parsed at once, one look into
it for each character position, and large scripts take no more memory than
small ones.

Texts are compared in lower case; everything that is no letter counts as one
blank, so layout, digits and junk do not matter. Whole texts are parsed, in
segments of ``SEGMENT`` characters; a segment's end ends a phrase.
"""

from __future__ import annotations

import math
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixeltide.llm.workers import slices

#: Characters of a segment, and bytes of texts parsed at once.
SEGMENT, TOGETHER = 1024, 1_000_000
#: Fixed classes of characters; letters of the samples follow.
BLANK, OTHER = 0, 1
#: Share of the slots of the table of moves that hold an edge, but for one more slot a state.
FILLED = 0.8


class Sample(NamedTuple):
    """Labelled text of one language."""

    language: str
    text: str


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def suffix_automaton(codes: np.ndarray) -> list[dict[int, int]]:
    """Edges {class: state} of each state of the automaton of all substrings of ``codes``; state 0 is the root.

    There are at most two states and three edges for each character, whatever the alphabet.
    """
    edges: list[dict[int, int]] = [{}]
    link, longest, last = [-1], [0], 0
    for c in codes.tolist():
        new = len(edges)
        edges.append({})
        longest.append(longest[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and c not in edges[at]:
            edges[at][c] = new
            at = link[at]
        if at >= 0:
            there = edges[at][c]
            if longest[there] == longest[at] + 1:
                link[new] = there
            else:
                split = len(edges)
                edges.append(edges[there].copy())
                longest.append(longest[at] + 1)
                link.append(link[there])
                link[there] = link[new] = split
                while at >= 0 and edges[at].get(c) == there:
                    edges[at][c] = split
                    at = link[at]
        last = new
    return edges


def _placed(degrees: np.ndarray, classes: np.ndarray, width: int) -> tuple[np.ndarray, int]:
    """A base of each state, and the number of slots, so that no two edges share the slot base + class.

    ``classes`` are those of all edges, state by state. No two states share a
    base, and none has 0. States with many edges are placed first, each at
    random places until all its slots are free.
    """
    rng = np.random.default_rng(0)
    room = int(len(classes) / FILLED) + len(degrees) + 2
    firsts = np.cumsum(degrees) - degrees
    base = np.zeros(len(degrees), np.int64)
    used, taken = np.zeros(room + width, bool), np.zeros(room, bool)
    taken[0] = True
    slots_of, states_of = np.zeros(room + width, np.int64), np.zeros(room, np.int64)
    sizes = np.frexp(degrees.astype(float))[1]
    for size in sorted(set(sizes.tolist()), reverse=True):
        left = np.flatnonzero(sizes == size)
        while len(left):
            tried = rng.integers(1, room, len(left))
            many = degrees[left]
            owner = np.repeat(np.arange(len(left)), many)
            at = np.repeat(firsts[left] - np.cumsum(many) + many, many) + np.arange(len(owner))
            slots = tried[owner] + classes[at]
            # Of those that want one place in this round the last one written has it.
            slots_of[slots], states_of[tried] = owner, np.arange(len(left))
            fits = ~taken[tried] & (states_of[tried] == np.arange(len(left)))
            fits[owner[used[slots] | (slots_of[slots] != owner)]] = False
            base[left[fits]] = tried[fits]
            taken[tried[fits]] = True
            used[slots[fits[owner]]] = True
            left = left[~fits]
    return base, room + width


class Parser:
    """The automata of all samples as one table of moves.

    A state is a number, its base; the edge by class c lies in slot base + c,
    which holds the base it belongs to and the base it leads to. So memory grows
    with the characters of the samples, not with their alphabets. A slot of
    another state means that there is no such edge: a phrase ends, and the next
    one begins with this character, by the moves from the root, which has base 0
    and no slots.
    """

    def __init__(self, samples: tuple[Sample, ...]):
        self.languages = [s.language for s in samples]
        letters = sorted({ord(c) for s in samples for c in s.text.lower() if c.isalpha()})
        self.classes = 2 + len(letters)
        self.known = np.where(_letters(), np.int32(OTHER), np.int32(BLANK))
        self.known[letters] = np.arange(2, self.classes)
        moves, starts, self.bits, shift = [np.zeros(0, np.int64)], [], [], 0
        for sample in samples:
            codes = self.codes(sample.text)[0]
            edges = suffix_automaton(codes)
            degrees = np.array([len(e) for e in edges], np.int64)
            classes = np.fromiter((c for e in edges for c in e), np.int64, degrees.sum())
            to = np.fromiter((t for e in edges for t in e.values()), np.int64, degrees.sum())
            del edges
            root = int(degrees[0])
            base, slots = _placed(degrees[1:], classes[root:], self.classes)
            base = np.concatenate([[0], base + shift])
            start = np.zeros(self.classes, np.int64)
            start[classes[:root]] = base[to[:root]]
            starts.append(start)
            part, owner = np.full(slots, -1, np.int64), np.repeat(base[1:], degrees[1:])
            part[owner - shift + classes[root:]] = owner << 32 | base[to[root:]]
            moves.append(part)
            self.bits.append(math.log2(len(codes) + 2))
            shift += slots
        self.moves = np.concatenate(moves)
        self.starts = np.array(starts).reshape(len(samples), self.classes)

    def codes(self, text: str) -> tuple[np.ndarray, bool]:
        """Classes of the characters, runs of blanks as one; and whether there is a letter."""
        codes = self.known[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
        blank = codes == BLANK
        again = np.zeros(len(codes), bool)
        again[1:] = blank[1:] & blank[:-1]
        return codes[~again], not blank.all()

    def phrases(self, rows: list[np.ndarray]) -> np.ndarray:
        """Number of phrases [row, language]."""
        lengths = np.array([len(r) for r in rows], np.int64)
        segments = -(-lengths // SEGMENT)
        owner = np.repeat(np.arange(len(rows)), segments)
        total = np.zeros((len(rows), len(self.languages)), np.int64)
        if not len(owner):
            return total
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(segments) - segments, segments)
        size = np.minimum(SEGMENT, lengths[owner] - nth * SEGMENT)
        order = np.argsort(-size, kind="stable")
        owner, size = owner[order], size[order]
        begins = ((np.cumsum(lengths) - lengths)[owner] + nth[order] * SEGMENT)[:, None]
        data = np.concatenate(rows)
        active = len(size) - np.searchsorted(size[::-1], np.arange(1, size[0] + 1))
        state = np.zeros((len(size), len(self.languages)), np.int64)
        count = np.zeros((len(size), len(self.languages)), np.int32)
        if not len(self.languages):
            return total
        for t, n in enumerate(active.tolist()):
            code = data[begins[:n] + t]
            move = self.moves.take(state[:n] + code)
            ends = move >> 32 != state[:n]
            move &= 0xFFFFFFFF
            row, language = np.nonzero(ends)
            move[row, language] = self.starts[language, code[row, 0]]
            count[:n] += ends
            state[:n] = move
        np.add.at(total, owner, count)
        return total

    def bits_per_character(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Cross entropy [text, language], and whether the text has a letter."""
        rows, lettered = zip(*(self.codes(t or "") for t in texts)) if texts else ((), ())
        counts = self.phrases(list(rows))
        sizes = np.array([max(1, len(r)) for r in rows])
        return counts * np.array(self.bits) / sizes[:, None], np.array(lettered, bool)


@lru_cache(maxsize=1)
def _parser(samples: tuple[Sample, ...]) -> Parser:
    return Parser(samples)


def learn(
    labelled: DataFrame, texts: int = 60, characters: int = 50_000, languages: int = 200,
    id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
) -> tuple[Sample, ...]:
    """Samples from rows with a text and a language.

    The bound is ``texts`` texts (those with the least hash of the id, so a
    fixed choice at random) and ``characters`` characters for each language,
    for at most ``languages`` languages (more are an error). Rows with null
    text or language teach nothing.
    """
    rows = labelled.select(
        F.xxhash64(F.col(id_col)).alias("at"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")
    ).where("text is not null and lang is not null")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().limit(languages + 1).collect()}
    if len(counts) > languages:
        raise ValueError(f"more than {languages} languages")
    if not counts:
        return ()
    # A share that leaves about 20 times the wanted rows is ranked, so no task ranks a whole language.
    share = F.create_map(*(F.lit(x) for k, n in counts.items() for x in (k, min(1.0, 20 * texts / n))))
    within = F.pmod("at", F.lit(1 << 30)) < F.element_at(share, F.col("lang")) * (1 << 30)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("at", "text"))
    chosen = (
        rows.where(within)
        .withColumn("text", F.substring("text", 1, characters))
        .withColumn("rank", rank)
        .where(F.col("rank") <= texts)
    )
    by_language: dict[str, str] = {}
    for r in sorted(chosen.collect(), key=lambda r: (r["lang"], r["rank"])):
        by_language[r["lang"]] = by_language.get(r["lang"], "") + r["text"] + "\n"
    return tuple(Sample(k, v[:characters]) for k, v in sorted(by_language.items()))


def predict(text: Column, samples: tuple[Sample, ...]) -> Column:
    """Struct of ``lang_pred``, ``score`` and ``lettered`` of a text column.

    ``und`` with score 0 for null, for texts without any letter, and if nothing
    was learned. The score is the share by which the best language needs fewer
    bits than the next (1 if there is no other); ties go to the smaller name.
    ``lettered`` says whether the text has a letter, whatever was learned.
    """

    @F.arrow_udf("lang_pred string, score double, lettered boolean")
    def identify(texts: pa.Array) -> pa.Array:
        parser = _parser(samples)
        names, scores, letters = ["und"] * len(texts), [0.0] * len(texts), [False] * len(texts)
        if len(texts):
            for start, part in slices(texts, TOGETHER):
                bits, lettered = parser.bits_per_character(part.to_pylist())
                letters[start : start + len(part)] = lettered.tolist()
                if not parser.languages:
                    continue
                order = np.argsort(bits, axis=1, kind="stable")
                for i in np.flatnonzero(lettered).tolist():
                    best = order[i, 0]
                    names[start + i] = parser.languages[best]
                    rest = bits[i, order[i, 1]] if len(parser.languages) > 1 else np.inf
                    scores[start + i] = 1.0 - bits[i, best] / rest
        return pa.StructArray.from_arrays(
            [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(letters, pa.bool_())],
            names=["lang_pred", "score", "lettered"],
        )

    # Else a filter on the result would have it evaluated again, by a second Python worker in each task.
    return identify.asNondeterministic()(text)


def identify(
    docs: DataFrame, samples: tuple[Sample, ...], text_col: str = "text"
) -> DataFrame:
    """``docs`` plus lang_pred and score, replacing columns of these names."""
    kept = [F.col(c) for c in docs.columns if c not in ("lang_pred", "score")]
    found = docs.select(*kept, predict(F.col(text_col), samples).alias("_found"))
    return found.select(*kept, "_found.lang_pred", "_found.score")
