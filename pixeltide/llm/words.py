"""Token ids of a whole batch of texts: words are cut in arrays, and the merges of all distinct words run side by side.

For texts whose characters all lie in Latin-1, a character is a byte, so the
vocabulary's word pattern becomes comparisons of neighbouring bytes' classes.
The words of a batch are numbered by Arrow's dictionary encoding, which is
exact. Distinct words of about the same length are rows of a matrix; in every
round each row makes its earliest merge, the leftmost if it has several, until
no row has any: the merges are those of one word at a time. Ids are then
gathered for all words at once. Other texts, texts that hold a special token,
and words of more than ``LONGEST`` bytes take the pattern and the word encoder.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa

from pixeltide.llm.bpe import LATIN_SPACE, LETTER, NUMBER, WordIds, _byte_letters, encode_text, specials_pattern
from pixeltide.llm.workers import bytes_of

#: Bytes of a word merged side by side with others, and such words in a matrix.
LONGEST, TOGETHER = 48, 8192
NEVER = np.iinfo(np.int32).max

SPACE_CLASS, LETTER_CLASS, NUMBER_CLASS, OTHER = range(4)


def _classes() -> np.ndarray:
    out = np.full(256, OTHER, np.uint8)
    for kind, chars in ((SPACE_CLASS, LATIN_SPACE), (LETTER_CLASS, LETTER), (NUMBER_CLASS, NUMBER)):
        one = re.compile(f"[{chars}]")
        out[[c for c in range(256) if one.match(chr(c))]] = kind
    return out


_CLASS = _classes()
_BLANK, _QUOTE = 0x20, 0x27
#: Letters after a quote that make a word with it, alone or with the one that must follow.
_ALONE = np.isin(np.arange(256), list(b"stmd"))
_PAIRED = np.zeros((256, 256), bool)
for _one, _two in (b"re", b"ve", b"ll"):
    _PAIRED[_one, _two] = True


def word_starts(raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where the words of Latin-1 texts begin; ``bounds`` are the texts' places in ``raw``, none of them empty."""
    kind = _CLASS[raw]
    first = np.zeros(len(raw) + 3, bool)  # of a text; the end counts as one
    first[bounds] = True
    starts = first[: len(raw)].copy()
    starts[1:] |= kind[1:] != kind[:-1]
    # The white space before a run is a word of its own, or, if it is a blank, the run's first character.
    runs = np.flatnonzero(starts & (kind != SPACE_CLASS) & ~first[: len(raw)])
    runs = runs[kind[runs - 1] == SPACE_CLASS]
    starts[runs - 1] = True
    starts[runs[raw[runs - 1] == _BLANK]] = False
    # A quote that begins a word and stands alone takes the letters of a contraction.
    padded, kinds = np.append(raw, [0, 0, 0]), np.append(kind, [OTHER] * 3)
    quotes = np.flatnonzero((raw == _QUOTE) & starts)
    quotes = quotes[(kinds[quotes + 1] == LETTER_CLASS) & ~first[quotes + 1]]
    alone = quotes[_ALONE[padded[quotes + 1]]]
    paired = quotes[_PAIRED[padded[quotes + 1], padded[quotes + 2]] & ~first[quotes + 2]]
    for taken, size in ((alone, 2), (paired, 3)):
        starts[taken + 1] = False
        rest = taken + size
        rest = rest[~first[rest] & (kinds[rest] == LETTER_CLASS)]
        starts[rest] = True
    return np.flatnonzero(starts)


class Merges:
    """Merges of a byte-level BPE file as arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        model = content["model"]
        self.special = {t["content"]: t["id"] for t in content["added_tokens"]}
        ids, letters = model["vocab"], {b: c for c, b in _byte_letters().items()}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left, right = (np.array([ids[p[k]] for p in pairs], np.int64) for k in (0, 1))
        #: Token of every merge, in their order.
        self.whole = np.array([ids[p[0] + p[1]] for p in pairs], np.int32)
        self.step = max(ids.values()) + 2
        keys = left * self.step + right
        self.order = np.argsort(keys, kind="stable").astype(np.int32)
        self.keys = keys[self.order]
        self.of_byte = np.array([ids[letters[b]] for b in range(256)], np.int32)
        self.of_bytes = self.rank(np.repeat(self.of_byte, 256), np.tile(self.of_byte, 256)).reshape(256, 256)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Number of the merge of each two tokens, ``NEVER`` if there is none; token -1 has none."""
        if not len(self.keys):
            return np.full(len(left), NEVER, np.int32)
        wanted = left.astype(np.int64) * self.step + right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        known = (self.keys[at] == wanted) & (left >= 0) & (right >= 0)
        return np.where(known, self.order[at], NEVER)

    def _together(self, raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of similar size one after the other, and their number in each word."""
        width, many = int(sizes.max()) + 1, len(sizes)  # the last slot of a row is its end
        column = np.arange(width)
        inside = column < sizes[:, None]
        text = raw[np.where(inside, starts[:, None] + column, 0)]
        ids = np.where(inside, self.of_byte[text], -1).ravel()
        rank = np.full((many, width), NEVER, np.int32)
        rank[:, :-1] = np.where(inside[:, 1:], self.of_bytes[text[:, :-1], text[:, 1:]], NEVER)
        flat, kept = rank.reshape(-1), inside.ravel()
        after, before = np.arange(1, many * width + 1), np.arange(-1, many * width - 1)
        live = np.arange(many)
        while True:
            rows = rank[live]
            column = rows.argmin(1)
            merge = rows[np.arange(len(live)), column]
            going = merge < NEVER
            live, column, merge = live[going], column[going], merge[going]
            if not len(live):
                return ids[kept], kept.reshape(many, width).sum(1)
            at = live * width + column
            gone = after[at]
            following = after[gone]
            ids[at], kept[gone], flat[gone] = self.whole[merge], False, NEVER
            after[at], before[following] = following, at
            flat[at] = self.rank(ids[at], ids[following])
            some = column > 0
            at = at[some]
            earlier = before[at]
            flat[earlier] = self.rank(ids[earlier], ids[at])

    def encode(self, raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of words (UTF-8 bytes in ``raw``), where each word's begin, and how many it has."""
        order = np.argsort(sizes, kind="stable")
        found, counts = [np.zeros(0, np.int32)], np.zeros(len(sizes), np.int64)
        for first in range(0, len(order), TOGETHER):
            rows = order[first : first + TOGETHER]
            ids, counts[rows] = self._together(raw, starts[rows], sizes[rows])
            found.append(ids)
        places = np.zeros(len(sizes), np.int64)
        places[order] = np.cumsum(counts[order]) - counts[order]
        return np.concatenate(found), places, counts


@lru_cache(maxsize=2)
def merges(path: str) -> Merges:
    """The merges of a file, loaded once per Python worker."""
    return Merges(path)


def _as_utf8(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Latin-1 bytes and the bounds of words in them, as UTF-8."""
    size = 1 + (raw >= 0x80)
    ends = np.cumsum(size)
    out = np.repeat(raw, size)
    high = np.flatnonzero(raw >= 0x80)
    out[ends[high] - 2] = 0xC0 | raw[high] >> 6
    out[ends[high] - 1] = 0x80 | raw[high] & 0x3F
    return out, np.concatenate([[0], ends])[bounds]


def _latin(coded: list[bytes], known: Merges, word_ids: WordIds) -> list[bytes]:
    """Ids of non-empty texts in Latin-1."""
    bounds = np.cumsum([0, *map(len, coded)])
    whole = b"".join(coded)
    starts = word_starts(np.frombuffer(whole, np.uint8), bounds)
    cuts = np.append(starts, len(whole)).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(cuts), pa.py_buffer(whole)]).dictionary_encode()
    raw, ends = _as_utf8(*bytes_of(words.dictionary))
    sizes = np.diff(ends)
    usual = np.flatnonzero(sizes <= LONGEST)
    places, counts = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    ids, places[usual], counts[usual] = known.encode(raw, ends[:-1][usual], sizes[usual])
    rest, total = [ids], len(ids)
    for i in np.flatnonzero(sizes > LONGEST):
        rest.append(np.frombuffer(word_ids[raw[ends[i] : ends[i + 1]].tobytes().decode()], "<i4"))
        places[i], counts[i] = total, len(rest[-1])
        total += len(rest[-1])
    ids = np.concatenate(rest)
    number = words.indices.to_numpy()
    each = counts[number]
    ends = np.cumsum(each)
    found = ids[np.repeat(places[number] - ends + each, each) + np.arange(ends[-1])]
    text_ends = 4 * ends[np.searchsorted(starts, bounds[1:]) - 1]
    data = found.astype("<i4").tobytes()
    return [data[a:b] for a, b in zip([0, *text_ends[:-1].tolist()], text_ends.tolist())]


def encode_texts(texts: list[str], known: Merges, word_ids: WordIds, special: dict[str, int]) -> list[bytes]:
    """What ``bpe.encode_text`` gives for each text, of a batch at once."""
    out = [b""] * len(texts)
    marked = specials_pattern(special)
    plain, coded = [], []
    for i, text in enumerate(texts):
        if not text:
            continue
        try:
            latin = None if marked and marked.search(text) else text.encode("latin-1")
        except UnicodeEncodeError:
            latin = None
        if latin is None:
            out[i] = encode_text(text, word_ids, special)
        else:
            plain.append(i)
            coded.append(latin)
    if plain:
        for i, ids in zip(plain, _latin(coded, known, word_ids)):
            out[i] = ids
    return out
