"""Byte-pair encoding by backtracking, and decoding by an offset table.

Encoding. Text is cut into words by the vocabulary's published pattern; merges
never cross a word. Within a word, one pass of an Aho-Corasick automaton gives
the longest token that starts at each byte. Tokens are then taken from left to
right, longest first. A token may follow another only if the pair is
compatible: undoing their merges, latest first, must never meet two neighbours
that would have been merged earlier. An incompatible token is replaced by its
longest proper prefix that is a token; when none is left, the position is
marked dead and the token before it is shortened instead. Each position dies at
most once, so the work is linear in the word, and the result is exactly that of
running the merges in order.

Decoding. The bytes of all tokens lie in one array with an offset table; ids
become text by one gather.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache
from struct import pack

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

# White space of the pattern, which is Unicode's White_Space.
SPACE = r"\t-\r " + "".join(
    map(chr, (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
)
# Letters and numbers of Latin-1.
LETTER = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
NUMBER = "0-9²³¹¼½¾"
LATIN_SPACE = r"\t-\r \x85\xa0"

#: Most words a worker remembers with their ids, twice: those used lately, and those before them.
REMEMBERED = 300_000


def _word_pattern(engine, letter: str, number: str, space: str):
    return engine.compile(
        rf" ?[{letter}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{number}]+| ?[^{space}{letter}{number}]+"
        rf"|[{space}]+(?![^{space}])|[{space}]+"
    )


LATIN_WORDS = _word_pattern(re, LETTER, NUMBER, LATIN_SPACE)
ALL_WORDS = _word_pattern(regex, r"\p{L}", r"\p{N}", SPACE)


def words_of(text: str) -> list[str]:
    """The words of ``text``; joined they are the text again."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return ALL_WORDS.findall(text)
    return LATIN_WORDS.findall(text)


def _byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in vocabulary files."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """Tokens, merges and special tokens of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        model, letters = content["model"], _byte_letters()
        self.special = {t["content"]: t["id"] for t in content["added_tokens"]}
        size = max([*model["vocab"].values(), *self.special.values()]) + 1
        self.tokens = [b""] * size
        for token, i in model["vocab"].items():
            self.tokens[i] = token.encode() if token in self.special else bytes(letters[c] for c in token)
        for token, i in self.special.items():
            self.tokens[i] = token.encode()
        special = set(self.special.values())
        self.parts: list[tuple[int, int] | None] = [None] * size
        self.joined: dict[tuple[int, int], int] = {}
        ids = model["vocab"]
        last = -1
        for merge in model["merges"]:
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            whole = ids[left + right]
            if whole <= last:
                raise ValueError("the vocabulary's ids must rise in the order of its merges")
            last = whole
            self.parts[whole] = ids[left], ids[right]
            self.joined[ids[left], ids[right]] = whole
        self.lengths = [len(t) for t in self.tokens]
        self.by_text = {t.decode("latin-1"): i for i, t in enumerate(self.tokens) if i not in special}
        self.longest = ahocorasick.Automaton()
        for token, i in self.by_text.items():
            self.longest.add_word(token, i)
        self.longest.make_automaton()
        self.shorter: dict[int, int] = {}
        self.known_pairs: dict[tuple[int, int], bool] = {}
        offsets = np.zeros(size + 1, np.int64)
        np.cumsum(self.lengths, out=offsets[1:])
        self.offsets, self.bytes = offsets, np.frombuffer(b"".join(self.tokens), np.uint8)

    def compatible(self, left: int, right: int) -> bool:
        """Whether the merges leave ``left`` and ``right`` as neighbours."""
        built_before = len(self.tokens)
        while True:
            if self.joined.get((left, right), built_before) < built_before:
                return False
            if left > right:
                if self.parts[left] is None:
                    return True
                built_before, left = left, self.parts[left][1]
            else:
                if self.parts[right] is None:
                    return True
                # Equal merges run from left to right, so here the bound itself counts.
                built_before, right = right + 1, self.parts[right][0]

    def _fits(self, left: int, right: int) -> bool:
        known = self.known_pairs.get((left, right))
        if known is None:
            if len(self.known_pairs) >= REMEMBERED:
                self.known_pairs.clear()
            known = self.known_pairs[left, right] = self.compatible(left, right)
        return known

    def _prefix(self, token: int) -> int:
        """The longest token that is a proper prefix of ``token``, or -1."""
        found = self.shorter.get(token)
        if found is None:
            text = self.tokens[token].decode("latin-1")
            found = next((self.by_text[text[:n]] for n in range(len(text) - 1, 0, -1) if text[:n] in self.by_text), -1)
            self.shorter[token] = found
        return found

    def encode_word(self, word: bytes) -> list[int]:
        """Token ids of one word."""
        text, lengths = word.decode("latin-1"), self.lengths
        longest = [-1] * len(text)
        for end, token in self.longest.iter(text):  # of one start, a later end is a longer token
            longest[end + 1 - lengths[token]] = token
        dead = bytearray(len(text) + 1)
        taken: list[int] = []
        at, token = 0, longest[0]
        while True:
            end = at + lengths[token]
            if not dead[end] and (not taken or self._fits(taken[-1], token)):
                taken.append(token)
                if end == len(text):
                    return taken
                at, token = end, longest[end]
                continue
            token_before = token
            token = self._prefix(token)
            if token < 0:
                if not taken:
                    raise ValueError(f"no tokens spell {word!r} from {token_before}")
                dead[at] = 1
                token = taken.pop()
                at -= lengths[token]

    def decode(self, ids: np.ndarray) -> bytes:
        starts, lengths = self.offsets[ids], self.offsets[ids + 1] - self.offsets[ids]
        ends = np.cumsum(lengths)
        return self.bytes[np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)].tobytes()


class WordIds(dict):
    """Ids of words as little-endian 32-bit integers, filled on demand by ``encode``; bounded.

    When full, the words become the older generation and a new one begins, to
    which words return as they are met: frequent words are never forgotten.
    """

    def __init__(self, encode, remembered: int = REMEMBERED):
        super().__init__()
        self.encode, self.remembered = encode, remembered
        self.older: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.remembered:
            self.older = dict(self)
            self.clear()
        ids = self.older.get(word)
        if ids is None:
            found = self.encode(word)
            ids = pack(f"<{len(found)}I", *found)
        self[word] = ids
        return ids

    def of_words(self, words: list[str]) -> bytes:
        return b"".join(map(self.__getitem__, words))


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a file, loaded once per Python worker."""
    return Vocabulary(path)


@lru_cache(maxsize=2)
def _word_ids(path: str) -> WordIds:
    known = vocabulary(path)
    return WordIds(lambda word: known.encode_word(word.encode()))


def specials_pattern(special: dict[str, int]):
    return re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None


def encode_text(text: str, word_ids: WordIds, special: dict[str, int]) -> bytes:
    """Ids of a text; strings of special tokens become their ids."""
    if not any(s in text for s in special):
        return word_ids.of_words(words_of(text))
    pieces = specials_pattern(special).split(text)
    return b"".join(
        int(special[p]).to_bytes(4, "little") if i % 2 else word_ids.of_words(words_of(p))
        for i, p in enumerate(pieces)
    )


def encode(text: Column, path: str) -> Column:
    """Token ids of a text column as binary: little-endian unsigned 32-bit integers; null for null.

    ``path`` is a byte-level BPE file that every machine has. Texts of any
    length are encoded whole; memory is that of one Arrow batch and of at most
    ``REMEMBERED`` words.
    """

    @F.arrow_udf("binary")
    def ids(texts: pa.Array) -> pa.Array:
        known, special = _word_ids(path), vocabulary(path).special
        return pa.array([None if t is None else encode_text(t, known, special) for t in map(_python, texts)], pa.binary())

    return ids(text)


def decode(ids: Column, path: str) -> Column:
    """Text of an ids column made by ``encode``; bytes that are no UTF-8 become U+FFFD; null for null.

    An id outside the vocabulary is an error.
    """

    @F.arrow_udf("string")
    def texts(rows: pa.Array) -> pa.Array:
        known = vocabulary(path)
        return pa.array(
            [None if r is None else known.decode(np.frombuffer(r, "<u4").astype(np.int64)).decode("utf-8", "replace") for r in map(_python, rows)],
            pa.string(),
        )

    return texts(ids)


def _python(scalar):
    return scalar.as_py()
