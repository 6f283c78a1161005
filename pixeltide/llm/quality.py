"""Document quality by a linear-chain conditional random field over lines.

Every line of a text is labelled good or bad. Its evidence is what the line and
its two neighbours look like (kinds of characters, words, repetition); a chain
of pairwise weights ties the labels of following lines. Forward-backward gives
each line's probability of being good, and the mean over lines, weighted by
their length, is the document's quality.

Documents are labelled as wholes, so for training every line carries its
document's label. Training runs on the driver over a bounded sample, by
gradient ascent on the exact likelihood; scoring is distributed. Chains of many
documents are worked off together, one step for each line number.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixeltide.llm.workers import bytes_of, slices, word_hashes

#: Bytes of a character class; fixed values.
CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "stop": b".,;:",
    "shout": b"!?",
    "pipe": b"|",
    "mark": b"#$%&*@^~<>{}[]\\_=+",
    "quote": b"\"'()/-",
    "blank": b" \t\r\x0b\x0c",
}
#: What a line is described by; its neighbours' values follow, then a constant.
FEATURES = (*CLASSES, "size", "word_size", "words", "known_words", "known_line", "stopped", "no_line")


class Field(NamedTuple):
    """Weights of a trained field: of a line's features, and of following labels [before, after]."""

    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    pairs: tuple[float, ...]


def lines_of(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last+1 byte of every line, and the bounds of each row's lines; an empty text is one empty line."""
    breaks = np.flatnonzero(raw == 10)
    owner = np.searchsorted(bounds, breaks, "right") - 1
    owners = np.concatenate([np.arange(len(bounds) - 1), owner])
    starts = np.concatenate([bounds[:-1], breaks + 1])
    order = np.lexsort((starts, owners))
    starts, owners = starts[order], owners[order]
    ends = bounds[owners + 1].copy()
    same = owners[1:] == owners[:-1]
    ends[:-1][same] = starts[1:][same] - 1
    return starts, ends, np.searchsorted(owners, np.arange(len(bounds)))


def _repeated(keys: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """Whether an equal key of the same group came before."""
    order = np.lexsort((keys, groups))
    again = np.zeros(len(keys), bool)
    again[order[1:]] = (keys[order[1:]] == keys[order[:-1]]) & (groups[order[1:]] == groups[order[:-1]])
    return again


def line_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features [line, 3 * FEATURES + 1], sizes of lines in bytes, and the bounds of each text's lines."""
    raw, bounds = bytes_of(texts)
    starts, ends, of_row = lines_of(raw, bounds)
    size = ends - starts
    share = np.maximum(size, 1)
    own = np.zeros((len(starts), len(FEATURES)))
    for k, letters in enumerate(CLASSES.values()):
        table = np.zeros(256, np.int32)
        table[list(letters)] = 1
        total = np.zeros(len(raw) + 1, np.int64)
        np.cumsum(table[raw], out=total[1:])
        own[:, k] = (total[ends] - total[starts]) / share
    hashes, first, _ = word_hashes(raw, bounds)
    line = np.searchsorted(starts, first, "right") - 1
    row = np.searchsorted(of_row, np.arange(len(starts)), "right") - 1
    words = np.bincount(line, minlength=len(starts))
    some = np.maximum(words, 1)
    k = len(CLASSES)
    own[:, k] = np.log1p(size)
    own[:, k + 1] = np.log1p(size / some)
    own[:, k + 2] = np.log1p(words)
    own[:, k + 3] = np.bincount(line, _repeated(hashes, row[line]), len(starts)) / some
    mixture = np.zeros(len(starts), np.uint64)
    np.add.at(mixture, line, hashes * (np.arange(len(hashes)) - np.searchsorted(line, line) + 1).astype(np.uint64))
    own[:, k + 4] = _repeated(mixture, row) & (words > 0)
    last = raw[np.maximum(ends - 1, 0)] if len(raw) else np.zeros(len(ends), np.uint8)
    own[:, k + 5] = (size > 0) & (last == ord("."))
    outside = np.zeros(len(FEATURES))
    outside[-1] = 1
    begins, finishes = of_row[:-1], of_row[1:] - 1
    before, after = np.roll(own, 1, 0), np.roll(own, -1, 0)
    before[begins], after[finishes] = outside, outside
    return np.concatenate([own, before, after, np.ones((len(own), 1))], 1), size, of_row


def _chains(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First line and number of lines of each chain, longest first, and how many chains have a line of each number."""
    sizes = np.diff(bounds)
    order = np.argsort(-sizes, kind="stable")
    first, sizes = bounds[:-1][order], sizes[order]
    longest = int(sizes[0]) if len(sizes) else 0
    return first, sizes, len(sizes) - np.searchsorted(sizes[::-1], np.arange(1, longest + 1))


def marginals(lean: np.ndarray, pairs: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of every line, and the expected number of each pair of labels [before, after].

    ``lean`` is each line's weight for good over bad. Probabilities are
    normalised at every step, so chains of any length are safe.
    """
    first, sizes, active = _chains(bounds)
    push = np.stack([np.exp(-np.maximum(lean, 0)), np.exp(np.minimum(lean, 0))], 1)  # bad, good; the greater is 1
    move = np.exp(pairs - pairs.max())
    ahead = np.ones((len(lean), 2))
    for t, n in enumerate(active.tolist()):
        at = first[:n] + t
        now = push[at] if t == 0 else push[at] * (ahead[at - 1] @ move)
        ahead[at] = now / now.sum(1, keepdims=True)
    good, expected = np.zeros(len(lean)), np.zeros((2, 2))
    back = np.ones((len(first), 2))
    for t in range(len(active) - 1, -1, -1):
        n = int(active[t])
        at = first[:n] + t
        both = ahead[at] * back[:n]
        both /= both.sum(1, keepdims=True)
        good[at] = both[:, 1]
        if t:
            onward = push[at] * back[:n]
            joint = ahead[at - 1][:, :, None] * move * onward[:, None, :]
            expected += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
            back[:n] = onward @ move.T
            back[:n] /= back[:n].sum(1, keepdims=True)
    return good, expected


def train(features: np.ndarray, bounds: np.ndarray, labels: np.ndarray, rounds: int = 120, rate: float = 0.1) -> Field:
    """Weights that make the labels of all lines likely, by gradient ascent with adaptive steps."""
    mean, scale = features.mean(0), features.std(0)
    mean[scale < 1e-9], scale[scale < 1e-9] = 0.0, 1.0
    x = (features - mean) / scale
    y = np.repeat(labels.astype(float), np.diff(bounds))
    wide = np.repeat(1.0 / np.diff(bounds), np.diff(bounds))  # every document counts alike
    same = (np.diff(bounds) - 1).astype(float)
    seen = np.array([[same[labels == 0].sum(), 0.0], [0.0, same[labels == 1].sum()]])
    theta = np.zeros(x.shape[1] + 4)
    one, two = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, rounds + 1):
        pairs = theta[-4:].reshape(2, 2)
        good, expected = marginals(x @ theta[:-4], pairs, bounds)
        slope = np.concatenate([((y - good) * wide) @ x / len(labels), ((seen - expected) / max(1.0, seen.sum())).ravel()])
        slope -= 1e-3 * theta
        one, two = 0.9 * one + 0.1 * slope, 0.99 * two + 0.01 * slope**2
        theta += rate * (one / (1 - 0.9**k)) / (np.sqrt(two / (1 - 0.99**k)) + 1e-8)
    return Field(tuple(mean), tuple(scale), tuple(theta[:-4]), tuple(theta[-4:]))


def document_scores(texts: pa.Array, field: Field) -> np.ndarray:
    """Length-weighted mean of the lines' probabilities of being good."""
    out = np.zeros(len(texts))
    mean, scale, weights = np.array(field.mean), np.array(field.scale), np.array(field.weights)
    pairs = np.array(field.pairs).reshape(2, 2)
    for start, part in slices(texts):
        features, size, bounds = line_features(part)
        good, _ = marginals((features - mean) / scale @ weights, pairs, bounds)
        weight = np.maximum(size, 1).astype(float)
        out[start : start + len(part)] = np.add.reduceat(good * weight, bounds[:-1]) / np.add.reduceat(weight, bounds[:-1])
    return np.clip(out, 0.0, 1.0)


def learn(
    docs: DataFrame, labels: DataFrame, documents: int = 2000, lines: int = 500,
    id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
) -> Field:
    """Train on the documents that ``labels`` marks 0 or 1.

    The sample is bounded: the ``documents`` labels with the least hash of
    their id, less those whose text is null or has more than ``lines`` lines. It
    is taken from the labels before the texts are read, and being bounded it is
    broadcast. Without any label the field scores every text 0.5.
    """
    marked = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    chosen = marked.where("id is not null and label in (0, 1)").orderBy(F.xxhash64("id"), "id", "label").limit(documents)
    text = F.col(text_col)
    breaks = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    sample = docs.select(F.col(id_col).alias("id"), text.alias("text")).where(text.isNotNull() & (breaks < lines))
    sample = sample.join(F.broadcast(chosen), "id").orderBy("id", "text", "label").limit(2 * documents)

    @F.arrow_udf("binary")
    def features(texts: pa.Array) -> pa.Array:
        out = []
        for _, part in slices(texts):
            found, _, bounds = line_features(part)
            out += [found[a:b].astype(np.float32).tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
        return pa.array(out, pa.binary())

    got = sample.select("label", features("text").alias("features")).collect()
    width = 3 * len(FEATURES) + 1
    if not got:
        zeros = (0.0,) * width
        return Field(zeros, (1.0,) * width, zeros, (0.0,) * 4)
    parts = [np.frombuffer(r["features"], np.float32).reshape(-1, width) for r in got]
    bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    return train(np.concatenate(parts).astype(float), bounds, np.array([r["label"] for r in got]))


def score(text: Column, field: Field) -> Column:
    """Quality 0 to 1 of a text column; a null text is an empty one."""

    @F.arrow_udf("double")
    def quality(texts: pa.Array) -> pa.Array:
        return pa.array(document_scores(texts, field))

    return quality(F.coalesce(text, F.lit("")))
