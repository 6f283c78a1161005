import bisect
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pixeltide.llm.packing import cuts, pack, plan_sequences

PATH = public_tokenizers.path("byte_bpe_50k.json")


def best_fit(lengths, width):
    """Number of sequences of best-fit decreasing, one piece after the other."""
    rooms, used = [], 0
    for length in sorted(lengths, reverse=True):
        i = bisect.bisect_left(rooms, length)
        room = rooms.pop(i) if i < len(rooms) else width
        used += i == len(rooms) and room == width
        bisect.insort(rooms, room - length)
    return used


def check(placed, width):
    """Sequences are gapless from 0 and no wider than allowed; returns their number."""
    by = {}
    for sequence, offset, length in placed:
        by.setdefault(sequence, []).append((offset, length))
    for parts in by.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= width
    return len(by)


@pytest.mark.parametrize("seed", range(20))
def test_the_plan_is_best_fit_over_single_pieces(seed):
    rng = random.Random(seed)
    width = rng.choice([10, 64, 2048])
    histogram = {rng.randint(1, width): rng.randint(1, rng.choice([3, 200])) for _ in range(rng.randint(0, 150))}
    placed, ranks = [], {}
    for s in plan_sequences(histogram, width):
        for k in range(s.pieces):
            placed.append((s.sequence + k // s.each, s.offset + k % s.each * s.length, s.length))
            ranks.setdefault(s.length, []).append(s.rank + k)
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in histogram.items()}
    lengths = [k for k, n in histogram.items() for _ in range(n)]
    rooms = check(placed, width)
    assert rooms <= max(1, best_fit(lengths, width)) or not lengths


def test_the_plan_stays_small_for_billions():
    slots = plan_sequences({n: 10**9 + n for n in range(1, 2049)}, 2048)
    assert len(slots) < 3 * 2048 * 11
    assert sum(s.pieces for s in slots) == sum(10**9 + n for n in range(1, 2049))
    with pytest.raises(ValueError):
        plan_sequences({2049: 1}, 2048)


def test_cuts():
    assert cuts(5, 8) == [(0, 5)] and cuts(8, 8) == [(0, 8)]
    assert cuts(9, 8) == [(0, 1), (1, 8)] and cuts(16, 8) == [(0, 8), (8, 8)]


def test_packs_whole_texts(spark, docs):
    rng = random.Random(1)
    words = ["the", "of", "Ñandú", "x1", "!", "<|endoftext|>", "\n"]
    texts = ["", None, "a", "a"] + [" ".join(rng.choice(words) for _ in range(rng.randint(1, 200))) for _ in range(80)]
    texts.append("word " * 700)
    rows = [*enumerate(texts), (3, "a"), (None, "no id")]
    got = pack(docs(rows), PATH, width=64).collect()
    assert check([(r.sequence_id, r.offset, r.length) for r in got], 64) == len({r.sequence_id for r in got})
    tokenizer = Tokenizer.from_file(PATH)
    wanted = []
    for i, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for k, (start, length) in enumerate(cuts(len(ids), 64)):
            wanted.append((i, k, start, length, zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())))
    columns = ("doc_id", "piece", "start", "length", "ids_crc32")
    assert sorted((tuple(r[c] for c in columns) for r in got), key=repr) == sorted(wanted, key=repr)
    assert len({r.sequence_id for r in got}) <= best_fit([r.length for r in got], 64)


def test_empty_table_and_extra_columns(spark, docs):
    assert pack(docs([]), PATH).collect() == []
    from pyspark.sql import functions as F

    clashing = docs([(1, "a")]).withColumns({"length": F.lit("x"), "piece": F.lit(9), "sequence_id": F.lit(7)})
    assert [(r.piece, r.length, r.sequence_id, r.offset) for r in pack(clashing, PATH).collect()] == [(0, 2, 0, 0)]
