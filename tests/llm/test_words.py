"""Words cut in arrays against the pattern, and ids against the library."""

import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pixeltide.llm.bpe import LATIN_WORDS
from pixeltide.llm.packing import _word_ids
from pixeltide.llm.words import encode_texts, merges, word_starts

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "s", "t", "re", "ve", "ll", "d", "m", "'", "''", "'s", "'re", "'l", " ", "  ", "\n", "\t", "\r\n", "\xa0", "\x85", "1", "23", "²", ".", "!?", "é", "ß", "-", "S", "'T", "r", "v"]


def cut(texts):
    raw = [t.encode("latin-1") for t in texts]
    bounds = np.cumsum([0, *map(len, raw)])
    whole = b"".join(raw)
    starts = word_starts(np.frombuffer(whole, np.uint8), bounds)
    return [whole[a:b].decode("latin-1") for a, b in zip(starts, [*starts[1:], len(whole)])]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), min_size=1, max_size=12).map("".join), min_size=1, max_size=4))
def test_words_are_those_of_the_pattern(texts):
    assert cut(texts) == [w for t in texts for w in LATIN_WORDS.findall(t)]


def test_all_bytes_cut_like_the_pattern():
    rng = random.Random(3)
    texts = ["".join(chr(rng.randrange(256)) for _ in range(300)) for _ in range(60)]
    assert cut(texts) == [w for t in texts for w in LATIN_WORDS.findall(t)]


@pytest.mark.parametrize("seed", range(3))
def test_ids_of_a_batch_are_the_library_s(seed):
    rng = random.Random(seed)
    known, special = _word_ids(PATH)
    texts = ["", "日本語 and 'll", *special, f"x{next(iter(special))} y's", "it's we'll they'RE", "  \n end  ", " " * 5000, "z" * 3000]
    texts += ["".join(rng.choice(PARTS + list(special) + ["漢", " word", " the", "tion", "ment", " éa", "z" * 47, "ÿ" * 30]) for _ in range(rng.randrange(80))) for _ in range(50)]
    library = Tokenizer.from_file(PATH)
    library.no_truncation()
    library.no_padding()
    wanted = [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert encode_texts(texts, merges(PATH), known, special) == wanted
    assert encode_texts([], merges(PATH), known, special) == []
