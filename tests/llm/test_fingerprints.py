import random

import pytest
from pyspark.sql import functions as F

from pixeltide.llm import fingerprints as fp


def text_of(rng, paragraphs):
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 8)))
    return "\n".join(" ".join(word() for _ in range(rng.randint(0, 40))) + "." for _ in range(paragraphs))


def test_pieces_cover_the_text():
    rng = random.Random(1)
    for text in (text_of(rng, 30), "", "\n\n", " a  b\t", "x" * 10_000, "no stop " * 99, "a.\nb!\n\nc? d"):
        paragraphs = fp._PARAGRAPH.findall(text)
        assert "".join(paragraphs) == text
        for p in paragraphs:
            assert "".join(fp._SENTENCE.findall(p)) == p


def test_every_byte_counts():
    text = "One two three four five.\nSix seven.\n\nEight"
    prints = {fp.fingerprint_of(text[:k] + "~" + text[k + 1 :]) for k in range(len(text))}
    assert len(prints) == len(text) and fp.fingerprint_of(text) not in prints
    assert fp.fingerprint_of(text) == fp.fingerprint_of("".join(list(text)))


def test_likeness_is_that_of_all_leaves():
    """Whole branches that agree are counted unseen; the result is the plain count over leaves."""
    rng = random.Random(2)
    for _ in range(40):
        one = text_of(rng, rng.randint(0, 40))
        cut = rng.randint(0, len(one))
        two = one[:cut] + text_of(rng, rng.randint(0, 3)) + one[rng.randint(cut, len(one)) :]
        a, b = fp.fingerprint_of(one), fp.fingerprint_of(two)
        leaves = [fp.Counter(x for s in fp._sections(f) for p in fp._paragraphs(s) for x in fp._leaves(p)) for f in (a, b)]
        size = leaves[0].total() + leaves[1].total()
        plain = 2 * (leaves[0] & leaves[1]).total() / size if size else 0.0
        # Equal leaves in different branches pair up late, so a branch match may leave a few unpaired.
        assert fp.likeness_of(a, b) == pytest.approx(1.0 if one == two else plain, abs=0.1)
        assert fp.likeness_of(a, b) == fp.likeness_of(b, a)
        assert (fp.likeness_of(a, b) == 1.0) == (one == two)


def test_edits_are_located():
    rng = random.Random(3)
    text = text_of(rng, 60)
    lines = text.split("\n")
    lines[30] = "entirely new words here."
    places = fp.edits_between(fp.fingerprint_of(text), fp.fingerprint_of("\n".join(lines)))
    assert places and len({p.rsplit(".", 1)[0] for p in places}) == 1
    assert fp.edits_between(fp.fingerprint_of(text), fp.fingerprint_of(text)) == []


def test_columns_with_nulls_and_empty_texts(spark, docs):
    df = docs([(1, None), (2, ""), (3, "a b"), (4, "a b")]).select("doc_id", fp.fingerprint(F.col("text")).alias("f"))
    prints = {r.doc_id: r.f for r in df.collect()}
    assert prints[1] == prints[2] != prints[3] == prints[4]
    both = df.select(fp.likeness(F.col("f"), F.lit(prints[3])).alias("l"), fp.edits(F.col("f"), F.lit(None)).alias("e"))
    assert sorted(r.l for r in both.collect()) == [0.0, 0.0, 1.0, 1.0]
    assert {r.e for r in both.collect()} == {None}


@pytest.mark.parametrize("rows", [3, 2000])
def test_the_next_document_goes_round(spark, docs, rows):
    made = [(i * i, f"text {i}") for i in range(40)] + [(None, "no id"), (16, "text 4b"), (16, "text 4b"), (9, None)]
    got = [(r.doc_id, r.text, r.next_text) for r in fp.with_next(docs(made), rows=rows).collect()]
    order = sorted(((i, t or "") for i, t in made), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    wanted = [(*r, order[(k + 1) % len(order)][1]) for k, r in enumerate(order)]
    assert sorted(got, key=repr) == sorted(wanted, key=repr)


def test_next_of_one_row_and_of_none(spark, docs):
    assert [tuple(r) for r in fp.with_next(docs([(5, "x")])).collect()] == [(5, "x", "x")]
    assert fp.with_next(docs([])).collect() == []


def test_lines_without_spaces_are_cut_by_content():
    rng = random.Random(9)
    line = lambda n: "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(n))
    for make in (line, lambda n: "".join(rng.choice("acgt") for _ in range(n))):
        text = make(4000)
        whole = fp.fingerprint_of(text)
        assert fp.likeness_of(whole, fp.fingerprint_of(text[:2000] + make(2000))) > 0.3
        assert fp.likeness_of(whole, fp.fingerprint_of(text[:1500] + make(3) + text[1500:])) > 0.9
        assert fp.likeness_of(whole, fp.fingerprint_of(make(4000))) < 0.1
        assert "".join(fp._pieces(text)) == text
    same = "a" * 200_000
    assert "".join(fp._pieces(same)) == same
    assert len(fp._pieces(same)) <= len(same) / fp.APART + 1
