import random

from hypothesis import given, settings
from hypothesis import strategies as st

from tallyframe.llm.split import oversized_pages, split_pages, split_spans


def check(text, limit, overlap):
    spans = split_spans(text, limit, overlap)
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    for a, b in spans:
        assert 0 < b - a <= limit or text == ""
    for (a, b), (c, d) in zip(spans, spans[1:]):
        assert a < c <= b < d and b - c <= overlap
    return spans


@settings(max_examples=150, deadline=None)
@given(st.text("ab .,\n!é漢", max_size=400), st.integers(10, 60), st.integers(0, 9))
def test_pieces_cover_and_fit(text, limit, overlap):
    check(text, limit, overlap)


def test_cuts_at_strong_boundaries():
    text = "\n\n".join("Sentence one here. Sentence two is here. " * 12 for _ in range(8))
    for _, end in check(text, 1000, 100)[:-1]:
        assert text[:end].endswith("\n\n")
    assert [b - a for a, b in check("x" * 5000, 2000, 200)] == [2000, 2000, 1400] or len(check("x" * 5000, 2000, 200)) == 3


def test_weakest_boundaries_merge_first():
    """Against a plain statement of the rule: merge the weakest, shortest, leftmost boundary that fits, until none does."""
    from tallyframe.llm.split import _atoms

    rng = random.Random(4)
    for _ in range(60):
        text = "".join(rng.choice(["aa bb", ". ", "\n", "\n\n", "ccc, "]) for _ in range(40))
        if len(text) <= 60:
            continue
        ends, marks = _atoms(text, 0, len(text), 50)
        segs = [[a, b, m] for a, b, m in zip([0, *ends[:-1]], ends, marks)]
        while True:
            options = [(segs[i][2], segs[i + 1][1] - segs[i][0], i) for i in range(len(segs) - 1) if segs[i + 1][1] - segs[i][0] <= (60 if segs[i][0] == 0 else 50)]
            if not options:
                break
            i = min(options)[2]
            segs[i : i + 2] = [[segs[i][0], segs[i + 1][1], segs[i + 1][2]]]
        assert [s[1] for s in segs] == [b for _, b in split_spans(text, 60, 10)]


def test_tables(spark):
    rows = [(1, "a", 1, "x" * 2000), (2, "a", 1, "word " * 1000), (3, None, None, None), (4, "b", 2, ""), (2, "a", 1, "word " * 1000), (5, "c", 1, "é" * 2001)]
    df = spark.createDataFrame([(*r, "e", 7) for r in rows], "page_id bigint, source_file string, number int, text string, piece string, start int")
    assert sorted(r.page_id for r in oversized_pages(df).collect()) == [2, 5]
    text = dict((r[0], r[3]) for r in rows)
    for r in split_pages(df).collect():
        assert r.piece == text[r.page_id][r.start : r.end] and len(r.piece) <= 2000
    assert split_pages(df.limit(0)).count() == 0
