import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemill.llm.split import split_oversized, split_spans


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab \n.é。#-中", max_size=400), st.integers(1, 50), st.integers(0, 60))
def test_pieces_cover_the_text(text, size, overlap):
    spans = split_spans(text, size, overlap)
    assert all(0 < b - a <= size for a, b in spans)
    if text:
        assert spans[0][0] == 0 and spans[-1][1] == len(text)
    for (a, b), (c, d) in zip(spans, spans[1:]):
        assert a < c <= b < d and b - c <= min(overlap, size - 1)


def test_boundaries_are_preferred():
    text = "# One\n\nFirst sentence here. Second one.\n\n# Two\n\nThird sentence there. Fourth one."
    pieces = [text[a:b] for a, b in split_spans(text, 45, 0)]
    assert pieces[0].endswith("Second one.\n\n") and pieces[1].startswith("# Two")
    text = "alpha beta gamma delta"
    assert [text[a:b] for a, b in split_spans(text, 12, 6)] == ["alpha beta ", "beta gamma ", "gamma delta"]
    assert split_spans("x" * 25, 10, 2) == [(0, 10), (8, 18), (16, 25)]


def test_higher_boundaries_end_pieces():
    """A short section end stays a piece end although the next section would fill the piece."""
    long = "Alpha beta gamma. Delta epsilon zeta. Eta theta."
    text = f"# A\n\n{long}\n\n# B\n\nShort one.\n\n# C\n\nShort two."
    pieces = [text[a:b] for a, b in split_spans(text, 30, 0)]
    assert pieces == ["# A\n\n", "Alpha beta gamma. ", "Delta epsilon zeta. ", "Eta theta.\n\n", "# B\n\nShort one.\n\n", "# C\n\nShort two."]
    words = "one two three four five six seven eight"
    spans = split_spans(words, 14, 6)
    assert all(a == 0 or words[a - 1] == " " for a, _ in spans) and all(b == len(words) or words[b - 1] == " " for _, b in spans)
    assert all(c < b for (_, b), (c, _) in zip(spans, spans[1:]))


def test_edge_rows(spark):
    rows = [
        (1, None, 10, 2, "c"), (2, "", 10, 2, "c"), (3, "short", 10, 2, "c"), (4, "a" * 30, 10, None, "c"), (5, "b" * 30, None, 2, "c"), (6, "c" * 30, 0, 2, "c"), (7, "word " * 40, 20, 99, "c"),
        (7, "word " * 40, 20, 99, "c"), (8, "long text. " * 30_000, 500, 50, "c"), (None, "d" * 15, 10, -5, "c"),
    ]
    df = spark.createDataFrame(rows, "k long, t string, size int, overlap int, start string")
    out = split_oversized(df, ["k"], "t", "size", "overlap")
    got = {}
    for r in out.collect():
        got.setdefault(r.k, []).append(r)
    assert set(got) == {None, 3, 4, 5, 6, 7, 8}
    assert [len(got[k]) for k in (3, 4, 5, 6)] == [1, 3, 1, 1]
    assert len(got[7]) == 2 * (max(r.chunk_index for r in got[7]) + 1)
    assert all(r.end_offset - r.start_offset == len(r.chunk_text) for rs in got.values() for r in rs)
    long = sorted(got[8], key=lambda r: r.chunk_index)
    assert all(b.start_offset <= a.end_offset for a, b in zip(long, long[1:]))
    assert all(len(r.chunk_text) <= 500 for r in long) and long[-1].end_offset == len("long text. " * 30_000)
    assert len(got[None]) == 2
    assert split_oversized(df.limit(0), ["k"], "t", 10, 2).count() == 0
    with pytest.raises(ValueError):
        split_oversized(df.withColumnRenamed("k", "chunk_index"), ["chunk_index"], "t", 10, 2)
