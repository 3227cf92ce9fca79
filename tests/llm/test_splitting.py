"""Problem 9: an exact round trip, and the limits on every piece."""

from hypothesis import given, settings, strategies as st

from postmill.llm import splitting
from postmill.llm.tokens import TOKEN, count_tokens

PIECES = st.lists(st.sampled_from(["word", "Ä1", ".", ",", " ", "  ", "\n", "\n\n", "_", "…", "! ", "x"]), max_size=400).map("".join)


@settings(max_examples=150, deadline=None)
@given(PIECES, st.integers(4, 30), st.integers(0, 3))
def test_round_trip(text, limit, overlap):
    pieces = splitting.split_text(text, limit, overlap)
    assert "".join(text[a:b] for _, _, a, b, _ in pieces) == text
    if count_tokens(text) <= limit:
        assert len(pieces) == 1
        return
    spans = [m.span() for m in TOKEN.finditer(text)]
    done = 0
    for k, (tokens, lead, a, b, piece) in enumerate(pieces):
        assert tokens == count_tokens(piece) <= limit
        assert lead == (min(overlap, done) if k else 0)
        if k:
            assert piece.startswith(text[spans[done - lead][0] : a]) if lead else True
        done += tokens - lead
    assert done == len(spans)


def test_natural_boundaries():
    text = "\n\n".join(" ".join(f"w{i}" for i in range(30)) + "." for _ in range(40))
    for _, _, a, _, _ in splitting.split_text(text)[1:]:
        assert text[a - 2 : a] == "\n\n"
    blob = "x," * 2000  # no white space at all
    assert len(splitting.split_text(blob)) > 7


def test_table(spark):
    big = "word " * 3000
    rows = [(1, big, "c", 1), (1, big, "c", 1), (2, None, "c", 1), (3, "", "c", 1), (4, "word " * 512, "c", 1), (5, "word " * 513, "c", 1), (None, big, "c", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, piece_text string, piece int")
    got = splitting.split_documents(df).collect()
    assert {(r.doc_id, r.pieces) for r in got if r.doc_id in (2, 3, 4)} == {(2, 1), (3, 1), (4, 1)}
    assert all(r.tokens <= 512 and r.overlap == (64 if r.piece > 1 else 0) for r in got)
    assert {r.doc_id for r in splitting.split_documents(df, whole=False).collect()} == {1, 5, None}
    assert splitting.split_documents(df.limit(0)).count() == 0
