from hypothesis import given, strategies as st

from postmill.plans.query_language import Clause, parse, tokens


@given(st.text())
def test_total(raw):
    q = parse(raw)
    assert q.raw == raw and all(c.kind for c in q.clauses)


def test_tokens():
    assert tokens('a "b c" d') == [("a", False), ("b c", True), ("d", False)]
    assert tokens('from:"a b"') == [("from:", False), ("a b", True)]
    assert tokens('"" "open end') == [("", True), ("open end", True)]


def kinds(raw):
    return [(c.kind, c.value, c.negated) for c in parse(raw).clauses]


def test_clauses():
    assert kinds("FROM:Ann cc:bob in:Work list:dev") == [("from", "Ann", False), ("to", "bob", False), ("mailbox", "Work", False), ("list", "dev", False)]
    assert kinds("is:unread -is:unread is:starred is:odd") == [("keyword", "$seen", True), ("keyword", "$seen", False), ("keyword", "$flagged", False), ("text", "is:odd", False)]
    assert kinds("has:attachments has:x from: :x a:b") == [("attachment", "", False), ("text", "has:x", False), ("text", "from:", False), ("text", ":x", False), ("text", "a:b", False)]
    assert kinds("after:2026-03 until:2026 before:2026-02-30")[0] == ("after", "2026-03-01T00:00:00+00:00", False)
    assert kinds("before:2026-02-30") == [("text", "before:2026-02-30", False)]
    assert kinds('-word - -"x y"') == [("text", "word", True), ("text", "-", False), ("text", "-", False), ("phrase", "x y", False)]
    assert parse("a from:b").text == [Clause("text", "a")] and len(parse("a from:b").filters) == 1
