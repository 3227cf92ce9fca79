"""A repeated sender is judged with the addresses of its own record."""

from postmill.llm import personal


def test_same_sender_with_other_recipients(spark, monkeypatch):
    class ByRecord:
        def __init__(self, *_):
            pass

        def kinds(self, text, record="", mails=None):
            return {"person_name"} if text and "weller" in record else set()

    monkeypatch.setattr(personal, "Judge", ByRecord)
    monkeypatch.setattr(personal, "models", dict)
    monkeypatch.setattr(personal, "spread", lambda df: df.coalesce(1))
    rows = [("a", "", "K. Weller", "x@y.test"), ("b", "", "K. Weller", "k.weller@y.test")]
    found = personal.found_kinds(spark.createDataFrame(rows, "message_id string, body string, sender string, recipients string")).collect()
    assert sorted((r.message_id, r.field) for r in found) == [("b", "recipients"), ("b", "sender")]
