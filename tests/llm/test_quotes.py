"""Problem 6: lines the sender did not write."""

import pytest

from postmill.llm import quotes

CASES = [
    ("Hi Ben,\n\nNew text.\n\nBest regards,\nAnn\n\nOn 14.03.26, Ben Low wrote:\n> old\n> \n> older", "Ann Lee", [5, 6, 8, 9, 10, 11]),
    ("Ben Low <b@x.test>\nschrieb:\n>Hallo\n>\n>alt\n\nLiebe Kollegen,\n\nneu.", "Ann", [1, 2, 3, 4, 5]),
    ("Neu.\n\nVon unterwegs gesendet\n\nHallo Ann,\n\nalt.", "Ann", [3, 5, 7]),
    ("New.\n\nHello Loïc,\n\nOld without any mark.", "Ann", [3, 5]),
    ("New.\n\n-----Original Message-----\nFrom: Ben\nSent: 2026-08-20, 05:23\n\nold", "Ann", [3, 4, 5, 7]),
    ("Neuf.\n\nDe : Ben\nEnvoyé : 2025-05-13\n\nvieux", "Ann", [3, 4, 6]),
    ("> q1\n\nanswer one\n\n> q2\n\nanswer two", "Ann", [1, 5]),
    ("| q\n\tq\n    q\nTH> q\nnew", "Ann", [1, 2, 3, 4]),
    ("Best regards from the yard are welcome, but no.\n-- draft, not final --\nStill new.", "Ann", []),
    ("New.\n***\nDiese Nachricht ist nur für den genannten Empfänger bestimmt.", "Ann", [2, 3]),
    ("New.\n\nPlease think before you print this mail.\n\nHi all,\n\nold.", "Ann", [3, 5, 7]),
    ("New text ends.\nAnn Lee\nField services, Tal\n+44 20 7946 0030", "Ann Lee a@x", [2, 3, 4]),
    ("Können wir.\n\nViele GrÃ¼ÃŸe\nNeil", "Neil", [3, 4]),
    ("CONFIDENTIAL: passing on or copying this mail is not allowed.\n\nNew below.", "Ann", [1]),
    ("new\r\n>old\r\n", "Ann", [2]),
    ("Thanks!\n\nThe report is attached and we meet on Friday.", "Ann", []),
    ("Thank you\n\nI read it all and agree with the plan.\n\nBest,\nAnn", "Ann", [5, 6]),
    ("The plan holds.\n\nThe vendor accepts no liability for parts.\n\nWe should ask again next week.", "Ann", []),
    ("New.\n\nBest,\nAnn\n\n> old one\n> old two\n\nYes, that works for me as well.", "Ann", [3, 4, 6, 7]),
    ("Run this:\n\n    pip install foo\n    x = bar(1)\n\nThen call me.", "Ann", []),
    ("Ben wrote:\n\n    pip install foo\n\nThen call me.", "Ann", [1, 3]),
    ("We know x>y is true.\nx>y is true.\nSo be it.", "Ann", []),
    ("    We set the first line in,\nthe rest of it not, as in a letter of old.", "Ann", []),
    ("All fine.\nThanks", "Ann", [2]), ("New.\n\nThanks,\nAnn Lee\n\n-- \nAnn Lee\nSales", "Ann Lee", [3, 4, 6, 7, 8]),
    ("", None, []), (None, None, []), ("\n \n", "x", []), (">", None, [1]),
]


@pytest.mark.parametrize("body, sender, want", CASES)
def test_lines(body, sender, want):
    assert quotes.foreign_lines(body, sender) == want


def test_table(spark):
    schema = "message_id string, body string, sender string, line_no bigint, lines string"
    rows = [("a", "New.\n> old", "A", 1, "x"), ("a", "New.\n> old", "A", 1, "x"), ("b", None, None, 1, "x"), ("c", "", None, 1, "x"), ("d", "x\n" * 50_000 + "> q", None, 1, "x")]
    df = spark.createDataFrame(rows, schema)
    got = sorted(tuple(r) for r in quotes.foreign_line_numbers(df).collect())
    assert got == [("a", 2), ("d", 50_001)]
    texts = [(r.message_id, r.new_text) for r in quotes.newly_written(df).collect()]
    assert ("a", "New.") in texts and ("b", None) in texts and len(texts) == 5
    assert quotes.foreign_line_numbers(df.limit(0)).count() == 0
