"""Problem 1: kinds and placeholders; held-out accuracy of the models on composed examples."""

import random
import time

import pytest

from postmill.llm import personal, personal_training
from tests.llm import unseen


@pytest.fixture(scope="module")
def judge():
    return personal.Judge(personal.models())


@pytest.mark.parametrize("kind", personal.KINDS)
def test_composed_rows_of_another_seed(judge, kind):
    x, y = personal_training.labelled(kind, 400, seed=77)
    m = judge.models[kind]
    said = [m.probability(r) >= m.threshold for r in x]
    hit = sum(a and b for a, b in zip(said, y))
    assert hit / max(1, sum(said)) > 0.85 and hit / max(1, sum(y)) > 0.93


def test_unseen_items_are_in_no_list():
    words = {*personal.GIVEN_NAMES, *personal_training._GIVEN, *personal_training._FAMILY}
    assert not words & {*unseen.GIVEN, *unseen.FAMILY}


@pytest.mark.parametrize("kind", personal.KINDS)
def test_recall_on_unseen_items(judge, kind):
    """Items and sentences that neither the lists nor the training examples hold, without any header book."""
    found = total = 0
    for k, text, item in unseen.cases():
        if k == kind:
            a = text.find(item)
            b = a + len(item)
            total += 1
            found += any(s == kind and min(b, y) - max(a, x) >= 0.8 * (b - a) for x, y, s in judge.spans(text))
    assert total >= 40 and found / total >= 0.9


def test_models_do_not_depend_on_the_process(judge):
    again = personal_training.fit_models({k: 300 for k in personal.KINDS})
    assert again == personal_training.fit_models({k: 300 for k in personal.KINDS})


CASES = [
    ("Ask Percy Winmere for the key.", {"person_name"}), ("Winmere, Percy wrote:", {"person_name"}), ("I spoke to percy winmere about it.", {"person_name"}),
    ("From: P. Winmere\n", {"person_name"}), ("Grüße\nBjörn\n> Fährkamp wrote", {"person_name"}), ("BjÃ¶rn FÃ¤hrkamp schrieb:", {"person_name"}),
    ("Hi Percy,\n\nThe list is closed.", set()), ("Cheers\nPercy\nNight desk", set()), ("samples at 21 °C. After the start", set()), ("Billing Bot <x", set()),
    ("mail percy.winmere@wolern.test today", {"email"}), ("percy (at) wolern.test", {"email"}), ("percy.w at wolern dot test", {"email"}),
    ("See <nikeist.3771@mx.wutisti.example> for the earlier one.", set()), ("https://vihest.test/list/4977", set()),
    ("Tel +44 20 7946 0030", {"phone"}), ("Tél. 06.39.98.92.98", {"phone"}), ("Ruf kurz an, 069/90009490.", {"phone"}),
    ("Ticket LOT 7730 3131 is closed, not #5245 of 2026-07-20", set()), ("Batch Q-708-9259 and TK-40019, v5.15.2", set()),
    ("ID on the badge request: 959-07-5279", {"id_number"}), ("Für das Formular: 02 574 591 853", {"id_number"}), ("Mi documento es 74301853N.", {"id_number"}),
    ("We moved to Flat 3, 92 Hodam Close, Brem.", {"street_address"}), ("Die Ware geht an Huflindgasse 86.", {"street_address"}), ("31, chemin des Hodam", {"street_address"}),
    ("C/ Tecloult nº 31, 58123 Vokuares", {"street_address"}), ("Rua da Hodam 84", {"street_address"}), ("Il reste 229 unités côté quai, contre 10 prévues", set()),
]


@pytest.fixture(scope="module")
def taught():
    """A judge whose corpus has Percy Winmere and Björn Fährkamp in its headers: what tells a name in lower case from other words."""
    return personal.Judge(personal.models(), frozenset({"percy", "winmere", "björn", "bj~rn", "fährkamp", "f~hrkamp"}))


@pytest.mark.parametrize("text, kinds", CASES)
def test_cases(taught, text, kinds):
    assert {k for _, _, k in taught.spans(text)} == kinds


def test_names_in_lower_case_need_evidence(judge, taught):
    text = "I spoke to percy winmere about it."
    assert judge.spans(text) == [] and [k for _, _, k in taught.spans(text)] == ["person_name"]
    assert [k for _, _, k in judge.spans(text, "percy.winmere")] == ["person_name"]  # the record's own address will do


def test_header_book(spark):
    rows = [("a", None, "Percy Winmere percy.w@x.test", "Zoé Low z@x.test"), ("b", "", "Zoé Hart z@x.test", None), ("c", "", None, None)]
    df = spark.createDataFrame(rows, "message_id string, body string, sender string, recipients string")
    assert personal.header_book(df) == {"percy", "winmere", "zoé", "zo~", "low", "hart"}
    assert personal.header_book(df, share=0.5) == {"zoé", "zo~"}
    assert personal.header_book(df, most=3) == {"zoé", "zo~"}  # the share rises to 6 words / (3 * 3 records)
    assert personal.header_book(df.limit(0)) == frozenset()


def test_redaction_keeps_the_rest(judge):
    text = "Ask Percy Winmere (percy@wolern.test), then go to 92 Hodam Close.\nThanks"
    assert judge.redact(text) == "Ask [PERSON] ([EMAIL]), then go to [ADDRESS].\nThanks"
    assert judge.redact("") == "" and judge.redact(None) is None
    spans = judge.spans(text * 3)
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))


def test_long_text_is_read_whole(judge):
    text = "nothing here. " * 60_000 + "Ask Percy Winmere for it."
    assert [k for _, _, k in judge.spans(text)] == ["person_name"]


SCHEMA = "message_id string, body string, sender string, recipients string, kind string, code int, field string"


def test_table(spark):
    rows = [
        ("a", "Tel +44 20 7946 0030", "Percy Winmere p@x.test", None, "c", 1, "f"), ("a", "Tel +44 20 7946 0030", "Percy Winmere p@x.test", None, "c", 1, "f"),
        ("b", None, None, "", "c", 1, "f"), (None, "mail p@x.test", None, None, "c", 1, "f"),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    got = [tuple(r) for r in personal.found_kinds(df).collect()]
    assert len(got) == len(set(got))
    assert set(got) == {("a", "body", "phone"), ("a", "sender", "person_name"), ("a", "sender", "email"), (None, "body", "email")}
    assert personal.redacted(df).count() == 4
    assert personal.found_kinds(df.limit(0)).count() == 0 and personal.redacted(df.limit(0)).count() == 0


def test_kinds_are_those_of_the_spans(judge, taught):
    """``kinds`` places no more names than it must; the result is that of placing all."""
    r = random.Random(5)
    pieces = [text for _, text, _ in unseen.cases()] + [t for t, _ in CASES] + ["Ask Percy Winmere Street 5, 12 Percy Winmere Lane", "Percy AB 12 34 56 C", "silas percy @ x.test"]
    for _ in range(1500):
        text = r.choice([" ", "\n", ", "]).join(r.sample(pieces, r.randrange(1, 6)))
        for j in (judge, taught):
            assert j.kinds(text) == {k for _, _, k in j.spans(text)}
    assert judge.kinds("") == judge.kinds(None) == set()


def test_words_are_placed_alike_one_by_one_and_together(monkeypatch):
    r = random.Random(9)
    words = [f"w{'abcdefgh'[k % 8]}{'xyz'[k % 3]}{k}" for k in range(60)] + ["o'brien", "zoé"]
    text = "".join(r.choice(words) + r.choice([" ", ", ", ". ", " (", "> ", "-", "@", ":", "'"]) for _ in range(3000))
    together = sorted(personal._lower_places(text, words))
    monkeypatch.setattr(personal, "MANY_WORDS", 10**9)
    assert together == sorted(personal._lower_places(text, words)) and len(together) > 500


def test_long_text_with_many_known_words(judge):
    book = frozenset(f"word{k}x" for k in range(5000))
    text = " ".join(f"word{k % 5000}x and" for k in range(120_000)) + " Ask Percy Winmere for it."
    began = time.perf_counter()
    personal.Judge(personal.models(), book).kinds(text)
    assert time.perf_counter() - began < 60
