"""Problem 5: every chain is found and undone, clean text is left alone."""

import pytest

from postmill.llm import garbled

CLEAN = ["Für die Prüfung müssen wir früh öffnen", "L’équipe a déplacé le modèle d’étiquette à côté", "La versión extraña está en el almacén", "It’s the “late” list — €25", "ATENÇÃO: a versão rápida NÃO está"]
SCHEMA = "record string, field string, text string, word string, docs bigint"


def garble_text(text, chain):
    return garbled._WORD.sub(lambda m: garbled.garble(m.group(), chain) or m.group(), text)


CHAINS = [c for c in garbled.CHAINS if c in ((("utf-8", r),) for r in garbled.READERS)] + [
    (("utf-8", "cp1252"), ("utf-8", "cp1252")), (("cp1252", "cp437"),), (("cp1252", "mac_roman"),), (("mac_roman", "cp1252"),),
]


def test_tables(spark):
    rows = [(f"c{i}-{k}", "body", t, "w", 1) for i, t in enumerate(CLEAN) for k in range(4)]
    want = {}
    for n, chain in enumerate(CHAINS):
        for i, t in enumerate(CLEAN):
            bad = garble_text(t, chain)
            if bad != t:
                rows.append((f"g{n}-{i}", "body", bad, "w", 1))
                want[f"g{n}-{i}"] = t
    rows += [("n", "body", None, "w", 1), ("e", "subject", "", "w", 1), ("a", "subject", "plain", "w", 1), ("lost", "subject", "Pr�fung", "w", 1), ("lost", "subject", "Pr�fung", "w", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    found = [(r.record, r.field) for r in garbled.garbled_records(df).collect()]
    assert len(found) == len(set(found))
    names = {r for r, _ in found}
    assert not {n for n in names if n.startswith("c")} and "lost" in names
    missed = set(want) - names
    assert len(missed) <= 0.05 * len(want), missed
    done = {r.record: r for r in garbled.restored_text(df).collect()}
    right = [k for k in want if k in done and done[k].restored == want[k]]
    assert len(right) >= 0.9 * len(want)
    assert done["lost"].restored == "Prüfung" and done["lost"].complete


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert garbled.garbled_records(df).count() == 0 and garbled.restored_text(df).count() == 0


@pytest.mark.parametrize("word", ["für", "d’étiquette", "NÃO", "€25", "☎"])
def test_way_back(word):
    for chain in CHAINS:
        bad = garbled.garble(word, chain)
        if bad and garbled.LOST not in bad and bad != word:
            assert garbled.ungarble(bad, chain) == word


def test_other_scripts_are_left_alone(spark):
    """Clean text in another script is no garbled text, whatever single letters the corpus holds elsewhere."""
    clean = ["Он и она к нам у дома", "Ελλάδα και φως", "může škola žít v Łodzi", "日本 の 本", "Şehir içinde güzel"]
    rows = [(f"c{k}", "body", clean[k % len(clean)]) for k in range(20)] + [(f"w{k}", "body", "è ê ó à é ú í il è là") for k in range(60)]
    rows += [("g1", "body", garble_text("für die Prüfung", (("utf-8", "cp1251"),))), ("k", "body", "für die Prüfung")]
    df = spark.createDataFrame(rows, "record string, field string, text string")
    assert {r.record for r in garbled.garbled_records(df).collect()} == {"g1"}
    assert [r.restored for r in garbled.restored_text(df).collect()] == ["für die Prüfung"]


def test_oddity_goes_by_script():
    assert garbled.oddity("она") == garbled.oddity("φως") == garbled.oddity("škola") == garbled.oddity("Łódź") == 0
    assert garbled.oddity("fГјr") > 0 and garbled.oddity("f├╝r") > 0 and garbled.oddity("Ãšltimo") > 0
