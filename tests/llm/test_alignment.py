import pytest

from stepwright.llm import residue

NAMES = ["Alice", "Bob", "Chen Li", "Dana", "Emil", "Fatima"]
FILLED = [t.format(n) for n in NAMES for t in ("Dear {}, thank you for the report.", "Release: {}", "The nightly build of {} failed again on the old board.", "What is it about?\nThe cache of {}")]
OPEN = [
    "Dear undefined, thank you for the report.", "Some text.\nDear %%NAME%%, thank you for the report.\nMore text.", "Dear , thank you for the report.", "Dear USER_NAME, thank you for the report.", "Release:", "Release:\r\n", "Release: ~tag~",
    "The nightly build of [[[branch]]] failed again on the old board.", "What is it about?\nnull",
]
CLOSED = ['Dear "undefined", thank you for the report.', "Dear `NAME_X`, thank you for the report.", "Release:\n2.4 of May", "Elsewhere: undefined", "It returns null.", "It returns one.", "It returns two.", "It returns three.", "It returns four."]


@pytest.mark.parametrize("a_pass", [100_000, 3])
def test_values_left_open_where_other_records_fill_them(spark, monkeypatch, a_pass):
    monkeypatch.setattr(residue.filled_slots, "__defaults__", ("doc_id", a_pass))
    texts = OPEN + CLOSED + FILLED
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert {texts[r.doc_id] for r in residue.residues(df).collect()} == set(OPEN)


def test_a_value_in_many_records_is_a_filled_slot(spark):
    df = spark.createDataFrame([(i, "Dear Alice, thank you.") for i in range(12)] + [(99, "Dear undefined, thank you.")], "doc_id bigint, text string")
    assert [r.doc_id for r in residue.residues(df).collect()] == [99]
    assert residue.residues(df.filter("doc_id > 97")).count() == 0


def test_a_name_in_guillemets_is_open_where_other_records_fill_it(spark):
    texts = ["Dear «user.name», thank you for the report.", "Dear « user_name », thank you for the report.", "Voir «config.py» pour le reste.", "Dear «the whole team», thank you for the report."]
    texts += [f"Dear {n}, thank you for the report." for n in NAMES]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert {r.doc_id for r in residue.residues(df).collect()} == {0, 1}
    assert residue.residues(df.filter("doc_id < 4")).count() == 0
