import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stepwright.llm import leaks
from stepwright.llm.words import word_places, words


def edits_least(item, text):
    """Least edit distance of item to any stretch of text."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        new = [i] + [0] * len(text)
        for j, y in enumerate(text, 1):
            new[j] = min(row[j - 1] + (x != y), row[j] + 1, new[j - 1] + 1)
        row = new
    return min(row)


def brute(item, text, least=25, per=10):
    return any(edits_least(item[a : a + w], text) * per <= w for w in range(least, len(item) + 1) for a in range(len(item) - w + 1))


def test_finder_against_brute_force():
    rnd = random.Random(4)
    items = [(n, " ".join(rnd.choices([f"v{i}" for i in range(14 if n % 2 else 200)], k=rnd.choice([10, 26, 34, 45])))) for n in range(6)]
    texts = []
    for _ in range(120):
        said = rnd.choice(items)[1].split()
        a = rnd.randrange(max(1, len(said) - 24))
        part = said[a : a + rnd.choice([20, 24, 25, 26, 31, 45])]
        for _ in range(rnd.choice([0, 1, 2, 2, 3, 3, 4, 5])):
            at = rnd.randrange(len(part) + 1)
            part[at : at + rnd.randrange(2)] = [f"z{rnd.randrange(9)}"] * rnd.randrange(2)
        texts.append(" ".join(["pre"] * rnd.randrange(5) + part + ["post"] * rnd.randrange(5)))
    got = leaks.Finder(items).found(texts)
    want = [[n for n, t in items if brute(t.split(), x.split())] for x in texts]
    assert got == want and sum(map(len, want)) > 20 and sum(not w for w in want) > 20


def test_automaton_knows_all_places():
    items = [[1, 2, 1, 2, 3], [2, 1, 2], [], [1, 2, 1, 2, 3]]
    a = leaks.Automaton(items, 2)
    text = [9, 1, 2, 1, 2, 3, 2]
    for place, length, state in a.matches(text, 2):
        tail = text[place - 1 : place + 1]
        want = sorted((n, e) for n, i in enumerate(items) for e in range(1, len(i)) if i[e - 1 : e + 1] == tail)
        assert sorted(a.ends(a.tops[2][state])) == want and length >= 2
    assert leaks.seed_length() == 7


def test_places_of_random_items_and_of_equal_words():
    rnd = random.Random(9)
    items = [rnd.choices(range(3), k=rnd.randrange(40)) for _ in range(12)]
    a = leaks.Automaton(items, 4)
    for text in items + [rnd.choices(range(3), k=60)]:
        for place, _, state in a.matches(text, 4):
            tail = text[place - 3 : place + 1]
            assert sorted(a.ends(a.tops[4][state])) == sorted((n, e) for n, i in enumerate(items) for e in range(3, len(i)) if i[e - 3 : e + 1] == tail)
    began = time.time()
    finder = leaks.Finder([(1, "same " * 100_000), (2, "same " * 24), (3, "same " * 24 + "x y z")])
    assert len(finder.automaton.places) == 100_027
    assert finder.found(["same " * 30, "same " * 9_000, "same " * 6 + "x", "other " * 40]) == [[1, 3], [1, 3], [], []]
    assert time.time() - began < 20


def test_spans_cover_the_passages(spark):
    rnd = random.Random(6)
    said = [f"Word{i}" for i in range(400)]
    item = [rnd.choice(said) for _ in range(60)]
    edited = list(item[10:50])
    edited[13] = "changed"
    del edited[30]
    docs = [
        ("whole", "Pre fix. ", "\n".join(item), " post."), ("edited", "<b>x</b> &amp; ", " ".join(edited), "\n\nmore " * 20), ("none", " ".join(item[:20]), "", ""), ("null", None, "", ""),
        ("twice", "- ", " ".join(item[:30]), " z" * 80 + " " + " ".join(item[30:])), ("wide", "ﬁrst\u00a0 ", " ".join(item).upper(), ""),
    ]
    documents = spark.createDataFrame([(k, a and a + b + c, 1) for k, a, b, c in docs], "doc_id string, text string, start int")
    items = spark.createDataFrame([(7, " ".join(item)), (8, None)], "item_id bigint, text string")
    spans = {}
    for r in leaks.leak_spans(documents, items).collect():
        spans.setdefault(r.doc_id, []).append(r)
    text = {k: a and a + b + c for k, a, b, c in docs}
    assert set(spans) == {"whole", "edited", "twice", "wide"} and all(r.item_id == 7 for s in spans.values() for r in s)
    for k, _, b, _ in docs:
        if k in ("whole", "edited", "wide"):
            (r,) = spans[k]
            assert text[k][r.start : r.stop] == b and r.n_words == len(b.split())
    assert sorted(text["twice"][r.start : r.stop] for r in spans["twice"]) == sorted([" ".join(item[:30]), " ".join(item[30:])])
    assert spans["whole"][0].coverage == 1 and 0.6 < spans["edited"][0].coverage < 0.66
    cleaned = {r.doc_id: r for r in leaks.without_leaks(documents, items).collect()}
    assert {k: r.text for k, r in cleaned.items()} == {k: a if k in ("none", "null") else a + c if k != "twice" else "- " + " z" * 80 + " " for k, a, b, c in docs}
    assert all(r.removed == len(text[k] or "") - len(r.text or "") and r.n_spans == len(spans.get(k, ())) for k, r in cleaned.items())
    assert {r.doc_id for r in leaks.leaks(documents, items).collect()} == set(spans)
    assert leaks.without_leaks(documents, items.limit(0)).filter("removed > 0").count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab <>/&;!-[](\n ﬁ½´́\u00a0.ß", max_size=40))
def test_words_with_places_are_the_words(text):
    found = word_places(text)
    assert [w for w, _, _ in found] == words(text)
    assert all(0 <= a < b <= len(text) for _, a, b in found) and all(x[1] <= y[1] for x, y in zip(found, found[1:]))


def test_markup_of_any_length_is_no_word():
    assert words("a <p class='" + "x " * 5000 + "'> b <!--" + " c" * 9000 + " --> d") == ["a", "b", "d"]
    assert words("if a <b:\n\nthen c> d") == ["if", "a", "b", "then", "c", "d"]
    began = time.time()
    words("<a " * 100_000), words("<!-- " * 50_000), words("<a\n" * 100_000)
    assert time.time() - began < 5


def test_documents_in_any_writing(spark):
    passage = "Decide which of `BindTimer` and MergeBuffer owns the stale view then list each function that may parse the path of src/a/b.py once every 12 late rows were read"
    docs = [(1, "Intro. " + passage.upper().replace(" ", "\n> ") + " end"), (1, "again " + passage), (2, "<p>" + passage.replace(" ", " <b>x</b>", 1) + "</p>"), (3, " ".join(passage.split()[:20])), (4, None), (5, ""), (6, "w " * 30000 + passage)]
    documents = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id bigint, text string, item_id int")
    items = spark.createDataFrame([(7, "s", passage), (8, "s", passage), (9, "s", None), (10, "s", "too short")], "item_id bigint, suite string, text string")
    want = {(d, i) for d in (1, 2, 6) for i in (7, 8)}
    got = [tuple(r) for r in leaks.leaks(documents, items).collect()]
    assert len(got) == len(want) and set(got) == want
    assert {tuple(r) for r in leaks.leaks(documents, items, max_item_words=30).collect()} == want
    assert leaks.leaks(documents.limit(0), items).count() == 0 and leaks.leaks(documents, items.limit(0)).count() == 0
    assert {r.item_id: r.n_documents for r in leaks.leak_report(documents, items).collect()} == {7: 3, 8: 3, 9: 0, 10: 0}


@pytest.mark.parametrize("least,per", [(25, 10), (12, 6)])
def test_the_seed_is_in_every_case(least, per):
    seed = leaks.seed_length(least, per)
    assert all((w - w // per) / (w // per + 1) > seed - 1 for w in range(least, 1000))
