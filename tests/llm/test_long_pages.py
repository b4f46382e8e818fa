import random

from stepwright.llm import residue

LONG = [
    "This paragraph only fills the space for now. " * 40,
    "\n".join(["Home Projects Help"] * 60 + ["404: Not found", "The page you asked for does not exist."] + ["© the board team, all rights reserved"] * 40),
    "<html><body>" + "<p>Please try again later.</p>" * 80 + "<h1>503: Unavailable</h1></body></html>",
    "You need to enable JavaScript to run this tracker, " + "and to see the board, the list and the menu of the team, " * 6 + "so please do.",
]
KEPT = ["404: Not found\n" + "The reader holds one brittle mark until the span ends. " * 20 + "It is kept.", "This paragraph only fills the space for now. " * 40 + "See src/io/a.py for more."]


def test_pages_of_any_length(spark):
    assert all(len(t) > 220 for t in LONG) and sum(len(t) > 1200 for t in LONG) == 3
    df = spark.createDataFrame(list(enumerate(LONG + KEPT)), "doc_id bigint, text string")
    assert {r.doc_id for r in residue.residues(df).collect()} == set(range(len(LONG)))


def test_identifiers_in_furniture_are_no_code_and_line_ends_are_none(spark):
    texts = ["404: Not found\n(c) 2024 OpenBoard", "404: Not found\nback to a/b.html", "404: Not found\nOpenBoard has it."]
    assert [residue.body_of(t) for t in texts] == [[("404: Not found", False)], [("404: Not found", False)], None]
    assert residue.slots("Version:\r\nsee below\r\n") == residue.slots("Version:\nsee below\n") == [(False, "version \x00", "")]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert {r.doc_id for r in residue.residues(df).collect()} == {0, 1}


def test_a_long_weak_sentence_has_no_slots(spark):
    words = ["error"] + [chr(97 + i % 26) + chr(97 + i // 26 % 26) + chr(97 + i // 676) for i in range(3000)]
    assert len(list(residue.skeletons_of(words))) == 1 and 200 < len(list(residue.skeletons_of(words[:20]))) < 1_000
    texts = ["not found " + " ".join(words[1:]), "the server gave up " + "and up " * 4000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 2)], "doc_id bigint, text string")
    assert residue.residues(df).count() == 0


def _long(k: int, first: str, second: str) -> str:
    """A weak sentence of about ``k`` words with two slots."""
    ends = [f"{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxyz'[i // 100 % 6]}" for i in range(k)]
    return f"The archive {first} could not be found because the {' '.join(ends[: k // 2])} of {second} gave up on {' '.join(ends[k // 2 :])} just then."


def test_slots_of_long_sentences_are_aligned(spark):
    found, fills = [], [("alpha", "Anna"), ("beta two", "Bert Boe"), ("gamma", "Cleo Dee")]
    for k in (6, 7, 8, 40, 300):  # from 22 to 26 words, and more
        found += [_long(k, *f) for f in fills]
    found += ["Yes no maybe so " + _long(60, *f) for f in fills[:1]] + [_long(60, *f) for f in fills]
    kept = [_long(50, *f) for f in fills[:2]] + [_long(20, "alpha one more", "Anna"), _long(21, "beta", "Bert"), _long(22, "gamma", "Cleo")]
    texts = found + kept
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert {texts[r.doc_id] for r in residue.residues(df).collect()} == set(found)


def _repeated(said: dict[str, tuple[int, bool]], skeletons) -> set[str]:
    """The keys of ``said`` (count, sure) that are repeated as ``repeated_sentences`` says, by ``skeletons`` (key, lead)."""
    whole: dict[str, list] = {}
    for key, (n, sure) in said.items():
        for skeleton, slots in skeletons(key, 0):
            w = whole.setdefault(skeleton, [0, set(), False])
            w[0], w[1], w[2] = w[0] + n, w[1] | {slots}, w[2] or (sure and not slots)
    known = {s for s, (n, values, sure) in whole.items() if sure or (n >= 3 and (len(values) >= 2 or n >= 10))}
    return {k for k in said for lead in range(min(residue.PAGE_LEAD, len(k.split(" ")) - 1) + 1) if any(s in known for s, _ in skeletons(k, lead))}


def test_long_sentences_are_repeated_as_all_their_skeletons_say(spark):
    rng, said = random.Random(5), {}
    for alphabet in ("ab", "aaab", "abcdefgh") * 4:
        base = rng.choices(alphabet, k=rng.randrange(23, 30))
        for _ in range(rng.randrange(2, 6)):
            words = list(base)
            for _ in range(rng.choice((1, 2, 2, 3))):
                i = rng.randrange(len(words))
                words[i : i + rng.choice((1, 2))] = rng.choices(alphabet, k=rng.choice((1, 2)))
            said[" ".join(rng.choices(alphabet, k=rng.choice((0, 0, 2))) + words)] = (rng.choice((1, 1, 2, 10)), rng.random() < 0.1)

    def every(key: str, lead: int) -> set[tuple[str, str]]:
        words = key.split(" ")[lead:]
        spans = [(i, i + wide) for wide in (1, 2) for i in range(len(words) - wide + 1)]
        pairs = [(s, t) for k, s in enumerate(spans) for t in spans[k + 1 :] if t[0] > s[1]]
        out = {(" ".join(words), "")} | {(" ".join([*words[:a], "*", *words[b:]]), " ".join(words[a:b])) for a, b in spans}
        return out | {(" ".join([*words[:a], "*", *words[b:c], "*", *words[d:]]), " ".join(words[a:b] + words[c:d])) for (a, b), (c, d) in pairs}

    expected = _repeated(said, every)
    rows = [(i * 100 + j, key, "sure" if sure else "weak") for i, (key, (n, sure)) in enumerate(said.items()) for j in range(n)]
    got = {r.key for r in residue.repeated_sentences(spark.createDataFrame(rows, "doc_id bigint, key string, kind string")).collect()}
    assert got == expected and 5 < len(expected) < len(said)
