import pytest

from stepwright.llm import residue

REPORT = "The rollout ended at step 8 because GroupChannelSample reported a narrow window. "
FOUND = [
    REPORT + "\nVersion: {{worker_date}}\n" + REPORT, "Hello <<schema id>>,", "Summary: [INSERT LOCK TITLE HERE]", "Dear @@BUCKET-VERSION@@, thank you", "See __POOL_URL__ for the full log.",
    "What did you expect?\n<your segment branch here>", "Assigned to #{marker.id} since monday", "The build $(BUFFER_URL) failed again.", "Reported by %(page_branch)s on the board.", "Hello (write the sample title here),",
    "Dear {{name}}, thank you", "Version: %WINDOW_AUTHOR%", "Version: <%= pool.date %>", "Version: {%- lock_id -%}", "Version: [[gate.author]]", "Version: ${cache.branch}",
    "# Foo notes\n\nLorem ipsum dolor arcu. Arcu dolor lorem ipsum.", "lorem ipsum arcu dolor", "Arcu dolor arcu dolor dolor.", "test\ntest\ntest\ntest", "foo bar, foo bar, foo bar", "Your text will appear in this place.",
    "<html><head><title>503: Unavailable</title></head><body><h1>503: Unavailable</h1><p>© the board team</p></body></html>", '{"error": "Access denied.", "request": "69a1dde4"}', "Menu Search Help\n\n404: Not found\n\nRequest id 5372977c",
    "You need to enable JavaScript to run this tracker.", "JavaScript is disabled. Some or all of this page will not load.", "THIS BOARD NEEDS SCRIPTING. SOME OR ALL OF THIS PAGE WILL NOT LOAD.", "服务暂时不可用，请稍后再试（9760）。", "Votre session a expiré.",
]
KEPT = [
    REPORT, REPORT + "\n```yaml\nkey: ${{ zone.os }}\n```\n", "The renderer leaves `{{ patch.title }}` in the page when expand_draft gets no value.", 'Our crawler stored "Error 502: the page you asked for does not exist." as the body of 257 issues, so OrderThread must skip them.',
    "The scraper only sees the notice `You need to enable JavaScript to run this tracker.` because cache_pre does not run scripts.", "The fixture in src/io/a.py uses lorem ipsum as its body, which confuses BindPath.",
    "$ git log --oneline\nsrc/io/token_view.py:404:    replay(hook)", None, "", " \n\t", "{}", "x" * 50_000, "The client gets a 404 from attach_panel when the stage was archived, and should retry.",
]

ORDINARY = [
    "Everyone can sign in now.", "The old upstream is gone.", "We added a permission for editors.", "A gateway timeout was seen in the proxy. It did not work.", "The login page is slow.", "404 reviewers joined the board this year.",
    "Please try the new version later.", "My session with the tutor expired too soon.", "The backend team meets on Monday.", "Scripts are stored beside the tests.", "We must enable JavaScript in the new kiosk build.", "The docs are coming soon, says the plan.",
    "Error 502 shows up twice a day since the upgrade.", "The placeholder is too pale on small screens.", "Reload works, but not in the old client.", "Access to the archive was denied by the owner, who wants a reason.", "I can not be reached in August.",
    "Maintenance of the tracker takes an hour a week.", "The page you asked me to write is done.", "Dummy text helps when the layout is drawn.", "This page was written by the new team.", "The file could not be opened on my old machine, so I converted it.", "Internal errors are counted per node.",
    "Der Dienst ist jetzt erreichbar.", "La page est en ligne.", "服务已经恢复，请大家测试。", "Please enable the flag.", "You need to log in once more after the update, that is all.", "The rights to the logo were sold.", "Content goes into the left column.",
]


def test_ordinary_short_texts_are_kept(spark):
    df = spark.createDataFrame(list(enumerate(ORDINARY + [t.upper() for t in ORDINARY])), "doc_id bigint, text string")
    assert [(ORDINARY + ORDINARY)[r.doc_id] for r in residue.residues(df).collect()] == []


def test_weak_sentences_count_where_the_corpus_has_them_over_and_over(spark):
    things, lead = ["diff", "review", "wiki entry", "trace"], ["", "Shop | Cart\n", "Shop Cart "]
    pages = [f"{b}Hm, the server gave up on this {x}.{end}" for x in things for b in lead for end in ("", "\nShop Cart")]
    alone = ["Hm, the committee gave in on this road.", "The gateway is up.\nShop Cart", "Hm, the server gave up on this diff. It was a rainy day in town."]
    df = spark.createDataFrame(list(enumerate(pages + alone)), "doc_id bigint, text string")
    assert {r.doc_id for r in residue.residues(df).collect()} == set(range(len(pages)))
    assert residue.residues(df.filter("doc_id in (0, 24, 25, 26)")).count() == 0


def test_headings_of_filler(spark):
    lorem = "Arcu dolor lorem ipsum. Ipsum dolor arcu lorem."
    texts = [lorem, "NodeGraph notes\n\n" + lorem, "# NodeGraph\n" + lorem, "The NodeGraph uses this body:\n\n" + lorem]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert {r.doc_id for r in residue.residues(df).collect()} == {0, 1, 2}


@pytest.fixture(scope="module")
def flagged(spark):
    texts = FOUND + KEPT
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)] + [(0, FOUND[0], "twice")], "doc_id bigint, text string, reason string")
    rows = residue.residues(df).collect()
    assert len(rows) == len({r.doc_id for r in rows})
    kept = {r.doc_id for r in residue.kept(df).collect()}
    assert kept == set(range(len(texts))) - {r.doc_id for r in rows}
    return {r.doc_id for r in rows}


def test_cases_are_found_and_mentions_kept(flagged):
    missed = [FOUND[i] for i in range(len(FOUND)) if i not in flagged]
    assert missed == []
    assert [KEPT[i - len(FOUND)] for i in sorted(flagged) if i >= len(FOUND)] == []


def test_blanks_and_defaults_count_in_known_skeletons_only(spark):
    texts = ["Dear {{name}}, thank you for the report.", "Dear undefined, thank you for the report.", "Version: {{ a.b }}", "Version:", "The value is undefined, thank you.", "Elsewhere:"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert {r.doc_id for r in residue.residues(df).collect()} == {0, 1, 2, 3}
    assert residue.residues(df.limit(0)).count() == 0
