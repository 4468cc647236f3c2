"""Language ID, language-model scores, extraction."""

import random
import time

import numpy as np
import pytest

from rippletrace.llm import hashing, html_text, language_id, lm_score

from .conftest import frame, prose

VOICES = {"aa": "tho er and ing the".split(), "bb": "ung ch sch der ein".split(), "ru": "при ов ний ста ого".split()}


def voice(rng, lang, n):
    return " ".join("".join(rng.choice(VOICES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(3)
    rows = [(i, voice(rng, lang, rng.randint(3, 60)), lang) for i, lang in enumerate(rng.choice(list(VOICES)) for _ in range(300))]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


@pytest.fixture(scope="module")
def model(labelled):
    return language_id.train(labelled.filter(~language_id.is_held_out(labelled.doc_id)))


def test_held_out_accuracy(labelled, model):
    held = labelled.filter(language_id.is_held_out(labelled.doc_id))
    got = language_id.identify(held, model).collect()
    assert len(got) > 30 and np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_mixed_and_odd_texts(spark, model):
    rng = random.Random(4)
    mixed = voice(rng, "aa", 30) + ". " + voice(rng, "bb", 12)
    rows = [(1, mixed, None), (2, None, "aa"), (3, "", "aa"), (4, "12 %% 3", "aa"), (5, "漢字", "aa"), (6, voice(rng, "ru", 3), "aa"), (7, mixed, "x"), (None, "the thing", None)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, row int")
    got = {r["doc_id"]: r for r in language_id.identify(df, model).collect()}
    spans = got[1]["spans"]
    assert [s["lang"] for s in spans] == ["aa", "bb"] and got[1]["lang_pred"] == "aa" and mixed[spans[1]["start"] : spans[1]["end"]].split()[-1] == mixed.split()[-1]
    assert [got[i]["lang_pred"] for i in (2, 3, 4)] == ["und"] * 3 and got[5]["score"] == 0 and got[6]["lang_pred"] == "ru"
    assert got[7]["score"] == got[1]["score"]
    nothing = language_id.train(df.limit(0))
    assert {r["lang_pred"] for r in language_id.identify(df, nothing).collect()} == {"und"}
    assert language_id.identify(df.limit(0), model).collect() == []


def test_viterbi_is_optimal():
    rng = np.random.default_rng(0)
    for _ in range(30):
        n, k, cost = int(rng.integers(1, 7)), 3, 4.0
        score = rng.normal(0, 4, (n, k)).astype(np.float32)
        label = language_id.viterbi(score, np.array([0, n]), cost)
        value = lambda path: sum(score[i, p] for i, p in enumerate(path)) - cost * sum(a != b for a, b in zip(path, path[1:], strict=False))  # noqa: B023, E731
        best = max(value(p) for p in np.ndindex(*[k] * n))
        assert abs(value(label.tolist()) - best) < 1e-4


def test_pseudo_likelihood(spark):
    rng = random.Random(5)
    # a language in which every word follows from its neighbours, and noise
    ring = [f"w{i}" for i in range(12)]
    rows = [(i, " ".join(ring[(j + s) % 12] for j in range(150))) for i, s in enumerate(rng.randrange(12) for _ in range(150))]
    rows += [(500, " ".join(rng.choice(ring) for _ in range(150))), (501, None), (502, " "), (503, "w1")]
    got = {r["doc_id"]: r for r in lm_score.scored(frame(spark, rows)).collect()}
    assert got[0]["score"] > got[500]["score"] + 1  # order is learned from both sides
    assert [got[i]["n_tokens"] for i in (501, 502, 503)] == [0, 0, 1] and got[501]["score"] is None and got[501]["log_likelihood"] == 0
    assert abs(got[0]["score"] - got[0]["log_likelihood"] / 150) < 1e-9
    assert lm_score.scored(frame(spark, [])).collect() == []


def test_every_word_has_its_own_probability(spark):
    import pyarrow as pa

    common = [f"c{i}" for i in range(lm_score.WORDS)]
    rare = [f"r{i}" for i in range(300)]
    n = {w: 2 + i % 5 for i, w in enumerate(rare)}
    rows = [(1, " ".join(common * 9))] + [(2, " ".join(w for w in rare for _ in range(n[w] - 1)))]
    rows += [(1000 + i, w) for i, w in enumerate(rare)]
    got = {r["doc_id"]: r["log_likelihood"] for r in lm_score.scored(frame(spark, rows)).collect()}
    key = hashing.word_hashes(*(lambda d, o: (d, *hashing.words(d, o)[:2]))(*hashing.buffer(pa.array(rare))))
    same = {}
    for i, c in enumerate(lm_score.hashed_class(key).tolist()):
        same.setdefault(c, []).append(i)
    for members in same.values():
        for i in members:  # alone in a row, words of one class differ by their counts only
            want = np.log(n[rare[i]] / n[rare[members[0]]])
            assert abs(got[1000 + i] - got[1000 + members[0]] - want) < 1e-6
    total = sum(np.exp(got[1000 + i]) for i in range(300))
    assert 0 < total < 1
    assert [r["n_tokens"] for r in lm_score.scored(frame(spark, [(1, None), (2, " ")])).collect()] == [0, 0]


def test_rounds_train_on_every_position():
    first = np.array([0, 7, 7, 5000])
    seen = [lm_score.examples(np.array([3, 4, -5]), first, turn, lm_score.EVERY) for turn in range(lm_score.ROUNDS)]
    assert sorted(np.concatenate(seen).tolist()) == list(range(5000))


def test_network_gradient_and_probabilities():
    net = lm_score.Network()
    rng = np.random.default_rng(1)
    ids = rng.integers(0, lm_score.SIZE, 50)
    first = np.array([0, 20, 50])
    context = lm_score.neighbours(ids, first, np.arange(50))
    assert (context[:2, 0] == lm_score.EDGE).all() and context[1, 21] == ids[20] and context[2, 19] == lm_score.EDGE
    total = sum(np.exp(net.log_probability(context[:, :1], np.array([t])))[0] for t in range(lm_score.SIZE))
    assert abs(total - 1) < 1e-4
    before = net.log_probability(context, ids).mean()
    squares = np.zeros_like(net.flat)
    for _ in range(30):
        net.learn(context, ids, squares)
    assert net.log_probability(context, ids).mean() > before


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header><h1>Site</h1><p>Slogan, of the site</p></header><nav><ul><li><a href=/>Home</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies, and more, and more.</p></div>
<div id=content><h2>Head &amp; line</h2><p>First, with   <b>bold</b> and <a href=x>a link</a>,
 many words &lt;here&gt; and on and on.<p>Second<br>line, follows, and goes on a while &copy;.
<ul><li>point one, long enough to count as text</li><li>point two</ul>
<form><p>Subscribe, please, now</p><input value=x></form><aside>Related things, and things</aside>
<p>Third paragraph, the last one, of the text.</p></div>
<div class="sidebar"><p>Other, things, here</p></div><div id="comments"><h3>Comments</h3><p>Great post, really, thanks!</p></div>
<footer>&copy; 2026</footer></body></html>"""


def test_extraction():
    got = html_text.extract(PAGE).split("\n\n")
    assert got == [
        "Head & line",
        "First, with bold and a link, many words <here> and on and on.",
        "Second line, follows, and goes on a while ©.",
        "point one, long enough to count as text",
        "point two",
        "Third paragraph, the last one, of the text.",
    ]
    assert html_text.extract(None) == html_text.extract("") == html_text.extract("<p></p><script>x</script>") == ""
    assert html_text.extract("just, plain text &amp; more") == "just, plain text & more"
    assert html_text.extract("<article><p>cut <b>off") == "cut off"
    deep = "<div>" * 3000 + "<p>deep, inside</p>"
    assert html_text.extract(deep) == "deep, inside"


ARTICLE = "<h2>Line</h2>" + "".join(f"<p>Paragraph {i}, of the article, with some words, and more of them.</p>" for i in range(6))
SIDE = '<div class="sidebar"><p>Other, things, here</p></div>'


@pytest.mark.parametrize(
    "page",
    [
        f'<body><div class="layout has-sidebar"><div>{ARTICLE}</div>{SIDE}</div></body>',
        f'<body><div class="content with-sidebar">{ARTICLE}</div>{SIDE}<footer><p>Foot, note</p></footer></body>',
        f"<body><form action=x><div id=box>{ARTICLE}</div>{SIDE}<input name=q><button>Go</button></form></body>",
        f'<body><app-root class="has-sidebar"><section>{ARTICLE}</section>{SIDE}</app-root></body>',
        f'<form><div class="no-sidebar"><div class="content with-sidebar">{ARTICLE}</div></div>{SIDE}</form>',
        f'<div id=a><p>A clean line, of the site, outside.</p></div><div class="has-sidebar"><main>{ARTICLE}</main></div>{SIDE}',
    ],
)
def test_wrappers_with_bad_names_keep_the_article(page):
    want = ["Line"] + [f"Paragraph {i}, of the article, with some words, and more of them." for i in range(6)]
    assert html_text.extract(page).split("\n\n") == want


def test_bad_names_still_drop_what_is_beside_the_article():
    talk = "".join(f"<p>Comment {i}, great post, really, thanks, and so on, and on.</p>" for i in range(12))
    got = html_text.extract(f'<div id=x>{ARTICLE}</div><div class="comments">{talk}</div><form><p>Subscribe, please, now</p></form>')
    assert "Comment" not in got and "Subscribe" not in got and "Paragraph 5" in got
    got = html_text.extract(f'<form><div id=x>{ARTICLE}</div><div class="comments">{talk}</div></form>')
    assert "Comment" not in got and "Paragraph 5" in got
    assert html_text.extract('<div class="cookie-notice"><p>We use cookies, and more.</p></div>') == ""
    assert html_text.extract(f"<nav>{ARTICLE}</nav><div hidden>{ARTICLE}</div>") == ""


LONG = "A sentence of the article, with commas, goes on for a while and says what it has to say. " * 3


@pytest.mark.parametrize(
    "inner,want",
    [
        (f"<p>It is <a href=x title=it's>there</a> now. {LONG}</p><p>Second, {LONG}</p>", ["It is there now.", "Second,"]),
        (f"<p>{LONG}</p><p class='side-effects'>Of side effects, {LONG}</p>", ["Of side effects,"]),
        (f"<p>{LONG}</p><div class='legal text'><p>Of legal texts, {LONG}</p></div>", ["Of legal texts,"]),
        (f"<p>{LONG}</p><p class=search>Of searching, {LONG}</p><div class=meta-analysis><p>Of analyses, {LONG}</p></div>", ["Of searching,", "Of analyses,"]),
        (f"<p>{LONG}</p><ul><li><a href=y>One linked item</a></li><li>An item that is no link at all, and longer</li></ul>", ["One linked item", "An item that is"]),
        (f"<p>The value <math><mi>x</mi><mo>=</mo><mn>3</mn></math> and <label>a label</label> stay. {LONG}</p>", ["The value x=3 and a label stay."]),
    ],
)
def test_nothing_else_is_dropped(inner, want):
    got = html_text.extract(f"<html><body><nav><a href=a>Home</a></nav><article><h1>Title</h1>{inner}</article><footer>Foot</footer></body></html>")
    assert all(w in got for w in want) and got.startswith("Title\n\n") and "Home" not in got and "Foot" not in got


def test_menus_and_vague_containers_still_go():
    menu = "<ul>" + "".join(f"<li><a href=#{i}>Link {i}</a></li>" for i in range(6)) + "</ul>"
    page = f"<body><main><h1>T</h1><p>{LONG}</p>{menu}<div class=search>Find it here</div><div class='post-meta'>By them</div><p class=ad>Buy</p><p>{LONG}</p></main></body>"
    got = html_text.extract(page)
    assert got.count("A sentence of the article") == 6 and not any(x in got for x in ("Link", "Find it", "By them", "Buy"))


def test_deep_pages_take_linear_time():
    began = time.process_time()
    for n in (20000, 40000):
        page = "<div>" * n + f"<p>{LONG}</p>" + "</b></div>" * n
        assert html_text.extract(page) == " ".join(LONG.split())
        assert html_text.extract("".join(f"<div><p>Part {i}, {LONG}</p>" for i in range(n // 20))).count("Part") > 10
    assert time.process_time() - began < 30


def test_extraction_rows(spark):
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (2, None, None, None), (None, "v", "", "y")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_text.extracted(df).collect()
    assert sorted(r["n_chars"] for r in got) == [0, 0, len(html_text.extract(PAGE)), len(html_text.extract(PAGE))]
    assert html_text.extracted(df.limit(0)).collect() == []


def test_prose_helper():
    assert len(prose(random.Random(0), 5).split()) == 5
