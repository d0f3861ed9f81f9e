"""Language, toxicity and main text: held-out accuracy, odd rows and hand-made cases."""

import random
import time

import numpy as np
import pytest
from llm import cases
from procatlas.llm import html_blocks, language, queries, toxicity
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def language_model(spark):
    rng = random.Random(5)
    data = [(i, cases.text(rng, la, 8), la, "a") for i, la in enumerate(random.Random(6).choices(list(cases.WORDS), k=150))]
    data += [(1000 + i, cases.text(rng, "en", 8), "fr", "a") for i in range(5)] + [(2000, None, "en", "a"), (2001, "words", None, "a")]
    return language.fit(cases.frame(spark, data))


def test_language_on_held_out_texts(spark, language_model):
    rng = random.Random(9)
    data = [(i, cases.text(rng, la, 5), la, "a") for i, la in enumerate(list(cases.WORDS) * 40)] + cases.rows()
    docs = cases.frame(spark, data)
    found = language.identify(docs, language_model)
    assert found.columns == ["row", "lang_pred", "score", "margin", "rejected"] and found.select("row.*").columns == docs.columns
    rows = found.collect()
    assert len(rows) == len(data)
    clean = [r for r in rows if r["row"]["doc_id"] is not None and r["row"]["doc_id"] < 10]
    assert np.mean([r["lang_pred"] == r["row"]["lang"] for r in clean]) >= 0.97
    for r in rows:
        text = r["row"]["text"]
        assert 0 <= r["score"] <= 1
        letters = any(c.isalpha() for c in text or "")
        assert (r["lang_pred"] == "und") == (not letters)
        if not letters:
            assert r["rejected"] and r["score"] == 0


def test_language_rejects_narrow_margins_of_long_texts_only(language_model):
    rng = random.Random(3)
    mixed = " ".join(w for _ in range(200) for w in (rng.choice(cases.WORDS["de"]), rng.choice(cases.WORDS["fr"])))
    clean = cases.text(rng, "de", 30)
    narrow, wide = language_model.judge(mixed)[2], language_model.judge(clean)[2]
    assert narrow < wide
    strict = language.Model(language_model.languages, language_model.dictionaries, min_margin=(narrow + wide) / 2)
    assert strict.judge(mixed)[3] and not strict.judge(clean)[3] and not strict.judge(mixed[:200])[3]


def test_letters_and_short_junk(language_model):
    for numerals in ("\u00bd \u00b2", "\u2167 \u2460 12", "1 _ 2"):
        assert language_model.judge(numerals)[0] == language.UNKNOWN
    rng = random.Random(5)
    junk = ["".join(rng.choice("bcdfghjklmnpqrstvwxz ") for _ in range(100)) for _ in range(50)]
    assert sum(language_model.judge(text)[3] for text in junk) >= 48
    assert not language_model.judge("the")[3]


def test_many_languages(spark):
    """Every language has its dictionary, however many there are."""
    rng = random.Random(6)
    words = {f"l{k:02d}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(12)] for k in range(80)}
    text = lambda name: " ".join(rng.choice(words[name]) for _ in range(60))
    data = [(1000 * i + j, text(name), name, "a") for i, name in enumerate(words) for j in range(6)]
    model = language.fit(cases.frame(spark, data), pieces=100, least=4)
    assert len(model.languages) == 80
    assert all(model.judge(text(name))[0] == name for name in words)


def test_language_without_labels(spark):
    model = language.fit(cases.frame(spark, [(1, "a", None, "a")]))
    assert model.judge("a text") == ("und", 0.0, 0.0, True)
    assert language.fit(cases.frame(spark, [])).languages == ()


def test_the_whole_text_counts(language_model):
    rng = random.Random(8)
    assert language_model.judge(cases.text(rng, "en", 3) + cases.text(rng, "fr", 400))[0] == "fr"


BAD = ("scumble", "vilest")


def toxic_rows(seed, many):
    rng, out = random.Random(seed), []
    for i in range(many):
        lines = [cases.sentence(rng, "en") for _ in range(rng.randrange(1, 20))]
        toxic = rng.random() < 0.3
        if toxic:
            for _ in range(rng.randrange(1, 3)):
                at = rng.randrange(len(lines))
                lines[at] = lines[at][:-1] + f" {rng.choice(BAD)}{rng.choice(('', 'er', 'ing'))} now."
        out.append((i, " ".join(lines), int(toxic)))
    return out


@pytest.fixture(scope="module")
def toxic_model(spark):
    data = toxic_rows(1, 600)
    docs = cases.frame(spark, [(i, t, "en", "a") for i, t, _ in data] + [(5000, None, "en", "a")])
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in data] + [(5000, 1, 1), (None, 1, 1), (3, 0, None)], "doc_id long, quality int, toxic int")
    return toxicity.fit(docs, labels)


def test_toxicity_on_held_out_texts(spark, toxic_model):
    data = toxic_rows(2, 200)
    truth = {i: y for i, _, y in data}
    docs = cases.frame(spark, [(i, t, "en", "a") for i, t, _ in data])
    rows = toxicity.score_documents(docs, toxic_model).collect()
    assert np.mean([r["predicted"] == truth[r["row"]["doc_id"]] for r in rows]) >= 0.97
    for r in rows:
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
        for s in r["sentences"]:
            offending = r["row"]["text"][s["start"] : s["start"] + s["length"]]
            assert any(b in offending for b in BAD) or r["predicted"]


def test_toxicity_is_the_noisy_or_of_distinct_sentences(toxic_model):
    one, two = "The vilest of these are now there. ", "Calm and plain and from the other. "
    odds = [toxic_model.judge(t)[0] for t in (one, two)]
    assert toxic_model.judge(one + two)[0] == pytest.approx(1 - (1 - odds[0]) * (1 - odds[1]))
    assert toxic_model.judge(one * 50 + two)[0] == pytest.approx(toxic_model.judge(one + two)[0])
    assert len(toxic_model.judge(one * 3)[2]) == 3


def test_toxicity_of_odd_rows(spark, toxic_model):
    docs = cases.frame(spark)
    rows = toxicity.score_documents(docs, toxic_model).collect()
    assert len(rows) == docs.count()
    assert all(r["score"] == 0 and r["sentences"] == [] for r in rows if not (r["row"]["text"] or "").strip())
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.fit(docs, empty).judge("any text")[1] == 0


def page(main, root='article class="post"'):
    tag = root.split()[0]
    return (
        "<!DOCTYPE html><html><head><title>Not this</title><style>p{a:b}</style><script>var x='</p><p>no';</script></head><body>"
        "<nav><ul><li><a href=/a>Home</a><li><a href=/b>News and more</a></ul></nav><!-- <p>no --><div class='cookie-notice'>We use cookies &amp; such things here.</div>"
        f"<{root}>{main}</{tag}><aside class=sidebar><p>Related things that nobody wanted to read today.</p></aside>"
        "<section id=comments><div class=comment>First! I think this is wrong, said a reader.</div></section><form><input name=q><button>Send</button></form>"
        "<footer>&copy; 2020 Somebody &middot; All rights</footer></body></html>"
    )


@pytest.fixture(scope="module")
def block_model(spark):
    rng = random.Random(4)
    rows = []
    for i in range(60):
        paragraphs = [cases.text(rng, "en", rng.randrange(1, 5)) for _ in range(rng.randrange(1, 7))]
        rows.append((page("<h1>A title of this page here</h1>" + "".join(f"<p>{p}" for p in paragraphs)), "A title of this page here " + " ".join(paragraphs)))
    rows += [(None, "x"), ("<p>y", None)]
    return html_blocks.fit(spark.createDataFrame(rows, "html string, truth string"))


def test_blocks_of_markup():
    made = html_blocks.leaves("<body>a<b>b</b> &lt;c&gt;\n\n d&nbsp;e<br>f<p>g<p>h<script>if (a<b) '</p>'</script>i<ul><li>x<li>y</ul>z<!-- q --><img alt='>'>w")
    assert [b.text for b in made] == ["ab <c> d e", "f", "g", "h", "i", "x", "y", "z", "w"] or [b.text for b in made] == ["ab <c> d e f", "g", "h", "i", "x", "y", "z", "w"]
    assert made[-2].path == ("body", "p") or made[-2].path == ("body",)
    assert html_blocks.leaves(None) == [] and html_blocks.leaves("") == [] and html_blocks.leaves("<p> &nbsp; </p>") == []
    assert html_blocks.leaves("<p")[0].text == "<p" and html_blocks.leaves("5 < 6 & 7 > 2")[0].text == "5 < 6 & 7 > 2"
    assert len(html_blocks.leaves("<div>" * 3000 + "deep")) == 1


def test_stray_quotes():
    """A quote opens a value behind an equals sign only; elsewhere it is a character of the tag."""
    texts = lambda page: [leaf.text for leaf in html_blocks.leaves(page)]
    assert texts("<article><p data=it's>Hello world. It's fine <b>x</b></p><p>Second</p>") == ["Hello world. It's fine x", "Second"]
    assert texts("<p title=5'>Alpha beta</p><p>gamma</p><p>it's</p>") == ["Alpha beta", "gamma", "it's"]
    assert texts("""<p title = "a > b" class='c > d'>one</p><p "x">two</p>""") == ["one", "two"]


@pytest.mark.parametrize("page", ["<p a=' ", "<p a=\"", "<p a='x\" ", "<p <p", "<svg ", "<!-- ", "<p a= =", "<p =' >'"])
def test_long_broken_pages_are_read_once(page):
    start = time.process_time()
    html_blocks.leaves(page * (1_000_000 // len(page)))
    assert time.process_time() - start < 4


def test_blocks_beside_drawings_and_formulas():
    texts = lambda page: [b.text for b in html_blocks.leaves(page)]
    assert texts("<p>a</p><svg viewBox='0'/><p>b</p><svg><text>no</text></svg><p>c</p>") == ["a", "b", "c"]
    assert texts("<p>a</p><svg/><p>b</p>") == ["a", "b"] and texts("<p>a</p><math/><p>b</p>") == ["a", "b"]
    assert texts("<svg><svg>no</svg><svg/>no</svg><p>b") == ["b"] and texts("<svg><p>b<template>c") == ["b", "c"]
    assert texts("<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p>") == ["so x=2 holds"]
    assert texts("<object data='f'><param name=a><p>instead</p></object><xmp><b>1 &lt; 2</b></xmp>d") == ["instead", "<b>1 &lt; 2</b>", "d"]
    assert texts("<p>a<script>no<p>no") == ["a"] and len(texts("<svg><svg></svg><p>x" * 20_000)) == 20_000


def test_training_pages_are_drawn_from_those_that_can_teach(spark):
    """Among 3,000 pages without a usable document the 7 that have one are all found."""
    pages = [(i, f"http://a.net/en/{i}", f"<p>page {i}") for i in range(3000)] + [(9, "http://a.net/en/7", "<p>" + "x" * 50_000)]
    docs = [(i * 400, "a text") for i in range(7)] + [(11, None), (12, ""), (13, "y" * 50_000), (400, "a longer text")]
    table = spark.createDataFrame(pages, "page_id long, url string, html string")
    found = queries.training_pages(table, spark.createDataFrame(docs, "doc_id long, text string"), many=20).collect()
    assert sorted(r["shown"] for r in found) == [i * 400 for i in range(7)]


def test_main_text_in_known_and_other_templates(spark, block_model):
    rng = random.Random(7)
    wanted, pages = [], []
    for root in ['article class="post"', 'div class="entry-content"', "main", 'section id="articleBody"'] * 5:
        paragraphs = [cases.text(rng, "de", rng.randrange(1, 5)) for _ in range(rng.randrange(2, 7))]
        pages.append(page("<h1>Another headline</h1>" + "".join(f"<p>{p}</p>" for p in paragraphs), root))
        wanted.append(" ".join(["Another headline", *paragraphs]))
    table = spark.createDataFrame(list(enumerate(pages)) + [(98, None), (99, ""), (97, "<script>x</script>")], "page_id long, html string")
    rows = {r["page_id"]: r["found"] for r in table.select("page_id", html_blocks.extract_text(block_model, F.col("html")).alias("found")).collect()}
    assert [rows[i]["text"] for i in (97, 98, 99)] == ["", "", ""]
    assert sum(rows[i]["text"] == w for i, w in enumerate(wanted)) >= 18


def test_gradients_of_the_block_labeller():
    rng = np.random.default_rng(2)
    model = html_blocks.Model.new(3)
    model.weights = {k: v.astype(np.float64) for k, v in model.weights.items()}
    paths, words = html_blocks._Buckets(html_blocks.PATHS), html_blocks._Buckets(html_blocks.WORDS)
    blocks = [[html_blocks.Leaf(("p", f".{i}"), f"word{i} other{j}") for i in range(n)] for j, n in enumerate((4, 2))]
    sequences = [html_blocks.Sequence(b, paths, words) for b in blocks]
    labels, counted = np.array([[1, 0], [0, 1], [1, 0], [0, 0]], float), np.array([[1, 1], [1, 1], [1, 0], [0, 0]], float)

    def loss():
        p = model.score(sequences)
        return -(counted * (labels * np.log(p) + (1 - labels) * np.log(1 - p))).sum() / counted.sum()

    grads = model.gradients(sequences, labels, counted)
    for name, g in grads.items():
        flat = np.argsort(-np.abs(g).ravel())[:20]
        at = np.unravel_index(rng.choice(flat), g.shape)
        old, step = model.weights[name][at], 1e-3
        model.weights[name][at] = old + step
        up = loss()
        model.weights[name][at] = old - step
        down = loss()
        model.weights[name][at] = old
        assert (up - down) / (2 * step) == pytest.approx(g[at], rel=0.05, abs=1e-4), name


def test_without_known_content_nothing_is_content():
    model = html_blocks.train([])
    assert all((s < 0.5).all() for s in html_blocks.label(model, [html_blocks.leaves(page("<p>x y z"))]))


def test_long_pages_are_labelled_whole(block_model):
    blocks = html_blocks.leaves(page("".join(f"<p>Paragraph number {i} is a sentence of the article here, with words.</p>" for i in range(3000))))
    scores = html_blocks.label(block_model, [blocks])[0]
    assert len(scores) == len(blocks) > 3000 and sum(s >= 0.5 for s in scores) >= 2990
