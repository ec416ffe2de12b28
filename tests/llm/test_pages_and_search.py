"""HTML extraction, source divergence and ranked search, against SQL on odd rows and by hand."""

import random

import duckdb
import numpy as np
import pytest
from conftest import rows_of

from mediaprism.llm import divergence, html_blocks, html_text, lexical_search, queries

TEXTS = [None, "", " \n\t ", "a", "The same text twice. And more.", "The same text twice. And more.", "Ñandú ß İ 漢字 🙂 x9 9", "la " * 3000, "a_b-c'd A1 a1", "the and the and of"]


def documents(spark, n=260):
    """Rows of one hot source, null and empty names, repeated ids, equal texts, and other columns with the names that the operators use."""
    rng, rows = random.Random(3), []
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    for i in range(n):
        text = TEXTS[i % 37] if i % 37 < len(TEXTS) else " ".join(rng.choices(words, weights=[1 / (k + 1) for k in range(60)], k=rng.randint(1, 40)))
        rows.append((None if i == 5 else i % 250, text, (None, "en", "en", "en", "fr", "")[i % 6], (None, "s0", "s0", "s0", "s1", "é", "z")[i % 7], 1, "c", 2, 3, "d", 4))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, row int, term string, i int, n int, item string, score int")


def by_sql(name, **tables):
    c = duckdb.connect()
    for k, v in tables.items():
        c.register(k, v.toPandas().convert_dtypes())
    return c.execute(queries.SQL[name]).fetchdf()


def same(a, b):
    assert sorted(a.columns) == sorted(b.columns)
    assert rows_of(a.convert_dtypes()) == rows_of(b.convert_dtypes())


# --- 11: pages

LONG = "<p>" + "A sentence of the article that goes on for some words. " * 3 + "</p>"
SAID = ("A sentence of the article that goes on for some words. " * 3).strip()
LAYOUTS = {
    "cut off": (f"<body><header><a href=/>Site</a></header><article><h1>Head line</h1>{LONG}<p>Short.{LONG}", ["Head line", SAID, "Short.", SAID]),
    "names": (
        f"<body class='has-sidebar'><div id='siteHeader'>My site</div><div class='mainNav'><a>Home</a><a>News</a></div><div class='content'><h1>Head line</h1>{LONG}<p>Yes.</p></div><div class=sidebar><h3>More</h3><p>Some text of the side bar, long enough to be read as text.</p></div><div id=comments><p>This is a reader's long comment on the article, which goes on.</p></div><div class='site-footer'>About</div>",
        ["Head line", SAID, "Yes."],
    ),
    "bare": (f"<form id=f><div><a>Home</a> <a>News</a></div><h1>Head line of it</h1>{LONG}<p>Yes.</p>{LONG}<div>&copy; 2024 Someone</div></form>", ["Head line of it", SAID, "Yes.", SAID]),
    "comments in main": (f"<main><h1>T</h1>{LONG}<section class='comments'><article class='comment'><p>I like this very much, it is good to read.</p></article></section></main>", ["T", SAID]),
    "notice": (f"<div class='cookie-consent'>We use cookies to make this site better for all of you.</div><div class='post'>{LONG}<p>x &lt;b&gt; &amp;amp; y&nbsp;\n z</p></div><script>if (a<b) {{ '<p>no</p>' }}</script><div class='newsletter'>Sign up for our letter, it is free.</div>", [SAID, "x <b> &amp; y z"]),
    "form inside": (f"<article>{LONG}<form><p>Your name and your mail address, please.</p></form>{LONG}</article>", [SAID, SAID]),
    "inline": (f"<article><p>on<b>e</b> <!-- no -->t<i>wo</i><br>three</p>{LONG}one<br> <br/>two</article>", ["one two three", SAID, "one", "two"]),
    "quotes": (f"<article title='a > b' data-x=don't><p title=\"<p>\">It is so.</p>{LONG}</article>", ["It is so.", SAID]),
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_layouts(name):
    page, said = LAYOUTS[name]
    found = html_blocks.blocks(page)
    tree = html_text.fit(html_text.labelled_pages())
    assert [b.text for b, keep in zip(found, html_text.kept(tree, html_text.features(found)), strict=True) if keep] == said


def test_tree_tells_its_own_table_apart_and_another_half_of_it():
    pages = html_text.labelled_pages()
    for learnt, judged, least in ((pages, pages, 0.995), (pages[::2], pages[1::2], 0.95)):
        tree, right, n = html_text.fit(learnt), 0, 0
        for page, article in judged:
            found = html_blocks.blocks(page)
            right += int((html_text.kept(tree, html_text.features(found)) == np.array([b.text in article for b in found], bool)).sum())
            n += len(found)
        assert right >= least * n
    with pytest.raises(ValueError):
        html_text.fit(pages, most=10)


def test_odd_pages(spark):
    odd = [None, "", "   ", "no tags at all", "<", "<p", "</p></div>", "<a href=x>" * 500, "<div>" * 3000 + "deep", "<!-- never closed", "<script>never closed", "&#0;&#x110000;&bogus;", "<article><p>" + "word " * 100_000 + "</article>", "<p>same</p>", "<p>same</p>"]
    pages = spark.createDataFrame([(i if i else None, f"u{i}", h, "c", 1) for i, h in enumerate(odd)], "page_id long, url string, html string, text string, _html int")
    got = {r["url"]: r for r in html_text.extract(pages).collect()}
    assert len(got) == len(odd) and all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert got["u0"]["text"] == got["u1"]["text"] == "" and got["u12"]["n_chars"] == 5 * 100_000 - 1 and got["u13"]["text"] == got["u14"]["text"]
    assert html_text.extract(pages.limit(0)).count() == 0


# --- 12: divergence


def test_divergence_of_odd_rows_agrees_with_sql(spark):
    docs = documents(spark)
    same(divergence.source_divergence(docs).toPandas(), by_sql("op12_divergence", documents=docs))
    assert divergence.source_divergence(docs.limit(0)).count() == 0
    nothing_kept = divergence.source_divergence(docs.limit(20)).toPandas()
    assert set(nothing_kept["part"]) == {"pair"} and (nothing_kept["value"] == 0).all()


def test_divergence_in_blocks_and_many_flushes(spark):
    docs = documents(spark)
    same(divergence.source_divergence(docs, held=10, block=2).toPandas(), by_sql("op12_divergence", documents=docs))


# --- 13: search


def items(spark):
    rows = [(1, "waa wba the"), (1, "waa wba the"), (None, "same text"), (3, None), (4, ""), (5, "unheard of words"), (6, "漢字 Ñandú x9"), (7, "waa waa waa"), (8, " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)))]
    return spark.createDataFrame([(*r, 1, "c") for r in rows], "item_id long, text string, row int, term string")


@pytest.mark.parametrize("how", [{}, {"block": 7}, {"most_terms": 0}, {"head": 1}])
def test_search_of_odd_rows_agrees_with_sql(spark, how):
    docs, asked = documents(spark), items(spark)
    got = lexical_search.search(docs, asked, **how).toPandas()
    want = by_sql("op13_search", documents=docs, benchmark=asked)
    same(got, want)


def test_search_of_empty_tables(spark):
    docs, asked = documents(spark, 40), items(spark)
    assert lexical_search.search(docs.limit(0), asked).count() == 0
    assert lexical_search.search(docs, asked.limit(0)).count() == 0


def test_level_is_reached_by_the_lists():
    rng = random.Random(1)
    for _ in range(200):
        tops = np.array([rng.randint(1, 50) for _ in range(rng.randint(1, 9))])
        t = rng.randint(0, int(tops.sum()))
        level, reach = lexical_search._level(t, tops)
        assert reach == np.minimum(tops, level).sum() <= t and np.minimum(tops, level + 1).sum() >= min(t, tops.sum())


# --- 6: a phrase of many items


def test_a_phrase_that_many_items_share_is_one_mark(spark):
    from mediaprism.llm import decontamination

    phrase = " ".join(f"word{k}" for k in range(13))
    items = spark.createDataFrame([(i, phrase) for i in range(500)], "item_id long, text string")
    marks = decontamination.item_fingerprints(items, 13, "item_id", "text").collect()
    assert len(marks) == 1 and sorted(marks[0]["items"]) == list(range(500))
    docs = spark.createDataFrame([(1, f"x {phrase} y"), (2, "word0 word1")], "doc_id long, text string")
    for how in ({}, {"broadcast_rows": 0}):
        got = {r["doc_id"]: r for r in decontamination.decontamination_report(docs, items, **how).collect()}
        assert (got[1]["n_hit"], got[1]["n_items"], got[2]["n_hit"], got[2]["n_items"]) == (13, 500, 0, 0)
