import time
import glob
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from sectionweave.llm import html_blocks, quality_model, quotes

SF_DIR = "/root/testdata/sf0.01"


@pytest.mark.parametrize("html, text", [
    ("", ""), ("plain words only", ""), ("<article>One &amp; two&nbsp;\n three<br>four</article>", "One & two three four"),
    ("<article><h1>T</h1><p><b>a<br><p>b</article><footer>f</footer>", "T\na\nb"),
    ("<nav>n</nav><article><p>a</p><aside>s</aside><div class='user-comments'><p>c</p></div><form>f</form><p>b<script>x='</p>'</script></p></article>", "a\nb"),
    ("<body class='has-sidebar'><main><p>a</p><section id=comments><article class=comment><p>c</p></article></section></main>", "a"),
    ("<article><p>a<!-- <p>x</p> -->b</p><style>p{}</style><template><p>t</p></template></article>", "ab"),
    ("<article><ul><li>x<li><a href='/y'>y</a></ul><table><tr><td>1<td>2</table></article>", "x\ny\n1\n2"),
    ("<article><p>a < b &lt;p&gt; &#233;&#x41;</p></div></span><p hidden>h</p>", "a < b <p> éA"),
    ("<header>site</header><article><header><h1>Title</h1></header><p>x</p><footer>by</footer></article>", "Title\nx"),
    ("<div role=navigation>n</div><div role=main><p>x</p></div><div class='cookieBanner'>c</div>", "x"),
    ("<article><p title='a > b'>x</p><p class=\"unclosed>y</p></article>", "x\ny"),
])
def test_main_text(html, text):
    assert html_blocks.main_text(html) == text


def test_pages_without_an_article_go_by_words_and_links():
    long = "many plain words in a paragraph that goes on and on about one thing and then about another thing until it ends at last"
    page = f"<ul><li><a href=/>Home</a><li><a href=/>News</a></ul><div><p>{long}</p><p>{long} again</p></div><div>All rights</div>"
    assert html_blocks.main_text(page) == f"{long}\n{long} again"


def test_pages_table(spark):
    pages = spark.createDataFrame([(1, "u", None, "x"), (2, None, "<article>é\U0001f600</article>", "x"), (2, None, "<article>é\U0001f600</article>", "x"), (None, "v", "<p>", "x")],
                                  "page_id long, url string, html string, text string")
    got = html_blocks.page_texts(pages).collect()
    assert Counter(map(tuple, got)) == Counter([(1, "u", "", 0), (2, None, "é\U0001f600", 2), (2, None, "é\U0001f600", 2), (None, "v", "", 0)])
    assert html_blocks.page_texts(pages.limit(0)).count() == 0


def test_features_of_slices_are_those_of_the_whole(monkeypatch):
    text = "The the  cat\ncat é sat, " * 40
    whole = quality_model.bag(text)
    monkeypatch.setattr(quality_model, "SLICE", 10)
    cut = quality_model.bag(text)
    assert (whole[0] == cut[0]).all() and (whole[1] == cut[1]).all()
    assert len(quality_model.bag("")[0]) == len(quality_model.bag(" \n")[0]) == 0


def test_held_out_accuracy(spark):
    if not os.path.isdir(SF_DIR):
        pytest.skip("no test tables")
    docs, labels = (spark.read.parquet(f"{SF_DIR}/{t}.parquet") for t in ("documents", "labels"))
    got = quality_model.quality_scores(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in got) / len(got) > 0.93
    good, bad = [r.score for r in got if r.quality], [r.score for r in got if not r.quality]
    assert sum(g > b for g in good for b in bad) / (len(good) * len(bad)) > 0.95


def test_classifier_edges(spark, documents, no_documents):
    labels = spark.createDataFrame([(i * 3, i % 2) for i in range(40)] + [(0, 0), (0, 1), (None, 1), (3, None), (6, 7)], "doc_id long, quality long")
    got = quality_model.quality_scores(documents, labels)
    rows = got.collect()
    assert len(rows) == documents.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    again = quality_model.quality_scores(documents.repartition(2), labels.repartition(3)).collect()
    assert Counter(map(tuple, rows)) == Counter(map(tuple, again))
    assert quality_model.quality_scores(no_documents, labels).count() == 0
    assert {r.score for r in quality_model.quality_scores(documents, labels.limit(0)).collect()} == {0.5}
    other = labels.withColumn("quality", F.when(quality_model.remainder(F.col("doc_id")) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert Counter(map(tuple, rows)) == Counter(map(tuple, quality_model.quality_scores(documents, other).collect()))


CONVERSATION = [
    (1, 0, "user", "Hello there.\n\nHow do I sort a list?"),
    (1, 1, "assistant", "> How do I sort a list?\nUse sorted.\nIt returns a new list."),
    (1, 2, "user", "Another question"),
    (1, 3, "user", "On Monday Bob wrote:\n> use   SORTED.\n> It returns a new list.\n>> How do I sort a list?\nThanks!"),
    (1, 4, "assistant", "> no such text\nWhat?"),
    (1, 5, "user", "> Another\n> question\nYes"),
    (1, 6, "user", "> Thanks!\n\nWelcome"),
    (2, 0, "user", "How do I sort a list?"), (2, 1, "user", None), (2, 2, "user", ""), (2, 3, None, ">\n> \nx"), (2, 3, None, ">\n> \nx"),
    (None, 0, "user", "> Hello there."), (3, None, "user", "> x\ny"), (3, 5, "user", "y"),
]


def test_quotes_link_and_order(spark):
    df = spark.createDataFrame(CONVERSATION, "conv_id long, turn long, role string, text string").withColumn("path", F.lit(1)).repartition(3)
    rows = quotes.reply_ordered(df).collect()
    assert len(rows) == len(CONVERSATION)
    one = {r.turn: r for r in rows if r.conv_id == 1}
    assert {t: r.reply_to for t, r in one.items()} == {0: None, 1: 0, 2: None, 3: 1, 4: None, 5: 2, 6: 3}
    assert {t: r.depth for t, r in one.items()} == {0: 0, 1: 1, 2: 0, 3: 2, 4: 0, 5: 1, 6: 3}
    assert sorted(one, key=lambda t: one[t].position) == [0, 1, 3, 6, 2, 5, 4]
    assert (one[3].text, one[3].max_level, one[3].n_quoted) == ("Thanks!", 2, 3)
    assert one[1].text == "Use sorted.\nIt returns a new list." and one[6].text == "Welcome" and one[0].text.startswith("Hello")
    assert sorted((r.turn, r.position, r.text) for r in rows if r.conv_id == 2) == [(0, 0, "How do I sort a list?"), (1, 1, ""), (2, 2, ""), (3, 3, "x"), (3, 3, "x")]
    assert all(r.reply_to is None for r in rows if r.conv_id in (None, 3))
    assert quotes.reply_ordered(df.limit(0)).count() == 0


def test_long_reply_chains(spark):
    chain = [(1, i, "user", (f"> say {i - 1}\n" if i else "") + f"say {i}") for i in range(60)]
    rows = {r.turn: r for r in quotes.reply_ordered(spark.createDataFrame(chain, "conv_id long, turn long, role string, text string")).collect()}
    assert {t: (r.depth, r.position) for t, r in rows.items()} == {i: (i, i) for i in range(60)}


def test_passages_are_runs_of_one_level(spark):
    text = "> a\n> b\n>> c\nplain\n>> d\n> e\n\n> f"
    df = spark.createDataFrame([(1, 0, "user", text), (1, 1, "user", "none"), (1, 2, "user", ">\n" * 3000 + "x")], "conv_id long, turn long, role string, text string")
    got = {r.turn: [(p.level, p.lines) for p in r.passages] for r in quotes.parsed(df).collect()}
    assert got[0] == [(1, ["a", "b"]), (2, ["c"]), (2, ["d"]), (1, ["e"]), (1, ["f"])] and got[1] == []
    assert [(level, len(lines)) for level, lines in got[2]] == [(1, 3000)]


def test_order_over_many_ranges(spark):
    """One conversation, wide threads and repeated turns, cut into more ranges than one."""
    rng = random.Random(8)
    rows = [(1, 0, "user", "start")] + [(1, i, "user", f"> {'start' if i % 3 else 'line 1'}\nline {i}") for i in range(1, 300)] + [(1, 7, "user", "line 7")] * 2
    rows += [(2, i, "user", (f"> line {rng.randrange(max(0, i - 5), i)}\n" if i and i % 40 else "") + f"line {i}") for i in range(200)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    coalesce = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = quotes.reply_ordered(df).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
    assert len(got) == len(rows)
    for conv in (1, 2):
        mine = [r for r in got if r.conv_id == conv]
        parent = {r.turn: r.reply_to for r in mine}

        def path(turn):
            return [turn] if parent[turn] is None else [*path(parent[turn]), turn]  # noqa: B023

        paths = [path(r.turn) for r in mine]
        assert [r.position for r in mine] == [sum(other < own for other in paths) for own in paths]
        assert [r.depth for r in mine] == [len(own) - 1 for own in paths] and max(map(len, paths)) > (2 if conv == 1 else 8)


def test_deeper_levels_and_quoted_paragraphs_link(spark):
    rows = [(1, 0, "user", "first words\n\nsecond part\ngoes on\n\nthird"), (1, 1, "user", "other"), (1, 2, "user", ">> first words\nyes"),
            (1, 3, "user", "> edited\n>> other\nno"), (1, 4, "user", "> second\n> part goes on\n>\n> third part\nhm"), (1, 5, "user", "> other\n>> first words\nok")]
    got = quotes.reply_ordered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {r.turn: r.reply_to for r in got} == {0: None, 1: None, 2: 0, 3: 1, 4: 0, 5: 1}


@pytest.mark.parametrize("advert", ["Buy now", "Buy this wonderful thing today and tell all of your friends about it at once"])
@pytest.mark.parametrize("words", [1, 2, 5, 10, 20, 23, 24, 25, 26, 27, 28, 29, 30, 31, 40, 60, 100])
def test_adverts_beside_paragraphs_of_any_length(advert, words):
    paragraph = " ".join(["word"] * words)
    page = f"<div class=ad>{advert}</div><article><p>{paragraph}</p></article><div>{advert}</div><footer>{advert}</footer>"
    assert html_blocks.main_text(page) == paragraph


def test_pages_without_an_article_need_words_and_densities():
    """A block of links is as long as a paragraph: with blanked densities it would be main text, and with blanked words nothing."""
    paragraph, links = " ".join(["word"] * 40), " ".join(["<a href=#>word</a>"] * 40)
    page = f"<div>{links}</div><div><p>{paragraph}</p><p>{paragraph}</p></div><div>{links}</div>"
    blocks = html_blocks.blocks_of(page)
    rows = html_blocks.features(blocks)
    assert [b.density for b in blocks] == [1.0, 0.0, 0.0, 1.0]
    assert [html_blocks.is_main(r) for r in rows.tolist()] == [False, True, True, False]
    for kind, expected in (("density", [True] * 4), ("words", [False] * 4)):
        blank = rows.copy()
        blank[:, [i for i, f in enumerate(html_blocks.FEATURES) if f.startswith(kind)]] = 0
        assert [html_blocks.is_main(r) for r in blank.tolist()] == expected


def test_links_alone_are_no_text():
    assert html_blocks.main_text("<ul>" + "<li><a href=#>A link to elsewhere</a>" * 12 + "</ul>") == ""


def test_names_inside_an_article():
    page = ("<article><p>where <math><mi>x</mi>=1</math> holds</p><div class='social-history'>Past</div><section id='legal'>Law</section>"
            "<h2 id='search'>Search</h2><div class='cookie-notice'>no</div><section id=comments>no</section><div class='related-links'>no</div></article>")
    assert html_blocks.main_text(page) == "where x=1 holds\nPast\nLaw\nSearch"


@pytest.mark.parametrize("page", ["<a " * 300_000, '<a b="' * 200_000, "<div>" * 20_000 + "</p>" * 20_000, "<!--" * 200_000, "<div " * 100_000 + ">x",
                                  "<p>a</p>" + "<" * 500_000, "<article>" * 20_000 + "x" + "</div>" * 20_000])
def test_malformed_pages_take_linear_time(page):
    begin = time.perf_counter()
    html_blocks.main_text(page)
    assert time.perf_counter() - begin < 5
