import random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import brute
from sectionweave.functions import lcs, sections
from sectionweave.functions.text import normalize
from sectionweave.operators import align
from sectionweave.plans import prepare
from sectionweave.schemas import ARTICLE

WORDS = "the cells were treated with running water flies and agreed national results 3 of s".split()


def sentence(rng, low=1, high=12):
    return " ".join(rng.choice(WORDS) for _ in range(rng.randint(low, high)))


def random_article(rng, article_id):
    sections = [[sentence(rng) for _ in range(rng.randint(0, 9))] for _ in range(rng.randint(1, 5))]
    headers = ["Introduction", "Related work", "METHODS", "Appendix", "Limitations", "Conclusions"]
    names = [rng.choice(headers) for _ in range(max(0, len(sections) + rng.randint(-1, 1)))]
    return {"article_id": article_id, "section_names": names, "sections": sections,
            "abstract_text": [f"<S> {sentence(rng)} </S>" for _ in range(rng.randint(0, 6))]}


def frame(spark, articles):
    return spark.createDataFrame([tuple(a[f] for f in ARTICLE.names) for a in articles], ARTICLE)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    return [random_article(rng, str(i)) for i in range(40)]


TOKEN_LISTS = st.lists(st.sampled_from("abcd"), max_size=14)


@settings(max_examples=200, deadline=None)
@given(TOKEN_LISTS, TOKEN_LISTS)
def test_bit_vectors_give_the_lcs(a, b):
    assert lcs.lcs_size(a, b) == brute.lcs(a, b)
    assert lcs.lcs_positions(a, b) == brute.walk(a, b)


@settings(max_examples=100, deadline=None)
@given(st.lists(TOKEN_LISTS, min_size=1, max_size=4), st.lists(st.lists(TOKEN_LISTS, max_size=3), max_size=3))
def test_many_sentences_at_once(abstract, sections):
    lines = "".join(" ".join(s) + "\n" for s in abstract)
    pages = "".join("".join(" ".join(s) + "\n" for s in section) + "\f" for section in sections)
    assert lcs.best_per_section(lines, pages) == [
        [max([brute.lcs(a, s) for s in section], default=0) for a in abstract] for section in sections]


@settings(max_examples=100, deadline=None)
@given(st.lists(TOKEN_LISTS, min_size=1, max_size=4), st.lists(TOKEN_LISTS, min_size=1, max_size=4))
def test_union_lcs(ref, cand):
    ref, cand = ("\n".join(" ".join(s) for s in x) for x in (ref, cand))
    assert lcs.summary_hits(ref, cand) == brute.union_hits(ref, cand)


@pytest.mark.parametrize("stem", [False, True])
def test_scores_against_brute_force(spark, corpus, stem):
    rows = align.sentence_section_scores(frame(spark, corpus), use_stemmer=stem).collect()
    got = {(r.article_id, r.section_idx): r.summary_scores for r in rows}
    for a in corpus:
        sections = a["sections"] + [None] * (len(a["section_names"]) - len(a["sections"]))
        for k, expected in enumerate(brute.recall_table(a["abstract_text"], sections, stem)):
            assert got.pop((a["article_id"], k)) == pytest.approx(expected, abs=1e-6)
    assert not got


@pytest.mark.parametrize("stem", [False, True])
@pytest.mark.parametrize("train", [False, True])
def test_prepare_against_brute_force(spark, corpus, train, stem):
    limits = {"min_document": 20, "min_summary": 8}
    rows = prepare.prepare_section_rows(frame(spark, corpus), train=train, use_stemmer=stem, **limits)
    expected = [r for a in corpus if a["abstract_text"] for r in brute.prepare(a, train, stem, **limits)]
    assert expected
    assert sorted(map(tuple, rows.collect())) == sorted(expected)


def test_every_sentence_has_one_section_whatever_the_partitions(spark, corpus):
    one = align.best_section(frame(spark, corpus).repartition(1)).collect()
    many = align.best_section(frame(spark, corpus[::-1]).repartition(7)).collect()
    assert sorted(one) == sorted(many)
    assert len(one) == sum(len(a["abstract_text"]) for a in corpus)
    regrouped = align.collect_section_summary(align.best_section(frame(spark, corpus)))
    assert regrouped.select(F.sum(F.size("section_summary"))).first()[0] == len(one)


def test_edge_cases(spark):
    def article(i, abstract, names, sections):
        return {"article_id": i, "abstract_text": abstract, "section_names": names, "sections": sections}

    articles = [
        article("no overlap", ["q q"], ["A", "B"], [["x"], ["y"]]),
        article("tie", ["x y"], ["A", "B"], [["x"], ["y"]]),
        article("empty first section", ["q"], ["A", "B"], [[], ["z"]]),
        article("later is better", ["x y"], ["A", "B"], [["x"], ["x y"]]),
        article("no tokens", ["...", "<S> </S>"], ["A"], [["x"]]),
        article("more names", ["x"], ["A", "B"], [["x"]]),
        article("more texts", ["y"], ["A"], [["x"], ["y"]]),
        article("null sentence", ["x", None], ["A", "B"], [["y"], [None, "x"]]),
        article("no abstract", [], ["A"], [["x"]]),
        article("null abstract", None, ["A"], [["x"]]),
        article("no sections", ["x"], [], []),
    ]
    rows = align.best_section(frame(spark, articles)).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.article_id, r.sent_idx)):
        got.setdefault(r.article_id, []).append((r.section_idx, round(r.score, 4)))
    assert got == {
        "no overlap": [(0, 0.0)], "tie": [(0, 0.5)], "empty first section": [(0, 0.0)], "later is better": [(1, 1.0)],
        "no tokens": [(0, 0.0), (0, 0.0)], "more names": [(0, 1.0)], "more texts": [(1, 1.0)],
        "null sentence": [(1, 1.0), (0, 0.0)]}


def test_length_rules_are_strict(spark):
    def article(i, words, summary_words):
        # A marked sentence of n words counts n + 2 pieces.
        return {"article_id": i, "abstract_text": ["<S> " + " ".join(["w"] * (summary_words - 2)) + " </S>"],
                "section_names": ["Methods"], "sections": [[" ".join(["w"] * words)]]}

    df = frame(spark, [article("50/51", 50, 51), article("51/50", 51, 50), article("51/51", 51, 51)])

    def kept(train):
        return sorted(r.article_id for r in prepare.prepare_section_rows(df, train=train).collect())

    assert kept(False) == ["51/50", "51/51"]
    assert kept(True) == ["51/51"]
    split = df.withColumn("split", F.when(F.col("article_id") == "51/50", "val").otherwise("train"))
    assert sorted(r.article_id for r in prepare.prepare_section_rows(split).collect()) == ["51/50", "51/51"]


def test_dropped_types_take_their_sentences_along(spark):
    a = {"article_id": "1", "abstract_text": ["x x", "y y"], "section_names": ["Limitations", "Methods"],
         "sections": [["x x"], ["y y"]]}
    rows = prepare.prepare_section_rows(frame(spark, [a]), train=False, min_document=0).collect()
    assert [(r.section_id, r.summary) for r in rows] == [("m", "y y")]


@pytest.mark.parametrize("broadcast_limit", [None, 0])
def test_rows_of_one_article_pool_their_sections(spark, monkeypatch, broadcast_limit):
    if broadcast_limit is not None:  # Shuffle joins instead of broadcasts.
        monkeypatch.setattr(prepare, "broadcast_if_small", lambda keys: keys)
    abstract = ["x y z", "p q r", "n o"]
    parts = [[["x y"], ["p q r"]], [["x y z"], ["p q"]], [["x y z"], ["p q"]]]
    rows = [{"article_id": "hot", "abstract_text": abstract, "section_names": ["Methods", "Results"], "sections": s}
            for s in parts]
    other = {"article_id": None, "abstract_text": ["x"], "section_names": ["Methods"], "sections": [["x"]]}
    alone = {"article_id": "alone", "abstract_text": abstract, "section_names": ["Methods"], "sections": [["p"]]}
    df = frame(spark, rows * 3 + [alone, other, other])
    got = prepare.prepare_section_rows(df, train=False, min_document=0).collect()
    found = sorted((str(r.article_id), r.document, r.summary) for r in got)
    hot = [f for f in found if f[0] == "hot"]
    # Zero-overlap "n o" goes to the first section of the first row in digest order.
    assert ("hot", "p q r", "p q r") in [(a, d, s.replace(" n o", "")) for a, d, s in hot]
    assert [s.replace(" n o", "") for _, d, s in hot if d == "x y z"] == ["x y z"]
    assert sum("n o" in s for _, _, s in hot) == 1
    assert [f for f in found if f[0] != "hot"] == [("None", "x", "x"), ("alone", "p", "x y z p q r n o")]


@pytest.mark.parametrize("partitions", [1, 3])
@pytest.mark.parametrize("order", [(0, 1, 2), (1, 0, 2), (2, 1, 0)])
def test_rows_that_differ_in_line_breaks_or_nulls_only_are_all_used(spark, order, partitions):
    sections = [[["x y z"]], [["x y", "z"]], [["x", None, "y z"]]]
    rows = [{"article_id": "1", "abstract_text": ["x y z"], "section_names": ["Methods"], "sections": s} for s in sections]
    df = frame(spark, [rows[i] for i in order]).repartition(partitions)
    got = prepare.prepare_section_rows(df, train=False, min_document=0).collect()
    assert [(r.document, r.summary) for r in got] == [("x y z", "x y z")]
    abstracts = [["a", "b"], ["a\nb"], ["a", None, "b"], ["a", "", "b"]]
    apart = [{"article_id": "1", "abstract_text": a, "section_names": ["Methods"], "sections": [["a b"]]} for a in abstracts]
    assert frame(spark, apart).select(prepare._group_key()).distinct().count() == len(apart)


def test_articles_of_one_id_stay_apart(spark):
    rows = [{"article_id": "1", "abstract_text": [a], "section_names": ["Methods", "Results"], "sections": [[a], ["q"]]} for a in ("x y", "z")]
    df = frame(spark, rows)
    regrouped = align.regroup_articles(align.explode_sections(df)).collect()
    assert sorted([s.section_idx for s in r.full_text_sections] for r in regrouped) == [[0, 1], [0, 1]]
    assert sorted(r.section_summary for r in align.collect_section_summary(align.best_section(df)).collect()) == [["x y"], ["z"]]


@settings(max_examples=300, deadline=None)
@given(st.lists(TOKEN_LISTS, min_size=1, max_size=4), st.lists(st.lists(TOKEN_LISTS, max_size=6), max_size=4), st.sampled_from([1, 2, 512]))
def test_bounds_never_change_the_best_section(abstract, sections, block):
    lines = "".join(" ".join(s) + "\n" for s in abstract)
    pages = "".join("".join(" ".join(s) + "\n" for s in section) + "\f" for section in sections)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(lcs, "BLOCK", block)
        patch.setattr(lcs, "SHORT", 5)
        found, hits, n_pairs, n_compared = lcs.best_sections(lines, pages)
    table = [[max([brute.lcs(a, s) for s in section], default=0) for section in sections] for a in abstract]
    assert (found, hits) == ([row.index(max(row)) for row in table if row], [max(row) for row in table if row])
    assert n_compared <= n_pairs == (len(abstract) * sum(map(len, sections)))


def test_lanes_of_long_sentences():
    words = ["a", "b", "c"]
    long = " ".join(words[i % 3] for i in range(900))
    lines, pages = f"{long}\na b\n", f"c c\n\f{long[:1000]}\n{long}\n\fa b\n\f"
    assert lcs.best_sections(lines, pages)[:2] == ([1, 1], [900, 2])


@pytest.mark.parametrize("stem", [False, True])
@pytest.mark.parametrize("limit", [-1, 100, 10**9])
def test_large_articles_dealt_to_many_tasks(spark, corpus, monkeypatch, stem, limit):
    monkeypatch.setattr(align, "RANGE", 2)
    monkeypatch.setattr(align, "SHARE", 1)
    odd = [dict(article_id=f"odd{i}", abstract_text=a, section_names=["Methods", "Results"], sections=s) for i, (a, s) in enumerate([
        ([], [["x y"]]), (["x y", None, "zz"], [[], None, ["q", "y x y"]]), (["zz"], [[], ["q"]]), (["x"], []), (None, [["x"]]), (["x"], None)])]
    df = frame(spark, corpus + odd + corpus[:3])

    def rows(**options):
        return sorted(map(tuple, align.best_section(df, use_stemmer=stem, **options).collect()), key=repr)

    assert rows(large_bytes=limit) == rows()


def test_a_planted_large_article_is_spread(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(300)]
    sections = [[" ".join(rng.choices(words, k=12)) for _ in range(3000)] for _ in range(4)]
    abstract = [rng.choice(rng.choice(sections)) for _ in range(600)]
    df = frame(spark, [dict(article_id="1", abstract_text=abstract, section_names=["a", "b", "c", "d"], sections=sections)])
    zipped = df.withColumn("zipped", align.zip_sections(df.section_names, df.sections))
    apart = align._matched_apart(zipped, False, False)
    assert apart.select("best").first() == align._matched_here(zipped, False, False).select("best").first()
    assert "REPARTITION_BY_NUM" in apart._jdf.queryExecution().toString()


def test_repeated_ids_with_unlike_abstracts_need_no_pooling(spark, corpus):
    twins = [dict(a, article_id="same" if i % 2 else None) for i, a in enumerate(corpus[:8])]
    found = prepare.aligned_sections(frame(spark, twins), use_stemmer=False)
    assert sorted(map(repr, found.collect())) == sorted(map(repr, align.matched_sections(frame(spark, twins), use_stemmer=False).collect()))


def test_one_sequence_has_the_length_of_the_table():
    rng = random.Random(5)
    for _ in range(300):
        left, right = (rng.choices("abcde", k=rng.randrange(0, 90)) for _ in range(2))
        masks, valid = lcs._masks(left)
        assert lcs._longest(masks, valid, right) == lcs.lcs_size(left, right)


def test_an_abstract_is_normalized_once(spark):
    article = spark.createDataFrame([("1", ["Cold rain <S>fell</S>.", None, ""], ["Introduction", "Results"], [["cold rain"], ["fell"]])],
                                    "article_id string, abstract_text array<string>, section_names array<string>, sections array<array<string>>")
    matched = align.with_matches(article, use_stemmer=False)
    assert [m.score for m in matched.first().matched] == [0.4000000059604645, 0.0, 0.0]
    plan = matched._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 2  # one for the abstract, one for the sections


def test_sentences_are_read_as_they_are_normalized(spark):
    """Every code point between letters: the table of bytes parts tokens as the expression does."""
    texts = [f"Ab{chr(c)}Cd" for c in range(0x110000) if not 0xd800 <= c < 0xe000]
    df = spark.createDataFrame([(texts[i:i + 5000],) for i in range(0, len(texts), 5000)], "texts array<string>")
    read = df.select(F.flatten(F.transform(sections._sentences(F.col("texts")), lambda s: F.array(s))).alias("read"),
                     F.transform("texts", normalize).alias("meant"))
    for row in read.toLocalIterator():
        assert [" ".join(s.split()) for s in lcs.scored_texts(pa.array(row.read))] == row.meant


def test_arrays_with_nulls_are_read_row_by_row():
    abstract = pa.array([["A, b"], None, [], ["q", None], ["x"]], pa.list_(pa.string()))
    sections_ = pa.array([[["b"], None, ["a B!", None]], [["b"]], [["b"]], [], None], pa.list_(pa.list_(pa.string())))
    whole = [([{"section_idx": 2, "hits": 2, "n_tokens": 2}], 3, 2), (None, None, None), ([], 0, 0), ([], 0, 0), (None, None, None)]
    for cut in (0, 2):  # a slice keeps the buffers of the whole
        found = lcs._matches(abstract.slice(cut), sections_.slice(cut), str.split).to_pylist()
        assert [(f["best"], f["pairs"], f["compared"]) for f in found][-2:] == whole[-2:]
        assert [f["best"] for f in found] == [w[0] for w in whole[cut:]]


def test_contained_and_short_sentences_need_no_table(monkeypatch):
    monkeypatch.setattr(lcs, "_longest", None)
    assert lcs.best_sections("a b c a a a\n", "b c\na\na b\n\fa a a\nx\n\f")[:2] == ([1], [3])


def test_equal_articles_are_dealt_once_in_parts_of_all_sections(spark):
    article = dict(article_id="1", abstract_text=["x y"] * 3, section_names=list("abcdef"), sections=[["x"], ["y", "x y"], [], ["z"], ["q"], ["x"]])
    df = frame(spark, [dict(article, article_id=str(i)) for i in range(4)])
    keyed = df.select(F.lit("k").alias("article_key"), "abstract_text", align.zip_sections(df.section_names, df.sections).alias("zipped"))
    assert align._cells(keyed).count() == 1
    found = align.best_section(df, large_bytes=0).collect()
    assert len(found) == 12 and {(r.section_idx, r.score) for r in found} == {(1, 1.0)}


def test_the_digest_of_dealt_articles_is_no_filter(spark, corpus):
    plan = align.best_section(frame(spark, corpus), large_bytes=0)._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line and "md5" in line]
