"""Which section does each abstract sentence come from?

An article is one row, so its sections and its abstract are already in the same
task: the whole comparison is a projection, without a join or a shuffle. Only articles
above a stated size, if one is given, are dealt out in parts and put together again.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.lcs import MATCH
from ..functions.sections import (
    abstract_lines, identify_section, recall_table, scored_matches, section_best, section_hits, sentence_sizes, zip_sections,
)
from ..functions.text import let, no_strings, spelt_list

# An article is its id and its abstract; the digest stands for the abstract wherever rows are grouped.
ABSTRACT_KEY = "abstract_key"
# Sentences of a large article's sections and abstract that are compared in one row.
RANGE, SHARE = 2000, 500


def abstract_key() -> Column:
    return F.md5(spelt_list(F.col("abstract_text"))).alias(ABSTRACT_KEY)


def explode_sections(articles: DataFrame) -> DataFrame:
    """One row per section with its header, sentences and position, and the key of its article's abstract."""
    return articles.select(
        "article_id", abstract_key(), F.inline_outer(zip_sections(F.col("section_names"), F.col("sections")))
    ).where(F.col("section_idx").isNotNull()).select("article_id", ABSTRACT_KEY, "section_idx", "section_head", "section_text")


def section_types(articles: DataFrame) -> DataFrame:
    """Sections with the type their header names."""
    return explode_sections(articles).withColumn("section_id", identify_section(F.col("section_head")))


def with_scores(articles: DataFrame, use_stemmer: bool = True, strip_markers_first: bool = False) -> DataFrame:
    """Add ``zipped`` sections and ``summary_scores``: recall per section and abstract sentence."""
    lines = F.col("abstract_lines")
    return (
        articles.withColumn("zipped", zip_sections(F.col("section_names"), F.col("sections")))
        .withColumn("abstract_lines", abstract_lines(F.col("abstract_text"), strip_markers_first))
        .withColumn("hits", section_hits(lines, F.col("zipped"), use_stemmer))
        .withColumn("summary_scores", recall_table(F.col("hits"), sentence_sizes(lines)))
        .drop("hits", "abstract_lines")
    )


def sentence_section_scores(articles: DataFrame, use_stemmer: bool = True,
                            strip_markers_first: bool = False) -> DataFrame:
    """Per section, an array with the best recall of each abstract sentence."""
    return with_scores(articles, use_stemmer, strip_markers_first).select(
        "article_id", F.posexplode_outer("summary_scores").alias("section_idx", "summary_scores"),
    ).where(F.col("section_idx").isNotNull())


def _matched_here(articles: DataFrame, use_stemmer: bool, strip_markers_first: bool) -> DataFrame:
    return articles.withColumn("best", section_best(F.col("abstract_text"), F.col("zipped.section_text"), use_stemmer, strip_markers_first)["best"])


def _slices(items: Column, size: int) -> Column:
    """An array in runs of ``size``: structs of the position of the first and the run."""
    starts = F.when(F.size(items) > 0, F.sequence(F.lit(0), F.size(items) - 1, F.lit(size))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda at: F.struct(at.alias("at"), F.slice(items, at + 1, size).alias("run")))


def _cells(keyed: DataFrame) -> DataFrame:
    """One row per part of the sections and part of the abstract, dealt out by a number of partitions; equal articles have theirs once."""
    told = F.flatten(F.transform("zipped", lambda z: F.transform(
        F.coalesce(z["section_text"], no_strings()), lambda s: F.struct(z["section_idx"].alias("section_idx"), s.alias("sentence")))))
    parts = keyed.select("article_key", "abstract_text", F.explode_outer(let(told, lambda t: _slices(t, RANGE))).alias("part")).where("part IS NOT NULL")
    cells = (parts.select("article_key", "part", F.explode_outer(_slices(F.col("abstract_text"), SHARE)).alias("own")).where("own IS NOT NULL")
             .select("article_key", F.col("part.at").alias("at"), F.col("own.at").alias("from"), F.col("part.run").alias("run"), F.col("own.run").alias("own")))
    n_parts = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cell = ["article_key", "at", "from"]
    return cells.repartition(n_parts, *cell).dropDuplicates(cell)


def _matched_apart(articles: DataFrame, use_stemmer: bool, strip_markers_first: bool) -> DataFrame:
    """The same for articles that are too large for a task: runs of the sentences of all sections meet runs of the abstract in many tasks.

    A digest stands for sections and abstract together; equal ones have equal matches, and are compared once. Each part gives the longest LCS
    for its sentences, and the maximum over the parts decides, the first section where they are equal.
    """
    digest = F.md5(F.concat(spelt_list(F.col("abstract_text")), spelt_list(F.col("zipped.section_text"), lambda s: spelt_list(s))))
    # It is never null; said so, the join needs no filter on it, which would compute the articles once more.
    key = F.coalesce(digest, F.lit(""))
    keyed = articles.withColumns({"article_key": key, "n_sections": F.size("zipped")})
    # Each sentence stands for a section of its own: the first that wins tells which section it is from.
    alone = F.transform("run.sentence", lambda s: F.array(s))
    found = _cells(keyed).select("article_key", "from", F.col("run.section_idx").alias("sections"),
                                 section_best(F.col("own"), alone, use_stemmer, strip_markers_first)["best"].alias("best"))
    claims = F.transform("best", lambda b: F.struct(b["hits"], (-F.get("sections", b["section_idx"])).alias("back"), b["n_tokens"]))
    each = found.select("article_key", "from", F.posexplode(claims).alias("place", "claim"))
    longest = F.max("claim")
    merged = each.groupBy("article_key", (F.col("from") + F.col("place")).alias("sent_idx")).agg(longest.alias("m"))
    # Without a common token the first section of all counts, also if it has no sentence.
    section = F.when(F.col("m.hits") > 0, -F.col("m.back")).otherwise(0).alias("section_idx")
    rows = merged.select("article_key", F.struct("sent_idx", section, F.col("m.hits").alias("hits"), F.col("m.n_tokens").alias("n_tokens")).alias("b"))
    best = rows.groupBy("article_key").agg(F.array_sort(F.collect_list("b")).alias("found"))
    nothing = F.struct(*(F.lit(0).alias(name) for name in MATCH.names))
    none = F.transform(F.coalesce("abstract_text", no_strings()), lambda _: nothing)
    known = F.transform("found", lambda b: F.struct(*(b[name].alias(name) for name in MATCH.names)))
    whole = F.when(F.col("n_sections") > 0, F.coalesce(known, none)).otherwise(F.array().cast(T.ArrayType(MATCH)))
    return keyed.join(best, "article_key", "left").withColumn("best", whole).drop("article_key", "n_sections", "found")


def _total(items: Column | str, size: Callable[[Column], Column]) -> Column:
    return F.aggregate(items, F.lit(0).cast("long"), lambda n, item: n + F.coalesce(size(item), F.lit(0)))


def with_matches(articles: DataFrame, use_stemmer: bool = True, strip_markers_first: bool = False,
                 large_bytes: int | None = None) -> DataFrame:
    """Add ``matched``: per abstract sentence the first section with the highest score, and that score.

    Articles whose sections have more than ``large_bytes`` bytes are compared by many tasks each; that reads the
    input twice. Without it every article is compared where it lies.
    """
    zipped = articles.withColumn("zipped", zip_sections(F.col("section_names"), F.col("sections")))
    if large_bytes is None:
        found = _matched_here(zipped, use_stemmer, strip_markers_first)
    else:
        size = F.coalesce(_total("sections", lambda section: _total(section, F.octet_length)), F.lit(0))
        found = _matched_here(zipped.where(size <= large_bytes), use_stemmer, strip_markers_first).unionByName(
            _matched_apart(zipped.where(size > large_bytes), use_stemmer, strip_markers_first))
    return found.withColumn("matched", scored_matches(F.col("best"))).drop("best")


def alignment_work(articles: DataFrame, use_stemmer: bool = True, strip_markers_first: bool = False) -> DataFrame:
    """article_id, ``n_pairs`` of abstract and section sentences, ``n_compared`` of them, of which bounds could not show that they lose."""
    zipped = zip_sections(F.col("section_names"), F.col("sections"))
    work = section_best(F.col("abstract_text"), zipped["section_text"], use_stemmer, strip_markers_first)
    return articles.select("article_id", work.alias("w")).select(
        "article_id", F.coalesce("w.pairs", F.lit(0)).alias("n_pairs"), F.coalesce("w.compared", F.lit(0)).alias("n_compared"))


def best_section(articles: DataFrame, min_score: float | None = None, use_stemmer: bool = True,
                 strip_markers_first: bool = False, large_bytes: int | None = None) -> DataFrame:
    """One row per abstract sentence with its section; ``min_score`` drops weaker matches."""
    aligned = with_matches(articles, use_stemmer, strip_markers_first, large_bytes).select(
        "article_id", abstract_key(),
        F.posexplode_outer(F.arrays_zip(F.col("abstract_text"), F.col("matched"))).alias("sent_idx", "pair"),
    ).where(F.col("pair.matched").isNotNull()).select("article_id", ABSTRACT_KEY, "sent_idx", F.col("pair.abstract_text").alias("sentence"),
             "pair.matched.section_idx", "pair.matched.score")
    return aligned if min_score is None else aligned.where(F.col("score") >= min_score)


def assigned_sections(rows: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Section rows of articles that carry ``assigned``: pairs of sentence and section position.

    ``inline_outer`` keeps the optimizer from computing the exploded array a
    second time just to test that it is not empty.
    """
    abstract = F.col("abstract_text")
    own = F.filter("assigned", lambda pair: pair["section_idx"] == F.col("section_idx"))
    return (
        rows.select("article_id", "abstract_text", "assigned", *keep, F.inline_outer("zipped"))
        .withColumn("section_summary", F.transform(own, lambda pair: F.get(abstract, pair["sent_idx"])))
        .where(F.size("section_summary") > 0)
        .drop("assigned")
    )


def matched_sections(articles: DataFrame, keep: tuple[str, ...] = (), **options) -> DataFrame:
    """Section rows with the abstract sentences assigned to them; ``keep`` names extra columns."""
    assigned = F.transform("matched", lambda match, m: F.struct(
        m.alias("sent_idx"), match["section_idx"].alias("section_idx")))
    return assigned_sections(with_matches(articles, **options).withColumn("assigned", assigned), keep)


def collect_section_summary(aligned: DataFrame) -> DataFrame:
    """Group long-form assignments back into ordered sentence lists per section of an article.

    For rows that still hold their arrays, :func:`matched_sections` gives the same without an exchange.
    """
    ordered = F.array_sort(F.collect_list(F.struct("sent_idx", "sentence")))
    return aligned.groupBy("article_id", ABSTRACT_KEY, "section_idx").agg(
        F.transform(ordered, lambda s: s["sentence"]).alias("section_summary"))


def regroup_articles(sections: DataFrame, text: Column | None = None) -> DataFrame:
    """Section rows back to one row per article (id and abstract), sections in order."""
    item = F.struct("section_idx", "section_head", (F.col("section_text") if text is None else text).alias("section_text"))
    return sections.groupBy("article_id", ABSTRACT_KEY).agg(F.array_sort(F.collect_list(item)).alias("full_text_sections"))
