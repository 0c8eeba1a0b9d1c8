"""Articles to section-level training rows."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sections import identify_section, zip_sections
from ..functions.text import join_sentences, piece_count, spelt, spelt_list, strip_markers
from ..operators.align import assigned_sections, matched_sections, with_matches
from ..schemas import TRAINING_TYPES
from ..session import broadcast_if_small, stored

GROUP = "group_key"
COPY = (GROUP, "body_key")


def _group_key() -> Column:
    return F.md5(F.concat(spelt(F.col("article_id")), spelt_list(F.col("abstract_text"))))


def _body_key() -> Column:
    return F.md5(F.concat(spelt_list(F.col("section_names")), spelt_list(F.col("sections"), lambda s: spelt_list(s))))


def repeated_ids(articles: DataFrame) -> DataFrame:
    """The article ids of several rows: a count of one column, to which a columnar source is pruned; partial sums make a hot id cheap."""
    return articles.groupBy(F.col("article_id").alias("repeated_id")).count().where("count > 1").select("repeated_id")


def pooled_sections(articles: DataFrame, keep: tuple[str, ...] = (), **options) -> DataFrame:
    """:func:`matched_sections` over groups of rows with one article_id and abstract.

    The sections of such rows compete together: per abstract sentence the highest score wins, then the
    smallest digest of the row's sections, then the first position. Rows are matched once, and only their
    digests and matches are written; digests, scores and positions are aggregated, map-side first. Rows that are
    equal in all their columns have one digest and count as one. Texts are read from the source for winning rows alone.
    """
    keyed = articles.withColumns({GROUP: _group_key(), "body_key": _body_key()})
    rows = stored(with_matches(keyed, **options).select(*COPY, *keep, "matched"), "matched")
    claims = rows.select(*COPY, *keep, F.posexplode_outer("matched").alias("sent_idx", "match")).where("match IS NOT NULL")
    claim = F.struct((-F.col("match.score")).alias("rank"), "body_key", "match.section_idx")
    assigned = (
        claims.groupBy(GROUP, *keep, "sent_idx").agg(F.min(claim).alias("best"))
        .select(GROUP, *keep, "best.body_key", F.struct("sent_idx", "best.section_idx").alias("pair"))
        .groupBy(*COPY, *keep).agg(F.array_sort(F.collect_list("pair")).alias("assigned"))
    )
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"a.{c}")) for c in (*COPY, *keep)]
    won = keyed.alias("r").join(assigned.alias("a"), same).select("r.*", "assigned")
    # Equal keys mean equal rows: any of them will do.
    names = ("abstract_text", "article_id", "section_names", "sections", "assigned")
    one = won.groupBy(*COPY, *keep).agg(F.first(F.struct(*names)).alias("row")).select(*keep, "row.*")
    return assigned_sections(one.withColumn("zipped", zip_sections(F.col("section_names"), F.col("sections"))), keep)


def aligned_sections(articles: DataFrame, pool_copies: bool = True, keep: tuple[str, ...] = (), **options) -> DataFrame:
    """Sections with their assigned sentences, for rows that may share an article_id and abstract.

    One narrow pass counts ids, which are broadcast when they are checked to be few. Rows alone with their id never
    leave their partition; only for the others are abstracts digested, and rows that share both are pooled.
    """
    if not pool_copies:
        return matched_sections(articles, keep, **options)
    ids = stored(repeated_ids(articles), "repeated_ids")
    if ids.isEmpty():
        return matched_sections(articles, keep, **options)
    ids = broadcast_if_small(ids)
    same = F.col("article_id").eqNullSafe(F.col("repeated_id"))
    single, several = articles.join(ids, same, "left_anti"), articles.join(ids, same, "left_semi")
    return matched_sections(single, keep, **options).unionByName(pooled_sections(several, keep, **options))


def prepare_section_rows(
    articles: DataFrame,
    types: tuple[str, ...] = TRAINING_TYPES,
    min_document: int = 50,
    min_summary: int = 50,
    train: bool | None = None,
    pool_copies: bool = True,
    use_stemmer: bool = True,
    strip_markers_first: bool = False,
    large_bytes: int | None = None,
) -> DataFrame:
    """One row per kept section: its text, its share of the abstract, the whole abstract.

    Sentences are assigned over all sections before types are filtered, so the
    sentences of a dropped section go with it. The summary length rule holds for
    training rows only; with ``train=None`` a ``split`` column decides, if there is one.
    Articles with more than ``large_bytes`` of section text are compared by many tasks each.
    """
    keep = ("split",) if "split" in articles.columns else ()
    sections = aligned_sections(articles, pool_copies, keep,
                                use_stemmer=use_stemmer, strip_markers_first=strip_markers_first, large_bytes=large_bytes)
    if train is None:
        exempt = F.col("split").isin("val", "test") if keep else F.lit(False)
    else:
        exempt = F.lit(not train)
    return (
        sections.withColumn("section_id", identify_section(F.col("section_head")))
        .where(F.col("section_id").isin(*types))
        .withColumn("document", F.coalesce(join_sentences(F.col("section_text")), F.lit("")))
        .where(piece_count(F.col("document")) > min_document)
        .withColumn("summary", strip_markers(join_sentences(F.col("section_summary"))))
        .where(exempt | (piece_count(F.col("summary")) > min_summary))
        .select("article_id", "section_idx", "section_id", "document", "summary",
                strip_markers(join_sentences(F.col("abstract_text"))).alias("abstract"), *keep)
    )
