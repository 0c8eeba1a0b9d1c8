"""Articles and pairs made of the ``documents`` and ``conversations`` tables.

Every document becomes an article with all of its text: six sections that share
its lines in order, and an abstract that fuses the first and last sentence of
each line.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let, sentences
from ..operators.encode import pieces

SECTION_HEADERS = ("Introduction", "Related Work", "Materials and Methods", "RESULTS", "Discussion and Conclusions")


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: F.trim(line) != "")


def _sections(lines: Column) -> Column:
    """Six runs of lines, each flattened to its sentences: line i belongs to run floor(6 i / n)."""
    count = len(SECTION_HEADERS) + 1

    def start(k: Column) -> Column:
        return F.floor((k * F.size(lines) + (count - 1)) / count).cast("int")

    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda k: F.flatten(F.slice(lines, start(k) + 1, start(k + 1) - start(k))))


def _abstract_sentence(line: Column) -> Column:
    """First and last sentence of a line, marked as one."""
    first, last = F.get(line, F.lit(0)), F.get(line, F.size(line) - 1)
    fused = F.when(F.size(line) == 1, first).otherwise(F.concat_ws(" ", first, last))
    return F.concat(F.lit("<S> "), fused, F.lit(" </S>"))


def articles_from_documents(documents: DataFrame, article_id: Column | None = None) -> DataFrame:
    """Article rows; ``lang`` is kept so that callers can split by it."""
    headers = F.array(*map(F.lit, SECTION_HEADERS),
                      F.when(F.col("lang") == "en", "Limitations").otherwise("Appendix A"))
    return documents.withColumn("lines", F.transform(_lines(F.col("text")), sentences)).select(
        (F.col("doc_id") if article_id is None else article_id).cast("string").alias("article_id"),
        F.transform("lines", _abstract_sentence).alias("abstract_text"),
        headers.alias("section_names"),
        let(F.col("lines"), _sections).alias("sections"),
        "lang",
    )


def pairs_from_conversations(conversations: DataFrame) -> DataFrame:
    """Each assistant turn with the user turn right before it.

    Turns must be numbered without gaps (a gap leaves the turn behind it without a pair), so the turn before is an equality; the join
    key holds the turn and spreads even a conversation that has most of the rows.
    """
    answers = conversations.where(F.col("role") == "assistant").select(
        "conv_id", "turn", F.col("text").alias("target_sum"))
    questions = conversations.where(F.col("role") == "user").select(
        "conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("gen_sum"))
    return answers.join(questions, ["conv_id", "turn"]).select(
        F.concat_ws(":", "conv_id", "turn").alias("article_id"), "target_sum", "gen_sum")


def vocabulary(texts: DataFrame, column: str, first_id: int = 2) -> DataFrame:
    """``(token, id)`` of the distinct pieces of a text column, numbered in digest order.

    Numbers are ranks within one of 4,096 digest buckets plus the sizes of the
    buckets before it, so no task sorts the whole vocabulary.
    """
    tokens = (
        texts.select(F.explode(pieces(F.col(column))).alias("token")).distinct()
        .withColumn("digest", F.md5("token")).withColumn("bucket", F.substring("digest", 1, 3))
    )
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    # At most 4,096 rows.
    offsets = tokens.groupBy("bucket").count().select(
        "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy("digest"))
    return tokens.withColumn("rank", rank).join(F.broadcast(offsets), "bucket").select(
        "token", (F.col("offset") + F.col("rank") + (first_id - 1)).cast("int").alias("id"))
