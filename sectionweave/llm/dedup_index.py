"""Exact deduplication against a persistent digest index.

The index is a Parquet table with one row per normalised text that was ever seen, bucketed and sorted by
digest. A new batch is reduced to its digests, which are pre-aggregated before they are shuffled, anti-joined
with the index by sort-merge (the index side needs no exchange) and appended.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .tables import keep_rows, stored, text_key

#: White space that does not count: U+0020 and U+0009 to U+000D.
SPACE = " \t\n\x0b\x0c\r"
BUCKETS = 64
INDEX_COLUMNS = "digest binary, doc_id bigint, text_key bigint, n_points int, group_size bigint, n_same bigint"


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), SPACE, "")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, digest (sha256 of the normalised text) and n_points (code points of the text) of every row."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("text_key"),
                       F.unhex(F.sha2(normalised(F.col("text")), 256)).alias("digest"), F.char_length(text).alias("n_points"))


def representatives(rows: DataFrame) -> DataFrame:
    """One row per digest: the text with the most code points, then the smallest doc_id (null last), then the smallest text key.

    Rows that agree in all three fold into one with their number before they meet the rest of their group.
    """
    folded = rows.groupBy("digest", "n_points", "doc_id", "text_key").agg(F.count("*").alias("n"))
    best = folded.groupBy("digest").agg(
        F.min(F.struct((-F.col("n_points")).alias("short"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key", "n")).alias("best"),
        F.sum("n").alias("group_size"))
    return best.select("digest", "best.doc_id", "best.text_key", (-F.col("best.short")).alias("n_points"), "group_size",
                       F.col("best.n").alias("n_same"))


class DigestIndex:
    """The index at ``path``, which a later session opens again by the same path; ``buckets`` must stay the same."""

    def __init__(self, spark: SparkSession, path: str, name: str, buckets: int = BUCKETS):
        self.spark, self.path, self.name, self.buckets = spark, path, name, buckets
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({INDEX_COLUMNS}) USING parquet "
                  f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'")

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def fresh(self, batch: DataFrame) -> DataFrame:
        """Of ``representatives``, those whose digest the index lacks. Both sides are bucketed alike; only the batch moves."""
        return batch.repartition(self.buckets, "digest").join(self.rows().hint("merge"), "digest", "left_anti")

    def append(self, rows: DataFrame) -> DataFrame:
        """Add the fresh representatives of ``digests`` and return them."""
        fresh = stored(self.fresh(representatives(rows)), "fresh")
        columns = [c.split()[0] for c in INDEX_COLUMNS.split(", ")]
        fresh.select(columns).repartition(self.buckets, "digest").write.insertInto(self.name)
        return fresh


def _new_index(spark: SparkSession) -> DigestIndex:
    path = scratch_path(spark, "digest_index")
    return DigestIndex(spark, path, path.rsplit("/", 1)[1].replace("-", "_"))


def membership(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty. Rows that agree in doc_id and text are one document given repeatedly: all of
    them say kept, and ``drop_duplicates`` leaves one. With an index that already holds texts, rows that
    equal one of those refer to its document and are not kept. group_size counts the rows of this batch.
    """
    spark = docs.sparkSession
    rows = stored(digests(docs), "digests")
    own = representatives(rows)
    if index is None:
        index = _new_index(spark)
    fresh = index.append(rows)
    sizes = own.select("digest", F.col("group_size").alias("own_size"))
    mine = fresh.select("digest", F.lit(True).alias("fresh"))
    # Written and read without buckets: then both sides of the last join are exchanges, whose large partitions are split.
    known = stored(index.rows().hint("merge").join(sizes, "digest").join(mine, "digest", "left"), "known")
    joined = rows.alias("r").join(known.alias("k"), "digest")
    return joined.select(
        "r.doc_id", F.col("k.doc_id").alias("keep_id"), F.col("own_size").alias("group_size"),
        (F.coalesce("fresh", F.lit(False)) & F.col("r.doc_id").eqNullSafe(F.col("k.doc_id"))
         & F.col("r.text_key").eqNullSafe(F.col("k.text_key"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


def drop_duplicates(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with its columns: one of each group that the index lacks."""
    index = index or _new_index(docs.sparkSession)
    return keep_rows(docs, index.append(digests(docs)))


ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
           FROM documents),
g AS (SELECT norm, count(*) AS group_size, arg_min(doc_id, (-length(text), doc_id)) AS keep_id FROM t GROUP BY norm)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g USING (norm)
"""
