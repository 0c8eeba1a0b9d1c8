"""Input tables, and keeping one row of a group."""

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import attach, stored

__all__ = ["keep_rows", "record_batch", "sliced", "stored", "table", "text_key"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return attach(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def text_key(text: Column) -> Column:
    """Tells rows of one doc_id apart by their text; null and empty texts differ."""
    return F.when(text.isNotNull(), F.xxhash64(text))


def record_batch(schema: T.StructType, columns: list) -> pa.RecordBatch:
    """A batch of the Arrow types that Spark expects for ``schema``."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)


def sliced(batches: Iterator[pa.RecordBatch], text: int, most: int) -> Iterator[pa.RecordBatch]:
    """Batches cut into runs of rows whose texts add up to about ``most`` bytes, so that memory follows bytes, not rows."""
    for batch in batches:
        begin = size = 0
        for row, value in enumerate(batch.column(text)):
            size += len(value.as_buffer() or b"") if value.is_valid else 0
            if size >= most:
                yield batch.slice(begin, row + 1 - begin)
                begin, size = row + 1, 0
        if begin < batch.num_rows:
            yield batch.slice(begin)


def keep_rows(docs: DataFrame, winners: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``winners`` names, each once, with the columns of ``docs``.

    winners: ``doc_id``, ``text_key``, and ``n_same``, the number of rows of docs with both. Where such
    rows repeat, one of them stays. Nulls match nulls. Only rows that repeat are grouped, so texts are
    not shuffled for the others except by the join on ids.
    """
    packed = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("l_id"), text_key(F.col("text")).alias("l_key"))
    on = F.col("l_id").eqNullSafe(F.col("r_id")) & F.col("l_key").eqNullSafe(F.col("r_key"))

    def matched(which: Column) -> DataFrame:
        names = winners.where(which).select(F.col("doc_id").alias("r_id"), F.col("text_key").alias("r_key"))
        return packed.join(names, on, "left_semi")

    kept = matched(F.col("n_same") == 1).select("row")
    if not winners.where("n_same > 1").isEmpty():
        kept = kept.unionByName(matched(F.col("n_same") > 1).groupBy("l_id", "l_key").agg(F.first("row").alias("row")).select("row"))
    return kept.select("row.*")
