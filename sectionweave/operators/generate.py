"""Batch inference over a text column with a caller's model."""

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stored
from .loading import loaded, named

Summarizer = Callable[[list[str]], list[str]]


def generate(rows: DataFrame, summarizer: Callable[[], Summarizer], text_col: str = "document", batch_size: int = 2,
             out: str = "gen_sum") -> DataFrame:
    """Add the generated text to each row; ids and targets stay on the row.

    ``summarizer`` is a loader called once per Python worker; the function it returns gets
    at most ``batch_size`` texts at a time. Null texts give null.
    """
    name = named(summarizer)

    @F.arrow_udf(T.StringType())
    def run(column: pa.Array) -> pa.Array:
        summarize = loaded(name, summarizer)
        texts = column.to_pylist()
        present = [t for t in texts if t is not None]
        made: list[str] = []
        for start in range(0, len(present), batch_size):
            made += summarize(present[start:start + batch_size])
        if len(made) != len(present):
            raise ValueError(f"summarizer returned {len(made)} texts for {len(present)}")
        results = iter(made)
        return pa.array([None if t is None else next(results) for t in texts], pa.string())

    # Only the text goes to Python. Not deterministic: a filter behind must not call the model twice.
    return rows.withColumn(out, run.asNondeterministic()(F.col(text_col)))


KEPT = T.StructType([T.StructField("text_key", T.StringType()), T.StructField("made", T.StringType()), T.StructField("batch", T.IntegerType())])


def _kept(rows: DataFrame, store: str) -> DataFrame:
    """What earlier runs have left in the store; nothing before the first."""
    spark = rows.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(store)
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    return spark.read.schema(KEPT).parquet(store) if there else spark.createDataFrame([], KEPT)


def generate_missing(rows: DataFrame, summarizer: Callable[[], Summarizer], store: str, text_col: str = "document",
                     batch_size: int = 2, n_batches: int = 16) -> int:
    """Generate for the distinct texts that ``store`` lacks, and return how many those were.

    A text is known by its digest, so equal texts are generated once. What is missing is found by an anti-join and
    written with a batch number; every batch is a job that appends to the store when it is whole. A run that
    breaks off loses the batch it was at; called again, it asks the model for what is missing only.
    """
    texts = rows.where(F.col(text_col).isNotNull()).select(F.sha2(F.col(text_col), 256).alias("text_key"), F.col(text_col).alias("text"))
    missing = texts.join(_kept(rows, store).select("text_key"), "text_key", "left_anti").groupBy("text_key").agg(F.first("text").alias("text"))
    batch = F.pmod(F.xxhash64("text_key"), F.lit(n_batches)).cast("int")
    waiting = stored(missing.withColumn("batch", batch), "waiting", "batch")
    counts = {r.batch: r["count"] for r in waiting.groupBy("batch").count().collect()}  # at most n_batches rows
    for number in sorted(counts):
        made = generate(waiting.where(F.col("batch") == number), summarizer, "text", batch_size, out="made")
        made.select("text_key", "made", "batch").write.mode("append").parquet(store)
    return sum(counts.values())


def generate_resumable(rows: DataFrame, summarizer: Callable[[], Summarizer], store: str, text_col: str = "document",
                       batch_size: int = 2, out: str = "gen_sum", n_batches: int = 16) -> DataFrame:
    """:func:`generate` over a store that outlives the run. Null texts give null; the store is for one model only."""
    generate_missing(rows, summarizer, store, text_col, batch_size, n_batches)
    kept = _kept(rows, store).groupBy("text_key").agg(F.min("made").alias(out))
    keyed = rows.withColumn("text_key", F.sha2(F.col(text_col), 256))
    return keyed.join(kept, "text_key", "left").select(*rows.columns, out)
