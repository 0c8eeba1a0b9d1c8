"""Split stores and checked ingestion: one pass over the input, whatever the number of splits or broken lines."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import ARTICLE

SPLIT = "split"


def write_split_store(rows: DataFrame, path: str, name: str) -> None:
    """Rows with a ``split`` column as a catalog table ``name`` at ``path``, laid out by split; replaced if present.

    All splits are written by one scan. The catalog keeps the list of splits, so readers neither search folders
    nor run a job to know what is there. A null split is a split of its own, which only a read of the whole table returns.
    """
    spark = rows.sparkSession
    rows.write.mode("overwrite").partitionBy(SPLIT).parquet(path)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != SPLIT)
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.sql(f"CREATE TABLE {name} ({fields}, `{SPLIT}` string) USING parquet PARTITIONED BY (`{SPLIT}`) LOCATION '{path}'")
    spark.catalog.recoverPartitions(name)


def split_names(spark: SparkSession, name: str) -> list[str]:
    """The splits of a store, from the catalog."""
    found = (row[0].split("=", 1)[1] for row in spark.sql(f"SHOW PARTITIONS {name}").collect())
    return sorted(s for s in found if s != "__HIVE_DEFAULT_PARTITION__")


def read_split(spark: SparkSession, name: str, split: str) -> DataFrame:
    """The rows of one split; only its files are read, and an absent split is an error."""
    if split not in (there := split_names(spark, name)):
        raise ValueError(f"{name} has no {split!r} split, only {', '.join(there)}")
    return spark.table(name).where(F.col(SPLIT) == split)


@dataclass
class Ingested:
    """``rows`` that could be read, the ``broken`` lines with their files, and the numbers of both."""

    rows: DataFrame
    broken: DataFrame
    n_rows: int
    n_broken: int


def ingest_articles(spark: SparkSession, path: str, store: str, max_broken: int | None = None, schema: T.StructType = ARTICLE) -> Ingested:
    """Articles of JSON lines that may hold broken ones, which go to a quarantine instead of failing the job.

    One pass parses every line, writes rows and broken lines to two partitions of ``store`` and counts both on the
    way. A line is broken that is no JSON object or has a field of another type; blank lines are skipped. With more
    than ``max_broken`` of them the job fails, and both partitions are there to be looked at.
    """
    whole = T.StructType([*schema.fields, T.StructField("_broken", T.StringType())])
    # Spark tells a broken line by the column that it fills with it.
    lines = spark.read.text(path).where(F.trim("value") != "").select("value", F.col("_metadata.file_path").alias("file"))
    parsed = lines.withColumn("row", F.from_json("value", whole, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}))
    broken = F.col("row").isNull() | F.col("row._broken").isNotNull() | ~F.trim("value").startswith("{")
    checked = parsed.select(broken.alias("broken"), F.when(broken, F.col("value")).alias("line"), F.when(broken, F.col("file")).alias("file"),
                            F.when(~broken, F.struct(*(F.col(f"row.{f}").alias(f) for f in schema.names))).alias("row"))
    seen = Observation()
    counted = checked.observe(seen, F.count(F.when(F.col("broken"), 1)).alias("n_broken"), F.count(F.when(~F.col("broken"), 1)).alias("n_rows"))
    counted.write.mode("overwrite").partitionBy("broken").parquet(store)
    counts = seen.get
    if max_broken is not None and counts["n_broken"] > max_broken:
        raise ValueError(f"{path} has {counts['n_broken']} broken lines, more than {max_broken}; they are in {store}")
    kept = spark.read.schema(counted.schema).parquet(store)
    return Ingested(kept.where("NOT broken").select("row.*"), kept.where("broken").select("line", "file"), counts["n_rows"], counts["n_broken"])
