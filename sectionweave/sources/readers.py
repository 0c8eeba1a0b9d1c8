"""Files and tables in."""

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.columns import select_pair
from ..schemas import ARTICLE, ROW, SPLITS

# Formats of training and validation files.
PAIR_FORMATS = ("csv", "json")


def read_articles(spark: SparkSession, path: str, fmt: str = "json", partitions: int | None = None) -> DataFrame:
    """Article rows; the declared schema saves the inference pass and reads no other field.

    A malformed line fails the job rather than turning into nulls. ``partitions``
    co-locates rows by article_id; leave it out unless a later step needs that.
    """
    reader = spark.read.schema(ARTICLE)
    if fmt == "json":
        reader = reader.option("mode", "FAILFAST")
    df = reader.format(fmt).load(path)
    return df if partitions is None else df.repartition(partitions, "article_id")


def read_splits(spark: SparkSession, root: str, names: tuple[str, ...] = SPLITS, fmt: str = "json",
                suffix: str = ".txt") -> DataFrame:
    """All splits under one root in one DataFrame with a ``split`` column."""
    parts = [read_articles(spark, f"{root.rstrip('/')}/{name}{suffix}", fmt).withColumn("split", F.lit(name))
             for name in names]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def read_rows(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Section rows as the writer leaves them: one directory per split. A malformed line fails the job."""
    reader = spark.read.schema(ROW)
    if fmt == "json":
        reader = reader.option("mode", "FAILFAST")
    return reader.format(fmt).load(path)


def file_format(path: str) -> str:
    """The text after the last dot, which must name a supported format."""
    extension = path.rsplit(".", 1)[-1]
    if extension not in PAIR_FORMATS:
        raise ValueError(f"{path}: expected a file ending in {' or '.join(PAIR_FORMATS)}")
    return extension


def read_file(spark: SparkSession, path: str, fmt: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """A csv or json file with all columns as strings, in file order.

    ``columns`` names the fields of json. Without it they are those of all records, in the order in which they
    first appear, as positions decide the text and summary column when no names are given; that costs a pass
    over the file. A malformed json record fails the job.
    """
    if (fmt or file_format(path)) == "csv":
        return spark.read.csv(path, header=True, multiLine=True, escape='"')
    names = columns or json_fields(spark.read.text(path))
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def json_fields(lines: DataFrame) -> list[str]:
    """Top-level fields of JSON lines by first appearance; one row per distinct field is gathered."""
    keys = lines.select(F.monotonically_increasing_id().alias("line"), F.posexplode(F.json_object_keys("value")).alias("at", "field"))
    first = keys.groupBy("field").agg(F.min(F.struct("line", "at")).alias("first"))
    return [row.field for row in first.orderBy("first").collect()]


def read_pairs(spark: SparkSession, path: str, text_col: str | None = None, summary_col: str | None = None,
               dataset: str | None = None, fmt: str | None = None) -> DataFrame:
    """Two-column texts as ``text`` and ``summary``."""
    named = [text_col, summary_col] if text_col and summary_col and text_col != summary_col else None
    return select_pair(read_file(spark, path, fmt, named), text_col, summary_col, dataset)


def read_pair_splits(spark: SparkSession, paths: Mapping[str, str], **options) -> DataFrame:
    """Pair files by split name in one DataFrame with a ``split`` column."""
    parts = [read_pairs(spark, path, **options).withColumn("split", F.lit(split)) for split, path in paths.items()]
    return reduce(DataFrame.unionByName, parts)


def read_translations(spark: SparkSession, path: str) -> DataFrame:
    """Records with one string per language code."""
    schema = T.StructType([T.StructField("translation", T.MapType(T.StringType(), T.StringType()))])
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def select_split(df: DataFrame, split: str) -> DataFrame:
    """Rows of one split; an absent split is an error."""
    rows = df.where(F.col("split") == split)
    if rows.isEmpty():
        raise ValueError(f"the dataset has no {split!r} split")
    return rows


def load_split(spark: SparkSession, name: str, split: str, paths: dict[str, str] | None = None) -> DataFrame:
    """One split of a named dataset: a catalog table, or a path the caller lists by name."""
    df = spark.read.load(paths[name]) if paths and name in paths else spark.table(name)
    return select_split(df, split)
