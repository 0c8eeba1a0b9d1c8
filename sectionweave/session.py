"""Session settings the operators are tuned for, and the shared scratch folder."""

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows of 64-bit keys that may be broadcast: 1M x 8 bytes is 8 MB on each executor.
BROADCAST_KEY_ROWS = 1_000_000
# Article rows are long: rows and bytes that one Arrow batch may hold.
ARROW_ROWS = 512
ARROW_BYTES = 64 << 20
# An input below this size may be dealt out to idle cores.
SPREAD_BYTES = 1 << 30


def build_session(app_name: str = "sectionweave", master: str | None = None, **conf) -> SparkSession:
    """A session with adaptive execution; keyword settings use ``__`` for dots."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        # Scoring costs far more per byte than reading a shuffle: do not merge small partitions.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), str(value))
    return attach(builder.getOrCreate())


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder all executors share.

    The cluster names that folder in ``spark.checkpoint.dir``; only a session
    without it (a local test) falls back to a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="sectionweave-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, *partitions: str) -> DataFrame:
    """Write an intermediate result to the shared folder and read it from there: it is computed once, and a lost executor costs nothing.

    ``partitions`` are columns by which the files are laid out, so that a reader of one value reads its files only.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.partitionBy(*partitions).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fits_broadcast(keys: DataFrame, max_rows: int = BROADCAST_KEY_ROWS) -> bool:
    """Whether a table of fixed-width keys has at most ``max_rows`` rows (reads no further)."""
    return keys.limit(max_rows + 1).count() <= max_rows


def broadcast_if_small(keys: DataFrame, max_rows: int = BROADCAST_KEY_ROWS) -> DataFrame:
    """Mark ``keys`` for a broadcast join when it is checked to be small, else leave it to a shuffle join."""
    return F.broadcast(keys) if fits_broadcast(keys, max_rows) else keys


def ship_package(spark: SparkSession) -> SparkSession:
    """Send this package to the executors' Python workers, once per application."""
    context = spark.sparkContext
    if not getattr(context, "_sectionweave_shipped", False):
        package = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp(prefix="sectionweave-")) / f"{package.name}.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for source in sorted(package.rglob("*.py")):
                out.write(source, source.relative_to(package.parent))
        context.addPyFile(str(archive))
        context._sectionweave_shipped = True
    return spark


def attach(spark: SparkSession) -> SparkSession:
    """Make any session ready for the operators: ship the package, bound Arrow batches by rows and bytes for the whole session."""
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(rows)) > ARROW_ROWS:
        spark.conf.set(rows, str(ARROW_ROWS))
    spark.conf.set(size, str(ARROW_BYTES))
    return ship_package(spark)


def spread(df: DataFrame) -> DataFrame:
    """Use all cores on a small input of few splits; inputs of SPREAD_BYTES and more pass through unshuffled."""
    if int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) >= SPREAD_BYTES:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
