"""Corpus-level numbers over scored pairs."""

from collections.abc import Iterator
from math import e, factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import spelt
from .rouge import GENERATED, TARGET, score_structs

SUMMARY_METRICS = ("rouge1", "rouge2", "rougeLsum")
REPORT_METRICS = ("rouge1", "rouge2", "rougeL")
STATISTICS = ("fmeasure", "recall", "precision")

# P(X <= k) of a Poisson variable with mean 1, as multiples of 2^-32, until these are used up.
POISSON_STEPS = tuple(round(sum(1 / factorial(i) for i in range(k + 1)) / e * 2 ** 32) for k in range(12))
# Equal rows that are weighed together; more of them are dealt out.
EQUAL_ROWS = 4096


def _exact_mean(score: str) -> Column:
    """Mean of scores, summed as decimals of twelve places so that the order of rows cannot matter."""
    return F.sum(F.col(score).cast("decimal(38,12)")).cast("double") / F.count(score)


def score_summary(scored: DataFrame) -> DataFrame:
    """Mean and sample standard deviation of each metric, one row per statistic."""
    columns = [f(m).alias(f"{name}_{m}")
               for name, f in (("mean", _exact_mean), ("std", F.stddev_samp)) for m in SUMMARY_METRICS]
    rows = F.array(*(
        F.struct(F.lit(name).alias("statistic"), *(F.col(f"{name}_{m}").alias(m) for m in SUMMARY_METRICS))
        for name in ("mean", "std")))
    return scored.agg(*columns).select(F.inline(rows))


def _mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 32-bit integers (the finalizer of MurmurHash3)."""
    h = (h ^ h >> np.uint32(16)) * np.uint32(0x85EBCA6B)
    h = (h ^ h >> np.uint32(13)) * np.uint32(0xC2B2AE35)
    return h ^ h >> np.uint32(16)


def _weights(low: np.ndarray, high: np.ndarray, reps: int) -> np.ndarray:
    """Poisson(1) counts, a row per replicate: the inverse distribution function at a 32-bit hash of seed and replicate."""
    replicate = np.arange(reps, dtype=np.uint32)[:, None] * np.uint32(0x9E3779B9)
    uniform = _mixed(_mixed(low[None, :] ^ replicate) ^ high[None, :])
    return np.searchsorted(np.array(POISSON_STEPS, np.uint32), uniform, side="right").astype(np.float64)


def _fold(n_values: int, reps: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of weights and of weighted values per replicate over the rows of a task; replicate -1 weighs each row once."""
    totals = np.zeros((reps + 1, n_values + 1))
    for batch in batches:
        low, high, first, n = (batch.column(i).to_numpy().astype(np.int64) for i in range(4))
        values = np.column_stack([np.ones(batch.num_rows), *(batch.column(4 + i).to_numpy(zero_copy_only=False) for i in range(n_values))])
        for k in range(int(n.max(initial=0))):  # the k-th of equal rows has a seed of its own
            here = n > k
            occurrence = ((first[here] + k) * 0x632BE5AB & 0xFFFFFFFF).astype(np.uint32)
            low_k, high_k = low[here].astype(np.uint32) ^ occurrence, high[here].astype(np.uint32)
            for at in range(0, len(low_k), 128):
                part = slice(at, at + 128)
                totals[1:] += _weights(low_k[part], high_k[part], reps) @ values[here][part]
            totals[0] += values[here].sum(axis=0)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.arange(-1, reps)), *(pa.array(totals[:, i]) for i in range(n_values + 1))],
        names=["replicate", "weight", *(f"v{i}" for i in range(n_values))])


def _replicate_means(scored: DataFrame, values: dict[str, Column], key: str, reps: int) -> DataFrame:
    """Weighted mean of each value per replicate, and replicate -1 with the plain means.

    A row's seed is a digest of its id and texts, so weights are the same wherever and however often a task
    runs; equal rows are counted and told apart by their number. Each task multiplies its rows with the
    weights of all replicates and returns one row per replicate, so rows are never multiplied.
    """
    digest = F.md5(F.concat(*(spelt(F.col(c).cast("string")) for c in (key, TARGET, GENERATED))))
    names = list(values)
    rows = (
        scored.select(digest.alias("digest"), *(c.alias(n) for n, c in values.items()))
        .groupBy("digest").agg(F.count("*").alias("n"), *(F.first(n).alias(n) for n in names))
        .withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(EQUAL_ROWS).cast("long"))))
        .repartition("digest", "first")
    )
    seed = [F.conv(F.substring("digest", at, 8), 16, 10).cast("long") for at in (1, 9)]
    schema = T.StructType([T.StructField("replicate", T.LongType()), T.StructField("weight", T.DoubleType()),
                           *(T.StructField(f"v{i}", T.DoubleType()) for i in range(len(names)))])
    sums = rows.select(seed[0].alias("low"), seed[1].alias("high"), "first", F.least(F.col("n") - F.col("first"), F.lit(EQUAL_ROWS)).alias("n"),
                       *names).mapInArrow(lambda batches: _fold(len(names), reps, batches), schema)
    return sums.groupBy("replicate").agg(F.sum("weight").alias("weight"), *(F.sum(f"v{i}").alias(f"v{i}") for i in range(len(names)))).select(
        "replicate", *((F.col(f"v{i}") / F.when(F.col("weight") > 0, F.col("weight"))).alias(n) for i, n in enumerate(names)))


def _drawn(name: str) -> Column:
    return F.when(F.col("replicate") >= 0, F.col(name))


def bootstrap_ci(pairs: DataFrame, reps: int = 1000, level: float = 0.95, key: str = "article_id",
                 use_stemmer: bool = False) -> DataFrame:
    """Value and bootstrap interval of every metric and statistic over all pairs.

    A replicate weighs each row by a Poisson(1) count, so nothing is resampled or
    shuffled per replicate: one pass folds all replicates. Rows may repeat, ids may be null.
    """
    cells = [(m, s) for m in REPORT_METRICS for s in STATISTICS]
    names = [f"{m}_{s}" for m, s in cells]
    scored = score_structs(pairs, REPORT_METRICS, use_stemmer)
    tail = (1 - level) / 2
    bounds = F.array(F.lit(tail), F.lit(1 - tail))
    folded = _replicate_means(scored, {f"{m}_{s}": F.col(m)[s] for m, s in cells}, key, reps).agg(
        *(F.percentile(_drawn(n), bounds).alias(n) for n in names),
        *(F.max(F.when(F.col("replicate") < 0, F.col(n))).alias(f"{n}_value") for n in names))
    return folded.select(F.inline(F.array(*(
        F.struct(F.lit(m).alias("metric"), F.lit(s).alias("statistic"), F.col(f"{m}_{s}_value").alias("value"),
                 F.get(F.col(f"{m}_{s}"), F.lit(0)).alias("lo"), F.get(F.col(f"{m}_{s}"), F.lit(1)).alias("hi"))
        for m, s in cells))))


def corpus_rouge(pairs: DataFrame, reps: int = 1000, key: str = "article_id", use_stemmer: bool = True) -> DataFrame:
    """F of each metric over the corpus in percent: the median of the bootstrap means."""
    metrics = ("rouge1", "rouge2", "rougeL", "rougeLsum")
    scored = score_structs(pairs, metrics, use_stemmer)
    mids = _replicate_means(scored, {m: F.col(m)["fmeasure"] for m in metrics}, key, reps).agg(*(
        F.percentile(_drawn(m), 0.5).alias(m) for m in metrics))
    rows = F.array(*(F.struct(F.lit(m).alias("metric"), F.round(F.col(m) * 100, 4).alias("value")) for m in metrics))
    return mids.select(F.inline(rows))
