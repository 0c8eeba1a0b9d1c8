"""Which columns, languages and rows of a dataset to use."""

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import DATASET_COLUMNS

# Fixed value: task names that carry their language pair.
TRANSLATION_TASK = re.compile("translation_([a-z]+)_to_([a-z]+)")
# How a column with a sort direction is written.
DIRECTION = re.compile(r"(ASC|DESC) NULLS (FIRST|LAST)'?>?$")


def resolve_columns(columns: Sequence[str], text: str | None = None, summary: str | None = None,
                    dataset: str | None = None) -> tuple[str, str]:
    """Text and summary column: the given name, else the dataset's known one, else by position."""
    known = DATASET_COLUMNS.get(dataset, tuple(columns[:2]))
    chosen = []
    for role, given, fallback in (("text", text, 0), ("summary", summary, 1)):
        name = given if given is not None else known[fallback] if fallback < len(known) else None
        if name not in columns:
            raise ValueError(f"{role} column {name!r} is not one of: {', '.join(columns)}")
        chosen.append(name)
    return chosen[0], chosen[1]


def select_pair(df: DataFrame, text: str | None = None, summary: str | None = None,
                dataset: str | None = None) -> DataFrame:
    """The resolved columns as ``text`` and ``summary``."""
    text, summary = resolve_columns(df.columns, text, summary, dataset)
    return df.select(F.col(text).alias("text"), F.col(summary).alias("summary"))


def resolve_languages(task: str, source: str | None = None, target: str | None = None) -> tuple[str, str]:
    """Language codes from the options (cut at ``_``) or from the task name."""
    named = TRANSLATION_TASK.match(task)
    if (source is None or target is None) and named is None:
        raise ValueError("give source and target language, or name the task translation_xx_to_yy")
    return (named[1] if source is None else source.split("_")[0],
            named[2] if target is None else target.split("_")[0])


def translation_pairs(df: DataFrame, task: str = "translation", source_lang: str | None = None,
                      target_lang: str | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """Two sides of a ``translation`` struct or map as ``text`` and ``summary``."""
    source, target = resolve_languages(task, source_lang, target_lang)
    record = F.col("translation")
    return df.select(*keys, record.getItem(source).alias("text"), record.getItem(target).alias("summary"))


def head(df: DataFrame, n: int | None, order_by: str | Column | Sequence[str | Column]) -> DataFrame:
    """The first ``n`` rows in a stated order; all rows when ``n`` is None.

    The last key of the head is found on the keys alone; rows behind it are then filtered away before whole rows are
    ordered. Keys with a direction of their own have no such comparison: then each task keeps its first ``n`` rows.
    """
    if n is None or n <= 0:
        return df if n is None else df.limit(0)
    keys = [F.col(k) if isinstance(k, str) else k for k in ([order_by] if isinstance(order_by, (str, Column)) else list(order_by))]
    if any(DIRECTION.search(str(k)) for k in keys):
        return df.orderBy(*keys).limit(n)
    named = [k.alias(f"k{i}") for i, k in enumerate(keys)]
    cut = df.select(*named).orderBy(*(f"k{i}" for i in range(len(keys)))).limit(n).agg(
        F.count("*").alias("n"), F.max(F.struct(*(f"k{i}" for i in range(len(keys))))).alias("last")).first()
    if cut.n < n:
        return df.orderBy(*keys)
    return df.where(F.struct(*named) <= F.struct(*(F.lit(v).alias(f"k{i}") for i, v in enumerate(cut["last"])))).orderBy(*keys).limit(n)


def sample_counts(df: DataFrame, max_samples: int | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """How many samples are used: the rows, or the limit where that is smaller."""
    rows = F.count("*")
    used = rows if max_samples is None else F.least(rows, F.lit(max_samples).cast("long"))
    return df.groupBy(*by).agg(used.alias("samples"))
