"""Tables and reports out."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import export_text, strip
from ..schemas import SPLITS

# Report names of metrics and statistics, in report order.
REPORT_NAMES = {"rouge1": "1", "rouge2": "2", "rougeL": "l"}
STATISTIC_NAMES = {"fmeasure": "f_score", "recall": "recall", "precision": "precision"}
REPORT_LINE = "%s: %.4f with confidence interval (%.4f, %.4f)"


def task_path(root: str, task: str) -> str:
    return f"{root.rstrip('/')}/processed/{task}"


def write_splits(rows: DataFrame, root: str, task: str, names: tuple[str, ...] = SPLITS, fmt: str = "json") -> None:
    """One directory per split under ``processed/<task>``, replaced if present.

    Split is a literal of each input branch, so writing one split reads only that
    split's files. Many part files stay many: read the directory back as a whole.
    """
    for name in names:
        part = rows.where(F.col("split") == name).drop("split")
        part.write.mode("overwrite").format(fmt).save(f"{task_path(root, task)}/{name}")


def export_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs as an outside scorer reads them: one line each, without line markers."""
    keys = [c for c in pairs.columns if c not in ("target_sum", "gen_sum")]
    return pairs.select(*keys, *(export_text(F.col(c)).alias(c) for c in ("target_sum", "gen_sum")))


def write_pairs(pairs: DataFrame, path: str, order_by: Sequence[str] = ()) -> None:
    """Exported pairs as JSON lines; ``order_by`` range-sorts the files, which read back in order by name."""
    pairs = export_pairs(pairs)
    (pairs.orderBy(*order_by) if order_by else pairs).write.mode("overwrite").json(path)


def _position(column: Column, names: dict[str, str]) -> Column:
    return F.array_position(F.array(*map(F.lit, names)), column)


def _named(column: Column, names: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[column]


def report_text(ci: DataFrame) -> DataFrame:
    """The interval report as one text value: a block per metric, a line per statistic."""
    short = _named(F.col("metric"), REPORT_NAMES)
    key = F.concat(F.lit("rouge_"), short, F.lit("_"), _named(F.col("statistic"), STATISTIC_NAMES))
    lines = ci.select(
        F.struct(_position(F.col("metric"), REPORT_NAMES).alias("m"),
                 _position(F.col("statistic"), STATISTIC_NAMES).alias("s"),
                 F.concat(F.when(F.col("statistic") == "fmeasure", F.concat(F.lit("\nROUGE-"), short, F.lit(":\n")))
                          .otherwise(F.lit("")), F.format_string(REPORT_LINE, key, "value", "lo", "hi")).alias("line")
                 ).alias("entry"))
    # Nine rows: three metrics by three statistics.
    return lines.agg(F.array_join(F.transform(F.array_sort(F.collect_list("entry")), lambda e: e["line"]), "\n")
                     .alias("value"))


def write_report(ci: DataFrame, path: str) -> None:
    report_text(ci).write.mode("overwrite").text(path)


def prediction_lines(df: DataFrame, column: str = "gen_sum") -> DataFrame:
    """Stripped predictions, one per line; line breaks inside a text become spaces."""
    return df.select(F.regexp_replace(strip(F.col(column)), r"\R", " ").alias("value"))


def write_predictions(df: DataFrame, path: str, column: str = "gen_sum", order_by: str | None = None) -> None:
    ordered = df if order_by is None else df.orderBy(order_by)
    prediction_lines(ordered, column).write.mode("overwrite").text(path)
