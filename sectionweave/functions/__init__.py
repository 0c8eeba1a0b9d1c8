"""Column expressions and Arrow UDFs."""

from pyspark.sql import SparkSession

SQL_NAMES = ("lcs_len", "summary_lcs", "section_lcs", "stem_text")


def register_functions(spark: SparkSession) -> None:
    """Make the Arrow UDFs callable from SQL; they take normalized text."""
    from . import lcs, stem

    for name in SQL_NAMES:
        spark.udf.register(name, getattr(lcs, name, None) or getattr(stem, name))
