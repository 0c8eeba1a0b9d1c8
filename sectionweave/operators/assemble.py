"""Section outputs back to one text per article."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def assemble(rows: DataFrame, select_sections: Sequence[str] | None = None) -> DataFrame:
    """Join the generated texts of an article with spaces, in section order.

    Rows without id or target belong to no group. A digest stands for the target in the key. The result holds
    one whole text per article, so a group is only ever as large as the text it becomes.
    """
    if select_sections is not None:
        rows = rows.where(F.col("section_id").isin(*select_sections))
    pieces = F.array_sort(F.collect_list(F.struct("section_idx", "gen_sum")))
    return (
        rows.where(F.col("article_id").isNotNull() & F.col("target_sum").isNotNull())
        .groupBy("article_id", F.md5("target_sum").alias("target_key"))
        .agg(F.first("target_sum").alias("target_sum"), F.concat_ws(" ", F.transform(pieces, lambda p: p["gen_sum"])).alias("gen_sum"))
        .drop("target_key")
    )
