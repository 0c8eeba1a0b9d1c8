"""Connected components of an edge table by alternating large and small stars."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import stored


def _downward(edges: DataFrame) -> DataFrame:
    """Each edge once, from its larger to its smaller end; no loops."""
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _digest(edges: DataFrame) -> tuple[int, int | None]:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(vertex, root) of every vertex that is not the smallest of its component, from edges (a, b) of bigints.

    A round hooks every neighbour on the smallest neighbour, first upwards, then downwards; rounds are
    logarithmic in the size of a component. The smallest neighbour of each vertex is a pre-aggregated minimum,
    written before it is joined back: a vertex with very many edges is then a large shuffle partition that can
    be split. Every round is written to the shared folder, which also ends its lineage.
    """
    now = stored(_downward(edges), "edges")
    state = _digest(now)
    while True:
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stored(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m")), "least")
        up = now.select(F.col("b").alias("a"), F.col("a").alias("b")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        up = stored(_downward(up), "up")
        least = stored(up.groupBy("a").agg(F.min("b").alias("m")), "least")
        down = up.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b")))
        now = stored(_downward(down), "edges")
        if (then := _digest(now)) == state:
            return now.select(F.col("a").alias("vertex"), F.col("b").alias("root"))
        state = then
