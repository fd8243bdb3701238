"""Connected components of a graph held as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(links: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(v, root) for each end of ``links`` (a, b): root is the same for all of a component.

    Each round every vertex points to its smallest neighbour, pointers are followed twice, and links are rewritten
    between what their ends point to; a component's vertices at least halve, so rounds grow with the logarithm of the
    longest chain.  Nothing of the graph visits the driver but a count; a vertex with very many links is met by partial
    aggregation and by joins that Spark can split.
    """
    links = materialize(links.select("a", "b").where("a <> b").distinct(), "links")
    labels = None
    for _ in range(max_rounds):
        if links.isEmpty():
            break
        ends = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        point = materialize(ends.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("p")), "points")
        for _ in range(2):
            point = point.join(point.select(F.col("v").alias("p"), F.col("p").alias("q")), "p").select("v", F.col("q").alias("p"))
        point = materialize(point, "points")
        if labels is None:
            labels = point.withColumnRenamed("p", "root")
        else:
            labels = materialize(labels.join(point.withColumnRenamed("v", "root"), "root", "left").select("v", F.coalesce("p", "root").alias("root")), "labels")
        side = lambda name: point.select(F.col("v").alias(name), F.col("p").alias(f"{name}2"))
        links = materialize(links.join(side("a"), "a").join(side("b"), "b").select(F.col("a2").alias("a"), F.col("b2").alias("b")).where("a <> b").distinct(), "links")
    else:
        raise RuntimeError(f"links are left after {max_rounds} rounds")
    if labels is None:
        return links.select(F.col("a").alias("v"), F.col("b").alias("root"))
    return labels
