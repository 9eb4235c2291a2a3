"""Connected components of an edge table of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.folders import remove, settle_at


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of ``edges`` (a, b: long) that has a neighbour; the label is the
    component's smallest node.

    Large stars (every larger neighbour to the smallest node around) and small stars (every smaller
    one) alternate until the edges stay the same; a component of n nodes takes about log n rounds.
    Each round is written to the shared folder, so plans don't grow.
    """
    spark = edges.sparkSession
    now, path = settle_at(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        # Combining aggregates and joins: a node of any number of neighbours isn't one task's.
        both = now.union(now.select("b", "a"))
        large = both.where("b > a").join(both.groupBy("a").agg(F.min("b").alias("m")), "a").select(F.col("b").alias("a"), F.least("m", "a").alias("b")).where("a <> b").distinct()
        starred = large.join(large.groupBy("a").agg(F.min("b").alias("m")), "a")
        small = starred.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        then, new = settle_at(small.where("a <> b").distinct(), "edges")
        said = then.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        remove(spark, path)
        now, path = then, new
        if said == before or said[0] == 0:
            return now.select(F.col("a").alias("node"), F.col("b").alias("label")).union(now.select("b", "b").distinct())
        before = said
