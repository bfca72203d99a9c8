"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.session import fresh_folder
from weftline.sources.tables import remove


def _only_stars(edges: DataFrame) -> bool:
    """Whether every node has one edge to a smaller one at most, and none from a larger one beside it: a further round changes nothing."""
    ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(
        edges.select(F.col("v").alias("id"), F.lit(0).alias("down"), F.lit(1).alias("up"))
    )
    return ends.groupBy("id").agg(F.sum("down").alias("down"), F.max("up").alias("up")).filter("down > 1 or (down = 1 and up = 1)").isEmpty()


def components(edges: DataFrame, name: str = "graph") -> DataFrame:
    """id, label for every node of the edges (u, v): the label is the smallest id that the node reaches.

    Each round's edges are written and read again, and the tables before them are removed. A node with many neighbours is
    reduced by partial sums and joined by merge joins that split it, and no neighbourhood is ever gathered.
    """
    spark, paths = edges.sparkSession, []

    def stored(df: DataFrame) -> DataFrame:
        paths.append(fresh_folder(spark, name))
        df.write.parquet(paths[-1])
        for old in paths[:-1]:
            remove(spark, old)
        del paths[:-1]
        return spark.read.parquet(paths[-1])

    now = stored(edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while not _only_stars(now):
        # Large star: every node sends its larger neighbours to its smallest neighbour or itself.
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = stored(both.filter("v > u").join(least.hint("merge"), "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        # Small star: every node sends its smaller neighbours and itself to the smallest of them.
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(root.hint("merge"), "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = stored(small.unionByName(root.select("u", F.col("m").alias("v"))).distinct())
    roots = now.select(F.col("v").alias("id")).distinct().withColumn("label", F.col("id"))
    return now.select(F.col("u").alias("id"), F.col("v").alias("label")).unionByName(roots)
