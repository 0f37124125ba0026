"""Connected components over edges, as rounds of grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import saved


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) for every node of ``edges`` (a, b: two longs).

    Each round links every node's larger neighbours to its smallest one, then its smaller ones (large and small stars):
    the rounds grow with the logarithm of the longest path, and every round's edges are written to shared storage.
    Neighbour sets are never gathered: a round is a grouped minimum and an equi-join, which can be split on skew.
    """
    edges = saved(edges.filter("a <> b").selectExpr("greatest(a, b) a", "least(a, b) b").distinct(), "edges")
    while True:
        both = edges.union(edges.selectExpr("b a", "a b"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(low, "a").selectExpr("b a", "m b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(down, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")),
                                                               F.struct(F.col("b").alias("a"), F.col("m").alias("b"))))
                                              .alias("e")).select("e.*").filter("a <> b").distinct())
        new = saved(small, "edges")
        # done when the edges are stars: no node is both a child and a parent, and no child has two parents
        children = new.select("a")
        open_ = new.select(F.col("b").alias("a")).distinct().join(children.distinct(), "a").limit(1).count() \
            or new.groupBy("a").count().filter("count > 1").limit(1).count()
        edges = new
        if not open_:
            return edges.selectExpr("a node", "b root").union(edges.selectExpr("b node", "b root").distinct())
