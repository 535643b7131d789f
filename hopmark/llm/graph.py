"""Connected components by alternating stars, over edges of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopmark.llm.common import stored


def _minima(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("m"))


def connected_components(edges: DataFrame) -> DataFrame:
    """Edges (a long, b long) to (node, component): component is the smallest node that can be reached.

    Large-star hangs the larger neighbours of each node on its smallest one, small-star the smaller ones; the rounds end
    when a round changes no edge, after a number of rounds that grows with the logarithm of the longest path. Minima
    are aggregated before they are joined back, from a table of their own, so that the join can split a node with many
    neighbours; each round's edges are written to the shared folder, which cuts the lineage. Loops and repeated edges do no harm; nulls are
    dropped; no edges give no rows.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    e = stored(e, "edges")
    before = None
    while True:
        state = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before or not state[0]:
            break
        before = state
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = stored(_minima(both).select("u", F.least("u", "m").alias("m")), "minima")
        large = both.where("v > u").join(m, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.where("u <> v").distinct(), "edges")
        m = stored(_minima(large), "minima")
        small = large.join(m, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(m.select("u", F.col("m").alias("v")))
        small = small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        e = stored(small.where("u <> v").distinct(), "edges")
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
