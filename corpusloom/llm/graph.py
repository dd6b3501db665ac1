"""Connected components over a DataFrame of edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import cut

#: Edges of a checkpoint's file at least, unless there are fewer files than cores: each file of a local folder has the executor start two processes (chmod).
FILE_EDGES = 200_000


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) of longs -> node, root (the smallest node of its component); nodes without edges don't appear.

    Each round leaves every node nearer to its smallest reachable node; rounds grow with the logarithm of the
    size, not with the diameter. Neighbourhoods are never gathered: only their minima are.
    """
    now = cut(edges.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    while True:
        mark = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if mark == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen = mark
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        files = max(edges.sparkSession.sparkContext.defaultParallelism, -(-mark["n"] // FILE_EDGES))
        now = cut(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct().coalesce(files))
