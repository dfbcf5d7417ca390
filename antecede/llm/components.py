"""Connected components of an edge table, by alternating star operations."""

from pyspark.sql import DataFrame, functions as F

from antecede.session import written


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest node around it instead."""
    near = _both_ways(edges)
    low = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = near.filter(F.col("v") > F.col("u")).join(low, "u")
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    own = low.select("u", F.col("m").alias("v"))
    rest = down.join(low, "u").filter(F.col("v") > F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return own.unionByName(rest).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every node is smaller than all around it or has but one edge, to a smaller one."""
    near = _both_ways(edges).groupBy("u").agg(F.min("v").alias("low"), F.count(F.lit(1)).alias("n"))
    return near.filter("low < u and n > 1").isEmpty()


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, component): for every node with an edge, the smallest node it is connected to.

    Alternates the two star steps until all edges lead to the root; the number of rounds is logarithmic in
    practice and each is written to the shared folder, so a lost executor costs one round at
    most. No round has more edges than the one before, and a hot node's edges are grouped by
    partial minima and joined back (Spark splits the join where it is skewed). Loops and
    repeated edges are allowed; edges with a null end are left out. The type of nodes is free.
    """
    now = edges.select(F.col(u).alias("u"), F.col(v).alias("v")).filter(F.col("u") != F.col("v"))
    now = written(now.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while not _settled(now):
        now = written(_small_star(_large_star(now)), "edges")
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
