"""Connected components of an edge table by large-star and small-star steps, in DataFrame joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Written


def _links(a: str, b: str):
    return F.struct(F.col(a).alias("u"), F.col(b).alias("v"))


def _both(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(_links("u", "v"), _links("v", "u"))).alias("e")).select("e.u", "e.v")


def _sum(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]


def components(edges: DataFrame) -> DataFrame:
    """edges(u, v) of longs -> node, component: the least node that each node reaches. Nodes without an edge to another aren't listed.

    Each step keeps the components, and hangs neighbours on the least node that they see. The minima are partial
    aggregates; the joins on a node with many edges are ones that adaptive execution splits. The number of steps is
    logarithmic in a component's size."""
    now = Written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = _sum(now.df)
    while seen[0]:
        both = _both(now.df)
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: larger neighbours go to the least
        large = Written(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "edges")
        # small star: smaller neighbours and the node itself go to the least
        mins = large.df.groupBy("u").agg(F.min("v").alias("m"))
        down = large.df.join(mins, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(mins.select("u", F.col("m").alias("v")))
        after = Written(down.where("u <> v").distinct(), "edges")
        now.drop()
        large.drop()
        now, before = after, seen
        seen = _sum(now.df)
        if seen == before:
            break
    return now.df.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.df.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
