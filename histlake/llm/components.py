"""Connected components of a graph of ids, by alternating large-star and small-star.

Each step is an aggregate with partial sums before its shuffle and a join that
AQE splits where one node has most edges; no adjacency list is ever gathered.
Steps are written to the shared folder, so lineage stays short and a lost
executor costs only its own tasks.

Defined cases: repeated edges and both directions of one are one edge; loops and
edges with a null end link nothing; nodes without edges are absent; a table
without edges gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import delete, settle


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to its smallest one."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("m", "u").alias("m"))
    return both.where("v > u").join(least, F.col("u") == F.col("node")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node links itself and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    near = down.join(least.select(F.col("u").alias("node"), "m"), F.col("u") == F.col("node")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return near.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _mark(edges: DataFrame) -> tuple:
    """A mark of a set of edges: equal sets have equal marks."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, folder: str, name: str = "components", most: int = 60) -> DataFrame:
    """node, component: the smallest id that each node of edges (u, v) reaches; nodes without edges are absent."""
    now = settle(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), folder, f"{name}-0")
    mark = _mark(now)
    for i in range(1, most):
        new = settle(_small_star(_large_star(now)), folder, f"{name}-{i}")
        delete(edges.sparkSession, f"{folder}/{name}-{i - 1}")
        now, before, mark = new, mark, _mark(new)
        if mark == before:
            roots = now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
    raise RuntimeError(f"components did not settle in {most} steps")
