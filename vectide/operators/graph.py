"""Graphs as edges, and node embeddings by iterated sparse random projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectide.storage import written


def adjacency(edges: DataFrame, directed: bool = False) -> DataFrame:
    """(src, dst, weight), weights of equal edges summed up; an undirected graph has each edge both ways."""
    e = edges.select("src", "dst", F.col("weight").cast("double").alias("weight"))
    if not directed:
        e = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    return e.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def projection(node: Column, d: Column) -> Column:
    """An entry of the sparse random projection: sqrt(3) x (1, 0, -1) with odds 1:4:1, from a hash of node and dimension."""
    r = F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", node.cast("string"), d.cast("string"))), 1, 8), 16, 10).cast("bigint"), F.lit(6))
    return F.when(r == 0, F.sqrt(F.lit(3.0))).when(r == 1, -F.sqrt(F.lit(3.0))).otherwise(F.lit(0.0))


def fastrp(edges: DataFrame, dimension: int = 64, weights: tuple[float, ...] = (0.1, 0.2, 1.0, 3.0), beta: float = 0.0, digits: int | None = None) -> DataFrame:
    """(node, d, value): the weighted sum of the powers of the adjacency matrix applied to a random projection.

    One row a node and dimension, so a node of many edges is summed map-side like any other. Each power is a join on the edges'
    end and an aggregation, written out before the next.
    """
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    degree = edges.groupBy(F.col("src").alias("node")).agg(F.sum("weight").alias("degree"))
    n = nodes.agg(F.count("*").alias("n"))
    scale = nodes.join(degree, "node", "left").crossJoin(F.broadcast(n)).select("node", (0.5 * F.pow(F.coalesce("degree", F.lit(0.0)), F.lit(beta)) / F.col("n")).alias("scale"))
    start = scale.crossJoin(F.broadcast(nodes.sparkSession.range(dimension).select(F.col("id").cast("int").alias("d")))).select("node", "d", (F.col("scale") * projection(F.col("node"), F.col("d"))).alias("x"))
    out = None
    power = start.where("x != 0")
    for k, w in enumerate(weights):
        power = edges.join(power.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node"), "d").agg(F.sum(F.col("weight") * F.col("x")).alias("x"))
        if k < len(weights) - 1:
            power = written(power, f"power{k}")
        part = power.select("node", "d", (F.lit(w) * F.col("x")).alias("x"))
        out = part if out is None else out.unionByName(part)
    value = F.sum("x")
    return out.groupBy("node", "d").agg((value if digits is None else F.round(value, digits)).alias("value"))
