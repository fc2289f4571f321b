"""Connected components of an edge table: blocks of edges contracted in tasks, then alternating star contraction."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldhouse.llm.util import removed, written

#: Edges that one task contracts, about.
BLOCK = 100_000


def _contracted(edges: DataFrame) -> DataFrame:
    """(v, u): each node of a partition's edges with the smallest node that it reaches through them, if that is another."""

    def run(batches):
        head: dict[int, int] = {}

        def root(x: int) -> int:
            top = x
            while (up := head.get(top, top)) != top:
                top = up
            while (up := head.get(x, x)) != top:
                head[x], x = top, up
            return top

        for batch in batches:
            for v, u in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = root(v), root(u)
                if a != b:
                    head[max(a, b)] = min(a, b)
        nodes = list(head)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], names=["v", "u"])

    return edges.mapInArrow(run, "v long, u long")


def components(edges: DataFrame, a: str = "a", b: str = "b", block: int = BLOCK) -> DataFrame:
    """(node, component): every node of an edge that joins two nodes, with the smallest node that it can reach.

    The edges are dealt out in blocks, and each block is contracted to stars in one task; a single block is then done. The
    stars of several blocks are joined by rounds: each hangs every node's larger neighbours, then its smaller ones, on the
    smallest it knows, and stores the edges in the shared folder. Rounds grow with the logarithm of the longest chain of
    stars; a round aggregates minima by node and joins them back, so a node with very many neighbours is a skewed join, not
    a gathered group."""
    first = written(edges.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("u")).filter("u <> v").distinct(), "edges")
    blocks = max(1, -(-first.count() // block))
    now = written(_contracted(first.repartition(blocks)), "edges")
    removed(first)
    seen = None
    while blocks > 1:
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")).first()
        if mark == seen:
            break
        seen, before = mark, now
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("x"), F.col("m").alias("y"))
        large = large.filter("x <> y").distinct().select(F.greatest("x", "y").alias("v"), F.least("x", "y").alias("u"))
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v")
        now = written(small.select("v", F.col("m").alias("u")).unionByName(small.filter("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u"))).distinct(), "edges")
        removed(before)
    return now.select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(now.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())
