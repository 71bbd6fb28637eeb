"""Connected components of an edge table, without gathering it anywhere.

Alternating large-star and small-star rounds (Kiveris et al., 2014); each round
is written to the shared folder, so lineage stays short and lost executors cost
one round at most. A node with very many edges is the single row of the side
that is joined to them, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataleaf.llm.frames import forget, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges u-v with u > v, relinked to the least neighbour of u (large: of either end)."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        out = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        out = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = out.where("u != v").unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u != v").distinct()


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def components(links: DataFrame) -> DataFrame:
    """node, component (least node reachable) for every end of links (a, b); written to the shared folder."""
    edges = links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = written(edges, "edges")
    state = _state(edges)
    while state[0]:
        new = written(_star(_star(edges, True), False), "edges")
        forget(edges)
        edges, before, state = new, state, _state(new)
        if state == before:
            break
    # Every edge now points at the least node of its component.
    ends = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return ends.unionByName(roots)
