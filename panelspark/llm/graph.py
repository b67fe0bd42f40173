"""Connected components as a DataFrame iteration (alternating large-star and small-star contraction)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from panelspark.llm.common import scratch_table


def connected_components(links: DataFrame) -> DataFrame:
    """(u, v) links -> one row (node, component) per linked node; component is the smallest node reachable.

    Each round rewires every node to the smallest neighbour it knows, first the larger neighbours, then the
    smaller ones, until nothing changes: about log(longest path) rounds. Only minima are aggregated, so a node
    with very many links costs one pre-aggregated row per task. Loops (u = v) and null ends are ignored.
    """
    edges = scratch_table(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                          .filter("u is not null and v is not null and u <> v").distinct(), "edges", narrow=True)
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        # every larger neighbour of a node goes to the smallest that the node knows
        star = scratch_table(edges.select(F.col("v").alias("u"), F.col("u").alias("w")).join(low, "u")
                             .select(F.col("w").alias("u"), F.least("u", "m").alias("v")), "stars", narrow=True)
        # then all smaller neighbours of a node go to the smallest of them
        low = star.groupBy("u").agg(F.min("v").alias("m"))
        edges = scratch_table(star.join(low, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
                              .select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).filter("u <> v").distinct(), "edges", narrow=True)
        # done when every node has one edge, to a node that has none
        ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("out"), F.lit(0).alias("into")) \
            .union(edges.select(F.col("v").alias("n"), F.lit(0).alias("out"), F.lit(1).alias("into")))
        if ends.groupBy("n").agg(F.sum("out").alias("out"), F.max("into").alias("into")).filter("out + into > 1").isEmpty():
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
