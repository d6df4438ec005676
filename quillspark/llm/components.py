"""Connected components by alternating stars, on DataFrames alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import discard, materialize


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node and component (the smallest node it is linked with) for every node of edges(a, b).

    An edge is kept as (hi, lo). A small star ties all lower neighbours of a node, and the node, to the least of
    them; a large star hands a node's higher neighbours on to its own least neighbour. Both keep components, and
    repeated edges fall together, so a node with many edges costs them once and one edge in later rounds. When each
    node has one lower neighbour, which itself has none, that is its component. Each step is written to the shared
    folder. Edges with a null end are ignored; no edges give no rows; more rounds than `rounds` raise an error.
    """
    low, high = F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")
    now = materialize(edges.where("a is not null and b is not null and a <> b").select(high, low).distinct(), "edges")
    for _ in range(rounds):
        least = now.groupBy(F.col("hi").alias("of")).agg(F.min("lo").alias("least"))
        pair = lambda hi: F.struct(F.col(hi).alias("hi"), F.col("least").alias("lo"))
        small = now.join(least, F.col("hi") == F.col("of")).select(
            F.explode(F.when(F.col("lo") == F.col("least"), F.array(pair("hi"))).otherwise(F.array(pair("hi"), pair("lo")))).alias("e"))
        tied = materialize(small.select("e.hi", "e.lo").distinct(), "edges")
        least = tied.groupBy(F.col("hi").alias("of")).agg(F.min("lo").alias("least"))
        large = tied.join(least, F.col("lo") == F.col("of"), "left").select("hi", F.coalesce("least", "lo").alias("lo"), F.col("least").isNotNull().alias("moved"))
        after = materialize(large.groupBy("hi", "lo").agg(F.max("moved").alias("moved")), "edges")
        discard(now, tied)
        now = after
        state = now.agg(F.count_if("moved").alias("moved"), F.count(F.lit(1)).alias("n"), F.count_distinct("hi").alias("nodes")).first()
        if not state["moved"] and state["n"] == state["nodes"]:
            roots = now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
            return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(roots)
    raise RuntimeError(f"components did not settle in {rounds} rounds")
