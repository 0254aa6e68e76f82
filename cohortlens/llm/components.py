"""Connected components by alternating large-star and small-star rounds, as DataFrame operations.

A round rewires every edge to the smallest neighbour, so depth falls quickly; rounds end when the edges no longer
change. Each round's tables are written to the shared folder, so lineage stays short, and both sides of each join are
plain shuffles, which adaptive execution can split where one node has very many edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.base import written


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges (a, b), of any orderable type -> (id, component): component is the smallest id that can be reached.

    Only ids with an edge to another id appear. Nulls, self edges and repeated edges are allowed and mean nothing. An
    empty table gives an empty table.
    """
    e = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = written(e, "edges")
    mark = _mark(e)
    for _ in range(max_rounds):
        if not mark[0]:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = written(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))  # used twice, but its exchange is run once
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        before, mark = mark, _mark(e)
        if mark == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
