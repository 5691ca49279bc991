"""Distributed union-find on an edge table, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.scratch import Scratch


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, root) of each vertex of ``edges(a, b)``; root is the least id that can be reached.

    Each round does a large-star and then a small-star step: the neighbours of
    a vertex are hung below the least of them.  The number of edges never
    grows, rows of one vertex are only grouped for a ``min`` (which Spark
    pre-aggregates) that is stored and joined back, and the depth at least halves, so
    rounds grow with the logarithm of the longest path.  Null ids and loops
    are ignored; no edges give an empty table.
    """
    spark = edges.sparkSession
    kind = edges.schema["a"].dataType
    work = Scratch(spark)
    edges = edges.select(F.col("a").cast(kind).alias("a"), F.col("b").cast(kind).alias("b"))
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = work.store(edges, "edges0")
    # Large star of u: every neighbour above u points to u's least neighbour (or u).
    # The minima are stored before they are joined back, so that Spark can split the rows of a star's centre among tasks.
    for i in range(rounds):
        both = edges.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(edges.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = work.store(both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m")), f"least{i}")
        large = edges.join(least.withColumnRenamed("x", "v"), "v").select("u", F.col("m").alias("v"))
        large = work.store(large.where("u <> v").distinct(), f"large{i}")
        # Small star: v's with the same u all point to the least of them.
        low = work.store(large.groupBy("u").agg(F.min("v").alias("m")), f"low{i}")
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        new = work.store(small.where("u <> v").distinct(), f"edges{i + 1}")
        # Done when every edge leads straight to a root: no vertex is both below and above, and each has one parent.
        tops = new.groupBy("u").agg(F.count("*").alias("n"))
        open_ = new.join(tops.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count() or tops.where("n > 1").limit(1).count()
        work.release(f"edges{i}", f"least{i}", f"large{i}", f"low{i}")
        edges = new
        if not open_:
            break
    else:
        raise RuntimeError("union-find did not settle")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
