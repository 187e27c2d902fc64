"""Connected components of an edge table, on Spark only."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from parcelspark.llm.store import stored


def connected_components(edges: DataFrame) -> DataFrame:
    """Smallest reachable id of every node of ``edges(a, b)`` (longs), as ``(node, component)``.

    Alternating large-star and small-star steps (Kiveris et al., 2014): each step replaces the
    edges of a node by edges to the smallest neighbour, until all edges point at component roots.
    Minima are partial aggregates and the joins are plain equi-joins that adaptive execution can
    split, so a hub with very many edges does not meet in one task. Every step is written to the
    shared folder. Null ends and self loops are ignored; an empty table gives an empty result.
    """
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                 .distinct(), "edges")
    before = None
    while True:
        # after a full round all edges are (member, root); unchanged edges mean convergence
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or state[0] == 0:
            break
        before = state
        # the minima are stored, so that each join reads two plain exchanges and a hub can be split
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
        large = stored(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")), "large")
        # large-star edges run from the larger end (u) to a smaller one (v)
        least = stored(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = (large.join(least, "u")
                 .select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
                                           F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
                 .select("e.u", "e.v").where("u <> v").distinct())
        now = stored(small, "edges")
    members = now.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return members.union(roots)
