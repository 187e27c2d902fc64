"""Exact group medians that stay distributed when one group holds a large share of all rows.

Spark's built-in ``median``/``percentile`` is exact but keeps a value->count map per group and
merges it in one task, so a group holding a third of a 100 TB table would be finished by one task.
``exact_medians`` therefore splits the groups by size:

* groups with at most ``HOT_GROUP_ROWS`` rows (nearly all streets, buildings, district-years)
  use the built-in aggregate: one hash aggregate whose per-group state is bounded;
* hot groups (found with an exact row count per group; there are at most rows / bound of them)
  use rank selection over a range-partitioned sort (``rank_medians``):

1. unpivot the value columns to ``(keys, m, v)`` rows (one sort for all medians at once) and
   pre-aggregate equal values to ``(keys, m, v, w)`` (map-side combine, hashed on the value, so a
   hot group is spread over all tasks);
2. ``repartitionByRange(keys, m, v)``: the sampled range bounds split a hot group over many
   partitions by value; each partition holds one contiguous run of the global order; the
   partition id becomes the block number. This table is checkpointed to the shared checkpoint
   folder so that both uses below see one block numbering, also after an executor is lost;
3. cumulative weights inside ``(block, keys, m)`` come from a window whose partitions are bounded
   by one shuffle partition, never by a group;
4. block sizes (at most #groups + #partitions rows) give each block's rank offset through a window
   per group ordered by block (at most #partitions rows per group);
5. keep the rows covering global ranks ``(n+1) div 2`` and ``n div 2 + 1`` and average them,
   which is the interpolated median (pandas / DuckDB ``median``).

"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir


# Groups above this many rows take the distributed rank-selection path.
HOT_GROUP_ROWS = 1_000_000


def exact_medians(df: DataFrame, keys: list[str], values: dict[str, str],
                  hot_rows: int | None = None, aggs: tuple = ()) -> DataFrame:
    """Exact median of each ``values`` column (``out_name -> input column``) per ``keys``, and other
    aggregates ``aggs`` of bounded state.

    Returns one row per group with columns ``keys``, the aggregates and ``list(values)`` (NULL where a group
    has no non-null value). Small groups go through the built-in aggregate, hot groups through
    ``rank_medians``; which groups are hot does not change the result. Keys must not be NULL. An input with
    no more rows than the bound has no hot group: one count without a shuffle tells.
    """
    hot_rows = HOT_GROUP_ROWS if hot_rows is None else hot_rows
    if df.count() <= hot_rows:
        return small_group_medians(df, keys, values, aggs)
    if not keys:
        ranked = rank_medians(df, keys, values)
        return df.agg(*aggs).crossJoin(ranked) if aggs else ranked      # one row each
    hot = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > hot_rows).select(*keys)
    if hot.isEmpty():
        return small_group_medians(df, keys, values, aggs)
    cold = df.join(hot, keys, "left_anti")
    warm = df.join(hot, keys, "left_semi")
    # a hot group without any value has no rank: the group list brings it back with NULLs
    groups = warm.groupBy(*keys).agg(*aggs) if aggs else hot
    ranked = groups.join(rank_medians(warm, keys, values), keys, "left").select(*groups.columns, *values)
    return small_group_medians(cold, keys, values, aggs).unionByName(ranked)


def rank_medians(df: DataFrame, keys: list[str], values: dict[str, str]) -> DataFrame:
    """Exact medians by rank selection over a range-partitioned sort (see module docstring);
    no group is ever held by a single task."""
    names = list(values)
    pairs = [F.struct(F.lit(i).alias("m"), F.col(c).cast("double").alias("v"))
             for i, c in enumerate(values.values())]
    long = (df.select(*keys, F.explode(F.array(*pairs)).alias("_mv"))
              .select(*keys, F.col("_mv.m").alias("_m"), F.col("_mv.v").alias("_v"))
              .where(F.col("_v").isNotNull() & ~F.isnan("_v")))
    weighted = long.groupBy(*keys, "_m", "_v").agg(F.count(F.lit(1)).alias("_w"))
    return rank_weighted(weighted, keys, names)


def rank_weighted(weighted: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Steps 2 to 5 of the rank selection on pre-aggregated rows ``(keys, _m, _v, _w)``: value ``_v`` of
    metric number ``_m`` occurs ``_w`` times. One median per name, in the order of the numbers."""
    checkpoint_dir(weighted.sparkSession)
    ranged = (weighted.repartitionByRange(*keys, "_m", "_v")
                      .withColumn("_blk", F.spark_partition_id())
                      .checkpoint(eager=True))

    block_key = ["_blk", *keys, "_m"]
    running = Window.partitionBy(*block_key).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = ranged.withColumn("_hi", F.sum("_w").over(running))

    per_group = Window.partitionBy(*keys, "_m")
    blocks = (ranged.groupBy(*block_key).agg(F.sum("_w").alias("_cnt"))
              .withColumn("_before", F.sum("_cnt").over(per_group.orderBy("_blk")) - F.col("_cnt"))
              .withColumn("_n", F.sum("_cnt").over(per_group))
              .withColumn("_r1", F.expr("(_n + 1) div 2") - F.col("_before"))
              .withColumn("_r2", F.expr("_n div 2 + 1") - F.col("_before"))
              .where(((F.col("_r1") >= 1) & (F.col("_r1") <= F.col("_cnt")))
                     | ((F.col("_r2") >= 1) & (F.col("_r2") <= F.col("_cnt"))))
              .select(*block_key, "_r1", "_r2"))

    lo = F.col("_hi") - F.col("_w") + 1
    covers = lambda r: (F.col(r) >= lo) & (F.col(r) <= F.col("_hi"))
    middle = ranked.join(blocks, block_key).where(covers("_r1") | covers("_r2"))
    return middle.groupBy(*keys).agg(
        *[F.avg(F.when(F.col("_m") == i, F.col("_v"))).alias(name) for i, name in enumerate(names)])


def median_of(col: str) -> Column:
    """Built-in exact median of a column, NaN left out."""
    value = F.col(col).cast("double")
    return F.median(F.when(~F.isnan(value), value))


def small_group_medians(df: DataFrame, keys: list[str], values: dict[str, str], aggs: tuple = ()) -> DataFrame:
    """Built-in exact ``median`` per group; use only where group sizes are bounded."""
    medians = [median_of(c).alias(name) for name, c in values.items()]
    return df.groupBy(*keys).agg(*aggs, *medians) if keys else df.agg(*aggs, *medians)


def kth_smallest(df: DataFrame, col: str, k_from_n) -> DataFrame:
    """One-row DataFrame ``(n, value)``: the k-th smallest non-null value (1-based), with
    ``k_from_n`` a function of the count Column, by the same rank selection as the medians: equal
    values are pre-aggregated, then ranked inside range partitions. ``value`` is NULL without
    values."""
    v = F.col(col).cast("double")
    values = df.select(v.alias("_v")).where(F.col("_v").isNotNull())
    checkpoint_dir(df.sparkSession)
    weighted = values.groupBy("_v").agg(F.count(F.lit(1)).alias("_w"))
    ranged = (weighted.repartitionByRange("_v").withColumn("_blk", F.spark_partition_id())
                      .checkpoint(eager=True))
    n = ranged.agg(F.coalesce(F.sum("_w"), F.lit(0))).first()[0]
    running = Window.partitionBy("_blk").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = ranged.withColumn("_hi", F.sum("_w").over(running))
    blocks = (ranged.groupBy("_blk").agg(F.sum("_w").alias("_cnt"))
              .withColumn("_before", F.sum("_cnt").over(Window.orderBy("_blk")) - F.col("_cnt"))
              .withColumn("_k", k_from_n(F.lit(n)) - F.col("_before"))
              .where((F.col("_k") >= 1) & (F.col("_k") <= F.col("_cnt"))))
    hit = (ranked.join(blocks.select("_blk", "_k"), "_blk")
                 .where((F.col("_k") >= F.col("_hi") - F.col("_w") + 1) & (F.col("_k") <= F.col("_hi"))))
    return hit.agg(F.lit(n).cast("long").alias("n"), F.max("_v").alias("value"))
