"""One value histogram for all grains of the market metrics.

The histogram is a table ``(grain, <keys>, metric, value, label, weight)``: how often each value of a
metric occurs in a group. Numeric metrics (price, value, surface, rooms, coordinates) use ``value``;
identities and kinds (transaction, building, parcel, property type) use ``label``. It is written in one pass
over the facts, pre-aggregated before its only shuffle, and everything else is read from it:

* distinct counts are numbers of rows, shares are sums of weights;
* exact medians come from the weighted values: the least and largest for groups of one or two values, one
  aggregate that holds all values for other groups of bounded size, rank selection
  over ranges (``quantile``) for groups with more distinct values than the bound;
* every grain holds the year, so a new year adds its partitions and leaves the others alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import quantile
from ..session import stored

# ---- fixed values: names of the metrics in the histogram ---------------------------------------
TRANSACTION, KIND = "transaction", "kind"
# -------------------------------------------------------------------------------------------------


class Grain:
    """A grain's keys, its numeric metrics (name -> column) and its labels (name -> column)."""

    def __init__(self, keys: list[str], values: dict[str, str], labels: dict[str, str | Column]):
        self.keys, self.values, self.labels = keys, values, labels


def value_histogram(facts: DataFrame, grains: dict[str, Grain]) -> DataFrame:
    """The histogram of ``facts`` at all ``grains``. Rows with a NULL key do not count at that grain, NULL
    and NaN values and NULL labels do not count for that metric."""
    def entry(grain: str, metric: str, value: Column, label: Column) -> Column:
        return F.struct(F.lit(grain).alias("grain"), F.lit(metric).alias("metric"),
                        value.cast("double").alias("value"), label.cast("string").alias("label"))

    def column(c: str | Column) -> Column:
        return F.col(c) if isinstance(c, str) else c

    none = F.lit(None)
    parts = []
    for name, g in grains.items():
        entries = [entry(name, m, column(c), none) for m, c in g.values.items()]
        entries += [entry(name, m, none, column(c)) for m, c in g.labels.items()]
        known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in g.keys])
        parts.append(F.when(known, F.array(*entries)))
    keys = list(dict.fromkeys(k for g in grains.values() for k in g.keys))
    some = F.concat(*[F.coalesce(p, F.array().cast("array<struct<grain:string,metric:string,value:double,label:string>>"))
                      for p in parts]) if len(parts) > 1 else parts[0]
    held = {k: [n for n, g in grains.items() if k in g.keys] for k in keys}
    long = facts.select(*keys, F.explode(some).alias("e")).where(
        F.col("e.label").isNotNull() | (F.col("e.value").isNotNull() & ~F.isnan("e.value")))
    of_grain = [F.col(k) if len(held[k]) == len(grains) else F.when(F.col("e.grain").isin(held[k]), F.col(k)).alias(k) for k in keys]
    return (long.select("e.grain", *of_grain, "e.metric", "e.value", "e.label")
            .groupBy("grain", *keys, "metric", "value", "label").agg(F.count(F.lit(1)).alias("weight")))


def write_histogram(histogram: DataFrame, path: str) -> str:
    """Store a histogram by year and grain. Years that ``histogram`` holds replace their stored partitions,
    other years stay as they are, so yearly facts can be added one year at a time."""
    (histogram.hint("rebalance", "year", "grain").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("year", "grain").parquet(path))
    return path


def group_metrics(histogram: DataFrame, grain: str, keys: list[str], *, medians: dict[str, str], distinct: dict[str, str],
                  shares: dict[str, str]) -> DataFrame:
    """One row per group of ``grain``: exact ``medians`` (out -> metric), ``distinct`` counts (out -> metric)
    and ``shares`` of the property kinds (out -> kind, 0 to 1). ``histogram`` is read several times: pass a stored one."""
    own = histogram.where(F.col("grain") == grain)
    rows = F.sum(F.when(F.col("metric") == KIND, F.col("weight")))

    def share(kind: str) -> Column:
        hit = F.when((F.col("metric") == KIND) & (F.col("label") == kind), F.col("weight")).otherwise(0)
        return F.sum(hit) / rows

    counts = [F.count_if(F.col("metric") == m).alias(out) for out, m in distinct.items()]
    counts += [share(kind).alias(out) for out, kind in shares.items()]
    bound = quantile.HOT_GROUP_ROWS
    of = lambda m, c: F.when(F.col("metric") == m, F.col(c))
    middles = [F.percentile(of(m, "value"), 0.5, F.col("weight")).alias(out) for out, m in medians.items()]
    # a grain with fewer rows than the bound has no group above it: one count, no shuffle
    if own.count() <= bound:
        return own.groupBy(*keys).agg(*counts, *middles)
    # least and largest value and their number settle the median of one or two values (most buildings, streets);
    # only other groups need all their values held
    ends = [x for i, m in enumerate(medians.values()) for x in (
        F.min(of(m, "value")).alias(f"_lo{i}"), F.max(of(m, "value")).alias(f"_hi{i}"), F.sum(of(m, "weight")).alias(f"_w{i}"))]
    groups = stored(own.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *counts, *ends), "groups")
    deep = reduce(lambda a, b: a | b, [F.coalesce((F.col(f"_w{i}") > 2) & (F.col(f"_lo{i}") < F.col(f"_hi{i}")), F.lit(False))
                                       for i in range(len(medians))], F.lit(False))
    middle = [F.when(F.col(f"_lo{i}") == F.col(f"_hi{i}"), F.col(f"_lo{i}")).otherwise(0.5 * F.col(f"_lo{i}") + 0.5 * F.col(f"_hi{i}")).alias(out)
              for i, out in enumerate(medians)]
    settled = groups.where(~deep).select(*keys, *distinct, *shares, *middle)
    cold, hot = (groups.where(deep & c).select(*keys) for c in (F.col("_n") <= bound, F.col("_n") > bound))
    n_cold, n_hot = groups.where(deep).agg(F.count_if(F.col("_n") <= bound), F.count_if(F.col("_n") > bound)).first()
    if n_cold:
        settled = settled.unionByName(own.join(cold, keys, "left_semi").groupBy(*keys).agg(*counts, *middles))
    if not n_hot:
        return settled
    warm = own.join(hot, keys, "left_semi")
    number = F.element_at(F.create_map(*[F.lit(x) for i, m in enumerate(medians.values()) for x in (m, i)]), F.col("metric"))
    weighted = (warm.where(F.col("metric").isin(list(medians.values())))
                .select(*keys, number.alias("_m"), F.col("value").alias("_v"), F.col("weight").alias("_w")))
    ranked = warm.groupBy(*keys).agg(*counts).join(quantile.rank_weighted(weighted, keys, list(medians)), keys, "left")
    return settled.unionByName(ranked)
