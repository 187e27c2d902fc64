"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in shuffled order, repeated for up to ``MAX_EPOCHS`` passes.
A document's virtual finish time is the cumulative size of its queue up to and including it, divided
by the target of its source. All queue entries are taken in the global order of virtual finish time,
as long as their running total stays within the budget (the total of all sizes).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from parcelspark.llm.running import block_digits, n_words, shuffle_key, with_running_sum
from parcelspark.llm.store import stored

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = MAX_EPOCHS) -> DataFrame:
    """``source, rank, source_size, target`` from ``sources(source, source_size)`` (one row each).

    Targets share the total by weight (repeating in code point order, null last). A target stops at
    ``cap`` times its source's size; the rest is shared again. The capped sources are a prefix in
    order of size per weight, so the common rate of the others follows from prefix sums. The table
    has one row per source; its windows run over that table only.
    """
    ranked = sources.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight.cast("double")).withColumn("limit", (cap * F.col("source_size")).cast("double"))
    by_ratio = Window.orderBy(F.col("limit") / F.col("weight"), "rank")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    total = F.sum("source_size").over(everything).cast("double")
    rate = ((total - F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
            / F.sum("weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    rated = ranked.withColumn("rate", rate)
    # the first source that stays under its limit fixes the rate; all before it are capped
    free = F.when(F.col("rate") * F.col("weight") <= F.col("limit"), F.col("rate"))
    common = F.first(free, ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    target = F.least(F.col("limit"), F.coalesce(common * F.col("weight"), F.col("limit")))
    return rated.select("source", "rank", "source_size", target.alias("target"))


def _time_block(time: Column, blocks: int) -> Column:
    """Monotone block number: ``blocks`` per unit up to 2, then 64 per doubling."""
    return F.when(time < 2, F.floor(time * blocks)).otherwise(2 * blocks + F.floor(F.log2(time) * 64)).cast("long")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = MAX_EPOCHS) -> DataFrame:
    """One row per row of ``docs(doc_id, source, text)``:
    ``doc_id, source, size, source_size, target, copies, taken``.

    Null and empty texts have size 0 and are not taken. Null sources form one source, the last.
    Ties in hash order go by doc_id, then size; identical rows are interchangeable. Rows without an
    id take part by the digest of their text. Reruns agree. An empty table gives an empty result. Other columns are ignored.
    """
    slim = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                              n_words(F.col("text").cast("string")).alias("size"),
                              shuffle_key(F.col("doc_id"), F.col("text")).alias("shuffle")), "sizes")
    sources = stored(targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap), "targets")
    rows, budget = slim.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    digits = block_digits(rows)

    queued = with_running_sum(slim, ["source"], "size", "upto",
                              digits, ties=("doc_id", "size"))
    placed = queued.join(sources, queued["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    placed = stored(placed, "queues")

    def finish(epoch: Column) -> Column:
        return ((epoch * F.col("source_size") + F.col("upto")).cast("double") / F.col("target"))

    entries = (placed.where("size > 0 AND target > 0")
               .withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(cap - 1))))
               .withColumn("time", finish(F.col("epoch"))))
    blocks = 16 ** digits
    entries = entries.withColumn("slice", _time_block(F.col("time"), blocks))
    totals = entries.groupBy("slice").agg(F.sum("size").alias("total"))
    upto = totals.withColumn("upto", F.sum("total").over(Window.orderBy("slice")))
    edge = upto.where(F.col("upto") > budget).orderBy("slice").limit(1).collect()
    if not edge:
        copies = F.lit(cap)
    else:
        cut, before = edge[0]["slice"], edge[0]["upto"] - edge[0]["total"]
        order = ["time", "rank", "epoch", "shuffle", "doc_id"]
        last = (entries.where(F.col("slice") == cut)
                .withColumn("run", F.sum("size").over(Window.partitionBy("slice").orderBy(*order)
                                                     .rowsBetween(Window.unboundedPreceding, Window.currentRow)))
                .where(F.col("run") + before <= budget)
                .agg(F.max(F.struct(*order)).alias("last")).first()["last"])

        def taken(epoch: int) -> Column:
            e = F.lit(epoch)
            block = _time_block(finish(e), blocks)
            inside = F.lit(False)
            if last is not None:
                entry = F.struct(finish(e).alias("time"), F.col("rank"), e.alias("epoch"), F.col("shuffle"),
                                 F.coalesce("doc_id", F.lit(-1 << 63)).alias("doc_id"))
                bound = F.struct(F.lit(last["time"]).alias("time"), F.lit(last["rank"]).alias("rank"),
                                 F.lit(last["epoch"]).alias("epoch"), F.lit(last["shuffle"]).alias("shuffle"),
                                 F.lit(-1 << 63 if last["doc_id"] is None else last["doc_id"]).cast("long").alias("doc_id"))
                inside = (block == cut) & (entry <= bound)
            return ((block < cut) | inside).cast("int")

        copies = sum((taken(e) for e in range(1, cap)), taken(0))
    copies = F.when((F.col("size") > 0) & (F.col("target") > 0), copies).otherwise(F.lit(0))
    return (placed.withColumn("copies", copies.cast("int"))
            .select("doc_id", "source", "size", "source_size", "target", "copies",
                    (F.col("copies") * F.col("size")).cast("long").alias("taken")))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` repeated by their copies in the mix, with all columns, whatever their names. Rows
    that share an id get the copies of one of them (the largest number). Null and empty texts are not taken;
    an empty table gives an empty result."""
    row = F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in docs.columns]).alias("row")
    plan = mix(docs).groupBy("doc_id").agg(F.max("copies").alias("copies")).where("copies > 0")
    told = docs.select(row, F.col("doc_id").cast("long").alias("id"))
    joined = told.join(plan, F.col("id").eqNullSafe(F.col("doc_id")))
    return joined.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
