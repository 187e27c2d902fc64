"""Packing into optimal length buckets.

The histogram of document lengths (rounded up to a multiple, as batches pad) is aggregated on Spark.
Dynamic programming over it chooses the bucket boundaries with the least total padding. Inside each
bucket documents are numbered in hash order and cut into batches that hold ``budget // length`` rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from parcelspark.llm.running import block_digits, n_words, shuffle_key, with_running_sum
from parcelspark.llm.store import stored

N_BUCKETS = 16
MULTIPLE = 8            # lengths are padded to this multiple
TOKEN_BUDGET = 32_768   # padded tokens of a batch; a longer document is a batch of its own


def bucket_bounds(lengths: list[int], counts: list[int], n_buckets: int = N_BUCKETS) -> list[int]:
    """Upper bounds of at most ``n_buckets`` buckets with the least total padded length.

    ``lengths`` ascend. The cost of a bucket (i, j] is lengths[j] * (documents in it), so a layer of
    the program is a minimum of lines with descending slopes, asked at ascending lengths: a convex
    hull walk, linear per layer. The total over documents is exact integer arithmetic.
    """
    m = len(lengths)
    if m == 0:
        return []
    upto = [0]
    for c in counts:
        upto.append(upto[-1] + c)
    cost = [lengths[j] * upto[j + 1] for j in range(m)]           # all of 0..j in one bucket
    splits = [[-1] * m]
    for k in range(1, min(n_buckets, m)):                         # k + 1 buckets need j >= k
        hull: list[tuple[int, int, int]] = []                     # slope, intercept, split
        layer, split, at = [0] * m, [-1] * m, 0
        for j in range(k, m):
            line = (-upto[j], cost[j - 1], j - 1)
            while len(hull) >= 2 and _useless(hull[-2], hull[-1], line):
                hull.pop()
            hull.append(line)
            at = min(at, len(hull) - 1)
            x = lengths[j]
            while at + 1 < len(hull) and hull[at + 1][0] * x + hull[at + 1][1] <= hull[at][0] * x + hull[at][1]:
                at += 1
            layer[j], split[j] = hull[at][0] * x + hull[at][1] + x * upto[j + 1], hull[at][2]
        cost = layer
        splits.append(split)
    bounds, j = [], m - 1
    for split in reversed(splits):
        bounds.append(lengths[j])
        j = split[j]
    return bounds[::-1]


def _useless(a: tuple, b: tuple, c: tuple) -> bool:
    """Line b is nowhere under both a and c (slopes descend)."""
    return (c[1] - a[1]) * (a[0] - b[0]) <= (b[1] - a[1]) * (a[0] - c[0])


def padded(tokens: Column, multiple: int = MULTIPLE) -> Column:
    return (F.greatest(F.ceil(tokens / multiple), F.lit(1)) * multiple).cast("long")


def pack(docs: DataFrame, n_buckets: int = N_BUCKETS, budget: int = TOKEN_BUDGET, multiple: int = MULTIPLE,
         keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``:
    ``doc_id, n_tokens, bucket, bucket_length, batch, slot``; with ``keep``, also ``copy`` and the columns
    of ``docs`` it names.

    Tokens are whitespace words. A row of bucket b is padded to ``bucket_length``; batches count from
    0 inside their bucket. ``copy`` numbers rows of equal id (without an id: of equal text) and length
    from 1. Null and empty texts have no tokens and go to the shortest bucket. Repeated rows get slots of
    their own. The histogram that comes to the driver has one row per distinct padded length. An empty
    table gives an empty result. Other columns are ignored.
    """
    kept = F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), n_words(F.col("text").cast("string")).alias("n_tokens"),
                       shuffle_key(F.col("doc_id"), F.col("text")).alias("shuffle"), F.lit(1).cast("long").alias("one"),
                       *([kept] if keep else [])).withColumn("length", padded(F.col("n_tokens"), multiple))
    slim = stored(rows.drop("kept"), "lengths")
    histogram = sorted((r["length"], r["n"]) for r in slim.groupBy("length").agg(F.count("*").alias("n")).collect())
    bounds = bucket_bounds([x for x, _ in histogram], [n for _, n in histogram], n_buckets) or [multiple]
    digits = block_digits(sum(n for _, n in histogram))
    bucket = sum(((F.col("length") > b).cast("int") for b in bounds[:-1]), F.lit(0))
    length = F.element_at(F.array(*[F.lit(b).cast("long") for b in bounds]), F.col("bucket") + 1)

    def placed(part: DataFrame) -> DataFrame:
        return part.withColumn("bucket", bucket).withColumn("bucket_length", length)

    numbered = with_running_sum(placed(rows if keep else slim), ["bucket"], "one", "place", digits, ties=("doc_id", "n_tokens"),
                                light=placed(slim), repeat="copy" if keep else None)
    per_batch = F.greatest(F.floor(F.lit(budget) / F.col("bucket_length")), F.lit(1))
    return (numbered.withColumn("rows", per_batch)
            .select("doc_id", "n_tokens", "bucket", "bucket_length",
                    F.floor((F.col("place") - 1) / F.col("rows")).cast("long").alias("batch"),
                    F.pmod(F.col("place") - 1, F.col("rows")).cast("long").alias("slot"),
                    *(["copy", *[F.col(f"kept.`{c}`") for c in keep]] if keep else [])))
