"""Running sums over hash order that never put one key's rows into one task."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

ROWS_PER_BLOCK = 20_000
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Words of a text (maximal runs of other than space and 0x09-0x0D); null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shuffle_key(doc_id: Column, text: Column) -> Column:
    """Fixed pseudo-random order of documents: the md5 digest of the id's text. Rows without an id are spread
    by their text, so that they do not meet in one block."""
    known = F.coalesce(doc_id.cast("string"), F.concat(F.lit("text "), F.coalesce(text.cast("string"), F.lit(""))))
    return F.md5(F.encode(known, "UTF-8"))


def block_digits(rows: int, per_block: int = ROWS_PER_BLOCK) -> int:
    """Hex digits that cut hash order into blocks of about ``per_block`` rows or fewer."""
    return max(1, math.ceil(math.log(max(rows, 1) / per_block, 16))) if rows > per_block else 1


def with_running_sum(df: DataFrame, keys: list[str], value: str, out: str, digits: int,
                     order: str = "shuffle", ties: tuple[str, ...] = ("doc_id",), light: DataFrame | None = None,
                     repeat: str | None = None) -> DataFrame:
    """Add ``out``: the inclusive running sum of ``value`` per ``keys`` in the order of the hex column
    ``order`` (then ``ties``). ``light`` holds the same rows with fewer columns, for the block totals.
    ``repeat`` names a column to add that numbers rows of equal keys, order and first tie from 1.

    Hash order is cut into blocks by leading digits. Sums inside blocks and the offsets of blocks
    are separate windows, so a key with most of the rows is spread over its blocks.
    """
    block = F.substring(order, 1, digits)
    blocked = df.withColumn("block__", block)
    by = [*keys, "block__"]
    totals = (blocked if light is None else light.withColumn("block__", block)).groupBy(*by).agg(F.sum(value).alias("total__"))
    earlier = Window.partitionBy(*keys).orderBy("block__").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*by, F.coalesce(F.sum("total__").over(earlier), F.lit(0)).alias("offset__"))
    inside = (Window.partitionBy(*by).orderBy(order, *ties)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    summed = blocked.withColumn("inside__", F.sum(value).over(inside))
    if repeat:
        # the windows share one distribution, so this one moves no rows
        same = Window.partitionBy(*by, order, ties[0]).orderBy(*ties[1:])
        summed = summed.withColumn(repeat, F.row_number().over(same))
    match = [summed[c].eqNullSafe(offsets[c]) for c in by]
    joined = summed.join(offsets, match)
    return joined.select(*[summed[c] for c in df.columns], *[summed[c] for c in [repeat] if c], (F.col("inside__") + F.col("offset__")).alias(out))
