"""Document fingerprints by one-permutation MinHash, with SQL functions only.

Every shingle is hashed once. The high bits name one of ``BINS`` bins, and the smallest hash of a bin
is kept. An empty bin takes the value of the non-empty bin that ranks first under a hash of the
(empty, non-empty) pair: a uniform choice that is independent per empty bin and the same for every
document with the same non-empty bins (optimal densification). The low ``BITS`` bits of the bins are packed
into longs; likeness is the share of equal bins, corrected for chance agreement.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from parcelspark.llm.store import stored

BINS, BITS, SHINGLE = 128, 8, 5
BIN_SHIFT = 63 - 7                      # hashes use 63 bits; the top 7 name the bin
PER_LONG = 64 // BITS
BLOCK, CELL_BITS = 2048, 11             # documents per window block when looking for the next one; ids of a cell
SPACE = r"[\x20\x09-\x0D]+"


def add_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add ``out``: the packed bins (array of longs) of column ``text``; empty without words.

    Each step is a column of its own, because it is read several times by the next one.
    """
    words = F.filter(F.split(F.col(text), SPACE), lambda w: w != "")
    df = df.withColumn("w__", F.transform(words, lambda w: F.xxhash64(w)))
    n = F.size("w__")
    run = F.transform(F.sequence(F.lit(0), F.greatest(n - SHINGLE, F.lit(0))), lambda i: F.shiftrightunsigned(
        F.xxhash64(*[F.get(F.col("w__"), i + j) for j in range(SHINGLE)]), 1))
    short = F.array(F.shiftrightunsigned(F.xxhash64(n, F.xxhash64(F.col("w__"))), 1))
    df = df.withColumn("h__", F.when(n >= SHINGLE, F.sort_array(run)).when(n > 0, short)
                       .otherwise(F.array().cast("array<bigint>")))
    # ascending hashes: the first of each bin is its minimum
    df = df.withColumn("m__", F.filter("h__", lambda x, i: (i == 0) | (
        F.shiftright(x, BIN_SHIFT) != F.shiftright(F.get(F.col("h__"), F.greatest(i - 1, F.lit(0))), BIN_SHIFT))))
    df = df.withColumn("b__", F.transform("m__", lambda x: F.shiftright(x, BIN_SHIFT).cast("int")))

    def bin_value(j: Column) -> Column:
        own = F.array_position("b__", j.cast("int")).cast("int")
        ranks = F.transform("b__", lambda b, k: F.xxhash64(j, b).bitwiseAND(F.lit(-BINS)).bitwiseOR(k.cast("long")))
        other = F.array_min(ranks).bitwiseAND(F.lit(BINS - 1)).cast("int")
        return F.when(own > 0, F.get(F.col("m__"), own - 1)).otherwise(F.get(F.col("m__"), other))

    filled = F.when(F.size("m__") == BINS, F.col("m__")).when(
        F.size("m__") > 0, F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), bin_value)).otherwise(
        F.array().cast("array<bigint>"))
    df = df.withColumn("v__", filled)

    def pack(g: Column) -> Column:
        packed = F.lit(0).cast("long")
        for k in range(PER_LONG):
            low = F.get(F.col("v__"), g * PER_LONG + k).bitwiseAND(F.lit((1 << BITS) - 1))
            packed = F.shiftleft(packed, BITS).bitwiseOR(low)
        return packed

    packed = F.when(F.size("v__") > 0, F.transform(F.sequence(F.lit(0), F.lit(BINS // PER_LONG - 1)), pack)) \
        .otherwise(F.array().cast("array<bigint>"))
    return df.withColumn(out, packed).drop("w__", "h__", "m__", "b__", "v__")


def likeness(a: Column, b: Column) -> Column:
    """Estimated similarity of two packed fingerprints, 0 to 1: share of equal bins, corrected for the
    2**-BITS chance that different values agree. Two texts without words are alike (1.0)."""
    chance = 2.0 ** -BITS

    def equal(x: Column) -> Column:
        return sum(((F.shiftrightunsigned(x, BITS * k).bitwiseAND(F.lit((1 << BITS) - 1)) == 0).cast("int")
                    for k in range(1, PER_LONG)), (x.bitwiseAND(F.lit((1 << BITS) - 1)) == 0).cast("int"))

    same = F.aggregate(F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y)), F.lit(0), lambda acc, x: acc + equal(x))
    corrected = F.greatest(F.lit(0.0), (same / BINS - chance) / (1 - chance))
    return (F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0)
            .otherwise(corrected))


def written(packed: Column) -> Column:
    """Hexadecimal form of packed bins."""
    return F.array_join(F.transform(packed, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def id_blocks(docs: DataFrame) -> DataFrame:
    """The blocks of about ``BLOCK`` documents that follow each other by (has_id, place): (has_id, cell, part, block,
    first, to_part, to_block). ``docs`` has ``has_id``, ``place`` and ``cell``, the place without its last bits.

    Cells are counted, dealt by ranges that are written once, and joined into blocks by running counts inside a
    range. So no task sees the ids of all documents, however sparse they are; only one row per range meets in one
    task, to find the block behind a range's last one (behind the last range: the first block).
    """
    cells = docs.groupBy("has_id", "cell").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    cells = stored(cells.repartitionByRange("has_id", "cell").withColumn("part", F.spark_partition_id()), "cells")
    along = Window.partitionBy("part").orderBy("has_id", "cell")
    before = F.coalesce(F.sum("n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = cells.withColumn("block", F.floor(before / BLOCK))
    heads = cells.groupBy("part", "block").agg(F.min(F.struct("has_id", "cell", "first")).alias("head"))
    inside = Window.partitionBy("part").orderBy("block")
    following = heads.select("part", "block", "head", F.lead("block").over(inside).alias("inner"))
    ranges = heads.groupBy("part").agg(F.min("block").alias("entry"))
    ring = Window.orderBy("part")                     # one row per range
    ranges = ranges.select("part", F.coalesce(F.lead("part").over(ring), F.first("part").over(ring)).alias("next_part"))
    links = following.join(ranges, "part").select(
        "part", "block", "head", F.when(F.col("inner").isNotNull(), F.col("part")).otherwise(F.col("next_part")).alias("to_part"),
        F.coalesce("inner", F.lit(0)).alias("to_block"))
    return stored(cells.join(links, ["part", "block"]).select(
        "has_id", "cell", "part", "block", (F.struct("has_id", "cell", "first") == F.col("head")).alias("is_head"), "first",
        "to_part", "to_block"), "id_blocks")


def with_next(docs: DataFrame) -> DataFrame:
    """Add ``packed`` (the fingerprint of ``text``), and ``next_text`` and ``next_packed`` of the row that follows
    by doc_id (after the last: the first).

    Ids are cut into blocks of about ``BLOCK`` documents, also where they are sparse. The first row of the next
    block joins each block as a closing row, found from one cell per block. Rows with one id follow each other by
    text; rows without an id come first, in the order of a hash of their texts.
    """
    columns = docs.columns
    place = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text"))
    docs = (docs.withColumn("has_id", F.col("doc_id").isNotNull()).withColumn("place", place)
            .withColumn("cell", F.shiftright("place", CELL_BITS)))
    blocks = id_blocks(docs.select("has_id", "place", "cell"))
    members = blocks.select("has_id", "cell", "part", "block")
    heads = blocks.where("is_head").select("has_id", "cell", F.col("first").alias("place"), "part", "block")
    texts = (docs.select("has_id", "cell", "place", "text").join(heads, ["has_id", "cell", "place"])
             .groupBy("part", "block").agg(F.min("text").alias("text")))
    ahead = blocks.where("is_head").select(F.col("part").alias("own_part"), F.col("block").alias("own_block"),
                                           F.col("to_part").alias("part"), F.col("to_block").alias("block"))
    closing = ahead.join(texts, ["part", "block"]).select(
        F.lit(None).cast("long").alias("doc_id"), "text", F.lit(None).cast("boolean").alias("has_id"),
        F.lit(None).cast("long").alias("place"), F.col("own_part").alias("part"), F.col("own_block").alias("block"),
        F.lit(True).alias("closing__"))
    own = docs.join(members, ["has_id", "cell"]).select(*columns, "has_id", "place", "part", "block",
                                                        F.lit(False).alias("closing__"))
    rows = add_fingerprint(own.unionByName(closing), "text", "packed")
    w = Window.partitionBy("part", "block").orderBy("closing__", "has_id", "place", "text")
    return (rows.withColumn("next_text", F.lead("text").over(w)).withColumn("next_packed", F.lead("packed").over(w))
            .where(~F.col("closing__")).drop("closing__", "has_id", "place", "part", "block"))


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs(doc_id, text)`` with its fingerprint, that of its edited text, and the
    likeness to the edited text and to the next document.

    The edited text has its last quarter of code points replaced by the first as many of the next
    document. Null texts are empty; texts without words have an empty fingerprint; a text of fewer
    than ``SHINGLE`` words is one shingle. Repeated rows get equal fingerprints; a single row is its own
    next document. Rows without an id come before the others. Other columns are ignored.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = with_next(slim)
    n = F.length("text")
    rows = rows.withColumn("n_chars", n.cast("long")).withColumn("tail", F.floor(n / 4).cast("int"))
    rows = rows.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - F.col("tail")),
                                              F.substring(F.col("next_text"), F.lit(1), F.col("tail"))))
    rows = add_fingerprint(rows.drop("text", "next_text"), "edited", "edited_packed")
    return rows.select("doc_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
                       written(F.col("packed")).alias("fingerprint"),
                       written(F.col("edited_packed")).alias("edited_fingerprint"),
                       likeness(F.col("packed"), F.col("edited_packed")).alias("near_edited"),
                       likeness(F.col("packed"), F.col("next_packed")).alias("near_next"))
