"""Records that do not end at line ends, read by many tasks: features of a GeoJSON document and rows of
CSV text with line breaks inside quotes.

A file is cut at a byte that ends records or lies inside them ('}' or the line feed), which Spark's text
reader does per split. Whether a piece begins inside a quoted text, and how deep in braces, depends on
all pieces before it. Both are running sums: they are summed inside each split, the splits' totals are summed
in file order (one row per split), and the offsets come back to the pieces. Pieces of one record are then
put together, so the only data that meets in one task is one split or one record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import stored

_SPLIT = ["file", "block"]


def _pieces(spark: SparkSession, paths, separator: str | None) -> DataFrame:
    """``file, block, seq, text``: pieces of the files; (block, seq) is their order in the file."""
    reader = spark.read.option("lineSep", separator) if separator else spark.read
    return reader.text(paths).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"), F.col("value").alias("text"))


def _with_running(df: DataFrame, value: Column, out: str, inclusive: bool) -> DataFrame:
    """Add the running sum of ``value`` over each file in order, with or without the row itself."""
    valued = df.withColumn("_v", value.cast("long"))
    totals = valued.groupBy(*_SPLIT).agg(F.sum("_v").alias("_total"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*_SPLIT, F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*_SPLIT).orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = valued.withColumn("_inside", F.sum("_v").over(inside)).join(offsets, _SPLIT)
    own = F.lit(0) if inclusive else F.col("_v")
    return summed.select(*df.columns, (F.col("_inside") + F.col("_offset") - own).alias(out))


def _every_other(parts: Column, first: int) -> Column:
    return F.array_join(F.filter(parts, lambda _, i: i % 2 == first), "")


def feature_texts(spark: SparkSession, paths) -> DataFrame:
    """``file, record, text`` of every object right below the top object of JSON documents: the features of
    a FeatureCollection, and objects beside them (such as its coordinate system)."""
    pieces = _pieces(spark, paths, "}")
    # quotes that open or close a text, and opening braces for either state at the piece's start
    bare = F.split(F.regexp_replace("text", r"(?s)\\.", ""), '"', -1)
    pieces = stored(pieces.withColumn("_bare", bare).select(
        "*", (F.size("_bare") - 1).alias("quotes"),
        F.regexp_count(_every_other(F.col("_bare"), 0), F.lit(r"\{")).alias("open_out"),
        F.regexp_count(_every_other(F.col("_bare"), 1), F.lit(r"\{")).alias("open_in")).drop("_bare"), "pieces")
    told = _with_running(pieces, F.col("quotes"), "quotes_before", inclusive=False)
    quoted = F.col("quotes_before") % 2 == 1
    closes = ((F.col("quotes_before") + F.col("quotes")) % 2 == 0).cast("int")
    told = told.withColumn("step", F.when(quoted, F.col("open_in")).otherwise(F.col("open_out")) - closes).withColumn("closes", closes)
    told = stored(told.select(*_SPLIT, "seq", "text", "step", "closes"), "steps")
    deep = _with_running(told, F.col("step"), "depth", inclusive=True)
    # a record ends with the brace that leads back to depth 1
    ended = deep.withColumn("ends", ((F.col("closes") == 1) & (F.col("depth") == 1)).cast("int"))
    numbered = _with_running(ended, F.col("ends"), "record", inclusive=False)
    order = F.sort_array(F.collect_list(F.struct("block", "seq", "text")))
    whole = numbered.groupBy("file", "record").agg(order.alias("parts"), F.max("ends").alias("ends"))
    text = F.concat(F.array_join(F.transform("parts", lambda p: p["text"]), "}"), F.lit("}"))
    # what stands in front: the top object's brace before its first record, members, brackets and commas
    front = r'(?s)^\x{FEFF}?(?:[^"{]|"(?:[^"\\]|\\.)*+")*+'
    first = F.regexp_replace(text, front + r'\{(?:[^"{]|"(?:[^"\\]|\\.)*+")*+', "")
    later = F.regexp_replace(text, front, "")
    return whole.where("ends = 1").select("file", "record", F.when(F.col("record") == 0, first).otherwise(later).alias("text"))


def read_features(spark: SparkSession, paths, schema: str) -> DataFrame:
    """Features of FeatureCollection documents as rows of ``schema``, each document read by many tasks. Empty
    files and documents without features give no rows."""
    rows = feature_texts(spark, paths).select(F.from_json("text", schema).alias("f")).select("f.*")
    return rows.where(F.col("type") == "Feature")


def read_quoted_csv(spark: SparkSession, path, columns: list[str], sep: str = ";") -> DataFrame:
    """Columns (as text) of CSV files with a header whose quoted fields may hold line breaks; a quote inside a field
    is doubled. All files have the header of the first one; ``columns`` are the wanted names."""
    from .readers import first_lines
    heads = first_lines(spark, path)
    if not heads:
        return spark.createDataFrame([], ", ".join(f"`{c}` string" for c in columns))
    header = sorted(heads.items())[0][1]
    options = {"sep": sep, "quote": '"', "escape": '"', "mode": "PERMISSIVE"}
    names = spark.range(1).select(F.split(F.lit(header.lstrip("﻿").rstrip("\r")), f"\\Q{sep}\\E", -1).alias("n")).first()["n"]
    names = [n.strip('"') for n in names]
    missing = [c for c in columns if c not in names]
    if missing:
        raise ValueError(f"no column {', '.join(missing)} in {path}")
    lines = stored(_pieces(spark, path, None).withColumn("quotes", F.length("text") - F.length(F.replace(F.col("text"), F.lit('"'), F.lit("")))), "lines")
    told = _with_running(lines, F.col("quotes"), "quotes_upto", inclusive=True)
    # a record ends with the line after which no quote is open
    ended = stored(told.withColumn("ends", (F.col("quotes_upto") % 2 == 0).cast("int")), "ends")
    numbered = _with_running(ended, F.col("ends"), "record", inclusive=False)
    alone = numbered.where((F.col("ends") == 1) & (F.col("quotes") % 2 == 0)).select("file", "record", "text")
    parts = numbered.where((F.col("ends") == 0) | (F.col("quotes") % 2 == 1)).groupBy("file", "record").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "seq", "text"))), lambda p: p["text"]), "\n").alias("text"))
    records = alone.unionAll(parts).where((F.col("record") > 0) & (F.trim("text") != ""))
    schema = ", ".join(f"`{n}` string" for n in names)
    return records.select(F.from_csv("text", schema, options).alias("r")).select(*[F.col(f"r.`{c}`") for c in columns])
