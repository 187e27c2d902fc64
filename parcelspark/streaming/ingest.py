"""Incremental Silver ingestion of yearly sales files with Structured Streaming.

The batch build rereads every yearly file; when files keep landing in the Bronze folder, this
stream picks up only new files (file source with an explicit all-text schema), applies the same
typing, filters and keys as the batch path (``operators.sales.clean_raw_sales``) and appends to
the Silver transactions table partitioned by year. Progress lives in the checkpoint folder, so a
restarted or failed query resumes without duplicates (file sink + checkpoint: exactly once).
Stateless per file: no watermark or state store is needed.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.sales import RAW_SALES_COLUMNS, clean_raw_sales
from ..sources.readers import source_year

RAW_SCHEMA = ", ".join(f"`{c}` string" for c in RAW_SALES_COLUMNS)


def start_sales_ingest(spark: SparkSession, bronze_dir: str, silver_path: str, checkpoint: str,
                       sep: str = ",", trigger_once: bool = False) -> StreamingQuery:
    raw = (spark.readStream.schema(RAW_SCHEMA).option("header", True).option("sep", sep)
                .option("enforceSchema", False)   # a file with other columns fails loudly
                .option("pathGlobFilter", "*.csv").csv(bronze_dir))
    # the year comes from the file's own name or its folder; files without one are skipped
    typed = raw.withColumn("year", source_year().cast("int")).where(F.col("year").isNotNull())
    writer = (clean_raw_sales(typed).writeStream.format("parquet").option("path", silver_path)
              .option("checkpointLocation", checkpoint).partitionBy("year").outputMode("append"))
    writer = writer.trigger(availableNow=True) if trigger_once else writer.trigger(processingTime="1 minute")
    return writer.start()
