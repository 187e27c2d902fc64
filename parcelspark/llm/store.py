"""Intermediate tables in the shared folder, and Arrow batch sizing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from parcelspark.session import checkpoint_dir


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet under ``spark.checkpoint.dir`` and reread it.

    Cuts lineage without tying data to an executor: a lost executor rereads the files, and later
    passes read only the columns they use. Each call writes to a folder of its own.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def arrow_rows(spark: SparkSession, rows: int = 1000) -> None:
    """Cap the rows of one Arrow batch for the session, so that a batch of long texts stays small."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, str(rows))
