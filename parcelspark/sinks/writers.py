"""Writers for Silver / Gold tables, GeoJSON layers, JSON documents and the versioned link table.

Tables go to Parquet (optionally also CSV with header), partitioned by ``year`` where the table
has one, so served reads of one year prune the other partitions. GeoJSON layers are written one
feature per line (splittable, no single-task document).
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.readers import commit_list


def write_table(df: DataFrame, path: str, *, partition_by: str | None = None,
                csv_path: str | None = None, order: list[str] | None = None) -> str:
    """Write ``df`` as Parquet. With ``order`` the rows are dealt by ranges of these columns and sorted inside
    them, so the table is ordered over its files by number (and narrow bounds let reads skip files), and no task
    holds more than a range. ``sources.readers.read_in_order`` returns the places."""
    if order:
        lead = [c for c in [partition_by] if c in df.columns and c not in order]
        df = df.repartitionByRange(*lead, *order).sortWithinPartitions(*lead, *order)
    writer = df.write.mode("overwrite")
    if partition_by and partition_by in df.columns:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    if csv_path:
        df.write.mode("overwrite").option("header", True).csv(csv_path)
    return path


def feature_lines(df: DataFrame, geometry: str = "geometry", properties: list[str] | str | None = None) -> DataFrame:
    """One GeoJSON Feature text per row: the raw coordinates text is embedded as JSON; the
    properties object is a map column (``properties`` given as one name) or the chosen columns."""
    if isinstance(properties, str):
        props_json = F.to_json(F.col(properties))
    else:
        props_json = F.to_json(F.struct(*[c for c in (properties or df.columns) if c != geometry]))
    g = F.col(geometry)
    # the geometry type is a GeoJSON identifier (letters only), the coordinates are JSON text
    line = F.concat(F.lit('{"type":"Feature","geometry":{"type":"'), g["type"],
                    F.lit('","coordinates":'), g["coordinates"], F.lit('},"properties":'),
                    props_json, F.lit("}"))
    return df.select(line.alias("value"))


def write_geojson_lines(df: DataFrame, path: str, geometry: str = "geometry",
                        properties: list[str] | str | None = None) -> str:
    feature_lines(df, geometry, properties).write.mode("overwrite").text(path)
    return path


def write_json_document(df: DataFrame, path: str) -> str:
    """A one-row (document) DataFrame of nested structs / arrays as a JSON file."""
    df.coalesce(1).write.mode("overwrite").json(path)
    return path


def dashboard_document(summary: DataFrame, city: DataFrame, sales_yearly: DataFrame,
                       social_yearly: DataFrame, rents_yearly: DataFrame, coverage: DataFrame,
                       metrics: DataFrame) -> DataFrame:
    """The dashboard payload as one row: generation time, latest and available years per theme,
    city figures, district records (bounded: one per district), coverage counters, metric
    catalogue."""
    years = lambda df: df.agg(F.sort_array(F.collect_set("year")).alias("y")).scalar()
    latest = lambda df: df.agg(F.max("year")).scalar()
    records = summary.agg(F.sort_array(F.collect_list(F.struct(*summary.columns))).alias("r")).scalar()
    return city.select(
        F.current_timestamp().cast("string").alias("generated_at"),
        latest(sales_yearly).alias("latest_sales_year"), latest(social_yearly).alias("latest_social_year"),
        latest(rents_yearly).alias("latest_rent_year"),
        years(sales_yearly).alias("available_sales_years"), years(social_yearly).alias("available_social_years"),
        years(rents_yearly).alias("available_rent_years"),
        F.struct(*city.columns).alias("city"), records.alias("arrondissements"),
        coverage.select(F.struct(*coverage.columns)).scalar().alias("coverage"),
        metrics.agg(F.collect_list(F.struct(*metrics.columns))).scalar().alias("metrics"))


def write_links_versioned(df: DataFrame, base_path: str) -> str:
    """Write the merged link table as a new ``version=<n>`` folder next to the one being read
    (never over it), then add its number to the commit list; readers see listed versions only."""
    version = int(time.time() * 1000)
    path = f"{base_path.rstrip('/')}/version={version}"
    df.write.mode("error").parquet(path)
    df.sparkSession.range(1).select(F.lit(version).alias("version")).write.mode("append").parquet(commit_list(base_path))
    return path
