"""Source catalogue: a YAML file naming each input (label, group, kind, location, target file,
optional filtered file and department code, delimiter) becomes a typed DataFrame with the
derived target and filtered paths. The catalogue is configuration (a few entries) read on the
driver; it only drives which readers run on which paths."""

from __future__ import annotations

import posixpath

import yaml
from pyspark.sql import DataFrame, SparkSession

CATALOGUE_SCHEMA = ("name string, label string, `group` string, kind string, url string, "
                    "target_dir string, target_file string, summary string, filtered_file string, "
                    "department_code string, delimiter string, target_path string, filtered_path string")


def load_sources(spark: SparkSession, yaml_path: str, root: str = "") -> DataFrame:
    with open(yaml_path, encoding="utf-8") as handle:
        data = yaml.safe_load(handle) or {}
    rows = []
    for name, p in (data.get("sources") or {}).items():
        target_dir = posixpath.join(root, p["target_dir"]) if root else p["target_dir"]
        filtered = p.get("filtered_file")
        rows.append((name, p["label"], p["group"], p["kind"], p["url"], p["target_dir"], p["target_file"],
                     p["summary"], filtered, p.get("department_code"), p.get("delimiter", ","),
                     posixpath.join(target_dir, p["target_file"]),
                     posixpath.join(target_dir, filtered) if filtered else None))
    return spark.createDataFrame(rows, CATALOGUE_SCHEMA)


def list_sources(catalogue: DataFrame) -> DataFrame:
    """The source listing served to users (name, label, group, kind, location, file, summary, paths)."""
    return catalogue.select("name", "label", "group", "kind", "url", "target_file", "summary", "target_path",
                            "filtered_path")
