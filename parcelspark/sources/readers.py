"""Readers for the Bronze inputs and the stored Silver / Gold tables.

CSV inputs are read as all-text (no schema inference) and coerced later by the operators, like
the reference's ``dtype=str`` reads; GeoJSON layers keep each feature's raw coordinates as text
(mixed Polygon / MultiPolygon layers share one schema) and properties as a string map. Every
reader is lazy; file listing, splitting and column pruning are Spark's.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce
from urllib.parse import unquote

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import codes
from ..operators.sales import RAW_SALES_COLUMNS
from .records import read_features, read_quoted_csv

FEATURE_SCHEMA = ("type string, geometry struct<type string, coordinates string>, "
                  "properties map<string, string>")
YEAR_IN_NAME = r"(20\d{2})"
SPARK_PART = r"^part-"

# ---- fixed values: input column names ---------------------------------------------------------
ADDRESS_COLUMNS = ["cle_interop", "commune_insee", "voie_nom", "numero", "suffixe", "long", "lat",
                   "certification_commune"]
IRIS_COLUMNS = ["CODE_IRIS", "NOM_IRIS", "TYP_IRIS", "INSEE_COM", "DEP", "Geo Shape"]
RENT_COLUMNS = ["Année", "Loyers de référence", "Loyers de référence majorés",
                "Loyers de référence minorés", "Numéro INSEE du quartier"]
# -----------------------------------------------------------------------------------------------


def _csv(spark: SparkSession, path, sep: str, **options) -> DataFrame:
    reader = spark.read.option("header", True).option("sep", sep).option("encoding", "UTF-8")
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.csv(path)


def _folder() -> Column:
    return F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1)


def source_year() -> Column:
    """The ``20xx`` year of the file a row comes from (text): from the file's own name, or from its
    folder where Spark wrote the file. Spark's names (``part-<number>-<id>``) hold chance digits, so
    they are never searched. NULL without a year."""
    own = F.when(~F.col("_metadata.file_name").rlike(SPARK_PART),
                 F.regexp_extract(F.col("_metadata.file_name"), YEAR_IN_NAME, 1))
    return F.coalesce(F.nullif(own, F.lit("")), F.nullif(F.regexp_extract(_folder(), YEAR_IN_NAME, 1), F.lit("")))


def source_name() -> Column:
    """Name of the file a row comes from, without its ending; the folder's value where Spark wrote it."""
    return F.when(F.col("_metadata.file_name").rlike(SPARK_PART), F.regexp_replace(_folder(), r"^.*=", "")) \
        .otherwise(F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", ""))


def list_files(spark: SparkSession, paths) -> list[str]:
    """Paths of the data files under ``paths`` (a listing; no content is read)."""
    return sorted(unquote(f) for f in spark.read.text(paths).inputFiles())


@contextmanager
def _settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings for the time of a block."""
    keys = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def first_lines(spark: SparkSession, paths, known: list[str] | None = None) -> dict[str, str]:
    """First line of every data file under ``paths``; empty files are left out.

    One scan with one file to a task: a task hands on its first row and stops reading, so a file costs
    one read buffer however long it is. What comes to the driver is one line per file.
    """
    files = known if known is not None else list_files(spark, paths)
    if not files:
        return {}
    whole = str(1 << 60)
    with _settings(spark, spark__sql__files__maxPartitionBytes=whole, spark__sql__files__openCostInBytes=whole,
                   spark__sql__execution__arrow__maxRecordsPerBatch="1"):
        lines = spark.read.text(files).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), "value")
        # where a cluster's settings deal files otherwise, every row is looked at instead
        alone = lines.rdd.getNumPartitions() == len(files)

        def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last = None
            for batch in batches:
                names, starts = batch.column("file").to_pylist(), batch.column("at").to_pylist()
                new = [i for i, f in enumerate(names) if starts[i] == 0 and f != (names[i - 1] if i else last)]
                if new:
                    yield batch.take(pa.array(new)).select(["file", "value"])
                    if alone:
                        return
                last = names[-1] if names else last

        return {unquote(r["file"]): r["value"] for r in lines.mapInArrow(heads, "file string, value string").collect()}


def files_by_header(spark: SparkSession, paths) -> dict[str, list[str]]:
    """Data files grouped by their first line; empty files are left out."""
    groups: dict[str, list[str]] = {}
    for file, line in sorted(first_lines(spark, paths).items()):
        groups.setdefault(line, []).append(file)
    return groups


def filter_national_sales(spark: SparkSession, path: str, department_code: str, out_path: str,
                          sep: str = "|", partition_by: str | None = None) -> str:
    """National sales text -> rows of one department (text compare, so ``075`` != ``75``),
    written as comma-separated CSV with header under ``out_path``. ``partition_by`` writes one folder
    per value of that column; a column the text does not have is filled with the source file's name,
    so the yearly names survive as folder names."""
    rows = _csv(spark, path, sep).where(F.col("Code departement") == department_code)
    if partition_by and partition_by not in rows.columns:
        rows = rows.withColumn(partition_by, source_name())
    writer = rows.write.mode("overwrite").option("header", True)
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.csv(out_path)
    return out_path


def read_sales(spark: SparkSession, paths, sep: str = ",") -> DataFrame:
    """Yearly sales files: the 18 used columns by name, all text, plus ``year`` (``source_year``);
    files without a year are skipped. Files may order their columns differently: those with one
    header are read together, and the groups are joined by column name. A missing path raises
    Spark's own error, a missing column too."""
    def read(files: list[str]) -> DataFrame:
        return (_csv(spark, files, sep).select(*[F.col(f"`{c}`") for c in RAW_SALES_COLUMNS], source_year().alias("_year"))
                .where(F.col("_year").isNotNull())
                .withColumn("year", F.col("_year").cast("int")).drop("_year"))

    groups = files_by_header(spark, paths)
    if not groups:
        names = ", ".join(f"`{c}` string" for c in RAW_SALES_COLUMNS)
        return spark.createDataFrame([], f"{names}, year int")
    return reduce(DataFrame.unionByName, [read(files) for files in groups.values()])


def read_addresses(spark: SparkSession, path: str) -> DataFrame:
    """Address reference CSV (``;``, BOM handled by the reader), the 8 used columns."""
    return _csv(spark, path, ";").select(*ADDRESS_COLUMNS)


def read_iris(spark: SparkSession, path: str, department: str = "75") -> DataFrame:
    """Census-block CSV with its polygon as GeoJSON text in ``Geo Shape``; blocks of the
    department only; typed attributes and a ``geometry`` struct. Fields may hold line breaks; one file is
    read by many tasks."""
    df = read_quoted_csv(spark, path, IRIS_COLUMNS).where(F.col("DEP") == department)
    geo = F.col("Geo Shape")
    return df.select(
        F.col("CODE_IRIS").alias("iris_code"), F.col("NOM_IRIS").alias("iris_name"),
        F.col("TYP_IRIS").alias("iris_type"),
        codes.positional_district("CODE_IRIS").alias("arrondissement"),
        F.col("INSEE_COM").alias("commune_insee"),
        F.struct(F.get_json_object(geo, "$.type").alias("type"),
                 F.get_json_object(geo, "$.coordinates").alias("coordinates")).alias("geometry"))


def read_income(spark: SparkSession, folder: str) -> DataFrame:
    """Income table: the ``.csv`` file(s) of an extracted archive (any letter case) whose name does
    not start with ``meta_``; ``;`` separated, all text. The other files are never opened, so the
    header is the table's."""
    files = [f for f in list_files(spark, folder)
             if f.lower().endswith(".csv") and not f.rsplit("/", 1)[-1].startswith("meta_")]
    if not files:
        raise FileNotFoundError(f"no income table in {folder}")
    return _csv(spark, files, ";")


def read_rents(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, ";").select(*[F.col(f"`{c}`") for c in RENT_COLUMNS])


def read_social(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, ";")


def read_geojson(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """GeoJSON features as rows (``type``, ``geometry`` with raw coordinates text,
    ``properties`` map), from FeatureCollection documents or (``lines=True``) one feature per line. Either
    way one file is read by many tasks."""
    if lines:
        return spark.read.schema(FEATURE_SCHEMA).json(path)
    return read_features(spark, path, FEATURE_SCHEMA)


def quarter_table(features: DataFrame) -> DataFrame:
    """Quarter polygons' properties -> typed quarter rows (id as text)."""
    from ..functions.numeric import round_half_even
    p = F.col("properties")
    return features.select(
        p["c_quinsee"].alias("quartier_id"),
        p["c_qu"].cast("double").cast("int").alias("quartier_code"),
        p["c_ar"].cast("double").cast("int").alias("arrondissement"),
        p["l_qu"].alias("name"),
        round_half_even(p["surface"].cast("double"), 2).alias("surface_m2"),
        round_half_even(p["perimetre"].cast("double"), 2).alias("perimeter_m"),
        "geometry")


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """Classified pollution cells as a columnar table (category, minx, miny, maxx, maxy)."""
    return spark.read.parquet(path).select(
        F.col("category").cast("int"), *[F.col(c).cast("double") for c in ["minx", "miny", "maxx", "maxy"]])


LINK_SCHEMA = "idu string, id_adr string, type_lien string, nb_adr string, nb_parc string, seq long"


def read_links(spark: SparkSession, base_path: str) -> DataFrame:
    """Newest complete version of the stored parcel -> address link table: the highest one in the
    commit list, which ``sinks.writers.write_links_versioned`` extends after a version's files are all
    written. An empty typed table when nothing was stored yet. Versions without a list are an error, as taking
    them for nothing would request every known link again; any other error is raised."""
    try:
        newest = spark.read.schema("version long").parquet(commit_list(base_path)).agg(F.max("version")).first()[0]
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        newest = None
    if newest is None:
        if exists(spark, f"{base_path.rstrip('/')}/version=*"):
            raise FileNotFoundError(f"{base_path} holds versions, but {commit_list(base_path)} lists none: the list is lost, or no write ended")
        return spark.createDataFrame([], LINK_SCHEMA)
    return spark.read.schema(LINK_SCHEMA).parquet(f"{base_path.rstrip('/')}/version={newest}")


def exists(spark: SparkSession, pattern: str) -> bool:
    """Whether a path pattern matches anything (a listing)."""
    try:
        spark.read.format("binaryFile").load(pattern)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return False
    return True


def commit_list(base_path: str) -> str:
    """Folder of the complete versions' numbers, next to the link table."""
    return f"{base_path.rstrip('/')}-commits"


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A stored Silver / Gold table (types are kept by Parquet)."""
    return spark.read.parquet(path)


def read_in_order(spark: SparkSession, path: str, position: str = "position") -> DataFrame:
    """A table written with an order (``sinks.writers.write_table``), with each row's ``position`` from 1.

    A row's place is its row number in its file behind the rows of all earlier files; only one row per file
    meets in one task. A table with partition folders counts folder by folder, in the order of their names.
    """
    rows = spark.read.parquet(path)
    file, number = F.col("_metadata.file_path"), F.regexp_extract(F.col("_metadata.file_name"), r"^part-(\d+)", 1).cast("long")
    piece = F.regexp_extract(F.col("_metadata.file_name"), r"[-.]c(\d+)\.", 1).cast("long")
    folder = F.regexp_extract(file, r"^(.*)/", 1)
    sizes = rows.groupBy(file.alias("_file"), folder.alias("_folder"), number.alias("_number"), piece.alias("_piece")).agg(F.count("*").alias("_n"))
    earlier = Window.orderBy("_folder", "_number", "_piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_file", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    placed = rows.select("*", file.alias("_file"), F.col("_metadata.row_index").alias("_row"))
    return placed.join(starts, "_file").select(*rows.columns, (F.col("_start") + F.col("_row") + 1).alias(position))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A JSON document table written by ``sinks.writers.write_json_document``."""
    return spark.read.json(path)
