"""The full medallion build on Bronze files: Silver (typed, cleaned, geocoded) and Gold
(aggregates, summary, map layers, dashboard document) tables.

Every step is a library operator; independent branches (sales, income, rents, social, noise) are
independent Spark jobs. Tables shared by several later steps are materialised once (written
Silver tables or checkpoints), never recomputed per consumer.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import lambert93
from ..operators import geocode, metrics, overlay, sales, serving, spatial, summary, themes
from ..operators.histogram import write_histogram
from ..session import materialize
from ..sinks import writers
from ..sources import readers



@dataclass
class BronzeInputs:
    sales: str | list[str]     # yearly sales files (glob or folder, or several)
    addresses: str             # address reference CSV
    links: str                 # versioned parcel -> address link table folder
    iris: str                  # census blocks CSV with GeoJSON shapes
    income: str                # extracted income archive folder
    rents: str                 # rent caps CSV
    social: str                # social housing CSV
    districts: str             # district polygons (GeoJSON)
    quarters: str              # quarter polygons (GeoJSON)
    streets: str               # street lines (GeoJSON)
    cells: str | None = None   # classified pollution cells (Parquet), None = skip noise
    geojson_lines: bool = False  # layers hold one feature per line (split over tasks) instead of one document


# ---- fixed values: catalogue names of the build's inputs ------------------------------------------
CATALOGUE_INPUTS = {"addresses": "adresses_ban", "iris": "iris_paris", "income": "insee_filosofi_2021", "rents": "paris_loyers",
                    "social": "paris_social_housing", "districts": "reference_arrondissements", "quarters": "quartier_paris",
                    "streets": "voie_paris"}
# -----------------------------------------------------------------------------------------------


def bronze_from_catalogue(spark: SparkSession, catalogue: DataFrame, links: str, cells: str | None = None,
                          inputs: dict[str, str] | None = None, geojson_lines: bool = False) -> BronzeInputs:
    """The build's inputs as the catalogue (``sources.catalogue.load_sources``) names them.

    ``inputs`` maps an input to its catalogue name. Archives are read as extracted: the target path without
    ``.zip``. Sales are all entries with a filtered file; where that file is not there yet, it is filtered from the
    extracted national file by the entry's department and delimiter. Unknown names and missing files are one
    error that lists them all, raised before anything is written.
    """
    entries = {r["name"]: r for r in catalogue.collect()}                # configuration: a few rows
    extracted = lambda entry: entry["target_path"].removesuffix(".zip")
    names = {**CATALOGUE_INPUTS, **(inputs or {})}
    wrong = [f"{role}: no entry {name}" for role, name in names.items() if name not in entries]
    paths = {role: extracted(entries[name]) for role, name in names.items() if name in entries}
    wrong += [f"{role}: no file {path}" for role, path in paths.items() if not readers.exists(spark, path)]
    sales_entries = [e for e in entries.values() if e["filtered_path"]]
    open_entries = [e for e in sales_entries if not readers.exists(spark, e["filtered_path"])]
    wrong += [f"sales: no file {e['filtered_path']} or {extracted(e)}" for e in open_entries if not readers.exists(spark, extracted(e))]
    wrong += [] if sales_entries else ["sales: no entry with a filtered file"]
    if wrong:
        raise FileNotFoundError("; ".join(wrong))
    for e in open_entries:
        readers.filter_national_sales(spark, extracted(e), e["department_code"], e["filtered_path"], sep=e["delimiter"])
    return BronzeInputs(sales=[e["filtered_path"] for e in sales_entries], links=links, cells=cells,
                        geojson_lines=geojson_lines, **paths)


def build(spark: SparkSession, bronze: BronzeInputs, silver: str, gold: str,
          csv_copies: bool = False) -> dict[str, str]:
    """Run the build; returns name -> written path. ``csv_copies`` also writes every table as
    CSV with header next to its Parquet copy (``<path>_csv``)."""
    out: dict[str, str] = {}

    def write(df: DataFrame, path: str, partition_by: str | None = None) -> str:
        return writers.write_table(df, path, partition_by=partition_by,
                                   csv_path=f"{path}_csv" if csv_copies else None)

    def layer(path: str) -> DataFrame:
        return readers.read_geojson(spark, path, lines=bronze.geojson_lines)

    # reference layers
    district_feats = layer(bronze.districts)
    districts = materialize(summary.district_table(district_feats).join(
        district_feats.select(F.col("properties")["c_ar"].cast("double").cast("int").alias("arrondissement"),
                              "geometry"), "arrondissement"))
    quarters = materialize(readers.quarter_table(layer(bronze.quarters))
                           .withColumn("quartier_order", F.col("quartier_id").cast("long")))
    iris = materialize(readers.read_iris(spark, bronze.iris)
                       .withColumn("iris_order", F.col("iris_code").cast("long")))
    # ids are generated once and materialised: the overlay reads the features twice
    street_feats = materialize(layer(bronze.streets)
                               .withColumn("feature_id", F.monotonically_increasing_id()))
    streets = materialize(overlay.street_reference(street_feats, districts))

    # sales: Silver transactions, district x year metrics
    tx = sales.clean_raw_sales(readers.read_sales(spark, bronze.sales))
    tx_path = write(tx, f"{silver}/sales_transactions", partition_by="year")
    tx = readers.read_table(spark, tx_path)

    # geocoding cascade, spatial attachment, micro keys
    ref = materialize(geocode.prepare_address_reference(readers.read_addresses(spark, bronze.addresses)))
    links = readers.read_links(spark, bronze.links)
    geo = geocode.geocode_cascade(
        tx, geocode.dedupe_reference(ref, "address_key"), geocode.dedupe_reference(ref, "address_key_no_suffix"),
        geocode.dedupe_reference(ref, "cle_interop"), links)
    geo = materialize(geo)
    out["links_to_fetch"] = write(
        geocode.missing_link_ids(geo.where(F.col("longitude").isNull()), links), f"{gold}/links_to_fetch")
    geo = spatial.attach_points(geo, quarters, x="longitude", y="latitude", feature_id="quartier_id",
                                order="quartier_order", mapping={"quartier_id": "quartier_id", "name": "quartier_name"})
    geo = materialize(geo)  # the next attach reads it twice (distinct coordinates, join back)
    geo = spatial.attach_points(geo, iris, x="longitude", y="latitude", feature_id="iris_code", order="iris_order",
                                mapping={"iris_code": "iris_code", "iris_name": "iris_name", "iris_type": "iris_type",
                                         "arrondissement": "iris_arrondissement"})
    geo = sales.micro_geography_keys(geo)
    # the working columns (transaction id, address keys) stay in an inner table for the metrics
    geo = readers.read_table(spark, write(geo, f"{silver}/sales_geocoded_working", partition_by="year"))
    geocoded = geo.select(*[F.col(c).alias(name) for c, name in sales.GEOCODED_COLUMNS.items()])
    write(geocoded, f"{silver}/sales_geocoded", partition_by="year")
    out["sales_geocoded"] = write(geocoded, f"{gold}/sales_geocoded", partition_by="year")

    # one pass over the sales; the yearly tables of all five grains are read from the histogram
    histogram = readers.read_table(spark, write_histogram(metrics.market_histogram(geo), f"{silver}/sales_histogram"))
    cover = metrics.coverage(geo)

    # theme tables
    income = metrics.income_metrics(themes.prepare_income(readers.read_income(spark, bronze.income)))
    rents = metrics.rent_metrics(themes.prepare_rents(readers.read_rents(spark, bronze.rents)))
    social = metrics.social_metrics(themes.prepare_social(readers.read_social(spark, bronze.social)))
    if bronze.cells:
        env = spatial.cell_exposure(readers.read_cells(spark, bronze.cells), districts,
                                    feature_id="arrondissement", project=lambert93)
    else:
        env = summary.neutral_environment(districts)

    tables = {"sales_yearly": metrics.market_table(histogram, "arrondissement"),
              **{f"sales_{grain}_yearly": metrics.market_table(histogram, grain) for grain in ("quartier", "iris", "street", "building")},
              "income": income, "rents_yearly": rents, "social_yearly": social, "noise": env}
    for name, df in tables.items():
        stored = readers.read_table(spark, write(df, f"{silver}/{name}", partition_by="year"))
        out[name] = write(stored, f"{gold}/{name}", partition_by="year")
        tables[name] = stored

    summ = summary.district_summary(districts.drop("geometry"), tables["sales_yearly"], tables["income"],
                                    tables["rents_yearly"], tables["social_yearly"], tables["noise"])
    out["summary"] = write(summ, f"{gold}/arrondissement_summary")
    summ = readers.read_table(spark, out["summary"])
    city = summary.city_rollup(summ)
    cover_path = writers.write_json_document(cover, f"{gold}/sales_spatial_coverage")
    out["coverage"] = cover_path
    catalog = spark.createDataFrame([(k, lab, u, y) for k, lab, u, y in serving.METRIC_CATALOG],
                                    "key string, label string, unit string, supports_year boolean")
    out["dashboard"] = writers.write_json_document(
        writers.dashboard_document(summ, city, tables["sales_yearly"], tables["social_yearly"],
                                   tables["rents_yearly"], readers.read_json(spark, cover_path), catalog),
        f"{gold}/dashboard")
    out["districts_geojson"] = writers.write_geojson_lines(summary.district_layer(district_feats), f"{gold}/arrondissements.geojsonl")
    out["quarters_geojson"] = writers.write_geojson_lines(quarters.drop("quartier_order"), f"{gold}/quartiers.geojsonl")
    out["streets_geojson"] = writers.write_geojson_lines(streets, f"{gold}/streets.geojsonl")
    out["iris_geojson"] = writers.write_geojson_lines(iris.drop("iris_order"), f"{gold}/iris.geojsonl")
    return out
