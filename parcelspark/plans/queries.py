"""Registered queries over the driver's test tables: each maps a SURVEY §7.4 analogue onto the
library's operators. Every callable takes ``(spark, sf_dir)`` and returns a DataFrame; operators that
look at group sizes or store intermediate tables run those jobs while the plan is built."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codes import postal_code_to_district
from ..session import materialize, stored, stored_together
from ..operators import geocode, metrics, overlay, sales, serving, spatial, summary, themes
from . import testdata as td


def cleaned_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = td.sales_rows(spark, sf_dir).withColumn(
        "arrondissement", postal_code_to_district("postal_code"))
    return sales.filter_sales(rows, nature=td.SALE_NATURE_STANDIN,
                              kinds=(td.APARTMENT_STANDIN, td.HOUSE_STANDIN))


def _metrics(df: DataFrame, keys: list[str]) -> DataFrame:
    return metrics.sales_metrics(df, keys, apartment=td.APARTMENT_STANDIN, house=td.HOUSE_STANDIN)


def q01_sales_district_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Market metric block per district x year over the cleaned sales."""
    return _metrics(cleaned_sales(spark, sf_dir), ["arrondissement", "year"])


def address_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned sales with normalised address fields and keys."""
    return sales.address_fields(cleaned_sales(spark, sf_dir), dep="dep_code", commune="commune_code",
                                number="raw_number", suffix="raw_suffix", street="raw_street")


def micro_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Address sales whose matched address id is the supplier stand-in, with street key,
    building id/source/label."""
    base = address_sales(spark, sf_dir).withColumn("matched_cle_interop", F.col("supplier_id"))
    return sales.micro_geography_keys(base)


KINDS = dict(apartment=td.APARTMENT_STANDIN, house=td.HOUSE_STANDIN)


def q03_sales_street_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Street x district x year metrics with distinct buildings, geocoded transactions and
    median coordinates (the extra columns ride along in the metric block's aggregates)."""
    return metrics.street_sales_metrics(micro_sales(spark, sf_dir), **KINDS)


def q04_sales_building_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Building (9-key grain) x year metrics with distinct parcels."""
    return metrics.building_sales_metrics(micro_sales(spark, sf_dir), **KINDS)


def income(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.income_metrics(themes.prepare_income(td.income_rows(spark, sf_dir)))


def rents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.rent_metrics(themes.prepare_rents(td.rent_rows(spark, sf_dir)))


def social(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.social_metrics(themes.prepare_social(td.social_rows(spark, sf_dir)))


def q05_income_by_district(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Census-block income per district: block count, medians, means (text parsed)."""
    return income(spark, sf_dir)


def q06_rent_by_district_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rent caps per district x year; rows with an unusable quarter code are dropped."""
    return rents(spark, sf_dir)


def q07_social_by_district_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Social housing per district x year: distinct programmes and unit sums."""
    return social(spark, sf_dir)


def q08_five_year_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Social units financed over the last five years per district."""
    return metrics.five_year_sum(social(spark, sf_dir))


def q09_latest_year_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest year and sorted distinct years per theme (sales, rents, social)."""
    themes_ = {"sales": cleaned_sales(spark, sf_dir), "rents": rents(spark, sf_dir),
               "social": social(spark, sf_dir)}
    parts = [df.agg(F.max("year").alias("latest_year"),
                    F.array_join(F.sort_array(F.collect_set("year")), ",").alias("years"))
               .select(F.lit(name).alias("theme"), "latest_year", "years")
             for name, df in themes_.items()]
    out = parts[0]
    for p_ in parts[1:]:
        out = out.unionByName(p_)
    return out


def address_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geocode.prepare_address_reference(td.address_rows(spark, sf_dir))


def q10_reference_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Address reference deduped per full address key: best id, median coordinates."""
    return geocode.dedupe_reference(address_reference(spark, sf_dir), "address_key")


def geocoded_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref = address_reference(spark, sf_dir)
    out = geocode.geocode_cascade(
        address_sales(spark, sf_dir).drop("longitude", "latitude"),
        geocode.dedupe_reference(ref, "address_key"),
        geocode.dedupe_reference(ref, "address_key_no_suffix"),
        geocode.dedupe_reference(ref, "cle_interop"),
        td.link_rows(spark, sf_dir))
    return sales.micro_geography_keys(out)


def q11_lookup_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-tier geocode (full key, key without suffix, parcel link) with source and
    building id tags, one row per sale."""
    return geocoded_sales(spark, sf_dir).select(
        "transaction_id", "address_key", "parcel_id", "matched_cle_interop", "longitude",
        "latitude", "geocode_source", "building_id", "building_id_source", "building_label")


def q12_best_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best address link per parcel (priority, address count, id; per-column first non-null)."""
    return geocode.best_links(td.link_rows(spark, sf_dir))


def q13_anti_missing_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parcel ids of sales still without coordinates after the two address tiers that the stored
    link table does not know yet (the ids to request from the link service)."""
    ref = address_reference(spark, sf_dir)
    tiers12 = geocode.geocode_cascade(
        address_sales(spark, sf_dir).drop("longitude", "latitude"),
        geocode.dedupe_reference(ref, "address_key"), geocode.dedupe_reference(ref, "address_key_no_suffix"),
        geocode.dedupe_reference(ref, "cle_interop"), links=None)
    unmatched = tiers12.where(F.col("longitude").isNull())
    return geocode.missing_link_ids(unmatched, td.link_rows(spark, sf_dir))


def q14_merge_keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored link table + a delivered batch, last row per (parcel, address, type) kept."""
    return geocode.merge_links(td.link_rows(spark, sf_dir), td.delivered_link_rows(spark, sf_dir))


OCTAGON_CELL = 0.5  # tile side for the unit-spaced octagons


def q02_sales_quarter_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales points attached to quarter polygons (point in polygon), then the metric block per
    quarter x district x year for sales inside a quarter."""
    # the attach reads its points twice (distinct coordinates, join back): materialise the
    # pruned sales once instead of running the four-table join twice
    pts = materialize(cleaned_sales(spark, sf_dir).select(
        "arrondissement", "year", "transaction_id", "price_per_m2", "sale_value_eur",
        "built_surface_m2", "rooms", "property_type", "longitude", "latitude"))
    located = spatial.attach_points(
        pts, td.octagon_features(spark, sf_dir),
        x="longitude", y="latitude", feature_id="feature_id", order="feature_id",
        mapping={"feature_id": "quartier_id", "name": "quartier_name"}, cell=OCTAGON_CELL)
    located = located.withColumn("quartier_id", F.col("quartier_id").cast("string"))
    return _metrics(located.where(F.col("quartier_id").isNotNull()),
                    ["quartier_id", "quartier_name", "arrondissement", "year"])


def q15_point_in_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event with the first octagon (lowest key) covering its point, NULL outside."""
    located = spatial.attach_points(
        td.event_points(spark, sf_dir), td.octagon_features(spark, sf_dir), x="x", y="y",
        feature_id="feature_id", order="feature_id", mapping={"feature_id": "n_nationkey"},
        cell=OCTAGON_CELL)
    return located.select("event_id", "n_nationkey")


def q16_weighted_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area-weighted noise / air exposure per octagon from classified cells (cell centre in
    polygon, first by key); octagons without cells score 0."""
    return spatial.cell_exposure(td.cell_rows(spark, sf_dir), td.octagon_features(spark, sf_dir),
                                 feature_id="feature_id", cell=OCTAGON_CELL)


def q17_line_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineal parts of every supplier segment inside every octagon it crosses: clipped length
    (round 6) and number of parts per (segment, octagon)."""
    from ..functions.numeric import round_half_even
    clipped = overlay.clip_lines(td.supplier_lines(spark, sf_dir), td.octagon_features(spark, sf_dir),
                                 line_id="s_suppkey", feature_id="feature_id", cell=OCTAGON_CELL)
    return clipped.select("s_suppkey", F.col("feature_id").alias("n_nationkey"),
                          round_half_even("length", 6).alias("clipped_length"), "parts")


def districts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.district_table(td.octagon_features(spark, sf_dir))


def environment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.cell_exposure(td.cell_rows(spark, sf_dir), td.octagon_features(spark, sf_dir),
                                 feature_id="arrondissement", cell=OCTAGON_CELL)


def theme_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The tables the summary joins, stored side by side: they do not depend on one another, and some are
    read several times (as the build rereads its Gold tables)."""
    makers = {"sales": q01_sales_district_year, "income": income, "rents": rents, "social": social, "environment": environment}
    return stored_together({name: lambda make=make: make(spark, sf_dir) for name, make in makers.items()})


def district_summary(spark: SparkSession, sf_dir: str, tables: dict[str, DataFrame] | None = None) -> DataFrame:
    t = tables or theme_tables(spark, sf_dir)
    return summary.district_summary(districts(spark, sf_dir), t["sales"], t["income"], t["rents"], t["social"], t["environment"])


def overview_rows(spark: SparkSession, sf_dir: str, year: int | None = None) -> DataFrame:
    """Overview rows (district grain), materialised for consumers that read them repeatedly."""
    t = theme_tables(spark, sf_dir)
    return stored(summary.overview(district_summary(spark, sf_dir, t), t["sales"], year), "overview")


def q18_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """District summary: every district with latest sales, income, latest rents and social
    housing, 5-year social units, environment; fills and derived indices."""
    return district_summary(spark, sf_dir)


def q19_quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Environmental pressure index and quality-of-life score from the cell exposure."""
    return summary.environment_indices(q16_weighted_exposure(spark, sf_dir))


def q20_city_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """City roll-up of the district summary."""
    return summary.city_rollup(district_summary(spark, sf_dir))


OVERVIEW_YEAR = 1998


def q21_overview_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overview for a chosen sales year: that year's sales block, months of income, price rank."""
    t = theme_tables(spark, sf_dir)
    return summary.overview(district_summary(spark, sf_dir, t), t["sales"], OVERVIEW_YEAR)


TIMELINE_DISTRICT = 7


def q22_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One district's sales, social and rent series in long form."""
    return summary.timeline(q01_sales_district_year(spark, sf_dir), social(spark, sf_dir),
                            rents(spark, sf_dir), TIMELINE_DISTRICT, districts(spark, sf_dir))


COMPARE_PAIR = (3, 11)


def q23_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two districts side by side for the latest sales year, with deltas."""
    return summary.compare(overview_rows(spark, sf_dir), *COMPARE_PAIR)


def q29_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage counters of the geocoded sales after attaching quarters and census blocks
    (two point-in-polygon joins on the geocoded coordinates; the octagons stand in for both layers)."""
    feats = td.octagon_features(spark, sf_dir)
    geo = materialize(geocoded_sales(spark, sf_dir))  # read by both spatial joins and the counters
    geo = spatial.attach_points(geo, feats, x="longitude", y="latitude", feature_id="feature_id",
                                order="feature_id", mapping={"feature_id": "quartier_id", "name": "quartier_name"},
                                cell=OCTAGON_CELL)
    geo = spatial.attach_points(geo, feats, x="longitude", y="latitude",
                                feature_id="feature_id", order="feature_id",
                                mapping={"feature_id": "iris_code", "region": "iris_type"}, cell=OCTAGON_CELL)
    return metrics.coverage(materialize(geo))


MAP_HEADER = ["map_level", "level_label", "selected_metric", "metric_label", "metric_unit", "supports_year", "metric_year"]


def district_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Octagon features as the served district layer."""
    return summary.district_layer(td.octagon_features(spark, sf_dir))


def q24_map_district(spark: SparkSession, sf_dir: str) -> DataFrame:
    """District map layer for the latest sales year, metric = median price per m2."""
    layer = serving.map_layer("arrondissement", "median_price_m2",
                              features=district_features(spark, sf_dir), overview=overview_rows(spark, sf_dir))
    return layer.select("arrondissement", "name", "perimeter_m", "metric_value", *MAP_HEADER,
                        F.col("geometry.type").alias("geometry_type"))


def q25_map_quarter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarter map layer (every quarter; last row per quarter wins), metric = transactions."""
    feats = td.octagon_features(spark, sf_dir).select(
        F.col("feature_id").cast("string").alias("quartier_id"), "arrondissement", "geometry")
    layer = serving.map_layer("quartier", "transactions", features=feats,
                              yearly=q02_sales_quarter_year(spark, sf_dir))
    return layer.select("quartier_id", "arrondissement", "metric_value", *MAP_HEADER)


def street_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlay.street_reference(td.part_street_lines(spark, sf_dir), district_features(spark, sf_dir),
                                    cell=OCTAGON_CELL)


def q26_map_street(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Street map layer: street pieces (lines clipped to districts) with a sales row for the
    latest year, metric = median price per m2."""
    layer = serving.map_layer("street", "median_price_m2", features=street_features(spark, sf_dir),
                              yearly=q03_sales_street_year(spark, sf_dir))
    return layer.select("street_ref_id", "street_key", "name", "arrondissement", "metric_value", *MAP_HEADER)


def q27_map_building(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Building map layer as points (rows with coordinates), metric = median surface."""
    layer = serving.map_layer("building", "median_surface_m2", yearly=q04_sales_building_year(spark, sf_dir))
    return layer.select("building_id", "name", "longitude", "latitude", "metric_value", *MAP_HEADER)


def q28_legend_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Legend colour stops of the district map layer."""
    return serving.legend_stops(materialize(q24_map_district(spark, sf_dir)))


def q37_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric catalogue per map level with latest and available years of the three themes (all but the
    time of the run). The sales years are those of the district x year groups."""
    years = cleaned_sales(spark, sf_dir).where(F.col("arrondissement").isNotNull()).select("year").distinct()
    return serving.metadata(spark, years, social(spark, sf_dir), rents(spark, sf_dir)).drop("generated_at")


def q30_text_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole document texts normalised (NFKD, ASCII, upper, punctuation to spaces, squeezed)."""
    from ..functions.text import normalize_text
    return td.document_texts(spark, sf_dir).select("doc_id", normalize_text("text").alias("normalized"))


def q31_street_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Street names assembled from non-empty parts, normalised, abbreviations expanded."""
    from ..functions.text import join_nonempty, normalize_street_name
    raw = td.raw_street_names(spark, sf_dir)
    name = join_nonempty("c_desi", "c_liaison", "l_voie")
    return raw.select("p_partkey", name.alias("raw_name"), normalize_street_name(name).alias("street_name"))


def q32_french_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """French-formatted amounts parsed back to numbers; unparsable text becomes NULL."""
    from ..functions.numeric import parse_french_number
    return td.french_amounts(spark, sf_dir).select(
        "c_custkey", parse_french_number("amount_text").alias("amount"))


def q33_postal_district(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postal code -> district, digits of the code, district from a block code's position."""
    from ..functions.codes import positional_district
    from ..functions.text import extract_digits
    pc = td.postal_codes(spark, sf_dir)
    return pc.select("c_custkey", postal_code_to_district("postal_code").alias("district"),
                     extract_digits("postal_code").alias("digits"),
                     positional_district("block_code").alias("block_district"))


def q34_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sale keys from raw parts: INSEE, parcel id, number, suffix, street, address keys,
    transaction id, street key and building label."""
    typed = sales.type_raw_sales(td.raw_sale_keys(spark, sf_dir).withColumn("year", F.lit(2024))
                                 .withColumn("Code postal", F.lit("75001"))
                                 .withColumn("Nature mutation", F.lit("Vente"))
                                 .withColumn("Reference document", F.lit(None).cast("string"))
                                 .withColumn("Identifiant de document", F.lit(None).cast("string"))
                                 .withColumn("Nombre pieces principales", F.lit(None).cast("string")))
    keyed = sales.micro_geography_keys(typed.withColumn("matched_cle_interop", F.lit(None).cast("string")))
    return keyed.select("commune_insee", "parcel_id", "house_number", "house_suffix", "street_name",
                        "address_key", "address_key_no_suffix", "transaction_id", "street_key",
                        "building_id", "building_id_source", "building_label")


def q35_lambert93(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WGS84 -> Lambert-93 projection of points around the city (metres, round 3)."""
    from ..functions.geo import lambert93
    from ..functions.numeric import round_half_even
    pts = td.nation_lon_lat(spark, sf_dir)
    x, y = lambert93("lon", "lat")
    return pts.select("n_nationkey", round_half_even(x, 3).alias("x"), round_half_even(y, 3).alias("y"))


def _scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint location for a query's written files."""
    import uuid
    from ..session import checkpoint_dir
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def q36_geojson_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """District polygons written as GeoJSON feature lines, read back, typed, edges counted."""
    from ..sinks import writers
    from ..sources import readers
    path = writers.write_geojson_lines(td.octagon_features(spark, sf_dir).select("properties", "geometry"),
                                       _scratch(spark, "q36"), properties="properties")
    back = readers.read_geojson(spark, path, lines=True)
    table_ = summary.district_table(back)
    edges = back.select(F.col("properties")["c_ar"].cast("int").alias("arrondissement"),
                        F.size(spatial.ring_edges(spatial.polygon_rings("geometry"))).alias("n_edges"))
    return table_.join(edges, "arrondissement").select(
        "arrondissement", "name", "label", "insee_code", "postal_code", "surface_m2", "n_edges")


def q38_filtered_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """National sales text (one folder per year) filtered to the city's department, reread as
    yearly files (year from the name; files without a 20xx year skipped), then cleaned."""
    from ..sources import readers
    national = _scratch(spark, "q38-national")
    td.national_sales_text(spark, sf_dir).write.option("header", True).option("sep", "|") \
        .partitionBy("valeursfoncieres").csv(national)
    filtered = readers.filter_national_sales(spark, national, "75", _scratch(spark, "q38-city"),
                                             partition_by="valeursfoncieres")
    cleaned = sales.clean_raw_sales(readers.read_sales(spark, filtered))
    return cleaned.select("year", "date_mutation", "sale_value_eur", "built_surface_m2",
                          "arrondissement", "property_type", "commune_insee", "parcel_id")


def q39_gold_sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """District x year metrics written as a Gold table (Parquet partitioned by year plus a
    CSV copy) and read back."""
    from ..sinks import writers
    from ..sources import readers
    base = _scratch(spark, "q39")
    path = writers.write_table(q01_sales_district_year(spark, sf_dir), f"{base}/sales_yearly",
                               partition_by="year", csv_path=f"{base}/sales_yearly_csv")
    return readers.read_table(spark, path).select(
        "arrondissement", F.col("year").cast("int").alias("year"), *metrics.METRIC_COLUMNS)


def q51_gold_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Street x year metrics written as a globally ordered Gold table and read back with their places."""
    from ..sinks import writers
    from ..sources import readers
    path = writers.write_table(q03_sales_street_year(spark, sf_dir), _scratch(spark, "q51"), order=metrics.STREET_KEYS)
    return readers.read_in_order(spark, path).select("position", *metrics.STREET_KEYS, "transactions", "median_price_m2")


def q41_overview_city(spark: SparkSession, sf_dir: str) -> DataFrame:
    """City block of the overview for the chosen sales year."""
    return summary.overview_city(overview_rows(spark, sf_dir, OVERVIEW_YEAR))


def q40_neutral_environment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neutral environment rows for every district (used when the noise layer is skipped)."""
    return summary.neutral_environment(districts(spark, sf_dir))


def q42_sales_block_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales points attached to census-block polygons, then the metric block per block x year."""
    pts = materialize(cleaned_sales(spark, sf_dir).select(
        "year", "transaction_id", "price_per_m2", "sale_value_eur", "built_surface_m2", "rooms",
        "property_type", "longitude", "latitude"))
    blocks = td.octagon_features(spark, sf_dir).withColumn("block_type", F.concat(F.lit("T"), F.col("region").cast("string")))
    located = spatial.attach_points(
        pts, blocks, x="longitude", y="latitude", feature_id="feature_id", order="feature_id",
        mapping={"feature_id": "iris_code", "name": "iris_name", "block_type": "iris_type", "arrondissement": "arrondissement"})
    return _metrics(located.withColumn("iris_code", F.col("iris_code").cast("string")),
                    ["iris_code", "iris_name", "iris_type", "arrondissement", "year"])


def _as_text(df: DataFrame, path: str) -> str:
    """Rows written as the ``;`` separated text the readers expect."""
    df.write.option("header", True).option("sep", ";").option("escape", '"').csv(path)
    return path


def q43_address_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Address reference text written, read and prepared: normalised parts, numbers, certification."""
    from ..sources import readers
    path = _as_text(td.address_rows(spark, sf_dir), _scratch(spark, "q43"))
    return geocode.prepare_address_reference(readers.read_addresses(spark, path)).select(
        "cle_interop", "commune_insee", "house_number", "house_suffix", "street_name", "long", "lat", "certification")


def q44_income_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Income table written as text, read and aggregated per district."""
    from ..sources import readers
    path = _as_text(td.income_rows(spark, sf_dir), _scratch(spark, "q44"))
    return metrics.income_metrics(themes.prepare_income(readers.read_income(spark, path)))


def q45_rent_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rent-cap text written, read and aggregated per district x year."""
    from ..sources import readers
    path = _as_text(td.rent_rows(spark, sf_dir), _scratch(spark, "q45"))
    return metrics.rent_metrics(themes.prepare_rents(readers.read_rents(spark, path)))


def q46_social_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Social-housing text written, read and aggregated per district x year."""
    from ..sources import readers
    path = _as_text(td.social_rows(spark, sf_dir), _scratch(spark, "q46"))
    return metrics.social_metrics(themes.prepare_social(readers.read_social(spark, path)))


def q47_quarter_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarter polygons written as GeoJSON lines, read back and typed."""
    from ..sinks import writers
    from ..sources import readers
    path = writers.write_geojson_lines(td.quarter_features(spark, sf_dir), _scratch(spark, "q47"), properties="properties")
    table_ = readers.quarter_table(readers.read_geojson(spark, path, lines=True))
    return table_.select("quartier_id", "quartier_code", "arrondissement", "name", "surface_m2", "perimeter_m",
                         F.col("geometry.type").alias("geometry_type"))


def q48_block_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Census-block text with polygons as GeoJSON text written, read, edges counted."""
    from ..sources import readers
    path = _as_text(td.block_shapes(spark, sf_dir), _scratch(spark, "q48"))
    blocks = readers.read_iris(spark, path)
    return blocks.select("iris_code", "iris_name", "iris_type", "arrondissement", "commune_insee",
                         F.size(spatial.ring_edges(spatial.polygon_rings("geometry"))).alias("n_edges"))


def q49_cell_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classified cells stored, read and turned into district exposure."""
    from ..sources import readers
    path = _scratch(spark, "q49")
    td.cell_rows(spark, sf_dir).write.parquet(path)
    return spatial.cell_exposure(readers.read_cells(spark, path), td.octagon_features(spark, sf_dir), feature_id="feature_id")


def q50_link_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Link table stored, two delivered batches merged through storage, the newest version read."""
    from ..sinks import writers
    from ..sources import readers
    base = _scratch(spark, "q50")
    writers.write_links_versioned(td.link_rows(spark, sf_dir), base)
    batch = td.delivered_link_rows(spark, sf_dir)
    for part in (batch, batch.withColumn("id_adr", F.lit("")).withColumn("nb_adr", F.lit("0"))):
        writers.write_links_versioned(geocode.merge_links(readers.read_links(spark, base), part), base)
    return readers.read_links(spark, base)


QUERIES = {
    "q01_sales_district_year": q01_sales_district_year,
    "q02_sales_quarter_year": q02_sales_quarter_year,
    "q03_sales_street_year": q03_sales_street_year,
    "q04_sales_building_year": q04_sales_building_year,
    "q05_income_by_district": q05_income_by_district,
    "q06_rent_by_district_year": q06_rent_by_district_year,
    "q07_social_by_district_year": q07_social_by_district_year,
    "q08_five_year_sum": q08_five_year_sum,
    "q09_latest_year_rows": q09_latest_year_rows,
    "q10_reference_dedupe": q10_reference_dedupe,
    "q11_lookup_cascade": q11_lookup_cascade,
    "q12_best_link": q12_best_link,
    "q13_anti_missing_ids": q13_anti_missing_ids,
    "q14_merge_keep_last": q14_merge_keep_last,
    "q15_point_in_polygon": q15_point_in_polygon,
    "q16_weighted_exposure": q16_weighted_exposure,
    "q17_line_overlay": q17_line_overlay,
    "q18_summary": q18_summary,
    "q19_quality_score": q19_quality_score,
    "q20_city_rollup": q20_city_rollup,
    "q21_overview_rank": q21_overview_rank,
    "q22_timeline": q22_timeline,
    "q23_compare": q23_compare,
    "q24_map_district": q24_map_district,
    "q25_map_quarter": q25_map_quarter,
    "q26_map_street": q26_map_street,
    "q27_map_building": q27_map_building,
    "q28_legend_stops": q28_legend_stops,
    "q29_coverage": q29_coverage,
    "q30_text_normalise": q30_text_normalise,
    "q31_street_alias": q31_street_alias,
    "q32_french_number": q32_french_number,
    "q33_postal_district": q33_postal_district,
    "q34_keys": q34_keys,
    "q35_lambert93": q35_lambert93,
    "q37_metadata": q37_metadata,
    "q36_geojson_roundtrip": q36_geojson_roundtrip,
    "q38_filtered_ingest": q38_filtered_ingest,
    "q39_gold_sinks": q39_gold_sinks,
    "q40_neutral_environment": q40_neutral_environment,
    "q41_overview_city": q41_overview_city,
    "q42_sales_block_year": q42_sales_block_year,
    "q43_address_file": q43_address_file,
    "q44_income_file": q44_income_file,
    "q45_rent_file": q45_rent_file,
    "q46_social_file": q46_social_file,
    "q47_quarter_layer": q47_quarter_layer,
    "q48_block_file": q48_block_file,
    "q49_cell_file": q49_cell_file,
    "q50_link_batches": q50_link_batches,
    "q51_gold_in_order": q51_gold_in_order,
}
