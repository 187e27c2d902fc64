"""Served reads: metadata, map layers per level, legend stops.

Each map function returns one row per map feature (feature id, attributes, geometry,
``metric_value``) as a DataFrame; writing it as GeoJSON lines is a sink's job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quantile import kth_smallest

# ---- fixed values (metric catalogue and map levels of the reference dashboard) -------------
METRIC_CATALOG = [
    # key, label, unit, supports_year
    ("median_price_m2", "Prix median au m²", "EUR/m²", True),
    ("transactions", "Transactions retenues", "count", True),
    ("median_surface_m2", "Surface mediane", "m²", True),
    ("median_income_eur", "Revenu median", "EUR/an", False),
    ("reference_rent_majorated_eur_m2", "Loyer majore moyen", "EUR/m²", False),
    ("social_units_financed", "Logements sociaux finances", "count", True),
    ("social_units_financed_5y", "Logements sociaux finances sur 5 ans", "count", False),
    ("months_income_for_1sqm", "Mois de revenu pour 1 m²", "months", False),
    ("estimated_50m2_rent_effort_pct", "Effort locatif estime pour 50 m²", "%", False),
    ("quality_of_life_score", "Qualite de vie", "/10", False),
]
MICRO_MAP_METRICS = ("median_price_m2", "transactions", "median_surface_m2")
MAP_LEVELS = [
    # key, label, supported metrics (None = every catalogue metric)
    ("arrondissement", "Arrondissements", None),
    ("quartier", "Quartiers", MICRO_MAP_METRICS),
    ("street", "Rues", MICRO_MAP_METRICS),
    ("building", "Batiments", MICRO_MAP_METRICS),
]
# ---------------------------------------------------------------------------------------------

METRIC_KEYS = [m[0] for m in METRIC_CATALOG]
LEVEL_LABELS = {k: label for k, label, _ in MAP_LEVELS}


def level_metrics(level: str) -> tuple[str, ...]:
    for key, _, supported in MAP_LEVELS:
        if key == level:
            return tuple(METRIC_KEYS) if supported is None else supported
    raise LookupError(f"unknown map level: {level}")


def validate(metric: str, level: str) -> None:
    """Unknown metric or level -> LookupError; metric not offered at the level -> ValueError."""
    if metric not in METRIC_KEYS:
        raise LookupError(f"unknown metric: {metric}")
    if metric not in level_metrics(level):
        raise ValueError(f"level {level} supports only: {', '.join(level_metrics(level))}")


def metadata(spark, sales_yearly: DataFrame, social_yearly: DataFrame, rents_yearly: DataFrame) -> DataFrame:
    """One row per (map level, supported metric) with the metric's label, unit and year
    support, the latest / available years of each theme (scalar subqueries), and when it was made.
    The theme tables are read for their years only."""
    rows = [(lvl, lvl_label, key, label, unit, yr)
            for lvl, lvl_label, supported in MAP_LEVELS
            for key, label, unit, yr in METRIC_CATALOG if supported is None or key in supported]
    catalog = spark.createDataFrame(rows, "level string, level_label string, metric string, "
                                          "label string, unit string, supports_year boolean")
    years = F.array_join(F.sort_array(F.collect_set("year")), ",")
    return catalog.select(
        "*",
        sales_yearly.agg(F.max("year")).scalar().alias("latest_sales_year"),
        social_yearly.agg(F.max("year")).scalar().alias("latest_social_year"),
        rents_yearly.agg(F.max("year")).scalar().alias("latest_rent_year"),
        sales_yearly.agg(years).scalar().alias("available_sales_years"),
        social_yearly.agg(years).scalar().alias("available_social_years"),
        rents_yearly.agg(years).scalar().alias("available_rent_years"),
        F.current_timestamp().alias("generated_at"))


def _resolve_year(yearly: DataFrame, year: int | None):
    if year:
        if yearly.where(F.col("year") == year).limit(1).count() == 0:
            raise LookupError(f"no sales data for {year}")
        return F.lit(year)
    return yearly.agg(F.max("year")).scalar()


def _tag(df: DataFrame, metric: str, level: str, year_col) -> DataFrame:
    """Add the layer's header: level and metric with their labels, unit, year support and year."""
    label, unit, supports_year = {k: (lab, u, y) for k, lab, u, y in METRIC_CATALOG}[metric]
    return df.select("*", F.lit(level).alias("map_level"), F.lit(LEVEL_LABELS[level]).alias("level_label"),
                     F.lit(metric).alias("selected_metric"), F.lit(label).alias("metric_label"),
                     F.lit(unit).alias("metric_unit"), F.lit(supports_year).alias("supports_year"),
                     (year_col if supports_year else F.lit(None)).cast("int").alias("metric_year"))


def map_districts(features: DataFrame, overview_rows: DataFrame, metric: str) -> DataFrame:
    """District features joined with overview rows (row values override feature values); a
    feature without a row is an error, as in the served map."""
    validate(metric, "arrondissement")
    missing = features.join(overview_rows, "arrondissement", "left_anti").limit(1).count()
    if missing:
        raise LookupError("district feature without an overview row")
    out = _merge_properties(features, overview_rows, "arrondissement", "inner") \
        .withColumn("metric_value", F.col(metric).cast("double"))
    return _tag(out, metric, "arrondissement", F.col("selected_sales_year"))


def _last_row_per_key(rows: DataFrame, key: str, order_cols: list[str]) -> DataFrame:
    """One row per key: the last in table order (order_cols ascending), as a dict build would
    keep. A hash aggregate with max_by, no window over the key."""
    cols = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(*order_cols)).alias("_r")) \
               .select(key, "_r.*")


def _merge_properties(features: DataFrame, rows: DataFrame, key: str, how: str) -> DataFrame:
    """Feature properties updated with the matching row's values (a row overrides every column
    it has; a feature without a row keeps its own), as a dict update would do."""
    feats = features.select(*[F.col(c).alias(c if c in (key, "geometry") else f"_f_{c}")
                              for c in features.columns])
    joined = feats.join(rows.withColumn("_has_row", F.lit(True)), key, how)
    own = [c for c in features.columns if c not in (key, "geometry")]
    merged = [F.when(F.col("_has_row"), F.col(c)).otherwise(F.col(f"_f_{c}")).alias(c)
              if c in rows.columns else F.col(f"_f_{c}").alias(c) for c in own]
    rest = [c for c in rows.columns if c != key and c not in own]
    return joined.select(key, "geometry", *merged, *rest)


def map_quarters(features: DataFrame, quarter_yearly: DataFrame, metric: str,
                 year: int | None = None) -> DataFrame:
    """Every quarter feature, with the selected year's row of that quarter when there is one
    (``metric_value`` NULL otherwise)."""
    validate(metric, "quartier")
    sel = _resolve_year(quarter_yearly, year)
    rows = _last_row_per_key(quarter_yearly.where(F.col("year") == sel).drop("year"),
                             "quartier_id", ["quartier_name", "arrondissement"])
    out = _merge_properties(features, rows, "quartier_id", "left")
    return _tag(out.withColumn("metric_value", F.col(metric).cast("double")), metric, "quartier", sel)


def map_streets(street_features: DataFrame, street_yearly: DataFrame, metric: str,
                year: int | None = None) -> DataFrame:
    """Street pieces with a row for the selected year (pieces without sales are dropped);
    name = display name, else street name, else key."""
    validate(metric, "street")
    sel = _resolve_year(street_yearly, year)
    rows = _last_row_per_key(street_yearly.where(F.col("year") == sel).drop("year"),
                             "street_key", ["street_name", "arrondissement", "commune_insee"])
    out = _merge_properties(street_features, rows, "street_key", "inner")
    out = out.withColumn("name", F.coalesce(F.when(F.col("display_name") != "", F.col("display_name")),
                                            F.when(F.col("street_name") != "", F.col("street_name")),
                                            F.col("street_key")))
    return _tag(out.withColumn("metric_value", F.col(metric).cast("double")), metric, "street", sel)


def map_buildings(building_yearly: DataFrame, metric: str, year: int | None = None) -> DataFrame:
    """Building rows of the selected year with coordinates, as points; name = label, else id."""
    validate(metric, "building")
    sel = _resolve_year(building_yearly, year)
    rows = building_yearly.where((F.col("year") == sel) & F.col("longitude").isNotNull()
                                 & F.col("latitude").isNotNull())
    geom = F.struct(F.lit("Point").alias("type"),
                    F.to_json(F.array("longitude", "latitude")).alias("coordinates"))
    out = rows.select("*", geom.alias("geometry"),
                      F.coalesce(F.when(F.col("building_label") != "", F.col("building_label")),
                                 F.col("building_id")).alias("name"),
                      F.col(metric).cast("double").alias("metric_value"))
    return _tag(out, metric, "building", sel)


def map_layer(level: str, metric: str, **layers) -> DataFrame:
    """Dispatch by level (validation first)."""
    validate(metric, level)
    if level == "arrondissement":
        return map_districts(layers["features"], layers["overview"], metric)
    if level == "quartier":
        return map_quarters(layers["features"], layers["yearly"], metric, layers.get("year"))
    if level == "street":
        return map_streets(layers["features"], layers["yearly"], metric, layers.get("year"))
    return map_buildings(layers["yearly"], metric, layers.get("year"))


def legend_stops(layer: DataFrame, col: str = "metric_value") -> DataFrame:
    """Three colour stops over a layer's values (missing counts as 0): [min, the value at
    position floor(n/2) of the sorted values, max]; all equal -> v, v+1, v+2; empty -> 0, 0, 0."""
    values = layer.select(F.coalesce(F.col(col).cast("double"), F.lit(0.0)).alias("v"))
    mid = kth_smallest(values, "v", lambda n: F.floor(n / 2) + 1)
    ext = values.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    both = ext.select("lo", "hi", mid.select("value").scalar().alias("mid"),
                      mid.select("n").scalar().alias("n"))
    equal = F.col("lo") == F.col("hi")
    return both.select(
        F.when(F.col("n") == 0, 0.0).otherwise(F.col("lo")).alias("stop_low"),
        F.when(F.col("n") == 0, 0.0).when(equal, F.col("lo") + 1).otherwise(F.col("mid")).alias("stop_mid"),
        F.when(F.col("n") == 0, 0.0).when(equal, F.col("lo") + 2).otherwise(F.col("hi")).alias("stop_high"))


def reference_layer(spark, gold: str, level: str) -> DataFrame:
    """Reference layer served as is (quarters or streets), from the written GeoJSON lines."""
    from ..sources.readers import read_geojson
    files = {"quartier": "quartiers.geojsonl", "street": "streets.geojsonl"}
    if level not in files:
        raise LookupError(f"unknown reference layer: {level}")
    return read_geojson(spark, f"{gold}/{files[level]}", lines=True)
