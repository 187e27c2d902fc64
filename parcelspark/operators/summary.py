"""District summary: theme tables joined on the district table, gaps filled, indices derived.

All inputs here are district-grain tables (one row per district, or per district x year), so
their size is bounded by the domain (20 districts, a few years) no matter how many sales,
addresses or cells produced them. Latest years are scalar subqueries and the column medians for the fills
are windows over the district table, all in one plan; pass stored tables where they are costly to make.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import clip, round_half_even, safe_ratio
from .metrics import METRIC_COLUMNS, five_year_sum
from .quantile import median_of

# ---- fixed values (domain rules of the reference pipeline) ---------------------------------
QUALITY_OF_LIFE_WEIGHTS = {"noise_norm": 0.30, "air_norm": 0.30, "high_noise_norm": 0.25, "env_norm": 0.15}
NEUTRAL_ENVIRONMENT_DEFAULTS = {"noise_score": 2.0, "air_score": 2.0, "high_noise_share_pct": 50.0}
ZERO_FILL = ["social_units_financed", "social_units_financed_5y", "program_count"]
MEDIAN_FILL = ["reference_rent_eur_m2", "reference_rent_majorated_eur_m2",
               "reference_rent_minorated_eur_m2", "median_income_eur", "poverty_rate_pct",
               "first_quartile_income_eur", "third_quartile_income_eur", "share_taxable_pct"]
# ---------------------------------------------------------------------------------------------


def district_table(features: DataFrame, props: str = "properties") -> DataFrame:
    """District polygons' properties -> typed district table (id, name, label, INSEE code,
    postal code ``75`` + 3-digit id, surface rounded to 2)."""
    p = F.col(props)
    arr = p["c_ar"].cast("double").cast("int")
    return features.select(
        arr.alias("arrondissement"),
        p["l_aroff"].alias("name"),
        p["l_ar"].alias("label"),
        p["c_arinsee"].cast("double").cast("int").alias("insee_code"),
        F.concat(F.lit("75"), F.lpad(arr.cast("string"), 3, "0")).alias("postal_code"),
        round_half_even(p["surface"].cast("double"), 2).alias("surface_m2"))


def district_layer(features: DataFrame, props: str = "properties") -> DataFrame:
    """District polygons as the served layer: typed properties with surface and perimeter (round 2),
    and the geometry."""
    p = F.col(props)
    return features.select(
        p["c_ar"].cast("double").cast("int").alias("arrondissement"),
        p["c_arinsee"].cast("double").cast("int").alias("insee_code"),
        p["l_aroff"].alias("name"), p["l_ar"].alias("label"),
        round_half_even(p["surface"].cast("double"), 2).alias("surface_m2"),
        round_half_even(p["perimetre"].cast("double"), 2).alias("perimeter_m"), "geometry")


def neutral_environment(districts: DataFrame) -> DataFrame:
    """Environment table used when the noise layer is skipped: defaults for every district."""
    d = NEUTRAL_ENVIRONMENT_DEFAULTS
    return districts.select(
        "arrondissement", F.lit(d["noise_score"]).alias("noise_score"),
        F.lit(d["air_score"]).alias("air_score"),
        F.lit(d["high_noise_share_pct"]).alias("high_noise_share_pct"),
        F.lit(0).cast("long").alias("noise_cell_count"))


def environment_indices(df: DataFrame) -> DataFrame:
    """Adds environmental_pressure_index (clip 0..100, round 1) and quality_of_life_score
    (weighted normalised scores using the *rounded* pressure index, round 2)."""
    env = round_half_even(clip(((F.col("noise_score") - 1.0) / 2.0) * 60.0
                               + ((F.col("air_score") - 1.0) / 2.0) * 40.0, 0.0, 100.0), 1)
    df = df.withColumn("environmental_pressure_index", env)
    w = QUALITY_OF_LIFE_WEIGHTS
    noise_norm = clip(1.0 - ((F.col("noise_score") - 1.0) / 2.0), 0.0, 1.0)
    air_norm = clip(1.0 - ((F.col("air_score") - 1.0) / 2.0), 0.0, 1.0)
    high_norm = clip(1.0 - (F.col("high_noise_share_pct") / 100.0), 0.0, 1.0)
    env_norm = clip(1.0 - (F.col("environmental_pressure_index") / 100.0), 0.0, 1.0)
    score = 10.0 * (w["noise_norm"] * noise_norm + w["air_norm"] * air_norm
                    + w["high_noise_norm"] * high_norm + w["env_norm"] * env_norm)
    return df.withColumn("quality_of_life_score", round_half_even(score, 2))


def months_income_for_1sqm() -> F.Column:
    return round_half_even(safe_ratio(F.col("median_price_m2"), F.col("median_income_eur") / 12.0), 2)


def district_summary(districts: DataFrame, sales_yearly: DataFrame, income: DataFrame,
                     rents_yearly: DataFrame, social_yearly: DataFrame,
                     environment: DataFrame) -> DataFrame:
    """The district summary: latest sales, income, latest rents (``year_rent``), latest social
    (``year_social``), 5-year social units and environment, left-joined on every district; zero
    and median fills; affordability, social and environment indices; the three latest years."""
    ls = sales_yearly.agg(F.max("year")).scalar()
    lr = rents_yearly.agg(F.max("year")).scalar()
    lso = social_yearly.agg(F.max("year")).scalar()
    sales_latest = sales_yearly.where(F.col("year") == ls)
    rents_latest = rents_yearly.where(F.col("year") == lr).withColumnRenamed("year", "year_rent")
    social_latest = social_yearly.where(F.col("year") == lso).withColumnRenamed("year", "year_social")
    social_5y = five_year_sum(social_yearly)

    s = districts
    for part in [sales_latest, income, rents_latest, social_latest, social_5y, environment]:
        s = s.join(part, "arrondissement", "left")
    s = s.select(*s.columns, ls.alias("sales_year"), lr.alias("rent_year"), lso.alias("social_year"))
    # column medians over the whole district table (bounded by the number of districts), in the same plan
    whole = Window.partitionBy()
    medians = {c: median_of(c).over(whole) for c in MEDIAN_FILL + list(NEUTRAL_ENVIRONMENT_DEFAULTS)}
    fills = {**{c: [F.lit(0)] for c in ZERO_FILL}, **{c: [medians[c]] for c in MEDIAN_FILL},
             **{c: [medians[c], F.lit(default)] for c, default in NEUTRAL_ENVIRONMENT_DEFAULTS.items()}}
    s = s.select(*[F.coalesce(c, *fills[c]).alias(c) if c in fills else F.col(c) for c in s.columns])

    tx = F.when(F.col("transactions") != 0, F.col("transactions"))
    s = (s.withColumn("months_income_for_1sqm", months_income_for_1sqm())
          .withColumn("estimated_50m2_rent_effort_pct", round_half_even(
              safe_ratio(F.col("reference_rent_majorated_eur_m2") * 50.0, F.col("median_income_eur") / 12.0)
              * 100.0, 1))
          .withColumn("social_units_per_100_sales", round_half_even(
              F.coalesce(safe_ratio(F.col("social_units_financed"), tx) * 100.0, F.lit(0.0)), 1)))
    return environment_indices(s)


def city_rollup(summary: DataFrame) -> DataFrame:
    """City figures over the district summary (bounded: one row per district)."""
    med = lambda c, n=2: round_half_even(F.median(c), n).alias(c)
    return summary.agg(
        F.count_distinct("arrondissement").alias("arrondissement_count"),
        med("median_price_m2"), med("median_income_eur"), med("reference_rent_majorated_eur_m2"),
        F.sum("social_units_financed").cast("long").alias("social_units_financed"),
        F.sum("social_units_financed_5y").cast("long").alias("social_units_financed_5y"),
        med("quality_of_life_score"), med("months_income_for_1sqm"),
        med("estimated_50m2_rent_effort_pct", 1))


def overview_city(overview_rows: DataFrame) -> DataFrame:
    """The overview's city block: the roll-up over the selected year's district rows, with the
    selected sales year."""
    return city_rollup(overview_rows).select(
        "*", overview_rows.agg(F.max("selected_sales_year")).scalar().alias("selected_sales_year"))


def overview(summary: DataFrame, sales_yearly: DataFrame, year: int | None = None) -> DataFrame:
    """District rows for one sales year (latest when ``year`` is None or 0): the summary's
    sales block replaced by that year's, months of income recomputed, rank by price (1 = most
    expensive, ties share the lowest rank). Raises LookupError for a year without sales."""
    if year:
        if sales_yearly.where(F.col("year") == year).limit(1).count() == 0:
            raise LookupError(f"no sales data for {year}")
        selected = F.lit(year)
    else:
        selected = sales_yearly.agg(F.max("year")).scalar()
    yearly = sales_yearly.where(F.col("year") == selected).select("arrondissement", *METRIC_COLUMNS)
    base = summary.drop(*METRIC_COLUMNS, "months_income_for_1sqm")
    merged = base.join(yearly, "arrondissement", "left").withColumn(
        "months_income_for_1sqm", months_income_for_1sqm())
    # rank over the district table (bounded by the number of districts)
    by_price = Window.orderBy(F.col("median_price_m2").desc_nulls_last())
    return (merged.withColumn("rank_by_price",
                              F.when(F.col("median_price_m2").isNotNull(), F.rank().over(by_price)))
                  .withColumn("selected_sales_year", selected.cast("int"))
                  .orderBy("arrondissement"))  # served order; district grain


def timeline(sales_yearly: DataFrame, social_yearly: DataFrame, rents_yearly: DataFrame,
             district: int, districts: DataFrame) -> DataFrame:
    """One district's yearly series of the three themes in long form (district and its name, theme,
    year, metric, value). ``districts`` (arrondissement, name) knows the districts; an unknown one is
    a LookupError."""
    known = districts.where(F.col("arrondissement") == district).select("name").limit(1).collect()
    if not known:
        raise LookupError(f"unknown district: {district}")

    def long(df, theme):
        cols = [c for c in df.columns if c not in ("arrondissement", "year")]
        stack = "stack({}, {}) as (metric, value)".format(
            len(cols), ", ".join(f"'{c}', cast(`{c}` as double)" for c in cols))
        return (df.where(F.col("arrondissement") == district)
                  .select(F.lit(theme).alias("theme"), "year", F.expr(stack)))
    return (long(sales_yearly, "sales").unionByName(long(social_yearly, "social"))
            .unionByName(long(rents_yearly, "rents"))
            .select(F.lit(district).alias("arrondissement"), F.lit(known[0]["name"]).cast("string").alias("name"),
                    "theme", "year", "metric", "value")
            .orderBy("theme", "year", "metric"))


# ---- fixed values: compared metrics -----------------------------------------------------------
COMPARE_METRICS = ["median_price_m2", "median_income_eur", "reference_rent_majorated_eur_m2",
                   "social_units_financed", "quality_of_life_score", "months_income_for_1sqm",
                   "estimated_50m2_rent_effort_pct"]
# -----------------------------------------------------------------------------------------------


def compared_rows(overview_rows: DataFrame, left: int, right: int) -> DataFrame:
    """The two districts' overview rows, with ``side`` (``left``, ``right``). An unknown district is a
    LookupError."""
    rows = overview_rows.where(F.col("arrondissement").isin(left, right))
    known = {r["arrondissement"] for r in rows.select("arrondissement").distinct().collect()}
    for district in (left, right):
        if district not in known:
            raise LookupError(f"unknown district: {district}")
    sides = F.array(F.when(F.col("arrondissement") == left, "left"), F.when(F.col("arrondissement") == right, "right"))
    return rows.select("*", F.explode(F.array_compact(sides)).alias("side"))


def compare(overview_rows: DataFrame, left: int, right: int) -> DataFrame:
    """Metric by metric: left value, right value and delta (round 2); metrics where either
    side is missing are omitted. Each line carries the selected sales year and both names.
    Conditional aggregation, no cross join; an unknown district is a LookupError."""
    stack = "stack({}, {}) as (metric, value)".format(
        len(COMPARE_METRICS), ", ".join(f"'{c}', cast(`{c}` as double)" for c in COMPARE_METRICS))
    long = compared_rows(overview_rows, left, right).select("side", "name", "selected_sales_year", F.expr(stack))
    on = lambda side, col: F.max(F.when(F.col("side") == side, F.col(col)))
    pair = long.groupBy("metric").agg(
        F.max("selected_sales_year").alias("sales_year"), on("left", "name").alias("left_name"),
        on("right", "name").alias("right_name"), on("left", "value").alias("left_value"),
        on("right", "value").alias("right_value"))
    return (pair.where(F.col("left_value").isNotNull() & F.col("right_value").isNotNull())
                .withColumn("delta", round_half_even(F.col("left_value") - F.col("right_value"), 2))
                .select("sales_year", F.lit(left).alias("left"), "left_name", F.lit(right).alias("right"), "right_name",
                        "metric", "left_value", "right_value", "delta"))
