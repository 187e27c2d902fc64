"""Aggregates: the market metric block at any grain, and the theme tables.

Every aggregate filters NULL keys first (pandas ``groupby`` drops them, Spark keeps a NULL group),
keeps NULL (never NaN) for missing values, and rounds half to even like numpy.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import round_half_even
from ..session import stored
from .histogram import KIND, TRANSACTION, Grain, group_metrics, value_histogram
from .quantile import exact_medians

# ---- fixed values: output names of the metric block ----------------------------------------
STREET_KEYS = ["street_key", "street_name", "arrondissement", "commune_insee", "year"]
BUILDING_KEYS = ["building_id", "building_id_source", "building_label", "arrondissement",
                 "commune_insee", "street_name", "house_number", "house_suffix", "year"]
METRIC_COLUMNS = [
    "transactions", "median_price_m2", "median_sale_value_eur", "median_surface_m2",
    "median_rooms", "apartment_share_pct", "house_share_pct",
]
# ---------------------------------------------------------------------------------------------


def _not_null_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    cond = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys], F.lit(True))
    return df.where(cond)


# medians of the metric block: output name -> metric of the histogram
MEDIANS = {"median_price_m2": "price_m2", "median_sale_value_eur": "sale_value", "median_surface_m2": "surface",
           "median_rooms": "rooms"}


def block_grain(keys: list[str], *, tx: str = "transaction_id", price: str = "price_per_m2",
                value: str = "sale_value_eur", surface: str = "built_surface_m2", rooms: str = "rooms",
                kind: str = "property_type", more_values: dict[str, str] | None = None,
                more_labels: dict | None = None) -> Grain:
    """What the metric block needs of each sale at one grain; ``more_values`` and ``more_labels`` add a
    grain's own metrics."""
    return Grain(keys, {"price_m2": price, "sale_value": value, "surface": surface, "rooms": rooms, **(more_values or {})},
                 {TRANSACTION: tx, KIND: F.coalesce(F.col(kind), F.lit("")), **(more_labels or {})})


def metric_block(histogram: DataFrame, grain: str, keys: list[str], *, apartment: str = "Appartement", house: str = "Maison",
                 more_medians: dict[str, str] | None = None, more_distinct: dict[str, str] | None = None) -> DataFrame:
    """The metric block of one grain of a stored histogram: distinct transactions, exact medians of price/m2,
    value, surface and rooms, apartment and house share in % (round 1), all metrics round 2; then the grain's
    own distinct counts and medians as they are."""
    own = group_metrics(histogram, grain, keys, medians={**MEDIANS, **(more_medians or {})},
                        distinct={"transactions": TRANSACTION, **(more_distinct or {})},
                        shares={"_apt": apartment, "_house": house})
    share = lambda c: round_half_even(round_half_even(F.col(c) * 100.0, 1), 2)
    return own.select(*keys, "transactions", *[round_half_even(m, 2).alias(m) for m in MEDIANS],
                      share("_apt").alias("apartment_share_pct"), share("_house").alias("house_share_pct"),
                      *(more_distinct or {}), *(more_medians or {}))


def sales_metrics(df: DataFrame, keys: list[str], *, apartment: str = "Appartement", house: str = "Maison",
                  **columns) -> DataFrame:
    """The metric block of ``df`` per group. The input is read once, into a stored histogram of this grain."""
    return metric_block(stored(value_histogram(df, {"group": block_grain(keys, **columns)}), "histogram"), "group", keys,
                        apartment=apartment, house=house)


GEOCODED_TRANSACTION = "geocoded_transaction"
PLACE_MEDIANS = {"longitude": "longitude", "latitude": "latitude"}
STREET_DISTINCT = {"buildings": "building", "geocoded_transactions": GEOCODED_TRANSACTION}
BUILDING_DISTINCT = {"geocoded_transactions": GEOCODED_TRANSACTION, "parcel_count": "parcel"}


def street_grain() -> Grain:
    geocoded = F.when(F.col("longitude").isNotNull(), F.col("transaction_id"))
    return block_grain(STREET_KEYS, more_values=PLACE_MEDIANS, more_labels={"building": "building_id", GEOCODED_TRANSACTION: geocoded})


def building_grain() -> Grain:
    geocoded = F.when(F.col("longitude").isNotNull(), F.col("transaction_id"))
    return block_grain(BUILDING_KEYS, more_values=PLACE_MEDIANS, more_labels={GEOCODED_TRANSACTION: geocoded, "parcel": "parcel_id"})


def street_block(histogram: DataFrame, grain: str = "street", **kinds) -> DataFrame:
    """Street x year: metric block + distinct buildings, geocoded transactions, median lon/lat."""
    m = metric_block(histogram, grain, STREET_KEYS, more_medians=PLACE_MEDIANS, more_distinct=STREET_DISTINCT, **kinds)
    return m.select(*STREET_KEYS, "buildings", "geocoded_transactions", "longitude", "latitude", *METRIC_COLUMNS)


def building_block(histogram: DataFrame, grain: str = "building", **kinds) -> DataFrame:
    """Building x year (9 keys): metric block + geocoded transactions, median lon/lat, parcels."""
    m = metric_block(histogram, grain, BUILDING_KEYS, more_medians=PLACE_MEDIANS, more_distinct=BUILDING_DISTINCT, **kinds)
    return m.select(*BUILDING_KEYS, "geocoded_transactions", "longitude", "latitude", "parcel_count", *METRIC_COLUMNS)


def street_sales_metrics(df: DataFrame, **kinds) -> DataFrame:
    """``street_block`` of sales that are read once."""
    return street_block(stored(value_histogram(df, {"street": street_grain()}), "histogram"), **kinds)


def building_sales_metrics(df: DataFrame, **kinds) -> DataFrame:
    """``building_block`` of sales that are read once."""
    return building_block(stored(value_histogram(df, {"building": building_grain()}), "histogram"), **kinds)


# the five grains of the market tables
MARKET_GRAINS = {
    "arrondissement": lambda: block_grain(["arrondissement", "year"]),
    "quartier": lambda: block_grain(["quartier_id", "quartier_name", "arrondissement", "year"]),
    "iris": lambda: block_grain(["iris_code", "iris_name", "iris_type", "arrondissement", "year"]),
    "street": street_grain, "building": building_grain}


def market_histogram(geocoded: DataFrame, grains: tuple[str, ...] = tuple(MARKET_GRAINS)) -> DataFrame:
    """The histogram of geocoded and attached sales at all five grains, in one pass."""
    return value_histogram(geocoded, {name: MARKET_GRAINS[name]() for name in grains})


def market_table(histogram: DataFrame, grain: str, **kinds) -> DataFrame:
    """The yearly market table of one grain, from the stored histogram."""
    if grain == "street":
        return street_block(histogram, **kinds)
    if grain == "building":
        return building_block(histogram, **kinds)
    return metric_block(histogram, grain, MARKET_GRAINS[grain]().keys, **kinds)


def income_metrics(df: DataFrame, *, district: str = "arrondissement", block_id: str = "IRIS",
                   median_income: str = "DEC_MED21", poverty: str = "DEC_TP6021",
                   q1: str = "DEC_Q121", q3: str = "DEC_Q321", taxable: str = "DEC_PIMP21") -> DataFrame:
    """Per district: count of blocks, medians of median/Q1/Q3 income, means of poverty and
    taxable share, rounded to 2."""
    data = _not_null_keys(df, [district]).select(district, block_id, median_income, poverty, q1, q3, taxable)
    out = exact_medians(data, [district], {
        "median_income_eur": median_income, "first_quartile_income_eur": q1,
        "third_quartile_income_eur": q3},
        aggs=(F.count(block_id).alias("iris_count"), F.avg(poverty).alias("poverty_rate_pct"),
              F.avg(taxable).alias("share_taxable_pct")))
    r = lambda c: round_half_even(c, 2).alias(c)
    return out.select(F.col(district).alias("arrondissement"), "iris_count", r("median_income_eur"),
                      r("poverty_rate_pct"), r("first_quartile_income_eur"),
                      r("third_quartile_income_eur"), r("share_taxable_pct"))


def rent_metrics(df: DataFrame, *, district: str = "arrondissement", year: str = "year",
                 ref: str = "reference_rent_eur_m2", high: str = "reference_rent_majorated_eur_m2",
                 low: str = "reference_rent_minorated_eur_m2") -> DataFrame:
    """Per district x year: means of the three rents (round 2) and non-null reference count."""
    data = _not_null_keys(df, [district, year])
    return data.groupBy(F.col(district).alias("arrondissement"), F.col(year).alias("year")).agg(
        round_half_even(F.avg(ref), 2).alias("reference_rent_eur_m2"),
        round_half_even(F.avg(high), 2).alias("reference_rent_majorated_eur_m2"),
        round_half_even(F.avg(low), 2).alias("reference_rent_minorated_eur_m2"),
        F.count(ref).alias("rent_reference_count"))


def social_metrics(df: DataFrame, *, district: str = "arrondissement", year: str = "year",
                   program: str = "program_id", total: str = "social_units_financed",
                   pla_i: str = "pla_i_units", plus: str = "plus_units",
                   pls: str = "pls_units") -> DataFrame:
    """Per district (1..20) x year: distinct programmes and unit sums (all-missing sums to 0),
    rounded to whole units."""
    data = df.where(F.col(district).between(1, 20) & F.col(year).isNotNull())
    s = lambda c, name: round_half_even(F.coalesce(F.sum(c), F.lit(0.0)), 0).alias(name)
    return data.groupBy(F.col(district).alias("arrondissement"), F.col(year).alias("year")).agg(
        F.count_distinct(program).alias("program_count"),
        s(total, "social_units_financed"), s(pla_i, "pla_i_units"),
        s(plus, "plus_units"), s(pls, "pls_units"))


def latest_year(df: DataFrame, year: str = "year") -> DataFrame:
    """One-row DataFrame holding ``max(year)``, joined where needed (no driver round trip)."""
    return df.agg(F.max(year).alias("latest_year"))


def five_year_sum(df: DataFrame, value: str = "social_units_financed", year: str = "year",
                  key: str = "arrondissement", window_years: int = 5,
                  out: str = "social_units_financed_5y") -> DataFrame:
    """Sum of ``value`` per key over the last ``window_years`` years (``year >= max - 4``)."""
    latest = latest_year(df, year).scalar()  # scalar subquery, evaluated once
    recent = df.where(F.col(year) >= latest - (window_years - 1))
    return recent.groupBy(key).agg(F.sum(value).alias(out))


def coverage(geocoded: DataFrame) -> DataFrame:
    """Spatial coverage counters of the geocoded sales (one row): rows, distinct transactions,
    rows per geocode source, geocoded rows, rows attached to a quarter / census block, distinct
    streets and buildings with their yearly row counts, geocoded share in % (round 2).

    The street / building yearly row counts are the number of distinct group keys of those
    aggregates, so no metric aggregate is needed here. One global aggregate with partial
    aggregation, distinct counts pre-aggregated by key."""
    # one row per group key, counted twice (names and yearly rows) by one aggregate each
    streets = _not_null_keys(geocoded, STREET_KEYS).groupBy(*STREET_KEYS).agg(F.lit(1).alias("_one"))
    buildings = _not_null_keys(geocoded, BUILDING_KEYS).groupBy(*BUILDING_KEYS).agg(F.lit(1).alias("_one"))
    street_counts = streets.agg(F.struct(F.count_distinct("street_key").alias("names"), F.count("_one").alias("rows"))).scalar()
    building_counts = buildings.agg(F.struct(F.count_distinct("building_id").alias("names"), F.count("_one").alias("rows"))).scalar()
    c = F.col
    base = geocoded.agg(
        F.count(F.lit(1)).alias("input_rows"),
        F.count_distinct("transaction_id").alias("input_transactions"),
        F.count_if(c("geocode_source") == "adresses-ban").alias("adresses_ban_rows"),
        F.count_if(c("geocode_source") == "ban-plus").alias("ban_plus_rows"),
        F.count_if(c("longitude").isNotNull()).alias("geocoded_rows"),
        F.count_if(c("quartier_id").isNotNull()).alias("quartier_rows"),
        F.count_if(c("iris_code").isNotNull()).alias("iris_rows"))
    return base.select(
        "*",
        street_counts["names"].alias("street_count"), street_counts["rows"].alias("street_year_rows"),
        building_counts["names"].alias("building_count"), building_counts["rows"].alias("building_year_rows"),
        round_half_even(F.try_divide(c("geocoded_rows") * 100.0, c("input_rows")), 2).alias("geocoded_rate_pct"))
