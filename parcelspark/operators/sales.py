"""Sales cleaning: typed fields, row filters and the derived keys of each transaction.

All functions are lazy ``DataFrame -> DataFrame`` steps; their row filters are plain predicates,
so Catalyst pushes them below joins and into Parquet scans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import codes, numeric, text

# ---- fixed values (domain rules of the reference pipeline) ---------------------------------
SALE_NATURE = "Vente"
APARTMENT = "Appartement"
HOUSE = "Maison"
MIN_SURFACE_EXCLUSIVE = 10.0
MIN_VALUE_EXCLUSIVE = 10000.0
PRICE_PER_M2_RANGE = (1000.0, 50000.0)
DISTRICT_RANGE = (1, 20)
# Columns of the raw national sales text that the pipeline reads.
RAW_SALES_COLUMNS = [
    "Date mutation", "Nature mutation", "Valeur fonciere", "No voie", "B/T/Q", "Type de voie",
    "Voie", "Code postal", "Code departement", "Code commune", "Prefixe de section", "Section",
    "No plan", "Reference document", "Identifiant de document", "Type local",
    "Surface reelle bati", "Nombre pieces principales",
]
# the stored geocoded sales: column of the working table -> stored name, in order
GEOCODED_COLUMNS = {
    "year": "year", "date_mutation": "Date mutation", "reference_document": "Reference document",
    "document_id": "Identifiant de document", "arrondissement": "arrondissement",
    "commune_insee": "commune_insee", "house_number": "house_number", "house_suffix": "house_suffix",
    "street_key": "street_key", "street_name": "street_name", "sale_value_eur": "sale_value_eur",
    "built_surface_m2": "built_surface_m2", "price_per_m2": "price_per_m2", "property_type": "Type local",
    "parcel_id": "parcel_id", "building_id": "building_id", "building_id_source": "building_id_source",
    "building_label": "building_label", "matched_cle_interop": "matched_cle_interop",
    "geocode_source": "geocode_source", "longitude": "longitude", "latitude": "latitude",
    "quartier_id": "quartier_id", "quartier_name": "quartier_name", "iris_code": "iris_code",
    "iris_name": "iris_name", "iris_type": "iris_type",
}
# ---------------------------------------------------------------------------------------------


def filter_sales(df: DataFrame, *, nature_col: str = "nature_mutation", nature: str = SALE_NATURE,
                 kind_col: str = "property_type", kinds: tuple[str, ...] = (APARTMENT, HOUSE),
                 district_col: str = "arrondissement", value_col: str = "sale_value_eur",
                 surface_col: str = "built_surface_m2") -> DataFrame:
    """Keep sales of the wanted nature and kinds inside the city, with plausible surface, value
    and price per m2; adds ``price_per_m2``. Bounds are inclusive except surface and value."""
    value, surface = F.col(value_col), F.col(surface_col)
    price = value / surface
    lo, hi = PRICE_PER_M2_RANGE
    return (df.where((F.col(nature_col) == nature)
                     & F.col(district_col).between(*DISTRICT_RANGE)
                     & F.col(kind_col).isin(*kinds)
                     & (surface > MIN_SURFACE_EXCLUSIVE) & (value > MIN_VALUE_EXCLUSIVE)
                     & price.between(lo, hi))
              .withColumn("price_per_m2", price))


def address_fields(df: DataFrame, *, dep: str, commune: str, number: str, suffix: str,
                   street: str, street_type: str | None = None) -> DataFrame:
    """Adds commune_insee, house_number, house_suffix, street_name and both address keys
    (``insee|number|suffix|street`` and ``insee|number|street``)."""
    c = F.col
    raw_street = c(street) if street_type is None else F.concat_ws(
        " ", F.coalesce(c(street_type), F.lit("")), F.coalesce(c(street), F.lit("")))
    out = df.select(
        "*",
        codes.commune_insee(c(dep), c(commune)).alias("commune_insee"),
        text.normalize_house_number(c(number)).alias("house_number"),
        text.normalize_house_suffix(c(suffix)).alias("house_suffix"),
        text.normalize_street_name(raw_street).alias("street_name"))
    return out.select(
        "*",
        codes.pipe_key("commune_insee", "house_number", "house_suffix", "street_name").alias("address_key"),
        codes.pipe_key("commune_insee", "house_number", "street_name").alias("address_key_no_suffix"))


def type_raw_sales(raw: DataFrame) -> DataFrame:
    """Raw all-string sales rows -> typed fields + keys (district, values, INSEE, parcel,
    address keys, transaction id). ``year`` must already be present (from the file name)."""
    c = F.col
    typed = raw.select(
        "year", "Code departement", "Code commune", "No voie", "B/T/Q", "Type de voie", "Voie",
        c("Date mutation").alias("date_mutation"),
        c("Nature mutation").alias("nature_mutation"),
        c("Reference document").alias("reference_document"),
        c("Identifiant de document").alias("document_id"),
        c("Type local").alias("property_type"),
        c("Valeur fonciere").alias("raw_value"),
        c("Surface reelle bati").alias("raw_surface"),
        codes.postal_code_to_district(c("Code postal")).alias("arrondissement"),
        numeric.parse_french_number(c("Valeur fonciere")).alias("sale_value_eur"),
        numeric.parse_french_number(c("Surface reelle bati")).alias("built_surface_m2"),
        numeric.parse_french_number(c("Nombre pieces principales")).alias("rooms"),
        codes.parcel_id(c("Code departement"), c("Code commune"), c("Prefixe de section"),
                        c("Section"), c("No plan")).alias("parcel_id"),
    )
    typed = address_fields(typed, dep="Code departement", commune="Code commune", number="No voie",
                           suffix="B/T/Q", street="Voie", street_type="Type de voie")
    typed = typed.drop("Code departement", "Code commune", "No voie", "B/T/Q", "Type de voie", "Voie")
    return typed.select(
        "*",
        codes.pipe_key("date_mutation", "raw_value", "parcel_id", "house_number", "street_name",
                       "property_type", "raw_surface").alias("transaction_id"),
    )


def clean_raw_sales(raw: DataFrame) -> DataFrame:
    """Typed, filtered sales (the Silver transactions table)."""
    return filter_sales(type_raw_sales(raw))


def micro_geography_keys(df: DataFrame) -> DataFrame:
    """Street key, building id with its source tag, and building label.

    Building id: matched address id, else parcel id, else address key (empty counts as missing),
    tagged ``ban_address`` / ``parcel`` / ``address_key``. Label: number, suffix and street
    squeezed; empty label falls back to the building id.
    """
    def nonempty(col):
        v = F.coalesce(F.col(col).cast("string"), F.lit(""))
        return F.when(v != "", v)

    matched, parcel, addr = nonempty("matched_cle_interop"), nonempty("parcel_id"), nonempty("address_key")
    building_id = F.coalesce(matched, parcel, addr)
    source = (F.when(matched.isNotNull(), F.lit("ban_address"))
               .when(parcel.isNotNull(), F.lit("parcel"))
               .when(addr.isNotNull(), F.lit("address_key")))
    part = lambda col: F.coalesce(F.col(col).cast("string"), F.lit(""))
    number = text.squeeze_spaces(F.concat_ws(" ", part("house_number"), part("house_suffix")))
    label = text.squeeze_spaces(F.concat_ws(" ", number, part("street_name")))
    return (df.withColumn("street_key", codes.street_key("commune_insee", "street_name"))
              .withColumn("building_id", building_id)
              .withColumn("building_id_source", source)
              .withColumn("building_label", F.coalesce(F.when(label != "", label), building_id)))
