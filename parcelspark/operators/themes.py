"""Typed theme tables from raw text rows: census-block income, rent caps, social housing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import codes, numeric, text

# ---- fixed values (domain rules of the reference pipeline) ---------------------------------
CITY_BLOCK_PREFIX = "751"
INCOME_COLUMNS = ["DEC_MED21", "DEC_TP6021", "DEC_Q121", "DEC_Q321", "DEC_PIMP21"]
RENT_QUARTER_CODE_WIDTH = 7
# ---------------------------------------------------------------------------------------------


def prepare_income(raw: DataFrame) -> DataFrame:
    """Blocks of the city (code starts with 751), district from code[3:5], French numbers."""
    data = raw.where(F.col("IRIS").startswith(CITY_BLOCK_PREFIX))
    return data.select(
        "IRIS", codes.positional_district("IRIS").alias("arrondissement"),
        *[numeric.parse_french_number(c).alias(c) for c in INCOME_COLUMNS])


def prepare_rents(raw: DataFrame) -> DataFrame:
    """Year as number, quarter code padded to 7 (never truncated), district from code[3:5],
    the three rents as French numbers."""
    code = text.zfill(F.col("Numéro INSEE du quartier"), RENT_QUARTER_CODE_WIDTH)
    return raw.select(
        numeric.parse_number("Année").cast("int").alias("year"),
        codes.positional_district(code).alias("arrondissement"),
        numeric.parse_french_number("Loyers de référence").alias("reference_rent_eur_m2"),
        numeric.parse_french_number("Loyers de référence majorés").alias("reference_rent_majorated_eur_m2"),
        numeric.parse_french_number("Loyers de référence minorés").alias("reference_rent_minorated_eur_m2"))


def prepare_social(raw: DataFrame) -> DataFrame:
    """Numbers coerced (bad text -> NULL); programme id kept as text."""
    n = numeric.parse_number
    return raw.select(
        n("Arrondissement").cast("int").alias("arrondissement"),
        n("Année du financement - agrément").cast("int").alias("year"),
        n("Nombre total de logements financés").alias("social_units_financed"),
        n("Dont nombre de logements PLA I").alias("pla_i_units"),
        n("Dont nombre de logements PLUS").alias("plus_units"),
        n("Dont nombre de logements PLS").alias("pls_units"),
        F.col("Identifiant livraison").alias("program_id"))
