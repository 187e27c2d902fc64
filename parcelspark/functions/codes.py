"""Code and key construction: postal code -> district, INSEE/parcel/address/transaction keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import parse_number
from .text import extract_digits, zfill


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def postal_code_to_district(col, city_prefix: str = "75", special: dict[str, int] | None = None,
                            max_district: int = 20) -> Column:
    """Digits of a postal code -> district number 1..max_district, else NULL.

    ``special`` lists whole codes with their own district (``75116`` -> 16 in the city data).
    Otherwise a code starting with ``city_prefix`` with at least 5 digits maps to its last two
    digits when they lie in 1..max_district.
    """
    special = {"75116": 16} if special is None else special
    digits = F.regexp_replace(_c(col).cast("string"), "[^0-9]", "")
    last_two = F.substring(digits, -2, 2).try_cast("int")
    result = F.when(digits.startswith(city_prefix) & (F.length(digits) >= 5)
                    & last_two.between(1, max_district), last_two)
    for code, district in special.items():
        result = F.when(digits == code, F.lit(district)).otherwise(result)
    return F.when(digits != "", result).cast("int")


def positional_district(col, start: int = 4, length: int = 2) -> Column:
    """District digits at a fixed position of a code (``code[3:5]``) -> INT, bad text -> NULL."""
    return parse_number(F.substring(_c(col).cast("string"), start, length)).cast("int")


def commune_insee(dep_col, commune_col) -> Column:
    """Department digits + commune digits padded to 3 (an empty commune becomes ``000``)."""
    return F.concat(extract_digits(dep_col), zfill(extract_digits(commune_col), 3))


def parcel_id(dep_col, commune_col, prefix_col, section_col, plan_col) -> Column:
    """dep + commune(3) + prefix(3, default 000) + section(upper, no spaces) + plan(4).

    NULL when the department, section or plan is empty.
    """
    dep = extract_digits(dep_col)
    commune = zfill(extract_digits(commune_col), 3)
    prefix = extract_digits(prefix_col)
    prefix = zfill(F.when(prefix == "", F.lit("000")).otherwise(prefix), 3)
    section = F.regexp_replace(F.upper(F.coalesce(_c(section_col).cast("string"), F.lit(""))), " ", "")
    plan = extract_digits(plan_col)
    value = F.concat(dep, commune, prefix, section, zfill(plan, 4))
    invalid = (dep == "") | (commune == "") | (section == "") | (plan == "")
    return F.when(~invalid, value)


def pipe_key(*cols) -> Column:
    """Join parts with ``|``; a NULL part counts as ``''`` (concat_ws alone would drop it)."""
    return F.concat_ws("|", *[F.coalesce(_c(c).cast("string"), F.lit("")) for c in cols])


def street_key(insee_col, street_col) -> Column:
    """``insee|street``, NULL when the street name is empty."""
    street = F.coalesce(_c(street_col), F.lit(""))
    return F.when(street != "", F.concat_ws("|", F.coalesce(_c(insee_col), F.lit("")), street))
