"""Numeric column expressions: rounding, lenient parsing, clipping, guarded ratios.

All functions take and return ``Column`` objects and stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A number written with optional sign, digits, one dot and an exponent. Anything else
# (``abc``, ``nan``, ``12d``, empty) is treated as missing, like a lenient pandas parse.
NUMBER_PATTERN = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def round_half_even(col, digits: int) -> Column:
    """Vector rounding as numpy does it: scale, round half to even, unscale."""
    scale = float(10 ** digits)
    return F.rint(_c(col) * F.lit(scale)) / F.lit(scale)


def parse_number(col) -> Column:
    """Text -> DOUBLE; anything that is not a plain decimal number becomes NULL."""
    text = F.trim(_c(col).cast("string"))
    return F.when(text.rlike(NUMBER_PATTERN), text.try_cast("double"))


def parse_french_number(col) -> Column:
    """French formatted number -> DOUBLE (``1 250 000,50`` -> 1250000.5).

    Removes no-break spaces and spaces, turns the decimal comma into a dot, then parses.
    """
    cleaned = F.translate(_c(col).cast("string"), ",\u00a0 ", ".")
    return F.when(cleaned.rlike(NUMBER_PATTERN), cleaned.try_cast("double"))


def clip(col, lower: float, upper: float) -> Column:
    """Clip to [lower, upper] keeping NULL as NULL (greatest/least alone would skip NULL)."""
    c = _c(col)
    return F.when(c.isNotNull(), F.greatest(F.lit(float(lower)), F.least(F.lit(float(upper)), c)))


def safe_ratio(numerator, denominator, default: float | None = None) -> Column:
    """numerator / denominator, NULL when the denominator is 0 or NULL (ANSI-safe)."""
    ratio = F.try_divide(_c(numerator).cast("double"), _c(denominator).cast("double"))
    return F.coalesce(ratio, F.lit(float(default))) if default is not None else ratio


def indicator(condition: Column) -> Column:
    """Boolean -> 1.0 / 0.0 as DOUBLE; a NULL condition counts as 0.0 (pandas ``eq`` on NaN)."""
    return F.when(condition, F.lit(1.0)).otherwise(F.lit(0.0))
