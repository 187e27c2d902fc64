"""Text normalisation as native column expressions (no Python UDF).

``normalize_text`` reproduces: Unicode NFKD, drop non-ASCII, upper case, every run of characters
outside ``[A-Z0-9 ]`` becomes one space, squeeze spaces, trim; NULL becomes ``''``.

Spark has no NFKD function, so the per-character effect of NFKD + ASCII filtering is computed
once, by rule, from Python's ``unicodedata`` over all code points: characters that reduce to one
ASCII character go into a ``translate`` table, characters that reduce to several (``½`` -> ``12``)
go into a small map applied only to rows that contain one of them. NFKD acts per character apart
from the ordering of combining marks, and those are non-ASCII and dropped, so this is exact.
"""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values (domain rules of the reference pipeline) ---------------------------------
# House-number suffix aliases, applied after text normalisation; other values stay unchanged.
SUFFIX_ALIASES = {
    "B": "BIS",
    "BIS": "BIS",
    "T": "TER",
    "TER": "TER",
    "Q": "QUATER",
    "QUATER": "QUATER",
}
# Street-type token aliases, applied to every token of a normalised street name.
STREET_TOKEN_ALIASES = {
    "ALL": "ALLEE",
    "AV": "AVENUE",
    "BD": "BOULEVARD",
    "BLD": "BOULEVARD",
    "CHE": "CHEMIN",
    "CRS": "COURS",
    "FG": "FAUBOURG",
    "IMP": "IMPASSE",
    "PAS": "PASSAGE",
    "PL": "PLACE",
    "QU": "QUAI",
    "RLE": "RUELLE",
    "RTE": "ROUTE",
    "SQ": "SQUARE",
    "VLA": "VILLA",
}
# ---------------------------------------------------------------------------------------------


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


@functools.lru_cache(maxsize=1)
def ascii_fold_tables() -> tuple[dict[str, str], dict[str, str]]:
    """(single, multi): non-ASCII characters whose NFKD has ASCII residue of 1 / >1 chars."""
    single: dict[str, str] = {}
    multi: dict[str, str] = {}
    for cp in range(0x80, 0x110000):
        if 0xD800 <= cp <= 0xDFFF:
            continue
        ch = chr(cp)
        folded = unicodedata.normalize("NFKD", ch).encode("ascii", "ignore").decode("ascii")
        if len(folded) == 1:
            single[ch] = folded
        elif len(folded) > 1:
            multi[ch] = folded
    return single, multi


@functools.lru_cache(maxsize=1)
def _fold_parts():
    single, multi = ascii_fold_tables()
    src = "".join(single)
    dst = "".join(single[c] for c in single)
    return src, dst, multi, "".join(multi)


def ascii_fold(col) -> Column:
    """NFKD + drop non-ASCII, per code point (see module docstring).

    Pure-ASCII strings (one cheap regex test) pass through untouched. Otherwise the characters
    with a multi-character expansion that the string really holds (a ``translate`` that deletes them
    tells whether there are any; then the distinct ones among its non-ASCII characters) are replaced
    one after the other, and the one-character table and the non-ASCII removal apply.
    """
    src, dst, multi, multi_chars = _fold_parts()
    text = _c(col)
    multi_map = _literal_map(multi)
    rare = F.array_distinct(F.split(F.regexp_replace(text, r"[\x00-\x7F]+", ""), ""))
    present = F.filter(rare, lambda ch: F.try_element_at(multi_map, ch).isNotNull())
    has_multi = F.length(F.translate(text, multi_chars, "")) < F.length(text)
    expanded = F.when(has_multi, F.aggregate(
        present, text, lambda acc, ch: F.replace(acc, ch, F.try_element_at(multi_map, ch)))).otherwise(text)
    folded = F.regexp_replace(F.translate(expanded, src, dst), r"[^\x00-\x7F]", "")
    return F.when(text.rlike(r"[^\x00-\x7F]"), folded).otherwise(text)


def normalize_text(col) -> Column:
    text = ascii_fold(F.coalesce(_c(col).cast("string"), F.lit("")))
    text = F.regexp_replace(F.upper(text), r"[^A-Z0-9 ]+", " ")
    return F.trim(F.regexp_replace(text, " +", " "))


def _literal_map(mapping: dict[str, str]) -> Column:
    """A constant map parsed from one text literal: Catalyst folds it into one value, and each use adds two
    literals to a plan instead of two per entry. Entries are parted by control characters."""
    return F.str_to_map(F.lit("\x01".join(f"{k}\x02{v}" for k, v in mapping.items())), F.lit("\x01"), F.lit("\x02"))


def normalize_street_name(col) -> Column:
    """normalize_text, then every space-separated token goes through the alias table."""
    aliases = _literal_map(STREET_TOKEN_ALIASES)
    tokens = F.transform(F.split(normalize_text(col), " "),
                         lambda t: F.coalesce(F.try_element_at(aliases, t), t))
    return F.array_join(tokens, " ")  # '' splits to [''] and joins back to ''


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it in ``body`` (a one-element ``transform``)."""
    return F.transform(F.array(value), body)[0]


def normalize_house_suffix(col) -> Column:
    """NULL -> '', else normalised text mapped through the suffix aliases."""
    aliases = _literal_map(SUFFIX_ALIASES)
    mapped = _let(normalize_text(col), lambda n: F.coalesce(F.try_element_at(aliases, n), n))
    return F.when(_c(col).isNull(), F.lit("")).otherwise(mapped)


def extract_digits(col) -> Column:
    """Keep ASCII digits only; NULL -> ''."""
    return F.regexp_replace(F.coalesce(_c(col).cast("string"), F.lit("")), "[^0-9]", "")


def normalize_house_number(col) -> Column:
    """Digits with leading zeros removed, unless the number is all zeros."""
    digits = extract_digits(col)
    stripped = F.regexp_replace(digits, "^0+", "")
    return F.when(stripped == "", digits).otherwise(stripped)


def zfill(col, width: int) -> Column:
    """Left-pad with zeros up to ``width`` without ever truncating (lpad would truncate)."""
    c = _c(col)
    return F.when(F.length(c) < width, F.lpad(c, width, "0")).otherwise(c)


def join_nonempty(*cols, sep: str = " ") -> Column:
    """Join the trimmed, non-empty parts with ``sep`` (NULL parts are skipped)."""
    parts = F.array(*[F.trim(F.coalesce(_c(c).cast("string"), F.lit(""))) for c in cols])
    return F.array_join(F.filter(parts, lambda p: p != ""), sep)


def first_truthy(*cols) -> Column:
    """First value that is neither NULL, '' nor '0' (Python truthiness of the raw props)."""
    def _truthy(c):
        s = _c(c).cast("string")
        return F.when(s.isNotNull() & (s != "") & (s != "0"), s)
    return F.coalesce(*[_truthy(c) for c in cols])


def squeeze_spaces(col) -> Column:
    return F.trim(F.regexp_replace(_c(col), r"\s+", " "))
