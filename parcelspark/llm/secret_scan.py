"""Secret scans by SQL functions only: fixed patterns plus sliding-window entropy.

Candidate strings are long runs of key characters that hold a digit. A candidate is cut into pieces at its
joints ('=', '/', '_', '+', '-'); one without any word or number between joints is taken whole, as keys in
base64 hold joints themselves. A window slides over each piece; symbol counts change by the entering and
the leaving character, and the window's Shannon entropy follows from the running sum of c * log2(c). A
piece is a secret if its largest window entropy reaches the limit of its character class and readable words
make up at most ``MAX_WORDS`` of it. Allow-listed strings are suppressed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from parcelspark.llm import spans as sp

KINDS = ["assign", "access", "hex", "entropy"]
ASSIGN = (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"              # maximal runs; shorter runs are dropped anyway
MIN_VALUE, MIN_ACCESS = 8, 16

WINDOW = 20
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
# least window entropy (bits) of a secret, per character class
LIMITS = {"hex": 2.8, "lower": 3.4, "mixed": 3.6}
MIN_PIECE = 18
JOINT = "[=/_+-]+"
TOKEN = "[=/_+-]+|[^=/_+-]+"
# pieces that show a candidate to be a path, slug or identifier: a word, a number, a time stamp
ORDINARY_PIECE = "^(?:(?:[A-Z]?[a-z]{3,}|[A-Z]{3,})[0-9]{0,4}|[0-9]{4,}|[0-9]{8}T[0-9]{4,6}Z?)$"
# readable words inside a piece: letter runs with a vowel and without letter pairs that words do not have
SEGMENT = "[A-Z]?[a-z]{2,}|[A-Z]{3,}"
VOWEL = "(?i)[aeiouy]"
ODD_LETTERS = "(?i)q[^u]|[jvz][bcdfgkmpqtwx]|[bcdfghkmpqtvwz][jqxz]|x[bdfgjkmnqrvwxz]|[bcdfgjkmpqvwxz]{3}|[bcdfghjklmnpqrstvwxz]{5}"
MAX_WORDS = 0.6
ALLOW = [
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",   # identifiers, not keys
    r"(?i)(?<![a-z0-9])(?:example|sample|dummy|placeholder|changeme|test)(?![a-z0-9])|xxxx",
    r"(?i)0123456789|abcdefghij",
]


def _clog(count: Column) -> Column:
    return F.when(count > 0, count * F.log2(count.cast("double"))).otherwise(F.lit(0.0))


def window_entropy(value: Column, window: int = WINDOW) -> Column:
    """Largest Shannon entropy of any ``window`` consecutive characters (all, if the value is shorter)."""
    chars = F.filter(F.split(value, ""), lambda c: c != "")
    symbols = F.array_distinct(chars)

    def step(acc: Column, i: Column) -> Column:
        entering = F.array_position(symbols, F.element_at(chars, i)).cast("int")
        leaving = F.when(i > window, F.array_position(symbols, F.element_at(chars, F.greatest(i - window, F.lit(1))))
                         .cast("int")).otherwise(F.lit(0))
        gained = F.element_at(acc["counts"], entering)
        grown = acc["sum"] + _clog(gained + 1) - _clog(gained)
        lost = (F.element_at(acc["counts"], F.greatest(leaving, F.lit(1)))
                + F.when(entering == leaving, 1).otherwise(0))
        total = F.when(leaving > 0, grown + _clog(lost - 1) - _clog(lost)).otherwise(grown)
        counts = F.transform(acc["counts"], lambda c, k: c + F.when(k + 1 == entering, 1).otherwise(0)
                             - F.when(k + 1 == leaving, 1).otherwise(0))
        size = F.least(i, F.lit(window)).cast("double")
        entropy = F.log2(size) - total / size
        # partial windows count only for the last position of a short value
        whole = (i >= window) | (i == F.size(chars))
        best = F.when(whole, F.greatest(acc["best"], entropy)).otherwise(acc["best"])
        return F.struct(counts.alias("counts"), total.alias("sum"), best.alias("best"))

    zero = F.struct(F.transform(symbols, lambda s: F.lit(0)).alias("counts"), F.lit(0.0).alias("sum"),
                    F.lit(0.0).alias("best"))
    return F.when(F.length(value) > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(value), F.lit(1))), zero, step,
                                                   lambda acc: acc["best"])).otherwise(F.lit(0.0))


def allowed(value: Column) -> Column:
    verdict = F.lit(False)
    for pattern in ALLOW:
        verdict = verdict | value.rlike(pattern)
    return verdict


def word_chars(value: Column) -> Column:
    """Characters of ``value`` inside readable words."""
    words = F.filter(F.regexp_extract_all(value, F.lit(SEGMENT), F.lit(0)), lambda w: w.rlike(VOWEL) & ~w.rlike(ODD_LETTERS))
    return F.aggregate(words, F.lit(0), lambda total, w: total + F.length(w))


def high(value: Column) -> Column:
    """Whether a string mixes letters and digits, is not made of words, and has a window at the limit of its
    character class. Cheap tests come first."""
    limit = (F.when(value.rlike("^[0-9a-f]+$") | value.rlike("^[0-9A-F]+$"), LIMITS["hex"])
             .when(value.rlike("[a-z]") & value.rlike("[A-Z]"), LIMITS["mixed"]).otherwise(LIMITS["lower"]))
    signs = F.length(F.regexp_replace(value, JOINT, ""))
    return (value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (signs >= MIN_PIECE)
            & (word_chars(value) <= MAX_WORDS * signs) & (window_entropy(value) >= limit))


def secret_parts(span: Column) -> Column:
    """Spans of the secrets in a candidate span: all of it, or some of its pieces."""
    value = span["value"]
    tokens = F.regexp_extract_all(value, F.lit(TOKEN), F.lit(0))
    joints = F.size(F.filter(tokens, lambda t: t.rlike("^" + JOINT)))
    signs = F.length(F.regexp_replace(value, JOINT, ""))
    whole = (joints * 6 <= signs) & ~F.exists(tokens, lambda t: t.rlike(ORDINARY_PIECE))

    def step(acc: Column, token: Column) -> Column:
        stop = (acc["at"] + F.length(token)).cast("int")
        part = F.struct(span["rank"].alias("rank"), acc["at"].alias("start"), stop.alias("stop"), token.alias("value"))
        taken = (F.length(token) >= MIN_PIECE) & ~allowed(token) & high(token)
        return F.struct(stop.alias("at"), F.when(taken, F.concat(acc["parts"], F.array(part))).otherwise(acc["parts"]).alias("parts"))

    zero = F.struct(span["start"].cast("int").alias("at"), sp.empty_spans().alias("parts"))
    pieces = F.aggregate(tokens, zero, step, lambda acc: acc["parts"])
    return (F.when(value.rlike(ALLOW[0]), sp.empty_spans())
            .when(whole, F.when(~allowed(value) & high(value), F.array(span)).otherwise(sp.empty_spans()))
            .otherwise(pieces))


def with_secret_spans(docs: DataFrame) -> DataFrame:
    """Add ``base`` and ``added`` span arrays to ``docs(text)``; null texts are empty. An added span
    can overlap base spans, but they never cover all of it."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    assign = F.filter(sp.regex_spans(text, ASSIGN, 0, r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]"),
                      lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 1)) >= MIN_VALUE)
    access = F.filter(sp.regex_spans(text, ACCESS, 1, "AKIA"), lambda s: s["stop"] - s["start"] >= MIN_ACCESS)
    hexes = sp.regex_spans(text, HEX, 2, "[0-9a-f]{32}")
    digit_in_run = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])[A-Za-z0-9+/_=-]{20}"
    found = F.flatten(F.transform(sp.regex_spans(text, CANDIDATE, 3, digit_in_run), secret_parts))
    with_base = docs.withColumn("base", sp.by_start(F.concat(assign, access, hexes))).withColumn("found", found)
    return (with_base.withColumn("added", F.filter("found", lambda s: ~sp.covered(s, F.col("base")))).drop("found"))


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: counts per kind, digest of the base spans, all spans.

    Spans are ``kind:start:stop`` in code points, by start, then kind. Null and empty texts have no
    spans; rows are scanned one by one, so repeated rows get equal results. Other columns are ignored.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = with_secret_spans(slim)
    return found.select(
        "doc_id", *[sp.count_rank(F.col("base"), i).alias(f"n_{k}") for i, k in enumerate(KINDS[:3])],
        sp.digest(sp.written(F.col("base"), KINDS)).alias("base_sha256"),
        sp.written(sp.by_start(F.concat("base", "added")), KINDS).alias("spans"),
        F.size("added").cast("long").alias("n_entropy"))


def redact_secrets(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret replaced by ``mark`` in ``text`` and ``n_chars`` counted anew where
    the text changed. All columns stay, whatever their names; null and empty texts stay as they are."""
    names = docs.columns
    quoted = {c: f"`{c.replace('`', '``')}`" for c in names}
    keep = docs.select(F.struct(*[F.col(quoted[c]) for c in names]).alias("row"), F.col("text"))
    found = with_secret_spans(keep).withColumn("all", F.concat("base", "added"))
    hit = F.size("all") > 0
    clean = sp.redacted(F.col("text"), F.col("all"), mark)
    out = found.withColumn("clean", F.when(hit, clean).otherwise(F.col("text")))
    picked = {"text": F.col("clean"), **({"n_chars": F.when(hit, F.length("clean").cast("long")).otherwise(F.col("row.n_chars"))} if "n_chars" in names else {})}
    return out.select(*[picked.get(c, F.col(f"row.{quoted[c]}")).alias(c) for c in names])
