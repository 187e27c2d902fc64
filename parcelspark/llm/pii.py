"""Personal data by weak supervision, with SQL functions only.

Candidate spans come from strict patterns (the base kinds) and looser ones. Labelers vote on every
candidate: its pattern, a gazetteer, the words before it, its arithmetic, and its neighbours. The
votes of all documents are counted per vote pattern on Spark; expectation-maximisation over that
bounded table estimates how reliable each labeler is, and a logistic span classifier is trained on
the resulting soft labels. Base spans always stay; other candidates are added where the classifier
accepts them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from parcelspark.llm import spans as sp
from parcelspark.llm.store import stored

KINDS = ["email", "ip", "card", "phone", "ssn", "iban"]
BASE_KINDS = 4

# strict patterns; the look-behinds only skip starts inside a run that was already tried
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# looser patterns of the method
LOOSE = {
    0: r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[(\[]at[)\]] ?[A-Za-z0-9-]{1,63}(?: ?(?:[(\[]dot[)\]]|\.) ?[A-Za-z0-9-]{2,63}){1,4}",
    3: r"(?<![0-9A-Za-z+(.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])",
    4: r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    5: r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
}
LOOSE_IF = {0: r"[(\[]at[)\]]", 3: "[0-9]{3}[ .-][0-9]{4}", 4: "[0-9]{3}-[0-9]{2}-[0-9]{4}", 5: "[A-Z]{2}[0-9]{2}"}

# gazetteers and context words (fixed values)
MAIL_ENDINGS = ["com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk", "it", "eu", "info"]
CALLING_CODES = ["1", "7", "20", "27", "30", "31", "32", "33", "34", "39", "41", "43", "44", "45", "46", "47", "48", "49",
                 "52", "55", "61", "81", "82", "86", "90", "91"]
IBAN_COUNTRIES = ["AT", "BE", "CH", "DE", "DK", "ES", "FI", "FR", "GB", "IE", "IT", "LU", "NL", "NO", "PL", "PT", "SE"]
CONTEXT = {
    0: "mail|contact|write|reach|courriel|correo|kontakt",
    1: r"\bip\b|address|host|server|login|adresse",
    2: "card|visa|master|amex|credit|payment|karte|carte|tarjeta",
    3: r"phone|\btel|call|mobile|cell|fax|contact|telefon|appel|llama",
    4: r"\bssn\b|social|security",
    5: r"\biban\b|account|bank|konto|compte|cuenta",
}
NOT_CONTEXT = r"version|\bv\.?$|\bver\.?$|release|isbn|issn|order|section|page|figure|table|id\b|#$"
LABELERS = ["pattern", "gazetteer", "context", "arithmetic", "neighbours"]
NEAR = 24
ACCEPT = 0.5


def luhn(digits: Column) -> Column:
    """Luhn check of a digit string."""
    n = F.length(digits)
    total = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), lambda acc, i: acc + (
        lambda d: F.when(F.pmod(i, F.lit(2)) == 0, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d))(
        F.coalesce(F.try_to_number(F.substring(digits, n - i + 1, F.lit(1)), F.lit("9")).cast("int"), F.lit(0))))
    return (n > 0) & (F.pmod(total, F.lit(10)) == 0)


def small_octets(value: Column) -> Column:
    """Whether every dotted part is at most 255 (leading zeros allowed, any length)."""
    return F.forall(F.split(value, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3)
                    & (F.lpad(F.ltrim(p, F.lit("0")), 3, "0") <= "255"))


def only_digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def with_base(text: Column) -> Column:
    """Base spans of a non-null text, by kind, then start."""
    emails = sp.regex_spans(text, EMAIL, 0, "@")
    ips = F.filter(sp.regex_spans(text, IP, 1, r"[0-9]\.[0-9]"), lambda s: small_octets(s["value"]))
    cards = F.filter(sp.regex_spans(text, CARD, 2, r"[0-9](?:[\x20-]?[0-9]){12}"),
                     lambda s: F.length(only_digits(s["value"])).between(13, 19) & luhn(only_digits(s["value"])))
    phones = F.filter(sp.regex_spans(text, PHONE, 3, r"\+[0-9]"),
                      lambda s: F.length(only_digits(s["value"])).between(9, 15))
    return sp.by_rank(F.concat(emails, ips, cards, phones))


def candidates(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``base`` and ``cands``: every candidate with its votes and shape."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    found = slim.withColumn("base", with_base(F.col("text")))
    loose = F.concat(*[sp.regex_spans(F.col("text"), p, rank, LOOSE_IF[rank]) for rank, p in LOOSE.items()])
    found = found.withColumn("loose", sp.leftmost(F.filter(loose, lambda s: ~sp.overlaps(s, F.col("base")))))

    def voted(strict: bool):
        def of(s: Column) -> Column:
            before = F.lower(F.substring(F.col("text"), F.greatest(s["start"] - NEAR + 1, F.lit(1)),
                                         F.least(s["start"], F.lit(NEAR))))
            left = F.when(s["start"] > 0, F.substring(F.col("text"), s["start"], F.lit(1))).otherwise(F.lit(""))
            right = F.substring(F.col("text"), s["stop"] + 1, F.lit(1))
            digits = only_digits(s["value"])
            return F.struct(
                s["rank"].alias("rank"), s["start"].alias("start"), s["stop"].alias("stop"),
                F.lit(strict).alias("strict"),
                F.lit(1 if strict else -1).alias("pattern"),
                _gazetteer(s, digits).alias("gazetteer"),
                _context(s, before).alias("context"),
                _arithmetic(s, digits).alias("arithmetic"),
                F.when(left.rlike(r"[\pL\pN_]") | right.rlike(r"[\pL\pN_@]"), -1).otherwise(1).alias("neighbours"),
                F.least(F.floor((s["stop"] - s["start"]) / 8), F.lit(3)).cast("int").alias("length"))
        return of

    both = F.concat(F.transform("base", voted(True)), F.transform("loose", voted(False)))
    return found.select("doc_id", F.transform("base", lambda s: s.dropFields("value")).alias("base"), both.alias("cands"))


def _gazetteer(s: Column, digits: Column) -> Column:
    ending = F.lower(F.regexp_extract(s["value"], r"([A-Za-z]+)$", 1))
    code = digits.rlike("^(?:" + "|".join(CALLING_CODES) + ")")
    return (F.when(s["rank"] == 0, F.when(ending.isin(MAIL_ENDINGS), 1).otherwise(-1))
            .when(s["rank"] == 1, F.when(s["value"].rlike(r"^(?:0+|127|255)\."), -1).otherwise(1))
            .when(s["rank"] == 2, F.when(digits.rlike("^[3-6]"), 1).otherwise(-1))
            .when(s["rank"] == 3, F.when(s["value"].startswith("+"), F.when(code, 1).otherwise(-1)).otherwise(0))
            .when(s["rank"] == 4, F.when(digits.rlike("^(?:000|666|9)"), -1).otherwise(1))
            .otherwise(F.when(F.substring(s["value"], 1, 2).isin(IBAN_COUNTRIES), 1).otherwise(-1)))


def _context(s: Column, before: Column) -> Column:
    hit = F.lit(False)
    for rank, words in CONTEXT.items():
        hit = hit | ((s["rank"] == rank) & before.rlike(words))
    return F.when(hit, 1).when(before.rlike(NOT_CONTEXT), -1).otherwise(0)


def _arithmetic(s: Column, digits: Column) -> Column:
    return (F.when(s["rank"] == 0, 0)
            .when(s["rank"] == 1, F.when(small_octets(s["value"]), 1).otherwise(-1))
            .when(s["rank"] == 2, F.when(luhn(digits), 1).otherwise(-1))
            .when(s["rank"] == 3, F.when(F.length(digits).between(9, 15) & ~digits.rlike(r"^(\d)\1+$")
                                         & (s["value"].startswith("+") | digits.rlike("^[2-9]..[2-9]")), 1).otherwise(-1))
            .when(s["rank"] == 4, F.when(~digits.rlike("0000$") & ~digits.rlike("^...00"), 1).otherwise(-1))
            .otherwise(F.when(F.length(F.replace(s["value"], F.lit(" "))).between(15, 34), 1).otherwise(-1)))


Reliabilities = dict[str, dict[int, tuple[float, float]]]


def estimate(patterns: list[tuple], rounds: int = 40, start: list[float] | None = None,
             known: Reliabilities | None = None, strength: float = 10.0) -> tuple[list[float], Reliabilities]:
    """Dawid-Skene with a binary truth over counted vote patterns ``(rank, votes, count)``.

    Returns the posterior of every pattern and, per labeler and vote, P(vote | personal) and
    P(vote | not). Starts from the posteriors ``start``, or from the share of positive votes. Counts are
    smoothed by one, and by ``strength`` imagined votes of each truth as in ``known``.
    """
    post = start or [(sum(v > 0 for v in votes) + 0.5) / (sum(v != 0 for v in votes) + 1.0) for _, votes, _ in patterns]
    tables: Reliabilities = {}
    for _ in range(rounds):
        total = [1.0, 1.0]
        for p, (_, _, n) in zip(post, patterns):
            total[0] += p * n
            total[1] += (1 - p) * n
        prior = total[0] / sum(total)
        for k, name in enumerate(LABELERS):
            seen = {v: [1.0 + strength * known[name][v][c] if known else 1.0 for c in (0, 1)] for v in (-1, 0, 1)}
            for p, (_, votes, n) in zip(post, patterns):
                seen[votes[k]][0] += p * n
                seen[votes[k]][1] += (1 - p) * n
            sums = [sum(s[c] for s in seen.values()) for c in (0, 1)]
            tables[name] = {v: (s[0] / sums[0], s[1] / sums[1]) for v, s in seen.items()}
        fresh = []
        for _, votes, _ in patterns:
            odds = math.log(prior / (1 - prior))
            for name, v in zip(LABELERS, votes):
                yes, no = tables[name][v]
                odds += math.log(yes / no) if v else 0.0
            fresh.append(1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))))
        post = fresh
    return post, tables


def reliabilities(patterns: list[tuple]) -> tuple[list[float], dict[int, Reliabilities]]:
    """Posterior of every pattern ``(rank, votes, count)``, and each kind's own reliabilities of the labelers: a
    context word can be telling for one kind and say little for another. A kind starts from what the labelers
    do over all kinds, which also steadies it where it has few candidates."""
    pooled, known = estimate(patterns)
    posts, tables = [0.0] * len(patterns), {}
    for kind in sorted({rank for rank, _, _ in patterns}):
        own = [i for i, (rank, _, _) in enumerate(patterns) if rank == kind]
        fresh, tables[kind] = estimate([patterns[i] for i in own], start=[pooled[i] for i in own], known=known)
        for i, p in zip(own, fresh):
            posts[i] = p
    return posts, tables


def fit_classifier(rows: list[tuple[list[str], float, float]], steps: int = 400, rate: float = 0.5,
                   decay: float = 1e-3) -> dict[str, float]:
    """Logistic regression on one-hot features ``(names, soft label, weight)`` by full gradient steps.

    Weights are scaled to a total of one; the result maps feature names (and ``bias``) to weights.
    """
    weights: dict[str, float] = {"bias": 0.0}
    total = sum(w for _, _, w in rows) or 1.0
    for _ in range(steps):
        slope: dict[str, float] = {}
        for names, label, n in rows:
            z = weights["bias"] + sum(weights.get(f, 0.0) for f in names)
            gap = (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - label) * n / total
            for f in ["bias", *names]:
                slope[f] = slope.get(f, 0.0) + gap
        for f, g in slope.items():
            weights[f] = weights.get(f, 0.0) - rate * (g + (decay * weights.get(f, 0.0) if f != "bias" else 0.0))
    return weights


def _names(rank: int, votes: tuple[int, ...], length: int) -> list[str]:
    return [f"kind={rank}", f"length={length}", *[f"{name}={v}" for name, v in zip(LABELERS, votes)]]


def train(cands: DataFrame) -> dict[str, float]:
    """Span classifier weights from the vote patterns of ``cands`` (as ``candidates`` returns).

    What comes to the driver is the table of distinct patterns: at most kinds * 3^labelers * 4
    lengths rows, whatever the corpus.
    """
    counted = (cands.select(F.explode("cands").alias("c")).groupBy("c.rank", *[f"c.{v}" for v in LABELERS], "c.length")
               .agg(F.count("*").alias("n")).collect())
    rows = sorted((r["rank"], tuple(r[v] for v in LABELERS), r["length"], r["n"]) for r in counted)
    posts, _ = reliabilities([(rank, votes, n) for rank, votes, _, n in rows])
    return fit_classifier([(_names(rank, votes, length), p, float(n)) for (rank, votes, length, n), p in zip(rows, posts)])


def probability(c: Column, weights: dict[str, float]) -> Column:
    """Classifier probability of one candidate."""
    z = F.lit(weights.get("bias", 0.0))
    fields = {"kind": "rank", "length": "length", **{v: v for v in LABELERS}}
    for name, value in weights.items():
        if "=" in name:
            field, level = name.split("=")
            z = z + F.when(c[fields[field]] == int(level), F.lit(value)).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-z))


def find(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: counts and digest of the base spans, all spans.

    Spans are ``kind:start:stop`` in code points, by kind, then start. Null and empty texts have no
    spans. Repeated rows are scanned one by one and get equal results; without any candidate the
    classifier is neutral and adds nothing. Other columns are ignored.
    """
    found = stored(candidates(docs), "candidates")
    weights = train(found)
    extra = F.transform(F.filter("cands", lambda c: ~c["strict"] & (probability(c, weights) >= ACCEPT)),
                        lambda c: F.struct(c["rank"].alias("rank"), c["start"].alias("start"), c["stop"].alias("stop")))
    counts = [sp.count_rank(F.col("base"), i).alias(f"n_{k}") for i, k in enumerate(KINDS[:BASE_KINDS])]
    return found.withColumn("extra", extra).select(
        "doc_id", *counts, sp.digest(sp.written(F.col("base"), KINDS)).alias("base_sha256"),
        sp.written(sp.by_rank(F.concat("base", "extra")), KINDS).alias("spans"), F.size("extra").cast("long").alias("n_added"))
