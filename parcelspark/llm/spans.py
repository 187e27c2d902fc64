"""Spans of regular expressions in whole texts, with code point offsets, by SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SPAN = "array<struct<rank:int,start:int,stop:int,value:string>>"


def empty_spans() -> Column:
    return F.array().cast(SPAN)


def regex_spans(text: Column, pattern: str, rank: int, only_if: str | None = None) -> Column:
    """Leftmost non-overlapping matches of ``pattern`` as (rank, start, stop, value), stop exclusive.

    The matches and the pieces between them come from the same matcher, so their lengths add up to
    the offsets. ``only_if`` is a cheaper pattern that any text with a match contains.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    pairs = F.arrays_zip(found.alias("value"), F.slice(pieces, F.lit(1), F.size(found)).alias("piece"))

    def step(acc: Column, pair: Column) -> Column:
        start = (acc["at"] + F.length(pair["piece"])).cast("int")
        stop = (start + F.length(pair["value"])).cast("int")
        span = F.struct(F.lit(rank).alias("rank"), start.alias("start"), stop.alias("stop"), pair["value"].alias("value"))
        return F.struct(stop.alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))

    zero = F.struct(F.lit(0).cast("int").alias("at"), empty_spans().alias("spans"))
    spans = F.aggregate(pairs, zero, step, lambda acc: acc["spans"])
    return F.when(text.rlike(only_if or pattern), spans).otherwise(empty_spans())


def overlaps(span: Column, others: Column) -> Column:
    return F.exists(others, lambda o: (o["start"] < span["stop"]) & (span["start"] < o["stop"]))


def covered(span: Column, others: Column) -> Column:
    """Whether ``others`` (by start) together cover all of ``span``."""
    reach = F.aggregate(others, span["start"], lambda at, o: F.when(o["start"] <= at, F.greatest(at, o["stop"])).otherwise(at))
    return reach >= span["stop"]


def leftmost(spans: Column) -> Column:
    """Spans in order of start (longer first), without those that overlap an earlier kept one."""
    def step(acc: Column, span: Column) -> Column:
        free = (F.size(acc) == 0) | (F.element_at(acc, -1)["stop"] <= span["start"])
        return F.when(free, F.concat(acc, F.array(span))).otherwise(acc)

    ordered = F.array_sort(spans, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"])
                           .when(a["stop"] != b["stop"], b["stop"] - a["stop"]).otherwise(a["rank"] - b["rank"]))
    return F.aggregate(ordered, empty_spans(), step)


def by_rank(spans: Column) -> Column:
    return F.array_sort(spans, lambda a, b: F.when(a["rank"] != b["rank"], a["rank"] - b["rank"])
                        .when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["stop"] - b["stop"]))


def by_start(spans: Column) -> Column:
    return F.array_sort(spans, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"])
                        .when(a["rank"] != b["rank"], a["rank"] - b["rank"]).otherwise(a["stop"] - b["stop"]))


def written(spans: Column, kinds: list[str]) -> Column:
    """``kind:start:stop`` of every span, joined by commas."""
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def digest(value: Column) -> Column:
    return F.sha2(F.encode(value, "UTF-8"), 256)


def count_rank(spans: Column, rank: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["rank"] == rank)).cast("long")


def redacted(text: Column, spans: Column, mark: str) -> Column:
    """Text with every span replaced by ``mark``; overlapping spans are replaced as one."""
    def merge(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.struct(last["start"].alias("start"), F.greatest(last["stop"], s["stop"]).alias("stop"))
        fresh = F.struct(s["start"].alias("start"), s["stop"].alias("stop"))
        return (F.when(F.size(acc) == 0, F.array(fresh))
                .when(s["start"] < last["stop"], F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(joined)))
                .otherwise(F.concat(acc, F.array(fresh))))

    merged = F.aggregate(by_start(spans), F.array().cast("array<struct<start:int,stop:int>>"), merge)

    def cut(acc: Column, s: Column) -> Column:
        before = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        return F.struct(s["stop"].alias("at"), F.concat(acc["out"], before, F.lit(mark)).alias("out"))

    zero = F.struct(F.lit(0).cast("int").alias("at"), F.lit("").alias("out"))
    done = F.aggregate(merged, zero, cut, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) == 0, text).otherwise(done)
