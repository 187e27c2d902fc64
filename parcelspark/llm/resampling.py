"""Importance resampling of documents towards a target distribution, by Arrow kernels.

Texts are lower-cased, split and flattened by Arrow kernels and dictionary-encoded. Shifted dictionary
indices form word n-grams; only the distinct n-grams of a slice are turned into text and hashed by CRC
into a fixed number of buckets. Bucket counts of the corpus and of the target give each bucket a gain.
A document's weight is the sum of its features' gains (taken by dictionary index, reduced by segment);
Gumbel noise from a hash of its id turns weights into scores, and the highest scores are drawn, which
samples without replacement in proportion to exp(weight / 1000).
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from parcelspark.llm.store import arrow_rows, stored

GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"    # between words, after lower-casing A-Z
MAX_N = 1                                   # features are runs of 1 to MAX_N words
BUCKETS = 10_000
SEED = 2024
MIN_WORDS = 20
PERCENT = 10
SLICE_BYTES = 4 << 20                       # texts are processed in slices of about this size


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """Consecutive parts of a string column with about ``limit`` bytes each (one long text: its own)."""
    if not len(column):
        return
    size = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False) + 1)
    part = (size - 1) // limit
    cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(column)]
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        yield column.slice(lo, hi - lo)


def features(texts: pa.Array, max_n: int, buckets: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Words of each text, and per n-gram length the owner and the bucket of every feature (owners ascend)."""
    # a slice is copied first: cast and lower-cased while it shares its column's buffers, Arrow reads its bytes from the wrong place
    own = texts.take(pa.array(np.arange(len(texts))))
    lists = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(own, "").cast(pa.large_string())), GAPS)
    words, owner = pc.list_flatten(lists), pc.list_parent_indices(lists)
    solid = pc.not_equal(pc.binary_length(words), 0)         # a gap at an end leaves an empty piece
    coded = words.filter(solid).dictionary_encode()
    owner = owner.filter(solid).to_numpy(zero_copy_only=False).astype(np.int64)
    index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    vocabulary = coded.dictionary.cast(pa.large_binary()).to_pylist()
    out = []
    grams, code = vocabulary, index
    for n in range(1, max_n + 1):
        if n > 1:
            # runs of n words: the run of n - 1 words here and the word n - 1 places on, in one text
            inside = owner[:len(code) - 1] == owner[n - 1:] if len(code) > 1 else np.zeros(0, dtype=bool)
            inside &= code[:-1] >= 0 if len(code) > 1 else inside
            pairs = code[:-1] * max(len(vocabulary), 1) + index[n - 1:] if len(code) > 1 else np.zeros(0, dtype=np.int64)
            distinct, place = np.unique(pairs[inside], return_inverse=True)
            grams = [grams[p // len(vocabulary)] + b" " + vocabulary[p % len(vocabulary)] for p in distinct.tolist()]
            code = np.full(len(pairs), -1, dtype=np.int64)
            code[inside] = place
        of_gram = np.fromiter((zlib.crc32(g) % buckets for g in grams), dtype=np.int64, count=len(grams))
        here = code >= 0
        out.append((owner[:len(code)][here], of_gram[code[here]] if len(grams) else np.zeros(0, dtype=np.int64)))
    return np.bincount(owner, minlength=len(texts)), out


def _count(max_n: int, buckets: int) -> Callable:
    """Feature counts per bucket of all a task reads: one row per bucket that occurs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for texts in slices(batch.column("text")):
                for _, bucket in features(texts, max_n, buckets)[1]:
                    total += np.bincount(bucket, minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "n"])
    return run


def bucket_counts(docs: DataFrame, max_n: int = MAX_N, buckets: int = BUCKETS) -> np.ndarray:
    """Feature counts of all ``docs(text)`` per bucket; what comes to the driver has ``buckets`` rows at most."""
    counted = (docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_count(max_n, buckets), "bucket long, n long")
               .groupBy("bucket").agg(F.sum("n").alias("n")))
    total = np.zeros(buckets, dtype=np.int64)
    for row in counted.collect():
        total[row["bucket"]] = row["n"]
    return total


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the smoothed ratio of target share to corpus share) of every bucket."""
    n = len(corpus)
    s_all, t_all = float(corpus.sum()) + n, float(target.sum()) + n
    return np.array([math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all)))
                     for s, t in zip(corpus.tolist(), target.tolist())], dtype=np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """Gumbel noise of a document, in thousandths, from a hash of its id (a null id reads as empty)."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return math.floor(-1000 * math.log(-math.log((int(digest[:8], 16) + 0.5) / 4294967296)))


def _score(gain: np.ndarray, max_n: int, seed: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in slices(batch.column("text")):
                ids = batch.column("doc_id").slice(at, len(texts))
                at += len(texts)
                n_words, grams = features(texts, max_n, len(gain))
                n_features, weight = np.zeros((2, len(texts)), dtype=np.int64)
                for owner, bucket in grams:
                    if len(owner):
                        first = np.flatnonzero(np.diff(owner, prepend=-1))
                        weight[owner[first]] += np.add.reduceat(gain.take(bucket), first)
                        n_features += np.bincount(owner, minlength=len(texts))
                score = weight + np.fromiter((noise(i, seed) for i in ids.to_pylist()), dtype=np.int64, count=len(ids))
                yield pa.RecordBatch.from_arrays(
                    [ids, *[pa.array(x.astype(np.int64)) for x in (n_words, n_features, weight, score)]],
                    names=["doc_id", "n_words", "n_features", "weight", "score"])
    return run


def resample(docs: DataFrame, target: DataFrame, max_n: int = MAX_N, buckets: int = BUCKETS, seed: int = SEED,
             min_words: int = MIN_WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: ``doc_id, n_features, weight, score, rank``.

    ``target(text)`` holds the texts whose feature distribution is wanted. Of the N documents with
    ``min_words`` words or more, the floor(percent * N / 100) highest scores are drawn and ranked from 1;
    ties go to the smaller doc_id, rows without an id last. Null, empty and wordless texts have no
    features and weight 0. Repeated rows are drawn one by one. An empty ``docs`` gives an empty result;
    an empty target has no counts. Other columns are ignored.
    """
    arrow_rows(docs.sparkSession)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    gain = gains(bucket_counts(slim, max_n, buckets), bucket_counts(target, max_n, buckets))
    scored = stored(slim.mapInArrow(_score(gain, max_n, seed), "doc_id long, n_words long, n_features long, weight long, score long"),
                    "scored")
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    # ranges of the order are written once, so that their numbers stay the same for every later read
    ranged = stored(scored.where(F.col("n_words") >= min_words).repartitionByRange(*order)
                    .withColumn("place", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy("place").agg(F.count("*").alias("n"))
    before = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    offsets = counts.select("place", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"),
                            F.floor(F.sum("n").over(every) * percent / 100).cast("long").alias("drawn"))
    placed = ranged.join(offsets, "place")
    inside = Window.partitionBy("place").orderBy(*order, "n_features", "weight")
    number = (F.row_number().over(inside) + F.col("offset")).cast("long")
    near_top = placed.where(F.col("offset") < F.col("drawn")).withColumn("number", number)
    out = ["doc_id", "n_features", "weight", "score"]
    unranked = F.lit(None).cast("long").alias("rank")
    return (near_top.select(*out, F.when(F.col("number") <= F.col("drawn"), F.col("number")).alias("rank"))
            .unionAll(placed.where(F.col("offset") >= F.col("drawn")).select(*out, unranked))
            .unionAll(scored.where(F.col("n_words") < min_words).select(*out, unranked)))
