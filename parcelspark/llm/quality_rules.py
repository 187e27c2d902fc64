"""Quality rules by repetition coverage.

Rolling hashes of several n-gram lengths mark the words that lie inside an n-gram occurring twice or
more in the same text; the share of the text's word characters they cover, and the share of
characters in repeated lines, are compared with a limit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from parcelspark.llm import textkit as tk
from parcelspark.llm.docstats import COVERAGE_NGRAMS, statistics
from parcelspark.llm.store import arrow_rows

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
# Largest shares of word characters inside duplicated n-grams, by n, and of characters inside repeated lines.
# A longer duplicated n-gram is stronger evidence, so its limit is lower; each length can decide alone.
MAX_SHARE = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
MAX_LINE_SHARE = 0.20
# Characters that may be duplicated in any text: one sentence said twice must not condemn a short text.
# In a text of n characters the rule is duplicated <= share * n + GRACE, so in long texts the shares decide.
GRACE_CHARS = 160

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SHARES = [f"dup_{n}gram_share" for n in COVERAGE_NGRAMS] + ["dup_line_share"]


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = tk.arrow_bytes(batch.column("text"))
        for lo, hi in tk.byte_batches(texts):
            s = statistics(texts[lo:hi])
            per_word = np.maximum(s["word_chars"], 1)
            shares = [s[f"dup_{n}gram_chars"] / per_word for n in COVERAGE_NGRAMS]
            shares.append(s["dup_line_chars"] / np.maximum(s["n_chars"], 1))
            failed = s["dup_line_chars"] - GRACE_CHARS > MAX_LINE_SHARE * s["n_chars"]
            for n, most in MAX_SHARE.items():
                failed |= s[f"dup_{n}gram_chars"] - GRACE_CHARS > most * s["word_chars"]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(lo, hi - lo)] + [pa.array(s[c].astype(np.int64)) for c in COUNTS]
                + [pa.array(x) for x in [*shares, failed]], names=["doc_id", *COUNTS, *SHARES, "coverage_failed"])


def quality_rules(docs: DataFrame) -> DataFrame:
    """Counts, coverage shares and verdict of every row of ``docs(doc_id, text)``.

    ``base_failed``: fewer than 50 words, or more than half of the words inside repeated 3-word
    windows. ``coverage_failed``: the duplicated characters of some n-gram length, or of lines, exceed their
    share of the text by more than ``GRACE_CHARS``. ``kept``: neither. Symbols are counted, but decide nothing.
    Null and empty texts have zero counts and fail the base rules. Rows are judged one by one,
    so repeated rows get equal results; other columns are ignored.
    """
    arrow_rows(docs.sparkSession)
    schema = ", ".join(["doc_id long", *[f"{c} long" for c in COUNTS], *[f"{c} double" for c in SHARES], "coverage_failed boolean"])
    out = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
           .mapInArrow(_measure, schema))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~(F.col("base_failed") | F.col("coverage_failed")))
