"""Toxicity by noisy-channel deobfuscation and a learned word model.

1. A character trigram model is counted over all documents.
2. Spellings that look disguised (leetspeak, spaced-out letters, stretched letters) become character
   lattices; Viterbi finds the letters with the least channel plus language-model cost. Spaced-out
   letters are then split into words by the word counts of all documents.
3. The restored text is scored by a logistic model over words and word beginnings. Its features are
   counted over, and its weights fitted on, all labelled rows outside the held-out fold.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import DataFrame, functions as F

from parcelspark.llm import textkit as tk
from parcelspark.llm.quality_model import held_out
from parcelspark.llm.store import arrow_rows, stored

SYMBOLS = 28                                  # 0: boundary, 1-26: a-z, 27: any other letter byte
BUCKETS = 22                                  # bits of a feature number
MIN_DOCS, MIN_Z, MAX_FEATURES = 8, 4.0, 4_000
PREFIXES = (4, 5, 6)
STEPS, DECAY = 100, 1e-4
ID_BITS = 26                                  # bits of the bitmap of labelled ids: 8 MB
HELD_KEYS = 100_000                           # distinct keys a task counts before it passes them on

# what a written character may stand for (fixed values)
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a",
        "$": "s", "!": "i", "|": "il", "+": "t", "*": "aeiou"}
SWAP_COST, GAP_COST, REPEAT_COST = 1.0, 2.0, 0.3
DOUBLE_COST = 11.0                            # a letter written twice is usually meant twice
KEEP_COST = {c: 0.5 if c in "!*|+" else 12.0 if c in "@$" else 6.0 for c in LEET}   # a written sign that means itself and ends a word
INNER_COST = 10.0                             # more for a digit that does so between letters
LONGEST = 40                                  # letters of a counted word, at most (as in WORD)
NEW_WORD_COST = 6.0                           # a word of such a run that is not among the counted ones
MAX_WORDS, MIN_WORD_DOCS = 20_000, 2
# a run left as written: rare, and any letter or digit is as likely
KEY_START, KEY_COST = 15.0, math.log(36)

_LETTER = np.zeros(256, dtype=bool)
_LETTER[97:123] = _LETTER[65:91] = True
_LETTER[128:] = True
_CODE = np.zeros(256, dtype=np.int64)
_CODE[97:123] = _CODE[65:91] = np.arange(1, 27)
_CODE[128:] = 27
_LEET_BYTE = np.zeros(256, dtype=bool)
_LEET_BYTE[[ord(c) for c in LEET]] = True
_GAP = np.zeros(256, dtype=bool)
_GAP[[ord(c) for c in " .-_*"]] = True

SWAPPED = re.compile(r"(?<![A-Za-z0-9@$!|*+])(?=[0-9@$!|*+]*[A-Za-z])(?=[A-Za-z]*[0-9@$!|*+])[A-Za-z0-9@$!|*+]+")
SPACED = re.compile(r"(?<![A-Za-z0-9@$!])[A-Za-z0-9@$!](?:[ .\-_*][A-Za-z0-9@$!]){2,}(?![A-Za-z0-9@$!])")
STRETCHED = re.compile(r"(?<![A-Za-z])(?=[A-Za-z]*?([A-Za-z])\1\1)[A-Za-z]+")
WORD = re.compile(rb"(?<![a-z\x80-\xff])[a-z]{1,40}(?![a-z\x80-\xff])")
LONG_REPEAT = re.compile(r"(.)\1{3,}", re.DOTALL)


# ---- character language model ----

def _trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SYMBOLS ** 3, dtype=np.int64)
    for batch in batches:
        texts = tk.arrow_bytes(batch.column("text"))
        for lo, hi in tk.byte_batches(texts):
            code = _CODE[np.frombuffer(b" " + b" ".join(texts[lo:hi]) + b" ", dtype=np.uint8)]
            if len(code) > 2:
                total += np.bincount(code[:-2] * SYMBOLS ** 2 + code[1:-1] * SYMBOLS + code[2:], minlength=len(total))
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["gram", "n"])


def character_counts(docs: DataFrame) -> np.ndarray:
    """Trigram counts over all texts; what comes to the driver is bounded by the alphabet."""
    arrow_rows(docs.sparkSession)
    rows = (docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_trigrams, "gram long, n long")
            .groupBy("gram").agg(F.sum("n").alias("n")).collect())
    counts = np.zeros(SYMBOLS ** 3, dtype=np.int64)
    for r in rows:
        counts[r["gram"]] = r["n"]
    return counts


def character_costs(counts: np.ndarray, strength: float = 5.0) -> np.ndarray:
    """-log P(c | a, b) with back-off: trigram, bigram, unigram, uniform (each a Dirichlet prior)."""
    tri = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(np.float64)
    bi, uni = tri.sum(axis=0), tri.sum(axis=(0, 1))
    p1 = (uni + 1) / (uni.sum() + SYMBOLS)
    p2 = (bi + strength * p1) / (bi.sum(axis=1, keepdims=True) + strength)
    p3 = (tri + strength * p2[None]) / (tri.sum(axis=2, keepdims=True) + strength)
    return -np.log(p3)


# ---- deobfuscation ----

class Decoder:
    """Viterbi decoding of disguised spellings; results are remembered per process."""

    def __init__(self, costs: np.ndarray, words: dict[str, float] | None = None):
        self.costs = costs.tolist()
        self.words = words or {}
        self.known: dict[tuple[str, bool], str | None] = {}

    def restore(self, written: str, key: bool = False) -> str:
        """Letters meant by ``written``. With ``key`` the run stays as written if that costs less."""
        short = LONG_REPEAT.sub(r"\1\1\1", written.lower())
        if (short, key) not in self.known:
            if len(self.known) > 50_000:
                self.known.clear()
            self.known[short, key] = self._decode(short, key)
        out = self.known[short, key]
        return written if out is None else out

    def _decode(self, written: str, key: bool) -> str | None:
        costs = self.costs
        start = 0.0 if written.strip("!*|+").isalpha() else KEY_START       # a word beside punctuation is no key
        as_key = start + len(written) * KEY_COST
        letters = [i for i, c in enumerate(written) if "a" <= c <= "z"]
        inner = range(letters[0], letters[-1]) if letters else range(0)
        # state: last two emitted symbols and the last observed letter -> (cost, path of emitted text)
        states: dict[tuple[int, int, str], tuple[float, tuple | None]] = {(0, 0, ""): (0.0, None)}
        for i, char in enumerate(written):
            fresh: dict[tuple[int, int, str], tuple[float, tuple | None]] = {}
            if "a" <= char <= "z":
                options = [(char, 0.0)]
            else:
                options = [(c, SWAP_COST) for c in LEET.get(char, "")]
            drop = REPEAT_COST if char * 3 in written[max(0, i - 2):i + 3] else DOUBLE_COST
            keep = KEEP_COST.get(char, 0.0) + (INNER_COST if char.isdigit() and i in inner else 0.0)
            for (a, b, seen), (cost, path) in states.items():
                for letter, extra in options:
                    if letter == seen:                       # a repeated letter may be dropped
                        self._keep(fresh, (a, b, seen), cost + extra + drop, path)
                    c = ord(letter) - 96
                    self._keep(fresh, (b, c, letter), cost + extra + costs[a][b][c], (path, letter))
                if char in " .-_*!|":
                    self._keep(fresh, (a, b, seen), cost + (GAP_COST if char in "*!|" else 0.1), path)
                elif not options:
                    self._keep(fresh, (a, b, seen), cost + GAP_COST, path)
                if char in KEEP_COST:                        # the sign means itself and bounds a word
                    bound = costs[a][b][0] if b else 0.0     # signs side by side are one bound
                    self._keep(fresh, (b or a, 0, ""), cost + keep + bound, (path, char))
            states = fresh
            if key and min(cost for cost, _ in states.values()) >= as_key:
                return None                                  # costs never fall, so no reading can be cheaper
        cost, path = min(((cost + (costs[a][b][0] if b else 0.0), path) for (a, b, _), (cost, path) in states.items()),
                         key=lambda end: end[0])
        if key and cost >= as_key:
            return None
        out = []
        while path is not None:
            path, char = path
            out.append(char)
        return "".join(reversed(out))

    def spaced(self, written: str) -> str:
        """Words of spaced-out letters: the split of least word and character cost. A gap can bound a
        word, so a run that reads best as single letters stays as written."""
        glued = self.restore(written)
        split = re.sub("[a-z]+", lambda m: " ".join(self._split(m[0])), glued)
        return split if re.search("[a-z]{2}", split) else written

    def _split(self, letters: str) -> list[str]:
        """Words of least cost: counted words, or unknown ones of any length, spelled by the character model."""
        costs, n = self.costs, len(letters)
        codes = [ord(c) - 96 for c in letters]
        far = (math.inf, 0)
        best = [(0.0, 0)] + [far] * n                    # least cost of the first letters, start of the last word
        one, two, more = [far] * (n + 1), [far] * (n + 1), [far] * (n + 1)     # inside an unknown word, by its letters so far
        for j in range(1, n + 1):
            a, b, c = codes[j - 3] if j > 2 else 0, codes[j - 2] if j > 1 else 0, codes[j - 1]
            one[j] = (best[j - 1][0] + NEW_WORD_COST + costs[0][0][c], j - 1)
            if j > 1:
                two[j] = (one[j - 1][0] + costs[0][b][c], j - 2)
            if j > 2:
                cost, first = min(two[j - 1], more[j - 1])
                more[j] = (cost + costs[a][b][c], first)
            ends = [(one[j][0] + costs[0][c][0], j - 1)]
            ends += [(cost + costs[b][c][0], first) for cost, first in (two[j], more[j])] if j > 1 else []
            ends += [(best[i][0] + self.words.get(letters[i:j], math.inf), i) for i in range(max(0, j - LONGEST), j)]
            best[j] = min(ends)
        out, end = [], n
        while end:
            out.append(letters[best[end][1]:end])
            end = best[end][1]
        return out[::-1]

    @staticmethod
    def _keep(fresh: dict, state: tuple, cost: float, path: tuple | None) -> None:
        old = fresh.get(state)
        if old is None or cost < old[0]:
            fresh[state] = (cost, path)

    def text(self, text: str) -> str:
        """Text with every disguised spelling replaced by its restored letters."""
        text = SPACED.sub(lambda m: self.spaced(m[0]) if any(c.isalpha() for c in m[0]) else m[0], text)
        text = SWAPPED.sub(lambda m: self.restore(m[0], key=True), text)
        return STRETCHED.sub(lambda m: self.restore(m[0]), text)


def disguised(texts: list[bytes]) -> np.ndarray:
    """Mask of the texts that may hold a disguised spelling (a superset, found on the byte buffer)."""
    ends = np.cumsum([len(t) + 1 for t in texts])
    buf = np.frombuffer(b"\n".join(texts) + b"\n" + b"\n" * 8, dtype=np.uint8)
    letter, n = _LETTER[buf], ends[-1]
    leet = _LEET_BYTE[buf]
    sign = letter | leet
    hit = (leet[:n] & letter[1:n + 1]) | (letter[:n] & leet[1:n + 1])
    hit |= letter[:n] & (buf[:n] == buf[1:n + 1]) & (buf[:n] == buf[2:n + 2])
    gap = _GAP[buf]
    hit |= sign[:n] & gap[1:n + 1] & sign[2:n + 2] & gap[3:n + 3] & sign[4:n + 4]
    # a stretched capital: letters that differ in case only
    low = buf | 32
    hit |= letter[:n] & (low[:n] == low[1:n + 1]) & (low[:n] == low[2:n + 2])
    out = np.zeros(len(texts), dtype=bool)
    out[np.searchsorted(ends, np.flatnonzero(hit), side="right")] = True
    return out


def restored(texts: list[bytes], decoder: Decoder) -> list[bytes]:
    if not texts:
        return texts
    out = list(texts)
    for i in np.flatnonzero(disguised(texts)):
        out[i] = decoder.text(texts[i].decode("utf-8", "replace")).encode("utf-8")
    return out


# ---- word model ----

def feature_numbers(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text index, feature number) of all words and word beginnings, with repeats."""
    t = tk.tokenize(texts, ~_LETTER)
    hashed = tk.RangeHash(t.buf, folded=True)
    doc, length = t.word_doc(), t.end - t.start
    docs, numbers = [doc], [_number(hashed(t.start, t.end), 0)]
    for size in PREFIXES:
        longer = np.flatnonzero(length > size)
        docs.append(doc[longer])
        numbers.append(_number(hashed(t.start[longer], t.start[longer] + size), size))
    return np.concatenate(docs), np.concatenate(numbers)


def _number(hashes: np.ndarray, kind: int) -> np.ndarray:
    return (tk.mix64(hashes + tk.U64(1 + kind)) >> tk.U64(64 - BUCKETS)).astype(np.int64)


@dataclass
class Model:
    """Character and word costs and the word weights of the scorer."""

    costs: np.ndarray
    words: dict[str, float]
    features: np.ndarray
    weights: np.ndarray
    bias: float

    def scorer(self) -> Callable[[list[bytes]], np.ndarray]:
        decoder = Decoder(self.costs, self.words)
        table = np.zeros(1 << BUCKETS, dtype=np.float32)
        table[self.features] = self.weights

        def run(texts: list[bytes]) -> np.ndarray:
            doc, number = feature_numbers(restored(texts, decoder))
            hit = table[number] != 0
            pairs = np.unique(doc[hit] << BUCKETS | number[hit])
            margin = self.bias + np.bincount(pairs >> BUCKETS, weights=table[pairs & ((1 << BUCKETS) - 1)],
                                             minlength=len(texts))
            return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))

        return run


def _feature_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((2, 1 << BUCKETS), dtype=np.int32)
    for batch in batches:
        for label, x in zip(batch.column("label").to_pylist(), batch.column("x").to_pylist()):
            counts[label][np.frombuffer(x, dtype=np.int32)] += 1       # a row holds each feature once
    seen = np.flatnonzero(counts.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[1][seen].astype(np.int64)), pa.array(counts[0][seen].astype(np.int64))],
                                     names=["feature", "pos", "neg"])


def marking_features(rows: DataFrame, n_pos: int, n_neg: int) -> np.ndarray:
    """Features that mark label 1, counted over all ``rows(label, x)``: those of ``MIN_DOCS`` positive rows
    and a two-proportion z of ``MIN_Z``. The strongest ``MAX_FEATURES`` bound the model."""
    pos, neg = F.col("pos"), F.col("neg")
    both = (pos + neg) / (n_pos + n_neg)
    z = (pos / n_pos - neg / n_neg) / F.sqrt(both * (1 - both) * (1 / n_pos + 1 / n_neg) + 1e-12)
    strong = (rows.mapInArrow(_feature_counts, "feature long, pos long, neg long").groupBy("feature")
              .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
              .where(pos >= min(MIN_DOCS, max(2, n_pos / 20))).withColumn("z", z).where(F.col("z") >= MIN_Z)
              .orderBy(F.desc("z"), "feature").limit(MAX_FEATURES).collect())
    return np.sort(np.array([r["feature"] for r in strong], dtype=np.int64))


def _patterns(chosen: np.ndarray) -> Callable:
    """How often each label meets each set of chosen features (their places, ascending)."""
    def table(total: Counter[tuple[int, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([label for label, _ in total], pa.int32()), pa.array([held for _, held in total], pa.binary()),
                                           pa.array(total.values(), pa.int64())], names=["label", "held", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full(1 << BUCKETS, -1, dtype=np.int32)
        place[chosen] = np.arange(len(chosen))
        total: Counter[tuple[int, bytes]] = Counter()
        for batch in batches:
            for label, x in zip(batch.column("label").to_pylist(), batch.column("x").to_pylist()):
                held = place[np.frombuffer(x, dtype=np.int32)]
                total[label, held[held >= 0].tobytes()] += 1
            if len(total) > HELD_KEYS:
                yield table(total)
                total.clear()
        yield table(total)

    return run


def fit_words(rows: DataFrame, sizes: dict[int, int]) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights of the words that mark label 1, fitted on all ``rows(label, x)``. Rows with equal label and
    chosen features are one row of their number, so what Spark's logistic regression reads is small."""
    n = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n_pos, n_neg = n.get(1, 0), n.get(0, 0)
    share = (sizes.get(1, 0) + 1) / (sizes.get(0, 0) + sizes.get(1, 0) + 2)
    chosen = marking_features(rows, n_pos, n_neg) if n_pos and n_neg else np.empty(0, dtype=np.int64)
    size = len(chosen)
    if not size:
        return chosen, np.zeros(0), math.log(share / (1 - share))
    held = stored(rows.mapInArrow(_patterns(chosen), "label int, held binary, n long").groupBy("label", "held")
                  .agg(F.sum("n").cast("double").alias("n")), "toxic-patterns")

    @F.udf(VectorUDT())
    def vector(places):
        at = np.frombuffer(places, dtype=np.int32)
        return Vectors.sparse(size, at, np.ones(len(at)))

    model = LogisticRegression(maxIter=STEPS, regParam=DECAY, weightCol="n").fit(
        held.select(F.col("label").cast("double").alias("label"), vector("held").alias("features"), "n"))
    # sums over tasks come in any order: what that changes is rounded away
    return chosen, np.round(model.coefficients.toArray(), 5), round(float(model.intercept), 5)


def _may_be_among(texts: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of ``texts`` but for most whose id ``known`` lacks, so that fewer texts are shuffled by the exact join
    that follows. What is broadcast is a bitmap of hashed ids, of at most 2 ** ``ID_BITS`` bits."""
    spot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << ID_BITS))
    bits = (known.select(spot.alias("spot__")).groupBy(F.bitmap_bucket_number("spot__").alias("bucket__"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("spot__")).alias("bits__")))
    at = F.bitmap_bit_position(spot)
    byte = F.conv(F.hex(F.substring("bits__", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return (texts.withColumn("bucket__", F.bitmap_bucket_number(spot)).join(F.broadcast(bits), "bucket__")
            .where(F.getbit(byte, (at % 8).cast("int")) == 1).select(*texts.columns))


def training_rows(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """Texts of all labelled rows outside the held-out fold, and the number of such labels per class."""
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label"))
             .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.max("label").alias("label")))
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    texts = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
             .where(~held_out(F.col("doc_id"))))
    # dealt by id at every size, so neither side need fit one machine
    return _may_be_among(texts, known).join(known.hint("merge"), "doc_id"), sizes


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def table(total: Counter[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in total], pa.string()),
                                           pa.array(total.values(), pa.int64())], names=["word", "n"])

    total: Counter[bytes] = Counter()
    for batch in batches:
        for text in tk.arrow_bytes(batch.column("text")):
            total.update(set(WORD.findall(text.lower())))
        if len(total) > HELD_KEYS:
            yield table(total)
            total.clear()
    yield table(total)


def word_costs(docs: DataFrame) -> dict[str, float]:
    """-log P of the most common words of all ``docs``, by the documents that hold them."""
    rows = (docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_words, "word string, n long")
            .groupBy("word").agg(F.sum("n").alias("n"))
            .where(F.col("n") >= MIN_WORD_DOCS).orderBy(F.desc("n"), "word").limit(MAX_WORDS).collect())
    total = sum(r["n"] for r in rows)
    return {r["word"]: math.log(total / r["n"]) for r in rows}


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Character and word costs of all documents, and the word model of all labelled rows outside the fold."""
    costs = character_costs(character_counts(docs))
    words = word_costs(docs)
    rows, sizes = training_rows(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(costs, words)
        for batch in batches:
            texts = tk.arrow_bytes(batch.column("text"))
            for lo, hi in tk.byte_batches(texts):
                doc, number = feature_numbers(restored(texts[lo:hi], decoder))
                pairs = np.unique(doc << BUCKETS | number)
                parts = np.split((pairs & ((1 << BUCKETS) - 1)).astype(np.int32),
                                 np.searchsorted(pairs >> BUCKETS, np.arange(1, hi - lo)))
                yield pa.RecordBatch.from_arrays([batch.column("label").slice(lo, hi - lo),
                                                  pa.array([p.tobytes() for p in parts], pa.binary())], names=["label", "x"])

    # decoded once, read by both passes of the fit
    held = stored(rows.select("label", "text").mapInArrow(run, "label int, x binary"), "toxic-rows")
    return Model(costs, words, *fit_words(held, sizes))


def score(docs: DataFrame, model: Model, cutoff: float = 0.5) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row. Null and empty texts get the base rate.
    Rows are scored one by one, so repeated rows get equal scores; other columns are ignored."""
    arrow_rows(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.scorer()
        for batch in batches:
            texts = tk.arrow_bytes(batch.column("text"))
            for lo, hi in tk.byte_batches(texts):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo),
                                                  pa.array(scorer(texts[lo:hi]))], names=["doc_id", "score"])

    scored = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
              .mapInArrow(run, "doc_id long, score double"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= cutoff).cast("int").alias("predicted"))
