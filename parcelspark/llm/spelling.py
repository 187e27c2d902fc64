"""Spelling variant grouping by finite-state composition.

The vocabulary is counted on Spark. Words that one inserted, deleted or replaced code point separates
agree before or behind the edit, so the vocabulary is dealt by shared parts: a group holds the words of
``size`` and ``size + 1`` code points that share their first ``head`` and last ``tail`` code points. Two
words one edit apart meet in exactly one group as owner. Within a group the minimised acceptor of its
shorter words is composed with a one-edit transducer and the minimised acceptor of all its words; the
accepted pairs are enumerated from the composition's initial state behind the shared parts. Groups that
are still large are dealt again by longer parts, so a group's size is bounded without a cap on words.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from parcelspark.llm.store import arrow_rows, stored

LETTERS = r"[A-Za-zÀ-ÿ]"
MIN_CHARS = 7
MIN_COUNT = 2
RATIO = 10               # a form is at least so many times as frequent
DROP = 31                # runs whose hash this divides lose one code point
GROUP_WORDS = 20_000     # groups with more words are dealt again

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEY = ["size", "head", "tail", "first", "last"]


class Acceptor:
    """Minimal acyclic automaton of sorted distinct strings: ``arcs[state][symbol] -> state``, ``final``.

    Built word by word: states behind the prefix shared with the next word are replaced by equal states
    that exist already (Daciuk et al., 2000). State 0 is the initial state.
    """

    def __init__(self, words: list[str]):
        self.arcs: list[dict[str, int]] = [{}]
        self.final: list[bool] = [False]
        known: dict[tuple, int] = {}
        open_states: list[tuple[int, str, int]] = []      # (parent, symbol, state) along the last word

        def close(keep: int) -> None:
            while len(open_states) > keep:
                parent, symbol, state = open_states.pop()
                shape = (self.final[state], tuple(self.arcs[state].items()))
                self.arcs[parent][symbol] = known.setdefault(shape, state)

        last = ""
        for word in words:
            shared = len(os.path.commonprefix((last, word)))
            close(shared)
            state = open_states[-1][2] if open_states else 0
            for symbol in word[shared:]:
                self.arcs.append({})
                self.final.append(False)
                open_states.append((state, symbol, len(self.arcs) - 1))
                self.arcs[state][symbol] = state = len(self.arcs) - 1
            self.final[state] = True
            last = word
        close(0)


class Composition:
    """``left`` composed with the transducer of one replaced or inserted symbol and with ``right``.

    A state is (left state, right state, edits made). States from which no pair is accepted are not
    entered: behind the edit, what both automata still accept in common is found once per state pair.
    """

    def __init__(self, left: Acceptor, right: Acceptor):
        self.left, self.right = left, right
        self.common: dict[tuple[int, int], bool] = {}

    def alive(self, p: int, q: int) -> bool:
        """Whether some string is accepted from both ``p`` (left) and ``q`` (right)."""
        stack = [(p, q)]
        while stack:
            a, b = stack[-1]
            if (a, b) in self.common:
                stack.pop()
                continue
            arcs, others = self.left.arcs[a], self.right.arcs[b]
            if len(arcs) > len(others):
                following = [(arcs[c], s) for c, s in others.items() if c in arcs]
            else:
                following = [(s, others[c]) for c, s in arcs.items() if c in others]
            unknown = [x for x in following if x not in self.common]
            if (self.left.final[a] and self.right.final[b]) or any(self.common.get(x) for x in following):
                self.common[a, b] = True
            elif unknown:
                stack.extend(unknown)
                continue
            else:
                self.common[a, b] = False
            stack.pop()
        return self.common[p, q]

    def pairs(self) -> set[tuple[str, str]]:
        """All accepted (left word, right word) from the initial state."""
        left, right = self.left, self.right
        found = set()
        # a path is a chain of (symbols read, symbols written, path before)
        stack: list[tuple] = [(0, 0, False, None)]
        while stack:
            p, q, edited, path = stack.pop()
            if edited and left.final[p] and right.final[q]:
                found.add(_spelled(path))
            arcs, others = left.arcs[p], right.arcs[q]
            for d, there in others.items():
                if d in arcs and (not edited or self.alive(arcs[d], there)):
                    stack.append((arcs[d], there, edited, (d, d, path)))
                if not edited:
                    if self.alive(p, there):
                        stack.append((p, there, True, ("", d, path)))
                    for c, here in arcs.items():
                        if c != d and self.alive(here, there):
                            stack.append((here, there, True, (c, d, path)))
        return found


def _spelled(path: tuple | None) -> tuple[str, str]:
    read, written = [], []
    while path is not None:
        read.append(path[0])
        written.append(path[1])
        path = path[2]
    return "".join(reversed(read)), "".join(reversed(written))


def one_edit_pairs(words: list[str], size: int) -> Iterator[tuple[str, str]]:
    """Pairs (a, b) of distinct words one edit apart, a of ``size`` code points, b of ``size`` (both
    orders) or ``size + 1``. ``words`` are sorted, distinct and of these two lengths."""
    if len(words) < 2:
        return
    head = len(os.path.commonprefix((words[0], words[-1])))
    back = os.path.commonprefix([w[::-1] for w in words])
    tail = min(len(back), min(map(len, words)) - head)
    start, end = words[0][:head], words[0][len(words[0]) - tail:]
    inner = sorted(w[head:len(w) - tail] for w in words)
    short = [w for w in inner if len(w) == size - head - tail]
    if not short:
        return
    for a, b in Composition(Acceptor(short), Acceptor(inner)).pairs():
        yield start + a + end, start + b + end


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per group and word: its near words there, their number, and the best of them."""
    out: list[tuple] = []
    for key, limit, counts in _groups(batches):
        best: dict[str, tuple[int, int, str]] = {}
        for a, b in one_edit_pairs(list(counts), key[0]):
            if limit is not None and len(os.path.commonprefix((a, b))) >= limit:
                continue                                   # a group of longer heads owns the pair
            for x, y in ((a, b), (b, a)) if len(a) != len(b) else ((a, b),):
                n, top, form = best.get(x, (0, 0, ""))
                if (-counts[y], y) < (-top, form):
                    top, form = counts[y], y
                best[x] = (n + 1, top, form)
        out.extend((w, *b) for w, b in best.items())
        if len(out) >= 10_000:
            yield _rows(out)
            out = []
    yield _rows(out)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[]] * 4
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], names=["word", "n_near", "best_n", "best"])


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, int | None, dict[str, int]]]:
    """(key, owner limit, {word: n}) of every group of two words or more, from batches sorted by key, word."""
    key, limit, held = None, None, {}
    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in ("size", "head", "tail", "word", "owner", "n")]
        for size, head, tail, word, owner, n in zip(*cols):
            now = (size, head, tail, word[:head], word[len(word) - tail:])
            if now != key:
                if len(held) > 1:
                    yield key, limit, held
                key, limit, held = now, owner, {}
            held[word] = n
    if len(held) > 1:
        yield key, limit, held


def word_counts(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, drop: int = DROP) -> DataFrame:
    """``word, n`` of all words of ``docs(doc_id, text)``: maximal letter runs, A-Z lower-cased; a run
    whose crc32 with its document's id ``drop`` divides loses one code point."""
    doc = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    # maximal runs of min_chars or more; a shorter run can only get shorter
    runs = F.regexp_extract_all(F.col("text").cast("string"), F.lit(f"{LETTERS}{{{min_chars},}}"), F.lit(0))
    run = docs.select(doc.alias("doc"), F.explode(runs).alias("run")).select("doc", F.translate("run", UPPER, LOWER).alias("run"))
    code = run.withColumn("code", F.crc32(F.encode(F.concat_ws(":", "doc", "run"), "UTF-8")))
    at = F.pmod(F.col("code"), F.length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    word = F.when(F.pmod(F.col("code"), F.lit(drop)) == 0, cut).otherwise(F.col("run"))
    return (code.select(word.alias("word")).where(F.length("word") >= min_chars)
            .groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count))


def _dealt(rows: DataFrame) -> DataFrame:
    """Deal each (word, n, size, head, tail, owner) by the first and by the second half of its free middle:
    an edit in one half leaves the other half equal. The second kind of group owns only pairs whose
    common beginning is shorter than the first kind's head."""
    half = F.floor((F.col("size") - F.col("head") - F.col("tail")) / 2).cast("int")
    middle = F.col("size") - F.col("head") - F.col("tail")
    longer = F.struct((F.col("head") + half).alias("head"), F.col("tail").alias("tail"), F.col("owner").alias("owner"))
    behind = F.struct(F.col("head").alias("head"), (F.col("tail") + middle - half).alias("tail"),
                      F.least("owner", F.col("head") + half).alias("owner"))
    out = rows.select("word", "n", "size", F.explode(F.array(longer, behind)).alias("part")).select("word", "n", "size", "part.*")
    return out.withColumn("first", _first("word", "head")).withColumn("last", _last("word", "tail"))


def _first(word: str, n: str) -> Column:
    return F.substring(F.col(word), F.lit(1), F.col(n))


def _last(word: str, n: str) -> Column:
    return F.substring(F.col(word), F.length(word) - F.col(n) + 1, F.col(n))


def near_words(vocabulary: DataFrame, min_chars: int = MIN_CHARS, group_words: int = GROUP_WORDS) -> DataFrame:
    """``word, n_near, best_n, best`` of every word of ``vocabulary(word, n)`` with near words."""
    sizes = F.filter(F.array(F.length("word"), F.length("word") - 1), lambda s: s >= min_chars)
    start = vocabulary.select("word", "n", F.explode(sizes).alias("size")).select(
        "word", "n", "size", F.lit(0).alias("head"), F.lit(0).alias("tail"), F.lit(None).cast("int").alias("owner"))
    rows = _dealt(start)
    while True:
        # a middle of one code point cannot be dealt again, and bounds the group by the alphabet
        large = stored(rows.where(F.col("size") - F.col("head") - F.col("tail") > 1).groupBy(*KEY).agg(F.count("*").alias("members"))
                       .where(F.col("members") > group_words).select(*KEY), "large")
        if large.isEmpty():
            break
        again = stored(_dealt(rows.join(large, KEY)), "dealt")
        rows = rows.join(large, KEY, "left_anti").select(*again.columns).unionAll(again)
    met = (rows.repartition(*KEY).sortWithinPartitions(*KEY, "word").select("size", "head", "tail", "word", "owner", "n")
           .mapInArrow(_met, "word string, n_near long, best_n long, best string"))
    return met


def roots(links: DataFrame) -> DataFrame:
    """``word, root`` for ``links(word, form)`` without cycles: the end of each chain, by doubling."""
    now = stored(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        after = stored(now.join(ahead, "root", "left"), "chains")
        if after.where(F.col("further").isNotNull()).isEmpty():
            return now
        now = after.select("word", F.coalesce("further", "root").alias("root"))


def spelling_variants(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, ratio: int = RATIO,
                      drop: int = DROP, group_words: int = GROUP_WORDS) -> DataFrame:
    """One row per word of ``docs(doc_id, text)``: ``word, form, root, n, n_near, form_n``.

    Near words differ by exactly one inserted, deleted or replaced code point. The form is the near word
    of largest n (ties: smallest in code point order) if that n is ``ratio`` times the word's or more.
    Null and empty texts hold no words; a null doc_id reads as empty; repeated rows count each time.
    No words give an empty result. Other columns are ignored.
    """
    if ratio < 2:
        raise ValueError("with a ratio under 2 two words could be each other's form")
    arrow_rows(docs.sparkSession, 10_000)
    vocabulary = stored(word_counts(docs, min_chars, min_count, drop), "vocabulary")
    alone = vocabulary.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("long").alias("best_n"),
                              F.lit(None).cast("string").alias("best"))
    met = near_words(vocabulary, min_chars, group_words).select("word", F.lit(None).cast("long").alias("n"), "n_near", "best_n", "best")
    best = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("rank"), F.col("best"))))
    merged = alone.unionAll(met).groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("top"))
    good = -F.col("top.rank") >= ratio * F.col("n")
    formed = stored(merged.select("word", "n", "n_near", F.when(good, F.col("top.best")).alias("form"),
                                  F.when(good, -F.col("top.rank")).alias("form_n")), "forms")
    ends = roots(formed.where(F.col("form").isNotNull()).select("word", "form"))
    return (formed.join(ends, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
