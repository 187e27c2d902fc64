"""Per-document statistics of a batch of texts, by whole-batch numpy operations."""

from __future__ import annotations

import numpy as np

from parcelspark.llm import textkit as tk

NGRAMS = tuple(range(3, 11))           # lengths measured for duplicated n-grams
COVERAGE_NGRAMS = tuple(range(5, 11))  # of these, lengths reported as character coverage

_LEAD = np.ones(256, dtype=bool)
_LEAD[0x80:0xC0] = False               # UTF-8 continuation bytes
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, dtype=bool)
_LOWER[97:123] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_PUNCT = np.zeros(256, dtype=bool)
_PUNCT[list(b".,;:!?'\"()-")] = True


def _duplicated(keys: np.ndarray) -> np.ndarray:
    """Mask of the keys that occur twice or more."""
    ordered = np.sort(keys)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return np.zeros(len(keys), dtype=bool)
    at = np.searchsorted(twice, keys)
    return (at < len(twice)) & (twice[np.minimum(at, len(twice) - 1)] == keys)


def _later(keys: np.ndarray) -> np.ndarray:
    """Mask of the keys that equal an earlier one."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    out = np.zeros(len(keys), dtype=bool)
    out[order[1:]] = ordered[1:] == ordered[:-1]
    return out


def _covered(starts: np.ndarray, n: int, size: int) -> np.ndarray:
    """Mask of the words inside windows of ``n`` words that begin at ``starts``."""
    step = np.zeros(size + 1, dtype=np.int32)
    step[starts] += 1                  # starts are distinct
    step[starts + n] -= 1
    return np.cumsum(step[:-1]) > 0


def statistics(texts: list[bytes]) -> dict[str, np.ndarray]:
    """Counts and repetition measures of each text (one array entry per text)."""
    t = tk.tokenize(texts)
    hashes = tk.RangeHash(t.buf)
    n_docs, n_words = t.n_docs, np.diff(t.first)
    hist = np.stack([np.bincount(t.buf[a:b], minlength=256) for a, b in zip(t.doc_start, t.doc_end)]) \
        if n_docs else np.zeros((0, 256), dtype=np.int64)
    chars = hist @ _LEAD
    out = {"n_words": n_words, "n_chars": chars, "word_chars": hist @ (_LEAD & ~tk.IS_SPACE),
           "n_symbols": hist @ _SYMBOL, "n_pipes": hist[:, ord("|")], "n_bangs": hist[:, ord("!")],
           "n_upper": hist @ _UPPER, "n_lower": hist @ _LOWER, "n_digits": hist @ _DIGIT,
           "n_punct": hist @ _PUNCT, "n_wide": hist[:, 0xC0:].sum(axis=1), "n_breaks": hist[:, 10]}

    lead = np.concatenate([[0], np.cumsum(_LEAD[t.buf], dtype=np.int64)])
    word_len = lead[t.end] - lead[t.start]
    doc = t.word_doc()
    words = hashes(t.start, t.end)
    salt = tk.mix64(np.arange(n_docs, dtype=tk.U64) + tk.U64(77))
    size = len(words)

    def per_doc(mask: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(doc[mask], weights=None if weights is None else weights[mask],
                           minlength=n_docs).astype(np.int64)

    distinct = np.sort(words + salt[doc]) if size else words
    firsts = np.ones(size, dtype=bool)
    firsts[1:] = distinct[1:] != distinct[:-1]
    # number of distinct words: count the first of each run, attributed through its owner
    owner = doc[np.argsort(words + salt[doc], kind="stable")] if size else doc
    out["n_distinct"] = np.bincount(owner[firsts], minlength=n_docs).astype(np.int64)
    same = np.zeros(size, dtype=bool)
    same[1:] = (words[1:] == words[:-1]) & (doc[1:] == doc[:-1])
    out["n_stutter"] = per_doc(same)

    # a duplicated n-gram consists of duplicated (n-1)-grams, so each length looks only there
    inside = np.zeros(size + 1, dtype=bool)
    for n in NGRAMS:
        if n == NGRAMS[0]:
            begin = np.arange(max(0, size - n + 1))
        else:
            begin = np.flatnonzero(inside[:-1] & inside[1:])
            begin = begin[begin + n <= size]
        begin = begin[doc[begin] == doc[begin + n - 1]] if len(begin) else begin
        inside = np.zeros(size + 1, dtype=bool)
        if len(begin):
            factors = tk.constants(5, n) | tk.U64(1)
            keys = words[begin] * factors[0]
            for j in range(1, n):
                keys += words[begin + j] * factors[j]
            inside[begin[_duplicated(tk.mix64(keys) + salt[doc[begin]])]] = True
        hit = _covered(np.flatnonzero(inside[:-1]), n, size) if inside.any() else np.zeros(size, dtype=bool)
        if n == 3:
            out["n_repeat_words"] = per_doc(hit)
        if n in COVERAGE_NGRAMS:
            out[f"dup_{n}gram_chars"] = per_doc(hit, word_len)

    breaks = np.flatnonzero(t.buf == 10)
    line_start = np.concatenate([[0], breaks[:-1] + 1]) if len(breaks) else breaks
    line_doc = np.searchsorted(t.doc_end, line_start)
    solid = np.concatenate([[0], np.cumsum(~tk.IS_SPACE[t.buf], dtype=np.int64)])
    has_word = solid[breaks] > solid[line_start]
    line_start, line_end, line_doc = line_start[has_word], breaks[has_word], line_doc[has_word]
    keys = hashes(line_start, line_end) + salt[line_doc] if len(line_start) else np.empty(0, dtype=tk.U64)
    again = _later(keys) if len(keys) else np.zeros(0, dtype=bool)
    repeated = _duplicated(keys) if len(keys) else again
    out["n_lines"] = np.bincount(line_doc, minlength=n_docs).astype(np.int64)
    out["n_dup_lines"] = np.bincount(line_doc[again], minlength=n_docs).astype(np.int64)
    out["dup_line_chars"] = np.bincount(line_doc[repeated], weights=(lead[line_end] - lead[line_start])[repeated],
                                        minlength=n_docs).astype(np.int64)
    return out
