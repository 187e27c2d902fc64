"""Spelling variants, HTML extraction and importance resampling against plain versions."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelspark.llm import html_blocks, resampling, spelling


def with_clashes(df, names):
    for name in names:
        df = df.withColumn(name, F.lit("x"))
    return df


# ---------------------------------------------------------------- spelling variants

def near(a, b):
    """One inserted, deleted or replaced code point."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_spelling(rows, min_chars=7, min_count=2, ratio=10):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                i = h % len(run)
                run = run[:i] + run[i + 1:]
            if len(run) >= min_chars:
                counts[run] += 1
    words = {w: n for w, n in counts.items() if n >= min_count}
    out = {}
    by_size = {}
    for w in words:
        by_size.setdefault(len(w), []).append(w)
    for w, n in words.items():
        close = [v for size in (len(w) - 1, len(w), len(w) + 1) for v in by_size.get(size, []) if near(w, v)]
        best = min(close, key=lambda v: (-words[v], v), default=None)
        form = best if best is not None and words[best] >= ratio * n else None
        out[w] = [form, None, n, len(close), words[form] if form else None]
    for w in out:
        root = w
        while out[root][0]:
            root = out[root][0]
        out[w][1] = root
    return {w: tuple(x) for w, x in out.items()}


def rows_of(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def test_acceptor_is_minimal_and_accepts_its_words():
    words = sorted({"".join(w) for k in range(1, 6) for w in itertools.product("ab", repeat=k) if hash(w) % 3})
    machine = spelling.Acceptor(words)

    def accepted(state, prefix):
        if machine.final[state]:
            yield prefix
        for c, there in machine.arcs[state].items():
            yield from accepted(there, prefix + c)

    assert sorted(accepted(0, "")) == words
    used, todo = {0}, [0]
    while todo:
        for there in machine.arcs[todo.pop()].values():
            if there not in used:
                used.add(there)
                todo.append(there)
    languages = [tuple(sorted(accepted(s, ""))) for s in used]
    assert len(set(languages)) == len(languages)          # no two states accept the same


@pytest.mark.parametrize("seed", range(6))
def test_composition_enumerates_all_pairs(seed):
    rng = random.Random(seed)
    size = rng.choice([2, 3, 5])
    words = sorted({"".join(rng.choice("abç\U0001F600") for _ in range(rng.choice([size, size + 1]))) for _ in range(60)})
    got = set(spelling.one_edit_pairs(words, size))
    expected = {(a, b) for a in words for b in words if len(a) == size and near(a, b) and len(b) >= size}
    assert got == expected


def test_composition_takes_very_long_words():
    long = "ab" * 40_000
    words = sorted([long + "a" + long, long + "c" + long, long + long])
    assert len(set(spelling.one_edit_pairs(words, len(long) * 2))) == 2


def test_spelling_of_documents(documents, texts):
    df = with_clashes(documents, ["word", "form", "root", "first", "last", "size", "head", "a.b"])
    assert rows_of(spelling.spelling_variants(df)) == brute_spelling(texts.items())


@pytest.mark.parametrize("group_words", [1, 3, 20_000])
def test_spelling_with_many_near_words(spark, group_words):
    """A small alphabet makes every word near to many; small bounds deal the groups again and again."""
    rng = random.Random(3)
    rows = []
    for i in range(60):
        words = ["".join(rng.choice("ab") for _ in range(rng.choice([7, 8, 9]))) for _ in range(20)]
        words += ["abababab"] * rng.choice([0, 30]) + ["aaaaaaa"] * 4 + ["ABABABABÀ"] * (i % 7)
        rows.append((i, " ".join(words)))
    rows += [(None, "straßenzug straßenzug Straßenzüg"), (70, None), (71, ""), (72, " 12 -- ")]
    rows += [(73, "wörterbuch " * 250), (74, "wörterbusch " * 21), (75, "wörterbuscht"), (75, "wörterbuscht")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = rows_of(spelling.spelling_variants(df, group_words=group_words))
    assert got == brute_spelling(rows)
    assert any(f and got[f][0] for f, *_ in got.values())          # chains of forms occur


def test_spelling_of_nothing(nothing):
    out = spelling.spelling_variants(nothing)
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"] and out.count() == 0
    with pytest.raises(ValueError):
        spelling.spelling_variants(nothing, ratio=1)


# ---------------------------------------------------------------- importance resampling

def brute_resample(rows, target, max_n, buckets=10_000, seed=2024, min_words=20, percent=10):
    def features(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return len(words), [zlib.crc32(" ".join(words[i:i + n]).encode()) % buckets
                            for n in range(1, max_n + 1) for i in range(len(words) - n + 1)]

    source, wanted = Counter(), Counter()
    for _, text in rows:
        source.update(features(text)[1])
    for text in target:
        wanted.update(features(text)[1])
    s_all, t_all = sum(source.values()), sum(wanted.values())
    gain = [math.floor(1000 * math.log((wanted[b] + 1) * (s_all + buckets) / ((source[b] + 1) * (t_all + buckets)))) for b in range(buckets)]
    out = []
    for doc_id, text in rows:
        n_words, own = features(text)
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in own)
        out.append([doc_id, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2 ** 32))), n_words])
    drawn = sorted((r for r in out if r[4] >= min_words),
                   key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for r in out:
        r[4] = None
    for place, r in enumerate(drawn[:len(drawn) * percent // 100], 1):
        r[4] = place
    return sorted(map(tuple, out), key=str)


@pytest.mark.parametrize("max_n, percent", [(1, 10), (3, 35)])
def test_resampling_equals_the_plain_version(spark, documents, texts, max_n, percent):
    target = ["die Straße und der Hund", None, "", "the first part of the whole", "the the THE"]
    rows = [*texts.items(), (9001, "the same text " * 9), (9001, "the same text " * 9), (None, "ids can be null " * 7), (None, None)]
    df = with_clashes(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), ["place", "rank", "offset", "weight", "n.w"])
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    got = resampling.resample(df, wanted, max_n=max_n, percent=percent)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=str) == brute_resample(rows, target, max_n, percent=percent)


def test_resampling_ties_and_empty_tables(spark, nothing):
    empty = spark.createDataFrame([], "text string")
    assert resampling.resample(nothing, empty).count() == 0
    rows = [(i // 2, "word " * 25) for i in range(40)]        # pairs of equal rows have equal scores
    got = resampling.resample(spark.createDataFrame(rows, "doc_id long, text string"), empty, percent=50).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 21))
    assert sorted(map(tuple, got), key=str) == brute_resample(rows, [], 1, percent=50)


def test_slices_cover_all_texts():
    import pyarrow as pa
    column = pa.array(["a" * 50, None, "", "b" * 500, "c", "d" * 20])
    parts = list(resampling.slices(column, 100))
    assert [v for p in parts for v in p.to_pylist()] == column.to_pylist() and len(parts) > 1


@pytest.mark.parametrize("max_n", [1, 3])
def test_features_of_slices_are_those_of_their_texts(max_n):
    """Every slice of a column, with and without nulls, gives what its texts give alone."""
    import pyarrow as pa
    for rows in (["x y z", "q", "A b", "", "c D e f", "b\u00dcB 9\x00k"], ["x y", None, "a B c", "\n\u0130 d", None, "e"]):
        alone = [resampling.features(pa.array([t], pa.string()), max_n, 10_000) for t in rows]
        for limit in (1, 6, 12, 1000):
            at = 0
            for part in resampling.slices(pa.array(rows, pa.string()), limit):
                n_words, grams = resampling.features(part, max_n, 10_000)
                for i in range(len(part)):
                    assert n_words[i] == alone[at][0][0]
                    assert [b[o == i].tolist() for o, b in grams] == [b.tolist() for _, b in alone[at][1]]
                    at += 1
            assert at == len(rows)


def test_resampling_of_batches_beyond_one_slice(spark):
    """Long texts without nulls, so that a batch is cut into several slices."""
    rows = [(i, " ".join(f"Word{(i * 31 + j * j) % 997} und{j % 13}" for j in range(30_000))) for i in range(30)]
    assert sum(len(t) for _, t in rows) > 2 * resampling.SLICE_BYTES
    target = ["word5 und3 word7 " * 5, "und1"]
    got = resampling.resample(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1),
                              spark.createDataFrame([(t,) for t in target], "text string")).collect()
    assert sorted(map(tuple, got), key=str) == brute_resample(rows, target, 1)


# ---------------------------------------------------------------- HTML extraction

STORY = "The ferry left the harbour at six in the morning with forty passengers and two dogs on board."
PAGES = {
    # named containers, references, white space, cut-off end
    f"<html><body class='has-sidebar'><nav><a href=/>Home</a></nav><article><h1>Caf&eacute; &amp;\n Bar</h1><p>{STORY}</p><p>Yes</p>":
        f"Café & Bar\n{STORY}\nYes",
    f"<body><header><h1>Site</h1></header><article><header><h1>Title</h1></header><p>One<br>two &#x263A;&nbsp;x</p></article><footer>F</footer>":
        "Title\nOne two ☺ x",
    # scripts, styles, comments, textareas, templates
    f"<article><script>var t='</p><p>no</p>';</script><style>p{{}}</style><!-- <p>no</p> --><p>{STORY}</p><noscript>On!</noscript>"
    f"<textarea><p>no</p></textarea><template><p>no</p></template></article>": STORY,
    # advert, notice, sidebar, form, reader comments, share links around and in the article
    f"""<div id=cookieNotice>{STORY}</div><aside>{STORY}</aside><main><article><p>{STORY}</p><div class="ad-slot">{STORY}</div><p>Tail.</p>
    <form><label>Mail</label><input><button>Go</button></form><section class="comments"><article class="comment"><p>{STORY}</p></article></section>
    </article></main><div class=promo>{STORY}</div>""": f"{STORY}\nTail.",
    # no article element
    f"<div class='menu'><a href=/>A</a></div><div class='entry-content'><h2>Head</h2><p>{STORY}</p><p>Ok.</p></div><div id='sidebar'>{STORY}</div>":
        f"Head\n{STORY}\nOk.",
    # no names at all
    f"<p><a href=/>Home</a> <a href=/n>News</a></p><p>{STORY}</p><p>{STORY} {STORY}</p><p>{STORY}</p><p><a href=/x>Imprint</a></p>":
        f"{STORY}\n{STORY} {STORY}\n{STORY}",
    # missing end tags: paragraphs, list items, nav
    f"<nav><ul><li><a href=/>Home</a><li><a href=/n>News</a><article><p><b>{STORY}<p>Two<ul><li>x y<li>z</ul></article>":
        f"{STORY}\nTwo\nx y\nz",
    "<article><p>1 < 2 and a<b>c</b> & d &lt;p&gt; <p title='a>b'>ok</p></article>": "1 < 2 and ac & d <p>\nok",
    "": "", "   \n": "", "<p": "", "<!-- never closed <p>text</p>": "", "<script>never closed": "",
}


def test_pages_give_their_main_text(spark):
    rows = [(i, f"u{i}", page) for i, page in enumerate(PAGES)] + [(90, None, None), (None, "u", "<article><p>x</p></article>")]
    rows += [rows[0], rows[0]]
    df = with_clashes(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2), ["text", "n_chars", "a.b"])
    got = html_blocks.extract(df)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    by_id = {}
    for r in got.collect():
        assert r["n_chars"] == len(r["text"])
        by_id.setdefault(r["page_id"], set()).add(r["text"])
    for i, (page, text) in enumerate(PAGES.items()):
        assert by_id[i] == {text}, page
    assert by_id[90] == {""} and by_id[None] == {"x"}
    assert got.count() == len(rows)
    assert html_blocks.extract(df.limit(0)).count() == 0


def test_given_pages(spark):
    """The given pages mark their article by an element; paragraphs and headings are its blocks."""
    import html
    for r in html_blocks.extract(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")).join(
            spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "html"), "page_id").collect():
        inner = re.search(r"<article>(.*?)(</article>|$)", r["html"] or "<article></article>", re.S)[1]
        parts = [" ".join(html.unescape(re.sub("<br>", " ", re.sub("</?b>", "", x))).split()) for x in re.split("</?p>|</?h1>", inner)]
        assert r["text"] == "\n".join(p for p in parts if p)


def test_tree_against_a_plain_walk():
    rng = np.random.default_rng(4)
    x, y = rng.integers(0, 6, (300, 4)).astype(float), rng.integers(0, 2, 300).astype(float)
    tree = html_blocks.grow(x, y, depth=5)

    def walk(row):
        at = 0
        while tree.left[at] != at:
            at = tree.right[at] if row[tree.feature[at]] > tree.limit[at] else tree.left[at]
        return tree.share[at] > 0.5

    assert [walk(r) for r in x] == tree.main(x).tolist()
    # the root splits where the weighted Gini impurity is least
    def impurity(f, limit):
        parts = [y[x[:, f] > limit], y[x[:, f] <= limit]]
        return sum(p.sum() * (len(p) - p.sum()) / len(p) for p in parts if len(p))
    best = min(impurity(f, v + 0.5) for f in range(4) for v in range(5))
    assert impurity(tree.feature[0], tree.limit[0]) == pytest.approx(best)


def test_labelled_table_is_learned():
    tree = html_blocks.train()
    for page in html_blocks.LABELLED_PAGES:
        read = html_blocks.blocks(page)
        assert tree.main(html_blocks.describe(read)).tolist() == [p.labelled for p in read.places]


@pytest.mark.parametrize("piece", ["<b", "<p ", "<a href=\"", "<!--", "<div>", "<p>x", "<li>x", "&amp", "</div>", "<ul><li>", "< "])
def test_long_broken_pages_are_read_in_linear_time(piece):
    import time
    began = time.perf_counter()
    html_blocks.blocks(piece * 100_000)
    assert time.perf_counter() - began < 20
