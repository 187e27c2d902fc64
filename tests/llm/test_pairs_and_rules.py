"""Near-duplicates, components, quality rules, quality and toxicity models."""

import itertools
import math
import random

import numpy as np
import pytest

from parcelspark.llm import docstats, near_dedup, quality_model, quality_rules, textkit as tk, toxicity
from parcelspark.llm.graph import connected_components
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def test_tokenizer_matches_the_word_rule(texts):
    chosen = [t or "" for t in texts.values()]
    tokens = tk.tokenize([t.encode() for t in chosen])
    for i, t in enumerate(chosen):
        got = [bytes(tokens.buf[a:b]).decode() for a, b in
               zip(tokens.start[tokens.first[i]:tokens.first[i + 1]], tokens.end[tokens.first[i]:tokens.first[i + 1]])]
        assert got == brute.words(t)


def test_range_hash_depends_on_content_only():
    data = [b"abc abc xabc", b"ABC abd"]
    tokens = tk.tokenize(data)
    plain = tk.RangeHash(tokens.buf)(tokens.start, tokens.end)
    assert plain[0] == plain[1] != plain[2] and plain[3] != plain[0]
    folded = tk.RangeHash(tokens.buf, folded=True)(tokens.start, tokens.end)
    assert folded[3] == folded[0] != folded[4]


@pytest.mark.parametrize("n", [2, 5])
def test_near_duplicates_equal_brute_force(documents, texts, n):
    got = {r["doc_id"]: r for r in near_dedup.near_duplicates(documents, shingle=n).collect()}
    expected = brute.components(texts, n, 80)
    assert len(got) == len(texts)
    for i, (size, component) in expected.items():
        assert (got[i]["n_shingles"], got[i]["component_id"]) == (size, component), i
        assert got[i]["kept"] == (i == component)


def _chain_documents(size=60, links=14):
    """Neighbours overlap at 0.8 or more, ends do not: one component only through the chain."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(5000)]
    now, out = [rng.choice(vocabulary) for _ in range(size)], []
    for i in range(links):
        out.append((i * 3, " ".join(now)))
        now = now[2:] + [rng.choice(vocabulary) for _ in range(2)]
    return out


def test_chains_and_hot_groups_keep_every_link(spark, monkeypatch):
    rng = random.Random(7)
    base = [f"v{rng.randrange(3000)}" for _ in range(120)]
    rows = _chain_documents()
    for i in range(150):                       # near copies whose mutual similarity lies on both sides of 0.8
        copy = list(base)
        for _ in range(rng.randrange(0, 12)):
            copy[rng.randrange(len(copy))] = f"x{rng.randrange(9000)}"
        rows.append((1000 + i, " ".join(copy)))
    rows += [(5000 + i, " ".join(base)) for i in range(40)]   # exact copies
    monkeypatch.setattr(near_dedup, "CHUNK", 16)              # many blocks per bucket
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(df, shingle=2).collect()}
    assert got == {i: c for i, (_, c) in brute.components(dict(rows), 2, 80).items()}


def test_near_duplicates_edge_rows(spark, nothing):
    assert near_dedup.near_duplicates(nothing).count() == 0
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (7, None), (8, "A B c d e f")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["component_id"]) for r in near_dedup.near_duplicates(df).collect())
    assert got == [(False, 3, 3), (False, 3, 3), (False, 7, 7), (False, 8, 3), (True, 0, None)]
    kept = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in near_dedup.deduplicated(df).collect())
    assert kept == [(False, 3), (False, 7), (True, 0)]


def test_posterior_bounds_keep_true_links():
    needed = near_dedup.min_matches(0.8)
    rng = np.random.default_rng(3)
    left = rng.integers(0, 1 << 16, (4000, near_dedup.N_HASHES)).astype(np.uint16)
    same = rng.random(left.shape) < 0.8
    right = np.where(same, left, left + 1)
    assert len(near_dedup.surviving(left, right, needed)) >= 3999
    far = np.where(rng.random(left.shape) < 0.5, left, left + 1)
    assert len(near_dedup.surviving(left, far, needed)) == 0


def test_intersections_by_matrix_equal_pairwise():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 300, 80)).astype(np.uint64) for _ in range(30)]
    left, right = np.triu_indices(30, 1)
    got = near_dedup.intersections(sets, left, right, slab=37)
    assert got.tolist() == [len(np.intersect1d(sets[a], sets[b])) for a, b in zip(left, right)]


def test_connected_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 90), (90, 95), (7, 7), (None, 3), (95, 100)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 90: 90, 95: 90, 100: 90}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_quality_rules_equal_brute_force(documents, texts):
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(documents).collect()}
    assert len(got) == len(texts)
    for i, t in texts.items():
        row, expected = got[i], brute.rules(t)
        assert tuple(row[c] for c in quality_rules.COUNTS) == expected, i
        assert row["base_failed"] == (expected[0] < 50 or 100 * expected[4] > 50 * expected[0])
        assert not (row["base_failed"] and row["kept"])


def test_repetition_coverage():
    phrase = "alpha beta gamma delta epsilon zeta"
    unique = " ".join(f"u{i}" for i in range(40))
    text = f"{phrase} {unique} {phrase}"
    s = docstats.statistics([text.encode(), b"", unique.encode()])
    chars = 2 * len(phrase.replace(" ", ""))
    assert s["dup_5gram_chars"].tolist() == [chars, 0, 0] and s["dup_6gram_chars"].tolist() == [chars, 0, 0]
    assert s["dup_7gram_chars"].tolist() == [0, 0, 0]


def test_quality_rules_empty(nothing):
    assert quality_rules.quality_rules(nothing).count() == 0


def _labelled_split(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    return docs, labels


def _area(y, p):
    order = np.argsort(p, kind="stable")
    rank = np.empty(len(p))
    rank[order] = np.arange(len(p))
    return (rank[y == 1].mean() - ((y == 1).sum() - 1) / 2) / (y == 0).sum()


def test_quality_model_on_held_out_rows(spark):
    docs, labels = _labelled_split(spark, "/root/testdata/sf0.01")
    scored = quality_model.score(docs, quality_model.train(docs, labels)).join(labels.select("doc_id", "quality"), "doc_id")
    rows = scored.where("held_out").toPandas()
    assert _area(rows["quality"].to_numpy(), rows["score"].to_numpy()) > 0.95
    assert (rows["predicted"] == rows["quality"]).mean() > 0.95
    assert rows["score"].between(0, 1).all()


def test_toxicity_model_on_held_out_rows(spark):
    docs, labels = _labelled_split(spark, "/root/testdata/sf0.1")
    scored = toxicity.score(docs, toxicity.train(docs, labels)).join(labels.select("doc_id", "toxic"), "doc_id")
    rows = scored.where("held_out").toPandas()
    assert _area(rows["toxic"].to_numpy(), rows["score"].to_numpy()) > 0.95
    assert (rows["predicted"] == rows["toxic"]).mean() > 0.97


def test_labels_of_the_held_out_fold_are_not_learned(spark):
    docs, labels = _labelled_split(spark, SF)
    from pyspark.sql import functions as F
    fold = quality_model.held_out(F.col("doc_id"))
    flipped = labels.withColumn("quality", F.when(fold, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality_model.train(docs, labels), quality_model.train(docs, flipped)
    assert a.base == b.base and np.array_equal(a.value, b.value)


def test_models_without_labels_or_texts(spark, documents, nothing):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    forest = quality_model.train(documents, none)
    assert {r["score"] for r in quality_model.score(documents, forest).collect()} == {0.5}
    assert quality_model.score(nothing, forest).count() == 0
    assert quality_model.accepted(documents, forest).columns == documents.columns
    model = toxicity.train(documents, none)
    assert {r["score"] for r in toxicity.score(documents, model).collect()} == {0.5}
    assert toxicity.score(nothing, toxicity.train(nothing, none)).count() == 0


def test_forest_fits_a_step():
    x = np.linspace(0, 1, 400)[:, None]
    y = (x[:, 0] > 0.3).astype(float)
    forest = quality_model.fit(x, y)
    assert ((forest.probability(x) > 0.5) == (y == 1)).mean() > 0.98


@pytest.fixture(scope="module")
def decoder(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return toxicity.Decoder(toxicity.character_costs(toxicity.character_counts(docs)))


def test_character_counts_equal_brute_force(spark):
    df = spark.createDataFrame([("Ab1",), (None,), ("é",)], "text string").coalesce(1)
    counts = toxicity.character_counts(df)
    codes = [0, 1, 2, 0, 0, 0, 27, 27, 0]          # " Ab1", "", "é" joined by blanks
    expected = np.zeros_like(counts)
    for a, b, c in zip(codes, codes[1:], codes[2:]):
        expected[a * 784 + b * 28 + c] += 1
    assert np.array_equal(counts, expected)


@pytest.mark.parametrize("written, meant", [("you 1d10t", "you idiot"), ("m0r0n!", "moron!"), ("s t u p i d", "stupid"),
                                            ("l.o.s.e.r", "loser"), ("stuuupid", "stupid"), ("tr@sh", "trash")])
def test_disguised_spellings_are_restored(decoder, written, meant):
    assert toxicity.disguised([written.encode()]).all()
    assert decoder.text(written) == meant


@pytest.mark.parametrize("written, meant", [("1d107", "idiot"), ("455h0l3", "asshole"), ("d13", "die"), ("57up1d!!!", "stupid!!!"),
                                            ("a$$", "ass"), ("s" * 130 + "tupid", "stupid"),
                                            ("5tu" + "u" * 60 + "p1d", "stupid")])
def test_words_disguised_strongly_or_at_the_end_are_restored(decoder, written, meant):
    assert toxicity.disguised([written.encode()]).all()
    assert decoder.text(written) == meant


@pytest.mark.parametrize("written, meant", [("you are a s t u p i d i d i o t", "you are a stupid idiot"), ("a t r a s h", "a trash"),
                                            ("s.t.u.p.i.d i.d.i.o.t", "stupid idiot"), ("d i e", "die"),
                                            ("1 d 1 0 t", "idiot")])
def test_spaced_out_words_are_split(spark, decoder, written, meant):
    docs, labels = _labelled_split(spark, "/root/testdata/sf0.1")
    words = toxicity.word_costs(toxicity.training_rows(docs, labels)[0])
    assert toxicity.disguised([written.encode()]).all()
    assert toxicity.Decoder(np.array(decoder.costs), words).text(written) == meant


@pytest.mark.parametrize("written", ["9f86d081884c7d65", "Zk39QpXw7LmT2vRb8NcYdF5hGj4S", "covid19", "10th", "$100k",
                                     "9c1185a5c5e9fc54612808977ee8f548b2258d31" * 50])
def test_keys_and_numbers_are_left_as_written(decoder, written):
    assert decoder.text(written) == written


def _split_cost(decoder, words):
    total = 0.0
    for w in words:
        spelled, a, b = toxicity.NEW_WORD_COST, 0, 0
        for c in (ord(x) - 96 for x in w):
            spelled += decoder.costs[a][b][c]
            a, b = b, c
        total += min(spelled + decoder.costs[a][b][0], decoder.words.get(w, math.inf))
    return total


def test_splits_cost_as_little_as_the_best_of_all_splits(decoder):
    rng = random.Random(5)
    known = toxicity.Decoder(np.array(decoder.costs), {w: rng.uniform(3, 9) for w in ("the", "cat", "bad", "at", "tea", "e")})
    for _ in range(100):
        s = "".join(rng.choice("theacbd") for _ in range(rng.randint(1, 9)))
        cuts = [[j for j, cut in enumerate(marks, 1) if cut] for marks in itertools.product((0, 1), repeat=len(s) - 1)]
        every = [[s[a:b] for a, b in zip([0, *c], [*c, len(s)])] for c in cuts]
        got = known._split(s)
        assert "".join(got) == s
        assert _split_cost(known, got) == pytest.approx(min(_split_cost(known, words) for words in every))
    assert known._split("q" * 90) == ["q" * 90]             # unknown words have any length


def _all_readings(decoder, written):
    """(cost, text) of every path through the lattice of ``written``, each walked on its own."""
    inside = [i for i, c in enumerate(written) if c.isalpha()]
    readings = [(0.0, 0, 0, "", "")]
    for i, char in enumerate(written):
        after = []
        options = [(char, 0.0)] if char.isalpha() else [(c, toxicity.SWAP_COST) for c in toxicity.LEET.get(char, "")]
        drop = toxicity.REPEAT_COST if char * 3 in written[max(0, i - 2):i + 3] else toxicity.DOUBLE_COST
        between = bool(inside) and inside[0] <= i < inside[-1]
        keep = toxicity.KEEP_COST.get(char, 0.0) + (toxicity.INNER_COST if char.isdigit() and between else 0.0)
        for cost, a, b, seen, text in readings:
            for letter, extra in options:
                c = ord(letter) - 96
                after.append((cost + extra + decoder.costs[a][b][c], b, c, letter, text + letter))
                if letter == seen:
                    after.append((cost + extra + drop, a, b, seen, text))
            if char in "*!|":
                after.append((cost + toxicity.GAP_COST, a, b, seen, text))
            if char in toxicity.KEEP_COST:
                after.append((cost + keep + (decoder.costs[a][b][0] if b else 0.0), b or a, 0, "", text + char))
        readings = after
    return [(cost + (decoder.costs[a][b][0] if b else 0.0), text) for cost, a, b, _, text in readings]


def test_decoding_equals_the_best_of_all_readings(decoder):
    rng = random.Random(9)
    changed = 0
    for _ in range(300):
        written = "".join(rng.choice("idotsa105!@$*") for _ in range(rng.randint(2, 6)))
        if not any(c.isalpha() for c in written):
            continue
        start = 0.0 if written.strip("!*|+").isalpha() else toxicity.KEY_START
        cost, text = min(_all_readings(decoder, written))
        expected = written if cost >= start + len(written) * toxicity.KEY_COST else text
        got = decoder.restore(written, key=True)
        changed += got != written
        costs = {t: min(c for c, u in _all_readings(decoder, written) if u == t) for t in {got}} if got != written else {}
        assert got == expected or costs[got] == pytest.approx(cost), written
    assert changed > 50


def test_plain_text_is_left_alone(decoder, texts):
    plain = "The quick brown fox, and 12 of 345 dogs; schön été niño. A | b | c!"
    assert not toxicity.disguised([plain.encode()])[0] or decoder.text(plain) == plain
    assert decoder.text("04dbebab91ab85687d33eeaaf9ac699e1188f962") == "04dbebab91ab85687d33eeaaf9ac699e1188f962"


def test_byte_search_finds_every_pattern_match(texts):
    for t in texts.values():
        t = t or ""
        if any(p.search(t) for p in (toxicity.SPACED, toxicity.STRETCHED)):
            assert toxicity.disguised([t.encode()])[0]


def test_toxicity_counts_and_learns_from_all_rows(spark):
    """A word of unlabelled documents is counted, and a word that only the last of many labelled rows hold is learned."""
    import hashlib
    import zlib
    taught = [i for i in range(18_000) if zlib.crc32(str(i).encode()) % 5][:13_500]
    toxic = sorted(taught[:4_500], key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
    late = set(toxic[-200:])
    rows = [(i, "zorbly words here" if i in late else "vile words here") for i in toxic]
    rows += [(i, "plain words here") for i in taught[4_500:]] + [(i, "quondam evening") for i in range(90_000, 90_005)]
    rows += [(95_000, "one zorbly day"), (95_001, "one plain day")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(n < 4_500)) for n, i in enumerate(taught)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert "quondam" in model.words
    score = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).where("doc_id >= 95000").collect()}
    assert score[95_000] > 0.9 and score[95_001] < 0.1
    assert [toxicity.train(docs, labels).bias for _ in range(2)] == [model.bias] * 2


def test_labelled_texts_are_all_found(spark):
    ids = [*range(-300, 300), 2 ** 62, -2 ** 63, None]
    docs = spark.createDataFrame([(i, f"t{n}") for n, i in enumerate(ids)] + [(7, "again")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, n % 2) for n, i in enumerate(ids) if n % 3], "doc_id long, toxic int")
    wanted = docs.join(labels, "doc_id").where(~quality_model.held_out(docs["doc_id"])).select("doc_id", "text", "toxic")
    got = toxicity.training_rows(docs, labels)[0].select("doc_id", "text", "label")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, wanted.collect()))
    slim = docs.where("doc_id is not null")
    assert toxicity._may_be_among(slim, labels.where("doc_id is not null")).count() < 0.8 * slim.count()
