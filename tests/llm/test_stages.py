"""Stages and operators on hard rows: repeated and missing ids, clashing names, empty tables; and verdicts
that the dealt methods alone decide."""

import random
import re
import string

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from parcelspark.llm import mixing, near_dedup, packing, pii, quality_model, quality_rules, secret_scan, toxicity
from tests.llm import brute

SF = "/root/testdata/sf0.001"
NAMES = ["stay", "stay__", "place__", "mix_copies", "mix_epoch", "mix_id", "copies", "epoch", "row", "digest", "group", "first", "node",
         "n", "s1", "bucket", "size", "all", "base", "a.b", "back`tick", "kept", "copy", "block__", "shuffle"]


def long_text(seed, n=40, change=None):
    words = [f"w{seed}x{i}" for i in range(n)]
    if change is not None:
        words[change] = "changed"
    return " ".join(words)


@pytest.fixture(scope="module")
def hard(spark):
    """Documents with hard rows and with extra columns of awkward names."""
    rows = [(1, long_text(1)), (1, long_text(2)), (2, long_text(1, change=39)), (3, long_text(2, change=39)), (4, long_text(9)),
            (5, None), (5, None), (5, ""), (6, ""), (7, " \t "), (None, None), (None, long_text(1)), (None, long_text(1)),
            (8, long_text(4)), (8, long_text(4)), (9, "short"), (10, "short"), (-3, long_text(4, change=0)), (11, "naïve \U0001F600 " * 30)]
    df = spark.createDataFrame([(i, t, None if k % 3 else "en", None if k % 4 == 0 else f"src{k % 2}", None) for k, (i, t) in enumerate(rows)],
                               "doc_id long, text string, lang string, source string, n_chars long")
    for name in NAMES:
        df = df.withColumn(name, F.lit(f"kept {name}"))
    return df.repartition(3).cache()


def test_rows_that_share_an_id_keep_all_their_links(spark, hard):
    got = {(r["doc_id"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(hard).collect()}
    assert {(1, 1, True), (2, 1, False), (3, 1, False), (4, 4, True)} <= got
    assert {(8, -3, False), (-3, -3, True), (9, 9, True), (10, 9, False), (5, 5, True), (None, None, True)} <= got
    again = {(r["doc_id"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(hard.repartition(7)).collect()}
    assert again == got


@pytest.mark.parametrize("seed", range(3))
def test_repeated_ids_against_brute_force(spark, seed):
    """Components of texts, smallest id of each: rows are given numbers of their own for the plain version."""
    rng = random.Random(seed)
    rows = []
    for _ in range(160):
        base, words = rng.randrange(12), 24
        text = long_text(base, words).split(" ")
        for _ in range(rng.randrange(4)):
            text[rng.randrange(words)] = f"z{rng.randrange(3)}"
        rows.append((rng.randrange(40), " ".join(text)))
    plain = brute.components({k: t for k, (_, t) in enumerate(rows)}, 2, 80)
    lowest = {}
    for k, (_, root) in plain.items():
        lowest[root] = min(lowest.get(root, 1 << 60), rows[k][0])
    expected = sorted((rows[k][0], plain[k][0], lowest[plain[k][1]]) for k in plain)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = near_dedup.near_duplicates(df, shingle=2).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == expected
    assert near_dedup.deduplicated(df, shingle=2).count() == len(lowest)


def test_deduplication_keeps_one_row_of_each_group(hard):
    out = near_dedup.deduplicated(hard)
    assert out.columns == hard.columns
    rows = out.collect()
    kept = sorted(((r["doc_id"], r["text"]) for r in rows if r["doc_id"] is not None), key=str)
    # both texts of id 1 stay, as no other row holds them
    assert kept == sorted([(1, long_text(1)), (1, long_text(2)), (4, long_text(9)), (5, None), (5, ""), (6, ""), (7, " \t "),
                           (-3, long_text(4, change=0)), (9, "short"), (11, "naïve \U0001F600 " * 30)], key=str)
    assert sum(r["doc_id"] is None for r in rows) == 3
    assert all(r[name] == f"kept {name}" for r in rows for name in NAMES)


def test_stages_keep_columns_with_any_name(spark, hard):
    for stage in (secret_scan.redact_secrets, mixing.mixed_documents):
        out = stage(hard)
        assert out.columns == hard.columns
        assert all(r[name] == f"kept {name}" for r in out.collect() for name in NAMES)
        assert stage(hard.limit(0)).count() == 0
    trees = quality_model.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    out = quality_model.accepted(hard, trees, cutoff=0.0)
    assert out.columns == hard.columns and out.count() == hard.count()


def test_packing_numbers_copies_and_keeps_text(hard):
    rows = packing.pack(hard.unionAll(hard), keep=("source", "text")).collect()
    assert len(rows) == 2 * hard.count()
    assert len({(r["bucket"], r["batch"], r["slot"]) for r in rows}) == len(rows)
    copies = {}
    for r in rows:
        copies.setdefault((r["doc_id"], r["n_tokens"], r["text"] if r["doc_id"] is None else None), []).append(r["copy"])
    assert all(sorted(c) == list(range(1, len(c) + 1)) for c in copies.values())
    assert sorted(str((r["doc_id"], r["text"])) for r in rows) == sorted(str((r["doc_id"], r["text"])) for r in hard.collect() for _ in range(2))


def test_operators_take_missing_and_repeated_ids(spark, hard):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in [1, 1, 2, 3, 4, 9, 12]] + [(None, 1, 1), (5, None, None)],
                                   "doc_id long, quality int, toxic int")
    n = hard.count()
    assert pii.find(hard).count() == n and secret_scan.scan(hard).count() == n
    for model in (toxicity, quality_model):
        rows = model.score(hard, model.train(hard, labels)).collect()
        assert len(rows) == n and all(0 <= r["score"] <= 1 for r in rows)


def test_pipeline_carries_text_and_takes_hard_tables(spark, hard, tmp_path):
    labels = spark.createDataFrame([(i, 1, 0) for i in (1, 2, 3, 4, 8, 9, 11)], "doc_id long, quality int, toxic int")
    secret = "key: Zk39QpXw7LmT2vRb8NcYdF5hGj4S end " + long_text(30)
    more = hard.limit(1).withColumn("doc_id", F.lit(77).cast("long")).withColumn("text", F.lit(secret))
    for name, docs in (("hard", hard.unionAll(more)), ("empty", hard.limit(0))):
        path = str(tmp_path / name)
        docs.drop("a.b", "back`tick").write.parquet(f"{path}/documents.parquet")
        labels.write.parquet(f"{path}/labels.parquet")
        out = corpus_pipeline.run(spark, path)
        assert out.columns == ["doc_id", "n_tokens", "bucket", "bucket_length", "batch", "slot", "copy", "source", "text"]
        rows = out.collect()
        assert (name == "empty") == (not rows)
        assert len({(r["bucket"], r["batch"], r["slot"]) for r in rows}) == len(rows)
        assert all("Zk39QpXw7" not in (r["text"] or "") for r in rows)
        known = {r["source"] for r in docs.select("source").collect()}
        assert all(r["source"] in known and r["n_tokens"] == len(brute.words(r["text"])) for r in rows)
    given = corpus_pipeline.run(spark, SF).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert given and all(r["text"] == texts[r["doc_id"]] or "[SECRET]" in r["text"] for r in given)


# ---------------------------------------------------------------- the methods decide

def covered_text(n_words, run, repeats):
    """A long text in which ``repeats`` runs of ``run`` words are said twice, everything else once."""
    runs = [" ".join(f"run{k}word{i}" for i in range(run)) for k in range(repeats)]
    used = 2 * run * repeats
    fresh = iter(f"fresh{i:05d}x" for i in range(n_words))
    out = []
    for k in range(2):
        for r in runs:
            out.append(r)
            out.extend(next(fresh) for _ in range(max(1, (n_words - used) // (2 * repeats))))
    return " ".join(out)


def test_one_length_alone_can_fail_a_text(spark):
    """Runs of exactly 8 words: 9- and 10-grams see nothing, and 5- to 7-grams stay under their higher limits."""
    text = covered_text(4000, 8, 37)
    line = "one line that is said twice in a short but clean text of some words"
    short = f"{line}\n{long_text(3, 50)}\n{line}"
    often = "\n".join([*(f"line {i} of {i * i} words here" for i in range(200)), *["a repeated line of this text"] * 80])
    df = spark.createDataFrame([(1, text), (2, long_text(5, 4000)), (3, short), (4, often), (5, "$ # % " * 5 + long_text(6, 60))], "doc_id long, text string")
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(df).collect()}
    row = got[1]
    over = [n for n, most in quality_rules.MAX_SHARE.items() if row[f"dup_{n}gram_share"] * row["word_chars"] - quality_rules.GRACE_CHARS > most * row["word_chars"]]
    assert over == [8] and row["coverage_failed"] and not row["base_failed"] and not row["kept"]
    assert got[2]["kept"]
    assert got[3]["kept"] and got[3]["dup_10gram_share"] > 0.2           # a short text may say one sentence twice
    assert not got[4]["kept"] and got[4]["coverage_failed"]
    assert got[5]["kept"]                                                # symbols decide nothing


WORDS = """index about contact article news report annual budget council meeting harbour market history travel guide winter summer recipe
    kitchen garden review product category search result login account profile setting language english french german download image
    gallery video player archive template version final draft message commit update release build test module package internal external
    library source address customer order invoice payment number value total count group street house price quarter year month week day
    section chapter introduction machine learning model data table column row string object request response handler manager factory
    service client server config user parse json html xml http url uuid hash key next previous first last left right top bottom""".split()
PROBES = ["org/articles/2023/10/some-long-title-here", "commit_message_template_version_2_final_draft",
          "Chapter1/Section2/Introduction-to-Machine-Learning", "the-quick-brown-fox-jumps-over-13-lazy-dogs",
          "fr/planete/article/2023/10/05/climat-les-temperatures-record-de-septembre_6192571_3244", "getElementById2ForUser3Name",
          "x86_64-linux-gnu-gcc-12-base", "internationalization18nHelper", "123e4567-e89b-12d3-a456-426614174000"]


def ordinary(rng):
    """A URL path, slug, file name or identifier made of words, numbers, dates and versions."""
    def w():
        return rng.choice(WORDS)

    def n(digits=4):
        return str(rng.randrange(10 ** rng.randrange(1, digits)))

    year, month, day = str(rng.randrange(1990, 2030)), f"{rng.randrange(1, 13):02d}", f"{rng.randrange(1, 29):02d}"
    kinds = [lambda: f"org/{w()}s/{year}/{month}/{w()}-{w()}-{w()}-{w()}", lambda: f"{w()}_{w()}_{w()}_{w()}_{n()}_{w()}",
             lambda: f"{w().title()}{n(2)}/{w().title()}{n(2)}/{w().title()}-{w()}-{w().title()}",
             lambda: f"the-{w()}-{w()}-{w()}-{n(3)}-{w()}-{w()}", lambda: w() + w().title() + n(3) + w().title() + w().title() + w().title(),
             lambda: f"{w()}/{w()}/{year}/{month}/{day}/{w()}-{w()}_{n(8)}_{n(5)}", lambda: f"{w()}-{n(2)}-{n(2)}-{n(2)}-{w()}-{n(3)}-rc-{n(2)}",
             lambda: f"{w().upper()}_{w().upper()}_{w().upper()}_V{n(2)}_{year}", lambda: f"{w()}_{year}{month}{day}T{n(3)}1200Z_{w()}",
             lambda: f"{w()}_source={w()}_{w()}{year}", lambda: f"{w()[:3].upper()}{n(6)}-{w()[:2].upper()}{n(3)}-{year}-X{n(3)}-{n(5)}"]
    return rng.choice(kinds)()


def found(spark, strings):
    """Characters of each string inside added or base spans, as a share."""
    df = spark.createDataFrame([(i, f"see {s} there") for i, s in enumerate(strings)], "doc_id long, text string")
    out = {}
    for r in secret_scan.scan(df).collect():
        inside = set()
        for span in filter(None, r["spans"].split(",")):
            _, start, stop = span.split(":")
            inside.update(range(int(start), int(stop)))
        out[r["doc_id"]] = len(inside) / len(strings[r["doc_id"]])
    return [out[i] for i in range(len(strings))]


def test_ordinary_strings_are_left_alone(spark):
    rng = random.Random(11)
    strings = list(PROBES)
    while len(strings) < 400:
        s = ordinary(rng)
        if re.search(r"[A-Za-z0-9+/_=-]{20}", s):
            strings.append(s)
    flagged = [s for s, share in zip(strings, found(spark, strings)) if share]
    assert len(flagged) <= 0.01 * len(strings) and not set(flagged) & set(PROBES), flagged


@pytest.mark.parametrize("alphabet", [string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/",
                                      string.ascii_letters + string.digits + "-_", string.ascii_lowercase + string.digits,
                                      string.ascii_uppercase + string.digits, "0123456789abcdef", "0123456789ABCDEF"])
def test_random_keys_are_found(spark, alphabet):
    rng = random.Random(12)
    keys = ["".join(rng.choice(alphabet) for _ in range(rng.choice([24, 32, 40, 64]))) for _ in range(200)]
    assert sum(share >= 0.8 for share in found(spark, keys)) >= 0.95 * len(keys)


def test_keys_behind_names_and_paths(spark):
    rows = [(1, "latest_key=Zk39QpXw7LmT2vRb8NcYdF5hGj4S"), (2, "https://x.org/contest/9fQzWk3LmT2vRb8NcYdF5hGj4S?a=1"),
            (3, "wJalrXUtnFEMI/K7MDENG/bPxRfiCYzEkQ9p1"), (4, "uuid 123e4567-e89b-12d3-a456-426614174000")]
    got = {r["doc_id"]: r["text"] for r in secret_scan.redact_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "latest_key=[SECRET]", 2: "https://x.org/contest/[SECRET]?a=1", 3: "[SECRET]", 4: rows[3][1]}


# ---------------------------------------------------------------- loose personal data against labels

def loose_corpus(seed, n):
    """Texts with one loose form each, true or look-alike; 30 percent of either lack the words in front that
    tell them apart. As many texts hold a strict form. Returns rows and (kind, true) by id."""
    rng = random.Random(seed)

    def d(k):
        return "".join(rng.choice("0123456789") for _ in range(k))

    def pick(*of):
        return rng.choice(of)

    def prose():
        return " ".join(pick("the", "house", "stood", "by", "water", "and", "many", "people", "came", "there") for _ in range(rng.randrange(4, 10)))

    kinds = [("email", True, lambda: f"{pick('joe', 'anna', 'max.b', 'info')} [at] {pick('example', 'mailbox', 'posta')} [dot] {pick('com', 'org', 'de', 'fr')}",
              ("write to ", "contact ", "mail me: ")),
             ("email", False, lambda: f"x{d(1)} (at) {pick('noon', 'page', 'line')}.{pick('then', 'we', 'next')}", ("meet ", "seen ")),
             ("phone", True, lambda: f"({rng.randrange(201, 990)}) {rng.randrange(201, 990)}-{d(4)}", ("call ", "phone ", "my cell: ")),
             ("phone", False, lambda: f"{d(3)}.{d(3)}.{d(4)}", ("version ", "section ", "isbn ")),
             ("ssn", True, lambda: f"{rng.randrange(101, 660)}-{rng.randrange(10, 99)}-{rng.randrange(1000, 9999)}", ("ssn ", "social security number ")),
             ("ssn", False, lambda: f"{pick('000', '666', '9' + d(2), d(3))}-{pick('00', d(2))}-{pick('0000', d(4))}", ("order ", "page ", "id ")),
             ("iban", True, lambda: f"DE{d(2)} {d(4)} {d(4)} {d(4)} {d(4)} {d(2)}", ("IBAN ", "my bank account ", "konto ")),
             ("iban", False, lambda: f"{pick('XK', 'QZ', 'ZZ', 'AB')}{d(2)} {d(4)} {d(4)} {d(4)}", ("release ", "order "))]
    rows, truth = [], {}
    for i in range(n):
        kind, true, form, words = rng.choice(kinds)
        rows.append((i, f"{prose()} {rng.choice(words) if rng.random() < 0.7 else ''}{form()} {prose()}"))
        truth[i] = (kind, true)
    strict = (" mail joe@example.com ", " call +1 415 555 2671 ", " card 4111 1111 1111 1111 ", " host 10.0.0.1 ")
    rows += [(n + i, prose() + rng.choice(strict) + prose()) for i in range(n)]
    return rows, truth


@pytest.mark.parametrize("seed, n", [(1, 400), (2, 120)])
def test_loose_forms_recall_and_precision(spark, seed, n):
    rows, truth = loose_corpus(seed, n)
    got = {r["doc_id"]: r["spans"] for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    least = {"email": (0.95, 0.95), "phone": (0.95, 0.7), "ssn": (0.95, 0.8), "iban": (0.95, 0.95)}
    for kind, (recall, precision) in least.items():
        true = [i for i, (k, t) in truth.items() if k == kind and t]
        hits = [i for i, (k, _) in truth.items() if k == kind and kind in got[i]]
        assert len(set(true) & set(hits)) >= recall * len(true), kind
        assert len(set(true) & set(hits)) >= precision * len(hits), kind


def test_reliabilities_are_estimated_per_kind():
    """Context tells for kind 0 and is noise for kind 1: its estimated weight differs."""
    patterns = [(0, (1, 1, 1, 1, 1), 40), (0, (-1, -1, -1, -1, 1), 40), (0, (1, 1, 1, 0, 1), 5),
                (1, (1, 1, 1, 1, 1), 20), (1, (1, 1, -1, 1, 1), 20), (1, (-1, -1, 1, -1, 1), 20), (1, (-1, -1, -1, -1, 1), 20)]
    posts, tables = pii.reliabilities(patterns)
    def telling(kind):
        yes, no = tables[kind]["context"][1]
        return yes / no
    assert telling(0) > 5 > telling(1) and posts[0] > 0.9 > 0.1 > posts[1]
