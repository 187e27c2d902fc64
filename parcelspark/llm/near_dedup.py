"""Near-duplicate detection: banded MinHash candidates, sequential Bayesian verification, exact check.

Plan:

1. One Arrow pass makes each text's shingle set, its 128-bit fingerprint and a MinHash signature.
   Texts with equal sets form one class with a number of its own; all further work is on classes, so
   groups of copies cost one row, and rows that share an id but not the text stay apart.
2. Signatures are cut into bands; rows of equal band form buckets. Bucket minima are partial
   aggregates. Only buckets with two or more members go on.
3. Star round: every member is compared with the smallest member of each of its buckets. Signature
   batches are compared one after the other; a pair is dropped as soon as the posterior probability
   that its similarity reaches the threshold (uniform prior) falls under ``MISS``. The best
   surviving edge of every member is checked on the full sets; the links make first components.
4. Cross round: only buckets that still hold more than one component are compared, and only across
   components. A bucket is cut into chunks; chunk pairs are tasks of bounded size, and a pair is
   taken in the first band it shares. Members of the bucket's largest component are never compared
   with each other, so a large group of linked copies costs its strays only. Survivors of the same
   sequential test are checked on the full sets, by block.
5. Components of all links; the smallest id of each component, joined back to every document.

No bucket, candidate list or group is capped, and no pair rows are emitted for a group.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from parcelspark.llm import textkit as tk
from parcelspark.llm.graph import connected_components
from parcelspark.llm.store import arrow_rows, stored

BANDS, ROWS = 32, 5            # miss of a pair at similarity 0.8 in the banding: (1 - 0.8**5)**32 < 3e-6
N_HASHES = BANDS * ROWS
BATCH = 32                     # hashes compared before each posterior test
MISS = 1e-5                    # a pair is pruned when P(similarity >= threshold | matches) is below this
CHUNK = 512                    # rows of one side of a block in the cross round

_A = (tk.constants(21, N_HASHES) >> tk.U64(32)).astype(np.uint32) | np.uint32(1)
_B = (tk.constants(22, N_HASHES) >> tk.U64(32)).astype(np.uint32)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash signatures (low 16 bits of each minimum) of non-empty sets, one row each."""
    sizes = np.fromiter((len(s) for s in sets), dtype=np.int64, count=len(sets))
    x = (np.concatenate(sets) >> tk.U64(32)).astype(np.uint32)
    offsets = np.cumsum(sizes) - sizes
    out = np.empty((len(sets), N_HASHES), dtype=np.uint16)
    hashed = np.empty_like(x)
    for k in range(N_HASHES):
        np.multiply(x, _A[k], out=hashed)
        np.add(hashed, _B[k], out=hashed)
        out[:, k] = np.minimum.reduceat(hashed, offsets) & np.uint32(0xFFFF)
    return out


def band_keys(sigs: np.ndarray) -> np.ndarray:
    """64-bit bucket key of every band (rows x BANDS); the band number is part of the key."""
    grouped = sigs.reshape(len(sigs), BANDS, ROWS).astype(tk.U64)
    mixed = (tk.mix64(grouped + tk.U64(1)) * (tk.constants(23, ROWS) | tk.U64(1))).sum(axis=2, dtype=tk.U64)
    return tk.mix64(mixed + tk.constants(24, BANDS))


def min_matches(threshold: float, miss: float = MISS) -> list[int]:
    """Fewest matches after each batch that keep a pair.

    With a uniform prior and m matches of n, the similarity is Beta(m + 1, n - m + 1), so
    P(similarity >= t) = P(Binomial(n + 1, t) <= m).
    """
    kept = []
    for n in range(BATCH, N_HASHES + 1, BATCH):
        total, m = 0.0, 0
        while m <= n:
            total += math.comb(n + 1, m) * threshold ** m * (1 - threshold) ** (n + 1 - m)
            if total >= miss:
                break
            m += 1
        kept.append(m)
    return kept


def surviving(left: np.ndarray, right: np.ndarray, needed: list[int]) -> np.ndarray:
    """Indices of rows whose signatures pass every batch test (row-wise comparison)."""
    alive = np.arange(len(left))
    matches = np.zeros(len(left), dtype=np.int32)
    for k, need in enumerate(needed):
        cut = slice(k * BATCH, (k + 1) * BATCH)
        matches = matches + (left[alive, cut] == right[alive, cut]).sum(axis=1)
        keep = matches >= need
        alive, matches = alive[keep], matches[keep]
    return alive


def _matrix(column: pa.Array) -> np.ndarray:
    """Signature matrix of a fixed-width binary column."""
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, dtype=np.uint16).reshape(len(column), N_HASHES)


def _longs(values: np.ndarray) -> pa.Array:
    return pa.array(values.astype(np.uint64).view(np.int64), pa.int64())


def _sums(sets: list[np.ndarray]) -> np.ndarray:
    """Two independent 64-bit sums over each set (2 x sets); equal sets have equal sums."""
    n = np.array([len(s) for s in sets], dtype=np.int64)
    full = np.flatnonzero(n)
    sums = np.zeros((2, len(sets)), dtype=tk.U64)
    if len(full):
        joined, offsets = np.concatenate([sets[i] for i in full]), np.cumsum(n[full]) - n[full]
        sums[0, full] = np.add.reduceat(tk.mix64(joined + tk.U64(101)), offsets)
        sums[1, full] = np.add.reduceat(tk.mix64(joined ^ tk.U64(0x5DEECE66D1234567)), offsets)
    return sums


def _sign(shingle: int, keep: list[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = tk.arrow_bytes(batch.column("text"))
            for lo, hi in tk.byte_batches(texts):
                sets = shingle_sets(texts[lo:hi], shingle)
                n = np.array([len(s) for s in sets], dtype=np.int64)
                full = np.flatnonzero(n)
                sig: list[bytes | None] = [None] * len(sets)
                if len(full):
                    for i, row in zip(full, signatures([sets[i] for i in full])):
                        sig[i] = row.tobytes()
                sums = _sums(sets)
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c).slice(lo, hi - lo) for c in keep], pa.array(n), _longs(sums[0]), _longs(sums[1]),
                     pa.array(sig, pa.binary())], names=[*keep, "n", "s1", "s2", "sig"])
    return run


def shingle_sets(texts: list[bytes], shingle: int) -> list[np.ndarray]:
    tokens = tk.tokenize(texts)
    words = tk.RangeHash(tokens.buf, folded=True)(tokens.start, tokens.end)
    return [tk.shingle_set(words[a:b], shingle) for a, b in zip(tokens.first[:-1], tokens.first[1:])]


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows == 0:
            continue
        keys = band_keys(_matrix(batch.column("sig")))
        nodes = np.repeat(batch.column("doc_id").to_numpy(zero_copy_only=False), BANDS)
        yield pa.RecordBatch.from_arrays([_longs(keys.reshape(-1)), pa.array(nodes, pa.int64())],
                                         names=["bucket", "node"])


def _bayes_pairs(needed: list[int]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            left, right = _matrix(batch.column("sig_a")), _matrix(batch.column("sig_b"))
            alive = surviving(left, right, needed)
            matches = (left[alive] == right[alive]).sum(axis=1).astype(np.int64)
            take = pa.array(alive)
            yield pa.RecordBatch.from_arrays([batch.column("a").take(take), batch.column("b").take(take),
                                              pa.array(matches)], names=["a", "b", "matches"])
    return run


def _linked(inter: np.ndarray, na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    return 100 * inter >= percent * (na + nb - inter)


def _exact_pairs(percent: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist())):
                x, y = np.frombuffer(x, dtype=tk.U64), np.frombuffer(y, dtype=tk.U64)
                inter = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * inter >= percent * (len(x) + len(y) - inter):
                    keep.append(i)
            take = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("a").take(take), batch.column("b").take(take)],
                                             names=["a", "b"])
    return run


def _sets(shingle: int) -> Callable:
    """Shingle sets of texts, each with the class it is wanted for; a text of another class (a row that
    shares the id only) gives nothing."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = tk.arrow_bytes(batch.column("text"))
            wanted = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64).view(tk.U64) for c in ("s1", "s2")])
            for lo, hi in tk.byte_batches(texts):
                sets = shingle_sets(texts[lo:hi], shingle)
                own = np.flatnonzero((_sums(sets) == wanted[:, lo:hi]).all(axis=0))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("node").slice(lo, hi - lo).take(pa.array(own)), pa.array([sets[i].tobytes() for i in own], pa.binary())],
                    names=["node", "shingles"])
    return run


def _blocks(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[dict[str, list]]:
    """Rows of one (bucket, i, j) block at a time, from batches sorted by these; a block may span
    batches. Blocks hold at most two chunks, so what is kept back is bounded."""
    held: dict[str, list] = {}
    for batch in batches:
        if batch.num_rows == 0:
            continue
        cols = {name: batch.column(name).to_pylist() for name in names}
        keys = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in ("bucket", "i", "j")])
        cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        bounds = [0, *cuts.tolist(), batch.num_rows]
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            part = {name: col[lo:hi] for name, col in cols.items()}
            if held and all(held[k][0] == part[k][0] for k in ("bucket", "i", "j")):
                held = {name: held[name] + part[name] for name in names}
            else:
                if held:
                    yield held
                held = part
    if held:
        yield held


def _cross_bayes(needed: list[int], percent: int) -> Callable:
    """Per block: pairs of different components, similar sizes, not met in an earlier band, that
    pass the sequential test. One row per block: its surviving nodes and their pairs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for block in _blocks(batches, ["bucket", "i", "j", "chunk", "node", "component", "n", "sig"]):
            sig = np.frombuffer(b"".join(block["sig"]), dtype=np.uint16).reshape(-1, N_HASHES)
            node, comp, n, chunk = (np.array(block[k]) for k in ("node", "component", "n", "chunk"))
            i, j = block["i"][0], block["j"][0]
            rows = np.flatnonzero(chunk == i)
            cols = rows if i == j else np.flatnonzero(chunk == j)
            keys = band_keys(sig)
            band = int(np.flatnonzero(keys[0] == np.uint64(block["bucket"][0] & 0xFFFFFFFFFFFFFFFF))[0])
            left, right = [], []
            for r in rows:
                c = cols[cols > r] if i == j else cols
                c = c[(comp[c] != comp[r]) & (node[c] != node[r])]
                c = c[(100 * np.minimum(n[c], n[r]) >= percent * np.maximum(n[c], n[r]))]
                if band and len(c):
                    c = c[~(keys[c, :band] == keys[r, :band]).any(axis=1)]
                if len(c):
                    c = c[surviving(np.broadcast_to(sig[r], (len(c), N_HASHES)), sig[c], needed)]
                left.append(np.full(len(c), r))
                right.append(c)
            left_rows = np.concatenate(left) if left else np.empty(0, dtype=np.int64)
            if not len(left_rows):
                continue
            right_rows = np.concatenate(right)
            used = np.unique(np.concatenate([left_rows, right_rows]))
            pairs = np.stack([node[left_rows], node[right_rows]], axis=1).astype(np.int64)
            out.append((block["bucket"][0], i, j, node[used].tolist(), pairs.tobytes()))
            if len(out) >= 64:
                yield _block_rows(out)
                out = []
        yield _block_rows(out)
    return run


def _block_rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[]] * 5
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)],
                                      names=["bucket", "i", "j", "nodes", "pairs"])


def _cross_exact(percent: int) -> Callable:
    """Per block: exact intersection sizes of its surviving pairs, from the full sets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, ["bucket", "i", "j", "node", "shingles", "pairs"]):
            pairs = np.frombuffer(next(p for p in block["pairs"] if p is not None), dtype=np.int64).reshape(-1, 2)
            order = np.argsort(block["node"], kind="stable")
            node = np.array(block["node"])[order]
            sets = [np.frombuffer(block["shingles"][k], dtype=tk.U64) for k in order]
            at = np.searchsorted(node, pairs)
            inter = intersections(sets, at[:, 0], at[:, 1])
            size = np.array([len(s) for s in sets], dtype=np.int64)
            keep = _linked(inter, size[at[:, 0]], size[at[:, 1]], percent)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[keep, 0]), pa.array(pairs[keep, 1])], names=["a", "b"])
    return run


def intersections(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, slab: int = 4096) -> np.ndarray:
    """Sizes of sets[left] & sets[right]: a 0/1 incidence matrix of the shared shingles, multiplied
    in column slabs of bounded width."""
    if len(left) * 8 < len(sets) ** 2 or len(sets) < 8:
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                         for a, b in zip(left, right)], dtype=np.int64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, word, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.flatnonzero(count > 1)
    rank = np.full(len(count), -1)
    rank[shared] = np.arange(len(shared))
    word = rank[word]
    owner, word = owner[word >= 0], word[word >= 0]
    by_word = np.argsort(word, kind="stable")
    owner, word = owner[by_word], word[by_word]
    total = np.zeros((len(sets), len(sets)), dtype=np.float32)
    for lo in range(0, len(shared), slab):
        a, b = np.searchsorted(word, [lo, lo + slab])
        incidence = np.zeros((len(sets), slab), dtype=np.float32)
        incidence[owner[a:b], word[a:b] - lo] = 1
        total += incidence @ incidence.T
    return total[left, right].astype(np.int64)


def _grouped(docs: DataFrame, shingle: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Rows of ``docs(doc_id, text, ...)`` with ``n, s1, s2`` instead of their text, and one row per class:
    ``n, s1, s2, node, first`` (its smallest id), ``group`` (its component), ``component_id``."""
    arrow_rows(docs.sparkSession)
    needed = min_matches(percent / 100)
    keep = [c for c in docs.columns if c != "text"]
    kinds = ", ".join([*[f"{c} {dict(docs.dtypes)[c]}" for c in keep], "n long, s1 long, s2 long, sig binary"])
    signed = stored(docs.mapInArrow(_sign(shingle, keep), kinds), "signed")
    full = signed.where("n > 0 AND doc_id IS NOT NULL")
    # numbered as they are written, so the numbers stay the same for every later read
    classes = stored(full.groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("first"), F.max("sig").alias("sig"))
                     .withColumn("node", F.monotonically_increasing_id()), "classes")
    reps = classes.select(F.col("node").alias("doc_id"), "n", "sig")

    bands = reps.select("doc_id", "sig").mapInArrow(_bands, "bucket long, node long")
    # per-bucket results are stored before they are joined back: a join of two plain exchanges can be split
    # where one bucket holds very many rows
    buckets = stored(bands.groupBy("bucket").agg(F.min("node").alias("rep"), F.count("*").alias("members"))
                     .where("members > 1").select("bucket", "rep"), "minima")
    multi = stored(bands.join(buckets, "bucket"), "buckets")

    # full sets of every class that shares a bucket, from the text of its smallest id
    wanted = multi.select("node").distinct().join(classes.select("node", F.col("first").alias("doc_id"), "s1", "s2"), "node")
    wanted = stored(wanted, "wanted")
    # repeated rows become one where the join has put them together; the sets, larger than the texts, are not moved.
    # The grouping needs the rows dealt by id at every size, so the join deals them, also where one side is small.
    texts = (docs.select("doc_id", "text", F.xxhash64("text").alias("digest64")).join(wanted.hint("merge"), "doc_id")
             .groupBy("doc_id", "node", "s1", "s2", "digest64").agg(F.first("text").alias("text")))
    sets = stored(texts.select("node", "s1", "s2", "text").mapInArrow(_sets(shingle), "node long, shingles binary"), "sets")

    # star round
    stars = multi.where("node <> rep").select(F.col("node").alias("b"), F.col("rep").alias("a")).distinct()
    sig = reps.select(F.col("doc_id").alias("node"), "n", "sig")
    paired = (stars.join(sig.toDF("a", "n_a", "sig_a"), "a").join(sig.toDF("b", "n_b", "sig_b"), "b")
              .where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")))
    likely = paired.select("a", "b", "sig_a", "sig_b").mapInArrow(_bayes_pairs(needed), "a long, b long, matches long")
    best = likely.groupBy("b").agg(F.min(F.struct((-F.col("matches")).alias("m"), F.col("a"))).alias("x")).select("b", "x.a")
    star_links = stored(exact_links(best, sets, percent), "links")

    # cross round
    label = connected_components(star_links)
    tagged = stored(multi.select("bucket", "node").join(label, "node", "left")
                    .select("bucket", "node", F.coalesce("component", "node").alias("component")), "tagged")
    per = tagged.groupBy("bucket", "component").agg(F.count("*").alias("c"))
    mixed = stored(per.groupBy("bucket").agg(F.count("*").alias("k"), F.max(F.struct("c", "component")).alias("top"),
                                             F.sum("c").alias("m"))
                   .where("k > 1").select("bucket", F.col("top.component").alias("big"), F.col("top.c").alias("dom"),
                                          (F.col("m") - F.col("top.c")).alias("rest")), "mixed")
    rows = tagged.join(mixed, "bucket").withColumn("main", F.col("component") == F.col("big"))
    n_rest = F.ceil(F.col("rest") / CHUNK).cast("int")
    n_main = F.ceil(F.col("dom") / CHUNK).cast("int")
    own = F.when(F.col("main"), n_rest + F.pmod(F.xxhash64("node"), n_main).cast("int")) \
        .otherwise(F.pmod(F.xxhash64("node"), n_rest).cast("int"))
    # strays meet every chunk, members of the largest component meet the strays' chunks only
    others = F.when(F.col("main"), F.sequence(F.lit(0), n_rest - 1)).otherwise(F.sequence(F.lit(0), n_rest + n_main - 1))
    spread = (rows.withColumn("chunk", own).withColumn("other", F.explode(others))
              .select("bucket", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"),
                      "chunk", "node", "component")
              .join(sig, "node"))
    block_schema = "bucket long, i int, j int, nodes array<long>, pairs binary"
    found = stored(spread.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
                   .select("bucket", "i", "j", "chunk", "node", "component", "n", "sig")
                   .mapInArrow(_cross_bayes(needed, percent), block_schema), "survivors")
    wanted = found.select("bucket", "i", "j", F.posexplode("nodes").alias("pos", "node"),
                          "pairs").select("bucket", "i", "j", "node",
                                          F.when(F.col("pos") == 0, F.col("pairs")).alias("pairs"))
    cross = (wanted.join(sets, "node").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
             .select("bucket", "i", "j", "node", "shingles", "pairs")
             .mapInArrow(_cross_exact(percent), "a long, b long"))

    component = connected_components(star_links.select("a", "b").union(cross))
    labelled = stored(classes.select("n", "s1", "s2", "node", "first").join(component, "node", "left")
                      .withColumn("group", F.coalesce("component", "node")).drop("component"), "labelled")
    lowest = stored(labelled.groupBy("group").agg(F.min("first").alias("component_id")), "lowest")
    return signed.drop("sig"), stored(labelled.join(lowest, "group"), "placed")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: ``doc_id, n_shingles, component_id, kept``.

    Texts are linked when 100 * |A & B| >= percent * |A | B| over their sets of distinct
    ``shingle``-word runs (A-Z folded; a shorter text is one shingle). Components are those of the
    link graph of texts: rows that share an id but not the text are linked by their texts only. Null,
    empty and wordless texts have no shingles and are components of their own. Rows with a null
    ``doc_id`` take part in no link and have a null component. Repeated rows and ties keep their
    smallest id. An empty table gives an empty result. Other columns are ignored.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed, classes = _grouped(slim, shingle, percent)
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return (signed.join(classes.select("n", "s1", "s2", "component_id"), ["n", "s1", "s2"], "left")
            .select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))


def exact_links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs ``(a, b)`` whose full sets meet the threshold."""
    both = (pairs.join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b")
            .select("a", "b", "set_a", "set_b"))
    return both.mapInArrow(_exact_pairs(percent), "a long, b long")


def deduplicated(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """Rows of ``docs`` that stay: of each component the row of smallest id (ties: smallest text digest), with
    all columns, whatever their names.

    Null, empty and wordless texts are linked with nothing; of rows with equal id and equal text one stays.
    Rows without an id all stay. An empty table gives an empty result.
    """
    row = F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in docs.columns]).alias("row")
    told = docs.select(row, F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    told = told.withColumn("digest", F.coalesce(F.md5(F.encode("text", "UTF-8")), F.lit("")))
    signed, classes = _grouped(told.select("doc_id", "digest", "text"), shingle, percent)
    named = signed.where("doc_id IS NOT NULL")
    linked = (named.join(classes.select("n", "s1", "s2", "group"), ["n", "s1", "s2"])
              .groupBy("group").agg(F.min(F.struct("doc_id", "digest")).alias("stay")).select("stay.*"))
    alone = named.where("n = 0").select("doc_id", "digest").distinct()
    stay = stored(linked.unionAll(alone), "stay")
    # equal ids and texts can differ in other columns: the pick among them is the same in every run
    picked = (told.join(stay, ["doc_id", "digest"]).groupBy("doc_id", "digest")
              .agg(F.min_by("row", F.xxhash64("row")).alias("row")))
    return picked.select("row.*").unionAll(told.where("doc_id IS NULL").select("row.*"))
