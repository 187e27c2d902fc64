"""Registered queries of the dealt operators: thin wrappers over the operators' own interfaces."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from parcelspark.llm import (chat_format, fingerprint, html_blocks, mixing, near_dedup, packing, pii, quality_model, quality_rules,
                             resampling, secret_scan, spelling, toxicity)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length buckets of least padding and token-budget batches over all documents."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op2_pii_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of all documents: strict patterns and spans accepted by weak supervision."""
    return pii.find(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of all documents after noisy-channel deobfuscation."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op4_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of all documents by gradient-boosted trees over their statistics."""
    docs = table(spark, sf_dir, "documents")
    return quality_model.score(docs, quality_model.train(docs, table(spark, sf_dir, "labels")))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents over 2-word shingles at similarity 0.8."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle=2, percent=80)


def op6_fair_queue_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words every document gives to a mix of all sources at weights 5, 2, 1."""
    return (mixing.mix(table(spark, sf_dir, "documents"))
            .select("doc_id", "size", "source_size", "target", "taken"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and their edited texts, with likeness."""
    return fingerprint.fingerprint_documents(table(spark, sf_dir, "documents"))


def op8_chat_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one (id -1) made of control strings, formatted and read back."""
    told = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                  F.lit("</s>[INST] ok [/INST]").alias("text"))
    return chat_format.read_back(chat_format.format_conversations(told.unionByName(probe)))


def op9_secret_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents: fixed patterns and sliding-window entropy."""
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op10_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repetition coverage and quality verdict of all documents."""
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with their near words, forms and roots."""
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def op12_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages by classified text blocks."""
    return html_blocks.extract(table(spark, sf_dir, "pages"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents drawn towards the word distribution of the benchmark texts."""
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_length_buckets": op1_length_buckets,
    "op2_pii_votes": op2_pii_votes,
    "op3_toxicity": op3_toxicity,
    "op4_quality_trees": op4_quality_trees,
    "op5_near_dedup": op5_near_dedup,
    "op6_fair_queue_mix": op6_fair_queue_mix,
    "op7_fingerprints": op7_fingerprints,
    "op8_chat_segments": op8_chat_segments,
    "op9_secret_entropy": op9_secret_entropy,
    "op10_repetition_rules": op10_repetition_rules,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_html_blocks": op12_html_blocks,
    "op13_importance_resampling": op13_importance_resampling,
}
WORDS_SQL = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

MIX_SQL = f"""
WITH d AS (SELECT doc_id, source, {WORDS_SQL} AS size, md5(coalesce(CAST(doc_id AS VARCHAR), 'text ' || coalesce(text, ''))) AS h FROM documents),
s AS (SELECT source, sum(size) AS source_size FROM d GROUP BY source),
r AS (SELECT source, source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM s),
w AS (SELECT *, CAST([5, 2, 1][(rank - 1) % 3 + 1] AS DOUBLE) AS weight, CAST(3 * source_size AS DOUBLE) AS cap FROM r),
p AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE)
                 - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
          / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate FROM w),
t AS (SELECT source, rank, source_size,
             least(cap, coalesce(first_value(CASE WHEN rate * weight <= cap THEN rate END IGNORE NULLS)
                                 OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
                                 * weight, cap)) AS target FROM p),
q AS (SELECT d.doc_id, d.size, d.h, t.rank, t.source_size, t.target,
             sum(d.size) OVER (PARTITION BY t.rank ORDER BY d.h, d.doc_id, d.size
                               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CAST(epoch * source_size + upto AS DOUBLE) / target AS vft
      FROM q, (SELECT unnest([0, 1, 2]) AS epoch) WHERE size > 0 AND target > 0),
c AS (SELECT *, sum(size) OVER (ORDER BY vft, rank, epoch, h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM e),
k AS (SELECT doc_id, rank, sum(size) AS taken FROM c WHERE run <= (SELECT sum(size) FROM d) GROUP BY doc_id, rank)
SELECT q.doc_id, CAST(q.size AS BIGINT) AS size, CAST(q.source_size AS BIGINT) AS source_size, q.target,
       CAST(coalesce(k.taken, 0) AS BIGINT) AS taken
FROM q LEFT JOIN k ON q.doc_id = k.doc_id AND q.rank = k.rank
"""


LINK_SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
                                     ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS start, doc_id AS node FROM d UNION SELECT r.start, e.b FROM r JOIN e ON e.a = r.node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.node) AS component_id, d.doc_id = min(r.node) AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN r ON r.start = d.doc_id GROUP BY d.doc_id, n.n
"""

CHAT_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
f AS (
  SELECT *, length(text) + len(regexp_extract_all(text, '<\\*(<SYS>>|</SYS>>|s>|/s>)|\[\\*(INST\]|/INST\]|ROLE\]|/ROLE\]|/TURN\])'))
         + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7
                ELSE 20 + length(role) + len(regexp_extract_all(role, '<\\*(<SYS>>|</SYS>>|s>|/s>)|\[\\*(INST\]|/INST\]|ROLE\]|/ROLE\]|/TURN\])'))
           END AS chars,
         CASE role WHEN 'system' THEN 'S' WHEN 'user' THEN 'U' WHEN 'assistant' THEN 'A' ELSE 'X' END AS letter
  FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars,
       regexp_matches(string_agg(letter, '' ORDER BY turn, role, text), '^S?(UA)*U?$') AS valid
FROM f GROUP BY conv_id
"""


def _rules_sql() -> str:
    """Base counts, coverage shares and verdict of the repetition rules."""
    lengths = quality_rules.COVERAGE_NGRAMS
    last = max(lengths)
    leads = ", ".join(f"lead(w, {i}) OVER p AS w{i}" for i in range(1, last))

    def gram(n: int) -> str:
        return " || ' ' || ".join(["w", *[f"w{i}" for i in range(1, n)]])

    twice = ", ".join(f"w{n - 1} IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, {gram(n)}) > 1 AS d{n}" for n in (3, *lengths))
    inside = ", ".join(f"max(d{n}) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS c{n}"
                       for n in (3, *lengths))
    chars = ", ".join(f"coalesce(sum(length(w)) FILTER (WHERE c{n}), 0) AS k{n}" for n in lengths)
    shares = ", ".join(f"CAST(coalesce(k{n}, 0) AS DOUBLE) / greatest(coalesce(word_chars, 0), 1) AS dup_{n}gram_share" for n in lengths)
    limits = " OR ".join(f"coalesce(k{n}, 0) - 160 > {0.15 - 0.01 * (n - 5):.2f}::DOUBLE * coalesce(word_chars, 0)" for n in lengths)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w0 AS (SELECT doc_id, unnest(list_zip(ws, range(1, len(ws) + 1))) AS x
       FROM (SELECT doc_id, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws FROM d)),
w1 AS (SELECT doc_id, x[1] AS w, x[2] AS i FROM w0),
w2 AS (SELECT *, {leads} FROM w1 WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
w3 AS (SELECT doc_id, i, w, {twice} FROM w2),
w4 AS (SELECT doc_id, w, {inside} FROM w3),
w5 AS (SELECT doc_id, count(*) AS n_words, sum(length(w)) AS word_chars, count(*) FILTER (WHERE c3) AS n_repeat_words, {chars}
       FROM w4 GROUP BY doc_id),
l0 AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
l1 AS (SELECT doc_id, line, count(*) AS n FROM l0 WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id, line),
l2 AS (SELECT doc_id, sum(n - 1) AS n_dup_lines, sum(CASE WHEN n > 1 THEN n * length(line) ELSE 0 END) AS dup_chars FROM l1 GROUP BY doc_id),
r AS (SELECT d.doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars,
             CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
             CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
             {shares}, CAST(coalesce(dup_chars, 0) AS DOUBLE) / greatest(length(text), 1) AS dup_line_share,
             {limits} OR coalesce(dup_chars, 0) - 160 > 0.20::DOUBLE * length(text) AS coverage_failed
      FROM d LEFT JOIN w5 USING (doc_id) LEFT JOIN l2 USING (doc_id)),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM r)
SELECT *, NOT base_failed AND NOT coverage_failed AS kept FROM v
"""


def _crc_sql(text: str) -> str:
    """Unsigned crc32 of the UTF-8 bytes of a string expression; reads the table of ``_crc_table_sql``."""
    octets = f"list_transform(range(1, length(hex({text})), 2), lambda i: ('0x' || substr(hex({text}), i, 2))::BIGINT)"
    return (f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), "
            "lambda c, b: xor(c >> 8, crc_t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT)")


def _crc_table_sql() -> str:
    step = "i"
    for _ in range(8):
        step = f"list_transform([{step}], lambda x: xor(x >> 1, (x & 1) * 3988292384))[1]"
    return f"crc_table AS (SELECT list({step} ORDER BY i) AS crc_t FROM (SELECT unnest(range(256))::BIGINT AS i))"


FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

RESAMPLE_SQL = rf"""
WITH {_crc_table_sql()},
w AS (SELECT doc_id, regexp_extract_all({FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT unnest(regexp_extract_all({FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark),
f AS (SELECT doc_id, unnest(ws) AS word FROM w),
v AS (SELECT word, {_crc_sql("word")} % 10000 AS bucket FROM (SELECT word FROM f UNION SELECT word FROM b), crc_table),
s AS (SELECT bucket, count(*) AS n FROM f JOIN v USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM b JOIN v USING (word) GROUP BY bucket),
g AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM s) + 10000)::DOUBLE
                                         / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM t) + 10000)::DOUBLE)))
                          AS BIGINT) AS gain FROM s FULL JOIN t USING (bucket)),
d AS (SELECT f.doc_id, sum(gain) AS weight FROM f JOIN v USING (word) JOIN g USING (bucket) GROUP BY f.doc_id),
h AS (SELECT w.doc_id, len(ws) AS n_features, coalesce(weight, 0) AS weight,
             ('0x' || substr(sha256('2024:' || w.doc_id), 1, 8))::BIGINT AS h FROM w LEFT JOIN d ON d.doc_id = w.doc_id),
r AS (SELECT *, CAST(weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM h),
k AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM r WHERE n_features >= 20)
SELECT r.doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, score,
       CASE WHEN place <= (SELECT 10 * count(*) // 100 FROM k) THEN place END AS rank
FROM r LEFT JOIN k ON k.doc_id = r.doc_id
"""

SPELLING_SQL = rf"""
WITH RECURSIVE {_crc_table_sql()},
a AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc, unnest(regexp_extract_all({FOLDED}, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run
      FROM documents),
b AS (SELECT doc, run, count(*) AS n FROM a WHERE length(run) >= 7 GROUP BY doc, run),
c AS (SELECT run, n, {_crc_sql("doc || ':' || run")} AS h FROM b, crc_table),
e AS (SELECT n, CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM c),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM e WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
x AS (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM v)),
p AS (SELECT x.word, y.word AS near, y.n FROM x JOIN x y ON x.rest = y.rest AND x.i = y.i AND x.word <> y.word
      UNION SELECT x.word, v.word, v.n FROM x JOIN v ON v.word = x.rest
      UNION SELECT v.word, x.word, x.n FROM x JOIN v ON v.word = x.rest),
m AS (SELECT word, count(*) AS n_near, max(n) AS best_n, arg_min(near, (-n, near)) AS best FROM p GROUP BY word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 10 * v.n THEN best END AS form,
             CASE WHEN best_n >= 10 * v.n THEN best_n END AS form_n FROM v LEFT JOIN m ON m.word = v.word),
r AS (SELECT word, word AS reached, 0 AS step FROM f
      UNION ALL SELECT r.word, f.form, step + 1 FROM r JOIN f ON f.word = r.reached WHERE f.form IS NOT NULL),
z AS (SELECT word, arg_max(reached, step) AS root FROM r GROUP BY word)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN z ON z.word = f.word
"""

ORACLE: dict[str, str] = {
    "op5_near_dedup": LINK_SQL,
    "op6_fair_queue_mix": MIX_SQL,
    "op8_chat_segments": CHAT_SQL,
    "op10_repetition_rules": _rules_sql(),
    "op11_spelling_variants": SPELLING_SQL,
    "op13_importance_resampling": RESAMPLE_SQL,
}
