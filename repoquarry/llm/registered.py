"""One query for each operator, over its whole table, and SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repoquarry.llm import (
    html_text, lexical_search, line_dedup, mixing, permutation_index, pii, quality_rules, secrets,
    sentencepiece_codec, sharding, simhash, spelling, url_filter,
)
from repoquarry.llm.common import table

TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"
SHARDS = [f"shard-{i:03d}" for i in range(64)]

URL_RULES = [
    url_filter.host_rule("org", "/", "allow"),
    url_filter.host_rule("example.org", "/es/", "block"),
    url_filter.host_rule("example.org", "/en/1", "block"),
    url_filter.host_rule("com", "/fr/", "allow"),
    url_filter.host_rule("com", "/de/", "block"),
    url_filter.word_rule("cheap", "pills"),
    url_filter.word_rule("free", "casino"),
    url_filter.word_rule("casino"),
    url_filter.word_rule("porn"),
    url_filter.word_rule("xxx"),
]


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_words(table(spark, sf_dir, "documents"))


def op2_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return permutation_index.nearest(rows, F.col("vec_id") % 100 == 0)


def op3_dedup_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select(
        "doc_id", "text", F.col("_gone").alias("n_lines_removed")
    )


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = quality_rules.ledger(table(spark, sf_dir, "documents"))
    return entries.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        quality_rules.failed("base-1").alias("base_failed"),
        (~quality_rules.failed("prose-2")).alias("kept"),
        "fail_bits",
    )


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages"))


def op6_find_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op7_filter_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    judged = url_filter.judge_urls(pages, url_filter.rule_table(spark, URL_RULES))
    return judged.select(
        "page_id", "host", "path",
        F.when(F.col("_rank") == 1, F.col("rule")).alias("rule"),
        F.coalesce("verdict", F.lit("allow")).alias("verdict"),
    )


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode_texts(table(spark, sf_dir, "documents"), TOKENIZER)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"), width=3, distance=2)


def op10_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.place(docs, "doc_id", SHARDS, spread=("text",)).select(
        "doc_id", "slot", "shard"
    )


def op11_find_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return lexical_search.rank(docs, items)


QUERIES = {
    fn.__name__: fn
    for fn in (
        op1_mix_sources, op2_nearest_vectors, op3_dedup_lines, op4_quality_rules, op5_main_text,
        op6_find_secrets, op7_filter_urls, op8_sentencepiece, op9_simhash, op10_shards,
        op11_find_pii, op12_spelling_variants, op13_ranked_search,
    )
}

ORACLES = {
    "op13_ranked_search": r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
s AS (SELECT count(*) FILTER (WHERE len(t) > 0) AS big_n, sum(len(t)) AS big_l FROM d),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM d) GROUP BY r, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
w AS (SELECT term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM df, s),
dm AS (SELECT r, doc_id, 25 + (75 * len(t)::BIGINT * big_n) // big_l AS m FROM d, s),
i AS (
  SELECT item_id, term, count(*) AS c FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
  GROUP BY item_id, term),
sc AS (
  SELECT i.item_id, dm.doc_id, sum(i.c * w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * dm.m)))::BIGINT AS score
  FROM i JOIN w USING (term) JOIN tf USING (term) JOIN dm USING (r) GROUP BY i.item_id, dm.r, dm.doc_id),
o AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM sc WHERE score > 0)
SELECT item_id::BIGINT AS item_id, rank::INT AS rank, doc_id::BIGINT AS doc_id, score FROM o WHERE rank <= 10
""",
    "op4_quality_rules": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS w,
        generate_subscripts(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), 1) AS i FROM d),
t AS (SELECT r, i, w, lead(w) OVER s AS w2, lead(w, 2) OVER s AS w3 FROM w
      WINDOW s AS (PARTITION BY r ORDER BY i)),
c AS (SELECT r, i, w3 IS NOT NULL AND count(*) OVER (PARTITION BY r, w, w2, w3) > 1 AS often FROM t),
p AS (SELECT r, i, often OR coalesce(lag(often) OVER s, false) OR coalesce(lag(often, 2) OVER s, false) AS hit
      FROM c WINDOW s AS (PARTITION BY r ORDER BY i)),
n AS (SELECT r, count(*) AS n_words, count(*) FILTER (hit) AS n_repeat_words FROM p GROUP BY r),
l AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
m AS (SELECT r, count(*) AS n_lines, count(DISTINCT line) AS n_lines_once FROM l
      WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
x AS (
  SELECT doc_id, coalesce(n_words, 0) AS n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(n_lines - n_lines_once, 0) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
    length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper,
    length(regexp_replace(text, '[^0-9]', '', 'g')) AS n_digits
  FROM d LEFT JOIN n USING (r) LEFT JOIN m USING (r)),
b AS (SELECT *,
    (n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT
    + 4 * (10 * n_symbols > n_words)::INT + 8 * (10 * n_dup_lines > 4 * n_lines)::INT
    + 16 * (word_chars < 2 * n_words OR word_chars > 12 * n_words)::INT
    + 32 * (10 * n_upper > 5 * word_chars)::INT + 64 * (10 * n_digits > 5 * word_chars)::INT
    AS fail_bits FROM x)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  fail_bits % 4 > 0 AS base_failed, fail_bits = 0 AS kept, fail_bits::BIGINT AS fail_bits FROM b
""",
    "op7_filter_urls": r"""
WITH u AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r(h, p, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'),
  ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
j AS (
  SELECT page_id, host, path,
    (SELECT max({'n': length(h || p), 'rule': h || p, 'verdict': verdict}) FROM r
     WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS hit,
    regexp_matches('.' || host || path, '(?i)(^|[^a-z0-9])(cheap[^a-z0-9]+pills|casino|porn|xxx)([^a-z0-9]|$)') AS bad
  FROM u)
SELECT page_id, host, path, hit.rule AS rule,
  coalesce(hit.verdict, CASE WHEN bad THEN 'block' ELSE 'allow' END) AS verdict FROM j
""",
}
