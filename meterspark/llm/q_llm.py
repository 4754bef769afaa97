"""Registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    decontaminate,
    importance,
    language,
    lexical,
    ngram_join,
    packing,
    quality,
    quality_rules,
    secret_scan,
    sharding,
    suffix_dedup,
    token_store,
    toxicity,
)
from .common import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return deco


_STOP = ", ".join(f"'{w}'" for w in quality_rules.STOP_WORDS)


@query("op7_quality_rules", f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
a AS (SELECT doc_id, t,
        list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
win AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM a)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, sum(least(3, coalesce(n - i, 3))) AS r
        FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS n FROM dup) GROUP BY doc_id),
m AS (SELECT a.doc_id, len(w)::BIGINT AS n_words,
        length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
        (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
        coalesce(rep.r, 0)::BIGINT AS n_repeat_words,
        length(regexp_replace(t, '[^!]', '', 'g')) AS ex,
        len(list_filter(w, lambda x: lower(x) IN ({_STOP}))) AS st, len(l) AS nl,
        len(list_filter(l, lambda x: regexp_matches(x, '^[\\x20\\x09]*[-*•]'))) AS bu,
        len(list_filter(l, lambda x: regexp_matches(x, '(\\.\\.\\.|…)[\\x20\\x09-\\x0D]*$'))) AS el
      FROM a LEFT JOIN rep ON rep.doc_id = a.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars BETWEEN 2 * n_words AND 20 * n_words AND n_symbols <= 0.1 * n_words
  AND ex <= 0.5 * n_words AND st >= 0.02 * n_words AND n_dup_lines <= 0.5 * nl AND bu <= 0.9 * nl AND el <= 0.3 * nl AS kept
FROM (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
""")
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op9_sharding")
def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_documents(documents(spark, sf_dir), 16)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("place").alias("slot"),
                      F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


@query("op1_ngram_jaccard_join")
def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link_components(documents(spark, sf_dir), 80, 5)


@query("op2_benchmark_decontamination")
def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_matches(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@query("op3_quality_classifier")
def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality.score_documents(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


@query("op10_toxicity")
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op4_best_fit_packing")
def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"), 2, 1024)


@query("op5_suffix_dedup")
def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(documents(spark, sf_dir), 100)


@query("op6_token_files")
def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.read(spark, token_store.write(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"), end_id=2))


@query("op8_secret_scans")
def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digests(secret_scan.scan(documents(spark, sf_dir)))


@query("op11_language_id")
def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return language.identify(docs, language.fit(docs))


_LOWER_TEXT = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("op12_importance_resampling", f"""
WITH RECURSIVE step(i, x, k) AS (
  SELECT i, i, 0 FROM (SELECT unnest(range(256)) AS i)
  UNION ALL
  SELECT i, CASE WHEN (x & 1) = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, k + 1 FROM step WHERE k < 8),
tbl AS (SELECT list(x ORDER BY i) AS t FROM step WHERE k = 8),
dw AS (SELECT doc_id, regexp_extract_all({_LOWER_TEXT}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
d AS (SELECT doc_id, unnest(w) AS w FROM dw),
b AS (SELECT unnest(regexp_extract_all({_LOWER_TEXT}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
vocab AS (SELECT DISTINCT w FROM (SELECT w FROM d UNION ALL SELECT w FROM b)),
hexed AS (SELECT w, hex(encode(w)) AS h FROM vocab),
coded AS (SELECT w, list_transform(range(length(h) // 2), lambda j: ('0x' || substr(h, 2 * j + 1, 2))::BIGINT) AS bytes FROM hexed),
bucketed AS (SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes),
               lambda a, c: xor(a >> 8, t[(xor(a, c) & 255) + 1])), 4294967295) % 10000 AS bucket FROM coded, tbl),
corpus AS (SELECT bucket, count(*) AS s FROM d JOIN bucketed USING (w) GROUP BY bucket),
target AS (SELECT bucket, count(*) AS t FROM b JOIN bucketed USING (w) GROUP BY bucket),
total AS (SELECT (SELECT coalesce(sum(s), 0) FROM corpus)::DOUBLE AS s_all, (SELECT coalesce(sum(t), 0) FROM target)::DOUBLE AS t_all),
gain AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * (s_all + 10000) / ((s + 1.0::DOUBLE) * (t_all + 10000))))::BIGINT AS g
         FROM corpus LEFT JOIN target USING (bucket), total),
gains AS (SELECT doc_id, floor(sum(g)::DOUBLE / count(*))::BIGINT AS m FROM d JOIN bucketed USING (w) JOIN gain USING (bucket) GROUP BY doc_id),
scored AS (SELECT dw.doc_id, len(w)::BIGINT AS n_features, coalesce(m, 0)::BIGINT AS weight,
    (coalesce(m, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || dw.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE))))::BIGINT AS score
  FROM dw LEFT JOIN gains USING (doc_id)),
able AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= 10 * (SELECT count(*) FROM able) // 100 THEN r END AS rank
FROM scored LEFT JOIN able USING (doc_id)""")
def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@query("op13_ranked_lexical_search", f"""
WITH dw AS (SELECT doc_id, regexp_extract_all({_LOWER_TEXT}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
total AS (SELECT count(*) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM dw WHERE len(w) > 0),
tf AS (SELECT doc_id, w, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS w FROM dw) GROUP BY ALL),
df AS (SELECT w, count(*) AS df FROM tf GROUP BY w),
it AS (SELECT item_id, unnest(regexp_extract_all({_LOWER_TEXT}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS w FROM benchmark),
q AS (SELECT item_id, w, count(*) AS times, floor(1000 * ln((2.0::DOUBLE * n_docs + 2) / (2 * df + 1)))::BIGINT AS weight
      FROM it JOIN df USING (w), total GROUP BY ALL),
scored AS (SELECT item_id, doc_id, sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * len(dw.w) * n_docs) // n_terms))))::BIGINT AS score
           FROM q JOIN tf USING (w) JOIN dw USING (doc_id), total GROUP BY item_id, doc_id),
best AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM best WHERE rank <= 10""")
def op13_ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
