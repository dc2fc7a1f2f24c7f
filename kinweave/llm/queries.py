"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinweave.llm import toxicity

    docs = _docs(spark, sf_dir)
    return toxicity.score(docs, toxicity.fit(docs, _labels(spark, sf_dir)))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinweave.llm import exact_dedup

    return exact_dedup.dedup(_docs(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinweave.llm import language_id

    docs = _docs(spark, sf_dir)
    return language_id.identify(docs, language_id.fit(docs))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from kinweave.llm import token_counts

    return token_counts.token_counts(_docs(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinweave.llm import quality_rules

    return quality_rules.judge(_docs(spark, sf_dir)).drop("clean_text")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinweave.llm import quality_classifier as q

    # A document is from the page with its number, where there is one (many hosts have a few documents only, most paths
    # one); else its source is its host, the language section of it the path.
    docs, (host, path) = _docs(spark, sf_dir), q.site_of(F.col("url"), 2)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").groupBy(F.col("page_id").alias("doc_id")).agg(F.min("url").alias("url"))
    return q.classify(docs, q.fit(docs, _labels(spark, sf_dir)), F.col("source"), F.col("lang"), pages.where("doc_id is not null").select("doc_id", host.alias("host"), path.alias("path")))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinweave.llm import mixing

    return mixing.plan(_docs(spark, sf_dir))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinweave.llm import simhash

    return simhash.dedup(_docs(spark, sf_dir)).select("doc_id", simhash.hex_of(F.col("fp")).alias("fingerprint"), "component_id")


def op9_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinweave.llm import passage_dedup

    return passage_dedup.repeated_passages(_docs(spark, sf_dir))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from kinweave.llm import sentencepiece_bpe

    return sentencepiece_bpe.encode(_docs(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_exact_dedup, op3_language_id, op4_token_counts, op5_quality_rules, op6_quality_classifier, op7_mixing, op8_simhash, op9_passage_dedup, op10_sentencepiece, pipeline)}

ORACLES: dict[str, str] = {
    "op2_exact_dedup": r"""
        WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256 FROM documents),
        w AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM w""",
    "op5_quality_rules": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        w AS (SELECT doc_id, t, list_filter(string_split_regex(t, '[ \t-\r]+'), lambda x: x <> '') AS w,
                     list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) AS lines FROM d),
        g AS (SELECT *, list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS g FROM w),
        p AS (SELECT doc_id, unnest(g) AS k, generate_subscripts(g, 1) AS i FROM g),
        r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM p) WHERE c > 1),
        c AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM r) GROUP BY doc_id),
        e AS (SELECT doc_id, t, w, lines, list_filter(lines, lambda x: NOT (
                  len(regexp_extract_all(x, '[|»›•·]')) > 0.2 * len(regexp_extract_all(x, '[^ \t-\r]+'))
               OR len(regexp_extract_all(x, '[#*$%&|<>]')) > 0.3 * len(regexp_extract_all(x, '[^ \t-\r]+'))
               OR len(regexp_extract_all(x, '!!')) > 0.3 * len(regexp_extract_all(x, '[^ \t-\r]+'))
               OR (len(regexp_extract_all(x, '[^ \t-\r]+')) >= 20 AND NOT regexp_matches(x, '[.!?…。！？।؟:;,]'))
               OR (len(regexp_extract_all(x, '[^ \t-\r]+')) <= 12 AND regexp_matches(x, '(?i)(all rights reserved|cookie policy|privacy policy|terms of (service|use)|subscribe to our|sign up (now|for)|click here|enable javascript|follow us on|share this|read more|skip to content|back to top|powered by)')))) AS good FROM w),
        f AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
                     len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, len(lines) - len(good) AS n_removed_lines,
                     length(regexp_replace(array_to_string(good, ''), '[ \t-\r]+', '', 'g')) AS kept_chars FROM e LEFT JOIN c USING (doc_id)),
        b AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM f)
        SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
               CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, (NOT base_failed AND NOT (word_chars - kept_chars > 0.5 * word_chars)) AS kept,
               CAST(n_removed_lines AS BIGINT) AS n_removed_lines, CAST(kept_chars AS BIGINT) AS kept_chars FROM b""",
    "op7_mixing": r"""
        WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract(coalesce(source, ''), '([0-9]{1,9})$', 1) AS num,
                          CAST(ceil(strlen(coalesce(text, '')) / 4) AS BIGINT) AS n_tokens FROM documents),
        s AS (SELECT doc_id, CASE WHEN num = '' THEN 'other' ELSE 'domain' || (CAST(num AS BIGINT) % 4) END AS domain, lang, source, n_tokens FROM d),
        leaves AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM s GROUP BY ALL),
        n1 AS (SELECT domain, CAST(2 * sum(tokens) AS BIGINT) AS cap, CAST(CASE domain WHEN 'domain0' THEN 4 WHEN 'domain1' THEN 3 WHEN 'domain2' THEN 2 ELSE 1 END AS BIGINT) AS w,
                      (SELECT CAST(sum(tokens) AS BIGINT) * 3 // 5 FROM leaves) AS budget FROM leaves GROUP BY domain),
        b1 AS (SELECT *, CASE WHEN turn IS NULL THEN cap ELSE least(cap, (budget - turn.past) * w // turn.left_w) END AS own FROM (
            SELECT *, first_value(CASE WHEN (budget - past) * w <= cap * left_w THEN {'past': past, 'left_w': left_w} END IGNORE NULLS) OVER ( ORDER BY cap / w, domain ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS turn FROM (
            SELECT *, CAST(coalesce(sum(cap) OVER ( ORDER BY cap / w, domain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS past,
                   CAST(sum(w) OVER ( ORDER BY cap / w, domain ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS left_w FROM n1))),
        n2 AS (SELECT l.domain, lang, CAST(2 * sum(tokens) AS BIGINT) AS cap, CAST(CASE lang WHEN 'en' THEN 6 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 WHEN 'es' THEN 2 ELSE 1 END AS BIGINT) AS w, any_value(b1.own) AS budget
               FROM leaves l JOIN b1 USING (domain) GROUP BY l.domain, lang),
        b2 AS (SELECT *, CASE WHEN turn IS NULL THEN cap ELSE least(cap, (budget - turn.past) * w // turn.left_w) END AS own FROM (
            SELECT *, first_value(CASE WHEN (budget - past) * w <= cap * left_w THEN {'past': past, 'left_w': left_w} END IGNORE NULLS) OVER (PARTITION BY domain ORDER BY cap / w, lang ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS turn FROM (
            SELECT *, CAST(coalesce(sum(cap) OVER (PARTITION BY domain ORDER BY cap / w, lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS past,
                   CAST(sum(w) OVER (PARTITION BY domain ORDER BY cap / w, lang ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS left_w FROM n2))),
        n3 AS (SELECT l.*, CAST(2 * tokens AS BIGINT) AS cap, CAST(1 AS BIGINT) AS w, b2.own AS budget FROM leaves l JOIN b2 USING (domain, lang)),
        b3 AS (SELECT domain, lang, source, tokens, own AS leaf_budget, CASE WHEN tokens > 0 THEN own // tokens ELSE 1 END AS full_epochs FROM (SELECT *, CASE WHEN turn IS NULL THEN cap ELSE least(cap, (budget - turn.past) * w // turn.left_w) END AS own FROM (
            SELECT *, first_value(CASE WHEN (budget - past) * w <= cap * left_w THEN {'past': past, 'left_w': left_w} END IGNORE NULLS) OVER (PARTITION BY domain, lang ORDER BY cap / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS turn FROM (
            SELECT *, CAST(coalesce(sum(cap) OVER (PARTITION BY domain, lang ORDER BY cap / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS past,
                   CAST(sum(w) OVER (PARTITION BY domain, lang ORDER BY cap / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS left_w FROM n3)))),
        r AS (SELECT s.*, leaf_budget, full_epochs, CASE WHEN tokens > 0 THEN leaf_budget - full_epochs * tokens ELSE 0 END AS rest, md5('42|' || full_epochs || '|' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS k
              FROM s JOIN b3 USING (domain, lang, source)),
        c AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY k, n_tokens) AS upto FROM r)
        SELECT doc_id, domain, lang, source, n_tokens, leaf_budget, CAST(CASE WHEN full_epochs >= 2 OR rest = 0 OR upto > rest THEN full_epochs ELSE full_epochs + 1 END AS BIGINT) AS copies FROM c""",
}
