"""Registered queries of this subpackage: each applies an operator to its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import bpe, ctw, embeddings, licenses, merkle, mixing, negatives, patricia, pii, repeats, simhash, toxicity, urlrules
from .tables import table

# The rule list of the url query: longest fitting rule wins.
URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def op1_toxicity(spark, folder):
    return toxicity.judged(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op2_url_rules(spark, folder):
    """page_id, host, path, rule, verdict of every page."""
    return urlrules.judge(table(spark, folder, "pages").select("page_id", "url"), URL_RULES).select(
        F.col("row")["page_id"].alias("page_id"), "host", "path", "rule", "verdict")


def op3_repeated_bytes(spark, folder):
    return repeats.judged(table(spark, folder, "documents"))


def op4_simhash(spark, folder):
    return simhash.judged(table(spark, folder, "documents"))


def op5_licenses(spark, folder):
    return licenses.judged(table(spark, folder, "documents"))


def op6_embedding_dedup(spark, folder):
    return embeddings.judged(table(spark, folder, "embeddings"))


def op7_poisson_mix(spark, folder):
    """doc_id, source, n_copies' rows: every copy of every document, globally shuffled."""
    return mixing.mixed(table(spark, folder, "documents").select("doc_id", "text", "source")).select(
        F.col("row")["doc_id"].alias("doc_id"), F.col("row")["source"].alias("source"),
        F.col("copy").cast("bigint").alias("copy"), F.col("row")["text"].alias("text"))


def op8_context_tree(spark, folder):
    return ctw.judged(table(spark, folder, "documents"))


def op9_patricia_dedup(spark, folder):
    return patricia.judged(table(spark, folder, "documents"), keep="largest")


def op10_byte_bpe(spark, folder):
    return bpe.round_trip(table(spark, folder, "documents"))


def op11_hard_negatives(spark, folder):
    return negatives.judged(table(spark, folder, "embeddings"))


def op12_personal_data(spark, folder):
    return pii.judged(table(spark, folder, "documents"))


def op13_merkle_manifest(spark, folder):
    return merkle.judged(table(spark, folder, "documents"))


_PARTED = """
  SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages"""

ORACLES = {
    "op5_licenses": licenses.oracle_sql(),
    "op11_hard_negatives": negatives.oracle_sql(),
    "op13_merkle_manifest": merkle.oracle_sql(),
    "op2_url_rules": f"""
WITH parted AS ({_PARTED}),
hosted AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parted),
ruled AS (
  SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, CASE
    WHEN ('.' || host) LIKE '%.example.net' AND path LIKE '/en/%' THEN 'example.net/en/'
    WHEN ('.' || host) LIKE '%.example.com' AND path LIKE '/de/%' THEN 'example.com/de/'
    WHEN ('.' || host) LIKE '%.org' AND path LIKE '/fr/%' THEN 'org/fr/'
    WHEN ('.' || host) LIKE '%.net' AND path LIKE '/%' THEN 'net/' END AS rule
  FROM hosted)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM ruled""",
    "op7_poisson_mix": f"""
WITH mass AS (SELECT source, sum(length(coalesce(text, '')))::DOUBLE AS mass, pow(sum(length(coalesce(text, '')))::DOUBLE, {mixing.POWER}) AS weight FROM documents GROUP BY source),
rated AS (SELECT source, CASE WHEN mass > 0 THEN round(weight / sum(weight) OVER () * sum(mass) OVER () / mass, 9) ELSE 1.0 END AS rate FROM mass),
terms AS (SELECT source, k, CASE WHEN k = 0 THEN 0 ELSE ln(rate / k) END AS grown, rate FROM rated, range(0, 200) r(k) WHERE k <= ceil(rate + 12 * sqrt(rate) + 20)),
logs AS (SELECT source, k, -rate + sum(grown) OVER (PARTITION BY source ORDER BY k) AS log FROM terms),
steps AS (SELECT source, k, sum(exp(log)) OVER (PARTITION BY source ORDER BY k) AS upto FROM logs),
drawn AS (SELECT doc_id, source, text, ('0x' || substr(md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, '-') || ':' || md5(coalesce(text, ''))), 1, 13))::BIGINT / 4503599627370496.0 AS u FROM documents),
counted AS (SELECT doc_id, d.source, any_value(text) AS text, count(*) AS n FROM drawn d JOIN steps s ON d.source IS NOT DISTINCT FROM s.source AND s.upto <= d.u GROUP BY doc_id, d.source, u)
SELECT doc_id, source, text, unnest(range(1, n + 1)) AS copy FROM counted""",
    "op9_patricia_dedup": """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
}

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_url_rules": op2_url_rules,
    "op3_repeated_bytes": op3_repeated_bytes,
    "op4_simhash": op4_simhash,
    "op5_licenses": op5_licenses,
    "op6_embedding_dedup": op6_embedding_dedup,
    "op7_poisson_mix": op7_poisson_mix,
    "op8_context_tree": op8_context_tree,
    "op9_patricia_dedup": op9_patricia_dedup,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_personal_data": op12_personal_data,
    "op13_merkle_manifest": op13_merkle_manifest,
}
