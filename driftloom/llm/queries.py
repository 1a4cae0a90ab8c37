"""The queries of the text operators, with production parameters over whole tables, and SQL for those it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.llm import bpe, decontam, langid, outliers, quality, secrets, simhash, substr, toxicity, urls
from driftloom.llm.common import table_path

VOCABULARY = "word_bpe_49k.json"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.fp_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.reject_outliers(_read(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.decontaminate(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(_read(spark, sf_dir, "documents"), vocabulary_path()).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_read(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "template", "purity")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_languages(_read(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substr.remove_repeats(_read(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_read(spark, sf_dir, "documents")).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_quality_classifier, op2_simhash_near_dedup, op3_quality_rules, op4_decontamination, op5_bpe_round_trip, op6_url_filters, op7_language_id, op8_substring_dedup, op9_secret_scan, op10_toxicity, pipeline)
    return {f.__name__: f for f in found}


_OP4 = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, array_to_string(w[i:i + 9], ' ') AS p, least(10, len(w)) AS n
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM win),
places AS (
  SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n
), hits AS (
  SELECT a.doc_id, a.i, a.n, win.item_id FROM (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS p FROM places) a JOIN win ON win.p = a.p AND win.n = a.n
), hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS l FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_OP8 = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS p FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)
), least_doc AS (SELECT p, min(doc_id) AS m FROM win GROUP BY p HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS k FROM win JOIN least_doc USING (p) WHERE m < doc_id),
cut AS (SELECT doc_id, list(k) AS ks, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string(CASE WHEN n IS NULL THEN w ELSE list_filter(w, lambda x, k: NOT list_contains(ks, k)) END, ' '), '')) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)
"""


def _op6(depth: int = 12) -> str:
    """The template tree with a step of it for each of ``depth`` levels: as deep as the paths of the compared tables are."""
    lower = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    fits = lambda r: f"((host = '{r.partition('/')[0]}' OR ends_with(host, '.{r.partition('/')[0]}')) AND starts_with(path, '/{r.partition('/')[2]}'))"
    ranked = sorted(urls.RULES, key=lambda r: -len(r[1]))
    rule = "CASE " + " ".join(f"WHEN {fits(r)} THEN '{r}'" for _, r in ranked) + " END"
    said = "CASE " + " ".join(f"WHEN {fits(r)} THEN '{v}'" for v, r in ranked) + " END"
    s = urls.Settings()
    parts = [
        f"u AS (SELECT page_id, {lower.format(f"regexp_extract(coalesce(url, ''), '{pattern}', 1)")} AS host, regexp_extract(coalesce(url, ''), '{pattern}', 2) AS path FROM pages)",
        f"r AS (SELECT *, {rule} AS rule, {said} AS said FROM u)",
        "t0 AS (SELECT host, path, count(*) AS n, count(*) FILTER (WHERE said = 'block') AS bad, count(said) AS known, list_filter(string_split(path, '/'), lambda x: x <> '') AS seg, '' AS template FROM r GROUP BY host, path)",
    ]
    for k in range(depth):
        parts += [
            f"c{k} AS (SELECT host, template, seg[{k + 1}] AS s, sum(n) AS n, sum(bad) AS bad, sum(known) AS known FROM t{k} WHERE len(seg) > {k} GROUP BY ALL)",
            f"d{k} AS (SELECT *, count(*) OVER w AS kids, sum(n) OVER w AS all_n, sum(bad) OVER w AS all_bad, sum(known) OVER w AS all_known FROM c{k} WINDOW w AS (PARTITION BY host, template))",
            f"e{k} AS (SELECT host, template, s, CASE WHEN kids >= {s.least} AND kids >= {s.variety} * all_n THEN '*' WHEN known > 0 AND all_known > known AND abs(bad / known - (all_bad - bad) / (all_known - known)) <= {s.z} * sqrt(all_bad / all_known * (1 - all_bad / all_known) * (1 / known + 1 / (all_known - known))) THEN '+' ELSE s END AS step FROM d{k})",
            f"t{k + 1} AS (SELECT t.host, t.path, t.n, t.bad, t.known, t.seg, CASE WHEN len(seg) > {k} THEN t.template || '/' || e.step ELSE t.template END AS template FROM t{k} t LEFT JOIN e{k} e ON e.host = t.host AND e.template = t.template AND e.s = t.seg[{k + 1}] AND len(t.seg) > {k})",
        ]
    parts += [
        f"p AS (SELECT (sum(bad) + 1.0) / (sum(known) + 2.0) AS prior FROM t{depth})",
        f"o AS (SELECT host, template, sum(bad) AS bad, sum(known) AS known FROM t{depth} GROUP BY ALL)",
        f"v AS (SELECT template, (sum(bad) + {s.weight} * any_value(prior)) / (sum(known) + {s.weight}) AS wide FROM o, p GROUP BY template)",
        f"q AS (SELECT host, template, (bad + {s.weight} * wide) / (known + {s.weight}) AS purity FROM o JOIN v USING (template))",
    ]
    return f"WITH {', '.join(parts)} SELECT page_id, host, path, rule, coalesce(said, CASE WHEN purity >= {s.bar} THEN 'block' ELSE 'allow' END) AS verdict, template, purity FROM r JOIN t{depth} USING (host, path) JOIN q USING (host, template)"


def oracle_sql() -> dict[str, str]:
    return {"op4_decontamination": _OP4, "op6_url_filters": _op6(), "op8_substring_dedup": _OP8}
