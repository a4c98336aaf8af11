"""The operators as registered queries, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from thermoline.llm import alignment, decontam, filter_audit, ngram_join, pii, quality_model, quality_rules, records, secrets, segment_sampling, sharding, url_filter, vector_join

Query = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_forest_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(_read(spark, sf_dir, "documents"))


def op2_glob_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_verdicts(_read(spark, sf_dir, "pages"))


def op3_gumbel_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment_sampling.sampled(_read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op4_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(_read(spark, sf_dir, "documents"))


def op5_ftrl_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.quality_scores(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op6_weak_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_spans(_read(spark, sf_dir, "documents"))


def op7_cgk_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op8_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_spans(_read(spark, sf_dir, "documents"))


def op9_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = (1.0, 1.5, 2.0, 1.25, 0.75)
    return sharding.sharded(_read(spark, sf_dir, "documents"), sharding.HashTree.sized(weights, 8), sharding.HashTree.sized(weights, 9))


def op10_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = records.write_records(_read(spark, sf_dir, "documents"), records.records_folder(spark), public_tokenizers.path("byte_bpe_50k.json"))
    return records.read_records(manifest)


def op11_word_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op12_block_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_join.nearest(_read(spark, sf_dir, "embeddings"))


def op13_interval_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.aligned(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_forest_join, op2_glob_automaton, op3_gumbel_segments, op4_repetition_rules, op5_ftrl_quality, op6_weak_labels, op7_cgk_decontamination, op8_secret_ownership, op9_hash_tree, op10_token_records, op11_word_audit, op12_block_join, op13_interval_alignment)}


_URL_SQL = """
WITH parts AS (
  SELECT page_id, coalesce(regexp_extract(url, '\\A.*?://([^/?#]*)', 1, 's'), '') AS raw,
         coalesce(regexp_extract(url, '\\A.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
named AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM parts),
ruled AS (
  SELECT *, CASE {rules} END AS rule FROM named)
SELECT page_id, host, path, rule,
       CASE {actions} WHEN {globs} THEN 'block' ELSE 'allow' END AS verdict FROM ruled
"""


def _url_sql() -> str:
    ranked = sorted(url_filter.RULES, key=lambda r: len(r.name), reverse=True)
    rules = " ".join(f"WHEN (host = '{r.host}' OR host LIKE '%.{r.host}') AND path LIKE '/{r.path}%' THEN '{r.name}'" for r in ranked)
    actions = " ".join(f"WHEN rule = '{r.name}' THEN '{r.action}'" for r in ranked)
    deep = lambda g: ".*".join("[^/]*".join(x.replace(".", "[.]") for x in part.split("*")) for part in g.split("**"))
    globs = " OR ".join(f"regexp_full_match(host || path, '{deep(g)}', 's')" for g in url_filter.BLOCK_GLOBS)
    return _URL_SQL.format(rules=rules, actions=actions, globs=globs)


def _rules_sql() -> str:
    ns = list(quality_rules.NGRAM_PERCENT)
    grams = " ".join(
        f""", seen{n} AS (SELECT row, a.i, row_number() OVER (PARTITION BY row, array_to_string(list_slice(words, a.i, a.i + {n - 1}), ' ') ORDER BY a.i) AS nth
             FROM twice a JOIN twice b USING (row) JOIN split USING (row) WHERE b.i = a.i + {n - 3}),
          cover{n} AS (SELECT row, sum(length(words[j])) AS chars FROM (
             SELECT DISTINCT row, unnest(range(i, i + {n})) AS j FROM seen{n} WHERE nth > 1) JOIN split USING (row) GROUP BY row)"""
        for n in ns
    )
    tops = " ".join(
        f""", top{n} AS (SELECT row, max(times * (length(gram) - {n - 1})) AS chars FROM (
             SELECT row, gram, count(*) AS times FROM (
               SELECT row, array_to_string(list_slice(words, i, i + {n - 1}), ' ') AS gram
               FROM (SELECT row, words, unnest(range(1, greatest(1, len(words) - {n - 2}))) AS i FROM split))
             GROUP BY row, gram HAVING count(*) > 1) GROUP BY row)"""
        for n in quality_rules.TOP_PERCENT
    )
    limits = " AND ".join(f"100 * dup{n}_chars <= {most} * word_chars" for n, most in quality_rules.NGRAM_PERCENT.items())
    limits += "".join(f" AND 100 * top{n}_chars <= {most} * word_chars" for n, most in quality_rules.TOP_PERCENT.items())
    return f"""
WITH split AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
lines AS (
  SELECT row, line, row_number() OVER (PARTITION BY row, line) AS nth FROM (SELECT row, unnest(string_split(text, chr(10))) AS line FROM split)
  WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
by_line AS (
  SELECT row, count(*) AS n_lines, sum(length(line)) AS line_chars, count(*) FILTER (nth > 1) AS n_dup_lines,
         coalesce(sum(length(line)) FILTER (nth > 1), 0) AS dup_line_chars FROM lines GROUP BY row),
three AS (
  SELECT row, i, count(*) OVER (PARTITION BY row, array_to_string(list_slice(words, i, i + 2), ' ')) AS n
  FROM (SELECT row, words, unnest(range(1, greatest(1, len(words) - 1))) AS i FROM split)),
twice AS (SELECT row, i FROM three WHERE n > 1),
repeated AS (
  SELECT row, count(*) AS n FROM (SELECT DISTINCT row, unnest(range(i, i + 3)) AS j FROM three WHERE n > 1) GROUP BY row)
{grams} {tops},
counts AS (
  SELECT s.doc_id, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda w: length(w))), 0)::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(repeated.n, 0)::BIGINT AS n_repeat_words,
         coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(line_chars, 0)::BIGINT AS line_chars, coalesce(dup_line_chars, 0)::BIGINT AS dup_line_chars,
         {", ".join(f"coalesce(top{n}.chars, 0)::BIGINT AS top{n}_chars" for n in quality_rules.TOP_PERCENT)},
         {", ".join(f"coalesce(cover{n}.chars, 0)::BIGINT AS dup{n}_chars" for n in ns)}
  FROM split s LEFT JOIN by_line USING (row) LEFT JOIN repeated USING (row) {" ".join(f"LEFT JOIN cover{n} USING (row)" for n in ns)} {" ".join(f"LEFT JOIN top{n} USING (row)" for n in quality_rules.TOP_PERCENT)}),
based AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts)
SELECT *, NOT base_failed AND 100 * dup_line_chars <= {quality_rules.LINE_CHAR_PERCENT} * line_chars
       AND 100 * n_dup_lines <= {quality_rules.LINE_PERCENT} * n_lines AND {limits} AS kept FROM based
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_glob_automaton": _url_sql(), "op4_repetition_rules": _rules_sql(), "op11_word_audit": filter_audit.oracle_sql(), "op12_block_join": vector_join.oracle_sql()}
