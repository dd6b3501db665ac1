"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import crf_lang, decontam, fst_tokens, hpylm, linespread, packing, sharding, simhash, urlfilter, vamana
from corpusloom.llm.common import table


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP1_SQL = r"""
WITH item_words AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, least(len(w), 13) AS k, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS gram
            FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM item_words WHERE len(w) > 0)),
doc_words AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
grams AS (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS gram
          FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM doc_words, (SELECT DISTINCT k FROM windows))),
hits AS (SELECT doc_id, i, k, item_id FROM grams JOIN windows USING (k, gram)),
hit_words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc_words LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hpylm.score_documents(table(spark, sf_dir, "documents"))


def op3_bestfit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fst_tokens.count_tokens(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


def op5_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crf_lang.identify(table(spark, sf_dir, "documents"))


def op8_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return vamana.nearest(vectors, vectors.filter("vec_id % 20 = 0"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return linespread.remove_boilerplate(docs).select("doc_id", "n_lines", "n_removed", F.col("text").alias("kept_text"))


OP9_SQL = """
WITH texts AS (SELECT text, min(coalesce(source, chr(0))) AS site FROM documents WHERE text IS NOT NULL GROUP BY text),
lines AS (SELECT site, translate(trim(l), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS line
          FROM (SELECT site, unnest(string_split(text, chr(10))) AS l FROM texts) WHERE trim(l) <> ''),
boiler AS (SELECT list(line) AS bad FROM (SELECT line FROM lines GROUP BY line HAVING count(DISTINCT site) >= 10)),
split AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
kept AS (SELECT doc_id, text, ls, list_filter(ls, lambda x: trim(x) = '' OR NOT coalesce(list_contains(bad,
         translate(trim(x), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')), false)) AS k FROM split, boiler)
SELECT doc_id, coalesce(len(ls), 0)::BIGINT AS n_lines, coalesce(len(ls) - len(k), 0)::BIGINT AS n_removed,
       CASE WHEN len(k) = len(ls) THEN text ELSE array_to_string(k, chr(10)) END AS kept_text FROM kept
"""


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(urlfilter.DEFAULT_RULES, "host string, path string, action string")
    return urlfilter.filter_urls(table(spark, sf_dir, "pages"), rules)


OP10_SQL = r"""
WITH rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(substr(r, length(regexp_extract(r, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM rest),
rules(h, p, a) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
fit AS (SELECT host, path, arg_max(h || p, length(h || p)) AS rule, arg_max(a, length(h || p)) AS a FROM (SELECT DISTINCT host, path FROM parts), rules
        WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY host, path)
SELECT page_id, parts.host, parts.path, rule, coalesce(a, 'allow') AS verdict FROM parts LEFT JOIN fit ON parts.host = fit.host AND parts.path = fit.path
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op1_benchmark_decontamination": OP1_SQL, "op9_line_dedup": OP9_SQL, "op10_url_filters": OP10_SQL}
