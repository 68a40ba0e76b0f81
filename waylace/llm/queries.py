"""The subpackage's queries, one for each operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from waylace.llm import bpe, exact_dedup, mixing, pii, quality, quality_rules, secrets, simhash, token_files, url_filter


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(_documents(spark, sf_dir), _labels(spark, sf_dir))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_documents(spark, sf_dir))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_documents(spark, sf_dir)).drop("copies")


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_positions(_documents(spark, sf_dir))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digests(_documents(spark, sf_dir))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_verdicts(_documents(spark, sf_dir), _labels(spark, sf_dir))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digests(_documents(spark, sf_dir))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_documents(spark, sf_dir))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_verdicts(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {name: fn for name, fn in globals().items() if name.startswith("op") and name[2].isdigit()}
    return dict(sorted(found.items(), key=lambda kv: int(kv[0][2:].split("_")[0])))


_LOW = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _node_sql(url: str) -> str:
    bare = f"regexp_replace({url}, '(?s)#.*$', '')"
    head = f"regexp_extract({bare}, '(?s)^(.*?://[^/?]*)', 1)"
    return f"CASE WHEN {head} <> '' THEN {_LOW.format(head)} || substr({bare}, length({head}) + 1) END"


def _rule_sql(host: str, path: str) -> str:
    fits = lambda h, p: f"({host} = '{h}' OR ends_with({host}, '.{h}')) AND starts_with({path}, '{p}')"
    return "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for _, h, p in sorted(url_filter.RULES, key=lambda r: -len(r[1] + r[2]))) + " END"


def _url_oracle() -> str:
    quote = lambda text: text.replace("'", "''")
    canonical = f"regexp_extract(regexp_extract(html, '{quote(url_filter._CANONICAL)}', 0), '{quote(url_filter._HREF)}', 1)"
    refresh = f"regexp_extract(regexp_extract(html, '{quote(url_filter._REFRESH)}', 0), '{quote(url_filter._URL)}', 1)"
    host = _LOW.format("coalesce(regexp_extract({0}, '://([^/?#]*)([^?#]*)', 1), '')")
    path = "coalesce(regexp_extract({0}, '://([^/?#]*)([^?#]*)', 2), '')"
    blocked = ", ".join(f"'{h}{p}'" for v, h, p in url_filter.RULES if v == "block")
    return f"""
        WITH RECURSIVE raw AS (SELECT url AS f, replace(t, '&amp;', '&') AS t FROM (SELECT url, {canonical} AS t FROM pages UNION ALL SELECT url, {refresh} FROM pages) WHERE t <> ''),
        parts AS (SELECT f, t, regexp_extract(f, '^([^:/?#]+)://', 1) AS scheme, regexp_extract(f, '^([^:/?#]+://[^/?#]*)', 1) AS site, regexp_extract(f, '^([^:/?#]+://[^/?#]*(?:[^?#]*/)?)', 1) AS folder FROM raw),
        whole AS (SELECT f, CASE WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN t WHEN starts_with(t, '//') THEN scheme || ':' || t WHEN starts_with(t, '/') THEN site || t
            WHEN ends_with(folder, '/') AND NOT ends_with(folder, '://') THEN folder || t ELSE site || '/' || t END AS t FROM parts),
        link AS (SELECT DISTINCT u, v FROM (SELECT {_node_sql("f")} AS u, {_node_sql("t")} AS v FROM whole) WHERE u IS NOT NULL AND v IS NOT NULL AND u <> v),
        ways AS (SELECT u, v FROM link UNION SELECT v, u FROM link),
        reach(n, m) AS (SELECT u, u FROM ways UNION SELECT n, v FROM reach JOIN ways ON u = m),
        judged AS (SELECT n, {_rule_sql(host.format("m"), path.format("m"))} AS rule FROM reach),
        carried AS (SELECT n, CASE WHEN count(*) FILTER (rule IS NOT NULL AND rule NOT IN ({blocked})) > 0 THEN 'allow' WHEN count(*) FILTER (rule IN ({blocked})) > 0 THEN 'block' END AS verdict FROM judged GROUP BY n),
        page AS (SELECT page_id, {host.format("url")} AS host, {path.format("url")} AS path, {_node_sql("url")} AS node FROM pages),
        ruled AS (SELECT *, {_rule_sql("host", "path")} AS rule FROM page)
        SELECT page_id, host, path, rule, CASE WHEN rule IN ({blocked}) THEN 'block' WHEN rule IS NOT NULL THEN 'allow' ELSE coalesce(verdict, 'allow') END AS verdict
        FROM ruled LEFT JOIN carried ON node = n
    """


def oracle_sql() -> dict[str, str]:
    return {
        "op3_exact_dedup": """
            WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
            SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
                   doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
            FROM d
        """,
        "op10_url_filter": _url_oracle(),
    }
