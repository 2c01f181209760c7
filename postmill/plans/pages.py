"""Queries on pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.functions import text as T
from postmill.functions.lexicon import LOGIN_MARKERS, QUOTE_MARKERS, SERVICE_MARKERS, WAF_MARKERS, fixture_lexicon
from postmill.operators import links, policy
from postmill.plans.common import sql_any, sql_collapse, sql_entities, sql_hits, sql_plain, sql_text, table

COMPANY = "Example Post"
LEX = fixture_lexicon()
TOPICS = list(LEX.categories)
LIMITS = [("example.com", 30), ("m.example.com", 10), ("example.net", 20), ("example.org", 40)]
DEFAULT_RPM = 60


def pages_plain_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.strip_html(F.col("html")).alias("plain_text"))


def pages_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.title(F.col("html"), F.lit(COMPANY)).alias("title"))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.page_features(table(spark, sf_dir, "pages"), COMPANY, TOPICS, LEX)


def pages_policy_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(spark, sf_dir).select(
        "page_id", "policy_signals", "noise_hits", F.array_join("policy_categories", ",").alias("categories"), F.coalesce("filter_reason", F.lit("keep")).alias("filter_reason")
    )


def pages_reason_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages_policy_gate(spark, sf_dir).groupBy("filter_reason").agg(F.count("*").alias("n"))


def pages_category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features(spark, sf_dir).select(F.explode("policy_categories").alias("category"))
    return rows.groupBy("category").agg(F.count("*").alias("n"))


def pages_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.page_links(table(spark, sf_dir, "pages"))


def pages_links_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.first_links(pages_links(spark, sf_dir))


def pages_domain_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").groupBy(links.host(F.col("url")).alias("host")).agg(F.count("*").alias("n"))


def pages_canonical_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", links.canonical_url(F.col("url")).alias("canonical_url"))


def pages_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    limits = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(d).alias("domain"), F.lit(n).alias("rpm")) for d, n in LIMITS])).alias("x")).select("x.*")
    return links.rate_limits(table(spark, sf_dir, "pages").select("page_id", "url"), limits, DEFAULT_RPM).select("page_id", "host", "rpm")


TITLE_SQL = "coalesce(nullif(" + sql_collapse(sql_entities("regexp_extract(html, '<title[^>]*>(.*?)</title>', 1, 'is')")) + ", ''), " + sql_text(COMPANY) + ")"
HOST_SQL = r"regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), ':\d*$', '')"


def _feature_sql() -> str:
    cases = ", ".join(f"CASE WHEN {sql_any('seen', words)} THEN {sql_text(t)} END" for t, words in LEX.categories.items())
    return f"""
    WITH base AS (SELECT page_id, url, {sql_plain('html')} AS plain_text, {TITLE_SQL} AS title FROM pages),
    parts AS (SELECT *, list_filter(list_transform(regexp_split_to_array(plain_text, '[。！？.!?]'), lambda p: trim(p)), lambda p: length(p) >= 12)[1:3] AS s FROM base),
    summed AS (SELECT *, CASE WHEN len(s) > 0 THEN substr(array_to_string(s, '。'), 1, 300) ELSE substr(plain_text, 1, 300) END AS summary, title || ' ' || plain_text AS seen FROM parts),
    cats AS (SELECT *, list_filter([{cases}], lambda c: c IS NOT NULL) AS cats, {sql_hits('seen', LEX.signals)} AS policy_signals,
        {sql_hits("title || ' ' || summary", LEX.noise)} AS noise_hits, {sql_any('title', LEX.hard_titles)} AS hard,
        title || ' ' || substr(plain_text, 1, 2500) AS early FROM summed),
    f AS (SELECT *, len(list_filter(cats, lambda c: c <> {sql_text(LEX.generic)})) > 0 AS meaningful,
        length(rtrim(url, '/')) - length(replace(rtrim(url, '/'), '/', '')) <= 2 AS shallow FROM cats),
    gate AS (SELECT *, CASE
        WHEN {sql_any('early', WAF_MARKERS)} THEN '{policy.WAF}'
        WHEN contains(lower(url), 'login') OR {sql_hits('early', LOGIN_MARKERS)} >= 4 THEN '{policy.LOGIN}'
        WHEN contains(lower(url), 'toquoteindex') OR {sql_hits('early', QUOTE_MARKERS)} >= 4 THEN '{policy.QUOTE}'
        WHEN {sql_hits('early', SERVICE_MARKERS)} >= 6 THEN '{policy.SERVICE}'
        WHEN length(plain_text) < 120 AND policy_signals < 4 AND NOT hard AND NOT meaningful THEN '{policy.SHORT}'
        WHEN shallow AND (contains(title, '首页') OR contains(title, 'Home') OR noise_hits >= 4) AND NOT hard THEN '{policy.HOME}'
        WHEN noise_hits >= 3 AND NOT hard THEN '{policy.NOISE}'
        WHEN {sql_hits("substr(plain_text, 1, 1500) || ' ' || summary", LEX.menu)} >= 6 AND NOT hard THEN '{policy.NAVIGATION}'
        WHEN len(cats) = 0 AND policy_signals < 4 AND NOT hard THEN '{policy.NO_SIGNAL}'
        WHEN len(cats) = 1 AND cats[1] = {sql_text(LEX.generic)} AND NOT hard AND policy_signals < 4 THEN '{policy.GENERIC_ONLY}'
        WHEN NOT meaningful AND NOT hard AND {sql_hits('plain_text', LEX.insurance)} < 2 AND policy_signals < 5 THEN '{policy.NO_SIGNAL}'
        ELSE 'keep' END AS filter_reason FROM f)
    """


LINK_SQL = r"""<a[^>]*href\s*=\s*["'']([^"''#]+)["''][^>]*>(.*?)</a>"""
LINKS_SQL = f"""
    WITH found AS (SELECT page_id, url AS base, unnest(regexp_extract_all(html, '{LINK_SQL}', 1, 'is')) AS href,
        unnest(regexp_extract_all(html, '{LINK_SQL}', 2, 'is')) AS inner_html, unnest(range(len(regexp_extract_all(html, '{LINK_SQL}', 1, 'is')))) AS pos FROM pages),
    links AS (SELECT page_id, pos::INT AS pos, lower(regexp_extract(base, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)) || href AS url,
        {sql_collapse("regexp_replace(inner_html, '<[^>]+>', ' ', 'g')")} AS anchor FROM found WHERE NOT regexp_matches(href, '^(javascript|mailto|tel):'))
"""
CANONICAL_SQL = r"""
    WITH p AS (SELECT page_id, regexp_replace(url, '#.*$', '') AS u FROM pages),
    q AS (SELECT *, lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)) AS origin, regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)', 1) AS path, regexp_extract(u, '\?(.*)$', 1) AS query FROM p)
    SELECT page_id, origin || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN query = '' THEN '' ELSE '?' || array_to_string(list_sort(string_split(query, '&')), '&') END AS canonical_url FROM q
"""
RATE_SQL = f"""
    WITH h AS (SELECT page_id, {HOST_SQL} AS host FROM pages),
    l(domain, rpm) AS (VALUES {', '.join(f"('{d}', {n})" for d, n in LIMITS)}),
    m AS (SELECT page_id, host, rpm, row_number() OVER (PARTITION BY page_id ORDER BY length(domain) DESC NULLS LAST) AS n FROM h LEFT JOIN l ON host = domain OR host LIKE '%.' || domain)
    SELECT page_id, host, coalesce(rpm, {DEFAULT_RPM})::INT AS rpm FROM m WHERE n = 1
"""
QUERIES = {f.__name__: f for f in (pages_plain_text, pages_title, pages_policy_gate, pages_reason_counts, pages_category_counts, pages_links, pages_links_first, pages_domain_counts, pages_canonical_url, pages_rate_limit)}
ORACLE = {
    "pages_plain_text": f"SELECT page_id, {sql_plain('html')} AS plain_text FROM pages",
    "pages_title": f"SELECT page_id, {TITLE_SQL} AS title FROM pages",
    "pages_policy_gate": _feature_sql() + "SELECT page_id, policy_signals, noise_hits, array_to_string(cats, ',') AS categories, filter_reason FROM gate",
    "pages_reason_counts": _feature_sql() + "SELECT filter_reason, count(*) AS n FROM gate GROUP BY 1",
    "pages_category_counts": _feature_sql() + "SELECT category, count(*) AS n FROM (SELECT unnest(cats) AS category FROM gate) GROUP BY 1",
    "pages_links": LINKS_SQL + "SELECT page_id, pos, url, anchor FROM links",
    "pages_links_first": LINKS_SQL + "SELECT page_id, pos, url, anchor FROM (SELECT *, row_number() OVER (PARTITION BY page_id, url ORDER BY pos) AS n FROM links) WHERE n = 1",
    "pages_domain_counts": f"SELECT {HOST_SQL} AS host, count(*) AS n FROM pages GROUP BY 1",
    "pages_canonical_url": CANONICAL_SQL,
    "pages_rate_limit": RATE_SQL,
}
