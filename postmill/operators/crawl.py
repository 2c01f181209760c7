"""Crawling as DataFrame rounds, and replay of stored fetches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postmill.operators import dedup, links, policy
from postmill.functions.lexicon import Lexicon
from postmill.session import materialise


def seeds(sources: DataFrame) -> DataFrame:
    """The first tasks of sources (source_id, company, entry_urls, allowed_topics): one for each entry address, at depth 0."""
    rows = sources.select("source_id", "company", F.col("allowed_topics").alias("topic_hints"), F.posexplode("entry_urls").alias("pos", "url"))
    return rows.select("source_id", "company", "pos", "url", "topic_hints", F.lit(0).alias("depth"))


def with_source(log: DataFrame, sources: DataFrame) -> DataFrame:
    """Log rows with their source's company and topics in place of their own; rows of unknown sources are left out."""
    known = sources.select("source_id", "company", "allowed_topics").dropDuplicates(["source_id"])
    return log.drop("company", "allowed_topics").join(known, "source_id")


def crawl(sources: DataFrame, fetch: Callable[[DataFrame], DataFrame], depth: int = 2, budget: int = 20) -> DataFrame:
    """Pages reached from ``sources`` (source_id, url) in rounds of equal depth.

    ``fetch`` turns (source_id, url, depth) into the same with html; it is the
    adapter to the network. A round follows the links of the last one that
    look like policy pages on the source's host, less those seen before. A
    source's pages stop at ``budget``, counted in the order of depth and url.
    Each round is a table in the shared folder, so no page is fetched twice.
    """
    frontier = sources.select("source_id", links.canonical_url(F.col("url")).alias("url")).distinct().withColumn("depth", F.lit(0))
    homes = sources.select("source_id", links.host(F.col("url")).alias("home")).distinct()
    pages = None
    for level in range(depth + 1):
        if pages is not None:
            used = pages.groupBy("source_id").agg(F.count("*").alias("used"))
            frontier = frontier.join(used, "source_id", "left")
        else:
            frontier = frontier.withColumn("used", F.lit(0))
        order = Window.partitionBy("source_id").orderBy("url")
        frontier = frontier.withColumn("n", F.row_number().over(order)).where(F.col("n") + F.coalesce("used", F.lit(0)) <= budget).drop("n", "used")
        got = materialise(fetch(frontier), f"crawl-{level}")
        pages = got if pages is None else pages.unionByName(got)
        if level == depth:
            break
        found = links.page_links(got.withColumn("page", F.struct("source_id", "url")), "page")
        found = found.select("page.source_id", "url", "anchor").where(links.policy_like(F.col("url"), F.col("anchor")))
        found = found.join(homes, "source_id").where(links.host(F.col("url")) == F.col("home")).select("source_id", "url").distinct()
        frontier = found.join(pages.select("source_id", "url"), ["source_id", "url"], "left_anti").withColumn("depth", F.lit(level + 1))
    return pages


def kept_fetches(log: DataFrame, raw: DataFrame, allowed: list[str], lexicon: Lexicon) -> DataFrame:
    """Policy pages of a fetch log with their ``fingerprint``, repeats not yet dropped; ``log`` may be a stream.

    ``log`` has ord, source_id, company, url, success, text and raw_text_path,
    ``raw`` path and html. The raw text goes before the log's preview; only a
    success that is true counts.
    """
    rows = log.where("success").join(raw, log["raw_text_path"] == raw["path"], "left")
    pages = rows.select("ord", "source_id", "company", "url", F.coalesce("html", "text").alias("html"))
    kept = policy.page_features(pages, "", allowed, lexicon).where("filter_reason IS NULL")
    kept = kept.withColumn("title", F.coalesce(F.nullif("title", F.lit("")), "company"))
    return kept.withColumn("fingerprint", F.concat_ws("\x1f", "title", "summary"))


def parse_fetches(log: DataFrame, raw: DataFrame, allowed: list[str], lexicon: Lexicon) -> DataFrame:
    """Kept policy pages of a fetch log, as ``kept_fetches``, repeats dropped."""
    return dedup.keep_unseen(kept_fetches(log, raw, allowed, lexicon), "ord", "url", "fingerprint").drop("fingerprint")


def crawl_report(log: DataFrame, policies: DataFrame) -> DataFrame:
    """section, name and n of the crawl report: totals, companies, categories, failures."""
    totals = log.agg(F.count("*").alias("total"), F.count_if("success").alias("successes"), F.count_if(~F.coalesce("success", F.lit(False))).alias("failures"))
    out = totals.select(F.lit("totals").alias("section"), F.expr("stack(3, 'total', total, 'successes', successes, 'failures', failures) as (name, n)"))
    company = F.coalesce(F.nullif("company", F.lit("")), F.lit("未知来源"))
    out = out.union(policies.groupBy(company.alias("name")).agg(F.count("*").alias("n")).select(F.lit("companies"), "name", "n"))
    out = out.union(policies.select(F.explode("policy_categories").alias("name")).groupBy("name").agg(F.count("*").alias("n")).select(F.lit("categories"), "name", "n"))
    failed = log.where(F.coalesce("failure_reason", F.lit("")) != "")
    return out.union(failed.groupBy(F.col("failure_reason").alias("name")).agg(F.count("*").alias("n")).select(F.lit("failures"), "name", "n"))
