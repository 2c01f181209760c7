"""Queries on vectors, evaluation records, events and the star schema."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postmill.operators import evaluation, retrieval
from postmill.plans.common import table
from postmill.streaming import streams

QUERY_STEP = 50
K = 5


def emb_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(retrieval.norm(F.col("embedding")), 4).alias("norm"))


def label_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query per label: the mean of its vectors."""
    rows = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    means = rows.groupBy("label", "i").agg(F.avg("x").alias("x"))
    grouped = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v"))
    return grouped.select(F.col("label").alias("query_id"), F.transform("v", lambda p: p["x"]).alias("embedding"))


def emb_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = retrieval.top_k(table(spark, sf_dir, "embeddings"), label_means(spark, sf_dir), K)
    return found.select("query_id", "rank", "vec_id", F.round("score", 3).alias("score"))


def emb_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row whose vec_id is divisible by ``QUERY_STEP`` against all rows."""
    rows = table(spark, sf_dir, "embeddings")
    asked = rows.where(F.col("vec_id") % QUERY_STEP == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    return retrieval.top_k(rows, asked, K).select("query_id", "rank", "vec_id", F.round("score", 3).alias("score"))


def emb_search_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search's hits with the documents of the same ids."""
    hits = emb_search(spark, sf_dir)
    return retrieval.with_documents(hits, table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id").select("query_id", "rank", "doc_id", "lang")


def emb_label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return rows.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(retrieval.norm(F.col("embedding"))), 3).alias("avg_norm"))


# Evaluation runs, monitors and ranks that are derived from the events.
TASKS = ["format", "postal", "safety", "math", "logic"]
RUNS_SQL = f"""(
    SELECT 'r' || user_id % 60 AS run, ['{"', '".join(TASKS)}'][1 + event_id % 5] AS task, count(*) % 8 AS "count",
        CASE WHEN event_id % 5 = 0 THEN sum(event_id) % 101 / 100 END AS json_valid_rate, CASE WHEN event_id % 5 = 0 THEN sum(event_id) % 97 / 96 END AS json_required_keys_rate,
        CASE WHEN event_id % 5 > 0 THEN count(*) % 7 / 2 END AS avg_postal_term_hits, CASE WHEN event_id % 5 > 0 THEN count(*) % 5 / 2 END AS avg_next_step_hits,
        sum(event_id) % 89 / 88 AS risk_rate, CASE WHEN event_id % 5 > 2 THEN max(event_id) % 11 / 10 END AS postal_pollution_rate
    FROM events GROUP BY user_id % 60, event_id % 5)"""
STEPS_SQL = "(SELECT 'r' || user_id % 12 AS run, event_id // 100 * 100 AS step, 'f' || (1 + event_id % 2) AS file, event_id AS line, value AS score, event_id % 7 = 0 AS gated FROM events)"
RANKS_SQL = "(SELECT 'm' || user_id % 5 AS model, (user_id % 4)::INT AS rank, max(value) AS best_score, count(*) % 10 / 10 AS score_drop, count(*) % 3 / 2 AS json_keys, max(event_id) % 2 / 1 AS safety_risk FROM events GROUP BY user_id % 5, user_id % 4)"


def named(letter: str, n: int) -> Column:
    return F.concat(F.lit(letter), (F.col("user_id") % n).cast("string"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Task metrics of sixty runs; counts from 0 to 7, rates from 0 to 1, metrics that a task lacks null."""
    which = F.col("k")
    events = table(spark, sf_dir, "events").withColumn("k", F.col("event_id") % 5)
    share = lambda n: F.sum("event_id") % n / (n - 1)
    rows = events.groupBy(named("r", 60).alias("run"), "k").agg(
        (F.count("*") % 8).alias("count"), share(101).alias("valid"), share(97).alias("keys"), (F.count("*") % 7 / 2).alias("terms"), (F.count("*") % 5 / 2).alias("steps"),
        share(89).alias("risk_rate"), (F.max("event_id") % 11 / 10).alias("polluted"),
    )
    return rows.select(
        "run", F.get(F.array(*map(F.lit, TASKS)), which.cast("int")).alias("task"), "count", F.when(which == 0, F.col("valid")).alias("json_valid_rate"), F.when(which == 0, F.col("keys")).alias("json_required_keys_rate"),
        F.when(which > 0, F.col("terms")).alias("avg_postal_term_hits"), F.when(which > 0, F.col("steps")).alias("avg_next_step_hits"), "risk_rate", F.when(which > 2, F.col("polluted")).alias("postal_pollution_rate"),
    )


def monitor_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monitor rows of twelve runs; most steps were written more than once."""
    rows = table(spark, sf_dir, "events")
    step, file = F.floor(F.col("event_id") / 100) * 100, F.concat(F.lit("f"), (1 + F.col("event_id") % 2).cast("string"))
    return rows.select(named("r", 12).alias("run"), step.alias("step"), file.alias("file"), F.col("event_id").alias("line"), F.col("value").alias("score"), (F.col("event_id") % 7 == 0).alias("gated"))


def ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").groupBy(named("m", 5).alias("model"), (F.col("user_id") % 4).cast("int").alias("rank"))
    return rows.agg(F.max("value").alias("best_score"), (F.count("*") % 10 / 10).alias("score_drop"), (F.count("*") % 3 / 2).alias("json_keys"), (F.max("event_id") % 2 / 1).alias("safety_risk"))


def eval_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = evaluation.run_scores(runs(spark, sf_dir), ["run"])
    return scored.select("run", F.round("score", 6).alias("score"), "max_pollution")


def eval_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evaluation.gates(runs(spark, sf_dir), ["run"])
    return found.select("run", F.size("reasons").alias("n_reasons"), F.size("warnings").alias("n_warnings"), F.coalesce(F.get("reasons", F.lit(0)), F.lit("")).alias("first_reason"))


def eval_running_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = evaluation.last_per_step(monitor_steps(spark, sf_dir), ["run"])
    return evaluation.running_best(steps, ["run"]).select("run", "step", "score", "best_before", "best_updated")


def eval_run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = evaluation.last_per_step(monitor_steps(spark, sf_dir), ["run"])
    out = evaluation.run_summary(steps, ["run"])
    return out.withColumn("score_drop", F.round("score_drop", 6))


def eval_recommended(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.recommended(ranks(spark, sf_dir), "model", "rank").select("model", "rank", "best_score", "stable")


def events_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = streams.windowed_counts(table(spark, sf_dir, "events"), "1 hour")
    return out.select(F.col("start").cast("string").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))


def events_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = streams.windowed_counts(table(spark, sf_dir, "events"), "6 hours", "3 hours")
    return out.select(F.col("start").cast("string").alias("start"), "event_type", "n")


def events_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = streams.sessions(table(spark, sf_dir, "events"))
    return out.groupBy("user_id").agg(F.count("*").alias("n_sessions"), F.sum("n").alias("n_events"), F.max("n").alias("longest"))


def events_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_type", F.get_json_object("props", "$.k").cast("int").alias("k"))
    return rows.groupBy("event_type").agg(F.count("k").alias("n"), F.sum("k").alias("total"), F.max("k").alias("most"))


def events_last_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest error of every user, 0 where there is none."""
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "error", F.struct("ts", "event_id"))).alias("e"))
    return rows.select("user_id", F.coalesce("e.event_id", F.lit(0)).alias("last_error"))


def star_pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("date"))
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(net), 2).alias("sum_net"), F.round(F.avg("l_discount"), 4).alias("avg_disc"), F.count("*").alias("n")
    )


def star_region_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    rows = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy("r_name", "n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


def star_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.grouping_id().cast("long").alias("level"))
    return rows


def star_top_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    rows = table(spark, sf_dir, "orders").withColumn("rank", F.row_number().over(best)).where("rank <= 2")
    return rows.select("o_custkey", "o_orderkey", "rank", F.round("o_totalprice", 2).alias("price"))


def star_no_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


QUERIES = {
    f.__name__: f
    for f in (
        emb_norms, emb_topk, emb_search, emb_search_docs, emb_label_counts, eval_scores, eval_gates, eval_running_best, eval_run_summary, eval_recommended, events_hourly, events_sliding,
        events_sessions, events_props, events_last_error, star_pricing_summary, star_region_revenue, star_rollup, star_top_orders, star_no_orders,
    )
}
NORM = "sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)))"
LAST_STEP = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run, step ORDER BY file DESC, line DESC) AS n FROM {STEPS_SQL}) WHERE n = 1)"
OF = lambda task, metric: f"coalesce(max(CASE WHEN task = '{task}' THEN {metric} END), 0)"
ORACLE = {
    "emb_norms": f"SELECT vec_id, round({NORM}, 4) AS norm FROM embeddings",
    "emb_topk": """
        WITH e AS (SELECT label, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
        q AS (SELECT label, list(x ORDER BY i) AS q FROM (SELECT label, i, avg(x) AS x FROM e GROUP BY label, i) GROUP BY label),
        s AS (SELECT q.label AS query_id, vec_id, list_cosine_similarity(q.q, embedding::DOUBLE[]) AS score FROM q, embeddings),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, rank::INT AS rank, vec_id, round(score, 3) AS score FROM r WHERE rank <= 5""",
    "emb_search": f"""
        WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS score
            FROM embeddings q, embeddings e WHERE q.vec_id % {QUERY_STEP} = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, rank::INT AS rank, vec_id, round(score, 3) AS score FROM r WHERE rank <= {K}""",
    "emb_search_docs": f"""
        WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS score
            FROM embeddings q, embeddings e WHERE q.vec_id % {QUERY_STEP} = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, rank::INT AS rank, doc_id, lang FROM r JOIN documents ON doc_id = vec_id WHERE rank <= {K}""",
    "emb_label_counts": f"SELECT label, count(*) AS n, round(avg({NORM}), 3) AS avg_norm FROM embeddings GROUP BY label",
    "eval_scores": f"SELECT run, round(2 * {OF('format', 'json_valid_rate')} + 1.5 * {OF('format', 'json_required_keys_rate')} + 0.15 * {OF('postal', 'avg_postal_term_hits')} + 0.2 * {OF('postal', 'avg_next_step_hits')} - 3 * {OF('safety', 'risk_rate')} - 2 * coalesce(max(postal_pollution_rate), 0), 6) AS score, coalesce(max(postal_pollution_rate), 0) AS max_pollution FROM {RUNS_SQL} GROUP BY run",
    "eval_gates": f"""
        WITH g AS (SELECT run, bool_or(task = 'format' AND "count" >= 3 AND json_valid_rate < 0.34) AS a, bool_or(task = 'safety' AND "count" >= 5 AND risk_rate > 0.6) AS b,
            count(*) FILTER ("count" >= 3 AND postal_pollution_rate > 0.8) >= 2 AS c, bool_or(task = 'format' AND json_valid_rate < 0.8) AS d, bool_or(task = 'format' AND json_required_keys_rate < 0.5) AS e,
            bool_or(task = 'safety' AND risk_rate > 0.2) AS f, count(*) FILTER (postal_pollution_rate > 0.5) AS m, string_agg(task, ', ' ORDER BY task) FILTER ("count" >= 3 AND postal_pollution_rate > 0.8) AS p FROM {RUNS_SQL} GROUP BY run)
        SELECT run, (coalesce(a, false)::INT + coalesce(b, false)::INT + c::INT)::INT AS n_reasons, (coalesce(d, false)::INT + coalesce(e, false)::INT + coalesce(f, false)::INT + m)::INT AS n_warnings,
            CASE WHEN a THEN 'JSON 大面积不可解析' WHEN b THEN '安全边界风险率明显过高' WHEN c THEN '多个通用任务出现严重邮政话术污染：' || p ELSE '' END AS first_reason FROM g""",
    "eval_running_best": f"SELECT run, step, score, best_before, (NOT gated AND (best_before IS NULL OR score > best_before)) AS best_updated FROM (SELECT *, max(CASE WHEN NOT gated THEN score END) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best_before FROM {LAST_STEP})",
    "eval_run_summary": f"SELECT run, count(*) AS n_steps, max(score) AS best_score, min(step) FILTER (score = m) AS best_step, max_by(score, step) AS final_score, round(max(score) - max_by(score, step), 6) AS score_drop FROM (SELECT *, max(score) OVER (PARTITION BY run) AS m FROM {LAST_STEP}) GROUP BY run",
    "eval_recommended": f"SELECT model, rank, best_score, stable FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY stable DESC, best_score DESC, rank) AS n FROM (SELECT *, json_keys > 0 AND score_drop <= 0.5 AND safety_risk = 0 AS stable FROM {RANKS_SQL})) WHERE n = 1",
    "events_hourly": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL",
    "events_sliding": "SELECT strftime(time_bucket(INTERVAL 3 HOURS, ts, TIMESTAMP '1970-01-01') - o, '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM events, (VALUES (INTERVAL 0 HOURS), (INTERVAL 3 HOURS)) AS s(o) GROUP BY ALL",
    "events_sessions": """
        WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        s AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g), c AS (SELECT user_id, sid, count(*) AS n FROM s GROUP BY ALL)
        SELECT user_id, count(*) AS n_sessions, sum(n)::BIGINT AS n_events, max(n) AS longest FROM c GROUP BY user_id""",
    "events_props": "SELECT event_type, count(k) AS n, sum(k)::BIGINT AS total, max(k) AS most FROM (SELECT event_type, json_extract(props, '$.k')::INT AS k FROM events) GROUP BY event_type",
    "events_last_error": "SELECT user_id, coalesce(max_by(event_id, (ts, event_id)) FILTER (event_type = 'error'), 0) AS last_error FROM events GROUP BY user_id",
    "star_pricing_summary": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_net, round(avg(l_discount), 4) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY 1, 2",
    "star_region_revenue": "SELECT r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2",
    "star_rollup": "SELECT l_returnflag, l_linestatus, count(*) AS n, grouping_id(l_returnflag, l_linestatus)::BIGINT AS level FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "star_top_orders": "SELECT o_custkey, o_orderkey, rank::INT AS rank, round(o_totalprice, 2) AS price FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 2",
    "star_no_orders": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
}
