"""Folders of training runs: monitors, best adapters and metrics, and where a run goes on.

A run folder has ``rank_<n>`` folders with ``logs/train_monitor_<time>.jsonl``,
``logs/best_adapter_<time>.json`` or, in older runs, ``best_adapter/best_adapter_<time>.json``.
"""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.functions import text as T
from postmill.operators.evaluation import metric_value
from postmill.sources.readers import numbered_lines

# The metrics of a summary, by task.
SUMMARY_METRICS = {
    "json_valid": ("format", "json_valid_rate"), "json_keys": ("format", "json_required_keys_rate"), "safety_risk": ("safety", "risk_rate"),
    "postal_terms": ("postal", "avg_postal_term_hits"), "next_steps": ("postal", "avg_next_step_hits"), "ceval_acc": ("ceval_choice", "choice_accuracy"),
}


def rank_of(path: Column) -> Column:
    return F.regexp_extract(path, r"/rank_(\d+)/", 1).cast("int")


def one_form(path: Column) -> Column:
    """A path as listings and rows both have it; local ones come with one slash or three."""
    return F.regexp_replace(path, "^file:/+", "file:///")


def files_below(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """path and name of files, empty ones too; only the listing is read, which for run folders is short."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    return spark.createDataFrame([(f, unquote(f.rpartition("/")[2])) for f in found.inputFiles()], "path string, name string").withColumn("path", one_form(F.col("path")))


def newest(files: DataFrame) -> DataFrame:
    """The last file by name of each rank, empty files too; a ``first`` column, where there is one, goes before the name."""
    order = F.struct(*(["first"] if "first" in files.columns else []), "name")
    return files.groupBy(rank_of(F.col("path")).alias("rank")).agg(F.max_by("path", order).alias("path"))


def monitors(spark: SparkSession, root: str) -> DataFrame:
    """rank, line and text of the newest monitor of each rank."""
    last = newest(files_below(spark, root, "train_monitor_*.jsonl").where(F.col("path").contains("/logs/")))
    lines = numbered_lines(spark, f"{root}/rank_*/logs/train_monitor_*.jsonl").withColumn("path", one_form(F.col("path")))
    return lines.join(last, "path").select("rank", "line", "text")


def completed_steps(spark: SparkSession, root: str) -> DataFrame:
    """rank and last completed step by its newest monitor; cut lines and steps that are no whole number count for nothing."""
    last = newest(files_below(spark, root, "train_monitor_*.jsonl").where(F.col("path").contains("/logs/")))
    step = F.try_variant_get(F.try_parse_json("text"), "$.step", "variant")
    whole = F.when(F.schema_of_variant(step) == "BIGINT", F.try_variant_get(F.try_parse_json("text"), "$.step", "long"))
    steps = monitors(spark, root).groupBy("rank").agg(F.max(whole).alias("step"))
    return last.join(steps, "rank", "left").select("rank", F.greatest(F.coalesce("step", F.lit(0)), F.lit(0)).cast("long").alias("completed"))


def resume_plan(ranks: DataFrame, completed: DataFrame, total: int) -> DataFrame:
    """rank, completed and status (skip, resume or start) of the ranks to train for ``total`` steps."""
    rows = ranks.select("rank").join(completed, "rank", "left").withColumn("completed", F.coalesce("completed", F.lit(0).cast("long")))
    status = F.when(F.col("completed") >= total, F.lit("skip")).when(F.col("completed") > 0, F.lit("resume")).otherwise(F.lit("start"))
    return rows.select("rank", "completed", status.alias("status"))


def best_metadata(spark: SparkSession, root: str) -> DataFrame:
    """rank, best_step, best_score and metrics (JSON text) of each rank's last best-adapter file; those in ``logs`` go first."""
    files = files_below(spark, root, "best_adapter_*.json").withColumn("first", F.col("path").contains("/logs/"))
    whole = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "best_adapter_*.json").text(root, wholetext=True)
    text = whole.select(one_form(F.col("_metadata.file_path")).alias("path"), "value").join(newest(files), "path")
    of = lambda name, kind: F.get_json_object("value", f"$.{name}").cast(kind).alias(name)
    return text.select("rank", of("best_step", "int"), of("best_score", "double"), F.get_json_object("value", "$.metrics").alias("metrics"))


def final_records(spark: SparkSession, root: str) -> DataFrame:
    """rank, step, score and metrics of the last line of each rank's newest monitor."""
    last = monitors(spark, root).groupBy("rank").agg(F.max_by("text", "line").alias("text"))
    of = lambda name, kind: F.get_json_object("text", f"$.{name}").cast(kind).alias(name)
    return last.select("rank", of("step", "int"), of("score", "double"), F.get_json_object("text", "$.metrics").alias("metrics"))


def metric_columns(metrics: Column, names: dict[str, tuple[str, str]], prefix: str = "") -> list[Column]:
    return [metric_value(metrics, task, metric, 0.0).alias(prefix + name) for name, (task, metric) in names.items()]


def rank_comparison(spark: SparkSession, root: str) -> DataFrame:
    """Best and final figures of each rank of a run folder."""
    best, final = best_metadata(spark, root), final_records(spark, root)
    joined = best.join(final.select("rank", F.col("score").alias("final_score"), F.col("metrics").alias("final_metrics")), "rank")
    shown = {n: SUMMARY_METRICS[n] for n in ("json_keys", "json_valid", "safety_risk", "postal_terms", "next_steps")}
    late = {n: SUMMARY_METRICS[n] for n in ("json_keys", "safety_risk")}
    return joined.select("rank", "best_step", "best_score", "final_score", *metric_columns(F.col("metrics"), shown), *metric_columns(F.col("final_metrics"), late, "final_"))


def rank_summaries(steps: DataFrame, keys: list[str]) -> DataFrame:
    """Summaries of runs (keys, step, score, metrics as JSON text): steps, last and best step, scores, drop and the metrics at the best step.

    The first step wins ties; a null score counts below all others and as 0.
    """
    score = F.coalesce("score", F.lit(float("-inf")))
    rows = steps.groupBy(*keys).agg(
        F.count("*").alias("steps"), F.max("step").alias("last_step"), F.max_by(F.struct("step", "score", "metrics"), F.struct(score, (-F.col("step")))).alias("b"), F.max_by("score", "step").alias("f")
    )
    best, final = F.coalesce("b.score", F.lit(0.0)), F.coalesce("f", F.lit(0.0))
    return rows.select(
        *keys, "steps", "last_step", F.col("b.step").alias("best_step"), best.alias("best_score"), final.alias("final_score"), (best - final).alias("score_drop"),
        *metric_columns(F.col("b.metrics"), SUMMARY_METRICS),
    )


def metrics_files(spark: SparkSession, root: str) -> DataFrame:
    """label and report (JSON text) of every ``<label>_metrics.json``; a file that is no JSON object is an error."""
    whole = spark.read.option("pathGlobFilter", "*_metrics.json").text(root, wholetext=True)
    name = F.col("_metadata.file_name")
    checked = F.when(F.json_object_keys("value").isNull(), F.raise_error(F.concat(name, F.lit(" is not a JSON object"))).cast("string")).otherwise(T.strip(F.col("value")))
    return whole.select(F.regexp_replace(name, r"_metrics\.json\z", "").alias("label"), checked.alias("report"))
