"""Readers with explicit schemas, and the ordinals that order-sensitive operators need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

from postmill.functions import text as T

POLICY = (
    "source_id string, company string, url string, uri string, title string, published_at string, policy_categories array<string>, summary string, "
    "evidence_text string, insurance_available boolean, insurance_type string, compensation_limit string, claim_deadline string, "
    "requirements array<string>, insurance_exclusions array<string>"
)
FETCH_LOG = (
    "url string, status_code int, content_type string, text string, final_url string, fetched_at string, success boolean, failure_reason string, "
    "body_bytes string, source_id string, company string, parser_kind string, raw_text_path string, text_truncated boolean"
)
FAQ = "code int, data array<struct<name: string, faqList: array<struct<id: string, question: string, answer: string>>>>"
DIALOGUE = (
    "DialogueID int, QRole string, QA array<struct<QueSumm: string, AnsSummShort: string, AnsSummLong: string, QASumm: string, intent: string>>, "
    "Session_id string, Dialogue array<struct<speaker: string, turn: int, utterance: string>>, UserSumm array<string>, AgentSumm array<string>, FinalSumm array<string>"
)
EMBEDDING_METADATA = "index int, session_id string, dialogue_id int, turn_count int"
EVAL_ITEM = "id string, task string, prompt string, answer_type string, answer string, required_keys array<string>, source string"


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a schema; blank lines are skipped, a missing path is empty, any other fault is an error."""
    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], StructType.fromDDL(schema))


def numbered_lines(spark: SparkSession, path: str, count_blank: bool = True) -> DataFrame:
    """path, file, line (from 0) and text of every line that is not blank, in files of any size.

    A file is read in splits by many tasks. A split's lines have ascending
    ids, so a line's number is its id less the least of its split, plus the
    lines of the file's earlier splits; only one row a split is gathered for
    those sums. ``count_blank`` numbers physical lines, else only those that
    are not blank.
    """
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("value").alias("text"))
    full = T.strip(F.col("text")) != ""
    rows = (rows if count_blank else rows.where(full)).withColumn("__id", F.monotonically_increasing_id())
    ahead = Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = rows.groupBy("path", "split").agg(F.min("__id").alias("first"), F.count("*").alias("n"))
    shifts = splits.select("path", "split", (F.coalesce(F.sum("n").over(ahead), F.lit(0)) - F.col("first")).alias("shift"))
    placed = rows.where(full).join(shifts, ["path", "split"])
    return placed.select("path", "file", (F.col("__id") + F.col("shift")).alias("line"), "text")


def jsonl_numbered(spark: SparkSession, path: str, schema: str, count_blank: bool = True) -> DataFrame:
    """JSON lines with file, line number from 0 and the parsed ``row``; a line that is no object is an error that names it.

    ``count_blank`` numbers physical lines; otherwise blank lines have no number.
    """
    message = F.concat_ws(":", "file", F.col("line").cast("string"), F.lit("not a JSON object"))
    checked = F.when(F.json_object_keys("text").isNull(), F.raise_error(message).cast("string")).otherwise(F.col("text"))
    return numbered_lines(spark, path, count_blank).select("file", "line", F.from_json(checked, schema).alias("row"))


def embedding_metadata(spark: SparkSession, path: str, split: str) -> DataFrame:
    """split, pos and fields of embedding metadata: an object of splits, or a bare list of the one ``split``."""
    whole = spark.read.text(path, wholetext=True)
    by_split = F.from_json("value", f"map<string, array<struct<{EMBEDDING_METADATA}>>>")
    listed = F.from_json("value", f"array<struct<{EMBEDDING_METADATA}>>")
    bare = F.ltrim("value").startswith("[")
    found = F.when(bare, F.create_map(F.lit(split), listed)).otherwise(by_split)
    shaped = F.when(found.isNull(), F.raise_error(F.lit("embedding metadata must be a list or an object of lists")).cast(f"map<string, array<struct<{EMBEDDING_METADATA}>>>")).otherwise(found)
    rows = whole.select(F.explode(shaped).alias("split", "items")).select("split", F.posexplode("items").alias("pos", "m"))
    return rows.select("split", "pos", "m.*")


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole-file JSON arrays with a ``split`` column from the file name; other content fails."""
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").option("pathGlobFilter", "[!._]*").json(path)
    return rows.withColumn("split", F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", ""))


def split_verdicts(spark: SparkSession, path: str, splits: list[str], record: str) -> DataFrame:
    """An object of splits to rows (split, pos, record fields); a missing split is an error."""
    schema = ", ".join(f"{s} array<struct<{record}>>" for s in splits)
    whole = spark.read.schema(schema).option("multiLine", True).json(path)
    missing = whole.where(" OR ".join(f"{s} IS NULL" for s in splits)).count()
    if missing:
        raise ValueError("a split is missing")
    parts = [whole.select(F.lit(s).alias("split"), F.posexplode(s).alias("pos", "r")).select("split", "pos", "r.*") for s in splits]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def whole_texts(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """file and text of every matching file below ``path``."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path, wholetext=True)
    return rows.select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("text"))


def media_files(spark: SparkSession, path: str, extensions: list[str] | None = None, without: list[str] | None = None) -> DataFrame:
    """Paths and sizes of files with one of the extensions, or of all but those ``without`` them; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    plain = lambda names: [n.lower().lstrip(".") for n in names]
    wanted = files if extensions is None else files.where(suffix.isin(plain(extensions)))
    return wanted.where(~suffix.isin(plain(without))) if without else wanted


def limit_per_file(rows: DataFrame, n: int, file: str = "file", order: str = "line") -> DataFrame:
    ranked = Window.partitionBy(file).orderBy(order)
    return rows.withColumn("__n", F.row_number().over(ranked)).where(F.col("__n") <= n).drop("__n")


def yaml_rows(spark: SparkSession, text: str, key: str, schema: str) -> DataFrame:
    """Rows of a list in a small YAML text; anything but a mapping is an error."""
    import yaml

    data = yaml.safe_load(text)
    if not isinstance(data, dict):
        raise ValueError("the YAML text is not a mapping")
    names = StructType.fromDDL(schema).fieldNames()
    return spark.createDataFrame([tuple(row.get(n) for n in names) for row in data.get(key) or []], StructType.fromDDL(schema))


def rate_limit_rows(overrides: DataFrame, default: dict[str, int]) -> DataFrame:
    """Domain limits with the default's values where an override has none."""
    def filled(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(default[name])).alias(name)

    return overrides.select("domain", *[filled(n) for n in default])


def raw_or_preview(log: DataFrame, raw: DataFrame) -> DataFrame:
    """The log with the full raw text where there is one, else its preview."""
    return log.join(raw.withColumnsRenamed({"text": "raw"}), log["raw_text_path"] == raw["path"], "left").withColumn("text", F.coalesce("raw", "text")).drop("raw", "path")
