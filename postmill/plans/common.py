"""Tables and SQL fragments that the registered queries share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
SPACE = r"[\s\p{Z}\x1c-\x1f\x{85}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_collapse(expr: str) -> str:
    return f"regexp_replace(regexp_replace({expr}, '{SPACE}', ' ', 'g'), '^ | $', '', 'g')"


def sql_entities(expr: str) -> str:
    for entity, plain in [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", "\u00a0"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]:
        expr = f"replace({expr}, '{entity}', '{plain}')"
    return expr


def sql_plain(expr: str) -> str:
    expr = f"regexp_replace({expr}, '<script[\\s\\S]*?</script>', ' ', 'gi')"
    expr = f"regexp_replace({expr}, '<style[\\s\\S]*?</style>', ' ', 'gi')"
    return sql_collapse(sql_entities(f"regexp_replace({expr}, '<[^>]+>', ' ', 'g')"))


def sql_hits(expr: str, words: list[str]) -> str:
    return "(" + " + ".join(f"contains(lower({expr}), {sql_text(w.lower())})::INT" for w in words) + ")"


def sql_any(expr: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower({expr}), {sql_text(w.lower())})" for w in words) + ")"
