"""Scalar text functions, Column to Column, built-ins only.

White space is Unicode white space throughout; ``WS`` names it for the
regular-expression engine.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"[\s\p{Z}\x1c-\x1f\x{85}]"
CJK = r"[\x{4e00}-\x{9fff}]"
# Entities decoded by the built-in chain; the ampersand comes last.
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]


def collapse(text: Column) -> Column:
    """White space runs to one space, none at the ends."""
    return F.regexp_replace(F.regexp_replace(text, f"{WS}+", " "), "^ | $", "")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{WS}+|{WS}+$", "")


def unescape_entities(text: Column) -> Column:
    for entity, plain in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return text


def strip_html(html: Column) -> Column:
    """Plain text of a page: scripts, styles and tags go, entities are decoded."""
    text = F.regexp_replace(html, r"(?i)<script[\s\S]*?</script>", " ")
    text = F.regexp_replace(text, r"(?i)<style[\s\S]*?</style>", " ")
    return collapse(unescape_entities(F.regexp_replace(text, "<[^>]+>", " ")))


def title(html: Column, company: Column) -> Column:
    """The first title element, or the company where it is missing or blank."""
    found = collapse(unescape_entities(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)))
    return F.coalesce(F.nullif(found, F.lit("")), company)


def pdf_title(url: Column, company: Column) -> Column:
    """File name of a PDF's address, or the company's name and PDF."""
    path = F.regexp_replace(F.split_part(url, F.lit("?"), F.lit(1)), "/+$", "")
    name = unescape_entities(F.element_at(F.split(path, "/"), -1))
    return F.coalesce(F.nullif(name, F.lit("")), F.concat(company, F.lit(" PDF")))


def published_at(text: Column) -> Column:
    """The first date as written; dashes, slashes and characters go before dots."""
    patterns = [r"(20\d{2}[-/年]\d{1,2}[-/月]\d{1,2}日?)", r"(20\d{2}\.\d{1,2}\.\d{1,2})"]
    return F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in patterns], F.lit(""))


def summary(text: Column) -> Column:
    """Up to three sentences of at least 12 characters, or the first 300 characters."""
    parts = F.filter(F.transform(F.split(text, "[。！？.!?]"), strip), lambda p: F.length(p) >= 12)
    joined = F.nullif(F.array_join(F.slice(parts, 1, 3), "。"), F.lit(""))
    return F.substring(F.coalesce(joined, text), 1, 300)


def lowered(text: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of the lower-case text, which is made once however often it is read."""
    return F.element_at(F.transform(F.array(F.lower(text)), body), 1)


def keyword_hits(text: Column, keywords: list[str]) -> Column:
    """How many different keywords occur, without regard to case; null for null."""
    if not keywords:
        return F.lit(0)
    words = F.array(*[F.lit(k.lower()) for k in keywords])
    return lowered(text, lambda low: F.when(low.isNotNull(), F.size(F.filter(words, lambda k: F.contains(low, k)))))


def has_any(text: Column, keywords: list[str]) -> Column:
    """Whether a keyword occurs, without regard to case; null for null."""
    if not keywords:
        return F.lit(False)
    words = F.array(*[F.lit(k.lower()) for k in keywords])
    return lowered(text, lambda low: F.exists(words, lambda k: F.contains(low, k)))


def first_match(text: Column, patterns: list[str]) -> Column:
    """The whole match of the first pattern, in list order, that matches; '' if none."""
    tries = [F.nullif(F.regexp_extract(text, f"(?i){p}", 0), F.lit("")) for p in patterns]
    return strip(F.coalesce(*tries, F.lit("")))


def content_hash(text: Column) -> Column:
    return F.sha2(collapse(text), 256)


def cjk_ratio(text: Column) -> Column:
    """Chinese characters among those that are not white space, digits or time marks."""
    counted = F.length(F.regexp_replace(text, r"[\s\p{Z}\d:,.\->]", ""))
    chinese = F.length(F.regexp_replace(text, r"[^\x{4e00}-\x{9fff}]", ""))
    return F.when(counted > 0, chinese / counted).otherwise(F.lit(0.0))


def looks_english(text: Column) -> Column:
    return text.rlike("[A-Za-z]") & ~text.rlike(CJK)


def eval_norm(text: Column) -> Column:
    """For comparisons: no white space, lower case, null as empty."""
    return F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), f"{WS}+", ""))


def slug(text: Column) -> Column:
    cleaned = F.regexp_replace(strip(text), r"(?U)[^\w\x{4e00}-\x{9fff}-]+", "-")
    cleaned = F.regexp_replace(F.regexp_replace(cleaned, "-{2,}", "-"), "^-|-$", "")
    return F.coalesce(F.nullif(cleaned, F.lit("")), F.lit("section"))


def rank_of_folder(path: Column) -> Column:
    """The number at the end of a folder named rank_N; null for other names."""
    return F.regexp_extract(path, r"rank_(\d+)$", 1).try_cast("int")


def chunks(text: Column, size: int) -> Column:
    """Slices of ``size`` characters; one empty slice for an empty text."""
    last = F.greatest(F.floor((F.length(text) - 1) / size), F.lit(0)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(text, i * size + 1, F.lit(size)))


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("int")


def display_norm(text: Column) -> Column:
    """Repair spacing of Chinese text and put each dialogue turn on its own line."""
    text = F.regexp_replace(text, rf"(?<={CJK}){WS}+(?={CJK})", "")
    text = F.regexp_replace(text, rf"{WS}+([，。！？；：、“”）])", "$1")
    text = F.regexp_replace(text, rf"([，。！？；：、“”]){WS}+(?={CJK})", "$1")
    text = F.regexp_replace(text, rf"([（“]){WS}+", "$1")
    text = F.regexp_replace(text, r"(?<!^)(?=(?:用户|客服)\[\d+\]:)", "\n")
    return F.regexp_replace(text, "\n{2,}", "\n")


def compact(text: Column, size: int) -> Column:
    return F.substring(collapse(display_norm(text)), 1, size)


def code_fence(text: Column) -> Column:
    """Text without a code fence's first and last line."""
    return strip(F.regexp_replace(F.regexp_replace(strip(text), r"^```[^\n]*\n?", ""), r"\n?```$", ""))


def srt_time(seconds: Column) -> Column:
    """HH:MM:SS,mmm with truncated milliseconds."""
    ms = F.floor(F.round(seconds * 1000, 6)).cast("long")
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def clock(ts: Column, zone: str, pattern: str) -> Column:
    return F.date_format(F.from_utc_timestamp(ts, zone), pattern)


def sse(event: Column, data: Column) -> Column:
    """A server-sent event frame of a name and a JSON text."""
    return F.concat(F.lit("event: "), event, F.lit("\ndata: "), data, F.lit("\n\n"))


def generated_body(text: Column) -> Column:
    """A generation's own text: between the marks, without the statistics lines."""
    parts = F.transform(F.split(strip(text), "={10}"), strip)
    inner = F.when((F.size(parts) >= 2) & (F.get(parts, F.lit(1)) != ""), F.get(parts, F.lit(1))).otherwise(strip(text))
    for mark in ("Prompt: ", "Generation: ", "Peak memory: "):
        inner = strip(F.regexp_replace(inner, f"{mark}[^\\n]*", ""))
    return inner


def choice(text: Column) -> Column:
    """The chosen letter A to D of a generation, '' if none."""
    patterns = [r"答案[:：]?\s*([ABCD])\b", r"选项[:：]?\s*([ABCD])\b", r"^\s*([ABCD])\b", r"\b([ABCD])\b"]
    body = generated_body(text)
    return F.upper(F.coalesce(*[F.nullif(F.regexp_extract(body, f"(?im){p}", 1), F.lit("")) for p in patterns], F.lit("")))


def safe_label(value: Column) -> Column:
    """A label as the start of a file name: other characters than ASCII letters, digits, ``_.-`` become one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(value, F.lit("")), r"[^A-Za-z0-9_.-]+", "_"), r"\A_+|_+\z", "")


def safe_file(value: Column) -> Column:
    """A value as part of a file name: each character that is no letter, digit or one of ``-_.`` becomes an underscore."""
    return F.regexp_replace(F.coalesce(value, F.lit("")), r"[^\p{L}\p{N}_.-]", "_")


def markdown_whitespace(text: Column) -> Column:
    """Line feeds only, at most one blank line in a row, nothing blank around."""
    return strip(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n"), "\n{3,}", "\n\n"))
