"""What a fetcher decides about addresses, headers and bodies, as columns."""

from __future__ import annotations

import codecs

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from postmill.functions.lexicon import WAF_MARKERS
from postmill.operators import links

# Parts of addresses and the companies they belong to; the first that matches counts.
COMPANIES = [
    ("ems.com.cn", "中国邮政 EMS"), ("sf-express.com", "顺丰速运"), ("spb.gov.cn", "国家邮政局"), ("ups.com", "UPS"), ("fedex.com", "FedEx"), ("dhl.com", "DHL Express"),
    ("chinapost.com.cn", "中国邮政"), ("jdl.com", "京东物流"), ("yto.net.cn", "圆通速递"), ("sto.cn", "申通快递"), ("zto.com", "中通快递"), ("yundaex.com", "韵达速递"),
    ("jtexpress.com.cn", "极兔速递"), ("deppon.com", "德邦快递"), ("ky-express.com", "跨越速运"), ("cainiao.com", "菜鸟"),
]
OTHER_COMPANY = "其他来源"
# States that mean a blocked page on one site.
BLOCK_STATES = [405, 406, 412]
GUARDED_SITE = "ems.com.cn"
# Redirects by script, then by a meta element.
REDIRECTS = [
    r"""window\.location\.replace\(['"]([^'"]+)['"]\)""",
    r"""window\.location\.href\s*=\s*['"]([^'"]+)['"]""",
    r"""location\.href\s*=\s*['"]([^'"]+)['"]""",
    r"""http-equiv=["']refresh["'][^>]*content=["'][^;]+;\s*url=([^"']+)["']""",
]
# Request headers.
HEADERS = {
    "Accept": "text/html,application/xhtml+xml,application/xml;q=0.9,application/pdf;q=0.8,*/*;q=0.7", "Accept-Language": "zh-CN,zh;q=0.9,en;q=0.7",
    "Cache-Control": "no-cache", "Pragma": "no-cache", "Upgrade-Insecure-Requests": "1",
}
GUARDED_HEADERS = {"Sec-Fetch-Dest": "document", "Sec-Fetch-Mode": "navigate", "Sec-Fetch-Site": "same-origin", "Sec-Fetch-User": "?1"}


def company_of(url: Column, names: list[tuple[str, str]] = COMPANIES) -> Column:
    """The company of an address, else its network location, else a constant."""
    known = [F.when(F.contains(url, F.lit(part)), F.lit(name)) for part, name in names]
    return F.coalesce(*known, F.nullif(links.netloc(url), F.lit("")), F.lit(OTHER_COMPANY))


def request_headers(url: Column, user_agent: Column) -> Column:
    """A map of headers like those of a browser."""
    pairs = lambda values: F.create_map(*[F.lit(x) for item in values.items() for x in item])
    none = F.create_map().cast("map<string,string>")
    origin = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1)
    referer = F.when(origin != "", F.create_map(F.lit("Referer"), F.concat(origin, F.lit("/")))).otherwise(none)
    guarded = F.when(browser_retry(url), pairs(GUARDED_HEADERS)).otherwise(none)
    return F.map_concat(F.create_map(F.lit("User-Agent"), user_agent), pairs(HEADERS), referer, guarded)


def browser_retry(url: Column) -> Column:
    """Whether a blocked address may be tried in a browser."""
    return F.coalesce(F.endswith(links.host(url), F.lit(GUARDED_SITE)), F.lit(False))


def blocked(status: Column, text: Column, final_url: Column) -> Column:
    """Whether a response is a security device's page."""
    low = F.lower(F.coalesce(text, F.lit("")))
    marked = F.exists(F.array(*map(F.lit, WAF_MARKERS)), lambda m: F.contains(low, m))
    return marked | F.coalesce(status.isin(BLOCK_STATES) & F.contains(F.lower(final_url), F.lit(GUARDED_SITE)), F.lit(False))


def html_response(content_type: Column, url: Column) -> Column:
    return F.contains(F.lower(F.coalesce(content_type, F.lit(""))), F.lit("html")) | F.lower(url).rlike(r"(\.html?|/)\z")


@F.pandas_udf(StringType())
def _decoded(bodies: pd.Series, charsets: pd.Series) -> pd.Series:
    def one(body: bytes | None, charset: str) -> str | None:
        try:
            codecs.lookup(charset)
        except LookupError:
            charset = "utf-8"
        return None if body is None else body.decode(charset, errors="replace")

    return pd.Series([one(b, c) for b, c in zip(bodies, charsets, strict=True)])


def decode_body(body: Column, content_type: Column, url: Column, charset: Column) -> Column:
    """A response's text; '' for a PDF and an empty body. UTF-8 stays in the JVM."""
    pdf = F.contains(F.lower(F.coalesce(content_type, F.lit(""))), F.lit("pdf")) | F.endswith(F.lower(url), F.lit(".pdf"))
    empty = body.isNull() | (F.octet_length(body) == 0)
    name = F.lower(F.coalesce(F.nullif(charset, F.lit("")), F.lit("utf-8")))
    text = F.when(name.isin("utf-8", "utf8"), F.make_valid_utf8(body.cast("string"))).otherwise(_decoded(body, name))
    return F.when(F.coalesce(pdf, F.lit(False)) | empty, F.lit("")).otherwise(text)


def client_redirect(url: Column, html: Column) -> Column:
    """The absolute address that a page sends its reader to, '' if none."""
    found = [F.nullif(F.trim(F.regexp_extract(html, f"(?i){p}", 1)), F.lit("")) for p in REDIRECTS]
    target = F.coalesce(*found)
    return F.when(target.isNotNull(), links.absolute_url(url, target)).otherwise(F.lit(""))
