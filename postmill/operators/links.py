"""Links of pages: extraction, canonical addresses, policy test and rate limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill.functions import text as T

# Hints of policy addresses and of addresses to leave alone.
POLICY_HINTS = [
    "policy", "terms", "insurance", "customs", "dangerous-goods", "hazmat", "restricted", "prohibited", "guide", "notice", "rules", "保价", "保险",
    "寄件", "须知", "禁寄", "限寄", "规则", "条款", "协议", "海关", "清关", "冷链", "危险品",
]
STATIC_SUFFIXES = [".css", ".js", ".png", ".jpg", ".jpeg", ".gif", ".svg", ".webp", ".ico", ".woff", ".woff2", ".ttf", ".eot", ".map", ".xml", ".json", ".zip", ".rar", ".7z"]
NEGATIVE_HINTS = [
    "login", "register", "sign-in", "search", "query", "track", "tracking", "order", "cart", "download-app", "app下载", "登录", "注册", "查询", "下单",
    "contact", "customer-service", "service-alert", "news", "media", "about", "careers", "portal", "帮助中心", "联系我们", "关于我们", "新闻中心", "通知公告",
]
PATH_HINTS = [
    "terms", "insurance", "customs", "dangerous-goods", "hazmat", "restricted", "prohibited", "rules", "policy", "保价", "保险", "寄件", "须知", "禁寄",
    "限寄", "规则", "条款", "协议", "海关", "清关", "冷链", "危险品",
]
ANCHOR_HINTS = ["条款", "协议", "禁寄", "限寄", "规则", "须知", "保价", "保险", "赔偿", "海关", "清关", "dangerous goods", "restricted", "prohibited", "customs"]
# Fixed value: what a link looks like.
LINK = r"""(?is)<a[^>]*href\s*=\s*["']([^"'#]+)["'][^>]*>(.*?)</a>"""


def netloc(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def host(url: Column) -> Column:
    """Host name in lower case, without user and port; '' if there is none."""
    return F.regexp_replace(F.regexp_replace(netloc(url), "^.*@", ""), r":\d*$", "")


def canonical_url(url: Column) -> Column:
    """Lower-case scheme and host, query pairs in order, '/' for an empty path, no fragment."""
    bare = F.regexp_replace(url, "#.*$", "")
    scheme = F.lower(F.regexp_extract(bare, "^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    path = F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)", 1)
    query = F.regexp_extract(bare, r"\?(.*)$", 1)

    def pair(p: Column) -> Column:
        named = lambda part: F.coalesce(F.try_url_decode(part), part)
        key = F.substring_index(p, "=", 1)
        return F.struct(named(key).alias("k"), named(F.substring(p, F.length(key) + 2, F.length(p))).alias("v"))

    coded = lambda part: F.replace(F.replace(F.url_encode(part), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))
    pairs = F.array_sort(F.transform(F.filter(F.split(query, "&"), lambda p: p != ""), pair))
    ordered = F.array_join(F.transform(pairs, lambda p: F.concat(coded(p["k"]), F.lit("="), coded(p["v"]))), "&")
    tail = F.when(ordered != "", F.concat(F.lit("?"), ordered)).otherwise(F.lit(""))
    return F.concat(scheme, F.lit("://"), netloc(bare), F.when(path == "", F.lit("/")).otherwise(path), tail)


def without_dots(segments: Column) -> Column:
    """A path from its segments, by a stack: ``..`` takes back the one before it, ``.`` nothing; the result begins with a slash."""
    text = lambda c: c.cast("string")
    step = lambda stack, s: (
        F.when(s == "..", F.slice(stack, 1, F.greatest(F.size(stack) - 1, F.lit(0)))).when(s == ".", stack).otherwise(F.concat(stack, F.array(text(s))))
    )
    kept = F.aggregate(segments, F.array().cast("array<string>"), step)
    ends_inside = F.element_at(segments, -1).isin(".", "..")
    path = F.array_join(F.when(ends_inside, F.concat(kept, F.array(F.lit("")))).otherwise(kept), "/")
    return F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.lit("/"), path))


def absolute_url(base: Column, href: Column) -> Column:
    """``href`` seen from ``base``, with dot segments resolved.

    An address with a scheme stays as it is, one that begins with two slashes
    takes the scheme. A path takes scheme and host, and a relative one the
    base's folder, less empty segments inside; one without a path takes the
    base's path, and its query too if it has none. Fragments of the base go.
    """
    scheme = F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    base_path = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    path = F.regexp_extract(href, r"^([^?#]*)", 1)
    tail = F.substring(href, F.length(path) + 1, F.length(href))
    folder = F.regexp_replace(F.when(base_path == "", F.lit("/")).otherwise(base_path), r"[^/]*\z", "")
    joined = F.split(F.concat(folder, path), "/", -1)
    inside = F.concat(F.slice(joined, 1, 1), F.filter(F.slice(joined, 2, F.greatest(F.size(joined) - 2, F.lit(0))), lambda s: s != ""), F.slice(joined, -1, 1))
    query = F.when(F.startswith(tail, F.lit("?")), F.lit("")).otherwise(F.regexp_extract(base, r"^[^?#]*(\?[^#]*)", 1))
    return (
        F.when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(F.startswith(href, F.lit("//")), F.concat(scheme, href))
        .when(path == "", F.concat(origin, base_path, query, tail))
        .when(F.startswith(path, F.lit("/")) & ~F.contains(path, F.lit("/.")), F.concat(origin, href))
        .when(F.startswith(path, F.lit("/")), F.concat(origin, without_dots(F.split(path, "/", -1)), tail))
        .otherwise(F.concat(origin, without_dots(inside), tail))
    )


def page_links(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """key, pos, url and anchor of every link of pages (key, url, html); order is kept in pos."""
    both = F.arrays_zip(
        F.regexp_extract_all("html", F.lit(LINK), F.lit(1)).alias("href"), F.regexp_extract_all("html", F.lit(LINK), F.lit(2)).alias("inner")
    )
    rows = pages.select(key, F.col("url").alias("base"), F.posexplode(both).alias("pos", "link"))
    rows = rows.where(~F.col("link.href").rlike("^(javascript|mailto|tel):"))
    anchor = T.collapse(F.regexp_replace("link.inner", "<[^>]+>", " "))
    # Through a generator, so that the address is resolved once and not at each place that reads it.
    rows = rows.select(key, "pos", anchor.alias("anchor"), F.explode(F.array(absolute_url(F.col("base"), F.col("link.href")))).alias("absolute"))
    return rows.select(key, "pos", canonical_url(F.col("absolute")).alias("url"), "anchor")


def first_links(links: DataFrame, key: str = "page_id") -> DataFrame:
    """The first occurrence of each address on its page."""
    order = Window.partitionBy(key, "url").orderBy("pos")
    return links.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def allowed_domain(url: Column, domains: list[str]) -> Column:
    """Whether the address is on one of the domains or below; any host without a list."""
    at, out = netloc(url), F.lit(False)
    for d in (x.lower() for x in domains if x):
        out = out | (at == d) | F.endswith(at, F.lit(f".{d}"))
    return (at != "") & (out if any(domains) else F.lit(True))


def policy_like(url: Column, anchor: Column) -> Column:
    """Whether address and anchor point to a policy page (the domain is tested apart)."""
    low = F.lower(url)
    static = F.lit(False)
    for suffix in STATIC_SUFFIXES:
        static = static | F.endswith(low, F.lit(suffix))
    barred = static | T.has_any(url, ["/xhtml/", "/images/", "/libs/"]) | T.has_any(url, NEGATIVE_HINTS) | T.has_any(anchor, NEGATIVE_HINTS)
    by_path, by_anchor = T.has_any(url, PATH_HINTS), T.has_any(anchor, POLICY_HINTS)
    hard = T.has_any(anchor, ANCHOR_HINTS)
    return ~barred & F.when(F.endswith(low, F.lit(".pdf")), by_path | by_anchor).otherwise(by_path | (hard & by_anchor))


def rate_limits(urls: DataFrame, limits: DataFrame, default_rpm: int) -> DataFrame:
    """Each address with the limit of its longest matching domain.

    ``limits`` has domain and rpm. A host matches its own domain and those
    above it, so hosts are exploded into their suffixes, few for each, and
    met by equality: the join stays a hash join however many domains there are.
    """
    labels = F.split(F.col("host"), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hosts = urls.select(host(F.col("url")).alias("host")).distinct()
    tried = hosts.select("host", F.explode(suffixes).alias("domain"))
    best = tried.join(limits, "domain").groupBy("host").agg(F.max_by("rpm", F.length("domain")).alias("rpm"))
    return urls.withColumn("host", host(F.col("url"))).join(best, "host", "left").withColumn("rpm", F.coalesce("rpm", F.lit(default_rpm)))
