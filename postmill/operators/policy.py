"""Pages to policy records: categories, the decision list and insurance terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions import text as T
from postmill.functions.lexicon import LOGIN_MARKERS, QUOTE_MARKERS, SERVICE_MARKERS, WAF_MARKERS, Lexicon

# Reasons, insurance patterns and labels.
SHORT, HOME, NOISE, NAVIGATION = "正文过短", "首页导航特征过强", "页面噪声过高", "导航页特征过强"
NO_SIGNAL, GENERIC_ONLY = "政策信号不足", "泛条款信号不足"
WAF, LOGIN, QUOTE, SERVICE = "WAF阻断页", "登录页", "报价工具页", "客服导航页"
INSURANCE_CONTEXT = ["保价", "声明价值", "insured", "insurance coverage", "shipment insurance", "赔偿", "赔付", "理赔", "索赔", "免责", "损失", "丢失", "破损"]
LIABILITY_CONTEXT = ["loss", "damage", "claim", "compensation", "赔偿", "理赔", "索赔"]
GENERIC_INSURANCE_CONTEXT = ["赔偿", "赔付", "理赔", "索赔", "声明价值", "保价", "丢失", "破损"]
LIMIT_PATTERNS = [r"最高赔偿[^。；;\n]*", r"赔偿上限[^。；;\n]*", r"责任限额[^。；;\n]*", r"up to [^.;\n]*"]
DEADLINE_PATTERNS = [r"\d+\s*日内[^。；;\n]*提出[^。；;\n]*", r"\d+\s*天内[^。；;\n]*索赔[^。；;\n]*", r"claim[^.;\n]*within[^.;\n]*"]
EXCLUSIONS = {"现金": ["现金", "currency"], "珠宝": ["珠宝", "jewelry"], "易碎品": ["易碎", "fragile"], "活体": ["活体", "live animals"], "危险品": ["危险品", "dangerous goods"], "生鲜": ["生鲜", "perishable"]}
REQUIREMENTS = {"价值证明": ["发票", "价值证明", "invoice"], "破损照片": ["照片", "破损图", "damage photo"], "签收证明": ["签收证明", "proof of delivery"], "温控记录": ["温控记录", "temperature record"]}


def labels_by_keyword(text: Column, table: dict[str, list[str]]) -> Column:
    """Labels of ``table``, in its order, that have a keyword in the text."""
    return F.array_compact(F.array(*[F.when(T.has_any(text, words), F.lit(label)) for label, words in table.items()]))


def categories(text: Column, allowed: list[str], lexicon: Lexicon) -> Column:
    """Allowed topics found in the text, or the generic one if its words occur."""
    known = {t: lexicon.categories[t] for t in allowed if t in lexicon.categories}
    found = labels_by_keyword(text, known) if known else F.array().cast("array<string>")
    generic = F.when(T.has_any(text, lexicon.categories[lexicon.generic]), F.array(F.lit(lexicon.generic)))
    return F.when(F.size(found) > 0, found).otherwise(F.coalesce(generic, F.array().cast("array<string>")))


def utility_reason(url: Column, title: Column, plain: Column) -> Column:
    """Reason for blocked, login, quote and service pages; null for others."""
    seen = F.concat_ws(" ", title, F.substring(plain, 1, 2500))
    low = F.lower(url)
    return (
        F.when(T.has_any(seen, WAF_MARKERS), F.lit(WAF))
        .when(F.contains(low, F.lit("login")) | (T.keyword_hits(seen, LOGIN_MARKERS) >= 4), F.lit(LOGIN))
        .when(F.contains(low, F.lit("toquoteindex")) | (T.keyword_hits(seen, QUOTE_MARKERS) >= 4), F.lit(QUOTE))
        .when(T.keyword_hits(seen, SERVICE_MARKERS) >= 6, F.lit(SERVICE))
    )


def filter_reason(lexicon: Lexicon) -> Column:
    """Why a page with the columns of :func:`page_features` is left out; null to keep it.

    The first rule that holds gives the reason.
    """
    hard, signals, noise = F.col("hard_title"), F.col("policy_signals"), F.col("noise_hits")
    cats = F.col("policy_categories")
    meaningful = F.exists(cats, lambda c: c != lexicon.generic)
    bare = F.regexp_replace("url", "/+$", "")
    shallow = F.length(bare) - F.length(F.replace(bare, F.lit("/"), F.lit(""))) <= 2
    homely = F.contains(F.col("title"), F.lit("首页")) | F.contains(F.col("title"), F.lit("Home")) | (noise >= 4)
    menu = T.keyword_hits(F.concat_ws(" ", F.substring("plain_text", 1, 1500), "summary"), lexicon.menu) >= 6
    only_generic = (F.size(cats) == 1) & (F.get(cats, F.lit(0)) == lexicon.generic)
    insured = T.keyword_hits(F.col("plain_text"), lexicon.insurance)
    return (
        F.when(F.col("utility").isNotNull(), F.col("utility"))
        .when((F.length("plain_text") < 120) & (signals < 4) & ~hard & ~meaningful, F.lit(SHORT))
        .when(shallow & homely & ~hard, F.lit(HOME))
        .when((noise >= 3) & ~hard, F.lit(NOISE))
        .when(menu & ~hard, F.lit(NAVIGATION))
        .when((F.size(cats) == 0) & (signals < 4) & ~hard, F.lit(NO_SIGNAL))
        .when(only_generic & ~hard & (signals < 4), F.lit(GENERIC_ONLY))
        .when(~meaningful & ~hard & (insured < 2) & (signals < 5), F.lit(NO_SIGNAL))
    )


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that later expressions read as values.

    Passing them through a generator keeps the optimiser from copying costly
    expressions into every place that refers to them.
    """
    made = F.struct(*[c.alias(n) for n, c in columns.items()])
    kept = [c for c in df.columns if c not in columns]
    return df.select(*[c for c in df.columns if c not in columns], F.explode(F.array(made)).alias("__made")).select(*kept, "__made.*")


def page_features(pages: DataFrame, company: str, allowed: list[str], lexicon: Lexicon) -> DataFrame:
    """Text features of pages (url, html, ...) and the filter reason, all from built-ins.

    A null html is an empty page, a null url an empty address.
    """
    html = F.coalesce("html", F.lit(""))
    out = computed(pages, url=F.coalesce("url", F.lit("")), plain_text=T.strip_html(html), title=T.title(html, F.lit(company)))
    out = computed(out, summary=T.summary(F.col("plain_text")), seen=F.concat_ws(" ", "title", "plain_text"))
    seen = F.col("seen")
    out = computed(
        out,
        policy_categories=categories(seen, allowed, lexicon),
        policy_signals=T.keyword_hits(seen, lexicon.signals),
        noise_hits=T.keyword_hits(F.concat_ws(" ", "title", "summary"), lexicon.noise),
        hard_title=T.has_any(F.col("title"), lexicon.hard_titles),
        utility=utility_reason(F.col("url"), F.col("title"), F.col("plain_text")),
    ).drop("seen")
    return out.withColumn("filter_reason", filter_reason(lexicon))


def insurance(text: Column) -> Column:
    """Availability, kind, limit, deadline, exclusions and requirements of insurance."""
    liability = T.has_any(text, ["liability"]) & T.has_any(text, LIABILITY_CONTEXT)
    generic = F.contains(text, F.lit("保险")) & T.has_any(text, GENERIC_INSURANCE_CONTEXT)
    declared = F.contains(text, F.lit("声明价值")) | T.has_any(text, ["declared value"])
    shipment = T.has_any(text, ["shipment insurance"])
    insured = F.contains(text, F.lit("保价"))
    available = (T.keyword_hits(text, INSURANCE_CONTEXT) >= 2) | insured | declared | shipment | liability | generic
    kind = (
        F.when(~available, F.lit("未知")).when(declared, F.lit("声明价值")).when(insured, F.lit("保价"))
        .when(generic | shipment, F.lit("运输保险")).when(liability, F.lit("承运商责任")).otherwise(F.lit("未知"))
    )
    return F.struct(
        available.alias("insurance_available"),
        kind.alias("insurance_type"),
        T.first_match(text, LIMIT_PATTERNS).alias("compensation_limit"),
        T.first_match(text, DEADLINE_PATTERNS).alias("claim_deadline"),
        labels_by_keyword(text, EXCLUSIONS).alias("insurance_exclusions"),
        labels_by_keyword(text, REQUIREMENTS).alias("requirements"),
    )


def policy_records(features: DataFrame, source_id: str, company: str) -> DataFrame:
    """Policy records of the kept pages."""
    kept = features.where("filter_reason IS NULL").withColumn("ins", insurance(F.col("plain_text")))
    return kept.select(
        F.lit(source_id).alias("source_id"), F.lit(company).alias("company"), "url", "title", T.published_at(F.col("plain_text")).alias("published_at"),
        "policy_categories", "summary", F.col("plain_text").alias("evidence_text"), "ins.*",
    )


def filtered_pages(features: DataFrame, source_id: str, company: str) -> DataFrame:
    """Audit rows of the pages left out."""
    return features.where("filter_reason IS NOT NULL").select(
        F.lit(source_id).alias("source_id"), F.lit(company).alias("company"), "url", "title", "filter_reason", F.substring("plain_text", 1, 300).alias("excerpt")
    )


def faq_items(faq: DataFrame) -> DataFrame:
    """Question and answer rows of FAQ payloads (url, data), useless ones left out.

    ``data`` is an array of sections with name and faqList; a missing list is
    empty. Entities are decoded before tags go, since tags may be escaped.
    """
    def clean(column: Column) -> Column:
        text = T.unescape_entities(F.coalesce(column, F.lit("")))
        return T.collapse(F.regexp_replace(F.regexp_replace(text, r"(?i)<br\s*/?>", "。"), "<[^>]+>", " "))

    sections = faq.select("url", F.explode("data").alias("section"))
    items = sections.select("url", "section.name", F.explode("section.faqList").alias("item"))
    items = items.select("url", F.coalesce("name", F.lit("常见问题")).alias("section"), F.col("item.id").alias("id"), clean(F.col("item.question")).alias("question"), clean(F.col("item.answer")).alias("answer"))
    useful = (F.col("question") != "") & (F.col("answer") != "") & ~F.col("answer").isin("跳转机器人", "暂无数据")
    items = items.where(useful & (F.length("question") + F.length("answer") >= 40))
    text = F.concat(F.lit("栏目："), "section", F.lit("。问题："), "question", F.lit("。答案："), "answer")
    return items.select(F.concat("url", F.lit("#faq-"), F.coalesce("id", "question")).alias("url"), "question", "answer", text.alias("text"))
