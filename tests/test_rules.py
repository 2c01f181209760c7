import pytest
from pyspark.sql import functions as F

from postmill.functions import text as T
from postmill.functions.lexicon import fixture_lexicon, reference_lexicon
from postmill.operators import links, policy, support

LEX = reference_lexicon()
ALL = list(LEX.categories)


def one(spark, column, **values):
    names = list(values)
    schema = ", ".join(f"{n} {'double' if isinstance(v, float) else 'string'}" for n, v in values.items())
    return spark.createDataFrame([tuple(values[n] for n in names)], schema).select(column.alias("x")).first()["x"]


def reason(spark, url, html, company="公司"):
    rows = spark.createDataFrame([(url, html)], "url string, html string")
    return policy.page_features(rows, company, ALL, LEX).select("filter_reason", "title", "policy_categories").first()


@pytest.mark.parametrize(
    "url, html, want",
    [
        ("https://a.cn/x/y/z", "<title>提示</title>您访问的URL有可能对网站造成安全威胁", policy.WAF),
        ("https://a.cn/x/login", "<p>x</p>", policy.LOGIN),
        ("https://a.cn/x/y/z", "报价查询 发件人省份 寄达国 业务产品", policy.QUOTE),
        ("https://a.cn/x/y/z", "11183在线客服 扫描二维码关注 自助服务 查邮件 寄快递 查时限", policy.SERVICE),
        ("https://a.cn/x/y/z", "<p>短</p>", policy.SHORT),
        ("https://a.cn/", "<title>首页</title>" + "无关 内容 文字 " * 40, policy.HOME),
        ("https://a.cn/x/y/z", "<title>联系我们 关于我们 新闻中心</title>" + "无关 内容 文字 " * 40, policy.NOISE),
        ("https://a.cn/x/y/z", "个人服务 企业服务 在线寄件 运单查询 home menu " + "无关 内容 文字 " * 40 + "。", policy.NOISE),
        ("https://a.cn/x/y/z", "无关 内容 文字 " * 40, policy.NO_SIGNAL),
        ("https://a.cn/x/y/z", "本服务条款 " + "无关 内容 文字 " * 40, policy.GENERIC_ONLY),
        ("https://a.cn/x/y/z", "<title>禁寄物品规则</title>" + "禁寄物品 违禁品 说明。" * 20, None),
    ],
)
def test_gate_reasons(spark, url, html, want):
    assert reason(spark, url, html).filter_reason == want


def test_policy_page_has_its_categories(spark):
    got = reason(spark, "https://a.cn/x/y/z", "<title>禁寄规则</title>保价运输 海关清关 " * 10)
    assert got.title == "禁寄规则" and got.policy_categories == ["禁限寄", "国际清关", "邮寄保险"]


def test_insurance_terms(spark):
    text = "客户可选择保价服务，最高赔偿1000元。需在7日内向网点提出索赔，并提供发票、照片和签收证明。现金、珠宝不予承保。"
    got = one(spark, policy.insurance(F.col("t")), t=text)
    assert got.insurance_available and got.insurance_type == "保价"
    assert got.compensation_limit == "最高赔偿1000元" and got.claim_deadline.startswith("7日内")
    assert got.insurance_exclusions == ["现金", "珠宝"] and got.requirements == ["价值证明", "破损照片", "签收证明"]
    menu = one(spark, policy.insurance(F.col("t")), t="首页 保险 产品 服务")
    assert not menu.insurance_available and menu.insurance_type == "未知"


def test_faq_items(spark):
    data = [{"name": "栏", "faqList": [{"id": "7", "question": "q" * 20, "answer": "a&lt;br&gt;" + "b" * 30}, {"id": "8", "question": "q", "answer": "跳转机器人"}]}, {"name": None, "faqList": None}]
    from postmill.sources.readers import FAQ

    import json

    rows = spark.createDataFrame([("u", json.dumps({"data": data}))], "url string, j string").select("url", F.from_json("j", FAQ)["data"].alias("data"))
    got = policy.faq_items(rows).collect()
    assert [r.url for r in got] == ["u#faq-7"] and "a。bbb" in got[0].text and got[0].text.startswith("栏目：栏。问题：")


def test_canonical_urls(spark):
    same = [one(spark, links.canonical_url(F.col("u")), u=u) for u in ("https://Example.com/path?b=2&a=1#x", "HTTPS://example.com/path?a=1&b=2")]
    assert same == ["https://example.com/path?a=1&b=2"] * 2
    assert one(spark, links.canonical_url(F.col("u")), u="http://a.com?q=~*") == "http://a.com/?q=~%2A"


def test_absolute_urls(spark):
    cases = {"/x": "https://a.com/x", "x": "https://a.com/d/x", "//b.com/y": "https://b.com/y", "http://c.com": "http://c.com", "?q=1": "https://a.com/d/p?q=1"}
    for href, want in cases.items():
        assert one(spark, links.absolute_url(F.col("b"), F.col("h")), b="https://a.com/d/p", h=href) == want


def test_policy_links(spark):
    like = lambda u, a: one(spark, links.policy_like(F.col("u"), F.col("a")), u=u, a=a)
    assert like("https://a.com/terms/x", "") and like("https://a.com/x", "禁寄规则") and like("https://a.com/f.pdf", "guide")
    assert not like("https://a.com/x.css", "禁寄规则") and not like("https://a.com/login/terms", "") and not like("https://a.com/x", "guide")
    inside = lambda u, d: one(spark, links.allowed_domain(F.col("u"), d), u=u)
    assert inside("https://m.a.com/x", ["a.com"]) and not inside("https://ba.com/", ["a.com"]) and inside("https://z.cn/", [])
    assert not inside("https://a.com:8080/", ["a.com"])


def test_rate_limits_prefer_the_longest_domain(spark):
    limits = spark.createDataFrame([("a.com", 5), ("m.a.com", 2)], "domain string, rpm int")
    urls = spark.createDataFrame([("https://m.a.com:1/x",), ("https://z.a.com",), ("https://b.com",), ("no url",)], "url string")
    assert sorted(r.rpm for r in links.rate_limits(urls, limits, 9).collect()) == [2, 5, 9, 9]


def test_text_functions(spark):
    t = F.col("t")
    assert one(spark, T.collapse(t), t=" a　 b\n") == "a b"
    assert one(spark, T.content_hash(t), t="a  b") == one(spark, T.content_hash(t), t=" a b ")
    assert one(spark, T.published_at(t), t="x 2024.1.2 y 2023年5月6日") == "2023年5月6日"
    assert one(spark, T.pdf_title(t, F.lit("C")), t="https://a.com/d/file.pdf?x=1") == "file.pdf"
    assert one(spark, T.summary(t), t="short. this is long enough. and this one is too!") == "this is long enough。and this one is too"
    assert one(spark, T.srt_time(F.col("t")), t=1.9996) == "00:00:01,999"
    assert one(spark, T.choice(t), t="答案：b") == "B" and one(spark, T.choice(t), t="无") == ""
    assert one(spark, T.generated_body(t), t="x\n==========\nbody\nPrompt: 3\n==========\ny") == "body"
    assert one(spark, T.chunks(t, 3), t="abcdefg") == ["abc", "def", "g"] and one(spark, T.chunks(t, 3), t="") == [""]
    assert one(spark, T.display_norm(t), t="用户 询问 邮寄 的 信息 ， 客服 回复 。") == "用户询问邮寄的信息，客服回复。"
    assert one(spark, T.display_norm(t), t="用户[1]: a客服[2]: b") == "用户[1]: a\n客服[2]: b"
    assert one(spark, T.slug(t), t="a b/ç 邮政!") == "a-b-ç-邮政" and one(spark, T.slug(t), t="!!") == "section"
    assert one(spark, T.code_fence(t), t="```json\n{}\n```") == "{}"
    assert one(spark, T.title(t, F.lit("C")), t="<TITLE x> a &amp; b\n</title>") == "a & b" and one(spark, T.title(t, F.lit("C")), t="<title> </title>") == "C"


def test_routes(spark):
    route = lambda t: one(spark, support.route(F.col("t"), LEX), t=t)
    assert [route(t) for t in ("你好", "邮寄危险品需要什么材料和官方依据", "包裹什么时候派送", "谢谢，怎么理赔", None)] == ["DIRECT", "STRONG_RAG", "LIGHT_RAG", "DIRECT", "LIGHT_RAG"]
    assert one(spark, support.route_profile(F.col("t")), t=" light_rag ") == ("light", 3) and one(spark, support.route_profile(F.col("t")), t="?") == ("strong", 6)


def test_tickets(spark):
    outputs = [
        '```json\n{"timestamp": "t", "issue_type": "Large item shipping", "summary": "done", "user_request": "寄件", "need_follow_up": true}\n```',
        '{"timestamp": "t", "other": 1}', '{"summary": "x"}', "nothing", '{"timestamp": "t", "issue_type": "tracking"}',
    ]
    got = support.parse_tickets(spark.createDataFrame(list(enumerate(outputs)), "id int, output string")).orderBy("id").collect()
    assert [r.error for r in got] == [None, "unknown field", "timestamp is missing", "not a JSON object", None]
    assert (got[0].ticket.issue_type, got[0].ticket.user_request, got[0].ticket.summary, got[0].ticket.need_follow_up) == ("大件寄递咨询", "寄件", support.SUMMARY_TEXT, True)
    assert got[4].ticket.issue_type == "物流查询" and got[4].ticket.service_type == "邮政客服"


def test_fixture_lexicon_reaches_several_rules(spark):
    from postmill.plans.pages import pages_reason_counts

    assert pages_reason_counts(spark, "/root/testdata/sf0.01").count() >= 4
    assert set(fixture_lexicon().categories) == {"fees", "customs", "packing", "terms"}
