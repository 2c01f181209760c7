import pytest
from pyspark.sql import functions as F

from postmill.functions import prompts as P
from postmill.operators import fetching, reporting


def values(spark, column, **given):
    frame = spark.range(1).select(*[F.lit(v).alias(k) for k, v in given.items()]) if given else spark.range(1)
    return frame.select(column.alias("x")).first()["x"]


def test_redirects_are_absolute(spark):
    rows = [
        ("https://a.example/x/y", "<script>window.location.href = '/home'</script>", "https://a.example/home"),
        ("https://a.example/x/y", "<script>location.href='z'; window.location.replace(\"/first\")</script>", "https://a.example/first"),
        ("https://a.example/x/y", '<meta http-equiv="refresh" content="0; url=https://b.example/ ">', "https://b.example/"),
        ("https://a.example/x/y", "nothing", ""), ("https://a.example/x/y", None, ""),
    ]
    frame = spark.createDataFrame(rows, "url string, html string, want string")
    got = frame.select(fetching.client_redirect(F.col("url"), F.col("html")).alias("got"), "want").collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_bodies_are_decoded(spark):
    rows = [
        ("é中".encode(), "text/html", "u", None, "é中"), ("中文".encode("gbk"), "text/html", "u", "gbk", "中文"), (b"a\xffb", "text/html", "u", "utf-8", "a�b"),
        (b"x", "application/pdf", "u", None, ""), (b"x", None, "u.PDF", None, ""), (None, None, "u", None, ""), (b"x", "t", "u", "no-such-set", "x"),
    ]
    frame = spark.createDataFrame(rows, "body binary, kind string, url string, charset string, want string")
    got = frame.select(fetching.decode_body(F.col("body"), F.col("kind"), F.col("url"), F.col("charset")).alias("got"), "want").collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_headers_and_companies(spark):
    rows = spark.createDataFrame([("https://www.ems.com.cn/a",), ("https://b.example/a",), ("no address",)], "url string")
    got = rows.select(fetching.request_headers(F.col("url"), F.lit("agent")).alias("h"), fetching.company_of(F.col("url")).alias("c"), fetching.browser_retry(F.col("url")).alias("r")).collect()
    assert [r.c for r in got] == ["中国邮政 EMS", "b.example", "其他来源"] and [r.r for r in got] == [True, False, False]
    assert got[0].h["Sec-Fetch-Mode"] == "navigate" and got[1].h["Referer"] == "https://b.example/" and "Referer" not in got[2].h


def test_report_values(spark):
    assert values(spark, P.answer_part(F.lit("问题：x 答案： y "), F.lit("z"))) == "y"
    assert values(spark, P.answer_part(F.lit(" "), F.lit("z"))) == "z" and values(spark, P.answer_part(F.lit(None), F.lit(None))) == "（空）"
    assert values(spark, P.without_trailing_rules(F.lit("a\n---\nb\n\n---\n \n***\n"))) == "a\n---\nb"
    assert values(spark, P.three_places(F.lit(None).cast("double"))) == "-" and values(spark, P.three_places(F.lit(1.23456))) == "1.235"
    assert values(spark, P.listed(P.as_list(F.array(F.lit(" a "), F.lit(" "), F.lit("b"))))) == "a、b" and values(spark, P.flag(F.lit(False))) == "否"
    assert values(spark, P.embedding_query(F.lit("q"), "find")) == "Instruct: find\nQuery:q"


def test_field_profile_is_that_of_the_first_row(spark):
    frame = spark.createDataFrame([(2, "b", [1], True), (1, None, None, False)], "ord int, a string, l array<int>, f boolean")
    got = [(r.field, r.kind) for r in reporting.field_profile(frame, "ord").orderBy("place").collect()]
    assert got == [("ord", "int"), ("a", "NoneType"), ("l", "NoneType"), ("f", "bool")]
    assert reporting.field_profile(frame.limit(0), "ord").collect() == []


def test_no_results_are_an_error(spark):
    schema = "source_file string, success_count int, json_valid boolean, required_ok boolean, risk_hits int, choice_correct boolean, candidate_ms double, agent_ms double"
    with pytest.raises(Exception, match="no results"):
        reporting.candidate_metrics(spark.createDataFrame([], schema), 3).collect()
    got = reporting.candidate_metrics(spark.createDataFrame([("f", 3, True, None, 0, None, 1.0, 2.0)], schema), 3).first()
    assert (got.success_rate, got.required_fields_rate, got.choice_case_count, got.choice_accuracy, got.source_files) == (1.0, 0.0, 0, None, ["f"])


def test_newest_citation_and_identity_examples(spark):
    messages = spark.createDataFrame([(1, 10), (2, 10), (3, 11)], "message_id int, conv_id int")
    cited = spark.createDataFrame([(1, 5, 1, "old"), (2, 5, 2, "new"), (9, 9, 3, "lost")], "message_id int, created_at int, id int, doc string")
    assert [(r.conv_id, r.doc) for r in reporting.newest_citation(messages, cited).collect()] == [(10, "new")]
    schema = "ord int, messages array<struct<role:string,content:string>>, question string, prompt string, user string, answer string, response string, assistant string"
    rows = [(1, [("user", "hi")], None, None, None, None, None, None), (2, None, "", "who\n are", None, None, None, "me"), (3, None, "q", None, None, None, None, None), (4, [], "q", None, None, "a", None, None)]
    got = {r.ord: [(m.role, m.content) for m in r.messages] for r in reporting.identity_examples(spark.createDataFrame(rows, schema), "sys").collect()}
    assert got == {1: [("user", "hi")], 2: [("system", "sys"), ("user", "who are"), ("assistant", "me")]}


def test_statuses(spark):
    rows = spark.createDataFrame([("ok",), ("ok",), ("skip",), (None,)], "status string")
    assert tuple(reporting.status_counts(rows, ["ok", "skip", "fail"]).first()) == (2, 1, 0)
