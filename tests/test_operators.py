import json
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from postmill.functions.lexicon import reference_lexicon
from postmill.operators import blocks, crawl, dedup, dialogue, evaluation, graph, markdown, ranges, retrieval, subtitles
from postmill.sources import adapters, readers, sinks
from postmill.streaming import streams


def greedy(rows):
    urls, prints, kept = set(), set(), []
    for o, u, f in rows:
        if (u is not None and u in urls) or (f is not None and f in prints):
            continue
        kept.append(o)
        urls |= {u} - {None}
        prints |= {f} - {None}
    return kept


@given(st.lists(st.tuples(st.sampled_from("abcd"), st.sampled_from("wxyz")), max_size=14))
@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_keep_unseen_equals_a_plain_loop(spark, pairs):
    rows = [(i, u, f) for i, (u, f) in enumerate(pairs)] + [(90, None, "w"), (91, None, None), (92, "u1", "f1"), (93, "u1", "f2"), (94, "u2", "f2")]
    frame = spark.createDataFrame(rows, "o long, u string, f string").repartition(3)
    assert sorted(r.o for r in dedup.keep_unseen(frame, "o", "u", "f").collect()) == greedy(rows)


def test_connected_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7), (None, 3)] + [(200, x) for x in range(201, 260)]
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in (100, 101, 102)} == {100} and {got[i] for i in range(200, 260)} == {200}
    assert graph.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_prefix_sums_and_range_buckets(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", None]), i, rng.randint(0, 5)) for i in range(300)]
    frame = spark.createDataFrame(rows, "g string, i long, v long").withColumn("b", F.floor(F.col("i") / 17))
    want, run = {}, {"a": 0, None: 0}
    for g, i, v in rows:
        want[i] = run[g]
        run[g] += v
    assert {r.i: r.s for r in ranges.prefix_sum(frame, ["g"], "b", ["i"], "v", "s").collect()} == want
    bounds = ranges.range_bounds(frame, "i", 8)
    got = frame.select("i", ranges.range_bucket(F.col("i"), bounds).alias("k")).collect()
    assert all(r.k == sum(b <= r.i for b in bounds) for r in got) and len(bounds) == 7


def test_top_k(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0]), (4, [2.0, 0.0])], "vec_id long, embedding array<float>")
    queries = spark.createDataFrame([(9, [0.9, 0.1])], "query_id long, embedding array<float>")
    got = [(r.vec_id, r.rank) for r in retrieval.top_k(vectors, queries, 3).orderBy("rank").collect()]
    assert got == [(1, 1), (4, 2), (2, 3)]
    assert retrieval.top_k(vectors, queries, 9).where("vec_id = 3").first().score == 0.0


def test_top_k_of_many_queries(spark, sf, monkeypatch):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    asked = rows.where("vec_id % 7 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    want = sorted(retrieval.top_k(rows, asked, 3).collect())
    assert len(want) == 3 * asked.count()
    monkeypatch.setattr(retrieval, "QUERY_ROWS", 4)
    monkeypatch.setattr(retrieval, "BLOCK_ROWS", 9)
    monkeypatch.setattr(blocks, "WAVE", 2)
    found = retrieval.top_k(rows, asked, 3)
    rounded = lambda rows: [(r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in rows]
    plan = found._jdf.queryExecution().toString()
    assert rounded(sorted(found.collect())) == rounded(want) and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_aligned_joins_fail_loudly(spark):
    left = spark.createDataFrame([("t", 0, "s1"), ("t", 1, "s2")], "split string, i int, session string")
    good = spark.createDataFrame([("t", 0, "s1", True), ("t", 1, "s2", None)], "split string, i int, other string, ok boolean")
    assert dialogue.aligned(left, good, ["split", "i"], [("session", "other")]).count() == 2
    assert dialogue.selected(left, good, ["split", "i"], "ok").count() == 1
    for bad in (good.limit(1), good.withColumn("other", F.lit("s1"))):
        with pytest.raises(dialogue.AlignmentError):
            dialogue.aligned(left, bad, ["split", "i"], [("session", "other")])


def test_qa_examples_keep_their_places(spark):
    qa = [{"QueSumm": "", "QASumm": "问", "AnsSummLong": "答 一", "intent": "寄件"}, {"QueSumm": "x", "AnsSummLong": " ", "AnsSummShort": ""}, {"QueSumm": "q", "AnsSummLong": None, "AnsSummShort": "短"}]
    frame = spark.createDataFrame([(json.dumps({"DialogueID": 1, "QA": qa}),)], "j string").select(F.from_json("j", readers.DIALOGUE).alias("d")).select(F.col("d.DialogueID").alias("dialogue_id"), "d.QA")
    got = dialogue.qa_examples(frame).orderBy("qa_index").collect()
    assert [r.qa_index for r in got] == [0, 2]
    assert got[0].messages[0].content == "问\n意图：寄件" and got[1].messages[1].content == "短"


def test_retry_and_citations(spark):
    rows = [(1, 7, "user", "a", 1), (2, 7, "assistant", "b", 2), (3, 7, "user", "c", 3), (4, 7, "assistant", "d", 3), (5, 8, "system", "e", 1)]
    messages = spark.createDataFrame(rows, "id long, conversation_id long, role string, content string, created_at int")
    tickets = spark.createDataFrame([(7, "t"), (8, "u")], "conversation_id long, payload string")
    kept, left = dialogue.retry_last_turn(messages, tickets, "new")
    assert [(r.id, r.content) for r in kept.orderBy("id").collect()] == [(1, "a"), (2, "b"), (3, "new"), (5, "e")]
    assert [r.payload for r in left.collect()] == ["u"]
    cites = spark.createDataFrame([(2, 0.5, 1, "q"), (2, 0.9, 2, "r")], "message_id long, score double, document_id long, quoted_text string")
    got = {r.id: [c.document_id for c in r.citations] for r in dialogue.with_citations(messages, cites).collect()}
    assert got[2] == [2, 1] and got[1] == []
    new, counts = dialogue.upsert(tickets, spark.createDataFrame([(8, "w"), (9, "x")], tickets.schema), ["conversation_id"])
    assert {r.conversation_id: r.payload for r in new.collect()} == {7: "t", 8: "w", 9: "x"} and tuple(counts.first()) == (1, 1)


def test_record_and_task_metrics(spark):
    rows = [
        ("f1", "format", "p", None, '{"category": "寄件", "flag": false}', ["category"], 'x {"类别": "寄 件"} y'),
        ("f2", "format", "p", None, None, ["category"], "no json"),
        ("c1", "ceval_choice", "p", None, "B", None, "答案：b"),
        ("m1", "math", "p", None, "abcd", None, "abxd 快递"),
        ("general_bilingual_001", "bilingual", "p", None, None, None, "运单号"),
        ("s1", "safety", "p", "choice", "A", None, "我们无法保证5天送达。但是今天下午四点以前寄出的一定赔"),
    ]
    got = {r.id: r for r in evaluation.record_metrics(spark.createDataFrame(rows, "id string, task string, prompt string, answer_type string, answer string, required_keys array<string>, output string")).collect()}
    assert (got["f1"].json_valid, got["f1"].json_required_keys_ok, got["f1"].json_value_match_rate, got["f1"].json_exact_match) == (True, True, 1.0, True)
    assert (got["f2"].json_valid, got["f2"].json_required_keys_ok, got["f2"].json_value_match_rate) == (False, False, None)
    assert got["c1"].choice_correct is True and got["m1"].postal_pollution is True and got["general_bilingual_001"].postal_pollution is False
    assert got["m1"].rouge_l_f1 == pytest.approx(2 * 3 / 10) and got["m1"].exact_match is False
    assert got["s1"].risk_hits == 1 and got["s1"].choice_correct is False
    tasks = {r.task: r for r in evaluation.task_metrics(spark.createDataFrame(list(got.values()))).collect()}
    assert tasks["format"].json_valid_rate == 0.5 and tasks["format"].avg_json_value_match_rate == 0.5 and tasks["math"].json_valid_rate is None


def test_recommended_run_and_weights(spark):
    got = {r.model: r.rank for r in evaluation.recommended(spark.createDataFrame([("3b", 1, 3.6, 0.2, 0.8, 0.0), ("3b", 2, 3.9, 0.9, 0.8, 0.0), ("7b", 4, 1.0, 0.9, 0.8, 0.0), ("7b", 2, 1.0, 0.9, 0.8, 0.0)], "model string, rank int, best_score double, score_drop double, json_keys double, safety_risk double"), "model", "rank").collect()}
    assert got == {"3b": 1, "7b": 2}
    rows = spark.createDataFrame([("r", "a", 90.0), ("r", "b", 80.0)], "run string, dimension string, score double")
    assert evaluation.weighted_dimensions(rows, "run", {"a": 0.75, "b": 0.25}).first().overall == 87.5


def test_markdown_sections(spark):
    text = "intro\n## 第一部分：清关\n### A a\n- one\n> two\n---\n1. three\n## 其他\nlost\n### B\n\n### C\nx"
    files = spark.createDataFrame([("1.md", text)], "file string, text string")
    got = markdown.sections(files).orderBy("first_line").collect()
    assert [(r.title, r.category) for r in got] == [("A a", "清关"), ("B", "清关"), ("C", "清关")]
    records = {r.title: r for r in markdown.section_records(markdown.sections(files)).collect()}
    assert records["A a"].summary == "one two three" and records["A a"].uri == "1.md#A-a" and set(records) == {"A a", "C"}


def test_subtitles(spark):
    text = "1\n00:00:01,000 --> 00:00:02,500\nhello\nthere\n\nx\n00\nbad\n\n2\n00\n\n3\n00:00:03,000 --> 00:00:04,000\n你好\n"
    files = spark.createDataFrame([("a.srt", text)], "file string, text string")
    entries = subtitles.parse_srt(files)
    got = entries.orderBy("pos").collect()
    assert [(r.idx, r.text) for r in got] == [(1, "hello\nthere"), (3, "你好")]
    assert subtitles.parse_srt(subtitles.format_srt(entries)).count() == 2
    prompts = subtitles.batches(entries, 2).orderBy("batch").collect()
    assert [p.prompt for p in prompts] == ["1: hello there", "2: 你好"]
    replies = spark.createDataFrame([("a.srt", 0, "1: 一\n1：二\njunk"), ("a.srt", 1, "7: x")], "file string, batch long, reply string")
    merged = subtitles.merge_translations(entries, replies, 2).orderBy("pos").collect()
    assert [r.text for r in merged] == ["二", "你好"]
    assert not subtitles.is_chinese(entries).first().chinese
    assert subtitles.split_languages(entries).orderBy("pos").collect()[1].zh == "你好"


PAGE = "<title>禁寄规则 {0}</title>" + "禁寄物品 违禁品 说明 清关。" * 20


def test_crawl_and_replay(spark):
    site = [
        ("https://a.com/", '<a href="/terms/1">条款</a><a href="/terms/2">条款</a><a href="https://b.com/terms">条款</a><a href="/login">x</a>'),
        ("https://a.com/terms/1", PAGE.format(1) + '<a href="/terms/3">条款</a>'), ("https://a.com/terms/2", PAGE.format(1)), ("https://a.com/terms/3", PAGE.format(3)),
    ]
    fetch = adapters.graph_fetcher(spark.createDataFrame(site, "url string, html string"))
    sources = spark.createDataFrame([("s", "https://A.com")], "source_id string, url string")
    got = crawl.crawl(sources, fetch, depth=2)
    assert sorted((r.depth, r.url[-7:]) for r in got.collect()) == [(0, "/a.com/"), (1, "terms/1"), (1, "terms/2"), (2, "terms/3")]
    assert crawl.crawl(sources, fetch, depth=2, budget=2).count() == 2
    log = got.select(F.xxhash64("url").alias("ord"), "source_id", F.lit("公司").alias("company"), "url", F.lit(True).alias("success"), F.substring("html", 1, 5).alias("text"), F.col("url").alias("raw_text_path"), F.lit("").alias("failure_reason"))
    kept = crawl.parse_fetches(log, got.select(F.col("url").alias("path"), "html"), list(reference_lexicon().categories), reference_lexicon())
    assert kept.count() == 2
    report = {(r.section, r.name): r.n for r in crawl.crawl_report(log, kept).collect()}
    assert report["totals", "total"] == 4 and report["companies", "公司"] == 2 and report["categories", "禁限寄"] == 2
    assert any("- 公司: 2" in r.markdown for r in sinks.report_lines(crawl.crawl_report(log, kept)).collect())


def test_readers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"url": "u1"}\n\n{"url": "u2", "odd": 1}\n')
    assert readers.jsonl(spark, str(tmp_path / "a.jsonl"), "url string").where("url IS NOT NULL").count() == 2
    assert readers.jsonl(spark, str(tmp_path / "none.jsonl"), "url string").count() == 0
    lines = lambda blank: [r.line for r in readers.jsonl_numbered(spark, str(tmp_path / "a.jsonl"), "url string", blank).orderBy("line").collect()]
    assert lines(True) == [0, 2] and lines(False) == [0, 1]
    (tmp_path / "b.jsonl").write_text("[1]\n")
    with pytest.raises(Exception, match="not a JSON object"):
        readers.jsonl_numbered(spark, str(tmp_path / "b.jsonl"), "url string").collect()
    (tmp_path / "v.json").write_text('{"train": [{"index": 0, "ok": true}], "val": []}')
    assert readers.split_verdicts(spark, str(tmp_path / "v.json"), ["train", "val"], "index: int, ok: boolean").count() == 1
    with pytest.raises(ValueError):
        readers.split_verdicts(spark, str(tmp_path / "v.json"), ["train", "test"], "index: int")
    assert readers.yaml_rows(spark, "sources:\n- id: a\n  depth: 2\n- id: b\n", "sources", "id string, depth int").collect()[1].depth is None
    limits = readers.rate_limit_rows(spark.createDataFrame([("a.com", 5, None)], "domain string, rpm int, wait int"), {"rpm": 9, "wait": 1}).first()
    assert (limits.rpm, limits.wait) == (5, 1)


def test_log_rows_and_adapters(spark):
    rows = sinks.fetch_log_rows(spark.createDataFrame([("u", "x" * 1200, bytearray(b"abc"))], "url string, text string, body binary")).first()
    assert len(rows.text) == 1000 and rows.text_truncated and rows.body_bytes == "<bytes:3>"
    asked = spark.createDataFrame([(i, f"p{i}") for i in range(3)], "id int, prompt string")

    def model(prompts):
        if "p1" in prompts:
            raise ValueError("down")
        return [p.upper() for p in prompts]

    got = {r.id: (r.output, r.error) for r in adapters.generate(asked, "prompt", model, 1).collect()}
    assert got == {0: ("P0", None), 1: (None, "down"), 2: ("P2", None)}
    assert adapters.candidates(asked, 3).count() == 9 and adapters.not_yet(asked, asked.where("id = 1"), ["id"]).count() == 2
    assert adapters.embed(asked, "prompt", lambda t: [[1.0, 2.0]] * len(t), 2).first().embedding == [1.0, 2.0]
    status = spark.createDataFrame([(200,), (404,), (429,)], "status_code int").select(adapters.fetch_status().alias("s")).collect()
    assert [(r.s.success, r.s.failure_reason) for r in status] == [(True, ""), (False, "HTTP 404"), (False, "refused")]


def test_streams_equal_batches(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    want = streams.windowed_counts(events).groupBy("event_type").agg(F.sum("n").alias("n"))
    stream = streams.windowed_counts(streams.events_stream(spark, sf))
    query = stream.writeStream.format("memory").queryName("hours").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    got = spark.table("hours").groupBy("event_type").agg(F.sum("n").alias("n"))
    assert sorted(got.collect()) == sorted(want.collect())


def test_best_so_far_stream(spark, tmp_path):
    schema = "label string, step long, score double, gated boolean"
    spark.createDataFrame([("a", 2, 5.0, True), ("a", 1, 1.0, False), ("b", 1, 2.0, False), ("a", 3, 0.5, False)], schema).coalesce(1).write.json(str(tmp_path / "in"))
    query = streams.best_so_far(spark.readStream.schema(schema).json(str(tmp_path / "in"))).writeStream.format("memory").queryName("best").outputMode("update").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(tuple(r) for r in spark.table("best").collect()) == [("a", 1.0, 1), ("b", 2.0, 1)]


def test_append_new_is_repeatable(spark, tmp_path):
    schema = "k int, v string"
    spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], schema).write.json(str(tmp_path / "in"))
    for run in ("one", "two"):
        stream = spark.readStream.schema(schema).json(str(tmp_path / "in"))
        streams.append_new(stream, str(tmp_path / "out"), ["k"], str(tmp_path / run)).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
