import random
import shutil
from pathlib import Path
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from postmill import session
from postmill.operators import dedup, dialogue, frames, index, links, reduction, retrieval, subtitles, support
from postmill.plans.flows import REFERENCES
from postmill.sources import readers, runs, sinks
from postmill.streaming import once, unseen


SEEN = "i long, u string, p string"


def kept_one_by_one(rows):
    urls, prints, out = set(), set(), []
    for i, url, mark in sorted(rows):
        if (url is None or url not in urls) and (mark is None or mark not in prints):
            urls.add(url)
            prints.add(mark)
            out.append(i)
    return out


@pytest.mark.parametrize("most", [50_000, 30])
def test_long_chains_of_choices_are_decided_in_few_rounds(spark, monkeypatch, most):
    monkeypatch.setattr(dedup, "COMPONENT_ROWS", most)
    chain = lambda n, name, start: [(start + i, f"{name}u{i // 2}", f"{name}p{(i + 1) // 2}") for i in range(n)]
    rows = chain(600 if most > 30 else 24, "a", 0) + chain(12, "b", 1000) + [(2000, None, None), (2001, "au0", None), (2002, None, "ap0"), (2003, "bu1", "bp3")]
    got = dedup.keep_unseen(spark.createDataFrame(rows, SEEN), "i", "u", "p")
    assert sorted(r.i for r in got.collect()) == kept_one_by_one(rows)


def random_rows(n, seed):
    rng = random.Random(seed)
    return [(i, rng.choice([None, *(f"u{k}" for k in range(n // 5))]), rng.choice([None, *(f"p{k}" for k in range(n // 5))])) for i in range(n)]


def test_a_stream_in_any_cut_keeps_what_the_loop_keeps(spark, tmp_path):
    rows, rng = random_rows(200, 1), random.Random(2)
    cuts = [0, *sorted(rng.sample(range(1, 200), 3)), 200]
    inbox, folder = f"{tmp_path}/in", f"{tmp_path}/out"
    spark.createDataFrame([], SEEN).write.parquet(inbox)
    for n, (b, e) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        query = unseen.keep_unseen_stream(spark.readStream.schema(SEEN).parquet(inbox), "i", "u", "p", folder, 2)  # also a restart for each cut
        spark.createDataFrame(rows[b:e], SEEN).write.mode("append").parquet(inbox)
        query.processAllAvailable()
        query.stop()
        if n == 1:  # the batch was written, but its commit was lost
            last = max((Path(folder) / "checkpoint/commits").glob("[0-9]*"), key=lambda p: int(p.name))
            last.unlink()
            last.with_name(f".{last.name}.crc").unlink(missing_ok=True)
    assert sorted(r.i for r in unseen.kept_rows(spark, folder).collect()) == kept_one_by_one(rows)


def test_late_rows_are_released_in_order(spark, tmp_path):
    schema = "i long, ts timestamp"
    inbox, folder = f"{tmp_path}/in", f"{tmp_path}/out"
    rows = [(i, f"2024-01-01 {i // 60:02d}:{i % 60:02d}:00") for i in range(600)]
    write = lambda part: spark.createDataFrame(part, "i long, t string").select("i", F.col("t").cast("timestamp").alias("ts")).write.mode("append").parquet(inbox)
    write(rows[:200:2])
    query = unseen.release_to(spark.readStream.schema(schema).parquet(inbox), "ts", "i", "4 hours", "10 minutes", folder)
    seen = []
    for part in (rows[1:200:2], rows[200:400], rows[400:], [(600, "2024-01-02 00:00:00")], [(601, "2024-01-02 00:01:00")]):
        write(part)
        query.processAllAvailable()
        now = sorted(r.i for r in spark.read.schema(schema).parquet(f"{folder}/released").collect())
        assert now[: len(seen)] == seen  # nothing comes before what was released
        seen = now
    query.stop()
    assert seen == list(range(600))


@pytest.mark.parametrize("size", [1, 2, 7, 64, 10_000])
def test_frames_cut_anywhere_read_back_equal(spark, size):
    rng = random.Random(size)
    data = lambda: "".join(rng.choice("a:\\é中 \"{}") for _ in range(rng.randrange(1, 30))).strip() or "x"
    rows = [(k, i, rng.choice(["delta", "done"]), data()) for k in range(3) for i in range(12)]
    events = spark.createDataFrame(rows, "k long, i long, event string, data string")
    chunks = frames.cut(frames.encoded(events), "k", ["i"], size)
    if size == 7:
        assert chunks.agg(F.max(F.length("text"))).first()[0] == 7
    assert sorted(map(tuple, frames.records(chunks, "k", "chunk").collect())) == sorted(rows)


def test_frames_by_the_standard(spark, monkeypatch):
    text = ": comment\r\n\r\nevent: a\r\nevent: b\r\ndata: one\r\ndata:two\r\ndata\r\n\r\nevent: none\n\ndata:  spaced: x\nid: 7\n\nevent: cut\ndata: lost"
    monkeypatch.setattr(frames, "BUCKET", 3)
    for size in (1, 3, 100):
        chunks = [("s", i, text[i * size : (i + 1) * size]) for i in range(len(text) // size + 1)] + [("t", 0, None)]
        got = frames.records(spark.createDataFrame(chunks, "k string, n long, text string"), "k", "n").collect()
        assert [(r.event, r.data) for r in sorted(got, key=lambda r: r.record)] == [("b", "one\ntwo\n"), ("message", " spaced: x")]


def test_completion_frames(spark):
    rows = spark.createDataFrame([(1, "abcde"), (2, "")], "id long, text string")
    chunks = frames.cut(frames.completion_frames(rows, "id", "text", "m", 2), "id", ["seq"], 13)
    got = frames.records(chunks, "id", "chunk").orderBy("id", "record").collect()
    assert [r.data for r in got if r.data == frames.DONE] == [frames.DONE] * 2
    said = spark.createDataFrame([(r.data,) for r in got if r.id == 1 and r.data != frames.DONE], "d string").select(F.get_json_object("d", "$.choices[0].delta.content").alias("c"), F.get_json_object("d", "$.choices[0].finish_reason").alias("f")).collect()
    assert ["".join(r.c or "" for r in said), said[-1].f, len(said)] == ["abcde", "stop", 5]


def test_an_index_is_loaded_as_written_and_faults_are_errors(spark, sf, tmp_path):
    rows, path = spark.read.parquet(f"{sf}/embeddings.parquet"), f"{tmp_path}/index"
    manifest = index.write_index(rows, path, "m", "p", "vec_id")
    asked = rows.where("vec_id % 40 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    loaded = index.load_index(spark, path)
    assert loaded.manifest == manifest and (manifest.dimensions, manifest.vectors) == (64, rows.count())
    found = lambda df: {(r.query_id, r["rank"], r.vec_id) for r in df.collect()}
    assert found(index.search(loaded, asked, 4)) == found(retrieval.top_k(rows, asked, 4))
    with pytest.raises(index.IndexShapeError):
        index.search(loaded, asked.withColumn("embedding", F.slice("embedding", 1, 3)), 4)
    for odd in (rows.withColumn("embedding", F.when(F.col("vec_id") != 3, F.col("embedding"))), rows.union(rows.limit(1)), rows.withColumn("embedding", F.slice("embedding", 1, 2 + F.col("vec_id").cast("int") % 2))):
        with pytest.raises(index.IndexShapeError):
            index.write_index(odd, f"{tmp_path}/odd", "m", "p", "vec_id")
    rows.limit(5).drop("embedding").write.mode("overwrite").parquet(f"{path}/documents")
    with pytest.raises(index.IndexShapeError):
        index.load_index(spark, path)


def test_search_of_zero_null_and_short_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [0.0, 2.0, 1.0]), (5, [None, 1.0]), (6, [1.0, 0.0])], "vec_id long, embedding array<double>")
    got = retrieval.top_k(rows, spark.createDataFrame([(9, [2.0])], "query_id long, embedding array<double>"), 4).collect()
    assert [(r.vec_id, round(r.score, 6)) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 1.0), (6, 1.0), (2, 0.0), (3, 0.0)]
    assert retrieval.top_k(rows.limit(0), rows.select(F.col("vec_id").alias("query_id"), "embedding"), 2).count() == 0


META = [{"index": i, "session_id": f"s{i}", "dialogue_id": 10 + i, "turn_count": 2} for i in range(3)]


def test_embedding_metadata_and_keyed_vectors(spark, tmp_path):
    import json

    (tmp_path / "a.json").write_text(json.dumps({"train": META, "policy": META[:1]}))
    (tmp_path / "b.json").write_text(json.dumps(META))
    (tmp_path / "c.json").write_text('"text"')
    both = readers.embedding_metadata(spark, f"{tmp_path}/a.json", "policy")
    assert sorted((r.split, r.pos) for r in both.collect()) == [("policy", 0), ("train", 0), ("train", 1), ("train", 2)]
    bare = readers.embedding_metadata(spark, f"{tmp_path}/b.json", "train")
    assert bare.count() == 3
    with pytest.raises(Exception, match="list or an object of lists"):
        readers.embedding_metadata(spark, f"{tmp_path}/c.json", "train").collect()
    vectors = spark.createDataFrame([("train", i, [float(i)]) for i in range(2)], "split string, index int, embedding array<float>")
    keys = lambda *rows: spark.createDataFrame(rows, "split string, index int, session_id string, dialogue_id int")
    assert [r.embedding for r in index.keyed_vectors(vectors, bare, keys(("train", 1, "s1", 11))).collect()] == [[1.0]]
    for row, what in ((("train", 1, "s2", 11), "session_id"), (("train", 0, "s0", 9), "dialogue_id"), (("train", 2, "s2", 12), "no vector"), (("train", 7, "s", 1), "no vector")):
        with pytest.raises(Exception, match=what):
            index.keyed_vectors(vectors, bare, keys(row)).collect()


def test_line_numbers_over_many_splits(spark, tmp_path):
    rng = random.Random(5)
    for name in ("a.jsonl", "b.jsonl"):
        lines = [rng.choice(["", "  ", *[f'{{"v": "{"x" * rng.randrange(300)}"}}'] * 4]) for _ in range(400)]
        (tmp_path / name).write_text(rng.choice(["\n", "\r\n"]).join(lines))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        for blank in (True, False):
            got = sorted((r.file, r.line, r.text) for r in readers.numbered_lines(spark, str(tmp_path), blank).collect())
            want = []
            for name in ("a.jsonl", "b.jsonl"):
                lines = (tmp_path / name).read_text().split("\n")
                numbered = [(i, t) for i, t in enumerate(lines) if t.strip()]
                want += [(name, i if blank else k, t) for k, (i, t) in enumerate(numbered)]
            assert got == sorted(want)
        (tmp_path / "b.jsonl").write_text('{"v": 1}\n' * 900 + "[1]\n" + '{"v": 1}\n' * 900)
        with pytest.raises(Exception, match=r"b\.jsonl:900:not a JSON object"):
            readers.jsonl_numbered(spark, f"{tmp_path}/b.jsonl", "v string").collect()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def test_a_bad_schema_is_no_empty_table(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("{}\n")
    assert readers.jsonl(spark, f"{tmp_path}/none", "a int").count() == 0
    with pytest.raises(Exception, match="(?i)parse"):
        readers.jsonl(spark, f"{tmp_path}/a.jsonl", "a strange type").count()


def test_run_folders(spark, tmp_path):
    def write(name, text):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)

    line = lambda step, score: f'{{"step": {step}, "score": {score}, "metrics": {{"tasks": {{"safety": {{"risk_rate": {score}}}}}}}}}'
    write("rank_1/logs/train_monitor_1.jsonl", line(900, 1))
    write("rank_1/logs/train_monitor_2.jsonl", "\n".join([line(100, 1), "", line(300, 0.5), '{"step": 400', '{"step": "700"}', '{"step": 2.5}', "[8]", line(200, 0.25)]))
    write("rank_2/logs/train_monitor_1.jsonl", line(500, 1))
    write("rank_2/logs/train_monitor_2.jsonl", "")
    write("rank_4/logs/train_monitor_1.jsonl", line(1000, 2))
    write("rank_1/logs/best_adapter_1.json", '{"best_step": 1, "best_score": 1}')
    write("rank_1/logs/best_adapter_2.json", '{"best_step": 300, "best_score": 0.5, "metrics": {"tasks": {"format": {"json_valid_rate": 0.75}}}}')
    write("rank_1/best_adapter/best_adapter_3.json", '{"best_step": 9, "best_score": 9}')
    write("rank_4/best_adapter/best_adapter_1.json", '{"best_step": 1000, "best_score": 2, "metrics": {"tasks": {}}}')
    write("one_metrics.json", '{"tasks": {"a": {"x": 1}}}')
    write("two_metrics.json", "{}")
    root = str(tmp_path)
    done = {r["rank"]: r.completed for r in runs.completed_steps(spark, root).collect()}
    assert done == {1: 300, 2: 0, 4: 1000}
    plan = runs.resume_plan(spark.createDataFrame([(r,) for r in (1, 2, 3, 4)], "rank int"), runs.completed_steps(spark, root), 1000)
    assert {r["rank"]: r.status for r in plan.collect()} == {1: "resume", 2: "start", 3: "start", 4: "skip"}
    rows = {r["rank"]: r for r in runs.rank_comparison(spark, root).collect()}
    assert (rows[1].best_step, rows[1].json_valid, rows[1].final_score, rows[1].final_safety_risk) == (300, 0.75, 0.25, 0.25)
    assert (rows[4].best_step, rows[4].json_valid, rows[4].final_score) == (1000, 0.0, 2.0)
    assert {r.label: r.report for r in runs.metrics_files(spark, root).collect()} == {"one": '{"tasks": {"a": {"x": 1}}}', "two": "{}"}
    write("bad_metrics.json", "[1]")
    with pytest.raises(Exception, match="bad_metrics.json is not a JSON object"):
        runs.metrics_files(spark, root).collect()


def test_summaries_in_rounds(spark):
    rows = spark.createDataFrame([(1, "abcdefghij" * 9), (2, "short"), (3, ""), (4, None), (5, "x" * 10)], "k long, t string")
    asked = spark.sparkContext.accumulator(0)

    def model(prompts):
        asked.add(len(prompts))
        return [p.removeprefix("S:").removeprefix("M:")[:4] for p in prompts]

    first, merge = (lambda c: F.concat(F.lit("S:"), c)), (lambda c: F.concat(F.lit("M:"), c))
    got = {r.k: r for r in reduction.summarised(rows, "k", "t", 10, first, merge, model).collect()}
    assert {k: r.rounds for k, r in got.items()} == {1: 5, 2: 1, 3: 0, 4: 0, 5: 1}
    assert (got[2].summary, got[5].summary, got[4].summary) == ("shor", "xxxx", "") and got[1].summary == "【片段1"
    assert asked.value == 9 + 5 + 3 + 2 + 1 + 2
    whole = reduction.summarised(rows, "k", "t", 10, lambda c: c, lambda c: c, lambda p: p, lambda parts: F.array_join(parts, "")).collect()
    assert {r.k: r.summary for r in whole} == {1: "abcdefghij" * 9, 2: "short", 3: "", 4: "", 5: "x" * 10}

    def fails(prompts):
        raise ValueError("gone")

    with pytest.raises(Exception, match="no summary: gone"):
        reduction.summarised(rows, "k", "t", 10, first, merge, fails).collect()


def test_parts_are_marked(spark):
    row = spark.createDataFrame([(["a", "b"],)], "p array<string>").select(reduction.marked(F.col("p")).alias("m")).first()
    assert row.m == "【片段1】\na\n\n【片段2】\nb"


def test_tickets_are_made_once_however_often_a_batch_runs(spark, tmp_path):
    schema, folder, inbox = StructType.fromDDL("k long, v double"), f"{tmp_path}/made", f"{tmp_path}/in"
    make = lambda rows: rows.select("k", F.rand().alias("v"))  # noqa: E731  a model that never answers alike
    run = lambda: once.make_once(spark.readStream.schema("k long, n long").parquet(inbox), "k", ["n"], make, folder, schema).awaitTermination()
    send = lambda rows: spark.createDataFrame(rows, "k long, n long").write.mode("append").parquet(inbox)
    send([(1, 1), (1, 2), (2, 1), (None, 1)])
    run()
    first = {r.k: r.v for r in once.stored(spark, folder).collect()}
    assert set(first) == {1, 2}
    for commit in (Path(folder) / "checkpoint/commits").glob("*0*"):  # written, but the commit was lost
        commit.unlink()
    run()
    send([(2, 5), (3, 1), (3, 1)])
    run()
    rows = once.stored(spark, folder).collect()
    assert len(rows) == 3 and {r.k: r.v for r in rows if r.k != 3} == first


def test_references_resolve_as_the_standard_library_does(spark):
    bases = ["http://h.example", "http://h.example/", "http://h.example/a/b/c?q=2#f", "https://h.example:8/a//b/./../d/", "http://h.example/a/../b"]
    refs = [r for r in REFERENCES if r != "g;x=1/../y"] + ["a/./", "x//y", "../..", "../../../", "a/b/../../c", "?#", "//h2.example", "/../../g/"]
    rows = spark.createDataFrame([(b, r) for b in bases for r in refs], "b string, r string").select("b", "r", links.absolute_url(F.col("b"), F.col("r")).alias("u")).collect()
    bare = lambda u: u.rstrip("#?") if u.endswith(("#", "?")) else u  # noqa: E731  an empty query or fragment is the same address
    wrong = [(x.b, x.r, x.u, urljoin(x.b, x.r)) for x in rows if bare(x.u) != bare(urljoin(x.b, x.r)) and not (x.r in ("", "?#", "#top"))]
    assert wrong == []


def test_subtitle_folders_and_the_files_made_of_them(spark, tmp_path):
    block = lambda n, *lines: "\n".join([str(n), "0 --> 1", *lines])
    texts = {
        "a.srt": block("x1", "你好", "hello") + "\n\n\n\n" + block(2, "again"), "b.srt": block(1, "only"), "c.en.srt": block(1, "only"), "d.zh.srt": block(1, "你好", "both"), "e.zh.srt": block(1, "你好"),
        "f.srt": "", "g.srt": "\n\n".join([block(i, "one", "two") for i in range(5)] + [block(6, "你好", "late")]), "h.srt": "1\nno text", "k.txt": block(1, "other"),
    }
    for name, text in texts.items():
        (tmp_path / "deep").mkdir(exist_ok=True)
        (tmp_path / ("deep" if name < "c" else ".") / name).write_text(text)
    files = readers.whole_texts(spark, str(tmp_path), "*.srt")
    got = {r.file: r.bilingual for r in subtitles.subtitle_sets(files).collect()}
    assert got == {"a.srt": True, "b.srt": False, "e.zh.srt": False, "g.srt": False}
    entries = subtitles.parse_srt_loosely(files.where("file = 'a.srt'"))
    out = f"{tmp_path}/out"
    sinks.write_files(subtitles.split_lines(entries).withColumn("line", F.struct("pos", "line")), out)
    assert Path(out, "a.zh.srt").read_text() == "x1\n0 --> 1\n你好\n\n2\n0 --> 1\n\n\n"
    assert Path(out, "a.en.srt").read_text() == "x1\n0 --> 1\nhello\n\n2\n0 --> 1\nagain\n\n"
    said = entries.select("file", "pos", F.concat(F.lit("T"), F.col("pos").cast("string")).alias("said"))
    both = subtitles.bilingual_lines(entries.withColumn("text", F.lit("en")), said)
    sinks.write_files(both.select(F.col("file").alias("name"), F.struct("pos", "line").alias("line"), "text"), out)
    assert Path(out, "a.srt").read_text() == "x1\n0 --> 1\nT0\nen\n\n2\n0 --> 1\nT1\nen\n\n"
    assert sorted(p.name for p in Path(out).iterdir() if p.suffix == ".srt") == ["a.en.srt", "a.srt", "a.zh.srt"]
    shutil.rmtree(out)


def test_the_driver_does_not_work_on_each_file_that_is_written(spark, tmp_path, monkeypatch):
    calls, client = [], spark.sparkContext._gateway._gateway_client
    send = type(client).send_command
    monkeypatch.setattr(type(client), "send_command", lambda self, command, *a, **k: (calls.append(command), send(self, command, *a, **k))[1])

    def driver_calls(n):
        lines = spark.range(3 * n).select(F.format_string("d%d/c%d.srt", F.col("id") % n % 3, F.col("id") % n).alias("name"), F.col("id").alias("line"), F.col("id").cast("string").alias("text"))
        before = len(calls)
        sinks.write_files(lines, f"{tmp_path}/{n}")
        made = sum(not command.startswith("m\n") for command in calls[before:])
        got = {r.file: r.text for r in readers.whole_texts(spark, f"{tmp_path}/{n}", "*.srt").collect()}
        assert got == {f"c{i}.srt": f"{i}\n{i + n}\n{i + 2 * n}\n" for i in range(n)}
        return made

    assert driver_calls(100) < driver_calls(10) + 30


@pytest.mark.parametrize("store", ["", "viewfs://files"])
def test_named_files_of_odd_rows(spark, tmp_path, monkeypatch, store):
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.files.link./odd", f"file://{tmp_path}")
    folder = f"{store}/odd/a b" if store else f"{tmp_path}/a b"
    long = [("long.txt", i, "x" * 9) for i in range(25_000)]
    odd = [("a=1/é%20.txt", 2, None), ("a=1/é%20.txt", 1, "one\ntwo"), (None, 1, "none"), ("", 2, "blank"), ("old.txt", 1, "new")]
    schema = "name string, line int, text string"
    (tmp_path / "a b").mkdir()
    spark.createDataFrame([("old", "x" * 900)], "k string, value string").select("value").coalesce(1).write.text(f"file://{tmp_path}/was")
    for part in (tmp_path / "was").glob("*part-*"):
        part.rename(tmp_path / "a b" / (".old.txt.crc" if part.suffix == ".crc" else "old.txt"))
    monkeypatch.setattr(sinks, "fresh_path", lambda spark, label: f"{store}/odd/{label}")
    sinks.write_files(spark.createDataFrame(long + odd, schema), folder)
    found = {str(p.relative_to(tmp_path / "a b")): p.read_text() for p in (tmp_path / "a b").rglob("*") if p.is_file() and p.suffix != ".crc"}
    assert found == {"long.txt": ("x" * 9 + "\n") * 25_000, "a=1/é%20.txt": "one\ntwo\n\n", sinks.NAMELESS: "none\nblank\n", "old.txt": "new\n"}
    assert readers.whole_texts(spark, folder, "old.txt").first().text == "new\n"
    sinks.write_files(spark.createDataFrame([], schema), f"{folder}/none")
    assert readers.whole_texts(spark, f"{folder}/none", "*").collect() == []


def test_conversations_are_made_or_found(spark, monkeypatch):
    monkeypatch.setattr(dialogue, "REQUEST_BUCKET", 2)
    known = spark.createDataFrame([(4,), (9,)], "conversation_id long")
    rows = spark.createDataFrame([(1, None, "a"), (2, 4, "b"), (5, 0, "c"), (6, None, "d"), (7, 9, "e")], "request_id long, conversation_id long, message string")
    created, messages = dialogue.conversation_writes(rows, known)
    assert sorted(r.conversation_id for r in created.collect()) == [10, 11, 12]
    assert {r.request_id: r.conversation_id for r in messages.collect()} == {1: 10, 2: 4, 5: 11, 6: 12, 7: 9}
    with pytest.raises(Exception, match="no conversation 3"):
        dialogue.conversation_writes(spark.createDataFrame([(1, 3, "a")], rows.schema), known)[1].collect()
    first = dialogue.conversation_writes(rows.limit(1), known.limit(0))[1].first()
    assert first.conversation_id == 1


def test_titles_and_error_rows(spark):
    rows = spark.createDataFrame([("q" * 30, None), ("q", ' "A title" '), ("q", "''"), (None, None)], "q string, r string")
    assert [r.t for r in rows.select(dialogue.made_title(F.col("q"), F.col("r")).alias("t")).collect()] == ["q" * 20, "A title", dialogue.UNTITLED, dialogue.UNTITLED]
    messages = spark.createDataFrame([(1, "2024", "user", "hi")], "conversation_id long, created_at string, role string, content string")
    errors = spark.createDataFrame([(1, "2025", "gone")], "conversation_id long, created_at string, message string")
    out = dialogue.with_error_rows(messages, errors).orderBy("created_at").collect()
    assert [(r.role, r.content, r.metadata) for r in out] == [("user", "hi", None), ("system", "gone", '{"kind":"error"}')]


def test_a_tuned_model_must_be_named(spark):
    pair = lambda p, m: F.struct(F.lit(p).alias("provider"), F.lit(m).alias("model"))
    rows = spark.createDataFrame([(True,), (False,)], "tuned boolean")
    chosen = lambda other: [tuple(r.c) for r in rows.select(support.model_choice(F.col("tuned"), pair("a", "m"), other).alias("c")).collect()]
    assert chosen(pair("b", "n")) == [("b", "n"), ("a", "m")]
    with pytest.raises(Exception, match="no tuned model"):
        chosen(pair("b", None))
    assert [tuple(r.c) for r in rows.select(support.model_metadata(F.col("tuned"), pair("a", "m"), pair("b", "")).alias("c")).collect()] == [("", ""), ("a", "m")]


def test_outputs_stay_unless_there_is_something_new(spark, tmp_path):
    a, b = f"{tmp_path}/a", f"{tmp_path}/b"
    rows = spark.createDataFrame([(1,)], "v int")
    assert sinks.replace_outputs({a: rows, b: rows}, a)
    assert not sinks.replace_outputs({a: rows.limit(0), b: rows.union(rows)}, a)
    assert [spark.read.parquet(p).count() for p in (a, b)] == [1, 1]


def test_call_logs_are_appended_by_day_and_media_listed(spark, tmp_path):
    calls = spark.createDataFrame([("2024-01-01 10:00:00.0425", "q/7b", 1), ("2024-01-02 00:00:00", None, 2)], "t string, model string, n int").select(F.col("t").cast("timestamp").alias("ts"), "model", "n")
    rows = sinks.call_log_rows(calls)
    assert [r.name for r in rows.orderBy("name").collect()] == ["20240101_100000_042_q_7b.json", "20240102_000000_000_unknown-model.json"]
    for _ in range(2):
        sinks.write_call_log(rows, f"{tmp_path}/log")
    back = spark.read.json(f"{tmp_path}/log")
    assert back.count() == 4 and {str(r.day) for r in back.select("day").distinct().collect()} == {"2024-01-01", "2024-01-02"}
    for name in ("a.mp4", "b.TXT", "c.wav"):
        (tmp_path / name).write_text("x")
    named = lambda df: sorted(Path(r.path).name for r in df.collect() if "/log/" not in r.path)
    assert named(readers.media_files(spark, str(tmp_path), without=[".txt"])) == ["a.mp4", "c.wav"]
    assert named(readers.media_files(spark, str(tmp_path), ["MP4", "txt"])) == ["a.mp4", "b.TXT"]


def test_scratch_tables_go_when_their_work_is_done(spark):
    rows = spark.range(3)
    with session.scratch(spark):
        path = session.fresh_path(spark, "x")
        inside = session.materialise(rows, "y")
        assert inside.count() == 3 and "/scratch-" in path
    with pytest.raises(Exception, match="(?i)not.exist|no such"):
        inside.count()
    assert "/scratch-" not in session.fresh_path(spark, "x")
