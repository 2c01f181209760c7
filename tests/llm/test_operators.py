import base64
import collections
import gzip
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from postmill.llm import chat_format, chunk_dedup, decontaminate, fingerprint, jaccard_join, language, source_mix, token_file, toxicity, warc
from postmill.llm.catalogue import ORACLE, QUERIES, TOKENIZER, op1_language_id, op2_toxicity, op3_token_files
from postmill.llm.common import id_remainder
from tests.oracle import connect, differences

DOCS = "doc_id long, text string, lang string, source string, extra string"
ODD = [(1, None, None, None, "x"), (2, "", "en", "s", None), (3, " \n ", None, "s", "x"), (3, " \n ", None, "s", "x"), (None, "a word", "en", None, "x"), (4, "1234 !?", "en", "s", "")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([*ODD, (5, "the long words " * 20000, "en", "s", "x")], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def crc(doc_id):
    return zlib.crc32(str(doc_id).encode())


def test_language_is_right_on_held_out_rows(spark, sf, docs):
    truth = {r.doc_id: r.lang for r in docs.collect()}
    rows = op1_language_id(spark, sf).collect()
    assert len(rows) == len(truth)
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (crc(r.doc_id) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.9 * len(held)


def test_every_language_is_learned(spark):
    names = [f"l{i:02d}" for i in range(70)]
    word = lambda i, k: "".join(chr(0x4E00 + 97 * i + (k * j) % 50) for j in range(1, 6))
    rows = [(100 * i + k, " ".join(word(i, k + m) for m in range(9)), name, "s", "x") for i, name in enumerate(names) for k in range(6)]
    got = language.identify_languages(spark.createDataFrame(rows, DOCS), F.lit(True)).collect()
    assert {r.lang_pred for r in got} == set(names)
    assert sum(r.lang_pred == names[r.doc_id // 100] for r in got) == len(rows)


def test_language_of_odd_rows(odd, empty):
    got = language.identify_languages(odd, id_remainder("doc_id", 5) != 99).collect()
    assert len(got) == 7
    assert {r.lang_pred for r in got if r.doc_id in (1, 2, 3, 4)} == {"und"}
    assert {r.lang_pred for r in got if r.doc_id in (None, 5)} == {"en"}
    assert language.identify_languages(empty, id_remainder("doc_id", 5) != 0).collect() == []


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in op2_toxicity(spark, sf).collect() if r.held_out and r.doc_id in truth]
    caught = sum(r.predicted for r in rows if truth[r.doc_id] == 1)
    wrong = sum(r.predicted for r in rows if truth[r.doc_id] == 0)
    assert caught >= 0.75 * sum(truth[r.doc_id] for r in rows)  # some labelled texts hold no insult at all
    assert wrong <= 0.1 * len(rows)


def test_toxicity_tolerates_insertions():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("etaonshrdlu") for _ in range(rng.randint(3, 9)))
    clean = [" ".join(word() for _ in range(30)) for _ in range(300)]
    bad = [t.replace(" ", f" {rng.choice(['wurgzib', 'fjimpox'])} ", 1) for t in clean[:150]]
    model = toxicity.fit(bad + clean[150:], [1] * 150 + [0] * 150, 64, 2000)
    score = lambda *texts: toxicity.scores(list(texts), model).tolist()
    assert min(score("wurgzib", "tah wurrgzib", "w-u-r-g-z-i-b", "w u r g z i b", "fjimmpox. then", "wurxgzib", "wurgzeib tah", "fjimkpox")) > 0.7
    assert max(score("", "onshe tarol", clean[200])) < 0.5


def test_toxicity_of_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(5, 0, 0), (2, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    got = toxicity.score_toxicity(odd, labels, id_remainder("doc_id", 3) != 9).collect()
    assert len(got) == 7 and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score_toxicity(empty, labels.limit(0), id_remainder("doc_id", 3) != 1).collect() == []


def test_token_files_equal_brute_force(spark, sf, docs):
    from tokenizers import Tokenizer

    library, start = Tokenizer.from_file(TOKENIZER), 0
    got = {r.doc_id: r for r in op3_token_files(spark, sf).collect()}
    for row in sorted(docs.collect(), key=lambda r: r.doc_id):
        ids = [*library.encode(row.text or "", add_special_tokens=False).ids, 0]
        data = b"".join(i.to_bytes(4, "little") for i in ids)
        assert (got[row.doc_id].start, got[row.doc_id].n_tokens, got[row.doc_id].ids_crc32) == (start, len(ids), zlib.crc32(data))
        start += len(ids)


def test_token_files_of_odd_rows(odd, empty):
    got = sorted((r.start, r.n_tokens, r.doc_id) for r in token_file.token_files(odd, TOKENIZER).collect())
    assert len(got) == 7 and got[0][2] is None and got[1] == (got[0][1], 1, 1)
    assert token_file.token_files(empty, TOKENIZER).collect() == []


def test_chunk_passages(spark, odd, empty):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = text(60)
    rows = [(i, f"{text(80)} {shared} {text(50)}" if i < 3 else text(150), "en", "s", "x") for i in range(6)]
    frame = spark.createDataFrame(rows, DOCS)
    got = chunk_dedup.repeated_passages(frame).collect()
    assert {r.doc_id for r in got} == {0, 1, 2} and {r.first_doc_id for r in got} == {0}
    for r in got:
        assert rows[r.doc_id][1][r.start : r.end] in f" {shared} "
    assert [r.is_first for r in sorted(got)] == [True, False, False]
    cut = {r.doc_id: r for r in chunk_dedup.cut_repeats(frame).collect()}
    assert cut[0].text == rows[0][1] and len(cut[1].text) < len(rows[1][1]) and cut[1].extra == "x"
    assert {r.doc_id for r in chunk_dedup.repeated_passages(odd).collect()} <= {5}
    assert chunk_dedup.repeated_passages(empty).collect() == []


def test_chunk_passages_keep_what_is_first(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared, own, line, short = text(80), text(120), text(90), text(40)
    rows = [(1, f"{text(60)} {shared} {text(60)}"), (5, f"{shared} {own}"), (9, f"{shared} {own}"), (11, f"{text(60)}\n" + f"{line}\n" * 5 + text(60)), (12, f"{short}\n" * 7)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(chunk_dedup.repeated_passages(frame).collect(), key=lambda r: (r.doc_id, r.start))
    origins = {k: [(r.is_first, r.first_doc_id) for r in got if r.doc_id == k] for k in (5, 9)}
    # The chunk that opens document 5 holds only a part of the passage, so it is another one.
    assert origins == {5: [(True, 5), (False, 1), (True, 5)], 9: [(False, 5), (False, 1), (False, 5)]}
    cut = {r.doc_id: r.text for r in chunk_dedup.cut_repeats(frame).collect()}
    middle = lambda t: t[150:-150]
    assert cut[1] == rows[0][1] and own[150:] in cut[5] and middle(shared) not in cut[5] and cut[9] == ""
    for part, key in ((shared, 1), (own, 5), (line, 11)):
        assert sum(t.count(middle(part)) for t in cut.values()) == 1 and middle(part) in cut[key]
    assert cut[12].startswith(short) and len(cut[12]) < 4 * len(short)


def words_of(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def brute_passages(rows, min_words=15):
    """Passages from each text's chunks by plain dictionaries; rows are (doc_id, text), each once."""
    cut = [(key, text, list(zip(*(x.tolist() for x in chunk_dedup.chunks_of(text)), strict=True))) for key, text in rows if text]
    places = collections.defaultdict(set)
    for key, _, chunks in cut:
        for digest, start, _, _ in chunks:
            places[digest].add((key, start))
    out = []
    for key, _, chunks in cut:
        stretches, last = [], None
        for digest, start, end, n in chunks:
            if len(places[digest]) > 1:
                first = min(places[digest])
                if last != start:
                    stretches.append([])
                stretches[-1].append((first == (key, start), first[0], start, end, n))
                last = end
        for stretch in stretches:
            if sum(c[4] for c in stretch) >= min_words:
                runs = [[stretch[0]]]
                for c in stretch[1:]:
                    runs[-1].append(c) if c[:2] == runs[-1][-1][:2] else runs.append([c])
                out += [(key, r[0][2], r[-1][3], sum(c[4] for c in r), r[0][0], r[0][1]) for r in runs]
    return sorted(out)


def test_chunk_passages_equal_brute_force(spark, docs):
    got = chunk_dedup.repeated_passages(docs).collect()
    assert sorted(tuple(r) for r in got) == brute_passages({(r.doc_id, r.text) for r in docs.collect()})
    assert len(got) > 20


def test_repeated_rows_are_one_text(spark):
    words = " ".join(f"w{i}" for i in range(12))
    long = " ".join(f"some{i}" for i in range(60))
    twice = spark.createDataFrame([(1, words, "en", "s", "x")] * 2, DOCS)
    assert chunk_dedup.repeated_passages(twice).count() == 0
    rows = spark.createDataFrame([(1, long, "en", "s", "x"), (1, long, "en", "s", "x"), (3, "and " + long, "en", "s", "y")], DOCS)
    kept = {(r.doc_id, len(r.text.split())) for r in chunk_dedup.cut_repeats(rows).collect()}
    assert (1, 60) in kept and max(n for d, n in kept if d == 3) < 25


def test_decontamination_equals_brute_force(spark, docs, sf, odd, empty):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in decontaminate.benchmark_hits(docs, bench).collect()}
    texts, items = docs.select("doc_id", "text").collect(), bench.select("item_id", "text").collect()
    spelled = {r.item_id: f" {' '.join(words_of(r.text))} " for r in items}
    assert got == {(r.doc_id, i) for r in texts for i, t in spelled.items() if t in f" {' '.join(words_of(r.text))} "}
    assert decontaminate.without_benchmark(docs, bench).count() == len([r for r in texts if r.doc_id not in {d for d, _ in got}])
    assert decontaminate.benchmark_hits(odd, bench).count() == decontaminate.benchmark_hits(empty, bench).count() == 0
    assert decontaminate.benchmark_hits(docs, bench.limit(0)).count() == 0


MARKET = "Maria buys 12 apples at the market for 30 cents. John sells 5 of the pears to Anna for 40 cents. Peter eats 2 of them."


@pytest.mark.parametrize(("question", "text", "found"), [
    (MARKET, "so Klaus buys 17 apples at the market for 31 cents. Fritz sells 6 of the pears to Mary Ann for 41 cents. Otto eats 3 of them. ok", True),
    (MARKET, "and nothing of the kind is in this text of some dozen words, 12 of which are numbers or names such as Maria", False),
    ("What is the capital of Peru?", "someone asked what they call it: What is the capital of Chile? Nobody knew", True),
    ("What is the capital of Peru?", "What is the largest city of Peru?", False),
    ("Anna has 5kg of flour and gives 2 kg to her brother Tom before noon", "Mary Ann has 7 kg of flour and gives 3kg to her brother Big Tom before noon", True),
    (MARKET, "so Klaus buys 17 apples at the market for 31 cents. Fritz sells 6 more of the pears to Sue for 41 cents. Otto eats 3 of them. ok", True),
    ("1 2 3 4 5 6 7 8 9 10", "11 12 13 14 15 16 17 18", False),
    ("Tom met Ann and Tom saw Ann but Tom left Ann", "Bob met Eve and Jim saw Sue but Kim left Pam", False),
])
def test_templates_meet_reparameterised_questions(spark, question, text, found):
    bench = spark.createDataFrame([(1, question), (2, None), (None, question)], "item_id long, text string")
    rows = spark.createDataFrame([(7, text), (None, text), (8, None), (7, text)], "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.benchmark_hits(rows, bench).collect()}
    assert got == ({(7, 1), (None, 1)} if found else set())
    assert decontaminate.without_benchmark(rows, bench).count() == (1 if found else 4)


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, total, stopped = {s: i % 3 + 1 for i, s in enumerate(order)}, sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in stopped]
        level = (total - sum(stopped.values())) / max(1, sum(weight[s] for s in free))
        over = [s for s in free if level * weight[s] > 3 * sizes[s]]
        if not over:
            return {s: stopped.get(s, level * weight[s]) for s in order}
        stopped |= {s: 3 * sizes[s] for s in over}


def brute_mix(rows, ratio=0.6180339887498949):
    """taken of each row (doc_id, source, size), sizes above 0, from a plain walk along the schedule; also each slot's source."""
    sums = collections.Counter()
    for _, source, size in rows:
        sums[source] += size
    goal = brute_targets(sums)
    order = sorted(sums, key=lambda s: (s is None, s or ""))
    blocks = {s: max(-(-sums[s] // 8192), min(sums[s], 1024)) for s in order}
    need = [goal[s] * blocks[s] / sums[s] for s in order]
    high = [sum(need[: i + 1]) / sum(need) for i in range(len(order))]
    passes, rank, walk = collections.Counter(), collections.Counter(), []
    for slot in range(round(sum(need))):
        at = (slot + 1) // (1 << 20) * (ratio * (1 << 20) % 1.0) + (slot + 1) % (1 << 20) * ratio
        source = order[next(i for i, h in enumerate(high) if at % 1.0 < h)]
        if rank[source] < 3 * blocks[source]:
            passes[source, rank[source] % blocks[source]] += 1
            walk.append(source)
        rank[source] += 1
    lines = collections.Counter()
    taken = {}
    for key, source, size in rows:
        begin = lines[source]
        lines[source] += size
        n, total = blocks[source], sums[source]
        taken[key] = sum(max(0, min(begin + size, (k + 1) * total // n) - max(begin, k * total // n)) * passes[source, k] for k in range(n))
    return taken, walk, goal


def test_source_mix_equals_a_walk_along_the_schedule(spark, docs, monkeypatch):
    rows = source_mix.mixed_rows(docs).collect()
    word = re.compile(r"[^\x20\x09-\x0D]+")
    known = {r.doc_id: (r.source, len(word.findall(r.text or ""))) for r in docs.collect()}
    assert {r.doc_id: (r.source, r["size"]) for r in rows} == known and len(rows) == len(known)
    worded = sorted((r for r in rows if r["size"]), key=lambda r: r.line)
    plain = [(r.doc_id, r.source, r["size"]) for r in worded]
    taken, walk, goal = brute_mix(plain)
    assert {r.doc_id: r.taken for r in rows if r["size"]} == taken
    sums = collections.Counter()
    for r in rows:
        assert 0 <= r.taken <= 3 * r["size"] and abs(r.target - goal[r.source]) < 1e-6
        sums[r.source] += r.taken
    assert all(abs(sums[s] - goal[s]) <= max(3, 0.01 * goal[s]) for s in goal)
    # Any stretch of the schedule holds the sources about as often as the whole.
    part = walk[len(walk) // 3 : len(walk) // 2]
    assert all(abs(part.count(s) / len(part) - walk.count(s) / len(walk)) < 0.01 for s in goal)
    assert sorted(source_mix.mix(docs).collect()) == sorted(source_mix.mix(docs.repartition(7)).collect())
    monkeypatch.setattr(source_mix, "GOLDEN_RATIO", 0.5)
    assert {r.doc_id: r.taken for r in source_mix.mix(docs).collect()} != {r.doc_id: r.taken for r in rows}


def test_source_mix_stops_small_sources(spark, odd, empty):
    rows = [(i, "w " * 50, "en", "a", "x") for i in range(40)] + [(99, "x y", "en", "b", "x"), (100, "z " * 9, "en", None, "x")]
    got = {r.doc_id: r for r in source_mix.mix(spark.createDataFrame(rows, DOCS)).collect()}
    want = brute_targets({"a": 2000, "b": 2, None: 9})
    assert (got[99].target, got[100].target, got[0].target) == (want["b"], want[None], want["a"])
    assert 5 <= got[99].taken <= 6 and 25 <= got[100].taken <= 27
    assert source_mix.mix(odd).count() == 7 and source_mix.mix(empty).count() == 0
    out = source_mix.apply_mix(spark.createDataFrame(rows, DOCS))
    assert out.columns == [c.split()[0] for c in DOCS.split(", ")] and 2 <= out.where("doc_id = 99").count() <= 3
    order = [r.source for r in out.collect()]
    assert "b" in order[: 2 * len(order) // 3] and source_mix.apply_mix(empty).count() == 0
    twins = spark.createDataFrame([(1, "a b c d", "en", "s", x) for x in "pqrs"], DOCS)
    assert collections.Counter(r.extra for r in source_mix.apply_mix(twins).collect()) == dict.fromkeys("pqrs", 1)


def shingles(text):
    words = (text or "").split()
    return frozenset(zip(*[words[k:] for k in range(5)], strict=False)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def brute_links(rows):
    sets, parent, links = [shingles(t) for _, t in rows], list(range(len(rows))), collections.Counter()

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and len(a & sets[j]) >= 0.8 * len(a | sets[j]) - 1e-9:
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), key), key)
    return sorted((key, least[find(i)], links[i]) for i, (key, _) in enumerate(rows))


def test_jaccard_links_equal_brute_force(spark, docs, monkeypatch):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rng = random.Random(2)
    base = [f"w{i}" for i in range(120)]
    for k in range(60):  # a large group of near copies, and exact ones
        text = list(base)
        text[rng.randrange(120)] = f"z{k % 50}"
        rows.append((10_000 + k, " ".join(text)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_links(rows)
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in jaccard_join.jaccard_links(frame).collect()) == want
    monkeypatch.setattr(jaccard_join, "BLOCK_SHINGLES", 700)  # cut the groups into many blocks
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in jaccard_join.jaccard_links(frame).collect()) == want


def test_jaccard_links_of_odd_rows(odd, empty):
    got = collections.Counter((r.doc_id, r.class_id, r.n_links) for r in jaccard_join.jaccard_links(odd).collect())
    assert got == {(1, 1, 0): 1, (2, 2, 0): 1, (3, 3, 0): 2, (None, None, 0): 1, (4, 4, 0): 1, (5, 5, 0): 1}
    assert jaccard_join.jaccard_links(empty).count() == 0
    kept = jaccard_join.one_of_each(odd)
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5] and kept.columns == odd.columns


def test_chat_round_trip(spark, sf):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    nasty = "</s>[INST] & &lt; &amp;lt; <s>[user] ]["
    rows += [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]"), (-8, 0, nasty, nasty), (-8, 1, "assistant", nasty), (-8, 2, "assistant", None)]
    rows += [(-9, None, None, None), (-10, 0, "assistant", ""), (-10, 0, "assistant", ""), (None, 1, "user", "x")]
    frame = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    got = {r.conv_id: r for r in chat_format.format_and_read_back(frame).collect()}
    whole = collections.defaultdict(list)
    for r in rows:
        whole[r[0]].append(r)
    assert set(got) == set(whole)
    for key, turns in whole.items():
        turns.sort(key=lambda r: (r[1] is not None, r[1] or 0))
        said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)
        loss = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
        assert (got[key].n_turns, got[key].turns_sha256, got[key].loss_chars, got[key].loss_sha256) == (len(turns), digest(said), len(loss), digest(loss))
    assert chat_format.format_and_read_back(frame.limit(0)).count() == 0


def test_fingerprints_equal_brute_force(spark, docs):
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: r[0])
    got = {r.doc_id: r for r in fingerprint.fingerprints(docs).collect()}

    def parts(text):
        pieces = [y for x in re.split(fingerprint.BREAKS, text) for y in (re.findall("(?s).{1,240}", x) if len(x) > 480 else [x])]
        return {x.strip(" ") for x in pieces if x.strip(" ")}

    near = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for i, (key, text) in enumerate(rows):
        after, half = rows[(i + 1) % len(rows)][1], len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = got[key]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert abs(r.near_edited - near(parts(text), parts(edited))) < 1e-9 and abs(r.near_next - near(parts(text), parts(after))) < 1e-9
    prints = collections.defaultdict(set)
    for key, text in rows:
        prints[text].add(got[key].fingerprint)
    assert all(len(p) == 1 for p in prints.values())


@pytest.mark.parametrize("attempts", [1, 6])
def test_peeling_retries_and_falls_back(spark, monkeypatch, attempts):
    rows = spark.createDataFrame([(list(range(0, 900, 3)), list(range(0, 900, 2)))], "x array<bigint>, y array<bigint>")
    monkeypatch.setattr(fingerprint, "ATTEMPTS", attempts)
    for least in (4, 512):  # at 4 cells a table the first attempts fail
        monkeypatch.setattr(fingerprint, "table_width", lambda n, least=least: F.lit(least))
        got = rows.select(fingerprint.difference(F.col("x"), F.col("y")).alias("d")).first().d
        assert (got.more, got.less) == (150, 300) and got.done


def test_fingerprints_of_odd_rows(odd, empty, spark):
    assert fingerprint.fingerprints(odd).count() == 7
    assert fingerprint.fingerprints(empty).count() == 0
    one = fingerprint.fingerprints(spark.createDataFrame([(1, "ab\ncd")], "doc_id long, text string")).collect()[0]
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"ab\nab").hexdigest()


def test_warc_round_trip(spark, sf):
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    rows += [(10_000 + r[0], r[1], r[2]) for r in rows[:20]] + [(20_000, None, None), (20_001, "a\r\nb", ""), (20_002, "u", "x\r\n\r\nWARC/1.1\r\n\r\n"), (20_003, "é", "é\U0001f600")]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int")
    got = {r.page_id: r for r in warc.archive_and_read(frame).collect()}
    owner = {}
    for key, _, html in rows:
        owner[html or ""] = max(owner.get(html or "", key), key)
    assert len(got) == len(rows)
    for key, _, html in rows:
        data, first, r = (html or "").encode(), owner[html or ""], got[key]
        kind, refers = ("response", None) if key == first else ("revisit", first)
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), kind, refers)
    assert warc.archive_and_read(frame.limit(0)).count() == 0
    tied = spark.createDataFrame([(1, "u", "x"), (1, "u", "x"), (None, "u", "x")], "page_id long, url string, html string")
    assert sorted((r.page_id or 0, r.record_type) for r in warc.archive_and_read(tied).collect()) == [(0, "revisit"), (1, "response"), (1, "response")]


def test_warc_of_other_writers(spark, tmp_path):
    def member(kind, rid, *near, block=b"GET / HTTP/1.1\r\n\r\n"):
        heads = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <{rid}>", *[f"WARC-Concurrent-To: <{n}>" for n in near], f"Content-Length: {len(block)}"]
        return gzip.compress("\r\n".join(heads).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")

    page = lambda text: b"HTTP/1.1 200 OK\r\n\r\n" + text
    note = b"fetchTimeMs: 5\r\nodd line\r\n"
    one = [member("warcinfo", "w"), member("request", "q1", "r1"), member("response", "r1", block=page(b"one")), member("metadata", "m1", "r1", block=note)]
    one += [member("request", "q2"), member("response", "r2", "q2", block=page(b"two")), member("metadata", "m2", "q2", "r2", block=note)]
    one += [member("request", "q3", "r3"), member("response", "r4", "q4", block=page(b"four")), member("response", "r5", block=page(b"five"))]
    two = [member("response", "r3", block=page(b"three")), member("metadata", "m3", "q3", block=note), member("request", "q4"), member("metadata", "m4", "r4", block=note)]
    (tmp_path / "one.warc.gz").write_bytes(b"".join(one))
    (tmp_path / "two.warc.gz").write_bytes(b"".join(two))
    got = warc.read_captures(spark, str(tmp_path)).collect()
    sha = lambda t: base64.b32encode(hashlib.sha1(t).digest()).decode()
    ids = lambda r: tuple(x and x.record_id for x in (r.request, r.response, r.metadata))
    assert sorted(map(ids, got), key=lambda t: t[1]) == [*((f"<q{i}>", f"<r{i}>", f"<m{i}>") for i in range(1, 5)), (None, "<r5>", None)]
    assert {r.response.payload_sha1 for r in got} == {sha(t) for t in (b"one", b"two", b"three", b"four", b"five")}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, sf, name):
    assert differences(QUERIES[name](spark, sf), ORACLE[name], connect(sf)) == []


def test_every_query_runs_and_numbers_are_complete(spark, sf):
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 11))
