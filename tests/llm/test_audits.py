import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from postmill.llm import divergence, hard_negatives, repetition
from postmill.llm.catalogue import ORACLE, QUERIES
from postmill.operators import blocks
from tests.oracle import connect, differences

DOCS = "doc_id long, text string, lang string, source string, repetition string, bytes string"
LONG = "a b c d e f g h i j k l m n o p q r s t u v w x y z"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, None, None, None, "x", "y"), (2, "", "en", "s", None, None), (3, LONG, "en", "t", "x", "y"), (3, LONG, "en", "t", "x", "y"), (None, LONG, "en", "s", "x", "y")]
    return spark.createDataFrame([*rows, (5, "long words again " * 30000, "de", "s", "x", "y"), (6, "word " + "x" * 500_000, "de", None, "x", "y")], DOCS)


@pytest.mark.parametrize("name", ["op11_quality_rules", "op12_source_divergence", "op13_hard_negatives"])
def test_new_queries_equal_sql(spark, sf, name):
    assert differences(QUERIES[name](spark, sf), ORACLE[name], connect(sf)) == []


def covered(words, run):
    places = defaultdict(list)
    for i in range(len(words) - run + 1):
        places[tuple(words[i : i + run])].append(i)
    return len({i + k for p in places.values() if len(p) > 1 for i in p for k in range(run)})


def longest(words):
    run = 0
    while any(n > 1 for n in Counter(tuple(words[i : i + run + 1]) for i in range(len(words) - run)).values()):
        run += 1
    return run


def test_repeats_equal_brute_force():
    rng = random.Random(11)
    for _ in range(150):
        texts = [" ".join(rng.choice("abcdefghij"[: rng.choice([1, 2, 3, 10])]) for _ in range(rng.choice([0, 1, 4, 9, 30, 80]))).encode() for _ in range(4)]
        for text, found in zip(texts, repetition.measure(texts), strict=True):
            words, most = text.split(), longest(text.split())
            assert found["n_repeat_words"] == covered(words, 8)
            assert found["covered_words"] == covered(words, 5) == sum(s["end"] - s["begin"] for s in found["repeats"])
            assert found["longest_repeat"] == (most if most >= 5 else 0)


def test_repeated_passages_and_stuttered_words_are_rejected_and_prose_is_kept(spark):
    rng = random.Random(12)
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    prose, passage, limit = fresh(400), fresh(51), fresh(50)
    stutter = [w for w in fresh(12) for _ in range(8)]
    cases = [prose, prose + passage + fresh(9) + passage, prose + limit + fresh(9) + limit, stutter, fresh(19), fresh(20), fresh(40) * 2]
    rows = [(i, " ".join(words), "en", "s", "x", "y") for i, words in enumerate(cases)]
    docs = spark.createDataFrame(rows, DOCS)
    found = {r.doc_id: r for r in repetition.quality_rules(docs).collect()}
    assert [found[i].kept for i in range(7)] == [True, False, True, False, False, True, False]
    assert [found[i].base_failed for i in range(7)] == [False, False, False, False, True, False, True]
    kept = repetition.kept_documents(docs)
    assert kept.columns == docs.columns and {tuple(r) for r in kept.collect()} == {rows[i] for i in (0, 2, 5)}


def test_quality_rules_of_odd_rows(spark, odd):
    found = repetition.quality_rules(odd).collect()
    assert Counter(r.doc_id for r in found) == {1: 1, 2: 1, 3: 2, None: 1, 5: 1, 6: 1}
    null = next(r for r in found if r.doc_id == 1)
    assert (null.n_words, null.word_chars, null.n_dup_lines, null.base_failed, null.kept) == (0, 0, 0, True, False)
    assert next(r for r in found if r.doc_id == 5).n_repeat_words == 90_000
    assert next(r for r in found if r.doc_id == 6).word_chars == 500_004
    whole = repetition.repetition(odd, odd.columns)
    assert whole.columns == [*odd.columns, "_repetition"] and whole.count() == 7
    assert repetition.quality_rules(odd.limit(0)).collect() == []


def test_lines_and_symbols_are_counted():
    found = repetition.measure(["a\n \na\n\nb\r\nb\n# < é|\n".encode()])[0]
    assert (found["n_dup_lines"], found["n_symbols"], found["word_chars"], found["n_words"]) == (1, 3, 8, 7)


@pytest.mark.parametrize("burst", [1, 5, 2048])
def test_tries_merge_and_walk_in_byte_order(burst, monkeypatch):
    monkeypatch.setattr(divergence.Trie, "BURST", burst)
    rng, whole, tries, want = random.Random(13), divergence.Trie(), [divergence.Trie() for _ in range(3)], defaultdict(Counter)
    for _ in range(4000):
        term, source = bytes(rng.choice(b"ab\x00\xc3\xff") for _ in range(rng.randrange(7))), rng.choice("xyz")
        rng.choice(tries).add(term, 1, {source: 2})
        want[term][source] += 2
    for trie in tries:
        for term, leaf in trie.walk():
            whole.add(term, leaf.pop(divergence.DOCUMENTS), leaf)
    assert list(whole.walk()) == [(t, {divergence.DOCUMENTS: sum(c.values()) // 2, **c}) for t, c in sorted(want.items())]
    assert whole.counters == sum(map(len, want.values()))


def test_divergence_does_not_depend_on_blocks_chunks_and_flushes(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = Counter(divergence.divergences(docs).collect())
    for name, value in (("TRIE_COUNTERS", 50), ("WAITING_WORDS", 200), ("LEAF_ROWS", 9), ("CHUNK_TERMS", 7), ("CHUNK_COUNTERS", 40), ("BLOCK_SOURCES", 3), ("BUCKET_TERMS", 100)):
        monkeypatch.setattr(divergence, name, value)
    # workers import the module with its own values, so counting and merging are called here
    rows = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")], F.col("text").cast("binary").alias("text")).toArrow()
    leaves = [b.to_pylist() for b in divergence.count_terms(iter(rows.to_batches(max_chunksize=20)))]
    merged = defaultdict(Counter)
    for leaf in (x for b in leaves for x in b):
        merged[leaf["lang"], leaf["term"]].update(dict(zip(leaf["sources"], leaf["counts"], strict=True)))
    assert len(leaves) > 3 and sum(map(len, leaves)) > len(merged)
    ordered = pa.Table.from_pylist(sorted((x for b in leaves for x in b), key=lambda x: (x["lang"].encode(), x["term"])), divergence.LEAF)
    documents = Counter()
    for leaf in (x for b in leaves for x in b):
        documents[leaf["lang"], leaf["term"]] += leaf["documents"]
    kept = {key: dict(own) for key, own in merged.items() if not key[1] or documents[key] >= divergence.LEAST_DOCUMENTS}
    for size in (1, 2, 13, 10**6):
        chunks = [c for b in divergence.merge_ranges(iter(ordered.to_batches(max_chunksize=size))) for c in b.to_pylist()]
        got = {(c["lang"], t): {} for c in chunks for t in c["terms"]}
        for c in chunks:
            for t, k, n in zip(c["term_at"], c["source_at"], c["counts"], strict=True):
                got[c["lang"], c["terms"][t]][c["sources"][k]] = n
        assert got == {key: own for key, own in kept.items() if key[1]}
        assert {(c["lang"], s) for c in chunks for s in c["sources"]} == {(lang, s) for (lang, t), own in merged.items() if not t for s in own}
    assert Counter(divergence.divergences(docs).collect()) == want


def test_divergence_of_odd_rows(spark, odd):
    found = divergence.divergences(odd).collect()
    assert {(r.lang, r.source, r.part, r.item) for r in found if r.part == "pair"} == {("en", "s", "pair", "t"), ("en", "t", "pair", "s"), ("de", "", "pair", "s"), ("de", "s", "pair", "")}
    terms = [(r.source, r.item, r.rank) for r in found if r.part == "term"]
    assert terms == [] or all(s in ("s", "t") for s, _, _ in terms)
    assert {r.value for r in found if r.lang == "de"} == {0}  # no term in three documents
    assert divergence.divergences(odd.limit(0)).collect() == []
    alone = divergence.divergences(spark.createDataFrame([(i, t, "en", s, "", "") for i, (t, s) in enumerate([("a É", "p"), ("A é", "p"), ("a É", "q"), (None, "r")])], DOCS)).collect()
    # only 'a' is in three rows: É and é are two terms; r has no term, and with one term every share is the same
    assert {(r.source, r.item, r.value) for r in alone if r.part == "pair"} == {(a, b, 0) for a in "pqr" for b in "pqr" if a != b}
    assert not [r for r in alone if r.part == "term"]


VECTORS = "vec_id long, embedding array<float>, label int, id int, block string"


def brute_negatives(rows):
    use = [(i, v, lab) for i, v, lab in rows if lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    whole = [[int(np.floor(256 * float(np.float32(x)))) for x in v] for _, v, _ in use]
    last = lambda i: (i is None, i or 0)
    out = []
    for a, (anchor, _, label) in enumerate(use):
        if anchor is not None and anchor % 50 == 0:
            scored = [(sum(x * y for x, y in zip(whole[a], whole[b], strict=False)), *use[b]) for b in range(len(use)) if b != a]
            order = sorted(scored, key=lambda s: (-s[0], last(s[1])))
            for score, pid, _, _ in [s for s in order if s[3] == label][:5]:
                fit = [s for s in order if s[3] != label and 50 * score <= 100 * s[0] <= 95 * score][:3]
                out += [(anchor, pid, k + 1, s[1], score, s[0]) for k, s in enumerate(fit)]
    return Counter(out)


def mined(spark, rows):
    df = spark.createDataFrame([(i, v, lab, 7, "x") for i, v, lab in rows], VECTORS)
    return Counter(map(tuple, hard_negatives.mine(df, "vec_id", "embedding", F.col("label"), F.col("vec_id") % 50 == 0).collect()))


def test_negatives_equal_brute_force_with_odd_rows_ties_and_repeats(spark, monkeypatch):
    rng = np.random.RandomState(14)
    rows = [(int(i), [float(x) for x in rng.randint(-3, 4, 4) / 2], int(rng.randint(3))) for i in rng.randint(0, 300, 400)]
    rows += [(50, None, 1), (100, [1.0, None, 2.0], 1), (150, [float("nan")] * 4, 1), (200, [float("inf")] * 4, 0), (250, [1.0, 2.0], None), (300, [2.0, 1.0], 0), (None, [1.5] * 4, 1), (None, [1.5] * 4, 2), (350, [], 1)]
    rows += [(0, [1.0, 1.0, 1.0, 0.5], 1)] * 4
    want = brute_negatives(rows)
    assert sum(want.values()) > 100 and mined(spark, rows) == want
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", 37)
    monkeypatch.setattr(hard_negatives, "QUERY_ROWS", 2)
    monkeypatch.setattr(blocks, "WAVE", 2)
    assert mined(spark, rows) == want


def test_negatives_of_empty_and_one_sided_tables(spark):
    assert mined(spark, []) == Counter()
    assert mined(spark, [(50, [1.0], 1), (51, [1.0], 1)]) == Counter()
    assert mined(spark, [(50, [1.0], 1), (51, [0.9], 2)]) == Counter()


def test_scores_are_exact_beyond_floats_and_held_at_the_ends():
    big = np.array([[2**31 - 1, 2**31 - 3]], np.int64)
    assert blocks.products(big, big).tolist() == [[(2**31 - 1) ** 2 + (2**31 - 3) ** 2]] if 2 * (2**31 - 1) ** 2 < 2**62 else True
    assert blocks.products(np.array([[2**26 + 1]]), np.array([[2**27 + 1]])).tolist() == [[(2**26 + 1) * (2**27 + 1)]]
    assert blocks.products(np.array([[2**62]]), np.array([[-4]])).tolist() == [[-(2**63 - 1)]]
    assert blocks.products(np.array([[3, 4]]), np.array([[5]])).tolist() == [[15]]
