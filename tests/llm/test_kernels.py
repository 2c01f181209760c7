import collections
import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from postmill.llm import chunk_dedup, jaccard_join, kernels, language, token_file, toxicity

pytestmark = pytest.mark.filterwarnings("ignore")


def test_span_digests_do_not_depend_on_place():
    codes = kernels.code_points("xx hello yy hello \U0001f600")
    spans = kernels.Spans(codes)
    a, b, c = spans.digests(np.array([3, 12, 0]), np.array([8, 17, 5]))
    assert a == b != c


@given(st.lists(st.integers(0, 5000), max_size=400), st.integers(0, 399), st.integers(0, 399))
@settings(max_examples=80, deadline=None)
def test_elias_fano_selects_any_range(sizes, first, last):
    ends = np.cumsum(np.array(sizes, np.int64)) if sizes else np.zeros(0, np.int64)
    data = b"ab" + token_file.pack_numbers(ends) + b"rest"
    packed = token_file.Numbers(data, 2)
    assert data[packed.end :] == b"rest" and packed.n == len(sizes)
    first, last = min(first, len(sizes)), min(last, len(sizes))
    assert packed.select(first, last).tolist() == ends[first:last].tolist()
    assert [x for _, step in packed.steps() for x in step.tolist()] == ends.tolist()
    if len(sizes) > 100:
        assert packed.end - 2 < 3 * len(sizes)


def test_select_goes_by_the_directory():
    ends = np.cumsum(np.arange(5000) % 90)
    packed = token_file.Numbers(token_file.pack_numbers(ends))
    assert len(packed.directory) == -(-5000 // token_file.SAMPLE)
    read = []

    class Watched(np.ndarray):
        def __getitem__(self, at):
            if isinstance(at, slice):
                read.append(len(range(*at.indices(len(self)))))
            return np.asarray(self)[at]

    packed.high, packed.low = packed.high.view(Watched), packed.low.view(Watched)
    assert packed.select(3000, 3001).tolist() == [ends[3000]] and max(read) < 100
    packed.directory = np.zeros_like(packed.directory)
    assert packed.select(3000, 3001).tolist() != [ends[3000]]


@given(st.lists(st.one_of(st.none(), st.integers(-(2**63), 2**63 - 1)), min_size=1, max_size=30), st.booleans(), st.integers(0, 30), st.integers(0, 30))
@settings(max_examples=80, deadline=None)
def test_document_ids_of_a_block(ids, ascending, first, last):
    if ascending:
        ids = sorted(abs(i) >> 20 for i in ids if i is not None)
    first, last = min(first, len(ids)), min(max(first, last), len(ids))
    data = token_file.pack_ids(ids)
    assert token_file.unpack_ids(data, first, last, len(ids)).to_pylist() == ids[first:last]
    assert bool(data[0]) == bool(ids and None not in ids and ids[0] >= 0 and ids == sorted(ids))


def test_block_round_trip():
    arrays = [np.array([5, 0]), np.array([0]), np.array([7, 8, 9, 0])]
    bounds, ids = token_file.decode_block(token_file.encode_block(arrays, 2))
    assert bounds.select(0, 3).tolist() == [2, 3, 7]
    assert ids.tolist() == [5, 0, 0, 7, 8, 9, 0]


def test_other_tokenizers_are_left_to_the_library():
    from tokenizers import Tokenizer, models, pre_tokenizers

    from postmill.llm.catalogue import TOKENIZER

    assert token_file.splits_as_assumed(Tokenizer.from_file(TOKENIZER))
    other = Tokenizer(models.BPE())
    other.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=True)
    assert not token_file.splits_as_assumed(other)
    other.pre_tokenizer = pre_tokenizers.Whitespace()
    assert not token_file.splits_as_assumed(other)


def test_presence_kernel_equals_a_double_loop():
    texts = ["Ab a\tb", "abc", "", "the cat sat", "¡Ñandú! the  cat", "ab"]

    def grams(text):
        low = "".join(" " if c.isspace() else c for c in text.lower())
        return {low[i : i + n] for n in (1, 2, 3) for i in range(len(low) - n + 1)}

    marks = [t for t in texts if t]
    model = language.fit(marks, ["x", "y", "x", "y", "x"], 10, 1e-2)
    got = language.kernel(texts, model.column_of, model.landmarks)
    order = [t for name in ("x", "y") for t, lang in zip(marks, "xyxyx", strict=True) if lang == name]
    for i, a in enumerate(texts):
        for k, b in enumerate(order):
            want = len(grams(a) & grams(b)) / np.sqrt(len(grams(a)) * len(grams(b))) if a else 0
            assert abs(got[i, k] - want) < 1e-5


PARTS = ["a", "b ", " ", "  ", "\n", "\n\n", ".", ",", "'s", "'", "é", "²", "1", "\t", "　", "<|endoftext|>", "word", "!?", "\x00", "中", "́", "\x1c"]


@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=14).map("".join), max_size=6))
@settings(max_examples=200, deadline=None)
def test_encoder_equals_the_library(texts):
    from postmill.llm.catalogue import TOKENIZER

    coder = token_file.encoder(TOKENIZER)
    assert [x.tolist() for x in coder.batch(texts)] == [x.tolist() for x in coder.library(texts)]


def test_matched_prefix_is_shortened_to_the_target():
    steps = jaccard_join.SIMILARITY_STEPS
    lower = lambda k: np.array([0.8 + 0.2 * k / steps])
    weak, close = np.zeros((5000, steps)), np.zeros((5000, steps))
    weak[:, 0], close[:, 36] = 3, 3
    depths = [jaccard_join.matched_prefix(x) for x in (np.zeros((0, steps)), weak, close)]
    assert depths[0] == depths[1] < depths[2]
    assert jaccard_join.recall_at(depths[1], lower(0))[0] >= jaccard_join.TARGET_RECALL > jaccard_join.recall_at(depths[1] + 1, lower(0))[0]
    close[:100, 0], close[:100, 36] = 3, 0  # some links near the threshold shorten the prefix
    assert depths[1] < jaccard_join.matched_prefix(close) < depths[2]


def test_counted_links_equal_brute_force():
    rng = np.random.RandomState(8)
    words = [f"w{i}" for i in range(150)]
    texts = [" ".join(words[:k] + [f"x{rng.randint(9)}"] + words[k:]) for k in rng.randint(0, 150, 60)] + ["", "a b", "a b"]
    sets = jaccard_join.shingle_sets(texts)
    sample = list({s.tobytes(): s for s in sets if len(s)}.values())[:20]
    want = collections.Counter()
    for i, a in enumerate(sample):
        for b in sets:
            both = len(np.intersect1d(a, b))
            alike = both / max(1, len(a) + len(b) - both)
            if 0.8 <= alike < 1:
                want[i, int((alike - 0.8) / 0.2 * jaccard_join.SIMILARITY_STEPS + 1e-6)] += 1
    got = collections.Counter()
    for frame in jaccard_join.count_links(sample)(iter([pd.DataFrame({"text": [*texts, None]})])):
        for i, row in zip(frame["sampled"], frame["counts"], strict=True):
            got.update({(i, k): n for k, n in enumerate(row) if n})
    assert got == want and want


def test_trees_find_links_near_the_threshold():
    rng = np.random.RandomState(9)
    weak = np.zeros((50, jaccard_join.SIMILARITY_STEPS))
    weak[:, 0] = 1
    depth = jaccard_join.matched_prefix(weak)
    pairs = [np.unique(rng.randint(0, 1 << 62, 110).astype(np.uint64)) for _ in range(300)]
    near = [(s[:99], s[10:]) for s in pairs]  # 89 of 110 are shared
    left, right = (jaccard_join.node_keys([pair[k] for pair in near], depth) for k in range(2))
    assert (left == right).any(axis=1).mean() >= 0.99


def test_the_join_matches_prefixes_that_find_every_link(spark, monkeypatch):
    used = []
    asked = jaccard_join.matched_prefix
    monkeypatch.setattr(jaccard_join, "matched_prefix", lambda counts: used.append((counts.sum(), asked(counts))) or asked(counts))
    close = " ".join(f"w{i}" for i in range(400))
    rows = [(i, close if i % 2 else close + " x") for i in range(60)]  # all links are close: measured, they would ask for the longest prefix
    links = jaccard_join.jaccard_links(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.class_id, r.n_links) for r in links} == {(0, 59)}
    (measured, depth), *_ = used
    assert measured == 0 and jaccard_join.recall_at(depth, np.array([0.8]))[0] >= jaccard_join.TARGET_RECALL


def test_shingle_sets():
    sets = jaccard_join.shingle_sets(["a b c d e f", "a  b\tc d e f", "", "  \n", "a b", "a b", "b a", "b c d e f"])
    sizes = [len(s) for s in sets]
    assert sizes == [2, 2, 0, 0, 1, 1, 1, 1]
    assert sets[0].tolist() == sets[1].tolist() and sets[4] == sets[5] != sets[6]
    assert sets[7][0] in sets[0]


def test_chunks_cover_the_text_and_survive_an_insertion():
    rng = np.random.RandomState(5)
    text = "".join(rng.choice(list("abcdefgh "), 3000))
    digest, start, end, words = chunk_dedup.chunks_of(text)
    assert start[0] == 0 and end[-1] == 3000 and (start[1:] == end[:-1]).all()
    assert words.sum() == len(text.split())
    changed = chunk_dedup.chunks_of(text[:100] + "ZZZ" + text[100:])[0]
    assert len(set(digest.tolist()) - set(changed.tolist())) <= 4
    assert len(chunk_dedup.chunks_of("a" * 5000)[0]) < 5
    assert len(chunk_dedup.chunks_of("")[0]) == 0


def test_every_shared_passage_of_51_words_is_seen():
    rng = np.random.RandomState(9)
    word = lambda: "".join(rng.choice(list("etaoinshrdlu"), rng.randint(2, 9)))
    for _ in range(60):
        shared = " ".join(word() for _ in range(51))
        a, b = (" ".join(word() for _ in range(rng.randint(5, 60))) for _ in range(2))
        one, two = chunk_dedup.chunks_of(f"{a} {shared} {b}"), chunk_dedup.chunks_of(f"{b} {shared} {a}")
        common, best, run = set(one[0].tolist()) & set(two[0].tolist()), 0, 0
        for d, n in zip(one[0].tolist(), one[3].tolist(), strict=True):
            run = run + n if d in common else 0
            best = max(best, run)
        assert best >= chunk_dedup.MIN_WORDS


def alternating(n, first="a"):
    """A word whose letters follow the parity of their places' binary digits, and its complement."""
    other = "b" if first == "a" else "a"
    return "".join(first if bin(i).count("1") % 2 == 0 else other for i in range(n))


@pytest.mark.parametrize("n", [64, 512, 1024, 4096, 8192])
def test_crafted_words_have_digests_of_their_own(n):
    one, two = alternating(n), alternating(n, "b")
    codes = kernels.code_points(one + " " + two)
    digests = kernels.Spans(codes).digests(np.array([0, n + 1]), np.array([n, 2 * n + 1]), exact=True)
    assert digests[0] != digests[1]
    assert not np.intersect1d(*jaccard_join.shingle_sets([one, two])).size


def test_crafted_words_get_the_ids_of_the_library():
    from postmill.llm.catalogue import TOKENIZER
    from tokenizers import Tokenizer

    coder, library = token_file.Encoder(TOKENIZER), Tokenizer.from_file(TOKENIZER)
    texts = [alternating(n, first) for n in (512, 1024, 2048, 4096) for first in "ab"]
    for text, ids in zip(texts, coder.batch(texts), strict=True):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids


def test_a_wrong_label_does_not_switch_the_model_off():
    rng = random.Random(3)
    words = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(3, 9))) for _ in range(300)]
    prose = lambda: " ".join(rng.choice(words) for _ in range(30))
    insults = lambda w: f"{prose()} {w} {prose()}"
    toxic, clean = [insults("zwixgub") for _ in range(150)], [prose() for _ in range(400)]
    model = toxicity.fit(toxic + clean + [insults("zwixgub")], [1] * 150 + [0] * 401, 64, 300)
    assert (toxicity.scores([insults("zwixgub") for _ in range(50)], model) >= toxicity.THRESHOLD).all()
    assert (toxicity.scores([insults("zwixxgub") for _ in range(50)], model) >= toxicity.THRESHOLD).mean() > 0.9
    assert (toxicity.scores([prose() for _ in range(200)], model) < toxicity.THRESHOLD).all()
    for gap in (" ", "  ", "\t", " \u00a0 "):
        assert (toxicity.scores([insults(gap.join("zwixgub")) for _ in range(20)], model) >= toxicity.THRESHOLD).all(), repr(gap)
