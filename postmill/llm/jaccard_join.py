"""Jaccard self-join of texts by a MinHash LSH forest.

A text is the set of its runs of ``WIDTH`` words (white space separates words;
a shorter text is one run). Texts with equal sets are one set with a number of
copies. Each set gets ``TREES`` labels of up to ``DEEPEST`` MinHash values; the
labels of a tree, ordered, are a prefix trie, and two sets are candidates where
their labels share a prefix. How long a prefix must match is arithmetic, not
measured: the longest one at which a link at the threshold itself, the hardest
to find, is found with the target recall (``matched_prefix`` without measured
links), so every link of any input is, whatever the others are like.

Candidates are never expanded into pairs: a node links each member to its
least one, by sizes, since sets within the threshold differ in size by at most
its factor. Connected components of those links hold every candidate pair.
The members of a component are compared exactly, in blocks of bounded size,
and a block returns counts and a spanning forest of its links.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm import kernels
from postmill.llm.common import let_workers_import
from postmill.operators.graph import connected_components
from postmill.session import materialise

WIDTH = 5
THRESHOLD = 0.8
TARGET_RECALL = 0.9999
TREES = 40
DEEPEST = 12
#: Steps of similarity, from the threshold to 1, by which measured links are counted.
SIMILARITY_STEPS = 40
#: Shingles of one side of a comparison.
BLOCK_SHINGLES = 100_000
#: Cells of one incidence block of a comparison.
BLOCK_CELLS = 1 << 24


def recall_at(depth: int, similarity: np.ndarray) -> np.ndarray:
    """The probability that sets of a similarity share a prefix of this length in one of the trees."""
    return 1 - (1 - similarity**depth) ** TREES


def matched_prefix(counts: np.ndarray) -> int:
    """The longest prefix at which the tries reach the target recall for the measured links.

    ``counts`` has a row for each sampled set and a column for each step of
    similarity. Recall is the mean over sampled sets with links, so that a
    large group counts no more than a small one; a link counts as the least
    similar of its step. One set with a link at the threshold is added, so
    few measured links, or none, are no reason for a longer prefix. The join
    passes none; audits of a forest's recall may.
    """
    steps = THRESHOLD + (1 - THRESHOLD) * np.arange(SIMILARITY_STEPS) / SIMILARITY_STEPS
    weakest = np.zeros((1, SIMILARITY_STEPS))
    weakest[0, 0] = 1
    linked = np.concatenate([counts[counts.sum(axis=1) > 0], weakest])
    share = (linked / linked.sum(axis=1, keepdims=True)).mean(axis=0)
    depth = DEEPEST
    while depth > 1 and share @ recall_at(depth, steps) < TARGET_RECALL:
        depth -= 1
    return depth


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """Sorted distinct 64-bit digests of each text's word runs; empty without a word."""
    out: list[np.ndarray] = []
    for begin, end in kernels.slices(texts):
        part = texts[begin:end]
        codes = kernels.code_points("\n".join(part))
        starts, ends = kernels.words(codes)
        digests = kernels.Spans(codes).digests(starts, ends, exact=True)
        first = np.cumsum([0] + [len(t) + 1 for t in part])
        cut = np.searchsorted(starts, first)
        if len(digests) >= WIDTH:
            runs = np.zeros(len(digests) - WIDTH + 1, np.uint64)
            for k in range(WIDTH):
                runs = runs * np.uint64(0x9FB21C651E98DF25) + digests[k : len(digests) - WIDTH + 1 + k]
            runs = kernels.mix(runs)
        for b, e in zip(cut[:-1], cut[1:], strict=True):
            if e - b >= WIDTH:
                out.append(np.unique(runs[b : e - WIDTH + 1]))
            elif e > b:
                short = np.array([e - b], np.uint64)
                for k in range(b, e):
                    short = kernels.mix(short * np.uint64(0x9FB21C651E98DF25) + digests[k : k + 1])
                out.append(short)
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def set_ids(sets: list[np.ndarray]) -> list[int | None]:
    """A 64-bit id of each set; None for an empty one."""
    with np.errstate(over="ignore"):
        sums = [np.bitwise_xor.reduce(kernels.mix(s + kernels.GOLDEN)) + s.sum() * np.uint64(3) + np.uint64(len(s)) if len(s) else None for s in sets]
    return [None if x is None else int(kernels.mix(np.array([x], np.uint64)).view(np.int64)[0]) for x in sums]


def label_functions(depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``depth`` functions of each tree's label."""
    rng = np.random.RandomState(20_000_003)
    draw = lambda: rng.randint(0, 1 << 32, (TREES, DEEPEST), dtype=np.uint64).astype(np.uint32)[:, :depth].ravel()
    return draw(), draw() | np.uint32(1)


def node_keys(sets: list[np.ndarray], depth: int) -> np.ndarray:
    """One 64-bit key per set and tree: the trie node at ``depth``."""
    xor, times = label_functions(depth)
    least = np.empty((len(sets), TREES * depth), np.uint32)
    for row, own in enumerate(sets):
        low = np.full(TREES * depth, 0xFFFFFFFF, np.uint32)
        short = (own >> np.uint64(32)).astype(np.uint32)
        for at in range(0, len(short), 256):
            value = short[at : at + 256, None] ^ xor
            value *= times
            np.minimum(low, value.min(axis=0), out=low)
        least[row] = low
    least = least.reshape(len(sets), TREES, depth).astype(np.uint64)
    keys = np.broadcast_to(np.arange(1, TREES + 1, dtype=np.uint64), (len(sets), TREES)).copy()
    for k in range(depth):
        keys = kernels.mix(keys * np.uint64(0x9FB21C651E98DF25) + least[:, :, k])
    return keys.view(np.int64)


def count_links(sample: list[np.ndarray]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """A function of batches that counts the links of some sets to all rows, by step of similarity; for audits of recall.

    Only rows that hold enough of the sample's shingles for a link are
    compared. A task returns one row for each sampled set with links in it.
    """
    ids = set_ids(sample)
    sizes = np.array([len(s) for s in sample])
    owners = np.repeat(np.arange(len(sample)), sizes)
    values, times = np.unique(np.concatenate(sample), return_counts=True)
    order = np.argsort(np.concatenate(sample), kind="stable")
    owners = owners[order]
    begins = np.cumsum(times) - times

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros((len(sample), SIMILARITY_STEPS), np.int64)
        for batch in batches:
            for at in range(0, len(batch), 1000):
                sets = shingle_sets([t if isinstance(t, str) else "" for t in batch["text"].iloc[at : at + 1000]])
                for own, sid in zip(sets, set_ids(sets), strict=True):
                    if sid is None:
                        continue
                    place = np.minimum(np.searchsorted(values, own), len(values) - 1)
                    place = place[values[place] == own]
                    if len(place) < THRESHOLD * len(own) - 1e-6:
                        continue
                    n = times[place]
                    spans = np.repeat(begins[place] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    shared = np.bincount(owners[spans], minlength=len(sample))
                    alike = shared / (sizes + len(own) - shared)
                    near = np.flatnonzero(alike >= THRESHOLD - 1e-9)
                    step = ((alike[near] - THRESHOLD) / (1 - THRESHOLD) * SIMILARITY_STEPS + 1e-6).astype(int)
                    for i, k in zip(near, step, strict=True):
                        if ids[i] != sid:
                            counts[i, min(k, SIMILARITY_STEPS - 1)] += 1
        some = np.flatnonzero(counts.any(axis=1))
        if len(some):
            yield pd.DataFrame({"sampled": some, "counts": list(counts[some])})

    return count


def size_class(n: np.ndarray) -> np.ndarray:
    """Class of a set's size; sets within the threshold are in one class or in neighbours."""
    return np.floor(np.log(np.maximum(n, 1)) / -math.log(THRESHOLD) + 1e-9).astype(int)


def describe(batches: Iterator[pd.DataFrame], depth: int) -> Iterator[pd.DataFrame]:
    """Each row's set id, number of shingles, size class and trie nodes at ``depth``."""
    for batch in batches:
        for at in range(0, len(batch), 1000):
            part = batch.iloc[at : at + 1000]
            sets = shingle_sets([t if isinstance(t, str) else "" for t in part["text"]])
            sizes = np.array([len(s) for s in sets])
            yield pd.DataFrame({
                "doc_id": part["doc_id"].astype("Int64").to_numpy(),
                "sid": pd.array(set_ids(sets), dtype="Int64"),
                "n": sizes,
                "cls": size_class(sizes),
                "nodes": list(node_keys(sets, depth)),
            })


def attach_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        sets = shingle_sets(batch["text"].tolist())
        yield pd.DataFrame({"sid": pd.array(set_ids(sets), dtype="Int64"), "shingles": [s.tobytes() for s in sets]})


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two lists of sets, by products of incidence blocks."""
    values = np.concatenate([*left, *right])
    side = np.repeat(np.arange(len(left) + len(right)), [len(s) for s in [*left, *right]])
    _, column, count = np.unique(values, return_inverse=True, return_counts=True)
    shared = count[column] > 1
    if not shared.any():
        return np.zeros((len(left), len(right)), np.float32)
    _, column = np.unique(column[shared], return_inverse=True)
    side = side[shared]
    out = np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(column, kind="stable")
    column, side = column[order], side[order]
    step = max(32, min(2048, BLOCK_CELLS // (len(left) + len(right))))
    for first in range(0, int(column[-1]) + 1, step):
        b, e = np.searchsorted(column, [first, first + step])
        block = np.zeros((len(left) + len(right), step), np.float32)
        block[side[b:e], column[b:e] - first] = 1
        out += block[: len(left)] @ block[len(left) :].T
    return out


def compare(rows: pd.DataFrame) -> pd.DataFrame:
    """Links between the left and the right sets of one block, or among those on both sides.

    Returns for each set the copies that it is linked to and one set of its
    linked group.
    """
    rows = rows.drop_duplicates(["sid", "side"])
    left, right = rows[rows["side"] != "R"], rows[rows["side"] != "L"]
    alike = bool((rows["side"] == "B").all())
    a = [np.frombuffer(x, np.uint64) for x in left["shingles"]]
    b = a if alike else [np.frombuffer(x, np.uint64) for x in right["shingles"]]
    if not a or not b:
        return pd.DataFrame({"sid": [], "linked": [], "root": []}).astype("int64")
    size_a, size_b = np.array([len(s) for s in a]), np.array([len(s) for s in b])
    copies_a, copies_b = left["copies"].to_numpy(), right["copies"].to_numpy()
    id_a, id_b = left["sid"].to_numpy(), right["sid"].to_numpy()
    linked_a, linked_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    ids = np.unique(np.concatenate([id_a, id_b]))
    at_a, at_b = np.searchsorted(ids, id_a), np.searchsorted(ids, id_b)
    root = np.arange(len(ids))
    for at in range(0, len(a), 512):
        both = overlaps(a[at : at + 512], b)
        total = size_a[at : at + 512, None] + size_b[None, :] - both
        near = both >= THRESHOLD * total - 1e-6
        near &= id_a[at : at + 512, None] != id_b[None, :]
        linked_a[at : at + 512] += near @ copies_b
        if not alike:
            linked_b += copies_a[at : at + 512] @ near
        for i in np.flatnonzero(near.any(axis=1)):
            groups = np.unique(np.append(root[at_b[near[i]]], root[at_a[at + i]]))
            if len(groups) > 1:
                root[np.isin(root, groups)] = groups[0]
    out = pd.DataFrame({"sid": np.concatenate([id_a, id_b]), "linked": np.concatenate([linked_a, linked_b])})
    out = out.groupby("sid", as_index=False)["linked"].sum()
    out = out[out["linked"] > 0]
    out["root"] = ids[root[np.searchsorted(ids, out["sid"].to_numpy())]]
    return out.astype("int64")


def candidate_components(labels: DataFrame) -> DataFrame:
    """sid and component of all sets that share a trie node with another set."""
    rows = labels.select("sid", "cls", F.explode("nodes").alias("node"))
    groups = rows.groupBy("node", "cls").agg(F.min("sid").alias("low"), F.max("sid").alias("high"))
    near = groups.select("node", (F.col("cls") - 1).alias("cls"), F.col("low").alias("next"))
    joined = groups.join(near, ["node", "cls"], "left").where("low <> high OR next IS NOT NULL")
    kept = materialise(joined, "nodes")
    stars = rows.join(kept.where("low <> high").select("node", "cls", "low"), ["node", "cls"]).select(
        F.col("sid").alias("src"), F.col("low").alias("dst")
    )
    bridges = kept.where("next IS NOT NULL").select(F.col("low").alias("src"), F.col("next").alias("dst"))
    links = stars.where("src <> dst").union(bridges.where("src <> dst"))
    return connected_components(links).select(F.col("node").alias("sid"), "component")


def block_plan(members: DataFrame) -> DataFrame:
    """sid, block and side for all comparisons; members has sid, component, cls and n.

    A component of at most ``BLOCK_SHINGLES`` shingles is one block. A larger
    one is cut by size class and hash; each part meets itself, the other parts
    of its class and those of the next class.
    """
    sizes = members.groupBy("component", "cls").agg(F.sum("n").alias("m"))
    totals = sizes.groupBy("component").agg(F.sum("m").alias("all"))
    parts = sizes.join(totals, "component").select(
        "component", "cls", (F.col("all") > BLOCK_SHINGLES).alias("cut"), F.ceil(F.col("m") / BLOCK_SHINGLES).cast("int").alias("parts")
    )
    up = parts.select("component", (F.col("cls") - 1).alias("cls"), F.col("parts").alias("above"))
    down = parts.select("component", (F.col("cls") + 1).alias("cls"), F.col("parts").alias("below"))
    table = parts.join(up, ["component", "cls"], "left").join(down, ["component", "cls"], "left")
    table = table.select("component", "cls", "cut", "parts", F.coalesce("above", F.lit(0)).alias("above"), F.coalesce("below", F.lit(0)).alias("below"))
    table = materialise(table, "parts")  # a join of its own, whose hot components Spark can split
    at = F.pmod(F.xxhash64("sid", F.lit(7)), F.col("parts")).cast("int")
    name = lambda c, i, d, j: F.concat_ws(":", c.cast("string"), i.cast("string"), d.cast("string"), j.cast("string"))
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    cls = F.col("cls")
    own = F.transform(
        upto(F.col("parts")),
        lambda j: F.struct(
            name(cls, F.least(at, j), cls, F.greatest(at, j)).alias("pair"),
            F.when(at == j, F.lit("B")).when(at < j, F.lit("L")).otherwise(F.lit("R")).alias("side"),
        ),
    )
    above = F.transform(upto(F.col("above")), lambda j: F.struct(name(cls, at, cls + 1, j).alias("pair"), F.lit("L").alias("side")))
    below = F.transform(upto(F.col("below")), lambda j: F.struct(name(cls - 1, j, cls, at).alias("pair"), F.lit("R").alias("side")))
    whole = F.array(F.struct(F.lit("all").alias("pair"), F.lit("B").alias("side")))
    planned = members.join(table, ["component", "cls"]).withColumn("__to", F.when(F.col("cut"), F.concat(own, above, below)).otherwise(whole))
    return planned.select("sid", "copies", "component", F.explode("__to").alias("to")).select("sid", "copies", "component", "to.pair", "to.side")


def jaccard_links(docs: DataFrame) -> DataFrame:
    """Classes and numbers of links of all rows of ``docs`` (doc_id, text, ...).

    Rows are linked if the Jaccard similarity of their shingle sets is at
    least ``THRESHOLD``. Returns doc_id, class_id (the least doc_id of the
    rows that links connect) and n_links (other rows linked to this one), one
    row for each row of docs. Null and empty texts and texts without a word
    have no links and are classes of their own; equal rows are linked to each
    other; ties in doc_id do not matter; other columns are ignored.
    """
    spark = docs.sparkSession
    let_workers_import(spark)
    plain = docs.select("doc_id", "text")
    depth = matched_prefix(np.zeros((0, SIMILARITY_STEPS)))
    known = materialise(plain.mapInPandas(lambda batches: describe(batches, depth), "doc_id long, sid long, n int, cls int, nodes array<long>"), "sets")
    worded = known.where("sid IS NOT NULL")
    sets = worded.groupBy("sid").agg(
        F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.max("n").alias("n"), F.max("cls").alias("cls")
    )
    sets = materialise(sets, "set-heads")
    labels = worded.select("doc_id", "sid", "cls", "nodes").join(sets.select("doc_id", "sid"), ["doc_id", "sid"], "left_semi")
    parts = candidate_components(labels)
    members = materialise(parts.join(sets, "sid"), "members")
    plan = block_plan(members)
    texts = plain.where("text IS NOT NULL").join(members.select("doc_id").distinct(), "doc_id", "left_semi")
    shingles = texts.mapInPandas(attach_sets, "sid long, shingles binary").where("sid IS NOT NULL")
    found = (
        plan.join(shingles, "sid")
        .groupBy("component", "pair")
        .applyInPandas(lambda rows: compare(rows[["sid", "copies", "side", "shingles"]]), "sid long, linked long, root long")
    )
    found = materialise(found, "links")
    tree = connected_components(found.select(F.col("sid").alias("src"), F.col("root").alias("dst")))
    counts = found.groupBy("sid").agg(F.sum("linked").alias("linked"))
    labelled = sets.join(tree.select(F.col("node").alias("sid"), "component"), "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    least = labelled.groupBy("component").agg(F.min("doc_id").alias("class_id"))
    per_set = labelled.join(least, "component").join(counts, "sid", "left").select(
        "sid", "class_id", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    return known.join(per_set, "sid", "left").select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, less the repeats: of linked rows one stays.

    The row with the class's least doc_id stays; of several rows with that id
    one does. Rows without links stay, those with a null doc_id too.
    """
    links = jaccard_links(docs.select("doc_id", "text")).select(F.col("doc_id").alias("__id"), "class_id")
    gone = links.where("class_id <> __id").select("__id").distinct()
    left = docs.join(gone, docs["doc_id"] == gone["__id"], "left_anti")
    tied = left.groupBy("doc_id").count().where("count > 1 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("__id"))
    columns = left.columns
    single = left.join(tied, left["doc_id"] == tied["__id"], "left_anti")
    repeated = left.join(tied, left["doc_id"] == tied["__id"], "left_semi").dropDuplicates(["doc_id", "text"])
    return single.select(*columns).unionByName(repeated.select(*columns))
