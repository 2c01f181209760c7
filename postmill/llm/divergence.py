"""Divergence of sources from each other and from their language, by mergeable radix tries.

A term is a run of ASCII letters and characters above ASCII, with only A to Z
lower-cased; texts are read as UTF-8 bytes and never cut. Null text, lang and
source count as ''. A language keeps the terms of at least ``LEAST_DOCUMENTS``
of its rows; repeated rows and equal or null ids count once each.

1. Every task counts its rows in one byte trie a language, whose leaves have a
   counter a source and a number of documents. A trie over ``TRIE_COUNTERS``
   counters is written out and begun anew, so a task's memory is bounded. Its
   leaves leave as rows in UTF-8 order; the root's counters say which sources
   occur, with terms or without.
2. The rows are dealt by ranges of (lang, term), so a range of prefixes has all
   its leaves, and each range is merged in a trie again. Its traversal drops
   rare terms and writes chunks of at most ``CHUNK_TERMS`` terms and about
   ``CHUNK_COUNTERS`` counters.
3. Totals by language and source are sums over chunks. Sources are dealt into
   blocks of ``BLOCK_SOURCES``; each chunk meets each pair of blocks of its
   language once, in a bucket of chunks, and yields sums for pairs of sources
   and, where a block meets itself, each source's best candidates, ordered by
   value and then by term. What tasks keep meanwhile is bounded by the blocks.

Shares are whole numbers p = 1 + floor(10**9 (count + 1) / (N + V)), and the
divergence of p from q on a term is floor((p - q)**2 / q). Both are exact: with
p and q up to 10**9 + 1 the square fits 64 bits, and the sum of squares over all
terms is at most the square of the sum of shares.

A row of the result: a source's distance to each other source of its language
(part ``pair``, all ranks) or a term that it uses more than its language does
(part ``term``, the first ``TOP_TERMS``). A language without kept terms has
distances of 0 and no terms; a source without terms has all shares equal; an
empty table has no rows.
"""

from __future__ import annotations

import heapq
import itertools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postmill.llm.common import let_workers_import
from postmill.session import materialise

LEAST_DOCUMENTS = 3
TOP_TERMS = 200
SCALE = 1_000_000_000
#: Counters of a task's tries before they are written out, words that wait to be counted, and rows of a batch of leaves.
TRIE_COUNTERS, WAITING_WORDS, LEAF_ROWS = 1 << 20, 1 << 20, 1 << 14
DOCUMENTS = None
CHUNK_TERMS, CHUNK_COUNTERS = 4096, 1 << 16
BLOCK_SOURCES = 256
#: Kept terms of a language that one bucket of its chunks has, about; a language may hold a third of all chunks and more.
BUCKET_TERMS = 1 << 16

LETTERS = {*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)}
#: Byte by byte: A to Z in lower case, all that is outside a term a space.
FOLD = bytes((b + 32 if 0x41 <= b <= 0x5A else b) if b in LETTERS else 32 for b in range(256))


class Trie:
    """A radix trie over bytes whose leaves count documents, and occurrences by source.

    An inner node has a child for each next byte and one for the end of a term;
    below them a container holds the remaining labels of up to ``BURST`` leaves
    and becomes an inner node beyond that. A leaf maps sources to occurrences,
    and ``DOCUMENTS`` to the number of documents.
    """

    BURST = 2048
    END = 256

    def __init__(self) -> None:
        self.root: list | dict = {}
        self.counters = 0

    def leaf(self, term: bytes) -> dict:
        """The leaf of a term, made if it is new."""
        node, above, at, i = self.root, None, 0, 0
        while type(node) is list:
            above, at = node, term[i] if i < len(term) else self.END
            node = above[at]
            i += 1
            if node is None:
                node = above[at] = {}
        rest = term[i:]
        found = node.get(rest)
        if found is None:
            found = node[rest] = {DOCUMENTS: 0}
            if len(node) > self.BURST:
                parted: list = [None] * 257
                for label, leaf in node.items():
                    slot = label[0] if label else self.END
                    if parted[slot] is None:
                        parted[slot] = {}
                    parted[slot][label[1:]] = leaf
                if above is None:
                    self.root = parted
                else:
                    above[at] = parted
        return found

    def add(self, term: bytes, documents: int, occurrences: dict[str, int]) -> None:
        """Count a term, or merge another trie's leaf."""
        leaf = self.leaf(term)
        before = len(leaf)
        leaf[DOCUMENTS] += documents
        for source, n in occurrences.items():
            leaf[source] = leaf.get(source, 0) + n
        self.counters += len(leaf) - before

    def walk(self) -> Iterator[tuple[bytes, dict]]:
        """Terms in the order of their bytes, with their leaves."""
        stack: list[tuple[bytes, list | dict]] = [(b"", self.root)]
        while stack:
            above, node = stack.pop()
            if type(node) is list:
                if node[self.END]:
                    yield above, node[self.END][b""]
                stack += [(above + bytes([k]), node[k]) for k in range(255, -1, -1) if node[k] is not None]
            else:
                for label in sorted(node):
                    yield above + label, node[label]


LEAF = pa.schema([("lang", pa.string()), ("term", pa.binary()), ("documents", pa.int64()), ("sources", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])
LEAF_DDL = "lang string, term binary, documents long, sources array<string>, counts array<long>"


def leaves(tries: dict[str, Trie]) -> Iterator[pa.RecordBatch]:
    """The leaves of tries as rows, in order."""
    for lang, trie in tries.items():
        walk = trie.walk()
        while some := list(itertools.islice(walk, LEAF_ROWS)):
            documents = [leaf.pop(DOCUMENTS) for _, leaf in some]
            offsets = pa.array(np.cumsum([0, *(len(leaf) for _, leaf in some)]), pa.int32())
            sources = pa.array(list(itertools.chain.from_iterable(leaf for _, leaf in some)), pa.string())
            counts = pa.array(list(itertools.chain.from_iterable(leaf.values() for _, leaf in some)), pa.int64())
            columns = [pa.array([lang] * len(some)), pa.array([t for t, _ in some], pa.binary()), pa.array(documents, pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(offsets, sources), pa.ListArray.from_arrays(offsets, counts)], schema=LEAF)


def pour(groups: dict[tuple[str, str], list[list[bytes]]], tries: dict[str, Trie]) -> None:
    """Count the words of rows, listed by (lang, source), in the languages' tries; a leaf is looked up once for all sources."""
    found: dict[str, dict[bytes, dict]] = {}
    for (lang, source), texts in groups.items():
        trie, known = tries.setdefault(lang, Trie()), found.setdefault(lang, {})
        held = Counter(itertools.chain.from_iterable(map(set, texts)))
        said = Counter(itertools.chain.from_iterable(texts))
        for term, n in said.items():
            leaf = known.get(term)
            if leaf is None:
                leaf = known[term] = trie.leaf(term)
            leaf[DOCUMENTS] += held[term]
            if source in leaf:
                leaf[source] += n
            else:
                leaf[source] = n
                trie.counters += 1
        trie.add(b"", len(texts), {source: 0})
    groups.clear()


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Leaves of the tries of one task's rows (lang, source, text)."""
    tries: dict[str, Trie] = {}
    groups: dict[tuple[str, str], list[list[bytes]]] = {}
    waiting = 0
    for batch in batches:
        for lang, source, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            words = text.translate(FOLD).split() if text else []
            groups.setdefault((lang, source), []).append(words)
            waiting += len(words) + 1
            if waiting >= WAITING_WORDS:
                pour(groups, tries)
                waiting = 0
                if sum(t.counters for t in tries.values()) >= TRIE_COUNTERS:
                    yield from leaves(tries)
                    tries.clear()
    pour(groups, tries)
    yield from leaves(tries)


CHUNK = pa.schema(
    [("lang", pa.string()), ("first", pa.binary()), ("n_terms", pa.int64()), ("sources", pa.list_(pa.string())), ("totals", pa.list_(pa.int64())), ("terms", pa.list_(pa.binary()))]
    + [("term_at", pa.list_(pa.int32())), ("source_at", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64()))]
)
CHUNK_DDL = (
    "lang string, first binary, n_terms long, sources array<string>, totals array<long>, terms array<binary>, term_at array<int>, source_at array<int>, counts array<long>"
)


def chunk(lang: str, trie: Trie) -> Iterator[pa.RecordBatch]:
    """The kept terms of one trie; a chunk that holds the root is written though it may have no term."""
    terms, at, names, counts, known = [], [], [], [], {}
    totals: list[int] = []
    root = False
    for term, leaf in trie.walk():
        del leaf[DOCUMENTS]
        for source, n in leaf.items():
            k = known.setdefault(source, len(known))
            if k == len(totals):
                totals.append(0)
            if term:
                totals[k] += n
                at.append(len(terms))
                names.append(k)
                counts.append(n)
        if term:
            terms.append(term)
        root = root or not term
    if root or terms:
        first = b"" if root else terms[0]
        row = [lang, first, len(terms), list(known), totals, terms, at, names, counts]
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, CHUNK.types, strict=True)], schema=CHUNK)


def combined(leaves: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """Sorted leaves with those of one lang and term added up.

    The first row of each term, its documents, where its counters begin in the
    lists of sources and occurrences, the names of sources, and those lists.
    """
    lang, term = (leaves.column(i).combine_chunks() for i in range(2))
    new = np.ones(len(term), bool)
    new[1:] = pc.or_(pc.not_equal(term[1:], term[:-1]), pc.not_equal(lang[1:], lang[:-1])).to_numpy(zero_copy_only=False)
    firsts = np.flatnonzero(new)
    documents = np.add.reduceat(leaves.column(2).to_numpy(), firsts)
    sources = leaves.column(3).combine_chunks()
    coded = sources.flatten().dictionary_encode()
    counts = leaves.column(4).combine_chunks().flatten().to_numpy()
    key = np.repeat(np.cumsum(new) - 1, np.diff(sources.offsets.to_numpy())) * len(coded.dictionary) + coded.indices.to_numpy()
    order = np.argsort(key, kind="stable")
    key = key[order]
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    begins = np.searchsorted(key[starts] // len(coded.dictionary), np.arange(len(firsts) + 1))
    return firsts, documents, begins, coded.dictionary, key[starts] % len(coded.dictionary), np.add.reduceat(counts[order], starts)


def merge_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of merged leaves; rows come in the order of lang and term, so a term is complete before the next begins."""
    trie, now, kept = Trie(), None, 0
    held: pa.RecordBatch | None = None  # the last term, which may go on
    for batch in itertools.chain(batches, [None]):
        parts = [b for b in (held, batch) if b is not None and b.num_rows]
        if not parts:
            continue
        rows = pa.Table.from_batches([b.cast(LEAF) for b in parts])
        firsts, documents, begins, names, codes, counts = combined(rows)
        done = len(firsts) - (batch is not None)
        lang, term, names = rows.column(0), rows.column(1), names.to_pylist()
        at = np.flatnonzero((documents >= LEAST_DOCUMENTS) | (pc.binary_length(term).to_numpy()[firsts] == 0))
        at = at[at < done]
        langs, terms = (c.take(pa.array(firsts[at])).to_pylist() for c in (lang, term))
        for g, own_lang, own_term in zip(at.tolist(), langs, terms, strict=True):
            if own_lang != now or kept >= CHUNK_TERMS or trie.counters >= CHUNK_COUNTERS:
                if now is not None:
                    yield from chunk(now, trie)
                trie, now, kept = Trie(), own_lang, 0
            inside = slice(begins[g], begins[g + 1])
            trie.add(own_term, int(documents[g]), dict(zip([names[c] for c in codes[inside].tolist()], counts[inside].tolist(), strict=True)))
            kept += 1
        held = None
        if batch is not None:
            inside = slice(begins[-2], begins[-1])
            own = [[names[c] for c in codes[inside].tolist()], counts[inside].tolist()]
            last = [lang[-1].as_py(), term[-1].as_py(), int(documents[-1]), *own]
            held = pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(last, LEAF.types, strict=True)], schema=LEAF)
    if now is not None:
        yield from chunk(now, trie)


def shares(counts: np.ndarray, total: np.ndarray | int, n_terms: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 1) / (total + n_terms)), exactly."""
    if not counts.size or int(counts.max(initial=0)) < (1 << 62) // SCALE:
        return 1 + SCALE * (counts + 1) // (total + n_terms)
    return (1 + SCALE * (counts.astype(object) + 1) // (np.asarray(total).astype(object) + n_terms)).astype(np.int64)


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


PART = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.binary()), ("value", pa.int64())])
PART_DDL = "lang string, source string, part string, item binary, value long"


def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums for pairs of sources and each source's best terms, of the chunks of one task.

    Input rows are a chunk's columns, the language's number of kept terms and
    total, and two blocks of sources with their totals and whether they are
    the same block. Rows of one pair of blocks come one after the other.
    """
    now, sums, best = None, None, {}

    def result() -> Iterator[pa.RecordBatch]:
        if now is None:
            return
        lang, left, right = now
        rows = [(lang, a, "pair", b.encode(), int(sums[i, j])) for i, a in enumerate(left) for j, b in enumerate(right) if a != b]
        rows += [(lang, a, "term", term, value) for a, found in best.items() for value, term in found]
        for k in range(0, len(rows), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + (1 << 16)], strict=True), PART.types, strict=True)], schema=PART)

    for batch in batches:
        for row in batch.to_pylist():
            key = (row["lang"], tuple(row["left"]), tuple(row["right"]))
            if key != now:
                yield from result()
                now, sums, best = key, np.zeros((len(row["left"]), len(row["right"])), np.int64), {}
            n_terms = row["kept"]
            if not row["n_terms"]:
                continue
            term_at, source_at, counts = (np.array(row[c], np.int64) for c in ("term_at", "source_at", "counts"))
            p = block_shares(row, "left", term_at, source_at, counts)
            q = p if row["same"] else block_shares(row, "right", term_at, source_at, counts)
            for i in range(len(p[0])):
                sums[i] += divergence(p[0][i], q[0]).sum(axis=1)
            if row["same"]:
                whole = np.zeros(row["n_terms"], np.int64)
                np.add.at(whole, term_at, counts)
                lang_share = shares(whole, row["lang_total"], n_terms)
                for i, source in enumerate(row["left"]):
                    at = np.flatnonzero((p[1][i] > 0) & (p[0][i] > lang_share))
                    if len(at):
                        value = divergence(p[0][i][at], lang_share[at])
                        order = np.lexsort((at, -value))[:TOP_TERMS]
                        own = [(int(value[k]), row["terms"][at[k]]) for k in order]
                        best[source] = heapq.nsmallest(TOP_TERMS, [*best.get(source, []), *own], key=lambda x: (-x[0], x[1]))
    yield from result()


def block_shares(row: dict, side: str, term_at: np.ndarray, source_at: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shares and counts of one block's sources on a chunk's terms."""
    place = {source: i for i, source in enumerate(row[side])}
    where = np.array([place.get(s, -1) for s in row["sources"]], np.int64)[source_at]
    held = np.zeros((len(place), row["n_terms"]), np.int64)
    inside = where >= 0
    held[where[inside], term_at[inside]] = counts[inside]
    return shares(held, np.array(row[f"{side}_totals"], np.int64)[:, None], row["kept"]), held


def divergences(docs: DataFrame) -> DataFrame:
    """Lang, source, part, item, value and rank of every pair of sources and of each source's leading terms."""
    spark = docs.sparkSession
    let_workers_import(spark)
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(blank("lang").alias("lang"), blank("source").alias("source"), F.col("text").cast("binary").alias("text"))
    counted = materialise(rows.mapInArrow(count_terms, LEAF_DDL), "term-leaves")
    ranges = counted.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term")
    chunks = materialise(ranges.mapInArrow(merge_ranges, CHUNK_DDL), "term-chunks")
    totals = chunks.select("lang", F.explode(F.arrays_zip("sources", "totals")).alias("s")).groupBy("lang", F.col("s.sources").alias("source")).agg(F.sum("s.totals").alias("total"))
    most = chunks.groupBy("lang").agg(F.sum("n_terms").alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0
    buckets = -(-most // BUCKET_TERMS) or 1
    by_lang = totals.groupBy("lang").agg(F.sum("total").alias("lang_total")).join(chunks.groupBy("lang").agg(F.sum("n_terms").alias("kept")), "lang")
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    dealt = totals.withColumn("block", F.floor(place / BLOCK_SOURCES)).groupBy("lang", "block").agg(F.sort_array(F.collect_list(F.struct("source", "total"))).alias("own"))
    side = lambda name: dealt.select("lang", F.col("block").alias(f"{name}_block"), F.col("own.source").alias(name), F.col("own.total").alias(f"{name}_totals"))
    blocks = side("left").join(side("right"), "lang").join(by_lang, "lang")
    blocks = blocks.withColumn("same", F.col("left_block") == F.col("right_block")).withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    met = chunks.withColumn("bucket", F.pmod(F.xxhash64("first"), F.lit(buckets)).cast("int")).join(blocks, ["lang", "bucket"])
    found = met.sortWithinPartitions("lang", "left_block", "right_block").mapInArrow(compare, PART_DDL)
    found = found.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = found.withColumn("rank", F.row_number().over(order)).where((F.col("part") == "pair") | (F.col("rank") <= TOP_TERMS))
    return ranked.select("lang", "source", "part", F.col("item").cast("string").alias("item"), "value", "rank")
