"""Token-id files: documents' ids in one array, boundaries in Elias-Fano form.

A block of the format is a byte string::

    b"EFTB"  u32 version  u64 documents  u64 ids  u32 id bytes  boundaries  ids

    boundaries: u32 low bits  u32 numbers  u32 bytes of low and of upper parts
    select directory  low parts, packed  upper parts in unary

Boundaries are the running ends of the documents. The lower bits of each lie
packed side by side; the upper bits are gaps in unary, so that the i-th set
bit at position p stands for the value p - i. The select directory holds the
position of every ``SAMPLE``-th set bit, half a bit a document; offsets are
found from there by looking at the bits of one sample. This takes about
2.5 + log2(ids / documents) bits a document and no 64-bit table.

Ids are little-endian, two bytes where the vocabulary allows. A block's
document ids go through the same coder where they ascend from 0 or more, and
are plain integers with a mask of nulls otherwise. On disk the blocks are rows
of a Parquet table, whose files every reader of the cluster can open: part,
block, doc_ids, payload.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postmill.llm import kernels
from postmill.llm.common import let_workers_import
from postmill.llm.kernels import slices
from postmill.session import fresh_path

MAGIC, VERSION = b"EFTB", 1
HEAD = struct.Struct("<4sIQQI")
PARTS = struct.Struct("<IIII")
#: Set bits for each entry of the select directory, and numbers read in one step.
SAMPLE, STEP = 64, 4096
BLOCK_IDS = 1 << 20
END_ID = 0
#: Characters encoded in one step, and documents' words compared with the memory.
STEP_CHARS = 1 << 20
#: A worker's memory of pieces: slots, and ids in all.
SLOT_BITS = 21
STORE_IDS = 12 << 20
BLOCK_SCHEMA = "part int, block long, n_docs long, n_ids long, doc_ids binary, payload binary"
SPAN_SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"
#: White space whose treatment depends on more than its neighbours.
LONG_SPACE = re.compile(r"\s\s\s|\s\s\Z")


def pack_numbers(numbers: np.ndarray) -> bytes:
    """Elias-Fano form of numbers from 0 that do not descend, with its select directory."""
    n, universe = len(numbers), int(numbers[-1]) + 1 if len(numbers) else 1
    width = max(0, (universe // max(1, n)).bit_length() - 1)
    numbers = numbers.astype(np.uint64)
    low = ((numbers[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    high = (numbers >> np.uint64(width)).astype(np.int64) + np.arange(n)
    bits = np.zeros(int(high[-1]) + 1 if n else 0, np.uint8)
    bits[high] = 1
    low_bytes, high_bytes = (np.packbits(x, bitorder="little").tobytes() for x in (low.ravel(), bits))
    return PARTS.pack(width, n, len(low_bytes), len(high_bytes)) + high[::SAMPLE].astype("<u4").tobytes() + low_bytes + high_bytes


class Numbers:
    """Random access to numbers packed by :func:`pack_numbers`, through the select directory."""

    def __init__(self, data: bytes, at: int = 0) -> None:
        self.width, self.n, low, high = PARTS.unpack_from(data, at)
        at += PARTS.size
        samples = -(-self.n // SAMPLE)
        self.directory = np.frombuffer(data, "<u4", samples, at)
        self.low = np.frombuffer(data, np.uint8, low, at + 4 * samples)
        self.high = np.frombuffer(data, np.uint8, high, at + 4 * samples + low)
        self.end = at + 4 * samples + low + high

    def select(self, first: int, last: int) -> np.ndarray:
        """The numbers from ``first`` to before ``last``, from the bits between their samples."""
        if last <= first:
            return np.zeros(0, np.int64)
        sample, upto = first // SAMPLE, (last - 1) // SAMPLE + 1
        begin = int(self.directory[sample]) >> 3
        end = (int(self.directory[upto]) >> 3) + 1 if upto < len(self.directory) else len(self.high)
        places = np.flatnonzero(np.unpackbits(self.high[begin:end], bitorder="little")) + 8 * begin
        places = places[np.searchsorted(places, self.directory[sample]) :][first - sample * SAMPLE : last - sample * SAMPLE]
        values = (places - np.arange(first, last)) << self.width
        begin = first * self.width >> 3
        bits = np.unpackbits(self.low[begin : (last * self.width + 7) >> 3], bitorder="little")[first * self.width - 8 * begin :]
        bits = bits[: (last - first) * self.width].reshape(last - first, self.width)
        return values + bits.astype(np.int64) @ (1 << np.arange(self.width, dtype=np.int64)) if self.width else values

    def steps(self) -> Iterator[tuple[int, np.ndarray]]:
        """All numbers in steps of bounded size, each with the place of its first."""
        for first in range(0, self.n, STEP):
            yield first, self.select(first, min(first + STEP, self.n))


def pack_ids(ids: list[int | None]) -> bytes:
    """A block's document ids."""
    mask = np.array([i is None for i in ids], bool)
    plain = np.array([0 if i is None else i for i in ids], "<i8")
    if len(ids) and not mask.any() and plain[0] >= 0 and (plain[1:] >= plain[:-1]).all():
        return b"\x01" + struct.pack("<q", plain[0]) + pack_numbers(plain - plain[0])
    return b"\x00" + np.packbits(mask).tobytes() + plain.tobytes()


def unpack_ids(data: bytes, first: int, last: int, n: int) -> pa.Array:
    """The document ids from ``first`` to before ``last`` of a block of ``n``."""
    if data[0]:
        return pa.array(Numbers(data, 9).select(first, last) + struct.unpack_from("<q", data, 1)[0], pa.int64())
    size = (n + 7) // 8
    mask = np.unpackbits(np.frombuffer(data, np.uint8, size, 1), count=n).astype(bool)
    return pa.array(np.frombuffer(data, "<i8", last - first, 1 + size + 8 * first), pa.int64(), mask=mask[first:last])


def encode_block(arrays: list[np.ndarray], id_bytes: int) -> bytes:
    """One block of the given documents' ids."""
    ids = np.concatenate(arrays).astype("<u2" if id_bytes == 2 else "<u4") if arrays else np.zeros(0, "<u2")
    ends = np.cumsum([len(a) for a in arrays], dtype=np.int64)
    return HEAD.pack(MAGIC, VERSION, len(arrays), len(ids), id_bytes) + pack_numbers(ends) + ids.tobytes()


def decode_block(data: bytes) -> tuple[Numbers, np.ndarray]:
    """Boundaries and ids of a block."""
    magic, version, _, n, id_bytes = HEAD.unpack_from(data)
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a token block")
    bounds = Numbers(data, HEAD.size)
    return bounds, np.frombuffer(data, "<u2" if id_bytes == 2 else "<u4", n, bounds.end)


def splits_as_assumed(tokenizer) -> bool:
    """Whether a tokenizer splits as :class:`Encoder` takes for granted."""
    parts = json.loads(tokenizer.to_str())
    split, model = parts["pre_tokenizer"] or {}, parts["model"]
    plain = parts["normalizer"] is None and model["type"] == "BPE" and not (model.get("dropout") or model.get("ignore_merges"))
    marked = any(model.get(k) for k in ("continuing_subword_prefix", "end_of_word_suffix"))
    return plain and not marked and split.get("type") == "ByteLevel" and split.get("use_regex") is True and not split.get("add_prefix_space")


class Encoder:
    """The library's tokenizer behind a bounded memory of pieces.

    A byte-level tokenizer first splits a text into pieces that are encoded
    one by one. Before a space, around a line break, and between a letter and
    the ASCII punctuation that ends a word it always splits, as long as white
    space does not run on. So a batch is cut there by array operations, equal
    pieces are found by digest, and each different piece goes to the library
    once. Texts in which white space runs on, and those that hold the string
    of a special token, go to the library whole, and so do all texts where the
    tokenizer file asks for another way of splitting.
    """

    TAIL = ".,!?;:"

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.alone = not splits_as_assumed(self.tokenizer)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.forget()
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
        self.shown = np.arange(256, dtype="<u4")
        self.shown[sorted({*range(256)} - {*plain})] = np.arange(256, 512 - len(plain))
        self.tail = np.zeros(0x10000, bool)
        self.tail[[ord(c) for c in self.TAIL]] = True

    def forget(self) -> None:
        """Empty the memory: for each slot a piece's digest and the place and number of its ids."""
        self.keys = np.zeros(1 << SLOT_BITS, np.uint64)
        self.places = np.zeros(1 << SLOT_BITS, np.int64)
        self.sizes = np.zeros(1 << SLOT_BITS, np.int32)
        self.store, self.used = np.zeros(STORE_IDS, self.dtype), 0

    def library(self, texts: list[str]) -> list[np.ndarray]:
        coded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(c.ids, self.dtype) for c in coded]

    def letters(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces that are letters after at most one space, which the library never splits."""
        raw = np.frombuffer("\0".join(pieces).encode("utf-8"), np.uint8)
        shown = self.shown[raw].tobytes().decode("utf-32-le").split(chr(self.shown[0])) if pieces else []
        kind, tokenize = self.dtype.str, self.model.tokenize
        ids = [[t.id for t in tokenize(w)] for w in shown]
        flat = np.array([i for own in ids for i in own], kind).tobytes()
        ends = (np.cumsum([len(own) for own in ids]) * self.dtype.itemsize).tolist() if ids else []
        return [flat[b:e] for b, e in zip([0, *ends], ends, strict=False)]

    def whole(self, text: str) -> bool:
        return self.alone or "\0" in text or any(s in text for s in self.specials) or bool(LONG_SPACE.search(text))

    def cuts(self, codes: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Where pieces begin."""
        flat = np.minimum(codes, 0xFFFF)
        start = (codes == 32) | (codes == 10)
        start[1:] |= codes[:-1] == 10
        start[begins] = True
        tail = self.tail[flat]
        n = len(codes)
        ahead = lambda mask: np.minimum.accumulate(np.where(mask, np.arange(n), n)[::-1])[::-1]
        ends_word = tail[1:] & kernels.ALPHA[flat[:-1]]
        ends_word &= ahead(start)[1:] <= ahead(~tail)[1:]
        start[1:] |= ends_word
        return np.flatnonzero(start)

    def encode(self, pieces: list[str]) -> list[bytes]:
        plain = [w.removeprefix(" ").isalpha() for w in pieces]
        simple = iter(self.letters([w for w, p in zip(pieces, plain, strict=True) if p]))
        other = iter(self.library([w for w, p in zip(pieces, plain, strict=True) if not p]))
        return [next(simple) if p else next(other).tobytes() for p in plain]

    def batch(self, texts: list[str]) -> list[np.ndarray]:
        """Each text's ids."""
        out: list[np.ndarray | None] = [np.zeros(0, self.dtype)] * len(texts)
        direct = [i for i, t in enumerate(texts) if self.whole(t)]
        for i, coded in zip(direct, self.library([texts[i] for i in direct]), strict=True):
            out[i] = coded
        known = set(direct)
        rest = [i for i, t in enumerate(texts) if t and i not in known]
        if not rest:
            return out
        joined = "".join(texts[i] for i in rest)
        codes = kernels.code_points(joined)
        begins = np.cumsum([0] + [len(texts[i]) for i in rest])
        starts = self.cuts(codes, begins[:-1])
        ends = np.append(starts[1:], len(codes))
        keys = kernels.Spans(codes).digests(starts, ends, exact=True) | np.uint64(1)
        slots = (keys >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        offsets, each = self.places[slots], self.sizes[slots].astype(np.int64)
        missed = np.flatnonzero(self.keys[slots] != keys)
        fresh, first, which = np.unique(keys[missed], return_index=True, return_inverse=True)
        first = missed[first]
        coded = self.encode([joined[b:e] for b, e in zip(starts[first].tolist(), ends[first].tolist(), strict=True)])
        new_sizes = np.array([len(c) for c in coded], np.int64) // self.dtype.itemsize
        new_ids = np.frombuffer(b"".join(coded), self.dtype)
        if self.used + len(new_ids) > len(self.store):
            store = np.concatenate([self.store[: self.used], new_ids])  # for this batch alone
            learn = False
        else:
            self.store[self.used : self.used + len(new_ids)] = new_ids
            store, learn = self.store, True
        new_places = self.used + np.cumsum(new_sizes) - new_sizes
        offsets[missed], each[missed] = new_places[which], new_sizes[which]
        if learn:
            self.used += len(new_ids)
            to = (fresh >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
            self.places[to], self.sizes[to], self.keys[to] = new_places, new_sizes, fresh
            last = np.zeros(len(fresh), bool)
            last[np.unique(to[::-1], return_index=True)[1]] = True
            drop = np.flatnonzero(~last[::-1])
            mixed = to[drop]  # slots that two fresh pieces share hold one piece's values, the last one's
            self.keys[mixed] = 0
        upto = np.cumsum(each)
        flat = store[np.repeat(offsets - (upto - each), each) + np.arange(upto[-1])]
        if not learn:
            self.forget()
        upto = np.concatenate(([0], upto))
        marks = upto[np.searchsorted(starts, begins)]
        for i, b, e in zip(rest, marks[:-1], marks[1:], strict=True):
            out[i] = flat[b:e]
        return out


ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file, made once."""
    if path not in ENCODERS:
        ENCODERS[path] = Encoder(path)
    return ENCODERS[path]


def write_token_files(docs: DataFrame, path: str, tokenizer: str) -> None:
    """Write the ids of all rows of ``docs`` (doc_id, text, ...) to ``path``.

    Rows go in ascending doc_id (nulls first, equal ids by text); a null text
    is empty; ``END_ID`` ends every document. Rows are range-partitioned by
    id, and every task cuts its range into blocks of about ``BLOCK_IDS`` ids.
    """
    let_workers_import(docs.sparkSession)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        coder = encoder(tokenizer)
        size = coder.dtype.itemsize
        end = np.array([END_ID], coder.dtype)
        ids, arrays, count = [], [], 0

        def emit() -> pa.RecordBatch:
            row = [part, number, len(ids), count, pack_ids(ids), encode_block(arrays, size)]
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            names = ["part", "block", "n_docs", "n_ids", "doc_ids", "payload"]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], names)

        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            keys = batch.column("doc_id").to_pylist()
            for at, to in slices(texts, STEP_CHARS):
                for key, coded in zip(keys[at:to], coder.batch(texts[at:to]), strict=True):
                    ids.append(key)
                    arrays.append(np.concatenate([coded, end]))
                    count += len(arrays[-1])
                    if count >= BLOCK_IDS:
                        yield emit()
                        ids, arrays, count, number = [], [], 0, number + 1
        if ids:
            yield emit()

    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    ordered = docs.select("doc_id", "text").repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(blocks, BLOCK_SCHEMA).write.option("compression", "zstd").parquet(path)


def read_token_files(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document of the files at ``path``.

    ``start`` counts the ids of all documents before, over all blocks.
    """
    let_workers_import(spark)
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    heads = blocks.select("part", "block", "n_ids")
    within = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    parts = heads.groupBy("part").agg(F.sum("n_ids").alias("n"))
    # One row for each partition of the writing job, whatever the input.
    base = parts.select(
        F.col("part").alias("p"),
        F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"),
    )
    local = heads.withColumn("ahead", F.coalesce(F.sum("n_ids").over(within), F.lit(0)))
    starts = local.join(base, local.part == base.p).select(
        F.col("part").alias("p"), F.col("block").alias("b"), (F.col("base") + F.col("ahead")).alias("first")
    )
    placed = blocks.join(starts, (F.col("part") == F.col("p")) & (F.col("block") == F.col("b")))

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, raw, data in zip(*(batch.column(c) for c in ("first", "doc_ids", "payload")), strict=True):
                keys = raw.as_py()
                bounds, ids = decode_block(data.as_py())
                begin = 0
                for at, ends in bounds.steps():
                    begins = np.concatenate(([begin], ends[:-1]))
                    crc = [zlib.crc32(ids[b:e].astype("<u4").tobytes()) for b, e in zip(begins, ends, strict=True)]
                    columns = [unpack_ids(keys, at, at + len(ends), bounds.n), begins + first.as_py(), ends - begins, np.array(crc, np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "n_tokens", "ids_crc32"])
                    begin = int(ends[-1])

    return placed.select("first", "doc_ids", "payload").mapInArrow(documents, SPAN_SCHEMA)


def token_files(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write ``docs`` to token files in the shared folder and read them back.

    See :func:`write_token_files` and :func:`read_token_files`; an empty input
    gives an empty result, other columns are ignored and repeated rows are
    documents of their own.
    """
    spark = docs.sparkSession
    path = fresh_path(spark, "tokens")
    write_token_files(docs, path, tokenizer)
    return read_token_files(spark, path)
