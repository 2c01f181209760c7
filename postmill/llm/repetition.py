"""Quality rules on repetition inside a text, by suffix arrays.

A text is its runs of characters other than ASCII white space. The suffix array
of those words is made by prefix doubling: suffixes that still share a rank are
ranked again by twice as many words, and the ranks of every doubling are kept,
so that the longest common prefix of neighbouring suffixes is read from them.
A suffix's innermost LCP interval is as long as the longer of the prefixes that
it shares with its two neighbours; that is the longest repeat which starts
there, and a maximal repeated substring unless the word before extends it too.
The union of those spans is what maximal repeats of at least so many words
cover. Repeats may overlap: eight times one word are a repeat of seven.

The base rule (``n_words`` under ``LEAST_WORDS``, or more than ``BASE_SHARE``
percent of the words in repeats of ``BASE_RUN`` words) and the verdict (more
than ``COVERED_SHARE`` percent in repeats of ``RUN`` words, or a repeat of more
than ``LONGEST`` words) use the same array. Short repeats catch texts that say
each word or phrase some times and move on, which windows of eight words miss.

A null text counts as empty: no words, so the base rule fails it. Repeated rows
and equal or null ids are rows of their own. Texts are read as bytes of UTF-8
and never cut; a text over the size of a step forms a step of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type
from pyspark.sql.types import StructType

from postmill.llm.common import let_workers_import

#: Least number of words, and the limits of the base rule in words and percent.
LEAST_WORDS, BASE_RUN, BASE_SHARE = 20, 8, 30
#: Words of a repeat that counts for the verdict, the percentage that such repeats may cover, and the longest repeat allowed.
RUN, COVERED_SHARE, LONGEST = 5, 30, 50
#: Bytes of text whose suffixes are sorted in one step.
STEP_BYTES = 1 << 20
SYMBOLS = b"#*$%&|<>"
SPACES = bytes(range(9, 14)) + b" "
CONTINUATION = bytes(range(0x80, 0xC0))

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat"]
VERDICTS = ["base_failed", "kept"]
ARROW = pa.struct([(n, pa.int64()) for n in COUNTS] + [("repeats", pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())])))] + [(n, pa.bool_()) for n in VERDICTS])
MEASURES = from_arrow_type(ARROW)


def word_codes(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all texts' words with an end mark after each text, and where each text begins.

    Codes are equal for equal words of one text and differ between texts, so
    no repeat goes from one text to another; every end mark is unique.
    """
    codes, begins, fresh = [], [], 0
    total = 0
    for words in texts:
        known: dict[bytes, int] = {}
        own = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
        begins.append(total)
        codes += [own + fresh, np.array([fresh + len(known)])]
        fresh += len(known) + 1
        total += len(words) + 1
    return np.concatenate(codes) if codes else np.zeros(0, np.int64), np.array(begins + [total])


def suffix_ranks(codes: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The suffix array and, for each doubling, every suffix's rank by its first 1, 2, 4, ... codes.

    A rank is the place of the first suffix of its group, so a group can be
    split further without touching the others.
    """
    order = np.argsort(codes, kind="stable")
    opens = np.concatenate(([True], codes[order][1:] != codes[order][:-1]))
    rank = np.empty(len(codes), np.int64)
    rank[order] = np.maximum.accumulate(np.where(opens, np.arange(len(codes)), 0))
    levels, reach = [rank], 1
    while True:
        alone = opens & np.append(opens[1:], True)
        places = np.flatnonzero(~alone)
        if not len(places):
            return order, levels
        open_suffixes = order[places]
        key = rank[open_suffixes] * len(codes) + rank[np.minimum(open_suffixes + reach, len(codes) - 1)]
        by = np.argsort(key, kind="stable")
        order[places] = open_suffixes[by]
        key = key[by]
        opens[places] = np.concatenate(([True], key[1:] != key[:-1]))
        rank = rank.copy()
        rank[order[places]] = np.maximum.accumulate(np.where(opens[places], places, 0))
        levels.append(rank)
        reach *= 2


def common_prefixes(order: np.ndarray, levels: list[np.ndarray], least: int) -> np.ndarray:
    """Words that each suffix of the array shares with the next one; those under ``least`` may be given as less."""
    shared = np.zeros(max(0, len(order) - 1), np.int64)
    level = min(len(levels) - 1, least.bit_length() - 1)
    at = np.flatnonzero(levels[level][order[:-1]] == levels[level][order[1:]])
    left, right = order[:-1][at], order[1:][at]
    found = np.zeros(len(at), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        same = levels[k][left + found] == levels[k][right + found]
        found[same] += 1 << k
    shared[at] = found
    return shared


def longest_repeats(codes: np.ndarray, least: int) -> np.ndarray:
    """The longest repeat that starts at each code, 0 where it is shorter than ``least``."""
    longest = np.zeros(len(codes), np.int64)
    if len(codes) > 1:
        order, levels = suffix_ranks(codes)
        shared = common_prefixes(order, levels, least)
        longest[order] = np.maximum(np.append(shared, 0), np.append(0, shared))
    longest[longest < least] = 0
    return longest


def covered(longest: np.ndarray, least: int) -> np.ndarray:
    """Which codes lie in a repeat of at least so many."""
    at = np.flatnonzero(longest >= least)
    edge = np.bincount(at, minlength=len(longest) + 1) - np.bincount(at + longest[at], minlength=len(longest) + 1)
    return np.cumsum(edge[:-1]) > 0


def spans(inside: np.ndarray) -> list[dict]:
    change = np.flatnonzero(np.diff(np.concatenate(([0], inside.astype(np.int8), [0]))))
    return [{"begin": int(b), "end": int(e)} for b, e in zip(change[::2], change[1::2], strict=True)]


def measure(texts: list[bytes]) -> list[dict]:
    """The measures of texts of one step."""
    split = [t.split() for t in texts]
    codes, begins = word_codes(split)
    longest = longest_repeats(codes, RUN)
    short, base = covered(longest, RUN), covered(longest, BASE_RUN)
    out = []
    for text, words, b, e in zip(texts, split, begins[:-1], begins[1:] - 1, strict=True):
        n, n_base, n_short, most = len(words), int(base[b:e].sum()), int(short[b:e].sum()), int(longest[b:e].max(initial=0))
        lines = [line for line in text.split(b"\n") if line.strip(SPACES)]
        failed = n < LEAST_WORDS or 100 * n_base > BASE_SHARE * n
        out.append(
            {
                "n_words": n,
                "word_chars": len(text.translate(None, SPACES + CONTINUATION)),
                "n_symbols": len(text) - len(text.translate(None, SYMBOLS)),
                "n_dup_lines": len(lines) - len(set(lines)),
                "n_repeat_words": n_base,
                "covered_words": n_short,
                "longest_repeat": most,
                "repeats": spans(short[b:e]),
                "base_failed": failed,
                "kept": not failed and 100 * n_short <= COVERED_SHARE * n and most <= LONGEST,
            }
        )
    return out


def steps(texts: list[bytes]) -> Iterator[list[bytes]]:
    """Runs of texts of about ``STEP_BYTES``."""
    own: list[bytes] = []
    size = 0
    for text in texts:
        if own and size + len(text) > STEP_BYTES:
            yield own
            own, size = [], 0
        own.append(text)
        size += len(text)
    if own:
        yield own


def measured(carry: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function of batches that puts the measures of the last column after the first ``carry`` columns."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column(carry).to_pylist()]
            found = [m for part in steps(texts) for m in measure(part)]
            columns = [batch.column(i) for i in range(carry)] + [pa.array(found, ARROW)]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:carry], "measures"])

    return run


def free_name(columns: list[str], name: str) -> str:
    """``name``, with underscores before it while a column is called so."""
    while name.lower() in {c.lower() for c in columns}:
        name = f"_{name}"
    return name


def repetition(docs: DataFrame, keep: list[str], text: str = "text", name: str = "repetition") -> DataFrame:
    """The columns ``keep`` of every row and a struct of its text's measures and verdict.

    The struct is called ``name`` (with underscores before it if a kept column
    has that name); ``repeats`` has the merged spans, in words, of all maximal
    repeats of at least ``RUN`` words. No rows in, no rows out.
    """
    let_workers_import(docs.sparkSession)
    name = free_name(keep, name)
    schema = StructType([docs.schema[c] for c in keep]).add(name, MEASURES)
    rows = docs.select(*keep, F.col(text).cast("binary").alias(free_name(keep, "bytes")))
    return rows.mapInArrow(measured(len(keep)), schema)


def kept_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows whose text passes the rules, with their columns."""
    found = repetition(docs, docs.columns, text, "repetition")
    return found.where(F.col(f"{found.columns[-1]}.kept")).select(*docs.columns)


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row per document: its id, the base features, the base rule and the verdict."""
    return repetition(docs, ["doc_id"]).select("doc_id", *[f"repetition.{n}" for n in COUNTS[:5] + VERDICTS])
