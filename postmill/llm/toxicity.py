"""Toxicity by a subsequence string-kernel support vector machine.

The kernel compares words by their character subsequences of length three
that span at most five places, each gap costing a factor ``DECAY``; word
ends take part as a symbol. A character inserted into an insult, or letters
set apart, therefore leave most of the kernel value. A Nyström sample of
words serves as landmarks; a linear SVM (squared hinge) is trained in the
landmarks' space.

Labels belong to texts, so training is multiple-instance: every sentence of
a clean text is clean, and a toxic text holds at least one toxic sentence,
known by its worst word. Training alternates between choosing that word in
each toxic text and fitting the machine. Chosen words are also trained on with
a letter inserted at each inner place. A text's score is the logistic of
its worst sentence's margin. Because the machine is linear in the kernel's
subsequences, landmarks and weights fold into one table of subsequence
weights, and whole texts are scored by array operations.

Bounds (parameters): ``per_label`` training texts of either label of at most
``text_chars`` characters each (longer ones are not trained on, but scored
whole), ``clean_words`` words of clean texts, ``landmarks`` words.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.llm import kernels
from postmill.llm.common import let_workers_import

DECAY = 0.6
BITS = 18
#: Offsets of the second and third symbol from the first.
PATTERNS = ((1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4))
MULTIPLIERS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)
NO_WORD = -3.0
#: What rejecting all clean texts costs, against passing all toxic ones.
CLEAN_WEIGHT = 3
THRESHOLD = 0.7
#: A word whose share of clean texts is at most this part of its share of toxic ones stands there by wrong labels.
MISLABELLED = 0.05


@dataclass(frozen=True)
class ToxicityModel:
    table: np.ndarray  # subsequence hash -> weight
    bias: float
    slope: float
    shift: float


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of the joined lower-case texts, their word borders, each text's first place.

    Letters keep their code; a border (white space, and punctuation beside it)
    is 1; any other character inside a word is left out, and so is white space
    of any length, line ends aside, between two single letters.
    """
    low = [t.lower() for t in texts]
    begins = np.cumsum([0] + [len(t) + 1 for t in low])
    codes = kernels.code_points("\n" + "\n".join(low) + "\n")
    flat = np.minimum(codes, 0xFFFF)
    letter = kernels.ALPHA[flat] | (codes > 0xFFFF)
    border = kernels.SPACE[flat].copy()
    for _ in range(3):
        border[:-1] |= border[1:] & ~letter[:-1]
        border[1:] |= border[:-1] & ~letter[1:]
    at = np.flatnonzero(border)
    opens = np.flatnonzero(np.concatenate(([True], np.diff(at) > 1)))
    closes = np.append(opens[1:], len(at)) - 1
    single = at[opens[1:]] - at[closes[:-1]] == 2
    blank = np.logical_and.reduceat(kernels.SPACE[flat[at]] & (codes[at] != 10), opens)
    lone = np.concatenate(([False], single[:-1] & single[1:], [False])) & blank if len(opens) > 2 else np.zeros(len(opens), bool)
    border[at[np.repeat(lone, closes - opens + 1)]] = False
    out = np.where(letter, flat + np.uint32(2), np.uint32(0))
    out[border] = 1
    kept = np.flatnonzero(out)
    return out[kept].astype(np.uint32), border[kept], np.searchsorted(kept, begins)


def subsequences(codes: np.ndarray, border: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float, int]]:
    """For each pattern: hashes at every first place, whether they count, weight and first offset."""
    inner = np.concatenate(([0], np.cumsum(border)))
    parts = [codes * np.uint32(m) for m in MULTIPLIERS]
    for second, third in PATTERNS:
        n = len(codes) - third
        if n <= 0:
            continue
        hashes = (parts[0][:n] ^ (parts[1][second : second + n] << np.uint32(5))) + parts[2][third:]
        hashes = (hashes * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - BITS)
        valid = inner[third : third + n] == inner[1 : n + 1]
        yield hashes, valid, DECAY ** (third - 2), second


def word_values(codes: np.ndarray, border: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places of the words and their normalised weight sums."""
    total, norm = np.zeros(len(codes), np.float32), np.zeros(len(codes), np.float32)
    for hashes, valid, weight, _ in subsequences(codes, border):
        keep = valid.astype(np.float32)
        total[: len(hashes)] += table[hashes] * (keep * np.float32(weight))
        norm[: len(hashes)] += keep * np.float32(weight * weight)
    starts = np.flatnonzero(border)
    if not len(starts):
        return starts, np.zeros(0, np.float32)
    sums, norms = np.add.reduceat(total, starts), np.add.reduceat(norm, starts)
    real = np.diff(np.append(starts, len(codes))) > 1
    return starts[real], (sums / np.sqrt(np.maximum(norms, 1e-9)))[real]


def text_margins(texts: list[str], table: np.ndarray, bias: float) -> np.ndarray:
    """The margin of each text's worst word; ``NO_WORD`` where there is none."""
    out = np.full(len(texts), NO_WORD)
    for begin, end in kernels.slices(texts):
        codes, border, begins = symbols(texts[begin:end])
        places, values = word_values(codes, border, table)
        if len(places):
            owner = np.searchsorted(begins, places, side="right") - 1
            owner = np.minimum(owner, end - begin - 1)
            np.maximum.at(out, begin + owner, np.maximum(values + bias, NO_WORD))
    return out


def word_list(text: str) -> list[str]:
    codes, border, _ = symbols([text])
    letters = (codes - np.uint32(2)).astype("<u4").tobytes()
    at = np.flatnonzero(border)
    spans = ((a + 1, b) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True) if b - a > 1)
    return sorted({letters[4 * a : 4 * b].decode("utf-32-le", "surrogatepass") for a, b in spans})


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word, subsequence hash and normalised weight of all subsequences of the words."""
    rows, cols, vals = [], [], []
    codes, border, begins = symbols(words)
    for hashes, valid, weight, second in subsequences(codes, border):
        at = np.flatnonzero(valid)
        rows.append(np.minimum(np.searchsorted(begins, at + (second > 1), side="right") - 1, len(words) - 1))
        cols.append(hashes[at])
        vals.append(np.full(len(at), weight))
    r, c, v = (np.concatenate(x) if x else np.zeros(0, int) for x in (rows, cols, vals))
    norm = np.sqrt(np.maximum(np.bincount(r, v * v, minlength=len(words)), 1e-9))
    return r, c.astype(np.int64), v / norm[r]


def gram(words: list[str], marks: list[str]) -> np.ndarray:
    """Kernel values of words against landmarks."""
    r, c, v = features(marks)
    known = np.unique(c)
    row_of = np.zeros(1 << BITS, np.int32)
    row_of[known] = np.arange(1, len(known) + 1)
    dense = np.zeros((len(known) + 1, len(marks)), np.float32)  # row 0: subsequences of no landmark
    np.add.at(dense, (row_of[c], r), v.astype(np.float32))
    out = np.zeros((len(words), len(marks)))
    for begin in range(0, len(words), 500):
        part = words[begin : begin + 500]
        r, c, v = features(part)
        order = np.argsort(r, kind="stable")
        r, c, v = r[order], c[order], v[order]
        if len(r):
            first = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1])))
            out[begin + r[first]] = np.add.reduceat(dense[row_of[c]] * v[:, None].astype(np.float32), first, axis=0)
    return out


def svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Weights and bias of the squared-hinge SVM, by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, keep = np.zeros(x.shape[1]), np.ones(x.shape[1])
    keep[-1] = 1e-3
    for _ in range(30):
        slack = 1 - y * (x @ w)
        on = slack > 0
        xo, yo, co = x[on], y[on], cost[on]
        grad = keep * w - 2 * xo.T @ (co * yo * slack[on])
        if np.abs(grad).max() < 1e-6:
            break
        hess = np.diag(keep) + 2 * xo.T @ (xo * co[:, None])
        w = w - np.linalg.solve(hess, grad)
    return w


def logistic(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic that maps margins to probabilities."""
    pos, neg = max(1, labels.sum()), max(1, len(labels) - labels.sum())
    goal = np.where(labels == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    cost = np.where(labels == 1, 1 / pos, CLEAN_WEIGHT / neg) * len(labels) / (1 + CLEAN_WEIGHT)
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-(a * margins + b)))
        g, h = cost * (p - goal), np.maximum(cost * p * (1 - p), 1e-9)
        grad = np.array([(g * margins).sum() + 1e-3 * a, g.sum()])
        hess = np.array([[(h * margins**2).sum() + 1e-3, (h * margins).sum()], [(h * margins).sum(), h.sum() + 1e-9]])
        step = np.linalg.solve(hess, grad)
        step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        a, b = max(a - step[0], 1e-2), b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def fit(texts: list[str], labels: list[int], landmarks: int, clean_words: int) -> ToxicityModel | None:
    """Fit on a bounded list of labelled texts, in their given order; None without both labels."""
    seen = dict(zip(texts, labels, strict=True))  # equal texts count once
    texts, y = list(seen), np.array(list(seen.values()))
    if not (y == 1).any() or not (y == 0).any():
        return None
    lists = [word_list(t) for t in texts]
    bad, good = {}, {}
    for words, label in zip(lists, y, strict=True):
        counts = bad if label else good
        for w in words:
            counts[w] = counts.get(w, 0) + 1
    share = {w: (n / (y == 0).sum()) / max(bad.get(w, 0) / (y == 1).sum(), 1e-12) for w, n in good.items()}
    good = {w: n for w, n in good.items() if share[w] > MISLABELLED}
    odds = {w: n / (y == 1).sum() - 3 * good.get(w, 0) / (y == 0).sum() for w, n in bad.items()}
    toxic_lists = [[w for w in words if w not in good] for words, label in zip(lists, y, strict=True) if label]
    toxic_lists = [words for words in toxic_lists if words]
    if not toxic_lists:
        return None
    picks = {max(words, key=lambda w: (odds[w], w)) for words in toxic_lists}
    # Words that only toxic texts hold, in more of them than chance would let any word be.
    usual = np.bincount([bad.get(w, 0) + good.get(w, 0) for w in bad.keys() | good.keys()])
    as_often = usual[::-1].cumsum()[::-1]
    sure = {w for w, n in bad.items() if w not in good and as_often[n] * y.mean() ** n < 0.5}
    picks = sorted(picks | sure)
    clean = sorted(good, key=lambda w: (rank(w), w))[:clean_words]
    hardest = sorted(good)
    model = None
    for _ in range(5):
        support = sorted(picks, key=lambda w: (-bad.get(w, 0), w))
        marks = support[: landmarks // 2]
        marks += clean[: landmarks - len(marks)]
        among = gram(marks, marks)
        value, vector = np.linalg.eigh(among)
        root = vector[:, value > 1e-6] / np.sqrt(value[value > 1e-6])
        variants = [(x, w) for w in support for x in stretched(w) if x not in good]
        own = np.sqrt([bad.get(w, 1) for w in support])
        own = np.concatenate([own, [np.sqrt(bad.get(w, 1)) / (len(w) - 1) for _, w in variants]])
        words = [*support, *[x for x, _ in variants], *clean]
        target = np.array([1.0] * len(own) + [-1.0] * len(clean))
        other = np.sqrt([good[w] for w in clean])
        cost = 0.5 * len(words) * np.concatenate([own / own.sum(), other / other.sum()])
        w = svm(gram(words, marks) @ root, target, cost)
        r, c, v = features(marks)
        table = np.bincount(c, v * (root @ w[:-1])[r], minlength=1 << BITS).astype(np.float32)
        model = table, float(w[-1])
        near = text_margins(hardest, *model)
        worst = np.lexsort((np.arange(len(near)), -near))[: clean_words // 6]
        clean = list(dict.fromkeys([*clean, *[hardest[i] for i in worst if near[i] > -1]]))
        pool = sorted({x for words in toxic_lists for x in words})
        margin = dict(zip(pool, text_margins(pool, *model), strict=True))
        chosen = {max(words, key=lambda x: (margin[x] + min(1.0, 20 * odds[x]), x)) for words in toxic_lists}
        chosen |= sure | {x for x in pool if margin[x] > 0.5 and bad[x] > 1}
        picks = sorted(chosen)
    tried = [x for x, w in variants if w in sure]
    margins = np.concatenate([text_margins(texts, *model), text_margins(tried, *model)])
    slope, shift = logistic(margins, np.concatenate([y, np.ones(len(tried), y.dtype)]))
    return ToxicityModel(model[0], model[1], slope, shift)


def stretched(word: str) -> list[str]:
    """The word with a letter inserted at each of its inner places."""
    if len(word) < 4:
        return []
    return [word[:k] + chr(97 + rank(f"{word} {k}") % 26) + word[k:] for k in range(1, len(word))]


def rank(text: str) -> int:
    return int(kernels.mix(np.array([hash_text(text)], np.uint64))[0])


def hash_text(text: str) -> int:
    out = 0xCBF29CE484222325
    for b in text.encode("utf-8", "surrogatepass"):
        out = (out ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return out


def scores(texts: list[str], model: ToxicityModel | None) -> np.ndarray:
    if model is None:
        return np.zeros(len(texts))
    return 1 / (1 + np.exp(-(model.slope * text_margins(texts, model.table, model.bias) + model.shift)))


def train(docs: DataFrame, labels: DataFrame, rows: Column, per_label: int, text_chars: int, landmarks: int, clean_words: int) -> ToxicityModel | None:
    """Fit on a bounded sample of the labelled rows for which ``rows`` holds, in one task."""
    usable = docs.select("doc_id", "text").where(rows & (F.length("text") <= text_chars))
    known = labels.where(F.col("toxic").isin(0, 1) & rows).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = []
    for label in (0, 1):
        mine = known.where(F.col("toxic") == label).join(usable.select("doc_id").distinct(), "doc_id")
        ids += [r["doc_id"] for r in mine.orderBy(F.xxhash64("doc_id", F.lit(2)), "doc_id").limit(per_label).collect()]
    picked = usable.where(F.col("doc_id").isin(ids)).join(F.broadcast(known.where(F.col("doc_id").isin(ids))), "doc_id")

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = sorted((row for batch in batches for row in batch.itertuples(index=False, name=None)), key=lambda x: (x[0], x[1]))
        model = fit([t for _, t, _ in rows], [int(y) for _, _, y in rows], landmarks, clean_words) if rows else None
        yield pd.DataFrame({"model": [pickle.dumps(model)]})

    # Only the bounded sample is moved to the one task that learns; the scan before it stays in parallel. The driver gets the table of weights.
    found = picked.select("doc_id", "text", "toxic").repartition(1).mapInPandas(learn, "model binary").first()
    return pickle.loads(found["model"]) if found else None


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    rows: Column,
    per_label: int = 1500,
    text_chars: int = 6000,
    landmarks: int = 256,
    clean_words: int = 8000,
    keep: bool = False,
) -> DataFrame:
    """Score every row of ``docs`` (doc_id, text, ...) from 0 to 1.

    Learns from ``labels`` (doc_id, toxic 0/1) on the rows for which the
    condition ``rows`` on doc_id holds. Returns doc_id, score and predicted
    (1 at ``THRESHOLD`` and above), or, with ``keep``, all columns of docs and
    these two as __score and __predicted. Null and empty texts and texts
    without a word score as a text with no toxic word at all; if no model can
    be fitted, all score 0. Equal texts score equally; repeated rows stay.
    """
    spark = docs.sparkSession
    let_workers_import(spark)
    model = train(docs, labels, rows, per_label, text_chars, landmarks, clean_words)

    def value(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(scores([t if isinstance(t, str) else "" for t in batch], model))

    score = F.pandas_udf(value, "double")
    if keep:
        out = docs.withColumn("__score", score("text"))
        return out.withColumn("__predicted", (F.col("__score") >= THRESHOLD).cast("int"))
    out = docs.select("doc_id", score("text").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
