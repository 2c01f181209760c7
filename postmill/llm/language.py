"""Language identification with blended-spectrum string kernels.

Two texts are compared by the n-grams (n = 1 to 3, lower case, white space
as one symbol) that both contain at least once. The presence kernel is
normalised by the texts' own numbers of different n-grams; a Nyström sample of
labelled texts serves as landmarks, and one ridge regression for each language
is fitted in the landmarks' kernel space. Scoring is one product of a batch's
sparse presence matrix with the landmarks' and one with the regressions'
weights. All n-grams of a landmark take part; an n-gram is known by a hash of
``HASH_BITS`` bits.

Bounds (parameters): ``per_language`` training texts for each language, fewer
where languages are so many that ``rows`` texts do not suffice, and two at
least; ``landmarks`` of the texts as landmarks, one at least of each language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill.llm import kernels
from postmill.llm.common import let_workers_import

UNKNOWN = "und"
HASH_BITS = 18
ORDERS = (1, 2, 3)
MULTIPLIERS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)
BATCH = 256


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    column_of: np.ndarray  # n-gram hash -> row of landmarks, 0 for n-grams of no landmark
    landmarks: np.ndarray  # n-grams x landmarks, normalised presence
    weights: np.ndarray  # landmarks x languages


def gram_hashes(codes: np.ndarray) -> Iterator[np.ndarray]:
    """Hashes of the n-grams of every order, at every position."""
    symbols = np.where(kernels.is_space(codes), np.uint32(32), codes).astype(np.uint32)
    for order in ORDERS:
        if len(symbols) < order:
            continue
        total = np.full(len(symbols) - order + 1, np.uint32(order * 0x27D4EB2F & 0xFFFFFFFF))
        for k in range(order):
            total = (total ^ symbols[k : len(symbols) - order + 1 + k]) * np.uint32(MULTIPLIERS[k])
            total ^= total >> np.uint32(15)
        yield total >> np.uint32(32 - HASH_BITS)


def presence(texts: list[str]) -> list[np.ndarray]:
    """The hashes of the different n-grams of each text."""
    out, seen = [], np.zeros(1 << HASH_BITS, bool)
    for text in texts:
        codes = kernels.code_points(text.lower())
        for begin in range(0, len(codes), kernels.STEP_CHARS):  # whole texts, in bounded steps
            for hashes in gram_hashes(codes[begin : begin + kernels.STEP_CHARS + len(ORDERS) - 1]):
                seen[hashes] = True
        out.append(np.flatnonzero(seen))
        seen[out[-1]] = False
    return out


def kernel(texts: list[str], column_of: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    """Kernel values of texts against landmarks: for each text the sum of its n-grams' rows, by its norm."""
    out = np.zeros((len(texts), landmarks.shape[1]), np.float32)
    ones = np.ones(len(column_of), np.float32)
    for row, own in enumerate(presence(texts)):
        known = column_of[own]
        known = known[known > 0]
        out[row] = ones[: len(known)] @ landmarks[known] / np.sqrt(np.float32(max(1, len(own))))
    return out


def fit(texts: list[str], langs: list[str], landmarks: int, ridge: float) -> LanguageModel:
    """Fit on a bounded list of texts, in their given order."""
    names = sorted(set(langs))
    by_lang = {name: [i for i, x in enumerate(langs) if x == name] for name in names}
    share = max(1, landmarks // max(1, len(names)))
    chosen = [i for name in names for i in by_lang[name][:share]]
    sets = presence([texts[i] for i in chosen])
    kept = np.unique(np.concatenate(sets))
    column_of = np.zeros(1 << HASH_BITS, np.int32)
    column_of[kept] = np.arange(1, len(kept) + 1)
    marks = np.zeros((len(kept) + 1, len(chosen)), np.float32)
    for k, own in enumerate(sets):
        marks[column_of[own], k] = 1 / np.sqrt(max(1, len(own)))
    among = marks.T @ marks
    to_marks = np.vstack([kernel(texts[i : i + BATCH], column_of, marks) for i in range(0, len(texts), BATCH)]).astype(np.float64)
    target = np.where(np.array(langs)[:, None] == np.array(names)[None, :], 1.0, -1.0)
    balance = np.array([1.0 / len(by_lang[x]) for x in langs])[:, None]
    balance *= len(langs) / balance.sum()
    left = to_marks.T @ (to_marks * balance) + ridge * among + 1e-6 * np.eye(len(chosen))
    weights = np.linalg.solve(left, to_marks.T @ (target * balance))
    return LanguageModel(names, column_of, marks, weights.astype(np.float32))


def predict(texts: list[str], model: LanguageModel) -> tuple[list[str], np.ndarray]:
    """Language and score of every text; texts without a letter are ``und`` at 0."""
    names, scores = [], np.zeros(len(texts))
    for begin, end in ((i, min(i + BATCH, len(texts))) for i in range(0, len(texts), BATCH)):
        part = texts[begin:end]
        margins = kernel(part, model.column_of, model.landmarks) @ model.weights
        best = margins.argmax(axis=1)
        known = np.array([kernels.has_letter(kernels.code_points(t)) for t in part])
        names += [model.languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
        value = np.clip((margins[np.arange(len(part)), best] + 1) / 2, 0, 1)
        scores[begin:end] = np.where(known, value, 0.0)
    return names, scores


def training_sample(docs: DataFrame, train: Column, per_language: int, rows: int) -> tuple[list[str], list[str]]:
    """Texts and languages of at most ``per_language`` rows of each language, about ``rows`` in all, by hash order."""
    ranked = Window.partitionBy("lang").orderBy("__at", "doc_id")
    usable = docs.where(train & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("text").rlike(r"\p{L}"))
    known = usable.select("lang").distinct().count()
    most = max(2, min(per_language, rows // max(1, known)))
    ids = (
        usable.select("lang", "doc_id", F.xxhash64(F.col("doc_id"), F.lit(1)).alias("__at"))
        .withColumn("__rank", F.row_number().over(ranked))
        .where(F.col("__rank") <= most)
        .select("doc_id")
        .collect()
    )
    picked = usable.where(F.col("doc_id").isin([r["doc_id"] for r in ids])).select("doc_id", "text", "lang")
    found = picked.dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").collect()
    return [r["text"] for r in found], [r["lang"] for r in found]


def identify_languages(
    docs: DataFrame,
    train: Column,
    per_language: int = 150,
    landmarks: int = 128,
    ridge: float = 1e-2,
    rows: int = 12_000,
) -> DataFrame:
    """Predict the language of every row of ``docs`` (doc_id, text, lang, ...).

    Learns from the rows where ``train`` holds and lang is given. Returns
    doc_id, lang_pred, score and n_chars. Only the text is read for a
    prediction. A null text, an empty one or one without a letter is ``und``
    at score 0, and so is every text if no row can be learned from; equal
    texts get equal results, repeated rows stay, other columns are ignored.
    """
    let_workers_import(docs.sparkSession)
    texts, langs = training_sample(docs, train, per_language, rows)
    model = fit(texts, langs, landmarks, ridge) if texts else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            whole = [t if isinstance(t, str) else "" for t in batch["text"]]
            names, scores = predict(whole, model) if model else ([UNKNOWN] * len(whole), np.zeros(len(whole)))
            sizes = [len(t) for t in whole]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "lang_pred": names, "score": scores, "n_chars": sizes})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, lang_pred string, score double, n_chars long")
