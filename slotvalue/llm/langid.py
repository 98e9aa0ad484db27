"""Language identification with error-correcting output codes.

Every language gets a codeword of +1/-1 bits.  One binary classifier per bit
reads hashed byte n-grams (orders 1 to 4, A-Z lower-cased) averaged over the
whole text, and predicts that bit's margin.  Decoding adds, per language, the
logistic loss of the margins against its codeword and takes the language of
the smallest loss.  ``score`` is that language's share of the softmax of the
negated losses; a document whose share is below ``AMBIGUOUS`` is flagged.

Training: logistic loss, AdaGrad steps in numpy on the driver, over a sample
of labelled rows of at most ``SAMPLE`` rows in expectation, spread evenly over
the languages and picked by a hash of label and text, so the layout of the files
plays no part; equal texts of one label are learned from once.  N-grams are counted in tasks; only their hashed counts reach
the driver (at most 2**BITS per sampled row).  The codebook holds one codeword
per language, so the set of languages must fit on the driver.

Defined cases: null text or no letter gives ``und`` with score 0, not
ambiguous; so does every text when no labelled row exists; one language gets
score 1.  Ties go to the language that sorts first.  Repeated rows get equal
results.  Extra columns are kept by ``identify``; a clashing name of theirs
stays and the new column gets an underscore in front.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotvalue.llm.common import LOWER, Shared, gram_counts, gram_means, map_columns, sampled, text_buffer

ORDERS = (1, 2, 3, 4)
BITS = 15
SAMPLE = 2400
EPOCHS = 6
AMBIGUOUS = 0.5
NONE = "und"
_SCALE = 16.0
_LETTER = re.compile(rb"[A-Za-z]")
_LOW = np.frombuffer(LOWER, np.uint8)


@dataclass
class Model:
    languages: list[str]
    codes: np.ndarray     # language x bit, +1 / -1
    weights: np.ndarray   # bucket x bit
    bias: np.ndarray      # bit


def codebook(n: int, seed: int = 7) -> np.ndarray:
    """n codewords: all distinct splits of the languages for up to five of
    them, else the best by smallest distance of seeded random books with about
    10 log2(n) bits."""
    if n <= 5:
        splits = range(1, 1 << max(n - 1, 0)) if n > 1 else range(1)
        return np.array([[1.0 if s >> i & 1 else -1.0 for s in splits] for i in range(n)]).reshape(n, len(splits))
    rng, best, most = np.random.default_rng(seed), None, -1
    for _ in range(50):
        book = rng.choice([-1.0, 1.0], (n, math.ceil(10 * math.log2(n))))
        same = book @ book.T - 2 * book.shape[1] * np.eye(n)
        if (gap := book.shape[1] - same.max()) > most:
            best, most = book, gap
    return best


def _gram_counts(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    total = gram_counts(_LOW[text], ORDERS, BITS)
    idx = np.flatnonzero(total)
    return idx.astype(np.uint16), total[idx].astype(np.float32)


def fit(docs: DataFrame, train: Column, text_col: str = "text", lang_col: str = "lang",
        sample: int = SAMPLE, seed: int = 11) -> Model | None:
    """Learn from rows of ``docs`` where ``train`` holds, the label is not null
    and the text is not empty."""
    rows = docs.where(train).select(F.col(lang_col).cast("string").alias("lang"),
                                    F.col(text_col).cast("string").alias("text")) \
        .where("lang is not null and length(text) > 0")
    found = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not found:
        return None
    each = sample / len(found)
    picked = sampled(rows.withColumn("key", F.xxhash64("lang", "text")), "key", "lang",
                     {k: min(1.0, each / n) for k, n in found.items()})

    def counted(texts: pa.Array) -> list[pa.Array]:
        raw, offs = text_buffer(texts)
        grams = [_gram_counts(raw[a:b]) for a, b in zip(offs[:-1], offs[1:])]
        return [pa.array([i.tobytes() for i, _ in grams], pa.binary()),
                pa.array([v.tobytes() for _, v in grams], pa.binary())]

    got = map_columns(picked, [F.col("text")], counted,
                      [("idx", "binary"), ("cnt", "binary")]).select("key", "lang", "idx", "cnt").collect()
    got.sort(key=lambda r: (r["key"], r["lang"]))
    languages = sorted(found)
    return _learn([(languages.index(r["lang"]), np.frombuffer(r["idx"], np.uint16).astype(np.int64),
                    np.frombuffer(r["cnt"], np.float32)) for r in got], languages, seed)


def _learn(rows: list[tuple[int, np.ndarray, np.ndarray]], languages: list[str], seed: int) -> Model:
    codes = codebook(len(languages))
    n_bits = codes.shape[1]
    weights = np.zeros((1 << BITS, n_bits), np.float32)
    squares = np.full((1 << BITS, n_bits), 1e-8, np.float32)
    bias, bias_squares = np.zeros(n_bits), np.full(n_bits, 1e-8)
    rng = np.random.default_rng(seed)
    for epoch in range(EPOCHS):
        rate = 0.5 * (1 - epoch / EPOCHS)
        for i in rng.permutation(len(rows)):
            y, idx, cnt = rows[i]
            share = (cnt * (_SCALE / cnt.sum()))[:, None]
            want = codes[y]
            margin = (share * weights[idx]).sum(0) + bias
            slope = -want / (1 + np.exp(np.clip(want * margin, -30, 30)))
            grad = share * slope.astype(np.float32)
            squares[idx] += grad * grad
            weights[idx] -= rate * grad / np.sqrt(squares[idx])
            bias_squares += slope * slope
            bias -= 0.1 * rate * slope / np.sqrt(bias_squares)
    return Model(languages, codes, weights * np.float32(_SCALE), bias)


def decode(model: Model, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest language, its share) for rows of bit margins."""
    losses = np.logaddexp(0.0, -margins[:, None, :] * model.codes[None]).sum(2)
    best = losses.argmin(1)
    share = np.exp(losses.min(1, keepdims=True) - losses)
    return best, 1 / share.sum(1)


def _has_letter(text: bytes) -> bool:
    return bool(_LETTER.search(text)) or (not text.isascii() and any(map(str.isalpha, text.decode("utf-8", "replace"))))


def lettered(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with has_letter, which needs no model."""
    def run(texts: pa.Array) -> list[pa.Array]:
        raw, offs = text_buffer(texts)
        return [pa.array([_has_letter(raw[a:b].tobytes()) for a, b in zip(offs[:-1], offs[1:])], pa.bool_())]

    return map_columns(docs, [F.col(text_col).cast("string")], run, [("has_letter", "boolean")])


def identify(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score and ambiguous."""
    shared = Shared(docs.sparkSession, model)  # 2**BITS weights per code bit

    def run(texts: pa.Array) -> list[pa.Array]:
        m = shared.value
        raw, offs = text_buffer(texts)
        n = len(offs) - 1
        lettered = np.array([_has_letter(raw[a:b].tobytes()) for a, b in zip(offs[:-1], offs[1:])], bool)
        if m is None or not n:
            return [pa.array([NONE] * n, pa.string()), pa.array(np.zeros(n)), pa.array(np.zeros(n, bool))]
        best, share = decode(m, gram_means(_LOW[raw], offs, m.weights, ORDERS, BITS) + m.bias)
        names = np.array(m.languages, object)[best]
        return [pa.array(np.where(lettered, names, NONE), pa.string()), pa.array(np.where(lettered, share, 0.0)),
                pa.array(lettered & (share < AMBIGUOUS))]

    return map_columns(docs, [F.col(text_col).cast("string")], run,
                       [("lang_pred", "string"), ("score", "double"), ("ambiguous", "boolean")])
