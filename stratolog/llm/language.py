"""Language identification with error-correcting output codes.

Every language gets a codeword; each bit has one binary classifier over hashed byte n-grams (log-odds of the n-gram under the languages whose bit is 1
against those whose bit is 0).  A text's margins are compared with all codewords by logistic loss, weighted by how well each bit separates the
training counts; the codeword of least loss wins, and a small lead over the second flags the text as ambiguous.

The counts cover every training row (whole texts) and are gathered as one row per language and slot, so what reaches the driver is bounded by
languages x ``SLOTS``.  Null texts and texts without a letter are ``und`` with score 0; a text of one letter has no n-gram, gets the first
language and is flagged.  Without training rows everything is ``und``.  Each input row gives one output row; ties go to the first language in
code-point order; rows with a null id count as held out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, utf8, whole_row

SLOTS = 8192
#: Lead in loss per bit below which a prediction is ambiguous.
AMBIGUOUS = 0.02

_LETTER = np.full(256, 32, np.uint8)
for _b in [*range(97, 123), *range(128, 256)]:
    _LETTER[_b] = _b
_LETTER[65:91] = np.arange(97, 123)


def held_out():
    """True where crc32 of the id, written as text, is divisible by 5."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def ngram_slots(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, slot) of each bigram and trigram of lower-cased letters; n-grams with two blanks in a row or crossing rows are left out."""
    if len(data) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    b = _LETTER[data].astype(np.uint32)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    blank = b == 32
    two = (row[:-1] == row[1:]) & ~(blank[:-1] & blank[1:])
    pair = b[:-1] << 8 | b[1:]
    at = np.flatnonzero(two)
    slot2 = (pair[at] * np.uint32(0x9E3779B1)) >> np.uint32(19)
    at3 = np.flatnonzero(two[:-1] & two[1:])
    slot3 = ((pair[at3] << 8 | b[at3 + 2]) * np.uint32(0x85EBCA6B)) >> np.uint32(19)
    return np.concatenate([row[at], row[at3]]), np.concatenate([slot2, slot3]).astype(np.int64)


def histograms(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    row, slot = ngram_slots(data, offsets)
    n = len(offsets) - 1
    return np.bincount(row * SLOTS + slot, minlength=n * SLOTS).reshape(n, SLOTS)


def codewords(k: int) -> np.ndarray:
    """k rows of +1/-1: the exhaustive code up to five classes, else the best of fifty random codes by least distance."""
    if k <= 1:
        return np.ones((k, 1))
    if k <= 5:
        bits = [[1 if c == 0 else (1 if (col >> (c - 1)) & 1 else -1) for c in range(k)] for col in range(2 ** (k - 1) - 1)]
        return np.array(bits, float).T
    rng, best, least = np.random.default_rng(7), None, -1
    for _ in range(50):
        code = rng.choice([-1.0, 1.0], (k, int(np.ceil(10 * np.log2(k)))))
        code = code[:, np.abs(code.sum(0)) < k]
        apart = min(int((code[i] != code[j]).sum()) for i in range(k) for j in range(i)) if code.size else -1
        if apart > least:
            best, least = code, apart
    return best


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    codes: np.ndarray
    weights: np.ndarray  # SLOTS x bits
    scale: np.ndarray  # bits

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best class, its share of the evidence, and the lead in loss per bit, for rows of margins."""
        m = margins / self.scale
        loss = np.stack([np.logaddexp(0, -4 * m * c) @ self.scale for c in self.codes], 1) / self.scale.sum()
        order = np.argsort(loss, 1, kind="stable")
        best = order[:, 0]
        lead = np.take_along_axis(loss, order[:, 1:2], 1)[:, 0] - loss[np.arange(len(best)), best] if loss.shape[1] > 1 else np.full(len(best), 9.0)
        share = np.exp(-8 * (loss - loss.min(1, keepdims=True)))
        return best, 1 / share.sum(1), lead


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        langs = np.array(batch.column("lang").to_pylist(), object)
        for lo, hi in blocks(offsets):
            names, code = np.unique(langs[lo:hi].astype(str), return_inverse=True)
            row, slot = ngram_slots(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            counts = np.bincount(code[row] * SLOTS + slot, minlength=len(names) * SLOTS).reshape(-1, SLOTS)
            for name, own in zip(names, counts):
                totals[name] = totals.get(name, 0) + own
    for name, own in totals.items():
        used = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(used), pa.string()), pa.array(used.astype(np.int32)), pa.array(own[used])], ["lang", "slot", "n"])


def train(docs: DataFrame) -> Model | None:
    """Learn from text and lang of all rows that are not held out and have both."""
    rows = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")
    counts = rows.mapInArrow(_count, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(counts.column("lang").to_pylist()))
    if not names:
        return None
    at = {x: k for k, x in enumerate(names)}
    table = np.full((len(names), SLOTS), 0.5)
    table[[at[x] for x in counts.column("lang").to_pylist()], counts.column("slot").to_numpy()] += counts.column("n").to_numpy()
    table /= table.sum(1, keepdims=True)
    codes = codewords(len(names))
    ones, zeros = np.maximum(codes, 0).T @ table, np.maximum(-codes, 0).T @ table
    ones, zeros = ones / np.maximum(ones.sum(1, keepdims=True), 1e-9), zeros / np.maximum(zeros.sum(1, keepdims=True), 1e-9)
    weights = (np.log(ones + 1e-9) - np.log(zeros + 1e-9)).T
    own = table @ weights  # what a text of each language scores on average
    return Model(tuple(names), codes, weights.astype(np.float32), np.maximum(np.abs(own).mean(0), 1e-6))


def _predictor(model: Model | None, carry: list[str]):
    def has_letter(text: bytes, ascii_letter: bool) -> bool:
        return ascii_letter or any(map(str.isalpha, text.decode("utf-8", "replace")))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            pred, score, unsure = [], [], []
            for lo, hi in blocks(offsets):
                part, ends = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                letters = np.concatenate([[0], np.cumsum((_LETTER[part] != 32) & (part < 128))])
                ascii_letters = letters[ends[1:]] > letters[ends[:-1]]
                if model:
                    counts = histograms(part, ends).astype(np.float32)
                    margins = (counts @ model.weights) / np.maximum(counts.sum(1, keepdims=True), 1)
                    best, share, lead = model.decode(margins)
                for k in range(hi - lo):
                    known = model and has_letter(part[ends[k] : ends[k + 1]].tobytes(), ascii_letters[k])
                    pred.append(model.languages[best[k]] if known else "und")
                    score.append(float(share[k]) if known else 0.0)
                    unsure.append(bool(lead[k] < AMBIGUOUS) if known else True)
            made = [pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(unsure, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*map(batch.column, carry), *made], [*carry, "lang_pred", "score", "ambiguous"])

    return predict


def _annotated(docs: DataFrame, carry: list[str], model: Model | None) -> DataFrame:
    schema = docs.select(*carry).schema
    for name, kind in (("lang_pred", "string"), ("score", "double"), ("ambiguous", "boolean")):
        schema = schema.add(name, kind)
    rows = docs.select(*dict.fromkeys([*carry, "text"]))
    return rows.mapInArrow(_predictor(model, carry), schema)


def annotate(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``row`` (every column of the document, which may have any names), lang_pred, score and ambiguous."""
    return _annotated(docs.select(whole_row(docs), "text"), ["row"], model or train(docs))


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """One row per document.  Trains on ``docs`` when no model is given."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out().alias("held_out"))
    return _annotated(rows, ["doc_id", "held_out"], model or train(docs))
