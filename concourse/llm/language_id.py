"""Language identification: sparse multinomial logistic regression on TF-IDF of hashed character n-grams.

Document frequencies come from all learnable documents. Weights are learned by follow-the-regularised-leader (proximal,
per coordinate) with L1 and L2 penalties on a bounded sample, and a temperature is then fitted on a part of that sample
that the weights did not see.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import tidy

BUCKETS = 1 << 14
SAMPLE_ROWS = 2400  # the classifier is fitted on about so many labelled rows, spread evenly over the languages
UNKNOWN = "und"


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def ngram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """(buckets, counts) of the 1- to 3-grams of a whole text in lower case, all but letters as one space; None if it has no letter."""
    if not text:
        return None
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[code]
    if not letter.any():
        return None
    code = np.where(letter, code, 32).astype(np.uint32)
    code = np.r_[np.uint32(32), code[letter | np.r_[True, letter[:-1]]], np.uint32(32)]
    total = np.zeros(BUCKETS, np.int64)
    h = np.zeros(len(code), np.uint32)
    for n in (1, 2, 3):
        if len(code) < n:
            break
        h = (h[: len(code) - n + 1] ^ code[n - 1 :]) * np.uint32(0x9E3779B1) + np.uint32(n)
        h ^= h >> np.uint32(15)
        total += np.bincount(((h * np.uint32(0x85EBCA6B)) >> np.uint32(18)).astype(np.int64), minlength=BUCKETS)
    at = np.flatnonzero(total)
    return at, total[at]


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen, n = np.zeros(BUCKETS, np.int64), 0
    for batch in batches:
        for text in batch.column(0).to_pylist():
            found = ngram_counts(text)
            if found is not None:
                seen[found[0]] += 1
                n += 1
    at = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, at]), pa.array(np.r_[n, seen[at]])], names=["bucket", "n"])
    tidy()


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(lang, *[x.astype(np.int32).tobytes() for x in found], u) for text, lang, u in zip(*(c.to_pylist() for c in batch.columns)) if (found := ngram_counts(text)) is not None]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.binary(), pa.binary(), pa.int64()))], names=["lang", "at", "count", "u"])


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray  # bucket by language, mostly zero
    bias: np.ndarray
    temperature: float = 1.0

    def features(self, found: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        at, count = found
        x = (1 + np.log(count)) * self.idf[at]
        return at, x / np.sqrt((x * x).sum())

    def logits(self, found: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        at, x = self.features(found)
        return x @ self.weights[at] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        found = ngram_counts(text)
        if found is None or not self.langs:
            return UNKNOWN, 0.0
        p = softmax(self.logits(found) / self.temperature)
        best = int(p.argmax())
        return self.langs[best], float(min(1.0, p[best]))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: int, epochs: int = 4, alpha: float = 1.0, beta: float = 1.0, l1: float = 2e-3, l2: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias of a multinomial logistic regression; row BUCKETS of the state is the bias, which is not penalised by l1."""
    z, n = np.zeros((BUCKETS + 1, classes)), np.zeros((BUCKETS + 1, classes))
    order = np.random.default_rng(2)

    def now(at: np.ndarray) -> np.ndarray:
        zi, penalty = z[at], np.where(at == BUCKETS, 0.0, l1)[:, None]
        return np.where(np.abs(zi) <= penalty, 0.0, -(zi - np.sign(zi) * penalty) / ((beta + np.sqrt(n[at])) / alpha + l2))

    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, x = rows[i]
            at, x = np.r_[at, BUCKETS], np.r_[x, 1.0]
            w = now(at)
            p = softmax(x @ w)
            p[labels[i]] -= 1
            g = x[:, None] * p
            old = n[at]
            z[at] += g - (np.sqrt(old + g * g) - np.sqrt(old)) / alpha * w
            n[at] = old + g * g
    w = now(np.arange(BUCKETS + 1))
    return w[:BUCKETS], w[BUCKETS]


def calibrated(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least negative log likelihood, on a fixed grid from 0.25 to 20."""
    if not len(labels):
        return 1.0
    grid = np.geomspace(0.25, 20, 200)
    loss = []
    for t in grid:
        z = logits / t
        z = z - z.max(axis=1, keepdims=True)
        loss.append((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(labels)), labels]).mean())
    return float(grid[int(np.argmin(loss))])


def fit(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model from labelled (doc_id, text, lang); rows without text or lang teach nothing. Document frequencies use all rows, weights a bounded sample by a hash of the row."""
    rows = labelled.where("text is not null and lang is not null").select("doc_id", "text", "lang")
    totals = {r["bucket"]: r["n"] for r in rows.select("text").mapInArrow(_frequencies, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()}
    counts = sorted((r["lang"], r["n"]) for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect())
    df = np.zeros(BUCKETS)
    for b, n in totals.items():
        if b >= 0:
            df[b] = n
    idf = np.log((1 + totals.get(-1, 0)) / (1 + df)) + 1
    model = Model([lang for lang, _ in counts], idf, np.zeros((BUCKETS, len(counts))), np.zeros(len(counts)))
    if not counts:
        return model
    each = max(20, sample_rows // len(counts))
    u = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30))
    share = F.create_map(*[x for lang, n in counts for x in (F.lit(lang), F.lit(int(min(1.0, each / n) * (1 << 30))))])
    drawn = rows.select("text", "lang", u.alias("u")).where(F.col("u") < share[F.col("lang")])
    sample = sorted((r["u"], r["lang"], bytes(r["at"]), bytes(r["count"])) for r in drawn.mapInArrow(_sampled, "lang string, at binary, count binary, u long").collect())
    index = {lang: i for i, lang in enumerate(model.langs)}
    x = [model.features((np.frombuffer(a, np.int32).astype(np.int64), np.frombuffer(c, np.int32))) for _, _, a, c in sample]
    y = np.array([index[lang] for _, lang, _, _ in sample], np.int64)
    aside = np.arange(len(x)) % 5 == 4
    model.weights, model.bias = ftrl([r for r, out in zip(x, aside) if not out], y[~aside], len(counts))
    held = np.array([v @ model.weights[at] + model.bias for (at, v), out in zip(x, aside) if out]).reshape(-1, len(counts))
    model.temperature = calibrated(held, y[aside])
    return model


def _predictor(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [model.predict(t) for t in batch.column(1).to_pylist()]
            found = [pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *found, *batch.columns[2:]], names=["doc_id", "lang_pred", "score", *batch.schema.names[2:]])
        tidy()

    return run


def held_out(doc_id: Column) -> Column:
    """The rows that teach nothing: crc32 of the id as text leaves remainder 2 by 4. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, model: Model, carry: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) and, with carry, the row itself as a struct `row`, for every row of docs: the most likely learned language of the whole text and its calibrated probability.

    Null text and text without a letter give `und` with score 0, as does a model that has seen no language. Repeated
    rows give repeated results; an empty table gives an empty result; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *([F.struct("*").alias("row")] if carry else []))
    kind = f", row {rows.schema['row'].dataType.simpleString()}" if carry else ""
    return rows.mapInArrow(_predictor(model), f"doc_id long, lang_pred string, score double{kind}")
