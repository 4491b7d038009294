"""Quality classifier: a factorisation machine over hashed words, structure statistics and text metadata.

score = sigmoid(b + sum w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2]): all pairwise
interactions at low rank, in time linear in the features a text has.  Features: hashed words with
log counts, scaled to length one; the standardised statistics of form; length and lines as metadata of
the text itself.  Labels, language, source and id are never features.

The model is fitted with Adam on the driver on at most ``sample`` labelled rows, those of the
smallest hash of the id; it has ``buckets * (rank + 1)`` numbers, whatever the corpus.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_position, position, rows_of, smallest, texts_of
from .textstats import SHARES, statistics, words_of

STRUCTURE = [*SHARES, "log_chars", "log_lines", "log_words"]


def word_features(text: str, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, values) of the lower-cased words, crc32 modulo the number of buckets; values have length one."""
    counts: Counter = Counter()
    for w, n in Counter(words_of(text.lower())).items():
        counts[zlib.crc32(w.encode("utf-8", "surrogatepass")) % buckets] += n
    idx = np.fromiter(counts.keys(), np.int64, len(counts))
    val = np.log1p(np.fromiter(counts.values(), np.float64, len(counts)))
    return idx, val / max(1e-9, np.sqrt((val ** 2).sum()))


def structure_features(text: str) -> np.ndarray:
    s = statistics(text)
    return np.array([*s[5:], np.log1p(len(text)), np.log1p(text.count("\n")), np.log1p(s[0])])


@dataclass
class Machine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    buckets: int

    def row(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        idx, val = word_features(text, self.buckets)
        z = np.clip((structure_features(text) - self.mean) / self.scale, -5, 5) / np.sqrt(len(self.mean))
        return np.concatenate([idx, self.buckets + np.arange(len(z))]), np.concatenate([val, z])

    def score(self, text: str) -> float:
        idx, x = self.row(text)
        v = self.factors[idx] * x[:, None]
        total = self.bias + self.linear[idx] @ x + 0.5 * (v.sum(0) ** 2 - (v ** 2).sum(0)).sum()
        return float(1 / (1 + np.exp(-np.clip(total, -40, 40))))


def fit(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray, float]], buckets: int, rank: int = 8, epochs: int = 12, rate: float = 0.02,
        decay: float = 1e-5, batch: int = 128, seed: int = 11) -> Machine:
    """Fit on (word buckets, word values, structure, label 0 or 1); no rows give a machine that says one half."""
    d = len(STRUCTURE)
    rng = np.random.default_rng(seed)
    size = buckets + d
    m = Machine(0.0, np.zeros(size), rng.normal(0, 0.05, (size, rank)), np.zeros(d), np.ones(d), buckets)
    if not rows:
        m.factors[:] = 0
        return m
    s = np.array([r[2] for r in rows])
    m.mean, m.scale = s.mean(0), np.maximum(s.std(0), 1e-6)
    z = np.clip((s - m.mean) / m.scale, -5, 5) / np.sqrt(d)
    y = np.array([r[3] for r in rows])
    m.bias = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    params = np.concatenate([m.linear[:, None], m.factors], axis=1)
    first, second, bias, step = np.zeros_like(params), np.zeros_like(params), np.array([m.bias, 0.0, 0.0]), 0
    tail = buckets + np.arange(d)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            part = order[at:at + batch]
            idx = np.concatenate([np.concatenate([rows[i][0], tail]) for i in part])
            x = np.concatenate([np.concatenate([rows[i][1], z[i]]) for i in part])
            starts = np.cumsum([0] + [len(rows[i][0]) + d for i in part])[:-1]
            counts = np.diff(np.append(starts, len(idx)))
            vx = params[idx, 1:] * x[:, None]
            sums = np.add.reduceat(vx, starts)
            out = bias[0] + np.add.reduceat(params[idx, 0] * x, starts) + 0.5 * (sums ** 2 - np.add.reduceat(vx ** 2, starts)).sum(1)
            err = (1 / (1 + np.exp(-np.clip(out, -40, 40))) - y[part]) / len(part)
            e = np.repeat(err, counts)[:, None] * x[:, None]
            grad = np.concatenate([e, e * (np.repeat(sums, counts, axis=0) - vx)], axis=1)
            used, where = np.unique(idx, return_inverse=True)
            g = np.stack([np.bincount(where, grad[:, k], len(used)) for k in range(rank + 1)], axis=1) + decay * params[used]
            step += 1
            first[used] = 0.9 * first[used] + 0.1 * g
            second[used] = 0.999 * second[used] + 0.001 * g * g
            fix = np.sqrt(1 - 0.999 ** step) / (1 - 0.9 ** step)
            params[used] -= rate * fix * first[used] / (np.sqrt(second[used]) + 1e-8)
            bias[1] = 0.9 * bias[1] + 0.1 * err.sum()
            bias[2] = 0.999 * bias[2] + 0.001 * err.sum() ** 2
            bias[0] -= rate * fix * bias[1] / (np.sqrt(bias[2]) + 1e-8)
    m.bias, m.linear, m.factors = float(bias[0]), params[:, 0].copy(), params[:, 1:].copy()
    return m


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text falls into the fold; a missing id doesn't."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = 8_000, buckets: int = 1 << 13, folds: int = 3, fold: int = 1, **how) -> Machine:
    """Fit on at most ``sample`` labelled documents outside the held-out fold."""
    lab = (labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), folds, fold))
           .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality")))
    texts = texts_of(docs)
    there = texts.select("doc_id").distinct()
    chosen = smallest(lab.join(there, "doc_id", "left_semi"), "doc_id", sample)
    rows = texts.join(F.broadcast(chosen), "doc_id")  # at most `sample` rows of two numbers

    def features(batches):
        import pyarrow as pa
        for doc_id, text, quality in rows_of(batches, "doc_id", "text", "quality"):
            idx, val = word_features(text, buckets)
            yield pa.RecordBatch.from_pydict({"doc_id": [doc_id], "idx": [idx.astype("<u2" if buckets <= 1 << 16 else "<u4").tobytes()], "val": [val.astype("<f4").tobytes()],
                                              "structure": [structure_features(text).tobytes()], "quality": [float(quality)]})
    found = rows.mapInArrow(features, "doc_id long, idx binary, val binary, structure binary, quality double").collect()
    found = sorted(found)
    t = "<u2" if buckets <= 1 << 16 else "<u4"
    return fit([(np.frombuffer(r.idx, t).astype(np.int64), np.frombuffer(r.val, "<f4").astype(float), np.frombuffer(r.structure), r.quality) for r in found],
               buckets, **how)


def score_texts(texts: DataFrame, machine: Machine) -> DataFrame:
    """(doc_id, score) per row of (doc_id, text); empty texts are scored as any other."""
    def run(batches):
        import pyarrow as pa
        ids, scores = [], []
        for doc_id, text in rows_of(batches, "doc_id", "text"):
            ids.append(doc_id)
            scores.append(machine.score(text))
            if len(ids) == 5000:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(scores, pa.float64())], ["doc_id", "score"])
                ids, scores = [], []
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(scores, pa.float64())], ["doc_id", "score"])
    return texts.mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row; predicted is 1 from a score of one half on.

    Missing texts are empty and scored like any other; rows are judged one by one, so repeated rows give repeated results.
    """
    scored = score_texts(texts_of(docs), train(docs, labels, **how))
    return scored.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5, **how) -> DataFrame:
    """The documents that score ``least`` or more; columns as they came.

    A missing text is scored as an empty one and stays missing.  Repeated rows stay or go together; an empty table stays empty.
    """
    machine = train(docs, labels, **how)

    @F.pandas_udf("double")
    def score(texts):
        import pandas as pd
        return pd.Series([machine.score(t or "") for t in texts], dtype=float)
    flat = by_position(docs)
    return flat.where(score(F.col(position(docs, "text")).cast("string")) >= least).toDF(*docs.columns)
