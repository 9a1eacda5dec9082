"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A feature is the presence of a hashed n-gram in a text, scaled by the log of the ratio of
its smoothed rates in toxic and in other texts. The MAX_FEATURES features with the largest
ratios for their support feed a logistic regression, whose margins are calibrated on
folds that it has not seen. It learns from a bounded hash sample of labelled rows.

Null and empty texts count as texts without a feature and get the score of the intercept.
Very long texts are scored whole. Without labels of both kinds every score is 0. Repeated
rows and ids all stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.llm._features import unique_buckets
from voxloom.llm._learn import labelled_texts
from voxloom.llm._linear import Sparse, fit, folds, platt, sigmoid
from voxloom.llm._spark import checkpoint, chunks, map_texts

ORDERS, BITS = (4, 5), 20
#: Labelled rows that are learned from, about; and tasks that count them.
ROWS, TASKS = 6000, 6
MAX_FEATURES, ALPHA, L2, FOLDS = 2000, 1.0, 1.0, 4
PREDICTED_FROM = 0.3


def learn(sample: DataFrame, label: str = "toxic") -> tuple[np.ndarray, float] | None:
    """A weight for each bucket and the intercept; the sigmoid of their sum is the score. None without both labels."""
    sample = checkpoint(sample.select(F.coalesce("text", F.lit("")).alias("text"), F.col(label).alias("y")).repartition(TASKS))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rows = np.zeros((2, 2**BITS), np.int64), [0, 0]
        for batch in batches:
            for part in chunks(batch, "text"):
                y = np.array(part.column("y").to_pylist())
                own, bucket = unique_buckets(part.column("text").to_pylist(), ORDERS, BITS)
                for k in (0, 1):
                    seen[k] += np.bincount(bucket[y[own] == k], minlength=2**BITS)
                    rows[k] += int((y == k).sum())
        for k in (0, 1):
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([rows[k]]), pa.array([seen[k].astype(np.uint32).tobytes()])], names=["y", "n", "seen"])

    seen, rows = np.zeros((2, 2**BITS)), [0, 0]
    for row in sample.mapInArrow(count, "y long, n long, seen binary").toLocalIterator():
        seen[row["y"]] += np.frombuffer(row["seen"], np.uint32)
        rows[row["y"]] += row["n"]
    if not all(rows):
        return None
    rate = (seen + ALPHA) / (np.array(rows)[:, None] + 2 * ALPHA)
    ratio = np.log(rate[1] / rate[0])
    worth = np.where(seen.sum(0) >= 2, np.abs(ratio) * np.sqrt(seen.sum(0)), 0)
    chosen = np.sort(np.argsort(-worth, kind="stable")[: min(MAX_FEATURES, int((worth > 0).sum()))])
    wanted = np.zeros(2**BITS, bool)
    wanted[chosen] = True
    held = sample.sparkSession.sparkContext.broadcast(wanted)

    def features(batch: pa.RecordBatch) -> list[pa.RecordBatch]:
        own, bucket = unique_buckets(batch.column("text").to_pylist(), ORDERS, BITS, held.value)
        parts = np.split(bucket.astype(np.int32), np.searchsorted(own, np.arange(1, batch.num_rows)))
        return [pa.RecordBatch.from_arrays([batch.column("y"), pa.array([p.tobytes() for p in parts])], names=["y", "buckets"])]

    found = sorted((r["y"], bytes(r["buckets"])) for r in map_texts(sample, "text", features, "y int, buckets binary").toLocalIterator())
    y = np.array([r[0] for r in found], float)
    columns = [np.frombuffer(r[1], np.int32) for r in found]
    col = np.concatenate(columns)
    row = np.repeat(np.arange(len(y)), [len(c) for c in columns])
    x = Sparse(row, np.searchsorted(chosen, col), ratio[col], (len(y), len(chosen)))
    fold = folds(len(y), FOLDS)
    margin = np.zeros(len(y))
    for k in range(FOLDS):
        w, b = fit(x, y, (fold != k).astype(float), L2)
        margin[fold == k] = (x.dot(w) + b)[fold == k]
    slope, shift = platt(margin, y)
    w, b = fit(x, y, None, L2)
    weight = np.zeros(2**BITS, np.float32)
    weight[chosen] = slope * w * ratio[chosen]
    return weight, slope * b + shift


def score_texts(texts: list[str | None], weight: np.ndarray, intercept: float) -> np.ndarray:
    own, bucket = unique_buckets([t or "" for t in texts], ORDERS, BITS, weight != 0)
    return sigmoid(np.bincount(own, weight[bucket], len(texts)) + intercept)


def score_toxicity(docs: DataFrame, labels: DataFrame, held_out: Column, label: str = "toxic", text: str = "text", rows: int = ROWS) -> DataFrame:
    """`doc_id`, `held_out`, `score` and `predicted` of each row of `docs`; rows of `labels` are learned from as they are."""
    source = docs.select("doc_id", held_out.alias("held_out"), F.col(text).alias("text"))
    model = learn(labelled_texts(source.select("doc_id", "text"), labels.select("doc_id", label), label, rows), label)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def score(batch: pa.RecordBatch) -> list[pa.RecordBatch]:
        texts = batch.column("text").to_pylist()
        scores = score_texts(texts, *held.value) if held.value else np.zeros(len(texts))
        columns = [batch.column("doc_id"), batch.column("held_out"), pa.array(scores), pa.array((scores >= PREDICTED_FROM).astype(np.int32))]
        return [pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "score", "predicted"])]

    return map_texts(source, "text", score, f"doc_id {dict(source.dtypes)['doc_id']}, held_out boolean, score double, predicted int")
