"""Quality classifier by co-training: a view of the text and a view of the metadata teach each other.

The content view sees the shape of the text (classes of characters and their hashed
trigrams, words, lines); the metadata view sees source, language and length. Each learns
from labelled rows. In every round each view gives its most confident pseudo-labels on
unlabelled rows to the other, which learns again. Both are calibrated on labelled rows
that neither has learned from, and a logistic regression there weighs the calibrated
log-odds. Labelled and unlabelled rows are bounded hash samples.

Null and empty texts have a shape without characters and are scored like all others, as
are null sources, languages and lengths. Very long texts are scored whole. Without labels
of both kinds every document scores 1 and is kept. Repeated rows and ids all stay.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.llm._features import code_points
from voxloom.llm._learn import hash_sample, labelled_texts
from voxloom.llm._linear import Dense, fit, folds, platt, sigmoid
from voxloom.llm._spark import map_texts

#: Labelled and unlabelled rows that are learned from, about.
LABELLED_ROWS, UNLABELLED_ROWS = 4000, 4000
ROUNDS, GIVEN_A_ROUND, CONFIDENT = 4, 0.05, 0.95
#: One of so many labelled rows is kept for calibration.
CALIBRATION = 4
L2, PSEUDO_WEIGHT = 0.5, 0.3
#: Documents below this are rejected, unless that would reject over MAX_GOOD_LOST of the good rows for calibration.
KEPT_FROM, MAX_GOOD_LOST = 0.5, 0.005
TRIGRAM_BITS, SOURCE_BUCKETS, LANG_BUCKETS, LENGTH_BUCKETS = 9, 64, 16, 24

# The classes of characters. Marks of ASCII have a class each.
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
LOWER, UPPER, DIGIT, SPACE, LINE, LETTER, OTHER = range(7)
CLASSES = 7 + len(MARKS)


def _classes() -> np.ndarray:
    """The class of each of the first 2 ** 16 characters."""
    found = np.full(2**16, OTHER, np.uint8)
    for i in range(2**16):
        c = chr(i)
        if c in MARKS:
            found[i] = 7 + MARKS.index(c)
        elif c == "\n":
            found[i] = LINE
        elif c.isspace():
            found[i] = SPACE
        elif c.isdigit():
            found[i] = DIGIT
        elif c.isalpha():
            found[i] = UPPER if c.isupper() else LOWER if c.islower() else LETTER
    return found


CLASS_OF = _classes()


def content_features(texts: Sequence[str | None]) -> np.ndarray:
    """A row for each text: shares of classes, hashed trigrams of classes, and measures of words and lines."""
    texts = [t or "" for t in texts]
    points, bounds = code_points(texts, 2)
    kinds = CLASS_OF[np.minimum(points, 2**16 - 1)].astype(np.int64)
    own = np.repeat(np.arange(len(texts)), np.diff(bounds))
    size = np.maximum(1, np.diff(bounds) - 3)[:, None]
    shares = np.bincount(own * CLASSES + kinds, minlength=len(texts) * CLASSES).reshape(len(texts), CLASSES) / size
    tri = (kinds[:-2] * CLASSES + kinds[1:-1]) * CLASSES + kinds[2:]
    tri = (tri * 0x9E3779B1 >> 7) & (2**TRIGRAM_BITS - 1)
    trigrams = np.bincount(own[:-2] * 2**TRIGRAM_BITS + tri, minlength=len(texts) * 2**TRIGRAM_BITS).reshape(len(texts), -1) / size
    more = np.zeros((len(texts), 6))
    for i, t in enumerate(texts):
        words, lines = t.split(), [x for x in t.split("\n") if x and not x.isspace()]
        n = max(1, len(words))
        more[i] = (np.log1p(len(words)) / 10, len(set(words)) / n, len(set(lines)) / max(1, len(lines)), len(lines) / n, sum(map(len, words)) / n / 20, max(map(len, words), default=0) ** 0.5 / 10)
    return np.hstack([np.sqrt(shares), np.sqrt(trigrams), more])


def metadata_features(source: Sequence[str | None], lang: Sequence[str | None], n_chars: Sequence[int | None]) -> np.ndarray:
    """A row for each document: hashed source, hashed language and the length's power of two, one of each set."""
    out = np.zeros((len(source), SOURCE_BUCKETS + LANG_BUCKETS + LENGTH_BUCKETS))
    bucket = lambda x, n: zlib.crc32(str(x).encode()) % n
    for i, (s, g, n) in enumerate(zip(source, lang, n_chars)):
        out[i, bucket(s, SOURCE_BUCKETS)] = 1
        out[i, SOURCE_BUCKETS + bucket(g, LANG_BUCKETS)] = 1
        out[i, SOURCE_BUCKETS + LANG_BUCKETS + min(LENGTH_BUCKETS - 1, max(0, n or 0).bit_length())] = 1
    return out


VIEWS = ("content", "metadata")


class Model:
    """Scales, weights and calibration of both views, and how they are weighed."""

    def __init__(self, labelled: dict[str, np.ndarray], y: np.ndarray, unlabelled: dict[str, np.ndarray]):
        fold = folds(len(y), CALIBRATION)
        learn = fold > 0
        if len(set(y[learn])) < 2 or len(set(y[~learn])) < 2:
            learn = np.ones(len(y), bool)
        check = fold == 0 if learn.sum() < len(y) else learn
        self.scale, rows, pool = {}, {}, {}
        for v in VIEWS:
            self.scale[v] = (labelled[v][learn].mean(0), labelled[v][learn].std(0) + 1e-3)
            rows[v], pool[v] = self.scaled(v, labelled[v]), self.scaled(v, unlabelled[v])
        own = {v: (np.empty(0, int), np.empty(0)) for v in VIEWS}
        for _ in range(ROUNDS + 1):
            self.weights = {}
            for v in VIEWS:
                given, label = own[v]
                x = np.vstack([rows[v][learn], pool[v][given]])
                weight = np.concatenate([np.ones(int(learn.sum())), np.full(len(given), PSEUDO_WEIGHT)])
                self.weights[v] = fit(Dense(x), np.concatenate([y[learn], label]), weight, L2)
            own = {a: self.pseudo(b, pool[b], own[a]) for a, b in (VIEWS, VIEWS[::-1])}
        self.calibration = {v: platt(self.margin(v, rows[v][check]), y[check]) for v in VIEWS}
        both = np.stack([self.log_odds(v, rows[v][check]) for v in VIEWS], 1)
        self.together = fit(Dense(both), y[check], l2=0.05, steps=400)
        score = self.score({v: labelled[v][check] for v in VIEWS})["score"]
        self.kept_from = min(KEPT_FROM, float(np.quantile(score[y[check] == 1], MAX_GOOD_LOST)))

    def scaled(self, view: str, x: np.ndarray) -> np.ndarray:
        mean, sd = self.scale[view]
        return np.clip((x - mean) / sd, -5, 5)

    def margin(self, view: str, x: np.ndarray) -> np.ndarray:
        w, b = self.weights[view]
        return x @ w + b

    def log_odds(self, view: str, x: np.ndarray) -> np.ndarray:
        slope, shift = self.calibration[view]
        return np.clip(slope * self.margin(view, x) + shift, -8, 8)

    def pseudo(self, view: str, pool: np.ndarray, before: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the pool, with labels, that `view` gives away: the most confident ones of either label that are new."""
        given, label = before
        p = sigmoid(self.margin(view, pool))
        p[given] = 0.5
        n = max(1, int(GIVEN_A_ROUND * len(pool)))
        good = [i for i in np.argsort(-p, kind="stable")[:n] if p[i] >= CONFIDENT]
        bad = [i for i in np.argsort(p, kind="stable")[:n] if p[i] <= 1 - CONFIDENT]
        return np.concatenate([given, np.array(good + bad, int)]), np.concatenate([label, np.ones(len(good)), np.zeros(len(bad))])

    def score(self, views: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        odds = {v: self.log_odds(v, self.scaled(v, views[v])) for v in VIEWS}
        w, b = self.together
        return {**{f"{v}_score": sigmoid(odds[v]) for v in VIEWS}, "score": sigmoid(np.stack([odds[v] for v in VIEWS], 1) @ w + b)}


def _views(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    meta = [batch.column(c).to_pylist() for c in ("source", "lang", "n_chars")]
    return {"content": content_features(batch.column("text").to_pylist()), "metadata": metadata_features(*meta)}


def _featured(df: DataFrame) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Both views and `y` of all rows of a bounded sample, in an order that depends on the rows alone."""

    def run(batch: pa.RecordBatch) -> list[pa.RecordBatch]:
        views = _views(batch)
        cells = [pa.array([x.tobytes() for x in views[v].astype(np.float32)], pa.binary()) for v in VIEWS]
        return [pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), *cells], names=["doc_id", "y", *VIEWS])]

    kind = dict(df.dtypes)["doc_id"]
    rows = sorted((r["doc_id"], r["y"], bytes(r["content"]), bytes(r["metadata"])) for r in map_texts(df, "text", run, f"doc_id {kind}, y int, content binary, metadata binary").toLocalIterator())
    width = {"content": CLASSES + 2**TRIGRAM_BITS + 6, "metadata": SOURCE_BUCKETS + LANG_BUCKETS + LENGTH_BUCKETS}
    found = {v: np.frombuffer(b"".join(r[2 + i] for r in rows), np.float32).reshape(len(rows), width[v]).astype(float) for i, v in enumerate(VIEWS)}
    return found, np.array([r[1] for r in rows], float)


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = LABELLED_ROWS, unlabelled_rows: int = UNLABELLED_ROWS) -> Model | None:
    """The co-trained model, or None without labels of both kinds."""
    columns = [F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text"), "source", "lang", F.col("n_chars").cast("long").alias("n_chars")]
    docs = docs.filter(F.col("doc_id").isNotNull()).select(*columns)
    known = labelled_texts(docs, labels.select("doc_id", label), label, rows)
    labelled, y = _featured(known.select(*docs.columns, F.col(label).cast("int").alias("y")))
    if len(set(y)) < 2:
        return None
    pool, _ = _featured(hash_sample(docs, "doc_id", unlabelled_rows).withColumn("y", F.lit(0)))
    return Model(labelled, y, pool)


def score_documents(docs: DataFrame, labels: DataFrame, label: str = "quality", carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns `carry` of each row of `docs`, with content_score, metadata_score, score and kept."""
    types = dict(docs.dtypes)
    source = docs.select(
        *[F.col(f"`{c}`").alias(f"c_{c}") for c in carry], "text", "source", "lang", F.col("n_chars").cast("long").alias("n_chars")
    )
    held = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, label))
    names = ["content_score", "metadata_score", "score"]

    def run(batch: pa.RecordBatch) -> list[pa.RecordBatch]:
        model, n = held.value, batch.num_rows
        found = model.score(_views(batch)) if model else dict.fromkeys(names, np.ones(n))
        kept = found["score"] >= (model.kept_from if model else 0)
        columns = [*(batch.column(f"c_{c}") for c in carry), *(pa.array(found[k]) for k in names), pa.array(kept)]
        return [pa.RecordBatch.from_arrays(columns, names=[*carry, *names, "kept"])]

    schema = ", ".join([*(f"`{c}` {types[c]}" for c in carry), *(f"{k} double" for k in names), "kept boolean"])
    return map_texts(source, "text", run, schema)


def keep_good(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """The rows of `docs`, all columns as they are, that the classifier learned from `labels` keeps."""
    types = dict(docs.dtypes)
    held = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, label))

    def run(batch: pa.RecordBatch) -> list[pa.RecordBatch]:
        model = held.value
        return [batch.filter(pa.array(model.score(_views(batch))["score"] >= model.kept_from)) if model else batch]

    return map_texts(docs, "text", run, ", ".join(f"`{c}` {types[c]}" for c in docs.columns))
