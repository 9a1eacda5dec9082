"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of a bounded hash sample of each language are added up in the tasks; the matrix
of log-probabilities (2 ** BITS buckets by languages) is broadcast. Its size is bounded by
the number of languages. Texts are scored in batches: the rows of the matrix at a text's
n-grams are summed.

Null texts and texts without a letter are `und` with score 0. Very long texts are scored
whole. Without a row to learn from, every text is `und`. Repeated rows and ids all stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.llm._features import ngram_buckets
from voxloom.llm._spark import chunks, map_texts

ORDERS, BITS, ALPHA = (1, 2, 3), 16, 0.1
#: Rows of each language that are learned from, about; and tasks that count them.
ROWS_A_LANGUAGE, TASKS = 2000, 8
LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"


def count_ngrams(texts: list[str]) -> np.ndarray:
    total = np.zeros(2**BITS, np.int64)
    for h, bounds in ngram_buckets(texts, ORDERS, BITS):
        total += np.bincount(h, minlength=2**BITS)
    return total


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", rows: int = ROWS_A_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """Languages, and the log-probability of each bucket (row) in each language (column)."""
    known = docs.filter(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.col(key).alias("key"))
    share = {r["lang"]: rows / r["count"] for r in known.groupBy("lang").count().collect()}
    if not share:
        return [], np.zeros((2**BITS, 0), np.float32)
    shares = docs.sparkSession.createDataFrame([(k, int(min(1.0, v) * 1_000_000)) for k, v in share.items()], "lang string, share long")
    sample = known.join(F.broadcast(shares), "lang").filter(F.pmod(F.xxhash64(F.lit("lang"), "key"), F.lit(1_000_000)) < F.col("share"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in chunks(batch, "text"):
                langs, texts = part.column("lang").to_pylist(), part.column("text").to_pylist()
                for name in sorted(set(langs)):
                    counts = count_ngrams([t for x, t in zip(langs, texts) if x == name])
                    total[name] = total.get(name, 0) + counts
        for name, counts in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([counts.astype(np.int64).tobytes()])], names=["lang", "counts"])

    names = sorted(share)
    counts = {name: np.zeros(2**BITS) for name in names}
    for row in sample.select("lang", "text").repartition(TASKS).mapInArrow(count, "lang string, counts binary").toLocalIterator():
        counts[row["lang"]] += np.frombuffer(row["counts"], np.int64)
    matrix = np.stack([np.log((counts[k] + ALPHA) / (counts[k].sum() + ALPHA * 2**BITS)) for k in names], 1)
    return names, matrix.astype(np.float32)


def score_texts(texts: list[str | None], names: list[str], matrix: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The likeliest language of each text and its posterior probability under equal priors."""
    if not texts or not names:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    total = np.zeros((len(texts), len(names)))
    for h, bounds in ngram_buckets([t or "" for t in texts], ORDERS, BITS):
        total += np.add.reduceat(matrix[h], bounds[:-1], 0)
    best = total.argmax(1)
    share = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
    told = np.array([bool(t and LETTER.search(t)) for t in texts])
    return [names[i] if ok else UNKNOWN for i, ok in zip(best, told)], np.where(told, share, 0.0)


def identify(docs: DataFrame, learned_from: DataFrame, held_out: Column, text: str = "text", key: str = "doc_id", lang: str = "lang") -> DataFrame:
    """`key`, `held_out`, `lang_pred` and `score` of each row of `docs`; only texts are scored."""
    names, matrix = learn(learned_from, text, lang, key)
    held = docs.sparkSession.sparkContext.broadcast((names, matrix))
    source = docs.select(F.col(key).alias("key"), held_out.alias("held_out"), F.col(text).alias("text"))

    def score(batch: pa.RecordBatch) -> list[pa.RecordBatch]:
        names, scores = score_texts(batch.column("text").to_pylist(), *held.value)
        return [pa.RecordBatch.from_arrays([batch.column("key"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(scores)], names=[key, "held_out", "lang_pred", "score"])]

    return map_texts(source, "text", score, f"`{key}` {dict(source.dtypes)['key']}, held_out boolean, lang_pred string, score double")
