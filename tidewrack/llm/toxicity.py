"""Toxicity: a linear classifier over character n-grams whose features are scaled by naive Bayes log-count ratios.

A text's features are the n-grams (3 to 6 characters, lower-cased, with everything but letters and digits as a space)
that it holds at least once. Their log-count ratios between toxic and other labelled texts scale the inputs of a
logistic regression (Wang and Manning, 2012). Only the n-grams whose ratio carries most weight are kept, so that a
score is a sum over few hits: as many as make ``HITS_PER_TEXT`` of them in a training text on average. The classifier is fitted on a bounded sample of labelled rows (``TRAIN_ROWS`` rows and
``TRAIN_CHARS`` characters at most); every whole text is scored.
"""

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewrack.llm.common import bounded_keys, codes, id_bucket, ngram_hashes, per_worker, small_batches, training_texts, trim

TRAIN_ROWS, TRAIN_CHARS = 10_000, 30_000_000
SIZES, BITS = (3, 4, 5, 6), 20
#: Features kept at most, their occurrences for each training text on average, least number of texts that hold one, weight
#: of the squared norm, and occurrences that a step of the descent takes at a time.
KEPT, HITS_PER_TEXT, LEAST_TEXTS, RIDGE, PART = 1 << 15, 200, 4, 1e-3, 1 << 20
#: Characters taken at a time.
CHUNK = 200_000
FOLDS = 5


class Model:
    """Weight of every n-gram bucket, and the intercept."""

    def __init__(self, weights: np.ndarray, intercept: float) -> None:
        self.weights, self.intercept = weights, intercept

    def score(self, texts: list[str]) -> np.ndarray:
        """Probability of each text; a text without a known n-gram gets the intercept's."""
        chars, starts = codes(texts, "isalnum")
        total = np.full(len(texts), self.intercept)
        for x in ngram_hashes(chars, starts, SIZES, BITS):
            w = self.weights[x]
            hit = np.flatnonzero(w)
            key = np.unique((np.searchsorted(starts, hit, "right") - 1) << BITS | x[hit])
            total += np.bincount(key >> BITS, self.weights[key & ((1 << BITS) - 1)], len(texts))[: len(texts)]
        return 1 / (1 + np.exp(-np.clip(total, -500, 500)))


def chunks(texts: list[str]):
    """Neighbouring texts of about CHUNK characters."""
    batch: list[str] = []
    held = 0
    for t in texts:
        batch.append(t)
        held += len(t)
        if held > CHUNK:
            yield batch
            batch, held = [], 0
    if batch:
        yield batch


def _grams(texts: list[str]):
    """Number of each text and its n-grams of one size, repeats included."""
    done = 0
    for batch in chunks(texts):
        chars, starts = codes(batch, "isalnum")
        for x in ngram_hashes(chars, starts, SIZES, BITS):
            for k in range(len(batch)):
                yield done + k, x[starts[k] : starts[k + 1]]
        done += len(batch)


def _document_counts(texts: list[str], toxic: np.ndarray) -> np.ndarray:
    """Texts of either label that hold each n-gram. Of equal n-grams the one whose mark is left last counts."""
    seen, mark = np.zeros((2, 1 << BITS)), np.zeros(1 << BITS, np.int32)
    for doc, x in _grams(texts):
        here = np.arange(len(x), dtype=np.int32)
        mark[x] = here
        seen[int(toxic[doc]), x[mark[x] == here]] += 1
    seen[:, 0] = 0
    return seen


def fit(texts: list[str], toxic: np.ndarray) -> Model:
    """Without both labels, every score is the share of toxic texts (0.5 without any text)."""
    toxic = np.asarray(toxic, np.float64)
    if not len(toxic) or toxic.min() == toxic.max():
        share = float(toxic.mean()) if len(toxic) else 0.5
        return Model(np.zeros(1 << BITS, np.float32), float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    seen = _document_counts(texts, toxic)
    n = np.array([(toxic == 0).sum(), (toxic == 1).sum()])
    ratio = np.log((seen[1] + 1) / (n[1] + 2)) - np.log((seen[0] + 1) / (n[0] + 2))
    ratio[seen.sum(0) < LEAST_TEXTS] = 0
    spread = np.abs(ratio) * np.sqrt(seen.sum(0))
    kept = np.argsort(-spread, kind="stable")[:KEPT]
    kept = kept[(spread[kept] > 0) & (np.cumsum(seen.sum(0)[kept]) <= HITS_PER_TEXT * len(texts))]
    place = np.full(1 << BITS, -1, np.int32)
    place[kept] = np.arange(len(kept))
    doc, feature = _hits(texts, place)
    weight = np.where(toxic == 1, len(toxic) / (2 * n[1]), len(toxic) / (2 * n[0])) / len(toxic)
    beta, bias = _descend(doc, feature, ratio[kept], toxic, weight)
    out = np.zeros(1 << BITS, np.float32)
    out[kept] = beta * ratio[kept]
    return Model(out, bias)


def _hits(texts: list[str], place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text and number (by ``place``) of every kept n-gram that a text holds."""
    docs, features = [], []
    for doc, x in _grams(texts):
        found = np.unique(place[x])
        found = found[found >= 0]
        docs.append(np.full(len(found), doc, np.int32))
        features.append(found.astype(np.uint16 if KEPT <= 1 << 16 else np.int32))
    return np.concatenate(docs), np.concatenate(features)


def _descend(doc, feature, ratio, label, weight, steps: int = 120) -> tuple[np.ndarray, float]:
    """Ridge-penalised logistic regression on features of the values ``ratio``, by accelerated gradient steps with adaptive
    scales. Occurrences are taken PART at a time, so only they themselves grow with the sample."""
    parts = [slice(a, a + PART) for a in range(0, len(doc), PART)]
    n = len(ratio)
    beta, bias = np.zeros(n), 0.0
    m, v, mb, vb = np.zeros(n), np.zeros(n), 0.0, 0.0
    for t in range(1, steps + 1):
        own = ratio * beta
        z = np.full(len(label), bias)
        for p in parts:
            z += np.bincount(doc[p], own[feature[p]], len(label))
        gap = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - label) * weight
        g = RIDGE * beta
        for p in parts:
            g += ratio * np.bincount(feature[p], gap[doc[p]], n)
        gb = gap.sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        rate = 0.05 / np.sqrt(t)
        beta -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        bias -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-9)
    return beta, float(bias)


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic", rows: int = TRAIN_ROWS, most_chars: int = TRAIN_CHARS) -> Model:
    """Fit on labelled rows whose id bucket is not 0. Null labels and ids are left out; of repeated labels the highest holds."""
    usable = labels.select(F.col(doc_id).alias("k"), F.col(toxic).cast("int").alias("y")).filter((id_bucket(F.col("k"), FOLDS) != 0) & F.col("y").isNotNull() & F.col("k").isNotNull())
    chosen = bounded_keys(usable.groupBy("k").agg(F.max("y").alias("y")), "k", rows)
    texts = docs.select(F.col(doc_id).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    got = training_texts(texts.join(F.broadcast(chosen), "k").select("k", "text", "y"), rows, most_chars)
    got = got.sort_by([("k", "ascending"), ("text", "ascending")])
    texts, toxic_ = got["text"].to_pylist(), np.array(got["y"].to_pylist(), np.float64) > 0
    del got
    model = fit(texts, toxic_)
    del texts
    trim()  # the driver goes on to other work
    return model


def score(spark, model: Model, text: Column) -> Column:
    """Score of a text column, 0 to 1; null counts as empty."""
    small_batches(spark)
    shared, key = spark.sparkContext.broadcast(model), f"toxicity-{uuid.uuid4().hex}"

    def run(texts: pa.Array) -> pa.Array:
        model = per_worker(key, lambda: shared.value)
        found = [model.score(b) for b in chunks([t or "" for t in texts.to_pylist()])]
        trim()
        return pa.array(np.concatenate(found) if found else np.zeros(0), pa.float64())

    return F.arrow_udf(run, "double")(text)


def toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, held_out, score and predicted of every row.

    Null and empty texts are scored as texts without n-grams; repeated rows give repeated results; a null id has the
    bucket of the empty text; an empty table gives no rows; other columns are ignored, whatever their names.
    """
    model = train(docs, labels, doc_id, text)
    scored = docs.select(F.col(doc_id).alias("k"), score(docs.sparkSession, model, F.col(text)).alias("score"))
    return scored.select(F.col("k").alias(doc_id), (id_bucket(F.col("k"), FOLDS) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that are not predicted toxic, with all their columns."""
    model = train(docs, labels, doc_id, text)
    mark = "__toxicity"
    return docs.withColumn(mark, score(docs.sparkSession, model, F.col(text))).filter(F.col(mark) < 0.5).drop(mark)
