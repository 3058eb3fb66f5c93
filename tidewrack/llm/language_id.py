"""Language identification by multilingual mixture inference.

A text is a mixture of languages: its character trigrams (lower-cased letters, everything else as a space) are drawn
from the languages' trigram distributions in unknown proportions, which expectation-maximisation estimates. The set of
languages is selected by penalised likelihood: starting from all that have a thousandth of the text, the language of the
smallest share is taken out as long as the Bayesian information criterion improves. The language of the largest share is the prediction. The
distributions are counted on a bounded sample of rows of known language (``TRAIN_ROWS`` rows, ``TRAIN_CHARS``
characters at most); every whole text is predicted.
"""

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewrack.llm.common import codes, id_bucket, ngram_hashes, per_worker, small_batches, training_texts

TRAIN_ROWS, TRAIN_CHARS = 12_000, 30_000_000
SIZES, BITS = (3,), 14
SMOOTHING = 0.5
#: Steps of expectation-maximisation at most, the change of shares at which it ends, and the least share looked at.
STEPS, CHANGE, LEAST_SHARE = 40, 1e-4, 1e-3
CHUNK = 200_000
FOLDS, HELD_OUT = 4, 2
UNKNOWN = "und"
RESULT = "struct<lang: string, share: double, langs: array<string>, shares: array<double>>"


class Model:
    """Log-probability of every trigram bucket in every language."""

    def __init__(self, langs: list[str], logp: np.ndarray) -> None:
        self.langs, self.p, self.logp = langs, np.exp(logp), logp

    def mixture(self, bucket: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Languages (numbers) selected for a text of so many trigrams, and their shares."""
        n = count.sum()
        p = self.p[bucket]
        scale = p.max(1)
        p = p / scale[:, None]
        base = float(count @ np.log(scale))
        here = np.arange(len(self.langs))
        share, fit = _shares(p, count)
        if (share < LEAST_SHARE).any():  # at once: one by one, many languages would take time by their square
            here = np.flatnonzero(share >= LEAST_SHARE)
            share, fit = _shares(p[:, here], count)
        best, fit = (here, share), fit + base - 0.5 * np.log(n) * (len(here) - 1)
        while len(here) > 1:
            here = np.delete(here, share.argmin())
            share, new = _shares(p[:, here], count)
            new += base - 0.5 * np.log(n) * (len(here) - 1)
            if new <= fit:
                break
            best, fit = (here, share), new
        return best

    def predict(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """None: no letter (or no language was learned)."""
        chars, starts = codes(texts, "isalpha")
        hashed = ngram_hashes(chars, starts, SIZES, BITS)[0]
        out = []
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            x = hashed[a:b]
            counts = np.bincount(x[x > 0], minlength=1 << BITS) if b - a > 1 << BITS else None
            if counts is not None:
                bucket = np.flatnonzero(counts)
                count = counts[bucket]
            else:
                bucket, count = np.unique(x[x > 0], return_counts=True)
            out.append(self.mixture(bucket, count) if len(bucket) and self.langs and b - a > 2 else None)
        return out


def _shares(p: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, float]:
    """Maximum-likelihood shares and the log-likelihood."""
    k, n = p.shape[1], count.sum()
    share = np.full(k, 1 / k)
    mass = p @ share
    if k > 1:
        for _ in range(STEPS):
            new = share * ((count / mass) @ p) / n
            moved = np.abs(new - share).max()
            share = np.maximum(new, 1e-12)
            mass = p @ share
            if moved < CHANGE:
                break
    return share, float(count @ np.log(mass))


def fit(texts: list[str], langs: list[str]) -> Model:
    names = sorted(set(langs))
    seen = np.full((1 << BITS, len(names)), SMOOTHING)
    number = {x: i for i, x in enumerate(names)}
    for k, name in enumerate(names):
        del name
        own = [t for t, x in zip(texts, langs, strict=True) if number[x] == k]
        for a in range(0, len(own), 500):
            chars, starts = codes(own[a : a + 500], "isalpha")
            x = ngram_hashes(chars, starts, SIZES, BITS)[0]
            seen[:, k] += np.bincount(x[x > 0], minlength=1 << BITS)
    return Model(names, np.log(seen / seen.sum(0)) if names else np.zeros((1 << BITS, 0)))


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = TRAIN_ROWS, most_chars: int = TRAIN_CHARS) -> Model:
    """Fit on rows with a text and a language whose id bucket is not the held-out one."""
    usable = docs.filter((id_bucket(F.col(doc_id), FOLDS) != HELD_OUT) & F.col(lang).isNotNull() & F.col(text).isNotNull())
    usable = usable.select(F.col(doc_id).alias("k"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    got = training_texts(usable, rows, most_chars).sort_by([("k", "ascending"), ("text", "ascending")])
    return fit(got["text"].to_pylist(), got["lang"].to_pylist())


def mixture(spark, model: Model, text: Column) -> Column:
    """Struct column: predicted language, its share, and all selected languages with their shares, largest first."""
    small_batches(spark)
    shared, key = spark.sparkContext.broadcast(model), f"language-{uuid.uuid4().hex}"

    def run(texts: pa.Array) -> pa.Array:
        model = per_worker(key, lambda: shared.value)
        found: list = []
        batch: list[str] = []
        held = 0
        for t in texts.to_pylist():
            batch.append(t or "")
            held += len(batch[-1])
            if held > CHUNK:
                found += model.predict(batch)
                batch, held = [], 0
        found += model.predict(batch) if batch else []
        rows = []
        for x in found:
            if x is None:
                rows.append({"lang": UNKNOWN, "share": 0.0, "langs": [], "shares": []})
                continue
            order = np.argsort(-x[1], kind="stable")
            names, shares = [model.langs[i] for i in x[0][order]], np.minimum(x[1][order], 1.0).tolist()
            rows.append({"lang": names[0], "share": shares[0], "langs": names, "shares": shares})
        kind = pa.struct([("lang", pa.string()), ("share", pa.float64()), ("langs", pa.list_(pa.string())), ("shares", pa.list_(pa.float64()))])
        return pa.array(rows, kind)

    return F.arrow_udf(run, RESULT)(text)


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """id, held_out, lang_pred, score, langs and shares of every row.

    Texts that are null or hold no letter are ``und`` with score 0; repeated rows give repeated results; a null id has the
    bucket of the empty text; without any language to learn from everything is ``und``; an empty table gives no rows;
    other columns are ignored, whatever their names.
    """
    model = train(docs, doc_id, text, lang)
    found = docs.select(F.col(doc_id).alias("k"), F.col(text).alias("t")).select("k", mixture(docs.sparkSession, model, F.col("t")).alias("m"))
    return found.select(F.col("k").alias(doc_id), (id_bucket(F.col("k"), FOLDS) == HELD_OUT).alias("held_out"), F.col("m.lang").alias("lang_pred"), F.col("m.share").alias("score"), "m.langs", "m.shares")
