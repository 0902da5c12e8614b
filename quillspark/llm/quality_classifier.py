"""Quality classifier: positive-unlabelled learning with a non-negative risk.

Trusted positives and unlabelled web text train a linear model on text
statistics and hashed word shapes.  The class prior comes from how much of the
unlabelled text scores like the positives.  Training sees bounded samples;
scoring runs where the documents lie.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, ship

#: Rows that training sees, at most (the lowest by a hash of the id).
MAX_POSITIVES, MAX_UNLABELLED = 6_000, 9_000
THRESHOLD = 0.3
SHAPES = 64
DENSE = 14
_SYMBOLS = frozenset("#*$%&|<>")
_shape_of: dict[str, int] = {}


def _shape(word: str) -> int:
    """The bucket of a word's shape: runs of capitals, small letters, digits and each other character, written once."""
    got = _shape_of.get(word)
    if got is None:
        out, last = [], ""
        for c in word[:64]:
            k = "d" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c
            if k != last:
                out.append(k)
                last = k
        h = 2166136261
        for b in "".join(out).encode():
            h = ((h ^ b) * 16777619) & 0xFFFFFFFF
        got = h % SHAPES
        if len(_shape_of) > 300_000:
            _shape_of.clear()
        _shape_of[word] = got
    return got


def features(text: str | None) -> np.ndarray:
    """What the model sees of a whole text; zeros for empty and null ones."""
    out = np.zeros(DENSE + SHAPES, np.float32)
    words = (text or "").split()
    n = len(words)
    if not n:
        return out
    chars = sum(map(len, words))
    often = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    upper = sum(map(str.isupper, words))
    out[:DENSE] = (
        log1p(n), sum(text.count(c) for c in _SYMBOLS) / chars, upper / n, text.count("!") / n, text.count("|") / n,
        chars / n / 10, len(often) / n, max(often.values()) / n, sum(map(str.__eq__, words, words[1:])) / n,
        1 - len(set(lines)) / max(1, len(lines)), log1p(n / max(1, len(lines))), sum(map(str.isalpha, words)) / n,
        (len(text.encode()) - len(text)) / chars, sum(map(str.isdigit, words)) / n,
    )
    for word, k in often.items():
        out[DENSE + _shape(word)] += k
    out[DENSE:] = np.sqrt(out[DENSE:] / n)
    return out


@dataclass
class Model:
    prior: float
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = ((x - self.mean) / self.scale) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among the unlabelled, from scores of either.

    Over a set of high scores that holds no negatives, the unlabelled are as
    dense as the prior times the positives; any other set shows more.  So the
    least ratio over upper tails, with room for chance, bounds it.
    """
    cuts = np.quantile(positive, np.linspace(0.05, 0.7, 27))
    p = np.array([(positive >= c).mean() for c in cuts])
    u = np.array([(unlabelled >= c).mean() for c in cuts])
    slack = 1 / np.sqrt(len(positive)) + 1 / np.sqrt(len(unlabelled))
    return float(np.clip(np.min(u / p + 0.5 * slack / p), 0.02, 0.98))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None = None, steps: int = 600, rate: float = 0.03, decay: float = 1e-4) -> Model:
    """Minimises the non-negative unbiased risk with the logistic loss by full-batch Adam.

    The risk is prior * E+[l(f)] + max(0, Eu[l(-f)] - prior * E+[l(-f)]).
    While the second part is negative, steps lead back up out of it.
    """
    both = np.concatenate([positive, unlabelled])
    mean, scale = both.mean(0), np.maximum(both.std(0), 1e-3)
    p, u = (positive - mean) / scale, (unlabelled - mean) / scale

    def descend(share: float | None) -> tuple[np.ndarray, float]:
        w, moment, square = np.zeros(p.shape[1] + 1), 0.0, 0.0
        for step in range(1, steps + 1):
            fp, fu = p @ w[:-1] + w[-1], u @ w[:-1] + w[-1]
            sp, su = 1 / (1 + np.exp(-np.clip(fp, -35, 35))), 1 / (1 + np.exp(-np.clip(fu, -35, 35)))
            up = (su[:, None] * u).mean(0), su.mean()
            if share is None:  # positives against unlabelled, for the prior
                gw, gb = ((sp - 1)[:, None] * p).mean(0) + up[0], (sp - 1).mean() + up[1]
            else:
                gain = (sp[:, None] * p).mean(0), sp.mean()
                negative = np.logaddexp(0, fu).mean() - share * np.logaddexp(0, fp).mean()
                part = up[0] - share * gain[0], up[1] - share * gain[1]
                if negative >= 0:
                    gw, gb = share * ((sp - 1)[:, None] * p).mean(0) + part[0], share * (sp - 1).mean() + part[1]
                else:
                    gw, gb = -part[0], -part[1]
            g = np.append(gw + decay * w[:-1], gb)
            moment, square = 0.9 * moment + 0.1 * g, 0.999 * square + 0.001 * g * g
            w = w - rate * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
        return w[:-1], w[-1]

    if prior is None:
        w, b = descend(None)
        prior = estimate_prior(p @ w + b, u @ w + b)
    w, b = descend(prior)
    return Model(prior, mean, scale, w, float(b))


def in_holdout(key: Column) -> Column:
    """Whether CRC-32 of the id's text leaves 0 when divided by 5; a null id never does."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(documents: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", max_positives: int = MAX_POSITIVES, max_unlabelled: int = MAX_UNLABELLED) -> Model | None:
    """The model from rows labelled 1 outside the hold-out and rows without any label; None without positives.

    Which rows are taken depends on hashes of ids only; the ids picked are
    bounded in number, so they may be broadcast.
    """
    ship(documents.sparkSession)
    known = labels.select(F.col(key).alias("k"), F.col(label).alias("y")).where("k is not null")
    good = known.where("y = 1").where(~in_holdout(F.col("k"))).select("k").distinct().orderBy(F.xxhash64("k"), "k").limit(max_positives)
    ids = documents.select(F.col(key).alias("k")).where("k is not null")
    free = ids.join(known.select("k"), "k", "left_anti").distinct().orderBy(F.xxhash64("k"), "k").limit(max_unlabelled)
    picked = good.withColumn("positive", F.lit(True)).unionByName(free.withColumn("positive", F.lit(False)))
    rows = documents.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(picked), "k")

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(t.as_py()).tolist() for t in b.column("t")]
            yield pa.RecordBatch.from_arrays([b.column("k").cast(pa.string()), b.column("positive"), pa.array(x, pa.list_(pa.float32()))], ["k", "positive", "x"])

    got = sorted((r["k"], r["positive"], r["x"]) for r in rows.select("k", "t", "positive").mapInArrow(seen, "k string, positive boolean, x array<float>").collect())
    one = [np.array([x for _, y, x in got if y is s], float) for s in (True, False)]
    if not len(one[0]):
        return None
    return fit(one[0], one[1] if len(one[1]) else one[0])


def score(documents: DataFrame, model: Model | None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id and score of every row of ``documents``, also of empty and null texts; 0.5 for all without a model."""
    ship(documents.sparkSession)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = np.full(b.num_rows, 0.5)
            if model is not None and b.num_rows:
                s = model.score(np.array([features(t.as_py()) for t in b.column(1)], float))
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(s, pa.float64())], ["doc_id", "score"])

    return documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text)).mapInArrow(scored, "doc_id long, score double")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a document: doc_id, held_out, score, predicted.

    Null and empty texts get the score of a text without words; repeated rows are scored one by one.
    """
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, train(docs, read_table(spark, sf_dir, "labels")))
    return out.select("doc_id", in_holdout(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
