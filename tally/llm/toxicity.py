"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; a sample of all texts, whatever
their labels, is the unlabelled set, which holds toxic ones at the class
prior.  The risk of a classifier is estimated without any negative label:
``prior * R(positives as toxic) + max(0, R(unlabelled as clean) - prior *
R(positives as clean))``.  The second term cannot be negative for a true
risk, so where the estimate is, its gradient is reversed, which keeps
flexible models from overfitting.

Features are the different words of a text (lower case, hashed); linear
classifiers are fitted by Adam in numpy on the driver, each on its own random
part of the sample, and their probabilities averaged.  The sample is bounded
by ``POSITIVES`` and ``UNLABELLED`` texts, chosen in hash order.  Scoring is
one Arrow pass over whole texts without a shuffle.

Defined results: null and empty texts get the classifiers' score of a text
without words; without a positive or an unlabelled text to learn from every
score is the prior; a repeated id is learnt from once (its text of the
smallest hash); a document labelled more than once counts as toxic if one
label says so; null ids and labels are never learnt from.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import LOWER, Words, byte_class, slices, text_buffers

#: Bounds of the learning sample.
POSITIVES, UNLABELLED = 4000, 12000
#: Word buckets (a power of two).
BUCKETS = 1 << 20
#: A word is a feature if its shares of positive and of unlabelled texts are
#: so many standard errors apart.
APART = 5.0
MODELS, PART, STEPS, RATE, SHRINK = 3, 0.8, 300, 0.05, 1e-4

_WORD = byte_class(rb"[0-9A-Za-z\x80-\xFF]")
_U = np.uint64


class Model(NamedTuple):
    words: np.ndarray  # sorted word buckets
    weights: np.ndarray  # one row per classifier
    bias: np.ndarray
    prior: float


def _features(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices: (first row, rows, owner of each word, its bucket)."""
    data, offsets = text_buffers(column)
    for lo, hi in slices(offsets):
        found = Words(data, offsets, lo, hi, _WORD, LOWER)
        bucket = (found.hashes() >> _U(20)) & _U(BUCKETS - 1)
        yield lo, hi - lo, np.repeat(np.arange(hi - lo), np.diff(found.first)), bucket.astype(np.int64)


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Different word buckets of each sampled text, packed."""
    for batch in batches:
        packed = []
        for _, n, owner, bucket in _features(batch.column(1)):
            key = np.unique(owner * BUCKETS + bucket)
            cut = np.searchsorted(key, np.arange(n + 1) * BUCKETS)
            packed += [(key[a:b] % BUCKETS).astype(np.int32).tobytes()
                       for a, b in zip(cut[:-1], cut[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())],
                                         names=["positive", "words"])


def fold(id_col: str) -> Column:
    """Remainder of the id's checksum by which rows are held out (0)."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> Model:
    """Learn from documents and labels outside the held-out fold."""
    known = (labels.where((fold(id_col) != 0) & F.col(label_col).isNotNull())
             .groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).alias("_label")))
    seen, toxic = known.agg(F.count("*"), F.coalesce(F.sum("_label"), F.lit(0))).first()
    prior = float(np.clip(toxic / seen, 1e-3, 0.5)) if seen else 1e-3
    order = F.xxhash64(F.col("_id"), F.lit(1))
    some = known.where("_label = 1").select("_id").orderBy(order, "_id").limit(POSITIVES)
    rest = (docs.where(fold(id_col) != 0).select(F.col(id_col).alias("_id")).distinct()
            .orderBy(order, "_id").limit(UNLABELLED))
    # bounded by POSITIVES + UNLABELLED rows
    chosen = F.broadcast(some.select("_id", F.lit(True).alias("positive"))
                         .unionByName(rest.select("_id", F.lit(False).alias("positive"))))
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(chosen, "_id")
    # one text per sampled id: the one of the smallest hash
    texts = (texts.groupBy("_id", "positive").agg(F.min(F.struct(F.xxhash64("_text").alias("hash"), "_text")).alias("_first"))
             .select("positive", "_first._text"))
    rows = texts.select("positive", "_text").mapInArrow(_fetch, "positive boolean, words binary").collect()
    rows = sorted((bool(r["positive"]), bytes(r["words"])) for r in rows)
    return train([np.frombuffer(w, np.int32) for p, w in rows if p],
                 [np.frombuffer(w, np.int32) for p, w in rows if not p], prior)


def train(positives: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, seed: int = 3) -> Model:
    """Classifiers from two lists of word sets."""
    texts = positives + unlabelled
    if not positives or not unlabelled:
        return Model(np.zeros(0, np.int64), np.zeros((1, 0)), np.array([np.log(prior / (1 - prior))]), prior)
    words, where = np.unique(np.concatenate(texts), return_inverse=True)
    n_p, n_u = len(positives), len(unlabelled)
    ours = np.bincount(where[:sum(map(len, positives))], minlength=len(words))
    count = np.bincount(where, minlength=len(words))
    both = count / (n_p + n_u)
    error = np.sqrt(both * (1 - both) * (1 / n_p + 1 / n_u))
    keep = np.abs(ours / n_p - (count - ours) / n_u) >= APART * error + 1e-12
    place = np.where(keep, np.cumsum(keep) - 1, -1)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    used = place[where] >= 0
    owner, column = owner[used], place[where][used]
    n, width = len(texts), int(keep.sum())
    first = np.searchsorted(owner, np.arange(n + 1))
    positive = np.arange(n) < len(positives)
    weights, bias = np.zeros((MODELS, width)), np.zeros(MODELS)
    for m in range(MODELS):
        rng = np.random.default_rng([seed, m])
        mine = rng.random(n) < PART
        pos, unl = mine & positive, mine & ~positive
        pos, unl = (pos, unl) if pos.any() and unl.any() else (positive, ~positive)
        rate_p, rate_u = pos / pos.sum(), unl / unl.sum()
        w, b = np.zeros(width), np.log(prior / (1 - prior))
        mean, power = np.zeros(width + 1), np.zeros(width + 1)
        for step in range(1, STEPS + 1):
            run = np.concatenate([[0.0], np.cumsum(w[column])])
            z = run[first[1:]] - run[first[:-1]] + b
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            clean = np.logaddexp(0, z)  # loss of calling a text clean
            negative = rate_u @ clean - prior * (rate_p @ clean)
            if negative >= 0:
                slope = prior * rate_p * (p - 1) + rate_u * p - prior * rate_p * p
            else:
                slope = -(rate_u * p - prior * rate_p * p)
            grad = np.append(np.bincount(column, slope[owner], width) + SHRINK * w * prior, slope.sum())
            mean += 0.1 * (grad - mean)
            power += 0.01 * (grad * grad - power)
            move = RATE * (mean / (1 - 0.9 ** step)) / (np.sqrt(power / (1 - 0.99 ** step)) + 1e-6)
            w, b = w - move[:-1], b - move[-1]
        weights[m], bias[m] = w, b
    return Model(words[keep].astype(np.int64), weights, bias, prior)


def score(docs: DataFrame, id_col: str, text_col: str, model: Model) -> DataFrame:
    """One row per input row: the id, ``score`` and ``predicted``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a weight per word of the bounded sample
    rows = docs.select(F.col(id_col), F.col(text_col).alias("_text"))
    schema = T.StructType([rows.schema[0], T.StructField("score", T.DoubleType(), False),
                           T.StructField("predicted", T.IntegerType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        place = np.full(BUCKETS, -1, np.int32)
        place[model.words] = np.arange(len(model.words))
        for batch in batches:
            parts = []
            for _, n, owner, bucket in _features(batch.column(1)):
                at = place[bucket]
                hit = at >= 0
                width = max(1, len(model.words))
                key = np.unique(owner[hit] * width + at[hit])
                of, at = key // width, key % width
                z = np.stack([np.bincount(of, w[at] if len(at) else None, n) + b
                              for w, b in zip(model.weights, model.bias, strict=True)])
                parts.append((1 / (1 + np.exp(-np.clip(z, -30, 30)))).mean(axis=0))
            scores = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))],
                names=[id_col, "score", "predicted"])

    return rows.mapInArrow(run, schema)
