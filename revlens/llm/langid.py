"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text is the bag of its byte n-grams (ASCII lower case, white space as one kind of byte), hashed into
``buckets``.  The model averages the embeddings of the bag and applies a linear softmax; it is trained
by stochastic gradient descent in numpy on a bounded sample of labelled rows.  The executors turn the
sampled texts into bucket counts, so the driver holds ``max_rows`` x ``buckets`` numbers at most.

A part of the sample is kept from training to calibrate: a temperature is fitted to it by likelihood,
and the rejection threshold is the score below which at most ``max_reject`` of its rightly labelled
texts fall.  A softmax is sure of some language on any text, so a text is rejected for its novelty too:
the mean surprise of its buckets under those of the language's training texts, less what chance gives
so few n-grams, beyond the novelty that ``max_reject`` of the calibration texts reach (half for each
of the two thresholds).  Prediction reads whole texts in blocks; embeddings times softmax weights are
multiplied out once, so a text costs its bucket counts and one small product.
"""

from __future__ import annotations

from dataclasses import dataclass
from statistics import NormalDist
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col, utf8

BUCKETS = 8192
NGRAMS = (1, 2, 3, 4)
UNKNOWN = "und"
LETTER = r"\p{L}"


def counts(raw: bytes, buckets: int = BUCKETS, block: int = 1 << 20):
    """Hashed n-gram counts of a whole text, read in blocks that overlap by an n-gram."""
    table = np.arange(256, dtype=np.uint32)
    table[65:91] += 32
    table[[9, 10, 11, 12, 13]] = 32
    out = np.zeros(buckets, np.int64)
    longest = max(NGRAMS)
    for at in range(0, max(len(raw), 1), block):
        a = table[np.frombuffer(raw[at:at + block + longest - 1], np.uint8)]
        h = np.zeros(len(a), np.uint32)
        for n in range(1, longest + 1):
            if len(a) < n:
                break
            h = h[:len(a) - n + 1] * np.uint32(0x01000193) + a[n - 1:] + np.uint32(n)
            own = h[:block]  # n-grams that start in this block
            if n in NGRAMS:
                out += np.bincount((own * np.uint32(2654435769)) >> np.uint32(32 - (buckets - 1).bit_length()), minlength=buckets)
    return out


@dataclass
class Model:
    labels: list[str]
    weights: Any      # buckets x labels, embeddings times softmax weights over the temperature
    bias: Any         # labels, over the temperature
    threshold: float  # scores below it are rejected
    surprise: Any     # buckets x labels, -log of the smoothed share in the label's training texts, less its mean there
    spread: Any       # labels, deviation of the surprise of one n-gram
    novel: float      # novelties above it are rejected

    def predict(self, raw: bytes) -> tuple[str, float, bool]:
        c = counts(raw, len(self.weights))
        n = max(int(c.sum()), 1)
        z = c @ self.weights / n + self.bias
        p = np.exp(z - z.max())
        i = int(p.argmax())
        score = float(p[i] / p.sum())
        novelty = float(c @ self.surprise[:, i]) / n - _chance(self.spread[i], n)
        return self.labels[i], score, bool(score >= self.threshold and novelty <= self.novel)


def _chance(spread, n):
    """Surprise that chance adds to the mean of ``n`` n-grams, which overlap: three deviations."""
    return 3 * spread * (len(NGRAMS) / n) ** 0.5


def _lower_tail(v, share: float) -> float:
    """The value that ``share`` of ``v`` fall below: the quantile, and where ``v`` are too few to show it, the normal tail."""
    low = float(np.quantile(v, share))
    return low if len(v) * share >= 1 else min(low, float(v.mean() + NormalDist().inv_cdf(share) * v.std()))


def _sample(labelled: DataFrame, max_rows: int) -> DataFrame:
    """``labelled(text, lang, key)``: a share of each language by hash, ``max_rows`` in all at most."""
    sizes = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    langs = max(1, sizes.count())
    quota = max(1, max_rows // langs)
    # thinned by hash first, so that the ranking reads a little more than it keeps
    # (one row per label: no more than the model itself holds, so it is broadcast)
    part = labelled.join(F.broadcast(sizes), "lang").withColumn("h", F.xxhash64(F.lit(11), "key", "lang")) \
        .where(F.pmod("h", F.lit(1 << 20)) * F.col("n") < F.lit(float(2 * quota * (1 << 20))))
    w = Window.partitionBy("lang").orderBy("h", "key")
    return part.withColumn("r", F.row_number().over(w)).where(F.col("r") <= quota).select("text", "lang", "h")


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", max_rows: int = 2048,
        dim: int = 16, buckets: int = BUCKETS, steps: int = 600, rate: float = 20.0, max_reject: float = 0.001, seed: int = 5) -> Model | None:
    """Train on a sample of ``max_rows`` labelled rows at most, shared equally among the languages.

    Rows without a label or without a letter are passed over.  None if there is no labelled row.
    """
    labelled = docs.select(col(text).cast("string").alias("text"), col(lang).cast("string").alias("lang"), col(key).cast("string").alias("key")) \
        .where(F.col("lang").isNotNull() & F.col("text").rlike(LETTER))

    def featurise(batches):
        for b in batches:
            for raw, own, h in zip(utf8(b.column(0)), b.column(1).to_pylist(), b.column(2).to_pylist()):
                c = counts(raw, buckets)
                i = np.flatnonzero(c)
                yield pa.RecordBatch.from_arrays([pa.array([own]), pa.array([h]), pa.array([i.tolist()], pa.list_(pa.int32())),
                                                  pa.array([c[i].tolist()], pa.list_(pa.int64()))], names=["lang", "h", "i", "c"])

    got = _sample(labelled, max_rows).mapInArrow(featurise, "lang string, h long, i array<int>, c array<long>").toArrow()
    if not got.num_rows:
        return None
    order = np.argsort(got.column("h").to_numpy(), kind="stable")
    names = np.array(got.column("lang").to_pylist(), dtype=object)
    labels = sorted(set(names))
    x = np.zeros((got.num_rows, buckets), np.float32)
    lists = [got.column(k).combine_chunks() for k in ("i", "c")]
    cuts = lists[0].offsets.to_numpy()
    bucket, n = (one.values.to_numpy()[cuts[0]:cuts[-1]] for one in lists)
    x[np.repeat(np.arange(got.num_rows), np.diff(cuts)), bucket] = n
    total = np.maximum(x.sum(axis=1), 1)
    x /= total[:, None]
    y = np.array([labels.index(n) for n in names])
    x, y, total = x[order], y[order], total[order]
    held = np.arange(len(y)) % 5 == 4
    if held.sum() < 2 or len(y) < 10:
        held[:] = False
    train = np.flatnonzero(~held)
    rng = np.random.default_rng(seed)
    e = rng.normal(0, 0.1, (buckets, dim)).astype(np.float32)
    w = rng.normal(0, 0.1, (dim, len(labels))).astype(np.float32)
    b = np.zeros(len(labels), np.float32)
    for k in range(steps):
        step, own = rate * (1 - k / steps), rng.choice(train, 32)
        xb, yb = x[own], y[own]
        v = xb @ e
        z = v @ w + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(yb)), yb] -= 1
        p /= len(yb)
        dv = p @ w.T
        w -= step * 0.1 * (v.T @ p)
        b -= step * 0.01 * p.sum(axis=0)
        e -= step * (xb.T @ dv)
    use = held if held.any() else ~held
    z = ((x[use] @ e) @ w + b).astype(np.float64)

    def scores(t):
        p = np.exp((z - z.max(axis=1, keepdims=True)) / t)
        return p / p.sum(axis=1, keepdims=True)

    right = np.arange(use.sum()), y[use]
    t = min(np.geomspace(0.25, 8, 41), key=lambda t: -np.log(scores(t)[right] + 1e-12).mean())
    p = scores(t)
    ok = p.argmax(axis=1) == y[use]
    # each label's smoothed shares of the buckets in training
    own = [train[y[train] == i] for i in range(len(labels))]
    share = np.array([total[k] @ x[k] if len(k) else np.zeros(buckets) for k in own], np.float64).T + 0.5
    share /= share.sum(axis=0)
    usual = -(share * np.log(share)).sum(axis=0)
    surprise = -np.log(share) - usual
    spread = np.sqrt((share * surprise ** 2).sum(axis=0))
    low, novel = 0.0, float("inf")
    if held.any() and ok.any():  # else nothing to calibrate by: all is accepted
        top = np.clip(p.max(axis=1)[ok], 1e-12, 1 - 1e-12)
        low = float(1 / (1 + np.exp(-_lower_tail(np.log(top / (1 - top)), max_reject / 2))))
        i = y[use][ok]
        mean = (x[use] @ surprise)[ok][np.arange(len(i)), i]
        novel = -_lower_tail(-(mean - _chance(spread[i], total[use][ok])), max_reject / 2)
    return Model(labels, (e.astype(np.float64) @ w.astype(np.float64)) / t, b.astype(np.float64) / t, low, surprise, spread, novel)


def identify(c: Column, model: Model | None) -> Column:
    """Column of structs: ``lang`` (``und`` for null or a text without a letter), ``score`` (0 to 1, then 0), ``accepted``."""
    none = F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score"), F.lit(False).alias("accepted"))
    if model is None:
        return none

    @F.arrow_udf("struct<lang:string,score:double,accepted:boolean>")
    def predict(a: pa.Array) -> pa.Array:
        got = [model.predict(raw) if raw else (UNKNOWN, 0.0, False) for raw in utf8(a)]
        return pa.StructArray.from_arrays([pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()),
                                           pa.array([g[2] for g in got], pa.bool_())], names=["lang", "score", "accepted"])

    return F.when(c.rlike(LETTER), predict(c)).otherwise(none)


def accepted_documents(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """The rows whose language the model accepts; without a model (no label anywhere) all rows stay."""
    if model is None:
        return docs
    name = "__language"
    return docs.withColumn(name, identify(col(text).cast("string"), model)).where(F.col(f"{name}.accepted")).drop(name)
