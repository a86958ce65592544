"""Quality classifier by positive-unlabelled learning.

Trusted positives are rows labelled 1; all other sampled rows are unlabelled web text. A small
network over shape features of the text minimises the non-negative unbiased risk
prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives)), with the class prior
estimated from the share of unlabelled rows that a first classifier scores below all but a few
positives. Rows labelled 0 are never used as negatives.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, remainder
from .fits import Adam, sigmoid
from .textbytes import IS_SPACE, LOWER, prefix_hash, run_index, sorted_distinct, span_hash, text_chunks, trimmed, word_spans

SAMPLE = 8_000  # most positives, and most unlabelled rows, that the fit sees
HIDDEN = 24
CUT = 0.7
N_FEATURES = 22

_KIND = np.zeros((256, 7), bool)  # letter, upper, digit, symbol, end mark, other mark, bar
_KIND[97:123, 0] = _KIND[65:91, 0] = _KIND[128:, 0] = True
_KIND[65:91, 1] = True
_KIND[48:58, 2] = True
_KIND[[ord(c) for c in "#*$%&<>@^~=+_{}[]\\"], 3] = True
_KIND[[ord(c) for c in ".!?"], 4] = True
_KIND[[ord(c) for c in ",;:'\"()-/"], 5] = True
_KIND[[ord("|")], 6] = True


def shape_features(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A row of N_FEATURES rates for each text, whatever its length."""
    n = len(off) - 1
    out = np.zeros((n, N_FEATURES))
    starts, ends, first = word_spans(buf, off)
    doc = run_index(first)
    words = np.diff(first)
    some = np.maximum(words, 1)
    size = np.maximum(off[1:] - off[:-1], 1)
    rates = lambda mask, by: np.diff(np.concatenate(([0], np.cumsum(mask)))[off]) / by
    for k in range(7):
        out[:, k] = rates(_KIND[buf, k], size)
    letters = np.maximum(out[:, 0] * size, 1)
    out[:, 1] = out[:, 1] * size / letters  # upper case among letters
    out[:, 7] = rates(buf == 33, some)  # exclamation marks by word
    per = lambda flags: np.bincount(doc, flags, n) / some
    length = ends - starts
    out[:, 8] = per(length) / 10
    if len(starts):
        last, head = buf[ends - 1], buf[starts]
        out[:, 9] = per(_KIND[last, 3])  # words that end in a symbol
        out[:, 10] = per((length == 1) & _KIND[head, 6])  # table bars
        out[:, 11] = per(_KIND[head, 1])
        h = span_hash(prefix_hash(LOWER[buf]), starts, ends)
        same = np.zeros(len(h), bool)
        same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
        out[:, 12] = per(same)  # a word right after itself
        distinct, at = sorted_distinct(h, first)
        out[:, 13] = np.diff(at) / some
        out[:, 14] = np.diff(at) / np.sqrt(some) / 10
        pair = h[:-1] * np.uint64(3) + h[1:]
        inside = doc[1:] == doc[:-1]
        pf = np.concatenate(([0], np.cumsum(inside)))[np.minimum(first, len(inside))]
        two, pat = sorted_distinct(pair[inside], pf)
        out[:, 15] = np.diff(pat) / np.maximum(words - 1, 1)
        out[:, 16] = per(length > 20)
        out[:, 17] = per(length < 3)
        upper = np.concatenate(([0], np.cumsum(_KIND[buf, 1])))
        out[:, 18] = per((upper[ends] - upper[starts] > 1))
    out[:, 19] = np.log1p(words) / 8
    lines = np.diff(np.concatenate(([0], np.cumsum(buf == 10)))[off])
    out[:, 20] = lines / some
    out[:, 21] = rates(IS_SPACE[buf], size)
    return out


def _forward(p: dict, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = np.tanh(x @ p["a"] + p["b"])
    return h @ p["c"] + p["d"], h


def _gradient(p: dict, x: np.ndarray, h: np.ndarray, e: np.ndarray) -> dict:
    back = (e[:, None] * p["c"]) * (1 - h * h)
    return {"a": x.T @ back, "b": back.sum(0), "c": h.T @ e, "d": e.sum()}


def fit_nnpu(pos: np.ndarray, unl: np.ndarray, prior: float, *, rounds: int = 60, batch: int = 512, seed: int = 0) -> dict:
    """Minimises the non-negative risk with the sigmoid loss l(g, y) = 1 / (1 + exp(y g)). Where
    the estimate of the negatives' risk falls below zero, the step goes against it instead."""
    rng = np.random.default_rng(seed)
    k = pos.shape[1]
    p = {"a": rng.normal(0, 1 / np.sqrt(k), (k, HIDDEN)), "b": np.zeros(HIDDEN), "c": rng.normal(0, 0.3, HIDDEN), "d": np.zeros(())}
    adam = Adam(0.005)
    n = max(1, max(len(pos), len(unl)) // batch)
    for _ in range(rounds):
        for i, j in zip(np.array_split(rng.permutation(len(pos)), n), np.array_split(rng.permutation(len(unl)), n), strict=True):
            xp, xu = pos[i], unl[j]
            (gp, hp), (gu, hu) = _forward(p, xp), _forward(p, xu)
            sp, su = sigmoid(gp), sigmoid(gu)
            negative = su.mean() - prior * sp.mean()
            dn = {m: a - b for (m, a), b in zip(_gradient(p, xu, hu, su * (1 - su) / len(gu)).items(), _gradient(p, xp, hp, prior * sp * (1 - sp) / len(gp)).values(), strict=True)}
            if negative >= 0:
                dp = _gradient(p, xp, hp, -prior * sp * (1 - sp) / len(gp))
                grads = {m: dp[m] + dn[m] for m in dp}
            else:
                grads = {m: -g for m, g in dn.items()}
            adam.step(p, {m: g + 1e-4 * p[m] for m, g in grads.items()})
    return p


def estimated_prior(pos: np.ndarray, unl: np.ndarray, seed: int = 0) -> float:
    """The share of positives among the unlabelled: a classifier of positive against unlabelled is
    fitted on one half of each; in the other halves, the least ratio over all cuts of (unlabelled
    above the cut) to (positives above it), with cuts that a tenth of the positives pass at least."""
    rng = np.random.default_rng(seed)
    i, j = rng.permutation(len(pos)), rng.permutation(len(unl))
    a, b = i[::2], j[::2]
    p = fit_nnpu(pos[a], unl[b], 0.5, rounds=20, seed=seed)
    gp, gu = np.sort(_forward(p, pos[i[1::2]])[0]), np.sort(_forward(p, unl[j[1::2]])[0])
    if not len(gp) or not len(gu):
        return 0.5
    cuts = np.quantile(gp, np.linspace(0.01, 0.9, 90))
    above = lambda g: 1 - np.searchsorted(g, cuts) / len(g)
    return float(np.clip((above(gu) / np.maximum(above(gp), 1e-9)).min(), 0.05, 0.98))


def sample_rows(docs: DataFrame, labels: DataFrame, label: str, id_col: str, text_col: str, divisor: int, held: int, most: int) -> DataFrame:
    """(positive, text): at most ``most`` rows labelled 1 and ``most`` others, outside the held-out
    remainder, those with the least md5 of their id. Only ids are sorted; a label's value is read
    for positives alone."""
    ids = docs.select(F.col(id_col).alias("id")).filter(F.col("id").isNotNull() & (remainder(F.col("id"), divisor) != held)).distinct()
    good = labels.filter(F.col(label) == 1).select(F.col(id_col).alias("id")).distinct().withColumn("positive", F.lit(1))
    ids = ids.join(good, "id", "left").withColumn("k", F.md5(F.col("id").cast("string")))
    pos = ids.filter("positive = 1").orderBy("k", "id").limit(most)
    unl = ids.filter("positive is null").orderBy("k", "id").limit(most)
    chosen = pos.unionByName(unl).select("id", F.coalesce("positive", F.lit(0)).alias("positive"))
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text is not null")
    return d.join(F.broadcast(chosen), "id").select("positive", "text")  # at most 2 * most ids


def fit_on(docs: DataFrame, labels: DataFrame, *, label="quality", id_col="doc_id", text_col="text", divisor: int = 4, held: int = 2, sample: int = SAMPLE) -> dict | None:
    rows = sample_rows(docs, labels, label, id_col, text_col, divisor, held, sample)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, buf, off in text_chunks(batch["text"]):
                yield pa.RecordBatch.from_arrays([batch["positive"][a:b], pa.array(list(shape_features(buf, off)), pa.list_(pa.float64()))], ["positive", "x"])

    got = rows.mapInArrow(trimmed(features), "positive int, x array<double>").toArrow()
    if not len(got):
        return None
    x = np.stack(got["x"].to_numpy(zero_copy_only=False))
    y = got["positive"].to_numpy()
    order = np.lexsort((*x.T, y))
    x, y = x[order], y[order]
    if y.min() == y.max():
        return None

    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = np.clip((x - mean) / scale, -4, 4)
    pos, unl = z[y == 1], z[y == 0]
    prior = estimated_prior(pos, unl)
    return fit_nnpu(pos, unl, prior) | {"mean": mean, "scale": scale, "prior": prior}


def quality(docs: DataFrame, labels: DataFrame, *, id_col="doc_id", text_col="text", divisor: int = 4, held: int = 2, cut: float = CUT, **options) -> DataFrame:
    """Per row of docs: doc_id, held_out, score (0 to 1), predicted (score >= cut).

    Null and empty texts score as texts without words; repeated rows score alike; without positives
    or without unlabelled rows all scores are 0. Labels of null ids are not used."""
    model = fit_on(docs, labels, id_col=id_col, text_col=text_col, divisor=divisor, held=held, **options)
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    if model is None:
        out = d.select("doc_id", F.lit(0.0).alias("score"))
    else:

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a, b, buf, off in text_chunks(batch["text"]):
                    z = np.clip((shape_features(buf, off) - model["mean"]) / model["scale"], -4, 4)
                    yield pa.RecordBatch.from_arrays([batch["doc_id"][a:b], pa.array(sigmoid(_forward(model, z)[0]))], ["doc_id", "score"])

        out = d.mapInArrow(trimmed(score), f"doc_id {dict(d.dtypes)['doc_id']}, score double")
    return out.select("doc_id", F.coalesce(remainder(F.col("doc_id"), divisor) == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
