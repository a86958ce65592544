"""Toxicity: a factorization machine over hashed terms.

Terms are the distinct words of a text (letters, lower case) and the openings of longer words,
hashed to ``1 << bits`` slots. The machine scores w0 + sum w[i] + sum over pairs <v[i], v[j]>, so a
pair of terms counts beyond what each says alone. Texts of any length keep every term, and its weight
does not shrink with the text. Every term of LEAST_ROWS rows has a weight and a vector; terms whose
own rates do not tell the classes apart start from a weight of zero, and small steps regularise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, remainder
from .fits import calibrated, fitted, sigmoid
from .textbytes import LOWER, U, prefix_hash, run_index, sorted_distinct, span_hash, text_chunks, trimmed

BITS = 20
RANK = 4
OPENINGS = (4, 5)  # code units of the openings of longer words
SAMPLE = 8_000  # most labelled rows of each class that the fit sees
LEAST_ROWS = 3  # of the sample, for a term to have a weight
LEAST_G2 = 20.0  # log-likelihood ratio beyond which a term's weight starts from its log odds
CUT = 0.7

_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[128:] = True  # parts of letters beyond ASCII


def term_slots(buf: np.ndarray, off: np.ndarray, bits: int = BITS, openings=OPENINGS) -> tuple[np.ndarray, np.ndarray]:
    """The distinct slots of each text, sorted, and the texts' offsets among them."""
    low = LOWER[buf]
    inside = _LETTER[low]
    edge = np.zeros(len(buf) + 1, bool)
    edge[off] = True
    before = np.concatenate(([False], inside[:-1])) & ~edge[:-1] if len(buf) else inside
    after = np.concatenate((inside[1:], [False])) & ~edge[1:] if len(buf) else inside
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    doc = np.searchsorted(off, starts, "right") - 1
    s = prefix_hash(low)
    at, of = [span_hash(s, starts, ends)], [doc]
    for k in openings:
        long = ends - starts > k
        a = starts[long]
        at.append(span_hash(s, a, a + k) + U(k))
        of.append(doc[long])
    doc, slot = np.concatenate(of), np.concatenate(at) >> U(64 - bits)
    order = np.argsort(doc, kind="stable")
    first = np.searchsorted(doc[order], np.arange(len(off)))
    return sorted_distinct(slot[order].astype(np.int64), first)


def fit(slots: list[np.ndarray], y: np.ndarray, *, bits: int = BITS, rank: int = RANK, rounds: int = 6, seed: int = 0) -> dict:
    """Fits by AdaGrad over shuffled batches, with an L1 proximal step on w and L2 on v; terms in
    fewer than LEAST_ROWS rows take no part. Classes weigh alike; then Platt scaling on the rows
    themselves puts the scores on the scale of the label."""
    rng = np.random.default_rng(seed)
    count = np.bincount(np.concatenate([*slots, np.empty(0, np.int64)]).astype(np.int64), minlength=1 << bits)
    kept = np.flatnonzero(count >= LEAST_ROWS)
    place = np.full(1 << bits, -1, np.int32)
    place[kept] = np.arange(len(kept))
    rows = [r[r >= 0] for r in (place[s] for s in slots)]
    # start from how far each term's rate differs between the classes: a smoothed log odds, kept
    # only where it is beyond chance, so that terms of no class begin at zero
    n1, n0 = max(1, y.sum()), max(1, (1 - y).sum())
    seen1 = np.bincount(np.concatenate([*[r for r, t in zip(rows, y, strict=True) if t], np.empty(0, np.int64)]).astype(np.int64), minlength=len(kept))
    seen0 = count[kept] - seen1
    p1, p0 = (seen1 + 0.5) / (n1 + 1), (seen0 + 0.5) / (n0 + 1)
    share = n1 / (n1 + n0)
    part = lambda seen, expected: np.where(seen > 0, seen * np.log(np.maximum(seen, 1) / expected), 0.0)
    g2 = 2 * (part(seen1, (seen1 + seen0) * share) + part(seen0, (seen1 + seen0) * (1 - share)))
    w = np.where(g2 > LEAST_G2, np.clip(np.log(p1 / p0), -3, 3), 0.0)
    v = rng.normal(0, 0.02, (len(kept), rank))
    w0 = -1.0
    gw, gv, g0 = np.full(len(kept), 1e-2), np.full((len(kept), rank), 1e-2), 1e-2
    weight = np.where(y > 0, 0.5 / n1, 0.5 / n0) * len(y)
    for _ in range(rounds):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), 64):
            batch = order[at : at + 64]
            idx = np.concatenate([rows[i] for i in batch])
            first = np.concatenate(([0], np.cumsum([len(rows[i]) for i in batch])))
            b = run_index(first)
            x = v[idx]
            sums = np.zeros((len(batch), rank))
            np.add.at(sums, b, x)
            raw = w0 + np.bincount(b, w[idx], len(batch)) + 0.5 * ((sums**2).sum(1) - np.bincount(b, (x**2).sum(1), len(batch)))
            e = (sigmoid(raw) - y[batch]) * weight[batch]
            g0 += e.sum() ** 2
            w0 -= 0.3 * e.sum() / np.sqrt(g0)
            u, where = np.unique(idx, return_inverse=True)
            d = np.bincount(where, e[b], len(u))
            dv = np.zeros((len(u), rank))
            np.add.at(dv, where, e[b][:, None] * (sums[b] - x))
            dv += 1e-3 * v[u]
            gw[u] += d**2
            gv[u] += dv**2
            step = 0.01 / np.sqrt(gw[u])
            w[u] -= step * d
            w[u] = np.sign(w[u]) * np.maximum(np.abs(w[u]) - step * 1e-3, 0)
            v[u] -= 0.01 / np.sqrt(gv[u]) * dv
    table = np.zeros((1 << bits, rank + 1), np.float32)
    table[kept, 0], table[kept, 1:] = w, v
    model = {"bits": bits, "w0": float(w0), "slots": np.flatnonzero(np.any(table != 0, axis=1)), "a": 1.0, "b": 0.0}
    model["weights"] = table[model["slots"]]
    raw = np.array([raw_scores(s, np.array([0, len(s)]), table, w0)[0] for s in slots])
    model["a"], model["b"] = calibrated(raw, y)
    return model


def raw_scores(slot: np.ndarray, first: np.ndarray, table: np.ndarray, w0: float) -> np.ndarray:
    sums = np.zeros((len(first) - 1, table.shape[1]))
    squares = np.zeros(len(first) - 1)
    x = table[slot].astype(np.float64)
    full = first[1:] > first[:-1]
    if len(x):
        sums[full] = np.add.reduceat(x, first[:-1][full], axis=0)
        squares[full] = np.add.reduceat((x[:, 1:] ** 2).sum(1), first[:-1][full])
    return w0 + sums[:, 0] + 0.5 * ((sums[:, 1:] ** 2).sum(1) - squares)


def sample_rows(docs: DataFrame, labels: DataFrame, label: str, *, id_col="doc_id", text_col="text", divisor: int, held: int, most: int) -> DataFrame:
    """(y, text) of labelled rows outside the held-out remainder, at most ``most`` of each class,
    those with the least md5 of their id. Only ids are sorted; texts join the chosen few."""
    ids = labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("y")).filter("y in (0, 1) and id is not null").distinct()
    ids = ids.filter(remainder(F.col("id"), divisor) != held).withColumn("k", F.md5(F.col("id").cast("string")))
    chosen = ids.filter("y = 1").orderBy("k", "id").limit(most).unionByName(ids.filter("y = 0").orderBy("k", "id").limit(most))
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text is not null")
    return d.join(F.broadcast(chosen.select("id", "y")), "id").select("y", "text")  # at most 2 * most ids


def fit_on(docs: DataFrame, labels: DataFrame, *, label="toxic", id_col="doc_id", text_col="text", divisor: int = 3, held: int = 1, sample: int = SAMPLE, bits: int = BITS, rank: int = RANK) -> dict | None:
    rows = sample_rows(docs, labels, label, id_col=id_col, text_col=text_col, divisor=divisor, held=held, most=sample)

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, buf, off in text_chunks(batch["text"]):
                s, first = term_slots(buf, off, bits)
                got = [s[i:j].astype(np.int32) for i, j in zip(first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch["y"][a:b], pa.array([x.tobytes() for x in got], pa.binary())], ["y", "slots"])

    def model(got: dict[str, list]) -> dict | None:
        if len(set(got["y"])) < 2:
            return None
        both = sorted(zip(got["y"], got["slots"], strict=True))  # whatever order the rows came in
        return fit([np.frombuffer(x, np.int32) for _, x in both], np.array([y for y, _ in both], float), bits=bits, rank=rank)

    return fitted(rows.mapInArrow(trimmed(slots), "y int, slots binary"), model)


def score_with(docs: DataFrame, model: dict | None, *, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id and score of every row; 0 where no model could be fitted (fewer than two classes)."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    if model is None:
        return d.select("doc_id", F.lit(0.0).alias("score"))
    held = docs.sparkSession.sparkContext.broadcast(model)  # at most 1 << bits rows of rank + 1 floats

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        table = np.zeros((1 << m["bits"], m["weights"].shape[1]), np.float32)
        table[m["slots"]] = m["weights"]
        known = np.zeros(1 << m["bits"], bool)
        known[m["slots"]] = True
        for batch in batches:
            for a, b, buf, off in text_chunks(batch["text"]):
                s, first = term_slots(buf, off, m["bits"])
                live = known[s]
                count = np.concatenate(([0], np.cumsum(live)))
                raw = raw_scores(s[live], count[first], table, m["w0"])
                yield pa.RecordBatch.from_arrays([batch["doc_id"][a:b], pa.array(sigmoid(m["a"] * raw + m["b"]))], ["doc_id", "score"])

    kind = dict(d.dtypes)["doc_id"]
    return d.mapInArrow(trimmed(score), f"doc_id {kind}, score double")


def toxicity(docs: DataFrame, labels: DataFrame, *, id_col="doc_id", text_col="text", divisor: int = 3, held: int = 1, cut: float = CUT, **options) -> DataFrame:
    """Per row of docs: doc_id, held_out, score (0 to 1), predicted (score >= cut).

    Null and empty texts score as a text without terms; repeated rows score alike; with labels of
    fewer than two classes all scores are 0. Labels of null ids are not used."""
    model = fit_on(docs, labels, id_col=id_col, text_col=text_col, divisor=divisor, held=held, **options)
    out = score_with(docs, model, id_col=id_col, text_col=text_col)
    return out.select("doc_id", F.coalesce(remainder(F.col("doc_id"), divisor) == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
