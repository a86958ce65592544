"""Language identification with error-correcting output codes.

Each language gets a codeword. For each bit a linear classifier over hashed letter n-grams (one to
four bytes within words, with the word's edges) learns the languages' bits; a text's margins are
then compared with every codeword by the logistic loss, each bit weighted by how well it was
learned, and the nearest codeword wins. A text whose two nearest codewords are close is ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, remainder, written
from .fits import Adam, fitted, sigmoid
from .textbytes import LOWER, U, mixed, text_chunks, trimmed

BITS = 13  # of n-gram slots
SAMPLE = 1_000  # most rows of each language that the fit sees
ROWS = 4_000  # about the rows of a fit: many languages get fewer rows each,
LEAST = 4  # but so many at least, of every language there is
MARGIN = 0.1  # a text whose winner leads by less is ambiguous

_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[128:] = True
#: A text has a letter if this finds one (any script).
HAS_LETTER = r"\p{L}"


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """n codewords of +1 and -1: random balanced bits, the best of many draws by least distance, and
    for few languages one bit for each against the rest. Many languages get longer words instead of
    draws, of which no two are alike."""
    if n < 2:
        return np.ones((n, 1))
    rng = np.random.default_rng(seed)
    if n > 64:
        width = 6 * int(np.ceil(np.log2(n)))
        while True:
            c = np.array([rng.permutation(np.where(np.arange(n) < n // 2, 1, -1)) for _ in range(width)]).T
            if len(np.unique(c, axis=0)) == n:
                return c.astype(float)
    width = max(3, 2 * int(np.ceil(np.log2(n))))
    best, far = None, -1.0
    for _ in range(200):
        c = np.array([rng.permutation(np.where(np.arange(n) < n // 2, 1, -1)) for _ in range(width)]).T
        d = (c[:, None] != c[None]).sum(2) + n * np.eye(n)
        if d.min() > far:
            best, far = c, d.min()
    own = 2 * np.eye(n) - 1 if n <= 16 else np.empty((n, 0))
    return np.concatenate([own, best], axis=1).astype(float)


def gram_slots(buf: np.ndarray, off: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(slot of each n-gram, its byte position), n-grams of one to four bytes of the lower-case
    text with other bytes than letters as one blank; an n-gram may have blanks at its ends only."""
    low = LOWER[buf]
    code = np.where(_LETTER[low], low, 32).astype(U)
    n = len(code)
    at, slots = [], []
    gram = np.zeros(n, U)
    for k in range(1, 5):
        gram = (gram[: max(0, n - k + 1)] << U(8)) | code[k - 1 : n] if k > 1 else code
        if not len(gram):
            break
        ok = code[: len(gram)] != 32 if k == 1 else np.ones(len(gram), bool)
        if k > 2:
            blank = np.concatenate(([0], np.cumsum(code == 32)))
            ok &= blank[k - 1 : n] - blank[1 : n - k + 2] == 0
        p = np.flatnonzero(ok)
        slots.append((mixed(gram[p] + U(k << 40)) >> U(64 - bits)).astype(np.int32))
        at.append(p)
    return np.concatenate(slots) if slots else np.empty(0, np.int32), np.concatenate(at) if at else np.empty(0, np.int64)


def gram_means(buf: np.ndarray, off: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The mean over each text's n-grams of the table's rows. N-grams that run over the end of a
    text are few and count for the text they begin in."""
    n = len(off) - 1
    out = np.zeros((n, table.shape[1]))
    count = np.zeros(n)
    slots, at = gram_slots(buf, off)
    if len(slots):
        cut = np.flatnonzero(np.diff(at) < 0) + 1
        for s, p in zip(np.split(slots, cut), np.split(at, cut), strict=True):
            first = np.searchsorted(p, off)
            full = np.diff(first) > 0
            for k in range(table.shape[1]):
                out[full, k] += np.add.reduceat(table[s, k], first[:-1][full])
            count += np.diff(first)
    return out / np.maximum(count, 1)[:, None]


def fit_on(docs: DataFrame, *, id_col="doc_id", text_col="text", lang_col="lang", divisor: int = 4, held: int = 2, sample: int = SAMPLE, rows: int = ROWS) -> dict | None:
    """The model of all languages of the rows that may be learned from."""
    ids = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang")).filter("id is not null and lang is not null")
    ids = ids.filter(remainder(F.col("id"), divisor) != held).distinct()
    known = written(ids.groupBy("lang").count(), "langs")
    sample = min(sample, max(LEAST, rows // max(1, known.count())))
    # the least keys of each language: a threshold on the hash, from the counts, then an exact cut
    ids = ids.withColumn("k", F.crc32(F.concat(F.lit("lang:"), F.col("id").cast("string"))))
    near = ids.join(known, "lang").filter(F.col("k") <= F.lit(2.0**32) * 4 * sample / F.col("count"))
    chosen = near.groupBy("lang").agg(F.slice(F.sort_array(F.collect_list(F.struct("k", "id"))), 1, sample).alias("c")).select("lang", F.explode("c.id").alias("id"))
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text is not null")
    texts = d.join(F.broadcast(chosen), "id").select("lang", "text")  # at most languages * sample ids

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, buf, off in text_chunks(batch["text"]):
                got = []
                for i, j in zip(off[:-1], off[1:], strict=True):
                    s, _ = gram_slots(buf[i:j], np.array([0, j - i]))
                    u, c = np.unique(s, return_counts=True)
                    got.append((u.astype(np.uint16).tobytes(), (c / max(1, c.sum())).astype(np.float32).tobytes()))
                yield pa.RecordBatch.from_arrays([batch["lang"][a:b], pa.array([x for x, _ in got], pa.binary()), pa.array([x for _, x in got], pa.binary())], ["lang", "slot", "share"])

    return fitted(texts.mapInArrow(trimmed(counts), "lang string, slot binary, share binary"), fit)


def fit(got: dict[str, list]) -> dict:
    """One linear classifier for each bit of the codewords, on rows of (slot, share) by language."""
    rows = sorted(zip(got["lang"], got["slot"], got["share"], strict=True))  # whatever order they came in
    langs = sorted(set(got["lang"]))
    index = {x: i for i, x in enumerate(langs)}
    grams = [(np.frombuffer(s, np.uint16), np.frombuffer(v, np.float32)) for _, s, v in rows]
    y = np.array([index[x] for x, *_ in rows])
    code = codewords(len(langs))
    target = (code[y] + 1) / 2
    weight = (1 / np.bincount(y)[y])[:, None] / len(langs)
    total, square = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for s, v in grams:
        total[s] += v
        square[s] += v.astype(np.float64) ** 2
    mean = total / len(rows)
    scale = (1 / (np.sqrt(np.maximum(square / len(rows) - mean**2, 0)) + 1e-4)).astype(np.float32)

    def batch(at: np.ndarray) -> np.ndarray:
        x = np.zeros((len(at), 1 << BITS), np.float32)
        for r, i in enumerate(at.tolist()):
            s, v = grams[i]
            x[r, s] = v * scale[s]
        return x

    p = {"w": np.zeros((1 << BITS, code.shape[1]), np.float32), "b": np.zeros(code.shape[1], np.float32)}
    adam, rng = Adam(0.02), np.random.default_rng(0)
    for _ in range(12):
        for i in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // 128)):
            xs = batch(i)
            e = ((sigmoid(xs @ p["w"] + p["b"]) - target[i]) * weight[i] * len(rows) / len(i)).astype(np.float32)
            adam.step(p, {"w": xs.T @ e + 1e-4 * p["w"], "b": e.sum(0)})
    margins = np.concatenate([batch(i) @ p["w"] + p["b"] for i in np.array_split(np.arange(len(rows)), max(1, len(rows) // 512))])
    right = np.clip((weight * ((margins > 0) == (target > 0.5))).sum(0), 0.5, 0.999)
    return {"langs": langs, "code": code, "w": (p["w"] * scale[:, None]).astype(np.float32), "b": p["b"], "bit": np.log(right / (1 - right)) + 1e-3}


def decoded(model: dict, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(share of each language, order of languages by loss): softmax of minus the weighted loss."""
    one = model["code"] > 0
    loss = (np.logaddexp(0, -margins) * model["bit"]) @ one.T + (np.logaddexp(0, margins) * model["bit"]) @ ~one.T
    share = np.exp(loss.min(1, keepdims=True) - loss)
    return share / share.sum(1, keepdims=True), np.argsort(loss, axis=1, kind="stable")


def languages(docs: DataFrame, *, id_col="doc_id", text_col="text", lang_col="lang", divisor: int = 4, held: int = 2, margin: float = MARGIN, **options) -> DataFrame:
    """Per row of docs: doc_id, held_out, lang_pred, score, ambiguous.

    Null, empty and letterless texts are ``und`` with score 0; so is everything where no row has a
    language. With one language all texts with letters are that one."""
    model = fit_on(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, divisor=divisor, held=held, **options)
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.col(text_col).rlike(HAS_LETTER), F.lit(False)).alias("letters"))
    held_out = F.coalesce(remainder(F.col("doc_id"), divisor) == held, F.lit(False)).alias("held_out")
    if model is None:
        return d.select("doc_id", held_out, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("ambiguous"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 1 << BITS rows of the code's width, and a word for each language

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array([*m["langs"], "und"], object)
        for batch in batches:
            letters = batch["letters"].to_numpy(zero_copy_only=False)
            for a, b, buf, off in text_chunks(batch["text"]):
                share, order = decoded(m, gram_means(buf, off, m["w"]) + m["b"])
                rows = np.arange(b - a)
                top = share[rows, order[:, 0]]
                lead = top - (share[rows, order[:, 1]] if share.shape[1] > 1 else 0)
                ok = letters[a:b]
                yield pa.RecordBatch.from_arrays([batch["doc_id"][a:b], pa.array(names[np.where(ok, order[:, 0], len(names) - 1)], pa.string()), pa.array(np.where(ok, top, 0.0)), pa.array(ok & (lead < margin))], ["doc_id", "lang_pred", "score", "ambiguous"])

    out = d.mapInArrow(trimmed(predict), f"doc_id {dict(d.dtypes)['doc_id']}, lang_pred string, score double, ambiguous boolean")
    return out.select("doc_id", held_out, "lang_pred", "score", "ambiguous")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(read(spark, sf_dir, "documents"))
