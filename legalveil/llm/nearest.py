"""Approximate nearest neighbours by largest inner product.

Vectors are product-quantised with four-bit codes by the score-aware anisotropic loss: the residual
parallel to the vector costs ``eta`` times as much as the orthogonal one, since it is what moves
large inner products. A query block scans blocks of codes with its tables of 16 entries per
subspace and keeps the best of each block; those are scored exactly on the original vectors.

The codebooks come from a bounded sample; every vector is coded and scanned. Queries are cut into
blocks and meet all blocks of vectors, each vector block once per query block; the best per block
are merged by a ranked window over at most (blocks x k) rows of a query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions, read, written
from .textbytes import trimmed

K = 20
EVERY = 20
WIDTH = 2  # components of a subspace
SAMPLE = 8_192  # vectors that the codebooks are fitted on
ROUNDS = 8
QUERY_BLOCK = 2_048
VECTOR_BLOCK = 4_096
RERANK = 128  # of a block, by table scores, that are scored exactly for each query
THRESHOLD = 0.2  # the cosine at which scores begin to matter, as in score-aware losses


def eta(dim: int, threshold: float = THRESHOLD) -> float:
    """The weight of the parallel residual over the orthogonal one."""
    return max(1.0, (dim - 1) * threshold**2 / (1 - threshold**2))


def fit_codebooks(x: np.ndarray, width: int = WIDTH, rounds: int = ROUNDS, seed: int = 0) -> np.ndarray:
    """(subspaces, 16, width) centres: k-means first, then alternating anisotropic updates, in which
    each centre minimises sum over its points of (x - c)' (I + (eta - 1) u u') (x - c), u being the
    point's part of its unit vector with the other subspaces' residuals held at zero."""
    rng = np.random.default_rng(seed)
    n, dim = x.shape
    m = dim // width
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    h = eta(dim) - 1
    books = np.zeros((m, 16, width))
    for s in range(m):
        part, u = x[:, s * width : (s + 1) * width], unit[:, s * width : (s + 1) * width]
        c = part[rng.choice(n, 16, replace=n < 16)].copy()
        for r in range(rounds):
            aniso = h if r >= rounds // 2 else 0.0
            d = part[:, None] - c[None]
            cost = (d**2).sum(2) + aniso * (d * u[:, None]).sum(2) ** 2
            own = cost.argmin(1)
            for j in range(16):
                p, q = part[own == j], u[own == j]
                if len(p):
                    a = len(p) * np.eye(width) + aniso * q.T @ q
                    c[j] = np.linalg.solve(a, p.sum(0) + aniso * q.T @ (q * p).sum(1))
                else:
                    c[j] = part[rng.integers(n)]
        books[s] = c
    return books


def encode(x: np.ndarray, books: np.ndarray, passes: int = 2) -> np.ndarray:
    """Codes (n, subspaces) by coordinate descent on the whole vector's anisotropic loss."""
    n, dim = x.shape
    m, _, width = books.shape
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    h = eta(dim) - 1
    parts, us = x.reshape(n, m, width), unit.reshape(n, m, width)
    square = np.stack([((parts[:, s, None] - books[s]) ** 2).sum(2) for s in range(m)], 1)
    along = np.stack([np.einsum("nkw,nw->nk", parts[:, s, None] - books[s], us[:, s]) for s in range(m)], 1)
    code = square.argmin(2)
    rows = np.arange(n)
    total = np.take_along_axis(along, code[:, :, None], 2)[:, :, 0].sum(1)
    for _ in range(passes):
        for s in range(m):
            rest = total - along[rows, s, code[:, s]]
            best = (square[:, s] + h * (rest[:, None] + along[:, s]) ** 2).argmin(1)
            total = rest + along[rows, s, best]
            code[:, s] = best
    return code.astype(np.uint8)


def packed(code: np.ndarray) -> np.ndarray:
    """Two four-bit codes a byte."""
    if code.shape[1] % 2:
        code = np.concatenate([code, np.zeros((len(code), 1), np.uint8)], 1)
    return code[:, ::2] | (code[:, 1::2] << 4)


def scan(queries: np.ndarray, books: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Table scores (queries, vectors): two subspaces a lookup, from tables of 16 x 16 sums."""
    m, _, width = books.shape
    tables = np.einsum("qmw,mkw->mkq", queries.reshape(len(queries), m, width), books).astype(np.float32)
    if m % 2:
        tables = np.concatenate([tables, np.zeros((1, 16, len(queries)), np.float32)])
    out = np.zeros((code.shape[0], len(queries)), np.float32)
    for j in range(code.shape[1]):
        pair = (tables[2 * j][None, :, :] + tables[2 * j + 1][:, None, :]).reshape(256, -1)
        out += pair[code[:, j]]
    return out.T


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, x array<double>) of vectors that take part: not null, without null or non-finite
    components, not zero."""
    x = F.col(vec_col).cast("array<double>")
    d = df.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x")).filter("vec_id is not null and x is not null and size(x) > 0")
    return d.filter("forall(x, c -> c is not null and not isnan(c) and abs(c) < double('infinity')) and exists(x, c -> c != 0)")


def nearest(vectors: DataFrame, *, id_col="vec_id", vec_col="embedding", k: int = K, every: int = EVERY, queries: DataFrame | None = None,
            width: int = WIDTH, sample: int = SAMPLE, query_block: int = QUERY_BLOCK, vector_block: int = VECTOR_BLOCK, rerank: int = RERANK) -> DataFrame:
    """query_id, rank, vec_id, score: for each query its k nearest other vectors by inner product.

    Queries are the vectors whose id is divisible by ``every``, or ``queries``. All vectors that
    take part have one dimension, the most frequent; others, and null, zero or non-finite ones,
    take no part: a product of vectors of two dimensions is not defined. Ties go to the smaller id. Of
    rows repeated with an id the least vector counts, so reruns agree."""
    spark = vectors.sparkSession
    base = usable(vectors, id_col, vec_col).groupBy("vec_id").agg(F.min("x").alias("x"))
    top = base.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), "n").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if top is None:
        return spark.createDataFrame([], schema)
    dim = top["n"]
    width = max(w for w in range(1, width + 1) if dim % w == 0)
    base = written(base.filter(F.size("x") == dim), "embeddings")
    n, spread = base.count(), 4 * partitions(spark)
    taken = base.orderBy(F.md5(F.col("vec_id").cast("string"))).limit(sample).select("vec_id", "x").toArrow()
    order = np.argsort(taken["vec_id"].to_numpy())
    books = fit_codebooks(np.stack(taken["x"].to_numpy(zero_copy_only=False))[order], width)
    shared = spark.sparkContext.broadcast(books)  # dim x 16 doubles

    def block(cut: int, coded: bool):
        def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch["vec_id"].to_numpy()
                x = batch["x"].flatten().to_numpy().reshape(-1, dim)
                for a in range(0, len(ids), cut):
                    xs = x[a : a + cut]
                    code = packed(encode(xs, shared.value)).tobytes() if coded else b""
                    yield pa.RecordBatch.from_pydict({"ids": [ids[a : a + cut].tobytes()], "x": [xs.astype(np.float64).tobytes()], "code": [code]})

        return make

    q = base.filter(F.col("vec_id") % every == 0) if queries is None else usable(queries, id_col, vec_col).groupBy("vec_id").agg(F.min("x").alias("x")).filter(F.size("x") == dim)
    kind = "ids binary, x binary, code binary"
    q = q.repartition(min(spread, -(-max(1, n if queries is not None else n // every) // query_block)))
    qb = written(q.mapInArrow(trimmed(block(query_block, False)), kind), "queries").withColumn("q", F.monotonically_increasing_id())
    qb = written(qb.select("q", F.col("ids").alias("qids"), F.col("x").alias("qx")), "queryblocks")
    vb = written(base.repartition(min(spread, -(-n // vector_block))).mapInArrow(trimmed(block(vector_block, True)), kind), "vectors")
    numbers = [r["q"] for r in qb.select("q").collect()]  # a number for each block of queries
    if not numbers:
        return spark.createDataFrame([], schema)
    vb = vb.withColumn("q", F.explode(F.array(*map(F.lit, numbers))))
    pairs = vb.join(qb, "q").repartition(partitions(spark))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for qi, qx, vi, vx, vc in zip(*(batch[c].to_pylist() for c in ("qids", "qx", "ids", "x", "code")), strict=True):
                qi, vi = np.frombuffer(qi, np.int64), np.frombuffer(vi, np.int64)
                qx, vx = np.frombuffer(qx).reshape(-1, dim), np.frombuffer(vx).reshape(-1, dim)
                vc = np.frombuffer(vc, np.uint8).reshape(len(vi), -1)
                most = min(len(vi), max(rerank, k + 1))
                for a in range(0, len(qi), 256):
                    ids, x = qi[a : a + 256], qx[a : a + 256]
                    rough = scan(x, shared.value, vc)
                    rough[ids[:, None] == vi[None, :]] = -np.inf
                    cand = np.argpartition(-rough, most - 1, axis=1)[:, :most] if most < len(vi) else np.tile(np.arange(len(vi)), (len(ids), 1))
                    exact = np.einsum("qd,qcd->qc", x, vx[cand])
                    exact[ids[:, None] == vi[cand]] = -np.inf
                    o = np.lexsort((vi[cand], -exact), axis=1)[:, :k]
                    score = np.take_along_axis(exact, o, 1)
                    found = np.take_along_axis(vi[cand], o, 1)
                    ok = score.ravel() > -np.inf
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, o.shape[1])[ok]), pa.array(found.ravel()[ok]), pa.array(score.ravel()[ok])], ["query_id", "vec_id", "score"])

    near = pairs.mapInArrow(trimmed(search), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read(spark, sf_dir, "embeddings"))
