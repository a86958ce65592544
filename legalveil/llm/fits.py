"""Small fits in NumPy over bounded samples of labelled rows."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .textbytes import trimmed


def fitted(rows: DataFrame, fit: Callable[[dict[str, list]], dict | None]) -> dict | None:
    """fit(columns) of a bounded sample, in one task of an executor: the driver gets the model only.
    A lost executor fits anew, from the same rows in any order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[str, list] = {}
        for batch in batches:
            for name in batch.schema.names:
                got.setdefault(name, []).extend(batch[name].to_pylist())
        if got:
            yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(fit(got))], pa.binary())})

    found = rows.repartition(1).mapInArrow(trimmed(run), "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else None


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Adam:
    """Adam steps for a dict of arrays."""

    def __init__(self, rate: float = 0.01):
        self.rate, self.t, self.m, self.v = rate, 0, {}, {}

    def step(self, params: dict[str, np.ndarray], grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, g in grads.items():
            m = self.m[k] = 0.9 * self.m.get(k, 0) + 0.1 * g
            v = self.v[k] = 0.999 * self.v.get(k, 0) + 0.001 * g * g
            params[k] -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)


def calibrated(raw: np.ndarray, y: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """Platt scaling: (a, b) of sigmoid(a * raw + b), by Newton steps on the standardised scores, each
    halved until it lowers the loss: on separable rows whole steps run away."""
    n1 = y.sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (len(y) - n1 + 2))
    mean, scale = raw.mean(), raw.std() + 1e-9
    x = (raw - mean) / scale
    loss = lambda p: np.logaddexp(0, p[0] * x + p[1]).sum() - (t * (p[0] * x + p[1])).sum() + 5e-4 * p[0] ** 2
    p = np.array([scale, mean])
    now = loss(p)
    for _ in range(rounds):
        q = sigmoid(p[0] * x + p[1])
        w = np.maximum(q * (1 - q), 1e-9)
        g = np.array([((q - t) * x).sum() + 1e-3 * p[0], (q - t).sum()])
        h = np.array([[(w * x * x).sum() + 1e-3, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        size = 1.0
        while size > 1e-9 and not loss(p - size * step) < now:
            size /= 2
        if size <= 1e-9:
            break
        p = p - size * step
        now, before = loss(p), now
        if before - now < 1e-9:
            break
    return float(p[0] / scale), float(p[1] - p[0] * mean / scale)
