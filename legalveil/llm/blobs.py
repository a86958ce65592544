"""Many small records as few rows: NumPy records packed in binary columns, dealt by bucket.

Spark shuffles, spills and recomputes the rows; a task sees the records of one bucket at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import partitions
from .textbytes import trimmed

FLUSH = 1 << 20  # records that a task gathers before it deals them out
ROWS = "bucket int, records binary, marks binary"


def buckets(df: DataFrame) -> int:
    """One bucket for each of the shuffle's partitions, which grow with the input; more would only
    multiply the rows, one for each task and bucket."""
    return partitions(df.sparkSession)


def dealt(records: np.ndarray, by: np.ndarray, n: int, marks: np.ndarray | None = None, marks_by: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """One row for each bucket that has records or marks."""

    def split(x: np.ndarray | None, b: np.ndarray | None) -> list[bytes]:
        if x is None or not len(x):
            return [b""] * n
        order = np.argsort(b, kind="stable")
        at = np.searchsorted(b[order], np.arange(n + 1))
        x = x[order]
        return [x[i:j].tobytes() for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]

    rows = [(k, r, m) for k, (r, m) in enumerate(zip(split(records, by), split(marks, marks_by), strict=True)) if r or m]
    for a in range(0, len(rows), 64):
        part = rows[a : a + 64]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in part], pa.int32()), pa.array([x[1] for x in part], pa.binary()), pa.array([x[2] for x in part], pa.binary())], ["bucket", "records", "marks"])


def by_bucket(df: DataFrame, work: Callable[[int, np.ndarray, np.ndarray], Iterator[pa.RecordBatch]], schema: str, kind: np.dtype, marks: np.dtype | None = None) -> DataFrame:
    """work(bucket, records, marks) once for each bucket, all its rows together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, got = None, []

        def done() -> Iterator[pa.RecordBatch]:
            if at is not None:
                yield from work(at, np.frombuffer(b"".join(r for r, _ in got), kind), np.frombuffer(b"".join(m for _, m in got), marks or kind))

        for batch in batches:
            for k, r, m in zip(batch["bucket"].to_pylist(), batch["records"].to_pylist(), batch["marks"].to_pylist(), strict=True):
                if k != at:
                    yield from done()
                    at, got = k, []
                got.append((r, m))
        yield from done()

    return df.repartition(partitions(df.sparkSession), "bucket").sortWithinPartitions("bucket").mapInArrow(trimmed(run), schema)
