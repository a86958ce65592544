"""Suffix-array dedup: every byte under a string of 200 bytes that starts anywhere else goes.

Prefix doubling over positions of UTF-8 bytes: positions are ranked by a prefix, Spark sorts the
(rank, rank at the offset) pairs, and positions drop out once unique or past the threshold. Ranking
all positions at the first rounds would move each byte many times over, so:

* Round 1 ranks, of the first 100 bytes, sampled positions only. Of the 101 strings of 100 bytes in
  a string of 200, the one with the least hash is its anchor. Equal strings have equal anchors at
  equal offsets, so no repeat is lost. Consecutive positions with one anchor form a run.
* Round 2 sorts (anchor's rank, rank of the run's whole string, 200 bytes or more). Runs whose
  anchor is unique drop out; runs whose string is not unique are past the threshold as a whole.
* Round 3 takes what is left (runs whose anchor repeats but whose string does not, and one run of
  each repeated string beside them) position by position, and sorts (rank of the first 100 bytes,
  rank of the next 100). Positions that are not unique are past the threshold.

Ranks are 64-bit fingerprints of the strings. Each task first meets its own equal strings and deals
out one record of each, so a string in a third of all texts never gathers in a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blobs
from .common import among, read, written
from .textbytes import U, prefix_hash, span_hash, text_chunks, trimmed

LEAST = 200
RUN = np.dtype([("h", "<u8"), ("u", "<u8"), ("k", "<i8"), ("p", "<u4"), ("n", "<u2"), ("f", "u1")])
MARK = np.dtype([("k", "<i8"), ("p", "<u4"), ("n", "<u2")])
POINT = np.dtype([("h", "<u8"), ("k", "<i8"), ("p", "<u4"), ("f", "u1")])
NO_MARKS = np.empty(0, MARK)


def text_runs(buf: np.ndarray, off: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, ...]:
    """(anchor hash, hash of the run's string, text, first position within it, positions) of the
    runs of all texts of ``least`` bytes or more."""
    gram = least // 2
    width = least - gram + 1
    n = len(buf)
    empty = tuple(np.empty(0, t) for t in (U, U, np.int64, np.int64, np.int64))
    if n < least:
        return empty
    s = prefix_hash(buf)
    at = np.arange(n - gram + 1)
    h = span_hash(s, at, at + gram)
    key = (h & U(0xFFFFFFFF00000000)) | at.astype(U)  # leftmost of equals
    m = -(-len(key) // width) * width
    key = np.concatenate([key, np.full(m - len(key), U(0xFFFFFFFFFFFFFFFF))]).reshape(-1, width)
    ahead = np.minimum.accumulate(key, axis=1).ravel()
    behind = np.minimum.accumulate(key[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = n - least + 1
    anchor = (np.minimum(behind[:starts], ahead[width - 1 : width - 1 + starts]) & U(0xFFFFFFFF)).astype(np.int64)
    ok = np.ones(starts, bool)  # strings that end within their text
    for e in off[1:-1][(off[1:-1] < n)].tolist():
        ok[max(0, e - least + 1) : e] = False
    new = np.ones(starts, bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | ~ok[:-1]
    first = np.flatnonzero(ok & new)
    if not len(first):
        return empty
    stop = np.zeros(starts, bool)
    stop[:-1] = new[1:] | ~ok[1:]
    stop[-1] = True
    last = np.flatnonzero(ok & stop)
    text = np.searchsorted(off, first, "right") - 1
    return h[anchor[first]], span_hash(s, first, last + least), text, first - off[text], last - first + 1


def _local(order: np.ndarray, same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(one of each group, whether its group has more), from a sorted order and equality flags."""
    lead = np.concatenate(([True], ~same))
    more = np.concatenate((same, [False]))
    return order[lead], more[lead]


def _run_records(h, u, k, p, n, count: int) -> Iterator[pa.RecordBatch]:
    order = np.lexsort((u, h))
    hs, us = h[order], u[order]
    same = (hs[1:] == hs[:-1]) & (us[1:] == us[:-1])
    rep, more = _local(order, same)
    out = np.empty(len(rep), RUN)
    out["h"], out["u"], out["k"], out["p"], out["n"], out["f"] = h[rep], u[rep], k[rep], p[rep], n[rep], more
    in_group = np.concatenate(([False], same)) | np.concatenate((same, [False]))
    again = order[in_group]
    marks = np.empty(len(again), MARK)
    marks["k"], marks["p"], marks["n"] = k[again], p[again], n[again]
    yield from blobs.dealt(out, (out["h"] % U(count)).astype(np.int64), count, *_marks_by(marks, count))


def _marks_by(marks: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    marks = merged(marks)
    return marks, (marks["k"].view(U) % U(count)).astype(np.int64)


def merged(marks: np.ndarray) -> np.ndarray:
    """Marks in order of text and position, those that touch as one."""
    if len(marks) < 2:
        return marks
    marks = marks[np.lexsort((marks["p"], marks["k"]))]
    end = marks["p"].astype(np.int64) + marks["n"]
    # runs of a text neither overlap nor repeat but through repeated rows, which are equal
    new = np.ones(len(marks), bool)
    new[1:] = (marks["k"][1:] != marks["k"][:-1]) | (marks["p"][1:] != end[:-1])
    dup = np.zeros(len(marks), bool)
    dup[1:] = marks[1:] == marks[:-1]
    marks, new, end = marks[~dup], new[~dup], end[~dup]
    group = np.flatnonzero(new)
    last = np.concatenate((group[1:], [len(marks)])) - 1
    size = end[last] - marks["p"][group]
    if (size > 65_535).any():
        return marks
    out = marks[group].copy()
    out["n"] = size
    return out


def find_runs(docs: DataFrame, count: int, least: int) -> DataFrame:
    """Round 1, on (k, text): bucketed records of runs, and marks of those that repeat in the task."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, held = [], 0
        for batch in batches:
            keys = batch["k"].to_numpy()
            for a, _, buf, off in text_chunks(batch["text"]):
                h, u, text, p, n = text_runs(buf, off, least)
                got.append((h, u, keys[a + text], p, n))
                held += len(h)
                if held >= blobs.FLUSH:
                    yield from _run_records(*map(np.concatenate, zip(*got, strict=True)), count)
                    got, held = [], 0
        if held:
            yield from _run_records(*map(np.concatenate, zip(*got, strict=True)), count)

    return docs.mapInArrow(trimmed(scan), blobs.ROWS)


def settle_runs(runs: DataFrame, count: int) -> DataFrame:
    """Round 2: rows of bucketed marks (runs past the threshold), with the runs to go on with as
    records, both dealt by text."""

    def work(_: int, r: np.ndarray, marks: np.ndarray) -> Iterator[pa.RecordBatch]:
        out, ask = [marks], np.empty(0, RUN)
        if len(r):
            r = r[np.lexsort((r["u"], r["h"]))]
            same_h = r["h"][1:] == r["h"][:-1]
            same = same_h & (r["u"][1:] == r["u"][:-1])
            group = np.concatenate(([0], np.cumsum(~same)))
            lead = np.flatnonzero(np.concatenate(([True], ~same)))
            often = (np.bincount(group) > 1) | (np.bincount(group, r["f"]) > 0)
            whole = often[group] & (r["f"] == 0)
            found = np.empty(int(whole.sum()), MARK)
            for c in ("k", "p", "n"):
                found[c] = r[c][whole]
            out.append(found)
            cls = np.concatenate(([0], np.cumsum(~same_h)))[lead]
            ask = r[lead][np.bincount(cls)[cls] > 1]
        marks, by = _marks_by(np.concatenate(out), count)
        yield from blobs.dealt(ask, (ask["k"].view(U) % U(count)).astype(np.int64), count, marks, by)

    return blobs.by_bucket(runs, work, blobs.ROWS, RUN, MARK)


def per_text(rows: DataFrame, column: str, kind: np.dtype, fields: tuple[str, ...], merge: bool) -> DataFrame:
    """(k, packed): all records of a text in one row."""

    def work(_: int, records: np.ndarray, __: np.ndarray) -> Iterator[pa.RecordBatch]:
        if merge:
            records = merged(records)
        records = records[np.lexsort((records["p"], records["k"]))]
        lead = np.flatnonzero(np.concatenate(([True], records["k"][1:] != records["k"][:-1]))) if len(records) else np.empty(0, int)
        ends = np.concatenate((lead[1:], [len(records)])) if len(lead) else lead
        kept = np.empty(len(records), np.dtype([(f, kind[f]) for f in fields]))
        for f in fields:
            kept[f] = records[f]
        for a in range(0, len(lead), 2048):
            ks = records["k"][lead[a : a + 2048]]
            packed = [kept[i:j].tobytes() for i, j in zip(lead[a : a + 2048].tolist(), ends[a : a + 2048].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ks), pa.array(packed, pa.binary())], ["k", "packed"])

    some = rows.filter(F.length(column) > 0).select("bucket", F.col(column).alias("records"), F.lit(b"").alias("marks"))
    return blobs.by_bucket(some, work, "k long, packed binary", kind)


def find_points(docs: DataFrame, count: int, least: int) -> DataFrame:
    """Round 3, on (k, text, packed runs): bucketed records of positions, as in find_runs."""
    gram = least // 2
    asked = np.dtype([("p", "<u4"), ("n", "<u2")])

    def flush(h, k, p) -> Iterator[pa.RecordBatch]:
        order = np.argsort(h, kind="stable")
        hs = h[order]
        same = hs[1:] == hs[:-1]
        rep, more = _local(order, same)
        out = np.empty(len(rep), POINT)
        out["h"], out["k"], out["p"], out["f"] = h[rep], k[rep], p[rep], more
        again = order[np.concatenate(([False], same)) | np.concatenate((same, [False]))]
        marks = np.empty(len(again), MARK)
        marks["k"], marks["p"], marks["n"] = k[again], p[again], 1
        yield from blobs.dealt(out, (out["h"] % U(count)).astype(np.int64), count, *_marks_by(marks, count))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, held = [], 0
        for batch in batches:
            keys, packed = batch["k"].to_numpy(), batch["packed"]
            for a, b, buf, off in text_chunks(batch["text"]):
                s = prefix_hash(buf)
                for i in range(a, b):
                    r = np.frombuffer(packed[i].as_py(), asked)
                    n = r["n"].astype(np.int64)
                    p = np.repeat(r["p"].astype(np.int64), n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    q = p + off[i - a]
                    h = span_hash(s, q, q + gram) * U(3) + span_hash(s, q + gram, q + least)
                    got.append((h, np.full(len(h), keys[i]), p))
                    held += len(h)
                if held >= blobs.FLUSH:
                    yield from flush(*map(np.concatenate, zip(*got, strict=True)))
                    got, held = [], 0
        if held:
            yield from flush(*map(np.concatenate, zip(*got, strict=True)))

    return docs.mapInArrow(trimmed(scan), blobs.ROWS)


def settle_points(points: DataFrame, count: int) -> DataFrame:
    def work(_: int, r: np.ndarray, marks: np.ndarray) -> Iterator[pa.RecordBatch]:
        out = [marks]
        if len(r):
            r = r[np.argsort(r["h"], kind="stable")]
            group = np.concatenate(([0], np.cumsum(r["h"][1:] != r["h"][:-1])))
            often = np.bincount(group)[group] > 1
            found = np.empty(int(often.sum()), MARK)
            found["k"], found["p"], found["n"] = r["k"][often], r["p"][often], 1
            out.append(found)
        marks, by = _marks_by(np.concatenate(out), count)
        yield from blobs.dealt(np.empty(0, RUN), np.empty(0, np.int64), count, marks, by)

    return blobs.by_bucket(points, work, blobs.ROWS, POINT, MARK)


def repeat_marks(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(k, packed): the start positions of repeated strings of each text that has any, from docs
    (k, text). k names a text; equal texts under one k are repeats of each other."""
    count = blobs.buckets(docs)
    settled = written(settle_runs(find_runs(docs, count, least), count), "runs")
    asked = written(per_text(settled, "records", RUN, ("p", "n"), merge=False), "asked")
    inside = among(docs, asked).filter("maybe").drop("maybe").join(asked.hint("shuffle_hash"), "k")
    points = written(settle_points(find_points(inside, count, least), count), "points")
    return written(per_text(settled.unionByName(points), "marks", MARK, ("p", "n"), merge=True), "marks")


def covered(packed: bytes, least: int) -> np.ndarray:
    """(m, 2) maximal byte ranges under the marked strings."""
    r = np.frombuffer(packed, np.dtype([("p", "<u4"), ("n", "<u2")]))
    a = r["p"].astype(np.int64)
    b = np.maximum.accumulate(a + r["n"] + least - 1)
    lead = np.flatnonzero(np.concatenate(([True], a[1:] > b[:-1])))
    return np.stack([a[lead], b[np.concatenate((lead[1:], [len(a)])) - 1]], 1)


def drop_repeats(docs: DataFrame, *, id_col="doc_id", text_col="text", least: int = LEAST, texts: bool = False, carry: Sequence[Column] = ()) -> DataFrame:
    """Per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (array of start,
    end in bytes), and with ``texts`` also kept (the remaining bytes, as text; bytes of a character
    cut in two go with the rest of it), and with ``carry`` a struct ``row`` of these columns.

    Null and empty texts have no bytes and lose none; texts shorter than ``least`` lose nothing.
    Repeated rows are repeats of each other, whatever their id."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *([F.struct(*carry).alias("row")] if carry else []))
    d = d.withColumn("k", F.xxhash64("doc_id", "text"))
    marks = repeat_marks(d.filter(F.octet_length("text") >= least).select("k", "text"), least)
    flagged = among(d, marks)
    spans_type = "array<struct<start:long,end:long>>"
    clean = flagged.filter("not maybe").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"), F.array().cast(spans_type).alias("spans"), *([F.col("text").alias("kept")] if texts else []), *(["row"] if carry else []))

    carried = "row" in d.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, buf, off in text_chunks(batch["text"]):
                size, gone, spans, sha, kept = [], [], [], [], []
                for i in range(a, b):
                    x, packed = buf[off[i - a] : off[i - a + 1]], batch["packed"][i].as_py()
                    s = covered(packed, least) if packed else np.empty((0, 2), np.int64)
                    stay = np.ones(len(x), bool)
                    for p, q in s.tolist():
                        stay[p:q] = False
                    left = x[stay].tobytes()
                    size.append(len(x))
                    gone.append(len(x) - len(left))
                    spans.append([{"start": p, "end": q} for p, q in s.tolist()])
                    sha.append(hashlib.sha256(left).hexdigest())
                    if texts:
                        at = [0, *s.ravel().tolist(), len(x)]
                        kept.append("".join(x[p:q].tobytes().decode("utf-8", "ignore") for p, q in zip(at[::2], at[1::2], strict=True)))
                cols = [batch["doc_id"][a:b], pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array([len(s) for s in spans], pa.int64()), pa.array(sha), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
                names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]
                if texts:
                    cols, names = [*cols, pa.array(kept, pa.string())], [*names, "kept"]
                if carried:
                    cols, names = [*cols, batch["row"][a:b]], [*names, "row"]
                yield pa.RecordBatch.from_arrays(cols, names)

    rest = flagged.filter("maybe").drop("maybe").join(marks.hint("shuffle_hash"), "k", "left").select("doc_id", "text", "packed", *(["row"] if carry else []))
    return clean.unionByName(rest.mapInArrow(trimmed(cut), clean.schema))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeats(read(spark, sf_dir, "documents")).drop("spans")
