"""SentencePiece encoding and decoding by a relational lattice.

Texts are cut into units at places that no piece crosses (before white space, around characters
that stand alone, between a letter and a mark that never follows one in a piece). The units of a
partition, each once, run ahead of its texts through one stage without a shuffle:

* their substrings of bounded length, as 64-bit hashes of their bytes, are exploded and equi-joined
  to the piece table, which is broadcast (a model's pieces, whatever the corpus); a bitmap of the
  table's hashes spares the explosion most of those that the join would drop;
* the edges of a unit, which stand together, are grouped into one row, best first;
* Spark's higher-order aggregate folds them: for a unigram model by Viterbi, the best total score
  over the lattice; for a BPE model by merges, an edge joining where its two halves are whole. A
  BPE model's scores are merge ranks, and a Viterbi path over them is not the encoding that the
  model defines.

The fold yields each unit's cuts, from which the texts behind it get their ids. A task remembers
SEEN units at most and then begins anew, so its memory is bounded whatever the corpus.
"""

from __future__ import annotations

import heapq
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read
from .textbytes import U, prefix_hash, span_hash, text_chunks, trimmed

MODEL = os.environ.get("LEGALVEIL_PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
SEEN = 1 << 20  # units that a task remembers, some 30 MB
SHORT = 62  # symbols of the longest unit whose cuts are bits of one long; longer ones have several
MAP_BITS = 20  # log2 of the places of the bitmaps
HEAD = 4  # symbols by whose bitmap longer substrings are tried
BLOCK = 1 << 18  # substrings that a row of units may explode into
SPACE = "▁"


@dataclass
class Model:
    """A piece table. kinds: 1 normal, 2 unknown, 3 control, 4 user-defined, 6 byte."""

    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    bpe: bool = True

    def __post_init__(self) -> None:
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k in (1, 4)}
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == 6}
        self.unknown = next((i for i, k in enumerate(self.kinds) if k == 2), 0)
        self.longest = max((len(p) for p in self.ids), default=1)
        many = [p for p in self.ids if len(p) > 1]
        if any(b == SPACE != a for p in many for a, b in zip(p, p[1:], strict=False)):
            raise ValueError("a piece holds white space after another character")
        self.cuts = np.zeros(1 << 16, bool)  # pairs of bytes, the second of which begins a unit: no piece holds both
        pair = np.arange(1 << 16)
        self.cuts[(pair & 0xC0) != 0x80] = True
        for a, b in {x for p in many for x in zip(p.replace(SPACE, " "), p[1:].replace(SPACE, " "), strict=False)}:
            self.cuts[a.encode()[-1] << 8 | b.encode()[0]] = False
        out = [p.replace(SPACE, " ").encode() for p in self.pieces]
        for b, i in self.bytes.items():
            out[i] = bytes([b])
        for i, k in enumerate(self.kinds):
            if k == 3:
                out[i] = b""
            if k == 2:
                out[i] = " ⁇ ".encode()
        self.out = np.frombuffer(b"".join(out), np.uint8)
        self.at = np.concatenate(([0], np.cumsum([len(x) for x in out])))
        if self.longest > SHORT - 1:
            raise ValueError(f"a piece has more than {SHORT - 1} symbols")
        self.word = SHORT - self.longest  # boundaries in each long of a longer unit
        raw = [p.replace(SPACE, " ").encode() for p in self.ids]
        ends = np.cumsum([len(x) for x in raw]) if raw else np.empty(0, int)
        h = span_hash(prefix_hash(np.frombuffer(b"".join(raw), np.uint8)), ends - [len(x) for x in raw], ends) if raw else np.empty(0, U)
        order = np.argsort(h)
        self.hashes, self.hash_ids = h[order], np.array(list(self.ids.values()), np.int32)[order]
        self.some = np.zeros(1 << MAP_BITS, bool)
        self.some[self.hashes >> U(64 - MAP_BITS)] = True
        self.heads = np.zeros(1 << MAP_BITS, bool)  # of the first HEAD symbols of longer pieces
        long = [p.replace(SPACE, " ")[:HEAD].encode() for p in self.ids if len(p) > HEAD]
        if long:
            ends = np.cumsum([len(x) for x in long])
            self.heads[span_hash(prefix_hash(np.frombuffer(b"".join(long), np.uint8)), ends - [len(x) for x in long], ends) >> U(64 - MAP_BITS)] = True
        self.by_byte = np.array([self.bytes.get(b, self.unknown) for b in range(256)], np.int32)
        self.rank = {p: -self.scores[i] for p, i in self.ids.items()}
        self.order = np.unique(-np.array(self.scores, float), return_inverse=True)[1]  # of each piece, by rank
        self.least = 2 if self.bpe else 1  # symbols of the shortest edge
        self.spans = [np.array([(i, k) for i in range(n) for k in range(self.least, n - i + 1)], np.int64).reshape(-1, 2) for n in range(self.longest)]

    def span(self, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, symbols) of the at-th substring of a unit of n symbols, by start and length."""
        per = self.longest - self.least + 1
        full = np.maximum(n - self.longest + 1, 0)
        head = at < full * per
        i, k = at // per, self.least + at % per
        few = np.flatnonzero(~head)
        if len(few):
            first = np.concatenate(([0], np.cumsum([len(x) for x in self.spans])))
            row = first[np.minimum(n[few], self.longest - 1)] + at[few] - full[few] * per
            table = np.concatenate(self.spans)[row]
            i[few], k[few] = full[few] + table[:, 0], table[:, 1]
        return i, k

    def in_order(self) -> bool:
        """Whether the merges that make each piece come in order of their ranks. Then those of any
        unit do (the merges inside a piece are those of the piece alone), and one pass over its
        edges, best first, finds them all."""
        return all(c == sorted(c) for c in (merges(p, self)[1] for p in self.ids if len(p) > 2))


def load_model(path: str = MODEL) -> Model:
    """Reads a SentencePiece model file on the driver."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    kinds = [6 if sp.is_byte(i) else 2 if sp.is_unknown(i) else 3 if sp.is_control(i) else 5 if sp.is_unused(i) else 1 for i in range(n)]
    data = sp.serialized_model_proto()
    return Model([sp.id_to_piece(i) for i in range(n)], [sp.get_score(i) for i in range(n)], kinds, _model_type(data) == 2)


def _model_type(data: bytes) -> int:
    """trainer_spec.model_type (field 3 of field 2) of the model's protocol buffer: 1 unigram, 2 BPE."""

    def fields(x: bytes) -> Iterator[tuple[int, int | bytes]]:
        at = 0

        def number() -> int:
            nonlocal at
            n = shift = 0
            while True:
                b = x[at]
                at += 1
                n |= (b & 127) << shift
                shift += 7
                if b < 128:
                    return n

        while at < len(x):
            key = number()
            if key & 7 == 0:
                yield key >> 3, number()
            else:
                size = number() if key & 7 == 2 else 8 if key & 7 == 1 else 4
                yield key >> 3, x[at : at + size]
                at += size

    for k, v in fields(data):
        if k == 2:
            return next((w for j, w in fields(v) if j == 3), 1)
    return 1


def with_blank(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with the dummy blank in front of each that has a byte."""
    full = off[1:] > off[:-1]
    at = off + np.concatenate(([0], np.cumsum(full)))
    out = np.full(len(buf) + int(full.sum()), 32, np.uint8)
    own = np.ones(len(out), bool)
    own[at[:-1][full]] = False
    out[own] = buf
    return out, at


def cut_units(buf: np.ndarray, off: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, key, first unit of each text): units of all texts and their 64-bit keys."""
    n = len(buf)
    if not n:
        return np.empty(0, int), np.empty(0, int), np.empty(0, U), np.zeros(len(off), int)
    start = np.zeros(n, bool)
    start[1:] = model.cuts[buf[:-1].astype(np.uint16) << 8 | buf[1:]]
    start[off[:-1][off[1:] > off[:-1]]] = True
    a = np.flatnonzero(start)
    b = np.concatenate((a[1:], [n]))
    return a, b, span_hash(prefix_hash(buf), a, b), np.searchsorted(a, off)


def merges(unit: str, model: Model) -> tuple[list[int], list[float]]:
    """The merge fold of one unit: (ends of its pieces, the ranks of the merges as they came)."""
    n, rank = len(unit), model.rank
    left, whole, end = list(range(-1, n - 1)), [True] * n, list(range(1, n + 1))
    heap = [(rank[unit[i : i + 2]], i, i + 1, i + 2) for i in range(n - 1) if unit[i : i + 2] in rank]
    heapq.heapify(heap)
    came = []
    while heap:
        c, i, j, e = heapq.heappop(heap)
        if not (whole[i] and whole[j] and end[i] == j and end[j] == e):
            continue
        came.append(c)
        whole[j], end[i] = False, e
        if e < n:
            left[e] = i
            if (p := unit[i : end[e]]) in rank:
                heapq.heappush(heap, (rank[p], i, e, end[e]))
        if (h := left[i]) >= 0 and (p := unit[h:e]) in rank:
            heapq.heappush(heap, (rank[p], h, i, e))
    return [end[i] for i in range(n) if whole[i]], came


def blanked(texts: pa.Array, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """with_blank of the texts, the white space mark in them being the blank that it stands for."""
    if SPACE.encode() in buf.tobytes():
        _, _, buf, off = next(text_chunks(pc.replace_substring(texts, SPACE, " "), 1 << 62))
    return with_blank(buf, off)


def substrings(buf: np.ndarray, start: np.ndarray, end: np.ndarray, m: Model, block: int) -> Iterator[tuple]:
    """(units, n, of, at, hashes) of blocks of about ``block`` substrings at most, of units in a row:
    the units that begin in the block and their symbols, and the unit of each substring (-1: the one
    before the block's first, which goes on), its number within the unit, and its hash."""
    raw, size = gathered(buf, start, end - start, np.arange(len(start)))
    ends = np.cumsum(size)
    symbol = np.flatnonzero((raw & 0xC0) != 0x80)
    first = np.searchsorted(symbol, np.concatenate(([0], ends)))
    n = np.diff(first)
    unit = np.repeat(np.arange(len(n)), n)
    left = n[unit] - (np.arange(len(unit)) - first[:-1][unit])
    per = np.maximum(np.minimum(left, m.longest) - m.least + 1, 0)
    total = np.concatenate(([0], np.cumsum(per)))
    edge = np.concatenate((symbol, [len(raw)]))
    s = prefix_hash(raw)
    a = 0
    while a < len(unit):
        b = max(a + 1, int(np.searchsorted(total, total[a] + block, "right")) - 1)
        if b < len(unit) and first[unit[b]] > a:  # a block ends with a unit, unless one has more
            b = int(first[unit[b]])
        # the short ones, and the longer ones where a longer piece begins like that
        few = np.minimum(per[a:b], HEAD - m.least + 1)
        far = a + np.flatnonzero(per[a:b] > few)
        far = far[m.heads[span_hash(s, edge[far], edge[far + HEAD]) >> U(64 - MAP_BITS)]]
        number, h = [], []
        for start, low, most in ((np.arange(a, b), m.least, few), (far, HEAD + 1, per[far] - (HEAD - m.least + 1))):
            begin = np.repeat(start, most)
            k = low + np.arange(len(begin)) - np.repeat(np.cumsum(most) - most, most)
            found = span_hash(s, edge[begin], edge[begin + k])
            own = m.some[found >> U(64 - MAP_BITS)]
            h.append(found[own])
            number.append(total[begin[own]] + k[own] - m.least)
        number, h = np.concatenate(number), np.concatenate(h)
        order = np.argsort(number, kind="stable")
        number, h = number[order], h[order]
        of = unit[np.searchsorted(total, number, "right") - 1]
        u = np.arange(unit[a] + (first[unit[a]] < a), unit[b - 1] + 1)
        yield u, n[u], of - (u[0] if len(u) else unit[a] + 1), number - total[first[:-1][of]], h
        a = b


def packed(key: np.ndarray, size: np.ndarray, n: np.ndarray, flat: np.ndarray, of: np.ndarray, at: np.ndarray) -> bytes:
    """The units of a block (keys, bytes, symbols) and its substrings (unit, number) as one value."""
    head = np.array([len(key), len(flat), len(of)], np.int64)
    return b"".join(x.tobytes() for x in (head, key, size.astype(np.int32), n.astype(np.int32), flat, of.astype(np.int32), at.astype(np.int32)))


def unpacked(data: bytes) -> tuple[np.ndarray, ...]:
    """(key, size, n, flat, of, at) of packed(); of and at are empty where only_units() made data."""
    units, size, subs = np.frombuffer(data, np.int64, 3).tolist()
    out, at = [], 24
    for kind, count in ((U, units), (np.int32, units), (np.int32, units), (np.uint8, size), (np.int32, subs), (np.int32, subs)):
        count = count if at < len(data) else 0
        out.append(np.frombuffer(data, kind, count, at) if count else np.empty(0, kind))
        at += count * np.dtype(kind).itemsize
    return tuple(out)


def only_units(data: bytes) -> bytes:
    units, size, _ = np.frombuffer(data, np.int64, 3).tolist()
    return data[: 24 + 16 * units + size]


#: What a row is, where it is no edge: a block of units, a text, the place where a task begins anew.
UNITS, TEXT, ANEW = -1, -2, -3
KINDS = {UNITS: 0, TEXT: 1, ANEW: 2}  # the hashes that stand for them in the piece table


def task_units(shared, most: int, kind: str, block: int):
    """Rows (doc_id, data, subs): blocks of units that the task has not met, with the hashes of their
    substrings, ahead of the texts that hold them. The first of subs says what the row is."""
    names = ["doc_id", "data", "subs"]

    def rows(what: int, ids: pa.Array, data: pa.Array) -> pa.RecordBatch:
        subs = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32)), pa.array(np.full(len(ids), KINDS[what], np.int64)))
        return pa.RecordBatch.from_arrays([ids, data, subs], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, seen = shared.value, np.empty(0, U)
        for batch in batches:
            none = pa.nulls(1, batch["doc_id"].type)
            for a, b, buf, off in text_chunks(batch["text"]):
                buf, off = blanked(batch["text"][a:b], buf, off)
                s, e, key, _ = cut_units(buf, off, m)
                key, at = np.unique(key, return_index=True)
                if len(seen) and len(seen) + len(key) > most:
                    seen = seen[:0]
                    yield rows(ANEW, none, pa.nulls(1, pa.binary()))
                if len(seen):
                    place = np.minimum(np.searchsorted(seen, key), len(seen) - 1)
                    new = seen[place] != key
                    key, at = key[new], at[new]
                seen = np.sort(np.concatenate([seen, key]), kind="stable")
                for i in range(0, len(key), 8192):
                    k, w = key[i : i + 8192], at[i : i + 8192]
                    for u, n, of, which, hashes in substrings(buf, s[w], e[w], m, block):
                        flat, size = gathered(buf, s[w], e[w] - s[w], u)
                        subs = np.concatenate((np.array([KINDS[UNITS]], U), hashes)).view(np.int64)
                        listed = pa.ListArray.from_arrays(pa.array([0, len(subs)], pa.int32()), pa.array(subs))
                        yield pa.RecordBatch.from_arrays([none, pa.array([packed(k[u], size, n, flat, of, which)], pa.binary()), listed], names)
                yield rows(TEXT, batch["doc_id"][a:b], batch["text"][a:b].cast(pa.binary()))

    return trimmed(run), f"doc_id {kind}, data binary, subs array<long>"


def edges_of(rows: DataFrame, model: Model) -> DataFrame:
    """The rows (doc_id, data, hit), and behind each block of units its lattice: a row with only hit,
    the place of a substring in the block (from 1) and the piece that it is, 32 bits each. Few and
    narrow columns: Spark adds up the size of each for each row that goes to Python."""
    spark = rows.sparkSession
    own = [(i, h) for i, h in zip(model.hash_ids.tolist(), model.hashes.view(np.int64).tolist(), strict=True) if len(model.pieces[i]) >= model.least]
    table = pa.table({"sub": pa.array([*KINDS.values(), *(h for _, h in own)], pa.int64()), "piece": pa.array([*KINDS, *(i for i, _ in own)], pa.int64())})
    e = rows.select("doc_id", "data", F.posexplode("subs").alias("pos", "sub")).join(F.broadcast(spark.createDataFrame(table.to_pandas())), "sub")
    hit = F.when(F.col("piece") < 0, F.col("piece")).otherwise(F.shiftleft(F.col("pos").cast("long"), 32).bitwiseOR(F.col("piece")))
    return e.select("doc_id", F.when(F.col("piece") < 0, F.col("data")).alias("data"), hit.alias("hit"))


EDGES = "ats array<int>, ends array<long>, costs array<double>"


def runs(what: np.ndarray) -> Iterator[tuple[int, int]]:
    """(first, last + 1) of the runs of equal values."""
    edge = np.concatenate(([0], np.flatnonzero(what[1:] != what[:-1]) + 1, [len(what)])) if len(what) else np.zeros(1, int)
    return zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)


def best_first(of: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The order by unit, then rank, then place."""
    low = len(of).bit_length()
    if not len(of) or int(of.max()).bit_length() + int(rank.max()).bit_length() + low > 63:
        return np.lexsort((rank, of))
    mid = low + int(rank.max()).bit_length()
    return np.sort(of << mid | rank << low | np.arange(len(of))) & ((1 << low) - 1)


def grouped(shared, kind: str, short: int):
    """Rows (doc_id, data, n, ats, ends, costs): one for each unit, n its symbols, with its
    edges as arrays, in the order of the fold; the first of a block has the block's data. Other rows
    have n < 0, which says what they are. For merges an edge has its ends as bits, from the word
    ``at`` (null: all from the first); for Viterbi ``at`` and ``ends`` are its first and last
    boundary."""
    names = ["doc_id", "data", "n", "ats", "ends", "costs"]
    empty = [pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.float64())]

    def arrays(m: Model, blocks: list, id_type: pa.DataType) -> pa.RecordBatch:
        data, units, of, at, piece = [], 0, [], [], []
        n = np.concatenate([x[2] for _, x, _ in blocks]).astype(np.int64)
        for own, x, hits in blocks:
            hit = np.concatenate(hits) if hits else np.empty(0, np.int64)
            place = (hit >> 32) - 1
            of.append(x[4][place].astype(np.int64) + units)
            at.append(x[5][place].astype(np.int64))
            piece.append(hit & 0xFFFFFFFF)
            if len(x[0]):
                data += [only_units(own), *[None] * (len(x[0]) - 1)]
            units += len(x[0])
        of, at, piece = np.concatenate(of), np.concatenate(at), np.concatenate(piece)
        a, size = m.span(at, n[of])
        if m.bpe:
            order = best_first(of, m.order[piece])  # edges come by start: equal ones stay so
            of, a, size = of[order], a[order], size[order]
            at = np.where(n[of] <= short, 0, a // m.word)
            low = (a - at * m.word).astype(U)
            ends = (U(1) << low) | (U(1) << (low + size.astype(U)))
        else:
            # a symbol that is no piece costs more than any; so does each, beside its own edge
            owner = np.repeat(np.arange(units), n)
            place = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
            low_cost = max(m.rank.values(), default=0.0) + 10
            of, a, size = np.concatenate([of, owner]), np.concatenate([a, place]), np.concatenate([size, np.ones(len(owner), np.int64)])
            cost = np.concatenate([-np.array(m.scores, float)[piece], np.full(len(owner), low_cost)])
            order = np.lexsort((cost, a, a + size, of))
            of, at, size, cost = of[order], a[order], size[order], cost[order]
            ends = (at + size).astype(U)
        first = pa.array(np.searchsorted(of, np.arange(units + 1)).astype(np.int32))
        listed = lambda v: pa.ListArray.from_arrays(first, pa.array(v))
        words = listed(at.astype(np.int32)) if not m.bpe or (n > short).any() else pa.nulls(units, empty[0])
        costs = pa.nulls(units, empty[2]) if m.bpe else listed(cost)
        return pa.RecordBatch.from_arrays([pa.nulls(units, id_type), pa.array(data, pa.binary()), pa.array(n.astype(np.int32)), words, listed(ends.view(np.int64)), costs], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, blocks = shared.value, []
        for batch in batches:
            hit, id_type = batch["hit"].to_numpy(), batch["doc_id"].type
            what = np.minimum(hit, 0)
            for i, j in runs(what):
                if what[i] == 0:
                    blocks[-1][2].append(hit[i:j].copy())
                    continue
                for data in batch["data"][i:j].to_pylist() if what[i] == UNITS else [None]:
                    own = unpacked(data) if data else None
                    if blocks and not (own and len(own[4]) and own[4][0] < 0):  # else its first unit goes on
                        yield arrays(m, blocks, id_type)
                        blocks = []
                    if own:
                        blocks.append((data, own, []))
                if what[i] != UNITS:
                    yield pa.RecordBatch.from_arrays([batch["doc_id"][i:j], batch["data"][i:j], pa.array(np.full(j - i, what[i], np.int32)), *(pa.nulls(j - i, t) for t in empty)], names)
        if blocks:
            yield arrays(m, blocks, id_type)

    return trimmed(run), f"doc_id {kind}, data binary, n int, {EDGES}"


def folded(items: DataFrame, model: Model, short: int, in_order: bool) -> DataFrame:
    """items with ``cuts``. For merges, bits where a piece ends: one long up to ``short`` symbols,
    else a long for each model.word boundaries. For Viterbi the best last piece's start by end."""
    each = "if(size(ends) > 0, sequence(0, size(ends) - 1), cast(array() as array<int>))"  # the edges, by number
    if not model.bpe:
        cand = "(s.done[ats[i]].c + costs[i])"
        fold = f"""aggregate({each}, struct(array(struct(0D as c, 0 as f)) as done, cast('Infinity' as double) as c, 0 as f, 1 as e), (s, i) ->
            if(ends[i] > s.e, struct(concat(s.done, array(struct(s.c as c, s.f as f))) as done, concat(s.done, array(struct(s.c as c, s.f as f)))[ats[i]].c + costs[i] as c, ats[i] as f, cast(ends[i] as int) as e),
               if({cand} < s.c, struct(s.done as done, {cand} as c, ats[i] as f, s.e as e), s)),
            s -> concat(transform(s.done, d -> cast(d.f as long)), array(cast(s.f as long))))"""
    else:
        w = model.word
        mid = "({e} - 3L * ({e} & -{e}))".replace  # the bits between the two of e
        joins = lambda s, e: f"(({s}) & {e}) = {e} and bit_count(({s}) & {mid('{e}', e)}) = 1"
        whole, words = "~shiftleft(-1L, n + 1)", f"transform(sequence(0, n div {w} + 2), j -> shiftleft(1L, {w}) - 1L)"
        both, own = f"s[ats[i]] | shiftleft(s[ats[i] + 1], {w})", mid("{e}", "ends[i]")
        clear = f"transform(s, (v, j) -> if(j = ats[i], v & ~{own}, if(j = ats[i] + 1, v & ~shiftrightunsigned({own}, {w}), v)))"
        one = f"aggregate(ends, {whole}, (s, e) -> if({joins('s', 'e')}, s & ~{mid('{e}', 'e')}, s))"
        many = f"aggregate({each}, {words}, (s, i) -> if({joins(both, 'ends[i]')}, {clear}, s))"
        if not in_order:  # the best edge whose halves are whole, until none is left
            best = lambda s: f"get(filter({each}, i -> {joins(s, 'ends[i]')}), 0)"
            one = f"aggregate(sequence(1, n), {whole}, (s, _) -> aggregate(array({best('s')}), s, (s, i) -> if(i is null, s, s & ~{own})))"
            many = f"aggregate(sequence(1, n), {words}, (s, _) -> aggregate(array({best(both)}), s, (s, i) -> if(i is null, s, {clear})))"
        fold = f"if(n <= {short}, array({one}), {many})"
    return items.select("doc_id", "data", "n", F.expr(f"if(n >= 0, {fold}, null)").alias("cuts"))


def unit_ids(buf: np.ndarray, n: np.ndarray, cuts: pa.Array, m: Model, short: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids of the units one after another, the number of each) from their bytes and cuts."""
    offsets, flat = cuts.offsets.to_numpy(), cuts.flatten().to_numpy().view(U)
    offsets = offsets - offsets[0]
    whole = np.cumsum(n) - n  # the first symbol of each unit among all
    if m.bpe:
        width = np.where(n <= short, SHORT + 1, m.word)
        of = np.repeat(np.arange(len(n)), np.diff(offsets))
        base = (np.arange(len(flat)) - offsets[:-1][of]) * width[of]
        bits = np.unpackbits(flat.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        row, bit = np.nonzero(bits)
        end, unit = base[row] + bit, of[row]
        ok = (end > 0) & (end <= n[unit]) & (bit < width[unit])
        end, unit = end[ok], unit[ok]
    else:
        ends, owner = [], []
        for u, size in enumerate(n.tolist()):
            back, e, got = flat[offsets[u] : offsets[u + 1]].astype(np.int64), size, []
            while e:
                got.append(e)
                e = int(back[e])
            ends += got[::-1]
            owner += [u] * len(got)
        end, unit = np.array(ends, np.int64), np.array(owner, np.int64)
    start = np.concatenate(([0], end[:-1]))
    start[np.concatenate(([True], unit[1:] != unit[:-1]))[: len(unit)]] = 0
    symbol = np.concatenate((np.flatnonzero((buf & 0xC0) != 0x80), [len(buf)]))
    a, b = symbol[whole[unit] + start], symbol[whole[unit] + end]
    h = span_hash(prefix_hash(buf), a, b)
    at = np.minimum(np.searchsorted(m.hashes, h), max(0, len(m.hashes) - 1))
    known = m.hashes[at] == h if len(m.hashes) else np.zeros(len(h), bool)
    many = np.where(known | (not m.bytes), 1, b - a)
    out = np.repeat(np.where(known, m.hash_ids[at] if len(m.hashes) else m.unknown, m.unknown), many)
    if m.bytes and not known.all():
        lost = ~known
        raw, _ = gathered(buf, a[lost], (b - a)[lost], np.arange(int(lost.sum())))
        out[np.repeat(lost, many)] = m.by_byte[raw]
    return out.astype(np.int32), np.bincount(unit, many, len(n)).astype(np.int64)


def encode(docs: DataFrame, model: Model | None = None, *, id_col="doc_id", text_col="text", seen: int = SEEN, short: int = SHORT, block: int = BLOCK) -> DataFrame:
    """Per row of docs: doc_id, ids (array<int>), n_tokens, round_trip (whether decoding gives the
    text back).

    Null and empty texts have no tokens. Text is taken as it is (identity normalisation, a dummy
    white space in front). A text that holds the white space mark itself decodes to a blank there,
    so its round trip fails; so do unknown symbols of models without byte pieces. Repeated rows are
    encoded each. Units of any length go through the lattice; the fold's time grows with the square
    of a unit's length beyond ``short`` symbols."""
    spark = docs.sparkSession
    model = model or load_model()
    shared = spark.sparkContext.broadcast(model)  # the piece table
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = dict(d.dtypes)["doc_id"]
    rows = d.mapInArrow(*task_units(shared, seen, kind, block))
    items = edges_of(rows, model).mapInArrow(*grouped(shared, kind, short))
    done = folded(items, model, short, model.bpe and model.in_order())
    return done.mapInArrow(trimmed(_encoder(shared, short)), f"doc_id {kind}, ids array<int>, n_tokens long, round_trip boolean")


def _encoder(shared, short: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        nothing = (np.empty(0, U), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32))
        keys, start, count, flat = nothing  # sorted keys; where the ids of each stand, and how many
        fresh: list[tuple] = []
        left: list[pa.RecordBatch] = []  # units whose block may go on

        def met() -> None:
            rows = pa.Table.from_batches(left).combine_chunks()
            own = [unpacked(x) for x in rows["data"].drop_null().to_pylist()]
            key, flat = (np.concatenate([x[i] for x in own]) for i in (0, 3))
            got, many = unit_ids(flat, rows["n"].to_numpy().astype(np.int64), rows["cuts"].chunk(0), m, short)
            fresh.append((key, many, got))
            left.clear()

        for batch in batches:
            what = np.minimum(batch["n"].to_numpy(), 0)
            for i, j in runs(what):
                part = batch.slice(i, j - i)
                if what[i] == 0:
                    heads = np.flatnonzero(part["data"].is_valid().to_numpy(zero_copy_only=False))
                    if len(heads):
                        if heads[-1]:
                            left.append(part.slice(0, heads[-1]))
                        if left:
                            met()
                        part = part.slice(heads[-1])
                    left.append(part)
                    continue
                if left:
                    met()
                if what[i] == ANEW:
                    keys, start, count, flat = nothing
                    fresh = []
                else:
                    if fresh:
                        more = np.concatenate([x[1] for x in fresh])
                        start = np.concatenate([start, len(flat) + np.cumsum(more) - more])
                        keys, count, flat = np.concatenate([keys, *(x[0] for x in fresh)]), np.concatenate([count, more]), np.concatenate([flat, *(x[2] for x in fresh)])
                        order = np.argsort(keys, kind="stable")
                        keys, start, count, fresh = keys[order], start[order], count[order], []
                    for a, b, buf, off in text_chunks(part["data"]):
                        padded, at = blanked(part["data"][a:b], buf, off)
                        _, _, key, first = cut_units(padded, at, m)
                        place = np.searchsorted(keys, key)
                        if len(key) and (keys[np.minimum(place, len(keys) - 1)] != key).any():
                            raise RuntimeError("a unit came behind its text")
                        ids, per = gathered(flat, start, count, place)
                        tokens = np.concatenate(([0], np.cumsum(per)))[first]
                        same = decoded_equal(ids, tokens, buf, off, m)
                        yield pa.RecordBatch.from_arrays([part["doc_id"][a:b], pa.ListArray.from_arrays(pa.array(tokens.astype(np.int32)), pa.array(ids)), pa.array(np.diff(tokens)), pa.array(same)], ["doc_id", "ids", "n_tokens", "round_trip"])

    return run


def gathered(flat: np.ndarray, start: np.ndarray, count: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the picked runs of flat one after another, the length of each)."""
    per = count[pick]
    place = np.repeat(start[pick] - (np.cumsum(per) - per), per) + np.arange(per.sum())
    return flat[place], per


def decode_ids(ids: np.ndarray, first: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the texts of these ids; a leading blank of each goes."""
    size = np.diff(model.at)
    out, per = gathered(model.out, model.at[:-1], size, ids)
    off = np.concatenate(([0], np.cumsum(per)))[first]
    keep = np.ones(len(out), bool)
    lead = off[:-1][off[1:] > off[:-1]]
    keep[lead[out[lead] == 32]] = False
    return out[keep], np.concatenate(([0], np.cumsum(keep)))[off]


def decoded_equal(ids, first, buf, off, model) -> np.ndarray:
    out, at = decode_ids(ids, first, model)
    same = np.diff(at) == np.diff(off)
    if same.all() and len(out) == len(buf) and (out == buf).all():
        return same
    return np.array([bool(s and (out[at[i] : at[i + 1]] == buf[off[i] : off[i + 1]]).all()) for i, s in enumerate(same.tolist())], bool)


def decode(encoded: DataFrame, model: Model | None = None, *, id_col="doc_id", ids_col="ids") -> DataFrame:
    """Per row: doc_id and text. A null list has the text null; bytes that are no UTF-8 are replaced."""
    model = model or load_model()
    shared = encoded.sparkSession.sparkContext.broadcast(model)
    d = encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for x in batch["ids"]:
                ids = np.array(x.as_py() or [], np.int64)
                out, _ = decode_ids(ids, np.array([0, len(ids)]), shared.value)
                texts.append(out.tobytes().decode("utf-8", "replace") if x.is_valid else None)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(texts, pa.string())], ["doc_id", "text"])

    return d.mapInArrow(trimmed(run), f"doc_id {dict(d.dtypes)['doc_id']}, text string")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(read(spark, sf_dir, "documents"))
