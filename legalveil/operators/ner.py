"""Mentions of token-classification models, as outside mentions of the plan."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WIDTH, OVERLAP = 1400, 200
ROLES = {"PER": "Nominativo", "PERSON": "Nominativo", "LAWYER": "Difensore", "AVV": "Difensore"}


_ready: dict[str, Callable] = {}  # the models of a worker, the last KEPT of them
KEPT = 4


def cached(name: str, make: Callable[[], Callable]) -> Callable:
    """The model of that name, made once in a worker process."""
    if name not in _ready:
        while len(_ready) >= KEPT:
            _ready.pop(next(iter(_ready)))
        _ready[name] = make()
    return _ready[name]


def available(models: dict[str, Callable[[], Callable]]) -> list[str]:
    """The models that can be made here; what a missing library or file forbids is left out."""
    found = []
    for name, make in models.items():
        try:
            cached(name, make)
        except (ImportError, OSError):
            continue
        found.append(name)
    return found


def windows(text: str, width: int = WIDTH, overlap: int = OVERLAP) -> Iterator[tuple[int, str]]:
    """Overlapping windows that end at white space of their second half where there is some."""
    at = 0
    while at < len(text):
        end = min(len(text), at + width)
        if end < len(text):
            cut = max(text.rfind(c, at + width // 2, end) for c in " \n\t")
            end = cut if cut > at else end
        yield at, text[at:end]
        if end >= len(text):
            return
        at = max(end - overlap, at + 1)


def mentions(docs: DataFrame, models: dict[str, Callable[[], Callable[[list[str]], list[list[dict]]]]], threshold: float = 0.60, width: int = WIDTH) -> DataFrame:
    """doc_id, start, end, text, role, score, source of docs (doc_id, text). Each model is a factory
    that is called once in a worker process and then takes a batch of windows. Duplicates keep their best
    score; the union over models stands."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ready = {name: cached(name, make) for name, make in models.items()}
        for pdf in batches:
            rows = []
            for doc, text in zip(pdf["doc_id"], pdf["text"].fillna(""), strict=True):
                cuts = list(windows(text, width, min(OVERLAP, width // 4)))
                for name, model in ready.items():
                    for (at, _), found in zip(cuts, model([c for _, c in cuts]), strict=True):
                        for m in found:
                            if m["score"] >= threshold and m["label"] in ROLES:
                                a, b = at + m["start"], at + m["end"]
                                rows.append((doc, a, b, text[a:b], ROLES[m["label"]], float(m["score"]), f"ner:{name}"))
            yield pd.DataFrame(rows, columns=["doc_id", "start", "end", "text", "role", "score", "source"])

    kind = dict(docs.dtypes)["doc_id"]
    found = docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, start int, end int, text string, role string, score double, source string")
    best = found.groupBy("doc_id", "start", "end", "source").agg(F.max_by("text", "score").alias("text"), F.max_by("role", "score").alias("role"), F.max("score").alias("score"))
    return merged(best.join(docs.select("doc_id", F.col("text").alias("whole")), "doc_id"))


def merged(found: DataFrame) -> DataFrame:
    """Adjacent mentions of a model as one, over at most two blanks and no line break: islands over
    a window of each document. The least score and the more specific role stand."""
    w = Window.partitionBy("doc_id", "source").orderBy("start", "end")
    gap = F.expr("substring(whole, lag(end) over (partition by doc_id, source order by start, end) + 1, start - lag(end) over (partition by doc_id, source order by start, end))")
    new = F.coalesce(~gap.rlike(r"^[^\S\n]{0,2}$") | (F.col("start") < F.lag("end").over(w)), F.lit(True))
    g = found.withColumn("new", new.cast("int")).withColumn("island", F.sum("new").over(w))
    out = g.groupBy("doc_id", "source", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("score").alias("score"), F.min("role").alias("role"), F.first("whole").alias("whole"))
    return out.select("doc_id", "start", "end", F.expr("substring(whole, start + 1, end - start)").alias("text"), "role", "score", "source")
