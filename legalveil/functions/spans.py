"""Spans of a pattern in a text, with JVM string functions only.

Spark's regexp functions return no offsets. Each hit is wrapped in two private-use characters, the
text is split at them, and the lengths of the pieces add up to the offsets. Offsets are code points,
0-based and half-open. Texts must not hold the two characters: normalisation removes them.
"""

from __future__ import annotations

from . import sql as F
from .sql import Expr as Column

OPEN, CLOSE = "\ue000", "\ue001"
FLAGS = "(?Ud)"  # Unicode classes; only \n ends a line
SPAN = "struct<start:int,end:int,text:string>"


def find(text: Column, core: str | Column, pre: str = "", flags: str = FLAGS) -> Column:
    """array<struct<start, end, text>> of the hits of ``core`` behind ``pre``, which is consumed.
    Neither may hold a capturing group. ``core`` may be a column."""
    if isinstance(core, str):
        pattern = F.lit(f"{flags}({pre})({core})")
    else:
        pattern = F.concat(F.lit(f"{flags}({pre})("), core, F.lit(")"))
    return hits(F.regexp_replace(text, pattern, f"$1{OPEN}$2{CLOSE}"))


def hits(marked: Column) -> Column:
    """The spans between the marks of a marked text."""
    step = lambda a, x: F.struct(
        (a["at"] + F.length(x)).alias("at"),
        (~a["hit"]).alias("hit"),
        F.when(a["hit"], F.concat(a["out"], F.array(F.struct(a["at"].alias("start"), (a["at"] + F.length(x)).alias("end"), x.alias("text"))))).otherwise(a["out"]).alias("out"),
    )
    first = F.struct(F.lit(0).alias("at"), F.lit(False).alias("hit"), none().alias("out"))
    found = lambda m: F.aggregate(F.split(m, f"[{OPEN}{CLOSE}]"), first, step, lambda a: a["out"])
    return F.bound(marked, f"array<{SPAN}>", lambda m: F.when(m.contains(OPEN), found(m)).otherwise(none()))


def none() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def inside(windows: Column, core: str, pre: str = "") -> Column:
    """Hits within each window, in the text's own offsets."""
    return F.flatten(F.transform(windows, lambda w: moved(find(w["text"], core, pre), w["start"])))


def moved(spans: Column, by: Column) -> Column:
    return F.transform(spans, lambda x: F.struct((x["start"] + by).alias("start"), (x["end"] + by).alias("end"), x["text"].alias("text")))


def reach(text: Column, cues: Column, most: int, stop: str) -> Column:
    """Behind each cue a window of at most ``most`` characters that ends before ``stop``."""

    def window(x: Column) -> Column:
        w = F.element_at(F.split(F.substring(text, x["end"] + 1, F.lit(most)), FLAGS + stop, 2), 1)
        return F.struct(x["end"].alias("start"), (x["end"] + F.length(w)).alias("end"), w.alias("text"))

    return F.transform(cues, window)


def before(text: Column, start: Column, most: int) -> Column:
    """Up to ``most`` characters in front of a span."""
    return F.substring(text, F.greatest(start - most, F.lit(0)) + 1, F.least(start, F.lit(most)))


def after(text: Column, end: Column, most: int) -> Column:
    return F.substring(text, end + 1, F.lit(most))


def quoted(value: Column) -> Column:
    """value as a literal of a pattern, any white space between its words."""
    safe = F.regexp_replace(value, r"([\\.\[\]{}()*+?^$|\-])", r"\\$1")
    return F.regexp_replace(safe, r"\s+", r"\\s+")
