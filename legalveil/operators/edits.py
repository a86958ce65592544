"""A reviewer's edits: one row of arrays for each edited document, joined on doc_id."""

from __future__ import annotations


from ..functions import sql as F
from ..functions.sql import Expr as Column
from ..functions.spans import find, quoted
from .detect import CANDIDATE, FIELDS, RANK, USER, candidates, name_key
from .people import END, LIMIT

COLUMNS = {
    "people": "array<struct<name:string,role:string>>",
    "terms": "array<struct<text:string,label:string>>",
    "exclude": "array<string>",
    "keep_spans": "array<struct<start:int,end:int>>",
    "include_spans": "array<struct<start:int,end:int,alias:string>>",
    "merge": "array<struct<a:string,b:string>>",
    "placeholders": "map<string,string>",
    "prior_tags": "map<string,string>",
}

RESULT = f"struct<pool:array<{CANDIDATE}>,merges:array<struct<a:string,b:string>>,custom:array<struct<label:string,value:string,tag:string>>>"


def some(name: str) -> Column:
    return F.coalesce(F.col(name), F.array().cast(COLUMNS[name]))


def user_seeds(n: Column) -> Column:
    rank = F.map(*[x for kv in RANK.items() for x in kv])
    return F.transform(some("people"), lambda p, i: F.struct(F.trim(p["name"]).alias("surface"), name_key(p["name"]).alias("key"), F.coalesce(p["role"], F.lit("Nominativo")).alias("role"), F.coalesce(F.element_at(rank, p["role"]), F.lit(3)).alias("rank"), F.lit("user").alias("source"), (n + i).cast("bigint").alias("seq")))


def owner(proposed: Column, alias: Column) -> Column:
    """(label, value) of the first candidate that the alias names."""
    fold = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    found = F.filter(proposed, lambda x: x["protection"].isNull() & (x["source"] != "alias:ambiguous") & ((fold(x["text"]) == fold(alias)) | (fold(x["value"]) == fold(alias))))
    first = F.array_min(F.transform(found, lambda x: F.struct(x["seq"].alias("q"), x["label"].alias("label"), x["value"].alias("value"), x["kind"].alias("kind"), x["role"].alias("role"))))
    return first


def key_of(label: Column, value: Column) -> Column:
    return F.concat(label, F.lit("\u0001"), F.lower(value))


def edited(text: Column, proposed: Column) -> Column:
    """struct<pool, merges, custom>: the candidates after the edits (keeps, terms, merges, includes,
    exclusions, in this order), the keys that were merged and a reviewer's own tags. An alias that
    names nothing has no effect; spans outside the text are dropped."""
    spans = lambda c: F.transform(F.filter(c, lambda s: (s["start"] >= 0) & (s["end"] <= F.length(text)) & (s["end"] > s["start"])), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.substring(text, s["start"] + 1, s["end"] - s["start"]).alias("text")))
    keeps = candidates(spans(some("keep_spans")), "keep", kind="USER", source="user:keep", priority=USER, reason="kept by the reviewer", role="Utente", protection="user")
    wanted = F.filter(some("terms"), lambda t: F.trim(t["text"]) != "")
    label = lambda t: F.coalesce(t["label"], F.lit("Nominativo"))
    terms = F.flatten(F.transform(wanted, lambda t: candidates(find(text, F.concat(quoted(t["text"]), F.lit(END)), LIMIT, "(?Udiu)"), "term", kind=lambda x: F.upper(label(t)), source="user:term", priority=USER, reason="term of the reviewer", role=lambda x: label(t), label=lambda x: label(t), value=lambda x: t["text"])))

    def merge(acc: Column, m: Column) -> Column:
        a, b = owner(acc["pool"], m["a"]), owner(acc["pool"], m["b"])
        old, new = key_of(a["label"], a["value"]), key_of(b["label"], b["value"])
        same = lambda x: x["protection"].isNull() & (key_of(x["label"], x["value"]) == old)
        pool = F.transform(acc["pool"], lambda x: F.when(same(x), F.replaced(x, FIELDS, label=b["label"], value=b["value"], role=b["role"])).otherwise(x))
        moved = F.transform(acc["merges"], lambda g: F.struct(g["a"].alias("a"), F.when(g["b"] == old, new).otherwise(g["b"]).alias("b")))
        merges = F.concat(moved, F.array(F.struct(old.alias("a"), new.alias("b"))))
        return F.when(a.isNull() | b.isNull() | (old == new), acc).otherwise(F.struct(pool.alias("pool"), merges.alias("merges")))

    start = F.struct(F.concat(proposed, terms).alias("pool"), F.array().cast("array<struct<a:string,b:string>>").alias("merges"))
    merged = F.aggregate(some("merge"), start, merge)

    def finish(now: Column) -> Column:
        pool = now["pool"]

        def include(x: Column) -> Column:
            o = owner(pool, x["alias"])
            return F.struct(x["start"].alias("start"), x["end"].alias("end"), F.substring(text, x["start"] + 1, x["end"] - x["start"]).alias("text"), F.coalesce(o["kind"], F.lit("PERSON")).alias("kind"), F.coalesce(o["label"], F.lit("Nominativo")).alias("label"), F.coalesce(o["value"], x["alias"]).alias("value"), F.coalesce(o["role"], F.lit("Nominativo")).alias("role"))

        inside = F.filter(some("include_spans"), lambda s: (s["start"] >= 0) & (s["end"] <= F.length(text)) & (s["end"] > s["start"]))
        added = candidates(F.transform(inside, include), "include", kind=lambda x: x["kind"], source="user:include", priority=USER, reason="added by the reviewer", role=lambda x: x["role"], label=lambda x: x["label"], value=lambda x: x["value"])
        gone = F.transform(some("exclude"), lambda e: owner(pool, e))
        gone = F.transform(F.filter(gone, lambda g: g.isNotNull()), lambda g: key_of(g["label"], g["value"]))
        kept = F.filter(pool, lambda x: (x["source"] == "alias:ambiguous") | x["protection"].isNotNull() | ~F.array_contains(gone, key_of(x["label"], x["value"])))
        tags = F.transform(F.map_entries(F.coalesce("placeholders", F.map().cast("map<string,string>"))), lambda e: F.struct(owner(pool, e["key"]).alias("o"), e["value"].alias("tag")))
        custom = F.transform(F.filter(tags, lambda e: e["o"].isNotNull()), lambda e: F.struct(e["o"]["label"].alias("label"), F.lower(e["o"]["value"]).alias("value"), e["tag"].alias("tag")))
        return F.struct(F.concat(keeps, kept, added).alias("pool"), now["merges"].alias("merges"), custom.alias("custom"))

    return F.bound(merged, RESULT, finish)
