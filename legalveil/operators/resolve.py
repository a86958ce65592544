"""Policy, tags, rendering and records: overlapping proposals become decisions, decisions tags, and
the text is rewritten once. All in the document's own row."""

from __future__ import annotations


from ..functions import sql as F
from ..functions.sql import Expr as Column
from ..functions.once import Steps
from .detect import FIELDS


def resolved(proposed: Column) -> Column:
    """Greedy: by priority, then length, then start, then order of proposal; accepted if it touches
    nothing accepted before. Losing to a rejected span does not count, so this is a fold; it runs
    within each island of spans that overlap, since spans of two islands never meet."""
    none = F.filter(proposed, lambda x: F.lit(False))
    by_start = F.array_sort(F.transform(F.filter(proposed, lambda x: x["end"] > x["start"]), lambda x: F.struct(x["start"].alias("s"), x["seq"].alias("q"), x.alias("x"))))

    def gather(a: Column, o: Column) -> Column:
        new = (o["s"] >= a["reach"]) & (F.size(a["now"]) > 0)
        return F.struct(
            F.when(new, F.concat(a["done"], F.array(a["now"]))).otherwise(a["done"]).alias("done"),
            F.when(new, F.array(o["x"])).otherwise(F.concat(a["now"], F.array(o["x"]))).alias("now"),
            F.greatest(a["reach"], o["x"]["end"]).alias("reach"))

    first = F.struct(F.slice(F.array(none), F.lit(1), F.lit(0)).alias("done"), none.alias("now"), F.lit(0).alias("reach"))
    islands = F.aggregate(by_start, first, gather, lambda a: F.concat(a["done"], F.array(a["now"])))

    def greedy(island: Column) -> Column:
        ordered = F.array_sort(F.transform(island, lambda x: F.struct((-x["priority"]).alias("p"), (x["start"] - x["end"]).alias("n"), x["start"].alias("s"), x["seq"].alias("q"), x.alias("x"))))
        taken = F.aggregate(ordered, none, lambda acc, o: F.when(F.exists(acc, lambda a: (a["start"] < o["x"]["end"]) & (o["x"]["start"] < a["end"])), acc).otherwise(F.concat(acc, F.array(o["x"]))))
        return F.transform(F.array_sort(F.transform(taken, lambda x: F.struct(x["start"].alias("s"), x.alias("x")))), lambda o: o["x"])

    return F.flatten(F.transform(islands, lambda i: F.when(F.size(i) < 2, i).otherwise(greedy(i))))


def tagged(d: Steps, roles: bool, edited: bool) -> None:
    """``decisions`` with action, replacement and entity_id. A tag is Label_N, N by first appearance
    of (label, lower-case value) within the label. With ``edited``, ``prior_tags`` maps values to the
    tags of an earlier run, which stay, and new ones go on after the largest; ``placeholders`` holds
    a reviewer's tags of entities, which take no number."""
    label = lambda x: F.when((x["kind"] == "PERSON") & F.lit(not roles), "Nominativo").otherwise(x["label"])
    name = lambda label_, value: F.concat(label_, F.lit("\u0001"), F.lower(value))
    redacted = F.filter("decisions", lambda x: x["protection"].isNull())
    keys = F.transform(redacted, lambda x: F.struct(label(x).alias("label"), F.lower(x["value"]).alias("value"), x["label"].alias("own")))
    d.add("keys", F.array_distinct(keys))
    old, fixed = F.array().cast("array<struct<label:string,value:string,tag:string,n:int>>"), F.array().cast("array<struct<label:string,value:string,tag:string>>")
    if edited:
        number = lambda e: F.regexp_extract(e["value"], r"_(\d+)$", 1).try_cast("int")
        entry = lambda e: F.struct(F.regexp_extract(e["value"], r"^(.*)_\d+$", 1).alias("label"), F.lower(e["key"]).alias("value"), e["value"].alias("tag"), number(e).alias("n"))
        d.add("old", F.coalesce(F.filter(F.transform(F.map_entries("prior_tags"), entry), lambda o: o["n"].isNotNull()), old))
        old, fixed = F.col("old"), F.col("custom")
    least = F.transform(F.array_distinct(F.transform(old, lambda o: o["label"])), lambda n: F.struct(n.alias("label"), F.array_max(F.transform(F.filter(old, lambda o: o["label"] == n), lambda o: o["n"])).alias("n")))

    def number_next(a: Column, k: Column) -> Column:
        own = F.get(F.filter(fixed, lambda o: (o["label"] == k["own"]) & (o["value"] == k["value"])), F.lit(0))["tag"]
        earlier = F.get(F.filter(old, lambda o: (o["label"] == k["label"]) & (o["value"] == k["value"])), F.lit(0))["tag"]
        known = F.coalesce(own, earlier)
        met = F.exists(a["out"], lambda o: o["key"] == name(k["label"], k["value"]))
        n = F.coalesce(F.get(F.filter(a["next"], lambda c: c["label"] == k["label"]), F.lit(0))["n"], F.lit(0)) + 1
        others = F.filter(a["next"], lambda c: c["label"] != k["label"])
        now = F.when(known.isNotNull() | met, a["next"]).otherwise(F.concat(others, F.array(F.struct(k["label"].alias("label"), n.alias("n")))))
        out = F.concat(a["out"], F.array(F.struct(name(k["label"], k["value"]).alias("key"), F.coalesce(known, F.concat(k["label"], F.lit("_"), n.cast("string"))).alias("tag"))))
        return F.struct(now.alias("next"), F.when(met, a["out"]).otherwise(out).alias("out"))

    zero = F.struct(least.cast("array<struct<label:string,n:int>>").alias("next"), F.array().cast("array<struct<key:string,tag:string>>").alias("out"))
    d.add("tags", F.map_from_entries(F.aggregate("keys", zero, number_next, lambda a: a["out"])))
    tag = lambda x: F.when(x["protection"].isNull(), F.element_at("tags", name(label(x), x["value"])))
    kept = lambda x: F.concat(F.lit("kept:"), x["kind"], F.lit(":"), F.lower(x["text"]))
    d.add("decisions", F.transform("decisions", lambda x: F.replaced(x, FIELDS, action=F.when(x["protection"].isNull(), "redact").otherwise("keep"), replacement=tag(x), entity_id=F.coalesce(tag(x), kept(x)))))


def rendered(text: Column, decisions: Column) -> Column:
    """The text with every redaction replaced, in one pass over the decisions."""
    step = lambda a, x: F.struct(F.concat(a["out"], F.substring(text, a["at"] + 1, x["start"] - a["at"]), F.coalesce(x["replacement"], x["text"])).alias("out"), x["end"].alias("at"))
    return F.aggregate(decisions, F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))


def output_spans(decisions: Column) -> Column:
    """Decisions' places in the output: start moves by what earlier replacements added."""
    grow = lambda x: F.length(F.coalesce(x["replacement"], x["text"])) - (x["end"] - x["start"])
    one = lambda a, x: F.struct((x["start"] + a["by"]).alias("start"), (x["end"] + a["by"] + grow(x)).alias("end"), x["protection"].alias("protection"), x["source"].alias("source"))
    first = F.struct(F.lit(0).alias("by"), F.array().cast("array<struct<start:int,end:int,protection:string,source:string>>").alias("out"))
    return F.aggregate(decisions, first, lambda a, x: F.struct((a["by"] + grow(x)).alias("by"), F.concat(a["out"], F.array(one(a, x))).alias("out")), lambda a: a["out"])


def mapping(decisions: Column) -> Column:
    """First spelling of each entity to its tag; of equal spellings the last wins."""
    redacted = F.filter(decisions, lambda x: x["replacement"].isNotNull())
    both = F.struct(F.transform(redacted, lambda x: x["replacement"]).alias("tags"), F.transform(redacted, lambda x: x["value"]).alias("values"))
    pair = "array<struct<k:string,v:string>>"
    pairs = F.bound(both, pair, lambda b: F.transform(F.reverse(F.array_distinct(b["tags"])), lambda t: F.struct(F.element_at(b["values"], F.array_position(b["tags"], t).cast("int")).alias("k"), t.alias("v"))))
    keyed = F.struct(pairs.alias("pairs"), F.transform(pairs, lambda p: p["k"]).alias("keys"))
    last = F.bound(keyed, pair, lambda b: F.filter(b["pairs"], lambda p, i: F.array_position(b["keys"], p["k"]) == i + 1))
    return F.map_from_entries(F.reverse(last))


def records(decisions: Column) -> Column:
    """One record for each entity: aliases, sources and spans."""
    ids = F.array_distinct(F.transform(decisions, lambda x: x["entity_id"]))

    def record(i: Column) -> Column:
        own = F.filter(decisions, lambda x: x["entity_id"] == i)
        one = F.get(own, F.lit(0))
        return F.struct(i.alias("entity_id"), one["kind"].alias("kind"), one["role"].alias("role"), one["action"].alias("action"), F.transform(F.array_sort(F.array_distinct(F.transform(own, lambda x: F.struct(F.lower(x["text"]).alias("low"), x["text"].alias("text"))))), lambda x: x["text"]).alias("aliases"), F.array_sort(F.array_distinct(F.transform(own, lambda x: x["source"]))).alias("sources"), F.transform(own, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))).alias("spans"))

    return F.transform(ids, record)
