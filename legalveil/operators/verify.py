"""What is left in the output: never changes it, only reports."""

from __future__ import annotations


from ..functions import sql as F
from ..functions.sql import Expr as Column
from ..functions.lexicons import Lexicons
from ..functions.spans import after, find
from . import rules as R
from .detect import Doc, listed, structured_spans
from .people import LIMIT, alternatives, name_orders, rare_tokens

PRIVATE = rf"{R.OPEN}(?:{R.PARTY}|{R.PENAL}|{R.spelled('debit(?:ore|rice) credit(?:ore|rice) ered[ei] persona_fisica difensore')}|{R.LAWYER}|{R.COURTESY}){R.SHUT}[\s,:;-]{{1,20}}(?:{R.DOCTOR}\s+|{R.COURTESY}\s+)?"
#: What a text holds in a name's place already: a mark of omission, or initials.
DONE = r"\(?(?:[Oo]missis|OMISSIS)\)?|(?<!\p{L})\p{Lu}\.\s?\p{Lu}\.(?:\s?\p{Lu}\.)?(?!\p{L})"
TAG = r"^\p{L}+_[0-9]+$"
FINDING = "array<struct<start:int,end:int,text:string,kind:string,source:string,reason:string>>"


def expected_aliases(people: Column, decisions: Column, merges: Column, lexicons: Lexicons, least: int) -> Column:
    """Every spelling of a person who is redacted, also under the name that a reviewer merged them
    into (``merges``: array of struct a, b of keys ``label lower-case value``)."""
    key = lambda label, value: F.concat(label, F.lit("\u0001"), F.lower(value))
    shown = F.transform(F.filter(decisions, lambda x: x["replacement"].isNotNull()), lambda x: key(x["label"], x["value"]))

    def spellings(known: Column) -> Column:
        final = lambda k: F.coalesce(F.get(F.filter(merges, lambda m: m["a"] == k), F.lit(0))["b"], k)
        gone = F.filter(people, lambda p: F.array_contains(known, final(key(p["role"], p["display"]))))
        return F.array_sort(F.array_distinct(F.flatten(F.transform(gone, lambda p: F.concat(F.flatten(F.transform(F.array_union(p["variants"], F.array(p["display"])), name_orders)), rare_tokens(p["display"], lexicons, least))))))

    return F.bound(shown, "array<string>", spellings)


def residuals(d: Doc, kept: Column, aliases: Column, n_replaced: Column, lexicons: Lexicons) -> Column:
    """array<struct<start, end, text, kind, source, reason>> in order, of an output. ``kept`` are the
    accepted public roles' places in it: a person wholly inside one is exempt. Of findings on one
    span and kind the last counts."""
    output = d.text
    make = lambda spans, kind, source, reason: F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["text"].alias("text"), (kind(x) if callable(kind) else F.lit(kind)).alias("kind"), F.lit(source).alias("source"), (reason(x) if callable(reason) else F.lit(reason)).alias("reason")))
    heading = lambda x: (F.upper(x["text"]) == x["text"]) & F.exists(F.split(F.lower(x["text"]), r"\s+"), lambda t: listed(F.btrim(t, F.lit(".,;:")), R.HEADINGS))
    named = lambda x: ~x["text"].rlike(R.ORGANISATION) & ~heading(x) & ~after(output, x["end"], 6).rlike("^_[0-9]")
    shape = lambda x: named(x) & ~x["text"].rlike(DONE) & ~x["text"].rlike(rf"{R.OPEN}{R.SUFFIX}") & ~x["text"].rlike(rf"^{R.STREET_WORD}{R.SHUT}")
    parts = [
        make(structured_spans(d, lexicons), lambda x: F.upper(x["label"]), "verification:structured", lambda x: F.concat(x["label"], F.lit(" is left"))),
        make(F.filter(find(output, R.FULL, PRIVATE), named), "PERSON", "verification:private-role", "what may be a person follows a private party's cue"),
        make(F.filter(find(output, rf"{R.FULL}(?![\p{{L}}'’])", r"(?<![\p{L}'’])"), shape), "PERSON", "verification:name-shape", "capitalised words that may be a name"),
        make(find(output, alternatives(F.filter(aliases, lambda a: F.length(F.trim(a)) >= 3)), LIMIT, "(?Udiu)"), "PERSON", "verification:alias", "a spelling of a redacted person is left"),
    ]
    long = (F.size(F.split(output, " ")) > 300) & (n_replaced == 0) & (F.regexp_count(output, F.lit("(?U)" + DONE)) < 3)
    nothing = make(F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit("").alias("text"))), "DOCUMENT", "verification:coverage", "a long document of which nothing was removed")
    found = F.filter(F.concat(*parts), lambda x: (x["text"] != "") & ~x["text"].rlike(TAG) & ~((x["kind"] == "PERSON") & F.exists(kept, lambda k: (k["start"] <= x["start"]) & (x["end"] <= k["end"]))))
    found = F.concat(found, F.filter(nothing, lambda x: long))
    ordered = F.array_sort(F.transform(found, lambda x, i: F.struct(x["start"].alias("s"), x["end"].alias("e"), x["kind"].alias("k"), (-i).alias("i"), x.alias("x"))))
    last = F.bound(ordered, FINDING, lambda o: F.transform(F.filter(o, lambda y, i: (i == 0) | ~((F.get(o, i - 1)["s"] == y["s"]) & (F.get(o, i - 1)["e"] == y["e"]) & (F.get(o, i - 1)["k"] == y["k"]))), lambda y: y["x"]))
    return last


def risk(found: Column, warnings: Column) -> Column:
    hard = F.exists(found, lambda x: x["kind"].isin("CF", "EMAIL", "PEC"))
    return F.round(F.when(hard, 0.9).when(F.size(found) > 0, 0.7).when(F.size(warnings) > 0, 0.5).otherwise(0.0), 3)


def status(found: Column, warnings: Column) -> Column:
    return F.when((F.size(found) > 0) | (F.size(warnings) > 0), "needs_review").otherwise("passed_checks")
