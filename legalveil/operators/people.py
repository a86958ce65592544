"""Identities of one document: seeds merged by key, short forms folded into their only host, and
the spans that each identity proposes."""

from __future__ import annotations


from ..functions import sql as F
from ..functions.sql import Expr as Column
from ..config import Config
from ..functions.lexicons import Lexicons
from ..functions.spans import after, before, find, quoted
from . import rules as R
from .detect import CANDIDATE, FIELDS, FULL_NAME, TOKEN, Doc, candidates, judge_key, listed, named_place, rare_tokens

#: What judges have too, what speaks for a private person, and what does so against a judge's role.
NEUTRAL = [r.source for r in R.SEEDS if r.kind == "neutral"] + ["lexicon:first_name"]
STRICT = [r.source for r in R.SEEDS if r.kind == "strong"] + sorted({r.source for r in R.LISTS}) + ["user"]
BROAD = STRICT[:-1] + ["regex:legal_party_block"]
PERSON = ["key", "display", "role", "variants", "sources", "seq"]
LIMIT = r"(?<![\p{L}\p{N}])"
END = r"(?![\p{L}\p{N}])"


def merged(seeds: Column) -> Column:
    """One person for each key: variants, sources, the strongest role (a reviewer's overrides), and
    the longest spelling, the first of equals."""

    def person(k: Column) -> Column:
        own = F.filter(seeds, lambda s: s["key"] == k)
        best = F.array_min(F.transform(own, lambda s: F.struct(F.when(s["source"] == "user", -1).otherwise(s["rank"]).alias("r"), F.when(s["source"] == "user", -s["seq"]).otherwise(s["seq"]).alias("q"), s["role"].alias("role"))))
        longest = F.array_min(F.transform(own, lambda s: F.struct((-F.length(s["surface"])).alias("n"), s["seq"].alias("q"), s["surface"].alias("s"))))
        return F.struct(
            k.alias("key"), longest["s"].alias("display"), best["role"].alias("role"),
            F.array_distinct(F.transform(own, lambda s: s["surface"])).alias("variants"),
            F.array_sort(F.array_distinct(F.transform(own, lambda s: s["source"]))).alias("sources"),
            F.array_min(F.transform(own, lambda s: s["seq"])).alias("seq"))

    return F.transform(F.array_distinct(F.transform(seeds, lambda s: s["key"])), person)


def with_parent(people: Column) -> Column:
    """Each person with the key of the one smallest strict superset of their key, or null."""

    def parent(p: Column) -> Column:
        hosts = F.filter(people, lambda q: (F.size(F.array_except(p["key"], q["key"])) == 0) & (F.size(F.array_distinct(p["key"])) < F.size(F.array_distinct(q["key"]))))
        least = F.array_min(F.transform(hosts, lambda q: F.size(q["key"])))
        nearest = F.filter(hosts, lambda q: F.size(q["key"]) == least)
        return F.when(F.size(nearest) == 1, F.get(nearest, F.lit(0))["key"])

    return F.transform(people, lambda p: F.replaced(p, PERSON, parent=parent(p)))


def folded(parented: Column) -> Column:
    """Hosts with the variants of all that fold into them; sources and role stay the host's. Each
    step doubles the way a person looks up, so names of up to sixteen tokens reach their host."""
    up = F.transform(parented, lambda p: F.struct(p["key"].alias("key"), F.coalesce(p["parent"], p["key"]).alias("root")))
    for _ in range(4):
        up = F.bound(up, "array<struct<key:array<string>,root:array<string>>>", lambda u: F.transform(u, lambda p: F.struct(p["key"].alias("key"), F.get(F.filter(u, lambda q: q["key"] == p["root"]), F.lit(0))["root"].alias("root"))))

    def with_guests(rooted: Column) -> Column:
        guests = lambda p: F.filter(rooted, lambda r: (r["root"] == p["key"]) & (r["key"] != p["key"]))
        variants = lambda p: F.flatten(F.transform(guests(p), lambda r: F.get(F.filter(parented, lambda q: q["key"] == r["key"]), F.lit(0))["variants"]))
        hosts = F.filter(parented, lambda p: p["parent"].isNull())
        return F.transform(hosts, lambda p: F.replaced(p, PERSON, variants=F.array_distinct(F.concat(p["variants"], variants(p)))))

    kind = "array<struct<key:array<string>,display:string,role:string,variants:array<string>,sources:array<string>,seq:bigint>>"
    return F.bound(up, kind, with_guests)


def judge_keys(protections: Column) -> Column:
    return F.array_distinct(F.transform(F.filter(protections, lambda x: x["protection"] == "judge"), lambda x: judge_key(x["text"])))


def conflicts(people: Column, judges: Column, sources: list[str] = STRICT) -> Column:
    """Keys of judges that are private persons too, by their sources."""
    private = F.filter(people, lambda p: F.exists(p["sources"], lambda x: listed(x, sources)))
    return F.array_intersect(F.transform(private, lambda p: F.array_join(p["key"], " ")), judges)


def role_conflicts(people: Column, judges: Column) -> Column:
    """A warning for each person who is a judge and a private party."""
    both = F.filter(people, lambda p: F.array_contains(judges, F.array_join(p["key"], " ")) & F.exists(p["sources"], lambda x: listed(x, BROAD)))
    return F.array_distinct(F.transform(both, lambda p: F.concat(F.lit("both a judge and a private party: '"), p["display"], F.lit("'"))))


def renumbered(seeds: Column) -> Column:
    return F.transform(seeds, lambda s, i: F.replaced(s, ["surface", "key", "role", "rank", "source"], seq=i.cast("bigint")))


def without_judges(people: Column, judges: Column, keep_judges: bool) -> Column:
    """People without those that only a title or a first name speaks for, where a judge has the name."""
    if not keep_judges:
        return people
    return F.filter(people, lambda p: ~(~F.exists(p["sources"], lambda x: ~listed(x, NEUTRAL)) & F.array_contains(judges, F.array_join(p["key"], " "))))


def name_orders(value: Column) -> Column:
    """The spelling, its reverse and its rotations."""
    t = F.split(value, r"\s+")
    turn = F.transform(F.sequence(F.lit(0), F.size(t) - 1), lambda i: F.array_join(F.concat(F.slice(t, i + 1, F.size(t)), F.slice(t, F.lit(1), i)), " "))
    return F.array_distinct(F.concat(turn, F.array(F.array_join(F.reverse(t), " "))))


def ambiguous_tokens(people: Column, lexicons: Lexicons, least: int) -> Column:
    """Lower-case tokens that several people own."""
    owned = F.flatten(F.transform(people, lambda p: F.array_distinct(F.transform(rare_tokens(p["display"], lexicons, least), lambda t: F.lower(t)))))
    return F.array_sort(F.array_distinct(F.filter(owned, lambda t: F.size(F.filter(owned, lambda u: u == t)) > 1)))


def alternatives(values: Column) -> Column:
    """A pattern of quoted values, long ones first; one that never matches, for none."""
    ordered = F.transform(F.array_sort(F.transform(values, lambda v: F.struct((-F.length(v)).alias("n"), v.alias("v")))), lambda x: quoted(x["v"]))
    return F.when(F.size(values) > 0, F.concat(F.lit("(?:"), F.array_join(ordered, "|"), F.lit(")" + END))).otherwise(F.lit(r"(?!)"))


def _numbered(spans: Column) -> Column:
    return F.transform(spans, lambda x, i: F.replaced(x, FIELDS, seq=x["seq"] + i))


def person_candidates(text: Column, people: Column, ambiguous: Column, cfg: Config, lexicons: Lexicons) -> Column:
    """Full names in any order and case, and distinctive tokens alone, case-sensitively."""
    def propose(p: Column) -> Column:
        label = lambda x: p["role"]
        value = lambda x: p["display"]
        source = lambda x: F.array_join(p["sources"], "+")
        usable = F.filter(F.array_distinct(F.concat(p["variants"], F.array(p["display"]))), lambda v: (F.size(F.split(v, r"\s+")) > 1) | (F.size(rare_tokens(v, lexicons, cfg.min_token_len)) > 0))
        names = F.array_distinct(F.flatten(F.transform(usable, name_orders)))
        full = candidates(find(text, alternatives(names), LIMIT, "(?Udiu)"), "people", kind="PERSON", source=source, priority=FULL_NAME, reason="resolved full-name alias", role=label, label=label, value=value)
        rare = F.filter(rare_tokens(p["display"], lexicons, cfg.min_token_len), lambda t: ~F.array_contains(ambiguous, F.lower(t)))
        forms = F.array_distinct(F.flatten(F.transform(rare, lambda t: F.array(t, F.concat(F.upper(F.substring(t, 1, 1)), F.lower(F.substring(t, F.lit(2), F.length(t)))), F.upper(t)))))
        token = candidates(find(text, alternatives(forms), LIMIT), "people", kind="PERSON", source=source, priority=TOKEN, reason="unique distinctive alias", role=label, label=label, value=value)
        return F.concat(full, token)

    return _numbered(F.flatten(F.transform(people, propose)))


def ambiguous_candidates(text: Column, ambiguous: Column) -> Column:
    one = lambda t: candidates(find(text, F.concat(quoted(t), F.lit(END)), LIMIT, "(?Udiu)"), "ambiguous", kind="PERSON", source="alias:ambiguous", priority=TOKEN, reason="alias belongs to multiple detected identities", role="Nominativo", label="Nominativo", value=lambda x: t)
    return _numbered(F.flatten(F.transform(ambiguous, one)))


def given_candidates(d: Doc, people: Column, cfg: Config, lexicons: Lexicons) -> Column:
    """The listed first name alone of exactly one person, where it is no distinctive token: in its
    usual case forms and as the person's variants spell it, where nothing beside it makes it part of
    another name or of a place's."""
    if not cfg.first_names:
        return F.array().cast(f"array<{CANDIDATE}>")

    def own(p: Column) -> Column:
        rare = F.transform(rare_tokens(p["display"], lexicons, cfg.min_token_len), lambda t: F.lower(t))
        plain = F.filter(F.array_distinct(F.transform(F.split(p["display"], r"\s+"), lambda t: F.lower(t))), lambda t: listed(t, lexicons.first_names) & ~F.array_contains(rare, t))
        spelled = lambda t: F.filter(F.flatten(F.transform(p["variants"], lambda v: F.split(v, r"\s+"))), lambda w: F.lower(w) == t)
        return F.transform(plain, lambda t: F.struct(t.alias("t"), p["display"].alias("display"), p["role"].alias("role"), p["sources"].alias("sources"), spelled(t).alias("spelled")))

    def alone(x: Column) -> Column:
        left, right = before(d.text, x["start"], 40), after(d.text, x["end"], 40)
        greeted = left.rlike(rf"{R.GREETING}$")
        return ~named_place(d, x) & ~right.rlike(rf"^{R.GAP}{R.NAME}") & (greeted | ~left.rlike(rf"{R.NAME}{R.GAP}$"))

    def propose(o: Column) -> Column:
        forms = F.array_distinct(F.concat(F.array(F.concat(F.upper(F.substring(o["t"], 1, 1)), F.substring(o["t"], F.lit(2), F.length(o["t"]))), F.upper(o["t"])), o["spelled"]))
        hits = F.filter(find(d.text, F.concat(alternatives(forms), F.lit("(?!['’])")), LIMIT + "(?<!['’])"), alone)
        return candidates(hits, "given", kind="PERSON", source=lambda x: F.concat(F.array_join(o["sources"], "+"), F.lit("+given_name")), priority=TOKEN, reason="given name of one detected person", role=lambda x: o["role"], label=lambda x: o["role"], value=lambda x: o["display"])

    def unique(owned: Column) -> Column:
        return F.array_sort(F.filter(owned, lambda o: F.size(F.filter(owned, lambda q: q["t"] == o["t"])) == 1))

    kind = "array<struct<t:string,display:string,role:string,sources:array<string>,spelled:array<string>>>"
    once_ = F.bound(F.flatten(F.transform(people, own)), kind, unique)
    return _numbered(F.flatten(F.transform(once_, propose)))
