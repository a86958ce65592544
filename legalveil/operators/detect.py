"""Detectors: each proposes spans, in the document's own row, from the catalogue of rules."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple


from ..functions import sql as F
from ..functions.sql import Expr as Column
from ..config import Config
from ..functions import checks
from ..functions.lexicons import Lexicons
from ..functions.spans import after, before, find, inside, none, reach
from . import rules as R
from .normalize import initials_key, place_key

CANDIDATE = "struct<start:int,end:int,text:string,kind:string,source:string,reason:string,priority:int,seq:bigint,role:string,label:string,value:string,protection:string>"
FIELDS = [f.partition(":")[0] for f in CANDIDATE[7:-1].split(",")]
SEED = "struct<surface:string,key:array<string>,role:string,rank:int,source:string,seq:bigint>"
RANK = {"Ricorrente": 0, "Resistente": 1, "Difensore": 2, "Nominativo": 3}
USER, STRUCTURED, PROTECTED, ADDRESS, COMPANY, FULL_NAME, TOKEN = 200, 120, 100, 40, 35, 30, 20
ORDER = {k: i * 1_000_000 for i, k in enumerate(["keep", "protect", "people", "ambiguous", "given", "initials", "structured", "address", "place", "company", "term", "include"])}


class Doc(NamedTuple):
    """A text and its lower case, in which rules look for their anchors."""

    text: Column
    low: Column

    def has(self, anchors: Sequence[str]) -> Column:
        return reduce(lambda a, b: a | b, (self.low.contains(x) for x in anchors))

    def find(self, core: str, pre: str = "", anchors: Sequence[str] = (), shape: str = "") -> Column:
        """spans.find, where the text holds an anchor and the shape."""
        found = find(self.text, core, pre)
        if shape:
            found = F.when(self.text.rlike(shape), found).otherwise(none())
        return F.when(self.has(anchors), found).otherwise(none()) if anchors else found

    def reach(self, r: R.Reach) -> Column:
        return reach(self.text, self.find(r.cue, anchors=r.anchors), r.most, r.stop)


def doc(text: Column, low: Column | None = None) -> Doc:
    return Doc(text, F.lower(text) if low is None else low)


def listed(value: Column, values: Sequence[str]) -> Column:
    """Whether a word list holds the value: a hashed set in the plan."""
    return value.isin(*values)


def joined(parts: list[Column]) -> Column:
    return F.concat(*parts)


def candidates(spans: Column, order: str, *, kind, source, priority: int, reason="", role=None, label=None, value=None, protection=None) -> Column:
    """Spans as candidates; kind, source, label and value may be functions of the span."""
    at = lambda v, x: v(x) if callable(v) else F.lit(v).cast("string")
    return F.transform(spans, lambda x, i: F.struct(
        x["start"].alias("start"), x["end"].alias("end"), x["text"].alias("text"), at(kind, x).alias("kind"), at(source, x).alias("source"), F.lit(reason).alias("reason"),
        F.lit(priority).alias("priority"), (F.lit(ORDER[order]) + i).cast("bigint").alias("seq"), at(role, x).alias("role"), at(label, x).alias("label"),
        (at(value, x) if value is not None else x["text"]).alias("value"), at(protection, x).alias("protection")))


def labelled(spans: Column, label: str) -> Column:
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["text"].alias("text"), F.lit(label).alias("label")))


# structured identifiers -------------------------------------------------------------------------
def structured_spans(d: Doc, lexicons: Lexicons) -> Column:
    """array<struct<start, end, text, label>> in the order of the catalogue."""
    parts = []
    for rule in R.STRUCTURED:
        s = d.find(rule.core, rule.pre, rule.anchors, rule.shape)
        if rule.label == "CF":
            s = F.filter(s, lambda x: checks.tax_code_ok(x["text"]))
        elif rule.label == "Iban":
            s = F.filter(s, lambda x: checks.iban_ok(x["text"]))
        elif rule.label in ("Pec", "Email"):
            s = F.filter(s, lambda x: ~checks.public_mailbox(x["text"], lexicons.first_names))
        parts.append(labelled(s, rule.label))
    number = F.transform(d.reach(R.REGISTER), lambda w: F.slice(inside(F.array(w), R.REGISTER_NUMBER[1], R.REGISTER_NUMBER[0]), 1, 1))
    parts.insert(next(i for i, r in enumerate(R.STRUCTURED) if r.label == "Targa"), labelled(F.array_distinct(F.flatten(number)), "Albo"))
    return joined(parts)


def structured(d: Doc, lexicons: Lexicons) -> Column:
    return candidates(structured_spans(d, lexicons), "structured", kind=lambda x: F.upper(x["label"]), source=lambda x: F.concat(F.lit("regex:"), F.lower(x["label"])), priority=STRUCTURED, reason="structured identifier", role=lambda x: x["label"], label=lambda x: x["label"])


# what is kept -----------------------------------------------------------------------------------
def name_key(text: Column) -> Column:
    """Sorted lower-case letter runs: the identity that a spelling stands for."""
    return F.sort_array(F.transform(F.regexp_extract_all(text, F.lit(r"([\p{L}'’]+)"), F.lit(1)), lambda t: F.lower(t)))


def without_role(name: Column) -> Column:
    """A judge's name without the role word that a table has in its next column."""
    return F.regexp_replace(name, rf"\s+{R.JUDICIAL}$", "")


def plausible_judge(x: Column) -> Column:
    name = without_role(x["text"])
    n = F.size(F.split(F.trim(name), r"\s+"))
    return n.between(2, 4) & ~name.rlike(rf"^{R.PUBLIC}") & ~name.rlike("[0-9]") & ~name.rlike(rf"^{R.JUDICIAL}$")


def bench_spans(d: Doc) -> Column:
    names = joined([inside(d.reach(b), rf"{R.FULL}(?!\p{{L}})", r"(?<![\p{L}'’])") for b in R.BENCHES])
    return F.filter(names, lambda x: ~x["text"].rlike(R.ORGANISATION))


def protections(d: Doc) -> Column:
    """array<struct<start, end, text, protection>>: judges and case numbers; where both claim one
    span it is a case number."""
    doctor = F.transform(d.reach(R.CLAUSED), lambda w: F.slice(F.filter(inside(F.array(w), R.FULL, rf"{R.OPEN}{R.DOCTOR}\s*"), lambda x: x["start"] - w["start"] <= R.CLAUSED_MOST + 12), 1, 1))
    judges = joined([d.find(j.core, j.pre, j.anchors) for j in R.JUDGES] + [F.flatten(doctor), bench_spans(d)])
    judges = F.filter(judges, plausible_judge)
    cases = joined([d.find(c.core, c.pre, c.anchors) for c in R.CASES])
    tag = lambda spans, kind: F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["text"].alias("text"), F.lit(kind).alias("protection")))
    judges = F.filter(judges, lambda j: ~F.exists(cases, lambda c: (c["start"] == j["start"]) & (c["end"] == j["end"])))
    return F.array_sort(F.array_distinct(F.concat(tag(judges, "judge"), tag(cases, "case_number"))))


def judge_key(text: Column) -> Column:
    return F.array_join(name_key(without_role(text)), " ")


def protected(spans: Column, conflicts: Column, cfg: Config) -> Column:
    """Keeps as candidates, without judges whose identity is also a private party's."""
    kinds = [k for k, on in (("judge", cfg.keep_judges), ("case_number", cfg.keep_case_numbers)) if on]
    kept = F.filter(spans, lambda x: x["protection"].isin(*kinds) if kinds else F.lit(False))
    kept = F.filter(kept, lambda x: (x["protection"] != "judge") | ~F.array_contains(conflicts, judge_key(x["text"])))
    return candidates(kept, "protect", kind=lambda x: F.when(x["protection"] == "judge", "JUDGE").otherwise("CASE_NUMBER"), source=lambda x: F.concat(F.lit("legal_role:"), x["protection"]), priority=PROTECTED, reason="public role or procedural number", role=lambda x: F.when(x["protection"] == "judge", "Giudice").otherwise("Numero"), protection=lambda x: x["protection"])


# person seeds -----------------------------------------------------------------------------------
def rare_tokens(name: Column, lexicons: Lexicons, least: int) -> Column:
    """Tokens of a name that can be looked for alone."""
    tokens = F.transform(F.split(name, r"[\s\-]+"), lambda t: F.btrim(t, F.lit(".,;:()'’")))
    return F.filter(tokens, lambda t: (F.length(t) >= least) & ~t.rlike("[0-9]") & ~listed(F.lower(t), lexicons.common_words) & ~listed(t, R.RESERVED))


def in_organisation(d: Doc, x: Column) -> Column:
    """Whether the text goes on into an organisation's name: its legal form behind, a capitalised
    word and a preposition in front, or a bank or an institute with a word at most between."""
    front = before(d.text, x["start"], 60)
    of = rf"\p{{Lu}}[\p{{L}}'’.]*{R.GAP}(?:{R.fold('d(?:i|el|ell[aoe]|ei|egli)', 'dell[’]', 'd[’]')}|{R.fold('dell', 'd')}['’]){R.SP}*$"
    head = rf"{R.OPEN}{R.fold('istitut[oi]', 'banc[ao]', 'cassa', 'credito')}{R.GAP}(?:\p{{Lu}}[\p{{L}}'’.]*{R.GAP})?$"
    return after(d.text, x["end"], 14).rlike(rf"^{R.SP}*,?{R.SP}*{R.SUFFIX}") | front.rlike(of) | front.rlike(head)


def named_place(d: Doc, x: Column) -> Column:
    """A street word or a saint right in front."""
    return before(d.text, x["start"], 40).rlike(rf"{R.OPEN}(?:{R.STREET_WORD}{R.GAP}(?:{R.fold('d(?:i|el|ell[aoe]|ei|egli)')}{R.GAP}|{R.fold('dell')}['’]{R.SP}*)?|{R.fold('san', 'santo', 'santa', 'ss[.]', 's[.]')}{R.GAP}|{R.fold('sant')}['’]{R.SP}*)$")


def goes_on(line: Column, lexicons: Lexicons) -> Column:
    """Whether a line's words read as the rest of a name that wrapped."""
    tokens = F.transform(F.regexp_extract_all(line, F.lit(f"({R.NAME})"), F.lit(1)), lambda t: F.lower(t))
    return (F.size(tokens) > 0) & ~F.exists(tokens, lambda t: listed(t, R.HEADINGS) | (listed(t, lexicons.common_words) & ~listed(t, lexicons.first_names)))


def one_name(d: Doc, x: Column, lexicons: Lexicons, ahead: bool) -> Column:
    """A wrapped capture keeps the line next to the evidence, and further ones as long as they go
    on with the name; a line that ends in a colon is a label."""
    lines = F.split(x["text"], rf"{R.SP}*\n{R.SP}*")
    lines = F.reverse(lines) if ahead else lines
    label = F.lit(False) if ahead else after(d.text, x["end"], 12).rlike(rf"^{R.SP}*:")
    last = F.size(lines) - 1
    put = (lambda a, line: F.concat_ws(" ", line, a)) if ahead else (lambda a, line: F.concat_ws(" ", a, line))
    start = F.struct(F.element_at(lines, 1).alias("out"), F.lit(True).alias("on"), F.lit(1).alias("i"))

    def step(a: Column, line: Column) -> Column:
        on = a["on"] & goes_on(line, lexicons) & ~((a["i"] == last) & label)
        return F.struct(F.when(on, put(a["out"], line)).otherwise(a["out"]).alias("out"), on.alias("on"), (a["i"] + 1).alias("i"))

    whole = F.aggregate(F.slice(lines, F.lit(2), F.greatest(last, F.lit(0))), start, step, lambda a: a["out"])
    return F.when(x["text"].contains("\n"), whole).otherwise(x["text"])


def cleaned(name: Column) -> Column:
    """Single blanks, no marks at the edges, cut at the first heading or role word but the first."""
    tokens = F.split(F.btrim(F.regexp_replace(name, r"\s+", " "), F.lit(" .,;:-–'’")), " ")
    stop = F.array_position(F.transform(F.slice(tokens, F.lit(2), F.size(tokens)), lambda t: listed(F.lower(F.btrim(t, F.lit(".,;:"))), R.HEADINGS)), True)
    return F.array_join(F.slice(tokens, F.lit(1), F.when(stop > 0, stop.cast("int")).otherwise(F.size(tokens))), " ")


def good_seed(x: Column, lexicons: Lexicons, least: int = 4) -> Column:
    """The guards of a proposed name, in terms of its surface and the rule's demands."""
    s = x["surface"]
    tokens = F.split(s, " ")
    n = F.size(tokens)
    first, last = F.lower(F.element_at(tokens, 1)), F.lower(F.element_at(tokens, -1))
    rare = F.size(rare_tokens(s, lexicons, least)) > 0
    alone = x["single"] & (rare | (x["given"] & listed(first, lexicons.first_names)))
    shape = F.when(n == 1, alone).otherwise(n.between(2, 4)) & (~x["distinctive"] | rare)
    body = s.rlike(R.ORGANISATION) | s.rlike(rf"{R.OPEN}{R.SUFFIX}") | s.rlike(rf"^{R.STREET_WORD}{R.SHUT}")
    slice_ = listed(first, R.NO_HEAD) | listed(last, R.NO_TAIL)
    own = F.exists(tokens, lambda t: listed(F.regexp_replace(t, "[_0-9]+$", ""), R.RESERVED))
    return (s != "") & shape & ~body & ~slice_ & ~own


RAW = "array<struct<start:int,end:int,text:string,role:string,source:string,single:boolean,distinctive:boolean,given:boolean,ahead:boolean>>"


def proposals(spans: Column, source, role, single=False, distinctive=False, given=False, ahead=False) -> Column:
    """Spans with what a rule demands of them; source and role may be functions of the span."""
    at = lambda v, x: v(x) if callable(v) else F.lit(v)
    return F.transform(spans, lambda x: F.struct(
        x["start"].alias("start"), x["end"].alias("end"), x["text"].alias("text"), at(role, x).alias("role"), at(source, x).alias("source"), F.lit(single).alias("single"),
        F.lit(distinctive).alias("distinctive"), F.lit(given).alias("given"), F.lit(ahead).alias("ahead")))


def accepted(d: Doc, raw: Column, lexicons: Lexicons, least: int) -> Column:
    """array<SEED> of proposals: their surface cleaned and cut to one name, and past the guards."""
    whole = lambda x: F.when(~x["text"].contains("\n"), x["text"]).when(x["ahead"], one_name(d, x, lexicons, True)).otherwise(one_name(d, x, lexicons, False))
    named = F.transform(raw, lambda x: F.struct(cleaned(whole(x)).alias("surface"), *(x[f].alias(f) for f in ("role", "source", "single", "distinctive", "given"))))
    rank = lambda x: reduce(lambda a, r: a.when(x["role"] == r, RANK[r]), list(RANK)[1:], F.when(x["role"] == "Ricorrente", 0)).otherwise(3)
    good = F.filter(named, lambda x: good_seed(x, lexicons, least))
    return F.transform(good, lambda x, i: F.struct(x["surface"].alias("surface"), name_key(x["surface"]).alias("key"), x["role"].alias("role"), rank(x).alias("rank"), x["source"].alias("source"), i.cast("bigint").alias("seq")))


TOKEN_FIELDS = {"start": "int", "end": "int", "low": "string", "text": "string", "caps": "boolean", "given": "boolean", "plain": "boolean"}


def listed_names(d: Doc, lexicons: Lexicons) -> Column:
    """Spans of names with a listed first name: it, another one or a particle, and a surname that is
    neither listed nor common; or, in capitals, the surname first. A name may wrap where the next
    line goes on with it in the same case."""
    t = find(d.text, R.NAME, r"(?<![\p{L}'’])")
    keyed = F.transform(t, lambda x: F.replaced(x, ["start", "end", "text"], low=F.lower(x["text"]), caps=F.upper(x["text"]) == x["text"]))
    keyed = F.transform(keyed, lambda x: F.replaced(x, ["start", "end", "low", "text", "caps"], given=listed(x["low"], lexicons.first_names), plain=listed(x["low"], lexicons.common_words)))

    kind = "struct<" + ",".join(f"{n}:{t}" for n, t in TOKEN_FIELDS.items()) + ">"
    span = "array<struct<start:int,end:int>>"
    places_ = ("a", "b", "c", "p", "q")  # this token, the next two and the two before

    def beside(a: Column, b: Column) -> Column:
        """0 for tokens apart, 1 side by side, 2 over a line break."""
        gap = F.substring(d.text, a["end"] + 1, b["start"] - a["end"])
        wrapped = (a["caps"] == b["caps"]) & goes_on(b["text"], lexicons) & ~after(d.text, b["end"], 12).rlike(rf"^{R.SP}*:")
        return F.when(a.isNull() | b.isNull(), 0).when(~(b["start"] - a["end"]).between(1, 40), 0).when(gap.rlike(rf"^{R.SP}+$"), 1).when(gap.rlike(rf"^{R.SP}*\n{R.SP}*$") & wrapped, 2).otherwise(0)

    def names(near: Column) -> Column:
        """Spans of the names that a listed token belongs to, from its neighbours and their gaps."""
        a, b, c, p, q = (near[n] for n in places_)
        surname = lambda x: F.coalesce(~x["given"] & ~x["plain"] & ~listed(x["low"], R.HEADINGS), F.lit(False))
        two, three, behind, first = near["ab"], near["bc"], near["pa"], near["qp"]
        particle = listed(b["low"], R.PARTICLES)
        end = F.when((two == 1) & b["given"] & (b["low"] != a["low"]) & (three > 0) & surname(c), c["end"]).when((two > 0) & ~b["given"] & particle & (three > 0) & surname(c), c["end"]).when((two > 0) & surname(b) & ~particle, b["end"])
        caps = F.coalesce((behind > 0) & a["caps"] & p["caps"], F.lit(False)) & surname(p)
        start = F.when((first > 0) & F.coalesce(listed(q["low"], R.PARTICLES), F.lit(False)), q["start"]).otherwise(p["start"])
        stop = F.when(F.coalesce((two == 1) & b["caps"] & b["given"], F.lit(False)), b["end"]).otherwise(a["end"])
        return F.filter(F.array(F.struct(a["start"].alias("start"), end.alias("end")), F.struct(F.when(caps, start).alias("start"), stop.alias("end"))), lambda s: s["start"].isNotNull() & s["end"].isNotNull())

    def scan(all_: Column) -> Column:
        at = lambda i, k: F.when(i + k >= 0, F.get(all_, i + k))
        hits = F.filter(F.transform(all_, lambda x, i: F.when(x["given"], i)), lambda i: i.isNotNull())
        five = lambda i: F.struct(*(at(i, k).alias(n) for n, k in zip(places_, (0, 1, 2, -1, -2), strict=True)))
        gaps = lambda t: F.struct(*(t[n].alias(n) for n in places_), beside(t["a"], t["b"]).alias("ab"), beside(t["b"], t["c"]).alias("bc"), beside(t["p"], t["a"]).alias("pa"), beside(t["q"], t["p"]).alias("qp"))
        tokens = ",".join(f"{n}:{kind}" for n in places_)
        one = lambda i: F.bound(F.bound(five(i), f"struct<{tokens},ab:int,bc:int,pa:int,qp:int>", gaps), span, names)
        return F.array_distinct(F.flatten(F.transform(hits, one)))

    nowhere = F.array().cast("array<struct<start:int,end:int>>")
    found = F.bound(keyed, "array<struct<start:int,end:int>>", lambda all_: F.when(F.exists(all_, lambda x: x["given"]), scan(all_)).otherwise(nowhere))
    spans = F.transform(found, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.substring(d.text, x["start"] + 1, x["end"] - x["start"]).alias("text")))
    place = lambda x: listed(place_key(x["text"]), lexicons.towns) | listed(place_key(x["text"]), lexicons.regions)
    return F.filter(spans, lambda x: ~in_organisation(d, x) & ~named_place(d, x) & ~place(x))


def block_spans(d: Doc) -> Column:
    """Names in capitals within a party block, with ``role``; a run of capitals ends where a body, an
    organisation or a legal form begins."""
    cue, window, anchors = R.PARTY_BLOCK
    cut = rf"(?s)(?:{R.ORGANISATION}|{R.OPEN}{R.SUFFIX}).*$"

    def block(w: Column) -> Column:
        respondent = before(d.text, w["start"], 40).rlike(rf"{R.fold('contro', 'confronti')}[^.]*$")
        runs = F.transform(find(w["text"], R.CAPITALS), lambda r: F.struct((r["start"] + w["start"]).alias("start"), r["end"].alias("end"), F.regexp_replace(r["text"], cut, "").alias("text")))
        return F.transform(inside(runs, R.CAPITAL_NAME), lambda x: F.replaced(x, ["start", "end", "text"], role=F.when(respondent, "Resistente").otherwise("Ricorrente")))

    return F.flatten(F.transform(d.find(window, cue, anchors), block))


def seeds(d: Doc, cfg: Config, lexicons: Lexicons) -> Column:
    """array<SEED>: every name that evidence proposes, after the guards."""
    parts = []
    add = lambda *args, **more: parts.append(proposals(*args, **more))
    for rule in R.SEEDS:
        spans = d.find(rule.core, rule.pre, rule.anchors, "[A-Z][0-9]{3}[A-Z]" if rule.source == "regex:cf_adiacente" else "")
        if rule.org_prone or rule.source.endswith("_solo"):
            spans = F.filter(spans, lambda x: ~in_organisation(d, x))
        add(spans, rule.source, rule.role, single=rule.single, distinctive=rule.distinctive, ahead=rule.ahead)
    for rule in R.LISTS:
        spans = F.filter(d.find(rule.core, rule.pre, rule.anchors), lambda x: ~in_organisation(d, x))
        add(inside(spans, R.FULL), rule.source, rule.role)
    if cfg.profile != "query":
        add(block_spans(d), "regex:legal_party_block", lambda x: x["role"])
    known = lambda x: listed(F.lower(F.element_at(F.split(x["text"], r"\s+"), 1)), lexicons.first_names) if cfg.first_names else F.lit(False)
    kin = d.find(R.KIN.core, R.KIN.pre, R.KIN.anchors)
    add(F.filter(kin, lambda x: known(x) | x["text"].rlike(r"^\p{Lu}")), R.KIN.source, R.KIN.role, single=True, given=cfg.first_names)
    if cfg.first_names:
        for pre, core, anchors in R.GREETED:
            add(F.filter(d.find(core, pre, anchors), known), "regex:saluto", "Nominativo", single=True, given=True)
        add(listed_names(d, lexicons), "lexicon:first_name", "Nominativo")
    return accepted(d, joined(parts), lexicons, cfg.min_token_len)


def mention_seeds(d: Doc, mentions: Column, lexicons: Lexicons, least: int) -> Column:
    """Seeds of mentions from outside (array of struct start, end, role, source), as of a model: the
    surface is read from the text at their offsets, and passes the same guards as any other."""
    ok = F.filter(mentions, lambda m: (m["start"] >= 0) & (m["end"] > m["start"]) & (m["end"] <= F.length(d.text)))
    spans = F.transform(ok, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.substring(d.text, m["start"] + 1, m["end"] - m["start"]).alias("text"), m["role"].alias("role"), m["source"].alias("from")))
    return accepted(d, proposals(spans, lambda x: x["from"], lambda x: x["role"], single=True), lexicons, least)


# the rest ---------------------------------------------------------------------------------------
def addresses(d: Doc) -> Column:
    """Residential, studio and property addresses within reach of a personal cue, addresses alone on
    a line, and those in front of a studio; none of a public body or a company."""
    clause = lambda x, n: F.element_at(F.split(before(d.text, x["start"], n), ";"), -1)
    office = lambda x: F.concat_ws(" ", clause(x, 180), x["text"], F.element_at(F.split(after(d.text, x["end"], 60), ";"), 1)).rlike(rf"{R.fold('avvocatura')}|{R.fold('segreteria', 'cancelleria')}\s+{R.fold('d')}")
    block = lambda x: F.element_at(F.split(before(d.text, x["start"], 300), r"\n[^\S\n]*\n"), -1)
    theirs = lambda t: t.rlike(R.PUBLIC) | t.rlike(rf"{R.OPEN}{R.SUFFIX}")

    def near(w: Column) -> Column:
        cue = before(d.text, w["start"], 14)
        seat = cue.rlike(rf"{R.PROPERTY}$") & theirs(before(d.text, w["start"], 54))
        first = F.slice(F.filter(inside(F.array(w), R.ADDRESS, r"(?<![\p{L}.\d])"), lambda x: x["start"] - w["start"] <= R.DWELLING_MOST), 1, 1)
        return F.when(seat, none()).otherwise(first)

    home = F.filter(F.array_distinct(F.flatten(F.transform(d.reach(R.DWELLING), near))), lambda x: ~office(x))
    line = d.find(rf"{R.ADDRESS}(?={R.SP}*(?:[,–-]{R.SP}*[0-9]{{5}}(?!\d)[^\n]*)?(?:\n|\z))", rf"(?m)^{R.SP}*", R.STREET_ANCHORS)
    line = F.filter(line, lambda x: ~theirs(block(x)) & ~office(x))
    studio = d.find(rf"{R.STREET}(?={R.SP}*,?{R.SP}*{R.fold('nel', 'presso')}(?:\s+{R.fold('il')})?\s+{R.fold('mio', 'suo', 'proprio')}\s+{R.fold('studio')})", "", ("studio",))
    make = lambda s, source, reason: candidates(s, "address", kind="ADDRESS", source=source, priority=ADDRESS, reason=reason, role="Indirizzo", label="Indirizzo", value=lambda x: F.regexp_replace(x["text"], r"\s+", " "))
    return F.concat(make(home, "regex:residential_address", "address behind a personal cue"), make(studio, "regex:studio_address", "address of the writer's studio"), make(line, "regex:address_line", "address alone on its line"))


def places(d: Doc, lexicons: Lexicons) -> Column:
    """The longest run of words of a biographic slot that is a listed town, or a foreign birthplace
    with its country in brackets."""

    def town(x: Column) -> Column:
        tokens = F.regexp_extract_all(x["text"], F.lit(r"(\s*\S+)"), F.lit(1))
        prefixes = F.transform(F.sequence(F.size(tokens), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(tokens, F.lit(1), n), ""))
        best = F.get(F.filter(prefixes, lambda p: listed(place_key(p), lexicons.towns)), F.lit(0))
        abroad = after(d.text, x["end"], 60).rlike(rf"^{R.SP}*\(\p{{Lu}}[\p{{L}}'’]+(?:\s+\p{{L}}[\p{{L}}'’]+){{0,3}}\)") & ~after(d.text, x["end"], 60).rlike(rf"^{R.SP}*\(\p{{Lu}}{{2}}\)")
        born = before(d.text, x["start"], 40).rlike(rf"{R.OPEN}{R.fold('nat[oaie]')}[^.;,]*$")
        best = F.when(best.isNull() & abroad & born, x["text"]).otherwise(best)
        return F.struct(x["start"].alias("start"), (x["start"] + F.length(best)).alias("end"), best.alias("text"))

    spans = F.filter(F.transform(d.find(R.PLACE, R.PLACE_CUE, R.PLACE_ANCHORS), town), lambda x: x["text"].isNotNull())
    return candidates(spans, "place", kind="PLACE", source="regex:place", priority=ADDRESS, reason="town of birth or residence", role="Luogo", label="Luogo")


def companies(d: Doc, cfg: Config) -> Column:
    """Private companies by their legal form; by policy all, or those named after persons: with a
    word for a family in the name or in front of it on the line, or two joined surnames."""
    if not cfg.companies:
        return F.array().cast(f"array<{CANDIDATE}>")
    intro = rf"^(?:{R.fold('d(?:i|el|ell[aoe]|ei|egli)', 'il', 'lo', 'la', 'le', 'gli', 'e')}\s+)+"
    society = rf"^{R.fold('societ[àa]')}\s+"

    def trimmed(x: Column) -> Column:
        bare = F.regexp_replace(x["text"], intro, "")
        return F.struct((x["end"] - F.length(bare)).alias("start"), x["end"].alias("end"), bare.alias("text"))

    def person_named(x: Column) -> Column:
        name = F.regexp_replace(x["text"], society, "")
        inner = F.regexp_replace(name, rf"{R.FAMILY}", " ")
        own = name.rlike(R.FAMILY) & F.regexp_replace(inner, rf"\s{R.SUFFIX}$", "").rlike(R.NAME)
        line = F.element_at(F.split(before(d.text, x["start"], 100), "\n"), -1)
        bridge = F.regexp_extract(line, rf"({R.FAMILY}{R.BRIDGE})", 1)
        front = F.when(own, F.lit("")).otherwise(bridge)
        ok = own | (bridge != "") | name.rlike(R.PAIR)
        return F.struct((x["start"] - F.length(front)).alias("start"), x["end"].alias("end"), F.concat(front, x["text"]).alias("text"), ok.alias("person"))

    spans = F.transform(d.find(R.COMPANY, shape=R.COMPANY_SHAPE), trimmed)
    spans = F.filter(spans, lambda x: ~F.regexp_replace(x["text"], society, "").rlike(rf"^{R.PUBLIC}") & ~x["text"].rlike(rf"^{R.SUFFIX}$"))
    spans = F.transform(spans, person_named)
    if cfg.companies == "person_named":
        spans = F.filter(spans, lambda x: x["person"])
    return candidates(spans, "company", kind="ORGANIZATION", source=lambda x: F.when(x["person"], "regex:person_named_company").otherwise("regex:private_company"), priority=COMPANY, reason="private company", role="Società", label="Società", value=lambda x: F.regexp_replace(x["text"], r"\s+", " "))


def initials(d: Doc, cfg: Config, lexicons: Lexicons) -> Column:
    """Initials in place of names: behind a cue, whose role every recurrence takes; or everywhere.
    References, sigle, judges' and organisations' are none, nor is what a surname follows. A full
    stop that ends the sentence is not theirs."""
    if not cfg.initials:
        return F.array().cast(f"array<{CANDIDATE}>")

    def free(x: Column) -> Column:
        front = before(d.text, x["start"], 60)
        line = F.element_at(F.split(front, "\n"), -1)
        next_ = F.lower(F.regexp_extract(after(d.text, x["end"], 60), rf"^{R.SP}+({R.NAME})", 1))
        surname = (next_ != "") & ~listed(next_, lexicons.common_words) & ~listed(next_, R.NO_HEAD) & ~listed(next_, R.HEADINGS)
        return ~listed(initials_key(x["text"]), lexicons.sigle) & ~front.rlike(R.REFERENCE_BEFORE) & ~after(d.text, x["end"], 40).rlike(R.REFERENCE_AFTER) & ~line.rlike(R.ROLE_BEFORE) & ~in_organisation(d, x) & ~surname

    token = lambda s: F.transform(inside(s, R.DOTTED), lambda x: x)
    anchored = F.concat(*(F.transform(token(find(d.text, core, pre)), lambda x, i=i, role=role: F.struct(x["start"].alias("start"), F.lit(i).alias("i"), initials_key(x["text"]).alias("key"), F.lit(role).alias("role"))) for i, (role, pre, core) in enumerate(R.INITIALS_CUES)))

    def make(named: Column) -> Column:
        first = lambda x: F.get(F.filter(named, lambda a: a["key"] == initials_key(x["text"])), F.lit(0))["role"]
        every = F.filter(find(d.text, R.INITIALS), free)
        every = F.transform(every, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["text"].alias("text"), first(x).alias("role")))
        kept = every if cfg.initials == "all" else F.filter(every, lambda x: x["role"].isNotNull())
        ends = lambda x: after(d.text, x["end"], 8).rlike(rf"^(?:{R.GAP}\p{{Lu}}|{R.SP}*(?:\n|\z))")
        return F.transform(kept, lambda x: F.struct(x["start"].alias("start"), F.when(ends(x), x["end"] - 1).otherwise(x["end"]).alias("end"), F.when(ends(x), F.regexp_replace(x["text"], r"\.$", "")).otherwise(x["text"]).alias("text"), F.coalesce(x["role"], F.lit("Nominativo")).alias("role"), F.when(x["role"].isNull(), "regex:initials_everywhere").otherwise("regex:initials").alias("from")))

    kind = "array<struct<start:int,end:int,text:string,role:string,from:string>>"
    spans = F.bound(F.array_sort(anchored), kind, make)
    return candidates(spans, "initials", kind="PERSON", source=lambda x: x["from"], priority=FULL_NAME, reason="initials in place of a name", role=lambda x: x["role"], label=lambda x: x["role"], value=lambda x: initials_key(x["text"]))
