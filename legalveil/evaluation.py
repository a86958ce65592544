"""Reports about runs and corpora: company policies, safety of fixtures, audits, projections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .operators import ner
from .plans.pseudonymize import analyze

POLICIES = {"keep": False, "person_named": "person_named", "all": True}
#: Markup of a page in the order in which it goes: what holds no text, breaks, any other tag.
HTML = [(r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>", " "), (r"(?is)<!--.*?-->", " "), (r"(?i)<(?:br|/p|/div|/li|/tr|/h[1-6])\s*/?>", "\n"), (r"<[^<>]+>", " "), (r"[ \t]+", " "), (r" ?\n[ \n]*", "\n")]
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]


def company_policies(docs: DataFrame, source: str = "source") -> DataFrame:
    """(source, policy, companies): companies that each policy redacts, of docs (doc_id, text, and the
    source's column)."""
    names = docs.select("doc_id", F.col(source).alias("source"))

    def one(policy: str) -> DataFrame:
        found = analyze(docs, companies=POLICIES[policy]).select("doc_id", F.size(F.filter("decisions", lambda x: (x["kind"] == "ORGANIZATION") & (x["action"] == "redact"))).alias("n"))
        return names.join(found, "doc_id").groupBy("source").agg(F.sum("n").alias("companies")).select("source", F.lit(policy).alias("policy"), "companies")

    return reduce(DataFrame.unionByName, map(one, POLICIES))


def tokens(name: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(name, F.lit(r"(\p{L}{2,})"), F.lit(1)), lambda t: F.lower(t)))


def fixture_scan(docs: DataFrame, bank: DataFrame) -> DataFrame:
    """(doc_id, kind, value): what a corpus of invented cases should not hold: words of people's names
    that are not in the bank (one column, lower case), tax codes and mail addresses."""
    a = analyze(docs)
    words = a.select("doc_id", F.explode("people").alias("p")).select("doc_id", F.explode(tokens(F.col("p.display"))).alias("value")).distinct()
    words = words.join(bank.select(F.col(bank.columns[0]).alias("value")).distinct(), "value", "left_anti").select("doc_id", F.lit("name").alias("kind"), "value")
    marks = a.select("doc_id", F.explode("decisions").alias("d")).filter("d.label in ('CF', 'Email', 'Pec')").select("doc_id", F.col("d.label").alias("kind"), F.col("d.value").alias("value"))
    return words.unionByName(marks.distinct())


def ner_audit(docs: DataFrame, models: dict, bank: DataFrame, width: int = 900) -> DataFrame:
    """(doc_id, text): mentions of models, over windows of ``width``, with a word outside the bank."""
    found = ner.mentions(docs, models, width=width).select("doc_id", "start", "text", F.explode(tokens(F.col("text"))).alias("value"))
    return found.join(bank.select(F.col(bank.columns[0]).alias("value")).distinct(), "value", "left_anti").select("doc_id", "text").distinct()


def projection(documents: int, seconds: float, target: int = 1_000_000) -> dict[str, float]:
    """What a measured run comes to for ``target`` documents."""
    per = seconds / max(documents, 1)
    return {"ms_per_document": 1000 * per, "documents_per_second": 1 / per if per else float("inf"), "hours": target * per / 3600}


def page_text(html: Column) -> Column:
    """The text of a page, for corpora that come as HTML."""
    text = reduce(lambda t, s: F.regexp_replace(t, *s), HTML, html)
    return F.trim(reduce(lambda t, e: F.replace(t, F.lit(e[0]), F.lit(e[1])), ENTITIES, text))
