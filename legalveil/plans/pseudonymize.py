"""The engine as one plan: normalise, detect, resolve identities, apply policy, render once, verify.

Documents are independent, so everything happens in the document's own row and nothing is shuffled;
only edits and outside mentions are joined, on doc_id. The single Python stage is the normalising
Pandas UDF (NFKC and HTML entities), in front of everything else.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config, resolved
from ..functions import sql as S
from ..functions.lexicons import Lexicons
from ..functions.once import Steps
from ..operators import detect, edits, people, resolve, verify
from ..operators.normalize import normalized

SCHEMA_VERSION = 1


def analyze(docs: DataFrame, config: Config | None = None, *, id_col="doc_id", text_col="text", edits_table: DataFrame | None = None,
            mentions: DataFrame | None = None, lexicons: Lexicons | None = None, **overrides) -> DataFrame:
    """doc_id, text (normalised), protections, people, candidates, decisions, mapping, entities,
    expected_aliases, warnings: one row per document. Null texts are empty."""
    cfg, lex = resolved(config, overrides), lexicons or Lexicons()
    d = normalized(spread(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))), sanitize=cfg.sanitize)
    edited = edits_table is not None
    if edited:
        have = [c for c in edits.COLUMNS if c in edits_table.columns]
        e = edits_table.select("doc_id", *[F.col(c).cast(edits.COLUMNS[c]).alias(c) for c in have], *[F.lit(None).cast(t).alias(c) for c, t in edits.COLUMNS.items() if c not in have])
        d = d.join(e, "doc_id", "left")
    if mentions is not None:
        m = mentions.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "role", "source"))).alias("mentions"))
        d = d.join(m, "doc_id", "left")
    d = Steps(d)
    d.add("low", S.lower("text"))
    own = detect.Doc(S.col("text"), S.col("low"))
    text = own.text
    d.add("protections", detect.protections(own))
    d.add("seeds", detect.seeds(own, cfg, lex))
    if mentions is not None:
        some = S.coalesce(S.col("mentions"), S.array().cast("array<struct<start:int,end:int,role:string,source:string>>"))
        d.add("seeds", people.renumbered(S.concat(S.col("seeds"), detect.mention_seeds(own, some, lex, cfg.min_token_len))))
    if edited:
        d.add("seeds", S.concat(S.col("seeds"), edits.user_seeds(S.size("seeds"))))
    d.add("people", people.merged(S.col("seeds")))
    d.add("people", people.with_parent(S.col("people")))
    d.add("people", people.folded(S.col("people")))
    d.add("judges", people.judge_keys(S.col("protections")))
    d.add("people", people.without_judges(S.col("people"), S.col("judges"), cfg.keep_judges))
    d.add("conflicts", people.conflicts(S.col("people"), S.col("judges")))
    d.add("ambiguous", people.ambiguous_tokens(S.col("people"), lex, cfg.min_token_len))
    p, a = S.col("people"), S.col("ambiguous")
    d.add("candidates", S.concat(
        detect.protected(S.col("protections"), S.col("conflicts"), cfg), people.person_candidates(text, p, a, cfg, lex), people.ambiguous_candidates(text, a),
        people.given_candidates(own, p, cfg, lex), detect.initials(own, cfg, lex), detect.structured(own, lex), detect.addresses(own), detect.places(own, lex), detect.companies(own, cfg)))
    merges = S.array().cast("array<struct<a:string,b:string>>")
    if edited:
        d.add("edited", edits.edited(text, S.col("candidates")))
        d.add("candidates", S.col("edited.pool"))
        d.add("custom", S.col("edited.custom"))
        merges = S.col("edited.merges")
    d.add("decisions", resolve.resolved(S.col("candidates")))
    resolve.tagged(d, cfg.roles, edited)
    d.add("warnings", people.role_conflicts(p, S.col("judges")))
    d.add("mapping", resolve.mapping(S.col("decisions")))
    d.add("entities", resolve.records(S.col("decisions")))
    d.add("expected_aliases", verify.expected_aliases(p, S.col("decisions"), merges, lex, cfg.min_token_len))
    return d.select("doc_id", "text", "protections", "people", "candidates", "decisions", "mapping", "entities", "expected_aliases", "warnings")


SMALL = 16 << 20  # bytes a core, below which the input is spread


def spread(docs: DataFrame) -> DataFrame:
    """docs over all cores where the plan's size is known to be small: one small file is one task, and
    the work for a document is a thousand times that of moving it. Larger inputs and streams stay as
    their files are split."""
    if docs.isStreaming:
        return docs
    cores = docs.sparkSession.sparkContext.defaultParallelism
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return docs.repartition(4 * cores) if size < cores * SMALL else docs


def render(analysis: DataFrame, config: Config | None = None, *, lexicons: Lexicons | None = None, **overrides) -> DataFrame:
    """Reports: doc_id, output, mapping, protected, replacements, replacement_spans, risk, status, warnings, residuals,
    entities, decisions, schema_version."""
    cfg, lex = resolved(config, overrides), lexicons or Lexicons()
    d = Steps(analysis)
    d.add("output", resolve.rendered(S.col("text"), S.col("decisions")))
    d.add("replacement_spans", S.transform(S.filter("decisions", lambda x: x["replacement"].isNotNull()), lambda x: S.struct(x["start"].alias("start"), x["end"].alias("end"))))
    d.add("replacements", S.size("replacement_spans"))
    d.add("protected", S.array_sort(S.array_distinct(S.transform(S.filter("decisions", lambda x: x["kind"] == "JUDGE"), lambda x: x["text"]))))
    if cfg.verify:
        d.add("kept", S.filter(resolve.output_spans(S.col("decisions")), lambda k: k["protection"].isNotNull() & (k["protection"] != "user")))
        d.add("low", S.lower("output"))
        d.add("residuals", verify.residuals(detect.Doc(S.col("output"), S.col("low")), S.col("kept"), S.col("expected_aliases"), S.col("replacements"), lex))
        d.add("status", verify.status(S.col("residuals"), S.col("warnings")))
        d.add("risk", verify.risk(S.col("residuals"), S.col("warnings")))
    else:
        d.add("residuals", S.array().cast(verify.FINDING))
        d.add("status", S.lit("not_run"))
        d.add("risk", S.when(S.size("warnings") > 0, 0.5).otherwise(0.0))
    d.add("schema_version", S.lit(SCHEMA_VERSION))
    return d.select("doc_id", "output", "mapping", "protected", "replacements", "replacement_spans", "risk", "status", "warnings", "residuals", "entities", "decisions", "schema_version")


def pseudonymize(docs: DataFrame, config: Config | None = None, *, id_col="doc_id", text_col="text", **options) -> DataFrame:
    """analyze and render in one plan."""
    plan = {k: options.pop(k) for k in ("edits_table", "mentions") if k in options}
    lexicons = options.pop("lexicons", None)
    cfg = resolved(config, options)
    return render(analyze(docs, cfg, id_col=id_col, text_col=text_col, lexicons=lexicons, **plan), cfg, lexicons=lexicons)


def anonymize(spark, raw: str, config: Config | None = None, **options) -> tuple[str, dict]:
    """One document: (output, report)."""
    row = pseudonymize(spark.createDataFrame([(0, raw)], "doc_id long, text string"), config, **options).first()
    return row["output"], row.asDict(recursive=True)
