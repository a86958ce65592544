"""Queries of the engine over the given tables, and the SQL that must give the same.

Rules run on texts of invented names, one per customer, put together by the same expression in Spark
and in SQL; what stands where, and what must become of it, is then known by construction.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import probes as P
from . import evaluation as V
from .config import Config
from .functions import sql as S
from .functions.checks import iban_remainder, tax_code_ok
from .functions.lexicons import Lexicons
from .functions.once import once, step
from .functions.spans import find
from .operators import detect, metrics, people, resolve
from .operators import rules as R
from .operators.normalize import fold_quotes, normalized
from .plans.pseudonymize import analyze, pseudonymize
from .sources.batch import pending, totals

LEX = Lexicons()
JUDGMENT = """Presidente: {JU}
Il ricorrente {P}, nato a {TOWN} il 3.4.1960, C.F. {CF}, residente in {HOME}, Via Garibaldi {NUM}, difeso dall'avv. {C}, ricorre contro l'Agenzia delle Entrate. Iban {IBAN}, e-mail {EMAIL}, tel. {PHONE}. Sentenza n. {NUM}/2020. {PS} insiste."""
TAGGED = """Presidente: {JU}
Il ricorrente <P>_1, nato a Luogo_1 il Data_nascita_1, C.F. CF_1, residente in Luogo_2, Indirizzo_1, difeso dall'avv. <C>, ricorre contro l'Agenzia delle Entrate. Iban Iban_1, e-mail Email_1, tel. Telefono_1. Sentenza n. {NUM}/2020. <P>_1 insiste."""
EDITABLE = "Il ricorrente {P} e la sig.ra {Q} discutono del Fondo Azzurro."
PARTS = {"party": "{P}", "surname": "{PS}", "counsel": "{C}", "judge": "{JU}", "town": "{TOWN}", "home": "{HOME}", "cf": "{CF}", "iban": "{IBAN}", "num": "{NUM}", "email": "{EMAIL}", "phone": "{PHONE}", "given": "{G}"}
EMAIL = next(r.core for r in R.STRUCTURED if r.label == "Email")

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _customers(spark: SparkSession, sf_dir: str, template: str, **more: str) -> DataFrame:
    """doc_id and text, and the parts that the judgment is made of, by customer."""
    parts = [f"{P.filled(t, P.spark)} AS {n}" for n, t in more.items()]
    return spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("c_custkey AS doc_id", f"{P.filled(template, P.spark)} AS text", *parts)


VIEW = f"WITH v AS (SELECT c_custkey AS doc_id, {P.filled(JUDGMENT, P.duck)} AS text, {', '.join(f'{P.filled(t, P.duck)} AS {n}' for n, t in PARTS.items())} FROM customer) "


def legal_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _customers(spark, sf_dir, JUDGMENT, **PARTS)


def _probes(spark: SparkSession, sf_dir: str, table: list[tuple[str, str]]) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("c_custkey AS doc_id", f"{P.chosen([t for t, _ in table], P.spark)} AS text")


def _expected(table: list[tuple[str, str]], name: str = "output") -> str:
    return f"SELECT c_custkey AS doc_id, {P.chosen([e for _, e in table], P.duck)} AS {name} FROM customer"


def _docs(spark, sf_dir, table="documents"):
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _spans(df: DataFrame, spans, *more) -> DataFrame:
    """doc_id, span_start, span_end, span_text of an array of spans."""
    return df.select("doc_id", once(spans).alias("s")).select("doc_id", F.explode("s").alias("s")).select("doc_id", F.col("s.start").alias("span_start"), F.col("s.end").alias("span_end"), F.col("s.text").alias("span_text"), *[F.col(f"s.{m}").alias(m) for m in more])


OWN = detect.doc(S.col("text"))


def _people(v: DataFrame) -> DataFrame:
    """v with seeds and people, each computed once."""
    v = step(v, "seeds", detect.seeds(OWN, Config(), LEX))
    return step(v, "people", people.merged(S.col("seeds")))


def _at(value: str, **more: str) -> str:
    """SQL of one span per document: where ``value`` first stands in the text."""
    extra = "".join(f", '{v}' AS {k}" for k, v in more.items())
    start = f"CAST(strpos(text, {value}) - 1 AS INTEGER)"
    return f"SELECT doc_id, {start} AS span_start, CAST({start} + length({value}) AS INTEGER) AS span_end, {value} AS span_text{extra} FROM v"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def probed(name: str, table: list[tuple[str, str]], **options) -> None:
    """A query of the outputs of a family of probes."""

    def run(spark, sf_dir):
        return pseudonymize(_probes(spark, sf_dir, table), verify=False, **options).select("doc_id", "output")

    QUERIES[name], ORACLE_SQL[name] = run, _expected(table)


# normalisation ----------------------------------------------------------------------------------
@query(_expected(P.MARKUP, "text"))
def sanitize_text(spark, sf_dir):
    return normalized(_probes(spark, sf_dir, P.MARKUP))


@query("SELECT conv_id, turn, translate(text, '‘’‚‛“”„‟', '''''''''\"\"\"\"') AS folded FROM conversations")
def quotes_folded(spark, sf_dir):
    return _docs(spark, sf_dir, "conversations").select("conv_id", "turn", fold_quotes(F.col("text")).alias("folded"))


# structured identifiers -------------------------------------------------------------------------
@query(f"SELECT doc_id, CAST(len(regexp_extract_all(text, '{EMAIL}')) AS INTEGER) AS n_emails FROM documents WHERE regexp_matches(text, '{EMAIL}')")
def extract_email(spark, sf_dir):
    found = S.size(find(S.col("text"), EMAIL, flags=""))
    return _docs(spark, sf_dir).filter(F.col("text").contains("@")).select("doc_id", found.column().alias("n_emails")).filter("n_emails > 0")


@query(VIEW + " UNION ALL ".join([_at("cf", label="CF"), _at("iban", label="Iban"), _at("email", label="Email"), _at("phone", label="Telefono"), _at("'3.4.1960'", label="Data_nascita")]))
def extract_structured_all(spark, sf_dir):
    return _spans(legal_view(spark, sf_dir), detect.structured_spans(OWN, LEX), "label")


@query(VIEW + "SELECT doc_id, cf AS value, true AS ok FROM v UNION ALL SELECT doc_id, lower(substr(cf, 1, 15)) || chr(CAST(97 + (ascii(cf[16]) - 64) % 26 AS INTEGER)), false FROM v")
def cf_check(spark, sf_dir):
    v = legal_view(spark, sf_dir)
    wrong = F.concat(F.lower(F.substring("cf", 1, 15)), F.char((97 + (F.ascii(F.substring("cf", 16, 1)) - 64) % 26).cast("bigint")))
    return v.select("doc_id", F.explode(F.array("cf", wrong)).alias("value")).withColumn("ok", tax_code_ok(S.col("value")).column())


@query(VIEW + "SELECT doc_id, CAST(CASE doc_id % 2 WHEN 0 THEN 1 ELSE 2 END AS INTEGER) AS remainder FROM v")
def iban_check(spark, sf_dir):
    """The remainder of an IBAN, and of one whose check digits are one too many."""
    v = legal_view(spark, sf_dir).withColumn("iban", F.expr("CASE WHEN doc_id % 2 = 0 THEN iban ELSE substr(iban, 1, 2) || lpad(cast(cast(substr(iban, 3, 2) as int) + 1 as string), 2, '0') || substr(iban, 5) END"))
    return v.select("doc_id", iban_remainder(S.col("iban")).column().alias("remainder"))


@query(VIEW + _at("'3.4.1960'"))
def birth_dates(spark, sf_dir):
    rule = next(r for r in R.STRUCTURED if r.label == "Data_nascita")
    return _spans(legal_view(spark, sf_dir), find(S.col("text"), rule.core, rule.pre))


probed("structured_probes", P.STRUCTURED)


# what is kept -----------------------------------------------------------------------------------
@query(VIEW + _at("'n. ' || num || '/2020'"))
def keep_case_numbers(spark, sf_dir):
    return _spans(legal_view(spark, sf_dir), S.filter(detect.protections(OWN), lambda x: (x["protection"] == "case_number") & S.call("startswith", x["text"], "n.")))


@query(VIEW + _at("judge"))
def keep_judges(spark, sf_dir):
    return _spans(legal_view(spark, sf_dir), S.filter(detect.protections(OWN), lambda x: x["protection"] == "judge"))


@query(VIEW + "SELECT doc_id, judge AS member FROM v UNION ALL SELECT doc_id, counsel FROM v")
def bench_window(spark, sf_dir):
    v = _customers(spark, sf_dir, "Collegio composto dai magistrati: {JU}, {C}, Ministero Interno; ha pronunciato {P}")
    return v.select("doc_id", once(detect.bench_spans(OWN)).alias("s")).select("doc_id", F.explode("s").alias("s")).select("doc_id", F.col("s.text").alias("member"))


@query(_expected(P.CASES, "kept"))
def case_probes(spark, sf_dir):
    """Numbers and names of cases, in order of their text."""
    kept = S.array_sort(S.transform(S.filter(detect.protections(OWN), lambda x: x["protection"] == "case_number"), lambda x: x["text"]))
    return _probes(spark, sf_dir, P.CASES).select("doc_id", once(S.array_join(kept, "; ")).alias("kept"))


probed("judge_probes", P.JUDGES)
probed("seed_probes", P.SEEDS)
probed("guard_probes", P.GUARDS)
probed("propagation_probes", P.PROPAGATION)
probed("role_probes", P.ROLES, roles=True)
probed("address_probes", P.ADDRESSES)
probed("initials_prudent", P.INITIALS, initials=True)
probed("initials_all", P.EVERYWHERE, initials="all")
probed("companies_all", P.COMPANIES, companies=True)
probed("companies_person_named", P.NAMED_COMPANIES, companies="person_named")


# people -----------------------------------------------------------------------------------------
@query(VIEW + "SELECT doc_id, party AS surface, 'regex:party_role' AS source FROM v UNION ALL SELECT doc_id, party, 'regex:biografico' FROM v UNION ALL SELECT doc_id, counsel, 'regex:counsel' FROM v UNION ALL SELECT doc_id, counsel, 'regex:difeso_da' FROM v UNION ALL SELECT doc_id, counsel, 'regex:counsel_list' FROM v")
def seed_anchors(spark, sf_dir):
    s = detect.seeds(OWN, Config(first_names=False), LEX)
    return legal_view(spark, sf_dir).select("doc_id", once(s).alias("s")).select("doc_id", F.explode("s").alias("s")).select("doc_id", F.col("s.surface").alias("surface"), F.col("s.source").alias("source"))


@query(VIEW + "SELECT doc_id, counsel AS surface FROM v UNION ALL SELECT doc_id, party FROM v")
def seed_lists(spark, sf_dir):
    v = _customers(spark, sf_dir, "Ricorso proposto da {C} e {P} contro il Comune.")
    s = S.filter(detect.seeds(OWN, Config(first_names=False), LEX), lambda x: x["source"] == "regex:party_list")
    return v.select("doc_id", once(s).alias("s")).select("doc_id", F.explode("s").alias("s")).select("doc_id", F.col("s.surface").alias("surface"))


@query(VIEW + "SELECT doc_id, given AS surface FROM v")
def first_name_scan(spark, sf_dir):
    """Of two names in prose the one whose first name is listed."""
    v = _customers(spark, sf_dir, "Ieri {G} era presente con {P}, in Viale {G}.")
    s = S.filter(detect.seeds(OWN, Config(), LEX), lambda x: x["source"] == "lexicon:first_name")
    return v.select("doc_id", once(s).alias("s")).select("doc_id", F.explode("s").alias("s")).select("doc_id", F.col("s.surface").alias("surface"))


@query(VIEW + "SELECT doc_id, party AS display, 'Ricorrente' AS role, 'regex:biografico+regex:party_role' AS sources FROM v UNION ALL SELECT doc_id, counsel, 'Difensore', 'regex:counsel+regex:counsel_list+regex:difeso_da' FROM v")
def people_merged(spark, sf_dir):
    return _people(legal_view(spark, sf_dir).select("doc_id", "text")).select("doc_id", F.explode("people").alias("p")).select("doc_id", F.col("p.display").alias("display"), F.col("p.role").alias("role"), F.array_join("p.sources", "+").alias("sources"))


@query(VIEW + "SELECT doc_id, party AS display, party || '+' || surname AS variants FROM v")
def people_folded(spark, sf_dir):
    v = step(_people(_customers(spark, sf_dir, "Compare il sig. {P} oggi. Poi il sig. {PS} insiste.")), "p", people.with_parent(S.col("people")))
    v = step(v, "p", people.folded(S.col("p")))
    return v.select("doc_id", F.explode("p").alias("p")).select("doc_id", F.col("p.display").alias("display"), F.array_join("p.variants", "+").alias("variants"))


@query(VIEW + "SELECT doc_id, array_to_string(list_sort(string_split(lower(counsel), ' ')), ' ') AS conflict FROM v")
def judge_conflicts(spark, sf_dir):
    v = step(_people(_customers(spark, sf_dir, "Presidente: {C}\nIl ricorrente {C} insiste con il dott. {P}.")), "judges", people.judge_keys(detect.protections(OWN)))
    return v.select("doc_id", once(people.conflicts(S.col("people"), S.col("judges"))).alias("c")).select("doc_id", F.explode("c").alias("conflict"))


def _analysis(spark, sf_dir, **options):
    return analyze(legal_view(spark, sf_dir).select("doc_id", "text"), **options)


@query(VIEW + "SELECT doc_id, 30 AS priority, party AS alias, 'resolved full-name alias' AS reason FROM v UNION ALL SELECT doc_id, 20, unnest(string_split(party, ' ')), 'unique distinctive alias' FROM v UNION ALL SELECT doc_id, 20, surname, 'unique distinctive alias' FROM v")
def propagate_names(spark, sf_dir):
    """Every spelling of the applicant that is proposed, the full name's parts included."""
    c = F.explode(F.filter("candidates", lambda x: (x["kind"] == "PERSON") & (x["role"] == "Ricorrente")))
    return _analysis(spark, sf_dir).select("doc_id", c.alias("c")).select("doc_id", F.col("c.priority").alias("priority"), F.col("c.text").alias("alias"), F.col("c.reason").alias("reason"))


@query(VIEW + "SELECT doc_id, lower(surname) AS token FROM v")
def ambiguous_aliases(spark, sf_dir):
    v = _people(_customers(spark, sf_dir, "Il sig. {PG} {PS} e la sig.ra {QG} {PS} ricorrono."))
    return v.select("doc_id", once(people.ambiguous_tokens(S.col("people"), LEX, 4)).alias("t")).select("doc_id", F.explode("t").alias("token"))


# places -----------------------------------------------------------------------------------------
@query(VIEW + _at("'Via Garibaldi ' || num"))
def addresses(spark, sf_dir):
    return _spans(legal_view(spark, sf_dir), detect.addresses(OWN))


@query(VIEW + "SELECT doc_id, town AS place FROM v UNION ALL SELECT doc_id, home FROM v")
def birth_places(spark, sf_dir):
    v = _customers(spark, sf_dir, "nato a {TOWN}, residente a {HOME} da anni, dimorante a Castelvuoto")
    return v.select("doc_id", once(detect.places(OWN, LEX)).alias("s")).select("doc_id", F.explode("s").alias("s")).select("doc_id", F.col("s.text").alias("place"))


# policy, tags, rendering ------------------------------------------------------------------------
@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 3 >= 1 THEN '1,4,3' WHEN l_linenumber % 3 >= 1 THEN '1,2' ELSE '1,2,3' END AS accepted FROM lineitem")
def resolve_overlaps(spark, sf_dir):
    """Four proposals for each line, of which the outcome hangs on how they meet: the fourth has the
    first's priority and may overlap it; the second is free only if the fourth lost; and so on."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("l_orderkey", "l_linenumber", "CAST(l_quantity AS INT) AS q", "CAST(l_orderkey % 3 AS INT) AS k", "CAST(l_linenumber % 3 AS INT) AS l")
    c = lambda a, b, p, n: S.struct(a.cast("int").alias("start"), b.cast("int").alias("end"), S.lit(p).alias("priority"), S.lit(n).cast("bigint").alias("seq"))
    q, k, line = S.col("q"), S.col("k"), S.col("l")
    found = resolve.resolved(S.array(c(q, q + 5, 30, 1), c(q + 5, q + 9 + line, 20, 2), c(q + 9, q + 12, 20, 3), c(q + 4 + k, q + 9, 30, 4)))
    return li.select("l_orderkey", "l_linenumber", once(S.array_join(S.transform(found, lambda x: x["seq"].cast("string")), ",")).alias("accepted"))


@query(VIEW + f"SELECT c_custkey AS doc_id, {P.filled(TAGGED.replace('<P>', 'Nominativo').replace('<C>', 'Nominativo_2'), P.duck)} AS output FROM customer")
def render(spark, sf_dir):
    return pseudonymize(legal_view(spark, sf_dir), verify=False).select("doc_id", "output")


@query(VIEW + f"SELECT c_custkey AS doc_id, {P.filled(TAGGED.replace('<P>', 'Ricorrente').replace('<C>', 'Difensore_1'), P.duck)} AS output FROM customer")
def render_roles(spark, sf_dir):
    return pseudonymize(legal_view(spark, sf_dir), verify=False, roles=True).select("doc_id", "output")


@query(VIEW + "SELECT doc_id, party AS value, 'Nominativo_1' AS tag FROM v UNION ALL SELECT doc_id, counsel, 'Nominativo_2' FROM v UNION ALL SELECT doc_id, cf, 'CF_1' FROM v UNION ALL SELECT doc_id, town, 'Luogo_1' FROM v UNION ALL SELECT doc_id, home, 'Luogo_2' FROM v UNION ALL SELECT doc_id, iban, 'Iban_1' FROM v UNION ALL SELECT doc_id, email, 'Email_1' FROM v UNION ALL SELECT doc_id, phone, 'Telefono_1' FROM v UNION ALL SELECT doc_id, '3.4.1960', 'Data_nascita_1' FROM v UNION ALL SELECT doc_id, 'Via Garibaldi ' || num, 'Indirizzo_1' FROM v")
def mapping(spark, sf_dir):
    return _analysis(spark, sf_dir).select("doc_id", F.explode("mapping").alias("value", "tag"))


@query(VIEW + "SELECT doc_id, 'Nominativo_1' AS entity_id, array_to_string(list_sort([party, surname]), '+') AS aliases, 2 AS n_spans FROM v UNION ALL SELECT doc_id, 'Nominativo_2', counsel, 1 FROM v UNION ALL SELECT doc_id, 'kept:JUDGE:' || lower(judge), judge, 1 FROM v UNION ALL SELECT doc_id, 'kept:CASE_NUMBER:n. ' || num || '/2020', 'n. ' || num || '/2020', 1 FROM v")
def entity_records(spark, sf_dir):
    e = _analysis(spark, sf_dir).select("doc_id", F.explode("entities").alias("e")).filter("e.kind in ('PERSON', 'JUDGE', 'CASE_NUMBER')")
    return e.select("doc_id", F.col("e.entity_id").alias("entity_id"), F.array_join("e.aliases", "+").alias("aliases"), F.size("e.spans").alias("n_spans"))


@query(VIEW + f"SELECT doc_id, CAST(strpos(text, party) - 1 AS INTEGER) AS span_start, 'Nominativo_1' AS tag, CAST(strpos(output, 'Nominativo_1') - 1 AS INTEGER) AS output_start FROM (SELECT v.*, {P.filled(TAGGED.replace('<P>', 'Nominativo').replace('<C>', 'Nominativo_2'), P.duck)} AS output FROM v JOIN customer ON c_custkey = doc_id)")
def output_offsets(spark, sf_dir):
    """Where the applicant stands in the text and where their tag stands in the output."""
    a = step(_analysis(spark, sf_dir), "o", resolve.output_spans(S.col("decisions")))
    both = a.select("doc_id", F.explode(F.arrays_zip("decisions", "o")).alias("z")).filter("z.decisions.replacement = 'Nominativo_1'")
    return both.groupBy("doc_id").agg(F.min("z.decisions.start").alias("span_start"), F.lit("Nominativo_1").alias("tag"), F.min("z.o.start").alias("output_start"))


# verification -----------------------------------------------------------------------------------
@query(_expected(P.RESIDUALS, "verdict"))
def status_and_risk(spark, sf_dir):
    found = F.array_join(F.transform("residuals", lambda x: F.concat_ws(" ", x["kind"], x["text"], x["source"])), "; ")
    return pseudonymize(_probes(spark, sf_dir, P.RESIDUALS)).select("doc_id", F.concat_ws("|", "status", F.col("risk").cast("string"), found).alias("verdict"))


# edits and mentions -----------------------------------------------------------------------------
EDITED = [
    "Il ricorrente Nominativo_1 e la sig.ra Nominativo_2 discutono del Nominativo_3.",  # a person is added
    "Il ricorrente Nominativo_1 e la sig.ra Nominativo_2 discutono del Terzo_1.",  # a term
    "Il ricorrente Nominativo_1 e la sig.ra {Q} discutono del Fondo Azzurro.",  # one is excluded
    "Il ricorrente {P} e la sig.ra Nominativo_1 discutono del Fondo Azzurro.",  # a span is kept
    "Il ricorrente Nominativo_1 e la sig.ra Nominativo_2 discutono del Nominativo_2.",  # a span is included
    "Il ricorrente Nominativo_1 e la sig.ra Nominativo_1 discutono del Fondo Azzurro.",  # two are merged
    "Il ricorrente Nominativo_1 e la sig.ra Parte_X discutono del Fondo Azzurro.",  # a tag of the reviewer's
    "Il ricorrente Nominativo_8 e la sig.ra Nominativo_7 discutono del Fondo Azzurro.",  # an earlier tag
]


def edits_table(v: DataFrame) -> DataFrame:
    """Of doc_id, text, p, q: one kind of edit for each document, by its id."""
    when = lambda i, value: f"CASE WHEN doc_id % 8 = {i} THEN {value} END"
    at = "cast(locate('Fondo Azzurro', text) - 1 as int)"
    return v.selectExpr(
        "doc_id", when(0, "array(named_struct('name', 'Fondo Azzurro', 'role', cast(null as string)))") + " AS people", when(1, "array(named_struct('text', 'fondo  azzurro', 'label', 'Terzo'))") + " AS terms",
        when(2, "array(lower(q))") + " AS exclude", when(3, "array(named_struct('start', 14, 'end', 14 + length(p)))") + " AS keep_spans",
        when(4, f"array(named_struct('start', {at}, 'end', {at} + 13, 'alias', q))") + " AS include_spans", when(5, "array(named_struct('a', q, 'b', p))") + " AS merge",
        when(6, "map(q, 'Parte_X')") + " AS placeholders", when(7, "map(q, 'Nominativo_7')") + " AS prior_tags")


@query(f"SELECT c_custkey AS doc_id, {P.chosen(EDITED, P.duck)} AS output FROM customer")
def reviewer_edits(spark, sf_dir):
    v = _customers(spark, sf_dir, EDITABLE, p="{P}", q="{Q}")
    return pseudonymize(v, verify=False, edits_table=edits_table(v)).select("doc_id", "output")


@query(f"SELECT c_custkey AS doc_id, 'needs_review' AS status, {P.filled('{P}', P.duck)} AS left_in FROM customer")
def kept_spans_are_verified(spark, sf_dir):
    """A span that a reviewer keeps is still reported."""
    v = _customers(spark, sf_dir, EDITABLE, p="{P}")
    edits = v.selectExpr("doc_id", "array(named_struct('start', 14, 'end', 14 + length(p))) AS keep_spans")
    return pseudonymize(v, edits_table=edits).select("doc_id", "status", F.expr("get(filter(residuals, x -> x.kind = 'PERSON'), 0).text").alias("left_in"))


@query(f"SELECT c_custkey AS doc_id, {P.filled('Oggi Nominativo_1 parla con Ministero Interno e con Nominativo_2; poi Nominativo_1 tace.', P.duck)} AS output FROM customer")
def outside_mentions(spark, sf_dir):
    """Mentions of a model pass the same guards: the ministry's does not, a single surname does."""
    v = _customers(spark, sf_dir, "Oggi {P} parla con Ministero Interno e con {QS}; poi {PS} tace.", p="{P}", q="{QS}")
    span = lambda value: f"named_struct('start', cast(locate({value}, text) - 1 as int), 'end', cast(locate({value}, text) - 1 + length({value}) as int))"
    m = v.select("doc_id", F.explode(F.expr(f"array({span('p')}, {span('q')}, {span(repr('Ministero Interno'))})")).alias("m")).select("doc_id", "m.start", "m.end", F.lit("Nominativo").alias("role"), F.lit("ner:stub").alias("source"))
    return pseudonymize(v, verify=False, mentions=m).select("doc_id", "output")


# batch ------------------------------------------------------------------------------------------
@query(VIEW + "SELECT count(*) AS documents, CAST(0 AS BIGINT) AS errors, CAST(11 * count(*) AS BIGINT) AS replacements, CAST(0 AS BIGINT) AS needs_review, count(*) AS passed_checks FROM v")
def batch_summary(spark, sf_dir):
    return totals(pseudonymize(legal_view(spark, sf_dir)).withColumn("error", F.lit(None).cast("string")))


@query("SELECT c_custkey AS doc_id, c_custkey % 5 = 4 AS unvalidated FROM customer WHERE c_custkey % 5 <> 0")
def resume_pending(spark, sf_dir):
    """Files that a resumed run does again (all but a fifth, whose sidecar is current in every fact)
    and whether an output without a sidecar stands there."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("c_custkey AS doc_id", "concat('d/', c_custkey, '.txt') AS path", "sha2(cast(c_custkey as string), 256) AS source_sha256", "sha2(c_name, 256) AS output_sha256")
    files = c.select("path", "source_sha256", "doc_id")
    outputs = c.select("path", "output_sha256")
    cars = c.filter("doc_id % 5 <> 4").select("path", F.expr("if(doc_id % 5 = 1, 'changed', source_sha256)").alias("source_sha256"), F.expr("if(doc_id % 5 = 2, 'changed', output_sha256)").alias("output_sha256"), F.expr("if(doc_id % 5 = 3, '{}', '{\"x\": 1}')").alias("config"), F.lit("1").alias("engine"), F.lit(1).alias("schema_version"))
    out = pending(files, cars, outputs, config='{"x": 1}', engine="1", schema_version=1)
    return out.select("doc_id", "unvalidated")


# evaluation -------------------------------------------------------------------------------------
def _gold(spark, sf_dir):
    """Gold surfaces of the judgments: of every third one an unredacted word is claimed, too."""
    g = F.array(*[F.struct(F.lit(e).alias("entity"), F.lit(k).alias("kind"), F.col(c).alias("surface"), F.lit(r).alias("remove")) for e, k, c, r in (("p", "name", "party", True), ("p", "name", "surname", True), ("c", "name", "counsel", True), ("f", "identifier", "cf", True), ("j", "name", "judge", False))])
    missed = F.when(F.col("doc_id") % 3 == 0, F.array(F.struct(F.lit("x").alias("entity"), F.lit("name").alias("kind"), F.lit("Agenzia").alias("surface"), F.lit(True).alias("remove")))).otherwise(F.slice(g, 1, 0))
    return legal_view(spark, sf_dir).select("doc_id", F.explode(F.concat(g, missed)).alias("g")).select("doc_id", "g.*")


def _scored(spark, sf_dir, **options):
    out = pseudonymize(legal_view(spark, sf_dir), **options)
    return metrics.surfaces(out, _gold(spark, sf_dir)), out


_THIRD = "count(*) FILTER (doc_id % 3 = 0)"


@query(VIEW + f"SELECT 3 * count(*) + {_THIRD} AS entities, 3 * count(*) AS entities_complete, CAST(4 * count(*) + {_THIRD} AS BIGINT) AS surfaces, CAST(4 * count(*) AS BIGINT) AS surfaces_removed, count(*) AS keeps, count(*) AS kept, count(*) AS documents, count(*) - {_THIRD} AS documents_complete FROM v")
def metrics_recall(spark, sf_dir):
    return metrics.recall(_scored(spark, sf_dir, verify=False)[0])


@query(VIEW + f"SELECT CASE WHEN grouping(s) = 1 THEN NULL ELSE s END AS source, 3 * count(*) + {_THIRD} AS entities, 3 * count(*) AS entities_complete, CAST(4 * count(*) + {_THIRD} AS BIGINT) AS surfaces, CAST(4 * count(*) AS BIGINT) AS surfaces_removed, count(*) AS documents, count(*) - {_THIRD} AS documents_complete FROM (SELECT *, 's' || CAST(doc_id % 4 AS STRING) AS s FROM v) GROUP BY ROLLUP (s)")
def metrics_by_source_rollup(spark, sf_dir):
    scored = _scored(spark, sf_dir, verify=False)[0].withColumn("source", F.concat(F.lit("s"), (F.col("doc_id") % 4).cast("string")))
    return metrics.by_source(scored)


@query(VIEW + f"SELECT CAST(0 AS BIGINT) AS tp, {_THIRD} AS fn, CAST(0 AS BIGINT) AS fp, count(*) - {_THIRD} AS tn FROM v")
def review_confusion(spark, sf_dir):
    scored, reports = _scored(spark, sf_dir)
    return metrics.confusion(scored, reports)


@query(VIEW + f"SELECT 'claimed' AS shape, {_THIRD} AS full_, {_THIRD} AS query_ FROM v")
def leaks_by_shape_pivot(spark, sf_dir):
    runs = [_scored(spark, sf_dir, verify=False, profile=p)[0].withColumn("config", F.lit(n)) for p, n in (("legal", "full_"), ("query", "query_"))]
    scored = runs[0].unionByName(runs[1])
    shapes = _gold(spark, sf_dir).select("doc_id", "surface", F.when(F.col("entity") == "x", "claimed").otherwise("plain").alias("shape")).distinct()
    return metrics.leaks_by_shape(scored, shapes, ["full_", "query_"])


@query(f"SELECT c_custkey AS doc_id, {P.filled('{G}', P.duck)} AS surface, false AS found FROM customer")
def ab_compared(spark, sf_dir):
    """What a run without the list of first names loses against one with it."""
    v = _customers(spark, sf_dir, "Ieri {G} era presente con il ricorrente {P}.", g="{G}", p="{P}")
    gold = v.select("doc_id", F.explode(F.array("g", "p")).alias("surface")).withColumn("entity", F.col("surface")).withColumn("kind", F.lit("name")).withColumn("remove", F.lit(True))
    a, b = (metrics.surfaces(pseudonymize(v, verify=False, first_names=n), gold) for n in (True, False))
    return metrics.compared(a, b)


@query("SELECT c_custkey AS doc_id, CAST(n AS INTEGER) AS n, CASE WHEN n <= 3 THEN 1 ELSE 4 END AS entity FROM customer, range(1, 8) AS r(n)")
def entity_components(spark, sf_dir):
    """Seven surfaces as a chain: each shares a token with the next, with a break behind the third."""
    word = lambda n: F.concat(F.lit("tok"), F.substring(F.lit("abcdefgh"), n, F.lit(1)), F.lit("en"))
    n = F.col("n")
    chain = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("doc_id"), F.explode(F.sequence(F.lit(1), F.lit(7))).alias("n"))
    gold = chain.select("doc_id", F.concat(n.cast("string"), F.lit(" "), word(n), F.when(n != 3, F.concat(F.lit(" "), word(n + 1))).otherwise("")).alias("surface"))
    got = metrics.entity_groups(gold)
    return got.select("doc_id", F.substring_index("surface", " ", 1).cast("int").alias("n"), F.substring_index("entity", " ", 1).cast("int").alias("entity"))


@query("WITH s AS (SELECT l_orderkey AS doc_id, CAST(min(l_quantity) AS INTEGER) AS a, CAST(max(l_quantity) AS INTEGER) + 1 AS b, CAST(l_orderkey % 30 AS INTEGER) AS c FROM lineitem GROUP BY l_orderkey) SELECT count(*) AS spans, count(*) FILTER (a < c + 10 AND c < b) AS hits FROM s")
def metrics_span_precision(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumnRenamed("l_orderkey", "doc_id")
    by = li.groupBy("doc_id").agg(F.min("l_quantity").cast("int").alias("a"), (F.max("l_quantity").cast("int") + 1).alias("b"))
    gold = by.select("doc_id", (F.col("doc_id") % 30).cast("int").alias("start"), ((F.col("doc_id") % 30).cast("int") + 10).alias("end"))
    return metrics.span_precision(by.select("doc_id", F.col("a").alias("start"), F.col("b").alias("end")), gold)


@query("WITH s AS (SELECT l_orderkey AS doc_id, CAST(min(l_quantity) AS INTEGER) AS a, CAST(max(l_quantity) AS INTEGER) + 1 AS b, CAST(l_orderkey % 30 AS INTEGER) AS c FROM lineitem GROUP BY l_orderkey) SELECT CAST(sum(b - a) AS BIGINT) AS chars, CAST(sum(greatest(0, least(b, c + 10) - greatest(a, c))) AS BIGINT) AS hits FROM s")
def metrics_char_precision(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumnRenamed("l_orderkey", "doc_id")
    by = li.groupBy("doc_id").agg(F.min("l_quantity").cast("int").alias("a"), (F.max("l_quantity").cast("int") + 1).alias("b"))
    spans = by.select("doc_id", F.col("a").alias("start"), F.col("b").alias("end")).union(by.select("doc_id", F.col("a"), F.col("a") + 1))
    gold = by.select("doc_id", (F.col("doc_id") % 30).cast("int").alias("start"), ((F.col("doc_id") % 30).cast("int") + 10).alias("end"))
    return metrics.char_precision(spans, gold)


@query("WITH w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents) SELECT word, count(*) AS documents FROM w GROUP BY word HAVING count(*) >= greatest(3, 0.02 * (SELECT count(*) FROM documents))")
def word_document_frequency(spark, sf_dir):
    return metrics.word_document_frequency(_docs(spark, sf_dir))


@query("WITH n AS (SELECT length(text) AS len, row_number() OVER (ORDER BY length(text)) - 1 AS i, count(*) OVER () AS n FROM documents) SELECT q, CAST(max(len) FILTER (i = CAST(floor(n * q) AS BIGINT)) AS INTEGER) AS chars FROM n, (VALUES (0.5::DOUBLE), (0.9::DOUBLE), (0.99::DOUBLE)) AS t(q) GROUP BY q")
def length_percentiles(spark, sf_dir):
    counts = _docs(spark, sf_dir).groupBy(F.length("text").alias("len")).count()  # a row per length, which the longest text bounds
    w = Window.orderBy("len")
    c = counts.withColumn("upto", F.sum("count").over(w)).withColumn("n", F.sum("count").over(Window.partitionBy()))
    return c.withColumn("q", F.explode(F.array(F.lit(0.5), F.lit(0.9), F.lit(0.99)))).filter("floor(n * q) < upto and floor(n * q) >= upto - count").select("q", F.col("len").alias("chars"))


@query("SELECT 's' || CAST(c_custkey % 2 AS STRING) AS source, policy, CAST(sum(n) AS BIGINT) AS companies FROM customer, (VALUES ('keep', 0), ('person_named', 1), ('all', 2)) AS p(policy, n) GROUP BY 1, 2")
def company_policies(spark, sf_dir):
    v = _customers(spark, sf_dir, "paga la {PS} Costruzioni S.r.l. e la Fratelli {QS} S.n.c. oggi.")
    return V.company_policies(v.withColumn("source", F.concat(F.lit("s"), (F.col("doc_id") % 2).cast("string"))))


@query(f"SELECT c_custkey AS doc_id, 'name' AS kind, lower({P.filled('{GG}', P.duck)}) AS value FROM customer UNION ALL SELECT c_custkey, 'CF', {P.filled('{CF}', P.duck)} FROM customer UNION ALL SELECT c_custkey, 'Email', {P.filled('{EMAIL}', P.duck)} FROM customer")
def fixture_scan(spark, sf_dir):
    """Names of a bank are safe in a fixture; others, tax codes and addresses are not."""
    bank = spark.createDataFrame([(w.lower(),) for w in P.GIVEN + P.SURNAMES], "word string")
    return V.fixture_scan(_customers(spark, sf_dir, "Il ricorrente {P} e il sig. {G}, C.F. {CF}, scrive a {EMAIL} oggi."), bank)


def _page_sql() -> str:
    text = "html"
    for pattern, by in V.HTML:
        text = f"regexp_replace({text}, '{pattern}', {P.quoted(by, P.duck)}, 'g')"
    for entity, by in V.ENTITIES:
        text = f"replace({text}, {P.quoted(entity, P.duck)}, {P.quoted(by, P.duck)})"
    return f"SELECT page_id, trim({text}) AS text FROM pages"


@query(_page_sql())
def html_text(spark, sf_dir):
    return _docs(spark, sf_dir, "pages").select("page_id", V.page_text(F.col("html")).alias("text"))
