import json
import os

import pytest
from pyspark.sql import functions as F

import legalveil
from legalveil import evaluation, probes, queries
from legalveil.config import Config, resolved
from legalveil.functions import sql as S
from legalveil.functions.lexicons import Lexicons
from legalveil.operators import metrics, ner
from legalveil.plans.pseudonymize import anonymize, pseudonymize
from legalveil.sources import batch
from legalveil.streaming import files

TABLES = {
    "STRUCTURED": {}, "JUDGES": {}, "SEEDS": {}, "GUARDS": {}, "PROPAGATION": {}, "ADDRESSES": {}, "ROLES": {"roles": True}, "INITIALS": {"initials": True}, "EVERYWHERE": {"initials": "all"},
    "COMPANIES": {"companies": True}, "NAMED_COMPANIES": {"companies": "person_named"},
}


@pytest.mark.parametrize("name", TABLES)
def test_probes(spark, name):
    """Every probe of a family, with the names of one customer; a second run changes nothing."""
    table = getattr(probes, name)
    one = spark.range(1).selectExpr("7L AS c_custkey")
    texts, want = ([one.selectExpr(probes.filled(t[i], probes.spark) + " AS t") for t in table] for i in (0, 1))
    union = lambda frames: [r["t"] for r in _rows(frames)]
    docs = spark.createDataFrame(list(enumerate(union(texts))), "doc_id long, text string")
    out = dict(pseudonymize(docs, verify=False, **TABLES[name]).select("doc_id", "output").collect())
    assert [out[i] for i in range(len(table))] == union(want)


def _rows(frames):
    out = frames[0]
    for f in frames[1:]:
        out = out.unionAll(f)
    return out.collect()


def test_a_second_run_changes_nothing(spark):
    text = "Il ricorrente Ildebrando Cervigatti, nato a Lodi il 3.4.1960, insiste. Presidente: FREGOLAZZI DOROTEA\n"
    first, report = anonymize(spark, text)
    assert first == "Il ricorrente Nominativo_1, nato a Luogo_1 il Data_nascita_1, insiste. Presidente: FREGOLAZZI DOROTEA\n"
    assert report["protected"] == ["FREGOLAZZI DOROTEA"] and report["replacement_spans"][0] == {"start": 14, "end": 35}
    assert anonymize(spark, first)[0] == first


def test_config_and_options_exclude_each_other(spark):
    with pytest.raises(TypeError):
        anonymize(spark, "x", Config(), roles=True)
    assert resolved(None, {"profile": "cassazione"}).profile == "legal"
    for bad in ({"profile": "x"}, {"companies": "some"}, {"initials": "few"}, {"ner": ()}):
        with pytest.raises(ValueError):
            resolved(None, bad)


def test_null_and_empty_texts_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (2, " \n", "c")], "doc_id long, text string, output string")
    assert [r["output"] for r in pseudonymize(docs).orderBy("doc_id", "output").collect()] == ["", "", " \n"]
    assert pseudonymize(docs.limit(0)).count() == 0


def test_a_long_judgment(spark):
    """Hundreds of spans: no step may be cubic."""
    text = " ".join(f"Il ricorrente Callisto Dondarelli cita la pagina {i} di Dondarelli." for i in range(800))
    out = anonymize(spark, text, verify=False)[0]
    assert "Dondarelli" not in out and out.count("Nominativo_1") == 1600


def test_unknown_names_stay_and_own_lists_find_them(spark):
    text = "Ieri Wilhelmina Quagliotto visitava Castelvuoto."
    assert anonymize(spark, text, verify=False)[0] == text
    rows = spark.createDataFrame([("Wilhelmina",)], "name string")
    lex = Lexicons.of(first_names=rows)
    assert anonymize(spark, text, verify=False, lexicons=lex)[0] == "Ieri Nominativo_1 visitava Castelvuoto."


def corpus(root):
    src = root / "src"
    (src / "a").mkdir(parents=True)
    (src / "a" / "one.txt").write_text("Il ricorrente Callisto Dondarelli insiste.\r\n", newline="")
    (src / "two.MD").write_text("Nulla da dire.")
    (src / "bad.txt").write_bytes(b"\xff\xfe caff\xe8")
    (src / "other.pdf").write_bytes(b"%PDF")
    return src


def test_batch_writes_resumes_and_summarises(spark, tmp_path):
    src, dst, told = corpus(tmp_path), tmp_path / "dst", []
    got = batch.run(spark, str(src), str(dst), progress=lambda a, b: told.append((a, b)))
    assert (got["documents"], got["errors"], got["replacements"], got["skipped"], got["unvalidated"]) == (3, 1, 1, 0, 0)
    assert (dst / "a" / "one.txt").read_bytes() == b"Il ricorrente Nominativo_1 insiste.\r\n"
    car = json.loads((dst / "a" / ("one.txt" + batch.SIDECAR)).read_text())
    assert car["path"] == "a/one.txt" and car["mapping"] == {"Callisto Dondarelli": "Nominativo_1"} and len(car["output_sha256"]) == 64
    assert got["error_sample"] == [("bad.txt", "not UTF-8")] and told[-1][1] == 3
    assert sorted(p.name for p in dst.rglob("*") if p.is_file()) == ["one.txt", "one.txt.report.json", "two.MD", "two.MD.report.json"]
    again = batch.run(spark, str(src), str(dst))
    assert (again["documents"], again["skipped"]) == (1, 2) and set(again) == set(got)
    (dst / "two.MD").write_text("changed by hand")
    os.remove(dst / "a" / ("one.txt" + batch.SIDECAR))
    third = batch.run(spark, str(src), str(dst))
    assert (third["documents"], third["unvalidated"]) == (3, 1) and (dst / "two.MD").read_text() == "Nulla da dire."
    other = batch.run(spark, str(src), str(dst), roles=True)
    assert other["documents"] == 3 and "Ricorrente_1" in (dst / "a" / "one.txt").read_text()


def test_batch_guards(spark, tmp_path):
    src = corpus(tmp_path)
    for dst in (src, src / "inner", tmp_path):
        with pytest.raises(ValueError):
            batch.run(spark, str(src), str(dst))
    (tmp_path / "link").symlink_to(tmp_path / "real")
    with pytest.raises(ValueError):
        batch.run(spark, str(src), str(tmp_path / "link" / "x"))
    with pytest.raises(ValueError):
        batch.run(spark, str(src), str(tmp_path / "dst"), workers=True)
    with pytest.raises(NotADirectoryError):
        batch.run(spark, str(tmp_path / "none"), str(tmp_path / "dst"))


def test_empty_run_has_the_same_keys(spark):
    empty = spark.createDataFrame([], "path string, replacements int, risk double, status string, error string")
    got = batch.summary(empty)
    assert got["documents"] == 0 and got["top_risk"] == [] and got["review_queue"] == [] and got["error_sample"] == []


def test_stream_gives_what_the_batch_gives(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.txt").write_text("Il ricorrente Callisto Dondarelli insiste.")
    for n in (1, 2):
        files.start(files.read_stream(spark, str(src)), str(tmp_path / "out"), str(tmp_path / "mark"), verify=False).awaitTermination()
        assert [r["output"] for r in spark.read.parquet(str(tmp_path / "out")).collect()].count("Il ricorrente Nominativo_1 insiste.") == n
        (src / "b.txt").write_text("Il ricorrente Callisto Dondarelli insiste.")


def test_windows_and_mentions_of_a_stub_model(spark):
    text = "x" * 900 + " " + "y" * 900
    cuts = list(ner.windows(text))
    assert cuts[0] == (0, "x" * 900) and all(text[a : a + len(w)] == w for a, w in cuts) and cuts[-1][0] + len(cuts[-1][1]) == len(text)

    def make():
        def model(windows):
            out = []
            for w in windows:
                found = [{"start": i, "end": i + 8, "label": "PER", "score": 0.9} for i in [w.find("Callisto")] if i >= 0]
                found += [{"start": i, "end": i + 10, "label": "LAWYER", "score": 0.7} for i in [w.find("Dondarelli")] if i >= 0]
                out.append(found + [{"start": 0, "end": 2, "label": "ORG", "score": 0.99}, {"start": 0, "end": 2, "label": "PER", "score": 0.1}])
            return out

        return model

    docs = spark.createDataFrame([(1, "Parla Callisto Dondarelli oggi."), (2, None)], "doc_id long, text string")
    got = ner.mentions(docs, {"stub": make}).collect()
    assert [(r["doc_id"], r["start"], r["end"], r["text"], r["role"], r["score"], r["source"]) for r in got] == [(1, 6, 25, "Callisto Dondarelli", "Difensore", 0.7, "ner:stub")]
    out = pseudonymize(docs, verify=False, roles=True, mentions=ner.mentions(docs, {"stub": make})).filter("doc_id = 1").first()
    assert out["output"] == "Parla Difensore_1 oggi."
    assert ner.available({"stub": make}) == ["stub"] and ner.cached("stub", make) is ner.cached("stub", make)


def test_leaks_by_shape(spark):
    rows = [(1, "A", "full_", True, False), (1, "A", "query_", True, True), (2, "B", "query_", True, False), (2, "C", "full_", True, True), (3, "A", "full_", False, False)]
    scored = spark.createDataFrame(rows, "doc_id long, surface string, config string, remove boolean, gone boolean")
    shapes = spark.createDataFrame([(1, "A", "x"), (2, "B", "y"), (2, "C", "z"), (3, "A", "x")], "doc_id long, surface string, shape string")
    found = metrics.leaks_by_shape(scored, shapes, ["full_", "query_"])
    assert found.columns == ["shape", "full_", "query_"] and sorted(map(tuple, found.collect())) == [("x", 1, 0), ("y", 0, 1)]


def test_scoring_sends_no_texts_through_the_driver(spark):
    out = spark.range(9).select(F.col("id").alias("doc_id"), F.lit("Rossi resta").alias("output"), F.lit("needs_review").alias("status"))
    gold = spark.range(9).select(F.col("id").alias("doc_id"), F.lit("p").alias("entity"), F.lit("name").alias("kind"), F.lit("Rossi").alias("surface"), F.lit(True).alias("remove"))
    scored = metrics.surfaces(out, gold)
    shapes = gold.select("doc_id", "surface", F.lit("x").alias("shape"))
    for df in (scored, metrics.confusion(scored, out), metrics.leaks_by_shape(scored.withColumn("config", F.lit("a")), shapes, ["a"])):
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()
    assert tuple(metrics.confusion(scored, out).first()) == (9, 0, 0, 0)


def test_gold_of_two_entities_is_refused(spark):
    gold = spark.createDataFrame([(1, "Rossi", "a"), (1, "Rossi", "b")], "doc_id long, surface string, entity string")
    with pytest.raises(ValueError):
        metrics.checked(gold)


def test_gold_reader(spark, tmp_path):
    (tmp_path / "set").mkdir()
    (tmp_path / "set" / "one.txt").write_text("Il ricorrente Callisto Dondarelli,\ndi Lodi.")
    (tmp_path / "set" / "one.gold.json").write_text(json.dumps({"source": "x", "must_remove": ["Callisto Dondarelli", "Lodi"], "must_keep": ["ricorrente"], "must_remove_entities": [{"kind": "name", "role": "Ricorrente", "values": ["Callisto Dondarelli"]}]}))
    texts, gold = batch.read_gold(spark, str(tmp_path))
    assert [(r["source"], r["text"][-5:]) for r in texts.collect()] == [("set", "Lodi.")]
    assert sorted((r["entity"], r["surface"], r["remove"]) for r in gold.collect()) == [("Lodi", "Lodi", True), ("e0", "Callisto Dondarelli", True), ("ricorrente", "ricorrente", False)]


def test_sql_surface(spark):
    from legalveil import sqlviews

    sqlviews.register(spark, spark.createDataFrame([(1, "Il ricorrente Callisto Dondarelli insiste.")], "doc_id long, text string"))
    assert spark.sql("SELECT kind, text FROM decisions").collect()[0]["text"] == "Callisto Dondarelli"
    assert spark.sql("SELECT output FROM reports").first()[0] == "Il ricorrente Nominativo_1 insiste."
    assert {t.name for t in spark.catalog.listTables()} >= {"docs", "candidates", "decisions", "entities", "residuals", "reports"}


def test_expression_text_escapes():
    assert S.text_of("a'b\\c\n") == "'a\\'b\\\\c\\n'" and S.lit(None).sql == "NULL" and S.lit(0.5).sql == "0.5D"


def test_every_query_has_sql_of_its_own():
    assert set(queries.ORACLE_SQL) == set(queries.QUERIES)


def test_lazy_surface_and_projection():
    assert legalveil.anonymize is anonymize and legalveil.run_batch is batch.run
    with pytest.raises(AttributeError):
        legalveil.nothing  # noqa: B018
    assert evaluation.projection(100, 10.0) == {"ms_per_document": 100.0, "documents_per_second": 10.0, "hours": pytest.approx(27.78, abs=0.01)}
