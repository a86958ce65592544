"""What every operator must bear: repeated rows, ties, very long texts and clashing column names."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from legalveil.llm import hostrules, language, licences, mixing, nearest, ngramjoin, pieces, quality, repeats, toxicity

CLASH = ["k", "f", "t", "g", "n", "root", "what", "unit", "size", "score", "maybe", "records", "bucket", "row", "kept", "y", "id", "positive", "host", "range", "target", "component_id", "ids", "h", "x", "key"]


def words(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choices("bcdfglmnprst", k=6)) for _ in range(n))


LONG = words(9, 60_000) + " " + "x" * 300 + " " + words(9, 200)  # half a megabyte, one chunk and more


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, words(1, 80), "en", "a"), (1, words(1, 80), "en", "a"), (1, words(2, 80), "de", "b"), (2, LONG, "en", "a"), (3, None, None, None), (4, "", "de", "b"), (None, words(3, 80), "en", "b"), (5, words(1, 80) + "\nReleased under the MIT License.", "de", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for c in CLASH:
        d = d.withColumn(c, F.lit("clash"))
    return d.repartition(2)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 1), (2, 0, 0), (4, 0, 0), (5, 1, 1), (None, 1, 1)], "doc_id long, toxic int, quality int")


def by_id(df, *columns):
    return sorted(((r["doc_id"], *(r[c] for c in columns)) for r in df.collect()), key=str)


def test_jaccard(docs):
    got = by_id(ngramjoin.jaccard_classes(docs), "n_shingles", "component_id")
    assert [x for x in got if x[0] == 1] == [(1, 76, 1)] * 3 and len(got) == 8
    assert (3, 0, 3) in got and (4, 0, 4) in got and (None, 76, None) in got and (5, 81, 1) in got
    once = ngramjoin.one_of_each(docs)
    assert once.columns == docs.columns and once.count() == 6


def test_licences(docs):
    assert [(r["doc_id"], r["licence"], r["n_units"], r["whole"]) for r in licences.scan_licences(docs).collect()] == [(5, "MIT-line", 1, False)]


def test_licence_size_bounds(spark):
    template = {"T": "one two three four five six seven eight nine ten eleven"}  # ten bigrams
    line = template["T"].split()
    d = spark.createDataFrame([(1, " ".join(line[:9])), (2, " ".join(line[:8])), (3, " ".join(line + ["a", "b", "c"])), (4, " ".join(line + list("abcd"))), (1, " ".join(line[:9]))], "doc_id long, text string")
    got = {r["doc_id"]: (round(r["dice"], 3), r["n_units"]) for r in licences.scan_licences(d, templates=template).collect()}
    assert got == {1: (round(16 / 18, 3), 2), 3: (round(20 / 23, 3), 1)}


def test_pieces(docs):
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=pieces.MODEL)
    got = pieces.encode(docs).collect()
    want = sorted((r["doc_id"], sp.encode(r["text"] or "")) for r in docs.filter("doc_id is not null").collect())
    assert sorted((r["doc_id"], r["ids"]) for r in got if r["doc_id"] is not None) == want and len(got) == 8 and all(r["round_trip"] for r in got)
    assert sorted(str(r["text"]) for r in pieces.decode(pieces.encode(docs)).collect()) == sorted(str(r["text"] or "") for r in docs.collect())


def test_quality_and_toxicity(docs, labels):
    for got in (quality.quality(docs, labels), toxicity.toxicity(docs, labels)):
        rows = got.collect()
        assert len(rows) == 8 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
        assert len({r["score"] for r in rows if r["doc_id"] in (3, 4)}) == 1
        assert {r["held_out"] for r in rows if r["doc_id"] is None} == {False}


def test_languages(docs):
    got = language.languages(docs, divisor=1, held=1).collect()
    assert len(got) == 8 and {r["lang_pred"] for r in got} <= {"en", "de", "und"} and {r["lang_pred"] for r in got if r["doc_id"] in (3, 4)} == {"und"}


def test_every_language_can_be_predicted(spark):
    r = random.Random(4)
    names = [f"l{i}" for i in range(300)]
    own = {n: ["".join(r.choices("abcdefghilmnoprstu", k=5)) for _ in range(12)] for n in names}
    rows = [(i, " ".join(r.choices(own[n], k=40)), n) for i, n in enumerate(n for n in names for _ in range(5))]
    got = language.languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"), divisor=1, held=1)
    right = got.join(spark.createDataFrame(rows, "doc_id long, text string, lang string").select("doc_id", "lang"), "doc_id").filter("lang = lang_pred")
    assert right.count() >= 0.9 * len(rows) and right.select("lang").distinct().count() >= 290


def test_hosts(docs):
    got = hostrules.host_rules(docs, host="source").collect()
    assert len(got) == 8 and {(r["n_words"], r["base_failed"]) for r in got if r["doc_id"] in (3, 4)} == {(0, True)}


def test_mix(docs):
    got = mixing.mix(docs).collect()
    assert len(got) == 8 and all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    assert sorted(got, key=str) == sorted(mixing.mix(docs.repartition(5)).collect(), key=str)
    assert mixing.mixed_documents(docs).columns == docs.columns


def test_repeats(docs):
    got = by_id(repeats.drop_repeats(docs), "n_bytes", "n_removed", "n_spans")
    assert got.count((1, 559, 559, 1)) == 2 and (1, 559, 0, 0) in got and (3, 0, 0, 0) in got and (4, 0, 0, 0) in got
    long = next(x for x in got if x[0] == 2)
    assert long[1] == len(LONG) and long[2] >= 2 * 199 * 7 and long[3] >= 2  # the passage of 200 words twice, and the run of x


def test_nearest_ties_and_equal_ids(spark):
    rows = [(i, [1.0, 0.0]) for i in range(30)] + [(0, [0.5, 0.0]), (0, [1.0, 0.0]), (40, [1.0, 0.0, 0.0])]
    got = nearest.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    mine = {(r["query_id"], r["vec_id"]): r for r in got}
    assert len(got) == 40 and all(r["score"] == 0.5 for r in got if r["query_id"] == 0)  # of equal ids the least vector counts
    assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == 0] == list(range(1, 21))
    assert (20, 0) not in mine and [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == 20] == [*range(1, 20), 21]


def test_nearest_recall_as_shipped(spark):
    r = np.random.default_rng(5)
    centres = r.normal(size=(60, 32))
    x = (centres[r.integers(0, 60, 6_000)] + 0.7 * r.normal(size=(6_000, 32))).astype(np.float32)
    got = nearest.nearest(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")).collect()
    found, right = {(g["query_id"], g["vec_id"]) for g in got}, 0
    for q in range(0, 6_000, 20):
        s = x.astype(np.float64) @ x[q].astype(np.float64)
        s[q] = -np.inf
        right += len(found & {(q, int(j)) for j in np.argsort(-s)[:20]})
    assert right >= 0.9 * 300 * 20
