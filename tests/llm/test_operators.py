import hashlib
import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from legalveil.llm import hostrules, language, licences, mixing, nearest, ngramjoin, pieces, quality, repeats, toxicity

DOCS = "doc_id long, text string, source string, size string"


def texts():
    r = random.Random(1)
    vocabulary = [f"w{i}é"[: r.randrange(3, 6)] for i in range(400)]
    base = [" ".join(r.choices(vocabulary, k=r.randrange(1, 150))) for _ in range(60)]
    passage = " ".join(r.choices(vocabulary, k=70))
    near = [b.replace(b.split()[0], "zz", 1) for b in base[:20]]
    return [*base, *base[:10], *near, *[f"{b} {passage} {i}" for i, b in enumerate(base[20:30])], "ha " * 200, "", None, " \n ", "a b c", "A B C", "é" * 300]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i % 11 == 0 else f"s{i % 3}", "x") for i, t in enumerate(texts())]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS + ", lang string")


def test_jaccard_classes_match_brute_force(docs):
    sets = []
    for t in texts():
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set())
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    got = {r[0]: (r[1], r[2]) for r in ngramjoin.jaccard_classes(docs, block_tokens=300).collect()}
    assert got == {i: (len(sets[i]), find(i)) for i in range(len(sets))}


@pytest.mark.parametrize("sets", [60, 2500])
def test_linked_in_a_cluster_of_many_that_do_not_link(sets):
    """Also in time: texts around one original, most of which do not link, took a minute for 2,300."""
    r = np.random.default_rng(3)
    draw = lambda n: r.integers(0, 1 << 63, n, dtype=np.uint64)
    base, got = draw(140), []
    for _ in range(sets):
        kept = r.random(140) > r.choice([0.02, 0.1, 0.3, 0.5])
        got.append(np.unique(np.concatenate([base[kept], draw(int((~kept).sum()))])))
    known = np.where(np.arange(sets) % 10, np.arange(sets), 0)
    began = time.process_time()
    root = ngramjoin.linked(got, known=known)
    assert time.process_time() - began < 15
    want = np.arange(sets)
    holds = np.zeros((sets, 140), np.float32)
    n = np.array([len(s) for s in got])
    place = {int(t): i for i, t in enumerate(base)}
    for i, s in enumerate(got):
        holds[i, [place[t] for t in s.tolist() if t in place]] = 1
    both = holds @ holds.T  # what else they hold is their own
    link = (100 * both >= 75 * (n[:, None] + n[None] - both)) | (known[:, None] == known[None])
    while True:
        low = np.where(link, want[None], sets).min(axis=1)
        if (low == want).all():
            break
        want = low
    assert (root == want).all()


def test_a_cluster_of_texts_that_share_little_is_dealt_anew(spark):
    texts = [" ".join(f"{c}{i}" for c in "abcdefghijkl" for _ in "xy") for i in range(40)]
    texts += [t + " z" for t in texts[:5]]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("t", F.xxhash64("text"))
    facts = ngramjoin.set_facts(d, 5).filter("part < 0")
    one = facts.select("f", F.col("doc_id").alias("rep"), "n", F.lit(7).cast("long").alias("cluster"))
    left = {r["rep"]: r["cluster"] for r in ngramjoin.narrowed(one, d, 5, 75, 300, 4).collect()}
    assert sorted(left) == [0, 1, 2, 3, 4, 40, 41, 42, 43, 44]
    assert all(left[i] == left[40 + i] for i in range(5)) and len(set(left.values())) == 5


def test_repeats_match_brute_force(docs):
    raw = [(t or "").encode() for t in texts()]
    seen = Counter(b[p : p + 200] for b in raw for p in range(len(b) - 199))
    want = {}
    for i, b in enumerate(raw):
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 199):
            if seen[b[p : p + 200]] > 1:
                gone[p : p + 200] = True
        left = bytes(np.frombuffer(b, np.uint8)[~gone])
        want[i] = (len(b), int(gone.sum()), int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum()), hashlib.sha256(left).hexdigest())
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeats.drop_repeats(docs).collect()}
    assert got == want


@pytest.mark.parametrize("options", [{}, {"seen": 20}, {"short": 3}, {"block": 7}])
def test_pieces_match_the_library_and_round_trip(docs, options):
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=pieces.MODEL)
    more = docs.select("doc_id", "text").unionByName(docs.sparkSession.createDataFrame([(900, "  a\n b\tc  "), (901, "x" * 300), (902, "1.234, «ok» …"), (903, "日本語の文章 と長い" * 40)], "doc_id long, text string"))
    rows = more.join(pieces.encode(more, **options), "doc_id").collect()
    assert len(rows) == more.count()
    assert all(r["ids"] == sp.encode(r["text"] or "") and r["round_trip"] for r in rows)


def test_units_end_wherever_no_piece_goes_on():
    m = pieces.Model(["<unk>", "▁", "a", "b", "c", "é", "ab", "bc", "éa", "▁▁", "▁a"], [0, *range(-1, -11, -1)], [2, *[1] * 10])
    text = " abcac  éaéb a$b ".encode()
    start, end, _, first = pieces.cut_units(np.frombuffer(text, np.uint8), np.array([0, len(text)]), m)
    assert [text[i:j].decode() for i, j in zip(start, end, strict=True)] == [" abc", "a", "c", "  ", "éa", "é", "b", " a", "$", "b", " "] and first.tolist() == [0, 11]


def test_units_about_as_long_as_a_long_has_bits(spark):
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=pieces.MODEL)
    rows = [(n, ("thereforeandinternationalization" * 5)[:n]) for n in range(55, 130)]
    got = pieces.encode(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows) and all(r["ids"] == sp.encode(dict(rows)[r["doc_id"]]) for r in got)


def test_few_columns_go_to_python_for_each_edge(spark):
    # Spark adds up the sizes of all columns for each row that goes there
    d = spark.createDataFrame([(1, "the words of the text")], "doc_id long, text string")
    m = pieces.load_model()
    rows = pieces.edges_of(d.mapInArrow(*pieces.task_units(spark.sparkContext.broadcast(m), pieces.SEEN, "long", pieces.BLOCK)), m).collect()
    assert all(len(r) <= 3 for r in rows) and [r["hit"] for r in rows if r["data"] is not None] == [pieces.UNITS, pieces.TEXT]
    assert sum(r["hit"] >= 0 for r in rows) == len(rows) - 2 > 10


def _cheapest(unit, m):
    """By brute force: the least cost of any way to cut the unit, a symbol that is no piece last."""
    low = max(m.rank.values()) + 10
    best = [0.0] + [float("inf")] * len(unit)
    for e in range(1, len(unit) + 1):
        best[e] = min(best[s] + (m.rank.get(unit[s:e], low) if e - s == 1 else m.rank.get(unit[s:e], float("inf"))) for s in range(e))
    return best[-1]


def test_the_spark_viterbi_finds_the_best_path(spark):
    m = pieces.Model(["<unk>", "▁", "a", "b", "ab", "▁a", "ba", "bab"], [0, -3.0, -2.0, -2.1, -2.5, -2.2, -2.45, -3.3], [2, 1, 1, 1, 1, 1, 1, 1], bpe=False)
    r = random.Random(8)
    rows = [(i, "".join(r.choices("ab z", [4, 4, 1, 1], k=r.randrange(0, 90)))) for i in range(60)]
    got = pieces.encode(spark.createDataFrame(rows, "doc_id long, text string"), m).collect()
    low = max(m.rank.values()) + 10
    for x in got:
        text = rows[x["doc_id"]][1]
        whole = ("▁" + text.replace(" ", "▁")) if text else ""
        assert sum(low if i == 0 else -m.scores[i] for i in x["ids"]) == pytest.approx(_cheapest(whole, m))
        assert "".join("?" if i == 0 else m.pieces[i] for i in x["ids"]) == whole.replace("z", "?")


@pytest.mark.parametrize("short", [62, 4])
def test_merges_that_are_not_in_order_of_rank(spark, short):
    # "abc" ranks before "bc", which makes it: one pass over the edges would miss it
    m = pieces.Model(["<unk>", "a", "b", "c", "bc", "abc", "▁"], [0, -9, -9, -9, -5.0, -1.0, -9], [2, 1, 1, 1, 1, 1, 1])
    assert not m.in_order()
    rows = [(1, "abcabc abc cab" + "bc" * 20), (2, None), (3, "")]
    got = {x["doc_id"]: x["ids"] for x in pieces.encode(spark.createDataFrame(rows, "doc_id long, text string"), m, short=short).collect()}
    assert got == {1: [6, 5, 5, 6, 5, 6, 3, 1, 2, *[4] * 20], 2: [], 3: []}


def test_mix_meets_its_targets(docs):
    rows = mixing.mix(docs, range_rows=7).collect()
    assert sum(r["target"] for r in {r["source"]: r for r in rows}.values()) == pytest.approx(1.5 * sum(r["size"] for r in rows))
    for s in {r["source"] for r in rows}:
        own = [r for r in rows if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 1 and all(0 <= r["taken"] <= 2 * r["size"] for r in own)


def test_host_rules_count_windows_and_lines(spark):
    t = "a b c d e f g h x a b c d e f g h\nl 1\nl 1\n\n"
    r = hostrules.base_rules(spark.createDataFrame([(t,), (None,)], "text string")).collect()
    assert (r[0]["n_repeat_words"], r[0]["n_dup_lines"], r[0]["n_words"], r[1]["n_words"], r[1]["base_failed"]) == (16, 1, 21, 0, True)


def test_licence_lines(spark):
    d = spark.createDataFrame([(1, "text\nReleased under the MIT License.\nmore"), (2, "nothing here"), (3, None)], "doc_id long, text string")
    assert [(r["doc_id"], r["licence"]) for r in licences.scan_licences(d).collect()] == [(1, "MIT-line")]


def test_nearest_recall(spark):
    x = np.random.default_rng(0).normal(size=(400, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(400, None), (401, [0.0] * 8), (402, [float("nan")] * 8), (403, [1.0])]
    got = nearest.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), rerank=60, vector_block=128).collect()
    found = {(r["query_id"], r["vec_id"]) for r in got}
    best = 0
    for q in range(0, 400, 20):
        s = x @ x[q]
        s[q] = -np.inf
        best += len(found & {(q, int(j)) for j in np.argsort(-s)[:20]})
    assert best >= 0.9 * 400 and all(r["vec_id"] < 400 for r in got)


def test_classifiers_learn_and_take_nulls(spark):
    r = random.Random(2)
    rows = []
    for i in range(400):
        bad = i % 4 == 0
        words = ["".join(r.choices("abcdefg" if i % 2 else "tuvwxyz", k=5)) for _ in range(30)]
        rows.append((i, " ".join([*words, *(["idiot"] * bad)]) if i % 8 else " ".join(w.upper() + "!!" for w in words) + " idiot", "en" if i % 2 else "de", int(bad), int(i % 8 != 0)))
    d = spark.createDataFrame([*rows, (990, None, None, None, None), (991, "", "en", None, None), (992, "123 !", None, None, None)], "doc_id long, text string, lang string, toxic int, quality int")
    labels = d.select("doc_id", "toxic", "quality").filter("toxic is not null")
    tox = {x["doc_id"]: x for x in toxicity.toxicity(d.select("doc_id", "text"), labels).collect()}
    assert len(tox) == 403 and all(0 <= x["score"] <= 1 for x in tox.values())
    assert sum(tox[i]["predicted"] == y for i, _, _, y, _ in rows) >= 390
    good = {x["doc_id"]: x for x in quality.quality(d.select("doc_id", "text"), labels).collect()}
    assert sum(good[i]["score"] for i, *_, y in rows if y) / 350 > sum(good[i]["score"] for i, *_, y in rows if not y) / 50
    lang = {x["doc_id"]: x for x in language.languages(d.select("doc_id", "text", "lang")).collect()}
    assert sum(lang[i]["lang_pred"] == l for i, _, l, *_ in rows) >= 396 and [lang[i]["lang_pred"] for i in (990, 991, 992)] == ["und"] * 3


def test_empty_tables(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    for got in (ngramjoin.jaccard_classes(empty), repeats.drop_repeats(empty), pieces.encode(empty), mixing.mix(empty), hostrules.host_rules(empty), licences.scan_licences(empty), nearest.nearest(vectors), toxicity.toxicity(empty, labels), quality.quality(empty, labels), language.languages(empty)):
        assert got.count() == 0
