"""Embedding analytics, labels, tags and relations."""

import numpy as np
import pytest

from graphloom.operators import embeddings, labels, relations, tagging


def points(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v], c) for i, (v, c) in enumerate(rows)], "id long, vec array<double>, label int")


def test_cohesion(spark):
    r = {x["label"]: x["cohesion"] for x in embeddings.cohesion(points(spark, [([1, 0], 0), ([0, 1], 0), ([1, 0], 1)])).collect()}
    assert abs(r[0]) < 1e-12 and r[1] == 1.0


def test_silhouette_against_numpy(spark):
    rng = np.random.default_rng(3)
    v, c = rng.normal(size=(30, 5)), rng.integers(0, 3, 30)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    far = 1 - u @ u.T
    want = []
    for i in range(30):
        own = (c == c[i]) & (np.arange(30) != i)
        a, b = far[i][own].mean(), min(far[i][c == k].mean() for k in set(c) - {c[i]})
        want.append((b - a) / max(a, b))
    got = {r["id"]: r["silhouette"] for r in embeddings.silhouette(points(spark, list(zip(v, map(int, c))))).collect()}
    assert np.allclose([got[i] for i in range(30)], want)


def test_dbscan(spark):
    r = {x["id"]: (x["cluster"], x["core"]) for x in embeddings.dbscan(points(spark, [([1, 0], 0), ([1, 0.1], 0), ([1, 0.2], 0), ([0, 1], 0), ([-1, 0], 0)]).select("id", "vec"), 0.03, 3).collect()}
    assert r[0][0] == r[1][0] == r[2][0] == 0 and r[3] == (-1, False)


def test_links_leave_out_known(spark):
    p = points(spark, [([1, 0], 0), ([1, 0.1], 0), ([0, 1], 0)]).select("id", "vec")
    known = spark.createDataFrame([(0, 1)], "src long, dst long")
    got = [(r["src"], r["dst"]) for r in embeddings.predict_links(p, p, known, 10, 0.5, exclude_self=True).collect()]
    assert got == [(1, 0)]


def test_auc_and_precision(spark):
    s = spark.createDataFrame([(0.9, True), (0.8, False), (0.7, True), (0.7, False)], "score double, truth boolean")
    assert abs(labels.roc_auc(s).first()["auc"] - (2 + 0.5) / 4) < 1e-12
    assert abs(labels.average_precision(s).first()[0] - (0.5 * 1 + 0.5 * 0.5)) < 1e-12


def test_split_shares(spark):
    n = {r["part"]: r["count"] for r in labels.split(spark.range(101).withColumnRenamed("id", "id")).groupBy("part").count().collect()}
    assert n == {"train": 60, "val": 20, "test": 21}


def test_spans(spark):
    rows = [(1, 0, "a", "B-IP", 0.9), (1, 1, "b", "I-IP", 0.5), (1, 2, "c", "I-FILE", 0.9), (1, 3, "d", "B-FILE", 0.8), (1, 4, "e", "O", 0.9)]
    t = spark.createDataFrame(rows, "doc_id long, place long, token string, tag string, confidence double")
    assert sorted((r["kind"], r["value"], r["confidence"]) for r in tagging.spans(t).collect()) == [("FILE", "d", 0.8), ("IP", "a b", 0.5)]


@pytest.mark.parametrize("text, entities, want", [("see evil.com now", [("DOMAIN", "evil.com")], "O B-DOMAIN O"), ("Fancy Bear here", [("X", "Fancy Bear"), ("Y", "Bear")], "B-X I-X O"), ("xevil.com", [("DOMAIN", "evil.com")], "O"), ("", [("X", "a")], ""), ("(a.a.a) b  a.a", [("Y", "A.A"), ("Z", "a.a) b")], "B-Y O B-Y"), ("x b c d", [("P", "b c"), ("Q", "c d"), ("R", "D")], "O B-P I-P B-R")])
def test_tags(spark, text, entities, want):
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    e = spark.createDataFrame([(1, kind, value, i) for i, (kind, value) in enumerate(entities)], "doc_id long, kind string, value string, place int")
    got = {r["doc_id"]: " ".join(r["tags"]) for r in tagging.bio_tags(docs, e).collect()}
    assert got == {1: want, 2: ""}


def test_related(spark):
    docs = spark.createDataFrame([(1, "Bear exploited hole. It may not work.\nTail Bear"), (2, None)], "doc_id long, text string")
    sents = relations.sentences(docs)
    assert "".join(r["sentence"] for r in sents.where("doc_id = 1").orderBy("sid").collect()) == docs.first()["text"]
    names = spark.createDataFrame([("ThreatActor", "bear"), ("Vulnerability", "hole")], "kind string, name string")
    placed = relations.in_sentences(relations.find_mentions(docs, names), sents)
    r = relations.explicit(relations.relate(relations.pairs(placed), relations.windows(sents))).collect()
    assert [(x["source"], x["relation"], x["target"], x["certainty"], x["negation"]) for x in r] == [("bear", "exploits", "hole", "possible", True)]


def test_overlaps_keep_the_first(spark):
    m = spark.createDataFrame([(1, "k", "a", 0, 5), (1, "k", "b", 3, 8), (1, "k", "c", 5, 9), (1, "k", "d", 2, 2)], "doc_id long, kind string, name string, start long, stop long")
    assert {r["name"] for r in relations.keep_apart(m).collect()} == {"a", "c"}


@pytest.mark.parametrize("n, want", [(0, 0), (19, 1), (40, 2)])
def test_weak_relations_are_capped(spark, n, want):
    from pyspark.sql import functions as F

    assert spark.range(1).select(relations.allowed_weak(F.lit(n)).alias("x")).first()["x"] == want


def test_forms_of_names(spark):
    docs = spark.createDataFrame([(1, "CVE-2024-12345 and cve 2024 12345"), (2, "a fancy thing, no animal"), (3, "Fancy Bear is fancy")], "doc_id long, text string")
    names = spark.createDataFrame([("Vulnerability", "cve 2024 12345"), ("ThreatActor", "Fancy Bear")], "kind string, name string")
    got = sorted((r["doc_id"], r["name"], r["start"], r["stop"]) for r in relations.find_all_forms(docs, names).collect())
    assert got == [(1, "cve 2024 12345", 0, 14), (1, "cve 2024 12345", 19, 33), (2, "Fancy Bear", 2, 7), (3, "Fancy Bear", 0, 10)]


def test_checked_split_and_members(spark):
    items = spark.createDataFrame([(i, i % 2 if i < 20 else 7) for i in range(22)], "id long, grp int")
    n = {(r["grp"], r["part"]): r["count"] for r in labels.checked_split(items, "grp").groupBy("grp", "part").count().collect()}
    assert n == {(g, p): k for g in (0, 1) for p, k in (("train", 6), ("val", 2), ("test", 2))}
    assert labels.checked_split(items.where("grp <> 1"), "grp").count() == 12
    nodes = spark.createDataFrame([(10, 0), (11, 1), (12, 2)], "node_id long, pos long")
    members = spark.createDataFrame([(10, None, 4), (99, 1, 5), (None, 0, 6)], "node_id long, local_idx long, label int")
    assert {r["node_id"]: r["label"] for r in labels.assign_members(nodes, members).collect()} == {10: 4, 11: 5, 12: -1}


def test_unlabelled_get_the_nearest_label(spark):
    p = points(spark, [([1, 0], 3), ([0, 1], 4), ([1, 0.1], -1)])
    assert [(r["id"], r["predicted"]) for r in embeddings.classify_unlabelled(p).collect()] == [(2, 3)]
