"""Graph, meta-path and feature operators on small graphs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.operators import features, graph, metapath, reports

TRIPLE = "head_type string, head_text string, relation string, tail_type string, tail_text string, confidence double, negation boolean, source string, ord long"


@pytest.fixture(scope="module")
def triples(spark):
    rows = [("A", "a", "uses", "B", "b", 0.8, False, "s", 1), ("A", " a ", "uses", "B", "b", 0.6, True, "t", 2), ("A", "c", "foo", "B", "b", 0.5, False, "s", 3), ("A", "", "foo", "B", "b", 0.5, False, "s", 4), ("A", "d", "foo", "B", "e", None, False, "s", 5)]
    return spark.createDataFrame(rows, TRIPLE)


def test_edges(triples):
    e = {(r["src"], r["relation"], r["dst"]): (round(r["weight"], 9), r["count"], r["negations"]) for r in graph.edges(triples).collect()}
    assert e == {("a", "uses", "b"): (0.7, 2, 1), ("c", "foo", "b"): (0.5, 1, 0)}


def test_nodes_by_first_appearance(triples):
    n = [(r["canonical"], r["frequency"], r["sources"]) for r in graph.nodes(triples).orderBy("node_id").collect()]
    assert n == [("a", 2, ["s", "t"]), ("b", 3, ["s", "t"]), ("c", 1, ["s"])]


def test_reverse(triples):
    e = graph.edges(triples)
    twice = graph.with_reverse(graph.with_reverse(e))
    assert {r["relation"] for r in graph.with_reverse(e).collect()} == {"uses", "used_by", "foo", "foo_rev"}
    assert twice.count() >= 4


def test_no_rows(spark):
    empty = spark.createDataFrame([], TRIPLE)
    assert graph.edges(empty).count() == 0 and graph.nodes(empty).count() == 0


def matrix(spark, m):
    return spark.createDataFrame([(str(i), str(j), float(v)) for i, r in enumerate(m) for j, v in enumerate(r) if v], "i string, j string, value double")


def test_pathsim(spark):
    s = {(r["i"], r["j"]): r["value"] for r in metapath.pathsim(matrix(spark, [[2, 1], [1, 4]])).collect()}
    assert s[("0", "0")] == s[("1", "1")] == 1 and abs(s[("0", "1")] - 1 / 3) < 1e-12


def test_product_and_pagerank_against_numpy(spark):
    rng = np.random.default_rng(0)
    a, b = (np.round(rng.random((6, 6)) * (rng.random((6, 6)) > 0.5), 3) for _ in range(2))
    got = np.zeros((6, 6))
    for r in metapath.multiply(matrix(spark, a), matrix(spark, b)).collect():
        got[int(r["i"]), int(r["j"])] = r["value"]
    assert np.allclose(got, a @ b)
    items = spark.createDataFrame([(str(i),) for i in range(6)], "i string")
    t = a.sum(1)
    p = a / np.where(t == 0, 1, t)[:, None]
    v = np.full(6, 1 / 6)
    for _ in range(5):
        v = 0.85 * p.T @ v + 0.15 / 6
    rank = {r["node"]: r["rank"] for r in features.pagerank(matrix(spark, a), items, iterations=5, tolerance=None).collect()}
    assert np.allclose([rank[str(i)] for i in range(6)], v) and sum(rank.values()) <= 1 + 1e-9


def test_prune_breaks_ties_by_column(spark):
    got = {r["j"] for r in metapath.prune(matrix(spark, [[1, 2, 1, 2]]), 3).collect()}
    assert got == {"0", "1", "3"}


def test_weights_prefer_the_path_that_tells(spark):
    rng = np.random.default_rng(1)
    w, loss = metapath.learn_weights(np.stack([np.full(200, 0.9), rng.random(200)], 1), np.stack([np.full(200, 0.1), rng.random(200)], 1))
    assert w[0] > w[1] and loss[-1] < loss[0] and abs(w.sum() - 1) < 1e-12


def test_metapath_features_count_missing_as_zero(spark):
    items = spark.createDataFrame([(str(i),) for i in range(4)], "i string")
    r = {x["node"]: x for x in features.metapath_features(matrix(spark, [[5, 1, 0, 0], [1, 5, 0, 0], [0, 0, 5, 0], [0, 0, 0, 5]]), items).collect()}
    assert abs(r["0"]["mean_sim"] - 0.25) < 1e-12 and r["0"]["neighbours"] == 1 and r["2"]["mean_sim"] == 0


def test_overlap_keeps_types_apart(spark):
    e = spark.createDataFrame([("A", "r", "B", "1", "x", 1.0, 1, 0), ("A", "r", "C", "2", "x", 1.0, 1, 0), ("A", "r", "B", "2", "y", 1.0, 1, 0), ("A", "r", "B", "1", "y", 1.0, 1, 0)], "src_type string, relation string, dst_type string, src string, dst string, weight double, count long, negations long")
    p = spark.createDataFrame([("A", "1", "A", "2")], "a_type string, a string, b_type string, b string")
    assert abs(graph.neighbour_overlap(e, p).first()["overlap"] - 1 / 3) < 1e-12


def test_find_node_takes_zero(spark):
    n = spark.createDataFrame([(0, "a", "T"), (1, "Xb", "T"), (2, "c", "U")], "node_id long, canonical string, node_type string")
    assert {(r["node_id"], r["matched"]) for r in reports.find_node(n, 0, "xB", "U").collect()} == {(0, "id"), (1, "name"), (2, "type")}


def test_days_are_elapsed_time(spark):
    from datetime import datetime

    t = spark.createDataFrame([(1, datetime(2024, 1, 1, 12), datetime(2024, 1, 2, 11), 1)], "grp long, first_seen timestamp, last_seen timestamp, frequency long")
    assert graph.temporal_span(t).first()["span_days"] == 0


@pytest.mark.parametrize("measure", ["product", "pathsim", "overlap"])
def test_blocks_against_numpy(spark, monkeypatch, measure):
    from graphloom.operators import blocks

    monkeypatch.setattr(blocks, "PIECE", 40)
    monkeypatch.setattr(blocks, "HELD", 3)
    monkeypatch.setattr(blocks, "READ", 4)
    rng = np.random.default_rng(5)
    ms = [np.round(rng.random((60, 25)) * (rng.random((60, 25)) < 0.2), 3), (np.arange(60)[:, None] % 4 == np.arange(25)) * 1.0]
    ms[0][:, 7] = 0.5  # a key of all rows
    frames = [spark.createDataFrame([(f"n{i}", f"k{k}", float(m[i, k])) for i, k in np.argwhere(m).tolist()] * 2, "i string, k string, value double") for m in ms]

    def measured(m):
        c = m @ m.T
        d = np.diag(c)
        total = d[:, None] + d - (0 if measure == "pathsim" else c)
        return c if measure == "product" else np.divide((2 if measure == "pathsim" else 1) * c, total, out=np.zeros_like(c), where=total > 1e-10)

    want = 0.7 * measured(ms[0]) + 0.3 * measured(ms[1])
    rows = blocks.similar_rows(frames, [0.7, 0.3], measure).collect()
    got = {(r["i"], j): v for r in rows for j, v in zip(r["js"], r["vals"])}
    assert len(got) == sum(len(r["js"]) for r in rows) == (want != 0).sum()
    assert all(abs(got[f"n{i}", f"n{j}"] - want[i, j]) < 1e-9 for i, j in np.argwhere(want).tolist())
    few = blocks.similar_rows(frames, [0.7, 0.3], measure, keep=3, floor=0.2, apart=True).collect()
    np.fill_diagonal(want, 0)
    assert sum(r["n"] for r in few) == (want >= 0.2).sum() and abs(sum(r["total"] for r in few) - want[want >= 0.2].sum()) < 1e-9
    for i in range(60):
        kept = sorted((v for r in few if r["i"] == f"n{i}" for v in r["vals"]), reverse=True)[:3]
        assert np.allclose(kept, sorted(want[i][want[i] >= 0.2], reverse=True)[:3])


TABLES = "/root/testdata/sf0.001"


def plan_of(query, spark):
    import os

    from graphloom.plans.queries import QUERIES

    if not os.path.isdir(TABLES):
        pytest.skip("no test tables")
    return QUERIES[query](spark, TABLES)._jdf.queryExecution().executedPlan().toString()


def deals_out_products(query, spark):
    """Whether a query's plan sends a row for each product of two links to another task."""
    import re

    return bool(re.search(r"hashpartitioning\(i#\d+, j#\d+", plan_of(query, spark)))


def test_pathsim_deals_out_no_products(spark):
    assert not deals_out_products("pathsim_sps", spark)


def test_group_overlap_deals_out_no_neighbours(spark):
    assert "vt" not in (p := plan_of("jaccard_neighbors", spark)) and "MapInArrow" in p


def test_stats_come_from_rows(spark):
    assert "js" not in (p := plan_of("pathsim_stats", spark)).split("MapInArrow")[0] and "MapInArrow" in p


def test_pathsim_of_some_pairs(spark):
    rng = np.random.default_rng(7)
    m = np.round(rng.random((9, 6)) * (rng.random((9, 6)) < 0.4), 3)
    frame = spark.createDataFrame([(str(i), str(k), float(m[i, k])) for i, k in np.argwhere(m).tolist()] * 2, "i string, k string, value double")
    pairs = [(i, j) for i in range(9) for j in range(9) if (i + j) % 3 == 0]
    c = m @ m.T
    got = {(int(r["i"]), int(r["j"])): r["value"] for r in metapath.pairs_pathsim(frame, spark.createDataFrame([(str(i), str(j)) for i, j in pairs], "i string, j string")).collect()}
    assert set(got) == {(i, j) for i, j in pairs if c[i, j]}
    assert all(abs(v - 2 * c[i, j] / (c[i, i] + c[j, j])) < 1e-12 for (i, j), v in got.items())


def test_commuting_deals_out_no_products(spark):
    assert not deals_out_products("commuting_sps", spark)


def test_augmented_edges_deal_out_no_products(spark):
    assert not deals_out_products("augmented_edges", spark)


def test_combined_similarity_deals_out_no_products(spark):
    assert not deals_out_products("combined_similarity", spark)


def test_metapath_features_of_the_largest_values(spark):
    m = matrix(spark, [[5, 3, 1, 0], [3, 5, 0, 0], [1, 0, 5, 0], [0, 0, 0, 5]])
    items = m.select("i").distinct()
    counts = spark.createDataFrame([("0", 2), ("1", 1), ("2", 1)], "i string, neighbours long").select(F.col("i").cast(items.schema["i"].dataType).alias("i"), "neighbours")
    top = metapath.prune(m.where("i <> j"), 1)
    want = {r["node"]: r for r in features.metapath_features(m, items, 1).collect()}
    assert {r["node"]: r for r in features.metapath_features(top, items, 1, counts).collect()} == want


def test_pagerank_writes_no_second_matrix(spark, monkeypatch):
    written = []
    monkeypatch.setattr(features, "materialize", lambda df, name: written.append(df.columns) or df)
    m = matrix(spark, [[0, 1, 2], [1, 0, 0], [0, 0, 0]])
    features.pagerank(m, m.select("i").distinct(), iterations=2, tolerance=None)
    assert written and not any("j" in columns for columns in written)


def test_pagerank_by_blocks_deals_out_no_entries(spark, monkeypatch):
    import duckdb

    from graphloom.operators import blocks
    from graphloom.plans.queries import ORACLES, QUERIES

    d, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events".split():
        con.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    want = dict(con.execute(ORACLES["pagerank_fixed"]).fetchall())
    monkeypatch.setattr(blocks, "entries", None)
    got = {r["node"]: r["rank"] for r in QUERIES["pagerank_fixed"](spark, d).collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 2e-9 for k in want)


def test_pagerank_by_blocks_is_that_of_the_matrix(spark, monkeypatch):
    from graphloom.operators import blocks

    monkeypatch.setattr(blocks, "PRODUCTS", 50)
    rng = np.random.default_rng(11)
    terms = []
    for width in (7, 3):
        m = np.round(rng.random((40, width)) * (rng.random((40, width)) < 0.3), 3)
        terms.append(spark.createDataFrame([(str(i), f"k{k}", float(m[i, k])) for i, k in np.argwhere(m).tolist()], "i string, k string, value double"))
    m = blocks.entries(blocks.similar_rows(terms, [0.7, 0.3])).localCheckpoint()
    want = {r["node"]: r["rank"] for r in features.pagerank(m, m.select("i").distinct(), iterations=3, tolerance=None).collect()}
    got = {r["node"]: r["rank"] for r in blocks.pagerank(terms, [0.7, 0.3], iterations=3).collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert blocks.pagerank([t.limit(0) for t in terms], [0.7, 0.3]).count() == 0
