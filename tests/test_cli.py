"""The command line from documents to prompts, on a few reports."""

import json

import pytest


def test_all_stages(spark, tmp_path, capsys):
    from graphloom.cli import main

    names = ["APT28", "APT29", "Turla", "Sandworm"]
    docs = [{"id": f"d{i}", "source": "s", "text": f"{a} uses Mimikatz to attack. {a} exploits CVE-2021-44228{k} on hosts. {a} and {names[(i + 1) % 4]} were seen."} for i, a in enumerate(names) for k in "12"]
    (tmp_path / "docs.jsonl").write_text("\n".join(json.dumps(d | {"id": d["id"] + str(i)}) for i, d in enumerate(docs)))
    d = str(tmp_path)
    run = lambda *args: main(list(map(str, args)), spark)
    run("relate", "--input", f"{d}", "--out", f"{d}/triples")
    triples = spark.read.json(f"{d}/triples")
    assert triples.where("relation = 'exploits' and head_type = 'ThreatActor' and tail_type = 'Vulnerability'").count() >= 8
    run("build", "--input", f"{d}/triples", "--output", f"{d}/graph")
    report = spark.read.json(f"{d}/graph/report").first()
    assert {t["node_type"] for t in report["types"]} >= {"ThreatActor", "Vulnerability"} and report["top_nodes"]
    edges = spark.read.json(f"{d}/graph/property-graph/edges")
    assert edges.count() == spark.read.parquet(f"{d}/graph/edges").count()
    run("metapaths", "--hin-dir", f"{d}/graph", "--output", f"{d}/mp", "--epochs", 5)
    combined = spark.read.parquet(f"{d}/mp/ThreatActor/combined")
    assert combined.count() > 0
    run("features", "--hin-dir", f"{d}/graph", "--metapath-dir", f"{d}/mp", "--output", f"{d}/features")
    f = spark.read.parquet(f"{d}/features")
    assert f.selectExpr("size(features) s").distinct().count() == 1 and spark.read.parquet(f"{d}/features-stats").count() == f.selectExpr("size(features) s").first()["s"]
    run("augment", "--hin-dir", f"{d}/graph", "--metapath-dir", f"{d}/mp", "--features-dir", f"{d}/features", "--output", f"{d}/augmented")
    assert spark.read.parquet(f"{d}/augmented/edges").where("relation = 'similar_to'").count() > 0
    vectors = f.selectExpr("node_type", "node_id", "features as vec")
    from graphloom.sources import readers, writers

    writers.embeddings(vectors, f"{d}/emb")
    run("clusters", "--embeddings", f"{d}/emb/vectors", "--hin-dir", f"{d}/graph", "--output", f"{d}/clusters", "--k", 3)
    assert readers.clusters(spark, f"{d}/clusters/kmeans/*.json").count() == vectors.count()
    run("labels", "--graph", f"{d}/graph", "--clusters", f"{d}/clusters/kmeans/*.json", "--output", f"{d}/labels", "--min-cluster-size", 1)
    assert {r["part"] for r in spark.read.parquet(f"{d}/labels").collect()} <= {"train", "val", "test"}
    run("predict", "--graph", f"{d}/graph", "--embeddings", f"{d}/emb/vectors", "--labels", f"{d}/labels", "--output", f"{d}/pred", "--link-threshold", 0.0)
    links = spark.read.json(f"{d}/pred/links")
    assert links.count() > 0 and links.where("src = dst").count() == 0
    run("interpret", "--predictions", f"{d}/pred", "--node-id", links.first()["src"])
    assert "Predicted links" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        run("train", "--graph", d)
