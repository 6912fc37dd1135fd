"""Command line of the stages: python -m graphloom.cli STAGE --help."""

from __future__ import annotations

import argparse
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import embeddings as emb
from graphloom.operators import entities, features, graph, labels, metapath, relations, reports
from graphloom.operators.metapath import MetaPath
from graphloom.session import materialize
from graphloom.sources import readers, writers

TRIPLE_COLUMNS = ("head_id", "head_text", "head_type", "tail_id", "tail_text", "tail_type", "relation", "confidence", "certainty", "negation", "evidence_span", "sentence", "source_id", "source", "auto_mapped")


def relate(spark: SparkSession, a) -> None:
    """Documents (JSON or JSON lines) to triples and suggested predicates."""
    docs = materialize(readers.documents(spark, a.input), "documents")
    found = materialize(entities.extract(docs).select("doc_id", "kind", F.explode("vals").alias("name")), "entities")
    own = relations.find_all_forms(docs, found.select("kind", "name").distinct()).join(found, ["doc_id", "kind", "name"], "left_semi")
    sents = materialize(relations.sentences(docs), "sentences")
    placed = materialize(relations.in_sentences(own, sents), "placed")
    wins = relations.windows(sents, a.sentence_window)
    related = materialize(relations.relate(relations.pairs(placed, a.sentence_window), wins), "related")
    told = relations.explicit(related, a.min_confidence).select("doc_id", "wid", "source_kind", "source", "target_kind", "target", "relation", "confidence", "certainty", "negation")
    weak = relations.weak(related, a.max_related_to_ratio, a.min_dep_score, a.seed).select(*told.columns)
    of = lambda side: F.concat(F.lit("E"), F.substring(F.md5(F.concat_ws("|", f"{side}_kind", side)), 1, 12))
    rows = told.unionByName(weak).join(wins.select("doc_id", "wid", "evidence", "sentence"), ["doc_id", "wid"]).join(docs.select("doc_id", F.col("source").alias("origin")), "doc_id")
    rows = rows.select(
        of("source").alias("head_id"), F.col("source").alias("head_text"), F.col("source_kind").alias("head_type"), of("target").alias("tail_id"), F.col("target").alias("tail_text"), F.col("target_kind").alias("tail_type"),
        "relation", "confidence", "certainty", "negation", F.col("evidence").alias("evidence_span"), "sentence", F.col("doc_id").alias("source_id"), F.col("origin").alias("source"), F.lit(False).alias("auto_mapped"),
    )
    writers.triples(rows.select(*TRIPLE_COLUMNS), a.out, relations.frequent_words(sents, placed, a.predicate_min_freq, a.predicate_top_k))


def build(spark: SparkSession, a) -> None:
    """Triples to a graph: node, edge, relation and type tables, a report, and JSON for graph tools."""
    triples, _ = readers.triples(spark, a.input)
    triples = materialize(triples, "triples")
    nodes = materialize(graph.nodes(triples), "nodes")
    edges = materialize(graph.with_reverse(materialize(graph.edges(triples), "edges")), "both-ways")
    writers.graph(nodes, edges, a.output)
    writers.graph_report(triples, nodes, edges, f"{a.output}/report")
    if not a.no_networkx:
        writers.property_graph(nodes, edges, f"{a.output}/property-graph")


def paths_from(relation_rows: list[tuple[str, str, str]], kind: str) -> list[MetaPath]:
    """Named paths whose relations exist and every there-and-back path, of one start type or of all."""
    have = set(relation_rows)
    out = [p for p in metapath.CATALOGUE if set(p.path) <= have]
    seen = {p.path for p in out}
    for i, there in enumerate(sorted(have)):
        for back in sorted(r for r in have if r[0] == there[2] and r[2] == there[0]):
            if (there, back) not in seen:
                out.append(MetaPath(f"M{i}_{back[1]}", f"{there[0]}-{there[2]}-{there[0]}", (there, back)))
    return [p for p in out if kind == "all" or p.path[0][0] == kind]


def similarities(spark: SparkSession, a) -> None:
    """Meta-path counts, PathSim, learned weights and their combination, for one type or for each type."""
    tables = readers.graph(spark, a.hin_dir)
    triplets = [tuple(r) for r in tables["relations"].select(*graph.TRIPLET).collect()]  # the relation catalogue
    paths = paths_from(triplets, a.target_type)
    for kind in metapath.end_types(tuple(paths)) if a.target_type == "all" else [a.target_type]:
        own = [p for p in paths if p.path[0][0] == kind]
        if not own:
            continue
        counts = {p.id: materialize(metapath.commuting(tables["edges"], p), p.id) for p in own}
        similar = {m: materialize(metapath.pathsim(c), m) for m, c in counts.items()}
        first = metapath.combined(similar)
        items = tables["nodes"].where(F.col("node_type") == kind).select(F.col("canonical").alias("i"))
        positive = metapath.positive_pairs(tables["edges"], kind, first, a.num_positives)
        negative = metapath.negative_pairs(items, positive, a.num_negatives)
        scores = [np.array([[r[m] for m in similar] for r in metapath.pair_scores(similar, p).collect()], float).reshape(-1, len(similar)) for p in (positive, negative)]  # num_positives and num_negatives rows at most
        w, losses = metapath.learn_weights(*scores, a.epochs, a.lr)
        weights = {m: float(x) for m, x in zip(similar, w)}
        rows = spark.createDataFrame([(kind, m, x) for m, x in weights.items()], "node_type string, mp_id string, weight double")
        writers.metapaths(f"{a.output}/{kind}", counts, similar, metapath.combined(similar, weights), rows, losses)


def node_features(spark: SparkSession, a) -> None:
    """Features of every node: frequency, type and degrees, and meta-path features where a type has similarities."""
    tables = readers.graph(spark, a.hin_dir)
    nodes = tables["nodes"]
    basic = features.fallback_features(nodes).select("node_id", "features")
    degree = graph.degrees(tables["edges"]).join(nodes, ["node_type", "canonical"]).select("node_id", F.array("in_degree", "out_degree", "total_degree", "log_degree").alias("features"))
    blocks = [basic, degree]
    for r in tables["types"].select("node_type").distinct().collect() if a.metapath_dir else []:  # the type catalogue
        m = readers.table_or_empty(spark, f"{a.metapath_dir}/{r[0]}/combined", "i string, j string, value double")
        items = nodes.where(F.col("node_type") == r[0])
        f = features.metapath_features(m, items.select("canonical")).join(items, F.col("node") == F.col("canonical"))
        blocks.append(f.select("node_id", F.array("mean_sim", "max_sim", "std_sim", F.col("neighbours").cast("double")).alias("features")))
    whole = features.assemble(nodes, blocks).join(nodes.select("node_id", "node_type"), "node_id")
    writers.features(whole.select("node_type", "node_id", "features"), a.output)


def augment(spark: SparkSession, a) -> None:
    """The graph with features, and edges from meta-path similarities."""
    tables = readers.graph(spark, a.hin_dir)
    nodes = features.with_features(tables["nodes"], spark.read.parquet(a.features_dir)) if a.features_dir else tables["nodes"]
    edges = tables["edges"].select(*graph.TRIPLET, "src", "dst", "weight")
    for r in tables["types"].select("node_type").distinct().collect() if a.metapath_dir and not a.no_metapath else []:
        m = readers.table_or_empty(spark, f"{a.metapath_dir}/{r[0]}/combined", "i string, j string, value double").withColumn("mp_id", F.lit("combined"))
        more = features.augmented_edges(m, a.threshold, a.top_k)
        edges = edges.unionByName(more.select(F.lit(r[0]).alias("src_type"), F.lit("similar_to").alias("relation"), F.lit(r[0]).alias("dst_type"), F.col("i").alias("src"), F.col("j").alias("dst"), F.col("value").alias("weight")))
    writers.augmented(nodes, edges, a.output)


def cluster(spark: SparkSession, a) -> None:
    """Clusters of embeddings (node_type, node_id, vec) and their summaries, by density, by means, or both."""
    v = spark.read.parquet(a.embeddings)
    nodes = readers.graph(spark, a.hin_dir)["nodes"].select(F.col("node_id").alias("id"), "canonical", "frequency")
    p = v.select(F.col("node_id").alias("id"), "vec")
    for method in ("dbscan", "kmeans") if a.method == "both" else (a.method,):
        found = emb.dbscan(p, a.eps, a.min_samples) if method == "dbscan" else emb.kmeans(p, a.k)
        s = emb.summaries(p.join(found.where("cluster >= 0").select("id", F.col("cluster").alias("label")), "id"), nodes)
        members = F.transform("members", lambda m: F.struct(m["id"].alias("node_id"), F.lit(None).cast("long").alias("local_idx"), m["canonical"].alias("canonical"), m["frequency"].alias("frequency")))
        writers.clusters(s.select(F.col("label").alias("cluster_id"), "size", "cohesion", members.alias("members")), f"{a.output}/{method}")


def label(spark: SparkSession, a) -> None:
    """Labels of nodes from cluster files, renumbered, and their parts; --inspect prints sizes alone."""
    found = readers.clusters(spark, a.clusters)
    places = readers.graph(spark, a.graph)["types"].select("node_id", "node_type", "pos")
    labelled = labels.relabel(labels.assign_members(places, found), a.min_cluster_size)
    if a.inspect:
        labels.label_sizes(labelled).show()
        return
    some = labelled.where("new_label >= 0").select(F.col("node_id").alias("id"), F.col("new_label").alias("label"))
    labels.checked_split(some, "label", a.min_cluster_size, train=a.train, validation=a.val).write.mode("overwrite").parquet(a.output)


def predict(spark: SparkSession, a) -> None:
    """New links between nodes by their embeddings, and classes of nodes without a label."""
    v = spark.read.parquet(a.embeddings).select(F.col("node_id").alias("id"), "vec")
    tables = readers.graph(spark, a.graph)
    ids = tables["nodes"].select("node_type", "canonical", "node_id")
    end = lambda side: ids.select(F.col("node_type").alias(f"{side}_type"), F.col("canonical").alias(f"{side}_name"), F.col("node_id").alias(side))
    known = tables["edges"].withColumnsRenamed({"src": "src_name", "dst": "dst_name"}).join(end("src"), ["src_type", "src_name"]).join(end("dst"), ["dst_type", "dst_name"]).select("src", "dst")
    links = emb.predict_links(v, v, known, a.link_top_k, a.link_threshold, exclude_self=True, by_score=True)
    about = lambda side: reports.node_info(ids.select(F.col("node_id")), tables["nodes"]).select(F.col("node_id").alias(side), F.col("canonical").alias(f"{side}_name"), F.col("node_type").alias(f"{side}_type"))
    links.join(about("src"), "src").join(about("dst"), "dst").write.mode("overwrite").json(f"{a.output}/links")
    if a.labels:
        known = spark.read.parquet(a.labels).select("id", "label")
        emb.classify_unlabelled(v.join(known, "id", "left")).orderBy(F.desc("confidence"), "id").limit(a.node_top_k).write.mode("overwrite").json(f"{a.output}/classes")


def interpret(spark: SparkSession, a, ask: Callable[[str], str] | None = None) -> DataFrame:
    """Prompts on nodes of the predictions, and what an injected model answers to them."""
    links = spark.read.json(f"{a.predictions}/links")
    nodes = links.select(F.col("src").alias("node_id"), F.col("src_name").alias("canonical"), F.col("src_type").alias("node_type")).distinct()
    if a.list_nodes:
        nodes.orderBy("node_id").limit(50).show(50, False)
        return nodes
    some = reports.find_node(nodes, a.node_id, a.canonical, a.node_type).drop("matched").withColumn("frequency", F.lit(1))
    lines = links.select(F.col("src").alias("subject_id"), F.col("rank").cast("int").alias("rank"), F.lit("related_to").alias("relation"), F.col("dst_name").alias("object"), F.col("dst_type").alias("object_type"), "score", F.array().cast("array<string>").alias("evidence"))
    prompts = reports.prompts(some, lines).join(some.select("node_id", "canonical", "node_type"), "node_id")
    if ask is None:
        prompts.select("prompt").show(truncate=False)
    else:
        from graphloom.adapters import interpret as asked

        rows = prompts.limit(a.limit).collect()  # a model is asked one by one
        said = spark.createDataFrame([(r["node_id"], r["canonical"], r["node_type"], r["prompt"], t) for r, t in zip(rows, asked([r["prompt"] for r in rows], ask))], "node_id long, canonical string, node_type string, prompt string, answer string")
        if not a.no_save:
            writers.interpretations(said, f"{a.predictions}/interpretations")
    return prompts


def train(spark: SparkSession, a) -> None:
    raise SystemExit("graph neural networks aren't part of this package: train elsewhere, run the model with adapters.infer, save vectors with writers.embeddings")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="graphloom")
    stages = p.add_subparsers(dest="stage", required=True)

    def stage(name: str, run: Callable, *flags) -> None:
        s = stages.add_parser(name, help=run.__doc__)
        s.set_defaults(run=run)
        for flag, default in flags:
            own = {"action": "store_true"} if default is False else {"required": True} if default is ... else {"default": default, "type": type(default) if default is not None else str}
            s.add_argument(f"--{flag}", **own)

    stage("relate", relate, ("input", ...), ("out", ...), ("min_confidence", 0.45), ("min_dep_score", 0.5), ("max_related_to_ratio", 0.05), ("sentence_window", 1), ("predicate_min_freq", 3), ("predicate_top_k", 15), ("seed", 42))
    stage("build", build, ("input", ...), ("output", ...), ("no-networkx", False))
    stage("metapaths", similarities, ("hin-dir", ...), ("output", ...), ("target-type", "ThreatActor"), ("num-positives", 500), ("num-negatives", 1000), ("epochs", 100), ("lr", 0.01))
    stage("features", node_features, ("hin-dir", ...), ("metapath-dir", None), ("output", ...))
    stage("augment", augment, ("hin-dir", ...), ("metapath-dir", None), ("features-dir", None), ("output", ...), ("no-metapath", False), ("threshold", 0.1), ("top-k", 50))
    stage("train", train, ("graph", ...), ("task", "both"), ("epochs", 100))
    stage("clusters", cluster, ("embeddings", ...), ("hin-dir", ...), ("output", ...), ("method", "both"), ("eps", 0.5), ("min-samples", 3), ("k", 10))
    stage("labels", label, ("graph", ...), ("clusters", ...), ("output", "labels"), ("train", 0.6), ("val", 0.2), ("min-cluster-size", 3), ("inspect", False))
    stage("predict", predict, ("graph", ...), ("embeddings", ...), ("labels", None), ("output", ...), ("link-top-k", 100), ("link-threshold", 0.5), ("node-top-k", 50))
    stage("interpret", interpret, ("predictions", ...), ("node-id", None), ("canonical", None), ("node-type", None), ("list-nodes", False), ("no-save", False), ("limit", 10))
    return p


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(args)
    if getattr(a, "node_id", None) is not None:
        a.node_id = int(a.node_id)
    a.run(spark or SparkSession.builder.appName("graphloom").getOrCreate(), a)


if __name__ == "__main__":
    main()
