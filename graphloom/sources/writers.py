"""Writers of graphs, similarities, features, data sets, summaries and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.features import summary as graph_summary
from graphloom.operators.features import vector_stats
from graphloom.operators.graph import TRIPLET, density, edge_stats, local_index, top_nodes, type_counts


def graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes, edges by triplet so that a relation is read alone, a row for each triplet with its shape and density, and places in types."""
    nodes.write.mode("overwrite").partitionBy("node_type").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").partitionBy("src_type", "relation", "dst_type").parquet(f"{path}/edges")
    density(edges, nodes).write.mode("overwrite").parquet(f"{path}/relations")
    local_index(nodes).write.mode("overwrite").parquet(f"{path}/types")


def property_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes and edges as JSON lines with the nodes' global ids at both ends, for graph tools."""
    end = lambda side: nodes.select(F.col("node_type").alias(f"{side}_type"), F.col("canonical").alias(side), F.col("node_id").alias(f"{side}_id"))
    nodes.select("node_id", "node_type", "canonical", "frequency").write.mode("overwrite").json(f"{path}/nodes")
    edges.join(end("src"), ["src_type", "src"]).join(end("dst"), ["dst_type", "dst"]).select("src_id", "relation", "dst_id", "weight", "count", "negations").write.mode("overwrite").json(f"{path}/edges")


def graph_report(triples: DataFrame, nodes: DataFrame, edges: DataFrame, path: str, k: int = 20) -> None:
    """One JSON row: nodes by type, triplets with their statistics and density, and the most frequent nodes."""
    stats = edge_stats(triples).join(density(edges, nodes).select(*TRIPLET, "edges", "density"), list(TRIPLET), "left")
    rows = lambda df, name: df.agg(F.array_sort(F.collect_list(F.struct(*df.columns))).alias(name))  # noqa: E731  a row for each type, triplet or top node
    whole = rows(type_counts(nodes), "types").join(rows(stats, "relations")).join(rows(top_nodes(nodes, k).select(F.col("frequency"), "node_id", "node_type", "canonical"), "top_nodes"))
    summary(whole, path)


def relation(spark, path: str, src: str, name: str, dst: str) -> DataFrame:
    """The edges of one triplet: partition columns prune the rest."""
    e = spark.read.parquet(f"{path}/edges")
    return e.where((F.col("src_type") == src) & (F.col("relation") == name) & (F.col("dst_type") == dst))


def similarities(matrices: dict[str, DataFrame], path: str) -> None:
    out = None
    for m, df in matrices.items():
        part = df.select(F.lit(m).alias("mp_id"), "i", "j", "value")
        out = part if out is None else out.unionByName(part)
    if out is not None:
        out.write.mode("overwrite").partitionBy("mp_id").parquet(path)


def metapaths(path: str, commuting: dict[str, DataFrame], similar: dict[str, DataFrame], combined: DataFrame, weights: DataFrame, losses: list[float] = ()) -> None:
    """Matrices by meta-path, their weighted sum, the weights with the losses of learning them, and a report of sizes."""
    similarities(commuting, f"{path}/commuting")
    similarities(similar, f"{path}/pathsim")
    combined.select("i", "j", "value").write.mode("overwrite").parquet(f"{path}/combined")
    summary(weights.withColumn("loss_history", F.array(*map(F.lit, losses)) if losses else F.array().cast("array<double>")), f"{path}/weights")
    spark = combined.sparkSession
    count = lambda name: spark.read.parquet(f"{path}/{name}").groupBy("mp_id").agg(F.count(F.lit(1)).alias(f"{name}_nnz"))
    summary(count("commuting").join(count("pathsim"), "mp_id", "full"), f"{path}/report")


def features(table: DataFrame, path: str) -> None:
    """Features (node_type, node_id, features) and beside them the mean and deviation of every component."""
    table.write.mode("overwrite").parquet(path)
    vector_stats(table.sparkSession.read.parquet(path), "features").write.mode("overwrite").parquet(f"{path}-stats")


def augmented(nodes: DataFrame, edges: DataFrame, path: str, width: int = 0) -> None:
    """The augmented graph's tables and the sizes of its parts."""
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").partitionBy("src_type", "relation", "dst_type").parquet(f"{path}/edges")
    summary(graph_summary(nodes, edges, width), f"{path}/meta")


def embeddings(vectors: DataFrame, path: str) -> None:
    """Embeddings (node_type, node_id, vec) by type, with the number of vectors and their width."""
    vectors.write.mode("overwrite").partitionBy("node_type").parquet(f"{path}/vectors")
    summary(vectors.groupBy("node_type").agg(F.count(F.lit(1)).alias("vectors"), F.max(F.size("vec")).alias("width")), f"{path}/meta")


def clusters(summaries: DataFrame, path: str) -> None:
    """Cluster summaries as JSON lines, a file set that readers.clusters() reads."""
    summaries.write.mode("overwrite").json(path)


def interpretations(answers: DataFrame, path: str) -> None:
    """Answers (node_id, canonical, node_type, prompt, answer) as JSON, and as Markdown, a section for each."""
    answers.write.mode("overwrite").json(f"{path}/json")
    head = F.concat(F.lit("# "), F.coalesce("canonical", F.lit("")), F.lit(" ("), F.coalesce("node_type", F.lit("")), F.lit(")"))
    text(answers.select(F.concat_ws("\n\n", head, F.col("answer"), F.lit("")).alias("section")), "section", f"{path}/markdown")


def label_mapping(ids: DataFrame, path: str) -> None:
    """Labels and their numbers, beside a model that an adapter saved."""
    summary(ids, path)


def dataset(documents: DataFrame, path: str, stats: DataFrame | None = None) -> None:
    """Documents with their maps of entities and confidences, as JSON lines; statistics by type as lines of text beside them."""
    documents.write.mode("overwrite").json(path)
    if stats is not None:
        line = F.format_string("%s: %d values, in %d documents (%.1f%%), confidence %.3f", "kind", "total_values", "with_values", "percentage", "avg_confidence")
        text(stats.orderBy("kind").select(line.alias("line")).coalesce(1), "line", f"{path}-stats")


def triples(table: DataFrame, path: str, suggestions: DataFrame | None = None) -> None:
    """Triples as JSON lines; suggested predicates, with the sentences they stand in, beside them."""
    table.write.mode("overwrite").json(path)
    if suggestions is not None:
        summary(suggestions, f"{path}-predicates")


def summary(table: DataFrame, path: str) -> None:
    """A small report: one JSON file."""
    table.coalesce(1).write.mode("overwrite").json(path)


def text(lines: DataFrame, column: str, path: str) -> None:
    lines.select(column).write.mode("overwrite").text(path)
