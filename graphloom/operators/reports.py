"""Looking up predictions, evidence from texts, and prompts for interpretation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def find_node(predictions: DataFrame, node_id: int | None = None, name: str | None = None, kind: str | None = None) -> DataFrame:
    """Predictions on a node (node_id, canonical, node_type, ...), matched by id, else by part of the name, else by type."""
    never = F.lit(False)
    by_id = F.col("node_id") == node_id if node_id is not None else never
    by_name = F.contains(F.lower("canonical"), F.lit(name.lower())) if name else never
    by_kind = F.col("node_type") == kind if kind else never
    how = F.when(by_id, "id").when(by_name, "name").when(by_kind, "type")
    return predictions.withColumn("matched", how).where("matched is not null")


def list_nodes(predictions: DataFrame, kind: str | None = None, limit: int = 50) -> DataFrame:
    """Up to limit different nodes of each group's first limit predictions (grp, rank, node_id, canonical, node_type), in order."""
    p = predictions.where(F.col("rank") <= limit)
    p = p.where(F.col("node_type") == kind) if kind else p
    return p.select("node_id", "canonical", "node_type").distinct().orderBy("node_id", "canonical", "node_type").limit(limit)


def evidence(pairs: DataFrame, docs: DataFrame, most: int = 5, before: int = 120, width: int = 400) -> DataFrame:
    """Documents that hold both names of a pair (subject, object), case ignored: the first `most` by doc_id with a snippet.

    The snippet starts 120 characters before the subject. Pairs must be few: they're sent to every task that
    reads texts, so that texts are read once and not dealt out.
    """
    low = docs.where("text is not null and text <> ''").select("doc_id", F.lower("text").alias("low"))
    both = low.join(F.broadcast(pairs.select("subject", "object").distinct()), F.expr("instr(low, lower(subject)) > 0 and instr(low, lower(object)) > 0"))
    start = F.greatest(F.lit(1), F.expr("instr(low, lower(subject))") - before)
    hits = both.select("subject", "object", "doc_id", F.trim(F.substring("low", start, F.lit(width))).alias("snippet"))
    return hits.withColumn("hit", F.row_number().over(Window.partitionBy("subject", "object").orderBy("doc_id"))).where(F.col("hit") <= most)


def metapath_label(labels: DataFrame, mp_id: str = "mp_id") -> Column:
    """A meta-path's name from its label, else its report name, else its id, else its number."""
    return F.coalesce(*(F.col(c) for c in ("label", "report_name", mp_id) if c in labels.columns), F.concat(F.lit("metapath_"), F.col("number").cast("string")))


def weights_with_fallback(items: DataFrame, nested: DataFrame, flat: DataFrame, generic: float) -> DataFrame:
    """Weight of each (node_type, mp_id): that of its type, else that of the path alone, else one for all."""
    n = nested.select("node_type", "mp_id", F.col("weight").alias("w1"))
    f = flat.select("mp_id", F.col("weight").alias("w2"))
    return items.join(n, ["node_type", "mp_id"], "left").join(f, "mp_id", "left").select("node_type", "mp_id", F.coalesce("w1", "w2", F.lit(generic)).alias("weight"))


def support(similarities: DataFrame, weights: DataFrame, pairs: DataFrame, k: int = 5, least: float = 1e-12) -> DataFrame:
    """The k meta-paths that weigh most for each pair (i, j), of those with a weight over the floor."""
    w = weights.where(F.col("weight") > least)
    s = pairs.select("i", "j").join(similarities, ["i", "j"]).join(F.broadcast(w), "mp_id")
    s = s.withColumn("score", F.col("weight") * F.col("value"))
    return s.withColumn("rank", F.row_number().over(Window.partitionBy("i", "j").orderBy(F.desc("score"), "mp_id"))).where(F.col("rank") <= k)


def describe(names: Column) -> Column:
    return F.concat(F.lit("Connection through: "), F.array_join(names, " -> "))


def node_info(ids: DataFrame, node_table: DataFrame) -> DataFrame:
    """Each id with its node's name, type and frequency; unknown_<id> where there is no node."""
    n = node_table.select("node_id", "canonical", "node_type", "frequency")
    return ids.join(n, "node_id", "left").select(*ids.columns, F.coalesce("canonical", F.concat(F.lit("unknown_"), "node_id")).alias("canonical"), F.coalesce("node_type", F.lit("Unknown")).alias("node_type"), F.coalesce("frequency", F.lit(0)).cast("long").alias("frequency"))


def link_lines(links: DataFrame, most: int = 10) -> DataFrame:
    """Text of each subject's predicted links (subject_id, rank, relation, object, object_type, score, evidence): its first `most`."""
    proof = F.when(F.size("evidence") > 0, F.concat(F.lit("\n  evidence: "), F.array_join(F.slice("evidence", 1, 3), "; "))).otherwise("")
    line = F.concat(F.format_string("%d. %s -> %s (%s), confidence %.3f", "rank", "relation", "object", "object_type", "score"), proof)
    top = links.where(F.col("rank") <= most).select("subject_id", "rank", line.alias("line"))
    return top.groupBy("subject_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]), "\n").alias("links"))


def prompts(subjects: DataFrame, links: DataFrame, classes: DataFrame | None = None, clusters: DataFrame | None = None) -> DataFrame:
    """A prompt for each subject (node_id, canonical, node_type, frequency) from its links, class and cluster texts."""
    s = subjects.join(link_lines(links).withColumnRenamed("subject_id", "node_id"), "node_id", "left")
    for name, table in (("classes", classes), ("clusters", clusters)):
        s = s.join(table.select("node_id", F.col("text").alias(name)), "node_id", "left") if table is not None else s.withColumn(name, F.lit(None).cast("string"))
    parts = [
        F.format_string("Node %d: %s (%s), seen %d times", "node_id", "canonical", "node_type", "frequency"),
        F.concat(F.lit("Predicted links:\n"), F.coalesce("links", F.lit("none"))),
        F.concat(F.lit("Class: "), F.coalesce("classes", F.lit("none"))),
        F.concat(F.lit("Cluster: "), F.coalesce("clusters", F.lit("none"))),
        F.lit("Assess the threat, list key findings, recommend actions, and say how sure you are."),
    ]
    return s.select("node_id", F.array_join(F.array(*parts), "\n\n").alias("prompt"))
