"""Node features and the augmented graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.operators.metapath import prune
from graphloom.session import materialize


def fallback_features(node_table: DataFrame) -> DataFrame:
    """[frequency, log1p(frequency), one-hot of the type] of each node; types in alphabetic order."""
    types = [r[0] for r in node_table.select("node_type").distinct().orderBy("node_type").collect()]  # the type catalogue
    hot = [F.when(F.col("node_type") == t, 1.0).otherwise(0.0) for t in types]
    return node_table.select("node_type", "node_id", F.array(F.col("frequency").cast("double"), F.log1p(F.col("frequency").cast("double")), *hot).alias("features"))


def pagerank(similarity: DataFrame, items: DataFrame, damping: float = 0.85, iterations: int = 100, tolerance: float | None = 1e-6) -> DataFrame:
    """(node, rank) over a similarity matrix (i, j, value) with rows made to sum to 1.

    Rank that flows into rows without entries is lost, and the vector before the step that converged is returned.
    Each step reads the matrix, joins and sums, and is written as a table; so the matrix should be a table too.
    Without tolerance all iterations run. An empty matrix gives equal ranks.
    """
    n = items.count()
    items = items.select(F.col(items.columns[0]).alias("node"))
    totals = similarity.groupBy("i").agg(F.sum("value").alias("total"))
    totals = materialize(totals.select("i", F.when(F.col("total") == 0, 1.0).otherwise(F.col("total")).alias("total")), "totals")
    rank = items.select("node", F.lit(1.0 / n if n else 0.0).alias("rank"))
    if totals.isEmpty():
        return rank
    for _ in range(iterations):
        share = rank.join(totals, rank["node"] == totals["i"]).select("i", (F.col("rank") / F.col("total")).alias("share"))
        flow = similarity.join(share, "i").groupBy("j").agg(F.sum(F.col("value") * F.col("share")).alias("flow"))
        new = items.join(flow, items["node"] == flow["j"], "left").select("node", (F.lit(damping) * F.coalesce("flow", F.lit(0.0)) + F.lit((1 - damping) / n)).alias("rank"))
        new = materialize(new, "ranks")
        if tolerance is not None:
            moved = new.join(rank.withColumnRenamed("rank", "old"), "node").agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0]
            if moved < tolerance:
                break
        rank = new
    return rank


def metapath_features(similarity: DataFrame, items: DataFrame, k: int = 50, counts: DataFrame | None = None) -> DataFrame:
    """Per node, self excluded: mean and population deviation of its top k values, largest value, number of entries.

    Mean and deviation are over min(k, n) values, of which those that don't exist count as zeros.
    counts: (i, neighbours) where similarity has only the largest values.
    """
    n = items.count()
    size = min(k, n)
    own = similarity.where("i <> j and value <> 0")
    ranked = own.withColumn("r", F.row_number().over(Window.partitionBy("i").orderBy(F.desc("value"), "j")))
    top = ranked.where(F.col("r") <= k).groupBy("i").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"), F.max("value").alias("max_sim"))
    count = counts if counts is not None else own.groupBy("i").agg(F.count(F.lit(1)).alias("neighbours"))
    out = items.select(F.col(items.columns[0]).alias("node")).join(top.withColumnRenamed("i", "node"), "node", "left").join(count.withColumnRenamed("i", "node"), "node", "left").fillna(0.0, ["s", "q", "max_sim"]).fillna(0, ["neighbours"])
    mean = F.col("s") / size
    return out.select("node", mean.alias("mean_sim"), "max_sim", F.sqrt(F.greatest(F.lit(0.0), F.col("q") / size - mean * mean)).alias("std_sim"), F.col("neighbours").cast("long").alias("neighbours"))


def zscore(df: DataFrame, columns: list[str]) -> DataFrame:
    """columns less their means over their population deviations; a deviation of 0 counts as 1."""
    row = df.agg(*(F.avg(c).alias(f"{c}_m") for c in columns), *(F.stddev_pop(c).alias(f"{c}_s") for c in columns)).first()
    return df.select(*(c for c in df.columns if c not in columns), *(((F.col(c) - F.lit(row[f"{c}_m"])) / F.lit(row[f"{c}_s"] or 1.0)).alias(c) for c in columns))


def vector_stats(vectors: DataFrame, column: str) -> DataFrame:
    """Mean and population deviation of every component: (dim, mean, std)."""
    return vectors.select(F.posexplode(column).alias("dim", "x")).groupBy("dim").agg(F.avg(F.col("x").cast("double")).alias("mean"), F.stddev_pop(F.col("x").cast("double")).alias("std"))


def with_features(node_table: DataFrame, features: DataFrame) -> DataFrame:
    """Every node with its features; a zero where it has none."""
    return node_table.join(features.select("node_id", "features"), "node_id", "left").withColumn("features", F.coalesce("features", F.array(F.lit(0.0))))


def assemble(node_table: DataFrame, blocks: list[DataFrame]) -> DataFrame:
    """(node_id, features): the blocks (node_id, features) of each node side by side; zeros of a block's width where it has none."""
    out, parts = node_table.select("node_id"), []
    for i, b in enumerate(blocks):
        width = b.agg(F.max(F.size("features"))).first()[0] or 0
        out = out.join(b.select("node_id", F.col("features").alias(f"f{i}")), "node_id", "left")
        parts.append(F.coalesce(F.col(f"f{i}"), F.array_repeat(F.lit(0.0), width)))
    return out.select("node_id", F.concat(*parts).alias("features") if parts else F.array().cast("array<double>").alias("features"))


def type_weights(weights: DataFrame, kinds: DataFrame) -> DataFrame:
    """(node_type, weights): a map from meta-path to weight for each type of kinds (node_type); an empty one where none is given."""
    maps = weights.groupBy("node_type").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("mp_id", F.col("weight").cast("double").alias("weight"))))).alias("weights"))
    return kinds.select("node_type").distinct().join(maps, "node_type", "left").withColumn("weights", F.coalesce("weights", F.create_map().cast("map<string,double>")))


def augmented_edges(similarities: DataFrame, threshold: float = 0.1, k: int = 50) -> DataFrame:
    """Similarities (mp_id, i, j, value) as edges: those of at least threshold, the k largest of each row of each meta-path."""
    s = similarities.where(F.col("value") >= threshold)
    return s.withColumn("_r", F.row_number().over(Window.partitionBy("mp_id", "i").orderBy(F.desc("value"), "j"))).where(F.col("_r") <= k).drop("_r")


def summary(node_table: DataFrame, edge_table: DataFrame, width: int = 0) -> DataFrame:
    """Counts of each node type and triplet, and bytes they'd take: width doubles a node, two ints and a double an edge."""
    n = node_table.groupBy(F.col("node_type").alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("node").alias("kind"), "name", "n", (F.col("n") * width * 8).alias("bytes"))
    e = edge_table.groupBy(F.concat_ws("|", "src_type", "relation", "dst_type").alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("edge").alias("kind"), "name", "n", (F.col("n") * 16).alias("bytes"))
    return n.unionByName(e)


__all__ = ["augmented_edges", "fallback_features", "metapath_features", "pagerank", "prune", "summary", "vector_stats", "with_features", "zscore"]
