"""Embedding analytics: cosine search, link prediction, nearest labels, clusters and their quality."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.functions.ranking import global_index
from graphloom.operators.components import components
from graphloom.session import materialize, ship_package

#: Rows of a block; a task multiplies one block by another.
BLOCK = 2048


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(0.0))


def _blocks(rows: DataFrame, name: str) -> DataFrame:
    """rows (id, vec) as blocks of some BLOCK rows: one array of ids and one of vectors each."""
    n = max(1, -(-rows.count() // BLOCK))
    b = rows.where("vec is not null").select(F.pmod(F.xxhash64("id"), F.lit(n)).alias("b"), "id", "vec")
    return b.groupBy("b").agg(F.collect_list(F.struct("id", "vec")).alias(name)).drop("b")


def _near(batches, k, least):
    for batch in batches:
        for left, right in zip(batch.column("l"), batch.column("r")):
            a, b = ((np.array(x.values.field(0).to_numpy(zero_copy_only=False)), np.array(x.values.field(1).to_pylist(), np.float64)) for x in (left, right))
            u, v = (m[1] / np.maximum(np.linalg.norm(m[1], axis=1, keepdims=True), 1e-300) for m in (a, b))
            cos = np.round(u @ v.T, 9)
            order = np.argsort(b[0], kind="stable")
            ids, cos = b[0][order], cos[:, order]
            if k:
                j = np.argsort(-cos, axis=1, kind="stable")[:, :k]
                i, j = np.repeat(np.arange(len(j)), j.shape[1]), j.ravel()
                some = cos[i, j] >= least
                i, j = i[some], j[some]
            else:
                i, j = np.nonzero(cos >= least)
            yield pa.RecordBatch.from_arrays([pa.array(a[0][i]), pa.array(ids[j]), pa.array(cos[i, j])], ["src", "dst", "cos"])


def cosines(src: DataFrame, dst: DataFrame, k: int | None = None, least: float = -2.0) -> DataFrame:
    """(src, dst, cos) over all pairs of (id, vec), cosine rounded to 9 places: the k nearest of each src, or all of at least `least`.

    Blocks are paired, not rows; each task multiplies two blocks and keeps what may be in the result.
    """
    ship_package(src.sparkSession)
    left, right = _blocks(src, "l"), _blocks(dst, "r")
    found = left.crossJoin(right).repartition(max(2, int(src.sparkSession.conf.get("spark.sql.shuffle.partitions")))).mapInArrow(lambda it: _near(it, k, least), "src long, dst long, cos double")
    if k is None:
        return found
    return found.withColumn("_r", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("cos"), "dst"))).where(F.col("_r") <= k).drop("_r")


def predict_links(src: DataFrame, dst: DataFrame, known: DataFrame | Callable[[DataFrame], DataFrame], k: int = 100, threshold: float = 0.5, exclude_self: bool = False, by_score: bool = False) -> DataFrame:
    """New links (src, dst, score, rank): of each source its k nearest, without known (src, dst), of at least threshold, k in all.

    The k in all are taken in the order of sources, then rank, or by_score by score. Known links use up places
    among a source's k nearest, as does the pair with itself unless exclude_self. known may be a function from
    candidates (src, dst) to those of them that are known, where all known links would be too many.
    """
    near = cosines(src, dst, k + 1 if exclude_self else k)
    if exclude_self:
        near = near.where("src <> dst").withColumn("_r", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("cos"), "dst"))).where(F.col("_r") <= k).drop("_r")
    near = near.where(F.col("cos") >= threshold)
    if callable(known):
        near = materialize(near, "candidates")
    have = known(near.select("src", "dst")) if callable(known) else known
    near = near.join(have.select("src", "dst").distinct(), ["src", "dst"], "left_anti")
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("cos"), "dst")))
    first = ranked.orderBy(F.desc("cos"), "src", "dst") if by_score else ranked.orderBy("src", "rank")
    return first.limit(k).select("src", "dst", F.col("cos").alias("score"), "rank")


def nearest_label(queries: DataFrame, train: DataFrame) -> DataFrame:
    """Label of the nearest train row (id, vec, label) for each query (id, vec), and the cosine; ties by id."""
    near = cosines(queries.select("id", "vec"), train.select("id", "vec"), 1)
    return near.join(train.select(F.col("id").alias("dst"), F.col("label").alias("predicted")), "dst").select(F.col("src").alias("id"), F.col("dst").alias("nearest"), "predicted", F.col("cos").alias("confidence"))


def classify_unlabelled(points: DataFrame) -> DataFrame:
    """Label of the nearest labelled point for each of (id, vec, label) whose label is null or negative."""
    known = points.where("label >= 0")
    return nearest_label(points.where("label is null or label < 0").select("id", "vec"), known)


def top_members(members: DataFrame, k: int = 10) -> DataFrame:
    """The k most frequent members of each cluster (cluster, id, canonical, frequency), ties by id."""
    return members.withColumn("rank", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("frequency"), "id"))).where(F.col("rank") <= k)


def centroids(points: DataFrame) -> DataFrame:
    """(label, dim, value): means of the components of (id, vec, label)."""
    return points.select("label", F.posexplode("vec").alias("dim", "x")).groupBy("label", "dim").agg(F.avg(F.col("x").cast("double")).alias("value"))


def _sums(points: DataFrame, vec: Column) -> DataFrame:
    """(label, n, total) with the sum vector of each label, by partial sums of the components."""
    parts = points.select("label", F.posexplode(vec).alias("dim", "x")).groupBy("label", "dim").agg(F.sum("x").alias("x"), F.count(F.lit(1)).alias("n"))
    return parts.groupBy("label").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias("total"))


def cohesion(points: DataFrame) -> DataFrame:
    """Mean cosine of the pairs in each label, by the norm of the sum of unit vectors; 1 for a single point."""
    s = _sums(points, unit(F.col("vec")))
    return s.select("label", F.col("n").alias("size"), F.when(F.col("n") > 1, (dot(F.col("total"), F.col("total")) - F.col("n")) / (F.col("n") * (F.col("n") - 1))).otherwise(1.0).alias("cohesion"))


def silhouette(points: DataFrame) -> DataFrame:
    """(id, label, silhouette) by cosine distance; 0 in a label of one point. A point meets each label's sum, not its points."""
    p = points.select("id", "label", unit(F.col("vec")).alias("u"))
    s = _sums(points, unit(F.col("vec")))
    d = p.join(s.select(F.col("label").alias("other"), "n", "total")).select("id", "label", "other", "n", (F.col("n") - dot(F.col("u"), F.col("total"))).alias("far"))
    own = F.col("label") == F.col("other")
    g = d.groupBy("id", "label").agg(F.max(F.when(own, F.col("n"))).alias("n"), F.max(F.when(own & (F.col("n") > 1), F.col("far") / (F.col("n") - 1))).alias("a"), F.min(F.when(~own, F.col("far") / F.col("n"))).alias("b"))
    return g.select("id", "label", F.when(F.col("n") > 1, (F.col("b") - F.col("a")) / F.greatest("a", "b")).otherwise(0.0).alias("silhouette"))


def calinski_harabasz(points: DataFrame) -> DataFrame:
    """Between-label over within-label dispersion, by degrees of freedom: one row."""
    e = points.select("label", F.posexplode("vec").alias("dim", "x")).withColumn("x", F.col("x").cast("double"))
    per = e.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    dims = per.groupBy("dim").agg(F.sum("n").alias("total_n"), F.sum("s").alias("total_s"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("own"), F.count(F.lit(1)).alias("k"))
    r = dims.agg(F.max("total_n").alias("n"), F.max("k").alias("k"), F.sum(F.col("own") - F.col("total_s") * F.col("total_s") / F.col("total_n")).alias("between"), F.sum(F.col("q") - F.col("own")).alias("within"))
    return r.select(F.col("n").alias("points"), F.col("k").alias("labels"), ((F.col("between") / (F.col("k") - 1)) / (F.col("within") / (F.col("n") - F.col("k")))).alias("score"))


def dbscan(points: DataFrame, eps: float = 0.5, least: int = 3) -> DataFrame:
    """(id, cluster, core): density clusters by cosine distance, numbered from 0 by their smallest core point; -1 is noise.

    A point is core with `least` points, itself included, within eps. Core points within eps of each other are one
    cluster; other points join that of the smallest-numbered core within eps.
    """
    near = materialize(cosines(points, points, None, round(1.0 - eps, 9)).select("src", "dst"), "near")
    cores = materialize(near.groupBy("src").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select(F.col("src").alias("id")), "cores")
    a, b = cores.select(F.col("id").alias("src")), cores.select(F.col("id").alias("dst"))
    links = near.join(a, "src", "left_semi").join(b, "dst", "left_semi").where("src > dst").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    found = components(links)
    root = cores.join(found, cores["id"] == found["node"], "left").select("id", F.coalesce("component", "id").alias("root"))
    numbers = global_index(root.select("root").distinct(), "root", name="cluster")
    root = root.join(numbers, "root").select("id", "cluster")
    reach = near.join(root.withColumnRenamed("id", "dst"), "dst").groupBy("src").agg(F.min("cluster").alias("border"))
    out = points.select("id").join(root, "id", "left").join(reach.withColumnRenamed("src", "id"), "id", "left")
    return out.select("id", F.coalesce("cluster", "border", F.lit(-1)).cast("long").alias("cluster"), F.col("cluster").isNotNull().alias("core"))


def kmeans(points: DataFrame, k: int = 10, seed: int = 42) -> DataFrame:
    """(id, cluster) by k-means on unit vectors; numbers of clusters depend on the seed."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    v = points.select("id", array_to_vector(unit(F.col("vec"))).alias("features")).persist()
    model = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(v)
    v.unpersist()
    return model.transform(points.select("id", array_to_vector(unit(F.col("vec"))).alias("features"))).select("id", "cluster")


def pca(points: DataFrame, k: int = 2) -> DataFrame:
    """(id, x, y, ...) on the first k principal components."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    v = points.select("id", array_to_vector(F.transform("vec", lambda x: x.cast("double"))).alias("features"))
    p = PCA(k=k, inputCol="features", outputCol="p").fit(v).transform(v).select("id", vector_to_array("p").alias("p"))
    return p.select("id", *(F.col("p")[i].alias("xyzuvw"[i] if i < 6 else f"p{i}") for i in range(k)))


def cluster_sizes(clusters: DataFrame) -> DataFrame:
    return clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))


def summaries(points: DataFrame, meta: DataFrame, most: int = 50) -> DataFrame:
    """Per label: size, cohesion, and its first `most` members by id with name and frequency, defaults where unknown."""
    m = points.select("id", "label").join(meta, "id", "left").select("label", "id", F.coalesce("canonical", F.concat(F.lit("node_"), "id")).alias("canonical"), F.coalesce("frequency", F.lit(0)).cast("long").alias("frequency"))
    m = m.withColumn("place", F.row_number().over(Window.partitionBy("label").orderBy("id"))).where(F.col("place") <= most)
    members = m.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("place", "id", "canonical", "frequency"))).alias("members"))
    return cohesion(points).join(members, "label")
