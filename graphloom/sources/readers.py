"""Readers of feeds, bundles, triples, documents and tables."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FEED = "id string, description string, created string, tags array<string>, references array<string>, indicators array<struct<type:string,indicator:string>>"
BUNDLE = "objects array<struct<id:string,type:string,name:string,description:string,x_mitre_platforms:array<string>,aliases:array<string>,x_mitre_aliases:array<string>,labels:array<string>,kill_chain_phases:array<struct<phase_name:string>>>>"
TRIPLE = "head_id string, head_text string, head_type string, tail_id string, tail_text string, tail_type string, relation string, confidence double, certainty string, negation boolean, evidence_span string, sentence string, source_id string, source string, auto_mapped boolean, _bad string"
DOCUMENT = "id string, source_id string, text string, content string, source string"
DATASET = "text string, entities map<string,array<string>>, source string, source_id string, created_date string, context string, confidence_scores map<string,double>"


def landed_feed(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Feed items that a collector has landed as JSON lines."""
    items = spark.read.schema(FEED).json(path)
    return items.limit(limit) if limit else items


def paged_feed(spark: SparkSession, fetch: Callable[..., list[dict]], keep: Callable[[DataFrame], DataFrame] | None = None, limit: int = 1000, since: str | None = None, pause: float = 0.0) -> DataFrame:
    """Items of a paged service, by an injected fetch(page) from page 1: until limit kept ones or an empty page.

    With since, fetch(page, since) lets the service leave out what is older; pause is slept between pages.

    A page that fails ends the scan with what came before it. The service is asked from the driver, since its
    pages follow one another; keep filters every page, and kept items count.
    """
    out, n, page = None, 0, 1
    while n < limit:
        try:
            if page > 1 and pause:
                time.sleep(pause)
            items = fetch(page) if since is None else fetch(page, since)
        except Exception:  # noqa: BLE001  a failing page ends the scan
            break
        if not items:
            break
        df = spark.createDataFrame(items, FEED)
        df = keep(df) if keep else df
        out = df if out is None else out.unionByName(df)
        n, page = n + df.count(), page + 1
    return out.limit(limit) if out is not None else spark.createDataFrame([], FEED)


def bundle(spark: SparkSession, path: str) -> DataFrame:
    """Objects of a bundle, read once for all kinds."""
    return spark.read.schema(BUNDLE).option("multiLine", True).json(path).select(F.explode("objects").alias("o")).select("o.*")


def techniques(objects: DataFrame) -> DataFrame:
    return objects.where(F.col("type") == "attack-pattern")


def software(objects: DataFrame) -> DataFrame:
    return objects.where(F.col("type").isin("malware", "tool"))


def groups(objects: DataFrame) -> DataFrame:
    return objects.where(F.col("type") == "intrusion-set")


def attack_data(objects: DataFrame, limit: int | None = 500) -> DataFrame:
    """Techniques, software, groups, in this order, up to limit; the kind's place keeps the order."""
    parts = [f(objects).withColumn("_k", F.lit(i)) for i, f in enumerate((techniques, software, groups))]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return (out.orderBy("_k", "id").limit(limit) if limit else out).drop("_k")


def triples(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Triples of a JSON-lines file with defaults for what lacks, and the lines that couldn't be read."""
    raw = spark.read.schema(TRIPLE).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path).withColumn("ord", F.monotonically_increasing_id())
    good = raw.where("_bad is null and length(head_text) > 0 and length(tail_text) > 0").drop("_bad")
    given = {"head_type": "Unknown", "tail_type": "Unknown", "relation": "related_to", "confidence": 0.8, "negation": False, "source_id": "unknown"}
    good = good.fillna(given).withColumn("head_id", F.coalesce("head_id", F.concat(F.lit("H"), "ord"))).withColumn("tail_id", F.coalesce("tail_id", F.concat(F.lit("T"), "ord"))).withColumn("source", F.coalesce("source", "source_id"))
    return good, raw.where("_bad is not null or coalesce(length(head_text), 0) = 0 or coalesce(length(tail_text), 0) = 0").select("_bad", "ord")


def documents(spark: SparkSession, path: str) -> DataFrame:
    """Documents of JSON and JSON-lines files below a path: (doc_id, text, source); unreadable lines are dropped."""
    lines = spark.read.schema(DOCUMENT).option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").option("mode", "DROPMALFORMED").json(path)
    whole = spark.read.schema(DOCUMENT).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    return lines.unionByName(whole).select(F.coalesce("id", "source_id").alias("doc_id"), F.coalesce("text", "content").alias("text"), F.coalesce("source", F.lit("")).alias("source"))


def dataset(spark: SparkSession, path: str) -> DataFrame:
    """The balanced data set as extracted rows (doc_id, kind, vals, confidence); ['NULL'] is an empty list."""
    d = spark.read.schema(DATASET).option("multiLine", True).json(path)
    e = d.select(F.col("source_id").alias("doc_id"), "text", "confidence_scores", F.explode("entities").alias("kind", "vals"))
    return e.select("doc_id", "kind", F.filter("vals", lambda v: v != "NULL").alias("vals"), F.coalesce(F.try_element_at("confidence_scores", "kind"), F.lit(0.9)).alias("confidence"))


def graph(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """What writers.graph() wrote: nodes, edges, relations (a row for each triplet) and types (places of nodes in their type)."""
    return {name: spark.read.parquet(f"{path}/{name}") for name in ("nodes", "edges", "relations", "types")}


CLUSTER = "cluster_id int, node_type string, size int, cohesion double, members array<struct<node_id:bigint,local_idx:bigint,canonical:string,frequency:bigint>>"


def clusters(spark: SparkSession, glob: str, lines: bool = True) -> DataFrame:
    """Members (cluster_id, node_type, node_id, local_idx, canonical, frequency, label) of the cluster files that a glob finds.

    Files hold a cluster a line, or without lines a list of clusters each.
    """
    c = spark.read.schema(CLUSTER).option("multiLine", not lines).json(glob)
    return c.select("cluster_id", "node_type", F.explode("members").alias("m")).select("cluster_id", "node_type", "m.*", F.col("cluster_id").alias("label"))


def table_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table, or an empty one where there is none."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)
