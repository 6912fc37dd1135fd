"""Head-relation-tail triples derived from the relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.session import table

COLUMNS = ("head_type", "head_text", "relation", "tail_type", "tail_text", "confidence", "negation", "source", "ord")


def relational_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases, supplies, places and events as triples; ord gives the order in which they'd be read."""
    t = lambda name: table(spark, sf_dir, name)

    def rows(df, head_type, head, relation, tail_type, tail, confidence, negation, source, order):
        return df.select(
            F.lit(head_type).alias("head_type"), F.col(head).cast("string").alias("head_text"), F.lit(relation).alias("relation"), F.lit(tail_type).alias("tail_type"), F.col(tail).cast("string").alias("tail_text"),
            confidence.cast("double").alias("confidence"), negation.alias("negation"), F.lit(source).alias("source"), order.cast("long").alias("ord"),
        )

    line = t("lineitem")
    sold = line.join(t("orders"), line["l_orderkey"] == F.col("o_orderkey"))
    sure, never = F.lit(1.0), F.lit(False)
    returned, certain = F.col("l_returnflag") == "R", F.lit(1.0) - F.col("l_discount")
    at = F.col("l_orderkey") * 16 + F.col("l_linenumber")
    far = lambda k, c: F.lit(k * 10**12) + F.col(c)
    out = rows(sold, "Customer", "o_custkey", "purchases", "Part", "l_partkey", certain, returned, "lineitem", at)
    for more in (
        rows(line, "Part", "l_partkey", "supplied_by", "Supplier", "l_suppkey", certain, returned, "lineitem", at),
        rows(t("customer"), "Customer", "c_custkey", "located_in", "Nation", "c_nationkey", sure, never, "customer", far(1, "c_custkey")),
        rows(t("supplier"), "Supplier", "s_suppkey", "located_in", "Nation", "s_nationkey", sure, never, "supplier", far(2, "s_suppkey")),
        rows(t("nation"), "Nation", "n_nationkey", "part_of", "Region", "n_regionkey", sure, never, "nation", far(3, "n_nationkey")),
        rows(t("events"), "User", "user_id", "performs", "EventType", "event_type", F.abs(F.col("value")) / (F.lit(1.0) + F.abs(F.col("value"))), F.col("event_type") == "error", "events", far(4, "event_id")),
    ):
        out = out.unionByName(more)
    return out


#: The same triples in SQL, for the oracles.
TRIPLES_SQL = """triples AS (
  SELECT 'Customer' AS head_type, CAST(o_custkey AS VARCHAR) AS head_text, 'purchases' AS relation, 'Part' AS tail_type, CAST(l_partkey AS VARCHAR) AS tail_text,
    1.0::DOUBLE - l_discount AS confidence, l_returnflag = 'R' AS negation, 'lineitem' AS source, l_orderkey * 16 + l_linenumber AS ord
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  UNION ALL SELECT 'Part', CAST(l_partkey AS VARCHAR), 'supplied_by', 'Supplier', CAST(l_suppkey AS VARCHAR), 1.0::DOUBLE - l_discount, l_returnflag = 'R', 'lineitem', l_orderkey * 16 + l_linenumber FROM lineitem
  UNION ALL SELECT 'Customer', CAST(c_custkey AS VARCHAR), 'located_in', 'Nation', CAST(c_nationkey AS VARCHAR), 1.0, false, 'customer', 1000000000000 + c_custkey FROM customer
  UNION ALL SELECT 'Supplier', CAST(s_suppkey AS VARCHAR), 'located_in', 'Nation', CAST(s_nationkey AS VARCHAR), 1.0, false, 'supplier', 2000000000000 + s_suppkey FROM supplier
  UNION ALL SELECT 'Nation', CAST(n_nationkey AS VARCHAR), 'part_of', 'Region', CAST(n_regionkey AS VARCHAR), 1.0, false, 'nation', 3000000000000 + n_nationkey FROM nation
  UNION ALL SELECT 'User', CAST(user_id AS VARCHAR), 'performs', 'EventType', event_type, abs(value) / (1.0 + abs(value)), event_type = 'error', 'events', 4000000000000 + event_id FROM events
)"""
NODES_SQL = TRIPLES_SQL + """, ends AS (
  SELECT head_type AS node_type, trim(head_text) AS canonical, head_text AS text, source, ord * 2 AS ord FROM triples WHERE head_text <> '' AND tail_text <> ''
  UNION ALL SELECT tail_type, trim(tail_text), tail_text, source, ord * 2 + 1 FROM triples WHERE head_text <> '' AND tail_text <> ''
), grouped AS (
  SELECT node_type, canonical, min(ord) AS first_ord, count(*) AS frequency, count(DISTINCT source) AS num_sources FROM ends GROUP BY 1, 2
), nodes AS (
  SELECT *, row_number() OVER (ORDER BY first_ord, node_type, canonical) - 1 AS node_id FROM grouped
)"""
EDGES_SQL = TRIPLES_SQL + """, edges AS (
  SELECT head_type AS src_type, relation, tail_type AS dst_type, trim(head_text) AS src, trim(tail_text) AS dst, avg(confidence) AS weight, count(*) AS count, CAST(sum(CAST(negation AS INT)) AS BIGINT) AS negations
  FROM triples WHERE head_text <> '' AND tail_text <> '' GROUP BY ALL
)"""
