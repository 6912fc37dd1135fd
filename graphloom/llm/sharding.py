"""Sharding by vector bin packing: bytes, tokens and rows balanced jointly."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from graphloom.session import materialize, scratch

#: Groups of more than this part of a shard, in any measure, are placed first, on the driver: at most 3 * PARTS * shards of them.
PARTS = 128
#: Other groups that one task places, about, in its share of what capacity they left.
PLACED = 50_000
#: A group too large for one shard is dealt over this many salts first.
SALTS = 256


def place(loads: np.ndarray, shards: int, residual: np.ndarray | None = None, total: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Shard of each load vector, and the capacity left: largest first, each where its dot product with the residual capacity is highest.

    Loads and residual (shards x measures, equal shares of all loads by default) are scaled by total, the loads' own by
    default, so that every measure counts alike. What fits nowhere goes where most of the first measure (bytes, which the law is about) is left.
    """
    total = np.maximum(loads.sum(0) if total is None else total, 1.0)
    unit = loads / total * shards
    residual = np.ones((shards, loads.shape[1])) if residual is None else residual / total * shards
    where = np.zeros(len(loads), np.int64)
    for i in np.lexsort((np.arange(len(loads)), -unit.sum(1), -unit.max(1))).tolist():
        fits = (residual >= unit[i] - 1e-12).all(1)
        k = int(np.where(fits, residual @ unit[i], -np.inf).argmax()) if fits.any() else int(residual[:, 0].argmax())
        where[i] = k
        residual[k] -= unit[i]
    return where, residual * total / shards


def _placed(batches, shards, left, total):
    """All groups of a task in its share of the capacity left, which is that of its groups' loads."""
    got = [b for b in batches if b.num_rows]
    if got:
        rows = pa.Table.from_batches(got).sort_by("g")
        loads = np.stack([rows.column(c).to_numpy() for c in ("b", "t", "n")], 1).astype(np.float64)
        where, _ = place(loads, shards, left * (loads.sum(0) / np.maximum(left.sum(0), 1.0)), total)
        yield pa.RecordBatch.from_arrays([rows.column("g").combine_chunks(), pa.array(where.astype(np.int32))], ["g", "shard"])


def shard(docs: DataFrame, shards: int = 24, overhead: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row of docs, by the law `bytes`.

    Equal texts are a group, known by a hash, and stay together unless the group is larger than a shard; those are
    dealt out by salts. Groups beyond 1/128 of a shard are placed on the driver, their number has a bound that
    doesn't depend on the input. All others are dealt to tasks whole, and each task places each of its groups in its
    share of the capacity that is left. Slots number each shard's rows from 0, by sub-shards whose counts are added
    up, so that no task sorts a whole shard. Null texts are one group of size 8; null doc_ids and repeated rows are
    rows like others; an empty table gives no rows; other columns are ignored.
    """
    with scratch(docs.sparkSession) as scope:
        placed = scope.keep(materialize(_sharded(docs, shards, overhead), "shards"))
    counts = placed.groupBy("shard", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("shard", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))  # at most SALTS rows a shard
    order = Window.partitionBy("shard", "salt").orderBy(F.col("doc_id").asc_nulls_last(), "text_crc32", "size")
    return placed.join(F.broadcast(first), ["shard", "salt"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.row_number().over(order) - 1 + F.col("first")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def _sharded(docs: DataFrame, shards: int, overhead: int) -> DataFrame:
    """doc_id, size, text_crc32, salt and shard."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text).cast("long") + overhead).alias("size"),
        F.crc32(F.encode(text, "utf-8")).cast("long").alias("text_crc32"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("tokens"),
        F.xxhash64(text).alias("g"),
        # by the row's place, so that neither a repeated id nor a repeated text makes a salt heavy
        F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS)).cast("int").alias("salt"),
    )
    rows = materialize(rows, "shard-rows")
    measures = [F.sum("size").cast("double").alias("b"), F.sum("tokens").cast("double").alias("t"), F.count(F.lit(1)).cast("double").alias("n")]
    out = ["doc_id", "size", "text_crc32", "salt"]
    total = rows.agg(*measures).first()
    if not total["n"]:
        return rows.select(*out, F.lit(0).alias("shard"))
    most = [max(1.0, total[k] / shards) for k in ("b", "t", "n")]
    groups = materialize(rows.groupBy("g").agg(*measures), "shard-groups")
    share = F.greatest(F.col("b") / most[0], F.col("t") / most[1], F.col("n") / most[2])
    large = [tuple(r) for r in groups.where(share > 1.0 / PARTS).select("g", "b", "t", "n", share).collect()]
    too_large = [r[0] for r in large if r[4] > 1]
    items = [(r[0], -1, *r[1:4]) for r in large if r[4] <= 1]
    if too_large:
        split = rows.where(F.col("g").isin(too_large)).groupBy("g", "salt").agg(*measures).select("g", "salt", "b", "t", "n")
        items += [tuple(r) for r in split.collect()]
    items.sort()
    whole = np.array([total[k] for k in ("b", "t", "n")])
    left = np.array([whole / shards] * shards)
    where = np.zeros(0, np.int64)
    if items:
        where, left = place(np.array([x[2:] for x in items]), shards, left, whole)
    left = np.maximum(left, 0.0)
    spark = docs.sparkSession
    shape = T.StructType([T.StructField("g", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("shard", T.IntegerType())])
    plan = spark.createDataFrame([(x[0], x[1], int(s)) for x, s in zip(items, where)], shape)  # (3 * PARTS + SALTS) entries a shard at most
    small = groups.where(share <= 1.0 / PARTS)
    tasks = max(1, -(-small.count() // PLACED))
    chosen = small.select("g", "b", "t", "n").repartition(tasks, "g").mapInArrow(lambda it: _placed(it, shards, left, whole), "g long, shard int")
    split = F.col("g").isin(too_large) if too_large else F.lit(False)
    one = rows.withColumn("part", F.when(split, F.col("salt")).otherwise(-1)).join(F.broadcast(plan), ["g", "part"]).select(*out, "shard")
    return one.unionByName(rows.join(chosen, "g").select(*out, "shard"))
