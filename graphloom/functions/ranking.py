"""Global numbering without a single-task sort."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.session import materialize


def global_index(df: DataFrame, *order, name: str = "index") -> DataFrame:
    """df with a gapless number from 0 in the given total order.

    Rows are range-partitioned and sorted in their partitions; only the partitions' counts reach the driver.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = materialize(ranged.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_row")), name)
    counts = sorted((r["_part"], r["n"]) for r in rows.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect())
    before, total = {}, 0
    for part, n in counts:
        before[part] = total
        total += n
    if not before:
        return rows.drop("_part", "_row").withColumn(name, F.lit(None).cast("long"))
    first = F.element_at(F.create_map(*(F.lit(x) for kv in before.items() for x in kv)), F.col("_part")).cast("long")
    # monotonically_increasing_id holds the partition above bit 33 and the row's place in it below
    place = F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.withColumn(name, first + place).drop("_part", "_row")


def running_totals(df: DataFrame, order: list, values: list[str], name: str = "totals") -> DataFrame:
    """df with cum_<value>: sums of the values over all rows up to each, in a total order, without a single-task sort."""
    from pyspark.sql.window import Window

    rows = materialize(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), name)
    sums = sorted((tuple(r) for r in rows.groupBy("_part").agg(*(F.sum(v) for v in values)).collect()))  # a row for each partition
    own = Window.partitionBy("_part").orderBy(*order)
    before, so_far = {}, [0] * len(values)
    for part, *more in sums:
        before[part] = list(so_far)
        so_far = [a + (b or 0) for a, b in zip(so_far, more)]
    out = rows
    for i, v in enumerate(values):
        start = F.element_at(F.create_map(*(F.lit(x) for p, b in before.items() for x in (p, b[i]))), F.col("_part")) if before else F.lit(0)
        out = out.withColumn(f"cum_{v}", F.sum(v).over(own) + start)
    return out.drop("_part")
