"""Labels, splits and scores of predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.functions.ranking import global_index, running_totals


def assign(node_table: DataFrame, labels: DataFrame, key: str = "node_id") -> DataFrame:
    """Nodes with their label, -1 without one; of several the largest."""
    one = labels.groupBy(key).agg(F.max("label").alias("label"))
    return node_table.join(one, key, "left").withColumn("label", F.coalesce("label", F.lit(-1)))


def assign_members(node_table: DataFrame, members: DataFrame) -> DataFrame:
    """Nodes (node_id, pos) with the label of the member (node_id, local_idx, label) of their id, else of their place, else -1."""
    by_id = members.where("node_id is not null").groupBy("node_id").agg(F.max("label").alias("_l1"))
    known = members.join(node_table.select("node_id"), "node_id", "left_anti").where("local_idx is not null")
    by_place = known.groupBy(F.col("local_idx").alias("pos")).agg(F.max("label").alias("_l2"))
    return node_table.join(by_id, "node_id", "left").join(by_place, "pos", "left").withColumn("label", F.coalesce("_l1", "_l2", F.lit(-1))).drop("_l1", "_l2")


def relabel(labelled: DataFrame, least: int = 3) -> DataFrame:
    """Labels of at least `least` rows numbered from 0 without gaps; others become -1."""
    sizes = labelled.where("label >= 0").groupBy("label").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    number = global_index(sizes.select("label"), "label", name="new")
    return labelled.join(number, "label", "left").withColumn("new_label", F.coalesce("new", F.lit(-1)).cast("long")).drop("new")


def label_sizes(labelled: DataFrame) -> DataFrame:
    """Number of labels, least, largest, mean and total size, and how many are under 3."""
    n = labelled.where("label >= 0").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.count(F.lit(1)).alias("labels"), F.min("n").alias("least"), F.max("n").alias("largest"), F.avg("n").alias("mean"), F.sum("n").alias("total"), F.sum((F.col("n") < 3).cast("long")).alias("small"))


def split(items: DataFrame, train: float = 0.6, validation: float = 0.2, seed: int = 42, by: str | None = None) -> DataFrame:
    """items (id, ...) with `part`: train, val or test, shares floored, by a seeded hash; with by, in each class.

    The hashed order is numbered by ranges, with by that of (class, hash) less where the class begins, so that no
    task sorts a class.
    """
    ranked = items.withColumn("_h", F.md5(F.concat_ws("|", "id", F.lit(seed))))
    if by:
        ranked = global_index(ranked, by, "_h", "id", name="_at").drop("_h")
        sizes = ranked.groupBy(F.col(by).alias("_by")).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
        ranked = ranked.join(sizes, ranked[by].eqNullSafe(sizes["_by"])).withColumn("_at", F.col("_at") - F.col("_first")).drop("_by", "_first")
    else:
        ranked = global_index(ranked, "_h", "id", name="_at").drop("_h").withColumn("_n", F.lit(items.count()))
    first, second = F.floor(F.col("_n") * train), F.floor(F.col("_n") * train) + F.floor(F.col("_n") * validation)
    return ranked.withColumn("part", F.when(F.col("_at") < first, "train").when(F.col("_at") < second, "val").otherwise("test")).drop("_at", "_n")


def checked_split(items: DataFrame, by: str, least: int = 3, **how) -> DataFrame:
    """split() in each class of at least `least` rows, the rest left out; without two such classes, regardless of class."""
    sizes = items.where(F.col(by).isNotNull()).groupBy(by).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).select(by)
    some = items.join(sizes, by, "left_semi")
    return split(some, by=by, **how) if sizes.limit(2).count() == 2 else split(items, **how)


def ordered_split(items: DataFrame, *order: Column, share: float = 0.8) -> DataFrame:
    """items with `part`: the first share of the rows, floored, is train and the rest test."""
    ranked = global_index(items, *order, name="_at")
    return ranked.withColumn("part", F.when(F.col("_at") < int(items.count() * share), "train").otherwise("test")).drop("_at")


def _thresholds(scored: DataFrame, order: Column) -> DataFrame:
    by_score = scored.groupBy("score").agg(F.sum(F.col("truth").cast("long")).alias("pos"), F.sum(1 - F.col("truth").cast("long")).alias("neg"))
    return running_totals(by_score, [order], ["pos", "neg"])


def roc_auc(scored: DataFrame) -> DataFrame:
    """Area under the ROC curve of (score, truth): the chance that a positive outranks a negative, ties half."""
    t = _thresholds(scored, F.col("score").asc())
    won = F.col("pos") * (F.col("cum_neg") - F.col("neg") + F.col("neg") / 2.0)
    return t.agg(F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"), (F.sum(won) / (F.sum("pos") * F.sum("neg"))).alias("auc"))


def average_precision(scored: DataFrame) -> DataFrame:
    """Sum over thresholds of precision times the gain in recall; no interpolation."""
    t = _thresholds(scored, F.col("score").desc())
    return t.agg((F.sum(F.col("pos") * F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))) / F.sum("pos")).alias("average_precision"))


def report(predicted: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of each class of (truth, predicted); 0 where undefined."""
    c = predicted.groupBy("truth", "predicted").agg(F.count(F.lit(1)).alias("n"))
    true = c.groupBy(F.col("truth").alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)).alias("hit"))
    said = c.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("said"))
    r = true.join(said, "label", "full").fillna(0, ["support", "hit", "said"])
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    r = r.select("label", "support", share("hit", "said").alias("precision"), share("hit", "support").alias("recall"))
    total = F.col("precision") + F.col("recall")
    return r.withColumn("f1", F.when(total > 0, 2 * F.col("precision") * F.col("recall") / total).otherwise(0.0))


def overall(predicted: DataFrame) -> DataFrame:
    """Accuracy, macro F1 and F1 weighted by support: one row."""
    r = report(predicted)
    f = r.agg(F.avg("f1").alias("macro_f1"), (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"))
    return predicted.agg(F.avg((F.col("truth") == F.col("predicted")).cast("double")).alias("accuracy")).join(f)


def evaluate(links: DataFrame | None = None, classes: DataFrame | None = None) -> dict[str, DataFrame]:
    """Scores of the tasks for which there are predictions."""
    out = {}
    if links is not None:
        out |= {"auc": roc_auc(links), "average_precision": average_precision(links)}
    if classes is not None:
        out |= {"classes": overall(classes), "report": report(classes)}
    return out
