"""Relations between mentions: sentences, mentions, windows, rules, cues, the cap on weak relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.functions.text import canonical, certainty, negated, stripped
from graphloom.session import materialize

# Relation, source types, target types, patterns, whether symmetric; in order of precedence.
RULES = (
    ("exploits", ("ThreatActor", "Malware"), ("Vulnerability",), ("exploit", "exploited", "exploiting", "exploits", "leverage", "leveraged", "abuse", "abused"), False),
    ("affects", ("Vulnerability",), ("Platform", "Device", "Software", "Vendor"), ("affect", "affects", "affected", "impact", "impacts", "impacted"), False),
    ("targets", ("ThreatActor", "Malware"), ("Device", "Platform", "Vendor", "Software"), ("target", "targets", "targeted", "attack", "attacks", "attacked", "compromise"), False),
    ("communicates_with", ("IP", "Domain", "URL", "Malware", "File"), ("IP", "Domain", "URL"), ("communicate", "connect", "beacon", "callback", "c2", "command and control"), True),
    ("delivers", ("URL", "Domain", "Malware", "IP"), ("Malware", "File"), ("deliver", "drop", "download", "distribute", "host"), False),
    ("belongs_to", ("File", "Malware", "IP", "Domain"), ("Malware", "ThreatActor"), ("belong", "associated with", "linked to", "part of", "variant of"), False),
    ("uses", ("ThreatActor", "Malware"), ("Malware", "Type", "Function", "File"), ("use", "uses", "used", "employ", "utilize", "deploy"), False),
    ("includes", ("Malware", "File"), ("File", "Function"), ("include", "contain", "embed", "bundle"), False),
    ("evolves_from", ("Vulnerability", "Malware"), ("Vulnerability", "Malware"), ("evolve", "derived from", "based on", "successor"), False),
    ("related_to", ("*",), ("*",), ("related to", "associated with", "connected to", "involves"), True),
)
# End of the fixed values.
SENTENCE = r"(?s).+?(?:[.!?]+\s+|\n+|$)"
FAR = 20.0


def sentences(docs: DataFrame) -> DataFrame:
    """(doc_id, sid, start, stop, sentence, tokens): sentences end after .!? and blanks, or at line ends.

    start and stop are places in the text; tokens is the number of blank-separated tokens before the sentence.
    """
    parts = docs.select("doc_id", F.posexplode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(SENTENCE), F.lit(0))).alias("sid", "sentence"))
    order = Window.partitionBy("doc_id").orderBy("sid")
    upto, n = F.sum(F.char_length("sentence")).over(order), F.regexp_count("sentence", F.lit(r"(?U)\S+"))
    return parts.select("doc_id", F.col("sid").cast("long").alias("sid"), (upto - F.char_length("sentence")).alias("start"), upto.alias("stop"), "sentence", (F.sum(n).over(order) - n).alias("tokens"))


def find_mentions(docs: DataFrame, names: DataFrame) -> DataFrame:
    """(doc_id, kind, name, start, stop) of every place, case ignored, of names (kind, name), a table of bounded size.

    Places of one name don't overlap. A text is cut at a name and the lengths of the parts tell where it stood.
    """
    low = F.lower(F.coalesce("text", F.lit("")))
    at = docs.select("doc_id", low.alias("low")).join(F.broadcast(names.where(F.char_length("name") > 0)), F.expr("instr(low, lower(name)) > 0"))
    cut = at.select("doc_id", "kind", "name", F.posexplode(F.expr(r"split(low, concat('\\Q', lower(name), '\\E'), -1)")).alias("k", "part"))
    own = Window.partitionBy("doc_id", "kind", "name").orderBy("k")
    upto = F.sum(F.char_length("part")).over(own) + F.col("k") * F.char_length("name")
    last = F.max("k").over(Window.partitionBy("doc_id", "kind", "name"))
    return cut.select("doc_id", "kind", "name", upto.alias("start"), (upto + F.char_length("name")).alias("stop"), "k", last.alias("last")).where("k < last").drop("k", "last")


def find_all_forms(docs: DataFrame, names: DataFrame) -> DataFrame:
    """Mentions as find_mentions() has them, of each name's text and its canonical form; where a document has neither, of
    its words of over three letters, if it has several words. Places of one name don't overlap: the first one stays."""
    n = names.select("kind", "name")
    form = canonical(F.col("name"), F.col("kind"))
    word = n.select("kind", "name", F.explode(F.split(stripped(F.col("name")), r"(?U)\s+")).alias("form"), F.lit(2).alias("level"))
    word = word.where((F.char_length("form") > 3) & F.col("name").rlike(r"(?U)\S\s+\S"))
    forms = n.select("kind", "name", F.col("name").alias("form"), F.lit(1).alias("level")).unionByName(n.select("kind", "name", form.alias("form"), F.lit(1).alias("level")).where("form <> name and form <> ''")).unionByName(word)
    at = find_mentions(docs, forms.select("kind", F.lower("form").alias("name")).distinct()).withColumnRenamed("name", "low")
    found = at.join(F.broadcast(forms.withColumn("low", F.lower("form"))), ["kind", "low"]).select("doc_id", "kind", "name", "start", "stop", "level")
    whole = found.where("level = 1").drop("level")
    parts = found.where("level = 2").drop("level").join(whole.select("doc_id", "kind", "name").distinct(), ["doc_id", "kind", "name"], "left_anti")
    return keep_apart(whole.unionByName(parts), ("start", "stop"), ("doc_id", "kind", "name")).select("doc_id", "kind", "name", "start", "stop")


def keep_apart(mentions: DataFrame, order: tuple[str, ...] = ("start", "stop", "kind", "name"), by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Mentions kept greedily in the given order, which ascends by start: one that overlaps a kept one goes.

    Mentions that touch no other cluster, by the farthest stop so far, are folded apart from the rest, so that a fold
    is as long as a run of overlapping mentions and not as a document.
    """
    own = Window.partitionBy(*by).orderBy(*order)
    reach = F.max("stop").over(own.rowsBetween(Window.unboundedPreceding, -1))
    m = mentions.where("stop > start").distinct().withColumn("_new", F.coalesce(F.col("start") >= reach, F.lit(True)).cast("int")).withColumn("_run", F.sum("_new").over(own))
    fields = [*order, *(c for c in mentions.columns if c not in order and c not in by)]
    m = m.groupBy(*by, "_run").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("m"))
    first = F.slice("m", 1, 1)
    kept = F.aggregate(F.slice("m", 2, F.greatest(F.size("m") - 1, F.lit(0))), first, lambda acc, x: F.when(x["start"] >= F.element_at(acc, -1)["stop"], F.concat(acc, F.array(x))).otherwise(acc))
    return m.select(*by, F.explode(kept).alias("x")).select(*(c if c in by else f"x.{c}" for c in mentions.columns))


def in_sentences(mentions: DataFrame, sents: DataFrame) -> DataFrame:
    """Mentions with the first sentence that holds them whole, and the token they stand at; others are left out."""
    s = sents.select("doc_id", "sid", F.col("start").alias("s0"), F.col("stop").alias("s1"), "sentence", "tokens")
    both = mentions.join(s, "doc_id").where("start >= s0 and stop <= s1")
    token = F.col("tokens") + F.regexp_count(F.expr("substring(sentence, 1, cast(start - s0 as int))"), F.lit(r"(?U)\S+\s+"))
    first = both.groupBy("doc_id", "kind", "name", "start", "stop").agg(F.min(F.struct("sid", token.alias("token"))).alias("x"))
    return first.select("doc_id", "kind", "name", "start", "stop", "x.sid", "x.token")


def windows(sents: DataFrame, ahead: int = 1) -> DataFrame:
    """(doc_id, wid, start, stop, evidence, sentence): each sentence with up to `ahead` that follow."""
    own = Window.partitionBy("doc_id").orderBy("sid").rowsBetween(0, ahead)
    return sents.select("doc_id", F.col("sid").alias("wid"), "start", F.max("stop").over(own).alias("stop"), F.array_join(F.collect_list("sentence").over(own), "").alias("evidence"), "sentence")


def pairs(placed: DataFrame, ahead: int = 1) -> DataFrame:
    """Unordered pairs of mentions in each sentence window, in order of sentence, start, stop and name."""
    inside = placed.select("doc_id", "kind", "name", "start", "stop", "token", "sid", F.explode(F.sequence(F.greatest(F.col("sid") - ahead, F.lit(0)), F.col("sid"))).alias("wid"))
    order = Window.partitionBy("doc_id", "wid").orderBy("sid", "start", "stop", "kind", "name")
    n = inside.withColumn("p", F.row_number().over(order))
    a = n.select("doc_id", "wid", *(F.col(c).alias(f"{c}1") for c in ("kind", "name", "start", "stop", "token", "p")))
    b = n.select("doc_id", "wid", *(F.col(c).alias(f"{c}2") for c in ("kind", "name", "start", "stop", "token", "p")))
    return a.join(b, ["doc_id", "wid"]).where("p1 < p2").drop("p1", "p2")


def valid_types(source: Column, target: Column, rule: Column) -> Column:
    """Whether types may stand in a relation: a star on either side allows all."""
    star = F.array_contains(rule["sources"], "*") | F.array_contains(rule["targets"], "*")
    return star | (F.array_contains(rule["sources"], source) & F.array_contains(rule["targets"], target))


def directionality(relation: Column) -> Column:
    return F.when(relation.isin(*(r[0] for r in RULES if r[4])), "symmetric").otherwise("directional")


def matched_rules(text: Column) -> Column:
    """Rules whose pattern occurs as whole words, in order of precedence; the weak relation isn't among them."""
    low = F.lower(text)
    rows = []
    for i, (relation, sources, targets, patterns, _) in enumerate(RULES):
        if relation != "related_to":
            for j, p in enumerate(patterns):
                hit = low.rlike(rf"(?U)\b{p}\b")
                rows.append(F.struct(F.lit(i * 100 + j).alias("no"), F.lit(relation).alias("relation"), F.lit(p).alias("pattern"), F.array(*map(F.lit, sources)).alias("sources"), F.array(*map(F.lit, targets)).alias("targets"), hit.alias("hit")))
    return F.filter(F.array(*rows), lambda r: r["hit"])


def relate(mention_pairs: DataFrame, wins: DataFrame) -> DataFrame:
    """Each pair with the first rule that fits its types in one order or the other; relation is null where none does.

    Columns: doc_id, wid, source and target kind and name, relation, pattern, confidence, certainty, negation,
    and the pair's places.
    """
    w = wins.select("doc_id", "wid", F.col("start").alias("window_start"), matched_rules(F.col("evidence")).alias("rules"), certainty(F.col("evidence")).alias("certainty"), negated(F.col("evidence")).alias("negation"))
    w = materialize(w, "windows")  # else every pair of a window would match its patterns anew
    p = mention_pairs.join(w, ["doc_id", "wid"])
    forward, back = lambda r: valid_types(F.col("kind1"), F.col("kind2"), r), lambda r: valid_types(F.col("kind2"), F.col("kind1"), r)
    p = p.withColumn("rule", F.try_element_at(F.filter("rules", lambda r: forward(r) | back(r)), F.lit(1)))
    turned = ~valid_types(F.col("kind1"), F.col("kind2"), F.col("rule"))
    pick = lambda a, b: F.when(turned, F.col(b)).otherwise(F.col(a))
    return p.select(
        "doc_id", "wid", "window_start", pick("kind1", "kind2").alias("source_kind"), pick("name1", "name2").alias("source"), pick("kind2", "kind1").alias("target_kind"), pick("name2", "name1").alias("target"),
        F.col("rule.relation").alias("relation"), F.col("rule.pattern").alias("pattern"), "start1", "stop1", "start2", "stop2", F.abs(F.col("token1") - F.col("token2")).alias("apart"),
        F.when(F.col("rule").isNotNull(), 0.8).alias("confidence"), "certainty", "negation",
    )


def explicit(related: DataFrame, least: float = 0.45) -> DataFrame:
    """Relations that a rule gave, once for each (source, target, relation, window)."""
    key = ["doc_id", "source_kind", "source", "target_kind", "target", "relation", "window_start"]
    order = Window.partitionBy(*key).orderBy("wid", "start1", "start2", "pattern")
    return related.where(F.col("relation").isNotNull() & (F.col("confidence") >= least)).withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def nearness(apart: Column) -> Column:
    """1 less a twentieth of the tokens between two places, 0 at least."""
    return F.greatest(F.lit(0.0), 1.0 - apart / FAR)


def allowed_weak(n_explicit: Column, ratio: float = 0.05) -> Column:
    """How many weak relations may stand beside n explicit ones."""
    return F.when((n_explicit > 0) & F.lit(ratio > 0), F.floor(n_explicit * ratio / (1.0 - ratio))).otherwise(0).cast("long")


def weak(related: DataFrame, ratio: float = 0.05, least: float = 0.5, seed: int = 42) -> DataFrame:
    """Pairs without a rule whose mentions stand near, of each document as many as its explicit relations allow, by a seeded hash."""
    n = explicit(related).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    c = related.where(F.col("relation").isNull()).withColumn("score", nearness(F.col("apart"))).where(F.col("score") >= least)
    order = Window.partitionBy("doc_id").orderBy(F.md5(F.concat_ws("|", "wid", "start1", "start2", "source", "target", F.lit(seed))), "wid", "start1", "start2")
    c = c.join(n, "doc_id").withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= allowed_weak(F.col("n"), ratio))
    return c.select("doc_id", "wid", "window_start", "source_kind", "source", "target_kind", "target", F.lit("related_to").alias("relation"), F.col("score").alias("confidence"), F.lit("possible").alias("certainty"), F.lit(False).alias("negation"))


def histogram(relations: DataFrame) -> DataFrame:
    return relations.groupBy("doc_id", "relation").agg(F.count(F.lit(1)).alias("count"))


def weak_share(relations: DataFrame) -> DataFrame:
    """Percentage of related_to among all relations."""
    return relations.agg(F.count(F.lit(1)).alias("relations"), (100.0 * F.avg((F.col("relation") == "related_to").cast("double"))).alias("weak_percent"))


def frequent_words(sents: DataFrame, placed: DataFrame, least: int = 3, k: int = 15, contexts: int = 5) -> DataFrame:
    """Words between two mentions of a sentence, by how often; a stand-in for verb patterns, which need a tagger.

    For the k commonest of at least `least`: the count and the first few sentences they stand in.
    """
    two = placed.groupBy("doc_id", "sid").agg(F.min("stop").alias("a"), F.max("start").alias("b")).where("b > a")
    between = sents.join(two, ["doc_id", "sid"]).select("doc_id", "sid", "sentence", F.explode(F.split(F.lower(stripped(F.expr("substring(sentence, a - start + 1, b - a)"))), r"\W+")).alias("word")).where("word <> ''")
    n = between.groupBy("word").agg(F.count(F.lit(1)).alias("count")).where(F.col("count") >= least).orderBy(F.desc("count"), "word").limit(k)
    first = between.join(F.broadcast(n), "word").withColumn("_r", F.row_number().over(Window.partitionBy("word").orderBy("doc_id", "sid"))).where(F.col("_r") <= contexts)
    return first.groupBy("word", "count").agg(F.array_sort(F.collect_set("sentence")).alias("contexts"))
