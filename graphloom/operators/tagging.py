"""BIO tags of texts, spans from tags, class weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.functions.text import ENTITY_TYPES, spaced, stripped
from graphloom.operators.relations import keep_apart

#: Marks that may stand beside an entity, as in a class of a pattern.
EDGES = r".,;:()\[\]{}\"'"
#: Texts of more tokens are left out of training data.
LONGEST = 450


def tag_value(value: Column, kind: Column) -> Column:
    """An entity value as it should stand in a text: without a type prefix or closing marks; null if nothing is left."""
    v = stripped(value)
    head = F.substring_index(v, ":", 1)
    v = F.when(v.contains(":") & head.isin(*ENTITY_TYPES), stripped(F.substring(v, F.char_length(head) + 2, F.char_length(v)))).otherwise(v)
    v = F.when((kind == "File") & v.startswith("FileHash-") & v.contains(":"), stripped(F.regexp_replace(v, "^[^:]*:", ""))).otherwise(v)
    v = F.when(kind.isin("Domain", "URL", "Email"), F.rtrim(v, F.lit(".,;:"))).when(kind == "ThreatActor", spaced(v)).otherwise(v)
    return F.when(value.isNull() | (value == "NULL") | (v == ""), None).otherwise(v)


def tokens_of(texts: DataFrame) -> DataFrame:
    """(doc_id, pos, start, stop) of the blank-separated tokens of (doc_id, text)."""
    parts = texts.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"(?U)\s*\S+"), F.lit(0))).alias("pos", "part"))
    upto = F.sum(F.char_length("part")).over(Window.partitionBy("doc_id").orderBy("pos"))
    blanks = F.char_length("part") - F.char_length(F.regexp_replace("part", r"(?U)^\s+", ""))
    return parts.select("doc_id", "pos", (upto - F.char_length("part") + blanks).alias("start"), upto.alias("stop"))


def places(texts: DataFrame, values: DataFrame) -> DataFrame:
    """(doc_id, kind, place, start, stop): where values (doc_id, kind, value, place) stand in (doc_id, text), case ignored.

    A value stands between blanks, EDGES or ends of the text; its places may overlap. The text is split before each
    of them, so that the lengths of the parts tell where they are.
    """
    wanted = F.lower(stripped(spaced(F.col("value"))))
    v = values.select("doc_id", "kind", "place", wanted.alias("wanted")).where("wanted <> ''").distinct()
    both = v.join(texts.select("doc_id", F.lower("text").alias("low")), "doc_id").where("contains(low, wanted)")
    quoted = F.concat(F.lit("\\Q"), F.replace("wanted", F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    inside = F.concat(quoted, F.lit(f"(?=$|[{EDGES}]|(?U:\\s))"))
    cut = both.select("doc_id", "kind", "place", "wanted", F.posexplode(F.split("low", F.concat(F.lit(f"(?s)(?<=[{EDGES}]|(?U:\\s))(?="), inside, F.lit(")")))).alias("k", "part"), F.rlike(F.col("low"), F.concat(F.lit("^"), inside)).alias("at_head"))
    own = Window.partitionBy("doc_id", "kind", "place", "wanted").orderBy("k")
    found = cut.withColumn("start", F.sum(F.char_length("part")).over(own) - F.char_length("part")).where("k > 0 or at_head")
    return found.select("doc_id", "kind", "place", "start", (F.col("start") + F.char_length("wanted")).alias("stop"))


def bio_tags(docs: DataFrame, entities: DataFrame, longest: int | None = LONGEST) -> DataFrame:
    """(doc_id, tags) for docs (doc_id, text) by entities (doc_id, kind, value, place); documents of too many tokens go.

    An entity covers the tokens that it overlaps. Of entities that would share a token the one that starts first has
    it, then the one of the smaller place; one that finds its first token taken is left out.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    if longest is not None:
        texts = texts.where(F.regexp_count("text", F.lit(r"(?U)\S+")) <= longest)
    values = entities.select("doc_id", "place", "kind", tag_value(F.col("value"), F.col("kind")).alias("value")).where("value is not null")
    tokens = tokens_of(texts)
    spans = places(texts, values).withColumnsRenamed({"start": "from", "stop": "to"})
    over = spans.join(tokens, "doc_id").where("start < to and stop > from").groupBy("doc_id", "kind", "place", "from", "to").agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("stop"))
    kept = keep_apart(over.select("doc_id", "from", "place", "to", "kind", "start", "stop"), ("from", "place", "to", "kind"))
    named = kept.select("doc_id", F.upper("kind").alias("kind"), F.col("start").alias("first"), F.explode(F.sequence(F.col("start"), F.col("stop") - 1)).alias("pos"))
    tag = F.concat(F.when(F.col("pos") == F.col("first"), "B-").otherwise("I-"), "kind")
    tagged = tokens.join(named.select("doc_id", "pos", tag.alias("tag")), ["doc_id", "pos"], "left").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("tag", F.lit("O")).alias("tag")))).alias("t"))
    return texts.select("doc_id").join(tagged, "doc_id", "left").select("doc_id", F.coalesce(F.transform("t", lambda x: x["tag"]), F.array().cast("array<string>")).alias("tags"))


def training_rows(tagged: DataFrame) -> DataFrame:
    """Documents with a tag other than O."""
    return tagged.where(F.exists("tags", lambda t: t != "O"))


def label_counts(tagged: DataFrame) -> DataFrame:
    return tagged.select(F.explode("tags").alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("count"))


def label_ids(counts: DataFrame) -> DataFrame:
    """Labels numbered from 0 in alphabetic order; a table of a few dozen rows."""
    return counts.select("label", (F.row_number().over(Window.orderBy("label")) - 1).cast("long").alias("id"))


def class_weights(counts: DataFrame) -> DataFrame:
    """Weight of each label: all tags over labels times count, by 5 for O, 0.2 for labels under 100, else 0.5."""
    t = counts.agg(F.sum("count").alias("total"), F.count(F.lit(1)).alias("labels"))
    scale = F.when(F.col("label") == "O", 5.0).when(F.col("count") < 100, 0.2).otherwise(0.5)
    return counts.join(F.broadcast(t)).select("label", "count", (F.col("total") / (F.col("labels") * F.col("count") * scale)).alias("weight"))


def spans(tokens: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Entities of predicted tokens (doc_id, place, token, tag, confidence): B starts one, I of its type goes on.

    Tokens tagged O or at most the threshold are skipped; an I of another type is skipped too. The confidence is
    the least of its tokens.
    """
    t = tokens.where((F.col("tag") != "O") & (F.col("confidence") > threshold)).select("*", F.substring("tag", 1, 1).alias("p"), F.expr("substring(tag, 3)").alias("kind"))
    own = Window.partitionBy("doc_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("span", F.sum((F.col("p") == "B").cast("int")).over(own)).where("span > 0")
    first = F.first(F.when(F.col("p") == "B", F.col("kind")), True).over(Window.partitionBy("doc_id", "span").orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    t = t.withColumn("own", first).where("own = kind")
    g = t.groupBy("doc_id", "span", F.col("own").alias("kind")).agg(F.min("place").alias("start"), F.max("place").alias("stop"), F.min("confidence").alias("confidence"), F.array_sort(F.collect_list(F.struct("place", "token"))).alias("x"))
    return g.select("doc_id", "kind", "start", "stop", "confidence", F.array_join(F.transform("x", lambda x: x["token"]), " ").alias("value"))


def category(kind: Column) -> Column:
    """Technical or semantic, by the type as tags name it."""
    return F.when(F.upper(kind).isin("IP", "DOMAIN", "URL", "FILE", "EMAIL", "VULNERABILITY"), "technical_ioc").otherwise("semantic_entity")
