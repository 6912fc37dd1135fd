"""Registered queries of the graph, text and embedding operators, each with SQL of the same rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import embeddings as emb
from graphloom.operators import entities as ent
from graphloom.operators import features as feat
from graphloom.operators import blocks, graph, labels, metapath, relations, reports, tagging
from graphloom.functions.text import HEDGES, NEGATIONS, PROBABLE
from graphloom.operators.metapath import MetaPath
from graphloom.plans.triples import EDGES_SQL, NODES_SQL, TRIPLES_SQL, relational_triples
from graphloom.session import materialize, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r6(name: str, alias: str | None = None):
    return F.round(name, 6).alias(alias or name)


def shifted(name: str):
    """Rounded a hair above, so that sums of short decimals don't stand on the edge between two results."""
    return F.round(F.col(name) + 3e-8, 6).alias(name)


# ---- graph -------------------------------------------------------------------------------------------------


@query(f"WITH {EDGES_SQL} SELECT src_type, relation, dst_type, src, dst, round(weight, 6) AS weight, count, negations FROM edges")
def hin_edges(spark, d):
    return graph.edges(relational_triples(spark, d)).select(*graph.TRIPLET, "src", "dst", r6("weight"), "count", "negations")


@query(f"WITH {NODES_SQL} SELECT node_id, node_type, canonical, frequency, num_sources FROM nodes")
def hin_nodes(spark, d):
    return graph.nodes(relational_triples(spark, d)).select("node_id", "node_type", "canonical", "frequency", F.size("sources").cast("long").alias("num_sources"))


@query(
    f"""WITH {TRIPLES_SQL} SELECT head_type AS src_type, relation, tail_type AS dst_type, count(*) AS count, round(avg(confidence), 6) AS avg_confidence, round(stddev_pop(confidence), 6) AS std_confidence,
    CAST(sum(CAST(negation AS INT)) AS BIGINT) AS negations, round(avg(CAST(negation AS INT)), 6) AS negation_ratio FROM triples GROUP BY ALL"""
)
def hin_edge_stats(spark, d):
    return graph.edge_stats(relational_triples(spark, d)).select(*graph.TRIPLET, "count", r6("avg_confidence"), r6("std_confidence"), "negations", r6("negation_ratio"))


@query(f"WITH {NODES_SQL} SELECT node_type, count(*) AS nodes FROM nodes GROUP BY 1")
def hin_type_counts(spark, d):
    return graph.type_counts(graph.nodes(relational_triples(spark, d)))


@query(f"WITH {NODES_SQL} SELECT node_id, node_type, canonical, frequency FROM nodes ORDER BY frequency DESC, node_id LIMIT 20")
def hin_top_nodes(spark, d):
    return graph.top_nodes(graph.nodes(relational_triples(spark, d))).select("node_id", "node_type", "canonical", "frequency")


@query(f"WITH {NODES_SQL} SELECT node_type, node_id, canonical, row_number() OVER (PARTITION BY node_type ORDER BY node_id) - 1 AS pos FROM nodes")
def hin_local_index(spark, d):
    return graph.local_index(graph.nodes(relational_triples(spark, d)))


_CATALOGUE = f"WITH {EDGES_SQL}, cat AS (SELECT DISTINCT src_type, relation, dst_type FROM edges), "
_BACK = """back AS (SELECT dst_type AS src_type, relation || '_rev' AS relation, src_type AS dst_type, dst AS src, src AS dst, weight, count, negations FROM edges),
both_ways AS (SELECT * FROM edges UNION ALL SELECT b.* FROM back b WHERE NOT EXISTS (SELECT 1 FROM cat c WHERE c.src_type = b.src_type AND c.relation = b.relation AND c.dst_type = b.dst_type))"""


@query(f"{_CATALOGUE}{_BACK} SELECT src_type, relation, dst_type, src, dst, round(weight, 6) AS weight, count, negations FROM both_ways")
def hin_reverse_edges(spark, d):
    return graph.with_reverse(materialize(graph.edges(relational_triples(spark, d)), "edges")).select(*graph.TRIPLET, "src", "dst", r6("weight"), "count", "negations")


@query(
    f"""WITH {EDGES_SQL}, ends AS (SELECT src_type AS t, src AS n FROM edges UNION SELECT dst_type, dst FROM edges), sizes AS (SELECT t, count(*) AS n FROM ends GROUP BY t)
    SELECT e.src_type, e.relation, e.dst_type, count(*) AS edges, round(count(*) / (max(a.n) * max(b.n)), 9) AS density FROM edges e JOIN sizes a ON a.t = e.src_type JOIN sizes b ON b.t = e.dst_type GROUP BY ALL"""
)
def hin_density(spark, d):
    t = relational_triples(spark, d)
    return graph.density(graph.edges(t), graph.nodes(t)).select(*graph.TRIPLET, "edges", F.round("density", 9).alias("density"))


@query(f"WITH {EDGES_SQL} SELECT src_type, relation, dst_type, count(*) AS edges FROM edges GROUP BY ALL")
def hin_relations(spark, d):
    return graph.relations(graph.edges(relational_triples(spark, d)))


@query(
    f"""WITH {EDGES_SQL}, ends AS (SELECT src_type AS node_type, src AS canonical, weight AS o, 0.0 AS i FROM edges UNION ALL SELECT dst_type, dst, 0.0, weight FROM edges)
    SELECT node_type, canonical, round(sum(i), 6) AS in_degree, round(sum(o), 6) AS out_degree, round(sum(i) + sum(o), 6) AS total_degree, round(ln(1 + sum(i) + sum(o)), 6) AS log_degree FROM ends GROUP BY 1, 2"""
)
def node_degree(spark, d):
    return graph.degrees(graph.edges(relational_triples(spark, d))).select("node_type", "canonical", r6("in_degree"), r6("out_degree"), r6("total_degree"), r6("log_degree"))


# ---- meta-paths --------------------------------------------------------------------------------------------

NATION_PATH = MetaPath("NCN", "Nation-Customer-Part-Customer-Nation", (("Nation", "located_in_rev", "Customer"), ("Customer", "purchases", "Part"), ("Part", "purchases_rev", "Customer"), ("Customer", "located_in", "Nation")))
SUPPLIER_PATH = MetaPath("SPS", "Supplier-Part-Supplier", (("Supplier", "supplied_by_rev", "Part"), ("Part", "supplied_by", "Supplier")))
CUSTOMER_PATH = MetaPath("CPC", "Customer-Part-Customer", (("Customer", "purchases", "Part"), ("Part", "purchases_rev", "Customer")))
USER_PATH = MetaPath("UEU", "User-EventType-User", (("User", "performs", "EventType"), ("EventType", "performs_rev", "User")))


def _edges(spark, d):
    return materialize(graph.with_reverse(materialize(graph.edges(relational_triples(spark, d)), "edges")), "both-ways")


def _matrices(spark, d, *paths):
    """The matrix of the way out of each path that goes out and back by one relation."""
    t = relational_triples(spark, d)
    out = []
    for p in paths:
        (a, there, b), (c, back, e) = p.path
        assert (a, b) == (e, c) and (there, back) in ((there, f"{there}_rev"), (f"{back}_rev", back))
        out.append(blocks.rows_of(t, (a, there, b)) if back == f"{there}_rev" else blocks.rows_of(t, (c, back, e), back=True))
    return out


_SPS = "sp AS (SELECT dst AS i, src AS k, weight AS x FROM edges WHERE relation = 'supplied_by'), c AS (SELECT a.i, b.i AS j, sum(a.x * b.x) AS value FROM sp a JOIN sp b USING (k) GROUP BY 1, 2)"
_SIM = """dg AS (SELECT i, value AS v FROM c WHERE i = j), s AS (SELECT c.i, c.j, CASE WHEN coalesce(a.v, 0) + coalesce(b.v, 0) > 1e-10 THEN 2 * c.value / (coalesce(a.v, 0) + coalesce(b.v, 0)) ELSE 0 END AS value
  FROM c LEFT JOIN dg a ON a.i = c.i LEFT JOIN dg b ON b.i = c.j)"""


@query(f"WITH {EDGES_SQL}, {_SPS} SELECT i, j, round(value + 3e-8, 6) AS value FROM c WHERE value >= 1e-9")
def commuting_sps(spark, d):
    return blocks.entries(blocks.similar_rows(_matrices(spark, d, SUPPLIER_PATH), measure="product", floor=1e-9)).select("i", "j", shifted("value"))


@query(f"WITH {EDGES_SQL}, {_SPS}, r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY round(value, 9) DESC, j) AS p FROM c WHERE value >= 1e-9) SELECT i, j, round(value + 3e-8, 6) AS value FROM r WHERE p <= 20")
def commuting_topk(spark, d):
    m = metapath.commuting(_edges(spark, d), SUPPLIER_PATH, None).withColumn("value", F.round("value", 9))
    return metapath.prune(m, 20).select("i", "j", shifted("value"))


_CPC = "sp AS (SELECT src AS i, dst AS k, weight AS x FROM edges WHERE relation = 'purchases'), c AS (SELECT a.i, b.i AS j, sum(a.x * b.x) AS value FROM sp a JOIN sp b USING (k) GROUP BY 1, 2)"


@query(f"WITH {EDGES_SQL}, {_CPC}, {_SIM} SELECT count(*) AS nnz, round(min(value), 6) AS min, round(max(value), 6) AS max, round(avg(value), 6) AS mean FROM s")
def pathsim_stats(spark, d):
    return blocks.row_stats(blocks.similar_rows(_matrices(spark, d, CUSTOMER_PATH), keep=0)).select("nnz", r6("min"), r6("max"), r6("mean"))


@query(f"WITH {EDGES_SQL}, {_SPS}, {_SIM} SELECT i, j, round(value, 6) AS value FROM s")
def pathsim_sps(spark, d):
    return blocks.entries(blocks.similar_rows(_matrices(spark, d, SUPPLIER_PATH))).select("i", "j", r6("value"))


NATION_MATES = MetaPath("SNS", "Supplier-Nation-Supplier", (("Supplier", "located_in", "Nation"), ("Nation", "located_in_rev", "Supplier")))


def _combined(spark, d, **how):
    return blocks.similar_rows(_matrices(spark, d, SUPPLIER_PATH, NATION_MATES), [0.7, 0.3], **how)


_SNS = """n AS (SELECT src AS i, dst AS k, weight AS x FROM edges WHERE relation = 'located_in' AND src_type = 'Supplier'), c2 AS (SELECT a.i, b.i AS j, sum(a.x * b.x) AS value FROM n a JOIN n b USING (k) GROUP BY 1, 2),
  d2 AS (SELECT i, value AS v FROM c2 WHERE i = j), s2 AS (SELECT c2.i, c2.j, 2 * c2.value / (a.v + b.v) AS value FROM c2 JOIN d2 a ON a.i = c2.i JOIN d2 b ON b.i = c2.j)"""
_COMBINED = f"WITH {EDGES_SQL}, {_SPS}, {_SIM}, {_SNS}, comb AS (SELECT i, j, sum(value) AS value FROM (SELECT i, j, value * 0.7 AS value FROM s UNION ALL SELECT i, j, value * 0.3 FROM s2) GROUP BY 1, 2)"


@query(f"{_COMBINED} SELECT i, j, round(value, 6) AS value FROM comb")
def combined_similarity(spark, d):
    return blocks.entries(_combined(spark, d)).select("i", "j", r6("value"))


@query(
    f"""{_COMBINED}, r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY round(value, 9) DESC, j) AS p FROM comb WHERE value >= 0.1) SELECT i, j, round(value + 3e-8, 5) AS value FROM r WHERE p <= 50"""
)
def augmented_edges(spark, d):
    m = blocks.entries(_combined(spark, d, keep=50, floor=0.1 - 1e-9))
    return feat.augmented_edges(m.select(F.lit("combined").alias("mp_id"), "i", "j", F.round("value", 9).alias("value"))).select("i", "j", F.round(F.col("value") + 3e-8, 5).alias("value"))


@query("SELECT * FROM (VALUES " + ", ".join(f"('{m.id}', '{m.name}', {len(m.path)}, {str(m.symmetric).lower()})" for m in metapath.CATALOGUE) + ") AS t(id, name, hops, is_symmetric)")
def metapath_catalog(spark, d):
    return spark.createDataFrame([(m.id, m.name, len(m.path), m.symmetric) for m in metapath.CATALOGUE], "id string, name string, hops int, is_symmetric boolean")


@query(
    f"""{_CATALOGUE}{_BACK}, r AS (SELECT DISTINCT src_type AS a, relation AS r, dst_type AS b FROM both_ways)
    SELECT x.a AS start_type, x.a || '-' || x.r || '->' || x.b || '-' || y.r || '->' || x.a AS name, CAST(2 AS BIGINT) AS hops FROM r x JOIN r y ON y.a = x.b AND y.b = x.a
    UNION ALL SELECT x.a, x.a || '-' || x.r || '->' || x.b || '-' || y.r || '->' || y.b || '-' || z.r || '->' || x.b || '-' || w.r || '->' || x.a, 4
    FROM r x JOIN r y ON y.a = x.b AND y.b <> x.a JOIN r z ON z.a = y.b AND z.b = x.b JOIN r w ON w.a = x.b AND w.b = x.a"""
)
def metapath_enum(spark, d):
    return metapath.enumerate_paths(graph.relations(_edges(spark, d)))


_RANK_STEPS = 10


def _pagerank_sql() -> str:
    steps = "".join(
        f", p{n} AS (SELECT items.i, 0.85 * coalesce(f.v, 0) + 0.15 / (SELECT count(*) FROM items) AS v FROM items LEFT JOIN (SELECT links.j, sum(links.p * p{n - 1}.v) AS v FROM links JOIN p{n - 1} ON p{n - 1}.i = links.i GROUP BY 1) f ON f.j = items.i)"
        for n in range(1, _RANK_STEPS + 1)
    )
    return f"""{_COMBINED}, items AS (SELECT DISTINCT i FROM comb), tot AS (SELECT i, sum(value) AS t FROM comb GROUP BY 1), links AS (SELECT comb.i, comb.j, comb.value / tot.t AS p FROM comb JOIN tot USING (i)),
    p0 AS (SELECT i, 1.0 / (SELECT count(*) FROM items) AS v FROM items){steps} SELECT i AS node, round(v, 9) AS rank FROM p{_RANK_STEPS}"""


@query(_pagerank_sql())
def pagerank_fixed(spark, d):
    return blocks.pagerank(_matrices(spark, d, SUPPLIER_PATH, NATION_MATES), [0.7, 0.3], iterations=_RANK_STEPS).select("node", F.round("rank", 9).alias("rank"))


@query(
    f"""{_COMBINED}, items AS (SELECT DISTINCT i FROM comb), cnt AS (SELECT least(50, count(*)) AS n FROM items), o AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY value DESC, j) AS p FROM comb WHERE i <> j AND value <> 0)
    SELECT items.i AS node, round(coalesce(sum(value) FILTER (WHERE p <= 50), 0) / max(cnt.n), 6) AS mean_sim, round(coalesce(max(value), 0), 6) AS max_sim,
    round(sqrt(greatest(0, coalesce(sum(value * value) FILTER (WHERE p <= 50), 0) / max(cnt.n) - pow(coalesce(sum(value) FILTER (WHERE p <= 50), 0) / max(cnt.n), 2))), 6) AS std_sim, count(value) AS neighbours
    FROM items CROSS JOIN cnt LEFT JOIN o ON o.i = items.i GROUP BY 1"""
)
def metapath_features(spark, d):
    m = materialize(_combined(spark, d, keep=50, apart=True), "combined")
    counts = m.groupBy("i").agg(F.sum("n").alias("neighbours"))
    return feat.metapath_features(blocks.entries(m), counts.select("i"), counts=counts).select("node", r6("mean_sim"), r6("max_sim"), r6("std_sim"), "neighbours")


@query(
    f"""WITH {EDGES_SQL}, ends AS (SELECT src_type AS node_type, src AS canonical, weight AS o, 0.0 AS i FROM edges UNION ALL SELECT dst_type, dst, 0.0, weight FROM edges), g AS (SELECT node_type, canonical, sum(i) AS a, sum(o) AS b FROM ends GROUP BY 1, 2)
    SELECT node_type, canonical, round((a - (SELECT avg(a) FROM g)) / (SELECT stddev_pop(a) FROM g), 6) AS in_degree, round((b - (SELECT avg(b) FROM g)) / (SELECT stddev_pop(b) FROM g), 6) AS out_degree FROM g"""
)
def feature_zscore(spark, d):
    g = materialize(graph.degrees(graph.edges(relational_triples(spark, d))).select("node_type", "canonical", "in_degree", "out_degree"), "degrees")
    return feat.zscore(g, ["in_degree", "out_degree"]).select("node_type", "canonical", r6("in_degree"), r6("out_degree"))


@query(
    f"""WITH {NODES_SQL} SELECT node_type, node_id, CAST(frequency AS DOUBLE) AS frequency, round(ln(1 + frequency), 6) AS log_frequency, 2 + (SELECT count(DISTINCT node_type) FROM nodes) AS width,
    CAST(3 + (SELECT count(DISTINCT m.node_type) FROM nodes m WHERE m.node_type < nodes.node_type) AS BIGINT) AS hot FROM nodes"""
)
def fallback_features(spark, d):
    f = feat.fallback_features(graph.nodes(relational_triples(spark, d)))
    x = F.col("features")
    return f.select("node_type", "node_id", x[0].alias("frequency"), F.round(x[1], 6).alias("log_frequency"), F.size(x).cast("long").alias("width"), (F.array_position(F.slice(x, 3, 99), 1.0) + 2).cast("long").alias("hot"))


@query()
def bpr_weights(spark, d):
    """Weights of two meta-paths learned from pairs of suppliers of one nation against others; at most 1,500 pairs reach the driver."""
    import numpy as np

    out = dict(zip(("SPS", "SNS"), _matrices(spark, d, SUPPLIER_PATH, NATION_MATES)))
    items = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("i"), "s_nationkey")
    pos = items.join(items.select(F.col("i").alias("j"), "s_nationkey"), "s_nationkey").where("i < j").select("i", "j").orderBy(F.xxhash64("i", "j"), "i", "j").limit(500)
    pos = materialize(pos, "positive")
    neg = materialize(metapath.negative_pairs(items.select("i"), pos, 1000), "negative")
    s = {m: materialize(metapath.pairs_pathsim(x, pos.unionByName(neg)), m) for m, x in out.items()}
    scores = [np.array([[r["SPS"], r["SNS"]] for r in metapath.pair_scores(s, p).orderBy("i", "j").collect()]).reshape(-1, 2) for p in (pos, neg)]
    w, _ = metapath.learn_weights(*scores)
    return spark.createDataFrame([("SPS", float(w[0])), ("SNS", float(w[1]))], "mp_id string, weight double")


_HASH = "CAST('0x' || substr(md5({}), 1, 12) AS BIGINT) % {}"


@query(
    f"""WITH n AS (SELECT count(*) AS n FROM customer), i AS (SELECT c_custkey AS i, {_HASH.format("c_custkey || '|42'", "n")} AS spot FROM customer, n),
    t AS (SELECT i, unnest(range(1, greatest(1, -(-3000 // n)) + 1)) AS t, n FROM (SELECT c_custkey AS i FROM customer), n), tries AS (SELECT i, {_HASH.format("i || '|' || t || '|43'", "n")} AS spot FROM t),
    p AS (SELECT DISTINCT tries.i, i.i AS j FROM tries JOIN i USING (spot) WHERE tries.i <> i.i), q AS (SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = p.i AND o_orderkey = p.j))
    SELECT i, j FROM q ORDER BY {_HASH.format("i || '|' || j || '|42'", 1 << 40)}, i, j LIMIT 1000"""
)
def negative_samples(spark, d):
    items = table(spark, d, "customer").select(F.col("c_custkey").alias("i"))
    known = table(spark, d, "orders").select(F.col("o_custkey").alias("i"), F.col("o_orderkey").alias("j"))
    return metapath.negative_pairs(items, known, 1000)


# ---- texts -------------------------------------------------------------------------------------------------


def _docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "text", "source")


def _extracted(spark, d):
    return materialize(ent.extract(_docs(spark, d)), "extracted")



_IP = r"\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b"
_MAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
_NET_SQL = f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), raw AS (
  SELECT doc_id, 'IP' AS kind, list_filter(regexp_extract_all(text, '{_IP}', 0, 'i'), lambda x: x NOT IN ('127.0.0.1', '0.0.0.0', '255.255.255.255', '192.168.1.1', '10.0.0.1')
     AND CAST(split_part(x, '.', 1) AS INT) NOT IN (0, 127, 255) AND NOT (CAST(split_part(x, '.', 1) AS INT) = 192 AND CAST(split_part(x, '.', 2) AS INT) = 168)) AS x FROM t
  UNION ALL SELECT doc_id, 'Email', list_filter(regexp_extract_all(text, '{_MAIL}', 0, 'i'), lambda x: lower(x) NOT IN ('user@example.com', 'test@test.com', 'admin@domain.com', 'support@company.com')) FROM t
), sorted AS (SELECT doc_id, kind, list_sort(list_distinct(x)) AS x FROM raw) SELECT doc_id, kind, array_to_string(x, '|') AS vals, len(x) AS n FROM sorted WHERE len(x) > 0"""


@query(_NET_SQL)
def doc_addresses(spark, d):
    """All IP and e-mail addresses of every document."""
    return ent.addresses(_docs(spark, d)).select("doc_id", "kind", F.array_join("vals", "|").alias("vals"), F.size("vals").cast("long").alias("n"))


@query()
def doc_entities(spark, d):
    """All entity types of every document."""
    return _extracted(spark, d).where(F.size("vals") > 0).select("doc_id", "kind", F.array_join("vals", "|").alias("vals"), r6("confidence"))


@query()
def entity_distribution(spark, d):
    return ent.distribution(_extracted(spark, d))


@query()
def dataset_stats(spark, d):
    return ent.dataset_stats(_extracted(spark, d))


@query()
def confidence_balance(spark, d):
    """Documents by average confidence; the threshold suits prose without reports."""
    return ent.balance_by_confidence(_extracted(spark, d), 0.1).select("doc_id", r6("avg_confidence"))


@query()
def min_representation(spark, d):
    e = _extracted(spark, d)
    return ent.minimum_representation(e, ent.balance_by_confidence(e, 0.15).select("doc_id"))


@query("SELECT doc_id, source FROM documents WHERE length(text) >= 50 AND length(regexp_replace(text, '[^\\p{L}]', '', 'g')) / length(text) >= 0.7")
def doc_quality_filter(spark, d):
    from graphloom.functions.text import low_quality

    return _docs(spark, d).where((F.char_length("text") >= 50) & ~low_quality(F.col("text"))).select("doc_id", "source")


@query(
    r"""SELECT page_id, CASE WHEN kind = 'URL' THEN rtrim(trim(v), ',') WHEN kind = 'Domain' THEN rtrim(lower(trim(v)), '.,') ELSE trim(v) END AS canonical, kind FROM (
    SELECT page_id, url || ',' AS v, 'URL' AS kind FROM pages UNION ALL SELECT page_id, upper(regexp_extract(url, '://([^/]+)', 1)) || '.', 'Domain' FROM pages UNION ALL SELECT page_id, '  ' || url || ' ', 'Other' FROM pages)"""
)
def canonical_entities(spark, d):
    from graphloom.functions.text import canonical

    p = table(spark, d, "pages")
    v = p.select("page_id", F.concat("url", F.lit(",")).alias("v"), F.lit("URL").alias("kind")).unionByName(p.select("page_id", F.concat(F.upper(F.regexp_extract("url", "://([^/]+)", 1)), F.lit(".")).alias("v"), F.lit("Domain").alias("kind")))
    v = v.unionByName(p.select("page_id", F.concat(F.lit("  "), "url", F.lit(" ")).alias("v"), F.lit("Other").alias("kind")))
    return v.select("page_id", canonical(F.col("v"), F.col("kind")).alias("canonical"), "kind")


#: Names that occur in the invented prose, as stand-ins for entities of each type.
NAMES = (("ThreatActor", "with"), ("Malware", "that"), ("Malware", "thin"), ("Vulnerability", "from"), ("Device", "this"), ("Domain", "tion"), ("File", "ing"), ("Platform", "de la"))
_NAMES_SQL = "names AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{n}')" for k, n in NAMES) + ") AS t(kind, name))"
_SENT_SQL = r"""parts AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '(?s).+?(?:[.!?]+\s+|\n+|$)') AS p FROM documents),
sents0 AS (SELECT doc_id, unnest(range(len(p))) AS sid, unnest(p) AS sentence FROM parts), sents AS (SELECT doc_id, sid, sentence, CAST(sum(length(sentence)) OVER (PARTITION BY doc_id ORDER BY sid) AS BIGINT) AS stop FROM sents0)"""
_MENTION_SQL = f"""{_NAMES_SQL}, cut AS (SELECT doc_id, kind, name, string_split(lower(text), name) AS p FROM documents JOIN names ON contains(lower(text), name)),
cut2 AS (SELECT doc_id, kind, name, unnest(range(len(p))) AS k, unnest(p) AS part, len(p) AS n FROM cut),
cut3 AS (SELECT *, CAST(sum(length(part)) OVER (PARTITION BY doc_id, kind, name ORDER BY k) AS BIGINT) + k * length(name) AS start FROM cut2), mentions AS (SELECT doc_id, kind, name, start, start + length(name) AS stop FROM cut3 WHERE k < n - 1)"""


def _names(spark):
    return spark.createDataFrame(list(NAMES), "kind string, name string")


@query(f"WITH {_SENT_SQL} SELECT doc_id, sid, stop - length(sentence) AS start, stop, md5(sentence) AS digest FROM sents")
def sentences(spark, d):
    return relations.sentences(_docs(spark, d)).select("doc_id", "sid", "start", "stop", F.md5(F.encode("sentence", "utf-8")).alias("digest"))


@query(f"WITH {_MENTION_SQL} SELECT * FROM mentions")
def mentions(spark, d):
    return relations.find_mentions(_docs(spark, d), _names(spark))


@query(
    f"""WITH {_MENTION_SQL}, l AS (SELECT doc_id, list_sort(list({{'start': start, 'stop': stop, 'kind': kind, 'name': name}})) AS m FROM mentions GROUP BY 1),
    k AS (SELECT doc_id, list_reduce(list_transform(m, lambda x: [x]), lambda a, b: CASE WHEN b[1].start >= a[-1].stop THEN list_concat(a, b) ELSE a END) AS m FROM l), u AS (SELECT doc_id, unnest(m) AS x FROM k)
    SELECT doc_id, x.kind AS kind, x.name AS name, x.start AS start, x.stop AS stop FROM u"""
)
def mention_overlap(spark, d):
    return relations.keep_apart(relations.find_mentions(_docs(spark, d), _names(spark)))


_PLACED_SQL = f"""WITH {_SENT_SQL}, {_MENTION_SQL}, placed AS (SELECT m.doc_id, kind, name, start, m.stop, min(sid) AS sid FROM mentions m JOIN sents s ON s.doc_id = m.doc_id AND m.start >= s.stop - length(s.sentence) AND m.stop <= s.stop GROUP BY ALL),
wins AS (SELECT doc_id, sid AS wid, stop - length(sentence) AS window_start, lower(sentence || coalesce(lead(sentence) OVER (PARTITION BY doc_id ORDER BY sid), '')) AS evidence FROM sents),
inside AS (SELECT *, unnest(range(greatest(sid - 1, 0), sid + 1)) AS wid FROM placed), num AS (SELECT *, row_number() OVER (PARTITION BY doc_id, wid ORDER BY sid, start, stop, kind, name) AS p FROM inside),
pairs AS (SELECT a.doc_id, a.wid, a.kind AS kind1, a.name AS name1, a.start AS start1, a.stop AS stop1, b.kind AS kind2, b.name AS name2, b.start AS start2, b.stop AS stop2 FROM num a JOIN num b ON a.doc_id = b.doc_id AND a.wid = b.wid AND a.p < b.p)"""


def _placed(spark, d):
    docs = _docs(spark, d)
    sents = materialize(relations.sentences(docs), "sentences")
    return sents, materialize(relations.in_sentences(relations.find_mentions(docs, _names(spark)), sents), "placed")


@query(f"{_PLACED_SQL} SELECT doc_id, wid, kind1, name1, kind2, name2, count(*) AS pairs FROM pairs GROUP BY ALL")
def cooccur_pairs(spark, d):
    _, placed = _placed(spark, d)
    return relations.pairs(placed).groupBy("doc_id", "wid", "kind1", "name1", "kind2", "name2").agg(F.count(F.lit(1)).alias("pairs"))


#: Cue words that occur in the invented prose, in place of the reports' verbs, so that rules apply.
def _cued(docs):
    """Texts with some words of the prose replaced by verbs that rules know, so that every rule can apply."""
    text = F.col("text")
    for word, verb in CUES:
        text = F.regexp_replace(text, rf"(?U)\b{word}\b", verb)
    return docs.withColumn("text", text)


CUES = (("and", "exploit"), ("was", "affected"), ("for", "target"), ("des", "connect"), ("que", "download"), ("as", "linked to"), ("by", "uses"), ("los", "contain"), ("en", "based on"))


_HEDGES_SQL = "CASE " + " ".join(f"WHEN contains(low, '{w}') THEN '{'probable' if w in PROBABLE else 'possible'}'" for w in HEDGES) + " ELSE 'confirmed' END"
_NEGATED_SQL = "regexp_matches(low, '" + "|".join(w.replace("'", "''") for w in NEGATIONS) + "')"


def _cued_sql() -> str:
    """Texts with the cue words replaced; twice each, since a blank between two words of a kind belongs to one match."""
    out = "coalesce(text, '')"
    for word, verb in CUES:
        for _ in range(2):
            out = rf"regexp_replace({out}, '(^|[^0-9A-Za-z_\p{{L}}\p{{N}}\p{{M}}]){word}($|[^0-9A-Za-z_\p{{L}}\p{{N}}\p{{M}}])', '\1{verb}\2', 'g')"
    return out


_RULE_ROWS = ", ".join(f"({i * 100 + j}, '{r[0]}', '{p}', {list(r[1])}, {list(r[2])})" for i, r in enumerate(relations.RULES) if r[0] != "related_to" for j, p in enumerate(r[3]))
_RULES_SQL = (
    f"WITH cued AS (SELECT doc_id, {_cued_sql()} AS text FROM documents), "
    + _PLACED_SQL.removeprefix("WITH ").replace("FROM documents", "FROM cued")
    + rf""", rules(no, relation, pattern, sources, targets) AS (VALUES {_RULE_ROWS}),
    w AS (SELECT doc_id, wid, window_start, evidence AS low, chr(1) || regexp_replace(evidence, '[^ 0-9A-Za-z_\p{{L}}\p{{N}}\p{{M}}]', chr(1), 'g') || chr(1) AS t FROM wins),
    hits AS (SELECT w.doc_id, w.wid, no, relation, pattern, sources, targets FROM w JOIN rules ON contains(t, ' ' || pattern || ' ') OR contains(t, ' ' || pattern || chr(1)) OR contains(t, chr(1) || pattern || ' ') OR contains(t, chr(1) || pattern || chr(1))),
    fits AS (SELECT p.*, h.no, h.relation, h.pattern, list_contains(h.sources, p.kind1) AND list_contains(h.targets, p.kind2) AS ahead FROM pairs p JOIN hits h ON h.doc_id = p.doc_id AND h.wid = p.wid
      WHERE (list_contains(h.sources, p.kind1) AND list_contains(h.targets, p.kind2)) OR (list_contains(h.sources, p.kind2) AND list_contains(h.targets, p.kind1))),
    one AS (SELECT *, row_number() OVER (PARTITION BY doc_id, wid, kind1, name1, start1, kind2, name2, start2 ORDER BY no) AS k FROM fits),
    told AS (SELECT one.doc_id, one.wid, w.window_start, CASE WHEN ahead THEN kind1 ELSE kind2 END AS source_kind, CASE WHEN ahead THEN name1 ELSE name2 END AS source, CASE WHEN ahead THEN kind2 ELSE kind1 END AS target_kind,
      CASE WHEN ahead THEN name2 ELSE name1 END AS target, relation, pattern, start1, start2, {_HEDGES_SQL} AS certainty, {_NEGATED_SQL} AS negation FROM one JOIN w USING (doc_id, wid) WHERE k = 1),
    explicit AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, source_kind, source, target_kind, target, relation, window_start ORDER BY wid, start1, start2, pattern) AS k FROM told) WHERE k = 1)"""
)


def _related(spark, d):
    docs = _cued(_docs(spark, d))
    sents = materialize(relations.sentences(docs), "sentences")
    placed = materialize(relations.in_sentences(relations.find_mentions(docs, _names(spark)), sents), "placed")
    return docs, relations.relate(relations.pairs(placed), relations.windows(sents))


@query(f"{_RULES_SQL} SELECT doc_id, wid, source_kind, source, target_kind, target, relation, pattern, CAST(0.8 AS DOUBLE) AS confidence, certainty, negation FROM explicit")
def relation_rules(spark, d):
    """Relations by rule, between mentions in windows of two sentences."""
    return relations.explicit(_related(spark, d)[1]).select("doc_id", "wid", "source_kind", "source", "target_kind", "target", "relation", "pattern", "confidence", "certainty", "negation")


@query(f"{_RULES_SQL} SELECT doc_id, relation, count(*) AS count FROM explicit GROUP BY 1, 2")
def relation_histogram(spark, d):
    return relations.histogram(relations.explicit(_related(spark, d)[1]))


@query()
def weak_relations(spark, d):
    return relations.weak(materialize(_related(spark, d)[1], "related")).select("doc_id", "wid", "source_kind", "source", "target_kind", "target", "relation", r6("confidence"))


@query()
def predicate_words(spark, d):
    sents, placed = _placed(spark, d)
    return relations.frequent_words(sents, placed).select("word", "count")


_HEDGE_SQL = "CASE " + " ".join(f"WHEN contains(lower(s), '{w}') THEN '{'probable' if w in ('likely', 'probably') else 'possible'}'" for w in ("likely", "possibly", "probably", "may", "might", "could", "suspected", "believed", "allegedly")) + " ELSE 'confirmed' END"


@query(f"SELECT doc_id, {_HEDGE_SQL} AS certainty, regexp_matches(lower(s), 'not|no|never|neither|nor|without|unable|failed|doesn''t|don''t') AS negation FROM (SELECT doc_id, coalesce(text, '') AS s FROM documents)")
def certainty_negation(spark, d):
    from graphloom.functions.text import certainty, negated

    return _docs(spark, d).select("doc_id", certainty(F.col("text")).alias("certainty"), negated(F.col("text")).alias("negation"))


# ---- embeddings --------------------------------------------------------------------------------------------


def _points(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


_U = "u AS (SELECT vec_id AS id, label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))) AS v FROM embeddings)"
_COS = f"{_U}, cs AS (SELECT a.id AS src, b.id AS dst, round(list_dot_product(a.v, b.v), 9) AS cos FROM u a CROSS JOIN u b)"


@query(f"WITH {_COS}, r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY cos DESC, dst) AS p FROM cs) SELECT src, dst, round(cos, 6) AS cos FROM r WHERE p <= 10")
def cosine_topk(spark, d):
    p = _points(spark, d).select("id", "vec")
    return emb.cosines(p, p, 10).select("src", "dst", r6("cos"))


_KNOWN = "known AS (SELECT a.vec_id AS src, b.vec_id AS dst FROM embeddings a JOIN embeddings b ON a.label = b.label)"


@query(
    f"""WITH {_COS}, {_KNOWN}, near AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY cos DESC, dst) AS p FROM cs), left_over AS (SELECT src, dst, cos FROM near WHERE p <= 100 AND cos >= 0.3 AND NOT EXISTS (SELECT 1 FROM known k WHERE k.src = near.src AND k.dst = near.dst)),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY cos DESC, dst) AS rank FROM left_over) SELECT src, dst, round(cos, 6) AS score, rank FROM ranked ORDER BY src, rank LIMIT 100"""
)
def link_predict(spark, d):
    p = _points(spark, d)

    def known(near):
        a, b = p.select(F.col("id").alias("src"), F.col("label").alias("l1")), p.select(F.col("id").alias("dst"), F.col("label").alias("l2"))
        return near.join(a, "src").join(b, "dst").where("l1 = l2")

    return emb.predict_links(p.select("id", "vec"), p.select("id", "vec"), known, 100, 0.3).select("src", "dst", r6("score"), F.col("rank").cast("long").alias("rank"))


_NEAREST = f"WITH {_COS}, r AS (SELECT cs.*, row_number() OVER (PARTITION BY src ORDER BY cos DESC, dst) AS p FROM cs WHERE dst % 5 <> 0 AND src % 5 = 0)"


@query(f"{_NEAREST} SELECT r.src AS id, a.label AS truth, r.dst AS nearest, b.label AS predicted, round(cos, 6) AS confidence FROM r JOIN u a ON a.id = src JOIN u b ON b.id = dst WHERE p = 1")
def nn1_eval(spark, d):
    """Held-out fifth of the points, each with the label of its nearest among the rest."""
    p = _points(spark, d)
    held = p.where("id % 5 = 0")
    return emb.nearest_label(held, p.where("id % 5 <> 0")).join(held.select("id", F.col("label").alias("truth")), "id").select("id", "truth", "nearest", "predicted", r6("confidence"))


@query(f"{_NEAREST} SELECT round(avg(CAST(a.label = b.label AS INT)), 9) AS accuracy, count(*) AS n FROM r JOIN u a ON a.id = src JOIN u b ON b.id = dst WHERE p = 1")
def nn1_accuracy(spark, d):
    return nn1_eval(spark, d).agg(F.round(F.avg((F.col("truth") == F.col("predicted")).cast("double")), 9).alias("accuracy"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {_COS} SELECT a.label, round((sum(cos) - count(DISTINCT a.id)) / (count(DISTINCT a.id) * (count(DISTINCT a.id) - 1)), 5) AS cohesion, count(DISTINCT a.id) AS size FROM cs JOIN u a ON a.id = src JOIN u b ON b.id = dst WHERE a.label = b.label GROUP BY 1")
def cluster_cohesion(spark, d):
    return emb.cohesion(_points(spark, d)).select("label", F.round("cohesion", 5).alias("cohesion"), F.col("size").cast("long").alias("size"))


@query("SELECT label, dim, round(avg(x), 6) AS value FROM (SELECT label, unnest(range(len(embedding)))::INT AS dim, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings) GROUP BY 1, 2")
def cluster_centroid(spark, d):
    return emb.centroids(_points(spark, d)).select("label", "dim", r6("value"))


@query(
    f"""WITH {_U}, dist AS (SELECT a.id, a.label, b.label AS other, sum(1 - list_dot_product(a.v, b.v)) AS far, count(*) AS n FROM u a JOIN u b ON a.id <> b.id GROUP BY ALL),
    g AS (SELECT id, label, max(far / n) FILTER (WHERE label = other) AS a, min(far / n) FILTER (WHERE label <> other) AS b FROM dist GROUP BY ALL) SELECT id, label, round((b - a) / greatest(a, b), 6) AS silhouette FROM g"""
)
def silhouette(spark, d):
    return emb.silhouette(_points(spark, d)).select("id", "label", r6("silhouette"))


@query(
    """WITH e AS (SELECT vec_id, label, unnest(range(len(embedding))) AS dim, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings), m AS (SELECT dim, avg(x) AS m FROM e GROUP BY 1), c AS (SELECT label, dim, avg(x) AS c, count(*) AS n FROM e GROUP BY 1, 2),
    b AS (SELECT sum(n * (c - m) * (c - m)) AS b FROM c JOIN m USING (dim)), w AS (SELECT sum((x - c) * (x - c)) AS w FROM e JOIN c USING (label, dim)), k AS (SELECT count(DISTINCT label) AS k, count(*) AS n FROM embeddings)
    SELECT n AS points, k AS labels, round((b / (k - 1)) / (w / (n - k)), 6) AS score FROM b, w, k"""
)
def calinski_harabasz(spark, d):
    return emb.calinski_harabasz(_points(spark, d)).select(F.col("points").cast("long").alias("points"), F.col("labels").cast("long").alias("labels"), r6("score"))


@query(
    f"""WITH RECURSIVE {_COS}, near AS (SELECT src, dst FROM cs WHERE cos >= 0.35), core AS (SELECT src AS id FROM near GROUP BY 1 HAVING count(*) >= 3),
    link AS (SELECT n.src, n.dst FROM near n JOIN core a ON a.id = n.src JOIN core b ON b.id = n.dst), reach AS (SELECT id AS root, id FROM core UNION SELECT r.root, l.dst FROM reach r JOIN link l ON l.src = r.id),
    comp AS (SELECT id, min(root) AS root FROM reach GROUP BY 1), num AS (SELECT root, row_number() OVER (ORDER BY root) - 1 AS cluster FROM (SELECT DISTINCT root FROM comp)), cc AS (SELECT id, cluster FROM comp JOIN num USING (root)),
    border AS (SELECT n.src AS id, min(cc.cluster) AS cluster FROM near n JOIN cc ON cc.id = n.dst GROUP BY 1)
    SELECT u.id, coalesce(cc.cluster, border.cluster, -1) AS cluster, cc.id IS NOT NULL AS core FROM u LEFT JOIN cc ON cc.id = u.id LEFT JOIN border ON border.id = u.id"""
)
def dbscan_cosine(spark, d):
    return emb.dbscan(_points(spark, d).select("id", "vec"), 0.65, 3)


@query("SELECT label, count(*) AS size FROM embeddings GROUP BY 1")
def cluster_sizes(spark, d):
    return emb.cluster_sizes(_points(spark, d).select(F.col("label").alias("cluster"))).withColumnRenamed("cluster", "label")


@query("SELECT dim, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std FROM (SELECT unnest(range(len(embedding)))::INT AS dim, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings) GROUP BY 1")
def embedding_stats(spark, d):
    return feat.vector_stats(_points(spark, d), "vec").select("dim", r6("mean"), r6("std"))


@query()
def kmeans(spark, d):
    return emb.kmeans(_points(spark, d))


@query()
def pca2(spark, d):
    return emb.pca(_points(spark, d))


@query(
    f"""WITH {_COS}, c AS (SELECT a.label, (sum(cos) - count(DISTINCT a.id)) / (count(DISTINCT a.id) * (count(DISTINCT a.id) - 1)) AS cohesion, count(DISTINCT a.id) AS size FROM cs JOIN u a ON a.id = src JOIN u b ON b.id = dst WHERE a.label = b.label GROUP BY 1)
    SELECT label, size, round(cohesion, 5) AS cohesion, least(50, size) AS members FROM c"""
)
def cluster_summaries(spark, d):
    meta = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("canonical"), F.col("n_chars").alias("frequency"))
    return emb.summaries(_points(spark, d), meta).select("label", F.col("size").cast("long").alias("size"), F.round("cohesion", 5).alias("cohesion"), F.size("members").cast("long").alias("members"))


# ---- neighbourhoods, time ----------------------------------------------------------------------------------

_LINKS = f"WITH {EDGES_SQL}, links AS (SELECT DISTINCT * FROM (SELECT src_type AS t, src AS n, dst_type AS vt, dst AS v FROM edges UNION ALL SELECT dst_type, dst, src_type, src FROM edges))"


@query(
    f"""{_LINKS}, p AS (SELECT a.s_suppkey::VARCHAR AS a, b.s_suppkey::VARCHAR AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey), sz AS (SELECT n, count(*) AS c FROM links WHERE t = 'Supplier' GROUP BY 1),
    sh AS (SELECT p.a, p.b, count(*) AS c FROM p JOIN links x ON x.t = 'Supplier' AND x.n = p.a JOIN links y ON y.t = 'Supplier' AND y.n = p.b AND y.vt = x.vt AND y.v = x.v GROUP BY 1, 2)
    SELECT p.a, p.b, round(coalesce(sh.c, 0) / (x.c + y.c - coalesce(sh.c, 0)), 6) AS overlap FROM p JOIN sz x ON x.n = p.a JOIN sz y ON y.n = p.b LEFT JOIN sh ON sh.a = p.a AND sh.b = p.b"""
)
def jaccard_neighbors(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("i"), F.col("s_nationkey").alias("grp"))
    both = blocks.entries(graph.group_overlap(relational_triples(spark, d), "Supplier", s))
    return both.where(F.col("i").cast("long") < F.col("j").cast("long")).select(F.col("i").alias("a"), F.col("j").alias("b"), F.round("value", 6).alias("overlap"))


@query(
    f"""WITH {EDGES_SQL}, m AS (SELECT s_nationkey AS grp, 'Supplier' AS t, s_suppkey::VARCHAR AS n, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS place FROM supplier), f AS (SELECT * FROM m WHERE place <= 10),
    c AS (SELECT grp, name, count(*) AS count FROM (SELECT grp, relation || '->' || dst_type AS name FROM f JOIN edges ON src_type = t AND src = n UNION ALL SELECT grp, src_type || '->' || relation FROM f JOIN edges ON dst_type = t AND dst = n) GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY count DESC, name) AS rank FROM c) SELECT grp, name, count, rank FROM r WHERE rank <= 5"""
)
def common_relations(spark, d):
    from pyspark.sql.window import Window

    m = table(spark, d, "supplier").select(F.col("s_nationkey").alias("grp"), F.lit("Supplier").alias("node_type"), F.col("s_suppkey").cast("string").alias("canonical"), F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey")).alias("place"))
    return graph.common_relations(materialize(graph.edges(relational_triples(spark, d)), "edges"), m).select("grp", "name", "count", F.col("rank").cast("long").alias("rank"))


@query("SELECT user_id AS grp, min(ts) AS earliest, max(ts) AS latest, CAST(sum(CASE WHEN value > 0 THEN 1 ELSE 0 END) AS BIGINT) AS active, CAST(floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 86400000000) AS BIGINT) AS span_days FROM events GROUP BY 1")
def temporal_span(spark, d):
    e = table(spark, d, "events")
    return graph.temporal_span(e.select(F.col("user_id").alias("grp"), F.col("ts").alias("first_seen"), F.col("ts").alias("last_seen"), F.col("value").alias("frequency")))


# ---- labels and scores -------------------------------------------------------------------------------------


@query("WITH s AS (SELECT c_nationkey AS label, count(*) AS n FROM customer GROUP BY 1 HAVING count(*) >= 60), m AS (SELECT label, dense_rank() OVER (ORDER BY label) - 1 AS new_label FROM s) SELECT c_custkey AS id, c_nationkey AS label, coalesce(new_label, -1) AS new_label FROM customer LEFT JOIN m ON m.label = c_nationkey")
def relabel(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("label"))
    return labels.relabel(c, 60).select("id", "label", "new_label")


@query("SELECT count(*) AS labels, min(n) AS least, max(n) AS largest, round(avg(n), 6) AS mean, CAST(sum(n) AS BIGINT) AS total, CAST(sum(CASE WHEN n < 3 THEN 1 ELSE 0 END) AS BIGINT) AS small FROM (SELECT label, count(*) AS n FROM embeddings WHERE label >= 0 GROUP BY 1)")
def label_sizes(spark, d):
    return labels.label_sizes(_points(spark, d)).select("labels", "least", "largest", r6("mean"), "total", "small")


@query("SELECT n.n_nationkey AS node_id, n.n_name, coalesce(max(CASE WHEN c_acctbal > 9990 THEN c_nationkey % 7 END), -1) AS label FROM nation n LEFT JOIN customer ON c_nationkey = n.n_nationkey GROUP BY 1, 2")
def label_assign(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("node_id"), "n_name")
    lab = table(spark, d, "customer").where("c_acctbal > 9990").select(F.col("c_nationkey").alias("node_id"), (F.col("c_nationkey") % 7).alias("label"))
    return labels.assign(n, lab).select("node_id", "n_name", "label")


_PARTS = "c AS (SELECT grp, n, CAST(floor(n * CAST(0.6 AS DOUBLE)) AS BIGINT) AS a, CAST(floor(n * CAST(0.2 AS DOUBLE)) AS BIGINT) AS b FROM g), p AS (SELECT grp, 'train' AS part, a AS rows FROM c UNION ALL SELECT grp, 'val', b FROM c UNION ALL SELECT grp, 'test', n - a - b FROM c)"


@query(f"WITH g AS (SELECT c_nationkey AS grp, count(*) AS n FROM customer GROUP BY 1), {_PARTS} SELECT grp AS c_nationkey, part, rows FROM p WHERE rows > 0")
def stratified_split(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_nationkey")
    return labels.split(c, by="c_nationkey").groupBy("c_nationkey", "part").agg(F.count(F.lit(1)).alias("rows"))


@query(
    """WITH r AS (SELECT o_orderkey AS id, row_number() OVER (ORDER BY md5(o_orderkey || '|42'), o_orderkey) - 1 AS place, count(*) OVER () AS n FROM orders)
    SELECT id, CASE WHEN place < floor(n * CAST(0.6 AS DOUBLE)) THEN 'train' WHEN place < floor(n * CAST(0.6 AS DOUBLE)) + floor(n * CAST(0.2 AS DOUBLE)) THEN 'val' ELSE 'test' END AS part FROM r"""
)
def random_split(spark, d):
    return labels.split(table(spark, d, "orders").select(F.col("o_orderkey").alias("id")))


@query("WITH n AS (SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_orderkey) - 1 AS place, count(*) OVER () AS n FROM orders) SELECT id, CASE WHEN place < floor(n * 0.8) THEN 'train' ELSE 'test' END AS part FROM n")
def ordered_split(spark, d):
    return labels.ordered_split(table(spark, d, "orders").select(F.col("o_orderkey").alias("id")), F.col("id"))


_SCORED = "s AS (SELECT l_quantity AS score, l_returnflag = 'R' AS truth FROM lineitem), b AS (SELECT score, CAST(sum(CAST(truth AS INT)) AS BIGINT) AS p, CAST(sum(1 - CAST(truth AS INT)) AS BIGINT) AS n FROM s GROUP BY 1)"


def _scored(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_quantity").alias("score"), (F.col("l_returnflag") == "R").alias("truth"))


@query(f"WITH {_SCORED}, c AS (SELECT *, sum(n) OVER (ORDER BY score) - n AS below FROM b) SELECT CAST(sum(p) AS BIGINT) AS positives, CAST(sum(n) AS BIGINT) AS negatives, round(sum(p * (below + n / 2.0)) / (CAST(sum(p) AS DOUBLE) * sum(n)), 9) AS auc FROM c")
def rank_auc(spark, d):
    return labels.roc_auc(_scored(spark, d)).select("positives", "negatives", F.round("auc", 9).alias("auc"))


@query(f"WITH {_SCORED}, c AS (SELECT *, sum(p) OVER (ORDER BY score DESC) AS cp, sum(n) OVER (ORDER BY score DESC) AS cn FROM b) SELECT round(sum(p * (cp / (cp + cn))) / sum(p), 9) AS average_precision FROM c")
def average_precision(spark, d):
    return labels.average_precision(_scored(spark, d)).select(F.round("average_precision", 9).alias("average_precision"))


_PRED = "p AS (SELECT o_orderpriority AS truth, CASE WHEN o_totalprice > 150000 THEN '1-URGENT' WHEN o_orderstatus = 'F' THEN '2-HIGH' ELSE o_orderpriority END AS predicted FROM orders)"
_REPORT = f"""WITH {_PRED}, l AS (SELECT truth AS label FROM p UNION SELECT predicted FROM p), x AS (SELECT label, (SELECT count(*) FROM p WHERE truth = label) AS support, (SELECT count(*) FROM p WHERE predicted = label) AS said, (SELECT count(*) FROM p WHERE truth = label AND predicted = label) AS hit FROM l),
y AS (SELECT label, support, CASE WHEN said > 0 THEN hit / said ELSE 0 END AS precision, CASE WHEN support > 0 THEN hit / support ELSE 0 END AS recall FROM x), z AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM y)"""


def _predicted(spark, d):
    said = F.when(F.col("o_totalprice") > 150000, "1-URGENT").when(F.col("o_orderstatus") == "F", "2-HIGH").otherwise(F.col("o_orderpriority"))
    return table(spark, d, "orders").select(F.col("o_orderpriority").alias("truth"), said.alias("predicted"))


@query(f"{_REPORT} SELECT label, support, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1 FROM z")
def classification_report(spark, d):
    return labels.report(_predicted(spark, d)).select("label", "support", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")))


@query(f"{_REPORT} SELECT (SELECT round(avg(CAST(truth = predicted AS INT)), 9) FROM p) AS accuracy, round(avg(f1), 9) AS macro_f1, round(sum(f1 * support) / sum(support), 9) AS weighted_f1 FROM z")
def weighted_f1(spark, d):
    return labels.overall(_predicted(spark, d)).select(*(F.round(c, 9).alias(c) for c in ("accuracy", "macro_f1", "weighted_f1")))


# ---- tags --------------------------------------------------------------------------------------------------


def _tagged(spark, d):
    docs = _docs(spark, d)
    found = ent.extract(docs, ("IP", "Email", "Domain", "URL"))
    values = found.select("doc_id", "kind", F.posexplode("vals").alias("i", "value"), "kind_no").select("doc_id", "kind", "value", (F.col("kind_no") * 100 + F.col("i")).alias("place"))
    return tagging.bio_tags(docs, values)


@query()
def bio_tags(spark, d):
    return tagging.training_rows(_tagged(spark, d)).select("doc_id", F.array_join("tags", " ").alias("tags"))


@query()
def class_weights(spark, d):
    return tagging.class_weights(tagging.label_counts(_tagged(spark, d))).select("label", "count", r6("weight"))


_TAG_SQL = "CASE WHEN event_type = 'click' THEN 'B-IP' WHEN event_type = 'view' THEN 'I-IP' WHEN event_type = 'purchase' THEN 'B-FILE' ELSE 'O' END"


@query(
    f"""WITH t AS (SELECT user_id AS doc_id, event_id AS place, {_TAG_SQL} AS tag, 0.5 + abs(value) / (2 + 2 * abs(value)) AS confidence FROM events), k AS (SELECT *, CAST(sum(CASE WHEN tag[1:1] = 'B' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY place) AS BIGINT) AS span FROM t WHERE tag <> 'O'),
    o AS (SELECT *, max(CASE WHEN tag[1:1] = 'B' THEN tag[3:] END) OVER (PARTITION BY doc_id, span) AS kind FROM k WHERE span > 0)
    SELECT doc_id, kind, min(place) AS start, max(place) AS stop, round(min(confidence), 9) AS confidence, count(*) AS tokens FROM o WHERE tag[3:] = kind GROUP BY doc_id, span, kind"""
)
def bio_spans(spark, d):
    """Spans from tags; events stand in for tokens, their types for predicted tags."""
    e = table(spark, d, "events")
    kind = F.col("event_type")
    tag = F.when(kind == "click", "B-IP").when(kind == "view", "I-IP").when(kind == "purchase", "B-FILE").otherwise("O")
    v = F.abs("value")
    tokens = e.select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("place"), F.lit("x").alias("token"), tag.alias("tag"), (F.lit(0.5) + v / (F.lit(2.0) + F.lit(2.0) * v)).alias("confidence"))
    return tagging.spans(tokens).select("doc_id", "kind", "start", "stop", F.round("confidence", 9).alias("confidence"), F.size(F.split("value", " ")).cast("long").alias("tokens"))


@query("SELECT event_type AS label, row_number() OVER (ORDER BY event_type) - 1 AS id FROM (SELECT DISTINCT event_type FROM events)")
def label_mapping(spark, d):
    return tagging.label_ids(table(spark, d, "events").groupBy(F.col("event_type").alias("label")).agg(F.count(F.lit(1)).alias("count")))


# ---- reports -----------------------------------------------------------------------------------------------


@query(f"WITH {NODES_SQL} SELECT node_id, node_type, canonical, CASE WHEN node_id = 0 THEN 'id' WHEN contains(lower(canonical), 'pur') THEN 'name' ELSE 'type' END AS matched FROM nodes WHERE node_id = 0 OR contains(lower(canonical), 'pur') OR node_type = 'Region'")
def find_node(spark, d):
    return reports.find_node(graph.nodes(relational_triples(spark, d)), 0, "PUR", "Region").select("node_id", "node_type", "canonical", "matched")


@query(
    f"WITH {NODES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY node_type ORDER BY frequency DESC, node_id) AS rank FROM nodes) SELECT DISTINCT node_id, canonical, node_type FROM r WHERE rank <= 50 AND node_type = 'Supplier' ORDER BY node_id LIMIT 50"
)
def list_nodes(spark, d):
    from pyspark.sql.window import Window

    n = graph.nodes(relational_triples(spark, d))
    return reports.list_nodes(n.withColumn("rank", F.row_number().over(Window.partitionBy("node_type").orderBy(F.desc("frequency"), "node_id"))), "Supplier")


_PAIRS = (("with", "that"), ("from", "this"), ("que", "los"))


@query(
    "WITH p(subject, object) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _PAIRS) + """), h AS (SELECT subject, object, doc_id, trim(substr(lower(text), greatest(1, instr(lower(text), subject) - 120), 400), ' ') AS snippet,
    row_number() OVER (PARTITION BY subject, object ORDER BY doc_id) AS hit FROM documents JOIN p ON contains(lower(text), subject) AND contains(lower(text), object)) SELECT subject, object, doc_id, md5(snippet) AS snippet, hit FROM h WHERE hit <= 5"""
)
def evidence_search(spark, d):
    pairs = spark.createDataFrame(list(_PAIRS), "subject string, object string")
    return reports.evidence(pairs, _docs(spark, d)).select("subject", "object", "doc_id", F.md5(F.encode("snippet", "utf-8")).alias("snippet"), F.col("hit").cast("long").alias("hit"))


@query()
def prompt_text(spark, d):
    p = _points(spark, d)
    near = emb.cosines(p.select("id", "vec"), p.select("id", "vec"), 11).where("src <> dst")
    from pyspark.sql.window import Window

    links = near.select(F.col("src").alias("subject_id"), F.row_number().over(Window.partitionBy("src").orderBy(F.desc("cos"), "dst")).alias("rank"), F.lit("related_to").alias("relation"), F.col("dst").cast("string").alias("object"), F.lit("Vector").alias("object_type"), F.col("cos").alias("score"), F.array().cast("array<string>").alias("evidence"))
    subjects = p.select(F.col("id").alias("node_id"), F.concat(F.lit("vector "), "id").alias("canonical"), F.lit("Vector").alias("node_type"), F.lit(1).alias("frequency"))
    return reports.prompts(subjects, links)
