"""Readers, writers and streams."""

import json

from graphloom.operators import entities, graph
from graphloom.sources import readers, writers
from graphloom.streaming import events


def test_triples_with_bad_lines(spark, tmp_path):
    lines = [json.dumps({"head_text": "a", "tail_text": "b"}), "{oops", json.dumps({"head_text": "", "tail_text": "b"})]
    (tmp_path / "t.jsonl").write_text("\n".join(lines))
    good, bad = readers.triples(spark, str(tmp_path / "t.jsonl"))
    r = good.collect()
    assert len(r) == 1 and r[0]["relation"] == "related_to" and r[0]["confidence"] == 0.8 and r[0]["head_type"] == "Unknown" and bad.count() == 2


def test_paged_feed_stops_at_errors(spark):
    def fetch(page):
        if page == 3:
            raise OSError
        return [{"id": f"{page}{i}", "description": "d", "created": "", "tags": [], "references": [], "indicators": []} for i in range(2)]

    assert readers.paged_feed(spark, fetch, limit=10).count() == 4
    assert readers.paged_feed(spark, fetch, limit=3).count() == 3
    assert readers.paged_feed(spark, lambda p: [], limit=3).count() == 0


def test_bundle(spark, tmp_path):
    objects = [{"id": "1", "type": "attack-pattern", "name": "N", "description": "D", "x_mitre_platforms": ["Linux"], "kill_chain_phases": [{"phase_name": "p"}]}, {"id": "2", "type": "tool"}, {"id": "3", "type": "other"}]
    (tmp_path / "b.json").write_text(json.dumps({"objects": objects}))
    o = readers.bundle(spark, str(tmp_path / "b.json"))
    assert [r["id"] for r in readers.attack_data(o).collect()] == ["1", "2"]
    assert entities.bundle_context(readers.techniques(o)).first()["text"] == "Name: N D Platforms: Linux Kill Chain: p"


def test_feed_context_and_quality(spark):
    item = {"id": "1", "description": "x" * 60, "created": "", "tags": ["t"], "references": ["r"], "indicators": [{"type": "IPv4", "indicator": "1.1.1.1"}, {"type": "domain", "indicator": "a.b"}]}
    df = spark.createDataFrame([item, item | {"id": "2", "indicators": item["indicators"][:1]}], readers.FEED)
    kept = entities.quality_feed(df)
    assert [r["id"] for r in kept.collect()] == ["1"]
    assert entities.feed_context(kept).first()["text"] == "x" * 60 + " Tags: t Indicators: IPv4:1.1.1.1, domain:a.b References: r"


def test_graph_round_trip_prunes_relations(spark, tmp_path):
    t = spark.createDataFrame([("A", "a", "uses", "B", "b", 0.8, False, "s", 1), ("A", "a", "has", "B", "b", 0.8, False, "s", 2)], "head_type string, head_text string, relation string, tail_type string, tail_text string, confidence double, negation boolean, source string, ord long")
    writers.graph(graph.nodes(t), graph.edges(t), str(tmp_path / "g"))
    assert writers.relation(spark, str(tmp_path / "g"), "A", "has", "B").count() == 1


def test_event_windows(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    src.write.parquet(str(tmp_path / "e"))
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    q = events.tumbling(events.event_stream(spark, str(tmp_path / "e"))).writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.sql("select sum(events) from w").first()[0] == src.count()
