"""Hand-worked values of the text functions."""

import re

import pytest
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.functions.patterns import PATTERNS
from graphloom.operators import entities as E


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    "kind, value, want",
    [
        ("Vulnerability", "cve 2024 12345", "CVE-2024-12345"), ("Domain", "Evil.COM.,", "evil.com"), ("IP", " 8.8.8.8.", "8.8.8.8"), ("URL", "http://a/,", "http://a/"), ("ThreatActor", " Fancy  Bear ", "fancy bear"),
        ("FileHash-MD5", "AB CD", "abcd"), ("Other", " x ", "x"), ("Domain", "NULL", "NULL"), ("Domain", None, None),
    ],
)
def test_canonical(spark, kind, value, want):
    assert one(spark, value, lambda v: T.canonical(v, F.lit(kind))) == want
    if want:
        assert one(spark, want, lambda v: T.canonical(v, F.lit(kind))) == want


@pytest.mark.parametrize("value, want", [("127.0.0.1", False), ("192.168.5.5", False), ("8.8.8.8", True), ("10.0.0.2", True), ("10.0.0.1", False), ("1.2.3.256", False), ("2001:db8::1", False)])
def test_addresses(spark, value, want):
    assert one(spark, value, lambda v: T.valid(v, "IP")) is want


@pytest.mark.parametrize("kind, value, want", [("File", "a.exe", True), ("File", "file.exe", False), ("Email", "a@b.c", True), ("Email", "a@b@c.d", False), ("ThreatActor", "lazarus", False), ("ThreatActor", "xAPT1", True), ("Other", "abc123", False), ("Other", "a" * 32, True), ("Domain", "a_b.com", False)])
def test_validity(spark, kind, value, want):
    assert one(spark, value, lambda v: T.valid(v, kind)) is want


@pytest.mark.parametrize("value, want", [("may be", "possible"), ("likely", "probable"), ("is", "confirmed"), ("unlikely", "probable"), (None, "confirmed")])
def test_certainty(spark, value, want):
    assert one(spark, value, T.certainty) == want


def test_negation(spark):
    assert one(spark, "we know it", T.negated) is True
    assert one(spark, "we know it", lambda v: T.negated(v, True)) is False


def test_low_quality(spark):
    assert one(spark, "", T.low_quality) and one(spark, "1 2 3 4 a", T.low_quality) and not one(spark, "abcdefg é", T.low_quality)


TEXT = "The server 8.8.8.8 drops evil.exe from http://bad.example.org/x and connects to c2.bad.org. APT28 group used Emotet malware; CVE-2021-44228 affects Windows 10. Mail: a.b@c.org. Été 10.1.2.3"


@pytest.mark.parametrize("kind", ["IP", "URL", "Email", "Vulnerability", "Platform", "Type"])
def test_extraction_follows_unicode_patterns(spark, kind):
    """Against Python's own regular expressions, with the tidying done by hand for types that need none."""
    want = sorted({re.sub(r"\s+", " ", m.group().strip()).lower() if kind in T.LOWERED else m.group().strip() for p in PATTERNS[kind] for m in re.finditer(p, TEXT, re.I | re.M)})
    got = one(spark, TEXT, lambda v: E.values_of(v, kind, 99))
    assert [x for x in want if x in got] == got and got


def test_confidence(spark):
    df = spark.createDataFrame([(1, "server host 8.8.8.8")], "doc_id long, text string")
    r = E.extract(df, ("IP",)).first()
    assert abs(r["confidence"] - (1 / 3 + 0.2)) < 1e-12 and r["vals"] == ["8.8.8.8"]


def test_null_and_empty_texts(spark):
    df = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert all(r["vals"] == [] and r["confidence"] == 0 for r in E.extract(df).collect())
    assert E.as_maps(E.extract(df)).first()["entities"]["IP"] == ["NULL"]


def test_minimum_representation(spark):
    rows = [(i, "IP" if i < 3 else "File", ["x"], 0.1 * i) for i in range(6)]
    e = spark.createDataFrame(rows, "doc_id long, kind string, vals array<string>, confidence double")
    got = {(r["doc_id"], r["added_for"]) for r in E.minimum_representation(e, e.where("doc_id = 0").select("doc_id"), least=2).collect()}
    assert got == {(0, None), (2, "IP"), (5, "File"), (4, "File")}


def test_addresses_are_those_of_the_sql(spark, tmp_path):
    import duckdb

    from graphloom.plans.queries import ORACLES, QUERIES

    texts = [
        "from: a@b.com", "email address x.y@z.org and e-mail: q@r.de", "connects to 8.8.8.8x, host is 9.9.9.1234", "IP address: 1.2.3.4 server: 01.002.3.4", "é5.6.7.8 日本1.1.1.1本 ñu@v.es é@w.fr",
        "\u017ftop@\u212aey.com_ A@B.CO|M", "127.0.0.1 192.168.7.7 10.0.0.1 255.1.1.1 0.1.1.1 127.9.9.9", "user@EXAMPLE.com Test@test.com", "b@b.bb a@a.aa c@c.cc e@e.ee d@d.dd f@f.ff", "1.2.3.4.5.6.7.8 1.2.3.400", None, "", "a@b.c.d@e.ff @x.yy a..b@-.co",
    ]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'s' AS source").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(ORACLES["doc_addresses"]).fetchall()
    got = [(r["doc_id"], r["kind"], r["vals"], r["n"]) for r in QUERIES["doc_addresses"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want) and len(want) >= 8


def test_addresses_are_all_kept(spark):
    from graphloom.operators.entities import addresses

    mails, ips = [f"user{i:02}@site.org" for i in range(30)], [f"8.8.4.{i}" for i in range(10, 22)]
    docs = spark.createDataFrame([(1, " ".join([*mails, *ips, *mails]))], "doc_id long, text string")
    assert {r["kind"]: r["vals"] for r in addresses(docs).collect()} == {"Email": mails, "IP": ips}
