"""Registered queries against DuckDB on the smallest tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from graphloom.plans.queries import ORACLES, QUERIES  # noqa: E402

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


def text(v):
    return str(round(v, 6) + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
@pytest.mark.parametrize("name", ["hin_edges", "hin_nodes", "hin_reverse_edges", "hin_density", "node_degree", "metapath_enum", "pathsim_sps", "sentences", "mention_overlap", "cosine_topk", "silhouette", "dbscan_cosine", "rank_auc", "average_precision", "weighted_f1", "bio_spans", "evidence_search"])
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    c = duck.execute(ORACLES[name])
    cols = [x[0] for x in c.description]
    assert sorted(cols) == sorted(df.columns)
    want = sorted(tuple(text(r[cols.index(k)]) for k in sorted(cols)) for r in c.fetchall())
    assert sorted(tuple(text(r[k]) for k in sorted(cols)) for r in df.collect()) == want
