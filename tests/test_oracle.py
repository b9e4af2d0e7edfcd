"""Queries against their SQL on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from quillon.plans import catalog, oracle

#: One query or more of every family of operators; the driver compares all of them.
CHECKED = (
    "dup_alert_ids chrono_split chrono_split_ties split_summary unseen_flag alert_catalog regex_class_select json_record_normalize synthetic_alerts clean_text tokens_bigram vocab_topk "
    "dedup_leader_cosine user_sessions edge_sample projection_edges tfidf_l2 pn_vector position_normalize kc_fanin fingerprint_embeddings projection_colnorm bridge_fingerprint rewire_degree_check jaccard_pairs knn_jaccard knn_cosine novelty_auroc lof_scores "
    "dedup_sweep class_report retrieval_metrics online_reason_counts diffusion_3 feedback_audit trace_edges inspect"
).split()


def tidy(value):
    return round(value, 5) + 0.0 if isinstance(value, float) else value


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for name in os.listdir(data):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{data}/{name}'")
    return con


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, data, duck, name):
    df = catalog.QUERIES[name](spark, data)
    columns = sorted(df.columns)
    got = sorted((tuple(tidy(r[c]) for c in columns) for r in df.collect()), key=repr)
    rel = duck.sql(oracle.SQL[name])
    assert sorted(rel.columns) == columns
    want = sorted((tuple(tidy(x) for x in r) for r in rel.select(*[f'"{c}"' for c in columns]).fetchall()), key=repr)
    assert got == want


def test_every_query_has_sql_or_is_known_not_to():
    assert set(catalog.QUERIES) - set(oracle.SQL) == {"isolation_forest", "ocsvm_scores", "logreg_verdict", "forest_verdict", "online_readout"}
    assert set(oracle.SQL) <= set(catalog.QUERIES)


@pytest.mark.parametrize("partitions", ["1", "17"])
def test_results_do_not_depend_on_partitions(spark, data, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    want = sorted(map(tuple, catalog.QUERIES["fingerprint_embeddings"](spark, data).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        assert sorted(map(tuple, catalog.QUERIES["fingerprint_embeddings"](spark, data).collect())) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_votes_use_whole_texts(spark, data, tmp_path):
    """Behind 17,000 characters without a term, texts name their class; what is cut there has no neighbours."""
    n = 200
    texts = [". " * 8_500 + ("alpha beta gamma delta epsilon" if i % 2 else "omega sigma theta kappa lambda") for i in range(n)]
    spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1 - i % 2, i % 2) for i in range(n)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    got = sorted(map(tuple, catalog.QUERIES["knn_vote"](spark, str(tmp_path)).collect()))
    assert got == sorted(con.sql(oracle.SQL["knn_vote"]).fetchall())
    assert got == [(i, "TRUE_POSITIVE" if i % 2 else "BENIGN", 1.0) for i in range(170, n)]
