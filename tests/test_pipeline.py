"""Fit, save, load and inspect; files and the service."""

from __future__ import annotations

import json
import threading
import urllib.error
import urllib.request
from http.server import ThreadingHTTPServer

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.plans import evaluation, pipeline, studies
from quillon.service import Graph, flat_record, handler
from quillon.sources import arrays, synthetic

SMALL = {"features": {"input_features": 128, "categorical_hash_dim": 64, "text_max_features": 56}, "expansion": {"kc_dim": 256, "top_k": 16}}


@pytest.fixture(scope="module")
def fitted(spark):
    alerts = synthetic.alerts(spark, 120).withColumn("id", F.substring("alert_id", 2, 8).cast("long"))
    return pipeline.train_and_score(alerts, SMALL)


def test_every_row_has_winners_and_reload_is_equal(spark, fitted, tmp_path):
    model, scored = fitted
    rows = sorted(map(tuple, scored.collect()))
    assert rows and all(0 < r[1] <= 16 and 0 <= r[3] <= 1 for r in rows)
    pipeline.save(model, str(tmp_path), "one")
    again = pipeline.load(spark, str(tmp_path), "one")
    assert again.limit == model.limit
    victim = next((tmp_path / "one" / "prints").glob("*.parquet"))
    some = model.history.limit(3)
    found = again.inspect(some).collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, model.inspect(some).collect())) and all(r["matches_include_self"] for r in found)
    victim.write_bytes(victim.read_bytes() + b"x")
    victim.with_name(f".{victim.name}.crc").unlink(missing_ok=True)
    with pytest.raises(ValueError):
        pipeline.load(spark, str(tmp_path), "one")


def test_one_row_of_history_is_an_error(spark, fitted):
    with pytest.raises(ValueError):
        pipeline.fit(fitted[0].history.limit(1), SMALL)


def test_evaluation_is_saved_and_recomputed(spark, tmp_path):
    alerts = synthetic.alerts(spark, 160).withColumn("id", F.substring("alert_id", 2, 8).cast("long"))
    more = SMALL | {"novelty": {"baselines": {"enabled": True, "lof_neighbors": 5}}, "classification": {"forest_trees": 5, "logistic_max_iter": 20}, "deduplication": {"thresholds": {"pn_cosine": 0.9}}}
    model = pipeline.train_and_score(alerts, more)[0]
    pipeline.save(model, str(tmp_path), "run")
    tables = evaluation.evaluate(model, alerts)
    evaluation.save_evaluation(tables, str(tmp_path), "run")
    saved = lambda name: spark.read.parquet(str(tmp_path / f"run/evaluation/{name}"))
    assert {r["method"] for r in saved("novelty_metrics").collect()} == {"fingerprint", "vector", "lof", "isolation_forest", "ocsvm"}
    assert max(evaluation.recomputed(spark, str(tmp_path), "run").values()) < 1e-12
    # Both representations in every table, by scope where the test part has known and unseen families.
    for name in ("retrieval_metrics", "cluster_metrics", "classification_metrics", "class_metrics", "class_curves"):
        assert {r["representation"] for r in saved(name).collect()} == {"fingerprint", "vector"}
    scopes = {(r["part"], r["scope"]) for r in saved("classification_metrics").collect()}
    assert {("validation", "all"), ("test", "all"), ("test", "known")} <= scopes <= {("validation", "all"), ("test", "all"), ("test", "known"), ("test", "unseen")}
    n = {(r["part"], r["scope"]): r["n"] for r in saved("classification_metrics").where("representation = 'vector' AND classifier = 'knn'").collect()}
    assert n["test", "all"] == n["test", "known"] + n.get(("test", "unseen"), 0) == saved("splits").where("split = 'test' AND verdict IS NOT NULL").count()
    # Thresholds of a representation, and where they came from.
    assert {(r["representation"], r["threshold"], r["threshold_source"]) for r in saved("cluster_metrics").collect()} == {("fingerprint", 0.75, "fallback"), ("vector", 0.9, "representation")}
    # Another file is refused, also one of as many rows.
    with pytest.raises(ValueError, match="trained on"):
        evaluation.evaluate(model, alerts.withColumn("id", 159 - F.col("id")))
    with pytest.raises(ValueError, match="trained on"):
        evaluation.evaluate(model, alerts.withColumn("hostname", F.concat("hostname", F.lit("x"))))
    with pytest.raises(ValueError):
        pipeline.parted(alerts.withColumn("family", F.lit("vault_export")), model.settings)
    swept = {r["metric"]: r["n"] for r in studies.seed_sweep(alerts, more | {"experiments": {"seeds": [1, 2]}}).collect()}
    assert swept["threshold"] == 2 and studies.latency(model, alerts.limit(3), 2)["samples"] == 2


def test_a_changed_evaluation_is_noticed(spark, fitted, tmp_path):
    """Any table that was changed after it was saved shows up in a number that is not zero."""
    model = fitted[0]
    alerts = synthetic.alerts(spark, 120).withColumn("id", F.substring("alert_id", 2, 8).cast("long"))
    pipeline.save(model, str(tmp_path), "run")
    model.settings["classification"] |= {"forest_trees": 3, "logistic_max_iter": 5}
    changes = {
        "retrieval": (lambda df: df.withColumn("ref", F.when(F.col("rank") == 1, F.lit(10**9)).otherwise(F.col("ref"))), "neighbours outside the history"),
        "novelty": (lambda df: df.withColumn("is_novel", ~F.col("is_novel")), "novelty flags that differ"),
        "classification": (lambda df: df.withColumn("p", F.col("p") / 2), "probabilities that do not sum to one"),
        "clusters": (lambda df: df.withColumn("leader", F.col("leader") + 1), "leaders that come later or lead nothing"),
        "splits": (lambda df: df.withColumn("time", -F.col("time")), "parts out of the order of time"),
        "class_curves": (lambda df: df.withColumn("auroc", F.lit(0.123)), "class_curves"),
    }
    tables = evaluation.evaluate(model, alerts)
    evaluation.save_evaluation(tables | {name: change(tables[name]) for name, (change, _) in changes.items()}, str(tmp_path), "run")
    wrong = evaluation.recomputed(spark, str(tmp_path), "run")
    assert all(wrong[what] > 0 for _, what in changes.values()) and wrong["train rows that are not the history"] == 0


def test_measured_weights_reach_the_units(spark):
    alerts = synthetic.alerts(spark, 100).withColumn("id", F.substring("alert_id", 2, 8).cast("long"))
    edges = spark.createDataFrame([(i % 20, (i * 7) % 30, 1.0 + i % 11) for i in range(140)], "pn long, kc long, w double").dropDuplicates(["pn", "kc"])
    prints = {}
    for mode in ("binary", "synapse", "column_normalized"):
        own = SMALL | {"representation": {"backend": "measured"}, "measured": {"enabled": True, "projection_path": "x", "mode": mode, "top_k": 6}}
        prints[mode] = sorted((r["id"], tuple(r["slots"])) for r in pipeline.fit(alerts, own, edges).prints.collect())
    assert len(set(map(str, prints.values()))) == 3 and all(0 < len(s) <= 6 for p in prints.values() for _, s in p)


def test_only_a_time_and_a_name(spark):
    rows = spark.createDataFrame([(i, f"2026-01-01 00:{i:02d}:00", f"alert {i % 4}x") for i in range(40)], "id long, timestamp string, alert_name string")
    model, scored = pipeline.train_and_score(rows, SMALL)
    assert scored.count() == 6 and model.limit is not None


def test_service(spark, fitted):
    nodes = spark.createDataFrame([(0, "a"), (1, "b")], "node long, class string")
    net = Graph(nodes, spark.createDataFrame([(0, 1, 1.0)], "src long, dst long, p double"))
    server = ThreadingHTTPServer(("127.0.0.1", 0), handler(fitted[0], 0, net))
    port = server.server_address[1]
    threading.Thread(target=server.serve_forever, daemon=True).start()

    def ask(path, body=None, **headers):
        request = urllib.request.Request(f"http://127.0.0.1:{port}{path}", json.dumps(body).encode() if body is not None else None, {"Content-Type": "application/json", **headers})
        try:
            with urllib.request.urlopen(request) as r:
                return r.status, json.loads(r.read())
        except urllib.error.HTTPError as e:
            return e.code, None

    try:
        assert ask("/api/status")[0] == 200
        assert ask("/api/status", Host="evil.example")[0] == 403
        assert ask("/api/status", Origin="http://evil.example")[0] == 403
        assert ask("/../etc/passwd")[0] == 404
        assert len(ask("/api/layout")[1]) == 256 and ask("/api/fly/layout")[0] == 200
        assert ask("/api/graph/node/1")[1]["class"] == "b" and ask("/api/graph/node/7")[0] == 404
        assert ask("/api/graph/scene")[1]["edges"] == [{"src": 0, "dst": 1, "p": 1.0}]
        pulse = ask("/api/graph/pulse", {"class": "a", "steps": 1})[1]["frames"]
        assert [f["mass"] for f in pulse] == pytest.approx([1.0, 0.9]) and ask("/api/graph/pulse", {"class": "a", "steps": 99})[0] == 400
        assert ask("/api/trace", {"alert_name": {"nested": 1}})[0] == 400
        assert ask("/api/trace", {"alert_name": "x" * 70_000})[0] == 413
        code, trace = ask("/api/trace", {"alert_name": "Failed logons", "severity": "__import__('os')"})
        assert code == 200 and trace["alert_id"] == "MANUAL" and {e["kc"] for e in trace["edges"]} == {w["kc"] for w in trace["winners"]}
    finally:
        server.shutdown()


def test_records_are_flat():
    for bad in ([], {}, {"a": [1]}, {"a": "x" * 20_000}):
        with pytest.raises(ValueError):
            flat_record(bad)


def test_sparse_files(spark, tmp_path):
    edges = spark.createDataFrame([(0, 2, 1.5), (2, 0, 2.0)], "row long, col long, w double")
    arrays.write_sparse_npz(edges, str(tmp_path / "m.npz"), (3, 3))
    assert sorted(map(tuple, arrays.read_sparse_npz(spark, str(tmp_path / "m.npz")).collect())) == [(0, 2, 1.5), (2, 0, 2.0)]
    np.savez(tmp_path / "bad.npz", data=np.array([1.0]), indices=np.array([9]), indptr=np.array([0, 1]), shape=np.array([1, 2]))
    with pytest.raises(ValueError):
        arrays.read_sparse_npz(spark, str(tmp_path / "bad.npz"))


def test_graph_files(spark, tmp_path):
    (tmp_path / "n.csv").write_text("root_id,nt_type\n1,a\n2,b\n")
    (tmp_path / "k.csv").write_text("root_id,class,super_class\n1,x,y\n")
    (tmp_path / "p.csv").write_text("root_id,position\n1,[1 2 3]\n1,[1 2 3]\n")
    (tmp_path / "e.csv").write_text("pre_root_id,post_root_id,syn_count\n1,2,3\n1,2,4\n")
    nodes, edges = arrays.graph_tables(spark, *[str(tmp_path / f"{c}.csv") for c in "nkpe"])
    assert nodes.count() == 2 and [tuple(r) for r in edges.collect()] == [(1, 2, 7)]
    (tmp_path / "e.csv").write_text("pre_root_id,post_root_id,syn_count\n1,9,3\n")
    with pytest.raises(ValueError):
        arrays.graph_tables(spark, *[str(tmp_path / f"{c}.csv") for c in "nkpe"])


def test_command_line_trains_without_a_name_and_serves_a_graph(spark, tmp_path, monkeypatch, capsys):
    from quillon import __main__, service

    synthetic.alerts(spark, 100).write.parquet(str(tmp_path / "alerts.parquet"))
    (tmp_path / "settings.json").write_text(json.dumps(SMALL))
    monkeypatch.setattr(__main__.config, "load", lambda path: SMALL)
    __main__.main(["train", str(tmp_path / "alerts.parquet"), str(tmp_path / "runs"), "--settings", "x"])
    run = json.loads(capsys.readouterr().out.strip().splitlines()[-1])["run"]
    assert run.startswith("run-") and (tmp_path / "runs" / run / "manifest").exists()
    spark.createDataFrame([(0, "a"), (1, "b")], "node long, class string").write.parquet(str(tmp_path / "nodes"))
    spark.createDataFrame([(0, 1, 2.0), (0, 1, 1.0)], "src long, dst long, w double").write.parquet(str(tmp_path / "edges"))
    served = []
    monkeypatch.setattr(service, "serve", lambda model, port, net: served.append((model.shape, port, net)))
    __main__.main(["serve", str(tmp_path / "runs"), run, "--nodes", str(tmp_path / "nodes"), "--edges", str(tmp_path / "edges")])
    __main__.main(["serve", str(tmp_path / "runs"), run])
    assert [(shape[1], port) for shape, port, _ in served] == [(256, 8765)] * 2 and served[1][2] is None
    net = served[0][2]
    assert net.node(1)["class"] == "b" and net.scene()["edges"] == [{"src": 0, "dst": 1, "p": 1.0}]
    with pytest.raises(SystemExit):
        __main__.main(["serve", str(tmp_path / "runs"), run, "--nodes", str(tmp_path / "nodes")])
    with pytest.raises(ValueError):
        service.network(spark.read.parquet(str(tmp_path / "nodes")).where("node = 0"), spark.read.parquet(str(tmp_path / "edges")))
