"""Hand-computed results of the operators."""

from __future__ import annotations

import dataclasses

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon import config
from quillon.functions import clean_text, position, softmax, tokens
from quillon.operators import classify, dedup, encode, features, graph, memory, metrics, novelty, one_class, search
from quillon.operators import split as parts
from quillon.sources import files, synthetic


def prints(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in s], [1.0] * len(s)) for i, s in rows], "id long, s array<double>, values array<double>").select("id", F.col("s").cast("array<bigint>").alias("slots"), "values")


def flat(spark, rows):
    return spark.createDataFrame([(i, x) for i, s in rows for x in s], "id long, kc long")


def test_similarities(spark):
    a, b = flat(spark, [(0, [0, 1])]), flat(spark, [(1, [0, 2])])
    row = search.overlaps(a, b).select(*[search.similarity(m, F.col("shared"), F.col("na"), F.col("nb"), 4).alias(m) for m in search.METRICS]).first()
    assert row["jaccard"] == pytest.approx(1 / 3) and row["cosine"] == pytest.approx(0.5) and row["hamming"] == pytest.approx(0.5)


def test_nearest_ties_padding_and_self(spark):
    refs = prints(spark, [(0, [1, 2]), (1, [1, 2]), (2, [3]), (3, [])])
    got = {(r["query"], r["rank"]): (r["ref"], r["similarity"]) for r in search.nearest(refs, refs, 10, "jaccard", 8, skip_self=True).collect()}
    assert got[0, 1] == (1, 1.0) and got[1, 1] == (0, 1.0) and got[2, 1] == (0, 0.0) and got[3, 1] == (0, 0.0)
    assert max(k for _, k in got) == 3


def test_nearest_without_references(spark):
    some = prints(spark, [(0, [1])])
    assert search.nearest(some, some.limit(0), 3, "jaccard", 8).count() == 0


def test_novelty_threshold_is_linear_percentile_and_flag_is_strict(spark):
    two = prints(spark, [(0, [0, 1]), (1, [0, 2])])
    loo = search.nearest(two, two, 1, "jaccard", 4, skip_self=True).select((1 - F.col("similarity")).alias("distance"))
    limit = novelty.threshold(loo)
    assert limit == pytest.approx(2 / 3)
    new = prints(spark, [(5, [3]), (6, [0, 1])])
    got = {r["query"]: (r["novelty"], r["is_novel"]) for r in novelty.scores(search.nearest(new, two, 1, "jaccard", 4), limit).collect()}
    assert got == {5: (1.0, True), 6: (0.0, False)}


def test_leader_clusters_follow_row_order(spark):
    sets = spark.createDataFrame([(0, [0, 1]), (1, [0, 1]), (2, [2]), (3, []), (4, [])], "id long, kcs array<bigint>")
    got = {r["id"]: r["leader"] for r in dedup.leader_clusters(sets, [75]).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 3, 4: 4}


@pytest.mark.parametrize("percent", [34, 50, 75])
def test_leader_clusters_equal_the_sequential_rule(spark, percent):
    rng = np.random.default_rng(percent)
    rows = [(i, sorted(set(rng.integers(0, 12, rng.integers(0, 6)).tolist()))) for i in range(80)]
    heads, want = [], {}
    for i, s in rows:
        near = [(len(set(s) & set(h)) / len(set(s) | set(h)), -j) for j, h in heads if s and 100 * len(set(s) & set(h)) >= percent * len(set(s) | set(h))]
        want[i] = -max(near)[1] if near else i
        if not near and s:
            heads.append((i, s))
    got = {r["id"]: r["leader"] for r in dedup.leader_clusters(spark.createDataFrame(rows, "id long, kcs array<bigint>"), [percent]).collect()}
    assert got == want


def test_cluster_metrics(spark):
    rows = spark.createDataFrame([(0, "a"), (0, "a"), (0, "b"), (1, "c")], "leader long, family string")
    r = dedup.cluster_metrics(rows).first()
    assert (r["purity"], r["reduction"]) == (0.75, 0.5) and r["false_merge_rate"] == pytest.approx(2 / 3)


def test_retrieval_metrics(spark):
    found = spark.createDataFrame([(0, 1, 1), (0, 2, 0), (0, 3, 1), (1, 1, 0), (1, 2, 0), (1, 3, 0)], "query long, rank int, rel int")
    r = metrics.retrieval(found, spark.createDataFrame([(0, 2), (1, 0)], "query long, total long"), 3).first()
    assert r["precision"] == pytest.approx(2 / 3) and r["recall"] == 1 and r["map"] == pytest.approx((1 + 2 / 3) / 2) and (r["queries"], r["excluded"]) == (1, 1)


def test_novelty_metrics(spark):
    rows = spark.createDataFrame([(0.1, False, False), (0.8, True, False), (0.7, False, True), (0.9, True, True)], "novelty double, is_novel boolean, truth boolean")
    r = metrics.novelty(rows).first()
    assert (r["tpr"], r["fpr"]) == (0.5, 0.5)
    assert metrics.auroc(rows, "novelty").first()["auroc"] == 0.75
    assert metrics.auroc(rows.where("truth"), "novelty").first()["auroc"] is None


def test_confusion_covers_the_grid_and_undefined_is_zero(spark):
    grid = metrics.confusion(spark.createDataFrame([("a", "a"), ("b", "a")], "actual string, predicted string"))
    assert grid.count() == 4
    r = {x["label"]: x for x in metrics.class_report(grid).collect()}
    assert r["b"]["precision"] == 0 and r["a"]["recall"] == 1


def test_diffusion_golden(spark):
    p = spark.createDataFrame([(0, 1, 1.0), (1, 2, 0.5)], "src long, dst long, p double")
    state = spark.createDataFrame([(0, 1.0)], "node long, a double")
    one = {r["node"]: r["a"] for r in graph.diffuse(p, state, 1).collect()}
    two = {r["node"]: r["a"] for r in graph.diffuse(p, state, 2).collect()}
    assert one == pytest.approx({0: 0.18, 1: 0.72}) and two == pytest.approx({0: 0.0324, 1: 0.2592, 2: 0.2592})


def test_graph_checks(spark):
    with pytest.raises(ValueError):
        graph.adjacency(spark.createDataFrame([(0, 1, 0)], "src long, dst long, w long"))
    for w in (2.0, -1.0):
        with pytest.raises(ValueError):
            graph.check_transition(spark.createDataFrame([(0, 0, w)], "src long, dst long, p double"))


def test_winners_are_positive_distinct_and_at_most_k(spark):
    v = spark.createDataFrame([(i, j, 1) for i in range(9) for j in range(20)], "id long, pn long, v long")
    edges = encode.random_edges(spark, 20, 40, 4)
    assert edges.groupBy("kc").count().where("count <> 4").count() == 0
    found = encode.encoded(v, edges, 20, 40, 5)
    assert {tuple(sorted(r["slots"])) for r in found.collect()}.__len__() == 1
    empty = search.packed_fingerprints(spark.createDataFrame([(99,)], "id long"), found.where("id = 99")).first()
    assert list(empty["slots"]) == []
    # The joined form, with and without weights, gives the same winners.
    mixed = spark.createDataFrame([(i, (i * 7 + j * 3) % 20, 1 + (i * j) % 9) for i in range(30) for j in range(6)], "id long, pn long, v long").groupBy("id", "pn").agg(F.sum("v").alias("v"))
    weighted = edges.withColumn("w", 1 + F.pmod(F.col("pn") * 3 + F.col("kc"), F.lit(5)) / 4.0)
    for table, weight in ((edges, None), (weighted, "w")):
        joined = encode.winners(encode.activation(mixed, table, weight), encode.tie_order(spark, 40), 5)
        want = {r["id"]: sorted(r["kcs"]) for r in joined.groupBy("id").agg(F.collect_list("kc").alias("kcs")).collect()}
        assert {r["id"]: r["slots"] for r in encode.encoded(mixed, table, 20, 40, 5, weight=weight).collect()} == want
    for bad in (-1, None):
        with pytest.raises(Exception, match="nonnegative"):
            encode.encoded(spark.createDataFrame([(0, 1, bad)], "id long, pn long, v long"), edges, 20, 40, 5).collect()
    with pytest.raises(ValueError):
        encode.random_edges(spark, 3, 4, 5)
    with pytest.raises(ValueError):
        encode.check_vectors(spark.createDataFrame([(0, 1, -1)], "id long, pn long, v long"), 20)


@pytest.mark.parametrize("swaps", [0.0, 0.4])
def test_rewire_keeps_degrees_and_makes_the_swaps(spark, swaps):
    edges = spark.createDataFrame([(i, j, float(i * 20 + j)) for i in range(20) for j in range(15) if (i * 7 + j * j) % 4 == 0], "pn long, kc long, w double")
    out = encode.rewire(edges, swaps)
    assert sorted(map(tuple, encode.degrees(out.edges).collect())) == sorted(map(tuple, encode.degrees(edges).collect()))
    assert out.edges.select("pn", "kc").distinct().count() == edges.count()
    # Weights stay with the side they came from.
    assert sorted((r["pn"], r["w"]) for r in out.edges.collect()) == sorted((r["pn"], r["w"]) for r in edges.collect())
    assert out.completed and out.asked == round(swaps * edges.count()) and (out.edges.exceptAll(edges).count() > 0) == (swaps > 0)
    again = encode.rewire(edges.repartition(7), swaps).edges
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, out.edges.collect()))


def test_rewire_makes_many_swaps_in_few_turns_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(encode, "BLOCK", 100)
    edges = spark.createDataFrame([(i, (i * 13 + j * j * 7) % 90, float(i + j)) for i in range(90) for j in range(8)], "pn long, kc long, w double").dropDuplicates(["pn", "kc"])
    out = encode.rewire(edges, 2.0)
    # Each turn shuffles and writes all edges.
    assert out.completed and out.rounds <= 4
    report = encode.rewire_report(out.before, out).first()
    assert report["degrees_kept"] and report["weights_kept"] and report["moved"] > report["edges"] / 2
    assert out.edges.select("pn", "kc").distinct().count() == edges.count()
    assert sorted(map(tuple, encode.rewire(edges.repartition(5), 2.0).edges.collect())) == sorted(map(tuple, out.edges.collect()))
    # The report tells what is lost: a weight, a degree of either side.
    for wrong, lost in (("pn, kc, w + 1 AS w", (True, False)), ("pn, kc + 1 AS kc, w", (False, True)), ("pn + 1 AS pn, kc, w", (False, False))):
        told = encode.rewire_report(out.before, dataclasses.replace(out, edges=out.edges.selectExpr(*wrong.split(", ")))).first()
        assert (told["degrees_kept"], told["weights_kept"]) == lost


def test_rewire_leaves_edges_without_an_end_and_takes_names(spark):
    rows = [(f"p{i}", f"k{(i * 7 + j * j) % 20}", i) for i in range(20) for j in range(4)] + [(None, "k1", 5), ("p1", None, None)]
    edges = spark.createDataFrame(rows, "pn string, kc string, w long").dropDuplicates(["pn", "kc"])
    out = encode.rewire(edges, 0.5)
    assert out.completed and sorted(map(str, encode.degrees(out.edges).collect())) == sorted(map(str, encode.degrees(edges).collect()))
    assert {(None, "k1", 5), ("p1", None, None)} <= set(map(tuple, out.edges.collect()))


def test_rewire_ends_where_nothing_can_be_swapped(spark):
    full = spark.createDataFrame([(i, j, 1.0) for i in range(4) for j in range(3)], "pn long, kc long, w double")
    out = encode.rewire(full, 1.0)
    assert (out.made, out.completed, out.rounds) == (0, False, 2) and sorted(map(tuple, out.edges.collect())) == sorted(map(tuple, full.collect()))
    for wrong in (-1.0, float("inf"), float("nan")):
        with pytest.raises(ValueError):
            encode.rewire(full, wrong)
    with pytest.raises(ValueError):
        encode.rewire(full.limit(1), 1.0)


def test_split(spark):
    rows = spark.createDataFrame([(i, i // 3) for i in range(30)], "id long, t long")
    out = parts.chronological_split(rows, F.col("t"), 0.65, 0.2).groupBy("t").agg(F.countDistinct("split").alias("n"))
    assert out.where("n > 1").count() == 0
    for bad in (rows.limit(5), rows.withColumn("t", F.when(F.col("id") > 3, F.col("t"))), rows.withColumn("t", F.lit(1))):
        with pytest.raises(ValueError):
            parts.chronological_split(bad, F.col("t"))


def test_text_functions(spark):
    df = spark.createDataFrame([("Logon from 10.0.0.1 with DEADBEEFDEADBEEF01 port 443 été_x",), (None,)], "t string")
    got = [r[0] for r in df.select(tokens(clean_text(F.col("t")))).collect()]
    assert got == [["logon", "from", "ipaddr", "with", "hexvalue", "port", "num"], []]


def test_positions_are_parsed_never_evaluated(spark):
    df = spark.createDataFrame([("[1 2 3]",), ("__import__('os')",), ("[nan 1 2]",), ("[1 2]",), (None,)], "t string")
    assert [r[0] for r in df.select(position(F.col("t"))).collect()] == [[1.0, 2.0, 3.0], None, None, None, None]


def test_softmax_of_large_scores(spark):
    assert spark.range(1).select(softmax(F.array(F.lit(1000.0), F.lit(1000.0)))).first()[0] == [0.5, 0.5]


def test_features_do_not_see_labels_and_keep_width(spark):
    df = spark.createDataFrame([(i, f"host{i}", "x") for i in range(1000)], "id long, hostname string, verdict string")
    block = features.category_block(features.categories(df, "id", ["hostname"]), 64)
    assert block.select("id").distinct().count() == 1000 and block.agg(F.max("pn")).first()[0] < 64
    other = features.category_block(features.categories(df.withColumn("verdict", F.lit("y")), "id", ["hostname"]), 64)
    assert sorted(map(tuple, block.collect())) == sorted(map(tuple, other.collect()))


def test_history_append_and_feedback(spark):
    base = spark.createDataFrame([(1, "BENIGN"), (2, None)], "id long, verdict string")
    with pytest.raises(ValueError):
        memory.append(base, base.limit(1))
    assert memory.append(base, spark.createDataFrame([(3,)], "id long")).count() == 3
    events = spark.createDataFrame([(1, 1, "TRUE_POSITIVE"), (2, 1, "UNKNOWN")], "seq long, id long, verdict string")
    assert {r["id"]: r["verdict"] for r in memory.current(base, events).collect()} == {1: "UNKNOWN", 2: None}
    assert [(r["previous"], r["verdict"]) for r in memory.audit(base, events).orderBy("seq").collect()] == [("BENIGN", "TRUE_POSITIVE"), ("TRUE_POSITIVE", "UNKNOWN")]
    for bad in ((1, 1, "MAYBE"), (1, 9, "BENIGN")):
        with pytest.raises(ValueError):
            memory.check_feedback(spark.createDataFrame([bad], events.schema), base)


def test_readout_learns_its_label_and_records_everything():
    r = classify.Readout(["A", "B"], {"A": 1.0, "B": 0.0}, rate=0.5)
    before = r.probabilities([0, 2])[0]
    assert [r.learn([0, 2], "A")[2] for _ in range(10)] == ["applied"] * 10
    assert r.probabilities([0, 2])[0] > before and r.updates == 10
    assert r.learn([], "A")[2] == "empty" and r.learn([1], "B")[2] == "no_reward" and r.seen == 12
    tight = classify.Readout(["A", "B"], {"A": 1.0, "B": 1.0}, rate=1.0, clip=0.01)
    assert tight.learn([0], "A")[3] == 4
    with pytest.raises(ValueError):
        classify.Readout(["A", "B"], {"A": 1.0})


def test_votes_at_distance_zero_outvote_the_rest(spark):
    found = spark.createDataFrame([(0, 1, 1.0), (0, 2, 0.5)], "query long, ref long, similarity double")
    labels = spark.createDataFrame([(1, "x"), (2, "y")], "id long, label string")
    assert {r["label"]: r["p"] for r in classify.neighbour_votes(found, labels).collect()} == {"x": 1.0, "y": 0.0}


def test_isolation_forest_and_one_class_svm_rank_an_outlier_first(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 4))
    far = np.vstack([x[:5], np.full((1, 4), 9.0)])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    forest = novelty.isolation_forest(rows, 50, 64)
    assert forest.score(far).argmax() == 5 and all(t[0, 4] == 64 for t in forest.trees)
    tested = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(far)], "id long, x array<double>")
    assert one_class.one_class_svm(rows, 0.05).scores(tested).orderBy(F.desc("score")).first()["id"] == 5


def test_settings():
    assert config.check(config.DEFAULTS) == []
    for change in ({"expansion": {"top_k": 0}}, {"features": {"text_fields": ["verdict"]}}, {"evaluation": {"train_ratio": 0.9}}, {"representation": {"backend": "measured"}}, {"features": {"ablation": {"disabled_fields": ["nope"]}}}, {"experiments": {"seeds": [1, 1]}}):
        assert config.check(config.with_defaults(change))
    published = config.with_defaults({"flyhash": {"kc_dim": 9000}, "mbon": {"weight_clip": 2.0}, "representation": {"backend": "flyhash"}})
    assert published["expansion"]["kc_dim"] == 9000 and published["readout"]["weight_clip"] == 2.0 and config.check(published) == []
    for unknown in ({"expansion": {"kc_dims": 1}}, {"extra": 1}, {"seed": {"a": 1}}):
        with pytest.raises(ValueError):
            config.with_defaults(unknown)


def test_readout_against_a_second_account_of_its_rule(spark):
    rng = np.random.default_rng(1)
    steps = [(i, sorted(set(rng.integers(0, 12, rng.integers(0, 5)).tolist())), "ABC"[rng.integers(3)]) for i in range(60)]
    rewards, rate, decay, clip = {"A": 1.0, "B": 0.5, "C": 0.0}, 0.5, 0.1, 0.4
    w, b, want = np.zeros((12, 3)), np.zeros(3), []
    for seq, slots, label in steps:
        z = w[slots].sum(0) + b
        p = np.exp(z) / np.exp(z).sum()
        reason = "empty" if not slots else "no_reward" if rewards[label] == 0 else "applied"
        if reason == "applied":
            error = np.eye(3)["ABC".index(label)] - p
            w *= 1 - decay
            w[slots] += rate * rewards[label] / len(slots) * error
            b += 0.05 * rate * rewards[label] * error
            w, b = w.clip(-clip, clip), b.clip(-clip, clip)
        want.append((seq, reason, pytest.approx(p["ABC".index(label)])))
    rows = spark.createDataFrame([("one", *s) for s in steps], "learner string, seq long, slots array<long>, label string")
    got = classify.online_readout(rows, ["A", "B", "C"], rewards, rate, decay, clip).orderBy("seq").collect()
    assert [(r["seq"], r["reason"], r["p_label"]) for r in got] == want
    learner = classify.Readout(["A", "B", "C"], rewards, rate, decay, clip)
    for _, slots, label in steps:
        learner.learn(slots, label)
    asked = spark.createDataFrame([(0, [1, 5]), (1, [])], "id long, slots array<long>")
    p = {(r["query"], r["label"]): r["p"] for r in classify.readout_scores(asked, classify.readout_weights(spark, learner), dict(zip("ABC", learner.bias.tolist()))).collect()}
    for i, slots in ((0, [1, 5]), (1, [])):
        assert [p[i, c] for c in "ABC"] == pytest.approx(learner.probabilities(slots).tolist())


def test_forest_scores_by_walking_each_tree(spark):
    x = np.random.default_rng(2).normal(size=(200, 3))
    forest = novelty.isolation_forest(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>"), 20, 32)
    c = lambda n: 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n if n > 2 else float(n == 2)

    def path(tree, row, at=0):
        f, cut, left, right, size = tree[at]
        return c(size) if f < 0 else 1 + path(tree, row, int(left if row[int(f)] < cut else right))

    want = [2 ** (-np.mean([path(t, row) for t in forest.trees]) / c(32)) for row in x[:20]]
    assert forest.score(x[:20]).tolist() == pytest.approx(want)


@pytest.mark.parametrize(("n", "nu", "working"), [(150, 0.1, 1000), (700, 0.3, 16), (20_000, 0.01, 1000), (5, 0.01, 1000), (4, 1.0, 2)])
def test_one_class_svm_meets_its_conditions(spark, monkeypatch, n, nu, working):
    """Over all rows: weights within their bounds and of sum one, and gradients on the right side of the offset."""
    monkeypatch.setattr(one_class, "WORKING_ROWS", working)
    if n == 700:  # the support is summed block by block
        monkeypatch.setattr(one_class, "SUPPORT_BYTES", 2000)
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(size=(n - n // 10, 3)), rng.normal(3, 0.2, (n // 10, 3))])
    rows = spark.createDataFrame([(i * 5, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    model = one_class.one_class_svm(rows, nu)
    top, weight = 1 / max(1, nu * n), {r["id"]: r["a"] for r in model.support.collect()}
    assert model.gap <= 1e-6 and sum(weight.values()) == pytest.approx(1) and max(weight.values()) <= top * (1 + 1e-9)
    score = {r["id"]: r["score"] for r in model.scores(rows).collect()}
    assert len(score) == n and model.gamma == pytest.approx(1 / (3 * x.var()))
    # Scores by brute force.
    support = x[np.array(sorted(weight)) // 5]
    ids = rng.choice(n, min(n, 50), replace=False)
    want = model.rho - one_class.rbf(x[ids], support, model.gamma) @ np.array([weight[i] for i in sorted(weight)])
    assert [score[5 * i] for i in ids.tolist()] == pytest.approx(want.tolist(), abs=1e-9)
    for i, s in score.items():
        a = weight.get(i, 0.0)
        assert s < 1e-5 if a == 0 else s > -1e-5 if a > top * (1 - 1e-9) else abs(s) < 1e-5
    assert np.mean([s > 1e-5 for s in score.values()]) <= max(nu, 1 / n) and len(weight) >= int(nu * n)


def test_one_class_svm_refuses(spark):
    rows = spark.createDataFrame([(1, [1.0])], "id long, x array<double>")
    with pytest.raises(ValueError):
        one_class.one_class_svm(rows, 0)
    with pytest.raises(ValueError):
        one_class.one_class_svm(rows.limit(0))


def test_logistic_regression_is_at_its_optimum(spark):
    rng = np.random.default_rng(4)
    rows = [(i, sorted(set(rng.integers(0, 8, 3).tolist()))) for i in range(120)]
    labels = ["x" if 0 in s or rng.random() < 0.2 else "y" if 1 in s else "z" for _, s in rows]
    df = spark.createDataFrame([(i, s, [1.0] * len(s), y) for (i, s), y in zip(rows, labels)], "id long, slots array<long>, values array<double>, label string")
    p = classify.logistic(df, df.drop("label"), 8, rounds=500)
    got = {(r["query"], r["label"]): r["p"] for r in p.collect()}
    # The biases carry no penalty, so at the optimum the mean probability of a class is its share.
    for c in "xyz":
        assert np.mean([got[i, c] for i, _ in rows]) == pytest.approx(labels.count(c) / len(labels), abs=1e-3)


def test_imports(spark):
    found = files.import_records(spark, "a.csv", "\ufeffname,cmd\r\nx,\"a \"\"b\"\", c\"\r\n\r\ny,\n")
    assert [dict(r["record"]) for r in found.orderBy("pos").collect()] == [{"name": "x", "cmd": 'a "b", c'}, {"name": "y"}]
    assert files.selected(found, 1) == {"alert_id": "MANUAL", "name": "y"}
    assert files.import_records(spark, "a.json", '{"alerts": [{"k": "1"}, {"k": "2"}]}').count() == 2
    for name, text in (("a.csv", "a,a\n1,2"), ("a.csv", ""), ("a.json", "[]"), ("a.json", str([{"k": "1"}] * 1001).replace("'", '"'))):
        with pytest.raises(ValueError):
            files.import_records(spark, name, text)
    with pytest.raises(ValueError):
        files.selected(found, 7)


def test_rewiring_is_reported_and_projections_stored(spark, tmp_path):
    edges = spark.createDataFrame([(i, j, 1.0) for i in range(12) for j in range(12) if (i * 5 + j) % 3 == 0], "pn long, kc long, w double")
    report = encode.rewire_report(edges, encode.rewire(edges, 0.25)).first()
    assert report["degrees_kept"] and report["weights_kept"] and report["completed"] and report["moved"] > 0 and report["made"] >= report["asked"] == round(report["edges"] / 4)
    encode.save_projection(edges, str(tmp_path / "p"))
    assert encode.stored_projection(spark, str(tmp_path / "p")).count() == edges.count()
    edges.limit(1).write.mode("append").parquet(str(tmp_path / "p"))
    with pytest.raises(ValueError):
        encode.stored_projection(spark, str(tmp_path / "p"))


def test_pairs_above_a_limit_equal_all_pairs(spark):
    rng = np.random.default_rng(6)
    sets = [(i, sorted(set(rng.integers(0, 10, rng.integers(0, 6)).tolist()))) for i in range(40)]
    df = spark.createDataFrame([(i, s, [1.0] * len(s)) for i, s in sets], "id long, slots array<long>, values array<double>")
    got = {(r["a"], r["b"]) for r in search.pairs_above(df, df, 0.4, "jaccard", 10).collect()}
    assert got == {(i, j) for i, a in sets for j, b in sets if a and b and len(set(a) & set(b)) / len(set(a) | set(b)) >= 0.4}
    with pytest.raises(Exception, match="ones only"):
        search.nearest(df.withColumn("values", F.transform("values", lambda v: v + 1)), df, 1, "jaccard", 10).collect()


def test_delimited_files(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("name\tverdict\nx\t benign \ny\tNA\n")
    rows = files.read_alerts(spark, str(tmp_path / "a.tsv")).orderBy("alert_id").collect()
    assert [(r["alert_id"], r["verdict"]) for r in rows] == [("ROW0000000", "BENIGN"), ("ROW0000001", None)]
    (tmp_path / "b.csv").write_text('alert_id,cmd\n007,"a ""quoted"" cmd, with comma"\n007,x\n')
    assert files.read_delimited(spark, str(tmp_path / "b.csv")).first()["alert_id"] == "007"
    for name, text in (("b.csv", None), ("c.csv", "alert_id\n"), ("d.txt", "x")):
        if text is not None:
            (tmp_path / name).write_text(text)
        with pytest.raises(ValueError):
            files.read_alerts(spark, str(tmp_path / name))


def test_columns_by_alias():
    assert files.choose_column(["Body ID", "type"], ["bodyid"], "id") == "Body ID"
    for cols in (["x"], ["Body ID", "body_id"]):
        with pytest.raises(ValueError):
            files.choose_column(cols, ["bodyid"], "id")


def test_runs_are_written_once_with_strict_manifests(spark, tmp_path):
    files.write_run({"t": spark.range(3).toDF("id")}, str(tmp_path), "run-1", {"x": float("nan"), "n": np.int64(3)})
    assert files.read_run(spark, str(tmp_path), "run-1")["x"] is None
    with pytest.raises(ValueError):
        files.safe_name("../up")
    assert '"a":null' in files.strict_json(spark.sql("SELECT double('NaN') AS a")).first()["json"]


def test_generator_holds_a_family_out(spark):
    df = synthetic.alerts(spark, 300)
    first = df.where("is_unseen").agg(F.min("alert_id")).first()[0]
    assert first is not None and first >= "Q00000255"
    assert df.where("family = 'vault_export'").count() == df.where("is_unseen").count()


def test_projections_are_verified(spark, tmp_path):
    edges = spark.createDataFrame([(0, 1, 1.0), (2, 1, 0.5)], "pn long, kc long, w double")
    path, digest = str(tmp_path / "p"), encode.projection_digest(edges)
    assert encode.load_projection(spark, path, 2, digest, required=False) is None
    with pytest.raises(FileNotFoundError):
        encode.load_projection(spark, path, 2, digest)
    edges.write.parquet(path)
    assert encode.load_projection(spark, path, 2, digest).count() == 2
    for rows, d in ((3, digest), (2, "0" * 32)):
        with pytest.raises(ValueError):
            encode.load_projection(spark, path, rows, d)


def test_measured_modes(spark):
    edges = spark.createDataFrame([(0, 0, 1), (0, 0, 2), (1, 0, 1)], "pn long, kc long, w long")
    got = {m: {r["pn"]: r["w"] for r in encode.measured_projection(edges, m).collect()} for m in ("binary", "synapse", "column_normalized")}
    assert got == {"binary": {0: 1.0, 1: 1.0}, "synapse": {0: 3.0, 1: 1.0}, "column_normalized": {0: 0.75, 1: 0.25}}
    with pytest.raises(ValueError):
        encode.measured_projection(edges, "other")


def vectors_brute(rows, least):
    """All pairs of a cosine of at least ``least``, and the similarities of all."""
    m = np.zeros((len(rows), 1 + max((s for _, slots, _ in rows for s in slots), default=0)))
    for i, (_, slots, values) in enumerate(rows):
        m[i, slots] = values
    size = np.sqrt((m * m).sum(1))
    scale = size[:, None] * size[None, :]
    cosine = np.divide(m @ m.T, scale, out=np.zeros_like(scale), where=scale > 0)
    ids = [r[0] for r in rows]
    return {(ids[a], ids[b]): cosine[a, b] for a in range(len(rows)) for b in range(len(rows)) if ids[a] < ids[b] and cosine[a, b] >= least}, cosine


def made_vectors(seed, n=160, signed=True):
    """Near copies of a few vectors, scaled copies, equal rows, rows of one slot, rows without values and negative values."""
    rng = np.random.default_rng(seed)
    roots = [(np.sort(rng.choice(400, 25, replace=False)), rng.integers(1, 1000, 25)) for _ in range(12)]
    rows = []
    for i in range(n):
        slots, values = roots[rng.integers(len(roots))]
        kind = rng.integers(8)
        if kind == 0:
            slots, values = np.array([], int), np.array([], int)
        elif kind == 1:
            slots, values = slots[:1], values[:1]
        elif kind == 2:
            values = values * 3
        elif kind < 7:
            keep = rng.random(len(slots)) < 0.9
            extra = np.setdiff1d(rng.integers(0, 400, 4), slots)
            slots = np.concatenate([slots[keep], extra])
            values = np.concatenate([values[keep] + rng.integers(0, 200, keep.sum()), rng.integers(1, 600, len(extra))])
            if signed:
                values = values * rng.choice([1, 1, 1, -1], len(values))
            by = np.argsort(slots)
            slots, values = slots[by], values[by]
        rows.append((i * 3 + 7, slots.tolist(), values.astype(float).tolist()))
    return rows


VECTOR = "id long, slots array<bigint>, values array<double>"


@pytest.mark.parametrize("percent", [30, 75, 95, 100])
def test_similar_vectors_equal_all_pairs(spark, percent):
    rows = made_vectors(percent)
    want, _ = vectors_brute(rows, percent / 100)
    got = {(r["early"], r["late"]): r["similarity"] for r in dedup.similar_vectors(spark.createDataFrame(rows, VECTOR), percent).collect()}
    # Pairs that sit on the limit up to the last bit may fall on either side of it.
    sure, _ = vectors_brute(rows, percent / 100 + 1e-12)
    assert set(sure) <= set(got) and all(s >= percent / 100 - 1e-12 for s in got.values())
    assert all(got[p] == pytest.approx(want[p], abs=1e-12) for p in set(got) & set(want)) and (percent == 100 or set(got) == set(want))
    if percent == 75:
        assert want


def test_candidates_are_far_fewer_than_all_pairs(spark):
    rows = made_vectors(5, 400, signed=False)
    frame = spark.createDataFrame(rows, VECTOR)
    pairs, links = len(rows) * (len(rows) - 1) // 2, len(vectors_brute(rows, 0.9)[0])
    candidates = dedup.vector_candidates(frame, 90).count()
    assert links <= candidates < pairs / 5 and dedup.vector_candidates(frame.limit(0), 90).count() == 0


def sequential(ids, similarity, least):
    """The rule as it reads: a walk in row order."""
    heads, out = [], {}
    for i, key in enumerate(ids):
        near = max(((similarity[i, h], -n) for n, h in enumerate(heads)), default=(-1, 0))
        if near[0] >= least:
            out[key] = ids[heads[-near[1]]]
        else:
            heads.append(i)
            out[key] = key
    return out


def test_cosine_leaders_equal_the_sequential_rule(spark):
    rows = made_vectors(9, 200, signed=False)
    _, cosine = vectors_brute(rows, 0)
    # Equal vectors are one class; elsewhere no similarity lies on a limit.
    cosine = np.where(cosine > 1 - 1e-12, 1.0, cosine)
    frame = spark.createDataFrame(rows, VECTOR)
    percents = [60, 75, 90]
    got = {}
    for r in dedup.leader_clusters_cosine(frame, percents).collect():
        got.setdefault(r["percent"], {})[r["id"]] = r["leader"]
    for p in percents:
        assert got[p] == sequential([r[0] for r in rows], cosine, p / 100)


def test_all_fifty_thresholds(spark):
    """Clusters and their metrics at every default threshold, by a walk in row order."""
    rng = np.random.default_rng(2)
    roots = [rng.choice(60, 16, replace=False) for _ in range(9)]
    rows = []
    for i in range(120):
        root = roots[rng.integers(9)]
        rows.append((i, sorted({int(x) if rng.random() < 0.85 else int(rng.integers(60)) for x in root})))
    m = np.zeros((120, 60))
    for i, s in rows:
        m[i, s] = 1
    shared = m @ m.T
    jaccard = shared / (m.sum(1)[:, None] + m.sum(1)[None, :] - shared)
    families = [("a", "b", "c")[i % 3] for i in range(120)]
    swept = {r["percent"]: r for r in dedup.sweep(spark.createDataFrame(rows, "id long, kcs array<bigint>"), spark.createDataFrame(list(enumerate(families)), "id long, family string")).collect()}
    assert sorted(swept) == list(range(50, 100))
    for p, row in swept.items():
        groups = {}
        for i, leader in sequential(list(range(120)), jaccard, p / 100).items():
            groups.setdefault(leader, []).append(families[i])
        pairs = sum(len(g) * (len(g) - 1) // 2 for g in groups.values())
        false = pairs - sum(g.count(f) * (g.count(f) - 1) // 2 for g in groups.values() for f in "abc")
        assert (row["clusters"], row["pairs"], row["false_pairs"]) == (len(groups), pairs, false)
        assert row["reduction"] == pytest.approx(1 - len(groups) / 120)


def test_calibration_is_by_representation_and_metric(spark):
    sets = spark.createDataFrame([(0, [1, 2, 3, 4]), (1, [1, 2, 3, 5]), (2, [9])], "id long, kcs array<bigint>")
    rows = spark.createDataFrame([(0, [1], [5.0]), (1, [1], [7.0]), (2, [1, 2], [3.0, 4.0])], VECTOR)
    families = spark.createDataFrame([(0, "a"), (1, "a"), (2, "b")], "id long, family string")
    out = dedup.calibrate({"print": {"jaccard": sets}, "vector": {"cosine": rows}}, families, [50, 60, 90], 0.0)
    got = {(r["representation"], r["metric"]): (r["percent"], r["clusters"], r["status"]) for r in out.collect()}
    # Three of five shared: together at 0.6. Parallel vectors are together at any threshold, the third (cosine 0.6) only up to 0.6.
    assert got == {("print", "jaccard"): (60, 2, "within_budget"), ("vector", "cosine"): (90, 2, "within_budget")}
    for wrong, budget in (({}, 0.1), ({"x": {}}, 0.1), ({"x": {"dot": sets}}, 0.1), ({"x": {"jaccard": sets}}, 1.5)):
        with pytest.raises(ValueError):
            dedup.calibrate(wrong, families, [50], budget)


@pytest.mark.parametrize(("metric", "k"), [("jaccard", 7), ("dot", 5), ("hamming", 400)])
def test_nearest_over_several_blocks(spark, monkeypatch, metric, k):
    """Blocks and dense pieces much smaller than the input, ties everywhere."""
    for name, value in (("BLOCK_BYTES", 6000), ("QUERY_ROWS", 7), ("REFERENCE_ROWS", 11)):
        monkeypatch.setattr(search, name, value)
    rng = np.random.default_rng(3)
    m = (rng.random((150, 12)) < 0.3).astype(float) * (rng.integers(1, 4, (150, 12)) if metric == "dot" else 1)
    rows = spark.createDataFrame([(i, np.flatnonzero(r).tolist(), r[r > 0].tolist()) for i, r in enumerate(m)], VECTOR)
    some = rows.where("id % 3 = 0")
    want = search._block_scores(m, m, metric, 12)
    got = {(r["query"], r["rank"]): (r["ref"], r["similarity"]) for r in search.nearest(some, rows, k, metric, 12, skip_self=True).collect()}
    for q in range(0, 150, 3):
        order = sorted((r for r in range(150) if r != q), key=lambda r: (-np.clip(want[q, r], 0, 1), r))[:k]
        assert [got[q, n + 1] for n in range(len(order))] == [(r, pytest.approx(np.clip(want[q, r], 0, 1))) for r in order]
    assert len(got) == 50 * min(k, 149)


@pytest.mark.parametrize("ranges", [1, 4, 256])
def test_curves_equal_all_pairs_of_scores(spark, monkeypatch, ranges):
    """Areas by comparing every positive with every negative, precision by walking down the scores; groups, ties, null keys, one class."""
    monkeypatch.setattr(metrics, "RANGES", ranges)
    rng = np.random.default_rng(ranges)
    rows = [(g, float(rng.integers(0, 40)) / 7 - 2, int(rng.random() < 0.3)) for g in ("a", "b", None) for _ in range(300)] + [("one", 0.5, 1), ("one", 0.7, 1), ("none", 0.1, 0)]
    frame = spark.createDataFrame(rows, "g string, score double, truth int")

    def brute(some):
        pos, neg = [s for s, t in some if t], [s for s, t in some if not t]
        if not pos or not neg:
            return None, None
        area = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg)
        ap, tp, n = 0.0, 0, 0
        for s in sorted({s for s, _ in some}, reverse=True):
            step = pos.count(s)
            tp, n = tp + step, n + step + neg.count(s)
            ap += step * tp / n
        return area, ap / len(pos)

    got = {r["g"]: (r["auroc"], r["ap"]) for r in metrics.curves(frame, by=("g",)).collect()}
    want = {g: brute([(s, t) for x, s, t in rows if x == g]) for g in {r[0] for r in rows}}
    assert got.keys() == want.keys() and all(got[g] == pytest.approx(want[g]) if want[g][0] is not None else got[g] == want[g] for g in want)
    row = metrics.curves(frame).first()
    assert (row["auroc"], row["ap"]) == pytest.approx(brute([(s, t) for _, s, t in rows]))
    assert metrics.auroc(frame.limit(0), by=("g",)).collect() == []
    plan = metrics.auroc(frame)._jdf.queryExecution().executedPlan().toString()
    assert "Window [" not in plan or "hashpartitioning(__range" in plan


def test_too_many_labels_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(metrics, "MOST_LABELS", 2)
    with pytest.raises(ValueError):
        metrics.confusion(spark.createDataFrame([("a", "b"), ("c", "a")], "actual string, predicted string"))


def test_row_vectors_equal_assembled_blocks_and_need_no_exchange(spark):
    """F31 to F33: vectors were brought together by id in three exchanges, whose tasks grew with the table."""
    rows = [(i, f"Host{i % 7}" if i % 5 else None, ("alpha beta beta", "gamma, alpha 10.0.0.1", "", None)[i % 4], str(i * 7919 % 70000) if i % 3 else "x", f"2024-01-0{i % 9 + 1} 0{i % 10}:00:00" if i % 6 else None) for i in range(200)]
    rows.append((200, None, None, None, None))
    df = spark.createDataFrame(rows, "id long, hostname string, name string, port string, at string").repartition(5)
    counts = features.term_counts(df, "id", features.text_of(df, ["name"]))
    idf, vocab = features.idf(counts, df.count()), features.vocabulary(counts, 5)
    token_block = features.category_block(features.categories(df, "id", ["hostname"], ["port"], 0.4), 16, 0.6)
    parts = [(token_block, 0), (features.vocabulary_text(features.tf_weights(counts, idf), vocab), 16), (features.numeric_block(df, "id", "at", "port", None, 0.3), 21)]
    blocks = features.Blocks(["hostname"], ["port"], 0.4, 16, 0.6, ["name"], ("at", "port", None), 21, 0.3)
    made = features.row_vectors(df, "id", blocks, vocab, idf)
    assert sorted(map(tuple, features.unpacked(made).collect())) == sorted(map(tuple, features.assembled(parts).collect()))
    alone = features.row_vectors(df, "id", features.Blocks(["hostname"], ["port"], 0.4, 16, 0.6))
    assert sorted(map(tuple, features.unpacked(alone).collect())) == sorted(map(tuple, token_block.collect()))
    edges = encode.random_edges(spark, 29, 64, 4)
    whole = encode.encoded(features.unpacked(made), edges, 29, 64, 8)
    found = encode.encoded_rows(made, edges, 29, 64, 8)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, whole.collect()))
    source = spark.read.schema(df.schema).parquet(_written(df))
    plan = encode.encoded_rows(features.row_vectors(source, "id", blocks, vocab, idf), edges, 29, 64, 8)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    wrong = made.withColumn("values", F.transform("values", lambda v: -v))
    with pytest.raises(Exception, match="nonnegative"):
        encode.encoded_rows(wrong, edges, 29, 64, 8).collect()


def _written(df):
    import tempfile

    path = tempfile.mkdtemp(prefix="quillon-test-") + "/rows"
    df.write.parquet(path)
    return path


def test_one_class_svm_needs_few_rounds_where_most_rows_have_weight(spark, monkeypatch):
    """vectors without clusters took a round for every few rows, hundreds of them on 7,179 rows."""
    monkeypatch.setattr(one_class, "WORKING_ROWS", 40)
    x = np.random.default_rng(8).normal(size=(400, 32))
    x /= np.sqrt((x * x).sum(1))[:, None]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    model = one_class.one_class_svm(rows, 0.02, rounds=8)
    weight = {r["id"]: r["a"] for r in model.support.collect()}
    a = np.array([weight.get(i, 0.0) for i in range(400)])
    g = one_class.rbf(x, x, model.gamma) @ a
    assert model.gap <= 1e-6 and a.sum() == pytest.approx(1) and 0 <= a.min() and a.max() <= 1 / 8 * (1 + 1e-9) and len(weight) > 100
    assert g[a > 0].max() - g[a < 1 / 8].min() <= 1.1e-6
