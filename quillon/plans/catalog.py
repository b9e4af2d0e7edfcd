"""Every operator as a query over the driver's tables. Their SQL is in :mod:`quillon.plans.oracle`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import streaming
from ..functions import TEXT_LIMIT, cyclic, port_value, portable_hash, position, valid_port
from ..functions import clean_text as clean
from ..functions import tokens as words
from ..operators import classify, dedup, encode, features, graph, memory, metrics, novelty, one_class, search
from ..operators import split as parts
from ..runtime import cut
from ..sources import files, synthetic, table
from . import evaluation, inspection
from . import fixtures as fx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def r6(c: str):
    return F.round(F.col(c), 6).alias(c)


def rounded(df: DataFrame) -> DataFrame:
    """Real columns to six places, at the output only."""
    return df.select(*[r6(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# --- sources, keys, splits ---------------------------------------------------------------------------


@query
def dup_alert_ids(spark, d):
    rows = fx.alerts(spark, d).select(F.concat("username", F.lit("/"), "category").alias("alert_id"))
    return files.duplicate_keys(rows, "alert_id")


@query
def verdict_normalize(spark, d):
    raw = fx.alerts(spark, d).select(F.concat(F.lit("  "), F.lower("verdict"), F.lit(" ")).alias("v"))
    return raw.groupBy(files.canonical(F.col("v")).alias("verdict")).agg(F.count("*").alias("n"))


def _alert_split(spark, d):
    return parts.chronological_split(fx.alerts(spark, d), F.unix_micros("ts"))


@query
def chrono_split(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    return parts.chronological_split(e, F.unix_micros("ts")).select("event_id", "split")


@query
def chrono_split_ties(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_shipdate").cast("timestamp").alias("t"))
    out = parts.chronological_split(rows, F.unix_micros("t"), 0.65, 0.2)
    return out.groupBy("split").agg(F.count("*").alias("n"), F.unix_date(F.to_date(F.min("t"))).alias("first_day"), F.unix_date(F.to_date(F.max("t"))).alias("last_day"))


@query
def split_summary(spark, d):
    out = parts.split_summary(_alert_split(spark, d), "seq", ["verdict", "family"])
    return out.withColumnRenamed("first_time", "first_seq").withColumnRenamed("last_time", "last_seq")


@query
def heldout_leak(spark, d):
    return parts.held_out_leaks(_alert_split(spark, d), [fx.HELD_OUT_FAMILY])


@query
def unseen_flag(spark, d):
    rows = _alert_split(spark, d)
    train = rows.where((F.col("split") == "train") & (F.col("family") != fx.HELD_OUT_FAMILY))
    return parts.with_unseen(rows, train).groupBy("split", "family", "is_unseen").agg(F.count("*").alias("n"))


@query
def alert_catalog(spark, d):
    rows = _alert_split(spark, d)
    train = rows.where((F.col("split") == "train") & (F.col("family") != fx.HELD_OUT_FAMILY))
    return inspection.catalog(parts.with_unseen(rows, train))


@query
def alert_catalog_filter(spark, d):
    return inspection.filter_catalog(alert_catalog(spark, d), "unseen").select("alert_id", "verdict")


@query
def alert_lookup(spark, d):
    return inspection.lookup(fx.alerts(spark, d), "EV0000007").select("alert_id", "seq", "family", "severity")


@query
def labelled_filter(spark, d):
    rows = fx.alerts(spark, d).where(F.col("verdict").isin("TRUE_POSITIVE", "FALSE_POSITIVE", "BENIGN"))
    return rows.groupBy("verdict").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))


@query
def family_counts(spark, d):
    return fx.alerts(spark, d).groupBy("family").agg(F.count("*").alias("n"))


@query
def verdict_counts(spark, d):
    return fx.alerts(spark, d).groupBy(F.coalesce("verdict", F.lit("UNKNOWN")).alias("verdict")).agg(F.count("*").alias("n"))


@query
def class_codes(spark, d):
    return graph.class_codes(fx.graph_nodes(spark, d))


@query
def regex_class_select(spark, d):
    return inspection.select_classes(table(spark, d, "part"), ["p_name", "p_type"], {"widgets": r"widget\b", "rings": r"\bring\b"}, "p_partkey")


@query
def bipartite_edges(spark, d):
    good = table(spark, d, "part").where(F.col("p_size") <= 25).select(F.col("p_partkey").alias("pn"))
    units = table(spark, d, "supplier").where(F.col("s_acctbal") > 0).select(F.col("s_suppkey").alias("kc"))
    rows = fx.bipartite(spark, d).where("w >= 5")
    return rows.join(good, "pn", "left_semi").join(units, "kc", "left_semi").groupBy("pn", "kc").agg(F.sum("w").alias("w"))


@query
def json_record_normalize(spark, d):
    text = F.concat(F.lit('{"alerts":['), "props", F.lit(',{"k":" ","type":"'), "event_type", F.lit('","user":"'), F.col("user_id").cast("string"), F.lit('"}]}'))
    rows = table(spark, d, "events").select("event_id", F.posexplode(files.records_of(text)).alias("pos", "record"))
    kept = rows.select("event_id", "pos", files.normalised_record(F.col("record")).alias("r"))
    return kept.select("event_id", "pos", F.size("r").alias("fields"), F.try_element_at("r", F.lit("k")).alias("k"), F.try_element_at("r", F.lit("type")).alias("type"))


@query
def synthetic_alerts(spark, d):
    """A generated alert for every event."""
    rows = synthetic.alerts(spark, ids=table(spark, d, "events").select(F.col("event_id").alias("id")))
    return rows.select(F.unix_seconds("timestamp").alias("second"), "alert_id", "alert_name", "severity", "hostname", "username", "source_ip", "source_port", "destination_port", "process_command_line", "action", "verdict", "family", "is_unseen")


# --- text and feature blocks -------------------------------------------------------------------------


@query
def clean_text(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(clean(F.col("text"))).alias("cleaned_md5"))


@query
def tokens_unigram(spark, d):
    t = table(spark, d, "documents").select(F.explode(words(clean(F.col("text")))).alias("token"))
    return t.groupBy("token").agg(F.count("*").alias("n"))


@query
def tokens_bigram(spark, d):
    from ..functions import bigrams

    t = table(spark, d, "documents").select("doc_id", F.explode(bigrams(words(clean(F.col("text"))))).alias("bigram"))
    return t.groupBy("bigram").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


@query
def vocab_topk(spark, d):
    counts = features.term_counts(fx.documents(spark, d).where("split = 'train'"), "id", F.col("text"))
    return features.vocabulary(counts, 2040).select("term", "n", F.col("rank").cast("int").alias("rank"))


@query
def idf_smooth(spark, d):
    train = fx.documents(spark, d).where("split = 'train'")
    return rounded(features.idf(features.term_counts(train, "id", F.col("text")), train.count()))


@query
def tfidf_l2(spark, d):
    return fx.document_vectors(fx.documents(spark, d))


CATEGORY, IDENTITY = ["severity", "category", "action"], ["hostname", "username", "source_ip"]


@query
def categorical_hash(spark, d):
    rows = features.categories(fx.alerts(spark, d), "seq", CATEGORY, IDENTITY)
    return rows.groupBy("token").agg(F.count("*").alias("n"), F.sum("w").alias("w")).select("token", portable_hash(F.col("token"), 2048).alias("slot"), "n", "w")


@query
def categorical_block(spark, d):
    return features.unpacked(features.row_vectors(fx.alerts(spark, d), "seq", features.Blocks(CATEGORY, IDENTITY)))


@query
def port_features(spark, d):
    a = fx.alerts(spark, d)
    src, dst = F.col("source_port").cast("string"), F.col("destination_port").cast("string")
    return rounded(a.select("seq", port_value(src).alias("src"), port_value(dst).alias("dst"), valid_port(src).alias("src_ok"), valid_port(dst).alias("dst_ok")))


@query
def cyclic_time(spark, d):
    a = fx.alerts(spark, d)
    hour, day = cyclic(F.hour("ts"), 24), cyclic(F.weekday("ts"), 7)
    return rounded(a.select("seq", hour[0].alias("hour_sin"), hour[1].alias("hour_cos"), day[0].alias("day_sin"), day[1].alias("day_cos")))


def _alert_vectors(spark, d, text: bool = True):
    a = fx.alerts(spark, d).withColumn("source_port", F.col("source_port").cast("string")).withColumn("destination_port", F.col("destination_port").cast("string"))
    blocks = features.Blocks(CATEGORY, IDENTITY, text_fields=["alert_name"], numbers=("ts", "source_port", "destination_port"))
    if not text:
        return features.row_vectors(a, "seq", blocks)
    counts = features.term_counts(a, "seq", features.text_of(a, ["alert_name"]))
    return features.row_vectors(a, "seq", blocks, features.vocabulary(counts, 2040), features.idf(counts, a.count()))


@query
def pn_vector(spark, d):
    return features.unpacked(_alert_vectors(spark, d))


@query
def ablation_without_text(spark, d):
    return features.unpacked(_alert_vectors(spark, d, False))


def _positions(spark, d):
    xs = [F.format_string("%.4f", F.element_at("embedding", i).cast("double")) for i in (1, 2, 3)]
    return table(spark, d, "embeddings").select("vec_id", F.concat(F.lit("["), F.concat_ws(" ", *xs), F.lit("]")).alias("text"))


@query
def position_parse(spark, d):
    p = _positions(spark, d).select("vec_id", position(F.col("text")).alias("p"))
    return p.select("vec_id", *[F.element_at("p", i + 1).alias(c) for i, c in enumerate("xyz")])


@query
def position_normalize(spark, d):
    return rounded(inspection.normalised_positions(position_parse(spark, d)))


@query
def first_position(spark, d):
    rows = table(spark, d, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey")
    order = Window.partitionBy("l_partkey").orderBy("l_orderkey", "l_linenumber", "l_suppkey")
    return rows.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


# --- encoders ----------------------------------------------------------------------------------------


@query
def projection_edges(spark, d):
    """A drawn projection of as many inputs as there are parts, and as many units as there are orders."""
    inputs, units = (table(spark, d, name).count() for name in ("part", "orders"))
    return encode.random_edges(spark, inputs, units, 8)


@query
def kc_fanin(spark, d):
    edges = projection_edges(spark, d)
    return edges.groupBy("kc").agg(F.count("*").alias("inputs"), F.countDistinct("pn").alias("distinct_inputs")).groupBy("inputs", "distinct_inputs").agg(F.count("*").alias("units"))


@query
def degree_signature(spark, d):
    edges = fx.bipartite(spark, d).select("pn", "kc").distinct()
    return encode.degrees(edges).groupBy("side", "degree").agg(F.count("*").alias("nodes"))


@query
def edge_sample(spark, d):
    return graph.sample(fx.graph_edges(spark, d).select("src", "dst").distinct(), ["src", "dst"], 18_000)


@query
def kc_activation(spark, d):
    v = fx.embedding_vectors(spark, d)
    return encode.activation(v, encode.random_edges(spark, 128, 512, 6))


@query
def fingerprint_embeddings(spark, d):
    return encode.encoded(fx.embedding_vectors(spark, d), encode.random_edges(spark, 128, 512, 6), 128, 512, 16).select("id", F.explode("slots").alias("kc"))


@query
def fingerprint_alerts(spark, d):
    return encode.encoded_rows(_alert_vectors(spark, d), encode.random_edges(spark, 4096, 8192, 8), 4096, 8192, 64).select("id", F.explode("slots").alias("kc"))


@query
def fingerprint_documents(spark, d):
    return fx.document_winners(fx.documents(spark, d))


@query
def empty_fingerprint(spark, d):
    docs = cut(fx.documents(spark, d))
    return docs.select("id").join(fx.encoded_documents(docs).where(F.size("slots") > 0), "id", "left_anti")


@query
def activation_histogram(spark, d):
    return metrics.histogram(kc_activation(spark, d).where("act > 0"), "act")


@query
def sparsity_stats(spark, d):
    docs = fx.documents(spark, d)
    sizes = search.packed_fingerprints(docs, fx.encoded_documents(docs)).select(F.size("slots").cast("long").alias("n_active"))
    return metrics.sparsity(sizes)


def _projection(spark, d, mode):
    return encode.measured_projection(fx.bipartite(spark, d), mode)


@query
def projection_binary(spark, d):
    return _projection(spark, d, "binary")


@query
def projection_synapse(spark, d):
    return _projection(spark, d, "synapse")


@query
def projection_colnorm(spark, d):
    return rounded(_projection(spark, d, "column_normalized"))


def _bridge_act(spark, d):
    n = table(spark, d, "part").count()
    bridge = encode.bridge_edges(spark, 128, n, 2)
    units = fx.bipartite(spark, d).groupBy("pn", "kc").agg(F.sum("w").alias("w"))
    return encode.bridged_activation(encode.bridge(fx.embedding_vectors(spark, d), bridge, 2), bridge, units)


@query
def bridge_activation(spark, d):
    return _bridge_act(spark, d)


@query
def bridge_fingerprint(spark, d):
    bridge = encode.bridge_edges(spark, 128, table(spark, d, "part").count(), 2)
    known = table(spark, d, "supplier").select(F.col("s_suppkey").alias("kc"))
    units = fx.bipartite(spark, d).join(F.broadcast(bridge.select("pn").distinct()), "pn", "left_semi").groupBy("pn", "kc").agg(F.sum("w").alias("w"))
    return encode.bridged_winners(fx.embedding_rows(spark, d), bridge, units.join(known, "kc", "left_semi"), 2, 16)


@query
def effective_connectivity(spark, d):
    n = table(spark, d, "part").count()
    units = fx.bipartite(spark, d).groupBy("pn", "kc").agg(F.sum("w").alias("w"))
    return encode.effective(encode.bridge_edges(spark, 128, n, 2), units)


@query
def rewire_degree_check(spark, d):
    edges = fx.bipartite(spark, d).groupBy("pn", "kc").agg(F.sum("w").alias("w"))
    return encode.degrees(encode.rewire(edges, 0.1).edges)


@query
def rewire_swaps(spark, d):
    """Whether the asked number of swaps was made, most edges stand where none stood, and every degree and weight is what it was."""
    after = encode.rewire(fx.bipartite(spark, d).groupBy("pn", "kc").agg(F.sum("w").alias("w")), 2.0)
    report = encode.rewire_report(after.before, after)
    return report.select("edges", "asked", "completed", (F.col("made") >= F.col("asked")).alias("reached"), (F.col("moved") > 0.5 * F.col("edges")).alias("mostly_moved"), "degrees_kept", "weights_kept")


# --- similarity and retrieval ------------------------------------------------------------------------


def _doc_prints(spark, d, limit=TEXT_LIMIT):
    docs = cut(fx.documents(spark, d))
    return docs, fx.document_prints(docs, limit)


def _parts(docs, prints):
    of = lambda s: prints.join(docs.where(F.col("split") == s).select("id"), "id", "left_semi")
    return of("train"), of("validation"), of("test")


def _pairs(spark, d, metric, least):
    docs, prints = _doc_prints(spark, d)
    train, _, test = _parts(docs, prints)
    return rounded(search.pairs_above(test, train, least, metric, fx.UNITS))


@query
def jaccard_pairs(spark, d):
    return _pairs(spark, d, "jaccard", 0.2)


@query
def binary_cosine_pairs(spark, d):
    return _pairs(spark, d, "cosine", 0.3)


@query
def hamming_pairs(spark, d):
    docs, prints = _doc_prints(spark, d)
    train, _, test = _parts(docs, prints)
    return rounded(search.nearest(test, train, 5, "hamming", fx.UNITS))


def _knn(spark, d, k=10):
    docs, prints = _doc_prints(spark, d)
    train, _, test = _parts(docs, prints)
    return docs, cut(search.nearest(test, train, k, "jaccard", fx.UNITS))


@query
def knn_jaccard(spark, d):
    return rounded(_knn(spark, d)[1])


@query
def knn_cosine(spark, d):
    ids = fx.with_split(table(spark, d, "embeddings").select(F.col("vec_id").alias("id")), "id")
    v = cut(search.packed_vectors(ids, fx.embedding_vectors(spark, d)))
    of = lambda s: v.join(ids.where(F.col("split") == s), "id", "left_semi")
    return rounded(search.nearest(of("test"), of("train"), 10, "dot", 128))


@query
def loo_nearest(spark, d):
    docs, prints = _doc_prints(spark, d)
    train, _, _ = _parts(docs, prints)
    return rounded(search.nearest(train, train, 1, "jaccard", fx.UNITS, skip_self=True).drop("rank"))


@query
def retrieve_with_metadata(spark, d):
    docs, found = _knn(spark, d, 5)
    return rounded(search.retrieve(found, docs.select("id", F.col("family").alias("ref_family"), F.col("verdict").alias("ref_verdict"))))


@query
def retrieval_predictions(spark, d):
    docs, found = _knn(spark, d)
    meta = docs.select("id", F.col("family").alias("ref_family"), F.col("verdict").alias("historical_verdict"))
    own = docs.select(F.col("id").alias("query"), "family")
    rows = search.retrieve(found, meta).join(own, "query")
    return rounded(rows.select("query", "rank", "ref", "similarity", "historical_verdict", (F.col("family") == F.col("ref_family")).alias("same_family")))


@query
def retrieval_metrics(spark, d):
    docs, found = _knn(spark, d)
    fam = docs.select("id", "family")
    rows = found.join(fam.select(F.col("id").alias("query"), "family"), "query").join(fam.select(F.col("id").alias("ref"), F.col("family").alias("rf")), "ref")
    train = docs.where("split = 'train'").groupBy("family").agg(F.count("*").alias("total"))
    relevant = docs.where("split = 'test'").join(train, "family", "left").select(F.col("id").alias("query"), F.coalesce("total", F.lit(0)).alias("total"))
    return rounded(metrics.retrieval(rows.select("query", "rank", (F.col("family") == F.col("rf")).cast("int").alias("rel")), relevant, 10))


@query
def knn_vote(spark, d):
    """Votes of the neighbours by fingerprints of whole texts."""
    docs, prints = _doc_prints(spark, d, None)
    labels = docs.where("verdict IS NOT NULL").select("id", F.col("verdict").alias("label"))
    train, _, test = _parts(docs, prints)
    found = cut(search.nearest(test, train.join(labels, "id", "left_semi"), 5, "cosine", fx.UNITS))
    return rounded(classify.neighbour_votes(found, labels))


# --- novelty -----------------------------------------------------------------------------------------


def _history(spark, d):
    """Documents, the calibrated limit, train and validation without the held-out language, and test."""
    docs, prints = _doc_prints(spark, d)
    train, validation, test = _parts(docs, prints)
    known = docs.where(F.col("family") != fx.HELD_OUT_LANG).select("id")
    train, validation = train.join(known, "id", "left_semi"), validation.join(known, "id", "left_semi")
    loo = search.nearest(train, train, 1, "jaccard", fx.UNITS, skip_self=True).select((1 - F.col("similarity")).alias("distance"))
    return docs, novelty.threshold(loo), train, validation, test


def _novelty(spark, d, part="test"):
    """Documents, and scores of a part against train without the held-out language."""
    docs, limit, train, validation, test = _history(spark, d)
    return docs, cut(novelty.scores(search.nearest(validation if part == "validation" else test, train, 1, "jaccard", fx.UNITS), limit))


@query
def novelty_threshold(spark, d):
    limit = _history(spark, d)[1]
    return spark.createDataFrame([(round(limit, 6),)], "threshold double")


@query
def novelty_scores(spark, d):
    return rounded(_novelty(spark, d)[1])


@query
def validation_flag_rate(spark, d):
    return rounded(novelty.flag_rate(_novelty(spark, d, "validation")[1]))


def _with_truth(spark, d):
    docs, scored = _novelty(spark, d)
    return scored.join(docs.select(F.col("id").alias("query"), (F.col("family") == fx.HELD_OUT_LANG).alias("truth")), "query")


@query
def novelty_metrics(spark, d):
    return rounded(metrics.novelty(_with_truth(spark, d)))


@query
def novelty_auroc(spark, d):
    rows = _with_truth(spark, d).withColumn("score", F.col("novelty"))
    return rounded(metrics.auroc(rows).withColumn("one", F.lit(1)).join(metrics.average_precision(rows).withColumn("one", F.lit(1)), "one").drop("one"))


def _embedding_knn(spark, d, k):
    ids = fx.with_split(table(spark, d, "embeddings").select(F.col("vec_id").alias("id")), "id")
    v = cut(search.packed_vectors(ids, fx.embedding_vectors(spark, d)))
    of = lambda s: v.join(ids.where(F.col("split") == s), "id", "left_semi")
    to = lambda rows: rows.select("query", "ref", "rank", (1 - F.col("similarity")).alias("distance"))
    return to(search.nearest(of("test"), of("train"), k, "dot", 128)), to(search.nearest(of("train"), of("train"), k, "dot", 128, skip_self=True))


@query
def lof_scores(spark, d):
    scored, known = _embedding_knn(spark, d, 35)
    return rounded(novelty.local_outlier_factor(cut(scored), cut(known)))


def _embedding_parts(spark, d):
    rows = fx.with_split(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("x")), "id")
    return rows.where("split = 'train'").select("id", "x"), rows.where("split <> 'train'")


@query
def isolation_forest(spark, d):
    """Scores of what is not train, and flags above the in-sample percentile."""
    train, rest = _embedding_parts(spark, d)
    model = novelty.isolation_forest(train)
    score = lambda rows: novelty.model_scores(rows, model).withColumnRenamed("id", "query")
    return rounded(novelty.flagged(score(rest), score(train)).withColumnRenamed("query", "id"))


@query
def ocsvm_scores(spark, d):
    """Scores of what is not train, and flags above the percentile of validation."""
    train, rest = _embedding_parts(spark, d)
    model = one_class.one_class_svm(train)
    score = lambda rows: model.scores(rows).withColumnRenamed("id", "query")
    return rounded(novelty.flagged(score(rest), score(rest.where("split = 'validation'"))).withColumnRenamed("query", "id"))


# --- dedup -------------------------------------------------------------------------------------------


def _sets(spark, d):
    docs, prints = _doc_prints(spark, d)
    return docs, prints.select("id", F.col("slots").alias("kcs"))


@query
def dedup_leader(spark, d):
    return dedup.leader_clusters(_sets(spark, d)[1], [75]).select("id", "leader")


@query
def dedup_documents(spark, d):
    docs, sets = _sets(spark, d)
    test = sets.join(docs.where("split = 'test'").select("id"), "id", "left_semi")
    return dedup.leader_clusters(test, [50]).groupBy("leader").agg(F.count("*").alias("size"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


@query
def dedup_leader_cosine(spark, d):
    """Exemplars of the documents' tf-idf vectors."""
    return dedup.leader_clusters_cosine(fx.document_terms(fx.documents(spark, d)), [75]).select("id", "leader")


@query
def cosine_links(spark, d):
    """Pairs of documents whose tf-idf vectors have a cosine of 0.75 or more."""
    return rounded(dedup.similar_vectors(fx.document_terms(fx.documents(spark, d)), 75))


def _swept(spark, d):
    docs, sets = _sets(spark, d)
    return dedup.sweep(sets, docs.select("id", "family"))


@query
def dedup_sweep(spark, d):
    return rounded(_swept(spark, d))


@query
def dedup_select(spark, d):
    return rounded(dedup.select_threshold(_swept(spark, d), 0.01))


@query
def dedup_calibrate(spark, d):
    """Fingerprints and their lower half by Jaccard, tf-idf vectors by cosine."""
    docs, sets = _sets(spark, d)
    half = sets.select("id", F.filter("kcs", lambda k: k < fx.UNITS // 2).alias("kcs"))
    rows = {"half": {"jaccard": half}, "whole": {"jaccard": sets}, "vector": {"cosine": fx.document_terms(docs)}}
    out = dedup.calibrate(rows, docs.select("id", "family"), [60, 75], 0.01)
    return rounded(out.select("representation", "metric", "percent", "clusters", "false_merge_rate", "status"))


@query
def threshold_resolve(spark, d):
    calibrated = dedup_calibrate(spark, d).where("status = 'within_budget'").select("representation", (F.col("percent") / 100).alias("threshold"))
    wanted = spark.createDataFrame([("half",), ("vector",), ("whole",), ("other",)], "representation string")
    return dedup.resolve_threshold(calibrated, wanted)


@query
def cluster_metrics(spark, d):
    docs, sets = _sets(spark, d)
    return rounded(dedup.cluster_metrics(dedup.leader_clusters(sets, [75]).join(docs.select("id", "family"), "id")))


# --- classification ----------------------------------------------------------------------------------


def _predicted(spark, d):
    """``actual, predicted, p_toxic`` of labelled test documents by neighbours' votes; the most frequent class without neighbours."""
    docs, prints = _doc_prints(spark, d)
    labels = docs.where("verdict IS NOT NULL").select("id", F.col("verdict").alias("label"))
    train, _, test = _parts(docs, prints)
    test = test.join(labels, "id", "left_semi")
    found = cut(search.nearest(test, train.join(labels, "id", "left_semi"), 5, "cosine", fx.UNITS))
    votes = cut(classify.neighbour_votes(found, labels))
    p = votes.groupBy("query").pivot("label", ["TRUE_POSITIVE", "FALSE_POSITIVE", "BENIGN"]).agg(F.round(F.first("p"), 9))
    rows = classify.best_class(votes).join(p, "query").join(labels.select(F.col("id").alias("query"), F.col("label").alias("actual")), "query")
    return rows.na.fill(0.0, ["TRUE_POSITIVE", "FALSE_POSITIVE", "BENIGN"])


@query
def confusion(spark, d):
    return metrics.confusion(_predicted(spark, d))


@query
def class_report(spark, d):
    return rounded(metrics.class_report(metrics.confusion(_predicted(spark, d))))


@query
def macro_report(spark, d):
    return rounded(metrics.macro_report(metrics.class_report(metrics.confusion(_predicted(spark, d)))))


@query
def verdict_scopes(spark, d):
    """Neighbours' verdicts by both representations: for all test rows, those of languages that train knows, and those of the held-out one."""
    docs = cut(fx.documents(spark, d))
    labels = docs.where("verdict IS NOT NULL").select("id", F.col("verdict").alias("label"))
    unseen = F.col("family") == fx.HELD_OUT_LANG
    known = docs.where((F.col("split") == "train") & ~unseen).select("id").join(labels, "id", "left_semi")
    asked = docs.where("split = 'test'").select("id").join(labels, "id", "left_semi")
    out = None
    for name, rows, metric, width in (("fingerprint", fx.document_prints(docs), "cosine", fx.UNITS), ("vector", fx.document_terms(docs), "dot", fx.TERMS)):
        found = cut(search.nearest(rows.join(asked, "id", "left_semi"), rows.join(known, "id", "left_semi"), 5, metric, width))
        best = classify.best_class(classify.neighbour_votes(found, labels)).withColumn("representation", F.lit(name))
        out = best if out is None else out.unionByName(best)
    truth = docs.select(F.col("id").alias("query"), F.col("verdict").alias("actual"), unseen.alias("is_unseen"))
    by = ("representation", "scope")
    cells = evaluation.by_scope(out.join(truth, "query"), by[:1], ("actual", "predicted"))
    return rounded(metrics.macro_report(metrics.class_report(metrics.confusion(cells, by=by, weight="n"), by), by))


def _one_vs_rest(spark, d):
    names = ["TRUE_POSITIVE", "FALSE_POSITIVE", "BENIGN"]
    return _predicted(spark, d).select(F.explode(F.array(*[F.struct(F.lit(n).alias("label"), F.col(n).alias("score"), (F.col("actual") == n).cast("int").alias("truth")) for n in names])).alias("x")).select("x.*")


@query
def ovr_auc(spark, d):
    return rounded(metrics.auroc(_one_vs_rest(spark, d), by=("label",)))


@query
def ovr_ap(spark, d):
    return rounded(metrics.average_precision(_one_vs_rest(spark, d), by=("label",)))


def _learned(spark, d, learner):
    docs, prints = _doc_prints(spark, d)
    labels = docs.where("verdict IS NOT NULL").select("id", F.col("verdict").alias("label"))
    train, _, test = _parts(docs, prints)
    return rounded(learner(train.join(labels, "id"), test, fx.UNITS))


@query
def logreg_verdict(spark, d):
    return _learned(spark, d, classify.logistic)


@query
def forest_verdict(spark, d):
    return _learned(spark, d, classify.forest)


def _turns(spark, d):
    turns = table(spark, d, "conversations")
    slots = F.array_sort(F.array_distinct(F.transform(words(clean(F.col("text"))), lambda t: portable_hash(t, 512))))
    # A learner for every 16 conversations, so there are more of them where the table is larger.
    learner = F.concat(F.lit("g"), F.expr("conv_id div 16").cast("string"))
    return turns.select(learner.alias("learner"), (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), slots.alias("slots"), F.col("role").alias("label"))


REWARDS = {"user": 1.0, "assistant": 1.0, "system": 0.0}


@query
def online_readout(spark, d):
    return rounded(classify.online_readout(_turns(spark, d), sorted(REWARDS), REWARDS).drop("before", "after", "note"))


@query
def online_reason_counts(spark, d):
    return online_readout(spark, d).groupBy("learner", "label", "reason").agg(F.count("*").alias("n"))


@query
def user_sessions(spark, d):
    """Sessions of a user's events at most half an hour apart."""
    events = table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("t"))
    out = streaming.session_counts(events, "t", "user_id")
    return out.select("user_id", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end"), "n")


# --- graph -------------------------------------------------------------------------------------------


@query
def graph_adjacency(spark, d):
    return graph.adjacency(fx.graph_edges(spark, d))


@query
def graph_transition(spark, d):
    return rounded(graph.transition(graph_adjacency(spark, d)))


@query
def graph_summary(spark, d):
    adj = graph_adjacency(spark, d)
    return adj.agg(F.count("*").alias("pairs"), F.sum("w").alias("total"), F.countDistinct("src").alias("sources"), F.countDistinct("dst").alias("targets"))


@query
def edge_endpoint_check(spark, d):
    return graph.missing_endpoints(fx.graph_edges(spark, d), fx.graph_nodes(spark, d).where("class <> 'Brand#2'"))


@query
def node_attributes(spark, d):
    degree = graph_adjacency(spark, d).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("targets"), F.sum("w").alias("weight"))
    return fx.graph_nodes(spark, d).join(degree, "node", "left").select("node", "class", F.coalesce("targets", F.lit(0)).alias("targets"), F.coalesce("weight", F.lit(0)).alias("weight"))


@query
def node_lookup(spark, d):
    return fx.graph_nodes(spark, d).where("node = 17")


def _pulse(spark, d, steps):
    p = cut(graph.transition(graph_adjacency(spark, d)))
    return graph.diffuse(p, graph.pulse(fx.graph_nodes(spark, d), "Brand#2"), steps)


@query
def diffusion_1(spark, d):
    return rounded(_pulse(spark, d, 1))


@query
def diffusion_3(spark, d):
    return rounded(_pulse(spark, d, 3))


@query
def pulse_frame(spark, d):
    return rounded(graph.frame_summary(_pulse(spark, d, 3)))


@query
def pulse_top(spark, d):
    rows = _pulse(spark, d, 3).select("node", r6("a"))
    return graph.strongest(rows, 8)


@query
def mass_decay(spark, d):
    p = cut(graph.transition(graph_adjacency(spark, d)))
    state, out = graph.pulse(fx.graph_nodes(spark, d), "Brand#2"), None
    for step in range(4):
        row = state.agg(F.sum("a").alias("mass")).select(F.lit(step).alias("step"), r6("mass"))
        out = row if out is None else out.unionByName(row)
        state = graph.diffuse(p, state, 1)
    return out


# --- memory, inspection ------------------------------------------------------------------------------


def _feedback(spark, d):
    n = table(spark, d, "documents").count()
    e = table(spark, d, "events").where(F.col("event_type").isin("click", "error"))
    return e.select(F.col("event_id").alias("seq"), (F.col("event_id") % n).alias("id"), F.when(F.col("event_type") == "error", "TRUE_POSITIVE").otherwise("BENIGN").alias("verdict"))


@query
def memory_append(spark, d):
    docs = fx.documents(spark, d).drop("text")
    history, new = docs.where("split <> 'test'"), docs.where("split = 'test'").drop("verdict")
    return memory.append(history, new).groupBy("split", "verdict").agg(F.count("*").alias("n"))


@query
def feedback_current(spark, d):
    return memory.current(fx.documents(spark, d), _feedback(spark, d))


@query
def feedback_audit(spark, d):
    return memory.audit(fx.documents(spark, d), _feedback(spark, d))


@query
def trace_pn(spark, d):
    docs = fx.documents(spark, d)
    return fx.document_vectors(docs).where("id = 17")


@query
def trace_edges(spark, d):
    docs = fx.documents(spark, d)
    vectors = cut(fx.document_vectors(docs).where("id = 17"))
    edges = encode.random_edges(spark, fx.INPUTS, fx.UNITS, fx.FAN_IN, fx.SEED)
    won = encode.winners(encode.activation(vectors, edges), encode.tie_order(spark, fx.UNITS, fx.SEED), fx.WINNERS)
    return inspection.contributing(vectors, edges, won)


@query
def inspect(spark, d):
    _, limit, train, _, test = _history(spark, d)
    found = search.nearest(test, train, 5, "jaccard", fx.UNITS)
    return rounded(inspection.inspect(test, cut(found), limit))


@query
def seed_summary(spark, d):
    docs, prints = _doc_prints(spark, d)
    sizes = prints.select("id", F.size("slots").alias("n")).join(docs.select("id", "family"), "id")
    return rounded(metrics.by_seed(sizes, "family", "n"))
