"""The driver's tables in the shapes the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import TEXT_LIMIT
from ..operators import encode, features, search, terms
from ..operators.split import ordinal_values
from ..runtime import Staged, cut, spread
from ..sources import table

#: Widths of the document encoder: inputs, units, inputs a unit, winners.
INPUTS, UNITS, FAN_IN, WINNERS, SEED = 256, 512, 6, 16, 42
#: Terms of the real-valued vectors.
TERMS = 4096
#: Held out of train and validation for the novelty queries.
HELD_OUT_LANG, HELD_OUT_FAMILY = "es", "signup"


def verdict_of(quality, toxic):
    return F.when(toxic == 1, "TRUE_POSITIVE").when(quality == 0, "FALSE_POSITIVE").when(quality.isNotNull(), "BENIGN")


def alerts(spark: SparkSession, d: str, command: bool = False) -> DataFrame:
    """Events as alert rows; with ``command`` each takes a document's text as its command line."""
    docs = table(spark, d, "documents")
    n = docs.count()
    e = spread(table(spark, d, "events")).withColumn("doc_id", F.col("event_id") % n)
    labels = table(spark, d, "labels")
    e = e.join(labels, "doc_id", "left")
    if command:
        e = e.join(docs.select("doc_id", F.col("text").alias("process_command_line")), "doc_id", "left")
    i, u = F.col("event_id"), F.col("user_id")
    text = lambda x: x.cast("string")
    port = F.element_at(F.array(*map(F.lit, (22, 80, 443, 445, 5985))), (i % 5 + 1).cast("int"))
    return e.select(
        F.concat(F.lit("EV"), F.lpad(text(i), 7, "0")).alias("alert_id"), i.alias("seq"), F.col("ts").cast("timestamp").alias("ts"), F.concat("event_type", F.lit(" activity")).alias("alert_name"),
        F.when(F.col("value") < 14.56, "low").when(F.col("value") < 69.14, "medium").otherwise("high").alias("severity"), F.col("event_type").alias("category"), F.col("event_type").alias("family"),
        F.concat(F.lit("host"), text(u % 80)).alias("hostname"), F.concat(F.lit("user"), text(u)).alias("username"), F.concat(F.lit("10.20."), text(u % 8), F.lit("."), text(i % 255)).alias("source_ip"),
        (F.get_json_object("props", "$.k").cast("long") + 49152).alias("source_port"), F.when(i % 7 != 0, port).alias("destination_port"),
        F.element_at(F.array(*map(F.lit, ("detected", "allowed", "blocked"))), (i % 3 + 1).cast("int")).alias("action"), verdict_of(F.col("quality"), F.col("toxic")).alias("verdict"),
        *(["process_command_line"] if command else []),
    )


def with_split(df: DataFrame, key: str) -> DataFrame:
    """Adds ``split`` by the ordinal of a unique whole-number key."""
    n = df.count()
    first, second = ordinal_values(df, F.col(key), [int(n * 0.7), int(n * (0.7 + 0.15))])
    return df.withColumn("split", F.when(F.col(key) < first, "train").when(F.col(key) < second, "validation").otherwise("test"))


def documents(spark: SparkSession, d: str) -> DataFrame:
    """``id, text, family, verdict, split``."""
    docs = spread(table(spark, d, "documents")).join(table(spark, d, "labels"), "doc_id", "left")
    rows = docs.select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("family"), verdict_of(F.col("quality"), F.col("toxic")).alias("verdict"))
    return with_split(rows, "id")


def document_rows(docs: DataFrame, limit: int | None = TEXT_LIMIT) -> DataFrame:
    """``id, slots, values``: hashed tf-idf with document frequencies of the train part, of the documents with any term. Of a text ``limit`` characters count (None: all)."""
    return terms.hashed_rows(docs, "id", F.col("text"), F.col("split") == "train", INPUTS, limit)


def document_vectors(docs: DataFrame) -> DataFrame:
    """``id, pn, v``."""
    return features.unpacked(document_rows(docs))


def document_terms(docs: DataFrame) -> DataFrame:
    """``id, slots, values`` of the documents' tf-idf over the ``TERMS`` most frequent terms of train, cut in the shared folder."""
    train = docs.where("split = 'train'")
    known = features.known_terms(features.term_counts(train, "id", F.col("text")), TERMS, train.count())
    return cut(features.text_rows(docs, "id", F.col("text"), known))


def encoded_documents(docs: DataFrame, limit: int | None = TEXT_LIMIT) -> DataFrame:
    """``id, slots`` of the documents with any term."""
    return encode.encoded_rows(document_rows(docs, limit), encode.random_edges(docs.sparkSession, INPUTS, UNITS, FAN_IN, SEED), INPUTS, UNITS, WINNERS, SEED)


def document_winners(docs: DataFrame) -> DataFrame:
    """``id, kc``."""
    return encoded_documents(docs).select("id", F.explode("slots").alias("kc"))


def document_prints(docs: DataFrame, limit: int | None = TEXT_LIMIT) -> DataFrame:
    """``id, slots, values`` of every document, from a table cut in the shared folder (it is read more than once)."""
    return cut(search.packed_fingerprints(docs, encoded_documents(docs, limit)))


def embedding_vectors(spark: SparkSession, d: str) -> DataFrame:
    """``id, pn, v``: positive parts in the first half of the slots, negative in the second."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.posexplode("embedding").alias("i", "x"))
    width = 64
    x = F.col("x").cast("double")
    return rows.where("x <> 0").select("id", F.when(x > 0, F.col("i")).otherwise(F.col("i") + width).cast("long").alias("pn"), F.floor(F.abs(x) * 1e6 + 0.5).cast("long").alias("v")).where("v > 0")


def embedding_rows(spark: SparkSession, d: str) -> DataFrame:
    """``id, slots, values``: :func:`embedding_vectors` in one row an id."""
    pair = lambda x, i: F.struct(F.when(x > 0, i).otherwise(i + 64).cast("long").alias("pn"), F.floor(F.abs(x.cast("double")) * 1e6 + 0.5).cast("long").alias("v"))
    pairs = F.filter(F.transform("embedding", pair), lambda p: p["v"] > 0)
    rows = spread(table(spark, d, "embeddings")).select(F.col("vec_id").alias("id"), pairs.alias("p"))
    return rows.where(F.size("p") > 0).select("id", F.col("p.pn").alias("slots"), F.col("p.v").alias("values"))


def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    """``src, dst, w``: parts to suppliers (numbered from 1,000,000,000), a row a line item."""
    return table(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), (F.col("l_suppkey") + 1_000_000_000).alias("dst"), F.lit(1).cast("long").alias("w"))


def graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    """``node, class``: parts by brand, suppliers by nation."""
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("node"), F.col("p_brand").alias("class"))
    nation = table(spark, d, "nation").select("n_nationkey", "n_name")
    suppliers = table(spark, d, "supplier").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return parts.unionByName(suppliers.select((F.col("s_suppkey") + 1_000_000_000).alias("node"), F.col("n_name").alias("class")))


def bipartite(spark: SparkSession, d: str) -> DataFrame:
    """``pn, kc, w``: parts to suppliers by quantity."""
    rows = table(spark, d, "lineitem").select(F.col("l_partkey").alias("pn"), F.col("l_suppkey").alias("kc"), F.col("l_quantity").cast("long").alias("w"))
    return rows.where("w >= 1")
