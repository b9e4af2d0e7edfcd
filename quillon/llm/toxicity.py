"""Toxicity: a word classifier with counterfactual regularisation.

The model is a logistic regression over the distinct words of a text and their beginnings of 4 to 6
letters (so that an insult is known in forms that were never labelled; identity terms have none, so that a swap
changes no other feature and none can carry a group's weight). It is fitted on labelled documents
only, on at most ``TRAIN_ROWS`` of them (those with the smallest hash of their id; the bound is a
parameter). In training texts that hold an identity term the term is swapped for the others of its kind,
and the squared change of the score is added to the loss: so the weight of a group's name hardly differs
from its counterparts', and neutral mentions of one group score like those of another.

Plan. The sample is chosen by id from the labels (bounded, so broadcast), and its texts are written to the
shared folder. Words are counted by label in tasks and summed by key; the words that tell the classes
apart best make a vocabulary of at most ``VOCABULARY`` words. The fit runs on the driver over the sample's
word indices. The weights (bounded by the vocabulary) go to every task; scoring reads each text once and
shuffles nothing.

Defined results. A null text counts as empty; an empty text scores the model's base rate. Labelled rows
without a text, with a null label or a null id train nothing; a row that repeats id and label counts once.
Document rows that repeat are scored each; a very long text is one row, read once. Without any training rows every score is the prior rate, 0.05. Extra columns are ignored. Neither labels
nor id, language or source enter a score.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Staged, ship_package, text_or_empty

#: Bounds of the fit: labelled documents, words of the vocabulary; least documents that hold a word.
TRAIN_ROWS, VOCABULARY, LEAST_DOCS = 20_000, 2048, 3
#: Strengths of the three penalties: counterfactual, sum of weights, squared weights.
COUNTERFACTUAL, L1, L2 = 10.0, 5e-5, 1e-6
ROUNDS = 400
#: Kinds of identity terms. Fixed values; any list of lists can be given instead.
IDENTITIES = (
    ("women", "men", "girls", "boys", "mothers", "fathers"),
    ("woman", "man", "girl", "boy", "mother", "father"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist", "catholic", "protestant"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists", "catholics", "protestants"),
    ("black", "white", "asian", "latino", "african", "european", "american", "mexican", "arab", "chinese"),
    ("gay", "lesbian", "straight", "bisexual", "transgender", "queer"),
    ("old", "young", "elderly", "blind", "deaf", "disabled"),
    ("immigrant", "immigrants", "refugee", "refugees", "foreigner", "foreigners", "native", "natives"),
)
#: Lengths of the beginnings of words that are features too.
STEMS = (4, 5, 6)
WORD = regex.compile(r"[\p{L}\p{M}\p{N}_]+")


def terms(identities=IDENTITIES) -> frozenset[str]:
    return frozenset(w for kind in identities for w in kind)


def words(text: str, plain: frozenset[str] = terms()) -> set[str]:
    """A text's features: its distinct words, and the beginnings of them (marked by a stroke) that many inflected forms
    share; of ``plain`` words no beginnings."""
    whole = set(WORD.findall(text.lower()))
    return whole.union(w[:n] + "|" for w in whole - plain for n in STEMS if len(w) > n)


@dataclass
class Model:
    """``bias`` and the weights of words; the score is the logistic of their sum over a text's distinct words."""

    bias: float
    weights: dict[str, float] = field(default_factory=dict)
    plain: frozenset[str] = terms()

    def __post_init__(self) -> None:
        self.heads = {w[: STEMS[0]] for w in self.weights if w.endswith("|")}

    def score(self, text: str) -> float:
        # The features of words(), without those that weigh nothing.
        weights, heads = self.weights, self.heads
        found = set()
        for w in set(WORD.findall(text.lower())):
            if w in weights:
                found.add(w)
            if w[: STEMS[0]] in heads and w not in self.plain:
                found.update(x for n in STEMS if len(w) > n and (x := w[:n] + "|") in weights)
        z = self.bias + sum(weights[w] for w in sorted(found))
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def _rows_of(indices: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(x) for x in indices], np.int64)
    return np.repeat(np.arange(len(indices)), sizes), np.concatenate(indices) if len(indices) else np.zeros(0, np.int64)


def fit(vocabulary: list[str], labels: np.ndarray, indices: list[np.ndarray], identities=IDENTITIES, strength: float = COUNTERFACTUAL) -> Model:
    """Accelerated proximal gradient over the sample; deterministic."""
    n = len(labels)
    prior = (labels.sum() + 0.5) / (n + 10)
    if not n:
        return Model(float(np.log(prior / (1 - prior))), plain=terms(identities))
    row, col = _rows_of(indices)
    place = {w: i for i, w in enumerate(vocabulary)}
    # Counterfactual differences: what a swap adds to and takes from a text's words.
    less, more = [], []
    for kind in identities:
        ids = [place[w] for w in kind if w in place]
        for have in indices:
            own = [i for i in ids if i in have] if len(ids) > 1 and np.isin(have, ids).any() else []
            for i in own:
                for j in ids:
                    if j not in own:
                        less.append(i)
                        more.append(j)
    less_a, more_a = np.array(less, np.int64), np.array(more, np.int64)
    w, bias = np.zeros(len(vocabulary)), float(np.log(prior / (1 - prior)))
    v, vb, t = w.copy(), bias, 1.0
    # Bound of the gradient's slope: rows hold at most `widest` words.
    widest = 1 + max((len(x) for x in indices), default=0)
    mean = np.bincount(row, minlength=n).mean() + 1
    step = 1 / (0.25 * min(widest, 8 * mean) + L2 + strength * 4 * len(less) / n)
    for _ in range(ROUNDS):
        z = vb + np.bincount(row, v[col], minlength=n)
        error = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels
        grad = np.bincount(col, error[row], minlength=len(w)) / n + L2 * v
        if len(less):
            gap = 2 * strength * (v[more_a] - v[less_a]) / n
            grad += np.bincount(more_a, gap, minlength=len(w)) - np.bincount(less_a, gap, minlength=len(w))
        new = v - step * grad
        new = np.sign(new) * np.maximum(np.abs(new) - step * L1, 0)
        new_bias = vb - step * error.mean()
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = new + (t - 1) / nt * (new - w), new_bias + (t - 1) / nt * (new_bias - bias)
        w, bias, t = new, new_bias, nt
    return Model(float(bias), {vocabulary[i]: float(w[i]) for i in np.flatnonzero(w)}, terms(identities))


def _count_words(plain: frozenset[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pos: Counter = Counter()
        neg: Counter = Counter()

        def out():
            names = [*pos.keys() | neg.keys()]
            return pa.record_batch([pa.array(names, pa.string()), pa.array([pos[w] for w in names], pa.int64()), pa.array([neg[w] for w in names], pa.int64())], names=["word", "pos", "neg"])

        for b in batches:
            for label, text in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                (pos if label else neg).update(words(text, plain))
            if len(pos) + len(neg) > 200_000:
                yield out()
                pos.clear()
                neg.clear()
        yield out()

    return run


def _index(vocabulary: list[str], plain: frozenset[str]):
    place = {w: i for i, w in enumerate(vocabulary)}

    def run(batches):
        for b in batches:
            lists = [sorted(place[w] for w in words(t, plain) & place.keys()) for t in b.column(2).to_pylist()]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(lists, pa.list_(pa.int32()))], names=["key", "label", "words"])

    return run


def training_sample(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fold: Column | None = None) -> DataFrame:
    """``key, label, text`` of at most ``rows`` labelled documents for which ``fold`` (a condition on ``key``) holds."""
    ship_package(docs.sparkSession)
    chosen = labels.select(F.col(id_col).alias("key"), F.col(label_col).cast("int").alias("label")).where("key IS NOT NULL AND label IS NOT NULL")
    if fold is not None:
        chosen = chosen.where(fold)
    chosen = chosen.distinct().orderBy(F.xxhash64("key"), "key", "label").limit(rows)
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    return texts.join(F.broadcast(chosen), "key").select("key", "label", "text")


def train(sample: DataFrame, vocabulary_words: int = VOCABULARY, least_docs: int = LEAST_DOCS, identities=IDENTITIES, strength: float = COUNTERFACTUAL) -> Model:
    """The model of a sample ``key, label, text`` that is small enough for the driver (see ``TRAIN_ROWS``)."""
    sizes = {r["label"]: r["n"] for r in sample.groupBy((F.col("label") > 0).cast("int").alias("label")).agg(F.count("*").alias("n")).collect()}
    p, n = float(sizes.get(1, 0)), float(sizes.get(0, 0))
    counts = sample.mapInArrow(_count_words(terms(identities)), "word string, pos long, neg long").groupBy("word").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    # How far a word's share of toxic texts is from the base rate, in standard errors.
    docs, rate = F.col("pos") + F.col("neg"), (p + 1) / (p + n + 2)
    z = F.abs(F.col("pos") - docs * rate) / F.sqrt(docs * rate * (1 - rate) + 1e-9)
    best = counts.where(docs >= least_docs).orderBy(F.desc(F.round(z, 9)), "word").limit(vocabulary_words).select("word").collect()
    vocabulary = sorted({r["word"] for r in best} | terms(identities))
    schema = T.StructType().add("key", sample.schema["key"].dataType).add("label", "integer").add("words", T.ArrayType(T.IntegerType()))
    rows = sample.mapInArrow(_index(vocabulary, terms(identities)), schema).select("key", "label", "words").collect()
    rows.sort(key=lambda r: (r["key"], r["label"], r["words"]))
    labels = np.array([float(r["label"] > 0) for r in rows])
    return fit(vocabulary, labels, [np.array(r["words"], np.int64) for r in rows], identities, strength)


def _score(model: Model, id_type: pa.DataType):
    schema = pa.schema([("key", id_type), ("score", pa.float64())])

    def run(batches):
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([model.score(t) for t in b.column(1).to_pylist()], pa.float64())], schema=schema)

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``key, score`` of every document."""
    ship_package(docs.sparkSession)
    from pyspark.sql.pandas.types import to_arrow_type

    source = docs.select(F.col(id_col).alias("key"), text_or_empty(text_col).alias("text"))
    kind = source.schema["key"].dataType
    return source.mapInArrow(_score(model, to_arrow_type(kind)), T.StructType().add("key", kind).add("score", "double"))


def _keep(model: Model, at: int, limit: float):
    def run(batches):
        for b in batches:
            keep = [t is None or model.score(t) < limit for t in b.column(at).to_pylist()]
            yield b.filter(pa.array(keep, pa.bool_()))

    return run


def reject_toxic(docs: DataFrame, model: Model, text_col: str = "text", limit: float = 0.5) -> DataFrame:
    """The documents that score below ``limit``, with all their columns."""
    ship_package(docs.sparkSession)
    return docs.mapInArrow(_keep(model, docs.columns.index(text_col), limit), docs.schema)


def held_out(key: str = "key", folds: int = 5) -> Column:
    return F.crc32(F.col(key).cast("string")) % folds == 0


def model_of(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Trained on the rows that are not held out."""
    sample = training_sample(docs, labels, rows, fold=~held_out())
    return train(Staged(docs.sparkSession).write(sample, "toxicity-sample"))
