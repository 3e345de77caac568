"""Toxicity categories by a classifier chain.

Categories are predicted one after another. Each has a linear (logistic) model on word features and on the
probabilities of the categories before it. For training, those probabilities are out of fold: documents are dealt into
folds by their id, and a document's probability comes from a model that has not seen its fold, so a later model
learns from inputs as good as those it will meet.

Models are fitted on a sample of about ``max_labelled`` labelled documents. Their features are the words and beginnings
of words whose presence deviates most from independence of a category (chi-square over the sample), ``words`` for each category.
Every document is scored on its whole text, with numpy on Arrow batches. The decision threshold of a category is the
one with the best F1 on the out-of-fold probabilities.

Defined cases: null or empty text has no feature; null labels and labels without document are not used; of repeated
labels the largest counts; a category with one class has its smoothed share as probability for all documents;
repeated rows are scored each; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.llm.bytescan import MARKS, in_small_batches, pieces, since_start, word_bounds, word_codes
from freshet.session import durable


#: bytes of word beginnings
PREFIXES = (4, 5, 6, 7)


@dataclass(frozen=True)
class ChainParams:
    max_labelled: int = 20_000
    words: int = 150
    least_documents: int = 5
    folds: int = 3
    regularization: float = 0.0005


@dataclass
class Link:
    """One category: weights of the word features and of the earlier categories, intercept and threshold."""

    name: str
    weights: np.ndarray
    intercept: float
    threshold: float = 0.5


def _units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code, row) of every word and of the beginnings of longer words, which inflected forms share."""
    starts, ends, rows = word_bounds(data, offsets, MARKS)
    codes, owners = [word_codes(data, starts, ends, MARKS)], [rows]
    if len(starts):
        nth = since_start(len(data), starts)
        for size in PREFIXES:
            longer = ends - starts > size
            cut = np.where(nth < size, data, np.uint8(0x20))
            codes.append(word_codes(cut, starts[longer], starts[longer] + size, MARKS))
            owners.append(rows[longer])
    return np.concatenate(codes), np.concatenate(owners)


def word_features(texts: pa.Array, features: np.ndarray):
    """Yield (first row, row after the last, matrix): log(1 + count) of each of the sorted codes, and of all words / 10."""
    for first, last, data, offsets in pieces(texts):
        codes, rows = _units(data, offsets)
        n = last - first
        found = np.zeros((n, len(features) + 1))
        if len(codes):
            if len(features):
                at = np.minimum(np.searchsorted(features, codes), len(features) - 1)
                hit = features[at] == codes
                flat = rows[hit] * len(features) + at[hit]
                found[:, :-1] = np.bincount(flat, minlength=n * len(features)).reshape(n, -1)
            found[:, -1] = np.bincount(rows, minlength=n)
            np.log1p(found, out=found)
            found[:, -1] /= 10
        yield first, last, found


def _labelled(docs: DataFrame, labels: DataFrame, categories: list[str], params: ChainParams) -> DataFrame:
    """(doc_id, text, categories as 0/1) of about ``max_labelled`` documents."""
    every = max(1, labels.count() // params.max_labelled)
    few = (
        labels.filter("doc_id is not null").filter(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0)
        .groupBy("doc_id").agg(*[F.max(F.col(c).cast("int")).alias(c) for c in categories]).na.drop()
    )
    return docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").dropDuplicates(["doc_id"])


def telling_words(sample: DataFrame, categories: list[str], params: ChainParams) -> np.ndarray:
    """Sorted codes of the words with the largest chi-square for each category."""

    def run(batches):
        for batch in batches:
            for first, last, data, offsets in pieces(batch.column(1)):
                codes, rows = _units(data, offsets)
                both = np.unique(np.stack([rows.astype(np.uint64), codes]), axis=1)
                at = pa.array(both[0].astype(np.int64) + first)
                yield pa.record_batch(
                    [pa.array(both[1].view(np.int64)), *[batch.column(2 + i).take(at) for i in range(len(categories))]],
                    names=["code", *categories],
                )

    schema = "code long, " + ", ".join(f"`{c}` int" for c in categories)
    totals = sample.agg(F.count("*").alias("n"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in categories]).first()
    counts = (
        sample.select("doc_id", "text", *categories).mapInArrow(run, schema)
        .groupBy("code").agg(F.count("*").alias("df"), *[F.sum(c).alias(c) for c in categories])
        .filter(F.col("df") >= params.least_documents)
    )
    found: set[int] = set()
    for c in categories:
        n, positive = totals["n"], totals[c]
        expected = F.col("df") * F.lit(positive / max(n, 1))
        spread = expected * (1 - F.lit(positive / max(n, 1))) * (1 - F.col("df") / F.lit(max(n, 1))) + 1e-9
        score = (F.col(c) - expected) * (F.col(c) - expected) / spread
        found |= {r.code for r in counts.orderBy(F.desc(score), "code").limit(params.words).collect()}
    return np.sort(np.array(sorted(found), dtype=np.int64).view(np.uint64))


def _fit(rows: DataFrame, label: str, params: ChainParams) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic model of ``label`` on the array column ``x``."""
    classes = {int(r[label]): r["count"] for r in rows.groupBy(label).count().collect()}
    if len(classes) < 2:
        share = (classes.get(1, 0) + 0.5) / (sum(classes.values()) + 1)
        return np.zeros(0), float(np.log(share / (1 - share)))
    model = LogisticRegression(
        featuresCol="v", labelCol=label, regParam=params.regularization, maxIter=60, standardization=False
    ).fit(rows.select(label, array_to_vector("x").alias("v")))
    return model.coefficients.toArray(), float(model.intercept)


def _probability(x: np.ndarray, weights: np.ndarray, intercept: float) -> np.ndarray:
    score = (x @ weights if len(weights) else np.zeros(len(x))) + intercept
    return 1 / (1 + np.exp(-np.clip(score, -500, 500)))


def _threshold(p: np.ndarray, y: np.ndarray) -> float:
    """Threshold with the best F1; halfway between neighbouring probabilities."""
    if not len(p) or y.min() == y.max():
        return 0.5
    order = np.argsort(-p)
    p, y = p[order], y[order]
    hits = np.cumsum(y)
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    f1[:-1][p[:-1] == p[1:]] = 0
    best = int(np.argmax(f1))
    return float((p[best] + (p[best + 1] if best + 1 < len(p) else 0.0)) / 2)


def fit_chain(docs: DataFrame, labels: DataFrame, categories: list[str], params: ChainParams = ChainParams()):
    """(word features, links of the chain in the order of ``categories``)."""
    sample = durable(_labelled(in_small_batches(docs), labels, categories, params))
    features = telling_words(sample, categories, params)

    def run(batches):
        for batch in batches:
            for first, last, found in word_features(batch.column(1), features):
                part = batch.slice(first, last - first)
                yield pa.record_batch(
                    [part.column(0), *part.columns[2:], pa.array(list(found), pa.list_(pa.float64()))],
                    names=["doc_id", *categories, "x"],
                )

    schema = "doc_id long, " + ", ".join(f"`{c}` int" for c in categories) + ", x array<double>"
    rows = durable(
        sample.select(F.col("doc_id").cast("long"), "text", *categories).mapInArrow(run, schema)
        .withColumn("fold", F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(params.folds)).cast("int"))
        .repartition(4)  # a bounded sample
    )
    chain = []
    for category in categories:
        parts = []
        for fold in range(params.folds):
            weights, intercept = _fit(rows.filter(F.col("fold") != fold), category, params)

            def predict(batches, weights=weights, intercept=intercept):
                for batch in batches:
                    x = np.array(batch.column("x").to_pylist()).reshape(batch.num_rows, -1)
                    p = _probability(x, weights, intercept)
                    arrays = [*batch.columns, pa.array(p)]
                    yield pa.record_batch(arrays, names=[*batch.schema.names, "p"])

            mine = rows.filter(F.col("fold") == fold)
            names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
            parts.append(mine.mapInArrow(predict, f"{names}, p double"))
        scored = parts[0]
        for part in parts[1:]:
            scored = scored.unionByName(part)
        scored = durable(scored)
        weights, intercept = _fit(rows, category, params)
        told = scored.select("p", category).toPandas()  # the bounded sample
        threshold = _threshold(told["p"].to_numpy(), told[category].to_numpy(dtype=np.int64))
        chain.append(Link(category, weights, intercept, threshold))
        rows = scored.withColumn("x", F.concat("x", F.array("p"))).drop("p")
    return features, chain


def chain_scores(docs: DataFrame, labels: DataFrame, categories: list[str], params: ChainParams = ChainParams()) -> DataFrame:
    """(doc_id, p_<category>, is_<category> ...) of every document of ``docs`` (doc_id, text)."""
    features, chain = fit_chain(docs, labels, categories, params)

    def run(batches):
        for batch in batches:
            for first, last, x in word_features(batch.column(1), features):
                arrays, names = [batch.column(0).slice(first, last - first)], ["doc_id"]
                for link in chain:
                    p = _probability(x, link.weights, link.intercept)
                    arrays += [pa.array(p), pa.array(p >= link.threshold)]
                    names += [f"p_{link.name}", f"is_{link.name}"]
                    x = np.column_stack([x, p])
                yield pa.record_batch(arrays, names=names)

    schema = "doc_id long" + "".join(f", `p_{c}` double, `is_{c}` boolean" for c in categories)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)
