"""Toxicity of documents by a chain of linear classifiers.

Features are the words of a text and their beginnings, hashed; a feature is there or not. The chain
predicts its categories one after the other; each model also sees the probabilities of the categories
before it. In training those come from folds that did not see the row, as they will in use.

The label table knows one category, `toxic`. Two degrees of it come first in the chain, read off the
labelled texts by the terms that only toxic ones use: `repeated` (three or more such terms) and
`dense` (one or more in a hundred words). The terms of a fold come from the rows outside of it. At most
`MAX_LABELLED` labelled documents are used.

Features of the sample are counted by Spark, by fold and label. Only those that tell toxic texts from
others, or are terms, come to the driver: a chain has no use for the rest.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from delayfold.llm import arrays
from delayfold.llm.quality import labelled_sample
from delayfold.llm.tables import stored, text_flag

MAX_LABELLED = 12_000
CATEGORIES = ["repeated", "dense", "toxic"]
_SPACE_BITS = 20
_PREFIXES = (4, 6)
_FOLDS = 5
# A feature tells two kinds of rows apart if it is in so many rows, and so many standard errors off.
_LEAST_ROWS = 3
_LEAST_ERRORS = 4.0

_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True


def _hits(chunk: arrays.Chunk, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number and feature of every word and beginning of a word, and words of each text."""
    data = arrays.ascii_lower(chunk.data)
    blanked = np.where(_WORD[data], data, np.uint8(0x20))
    words = arrays.split_words(blanked, chunk.offsets)
    hashes, doc = arrays.RangeHash(blanked), words.doc
    length = words.ends - words.starts
    owners, found = [], []
    for size in (0, *_PREFIXES):
        take = np.flatnonzero(length > size) if size else np.arange(len(doc))
        ends = words.starts[take] + size if size else words.ends
        feature = hashes(words.starts[take], ends) ^ np.uint64(size)
        feature = (arrays.mix(feature) >> np.uint64(64 - _SPACE_BITS)).astype(np.int64)
        keep = np.ones(len(take), bool) if wanted is None else wanted[feature]
        owners.append(doc[take][keep])
        found.append(feature[keep])
    return np.concatenate(owners), np.concatenate(found), words.counts


def _distinct(owner: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique((owner << _SPACE_BITS) | feature)
    return both >> _SPACE_BITS, both & ((1 << _SPACE_BITS) - 1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _telling(owner: np.ndarray, feature: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Features whose share differs between the two kinds of rows."""
    size = 1 << _SPACE_BITS
    positive = np.bincount(feature, y[owner], size)
    both = np.bincount(feature, minlength=size)
    n, share = len(y), both / len(y)
    expected = share * y.sum()
    error = np.sqrt(np.maximum(expected * (1 - share) * (1 - y.sum() / n), 1e-9))
    return np.flatnonzero((np.abs(positive - expected) >= _LEAST_ERRORS * error) & (both >= _LEAST_ROWS))


def _terms(owner: np.ndarray, feature: np.ndarray, toxic: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Whether a feature is in enough toxic texts, and in no other text, among `rows`."""
    size = 1 << _SPACE_BITS
    inside = rows[owner]
    y, found = toxic[owner[inside]], feature[inside]
    return (np.bincount(found, y, size) >= _LEAST_ROWS) & (np.bincount(found, 1 - y, size) == 0)


@dataclass
class Linear:
    features: np.ndarray
    weights: np.ndarray
    earlier: np.ndarray
    bias: float

    def margin(self, owner: np.ndarray, feature: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        table = np.zeros(1 << _SPACE_BITS)
        table[self.features] = self.weights
        linear = np.bincount(owner, table[feature], len(earlier))
        return linear + earlier @ self.earlier + self.bias


def _fit(
    owner: np.ndarray, feature: np.ndarray, earlier: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 300
) -> Linear:
    """Logistic regression with an L2 penalty, by Adam over all rows, each with its weight."""
    chosen = _telling(owner, feature, y)
    place = np.full(1 << _SPACE_BITS, -1)
    place[chosen] = np.arange(len(chosen))
    inside = place[feature] >= 0
    row, column = owner[inside], place[feature[inside]]
    size, n = len(chosen), max(1e-9, weight.sum())
    w = np.zeros(size + earlier.shape[1] + 1)
    first, second = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        margin = np.bincount(row, w[:size][column], len(y)) + earlier @ w[size:-1] + w[-1]
        off = weight * (_sigmoid(margin) - y) / n
        gradient = np.concatenate([np.bincount(column, off[row], size), off @ earlier, [off.sum()]])
        gradient[:-1] += 1e-4 * w[:-1]
        first = 0.9 * first + 0.1 * gradient
        second = 0.99 * second + 0.01 * gradient**2
        w -= 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return Linear(chosen, w[:size], w[size:-1], float(w[-1]))


@dataclass
class Chain:
    categories: list[str]
    links: list[Linear]
    threshold: float

    def probabilities(self, owner: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
        earlier = np.zeros((n, 0))
        for link in self.links:
            p = _sigmoid(link.margin(owner, feature, earlier))
            earlier = np.column_stack([earlier, p])
        return earlier

    def wanted(self) -> np.ndarray:
        table = np.zeros(1 << _SPACE_BITS, bool)
        for link in self.links:
            table[link.features] = True
        return table


def _rows_of(owner: np.ndarray, feature: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    number = np.cumsum(keep) - 1
    inside = keep[owner]
    return number[owner[inside]], feature[inside]


def train_chain(
    owner: np.ndarray,
    feature: np.ndarray,
    labels: dict[str, np.ndarray],
    fold: np.ndarray,
    weight: np.ndarray | None = None,
) -> Chain:
    """A chain over the categories in order of `labels`; the last one's threshold is the best by F1 on
    probabilities out of fold. Rows count by `weight`, in the models and in F1.

    A category has one label for each row, or a table of them: one line for each fold, told without its
    rows, and a last line told from all rows.
    """
    n = len(fold)
    weight = np.ones(n) if weight is None else weight
    earlier, links = np.zeros((n, 0)), []
    outside = np.zeros(n)
    for told in labels.values():
        told = np.broadcast_to(told, (_FOLDS + 1, n))
        y = told[-1]
        for k in range(_FOLDS):
            held = fold == k
            if not held.any() or held.all():
                continue
            model = _fit(*_rows_of(owner, feature, ~held), earlier[~held], told[k][~held], weight[~held])
            outside[held] = _sigmoid(model.margin(*_rows_of(owner, feature, held), earlier[held]))
        links.append(_fit(owner, feature, earlier, y, weight))
        earlier = np.column_stack([earlier, outside])
    levels = np.linspace(0.2, 0.9, 36)
    f1 = [
        2 * weight[(outside >= t) & (y > 0)].sum() / max(1, weight[outside >= t].sum() + (weight * y).sum())
        for t in levels
    ]
    best = np.flatnonzero(np.array(f1) == max(f1))
    return Chain(list(labels), links, float(levels[best[len(best) // 2]]))


_SAMPLE = "doc_id long, label long, weight double, fold int, n_words long, features array<int>"


def _sampled_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for chunk in arrays.text_chunks(batches):
        owner, feature, words = _hits(chunk)
        owner, feature = _distinct(owner, feature)
        bounds = np.searchsorted(owner, np.arange(len(chunk) + 1)).astype(np.int32)
        ids = chunk.column("doc_id").to_numpy().astype(np.uint64)
        fold = (arrays.mix(ids) % np.uint64(_FOLDS)).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(feature.astype(np.int32)))
        kept = [chunk.column(c) for c in ("doc_id", "label", "weight")]
        yield pa.record_batch(
            [*kept, pa.array(fold), pa.array(words.astype(np.int64)), lists],
            ["doc_id", "label", "weight", "fold", "n_words", "features"],
        )


def _useful(sample: DataFrame) -> DataFrame:
    """Features of the sample that the chain may use: those that tell toxic texts from others, or are terms,
    among all rows or all but those of one fold."""
    sizes = {(r.fold, r.label): r.n for r in sample.groupBy("fold", "label").agg(F.count("*").alias("n")).collect()}

    def counts(label: int) -> list[Column]:
        return [F.count_if((F.col("fold") == k) & (F.col("label") == label)).alias(f"n{label}_{k}") for k in range(_FOLDS)]

    counted = sample.select("fold", "label", F.explode("features").alias("feature")).groupBy("feature")
    counted = counted.agg(*counts(0), *counts(1))
    useful = F.lit(False)
    for without in range(_FOLDS + 1):
        folds = [k for k in range(_FOLDS) if k != without]
        n0, n1 = (sum(sizes.get((k, label), 0) for k in folds) for label in (0, 1))
        if not n0 or not n1:
            continue
        clean, toxic = (sum((F.col(f"n{label}_{k}") for k in folds), F.lit(0)) for label in (0, 1))
        share = (clean + toxic) / (n0 + n1)
        error = F.sqrt(F.greatest(share * n1 * (1 - share) * (n0 / (n0 + n1)), F.lit(1e-9)))
        # A little less than the models ask for, as they add up in another order.
        off = F.abs(toxic - share * n1) >= (_LEAST_ERRORS - 1e-6) * error
        useful = useful | (off & (clean + toxic >= _LEAST_ROWS)) | ((toxic >= _LEAST_ROWS) & (clean == 0))
    return counted.where(useful).select("feature")


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> Chain | None:
    """A chain from at most `most` labelled documents, half of each label but weighted by how many there
    are of it; None if a label is missing. Of rows that share a doc_id one counts.

    The sample's ids are broadcast; its useful features come to the driver.
    """
    chosen = labelled_sample(labels, "toxic", most).toPandas()
    if chosen["label"].nunique() < 2:
        return None
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = texts.join(F.broadcast(spark.createDataFrame(chosen)), "doc_id")
    row = F.struct("n_words", "features", "label", "weight", "fold")
    found = texts.mapInArrow(_sampled_features, _SAMPLE).groupBy("doc_id").agg(F.min(row).alias("row"))
    sample = stored(found.select("doc_id", "row.*"), "toxicity-sample")
    useful = np.zeros(1 << _SPACE_BITS, bool)
    useful[_useful(sample).toPandas()["feature"].to_numpy(np.int64)] = True

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            lists = rows.column("features")
            feature, bounds = lists.flatten().to_numpy(), np.append(0, np.cumsum(lists.value_lengths()))
            keep = useful[feature]
            few = arrays.binary_rows(feature[keep], np.append(0, np.cumsum(keep))[bounds])
            columns = ["doc_id", "label", "weight", "fold", "n_words"]
            yield pa.record_batch([*(rows.column(c) for c in columns), few], [*columns, "features"])

    rows = sample.mapInArrow(kept, _SAMPLE.replace("array<int>", "binary")).toPandas().sort_values("doc_id")
    if rows["label"].nunique() < 2:
        return None
    lists = [np.frombuffer(f, np.int32).astype(np.int64) for f in rows["features"]]
    owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    feature = np.concatenate(lists)
    toxic, fold = rows["label"].to_numpy(np.float64), rows["fold"].to_numpy()
    degrees = {"repeated": [], "dense": [], "toxic": toxic}
    for without in range(_FOLDS + 1):
        terms = _terms(owner, feature, toxic, fold != without)
        terms_in = np.bincount(owner, terms[feature], len(toxic))
        degrees["repeated"].append(toxic * (terms_in >= 3))
        degrees["dense"].append(toxic * (100 * terms_in >= rows["n_words"].to_numpy()))
    told = {name: np.array(degrees[name]) for name in CATEGORIES}
    return train_chain(owner, feature, told, fold, rows["weight"].to_numpy(np.float64))


def _judge(chunk: arrays.Chunk, chain: Chain | None, wanted: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    if chain is None:
        return np.zeros((len(chunk), len(CATEGORIES))), np.zeros(len(chunk), bool)
    owner, feature, words = _hits(chunk, wanted)
    p = chain.probabilities(*_distinct(owner, feature), len(chunk))
    p[words == 0] = 0
    return p, p[:, -1] >= chain.threshold


def scored(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> DataFrame:
    """doc_id, p_ of each category and `toxic` of every row.

    A text without words, or null, has probability 0. Without labels of both kinds nothing is toxic.
    """
    chain = train(docs, labels, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = chain.wanted() if chain is not None else None
        for chunk in arrays.text_chunks(batches):
            p, toxic = _judge(chunk, chain, wanted)
            yield pa.record_batch(
                [chunk.column("doc_id"), *(pa.array(c) for c in p.T), pa.array(toxic)],
                ["doc_id", *(f"p_{c}" for c in CATEGORIES), "toxic"],
            )

    columns = ", ".join(f"p_{c} double" for c in CATEGORIES)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.mapInArrow(run, f"doc_id long, {columns}, toxic boolean")


def clean_documents(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> DataFrame:
    """The rows of `docs` that are not toxic, with all their columns; nothing is shuffled."""
    chain = train(docs, labels, most)
    wanted = chain.wanted() if chain is not None else None

    def clean(chunk: arrays.Chunk) -> np.ndarray:
        return ~_judge(chunk, chain, wanted)[1]

    return docs.where(text_flag(clean))
