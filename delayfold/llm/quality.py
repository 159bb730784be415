"""Quality of documents: fixed rules, then gradient-boosted trees over statistics of the text.

Statistics are counted in numpy, one pass over whole texts. The trees are trained on the driver from
the statistics of a bounded sample of labelled documents (`MAX_LABELLED`), flattened into node arrays,
and score all rows of a batch together. On features in `FALLING` the score can only fall.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from delayfold.llm import arrays
from delayfold.llm.tables import text_flag

MAX_LABELLED = 20_000

COUNTS = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_upper", "n_letters", "n_digits", "n_marks", "n_bare_words", "n_distinct_words", "n_ends",
]
FEATURES = [
    "log_words", "word_length", "symbols", "dup_lines", "repeat_words", "line_length",
    "upper", "letters", "digits", "marks", "bare_words", "distinct_words", "ends",
]
FALLING = {"symbols", "dup_lines", "repeat_words", "upper", "bare_words"}


def _flags(characters: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(characters.encode())] = True
    return table


_SYMBOL = _flags("#*$%&|<>")
_UPPER = _flags("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_DIGIT = _flags("0123456789")
_MARK = _flags("!?.,;:'\"-()")
_END = _flags(".!?")
_LETTER = _flags("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
_LETTER[128:] = True
_FIRST_BYTE = np.ones(256, bool)
_FIRST_BYTE[0x80:0xC0] = False


def _per_doc(owner: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(owner, minlength=n).astype(np.int64)


def _keyed(values: np.ndarray, doc: np.ndarray) -> np.ndarray:
    return arrays.mix(values ^ arrays.mix(doc.astype(np.uint64) + np.uint64(1)))


def text_counts(chunk: arrays.Chunk) -> np.ndarray:
    """The columns of COUNTS, one row for each text."""
    data, offsets, n = chunk.data, chunk.offsets, len(chunk)
    words = arrays.split_words(data, offsets)
    hashes = arrays.RangeHash(data)
    word, doc = hashes(words.starts, words.ends), words.doc
    letter = np.concatenate([[0], np.cumsum(_LETTER[data])])
    counts = dict.fromkeys(COUNTS)
    counts["n_words"] = words.counts

    inside = ~arrays._SPACE[data]
    counts["word_chars"] = arrays.sums_of(inside & _FIRST_BYTE[data], offsets)
    for name, table in (
        ("n_symbols", _SYMBOL), ("n_upper", _UPPER), ("n_digits", _DIGIT), ("n_marks", _MARK),
    ):
        counts[name] = arrays.sums_of(table[data], offsets)
    counts["n_letters"] = arrays.sums_of(_LETTER[data] & _FIRST_BYTE[data], offsets)
    counts["n_bare_words"] = _per_doc(doc[letter[words.ends] == letter[words.starts]], n)
    counts["n_ends"] = _per_doc(doc[_END[data[words.ends - 1]]] if len(doc) else doc, n)
    distinct = np.unique(_keyed(word, doc), return_index=True)[1]
    counts["n_distinct_words"] = _per_doc(doc[distinct], n)

    # Words in windows of three that occur twice or more in their text.
    repeated = np.zeros(len(word) + 2, bool)
    if len(word) > 2:
        k = np.uint64(0x9E3779B97F4A7C15)
        window = arrays.mix(arrays.mix(word[:-2] * k + word[1:-1]) * k + word[2:])
        whole = np.flatnonzero(doc[2:] == doc[:-2])
        which, times = np.unique(_keyed(window[whole], doc[whole]), return_inverse=True, return_counts=True)[1:]
        found = whole[times[which] > 1]
        for step in range(3):
            repeated[found + step] = True
    counts["n_repeat_words"] = _per_doc(doc[repeated[: len(word)]], n)

    # Lines with a word, and those of them that came before.
    breaks = np.flatnonzero(data == 10)
    line_start = np.union1d(breaks + 1, offsets[:-1][chunk.lengths > 0])
    line_start = line_start[line_start < len(data)]
    ends = np.append(line_start[1:], len(data))
    line_end = np.where(data[ends - 1] == 10, ends - 1, ends) if len(ends) else ends
    line_doc = np.searchsorted(offsets, line_start, side="right") - 1
    first = np.searchsorted(words.starts, line_start)
    with_word = np.searchsorted(words.starts, line_end) > first
    line_start, line_end, line_doc = line_start[with_word], line_end[with_word], line_doc[with_word]
    counts["n_lines"] = _per_doc(line_doc, n)
    once = np.unique(_keyed(hashes(line_start, line_end), line_doc), return_index=True)[1]
    counts["n_dup_lines"] = counts["n_lines"] - _per_doc(line_doc[once], n)
    return np.column_stack([counts[c] for c in COUNTS]).astype(np.int64)


def features(counts: np.ndarray) -> np.ndarray:
    c = dict(zip(COUNTS, counts.T.astype(np.float64)))
    words, chars = np.maximum(c["n_words"], 1), np.maximum(c["word_chars"], 1)
    lines, letters = np.maximum(c["n_lines"], 1), np.maximum(c["n_letters"], 1)
    return np.column_stack(
        [
            np.log1p(c["n_words"]),
            c["word_chars"] / words,
            c["n_symbols"] / words,
            c["n_dup_lines"] / lines,
            c["n_repeat_words"] / words,
            c["n_words"] / lines,
            c["n_upper"] / letters,
            c["n_letters"] / chars,
            c["n_digits"] / chars,
            c["n_marks"] / chars,
            c["n_bare_words"] / words,
            c["n_distinct_words"] / words,
            c["n_ends"] / words,
        ]
    )


def base_failed(counts: np.ndarray) -> np.ndarray:
    n_words, repeat = counts[:, COUNTS.index("n_words")], counts[:, COUNTS.index("n_repeat_words")]
    return (n_words < 50) | (100 * repeat > 50 * n_words)


# ---------------------------------------------------------------- trees


@dataclass
class Trees:
    """Nodes of all trees in one set of arrays; a leaf points to itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of the label 1 for each row, all trees one level at a time."""
        node = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            low = x[rows, self.feature[node]] <= self.threshold[node]
            node = np.where(low, self.left[node], self.right[node])
        return 1 / (1 + np.exp(-(self.base + self.value[node].sum(axis=1))))


def train_trees(
    x: np.ndarray,
    y: np.ndarray,
    signs: np.ndarray,
    n_trees: int = 60,
    depth: int = 3,
    rate: float = 0.2,
    bins: int = 64,
    penalty: float = 1.0,
    least_weight: float = 1.0,
    weight: np.ndarray | None = None,
) -> Trees:
    """Newton boosting of the logistic loss on histograms.

    signs[f] = -1 or 1: the score may only fall or rise with feature f. A split that would break this is
    not taken, and below a taken one both sides stay on their side of the middle of the two values.
    Rows count by `weight`, scaled to a mean of 1.
    """
    weight = np.ones(len(y)) if weight is None else weight / weight.mean()
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(e, x[:, f]) for f, e in enumerate(edges)])
    share = np.clip(np.average(y, weights=weight), 1e-6, 1 - 1e-6)
    base = float(np.log(share / (1 - share)))
    margin = np.full(len(y), base)
    nodes: list[list] = []  # feature, threshold, left, right, value
    roots = []

    def grow(rows: np.ndarray, level: int, low: float, high: float) -> int:
        g, h = gradient[rows], hessian[rows]
        total_g, total_h = g.sum(), h.sum()
        value = float(np.clip(-total_g / (total_h + penalty), low, high))
        here = len(nodes)
        nodes.append([0, 0.0, here, here, rate * value])
        if level == depth or len(rows) < 2:
            return here
        best = (1e-9, None)
        for f, cuts in enumerate(edges):
            if not len(cuts):
                continue
            left_g = np.bincount(binned[rows, f], g, len(cuts) + 1).cumsum()[:-1]
            left_h = np.bincount(binned[rows, f], h, len(cuts) + 1).cumsum()[:-1]
            right_g, right_h = total_g - left_g, total_h - left_h
            gain = left_g**2 / (left_h + penalty) + right_g**2 / (right_h + penalty) - total_g**2 / (total_h + penalty)
            left_v = np.clip(-left_g / (left_h + penalty), low, high)
            right_v = np.clip(-right_g / (right_h + penalty), low, high)
            gain[(left_h < least_weight) | (right_h < least_weight) | (signs[f] * (right_v - left_v) < 0)] = 0
            at = int(gain.argmax())
            if gain[at] > best[0]:
                best = (gain[at], (f, at, left_v[at], right_v[at]))
        if best[1] is None:
            return here
        f, at, left_v, right_v = best[1]
        middle = (left_v + right_v) / 2
        left_bounds = (low, min(high, middle)) if signs[f] > 0 else (max(low, middle), high) if signs[f] < 0 else (low, high)
        right_bounds = (max(low, middle), high) if signs[f] > 0 else (low, min(high, middle)) if signs[f] < 0 else (low, high)
        goes_left = binned[rows, f] <= at
        left = grow(rows[goes_left], level + 1, *left_bounds)
        right = grow(rows[~goes_left], level + 1, *right_bounds)
        nodes[here][:4] = [f, float(edges[f][at]), left, right]
        return here

    trees = None
    for _ in range(n_trees):
        p = 1 / (1 + np.exp(-margin))
        gradient, hessian = weight * (p - y), weight * np.maximum(p * (1 - p), 1e-9)
        roots.append(grow(np.arange(len(y)), 0, -np.inf, np.inf))
        columns = [np.array(c) for c in zip(*nodes)]
        trees = Trees(*columns, np.array(roots), depth, base)
        one = Trees(*columns, np.array(roots[-1:]), depth, 0.0)
        p_one = one.score(x)
        margin += np.log(p_one / (1 - p_one))
    return trees


# ---------------------------------------------------------------- the jobs


def _count_rows(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[pa.RecordBatch]:
    for chunk in arrays.text_chunks(batches):
        counts = text_counts(chunk)
        yield pa.record_batch(
            [chunk.column(name), *(pa.array(c) for c in counts.T)], [name, *COUNTS]
        )


def text_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of every row; a null text has none of anything."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.mapInArrow(
        lambda batches: _count_rows(batches, "doc_id"), "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS)
    )


def labelled_sample(labels: DataFrame, label: str, most: int) -> DataFrame:
    """doc_id, label (0 or 1) and weight of at most `most` documents, half of them with each label if there
    are enough, chosen by a hash of doc_id. Of contradicting rows the smaller label counts.

    `weight` is the number of labelled documents that a row stands for, so that a rare label is not lost
    and the models still see both in the ratio of the whole table, whatever its size.
    """
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.min(label).cast("long").alias("label"))
    )
    half = most // 2
    totals = {r.label: r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}

    def part(value: int) -> DataFrame:
        weight = max(1.0, totals.get(value, 0) / max(1, half))
        chosen = known.where(F.col("label") == value).orderBy(F.xxhash64("doc_id")).limit(half)
        return chosen.withColumn("weight", F.lit(weight))

    return part(0).union(part(1))


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> Trees | None:
    """Trees from at most `most` labelled documents; None if a label is missing. The sample is broadcast,
    its statistics (a row of numbers each) come to the driver."""
    sample = labelled_sample(labels, "quality", most).toPandas()
    if sample["label"].nunique() < 2:
        return None
    chosen = F.broadcast(docs.sparkSession.createDataFrame(sample[["doc_id"]]))
    found = text_statistics(docs.select("doc_id", "text").join(chosen, "doc_id", "left_semi")).toPandas()
    found = found.drop_duplicates().merge(sample, on="doc_id")
    signs = np.array([-1 if f in FALLING else 0 for f in FEATURES])
    if found["label"].nunique() < 2:
        return None
    weight = found["weight"].to_numpy(np.float64)
    return train_trees(
        features(found[COUNTS].to_numpy()), found["label"].to_numpy(np.float64), signs, weight=weight
    )


def _verdicts(counts: np.ndarray, model: Trees | None, least: float) -> tuple[np.ndarray, ...]:
    failed = base_failed(counts)
    score = model.score(features(counts)) if model is not None else np.ones(len(counts))
    return failed, score, ~failed & (score >= least)


def judged(docs: DataFrame, labels: DataFrame, least: float = 0.3, most: int = MAX_LABELLED) -> DataFrame:
    """Counts, base_failed, score and kept of every row.

    kept: the rules (50 words, half of them in no repeated window of three) hold and the trees give a
    score of `least` or more. Without labels of both kinds the rules decide alone. A null text fails.
    """
    model = train(docs, labels, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _count_rows(batches, "doc_id"):
            counts = np.column_stack([rows.column(c).to_numpy() for c in COUNTS])
            failed, score, kept = _verdicts(counts, model, least)
            yield pa.record_batch(
                [*rows.columns, pa.array(failed), pa.array(score), pa.array(kept)],
                [*rows.schema.names, "base_failed", "score", "kept"],
            )

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.mapInArrow(run, f"{schema}, base_failed boolean, score double, kept boolean")


def good_documents(docs: DataFrame, labels: DataFrame, least: float = 0.3, most: int = MAX_LABELLED) -> DataFrame:
    """The rows of `docs` that `judged` keeps, with all their columns; nothing is shuffled."""
    model = train(docs, labels, most)

    def keep(chunk: arrays.Chunk) -> np.ndarray:
        return _verdicts(text_counts(chunk), model, least)[2]

    return docs.where(text_flag(keep))
