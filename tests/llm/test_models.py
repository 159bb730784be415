import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from delayfold.llm import language, quality, toxicity
from llm.conftest import ROWS, frame, words


def counts_of(text):
    text = text or ""
    found = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(found[i : i + 3]) for i in range(len(found) - 2)]
    times = Counter(windows)
    repeated = {j for i, w in enumerate(windows) if times[w] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    symbols = re.findall(r"[#*$%&|<>]", text)
    return len(found), sum(map(len, found)), len(symbols), len(lines) - len(set(lines)), len(repeated)


def test_statistics(docs, real):
    for table in (docs, real):
        texts = table.select("doc_id", "text").collect()
        got = quality.text_statistics(table).collect()
        assert Counter((r.doc_id, *tuple(r)[1:6]) for r in got) == Counter(
            (r.doc_id, *counts_of(r.text)) for r in texts
        )


def test_rules_decide_without_labels(docs, no_docs, labels):
    nobody = labels.where("doc_id < 0")
    got = quality.judged(docs, nobody).collect()
    assert len(got) == len(ROWS) and all(r.kept != r.base_failed for r in got)
    assert quality.judged(no_docs, nobody).count() == 0
    kept = quality.good_documents(docs, nobody)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got)


def test_labels_may_hold_nulls_and_contradict(spark, docs):
    rows = [(1, 1), (1, 0), (4, 1), (5, 0), (None, 1), (8, None)]
    labels = spark.createDataFrame(rows, "doc_id long, quality long")
    sample = quality.labelled_sample(labels, "quality", 100).collect()
    assert {(r.doc_id, r.label) for r in sample} == {(1, 0), (4, 1), (5, 0)}
    assert quality.judged(docs, labels).count() == len(ROWS)


def test_quality_of_documents_not_seen(real, labels):
    known = labels.where("doc_id % 2 = 0")
    got = quality.judged(real, known).join(labels.where("doc_id % 2 = 1"), "doc_id").where("not base_failed")
    good = got.where("quality = 1").agg(F.avg(F.col("kept").cast("int"))).first()[0]
    assert good >= 0.95


def test_trees_respect_their_signs():
    pick = np.random.default_rng(0)
    x = pick.random((3_000, 2))
    y = ((x[:, 0] + 0.3 * pick.standard_normal(3_000) < 0.5) ^ (x[:, 1] > 0.9)).astype(float)
    trees = quality.train_trees(x, y, np.array([-1, 0]))
    for other in (0.1, 0.5, 0.95):
        line = np.column_stack([np.linspace(0, 1, 200), np.full(200, other)])
        assert (np.diff(trees.score(line)) <= 1e-12).all()
    assert ((trees.score(x) > 0.5) == (y > 0.5)).mean() > 0.7
    assert (trees.left >= np.arange(len(trees.left))).all()


def test_language_of_documents_not_seen(real):
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    filters = language.train(real.where(~held))
    assert filters.languages == ["de", "en", "es", "fr"]
    got = language.predicted(real, filters).join(real.where(held).select("doc_id", "lang"), "doc_id")
    assert got.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0] > 0.98


def test_language_edges(spark, docs, no_docs):
    filters = language.train(docs)
    assert filters.languages == ["en", "fr"]
    got = language.predicted(docs, filters).collect()
    by_id = {r.doc_id: r for r in got}
    assert len(got) == len(ROWS)
    for i in (6, 7, 10):
        assert (by_id[i].lang_pred, by_id[i].score) == ("und", 0.0)
    assert all(0 <= r.score <= 1 for r in got)
    odd = spark.createDataFrame([(1, "123 !?"), (2, "Ω")], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in language.predicted(odd, filters).collect()} == {
        1: "und", 2: filters.fallback,
    }
    assert language.train(no_docs) is None
    assert {r.lang_pred for r in language.predicted(docs, None).collect()} == {"und"}


def test_masks_hold_every_language_of_a_trigram(real):
    filters = language.train(real)
    text = real.where("lang = 'en'").first().text
    import pyarrow as pa

    from delayfold.llm import arrays

    batch = pa.record_batch([pa.array([text])], ["text"])
    grams, bounds = language._trigrams(next(iter(arrays.text_chunks(iter([batch])))))
    masks = filters.masks(grams)
    assert ((masks >> filters.languages.index("en")) & 1).mean() > 0.95
    assert bounds.tolist() == [0, len(grams)]


def test_more_languages_than_a_word_has_bits(spark):
    """Each language writes in letters of its own."""
    rows = [(i, "".join(chr(0x4E00 + 20 * i + k % 9) for k in range(60)), f"l{i:03d}") for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    filters = language.train(docs)
    assert [w.dtype.itemsize for w in filters.slots] == [8, 8, 4]
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.predicted(docs, filters).collect()}
    assert {i: lang for i, (lang, _) in got.items()} == {i: lang for i, _, lang in rows}
    assert min(score for _, score in got.values()) > 0.99


def test_toxicity_of_documents_not_seen(real, labels):
    known = labels.where("doc_id % 2 = 0")
    got = toxicity.scored(real, known).withColumnRenamed("toxic", "found").join(
        labels.where("doc_id % 2 = 1"), "doc_id"
    )
    clean = got.where("toxic = 0").agg(F.avg(F.col("found").cast("int"))).first()[0]
    assert clean <= 0.05


def test_most_toxic_documents_not_seen_are_found(spark):
    """The smallest table has too few labels to learn from: all terms of its held-out rows are new."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.scored(docs, labels.where("doc_id % 2 = 0")).withColumnRenamed("toxic", "found")
    got = got.join(labels.where("doc_id % 2 = 1"), "doc_id")
    shares = {r.toxic: r.share for r in got.groupBy("toxic").agg(F.avg(F.col("found").cast("int")).alias("share")).collect()}
    assert shares[0] <= 0.05 and shares[1] >= 0.7


def test_the_driver_gets_every_feature_that_a_model_or_a_term_needs(spark):
    pick = np.random.default_rng(5)
    n = 400
    label, fold = (pick.random(n) < 0.3).astype(int), pick.integers(0, 5, n)
    rows = []
    for i in range(n):
        some = set(pick.integers(0, 60, 8).tolist()) | ({100 + int(pick.integers(0, 25))} if label[i] else set())
        rows.append((i, int(label[i]), 1.0, int(fold[i]), 9, sorted(some)))
    got = {r.feature for r in toxicity._useful(spark.createDataFrame(rows, toxicity._SAMPLE)).collect()}
    expected = set()
    for without in range(6):
        inside = [r for r in rows if r[3] != without]
        y = np.array([r[1] for r in inside], float)
        owner = np.repeat(np.arange(len(inside)), [len(r[5]) for r in inside])
        feature = np.concatenate([r[5] for r in inside])
        expected |= set(toxicity._telling(owner, feature, y).tolist())
        for f in set(feature.tolist()):
            in_rows = [r[1] for r in inside if f in r[5]]
            expected |= {f} if len(in_rows) >= 3 and all(in_rows) else set()
    assert got == expected and 0 < len(got) < 85


def test_terms_of_a_fold_come_from_the_other_rows():
    """A term that only rows of one fold use is none without them."""
    owner, feature = np.arange(8), np.array([5, 5, 5, 6, 6, 6, 7, 7])
    toxic, fold = np.array([1.0] * 6 + [0, 0]), np.array([0, 0, 0, 1, 2, 3, 4, 4])
    assert np.flatnonzero(toxicity._terms(owner, feature, toxic, fold != 9)).tolist() == [5, 6]
    assert np.flatnonzero(toxicity._terms(owner, feature, toxic, fold != 0)).tolist() == [6]
    assert np.flatnonzero(toxicity._terms(owner, feature, toxic, fold != 1)).tolist() == [5]


def test_toxicity_edges(docs, no_docs, labels):
    got = toxicity.scored(docs, labels).collect()
    assert len(got) == len(ROWS)
    assert all(r.p_toxic == 0 and not r.toxic for r in got if r.doc_id in (6, 7, 10))
    assert toxicity.scored(no_docs, labels).count() == 0
    none = labels.where("toxic < 0")
    assert not any(r.toxic for r in toxicity.scored(docs, none).collect())
    assert toxicity.clean_documents(docs, none).columns == docs.columns


def test_a_chain_hands_probabilities_on():
    pick = np.random.default_rng(3)
    n = 2_000
    owner = np.repeat(np.arange(n), 6)
    feature = pick.integers(100, 400, 6 * n)
    mild = pick.random(n) < 0.3
    feature[::6][mild] = 7
    severe = mild & (pick.random(n) < 0.5)
    feature[1::6][severe] = 9
    chain = toxicity.train_chain(owner, feature, {"mild": mild * 1.0, "severe": severe * 1.0}, np.arange(n) % 5)
    assert [len(link.earlier) for link in chain.links] == [0, 1]
    p = chain.probabilities(owner, feature, n)
    assert ((p[:, 0] > 0.5) == mild).mean() > 0.98 and ((p[:, 1] > 0.5) == severe).mean() > 0.98


@pytest.mark.parametrize("table", ["docs", "real"])
def test_models_are_the_same_each_time(request, table, labels):
    rows = request.getfixturevalue(table)
    first, second = (sorted(map(tuple, toxicity.scored(rows, labels).collect()), key=repr) for _ in range(2))
    assert first == second


def rare(spark):
    """300 documents of one text, 30 of them good and 30 toxic."""
    docs = frame(spark, [(i, words(7, 80)) for i in range(300)])
    labels = [(i, int(i % 10 == 0), int(i % 10 == 1)) for i in range(300)]
    return docs, spark.createDataFrame(labels, "doc_id long, quality long, toxic long")


def test_a_sample_stands_for_all_labels(spark):
    labels = rare(spark)[1]
    for most in (40, 1_000):
        sample = quality.labelled_sample(labels, "toxic", most).toPandas()
        assert len(sample) <= most and set(sample["label"]) == {0, 1}
        assert sample.groupby("label")["weight"].sum().round(6).to_dict() == {0: 270, 1: 30}


def test_models_do_not_depend_on_the_size_of_the_sample(spark):
    """Nothing tells these documents apart, so their scores are the shares of the labels."""
    docs, labels = rare(spark)
    for most in (40, 1_000):
        assert {round(r.score, 3) for r in quality.judged(docs, labels, most=most).collect()} == {0.1}
        got = toxicity.scored(docs, labels, most=most).collect()
        assert all(abs(r.p_toxic - 0.1) < 0.03 and not r.toxic for r in got)
