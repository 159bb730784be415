"""Each stage on what the one before it kept, against the same rules written out plainly."""

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from delayfold.llm import packing, quality, toxicity
from delayfold.llm.ngram_join import Similarity
from delayfold.llm.queries import ORACLES, QUERIES
from delayfold.llm.tables import stored
from oracle import connect, differences
from llm.test_chat_topk_packing import check_packing
from llm.test_ngram_join import brute_force
from llm.conftest import frame, words
from llm.test_repeats import SHORT, by_id, covered, passages_covered

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    tables = [spark.read.parquet(f"{SMALL}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        tables.append(stored(stage(spark, tables[-1], SMALL), "stage"))
    return tables


def texts(frame):
    return {r.doc_id: r.text for r in frame.collect()}


def test_stages_keep_the_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality rules", "toxicity", "n-gram Jaccard join", "suffix-array dedup", "best-fit packing",
    ]
    assert all(s.schema.fieldNames() == stages[0].columns for s in stages[:-1])


def test_models_reject_what_they_judge(stages, labels):
    docs, good, clean = stages[:3]
    kept = {r.doc_id for r in quality.judged(docs, labels).collect() if r.kept}
    assert set(texts(good)) == kept
    toxic = {r.doc_id for r in toxicity.scored(good, labels).collect() if r.toxic}
    assert set(texts(clean)) == kept - toxic and toxic


def test_one_of_each_group_stays(stages):
    before, after = texts(stages[2]), texts(stages[3])
    found = brute_force(sorted(before.items()), Similarity())
    assert after == {i: before[i] for i in set(found.values())}


def test_later_passages_go(stages):
    """Strings of 400 bytes and runs of 51 words that came before, and nothing else."""
    before, after = texts(stages[3]), texts(stages[4])
    rows = by_id((i, t.encode()) for i, t in before.items())
    raw = [t for _, t in rows]
    for (i, text), one, two in zip(rows, covered(raw, 400, True), passages_covered(raw, 51)):
        gone = sum(a | b for a, b in zip(one, two))
        assert 0 <= len(after[i].encode()) - (len(text) - gone) <= 6 * gone
        assert (after[i].encode() == text) == (not gone)


def test_a_planted_passage_of_51_words_goes(spark):
    rows = [(i, f"{words(200 + i, 80)} {SHORT}\n{words(300 + i, 80)}") for i in range(3)]
    after = texts(corpus_pipeline.repeated_passages(spark, frame(spark, rows), SMALL))
    assert [SHORT in after[i] for i in range(3)] == [True, False, False]
    assert all(after[i] == dict(rows)[i].replace(SHORT, "" if i else SHORT) for i in range(3))


def test_everything_left_is_packed(stages):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    lengths = {
        i: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in texts(stages[4]).items()
    }
    check_packing(stages[5].collect(), lengths)
    assert max(packing.CAPACITIES) >= max(r.capacity for r in stages[5].collect())


@pytest.mark.parametrize("name", ORACLES)
def test_query_equals_sql(spark, name):
    assert differences(QUERIES[name](spark, SMALL), connect(SMALL), ORACLES[name]) == ""


def test_registered(spark):
    assert QUERIES.keys() | {"pipeline"} <= entry.queries().keys()
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 14)]
    assert corpus_pipeline.run(spark, SMALL).columns[:2] == ["doc_id", "piece"]
