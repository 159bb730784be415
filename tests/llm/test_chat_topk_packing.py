import math
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from delayfold.llm import chat, packing, token_files, topk
from delayfold.llm.queries import QUERIES
from llm.conftest import ROWS

TURNS = [
    (-7, 0, "user", "</s>[INST] ok [/INST]"),
    (-7, 1, "assistant", "</s>[INST] ok [/INST]"),
    (1, 2, "assistant", "b"),
    (1, 1, "user", "a"),
    (1, 3, "assistant", None),
    (1, 4, "assistant", "é\U0001f600\n"),
    (2, 0, "user", "<|end|>\n<|"),
    (2, 1, "user", "\n<|next|>\n<\\|x<\\\\|"),
    (2, 2, "as|>\n<|s", "<"),
    (2, 2, "as|>\n<|s", "<"),  # a repeated row
    (2, 3, "assistant", "<|role:user|>\nhello\n<|end|>\n"),
    (3, None, None, "no role"),
    (None, 1, "user", "no conversation"),
]


def test_chat_is_read_back_whole(spark):
    turns = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string")
    out = chat.formatted(turns.withColumn("formatted", F.lit(1)))
    back = {r.conv_id: r for r in chat.read_back(out).collect()}
    expected = {}
    for conv, turn, role, text in sorted(TURNS, key=lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or "")):
        expected.setdefault(conv, []).append((role or "", text or ""))
    assert {c: [tuple(t) for t in r.turns] for c, r in back.items()} == expected
    for conv, r in back.items():
        assert r.loss_texts == [t for role, t in expected[conv] if role == "assistant"]
    texts = {r.conv_id: r for r in out.collect()}
    assert texts[1].formatted.count("<|role:") == 2  # neighbours of one role are merged
    assert all(len(texts[c].formatted) == back[c].formatted_chars for c in back)
    assert chat.formatted(turns.limit(0)).count() == 0


def test_chat_runs_no_python(spark):
    turns = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string")
    plan = chat.read_back(chat.formatted(turns))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def exact(rows, k, scale):
    kept = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            kept[i] = [math.floor(scale * x) for x in v]
    out = []
    for q, a in kept.items():
        scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in kept.items() if i != q)
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k]) if q % 2 == 0]
    return sorted(out)


@pytest.mark.parametrize("block", [8192, 5])
def test_top_products_equal_brute_force(spark, block):
    pick = np.random.default_rng(block)
    rows = [(i, [float(x) for x in pick.standard_normal(6) * 10.0 ** (i % 4 - 2)]) for i in range(120)]
    rows += [(120, [0.0] * 6), (121, [0.5, 0.25]), (122, []), (123, None), (124, [float("nan")] * 6)]
    rows += [(125, [None, 1.0]), (126, [float("inf")] * 6), (None, [1.0] * 6), (127, [-1.0] * 6)]
    rows += [(128 + i, rows[3][1]) for i in range(4)]  # ties
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("length", F.lit("x"))
    got = topk.top_products(frame, F.col("vec_id") % 2 == 0, 10, 1024, block).collect()
    assert sorted(map(tuple, got)) == exact(rows, 10, 1024)


def test_repeated_query_rows_are_asked_each(spark):
    pick = np.random.default_rng(3)
    rows = [(i, [float(x) for x in pick.standard_normal(4)]) for i in range(30)]
    rows += [(2, rows[5][1]), (3, rows[3][1])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, topk.top_products(frame, F.col("vec_id") == 2, 10, 1024).collect()))
    expected = []
    for query in (rows[2][1], rows[5][1]):
        whole = lambda v: [math.floor(1024 * x) for x in v]
        scores = sorted((-sum(x * y for x, y in zip(whole(query), whole(v))), i) for i, v in rows if i != 2)
        expected += [(2, r + 1, i, -s) for r, (s, i) in enumerate(scores[:10])]
    assert got == sorted(expected)


def test_top_products_of_few_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0])], schema)
    assert [tuple(r) for r in topk.top_products(few, "vec_id = 0").collect()] == [(0, 1, 1, 1024 * 2048)]
    assert topk.top_products(few.limit(0), "vec_id = 0").count() == 0
    huge = spark.createDataFrame([(0, [1e30]), (1, [1e30])], schema)
    assert topk.top_products(huge, "vec_id = 0").first().score == 2**63 - 1


def check_packing(rows, lengths):
    bins = {}
    for r in rows:
        bins.setdefault((r.pack, r.bin), []).append(r)
    for members in bins.values():
        capacity, = {m.capacity for m in members}
        ends = 0
        for m in sorted(members, key=lambda m: (m.bin_offset, m.length)):
            assert m.bin_offset == ends
            ends += m.length
        shorter = [c for c in packing.CAPACITIES if c < capacity]
        assert ends <= capacity and (not shorter or ends > max(shorter))
    per_doc = {}
    for r in sorted(rows, key=lambda r: r.piece):
        assert r.start == r.piece * max(packing.CAPACITIES)
        per_doc[r.doc_id] = per_doc.get(r.doc_id, 0) + r.length
    assert per_doc == lengths


def test_packing_holds_everything(docs, no_docs):
    rows = packing.packed(docs.withColumn("rank", F.lit(1)).withColumn("row", F.lit(2))).collect()
    lengths = {}
    for i, text in ROWS:
        lengths[i] = lengths.get(i, 0) + (len(text.encode()) + 1 if text is not None else 0)
    check_packing(rows, lengths)
    assert packing.packed(no_docs).count() == 0


def test_the_plan_does_not_depend_on_partitions(spark):
    pick = np.random.default_rng(5)
    rows = [(i, int(n)) for i, n in enumerate(pick.integers(0, 20_000, 600))] + [(7, 0), (7, 0), (None, 5)]
    frame = spark.createDataFrame(rows, "doc_id long, n long")
    found = [sorted(map(str, packing.packed(frame.repartition(n), F.col("n")).collect())) for n in (1, 20)]
    assert found[0] == found[1]


def item_by_item(lengths, capacities, cost):
    """Contents of the bins when every item goes where the least room is left that is enough."""
    bins, left = [], sum(lengths)
    for length in sorted(lengths, reverse=True):
        if not length:
            if not bins:
                bins.append([min(capacities, key=lambda c: (cost(c), c)), 0])
            continue
        fitting = [b for b in bins if b[0] >= length]
        if fitting:
            chosen = min(fitting)
        else:
            enough = [c for c in capacities if c >= length]
            chosen = [min(enough, key=lambda c: (cost(c) / max(1, min(c, left)), c)), 0]
            bins.append(chosen)
        chosen[0] -= length
        chosen[1] += length
        left -= length
    return sorted(b[1] for b in bins)


def test_packing_is_best_fit_and_takes_the_cheapest_plan():
    pick = random.Random(1)
    for _ in range(400):
        capacities = tuple(sorted(pick.sample([4, 8, 16, 32, 64, 100], pick.randrange(1, 4))))
        most = max(capacities)
        lengths = [pick.randrange(most + 1) if pick.random() < 0.7 else pick.choice([0, 1, 2, most]) for _ in range(pick.randrange(60))]
        costs = []
        for longest in capacities:
            price = lambda c: packing.training_cost(c) + 1e12 * (c > longest)  # noqa: B023, E731
            _, bins = packing._plan(sorted(Counter(lengths).items(), reverse=True), capacities, price)
            contents = item_by_item(lengths, capacities, price)
            assert sorted(c for _, n, c in bins for _ in range(n)) == contents
            sizes = [packing._shrunk(c, capacities, packing.training_cost) for c in contents]
            costs.append(sum(map(packing.training_cost, sizes)))
        plan = packing.best_plan(Counter(lengths), capacities)
        assert plan.cost == pytest.approx(min(costs))
        number, offset, capacity = plan.place(np.arange(len(lengths))) if lengths else ([], [], [])
        held = {}
        for item in zip(number, offset, sorted(lengths, reverse=True), capacity):
            held.setdefault(item[0], []).append(item[1:])
        for members in held.values():
            ends = 0
            for start, length, size in sorted(members):
                assert start == ends and start + length <= size
                ends += length


def test_plans_do_not_grow_with_rows():
    lengths = np.minimum(8192, np.random.default_rng(0).lognormal(6, 1, 100_000).astype(int))
    one = Counter(lengths.tolist())
    plans = [packing.best_plan({length: n * many for length, n in one.items()}) for many in (1, 100_000)]
    assert len(plans[1].first) < 1.1 * len(plans[0].first) < 11_000
    for many, plan in zip((1, 100_000), plans):
        room = (np.diff(np.append(0, plan.ends)) * plan.capacities).sum()
        assert lengths.sum() * many > 0.999 * room


def test_tokens_of_whole_texts_are_packed(spark, docs):
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    english = (" the people of the house and the time of the year" * 200).strip()
    more = docs.select("doc_id", "text").union(spark.createDataFrame([(50, english)], "doc_id long, text string"))
    manifest = token_files.write_tokens(more.where("text is not null"), vocabulary, end_id=2)
    lengths = Counter({i: 0 for i, _ in ROWS})
    for r in token_files.read_tokens(manifest, token_files.checksum, "ids_crc32 long").collect():
        lengths[r.doc_id] += r.n_tokens
    rows = packing.packed_tokens(more, vocabulary).collect()
    check_packing(rows, lengths)
    assert len(english) > max(packing.CAPACITIES) and sum(r.doc_id == 50 for r in rows) == 1


def test_the_query_packs_tokens(spark):
    folder = "/root/testdata/sf0.001"
    n_tokens = {r.doc_id: r.n_tokens for r in QUERIES["op3_token_files"](spark, folder).collect()}
    empty = {r.doc_id for r in spark.read.parquet(f"{folder}/documents.parquet").where("text is null").collect()}
    rows = QUERIES["op7_best_fit_packing"](spark, folder).collect()
    check_packing(rows, {i: 0 if i in empty else n for i, n in n_tokens.items()})
