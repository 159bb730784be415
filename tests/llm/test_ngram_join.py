import random
import re

import numpy as np
import pytest

from delayfold.llm import graph, ngram_join as op
from llm.conftest import BASE, frame, words


def shingles(text, size):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    found = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if len(found) < size:
        return {tuple(found)} - {()}
    return {tuple(found[i : i + size]) for i in range(len(found) - size + 1)}


def brute_force(rows, rule):
    sets = [(i, shingles(t, rule.size)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (a, x) in enumerate(sets):
        for b, y in sets[k + 1 :]:
            if x and y and rule.den * len(x & y) >= rule.num * len(x | y):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    return {i: root(i) for i in parent}


def test_crafted_rows(spark, docs, no_docs):
    rule = op.Similarity(3, 90, 100)
    got = op.similar_documents(docs, rule).collect()
    expected = brute_force([(r.doc_id, r.text) for r in docs.collect()], rule)
    assert len(got) == docs.count()
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == expected
    assert {r.doc_id: r.n_shingles for r in got}[8] == 1
    assert expected[3] == expected[2] == 1 and expected[9] == 8 and expected[7] == 7
    assert op.similar_documents(no_docs, rule).count() == 0


@pytest.mark.parametrize("block", [256, 3])
@pytest.mark.parametrize("rule", [op.Similarity(), op.Similarity(3, 90, 100)])
def test_near_copies_equal_brute_force(spark, rule, block):
    """Chains of copies with more and more changes; small blocks take the path of large families."""
    pick, rows = random.Random(block), []
    for family in range(5):
        text = words(100 + family, pick.choice([6, 40, 200])).split()
        for _ in range(10):
            text = list(text)
            for _ in range(pick.randrange(3)):
                text[pick.randrange(len(text))] = "w%d" % pick.randrange(10**6)
            rows.append((len(rows), " ".join(text)))
    got = op.similar_documents(frame(spark, rows), rule, block=block, pivots=2).collect()
    assert {r.doc_id: r.component_id for r in got} == brute_force(rows, rule)


def test_one_of_each_group_stays(docs):
    kept = op.deduplicated(docs)
    assert kept.columns == docs.columns
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect())
    assert [i for none, i in ids if not none] == [1, 4, 5, 6, 7, 8, 10, 11, 12, 13]
    assert sum(none for none, _ in ids) == 2


def test_texts_that_share_an_id_are_documents_of_their_own(spark):
    a, b, c = words(70, 60), words(71, 60), words(72, 60)
    near_b = b.rsplit(" ", 1)[0] + " other"
    rows = [(5, a), (5, b), (5, b), (6, near_b), (6, c), (7, a), (8, near_b), (None, b)]
    kept = sorted(((r.doc_id, r.text) for r in op.deduplicated(frame(spark, rows)).collect()), key=repr)
    # Text a stays once and c stays; of b and its near copies the one with an id to itself does.
    assert kept == sorted([(7, a), (6, c), (8, near_b), (None, b)], key=repr)


@pytest.mark.parametrize("rule", [op.Similarity(), op.Similarity(3, 90, 100)])
def test_linked_sets_share_the_signatures_they_need(rule):
    pick = np.random.default_rng(1)
    for n in (1, 2, 9, 10, 19, 37, 200, 1000):
        for _ in range(20):
            x = np.unique(pick.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2))
            y = x.copy()
            while True:
                z = y.copy()
                z[pick.integers(len(z))] = pick.integers(0, 2**63)
                z = np.unique(z)
                if rule.den * len(np.intersect1d(x, z)) < rule.num * len(np.union1d(x, z)):
                    break
                y = z
            signed = op._signatures(
                np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)]), rule
            )
            first = set(signed.marks[signed.owners == 0].tolist())
            second = set(signed.marks[signed.owners == 1].tolist())
            both = first & second
            assert both
            fulfilled = []
            for owner in (0, 1):
                needs = signed.needs[signed.needing == owner]
                fulfilled.append(
                    {v & 31 for v in needs.tolist() if sum(m & 31 == v & 31 for m in both) >= v >> 5}
                )
            assert fulfilled[0] & fulfilled[1]


def test_levels():
    for rule in (op.Similarity(), op.Similarity(3, 90, 100)):
        for level in range(10):
            most = op._largest_of_level(level, rule)
            assert op._level(np.array([most]), rule)[0] <= level < op._level(np.array([most + 1]), rule)[0]


@pytest.mark.parametrize("local", [500_000, 5])
def test_components(spark, monkeypatch, local):
    monkeypatch.setattr(graph, "LOCAL", local)
    pick = random.Random(local)
    links = [(pick.randrange(60), pick.randrange(60)) for _ in range(30)] + [(i, i + 1) for i in range(100, 130)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "x long, y long")).collect()}
    label = {n: n for link in links for n in link}
    for _ in label:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    linked = {n for a, b in links if a != b for n in (a, b)}
    assert got == {n: label[n] for n in linked}
    assert graph.components(spark.createDataFrame([], "x long, y long")).count() == 0


def test_base_text_has_the_expected_size():
    assert len(BASE.split()) == 300
