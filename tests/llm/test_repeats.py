import hashlib
import re
from collections import Counter

import pytest

from delayfold.llm import repeats as op
from llm.conftest import ROWS, frame, words


def covered(texts, length, keep_first):
    """Per text, a flag for each byte. Texts in order of doc_id, null first."""
    count, seen, flags = Counter(), set(), []
    for text in texts:
        count.update(text[i : i + length] for i in range(len(text) - length + 1))
    for text in texts:
        flag = bytearray(len(text))
        for i in range(len(text) - length + 1):
            window = text[i : i + length]
            if window in seen if keep_first else count[window] > 1:
                flag[i : i + length] = b"\1" * length
            seen.add(window)
        flags.append(flag)
    return flags


def by_id(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))


@pytest.mark.parametrize("group", [4096, 1])
def test_digests_equal_brute_force(spark, docs, group):
    rows = by_id((i, (t or "").encode()) for i, t in ROWS)
    flags = covered([t for _, t in rows], 400, False)
    expected = Counter()
    for (i, text), flag in zip(rows, flags):
        kept = bytes(b for b, f in zip(text, flag) if not f)
        spans = sum(f and not (k and flag[k - 1]) for k, f in enumerate(flag))
        expected[i, len(text), sum(flag), spans, hashlib.sha256(kept).hexdigest(), 0, 0] += 1
    found = op.with_repeats(docs, 400, False, group)
    assert Counter(map(tuple, op.repeat_digests(found).collect())) == expected
    assert sum(k[2] * n for k, n in expected.items()) > 40_000


@pytest.mark.parametrize("group", [4096, 1])
def test_the_first_copy_stays(spark, group):
    rows = [(i, t) for i, t in ROWS if i is not None and not (i == 13)] + [(13, words(5, 900)), (14, words(5, 900))]
    cleaned = {r.doc_id: r for r in op.without_repeats(frame(spark, rows), 400, group).collect()}
    ordered = by_id((i, (t or "").encode()) for i, t in rows)
    for (i, text), flag in zip(ordered, covered([t for _, t in ordered], 400, True)):
        kept = bytes(b for b, f in zip(text, flag) if not f)
        got = (cleaned[i].text or "").encode()
        if text.isascii():
            assert got == kept
        else:
            assert len(kept) <= len(got) <= len(kept) + 6
    assert cleaned[6].text is None and cleaned[2].text == "" and cleaned[2].n_chars == 0
    assert cleaned[1].text == dict(rows)[1] and cleaned[14].text == ""
    assert len(cleaned) == len(rows)


def test_empty_table_and_columns(no_docs):
    assert op.without_repeats(no_docs).count() == 0
    assert op.without_repeats(no_docs).columns == no_docs.columns
    assert op.repeat_digests(op.with_repeats(no_docs, 400, False)).count() == 0


def test_candidates_that_do_not_match(spark):
    """Anchors in common, but no 400 bytes: 300 of them are the same."""
    common = words(7, 70)[:300]
    rows = [(i, f"{words(20 + i, 60)} {common} {words(40 + i, 60)}") for i in range(4)]
    got = op.repeat_digests(op.with_repeats(frame(spark, rows), 400, False)).collect()
    assert [r.n_removed for r in got] == [0] * 4


def passages_covered(texts, n_words):
    """Per text, a flag for each byte in a run of words, with all between them, that came before."""
    seen, flags = set(), []
    for text in texts:
        flag = bytearray(len(text))
        at = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", text)]
        for (start, _), (_, end) in zip(at, at[n_words - 1 :]):
            if text[start:end] in seen:
                flag[start:end] = b"\1" * (end - start)
            seen.add(text[start:end])
        flags.append(flag)
    return flags


def all_passages(texts, n_words):
    """The same for runs that occur anywhere else."""
    count, flags = Counter(), []
    found = []
    for text in texts:
        at = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", text)]
        found.append([(s, e) for (s, _), (_, e) in zip(at, at[n_words - 1 :])])
        count.update(text[s:e] for s, e in found[-1])
    for text, windows in zip(texts, found):
        flag = bytearray(len(text))
        for s, e in windows:
            if count[text[s:e]] > 1:
                flag[s:e] = b"\1" * (e - s)
        flags.append(flag)
    return flags


@pytest.mark.parametrize("group", [4096, 1])
def test_passages_are_told_beside_the_bytes(spark, group):
    rows = [(i, t) for i, t in ROWS if i is not None] + [(i, f"{words(70 + i, 40)} {SHORT}\n{words(90 + i, 40)}") for i in (20, 21)]
    raw = [t for _, t in by_id((i, (t or "").encode()) for i, t in rows)]
    got = op.repeat_digests(op.with_repeats(frame(spark, rows), 400, False, group, words=51)).collect()
    expected = Counter()
    for (i, _), one, two in zip(by_id(rows), covered(raw, 400, False), all_passages(raw, 51)):
        runs = sum(f and not (k and two[k - 1]) for k, f in enumerate(two))
        expected[i, sum(one), runs, sum(two)] += 1
    assert Counter((r.doc_id, r.n_removed, r.n_passages, r.n_passage_bytes) for r in got) == expected
    short = {r.doc_id: r for r in got}[20]
    assert short.n_removed == 0 and short.n_passages == 1 and short.n_passage_bytes == len(SHORT)


SHORT = " ".join(words(60, 200).split()[:51])  # 51 words in far less than 400 bytes
TINY = " ".join("abcdefghij"[i * i % 10] for i in range(51))  # 101 bytes, the least there can be


@pytest.mark.parametrize("group", [4096, 1])
def test_passages_of_51_words_go(spark, group):
    """Short ones too, whatever is around them; one of 50 words stays."""
    assert len(SHORT) < 300
    fifty = " ".join(words(61, 50).split())
    rows = [(i, t) for i, t in ROWS if i is not None]
    rows += [(20 + i, f"{words(70 + i, 40)} {SHORT}\n{words(90 + i, 40)}") for i in range(4)]
    rows += [(30 + i, f"{words(110 + i, 9)} {TINY} {words(120 + i, 9)} {fifty} {words(130 + i, 9)}") for i in range(3)]
    rows += [(40, f"{SHORT} {TINY}"), (41, SHORT), (42, f"{SHORT[1:]} x"), (43, SHORT.replace(" ", "  ", 1))]
    cleaned = {}
    for r in op.without_repeats(frame(spark, rows), 400, group, 51).collect():
        cleaned.setdefault(r.doc_id, []).append((r.text or "").encode())
    ordered = by_id((i, (t or "").encode()) for i, t in rows)
    texts = [t for _, t in ordered]
    by_bytes, by_words = covered(texts, 400, True), passages_covered(texts, 51)
    for (i, text), one, two in zip(ordered, by_bytes, by_words):
        kept = bytes(b for b, f, g in zip(text, one, two) if not (f or g))
        if text.isascii() and i != 13:  # 13 is there twice
            assert cleaned[i] == [kept]
    assert SHORT.encode() in cleaned[20][0] and TINY.encode() in cleaned[30][0]
    assert all(SHORT.encode() not in cleaned[20 + i][0] for i in (1, 2, 3))
    assert all(TINY.encode() not in cleaned[30 + i][0] and fifty.encode() in cleaned[30 + i][0] for i in (1, 2))
