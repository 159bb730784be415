import hashlib
import os
import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from delayfold.llm import byte_bpe, pieces, token_files
from llm.conftest import ROWS

HF = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    ranks = byte_bpe.read_ranks(RANKS)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def bpe():
    return byte_bpe.Bpe(RANKS)


def test_pieces_equal_the_pattern():
    import regex

    pattern, pick = regex.compile(public_tokenizers.PATTERN), random.Random(4)
    for _ in range(500):
        texts = ["".join(pick.choices("ab'stremdlv  \n\t é1²٣,.!日\U0001f600́", k=pick.randrange(12))) for _ in range(4)]
        raw = [t.encode() for t in texts]
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        bounds = pieces.piece_bounds(data, offsets)
        got = [data[a:b].tobytes().decode() for a, b in zip(bounds[:-1], bounds[1:])]
        assert got == [p for t in texts for p in pattern.findall(t)]


def test_white_space_of_several_bytes():
    import regex

    pattern, pick = regex.compile(public_tokenizers.PATTERN), random.Random(6)
    for _ in range(500):
        texts = ["".join(pick.choices("a's \n\x85\xa0\u2028\u3000é日", k=pick.randrange(12))) for _ in range(4)]
        raw = [t.encode() for t in texts]
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        bounds = pieces.piece_bounds(data, offsets)
        got = [data[a:b].tobytes().decode() for a, b in zip(bounds[:-1], bounds[1:])]
        assert got == [p for t in texts for p in pattern.findall(t)]


def _as_bounds(found):
    return np.frombuffer(b"".join(found), np.uint8), np.cumsum([0, *map(len, found)])


def test_known_pieces_are_found_without_sorting(monkeypatch):
    words = [b"a" * n for n in (1, 7, 8, 9, 16, 17, 255, 256, 257, 2_000)] + [b"a\0", b"a\0\0", b"ab", b"b", b"b" * 300]
    seen = []
    table = pieces.PieceTable(lambda found: seen.extend(found) or [list(p) for p in found], np.uint32)
    for order in (words, words[::-1], words[3:] + words):
        values, counts = table.lookup(*_as_bounds(order))
        assert bytes(values.tolist()) == b"".join(order) and counts.tolist() == [len(w) for w in order]
    assert sorted(seen) == sorted(words)  # each of them encoded once
    monkeypatch.setattr(pieces.np, "unique", None)
    values, _ = table.lookup(*_as_bounds(words * 3))
    assert bytes(values.tolist()) == b"".join(words * 3)


def test_pieces_that_share_a_slot(monkeypatch):
    monkeypatch.setattr(pieces, "_SLOT_BITS", 1)
    table = pieces.PieceTable(lambda found: [list(p) for p in found], np.uint32, limit=50)
    pick = random.Random(7)
    for _ in range(20):
        words = [bytes(pick.choices(b"abc", k=pick.randrange(1, 6))) for _ in range(40)]
        values, counts = table.lookup(*_as_bounds(words))
        assert bytes(values.tolist()) == b"".join(words) and counts.tolist() == [len(w) for w in words]


def test_contraction_equals_the_library(bpe, reference):
    pick = random.Random(5)
    words = ["".join(pick.choices("abcdeé' ñ日", k=pick.randrange(1, 40))).encode() for _ in range(400)]
    words += [b"a" * 300, b"abcd" * 300, "é日".encode() * 200, b"a" * 256, b"a" * 257]
    encoded = bpe.encode(words)
    assert [e.tolist() for e in encoded] == [reference._core_bpe.encode_single_piece(w) for w in words]
    assert bpe.decode(encoded) == words


def test_digests_and_round_trip(docs, no_docs, reference):
    expected = []
    for i, text in ROWS:
        ids = reference.encode_ordinary(text or "")
        raw = np.array(ids, "<u4").tobytes()
        expected.append((i, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    got = list(map(tuple, byte_bpe.digests(docs, RANKS).collect()))
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    back = byte_bpe.decode(byte_bpe.encode(docs, RANKS), RANKS).collect()
    assert sorted(bytes(r.bytes) for r in back) == sorted((t or "").encode() for _, t in ROWS)
    assert byte_bpe.digests(no_docs, RANKS).count() == 0


@pytest.mark.parametrize("shard_tokens", [1 << 22, 500])
def test_token_files(docs, shard_tokens):
    tokenizer = Tokenizer.from_file(HF)
    encoded = [(i, tokenizer.encode(t or "", add_special_tokens=False).ids + [2]) for i, t in ROWS]
    start, expected = 0, []
    order = lambda r: (r[0] is not None, r[0] or 0, np.array(r[1], "<u2").tobytes())
    for i, ids in sorted(encoded, key=order):
        expected.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    manifest = token_files.write_tokens(docs, HF, 2, shard_tokens=shard_tokens)
    assert manifest.count() > (1 if shard_tokens == 500 else 0)
    got = token_files.read_tokens(manifest, token_files.checksum, "ids_crc32 long").collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == expected


def test_special_strings_have_their_id(spark):
    end = "<|endoftext|>"
    texts = [end, f"a{end}", f"{end}b", f"a {end} 's{end}{end}don't", "<|endof", "text|>x", f"é{end}é", f" \n{end}\n "]
    tokenizer = Tokenizer.from_file(HF)
    expected = [tokenizer.encode(t, add_special_tokens=False).ids + [2] for t in texts]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    manifest = token_files.write_tokens(frame, HF, 2)
    got = token_files.read_tokens(manifest, lambda ids: {"ids": ids.tolist()}, "ids array<long>").collect()
    assert [list(r.ids) for r in sorted(got)] == expected and expected[0] == [50256, 2]
    counts = token_files.token_counts(frame, HF).collect()
    assert [r.n_tokens for r in sorted(counts)] == [len(e) for e in expected]


def test_a_worker_keeps_its_encoder_between_tasks(spark):
    def known(batches):
        before = len(token_files._encoder(HF)._runs)
        encoded = list(token_files._encode(HF, 2, np.zeros(0, np.int64))(batches))
        yield pa.record_batch([[os.getpid()], [before], [len(encoded)]], ["pid", "known", "batches"])

    frame = spark.createDataFrame([(i, f"text {i}") for i in range(400)], "doc_id long, text string").repartition(32)
    seen = [r for _ in range(2) for r in frame.mapInArrow(known, "pid long, known long, batches long").collect()]
    fresh = [r.pid for r in seen if r.known == 0]
    assert all(r.batches for r in seen) and len(fresh) == len(set(fresh))


def test_token_files_of_nothing(no_docs):
    assert token_files.write_tokens(no_docs, HF, 2).count() == 0


@pytest.mark.parametrize("high", [2, 50_257, 1 << 20])
def test_a_shard_answers_from_its_planes(high, monkeypatch):
    monkeypatch.setattr(token_files, "_BLOCK", 64)
    ids = np.random.default_rng(high).integers(0, high, 1_000).astype(np.uint32)
    ids[::9] = 1
    shard = token_files.Shard(token_files.write_shard(ids, [5, None], np.array([400, 600])))
    assert (shard.ids() == ids).all() and shard.docs == [5, None] and shard.lengths.tolist() == [400, 600]
    assert [shard.access(i) for i in (0, 63, 64, 999)] == ids[[0, 63, 64, 999]].tolist()
    assert shard.occurrences(1) == np.flatnonzero(ids == 1).tolist()
    assert shard.rank(1, 500) == (ids[:500] == 1).sum() and shard.count(high + 5) == 0
    with pytest.raises(IndexError):
        shard.select(1, shard.count(1))
    empty = token_files.Shard(token_files.write_shard(np.zeros(0, np.uint32), [], np.zeros(0)))
    assert len(empty.ids()) == 0 and empty.count(3) == 0
