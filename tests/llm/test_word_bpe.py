import hashlib
import os
import random

import public_tokenizers
import pytest

from delayfold.llm import word_bpe
from delayfold.llm.queries import QUERIES
from llm.conftest import ROWS

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    *[t for _, t in ROWS if t],
    "Σίσυφος ΣΑΣ İstanbul ǅ Å Å Å ﬁ it's DON'T we'LL 'tis ''s",
    "a<|endoftext|>b <|startoftext|><|startoftext|> <|ENDOFTEXT|> <|endoftext",
    "xᲉy ꟋꟜ \U00010d50\U00010d66 ͸ ￿ é<|endoftext|>́",  # newer letters
    "".join(random.Random(5).choices("abcdeth", k=5000)),  # one long word
    "1234567890 ٣٤ Ⅷ ½ \x85 　\x1c\x00 ... !!!??? \U0001f600‍\U0001f525",
]


@pytest.fixture(scope="module")
def library():
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def bpe():
    return word_bpe.WordBpe(PATH)


def test_ids_and_decoding_are_those_of_the_library(library, bpe):
    pick = random.Random(1)
    pool = "abcdefghij ABC'sdmtrevl  \n\t12é́Σσςİıß日本\U0001f600<|>endoftext"
    more = ["".join(pick.choices(pool, k=pick.randrange(200))) for _ in range(500)]
    for text in TEXTS + more:
        expected = library.encode(text, add_special_tokens=False).ids
        assert bpe.encode(text).tolist() == expected, text[:80]
        assert bpe.decode(bpe.encode(text)) == library.decode(expected, skip_special_tokens=False)


def test_every_character(library, bpe):
    for low in range(0, 0x30000, 128):
        some = [chr(c) for c in range(low, low + 128) if not 0xD800 <= c < 0xE000]
        text = " ".join(f"a{c}1{c}." for c in some)
        assert bpe.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids, hex(low)


def test_heap_takes_the_same_merges(bpe):
    pick = random.Random(2)
    for _ in range(300):
        word = "".join(pick.choices("abcdethé", k=pick.randrange(1, 60)))
        assert bpe.contract(word) == bpe.contract(word, long=0)


def test_slices_change_nothing(bpe, monkeypatch):
    whole = [bpe.encode(t).tolist() for t in TEXTS]
    monkeypatch.setattr(word_bpe, "_SLICE", 7)
    assert [bpe.encode(t).tolist() for t in TEXTS] == whole


def test_rows(spark, docs, no_docs, library):
    ids = word_bpe.encode(docs, PATH)
    got = sorted(((r.doc_id, list(r.ids)) for r in ids.collect()), key=repr)
    expected = [(i, library.encode(t or "", add_special_tokens=False).ids) for i, t in ROWS]
    assert got == sorted(expected, key=repr)
    back = sorted(((r.doc_id, r.text) for r in word_bpe.decode(ids, PATH).collect()), key=repr)
    assert back == sorted(((i, library.decode(e, skip_special_tokens=False)) for i, e in expected), key=repr)
    assert word_bpe.encode(no_docs, PATH).count() == word_bpe.digests(no_docs, PATH).count() == 0


def test_query_equals_the_library(spark, real, library):
    got = {r.doc_id: r for r in QUERIES["op12_word_bpe"](spark, "/root/testdata/sf0.001").collect()}
    rows = real.collect()
    assert len(got) == len(rows)
    for row in rows:
        ids = library.encode(row.text or "", add_special_tokens=False).ids
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        text = library.decode(ids, skip_special_tokens=False)
        mine = got[row.doc_id]
        assert (mine.n_tokens, mine.ids_sha256) == (len(ids), hashlib.sha256(raw).hexdigest())
        assert mine.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
