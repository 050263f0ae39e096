"""The pair index against the public tokenizers library, and the operator's edge cases."""

import hashlib
import random

import pytest

tokenizers = pytest.importorskip("tokenizers")
pytest.importorskip("public_tokenizers")

from strandloom.llm.bpe import PairIndexBPE, default_vocabulary, encode  # noqa: E402


@pytest.fixture(scope="module")
def ours():
    return PairIndexBPE(default_vocabulary())


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(default_vocabulary())


def test_random_unicode_and_special_tokens(ours, library):
    random.seed(7)
    pool = [chr(c) for c in [*range(0x250), *range(0x300, 0x330), *range(0x2000, 0x2070), 0x3000, 0x1680, *range(0x4E00, 0x4E10), *range(0x1F600, 0x1F608), 0x661, 0x2160, 0xBD]]
    texts = ["".join(random.choice(pool) for _ in range(random.randint(0, 60))) for _ in range(1500)]
    texts += ["", " ", "a" * 5000, "<|endoftext|>a <|endoftext|><|endoftext|>", "  x \n\n y 's 'll I'VE ", "ab" * 3000]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    got = ours.encode_batch(texts)
    assert got == want
    assert [ours.decode(x) for x in got] == [library.decode(x, skip_special_tokens=False) for x in want]


def test_broken_utf8_decodes_like_the_library(ours, library):
    random.seed(8)
    for _ in range(300):
        ids = [random.randrange(50257) for _ in range(12)]
        assert ours.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_operator_edges(spark, library):
    rows = [(1, None, "x"), (2, "", "x"), (3, "Hello  world\n", "x"), (3, "Hello  world\n", "x"), (None, "z" * 100_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    out = encode(docs).collect()
    assert len(out) == 5
    for r, (doc_id, text, _) in zip(sorted(out, key=lambda r: (r.doc_id is None, r.doc_id)), rows):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert (r.doc_id, list(r.ids), r.n_tokens) == (doc_id, ids, len(ids))
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert encode(docs.limit(0)).count() == 0
