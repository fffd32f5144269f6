import hashlib
import os
import random

import numpy as np
import pytest

from tidemark.llm import bpe

tokenizers = pytest.importorskip("tokenizers")
pytestmark = pytest.mark.skipif(not os.path.exists(bpe.TOKENIZER), reason="no vocabulary file")


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(bpe.TOKENIZER)
    t.no_truncation(), t.no_padding()
    return t


@pytest.fixture(scope="module")
def spec():
    return bpe.tables(bpe.TOKENIZER)


def test_encodes_as_the_library(library, spec):
    encoder, rnd = bpe.Encoder(spec), random.Random(3)
    letters = list("abcdefghijklmnopqrstuvwxyzaeiouaeiou")
    other = list("ABC  \n\t .,'!?-_0129éñßΣςİﬁ中😀́ ") + ["'s", "'LL", "<|startoftext|>", "<|endoftext|>", "</w>", "ing", "the "]
    for n in range(6000):
        pool = letters if n % 2 else letters + other
        text = rnd.choice(["aa", "the", "er", "!"]) * rnd.randrange(1, 12) if n % 7 == 0 else "".join(rnd.choice(pool) for _ in range(rnd.randrange(40)))
        assert encoder.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_compatible_pairs_are_those_that_merging_keeps(library, spec):
    encoder, rnd = bpe.Encoder(spec), random.Random(4)
    names = {i: t for t, i in spec["vocab"].items()}
    plain = [i for i, t in names.items() if t.isascii() and t.isalpha() and t.islower() and not t.endswith("</w>")]
    ends = [i for i, t in names.items() if t.endswith("</w>") and t[:-4].isascii() and t[:-4].isalpha() and t[:-4].islower()]
    for _ in range(4000):
        a, b = rnd.choice(plain), rnd.choice(ends)
        ids = library.encode(names[a] + names[b][:-4], add_special_tokens=False).ids
        alone = library.encode(names[b][:-4], add_special_tokens=False).ids == [b]
        if alone and len(ids) == 2:
            assert encoder.compatible(a, b) == (ids == [a, b])


def test_decodes_as_the_library(library, spec):
    decoder, rnd = bpe.Decoder(spec), random.Random(5)
    for n in (0, 1, 7, 200_000):
        ids = [rnd.randrange(49408) for _ in range(n)]
        want = library.decode(ids, skip_special_tokens=False)
        assert (decoder.decode(np.array(ids, np.int32)) if n else b"") == want.encode()


def test_round_trip_digests(docs, odd, library):
    got = {r.doc_id: r for r in bpe.round_trip(docs(odd, extra=True)).collect()}
    assert len(got) == len(odd)
    for i, text in odd.items():
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_operators_keep_columns_and_agree(docs, odd):
    df = docs(odd).withColumnRenamed("source", "lang")
    both = bpe.decode(bpe.encode(df)).collect()
    digests = {r.doc_id: r for r in bpe.round_trip(df).collect()}
    for r in both:
        assert r.lang == "a" and len(r.ids) == digests[r.doc_id].n_tokens
        assert hashlib.sha256(r.decoded.encode()).hexdigest() == digests[r.doc_id].decoded_sha256
    assert bpe.round_trip(df.limit(0)).count() == 0
