import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from octetflow.llm.bpe import BytePairEncoder, bpe_decode, bpe_digests, bpe_encode, parse_ranks

NAMES = ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"]
MADE = {}


def both(name):
    if name not in MADE:
        ranks = parse_ranks(open(P.path(name), "rb").read())
        MADE[name] = BytePairEncoder(ranks, P.PATTERN), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return MADE[name]


@pytest.mark.parametrize("name", NAMES)
@given(text=st.text(max_size=400) | st.text(alphabet="abetionsrl ''stdSLL019.,\n\t ", max_size=400))
@settings(max_examples=300, deadline=None)
def test_same_ids_as_the_library(name, text):
    own, lib = both(name)
    ids = own.encode(text)
    assert ids == lib.encode_ordinary(text)
    assert own.decode(ids) == text.encode()


@pytest.mark.parametrize("name", NAMES)
def test_long_pieces(name):
    own, lib = both(name)
    r = random.Random(1)
    for t in ["a" * 50_000, "ab" * 5_000, "".join(r.choice("etaoin") for _ in range(20_000)), "".join(r.choice("éèçñüß漢字") for _ in range(3_000)), " " * 3_000 + "x", "<|endoftext|>"]:
        assert own.encode(t) == lib.encode_ordinary(t)


def test_tables(spark):
    own, lib = both(NAMES[0])
    rows = [(1, "Hello  world's\n\n 123 <|endoftext|>", "a"), (2, None, "b"), (3, "", None), (None, "x", "c"), (1, "Hello", "d"), (4, "word " * 30_000, "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = bpe_digests(df).collect()
    assert len(got) == len(rows)
    for r, (i, t, _) in zip(sorted(got, key=str), sorted([(i, t, None) for i, t, _ in rows], key=lambda x: str([r for r in got if r.doc_id == x[0] and r.n_tokens == len(lib.encode_ordinary(x[1] or ""))][0])), strict=True):
        ids = lib.encode_ordinary(t or "")
        assert (r.doc_id, r.n_tokens) == (i, len(ids))
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    back = bpe_decode(bpe_encode(df)).collect()
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in back) and len(back) == len(rows)
    assert bpe_digests(df.limit(0)).count() == 0
