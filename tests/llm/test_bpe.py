from __future__ import annotations

import os
import random
import tracemalloc

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from siftwell.llm import bpe

from .conftest import ODD

pytestmark = pytest.mark.skipif(not os.path.exists(bpe.VOCABULARY), reason="no vocabulary here")


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder.load()


@pytest.fixture(scope="module")
def known(encoder):
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=encoder.ranks, special_tokens={})


def ids(codes):
    return np.frombuffer(codes, np.int32).tolist()


def test_every_token_was_merged_from_two(encoder):
    assert all(len(v) == 2 for v in encoder.splits.values())


@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.text(max_size=60), max_size=4))
def test_equals_merging(encoder, known, texts):
    for text, codes in zip(texts, encoder.encode(texts)):
        assert ids(codes) == known.encode_ordinary(text)
        assert encoder.decode(ids(codes)) == text


def test_shared_prefixes(encoder):
    """Words that are prefixes of each other, merged one by one."""
    r = random.Random(4)
    words = {"".join(r.choice("theanr ion") for _ in range(r.randrange(1, 14))).encode() for _ in range(3000)}
    words |= {w[:k] for w in list(words)[:300] for k in range(1, len(w))}
    for w, codes in encoder.encode_words(words).items():
        assert ids(codes) == encoder.merged(w)


def test_documents(encoder, known, tables):
    rows = bpe.encode(tables("documents"), check=True, drop_text=False).collect()
    assert len(rows) == tables("documents").count() and all(r.round_trip for r in rows)
    for r in rows[:60]:
        assert r.token_ids == known.encode_ordinary(r.text) and r.n_tokens == len(r.token_ids)


def test_odd_documents(docs):
    rows = [*enumerate(ODD), (3, "x"), (None, "y")]
    d = docs(rows).withColumnRenamed("segments", "n_tokens")
    got = bpe.encode(d, check=True).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and (by[0].token_ids, by[0].n_tokens, by[0].round_trip) == (None, None, None) and by[1].token_ids == []
    assert all(r.round_trip in (True, None) for r in got) and "text" not in got[0].asDict()
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(d)).collect()}
    assert back == dict(rows)
    assert bpe.encode(d.where("false")).count() == 0


def test_unknown_ids_raise(encoder):
    with pytest.raises(KeyError):
        encoder.decode([99_999_999])


def test_pieces_held_at_once(encoder):
    """Pieces of a batch's texts aren't all held together; the ids are those of each text alone."""
    texts = [" ".join(f"w{(7 * i + k) % 90} of" for k in range(25_000)) for i in range(20)]
    alone = encoder.encode(texts[:1])
    tracemalloc.start()
    try:
        codes = encoder.encode(texts)
        peak = tracemalloc.get_traced_memory()[1] - sum(map(len, codes))
    finally:
        tracemalloc.stop()
    assert codes[0] == alone[0] and peak < 40e6
