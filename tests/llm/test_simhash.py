from __future__ import annotations

import itertools
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from siftwell.llm import simhash as sh

from .conftest import ODD, prose


def ints(n, seed=0):
    return np.random.default_rng(seed).integers(0, 1 << 63, n, dtype=np.int64)


def planted(n, seed=1):
    """Fingerprints of which many lie at chosen distances from others."""
    r, g = random.Random(seed), np.random.default_rng(seed)
    rows = [(int(a), int(b)) for a, b in g.integers(-(1 << 63), 1 << 63, (n, 2), dtype=np.int64)]
    for d in range(0, 40):
        for _ in range(6):
            bits = int.from_bytes((rows[r.randrange(n)][0] & (1 << 64) - 1).to_bytes(8, "big") + (rows[r.randrange(n)][1] & (1 << 64) - 1).to_bytes(8, "big"), "big")
            near = bits
            for k in r.sample(range(128), d):
                near ^= 1 << k
            for v in (bits, near):
                rows.append(tuple(x - (1 << 64) if x >> 63 else x for x in (v >> 64, v & (1 << 64) - 1)))
    return [(i, *x) for i, x in enumerate(dict.fromkeys(rows))]


def brute(rows):
    bits = [((h & (1 << 64) - 1) << 64 | lo & (1 << 64) - 1) for _, h, lo in rows]
    return {(i, j, d) for i in range(len(rows)) for j in range(i + 1, len(rows)) if (d := (bits[i] ^ bits[j]).bit_count()) <= sh.LIMIT}


def test_tree_search_equals_brute_force():
    g = np.random.default_rng(0)
    home, query = np.unique(g.integers(0, 65536, 3000).astype(np.uint16)), np.unique(g.integers(0, 65536, 900).astype(np.uint16))
    q, h = sh.tree_pairs(home, query)
    want = np.argwhere(np.bitwise_count(query[:, None] ^ home[None]) <= sh.RADIUS)
    assert sorted(zip(q.tolist(), h.tolist())) == [tuple(x) for x in want.tolist()]
    assert sorted(zip(*map(np.ndarray.tolist, sh.tree_pairs(home[:1], query)))) == sorted((int(i), 0) for i in np.flatnonzero(np.bitwise_count(query ^ home[0]) <= 2))


@pytest.mark.parametrize("size", [None, 150])
def test_pairs_equal_brute_force_at_every_level(spark, monkeypatch, size):
    """Also where shards are divided."""
    if size:
        monkeypatch.setattr(sh, "SHARD_ROWS", size)
    rows = planted(200)
    d = spark.createDataFrame(rows, "rep bigint, hi bigint, lo bigint")
    want = brute(rows)
    assert {x[2] for x in want} >= set(range(1, 24)) and len(want) > 150
    for levels in (1, 2) if size else (1, 2, 3, 4):
        got = [tuple(r) for r in sh.near_pairs(d, levels).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_rows_of_a_fingerprint_by_level():
    """Distances to the vantage points are all even or all odd, so steps of mixed parity would visit empty cells."""
    g = np.random.default_rng(3)
    x = g.integers(0, 65536, 5000).astype(np.uint16)
    d = np.stack([np.bitwise_count(x ^ np.uint16(v)) for v in sh.VANTAGES])
    assert ((d % 2) == (d[0] % 2)).all()
    for levels, rows in ((1, 24), (2, 56), (3, 144), (4, 392)):
        steps = [s for s in itertools.product(range(-2, 3), repeat=levels) if s >= (0,) * levels and len({y % 2 for y in s}) == 1]
        assert 8 * len(steps) == rows


def test_a_pair_of_several_blocks_is_told_once():
    rows = [(i, 0, i) for i in range(60)]
    rep, hi, lo = (np.array(c, np.int64) for c in zip(*rows))
    found = [p for b in range(8) for f in sh.shard_pairs(b, rep, hi, lo, np.zeros(60, bool)) for p in zip(*(c.tolist() for c in f))]
    assert len(found) == len(set(found)) == 60 * 59 // 2


def test_memory_of_a_shard():
    """A shard of few values, as of texts with much in common, is compared in small parts."""
    g = np.random.default_rng(4)
    n = 6000
    hi = g.integers(0, 40, n, dtype=np.int64) << 48 | g.integers(0, 1 << 48, n, dtype=np.int64)
    tracemalloc.start()
    found = sum(len(f[0]) for f in sh.shard_pairs(0, np.arange(n), hi, ints(n, 5), np.arange(n) % 3 > 0))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found < 100 and peak < 30e6


def test_search_holds_no_visitors():
    """Visitors are read in batches after a shard's own fingerprints, from a stream of several shards."""
    rows = planted(120)
    rep, hi, lo = (np.array(c, np.int64) for c in zip(*rows))
    value = sh.block_values(hi.view(np.uint64), lo.view(np.uint64), 0).astype(np.int64)
    visits = (np.arange(len(rep)) % 4 > 0).astype(np.int64)
    order = np.lexsort((value, visits))
    zero = np.zeros(len(rep), np.int64)

    def batches():
        for shard in (0, 8):
            place = (((shard * 2 + visits) << 16) + value)[order]
            table = pa.table({"place": place, "rep": rep[order], "hi": hi[order], "lo": lo[order], "n": zero, "parity": zero})
            yield from table.to_batches(max_chunksize=7)

    want = [p for f in sh.shard_pairs(0, rep, hi, lo, visits > 0) for p in zip(*(c.tolist() for c in f))]
    got = [p for f in sh.search(batches()) for p in zip(*(c.tolist() for c in f))]
    assert len(want) > 10 and sorted(got) == sorted(want * 2)


def test_components(spark):
    r = random.Random(2)
    edges = [(a, b) for a, b in ((r.randrange(300), r.randrange(300)) for _ in range(180)) if a != b] + [(1000 + i, 1001 + i) for i in range(40)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {n.node: n.root for n in sh.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for x in root}


def test_word_table_that_is_emptied(monkeypatch):
    texts = [prose(i, 60) for i in range(20)]
    want = sh.fingerprints_of(texts, sh.Words())
    monkeypatch.setattr(sh, "CACHE_WORDS", 50)
    words = sh.Words()
    assert [sh.fingerprints_of([t], words)[0] for t in texts] == want


def change(text, share, seed):
    r = random.Random(seed)
    return " ".join(f"new{r.randrange(10**6)}" if r.random() < share else w for w in text.split())


def test_near_copies_and_clean_documents(docs):
    base = {i: prose(i, 200 + 10 * i) for i in range(40)}
    rows = [*base.items()] + [(100 + i, change(t, 0.04, i)) for i, t in base.items()] + [(200 + i, t.upper() + "!") for i, t in base.items()]
    got = sh.groups(docs(rows)).collect()
    near = sum(100 + r.group_id in r.doc_ids for r in got)
    assert {r.group_id for r in got} == set(base) and near >= 36
    assert all({r.group_id, 200 + r.group_id} <= {*r.doc_ids} <= {r.group_id, 100 + r.group_id, 200 + r.group_id} for r in got)
    kept = {r.doc_id for r in sh.deduplicated(docs(rows)).collect()}
    assert set(base) <= kept and not kept & {200 + i for i in base}


def short_texts():
    """Pairs of texts of 6 to 16 words of which half are the same, with fingerprints within the limit; found by trying."""
    r, out = random.Random(11), []
    while len(out) < 3:
        same = [f"s{r.randrange(10**6)}" for _ in range(r.randrange(4, 9))]
        a, b = (" ".join(same + [f"o{r.randrange(10**6)}" for _ in range(len(same) - 1)]) for _ in range(2))
        x, y = (int.from_bytes(f, "big") for f in sh.fingerprints_of([a, b], sh.Words()))
        if (x ^ y).bit_count() <= sh.LIMIT:
            out.append((a, b))
    return out


def test_short_texts_that_share_a_line_stay(docs):
    pairs = short_texts()
    rows = [(10 * i + k, t) for i, p in enumerate(pairs) for k, t in enumerate(p)] + [(100, pairs[0][0].upper())]
    assert {tuple(r.doc_ids) for r in sh.groups(docs(rows)).collect()} == {(0, 100)}
    assert {r.doc_id for r in sh.deduplicated(docs(rows)).collect()} == {0, 1, 10, 11, 20, 21}


def test_pairs_that_share_too_few_words_go_before_confirmation(docs):
    """Numbers of words and parities leave out no pair that shares enough."""
    r = random.Random(5)
    for _ in range(200):
        x = {f"a{r.randrange(10**6)}" for _ in range(r.randrange(1, 60))}
        y = {w for w in x if r.random() < 0.85} | {f"b{r.randrange(10**6)}" for _ in range(r.randrange(0, 8))}
        (_, n, p), (_, m, q) = sh.marked([" ".join(x), " ".join(y)], sh.Words()) if y else [("", 0, b"")] * 2
        apart = (int.from_bytes(p) ^ int.from_bytes(q)).bit_count()
        assert max(abs(n - m), apart) <= len(x ^ y) or not y
        assert len(x & y) < sh.SHARED * len(x | y) or max(abs(n - m), apart) <= sh.UNLIKE * (n + m)
    pairs = short_texts()
    rows = [(10 * i + k, t) for i, p in enumerate(pairs) for k, t in enumerate(p)] + [(100, pairs[0][0].upper() + "!")]
    marks = sh.fingerprints(docs(rows)).withColumnRenamed("doc_id", "rep")
    assert sh.near_pairs(marks.select("rep", "hi", "lo")).count() >= 4
    got = {(p.a, p.b) for p in sh.near_pairs(marks).collect()}
    assert (0, 100) in got and len(got) < 4


def test_a_cluster_is_linked_once(docs):
    """A cluster of n unlike near copies needs no n * n confirmed pairs."""
    text = prose(9, 200)
    d = docs([(i, change(text, 0.01, i) if i else text) for i in range(40)])
    pairs = sh.near_pairs(sh.fingerprints(d).withColumnRenamed("doc_id", "rep"))
    links = sh.confirmed(d, pairs)
    assert pairs.count() > 300 and links.count() < 40
    assert {(x.node, x.root) for x in sh.components(links).collect()} == {(x.node, x.root) for x in sh.components(pairs).collect()}


def test_confirmation_in_divisions(docs, monkeypatch):
    """Groups are the same however few documents are held at once."""
    base = {i: prose(i, 150) for i in range(6)}
    rows = [(20 * i + k, change(t, 0.02, 20 * i + k) if k else t) for i, t in base.items() for k in range(8)]
    want = {tuple(r.doc_ids) for r in sh.groups(docs(rows)).collect()}
    monkeypatch.setattr(sh, "TOGETHER", 3)
    assert {tuple(r.doc_ids) for r in sh.groups(docs(rows)).collect()} == want and len(want) == 6


def test_one_python_worker_for_each_task(docs, monkeypatch):
    """No step runs two Python operators in one task, which would take two workers for each core, and keep both."""
    plans, real = [], sh.checkpointed
    monkeypatch.setattr(sh, "checkpointed", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df))
    sh.groups(docs([(i, change(prose(3, 100), 0.01, i)) for i in range(5)])).count()
    steps = [part.count("MapInArrow") for plan in plans for part in plan.split("Exchange")]
    assert max(steps) == 1


def test_large_group(docs):
    text = prose(7, 120)
    rows = [(i, text) for i in range(500)] + [(1000 + i, change(text, 0.02, i)) for i in range(200)]
    got = sh.groups(docs(rows)).collect()
    assert len(got) == 1 and got[0].n_docs >= 690 and got[0].doc_ids == sorted(got[0].doc_ids)
    assert sh.deduplicated(docs(rows)).count() == 700 - got[0].n_docs + 1


def test_columns_that_clash(spark):
    text = prose(5, 60)
    d = spark.createDataFrame([(i, text, i, "r", 1, 2, 3) for i in range(3)], "doc_id bigint, text string, root int, rep string, hi int, node int, words int")
    assert [r.doc_ids for r in sh.groups(d).collect()] == [[0, 1, 2]] and [tuple(r) for r in sh.deduplicated(d).collect()] == [(0, text, 0, "r", 1, 2, 3)]


def test_odd_rows(docs):
    rows = [*enumerate(ODD), (3, "x"), (20, "x"), (21, None), (21, None), (None, "x"), (None, "x"), (22, prose(1, 50)), (22, prose(2, 50))]
    d = docs(rows)
    assert {tuple(r.doc_ids) for r in sh.groups(d).collect()} == {(3, 3, 20), (22, 22)}
    kept = sh.deduplicated(d)
    ids = sorted(-1 if r.doc_id is None else r.doc_id for r in kept.collect())
    assert kept.columns == d.columns
    assert ids == sorted([*range(len(ODD)), 21, 21, -1, -1, 22, 22])
    empty = d.where("false")
    assert sh.groups(empty).count() == 0 and sh.deduplicated(empty).count() == 0
