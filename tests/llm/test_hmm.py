from __future__ import annotations

import itertools
import math
import re

import numpy as np

from siftwell.llm import hmm

from .conftest import ODD, prose


def params(states=3, symbols=5, seed=0):
    r = np.random.default_rng(seed)
    n = lambda x, axis: x / x.sum(axis=axis, keepdims=True)
    return hmm.Parameters(n(r.random(states), 0), n(r.random((states, states)), 1), n(r.random((symbols, states)), 0))


def brute(p, s):
    total = 0.0
    for path in itertools.product(range(len(p.start)), repeat=len(s)):
        x = p.start[path[0]] * p.emit[s[0], path[0]]
        for t in range(1, len(s)):
            x *= p.move[path[t - 1], path[t]] * p.emit[s[t], path[t]]
        total += x
    return math.log(total)


def test_forward_equals_the_sum_over_all_paths():
    p, r = params(), np.random.default_rng(1)
    seqs = [r.integers(0, 5, n).astype(np.int32) for n in (6, 1, 4, 0, 3, 6)]
    got = hmm.forward(p, seqs)
    assert np.allclose(got, [brute(p, s) if len(s) else 0 for s in seqs])


def test_expected_counts_equal_posteriors_over_all_paths():
    p, s = params(2, 3), np.array([0, 2, 1, 2], np.int32)
    start, move, emit = np.zeros(2), np.zeros((2, 2)), np.zeros((3, 2))
    log = hmm.expected(p, [s, s[:0]], start, move, emit)
    want_move, want_emit, want_start = np.zeros((2, 2)), np.zeros((3, 2)), np.zeros(2)
    for path in itertools.product(range(2), repeat=4):
        x = p.start[path[0]] * np.prod([p.emit[s[t], path[t]] for t in range(4)]) * np.prod([p.move[path[t], path[t + 1]] for t in range(3)]) / math.exp(log)
        want_start[path[0]] += x
        for t in range(4):
            want_emit[s[t], path[t]] += x
        for t in range(3):
            want_move[path[t], path[t + 1]] += x
    assert math.isclose(log, brute(p, s))
    assert np.allclose(move, want_move) and np.allclose(emit, want_emit) and np.allclose(start, want_start)


def plainly(p, s):
    """Expected counts and likelihood of one sequence, step by step over the whole of it."""
    alpha, scale = [], []
    for t, w in enumerate(s):
        x = (p.start if not t else alpha[-1] @ p.move) * p.emit[w]
        scale.append(x.sum())
        alpha.append(x / scale[-1])
    beta, move, emit = np.ones(len(p.start)), np.zeros_like(p.move), np.zeros_like(p.emit)
    for t in range(len(s) - 1, -1, -1):
        emit[s[t]] += alpha[t] * beta
        start = alpha[t] * beta
        ahead = p.emit[s[t]] * beta / scale[t]
        if t:
            move += np.outer(alpha[t - 1], ahead) * p.move
        beta = p.move @ ahead
    return start, move, emit, float(np.log(scale).sum())


def test_segments_change_nothing(monkeypatch):
    """Messages are carried over the cuts: counts and likelihoods are those of whole documents."""
    p, r = params(4, 9, 5), np.random.default_rng(6)
    seqs = [r.integers(0, 9, n).astype(np.int32) for n in (1, 300, 7, 0, 64, 65, 8, 129, 2000, 15)]
    want = [np.zeros(4), np.zeros((4, 4)), np.zeros((9, 4)), 0.0]
    for s in seqs:
        if len(s):
            want = [a + b for a, b in zip(want, plainly(p, s))]
    for size in (1, 2, 7, 64, 10_000):
        monkeypatch.setattr(hmm, "SEGMENT", size)
        start, move, emit = np.zeros(4), np.zeros((4, 4)), np.zeros((9, 4))
        log = hmm.expected(p, seqs, start, move, emit)
        assert math.isclose(log, want[3]) and np.allclose(start, want[0]) and np.allclose(move, want[1]) and np.allclose(emit, want[2]), size
        assert np.allclose(hmm.forward(p, seqs), [plainly(p, s)[3] if len(s) else 0 for s in seqs])
    assert math.isclose(start.sum(), 9) and math.isclose(move.sum(), sum(len(s) - 1 for s in seqs if len(s)))


def emissions(model):
    """Emission of every symbol, gathered from the buckets."""
    k = len(model.shape.start)
    rows = [np.frombuffer(r.counts, np.float32).reshape(-1, k) for r in model.state.collect()]
    return np.concatenate([model.shape.rare[None], (np.concatenate(rows) + hmm.FLOOR) / model.shape.sums])


def test_likelihood_grows_until_it_hardly_does(docs):
    rows = [(i, " ".join(("ab cd ef gh" if i % 2 else "uv wx yz uv").split() * 20) + " " + prose(i, 20, 30)) for i in range(30)]
    model, history = hmm.train(docs(rows), states=3)
    assert all(b > a for a, b in zip(history, history[1:])) and 2 < len(history) < 20
    assert history[-1] - history[-2] < 2e-3 * abs(history[-1]) and history[-2] - history[-3] >= 2e-3 * abs(history[-2])
    assert np.allclose(emissions(model).sum(axis=0), 1) and np.allclose(model.shape.move.sum(axis=1), 1) and math.isclose(model.shape.start.sum(), 1)


def test_scores_equal_a_model_in_one_place(docs, monkeypatch):
    """Two iterations and the scores, computed directly with one table; blocks, buckets and segments of any size give the same."""
    rows = [(i, prose(i, 30 + i, 40) + f" once{i}") for i in range(25)] + [(90, ""), (91, None)]
    texts = [t.split() if t else [] for _, t in rows]
    counts = {}
    for w in itertools.chain(*texts):
        counts[w] = counts.get(w, 0) + 1
    symbols = sorted(w for w, n in counts.items() if n >= 2)
    ids = {w: i for i, w in enumerate(symbols, 1)}
    seqs = [np.array([ids.get(w, 0) for w in t], np.int32) for t in texts]
    first = hmm.first_counts(symbols, np.array([counts[w] for w in symbols], float), 3, 1)
    rare = sum(n for n in counts.values() if n < 2) + 1.0
    emit = np.concatenate([np.full((1, 3), rare), first]) + hmm.FLOOR
    p = hmm.Parameters(np.full(3, 1 / 3), np.full((3, 3), 0.2 / 3) + 0.8 * np.eye(3), emit / emit.sum(axis=0))
    for _ in range(2):
        new = [np.full(3, hmm.FLOOR), np.full((3, 3), hmm.FLOOR), np.full(p.emit.shape, hmm.FLOOR)]
        for s in seqs:
            if len(s):
                new = [a + b for a, b in zip(new, plainly(p, s)[:3])]
        p = hmm.Parameters(new[0] / new[0].sum(), new[1] / new[1].sum(axis=1, keepdims=True), new[2] / new[2].sum(axis=0))
    pairs = np.zeros(65536)
    for w, n in counts.items():
        b = f" {w} ".encode()
        for x, y in zip(b, b[1:]):
            pairs[x << 8 | y] += n
    spelling = hmm.Spelling(pairs)
    spelling.without(float(np.exp(spelling.each(symbols)).sum()))
    want = {i: (plainly(p, s)[3] + sum(spelling.each([w])[0] for w in t if w not in ids) if t else 0.0) for (i, _), s, t in zip(rows, seqs, texts)}
    for block, edges, segment, pool in ((2_000_000, 200_000, 512, 1_000_000), (100, 50, 16, 90), (1, 7, 5, 1)):
        for name, v in (("BLOCK_WORDS", block), ("EDGES", edges), ("SEGMENT", segment), ("POOL", pool)):
            monkeypatch.setattr(hmm, name, v)
        got = {r.doc_id: r.log_likelihood for r in hmm.score(docs(rows), states=3, iterations=2, tolerance=0).collect()}
        assert set(got) == set(want) and all(math.isclose(got[i], want[i], rel_tol=1e-5, abs_tol=1e-9) for i in want), (block, edges)


def test_what_is_gathered_grows_with_the_corpus(docs):
    """Every word that occurs twice is a symbol, however rare it is among all."""
    rows = [(i, prose(i, 3000, 900) + f" pair{i // 2}") for i in range(40)]
    model, _ = hmm.train(docs(rows), states=2, iterations=1)
    assert len(emissions(model)) - 1 >= 900 + 20


def test_spellings_are_a_distribution():
    """Over all words of two letters and their symbols the probabilities of a closed alphabet sum to 1."""
    pairs = np.zeros(65536)
    for a, b in ((32, 97), (97, 98), (98, 32), (97, 32)):
        pairs[a << 8 | b] = 10
    bare = hmm.Spelling(pairs)
    s = hmm.Spelling(pairs).without(float(np.exp(bare.each(["ab"])).sum()))
    assert math.exp(s.each(["a"])[0]) < 1 and s.rest < 0
    assert np.allclose(s.each(["a", "ab"]) + s.rest, bare.each(["a", "ab"]))


def test_words_equal_those_of_a_pattern():
    import pyarrow as pa

    texts = [*ODD[:6], "Größe_1 ÉTÉ 漢字 x²½Ⅷ a\u0301b don't  end.", " lead", "one", "ab cd"]
    words, lengths = hmm.words_in(pa.array(texts, pa.string()))
    want = [re.findall(r"\w+", t.lower()) if t else [] for t in texts]
    got = np.split(np.array(words.to_pylist(), object), np.cumsum(lengths)[:-1])
    assert lengths.tolist() == [len(w) for w in want]
    assert [[x.replace("i̇", "i") for x in w] for w in want if "i̇" not in "".join(w)] == [[*w] for w, v in zip(got, want) if "i̇" not in "".join(v)]


def test_odd_documents(docs):
    rows = [*enumerate(ODD), (3, "x"), (None, "x y"), (90, prose(1, 200))]
    got = hmm.score(docs(rows), states=2, iterations=1).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i in (0, 1, 2, 4):
        assert (by[i].n_words, by[i].log_likelihood, by[i].bits_per_word) == (0, 0.0, None)
    assert by[6].n_words == 60_000 and all(math.isfinite(r.log_likelihood) for r in got)
    assert len({r.log_likelihood for r in got if r.doc_id == 3}) == 1
    assert hmm.score(docs([]).where("false")).count() == 0


def test_columns_that_clash(spark):
    d = spark.createDataFrame([(i, prose(i, 40, 30), 5, "x", 1) for i in range(4)], "doc_id bigint, text string, n_words int, part string, block int")
    got = hmm.score(d, states=2, iterations=2)
    assert got.columns == ["doc_id", "n_words", "log_likelihood", "bits_per_word"] and {r.n_words for r in got.collect()} == {40}


def test_scores_do_not_depend_on_partitions(docs):
    d = docs([(i, prose(i, 50, 60)) for i in range(20)])
    one, five = ({r.doc_id: r.log_likelihood for r in hmm.score(x, states=2, iterations=2).collect()} for x in (d.coalesce(1), d.repartition(5)))
    assert set(one) == set(five) and all(math.isclose(one[i], five[i], rel_tol=1e-5) for i in one)


def test_blocks_stay_where_they_are(docs):
    model, _ = hmm.train(docs([(i, prose(i, 50, 60)) for i in range(20)]), states=2, iterations=1)
    plan = hmm.scores(model)._jdf.queryExecution().executedPlan().toString()
    # Only counts and emissions are exchanged, once each; blocks and buckets are read as they lie.
    assert plan.count("Exchange") == 2 and plan.count("Bucketed: true") == 2


def test_long_documents_keep_their_range(docs):
    """Hundreds of thousands of words in one chain, with words that one state alone gives."""
    rows = [(1, "aa " * 150_000 + "bb " * 150_000), (2, "bb cc " * 20_000), (3, prose(1, 500))]
    got = {r.doc_id: r for r in hmm.score(docs(rows), states=3).collect()}
    assert all(math.isfinite(r.log_likelihood) and r.log_likelihood < 0 for r in got.values()) and got[1].n_words == 300_000
    assert got[1].bits_per_word < 1.5 < got[3].bits_per_word
