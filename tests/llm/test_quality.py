from __future__ import annotations

import itertools
import os

import numpy as np

from siftwell.llm import quality as q

from .conftest import DATA, ODD


def test_marginals_equal_the_sum_over_all_labellings():
    r = np.random.default_rng(0)
    field = q.Field(np.zeros(1), r.normal(size=(2, 2)))
    count = np.array([3, 1, 5, 2])
    odds = r.normal(size=11)
    good, joint, log = q.marginals(field, odds, count)
    want, pairs, total, at = [], np.zeros((2, 2)), 0.0, 0
    for n in count:
        own = odds[at : at + n]
        weights = {y: np.exp(sum(own[i] * y[i] for i in range(n)) + sum(field.move[y[i], y[i + 1]] for i in range(n - 1))) for y in itertools.product((0, 1), repeat=int(n))}
        z = sum(weights.values())
        total += np.log(z)
        want += [sum(w for y, w in weights.items() if y[i]) / z for i in range(n)]
        for y, w in weights.items():
            for i in range(n - 1):
                pairs[y[i], y[i + 1]] += w / z
        at += n
    assert np.allclose(good, want) and np.allclose(joint, pairs) and np.isclose(log, total)


def test_fit_follows_the_gradient():
    r = np.random.default_rng(1)
    count = np.full(60, 4)
    label = np.repeat(r.integers(0, 2, 60), 4)
    x = np.stack([label + r.normal(0, 0.7, 240), np.ones(240)], axis=1)
    field = q.fit(x, count, label)
    good, joint, _ = q.marginals(field, x @ field.weights, count)
    assert np.abs(x.T @ (label - good) - field.weights).max() < 2
    assert ((good > 0.5) == label).mean() > 0.9 and field.move[0, 0] > field.move[0, 1]


def test_features():
    x, size, count = q.line_features(["Good line.\nGood line.\n", "é|é"])
    assert count.tolist() == [3, 1] and size.tolist() == [10, 10, 0, 3]
    again = 11
    assert x[:, again].tolist() == [0, 1, 0, 0] and x[0, -2] == 1 and x[2, -1] == 1 and x[3, -2] == x[3, -1] == 1
    assert np.allclose(x[1, q.OWN : 2 * q.OWN], x[0, : q.OWN]) and not x[0, q.OWN : 2 * q.OWN].any()


def test_held_out_accuracy(tables):
    labels = tables("labels")
    field = q.train(tables("documents"), labels.where("doc_id % 2 = 0"))
    rows = q.assess(tables("documents"), field).join(labels.where("doc_id % 2 = 1"), "doc_id").select("keep", labels.quality.alias("label")).collect()
    good = [r.keep for r in rows if r.label == 1]
    assert sum(r.keep == bool(r.label) for r in rows) >= 0.9 * len(rows) and sum(good) >= 0.95 * len(good)


def test_lines_of_mixed_documents(spark, tables):
    """Held-out good and bad documents joined in both orders: their lines are told apart."""
    large = DATA.replace("sf0.001", "sf0.01")
    read = lambda t: spark.read.parquet(f"{large if os.path.isdir(large) else DATA}/{t}.parquet")
    labels = read("labels")
    field = q.train(read("documents"), labels.where("doc_id % 2 = 0"))
    rows = read("documents").join(labels.where("doc_id % 2 = 1"), "doc_id").where("length(trim(text)) > 0").orderBy("doc_id").collect()
    good, bad = ([r.text for r in rows if r.quality == k] for k in (1, 0))
    wrong = {1: [0, 0], 0: [0, 0]}
    for i, b in enumerate(bad):
        for g in good[i::50][:4]:
            parts = [(g, 1), (b, 0)][:: 1 - 2 * (i % 2)]
            x, size, count = q.line_features([parts[0][0] + "\n" + parts[1][0]])
            label = np.repeat([k for _, k in parts], [t.count("\n") + 1 for t, _ in parts])
            called = q.marginals(field, x @ field.weights, count)[0] >= 0.5
            for k in (0, 1):
                wrong[k][0] += size[(label == k) & (called != k)].sum()
                wrong[k][1] += size[label == k].sum()
    assert len(bad) > 5 and all(a <= 0.15 * n for a, n in wrong.values()), wrong
    assert field.move[0, 0] > field.move[0, 1] and field.move[1, 1] > field.move[1, 0]


def test_bounds_of_the_sample(spark, docs):
    rows = [(i, f"Good words stand here {i}.\nAnd here they end.") for i in range(20)] + [(20 + i, f"#$% {i} |||\n@@ ^^") for i in range(20)]
    labels = spark.createDataFrame([(i, int(i < 20)) for i in range(40)], "doc_id bigint, quality int")
    same = lambda a, b: np.array_equal(a.weights, b.weights)
    whole = q.train(docs(rows), labels)
    assert same(whole, q.train(docs(rows + [(0, "x " * 60_000)]), labels)) and not same(whole, q.train(docs(rows), labels, max_lines=40))
    assert not same(whole, q.train(docs(rows), labels, sample=25)) and q.train(docs(rows), labels, max_lines=3) is None


def test_odd_rows(spark, docs, tables):
    field = q.train(tables("documents"), tables("labels"))
    rows = [*enumerate(ODD), (3, "x"), (None, "A good line of words.\n" * 3)]
    got = q.assess(docs(rows), field).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    for i in (0, 1, 2):
        assert (by[i].quality, by[i].keep, by[i].bad_lines) == (None, False, [])
    assert by[0].n_lines == 0 and by[1].n_lines == 1 and not by[6].keep and len({r.quality for r in got if r.doc_id == 3}) == 1
    assert q.assess(docs(rows).where("false"), field).count() == 0


def test_columns_that_clash(spark):
    rows = [(i, "Good words stand here.\nAnd here." if i % 2 else "#$% |||\n@@ ^^", "q", 3, False) for i in range(20)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, quality string, n_lines int, keep boolean")
    field = q.train(d, spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id bigint, quality int"))
    assert {r.doc_id % 2 for r in q.assess(d, field).where("keep").collect()} == {1}


def test_labels_that_are_all_alike(spark, docs):
    rows = docs([(1, "a b"), (2, None), (3, "")])
    labels = lambda *x: spark.createDataFrame([*x], "doc_id bigint, quality int")
    assert q.train(rows, labels()) is None and q.train(rows, labels((1, 1), (2, 0), (None, 1), (3, None))) is None
    assert {r.doc_id: r.keep for r in q.assess(rows, None).collect()} == {1: True, 2: False, 3: False}


def test_every_document_has_a_row(tables):
    field = q.train(tables("documents"), tables("labels"))
    got = q.assess(tables("documents"), field)
    assert got.count() == tables("documents").count() and got.where("quality < 0 or quality > 1").count() == 0
