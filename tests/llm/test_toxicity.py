from __future__ import annotations

import math
import random

from siftwell.llm import toxicity as tox

from .conftest import ODD, prose


def maximal(scores):
    """All maximal scoring segments by their definition: best of what is left, again and again."""
    out = []

    def rec(a, b):
        best = None
        for i in range(a, b):
            total = 0.0
            for j in range(i, b):
                total += scores[j]
                if total > 0 and (best is None or total > best[0] + 1e-9):
                    best = (total, i, j)
        if best:
            _, i, j = best
            rec(a, i)
            out.append((i, j, best[0]))
            rec(j + 1, b)

    rec(0, len(scores))
    return out


def test_linear_scan_equals_the_definition():
    r = random.Random(1)
    for _ in range(400):
        n = r.randrange(1, 30)
        at = sorted(r.sample(range(n), r.randrange(0, n // 2 + 1)))
        s = [r.uniform(0.5, 4) for _ in at]
        scores = [-0.8] * n
        for i, x in zip(at, s):
            scores[i] = x
        got, want = tox.segments(at, s, -0.8), maximal(scores)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert all(math.isclose(x[2], y[2], abs_tol=1e-9) for x, y in zip(got, want))


def corpus(n=400, toxic=60):
    r, rows, labels = random.Random(3), [], []
    for i in range(n):
        w = prose(i, 150, 600).split()
        if i < toxic:
            for k in range(4):
                w[r.randrange(len(w))] = r.choice(["vile", "scummy"]) if k % 2 else "dreck" + r.choice("abcdefghijklmnop") * 3
        rows.append((i, " ".join(w)))
        labels.append((i, int(i < toxic)))
    return rows, labels


def test_held_out_documents(spark, docs):
    rows, labels = corpus()
    known = spark.createDataFrame([x for x in labels if x[0] % 2], "doc_id bigint, toxic int")
    model = tox.train(docs(rows), known)
    assert {"vile", "scummy"} <= set(model.words) and any("dreck".startswith(s[:5]) for s in model.stems)
    found = {r.doc_id for r in tox.find(docs(rows), model).collect()}
    assert len(found & set(range(60))) >= 57 and len(found - set(range(60))) <= 3
    unseen = docs([(900, prose(9, 50) + " dreckzzz dreckyy vile " + prose(10, 50)), (901, prose(11, 100))])
    got = tox.find(unseen, model).collect()
    assert [r.doc_id for r in got] == [900] and got[0].n_segments >= 1
    s, text = got[0].segments[0], unseen.first().text
    assert text[s.start : s.end].startswith("dreck") and text[s.start : s.end].endswith("vile")


def test_real_labels(tables):
    docs, labels = tables("documents"), tables("labels")
    model = tox.train(docs, labels)
    clean = labels.where("toxic = 0")
    flagged = tox.find(docs, model).join(clean, "doc_id", "left_semi").count()
    assert flagged <= 0.05 * clean.count() + 1


def test_lambda_solves_its_equation(spark, docs):
    rows, labels = corpus(200, 40)
    m = tox.train(docs(rows), spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    assert 0.5 < m.lam < 2 and 0 < m.k <= 1 and m.other < 0


def test_p_values():
    m = tox.Model(lam=1.0, k=0.1, alpha=0.01)
    assert tox.document_p(m, 100, []) == 1.0
    weak = tox.document_p(m, 100, [6.0])
    assert tox.document_p(m, 100, [6.0, 6.0]) < weak < 1 and tox.document_p(m, 10_000, [6.0]) > weak


def test_odd_rows(spark, docs):
    model = tox.Model(words={"x": 20.0, "lorem": 20.0}, stems={})
    rows = [*enumerate(ODD), (3, "x"), (None, "so x it is")]
    d = docs(rows)
    got = tox.find(d, model).collect()
    assert sorted(map(str, (r.doc_id for r in got))) == ["3", "3", "6", "None"]
    left = tox.clean(d, model)
    assert left.columns == d.columns and {r.doc_id for r in left.collect()} == {0, 1, 2, 4, 5, 7}
    assert tox.find(d.where("false"), model).count() == 0
    labels = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert tox.find(d, tox.train(d, labels)).count() == 0
    one = spark.createDataFrame([(3, 1), (3, 0), (None, 1), (7, None)], "doc_id bigint, toxic int")
    assert tox.find(d, tox.train(d, one)).count() == 0
