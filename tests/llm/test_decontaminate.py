from __future__ import annotations

import random

from siftwell.llm import decontaminate as dc

from .conftest import ODD, prose


def automaton(items):
    return dc.Automaton([(i, t.split()) for i, t in items])


def longest(items, words, end):
    """Longest passage of any item that ends at a word, by trying all."""
    best = 0
    for _, t in items:
        own = t.split()
        for j in range(len(own)):
            n = 0
            while n <= min(j, end) and own[j - n] == words[end - n]:
                n += 1
            best = max(best, n)
    return best


def test_matching_lengths_equal_brute_force():
    r = random.Random(1)
    for _ in range(150):
        items = [(i, " ".join(r.choice("abc") for _ in range(r.randrange(1, 9)))) for i in range(r.randrange(1, 5))]
        auto = automaton(items)
        words = [r.choice("abc") for _ in range(25)]
        got = [n for n, _ in auto.matches([auto.ids.get(w, -1) for w in words])]
        assert got == [longest(items, words, e) for e in range(25)]


def test_state_names_the_shortest_item():
    r = random.Random(2)
    for _ in range(150):
        items = [(i, " ".join(r.choice("ab") for _ in range(r.randrange(1, 9)))) for i in range(4)]
        auto = automaton(items)
        words = [r.choice("ab") for _ in range(20)]
        for e, (n, v) in enumerate(auto.matches([auto.ids.get(w, -1) for w in words])):
            if n:
                passage = words[e - n + 1 : e + 1]
                holders = [(len(t.split()), i) for i, t in items if any(t.split()[k : k + n] == passage for k in range(len(t.split())))]
                assert auto.item[v] == min(holders)


def test_hits_equal_brute_force_on_items_that_share_passages():
    """The longest passage that ends at each word and reaches a limit, by trying all."""
    r = random.Random(3)
    shorter = 0
    for _ in range(300):
        items = [(i, " ".join(r.choice("abc") for _ in range(r.randrange(2, 22)))) for i in range(r.randrange(2, 6))]
        auto = automaton(items)
        words = r.choice(items)[1].split()[:7] + [r.choice("abc") for _ in range(15)] + r.choice(items)[1].split()[2:]
        got = {h[0]: h[1:4] for h in dc.hits(auto, dc.Known(auto.ids), " ".join(words), (7, 3, 0.5))}
        for e in range(len(words)):
            want = None
            for n in range(e + 1, 2, -1):
                holders = [(len(t.split()), i) for i, t in items if f" {' '.join(words[e - n + 1 : e + 1])} " in f" {t} "]
                if holders and (n >= 7 or n >= 0.5 * min(holders)[0]):
                    want = (n, *min(holders))
                    break
            assert got.get(e) == want
            shorter += want is not None and want[0] < longest(items, words, e)
    assert shorter


def test_item_inside_a_longer_item(spark, docs):
    b = prose(6, 10)
    item = f"x {b} {prose(7, 30)}"
    assert dc.clean(docs([(1, f"so x {b} ends")]), bench(spark, (1, item), (2, b))).first().text == "so x \n ends"


def bench(spark, *rows):
    return spark.createDataFrame([*rows], "item_id bigint, text string, spans int" if rows and len(rows[0]) == 3 else "item_id bigint, text string")


def test_limits(spark, docs):
    item, short = prose(1, 40), prose(2, 15)
    w, s = item.split(), short.split()
    texts = {1: " ".join(["clean words"] * 20), 2: "before " + " ".join(w[3:16]) + " after", 3: "before " + " ".join(w[3:15]) + " after", 4: "x " + " ".join(s[2:10]) + " y", 5: "x " + " ".join(s[2:9]) + " y", 6: "Intro: " + ", ".join(w).upper() + "!"}
    got = {r.doc_id: r for r in dc.find(docs([*texts.items()]), bench(spark, (1, item), (2, short))).collect()}
    assert set(got) == {2, 4, 6}
    assert got[2].spans[0].n_words == 13 and got[4].spans[0].item_id == 2 and got[6].spans[0].coverage == 1.0
    left = {r.doc_id: (r.text, r.n_chars) for r in dc.clean(docs([*texts.items()]), bench(spark, (1, item), (2, short))).collect()}
    assert left[1] == (texts[1], len(texts[1])) and left[2] == ("before \n after", 14) and left[6][0] == "Intro: \n!"


def test_removal_leaves_nothing_over_the_limits(docs, tables):
    cleaned = dc.clean(tables("documents"), tables("benchmark"))
    assert cleaned.count() == tables("documents").count() and dc.find(cleaned, tables("benchmark")).count() == 0


def test_found_documents_equal_brute_force(tables):
    """A document is found if and only if it has 13 words of an item in a row, or 8 that are half of one."""
    items = [[dc.normalised(w) for w in dc.WORD.findall(r.text)] for r in tables("benchmark").collect()]
    grams = {tuple(w[k : k + n]) for w in items for n in {min(13, max(8, -(-len(w) // 2)))} for k in range(len(w) - n + 1)}
    want = set()
    for r in tables("documents").collect():
        w = [dc.normalised(x) for x in dc.WORD.findall(r.text)]
        if any(tuple(w[k : k + n]) in grams for n in range(8, 14) for k in range(len(w) - n + 1)):
            want.add(r.doc_id)
    assert {r.doc_id for r in dc.find(tables("documents"), tables("benchmark")).collect()} == want


def test_benchmark_in_parts(spark, docs, monkeypatch):
    monkeypatch.setattr(dc, "WORDS_PER_AUTOMATON", 30)
    a, b = prose(1, 20), prose(2, 20)
    assert len(dc.automata(bench(spark, (1, a), (2, b)))) == 2
    assert dc.clean(docs([(1, f"x {a} y {b} z")]), bench(spark, (1, a), (2, b))).first().text == "x \n y \n z"


def test_parts_give_what_one_automaton_gives(spark, docs, monkeypatch):
    """Items overlap, so that passages of several parts meet in a text, and one removal would hide another."""
    w = prose(4, 60).split()
    b = bench(spark, *((i, " ".join(w[k : k + 20])) for i, k in enumerate(range(0, 41, 10))), (9, prose(5, 16)))
    rows = [(1, " ".join(w)), (1, "a " + " ".join(w[:32]) + " b"), (None, " ".join(w[5:25]) + f" c {prose(5, 16)}"), (2, "clean"), (3, None)]
    as_rows = lambda df: sorted(map(repr, df.collect()))
    found, left = as_rows(dc.find(docs(rows), b)), as_rows(dc.clean(docs(rows), b))
    assert len(found) == 3
    for size in (20, 45, 70):
        monkeypatch.setattr(dc, "WORDS_PER_AUTOMATON", size)
        assert len(dc.automata(b)) > 1
        assert as_rows(dc.find(docs(rows), b)) == found and as_rows(dc.clean(docs(rows), b)) == left


def test_nothing_is_left_that_removals_bring_together(spark, docs, monkeypatch):
    """An item around another one: what is left of it forms a passage when the inner one has gone."""
    outer, inner = prose(11, 24).split(), prose(12, 15)
    text = " ".join(["so", *outer[:7], inner, *outer[7:14], "ends"])
    b = bench(spark, (1, " ".join(outer)), (2, inner))
    assert [len(r.spans) for r in dc.find(docs([(1, text)]), b).collect()] == [1]
    for size in (10**6, 20):
        monkeypatch.setattr(dc, "WORDS_PER_AUTOMATON", size)
        assert [r.text for r in dc.clean(docs([(1, text), (2, None), (3, "clean")]), b).orderBy("doc_id").collect()] == ["so \n ends", None, "clean"]


def test_random_texts_have_no_finding_after_cleaning():
    r = random.Random(8)
    again = 0
    for _ in range(400):
        items = [(i, " ".join(r.choice("abcd") for _ in range(r.randrange(2, 22)))) for i in range(r.randrange(2, 6))]
        auto, limits = automaton(items), (7, 3, 0.5)
        known = dc.Known(auto.ids)
        text = " ".join(r.choice("abcdx") for _ in range(40))
        left = dc.cleaned(auto, known, text, limits)
        words = left.split()
        for e in range(len(words)):
            for n in range(3, e + 2):
                holders = [len(t.split()) for _, t in items if f" {' '.join(words[e - n + 1 : e + 1])} " in f" {t} "]
                assert not holders or n < 7 and n < 0.5 * min(holders)
        again += left != text and bool(dc.passages(auto, known, dc.without(text, dc.passages(auto, known, text, limits)), limits))
    assert again


def test_columns_that_clash(spark, monkeypatch):
    d = spark.createDataFrame([(1, f"x {prose(3, 20)} y", 1, 2, 3)], "doc_id bigint, text string, spans int, item_id int, row int")
    for size in (10**6, 15):
        monkeypatch.setattr(dc, "WORDS_PER_AUTOMATON", size)
        b = bench(spark, (1, prose(3, 20)), (2, prose(4, 20)))
        assert dc.find(d, b).first().n_words_removed == 20 and dc.clean(d, b).first() == (1, "x \n y", 1, 2, 3)


def test_odd_rows(spark, docs):
    item = prose(3, 20)
    b = bench(spark, (1, None, 0), (2, "", 0), (None, item, 0), (4, item, 0), (3, item, 0), (5, "?!", 0))
    rows = [*enumerate(ODD), (3, "x"), (None, item), (50, item)]
    found = dc.find(docs(rows), b).collect()
    assert {r.doc_id for r in found} == {None, 50} and found[0].spans[0].item_id == 3
    cleaned = dc.clean(docs(rows), b)
    assert cleaned.count() == len(rows) and cleaned.columns == docs(rows).columns and cleaned.where("doc_id = 50").first().text == "\n"
    assert dc.clean(docs(rows), b.where("false")).count() == len(rows)
    assert dc.find(docs(rows).where("false"), b).count() == 0 and dc.find(docs(rows), b.where("false")).count() == 0
