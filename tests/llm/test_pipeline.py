from __future__ import annotations

import __spark_entry__
import corpus_pipeline
from siftwell.llm import bpe, decontaminate, pii, simhash, toxicity
from siftwell.llm.common import read

from .conftest import DATA, ODD, prose


def test_names():
    names = __spark_entry__.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 11)} and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def test_stages_written_between(spark, tmp_path, tables):
    """Each stage on what the one before wrote gives the rows of the whole, and its decisions took effect."""
    docs = read(spark, DATA, "documents")
    columns, counts = docs.columns, [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        counts.append(docs.count())
        assert k == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns
    assert counts[0] >= counts[1] > counts[2] == counts[3] == counts[4] == counts[5]
    whole = {(r.doc_id, r.n_tokens) for r in corpus_pipeline.run(spark, DATA).collect()}
    assert whole == {(r.doc_id, r.n_tokens) for r in docs.collect()}


def test_decisions(spark, tmp_path, tables):
    docs = read(spark, DATA, "documents")
    model = toxicity.train(docs, read(spark, DATA, "labels"))
    toxic = {r.doc_id for r in toxicity.find(docs, model).collect()}
    left = corpus_pipeline.drop_toxic(spark, docs, DATA)
    assert {r.doc_id for r in docs.select("doc_id").collect()} - {r.doc_id for r in left.select("doc_id").collect()} == toxic
    once = corpus_pipeline.drop_near_copies(spark, docs, DATA)
    groups = [set(r.doc_ids) for r in simhash.groups(docs).collect()]
    kept = {r.doc_id for r in once.select("doc_id").collect()}
    assert all(len(g & kept) == 1 for g in groups) and len(kept) == docs.count() - sum(len(g) - 1 for g in groups)
    end = bpe.decode(corpus_pipeline.encode(spark, corpus_pipeline.mask_personal_data(spark, corpus_pipeline.remove_benchmark(spark, docs, DATA), DATA), DATA))
    assert pii.find(end).count() == 0 and decontaminate.find(end, read(spark, DATA, "benchmark")).count() == 0


def tables_of(spark, path, rows, labels=(), items=()):
    """A folder with documents that have a clashing column for each stage."""
    full = [(i, t, "en", "s", None if t is None else len(t), 7, "x", 1, [1], 2, 0) for i, t in rows]
    spark.createDataFrame(full, "doc_id bigint, text string, lang string, source string, n_chars bigint, segments int, spans string, root int, token_ids array<int>, n_tokens int, round_trip int").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([*labels], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([*items], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_odd_documents(spark, tmp_path):
    """Null, empty, very long and repeated texts, ties, null ids, and columns with the stages' own names."""
    item = prose(3, 20)
    toxic = [(200 + i, f"{prose(i, 30)} vilerot foulmuck {prose(50 + i, 5)} vilerot foulmuck") for i in range(30)]
    clean = [(300 + i, prose(100 + i, 60)) for i in range(60)]
    rows = [*enumerate(ODD), (3, "x"), (None, "null id"), (None, None), (50, f"so {item} ends"), (51, "to a.b@c.de"), (52, prose(1, 80)), (53, prose(1, 80)), (53, prose(1, 80)), *toxic, *clean]
    labels = [(i, 1, 1) for i, _ in toxic] + [(i, 1, 0) for i, _ in clean] + [(None, None, None), (50, None, None)]
    sf = tables_of(spark, tmp_path, rows, labels, [(1, item), (2, None), (None, item)])
    got = corpus_pipeline.run(spark, sf).collect()
    ids = sorted(-1 if r.doc_id is None else r.doc_id for r in got)
    assert ids == sorted([*range(len(ODD)), -1, -1, 50, 51, 52, *(i for i, _ in clean)])
    by = {r.doc_id: r for r in got}
    assert by[0].token_ids is None and by[0].n_tokens is None and by[1].token_ids == [] and (by[6].segments, by[6].spans, by[6].root, by[6].round_trip) == (7, "x", 1, 0)
    text = {r.doc_id: r.text for r in bpe.decode(spark.createDataFrame([(r.doc_id, r.token_ids) for r in got], "doc_id bigint, token_ids array<int>")).collect()}
    assert text[50] == "so \n ends" and text[51] == "to <EMAIL>" and all(text[i] == ODD[i] for i in range(len(ODD)) if ODD[i] is not None)


def test_empty_tables(spark, tmp_path):
    sf = tables_of(spark, tmp_path, [])
    assert corpus_pipeline.run(spark, sf).count() == 0
    sf = tables_of(spark, tmp_path / "more", [(1, "a b c"), (2, prose(1, 30))])
    assert corpus_pipeline.run(spark, sf).count() == 2


def test_toxic_documents_are_scored_once(spark, tables):
    """What follows toxicity reads a written table, not the scoring again."""
    plan = corpus_pipeline.run(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") + plan.count("PythonMapInArrow") <= 8 and "table-" in plan
