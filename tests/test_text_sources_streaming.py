from __future__ import annotations

import json

from pyspark.sql import functions as F

from siftwell.functions import text
from siftwell.operators import ledger
from siftwell.sources import files
from siftwell.streaming import ledger as stream


def apply(spark, f, *values):
    d = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.o for r in d.select("i", f(F.col("v")).alias("o")).orderBy("i").collect()]


def test_text_functions(spark):
    assert apply(spark, text.nfkc_fold, " ＡBc ", None, "ﬁ") == ["abc", None, "fi"]
    assert apply(spark, text.normal_lines, "  a \r\n\tb  \n", "") == ["a\nb", ""]
    assert apply(spark, text.repository_path, "./a\\b", "/a", "../a", "a/../b", "..") == ["a/b", None, None, None, None]
    assert apply(spark, text.canonical_json, '{"b": [1, {"z": 1, "a": null}], "a": "é"}', "{", None) == ['{"a":"é","b":[1,{"a":null,"z":1}]}', None, None]
    assert apply(spark, text.decode_quoted_path, '"a/\\303\\251\\t\\""', "plain", '"bad\\9"', '"open') == ['a/é\t"', "plain", None, None]
    assert apply(spark, text.truncate_utf8(6), "éééé", "abcdef") == ["é...", "abcdef"]
    assert apply(spark, text.redact, "Authorization: bearer  abc.d-e_f/g", "BEARER\tx y", "Bearer ", "key 12345678") == ["Authorization: bearer  [REDACTED]/g", "BEARER\t[REDACTED] y", "Bearer ", "key 12345678"]
    assert apply(spark, lambda c: text.redact(c, ("12345678", "short")), "a12345678b short 12345678") == ["a[REDACTED]b short [REDACTED]"]
    assert apply(spark, text.terminal_safe(), 'a"b\\c\td\n\x1b[31m\x7f\u202e\u2028é😀\u00ad', None, "plain") == ['a\\"b\\\\c\\td\\n\\u001b[31m\\u007f\\u202e\\u2028é😀\\u00ad', None, "plain"]
    assert apply(spark, text.terminal_safe(8), "éééé", "ééééé") == ["éééé", "éé..."]
    assert apply(spark, text.utf16_length, "a😀é", "") == [4, 0]
    assert apply(spark, text.json_pointer, "a/b~c") == ["a~1b~0c"]


def test_strict_timestamps(spark):
    got = apply(spark, text.strict_utc, "2026-02-28T23:59:59Z", "2026-02-29T00:00:00Z", "2024-02-29T00:00:00.123Z", "2026-01-01T00:00:00+00:00", "2026-01-01 00:00:00Z", "2026-13-01T00:00:00Z", "x", None)
    assert [x is not None for x in got] == [True, False, True, False, False, False, False, False]


def test_line_slices(spark):
    d = spark.createDataFrame([("a\r\nb\nc", 2, 3), ("a", 1, 2), ("a\n", 2, 2), ("a", 2, 1)], "c string, s int, e int")
    assert [r.o for r in d.select(text.line_slice(F.col("c"), F.col("s"), F.col("e")).alias("o")).collect()] == ["b\nc", None, "", None]


def test_signed_tenths(spark):
    d = spark.createDataFrame([(25, 500), (-25, 500), (20, 500), (-1, 0), (60, 500)], "a int, b int")
    assert [r.o for r in d.select(text.signed_tenths_text(F.col("a"), F.col("b")).alias("o")).collect()] == ["+0.1", "-0.1", "0.0", "N/A", "+0.1"]


def test_bounded_files(spark, tmp_path):
    (tmp_path / "a.md").write_text("ok")
    (tmp_path / "b.md").write_text("x" * 50)
    (tmp_path / "c.md").write_bytes(b"\xff")
    got = {r.path.rsplit("/", 1)[1]: (r.content, r.issue) for r in files.bounded_files(spark, str(tmp_path), 10, "*.md").collect()}
    assert got == {"a.md": ("ok", None), "b.md": (None, "file_limit"), "c.md": (None, "not_utf8")}


def test_structured_documents(spark):
    assert apply(spark, files.structured, '{"a": 1}', '{"a": 1, "a": 2}', None)[0] == '{"a": 1}'
    assert apply(spark, lambda c: files.unknown_keys(c, ["a"]), '{"a": 1, "b": 2}', '{"a": 1}', "[1]") == [["b"], [], None]


def test_score_model_documents(spark):
    doc = json.dumps({"id": "m", "version": "1", "majors": [{"id": "x", "weightTenths": 10, "minors": [{"id": "y", "weightTenths": 10, "required": True}]}]})
    r = files.score_models(spark.createDataFrame([("p", doc)], "path string, content string")).first()
    assert (r.model_id, r.major_id, r.minor_id, r.weight, r.required) == ("m", "x", "y", 10, True)


def test_forge_page_that_is_incomplete(spark):
    body = json.dumps({"changed_files": 2, "files": [{"filename": "b", "previous_filename": "a", "status": "renamed", "additions": 1, "deletions": 0}]})
    r = files.forge_files(spark.createDataFrame([(1, body)], "change_id int, body string")).first()
    assert (r.incomplete, r.path, r.previous_path, r.status) == (True, "b", "a", "renamed")


def test_path_sets(spark):
    d = spark.createDataFrame([("tracked", "a"), ("tracked", "a"), ("tracked", "b"), ("ignored", "c")], "kind string, path string")
    assert {r.kind: (r.n, r.kept, r.overflow) for r in files.path_sets(d, 1).collect()} == {"tracked": (2, 1, 1), "ignored": (1, 1, 0)}


def test_ledger_round_trip(spark, tmp_path):
    path = str(tmp_path / "runs.jsonl")
    (tmp_path / "runs.jsonl").write_text('{"run_id": "a", "gate": "PASS"}\n{broken\n')
    runs = files.run_ledger(spark, path)
    assert {(r.run_id, r.broken) for r in runs.collect()} == {("a", False), (None, True)}
    assert files.run_ledger(spark, path, "a").count() == 1
    ledger.append_runs(spark.createDataFrame([("a", "2026-01-01")], "run_id string, day string"), str(tmp_path / "out"))
    ledger.append_runs(spark.createDataFrame([("b", "2026-01-02")], "run_id string, day string"), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_cache_keeps_the_other_keys_of_a_shard(spark, tmp_path):
    path, schema = str(tmp_path / "cache"), "cache_key string, written_ms long, v int"
    ledger.put_cache(spark.createDataFrame([("aa1", 1, 1), ("aa2", 1, 1), ("bb1", 1, 1)], schema), path)
    ledger.put_cache(spark.createDataFrame([("aa1", 2, 2), ("aa3", 2, 3)], schema), path)
    assert {(r.cache_key, r.v) for r in ledger.cached(spark.read.parquet(path)).collect()} == {("aa1", 2), ("aa2", 1), ("aa3", 3), ("bb1", 1)}


def test_cacheable_and_projection(spark):
    d = spark.createDataFrame([(1, False, "PASS", ["X"]), (2, True, "PASS", []), (3, False, "INCOMPLETE", []), (4, False, "WARN", ["PROVIDER_TIMEOUT"])], "id int, incomplete boolean, gate string, codes array<string>")
    assert [r.id for r in ledger.cacheable(d).collect()] == [1]
    rows = spark.createDataFrame([(1, i, "C", "s" * 130, None, "Bearer abc " + "é" * 300) for i in range(40)], "run int, ordinal int, code string, stage_id string, path string, message string")
    kept = ledger.stored_diagnostics(rows, "run").collect()
    assert len(kept) == 32 and all((r.stage_id, r.path) == ("s" * 117 + "...", None) and r.message.startswith("Bearer [REDACTED] é") and len(r.message.encode()) in (511, 512) for r in kept)


def test_stream_of_runs(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [{"run_id": r, "gate": g, "created_at": f"2026-01-01T0{h}:00:00Z"} for r, g, h in (("a", "PASS", 1), ("a", "PASS", 1), ("b", "WARN", 1), ("c", "PASS", 5))]
    (tmp_path / "in" / "x.json").write_text("\n".join(map(json.dumps, rows)))
    q = stream.keep(stream.gates_by_window(stream.arriving(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "state"))
    q.awaitTermination()
    assert {(r.gate, r.runs) for r in spark.read.parquet(str(tmp_path / "out")).collect()} >= {("PASS", 1), ("WARN", 1)}
