"""What a review stage answers: validation of its JSON, and its candidates and assessments as rows."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.schema import fault

LINES, TITLE, PATH, LONG, QUOTE = 10_000_000, 300, 4096, 10_000, 8


def text(low: int, high: int, **more) -> dict:
    return {"type": "string", "minLength": low, "maxLength": high, **more}


def record(needed: str, properties: dict, **more) -> dict:
    """An object with these properties alone, of which some are needed."""
    return {"type": "object", "additionalProperties": False, "required": needed.split(), "properties": properties, **more}


def place() -> dict:
    line = {"type": "integer", "minimum": 1, "maximum": LINES}
    return {"path": text(1, PATH), "startLine": line, "endLine": line}


CANDIDATE = record(
    "title severity evidence path startLine endLine",
    {"title": text(1, TITLE), "severity": {"type": "string", "enum": "P0 P1 P2 P3 NIT".split()}, "evidence": text(12, LONG), **place(), "sourceQuote": text(QUOTE, LONG), "contractFact": text(QUOTE, LONG), "impact": text(1, LONG), "remediation": text(1, LONG)},
    anyOf=[{"required": [k]} for k in ("sourceQuote", "contractFact")],
)
PROOF = record("path startLine endLine sourceQuote", {**place(), "sourceQuote": text(QUOTE, LONG)})


def assessment(most_evidence: int) -> dict:
    scored = record(
        "minorId status rating confidence evidence explanation",
        {
            "minorId": text(1, TITLE), "status": {"const": "scored"}, "rating": {"type": "number", "minimum": 0, "maximum": 5, "multipleOf": 0.5}, "confidence": {"type": "string", "enum": "low medium high".split()},
            "evidence": {"type": "array", "minItems": 1, "maxItems": most_evidence, "items": PROOF}, "explanation": text(1, LONG, pattern=r"\S"),
        },
    )
    without = record("minorId status reason", {"minorId": text(1, TITLE), "status": {"const": "not_applicable"}, "reason": text(1, LONG, pattern=r"\S")})
    return {"oneOf": [scored, without]}


def answer(most_candidates: int = 64, most_assessments: int = 1000, most_evidence: int = 16) -> dict:
    """The schema of a stage's answer."""
    lists = {"candidates": {"type": "array", "maxItems": most_candidates, "items": CANDIDATE}, "assessments": {"type": "array", "maxItems": most_assessments, "items": assessment(most_evidence)}}
    return record("candidates", lists)


def validated(outputs: DataFrame, key: str = "stage_id", schema: dict | None = None) -> DataFrame:
    """(key, ok, path, keyword) of outputs (key, content): where an answer first breaks the schema, and which of its rules.

    A text that is null or no JSON breaks the type of the whole, at "/".
    """
    rules, kind = schema or answer(), outputs.schema[key].dataType.simpleString()

    def one(content: str | None) -> tuple[str, str] | None:
        try:
            value = None if content is None else json.loads(content)
        except (ValueError, RecursionError):
            value = None
        return fault(value, rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [one(x.as_py()) for x in batch.column(1)]
            columns = [pa.array([x is None for x in found]), pa.array([x and (x[0] or "/") for x in found], pa.string()), pa.array([x and x[1] for x in found], pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[key, "ok", "path", "keyword"])

    return outputs.select(key, "content").mapInArrow(run, f"`{key}` {kind}, ok boolean, path string, keyword string")


CANDIDATES = "candidates array<struct<title:string,severity:string,evidence:string,path:string,startLine:double,endLine:double,sourceQuote:string,contractFact:string,impact:string,remediation:string>>"
ASSESSMENTS = "assessments array<struct<minorId:string,status:string,rating:double,confidence:string,evidence:array<struct<path:string,startLine:double,endLine:double,sourceQuote:string>>,explanation:string,reason:string>>"


def candidates(outputs: DataFrame, key: str = "stage_id") -> DataFrame:
    """Candidates of valid answers, as evidence.verified takes them, with their place in the answer."""
    rows = outputs.select(key, F.posexplode(F.from_json("content", CANDIDATES)["candidates"]).alias("ordinal", "c"))
    line = lambda c: F.col(f"c.{c}").cast("int")
    return rows.select(key, "ordinal", F.col("c.title").alias("title"), F.col("c.severity").alias("severity"), F.col("c.evidence").alias("evidence"), F.col("c.path").alias("path"), line("startLine").alias("start_line"), line("endLine").alias("end_line"), F.col("c.sourceQuote").alias("quote"), F.col("c.contractFact").alias("fact"), F.col("c.impact").alias("impact"), F.col("c.remediation").alias("remediation"))


def assessments(outputs: DataFrame, key: str = "stage_id") -> DataFrame:
    """Assessments of valid answers; ratings in half points."""
    rows = outputs.select(key, F.posexplode(F.from_json("content", ASSESSMENTS)["assessments"]).alias("ordinal", "a"))
    return rows.select(key, "ordinal", F.col("a.minorId").alias("minor_id"), F.col("a.status").alias("status"), (F.col("a.rating") * 2).cast("int").alias("half_points"), F.col("a.confidence").alias("confidence"), F.size(F.coalesce("a.evidence", F.array().cast("array<struct<path:string,startLine:double,endLine:double,sourceQuote:string>>"))).alias("n_evidence"), F.coalesce("a.explanation", "a.reason").alias("text"))
