"""Content policy: which paths and bytes may be looked at, what risks paths signal, which stages that calls for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEPENDENCY, GENERATED, CACHE = (s.split() for s in ("bower_components vendor node_modules .pnpm-store", "out coverage dist .next build", "__pycache__ .turbo .cache .parcel-cache"))
SECRET_MARKS = "secrets credentials .pfx .p12 .pem id_ed25519 id_rsa .env".split()
BINARY_ENDS = "7z bin class dll dylib eot exe gif gz ico jar jpeg jpg mp3 mp4 pdf png pyc so tar ttf wasm webp woff woff2 zip".split()
KEY_BLOCK = "-----BEGIN ((RSA|EC|OPENSSH) )?PRIVATE KEY-----"
KEY_VALUE = "(?i)(password|token|secret|api[_-]?key)\\s*[=:]\\s*['\"]?[\\w-]{16,}"

#: What a list of paths signals, as patterns over the lower-case paths joined by line feeds.
RISKS = {
    "auth": "session|auth|jwt|rbac|permission", "crypto": "hash|cipher|crypto|password|secret|hmac", "sql": "migration|sql|prisma|knex|typeorm|sequelize", "cache": "redis|cache", "jobs": "worker|job|queue|bull", "events": "kafka|event|sqs|sns|pubsub",
    "external_api": "client|http|axios|fetch|webhook", "ui": "css|view|component|[.][tj]sx\\z", "schema": "graphql|schema|openapi|protobuf|migration", "performance": "latency|perf|benchmark|hotpath",
}
MANDATORY = "universal behavior readability testing concurrency".split()
#: Optional stages in order of preference, each with the signals that call for it.
OPTIONAL = {"security": "auth crypto", "permissions": "auth", "data": "sql schema", "cache": "cache", "jobs": "jobs", "events": "events", "external_api": "external_api", "performance": "performance", "compatibility": "schema", "ui": "ui"}
MAX_STAGES = 7
#: Stages that may assess a major, best first; security has no stand-in.
ROUTES = {
    "correctness": "behavior universal", "readability": "readability universal", "architecture": "universal readability", "testing": "testing universal", "concurrency": "concurrency cache jobs events performance universal", "security": "security permissions",
    "compatibility": "compatibility data external_api universal", "observability-docs-supply-chain": "universal testing",
}


def valid_path(path: Column) -> Column:
    """Relative, without empty or dot segments or NUL, at most 4096 bytes."""
    return (path != "") & ~path.startswith("/") & ~path.contains("\0") & ~F.exists(F.split(path, "/", -1), lambda s: s.isin("", ".", "..")) & (F.octet_length(path) <= 4096)


def path_class(path: Column) -> Column:
    """Why a path isn't read, null if it may be; the first reason counts."""
    parts, low = F.split(path, "/", -1), F.lower(path)
    among = lambda names: F.arrays_overlap(parts, F.array(*map(F.lit, names)))
    marked = F.lit(False)
    for m in SECRET_MARKS:
        marked = marked | low.contains(m)
    return (
        F.when(among([".git"]), "git_metadata").when(among(DEPENDENCY), "dependency").when(among(GENERATED), "generated").when(among(CACHE), "cache").when(marked, "suspected_secret")
        .when(F.regexp_extract(low, r"\.([^.]*)\z", 1).isin(BINARY_ENDS), "binary")
    )


def is_binary(content: Column) -> Column:
    """A NUL in the first 8192 bytes, or more than 3 in 10 control characters among them; over BINARY."""
    head = F.decode(F.substring(content, 1, 8192), "ISO-8859-1")
    odd = F.length(head) - F.length(F.regexp_replace(head, "[\\x00-\\x06\\x0e-\\x1f]", ""))
    return head.contains("\0") | ((F.length(head) > 0) & (odd > F.length(head) * 0.3))


def looks_secret(text: Column) -> Column:
    return text.rlike(KEY_BLOCK) | text.rlike(KEY_VALUE)


def valid_utf8(content: Column) -> Column:
    return F.is_valid_utf8(content)


def candidates(files: DataFrame) -> DataFrame:
    """Each path with the reason why it isn't selected; an unsafe path before all others."""
    return files.withColumn("reason", F.when(~valid_path(F.col("path")), "unsafe_path").otherwise(path_class(F.col("path"))))


def exclusion_counts(files: DataFrame, by: str, samples: int = 20) -> DataFrame:
    """(by, reason, n, first): how many are excluded for each reason, and the first few in order."""
    numbered = files.where("reason is not null").withColumn("nth", F.row_number().over(Window.partitionBy(by, "reason").orderBy("ordinal")))
    kept = F.array_sort(F.collect_list(F.when(F.col("nth") <= samples, F.struct("ordinal", "path"))))
    return numbered.groupBy(by, "reason").agg(F.count("*").alias("n"), F.transform(kept, lambda x: x["path"]).alias("first"))


def eligible(files: DataFrame) -> DataFrame:
    return files.where("status != 'deleted' and not is_binary")


def risk_signals(files: DataFrame, by: str) -> DataFrame:
    """(by, one flag for each risk) of all paths of a review; the patterns see the whole list at once."""
    joined = F.lower(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "path"))), lambda x: x["path"]), "\n"))
    return files.groupBy(by).agg(joined.alias("paths")).select(by, *(F.col("paths").rlike(p).alias(k) for k, p in RISKS.items()))


def stages(signals: DataFrame, execution: str = "full", limit: int = MAX_STAGES) -> DataFrame:
    """Signals with the stages that they call for, mandatory ones first."""
    if execution == "fast":
        return signals.withColumn("stages", F.array(F.lit("universal")))
    if not len(MANDATORY) <= limit <= MAX_STAGES:
        raise ValueError(f"a plan has {len(MANDATORY)} to {MAX_STAGES} stages")
    wanted = []
    for stage, causes in OPTIONAL.items():
        any_of = F.lit(False)
        for c in causes.split():
            any_of = any_of | F.col(c)
        wanted.append(F.when(any_of, stage))
    return signals.withColumn("stages", F.slice(F.concat(F.array(*map(F.lit, MANDATORY)), F.array_compact(F.array(*wanted))), 1, limit))


def assessment_plan(plans: DataFrame, by: str) -> DataFrame:
    """(by, major_id, stage): the first stage of each major's route that is in the plan; null where none is."""
    routes = F.explode(F.array(*(F.struct(F.lit(m).alias("major_id"), F.array(*map(F.lit, r.split())).alias("route")) for m, r in ROUTES.items())))
    return plans.select(by, "stages", routes.alias("r")).select(by, "r.major_id", F.get(F.filter("r.route", lambda s: F.array_contains("stages", s)), F.lit(0)).alias("stage"))


def stage_assessments(expected: DataFrame, output: DataFrame) -> DataFrame:
    """Expected minors (review, stage, minor_id) with what the stage said (…, status, half_points).

    A stage that speaks about a minor that isn't its own is void: all its minors are not assessed. So is a minor
    that it assessed more than once or not at all.
    """
    extra = output.join(expected, ["review", "stage", "minor_id"], "left_anti").select("review", "stage").distinct().withColumn("void", F.lit(True))
    said = output.groupBy("review", "stage", "minor_id").agg(F.count("*").alias("n"), F.min("status").alias("said"), F.min("half_points").alias("points"))
    good = (F.col("n") == 1) & F.col("void").isNull()
    return expected.join(said, ["review", "stage", "minor_id"], "left").join(extra, ["review", "stage"], "left").select("review", "stage", "minor_id", F.when(good, F.col("said")).otherwise("not_assessed").alias("status"), F.when(good, F.col("points")).alias("half_points"))


def content_mismatch(files: DataFrame, contents: DataFrame) -> DataFrame:
    """Eligible paths without content, and contents of no eligible path."""
    own = eligible(files).select("workspace", "path").distinct()
    have = contents.select("workspace", "path").distinct()
    return own.join(have, ["workspace", "path"], "left_anti").withColumn("issue", F.lit("missing")).unionByName(have.join(own, ["workspace", "path"], "left_anti").withColumn("issue", F.lit("unexpected")))


def egress(requests: DataFrame) -> DataFrame:
    """Whether data of a class may leave: public data may, internal data by consent, restricted data never."""
    return requests.withColumn("allowed", F.when(F.col("classification") == "public", True).when(F.col("classification") == "internal", F.col("consent") == "allow").otherwise(False))
