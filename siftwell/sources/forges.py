"""Forges: addresses of changes, and the files and revisions of landed responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_FILES, MAX_PATCHES, MAX_DIFF = 200, 50, 512 * 1024


def address(urls: DataFrame, column: str = "url") -> DataFrame:
    """urls with kind, owner, repository, number, canonical and issue of the change that an address names.

    Only https without user data, port or fragment, on the two public hosts. Percent escapes in the path are decoded.
    """
    u = F.trim(F.col(column))
    authority = F.regexp_extract(u, r"(?i)^[a-z][a-z0-9+.-]*://([^/?#\\]*)", 1)
    host = F.lower(F.regexp_replace(authority, r"^.*@|:\d*$", ""))
    path = F.regexp_extract(u, r"(?i)^[a-z][a-z0-9+.-]*://[^/?#\\]*([^?#]*)", 1)
    raw = F.filter(F.split(path, "/", -1), lambda s: s != "")
    parts = F.transform(raw, lambda s: F.try_url_decode(F.replace(s, F.lit("+"), F.lit("%2B"))))
    rows = urls.withColumns({"_host": host, "_parts": parts, "_authority": authority})
    size, at = F.size("_parts"), F.array_position("_parts", F.lit("merge_requests"))
    last = F.element_at("_parts", -1)
    number = F.when(last.rlike(r"^\s*[0-9]{1,16}\s*\z"), F.expr("try_cast(trim(element_at(_parts, -1)) as bigint)"))
    project = F.filter(F.slice("_parts", 1, F.greatest(at - 1, F.lit(0)).cast("int")), lambda s: s != "-")
    hub, lab = F.col("_host") == "github.com", F.col("_host") == "gitlab.com"
    shape = F.when(hub, (size == 4) & (F.get("_parts", F.lit(2)) == "pull")).when(lab, (at >= 3) & (at == size - 1))
    issue = (
        F.when(u.isNull() | ~u.rlike(r"(?i)^[a-z][a-z0-9+.-]*://[^/?#\s]+"), "invalid").when(~u.rlike("(?i)^https://"), "not_https").when(F.col("_authority").contains("@"), "userinfo")
        .when(F.col("_authority").rlike(r":\d+$") & ~F.endswith("_authority", F.lit(":443")), "port").when(u.rlike("#."), "fragment").when(~(hub | lab), "untrusted_host").when(~F.coalesce(shape, F.lit(False)), "shape")
        .when(number.isNull() | (number < 1) | (number > 2**53 - 1), "number").when(lab & (F.size(project) < 2), "project")
    )
    owner = F.when(hub, F.get("_parts", F.lit(0))).otherwise(F.array_join(F.slice(project, 1, F.greatest(F.size(project) - 1, F.lit(0))), "/"))
    repository = F.when(hub, F.get("_parts", F.lit(1))).otherwise(F.try_element_at(project, F.lit(-1)))
    found = rows.withColumn("issue", issue)
    ok = F.col("issue").isNull()
    canonical = F.concat(F.lit("https://"), F.col("_host"), F.lit("/"), owner, F.lit("/"), repository, F.when(hub, "/pull/").otherwise("/-/merge_requests/"), number.cast("string"))
    values = {"kind": F.when(hub, "github").otherwise("gitlab"), "owner": owner, "repository": repository, "number": number, "canonical": canonical}
    return found.select(*urls.columns, *(F.when(ok, v).alias(k) for k, v in values.items()), "issue")


CHANGES = "changes array<struct<new_path:string,old_path:string,new_file:boolean,deleted_file:boolean,renamed_file:boolean,diff:string>>"
#: A field that isn't there and one that is null are both null here.


def merge_request_files(rows: DataFrame) -> DataFrame:
    """Files of landed change lists (change_id, body): (change_id, incomplete, ordinal, path, previous_path, status, is_binary).

    The first MAX_FILES entries count, those without a path don't become files. A full list may be cut, so it is incomplete.
    """
    b = rows.select("change_id", F.from_json("body", CHANGES).alias("b")).select("change_id", F.coalesce("b.changes", F.array().cast("array<struct<new_path:string,old_path:string,new_file:boolean,deleted_file:boolean,renamed_file:boolean,diff:string>>")).alias("c"))
    f = b.select("change_id", (F.size("c") >= MAX_FILES).alias("incomplete"), F.posexplode(F.slice("c", 1, MAX_FILES)).alias("ordinal", "f"))
    true = lambda c: F.coalesce(F.col(f"f.{c}"), F.lit(False))
    status = F.when(true("new_file"), "added").when(true("deleted_file"), "deleted").when(true("renamed_file"), "renamed").otherwise("modified")
    path = F.coalesce("f.new_path", "f.old_path")
    return f.where(path != "").select("change_id", "incomplete", "ordinal", path.alias("path"), F.when(true("renamed_file"), F.col("f.old_path")).alias("previous_path"), status.alias("status"), (F.coalesce(F.length("f.diff"), F.lit(0)) == 0).alias("is_binary"))


def merge_request_diff(rows: DataFrame) -> DataFrame:
    """(change_id, diff): the patches of the first MAX_PATCHES entries as one text, cut to MAX_DIFF characters; null without one."""
    c = F.from_json("body", CHANGES)["changes"]
    patches = F.filter(F.transform(F.slice(c, 1, MAX_PATCHES), lambda x: x["diff"]), lambda d: d.isNotNull())
    return rows.select("change_id", F.when(F.size(patches) > 0, F.left(F.array_join(patches, "\n"), F.lit(MAX_DIFF))).alias("diff"))


def revisions(rows: DataFrame) -> DataFrame:
    """(change_id, base_sha, head_sha, title, author, forked, issue) of landed merge requests (change_id, body)."""
    shape = "title string, description string, diff_refs struct<base_sha:string,head_sha:string>, author struct<username:string>, source_project_id bigint, target_project_id bigint"
    b = rows.select("change_id", F.from_json("body", shape).alias("b"))
    sha = lambda c: F.coalesce(F.col(f"b.diff_refs.{c}"), F.lit("")).rlike(r"^[0-9a-f]{40}\z")
    forked = F.coalesce(~F.col("b.source_project_id").eqNullSafe(F.col("b.target_project_id")) & F.col("b.source_project_id").isNotNull(), F.lit(False))
    issue = F.when(~(sha("base_sha") & sha("head_sha")), "revisions")
    return b.select("change_id", F.col("b.diff_refs.base_sha").alias("base_sha"), F.col("b.diff_refs.head_sha").alias("head_sha"), F.coalesce("b.title", F.lit("")).alias("title"), F.col("b.author.username").alias("author"), forked.alias("forked"), issue.alias("issue"))


