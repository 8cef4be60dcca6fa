"""Instruction documents of agents: a canonical one in each folder, peers that must point to it, and what peers get wrong."""

from __future__ import annotations

import posixpath
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .documents import MIN_COPIED

CANONICAL = "AGENTS.md"
MAX_LINES, MAX_MARKS, MARKS = 10_000, 50_000, set("[]()`*_#>+-")
#: Texts of up to so many characters are read once for all their copies, while they are among the last so many.
MAX_HELD, HELD = 32_768, 128
TAIL = r"\.md(?![A-Za-z0-9_\\/-]|\.[A-Za-z0-9])(?:[?#][^\s`<>()]+)?"
TOKEN = re.compile(rf"[a-z][a-z0-9+.-]*:[^\s`<>()]*?{TAIL}|(?:\.{{0,2}}[\\/])?(?:[a-z0-9._-]+[\\/])*[a-z0-9._-]+{TAIL}", re.I)
LINK = re.compile(r"!?\[((?:[^\[\]\\]|\\.)*)\](?:\(\s*<?([^)\s>]*)>?(?:\s+(?:\"[^\"]*\"|'[^']*'))?\s*\)|\[([^\]]*)\])?")
DEFINITION = re.compile(r" {0,3}\[([^\]]+)\]:\s*<?([^\s>]+)>?")
CODE = re.compile(r"(`+)(.+?)(?<!`)\1(?!`)", re.S)
CLAUSES = re.compile(r"[.!?;。！？；\n]+")

# Patterns about the canonical document, which stands as AGENTS_MD in a clause.
NAME = "AGENTS_MD"
THEM = r"(?:it|them|these|those|the\s+(?:instructions|rules))\b"
HEED = rf"(?:(?:obey|follow)\s+{THEM}|comply\s+with\s+{THEM})"
WEAKEN, WEAKEN_ZH = r"\b(?:override|ignore)\b", "(?:覆盖|弱化|忽略)"


def about(*parts: str) -> re.Pattern:
    return re.compile("|".join(parts), re.I)


PROTECTS = about(
    rf"\b(?:never|do not|must not)\b.{{0,60}}{WEAKEN}.{{0,60}}{NAME}",
    rf"\bignore\b.{{0,20}}\b(?:any\s+)?(?:rule|request|instruction)s?\b.{{0,80}}\b(?:weaken|override|ignore)\b.{{0,40}}{NAME}",
    rf"\b(?:refuse|reject|block)\b.{{0,30}}\b(?:any\s+)?(?:rule|request|instruction|attempt)s?\b.{{0,80}}\b(?:weaken|override|ignore)\b.{{0,40}}{NAME}",
    rf"(?:不能|不得).{{0,40}}{WEAKEN_ZH}.{{0,40}}{NAME}",
    rf"忽略.{{0,20}}(?:任何)?(?:规则|指令|指示|要求|请求).{{0,60}}{WEAKEN_ZH}.{{0,40}}{NAME}",
)
DEFIES = about(
    rf"\bdo not\s+(?:include|import|obey|follow|read)\b.{{0,60}}{NAME}", rf"\bdo not comply with\b.{{0,60}}{NAME}", rf"{WEAKEN}.{{0,60}}{NAME}", rf"{NAME}.{{0,60}}\b(?:should|may|can|must)\s+be\s+(?:overridden|ignored)\b",
    rf"(?:覆盖|忽略|无需遵守).{{0,40}}{NAME}", rf"{NAME}.{{0,40}}(?:应当忽略|必须忽略|可以忽略|无需遵守)",
)
REJECTS = about(r"\b(?:do not|never|must not)\b.{0,50}\b(?:include|import|obey|follow|read)\b", r"\bdo not comply with\b", "(?:无需|不得|不要).{0,30}(?:引用|导入|遵守|阅读|读取)")
DIRECTS = about(
    rf"\bread\s+and\s+(?:obey|follow)\b.{{0,60}}{NAME}", rf"\bread\b.{{0,60}}{NAME}.{{0,80}}\b(?:and\s+)?{HEED}", rf"{NAME}.{{0,60}}\b(?:should|must)\s+be\s+read\b.{{0,60}}\band\s+(?:obeyed|followed)\b",
    rf"(?:阅读|读取).{{0,40}}(?:且|并).{{0,20}}(?:服从|遵守).{{0,40}}{NAME}", rf"(?:阅读|读取).{{0,40}}{NAME}.{{0,40}}(?:且|并).{{0,20}}(?:服从|遵守)",
)
READS = about(rf"\bread\b.{{0,60}}{NAME}", rf"(?:阅读|读取).{{0,40}}{NAME}")
THEN = about(rf"^\s*(?:you\s+)?(?:(?:should|must)\s+)?{HEED}", "^\\s*(?:服从|遵守)(?:该|上述|这些|它)")
FOLLOWS = about(rf"^\s*(?:you\s+)?(?:(?:should|must)\s+)?{HEED}")
OWN_RULE = about(rf"{NAME}.{{0,50}}\band\s+(?:always\s+)?(?:test|name|format|write|require|prefer|avoid|use)\b")
NO_COPY = about(r"\b(?:never|must not|do not)\s+(?:repeat|duplicate|copy)\b.{0,80}\bshared\s+(?:instructions|rules)\b", "(?:不要|不能|不得).{0,30}(?:重复|复制).{0,30}(?:共享|共性)(?:约束|指令|规则)")
SHARED_TITLE = re.compile("(?:shared|canonical) (?:rules|instructions)|(?:共享|共性|统一)(?:约束|规则|指令)")
DELTA_TITLE = re.compile("(?:agent|tool)-specific\\b|(?:工具|智能体|tool|agent)(?:专属|特定)(?:约束|规则|指令|增量)\\Z")


def clauses(text: str) -> list[str]:
    return CLAUSES.split(re.sub(r"agents\.md", NAME, unicodedata.normalize("NFKC", text), flags=re.I))


def reference_tokens(text: str) -> list[str]:
    """Names of Markdown files in a text, with schemes, folders, queries and fragments."""
    return [m.group() for m in TOKEN.finditer(text)] if ".md" in text.lower() else []


def own_scope(reference: str) -> bool:
    return reference.replace("\\", "/") in (CANONICAL, f"./{CANONICAL}")


def reference_kind(references: list[str]) -> str:
    """same_scope, wrong_scope or missing: how references point to a canonical document."""
    found = [r for r in (x.replace("\\", "/") for x in references) if re.search(r"(?:^|[/:])AGENTS\.md\Z", r)]
    return "same_scope" if any(map(own_scope, found)) else "wrong_scope" if found else "missing"


def conflicts_with_canonical(text: str) -> bool:
    return any(NAME in c and not PROTECTS.search(c) and DEFIES.search(c) for c in clauses(text))


def directs_to_canonical(text: str, references: list[str]) -> bool:
    """Whether a paragraph that names the canonical document requires to read and follow it."""
    if not any(map(own_scope, references)):
        return False
    parts = clauses(text)
    if any(REJECTS.search(c) for c in parts):
        return False
    return any(NAME in c and DIRECTS.search(c) for c in parts) or any(READS.search(c) and THEN.search(after) for c, after in zip(parts, [*parts[1:], ""]))


def section_kind(title: str, peer: str) -> str:
    """canonical, delta or unknown: what a section of a peer document is for, by its title."""
    plain = unicodedata.normalize("NFKC", title).lower().strip()
    if SHARED_TITLE.fullmatch(plain):
        return "canonical"
    name = unicodedata.normalize("NFKC", re.sub(r"\.md\Z", "", peer, flags=re.I)).lower()
    return "delta" if DELTA_TITLE.match(plain) or plain.startswith(f"{name}-specific") else "unknown"


@dataclass
class Paragraph:
    text: str
    line: int
    section: str | None
    references: list[str] = field(default_factory=list)
    directive: str = ""


@dataclass
class Parsed:
    headings: list[tuple[int, str, int]] = field(default_factory=list)
    paragraphs: list[Paragraph] = field(default_factory=list)
    links: list[tuple[str, int]] = field(default_factory=list)
    references: list[str] = field(default_factory=list)

    @property
    def directive(self) -> Paragraph | None:
        return next((p for p in self.paragraphs if directs_to_canonical(p.directive, p.references)), None)

    @property
    def conflict(self) -> Paragraph | None:
        return next((p for p in self.paragraphs if conflicts_with_canonical(p.text)), None)


class TooLarge(ValueError):
    pass


def inline(text: str, definitions: dict[str, str]) -> tuple[str, str, list[str], list[str]]:
    """Visible text, text with link targets, references and link targets of an inline text."""
    shown, directive, references, targets, last = [], [], [], [], 0

    def plain(part: str) -> None:
        k = 0
        for m in CODE.finditer(part):
            for piece in (part[k : m.start()], m.group(2)):
                shown.append(piece)
                directive.append(piece)
                references.extend(reference_tokens(piece))
            k = m.end()
        shown.append(part[k:])
        directive.append(part[k:])
        references.extend(reference_tokens(part[k:]))

    for m in LINK.finditer(text):
        label = m.group(1)
        target = m.group(2) if m.group(2) is not None else definitions.get((m.group(3) or label).lower())
        if target is None or m.group().startswith("!"):
            continue
        plain(text[last : m.start()])
        label = label.replace("`", "")
        shown.append(label)
        directive.append(f"{label} {CANONICAL if own_scope(target) else target}")
        references.append(target)
        targets.append(target)
        last = m.end()
    plain(text[last:])
    return " ".join("".join(shown).replace("*", "").split()), "".join(directive), references, targets


def parse(source: str) -> Parsed:
    """Headings, paragraphs and links of a Markdown text, with their lines; fenced code is none of them."""
    if source.count("\n") >= MAX_LINES or sum(map(source.count, MARKS)) > MAX_MARKS:
        raise TooLarge
    lines, out, section = source.split("\n"), Parsed(), None
    definitions = {m.group(1).lower(): m.group(2) for line in lines if (m := DEFINITION.match(line))}
    held: list[str] = []
    begun, fence = 0, None

    def flush() -> None:
        if held:
            shown, directive, references, targets = inline("\n".join(held), definitions)
            out.paragraphs.append(Paragraph(shown, begun, section, references, directive))
            out.references.extend(references)
            out.links.extend((t, begun) for t in targets)
            held.clear()

    for n, raw in enumerate(lines, 1):
        line = raw.rstrip("\r")
        mark = re.match(r" {0,3}(`{3,}|~{3,})", line)
        if fence:
            fence = None if mark and mark[1][0] == fence[0] and len(mark[1]) >= len(fence) and not line.strip().strip(fence[0]) else fence
        elif mark:
            flush()
            fence = mark[1]
        elif head := re.match(r" {0,3}(#{1,6})(?:\s+(.*?))?\s*#*\s*\Z", line):
            flush()
            shown, _, references, targets = inline(head[2] or "", definitions)
            if len(head[1]) == 2:
                section = shown
            out.headings.append((len(head[1]), shown, n))
            out.references.extend(references)
            out.links.extend((t, n) for t in targets)
        elif not line.strip() or DEFINITION.match(line):
            flush()
        else:
            item = re.match(r"\s*(?:[-+*]|\d{1,9}[.)])\s+|\s*>\s?", line)
            if item:
                flush()
            if not held:
                begun = n
            held.append(line[item.end() :] if item else line.strip())
    flush()
    return out


def unscoped(parsed: Parsed, peer: str) -> int | None:
    """The line of content that is neither a pointer to the canonical document nor a named delta; None for none."""
    kinds = {t: section_kind(t, peer) for d, t, _ in parsed.headings if d == 2}
    for depth, title, line in parsed.headings:
        if depth == 2 and kinds[title] == "unknown":
            return line
    pointer = parsed.directive

    def of_its_own(p: Paragraph) -> bool:
        for c in filter(None, map(str.strip, clauses(p.text))):
            allowed = NAME in c and not OWN_RULE.search(c)
            leads = p is pointer and NAME not in c and (re.search(r"\bread\b", c, re.I) or FOLLOWS.search(c))
            if not allowed and not leads and not NO_COPY.search(c):
                return True
        return False

    for p in parsed.paragraphs:
        if (p is pointer or p.section is not None and kinds.get(p.section) == "canonical") and of_its_own(p):
            return p.line
    loose = [p for p in parsed.paragraphs if p.section is None]
    if len(loose) > 1:
        return loose[1].line
    return None


def block(text: str) -> str:
    return " ".join(unicodedata.normalize("NFKC", text).lower().split())


def shared_blocks(canonical: str) -> frozenset[str]:
    """The blocks of a canonical document that peers must not copy."""
    return frozenset(b for p in parse(canonical).paragraphs if len(b := block(p.text)) >= MIN_COPIED)


@lru_cache(HELD)
def held_blocks(canonical: str) -> frozenset[str]:
    return shared_blocks(canonical)


def peer_faults(canonical: str, peer: str, name: str) -> list[tuple[str, int | None]]:
    """(code, line) of what a peer document gets wrong beside the canonical one of its folder."""
    own, blocks = parse(peer), (held_blocks if len(canonical) <= MAX_HELD else shared_blocks)(canonical)
    at = next((p.line for p in own.paragraphs if reference_kind(p.references) != "missing"), own.paragraphs[0].line if own.paragraphs else None)
    out: list[tuple[str, int | None]] = []
    kind = reference_kind(own.references)
    if kind == "missing":
        out.append(("MISSING_CANONICAL_REFERENCE", at))
    elif kind == "wrong_scope":
        out.append(("WRONG_CANONICAL_SCOPE", at))
    elif own.directive is None:
        out.append(("MISSING_CANONICAL_DIRECTIVE", at))
    if (against := own.conflict) is not None:
        out.append(("EXPLICIT_CANONICAL_CONFLICT", against.line))
    if (line := unscoped(own, name)) is not None:
        out.append(("UNSCOPED_PEER_CONTENT", line))
    copied = next((p.line for p in own.paragraphs if block(p.text) in blocks), None)
    if copied is not None:
        out.append(("COPIED_SHARED_POLICY", copied))
    return out


@lru_cache(HELD)
def held_faults(canonical: str, peer: str, name: str) -> list[tuple[str, int | None]]:
    return peer_faults(canonical, peer, name)


FAULTS = "path string, code string, line int"


def diagnostics(files: DataFrame) -> DataFrame:
    """(path, code, line) of documents (path, content, target): every diagnostic of peers beside the canonical document of their folder.

    A peer is any other Markdown file in the relation; target is what a symbolic link points to, null for a file.
    Cycles of links come from link_edges and documents.cycles.
    """
    name, folder = F.element_at(F.split("path", "/", -1), -1), F.regexp_replace("path", "(^|/)[^/]*$", "")
    rows = files.withColumns({"name": name, "folder": folder})
    lead = rows.where(F.col("name") == CANONICAL).select("folder", F.col("path").alias("lead"), F.col("content").alias("shared"))
    code = F.when(F.col("lead").isNull(), "ORPHAN_PEER_SCOPE").when(F.col("target") != F.col("lead"), "SYMLINK_TARGET_MISMATCH")
    peers = rows.where(F.col("name") != CANONICAL).join(lead, "folder", "left").withColumn("code", code).where("code is not null or target is null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, code, own, shared, peer in zip(*(c.to_pylist() for c in batch.columns)):
                if code is not None:
                    out.append((path, code, None))
                    continue
                own, shared = own or "", shared or ""
                try:
                    out += [(path, *x) for x in (held_faults if len(own) + len(shared) <= MAX_HELD else peer_faults)(shared, own, peer)]
                except TooLarge:
                    out.append((path, "MARKDOWN_LIMIT_EXCEEDED", None))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.string()), pa.array([r[2] for r in out], pa.int32())], names=["path", "code", "line"])

    text = lambda c: F.when(F.col("code").isNull(), F.col(c)).alias(c)
    return by_rows(peers.select("path", "code", text("content"), text("shared"), "name")).mapInArrow(run, FAULTS)


def by_rows(rows: DataFrame) -> DataFrame:
    """The rows over all tasks by path: joins and groups of many small texts end in few partitions, as their bytes are few, and one folder may hold most."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), "path")


def link_edges(files: DataFrame) -> DataFrame:
    """(src, dst): links between documents (path, content) of the relation, resolved from the folder of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = set()
            for path, content in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    links = parse(content or "").links
                except TooLarge:
                    continue
                for target, _ in links:
                    t = re.split("[?#]", target)[0]
                    to = posixpath.normpath(posixpath.join(posixpath.dirname(path), t)) if t and not t.startswith("/") else ""
                    if to and not to.startswith("../"):
                        out.add((path, to))
            rows = sorted(out)
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in rows], pa.string()), pa.array([b for _, b in rows], pa.string())], names=["src", "dst"])

    found = by_rows(files.select("path", "content")).mapInArrow(run, "src string, dst string")
    return found.join(files.select(F.col("path").alias("dst")), "dst", "left_semi").select("src", "dst")


def scopes(paths: DataFrame, most: int = 1000) -> DataFrame:
    """(folder, canonical, peers): folders that hold instruction documents (path), with the peers in order; at most ``most`` folders, by name."""
    name, folder = F.element_at(F.split("path", "/", -1), -1), F.regexp_replace("path", "(^|/)[^/]*$", "")
    rows = paths.withColumns({"name": name, "folder": folder})
    grouped = rows.groupBy("folder").agg(F.max(F.when(F.col("name") == CANONICAL, F.col("path"))).alias("canonical"), F.array_sort(F.collect_list(F.when(F.col("name") != CANONICAL, F.col("path")))).alias("peers"))
    return grouped.orderBy("folder").limit(most)
