"""Instruction documents: headings, paragraphs and links of Markdown, copied blocks, circular references."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.graphs import components, shortcuts
from ..functions.text import nfkc_block
from ..plans.storage import checkpointed

LINK = re.compile(r"\[([^\]\n]*)\]\(\s*<?([^)\s>]+)>?(?:\s+\"[^\"]*\")?\s*\)")
MIN_COPIED = 120


def blocks(documents: DataFrame) -> DataFrame:
    """(path, ordinal, kind, level, text, target) of Markdown documents (path, content).

    Kinds are heading, paragraph, code and link; a link stands after the block that holds it. Fenced code holds no
    links.
    """

    def parse(content: str) -> Iterator[tuple]:
        paragraph: list[str] = []
        fence, code = None, []

        def flush():
            if paragraph:
                text = " ".join(paragraph)
                paragraph.clear()
                yield "paragraph", None, text, None
                yield from (("link", None, a, b) for a, b in LINK.findall(text))

        for line in content.splitlines():
            mark = re.match(r"\s{0,3}(`{3,}|~{3,})", line)
            if fence:
                if mark and mark[1][0] == fence[0] and len(mark[1]) >= len(fence):
                    yield "code", None, "\n".join(code), None
                    fence, code = None, []
                else:
                    code.append(line)
            elif mark:
                yield from flush()
                fence = mark[1]
            elif head := re.match(r"\s{0,3}(#{1,6})\s+(.*?)\s*#*\s*$", line):
                yield from flush()
                yield "heading", len(head[1]), head[2], None
                yield from (("link", None, a, b) for a, b in LINK.findall(head[2]))
            elif line.strip():
                paragraph.append(line.strip())
            else:
                yield from flush()
        yield from flush()
        if fence:
            yield "code", None, "\n".join(code), None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(p, i, *b) for p, c in zip(f["path"], f["content"]) if c is not None for i, b in enumerate(parse(c))]
            out = pd.DataFrame(rows, columns=["path", "ordinal", "kind", "level", "text", "target"])
            yield out.astype({"level": "Int32"})

    return documents.select("path", "content").mapInPandas(run, "path string, ordinal int, kind string, level int, text string, target string")


def copied_blocks(peers: DataFrame, canonical: DataFrame) -> DataFrame:
    """(path, block): the first block of each peer that the canonical documents have too.

    Both relations: (path, ordinal, text); blocks under 120 characters don't count.
    """
    normal = lambda d: d.withColumn("block", nfkc_block("text")).where(F.length("block") >= MIN_COPIED)
    shared = normal(peers).join(normal(canonical).select("block").distinct(), "block", "left_semi")
    return shared.groupBy("path").agg(F.min_by("block", "ordinal").alias("block"), F.min("ordinal").alias("ordinal"))


#: Edges of a graph that one task takes; beyond it blocks of a quarter of that.
EDGES_PER_TASK = 2_000_000


def cycles(edges: DataFrame, most: int = EDGES_PER_TASK) -> DataFrame:
    """(node, component): nodes that can reach themselves over (src, dst), under the smallest node of their component.

    Nodes are numbered in their order. Up to ``most`` edges are solved in one task, more by blocks of near nodes.
    """
    known = checkpointed(edges.where("src is not null and dst is not null").select("src", "dst").distinct())
    nodes = checkpointed(known.select(F.col("src").alias("node")).intersect(known.select(F.col("dst").alias("node"))).orderBy("node").withColumn("id", F.monotonically_increasing_id()))
    numbered = known.join(nodes.select(F.col("node").alias("src"), F.col("id").alias("s")), "src").join(nodes.select(F.col("node").alias("dst"), F.col("id").alias("d")), "dst")
    found = strong(checkpointed(numbered.select(F.col("s").alias("src"), F.col("d").alias("dst"))), most)
    least = found.groupBy("component").agg(F.min("node").alias("first"))
    named = nodes.select(F.col("node").alias("name"), "id")
    firsts = least.join(named, F.col("id") == F.col("first")).select("component", F.col("name").alias("least"))
    return found.join(named, F.col("id") == F.col("node")).join(firsts, "component").select(F.col("name").alias("node"), F.col("least").alias("component"))


FOUND = "node bigint, component bigint"


def members(src: np.ndarray, dst: np.ndarray) -> pd.DataFrame:
    """FOUND of the edges of one task, under one node of each component; numbers under 0 stand for components, -1 - component."""
    node, component, cyclic = components(src, dst)
    # Nodes are in order: the first of a component is the component it stands for, or else its smallest node.
    first = node[np.unique(component, return_index=True)[1]] if len(node) else node
    first = np.where(first < 0, -1 - first, first)[component]
    keep = cyclic & (node >= 0)
    return pd.DataFrame({"node": node[keep], "component": first[keep]})


def strong(live: DataFrame, most: int) -> DataFrame:
    """FOUND of edges (src, dst) of numbers from 0, which are checkpointed.

    Up to ``most`` edges are one task. More are cut into blocks by ranges of src: a block's own components become one
    node each, and what is left of it, which has no cycle, shortcuts from the nodes that other blocks point to to those
    that point to other blocks. The components of the smaller graph that makes then tell, in each block, which nodes
    between these belong to them. Where blocks take away less than a tenth, colours are spread over the whole graph.
    """
    count = live.count()
    if count <= most:

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held = [f for f in frames]
            if held:
                yield members(*(np.concatenate([f[c].to_numpy() for f in held]) for c in ("src", "dst")))

        return checkpointed(live.coalesce(1).mapInPandas(run, FOUND))
    cut = checkpointed(live.repartitionByRange(-(-count * 4 // most), "src").withColumn("block", F.spark_partition_id()))
    place = checkpointed(cut.select(F.col("src").alias("node"), "block").distinct())
    # What points to nothing has no block, and goes.
    cut = checkpointed(cut.join(place.select(F.col("node").alias("dst"), F.col("block").alias("to")), "dst"))
    inner, outer = cut.where("block = to").select("block", "src", "dst"), cut.where("block != to")
    ends = outer.selectExpr("block", "src", "-1L AS dst").union(outer.selectExpr("to AS block", "-1L AS src", "dst")).distinct()

    def shrink(f: pd.DataFrame) -> pd.DataFrame:
        src, dst = f["src"].to_numpy(), f["dst"].to_numpy()
        own, out, into = (src >= 0) & (dst >= 0), src[dst < 0], dst[src < 0]
        alone = np.concatenate([out, into])
        # Loops, which change no component, bring in the nodes that have edges to other blocks only.
        node, component, _ = components(np.concatenate([src[own], alone]), np.concatenate([dst[own], alone]))
        at = lambda x: component[np.searchsorted(node, x)].tolist()
        pairs = {(a, b) for a, b in zip(at(src[own]), at(dst[own])) if a != b}
        least = node[np.unique(component, return_index=True)[1]]
        kept = np.array(sorted(shortcuts(pairs, set(at(into)), set(at(out)))), dtype=np.int64).reshape(-1, 2)
        edges = pd.DataFrame({"src": least[kept[:, 0]], "dst": least[kept[:, 1]], "edge": True})
        return pd.concat([edges, pd.DataFrame({"src": node, "dst": least[component], "edge": False})])

    small = checkpointed(inner.unionByName(ends).groupBy("block").applyInPandas(shrink, "src bigint, dst bigint, edge boolean"))
    name = lambda c, to: small.where("not edge").select(F.col("src").alias(c), F.col("dst").alias(to))
    moved = outer.join(name("src", "s"), "src").join(name("dst", "d"), "dst").select(F.col("s").alias("src"), F.col("d").alias("dst"))
    rest = trimmed_edges(checkpointed(small.where("edge").select("src", "dst").unionByName(moved).distinct()))
    found = strong(rest, most) if rest.count() <= 0.9 * count else coloured(rest, most)
    tied = found.join(place, "node").selectExpr("block", "node", "-1 - component AS whole")
    ties = tied.selectExpr("block", "node AS src", "whole AS dst").union(tied.selectExpr("block", "whole AS src", "node AS dst"))
    return checkpointed(inner.unionByName(ties).groupBy("block").applyInPandas(lambda f: members(f["src"].to_numpy(), f["dst"].to_numpy()), FOUND))


def coloured(live: DataFrame, most: int = 0) -> DataFrame:
    """FOUND by rounds over the whole graph, as many as its paths are long.

    Nodes that nothing points to, or that point to nothing, are in no cycle and go first. Then the smallest node that
    reaches each node, its colour, spreads along the edges; the nodes of a colour that reach back to the node that
    gave it are a component. They go, and the rest begins anew, in one task once it has at most ``most`` edges. No relation
    is ever larger than the edges.
    """
    live = trimmed_edges(live)
    found = [live.where("src = dst").select(F.col("src").alias("node"), F.col("src").alias("component"))]
    while not live.isEmpty():
        if live.count() <= most:
            found.append(strong(live, most))
            break
        colour = spread(live, live.select(F.col("src").alias("node")).distinct().withColumn("colour", F.col("node")))
        ends = live.join(colour.select(F.col("node").alias("src"), F.col("colour").alias("c")), "src").join(colour.select(F.col("node").alias("dst"), F.col("colour").alias("d")), "dst")
        same = checkpointed(ends.where("c = d").select("src", "dst"))
        # Backwards from each colour's own node, within the colour.
        back = spread(same.select(F.col("dst").alias("src"), F.col("src").alias("dst")), colour.where("node = colour"))
        part = checkpointed(back.select("node", F.col("colour").alias("component")))
        inside = part.groupBy("component").count().where("count > 1").select("component")
        found.append(part.join(inside, "component", "left_semi").select("node", "component"))
        gone = part.select("node")
        live = trimmed_edges(checkpointed(ends.where("c = d").join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst")))
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out.groupBy("node").agg(F.min("component").alias("component"))


def trimmed_edges(live: DataFrame) -> DataFrame:
    """The edges without nodes that nothing points to or that point to nothing, while that takes away a tenth of them."""
    count = live.count()
    while count:
        ends = live.select(F.col("src").alias("n")).intersect(live.select(F.col("dst").alias("n")))
        live = checkpointed(live.join(ends.withColumnRenamed("n", "src"), "src", "left_semi").join(ends.withColumnRenamed("n", "dst"), "dst", "left_semi").select("src", "dst"))
        before, count = count, live.count()
        if count > 0.9 * before:
            break
    return live


def spread(edges: DataFrame, colour: DataFrame) -> DataFrame:
    """(node, colour) with the smallest colour that reaches each node, also of nodes that had none."""
    state, before = checkpointed(colour), None
    while True:
        sent = edges.join(state.select(F.col("node").alias("src"), "colour"), "src").select(F.col("dst").alias("node"), "colour")
        state = checkpointed(state.unionByName(sent).groupBy("node").agg(F.min("colour").alias("colour")))
        now = state.agg(F.count("*"), F.sum(F.xxhash64("node", "colour").cast("decimal(38,0)"))).first()
        if now == before:
            return state
        before = now


def instruction_gate(diagnostics: DataFrame, by: str) -> DataFrame:
    return diagnostics.groupBy(by).agg(F.when(F.bool_or(F.col("level") == "incomplete"), "INCOMPLETE").when(F.count("*") > 0, "WARN").otherwise("PASS").alias("gate"))


def progress(rows: DataFrame, total: int = 19) -> DataFrame:
    """One row from Markdown table rows (document, line, text) | id | title | status |: counts and the share accepted.

    Ids must run from 1 to total without a gap.
    """
    cells = rows.where(F.col("text").rlike(r"^\|\s*\d+\s*\|")).select("document", F.transform(F.split("text", r"\|"), lambda x: F.trim(x)).alias("c")).select("document", F.col("c")[1].cast("int").alias("id"), F.lower(F.col("c")[3]).alias("status"))
    sums = cells.groupBy("document").agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("complete", "partial", "failed")), (F.array_sort(F.collect_list("id")) == F.sequence(F.lit(1), F.lit(total))).alias("contiguous"))
    return sums.withColumns({"accepted_tenths": F.floor((F.col("complete") * 2 + F.col("partial")) * 500 / total + F.lit(0.5)).cast("bigint"), "release": (F.col("complete") >= total - 1) & (F.col("failed") == 0) & F.col("contiguous")})
