"""Removal of benchmark passages by a generalised suffix automaton.

The words of every benchmark item (NFKC, case-folded, punctuation left out) go into one suffix automaton. Each
document's words run through it; the state gives the longest passage of any item that ends at a word, and its suffix
links the shorter ones, which may belong to shorter items. A passage is removed if it has at least ``min_words``
words, or at least ``min_covered`` words that make up ``coverage`` of an item or more. Words that occur in no item break every match, so only runs of ``min_covered`` known words are
streamed; nothing that could reach a limit is passed over.

Size. The automata are broadcast, at most ``WORDS_PER_AUTOMATON`` words of items in each. A larger benchmark is split
by items: each automaton looks at the original texts in tasks of its own, the hits are gathered by row and merged
once, so the result is that of one automaton. For that the documents are written once, and hits are shuffled.

Defined results: a null or empty text stays as it is, and null, empty or wordless items match nothing. Repeated
items count once, under their smallest item_id. Overlapping passages are merged; a removed passage leaves one line
break. Where the words before and after it form a passage again, that goes too, until none is left: no cleaned text
has a finding. find tells the passages of the text as it is. A document that is a benchmark item throughout keeps its
row with what text is left. Of several items that hold a passage the shortest is named, then the smallest item_id.
Repeated documents, and those with a null doc_id, are treated alike; texts of any length are streamed whole. Empty
tables give an empty result, or the documents as they are. Other columns stay, whatever their names.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, CACHE_WORDS, WORD, checkpointed, map_arrow, replaced

MIN_WORDS, MIN_COVERED, COVERAGE = 13, 8, 0.5
WORDS_PER_AUTOMATON = 2_000_000
SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("n_words", pa.int32()), ("item_id", pa.int64()), ("coverage", pa.float64())])
HIT = pa.struct([("last", pa.int32()), ("n", pa.int32()), ("size", pa.int32()), ("item_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32())])
HITS = "row bigint, doc_id bigint, hits array<struct<last:int,n:int,size:int,item_id:bigint,start:int,end:int>>"
RESULT = "doc_id bigint, n_words_removed int, spans array<struct<start:int,end:int,n_words:int,item_id:bigint,coverage:double>>"


def normalised(word: str) -> str:
    return unicodedata.normalize("NFKC", word).casefold()


class Automaton:
    """Suffix automaton of several word sequences; each state names the shortest item that has its passages."""

    covering: tuple[tuple[int, float], list[int]] | None = None

    def __init__(self, items: list[tuple[int, list[str]]]):
        self.ids: dict[str, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.item: list[tuple[int, int]] = [(0, 0)]  # words of the item, item_id
        for item_id, words in sorted(items, key=lambda x: (len(x[1]), x[0])):
            at, prefixes = 0, []
            for w in words:
                at = self.extend(at, self.ids.setdefault(w, len(self.ids)))
                prefixes.append(at)
            for v in prefixes:
                while v > 0 and self.item[v] == (0, 0):
                    self.item[v] = (len(words), item_id)
                    v = self.link[v]

    def state(self, length: int, item: tuple[int, int] = (0, 0)) -> int:
        self.next.append({})
        self.link.append(-1)
        self.length.append(length)
        self.item.append(item)
        return len(self.next) - 1

    def split(self, p: int, c: int, q: int) -> int:
        """A copy of q for the passages that reach it from p with c."""
        clone = self.state(self.length[p] + 1, self.item[q])
        self.next[clone] = {**self.next[q]}
        self.link[clone] = self.link[q]
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def extend(self, last: int, c: int) -> int:
        q = self.next[last].get(c)
        if q is not None:  # an earlier item has this prefix's passage
            return q if self.length[q] == self.length[last] + 1 else self.split(last, c, q)
        new, p = self.state(self.length[last] + 1), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p < 0:
            self.link[new] = 0
        else:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self.split(p, c, q)
        return new

    def covers(self, least: int, coverage: float) -> list[int]:
        """For each state the one of its longest suffix, itself included, that covers a share of an item; 0 where none does."""
        if self.covering is None or self.covering[0] != (least, coverage):
            best = [0] * len(self.length)
            for v in sorted(range(1, len(best)), key=self.length.__getitem__):
                n = self.length[v]
                best[v] = v if n >= least and n >= coverage * self.item[v][0] else best[self.link[v]]
            self.covering = (least, coverage), best
        return self.covering[1]

    def matches(self, words: list[int]) -> Iterator[tuple[int, int]]:
        """(length, state) of the longest passage that ends at each word."""
        v = n = 0
        for c in words:
            while v and c not in self.next[v]:
                v = self.link[v]
                n = self.length[v]
            to = self.next[v].get(c)
            if to is None:
                v = n = 0
            else:
                v, n = to, n + 1
            yield n, v


class Known(dict):
    """1 for a word that some item has, else 0; by the word as it is written."""

    def __init__(self, ids: dict[str, int]):
        super().__init__()
        self.ids = ids

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = n = int(normalised(word) in self.ids)
        return n


def hits(auto: Automaton, known: Known, text: str | None, limits: tuple[int, int, float]) -> list[tuple[int, int, int, int, int, int]]:
    """For each last word the longest passage over the limits: last word, words, words of the item, item, characters from start to end."""
    min_words, least, coverage = limits
    least = min(least, min_words)
    if not text:
        return []
    words = WORD.findall(text)
    flags = bytes(map(known.__getitem__, words))
    if b"\x01" * least not in flags:
        return []
    found = []
    best = auto.covers(least, coverage)
    for run in re.finditer(b"\x01{%d,}" % least, flags):
        start = run.start()
        ids = [auto.ids[normalised(w)] for w in words[start : run.end()]]
        for i, (n, v) in enumerate(auto.matches(ids), start):
            if n < least:
                continue
            size, item = auto.item[v]
            if n < min_words and n < coverage * size:
                # A shorter suffix may belong to a shorter item.
                v = best[auto.link[v]]
                if not v:
                    continue
                n, (size, item) = auto.length[v], auto.item[v]
            found.append((i, n, size, item))
    if not found:
        return []
    at = [m.span() for m in WORD.finditer(text)]
    return [(i, n, size, item, at[i - n + 1][0], at[i][1]) for i, n, size, item in found]


def merged(found: list[tuple[int, int, int, int, int, int]]) -> list[dict]:
    """Passages of the hits of one or more automata: characters, words, the item and how much of it the longest match covers."""
    out: list[list] = []  # first word, last word, item, coverage, start, end
    done = -1
    for i, n, size, item, start, end in sorted(found, key=lambda x: (x[0], -x[1], x[2], x[3])):
        if i == done:  # of an automaton with a shorter passage, or a longer item
            continue
        done = i
        hit = [i - n + 1, i, item, n / size, start, end]
        while out and out[-1][1] >= hit[0] - 1:
            old = out.pop()
            hit = [min(old[0], hit[0]), i, *max((old[2:4], hit[2:4]), key=lambda x: x[1]), min(old[4], start), end]
            start = hit[4]
        out.append(hit)
    return [{"start": start, "end": end, "n_words": b - a + 1, "item_id": item, "coverage": min(1.0, c)} for a, b, item, c, start, end in out]


def passages(auto: Automaton, known: Known, text: str | None, limits: tuple[int, int, float]) -> list[dict]:
    return merged(hits(auto, known, text, limits))


def cleaned(auto: Automaton, known: Known, text: str | None, limits: tuple[int, int, float]) -> str | None:
    """The text without passages; also without those that a removal brings together."""
    while spans := passages(auto, known, text, limits):
        text = without(text, spans)
    return text


def without(text: str, spans: list[dict]) -> str:
    out, last = [], 0
    for s in spans:
        out += [text[last : s["start"]], "\n"]
        last = s["end"]
    return "".join([*out, text[last:]])


def automata(benchmark: DataFrame) -> list[Automaton]:
    seen: dict[tuple[str, ...], int] = {}
    for r in benchmark.select(F.col("item_id").cast("bigint"), "text").where("item_id is not null and text is not null").toLocalIterator():
        words = tuple(map(normalised, WORD.findall(r.text)))
        if words:
            seen[words] = min(r.item_id, seen.get(words, r.item_id))
    parts: list[list[tuple[int, list[str]]]] = [[]]
    size = 0
    for words, item in seen.items():
        if parts[-1] and size + len(words) > WORDS_PER_AUTOMATON:
            parts.append([])
            size = 0
        parts[-1].append((item, [*words]))
        size += len(words)
    return [Automaton(p) for p in parts]


def gathered(docs: DataFrame, row: str, parts: list[Automaton], limits: tuple[int, int, float]) -> DataFrame:
    """(row, doc_id, n_words_removed, spans) of the documents that have passages, from all automata's hits on the text."""
    out, names = None, [HIT.field(i).name for i in range(HIT.num_fields)]
    for auto in parts:
        shared = docs.sparkSession.sparkContext.broadcast(auto)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            known = Known(shared.value.ids)
            for batch in batches:
                rows = []
                for at, doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                    if found := hits(shared.value, known, text.as_py(), limits):
                        rows.append({"row": at, "doc_id": doc_id, "hits": [dict(zip(names, h)) for h in found]})
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("hits", pa.list_(HIT))]))

        part = map_arrow(docs.select(F.col(row).alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), "text"), run, HITS)
        out = part if out is None else out.unionByName(part)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_words_removed", pa.int32()), ("spans", pa.list_(SPAN))])
        for batch in batches:
            spans = [merged([tuple(h.values()) for h in found]) for found in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([sum(s["n_words"] for s in x) for x in spans], pa.int32()), pa.array(spans, pa.list_(SPAN))], schema=schema)

    return map_arrow(out.groupBy("row", "doc_id").agg(F.flatten(F.collect_list("hits")).alias("hits")), merge, f"row bigint, {RESULT}")


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """The documents, computed once, with a number for each row, and the name of that column."""
    row = "row" + "_" * max(map(len, docs.columns))
    return checkpointed(docs.withColumn(row, F.monotonically_increasing_id())), row


def find(docs: DataFrame, benchmark: DataFrame, min_words: int = MIN_WORDS, min_covered: int = MIN_COVERED, coverage: float = COVERAGE) -> DataFrame:
    """A row for each document with a benchmark passage: every passage, with characters from start to end."""
    limits, parts = (min_words, min_covered, coverage), automata(benchmark)
    for auto in parts:
        auto.covers(min(min_covered, min_words), coverage)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    if len(parts) > 1:
        docs, row = numbered(docs)
        return gathered(docs, row, parts, limits).drop("row")
    schema = pa.schema([("doc_id", pa.int64()), ("n_words_removed", pa.int32()), ("spans", pa.list_(SPAN))])
    shared = docs.sparkSession.sparkContext.broadcast(parts[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(shared.value.ids)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if spans := passages(shared.value, known, text.as_py(), limits):
                    rows.append({"doc_id": doc_id, "n_words_removed": sum(s["n_words"] for s in spans), "spans": spans})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return map_arrow(docs, run, RESULT)


def clean(docs: DataFrame, benchmark: DataFrame, min_words: int = MIN_WORDS, min_covered: int = MIN_COVERED, coverage: float = COVERAGE) -> DataFrame:
    """The documents with all columns, without benchmark passages; n_chars, where there is one, follows the text."""
    limits, schema, parts = (min_words, min_covered, coverage), docs.schema, automata(benchmark)
    for auto in parts:
        auto.covers(min(min_covered, min_words), coverage)
    at, count = docs.columns.index("text"), "n_chars" in docs.columns

    if len(parts) > 1:
        return cleaned_in_parts(docs, parts, limits)
    shared = docs.sparkSession.sparkContext.broadcast(parts[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(shared.value.ids)
        for batch in batches:
            texts = batch.column(at).to_pylist()
            left = [cleaned(shared.value, known, t, limits) for t in texts]
            changed = [x is not t for x, t in zip(left, texts)]
            yield with_texts(batch, left, changed, at, count) if any(changed) else batch

    return docs.mapInArrow(run, schema)


def cleaned_in_parts(docs: DataFrame, parts: list[Automaton], limits: tuple[int, int, float]) -> DataFrame:
    """The same with several automata: rounds of finding and cutting, each on the rows that the one before cut."""
    schema, at, count = docs.schema, docs.columns.index("text"), "n_chars" in docs.columns
    done, todo = [], docs
    while True:
        todo, row = numbered(todo)
        spans = checkpointed(gathered(todo, row, parts, limits).select(F.col("row").alias(row), F.col("spans").alias(f"{row}_")))
        n = spans.count()
        if not n:
            break
        small = n <= BROADCAST_ROWS // 20  # a row of spans is larger than an id
        hinted = F.broadcast(spans) if small else spans.hint("merge")
        done.append(todo.join(hinted, row, "left_anti").select(*schema.names))

        def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found, own = batch.column(len(schema.names)).to_pylist(), batch.select([*range(len(schema.names))])
                yield with_texts(own, [without(t, x) for t, x in zip(own.column(at).to_pylist(), found)], [True] * len(found), at, count)

        todo = todo.join(hinted, row).select(*schema.names, f"{row}_").mapInArrow(last, schema)
    out = todo.select(*schema.names)
    for part in done:
        out = out.unionByName(part)
    return out


def with_texts(batch: pa.RecordBatch, texts: list[str | None], changed: list[bool], at: int, count: bool) -> pa.RecordBatch:
    """The batch with other texts, and their lengths where a text changed."""
    new = {batch.schema.names[at]: pa.array(texts, batch.schema.field(at).type)}
    if count:
        i = batch.schema.names.index("n_chars")
        new["n_chars"] = pa.array([len(t) if c else n for t, c, n in zip(texts, changed, batch.column(i).to_pylist())], batch.schema.field(i).type)
    return replaced(batch, new)
