"""Toxic passages by maximum-scoring segment search.

Token log-odds come from labelled documents with an informative Dirichlet prior; a linear-time scan finds
every maximal segment of a text; extreme-value statistics turn segment scores into p-values of the document.

Training. A feature is a word (lower case) or a word's prefix of 4, 5 or 6 characters; a prefix counts only if
at least ``min_types`` distinct words of toxic documents share it, so that it stands for a productive stem. Near
copies among the labelled documents count once, and a word once a document. With counts n1 and n0 in toxic and
other documents, N1 and N0 words in all, and the labelled sample of both classes as the prior, not the corpus (pi =
the feature's share in both classes, its weight ``prior`` times N1 + N0), the log-odds difference is divided by its standard error; features over
``min_z`` whose odds are at least ``min_ratio`` form the lexicon; a stem must do so beyond the longer stems that it
holds, and beyond a word that alone makes up over half of it. A passage that is toxic is modelled as lexicon
words at rate ``density`` among ordinary text, so each word scores the log-likelihood ratio of that model against
clean text.

Calibration. lambda solves sum p_i exp(lambda s_i) = 1 over the clean documents of the labelled sample, where a word
counts once a document, and K is their rate of excursions, as
in Karlin and Altschul's theory of maximal segments; E = K n exp(-lambda S) for n words. The document's p-value
is the smallest sum statistic over its best r segments, each multiplied by 2^r.

Defined results: a null, empty or wordless text has no passage; it is never rejected. A repeated row is scored
as often as it stands there, and so is one with a null doc_id. Equal scores keep text order. Without labelled
documents of both classes the lexicon is empty and nothing is toxic. Conflicting labels of one doc_id count as toxic.
Whole texts are scanned, however long. An empty table gives an empty result. Other columns stay, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHE_WORDS, WORD, checkpointed, map_arrow
from .simhash import deduplicated

PREFIXES = (6, 5, 4)
SEGMENT = "struct<start:int,end:int,score:double,e_value:double>"
RESULT = f"doc_id bigint, p_value double, n_segments int, segments array<{SEGMENT}>"


@dataclass
class Model:
    """Scores of lexicon words and stems, the score of any other word, and the calibration."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    other: float = -0.05
    lam: float = 1.0
    k: float = 1.0
    alpha: float = 0.01


class Scores(dict):
    """Scores by word as it is written; filled on first sight."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> float:
        w = word.lower()
        s = self.model.words.get(w)
        if s is None:
            s = next((self.model.stems[w[:k]] for k in PREFIXES if len(w) > k and w[:k] in self.model.stems), 0.0)
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = s
        return s


def segments(positions: list[int], scores: list[float], other: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first word, last word, score), in linear time.

    positions are those of words with a score over 0; every word between them scores ``other``, below 0.
    """
    stack: list[tuple[int, int, float, float, int]] = []  # first, last, sum before, sum after, link to the nearest lower sum before
    total, last = 0.0, -1
    for pos, s in zip(positions, scores):
        total += other * (pos - last - 1)
        first, low = pos, total
        total += s
        last, high = pos, total
        j = len(stack) - 1
        while True:
            while j >= 0 and stack[j][2] >= low:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= high:
                break
            first, low = stack[j][0], stack[j][2]
            link = stack[j][4]
            del stack[j:]
            j = link
        stack.append((first, pos, low, high, j))
    return [(a, b, high - low) for a, b, low, high, _ in stack]


def document_p(model: Model, n_words: int, found: list[float]) -> float:
    """p-value of a document from the scores of its segments."""
    best, total = 1.0, 0.0
    for r, s in enumerate(sorted(found, reverse=True), 1):
        total += model.lam * s - math.log(model.k * n_words)
        if total > 0:
            log_p = -total + (r - 1) * math.log(total) - math.lgamma(r + 1) - math.lgamma(r) + r * math.log(2)
            best = min(best, math.exp(min(0.0, log_p)))
    return best


def score_text(model: Model, scores: Scores, text: str | None) -> tuple[float, list[tuple[int, int, float, float]]]:
    """p-value and segments (start and end in characters, score, E-value)."""
    words = WORD.findall(text) if text else ()
    if not any(map(scores.__getitem__, words)):
        return 1.0, []
    each = list(map(scores.__getitem__, words))
    at = [i for i, s in enumerate(each) if s]
    found = segments(at, [each[i] for i in at], model.other)
    spans = [m.span() for m in WORD.finditer(text)]
    n = len(words)
    return document_p(model, n, [s for *_, s in found]), [(spans[a][0], spans[b][1], s, model.k * n * math.exp(-model.lam * s)) for a, b, s in found]


def sample_labels(labels: DataFrame, per_class: int) -> DataFrame:
    """At most per_class labelled documents of each class, by a hash of the id."""
    each = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    pick = lambda t: each.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
    return pick(1).unionByName(pick(0))


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[int, Counter] = {0: Counter(), 1: Counter()}
    for batch in batches:
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if text:
                words = {*WORD.findall(text.lower())}
                counts[toxic].update(words)
                counts[toxic][""] += len(words)
    words = [*counts[0].keys() | counts[1].keys()]
    if words:
        yield pa.RecordBatch.from_arrays([pa.array(words), pa.array([counts[1][w] for w in words], pa.int64()), pa.array([counts[0][w] for w in words], pa.int64())], names=["word", "n1", "n0"])


def stems_of_their_own(lexicon: list, min_count: int, least: float) -> list:
    """The stems that still stand out without the longer stems in them, and without a word that alone makes up over half."""
    kept: list = []
    words = [r for r in lexicon if not r.stem]
    for s in sorted((r for r in lexicon if r.stem), key=lambda r: (-len(r.word), r.word)):
        longer = [r for r in kept if r.word.startswith(s.word)]
        inner = [r for r in longer if not any(r is not q and r.word.startswith(q.word) for q in longer)]
        inner += [r for r in words if 2 * r.n1 > s.n1 and len(r.word) > len(s.word) and r.word.startswith(s.word) and not any(r.word.startswith(q.word) and len(r.word) > len(q.word) for q in inner)]
        n1, n0 = s.n1 - sum(r.n1 for r in inner), s.n0 - sum(r.n0 for r in inner)
        if n1 >= min_count and n1 >= least * (n0 + 1):
            kept.append(s)
    return kept


def train(docs: DataFrame, labels: DataFrame, per_class: int = 8000, prior: float = 0.1, min_z: float = 3.5, min_ratio: float = 10.0, min_types: int = 5, min_count: int = 3, density: float = 0.05, alpha: float = 0.01) -> Model:
    """A model from labelled documents; per_class bounds how many of each class are read."""
    sample = checkpointed(docs.select("doc_id", "text").join(F.broadcast(sample_labels(labels, per_class)), "doc_id"))
    counts = map_arrow(deduplicated(sample).select("text", "toxic"), count_words, "word string, n1 bigint, n0 bigint").groupBy("word").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0")).persist()
    try:
        totals = counts.where("word = ''").first()
        if totals is None or not totals.n1 or not totals.n0:
            return Model(other=math.log(1 - density), alpha=alpha)
        words = counts.where("word != ''")
        stems = words.select(F.explode(F.array(*(F.when(F.length("word") > k, F.substring("word", 1, k)) for k in PREFIXES))).alias("word"), "n1", "n0").where("word is not null").groupBy("word").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"), F.count_if(F.col("n1") > 0).alias("types"))
        both = words.select("word", "n1", "n0", F.lit(False).alias("stem")).unionByName(stems.where(F.col("types") >= min_types).select("word", "n1", "n0", F.lit(True).alias("stem")))
        share, weight = (F.col("n1") + F.col("n0")) * prior, (totals.n1 + totals.n0) * prior
        odds = lambda c, n: F.log((F.col(c) + share) / (n + weight - F.col(c) - share))
        log_odds = odds("n1", totals.n1) - odds("n0", totals.n0)
        z = log_odds / F.sqrt(1 / (F.col("n1") + share) + 1 / (F.col("n0") + share))
        lexicon = both.where((F.col("n1") >= min_count) & (z >= min_z) & (log_odds >= math.log(min_ratio))).orderBy("stem", "word").collect()
    finally:
        counts.unpersist()
    lexicon = [r for r in lexicon if not r.stem] + stems_of_their_own(lexicon, min_count, min_ratio * totals.n1 / totals.n0)
    # A word of the lexicon keeps its own score; a stem speaks for words that aren't in it.
    total = sum(r.n1 for r in lexicon if not r.stem) or sum(r.n1 for r in lexicon) or 1
    model, null = Model(other=math.log(1 - density), alpha=alpha), []
    for r in lexicon:
        # One document more than were seen, so that a word never seen in clean text keeps a chance there.
        clean = (r.n0 + 1) / (totals.n0 + 1)
        s = math.log(1 - density + density * r.n1 / total / clean)
        if s > 0:
            (model.stems if r.stem else model.words)[r.word] = s
            if not r.stem:
                null.append((clean, s, r.n0))
    if null:
        f = lambda lam: sum(p * math.exp(lam * s) for p, s, _ in null) + (1 - sum(p for p, *_ in null)) * math.exp(lam * model.other) - 1
        low, high = 1e-3, 1.0
        while f(high) < 0 and high < 64:
            high *= 2
        for _ in range(80):
            mid = (low + high) / 2
            low, high = (mid, high) if f(mid) < 0 else (low, mid)
        model.lam = (low + high) / 2
        expected = totals.n0 * math.exp(-model.lam * min(s for _, s, _ in null))
        model.k = min(1.0, max(1e-4, (sum(n for *_, n in null) + 0.5) / expected)) if expected > 0 else 1.0
    return model


def find(docs: DataFrame, model: Model) -> DataFrame:
    """A row for each toxic document: its p-value and every significant passage."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        scores = Scores(m)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                p, found = score_text(m, scores, text.as_py())
                if p <= m.alpha:
                    # A document that only its passages together make toxic keeps them all.
                    kept = [x for x in found if x[3] <= m.alpha] or found
                    rows.append({"doc_id": doc_id, "p_value": p, "n_segments": len(kept), "segments": [dict(zip(("start", "end", "score", "e_value"), x)) for x in kept]})
            yield pa.RecordBatch.from_pylist(rows, schema=ARROW)

    return map_arrow(docs.select(F.col("doc_id").cast("bigint"), "text"), run, RESULT)


ARROW = pa.schema([("doc_id", pa.int64()), ("p_value", pa.float64()), ("n_segments", pa.int32()), ("segments", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("e_value", pa.float64())])))])


def clean(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that aren't toxic, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        scores = Scores(m)
        for batch in batches:
            yield batch.filter(pa.array([score_text(m, scores, x.as_py())[0] > m.alpha for x in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
