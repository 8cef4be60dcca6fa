"""Document quality from a linear-chain conditional random field over lines.

Each line is labelled good or bad. Its features are shares of character classes, repeated words, word and line
lengths, how it begins and ends and whether the document has it before; the same features of the line before and
the line after stand beside its own. A transition matrix links neighbouring labels. Weights maximise the
conditional likelihood of the labels of a bounded sample of labelled documents, with an L2 penalty. A line carries
its document's label; so that chains have borders to learn from, documents of the rarer class are also joined with
those of the other, by turns before and behind them, as chains whose label changes in between, half as many as there
are of the other class. A document's quality is the mean of its lines' forward-backward marginals of "good", weighted by line length; it is kept from ``threshold`` on.

The sample, which alone goes to the driver: at most ``sample`` labelled rows in the order of a hash of their id, those
of over ``longest`` characters left out, up to ``max_lines`` lines in all. Any text, however long, is assessed whole.

Defined results: a text that is null, empty or blank has a null quality and isn't kept. Repeated rows, and rows with a
null doc_id, are judged alike. Lines are separated by line feeds; a last empty line counts as a line of length 0.
Conflicting labels of one doc_id count as bad. Without labels of both classes no line can be told apart, and every text
with a line is kept. An empty table gives an empty result. Other columns are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

LOWER, UPPER, DIGIT, SPACE, POINT, SYMBOL, BAR, LETTER, REST = range(9)
OWN = 14
FEATURES = 3 * OWN + 2


def byte_classes() -> np.ndarray:
    table = np.full(256, SYMBOL, np.uint8)
    for chars, kind in ((range(97, 123), LOWER), (range(65, 91), UPPER), (range(48, 58), DIGIT), (b" \t\r\n\v\f", SPACE), (b".,;:!?'\"()-", POINT), (b"|", BAR), (range(0xC0, 0x100), LETTER), (range(0x80, 0xC0), REST)):
        table[[*chars]] = kind
    return table


TABLE = byte_classes()


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features (lines x FEATURES), line lengths in characters, and the number of lines of each text."""
    lines: list[str] = []
    count, again, various, words = [], [], [], []
    for text in texts:
        own = text.split("\n")
        count.append(len(own))
        seen: set[str] = set()
        for line in own:
            parts = line.split()
            words.append(len(parts))
            various.append(len(set(parts)))
            again.append(line in seen)
            seen.add(line)
        lines += own
    data = np.frombuffer(("\n".join(lines) + "\n").encode(), np.uint8)
    ends = np.flatnonzero(data == 10)
    begins = np.concatenate([[0], ends[:-1] + 1])
    kinds = TABLE[data]
    each = np.stack([np.add.reduceat(kinds == k, begins, dtype=np.int64) for k in range(REST)], axis=1).astype(float)
    each[:, SPACE] -= 1  # the line feed
    size = each.sum(axis=1)
    full, n = np.maximum(size, 1), np.maximum(np.array(words, float), 1)
    letters = np.maximum(each[:, [LOWER, UPPER, LETTER]].sum(axis=1), 1)
    first, final = data[begins], data[np.maximum(ends - 1, begins)]
    x = np.zeros((len(lines), FEATURES))
    own = np.stack(
        [
            size > 0, each[:, UPPER] / letters, each[:, DIGIT] / full, np.minimum(1, 4 * each[:, SYMBOL] / full), np.minimum(1, 4 * each[:, POINT] / full), np.minimum(1, 8 * each[:, BAR] / full), 1 - np.array(various) / n,
            np.minimum(2, letters / n / 8), np.log1p(size) / 8, np.isin(final, [*b".!?"]), np.isin(TABLE[first], [UPPER, LETTER]), np.array(again), (each[:, SYMBOL] > 0.03 * full), (np.array(words) < 4),
        ],
        axis=1,
    )
    starts = np.concatenate([[0], np.cumsum(count)[:-1]]).astype(np.int64)
    stops = np.cumsum(count) - 1
    x[:, :OWN] = own
    x[1:, OWN : 2 * OWN] = own[:-1]
    x[:-1, 2 * OWN : 3 * OWN] = own[1:]
    x[starts, OWN : 2 * OWN] = 0
    x[stops, 2 * OWN : 3 * OWN] = 0
    x[starts, -2] = 1
    x[stops, -1] = 1
    return x, size, np.array(count)


@dataclass
class Field:
    """Log-odds of a good line by feature, and the transition scores between bad (0) and good (1)."""

    weights: np.ndarray
    move: np.ndarray


def steps(count: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """For each step: rows of the documents that are so long, longest document first, and how many."""
    order = np.argsort(-count, kind="stable")
    starts = np.concatenate([[0], np.cumsum(count)[:-1]])[order]
    active = np.searchsorted(-count[order], -np.arange(1, count.max(initial=0) + 1), side="right")
    return [(starts[:n] + t, n) for t, n in enumerate(active)]


def marginals(field: Field, odds: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Probability of good for each line, expected transitions (2 x 2), and the logarithm of the normaliser."""
    plan = steps(count)
    unary = np.stack([np.zeros_like(odds), odds], axis=1)
    top = unary.max(axis=1, keepdims=True)
    unary, move, peak = np.exp(unary - top), np.exp(field.move - field.move.max()), field.move.max()
    alpha, scale = np.empty_like(unary), np.empty(len(odds))
    log = float(top.sum()) + peak * (len(odds) - len(count))
    before = None
    for rows, n in plan:
        a = unary[rows] if before is None else (alpha[before[:n]] @ move) * unary[rows]
        scale[rows] = s = a.sum(axis=1)
        alpha[rows] = a / s[:, None]
        before = rows
    log += float(np.log(scale).sum())
    joint, beta, later = np.zeros((2, 2)), None, None
    good = np.empty(len(odds))
    for rows, n in reversed(plan):
        now = np.ones((n, 2))
        if later is not None:
            ahead = unary[later] * beta / scale[later, None]
            joint += (alpha[rows[: len(later)]].T @ ahead) * move
            now[: len(later)] = ahead @ move.T
        good[rows] = alpha[rows, 1] * now[:, 1]
        beta, later = now, rows
    return good, joint, log


def fit(x: np.ndarray, count: np.ndarray, label: np.ndarray, penalty: float = 1.0, rounds: int = 200) -> Field:
    """Weights of greatest penalised conditional likelihood; label holds 1 or 0 for each line."""
    field = Field(np.zeros(x.shape[1]), np.zeros((2, 2)))
    inner = np.ones(len(label), bool)
    inner[np.cumsum(count)[:-1]] = False
    inner[0] = False
    pairs = np.zeros((2, 2))
    np.add.at(pairs, (label[:-1][inner[1:]], label[1:][inner[1:]]), 1)
    target, n = x.T @ label, len(label)
    m, v = np.zeros(x.shape[1] + 4), np.zeros(x.shape[1] + 4)
    for i in range(1, rounds + 1):
        good, joint, _ = marginals(field, x @ field.weights, count)
        slope = np.concatenate([target - x.T @ good - penalty * field.weights, (pairs - joint).ravel() - penalty * field.move.ravel()]) / n
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        step = 0.2 * (1 - i / (rounds + 1)) * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
        field = Field(field.weights + step[:-4], field.move + step[-4:].reshape(2, 2))
    return field


def features_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all lines, and the number of lines of each text."""
    parts = [line_features(texts[k : k + 500]) for k in range(0, len(texts), 500)]
    return np.concatenate([x for x, _, _ in parts]), np.concatenate([n for _, _, n in parts])


def joined(texts: list[str], quality: list[int]) -> tuple[list[str], np.ndarray]:
    """A text of the rarer class and one of the other, by turns in both orders, as one text; and the labels of all lines."""
    at = [[i for i, q in enumerate(quality) if q == k] for k in (0, 1)]
    rare, often = sorted(at, key=len)
    n = max(len(rare), len(often) // 2)
    pairs = [(rare[k % len(rare)], often[k % len(often)])[:: 1 - 2 * ((k + k // len(rare)) % 2)] for k in range(n)]
    label = np.concatenate([np.repeat([quality[a], quality[b]], [texts[a].count("\n") + 1, texts[b].count("\n") + 1]) for a, b in pairs])
    return [f"{texts[a]}\n{texts[b]}" for a, b in pairs], label


def train(docs: DataFrame, labels: DataFrame, sample: int = 6000, longest: int = 100_000, max_lines: int = 200_000) -> Field | None:
    """A field from a bounded sample of labelled documents; None if their labels are all alike."""
    each = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    picked = each.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    usable = docs.select(F.col("doc_id").cast("bigint"), "text").where(f"length(trim(text)) > 0 and length(text) <= {longest:d}")
    rows = usable.join(F.broadcast(picked), "doc_id").select("doc_id", F.col("quality").cast("int").alias("quality"), "text").orderBy(F.xxhash64("doc_id"), "doc_id", "text")
    texts, quality, lines = [], [], 0
    for r in rows.toLocalIterator():
        lines += r.text.count("\n") + 1
        if lines > max_lines or len(texts) == sample:
            break
        texts.append(r.text)
        quality.append(r.quality)
    if len({*quality}) < 2:
        return None
    x, count = features_of(texts)
    label = np.repeat(quality, count)
    mixed, borders = joined(texts, quality)
    y, more = features_of(mixed)
    return fit(np.concatenate([x, y]), np.concatenate([count, more]), np.concatenate([label, borders]))


def assess(docs: DataFrame, field: Field | None, threshold: float = 0.5) -> DataFrame:
    """(doc_id, quality, keep, n_lines, bad_lines) of every row; bad_lines are the numbers of lines labelled bad."""
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                part = batch.slice(k, 2000)
                texts = part.column(1).to_pylist()
                blank = [not t or t.isspace() for t in texts]
                x, size, count = line_features([t or "" for t in texts])
                good = marginals(model, x @ model.weights, count)[0] if model else np.ones(len(x))
                ends = np.cumsum(count)
                total = np.add.reduceat(size, ends - count)
                quality = np.clip(np.add.reduceat(size * good, ends - count) / np.maximum(total, 1), 0, 1)
                bad = [np.flatnonzero(good[e - c : e] < 0.5) for e, c in zip(ends, count)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), pa.array(quality, mask=np.array(blank)), pa.array((quality >= threshold) & ~np.array(blank)),
                        pa.array([0 if t is None else c for t, c in zip(texts, count.tolist())], pa.int32()), pa.array([[] if e else b for b, e in zip(bad, blank)], pa.list_(pa.int32())),
                    ],
                    names=["doc_id", "quality", "keep", "n_lines", "bad_lines"],
                )

    return map_arrow(docs.select(F.col("doc_id").cast("bigint"), "text"), run, "doc_id bigint, quality double, keep boolean, n_lines int, bad_lines array<int>")
