"""A hidden Markov language model: Baum-Welch over partitions, exact scores by the scaled forward recursion.

Words (lower case) that occur at least ``min_count`` times are symbols of their own, however many that makes. Any other
word is the symbol RARE and is spelled by a model of byte pairs that is counted over all words and normalised over the
spellings that aren't symbols. So every text has a probability, and those of all word sequences of a length sum to 1.

Blocks and buckets. The corpus is read once, into blocks of whole documents with a list of words of their own, closed
by the document that reaches ``BLOCK_WORDS`` words. The emission table is never in one place: it lies in buckets of
words by a hash, with about ``EDGES`` pairs of block and word in each. In each iteration every bucket sends each block the rows of the block's own
symbols, the block runs forward and backward recursions over its documents and sends expected counts back, and the
bucket adds them up. Blocks and buckets are bucketed tables in the shared folder, so that they are read where they are
worked on; only these rows travel, in packed form. The driver sees initial and transition counts, sums by state and the likelihood, nothing that grows.

Training. The first counts are word frequencies, disturbed by hashes of word and state. Iterations end when the
likelihood gains less than ``tolerance`` of itself, or after ``iterations``. Neither blocks nor buckets change a
result. Long documents are cut into segments for the sake of speed alone: the products of their transfer matrices carry forward and backward messages
over the cuts exactly, so counts are those of whole documents.

Scores. log_likelihood is the exact natural logarithm of the probability of a document's words given their number: the
sum over all state sequences of the whole document.

Defined results: a null, empty or wordless text has no words, log_likelihood 0 and a null bits_per_word. Repeated rows,
and rows with a null doc_id, are scored, and count in training, as often as they stand there. Words of equal frequency
are alike; nothing is ranked. An empty table gives an empty result. Other columns are left out, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucketed, discard, map_arrow, written

RARE = 0
BLOCK_WORDS = 4_000_000
#: Pairs of block and word in a bucket, about.
EDGES = 200_000
#: Words whose recursions run side by side, and of a segment.
POOL, SEGMENT = 1_000_000, 2048
SPACE = 32
#: What stands between words: no letter, number or underscore.
BETWEEN = r"[^\p{L}\p{N}_]+"
#: Added to each expected count.
FLOOR = 1e-3
TOTALS = -1


@dataclass
class Parameters:
    start: np.ndarray  # states
    move: np.ndarray  # states x states
    emit: np.ndarray  # symbols x states; the first symbol is RARE

    def precise(self, shape: Shape) -> Parameters:
        emit = self.emit.astype(float)
        emit[RARE] = shape.rare
        return Parameters(shape.start, shape.move, emit)


@dataclass
class Shape:
    """What the driver holds of the model: all but the emissions of symbols, and what normalises those."""

    start: np.ndarray
    move: np.ndarray
    rare: np.ndarray  # emission of RARE
    sums: np.ndarray  # counts of all symbols by state


class Spelling:
    """Logarithm of a word's probability as a chain of UTF-8 bytes, given that it is no symbol."""

    def __init__(self, pairs: np.ndarray):
        p = pairs.reshape(256, 256) + 0.01
        p[SPACE, SPACE] = 0  # no empty word
        self.log = np.log(p / p.sum(axis=1, keepdims=True), where=p > 0, out=np.full_like(p, -np.inf))
        self.rest = 0.0

    def without(self, known: float) -> Spelling:
        """The same given that the word is none of those whose probabilities sum to known."""
        self.rest = math.log1p(-min(known, 1 - 1e-12))
        return self

    def each(self, words: list[str]) -> np.ndarray:
        data = np.frombuffer((" " + " ".join(words) + " ").encode(), np.uint8)
        steps = self.log[data[:-1], data[1:]]
        spaces = np.flatnonzero(data == SPACE)
        return np.add.reduceat(steps, spaces[:-1]) - self.rest


class Ids(dict):
    """Numbers of words in order of their first sight."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


BLOCKS = "block bigint, doc_ids array<bigint>, lengths binary, tokens binary, words binary, counts binary, n_words bigint, n_own bigint"


def pack(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(a.tobytes())


def unpack(data: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def words_of(data: bytes) -> list[str]:
    text = zstandard.ZstdDecompressor().decompress(data).decode()
    return text.split(" ") if text else []


def words_in(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts, in order, and how many each text has."""
    parts = pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(texts, "")), pattern=BETWEEN)
    words, ends = parts.flatten(), parts.offsets.to_numpy().astype(np.int64)
    real = pc.not_equal(words, "")  # before a first and after a last word stands an empty one
    lengths = np.diff(np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])[ends - ends[0]])
    return words.filter(real), lengths


def blocks_of(docs: DataFrame) -> DataFrame:
    """Blocks of documents: word numbers of all, and the words that they stand for with their counts."""
    names = [x.split()[0] for x in BLOCKS.split(", ")]
    kinds = [pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 4, pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, lengths, words, size, part, nth = [], [], [], 0, None, 0

        def block() -> pa.RecordBatch:
            found = pa.chunked_array(words, pa.string()).combine_chunks().dictionary_encode()
            found = found.combine_chunks() if isinstance(found, pa.ChunkedArray) else found
            tokens, own = found.indices.to_numpy().astype(np.int32), found.dictionary.to_pylist()
            counts = np.bincount(tokens, minlength=len(own)).astype(np.int64)
            text = zstandard.ZstdCompressor(level=1).compress(" ".join(own).encode())
            row = [part << 32 | nth, docs, pack(np.concatenate([*lengths, np.empty(0, np.int32)]).astype(np.int32)), pack(tokens), text, pack(counts), size, len(own)]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=names)

        for batch in batches:
            if part is None and batch.num_rows:
                part = batch.column(2)[0].as_py()
            for k in range(0, batch.num_rows, 500):
                some = batch.slice(k, 500)
                found, n = words_in(some.column(1))
                ends, ids, begun = np.cumsum(n), some.column(0).to_pylist(), 0
                while begun < len(n):
                    # Up to the document that fills the block.
                    before = int(ends[begun - 1]) if begun else 0
                    stop = min(len(n), int(np.searchsorted(ends, before + BLOCK_WORDS - size)) + 1)
                    docs += ids[begun:stop]
                    lengths.append(n[begun:stop])
                    words.append(found.slice(before, int(ends[stop - 1]) - before))
                    size, begun = size + int(ends[stop - 1]) - before, stop
                    if size >= BLOCK_WORDS:
                        yield block()
                        docs, lengths, words, size, nth = [], [], [], 0, nth + 1
        if docs:
            yield block()

    return map_arrow(docs.select(F.col("doc_id").cast("bigint"), "text", F.spark_partition_id().cast("bigint").alias("part")), run, BLOCKS)


def byte_pairs(blocks: DataFrame) -> np.ndarray:
    """Counts of byte pairs of all words, each between two spaces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = np.zeros(65536)
        for batch in batches:
            for w, c in zip(*(batch.column(k).to_pylist() for k in (0, 1))):
                if words := words_of(w):
                    data = np.frombuffer((" " + " ".join(words) + " ").encode(), np.uint8).astype(np.int32)
                    ends = np.flatnonzero(data == SPACE)
                    # A step belongs to the word before whose end it is.
                    pairs += np.bincount(data[:-1] << 8 | data[1:], np.repeat(unpack(c, np.int64), np.diff(ends)), 65536)
        at = np.flatnonzero(pairs)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(pairs[at])], names=["pair", "n"])

    out = np.zeros(65536)
    for r in map_arrow(blocks.select("words", "counts"), run, "pair int, n double").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        out[r.pair] = r.n
    return out


def first_counts(words: list[str], total: np.ndarray, states: int, seed: int) -> np.ndarray:
    """Counts of words for each state: their own, times exp(0.5 z) with normal z from a hash of the word."""
    turns = -(-states // 4)
    raw = np.frombuffer(b"".join(xxhash.xxh3_128_digest(w, seed=seed + k) for w in words for k in range(turns)), np.uint16)
    u = (raw.reshape(len(words), 4 * turns, 2)[:, :states] + 0.5) / 65536
    return total[:, None] * np.exp(0.5 * np.sqrt(-2 * np.log(u[..., 0])) * np.cos(2 * np.pi * u[..., 1]))


BOOK = "bucket int, blocks binary, sizes binary, locals binary, symbols binary, n_symbols bigint, n_words bigint, known double, initial binary, sums array<double>"


def book_of(blocks: DataFrame, buckets: int, spelling: Spelling, states: int, min_count: int, seed: int) -> DataFrame:
    """The buckets: which symbols of which blocks lie there, and their first emission counts."""
    shared = blocks.sparkSession.sparkContext.broadcast(spelling)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["bucket", "block", "words", "locals", "counts"]
        for batch in batches:
            for block, w, c in zip(*(batch.column(k).to_pylist() for k in range(3))):
                words, counts = np.array(words_of(w), object), unpack(c, np.int64)
                of = np.fromiter((xxhash.xxh3_64_intdigest(x) % buckets for x in words), np.int64, len(words))
                order = np.argsort(of, kind="stable")
                rows = [x for x in np.split(order, np.flatnonzero(np.diff(of[order])) + 1) if len(x)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([int(of[x[0]]) for x in rows], pa.int32()), pa.array([block] * len(rows), pa.int64()), pa.array([" ".join(words[x]) for x in rows], pa.string()),
                        pa.array([x.astype(np.int32).tobytes() for x in rows], pa.binary()), pa.array([counts[x].tobytes() for x in rows], pa.binary()),
                    ],
                    names=names,
                )

    def run(key, table):
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("block", "words", "locals", "counts"))))
        ids, total = Ids(), np.zeros(1024)
        each = []
        for _, w, _, c in rows:
            at = np.fromiter(map(ids.__getitem__, w.split(" ")), np.int32)
            if len(ids) > len(total):
                total = np.concatenate([total, np.zeros(max(len(total), len(ids) - len(total)))])
            total[at] += np.frombuffer(c, np.int64)
            each.append(at)
        words = np.array([*ids], object)
        # Symbols in order of their words, so that nothing depends on the order of blocks.
        kept = np.flatnonzero(total[: len(words)] >= min_count)
        kept = kept[np.argsort(words[kept], kind="stable")]
        number = np.full(len(words), -1, np.int32)
        number[kept] = np.arange(len(kept))
        blocks, sizes, local, symbol = [], [], [], []
        for (block, _, loc, _), at in zip(rows, each):
            has = number[at] >= 0
            if has.any():
                blocks.append(block)
                sizes.append(int(has.sum()))
                local.append(np.frombuffer(loc, np.int32)[has])
                symbol.append(number[at][has])
        counts = first_counts(words[kept].tolist(), total[kept], states, seed)
        known = float(np.exp(shared.value.each(words[kept].tolist())).sum()) if len(kept) else 0.0
        flat = lambda x: np.concatenate([*x, np.empty(0, np.int32)]).tobytes()
        return pa.table({
            "bucket": pa.array([key[0].as_py()], pa.int32()), "blocks": [np.array(blocks, np.int64).tobytes()], "sizes": [np.array(sizes, np.int32).tobytes()], "locals": [flat(local)], "symbols": [flat(symbol)], "n_symbols": [len(kept)], "n_words": [int(total[kept].sum())],
            "known": [known], "initial": [counts.astype(np.float32).tobytes()], "sums": [counts.sum(axis=0).tolist()],
        })

    pieces = map_arrow(blocks.select("block", "words", "counts"), split, "bucket int, block bigint, words string, locals binary, counts binary")
    return pieces.groupBy("bucket").applyInArrow(run, BOOK)


class TimeMajor:
    """Sequences of falling length side by side: at each step the first ``active[t]`` of them go on."""

    def __init__(self, sequences: list[np.ndarray]):
        self.order = np.argsort([-len(s) for s in sequences], kind="stable")
        lengths = np.array([len(sequences[i]) for i in self.order], np.int64)
        longest = int(lengths[0]) if len(lengths) else 0
        self.active = np.searchsorted(-lengths, -np.arange(1, longest + 1), side="right")
        self.begin = np.concatenate([[0], np.cumsum(self.active)])
        flat = np.concatenate([sequences[i] for i in self.order]) if longest else np.empty(0, np.int32)
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(lengths) else lengths
        step = np.arange(len(flat)) - np.repeat(starts, lengths)
        self.symbols = np.empty(len(flat), np.int32)
        self.symbols[self.begin[step] + np.repeat(np.arange(len(lengths)), lengths)] = flat


class Chains:
    """Sequences as segments side by side, with the messages that pass the cuts between them; arrays are states x places.

    ``before`` is a segment's normalised forward message from the one before it, ``after`` the backward one from the
    one behind it, scaled so that its product with the forward message at the segment's end is 1.
    """

    def __init__(self, p: Parameters, sequences: list[np.ndarray], backward: bool):
        cuts = [(d, k) for d, s in enumerate(sequences) for k in range(0, len(s), SEGMENT)]
        self.tm = tm = TimeMajor([sequences[d][k : k + SEGMENT] for d, k in cuts])
        self.doc, nth = (np.array([c[i] for c in cuts], np.int64)[tm.order] for i in (0, 1))
        self.seen = np.ascontiguousarray(p.emit[tm.symbols].T)
        self.first = nth == 0
        shape, kind = (len(p.start), len(cuts)), p.emit.dtype
        self.before, self.after = np.zeros(shape, kind), np.ones(shape, kind)
        rows = np.flatnonzero(np.bincount(self.doc, minlength=len(sequences))[self.doc] > 1)
        if len(rows):
            self.carry(p, rows, nth[rows] // SEGMENT, backward)

    def carry(self, p: Parameters, rows: np.ndarray, nth: np.ndarray, backward: bool) -> None:
        tm, back = self.tm, np.ascontiguousarray(p.move.T)
        seen = self.seen[:, rows]
        # Products of the steps of each segment; the first one's rows are all its forward message.
        x = np.where(self.first[rows], (p.start[:, None] * seen)[None], p.move[:, :, None] * seen[None])
        for t in range(1, len(tm.active)):
            m = np.searchsorted(rows, tm.active[t])
            if not m:
                break
            y = np.matmul(back, x[:, :, :m])
            y *= self.seen[:, tm.begin[t] + rows[:m]]
            y /= y.sum(axis=(0, 1))
            x[:, :, :m] = y
        place = {(d, k): i for i, (d, k) in enumerate(zip(self.doc[rows].tolist(), nth.tolist()))}
        layers = [np.flatnonzero(nth == 0)]
        for k in range(1, int(nth.max()) + 1):
            layers.append(np.array([i for i in (place.get((d, k)) for d in self.doc[rows[layers[-1]]].tolist()) if i is not None], np.int64))
        previous = np.array([place.get((d, k - 1), -1) for d, k in zip(self.doc[rows].tolist(), nth.tolist())])
        ends = np.empty((len(p.start), len(rows)), x.dtype)
        ends[:, layers[0]] = x[0][:, layers[0]] / x[0][:, layers[0]].sum(axis=0)
        for own in layers[1:]:
            v = ends[:, previous[own]]
            self.before[:, rows[own]] = v
            v = np.einsum("in,ijn->jn", v, x[:, :, own])
            ends[:, own] = v / v.sum(axis=0)
        if backward:
            for own in layers[:0:-1]:
                v = np.einsum("ijn,jn->in", x[:, :, own], self.after[:, rows[own]])
                to = previous[own]
                self.after[:, rows[to]] = v / (ends[:, to] * v).sum(axis=0)

    def start(self, p: Parameters) -> np.ndarray:
        """What comes into the first step of each segment."""
        return np.where(self.first, p.start[:, None], p.move.T @ self.before)


def forward(p: Parameters, sequences: list[np.ndarray]) -> np.ndarray:
    """Exact log-likelihood of each sequence."""
    chains = Chains(p, sequences, False)
    tm, back = chains.tm, np.ascontiguousarray(p.move.T)
    each = np.zeros(len(chains.doc))
    state = None
    for t, n in enumerate(tm.active):
        state = chains.start(p) if state is None else back @ state[:, :n]
        state *= chains.seen[:, tm.begin[t] : tm.begin[t] + n]
        scale = state.sum(axis=0)
        state /= scale
        each[:n] += np.log(scale)
    return np.bincount(chains.doc, each, len(sequences))


def expected(p: Parameters, sequences: list[np.ndarray], start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> float:
    """Adds the expected counts of all sequences to the arrays; returns their log-likelihood. In the parameters' precision."""
    chains = Chains(p, sequences, True)
    tm, seen, back = chains.tm, chains.seen, np.ascontiguousarray(p.move.T)
    if not len(tm.symbols):
        return 0.0
    alpha = np.empty((len(p.start), len(tm.symbols)), p.emit.dtype)
    scale = np.empty(len(tm.symbols), p.emit.dtype)
    x = None
    for t, n in enumerate(tm.active):
        here = slice(tm.begin[t], tm.begin[t] + n)
        x = chains.start(p) if x is None else back @ x[:, :n]
        x *= seen[:, here]
        x *= np.reciprocal(np.add.reduce(x, axis=0, out=scale[here]))
        alpha[:, here] = x
    seen /= scale
    joint, beta = np.zeros_like(p.move), None
    for t in range(len(tm.active) - 1, -1, -1):
        here = slice(tm.begin[t], tm.begin[t] + tm.active[t])
        now = chains.after[:, : tm.active[t]].copy()
        if beta is not None:
            m = tm.active[t + 1]
            there = slice(tm.begin[t + 1], tm.begin[t + 1] + m)
            beta *= seen[:, there]
            joint += alpha[:, tm.begin[t] : tm.begin[t] + m] @ beta.T
            now[:, :m] = p.move @ beta
        beta = now
        alpha[:, here] *= beta  # now the posterior
    # Transitions over the cuts.
    inner = np.flatnonzero(~chains.first)
    joint += chains.before[:, inner] @ (seen[:, inner] * beta[:, inner]).T
    move += joint * p.move
    start += alpha[:, : tm.active[0]][:, chains.first].sum(axis=1)
    for k in range(len(alpha)):
        emit[:, k] += np.bincount(tm.symbols, alpha[k], len(emit))
    return float(np.log(scale.astype(float)).sum())


def pools(sequences: Iterator[np.ndarray]) -> Iterator[list[np.ndarray]]:
    pool, size = [], 0
    for s in sequences:
        pool.append(s)
        size += len(s)
        if size >= POOL:
            yield pool
            pool, size = [], 0
    if pool:
        yield pool


def sent(book: DataFrame, state: DataFrame, shape: Shape) -> DataFrame:
    """(block, bucket, locals, values): emissions of each block's symbols, from the counts (bucket, counts)."""
    states = len(shape.start)

    def run(key, own, counts):
        if not own.num_rows or not counts.num_rows:
            return pa.table({"block": pa.array([], pa.int64()), "bucket": pa.array([], pa.int32()), "locals": pa.array([], pa.binary()), "values": pa.array([], pa.binary())})
        blocks, sizes, local, symbol = (np.frombuffer(own.column(c)[0].as_py(), k) for c, k in (("blocks", np.int64), ("sizes", np.int32), ("locals", np.int32), ("symbols", np.int32)))
        emit = ((np.frombuffer(counts.column("counts")[0].as_py(), np.float32).reshape(-1, states) + FLOOR) / shape.sums).astype(np.float32)
        ends = np.cumsum(sizes, dtype=np.int64)
        rows = [(local[e - n : e].tobytes(), emit[symbol[e - n : e]].tobytes()) for e, n in zip(ends, sizes)]
        return pa.table({"block": pa.array(blocks), "bucket": pa.array([key[0].as_py()] * len(blocks), pa.int32()), "locals": pa.array([x for x, _ in rows], pa.binary()), "values": pa.array([v for _, v in rows], pa.binary())})

    return book.select("bucket", "blocks", "sizes", "locals", "symbols").groupBy("bucket").cogroup(state.groupBy("bucket")).applyInArrow(run, "block bigint, bucket int, locals binary, values binary")


def of_block(shape: Shape, n_own: int, rows: pa.Table) -> tuple[Parameters, np.ndarray, list[tuple[int, np.ndarray]]]:
    """A block's parameters, the symbol of each of its words, and the words that each bucket sent."""
    states = len(shape.start)
    sent = sorted(zip(*(rows.column(c).to_pylist() for c in ("bucket", "locals", "values"))))
    places = [(bucket, np.frombuffer(x, np.int32)) for bucket, x, _ in sent]
    emit = np.concatenate([shape.rare[None].astype(np.float32), *(np.frombuffer(v, np.float32).reshape(-1, states) for *_, v in sent)])
    symbol = np.full(n_own, RARE, np.int32)
    at = 1
    for _, x in places:
        symbol[x] = np.arange(at, at + len(x))
        at += len(x)
    return Parameters(shape.start.astype(np.float32), shape.move.astype(np.float32), emit), symbol, places


def sequences_of(lengths: bytes, tokens: bytes, symbol: np.ndarray) -> list[np.ndarray]:
    flat = symbol[unpack(tokens, np.int32)]
    return np.split(flat, np.cumsum(unpack(lengths, np.int32))[:-1])


def iterate(blocks: DataFrame, book: DataFrame, state: DataFrame, shape: Shape, n_symbols: int) -> tuple[DataFrame, Shape, float]:
    """One Baum-Welch iteration; also the log-likelihood under the parameters before it."""
    states = len(shape.start)

    def run(key, own, rows):
        p, symbol, places = of_block(shape, own.column("n_own")[0].as_py(), rows)
        # Documents of like length run side by side.
        sequences = sorted(sequences_of(own.column("lengths")[0].as_py(), own.column("tokens")[0].as_py(), symbol), key=len)
        for q in (p, p.precise(shape)):  # single precision is enough, unless messages leave its range
            start, move, emit, total = np.zeros(states), np.zeros((states, states)), np.zeros(q.emit.shape, order="F"), 0.0
            with np.errstate(all="ignore"):
                for pool in pools(iter(sequences)):
                    total += expected(q, pool, start, move, emit)
            if math.isfinite(total + start.sum() + move.sum() + emit.sum()):
                break
        totals = np.concatenate([start, move.ravel(), emit[RARE], emit.sum(axis=0), [total]])
        at, values = 1, [totals.tobytes()]
        for _, x in places:
            values.append(emit[at : at + len(x)].astype(np.float32).tobytes())
            at += len(x)
        return pa.table({"bucket": pa.array([TOTALS, *(b for b, _ in places)], pa.int32()), "block": pa.array([key[0].as_py()] * len(values), pa.int64()), "values": pa.array(values, pa.binary())})

    def add(key, own, rows):
        if key[0].as_py() == TOTALS:
            by_block = sorted(zip(rows.column("block").to_pylist(), rows.column("values").to_pylist()))
            out, kind = np.sum([np.frombuffer(v) for _, v in by_block], axis=0), float
        else:
            blocks, sizes, symbol = (np.frombuffer(own.column(c)[0].as_py(), k) for c, k in (("blocks", np.int64), ("sizes", np.int32), ("symbols", np.int32)))
            ends = np.cumsum(sizes, dtype=np.int64)
            span = {int(b): (e - n, e) for b, e, n in zip(blocks, ends, sizes)}
            out, kind = np.zeros((own.column("n_symbols")[0].as_py(), states)), np.float32
            for b, v in sorted(zip(rows.column("block").to_pylist(), rows.column("values").to_pylist())):
                a, e = span[b]
                out[symbol[a:e]] += np.frombuffer(v, np.float32).reshape(-1, states)
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([out.astype(kind).tobytes()], pa.binary())})

    counted = blocks.select("block", "lengths", "tokens", "n_own").groupBy("block").cogroup(sent(book, state, shape).groupBy("block")).applyInArrow(run, "bucket int, block bigint, values binary")
    following = written(book.select("bucket", "blocks", "sizes", "symbols", "n_symbols").groupBy("bucket").cogroup(counted.groupBy("bucket")).applyInArrow(add, "bucket int, counts binary"))
    totals = np.frombuffer(following.where(F.col("bucket") == TOTALS).first().counts)
    start, move, rare, sums, log = np.split(totals, np.cumsum([states, states * states, states, states]))
    start, move, sums = start + FLOOR, move.reshape(states, states) + FLOOR, sums + FLOOR * (n_symbols + 1)
    return following.where(F.col("bucket") != TOTALS), Shape(start / start.sum(), move / move.sum(axis=1, keepdims=True), (rare + FLOOR) / sums, sums), float(log[0])


@dataclass
class Model:
    """A trained model beside its corpus: blocks, buckets, the buckets' counts, and what the driver holds."""

    blocks: DataFrame
    book: DataFrame
    state: DataFrame
    shape: Shape
    spelling: Spelling


def train(docs: DataFrame, states: int = 8, iterations: int = 20, tolerance: float = 2e-3, min_count: int = 2, seed: int = 1) -> tuple[Model, list[float]]:
    """The trained model, and the log-likelihood before each iteration (symbols alone, without the spelling of rare words)."""
    # Both tables are bucketed by their numbers, so that no iteration moves them.
    blocks = bucketed(blocks_of(docs), "block", docs.rdd.getNumPartitions())
    n_edges, n_words = blocks.agg(F.sum("n_own"), F.sum("n_words")).first()
    spelling = Spelling(byte_pairs(blocks))
    buckets = max(1, -(-(n_edges or 0) // EDGES))
    book = bucketed(book_of(blocks.where("n_own > 0"), buckets, spelling, states, min_count, seed), "bucket", buckets)
    row = book.agg(F.sum("n_symbols"), F.sum("known"), F.sum("n_words"), *(F.sum(F.get("sums", F.lit(k))) for k in range(states))).first()
    n_symbols, known, sums = row[0] or 0, row[1] or 0.0, np.array([x or 0.0 for x in row[3:]])
    spelling.without(known)
    rare = (n_words or 0) - (row[2] or 0) + 1.0
    sums = sums + FLOOR * (n_symbols + 1) + rare
    shape = Shape(np.full(states, 1 / states), np.full((states, states), 0.2 / states) + 0.8 * np.eye(states), (rare + FLOOR) / sums, sums)
    state, history = book.select("bucket", F.col("initial").alias("counts")), []
    while n_words and len(history) < iterations:
        last = state
        state, shape, before = iterate(blocks, book, state, shape, n_symbols)
        if history:
            discard(last)
        del last
        history.append(before)
        if len(history) > 1 and before - history[-2] < tolerance * abs(before):
            break
    return Model(blocks, book, state, shape, spelling), history


def scores(model: Model) -> DataFrame:
    """(doc_id, n_words, log_likelihood, bits_per_word) of every document."""
    shape = model.shape
    shared = model.blocks.sparkSession.sparkContext.broadcast(model.spelling)

    def run(key, own, rows):
        p, symbol, _ = of_block(shape, own.column("n_own")[0].as_py(), rows)
        p = p.precise(shape)
        lengths, tokens = unpack(own.column("lengths")[0].as_py(), np.int32), unpack(own.column("tokens")[0].as_py(), np.int32)
        rare = np.flatnonzero(symbol == RARE)
        spelled = np.zeros(len(symbol))
        if len(rare):
            words = words_of(own.column("words")[0].as_py())
            spelled[rare] = shared.value.each([words[i] for i in rare])
        ends = np.cumsum(lengths, dtype=np.int64)
        log = np.zeros(len(lengths))
        has = np.flatnonzero(lengths)
        if len(has):
            log[has] = np.add.reduceat(spelled[tokens], (ends - lengths)[has])
        sequences = np.split(symbol[tokens], ends[:-1])
        # Documents of like length run side by side.
        order = np.argsort(lengths, kind="stable")
        k = 0
        for pool in pools(sequences[i] for i in order):
            log[order[k : k + len(pool)]] += forward(p, pool)
            k += len(pool)
        bits = [-x / m / math.log(2) if m else None for x, m in zip(log.tolist(), lengths.tolist())]
        return pa.table({"doc_id": pa.array(own.column("doc_ids")[0].as_py(), pa.int64()), "n_words": pa.array(lengths.astype(np.int64)), "log_likelihood": log, "bits_per_word": pa.array(bits, pa.float64())})

    rows = sent(model.book, model.state, shape)
    return model.blocks.select("block", "doc_ids", "lengths", "tokens", "words", "n_own").groupBy("block").cogroup(rows.groupBy("block")).applyInArrow(run, "doc_id bigint, n_words bigint, log_likelihood double, bits_per_word double")


def score(docs: DataFrame, **options) -> DataFrame:
    return scores(train(docs, **options)[0])
