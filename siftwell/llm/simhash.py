"""Near-duplicate documents: SimHash fingerprints and vantage-point trees.

Fingerprint. Each distinct word (lower case) of a text votes with the bits of its 128-bit hash; the majority
sign of each bit position is the fingerprint. Two documents are near copies if their fingerprints differ in at
most ``LIMIT`` = 23 of 128 bits and they share at least ``SHARED`` = 0.6 of their distinct words (of either): few
words give fingerprints that lie close by chance. Documents with equal fingerprints, numbers of words and parities of
the words in 64 classes of hashes share one search entry.

Search. A fingerprint is cut into 8 blocks of 16 bits. If two differ in at most 23 bits, then in at least one
block they differ in at most 2 (8 blocks with 3 or more would make 24), so the union over the blocks of exact
searches of radius 2 in the block's Hamming metric has every pair. In each block fingerprints are partitioned by
their distance to fixed vantage points. A fingerprint lives in the shard of its own distances and visits, as a
query, the shards whose distances are within the radius: by the triangle inequality no pair is lost, and each
pair of shards meets once. The vantage points differ from each other in even numbers of bits, so a fingerprint's
distances to them are all even or all odd, and only such shards are visited. Inside a shard a vantage-point tree over
the distinct block values prunes branches through the triangle bounds; survivors are compared over the 64 bits of the
half that the block isn't in, then over all 128. Pairs whose numbers of words or parities show that they share too few
go at once: such pairs of short texts grow with the square of the corpus. A pair is told by the first block that has it,
so none is found twice and no pairs are shuffled to make them distinct. A worker holds a shard's own fingerprints and
gets those that visit after them, a batch at a time. More vantage points are used as fingerprints grow in number; a
shard that still has more than ``SHARD_ROWS`` own rows is divided, later divisions are visited by earlier ones and all
by visitors, so that what a worker holds is bounded at any size.

Confirmation. The words of documents that have a pair, as 64-bit hashes, are brought together with their pairs by
component of the unconfirmed pairs; a component of more than ``TOGETHER`` documents is divided, and the pairs of each
two of its divisions are confirmed on their own. Pairs come after the words of their cell and aren't held; those whose ends
confirmed pairs link already aren't looked at, which changes no group.

Groups are the connected components of the confirmed pairs, found by alternating large-star and small-star steps.

Defined results: a null, empty or wordless text has no fingerprint and belongs to no group. A null doc_id is
compared with nothing and its row stays. Repeated rows are copies: one stays. Rows of one doc_id with unlike texts
are versions of one document: its group lists the doc_id once for each, and one row of each text stays. The document
with the smallest doc_id of a group stays. The search is exact: every fingerprint is a query, and no count of partners
is capped. Texts of any length vote with all their words. An empty table has no groups, and stays as it is. Other
columns stay, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import groupby, product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHE_WORDS, WORD, checkpointed, join_ids, map_arrow

BLOCKS, BITS, RADIUS = 8, 16, 2
LIMIT = BLOCKS * (RADIUS + 1) - 1
#: Vantage points of a block's metric: each halves what the ones before leave together.
VANTAGES = (0x5A3C, 0x5A3C ^ 0x00FF, 0x5A3C ^ 0x0F0F, 0x5A3C ^ 0x3333)
#: Fingerprints up to which one vantage point is enough; each further one serves this many times more.
LEVEL_ROWS, LEVEL_FACTOR = 5_000_000, 5
#: Own fingerprints of a shard that a worker holds at once; those that visit aren't held.
SHARD_ROWS = 500_000
#: Fingerprints that ask a shard at once, about.
ASKED = 50_000
#: Pairs of block values, or of fingerprints, that are compared at once: what a core's cache holds.
CHUNK = 1 << 17
#: Pairs of two block values from which their fingerprints are compared as a table of their own.
TILE = 1_000
#: Share of the distinct words of two documents that both have, at least.
SHARED = 0.6
#: Share of the sum of both numbers of words that only one of them has, at most, to share that much.
UNLIKE = (1 - SHARED) / (1 + SHARED) + 1e-9
#: Documents whose words are held at once, in about this number.
TOGETHER = 2_000
#: Nodes that a worker's forest knows at once; beyond them it begins anew, with more edges and no fewer links.
FOREST = 500_000


class Words(dict):
    """Signs of a word's hash bits, by row of a table."""

    def __init__(self):
        super().__init__()
        self.digests: list[bytes] = []  # of words whose signs aren't made yet
        self.made = np.empty((1024, 128), np.int8)
        self.classes = np.empty(1024, np.uint8)  # of the 64 whose parities tell sets apart
        self.n = 0

    def __missing__(self, word: str) -> int:
        self[word] = n = self.n + len(self.digests)
        self.digests.append(xxhash.xxh3_128_digest(word))
        return n

    def empty(self) -> None:
        self.clear()
        self.digests.clear()
        self.n = 0

    def signs(self) -> np.ndarray:
        if self.digests:
            n = self.n + len(self.digests)
            if n > len(self.made):
                grown = np.empty((max(n, 2 * len(self.made)), 128), np.int8)
                grown[: self.n] = self.made[: self.n]
                self.made = grown
                self.classes = np.resize(self.classes, len(grown))
            new = np.frombuffer(b"".join(self.digests), np.uint8).reshape(-1, 16)
            self.made[self.n : n] = np.unpackbits(new, axis=1).view(np.int8) * 2 - 1
            self.classes[self.n : n] = new[:, 15] & 63
            self.digests.clear()
            self.n = n
        return self.made


def marked(texts: list[str | None], words: Words) -> list[tuple[bytes, int, bytes] | None]:
    """For each text the 16 bytes of its fingerprint, its number of distinct words and 8 bytes of their parities; None where it has no word.

    The parities are of the numbers of words in 64 classes of hashes. Two sets differ in a word at least for each class
    whose parities differ, so sets that differ in too many are known without a look at the words.
    """
    if len(words) > CACHE_WORDS:
        words.empty()
    each = []
    for text in texts:
        own = {*WORD.findall(text.lower())} if text else ()
        each.append(np.fromiter(map(words.__getitem__, own), np.int32, len(own)))
    signs = words.signs()
    out: list[tuple[bytes, int, bytes] | None] = []
    for ids in each:
        # Sums of a few thousand rows at a time stay small enough for the cache.
        total = sum((signs[ids[k : k + 4096]].sum(axis=0, dtype=np.int32) for k in range(0, len(ids), 4096)), np.zeros(128, np.int32))
        parity = np.packbits(np.bincount(words.classes[ids], minlength=64) & 1)
        out.append((np.packbits(total > 0).tobytes(), len(ids), parity.tobytes()) if len(ids) else None)
    return out


def fingerprints_of(texts: list[str | None], words: Words) -> list[bytes | None]:
    """16 bytes for each text, None where it has no word."""
    return [x and x[0] for x in marked(texts, words)]


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, hi, lo, n, parity), for every document that has a fingerprint: its two 64-bit halves, the number of distinct words and their parities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                all_rows = marked(part.column(1).to_pylist(), words)
                rows = [x for x in all_rows if x is not None]
                halves = np.frombuffer(b"".join(x[0] for x in rows), ">i8").astype(np.int64).reshape(-1, 2)
                parity = np.frombuffer(b"".join(x[2] for x in rows), ">i8").astype(np.int64)
                has = pa.array([x is not None for x in all_rows], pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column(0).filter(has), pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array([x[1] for x in rows], pa.int32()), pa.array(parity)], names=["doc_id", "hi", "lo", "n", "parity"])

    return map_arrow(docs.select(F.col("doc_id").cast("bigint"), "text").where("doc_id is not null and text is not null"), run, "doc_id bigint, hi bigint, lo bigint, n int, parity bigint")


def tree_pairs(home: np.ndarray, query: np.ndarray, radius: int = RADIUS, leaf: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Positions (in query, in home) of all block values within the radius, by a vantage-point tree over home."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    todo = [(np.arange(len(home)), np.arange(len(query)))]
    while todo:
        own, asked = todo.pop()
        if not len(own) or not len(asked):
            continue
        vantage = home[own[len(own) // 2]]
        d = np.bitwise_count(home[own] ^ vantage)
        middle = int(np.median(d))
        if d.max() == middle:
            middle -= 1
        if len(own) <= leaf or middle < d.min():
            step = max(1, CHUNK // len(own))
            for k in range(0, len(asked), step):
                q, h = np.nonzero(np.bitwise_count(query[asked[k : k + step], None] ^ home[None, own]) <= radius)
                found.append((asked[k : k + step][q], own[h]))
            continue
        to = np.bitwise_count(query[asked] ^ vantage).astype(np.int16)
        # |d(q,v) - d(x,v)| <= d(q,x): a branch whose distances are all further than the radius holds no result.
        todo.append((own[d <= middle], asked[to <= middle + radius]))
        todo.append((own[d > middle], asked[to > middle - radius]))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([q for q, _ in found]), np.concatenate([h for _, h in found])


def block_values(hi: np.ndarray, lo: np.ndarray, block: int) -> np.ndarray:
    half, shift = (hi, 48 - 16 * block) if block < 4 else (lo, 48 - 16 * (block - 4))
    return ((half >> np.uint64(shift)) & np.uint64(0xFFFF)).astype(np.uint16)


class Shard:
    """Fingerprints (rep, hi, lo, n, parity) of which those that ask are near, for one block."""

    def __init__(self, block: int, rows: tuple[np.ndarray, ...]):
        self.block = block
        value = block_values(rows[1], rows[2], block)
        order = np.argsort(value, kind="stable")
        self.rows = tuple(x[order] for x in rows)
        self.values, self.first, self.size = np.unique(value[order], return_index=True, return_counts=True)

    def inside(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Near pairs (a, b, distance), a < b, of its own fingerprints that no earlier block has."""
        for k in range(0, len(self.rows[0]), ASKED):
            yield from self._near(tuple(x[k : k + ASKED] for x in self.rows), k)

    def asked(self, rows: tuple[np.ndarray, ...]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Such pairs of its own fingerprints and others."""
        order = np.argsort(block_values(rows[1], rows[2], self.block), kind="stable")
        for k in range(0, len(order), ASKED):
            yield from self._near(tuple(x[order[k : k + ASKED]] for x in rows), None)

    def _near(self, rows, at: int | None):
        """rows in order of their values; at: their place among the shard's own, of which only later ones count then."""
        values, start, count = np.unique(block_values(rows[1], rows[2], self.block), return_index=True, return_counts=True)
        q, h = tree_pairs(self.values, values)
        if at is not None:
            later = self.values[h] >= values[q]
            q, h = q[later], h[later]
        order = np.argsort(q, kind="stable")
        q, h = q[order], h[order]
        # Most pairs differ in over LIMIT bits of the half that the block isn't in.
        far = 2 if self.block < 4 else 1
        asking, own, size = rows[far], self.rows[far], self.size[h]
        each = np.bincount(q, size, len(values)).astype(np.int64)  # own fingerprints near a value
        for lot in lots(each):
            u, v = np.searchsorted(q, [lot[0], lot[-1] + 1])
            ends = np.cumsum(size[u:v])
            near = np.arange(int(ends[-1]) if v > u else 0) + np.repeat(self.first[h[u:v]] - ends + size[u:v], size[u:v])
            half, begins = own[near], np.cumsum(each[lot]) - each[lot]
            many = each[lot] * count[lot]
            for k in np.flatnonzero(many >= TILE):
                ours, theirs = half[begins[k] : begins[k] + each[lot[k]]], near[begins[k] : begins[k] + each[lot[k]]]
                step = max(1, CHUNK // len(ours))
                for x in range(start[lot[k]], start[lot[k]] + count[lot[k]], step):
                    mine = asking[x : min(x + step, start[lot[k]] + count[lot[k]])]
                    for y in range(0, len(ours), CHUNK):
                        part = ours[y : y + CHUNK]
                        hit = np.flatnonzero(np.bitwise_count(mine[:, None] ^ part) <= LIMIT)
                        if len(hit):
                            yield from self._told(rows, x + hit // len(part), theirs[y + hit % len(part)], at)
            few = np.flatnonzero((many < TILE) & (many > 0))
            if len(few):
                # Every asking fingerprint with the own ones near its value, in one row.
                x = np.repeat(start[lot[few]], count[lot[few]])
                x += np.arange(len(x)) - np.repeat(np.cumsum(count[lot[few]]) - count[lot[few]], count[lot[few]])
                n, begin = np.repeat(each[lot[few]], count[lot[few]]), np.repeat(begins[few], count[lot[few]])
                for some in lots(n):
                    m = n[some]
                    y = np.arange(m.sum()) + np.repeat(begin[some] - np.cumsum(m) + m, m)
                    hit = np.flatnonzero(np.bitwise_count(np.repeat(asking[x[some]], m) ^ half[y]) <= LIMIT)
                    if len(hit):
                        yield from self._told(rows, x[some][np.searchsorted(np.cumsum(m), hit, side="right")], near[y[hit]], at)

    def _told(self, rows, x: np.ndarray, y: np.ndarray, at: int | None):
        """The pairs of positions that are near, can share enough words and aren't told by an earlier block."""
        if at is not None:
            later = y > x + at
            x, y = x[later], y[later]
        hi, lo = rows[1][x] ^ self.rows[1][y], rows[2][x] ^ self.rows[2][y]
        d = np.bitwise_count(hi).astype(np.int32) + np.bitwise_count(lo)
        keep = np.flatnonzero(d <= LIMIT)
        x, y, hi, lo, d = x[keep], y[keep], hi[keep], lo[keep], d[keep]
        n, m = rows[3][x], self.rows[3][y]
        apart = np.maximum(np.abs(n - m), np.bitwise_count(rows[4][x] ^ self.rows[4][y]))
        good = (apart <= UNLIKE * (n + m)) & (rows[0][x] != self.rows[0][y])
        for earlier in range(self.block):
            good &= np.bitwise_count(block_values(hi, lo, earlier)) > RADIUS
        if good.any():
            u, v = rows[0][x[good]], self.rows[0][y[good]]
            yield np.minimum(u, v), np.maximum(u, v), d[good]


def lots(sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Positions in order, in lots whose sizes come to about CHUNK."""
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // CHUNK, prepend=0)) + 1
    for part in np.split(np.arange(len(sizes)), cuts):
        if len(part):
            yield part


def shard_pairs(block: int, rep: np.ndarray, hi: np.ndarray, lo: np.ndarray, visits: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Near pairs (a, b, distance), a < b, of a shard that no earlier block has: among its own fingerprints, and with those that visit."""
    none = np.zeros(len(rep), np.int64)
    rows = rep, hi.view(np.uint64), lo.view(np.uint64), none, none.view(np.uint64)
    shard = Shard(block, tuple(x[~visits] for x in rows))
    yield from shard.inside()
    yield from shard.asked(tuple(x[visits] for x in rows))


def runs(batches: Iterator[pa.RecordBatch], of: Callable[[pa.RecordBatch], list[np.ndarray]]) -> Iterator[tuple[tuple[int, ...], pa.RecordBatch]]:
    """(key, rows) in order, for batches that are sorted by the numbers of a key: slices of one key each."""
    for batch in batches:
        keys = np.stack(of(batch))
        cuts = [0, *(np.flatnonzero((np.diff(keys) != 0).any(axis=0)) + 1).tolist(), keys.shape[1]]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield tuple(keys[:, a].tolist()), batch.slice(a, b - a)


def search(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Near pairs of shards that come in order, each with its own fingerprints before those that visit, which aren't held."""

    def columns(rows: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        rep, hi, lo, n, parity = (rows.column(c).to_numpy() for c in ("rep", "hi", "lo", "n", "parity"))
        return rep, hi.view(np.uint64), lo.view(np.uint64), n, parity.view(np.uint64)

    def shard_of(rows: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        first, own, held = next(rows), [], 0
        while first is not None and not first[1]:
            own.append(columns(first[2]))
            first = next(rows, None)
        if not own:
            return
        shard = Shard(own_block, tuple(map(np.concatenate, zip(*own))))
        own.clear()
        yield from shard.inside()
        while first is not None:
            own.append(columns(first[2]))
            held += len(own[-1][0])
            first = next(rows, None)
            if held >= ASKED or first is None:
                yield from shard.asked(tuple(map(np.concatenate, zip(*own))))
                held = own.clear() or 0

    each = ((key[0] >> 1, key[0] & 1, rows) for key, rows in runs(batches, lambda batch: [batch.column("place").to_numpy() >> BITS]))
    for shard, rows in groupby(each, lambda x: x[0]):
        own_block = shard % BLOCKS
        yield from shard_of(rows)


def near_pairs(entries: DataFrame, levels: int | None = None) -> DataFrame:
    """(a, b, distance), a < b: every pair of entries (rep, hi, lo) within the limit, once; with n and parity, of those that can share enough words."""
    if levels is None:
        n, levels = entries.count(), 1
        while n > LEVEL_ROWS * LEVEL_FACTOR ** (levels - 1) and levels < len(VANTAGES):
            levels += 1
    if "parity" not in entries.columns:
        entries = entries.select("rep", "hi", "lo", F.lit(0).alias("n"), F.lit(0).cast("bigint").alias("parity"))
    row = ["rep", "hi", "lo", "n", "parity"]
    block = lambda b: F.shiftrightunsigned("hi" if b < 4 else "lo", 48 - 16 * (b % 4)).bitwiseAND(0xFFFF)
    distances = F.array(*(F.array(*(F.bit_count(block(b).bitwiseXOR(v)) for v in VANTAGES[:levels])) for b in range(BLOCKS)))
    homes = entries.select(*row, F.posexplode(distances).alias("block", "d"))
    # A pair of different cells meets in the later one; the entry from the earlier one visits it.
    steps = [s for s in product(range(-RADIUS, RADIUS + 1), repeat=levels) if s >= (0,) * levels and len({x % 2 for x in s}) == 1]
    # There are as many cells as distances, whatever the number of entries.
    own = {(r.block, tuple(r.d)): r["count"] for r in homes.groupBy("block", "d").count().collect()}
    cells = F.explode(F.array(*(F.array(*(F.lit(x) for x in s)) for s in steps)))
    placed = (
        homes.select(*row, "block", "d", cells.alias("step"))
        .select(*row, "block", F.exists("step", lambda x: x != 0).alias("visits"), F.zip_with("d", "step", lambda x, y: x + y).alias("cell"))
        .where(F.forall("cell", lambda x: x.between(0, BITS)))
        .withColumn("code", F.aggregate("cell", F.lit(0), lambda code, x: code * (BITS + 1) + x))
    )
    large = [(b, c, -(-n // SHARD_ROWS)) for (b, d), n in own.items() if n > SHARD_ROWS for c in [reduce(lambda code, x: code * (BITS + 1) + x, d, 0)]]
    part = F.lit(0)
    if large:
        # A cell's own entries live in one division and visit the later ones; visitors from other cells visit all.
        parts = entries.sparkSession.createDataFrame(large, "block int, code int, parts int")
        placed = placed.join(F.broadcast(parts), ["block", "code"], "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("lives", F.when(F.col("visits"), -1).otherwise(F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")))
        placed = placed.withColumn("part", F.explode(F.sequence(F.greatest("lives", F.lit(0)), F.col("parts") - 1))).withColumn("visits", F.col("part") != F.col("lives"))
        part = F.col("part")
    shard = ((part.cast("bigint") * (BITS + 1) ** levels + F.col("code")) * BLOCKS + F.col("block")).alias("shard")
    # Sorted by their block's value too, so that those that ask at once have few values.
    value = F.get(F.array(*(block(b) for b in range(BLOCKS))), F.col("block"))
    placed = placed.select(shard, "visits", value.alias("value"), *row).select(((F.col("shard") * 2 + F.col("visits").cast("int")) * (1 << BITS) + F.col("value")).alias("place"), *row)
    names = ["a", "b", "distance"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in search(batches):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=names)

    placed = placed.repartition(F.shiftright("place", BITS + 1)).sortWithinPartitions("place")
    return map_arrow(placed, run, "a bigint, b bigint, distance int")


def word_sets(docs: DataFrame) -> DataFrame:
    """(doc_id, hi, lo, words): the fingerprint and the sorted 64-bit hashes of the distinct words, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                texts = part.column(1).to_pylist()
                raw = fingerprints_of(texts, words)
                rows = [i for i, x in enumerate(raw) if x is not None]
                halves = np.frombuffer(b"".join(raw[i] for i in rows), ">i8").astype(np.int64).reshape(-1, 2)
                own = ({*WORD.findall(texts[i].lower())} for i in rows)
                packed = [np.sort(np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, len(w))).tobytes() for w in own]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows, pa.int64())), pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(packed, pa.binary())], names=["doc_id", "hi", "lo", "words"])

    return map_arrow(docs, run, "doc_id bigint, hi bigint, lo bigint, words binary")


def alike(x: tuple[int, int, np.ndarray], y: tuple[int, int, np.ndarray]) -> bool:
    """Whether two (hi, lo, words) are within the limit and share enough words."""
    if ((x[0] ^ y[0]) & (1 << 64) - 1).bit_count() + ((x[1] ^ y[1]) & (1 << 64) - 1).bit_count() > LIMIT:
        return False
    both = np.concatenate([x[2], y[2]])
    both.sort()
    common = np.count_nonzero(both[1:] == both[:-1])
    return common >= SHARED * (len(both) - common)


def confirmed(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) whose documents share enough words, as many as it takes to link all that such pairs link."""
    pairs = checkpointed(pairs)
    roots = components(pairs)
    n = roots.count()
    parts = roots.groupBy("root").agg(F.ceil(F.count("*") / TOGETHER).alias("parts"))
    # Small components share cells, a large one has cells of its own for each two divisions.
    large = F.col("parts") > 1
    placed = checkpointed(
        roots.join(parts, "root").select(
            "node", F.when(large, F.col("root")).otherwise(0).alias("own"), F.when(large, -1).otherwise(F.pmod(F.xxhash64("root"), F.lit(n // TOGETHER + 1))).alias("cell"), "parts", F.pmod(F.xxhash64("node"), F.col("parts")).alias("part")
        )
    )
    known = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    sets = word_sets(join_ids(known, placed.select(F.col("node").alias("doc_id")), "doc_id", "left_semi", n))
    cells = [F.col("own"), F.col("cell"), F.least("x", "y").cast("bigint").alias("i"), F.greatest("x", "y").cast("bigint").alias("j")]
    none = F.lit(None)
    left = sets.join(placed, F.col("doc_id") == F.col("node")).select("*", F.col("part").alias("x"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("y"))
    left = left.select(*cells, F.lit(0).alias("pair"), F.col("doc_id").alias("a"), none.cast("bigint").alias("b"), "hi", "lo", "words")
    end = lambda c, x: placed.select(F.col("node").alias(c), "own", "cell", F.col("part").alias(x))
    right = pairs.where("a != b").join(end("a", "x"), "a").join(end("b", "y").select("b", "y"), "b")
    right = right.select(*cells, F.lit(1).alias("pair"), "a", "b", none.cast("bigint").alias("hi"), none.cast("bigint").alias("lo"), none.cast("binary").alias("words"))
    key = ["own", "cell", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The texts of a cell come before its pairs, which aren't held.
        cell, by, known = None, {}, Forest()
        for (*now, pair), rows in runs(batches, lambda batch: [batch.column(c).to_numpy() for c in (*key, "pair")]):
            if now != cell:
                cell, by, known = now, {}, Forest()
            if not pair:
                for k in range(0, rows.num_rows, 1000):
                    for doc_id, hi, lo, words in zip(*(rows.column(c).slice(k, 1000).to_pylist() for c in ("a", "hi", "lo", "words"))):
                        by.setdefault(doc_id, []).append((hi, lo, np.frombuffer(words, np.uint64)))
                continue
            keep = []
            for a, b in zip(rows.column("a").to_pylist(), rows.column("b").to_pylist()):
                # What is linked already needs no look at the words.
                keep.append(known.root(a) != known.root(b) and any(alike(x, y) for x in by[a] for y in by[b]) and known.link(a, b))
            yield rows.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = left.unionByName(right).repartition(*key).sortWithinPartitions(*key, "pair")
    return map_arrow(both, run, "a bigint, b bigint")


class Forest(dict):
    """Nodes that edges have linked so far."""

    def root(self, x: int) -> int:
        while (up := self.get(x, x)) != x:
            self[x] = x = self.get(up, up)
        return x

    def link(self, a: int, b: int) -> bool:
        """Whether they weren't linked before."""
        a, b = self.root(a), self.root(b)
        self[max(a, b)] = self.setdefault(min(a, b), min(a, b))
        return a != b


def forest(edges: DataFrame) -> DataFrame:
    """Edges (a, b) that link all that the given ones link: of each partition those that link what the ones before don't."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Forest()
        for batch in batches:
            if len(known) > FOREST:
                known.clear()
            keep = [known.link(a, b) for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return map_arrow(edges.select("a", "b"), run, "a bigint, b bigint")


def components(edges: DataFrame, thin: bool = True) -> DataFrame:
    """(node, root): the smallest node of each node's component, for edges (a, b); thin: whether a forest thins them out first."""
    edges = edges.where("a != b")
    state, before = checkpointed((forest(edges) if thin else edges).distinct()), None
    while True:
        both = state.unionByName(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Large star: neighbours beyond a node go to the smallest of its neighbourhood.
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        # Small star: a node and its smaller neighbours go to the smallest of them.
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        lowest = down.groupBy("a").agg(F.min("b").alias("m"))
        state = checkpointed(down.join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").unionByName(lowest.select("a", F.col("m").alias("b"))).distinct())
        now = state.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return state.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(state.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
        before = now


def grouped(docs: DataFrame) -> DataFrame:
    """(doc_id, root) for every row that has a fingerprint; root is the smallest doc_id of its group."""
    marks = checkpointed(fingerprints(docs))
    entries = checkpointed(marks.groupBy("hi", "lo", "n", "parity").agg(F.min("doc_id").alias("rep")))
    # Each cell's pairs are a forest already; another one in the same tasks would take a second Python worker for each.
    roots = components(confirmed(docs, near_pairs(entries)), thin=False)
    return marks.join(entries, ["hi", "lo", "n", "parity"]).join(roots, F.col("rep") == F.col("node"), "left").select("doc_id", F.coalesce("root", "rep").alias("root"))


def groups(docs: DataFrame) -> DataFrame:
    """(group_id, doc_ids, n_docs): every group of two or more rows, its doc_ids in order."""
    return grouped(docs).groupBy(F.col("root").alias("group_id")).agg(F.array_sort(F.collect_list("doc_id")).alias("doc_ids"), F.count("*").alias("n_docs")).where("n_docs > 1")


def deduplicated(docs: DataFrame) -> DataFrame:
    """One document of each group, and every document that is in none, with all columns."""
    member = checkpointed(grouped(docs))
    gone = member.where("doc_id != root").select("doc_id").distinct()
    kept = join_ids(docs, gone, "doc_id", "left_anti", member.where("doc_id != root").count()).select(docs.columns)
    again = member.groupBy("doc_id").count().where("count > 1").select("doc_id")
    if again.isEmpty():
        return kept
    # Rows that share a doc_id: one of each text stays.
    n = again.count()
    return join_ids(kept, again, "doc_id", "left_anti", n).unionByName(join_ids(kept, again, "doc_id", "left_semi", n).dropDuplicates(["doc_id", "text"])).select(docs.columns)
