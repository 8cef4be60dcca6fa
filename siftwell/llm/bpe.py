"""Byte-pair encoding and decoding by prefix-sharing trie traversal.

A text is cut into pieces by the tokenizer's pattern. The distinct pieces of a stretch of text form a trie, which
is walked depth first: in sorted order a piece shares with the one before exactly their common prefix in the
trie, and the stack along the current path holds the state of each prefix. The state is the last token of the
prefix's encoding, and the encoding itself. It follows from shorter prefixes alone: of the tokens that end the
prefix exactly one, t, may stand after the last token of the prefix without t, which is the case if no merge
across their border comes before the merges that made them. So shared prefixes are encoded once.

Pieces, tries and encodings stay within a partition: nothing is shuffled, and the vocabulary (of a fixed size) is
all that is broadcast.

Defined results: a null text gives null ids and a null count, an empty one no ids. Texts of any length are encoded
whole. Repeated rows, and rows with a null doc_id, are encoded alike. Decoding is exact for whole texts; ids that aren't
in the vocabulary raise an error, and ids whose bytes aren't UTF-8 decode with U+FFFD. An empty table gives an empty
result. Columns named like the result's (token_ids, n_tokens and, if checked, round_trip) are replaced; all others stay.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
#: Characters of text whose pieces are encoded together, and held at once: some 15 bytes for each character.
STRETCH = 1_000_000
#: Encodings of pieces, and answers about pairs of tokens, that are kept; only speed depends on them.
PIECES, ALLOWED = 400_000, 400_000
#: Bytes of a path up to which whole encodings are kept; beyond, last tokens alone, which lead back to there.
DEEP = 256


class Encoder:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {i: b for b, i in ranks.items()}

    @classmethod
    def load(cls, path: str = VOCABULARY) -> Encoder:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})

    def __getstate__(self) -> dict:
        return {k: self.__dict__[k] for k in ("ranks", "tokens")}

    @cached_property
    def splits(self) -> dict[int, tuple[int, int]]:
        """The two tokens that each longer token was merged from."""
        return {i: tuple(self.merged(b, i)) for b, i in self.ranks.items() if len(b) > 1}

    @cached_property
    def pairs(self) -> dict[tuple[int, int], int]:
        return {p: i for i, p in self.splits.items()}

    @cached_property
    def reach(self) -> dict[bytes, int]:
        """Length of the longest token that ends with given four bytes."""
        out: dict[bytes, int] = {}
        for b in self.ranks:
            if len(b) > 3:
                out[b[-4:]] = max(len(b), out.get(b[-4:], 0))
        return out

    @cached_property
    def packed(self) -> dict[int, bytes]:
        return {i: np.int32(i).tobytes() for i in self.tokens}

    @cached_property
    def allowed(self) -> dict[int, bool]:
        """What may_follow said, by the first token times 2^32 plus the second."""
        return {}

    def merged(self, piece: bytes, below: int = 1 << 31) -> list[int]:
        """Encoding by repeated merges of the lowest rank, only ranks under below."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            rank, i = min((self.ranks.get(parts[i] + parts[i + 1], below), i) for i in range(len(parts) - 1))
            if rank >= below:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def may_follow(self, a: int, b: int) -> bool:
        """Whether a, b stay two tokens: no merge across the border precedes those that made a's end and b's start."""
        limit = 1 << 31
        while True:
            if self.pairs.get((a, b), limit) < limit:
                return False
            # Undo the later of the two merges that touch the border; what it made can't have merged before it.
            x, y = self.splits.get(a), self.splits.get(b)
            if x and (not y or a > b):
                limit, a = a, x[1]
            elif y:
                limit, b = b + 1, y[0]
            else:
                return True

    def encode_words(self, words: Iterable[bytes]) -> dict[bytes, bytes]:
        """Encodings, as little-endian 32-bit numbers, of distinct pieces."""
        rank, packed, allowed, reach = self.ranks.get, self.packed, self.allowed, self.reach.get
        out, before = {}, b""
        last: list[int] = [-1]  # last token of each prefix of the current path
        codes: list[bytes] = [b""]
        for word in sorted(words):
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del last[shared + 1 :], codes[shared + 1 :]
            for i in range(shared + 1, len(word) + 1):
                k = i - reach(word[i - 4 : i], 3) if i > 3 else 0
                if k < 0:
                    k = 0
                while True:
                    t = rank(word[k:i])
                    if t is not None:
                        if not k:
                            break
                        pair = last[k] << 32 | t
                        ok = allowed.get(pair)
                        if ok is None:
                            ok = allowed[pair] = self.may_follow(last[k], t)
                        if ok:
                            break
                    k += 1
                last.append(t)
                if i <= DEEP:
                    codes.append(codes[k] + packed[t])
            tail, i = [], len(word)
            while i > DEEP:
                tail.append(packed[last[i]])
                i -= len(self.tokens[last[i]])
            out[word] = codes[i] + b"".join(reversed(tail))
            before = word
        if len(allowed) > ALLOWED:
            allowed.clear()
        return out

    def encode(self, texts: list[str | None], cache: dict[str, bytes] | None = None) -> list[bytes | None]:
        """Ids of each text, packed."""
        cache = {} if cache is None else cache
        find = regex.compile(PATTERN).findall
        out: list[bytes | None] = []
        k = 0
        while k < len(texts):
            stretch, size = [], 0
            while k < len(texts) and (not stretch or size < STRETCH):
                stretch.append(None if texts[k] is None else find(texts[k]))
                size += len(texts[k] or "")
                k += 1
            if len(cache) > PIECES:
                cache.clear()
            new = {w.encode(): w for w in set().union(*filter(None, stretch)) if w not in cache}
            cache.update((new[b], code) for b, code in self.encode_words(new).items())
            out += [None if s is None else b"".join(map(cache.__getitem__, s)) for s in stretch]
        return out

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.tokens.__getitem__, ids)).decode("utf-8", "replace")


def ids_array(codes: list[bytes | None]) -> pa.ListArray:
    sizes = np.fromiter((len(c) // 4 if c is not None else 0 for c in codes), np.int64, len(codes))
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    values = pa.array(np.frombuffer(b"".join(c for c in codes if c is not None), np.int32))
    return pa.ListArray.from_arrays(pa.array(offsets), values, mask=pa.array([c is None for c in codes]))


def encode(docs: DataFrame, path: str = VOCABULARY, check: bool = False, drop_text: bool = True) -> DataFrame:
    """The documents with token_ids and n_tokens instead of the text; with check also whether the ids decode to it."""
    own = ("token_ids", "n_tokens", *(["round_trip"] if check else []))
    kept = [c for c in docs.columns if c not in own and not (drop_text and c == "text")]
    shared = docs.sparkSession.sparkContext.broadcast(Encoder.load(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, cache = shared.value, {}
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                part = batch.slice(k, 2000)
                texts = part.column(0).to_pylist()
                codes = encoder.encode(texts, cache)
                columns = [*part.columns[1:], ids_array(codes), pa.array([None if c is None else len(c) // 4 for c in codes], pa.int32())]
                if check:
                    columns.append(pa.array([None if c is None else encoder.decode(np.frombuffer(c, np.int32).tolist()) == t for c, t in zip(codes, texts)], pa.bool_()))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    source = docs.select(F.col("text").alias("text" + "_" * max(map(len, docs.columns))), *kept)
    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[1:]] + ["token_ids array<int>", "n_tokens int", *(["round_trip boolean"] if check else [])]
    names = [*source.columns[1:], "token_ids", "n_tokens", *(["round_trip"] if check else [])]
    return map_arrow(source, run, ", ".join(schema))


def decode(encoded: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """The rows with a text column made from token_ids."""
    shared = encoded.sparkSession.sparkContext.broadcast(Encoder.load(path))
    kept = [c for c in encoded.columns if c != "text"]
    at = kept.index("token_ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if x is None else shared.value.decode(x) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*kept, "text"])

    source = encoded.select(*kept)
    return map_arrow(source, run, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields] + ["text string"]))
