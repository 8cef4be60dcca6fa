"""MPEG audio clips made from documents, for tables that have no audio of their own.

A document's UTF-8 bytes become the main data of frames. Version, layer, bit rate, channels, checksums, tags and
tables, and faults (junk between frames, a wrong checksum, a cut last frame) follow from the document's number. A
null text gives a null content, an empty one tags alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow
from .mpeg import BITRATES, V1, V2, V25, Header, crc16, read_header, selection


def synchsafe(n: int) -> bytes:
    return bytes(n >> s & 127 for s in (21, 14, 7, 0))


def words(version: int, layer: int, rate: int, protected: bool, mono: bool) -> list[int]:
    """Header words of each bit rate."""
    return [0xFFE00000 | version << 19 | 4 - layer << 17 | (not protected) << 16 | bits << 12 | rate << 10 | (3 if mono else 0) << 6 for bits in range(1, len(BITRATES[version == V1, layer]) + 1)]


def fixed(h: Header) -> bytes:
    """What lies before the payload and under the checksum, without a sync word: side information (III) and allocation (I) of zeros, allocation and selection (II) of a pattern."""
    return bytes(h.side) if h.layer == 3 else bytes(16 if h.mono else 32) if h.layer == 1 else b"\x21\x43\x05" * 13


def frame(word: int, h: Header, payload: bytes, wrong: bool = False) -> bytes:
    """A frame around its payload."""
    before = fixed(h)
    body = (before + payload).ljust(h.length - 4 - 2 * h.protected, b"\0")
    check = b""
    if h.protected:
        bits = selection(body, 0, h) if h.layer == 2 else 8 * len(before)
        check = (crc16(word.to_bytes(4, "big")[2:] + body[: (bits + 7) // 8], 16 + bits) ^ wrong).to_bytes(2, "big")
    return word.to_bytes(4, "big") + check + body


def clip(number: int, text: str | None) -> tuple[bytes | None, list[int]]:
    """The clip and where its frames begin."""
    if text is None:
        return None, []
    number = abs(number)
    data = text.encode()
    version, layer = (V1, V1, V2, V25)[number % 4], {3: 1, 6: 2}.get(number % 7, 3)
    rate, mono, protected, varying = number // 4 % 3, number // 3 % 2 == 0, number % 2 == 0, number % 5 == 2
    choices = [(w, h) for w in words(version, layer, rate, protected, mono) if (h := read_header(w)) and h.length > 160]
    out, offsets = bytearray(), []
    if number % 3 == 0:
        title = b"\x03" + text[:40].encode()
        tag = b"TIT2" + synchsafe(len(title)) + b"\0\0" + title
        out += b"ID3\x04\0\0" + synchsafe(len(tag) + 16) + tag + bytes(16)
    frames, k, i = bytearray(), 0, 0
    starts = []
    while k < len(data):
        word, h = choices[(i * 3 if varying else number // 8) % min(len(choices), 8)]
        if number % 11 == 5 and i and i % 6 == 0:
            frames += b"\xff\xfa junk \xff" + bytes(13)
        starts.append(len(frames))
        room = h.length - 4 - 2 * h.protected - len(fixed(h))
        frames += frame(word, h, data[k : k + room], number % 13 == 6 and i == 1)
        k += room
        i += 1
    if varying and layer == 3 and data:
        word, h = choices[min(len(choices), 8) - 1]
        if number % 10 == 7:
            # A seek entry for each four frames, their bytes in units of two.
            sizes = [b - a for a, b in zip(starts, [*starts[1:], len(frames)])]
            entries = [sum(sizes[j : j + 4]) // 2 for j in range(0, i, 4)][:20]
            about = (1, 0, 75), (len(frames), i), (len(entries), 2, 2, 4)
            table = bytes(32 - h.side) + b"VBRI" + b"".join(x.to_bytes(n, "big") for xs, n in zip(about, (2, 4, 2)) for x in xs) + b"".join(e.to_bytes(2, "big") for e in entries)
        else:
            size = h.length + len(frames)
            seek = bytes(min(254, 256 * (h.length + starts[i * j // 100]) // size) for j in range(100)) if h.length > 200 else b""
            table = b"Xing" + (7 if seek else 3).to_bytes(4, "big") + i.to_bytes(4, "big") + size.to_bytes(4, "big") + seek + b"LAME3.100" + bytes(12) + (576 << 12 | 100).to_bytes(3, "big")
        out += frame(word, h, table)
    offsets = [len(out) + s for s in starts]
    out += frames
    if number % 17 == 4 and len(offsets) > 1:
        del out[-20:]
        offsets.pop()
    if number % 6 == 1:
        out += b"TAG" + b"clip %d" % number + bytes(30 - len(b"clip %d" % number)) + bytes(95)
    return bytes(out), offsets


def clips(docs: DataFrame) -> DataFrame:
    """(doc_id, content) for every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([clip(n or 0, t.as_py())[0] for n, t in zip(part.column(0).to_pylist(), part.column(1))], pa.binary())], names=["doc_id", "content"])

    return map_arrow(docs.select(F.col("doc_id").cast("bigint"), "text"), run, "doc_id bigint, content binary")
