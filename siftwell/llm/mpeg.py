"""MPEG audio columns: frames, tags, checksums, exact durations and seek offsets from the bytes alone.

A stream may begin with ID3v2 tags and end with an ID3v1 tag. Between them frame headers are resynchronised: from
any position the next sync word whose header is valid and whose frame is followed by a header of the same version,
layer and sampling rate, or by the end of the audio, begins a frame; right after a frame a header of that kind is
enough. Bytes before it are junk. Headers of other versions, layers or rates than the first frame's are no frames.
A first frame of layer III that holds a Xing, Info or VBRI table is metadata, not sound: its frame and byte counts,
quality and seek table (as offsets of bytes in the content) are kept, and ``table_agrees`` says whether its counts
are those of the frames found. The encoder's delay and padding after a Xing or Info table are taken off the samples;
VBRI's delay isn't, since encoders write it in unlike forms. Checksums (CRC-16, polynomial 0x8005) are verified over
the header and, by layer, the bit allocation (I), the bit allocation and scale factor selection (II) or the side
information (III); a frame too short to hold these is counted as unchecked. Durations are exact: samples, and samples
per second.

Defined results: a null content gives null counts, an empty one or one without a frame zero frames, a null rate and
a null duration. A header right after a frame, or at the start of the audio, whose frame runs past the end is a cut
last frame if no frame follows, counted as truncated and not as a frame; anywhere else it is junk. Free-format
streams have no frame lengths in their headers and count as junk. A tag whose size runs past the end takes the rest.
Contents of any length are parsed whole. Repeated rows, and rows with a null key, are parsed alike; an empty table
gives an empty result. Other columns are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

V1, V2, V25 = 3, 2, 0
BITRATES = {
    (True, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448), (True, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384), (True, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256), (False, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160), (False, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {V1: (44100, 48000, 32000), V2: (22050, 24000, 16000), V25: (11025, 12000, 8000)}


@dataclass(frozen=True)
class Header:
    version: int
    layer: int
    protected: bool
    rate: int
    length: int
    mono: bool
    bound: int  # subbands before joint coding
    kbps: int = 0

    @property
    def samples(self) -> int:
        return 384 if self.layer == 1 else 576 if self.layer == 3 and self.version != V1 else 1152

    @property
    def side(self) -> int:
        """Bytes of layer III side information."""
        return (17 if self.mono else 32) if self.version == V1 else (9 if self.mono else 17)

    @property
    def kind(self) -> tuple[int, int, int]:
        return self.version, self.layer, self.rate


def read_header(word: int) -> Header | None:
    version, layer = word >> 19 & 3, 4 - (word >> 17 & 3)
    bits, rate = word >> 12 & 15, word >> 10 & 3
    if word >> 21 != 0x7FF or version == 1 or layer == 4 or bits in (0, 15) or rate == 3 or word & 3 == 2:
        return None
    hz = RATES[version][rate]
    speed = BITRATES[version == V1, layer][bits - 1] * 1000
    pad = word >> 9 & 1
    if layer == 1:
        length = (12 * speed // hz + pad) * 4
    else:
        length = (72 if layer == 3 and version != V1 else 144) * speed // hz + pad
    mode = word >> 6 & 3
    return Header(version, layer, not word >> 16 & 1, hz, length, mode == 3, 4 * (word >> 4 & 3) + 4 if mode == 1 else 32, speed // 1000)


HEADERS: dict[int, Header | None] = {}


def header(data: bytes, at: int, end: int | None = None) -> Header | None:
    word = int.from_bytes(data[at : at + 4], "big")
    if word >> 21 != 0x7FF or at + 4 > (len(data) if end is None else end):
        return None
    key = word & 0xFFFFFEF3  # the bits for private use, copyright and original don't count
    if key not in HEADERS:
        HEADERS[key] = read_header(key)
    return HEADERS[key]


def crc_table() -> list[int]:
    out = []
    for b in range(256):
        c = b << 8
        for _ in range(8):
            c = c << 1 ^ (0x8005 if c & 0x8000 else 0)
        out.append(c & 0xFFFF)
    return out


CRC = crc_table()


def crc16(data: bytes, bits: int | None = None) -> int:
    c = 0xFFFF
    whole = len(data) if bits is None else bits // 8
    for b in data[:whole]:
        c = (c << 8 & 0xFF00) ^ CRC[c >> 8 ^ b]
    for i in range(0 if bits is None else bits % 8):
        c = (c << 1 ^ (0x8005 if (c >> 15 ^ data[whole] >> 7 - i) & 1 else 0)) & 0xFFFF
    return c


def widths(h: Header) -> list[int]:
    """Bits of the allocation of each subband of layer II."""
    if h.version != V1:
        return [4] * 4 + [3] * 7 + [2] * 19
    each = h.kbps if h.mono else h.kbps // 2
    if each < 56:
        return [4] * 2 + [3] * (10 if h.rate == 32000 else 6)
    return ([4] * 11 + [3] * 12 + [2] * 7)[: 30 if each >= 96 and h.rate != 48000 else 27]


def selection(data: bytes, at: int, h: Header) -> int:
    """Bits of the allocation and scale factor selection of a layer II frame whose allocation begins at a place."""
    head, used, chosen = int.from_bytes(data[at : at + 24].ljust(24, b"\0"), "big"), 0, 0
    for band, n in enumerate(widths(h)):
        shared = h.mono or band >= h.bound
        for _ in range(1 if shared else 2):
            used += n
            if head >> 192 - used & (1 << n) - 1:
                chosen += 1 if h.mono or not shared else 2
    return used + 2 * chosen


def checksum(data: bytes, at: int, h: Header) -> bool | None:
    """Whether the frame's checksum holds; None if the frame is too short for what it covers."""
    if h.layer == 3:
        bits = 8 * h.side
    elif h.layer == 2:
        bits = selection(data, at + 6, h)
    else:
        bits = 128 if h.mono else 8 * h.bound + 4 * (32 - h.bound)
    if 48 + bits > 8 * h.length:
        return None
    body = data[at + 6 : at + 6 + (bits + 7) // 8]
    return crc16(data[at + 2 : at + 4] + body, bits + 16) == int.from_bytes(data[at + 4 : at + 6], "big")


def synchsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


ENCODINGS = ("latin-1", "utf-16", "utf-16-be", "utf-8")


def id3v2(data: bytes, at: int, tags: dict[str, str]) -> int:
    """Reads text frames of a tag into tags; returns the position after it, or at."""
    if data[at : at + 3] != b"ID3" or len(data) < at + 10 or max(data[at + 6 : at + 10]) > 127:
        return at
    major, flags, end = data[at + 3], data[at + 5], at + 10 + synchsafe(data[at + 6 : at + 10])
    body = data[at + 10 : end]
    if flags & 0x80 and major < 4:
        body = body.replace(b"\xff\x00", b"\xff")
    k = 0
    if flags & 0x40 and len(body) >= 4 and major > 2:
        k = synchsafe(body[:4]) if major == 4 else int.from_bytes(body[:4], "big") + 4
    wide = 6 if major == 2 else 10
    while k + wide <= len(body) and body[k]:
        name = body[k : k + (3 if major == 2 else 4)].decode("latin-1")
        size = int.from_bytes(body[k + 3 : k + 6], "big") if major == 2 else synchsafe(body[k + 4 : k + 8]) if major == 4 else int.from_bytes(body[k + 4 : k + 8], "big")
        value = body[k + wide : k + wide + size]
        if name[0] == "T" and name not in ("TXX", "TXXX") and value and value[0] < 4:
            tags.setdefault(name, value[1:].decode(ENCODINGS[value[0]], "replace").rstrip("\0").replace("\0", "/"))
        k += wide + size
    return min(len(data), end + (10 if flags & 0x10 and major == 4 else 0))


def id3v1(data: bytes, tags: dict[str, str]) -> int:
    """Reads the tag at the end into what tags lacks; returns where the audio ends."""
    if len(data) < 128 or data[-128:-125] != b"TAG":
        return len(data)
    for name, a, b in (("TIT2", 3, 33), ("TPE1", 33, 63), ("TALB", 63, 93), ("TYER", 93, 97)):
        if value := data[len(data) - 128 + a : len(data) - 128 + b].split(b"\0")[0].decode("latin-1").strip():
            tags.setdefault(name, value)
    return len(data) - 128


@dataclass
class Table:
    """What a first frame says of the stream; seek holds offsets of bytes in the content."""

    kind: str
    frames: int | None = None
    size: int | None = None
    quality: int | None = None
    seek: list[int] = field(default_factory=list)
    cut: int = 0  # samples of delay and padding


@dataclass
class Stream:
    offsets: list[int] = field(default_factory=list)
    tags: dict[str, str] = field(default_factory=dict)
    samples: int = 0
    rate: int | None = None
    version: int | None = None
    layer: int | None = None
    table: Table | None = None
    table_agrees: bool | None = None
    crc_checked: int = 0
    crc_failed: int = 0
    crc_unchecked: int = 0
    junk: int = 0
    truncated: int = 0


def rate_table(data: bytes, at: int, h: Header) -> Table | None:
    """The table that a first frame holds, if it holds one."""
    k, end = at + 4 + 2 * h.protected + h.side, at + h.length
    number = lambda a, n=4: int.from_bytes(data[a : a + n], "big")
    if data[k : k + 4] in (b"Xing", b"Info") and k + 8 <= end:
        table, flags, k = Table(data[k : k + 4].decode()), number(k + 4), k + 8
        if flags & 1:
            table.frames, k = number(k), k + 4
        if flags & 2:
            table.size, k = number(k), k + 4
        if flags & 4:
            if table.size is not None and k + 100 <= end:
                table.seek = [at + table.size * x // 256 for x in data[k : k + 100]]
            k += 100
        if flags & 8:
            table.quality, k = number(k), k + 4
        if k + 24 <= end and data[k : k + 4] in (b"LAME", b"Lavf", b"Lavc"):
            gap = number(k + 21, 3)
            table.cut = (gap >> 12) + (gap & 0xFFF)
        return table
    k = at + 36
    if data[k : k + 4] == b"VBRI" and k + 26 <= end:
        table = Table("VBRI", number(k + 14), number(k + 10), number(k + 8, 2))
        n, scale, size = number(k + 18, 2), number(k + 20, 2), number(k + 22, 2)
        if 0 < size <= 4 and k + 26 + n * size <= end:
            to = end
            for i in range(n):
                table.seek.append(to)
                to += scale * number(k + 26 + i * size, size)
        return table
    return None


def parse(data: bytes) -> Stream:
    s = Stream()
    at = 0
    while (after := id3v2(data, at, s.tags)) > at:
        at = after
    end = id3v1(data, s.tags) if at < len(data) else at
    first, follows = None, at  # follows: where the last frame, or the tag before all, ends
    cut, junk, begin = -1, 0, at  # a header whose frame runs past the end, and the junk before it
    while at < end:
        h = header(data, at, end)
        fits = h is not None and (first is None or h.kind == first.kind)
        if fits and at + h.length > end:
            if at == follows:
                cut, junk = at, s.junk
            fits = False
        elif fits and at + h.length < end:
            follower = header(data, at + h.length, end)
            fits = follower is not None and follower.kind == h.kind or first is not None and at == follows
        if not fits:
            to = data.find(b"\xff", at + 1, end)
            to = end if to < 0 else to
            s.junk += to - at
            at = to
            continue
        cut = -1
        if first is None:
            first, begin = h, at
            s.version, s.layer, s.rate = h.version, h.layer, h.rate
            if h.layer == 3 and (found := rate_table(data, at, h)):
                s.table = found
                follows = at = at + h.length
                begin = at
                continue
        if h.protected:
            ok = checksum(data, at, h)
            s.crc_unchecked += ok is None
            s.crc_checked += ok is not None
            s.crc_failed += ok is False
        s.offsets.append(at)
        follows = at = at + h.length
    if cut >= 0:
        s.truncated, s.junk = 1, junk
    if first:
        s.samples = max(0, len(s.offsets) * first.samples - (s.table.cut if s.table else 0))
    if t := s.table:
        # Encoders count the bytes with the table's own frame or without it.
        sizes = (None, follows - begin, follows - begin + first.length)
        s.table_agrees = t.frames in (None, len(s.offsets)) and t.size in sizes
    return s


COLUMNS = [("n_frames", pa.int32()), ("n_samples", pa.int64()), ("sample_rate", pa.int32()), ("duration_s", pa.float64()), ("version", pa.string()), ("layer", pa.int32()), ("rate_table", pa.string()), ("table_frames", pa.int64()), ("table_bytes", pa.int64()), ("table_quality", pa.int64()), ("table_agrees", pa.bool_()), ("crc_checked", pa.int32()), ("crc_failed", pa.int32()), ("crc_unchecked", pa.int32()), ("junk_bytes", pa.int64()), ("truncated", pa.int32()), ("tags", pa.map_(pa.string(), pa.string())), ("seek_table", pa.list_(pa.int64())), ("frame_offsets", pa.list_(pa.int64()))]
SQL_TYPES = {pa.int32(): "int", pa.int64(): "bigint", pa.float64(): "double", pa.string(): "string", pa.bool_(): "boolean"}


def row(data: bytes | None) -> dict:
    if data is None:
        return {}
    s = parse(data)
    t = s.table or Table("")
    return {
        "n_frames": len(s.offsets), "n_samples": s.samples, "sample_rate": s.rate, "duration_s": s.samples / s.rate if s.rate else None, "version": {V1: "1", V2: "2", V25: "2.5"}.get(s.version), "layer": s.layer, "rate_table": t.kind or None, "table_frames": t.frames, "table_bytes": t.size, "table_quality": t.quality, "table_agrees": s.table_agrees, "seek_table": t.seek if s.table else None,
        "crc_checked": s.crc_checked, "crc_failed": s.crc_failed, "crc_unchecked": s.crc_unchecked, "junk_bytes": s.junk, "truncated": s.truncated, "tags": [*s.tags.items()], "frame_offsets": s.offsets,
    }


def scan(clips: DataFrame, key: str = "doc_id", content: str = "content") -> DataFrame:
    """A row for each clip (key, content): what its frames and tags say."""
    schema = pa.schema([(key, pa.int64()), *COLUMNS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                yield pa.RecordBatch.from_pylist([{key: i, **row(c.as_py())} for i, c in zip(part.column(0).to_pylist(), part.column(1))], schema=schema)

    types = ", ".join(f"{n} {SQL_TYPES.get(t) or ('map<string,string>' if n == 'tags' else 'array<bigint>')}" for n, t in COLUMNS)
    return map_arrow(clips.select(F.col(key).cast("bigint"), content), run, f"{key} bigint, {types}")
