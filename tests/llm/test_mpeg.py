from __future__ import annotations

import random

from siftwell.llm import mpeg, mpeg_clips

from .conftest import prose


SPEEDS = {  # kbit/s by version 1 or not, and layer
    "11": "32 64 96 128 160 192 224 256 288 320 352 384 416 448", "12": "32 48 56 64 80 96 112 128 160 192 224 256 320 384", "13": "32 40 48 56 64 80 96 112 128 160 192 224 256 320",
    "21": "32 48 56 64 80 96 112 128 144 160 176 192 224 256", "22": "8 16 24 32 40 48 56 64 80 96 112 128 144 160", "23": "8 16 24 32 40 48 56 64 80 96 112 128 144 160",
}


def slow_header(data, at, end):
    """(kind, bytes) of a header by its bits as text, or None."""
    if at + 4 > end:
        return None
    bits = "".join(f"{x:08b}" for x in data[at : at + 4])
    version, layer = {"11": "1", "10": "2", "00": "2.5"}.get(bits[11:13]), {"11": 1, "10": 2, "01": 3}.get(bits[13:15])
    if bits[:11] != "1" * 11 or not version or not layer or bits[16:20] in ("0000", "1111") or bits[20:22] == "11" or bits[30:] == "10":
        return None
    hz = {"00": 44100, "01": 48000, "10": 32000}[bits[20:22]] // {"1": 1, "2": 2, "2.5": 4}[version]
    speed = 1000 * int(SPEEDS[("1" if version == "1" else "2") + str(layer)].split()[int(bits[16:20], 2) - 1])
    samples = {1: 384, 2: 1152, 3: 1152 if version == "1" else 576}[layer]
    pad = int(bits[22])
    return (version, layer, hz), (12 * speed // hz + pad) * 4 if layer == 1 else samples // 8 * speed // hz + pad


def slow_frames(data):
    """Offsets of all frames, junk and cut frames by the stated rules, one byte at a time. No tags, no tables."""
    out, kind, at, follows, junk, cut = [], None, 0, 0, [], None
    while at < len(data):
        h = slow_header(data, at, len(data))
        good = h is not None and kind in (None, h[0])
        if good and at + h[1] > len(data):
            cut = at if at == follows else cut
            good = False
        elif good and at + h[1] < len(data):
            then = slow_header(data, at + h[1], len(data))
            good = then is not None and then[0] == h[0] or kind is not None and at == follows
        if good:
            out.append(at)
            kind, cut = h[0], None
            at = follows = at + h[1]
        else:
            junk.append(at)
            at += 1
    return out, sum(cut is None or x < cut for x in junk), int(cut is not None)


def test_made_clips_are_read_back():
    layers, tables = set(), set()
    for n in range(300):
        data, offsets = mpeg_clips.clip(n, prose(n, 30 + n * 3))
        s = mpeg.parse(data)
        assert s.offsets == offsets, n
        assert s.crc_failed == (n % 13 == 6 and n % 2 == 0 and len(offsets) > 1) and s.crc_unchecked == 0 and s.crc_checked == (len(offsets) if n % 2 == 0 else 0)
        tag = 128 if n % 6 == 1 else 0
        ends = offsets[-1] + mpeg.header(data, offsets[-1]).length if offsets else len(data) - tag
        assert s.truncated == (n % 17 == 4 and len(data) - tag > ends and slow_header(data, ends, len(data)) is not None), n
        if s.rate:
            assert s.rate == mpeg.header(data, offsets[0]).rate
        layers.add((s.version, s.layer))
        if s.table:
            tables.add(s.table.kind)
            whole = n % 17 != 4 and n % 11 != 5
            assert s.table.frames == len(offsets) + (n % 17 == 4 and s.truncated) and (s.table_agrees or not whole), n
            assert all(x <= len(data) for x in s.table.seek) and s.table.seek == sorted(s.table.seek)
            if s.table.kind == "VBRI" and n % 11 != 5:
                assert all(abs(x - y) <= k + 1 for k, (x, y) in enumerate(zip(s.table.seek, offsets[::4])))
    assert {layer for _, layer in layers} == {1, 2, 3} and len(layers) == 9 and tables == {"Xing", "VBRI"}


def test_frames_equal_a_slow_parser():
    """Junk with false headers, some of frames that run past the end, between, before and after frames; and cuts."""
    r = random.Random(7)
    cuts = 0
    for n in range(250):
        version, layer = r.choice([(mpeg.V1, 1), (mpeg.V1, 2), (mpeg.V1, 3), (mpeg.V2, 3), (mpeg.V25, 2)])
        choices = [(w, h) for w in mpeg_clips.words(version, layer, r.randrange(3), r.random() < 0.5, r.random() < 0.5) if (h := mpeg.read_header(w)) and h.length > 110]
        data = bytearray()
        for _ in range(r.randrange(1, 9)):
            if r.random() < 0.4:
                for _ in range(r.randrange(1, 4)):
                    data += r.choice([r.randbytes(r.randrange(9)), r.choice(choices)[0].to_bytes(4, "big"), b"\xff\xfb\x90\x64", b"\xff\xff\xff", b"junk"])
            w, h = r.choice(choices)
            data += mpeg_clips.frame(w, h, b"text " * r.randrange(20))[: h.length]
        if r.random() < 0.4:
            del data[-r.randrange(1, min(len(data), 90)) :]
        if data[:3] == b"ID3" or data[-128:-125] == b"TAG":
            continue
        s = mpeg.parse(bytes(data))
        assert (s.offsets, s.junk, s.truncated) == slow_frames(bytes(data)), n
        cuts += s.truncated
    assert cuts > 20


def test_false_header_past_the_end_hides_no_frame():
    w, h = next((w, h) for w in mpeg_clips.words(mpeg.V1, 3, 0, False, False) if (h := mpeg.read_header(w)) and h.kbps == 128)
    big = next(w for w in mpeg_clips.words(mpeg.V1, 3, 0, False, False) if mpeg.read_header(w).kbps == 320)
    frames = [mpeg_clips.frame(w, h, b"x") for _ in range(10)]
    s = mpeg.parse(b"".join([*frames[:8], b"jk", big.to_bytes(4, "big"), b"junk", *frames[8:]]))
    assert (len(s.offsets), s.junk, s.truncated) == (10, 10, 0)
    s = mpeg.parse(b"".join([*frames[:9], frames[9][:40]]))
    assert (len(s.offsets), s.junk, s.truncated) == (9, 0, 1)


def slow_crc(bits):
    c = 0xFFFF
    for b in bits:
        top = c >> 15
        c = c << 1 & 0xFFFF
        if top ^ int(b):
            c ^= 0x8005
    return c


def test_layer_two_checksums():
    """Allocation and scale factor selection read bit by bit from text, by the tables of the standard."""
    r = random.Random(9)
    seen = set()
    for n in range(400):
        version, rate, mono = r.choice([mpeg.V1, mpeg.V1, mpeg.V2]), r.randrange(3), r.random() < 0.3
        word = r.choice(mpeg_clips.words(version, 2, rate, True, mono))
        if not mono and r.random() < 0.6:
            word |= 1 << 6 | r.randrange(4) << 4
        h = mpeg.read_header(word)
        if h.length < 60:
            continue
        body = bytearray(r.randbytes(h.length - 6))
        text = "".join(f"{x:08b}" for x in body)
        each = h.kbps / (1 if mono else 2)
        if version != mpeg.V1:
            table = "4 " * 4 + "3 " * 7 + "2 " * 19
        elif each <= 48:
            table = "4 4 " + "3 " * (10 if h.rate == 32000 else 6)
        elif each <= 80 or h.rate == 48000:
            table = "4 " * 11 + "3 " * 12 + "2 " * 4
        else:
            table = "4 " * 11 + "3 " * 12 + "2 " * 7
        at = scale = 0
        bound = 0 if mono else 4 * (word >> 4 & 3) + 4 if word >> 6 & 3 == 1 else 99
        for band, wide in enumerate(map(int, table.split())):
            for _ in range(2 if band < bound else 1):
                used = int(text[at : at + wide], 2) > 0
                scale += used * (1 if mono or band < bound else 2)
                at += wide
        at += 2 * scale
        if at > len(text):
            continue
        right = slow_crc(f"{word & 0xFFFF:016b}" + text[:at])
        data = word.to_bytes(4, "big") + right.to_bytes(2, "big") + bytes(body)
        assert mpeg.checksum(data, 0, h) is True
        k = 6 + r.randrange(at // 8)
        wrong = bytearray(data)
        wrong[k] ^= 0x40
        assert mpeg.checksum(bytes(wrong), 0, h) is not True or mpeg.selection(bytes(wrong), 6, h) != at
        seen.add((table, mono, bound))
    assert len(seen) > 15


def test_known_header():
    h = mpeg.read_header(0xFFFB9064)
    assert (h.version, h.layer, h.protected, h.rate, h.length, h.samples, h.side) == (mpeg.V1, 3, False, 44100, 417, 1152, 32)
    assert mpeg.read_header(0xFFFBF064) is None and mpeg.read_header(0xFFE09064) is None


def test_crc_bit_by_bit():
    def slow(data, bits):
        c = 0xFFFF
        for i in range(bits):
            bit = data[i // 8] >> 7 - i % 8 & 1
            top = c >> 15
            c = c << 1 & 0xFFFF
            if top ^ bit:
                c ^= 0x8005
        return c

    r = random.Random(2)
    for n in (1, 2, 19, 34):
        data = r.randbytes(n)
        assert mpeg.crc16(data) == slow(data, 8 * n)
        assert mpeg.crc16(data, 8 * n - 3) == slow(data, 8 * n - 3)


def test_exact_duration_with_table():
    data, offsets = mpeg_clips.clip(12, prose(1, 2000))
    s = mpeg.parse(data)
    assert s.table.kind == "Xing" and s.table.frames == len(offsets) and s.table_agrees
    assert len(s.table.seek) == 100 and all(any(abs(x - o) <= 1 + s.table.size // 256 for o in offsets) for x in s.table.seek)
    assert s.samples == len(offsets) * mpeg.header(data, offsets[0]).samples - 676


def test_tags_and_junk():
    data, offsets = mpeg_clips.clip(19, "short text " * 200)
    assert mpeg.parse(data).tags == {"TIT2": "clip 19"}
    shifted = b"\xff\xfb\x90\x64 no frame" + data
    s = mpeg.parse(shifted)
    assert [o - 13 for o in s.offsets] == offsets and s.junk == 13


def test_random_bytes_never_crash():
    r = random.Random(5)
    for n in range(300):
        s = mpeg.parse(bytes(r.choice(b"\xff\xfb\x90\x64\x00ID3TAG") for _ in range(r.randrange(400))))
        assert s.samples >= 0 and s.offsets == sorted(s.offsets)


def test_columns_of_odd_clips(spark):
    clip = mpeg_clips.clip(1, "some text " * 300)[0]
    rows = [(1, None, 0), (2, b"", 0), (3, b"\xff" * 5000, 0), (4, clip, 0), (4, clip, 0), (None, clip, 0)]
    d = spark.createDataFrame([(i, None if c is None else bytearray(c), z) for i, c, z in rows], "doc_id bigint, content binary, n_frames int")
    got = mpeg.scan(d).collect()
    assert len(got) == 6
    by = {r.doc_id: r for r in got}
    assert by[1].n_frames is None and (by[2].n_frames, by[2].duration_s, by[2].sample_rate) == (0, None, None)
    assert by[3].n_frames == 0 and by[3].junk_bytes == 5000
    assert by[4].n_frames == len(by[4].frame_offsets) > 0 and by[4] in got[3:5] and by[4].duration_s == by[4].n_samples / by[4].sample_rate
    assert mpeg.scan(d.where("false")).count() == 0


def test_documents_as_clips(tables):
    made, read = mpeg_clips.clips(tables("documents")), mpeg.scan(mpeg_clips.clips(tables("documents")))
    assert made.count() == read.count() == tables("documents").count()
    want = {r.doc_id: mpeg_clips.clip(r.doc_id, r.text)[1] for r in tables("documents").collect()}
    assert {r.doc_id: r.frame_offsets for r in read.collect()} == want


def test_long_contents(spark):
    w, h = next((w, h) for w in mpeg_clips.words(mpeg.V1, 3, 0, True, False) if (h := mpeg.read_header(w)) and h.kbps == 128)
    one = mpeg_clips.frame(w, h, b"x")
    d = spark.createDataFrame([(1, bytearray(one * 20_000), 1, 2)], "doc_id bigint, content binary, tags int, layer int")
    got = mpeg.scan(d).first()
    assert got.n_frames == 20_000 and got.crc_checked == 20_000 and got.frame_offsets[-1] == 19_999 * h.length and got.layer == 3
    assert mpeg.parse(b"\xff\xfb" * 500_000).offsets == []
