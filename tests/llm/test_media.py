import hashlib
import random
import struct
import zlib

import numpy as np
import pytest
from cases import LONG, documents

from tidemark.llm import media


def plain_lzw(stream, size):
    """Bit by bit, as the format is defined."""
    bits = "".join(f"{b:08b}"[::-1] for b in stream)
    clear, out, at, width, table, previous = 1 << size, b"", 0, size + 1, None, None
    while True:
        code = int(bits[at : at + width][::-1], 2)
        at += width
        if code == clear:
            table, width, previous = [bytes([i]) for i in range(clear)] + [b"", b""], size + 1, None
            continue
        if code == clear + 1:
            return out
        entry = table[code] if code < len(table) else previous + previous[:1]
        if previous is not None and len(table) < 4096:
            table.append(previous + entry[:1])
            if len(table) == 1 << width and width < 12:
                width += 1
        previous, out = entry, out + entry


@pytest.mark.parametrize("data", [b"", b"a", b"aaaaaaa", bytes(range(256)) * 40, random.Random(1).randbytes(30_000), b"to be or not " * 4000])
def test_lzw_round_trip(data):
    stream = media.lzw_pack(*media.lzw_codes(data))
    assert media.lzw_decode(stream, 8, 10**9) == data
    assert plain_lzw(stream, 8) == data


def test_text_round_trip():
    for text in (None, "", "é" * 33, "x" * 64, LONG, "a\0b"):
        payload = media.padded(text)
        assert len(payload) % 64 == 0 and payload.rstrip(b"\0") == (text or "").encode().rstrip(b"\0") and payload
        got = list(media.frames(media.encode(payload)))
        assert b"".join(f["pixels"] for f in got) == payload
        assert [f["delay_ms"] for f in got] == [media.DELAY_MS] * len(got)


def image(width, height, images, palette=bytes(range(12)), flags=0xF1):
    """A GIF of four colours from (pixels, left, top, w, h, disposal, transparent, interlace, local palette) each."""
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, flags, 0, 0), palette]
    for pixels, left, top, w, h, disposal, clear, interlace, local in images:
        out.append(struct.pack("<BBBBHBB", 0x21, 0xF9, 4, disposal << 2 | (clear is not None), 7, clear or 0, 0))
        out.append(struct.pack("<BHHHHB", 0x2C, left, top, w, h, (0x40 if interlace else 0) | (0x81 if local else 0)))
        out.append((local or b"") + b"\2")
        out.extend(media._blocks(media.lzw_pack(*media.lzw_codes(bytes(pixels), 2), 2)))
    return b"".join([*out, b"\x3b"])


def test_disposal_transparency_palettes_and_interlace():
    local = bytes(range(100, 112))
    data = image(
        2,
        2,
        [
            ([0, 1, 2, 3], 0, 0, 2, 2, 1, None, False, None),
            ([1], 1, 1, 1, 1, 3, None, False, None),
            ([2, 3], 0, 0, 2, 1, 2, 2, False, local),
            ([0], 1, 1, 1, 1, 0, None, False, None),
        ],
    )
    colour = lambda i, base=0: [base + 3 * i, base + 3 * i + 1, base + 3 * i + 2, 255]
    want = [
        [colour(0), colour(1), colour(2), colour(3)],
        [colour(0), colour(1), colour(2), colour(1)],
        [colour(0), colour(3, 100), colour(2), colour(3)],
        [[0] * 4, [0] * 4, colour(2), colour(0)],
    ]
    got = [(f["picture"].reshape(-1, 4).tolist(), f["delay_ms"]) for f in media.frames(data)]
    assert got == [(w, 70) for w in want]
    rows = [[i % 4] * 1 for i in range(11)]
    stored = [rows[i][0] for i in media._rows_of_passes(11)]
    (frame,) = media.frames(image(1, 11, [(stored, 0, 0, 1, 11, 0, None, True, None)]))
    assert list(frame["pixels"]) == [r[0] for r in rows]


def test_columns_and_broken_files(spark):
    df = media.with_media(documents(spark))
    rows = media.with_frames(df).collect()
    for r in rows:
        payload = media.padded(r["text"])
        assert sum(f["height"] for f in r["frames"]) * 64 == len(payload)
        colours = np.frombuffer(media.palette(), np.uint8).reshape(-1, 3)
        first = r["frames"][0]
        want = colours[np.frombuffer(payload[: 64 * media.ROWS], np.uint8)]
        assert np.array_equal(np.frombuffer(first["rgba"], np.uint8).reshape(-1, 4)[: len(want), :3], want)
        assert sum(first["histogram"]) == len(want)
    good = media.encode(media.padded("hello"))
    bad = spark.createDataFrame([(1, good), (2, good[:-30]), (3, b"no"), (4, None), (5, b""), (1, good)], "id long, media binary")
    assert sorted((r["id"], r["frames"] is None) for r in media.with_frames(bad).collect()) == [(1, False), (1, False), (2, True), (3, True), (4, True), (5, True)]
    assert media.with_media(documents(spark, [])).count() == 0


def test_query(spark):
    from tidemark.llm.queries import QUERIES

    got = QUERIES["op8_gif"](spark, "/root/testdata/sf0.001").collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert sorted(texts) == sorted(r["doc_id"] for r in got)
    for r in got:
        payload = media.padded(texts[r["doc_id"]])
        gif = media.encode(payload)
        assert (r["n_bytes"], r["payload_bytes"]) == (len((texts[r["doc_id"]] or "").encode()), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-64:])
        assert (r["media_bytes"], r["media_sha256"]) == (len(gif), hashlib.sha256(gif).hexdigest())
        assert sum(map(int, r["feature"].split(":")[1].split(","))) == len(payload)


def test_streams_that_end_early_or_have_no_sound_code_size():
    data = image(2, 2, [([0, 1, 2, 3], 0, 0, 2, 2, 1, None, False, None)])
    assert len(list(media.frames(data))) == 1
    short = image(2, 2, [([0, 1, 2], 0, 0, 2, 2, 1, None, False, None)])
    with pytest.raises(ValueError, match="ends after 3"):
        list(media.frames(short))
    at = data.index(b"\x2c") + 10
    for size in (0, 1, 9, 12):
        with pytest.raises(ValueError, match="code size"):
            list(media.frames(data[:at] + bytes([size]) + data[at + 1 :]))
