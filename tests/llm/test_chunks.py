import random
from collections import defaultdict

import numpy as np
import xxhash
from cases import LONG, ROWS, documents

from tidemark.llm import chunks


def plain_cuts(data):
    """Byte by byte."""
    gear = [xxhash.xxh64_intdigest(bytes([i]), 2024) & 0xFFFF for i in range(256)]
    ends, last, h = [], 0, 0
    starts = [i == len(data) or data[i] & 0xC0 != 0x80 for i in range(len(data) + 1)]
    for i, b in enumerate(data, 1):
        h = (h * 2 + gear[b]) & 0xFFFF
        while i - last > chunks.MOST:
            stop = last + chunks.MOST
            while not starts[stop]:
                stop -= 1
            ends.append(stop)
            last = stop
        if (h >> (16 - chunks.CUT_BITS) == 0 and starts[i] and i - last >= chunks.LEAST) or i == len(data):
            ends.append(i)
            last = i
    return ends


def test_cuts_agree_with_a_byte_loop():
    draw = random.Random(2)
    for data in (b"", b"a", b"a" * 2000, "é€𝄞".encode() * 300, draw.randbytes(0), " ".join(f"wörd{draw.randrange(999)}" for _ in range(3000)).encode()):
        got = chunks.cuts(data)
        assert got == plain_cuts(data)
        assert all(b - a <= chunks.MOST for a, b in zip([0, *got], got, strict=False))
    whole = chunks.gear_hashes(np.frombuffer(LONG.encode(), np.uint8))
    tail = chunks.gear_hashes(np.frombuffer(LONG.encode()[1000:], np.uint8))
    assert (whole[1016:] == tail[16:]).all()


def plain_repeats(rows, least):
    owner, spans = defaultdict(set), set()
    cut = {}
    for key, text, *_ in rows:
        if key is not None and text is not None:
            data = text.encode()
            ends = plain_cuts(data)
            cut[key] = [(a, b, data[a:b]) for a, b in zip([0, *ends], ends, strict=False)]
            for _, _, part in cut[key]:
                owner[part].add(key)
    for key, parts in cut.items():
        run = []
        for a, b, part in [*parts, (0, 0, None)]:
            if part is not None and min(owner[part]) < key:
                run.append((a, b, min(owner[part])))
            elif run:
                if run[-1][1] - run[0][0] >= least:
                    spans.add((key, run[0][0], run[-1][1], min(r[2] for r in run)))
                run = []
    return spans


def test_against_plain_version_and_shifts(spark):
    draw = random.Random(4)
    words = lambda n: " ".join("".join(draw.choice("abcdefgh") for _ in range(draw.randint(2, 9))) for _ in range(n))
    passage = words(60)
    rows = [(300 + i, words(120), "en", "a") for i in range(20)]
    rows += [(100 + i, f"{words(i)} {passage} {words(30)}", "en", "a") for i in range(12)] + [(200, passage, None, None), (201, passage + passage, None, None)] + ROWS
    df = documents(spark, rows)
    got = {tuple(r) for r in chunks.repeats(df).collect()}
    assert got == plain_repeats(rows, chunks.MIN_BYTES)
    assert {r[0] for r in got} & set(range(300, 320)) == set()
    assert len({r[0] for r in got if 100 < r[0] <= 201}) >= 12


def test_texts_without_repeats(spark):
    df = documents(spark)
    out = chunks.without_repeats(df)
    assert out.columns == df.columns
    rows = {(r["doc_id"]): r["text"] for r in out.collect()}
    assert out.count() == len(ROWS)
    assert rows[9] == LONG and len(rows[10]) < 600 and rows[4] is None and rows[5] == "" and rows[8] == ROWS[8][1]
    assert chunks.repeats(documents(spark, [])).count() == 0 and chunks.without_repeats(documents(spark, [])).count() == 0
