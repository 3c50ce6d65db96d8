import random
from collections import defaultdict

import pytest
import xxhash
from cases import LONG, ROWS, documents

from tidemark.llm import simhash


def plain_fingerprint(text, k=3):
    words = [w for w in "".join(c.lower() if c.isascii() else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words)] if len(words) < k else [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_roots(prints, distance):
    """Smallest id per component, by comparing all pairs."""
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= distance:
                parent[find(i)] = find(j)
    least = defaultdict(list)
    for i, (key, _) in enumerate(prints):
        if key is not None:
            least[find(i)].append(key)
    return [min(least[find(i)], default=None) for i in range(len(prints))]


def test_fingerprints_and_components(spark):
    got = simhash.groups(documents(spark), shingle=3, distance=2).collect()
    prints = [(r[0], plain_fingerprint(r[1])) for r in ROWS]
    want = sorted(((i, f"{f:016x}", c) for (i, f), c in zip(prints, plain_roots(prints, 2), strict=True)), key=str)
    assert sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got), key=str) == want
    assert plain_fingerprint(LONG) != 0


def test_blocks_of_words_do_not_matter(monkeypatch):
    whole = simhash.fingerprint(LONG, 3, 2)
    monkeypatch.setattr(simhash, "BLOCK", 1000)
    monkeypatch.setattr(simhash, "word_blocks", lambda data: (w for w in __import__("tidemark.llm.text", fromlist=["x"]).word_blocks(data, 777)))
    assert simhash.fingerprint(LONG, 3, 2) == whole


def scattered(seed, n, centres=3, spread=5):
    """Fingerprints in tight balls, with many links, and some anywhere."""
    draw = random.Random(seed)
    middle = [draw.getrandbits(64) for _ in range(centres)]
    prints = set()
    while len(prints) < n:
        x = draw.choice(middle)
        for _ in range(draw.randint(0, spread)):
            x ^= 1 << draw.randrange(24)
        prints.add(x)
    return [(i, x) for i, x in enumerate(sorted(prints | {draw.getrandbits(64) for _ in range(50)}))]


@pytest.mark.parametrize("bucket", [64, 5, 1])
@pytest.mark.parametrize("distance", [2, 3])
def test_links_are_complete_with_and_without_large_buckets(spark, bucket, distance):
    from tidemark.llm.graph import components

    prints = scattered(distance, 250)
    signed = [(x - (1 << 64) if x >> 63 else x) for _, x in prints]
    df = spark.createDataFrame([(x, [x]) for x in signed], "node long, bits array<long>")
    found = simhash.links(df, simhash.pigeonhole(distance, 5), distance, 1, bucket)
    for a, b in found.collect():
        assert a != b and ((a ^ b) & (2**64 - 1)).bit_count() <= distance
    root = {r["node"]: r["root"] for r in components(found, "a", "b").collect()}
    want = plain_roots([(s, x) for s, (_, x) in zip(signed, prints, strict=True)], distance)
    assert [root.get(s, s) for s in signed] == want


@pytest.mark.parametrize("steps", [(1,), (2, 5), ()])
def test_wide_components_are_those_of_all_pairs_that_meet(spark, steps):
    """Several lanes: every pair that shares a key and is near enough ends up connected, and nothing else."""
    draw = random.Random(len(steps))
    masks = simhash.spread(2, 8, 10)
    middle = [[draw.getrandbits(64) for _ in range(2)] for _ in range(6)]
    prints = {tuple(x) for x in middle}
    while len(prints) < 400:
        x = list(draw.choice(middle)) if draw.random() < 0.8 else [draw.getrandbits(64) for _ in range(2)]
        for _ in range(draw.randint(0, 14)):
            x[draw.randrange(2)] ^= 1 << draw.randrange(64)
        prints.add(tuple(x))
    prints = sorted(prints)
    signed = [[v - (1 << 64) if v >> 63 else v for v in x] for x in prints]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(signed)], "node long, bits array<long>")
    got = {r["node"]: r["root"] for r in simhash.wide_roots(df, masks, 12, 2, steps).collect()}
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, x in enumerate(prints):
        for j in range(i):
            y = prints[j]
            meets = any(all(a & m == b & m for a, b, m in zip(x, y, mask, strict=True)) for mask in masks)
            if meets and sum((a ^ b).bit_count() for a, b in zip(x, y, strict=True)) <= 12:
                low, high = sorted((find(i), find(j)))
                parent[high] = low
    assert [got.get(i, i) for i in range(len(prints))] == [find(i) for i in range(len(prints))]
    assert 6 < len({find(i) for i in range(len(prints))}) < len(prints) - 50


def test_empty_table(spark):
    assert simhash.groups(documents(spark, []), distance=2).count() == 0
    assert simhash.one_of_each(documents(spark, [])).count() == 0


def edited(draw, words, changes):
    words = list(words)
    for _ in range(changes):
        words[draw.randrange(len(words))] = f"new{draw.randrange(10**6)}"
    return " ".join(words)


def test_one_of_each_keeps_clean_documents_and_one_copy(spark):
    draw = random.Random(5)
    rows, groups = [], []
    for g in range(60):
        words = [f"v{draw.randrange(5000)}" for _ in range(220)]
        rows.append((g * 10, " ".join(words), "en", "a"))
        if g % 3 == 0:
            rows.append((g * 10 + 1, edited(draw, words, 1 + g % 4), "en", "a"))
            groups.append(g * 10)
    rows += [(9000, None, None, None), (9001, "", None, None), (None, "alone without an id here", None, None), (0, rows[0][1], "en", "a")]
    df = documents(spark, rows)
    kept = simhash.one_of_each(df)
    assert kept.columns == df.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert {g * 10 for g in range(60)} | {9000, 9001, None} <= set(ids)
    assert len(ids) == len(set(ids))
    missed = [g + 1 for g in groups if g + 1 in ids]
    assert len(missed) <= 1


def test_one_of_each_is_exact_on_both_sides_of_the_limit(spark):
    """Isolated pairs just above 0.8 all lose their copy, and pairs just below all keep both."""

    def shingles(text):
        words = text.split()
        return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}

    draw = random.Random(11)
    rows, kept = [], set()
    for g in range(240):
        words = [f"g{g}v{draw.randrange(5000)}" for _ in range(220)]
        # The end replaced: similarities around 0.8 and above, or from 0.7 to 0.79.
        end = draw.randint(20, 24) if g % 2 else draw.randint(26, 38)
        other = words[:-end] + [f"o{g}v{draw.randrange(5000)}" for _ in range(end)]
        a, b = " ".join(words), " ".join(other)
        same = len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))
        assert (0.79 < same < 0.85) if g % 2 else (0.69 < same < 0.8)
        rows += [(2 * g, a, "en", "a"), (2 * g + 1, b, "en", "a")]
        kept |= {2 * g} | (set() if same >= 0.8 else {2 * g + 1})
    # Many copies in one group, and texts that are near only because a line repeats (equal fingerprints, different sets).
    words = [f"big{i}" for i in range(300)]
    rows += [(1000 + i, " ".join([*words[:i], f"new{i}", *words[i + 1 :]]), "en", "a") for i in range(150)]
    line = " ".join(["same"] * 4000)
    rows += [(2000 + i, f"{line} {' '.join(f'own{i}x{k}' for k in range(30))}", "en", "a") for i in range(2)]
    got = [r["doc_id"] for r in simhash.one_of_each(documents(spark, rows, extra=False)).collect()]
    assert sorted(got) == sorted(kept | {1000, 2000, 2001})
