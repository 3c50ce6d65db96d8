"""SimHash near-duplicates: fingerprints, pigeonhole blocks, verified links, components."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.graph import components
from tidemark.llm.text import free_name, stored, word_blocks

SEED = 42
BLOCK = 1 << 16
# Rows of a bucket up to which all its pairs are compared; larger ones go the other, equally exact, way.
BUCKET = 64
_MASK = (1 << 64) - 1


def _lane(hashes: np.ndarray, lane: int) -> np.ndarray:
    """Lane 0 is the hash itself; further lanes are independent mixes of it."""
    if lane == 0:
        return hashes
    x = hashes ^ np.uint64(xxhash.xxh64_intdigest(b"lane", lane))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str | None, shingle: int) -> Iterator[np.ndarray]:
    """Hashes of a whole text's shingles, block by block. Fewer words than a shingle: the words are the shingle; no words: none."""
    carry, some = [], False
    for words in word_blocks((text or "").encode("utf-8", "surrogatepass").lower()):
        carry += words
        if len(carry) < shingle:
            continue
        for at in range(0, len(carry) - shingle + 1, BLOCK):
            part = carry[at : at + BLOCK + shingle - 1]
            joined = map(b" ".join, zip(*(part[k:] for k in range(shingle))))
            yield np.fromiter(map(xxhash.xxh64_intdigest, joined, repeat(SEED)), np.uint64, len(part) - shingle + 1)
            some = True
        carry = carry[len(carry) - shingle + 1 :]
    if not some and carry:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(carry), SEED)], np.uint64)


def fingerprint(text: str | None, shingle: int, lanes: int = 1) -> list[int]:
    """64 bits per lane, as signed numbers: a bit is 1 if set in over half of the shingles' hashes.

    Shingles are taken block by block. No words: all zero. Fewer words than a shingle: the words are the shingle.
    """
    return _majority(shingle_hashes(text, shingle), lanes)


def _majority(blocks: Iterable[np.ndarray], lanes: int = 1) -> list[int]:
    ones, total = np.zeros(64 * lanes, np.int64), 0
    for hashes in blocks:
        ones += _ones(hashes, lanes)
        total += len(hashes)
    bits = np.packbits(ones * 2 > total) if total else np.zeros(8 * lanes, np.uint8)
    return bits.view(">i8").tolist()


def _ones(hashes: np.ndarray, lanes: int) -> np.ndarray:
    each = [np.unpackbits(_lane(hashes, k).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64) for k in range(lanes)]
    return np.concatenate(each)


def with_fingerprints(df: DataFrame, text: str = "text", shingle: int = 5, lanes: int = 1, out: str = "bits") -> DataFrame:
    """The rows with an array of ``lanes`` numbers of 64 bits. A NULL text counts as empty."""

    @F.pandas_udf("array<bigint>")
    def bits(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, shingle, lanes) for t in texts])

    return df.withColumn(out, bits(F.col(text)))


def hex_digits(bits: Column, lanes: int = 1) -> Column:
    """16 lowercase hex digits per lane."""
    return F.concat(*[F.lower(F.lpad(F.hex(bits[k]), 16, "0")) for k in range(lanes)])


def pigeonhole(distance: int, blocks: int) -> list[list[int]]:
    """Bit masks of one lane: 64 bits are cut into blocks; fingerprints that differ in ``distance`` bits or fewer

    agree in at least ``blocks - distance`` of them, so each choice of that many blocks is a key.
    """
    if not 0 <= distance < blocks <= 64:
        raise ValueError("0 <= distance < blocks <= 64 is needed")
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    block = [((1 << cuts[i + 1]) - 1) ^ ((1 << cuts[i]) - 1) for i in range(blocks)]
    return [[reduce(int.__or__, (block[i] for i in chosen))] for chosen in combinations(range(blocks), blocks - distance)]


def spread(lanes: int, keys: int, bits: int) -> list[list[int]]:
    """Masks over several lanes for radii no pigeonhole key is selective for: each key takes ``bits`` bit blocks of width one.

    The positions follow from the key's number alone. Pairs meet in a key with a probability that falls with
    their distance; what meets is verified.
    """
    masks = []
    for key in range(keys):
        order = sorted(range(64 * lanes), key=lambda i: xxhash.xxh64_intdigest(f"{key}/{i}"))[:bits]
        masks.append([sum(1 << (i % 64) for i in order if i // 64 == lane) for lane in range(lanes)])
    return masks


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _keys(bits: Column, masks: list[list[int]], start: int = 0) -> Column:
    """One number per key; equal masked bits give equal numbers (the rest is verified anyway).

    Keys of few bits are hashed to 32, which with the key's number makes a number that packs well.
    """

    few = all(sum(m.bit_count() for m in mask) <= 28 for mask in masks)
    table = json.dumps([{"i": i, "m": [_signed(m) for m in mask]} for i, mask in enumerate(masks, start)])

    def key(row: Column) -> Column:
        hashed = F.xxhash64(row["i"], *[bits[k].bitwiseAND(row["m"][k]) for k in range(len(masks[0]))])
        return F.shiftleft(row["i"], 32).bitwiseOR(hashed.bitwiseAND(F.lit((1 << 32) - 1))) if few else hashed

    # The masks are a constant array that is walked: spelled out, a hundred keys would be too much code for one method.
    return F.transform(F.from_json(F.lit(table), "array<struct<i: bigint, m: array<bigint>>>"), key)


def _apart(a: Column, b: Column, lanes: int) -> Column:
    return reduce(Column.__add__, [F.bit_count(a[k].bitwiseXOR(b[k])) for k in range(lanes)])


def links(prints: DataFrame, masks: list[list[int]], distance: int, lanes: int = 1, bucket: int = BUCKET) -> DataFrame:
    """Verified links (a, b) between the fingerprints of a table (node, bits) without repeats.

    Every pair that shares a key and differs in at most ``distance`` bits is linked here or connected by other
    links. Buckets of up to ``bucket`` rows compare all pairs. Of larger ones (a big group of near copies)
    no pairs are formed: for distance 2 in one lane, fingerprints meet at the values one bit away from
    them, each of which links all that reach it to its smallest, 65 rows a fingerprint; else each member is
    compared with its bucket's smallest, and only members left outside that component are compared with the
    rest of the bucket.
    """
    rows = prints.select("node", F.explode(_keys(F.col("bits"), masks)).alias("key"))
    busy = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("leader")).where("n > 1")
    members = stored(rows.join(busy, "key").join(prints, "node"), "buckets")
    small = members.where(F.col("n") <= bucket).select("key", "node", "bits")
    other = small.select(F.col("key").alias("key_b"), F.col("node").alias("node_b"), F.col("bits").alias("bits_b"))
    found = small.join(other, (F.col("key") == F.col("key_b")) & (F.col("node") < F.col("node_b")) & (_apart(F.col("bits"), F.col("bits_b"), lanes) <= distance))
    found = found.select(F.col("node").alias("a"), F.col("node_b").alias("b")).distinct()
    large = members.where(F.col("n") > bucket)
    if large.isEmpty():
        return found
    found = stored(found, "pairs")
    if distance == 2 and lanes == 1:
        return found.union(_one_bit_stars(large.select("node", "bits").distinct()))
    led, crossing, _ = _outsiders(found, large, distance, lanes)
    return found.union(led).union(crossing)


def wide_roots(prints: DataFrame, masks: list[list[int]], distance: int, lanes: int, steps: tuple[int, ...] = (4, 24)) -> DataFrame:
    """(node, root): components of all links between fingerprints that share a key and differ in ``distance`` bits or fewer.

    Pairs are never formed within what is connected already. Keys are taken in turns that end at ``steps`` and at the last
    key: the first few connect most of a large group; of later keys only buckets that hold several components are looked at. In a bucket each member is compared with the smallest, and
    those it leaves outside with all members of other components: nothing that meets in a key is left uncompared, and
    rows stay in proportion to fingerprints times keys.
    """
    edges, roots = None, None
    ends = [n for n in steps if n < len(masks)] + [len(masks)]
    for start, stop in zip([0, *ends], ends, strict=False):
        known = prints if roots is None else prints.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        component = "node" if roots is None else "root"
        rows = known.select("node", F.col(component).alias("part"), F.explode(_keys(F.col("bits"), masks[start:stop], start)).alias("key"))
        busy = rows.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.min("node").alias("leader")).where("low < high")
        members = stored(rows.join(busy.select("key", "leader"), "key").join(prints, "node").select("key", "node", "bits", "leader"), "buckets")
        led, crossing, roots = _outsiders(edges, members, distance, lanes)
        crossing = stored(crossing, "crossing")
        edges = stored(led.union(crossing) if edges is None else edges.union(led).union(crossing), "edges")
        if not crossing.isEmpty():
            roots = stored(components(edges, "a", "b"), "roots")
    return roots


def _one_bit_stars(prints: DataFrame) -> DataFrame:
    """Two fingerprints reach a common value by changing one bit or none exactly if they differ in 2 bits or fewer."""
    near = F.array(F.col("bits")[0], *[F.col("bits")[0].bitwiseXOR(F.lit(_signed(1 << i)).cast("long")) for i in range(64)])
    rows = prints.select("node", F.explode(near).alias("value"))
    least = rows.groupBy("value").agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return rows.join(least, "value").where("node != a").select("a", F.col("node").alias("b")).distinct()


def _outsiders(found: DataFrame | None, large: DataFrame, distance: int, lanes: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links of buckets to their leader, links between those whom that leaves in different components, and these components."""
    leaders = large.where("node = leader").select("key", F.col("bits").alias("leader_bits"))
    led = large.join(leaders, "key").where(_apart(F.col("bits"), F.col("leader_bits"), lanes) <= distance)
    led = stored(led.where("node != leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct(), "led")
    roots = stored(components(led if found is None else found.union(led), "a", "b"), "roots")
    root = F.coalesce("root", "node")
    named = large.join(roots, "node", "left").withColumn("root", root)
    heads = named.where("node = leader").select("key", F.col("root").alias("head"))
    named = stored(named.join(heads, "key").select("key", "node", "bits", "root", "head"), "named")
    out = named.where("root != head").select("key", "node", "bits", "root", "head")
    rest = named.select(F.col("key").alias("key_b"), F.col("node").alias("node_b"), F.col("bits").alias("bits_b"), F.col("root").alias("root_b"), F.col("head").alias("head_b"))
    meets = (
        (F.col("key") == F.col("key_b"))
        & (F.col("root") != F.col("root_b"))
        & ((F.col("root_b") == F.col("head_b")) | (F.col("node") < F.col("node_b")))
        & (_apart(F.col("bits"), F.col("bits_b"), lanes) <= distance)
    )
    crossing = out.join(rest, meets).select(F.col("node").alias("a"), F.col("node_b").alias("b")).distinct()
    return led, crossing, roots


def groups(
    df: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    shingle: int = 5,
    distance: int = 2,
    lanes: int = 1,
    masks: list[list[int]] | None = None,
    bucket: int = BUCKET,
) -> DataFrame:
    """One row per input row: (id, bits, fingerprint, component_id), the smallest id its fingerprint is linked to.

    Equal fingerprints are collapsed before anything is joined, so copies cost one row each. NULL and empty
    texts and texts without words have fingerprint zero and are linked with each other. Repeated rows stay
    repeated. Rows with a NULL id take part; their component is the smallest id that is not NULL, or NULL.
    An empty table gives no rows. Only the id is carried along, so other columns cannot clash.
    """
    masks = pigeonhole(distance, 5) if masks is None else masks
    seen = with_fingerprints(df.select(F.col(id_column).alias("id"), F.col(text).alias("text")), "text", shingle, lanes)
    node = F.col("bits")[0] if lanes == 1 else F.xxhash64("bits")
    seen = stored(seen.select("id", "bits", node.alias("node")), "fingerprints")
    prints = stored(seen.groupBy("node").agg(F.min("id").alias("least"), F.first("bits").alias("bits")), "prints")
    if lanes == 1:
        roots = components(links(prints.select("node", "bits"), masks, distance, lanes, bucket), "a", "b")
    else:
        roots = wide_roots(prints.select("node", "bits"), masks, distance, lanes)
    rooted = prints.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "least")
    linked = rooted.join(roots.select("root").distinct(), "root").groupBy("root").agg(F.min("least").alias("linked"))
    named = rooted.join(linked, "root", "left").select("node", F.coalesce("linked", "least").alias("component_id"))
    return seen.join(named, "node").select(F.col("id").alias(id_column), "bits", hex_digits(F.col("bits"), lanes).alias("fingerprint"), "component_id")


# Exact near copies. Bits in which the fingerprints of the first turn may differ, and the blocks they are cut into.
DISTANCE, BLOCKS = 2, 5
# Shingles that occur often come last in the order of a prefix: counted in one set of SAMPLE, this many at most.
SAMPLE, FREQUENT = 16, 1 << 20


def _distinct(parts: Iterable[np.ndarray]) -> np.ndarray:
    each = [np.unique(h) for h in parts]
    return np.unique(np.concatenate(each)).view(np.int64) if each else np.zeros(0, np.int64)


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """The different shingle hashes of a whole text, as signed numbers."""
    return _distinct(shingle_hashes(text, shingle))


def prefix(shingles: np.ndarray, similarity: float, frequent: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first shingles of a set in one order for all sets (rare ones first): n less the least overlap, plus one.

    Pigeonhole for sets: a partner of this Jaccard similarity has ceil(similarity * n) of the n shingles or more, so two partners
    cannot miss each other's prefix. The order decides how many others meet, never which partners do.
    """
    rank = np.zeros(len(shingles), np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, shingles), len(frequent) - 1)
        rank = np.where(frequent[at] == shingles, counts[at], 0)
    least = int(np.ceil(similarity * len(shingles) - 1e-9))
    return shingles[np.lexsort((shingles, rank))[: len(shingles) - least + 1]]


def _frequent(texts: DataFrame, shingles: Callable[[str], Column]) -> tuple[np.ndarray, np.ndarray]:
    """(shingles in order, counts) of the most frequent ones of a sample; bounded, as it goes along with the tasks."""
    sample = texts.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).select(F.explode(shingles("text")).alias("shingle"))
    rows = sample.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where("n > 2").orderBy(F.desc("n"), "shingle").limit(FREQUENT).toPandas().sort_values("shingle")
    return rows["shingle"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)


# Bytes of a packed shingle: 40 bits tell the shingles of two texts apart. Words of a bitmap, which only rules pairs out.
PACKED, MAP_WORDS = 5, 32


def pack(shingles: np.ndarray) -> bytes:
    """A set of shingle hashes, five bytes each."""
    return np.ascontiguousarray(np.unique(shingles.view(np.uint64) >> np.uint64(24)).view(np.uint8).reshape(-1, 8)[:, :PACKED]).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // PACKED, 8), np.uint8)
    wide[:, :PACKED] = np.frombuffer(data, np.uint8).reshape(-1, PACKED)
    return wide.view(np.uint64).ravel()


def bitmap(shingles: np.ndarray) -> np.ndarray:
    """A bit for every shingle, by its hash. Each bit in which two maps differ is a shingle that one set lacks."""
    at = np.unique(shingles.view(np.uint64) % np.uint64(64 * MAP_WORDS)).astype(np.int64)
    bits = np.zeros(64 * MAP_WORDS, np.uint8)
    bits[at] = 1
    return np.packbits(bits).view(np.int64)


def _similarities(a: pd.Series, b: pd.Series) -> pd.Series:
    """Jaccard similarities of packed sets."""
    found = []
    for x, y in zip(a, b, strict=True):
        x, y = _unpacked(x), _unpacked(y)
        common = len(np.intersect1d(x, y, assume_unique=True))
        found.append(common / (len(x) + len(y) - common))
    return pd.Series(found, dtype=float)


def _verified(pairs: DataFrame, sets: DataFrame, sets_of: Callable[[DataFrame], DataFrame], similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets have this Jaccard similarity: counted, not estimated.

    Bitmaps rule out pairs that surely differ in too many shingles; only the sets of the others are made.
    """
    maps = sets.select("node", "size", "map")
    end = lambda side: maps.select(F.col("node").alias(side), F.col("size").alias(f"size_{side}"), F.col("map").alias(f"map_{side}"))
    both = pairs.distinct().join(end("a"), "a").join(end("b"), "b")
    apart = F.aggregate(F.zip_with("map_a", "map_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    most = (F.col("size_a") + F.col("size_b")) * ((1 - similarity) / (1 + similarity)) + 1e-6
    likely = stored(both.where(apart <= most).select("a", "b"), "pairs")
    if likely.isEmpty():
        return likely
    held = stored(sets_of(stored(likely.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "asked")), "sets")
    both = likely.join(held.select(F.col("node").alias("a"), F.col("packed").alias("of_a")), "a").join(held.select(F.col("node").alias("b"), F.col("packed").alias("of_b")), "b")
    jaccard = F.pandas_udf(_similarities, "double")
    return stored(both.where(jaccard("of_a", "of_b") >= similarity).select("a", "b"), "verified")


def fingerprint_pairs(sets: DataFrame) -> DataFrame:
    """(a, b): sets whose fingerprints differ in ``DISTANCE`` bits or fewer, each group of equal ones by its smallest node."""
    prints = stored(sets.groupBy("bits").agg(F.min("node").alias("least")), "prints")
    found = links(prints.select(F.col("bits").alias("node"), F.array("bits").alias("bits")), pigeonhole(DISTANCE, BLOCKS), DISTANCE)
    end = lambda side: prints.select(F.col("bits").alias(side), F.col("least").alias(f"least_{side}"))
    found = found.join(end("a"), "a").join(end("b"), "b").select(F.col("least_a").alias("a"), F.col("least_b").alias("b"))
    return found.union(sets.join(prints, "bits").where("node != least").select(F.col("least").alias("a"), F.col("node").alias("b")))


def near_roots(sets: DataFrame, sets_of: Callable[[DataFrame], DataFrame], similarity: float) -> DataFrame:
    """(node, root): components of all pairs of sets with a Jaccard similarity of ``similarity`` or more.

    ``sets`` has, for each different set, node, size, bitmap, ``bits`` (its SimHash fingerprint) and ``keys`` (its prefix, in order);
    ``sets_of`` makes the packed sets of a table of nodes. Sets meet by their fingerprints first. Every pair that is similar enough
    and no fingerprint has brought together meets in a key of both prefixes. In a bucket that holds several components,
    members are compared with one of them unless they are connected to it, and those still outside with the members of other
    components: pairs are never formed within what is connected already. What two sets have in common cannot come before the first
    key they share, so no more than what either has from there on; where that is too little they are not compared. Every
    other comparison counts the common shingles.
    """
    share = similarity / (1 + similarity)

    def enough(size: str, at: str, size_b: str, at_b: str) -> Column:
        return F.least(F.col(size) - F.col(at), F.col(size_b) - F.col(at_b)) >= (F.col(size) + F.col(size_b)) * share - 1e-6

    edges = _verified(fingerprint_pairs(sets), sets, sets_of, similarity)
    roots = stored(components(edges, "a", "b"), "roots")
    known = sets.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rows = known.select("node", "root", "size", F.posexplode("keys").alias("at", "key"))
    # The member that has the key foremost leads the bucket: it has fewest shingles of its own, so most in common with the others.
    place = F.shiftleft(F.floor(F.col("at") * 4096 / F.col("size")).cast("long"), 48).bitwiseOR(F.col("node").bitwiseAND(F.lit((1 << 48) - 1)))
    first = F.max(enough("size", "at", "size", "at")).alias("first")
    busy = rows.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min(place).alias("lead"), first).where("low < high AND first")
    busy = stored(busy.select("key", "lead"), "busy")
    members = stored(rows.join(busy, "key").select("key", "node", "size", "at", "root", (place == F.col("lead")).alias("leads")), "buckets")
    heads = stored(members.where("leads").select("key", *[F.col(c).alias(f"leader_{c}") for c in ("node", "size", "at", "root")]), "heads")
    apart = members.join(heads, "key").where((F.col("root") != F.col("leader_root")) & enough("size", "at", "leader_size", "leader_at"))
    led = _verified(apart.select(F.least("node", "leader_node").alias("a"), F.greatest("node", "leader_node").alias("b")), sets, sets_of, similarity)
    edges = edges.union(led)
    roots = stored(components(edges, "a", "b"), "roots")
    found = roots.select(F.col("node").alias("leader_node"), F.col("root").alias("head"))
    found = heads.join(found, "leader_node", "left").select("key", F.coalesce("head", "leader_node").alias("head"))
    named = members.drop("root", "leads").join(roots, "node", "left").join(found, "key")
    named = stored(named.select("key", "node", "size", "at", F.coalesce("root", "node").alias("root"), "head"), "named")
    rest = named.toDF("key_b", "node_b", "size_b", "at_b", "root_b", "head_b")
    meets = (
        (F.col("key") == F.col("key_b"))
        & (F.col("root") != F.col("root_b"))
        & ((F.col("root_b") == F.col("head_b")) | (F.col("node") < F.col("node_b")))
        & enough("size", "at", "size_b", "at_b")
    )
    crossing = named.where("root != head").join(rest, meets).select(F.least("node", "node_b").alias("a"), F.greatest("node", "node_b").alias("b"))
    crossing = _verified(crossing, sets, sets_of, similarity)
    return roots if crossing.isEmpty() else stored(components(edges.union(crossing), "a", "b"), "roots")


def one_of_each(df: DataFrame, id_column: str = "doc_id", text: str = "text", similarity: float = 0.8, size: int = 5) -> DataFrame:
    """The input without near copies: of each group of linked texts the row with the smallest id stays.

    Texts are linked if the Jaccard similarity of their sets of five-word shingles is ``similarity`` or more, all such pairs and
    no others (shingles are told apart by hashes of 64 bits). Groups are the components of these links. Texts without words are no
    copies of each other and all stay. NULL ids: such a row stays only if its group has no id. Of rows that repeat the kept id, one
    stays. All columns are returned as they were.
    """
    row = free_name(df, "row_key")
    keyed = df.withColumn(row, F.struct(F.col(id_column).isNull().alias("none"), F.col(id_column).alias("id"), F.xxhash64(text).alias("content")))
    worded = F.coalesce(F.col(text), F.lit("")).rlike(r"[^\x20\x09-\x0D]")

    @F.pandas_udf("array<bigint>")
    def shingles(texts: pd.Series) -> pd.Series:
        return pd.Series([shingle_set(t, size) for t in texts], dtype=object)

    @F.pandas_udf("binary")
    def packed(texts: pd.Series) -> pd.Series:
        return pd.Series([pack(shingle_set(t, size)) for t in texts], dtype=object)

    texts = keyed.where(worded).select(F.col(row).alias("row"), F.col(text).alias("text"))
    frequent = df.sparkSession.sparkContext.broadcast(_frequent(texts, shingles))

    @F.pandas_udf("struct<node:bigint,size:int,map:array<bigint>,bits:bigint,keys:array<int>>")
    def profile(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for each in texts:
            parts = list(shingle_hashes(each, size))
            s = _distinct(parts)
            # Folded keys only let a few more sets meet; what is linked is counted on whole hashes.
            keys = prefix(s, similarity, *frequent.value).astype(np.uint64).astype(np.uint32).view(np.int32)
            rows.append((np.uint64(xxhash.xxh64_intdigest(s.tobytes())).astype(np.int64), len(s), bitmap(s), _majority(parts)[0], keys))
        return pd.DataFrame(rows, columns=["node", "size", "map", "bits", "keys"])

    # Every text is cut once; what goes on is a fifth of its shingles, four bytes each.
    made = stored(texts.select("row", profile("text").alias("p")).select("row", "p.*"), "profiles")
    least = stored(made.groupBy("node").agg(F.min("row").alias("row")), "least")

    # Only rows that repeat a key have to be brought together; as a rule there are none.
    repeated = stored(made.groupBy("row").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("row"), "repeated")

    def single(rows: DataFrame, key: str) -> DataFrame:
        again = repeated.withColumnRenamed("row", key)
        return rows.join(again, key, "left_anti").unionByName(rows.join(again, key, "left_semi").dropDuplicates([key]))

    sets = stored(single(made.join(least.select("row"), "row", "left_semi"), "row").drop("row"), "distinct")

    # What texts are joined with is a table by then, so that Spark knows its size and moves no text where it is small.
    def sets_of(nodes: DataFrame) -> DataFrame:
        wanted = stored(least.join(nodes, "node", "left_semi"), "wanted")
        return single(texts.join(wanted, "row"), "row").select("node", packed("text").alias("packed"))

    roots = near_roots(sets, sets_of, similarity)
    rooted = least.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    kept = stored(rooted.groupBy("root").agg(F.min("row").alias(row)).select(row), "kept")
    once = single(keyed.where(worded).join(kept, row, "left_semi"), row)
    return once.drop(row).unionByName(keyed.where(~worded).drop(row))
