from collections import Counter

import corpus_pipeline
from cases import documents
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, language, mixing, simhash

SF = "/root/testdata/sf0.001"


def plain_near_dedup(rows):
    """Smallest ids of the components of all pairs of five-word shingle sets that are similar enough."""
    rows = sorted(rows, key=lambda r: r["doc_id"])
    sets = [set(simhash.shingle_set(r["text"], 5).tolist()) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and len(a & sets[j]) / len(a | sets[j]) >= corpus_pipeline.SIMILARITY:
                low, high = sorted((find(i), find(j)))
                root[high] = low
    return [r["doc_id"] for i, r in enumerate(rows) if find(i) == i]


def test_stages_against_plain_versions(spark):
    """Each stage on what its predecessor kept, compared with a version on the driver."""
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "near_dedup", "decontaminate", "mix", "shard"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.collect()
    model = language.fit(docs)
    keeps = lambda m: bool(m) and next(iter(m.values())) >= corpus_pipeline.LANGUAGE_SHARE
    want = sorted(r["doc_id"] for r, m in zip(rows, language.mixtures([r["text"] for r in rows], model), strict=True) if keeps(m))
    known = stages["language_id"](spark, docs, SF).cache()
    assert known.columns == docs.columns and sorted(r["doc_id"] for r in known.collect()) == want
    assert len(want) >= 0.97 * len(rows)

    single = stages["near_dedup"](spark, known, SF).cache()
    kept = {r["doc_id"]: r["text"] for r in single.collect()}
    assert single.columns == docs.columns and len(kept) == single.count()
    assert set(kept) == set(plain_near_dedup(known.collect()))

    clean = stages["decontaminate"](spark, single, SF).cache()
    items = [decontaminate.words_of(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    windows = {w for words in items for w in decontaminate.windows_of(words, 10)}
    hit = {i for i, t in kept.items() if windows & set(decontaminate.windows_of(decontaminate.words_of(t), 10))}
    assert hit and sorted(r["doc_id"] for r in clean.collect()) == sorted(set(kept) - hit)

    mixed = stages["mix"](spark, clean, SF).cache()
    assert mixed.columns == docs.columns and max(Counter(r["doc_id"] for r in mixed.collect()).values()) <= 2
    total = lambda df: df.agg(F.sum(mixing.word_count(F.col("text")))).first()[0]
    assert abs(total(mixed) / total(clean) - 1.5) < 0.2

    shards = stages["shard"](spark, mixed, SF).collect()
    assert Counter(r["doc_id"] for r in shards) == Counter(r["doc_id"] for r in mixed.collect())
    sizes = Counter()
    for r in shards:
        sizes[r["shard"]] += len(r["text"].encode()) + 1
    assert len(sizes) == corpus_pipeline.SHARDS and max(sizes.values()) - min(sizes.values()) <= 2 * max(len(r["text"].encode()) for r in shards)


def test_stages_take_odd_rows_and_empty_tables(spark):
    for rows in (None, []):
        docs = documents(spark, rows)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            assert out.columns[: len(docs.columns)] == docs.columns, name
            assert out.count() <= 2 * docs.count()


def test_operators_replace_a_column_of_the_name_they_give(spark):
    """Names that the operators themselves give to their results."""
    from tidemark.llm import licences, media

    df = documents(spark).withColumns({c: F.lit("mine") for c in ("found", "languages", "licences", "media", "Copies")})
    assert dict(decontaminate.find_passages(df, spark.read.parquet(f"{SF}/benchmark.parquet")).dtypes)["found"].startswith("struct")
    assert dict(language.identify(df, language.Model([], language.np.zeros((language.BUCKETS, 0), "f4"))).dtypes)["languages"].startswith("array")
    assert dict(licences.scan(df).dtypes)["licences"].startswith("struct") and dict(media.with_media(df).dtypes)["media"] == "binary"
    for frame in (media.with_media(df), licences.scan(df)):
        assert frame.columns == df.columns and frame.count() == df.count()


def test_near_dedup_is_exact(spark):
    """What stays is what comparing the shingle sets of all pairs leaves."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = docs.collect()
    want = plain_near_dedup(rows)
    assert len(want) < len(rows)
    assert sorted(r["doc_id"] for r in dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, SF).collect()) == want


def test_near_dedup_of_groups_chains_and_common_lines(spark):
    """A large group of near copies, a chain whose ends are far apart, and a line that all documents share."""
    word = lambda *parts: "w" + "x".join(map(str, parts))
    line = " ".join(word("common", k) for k in range(30))
    rows = [(i, " ".join(word(i, k) for k in range(40)) + " " + line) for i in range(150)]
    base = [word("base", k) for k in range(120)]
    rows += [(1000 + i, " ".join(base[:60] + [word("edit", i)] + base[61:])) for i in range(90)]
    rows += [(2000 + i, " ".join(word("chain", k) for k in range(i * 5, i * 5 + 100))) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted(r["doc_id"] for r in simhash.one_of_each(docs).collect())
    assert found == plain_near_dedup(docs.collect()) == [*range(150), 1000, 2000]


def near_copies(n):
    """A text, copies with two words of their own each (near the text, not near each other), and others that share a line only."""
    word = lambda *parts: "w" + "x".join(map(str, parts))
    base = [word("base", k) for k in range(124)]
    rows = [(5000, " ".join(base))]
    for i in range(n):
        words = list(base)
        words[5 + i % 50], words[65 + (i * 7) % 50] = word("a", i), word("b", i)
        rows.append((6000 + i, " ".join(words)))
    return rows + [(9000 + i, " ".join([word("own", i, k) for k in range(12)] + base[:40])) for i in range(n)]


def test_near_dedup_forms_no_pairs_of_a_large_group(spark, monkeypatch):
    """Pairs that are formed stay in proportion to the rows, where a group's members are near one text and not each other."""
    n, formed, verified = 400, [], simhash._verified

    def counted(pairs, *rest):
        formed.append(pairs.count())
        return verified(pairs, *rest)

    monkeypatch.setattr(simhash, "_verified", counted)
    docs = spark.createDataFrame(near_copies(n), "doc_id long, text string").repartition(4)
    found = sorted(r["doc_id"] for r in simhash.one_of_each(docs).collect())
    assert found == [5000, *range(9000, 9000 + n)]
    assert sum(formed) < 100 * n


def test_near_dedup_meets_by_fingerprints_first(spark):
    """Links of the fingerprints are found by themselves, counted before they are taken, and not looked for again."""
    base = [f"w{k}" for k in range(600)]
    texts = [" ".join(base), " ".join([*base[:-1], "end"]), " ".join(f"v{k}" for k in range(600))]
    prints = [simhash.fingerprint(t, 5)[0] for t in texts]
    apart = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count()
    assert apart(prints[0], prints[1]) <= simhash.DISTANCE < apart(prints[0], prints[2])
    # The last set is given the fingerprint of one it has nothing in common with.
    rows = [(0, prints[0]), (1, prints[1]), (2, prints[2]), (3, prints[2])]
    sets = [simhash.shingle_set(t, 5) for t in [*texts, "a b c d e f"]]
    frame = spark.createDataFrame([(n, len(sets[n]), simhash.bitmap(sets[n]).tolist(), bits, []) for n, bits in rows], "node long, size int, map array<long>, bits long, keys array<int>")
    packed = spark.createDataFrame([(n, bytearray(simhash.pack(s))) for n, s in enumerate(sets)], "node long, packed binary")
    roots = simhash.near_roots(frame, lambda nodes: packed.join(nodes, "node", "left_semi"), 0.8)
    assert {(r["node"], r["root"]) for r in roots.collect()} == {(0, 0), (1, 0)}
