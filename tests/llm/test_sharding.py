import zlib

from cases import ROWS, documents
from pyspark.sql import functions as F

from tidemark.llm import sharding


def check(df, shards, rows, slack):
    got = df.collect()
    assert len(got) == rows
    size = [0] * shards
    slots = [[] for _ in range(shards)]
    for r in got:
        size[r["shard"]] += len((r["text"] or "").encode()) + 1
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots)
    assert max(size) - min(size) <= slack
    return got


def test_sizes_are_equal_whatever_the_keys(spark):
    rows = [(i, f"text {i} " * (1 + i % 50), "en", "a") for i in range(3000)] + [(5000 + i, "the same " * 9, None, None) for i in range(1500)]
    check(sharding.sharded(documents(spark, rows), 16), 16, 4500, 2 * 500)


def test_equal_texts_stay_together_and_reruns_agree(spark):
    df = documents(spark, [(i, f"text {i // 4}", None, None) for i in range(4000)])
    first = {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.sharded(df, 4).collect()}
    assert first == {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.sharded(df.repartition(9), 4).collect()}
    assert sum(len({first[i + k][0] for k in range(4)}) > 1 for i in range(0, 4000, 4)) <= 3


def test_odd_rows(spark):
    got = sharding.sharded(documents(spark), 3)
    assert got.columns == [*documents(spark).columns, "shard", "slot"]
    check(got, 3, len(ROWS), 10**7)
    assert sharding.sharded(documents(spark, []), 3).count() == 0
    check(sharding.sharded(documents(spark, [(None, None, None, None)] * 40), 4), 4, 40, 2)
    again = sharding.sharded(documents(spark).withColumns({"Shard": F.lit(77), "slot": F.lit("x")}), 3)
    assert again.columns == got.columns and {r["shard"] for r in again.collect()} <= {0, 1, 2}


def test_files_hold_the_rows(spark, tmp_path):
    df = documents(spark, [(i, f"text {i}", None, None) for i in range(200)], extra=False)
    sharding.write(df, str(tmp_path / "out"), shards=4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 200 and {r[0] for r in back.select("shard").distinct().collect()} == {0, 1, 2, 3}


def test_query_digests(spark):
    from tidemark.llm.queries import QUERIES

    got = QUERIES["op7_sampled_splitters"](spark, "/root/testdata/sf0.001").collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    for r in got:
        data = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 1, zlib.crc32(data), "bytes", None)
