from collections import Counter

import pytest
from cases import ROWS, documents
from pyspark.sql import functions as F

from tidemark.llm import mixing


def plain_targets(sizes, weights, share=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    target, left, open_ = dict.fromkeys(names, 0.0), share * sum(sizes.values()), set(names)
    while open_:
        total = sum(weight[n] for n in open_)
        full = {n for n in open_ if left * weight[n] / total >= most * sizes[n]}
        for n in full or open_:
            target[n] = most * sizes[n] if full else left * weight[n] / total
        if not full:
            break
        left -= sum(target[n] for n in full)
        open_ -= full
    return target


def test_targets(spark):
    for sizes in ({"a": 100, "b": 900, None: 50, "c": 10, "d": 4000}, {"a": 10}, {"x": 0, "y": 7, "z": 3}, {None: 5, "": 5}):
        df = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, size long")
        got = {r["source"]: r["target"] for r in mixing.source_targets(df, "source", "size", [5.0, 2.0, 1.0]).collect()}
        assert got == pytest.approx(plain_targets(sizes, [5.0, 2.0, 1.0]))


def test_copies_by_a_plain_running_sum(spark):
    rows = [(i, "a" if i % 3 else None, (i * 37) % 50, (i % 7) / 3) for i in range(400)] + [(None, "b", None, None), (None, "b", 5, 1.5)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long, expected double")
    got = mixing.copies(df)
    again = got.collect()
    assert sorted(map(str, again)) == sorted(map(str, mixing.copies(df.repartition(7)).collect()))
    for r in again:
        assert int(r["expected"] or 0) <= r["copies"] <= -int(-(r["expected"] or 0) // 1)
    for name in ("a", None):
        mine = [r for r in again if r["source"] == name]
        assert abs(sum(r["copies"] for r in mine) - sum(r["expected"] for r in mine)) < 1


def test_mixed(spark):
    df = documents(spark, ROWS + [(100 + i, "word " * (i % 40), "en", "abc"[i % 3]) for i in range(600)])
    out = mixing.mixed(df, [5.0, 2.0, 1.0])
    assert out.columns == df.columns
    rows = out.collect()
    words = lambda frame: {r[0]: r[1] for r in frame.groupBy("source").agg(F.sum(mixing.word_count(F.col("text")))).collect()}
    target = plain_targets(words(df), [5.0, 2.0, 1.0])
    taken = words(out)
    for name in ("b", "c"):
        assert taken[name] == pytest.approx(target[name], rel=0.05)
    assert max(Counter((r["doc_id"], r["text"]) for r in rows if r["doc_id"] != 2).values()) <= 2
    assert mixing.mixed(documents(spark, []), [1.0]).count() == 0
