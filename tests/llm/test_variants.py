import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cases import documents
from tidemark.llm import queries, variants

SF = "/root/testdata/sf0.001"


def plain_words(rows, wear=97, letters=5, count=3):
    n = Counter()
    for doc_id, text in rows:
        run = ""
        for c in (text or "") + " ":
            if "A" <= c <= "Z" or "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += chr(ord(c) + 32) if "A" <= c <= "Z" else c
            elif run:
                h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
                if wear and h % wear == 0:
                    run = run[: h % len(run)] + run[h % len(run) + 1 :]
                n[run] += 1
                run = ""
    return {w: k for w, k in n.items() if len(w) >= letters and k >= count}


def is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_groups(n):
    near = {w: [] for w in n}
    words = sorted(n)
    for i, a in enumerate(words):
        for b in words[:i]:
            if abs(len(a) - len(b)) < 2 and is_near(a, b):
                near[a].append(b)
                near[b].append(a)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-n[o], o), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None)
    return out


def as_dict(df):
    rows = df.collect()
    found = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}
    assert len(found) == len(rows)
    return found


def test_query_against_plain_version(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    expected = plain_groups(plain_words(rows))
    assert as_dict(queries.QUERIES["op12_kd_variants"](spark, SF)) == expected
    assert any(v[0] for v in expected.values())


@pytest.mark.parametrize("limits", [{}, {"CELL": 40, "LEAF": 4}, {"CELL": 40, "SAMPLE": 50, "POINTS": 7, "QUERIES": 11, "LEAF": 2, "PAIRS": 16}])
def test_cells_and_blocks_change_nothing(spark, limits, monkeypatch):
    for name, value in limits.items():
        monkeypatch.setattr(variants, name, value)
    draw = np.random.default_rng(3)
    n = {"".join(draw.choice(list("abcé"), draw.integers(5, 8))): int(draw.integers(3, 60)) for _ in range(900)}
    n |= {"ab" * 200: 5, "ab" * 200 + "a": 50, "aaaaaaaaaa": 3, "aaaaaaaaab": 3, "\U0001f600bcde": 9, "\U0001f601bcde": 3}
    words = spark.createDataFrame(list(n.items()), "word string, n long")
    assert as_dict(variants.grouped(words)) == plain_groups(n)


def test_anagrams_in_one_cell_are_searched_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(variants, "CELL", 20)
    monkeypatch.setattr(variants, "POINTS", 16)
    from itertools import permutations

    n = {"".join(p): 3 + i % 5 for i, p in enumerate(permutations("abcdef"))} | {"abcdeg": 40, "abcde": 90}
    words = spark.createDataFrame(list(n.items()), "word string, n long")
    assert as_dict(variants.grouped(words)) == plain_groups(n)


def test_ties_chains_and_repeats(spark):
    n = {"house": 100, "houses": 40, "houzes": 10, "hounes": 3, "mouse": 100, "louse": 20}
    words = spark.createDataFrame(list(n.items()), "word string, n long")
    found = as_dict(variants.grouped(words))
    assert found == plain_groups(n)
    assert found["hounes"][:2] == ("houses", "house") and found["louse"][0] == "house" and found["mouse"][0] is None


def test_odd_rows(spark):
    docs = documents(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    words = variants.word_counts(docs, wear=97)
    assert {r["word"]: r["n"] for r in words.collect()} == plain_words(rows)
    short = variants.word_counts(docs, 1, 1)
    assert {r["word"]: r["n"] for r in short.collect()} == plain_words(rows, None, 1, 1)
    assert as_dict(variants.grouped(words)) == plain_groups(plain_words(rows))
    assert variants.grouped(words.where(F.lit(False))).collect() == []
    nothing = variants.word_counts(documents(spark, [(1, None, None, None), (None, "", None, None), (2, "- 7 %", None, None)]))
    assert variants.grouped(nothing).collect() == []
