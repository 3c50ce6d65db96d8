import zlib

import numpy as np
from cases import LONG, ROWS, documents
from pyspark.sql import functions as F

from tidemark.llm import language

SF = "/root/testdata/sf0.001"


def test_counts_are_those_of_a_plain_loop():
    text = "Ab, c1dé  Ab"
    plain = " ab c dé ab "
    buckets, counts = language.n_grams(text)
    assert counts.sum() == len(plain) - 2
    assert len(buckets) == len({plain[i : i + 3] for i in range(len(plain) - 2)})
    for none in (None, "", " 12 .\n"):
        assert len(language.n_grams(none)[0]) == 0


def test_pieces_of_a_long_text(monkeypatch):
    whole = dict(zip(*map(np.ndarray.tolist, language.n_grams(LONG)), strict=True))
    monkeypatch.setattr(language, "PIECE", 50_000)
    parts = dict(zip(*map(np.ndarray.tolist, language.n_grams(LONG)), strict=True))
    assert sum(abs(whole.get(k, 0) - parts.get(k, 0)) for k in {*whole, *parts}) < len(LONG) // 50_000 * 8


def plain_em(buckets, counts, table, rounds):
    k = table.shape[1]
    share = np.full(k, 1 / k)
    p = np.exp(table[buckets].astype(float))
    for _ in range(rounds):
        new = np.zeros(k)
        for row, c in zip(p, counts, strict=True):
            new += c * row * share / (row * share).sum()
        share = new / new.sum()
    return share


def trained(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return docs, language.fit(docs.where(~language.held_out(F.col("doc_id"))))


def test_em_agrees_with_a_plain_loop(spark):
    docs, model = trained(spark)
    grams = [language.n_grams(r["text"]) for r in docs.limit(5).collect()]
    batch = language._Batch([g[0] for g in grams], [g[1] for g in grams], model)
    got, _ = batch.em(np.full((len(grams), len(model.languages)), 1 / len(model.languages)))
    for row, g in zip(got, grams, strict=True):
        np.testing.assert_allclose(row, plain_em(*g, model.log_probability, language.ROUNDS), atol=1e-6)


def test_held_out_accuracy_and_mixtures(spark):
    docs, model = trained(spark)
    rows = docs.where(language.held_out(F.col("doc_id"))).collect()
    got = language.mixtures([r["text"] for r in rows], model)
    right = sum(next(iter(m), None) == r["lang"] for m, r in zip(got, rows, strict=True))
    assert right / len(rows) >= 0.97
    by = {}
    for r in rows:
        if len(r["text"]) > 600:
            by.setdefault(r["lang"], r["text"])
    assert len(by) >= 3
    names = sorted(by)
    for a, b in zip(names, names[1:], strict=False):
        mixed = language.mixtures([by[a][:400] + " " + by[b][:400]], model)[0]
        assert {a, b} == set(mixed) and min(mixed.values()) > 0.3
    alone = [language.mixtures([t], model)[0] for t in by.values()]
    assert sum(len(m) == 1 for m in alone) >= len(alone) - 1


def test_odd_rows(spark):
    _, model = trained(spark)
    got = language.identify(documents(spark), model).collect()
    assert len(got) == len(ROWS)
    for r in got:
        assert bool(r["languages"]) == any(c.isalpha() for c in r["text"] or "")
        assert not r["languages"] or abs(sum(x["share"] for x in r["languages"]) - 1) < 1e-6
    assert language.identify(documents(spark, []), model).count() == 0
    kept = language.known_language(documents(spark), model)
    assert kept.columns == documents(spark).columns and {4, 5, 6}.isdisjoint({r["doc_id"] for r in kept.collect()})


def test_nothing_to_learn_from(spark):
    empty = language.fit(documents(spark, [(1, "text", None, None), (2, None, "en", None)]))
    assert empty.languages == []
    assert all(r["languages"] == [] for r in language.identify(documents(spark), empty).collect())


def test_query(spark):
    from tidemark.llm.queries import QUERIES

    got = QUERIES["op1_language_mixture"](spark, SF).collect()
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert sorted(docs) == sorted(r["doc_id"] for r in got)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["lang_pred"] in {"en", "fr", "de", "es", "und"}


def test_texts_of_five_and_six_languages(spark):
    """As many languages as a text has, each with its share; nothing limits their number."""
    draw = np.random.default_rng(4)
    alphabets = ["abcdefgh", "ijklmnop", "qrstuvwx", "αβγδεζηθ", "абвгдежз", "ابتثجحخد", "אבגדהוזח"]
    text = lambda letters, n: " ".join("".join(draw.choice(list(letters), draw.integers(3, 9))) for _ in range(n))
    rows = [(k, text(a, 400), f"l{k}", None) for k, a in enumerate(alphabets)]
    model = language.fit(documents(spark, rows))
    for n in (5, 6, 7):
        mixed = " ".join(text(a, 120) for a in alphabets[:n])
        (found,) = language.mixtures([mixed], model)
        sizes = [len("".join(c for c in mixed if c in a)) for a in alphabets[:n]]
        assert set(found) == {f"l{k}" for k in range(n)}
        assert all(abs(found[f"l{k}"] - size / sum(sizes)) < 0.03 for k, size in enumerate(sizes))
