import itertools
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from cases import LONG, documents
from tidemark.llm import queries, toxicity

SF = "/root/testdata/sf0.01"


def brute(scores, turns):
    """Marginals by summing over all paths."""
    total, toxic = 0.0, np.zeros(len(scores))
    for path in itertools.product((0, 1), repeat=len(scores)):
        weight = np.exp(sum(s for s, y in zip(scores, path) if y)) * np.prod([turns[a, b] for a, b in zip(path, path[1:])])
        total += weight
        toxic += weight * np.array(path)
    return toxic / total


def test_marginals_are_sums_over_paths():
    draw = np.random.default_rng(2)
    lengths = [1, 9, 3, 1, 7, 10]
    scores, turns = draw.normal(size=sum(lengths)) * 3, np.array([[1.0, 0.2], [0.4, 3.0]])
    first = np.zeros(len(scores), bool)
    first[np.cumsum([0, *lengths[:-1]])] = True
    found, ahead, behind = toxicity.forward_backward(scores, first, turns)
    expected = np.concatenate([brute(part, turns) for part in np.split(scores, np.flatnonzero(first)[1:])])
    assert np.allclose(found, expected, atol=1e-12)
    pairs = toxicity._turn_shares(scores, first, turns, ahead, behind)
    assert pairs.sum() == pytest.approx(sum(n - 1 for n in lengths))
    assert pairs[1].sum() == pytest.approx(sum(p[:-1].sum() for p in np.split(found, np.flatnonzero(first)[1:])))


def test_strong_scores_stay_finite():
    scores = np.tile([500.0, -500.0, 0.0], 40_000)
    found = toxicity.forward_backward(scores, np.arange(len(scores)) == 0, np.array([[1.0, 1e-8], [1e-8, 1.0]]))[0]
    assert np.isfinite(found).all() and found.min() >= 0 and found.max() <= 1


@pytest.fixture(scope="module")
def found(spark):
    rows = queries.QUERIES["op11_crf_spans"](spark, SF).collect()
    return {r["doc_id"]: r for r in rows}, len(rows)


def test_held_out_documents(spark, found):
    rows, n = found
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert n == len(rows) == len(docs)
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = [(rows[i], y) for i, y in labels.items() if rows[i]["held_out"]]
    right = sum(r["predicted"] == y for r, y in held)
    assert right / len(held) > 0.9
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows.values())
    spans = {docs[i][s["start"] : s["stop"]].lower() for i, r in rows.items() if r["held_out"] and r["predicted"] for s in json.loads(r["spans"])}
    assert {"idiot", "moron", "stupid"} <= {w for s in spans for w in s.split()}


def labelled(spark):
    words = "the of and to in is it that was for on with as be at by this from or an".split()
    draw = np.random.default_rng(5)
    rows, labels = [], []
    for i in range(160):
        text = [str(w) for w in draw.choice(words, 40)]
        if i % 4 == 0:
            for at in draw.integers(0, 39, 5):
                text[int(at)] = str(draw.choice(["grumbol", "grumbat", "Grumbix!"]))
        rows.append((i, " ".join(text), None, None))
        labels.append((i, int(i % 4 == 0)))
    return rows, labels


def test_shared_beginnings_and_spans(spark):
    rows, labels = labelled(spark)
    model = toxicity.fit(documents(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    texts = [(1, "this is for the grumbunk, and grumbol grumbat of it", None, None), (2, "this is for the grammar of it", None, None)]
    one, two = toxicity.tagged(documents(spark, texts), model).orderBy("doc_id").collect()
    assert [texts[0][1][s["start"] : s["stop"]] for s in one["toxicity"]["spans"]] == ["grumbunk", "grumbol grumbat"]
    assert one["toxicity"]["score"] > 0.5 > two["toxicity"]["score"] and two["toxicity"]["spans"] == []


def test_odd_rows(spark, monkeypatch):
    rows, labels = labelled(spark)
    odd = [(None, 1), (3, None), (1, 0), (1, 0), (777, 1), (5, 3)]
    model = toxicity.fit(documents(spark, rows + rows[:5]), spark.createDataFrame(labels + odd, "doc_id long, toxic int"))
    docs = documents(spark).withColumn("toxicity", F.lit(1)).withColumn("toxic", F.lit("x")).withColumn("score", F.lit(2))
    whole = toxicity.tagged(docs, model)
    assert whole.columns == docs.columns
    first = [(r["doc_id"], r["toxicity"]) for r in whole.collect()]
    assert len(first) == docs.count()
    by_text = {}
    for r in whole.collect():
        assert by_text.setdefault(r["text"], r["toxicity"]) == r["toxicity"] and 0 <= r["toxicity"]["score"] <= 1
    assert by_text[None] == by_text[""] == by_text[" \n\t "] and by_text[LONG]["n_tokens"] == 120_000
    assert toxicity.tagged(docs.where("false"), model).collect() == []
    # How texts are put together, and what a task forgets, changes nothing; where a chain is cut only its ends can.
    monkeypatch.setattr(toxicity, "KNOWN_WORDS", 20)
    monkeypatch.setattr(toxicity, "CHAIN", 200_000)
    tagger = toxicity.Tagger(model)
    texts = [r["text"] or "" for r in docs.orderBy("doc_id").collect()]
    together, alone = tagger.marginals(texts), [toxicity.Tagger(model).marginals([t])[0] for t in texts]
    assert all(len(a) == len(b) and all(np.allclose(x, y) for x, y in zip(a, b)) for a, b in zip(together, alone))
    monkeypatch.setattr(toxicity, "CHAIN", 1000)
    cut = toxicity.Tagger(model).marginals(texts)
    assert [sum(len(p) for p in parts) for parts in cut] == [sum(len(p) for p in parts) for parts in alone]


def test_pieces_cover_the_text(monkeypatch):
    text = "ab, cd  ef-gh  " * 50 + "x" * 80 + " end"
    whole = [w for _, words in toxicity.tokens(text) for w in words]
    monkeypatch.setattr(toxicity, "PIECE", 7)
    assert [w for _, words in toxicity.tokens(text) for w in words] == whole


@pytest.mark.parametrize("labels, score", [([], 0.0), ([(1, 1), (2, 1)], 1.0), ([(1, 0), (2, None)], 0.0), ([(4, 1), (5, 0)], None)])
def test_one_class_or_no_words(spark, labels, score):
    docs = documents(spark)
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    scores = {r["toxicity"]["score"] for r in toxicity.tagged(docs, model).collect()}
    assert len(scores) == 1 and (score is None or scores.pop() == pytest.approx(score, abs=1e-6))
