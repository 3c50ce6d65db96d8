import random
import re

from cases import documents

from tidemark.llm import decontaminate


def plain(text, items, window=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    words, hit, ids = split(text), set(), set()
    for item, item_text in items:
        w = split(item_text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            for j in range(len(words) - n + 1):
                if words[j : j + n] == w[i : i + n]:
                    hit |= set(range(j, j + n))
                    ids |= {str(item)} if item is not None else set()
    return len(words), len(hit), sorted(ids)


def compare(spark, docs, items, **options):
    df = documents(spark, docs)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find_passages(df, benchmark, **options).select("doc_id", "text", "found.n_words", decontaminate.n_hit(decontaminate.F.col("found")).alias("h"), "found.items").collect()
    for r in got:
        assert (r["n_words"], r["h"], list(r["items"])) == plain(r["text"], items), r["doc_id"]
    assert len(got) == len(docs)


def test_against_plain_search(spark):
    draw = random.Random(1)
    word = lambda: draw.choice(["aa", "ab", "ba", "é", "b1"])
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(i, text(draw.choice([12, 15, 10, 11]))) for i in range(12)] + [(50, "aa ab\nBA."), (51, None), (52, "..."), (None, text(11)), (7, text(14)), (1000, text(10))]
    docs = [(i, text(draw.randrange(0, 300)), None, None) for i in range(25)]
    docs += [(100 + i, f"{text(9)}, {(t or '').upper()} -- {text(5)}", "en", "a") for i, (_, t) in enumerate(items)]
    docs += [(200, None, None, None), (201, "", None, None), (202, " .\n", None, None), (202, " .\n", None, None), (None, items[0][1], None, None)]
    compare(spark, docs, items)
    compare(spark, docs, items, table_windows=8)


def test_single_words_and_no_items(spark):
    docs = [(1, "moon over the moon", None, None), (2, None, None, None)]
    compare(spark, docs, [(5, "MOON"), (6, "over the")])
    compare(spark, docs, [])
    compare(spark, [], [(5, "moon")])


def test_clean_keeps_columns_and_clean_rows(spark):
    item = "one two three four five six seven eight nine ten eleven"
    df = documents(spark, [(1, f"so {item} it", "en", "a"), (2, "one two three four five six seven eight nine", "en", "a"), (3, None, None, None)])
    kept = decontaminate.clean(df, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 3]
