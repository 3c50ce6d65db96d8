"""Small tables with everything that may go wrong, and plain versions to compare with."""

from __future__ import annotations

LONG = " ".join(f"w{i % 977} x{i % 13}" for i in range(60_000))

# doc_id, text, lang, source: NULLs in every column, empty and blank texts, ties, repeated rows, a very long text.
ROWS = [
    (1, "the cat sat on the mat and looked at the moon for a long while", "en", "a"),
    (2, "the cat sat on the mat and looked at the moon for a long while", "en", "a"),
    (2, "the cat sat on the mat and looked at the moon for a long while", "en", "a"),
    (3, "The CAT sat\ton the mat and looked  at the moon for a long while", "en", None),
    (4, None, "en", "b"),
    (5, "", None, "b"),
    (6, " \n\t ", "fr", "c"),
    (7, "one", "fr", None),
    (8, "Été à la plage, où l'on mange des glaces; naïve façade", "fr", "c"),
    (None, "no id but words enough to count as text", None, None),
    (9, LONG, "en", "a"),
    (10, LONG + " tail", "en", "d"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


def documents(spark, rows=None, extra: bool = True):
    df = spark.createDataFrame(ROWS if rows is None else rows, SCHEMA)
    if extra:  # names that operators use themselves
        for i, name in enumerate(("node", "key", "size", "id", "n", "bits", "root", "row", "item_id", "mix_target", "mix_name", "shard_range", "repeats_at")):
            df = df.selectExpr("*", f"{i} AS {name}")
    return df


def blank(value):
    return {"text": None, "doc_id": None, "lang": None, "source": None}.get(value)
