from datetime import date

from pyspark.sql import functions as F

from tidemark.llm import urllists

DAYS = [date(2023, 12, 30), date(2024, 1, 5), date(2024, 2, 1), date(2024, 3, 1), date(2025, 6, 1)]
ENTRIES = [
    ("block", "Bad.example.com", DAYS[1], "add"),
    ("block", "bad.example.com", DAYS[1], "add"),
    ("block", "bad.example.com", DAYS[2], "add"),
    ("block", "bad.example.com", DAYS[3], "remove"),
    ("block", "bad.example.com", DAYS[4], "add"),
    ("ads", "example.com", DAYS[0], "add"),
    ("ads", "example.com", DAYS[1], "remove"),
    ("ads", "example.com", DAYS[1], "add"),
    ("allow", "bad.example.com/ok", DAYS[2], "add"),
    ("urls", "x.org/a/b", DAYS[0], "add"),
    ("urls", "gone.org", DAYS[0], "remove"),
    (None, "x.org", DAYS[0], "add"),
    ("urls", None, DAYS[0], "add"),
    ("urls", "x.org", None, "add"),
    ("urls", "x.org", DAYS[0], None),
    ("urls", "x.org", DAYS[0], "rename"),
]
URLS = [
    "http://bad.example.com/ok/page?x=1",
    "HTTPS://u@Bad.Example.com:80/no#y",
    "//bad.example.com",
    "http://other.example.com/",
    "http://notexample.com/",
    "http://x.org/a/b/c.html",
    "http://x.org/a/bb",
    "http://gone.org/",
    "no url at all",
    "",
    None,
]


def plain(url, day):
    """One capture judged by replaying all entries up to its day."""
    if url is None or day is None or "//" not in url:
        return False, None, ""
    rest = url.split("//", 1)[1]
    cut = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
    host = rest[:cut].split("@")[-1].split(":")[0].lower()
    path = [p for p in rest[cut:].split("?")[0].split("#")[0].split("/") if p]
    labels = host.split(".")
    names = {".".join(labels[i:]) for i in range(len(labels))} | {"/".join([host, *path[: i + 1]]) for i in range(len(path))}
    active = []
    for name, pattern in {(e[0], e[1].lower()) for e in ENTRIES if e[0] and e[1]}:
        if pattern not in names:
            continue
        on = False
        for d in sorted({e[2] for e in ENTRIES if e[2]}):
            acts = {e[3] for e in ENTRIES if e[0] == name and (e[1] or "").lower() == pattern and e[2] == d} & {"add", "remove"}
            if acts and d <= day:
                on = "remove" not in acts
        if on:
            active.append((len(pattern), name == "allow", pattern, name))
    if not active:
        return False, None, ""
    top = max(active)
    return not top[1], top[2], ",".join(sorted({a[3] for a in active}))


def test_against_replay(spark):
    days = [date(2023, 1, 1), *DAYS, date(2024, 1, 20), date(2026, 1, 1), None]
    rows = [(i * 100 + j, u, d, "mine") for i, u in enumerate(URLS) for j, d in enumerate(days)] + [(0, URLS[0], days[0], "again")]
    captures = spark.createDataFrame(rows, "page_id long, url string, day date, pattern string").withColumns({"list": F.lit(1), "judged_url": F.lit(2)})
    entries = spark.createDataFrame(ENTRIES, "list string, pattern string, day date, action string")
    got = urllists.judged(captures, entries)
    assert got.columns == [*captures.columns, "verdict"]
    found = got.collect()
    assert len(found) == len(rows)
    for r in found:
        assert tuple(r["verdict"]) == plain(r["url"], r["day"]), (r["url"], r["day"])


def test_empty(spark):
    captures = spark.createDataFrame([], "page_id long, url string, day date")
    entries = spark.createDataFrame([], "list string, pattern string, day date, action string")
    assert urllists.judged(captures, entries).count() == 0
    one = spark.createDataFrame([(1, "http://a.b/", date(2024, 1, 1))], "page_id long, url string, day date")
    assert urllists.judged(one, entries).first()["verdict"]["blocked"] is False


def test_paths_keep_their_capitals(spark):
    day = date(2024, 1, 1)
    entries = spark.createDataFrame([("block", "H.example/Bad", day, "add"), ("allow", "h.Example/Bad/But/Good", day, "add")], "list string, pattern string, day date, action string")
    urls = ["http://H.example/Bad/x", "http://h.example/Bad/But/Good/y", "http://h.example/bad/x"]
    captures = spark.createDataFrame([(i, u, day) for i, u in enumerate(urls)], "page_id long, url string, day date")
    got = {r["page_id"]: tuple(r["verdict"]) for r in urllists.judged(captures, entries).collect()}
    assert got == {0: (True, "h.example/Bad", "block"), 1: (False, "h.example/Bad/But/Good", "allow,block"), 2: (False, None, "")}
