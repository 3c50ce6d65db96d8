"""URL filters: dated list entries as validity intervals, captures judged by those active at fetch time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.text import free_name

# Scheme, user and port are no part of what lists name.
_HOST = r"(?i)^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)"
_PATH = r"(?i)^(?:[a-z][a-z0-9+.-]*:)?//[^/?#]*(/[^?#]*)"


def host(url: Column) -> Column:
    """Lower-case host without a final dot; empty if there is none."""
    return F.regexp_replace(F.lower(F.coalesce(F.regexp_extract(url, _HOST, 1), F.lit(""))), r"\.+$", "")


def patterns(url: Column) -> Column:
    """Every pattern a list could name the URL by: its host, the domains above it, and its host with each folder of its path.

    One per label of the host and per folder of the path, whatever their number.
    """
    labels = F.split(host(url), r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    path = F.coalesce(F.regexp_extract(url, _PATH, 1), F.lit(""))
    folders = F.filter(F.split(path, "/"), lambda p: p != "")
    prefixes = F.transform(
        F.when(F.size(folders) > 0, F.sequence(F.lit(1), F.size(folders))).otherwise(F.array().cast("array<int>")),
        lambda i: F.concat(host(url), F.lit("/"), F.array_join(F.slice(folders, F.lit(1), i), "/")),
    )
    return F.when(host(url) == "", F.array().cast("array<string>")).otherwise(F.array_union(domains, prefixes))


def validity(entries: DataFrame, list_column: str = "list", pattern: str = "pattern", day: str = "day", action: str = "action") -> DataFrame:
    """(list, pattern, valid_from, valid_to): when each pattern was on each list; valid_to is the first day it is not, NULL if still.

    Entries are dated ``add`` or ``remove``. Of several on one day a removal counts. Adding what is on the list or
    removing what is not changes nothing. The host of a pattern is lower-cased, its path is not. Entries with a NULL or another action are left out. A list names a
    pattern at most once a day after the first step, so that the calendar bounds what is put in order per pattern.
    """
    named = F.substring_index(F.col(pattern), "/", 1)
    folded = F.concat(F.lower(named), F.col(pattern).substr(F.length(named) + 1, F.length(pattern)))
    c = {"list": F.col(list_column), "pattern": folded, "day": F.col(day).cast("date")}
    known = entries.where(F.col(action).isin("add", "remove"))
    for column in c.values():
        known = known.where(column.isNotNull())
    daily = known.groupBy(*[v.alias(k) for k, v in c.items()]).agg(F.max(F.when(F.col(action) == "remove", 1).otherwise(0)).alias("gone"))
    order = Window.partitionBy("list", "pattern").orderBy("day")
    changes = daily.withColumn("before", F.lag("gone", 1, 1).over(order)).where("gone != before")
    return changes.withColumn("valid_to", F.lead("day").over(order)).where("gone = 0").select("list", "pattern", F.col("day").alias("valid_from"), "valid_to")


def matches(captures: DataFrame, intervals: DataFrame, url: str = "url", day: str = "day") -> DataFrame:
    """(url, day, list, pattern) for every different capture and every entry active on its day.

    As-of join on (pattern, year): an interval stands in each year it touches up to the last capture's, so a capture meets only
    entries of its year, of which a pattern has no more than the calendar allows. Captures are made different first;
    Spark splits keys that many of them share.
    """
    unique = captures.select(F.col(url).alias("url"), F.col(day).cast("date").alias("day")).where("url is not null and day is not null").distinct()
    years = captures.agg(F.min(F.year(day)), F.max(F.year(day))).first()
    first, last = (F.lit(y if y is not None else 0) for y in years)
    open_end = F.coalesce(F.year(F.date_sub("valid_to", 1)), last)
    lived = intervals.withColumns({"from_year": F.greatest(F.year("valid_from"), first), "to_year": F.least(open_end, last)}).where("from_year <= to_year")
    lived = lived.select("list", F.col("pattern").alias("entry"), "valid_from", "valid_to", F.explode(F.sequence("from_year", "to_year")).alias("in_year"))
    asked = unique.select("url", "day", F.explode(patterns(F.col("url"))).alias("pattern"))
    active = (F.col("pattern") == F.col("entry")) & (F.year("day") == F.col("in_year")) & (F.col("day") >= F.col("valid_from")) & (F.col("day") < F.coalesce("valid_to", F.lit("9999-12-31").cast("date")))
    return asked.join(lived, active).select("url", "day", "list", "pattern")


def judged(captures: DataFrame, entries: DataFrame, allow: str = "allow", url: str = "url", day: str = "day", out: str = "verdict", **columns) -> DataFrame:
    """The captures with a struct (blocked, pattern, lists).

    The longest active pattern decides; on the list ``allow`` it lets the capture pass, also against others of its length;
    on any other it blocks. lists: all lists with an active entry, sorted and joined by commas. Nothing active:
    not blocked, pattern NULL, lists empty; the same for NULL, hostless or undated URLs. Repeated captures stay repeated and
    get the same. ``out`` replaces a column of that name; other columns are carried along.
    """
    found = matches(captures, validity(entries, **columns), url, day)
    rank = F.struct(F.length("pattern"), (F.col("list") == allow).cast("int"), F.col("pattern"))
    verdicts = found.groupBy("url", "day").agg(
        F.max_by(F.struct((F.col("list") != allow).alias("blocked"), F.col("pattern")), rank).alias("top"), F.array_join(F.array_sort(F.collect_set("list")), ",").alias("lists")
    )
    names = [free_name(captures, n) for n in ("judged_url", "judged_day", "judged_top", "judged_lists")]
    verdicts = verdicts.toDF(*names)
    same = (F.col(url) == F.col(names[0])) & (F.col(day).cast("date") == F.col(names[1]))
    verdict = F.struct(
        F.coalesce(F.col(names[2])["blocked"], F.lit(False)).alias("blocked"), F.col(names[2])["pattern"].alias("pattern"), F.coalesce(F.col(names[3]), F.lit("")).alias("lists")
    )
    return captures.join(verdicts, same, "left").withColumn(out, verdict).drop(*names)
