"""Licence scans by sentence rules: DataFrame and SQL functions only."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What licence texts and notices say. A sentence is compared in its normal form, whole.
_UNDER = r"(this (work|file|code|program|project|software|document|library) is |is )?(released|licensed|distributed|available|provided|published) under (the )?(terms of )?(the )?"
_CC = r"(a |the )?(cc|creative commons) (by|attribution)"
_V = r"( version| v)? ?[0-9.]+( international| unported)?( licen[sc]e)?"
SENTENCES: list[tuple[str, str]] = [
    ("spdx-mit", r"spdx license identifier mit"),
    ("spdx-apache-2.0", r"spdx license identifier apache 2.0"),
    ("spdx-bsd-2", r"spdx license identifier bsd 2 clause"),
    ("spdx-bsd-3", r"spdx license identifier bsd 3 clause"),
    ("spdx-gpl-2", r"spdx license identifier gpl 2.0( only| or later|\+)?"),
    ("spdx-gpl-3", r"spdx license identifier gpl 3.0( only| or later|\+)?"),
    ("spdx-mpl-2.0", r"spdx license identifier mpl 2.0"),
    ("spdx-other", r"spdx license identifier .+"),
    ("apache-grant", r"licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license"),
    ("apache-copy", r"you may obtain a copy of the license at .+"),
    ("apache-basis", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis .+"),
    ("apache-see", r"see the license for the specific language governing permissions and limitations under the license"),
    ("mit-permission", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files .+"),
    ("mit-notice", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit-as-is", r"the software is provided as is without warranty of any kind .+"),
    ("mit-liability", r"in no event shall the authors or copyright holders be liable for any claim .+"),
    ("bsd-permission", r"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met.*"),
    ("bsd-source", r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer.*"),
    ("bsd-binary", r"redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer .+"),
    ("bsd-name", r"neither the name of .+ may be used to endorse or promote products derived from this software .+"),
    ("bsd-as-is", r"this software is provided by the (copyright holders|regents|author).* as is and .+"),
    ("gpl-2-grant", r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 .+"),
    ("gpl-3-grant", r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 .+"),
    ("gpl-hope", r"this program is distributed in the hope that it will be useful but without any warranty .+"),
    ("gpl-see", r"see the gnu general public license for more details"),
    ("gpl-copy", r"you should have received a copy of the gnu general public license .+"),
    ("mit-name", _UNDER + r"mit licen[sc]e"),
    ("apache-2.0-name", _UNDER + r"apache licen[sc]e( version| v)? ?2(.0)?"),
    ("lgpl-name", _UNDER + r"gnu lesser general public licen[sc]e.*"),
    ("agpl-name", _UNDER + r"gnu affero general public licen[sc]e.*"),
    ("gpl-3-name", _UNDER + r"(gnu general public licen[sc]e|gnu gpl|gpl)( version| v)? ?3(.0)?( or (any )?later( version)?)?"),
    ("gpl-2-name", _UNDER + r"(gnu general public licen[sc]e|gnu gpl|gpl)( version| v)? ?2(.0)?( or (any )?later( version)?)?"),
    ("mpl-2.0-name", _UNDER + r"mozilla public licen[sc]e( version| v)? ?2(.0)?"),
    ("bsd-3-name", _UNDER + r"(3 clause bsd|bsd 3 clause|new bsd|modified bsd) licen[sc]e"),
    ("bsd-2-name", _UNDER + r"(2 clause bsd|bsd 2 clause|simplified bsd) licen[sc]e"),
    ("cc-by-nc-sa-name", _UNDER + _CC + r" (nc|noncommercial) (sa|sharealike)" + _V),
    ("cc-by-nc-nd-name", _UNDER + _CC + r" (nc|noncommercial) (nd|noderivatives)" + _V),
    ("cc-by-nc-name", _UNDER + _CC + r" (nc|noncommercial)" + _V),
    ("cc-by-sa-name", _UNDER + _CC + r" (sa|sharealike)" + _V),
    ("cc-by-nd-name", _UNDER + _CC + r" (nd|noderivatives)" + _V),
    ("cc-by-name", _UNDER + _CC + _V),
    ("public-domain", r"(this (work|file|code|program|software|document) (is|has been) )?(released|placed|dedicated) (in|into|to) the public domain|" + _UNDER + r"(cc0|creative commons zero)( 1.0)?.*"),
    ("reserved", r"(.* )?all rights reserved"),
    ("copyright", r"(copyright|c) (c )?[0-9]{4}.*"),
]

# First words of the sentences above, all followed by a blank; and how a sentence ends that may begin with any word.
OPENINGS = (
    "spdx licensed you unless see permission the in redistribution redistributions neither this is "
    "released distributed available provided published placed dedicated copyright c"
).split()
ENDING = "all rights reserved"

# Ordered rules over sentence identifiers. What a rule takes is gone for those after it.
RULES: list[tuple[str, str]] = [
    ("BSD-3-Clause", ",bsd-permission,bsd-source,bsd-binary,bsd-name,(bsd-as-is,)?"),
    ("BSD-2-Clause", ",bsd-permission,bsd-source,bsd-binary,(bsd-as-is,)?"),
    ("MIT", ",mit-permission,mit-notice,(mit-as-is,)?(mit-liability,)?"),
    ("Apache-2.0", ",apache-grant,(apache-copy,)?(apache-basis,)?(apache-see,)?"),
    ("GPL-3.0-or-later", ",gpl-3-grant,(gpl-hope,)?(gpl-see,)?(gpl-copy,)?"),
    ("GPL-2.0-or-later", ",gpl-2-grant,(gpl-hope,)?(gpl-see,)?(gpl-copy,)?"),
    ("MIT", ",((mit-name|spdx-mit),)+"),
    ("Apache-2.0", ",((apache-2.0-name|spdx-apache-2.0),)+"),
    ("BSD-3-Clause", ",((bsd-3-name|spdx-bsd-3),)+"),
    ("BSD-2-Clause", ",((bsd-2-name|spdx-bsd-2),)+"),
    ("GPL-3.0", ",((gpl-3-name|spdx-gpl-3),)+"),
    ("GPL-2.0", ",((gpl-2-name|spdx-gpl-2),)+"),
    ("LGPL", ",(lgpl-name,)+"),
    ("AGPL", ",(agpl-name,)+"),
    ("MPL-2.0", ",((mpl-2.0-name|spdx-mpl-2.0),)+"),
    ("CC-BY-NC-SA", ",(cc-by-nc-sa-name,)+"),
    ("CC-BY-NC-ND", ",(cc-by-nc-nd-name,)+"),
    ("CC-BY-NC", ",(cc-by-nc-name,)+"),
    ("CC-BY-SA", ",(cc-by-sa-name,)+"),
    ("CC-BY-ND", ",(cc-by-nd-name,)+"),
    ("CC-BY", ",(cc-by-name,)+"),
    ("public-domain", ",(public-domain,)+"),
    ("all-rights-reserved", ",(copyright,)*(reserved,)+"),
]

# A line that names a licence by its identifier is a sentence of its own; others end at . ! ? before white space, or at an empty line.
_IDENTIFIER = r"(?im)^(.*SPDX-License-Identifier:.*)$"
_END = r"[.!?]+[\s]+|\n[ \t]*\n|\n\n"
# What stands before the words of a line in comments and lists.
_MARGIN = r"(?m)^[ \t]*([#*/;%>|-]+[ \t]*|[0-9a-z][.)][ \t]+)+"


def sentences(text: Column) -> Column:
    """The sentences of a text in normal form: lower case, words of letters, digits, ``.`` and ``+`` with one blank between."""
    marked = F.regexp_replace(F.regexp_replace(text, _MARGIN, ""), _IDENTIFIER, "\n\n$1\n\n")
    words = lambda s: F.trim(F.regexp_replace(F.regexp_replace(F.lower(s), r"[^a-z0-9.+]+", " "), r"[. ]+$|^[. ]+", ""))
    return F.filter(F.transform(F.split(marked, _END), words), lambda s: s != "")


def sentence_id(sentence: Column) -> Column:
    """The identifier of the first known sentence this one is; NULL for any other.

    Only sentences that begin or end as a known one does are compared with the patterns.
    """
    known = F.lit(None).cast("string")
    for name, pattern in reversed(SENTENCES):
        known = F.when(sentence.rlike(f"^(?:{pattern})$"), F.lit(name)).otherwise(known)
    return F.when(F.substring_index(sentence, " ", 1).isin(OPENINGS) | sentence.endswith(ENDING), known)


def _by_rules(ids: Column) -> Column:
    """(left, found): the rules in turn, each taking what it matches out of the sequence.

    The comma before a match is looked at, not taken, so that what follows a match at once can be one too.
    """
    rules = F.from_json(
        F.lit("[" + ",".join(f'{{"name":"{n}","pattern":"(?<=,){p[1:]}"}}' for n, p in RULES) + "]"), "array<struct<name: string, pattern: string>>"
    )
    start = F.struct(ids.alias("left"), F.array().cast("array<string>").alias("found"))

    def step(done: Column, rule: Column) -> Column:
        found = F.when(F.regexp_like(done["left"], rule["pattern"]), F.array_union(done["found"], F.array(rule["name"]))).otherwise(done["found"])
        return F.struct(F.regexp_replace(done["left"], rule["pattern"], F.lit("")).alias("left"), found.alias("found"))

    return F.aggregate(rules, start, step)


def scan(df: DataFrame, text: str = "text", out: str = "licences") -> DataFrame:
    """The rows with a struct (ids, names, rest): known licence sentences in order, licences found, sentences no rule took.

    ids and rest are identifiers joined by commas, names the licences in the order of their rules, each once. Texts without a
    known sentence, NULL and empty ones have empty strings and no names. Nothing is shuffled; whole texts are
    cut into sentences, and every sentence is compared. ``out`` replaces a column of that name.
    """
    ids = F.filter(F.transform(sentences(F.col(text)), sentence_id), lambda i: i.isNotNull())
    joined = F.concat(F.lit(","), F.concat_ws(",", ids), F.when(F.size(ids) > 0, ",").otherwise(""))
    result = F.transform(F.array(joined), lambda seq: F.struct(F.trim(seq, F.lit(",")).alias("ids"), F.when(seq == ",", F.lit(None)).otherwise(_by_rules(seq)).alias("taken")))[0]
    none = F.array().cast("array<string>")
    row = F.transform(
        F.array(result),
        lambda r: F.struct(
            r["ids"].alias("ids"),
            F.coalesce(r["taken"]["found"], none).alias("names"),
            F.coalesce(F.trim(r["taken"]["left"], F.lit(",")), F.lit("")).alias("rest"),
        ),
    )[0]
    return df.withColumn(out, row)


def _sql_step(previous: str, index: int, name: str, pattern: str) -> str:
    found = f"CASE WHEN regexp_matches(seq, '{pattern}') AND NOT list_contains(found, '{name}') THEN list_append(found, '{name}') ELSE found END"
    return f"r{index} AS (SELECT doc_id, ids, regexp_replace(seq, '{pattern}', '', 'g') AS seq, {found} AS found FROM {previous})"


def scan_sql() -> str:
    """The same as SQL over ``documents``: (doc_id, sentence_ids, licences, rest).

    Identifiers stand between commas of their own there (``,a,,b,``), as its patterns cannot look at a comma without taking it.
    """
    case = " ".join(f"WHEN regexp_matches(s, '^(?:{p})$') THEN '{n}'" for n, p in SENTENCES)
    marked = f"regexp_replace(regexp_replace(text, '{_MARGIN}', '', 'g'), '{_IDENTIFIER}', '\n\n\\1\n\n', 'g')"
    words = "trim(regexp_replace(regexp_replace(lower(s), '[^a-z0-9.+]+', ' ', 'g'), '[. ]+$|^[. ]+', '', 'g'))"
    steps, previous = [], "named"
    for i, (name, pattern) in enumerate(RULES):
        steps.append(_sql_step(previous, i, name, re.sub(r"(\([^()]*\)|[a-z0-9.-]+),", r",\1,", pattern[1:])))
        previous = f"r{i}"
    return f"""WITH cut AS (SELECT doc_id, list_transform(string_split_regex({marked}, '{_END}'), lambda s: {words}) AS s FROM documents),
named AS (SELECT doc_id, array_to_string(list_filter(list_transform(s, lambda s: CASE {case} END), lambda i: i IS NOT NULL), ',') AS ids, CASE WHEN ids = '' THEN '' ELSE ',' || replace(ids, ',', ',,') || ',' END AS seq, CAST([] AS VARCHAR[]) AS found
          FROM cut),
{", ".join(steps)}
SELECT doc_id, coalesce(ids, '') AS sentence_ids, coalesce(array_to_string(found, ','), '') AS licences, coalesce(trim(replace(seq, ',,', ','), ','), '') AS rest
FROM documents LEFT JOIN (SELECT * FROM {previous} WHERE ids <> '') USING (doc_id)"""


