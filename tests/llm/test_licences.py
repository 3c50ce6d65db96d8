import re

from cases import LONG, documents

from tidemark.llm import licences

MIT = """Copyright (c) 2021 A. Person

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal in the Software without restriction.

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED.
"""
BSD = """ * Redistribution and use in source and binary forms, with or without
 * modification, are permitted provided that the following conditions are met:
 *
 * 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
 * 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation.
"""
TEXTS = {
    MIT: ("copyright,mit-permission,mit-notice,mit-as-is", ["MIT"], "copyright"),
    BSD: ("bsd-permission,bsd-source,bsd-binary", ["BSD-2-Clause"], ""),
    BSD + " * 3. Neither the name of X may be used to endorse or promote products derived from this software at all.": (
        "bsd-permission,bsd-source,bsd-binary,bsd-name",
        ["BSD-3-Clause"],
        "",
    ),
    "Text before. Licensed under the Apache License, Version 2.0.\nText after": ("apache-2.0-name", ["Apache-2.0"], ""),
    "This work is licensed under the GNU General Public License, version 3. Released under the MIT License. Released under the MIT Licence!": (
        "gpl-3-name,mit-name,mit-name",
        ["MIT", "GPL-3.0"],
        "",
    ),
    "x\n// SPDX-License-Identifier: MIT\ncode follows here": ("spdx-mit", ["MIT"], ""),
    "SPDX-License-Identifier: WTFPL": ("spdx-other", [], "spdx-other"),
    "Licensed under CC BY-NC 4.0.\nwords": ("cc-by-nc-name", ["CC-BY-NC"], ""),
    "Copyright 2020 Me. All rights reserved.": ("copyright,reserved", ["all-rights-reserved"], ""),
    "My license to drive. The warranty is void.": ("", [], ""),
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.": ("mit-notice", [], "mit-notice"),
    LONG + ". Released under the MIT License. " + LONG: ("mit-name", ["MIT"], ""),
    "": ("", [], ""),
}


def test_texts(spark):
    rows = [(i, t, None, None) for i, t in enumerate(TEXTS)] + [(99, None, None, None), (2, list(TEXTS)[2], None, None)]
    df = documents(spark, rows)
    got = licences.scan(df)
    assert got.columns == [*df.columns, "licences"]
    found = got.collect()
    assert len(found) == len(rows)
    for r in found:
        ids, names, rest = r["licences"]
        assert (ids, list(names), rest) == (TEXTS[r["text"]] if r["text"] is not None else ("", [], ""))
    assert licences.scan(documents(spark, [])).count() == 0


def test_sql_states_the_rule_of_the_operator(spark):
    """Also for sentences without a telling word, and for licences that stand side by side or around others."""
    import duckdb

    mit, gpl, cc = "This project is released under the MIT License. ", "This project is released under the GPL v3. ", "This work is released under CC BY 4.0. "
    texts = [*TEXTS, gpl, gpl + gpl, mit + gpl + mit, cc + mit + mit + cc, mit + cc + gpl + "All\nrights reserved. " + gpl, "Nothing here.", "", None]
    rows = [(i, t, None, None) for i, t in enumerate(texts)]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [r[:2] for r in rows])
    theirs = {r[0]: r[1:] for r in con.execute(f"SELECT doc_id, sentence_ids, licences, rest FROM ({licences.scan_sql()})").fetchall()}
    found = licences.scan(documents(spark, rows)).collect()
    assert {r["doc_id"]: (r["licences"]["ids"], ",".join(r["licences"]["names"]), r["licences"]["rest"]) for r in found} == theirs
    assert sum(bool(r["licences"]["names"]) for r in found) > 5


def test_sentences_without_a_telling_word(spark):
    """Known sentences count whatever their words, and wherever their lines end."""
    texts = {
        "This project is released under the GPL v3.": ("gpl-3-name", ["GPL-3.0"]),
        "Distributed under the terms of the GNU GPL version 2 or later.": ("gpl-2-name", ["GPL-2.0"]),
        "This work is released under CC BY 4.0.": ("cc-by-name", ["CC-BY"]),
        "This work is available under CC BY-SA 4.0.": ("cc-by-sa-name", ["CC-BY-SA"]),
        "This work is published under Creative Commons Zero 1.0.": ("public-domain", ["public-domain"]),
        "Released into the public\ndomain.": ("public-domain", ["public-domain"]),
        "All\nrights reserved": ("reserved", ["all-rights-reserved"]),
    }
    df = documents(spark, [(i, t, None, None) for i, t in enumerate(texts)])
    for r in licences.scan(df).collect():
        assert (r["licences"]["ids"], list(r["licences"]["names"])) == texts[r["text"]] and r["licences"]["rest"] == ""


def test_every_alternative_of_every_sentence_is_found(spark):
    """One text for each way a pattern can be read."""
    from itertools import product
    from re import _parser as parser

    def readings(parsed):
        parts = []
        for op, value in parsed:
            op = str(op)
            if op == "LITERAL":
                parts.append([chr(value)])
            elif op == "ANY":
                parts.append(["x"])
            elif op == "IN":
                parts.append([chr(value[0][1] if str(value[0][0]) == "LITERAL" else value[0][1][0] + 2)])
            elif op == "SUBPATTERN":
                parts.append(readings(value[3]))
            elif op == "BRANCH":
                parts.append([r for branch in value[1] for r in readings(branch)])
            else:
                low, high, inner = value
                parts.append([r * max(low, 1) for r in readings(inner)] + ([""] if low == 0 else []))
        return ["".join(p) for p in product(*parts)]

    rows = []
    for name, pattern in licences.SENTENCES:
        found = sorted(set(readings(parser.parse(pattern))))
        assert all(re.fullmatch(pattern, f) for f in found)
        rows += [(len(rows) + i, f.replace(" ", "\n" if i % 2 else " "), name, None) for i, f in enumerate(found[:: max(1, len(found) // 300)])]
    df = documents(spark, rows, extra=False)
    got = licences.scan(df).select("text", "lang", "licences.ids").collect()
    # A reading may be cut where it looks like a list mark; what is whole is found.
    whole = {tuple(r) for r in df.select("text", licences.F.array_join(licences.F.transform(licences.sentences(licences.F.col("text")), licences.sentence_id), ",")).collect()}
    assert {(r["text"], r["ids"]) for r in got} == whole
    assert sum(r["ids"] != "" for r in got) >= 0.99 * len(rows)


def test_a_licence_given_twice_leaves_no_rest(spark):
    df = documents(spark, [(1, BSD + "\n" + BSD, None, None)])
    row = licences.scan(df).first()["licences"]
    assert list(row["names"]) == ["BSD-2-Clause"] and row["rest"] == "" and row["ids"].count("bsd-permission") == 2


def _beginnings(items):
    """Every way a parsed pattern can begin, up to the first blank."""
    out = {""}
    for op, value in items:
        name, ways = str(op), {"?"}
        if name == "LITERAL":
            ways = {chr(value)}
        elif name == "SUBPATTERN":
            ways = _beginnings(value[3])
        elif name == "BRANCH":
            ways = {w for branch in value[1] for w in _beginnings(branch)}
        elif name == "MAX_REPEAT":
            ways = _beginnings(value[2]) | ({""} if value[0] == 0 else set())
        out = {h for h in out if " " in h} | {h + w for h in out if " " not in h for w in ways}
    return out


def test_openings_are_those_of_the_sentences():
    import re

    found = {b.split(" ")[0] for name, p in licences.SENTENCES if name != "reserved" for b in _beginnings(re._parser.parse(p))}
    assert found == set(licences.OPENINGS)
    assert dict(licences.SENTENCES)["reserved"].endswith(licences.ENDING)
