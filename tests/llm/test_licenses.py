import random
import re
from itertools import product
from re import _parser as parser

from cartulary.llm import licenses


def brute(text, rules):
    """The same rules with Python's own regular expressions and all pairs of detections."""
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    line = f" {' '.join(words)} "
    found = []
    for r in rules:
        for m in re.finditer(f"(?<= ){r.pattern}(?= )", line):
            start = line[: m.start()].count(" ") - 1
            found.append((start, -(start + m[0].count(" ") + 1), r.priority, r.label, r.weight, r.base))
    found.sort()
    stay = []
    for d in found:
        if not any(e[0] <= d[0] and e[1] <= d[1] and e[2] <= d[2] for e in stay):
            stay.append(d)
    base = [d for d in found if d[5]]
    score = 1.0
    for d in stay:
        score *= 1 - d[4]
    names = lambda x: ",".join(sorted(x))
    return len(words), len(base), min((d[0] for d in base), default=None), max((d[0] for d in base), default=None), names({d[3] for d in base}), names({d[3] for d in base} | {d[3] for d in stay}), round(1 - score, 9)


def base_places(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return [(k, p) for k in range(len(words)) for p in licenses.BASE_PHRASES if words[k : k + len(p.split())] == p.split()]


def odd_texts():
    rng = random.Random(12)
    bits = ["Released under the MIT License.", "Licensed under the Apache License, Version 2.0", "CC BY-NC", "cc by nc cc-by-nc", "CC-BY-NC-SA 4.0", "GNU General Public License, version 3", "mit", "Mit dem", "license", "All rights reserved.", "SPDX-License-Identifier: GPL-2.0-only", "é", "ÉÀ", "Copyright (c) 2021 X", "Permission is hereby granted, free of charge, to any person obtaining a copy", "under", "the", "version 2", "BSD 3-clause license", "creative commons attribution non-commercial share alike"]
    return [None, "", " ", "--", "x" * 50, "under the mit license " * 900, *(" ".join(rng.choice(bits) for _ in range(rng.randrange(1, 14))) for _ in range(250))]


def rows_of(df):
    return sorted(((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9)) for r in df.collect()), key=str)


def test_rules_are_hundreds_and_gated():
    rules = licenses.rules()
    assert len(rules) > 350 and len(licenses.NOTICES) > 80 and {r.priority for r in rules} == set(range(licenses.PRIORITIES))
    assert all(any(a in r.keyword for a in licenses.ANCHORS) for r in rules)


def test_against_brute_force(spark):
    rules = licenses.rules()
    rows = [(k if k % 8 else None, t, 1) for k, t in enumerate(odd_texts())] + [(5, "MIT License", 1)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words int")
    want = sorted(((i is None, i or 0, *brute(t, rules)) for i, t, _ in rows), key=str)
    assert rows_of(licenses.scanned(df)) == want
    for _, t, _ in rows:
        at = base_places(t)
        assert brute(t, rules)[1:4] == (len(at), min((k for k, _ in at), default=None), max((k for k, _ in at), default=None))
    assert licenses.scanned(df.limit(0)).count() == 0


def test_suppression():
    rules = licenses.rules()
    assert brute("distributed under the terms of the GNU General Public License version 3", rules)[5] == "gpl-3"
    assert brute("licensed under CC BY-NC-SA 4.0", rules)[5] == "cc-by-nc,cc-by-nc-sa"
    assert brute("with mit dem Hut", rules)[5:] == ("", 0.0)


def test_query(spark, small):
    rules = licenses.rules()
    out = licenses.op2(spark, small.dir)
    assert not re.search("Python|Arrow|Pandas|Exchange", out._jdf.queryExecution().executedPlan().toString())
    assert rows_of(out) == sorted(((False, r.doc_id, *brute(r.text, rules)) for r in small("documents").collect()), key=str)


NOTICES = {
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above notice appears in all copies.",
    "bsd-3": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted",
    "boost-1": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software",
    "zlib": "Permission is granted to anyone to use this software for any purpose, including commercial applications",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms",
    "lgpl": "This library is free software; you can redistribute it and/or modify it under the terms",
    "apache-2": "you may not use this file except in compliance with the License.",
    "mpl-2": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


def test_notices_pass_their_gates(spark):
    rows = list(enumerate(NOTICES.items()))
    df = spark.createDataFrame([(k, text) for k, (_, text) in rows], "doc_id long, text string")
    got = {r.doc_id: r.labels.split(",") for r in licenses.scanned(df).collect()}
    for k, (label, text) in rows:
        assert label in got[k], (label, got[k])
        words = f" {' '.join(re.findall(r'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+', text.lower()))} "
        for r in licenses.rules():
            assert not re.search(f"(?<= ){r.pattern}(?= )", words) or r.keyword in words, r


def ways(tree):
    """Texts that a parsed pattern matches: every alternative, what may be missing both there and not, repeats at their least."""
    out = [""]
    for kind, value in tree:
        name = str(kind)
        if name == "LITERAL":
            some = [chr(value)]
        elif name == "NOT_LITERAL":
            some = ["x"]
        elif name == "IN":
            some = [chr(v if str(k) == "LITERAL" else v[0]) for k, v in value] if str(value[0][0]) != "NEGATE" else ["x"]
        elif name == "BRANCH":
            some = [w for t in value[1] for w in ways(t)]
        elif name == "SUBPATTERN":
            some = ways(value[3])
        else:
            assert name in ("MAX_REPEAT", "MIN_REPEAT"), name
            low, high, inner = value
            some = [w * low for w in ways(inner)] + (ways(inner) if low == 0 else [])
        out = [a + b for a, b in product(out, sorted(set(some)))]
    return out


def test_every_alternative_passes_its_keyword_and_an_anchor():
    for r in licenses.rules():
        for w in ways(parser.parse(r.pattern)):
            assert r.keyword in f" {w} ", (r, w)
            assert any(a in f" {w} " for a in licenses.ANCHORS), (r, w)


def test_a_very_long_text(spark):
    text = "word " * 60_000 + "released under the MIT X11 license"
    r = licenses.scanned(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert r.n_words == 60_006 and "mit" in r.labels.split(",")
