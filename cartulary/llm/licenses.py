"""License scans by ordered signature rules, in Spark SQL functions alone.

A text is lower-cased (A-Z) and cut into words; rules are regular expressions over
the words, one space apart.  A text goes through three gates: a few anchors, then
each rule's literal keyword, then its regular expression.  A detection is a run of
words with its rule's label, weight and priority (0 is best).  One that lies in
another of the same or a better priority is suppressed: detections are sorted by
start, longest first, then priority, so one fold that remembers how far each
priority reaches decides all of them in linear time.  Everything is computed in
the row of its document, without a shuffle.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A text without any of these has no detection; every rule's keyword holds one.
ANCHORS = ("licen", "copyright", "spdx", "gpl", " cc by ", " cc0 ", "creative commons", "public domain", "permission is", "permission to", "written permission", "copy modify and or distribute", "permission notice", "redistribution", "shall not be used in advertising", "all advertising materials", "may not be called apache", "warranties", "rights reserved", "free software", "warranty")
PRIORITIES = 4


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    weight: float
    keyword: str
    pattern: str
    base: bool = False


#: The base phrases.
BASE_PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Licenses by label: (keyword that every mention holds, what its name looks like as words).
NAMES = {
    "mit": [("mit licen", r"mit licen[cs]e"), ("mit x11 licen", r"mit x11 licen[cs]e"), ("expat licen", r"expat licen[cs]e")],
    "x11": [("x11 licen", r"x11 licen[cs]e")],
    "apache-2": [("apache licen", r"apache licen[cs]e(?: version)? (?:2|v2)(?: 0)?"), ("apache 2 0 licen", r"apache 2 0 licen[cs]e")],
    "apache-1.1": [("apache software licen", r"apache software licen[cs]e(?: version)? 1 1")],
    "gpl-2": [("general public licen", r"(?:gnu )?general public licen[cs]e(?: version)? (?:2|v2)(?: 0)?"), ("gpl", r"(?:gnu )?gpl ?(?:version )?v?2(?: 0)?")],
    "gpl-3": [("general public licen", r"(?:gnu )?general public licen[cs]e(?: version)? (?:3|v3)(?: 0)?"), ("gpl", r"(?:gnu )?gpl ?(?:version )?v?3(?: 0)?")],
    "gpl": [("general public licen", r"(?:gnu )?general public licen[cs]e"), ("gpl", r"gnu gpl")],
    "lgpl-2.1": [("lesser general public licen", r"(?:gnu )?lesser general public licen[cs]e(?: version)? v?2 1"), ("lgpl", r"(?:gnu )?lgpl ?(?:version )?v?2 1")],
    "lgpl-3": [("lesser general public licen", r"(?:gnu )?lesser general public licen[cs]e(?: version)? v?3(?: 0)?"), ("lgpl", r"(?:gnu )?lgpl ?(?:version )?v?3(?: 0)?")],
    "lgpl": [("lesser general public licen", r"(?:gnu )?lesser general public licen[cs]e"), ("library general public licen", r"(?:gnu )?library general public licen[cs]e")],
    "agpl-3": [("affero general public licen", r"(?:gnu )?affero general public licen[cs]e(?: version)?(?: v?3)?(?: 0)?"), ("agpl", r"(?:gnu )?agpl ?(?:version )?v?3(?: 0)?")],
    "bsd-2": [("2 clause bsd licen", r"2 clause bsd licen[cs]e"), ("simplified bsd licen", r"simplified bsd licen[cs]e"), ("bsd 2 clause licen", r"bsd 2 clause licen[cs]e")],
    "bsd-3": [("3 clause bsd licen", r"3 clause bsd licen[cs]e"), ("new bsd licen", r"new bsd licen[cs]e"), ("bsd 3 clause licen", r"bsd 3 clause licen[cs]e")],
    "bsd": [("bsd licen", r"bsd licen[cs]e"), ("bsd style licen", r"bsd style licen[cs]e")],
    "isc": [("isc licen", r"isc licen[cs]e")],
    "mpl-2": [("mozilla public licen", r"mozilla public licen[cs]e(?: version)? v?2(?: 0)?")],
    "mpl-1.1": [("mozilla public licen", r"mozilla public licen[cs]e(?: version)? v?1 1")],
    "mpl": [("mozilla public licen", r"mozilla public licen[cs]e")],
    "epl-2": [("eclipse public licen", r"eclipse public licen[cs]e(?: version)? v?2(?: 0)?")],
    "epl-1": [("eclipse public licen", r"eclipse public licen[cs]e(?: version)? v?1(?: 0)?")],
    "cddl-1": [("common development and distribution licen", r"common development and distribution licen[cs]e")],
    "cpl-1": [("common public licen", r"common public licen[cs]e")],
    "eupl": [("european union public licen", r"european union public licen[cs]e")],
    "artistic-2": [("artistic licen", r"artistic licen[cs]e(?: version)? v?2(?: 0)?")],
    "artistic": [("artistic licen", r"artistic licen[cs]e")],
    "boost-1": [("boost software licen", r"boost software licen[cs]e")],
    "zlib": [("zlib licen", r"zlib licen[cs]e")],
    "unlicense": [("the unlicen", r"the unlicense")],
    "wtfpl": [("do what the fuck you want to public licen", r"do what the fuck you want to public licen[cs]e")],
    "python-2": [("python software foundation licen", r"python software foundation licen[cs]e")],
    "php-3": [("php licen", r"php licen[cs]e")],
    "ruby": [("ruby licen", r"ruby licen[cs]e")],
    "ofl-1.1": [("open font licen", r"(?:sil )?open font licen[cs]e")],
    "odbl": [("open database licen", r"open database licen[cs]e")],
    "openssl": [("openssl licen", r"openssl licen[cs]e")],
    "postgresql": [("postgresql licen", r"postgresql licen[cs]e")],
    "ncsa": [("ncsa open source licen", r"ncsa open source licen[cs]e")],
    "ms-pl": [("microsoft public licen", r"microsoft public licen[cs]e")],
    "ms-rl": [("microsoft reciprocal licen", r"microsoft reciprocal licen[cs]e")],
    "osl-3": [("open software licen", r"open software licen[cs]e")],
    "afl-3": [("academic free licen", r"academic free licen[cs]e")],
    "gfdl": [("free documentation licen", r"(?:gnu )?free documentation licen[cs]e")],
    "sspl-1": [("server side public licen", r"server side public licen[cs]e")],
    "busl-1.1": [("business source licen", r"business source licen[cs]e")],
    "elastic-2": [("elastic licen", r"elastic licen[cs]e")],
    "cc-by": [("creative commons attribution", r"creative commons attribution(?: [1-4] [05])?"), (" cc by ", r"cc by(?: [1-4] [05])?")],
    "cc-by-sa": [("creative commons attribution share", r"creative commons attribution share ?alike(?: [1-4] [05])?"), (" cc by sa", r"cc by sa(?: [1-4] [05])?")],
    "cc-by-nd": [("creative commons attribution no", r"creative commons attribution no ?deriv(?:ative)?s?(?: [1-4] [05])?"), (" cc by nd", r"cc by nd(?: [1-4] [05])?")],
    "cc-by-nc": [("creative commons attribution non", r"creative commons attribution non ?commercial(?: [1-4] [05])?")],
    "cc-by-nc-sa": [("creative commons attribution non", r"creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?"), (" cc by nc sa", r"cc by nc sa(?: [1-4] [05])?")],
    "cc-by-nc-nd": [("creative commons attribution non", r"creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: [1-4] [05])?"), (" cc by nc nd", r"cc by nc nd(?: [1-4] [05])?")],
    "cc0": [("creative commons zero", r"creative commons zero"), (" cc0 ", r"cc0(?: 1 0)?")],
}

#: What makes a mention a grant: (pattern around the name, priority, weight).
MENTIONS = (
    (r"(?:licensed|distributed|released|available|provided|published|covered) (?:under|by) (?:an? |the )?(?:terms (?:and conditions )?of (?:an? |the )?)?{}", 1, 0.95),
    (r"(?:subject to|governed by|in accordance with|compliance with) (?:an? |the )?(?:terms (?:and conditions )?of (?:an? |the )?)?{}", 1, 0.9),
    (r"licen[cs]e (?:is |s )?(?:an? |the )?{}", 2, 0.85),
    (r"{}", 3, 0.6),
)

#: Words of the notices themselves: (label, keyword, pattern, weight).
NOTICES = (
    ("mit", "permission is hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy", 0.9),
    ("mit", "warranty of any kind express or implied", r"the software is provided as is without warranty of any kind express or implied", 0.7),
    ("isc", "copy modify and or distribute", r"permission (?:is hereby granted )?to use copy modify and or distribute this software", 0.85),
    ("bsd", "redistribution", r"redistributions? and use in source and binary forms with or without modification", 0.9),
    ("bsd-3", "without specific prior written permission", r"neither the names? of [^.]{1,300}? without specific prior written permission", 0.8),
    ("gpl", "free software", r"this program is free software you can redistribute it and or modify it", 0.85),
    ("lgpl", "free software", r"this library is free software you can redistribute it and or modify it", 0.85),
    ("gpl", "without any warranty", r"distributed in the hope that it will be useful but without any warranty", 0.7),
    ("apache-2", "you may not use this file except in compliance with the licen", r"you may not use this file except in compliance with the licen[cs]e", 0.9),
    ("mpl-2", "mozilla public licen", r"this source code form is subject to the terms of the mozilla public licen[cs]e", 0.95),
    ("public-domain", "public domain", r"(?:released|placed|dedicated|donated) (?:in|into|to) the public domain", 0.9),
    ("public-domain", "public domain", r"this (?:work|software|file|code) is (?:in|hereby in) the public domain", 0.9),
    ("proprietary", "rights reserved", r"all rights reserved", 0.5),
    ("proprietary", "permission is", r"no permission is granted", 0.7),
    ("copyright", "copyright", r"copyright (?:c )?(?:19|20)[0-9]{2}", 0.4),
    ("boost-1", "permission is hereby granted", r"permission is hereby granted free of charge to any person or organization obtaining a copy", 0.9),
    ("zlib", "permission is granted", r"permission is granted to anyone to use this software for any purpose", 0.85),
    ("cc-by-nc", "creative commons", r"creative commons [^.]{0,40}non ?commercial(?: licen[cs]e)?", 0.7),
    ("cc", "creative commons", r"creative commons licen[cs]e", 0.6),
    ("mit", "permission notice shall be included in all copies", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", 0.8),
    ("mit-0", "permission is hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction[^.]{1,300} to permit persons to whom the software is furnished to do so the software is provided as is", 0.9),
    ("x11", "shall not be used in advertising", r"the name of the x consortium shall not be used in advertising or otherwise to promote the sale[^.]{1,120} without prior written authorization", 0.85),
    ("isc", "copyright notice and this permission notice appear in all copies", r"provided that the above copyright notice and this permission notice appear in all copies", 0.7),
    ("bsd", "redistributions of source code must retain", r"redistributions of source code must retain the above copyright notice", 0.85),
    ("bsd", "redistributions in binary form must reproduce", r"redistributions in binary form must reproduce the above copyright notice", 0.85),
    ("bsd-4", "all advertising materials mentioning features", r"all advertising materials mentioning features or use of this software must display the following acknowledgements? copyright|all advertising materials mentioning features or use of this software must display the following acknowledgement", 0.9),
    ("bsd", "warranties including but not limited to", r"any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed", 0.5),
    ("0bsd", "permission to use copy modify and or distribute this software", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is", 0.85),
    ("apache-2", "apache licen", r"licensed under the apache licen[cs]e version 2 0 the licen[cs]e", 0.95),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the licen", r"unless required by applicable law or agreed to in writing software distributed under the licen[cs]e is distributed on an as is basis", 0.9),
    ("apache-2", "contributor licen", r"licensed to the [^.]{1,60} under one or more contributor licen[cs]e agreements", 0.8),
    ("apache-1.1", "products derived from this software may not be called apache", r"products derived from this software may not be called apache nor may apache appear in their name without prior written permission", 0.9),
    ("gpl", "general public licen", r"you should have received a copy of the gnu general public licen[cs]e along with this", 0.8),
    ("gpl-2", "general public licen", r"as published by the free software foundation either version 2 of the licen[cs]e or at your option any later version[^.]{0,200} general public licen[cs]e", 0.9),
    ("gpl-2", "general public licen", r"under the terms of the gnu general public licen[cs]e as published by the free software foundation either version 2 of the licen[cs]e", 0.95),
    ("gpl-3", "general public licen", r"under the terms of the gnu general public licen[cs]e as published by the free software foundation either version 3 of the licen[cs]e", 0.95),
    ("gpl-2", "general public licen", r"under the terms of version 2 of the gnu general public licen[cs]e", 0.95),
    ("gpl-3", "general public licen", r"gnu general public licen[cs]e version 3 29 june 2007", 1.0),
    ("gpl-2", "general public licen", r"gnu general public licen[cs]e version 2 june 1991", 1.0),
    ("lgpl-2.1", "lesser general public licen", r"gnu lesser general public licen[cs]e version 2 1 february 1999", 1.0),
    ("lgpl-2.1", "lesser general public licen", r"under the terms of the gnu lesser general public licen[cs]e as published by the free software foundation either version 2 1 of the licen[cs]e", 0.95),
    ("lgpl-3", "lesser general public licen", r"under the terms of the gnu lesser general public licen[cs]e as published by the free software foundation either version 3 of the licen[cs]e", 0.95),
    ("agpl-3", "affero general public licen", r"under the terms of the gnu affero general public licen[cs]e as published by the free software foundation either version 3 of the licen[cs]e", 0.95),
    ("agpl-3", "affero general public licen", r"gnu affero general public licen[cs]e version 3 19 november 2007", 1.0),
    ("gpl-classpath", "free software", r"free software foundation[^.]{0,200} designates this particular file as subject to the classpath exception", 0.9),
    ("gpl", "licen", r"everyone is permitted to copy and distribute verbatim copies of this licen[cs]e document but changing it is not allowed", 0.7),
    ("gfdl", "free documentation licen", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[cs]e", 0.95),
    ("mpl-2", "mozilla public licen", r"if a copy of the mpl was not distributed with this file you can obtain one at [^.]{0,40}mozilla public licen[cs]e", 0.7),
    ("mpl-1.1", "mozilla public licen", r"the contents of this file are subject to the mozilla public licen[cs]e version 1 1", 0.95),
    ("npl-1.1", "netscape public licen", r"the contents of this file are subject to the netscape public licen[cs]e", 0.95),
    ("epl-1", "eclipse public licen", r"all rights reserved this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e v1 0", 0.95),
    ("epl-2", "eclipse public licen", r"this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e 2 0", 0.95),
    ("cddl-1", "common development and distribution licen", r"the contents of this file are subject to the terms of the common development and distribution licen[cs]e", 0.95),
    ("eupl", "european union public licen", r"licensed under the eupl version 1 [12][^.]{0,120} european union public licen[cs]e", 0.9),
    ("cecill", "licen", r"this software is governed by the cecill(?: [bc])? licen[cs]e under french law", 0.95),
    ("artistic", "licen", r"same terms as perl itself[^.]{0,80} licen[cs]e", 0.5),
    ("zlib", "permission is granted", r"permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely", 0.95),
    ("zlib", "copyright", r"altered source versions must be plainly marked as such and must not be misrepresented as being the original software[^.]{0,200} copyright", 0.6),
    ("boost-1", "boost software licen", r"distributed under the boost software licen[cs]e version 1 0", 0.95),
    ("unlicense", "public domain", r"this is free and unencumbered software released into the public domain", 0.95),
    ("wtfpl", "public licen", r"everyone is permitted to copy and distribute verbatim or modified copies of this licen[cs]e document[^.]{0,120} public licen[cs]e", 0.8),
    ("cc0", "creative commons", r"to the extent possible under law [^.]{1,120} has waived all copyright and related or neighboring rights[^.]{0,160} creative commons", 0.9),
    ("cc-by", "creative commons attribution", r"this work is licensed under (?:a|the) creative commons attribution [1-4] [05] (?:international|unported|generic) licen[cs]e", 0.95),
    ("cc-by-sa", "creative commons attribution", r"this work is licensed under (?:a|the) creative commons attribution share ?alike [1-4] [05] (?:international|unported|generic) licen[cs]e", 0.95),
    ("cc-by-nd", "creative commons attribution", r"this work is licensed under (?:a|the) creative commons attribution no ?deriv(?:ative)?s [1-4] [05] (?:international|unported|generic) licen[cs]e", 0.95),
    ("cc-by-nc", "creative commons attribution", r"this work is licensed under (?:a|the) creative commons attribution non ?commercial [1-4] [05] (?:international|unported|generic) licen[cs]e", 0.95),
    ("python-2", "python software foundation licen", r"psf licen[cs]e agreement for python [23][^.]{0,120} python software foundation licen[cs]e", 0.9),
    ("php-3", "licen", r"this source file is subject to version 3 0?1? ?of the php licen[cs]e", 0.95),
    ("openssl", "copyright", r"this product includes software developed by the openssl project[^.]{0,120} copyright", 0.8),
    ("openssl", "written permission", r"the names openssl toolkit and openssl project must not be used to endorse or promote products[^.]{0,120} written permission", 0.9),
    ("postgresql", "permission to use copy modify and distribute this software", r"permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted", 0.9),
    ("ncsa", "permission is hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal with the software without restriction", 0.9),
    ("curl", "permission to use copy modify and distribute this software", r"permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", 0.85),
    ("hpnd", "permission to use copy modify and distribute this software", r"permission to use copy modify and distribute this software and its documentation for any purpose (?:and without fee )?is hereby granted", 0.8),
    ("unicode", "permission is hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy of the unicode data files", 0.95),
    ("w3c", "permission to", r"permission to copy modify and distribute this work with or without modification for any purpose and without fee or royalty is hereby granted", 0.9),
    ("json", "copyright", r"the software shall be used for good not evil[^.]{0,200} copyright", 0.7),
    ("beerware", "licen", r"the beer ?ware licen[cs]e", 0.9),
    ("ofl-1.1", "open font licen", r"this font software is licensed under the sil open font licen[cs]e version 1 1", 0.95),
    ("odbl", "open database licen", r"made available under the open database licen[cs]e", 0.95),
    ("bsl-1.1", "business source licen", r"change date [^.]{0,40} change licen[cs]e [^.]{0,80} business source licen[cs]e", 0.9),
    ("elastic-2", "elastic licen", r"you may not use this file except in compliance with the elastic licen[cs]e", 0.95),
    ("commercial", "licen", r"this software is licensed not sold", 0.8),
    ("commercial", "licen", r"end user licen[cs]e agreement", 0.8),
    ("proprietary", "copyright", r"confidential and proprietary[^.]{0,120} copyright", 0.7),
    ("proprietary", "written permission", r"unauthori[sz]ed copying of this file via any medium is strictly prohibited[^.]{0,160} written permission", 0.8),
    ("proprietary", "written permission", r"may not be (?:reproduced|copied|distributed|published)[^.]{0,160} without (?:the )?(?:prior |express )?written permission", 0.7),
    ("proprietary", "licen", r"no licen[cs]e (?:express or implied )?is granted", 0.7),
    ("non-commercial", "licen", r"licen[cs]ed? (?:only )?for (?:personal and )?non ?commercial use(?: only)?", 0.7),
    ("research-only", "licen", r"licen[cs]ed? for (?:academic|research|educational)(?: and (?:academic|research|educational))? (?:use|purposes) only", 0.8),
    ("dual", "licen", r"dual licensed under", 0.5),
    ("copyright", "rights reserved", r"some rights reserved", 0.4),
    ("copyright", "copyright", r"copyright by the authors?", 0.4),
)


def rules() -> list[Rule]:
    """All rules: base phrases, license identifiers, mentions of each name, and notices."""
    out = [Rule(label, 0, 1.0, phrase if any(a in phrase for a in ANCHORS) else f" {phrase} ", phrase, True) for phrase, label in BASE_PHRASES.items()]
    for label, names in NAMES.items():
        identifier = " ".join(re.findall(r"[a-z]+|[0-9]+", label))
        out.append(Rule(label, 0, 1.0, f"spdx license identifier {identifier.split()[0]}", rf"spdx license identifier {identifier}(?: 0)?(?: only| or later)?"))
        for keyword, name in names:
            out += [Rule(label, priority, weight, keyword, around.format(name)) for around, priority, weight in MENTIONS]
    return out + [Rule(label, 2, weight, keyword, pattern) for label, keyword, pattern, weight in NOTICES]


def bound(value: Column, f) -> Column:
    """f(value) with value computed once: a lambda over an array of it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def rule_array(some: list[Rule]) -> Column:
    fields = lambda r: F.struct(F.lit(r.priority).alias("priority"), F.lit(r.label).alias("label"), F.lit(r.weight).alias("weight"), F.lit(r.keyword).alias("keyword"), F.lit(f"(?<= ){r.pattern}(?= )").alias("pattern"), F.lit(r.base).alias("base"))
    return F.array(*map(fields, some))


def detections(words: Column, some: list[Rule]) -> Column:
    """Sorted array of (start, back, priority, label, weight, base); back is minus the end, exclusive."""

    def places(r: Column) -> Column:
        marked = F.split(F.regexp_replace(words, r["pattern"], F.lit("\1$0\2")), " ")

        def with_mark(at: Column, found) -> Column:
            return F.filter(F.transform(at, lambda w, i: F.when(found(w), i)), lambda i: i.isNotNull())

        starts = with_mark(marked, lambda w: F.startswith(w, F.lit("\1")))
        ends = with_mark(marked, lambda w: F.endswith(w, F.lit("\2")))
        return F.zip_with(starts, ends, lambda a, b: F.struct((a - 1).cast("long").alias("start"), (-b).cast("long").alias("back"), r["priority"].alias("priority"), r["label"].alias("label"), r["weight"].alias("weight"), r["base"].alias("base")))

    hit = F.filter(rule_array(some), lambda r: F.contains(words, r["keyword"]) & F.regexp_like(words, r["pattern"]))
    return F.array_sort(F.flatten(F.transform(hit, places)))


def verdict(found: Column) -> Column:
    """What a document's sorted detections come to."""
    start = F.struct(*(F.lit(-1).cast("long").alias(f"reach{k}") for k in range(PRIORITIES)), F.array().cast("array<string>").alias("labels"), F.lit(1.0).alias("miss"))

    def step(a: Column, d: Column) -> Column:
        end = -d["back"]
        reaches = [F.when(d["priority"] >= k, a[f"reach{k}"]).otherwise(F.lit(-1)) for k in range(PRIORITIES)]
        stays = F.greatest(*reaches) < end
        return F.struct(
            *(F.when(stays & (d["priority"] == k), F.greatest(a[f"reach{k}"], end)).otherwise(a[f"reach{k}"]).alias(f"reach{k}") for k in range(PRIORITIES)),
            F.when(stays, F.array_union(a["labels"], F.array(d["label"]))).otherwise(a["labels"]).alias("labels"),
            F.when(stays, a["miss"] * (1 - d["weight"])).otherwise(a["miss"]).alias("miss"),
        )

    base = F.filter(found, lambda d: d["base"])
    labels = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")

    def finished(both: Column) -> Column:
        at, base_labels = F.transform(both["base"], lambda d: d["start"]), F.transform(both["base"], lambda d: d["label"])
        return F.struct(
            F.size(at).cast("long").alias("n_base"),
            F.array_min(at).alias("first_word"),
            F.array_max(at).alias("last_word"),
            labels(base_labels).alias("base_labels"),
            labels(F.array_union(base_labels, both["end"]["labels"])).alias("labels"),
            (1 - both["end"]["miss"]).alias("score"),
        )

    return bound(F.struct(base.alias("base"), F.aggregate(found, start, step).alias("end")), finished)


def scanned(docs: DataFrame, some: list[Rule] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of each row.

    Words are numbered from 0.  A null or empty text has no words, no places and
    empty labels; a text of any length is one string, read by each rule whose
    keyword it holds.  Null doc_ids and repeated rows stay as they are; other columns
    don't matter; an empty table gives an empty result.
    """
    some = rules() if some is None else some
    lowered = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    cut = docs.select(F.col("doc_id").cast("long"), F.trim(F.regexp_replace(lowered, NOT_WORD, " ")).alias("__cut"))
    n_words = F.when(F.col("__cut") == "", 0).otherwise(F.length("__cut") - F.length(F.replace("__cut", F.lit(" "))) + 1)
    cut = cut.select("doc_id", n_words.cast("long").alias("n_words"), F.concat(F.lit(" "), "__cut", F.lit(" ")).alias("__words"))
    anchored = reduce(lambda a, b: a | b, (F.contains("__words", F.lit(a)) for a in ANCHORS))
    result = F.when(anchored, bound(detections(F.col("__words"), some), verdict))
    none = {"n_base": F.lit(0).cast("long"), "base_labels": F.lit(""), "labels": F.lit(""), "score": F.lit(0.0)}
    found = cut.select("doc_id", "n_words", result.alias("r"))
    fields = ("n_base", "first_word", "last_word", "base_labels", "labels", "score")
    return found.select("doc_id", "n_words", *(F.coalesce(F.col("r")[f], none[f]).alias(f) if f in none else F.col("r")[f].alias(f) for f in fields))


def op2(spark, sf_dir: str) -> DataFrame:
    return scanned(table(spark, sf_dir, "documents"))
