"""License scans: ordered signature rules, by DataFrame functions only.

Rules are regexes with keywords, a priority and a confidence: names and versions of licences, and clauses of their own wording
(grants, conditions, disclaimers). scan() tries them on whole texts, in which A-Z are lowered and each run of white space is
one blank, so that notices wrapped over lines match. A text is looked at only if it passes the gate, which every rule's first keyword
passes, and a rule is tried only where all its keywords stand. Each match is an interval. A match is suppressed if one of the same or
a higher priority contains it, or one of a higher priority overlaps it; running maxima over a text's sorted
matches decide this, so no pairs are formed.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lower_ascii, row_key

# The two base phrases of two and more words and the labels of their places: fixed values.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
WHITE = r"[\x20\x09-\x0D]+"
WORD_BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

Rule = tuple[str, str, tuple[str, ...], int, float]  # label, regex, keywords, priority (more is stronger), confidence

_B = r"(?<![a-z0-9])"
_E = r"(?![a-z0-9])"
_VERSION = r",? ?(?:version |v\.? ?)?"

_CC_NAMES = {
    "by": "attribution", "by-sa": "attribution[ -]share ?alike", "by-nd": "attribution[ -]no ?deriv(?:ative)?s?", "by-nc": "attribution[ -]non ?commercial",
    "by-nc-sa": "attribution[ -]non ?commercial[ -]share ?alike", "by-nc-nd": "attribution[ -]non ?commercial[ -]no ?deriv(?:ative)?s?",
}
#: label: (name as a regex, keyword)
_GNU = {
    "gpl": (r"(?:gnu )?general public licen[sc]e", "general public licen"), "lgpl": (r"(?:gnu )?(?:lesser|library) general public licen[sc]e", "general public licen"),
    "agpl": (r"(?:gnu )?affero general public licen[sc]e", "affero"), "gfdl": (r"(?:gnu )?free documentation licen[sc]e", "free documentation"),
}
#: label: (name as a regex, keyword, versions)
_VERSIONED = {
    "apache": (r"apache(?: software)? licen[sc]e", "apache", ("1.0", "1.1", "2.0")),
    "mpl": (r"mozilla public licen[sc]e", "mozilla", ("1.0", "1.1", "2.0")),
    "epl": (r"eclipse public licen[sc]e", "eclipse", ("1.0", "2.0")),
    "cddl": (r"common development and distribution licen[sc]e", "common development", ("1.0", "1.1")),
    "eupl": (r"european union public licen[sc]e", "european union", ("1.0", "1.1", "1.2")),
    "osl": (r"open software licen[sc]e", "open software", ("1.0", "2.0", "2.1", "3.0")),
    "afl": (r"academic free licen[sc]e", "academic free", ("1.1", "1.2", "2.0", "2.1", "3.0")),
    "artistic": (r"artistic licen[sc]e", "artistic", ("1.0", "2.0")),
    "ofl": (r"sil open font licen[sc]e", "open font", ("1.0", "1.1")),
    "boost": (r"boost software licen[sc]e", "boost", ("1.0",)),
    "cpl": (r"common public licen[sc]e", "common public", ("1.0",)),
    "lppl": (r"latex project public licen[sc]e", "latex project", ("1.0", "1.1", "1.2", "1.3a", "1.3c")),
    "psf": (r"python software foundation licen[sc]e", "python software", ("2",)),
    "php": (r"php licen[sc]e", "php licen", ("3.0", "3.01")),
    "zpl": (r"zope public licen[sc]e", "zope", ("1.1", "2.0", "2.1")),
    "odbl": (r"open (?:data commons open )?database licen[sc]e", "database licen", ("1.0",)),
    "cecill": (r"cecill(?:-[bc])?", "cecill", ("1.0", "2.0", "2.1")),
}
_PLAIN = {
    "mit": (r"(?:the )?mit licen[sc]e", "mit licen"), "expat": (r"(?:the )?expat licen[sc]e", "expat"), "isc": (r"(?:the )?isc licen[sc]e", "isc licen"), "zlib": (r"(?:the )?zlib(?:/libpng)? licen[sc]e", "zlib"), "bsd": (r"(?:the )?(?:(?:new|modified|simplified|revised) )?bsd(?: style)? licen[sc]e", "bsd"),
    "bsd-2-clause": (r"bsd[ -]2[ -]clause(?: licen[sc]e)?", "bsd"), "bsd-3-clause": (r"bsd[ -]3[ -]clause(?: licen[sc]e)?", "bsd"), "bsd-4-clause": (r"bsd[ -]4[ -]clause(?: licen[sc]e)?", "bsd"),
    "unlicense": (r"(?:the )?unlicense", "unlicense"), "wtfpl": (r"do what the f[a-z*]+ you want to public licen[sc]e", "want to public licen"), "cc0": (r"(?:creative commons )?cc0(?: 1\.0)?(?: universal)?", "cc0"), "public-domain": (r"(?:released (?:in)?to|placed in|in) the public domain", "public domain"),
    "beerware": (r"beer-?ware licen[sc]e", "ware licen"), "postgresql": (r"postgresql licen[sc]e", "postgresql"), "ms-pl": (r"microsoft public licen[sc]e", "microsoft"), "ms-rl": (r"microsoft reciprocal licen[sc]e", "microsoft"),
    "proprietary": (r"proprietary and confidential", "proprietary"),
}


_AS_IS = r"""["'“]?as[ -]is["'”]?"""
#: Clauses in the licences' own wording: label, regex, first keyword, further keywords, confidence.
_CLAUSES = (
    ("mit", r"permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "hereby", "free of charge", 0.97),
    ("mit", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "copyright", "permission notice", 0.9),
    ("mit", rf"the software is provided {_AS_IS}, without warranty of any kind, express or implied", "warrant", "of any kind", 0.8),
    ("mit", r"to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge, publish", "limitation", "to deal in", 0.9),
    ("boost-1.0", r"permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation", "hereby", "organization", 0.97),
    ("isc", r"permission to use, copy, modify,? and(?:/or)? distribute this software for any purpose with or without fee is hereby granted", "hereby", "without fee", 0.95),
    ("isc", rf"the software is provided {_AS_IS} and the author disclaims all warranties with regard to this software", "warrant", "disclaims all", 0.85),
    ("postgresql", r"permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted", "hereby", "written agreement", 0.97),
    ("hpnd", r"permission to use, copy, modify,? and distribute this software and its documentation for any purpose and without fee is hereby granted", "hereby", "without fee", 0.9),
    ("x11-sell", r"permission to use, copy, modify, distribute, and sell this software and its documentation for any purpose is hereby granted", "hereby", "and sell", 0.95),
    ("bsd", r"redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "redistribut", "binary forms", 0.9),
    ("bsd", r"redistributions of source code must retain the above copyright notice, this list of conditions", "redistribut", "must retain", 0.85),
    ("bsd", r"redistributions in binary form must reproduce the above copyright notice, this list of conditions", "redistribut", "must reproduce", 0.85),
    ("bsd", rf"this software is provided by the (?:copyright holders? and contributors|author|regents and contributors) {_AS_IS} and any express or implied warranties", "warrant", "is provided by the", 0.8),
    ("bsd-3-clause", r"neither the name of [a-z0-9 .,<>'-]{1,80} nor the names of (?:its|their|any|the) contributors may be used to endorse or promote products", "endorse", "neither the name", 0.95),
    ("bsd-4-clause", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment", "advertising", "must display", 0.95),
    ("bsd-4-clause", r"this product includes software developed by the university of california", "product includes", "california", 0.9),
    ("apache-1.1", r"this product includes software developed by the apache software foundation", "product includes", "apache", 0.9),
    ("apache-2.0", rf"unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an {_AS_IS} basis", "applicable law", "agreed to in writing", 0.9),
    ("apache-2.0", r"you may not use this file except in compliance with the license", "compliance", "this file except", 0.9),
    ("apache-2.0", r"each contributor hereby grants to you a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable (?:copyright|patent|\(except)", "hereby", "royalty-free", 0.9),
    ("apache-2.0", r"you must give any other recipients of the work or derivative works a copy of this license", "recipients", "derivative works", 0.85),
    ("gpl", r"this program is free software[;:,] you can redistribute it and/or modify it under the terms of the gnu general public licen[sc]e", "redistribut", "this program is free", 0.95),
    ("gpl", r"this program is distributed in the hope that it will be useful, but without any warranty", "warrant", "in the hope", 0.8),
    ("gpl", r"you should have received a copy of the gnu general public licen[sc]e along with", "general public licen", "should have received", 0.9),
    ("gpl", r"everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed", "verbatim", "license document", 0.8),
    ("gpl", r"the licenses for most software are designed to take away your freedom to share and change it", "freedom", "take away", 0.85),
    ("gpl-2.0", r"any work that you distribute or publish, that in whole or in part contains or is derived from the program", "derived from", "whole or in part", 0.85),
    ("gpl-3.0", r"conveying under any other circumstances is permitted solely under the conditions stated below", "conveying", "solely under", 0.85),
    ("gpl-3.0", r"you may convey verbatim copies of the program's source code as you receive it", "verbatim", "convey", 0.85),
    ("lgpl", r"this library is free software[;:,] you can redistribute it and/or modify it under the terms of the gnu (?:lesser|library) general public licen[sc]e", "redistribut", "this library is free", 0.95),
    ("lgpl", r"you should have received a copy of the gnu (?:lesser|library) general public licen[sc]e along with", "general public licen", "should have received", 0.9),
    ("agpl", r"you should have received a copy of the gnu affero general public licen[sc]e along with", "affero", "should have received", 0.95),
    ("agpl-3.0", r"all users interacting with it remotely through a computer network", "remotely", "interacting", 0.9),
    ("mpl-2.0", r"this source code form is subject to the terms of the mozilla public licen[sc]e", "mozilla", "source code form", 0.97),
    ("mpl-2.0", r"if a copy of the mpl was not distributed with this file, you can obtain one at", "can obtain one", "mpl was not", 0.97),
    ("mpl-1.1", r"the contents of this file are subject to the mozilla public licen[sc]e", "mozilla", "contents of this file", 0.95),
    ("epl", r"this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e", "eclipse", "accompanying materials", 0.97),
    ("cddl", r"the contents of this file are subject to the terms of the common development and distribution licen[sc]e", "common development", "contents of this file", 0.97),
    ("cpl-1.0", r"the accompanying program is provided under the terms of this common public licen[sc]e", "common public", "accompanying program", 0.95),
    ("zlib", r"""this software is provided ["'‘]as-is["'’], without any express or implied warranty""", "warrant", "without any express", 0.9),
    ("zlib", r"the origin of this software must not be misrepresented", "misrepresented", "the origin", 0.95),
    ("zlib", r"altered source versions must be plainly marked as such", "plainly marked", "altered source", 0.95),
    ("unlicense", r"this is free and unencumbered software released into the public domain", "unencumbered", "public domain", 0.98),
    ("unlicense", r"anyone is free to copy, modify, publish, use, compile, sell, or distribute this software", "anyone is free", "compile, sell", 0.95),
    ("cc0-1.0", r"the person who associated a work with this deed has dedicated the work to the public domain", "public domain", "this deed", 0.97),
    ("cc0-1.0", r"to the extent possible under law, [a-z0-9 .,'-]{1,100} has waived all copyright and related", "waived", "extent possible", 0.95),
    ("public-domain", r"the authors? (?:hereby )?disclaims? (?:all )?copyright to this source code", "disclaim", "copyright to", 0.9),
    ("creative-commons", r"this (?:work|article|book|photo|page) is licen[sc]ed under (?:a|the) creative commons", "creative commons", "this ", 0.8),
    ("cc-by", r"you must give appropriate credit, provide a link to the licen[sc]e, and indicate if changes were made", "appropriate credit", "indicate if", 0.85),
    ("cc-by-sa", r"if you remix, transform, or build upon the material, you must distribute your contributions under the same licen[sc]e", "remix", "contributions", 0.9),
    ("cc-by-nd", r"if you remix, transform, or build upon the material, you may not distribute the modified material", "remix", "modified material", 0.9),
    ("cc-by-nc", r"you may not use the material for commercial purposes", "commercial purposes", "the material", 0.85),
    ("wtfpl", r"everyone is permitted to copy and distribute verbatim or modified copies of this license document", "verbatim", "or modified", 0.95),
    ("beerware", r"as long as you retain this notice you can do whatever you want with this stuff", "retain this notice", "this stuff", 0.97),
    ("openssl", r"this product includes software developed by the openssl project", "product includes", "openssl", 0.97),
    ("php", r"this product includes php software, freely available from", "product includes", "php", 0.95),
    ("psf-2", rf"psf is making python [0-9.a-z]{{0,12}} ?available to licensee on an {_AS_IS} basis", "psf", "to licensee", 0.95),
    ("artistic", r"""the ["“]?(?:standard version|package)["”]? refers to the collection of files distributed by the copyright holder""", "copyright", "collection of files", 0.9),
    ("artistic-or-gpl", r"you can redistribute it and/or modify it under the same terms as perl(?: itself)?", "redistribut", "terms as perl", 0.95),
    ("ruby", r"you can redistribute it and/or modify it under either the terms of the", "redistribut", "either the terms", 0.7),
    ("ofl-1.1", r"the font software may be sold as part of a larger software package", "font software", "larger", 0.9),
    ("ofl-1.1", r"with reserved font name", "reserved font", "name", 0.9),
    ("lppl", r"this work may be distributed and/or modified under the conditions of the latex project public licen[sc]e", "latex project", "may be distributed", 0.97),
    ("odbl", r"is made available under the open database licen[sc]e", "database licen", "made available", 0.95),
    ("pddl", r"public domain dedication and licen[sc]e", "public domain", "dedication and", 0.9),
    ("ncsa", r"university of illinois/ncsa open source licen[sc]e", "ncsa", "illinois", 0.97),
    ("json", r"the software shall be used for good, not evil", "not evil", "for good", 0.98),
    ("ms-pl", r"if you use the software, you accept this licen[sc]e\. if you do not accept the licen[sc]e, do not use the software", "accept", "do not use the software", 0.9),
    ("sspl-1.0", r"server side public licen[sc]e", "server side", "public", 0.9),
    ("busl-1.1", r"business source licen[sc]e", "business source", "licen", 0.9),
    ("elastic-2.0", r"elastic licen[sc]e(?: 2\.0)?", "elastic licen", "elastic", 0.8),
    ("ecl-2.0", r"educational community licen[sc]e", "educational community", "licen", 0.9),
    ("ijg", r"this software is based in part on the work of the independent jpeg group", "jpeg group", "based in part", 0.97),
    ("proprietary", r"unauthorized copying of this file, via any medium,? is strictly prohibited", "unauthorized", "strictly prohibited", 0.97),
    ("proprietary", r"this software is the confidential and proprietary information of", "confidential", "proprietary information", 0.95),
    ("proprietary", r"this source code is licen[sc]ed under a commercial licen[sc]e agreement", "commercial licen", "source code", 0.9),
    ("reserved", r"no part of this (?:publication|book|document|work) may be reproduced", "reproduced", "no part of", 0.85),
    ("reserved", r"may not be (?:reproduced|copied|redistributed)[a-z ,]{0,60} without (?:the )?(?:prior |express )?written (?:permission|consent)", "written", "may not be", 0.7),
    ("dual-license", r"dual[- ]licen[sc]ed", "licen", "dual", 0.6),
)


def rules() -> list[Rule]:
    """The ordered rules: each family, by version and by form of its name, and the clauses."""
    out: list[Rule] = []
    for label, name in _CC_NAMES.items():
        for version in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            v, full = re.escape(version), f"cc-{label}-{version}"
            out.append((full, rf"{_B}cc[ -]{label.replace('-', '[ -]')}[ -]{v}{_E}", ("cc", version), 4, 0.95))
            out.append((full, rf"creative commons {name}{_VERSION}{v}(?: [a-z]+)?(?: licen[sc]e)?", ("creative commons", version), 4, 0.97))
            out.append((full, rf"creativecommons\.org/licenses/{label}/{v}/?", ("creativecommons", f"/{label}/{version}"), 5, 0.99))
            out.append((full, rf"spdx-license-identifier: ?cc-{label}-{v}{_E}", ("spdx", f"cc-{label}-{version}"), 6, 1.0))
        out.append((f"cc-{label}", rf"{_B}cc[ -]{label.replace('-', '[ -]')}{_E}", ("cc",), 2, 0.7))
        out.append((f"cc-{label}", rf"creative commons {name}", ("creative commons", "attribution"), 2, 0.8))
    for label, (name, keyword) in _GNU.items():
        for version in ("1.0", "1.1", "1.2", "1.3") if label == "gfdl" else ("1.0", "2.0", "2.1", "3.0"):
            short = version.removesuffix(".0")
            v, full = rf"{re.escape(short)}(?:\.0)?", f"{label}-{version}"
            out.append((full, rf"{name}(?: \({label}\))?{_VERSION}{v}{_E}", (keyword, short), 4, 0.97))
            out.append((f"{full}-or-later", rf"{name}(?: \({label}\))?{_VERSION}{v},? or (?:\(at your option\) )?(?:any )?later", (keyword, short, "later"), 5, 0.98))
            out.append((full, rf"{_B}{label}[ -]?v?{v}{_E}", (label, short), 3, 0.9))
            out.append((f"{full}-or-later", rf"{_B}{label}[ -]?v?{v}(?:\+|[ -]or[ -]later)", (label, short), 4, 0.95))
            out.append((full, rf"spdx-license-identifier: ?{label}-{v}(?:-only)?{_E}", ("spdx", f"{label}-{short}"), 6, 1.0))
            out.append((f"{full}-or-later", rf"spdx-license-identifier: ?{label}-{v}(?:-or-later|\+)", ("spdx", f"{label}-{short}"), 7, 1.0))
        out.append((label, name, (keyword,), 2, 0.8))
        out.append((label, rf"{_B}{label}{_E}", (label,), 1, 0.5))
    for label, (name, keyword, versions) in _VERSIONED.items():
        for version in versions:
            v, full = re.escape(version), f"{label}-{version}"
            out.append((full, rf"{name}{_VERSION}{v}{_E}", (keyword, version), 4, 0.97))
            out.append((full, rf"licen[sc]ed under (?:the )?(?:terms of (?:the )?)?{name}{_VERSION}{v}{_E}", (keyword, version, "ed under"), 5, 0.99))
            out.append((full, rf"spdx-license-identifier: ?{label}-{v}{_E}", ("spdx", f"{label}-{version}"), 6, 1.0))
        out.append((label, name, (keyword,), 2, 0.8))
    for label, (name, keyword) in _PLAIN.items():
        out.append((label, rf"{_B}{name}{_E}", (keyword,), 3, 0.8))
        out.append((label, rf"(?:released|distributed|licen[sc]ed|available) under (?:the )?(?:terms of (?:the )?)?{name}{_E}", (keyword, " under "), 4, 0.95))
        out.append((label, rf"spdx-license-identifier: ?{label}{_E}", ("spdx", label), 6, 1.0))
    out += [(label, regex, tuple(words), 3, sure) for label, regex, *words, sure in _CLAUSES]
    out.append(("copyright", r"copyright (?:\(c\) )?(?:19|20)[0-9]{2}", ("copyright",), 3, 0.8))
    out.append(("copyright", r"\(c\) (?:19|20)[0-9]{2}", ("(c)",), 3, 0.8))
    out.append(("reserved", r"all rights reserved", ("reserved",), 2, 0.6))
    out.append(("license-reference", r"(?:see|refer to) (?:the )?(?:accompanying )?licen[sc]e(?: file)?", ("licen",), 1, 0.3))
    return out


#: Words that stand in the fixed parts of most rules.
_COMMON = ("licen", "copyright", "software")


def _gate_word(rule: Rule) -> str:
    """A word without blanks that every match holds: a common one from the regex without its groups and classes, else the longest part of the first keyword."""
    fixed, before = re.sub(r"\\.|\[[^]]*\]", " ", rule[1]), None
    while fixed != before:
        fixed, before = re.sub(r"\([^()]*\)(?:[?*+]|\{[^}]*\})?", " ", fixed), fixed
    return next((w for w in _COMMON if w in fixed), max(rule[2][0].split(), key=len))


def _gate(table: list[Rule]) -> Callable[[Column], Column]:
    """Whether a lower-cased text may match a rule; cc counts only before white space or a hyphen."""
    parts = sorted({_gate_word(r) for r in table})
    apart = [p for p in parts if p != "cc" and not any(q not in (p, "cc") and q in p for q in parts)]

    def test(low: Column) -> Column:
        found = [low.contains(p) for p in apart]
        return reduce(Column.__or__, found + [low.contains("cc") & low.rlike(r"cc[\s-]")] * ("cc" in parts))

    return test


def _holds(text: Column, test: Callable[[Column], Column]) -> Column:
    """test of the lower-cased text, which is made once for each row; null counts as empty."""
    return F.exists(F.array(F.lower(F.coalesce(text, F.lit("")))), test)


def unwrapped(docs: DataFrame, table: list[Rule]) -> DataFrame:
    """(key, low) of the documents that pass the gate; low is the text as one line with single blanks."""
    low = lower_ascii(F.col("text"))
    return docs.select("doc_id", "text").where(_holds(F.col("text"), _gate(table))).select(row_key(F.col("doc_id"), F.col("text")).alias("key"), F.regexp_replace(low, WHITE, " ").alias("low"))


def _words(fragment: Column) -> Column:
    """Words of a text in which single blanks stand between words."""
    t = F.trim(fragment)
    return F.when(t == "", F.lit(0)).otherwise(F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit(""))) + 1).cast("long")


def _may_hold_phrase(low: Column) -> Column:
    near = low.contains("cc") & low.rlike(rf"cc{WORD_BREAKS}by")
    return near | (low.contains("general") & low.contains("public") & low.contains("license")) | (low.contains("rights") & low.contains("reserved"))


def base_places(docs: DataFrame) -> DataFrame:
    """key, doc_id, n_words, n_base, first_word, last_word and base (array of labels). Only texts that may hold a phrase are split."""
    text = F.coalesce("text", F.lit(""))
    out = docs.select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("key"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("n_words"), F.when(_holds(F.col("text"), _may_hold_phrase), text).alias("maybe"))
    out = out.withColumn("plain", F.trim(F.regexp_replace(lower_ascii(F.col("maybe")), WORD_BREAKS, " "))).drop("maybe")
    found = []
    for phrase, label in BASE_PHRASES.items():
        parts = F.split(F.concat(F.lit(" "), F.col("plain"), F.lit(" ")), f"(?<= ){phrase}(?= )", -1)
        n = F.size(parts).cast("long") - 1
        first, last = _words(parts[0]), F.col("n_words") - _words(F.element_at(parts, -1)) - (phrase.count(" ") + 1)
        spot = F.when(F.col("plain").contains(phrase) & (n > 0), F.struct(n.alias("n"), first.alias("first"), last.alias("last"), F.lit(label).alias("label")))
        found.append(spot)
    out = out.withColumn("found", F.array_compact(F.array(*found))).drop("plain")
    total = F.aggregate("found", F.lit(0).cast("long"), lambda a, x: a + x.n)
    return out.select("key", "doc_id", "n_words", total.alias("n_base"), F.array_min("found.first").alias("first_word"), F.array_max("found.last").alias("last_word"), F.col("found.label").alias("base")).drop("found")


def _known(table: list[Rule]) -> Column:
    """The rules by their first keyword, as one constant."""
    by_word: dict[str, list[dict]] = {}
    for label, regex, words, level, sure in table:
        by_word.setdefault(words[0], []).append({"label": label, "regex": regex, "words": list(words[1:]), "priority": level, "confidence": sure})
    rule = "struct<label: string, regex: string, words: array<string>, priority: int, confidence: double>"
    return F.from_json(F.lit(json.dumps([{"word": w, "rules": own} for w, own in by_word.items()])), f"array<struct<word: string, rules: array<{rule}>>>")


def detections(texts: DataFrame, table: list[Rule] | None = None) -> DataFrame:
    """(key, start, end, label, priority, confidence) of the matches that are not suppressed.

    texts: key, low (lower-cased, single blanks); rows that repeat a key are alike. start and end are code points of low, end exclusive.
    One exchange by key serves all that follows it; texts are not moved.
    """
    table = table or rules()
    known = _known(table)
    near = F.flatten(F.transform(F.filter(known, lambda w: F.col("low").contains(w.word)), lambda w: F.filter(w.rules, lambda r: F.forall(r.words, lambda x: F.col("low").contains(x)))))
    tried = texts.withColumn("r", F.monotonically_increasing_id()).select("key", "r", "low", F.explode(near).alias("rule"))
    hits = tried.withColumn("hits", F.expr("regexp_extract_all(low, rule.regex, 0)")).where("size(hits) > 0")
    apart = hits.withColumn("gaps", F.expr("slice(split(low, rule.regex, -1), 1, size(hits))"))
    sizes = F.transform(F.arrays_zip("gaps", "hits"), lambda m: F.struct(F.length(m.gaps).alias("gaps"), F.length(m.hits).alias("hits")))
    each = apart.select("key", "r", "rule.label", "rule.priority", "rule.confidence", F.col("rule.regex").alias("regex"), F.posexplode(sizes).alias("turn", "m")).repartition("key")
    run = Window.partitionBy("key", "r", "regex").orderBy("turn")
    end = F.sum(F.col("m.gaps") + F.col("m.hits")).over(run).cast("long")
    placed = each.withColumn("end", end).withColumn("start", F.col("end") - F.col("m.hits")).select("key", "start", "end", "label", "priority", "confidence").distinct()
    order = Window.partitionBy("key").orderBy("start", F.desc("end"), F.desc("priority"), "label", "confidence")
    ahead, behind = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    levels = sorted({r[3] for r in table})
    lost = F.lit(False)
    for p in levels:
        over = F.max(F.when(F.col("priority") >= p, F.col("end"))).over(ahead)
        lost = lost | ((F.col("priority") == p) & (F.coalesce(over, F.lit(-1)) >= F.col("end")))
        above = F.max(F.when(F.col("priority") > p, F.col("end"))).over(ahead)
        next_start = F.min(F.when(F.col("priority") > p, F.col("start"))).over(behind)
        lost = lost | ((F.col("priority") == p) & ((F.coalesce(above, F.lit(-1)) > F.col("start")) | (F.coalesce(next_start, F.col("end")) < F.col("end"))))
    return placed.withColumn("lost", lost).where("not lost").drop("lost")


def scan(docs: DataFrame, table: list[Rule] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score for each row of docs.

    docs: doc_id, text; further columns are ignored. score is the highest confidence of the rules that fire, and at
    least 0.5 with a base phrase. Null and empty texts have no words, empty labels and score 0. Repeated rows get equal
    results. An empty table gives an empty one.
    """
    table = table or rules()
    base = base_places(docs)
    found = detections(unwrapped(docs, table), table).groupBy("key").agg(F.collect_set("label").alias("found"), F.max("confidence").alias("sure"))
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    labels = F.concat("base", F.coalesce("found", F.array().cast("array<string>")))
    score = F.greatest(F.coalesce("sure", F.lit(0.0)), F.when(F.col("n_base") > 0, F.lit(0.5)).otherwise(F.lit(0.0)))
    return base.join(found, "key", "left").select("doc_id", "n_words", "n_base", "first_word", "last_word", joined(F.col("base")).alias("base_labels"), joined(labels).alias("labels"), score.cast("double").alias("score"))
