"""Licence scans: TF-IDF cosine of licence statements to templates, then inheritance from the nearest directory.

Lines with a licensing cue are a text's statements; where there are several, all of them together are one more. Each is
compared with short templates of licence notices. Terms are runs of a-z and 0-9 (A-Z lower-cased). Idf is taken over the
templates; a term of no template has the greatest idf and counts once for each occurrence. An SPDX identifier names the
text's own licence; else the best template with a cosine of ``least_cosine`` or more does, unless a template of another
licence is within ``MARGIN`` of it. A licence that has a version needs its number in the statement, and some have terms that
they never hold (``NEEDS``, ``BANS``). Statements that say what a text is not, or that name licences of two families, count
for nothing, and "all rights reserved" only alone in its line or with a sign of copyright.

A text with a cue that has none of these, and no such statement, is looked at again: windows of the length of each notice of
``NOTICES`` are compared with it by the same cosine, wherever the notice stands in longer lines or is wrapped. Windows are
laid over the text's terms so that one of the notice's key terms meets its place in the notice, and must hold all its key
terms (a name, a version) and none of those that make it another licence. The longest notice found counts, then the
greatest cosine; "all rights reserved" only if it is the only one.

A licence file is one named as such, or whose matched statements hold at least half of its words; it licenses its directory.
Of all other texts, those without a licence of their own take that of the nearest directory above them that has one.

Scale: DataFrame operations only. Whole texts are searched where they are scanned; only (doc_id, path, licence) goes on.
Inheritance is decided for directories, of which there are far fewer than files, by equality joins of each directory with
its ancestors; files then join their directory. A directory with very many files is one key of a join whose other side, a
written table, has one row for it, so Spark's skew join splits it.

Defined cases: a null or empty text has no statement; a very long text is searched whole, in lists of its terms only if it has
a cue; a null path is in no directory (and inherits nothing); of several
licence files in a directory, that of greatest cosine counts, then the least path; templates that tie go by the order
below; repeated rows are each given back; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runfield.sources.shared import written

LEAST_COSINE = 0.7
#: How much less the cosine of the next licence must be.
MARGIN = 0.01
#: Short notices by which these licences are declared; the first of a tie counts.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-2.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or any later version"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License, version 2"),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3"),
    ("LGPL-3.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or any later version"),
    ("LGPL-2.1", "This library is licensed under the GNU Lesser General Public License, version 2.1"),
    ("LGPL-2.1", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or any later version"),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3"),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    ("CC-BY-NC-ND-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0"),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0"),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0"),
    ("CC0-1.0", "CC0 1.0 Universal Public Domain Dedication"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0"),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003"),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("ISC", "Released under the ISC License"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("EPL-2.0", "Eclipse Public License - v 2.0"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software"),
    ("Proprietary", "All rights reserved"),
]
#: Terms without which a statement is not of a licence, for licences that differ from others in little else; GNU ones: see ``needs``.
NEEDS = {
    "Apache-2.0": "apache 2", "MPL-2.0": "mozilla 2", "BSL-1.0": "", "EPL-2.0": "eclipse 2", "CC0-1.0": "cc0 1", "CC-BY-4.0": "4", "CC-BY-SA-4.0": "4", "CC-BY-NC-4.0": "4", "CC-BY-ND-4.0": "4",
    "CC-BY-NC-SA-4.0": "4", "CC-BY-NC-ND-4.0": "4", "BSD-3-Clause": "redistribution source binary",
}
#: Terms that a statement of MIT's permission, or of any other Boost's, does not have.
BANS = {"MIT": "organization accompanying"}
#: Names of families; a statement that has two is an offer of either, or a list, and no licence of the text.
FAMILIES = "apache mit gnu mozilla bsd creative boost isc eclipse zlib".split()
#: A statement that says what a text is not.
NEGATED = r"\b(not|never|isn.t|aren.t) ((yet|being|currently|intended|meant|to|be|made) )*(re)?(licen[cs]ed|leased|available|distributed|covered|under)\b|\bno licen[cs]e\b"
#: "All rights reserved" tells of a licence alone in its line, or with a sign of copyright.
SIGNED = r"copyright|\(c\)|©|^[^a-z0-9]*all rights reserved[^a-z0-9]*$"
_RESERVED = r"(copyright|\(c\)|©)[^\n]*all rights reserved|all rights reserved[^\n]*(copyright|\(c\)|©)|(^|\n)[^a-z0-9\n]*all rights reserved[^a-z0-9\n]*(\n|$)"
#: Fixed values for the second look: licence, notice, key terms (all needed), terms of other licences (none allowed).
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_AS_IS = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
_FREE = "{} is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version"
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0", "apache 2", ""),
    ("Apache-2.0", "Apache License Version 2.0, January 2004", "apache 2", ""),
    ("MIT", "Released under the MIT License", "under mit license", ""),
    ("MIT", "Licensed under the MIT license", "under mit license", ""),
    ("MIT", _MIT, "permission granted charge software documentation", BANS["MIT"]),
    ("MIT", _MIT + ' (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.', "permission granted sublicense noninfringement", BANS["MIT"]),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "redistribution source binary modification conditions", ""),
    ("BSD-2-Clause", _BSD + " " + _AS_IS, "redistribution retain reproduce warranties", "neither endorse"),
    ("BSD-3-Clause", _BSD + " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _AS_IS, "redistribution retain reproduce endorse", ""),
    *((f"{short}-{v}" if "." in v else f"{short}-{v}.0", text, f"{keys} {v.replace('.', ' ')}", bans) for short, name, keys, bans, versions in (
        ("GPL", "General Public License", "gnu general public", "lesser affero library", ("2", "3")),
        ("LGPL", "Lesser General Public License", "gnu lesser public", "affero", ("2.1", "3")),
        ("AGPL", "Affero General Public License", "gnu affero public", "lesser", ("3",)),
    ) for v in versions for text in (
        f"licensed under the GNU {name}, version {v}",
        f"GNU {name} Version {v}",
        _FREE.format("This program", name, v),
    )),
    ("MPL-2.0", "subject to the terms of the Mozilla Public License, v. 2.0", "mozilla 2", ""),
    *((f"CC-{k}-4.0", text, keys, bans) for k, more in (("BY", ""), ("BY-SA", "ShareAlike"), ("BY-NC", "NonCommercial"), ("BY-ND", "NoDerivatives"), ("BY-NC-SA", "NonCommercial-ShareAlike"), ("BY-NC-ND", "NonCommercial-NoDerivatives")) for text, keys, bans in (
        (f"licensed under a Creative Commons Attribution{'-' * bool(more)}{more} 4.0 International License", f"creative commons attribution 4 {more.lower().replace('-', ' ')}".strip(), " ".join(w for w in ("sharealike", "noncommercial", "noderivatives", "noderivs") if w not in more.lower())),
        (f"licensed under CC {k} 4.0", f"cc 4 {k.lower().replace('-', ' ')}", " ".join(w for w in ("sa", "nc", "nd") if w not in k.lower().split("-"))),
    )),
    ("CC0-1.0", "CC0 1.0 Universal Public Domain Dedication", "cc0 universal", ""),
    ("Unlicense", "This is free and unencumbered software released into the public domain", "unencumbered public domain", ""),
    ("Proprietary", "All rights reserved", "all rights reserved", ""),
]
#: Identifiers of the second look that go by another name here; all others are named as they are written.
SPDX = {f"{k.lower()}-{v}{end}": f"{k}-{v}" for k in ("GPL", "LGPL", "AGPL") for v in ("2.0", "2.1", "3.0") for end in ("", "+", "-only", "-or-later")} | {n.lower(): n for n in dict.fromkeys(n for n, *_ in NOTICES) if n != "Proprietary"}
IDENTIFIER = r"(?i)spdx-license-identifier:[ \t]*(\(?[a-z0-9][a-z0-9.+-]*\)?(?:[ \t]+(?:or|and|with)[ \t]+\(?[a-z0-9][a-z0-9.+-]*\)?)*)"
CUES = r"licen[cs]|copyright|rights reserved|public domain|spdx|permission is hereby|hereby granted|free software|unencumbered|redistribut"
FILE_NAMES = r"(^|/)(license|licence|copying|notice|unlicense)(\.[a-z]+)?$"
UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def needs(name: str) -> list[str]:
    """Terms without which a statement is not of this licence: those of NEEDS, and the version's numbers of GNU licences."""
    version = re.search(r"GPL-(\d)\.(\d)", name)
    return [x for x in version.groups() if x != "0"] if version else NEEDS.get(name, "").split()


def bans(name: str) -> list[str]:
    """Terms that a statement of this licence does not have."""
    return BANS.get(name, "").split()


def template_vectors() -> tuple[dict[str, float], float, list[tuple[str, float, list[tuple[str, float]]]]]:
    """Idf by term, the idf of other terms, and for each template its licence, norm and weights."""
    counts = [Counter(re.findall("[a-z0-9]+", text.lower())) for _, text in TEMPLATES]
    df = Counter(t for c in counts for t in c)
    idf = {t: math.log((1 + len(counts)) / (1 + n)) + 1 for t, n in sorted(df.items())}
    vectors = [[(t, n * idf[t]) for t, n in c.items()] for c in counts]
    return idf, math.log(1 + len(counts)) + 1, [(name, math.sqrt(sum(w * w for _, w in v)), v) for (name, _), v in zip(TEMPLATES, vectors, strict=True)]


def _total(array: Column, value) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda s, x: s + value(x))


def _matches(statements: Column) -> Column:
    """For each statement, (cosine, order, licence, words, rival): its best template, and the best cosine of another licence."""
    idf, other, templates = template_vectors()
    array = lambda items: f"array({', '.join(items)})"
    pairs = lambda items: array(f"struct('{t}' AS t, {w!r}D AS w)" for t, w in items)
    terms_of = lambda items: array(map(repr, items)) if items else "cast(array() as array<string>)"
    marks = F.expr(array(map(repr, [*FAMILIES, *(t for name in BANS for t in bans(name))])))
    families = F.expr(array(map(repr, FAMILIES)))
    vocabulary, weights = F.expr(array(f"'{t}'" for t in idf)), F.expr(pairs(idf.items()))
    vectors = F.expr(array(f"struct({-i} AS i, '{name}' AS name, {norm!r}D AS norm, {terms_of(needs(name))} AS needs, {terms_of(bans(name))} AS bans, {pairs((t, w * idf[t]) for t, w in v)} AS v)" for i, (name, norm, v) in enumerate(templates)))

    def of(statement: Column) -> Column:
        terms = F.regexp_extract_all(statement, F.lit("[a-z0-9]+"), 0)
        known = F.filter(terms, lambda t: F.array_contains(vocabulary, t))
        return F.struct(known.alias("known"), F.size(terms).alias("n"), F.array_intersect(terms, marks).alias("marks"), statement.rlike(SIGNED).alias("signed"))

    def best(s: Column) -> Column:
        known = s["known"]
        count = lambda t: F.size(F.filter(known, lambda x: x == t)).cast("double")
        norm = F.sqrt(_total(F.filter(weights, lambda w: F.array_contains(known, w["t"])), lambda w: F.pow(count(w["t"]) * w["w"], 2)) + F.lit(other * other) * (s["n"] - F.size(known)))
        apt = F.filter(vectors, lambda v: F.forall(v["needs"], lambda t: F.array_contains(known, t)) & ~F.arrays_overlap(v["bans"], s["marks"]) & ((v["name"] != "Proprietary") | s["signed"]))
        cosines = F.transform(apt, lambda v: F.struct(F.round(_total(v["v"], lambda w: count(w["t"]) * w["w"]) / (norm * v["norm"]), 6).alias("cosine"), v["i"].alias("order"), v["name"].alias("license"), s["n"].alias("words")))

        def with_rival(each: Column) -> Column:
            top = F.array_max(each)
            rival = F.array_max(F.transform(F.filter(each, lambda x: x["license"] != top["license"]), lambda x: x["cosine"]))
            return F.struct(top["cosine"].alias("cosine"), top["order"].alias("order"), top["license"].alias("license"), top["words"].alias("words"), rival.alias("rival"))

        return F.transform(F.array(cosines), with_rival)[0]

    clear = F.filter(F.transform(F.filter(statements, lambda x: ~x.rlike(NEGATED)), of), lambda s: (F.size(s["known"]) > 0) & (F.size(F.array_intersect(s["marks"], families)) < 2))
    return F.filter(F.transform(clear, best), lambda m: m["license"].isNotNull())


def _barred(low: Column) -> Column:
    """Whether a lower-cased text says what it is not, or names several licences in one line; it is then not looked at again."""
    several = F.exists(F.split(low, "\n"), lambda x: x.rlike(CUES) & (F.size(F.filter(F.expr(f"array({', '.join(map(repr, FAMILIES))})"), lambda f: F.array_contains(F.regexp_extract_all(x, F.lit("[a-z0-9]+"), 0), f))) > 1))
    return low.rlike(NEGATED) | several


def _noticed(terms: Column, least_cosine: float, reserved: Column) -> Column:
    """(general, words, cosine, order, licence) of the notice found among the terms of a text; null if there is none.

    ``reserved``: whether "all rights reserved" counts.
    """
    split = lambda text: re.findall("[a-z0-9]+", text.lower())
    counts = [Counter(split(text)) for _, text, *_ in NOTICES]
    df = Counter(t for c in counts for t in c)
    idf = {t: math.log((1 + len(counts)) / (1 + n)) + 1 for t, n in sorted(df.items())}
    other = math.log(1 + len(counts)) + 1
    array = lambda items: f"array({', '.join(items)})"
    words = lambda items: f"{array(repr(t) for t in items)}" if items else "cast(array() as array<string>)"
    notices = []
    for i, ((name, text, keys, bans), c) in enumerate(zip(NOTICES, counts, strict=True)):
        own = split(text)
        norm = math.sqrt(sum((n * idf[t]) ** 2 for t, n in c.items()))
        places = array(f"struct('{t}' AS t, {k} AS o)" for k, t in enumerate(own) if t in keys.split())
        vector = array(f"struct('{t}' AS t, {n * idf[t] * idf[t]!r}D AS w)" for t, n in c.items())
        notices.append(f"struct({-i} AS i, '{name}' AS name, {norm!r}D AS norm, {len(own)} AS len, {places} AS places, {words(keys.split())} AS keys, {words(bans.split())} AS bans, {vector} AS v)")
    keys = sorted({t for _, _, k, _ in NOTICES for t in k.split()})
    known, weights = F.expr(words(idf)), F.expr(array(f"{w!r}D" for w in idf.values()))
    squared = lambda t: F.pow(F.coalesce(F.try_element_at(weights, F.nullif(F.array_position(known, t), F.lit(0)).cast("int")), F.lit(other)), 2)
    # Where key terms stand; a key term that a text repeats without end stands at each of its places, one window each.
    spots = F.filter(F.transform(terms, lambda t, i: F.struct(t.alias("t"), i.alias("i"))), lambda s: F.array_contains(F.expr(words(keys)), s["t"]))

    def windows(t: Column, at: Column, v: Column) -> Column:
        laid = F.flatten(F.transform(at, lambda s: F.transform(F.filter(v["places"], lambda p: p["t"] == s["t"]), lambda p: F.greatest(s["i"] - p["o"], F.lit(0)))))
        cut = F.transform(F.array_distinct(laid), lambda a: F.slice(t, a + 1, v["len"]))
        return F.filter(cut, lambda w: F.forall(v["keys"], lambda k: F.array_contains(w, k)) & ~F.arrays_overlap(w, v["bans"]))

    def scored(w: Column, v: Column) -> Column:
        count = lambda t: F.size(F.filter(w, lambda x: x == t)).cast("double")
        norm = F.sqrt(_total(F.array_distinct(w), lambda t: F.pow(count(t), 2) * squared(t)))
        cosine = F.round(_total(v["v"], lambda x: count(x["t"]) * x["w"]) / (norm * v["norm"]), 6)
        return F.struct((v["name"] != "Proprietary").alias("general"), F.size(w).alias("words"), cosine.alias("cosine"), v["i"].alias("order"), v["name"].alias("license"))

    def found(pair: Column) -> Column:
        each = F.transform(F.expr(array(notices)), lambda v: F.transform(windows(pair["t"], pair["at"], v), lambda w: scored(w, v)))
        return F.array_max(F.filter(F.flatten(each), lambda x: (x["cosine"] >= least_cosine) & (x["general"] | reserved)))

    # One-element arrays bind terms and spots once.
    return F.transform(F.array(F.struct(terms.alias("t"), spots.alias("at"))), found)[0]


def _identified(text: Column) -> Column:
    """The licence that the first SPDX identifier of a text names; null without one."""
    written_id = F.nullif(F.regexp_extract(text, IDENTIFIER, 1), F.lit(""))
    names = F.create_map(*(F.lit(x) for pair in sorted(SPDX.items()) for x in pair))
    return F.coalesce(F.try_element_at(names, F.lower(written_id)), written_id)


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "path", least_cosine: float = LEAST_COSINE) -> DataFrame:
    """doc_id, path, own_license, cosine (of the best statement, 0 without one), license_file: a row for each of ``docs``."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(path_col).cast("string").alias("path"), F.col(text_col).cast("string").alias("text"), F.translate(F.col(text_col).cast("string"), UPPER, SMALL).alias("low"))
    # Texts without a cue take the short way: they are not split into lines.
    lines = F.when(F.col("low").rlike(CUES), F.filter(F.split("low", "\n"), lambda x: x.rlike(CUES)))
    rows = rows.select("doc_id", "path", "text", "low", lines.alias("lines"), F.when(F.col("low").rlike(CUES), F.size(F.filter(F.split("low", "[^a-z0-9]+"), lambda w: w != ""))).alias("n_terms"))
    statements = F.when(F.size("lines") > 1, F.concat("lines", F.array(F.concat_ws(" ", "lines")))).otherwise(F.col("lines"))
    rows = rows.select("doc_id", "path", "text", "low", "n_terms", F.when(F.col("lines").isNotNull(), _matches(statements)).alias("m"))
    top = F.array_max("m")
    rows = rows.select("doc_id", "path", "text", "low", "n_terms", F.coalesce(top["cosine"], F.lit(0.0)).alias("cosine"), F.when(top["rival"] <= top["cosine"] - MARGIN, top["license"]).alias("name"), top["words"].alias("words"))
    # The second look is at texts with a cue only that have no identifier and whose statements are like no one licence.
    rows = rows.withColumn("spdx", F.when(F.col("n_terms").isNotNull(), _identified(F.col("text"))))
    again = F.col("n_terms").isNotNull() & F.col("spdx").isNull() & (F.col("name").isNull() | (F.col("cosine") < least_cosine))
    again = again & ~_barred(F.col("low"))
    rows = rows.withColumn("notice", F.when(again, _noticed(F.regexp_extract_all("low", F.lit("[a-z0-9]+"), 0), least_cosine, F.col("low").rlike(_RESERVED))))
    rows = rows.select("doc_id", "path", "n_terms", F.when(F.col("spdx").isNotNull(), 1.0).otherwise(F.coalesce("notice.cosine", "cosine")).alias("cosine"), F.coalesce("spdx", "notice.license", "name").alias("name"), F.coalesce("notice.words", "words").alias("words"))
    own = F.when(F.col("cosine") >= least_cosine, F.col("name"))
    named = F.coalesce(F.lower("path").rlike(FILE_NAMES), F.lit(False))
    return rows.select("doc_id", "path", own.alias("own_license"), "cosine", (own.isNotNull() & (named | F.coalesce(2 * F.col("words") >= F.col("n_terms"), F.lit(False)))).alias("license_file"))


def _parent(path: Column) -> Column:
    """The directory of a path without slash at its end; '' for the root, null for the root itself and for null."""
    return F.when(path == "", None).otherwise(F.regexp_replace(path, "/?[^/]*$", ""))


def inherited(found: DataFrame) -> DataFrame:
    """``scanned`` rows with license, origin (own, inherited, none) and license_dir (the directory inherited from)."""
    found = written(found.withColumn("dir", _parent(F.col("path"))), "licences")
    licensed = found.where("license_file and dir is not null").groupBy("dir").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "path", "own_license")).alias("first"))
    licensed = written(licensed.select(F.col("dir").alias("above"), F.col("first.own_license").alias("dir_license")), "licensed-directories")
    dirs = found.select("dir").where("dir is not null").distinct()
    parts = F.split("dir", "/")
    ancestors = F.transform(F.sequence(F.lit(0), F.when(F.col("dir") == "", 0).otherwise(F.size(parts))), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, 1, k), "/").alias("above")))
    climbs = dirs.select("dir", F.explode(ancestors).alias("a")).select("dir", "a.depth", "a.above")
    nearest = climbs.join(licensed, "above").groupBy("dir").agg(F.max(F.struct("depth", "above", "dir_license")).alias("n")).select("dir", F.col("n.above").alias("license_dir"), F.col("n.dir_license").alias("dir_license"))
    out = found.join(written(nearest, "nearest"), "dir", "left")
    takes = F.col("own_license").isNull() & F.col("dir_license").isNotNull()
    return out.select("doc_id", "path", "own_license", "cosine", "license_file", F.coalesce("own_license", "dir_license").alias("license"), F.when(F.col("own_license").isNotNull(), "own").when(takes, "inherited").otherwise("none").alias("origin"), F.when(takes, F.col("license_dir")).alias("license_dir"))


def licenses(docs: DataFrame, **options) -> DataFrame:
    """The licence of every row of ``docs`` (doc_id, text, path), by its own statements or its nearest licensed directory."""
    return inherited(scanned(docs, **options))


def documents_with_paths(documents: DataFrame) -> DataFrame:
    """``documents`` laid out as files: source / thousands of ids / hundreds of ids / id.txt; as they are if they have a path."""
    if "path" in {c.lower() for c in documents.columns}:
        return documents
    part = lambda n: F.floor(F.col("doc_id") / n).cast("string")
    return documents.withColumn("path", F.concat_ws("/", F.coalesce("source", F.lit("unknown")), part(1000), part(100), F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))))
