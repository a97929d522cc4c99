"""Licence scans and sharding."""

import hashlib
import textwrap

from runfield.llm import extendible_sharding as X
from runfield.llm import license_scan as L
from tests.llm import helpers


def plain_shards(rows, limit):
    """Extendible hashing by splitting lists: {bits: rows}"""
    def bits(i):
        return f"{int(hashlib.md5(('' if i is None else str(i)).encode()).hexdigest()[:15], 16):060b}"

    done, open_ = {}, [("", rows)]
    while open_:
        prefix, members = open_.pop()
        if sum(n for _, n in members) <= limit or len(prefix) == 60:
            if members:
                done[prefix] = members
        else:
            open_ += [(prefix + b, [m for m in members if bits(m[0])[len(prefix)] == b]) for b in "01"]
    return {(i, n, prefix) for prefix, members in done.items() for i, n in members}


def test_shards_equal_splitting_by_hand(spark):
    docs = helpers.table(spark, "documents")
    rows = [(r["doc_id"], len(r["text"].encode())) for r in docs.collect()]
    for limit, step in ((20_000, 12), (20_000, 3), (10**9, 12), (0, 20)):
        got = X.shards(docs, limit, step).collect()
        assert {(r["doc_id"], r["n_bytes"], r["shard"]) for r in got} == plain_shards(rows, limit) and len(got) == len(rows)
        assert all((r["shard_bytes"] <= limit) != r["oversize"] for r in got)


def test_repeated_ids_stay_together_oversize(spark):
    docs = spark.createDataFrame([(7, "x" * 60)] * 3 + [(8, "y")], "doc_id long, text string")
    got = X.shards(docs, 100).collect()
    assert len(got) == 4 and all(r["oversize"] == (r["doc_id"] == 7) for r in got)


def test_sharding_odd_rows(spark):
    assert X.shards(helpers.odd(spark), 1000).count() == len(helpers.odd_rows())
    assert X.shards(helpers.none(spark)).count() == 0


def test_written_shards_hold_all_rows(spark, tmp_path):
    docs = helpers.odd(spark)
    X.write_shards(docs, f"file://{tmp_path}/out", 100_000)
    back = spark.read.parquet(f"file://{tmp_path}/out")
    assert back.count() == docs.count() and set(docs.columns) < set(back.columns)
    clash = docs.selectExpr("*", "doc_id AS _id", "'mine' AS _shard", "1 AS d", "2 AS w")
    X.write_shards(clash, f"file://{tmp_path}/clash", 100_000)
    back = spark.read.parquet(f"file://{tmp_path}/clash")
    assert set(back.columns) == {*clash.columns, "_shard_"} and {r["_shard"] for r in back.collect()} == {"mine"}
    assert back.where("_id <=> doc_id").count() == docs.count()


def test_statements_and_inheritance(spark):
    body = helpers.prose(100, 1)
    rows = [
        (1, "Released under the MIT License.", "repo/LICENSE"),
        (2, body, "repo/src/a.txt"),
        (3, body + "\nLicensed under the Apache License, Version 2.0.\n" + body, "repo/src/b.txt"),
        (4, "All rights reserved.", "repo/src/vendor/COPYING.txt"),
        (5, body, "repo/src/vendor/deep/er/c.txt"),
        (6, body, "other/d.txt"),
        (7, None, None),
        (8, body + " all rights", "repo/e.txt"),
        (9, "See the license in the file next to this one for more words", "free.txt"),
        (2, body, "repo/src/a.txt"),
    ]
    got = {r["doc_id"]: (r["license"], r["origin"], r["license_dir"]) for r in L.licenses(spark.createDataFrame(rows, "doc_id long, text string, path string")).collect()}
    assert got == {1: ("MIT", "own", None), 2: ("MIT", "inherited", "repo"), 3: ("Apache-2.0", "own", None), 4: ("Proprietary", "own", None), 5: ("Proprietary", "inherited", "repo/src/vendor"), 6: (None, "none", None), 7: (None, "none", None), 8: ("MIT", "inherited", "repo"), 9: (None, "none", None)}


def test_root_directory_licenses_all(spark):
    rows = [(1, "Licensed under CC BY-NC 4.0.", "LICENSE"), (2, "nothing", "a/b/c.txt"), (3, "nothing", "d.txt")]
    got = {r["doc_id"]: (r["license"], r["license_dir"]) for r in L.licenses(spark.createDataFrame(rows, "doc_id long, text string, path string")).collect()}
    assert got == {1: ("CC-BY-NC-4.0", None), 2: ("CC-BY-NC-4.0", ""), 3: ("CC-BY-NC-4.0", "")}


def test_notices_inside_lines_wrapped_and_spdx(spark):
    body = helpers.prose(60, 1)
    mit = L.NOTICES[5][1]
    bsd = L.NOTICES[6][1]
    texts = [
        ("// SPDX-License-Identifier: MIT\nint x;", "MIT"),
        ("# SPDX-License-Identifier: Apache-2.0\n" + body, "Apache-2.0"),
        ("/* SPDX-License-Identifier: GPL-2.0-or-later */", "GPL-2.0"),
        ("SPDX-License-Identifier: (MIT OR Zlib)", "(MIT OR Zlib)"),
        ("SPDX-License-Identifier: Zlib", "Zlib"),
        ("Copyright (c) 2024 Example Corporation. All rights reserved.", "Proprietary"),
        ("© 2024 Foo Inc. All rights reserved.\n" + body, "Proprietary"),
        ("# Copyright 2020 Jane Doe and others, see AUTHORS\n# This file is part of x and licensed under the MIT license (see LICENSE).\n" + body, "MIT"),
        (body + " Released under the MIT License. " + body, "MIT"),
        (mit.replace("\n", " "), "MIT"),
        ("\n".join("# " + x for x in textwrap.wrap(bsd, 72)) + "\n" + body, "BSD-3-Clause"),
        ("Copyright 1999 A. All rights reserved. " + bsd, "BSD-3-Clause"),
        ("\n".join(textwrap.wrap(L.NOTICES[7][1], 60)), "BSD-2-Clause"),
        ("it is licensed, as far as anyone here knows, under the GNU General\nPublic License, version 2, and " + body, "GPL-2.0"),
        (body + " The license of this is unknown, apache or mit. " + body, None),
        ("Our license to operate under the terms of the council", None),
    ]
    rows = [(i, t, f"{i}/x.txt") for i, (t, _) in enumerate(texts)]
    got = {r["doc_id"]: r for r in L.scanned(spark.createDataFrame(rows, "doc_id long, text string, path string")).collect()}
    assert [got[i]["own_license"] for i in range(len(texts))] == [name for _, name in texts]
    assert got[9]["license_file"] and got[12]["license_file"] and not got[8]["license_file"]


FREE = "This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU {} as published by\nthe Free Software Foundation; either version {} of the License, or\n(at your option) any later version."


def test_versions_and_variants_are_told_apart(spark):
    by = "This work is licensed under a Creative Commons Attribution{} 4.0 International License."
    texts = [
        (FREE.format("General Public License", "2"), "GPL-2.0"), (FREE.format("General Public License", "3"), "GPL-3.0"),
        (FREE.format("General Public License", "2").replace("\n", " "), "GPL-2.0"), (FREE.format("General Public License", "3").replace("\n", " "), "GPL-3.0"),
        (FREE.format("Lesser General Public License", "2.1"), "LGPL-2.1"), (FREE.format("Lesser General Public License", "2.1").replace("\n", " "), "LGPL-2.1"),
        (FREE.format("Lesser General Public License", "3"), "LGPL-3.0"), (FREE.format("Affero General Public License", "3").replace("\n", " "), "AGPL-3.0"),
        (by.format(""), "CC-BY-4.0"), (by.format("-ShareAlike"), "CC-BY-SA-4.0"), (by.format("-NonCommercial-NoDerivatives"), "CC-BY-NC-ND-4.0"),
        ("Licensed under CC BY-ND 4.0", "CC-BY-ND-4.0"), ("Licensed under CC BY 4.0", "CC-BY-4.0"),
        ("                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/", "Apache-2.0"),
        ("Copyright (c) 2024, Someone\nAll rights reserved.\n// SPDX-License-Identifier: MIT", "MIT"),
        ("This work is licensed under the GNU General Public License", None),
    ]
    docs = spark.createDataFrame([(i, t, f"d/{i}.txt") for i, (t, _) in enumerate(texts)], "doc_id long, text string, path string")
    got = {r["doc_id"]: r["own_license"] for r in L.scanned(docs).collect()}
    assert [got[i] for i in range(len(texts))] == [name for _, name in texts]


def test_notices_that_are_of_no_or_of_another_licence(spark):
    boost = "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"
    isc = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies."
    texts = [
        (f"Boost Software License - Version 1.0 - August 17th, 2003\n\n{boost} (the \"Software\") to use, reproduce, display", "BSL-1.0"), (boost, "BSL-1.0"),
        ("This file is not released under the MIT License.", None), ("This work isn't licensed under CC BY-NC 4.0.", None),
        ("This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License.", None),
        ("Licensed under either of Apache License, Version 2.0 or MIT license at your option.", None),
        ("we heard that all rights reserved for members of the club were lost, " + helpers.prose(30, 5), None),
        ("Copyright (c) 2021 A Company of a Long Name and Partners. All rights reserved.", "Proprietary"), ("All rights reserved.", "Proprietary"),
        ("Mozilla Public License Version 2.0\n==================================\n\n1. Definitions", "MPL-2.0"),
        ("Mozilla Public License Version 1.1", None), ("Eclipse Public License - v 2.0\n\n    THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS", "EPL-2.0"),
        (isc, "ISC"), ("Licensed under the Apache License, Version 1.1", None), ("Released under the MIT License.", "MIT"),
    ]
    docs = spark.createDataFrame([(i, t, f"f/{i}.txt") for i, (t, _) in enumerate(texts)], "doc_id long, text string, path string")
    got = {r["doc_id"]: r["own_license"] for r in L.scanned(docs).collect()}
    assert [(texts[i][0], got[i]) for i in range(len(texts))] == texts


def test_a_long_text_with_a_cue(spark):
    docs = spark.createDataFrame([(1, helpers.prose(60_000, 6) + "\nReleased under the MIT License.\n" + "license " * 3000, "a.txt")], "doc_id long, text string, path string")
    assert L.scanned(docs).first()["own_license"] == "MIT"


def test_many_licensed_directories(spark):
    names = ["MIT", "Apache-2.0", "GPL-2.0"]
    rows, want = [], {}
    for d in range(60):
        if d % 3:
            rows.append((10_000 + d, f"SPDX-License-Identifier: {names[d % 3]}", f"top/{d}/LICENSE"))
        for k in range(5):
            rows.append((d * 10 + k, helpers.prose(20, k), f"top/{d}/a/b{k}/file.txt"))
            want[d * 10 + k] = (names[d % 3], f"top/{d}") if d % 3 else (None, None)
    got = {r["doc_id"]: (r["license"], r["license_dir"]) for r in L.licenses(spark.createDataFrame(rows, "doc_id long, text string, path string")).collect()}
    assert {k: got[k] for k in want} == want


def test_a_path_of_the_input_is_kept(spark):
    docs = spark.createDataFrame([(1, "x", "own/path.txt")], "doc_id long, text string, path string")
    assert L.documents_with_paths(docs).first()["path"] == "own/path.txt"


def test_a_hot_directory_is_split(spark):
    hot = "concat(if(id % 2 = 0, 'hot', concat('d', cast(id % 20000 as string))), '/', cast(id as string), '.txt')"
    found = spark.range(60_000).selectExpr("id AS doc_id", f"{hot} AS path", "if(id % 20000 < 2, 'MIT', cast(null as string)) AS own_license", "1.0D AS cosine", "id % 20000 < 2 AS license_file")
    changed = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k", "spark.sql.shuffle.partitions": "20"}
    before = {k: spark.conf.get(k) for k in changed}
    try:
        for k, v in changed.items():
            spark.conf.set(k, v)
        out = L.inherited(found)
        rows = out.collect()
        assert len(rows) == 60_000 and sum(r["origin"] == "inherited" for r in rows) > 29_000
        assert "skew=true" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_license_odd_rows(spark):
    for docs in (helpers.odd(spark), helpers.none(spark)):
        assert L.licenses(L.documents_with_paths(docs)).count() == docs.count()


def test_scan_plan_has_no_python(spark):
    plan = L.scanned(L.documents_with_paths(helpers.table(spark, "documents")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
