import hashlib
import zlib

import pytest
from cases import documents, empty_documents, odd_rows
from pyspark.sql import functions as F

from replyscope.llm import licenses, line_dedup, toxicity


def test_lines_against_brute_force(spark):
    rows = odd_rows() + [
        (20, "The same long line, in all of them.\nshort\nAnother line that is only here, once.\n"),
        (21, "x\nthe  same LONG line,\tin all of them.  \nThe same long line, in all of them."),
        (19, "THE SAME LONG LINE, IN ALL OF THEM.\n\n\nshort\n"),
        (22, "short\nshort\nÉtroit et long, mais pas le même.\nétroit et long, mais pas le même.\n"),
    ]
    units = []
    for n, (d, t, _) in enumerate([(*r, None)[:3] for r in rows]):
        units += [((d is None, d or 0, lo), n, lo, hi, norm) for lo, hi, norm in line_dedup.units((t or "").encode(), 24)]
    first = {}
    for rank, n, lo, _, norm in sorted(units, key=lambda u: u[0]):
        first.setdefault(norm, (rows[n][:2], lo))
    want = []
    for n, r in enumerate(rows):
        t = (r[1] or "").encode()
        gone = [(lo, hi) for _, m, lo, hi, norm in units if m == n and first[norm] != (r[:2], lo)]
        kept = b"".join(t[a:b] for a, b in zip([0, *(h for _, h in gone)], [*(lo for lo, _ in gone), len(t)]))
        want.append((r[0], len(t), sum(h - lo for lo, h in gone), len(gone), gone, hashlib.sha256(kept).hexdigest()))
    got = line_dedup.digest(line_dedup.remove_lines(documents(spark, rows), min_bytes=24)).collect()
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, [tuple(s) for s in r.removed], r.kept_sha256) for r in got]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert line_dedup.remove_lines(empty_documents(spark)).count() == 0


def test_passages_are_counted_apart(spark):
    """Runs of neighbouring lines of over 20 words together that all stand elsewhere too, the earliest holder's as well; short ones do not count."""
    long, other, half, rest = (" ".join(f"{c}{i}" for i in range(n)) for c, n in (("a", 21), ("b", 60), ("c", 11), ("d", 10)))
    rows = [
        (1, f"{long}\nshort"), (2, f"x\n{long.upper()}\n{other}\nshort"), (3, f"{half}\n{rest}\nown line"), (4, f"{half}\n\n{rest}\nshort"),
        (5, f"{long}\n{long}"), (6, None), (6, None), (7, f"{rest}\nmine\n{half}\n{rest}"),
    ]
    got = {r.doc_id: (r.shared_passages, r.removed_passages) for r in line_dedup.digest(line_dedup.remove_lines(documents(spark, rows))).collect()}
    n, both = len(long) + 1, len(half) + len(rest) + 2
    first = n + len("short")  # the line "short" is next to the long one
    assert got == {1: (first, 0), 2: (n, n), 3: (both, 0), 4: (0, 0), 5: (2 * n - 1, 2 * n - 1), 6: (0, 0), 7: (both - 1, both - 1)}


def test_every_line_but_empty_ones_is_a_unit(spark, tmp_path):
    import duckdb

    from replyscope.llm.registry import QUERIES, SQL

    rows = [(1, "Les.\nown\n\n \t\nx"), (2, "x\n\nles. \n}\n}"), (3, "}"), (4, " \t\n\n"), (5, "É\né\nÉ"), (6, None)]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in QUERIES["op6_line_dedup"](spark, str(tmp_path)).collect()}
    kept = {1: "Les.\nown\n\n \t\nx", 2: "\n}\n", 3: "", 4: " \t\n\n", 5: "É\né\n", 6: ""}
    assert {d: r.kept_sha256 for d, r in got.items()} == {d: hashlib.sha256(t.encode()).hexdigest() for d, t in kept.items()}
    assert [tuple(s) for s in got[2].removed] == [(0, 2), (3, 9), (11, 12)]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    twin = con.execute(f"SELECT doc_id, n_removed, kept_sha256 FROM ({SQL['op6_line_dedup']})").fetchall()
    assert sorted(twin) == sorted((d, r.n_removed, r.kept_sha256) for d, r in got.items())


def test_license_sequences(spark):
    apache = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance."""
    header = (
        'Licensed under the Apache License, Version 2.0 (the "License").\nYou may not use this file except in compliance with the License.\n'
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0.\n" + licenses.SENTENCES["apache-2-basis"].capitalize() + "."
    )
    rows = [
        (1, "Some text. Released under the MIT License. More text."), (2, header), (3, "This work is licensed under the GNU General Public License, version 3."),
        (4, licenses.SENTENCES["mit-notice"]), (5, "Released under the MIT License.\nLicensed under CC BY-NC 4.0.\nReleased under the MIT license!"), (6, apache), (7, None), (8, ""),
    ]
    got = {r.doc_id: r for r in licenses.license_scan(documents(spark, rows)).collect()}
    assert got[1].licenses == ["MIT"] and got[2].licenses == ["Apache-2.0"] and len(got[2].sentence_ids) == 4 and got[2].unmatched == []
    assert got[3].licenses == ["GPL-3.0"] and got[4].licenses == [] and got[4].unmatched == ["mit-notice"]
    assert got[5].licenses == ["MIT", "CC-BY-NC-4.0"] and got[5].sentence_ids == ["mit-released", "cc-by-nc-4", "mit-released"]
    assert all(got[i].licenses == [] and got[i].sentence_ids == [] for i in (6, 7, 8))
    assert licenses.license_scan(empty_documents(spark)).count() == 0
    assert licenses.license_scan(documents(spark, odd_rows())).count() == len(odd_rows())


MIT = """MIT License

Copyright (c) 2020 Some Body

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND
"""
APACHE = """Copyright 2020 Some Body

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
GPL = """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation; either version 2 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.
"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
CLAUSE = """3. Neither the name of the {} nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
"""


def test_wrapped_license_texts(spark):
    texts = {"MIT": MIT, "Apache-2.0": APACHE, "GPL-2.0-or-later": GPL, "BSD-2-Clause": BSD, "BSD-3-Clause": BSD + CLAUSE.format("copyright holder"), "MPL-2.0": MPL}
    texts["GPL-3.0-or-later"] = GPL.replace("software;", "software:").replace("version 2", "version 3")
    rows, want = [], {}
    for name, t in texts.items():
        lines = t.split("\n")
        layouts = [t, t.replace("\n", "\r\n"), "\n\n".join(" ".join(x.split()) for x in t.split("\n\n")), *("".join(m + x + "\n" for x in lines) for m in (" * ", "// ", "# ", "; ", "dnl ", "REM "))]
        for layout in layouts:
            want[len(rows)] = [name]
            rows.append((len(rows), layout))
    bsd = [
        (BSD + CLAUSE.format("University of X, Y and Z"), "BSD-3-Clause"), (BSD.replace("1.", "(a)").replace("2.", "b)") + CLAUSE.format("x").replace("3.", "* "), "BSD-3-Clause"),
        (BSD + "3. All advertising materials mentioning features or use of this software\n   must display the following acknowledgement:\n   x\n" + CLAUSE.format("x"), "BSD-4-Clause"),
        (BSD + "3. The name of the author may not be used to endorse or promote products\nderived from this software without specific prior written permission.", "BSD-3-Clause"),
    ]
    bsd.append((BSD.replace("disclaimer.", "disclaimer;").replace("distribution.", "distribution; and") + CLAUSE.format("x"), "BSD-3-Clause"))
    bsd.append((" ".join(bsd[-1][0].split()), "BSD-3-Clause"))
    notes = [("A heading\nLicensed under CC BY-NC 4.0\nmore text", "CC-BY-NC-4.0"), ("x y\nReleased under the\nMIT License\nz", "MIT")]
    for t, name in bsd + notes:
        want[len(rows)] = [name]
        rows.append((len(rows), t))
    for t in ("It is not released under the MIT License.", "Released under the MIT License of old.", "Released under\nthe old MIT License", "Released under the MIT License; not so."):
        want[len(rows)] = []
        rows.append((len(rows), t))
    got = {r.doc_id: r for r in licenses.license_scan(documents(spark, rows)).collect()}
    assert {i: r.licenses for i, r in got.items()} == want
    assert all(r.unmatched == [] for r in got.values())


def test_triggers_bear_any_space(spark):
    warranty = licenses.SENTENCES["gpl-warranty"]
    rows = [(i, warranty.replace("this program", x) + ".") for i, x in enumerate(("this  program", "This\tprogram", "this\nprogram", '"this" program'))]
    assert all(r.sentence_ids == ["gpl-warranty"] for r in licenses.license_scan(documents(spark, rows)).collect())
    assert not any(t.split() != [t] for t in licenses.TRIGGERS)


def test_license_tables():
    assert all(any(t in s for t in licenses.TRIGGERS) for s in licenses.SENTENCES.values())
    assert all(i in licenses.SENTENCES for _, run in licenses.RULES for i in run)


def test_license_scan_stays_in_the_jvm(spark):
    plan = licenses.license_scan(documents(spark, [(1, "x")]))._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = toxicity.score_documents(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) for r in out)
    hit = [r.predicted for r in out if r.toxic == 1]
    false = [r.predicted for r in out if r.toxic == 0]
    assert sum(hit) / len(hit) > 0.5 and sum(false) / len(false) < 0.03


@pytest.fixture(scope="module")
def model():
    import random

    rng = random.Random(3)
    plain = [" ".join(rng.choice(["river", "stone", "walks", "under", "green", "light"]) for _ in range(40)) for _ in range(120)]
    bad = [" ".join(rng.choice(["river", "stone", "walks", "under", "zorkish", "blorgen"]) for _ in range(40)) for _ in range(120)]
    return toxicity.fit([t.encode() for t in bad], [t.encode() for t in plain]), plain, bad


def test_toxicity_of_separable_classes(model):
    m, plain, bad = model
    assert (m.scores([t.encode() for t in bad]) > 0.5).mean() > 0.95 and (m.scores([t.encode() for t in plain]) < 0.5).mean() > 0.95
    assert 0 <= m.scores([b""])[0] < 0.5 and m.scores([b"river stone"])[0] < 0.5


def test_toxicity_sample_has_one_row_of_an_id(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda toxic, ordinary, *a: seen.append((toxic, ordinary)))
    ids = [i for i in range(1, 60) if zlib.crc32(str(i).encode()) % 5]
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, toxic int")
    rows = [(ids[0], f"copy {n}") for n in range(300)] + [(i, f"text {i}") for i in ids[1:]]
    for order in (rows, rows[::-1]):
        toxicity.train(documents(spark, order), labels, per_class=len(ids))
    for toxic, ordinary in seen:
        texts = sorted(toxic + ordinary)
        assert sum(t.startswith(b"copy") for t in texts) == 1 and len(texts) == len(ids)
        assert {t for t in texts if t.startswith(b"text")} == {f"text {i}".encode() for i in ids[1:]}
    assert seen[0] == seen[1]


NOTICES = {
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS.""",
    "LGPL-2.1-or-later": """ * This library is free software; you can redistribute it and/or
 * modify it under the terms of the GNU Lesser General Public
 * License as published by the Free Software Foundation; either
 * version 2.1 of the License, or (at your option) any later version.
 *
 * This library is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.""",
    "LGPL-3.0-or-later": """This file is free software: you can redistribute it and/or modify it under
the terms of the GNU Lesser General Public License as published by the Free
Software Foundation, either version 3 of the License, or (at your option) any
later version.""",
    "AGPL-3.0-or-later": """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU Affero General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.
#
# This program is distributed in the hope that it will be useful,
# but WITHOUT ANY WARRANTY; without even the implied warranty of
# MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.""",
    "EPL-2.0": """This program and the accompanying materials are made available under the
terms of the Eclipse Public License 2.0 which is available at
https://www.eclipse.org/legal/epl-2.0/""",
    "EPL-1.0": """All rights reserved. This program and the accompanying materials
are made available under the terms of the Eclipse Public License v1.0
which accompanies this distribution, and is available at
http://www.eclipse.org/legal/epl-v10.html""",
    "Zlib": """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented;""",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "Artistic-2.0": """This program is free software; you can redistribute it and/or modify it
under the terms of the the Artistic License (2.0). You may obtain a copy""",
    "BSL-1.0": """//          Copyright Some Body 2008 - 2013.
// Distributed under the Boost Software License, Version 1.0.
//    (See accompanying file LICENSE_1_0.txt or copy at
//          http://www.boost.org/LICENSE_1_0.txt)""",
}


def test_notices_of_many_licences(spark):
    rows = [(i, f"{t}\n\nint main() {{}}\n") for i, t in enumerate(NOTICES.values())]
    rows += [(100, "\n\n".join(NOTICES.values())), (101, "They redistribute it freely and are liable for the unencumbered estate.")]
    got = {r.doc_id: r for r in licenses.license_scan(documents(spark, rows)).collect()}
    assert {i: list(got[i].licenses) for i in range(len(NOTICES))} == {i: [n] for i, n in enumerate(NOTICES)}
    assert all(not got[i].unmatched for i in got) and set(got[100].licenses) == set(NOTICES) and not got[101].licenses


def test_every_sentence_holds_a_trigger_and_is_in_a_rule():
    assert all(any(t in s for t in licenses.TRIGGERS) for s in licenses.SENTENCES.values())
    used = {i for _, run in licenses.RULES for i in run}
    assert used <= set(licenses.SENTENCES) and all(s == " ".join(s.split()) for s in licenses.SENTENCES.values())


def plain_score(m, text):
    """The score of one text from the model's dictionaries and plane, window by window."""
    import math
    import re

    import zstandard as zstd

    params = dict(window_log=17, hash_log=17, chain_log=17, search_log=1, min_match=6, strategy=zstd.STRATEGY_DFAST, format=zstd.FORMAT_ZSTD1_MAGICLESS, write_checksum=0, write_content_size=0, write_dict_id=0)

    def packed(front, window):
        d = zstd.ZstdCompressionDict(front, dict_type=zstd.DICT_TYPE_RAWCONTENT)
        return len(zstd.ZstdCompressor(dict_data=d, compression_params=zstd.ZstdCompressionParameters(**params)).compress(window))

    w = re.findall(rb"[a-z0-9\x80-\xff]+", re.sub(rb"[A-Z]", lambda c: c[0].lower(), text))
    saved = []
    for i in range(0, len(w), m.words):
        window = b" " + b" ".join(w[i : i + m.words]) + b" "
        zeros = b"\0" * ((24 - len(m.toxic) % 24) % 24)
        saved.append(packed(m.ordinary, window) - packed(zeros + m.toxic + m.ordinary, window))
    top = [max(x, 0) for x in (sorted(saved, reverse=True) + [0, 0, 0])[:3]]
    return 1 / (1 + math.exp(-sum(a * b for a, b in zip(m.plane, [*top, math.log1p(len(saved)), 1]))))


def test_toxicity_scores_against_plain_version(spark):
    """Every score of the query's own path, with null, empty and very long texts."""
    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    m = toxicity.train(docs, labels)
    assert m.plane and len(m.plane) == 5
    texts = [r.text for r in docs.limit(60).collect()]
    long = " ".join(t for t in texts if t)[:200_000]
    rows = [(i, t) for i, t in enumerate([*texts, None, "", " \n", "\x00 \x00", long, "word " * 20_000])]
    got = {r.doc_id: r.s for r in documents(spark, rows).select("doc_id", toxicity.toxicity(m).alias("s")).collect()}
    want = {i: plain_score(m, (t or "").encode()) for i, t in rows}
    assert max(abs(got[i] - want[i]) for i in want) < 1e-12 and len(got) == len(rows)
    same = {r.doc_id: r.score for r in toxicity.score_documents(docs, labels).collect()}
    assert all(abs(same[r.doc_id] - plain_score(m, (r.text or "").encode())) < 1e-12 for r in docs.orderBy("doc_id").limit(40).collect())


def test_toxicity_odd_rows(spark, model):
    m = model[0]
    got = documents(spark, odd_rows()).select("doc_id", toxicity.toxicity(m).alias("s")).collect()
    assert len(got) == len(odd_rows()) and all(0 <= r.s <= 1 for r in got)
    docs = documents(spark, odd_rows())
    for labels in ([], [(4, 1), (None, 1), (5, None), (8, 0), (8, 1)]):
        out = toxicity.score_documents(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert out.count() == len(odd_rows()) and out.where("predicted = 1 or score is null").count() == 0
    assert toxicity.score_documents(empty_documents(spark), spark.createDataFrame([], "doc_id long, toxic int")).count() == 0
    assert docs.select(toxicity.held_out(F.col("doc_id")).alias("h")).where("h is null").count() == 0
