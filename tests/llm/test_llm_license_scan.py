import textwrap
import time

from compare import assert_same, connect
from edge_cases import TEXTS, documents, empty

from entitymill.llm import license_scan as s


def licenses(spark, *texts):
    got = s.scan_licenses(documents(spark, list(enumerate(texts)))).collect()
    return [r.licenses for r in sorted(got, key=lambda r: r.doc_id)]


def whole(*names, join=" "):
    return join.join(s.SENTENCES[n] for n in names)


def test_sequences_and_order_of_rules(spark):
    mit = ["mitGrant", "mitNotice", "mitAsIs", "mitLiable"]
    bsd = ["bsdUse", "bsdSource", "bsdBinary", "bsdEndorse"]
    assert licenses(
        spark,
        whole(*mit, join="\n\n"),
        "Some code.\n" + textwrap.indent(textwrap.fill(whole("mitGrant"), 70), "# ") + "\n\n" + whole("mitNotice"),
        whole(*bsd, join="\n\n"),
        whole(*bsd[:3], join="\n\n"),
        whole("bsdSource", "bsdBinary"),
        whole("iscGrant") + "\n\n" + whole("iscAsIs"),
        "NO END\n" + whole("mitShort") + "\nnext | line " + whole("ccByNcShort") + "\n" + whole("ccByNcShort"),
        whole("apacheShort", "gpl3Short").upper(),
        "Licensed under the Apache License, Version 2.0.1.",
        "licensed",
    ) == ["MIT", "MIT", "BSD-3-Clause", "BSD-2-Clause", "", "ISC", "MIT,CC-BY-NC-4.0", "Apache-2.0,GPL-3.0-only", "", ""]


def wrapped(*names, first="", indent=""):
    return textwrap.fill(" ".join(s.SENTENCES[n] for n in names), 72, initial_indent=first, subsequent_indent=indent)


def test_wrapped_texts(spark):
    items = ["bsdSource", "bsdBinary", "bsdEndorse"]

    def bsd(*marks, gap="\n"):
        listed = [wrapped(n, first=m, indent="   ") for n, m in zip(items, marks, strict=False)]
        return gap.join(["Copyright (c) 2020, Foo", wrapped("bsdUse"), *listed])

    apache = "\n\n".join(
        [
            wrapped("apacheHeader") + "\nYou may obtain a copy of the License at",
            "    http://www.apache.org/licenses/LICENSE-2.0",
            wrapped("apacheAsIs", "apacheSee"),
        ]
    )
    mit = wrapped("mitGrant") + "\n\n" + wrapped("mitNotice") + "\n\n" + wrapped("mitAsIs", "mitLiable")
    texts = {
        bsd("* ", "* ", "* "): "BSD-3-Clause",
        bsd("1. ", "2. ", "3. ", gap="\n\n"): "BSD-3-Clause",
        bsd("(a) ", "(b) "): "BSD-2-Clause",
        textwrap.indent(bsd("1) ", "2) ", "3) "), " * ", lambda line: True): "BSD-3-Clause",
        bsd("* ", "* ").replace("\n", "\r\n"): "BSD-2-Clause",
        " * ".join(s.SENTENCES[n] for n in ("bsdUse", "bsdSource", "bsdBinary")): "BSD-2-Clause",
        "MIT License\nCopyright (c) 2020 Foo\n" + mit: "MIT",
        mit + "\n" + apache: "MIT,Apache-2.0",
        apache + "\nno mark here\n" + wrapped("iscGrant"): "Apache-2.0,ISC",
        textwrap.indent(apache, "// ", lambda line: True): "Apache-2.0",
        "This work is licensed under the GNU General Public License, version\n3. Foo": "GPL-3.0-only",
        "Licensed under the Apache License, Version 2.0\n" + wrapped("apacheHeader")[47:]: "Apache-2.0",
        "Redistributions of source code must\nnot retain the above copyright notice": "",
    }
    assert licenses(spark, *texts) == list(texts.values())
    apache_codes = s.scan_licenses(documents(spark, [(1, apache)])).first()
    assert (apache_codes.n_sentences, apache_codes.n_rules) == (4, 1)


def test_every_sentence_is_recognised_alone(spark):
    names = list(s.SENTENCES)
    got = s.scan_licenses(documents(spark, [(i, f"A word.\n{s.SENTENCES[n]}\nAnother.") for i, n in enumerate(names)])).collect()
    codes = {r.doc_id: r.codes for r in got}
    assert len(set(codes.values())) == len(names) and all(len(c.strip('-')) == 2 for c in codes.values())


REAL = {
    # Headers as they stand in files.
    """Copyright 2021 Example Inc. All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are
met:

   * Redistributions of source code must retain the above copyright
notice, this list of conditions and the following disclaimer.
   * Redistributions in binary form must reproduce the above
copyright notice, this list of conditions and the following disclaimer
in the documentation and/or other materials provided with the
distribution.
   * Neither the name of Example Inc. nor the names of its
contributors may be used to endorse or promote products derived from
this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS
"AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR
A PARTICULAR PURPOSE ARE DISCLAIMED.
""": "BSD-3-Clause",
    """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at http://mozilla.org/MPL/2.0/. */
int main() {}
""": "MPL-2.0",
    """# Permission to use, copy, modify, and/or distribute this software for any
# purpose with or without fee is hereby granted, provided that the above
# copyright notice and this permission notice appear in all copies.
#
# THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
# WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
# MERCHANTABILITY AND FITNESS.
""": "ISC",
    """ * This library is free software; you can redistribute it and/or
 * modify it under the terms of the GNU Lesser General Public
 * License as published by the Free Software Foundation; either
 * version 2.1 of the License, or (at your option) any later version.
 *
 * This library is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU
 * Lesser General Public License for more details.
""": "LGPL-2.1-or-later",
    """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU Affero General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU Affero General Public License for more details.
""": "AGPL-3.0-or-later",
    """// This program is free software; you can redistribute it and/or modify
// it under the terms of the GNU General Public License version 2 as
// published by the Free Software Foundation.
""": "GPL-2.0-only",
    "# SPDX-License-Identifier: GPL-2.0-only\nx = 1\n": "GPL-2.0-only",
    "// SPDX-License-Identifier: MIT OR Apache-2.0\nfn main() {}\n": "MIT OR Apache-2.0",
}


def test_real_headers(spark):
    assert licenses(spark, *REAL) == list(REAL.values())


def test_unknown_text_parts_a_sequence(spark):
    grant, notice = s.SENTENCES["mitGrant"], s.SENTENCES["mitNotice"]
    texts = [f"{grant}\n\n{notice}", f"{grant}\n\nAnother sentence. {notice}", f"{grant}\n" + "Some words here.\n" * 3000 + notice]
    assert licenses(spark, *texts) == ["MIT", "", ""]
    codes = [r.codes for r in s.scan_licenses(documents(spark, list(enumerate(["Words. " + t + " Words." for t in texts])))).orderBy("doc_id").collect()]
    a, b = (s._catalogue(s.SENTENCES, s.RULES)[0][s.plain(x)] for x in (grant, notice))
    assert codes == [f"-{a}{b}-", f"-{a}-{b}-", f"-{a}-{b}-"]


def test_more_sentences_than_letters(spark):
    many = {f"n{i}": f"Licence number {i} applies." for i in range(300)}
    rules = [(f"L-{i}", [f"n{i}"]) for i in range(300)]
    docs = documents(spark, [(i, f"Words. Licence number {i} applies. Words.") for i in range(0, 300, 37)])
    got = {r.doc_id: r.licenses for r in s.scan_licenses(docs, sentences=many, rules=rules).collect()}
    assert got == {i: f"L-{i}" for i in range(0, 300, 37)}


def test_long_runs_take_linear_time(spark):
    texts = [m * 60_000 + "a licence" for m in ("-", "- ", "|", "| ", "\n", ".", ") ", "(a", "1) ")]
    docs = documents(spark, list(enumerate(texts))).coalesce(1).persist()
    docs.count()
    start = time.perf_counter()
    assert {r.licenses for r in s.scan_licenses(docs).collect()} == {""}
    assert time.perf_counter() - start < 60


def test_edge_rows_equal_the_sql(spark):
    rows = [*TEXTS, (30, whole("mitShort")), (30, whole("mitShort")), (31, "İLicen ſe K warranty. " + whole("mitShort")), (32, "\n".join(s.SENTENCES.values()) * 20)]
    got = s.scan_licenses(documents(spark, rows)).toPandas()
    con = connect("/nowhere")
    frame = documents(spark, rows).select("doc_id", "text").toPandas()
    con.register("docs", frame)
    con.execute("create view documents as select cast(doc_id as bigint) as doc_id, text from docs")
    want = con.execute(s.license_sql()).df()
    for d in (got, want):
        d["doc_id"] = d["doc_id"].astype("float64")
    assert_same(got, want)
    assert s.scan_licenses(empty(spark)).count() == 0


def test_only_dataframe_functions(spark):
    plan = s.scan_licenses(documents(spark))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_query(spark):
    import __spark_entry__ as contract

    folder = "/root/testdata/sf0.001"
    got = contract.queries()["op1_license_scan"](spark, folder).toPandas()
    assert_same(got, connect(folder).execute(contract.oracle_sql()["op1_license_scan"]).df())
    assert (got["licenses"] != "").sum() > 0
