"""Licence texts of others, in the forms in which documents hold them."""

from __future__ import annotations

import re
import textwrap
from pathlib import Path

import duckdb
import pytest

from tests.llm import fixtures
from tideline.llm import license_scan

COMMON = Path("/usr/share/common-licenses")
IDS = {
    "Apache-2.0": "Apache-2.0", "BSD": "BSD-3-Clause", "CC0-1.0": "CC0-1.0", "GPL-1": "GPL-1.0-only", "GPL-2": "GPL-2.0-only",
    "GPL-3": "GPL-3.0-only", "LGPL-2.1": "LGPL-2.1-only", "LGPL-3": "LGPL-3.0-only", "MPL-2.0": "MPL-2.0", "Artistic": "Artistic-1.0-Perl",
}
BSD_2 = """BSD 2-Clause License

Copyright (c) 2021, Somebody Else
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""


def cases() -> dict[int, tuple[str, str]]:
    found = [("BSD-2-Clause", BSD_2)]
    for name, license_id in IDS.items():
        if (COMMON / name).exists():
            text = (COMMON / name).read_text("utf-8")
            found += [(license_id, text), (license_id, "\n".join(f"# {line}" for line in text.split("\n")))]
            if name in ("GPL-2", "GPL-3"):
                found.append((license_id, text[: text.index("How to Apply These Terms")]))
    notice = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version 3 of the Licence, or (at your option) any later version."
    for license_id, name in (("GPL-3.0-or-later", "General Public License"), ("AGPL-3.0-or-later", "Affero General Public License")):
        found.append((license_id, "\n".join(textwrap.wrap(notice.format(name), 60))))
    mpl = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    return dict(enumerate([*found, ("MPL-2.0", mpl)]))


def test_published_texts_are_found_whole(spark):
    known = cases()
    docs = fixtures.documents(spark, [fixtures.row(i, text) for i, (_, text) in known.items()])
    rows = license_scan.scan_licenses(docs).filter("unit = 'text'").collect()
    assert sorted((r["doc_id"], r["license_id"]) for r in rows) == [(i, license_id) for i, (license_id, _) in known.items()]


def wrapped(text: str, columns: int) -> str:
    """Each paragraph but notices of copyright wrapped anew."""
    parts = re.split(r"\n[ \t]*\n", text)
    return "\n\n".join(
        part if part.startswith("Copyright (c)") else textwrap.fill(" ".join(part.split()), columns, break_long_words=False, break_on_hyphens=False)
        for part in parts
    )


WRAPPED = {"MIT": license_scan._MIT, "ISC": license_scan._ISC, "BSD-2-Clause": BSD_2, "Apache-2.0": license_scan._APACHE_HEADER}


def test_texts_are_found_at_any_width(spark):
    cases = [(name, wrapped(text, columns)) for name, text in WRAPPED.items() for columns in range(40, 101, 3)]
    full = (COMMON / "Apache-2.0").read_text("utf-8")
    cases += [("Apache-2.0", wrapped(full, columns)) for columns in (44, 57, 72, 90)]
    head = "Copyright (c) 2020-2023 Some One <a@b.c>\n© Another\n\n"
    cases += [(name, head + wrapped(text, columns)) for name, text in WRAPPED.items() for columns in (44, 66, 88)]
    docs = fixtures.documents(spark, [fixtures.row(i, text) for i, (_, text) in enumerate(cases)])
    rows = license_scan.scan_licenses(docs).filter("unit = 'text'").collect()
    assert sorted((r["doc_id"], r["license_id"]) for r in rows) == [(i, name) for i, (name, _) in enumerate(cases)]


def test_repeated_words_are_all_respelled_and_a_notice_in_front_deletes_nothing(spark):
    known = [license_scan.License("x", "license license sub license sub license end"), license_scan.License("y", "copyright notice holders")]
    texts = [
        "Licence licence, sublicence; sub licence END", "Copyright\nnotice holders", "COPYRIGHT 1999 Me\ncopyright notice\nholders",
        "copyright (c) 2020 me " + license_scan._MIT.replace("\n", " "),
    ]
    docs = fixtures.documents(spark, [fixtures.row(i, text) for i, text in enumerate(texts)])
    for licenses in (known, spark.createDataFrame([(k.license_id, k.text) for k in known], "license_id string, text string")):
        rows = license_scan.scan_licenses(docs, licenses).filter("unit = 'text'").collect()
        assert sorted((r["doc_id"], r["license_id"]) for r in rows) == [(0, "x"), (1, "y"), (2, "y")]
    plain = docs.select("doc_id", license_scan.canonical(docs["text"]).alias("plain")).orderBy("doc_id").collect()
    assert plain[3]["plain"].startswith("copyright c 2020 me permission is hereby granted")


def test_published_texts_equal_the_sql(spark):
    docs = fixtures.documents(spark, fixtures.rows() + [fixtures.row(1000 + i, text) for i, (_, text) in cases().items()])
    db = duckdb.connect()
    db.register("documents", docs.select("doc_id", "text").toArrow())
    columns = ["doc_id", "unit", "position", "digest", "license_id"]
    expected = db.sql(f"select {', '.join(columns)} from ({license_scan.oracle_sql()})").fetchall()
    found = [tuple(r) for r in license_scan.scan_licenses(docs).select(columns).collect()]
    assert sorted(found) == sorted(expected)


@pytest.mark.parametrize(("one", "other"), [pair for pair in license_scan.SPELLINGS if not pair[0].startswith("copyright")])
def test_either_spelling_may_come_first(one, other):
    for known in (one, other):
        assert {one.split()[0], other.split()[0]} <= set(license_scan.first_words([license_scan.License("x", f"{known} text")]))
