"""License scan by canonical digests of entire texts.

A licence is recognised by what it says, not how it is set: case, punctuation,
white space, copyright lines and equivalent spellings are normalised away, and
the digest of what is left is looked up among the digests of known licences,
which went the same way.  The units that are looked up whole are a document,
its blocks between blank lines, and its lines.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import LOWER, UPPER, ascii_lower, stored
from tideline.llm.license_texts import published

#: Known texts up to which their digests are broadcast (about 100 bytes each).
BROADCAST_LICENSES = 100_000


@dataclass(frozen=True)
class License:
    """A known text and the SPDX identifier it stands for."""

    license_id: str
    text: str


# Notices and short licence texts as their owners publish them.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND
FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR
OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE."""
_APACHE_HEADER = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
KNOWN = (
    License("MIT", _MIT),
    License("MIT", "MIT License\n" + _MIT),
    License("MIT", "The MIT License (MIT)\n" + _MIT),
    License("ISC", _ISC),
    License("ISC", "ISC License\n" + _ISC),
    License("Apache-2.0", _APACHE_HEADER),
    License("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    License("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    License("MIT", "Released under the MIT License."),
    License("MIT", "Licensed under the MIT License."),
    License("MIT", "SPDX-License-Identifier: MIT"),
    License("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    License("GPL-3.0-only", "Licensed under the GNU General Public License, version 3."),
    License("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    License("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    License("CC-BY-NC-4.0", "This work is licensed under CC BY-NC 4.0."),
    License("CC-BY-4.0", "Licensed under CC BY 4.0."),
    License("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"),
    *(License(*known) for known in published()),
)
#: Spellings that licence matching holds to be equal, after lower-casing.
SPELLINGS = (
    ("licence", "license"),
    ("sublicence", "sublicense"),
    ("sub license", "sublicense"),
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("analyse", "analyze"),
    ("artefact", "artifact"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("calibre", "caliber"),
    ("cancelled", "canceled"),
    ("capitalisations", "capitalizations"),
    ("catalogue", "catalog"),
    ("categorise", "categorize"),
    ("centre", "center"),
    ("copyright owner", "copyright holder"),
    ("copyright owners", "copyright holders"),
    ("emphasised", "emphasized"),
    ("favour", "favor"),
    ("favourite", "favorite"),
    ("fulfil", "fulfill"),
    ("fulfilment", "fulfillment"),
    ("https", "http"),
    ("initialise", "initialize"),
    ("judgement", "judgment"),
    ("labelling", "labeling"),
    ("labour", "labor"),
    ("maximise", "maximize"),
    ("modelled", "modeled"),
    ("modelling", "modeling"),
    ("offence", "offense"),
    ("optimise", "optimize"),
    ("organisation", "organization"),
    ("organise", "organize"),
    ("practise", "practice"),
    ("programme", "program"),
    ("realise", "realize"),
    ("recognise", "recognize"),
    ("signalling", "signaling"),
    ("utilisation", "utilization"),
    ("whilst", "while"),
    ("wilful", "willful"),
    ("per cent", "percent"),
    ("noncommercial", "non commercial"),
)
#: A line that only says who holds the copyright: after the word come a sign, a
#: year, a place for one, or "by"; the sign (c) alone needs a year.  Running text that a wrap begins with the word
#: is none of these, and neither is a line that goes on into the licence.
COPYRIGHT_LINE = r"^[ \t#*/;-]*(copyright[ \t,:]*(\(c\)|©|\[|<|\{|[0-9]|by )|\(c\)([ \t]*copyright|[^\n]{0,80}[12][0-9]{3})|©)[^\n]{0,160}$"
#: All but ASCII letters, digits, line feeds and what is not ASCII.
NO_LETTER = r"[\x00-\x09\x0B-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Around a line's end; between blocks, which lines without a word part; between lines.
LINE_END, BLOCK_END, LINE_ENDS = " *\n *", "\n\n+", "\n+"


def plain_lines(text: Column) -> Column:
    """Lower case, no copyright lines, words apart by two blanks, lines kept.

    Each word has blanks of its own, so that neighbours can both be respelled.
    """
    # (?d): only line feeds end lines, as in RE2.
    plain = F.regexp_replace(ascii_lower(text), "(?dm)" + COPYRIGHT_LINE, " ")
    return F.btrim(F.regexp_replace(F.regexp_replace(plain, NO_LETTER, "  "), LINE_END, "\n"))


def one_line(plain: Column) -> Column:
    return F.regexp_replace(F.btrim(plain, F.lit("\n")), LINE_ENDS, "  ")


def one_spelling(line: Column) -> Column:
    """Words apart by one blank, in one spelling."""
    line = F.concat(F.lit(" "), line, F.lit(" "))
    for one, other in SPELLINGS:
        line = F.replace(line, F.lit(spaced(one)), F.lit(spaced(other)))
    return F.btrim(F.replace(line, F.lit("  "), F.lit(" ")))


def spaced(words: str) -> str:
    return f" {words.replace(' ', '  ')} "


def canonical(text: Column) -> Column:
    """Lower case, no copyright lines, words apart by one blank, one spelling."""
    return one_spelling(one_line(plain_lines(text)))


def first_words(licenses: Sequence[License]) -> list[str]:
    """Every word, in any spelling, that a text equal to a known one can begin with."""
    known = (re.sub("(?m)" + COPYRIGHT_LINE, " ", k.text.translate(str.maketrans(UPPER, LOWER))) for k in licenses)
    found = {re.sub(NO_LETTER, " ", text).replace("\n", " ").strip(" ").partition(" ")[0] for text in known} - {""}
    pairs = [{one.split()[0], other.split()[0]} for one, other in SPELLINGS]
    while more := set().union(*(pair for pair in pairs if pair & found)) - found:
        found |= more
    return sorted(found)


def known_digests(known: DataFrame) -> DataFrame:
    """digest and license_id of every known text (license_id, text); the least
    id of equal texts."""
    digests = known.select(F.sha2(canonical(F.col("text")).cast("binary"), 256).alias("digest"), "license_id")
    return digests.filter(F.col("digest") != F.sha2(F.lit("").cast("binary"), 256)).groupBy("digest").agg(F.min("license_id").alias("license_id"))


def units_of(plain: Column, first: Sequence[str] | None) -> Column:
    """An array of (kind, position, digest): the text, its blocks, its lines.

    All are cut from ``plain_lines`` of the text, which is made once.  Blocks
    and lines are units of their own only if there is more than one.  Units
    that begin with none of the ``first`` words are left out: the many
    spellings are looked for in the others alone.
    """

    def digested(parts: Column, kind: str) -> Column:
        found = F.transform(parts, lambda part, i: F.struct(i.alias("position"), one_line(part).alias("line")))
        if first is not None:
            found = F.filter(found, lambda x: F.substring_index(x["line"], " ", 1).isin(*first))
        return F.transform(
            found,
            lambda x: F.struct(
                F.lit(kind).alias("kind"),
                x["position"].alias("position"),
                F.sha2(one_spelling(x["line"]).cast("binary"), 256).alias("digest"),
            ),
        )

    def several(parts: Column) -> Column:
        return F.when(F.size(parts) > 1, parts).otherwise(F.slice(parts, 1, 0))

    blocks, lines = several(F.split(plain, BLOCK_END)), several(F.split(plain, "\n"))
    return F.concat(digested(F.array(plain), "text"), digested(blocks, "block"), digested(lines, "line"))


def scan_licenses(
    docs: DataFrame, licenses: Sequence[License] | DataFrame = KNOWN, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """doc_id, unit (text, block or line), position, digest, license_id.

    One row for each unit that, entire, is a known licence text.  Positions
    count from 0; blocks end where a line has no word or only says who holds
    the copyright.  ``licenses`` are known texts, or a table of any size with
    license_id and text.  Null or empty texts are no licence; very long ones
    are scanned whole.  Repeated rows give repeated results; an empty table
    gives none; other columns are ignored.

    Up to ``BROADCAST_LICENSES`` digests of known texts are broadcast; beyond,
    the join is left to Spark.
    """
    if isinstance(licenses, DataFrame):
        texts, first = licenses.select("license_id", "text"), None
    else:
        rows = [(k.license_id, k.text) for k in licenses]
        texts, first = docs.sparkSession.createDataFrame(rows, "license_id string, text string"), first_words(licenses)
    known = stored(known_digests(texts))
    plain = docs.select(docs[doc_id].alias("doc_id"), plain_lines(F.coalesce(docs[text], F.lit(""))).alias("plain"))
    units = plain.select("doc_id", F.explode(units_of(F.col("plain"), first)).alias("unit"))
    flat = units.select(
        "doc_id",
        F.col("unit.kind").alias("unit"),
        F.col("unit.position").cast("long").alias("position"),
        F.col("unit.digest").alias("digest"),
    )
    few = known.count() <= BROADCAST_LICENSES
    return flat.join(F.broadcast(known) if few else known, "digest").select(
        "doc_id", "unit", "position", "digest", "license_id"
    )


def oracle_sql(licenses: Sequence[License] = KNOWN) -> str:
    """The scan of table ``documents`` in DuckDB's SQL."""

    def quoted(value: str) -> str:
        return "'" + value.replace("'", "''") + "'"

    def plain(value: str) -> str:
        out = f"regexp_replace(translate({value}, '{UPPER}', '{LOWER}'), {quoted('(?m)' + COPYRIGHT_LINE)}, ' ', 'g')"
        return f"trim(regexp_replace(regexp_replace({out}, {quoted(NO_LETTER)}, '  ', 'g'), {quoted(LINE_END)}, chr(10), 'g'), ' ')"

    def digest(value: str) -> str:
        out = f"' ' || regexp_replace(trim({value}, chr(10)), {quoted(LINE_ENDS)}, '  ', 'g') || ' '"
        for one, other in SPELLINGS:
            out = f"replace({out}, {quoted(spaced(one))}, {quoted(spaced(other))})"
        return f"sha256(trim(replace({out}, '  ', ' '), ' '))"

    def cells(parts: str, kind: str) -> str:
        one = f"list_transform({parts}, lambda x, i: struct_pack(unit := '{kind}', position := i - 1, digest := {digest('x')}))"
        return f"case when len({parts}) > 1 then {one} else [] end"

    values = ", ".join(f"({quoted(k.license_id)}, {quoted(k.text)})" for k in licenses)
    blocks, lines = f"regexp_split_to_array(body, {quoted(BLOCK_END)})", "string_split(body, chr(10))"
    whole = f"[struct_pack(unit := 'text', position := 0::bigint, digest := {digest('body')})]"
    return f"""
        with known as (
            select digest, min(license_id) as license_id
            from (select license_id, {digest(plain("text"))} as digest from (values {values}) v(license_id, text))
            where digest <> sha256('') group by digest),
        d as (select doc_id, {plain("coalesce(text, '')")} as body from documents),
        u as (select doc_id, unnest({whole} || {cells(blocks, "block")} || {cells(lines, "line")}) as u from d)
        select doc_id, u.unit as unit, u.position::bigint as position, u.digest as digest, license_id
        from u join known on u.digest = known.digest"""
