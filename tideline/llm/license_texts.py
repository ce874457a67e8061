"""Published licence texts, in the forms in which documents hold them.

The folder ``licenses`` has one file per SPDX identifier, as published.  Of
each there are also its forms: without the part on how to apply it, with the
licensor's other addresses, with the usual titles, and on one line.
"""

from __future__ import annotations

import re
from importlib.resources import files

#: Where a licence ends and the part on how to apply it begins.
_APPENDIX = re.compile(r"END OF TERMS AND CONDITIONS|\n *How to Apply These Terms|\nExhibit A - |\nEXHIBIT A -|\n(How to use this License|ADDENDUM: How to use)")
#: A line that states a copyright, not one of running text that begins with the word.
_STATEMENT = re.compile(r"(?mi)^[ \t]*copyright[ \t]+(\(c\)|\[|[0-9])[^\n]*$")
_FSF = re.compile(r"51 Franklin St(?:reet)?, Fifth Floor, Boston,? MA\s+02110-1301,?\s+USA")
_FSF_ADDRESSES = (
    "51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA",
    "51 Franklin St, Fifth Floor, Boston, MA 02110-1301 USA",
    "59 Temple Place, Suite 330, Boston, MA 02111-1307 USA",
    "59 Temple Place - Suite 330, Boston, MA 02111-1307, USA",
    "675 Mass Ave, Cambridge, MA 02139, USA",
    "<https://fsf.org/>",
)
_TITLES = {
    "BSD-2-Clause": ("BSD 2-Clause License", 'BSD 2-Clause "Simplified" License', "The BSD 2-Clause License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License', "The BSD 3-Clause License", "BSD License", "New BSD License"),
    "Zlib": ("zlib License", "The zlib License", "The zlib/libpng License"),
    "Unlicense": ("The Unlicense",),
}
_GPL_ONLY = """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License version 2 as
published by the Free Software Foundation."""
#: Identifiers whose tag is known though they have no file: only the choice
#: of later versions differs, or the text is not at hand.
_TAGS = (
    "AGPL-3.0-only", "AGPL-3.0-or-later", "BSD-2-Clause", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "EPL-1.0", "EPL-2.0",
    "GFDL-1.2-or-later", "GFDL-1.3-or-later", "GPL-1.0-or-later", "GPL-2.0-or-later", "GPL-3.0-or-later",
    "LGPL-2.0-or-later", "LGPL-2.1-or-later", "LGPL-3.0-or-later", "ISC", "MIT", "0BSD",
)


def _bsd(text: str) -> list[tuple[str, str]]:
    """The BSD licences of two and three clauses from the University's."""
    found = [("BSD-3-Clause", text)]
    for owner, many, one in (
        ("copyright holder", "COPYRIGHT HOLDERS", "COPYRIGHT HOLDER"),
        ("copyright holder", "COPYRIGHT HOLDERS", "COPYRIGHT HOLDERS"),
        ("author", "AUTHOR", "AUTHOR"),
        ("University", "REGENTS", "REGENTS"),
    ):
        three = " ".join(text.split())
        three = three.replace("THE REGENTS AND", f"THE {many} AND").replace("THE REGENTS OR", f"THE {one} OR").replace("the University nor", f"the {owner} nor")
        two = re.sub(r"3\. Neither .*? permission\. ", "", three)
        found += [("BSD-3-Clause", three), ("BSD-2-Clause", two)]
    begin = "Redistribution and use"
    found = [(i, t[t.index(begin) :]) for i, t in found]
    return found + [(i, re.sub(r"(?<=[:.] )[123]\. (?=Redistributions|Neither)", "", " ".join(t.split()))) for i, t in found]


def _notices(license_id: str, text: str) -> list[tuple[str, str]]:
    """The notices that a licence tells to put into files, entire and their first paragraph."""
    found = []
    for notice in re.findall(r"(?s)\n *(This (?:program|library) is free\s+software.*?)\n\s*\n *(?:Also add|The hypothetical)", text):
        paragraphs = re.split(r"\n\s*\n", notice)
        for name, other in ((license_id, "General"), *((("LGPL-3.0-only", "Lesser General"), ("AGPL-3.0-only", "Affero General")) if license_id == "GPL-3.0-only" else ())):
            either = [p.replace("General Public", f"{other} Public") if name != license_id else p for p in paragraphs]
            later = name.replace("-only", "-or-later")
            found += [(later, "\n\n".join(either)), (later, either[0])]
    if license_id == "MPL-2.0":
        found += [(license_id, notice) for notice in re.findall(r"(?s)\n *(This Source Code Form is subject.*?MPL/2\.0/\.)", text)]
    return found


def _forms(license_id: str, text: str) -> list[str]:
    end = _APPENDIX.search(text)
    parts = [text]
    if end:
        parts += [text[: end.start()], text[: end.end()]] if end[0].startswith("END") else [text[: end.start()]]
    parts = [_FSF.sub(address, part) for part in parts for address in (_FSF_ADDRESSES if _FSF.search(part) else ("",))] + parts
    parts += [f"{title}\n{part}" for part in parts for title in _TITLES.get(license_id, ())]
    if license_id.startswith("BSD"):
        parts += [re.sub(r"(?=Redistribution and use)", "All rights reserved.\n", part, count=1) for part in parts]
    # Lines that begin with "copyright" are taken for statements; on one line none does.
    return [form for part in parts for form in (part, " ".join(_STATEMENT.sub(" ", part).split()), " ".join(part.split()))]


def published() -> list[tuple[str, str]]:
    """(SPDX identifier, text) of all known texts in all their forms."""
    texts = []
    for file in sorted(files("tideline.llm").joinpath("licenses").iterdir(), key=lambda f: f.name):
        license_id, text = file.name.removesuffix(".txt"), file.read_text("utf-8")
        texts += _bsd(text) if license_id == "BSD-3-Clause" else [(license_id, text), *_notices(license_id, text)]
    texts.append(("GPL-2.0-only", _GPL_ONLY))
    found = [(license_id, form) for license_id, text in texts for form in _forms(license_id, text)]
    ids = sorted({license_id for license_id, _ in texts} | set(_TAGS))
    return list(dict.fromkeys(found + [(license_id, f"SPDX-License-Identifier: {license_id}") for license_id in ids]))
