"""Licence scans by sentence rules: known sentences become identifiers, identifier sequences match ordered rules."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_GPL = "you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, {}"
_MIT_GRANT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions'
_MIT_NOTICE = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"
_LATER = "either version {} of the License, or (at your option) any later version"
#: Sentences of public licences and their usual notices, with an identifier each.
SENTENCES = (
    # Apache
    ("Licensed under the Apache License, Version 2.0", "ApacheLine"),
    ('Licensed under the Apache License, Version 2.0 (the "License")', "ApacheLicensed"),
    ('Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License', "ApacheHeader"),
    ("you may not use this file except in compliance with the License", "ApacheComply"),
    ("You may obtain a copy of the License at", "ApacheCopy"),
    ("You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "ApacheCopy"),
    ("You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0", "ApacheCopy"),
    ('Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied', "ApacheAsIs"),
    ("See the License for the specific language governing permissions and limitations under the License", "ApacheSee"),
    # MIT
    ("Released under the MIT License", "MitLine"),
    ("Licensed under the MIT License", "MitLine"),
    ("This project is licensed under the MIT License", "MitLine"),
    (_MIT_GRANT, "MitGrant"),
    (_MIT_NOTICE, "MitNotice"),
    (f"{_MIT_GRANT}: {_MIT_NOTICE}", "MitGrantNotice"),
    ('THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT', "MitAsIs"),
    ("IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE", "MitLiability"),
    # BSD
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "BsdGrant"),
    ("Redistributions of source code must retain the above copyright notice", "BsdSource"),
    ("Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer", "BsdSource"),
    ("Redistributions in binary form must reproduce the above copyright notice", "BsdBinary"),
    ("Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution", "BsdBinary"),
    ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "BsdEndorse"),
    ('THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED', "BsdAsIs"),
    # GNU
    ("This work is licensed under the GNU General Public License version 3", "Gpl3Line"),
    *((f"This {what} is free software: " + _GPL.format("General Public License", _LATER.format(v)), f"Gpl{v}OrLater") for what in ("program", "file", "library") for v in (2, 3)),
    *((_GPL.format("General Public License", _LATER.format(v)), f"Gpl{v}OrLater") for v in (2, 3)),
    ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation", "Gpl2Only"),
    ("This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE", "GplNoWarranty"),
    *((f"This {what} is free software; " + _GPL.format("Lesser General Public License", _LATER.format(v)), f"Lgpl{v}OrLater") for what in ("program", "library") for v in ("2.1", "3")),
    *((_GPL.format("Lesser General Public License", _LATER.format(v)), f"Lgpl{v}OrLater") for v in ("2.1", "3")),
    ("This program is free software: " + _GPL.format("Affero General Public License", _LATER.format(3)), "Agpl3OrLater"),
    (_GPL.format("Affero General Public License", _LATER.format(3)), "Agpl3OrLater"),
    # Mozilla, ISC, others; the full stop of "v. 2.0" ends a sentence.
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v", "MplSubject"),
    ("If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/", "MplCopy"),
    ("If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/", "MplCopy"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", "IscGrant"),
    ("Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", "IscGrant"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "ZeroGrant"),
    ('THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS', "IscAsIs"),
    ("This is free and unencumbered software released into the public domain", "Unlicense"),
    ("Distributed under the Boost Software License, Version 1.0", "Boost"),
    # Creative Commons
    ("Licensed under CC BY 4.0", "CcBy4"),
    ("Licensed under CC BY-SA 4.0", "CcBySa4"),
    ("Licensed under CC BY-NC 4.0", "CcByNc4"),
    *((f"This work is licensed under {a} Creative Commons {name} 4.0 International License", i) for a in ("a", "the") for name, i in (("Attribution", "CcBy4"), ("Attribution-ShareAlike", "CcBySa4"), ("Attribution-NonCommercial", "CcByNc4"))),
    *((f"This work is licensed under {name} 4.0", i) for name, i in (("CC BY", "CcBy4"), ("CC BY-SA", "CcBySa4"), ("CC BY-NC", "CcByNc4"))),
    ("All rights reserved", "AllRights"),
)
#: Identifiers that the tag SPDX-License-Identifier may name.
TAGS = ("0BSD", "AGPL-3.0-or-later", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-or-later", "ISC", "LGPL-2.1-or-later", "LGPL-3.0-or-later", "MIT", "MPL-2.0", "Unlicense")
#: Rules in order, a licence and the sequence of identifiers that states it.  The first that fits at a place wins.
RULES = (
    ("BSD-3-Clause", ("BsdGrant", "BsdSource", "BsdBinary", "BsdEndorse")),
    ("BSD-2-Clause", ("BsdGrant", "BsdSource", "BsdBinary")),
    ("MIT", ("MitGrant", "MitNotice", "MitAsIs", "MitLiability")),
    ("MIT", ("MitGrant", "MitNotice")),
    ("MIT", ("MitGrantNotice",)),
    ("Apache-2.0", ("ApacheHeader", "ApacheCopy")),
    ("Apache-2.0", ("ApacheLicensed", "ApacheComply", "ApacheCopy")),
    ("Apache-2.0", ("ApacheHeader",)),
    ("Apache-2.0", ("ApacheLicensed",)),
    ("Apache-2.0", ("ApacheLine",)),
    ("ISC", ("IscGrant", "IscAsIs")),
    ("ISC", ("IscGrant",)),
    ("0BSD", ("ZeroGrant", "IscAsIs")),
    ("MPL-2.0", ("MplSubject", "MplCopy")),
    ("AGPL-3.0-or-later", ("Agpl3OrLater",)),
    ("GPL-2.0-only", ("Gpl2Only",)),
    ("GPL-2.0-or-later", ("Gpl2OrLater",)),
    ("GPL-3.0-or-later", ("Gpl3OrLater",)),
    ("GPL-3.0", ("Gpl3Line",)),
    ("LGPL-2.1-or-later", ("Lgpl2.1OrLater",)),
    ("LGPL-3.0-or-later", ("Lgpl3OrLater",)),
    ("MIT", ("MitLine",)),
    ("BSL-1.0", ("Boost",)),
    ("Unlicense", ("Unlicense",)),
    ("CC-BY-NC-4.0", ("CcByNc4",)),
    ("CC-BY-SA-4.0", ("CcBySa4",)),
    ("CC-BY-4.0", ("CcBy4",)),
    *((tag, (f"Spdx:{tag}",)) for tag in TAGS),
    ("All-Rights-Reserved", ("AllRights",)),
)
#: Patterns of what ends a sentence and what to put there, a mark: a full stop, exclamation or question mark before white
#: space; a colon at the end of a line or before a numbered item; a blank line.
END = "\x1e"
BREAKS = (
    (r"([.!?])([\x20\x09-\x0D])", rf"\1{END}\2"),
    (r":([\x20\x09\x0B-\x0D]*\n)", rf"{END}\1"),
    (r":([\x20\x09-\x0D]+\(?[0-9]+[.)])", rf"{END}\1"),
    (r"\n[\x20\x09\x0B-\x0D]*\n", END),
)


def plain(sentence: str) -> str:
    """Letters a-z and digits with single spaces between runs of them, A-Z lower-cased."""
    return re.sub(r"[^a-z0-9]+", " ", sentence.lower()).strip()


def known_sentences(sentences: tuple[tuple[str, str], ...] = SENTENCES, tags: tuple[str, ...] = TAGS) -> dict[str, str]:
    """Identifiers by sentence in plain form."""
    return {plain(s): i for s, i in sentences} | {plain(f"SPDX-License-Identifier: {t}"): f"Spdx:{t}" for t in tags}


def normalised(sentence: Column) -> Column:
    """As ``plain``, without the number or letter of a list item in front."""
    low = F.translate(sentence, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_replace(F.trim(F.regexp_replace(low, r"[^a-z0-9]+", " ")), r"^([0-9]+|[a-z]) ", "")


def sentence_ids(text: Column, known: dict[str, str]) -> Column:
    """The identifiers of the known sentences of a text, in order; unknown sentences are left out.

    A sentence may go over several lines, with comment marks before them.  Where it is unknown as a whole, each of its lines
    is looked up, so that a notice on a line of its own is found in text without full stops.
    """
    marked = F.coalesce(text, F.lit(""))
    for pattern, mark in BREAKS:
        marked = F.regexp_replace(marked, pattern, re.sub(r"\\(\d)", r"$\1", mark))
    table, least = F.create_map(*[F.lit(x) for pair in known.items() for x in pair]), min(map(len, known))
    found = lambda s: F.when(F.length(s) >= least, F.try_element_at(table, normalised(s)))

    def looked_up(unit: Column) -> Column:
        return F.transform(F.array(found(unit)), lambda whole: F.when(whole.isNotNull() | ~F.contains(unit, F.lit("\n")), F.array(whole)).otherwise(F.transform(F.split(unit, "\n"), found)))[0]

    long_ones = F.filter(F.split(marked, END), lambda s: F.length(s) >= least)
    return F.array_compact(F.flatten(F.transform(long_ones, looked_up)))


def scan_licences(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", known: dict[str, str] | None = None, rules: tuple[tuple[str, tuple[str, ...]], ...] = RULES) -> DataFrame:
    """One row per document: doc_id, n_sentences (known ones), sentence_ids, licences (both joined by commas).

    A rule fits where its identifiers follow each other with no other known sentence between.  Rules are tried in their
    order, and what one has matched is no longer there for the next.  Licences are listed once, in order of their names.
    Without a known sentence both lists are empty.  A null text has none.  Other columns are not read; rows may repeat.
    """
    ids = docs.select(F.col(id_col).alias("doc_id"), sentence_ids(F.col(text_col), known or known_sentences()).alias("ids"))
    # The sequence is a string with a bar before and after each identifier; a matched part becomes a mark that nothing matches.
    left = F.when(F.size("ids") > 0, F.concat(F.lit("|"), F.array_join("ids", "||"), F.lit("|"))).otherwise(F.lit(""))

    def step(state: Column, rule: Column) -> Column:
        hit = F.contains(state["left"], rule["part"])
        return F.struct(F.when(hit, F.replace(state["left"], rule["part"], F.lit("-"))).otherwise(state["left"]).alias("left"), F.when(hit, F.array_union(state["names"], F.array(rule["name"]))).otherwise(state["names"]).alias("names"))

    listed = F.array(*[F.struct(F.lit("".join(f"|{x}|" for x in sequence)).alias("part"), F.lit(name).alias("name")) for name, sequence in rules])
    start = F.struct(left.alias("left"), F.array().cast("array<string>").alias("names"))
    names = F.when(F.size("ids") > 0, F.aggregate(listed, start, step, lambda state: F.array_sort(state["names"]))).otherwise(F.array().cast("array<string>"))
    return ids.select("doc_id", F.size("ids").cast("long").alias("n_sentences"), F.array_join("ids", ",").alias("sentence_ids"), F.array_join(names, ",").alias("licences"))
