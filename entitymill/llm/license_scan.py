"""License scans by sentence recognition, with DataFrame functions only.

Sentences may begin and end at sentence marks, colons, line ends and bullets. Between
two such places a known sentence is found however it is wrapped: any of them may also
stand inside it, as an empty line does before an address. Of sentences that begin at
the same place the longest counts; where one names a holder, any name of a few words
will do. Normalised sentences become identifiers of two letters, and text between them
a dash, so a text becomes a short string. Licences are ordered rules over that string:
at every place the first rule whose sequence stands there, without a dash inside, counts
and uses it up.
"""

from __future__ import annotations

import re
from string import ascii_lowercase as SMALL
from string import ascii_uppercase as LARGE

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Known licence sentences.
SENTENCES = {
    "apacheHeader": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    "apacheCopy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apacheAsIs": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "apacheSee": "See the License for the specific language governing permissions and limitations under the License.",
    "apacheShort": "Licensed under the Apache License, Version 2.0.",
    "apacheSpdx": "SPDX-License-Identifier: Apache-2.0",
    "mitShort": "Released under the MIT License.",
    "mitGrant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mitNotice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mitAsIs": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "mitLiable": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "mitSpdx": "SPDX-License-Identifier: MIT",
    "gpl3Short": "This work is licensed under the GNU General Public License, version 3.",
    "gpl3Later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl2Later": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gplHope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gplSee": "See the GNU General Public License for more details.",
    "gpl3Spdx": "SPDX-License-Identifier: GPL-3.0-only",
    "bsdUse": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsdSource": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsdBinary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsdEndorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsdSpdx": "SPDX-License-Identifier: BSD-3-Clause",
    "iscGrant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "bsdEndorseName": "The name of the author may not be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsdAsIs": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    "iscAsIs": 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
    "mplSubject": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mplObtain": "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "mplObtainSafe": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "lgpl21Later": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl3Later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgplHope": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "lgplSee": "See the GNU Lesser General Public License for more details.",
    "agpl3Later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agplSee": "See the GNU Affero General Public License for more details.",
    "gpl2Only": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    "mplCopy": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/ under the license.",
    "boostShort": "Distributed under the Boost Software License, Version 1.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "ccByShort": "Licensed under CC BY 4.0.",
    "ccByNcShort": "Licensed under CC BY-NC 4.0.",
    "ccBySaShort": "Licensed under CC BY-SA 4.0.",
    "ccBy": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "ccByNc": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "ccBySa": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
}

# Licences as sequences of sentences, in the order in which they are tried.
RULES = [
    ("Apache-2.0", ["apacheHeader", "apacheCopy", "apacheAsIs", "apacheSee"]),
    ("Apache-2.0", ["apacheHeader", "apacheCopy"]),
    ("Apache-2.0", ["apacheHeader"]),
    ("Apache-2.0", ["apacheShort"]),
    ("Apache-2.0", ["apacheSpdx"]),
    ("MIT", ["mitGrant", "mitNotice", "mitAsIs", "mitLiable"]),
    ("MIT", ["mitGrant", "mitNotice", "mitAsIs"]),
    ("MIT", ["mitGrant", "mitNotice"]),
    ("MIT", ["mitShort"]),
    ("MIT", ["mitSpdx"]),
    ("GPL-3.0-or-later", ["gpl3Later", "gplHope", "gplSee"]),
    ("GPL-3.0-or-later", ["gpl3Later"]),
    ("GPL-2.0-or-later", ["gpl2Later", "gplHope", "gplSee"]),
    ("GPL-2.0-or-later", ["gpl2Later"]),
    ("GPL-3.0-only", ["gpl3Short"]),
    ("GPL-3.0-only", ["gpl3Spdx"]),
    ("BSD-3-Clause", ["bsdUse", "bsdSource", "bsdBinary", "bsdEndorse"]),
    ("BSD-3-Clause", ["bsdUse", "bsdSource", "bsdBinary", "bsdEndorseName"]),
    ("BSD-2-Clause", ["bsdUse", "bsdSource", "bsdBinary"]),
    ("BSD-3-Clause", ["bsdSpdx"]),
    ("ISC", ["iscGrant", "iscAsIs"]),
    ("ISC", ["iscGrant"]),
    ("MPL-2.0", ["mplSubject", "mplObtain"]),
    ("MPL-2.0", ["mplSubject", "mplObtainSafe"]),
    ("MPL-2.0", ["mplSubject"]),
    ("LGPL-2.1-or-later", ["lgpl21Later", "lgplHope", "lgplSee"]),
    ("LGPL-2.1-or-later", ["lgpl21Later"]),
    ("LGPL-3.0-or-later", ["lgpl3Later", "gplHope", "lgplSee"]),
    ("LGPL-3.0-or-later", ["lgpl3Later"]),
    ("AGPL-3.0-or-later", ["agpl3Later", "gplHope", "agplSee"]),
    ("AGPL-3.0-or-later", ["agpl3Later"]),
    ("GPL-2.0-only", ["gpl2Only", "gplHope", "gplSee"]),
    ("GPL-2.0-only", ["gpl2Only"]),
    ("MPL-2.0", ["mplCopy"]),
    ("BSL-1.0", ["boostShort"]),
    ("Unlicense", ["unlicense"]),
    ("CC-BY-4.0", ["ccByShort"]),
    ("CC-BY-4.0", ["ccBy"]),
    ("CC-BY-NC-4.0", ["ccByNcShort"]),
    ("CC-BY-NC-4.0", ["ccByNc"]),
    ("CC-BY-SA-4.0", ["ccBySaShort"]),
    ("CC-BY-SA-4.0", ["ccBySa"]),
]

# Further licences that files name by identifier, alone or as a choice.
IDENTIFIERS = [
    "GPL-2.0-only", "GPL-2.0-or-later", "GPL-2.0", "GPL-3.0-or-later", "GPL-3.0", "LGPL-2.1-only", "LGPL-2.1-or-later",
    "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "BSD-2-Clause", "ISC", "MPL-2.0", "BSL-1.0",
    "Unlicense", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "EPL-2.0", "Zlib", "MIT OR Apache-2.0", "Apache-2.0 OR MIT",
    "GPL-2.0-only OR MIT", "GPL-2.0 OR MIT", "Apache-2.0 WITH LLVM-exception",
]
SENTENCES |= {f"spdx {name}": f"SPDX-License-Identifier: {name}" for name in IDENTIFIERS}
RULES += [(name, [f"spdx {name}"]) for name in IDENTIFIERS]

#: Sentences that name a holder: what stands in front of the name, the name, what stands behind it.
HOLDERS = [
    ("neither the name of", "the copyright holder", "nor the names of its contributors may be used to endorse"),
    ("neither the name of", "the copyright holder", "nor the names of contributors may be used to endorse"),
    ("the name of", "the author", "may not be used to endorse or promote products derived"),
]
HOLDER_WORDS = 12

#: Every known sentence holds one of these words, so a text without any has no sentence.
ANCHORS = ["licen", "mpl was", "permission", "copyright", "warrant", "liab", "redistribut", "unencumbered"]

#: The end of a sentence: its mark and white space, or an empty line.
SENTENCE_END = r"[.!?]+[\x20\x09-\x0D]+|\n[\x20\x09]*\n"
#: Where a sentence may begin or end besides: a colon and white space, a line end.
PLACE = r"(?<![.!?:])[.!?:]++[\x20\x09-\x0D]++|[\x0A-\x0D]"
#: A list item's number or letter alone, which parts no sequence.
NUMBER = "[0-9]{1,3}|[a-z]|[ivx]{2,5}"
#: The number or letter of a list item, with what stands before it in its line.
ITEM = r"(?m)^([^a-z0-9\x0A-\x0D]*+(?:[0-9]{1,3}|[a-z]|[ivx]{2,5})[)\]])"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def plain(sentence: str) -> str:
    """A sentence as it is compared: ASCII letters and digits, in lower case, single blanks."""
    lowered = sentence.translate(str.maketrans(UPPER, LOWER))
    return re.sub("[^a-z0-9]+", " ", lowered).strip(" ")


def _catalogue(sentences: dict[str, str], rules: list) -> tuple[dict[str, str], list[tuple[str, str]]]:
    """({normalised sentence: code}, [(codes, licence)]) in the order of the arguments."""
    if len(sentences) > len(LARGE) * len(SMALL):
        raise ValueError("more sentences than codes of two letters")
    code = dict(zip(sentences, (a + b for a in LARGE for b in SMALL), strict=False))
    known = {plain(s): code[k] for k, s in sentences.items()}
    for s in known:
        if not any(a in s for a in ANCHORS):
            raise ValueError(f"no anchor word in {s!r}")
    coded = {}
    for licence, names in rules:
        coded.setdefault("".join(code[n] for n in names), licence)
    return known, list(coded.items())


def _lookup(pairs, key: Column) -> Column:
    """A small fixed map; a key that is not in it gives null."""
    keys, values = zip(*pairs, strict=True)
    return F.element_at(F.map_from_arrays(F.array(*map(F.lit, keys)), F.array(*map(F.lit, values))), key)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences: dict | None = None, rules: list | None = None) -> DataFrame:
    """For every row: its id, ``n_sentences`` (known ones), ``codes`` (theirs in order, with a
    dash for what stands before, between and behind them), ``n_rules`` (rules matched) and
    ``licenses`` (their licences in order, by comma).

    Null and empty texts, and texts without a known sentence, have 0, "" and 0, "".
    Repeated rows give repeated results, a null id is kept, an empty table gives no
    rows; whole texts are read, in linear time; further columns play no part.
    """
    known, coded = _catalogue(sentences or SENTENCES, rules or RULES)

    text = F.coalesce(F.col("_text"), F.lit(""))
    anchored = text.rlike("(?i)" + "|".join(ANCHORS))
    # Marks at all places, then words with a blank or a mark between them.
    lowered = F.translate(text, UPPER + "|", LOWER + " ")
    placed = F.regexp_replace(F.regexp_replace(lowered, ITEM, "$1|"), PLACE, "|")
    words = F.regexp_replace(F.concat(F.lit("|"), placed, F.lit("|")), "[^a-z0-9|]+", " ")
    words = F.regexp_replace(words, r" ?\|[ |]*+", "|")
    for before, name, behind in HOLDERS:
        gap = r"((?:[ |][a-z0-9]+){1,%d}?)" % HOLDER_WORDS
        words = F.regexp_replace(words, f"{_spaced(before)}{gap}[ |]{_spaced(behind)}", f"{before} {name} {behind}")
    longest_first = sorted(known, key=len, reverse=True)
    sentence = r"\|(?:" + "|".join(map(_spaced, longest_first)) + r")(?=\|)"
    # At every place a known sentence, or else the words up to the next place.
    found = F.regexp_extract_all(words, F.lit(sentence + r"|\|[^|]++(?=\|)"), F.lit(0))

    def code(match: Column) -> Column:
        plain_words = F.trim(F.translate(match, "|", " "))
        unknown = F.when(plain_words.rlike(f"^(?:{NUMBER})$"), F.lit("")).otherwise(F.lit("-"))
        return F.coalesce(_lookup(list(known.items()), plain_words), unknown)

    codes = F.transform(found, code)
    whole = F.regexp_replace(F.array_join(codes, ""), "-+", "-")
    whole = F.when(whole == "-", F.lit("")).otherwise(whole)
    found = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").alias("_text"))
    found = found.select(F.col(f"`{id_col}`"), F.when(anchored, whole).otherwise(F.lit("")).alias("codes"))
    matched = F.regexp_extract_all("codes", F.lit("|".join(c for c, _ in coded)), F.lit(0))
    names = F.transform(matched, lambda m: _lookup(coded, m))
    return found.select(
        F.col(f"`{id_col}`"),
        (F.length(F.translate("codes", "-", "")) / 2).cast("long").alias("n_sentences"),
        "codes",
        F.size(matched).cast("long").alias("n_rules"),
        F.array_join(names, ",").alias("licenses"),
    )


def _spaced(sentence: str) -> str:
    return sentence.replace(" ", "[ |]")


def license_sql(table: str = "documents", id_col: str = "doc_id", text_col: str = "text") -> str:
    """DuckDB SQL for the rows of ``scan_licenses``, without its search for anchor words, where
    every sentence stands alone between ``SENTENCE_END`` marks (but for that of ", v. ") or on
    a line of its own."""
    known, coded = _catalogue(SENTENCES, RULES)

    def case(pairs, key):
        return f"case {key} " + " ".join(f"when '{k}' then '{v}'" for k, v in pairs) + " else '' end"

    def code(x):
        normal = f"trim(regexp_replace(translate({x}, '{UPPER}', '{LOWER}'), '[^a-z0-9]+', ' ', 'g'), ' ')"
        for before, name, behind in HOLDERS:
            normal = f"regexp_replace({normal}, '{before}((?: [a-z0-9]+){{1,{HOLDER_WORDS}}}?) {behind}', '{before} {name} {behind}')"
        words = f"regexp_matches({x}, '[A-Za-z0-9]') and not regexp_full_match({normal}, '{NUMBER}')"
        return f"case {normal} " + " ".join(f"when '{k}' then '{v}'" for k, v in known.items()) + f" else case when {words} then '-' else '' end end"

    pattern = "|".join(c for c, _ in coded)
    lines = f"list_transform(string_split(s, chr(10)), lambda l: {code('l')})"
    one = f"case when {code('s')} not in ('', '-') then {code('s')} else array_to_string({lines}, '') end"
    return f"""
with parts as (
  select {id_col}, regexp_split_to_array(replace(coalesce({text_col}, ''), ', v. ', ', v '), '{SENTENCE_END}') as parts from {table}
), joined as (
  select {id_col}, regexp_replace(array_to_string(list_transform(parts, lambda s: {one}), ''), '-+', '-', 'g') as codes from parts
), coded as (
  select {id_col}, case when codes = '-' then '' else codes end as codes from joined
), matched as (
  select {id_col}, codes, regexp_extract_all(codes, '{pattern}') as found from coded
)
select {id_col}, cast(length(replace(codes, '-', '')) // 2 as bigint) as n_sentences, codes, cast(len(found) as bigint) as n_rules,
       array_to_string(list_transform(found, lambda m: {case(coded, 'm')}), ',') as licenses
from matched
"""
