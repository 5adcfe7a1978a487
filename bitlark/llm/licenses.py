r"""License scans by sentences and ordered rules. DataFrame functions only.

Texts are cut into pieces at line ends and at ``.``, ``!`` or ``?`` before a blank. A piece is normalised: A-Z lower-cased, every
run of other characters than a-z and 0-9 one blank; ``rem`` and ``dnl`` at the start of a line are comment prefixes and go too. A known
sentence begins and ends at cuts. Inside it line ends are blanks (hard-wrapped texts and commented headers; blank and comment-only lines
included: the Apache header has one before its address), and so is a stop where the sentence itself has one (``v. 2.0``); all its words are
compared. Of known sentences that share pieces the one that begins first counts, of these the longest. Known sentences have identifiers; a
document becomes the sequence of identifiers of its known sentences with their first and last pieces. A rule is an ordered list of
identifiers; it matches where they follow each other in that sequence with at most ``GAP`` unknown sentences between any two (a line end
inside a paragraph doesn't end a sentence). A match inside a longer match is dropped; matches of the same pieces by several rules all stay.

Scale: one scan, no shuffle. The known sentences are one pattern of fixed size, tried at the start of each piece. Every known sentence holds
one of ``WORDS`` (checked on import), so texts without any of them skip the recognition; that changes no result. Edge cases: a null text is
one empty piece; repeated rows give a row each; very long texts and sentences are read whole; an empty table gives an empty table; extra
columns pass ``matches``.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, text_of

GAP = 2
CUT = "[.!?]+[ \\t\\r]+|[ \\t\\r]*\\n+"
WORDS = "licen[sc]e|permission|warrant|liab|redistribut|copyright|public[^a-z0-9]+domain|damages|unencumbered|of[^a-z0-9]+the[^a-z0-9]+mpl|terms[^a-z0-9]+and[^a-z0-9]+conditions"

# Sentences of public licences and their usual notices.
SENTENCES = {
    "mit.name": "MIT License",
    "mit.short": "Released under the MIT License.",
    "mit.short2": "Licensed under the MIT License.",
    "mit.short3": "This project is licensed under the MIT License.",
    "mit.grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit.notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit.warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "mit.liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "apache2.short": "Licensed under the Apache License, Version 2.0.",
    "apache2.header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "apache2.copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache2.as_is": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "apache2.see": "See the License for the specific language governing permissions and limitations under the License.",
    "gpl3.short": "This work is licensed under the GNU General Public License, version 3.",
    "gpl3.short2": "Licensed under the GNU General Public License, version 3.",
    "gpl3.free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl2.free": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl.hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl.see": "See the GNU General Public License for more details.",
    "gpl2.short": "Licensed under the GNU General Public License, version 2.",
    "lgpl3.short": "Licensed under the GNU Lesser General Public License, version 3.",
    "agpl3.short": "Licensed under the GNU Affero General Public License, version 3.",
    "mpl2.short": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "bsd.grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd.source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd.binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd3.endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd3.short": "Licensed under the BSD 3-Clause License.",
    "bsd2.short": "Licensed under the BSD 2-Clause License.",
    "isc.grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "isc.short": "Licensed under the ISC License.",
    "ccby4.short": "Licensed under CC BY 4.0.",
    "ccbysa4.short": "Licensed under CC BY-SA 4.0.",
    "ccbync4.short": "Licensed under CC BY-NC 4.0.",
    "ccby4.long": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "ccbysa4.long": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "ccbync4.long": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc0.short": "Licensed under CC0 1.0.",
    "cc0.long": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "unlicense.free": "This is free and unencumbered software released into the public domain.",
    "mit.notice2": "The above copyright notice and this permission notice (including the next paragraph) shall be included in all copies or substantial portions of the Software.",
    "apache2.title": "Apache License Version 2.0, January 2004",
    "apache2.terms": "TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    "gpl3.title": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "gpl2.title": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "lgpl3.title": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "lgpl21.title": "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    "agpl3.title": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    "mpl2.title": "Mozilla Public License Version 2.0",
    "gpl2.only": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    "gpl.copy": "You should have received a copy of the GNU General Public License along with this program.",
    "lgpl21.free": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl3.free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl.hope": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "lgpl.see": "See the GNU Lesser General Public License for more details.",
    "lgpl.copy": "You should have received a copy of the GNU Lesser General Public License along with this library.",
    "agpl3.free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl.see": "See the GNU Affero General Public License for more details.",
    "agpl.copy": "You should have received a copy of the GNU Affero General Public License along with this program.",
    "mpl2.copy": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "mpl2.copy2": "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "bsd3.endorse2": "Neither the name of the University nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd.warranty": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "bsd.liability": "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "isc.warranty": "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    "isc.liability": "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "zlib.warranty": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib.liability": "In no event will the authors be held liable for any damages arising from the use of this software.",
    "zlib.grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "bsl1.title": "Boost Software License - Version 1.0 - August 17th, 2003",
    "bsl1.short": "Distributed under the Boost Software License, Version 1.0.",
    "spdx.mit": "SPDX-License-Identifier: MIT",
    "spdx.apache2": "SPDX-License-Identifier: Apache-2.0",
    "spdx.bsd2": "SPDX-License-Identifier: BSD-2-Clause",
    "spdx.bsd3": "SPDX-License-Identifier: BSD-3-Clause",
    "spdx.isc": "SPDX-License-Identifier: ISC",
    "spdx.mpl2": "SPDX-License-Identifier: MPL-2.0",
    "spdx.gpl2": "SPDX-License-Identifier: GPL-2.0-only",
    "spdx.gpl2l": "SPDX-License-Identifier: GPL-2.0-or-later",
    "spdx.gpl3": "SPDX-License-Identifier: GPL-3.0-only",
    "spdx.gpl3l": "SPDX-License-Identifier: GPL-3.0-or-later",
    "spdx.lgpl21": "SPDX-License-Identifier: LGPL-2.1-or-later",
    "spdx.lgpl3": "SPDX-License-Identifier: LGPL-3.0-or-later",
    "spdx.agpl3": "SPDX-License-Identifier: AGPL-3.0-or-later",
    "reserved": "All rights reserved; no part may be redistributed without permission.",
}

# Rules in order, (licence, identifiers).
RULES = [
    ("MIT", ("mit.grant", "mit.notice", "mit.warranty", "mit.liability")),
    ("MIT", ("mit.name",)), ("MIT", ("mit.short",)), ("MIT", ("mit.short2",)), ("MIT", ("mit.short3",)),
    ("Apache-2.0", ("apache2.header", "apache2.copy", "apache2.as_is", "apache2.see")),
    ("Apache-2.0", ("apache2.header",)), ("Apache-2.0", ("apache2.short",)),
    ("GPL-3.0", ("gpl3.free", "gpl.hope", "gpl.see")), ("GPL-3.0", ("gpl3.free",)), ("GPL-3.0", ("gpl3.short",)), ("GPL-3.0", ("gpl3.short2",)),
    ("GPL-2.0", ("gpl2.free", "gpl.hope", "gpl.see")), ("GPL-2.0", ("gpl2.free",)), ("GPL-2.0", ("gpl2.short",)),
    ("LGPL-3.0", ("lgpl3.short",)), ("AGPL-3.0", ("agpl3.short",)), ("MPL-2.0", ("mpl2.short",)),
    ("BSD-3-Clause", ("bsd.grant", "bsd.source", "bsd.binary", "bsd3.endorse")),
    ("BSD-2-Clause", ("bsd.grant", "bsd.source", "bsd.binary")),
    ("BSD-3-Clause", ("bsd3.short",)), ("BSD-2-Clause", ("bsd2.short",)),
    ("ISC", ("isc.grant",)), ("ISC", ("isc.short",)),
    ("CC-BY-4.0", ("ccby4.short",)), ("CC-BY-4.0", ("ccby4.long",)), ("CC-BY-SA-4.0", ("ccbysa4.short",)), ("CC-BY-SA-4.0", ("ccbysa4.long",)),
    ("CC-BY-NC-4.0", ("ccbync4.short",)), ("CC-BY-NC-4.0", ("ccbync4.long",)),
    ("CC0-1.0", ("cc0.short",)), ("CC0-1.0", ("cc0.long",)), ("Unlicense", ("unlicense.free",)), ("Proprietary", ("reserved",)),
    ("MIT", ("mit.grant", "mit.notice")), ("MIT", ("mit.grant", "mit.notice2")), ("MIT", ("mit.grant", "mit.notice2", "mit.warranty", "mit.liability")), ("MIT", ("spdx.mit",)),
    ("Apache-2.0", ("apache2.title",)), ("Apache-2.0", ("apache2.title", "apache2.terms")), ("Apache-2.0", ("spdx.apache2",)),
    ("GPL-3.0", ("gpl3.title",)), ("GPL-3.0", ("gpl3.free", "gpl.hope", "gpl.see", "gpl.copy")), ("GPL-3.0", ("spdx.gpl3",)), ("GPL-3.0", ("spdx.gpl3l",)),
    ("GPL-2.0", ("gpl2.title",)), ("GPL-2.0", ("gpl2.free", "gpl.hope", "gpl.see", "gpl.copy")), ("GPL-2.0", ("gpl2.only",)), ("GPL-2.0", ("gpl2.only", "gpl.hope", "gpl.see")),
    ("GPL-2.0", ("spdx.gpl2",)), ("GPL-2.0", ("spdx.gpl2l",)),
    ("LGPL-3.0", ("lgpl3.title",)), ("LGPL-3.0", ("lgpl3.free",)), ("LGPL-3.0", ("spdx.lgpl3",)),
    ("LGPL-2.1", ("lgpl21.title",)), ("LGPL-2.1", ("lgpl21.free",)), ("LGPL-2.1", ("lgpl21.free", "lgpl.hope", "lgpl.see")), ("LGPL-2.1", ("lgpl21.free", "lgpl.hope", "lgpl.see", "lgpl.copy")), ("LGPL-2.1", ("spdx.lgpl21",)),
    ("AGPL-3.0", ("agpl3.title",)), ("AGPL-3.0", ("agpl3.free",)), ("AGPL-3.0", ("agpl3.free", "gpl.hope", "agpl.see")), ("AGPL-3.0", ("agpl3.free", "gpl.hope", "agpl.see", "agpl.copy")), ("AGPL-3.0", ("spdx.agpl3",)),
    ("MPL-2.0", ("mpl2.title",)), ("MPL-2.0", ("mpl2.short", "mpl2.copy")), ("MPL-2.0", ("mpl2.short", "mpl2.copy2")), ("MPL-2.0", ("spdx.mpl2",)),
    ("BSD-3-Clause", ("bsd.grant", "bsd.source", "bsd.binary", "bsd3.endorse", "bsd.warranty", "bsd.liability")),
    ("BSD-3-Clause", ("bsd.grant", "bsd.source", "bsd.binary", "bsd3.endorse2")), ("BSD-3-Clause", ("bsd.grant", "bsd.source", "bsd.binary", "bsd3.endorse2", "bsd.warranty", "bsd.liability")),
    ("BSD-2-Clause", ("bsd.grant", "bsd.source", "bsd.binary", "bsd.warranty", "bsd.liability")), ("BSD-3-Clause", ("spdx.bsd3",)), ("BSD-2-Clause", ("spdx.bsd2",)),
    ("ISC", ("isc.grant", "isc.warranty", "isc.liability")), ("ISC", ("spdx.isc",)),
    ("Zlib", ("zlib.warranty", "zlib.liability", "zlib.grant")), ("BSL-1.0", ("bsl1.title",)), ("BSL-1.0", ("bsl1.short",)),
]


def normal(sentence: str) -> str:
    return re.sub("[^a-z0-9]+", " ", sentence.lower()).strip()


#: Normalised known sentences and their identifiers.
KNOWN: dict[str, str] = {normal(x): i for i, x in SENTENCES.items()}
assert all(re.search(WORDS, x) for x in KNOWN), [x for x in KNOWN if not re.search(WORDS, x)]

# Marks in place of the cuts: after a stop, at a line end, at a line end after a stop or before blank lines; and around known sentences.
_STOP, _LINE, _BLANK, _AROUND = "\x01", "\x02", "\x03", "\x04"
_CUTS = _STOP + _LINE + _BLANK


def _stopped(sentence: str, stop: str, blank: str) -> str:
    """The normalised sentence with ``stop`` where a cut after a stop stands inside it and ``blank`` for its other blanks."""
    pieces = [normal(x).replace(" ", blank) for x in re.split(CUT, sentence)]
    return stop.join(x for x in pieces if x)


#: A known sentence from one cut to another; line ends are blanks inside. Longest first, so the longest is taken.
_FIND = (
    f"(^ ?|[{_CUTS}] ?)("
    + "|".join(sorted((_stopped(x, f"[ {_CUTS}]+", f"[ {_LINE}{_BLANK}]+") for x in SENTENCES.values()), key=len, reverse=True))
    + f")(?= ?(?:[{_CUTS}]|\\z))"
)


def _marked(text: Column) -> Column:
    """The normalised text with marks for its cuts, the same places as ``CUT``."""
    t = F.translate(ascii_lower(text), _CUTS + _AROUND, "----")
    t = F.regexp_replace(t, "[.!?]+[ \\t\\r]+", _STOP)
    t = F.regexp_replace(t, "[.!?]+\\n+|[ \\t\\r]*\\n\\n+", _BLANK)
    t = F.regexp_replace(t, "[ \\t\\r]*\\n", _LINE)
    t = F.regexp_replace(t, f"[^a-z0-9{_CUTS}]+", " ")
    return F.regexp_replace(t, f"(^|[{_LINE}{_BLANK}]) ?(?:rem|dnl)(?=[ {_CUTS}]|\\z)", "$1")


def _ids(text: Column) -> Column:
    """array<struct<pos, last, id, unknown>> of the known sentences: first and last piece, unknown sentences since the one before."""
    table = F.create_map(*[F.lit(x) for kv in KNOWN.items() for x in kv])
    # text between known sentences at even places, known sentences at odd ones
    parts = F.split(F.regexp_replace(_marked(text), _FIND, f"$1{_AROUND}$2{_AROUND}"), _AROUND, -1)
    cuts = lambda s: F.char_length(s) - F.char_length(F.translate(s, _CUTS, ""))
    words = lambda s: F.btrim(s, F.lit(" " + _CUTS)) != ""

    def step(a: Column, s: Column) -> Column:
        last = a["at"] + cuts(s)
        known = F.struct(
            a["at"].alias("pos"), last.alias("last"), F.try_element_at(table, F.regexp_replace(s, f"[ {_CUTS}]+", " ")).alias("id"), a["unknown"].alias("unknown")
        )
        between = F.size(F.filter(F.split(s, f"[{_STOP}{_BLANK}]|{_LINE} ?(?={_LINE})", -1), words))
        return F.struct(
            last.alias("at"), (~a["odd"]).alias("odd"), F.when(a["odd"], F.lit(0)).otherwise(between).alias("unknown"),
            F.when(a["odd"], F.concat(a["found"], F.array(known))).otherwise(a["found"]).alias("found"),
        )

    zero = F.struct(F.lit(0).alias("at"), F.lit(False).alias("odd"), F.lit(0).alias("unknown"), F.array().cast(_IDS).alias("found"))
    return F.aggregate(parts, zero, step, lambda a: a["found"])


def _rule_matches(ids: Column) -> Column:
    """array<struct<first, last, licence, n>>: every place where a rule's identifiers follow each other."""
    rules = F.from_json(F.lit(json.dumps([{"licence": x, "ids": r} for x, r in RULES])), "array<struct<licence:string,ids:array<string>>>")
    names = F.transform(ids, lambda x: x["id"])

    def at(i: Column) -> Column:
        def fits(r: Column) -> Column:
            n = F.size(r["ids"])
            near = F.forall(F.slice(ids, i + 2, n - 1), lambda x: x["unknown"] <= GAP)
            return (F.get(r["ids"], F.lit(0)) == F.get(ids, i)["id"]) & (F.slice(names, i + 1, n) == r["ids"]) & near

        def made(r: Column) -> Column:
            n = F.size(r["ids"])
            return F.struct(F.get(ids, i)["pos"].alias("first"), F.get(ids, i + n - 1)["last"].alias("last"), r["licence"].alias("licence"), n.alias("n"))

        return F.transform(F.filter(rules, fits), made)

    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(ids) - 1), at))


_IDS = "array<struct<pos:int,last:int,id:string,unknown:int>>"
_MATCH = "array<struct<first:int,last:int,licence:string,n:int>>"


def matches(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with _lc_sentences long, _lc_ids and _lc_matches (struct<first, last, licence, n>, by place)."""
    text = text_of(text_col)
    none = F.array().cast(_IDS)
    cut = docs.withColumns({"_lc_sentences": F.size(F.split(text, CUT, -1)).cast("long"), "_lc_ids": F.when(F.lower(text).rlike(WORDS), _ids(text)).otherwise(none)})
    # a barrier: the sequence is built once, not for each rule
    cut = cut.select(*[c for c in cut.columns if c != "_lc_ids"], F.explode(F.array("_lc_ids")).alias("_lc_ids"))
    all_ = F.when(F.size("_lc_ids") > 0, _rule_matches(F.col("_lc_ids"))).otherwise(F.array().cast(_MATCH)).cast(_MATCH)
    cut = cut.withColumn("_lc_all", all_)
    cut = cut.select(*[c for c in cut.columns if c != "_lc_all"], F.explode(F.array("_lc_all")).alias("_lc_all"))
    inside = lambda x, y: (y["n"] > x["n"]) & (y["first"] <= x["first"]) & (x["last"] <= y["last"])
    kept = F.array_sort(F.filter("_lc_all", lambda x: ~F.exists("_lc_all", lambda y: inside(x, y))))
    return cut.withColumn("_lc_matches", kept).drop("_lc_all")


def digest(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, n_sentences, n_known, licenses (distinct, sorted, comma-joined), matches (licence:first:last)."""
    found = matches(docs.select("doc_id", "text"))
    return found.select(
        "doc_id",
        F.col("_lc_sentences").alias("n_sentences"),
        F.size("_lc_ids").cast("long").alias("n_known"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("_lc_matches", lambda x: x["licence"]))), ",").alias("licenses"),
        F.array_join(F.transform("_lc_matches", lambda x: F.concat_ws(":", x["licence"], x["first"], x["last"])), ",").alias("matches"),
    )


def _sql() -> str:
    """The same by words: a known sentence is looked up at each first word of a piece, by its number of words."""
    known = set()
    for i, x in SENTENCES.items():
        known |= {(_stopped(x, f" {_STOP} ", " "), i), (normal(x), i)}
    known = ", ".join(f"('{x.replace(_STOP, '|')}', '{i}')" for x, i in sorted(known))
    rules = []
    for licence, rule in RULES:
        joins = "".join(f" JOIN k k{n} ON k{n}.rid = k0.rid AND k{n}.seq = k0.seq + {n} AND k{n}.id = '{x}' AND k{n}.unknown <= {GAP}" for n, x in enumerate(rule) if n)
        rules.append(f"SELECT k0.rid, k0.pos AS a, k{len(rule) - 1}.last AS b, '{licence}' AS licence, {len(rule)} AS n FROM k k0{joins} WHERE k0.id = '{rule[0]}'")
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' || chr(1) || chr(2) || chr(3) || chr(4), 'abcdefghijklmnopqrstuvwxyz----')"
    for pattern, mark in (("[.!?]+[ \\t\\r]+", "chr(1)"), ("[.!?]+\\n+|[ \\t\\r]*\\n\\n+", "chr(3)"), ("[ \\t\\r]*\\n", "chr(2)"), ("[^a-z0-9\\x01\\x02\\x03]+", "' '")):
        low = f"regexp_replace({low}, '{pattern}', {mark}, 'g')"
    for _ in range(2):  # a match takes the cut that the next one begins with
        low = f"regexp_replace({low}, '(^|[\\x02\\x03]) ?(?:rem|dnl)([ \\x01\\x02\\x03]|$)', '\\1\\2', 'g')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, len(string_split_regex(coalesce(text, ''), '{CUT}')) AS n_sentences, {low} AS t FROM documents
),
known AS (SELECT sentence, id, string_split(sentence, ' ')[1] AS head, len(string_split(sentence, ' ')) AS n FROM (VALUES {known}) v(sentence, id)),
p AS (SELECT rid, unnest(string_split_regex(t, '[\\x01\\x02\\x03]')) AS p, generate_subscripts(string_split_regex(t, '[\\x01\\x02\\x03]'), 1) - 1 AS pos,
        unnest(list_concat([''], regexp_extract_all(t, '[\\x01\\x02\\x03]'))) AS mark FROM d WHERE regexp_matches(t, '{WORDS}')),
-- pieces with words, and whether a sentence ends before them: a stop, a blank line or two line ends stand there
q AS (
  SELECT rid, pos, string_split(trim(p), ' ') AS w, upto - coalesce(lag(upto) OVER o, 0) > 0 OR pos - coalesce(lag(pos) OVER o, pos - 1) > 1 AS fresh, stops - coalesce(lag(stops) OVER o, 0) > 0 AS stopped
  FROM (SELECT *, sum((mark <> chr(2))::INTEGER) OVER (PARTITION BY rid ORDER BY pos) AS upto, sum((mark = chr(1))::INTEGER) OVER (PARTITION BY rid ORDER BY pos) AS stops FROM p)
  WHERE trim(p) <> '' WINDOW o AS (PARTITION BY rid ORDER BY pos)
),
s AS (SELECT *, sum(fresh::INTEGER) OVER (PARTITION BY rid ORDER BY pos) AS sn, sum(len(w)) OVER (PARTITION BY rid ORDER BY pos) - len(w) AS off, row_number() OVER (PARTITION BY rid ORDER BY pos) AS nth FROM q),
-- the words of a document, with | for the stops between pieces
doc AS (SELECT rid, flatten(list(CASE WHEN stopped AND nth > 1 THEN list_concat(['|'], w) ELSE w END ORDER BY pos)) AS w FROM s GROUP BY rid),
b AS (SELECT rid, pos, sn, off + 1 + sum((stopped AND nth > 1)::INTEGER) OVER (PARTITION BY rid ORDER BY pos) AS i, len(w) AS n, w[1] AS head FROM s),
found AS (
  SELECT b.rid, b.pos, e.pos AS last, known.id, b.sn, b.i, e.i + e.n AS stop
  FROM b JOIN known USING (head) JOIN doc ON doc.rid = b.rid AND known.sentence = array_to_string(doc.w[b.i:b.i + known.n - 1], ' ')
  JOIN b e ON e.rid = b.rid AND e.i + e.n = b.i + known.n
),
first_ AS (SELECT * FROM found x WHERE NOT EXISTS (SELECT 1 FROM found y WHERE y.rid = x.rid AND ((y.i < x.i AND y.stop > x.i) OR (y.i = x.i AND y.stop > x.stop)))),
k0 AS (SELECT *, row_number() OVER o AS seq, coalesce(lag(last) OVER o, -1) AS before FROM first_ WINDOW o AS (PARTITION BY rid ORDER BY pos)),
k AS (SELECT k0.*, (SELECT count(DISTINCT b.sn) FROM b WHERE b.rid = k0.rid AND b.pos > k0.before AND b.pos < k0.pos) AS unknown FROM k0),
m AS ({" UNION ALL ".join(rules)}),
kept AS (SELECT * FROM m x WHERE NOT EXISTS (SELECT 1 FROM m y WHERE y.rid = x.rid AND y.n > x.n AND y.a <= x.a AND x.b <= y.b))
SELECT d.doc_id, d.n_sentences::BIGINT AS n_sentences, (SELECT count(*) FROM k WHERE k.rid = d.rid)::BIGINT AS n_known,
  coalesce((SELECT string_agg(DISTINCT licence, ',' ORDER BY licence) FROM kept WHERE kept.rid = d.rid), '') AS licenses,
  coalesce((SELECT string_agg(licence || ':' || a || ':' || b, ',' ORDER BY a, b, licence) FROM kept WHERE kept.rid = d.rid), '') AS matches
FROM d
"""


SQL = _sql()
