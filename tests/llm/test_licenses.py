from bitlark.llm import licenses
from tests.llm.helpers import clashing, frame, odd_rows

MIT = "\n".join(licenses.SENTENCES[x] for x in ("mit.grant", "mit.notice", "mit.warranty", "mit.liability"))


def test_rules(spark):
    apache = " ".join(licenses.SENTENCES[x] for x in ("apache2.header", "apache2.copy")) + "\n" + " ".join(licenses.SENTENCES[x] for x in ("apache2.as_is", "apache2.see"))
    rows = [
        (1, f"Title.\n{MIT.upper()}\nmore"),
        (2, "x y z. Licensed under the Apache License, Version 2.0. More text.\nreleased   UNDER the (MIT) license!"),
        (3, apache),
        (4, MIT.replace("\n", "\nunknown one.\nunknown two.\nunknown three.\n", 1)),  # the gap is too wide
        (5, "Licensed under the Apache Licence, Version 2.0."),
        (6, "a. " * 500 + "Licensed under CC BY-NC 4.0. Licensed under CC BY-NC 4.0."),
        (7, "\n".join(reversed(MIT.split("\n")))),  # order counts
        (8, "Permission is granted to read."),
    ]
    got = {r.doc_id: r for r in licenses.digest(frame(spark, rows)).collect()}
    assert got[1].matches == "MIT:1:4" and got[1].licenses == "MIT" and got[1].n_known == 4
    assert got[2].licenses == "Apache-2.0,MIT" and got[2].n_known == 2
    assert got[3].licenses == "Apache-2.0" and got[3].matches.count(",") == 0
    assert [got[i].licenses for i in (4, 5, 7, 8)] == ["", "", "", ""] and got[4].n_known == 4
    assert got[6].matches == "CC-BY-NC-4.0:500:500,CC-BY-NC-4.0:501:501"


def test_length_and_blanks_of_a_notice_do_not_matter(spark):
    free = licenses.SENTENCES["unlicense.free"]
    rows = [
        (1, "Licensed under the" + " " * 3000 + "MIT License."),
        (2, "*" * 2000 + " Released under the MIT License " + "日本" * 1000),
        (3, free.replace("public domain", "public  domain")),
        (4, free.replace("public domain", "PUBLIC-domain")),
        (5, "z" + "*" * 2000 + " Released under the MIT License"),
    ]
    got = {r.doc_id: r.licenses for r in licenses.digest(frame(spark, rows)).collect()}
    assert got == {1: "MIT", 2: "MIT", 3: "Unlicense", 4: "Unlicense", 5: ""}


def wrapped(ids, width, prefix="", between="\n"):
    import textwrap

    return between.join("\n".join(prefix + x for x in textwrap.wrap(licenses.SENTENCES[i], width, break_long_words=False)) for i in ids)


def test_wrapped_texts(spark):
    mit = ("mit.grant", "mit.notice", "mit.warranty", "mit.liability")
    gpl = ("gpl3.free", "gpl.hope", "gpl.see")
    bsd = [licenses.SENTENCES[x] for x in ("bsd.grant", "bsd.source", "bsd.binary", "bsd3.endorse")]
    apache = """Copyright 2020 Somebody
Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
    comment = lambda p: "\n".join((p + x).rstrip() for x in apache.split("\n"))
    rows = [(10 + n, comment(p) + "\nimport x\n") for n, p in enumerate(("", "   ", "# ", "// ", " * ", "-- ", ";; ", "rem ", "dnl "))]
    rows += [(20 + w, "MIT License\n\nCopyright (c) 2020 X\n\n" + wrapped(mit, w, between="\n\n")) for w in (60, 70, 72, 78, 80)]
    rows += [(200, wrapped(gpl, 72, " * ", "\n *\n")), (201, wrapped(("gpl2.free", *gpl[1:]), 70, "# ", "\r\n#\r\n")), (202, wrapped(("isc.grant",), 75).upper())]
    rows += [(203, "\n\n".join([bsd[0].replace(" are ", "\nare "), *(f"{n}. " + b.replace(" the ", "\n   the ", 1) for n, b in enumerate(bsd[1:], 1))]))]
    rows += [
        (300, wrapped(mit, 70, between="\n\nan unknown sentence\nwrapped over\nmore lines than\nthe gap has\n\n")),
        (301, wrapped(mit, 70, between="\n\none.\ntwo.\nthree.\n\n")),  # the gap is too wide
        (302, wrapped(("mit.grant",), 70).replace("free of charge", "free of\nany charge")),
        (303, "Released under the. MIT License. Released under the\nMIT license"),
        (304, "unreleased under the\nMIT License 2"),
        (305, "This work is released under\nthe MIT License."),
        (306, wrapped(("unlicense.free",), 65).replace("public domain", "public\ndomain")),
    ]
    got = {r.doc_id: r for r in licenses.digest(frame(spark, rows)).collect()}
    assert all(got[i].licenses == "Apache-2.0" and got[i].n_known == 4 for i in range(10, 19))
    assert got[10].matches == "Apache-2.0:1:9" and got[10].n_sentences == 12
    assert all(got[20 + w].licenses == "MIT" and got[20 + w].n_known == 5 for w in (60, 70, 72, 78, 80))
    assert all(got[20 + w].matches.count(",") == 1 for w in (60, 70, 72, 78, 80))
    assert [got[i].licenses for i in (200, 201, 202, 203)] == ["GPL-3.0", "GPL-2.0", "ISC", "BSD-3-Clause"]
    assert [got[i].matches.count(",") for i in (200, 201, 202, 203)] == [0, 0, 0, 0] and got[203].n_known == 4
    assert got[300].licenses == "MIT" and got[301].licenses == got[302].licenses == "" and got[301].n_known == 4
    assert got[303].matches == "MIT:1:1,MIT:2:3" and [got[i].n_known for i in (304, 305, 306)] == [0, 0, 1]


def test_odd_rows(spark):
    df = frame(spark, odd_rows())
    got = licenses.digest(clashing(df)).collect()
    assert len(got) == len(odd_rows()) and not any(r.n_known for r in got)
    assert licenses.digest(df.limit(0)).count() == 0
    plan = licenses.digest(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange hash" not in plan


def test_driver_tables(spark, data, duck):
    from conftest import rows_of

    got = licenses.digest(spark.read.parquet(f"{data}/documents.parquet")).toPandas()
    assert rows_of(got) == rows_of(duck.execute(licenses.SQL).df())


def files():
    """Notices and whole texts as they stand in files."""
    of = lambda ids, w=72, p="", between="\n\n": wrapped(ids, w, p, between)
    bsd = ("bsd.grant", "bsd.source", "bsd.binary", "bsd3.endorse", "bsd.warranty", "bsd.liability")
    bullets = "\n\n".join(("  * " if i in bsd[1:4] else "") + of((i,)) for i in bsd)
    mpl = "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at https://mozilla.org/MPL/2.0/. */\n"
    gpl = lambda *ids: " This file is part of X.\n\n" + "\n\n".join(of((i,), 70) for i in ids) + " If not, see <https://www.gnu.org/licenses/>.\n"
    return {
        1: ("MIT", "MIT License\n\nCopyright (c) 2021 Some One\n\n" + of(("mit.grant", "mit.notice", "mit.warranty"), 78) + "\n" + of(("mit.liability",), 78)),
        2: ("BSD-3-Clause", "BSD 3-Clause License\n\nCopyright (c) 2021, X\n\n" + bullets),
        3: ("BSD-2-Clause", of((*bsd[:3], *bsd[4:])).replace("Redistributions of", "1. Redistributions of").replace("Redistributions in", "2. Redistributions in")),
        4: ("ISC", of(("isc.grant",), 80) + "\n\n" + of(("isc.warranty",), 80) + " " + of(("isc.liability",), 80)),
        5: ("MPL-2.0", mpl),
        6: ("GPL-3.0", gpl("gpl3.free", "gpl.hope", "gpl.see", "gpl.copy")),
        7: ("LGPL-2.1", gpl("lgpl21.free", "lgpl.hope", "lgpl.see", "lgpl.copy")),
        8: ("AGPL-3.0", gpl("agpl3.free", "gpl.hope", "agpl.see", "agpl.copy")),
        9: ("Apache-2.0", "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n\n   1. Definitions.\n"),
        10: ("GPL-2.0", "\t\t    GNU GENERAL PUBLIC LICENSE\n\t\t       Version 2, June 1991\n\n Copyright (C) 1989"),
        11: ("LGPL-3.0", "                   GNU LESSER GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n"),
        12: ("Zlib", of(("zlib.warranty", "zlib.liability"), between="  ") + "\n\n" + of(("zlib.grant",))),
        13: ("MIT", "// SPDX-License-Identifier: MIT\nimport x\n"),
        14: ("", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 9.9."),
        15: ("", "This Source Code Form is subject to the terms of the Mozilla Public License, v."),
        16: ("", "The MIT licence and the public domain, with damages. No warranty! Redistribution? permission\n\n\n"),
        17: ("", None),
    }


def test_texts_of_files_and_their_sql(spark):
    import duckdb

    from conftest import rows_of

    rows = [(i, t) for i, (_, t) in files().items()]
    rows += [(100 + i, "\n".join(("# " + x).rstrip() for x in (t or "").split("\n"))) for i, t in rows if i != 5]
    rows += [(200 + i, (t or "").replace("\n", "\r\n")) for i, t in rows if i < 100]
    rows += [(300 + r, licenses.SENTENCES["mit.grant"] + x + licenses.SENTENCES["mit.notice"]) for r, x in enumerate(("\n\na b\nc d\n", "\nOne. Two. ", "\nOne. Two. Three. ", "\n\n\n", "\nrem\n", " "))]
    df = frame(spark, rows)
    got = licenses.digest(df).toPandas()
    found = dict(zip(got.doc_id, got.licenses, strict=True))
    for i, (want, _) in files().items():
        assert [found[j] for j in (i, 100 + i, 200 + i) if j in found] == [want] * sum(j in found for j in (i, 100 + i, 200 + i)), i
    assert [found[300 + r] for r in range(6)] == ["MIT", "MIT", "", "MIT", "MIT", ""]
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    assert rows_of(got) == rows_of(con.execute(licenses.SQL).df())
