from __future__ import annotations

import duckdb
import pytest

from sensorframe.llm import licences, queries
from tests.llm.cases import LONG, documents
from tools.compare import compare, connect

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction.

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED."""
BSD = """ * Redistribution and use in source and binary forms, with or without
 * modification, are permitted provided that the following conditions are met:
 * Redistributions of source code must retain the above copyright notice.
 * Redistributions in binary form must reproduce the above copyright notice.
{} * This software is provided by the owner "as is" and any express or implied
 * warranties are disclaimed."""
ENDORSE = " * Neither the name of the owner may be used to endorse or promote products.\n"
CASES = {
    1: ("Oulle.\nReleased under the MIT License.", "<MITname>", ["MIT"], ""),
    2: ("x | y\nLicensed under the Apache License, Version 2.0.\nmore", "<Apache:2.0>", ["Apache-2.0"], ""),
    3: ("This work is licensed under the GNU General Public License, version 3.", "<GPL:3>", ["GPL-3"], ""),
    4: ("Licensed under CC BY-NC 4.0.", "<CC-BY-NC:4.0>", ["CC-BY-NC-4.0"], ""),
    5: (MIT, "<MITpermission><MITnotice><MITwarranty>", ["MIT"], ""),
    6: (BSD.format(ENDORSE), "<BSDuse><BSDsource><BSDbinary><BSDendorse><BSDwarranty>", ["BSD-3-Clause"], ""),
    7: (BSD.format(""), "<BSDuse><BSDsource><BSDbinary><BSDwarranty>", ["BSD-2-Clause"], ""),
    8: (MIT.split("\n\n")[0], "<MITpermission>", [], "<MITpermission>"),
    9: ("GNU General Public License version 2, or (at your option) any later version.", "<GPLorLater:2>", ["GPL-2-or-later"], ""),
    10: ("// SPDX-License-Identifier: BSL-1.0\nint x;", "<SPDX:bsl-1.0>", ["SPDX-bsl-1.0"], ""),
    11: ("I like my license. Nothing to see.", "", [], ""),
    12: ("", "", [], ""), 13: (None, "", [], ""), 14: (LONG, "", [], ""),
    15: ("Licensed under the Apache License, Version 2.0. Released under the MIT License. Released under the MIT License.",
         "<Apache:2.0><MITname><MITname>", ["Apache-2.0", "MIT"], ""),
}


def test_known_texts(spark):
    docs = documents(spark, [(i, c[0], "en", "s") for i, c in CASES.items()])
    got = {r.doc_id: (r.sequence, r.licences, r.rest) for r in licences.scan(docs).collect()}
    assert got == {i: tuple(c[1:]) for i, c in CASES.items()}


def test_sql_gives_the_same(spark):
    docs = documents(spark, [(i, c[0], "en", "s") for i, c in CASES.items()]).select("doc_id", "text").toPandas()
    con = duckdb.connect()
    con.register("documents", docs)
    got = {r[0]: tuple(r[1:]) for r in con.execute(licences.plain_sql()).fetchall()}
    assert got == {i: (c[1], ",".join(c[2]), c[3]) for i, c in CASES.items()}


def test_awkward_rows(spark):
    assert {(r.sequence, r.rest) for r in licences.scan(documents(spark)).collect()} == {("", "")}
    assert licences.scan(documents(spark)).count() == 9
    assert licences.scan(documents(spark, [])).count() == 0


@pytest.mark.parametrize("name", ["op3_licence_scan", "op8_mix_sources", "op10_exact_top_k"])
def test_queries_match_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    good, note = compare(spark, connect(sf), name, queries.QUERIES[name], queries.ORACLES[name], sf)
    assert good, note


def test_clues_survive_wrapping_comments_and_quotes(spark):
    texts = ["This is free and unencumbered software released into the public\n# domain", "All rights\nreserved", "all  rights \"reserved\"",
             "CC\n// BY 4.0", "CC  BY-SA 4.0", "cc0\n1.0", "under any later\nversion", "released under the BSD\n3-clause",
             "Neither the name of X may be used to\n* endorse or promote products"]
    got = [r.sequence for r in licences.scan(documents(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])).orderBy("doc_id").collect()]
    assert got == ["<Unlicense>", "<AllRights>", "<AllRights>", "<CC-BY:4.0>", "<CC-BY-SA:4.0>", "<CC0:1.0>", "<OrLater>",
                   "<BSDname:3>", "<BSDendorse>"]


GNU = """This {what} is free software; you can redistribute it and/or modify
it under the terms of the GNU {name}General Public License as published by
the Free Software Foundation; either version {v} of the License, or
(at your option) any later version.

This {what} is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU {name}General Public License for more details.

You should have received a copy of the GNU {name}General Public License
along with this {what}; if not, write to the Free Software Foundation."""
#: The notices that the licences ask for, as published.
NOTICES = {
    "GPL-2-or-later": GNU.format(what="program", name="", v="2"),
    "LGPL-2.1-or-later": """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.

This library is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU
Lesser General Public License for more details.""",
    "AGPL-3-or-later": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU Affero General Public License as
published by the Free Software Foundation, either version 3 of the
License, or (at your option) any later version.""",
    "GPL-2": """This program is free software; you can redistribute it and/or modify it
under the terms of the GNU General Public License version 2 only, as
published by the Free Software Foundation.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "EPL-2.0": """This program and the accompanying materials are made
available under the terms of the Eclipse Public License 2.0
which is available at https://www.eclipse.org/legal/epl-2.0/""",
    "BSL-1.0": """Distributed under the Boost Software License, Version 1.0.
(See accompanying file LICENSE_1_0.txt or copy at
https://www.boost.org/LICENSE_1_0.txt)""",
    "CC-BY-SA-4.0": """This work is licensed under the Creative Commons
Attribution-ShareAlike 4.0 International License.""",
    "Artistic-2.0": "This package is licensed under The Artistic License 2.0.",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
WITH REGARD TO THIS SOFTWARE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not
   claim that you wrote the original software.
2. Altered source versions must be plainly marked as such, and must not be
   misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "MIT": MIT,
}
MORE = {
    "SPDX-mit or apache-2.0": "/* SPDX-License-Identifier: MIT OR Apache-2.0 */\nint x;",
    "SPDX-(mit or gpl-2.0+) and bsd-3-clause with x-exception-1.0":
        "# SPDX-License-Identifier: (MIT OR GPL-2.0+) AND BSD-3-Clause WITH x-exception-1.0\nimport os",
    "GPL-3.0": "Licensed under GPL-3.0", "GPL-2.0-or-later": "Licensed under GPL-2.0-or-later.", "LGPL-3": "Available as LGPLv3; no more.",
    "AGPL-3.0": "License: AGPL v. 3.0\n", "Apache-2": "Apache-2 licensed", "GPL-2": "GNU GENERAL PUBLIC LICENSE\n   Version 2, June 1991\n",
    "MPL-1.1": "Mozilla Public License Version 1.1",
    "GPL-3-or-later": "Covered by the GNU General Public License.  Use version 3 of the License, or any later version.",
}


def wrapped(text, width, mark):
    import textwrap
    return "\n".join(f"{mark} {line}".rstrip() for part in text.split("\n\n")
                     for line in [*textwrap.wrap(part, width), ""])


def test_published_notices(spark):
    cases = [(name, t) for name, text in NOTICES.items() for t in (
        text, wrapped(text, 60, " *"), wrapped(text, 45, "#"), wrapped(text, 72, "//"), "Some code\n" + text + "\nmore code")]
    cases += list(MORE.items())
    docs = documents(spark, [(i, t, "en", "s") for i, (_, t) in enumerate(cases)])
    got = {r.doc_id: r.licences for r in licences.scan(docs).collect()}
    assert {(n, t): got[i] for i, (n, t) in enumerate(cases) if got[i] != [n]} == {}
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text").toPandas())
    said = {r[0]: r[2] for r in con.execute(licences.plain_sql()).fetchall()}
    assert said == {i: n for i, (n, _) in enumerate(cases)}
