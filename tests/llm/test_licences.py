"""Licence rules with precedence, expressions of tags and common notices, against a matcher that tries every combination."""

import itertools
import random
import textwrap

from angula.llm import licences as L

SCHEMA = "doc_id long, text string"
BSD3 = """Copyright (c) 2019, The Regents
All rights reserved.

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED."""
NOTICES = {
    "BSD-3-Clause": [BSD3.replace("All rights reserved.\n", ""), "// Use of this source code is governed by a BSD-style license that can be\n// found in the LICENSE file."],
    "BSD-2-Clause": [BSD3.replace("All rights reserved.\n", "").split("3. Neither")[0]],
    "GPL-2.0-only": [
        "This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License version 2 as\npublished by the Free Software Foundation.",
        " * This program is free software; you can redistribute it and/or modify it\n * under the terms of the GNU General Public License as published by the Free\n * Software Foundation; version 2 of the License.\n *\n * This program is distributed in the hope that it will be useful, but WITHOUT\n * ANY WARRANTY; without even the implied warranty of MERCHANTABILITY.",
        "# SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0\nx = 1",
    ],
    "BSL-1.0": ["Boost Software License - Version 1.0 - August 17th, 2003\n\n" + L.SENTENCES["boost-grant"], L.SENTENCES["boost-grant"], "// Distributed under the Boost Software License, Version 1.0."],
    "LGPL-3.0-only": ["GNU LESSER GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n\nEveryone is permitted to copy and distribute verbatim copies\nof this license document, but changing it is not allowed.\n\n\n  This version of the GNU Lesser General Public License incorporates\nthe terms and conditions of version 3 of the GNU General Public\nLicense, supplemented by the additional permissions listed below."],
    "EPL-2.0": ["This program and the accompanying materials are made\navailable under the terms of the Eclipse Public License 2.0\nwhich is available at https://www.eclipse.org/legal/epl-2.0/"],
    "OFL-1.1": ["This Font Software is licensed under the SIL Open Font License, Version 1.1.\nThis license is copied below, and is also available with a FAQ at:"],
    "MIT": ["Licensed under the MIT license. See LICENSE file in the project root.", "## License\n\nThis project is licensed under the MIT License - see the LICENSE file for details."],
    "CC-BY-SA-4.0": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "Apache-2.0,MIT": ["SPDX-License-Identifier: Apache-2.0 OR MIT"],
    "Apache-2.0,BSD-3-Clause,MIT": ["/* SPDX-License-Identifier: (MIT AND (Apache-2.0 OR BSD-3-Clause)) */"],
}


def test_notices_by_name(spark):
    rows, want = [], {}
    for names, texts in NOTICES.items():
        for t in texts:
            want[len(rows)] = names
            rows.append((len(rows), t))
    got = {r.doc_id: ",".join(sorted(r.licences.split(","))) for r in L.scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [(want[i], got[i], rows[i][1]) for i in want if got[i] != want[i]] == []


def test_every_rule_reports_its_licence(spark):
    """A text made of a rule's sentences is of its licence alone, unless a stronger rule has them all."""
    rules = [(i, name, rule) for i, (name, rule) in enumerate(L.RULES)]
    text = lambda rule: "\n\n".join(L.SENTENCES[x] for x in rule)
    got = {r.doc_id: (r.licences, r.sentence_ids) for r in L.scan(spark.createDataFrame([(i, text(rule)) for i, _, rule in rules], SCHEMA)).collect()}
    assert [(name, rule, got[i]) for i, name, rule in rules if got[i] != (name, ",".join(rule))] == []


def test_wrapped_notices(spark):
    rows, want = [], {}
    for i, (name, rule) in enumerate(r for r in L.RULES if not r[1][0].startswith("spdx")):
        for width, lead in ((76, "// "), (60, " * "), (80, "")):
            want[len(rows)] = name
            rows.append((len(rows), "\n".join(lead + line for x in rule for line in [*textwrap.wrap(L.WHOLE.get(x, L.SENTENCES[x]), width, break_on_hyphens=False), ""])))
    got = {r.doc_id: r.licences for r in L.scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [(want[i], got[i], rows[i][1]) for i in want if want[i] != got[i]] == []


def brute(ids, rules, gap):
    """All combinations of places, rule after rule."""
    left, names = list(ids), set()
    for name, rule in rules:
        while True:
            ways = [p for p in itertools.combinations(range(len(left)), len(rule)) if [left[i][1] for i in p] == rule and all(left[b][0] - left[a][0] <= gap + 1 for a, b in zip(p, p[1:]))]
            if not ways:
                break
            first = min(p[-1] for p in ways)
            taken = max(p[::-1] for p in ways if p[-1] == first)
            names.add(name)
            left = [x for i, x in enumerate(left) if i not in taken]
    return [n for n in dict.fromkeys(n for n, _ in rules) if n in names]


def test_rules_against_every_combination():
    rng = random.Random(6)
    for _ in range(1500):
        rules = [(rng.choice("XYZVW"), [rng.choice("abcd") for _ in range(rng.randrange(1, 4))]) for _ in range(5)]
        nth = sorted(rng.sample(range(14), rng.randrange(9)))
        ids = [(n, rng.choice("abcd")) for n in nth]
        assert L.matched(ids, rules, 2) == brute(ids, rules, 2), (ids, rules)


def test_two_licences_of_one_family_are_both_reported(spark):
    two = BSD3 + "\n\n" + "\n\n".join("other words, " + w for w in ("one", "two", "three", "four", "five")) + "\n\n" + BSD3.split("3. Neither")[0]
    got = {r.doc_id: r.licences for r in L.scan(spark.createDataFrame([(1, two), (2, BSD3), (3, None), (3, ""), (None, BSD3), (None, BSD3)], SCHEMA)).collect()}
    assert got[1] == "BSD-3-Clause,BSD-2-Clause,LicenseRef-proprietary" and got[2] == got[None] == "BSD-3-Clause,LicenseRef-proprietary" and got[3] == ""
