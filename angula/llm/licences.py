"""Licence scan: known sentences by identifier, and ordered rules over sequences of identifiers.

A text is cut into pieces at line ends and after . ! ? ; followed by white space, and signs that open a comment go. A piece is
lower-cased, its copyright holder and numbers of years become fields, punctuation goes and spaces are one. Pieces in a row,
without a blank line between, that make up a known sentence give its identifier; a tag's expression gives one for each
licence in it. A rule is an ordered list of identifiers, of which up to GAP foreign sentences may part two neighbours. Rules
have precedence: what a stronger rule has matched, no weaker one reads again, so that a licence whose sentences are part of
another's is not reported beside it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_of

# Known licence sentences, identifier: sentence.
SENTENCES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\")",
    "apache-compliance": "you may not use this file except in compliance with the License.",
    "apache-copy": "You may obtain a copy of the License at",
    "apache-as-is": "distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "mit-line": "Released under the MIT License.",
    "mit-named": "The MIT License (MIT)",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-as-is": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED",
    "gpl-3-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-2-line": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-2-free": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "lgpl-2.1-free": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "agpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl-3-line": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "agpl-3-line": "This work is licensed under the GNU Affero General Public License, version 3.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "isc-as-is": "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    "zlib-as-is": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "boost-line": "Distributed under the Boost Software License, Version 1.0.",
    "unlicense-free": "This is free and unencumbered software released into the public domain.",
    "bsd-2-line": "Licensed under the BSD 2-Clause License.",
    "bsd-3-line": "Licensed under the BSD 3-Clause License.",
    "cc-by-nd-4.0-line": "Licensed under CC BY-ND 4.0.",
    "cc-by-nc-sa-4.0-line": "Licensed under CC BY-NC-SA 4.0.",
    "cc-by-nc-nd-4.0-line": "Licensed under CC BY-NC-ND 4.0.",
    "gpl-no-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
    "mpl-2-line": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-no-endorsement": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-line": "Licensed under CC BY 4.0.",
    "cc-by-sa-4.0-line": "Licensed under CC BY-SA 4.0.",
    "cc0-line": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "all-rights-reserved": "All rights reserved.",
    "gpl-2-free-only": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; version 2 of the License.",
    "gpl-2-free-kernel": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    "gpl-2-free-version-2": "This program is free software; you can redistribute it and/or modify it under the terms of version 2 of the GNU General Public License as published by the Free Software Foundation.",
    "gpl-3-free-only": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3 of the License.",
    "gpl-3-free-version-3": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License version 3 as published by the Free Software Foundation.",
    "agpl-free-only": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, version 3 of the License.",
    "lgpl-3-free": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl-3-free-program": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl-2.1-free-only": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License version 2.1 as published by the Free Software Foundation.",
    "lgpl-2.1-line": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "lgpl-3-incorporates": "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below.",
    "gpl-3-preamble": "The GNU General Public License is a free, copyleft license for software and other kinds of works.",
    "agpl-3-preamble": "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software.",
    "gpl-2-preamble": "The licenses for most software are designed to take away your freedom to share and change it.",
    "gnu-verbatim": "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
    "boost-grant": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    "boost-title": "Boost Software License - Version 1.0 - August 17th, 2003",
    "epl-1-available": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution",
    "epl-2-available": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "epl-2-available-v": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v. 2.0 which is available at http://www.eclipse.org/legal/epl-2.0",
    "epl-2-title": "Eclipse Public License - v 2.0",
    "ofl-licensed": "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
    "ofl-title": "SIL OPEN FONT LICENSE Version 1.1 - 26 February 2007",
    "bsd-style": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "mit-style": "Use of this source code is governed by an MIT-style license that can be found in the LICENSE file.",
    "mit-licensed": "Licensed under the MIT license.",
    "mit-this": "This project is licensed under the MIT License.",
    "mit-see": "This project is licensed under the MIT License - see the LICENSE file for details.",
    "mit-see-md": "This project is licensed under the MIT License - see the LICENSE.md file for details",
    "mit-title": "MIT License",
    "mit-terms": "This software may be modified and distributed under the terms of the MIT license.",
    "apache-title": "Apache License Version 2.0, January 2004",
    "apache-this": "This project is licensed under the Apache License 2.0.",
    "mpl-2-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "mpl-2-copy-https": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "mpl-2-title": "Mozilla Public License Version 2.0",
    "cc-by-4.0-work": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0-work": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-nc-4.0-work": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc-by-nd-4.0-work": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "cc-by-nc-sa-4.0-work": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "cc-by-nc-nd-4.0-work": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    "cc-by-sa-3.0-work": "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License.",
    "cc-by-3.0-work": "This work is licensed under a Creative Commons Attribution 3.0 Unported License.",
    "cc0-title": "CC0 1.0 Universal",
    "wtfpl-line": "This program is free software. It comes without any warranty, to the extent permitted by applicable law.",
    "wtfpl-title": "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE",
    "artistic-title": "The Artistic License 2.0",
    "0bsd-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "psf-title": "PYTHON SOFTWARE FOUNDATION LICENSE VERSION 2",
    "bsd-4-advertising": "All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the organization.",
    "x11-no-endorsement": "Except as contained in this notice, the name of the X Consortium shall not be used in advertising or otherwise to promote the sale, use or other dealings in this Software without prior written authorization from the X Consortium.",
    "cddl-terms": "The contents of this file are subject to the terms of the Common Development and Distribution License (the \"License\").",
    "eupl-line": "Licensed under the EUPL, Version 1.2 or - as soon they will be approved by the European Commission - subsequent versions of the EUPL (the \"Licence\");",
    "ms-pl-title": "Microsoft Public License (Ms-PL)",
    "proprietary-confidential": "This software is proprietary and confidential.",
    "proprietary-copying": "Unauthorized copying of this file, via any medium is strictly prohibited.",
}
# Whole sentences of which SENTENCES has a part, by the same identifiers.
WHOLE = {
    "apache-as-is": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-as-is": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
}
# Rules, strongest first. licence, identifiers in order.
RULES = [
    ("Apache-2.0", ["apache-2.0-header", "apache-compliance", "apache-copy"]),
    ("X11", ["mit-grant", "mit-notice", "mit-as-is", "x11-no-endorsement"]),
    ("MIT", ["mit-grant", "mit-notice", "mit-as-is"]),
    ("BSD-4-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary", "bsd-4-advertising", "bsd-no-endorsement"]),
    ("BSD-3-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary", "bsd-no-endorsement"]),
    ("BSD-2-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl-no-warranty"]),
    ("GPL-2.0-or-later", ["gpl-2-free", "gpl-no-warranty"]),
    ("AGPL-3.0-or-later", ["agpl-free", "gpl-no-warranty"]),
    ("ISC", ["isc-grant", "isc-as-is"]),
    ("Zlib", ["zlib-as-is", "zlib-grant"]),
    ("GPL-2.0-only", ["gpl-2-free-only", "gpl-no-warranty"]),
    ("GPL-2.0-only", ["gpl-2-free-kernel", "gpl-no-warranty"]),
    ("GPL-2.0-only", ["gpl-2-free-version-2", "gpl-no-warranty"]),
    ("GPL-3.0-only", ["gpl-3-free-only", "gpl-no-warranty"]),
    ("GPL-3.0-only", ["gpl-3-free-version-3", "gpl-no-warranty"]),
    ("LGPL-3.0-only", ["gnu-verbatim", "lgpl-3-incorporates"]),
    ("AGPL-3.0-only", ["gnu-verbatim", "agpl-3-preamble"]),
    ("GPL-3.0-only", ["gnu-verbatim", "gpl-3-preamble"]),
    ("GPL-2.0-only", ["gnu-verbatim", "gpl-2-preamble"]),
    ("BSL-1.0", ["boost-title", "boost-grant"]),
    ("MPL-2.0", ["mpl-2-line", "mpl-2-copy"]),
    ("MPL-2.0", ["mpl-2-line", "mpl-2-copy-https"]),
    ("0BSD", ["0bsd-grant", "isc-as-is"]),
    ("MIT", ["mit-title", "mit-grant"]),
    ("GPL-2.0-only", ["gpl-2-free-only"]),
    ("GPL-2.0-only", ["gpl-2-free-kernel"]),
    ("GPL-2.0-only", ["gpl-2-free-version-2"]),
    ("GPL-3.0-only", ["gpl-3-free-only"]),
    ("GPL-3.0-only", ["gpl-3-free-version-3"]),
    ("AGPL-3.0-only", ["agpl-free-only"]),
    ("LGPL-3.0-or-later", ["lgpl-3-free"]),
    ("LGPL-3.0-or-later", ["lgpl-3-free-program"]),
    ("LGPL-2.1-only", ["lgpl-2.1-free-only"]),
    ("LGPL-2.1-only", ["lgpl-2.1-line"]),
    ("LGPL-3.0-only", ["lgpl-3-incorporates"]),
    ("GPL-3.0-only", ["gpl-3-preamble"]),
    ("AGPL-3.0-only", ["agpl-3-preamble"]),
    ("BSL-1.0", ["boost-grant"]),
    ("BSL-1.0", ["boost-title"]),
    ("EPL-1.0", ["epl-1-available"]),
    ("EPL-2.0", ["epl-2-available"]),
    ("EPL-2.0", ["epl-2-available-v"]),
    ("EPL-2.0", ["epl-2-title"]),
    ("OFL-1.1", ["ofl-licensed"]),
    ("OFL-1.1", ["ofl-title"]),
    ("BSD-3-Clause", ["bsd-style"]),
    ("MIT", ["mit-style"]),
    ("MIT", ["mit-licensed"]),
    ("MIT", ["mit-this"]),
    ("MIT", ["mit-see"]),
    ("MIT", ["mit-see-md"]),
    ("MIT", ["mit-terms"]),
    ("MIT", ["mit-grant"]),
    ("MIT", ["mit-title"]),
    ("Apache-2.0", ["apache-title"]),
    ("Apache-2.0", ["apache-this"]),
    ("MPL-2.0", ["mpl-2-title"]),
    ("CC-BY-4.0", ["cc-by-4.0-work"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-4.0-work"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-4.0-work"]),
    ("CC-BY-ND-4.0", ["cc-by-nd-4.0-work"]),
    ("CC-BY-NC-SA-4.0", ["cc-by-nc-sa-4.0-work"]),
    ("CC-BY-NC-ND-4.0", ["cc-by-nc-nd-4.0-work"]),
    ("CC-BY-SA-3.0", ["cc-by-sa-3.0-work"]),
    ("CC-BY-3.0", ["cc-by-3.0-work"]),
    ("CC0-1.0", ["cc0-title"]),
    ("WTFPL", ["wtfpl-title"]),
    ("WTFPL", ["wtfpl-line"]),
    ("Artistic-2.0", ["artistic-title"]),
    ("0BSD", ["0bsd-grant"]),
    ("PSF-2.0", ["psf-title"]),
    ("CDDL-1.0", ["cddl-terms"]),
    ("EUPL-1.2", ["eupl-line"]),
    ("MS-PL", ["ms-pl-title"]),
    ("GPL-3.0-or-later", ["gpl-free"]),
    ("GPL-2.0-or-later", ["gpl-2-free"]),
    ("LGPL-2.1-or-later", ["lgpl-2.1-free"]),
    ("AGPL-3.0-or-later", ["agpl-free"]),
    ("Unlicense", ["unlicense-free"]),
    ("BSL-1.0", ["boost-line"]),
    ("LGPL-3.0-only", ["lgpl-3-line"]),
    ("AGPL-3.0-only", ["agpl-3-line"]),
    ("BSD-2-Clause", ["bsd-2-line"]),
    ("BSD-3-Clause", ["bsd-3-line"]),
    ("CC-BY-ND-4.0", ["cc-by-nd-4.0-line"]),
    ("CC-BY-NC-SA-4.0", ["cc-by-nc-sa-4.0-line"]),
    ("CC-BY-NC-ND-4.0", ["cc-by-nc-nd-4.0-line"]),
    ("Apache-2.0", ["apache-2.0-line"]),
    ("Apache-2.0", ["apache-2.0-header"]),
    ("MIT", ["mit-line"]),
    ("MIT", ["mit-named"]),
    ("GPL-3.0-only", ["gpl-3-line"]),
    ("GPL-2.0-only", ["gpl-2-line"]),
    ("MPL-2.0", ["mpl-2-line"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-4.0-line"]),
    ("CC-BY-4.0", ["cc-by-4.0-line"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-4.0-line"]),
    ("CC0-1.0", ["cc0-line"]),
    ("LicenseRef-proprietary", ["proprietary-confidential", "proprietary-copying"]),
    ("LicenseRef-proprietary", ["proprietary-copying", "proprietary-confidential"]),
    ("LicenseRef-proprietary", ["all-rights-reserved"]),
]
#: Tags name their licence: one sentence and one rule for each.
TAGGED = sorted({name for name, _ in RULES if not name.startswith("LicenseRef")} | {"MIT-0", "GPL-2.0", "GPL-3.0", "GPL-2.0+", "GPL-3.0+", "LGPL-2.1", "LGPL-2.1+", "LGPL-3.0", "AGPL-3.0", "Python-2.0", "Apache-1.1", "MPL-1.1", "Unicode-3.0", "NCSA", "PostgreSQL", "BlueOak-1.0.0"})
SENTENCES |= {f"spdx-{name.lower()}": f"SPDX-License-Identifier: {name}" for name in TAGGED}
RULES += [(name, [f"spdx-{name.lower()}"]) for name in TAGGED]
GAP = 3
#: A piece ends at a line end or after one of these and a space, but not after "v.".
ENDS = r"\r\n|[\n\r]|(?<=[.!?;])(?<!\b[vV]\.)[ \t]+"
#: What opens a line of a comment, and what closes it.
LEADER = r"^[ \t]*(?:(?://+|/?\*+/?|#+|--+|;+|%+|>+|<!--+|[\"']{3}|dnl\b|rem\b)[ \t]*)*|[ \t]*(?:\*+/|--+>)?[ \t]*$"
#: A sentence ends with a piece that ends so; a shorter piece is a sentence, a longer one may be part of a wrapped sentence.
STOP, WRAPPED = r"[.!?;:][\"')\]]*$", 30
#: Pieces that a known sentence is wrapped in at most.
WIDTH = 24
#: Words of which every known sentence has one; a document without any has no known sentence.
CUES = r"(?i)licen[cs]e|permi|copyright|redistribut|warrant|reserved|unencumbered|cc0 1\.0|the eupl|a copy of the mpl|software is proprietary|advertising materials|unauthorized copying|x consortium"
#: What a tag begins with, and what stands between the licences of its expression.
TAG, JOINS = "spdx-license-identifier", ["and", "or", "with"]


def normalised(sentence: Column) -> Column:
    s = F.lower(sentence)
    s = F.regexp_replace(s, r"^.*copyright *(\(c\)|©)? *[0-9][0-9, -]*.*$", "copyright notice of holder")
    return F.trim(F.regexp_replace(s, r"(?:[^a-z0-9.+/-]|\.(?= |$)|(?<=[a-z])\.)+", " "))


def sentence_table(spark: SparkSession, sentences: dict[str, str] = SENTENCES, whole: dict[str, str] = WHOLE) -> DataFrame:
    t = spark.createDataFrame(sorted(sentences.items()) + sorted(whole.items()), "sentence_id string, sentence string")
    return t.select("sentence_id", normalised(F.col("sentence")).alias("sentence"))


def sentences(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, copies and the known sentences of each different row of docs in order: ids array<struct<nth, sentence_id>>.

    Rows are known by id and text (two 64-bit hashes); copies counts the rows that are equal in both.

    nth counts sentences; a known sentence is one, in however many pieces. Where known sentences overlap, the first and
    longest counts.
    """
    table = [r.sentence for r in known.collect()]
    heads, longest = sorted({x.split(" ")[0] for x in table}), max(map(len, table))
    d = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    row = ["doc_id", "k", "v"]
    cut = F.when(F.col("text").rlike(CUES), F.transform(F.split(F.col("text"), ENDS, -1), lambda x: F.regexp_replace(x, LEADER, "")))
    d = d.select("doc_id", F.xxhash64("text").alias("k"), F.xxhash64(F.lit(1), "text").alias("v"), cut.alias("pieces"))
    ends = F.transform("pieces", lambda x, i: (x != "") & (x.rlike(STOP) | (F.length(x) < WRAPPED) | (F.coalesce(F.get("pieces", i + 1), F.lit("")) == "")))
    starts = F.filter(F.sequence(F.lit(0), F.size("pieces") - 1), lambda i: F.get("pieces", i).rlike(rf"(?i)^[^a-z0-9]*({'|'.join(heads)})(?![a-z0-9])") & F.array_join(F.slice("pieces", i + 1, WIDTH), " ").rlike(CUES))
    d = d.select(*row, "pieces", ends.alias("ends"), F.when(F.col("pieces").isNotNull(), starts).alias("starts"))
    count = lambda at, n: F.size(F.filter(F.slice("ends", at, n), lambda x: x))
    begun = F.transform("starts", lambda i: F.struct(i.alias("at"), count(F.lit(1), i).alias("nth"), F.transform(F.slice("pieces", i + 1, WIDTH), normalised).alias("pieces")))
    d = d.select(*row, "ends", begun.alias("begun"))
    each = lambda b: F.transform(F.sequence(F.lit(1), F.size(b["pieces"])), lambda n: F.struct(b["at"].alias("at"), n.alias("n"), b["nth"].alias("nth"), count(b["at"] + 1, n - 1).alias("inner"), F.array_join(F.slice(b["pieces"], 1, n), " ").alias("sentence")))
    whole = lambda x: F.length(x["sentence"]) <= longest
    made = F.filter(F.flatten(F.transform("begun", each)), lambda x: whole(x) & ~x["sentence"].startswith(TAG))
    names = lambda b: F.filter(F.split(F.get(b["pieces"], F.lit(0)), " "), lambda w: ~w.isin(TAG, *JOINS))
    tag = lambda b: F.transform(names(b), lambda w: F.struct(b["at"].alias("at"), F.lit(1).alias("n"), b["nth"].alias("nth"), F.lit(0).alias("inner"), F.concat(F.lit(f"{TAG} "), w).alias("sentence")))
    made = F.concat(made, F.flatten(F.transform(F.filter("begun", lambda b: F.get(b["pieces"], F.lit(0)).startswith(TAG)), tag)))
    rows = d.select(*row, F.posexplode_outer(made).alias("pos", "c")).select(*row, "pos", "c.*")
    hit = rows.join(F.broadcast(known), "sentence", "left").filter("sentence_id is not null or pos is null or pos = 0")
    hit = hit.groupBy(*row).agg(F.count_if(F.coalesce(F.col("pos") == 0, F.lit(True))).alias("copies"), F.array_sort(F.collect_set(F.when(F.col("sentence_id").isNotNull(), F.struct("at", "n", "nth", "inner", "sentence_id")))).alias("ids"))
    hit = hit.withColumn("long", F.filter("ids", lambda y: y["n"] > 1))
    over = lambda x: F.exists("long", lambda y: ((y["at"] < x["at"]) & (x["at"] < y["at"] + y["n"])) | ((y["at"] == x["at"]) & (y["n"] > x["n"])))
    hit = hit.withColumn("ids", F.filter("ids", lambda x: ~over(x))).withColumn("long", F.filter("ids", lambda y: y["inner"] > 0))
    parted = lambda x: F.aggregate("long", F.lit(0), lambda sum_, y: sum_ + F.when(y["at"] < x["at"], y["inner"]).otherwise(0))
    return hit.select("doc_id", "copies", F.transform("ids", lambda x: F.struct((x["nth"] - parted(x)).alias("nth"), x["sentence_id"].alias("sentence_id"))).alias("ids"))


def matched(ids: list[tuple[int, str]], rules: list[tuple[str, list[str]]], gap: int = GAP) -> list[str]:
    """The licences of the rules that match (nth, identifier) in order, strongest rule first, each licence once.

    A rule matches as often as it can, each time the match that ends first, by the latest identifiers up to there; what it
    has matched is taken, and weaker rules read only what is left.
    """
    free, out = list(ids), []
    by: dict[str, list[list[str]]] = {}
    held = {x for _, x in free}
    for name, rule in rules:
        while held.issuperset(rule):
            ends: list[list[int]] = [[] for _ in rule]  # places of the latest match up to each identifier
            done = None
            for i, (nth, x) in enumerate(free):
                for k in reversed(range(len(rule))):
                    if x == rule[k] and (k == 0 or (ends[k - 1] and nth - free[ends[k - 1][-1]][0] <= gap + 1)):
                        ends[k] = [*(ends[k - 1] if k else []), i]
                        if k == len(rule) - 1:
                            done = ends[k]
                if done:
                    break
            if not done:
                break
            by.setdefault(name, []).append(rule)
            free = [x for i, x in enumerate(free) if i not in done]
            held = {x for _, x in free}
    for name, _ in rules:
        if name in by and name not in out:
            out.append(name)
    return out


def _licences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids = [[(s["nth"], s["sentence_id"]) for s in row] for row in b.column(2).to_pylist()]
        found = pa.array([",".join(matched(x, RULES)) if x else "" for x in ids], pa.string())
        names = pa.array([",".join(s for _, s in x) for x in ids], pa.string())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(x) for x in ids], pa.int64()), names, found], ["doc_id", "copies", "n_sentences", "sentence_ids", "licences"])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_sentences, sentence_ids, licences for each row of docs.

    licences: each once, in the order of RULES, of the rules that matched() finds. Null and empty texts have none, a null id
    stays null, equal rows give equal rows, an empty table gives none, other columns are not looked at.
    """
    found = sentences(docs, sentence_table(docs.sparkSession), id_col, text_col)
    kind = found.schema["doc_id"].dataType.simpleString()
    found = found.select("doc_id", "copies", "ids").mapInArrow(_licences, f"doc_id {kind}, copies long, n_sentences long, sentence_ids string, licences string")
    block = 1 << 15  # no array holds more copies
    found = found.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / block))).alias("b"))
    found = found.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(block).cast("long"), F.col("copies") - F.col("b") * block))).alias("copy"))
    return found.select("doc_id", "n_sentences", "sentence_ids", "licences")
