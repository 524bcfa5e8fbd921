"""Licence recognition by sentence rules, in DataFrame operations only.

A text's sentences are normalised and looked up among known licence sentences; what is found is
the text's sequence of sentence identifiers. A rule is an ordered list of identifiers; it
matches where they follow each other with at most GAP other known sentences between two of them
and no more than FAR sentences apart. Everything happens within a document's row: no shuffle.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GAP, FAR = 2, 12

#: Known sentences by identifier, as they read in the licences and their notices.
SENTENCES = {
    "mit-notice": ["Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the MIT License.", "SPDX-License-Identifier: MIT", "The MIT License (MIT)", "MIT License"],
    "mit-grant": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"],
    "mit-condition": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "mit-warranty": ["THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."],
    "isc-notice": ["ISC License", "The ISC License", "Licensed under the ISC License.", "SPDX-License-Identifier: ISC"],
    "isc-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
                  "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "isc-warranty": ["THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."],
    "0bsd-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."],
    "apache-2-notice": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\");", "This project is licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0"],
    "apache-2-use": ["you may not use this file except in compliance with the License."],
    "apache-2-copy": ["You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0", "You may obtain a copy of the License at"],
    "apache-2-url": ["http://www.apache.org/licenses/LICENSE-2.0", "https://www.apache.org/licenses/LICENSE-2.0"],
    "apache-2-warranty": ["Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."],
    "apache-2-terms": ["TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"],
    "apache-2-licensor": ["\"License\" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document."],
    "apache-2-patent": ["Grant of Patent License."],
    "gpl-3-notice": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-or-later"],
    "gpl-free": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "gpl-2-free": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
                   "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation;"],
    "gpl-2-later": ["either version 2 of the License, or (at your option) any later version."],
    "gpl-warranty": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;"],
    "gpl-2-notice": ["This work is licensed under the GNU General Public License, version 2.", "Licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0-or-later"],
    "gpl-preamble": ["The GNU General Public License is a free, copyleft license for software and other kinds of works."],
    "gpl-2-preamble": ["The licenses for most software are designed to take away your freedom to share and change it."],
    "gpl-copies": ["Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."],
    "lgpl-notice": ["SPDX-License-Identifier: LGPL-2.1-only", "SPDX-License-Identifier: LGPL-2.1-or-later", "SPDX-License-Identifier: LGPL-3.0-only", "SPDX-License-Identifier: LGPL-3.0-or-later", "Licensed under the GNU Lesser General Public License."],
    "lgpl-free": ["you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation;",
                  "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "lgpl-warranty": ["This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;"],
    "agpl-notice": ["SPDX-License-Identifier: AGPL-3.0-only", "SPDX-License-Identifier: AGPL-3.0-or-later", "Licensed under the GNU Affero General Public License, version 3."],
    "agpl-free": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "mpl-2-notice": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."],
    "mpl-2-copy": ["If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "epl-2-notice": ["SPDX-License-Identifier: EPL-2.0", "Licensed under the Eclipse Public License 2.0."],
    "epl-2-terms": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at"],
    "bsd-notice": ["Licensed under the BSD License.", "SPDX-License-Identifier: BSD-3-Clause", "SPDX-License-Identifier: BSD-2-Clause"],
    "bsd-grant": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "bsd-source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."],
    "bsd-binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."],
    "bsd-name": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "zlib-warranty": ["This software is provided 'as-is', without any express or implied warranty."],
    "zlib-grant": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"],
    "boost-notice": ["Distributed under the Boost Software License, Version 1.0.", "SPDX-License-Identifier: BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003"],
    "unlicense-domain": ["This is free and unencumbered software released into the public domain."],
    "unlicense-notice": ["SPDX-License-Identifier: Unlicense", "Released under the Unlicense."],
    "wtfpl": ["DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE", "SPDX-License-Identifier: WTFPL"],
    "cc-by-notice": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-sa-notice": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc-by-nc-notice": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by-nd-notice": ["Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."],
    "cc0-notice": ["Released under CC0 1.0 Universal (Public Domain Dedication License).", "SPDX-License-Identifier: CC0-1.0", "This work is dedicated to the public domain under CC0 1.0."],
    "rights": ["All rights reserved."],
}

#: Rules as (rule, licence, sentence identifiers in order).
RULES = [
    ("mit-text", "MIT", ["mit-grant", "mit-condition", "mit-warranty"]),
    ("mit-notice", "MIT", ["mit-notice"]),
    ("isc-text", "ISC", ["isc-grant", "isc-warranty"]),
    ("isc-notice", "ISC", ["isc-notice"]),
    ("0bsd-text", "0BSD", ["0bsd-grant", "isc-warranty"]),
    ("apache-2.0-text", "Apache-2.0", ["apache-2-terms", "apache-2-licensor", "apache-2-patent"]),
    ("apache-2.0-header", "Apache-2.0", ["apache-2-notice", "apache-2-use", "apache-2-copy", "apache-2-warranty"]),
    ("apache-2.0-notice", "Apache-2.0", ["apache-2-notice"]),
    ("gpl-3.0-text", "GPL-3.0", ["gpl-copies", "gpl-preamble"]),
    ("gpl-3.0-header", "GPL-3.0", ["gpl-free", "gpl-warranty"]),
    ("gpl-3.0-notice", "GPL-3.0", ["gpl-3-notice"]),
    ("gpl-2.0-text", "GPL-2.0", ["gpl-copies", "gpl-2-preamble"]),
    ("gpl-2.0-header", "GPL-2.0", ["gpl-2-free", "gpl-2-later", "gpl-warranty"]),
    ("gpl-2.0-notice", "GPL-2.0", ["gpl-2-notice"]),
    ("lgpl-header", "LGPL", ["lgpl-free", "lgpl-warranty"]),
    ("lgpl-notice", "LGPL", ["lgpl-notice"]),
    ("agpl-3.0-header", "AGPL-3.0", ["agpl-free", "gpl-warranty"]),
    ("agpl-3.0-notice", "AGPL-3.0", ["agpl-notice"]),
    ("mpl-2.0-header", "MPL-2.0", ["mpl-2-notice", "mpl-2-copy"]),
    ("mpl-2.0-notice", "MPL-2.0", ["mpl-2-notice"]),
    ("epl-2.0-header", "EPL-2.0", ["epl-2-terms"]),
    ("epl-2.0-notice", "EPL-2.0", ["epl-2-notice"]),
    ("bsd-3-text", "BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-name"]),
    ("bsd-2-text", "BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("bsd-notice", "BSD", ["bsd-notice"]),
    ("zlib-text", "Zlib", ["zlib-warranty", "zlib-grant"]),
    ("boost-1.0-notice", "BSL-1.0", ["boost-notice"]),
    ("unlicense-text", "Unlicense", ["unlicense-domain"]),
    ("unlicense-notice", "Unlicense", ["unlicense-notice"]),
    ("wtfpl", "WTFPL", ["wtfpl"]),
    ("cc-by-notice", "CC-BY-4.0", ["cc-by-notice"]),
    ("cc-by-sa-notice", "CC-BY-SA-4.0", ["cc-by-sa-notice"]),
    ("cc-by-nc-notice", "CC-BY-NC-4.0", ["cc-by-nc-notice"]),
    ("cc-by-nd-notice", "CC-BY-ND-4.0", ["cc-by-nd-notice"]),
    ("cc0-notice", "CC0-1.0", ["cc0-notice"]),
    ("all-rights-reserved", "proprietary", ["rights"]),
]

#: Every known sentence has one of these, in small letters; a text or sentence without any has or is none.
MAY = ["licens", "licenc", "permi", "warrant", "copyright", "distribut", "rights reserved", "public domain"]
#: Where sentences end: white space after a stop; and either every line's end or empty lines only.
_STOP = r"(?<=[.!?;][\"')\]]{0,2})\s+"
SEGMENTATIONS = [rf"{_STOP}|\s*\n\s*", rf"{_STOP}|\s*\n\s*\n\s*"]


def normal(text: str) -> str:
    return re.sub("[^a-z0-9]+", " ", text.lower()).strip()


def _pattern(ids: list[str]) -> str:
    between = rf"(?:[0-9]+=\S+ ){{0,{GAP}}}?"
    return r"(?<!\S)" + between.join(f"[0-9]+={i} " for i in ids)


def _may(text: Column) -> Column:
    """Whether text in small letters has any of the words of MAY."""
    found = F.contains(text, F.lit(MAY[0]))
    for word in MAY[1:]:
        found = found | F.contains(text, F.lit(word))
    return found


def _sequence(low: Column, pattern: str) -> Column:
    """Known sentences of a text in small letters: struct of place and 'place=identifier '."""
    known = F.create_map(*[F.lit(x) for i, said in SENTENCES.items() for s in said for x in (normal(s), i)])
    plain = lambda s: F.btrim(F.regexp_replace(s, "[^a-z0-9]+", " "))
    found = F.transform(F.split(low, pattern, -1), lambda s, i: F.struct(i.alias("i"), s.alias("s")))
    found = F.filter(found, lambda x: _may(x["s"]))
    found = F.transform(found, lambda x: F.struct(x["i"].alias("i"), F.try_element_at(known, plain(x["s"])).alias("id")))
    found = F.filter(found, lambda x: x["id"].isNotNull())
    return F.transform(found, lambda x: F.struct(x["i"].alias("i"), F.concat(x["i"].cast("string"), F.lit("="), x["id"], F.lit(" ")).alias("s")))


def _spaced(q: str):
    """Elements of a sequence, with a break before those far from the one before."""

    def one(x: Column, k: Column) -> Column:
        before = F.get(F.col(q), k - 1)
        return F.concat(F.when((k > 0) & (x["i"] - before["i"] > FAR), "# ").otherwise(""), x["s"])

    return one


def _matches(sequence: Column, name: str, licence: str, ids: list[str]) -> Column:
    def one(m: Column) -> Column:
        place = lambda x: F.regexp_extract(m, x, 1).cast("int")
        return F.struct(F.lit(licence).alias("license"), F.lit(name).alias("rule"), place(r"^([0-9]+)=").alias("first"),
                        place(r"([0-9]+)=\S+ $").alias("last"), F.lit(len(ids)).alias("n"))

    return F.transform(F.regexp_extract_all(sequence, F.lit(_pattern(ids)), F.lit(0)), one)


def _parts(rule: tuple) -> list[str]:
    """Names of shorter rules of the same licence whose sentences the rule has too."""
    return [name for name, licence, ids in RULES if licence == rule[1] and set(ids) < set(rule[2])]


def _outermost(q: str):
    """Matches that no match of a longer rule holds."""
    return lambda x: ~F.exists(F.col(q), lambda y: (y["n"] > x["n"]) & (y["first"] <= x["first"]) & (x["last"] <= y["last"]))


def scan(docs: DataFrame) -> DataFrame:
    """Licences that texts (doc_id, text) hold: one row per document row and licence.

    Columns: doc_id, license, rules (names, sorted), n_matches, n_sentences (of the longest
    rule), first_sentence (the least place of a match; sentences are counted by lines and stops,
    or by paragraphs and stops where only those show the rule). A match inside that of a longer
    rule doesn't count. Null and empty texts have none; repeated rows are reported each; very long
    texts are scanned whole; an empty table gives no rows; other columns are ignored, whatever
    their names. Licences that the lists above don't name give no row."""
    low = F.lower(F.col("text").cast("string"))
    rows = docs.select(F.col("doc_id").cast("long"), low.alias("low")).where(_may(F.col("low")))
    for q, pattern in zip(("q0", "q1"), SEGMENTATIONS, strict=True):
        rows = rows.withColumn(q, _sequence(F.col("low"), pattern))
    # a step that Spark doesn't merge with the next, so that each sequence is made once
    rows = rows.select("doc_id", F.explode(F.array(F.struct("q0", "q1"))).alias("q")).select("doc_id", "q.q0", "q.q1")
    rows = rows.where((F.size("q0") > 0) | (F.size("q1") > 0))
    none = F.array().cast("array<struct<license:string,rule:string,first:int,last:int,n:int>>")
    for q in ("q0", "q1"):
        rows = rows.withColumn(q, F.array_join(F.transform(q, _spaced(q)), ""))
        some = F.flatten(F.array(*[F.when(F.contains(F.col(q), F.lit(f"={rule[2][0]} ")), _matches(F.col(q), *rule)).otherwise(none) for rule in RULES]))
        rows = rows.withColumn(q, some).withColumn(q, F.filter(q, _outermost(q)))
    # by paragraphs: rules that lines don't show; and no rule that is part of one that the other way shows
    parts = F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*[F.lit(p) for p in x]).cast("array<string>") for rule in RULES for x in (rule[0], _parts(rule))])
    part = lambda x, y: F.array_contains(F.element_at(parts, y["rule"]), x["rule"])
    lines = F.filter("q0", lambda x: ~F.exists("q1", lambda y: part(x, y)))
    more = F.filter("q1", lambda x: ~F.exists("q0", lambda y: (x["rule"] == y["rule"]) | part(x, y)))
    rows = rows.withColumn("all", F.concat(lines, more)).where(F.size("all") > 0)
    rows = rows.select("doc_id", "all", F.explode(F.array_distinct(F.transform("all", lambda x: x["license"]))).alias("license"))
    own = F.filter("all", lambda x: x["license"] == F.col("license"))
    rows = rows.select("doc_id", "license", own.alias("own"))
    return rows.select(
        "doc_id", "license", F.array_join(F.array_sort(F.array_distinct(F.transform("own", lambda x: x["rule"]))), ",").alias("rules"),
        F.size("own").alias("n_matches"), F.array_max(F.transform("own", lambda x: x["n"])).alias("n_sentences"),
        F.array_min(F.transform("own", lambda x: x["first"])).alias("first_sentence"))


def op10_licenses(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
