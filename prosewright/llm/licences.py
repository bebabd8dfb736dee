r"""Licence recognition by sentence rules.

Known licence sentences have identifiers. A text is put into normal form: lower
case, every run of characters that are neither letters nor digits is one break
between words. So line feeds, comment marks, numbering and punctuation are all
alike, and a known sentence is found wherever its words stand in a row, within
a sentence of the text too ("This file is licensed under the MIT License.").
At each place the longest known sentence counts.

The sequence of identifiers is then matched against ordered rules: a licence
and the identifiers that must occur in this order, with at most ``MAX_GAP``
other known sentences between two of them. A rule uses up the identifiers it
has matched, so a rule that asks for more comes first: three BSD clauses are
not two BSD clauses as well.

All of it is a narrow projection of built-in functions: no row meets another
one, so no source or group of copies can be hot, and nothing is broadcast but
the rule book's own literals. The book is one pattern in which sentences share
their beginnings, so its cost does not grow with their number.

Defined results: null, empty and unlicensed texts have no identifiers and no
licences; whole texts are read; repeated sentences are repeated identifiers,
each licence is named once, where it first occurs; ids and other columns are
passed by.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_GAP = 2

#: Sentences of well-known licences, and their identifiers.
SENTENCES: dict[str, str] = {
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so': "mit.grant",
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software": "mit.notice_kept",
    "The above copyright notice and this permission notice (including the next paragraph) shall be included in all copies or substantial portions of the Software": "mit.notice_kept",
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED': "mit.as_is",
    "you may not use this file except in compliance with the License": "apache2.comply",
    "You may obtain a copy of the License at": "apache2.copy_at",
    'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied': "apache2.as_is",
    "Apache License Version 2.0, January 2004": "apache2.title",
    "TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION": "apache2.terms",
    "How to apply the Apache License to your work": "apache2.howto",
    "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007": "gpl3.title",
    "GNU GENERAL PUBLIC LICENSE Version 2, June 1991": "gpl2.title",
    "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007": "lgpl3.title",
    "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999": "lgpl21.title",
    "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007": "agpl3.title",
    "How to Apply These Terms to Your New Programs": "gnu.howto",
    "How to Apply These Terms to Your New Libraries": "gnu.howto",
    "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation": "gpl.grant",
    "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation": "lgpl.grant",
    "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation": "agpl.grant",
    "you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation": "gpl2.only",
    "you can redistribute it and/or modify it under the terms of the GNU General Public License version 3 as published by the Free Software Foundation": "gpl3.only",
    "you can redistribute it and/or modify it under the terms of version 2 of the GNU General Public License": "gpl2.only",
    "either version 2 of the License, or (at your option) any later version": "gnu.v2_later",
    "either version 2.1 of the License, or (at your option) any later version": "gnu.v21_later",
    "either version 3 of the License, or (at your option) any later version": "gnu.v3_later",
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY": "gnu.hope",
    "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY": "gnu.hope",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met": "bsd.grant",
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer": "bsd.source",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution": "bsd.binary",
    "All advertising materials mentioning features or use of this software must display the following acknowledgement": "bsd.advertising",
    "the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd.names",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0": "mpl2.notice",
    "Mozilla Public License Version 2.0": "mpl2.title",
    "The contents of this file are subject to the Mozilla Public License Version 1.1": "mpl11.notice",
    "Mozilla Public License Version 1.1": "mpl11.title",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted": "isc.grant",
    "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted": "isc.grant",
    "provided that the above copyright notice and this permission notice appear in all copies": "isc.proviso",
    "This is free and unencumbered software released into the public domain": "unlicense.notice",
    "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software": "zlib.altered",
    "This software is provided 'as-is', without any express or implied warranty": "zlib.as_is",
    "Boost Software License - Version 1.0": "bsl.title",
    "Eclipse Public License - v 2.0": "epl2.title",
    "CC0 1.0 Universal": "cc0.title",
    "all rights reserved": "reserved.notice",
}

#: Names that stand in a notice such as "licensed under the ...".
NAMES: dict[str, list[str]] = {
    "MIT": ["MIT License", "MIT Licence"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU General Public License v2.0", "GPLv2", "GPL v2"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU General Public License v3.0", "GPLv3", "GPL v3"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v2.1", "LGPL v2.1"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3.0", "LGPLv3", "LGPL v3"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0", "AGPLv3", "AGPL v3"],
    "BSD-2-Clause": ["BSD 2-Clause License", "2-clause BSD license", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "3-clause BSD license", "New BSD License"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "CC-BY-NC-SA-4.0": ["CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"],
    "CC-BY-NC-ND-4.0": ["CC BY-NC-ND 4.0", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"],
    "CC0-1.0": ["CC0 1.0", "Creative Commons Zero 1.0"],
    "MPL-1.1": ["MPL 1.1", "MPL-1.1"],
    "MPL-2.0": ["MPL 2.0", "Mozilla Public License 2.0"],
    "ISC": ["ISC License"],
    "Zlib": ["zlib License"],
    "Unlicense": ["Unlicense"],
    "BSL-1.0": ["Boost Software License 1.0"],
    "EPL-2.0": ["Eclipse Public License 2.0", "Eclipse Public License version 2.0"],
}
#: What stands before a name in a notice.
LEADS = [f"{verb} under {article}" for verb in ("licensed", "released", "distributed", "available", "published", "licenced") for article in ("", "the ", "a ", "the terms of the ")]
LEADS += ["SPDX-License-Identifier: "]

#: Licence and the identifiers that must follow each other; a rule that asks for more comes first.
RULES: list[tuple[str, list[str]]] = [
    ("Apache-2.0", ["apache2.title", "apache2.terms", "apache2.howto", "apache2.notice", "apache2.comply", "apache2.copy_at", "apache2.as_is"]),
    ("Apache-2.0", ["apache2.title", "apache2.terms"]),
    ("Apache-2.0", ["apache2.notice", "apache2.comply", "apache2.copy_at", "apache2.as_is"]),
    ("Apache-2.0", ["apache2.notice"]),
    ("GPL-3.0", ["gpl3.title", "gnu.howto", "gpl.grant", "gnu.v3_later", "gnu.hope"]),
    ("GPL-3.0", ["gpl3.title"]),
    ("GPL-2.0", ["gpl2.title", "gnu.howto", "gpl.grant", "gnu.v2_later", "gnu.hope"]),
    ("GPL-2.0", ["gpl2.title"]),
    ("LGPL-2.1", ["lgpl21.title", "gnu.howto", "lgpl.grant", "gnu.v21_later", "gnu.hope"]),
    ("LGPL-2.1", ["lgpl21.title"]),
    ("LGPL-3.0", ["lgpl3.title"]),
    ("AGPL-3.0", ["agpl3.title", "gnu.howto", "agpl.grant", "gnu.v3_later", "gnu.hope"]),
    ("AGPL-3.0", ["agpl3.title"]),
    ("GPL-3.0-or-later", ["gpl.grant", "gnu.v3_later"]),
    ("GPL-2.0-or-later", ["gpl.grant", "gnu.v2_later"]),
    ("LGPL-3.0-or-later", ["lgpl.grant", "gnu.v3_later"]),
    ("LGPL-2.1-or-later", ["lgpl.grant", "gnu.v21_later"]),
    ("AGPL-3.0-or-later", ["agpl.grant", "gnu.v3_later"]),
    ("GPL-2.0", ["gpl2.only"]),
    ("GPL-3.0", ["gpl3.only"]),
    ("MIT", ["mit.grant", "mit.notice_kept"]),
    ("MIT-0", ["mit.grant", "mit.as_is"]),
    ("BSD-4-Clause", ["bsd.grant", "bsd.source", "bsd.binary", "bsd.advertising", "bsd.names"]),
    ("BSD-3-Clause", ["bsd.grant", "bsd.source", "bsd.binary", "bsd.names"]),
    ("BSD-2-Clause", ["bsd.grant", "bsd.source", "bsd.binary"]),
    ("ISC", ["isc.grant", "isc.proviso"]),
    ("0BSD", ["isc.grant"]),
    ("MPL-2.0", ["mpl2.title", "mpl2.notice"]),
    ("MPL-2.0", ["mpl2.notice"]),
    ("MPL-2.0", ["mpl2.title"]),
    ("MPL-1.1", ["mpl11.title", "mpl11.notice"]),
    ("MPL-1.1", ["mpl11.notice"]),
    ("MPL-1.1", ["mpl11.title"]),
    ("Unlicense", ["unlicense.notice"]),
    ("Zlib", ["zlib.as_is", "zlib.altered"]),
    ("BSL-1.0", ["bsl.title"]),
    ("EPL-2.0", ["epl2.title"]),
    ("CC0-1.0", ["cc0.title"]),
]


def normal(sentence: str) -> str:
    """The words of a sentence, two spaces between each two: a pattern can take one of them."""
    return "  ".join(re.findall(r"[^\W_]+", sentence.lower()))


def notice_id(name: str) -> str:
    return "apache2.notice" if name == "Apache-2.0" else f"{name}.notice"


def known(sentences: dict[str, str], names: dict[str, list[str]] | None = None) -> dict[str, str]:
    """Normal form to identifier; two identifiers of one form are refused."""
    pairs = list(sentences.items())
    for name, forms in (names or {}).items():
        spdx = [f"SPDX-License-Identifier: {name}"]
        pairs += [(t, notice_id(name)) for t in spdx + [lead + form for form in forms for lead in LEADS]]
    out: dict[str, str] = {}
    for text, identifier in pairs:
        if out.setdefault(normal(text), identifier) != identifier:
            raise ValueError(f"{identifier} and {out[normal(text)]} have one normal form")
    return out


def with_notices(rules: list[tuple[str, list[str]]], names: dict[str, list[str]]) -> list[tuple[str, list[str]]]:
    """The rules, and one for each name's notice."""
    return rules + [(name, [notice_id(name)]) for name in names if (name, [notice_id(name)]) not in rules]


def book_pattern(book: dict[str, str]) -> str:
    """Any known form between two spaces, the longest at its place; forms share their beginnings."""
    tree: dict = {}
    for form in book:
        node = tree
        for word in form.split("  "):
            node = node.setdefault(word, {})
        node[""] = {}

    def of(node: dict) -> str:
        options = []
        for word in sorted(w for w in node if w):
            run, below = re.escape(word), node[word]
            while len(below) == 1 and "" not in below:
                (following, below), = below.items()
                run += "  " + re.escape(following)
            if set(below) - {""}:
                run += f"(?:  {of(below)})" + ("?" if "" in below else "")
            options.append(run)
        return options[0] if len(options) == 1 else "(?:" + "|".join(options) + ")"

    return f" ({of(tree)}) "


def rule_pattern(ids: list[str]) -> str:
    """A rule as a pattern over identifiers, each between spaces of its own; a group for what lies between two of them."""
    gap = r"((?: \S+ ){0,%d}?)" % MAX_GAP
    return gap.join(f" {re.escape(i)} " for i in ids)


def rule_result(name: str, ids: list[str], group: str) -> str:
    return f" ={name} " + "".join(f"{group}{k}" for k in range(1, len(ids)))


def sentence_ids(text: Column, book: dict[str, str]) -> Column:
    """The identifiers of a text's known sentences, in order."""
    words = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", "  ")
    found = F.regexp_extract_all(F.concat(F.lit("  "), words, F.lit("  ")), F.lit(book_pattern(book)), F.lit(1))
    names = F.create_map(*[F.lit(x) for pair in book.items() for x in pair])
    return F.transform(found, lambda s: F.element_at(names, s))


def licences_of(ids: Column, rules: list[tuple[str, list[str]]]) -> Column:
    """The licences that an array of identifiers amounts to, in order."""
    line = F.concat(F.lit(" "), F.array_join(ids, "  "), F.lit(" "))
    for name, sequence in rules:
        line = F.regexp_replace(line, rule_pattern(sequence), rule_result(name, sequence, "$"))
    return F.when(F.size(ids) == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(F.regexp_extract_all(line, F.lit(r" =(\S+) "), F.lit(1))))


def scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    sentences: dict[str, str] | None = None,
    rules: list[tuple[str, list[str]]] | None = None,
    names: dict[str, list[str]] | None = None,
) -> DataFrame:
    """One row per document: ``doc_id``, ``sentence_ids`` and ``licences``, both arrays of strings."""
    sentences, rules, names = sentences or SENTENCES, rules or RULES, NAMES if names is None else names
    found = docs.select(F.col(id_col).alias("doc_id"), sentence_ids(F.col(text_col).cast("string"), known(sentences, names)).alias("sentence_ids"))
    return found.withColumn("licences", licences_of(F.col("sentence_ids"), with_notices(rules, names)))


def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its licences and its known sentences, both in the text's order."""
    got = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return got.select(
        "doc_id",
        F.concat_ws(",", "licences").alias("licences"),
        F.concat_ws(",", "sentence_ids").alias("sentence_ids"),
        F.size("licences").cast("long").alias("n_licences"),
    )


def oracle() -> str:
    """The same in DuckDB's SQL."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    book = known(SENTENCES, NAMES)
    forms, names = ", ".join(map(quote, book)), ", ".join(map(quote, book.values()))
    line = "' ' || array_to_string(ids, '  ') || ' '"
    for name, ids in with_notices(RULES, NAMES):
        line = f"regexp_replace({line}, {quote(rule_pattern(ids))}, {quote(rule_result(name, ids, chr(92)))}, 'g')"
    return f"""
WITH found AS (
  SELECT doc_id, regexp_extract_all('  ' || regexp_replace(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+', '  ', 'g') || '  ', {quote(book_pattern(book))}, 1) AS found FROM documents
), named AS (
  SELECT doc_id, list_transform(found, lambda s: list_extract([{names}], list_position([{forms}], s))) AS ids FROM found
), hits AS (
  SELECT doc_id, ids, CASE WHEN len(ids) = 0 THEN [] ELSE regexp_extract_all({line}, ' =(\\S+) ', 1) END AS hits FROM named
), each AS (
  SELECT doc_id, ids, list_filter(hits, lambda x, i: list_position(hits, x) = i) AS licences FROM hits
)
SELECT doc_id, array_to_string(licences, ',') AS licences, array_to_string(ids, ',') AS sentence_ids,
  CAST(len(licences) AS BIGINT) AS n_licences FROM each
"""
