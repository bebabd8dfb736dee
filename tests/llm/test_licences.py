"""Licence rules on texts as they are found in files, with literal expectations."""

import pytest

from prosewright.llm import licences

MIT = """MIT License

Copyright (c) 2020 Some Body

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
"""
BSD2 = """Copyright (c) 2019, Some Body
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD3 = BSD2 + """
3. Neither the name of the Some University nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
"""
ZERO_BSD = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted.
"""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
"""


def gnu(name, version, mark=":", thing="program"):
    c = "," if mark == ":" else ";"
    return f"""This {thing} is free software{mark} you can redistribute it and/or modify
it under the terms of the GNU {name} as published by
the Free Software Foundation{c} either version {version} of the License, or
(at your option) any later version.

This {thing} is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
"""


GPL, LGPL, AGPL = "General Public License", "Lesser General Public License", "Affero General Public License"
GPL2_ONLY = """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License version 2 as
published by the Free Software Foundation.
"""
GPL3_TEXT = """                    GNU GENERAL PUBLIC LICENSE
                       Version 3, 29 June 2007

 Everyone is permitted to copy and distribute verbatim copies.

            How to Apply These Terms to Your New Programs

""" + gnu(GPL, "3")
GPL2_TEXT = """                    GNU GENERAL PUBLIC LICENSE
                       Version 2, June 1991

            How to Apply These Terms to Your New Programs

""" + gnu(GPL, "2", ";")
MPL2 = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""
MPL11 = """The contents of this file are subject to the Mozilla Public License Version
1.1 (the "License"); you may not use this file except in compliance with
the License. You may obtain a copy of the License at
http://www.mozilla.org/MPL/
"""
CASES = [
    (MIT, ["MIT"]), (BSD2, ["BSD-2-Clause"]), (BSD3, ["BSD-3-Clause"]), (ISC, ["ISC"]), (ZERO_BSD, ["0BSD"]), (APACHE, ["Apache-2.0"]),
    (gnu(GPL, "2", ";"), ["GPL-2.0-or-later"]), (gnu(GPL, "3"), ["GPL-3.0-or-later"]), (gnu(LGPL, "2.1", ";", "library"), ["LGPL-2.1-or-later"]),
    (gnu(LGPL, "3", thing="library"), ["LGPL-3.0-or-later"]), (gnu(AGPL, "3"), ["AGPL-3.0-or-later"]), (GPL2_ONLY, ["GPL-2.0"]),
    (GPL3_TEXT, ["GPL-3.0"]), (GPL2_TEXT, ["GPL-2.0"]), (MPL2, ["MPL-2.0"]), (MPL11, ["MPL-1.1"]), (BSD3 + "\n" + MIT, ["BSD-3-Clause", "MIT"]), (BSD2 + "\n" + BSD3, ["BSD-2-Clause", "BSD-3-Clause"]),
]
NOTICES = [
    ("This file is licensed under the MIT License.", ["MIT"]), ("licensed under CC BY-NC 4.0", ["CC-BY-NC-4.0"]), ("Licensed under CC BY 4.0 by all of us", ["CC-BY-4.0"]),
    ("x = 1  # SPDX-License-Identifier: GPL-2.0-only", ["GPL-2.0"]), ("// SPDX-License-Identifier: Apache-2.0", ["Apache-2.0"]),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", ["CC-BY-SA-4.0"]),
    ("this work is licensed under the GNU General Public License, version 3", ["GPL-3.0"]), ("The mit of license and the licence of mit.", []), ("All rights reserved.", []),
    ("unlicensed under the mitigation license", []), ("Released under the MIT License. Released under the MIT License.", ["MIT"]), ("", []), (None, []),
]


@pytest.mark.parametrize("prefix", ["", "# ", " * ", "// "])
def test_licence_texts(spark, prefix):
    texts = ["\n".join(prefix + line for line in t.split("\n")) for t, _ in CASES]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r["licences"] for r in licences.scan(docs).orderBy("doc_id").collect()]
    assert got == [want for _, want in CASES]


def test_notices(spark):
    docs = spark.createDataFrame([(k, t, "x", 1) for k, (t, _) in enumerate(NOTICES)], "doc_id long, text string, sentence_ids string, licences int")
    got = [r["licences"] for r in licences.scan(docs).orderBy("doc_id").collect()]
    assert got == [want for _, want in NOTICES]


def test_very_long_texts(spark):
    docs = spark.createDataFrame([(1, "word " * 400_000 + MIT), (2, "-" * 2_000_000 + BSD2), (3, "permission is hereby " * 100_000)], "doc_id long, text string")
    assert [r["licences"] for r in licences.scan(docs).orderBy("doc_id").collect()] == [["MIT"], ["BSD-2-Clause"], []]


def test_gaps_between_the_sentences_of_a_rule(spark):
    fill = " licensed under the MIT License."
    source = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
    texts = [BSD2.replace(source.split(" must")[0], fill * n + source.split(" must")[0]) for n in (2, 3)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r["licences"] for r in licences.scan(docs).orderBy("doc_id").collect()] == [["BSD-2-Clause", "MIT"], ["MIT"]]


def test_two_identifiers_of_one_form():
    with pytest.raises(ValueError):
        licences.known({"Some words: here": "a", "some words; HERE": "b"})
