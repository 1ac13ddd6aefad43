"""Licence texts, headers and references that stand in no given table, and rules against a brute-force matcher."""

from itertools import product

import numpy as np

from corvane.llm import licenses

APACHE = '''/*
 * Copyright 2020 The Authors
 *
 * Licensed under the Apache License, Version 2.0 (the "License");
 * you may not use this file except in compliance with the License.
 * You may obtain a copy of the License at
 *
 *     http://www.apache.org/licenses/LICENSE-2.0
 *
 * Unless required by applicable law or agreed to in writing, software
 * distributed under the License is distributed on an "AS IS" BASIS,
 * WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
 * See the License for the specific language governing permissions and
 * limitations under the License.
 */
int main() {}'''

MPL = '''/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at https://mozilla.org/MPL/2.0/. */'''

UNL = '''This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means.'''

GPL = '''    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.

    You should have received a copy of the GNU General Public License
    along with this program.  If not, see <https://www.gnu.org/licenses/>.'''

LGPL2 = '''This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.'''

BSD3 = '''BSD 3-Clause License

Copyright (c) 2020, Someone
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED.'''

ZLIB = '''This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not
   claim that you wrote the original software.'''

APACHE_TITLE = """
                                 Apache License
                           Version 2.0, January 2004
                        http://www.apache.org/licenses/

   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION

   1. Definitions."""
GPL_TITLE = """                    GNU GENERAL PUBLIC LICENSE
                       Version 3, 29 June 2007

 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>
 Everyone is permitted to copy and distribute verbatim copies
 of this license document, but changing it is not allowed."""

CASES = (
    (APACHE, "Apache-2.0", "ref apache-limits apache-copy apache-basis apache-see"), (MPL, "MPL-2.0", "mpl-subject mpl-copy"), (UNL, "Unlicense", "unlicense-free unlicense-anyone"),
    (GPL, "GPL-3-or-later", "gpl-free gpl-hope gpl-see gpl-copy gpl-copy"), (LGPL2, "LGPL-2.1-or-later", "gpl-free"), (BSD3, "BSD-3-Clause", "title bsd-grant bsd-source bsd-binary bsd-endorse as-is"),
    (ZLIB, "Zlib", "zlib-as-is liability zlib-grant zlib-origin"), (APACHE_TITLE, "Apache-2.0", "apache-title apache-terms"), (GPL_TITLE, "GPL-3", "gpl-title gpl-verbatim"),
    ("The code is released under GPLv3.", "GPL-3", "ref"), ("GPL-2.0-or-later", "GPL-2.0-or-later", "title"), ("BSD 3-Clause License", "BSD-3-Clause", "title"),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "CC-BY-4.0", "ref"),
    ("This project is licensed under the MIT License - see the LICENSE file for details.", "MIT", "ref"), ("# SPDX-License-Identifier: (MIT OR Apache-2.0)", "MIT OR APACHE-2.0", "spdx"),
    ("Licensed under either of the Apache License, Version 2.0 or the MIT license at your option.", "Apache-2.0 OR MIT", "ref"), ('license = "MIT"', "MIT", "title"),
    ("Distributed under the Boost Software License, Version 1.0. (See accompanying file)", "BSL-1.0", "ref"), ("available under the new BSD license", "BSD-3-Clause", "ref"),
    ("Released under the GNU Affero General Public License v3.0 or later.", "AGPL-3.0-or-later", "ref"), ("dual-licensed under MIT/Apache-2.0", "MIT OR Apache-2.0", "ref"),
)
NONE = ("The MIT graduates published under stress.", "He was released by the police in 3 days.", "provided by the bsd team", "the water is free and available by the lake", "he likes boost", "a driving licence is required", "# #\n\n", "\n \n" * 50)


def test_known_texts():
    for text, licence, ids in CASES:
        assert [(x[0], x[3]) for x in licenses.scan(text)] == [(licence, ids)], text
        again = f"Some prose before it all.\n\n{text}\n\nSome prose after it."
        ((_, start, end, _),) = licenses.scan(again)
        assert [x[0] for x in licenses.scan(again[start:end])] == [licence]
    for text in NONE:
        assert licenses.scan(text) == [], text


def test_rules_by_brute_force():
    every = []
    for licence, said in licenses.RULES:
        parts = [([p.rstrip("?")], []) if p.endswith("?") else ([p],) for p in said.split()]
        every.append((licence, {tuple(x for c in chosen for x in c) for chosen in product(*parts)}))
    ids = sorted({p.rstrip("?") for _, said in licenses.RULES for p in said.split()} | {"copyright", "reserved"})
    rng = np.random.default_rng(5)
    for _ in range(3000):
        some = rng.choice(ids, 4)
        known = [(str(rng.choice(some)), "N", 10 * k, 10 * k + 5) for k in range(rng.integers(0, 9))]
        if rng.random() < 0.5:
            said = licenses.RULES[rng.integers(len(licenses.RULES))][1].split()
            known = [(p.rstrip("?"), "N", 10 * k, 10 * k + 5) for k, p in enumerate(said) if not p.endswith("?") or rng.random() < 0.7]
        core, want, at = [k for k in known if k[0] not in ("copyright", "reserved")], [], 0
        while at < len(core):
            for licence, forms in every:
                fits = [f for f in forms if tuple(k[0] for k in core[at : at + len(f)]) == f]
                if fits:
                    n = max(map(len, fits))
                    want.append((licence.replace("{name}", "N"), core[at][2], core[at + n - 1][3]))
                    at += n
                    break
            else:
                at += 1
        assert [x[:3] for x in licenses.match_rules(known)] == want, known


def test_tables(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "Released under the MIT License.", "x"), (3, "Released under the MIT License.", "x"), (None, MPL, None), (5, "prose. " * 100_000 + "GPL-2.0-or-later", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, licenses string")
    got = licenses.find_licenses(df)
    assert got.columns == df.columns and [len(r["licenses"]) for r in got.collect()] == [0, 0, 1, 1, 1, 1]
    assert licenses.find_licenses(df.limit(0)).collect() == []


def test_long_adversarial_texts():
    import time

    for unit in ("licensed under ", "permission ", "licensed; you ", "licen\n", "is distributed ", "copyright (c) ", "license; ", "\n \n", "released under the x ", "mit or ", "\n\x0b", "*", " \t", "\n\t*", "/*"):
        began = time.process_time()
        licenses.scan(unit * (1_000_000 // len(unit)) + "license")
        assert time.process_time() - began < 5, unit
