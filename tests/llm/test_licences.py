"""Licence texts and headers as their owners publish them."""

from folioforge.llm import licences

BSD = """Copyright (c) 2020, Some Body

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
{0}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION).
"""
NAMES = """
3. Neither the name of {0} nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
GNU = """ * This {0} is free software{1} you can redistribute it and/or modify
 * it under the terms of the GNU {2}General Public License as published by
 * the Free Software Foundation{3} either version {4} of the License, or
 * (at your option) any later version.
 *
 * This {0} is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
 * GNU {2}General Public License for more details.
"""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS.
"""
MPL = """// This Source Code Form is subject to the terms of the Mozilla Public
// License, v. 2.0. If a copy of the MPL was not distributed with this
// file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""
CASES = [
    (BSD.format(""), "BSD-2-Clause"),
    (BSD.format(NAMES.format("the copyright holder")), "BSD-3-Clause"),
    (BSD.format(NAMES.format("Some Company Inc.")), "BSD-3-Clause"),
    (BSD.format("\n3. All advertising materials mentioning features or use of this software must display the following acknowledgement: it.\n" + NAMES.format("the author").replace("3.", "4.")), "BSD-4-Clause"),
    (GNU.format("program", ";", "", ";", "2"), "GPL-2.0-or-later"),
    (GNU.format("program", ":", "", ",", "3"), "GPL-3.0-or-later"),
    (GNU.format("library", ";", "Lesser ", ";", "2.1"), "LGPL-2.1-or-later"),
    (GNU.format("program", ":", "Affero ", ",", "3"), "AGPL-3.0-or-later"),
    ("Licensed under the GNU General Public License version 2.", "GPL-2.0-only"),
    ("This work is licensed under the GNU Lesser General Public License version 3.", "LGPL-3.0-only"),
    (ISC, "ISC"),
    (MPL, "MPL-2.0"),
    ("# SPDX-License-Identifier: MIT\nx", "MIT"),
    ("/* SPDX-License-Identifier: (GPL-2.0 WITH Linux-syscall-note) OR BSD-3-Clause */", "GPL-2.0-only,BSD-3-Clause"),
    ("SPDX-License-Identifier:LGPL-2.1+", "LGPL-2.1-or-later"),
    ("spdx-license-identifier: EUPL-1.2.", "EUPL-1.2"),
    ("Released under the MIT License.\nSPDX-License-Identifier: MIT", "MIT"),
]


def test_published_texts(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "doc_id long, text string")
    got = {r.doc_id: r for r in licences.scan(rows).collect()}
    want = {i: x.split(",") for i, (_, x) in enumerate(CASES)}
    assert {i: got[i].licences.split(",") for i in got} == want
    assert "?" not in got[12].sentences
