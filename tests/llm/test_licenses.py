import textwrap

import duckdb

from tallow.llm import licenses

GRANT, WARRANTY = "Permission is hereby granted, free of charge, to any person obtaining a copy.", 'The software is provided "as is", without warranty of any kind.'
CASES = [
    (1, f"{GRANT} Other words. {WARRANTY}", ["mit"]),
    (2, f"{WARRANTY} {GRANT}", []),
    (3, "All rights reserved.\nx", ["all-rights-reserved"]),
    (4, None, []),
    (5, "", []),
    (5, "", []),
    (6, "Text. Released under the MIT License.\nLicensed under CC BY-NC 4.0.", ["mit", "cc-by-nc-4.0"]),
    (7, "This work is licensed under the GNU General Public License, version 3.", ["gpl-3.0"]),
    (8, "Licensed under the Apache License, Version 2.0.", ["apache-2.0"]),
    (9, "He licensed under the MIT License nothing at all", []),
    (None, "... !!! é", []),
    (10, "word " * 50_000 + ". All rights reserved!", ["all-rights-reserved"]),
]


def test_rules_follow_the_order_of_sentences(spark):
    docs = spark.createDataFrame([(i, t, "kept") for i, t, _ in CASES], "doc_id long, text string, sentence string")
    got = licenses.scan_licenses(docs)
    assert got.columns[:3] == docs.columns
    assert sorted((str(r.doc_id), r.licenses, r.license) for r in got.collect()) == sorted((str(i), names, names[0] if names else None) for i, _, names in CASES)
    assert licenses.scan_licenses(docs.limit(0)).count() == 0


def test_the_sql_agrees(spark):
    docs = spark.createDataFrame([(i, t) for i, t, _ in CASES], "doc_id long, text string")
    db = duckdb.connect()
    db.register("documents", docs.toArrow())
    want = sorted(str((str(i), n, k, x)) for i, n, k, x, _ in db.sql(licenses.scan_sql()).fetchall())
    got = sorted(str((str(r.doc_id), r.n_sentences, len(r.sentence_ids), r.license)) for r in licenses.scan_licenses(docs).collect())
    assert got == want


MIT = """MIT License

Copyright (c) 2020 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
THIRD = "3. Neither the name of the University of Example nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n"
BSD = """Copyright (c) 2020, Some One

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

{}THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."""
APACHE = """Copyright 2020 Some One

Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
GNU = """This file is part of Example.

This program is free software: you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."""
MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
PUBLISHED = [(MIT, "mit"), (BSD.format(""), "bsd-2-clause"), (BSD.format(THIRD), "bsd-3-clause"), (APACHE, "apache-2.0"), (GNU.format("", "3"), "gpl-3.0-or-later"), (GNU.format("", "2"), "gpl-2.0-or-later"), (GNU.format("Lesser ", "2.1"), "lgpl-2.1-or-later"), (GNU.format("Affero ", "3"), "agpl-3.0-or-later"), (MPL, "mpl-2.0")]
TAGS = [("# SPDX-License-Identifier: MIT\nimport os", ["mit"]), ("/* SPDX-License-Identifier: GPL-2.0-or-later */", ["gpl-2.0-or-later"]), ("// SPDX-License-Identifier: (MIT OR Apache-2.0)\n", ["mit", "apache-2.0"]), ("SPDX-License-Identifier: GPL-2.0-only WITH Linux-syscall-note", ["gpl-2.0"]), ("GNU GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007\n\nText", ["gpl-3.0"]), ("// SPDX-License-Identifier: MIT-0", ["mit-0"]), ("The licence: MIT", [])]
BROKEN = "Permission is hereby granted, free of charge, to any person\n\nobtaining a copy. The software is provided as is, without warranty of any kind."


def test_published_texts_wrapped_and_unwrapped(spark):
    def wrapped(text, width, mark):
        return "\n".join(mark + x for p in text.split("\n") for x in (textwrap.wrap(p, width) or [""]))

    forms = [lambda t: t, *[lambda t, w=w, m=m: wrapped(t, w, m) for w in (20, 72) for m in ("", "# ", " * ")], lambda t: wrapped(t, 60, "").replace("\n", "\r\n")]
    cases = [(f"{k} {j}", form(text), name) for k, (text, name) in enumerate(PUBLISHED) for j, form in enumerate(forms)]
    got = {r.doc_id: r.license for r in licenses.scan_licenses(spark.createDataFrame([c[:2] for c in cases], "doc_id string, text string")).collect()}
    assert got == {i: name for i, _, name in cases}
    tags = [(str(k), t) for k, (t, _) in enumerate([*TAGS, (BROKEN, [])])]
    got = {r.doc_id: r.licenses for r in licenses.scan_licenses(spark.createDataFrame(tags, "doc_id string, text string")).collect()}
    assert got == {str(k): names for k, (_, names) in enumerate([*TAGS, (BROKEN, [])])}


NOTICES = [
    ("This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable.\n\nPermission is granted to anyone to use this software for any purpose,\nincluding commercial applications, and to alter it and redistribute it\nfreely, subject to the following restrictions:", "zlib"),
    ("// Distributed under the Boost Software License, Version 1.0.\n// See the file.", "bsl-1.0"),
    ("/* This program and the accompanying materials are made available under the\n * terms of the Eclipse Public License 2.0 which is available at\n * https://www.eclipse.org/legal/epl-2.0 */", "epl-2.0"),
    ("DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE\n\n 0. You just DO WHAT THE FUCK YOU WANT TO.", "wtfpl"),
    ("The Artistic License 2.0\n\nCopyright (c) 2000", "artistic-2.0"),
    ("This work is licensed under the Creative Commons Attribution-ShareAlike 3.0 Unported License.", "cc-by-sa-3.0"),
    ("This work is licensed under a Creative Commons Attribution 3.0 Unported License.", "cc-by-3.0"),
    ("// Use of this source code is governed by a BSD-style license that can be\n// found in the LICENSE file.", "bsd"),
    ("This source code is licensed under the MIT license found in the\nLICENSE file in the root directory of this source tree.", "mit"),
    ("Dual licensed under the MIT and GPL licenses.", "mit,gpl"),
    ("Licensed under either of Apache License, Version 2.0 or MIT license at your option.", "apache-2.0,mit"),
    ("SPDX-License-Identifier: EPL-2.0", "epl-2.0"),
]


def test_notices_of_further_licenses(spark):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(NOTICES)], "doc_id long, text string")
    got = {r.doc_id: ",".join(r.licenses) for r in licenses.scan_licenses(docs).collect()}
    assert got == {i: names for i, (_, names) in enumerate(NOTICES)}


def test_columns_of_any_name_pass_through(spark):
    docs = spark.createDataFrame([(1, "All rights reserved.", "a", "b", "c", "d"), (None, None, None, None, None, None)], "doc_id long, text string, _license_text string, _license_ids string, _license_names string, license string")
    got = licenses.scan_licenses(docs)
    assert got.columns == ["doc_id", "text", "_license_text", "_license_ids", "_license_names", "sentence_ids", "licenses", "license", "n_sentences"]
    assert [tuple(r)[2:5] for r in got.orderBy("doc_id").collect()] == [(None, None, None), ("a", "b", "c")]
