"""License scans by sentence rules, with DataFrame functions only.

Known licence sentences are found in the normalised text, over line breaks too; each text
becomes a string of sentence identifiers, against which ordered rules (first match wins) run.
Everything happens inside the row: no shuffle.
"""

from __future__ import annotations

import re
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallow.llm.common import set_aside

# Identifiers of licence sentences, by normalised text. An identifier is a letter for the licence and a digit for the sentence.
SENTENCES = {
    "all rights reserved": "R0",
    "mit license": "M0",
    "the mit license": "M0",
    "the mit license mit": "M0",
    "licensed under the mit license": "M1",
    "released under the mit license": "M1",
    "this work is licensed under the mit license": "M1",
    "this project is licensed under the mit license": "M1",
    "distributed under the mit license": "M1",
    "permission is hereby granted free of charge to any person obtaining a copy": "M2",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "M3",
    "the software is provided as is without warranty of any kind": "W0",
    "apache license": "A0",
    "licensed under the apache license version 2 0": "A1",
    "released under the apache license version 2 0": "A1",
    "this work is licensed under the apache license version 2 0": "A1",
    "licensed under the apache license version 2 0 the license": "A1",
    "you may not use this file except in compliance with the license": "A2",
    "you may obtain a copy of the license at": "A3",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "B0",
    "redistribution and use in source and binary forms are permitted": "B0",
    "released under the bsd license": "B1",
    "licensed under the bsd license": "B1",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "B2",
    "gnu general public license": "G0",
    "this program is free software": "G1",
    "you can redistribute it under the terms of the gnu general public license": "G2",
    "this work is licensed under the gnu general public license version 3": "G3",
    "licensed under the gnu general public license version 3": "G3",
    "released under the gnu general public license version 3": "G3",
    "licensed under the gnu general public license version 2": "G4",
    "released under the gnu general public license version 2": "G4",
    "licensed under the gnu lesser general public license version 3": "L0",
    "licensed under the gnu affero general public license version 3": "F0",
    "licensed under the mozilla public license version 2 0": "P0",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "P0",
    "licensed under cc by 4 0": "C0",
    "this work is licensed under a creative commons attribution 4 0 license": "C0",
    "this work is licensed under a creative commons attribution 4 0 international license": "C0",
    "licensed under cc by sa 4 0": "C1",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "C1",
    "licensed under cc by nc 4 0": "C2",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "C2",
    "licensed under cc by nd 4 0": "C3",
    "licensed under cc0 1 0": "C4",
    "this is free and unencumbered software released into the public domain": "U0",
}
# Ordered rules, the name of the licence and the sentences that must follow one another (others may stand between). The first match is the licence of the text.
RULES = [
    ("mit", ["M2", "M3", "W0"]),
    ("mit", ["M2", "W0"]),
    ("mit", ["M1"]),
    ("apache-2.0", ["A1", "A2"]),
    ("apache-2.0", ["A1"]),
    ("bsd-3-clause", ["B0", "B2"]),
    ("bsd", ["B0"]),
    ("bsd", ["B1"]),
    ("gpl-3.0", ["G3"]),
    ("gpl-2.0", ["G4"]),
    ("gpl", ["G1", "G2"]),
    ("lgpl-3.0", ["L0"]),
    ("agpl-3.0", ["F0"]),
    ("mpl-2.0", ["P0"]),
    ("cc-by-nc-4.0", ["C2"]),
    ("cc-by-sa-4.0", ["C1"]),
    ("cc-by-nd-4.0", ["C3"]),
    ("cc-by-4.0", ["C0"]),
    ("cc0-1.0", ["C4"]),
    ("unlicense", ["U0"]),
    ("mit-name", ["M0"]),
    ("apache-name", ["A0"]),
    ("gpl-name", ["G0"]),
    ("all-rights-reserved", ["R0"]),
]
_GNU = "you can redistribute it and or modify it under the terms of the gnu {} as published by the free software foundation"
_LATER = (" either version {0} of the license or at your option any later version", " either version {0} or at your option any later version")
_GNU_KINDS = [("general public license", "3", "G5"), ("general public license", "2", "G6"), ("lesser general public license", "3", "L1"), ("lesser general public license", "2 1", "L2"), ("affero general public license", "3", "F1")]
_WARRANTY = "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and {}"
_GRANT = "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so"
# Whole sentences of the published texts and headers, and common variants. A ". " stands for a sentence end inside, {} for a holder's name of 1 to 12 words.
PUBLISHED = {
    f"{_GRANT} subject to the following conditions": "M2",
    _GRANT: "M4",
    "the above copyright notice and this permission notice including the next paragraph shall be included in all copies or substantial portions of the software": "M3",
    _WARRANTY.format("noninfringement"): "W0",
    _WARRANTY.format("non infringement"): "W0",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "W1",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "I0",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "I0",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "B3",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "B4",
    "neither the name of {} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "B2",
    "neither the name of {} nor the names of contributors may be used to endorse or promote products derived from this software without specific prior written permission": "B2",
    "all advertising materials mentioning features or use of this software must display the following acknowledgement": "B5",
    "this software is provided by {} as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "B6",
    "the asf licenses this file to you under the apache license version 2 0 the license": "A1",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "A4",
    "see the license for the specific language governing permissions and limitations under the license": "A5",
    "apache license version 2 0 january 2004": "A6",
    "you can redistribute it and or modify it under the terms of the gnu general public license": "G2",
    _GNU.format("general public license"): "G2",
    _GNU.format("general public license") + ". version 2 of the license": "G4",
    _GNU.format("general public license version 2"): "G4",
    _GNU.format("general public license version 3"): "G3",
    **{_GNU.format(kind) + tail.format(v): i for kind, v, i in _GNU_KINDS for tail in _LATER},
    "gnu general public license version 3 29 june 2007": "G7",
    "gnu general public license version 2 june 1991": "G8",
    "gnu lesser general public license version 3 29 june 2007": "L3",
    "gnu lesser general public license version 2 1 february 1999": "L4",
    "gnu affero general public license version 3 19 november 2007": "F2",
    "this source code form is subject to the terms of the mozilla public license v. 2 0": "P0",
    "mozilla public license version 2 0": "P1",
    "this software is provided as is without any express or implied warranty": "Z0",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "Z1",
    "boost software license version 1 0 august 17th 2003": "E0",
    "distributed under the boost software license version 1 0": "E1",
    "use modification and distribution are subject to the boost software license version 1 0": "E1",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at {}": "D0",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0": "D0",
    "this program and the accompanying materials are made available under the terms of the eclipse public license v2 0 which accompanies this distribution and is available at {}": "D0",
    "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0 which accompanies this distribution and is available at {}": "D1",
    "eclipse public license v 2 0": "D2",
    "do what the fuck you want to public license": "K0",
    "you just do what the fuck you want to": "K1",
    "the artistic license 2 0": "T0",
    "licensed under the artistic license 2 0": "T1",
    "this is free software licensed under the artistic license 2 0": "T1",
    **{
        f"this work is licensed under {article} creative commons attribution{kind} {version} {scope} license": i
        for article in ("a", "the")
        for kind, version, scope, i in (("", "3 0", "unported", "C5"), (" sharealike", "3 0", "unported", "C6"), (" share alike", "3 0", "unported", "C6"), ("", "4 0", "international", "C0"), (" sharealike", "4 0", "international", "C1"))
    },
    **{f"{subject} governed by a {style} license that can be found in the license file": i for subject in ("use of this source code is", "this source code is", "governed") for style, i in (("bsd style", "B7"), ("mit style", "M5"))},
    **{f"this source code is licensed under the {name} license found in the license file in the root directory of this source tree": i for name, i in (("mit", "M1"), ("apache 2 0", "A1"), ("bsd style", "B7"))},
    "licensed under the mit license found in the license file": "M1",
    "dual licensed under the mit and gpl licenses": "X0",
    "dual licensed under the mit or gpl version 2 licenses": "X1",
    "licensed under either of apache license version 2 0 or mit license at your option": "X2",
    **{
        f"this {what} is {how} under the {name}": i
        for what in ("project", "software", "program", "library", "work", "file", "code")
        for how in ("licensed", "released", "distributed")
        for name, i in (("mit license", "M1"), ("apache license version 2 0", "A1"), ("bsd license", "B1"), ("gnu general public license version 3", "G3"), ("gnu general public license version 2", "G4"), ("mozilla public license version 2 0", "P0"))
    },
}
# Names in SPDX tags. Every operand of an expression counts; -only is the plain name of a rule.
SPDX = (
    "mit mit-0 isc apache-2.0 bsd-2-clause bsd-3-clause bsd-4-clause gpl-2.0 gpl-2.0-only gpl-2.0-or-later gpl-3.0 gpl-3.0-only gpl-3.0-or-later lgpl-2.1 lgpl-2.1-only lgpl-2.1-or-later lgpl-3.0 lgpl-3.0-only lgpl-3.0-or-later "
    "agpl-3.0 agpl-3.0-only agpl-3.0-or-later mpl-2.0 cc-by-4.0 cc-by-sa-4.0 cc-by-nc-4.0 cc-by-nd-4.0 cc0-1.0 unlicense epl-1.0 epl-2.0 zlib bsl-1.0 wtfpl artistic-2.0 cc-by-3.0 cc-by-sa-3.0"
).split()
SPDX_IDS = {re.sub("[^0-9a-z]+", " ", name): f"S{k}" for k, name in enumerate(SPDX)}
# Rules of the published texts and tags; they stand before RULES, which have the short forms.
WHOLE_RULES = [
    ("lgpl-3.0", ["L3"]),
    ("lgpl-2.1", ["L4"]),
    ("agpl-3.0", ["F2"]),
    ("gpl-3.0", ["G7"]),
    ("gpl-2.0", ["G8"]),
    ("mpl-2.0", ["P1"]),
    ("apache-2.0", ["A6"]),
    ("mit-0", ["M4", "W0"]),
    ("isc", ["I0"]),
    ("bsd-4-clause", ["B0", "B5", "B2"]),
    ("bsd-3-clause", ["B0", "B2"]),
    ("bsd-2-clause", ["B0", "B3", "B4 B6"]),
    ("gpl-3.0-or-later", ["G5"]),
    ("gpl-2.0-or-later", ["G6"]),
    ("lgpl-3.0-or-later", ["L1"]),
    ("lgpl-2.1-or-later", ["L2"]),
    ("agpl-3.0-or-later", ["F1"]),
    ("zlib", ["Z0", "Z1"]),
    ("bsl-1.0", ["E0"]),
    ("bsl-1.0", ["E1"]),
    ("epl-2.0", ["D2"]),
    ("epl-2.0", ["D0"]),
    ("epl-1.0", ["D1"]),
    ("wtfpl", ["K0", "K1"]),
    ("artistic-2.0", ["T0"]),
    ("artistic-2.0", ["T1"]),
    ("cc-by-sa-3.0", ["C6"]),
    ("cc-by-3.0", ["C5"]),
    ("bsd", ["B7"]),
    ("mit", ["M5"]),
    ("apache-2.0", ["X2"]),
    ("mit", ["X2"]),
    ("mit", ["X0"]),
    ("gpl", ["X0"]),
    ("mit", ["X1"]),
    ("gpl-2.0", ["X1"]),
    *[(name.removesuffix("-only"), [f"S{k}"]) for k, name in enumerate(SPDX)],
]
MARKED_END = r"[.!?]+(?=[\x20\x09-\x0DS]|$)|[:;](?=[\x20\x09-\x0DS])"


SPDX_TAG = "spdx license identifier"


def sentence_pattern(sentence: str) -> str:
    """A known sentence in marked text: its words apart by a blank or one line break."""
    gap, end = "(?: ?S ?| )", " ?S? ?H ?S? ?"
    return end.join(gap.join(f"[0-9a-z]+(?:{gap}[0-9a-z]+){{0,11}}?" if w == "{}" else w for w in part.split()) for part in sentence.split(". "))


def any_sentence(sentences: list[str]) -> str:
    """All known sentences and the SPDX tag as one expression, by their first words; the longest match first."""
    by = defaultdict(list)
    for x in sorted(sentences, key=len, reverse=True):
        first, rest = x.split(None, 1) if " " in x else (x, "")
        by[first].append(sentence_pattern(x)[len(first) :])
    known = "|".join(f"{first}(?:{'|'.join(rest)})" for first, rest in by.items())
    return f"(?<=[HS]|[HS] )(?:{SPDX_TAG}(?: ?H ?| )[0-9a-z][0-9a-z ]*|(?:{known})(?= ?[HS]))"


def scan_licenses(docs: DataFrame, text_col: str = "text", sentences: dict[str, str] = SENTENCES | PUBLISHED, rules: list[tuple[str, list[str]]] = WHOLE_RULES + RULES) -> DataFrame:
    """docs with sentence_ids (array, in text order), licenses (names of all rules that match, in their order), license (the first, else null) and n_sentences.

    Sentences end at a full stop, exclamation or question mark before white space or the end, a colon or semicolon
    before white space, and a line's end. A known sentence may also run over line breaks (marks of comments do not
    count, a blank line ends it). Normalised, sentences are lower-case ASCII letters and digits with single
    blanks; those without any do not count. A null or empty text has no sentences and no license. Repeated
    rows are judged alike, a long text is searched whole, a table without rows gives none. Other columns pass
    through, whatever their names; those named like the four new ones are replaced.
    """
    d, given = set_aside(docs)
    new_names = ("sentence_ids", "licenses", "license", "n_sentences")
    keep = [c for c in docs.columns if c not in new_names]
    literal = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    plain, shaped = {k: i for k, i in sentences.items() if "{}" not in k}, {k: i for k, i in sentences.items() if "{}" in k}
    # In lower-case text H marks the end of a sentence and S that of a line.
    lower = F.translate(F.coalesce(F.col(given[text_col]), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ\n", "abcdefghijklmnopqrstuvwxyzS")
    marked = F.concat(F.lit("H"), F.regexp_replace(F.regexp_replace(lower, MARKED_END, "H"), r"[^0-9a-zHS]+", " "), F.lit("H"))
    flat = lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, "[ S]*H[ S]*", ". "), "[ S]+", " "))
    named = lambda x: F.coalesce(F.try_element_at(literal(plain), x), *[F.when(x.rlike(f"^(?:{sentence_pattern(k)})$"), F.lit(i)) for k, i in shaped.items()])
    operands = lambda x: F.transform(F.split(F.regexp_replace(x, rf"^{SPDX_TAG}\.? ", ""), " (?:or(?! later)|and|with) "), lambda y: F.try_element_at(literal(SPDX_IDS), F.trim(y)))
    found = F.transform(F.regexp_extract_all("_license_text", F.lit(any_sentence(list(sentences))), F.lit(0)), flat)
    ids = F.flatten(F.transform(found, lambda x: F.when(x.startswith(SPDX_TAG), operands(x)).otherwise(F.array(named(x)))))
    row = F.concat(F.lit(" "), F.array_join("_license_ids", " "), F.lit(" "))
    names = F.array(*[F.when(row.rlike("".join(f" {i}(?= ).*" for i in ids)), F.lit(name)) for name, ids in rules])
    out = d.withColumn("_license_text", marked).withColumn("_license_ids", F.filter(ids, lambda x: x.isNotNull()))
    out = out.withColumn("_license_names", F.when(F.size("_license_ids") == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(F.filter(names, lambda x: x.isNotNull()))))
    new = (F.col("_license_ids"), F.col("_license_names"), F.try_element_at("_license_names", F.lit(1)), F.regexp_count("_license_text", F.lit("[0-9a-z][0-9a-z ]*+")).cast("long"))
    return out.select(*[given[c] for c in keep], *[x.alias(f"_new_{i}") for i, x in enumerate(new)]).toDF(*keep, *new_names)


def scan_sql(sentences: dict[str, str] = SENTENCES, rules: list[tuple[str, list[str]]] = RULES, source: str = "documents") -> str:
    """The same scan in DuckDB's SQL: doc_id, n_sentences, n_license_sentences, license and license_names."""
    known = ", ".join(f"('{s}', '{i}')" for s, i in sentences.items())
    ranked = ", ".join(f"({k}, '{name}', '{'.* '.join(f' {i} '.rstrip() for i in ids)} ')" for k, (name, ids) in enumerate(rules))
    return rf"""
WITH known AS (SELECT * FROM (VALUES {known}) t(sentence, id)
), rules AS (SELECT * FROM (VALUES {ranked}) t(k, name, pattern)
), s AS (
  SELECT doc_id, row, i, sentence FROM (
    SELECT doc_id, row, unnest(list_transform(parts, lambda x: trim(regexp_replace(x, '[^0-9a-z]+', ' ', 'g')))) AS sentence, unnest(range(len(parts))) AS i FROM (
      SELECT doc_id, row_number() OVER () AS row, string_split(regexp_replace(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[.!?]+([\x20\x09-\x0D]|$)', chr(10), 'g'), '[:;][\x20\x09-\x0D]', chr(10), 'g'), chr(10)) AS parts FROM {source}))
), d AS (
  SELECT doc_id, row, count(*) FILTER (WHERE sentence <> '')::BIGINT AS n_sentences, count(id)::BIGINT AS n_license_sentences,
    ' ' || coalesce(string_agg(id, '  ' ORDER BY i) FILTER (WHERE id IS NOT NULL), '') || ' ' AS ids FROM s LEFT JOIN known USING (sentence) GROUP BY doc_id, row
), m AS (
  SELECT doc_id, row, name, min(k) AS k FROM d JOIN rules ON regexp_matches(ids, pattern) GROUP BY doc_id, row, name
), v AS (
  SELECT row, arg_min(name, k) AS license, string_agg(name, ',' ORDER BY k) AS license_names FROM m GROUP BY row
)
SELECT doc_id, n_sentences, n_license_sentences, license, coalesce(license_names, '') AS license_names FROM d LEFT JOIN v USING (row)
"""
