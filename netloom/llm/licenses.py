"""License scan by sentence rules. DataFrame functions only.

Texts are cut into sentences, each sentence is normalised (A-Z lower-cased, everything but
ASCII letters and digits becomes one space) and mapped to the identifier of a known licence
sentence, if it is one. The identifiers of a text, in order, are matched against rules: a rule
is an ordered list of identifiers, found in that order with other known sentences allowed in
between. Cutting is done twice, at sentence ends only (for wrapped notices) and at line ends
as well (for notices after unfinished lines); a rule may match either sequence.

The sentence and rule tables are constants of this module, so what each task holds is fixed.
There is no shuffle: a text is read once and only its result kept.

Defined results: a null text has no sentences, as an empty one. Repeated rows and null ids
each give a row. Texts of any length are scanned whole. An empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Sentences of public licence texts and notices, as written there.
SENTENCES = [
    ("apache-line", "Licensed under the Apache License, Version 2.0"),
    ("apache-notice", 'Licensed under the Apache License, Version 2.0 (the "License")'),
    ("apache-comply", "you may not use this file except in compliance with the License"),
    ("apache-copy", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache-asis", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied'),
    ("apache-see", "See the License for the specific language governing permissions and limitations under the License"),
    ("mit-line", "Released under the MIT License"),
    ("mit-line-2", "This project is licensed under the MIT License"),
    ("mit-line-3", "Licensed under the MIT License"),
    ("mit-grant", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions'),
    ("mit-keep", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("mit-asis", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT'),
    ("bsd-grant", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd-source", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("bsd-binary", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"),
    ("bsd-endorse", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("isc-grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("isc-asis", 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS'),
    ("bsd-acknowledge", "All advertising materials mentioning features or use of this software must display the following acknowledgement"),
    ("bsd-line-2", "Licensed under the BSD 2-Clause License"),
    ("bsd-line-3", "Licensed under the BSD 3-Clause License"),
    ("gpl2-line", "This work is licensed under the GNU General Public License, version 2"),
    ("gpl3-line", "This work is licensed under the GNU General Public License, version 3"),
    ("lgpl21-line", "This work is licensed under the GNU Lesser General Public License, version 2.1"),
    ("lgpl3-line", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("agpl3-line", "This work is licensed under the GNU Affero General Public License, version 3"),
    ("gpl-free", "This program is free software"),
    ("lgpl-free", "This library is free software"),
    ("gpl2-terms", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl3-terms", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("lgpl-terms", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("lgpl3-terms", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("agpl3-terms", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("gpl2-version", "either version 2 of the License, or (at your option) any later version"),
    ("lgpl21-version", "either version 2.1 of the License, or (at your option) any later version"),
    ("gpl3-version", "either version 3 of the License, or (at your option) any later version"),
    ("gpl-hope", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY"),
    ("gpl-title", "GNU GENERAL PUBLIC LICENSE"),
    ("lgpl-title", "GNU LESSER GENERAL PUBLIC LICENSE"),
    ("agpl-title", "GNU AFFERO GENERAL PUBLIC LICENSE"),
    ("gpl2-date", "Version 2, June 1991"),
    ("lgpl21-date", "Version 2.1, February 1999"),
    ("gpl3-date", "Version 3, 29 June 2007"),
    ("agpl3-date", "Version 3, 19 November 2007"),
    ("mpl-terms", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("epl2-terms", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("boost-line", "Distributed under the Boost Software License, Version 1.0"),
    ("zlib-grant", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("zlib-altered", "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software"),
    ("zlib-notice", "This notice may not be removed or altered from any source distribution"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0"),
    ("cc-by-nc-sa", "Licensed under CC BY-NC-SA 4.0"),
    ("cc-by-nc-nd", "Licensed under CC BY-NC-ND 4.0"),
    ("cc-by-long", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa-long", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc-long", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-nd-long", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"),
    ("cc-by-nc-sa-long", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    ("cc-by-nc-nd-long", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("all-rights", "All rights reserved"),
]
# licence, kind, sentences in order
RULES = [
    ("Apache-2.0", "permissive", ["apache-line"]),
    ("Apache-2.0", "permissive", ["apache-notice", "apache-comply", "apache-asis"]),
    ("MIT", "permissive", ["mit-line"]),
    ("MIT", "permissive", ["mit-line-2"]),
    ("MIT", "permissive", ["mit-line-3"]),
    ("MIT", "permissive", ["mit-grant", "mit-keep", "mit-asis"]),
    ("BSD-4-Clause", "permissive", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-acknowledge"]),
    ("BSD-3-Clause", "permissive", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-3-Clause", "permissive", ["bsd-line-3"]),
    ("BSD-2-Clause", "permissive", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("BSD-2-Clause", "permissive", ["bsd-line-2"]),
    ("ISC", "permissive", ["isc-grant", "isc-asis"]),
    ("GPL-3.0", "copyleft", ["gpl3-line"]),
    ("GPL-3.0", "copyleft", ["gpl-free", "gpl2-terms", "gpl3-version"]),
    ("GPL-3.0", "copyleft", ["gpl-free", "gpl3-terms"]),
    ("GPL-3.0", "copyleft", ["gpl-title", "gpl3-date"]),
    ("GPL-2.0", "copyleft", ["gpl2-line"]),
    ("GPL-2.0", "copyleft", ["gpl-free", "gpl2-terms", "gpl2-version"]),
    ("GPL-2.0", "copyleft", ["gpl-title", "gpl2-date"]),
    ("LGPL-2.1", "copyleft", ["lgpl21-line"]),
    ("LGPL-2.1", "copyleft", ["lgpl-free", "lgpl-terms", "lgpl21-version"]),
    ("LGPL-2.1", "copyleft", ["lgpl-title", "lgpl21-date"]),
    ("LGPL-3.0", "copyleft", ["lgpl3-line"]),
    ("LGPL-3.0", "copyleft", ["lgpl3-terms"]),
    ("LGPL-3.0", "copyleft", ["lgpl-title", "gpl3-date"]),
    ("AGPL-3.0", "copyleft", ["agpl3-line"]),
    ("AGPL-3.0", "copyleft", ["gpl-free", "agpl3-terms"]),
    ("AGPL-3.0", "copyleft", ["agpl-title", "agpl3-date"]),
    ("MPL-2.0", "copyleft", ["mpl-terms"]),
    ("EPL-2.0", "copyleft", ["epl2-terms"]),
    ("BSL-1.0", "permissive", ["boost-line"]),
    ("Zlib", "permissive", ["zlib-grant", "zlib-altered", "zlib-notice"]),
    ("Unlicense", "permissive", ["unlicense"]),
    ("CC0-1.0", "permissive", ["cc0"]),
    ("CC-BY-4.0", "permissive", ["cc-by"]),
    ("CC-BY-4.0", "permissive", ["cc-by-long"]),
    ("CC-BY-SA-4.0", "copyleft", ["cc-by-sa"]),
    ("CC-BY-SA-4.0", "copyleft", ["cc-by-sa-long"]),
    ("CC-BY-NC-4.0", "noncommercial", ["cc-by-nc"]),
    ("CC-BY-NC-4.0", "noncommercial", ["cc-by-nc-long"]),
    ("CC-BY-ND-4.0", "noderivatives", ["cc-by-nd"]),
    ("CC-BY-ND-4.0", "noderivatives", ["cc-by-nd-long"]),
    ("CC-BY-NC-SA-4.0", "noncommercial", ["cc-by-nc-sa"]),
    ("CC-BY-NC-SA-4.0", "noncommercial", ["cc-by-nc-sa-long"]),
    ("CC-BY-NC-ND-4.0", "noncommercial", ["cc-by-nc-nd"]),
    ("CC-BY-NC-ND-4.0", "noncommercial", ["cc-by-nc-nd-long"]),
]
# SPDX identifiers, and the licence and kind that each stands for.
SPDX = [
    ("MIT", "MIT", "permissive"),
    ("Apache-2.0", "Apache-2.0", "permissive"),
    ("BSD-2-Clause", "BSD-2-Clause", "permissive"),
    ("BSD-3-Clause", "BSD-3-Clause", "permissive"),
    ("ISC", "ISC", "permissive"),
    ("BSL-1.0", "BSL-1.0", "permissive"),
    ("Zlib", "Zlib", "permissive"),
    ("Unlicense", "Unlicense", "permissive"),
    ("CC0-1.0", "CC0-1.0", "permissive"),
    ("CC-BY-4.0", "CC-BY-4.0", "permissive"),
    ("CC-BY-SA-4.0", "CC-BY-SA-4.0", "copyleft"),
    ("MPL-2.0", "MPL-2.0", "copyleft"),
    ("EPL-2.0", "EPL-2.0", "copyleft"),
    ("GPL-2.0-only", "GPL-2.0", "copyleft"),
    ("GPL-2.0-or-later", "GPL-2.0", "copyleft"),
    ("GPL-3.0-only", "GPL-3.0", "copyleft"),
    ("GPL-3.0-or-later", "GPL-3.0", "copyleft"),
    ("LGPL-2.1-only", "LGPL-2.1", "copyleft"),
    ("LGPL-2.1-or-later", "LGPL-2.1", "copyleft"),
    ("LGPL-3.0-only", "LGPL-3.0", "copyleft"),
    ("LGPL-3.0-or-later", "LGPL-3.0", "copyleft"),
    ("AGPL-3.0-only", "AGPL-3.0", "copyleft"),
    ("AGPL-3.0-or-later", "AGPL-3.0", "copyleft"),
]
SENTENCES += [("spdx-" + tag.lower(), "SPDX-License-Identifier: " + tag) for tag, _, _ in SPDX]
RULES += [(lic, kind, ["spdx-" + tag.lower()]) for tag, lic, kind in SPDX]
# of several kinds found, the first in this order is the verdict
KINDS = ["noncommercial", "noderivatives", "copyleft", "permissive"]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SENTENCE_END = r"[.!?;:]+[ \t\r\n\f\x0B]+"
LINE_END = r"[.!?;:]+[ \t\r\n\f\x0B]+|[\r\n]+"
NOT_WORD = r"[^a-z0-9\x01]+"


def normalised(sentence: str) -> str:
    import re

    return " ".join(re.sub("[^a-z0-9]+", " ", re.sub("[A-Z]", lambda m: m[0].lower(), sentence)).split())


def _pieces() -> tuple[dict[str, str], list[tuple[str, str, list[str]]]]:
    """Identifiers of the distinct normalised sentences (the name of the first entry that holds
    one; with a number, if an entry holds several), and rules over identifiers."""
    import re

    known: dict[str, str] = {}
    of = {}
    for name, text in SENTENCES:
        parts = [normalised(p) for p in re.split(SENTENCE_END, text)]
        for i, p in enumerate(parts):
            known.setdefault(p, name if len(parts) == 1 else f"{name}.{i + 1}")
        of[name] = [known[p] for p in parts]
    return known, [(lic, kind, [i for s in names for i in of[s]]) for lic, kind, names in RULES]


def rule_pattern(ids: list[str]) -> str:
    """Over ',a,b,c,': the identifiers in order, others in between allowed."""
    return "," + ",(?:[a-z0-9.-]+,)*".join(i.replace(".", "[.]") for i in ids) + ","


def beginnings(known: dict[str, str]) -> str:
    """A pattern for raw sentences that begin with the first two words of a known one: all
    that can be known, so only these are normalised and looked up."""
    first = sorted({"[^A-Za-z0-9]+".join(k.split()[:2]) for k in known})
    return "(?i)^[^A-Za-z0-9]*(?:" + "|".join(first) + ")(?![A-Za-z0-9])"


def _identifiers(parts: Column, known: dict[str, str]) -> Column:
    """Identifiers of the known sentences among raw ones, in order."""
    near = F.filter(parts, lambda s: F.rlike(s, F.lit(beginnings(known))))
    clean = F.transform(near, lambda s: F.trim(F.regexp_replace(F.translate(s, UPPER, LOWER), NOT_WORD, " ")))
    table, names = F.array(*map(F.lit, known)), F.array(*map(F.lit, known.values()))
    return F.transform(F.filter(F.transform(clean, lambda s: F.array_position(table, s)), lambda i: i > 0), lambda i: F.element_at(names, i.cast("int")))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_sentences int, sentence_ids string, licenses string, verdict string``."""
    known, rules = _pieces()
    # \x01 is a sentence end too; line ends that follow another end belong to it, so cutting sentences at lines is cutting at both
    d = docs.select(F.col(id_col).alias("doc_id"), F.split(F.coalesce(F.col(text_col), F.lit("")), SENTENCE_END + "|\x01").alias("parts"))
    n = F.size(F.filter("parts", lambda s: F.rlike(s, F.lit("[A-Za-z0-9]"))))
    wrapped = _identifiers(F.col("parts"), known)
    lines = _identifiers(F.flatten(F.transform("parts", lambda s: F.split(s, r"[\r\n]+"))), known)
    joined = lambda ids: F.concat(F.lit(","), F.concat_ws(",", ids), F.lit(","))
    d = d.select("doc_id", n.alias("n_sentences"), joined(wrapped).alias("w"), joined(lines).alias("l"))
    hit = F.array(*[F.when(F.col("w").rlike(p) | F.col("l").rlike(p), F.struct(F.lit(lic).alias("license"), F.lit(kind).alias("kind"))) for lic, kind, ids in rules for p in [rule_pattern(ids)]])
    d = d.withColumn("hits", F.when((F.col("w") != ",,") | (F.col("l") != ",,"), F.array_sort(F.array_distinct(F.array_compact(hit)))).otherwise(F.array().cast("array<struct<license: string, kind: string>>")))
    kinds = F.transform("hits", lambda h: h.kind)
    verdict = F.coalesce(*[F.when(F.array_contains(kinds, k), F.lit(k)) for k in KINDS], F.lit("none"))
    return d.select("doc_id", "n_sentences", F.trim(F.col("l"), F.lit(",")).alias("sentence_ids"), F.array_join(F.transform("hits", lambda h: h.license), ",").alias("licenses"), verdict.alias("verdict"))


def oracle() -> str:
    known, rules = _pieces()
    q = lambda s: "'" + s.replace("'", "''") + "'"
    clean = lambda cut: f"regexp_replace(translate(regexp_replace(coalesce(text, ''), {q(cut)}, chr(1), 'g'), '{UPPER}', '{LOWER}'), {q(NOT_WORD)}, ' ', 'g')"
    parts = lambda cut: f"list_filter(list_transform(string_split({clean(cut)}, chr(1)), lambda s: trim(s)), lambda s: s <> '')"
    table, ids_of = ("[" + ", ".join(map(q, x)) + "]" for x in (known, known.values()))
    ids = lambda p: f"',' || array_to_string(list_transform(list_filter(list_transform({p}, lambda s: list_position({table}, s)), lambda i: i IS NOT NULL AND i > 0), lambda i: {ids_of}[i]), ',') || ','"
    hits = ", ".join(f"CASE WHEN regexp_matches(w, {q(p)}) OR regexp_matches(l, {q(p)}) THEN {q(lic)} END" for lic, _, i in rules for p in [rule_pattern(i)])
    names = {k: sorted({lic for lic, kind, _ in rules if kind == k}) for k in KINDS}
    verdict = " ".join(f"WHEN list_has_any(hits, [{', '.join(map(q, names[k]))}]) THEN '{k}'" for k in KINDS if names[k])
    return f"""
WITH a AS (SELECT doc_id, {parts(SENTENCE_END)} AS s, {parts(LINE_END)} AS t FROM documents),
b AS (SELECT doc_id, len(s)::INTEGER AS n_sentences, {ids('s')} AS w, {ids('t')} AS l FROM a),
c AS (SELECT *, list_sort(list_distinct(list_filter([{hits}], lambda x: x IS NOT NULL))) AS hits FROM b)
SELECT doc_id, n_sentences, trim(l, ',') AS sentence_ids, array_to_string(hits, ',') AS licenses,
       CASE {verdict} ELSE 'none' END AS verdict FROM c"""
