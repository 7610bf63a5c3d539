"""Licence recognition by sentences, in DataFrame functions only.

A text falls into sentences, whose lines may be wrapped; known licence sentences are looked up among them, normalised. What is found
gives a path of sentence identifiers, in which ordered rules, the longest first, replace what they match.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Known sentences by identifier. Fixed values.
SENTENCES = {
    "apache-by": "Licensed under the Apache License, Version 2.0.",
    "apache-you": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "apache-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-as-is": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "apache-see": "See the License for the specific language governing permissions and limitations under the License.",
    "mit-released": "Released under the MIT License.",
    "mit-licensed": "Licensed under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-as-is": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "mit-liable": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "gpl-3-work": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-redistribute-3": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-redistribute-2": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl-see": "See the GNU General Public License for more details.",
    "mpl-2-form": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "cc-by-nc-4": "Licensed under CC BY-NC 4.0.",
    "cc-by-4": "Licensed under CC BY 4.0.",
    "cc-by-sa-4": "Licensed under CC BY-SA 4.0.",
    "cc-by-nc-4-long": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc-by-4-long": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc0": "This work is dedicated to the public domain under CC0 1.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "reserved": "All rights reserved.",
}

#: Rules: a licence and the sentences that say so, in their order. Fixed values.
RULES = [
    ("Apache-2.0", ["apache-you", "apache-copy", "apache-as-is", "apache-see"]),
    ("MIT", ["mit-grant", "mit-notice", "mit-as-is", "mit-liable"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("GPL-3.0-or-later", ["gpl-redistribute-3", "gpl-hope", "gpl-see"]),
    ("GPL-2.0-or-later", ["gpl-redistribute-2", "gpl-hope", "gpl-see"]),
    ("Apache-2.0", ["apache-you"]),
    ("Apache-2.0", ["apache-by"]),
    ("MIT", ["mit-grant"]),
    ("MIT", ["mit-released"]),
    ("MIT", ["mit-licensed"]),
    ("ISC", ["isc-grant"]),
    ("GPL-3.0-only", ["gpl-3-work"]),
    ("GPL-3.0-or-later", ["gpl-redistribute-3"]),
    ("GPL-2.0-or-later", ["gpl-redistribute-2"]),
    ("MPL-2.0", ["mpl-2-form"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-4"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-4-long"]),
    ("CC-BY-4.0", ["cc-by-4"]),
    ("CC-BY-4.0", ["cc-by-4-long"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-4"]),
    ("CC0-1.0", ["cc0"]),
    ("Unlicense", ["unlicense"]),
]

#: Ends of a sentence: a line feed, or marks before white space or the end. "Version 2.0" stays whole.
BREAK = r"\n+|[.!?;:]+([ \t\r]+|$)"
#: Every known sentence holds one of these, single words since a line may end between two; a text without any has no licence sentence.
CUES = ("licen", "permi", "redistribut", "warrant", "liab", "copyright", "domain", "reserved", "software", "prior", "obtain")


def normal(sentence: str) -> str:
    """A-Z lower-cased, all but a-z and 0-9 made one space, ends trimmed."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in sentence)
    return " ".join("".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in low).split())


def parts(sentence: str) -> list[str]:
    """A known sentence as the text's own splitting leaves it, without parts of one or two words."""
    return [n for p in re.split(BREAK.replace("(", "(?:"), sentence) if (n := normal(p)).count(" ") > 1]


def known() -> dict[str, str]:
    """Normalised sentence to its code in a path. A sentence that splits into several has several codes."""
    out: dict[str, str] = {}
    for sentence in SENTENCES.values():
        for p in parts(sentence):
            out.setdefault(p, f"<{len(out)}>")
    return out


def rules() -> list[tuple[str, str]]:
    """(licence, path) in the order in which they apply: longer paths first, then as listed."""
    code = known()
    paths = [(name, "".join(code[p] for i in ids for p in parts(SENTENCES[i]))) for name, ids in RULES]
    return sorted(paths, key=lambda r: -r[1].count("<"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def flow(text: Column) -> Column:
    """The text's words by single spaces, with S where a sentence ends and L where a line ends inside one.

    Marks before the first letter or digit of a line (comment marks, bullets, the words rem and dnl) belong to no
    sentence. A line without letters and digits is blank, and ends a sentence unless an address follows.
    Every pattern takes a run of its characters once, so the work is linear.
    """
    low = F.concat(F.lit("\n"), F.translate(text, _UPPER, _LOWER), F.lit("\n"))
    for pattern, mark in (
        (r"\n[^a-z0-9\n]*+(?:(?:rem|dnl)\b[^a-z0-9\n]*+)?", "\n"),
        (r"(?<!\n)\n\n++(?=https?://)", "\n"),
        (r"\n\n++", " S "),
        (r"(?<![.!?;:])[.!?;:]++(?=[ \t\r\n]|$)", " S "),
        (r"\n", " L "),
        (r"[^a-z0-9LS]+", " "),
    ):
        low = F.regexp_replace(low, pattern, mark)
    return low


def wrapped() -> str:
    """Any known sentence, the longest first, from the start of a line or sentence to the end of one; lines may end
    between its words."""
    longest = sorted(known(), key=lambda s: (-s.count(" "), s))
    return "[LS] (" + "|".join(s.replace(" ", " (?:L )?") for s in longest) + ")(?= [LS])"


def sentence_path(text: Column) -> Column:
    """The codes of a text's known sentences, in order; those unknown leave nothing."""
    codes = F.create_map(*(F.lit(x) for pair in known().items() for x in pair))
    found = F.regexp_extract_all(flow(text), F.lit(wrapped()), F.lit(1))
    found = F.array_join(F.transform(found, lambda s: F.try_element_at(codes, F.replace(s, F.lit(" L "), F.lit(" ")))), "")
    low = F.translate(text, _UPPER, _LOWER)
    cue = low.contains(CUES[0])
    for c in CUES[1:]:
        cue = cue | low.contains(c)
    return F.when(cue, found).otherwise("")


def recognise(path: Column) -> Column:
    """(rest, found) after every rule: found counts the matches of each, in the order of rules()."""
    table = F.array(*(F.struct(F.lit(p).alias("path"), F.lit("#").alias("mark")) for _, p in rules()))
    start = F.struct(path.alias("rest"), F.array().cast("array<long>").alias("found"))

    def apply(state: Column, rule: Column) -> Column:
        after = F.replace(state["rest"], rule["path"], F.lit("#"))
        times = (F.length(state["rest"]) - F.length(after)) / (F.length(rule["path"]) - 1)
        return F.struct(after.alias("rest"), F.concat(state["found"], F.array(F.round(times).cast("long"))).alias("found"))

    return F.aggregate(table, start, apply)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_sentences (known ones), n_matches (rules applied), n_left (known sentences in no rule),
    licenses ("name:count,..." by name).

    Whole texts; a sentence may be wrapped over lines, behind comment marks too. Longer rules apply first, so a full notice counts once; sentences that aren't known may stand
    between those of a rule. Null and empty texts have none. One row for each row of docs; only the
    named columns are read, and nothing is shuffled.
    """
    path = F.coalesce(sentence_path(F.col(text_col)), F.lit(""))
    out = docs.select(F.col(id_col).alias("doc_id"), path.alias("path"))
    done = F.when(F.col("path") == "", F.lit(None)).otherwise(recognise(F.col("path")))
    out = out.select("doc_id", F.regexp_count("path", F.lit("<")).cast("long").alias("n_sentences"), done.alias("done"))
    names = sorted({name for name, _ in RULES})
    count = lambda name: sum((F.coalesce(F.get("done.found", F.lit(i)), F.lit(0)) for i, (n, _) in enumerate(rules()) if n == name), F.lit(0))
    tagged = [F.when(count(n) > 0, F.concat(F.lit(f"{n}:"), count(n).cast("string"))) for n in names]
    total = F.coalesce(F.aggregate("done.found", F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long"))
    left = F.coalesce(F.regexp_count("done.rest", F.lit("<")), F.lit(0)).cast("long")
    return out.select("doc_id", "n_sentences", total.alias("n_matches"), left.alias("n_left"), F.concat_ws(",", *tagged).alias("licenses"))


def oracle() -> str:
    """DuckDB SQL that says the same, rule by rule, for sentences that stand on one line each."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    codes = ", ".join(f"({quote(s)}, {quote(c)})" for s, c in known().items())
    steps, last = [], "path_of"
    for i, (_, path) in enumerate(rules()):
        old = "".join(f", m{k}" for k in range(i))
        steps.append(f"r{i} AS (SELECT doc_id, n{old}, (length(p) - length(replace(p, '{path}', '#'))) // {len(path) - 1} AS m{i}, replace(p, '{path}', '#') AS p FROM {last})")
        last = f"r{i}"
    names = sorted({name for name, _ in RULES})
    total = {n: " + ".join(f"m{i}" for i, (name, _) in enumerate(rules()) if name == n) for n in names}
    tags = ", ".join(f"CASE WHEN {total[n]} > 0 THEN '{n}:' || CAST({total[n]} AS VARCHAR) END" for n in names)
    everything = " + ".join(f"m{i}" for i in range(len(rules())))
    return f"""
WITH codes(s, code) AS (VALUES {codes}
), cut AS (SELECT doc_id, unnest(CASE WHEN coalesce(text, '') = '' THEN [''] ELSE regexp_split_to_array(translate(text, '{_UPPER}', '{_LOWER}'), '{BREAK.replace("(", "(?:")}') END) AS s, generate_subscripts(CASE WHEN coalesce(text, '') = '' THEN [''] ELSE regexp_split_to_array(translate(text, '{_UPPER}', '{_LOWER}'), '{BREAK.replace("(", "(?:")}') END, 1) AS i FROM documents
), path_of AS (SELECT doc_id, coalesce(string_agg(code, '' ORDER BY i), '') AS p, count(code) AS n FROM cut LEFT JOIN codes ON codes.s = trim(regexp_replace(cut.s, '[^a-z0-9]+', ' ', 'g')) GROUP BY doc_id
), {", ".join(steps)}
SELECT doc_id, CAST(n AS BIGINT) AS n_sentences, CAST({everything} AS BIGINT) AS n_matches,
  CAST(length(p) - length(replace(p, '<', '')) AS BIGINT) AS n_left, array_to_string(list_filter([{tags}], lambda x: x IS NOT NULL), ',') AS licenses
FROM {last}
"""
