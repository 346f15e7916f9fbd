"""Licence scan: known sentences first, then rules over their sequence.

A text is cut into sentences, each is normalised (lower case, letters and digits
only, single spaces) and looked up among the sentences of known licence texts.
The identifiers that are found, in order, are matched against the rules, which
are the identifier sequences of these texts; longer rules go first.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The wording of licences and of common licence notices.
RULES = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Released under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ],
    "GPL-2.0": [
        "Licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ],
    "BSD-2-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": ["Released under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "Proprietary": ["All rights reserved."],
}

#: A sentence ends at one of these marks and white space, or at an empty line.
END = r"([.!?;:])[ \t\r\n]+|\n[ \t\r]*\n"
MARK = "\x1e"
#: Every known sentence matches this.
HINT = "(?i)licen|cc0|permi|warrant|redistribut|liable|rights|software|copyright"


def normal(sentence: str) -> str:
    return re.sub("[^a-z0-9]+", " ", sentence.translate({c: c + 32 for c in range(65, 91)})).strip(" ")


def compiled() -> tuple[dict[str, str], list[tuple[str, list[str]]]]:
    """({normalised sentence: identifier}, [(licence, identifiers)], longest rule first)."""
    known: dict[str, str] = {}
    rules = []
    for licence, texts in RULES.items():
        for text in texts:
            ids = []
            for s in re.sub(END, r"\1" + MARK, text).split(MARK):
                if s := normal(s):
                    ids.append(known.setdefault(s, f"s{len(known) + 1:03d}"))
            rules.append((licence, ids))
    return known, sorted(rules, key=lambda r: (-len(r[1]), r))


def stretches(known: dict[str, str]) -> str:
    """A pattern of the known sentences, longest first, over normalised lines that two line ends part, each broken anywhere between words."""
    longest = sorted(known, key=lambda x: (-len(x), x))
    return "(?:^|\n)(" + "|".join(x.replace(" ", "(?: |\n\n)") for x in longest) + ")(?:\n|$)"


def scan_licences(docs: DataFrame, text: str | Column = "text") -> DataFrame:
    """The rows of ``docs`` with sentence_ids and licences (arrays) in place of the other columns but doc_id.

    sentence_ids: what was recognised, in order. licences: the rules that match,
    one entry for each match, sorted. A sentence that spans lines is looked up
    whole and, where it is not known, as any lines in sequence within it, the
    longest first: wording below a copyright line is found however it is wrapped
    or marked as a comment. Null and empty texts have empty arrays; a sentence
    that repeats counts each time, a row that repeats is scanned each time, and
    long texts are scanned whole, in time that grows with their length.
    """
    known, rules = compiled()
    least = min(map(len, known))
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    none, pattern = F.array().cast("array<string>"), stretches(known)

    def look(s: Column) -> Column:
        return table[F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " "))]

    def lines(s: Column) -> Column:
        flat = F.regexp_replace(F.regexp_replace(F.lower(s), "[^a-z0-9\n]+", " "), " ?\n[ \n]*", "\n\n")
        bare = F.trim(flat, F.lit(" \n"))
        return F.transform(F.regexp_extract_all(bare, F.lit(pattern), F.lit(1)), lambda x: table[F.replace(x, F.lit("\n\n"), F.lit(" "))])

    def ids(s: Column) -> Column:
        whole = look(s)
        found = F.when(whole.isNotNull(), F.array(whole)).when(F.contains(s, F.lit("\n")), lines(s)).otherwise(none)
        return F.when((F.length(s) >= least) & s.rlike(HINT), found).otherwise(none)

    body = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    sentences = F.split(F.regexp_replace(body, END, "$1" + MARK), MARK)
    # every known sentence holds a hint, so that most texts are passed over after one search
    found = docs.select("doc_id", F.when(body.rlike(HINT), F.flatten(F.transform(sentences, ids))).otherwise(none).alias("sentence_ids"))
    return _matched(found, rules)


def _matched(found: DataFrame, rules: list[tuple[str, list[str]]]) -> DataFrame:
    """Rules over the sequence: each takes its identifiers out, so that a shorter rule can't use them again."""
    joined = F.array_join(F.transform("sentence_ids", lambda x: F.concat(F.lit("<"), x, F.lit(">"))), "")
    some = found.withColumn("rest", joined).withColumn("licences", F.array().cast("array<string>"))
    for licence, own in rules:
        key = "".join(f"<{i}>" for i in own)
        times = F.size(F.split("rest", key, -1)) - 1
        some = some.withColumns({"licences": F.concat("licences", F.array_repeat(F.lit(licence), times)), "rest": F.replace("rest", F.lit(key), F.lit("|"))})
    return some.select("doc_id", "sentence_ids", F.array_sort("licences").alias("licences"))
