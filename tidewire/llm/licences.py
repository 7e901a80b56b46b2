"""Licence scans: TF-IDF cosine to templates, then inheritance from the nearest ancestor directory."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import unused, written

# Notices by which licences are declared, one to a line.
NOTICES = {
    "Apache-2.0": """
Licensed under the Apache License, Version 2.0
Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.""",
    "MIT": """
Released under the MIT License
Licensed under the MIT License""",
    "GPL-3.0": """
This work is licensed under the GNU General Public License, version 3
This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
    "GPL-2.0": """
This program is licensed under the GNU General Public License, version 2
This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.""",
    "LGPL-3.0": """
Licensed under the GNU Lesser General Public License, version 3""",
    "LGPL-2.1": """
Licensed under the GNU Lesser General Public License, version 2.1""",
    "AGPL-3.0": """
Licensed under the GNU Affero General Public License, version 3""",
    "BSD-2-Clause": """
Licensed under the BSD 2-Clause License""",
    "BSD-3-Clause": """
Licensed under the BSD 3-Clause License""",
    "MPL-2.0": """
This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/
Licensed under the Mozilla Public License, version 2.0""",
    "ISC": """
Released under the ISC License""",
    "CC-BY-4.0": """
Licensed under CC BY 4.0
This work is licensed under a Creative Commons Attribution 4.0 International License""",
    "CC-BY-SA-4.0": """
Licensed under CC BY-SA 4.0
This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License""",
    "CC-BY-NC-4.0": """
Licensed under CC BY-NC 4.0
This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License""",
    "CC0-1.0": """
Released under CC0 1.0""",
}
# Whole texts of short licences and the openings of long ones.
TEXTS = {
    "Apache-2.0": """
Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions. "License" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document.
Apache License Version 2.0, January 2004""",
    "MIT": """
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files""",
    "GPL-3.0": """
GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. Preamble The GNU General Public License is a free, copyleft license for software and other kinds of works.
GNU General Public License Version 3, 29 June 2007""",
    "GPL-2.0": """
GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. Preamble The licenses for most software are designed to take away your freedom to share and change it.
GNU General Public License Version 2, June 1991""",
    "LGPL-3.0": """
GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007""",
    "LGPL-2.1": """
GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999""",
    "AGPL-3.0": """
GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007""",
    "BSD-2-Clause": """
Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.""",
    "BSD-3-Clause": """
Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.""",
    "MPL-2.0": """
Mozilla Public License Version 2.0 1. Definitions 1.1. "Contributor" means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software.""",
    "ISC": """
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.""",
    "Zlib": """
This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.""",
    "EPL-2.0": """
Eclipse Public License - v 2.0 THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE""",
    "CC0-1.0": """
CC0 1.0 Universal Public Domain Dedication""",
    "Unlicense": """
This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
This is free and unencumbered software released into the public domain""",
}
#: Cosine from which a passage declares a licence; share of a text's words in such passages that makes it a licence file, and words before a licence's own text that are allowed in one.
THRESHOLD, FILE_SHARE, OPENING = 0.7, 0.5, 40
#: Words of a text that are compared at a time; neighbouring pieces overlap by the longest template.
PIECE = 1 << 15
FILE_NAME = r"(?i)^(un)?licen[sc]es?\b|^copying\b"
_WORD = re.compile(r"[a-z]+|\d+(?:\.\d+)*")
#: A notice that one of these words precedes by at most so many words, or that holds more of them than its template, declares nothing.
NEGATIONS, BEFORE = frozenset(["not", "never", "neither", "nor", "cannot", "isn", "aren", "wasn"]), 3
_ID = r"\(?[A-Za-z0-9][A-Za-z0-9.+-]*\)?"
_TAG = re.compile(rf"SPDX-License-Identifier:[ \t]*({_ID}(?:[ \t]+(?:AND|OR|WITH)[ \t]+{_ID})*)")
HINT_SQL = r"(?i)licen[sc]e|permission|redistribution|public domain|creative commons|\bcc[ 0]|general public|unencumbered"


class Templates:
    """TF-IDF vectors of the templates (words and pairs of words), and the passages of a text that come close to one."""

    def __init__(self, notices: dict[str, list[str]], texts: dict[str, list[str]]) -> None:
        every = [(k, x, own) for own, group in ((False, notices), (True, texts)) for k, v in group.items() for x in v]
        self.names, self.own = [k for k, _, _ in every], [o for _, _, o in every]
        bags = [self.terms(x) for _, x, _ in every]
        self.lengths = [sum(n for t, n in b.items() if " " not in t) for b in bags]
        self.negations = [sum(n for t, n in b.items() if t in NEGATIONS) for b in bags]
        df = Counter(t for b in bags for t in b)
        self.index = {t: k for k, t in enumerate(sorted(df))}
        # The last place is for all terms that no template knows.
        self.idf = np.array([*(math.log((1 + len(bags)) / (1 + df[t])) + 1 for t in sorted(df)), math.log(1 + len(bags)) + 1])
        self.vectors = np.zeros((len(bags), len(self.idf)))
        for k, bag in enumerate(bags):
            for t, n in bag.items():
                self.vectors[k, self.index[t]] = n * self.idf[self.index[t]]
        self.vectors /= np.maximum(1e-12, np.linalg.norm(self.vectors, axis=1, keepdims=True))

    @staticmethod
    def standard() -> Templates:
        """NOTICES, TEXTS and, for each licence, its SPDX tag."""
        lines = lambda group: {k: [x for x in v.split("\n") if x] for k, v in group.items()}
        notices = lines(NOTICES)
        for name in {*NOTICES, *TEXTS}:
            notices[name] = [*notices.get(name, []), f"SPDX-License-Identifier: {name}"]
        return Templates(dict(sorted(notices.items())), lines(TEXTS))

    @staticmethod
    def terms(text: str) -> Counter:
        w = _WORD.findall(text.lower())
        return Counter(w) + Counter(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))

    def cosine(self, k: int, words: list[str]) -> float:
        """Of template k and a passage."""
        bag = Counter(words) + Counter(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))
        at = np.array([self.index.get(t, -1) for t in bag], np.int64)
        v = np.array(list(bag.values())) * self.idf[at]
        return float(self.vectors[k, at] @ v / max(1e-12, np.linalg.norm(v)))

    def passages(self, words: list[str]) -> list[tuple[int, int, int, float]]:
        """(template, first word, word after the last, cosine) of the passages, as long as the template, that reach THRESHOLD; of those of one template that overlap the best is among them.

        Sums over sliding windows bound every window's cosine from above (terms
        that occur twice make the passage's norm greater); the cosine itself is
        computed from the best bound on, until none is left.
        """
        get = self.index.get
        one = np.array([get(w, -1) for w in words], np.int64)
        two = np.array([get(f"{a} {b}", -1) if one[i] >= 0 <= one[i + 1] else -1 for i, (a, b) in enumerate(zip(words, words[1:], strict=False))], np.int64)
        sums = lambda x: np.concatenate([[0.0], np.cumsum(x)])
        norm1, norm2 = sums(self.idf[one] ** 2), sums(self.idf[two] ** 2)
        found = []
        for k, m in enumerate(self.lengths):
            m = min(m, len(words))
            if not m:
                continue
            u = self.vectors[k].copy()
            u[-1] = 0
            dot1, dot2, weight = sums(u[one] * self.idf[one]), sums(u[two] * self.idf[two]), m - 1
            i = np.arange(len(words) - m + 1)
            bound = (dot1[i + m] - dot1[i] + dot2[i + weight] - dot2[i]) / np.sqrt(np.maximum(1e-12, norm1[i + m] - norm1[i] + norm2[i + weight] - norm2[i]))
            free = bound >= THRESHOLD
            while free.any():
                best = int(np.where(free, bound, -1).argmax())
                score = self.cosine(k, words[best : best + m])
                free[best] = False
                if score >= THRESHOLD:
                    found.append((k, best, best + m, round(score, 6)))
                    beside = slice(max(0, best - m + 1), best + m)
                    free[beside] &= bound[beside] > score
        return found

    def best(self, text: str) -> tuple[str | None, float, bool]:
        """The licence that a whole text declares, its cosine, and whether the text is a licence itself."""
        words = _WORD.findall(text.lower())
        longest, covered, top, opening = max(self.lengths), np.zeros(len(words), bool), (0.0, 0, ""), False
        for lo in range(0, max(1, len(words)), PIECE):
            for k, a, b, score in self.passages(words[lo : lo + PIECE + longest]):
                if not self.own[k] and sum(w in NEGATIONS for w in words[max(0, lo + a - BEFORE) : lo + b]) > self.negations[k]:
                    continue
                covered[lo + a : lo + b] = True
                top = max(top, (score, self.lengths[k], self.names[k]))
                opening |= self.own[k] and lo + a <= OPENING
        return (top[2] or None), top[0], bool(top[2]) and (opening or covered.sum() >= FILE_SHARE * len(words))


    def declared(self, text: str) -> tuple[str | None, float, bool]:
        """``best``, but a tag of the text says its licence itself: a whole SPDX expression, of known licences or not."""
        found, tag = self.best(text), _TAG.search(text)
        return (" ".join(tag[1].rstrip(".").split()), 1.0, found[2]) if tag else found


def scan(files: DataFrame, templates: Templates | None = None) -> DataFrame:
    """(path, licence, score, is_file, named) of each row of ``files`` (path, text, any further columns) whose own text declares a licence, or whose name says that it is one.

    Passages as long as a template are compared with it wherever they stand in
    the whole text, across line ends; the greatest cosine counts, of equals the
    longer template; a negated notice does not count; an SPDX tag counts before
    any. is_file: the file is named as licences are, or begins with a licence's
    own text, or half of its words lie in such passages. Null and empty texts
    declare nothing; a file named as a licence has then a null one.
    """
    shared = files.sparkSession.sparkContext.broadcast(templates or Templates.standard())  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [shared.value.declared(text or "") for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([o[k] for o in out], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.bool_())))], names=["path", "licence", "score", "is_file"])

    named = F.coalesce(F.regexp_extract("path", "([^/]*)$", 1).rlike(FILE_NAME), F.lit(False))
    hits = files.select("path", "text").where(F.coalesce(F.col("text").rlike(HINT_SQL), F.lit(False)) | named).mapInArrow(run, "path string, licence string, score double, is_file boolean")
    return hits.withColumn("named", named).where("licence is not null or named").withColumn("is_file", F.col("named") | F.col("is_file"))


def licensed(files: DataFrame, templates: Templates | None = None) -> DataFrame:
    """All columns of ``files`` but text, with licence, score, via and from_path.

    A file has the licence its text declares (via ``own``); else that of the
    nearest directory at or above its own that holds a licence file (via
    ``inherited``; from_path is the first by path); else none (via ``none``). The
    nearest licence file counts whether its text is known or not: if it is not,
    or one of several named ones in the directory is not, the licence is null
    (via ``unknown``). Several known ones that are named as licences are joined
    by OR; among others the first by path counts. Directories are cut at ``/``. Null paths inherit
    nothing; null and empty texts declare nothing; rows of equal path share the
    best declaration; columns of these names are replaced.

    Licence files are few, and only directories are joined: every directory is
    exploded to its ancestors once, whatever number of files it holds.
    """
    files = files.drop("licence", "score", "via", "from_path")
    best = F.max_by(F.struct("licence", "score", "is_file", "named"), F.struct("score", "licence"))
    own = written(scan(files.where("path is not null"), templates).groupBy("path").agg(best.alias("o")).select("path", "o.*"))
    directory = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    first = F.min(F.struct(~F.col("named"), "path", "licence", "score"))
    # A directory holds as many licence files as it names licences.
    held = own.where("is_file").withColumn("at", directory).groupBy("at").agg(first.alias("f"), F.array_sort(F.collect_set(F.when(F.col("named"), F.col("licence")))).alias("all"), F.count_if(F.expr("named and licence is null")).alias("strange"))
    several = F.when(F.col("strange") > 0, None).when(F.size("all") > 1, F.array_join("all", " OR ")).otherwise(F.col("f.licence"))
    declared = written(held.select("at", F.col("f.path").alias("from_path"), several.alias("f_licence"), F.when(F.col("strange") > 0, 0.0).otherwise(F.col("f.score")).alias("f_score")))
    rest = files.drop("text")
    at, mine, above = unused(rest.columns, "_dir", "_own", "_above")
    out = rest.withColumn(at, directory)
    places = written(out.where(f"{at} is not null").select(F.col(at).alias("dir")).distinct())
    parts = F.split("dir", "/")
    up = places.withColumn("depth", F.explode(F.sequence(F.lit(0), F.size(parts)))).withColumn("at", F.array_join(F.slice(parts, 1, F.col("depth")), "/"))
    near = written(up.join(declared, "at").groupBy("dir").agg(F.max_by(F.struct("from_path", "f_licence", "f_score"), "depth").alias("n")))
    out = out.join(own.select("path", F.struct("licence", "score").alias(mine)), "path", "left").join(near.select(F.col("dir").alias(at), F.col("n").alias(above)), at, "left")
    has, over = F.col(mine)["licence"].isNotNull(), F.col(above)
    strange = F.col(mine).isNotNull() | over.isNotNull() & over["f_licence"].isNull()
    via = F.when(has, "own").when(strange, "unknown").when(over.isNotNull(), "inherited").otherwise("none")
    return out.select(
        *[F.col(f"`{c}`") for c in rest.columns],
        F.when(has, F.col(mine)["licence"]).when(~strange, over["f_licence"]).alias("licence"),
        F.when(has, F.col(mine)["score"]).otherwise(F.when(~strange, F.coalesce(over["f_score"], F.lit(0.0))).otherwise(0.0)).alias("score"),
        via.alias("via"),
        F.when(F.col(mine).isNull(), over["from_path"]).alias("from_path"),
    )
