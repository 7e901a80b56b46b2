import math
import random
import textwrap
from collections import Counter

from pyspark.sql import functions as F
from tidewire.llm.licences import FILE_SHARE, OPENING, TEXTS, THRESHOLD, Templates, licensed
from tidewire.llm.queries import op6_licence_inheritance, table


def plain_best(t, text):
    """Every window of every template's length, with dictionaries."""
    import re

    words = re.findall(r"[a-z]+|\d+(?:\.\d+)*", text.lower())
    idf = lambda x: float(t.idf[t.index.get(x, -1)])
    top, covered, opening = (0.0, 0, ""), set(), False
    for k, m in enumerate(t.lengths):
        m = min(m, len(words))
        for i in range(len(words) - m + 1 if m else 0):
            w = words[i : i + m]
            bag = Counter(w) + Counter(f"{a} {b}" for a, b in zip(w, w[1:]))
            dot = sum(n * idf(x) * t.vectors[k, t.index[x]] for x, n in bag.items() if x in t.index)
            score = round(dot / math.sqrt(sum((n * idf(x)) ** 2 for x, n in bag.items())), 6)
            if score >= THRESHOLD:
                top = max(top, (score, t.lengths[k], t.names[k]))
    return top[2] or None, top[0]


def test_best_equals_every_window():
    t, rng = Templates.standard(), random.Random(0)
    pieces = [x for v in TEXTS.values() for x in v.split("\n")[-1:]] + ["Released under the MIT License", "no licence here", "see version 2.0 of it", "SPDX-License-Identifier: ISC", "permission permission permission"]
    for _ in range(12):
        words = " ".join(rng.choice(pieces) for _ in range(3)).split()
        for _ in range(len(words) // 8):
            words[rng.randrange(len(words))] = rng.choice(["xx", "the", "license", "2.0"])
        text = " ".join(words[:90])
        assert t.best(text)[:2] == plain_best(t, text)


def wrapped(text, mark=""):
    return "\n".join(mark + x for x in textwrap.wrap(text, 60))


def test_whole_licences(spark):
    own = {k: v.split("\n")[1] for k, v in TEXTS.items()}
    body = " ".join(f"clause{k} grants each contributor rights" for k in range(400))
    files = [
        ("mit/LICENSE", "The MIT License\n\nCopyright (c) 2020 Somebody Else\n\n" + wrapped(own["MIT"])),
        ("apache/doc/legal.txt", "                 Apache License\n           Version 2.0, January 2004\n        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n\n   1. Definitions.\n\n" + wrapped(body)),
        ("bsd/LICENSE.txt", "Copyright 2019 The Authors. All rights reserved.\n" + wrapped(own["BSD-3-Clause"])),
        ("gpl/COPYING", wrapped(own["GPL-3.0"]) + "\n" + body),
        ("spdx/a.c", "// SPDX-License-Identifier: MIT\nint main(void) { return 0; }\n" + "x = 1;\n" * 50),
        ("head/b.c", "/*\n" + wrapped("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at", " * ") + "\n */\n" + "call(x);\n" * 80),
        ("isc/x", own["ISC"]),
    ]
    under = [(p.rsplit("/", 1)[0] + "/src/deep/f", "nothing") for p, _ in files]
    docs = spark.createDataFrame(files + under, "path string, text string").withColumns({c: F.lit("x") for c in ("f_score", "f_licence", "_dir", "at", "n", "o", "score", "is_file", "_own", "depth", "dir")})
    rows = licensed(docs)
    assert [c for c in rows.columns if c not in ("licence", "score", "via", "from_path")] == [c for c in docs.columns if c not in ("text", "score")]
    got = {r.path: (r.licence, r.via, r.f_score) for r in rows.collect()}
    want = {"mit": "MIT", "apache/doc": "Apache-2.0", "bsd": "BSD-3-Clause", "gpl": "GPL-3.0", "isc": "ISC"}
    for folder, name in want.items():
        assert got[f"{folder}/src/deep/f"] == (name, "inherited", "x"), folder
    assert got["spdx/a.c"][:2] == ("MIT", "own") and got["spdx/src/deep/f"][:2] == (None, "none")
    assert got["head/b.c"][:2] == ("Apache-2.0", "own") and got["head/src/deep/f"][:2] == (None, "none")


def test_whole_query_equals_plain_scan(spark, sf):
    t = Templates.standard()
    docs = {r.doc_id: r for r in table(spark, sf, "documents").collect()}
    path = lambda i: f"{docs[i].source or 'unknown'}/{i // 1000}/{i // 100}/{i}"
    own = {i: plain_best(t, r.text) for i, r in docs.items() if r.text and len(r.text) < 4000 and "icens" in r.text}
    got = {r.doc_id: r for r in op6_licence_inheritance(spark, sf).collect()}
    assert len(got) == len(docs)
    for i, (name, score) in own.items():
        assert (got[i].licence, got[i].via) == (name, "own") and abs(got[i].score - score) < 1e-6 if name else got[i].via != "own"
    files = {path(i): (got[i].licence, i) for i in got if got[i].via == "own" and t.best(docs[i].text)[2]}
    for i, r in got.items():
        if r.via == "own":
            continue
        parts, want = path(i).split("/")[:-1], None
        while want is None:
            here = sorted(p for p in files if p.rsplit("/", 1)[0] == "/".join(parts))
            want = (files[here[0]][0], here[0]) if here else None
            if not parts:
                break
            parts = parts[:-1]
        assert (r.licence, r.from_path) == (want or (None, None))
    assert 0 < FILE_SHARE < 1 and OPENING > 0


def test_the_nearest_licence_file_counts_known_or_not(spark):
    mit = TEXTS["MIT"].split("\n")[1]
    strange = "All rights reserved. Custom license agreement: no use permitted."
    files = [
        ("p/LICENSE", mit), ("p/a.py", "x"), ("p/u/LICENSE", strange), ("p/u/c.py", "x"), ("p/u/v/d.py", None), ("p/u/own.py", "Released under the MIT License"), ("p/e/LICENSE", ""), ("p/e/f", "x"), ("p/n/LICENSE.txt", None), ("p/n/f", "x"),
        ("two/LICENSE-APACHE", "Licensed under the Apache License, Version 2.0"), ("two/LICENSE-MIT", mit), ("two/f", "x"), ("mixed/COPYING", mit), ("mixed/LICENSE", strange), ("mixed/f", "x"), ("z/LICENSE", TEXTS["Zlib"].split("\n")[1]), ("z/f", "x"),
    ]
    got = {r.path: (r.licence, r.via, r.from_path) for r in licensed(spark.createDataFrame(files, "path string, text string")).collect()}
    assert got["p/a.py"] == ("MIT", "inherited", "p/LICENSE") and got["p/u/own.py"] == ("MIT", "own", None)
    assert got["p/u/LICENSE"] == (None, "unknown", None)
    for path, of in {"p/u/c.py": "p/u", "p/u/v/d.py": "p/u", "p/e/f": "p/e", "p/n/f": "p/n", "mixed/f": "mixed"}.items():
        assert got[path][:2] == (None, "unknown") and got[path][2].startswith(of), path
    assert got["two/f"] == ("Apache-2.0 OR MIT", "inherited", "two/LICENSE-APACHE") and got["z/f"] == ("Zlib", "inherited", "z/LICENSE")


def test_negated_notices_and_expressions():
    t = Templates.standard()
    for text in ("This is not licensed under the MIT License", "It isn't released under the MIT License.", "was never Licensed under the MIT License"):
        assert t.declared(text)[0] is None, text
    assert t.declared("We do not mind. All of this work here is Released under the MIT License")[0] == "MIT"
    assert t.declared(TEXTS["MIT"])[0] == "MIT" and t.declared(TEXTS["ISC"])[0] == "ISC"
    for tag in ("Apache-2.0 OR MIT", "GPL-2.0-or-later", "EPL-2.0", "(MIT AND Zlib)", "GPL-3.0-only WITH Classpath-exception-2.0"):
        assert t.declared(f"/* SPDX-License-Identifier: {tag} */\nint x;")[:2] == (tag, 1.0)
    assert t.declared("SPDX-License-Identifier: MIT.")[0] == "MIT"
