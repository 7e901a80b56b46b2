import random
import re
from collections import Counter, defaultdict

import duckdb
from pyspark.sql import functions as F
from tidewire.llm import divergence as d
from tidewire.llm.queries import op11_source_divergence
from tidewire.llm.sql import ORACLES


def plain(docs, least, k):
    """Every kept term of every group and pair."""
    c, seen, groups = Counter(), defaultdict(set), set()
    for i, (lang, source, text) in enumerate(docs):
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or ""):
            t = "".join(x.lower() if x.isascii() else x for x in t)
            c[lang, source, t] += 1
            seen[lang, t].add(i)
    kept = defaultdict(list)
    for (lang, t), ids in seen.items():
        if len(ids) >= least:
            kept[lang].append(t)
    out = []
    for lang, source in groups:
        terms = kept[lang]
        others = [s for x, s in groups if x == lang]

        def p(s, t):
            of = others if s is None else [s]
            n = sum(c[lang, o, x] for o in of for x in terms)
            return 1 + 10**9 * (sum(c[lang, o, t] for o in of) + 2) // (n + 2 * len(terms))

        f = lambda a, b: (a - b) ** 2 // (a + b)
        own, of_lang = {t: p(source, t) for t in terms}, {t: p(None, t) for t in terms}
        pairs = [(sum(f(own[t], p(o, t)) for t in terms), o) for o in others if o != source]
        over = [(f(own[t], of_lang[t]), t) for t in terms if c[lang, source, t] and own[t] > of_lang[t]]
        for part, rows, most in (("pair", pairs, None), ("term", over, k)):
            for rank, (value, item) in enumerate(sorted(rows, key=lambda r: (-r[0], r[1].encode()))[:most], 1):
                out.append((lang, source, part, item, value, rank))
    return sorted(out)


def made(seed, n=90):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in "abcdÄß語" for b in "efgh"]
    text = lambda: " ".join(rng.choices(words[: rng.choice([3, 10, 28])], k=rng.choice([1, 4, 30]))).replace(" a", rng.choice([" A", "9", "\x00", "_", "\n"]))
    return [(rng.choice(["en", "en", "de", None, ""]), rng.choice(["s1", "s2", "s3", None, "é"]), rng.choice([None, "", "1 2 - _", text(), text(), text()])) for _ in range(n)] + [("xx", "only", "b c")]


def test_against_every_term(spark, monkeypatch):
    for seed, (least, k) in enumerate([(10, 10), (2, 3), (1, 1)]):
        monkeypatch.setattr(d, "HELD_TERMS", 7)  # counts are handed on in parts
        docs = made(seed)
        df = spark.createDataFrame(docs, "lang string, source string, text string").withColumns({c: F.lit("clash") for c in ("n", "term", "value", "held", "rank")})
        assert sorted(map(tuple, d.divergence(df, least, k).collect())) == plain(docs, least, k)


def test_bounds_and_rounds(spark):
    """Many terms of few counts: the first round must not end the search."""
    rng = random.Random(5)
    docs = [("en", rng.choice("ab"), " ".join(f"t{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}" for _ in range(60))) for _ in range(40)]
    df = spark.createDataFrame(docs, "lang string, source string, text string")
    assert sorted(map(tuple, d.divergence(df, 3, 2).collect())) == plain(docs, 3, 2)


def test_ties_beyond_the_kth(spark):
    docs = [("en", "a", " ".join(chr(97 + i) for i in range(26))), ("en", "b", "a"), ("en", "a", "zz zz zz")]
    df = spark.createDataFrame(docs, "lang string, source string, text string")
    got = sorted(map(tuple, d.divergence(df, 1, 4).collect()))
    assert got == plain(docs, 1, 4) and [r[3] for r in got if r[1:3] == ("a", "term")] == ["b", "c", "d", "zz"]


def test_buckets_and_large_counts(spark):
    n = [1, 15, 16, 17, 31, 32, 1000, 10**9, 9 * 10**9, 5 * 10**12, 10**13]
    df = spark.createDataFrame([(x, 2 * 10**13, 10**6) for x in n], "n long, total long, kept long")
    rows = df.select("n", F.expr(d._bucket("n")).alias("b"), F.expr(d.probability("n", "total", "kept")).alias("p")).collect()
    assert [r.p for r in rows] == [1 + 10**9 * (x + 2) // (2 * 10**13 + 2 * 10**6) for x in n]
    assert [r.b for r in rows] == [x if x < 16 else 16 * (x.bit_length() - 1) + ((x >> (x.bit_length() - 5)) & 15) for x in n]


def test_empty_and_termless(spark):
    schema = "lang string, source string, text string"
    assert d.divergence(spark.createDataFrame([], schema)).count() == 0
    docs = [("en", "a", None), ("en", "b", "1 2"), (None, None, "one")]
    got = sorted(map(tuple, d.divergence(spark.createDataFrame(docs, schema)).collect()))
    assert got == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)] == plain(docs, 10, 10)


def test_the_query_equals_its_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = op11_source_divergence(spark, sf)
    want = con.execute(ORACLES["op11_source_divergence"])
    assert [c[0] for c in want.description] == got.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
