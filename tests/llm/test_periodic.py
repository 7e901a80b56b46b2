import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tidewire.llm.periodic import numbers, periodic_runs, runs
from tidewire.llm.queries import op13_periodic_runs, table


def plain_runs(w):
    """Every period, every place; the smallest period by trying all smaller ones."""
    n, out = len(w), []
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            stretch = w[i : j + p]
            if j > i and len(stretch) >= max(12, 2 * p) and all(any(stretch[k] != stretch[k + q] for k in range(len(stretch) - q)) for q in range(1, p)):
                out.append((i, len(stretch), p))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = plain_runs(w)
    dropped = {i for s, k, q in found for i in range(s + q, s + k)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (len(found), *best, 1000 * best[1] // best[2] if found else None, sha("".join(f"{s},{k},{q}\n" for s, k, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in dropped)))


def rows(df):
    return [tuple(r[c] for c in ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")) for r in df.orderBy("doc_id").collect()]


def test_runs_against_every_period():
    rng = random.Random(1)
    for _ in range(1500):
        n, kinds = rng.choice([0, 11, 12, 13, 20, 40, 80, 150]), rng.choice([1, 2, 2, 3, 5])
        w = [rng.randrange(kinds) for _ in range(n)]
        for _ in range(rng.randrange(3) if n else 0):
            a, p = rng.randrange(n), rng.randrange(1, max(2, n // 3))
            for i in range(a, rng.randrange(a, n + 1)):
                w[i] = w[a + (i - a) % p]
        assert runs(np.array(w, np.int64)) == plain_runs(w)


def test_long_texts():
    n = 200_000
    assert runs(np.zeros(n, np.int64)) == [(0, n, 1)]
    assert runs(np.arange(n) % 977) == [(0, n, 977)]
    planted = np.random.default_rng(0).integers(0, 1 << 40, n)
    planted[50_000:149_000] = np.resize(planted[50_000:83_000], 99_000)
    assert runs(planted) == [(50_000, 99_000, 33_000)]
    assert runs(np.arange(n)) == []


def test_the_query_against_every_period(spark, sf):
    docs = [r for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    got = {r.doc_id: r for r in op13_periodic_runs(spark, sf).collect()}
    assert len(got) == len(docs)
    short = [r for r in docs if len((r.text or "").split()) <= 1500]
    assert len(short) > 0.9 * len(docs)
    for r in short:
        g = got[r.doc_id]
        assert tuple(g)[1:] == plain_row(r.doc_id, r.text), r.doc_id
    assert sum(g.n_runs > 0 for g in got.values()) >= len(docs) // 20


@pytest.fixture
def folder(spark, tmp_path):
    def put(rows, schema="doc_id long, text string"):
        df = spark.createDataFrame(rows, schema)
        df.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
        return str(tmp_path)

    return put


def test_odd_rows(spark, folder):
    tenth = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0)
    texts = [None, "", " \n\t ", "a", "x " * 11, "x " * 12, " x y  " * 9, "a b " * 30 + "c", ("p q r " * 5 + "zz ") * 4]
    docs = [(i, t) for i, t in enumerate(texts * 2)] + [(tenth, "one two three four five six seven eight nine ten eleven twelve " * 2), (tenth, None), (tenth, " ")]
    docs.sort(key=lambda r: r[0])
    got = sorted(map(tuple, op13_periodic_runs(spark, folder(docs)).collect()), key=str)
    assert got == sorted(((i, *plain_row(i, t)) for i, t in docs), key=str)


def test_no_rows_and_null_ids(spark, folder):
    sf = folder([(None, "a b " * 9), (None, None)])
    got = op13_periodic_runs(spark, sf).collect()
    assert sorted(r.n_runs for r in got) == [0, 1]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert periodic_runs(empty).count() == 0 and "collapsed" in periodic_runs(empty).columns


def test_columns_of_the_caller_pass(spark):
    docs = spark.createDataFrame([(1, "go " * 20, [1, 2], None)], "doc_id long, text string, `a b` array<int>, lang string").withColumns({c: F.lit("clash") for c in ("RUNS", "n_words", "words")})
    row = periodic_runs(docs).first()
    assert row["a b"] == [1, 2] and row["lang"] is None and row["words"] == "clash" and row["n_words"] == 20
    assert [tuple(r) for r in row["runs"]] == [(0, 20, 1)] and row["collapsed"] == "go"


def test_numbers_tell_words_apart():
    assert numbers([b"a", b"b", b"a", b""]).tolist() == [0, 1, 0, 2]
