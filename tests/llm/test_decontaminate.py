import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tidewire.llm.decontaminate import contamination, smith_waterman
from tidewire.llm.queries import op2_seeded_alignment


def plain(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            h[i + 1][j + 1] = max(0, h[i][j] + (2 if x == y else -1), h[i][j + 1] - 1, h[i + 1][j] - 1)
    return max(map(max, h))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(2, 5), max_size=9), st.lists(st.integers(2, 5), max_size=14)), max_size=6))
def test_alignment_equals_plain_dynamic_programme(pairs):
    got, _ = smith_waterman([(np.array(a, np.uint64), np.array(b, np.uint64)) for a, b in pairs])
    assert got.tolist() == [plain(a, b) for a, b in pairs]


def words(text):
    return re.findall(r"[0-9a-zA-Z\x80-\U0010ffff]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def test_whole_table_against_all_alignments(spark, sf):
    """No pair of document and item that aligns is missed, without any seeds; every flagged one aligns."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [(r.item_id, words(r.text)) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = {r.doc_id: r for r in op2_seeded_alignment(spark, sf).collect()}
    code = {}
    arr = lambda w: np.array([code.setdefault(x, len(code) + 2) for x in w], np.uint64)
    short = [r for r in docs.collect() if len(words(r.text)) < 500]
    for r in short:
        score, _ = smith_waterman([(arr(w), arr(words(r.text))) for _, w in items])
        best = max(s / (2 * len(w)) for s, (_, w) in zip(score, items, strict=True))
        assert got[r.doc_id].contaminated == (best >= 0.5), (r.doc_id, best)
    assert any(got[r.doc_id].contaminated for r in short)


def test_edits_copies_and_odd_rows(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
    edited = [w if i % 7 else "changed" for i, w in enumerate(item)]
    docs = [(1, "before " * 50 + " ".join(item).upper() + " after" * 9), (2, " ".join(edited)), (3, " ".join(item[:5]) + " other words follow here"), (4, None), (5, ""), (6, "x " * 30000)]
    docs += [(100 + i, " ".join(item)) for i in range(300)]  # frequent seeds: the rarest stay
    docs = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("clash"))
    bench = spark.createDataFrame([(7, " ".join(item)), (7, " ".join(item)), (8, "tiny one"), (None, "x x x x"), (9, None), (10, "!!")], "item_id long, text string")
    got = {r.doc_id: (r.contaminated, r.item_id) for r in contamination(docs, bench).collect()}
    assert [got[i] for i in range(1, 7)] == [(True, 7), (True, 7), (False, 7), (False, None), (False, None), (False, None)]
    assert all(got[100 + i] == (True, 7) for i in range(300))
    assert contamination(docs, bench.where("false")).where("contaminated").count() == 0
    assert contamination(docs.where("false"), bench).count() == 0


def test_much_copied_edited_and_partial_copies_without_an_intact_one(spark):
    """Seeds that occur in no document take no frequent one's place; one rare stretch does not hide the others."""
    item = [f"word{i}" for i in range(38)]
    edited = [w if i not in (9, 19, 29) else f"changed{i}" for i, w in enumerate(item)]
    part = [f"part{i}" for i in range(40)]
    docs = [(i, f"title{i} " + " ".join(edited)) for i in range(1000)] + [(1000 + i, " ".join(part[:24]) + f" tail{i}") for i in range(1000)]
    docs += [(2000, "long " * 30000 + " ".join(edited) + " end" * 30000), (2001, " ".join(part[30:]) + " only the rare end"), (2002, " ".join(edited[:8]) + " and nothing more")]
    docs += [(3000 + i, f"clean text {i} about other things") for i in range(7000)]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(part))], "item_id long, text string")
    got = {r.doc_id: (r.contaminated, r.item_id) for r in contamination(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert {i for i, (c, _) in got.items() if c} == {*range(2001)}
    assert all(got[i] == (True, 1) for i in range(1000)) and all(got[1000 + i] == (True, 2) for i in range(1000)) and got[2000] == (True, 1)
