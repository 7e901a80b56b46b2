import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from tidewire.llm.queries import op7_string_kernel_toxicity
from tidewire.llm.textkit import texts
from tidewire.llm.toxicity import HELD_OUT, SCALES, Kernel, toxicity, train



def test_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    rows = op7_string_kernel_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id", "left").collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out and r.toxic is not None]
    toxic, clean = [r.predicted for r in held if r.toxic], [r.predicted for r in held if not r.toxic]
    assert sum(toxic) >= 0.72 * len(toxic) and sum(clean) <= 0.02 * len(clean)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, "fine words only here", "a"), (2, "you dolthead wretch", "b"), (3, None, "c"), (4, "", "d"), (None, "dol.thead", "e"), (5, "ok " * 40000 + "dolthead", "f")], "doc_id long, text string, toxicity string")
    assert [r.toxicity for r in toxicity(docs, spark.createDataFrame([], "doc_id long, toxic int")).collect()] == [0.0] * 6
    train = spark.createDataFrame([(100 + i, f"some dolthead number{i} came" if i % 2 else f"some person number{i} came", 0) for i in range(60)], "doc_id long, text string, n int")
    labels = train.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic")).unionByName(spark.createDataFrame([(101, 0), (None, 1)], "doc_id long, toxic int"))
    got = {r.doc_id: r.toxicity for r in toxicity(docs.unionByName(train.selectExpr('doc_id', 'text', "'x' as toxicity")), labels).collect()}
    assert got[1] < 0.5 and got[3] == got[4] < 0.5 and min(got[2], got[None], got[5]) >= 0.5
    assert toxicity(docs.where("false"), labels).count() == 0


def plain_kernel(a, b, scale):
    """The normalised kernel, subsequence by subsequence."""

    def phi(x):
        out = Counter()
        for n in (2, 3) if scale.pairs else (3,):
            for at in combinations(range(len(x)), n):
                if at[-1] - at[0] < scale.span:
                    out[tuple(int(x[i]) for i in at)] += scale.decay ** (at[-1] - at[0])
        return out

    x, y = phi(a), phi(b)
    dot = lambda p, q: sum(v * q[k] for k, v in p.items())
    both = dot(x, x) * dot(y, y)
    return dot(x, y) / both**0.5 if both else 0.0


def test_kernel_equals_plain_kernel():
    rng = np.random.default_rng(0)
    for scale in SCALES:
        size = scale.window + scale.slack
        own = [rng.integers(0, 4, rng.integers(4, size + 1)).astype(np.uint8) for _ in range(12)]
        others = [rng.integers(0, 5, rng.integers(1, size + 1)).astype(np.uint8) for _ in range(40)] + own
        length = np.array([len(x) for x in others])
        near, got = Kernel.of(own, scale).values(np.concatenate(others), np.cumsum(length) - length, length)
        full = np.zeros((len(others), len(own)))
        full[near] = got
        want = np.array([[scale.value(np.array(plain_kernel(x, y, scale))) for y in own] for x in others])
        assert np.abs(full - want).max() < 1e-4


def test_edited_insults(spark):
    """Every word of held-out toxic texts edited in its middle: most stay found, clean ones stay clean."""
    sf = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{sf}/documents.parquet").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").selectExpr("text", "toxic", f"{HELD_OUT} as held").where("text is not null").collect()
    model = train([r.text for r in rows if not r.held], np.array([r.toxic for r in rows if not r.held]) == 1)

    def flagged(found):
        return sum(int((model.scores(data, offsets) >= 0.5).sum()) for _, _, data, offsets in texts(pa.array(found, pa.large_string())))

    bad = [r.text for r in rows if r.held and r.toxic and flagged([r.text])]
    good = [r.text for r in rows if r.held and not r.toxic][:300]
    edits = {"mark": (lambda a, b: a + "*" + b, 1.0), "inserted": (lambda a, b: a + "x" + b, 0.7), "doubled": (lambda a, b: a + a[-1] + b, 0.7), "dropped": (lambda a, b: a[:-1] + b, 0.4)}
    for edit, least in edits.values():
        change = lambda t, edit=edit: re.sub(r"\w{4,}", lambda m: edit(m[0][: len(m[0]) // 2], m[0][len(m[0]) // 2 :]), t)
        assert flagged([change(t) for t in bad]) >= least * len(bad)
        assert flagged([change(t) for t in good]) <= 0.02 * len(good)
