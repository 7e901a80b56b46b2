import math
from collections import Counter, defaultdict
from zlib import crc32

import pytest
from pyspark.sql import functions as F
from tidewire.llm import perplexity
from tidewire.llm.perplexity import ORDER, UNITS, Model, gram_counts, quality


def units(text):
    raw = "".join(c.lower() if "A" <= c <= "Z" else " " if c in "\t\n\x0b\x0c\r" else c for c in text).encode("utf-16-le")
    return tuple(raw[i] | raw[i + 1] << 8 for i in range(0, len(raw), 2))


def grams(text):
    u = (0,) * (ORDER - 1) + units(text)
    return [u[i : i + ORDER] for i in range(len(u) - ORDER + 1)]


class Plain:
    """The same model with dictionaries."""

    def __init__(self, texts):
        orders = [Counter(g for t in texts for g in grams(t))]
        while len(orders) < ORDER:
            orders.append(Counter(g[1:] for g in orders[-1]))
        self.orders = []
        for c in reversed(orders):
            n = [max(1, sum(v == k for v in c.values())) for k in (1, 2, 3, 4)]
            y = n[0] / (n[0] + 2 * n[1])
            d = [0, *(min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.05), k - 0.05) for k in (1, 2, 3))]
            total, cut = defaultdict(int), defaultdict(float)
            for g, v in c.items():
                total[g[:-1]] += v
                cut[g[:-1]] += d[min(v, 3)]
            self.orders.append((c, d, total, cut))

    def p(self, gram):
        p = 1 / UNITS
        for k, (c, d, total, cut) in enumerate(self.orders, 1):
            g = gram[ORDER - k :]
            if total[g[:-1]]:
                v = c.get(g, 0)
                p = (v - d[min(v, 3)]) / total[g[:-1]] + cut[g[:-1]] / total[g[:-1]] * p
        return p

    def perplexity(self, text):
        return math.exp(-sum(math.log(self.p(g)) for g in grams(text)) / len(grams(text))) if text else None


ODD = [(-1, "Ünïcode ключ 漢字 🙂🙂 \x00 end", "en"), (-2, "", None), (-3, None, "en"), (-4, "zz" * 30000, "xx"), (-5, "A\tb\nC d", None), (None, "no id", "en"), (-5, "A\tb\nC d", None)]


@pytest.mark.parametrize("bounds", [{}, {"MOST_GRAMS": 0, "MOST_IDS": 0, "HELD": 50}, {"MOST_GRAMS": 900, "HELD": 2000}])
def test_perplexities_equal_plain_model(spark, sf, monkeypatch, bounds):
    """Every document's perplexity, whichever grams are broadcast or joined and however counts are cut."""
    for k, v in bounds.items():
        monkeypatch.setattr(perplexity, k, v)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").union(spark.createDataFrame(ODD, "doc_id long, text string, lang string"))
    labels = spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").select("doc_id").union(spark.createDataFrame([(-1,), (None,), (-1,)], "doc_id long"))
    rows = docs.collect()
    known = {r.doc_id for r in labels.collect()} - {None}
    held = {i for i in known if crc32(str(i).encode()) % 5 == 0}
    assert held and known - held
    model = Plain([r.text for r in rows if r.doc_id in known - held and r.text])
    want = Counter((r.doc_id, r.lang, None if not r.text else f"{model.perplexity(r.text):.4f}") for r in rows)
    got = quality(docs.withColumn("low", F.lit(1)).withColumn("gram", F.lit("x")), labels).collect()
    assert Counter((r.doc_id, r.lang, None if r.perplexity is None else f"{r.perplexity:.4f}") for r in got) == want
    for lang in {r.lang for r in rows}:  # few documents: quantiles of 0.005 and 0.995 are the ends
        ends = []
        for ids in (known, held):
            some = [r for r in got if r.doc_id in ids and r.perplexity is not None]
            ends.append(sorted(r.perplexity for r in ([r for r in some if r.lang == lang and lang] or some)))
        assert {(r.low, r.high) for r in got if r.lang == lang} == {(ends[0][0], ends[1][-1])}
    assert all(r.kept == (r.perplexity is not None and r.low <= r.perplexity <= r.high) for r in got)


def test_probabilities_sum_to_one(spark):
    texts = ["abracadabra", "abba baab", "cab"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = Model(gram_counts(docs, docs.select("doc_id")))
    base = (ord("a") << 48) | (ord("b") << 32)
    for third in ("r", "q"):
        asked = spark.range(UNITS).select((F.lit(base | ord(third) << 16) + F.col("id")).alias("gram"))
        assert abs(model.bits(asked).agg(F.sum(F.expr("pow(2, -bits)"))).first()[0] - 1) < 1e-9
