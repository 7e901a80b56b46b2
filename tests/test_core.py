import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tidewire import catalogue
from tidewire.functions import text as T
from tidewire.functions import time as D
from tidewire.functions import vectors as V
from tidewire.operators import classify as K
from tidewire.operators import clustering as C
from tidewire.operators import entities as E
from tidewire.operators import relational as R
from tidewire.operators import store as S
from tidewire.plans.algorithms import checkpointed
from tidewire.plans.annotation import process


def test_every_query_has_a_stable_name_and_sql_for_known_queries():
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries()) and len(catalogue.queries()) > 150


def plain_greedy(similar, least):
    """The sequential algorithm, one row at a time."""
    n, label, k = len(similar), [-1] * len(similar), 0
    for i in sorted(range(n), key=lambda i: (-sum(similar[i]), i)):
        near = [j for j in range(n) if similar[i][j]]
        if label[i] < 0 and len(near) >= least:
            for j in near:
                if label[j] < 0:
                    label[j] = k
            k += 1
    return label


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 14), st.sets(st.tuples(st.integers(0, 13), st.integers(0, 13))), st.integers(2, 4))
def test_greedy_labels(n, pairs, least):
    m = np.eye(n, dtype=bool)
    for i, j in pairs:
        if i < n and j < n:
            m[i, j] = m[j, i] = True
    assert C.greedy_labels(m, least).tolist() == plain_greedy(m.tolist(), least)
    c = C.components_labels(m)
    assert all(c[i] == c[j] for i in range(n) for j in range(n) if m[i, j] and i != j) and all((c[i] == -1) == (m[i].sum() == 1) for i in range(n))


def test_greedy_by_edges_equals_dense(spark):
    rng = np.random.default_rng(1)
    for least in (2, 3):
        n = 30
        m = rng.random((n, n)) < 0.08
        m = m | m.T | np.eye(n, dtype=bool)
        edges = spark.createDataFrame([(int(i), int(j)) for i, j in zip(*np.where(m), strict=True) if i < j], "i long, j long")
        got = {r.id: r.seed for r in C.greedy_by_edges(spark.range(n), edges, least, checkpointed).collect()}
        label = C.greedy_labels(m, least)
        assert all((got[i] is None) == (label[i] < 0) for i in range(n))
        assert all((got[i] == got[j]) == (label[i] == label[j]) for i in range(n) for j in range(n) if label[i] >= 0 and label[j] >= 0)


def test_clusters_of_few_rows(spark):
    one = spark.createDataFrame([(0, 5, [1.0, 0.0])], "block long, id long, vector array<double>")
    (r,) = C.cluster_vectors(one, 0.8).collect()
    assert (r.cluster_label, r.is_centroid, r.distance_to_centroid) == (-1, True, 0.0)
    assert C.cluster_vectors(one.where("false"), 0.8).count() == 0
    same = spark.createDataFrame([(0, i, [1.0, 0.0]) for i in (3, 1, 2)] + [(0, 9, [0.0, 0.0])], one.schema)
    got = {r.id: (r.cluster_label, r.is_centroid) for r in C.cluster_vectors(same, 0.8).collect()}
    assert got == {1: (0, True), 2: (0, False), 3: (0, False), 9: (-1, True)}
    with pytest.raises(ValueError):
        C.create_clusterer("unknown")


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a", 0.9), (2, "b", None)], "id int, m string, c double")
    new = spark.createDataFrame([(1, None, 0.5), (3, "z", 0.1)], old.schema)
    assert sorted(map(tuple, S.upsert(old, new, ["id"], greatest=["c"]).collect())) == [(1, None, 0.9), (2, "b", None), (3, "z", 0.1)]
    assert sorted(r.id for r in S.not_in(old, "id", new, "id").collect()) == [2]
    assert S.not_in(old, "id", new.unionByName(spark.createDataFrame([(None, "x", 1.0)], old.schema)), "id").count() == 0
    assert S.not_in(old.unionByName(spark.createDataFrame([(None, "x", 1.0)], old.schema)), "id", new.where("false"), "id").count() == 3
    assert [r.m for r in S.insert_if_absent(spark.createDataFrame([(7, "late", 2.0), (7, "first", 1.0)], old.schema), old, "id", "c").collect()] == ["first"]
    assert S.delete(old, F.col("c") > 0.5).count() == 1 and S.check_counts(old, old) == 0
    assert sorted(map(tuple, S.update_from(old, spark.createDataFrame([(2, None, 0.4)], old.schema), ["id"]).collect())) == [(1, "a", 0.9), (2, "b", 0.4)]
    assert [r.id for r in S.mark(old, old.where("id = 1").select("id"), old.select("id"), "id", F.lit("now")).collect()] == [2]


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_text_and_time(spark):
    v = lambda c: value(spark, c)
    assert v(T.strip_suffix(F.lit("Acme Holdings Inc."))) == "Acme Holdings" and v(T.has_word(F.lit("an apple a day"), F.lit("APPLE"))) and not v(T.has_word(F.lit("pineapple"), F.lit("apple")))
    assert v(T.cashtag(F.lit("buy $A now"), F.lit("A"))) and not v(T.cashtag(F.lit("buy $AB"), F.lit("A")))
    assert v(T.cleaned(F.lit('<b>New</b> price target, see http://x.y/z now'))).split() == ['New', ',', 'see', 'now']
    assert v(T.shingles(F.lit("Ein Wort"), 3)) == ["ein wort"] and v(T.shingles(F.lit("!"), 3)) == [] and v(T.shingles(F.lit("a b c a b c"), 3)) == ["a b c", "b c a", "c a b"]
    assert v(T.unfenced(F.lit('```json\n{"a": 1}\n```'))) == '{"a": 1}' and v(T.filing_type(F.lit("424B"))) == "4" and v(T.provider(F.lit("S (X)"))) == "S"
    stamp = lambda c: str(v(c.cast("string")))
    assert stamp(D.rfc2822(F.lit("Mon, 02 Jan 2006 15:04:05 GMT"))) == "2006-01-02 15:04:05" and stamp(D.rfc2822_local(F.lit("Mon, 02 Jan 2006 15:04:05 -0500"))) == "2006-01-02 15:04:05"
    assert v(D.rfc2822(F.lit("nonsense"))) is None and v(D.iso8601(F.lit("x"))) is None and stamp(D.compact(F.lit("20240131T123000"))) == "2024-01-31 12:30:00"
    assert v(V.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0 and v(V.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>"))) == 0


def test_mapper(spark):
    firms = spark.createDataFrame([("AAA", "Acme Widgets Inc"), ("ON", "Onward Corp."), ("T", "Tele Co"), ("BRN", None)], "ticker string, name string")
    alias = spark.createDataFrame([("widget king", "AAA", "alias"), ("FizzPop", "BRN", "brand")], "alias string, ticker string, kind string")
    gaz = E.gazetteer(firms, alias)
    rows = spark.createDataFrame([(1, "Acme Widgets soars", "the Widget King"), (2, "moving on with ONward", None), (3, "$T up, $ON too", ""), (4, "fizzpop aaa", "AAA"), (5, None, None), (6, "T ON", "price target AAA")], "id long, title string, summary string")
    got = {(r.article_id, r.ticker): (r.mention_type, r.match_method, r.confidence) for r in E.map_articles(rows, gaz).collect()}
    assert got == {(1, "AAA"): ("both", "name", 1.0), (2, "ON"): ("title", "name", 1.0), (3, "T"): ("title", "ticker", 0.85), (3, "ON"): ("title", "ticker", 0.85), (4, "BRN"): ("title", "brand", 0.8), (4, "AAA"): ("summary", "ticker", 0.9), (6, "AAA"): ("summary", "ticker", 0.9)}
    assert E.ticker_of(alias, " Widget King ").first()[0] == "AAA" and E.aliases_of(alias, "brn").first()[0] == "FizzPop"
    truth = spark.createDataFrame([(1, "S (AAA)"), (2, "S (ON)"), (5, "S (T)"), (6, "plain")], "id long, source string")
    assert tuple(E.validation(truth, E.map_articles(rows, gaz)).first()) == (3, 2, 1, 0.6667, False)


def test_filters_and_rules(spark):
    rows = spark.createDataFrame([(1, "Firm acquires rival", "$3 million"), (2, "Analysts think and consider", ""), (3, "Nothing here", None), (4, "May announce", "5% in March 2024"), (5, None, None), (6, "a a a a a a a a", "")], "id long, title string, summary string")
    got = {r.id: (r.category, r.verb, r.passed) for r in E.verb_filter(rows).collect()}
    assert got[1] == ("keep", "acquire", True) and got[2] == ("kill", "consider", False) and got[3] == got[5] == ("neutral", None, True) and got[4] == ("keep", "announce", True)
    dense = {r.id: (r.total, r.passed) for r in E.entity_density(rows).collect()}
    assert dense[1] == (1, True) and dense[4][0] == 3 and dense[5] == (0, False)
    labels = {r.article_id: r.label for r in K.rule_labels(rows).collect()}
    assert labels[5] == "UNKNOWN" and labels[6] == "SLOP" and labels[2] == "OPINION" and labels[1] == "FACTUAL"
    flags = spark.createDataFrame([("FACTUAL", None, None, True), (None, 1, "x", False)], "classification_label string, cluster_label int, entity_mapped_at string, ready_for_kg boolean")
    assert R.by_flags(flags).count() == 2 and R.by_flags(flags, classified=True, mapped=False).count() == 1


def test_annotation_loses_nothing(spark):
    rows = spark.createDataFrame([(i, f"Firm {i} buys", "$5 million" if i % 2 else None, None if i == 4 else f"2024-01-0{i + 1}") for i in range(5)], "id long, title string, summary string, published_at string").withColumn("published_at", F.to_timestamp("published_at"))
    vec = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(5)], "id long, vector array<double>")
    out = process(rows, vec)
    s = out.stats.first()
    assert s.total_articles == 5 == out.verbs.count() == out.entities.count() and s.not_processed == 1
    assert process(rows.where("false"), vec).stats.first().total_articles == 0


def test_sandbox_and_minhash(spark):
    m = np.eye(5, dtype=bool)
    for i, j in ((0, 1), (1, 2), (2, 3)):
        m[i, j] = m[j, i] = True
    assert C.sandbox_labels(m).tolist() == [0, 0, 0, 0, -1]
    rows = spark.createDataFrame([(1, "a b c d e f g h"), (2, "a b c d e f g h"), (3, "a b c d e f g h i"), (4, "other words stand here now"), (5, ""), (6, None)], "id long, text string")
    pairs = checkpointed(C.minhash_pairs(rows, 0.7, checkpointed))
    assert {(r.i, r.j) for r in pairs.collect()} == {(r.i, r.j) for r in C.exact_jaccard(rows.where("text is not null"), 0.7).collect()} == {(1, 2), (1, 3), (2, 3)}
    assert {r.id: r.label for r in C.first_come_labels(rows, pairs, checkpointed).collect()} == {1: 1, 2: 1, 3: 1, 4: -1, 5: -1, 6: -1}
    chain = spark.createDataFrame([(i, i + 1, 1.0) for i in range(20)], "i long, j long, sim double")
    assert {r.label for r in C.first_come_labels(spark.range(21), chain, checkpointed).collect()} == {0}
