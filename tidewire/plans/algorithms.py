"""The dataflow operators as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import classify as K
from ..operators import clustering as C
from ..operators import entities as E
from ..operators.clustering import checkpointed
from .fixtures import articles, table, text_articles
from .registry import query

Spark = SparkSession
_SIM = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"

_GREEDY = f"""WITH RECURSIVE s AS (SELECT a.vec_id AS i, b.vec_id AS j FROM embeddings a, embeddings b WHERE a.vec_id = b.vec_id OR {_SIM} >= 0.3),
d AS (SELECT i, count(*) AS d FROM s GROUP BY i),
p AS (SELECT i, d, row_number() OVER (ORDER BY d DESC, i) AS p FROM d),
e AS (SELECT pi.p, coalesce(list(pj.p) FILTER (WHERE pj.p < pi.p), []::BIGINT[]) AS earlier FROM s JOIN p pi ON s.i = pi.i JOIN p pj ON s.j = pj.i GROUP BY pi.p),
r AS (SELECT 0::BIGINT AS p, []::BIGINT[] AS seeds UNION ALL
  SELECT r.p + 1, CASE WHEN pp.d >= 2 AND NOT list_has_any(r.seeds, e.earlier) THEN list_append(r.seeds, r.p + 1) ELSE r.seeds END FROM r JOIN p pp ON pp.p = r.p + 1 JOIN e ON e.p = r.p + 1),
f AS (SELECT seeds FROM r ORDER BY p DESC LIMIT 1),
m AS (SELECT s.i, min(pj.p) FILTER (WHERE list_contains(f.seeds, pj.p)) AS seed FROM s JOIN p pj ON s.j = pj.i, f GROUP BY s.i)"""


def vectors(s: Spark, d: str) -> DataFrame:
    return table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.lit(0).cast("long").alias("block"))


@query("alg_01_greedy_clusters", _GREEDY + " SELECT i AS id, CASE WHEN seed IS NULL THEN -1 ELSE dense_rank() OVER (ORDER BY seed NULLS LAST) - 1 END AS cluster_label FROM m", None)
def alg_01(s: Spark, d: str) -> DataFrame:
    return C.cluster_vectors(vectors(s, d), 0.3).select("id", F.col("cluster_label").cast("long").alias("cluster_label"))


@query("alg_01_greedy_by_edges", _GREEDY + " SELECT m.i AS id, p.i AS seed FROM m LEFT JOIN p ON p.p = m.seed", None)
def alg_01_edges(s: Spark, d: str) -> DataFrame:
    """Edges are found anew in each round and never kept."""
    return C.greedy_by_rounds(vectors(s, d), 0.3, 2, checkpointed).select("id", "seed")


@query("alg_02_assignments", _GREEDY + """, size AS (SELECT seed, count(*) AS n FROM m GROUP BY seed)
    SELECT m.i AS id, CASE WHEN m.seed IS NULL THEN 1 ELSE n END AS cluster_size FROM m LEFT JOIN size ON size.seed = m.seed""", None)  # fmt: skip
def alg_02(s: Spark, d: str) -> DataFrame:
    return C.create_clusterer("embedding", threshold=0.3)(vectors(s, d)).select("id", "cluster_size")


@query(
    "alg_03_dbscan_components",
    f"""WITH RECURSIVE e AS (SELECT a.vec_id AS i, b.vec_id AS j FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id AND {_SIM} >= 0.35),
    r AS (SELECT vec_id AS i, vec_id AS j FROM embeddings UNION SELECT r.i, e.j FROM r JOIN e ON e.i = r.j),
    c AS (SELECT i, min(j) AS root, count(*) AS n FROM r GROUP BY i)
    SELECT i AS id, CASE WHEN n = 1 THEN -1 ELSE dense_rank() OVER (ORDER BY CASE WHEN n > 1 THEN root END NULLS LAST) - 1 END AS cluster_label FROM c""",
    None,
)
def alg_03(s: Spark, d: str) -> DataFrame:
    return C.create_clusterer("dbscan", threshold=0.35)(vectors(s, d)).select("id", F.col("cluster_label").cast("long").alias("cluster_label"))


@query(
    "alg_03_tfidf",
    r"""WITH w AS (SELECT item_id AS id, list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda x: length(x) >= 2 AND NOT list_contains(string_split('{stop}', ' '), x)) AS w FROM benchmark),
    t AS (SELECT id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM w),
    tf AS (SELECT id, term, count(*) AS tf FROM t GROUP BY ALL), v AS (SELECT term, sum(tf) AS cf, count(*) AS df FROM tf GROUP BY term ORDER BY cf DESC, term LIMIT 500),
    x AS (SELECT id, term, tf * (ln((1 + (SELECT count(*) FROM benchmark)) / (1 + df)::DOUBLE) + 1) AS x FROM tf JOIN v USING (term)), n AS (SELECT id, sqrt(sum(x * x)) AS n FROM x GROUP BY id)
    SELECT id, term, round(x / n, 6) AS weight FROM x JOIN n USING (id)""".replace("{stop}", " ".join(C.STOP_WORDS)),
    None,
)
def alg_03_tfidf(s: Spark, d: str) -> DataFrame:
    rows = table(s, d, "benchmark").select(F.col("item_id").alias("id"), "text")
    return C.tfidf(rows, 500).select("id", "term", F.round("weight", 6).alias("weight"))


@query(
    "alg_05_exact_jaccard",
    r"""WITH w AS (SELECT id, regexp_extract_all(lower(title), '[\p{L}\p{N}_]+') AS w FROM text_articles),
    g AS (SELECT DISTINCT id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) <= 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM w),
    n AS (SELECT id, count(*) AS n FROM g GROUP BY id), m AS (SELECT a.id AS i, b.id AS j, count(*) AS m FROM g a JOIN g b ON a.g = b.g AND a.id < b.id GROUP BY ALL)
    SELECT i, j, round(m / (x.n + y.n - m)::DOUBLE, 6) AS sim FROM m JOIN n x ON x.id = i JOIN n y ON y.id = j WHERE m / (x.n + y.n - m)::DOUBLE >= 0.7""",
    "text",
)
def alg_05(s: Spark, d: str) -> DataFrame:
    rows = text_articles(s, d).select("id", F.col("title").alias("text"))
    return C.exact_jaccard(rows, 0.7).select("i", "j", F.round("sim", 6).alias("sim"))


@query("alg_09_nearest_centroid", f"SELECT a.vec_id AS id, arg_min(b.vec_id, (-round({_SIM}, 12), b.vec_id)) AS centroid_id, round(max({_SIM}), 6) AS sim FROM embeddings a JOIN embeddings b ON a.label = b.label WHERE a.vec_id % 3 = 0 AND b.vec_id % 3 = 1 GROUP BY a.vec_id HAVING max({_SIM}) >= 0.2", None)
def alg_09(s: Spark, d: str) -> DataFrame:
    v = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("label").cast("long").alias("block"))
    return C.match_centroids(v.where("id % 3 = 0"), v.where("id % 3 = 1"), 0.2).select("id", "centroid_id", F.round("sim", 6).alias("sim"))


@query(
    "alg_03_tfidf_clusters",
    r"""WITH RECURSIVE w AS (SELECT item_id AS id, list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda x: length(x) >= 2 AND NOT list_contains(string_split('{stop}', ' '), x)) AS w FROM benchmark),
    t AS (SELECT id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM w),
    tf AS (SELECT id, term, count(*) AS tf FROM t GROUP BY ALL), v AS (SELECT term, sum(tf) AS cf, count(*) AS df FROM tf GROUP BY term ORDER BY cf DESC, term LIMIT 200),
    x AS (SELECT id, term, tf * (ln((1 + (SELECT count(*) FROM benchmark)) / (1 + df)::DOUBLE) + 1) AS x FROM tf JOIN v USING (term)), n AS (SELECT id, sqrt(sum(x * x)) AS n FROM x GROUP BY id),
    u AS (SELECT id, term, x / n AS u FROM x JOIN n USING (id)), e AS (SELECT a.id AS i, b.id AS j FROM u a JOIN u b ON a.term = b.term AND a.id <> b.id GROUP BY ALL HAVING sum(a.u * b.u) >= 0.5),
    r AS (SELECT item_id AS i, item_id AS j FROM benchmark UNION SELECT r.i, e.j FROM r JOIN e ON e.i = r.j)
    SELECT i AS id, CASE WHEN count(*) > 1 THEN min(j) END AS seed FROM r GROUP BY i""".replace("{stop}", " ".join(C.STOP_WORDS)),
    None,
)
def alg_03_clusters(s: Spark, d: str) -> DataFrame:
    return C.cluster_texts(table(s, d, "benchmark").select(F.col("item_id").alias("id"), "text"), 0.5, 200)


@query(
    "alg_08_incremental",
    f"""WITH RECURSIVE v AS (SELECT vec_id AS id, embedding, ts FROM embeddings JOIN events ON event_id = vec_id),
    p AS (SELECT a.id, b.id AS c, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 12) AS sim FROM v a JOIN v b ON a.id % 3 = 0 AND b.id % 3 = 1 AND b.ts >= date_trunc('day', a.ts) AND b.ts < date_trunc('day', a.ts) + INTERVAL 48 HOUR),
    matched AS (SELECT id, arg_min(c, (-sim, c)) AS c FROM p GROUP BY id HAVING max(sim) >= 0.3),
    rest AS (SELECT * FROM v WHERE id % 3 = 0 AND id NOT IN (SELECT id FROM matched)),
    e AS (SELECT a.id AS i, b.id AS j FROM rest a JOIN rest b ON date_trunc('day', a.ts) = date_trunc('day', b.ts) AND a.id <> b.id AND {_SIM} >= 0.3),
    deg AS (SELECT i, count(*) + 1 AS n FROM e GROUP BY i)
    SELECT id, c AS centroid_id, NULL::BIGINT AS degree FROM matched UNION ALL SELECT id, NULL, coalesce(n, 1) FROM rest LEFT JOIN deg ON deg.i = id""",
    None,
)
def alg_08(s: Spark, d: str) -> DataFrame:
    """New rows join centroids of [day, day + 48 h); of the others the number of neighbours of their day, themselves included."""
    v = table(s, d, "embeddings").join(table(s, d, "events"), F.col("vec_id") == F.col("event_id")).select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("ts").alias("at"))
    new, centroids = C.day_candidates(v.where("id % 3 = 0"), v.where("id % 3 = 1"))
    matched = checkpointed(C.match_centroids(new, centroids, 0.3))
    rest = new.join(matched, "id", "left_anti")
    pairs = C.similar_pairs(rest, 0.3)
    degree = pairs.select("i").unionByName(pairs.select(F.col("j").alias("i"))).groupBy(F.col("i").alias("id")).agg((F.count("*") + 1).alias("degree"))
    others = rest.select("id", F.lit(None).cast("long").alias("centroid_id")).join(degree, "id", "left").fillna(1, ["degree"])
    return matched.select("id", "centroid_id", F.lit(None).cast("long").alias("degree")).unionByName(others)


@query(
    "alg_08_clusters",
    f"""WITH v AS (SELECT vec_id, embedding, ts FROM embeddings JOIN events ON event_id = vec_id),
    p AS (SELECT a.vec_id AS id, max({_SIM}) AS sim FROM v a JOIN v b ON a.vec_id % 3 = 0 AND b.vec_id % 3 = 1 AND b.ts >= date_trunc('day', a.ts) AND b.ts < date_trunc('day', a.ts) + INTERVAL 48 HOUR GROUP BY a.vec_id)
    SELECT (SELECT count(*) FROM v WHERE vec_id % 3 = 0) AS total, (SELECT count(*) FROM p WHERE sim >= 0.3) AS matched""",
    None,
)
def alg_08_clusters(s: Spark, d: str) -> DataFrame:
    v = table(s, d, "embeddings").join(table(s, d, "events"), F.col("vec_id") == F.col("event_id")).select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("ts").alias("at"))
    matched, rest = C.incremental(*C.day_candidates(v.where("id % 3 = 0"), v.where("id % 3 = 1")), 0.3)
    both = matched.select(F.lit(1).alias("m")).unionByName(rest.select(F.lit(0).alias("m")))
    return both.agg(F.count("*").alias("total"), F.count_if(F.col("m") == 1).alias("matched"))


_WINDOW = "SELECT {w} AS block, count(*) AS n, min(event_id) AS first FROM events{where} GROUP BY 1 HAVING count(*) >= 2"
_SECONDS = "date_diff('microsecond', (SELECT {start} FROM events), ts)"


@query("alg_10_tumbling", _WINDOW.format(w="CAST(floor(" + _SECONDS.format(start="min(ts)") + " / 129600000000.0) AS BIGINT)", where=""), None)
def alg_10(s: Spark, d: str) -> DataFrame:
    e = table(s, d, "events")
    start = F.lit(e.agg(F.min("ts")).first()[0])
    return e.groupBy(C.tumbling(F.col("ts"), start, 36).alias("block")).agg(F.count("*").alias("n"), F.min("event_id").alias("first")).where("n >= 2")


@query("alg_11_from_midnight", _WINDOW.format(w="CAST(floor(" + _SECONDS.format(start="date_trunc('day', min(ts))") + " / 172800000000.0) AS BIGINT)", where=""), None)
def alg_11(s: Spark, d: str) -> DataFrame:
    e = table(s, d, "events")
    start = F.date_trunc("day", F.lit(e.agg(F.min("ts")).first()[0]))
    return e.groupBy(C.tumbling(F.col("ts"), start, 48).alias("block")).agg(F.count("*").alias("n"), F.min("event_id").alias("first")).where("n >= 2")


@query("alg_12_end_exclusive", _WINDOW.format(w="CAST(floor(" + _SECONDS.format(start="min(ts)") + " / 129600000000.0) AS BIGINT)", where=" WHERE ts < (SELECT max(ts) FROM events)"), None)
def alg_12(s: Spark, d: str) -> DataFrame:
    e = table(s, d, "events")
    ends = e.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    return e.where(F.col("ts") < F.lit(ends.b)).groupBy(C.tumbling(F.col("ts"), F.lit(ends.a), 36).alias("block")).agg(F.count("*").alias("n"), F.min("event_id").alias("first")).where("n >= 2")


@query(
    "alg_13_sliding",
    """WITH m AS (SELECT max(ts) AS newest FROM events), b AS (SELECT event_id, date_diff('microsecond', ts, newest) / 3600000000.0 AS back FROM events, m),
    k AS (SELECT event_id, unnest(generate_series(greatest(0, CAST(ceil((back - 36) / 4) AS BIGINT)), CAST(ceil(back / 4) AS BIGINT) - 1)) AS block FROM b)
    SELECT block, count(*) AS n FROM k GROUP BY block""",
    None,
)
def alg_13(s: Spark, d: str) -> DataFrame:
    return C.sliding(table(s, d, "events"), "ts", 36, 4).groupBy("block").agg(F.count("*").alias("n"))


@query("alg_14_fixed_batches", "WITH r AS (SELECT id, (row_number() OVER (ORDER BY published_at, id) - 1) // 250 AS block FROM text_articles WHERE ready_for_kg) SELECT block, count(*) AS n, min(id) AS first FROM r GROUP BY block", "text")
def alg_14(s: Spark, d: str) -> DataFrame:
    """Numbers follow from counts by day, so only a day is sorted at a time."""
    rows = text_articles(s, d).where("ready_for_kg").select("id", "published_at", F.to_date("published_at").alias("day"))
    from pyspark.sql import Window

    days = rows.groupBy("day").agg(F.count("*").alias("c"))
    base = days.withColumn("base", F.sum("c").over(Window.orderBy("day")) - F.col("c")).select("day", "base")  # a row for each day
    numbered = rows.join(base, "day").withColumn("k", F.col("base") + F.row_number().over(Window.partitionBy("day").orderBy("published_at", "id")) - 1)
    return numbered.groupBy(F.expr("k div 250").alias("block")).agg(F.count("*").alias("n"), F.min("id").alias("first"))


_GAZ = r"""WITH gaz AS (SELECT item_id, 'T' || (item_id % 15) AS ticker, array_to_string(list_slice(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), 1, 3), ' ') AS pattern, ['name', 'alias', 'brand'][item_id % 3 + 1] AS method, [1.0, 0.95, 0.8][item_id % 3 + 1]::DOUBLE AS confidence FROM benchmark),
hits AS (SELECT a.id, g.*, regexp_matches(lower(a.title), '(^|[^\p{L}\p{N}_])' || g.pattern || '($|[^\p{L}\p{N}_])') AS t, regexp_matches(lower(a.summary), '(^|[^\p{L}\p{N}_])' || g.pattern || '($|[^\p{L}\p{N}_])') AS s FROM text_articles a, gaz g)
SELECT id AS article_id, ticker, CASE WHEN bool_or(t) AND bool_or(s) THEN 'both' WHEN bool_or(t) THEN 'title' ELSE 'summary' END AS mention_type, arg_min(method, (-confidence, item_id)) AS match_method, arg_min(pattern, (-confidence, item_id)) AS matched_text, max(confidence) AS confidence FROM hits WHERE t OR s GROUP BY id, ticker"""


@query("alg_16_map_articles", _GAZ, "text")
def alg_16(s: Spark, d: str) -> DataFrame:
    words = F.array_join(F.slice(T.tokens("text"), 1, 3), " ")
    pick = lambda *x: F.element_at(F.array(*[F.lit(v) for v in x]), (F.col("item_id") % 3 + 1).cast("int"))
    gaz = table(s, d, "benchmark").select(words.alias("pattern"), F.concat(F.lit("T"), (F.col("item_id") % 15).cast("string")).alias("ticker"), pick("name", "alias", "brand").alias("method"), pick(1.0, 0.95, 0.8).alias("confidence"), F.lit(True).alias("fold"), F.lit(False).alias("cashtag"), F.col("item_id").alias("priority"))
    return E.map_articles(text_articles(s, d), gaz)


_FORMS = ", ".join(f"('{f}', '{v}')" for f, v in sorted(E.verb_forms().items()))
_LIST = lambda words: ", ".join(f"'{w}'" for w in words)


@query(
    "alg_19_verb_filter",
    rf"""WITH forms(f, v) AS (VALUES {_FORMS}), w AS (SELECT id, unnest(regexp_extract_all(lower(title), '[\p{{L}}\p{{N}}_]+')) AS w, generate_subscripts(regexp_extract_all(lower(title), '[\p{{L}}\p{{N}}_]+'), 1) AS k FROM text_articles),
    hit AS (SELECT id, arg_min(v, k) FILTER (WHERE v IN ({_LIST(E.KEEP_VERBS)})) AS keep, arg_max(v, k) FILTER (WHERE v IN ({_LIST(E.KILL_VERBS)})) AS kill FROM w JOIN forms ON f = w GROUP BY id)
    SELECT id, keep IS NOT NULL OR kill IS NULL AS passed, CASE WHEN keep IS NOT NULL THEN 'keep' WHEN kill IS NOT NULL THEN 'kill' ELSE 'neutral' END AS category, coalesce(keep, kill) AS verb,
      CASE WHEN keep IS NOT NULL THEN 0.9 WHEN kill IS NOT NULL THEN 0.8 ELSE 0.5 END::DOUBLE AS confidence FROM text_articles LEFT JOIN hit USING (id)""",
    "text",
)
def alg_19(s: Spark, d: str) -> DataFrame:
    return E.verb_filter(text_articles(s, d))


@query("alg_20_entity_density")
def alg_20(s: Spark, d: str) -> DataFrame:
    out = E.entity_density(text_articles(s, d))
    return out.withColumn("counts", F.to_json("counts"))


@query("alg_22_student")
def alg_22(s: Spark, d: str) -> DataFrame:
    """A student of the embeddings' labels, measured on held-out rows."""
    train, test = K.split(table(s, d, "embeddings"), "vec_id")
    return K.measures(K.predict(K.train_student(train), test), "label", "predicted")


@query("agg_22_measures", """WITH x AS (SELECT quality AS t, toxic AS p FROM labels), l AS (SELECT t AS label FROM x UNION SELECT p FROM x),
    n AS (SELECT label, (SELECT count(*) FROM x WHERE t = label) AS support, (SELECT count(*) FROM x WHERE p = label) AS predicted_n, (SELECT count(*) FROM x WHERE t = label AND p = label) AS correct FROM l)
    SELECT *, round(CASE WHEN predicted_n > 0 THEN correct / predicted_n::DOUBLE ELSE 0 END, 6) AS precision, round(CASE WHEN support > 0 THEN correct / support::DOUBLE ELSE 0 END, 6) AS recall, round(2 * correct / (support + predicted_n)::DOUBLE, 6) AS f1 FROM n""", None)  # fmt: skip
def agg_22(s: Spark, d: str) -> DataFrame:
    return K.measures(table(s, d, "labels"), "quality", "toxic")


@query("alg_24_classification_filter", "SELECT id, classification_label IN ('FACTUAL', 'OPINION') AS passed FROM articles WHERE classification_label IS NOT NULL")
def alg_24(s: Spark, d: str) -> DataFrame:
    return K.passing(articles(s, d).where("classification_label is not null"), "classification_label", ["FACTUAL", "OPINION"]).select("id", "passed")


@query("alg_32_cost", "SELECT source, count(*) AS n, round(count(*) * (350 * 0.15 + 50 * 0.6) / 1e6, 6) AS cost FROM articles GROUP BY source")
def alg_32(s: Spark, d: str) -> DataFrame:
    return articles(s, d).groupBy("source").agg(F.count("*").alias("n"), K.cost(F.count("*"), price_in=0.15, price_out=0.6).alias("cost"))


@query("q25_all_pairs", f"SELECT a.vec_id AS i, b.vec_id AS j, round({_SIM}, 6) AS sim, {_SIM} >= 0.4 AS would_cluster FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id ORDER BY {_SIM} DESC, i, j LIMIT 50", None)
def q25(s: Spark, d: str) -> DataFrame:
    pairs = C.similar_pairs(vectors(s, d), -1.0, None, most=50)
    return pairs.orderBy(F.desc("sim"), "i", "j").limit(50).select("i", "j", F.round("sim", 6).alias("sim"), (F.col("sim") >= 0.4).alias("would_cluster"))


@query("alg_28_sandbox_clusters")
def alg_28(s: Spark, d: str) -> DataFrame:
    return C.sandbox(vectors(s, d), 0.3)


@query("alg_35_recent_window", f"WITH r AS (SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 36 HOUR) SELECT count(*) AS n, count(*) >= 2 AS clustered FROM r JOIN embeddings ON vec_id = event_id", None)
def alg_35(s: Spark, d: str) -> DataFrame:
    """The last 36 hours in one block; fewer than two rows are not clustered."""
    e = table(s, d, "events")
    recent = e.where(F.col("ts") >= F.lit(e.agg(F.max("ts")).first()[0]) - F.expr("INTERVAL 36 HOURS")).select(F.col("event_id").alias("id"))
    rows = vectors(s, d).join(recent, "id")
    return C.cluster_vectors(rows, 0.3).agg(F.count("*").alias("n"), (F.count("*") >= 2).alias("clustered"))


@query("alg_36_bulk_classification")
def alg_36(s: Spark, d: str) -> DataFrame:
    """The whole backlog in one job, with the histogram of labels by source."""
    a = text_articles(s, d)
    return a.select("id", "source").join(K.rule_labels(a).withColumnRenamed("article_id", "id"), "id").groupBy("source", "label").agg(F.count("*").alias("n"))


@query("alg_26_integrity", "SELECT (SELECT count(*) FROM text_articles) AS articles, (SELECT count(*) FROM text_articles) AS verbs, (SELECT count(*) FROM text_articles) AS entities, (SELECT count(*) FROM embeddings) AS clustered", "text")
def alg_26(s: Spark, d: str) -> DataFrame:
    """Every operator returns as many rows as it got."""
    a = text_articles(s, d)
    n = lambda rows, name: rows.agg(F.count("*").alias(name))
    return n(a, "articles").crossJoin(n(E.verb_filter(a), "verbs")).crossJoin(n(E.entity_density(a), "entities")).crossJoin(n(C.cluster_vectors(vectors(s, d), 0.3), "clustered"))


@query("alg_31_retro_fix", "SELECT article_id, company_id FROM mentions WHERE NOT (match_method = 'brand' AND company_id % 2 = 0) UNION ALL SELECT article_id, company_id FROM mentions WHERE match_method = 'brand' AND company_id % 2 = 0 AND article_id % 3 = 0")
def alg_31(s: Spark, d: str) -> DataFrame:
    """After a rule change the matches it touches are deleted and those that still hold are put back."""
    from ..operators import store as S
    from .fixtures import mentions

    m = mentions(s, d).select("article_id", "company_id", "match_method")
    touched = (F.col("match_method") == "brand") & (F.col("company_id") % 2 == 0)
    again = m.where(touched).where("article_id % 3 = 0")
    return S.delete(m, touched).unionByName(again).select("article_id", "company_id")


@query("q27_teacher_queue", "SELECT id FROM text_articles WHERE id NOT IN (SELECT doc_id FROM labels) AND NOT source LIKE 'src1%' ORDER BY md5(id || ':1'), id LIMIT 1", "text")
def q27(s: Spark, d: str) -> DataFrame:
    """The next article for the teacher."""
    from ..operators import store as S

    rest = S.not_in(text_articles(s, d).select("id", "source"), "id", table(s, d, "labels"), "doc_id").where(~F.col("source").startswith("src1"))
    return rest.orderBy(F.md5(F.concat_ws(":", F.col("id").cast("string"), F.lit("1"))), "id").limit(1).select("id")


@query("q26_sandbox_mapper", "SELECT id, title FROM text_articles ORDER BY md5(id || ':3'), id LIMIT 5", "text")
def q26(s: Spark, d: str) -> DataFrame:
    """Random articles for the mapper's sandbox."""
    return text_articles(s, d).orderBy(F.md5(F.concat_ws(":", F.col("id").cast("string"), F.lit("3"))), "id").limit(5).select("id", "title")


@query("alg_27_annotation")
def alg_27(s: Spark, d: str) -> DataFrame:
    from .annotation import process

    return process(text_articles(s, d), table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), threshold=0.3).stats
