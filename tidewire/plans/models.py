"""Students, MinHash clusters, backfills and batches as queries."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import backfill as B
from ..operators import clustering as C
from ..operators import entities as E
from ..operators import inference as I
from ..operators import minhash as M
from ..operators import student as K
from . import algorithms  # noqa: F401  the SQL of its queries is used here
from .annotation import unprocessed
from .fixtures import table, text_articles
from .registry import ORACLES, query

Spark = SparkSession
CLASSES = list(range(10))

_NEAREST = """cells AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS m FROM embeddings, range(1, 65) t(i) GROUP BY label, i),
means AS (SELECT label, list(m ORDER BY i) AS mean FROM cells GROUP BY label),
stored AS (SELECT e.vec_id, e.label, arg_min(m.label, (-round(list_dot_product(e.embedding::DOUBLE[], m.mean), 12), m.label)) AS predicted FROM embeddings e, means m GROUP BY e.vec_id, e.label)"""


def _stored(s: Spark, d: str) -> DataFrame:
    rows = table(s, d, "embeddings")
    return K.nearest_mean(rows, K.class_means(rows, "label", "embedding"), "label", "embedding").select("vec_id", "label", "predicted")


@query("alg_22_nearest_mean", f"WITH {_NEAREST} SELECT * FROM stored", None)
def alg_22_nearest(s: Spark, d: str) -> DataFrame:
    """Labels of all embeddings by the nearest class mean."""
    return _stored(s, d)


@query("agg_22_confusion", f"WITH {_NEAREST} SELECT CAST(label AS VARCHAR) AS truth, " + ", ".join(f"count(*) FILTER (WHERE predicted = {c}) AS \"{c}\"" for c in CLASSES) + " FROM stored GROUP BY label", None)
def agg_22_confusion(s: Spark, d: str) -> DataFrame:
    """How often each label was predicted as which."""
    return K.confusion(_stored(s, d), "label", "predicted", CLASSES)


@query("agg_22_accuracy", f"WITH {_NEAREST} SELECT count(*) AS n, count(*) FILTER (WHERE label = predicted) AS correct, round(count(*) FILTER (WHERE label = predicted) / count(*), 4) AS accuracy FROM stored", None)
def agg_22_accuracy(s: Spark, d: str) -> DataFrame:
    return K.accuracy(_stored(s, d), "label", "predicted")


@query("alg_22_cross_validated")
def alg_22_cross(s: Spark, d: str) -> DataFrame:
    """Both kinds of student of the embeddings' labels: held-out accuracy, and mean and deviation over five folds."""
    rows, out = table(s, d, "embeddings"), []
    for kind, options in (("logistic", {}), ("mlp", {"hidden": (32,), "max_iter": 20})):
        _, r = K.train(rows, "vec_id", kind=kind, **options)
        out.append((kind, r.train_size, r.test_size, r.test_accuracy, r.cv_mean, r.cv_std))
    return s.createDataFrame(out, "kind string, train_size long, test_size long, test_accuracy double, cv_mean double, cv_std double")


_BUCKETS = rf"words AS (SELECT id, regexp_extract_all(lower(title), '[\p{{L}}\p{{N}}_]+') AS w FROM text_articles), {M.buckets_sql('words', 0.7)}"


def _titles(s: Spark, d: str) -> DataFrame:
    return text_articles(s, d).select("id", F.col("title").alias("text"))


@query("alg_04_minhash_pairs", f"WITH {_BUCKETS} SELECT DISTINCT a.id AS i, b.id AS j FROM buckets a JOIN buckets b ON a.bucket = b.bucket AND a.id < b.id", "text")
def alg_04_pairs(s: Spark, d: str) -> DataFrame:
    """Candidates of the index: titles that share a band."""
    return M.text_pairs(_titles(s, d), 0.7, C.checkpointed)


@query(
    "alg_04_minhash_clusters",
    f"""WITH RECURSIVE {_BUCKETS},
    s AS (SELECT DISTINCT a.id AS i, b.id AS j FROM buckets a JOIN buckets b USING (bucket)),
    p AS (SELECT i, count(*) AS n, row_number() OVER (ORDER BY i) AS p FROM s GROUP BY i),
    e AS (SELECT pi.p, coalesce(list(pj.p) FILTER (WHERE pj.p < pi.p), []::BIGINT[]) AS earlier FROM s JOIN p pi ON s.i = pi.i JOIN p pj ON s.j = pj.i GROUP BY pi.p),
    r AS (SELECT 0::BIGINT AS p, []::BIGINT[] AS seeds UNION ALL
      SELECT r.p + 1, CASE WHEN pp.n >= 2 AND NOT list_has_any(r.seeds, e.earlier) THEN list_append(r.seeds, r.p + 1) ELSE r.seeds END FROM r JOIN p pp ON pp.p = r.p + 1 JOIN e ON e.p = r.p + 1),
    f AS (SELECT seeds FROM r ORDER BY p DESC LIMIT 1),
    m AS (SELECT s.i, min(s.j) FILTER (WHERE list_contains(f.seeds, pj.p)) AS seed FROM s JOIN p pj ON s.j = pj.i, f GROUP BY s.i)
    SELECT id, coalesce(seed, -1) AS label FROM text_articles LEFT JOIN m ON m.i = id""",
    "text",
)
def alg_04(s: Spark, d: str) -> DataFrame:
    """Clusters of titles by 128 permutations; candidates are not verified."""
    return M.clusters(_titles(s, d), 0.7, C.checkpointed)


def _verbs_sql() -> str:
    """The verb filter's own SQL over the articles that a backfill takes."""
    whole = ORACLES["alg_19_verb_filter"]
    head, last = whole.rsplit("FROM text_articles LEFT JOIN hit USING (id)", 1)
    return f"{head}FROM text_articles LEFT JOIN hit USING (id) WHERE source NOT LIKE 'src1%'{last}"


@query("alg_33_backfill", _verbs_sql(), None)
def alg_33(s: Spark, d: str) -> DataFrame:
    """The verb filter over the backlog, range by range, without one provider's articles."""
    C.checkpointed(s.range(1))  # sets the shared folder where it is unset
    root = f"{s.sparkContext.getCheckpointDir().rstrip('/')}/backfill-{uuid.uuid4().hex}"
    rows = text_articles(s, d)
    B.backfill(rows, "id", E.verb_filter, root, size=max(1000, rows.count() // 4), exclude="src1%")
    return B.results(s, root)


@query("alg_27_unprocessed", "SELECT id FROM text_articles WHERE classification_label IS NULL AND published_at >= (SELECT max(published_at) FROM text_articles) - INTERVAL 240 HOUR AND source NOT LIKE 'src1%' ORDER BY published_at DESC, id DESC LIMIT 200", "text")
def alg_27_unprocessed(s: Spark, d: str) -> DataFrame:
    """The batch that the refinery takes: unprocessed articles of the window, newest first, without one provider."""
    rows = text_articles(s, d)
    done = rows.where("classification_label is not null")
    return unprocessed(rows, done, batch_size=200, hours=240, exclude="src1%").select("id")


@query("alg_27_refinery")
def alg_27_refinery(s: Spark, d: str) -> DataFrame:
    """One batch through clusters, verbs, entities and statuses, and its row of statistics."""
    from .annotation import process_batch

    rows = text_articles(s, d)
    vectors = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return process_batch(rows, vectors, rows.where("classification_label is not null"), batch_size=200, hours=240, exclude="src1%", threshold=0.3).stats


LABELS = ("FACTUAL", "OPINION", "SLOP")


def rule_head() -> I.LinearHead:
    """A head whose weights come from MD5, so SQL can make them too: it shows the path of a model, not one that was trained."""
    from hashlib import md5

    return I.LinearHead(LABELS, np.array([[int(md5(f"{c}:{k}".encode()).hexdigest()[:8], 16) % 2001 - 1000 for k in range(I.BUCKETS)] for c in range(len(LABELS))]))


@query(
    "alg_36_model_histogram",
    f"""WITH w AS (SELECT id, source, list_slice(regexp_extract_all(lower(title || ' ' || summary), '[\\p{{L}}\\p{{N}}_]+'), 1, {I.TOKENS}) AS w FROM text_articles),
    b AS (SELECT id, CAST('0x' || substr(md5(unnest(w)), 1, 8) AS BIGINT) % {I.BUCKETS} AS k FROM w),
    c(c, name) AS (VALUES {', '.join(f"({i}, '{x}')" for i, x in enumerate(LABELS))}),
    s AS (SELECT id, c, name, sum(CAST('0x' || substr(md5(c || ':' || k), 1, 8) AS BIGINT) % 2001 - 1000) AS s FROM b, c GROUP BY id, c, name),
    p AS (SELECT id, arg_min(name, (-s, c)) AS label FROM s GROUP BY id),
    l AS (SELECT source, coalesce(label, 'UNKNOWN') AS label FROM w LEFT JOIN p USING (id))
    SELECT source, label, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY source), 6) AS share FROM l GROUP BY source, label""",
    "text",
)
def alg_36_model(s: Spark, d: str) -> DataFrame:
    """Labels of the whole backlog by a model in batches, by source."""
    rows = text_articles(s, d).select("id", "source", "title", "summary")
    return I.histogram(I.classified(rows, F.concat_ws(" ", "title", "summary"), rule_head, LABELS).select("source", "label"))
