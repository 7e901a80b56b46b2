"""How far each source of a language strays from the language and from its other sources, and by which terms."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import written

#: A language keeps the terms that this many of its documents hold.
LEAST_DOCS = 10
#: Counts of a task are handed on when it holds so many terms, or has read so many bytes.
HELD_TERMS, HELD_BYTES = 1 << 18, 1 << 26
#: Probabilities are whole billionths; each term counts as if seen so many times more.
SCALE, PRIOR = 1_000_000_000, 2
#: Each further round looks so many times deeper into the buckets of a group.
DEEPER = 8

#: ASCII letters in lower case and all bytes beyond ASCII; any other byte ends a term.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of (lang, source, text), summed over what one task holds at a time; the term '' counts a group's documents."""
    found: dict[tuple, tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))

    def handed_on() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in found.items():
            terms = list(docs)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()), pa.array(terms, pa.binary()).cast(pa.string()), pa.array([n[t] for t in terms], pa.int64()), pa.array([docs[t] for t in terms], pa.int64())],
                names=["lang", "source", "term", "n", "docs"],
            )
        found.clear()

    held = read = 0
    for batch in batches:
        langs, sources, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary())
        for lang, source, body in zip(langs, sources, texts, strict=True):
            body = body.as_py()
            terms = body.translate(_LETTERS).split(b" ")
            n, docs = found[lang, source]
            before = len(docs)
            n.update(terms)
            docs.update({*terms, b""})
            n[b""] = 0
            held, read = held + len(docs) - before, read + len(body)
            if held >= HELD_TERMS or read >= HELD_BYTES:
                yield from handed_on()
                held = read = 0
    yield from handed_on()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and documents that hold it; the term '' has the documents of each group. Null langs, sources and texts are ''."""
    rows = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counted = rows.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def probability(n: str, total: str, kept: str) -> str:
    """SQL of 1 + floor(SCALE * (n + PRIOR) / (total + PRIOR * kept)), exact for any long n."""
    whole = f"({total} + {PRIOR} * {kept})"
    return f"1 + if({n} < 9000000000, (({n} + {PRIOR}) * {SCALE}) div {whole}, cast((cast({n} + {PRIOR} as decimal(20, 0)) * {SCALE}) div cast({whole} as decimal(20, 0)) as long))"


def distance(p: str, q: str) -> str:
    """SQL of floor((p - q)^2 / (p + q)); it rises with p above q and falls with q below p."""
    return f"((({p}) - ({q})) * (({p}) - ({q}))) div (({p}) + ({q}))"


def _bucket(n: str) -> str:
    """SQL of the bucket of a count: itself below 16, then sixteen for each doubling; a group has fewer than 1,000."""
    e = f"(length(bin({n})) - 1)"
    return f"if({n} < 16, {n}, 16L * {e} + (shiftright({n}, {e} - 4) & 15L))"


def postings(counts: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, term, lang_n, held: array of (source, n)) of the kept terms; an array is as long as a language has sources at most."""
    found = counts.where("term <> ''").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("held"))
    return found.where(F.col("docs") >= least_docs).drop("docs")


def groups(counts: DataFrame, held: DataFrame) -> DataFrame:
    """(lang, source, total, kept, lang_total, rest): a row for each group that occurs; rest is the probability of a kept term that it lacks (null without kept terms)."""
    sums = held.select("lang", F.explode("held").alias("h")).groupBy("lang", F.col("h.source").alias("source")).agg(F.sum("h.n").alias("total"))
    langs = held.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("lang_n").alias("lang_total"))
    found = counts.where("term = ''").select("lang", "source").join(sums, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["total", "kept", "lang_total"])
    return found.withColumn("rest", F.expr(f"if(kept > 0, {probability('0L', 'total', 'kept')}, null)"))


def top_terms(entries: DataFrame, group: DataFrame, k: int = 10) -> DataFrame:
    """(lang, source, term, value, rank): the ``k`` terms by which each group exceeds its language most; ties to the smaller term.

    ``entries`` are (lang, source, term, n, lang_n). The terms of a group lie in
    buckets of like counts. The largest count of a bucket with the smallest count
    that the language has for any of its terms bounds the value of all of them.
    Buckets are evaluated from the greatest bound down, deeper by rounds, until
    every bound left is strictly below the group's kth value. A group has fewer
    than 1,000 buckets, and only terms of opened ones are evaluated and ranked.
    """
    spark, key = entries.sparkSession, ["lang", "source"]
    p, q = probability("n", "total", "kept"), probability("lang_n", "lang_total", "kept")
    entries = entries.withColumn("bucket", F.expr(_bucket("n")))
    buckets = entries.groupBy(*key, "bucket").agg(F.max("n").alias("n"), F.min("lang_n").alias("lang_n"), F.count("*").alias("size"))
    buckets = buckets.join(group, key).withColumn("p", F.expr(p)).withColumn("q", F.expr(q)).where("p > q").withColumn("bound", F.expr(distance("p", "q")))
    order = Window.partitionBy(*key).orderBy(F.desc("bound"), "bucket")
    buckets = written(buckets.withColumn("before", F.sum("size").over(order) - F.col("size")).select(*key, "bucket", "bound", "before"))
    best = spark.createDataFrame([], "lang string, source string, term string, value long, rank int")
    kth = spark.createDataFrame([], "lang string, source string, kth long")
    low, depth = 0, k
    while True:
        # Buckets of earlier rounds that their group's kth value left out then stay out: it only rises.
        opened = buckets.join(kth, key, "left").where(f"before >= {low} and before < {depth} and bound >= coalesce(kth, 0)").select(*key, "bucket")
        terms = entries.join(opened, [*key, "bucket"]).join(group, key).withColumn("p", F.expr(p)).withColumn("q", F.expr(q)).where("p > q")
        both = best.drop("rank").unionByName(terms.select(*key, "term", F.expr(distance("p", "q")).alias("value")))
        ranked = both.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("value"), "term")))
        best = written(ranked.where(f"rank <= {k}"))
        kth = best.where(f"rank = {k}").select(*key, F.col("value").alias("kth"))
        if buckets.join(kth, key, "left").where(f"before >= {depth} and bound >= coalesce(kth, 0)").isEmpty():
            return best
        low, depth = depth, DEEPER * depth


def pair_sums(held: DataFrame, entries: DataFrame, group: DataFrame) -> DataFrame:
    """(lang, source, other, value): the summed distance over all kept terms of each two sources of a language, both ways round.

    Terms that neither source has differ alike, and so do those that only one
    has with equal counts: they are summed by counts. Only for terms that both
    have the postings are paired, which makes no more rows than a language has
    pairs of sources for each kept term, and they are summed before they move.
    """
    rest = group.groupBy("lang", "kept").agg(F.collect_list(F.struct("source", "total", "rest")).alias("all"))  # a row for each language, as long as its sources
    sides = group.join(rest.drop("kept"), "lang").select("lang", "source", "total", "kept", "rest", F.explode("all").alias("o")).where("o.source <> source")
    none = sides.select("lang", "source", F.col("o.source").alias("other"), F.expr(f"if(kept > 0, kept * ({distance('rest', 'o.rest')}), 0L)").alias("value"))
    like = entries.groupBy("lang", "source", "n").agg(F.count("*").alias("terms")).join(group, ["lang", "source"]).withColumn("p", F.expr(probability("n", "total", "kept")))
    one = like.join(rest.drop("kept"), "lang").select("lang", "source", "terms", "p", "rest", F.explode("all").alias("o")).where("o.source <> source")
    one = one.groupBy("lang", "source", F.col("o.source").alias("other")).agg(F.sum(F.expr(f"terms * ({distance('p', 'o.rest')} - {distance('rest', 'o.rest')})")).alias("value"))
    known = rest.select("lang", "kept", F.expr("map_from_entries(transform(all, x -> struct(x.source, x)))").alias("of"))
    posted = held.where("size(held) > 1").join(known, "lang")
    posted = posted.select("lang", F.expr(f"transform(held, h -> struct(h.source as source, {probability('h.n', 'of[h.source].total', 'kept')} as p, of[h.source].rest as rest))").alias("h"))
    pairs = posted.select("lang", "h", F.posexplode("h").alias("i", "a")).select("lang", "a", F.explode(F.expr("slice(h, i + 2, size(h))")).alias("b"))
    more = pairs.select(
        "lang",
        F.least("a.source", "b.source").alias("source"),
        F.greatest("a.source", "b.source").alias("other"),
        F.expr(f"{distance('a.p', 'b.p')} - {distance('a.p', 'b.rest')} - {distance('a.rest', 'b.p')} + {distance('a.rest', 'b.rest')}").alias("value"),
    )
    more = written(more.groupBy("lang", "source", "other").agg(F.sum("value").alias("value")))
    turned = [x.select("lang", F.col("other").alias("source"), F.col("source").alias("other"), "value") for x in (one, more)]
    parts = none.unionByName(one).unionByName(more)
    for x in turned:
        parts = parts.unionByName(x)
    return parts.groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, k: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank): for each source of a language its distance to each other one (part ``pair``), and the ``k`` terms it overuses most (``term``).

    ``docs`` has lang, source and text, any of them null (then ''); further
    columns are ignored, repeated rows count each. Terms are runs of ASCII
    letters, lower-cased, and of all characters beyond ASCII, of whole texts. A
    language keeps terms that ``least_docs`` of its documents hold; without any,
    distances are 0 and there are no ``term`` rows. Ranks start at 1, by falling
    value, then rising item in UTF-8. A single source of a language has no
    pairs; an empty table gives an empty one.
    """
    counts = written(term_counts(docs))
    held = written(postings(counts, least_docs))
    group = written(groups(counts, held))
    entries = held.select("lang", "term", "lang_n", F.explode("held").alias("h")).select("lang", F.col("h.source").alias("source"), "term", F.col("h.n").alias("n"), "lang_n")
    pair = pair_sums(held, entries, group).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "other")))
    pair = pair.select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), "value", "rank")
    term = top_terms(entries, group, k).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")
    return pair.unionByName(term)
