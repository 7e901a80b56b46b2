"""Companies in articles by dictionary, and rule-based stand-ins for verb and entity models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# Tickers that are words or too short, which count as $TICKER only.
AMBIGUOUS = (
    "A C D F J K L O V T AL AN AM BA BG BR CE CF CI CL DD DG ED EL ES FE GD GE GL GM GS HD IR IT IP KR LH LW MA MO MS MU NI NP ON PH PM RE RF RL SO TT WM WY "
    "ALL ARE BIO CAT COF COP DAL DAY DOC DOV DOW DTE EOG ERA EQT FAST DISH DASH BALL COST DECK DELL EDGE FLEX GAIN HALO HAS HAL HUM ICE KEY KIM LULU LOW MAS META NAPA NOW POOL PARA PEAK PLAY POST SNAP TECH TRUE WELL WOLF"
).split()
# Lemmas of verbs that report events, and of those that only ponder.
KEEP_VERBS = (
    "acquire merge buy sell divest spin split launch announce unveil introduce release close open expand cut reduce increase hire fire appoint resign retire promote "
    "beat miss report post deliver record raise lower upgrade downgrade initiate pay dividend buyback repurchase sue settle fine penalize approve reject ban allow regulate investigate charge "
    "soar plunge surge tumble rally crash gain lose rise fall climb drop produce manufacture halt suspend resume recall fix replace update partner collaborate sign agree negotiate bid win award contract"
).split()
KILL_VERBS = (
    "think believe feel seem appear look suggest indicate imply hint might may could would should expect predict forecast estimate project why what how when where who "
    "watch monitor track follow eye consider weigh ponder contemplate explore evaluate assess review"
).split()
# Irregular forms.
IRREGULAR = {"bought": "buy", "sold": "sell", "spun": "spin", "paid": "pay", "lost": "lose", "rose": "rise", "fell": "fall", "won": "win", "thought": "think", "felt": "feel"}


def gazetteer(companies: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(pattern, ticker, method, confidence, fold, cashtag, priority) of ``companies`` (ticker, name) and ``aliases`` (alias, ticker, kind alias|brand).

    In this order: full names (1.0), names without ending (1.0), aliases (0.95)
    and brands (0.8), tickers of three letters and more that are no words (0.9,
    case-sensitive), other tickers as $TICKER (0.85). A pattern seen before, in
    lower case, is dropped.
    """
    names = companies.where("name is not null and trim(name) <> ''").select(F.trim("name").alias("pattern"), "ticker", F.lit("name").alias("method"), F.lit(1.0).alias("confidence"), F.lit(1).alias("step"))
    short = names.select(T.strip_suffix("pattern").alias("pattern"), "ticker", "method", "confidence", F.lit(2).alias("step")).where("length(pattern) >= 3")
    parts = [names, short]
    if aliases is not None:
        brand = F.col("kind") == "brand"
        parts.append(aliases.select(F.trim("alias").alias("pattern"), "ticker", F.when(brand, "brand").otherwise("alias").alias("method"), F.when(brand, 0.8).otherwise(0.95).alias("confidence"), F.when(brand, 4).otherwise(3).alias("step")))
    plain = (F.length("ticker") >= 3) & ~F.col("ticker").isin(AMBIGUOUS)
    parts.append(companies.where(plain).select(F.col("ticker").alias("pattern"), "ticker", F.lit("ticker").alias("method"), F.lit(0.9).alias("confidence"), F.lit(5).alias("step")))
    parts.append(companies.where(~plain).select(F.concat(F.lit("$"), "ticker").alias("pattern"), "ticker", F.lit("ticker").alias("method"), F.lit(0.85).alias("confidence"), F.lit(6).alias("step")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    first = rows.groupBy(F.lower("pattern").alias("_k")).agg(F.min(F.struct("step", "ticker", "pattern", "method", "confidence")).alias("p")).select("p.*")
    return first.select("pattern", "ticker", "method", "confidence", (F.col("step") < 5).alias("fold"), (F.col("step") == 6).alias("cashtag"), F.struct("step", "ticker", "pattern").alias("priority"))


def _found(text: Column) -> Column:
    """Whether the row's pattern stands in ``text`` with word boundaries (a boundary beside a mark never holds; a cashtag needs one at its end only)."""
    quoted = F.concat(F.lit(r"\Q"), F.col("pattern"), F.lit(r"\E\b"))
    regex = F.when(F.col("cashtag"), F.concat(F.lit("(?U)"), quoted)).when(F.col("fold"), F.concat(F.lit(r"(?iuU)\b"), quoted)).otherwise(F.concat(F.lit(r"(?U)\b"), quoted))
    return F.rlike(text, regex)


def map_articles(articles: DataFrame, patterns: DataFrame) -> DataFrame:
    """(article_id, ticker, mention_type, match_method, matched_text, confidence): companies found in ``articles`` (id, title, summary).

    Of a company's patterns the most confident counts (the first by priority of
    equals); mention_type says where any of them stands. Texts are exploded to
    runs of words as long as patterns are and joined with them by equality; the
    pattern itself is then searched in the cleaned text. So the work follows the
    text, not text times patterns.
    """
    patterns = patterns.withColumn("_w", T.tokens("pattern")).where("size(_w) > 0")
    lengths = sorted(r[0] for r in patterns.select(F.size("_w")).distinct().collect())  # a few lengths
    keyed = patterns.withColumn("_key", F.array_join("_w", " ")).drop("_w")
    rows = articles.select(F.col("id").alias("article_id"), T.cleaned(F.coalesce("title", F.lit(""))).alias("_t"), T.cleaned(F.coalesce("summary", F.lit(""))).alias("_s"))
    words = rows.select("article_id", F.array(T.tokens("_t"), T.tokens("_s")).alias("_both")).select("article_id", F.explode("_both").alias("_w"))
    none = F.array().cast("array<string>")

    def of(n: int) -> Column:
        """The runs of n words."""
        return F.when(F.size("_w") >= n, F.transform(F.sequence(F.lit(1), F.size("_w") - n + 1), lambda i: F.array_join(F.slice("_w", i, n), " "))).otherwise(none)

    runs = F.flatten(F.array(none, *map(of, lengths)))
    grams = words.select("article_id", F.explode(F.array_distinct(runs)).alias("_key"))
    candidates = grams.join(keyed, "_key").join(rows, "article_id")
    hits = candidates.withColumn("_in_t", _found(F.col("_t"))).withColumn("_in_s", _found(F.col("_s"))).where("_in_t or _in_s")
    best = F.min(F.struct((-F.col("confidence")).alias("c"), "priority", "method", "pattern")).alias("b")
    found = hits.groupBy("article_id", "ticker").agg(best, F.bool_or("_in_t").alias("t"), F.bool_or("_in_s").alias("s"))
    kind = F.when(F.col("t") & F.col("s"), "both").when(F.col("t"), "title").otherwise("summary")
    return found.select("article_id", "ticker", kind.alias("mention_type"), F.col("b.method").alias("match_method"), F.col("b.pattern").alias("matched_text"), (-F.col("b.c")).alias("confidence"))


def aliases_of(aliases: DataFrame, ticker: str) -> DataFrame:
    return aliases.where(F.upper("ticker") == ticker.strip().upper()).select("alias")


def ticker_of(aliases: DataFrame, alias: str) -> DataFrame:
    return aliases.where(F.lower(F.trim("alias")) == alias.strip().lower()).select("ticker")


def validation(articles: DataFrame, found: DataFrame) -> DataFrame:
    """How often the ticker in the source's parentheses was found; passes at 80 %."""
    truth = articles.select(F.col("id").alias("article_id"), T.in_parentheses("source").alias("want")).where("want <> ''")
    got = found.groupBy("article_id").agg(F.collect_set("ticker").alias("tickers"))
    rows = truth.join(got, "article_id", "left")
    right = F.count_if(F.array_contains("tickers", F.col("want")))
    return rows.agg(F.count("*").alias("total"), right.alias("correct"), F.count_if(F.col("tickers").isNull()).alias("none"), F.round(right / F.greatest(F.count("*"), F.lit(1)), 4).alias("rate"), (right >= 0.8 * F.count("*")).alias("passed"))


def _forms(lemma: str) -> list[str]:
    e = lemma.endswith("e")
    stem = lemma[:-1] if e else lemma
    y = lemma.endswith("y") and lemma[-2] not in "aeiou"
    third = lemma[:-1] + "ies" if y else lemma + ("es" if lemma.endswith(("s", "x", "ch", "sh")) else "s")
    past = lemma[:-1] + "ied" if y else stem + "ed"
    double = lemma + lemma[-1] if lemma[-1] in "bdgnptr" and lemma[-2] in "aeiou" else stem
    return [lemma, third, past, stem + "ing", double + "ed", double + "ing"]


def verb_forms() -> dict[str, str]:
    return {f: v for v in [*KILL_VERBS, *KEEP_VERBS] for f in _forms(v)} | IRREGULAR


def _lemmas() -> Column:
    return F.create_map(*[F.lit(x) for k, v in sorted(verb_forms().items()) for x in (k, v)])


def verb_filter(articles: DataFrame) -> DataFrame:
    """(id, passed, category, verb, confidence): the first event verb of the title passes it, else the last pondering one fails it, else it passes as neutral.

    A stand-in for a tagger: lemmas come from a list of forms made by rule.
    """
    lemmas = _lemmas()
    lemma = F.filter(F.transform(T.tokens(F.coalesce("title", F.lit(""))), lambda w: F.element_at(lemmas, w)), lambda x: x.isNotNull())
    keep = F.get(F.filter("_l", lambda x: x.isin(KEEP_VERBS)), F.lit(0))
    kills = F.filter("_l", lambda x: x.isin(KILL_VERBS))
    rows = articles.withColumn("_l", lemma).select("id", keep.alias("_k"), F.when(F.size(kills) > 0, F.element_at(kills, -1)).alias("_x"))
    category = F.when(F.col("_k").isNotNull(), "keep").when(F.col("_x").isNotNull(), "kill").otherwise("neutral")
    return rows.select("id", (category != "kill").alias("passed"), category.alias("category"), F.coalesce("_k", "_x").alias("verb"), F.when(category == "keep", 0.9).when(category == "kill", 0.8).otherwise(0.5).alias("confidence"))


ENTITY_RULES = {
    "MONEY": r"[$€£]\s?\d[\d,.]*(?:\s?(?:million|billion|trillion|[MBT]))?",
    "PERCENT": r"\d+(?:\.\d+)?\s?(?:%|percent)",
    "DATE": r"\b(?:January|February|March|April|May|June|July|August|September|October|November|December)(?:\s+\d{1,2})?(?:,?\s+\d{4})?|\bQ[1-4]\b",
    "ORG": r"\b(?:\p{Lu}[\p{L}&]+\s+)+(?:Inc|Corp|Ltd|PLC|LLC|Group|Holdings)\b",
    "LAW": r"\b(?:\p{Lu}\p{Ll}+\s+)+Act\b",
}


def entity_density(articles: DataFrame, minimum: int = 1) -> DataFrame:
    """(id, total, counts, passed): typed spans in title and summary, by rules in place of a model."""
    text = T.full_text(F.coalesce("title", F.lit("")), "summary")
    counts = {k: F.size(F.regexp_extract_all(text, F.lit(p), F.lit(0))) for k, p in ENTITY_RULES.items()}
    pairs = F.filter(F.array(*[F.struct(F.lit(k).alias("type"), n.alias("n")) for k, n in counts.items()]), lambda x: x["n"] > 0)
    rows = articles.select("id", F.map_from_entries(pairs).alias("counts"))
    total = F.aggregate(F.map_values("counts"), F.lit(0), lambda a, x: a + x)
    return rows.select("id", total.alias("total"), "counts", (total >= minimum).alias("passed"))
