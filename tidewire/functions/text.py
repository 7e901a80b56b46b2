"""Text functions as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Corporate endings that are cut from names, and phrases that mention no company.
SUFFIXES = ["Incorporated", "Corporation", "Company", "Limited", "Holdings", "Group", "Inc.", "Inc", "Corp.", "Corp", "Co.", "Ltd.", "Ltd", "PLC", "plc", "LLC", "S.A.", "N.V."]
NEGATIVE_PHRASES = ["price target", "target price", "target to $", "target of $", "raises target", "cuts target"]


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip_urls(text: Column | str) -> Column:
    return F.regexp_replace(_c(text), r"https?://\S+|www\.\S+", " ")


def strip_tags(text: Column | str) -> Column:
    return F.regexp_replace(_c(text), r"<[^>]+>", " ")


def drop_phrases(text: Column | str, phrases: list[str] = NEGATIVE_PHRASES) -> Column:
    quoted = "|".join(p.replace("$", r"\$").replace(".", r"\.") for p in phrases)
    return F.regexp_replace(_c(text), f"(?iu)(?:{quoted})", " ")


def cleaned(text: Column | str) -> Column:
    """URLs go before tags (so attribute text up to a blank goes with them), then phrases without a company."""
    return drop_phrases(strip_tags(strip_urls(text)))


def strip_suffix(name: Column | str) -> Column:
    """One corporate ending less."""
    quoted = "|".join(s.replace(".", r"\.") for s in SUFFIXES)
    return F.trim(F.regexp_replace(_c(name), rf",?\s+(?:{quoted})$", ""))


def has_word(text: Column | str, word: Column | str, fold: bool = True) -> Column:
    """Whether the literal occurs with no word character beside its ends."""
    flags = "(?iu)" if fold else ""
    edge = r"[\p{L}\p{N}_]"
    return F.rlike(_c(text), F.concat(F.lit(rf"{flags}(?<!{edge})\Q"), _c(word), F.lit(rf"\E(?!{edge})")))


def cashtag(text: Column | str, ticker: Column | str) -> Column:
    return F.rlike(_c(text), F.concat(F.lit(r"\$\Q"), _c(ticker), F.lit(r"\E(?![\p{L}\p{N}_])")))


def tokens(text: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(_c(text)), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once: inside a lambda a plain expression would be computed for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def shingles(text: Column | str, k: int = 3) -> Column:
    """Distinct k-word shingles; a shorter text is one."""

    def of(w: Column) -> Column:
        many = F.transform(F.sequence(F.lit(1), F.size(w) - k + 1), lambda i: F.array_join(F.slice(w, i, k), " "))
        return F.when(F.size(w) == 0, F.array().cast("array<string>")).when(F.size(w) <= k, F.array(F.array_join(w, " "))).otherwise(F.array_distinct(many))

    return let(tokens(text), of)


def ticker_list(text: Column | str) -> Column:
    """'a, b,,c' -> [A, B, C]"""
    return F.filter(F.transform(F.split(F.upper(_c(text)), ","), lambda x: F.trim(x)), lambda x: x != "")


def provider(source: Column | str) -> Column:
    return F.substring_index(_c(source), " (", 1)


def in_parentheses(source: Column | str) -> Column:
    return F.trim(F.regexp_extract(_c(source), r"\(([^)]*)\)", 1))


def full_text(title: Column | str, summary: Column | str) -> Column:
    return F.trim(F.concat_ws(" ", _c(title), F.coalesce(_c(summary), F.lit(""))))


def filing_type(title: Column | str) -> Column:
    """By fixed priority; '4' is contained in much."""
    t = _c(title)
    chain = F.when(t.contains("8-K"), "8-K")
    for kind in ("10-K", "10-Q", "Form 4", "4"):
        chain = chain.when(t.contains(kind), kind)
    return chain


def unfenced(text: Column | str) -> Column:
    """The body of a reply in a code fence."""
    return F.trim(F.regexp_replace(_c(text), r"^\s*```(?:json)?\s*|\s*```\s*$", ""))
