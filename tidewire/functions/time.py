"""Dates of feeds as Column expressions; the result is in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rfc2822(text: Column) -> Column:
    """'Mon, 02 Jan 2006 15:04:05 +0100' or with a zone name -> UTC. Spark parses no weekdays: they are cut first."""
    body = F.trim(F.regexp_replace(text, r"^[A-Za-z]{3},\s*", ""))
    body = F.regexp_replace(body, r"\s(?:GMT|UTC|UT|Z)$", " +0000")
    zoned = F.try_to_timestamp(body, F.lit("d MMM yyyy HH:mm:ss xx"))
    return F.coalesce(zoned, F.try_to_timestamp(body, F.lit("d MMM yyyy HH:mm:ss")))


def rfc2822_local(text: Column) -> Column:
    """The local part alone: the offset is dropped, not applied."""
    return F.try_to_timestamp(F.regexp_extract(text, r"(\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2})", 1), F.lit("d MMM yyyy HH:mm:ss"))


def iso8601(text: Column) -> Column:
    return text.try_cast("timestamp")


def compact(text: Column) -> Column:
    """'20240131T123000'"""
    return F.try_to_timestamp(text, F.lit("yyyyMMdd'T'HHmmss"))


def epoch(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds)


def first_of(*candidates: Column) -> Column:
    """The first date that parses."""
    return F.coalesce(*candidates)
