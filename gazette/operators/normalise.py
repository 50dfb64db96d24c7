"""Typed rows from string feeds. Every output keeps row_id, the order of a file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazette.functions import scalars as X


def _texts(df: DataFrame, *names: str):
    return [X.default(X.field(df, n)).alias(n) for n in names]


def events(raw: DataFrame) -> DataFrame:  # P1, F1
    f = lambda n: X.field(raw, n)
    # The end comes in steps of its own, so that filters on the start go below them.
    dated = X.with_datetimes(raw, _start=(f("start_date"), f("start_time"))).where("_start is not null")
    dated = X.with_datetimes(dated, _end=(X.default(f("end_date"), f("start_date")), X.default(f("end_time"), f("start_time"))))
    return dated.select(
        "row_id", X.default(f("id"), X.slug_id(f("start_date"), f("title"))).alias("id"), X.default(f("title"), "(Untitled event)").alias("title"),
        F.lower(X.default(f("category"), "other")).alias("category"), F.col("_start").alias("start"), F.col("_end").alias("end"),
        X.default(f("end_date"), X.default(f("start_date"))).alias("end_date"), *_texts(raw, "start_date", "start_time", "end_time", "location", "address", "district", "url", "flyer_url", "description", "contact"),
        X.flag(f("featured")).alias("featured"),
    )


def officers(raw: DataFrame) -> DataFrame:  # P2
    f = lambda n: X.field(raw, n)
    return raw.select("row_id", F.lower(X.default(f("type"), "officer")).alias("type"), X.int_prefix(X.default(f("sort"), "99")).alias("sort"), *_texts(raw, "name", "position", "district", "email", "bio"))


def committees(raw: DataFrame, icon: str = "people") -> DataFrame:  # P3
    return raw.select("row_id", *_texts(raw, "name", "purpose", "chair", "email", "meeting_schedule"), X.default(X.field(raw, "icon"), icon).alias("icon"))


def districts(raw: DataFrame) -> DataFrame:  # P4
    number = X.default(X.field(raw, "number"), X.default(X.field(raw, "district")))
    return raw.select("row_id", number.alias("number"), *_texts(raw, "name", "area", "dcm", "email", "website", "meeting_info"))


def resources(raw: DataFrame) -> DataFrame:  # P5
    f = lambda n: X.field(raw, n)
    return raw.select("row_id", X.default(f("category"), "General").alias("category"), X.default(f("url"), "#").alias("url"), *_texts(raw, "title", "description", "updated"))


def announcements(raw: DataFrame) -> DataFrame:  # P6
    f = lambda n: X.field(raw, n)
    dated = X.with_datetimes(raw, _starts=(f("starts"), None), _ends=(f("ends"), None))
    return dated.select("row_id", X.default(f("id"), X.default(f("title"))).alias("id"), *_texts(raw, "title", "body", "url"), F.col("_starts").alias("starts"), F.col("_ends").alias("ends"), X.int_prefix(X.default(f("priority"), "5")).alias("priority"))


def meetings(raw: DataFrame) -> DataFrame:  # P7
    return raw.select("row_id", *_texts(raw, "name", "day", "time", "address", "city", "district", "notes"), X.tags(X.field(raw, "types")).alias("types"))
