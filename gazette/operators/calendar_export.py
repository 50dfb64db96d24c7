"""Calendar documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazette.functions import scalars as X
from gazette.operators.listings import midnight

HEAD = ("BEGIN:VCALENDAR", "VERSION:2.0")


def vevent(zone: str, uid_domain: str, dtstamp: str) -> Column:
    end = F.coalesce("end", F.col("start") + F.expr("interval 1 hour"))
    place = F.concat(X.calendar_text(F.col("location")), F.when(X.present(F.col("address")), F.concat(F.lit("  "), X.calendar_text(F.col("address")))).otherwise(""))
    line = lambda name, value: F.concat(F.lit(name + ":"), value)
    return F.concat_ws(
        "\r\n", F.lit("BEGIN:VEVENT"), line("UID", F.concat("id", F.lit("@" + uid_domain))), F.lit("DTSTAMP:" + dtstamp), line("DTSTART", X.calendar_stamp(F.col("start"), zone)), line("DTEND", X.calendar_stamp(end, zone)),
        line("SUMMARY", X.calendar_text(F.col("title"))), F.when(X.present(F.col("location")), line("LOCATION", place)), F.when(X.present(F.col("description")), line("DESCRIPTION", X.calendar_text(F.col("description")))), F.lit("END:VEVENT"),
    )


def export_calendar(events: DataFrame, as_of: str, zone: str = "UTC", dtstamp: str = "20240101T000000Z", uid_domain: str = "example.org") -> DataFrame:
    """One VEVENT per upcoming event, whatever the listing's filters; write_calendar() makes the document."""
    return events.where(F.col("start") >= midnight(as_of)).select("row_id", "start", vevent(zone, uid_domain, dtstamp).alias("vevent"))


def single_calendars(events: DataFrame, product: str = "-//gazette//EN", zone: str = "UTC", dtstamp: str = "20240101T000000Z", uid_domain: str = "example.org") -> DataFrame:
    """One whole document per event."""
    head = [F.lit(x) for x in (*HEAD, f"PRODID:{product}")]
    return events.select("row_id", "id", F.concat_ws("\r\n", *head, vevent(zone, uid_domain, dtstamp), F.lit("END:VCALENDAR")).alias("document"))


def write_calendar(vevents: DataFrame, path: str, product: str = "-//gazette//EN", name: str = "Events") -> None:
    """Text parts in start order with the document's head first and its foot last."""
    spark = vevents.sparkSession
    around = spark.createDataFrame([(0, "\r\n".join((*HEAD, f"PRODID:{product}", f"X-WR-CALNAME:{name}"))), (2, "END:VCALENDAR")], "part int, vevent string")
    rows = vevents.withColumn("part", F.lit(1)).unionByName(around, allowMissingColumns=True)
    rows.orderBy("part", "start", "row_id").select("vevent").write.option("lineSep", "\r\n").text(path)
