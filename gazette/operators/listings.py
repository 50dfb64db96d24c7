"""Listings, sections and facets over normalised feeds.

Sections without a bound carry their order keys instead of a position, so that no single task
has to number them; top-k sections carry pos.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gazette.functions import scalars as X
from gazette.sources.tables import join_counted, materialise

# Labels and orders of the closed sets.
CATEGORY_LABELS = {"assembly": "Assembly", "workshop": "Workshop", "committee": "Committee", "convention": "Convention", "other": "Other"}
DAYS = ("Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday")
ROSTER_SECTIONS = ("officer", "chair", "dcm")
PAST, HOME = 6, 4


def midnight(as_of: str) -> Column:
    return F.lit(as_of).cast("date").cast("timestamp_ntz")


def labels(spark: SparkSession, pairs: dict[str, str]) -> DataFrame:  # S4
    return spark.createDataFrame(list(pairs.items()), "category string, label string")


def with_label(df: DataFrame, pairs: dict[str, str]) -> DataFrame:
    """The label of a category, or that of other; the dimension has a row per entry of pairs."""
    dim = F.broadcast(labels(df.sparkSession, pairs))
    return df.join(dim, "category", "left").withColumn("label", F.coalesce("label", F.lit(pairs.get("other", "Other"))))


def chosen(c: Column, values: list[str]) -> Column:
    """an empty selection takes nothing."""
    return c.isin(*values) if values else F.lit(False)


def containing(text: Column, q: str) -> Column:
    """F8: case-insensitive substring, no wildcards."""
    return F.contains(text, F.lit(q.lower())) if q else F.lit(True)


def event_listing(events: DataFrame, as_of: str, categories: list[str], q: str = "", pairs: dict[str, str] = CATEGORY_LABELS, past: int = PAST) -> DataFrame:  # C1
    text = X.search_text(F.col("title"), F.col("location"), F.col("description"))
    found = events.where(chosen(F.col("category"), categories) & containing(text, q.strip(X.SPACES)))
    upcoming = found.where(F.col("start") >= midnight(as_of)).withColumns({"section": F.lit("upcoming"), "pos": F.lit(None).cast("long")})
    latest = found.where(F.col("start") < midnight(as_of)).orderBy(F.desc("start"), F.desc("row_id")).limit(past)
    place = F.row_number().over(Window.orderBy(F.desc("start"), F.desc("row_id"))).cast("long")
    rows = upcoming.unionByName(latest.withColumns({"section": F.lit("past"), "pos": place}))
    tile = {k: v.cast("long") if k != "tile_month" else v for k, v in X.date_tile(F.col("start")).items()}
    return with_label(rows, pairs).select(
        "section", "pos", "row_id", "id", "title", "category", "label", "start", "location", X.present(F.col("district")).alias("has_district"), "featured",
        X.truncate(F.col("description")).alias("teaser"), X.time_range(F.col("start"), F.col("end")).alias("times"), *[v.alias(k) for k, v in tile.items()],
    )


def calendar_items(events: DataFrame, categories: list[str]) -> DataFrame:  # C2, P8
    link = F.concat(F.lit("#/events/"), X.percent_encode(F.col("id")))
    return events.where(chosen(F.col("category"), categories)).select("row_id", "id", "title", "start", "end", F.concat(F.lit("cat-"), "category").alias("class"), link.alias("url"))


def calendar_days(items: DataFrame, first: str, last: str) -> DataFrame:  # C3
    """Rows per covered day from first to last, with how many items cover it.

    An item is two rows whatever its length: one more from its first day on, one less after its last. The changes are
    summed by day, then by prefix sums within years that start from the sums of the years before; a
    day without a change is as the one before.
    """
    until = F.when(F.col("end") > F.col("start"), F.col("end") - F.expr("interval 1 microsecond")).otherwise(F.col("start"))
    low, high = F.greatest(F.to_date("start"), F.lit(first).cast("date")), F.least(F.to_date(until), F.lit(last).cast("date"))
    borders = items.select(low.alias("low"), high.alias("high")).where("low <= high")
    borders = borders.select(F.inline(F.array(F.struct(F.col("low").alias("day"), F.lit(1).alias("change")), F.struct(F.date_add("high", 1).alias("day"), F.lit(-1).alias("change")))))
    changes = borders.groupBy("day").agg(F.sum("change").alias("change")).withColumn("year", F.year("day"))
    years = changes.groupBy("year").agg(F.sum("change").alias("change"), F.min("day").alias("begins"))
    by_year = Window.orderBy("year")  # a row per year
    years = years.select("year", (F.sum("change").over(by_year) - F.col("change")).alias("base"), F.lead("begins").over(by_year).alias("next_begins"))
    within = Window.partitionBy("year").orderBy("day")
    known = changes.join(years, "year").select("day", (F.col("base") + F.sum("change").over(within)).alias("n_items"), F.coalesce(F.lead("day").over(within), "next_begins").alias("until"))
    return known.where("n_items > 0").select(F.explode(F.sequence("day", F.date_sub("until", 1))).alias("day"), "n_items")


def event_detail(events: DataFrame, event_id: str, map_base: str = "https://maps.example.org/?q=", pairs: dict[str, str] = CATEGORY_LABELS) -> DataFrame:  # C4
    """The first event with the id, in start order; no row if there is none."""
    one = with_label(events.where(F.col("id") == event_id).orderBy("start", "row_id").limit(1), pairs)
    return one.select("row_id", "id", "title", "label", X.long_date(F.col("start")).alias("date_text"), X.time_range(F.col("start"), F.col("end")).alias("times"), X.map_link(F.col("address"), map_base).alias("map_url"), X.contact_link(F.col("contact")).alias("contact_url"), X.file_stem(F.col("title")).alias("file_stem"))


def meeting_finder(meetings: DataFrame, day: str = "", city: str = "", q: str = "") -> DataFrame:  # C6
    text = X.search_text(F.col("name"), F.array_join("types", " "), F.col("notes"), F.col("address"))
    found = meetings.where(containing(text, q.strip(X.SPACES)))
    for column, value in (("day", day), ("city", city)):
        found = found.where(F.col(column) == value) if value else found
    order = F.array_position(F.array(*map(F.lit, DAYS)), F.col("day"))
    out = found.select(order.alias("section_pos"), "day", X.lenient_clock(F.col("time")).cast("long").alias("minutes"), "row_id", "name", "time", "city", "address", F.array_join("types", "|").alias("types"))
    return out.where("section_pos > 0")


def facet_values(df: DataFrame, column: str) -> DataFrame:  # C7, A4
    return df.select(F.col(column).alias("value")).where("value <> ''").distinct()


def facet_options(df: DataFrame, column: str, every: str = "All") -> DataFrame:  # C7, A4
    """The choices of a facet that begins with one for every row: pos and value, in whose order they stand."""
    first = df.sparkSession.createDataFrame([(0, every)], "pos long, value string")
    return first.unionByName(facet_values(df, column).select(F.lit(1).cast("long").alias("pos"), "value"))


def no_match(**listings: DataFrame) -> DataFrame:  # A6
    """listing and empty: which of them show their state for no rows; of each at most one row is looked for."""
    states = [df.limit(1).agg((F.count("*") == 0).alias("empty")).select(F.lit(name).alias("listing"), "empty") for name, df in listings.items()]
    return reduce(DataFrame.unionByName, states)


def resource_browser(resources: DataFrame, category: str = "All", q: str = "") -> DataFrame:  # C8
    """Rows with their section's order. The sections are counted and written once, so that the rows of a category that most have stay where they are."""
    found = resources.where(containing(X.search_text(F.col("title"), F.col("description")), q))
    found = found if category == "All" else found.where(F.col("category") == category)
    sections = materialise(found.groupBy("category").agg(F.min("row_id").alias("section_order"), F.count("*").alias("n")), "sections")
    return join_counted(found, sections, ["category"], "n").select("section_order", "category", "row_id", "title", "url", X.url_kind(F.col("url")).alias("kind"), "updated")


def roster(officers: DataFrame, vacant: str = "Open position") -> DataFrame:  # C9
    section = F.when(F.col("type").isin(*ROSTER_SECTIONS), F.col("type")).otherwise(ROSTER_SECTIONS[0])
    place = F.array_position(F.array(*map(F.lit, ROSTER_SECTIONS)), section)
    return officers.select(place.alias("section_pos"), section.alias("section"), F.col("sort").cast("long").alias("sort"), "row_id", X.default(F.col("name"), vacant).alias("name"), X.initials(F.col("name")).alias("initials"), "position", X.contact_link(F.col("email")).alias("contact_url"))


def district_directory(districts: DataFrame) -> DataFrame:  # C10, O3
    return districts.select(X.int_prefix(F.col("number")).cast("long").alias("order_number"), "row_id", "number", "name", "area", X.contact_link(F.col("email")).alias("contact_url"))


def committee_directory(committees: DataFrame) -> DataFrame:  # C10
    return committees.select("row_id", "name", "purpose", "chair", "meeting_schedule", "icon", X.contact_link(F.col("email")).alias("contact_url"))


def active_announcements(announcements: DataFrame, as_of: str) -> DataFrame:  # F4
    today = midnight(as_of)
    open_or = lambda c, test: F.col(c).isNull() | test
    return announcements.where(open_or("starts", F.col("starts") <= today) & open_or("ends", F.col("ends") >= today))


def active_announcement(announcements: DataFrame, as_of: str, dismissed: DataFrame | None = None) -> DataFrame:  # C11
    """The first active one, or nothing if that one is dismissed."""
    top = active_announcements(announcements, as_of).orderBy(F.asc_nulls_last("priority"), "row_id").limit(1)
    top = top if dismissed is None else top.join(dismissed.select("id"), "id", "left_anti")
    return top.select("row_id", "id", "title", "body", X.announcement_link(F.col("url")).alias("link"), F.col("priority").cast("long").alias("priority"))


def home_summary(events: DataFrame, committees: DataFrame, districts: DataFrame, as_of: str, k: int = HOME) -> DataFrame:  # C12
    """kind, pos, name: two counts, the next k events, the first k committees."""
    upcoming = events.where(F.col("start") >= midnight(as_of))
    count = lambda df, kind: df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), F.col("n").alias("pos"), F.lit("").alias("name"))

    def first(df: DataFrame, kind: str, name: str, *order: str) -> DataFrame:
        return df.orderBy(*order).limit(k).select(F.lit(kind).alias("kind"), F.row_number().over(Window.orderBy(*order)).cast("long").alias("pos"), F.col(name).alias("name"))

    parts = [count(districts, "districts"), count(upcoming, "upcoming"), first(upcoming, "event", "title", "start", "row_id"), first(committees, "committee", "name", "row_id")]
    return reduce(DataFrame.unionByName, parts)
