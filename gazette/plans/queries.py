
from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gazette.functions import scalars as X
from gazette.operators import calendar_export, listings, normalise, routing, search
from gazette.sources.adapters import feed
from gazette.sources.feeds import FeedCatalog
from gazette.sources.tables import Workspace, materialise, shared_folder

AS_OF, ORDERS_AS_OF = "2024-01-15", "1998-01-01"
CATEGORIES = ["click", "view", "purchase"]
LABELS = {"click": "Click", "view": "View", "purchase": "Purchase", "other": "Other"}
ROUTES = ["/", "/p/:id", "/item/:id", "/wiki/*", "/:section/:id", "/:section"]
#: Static pages of the search index: row_id, title, url, keywords.
PAGES = [
    (0, "Start page", "#/", "overview front"), (1, "What is on", "#/events", "programme dates agenda"), (2, "Groups near you", "#/meetings", "places weekdays hours"), (3, "Areas", "#/districts", "regions map"),
    (4, "Library", "#/resources", "files downloads"), (5, "Who does what", "#/officers", "people roles"), (6, "Working groups", "#/service", "volunteer tasks"), (7, "News", "#/news", "notices"),
    (8, "Money", "#/giving", "donate payment"), (9, "First visit", "#/new", "newcomer questions"), (10, "Write to us", "#/contact", "mail address"), (11, "Small print", "#/legal", "privacy imprint"),
]

Query = Callable[[SparkSession, str], DataFrame]


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalise.events(feed(spark, sf_dir, "events"))


def order_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as events of up to four days, by priority."""
    start = F.col("o_orderdate").cast("timestamp_ntz")
    end = (F.date_add(F.col("o_orderdate").cast("date"), (F.col("o_orderkey") % 4).cast("int"))).cast("timestamp_ntz")
    kind = F.lower(F.substring("o_orderpriority", 3, 40))
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("row_id"), F.concat(F.lit("o "), F.col("o_orderkey").cast("string")).alias("id"), F.col("o_orderpriority").alias("title"), start.alias("start"), end.alias("end"), kind.alias("category"))


def search_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = {n: getattr(normalise, n)(feed(spark, sf_dir, n)) for n in ("events", "officers", "committees", "districts", "resources", "meetings")}
    return search.build_search_index(of, spark.createDataFrame(PAGES, "row_id long, title string, url string, keywords string"))


def search_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queries of search_parts for the parts whose key is divisible by 20, against all rows."""
    return _search_parts(spark, sf_dir, F.col("p_partkey") % 20 == 0)


def search_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query for every part: the end of its name and its brand; a fifth has short tokens alone."""
    return _search_parts(spark, sf_dir, F.lit(True))


def _part_queries(spark: SparkSession, sf_dir: str, where: Column) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet").where(where)
    short = F.substring(F.concat(F.lit("k "), F.col("p_partkey").cast("string")), 1, 4)
    q = F.when(F.expr("p_partkey div 20 % 5 = 0"), short).otherwise(F.concat(F.substring(F.lower("p_name"), 3, 40), F.lit("  "), F.upper(F.col("p_brand"))))
    return part.select(F.col("p_partkey").alias("query_id"), q.alias("q"))


def _search_parts(spark: SparkSession, sf_dir: str, where: Column) -> DataFrame:
    """The rows are written once, as a search reads them twice; the result, at most search.TOP rows a query, stays."""
    with Workspace(spark, "feeds") as tables:
        return search.search(tables.write(search_index(spark, sf_dir), "index"), _part_queries(spark, sf_dir, where))


def search_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """search_batch against a kept index to which every third row is appended later, as two batches: the even and the odd keys."""
    with Workspace(spark, "kept") as tables:
        tables.paths["index"] = f"{shared_folder(spark)}/kept-index-{uuid.uuid4().hex}"
        rows = tables.write(search_index(spark, sf_dir), "rows")
        index = search.SearchIndex.build(rows.where("item_pos % 3 <> 0"), tables.paths["index"])
        index.append(rows.where("item_pos % 3 = 0"))
        asked = _part_queries(spark, sf_dir, F.col("p_partkey") % 20 == 0)
        batches = [index.search(asked.where(F.col("query_id") % 40 == k)) for k in (0, 20)]
        return batches[0].unionByName(batches[1])


def search_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    index = docs.select(F.lit("document").alias("type"), F.lit("").alias("title"), F.lit("").alias("url"), F.lower("text").alias("search_text"), F.lit(0).cast("long").alias("type_pos"), F.col("doc_id").alias("item_pos"))
    asked = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.concat(F.substring("text", 12, 7), F.when(F.col("item_id") % 2 == 0, "\xa0").otherwise(" "), F.substring("text", 31, 6)).alias("q"))
    return search.search(index, asked)


def parse_datetime(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates and clocks as text in the forms that feeds use, rollovers and junk among them."""
    k = F.col("o_orderkey")
    date = F.when(k % 7 == 0, F.concat(F.year("o_orderdate").cast("string"), F.lit("-13-31"))).when(k % 7 == 1, F.concat(F.lit("98-02-"), (k % 40).cast("string"))).when(k % 7 == 2, "TBA").otherwise(F.col("o_orderdate").cast("date").cast("string"))
    clock = F.when(k % 5 == 0, F.concat((k % 14).cast("string"), F.lit(":30 p.m."))).when(k % 5 == 1, F.concat((k % 30).cast("string"), F.lit(":75"))).when(k % 5 == 2, "noon").when(k % 5 == 3, F.concat((k % 13).cast("string"), F.lit("AM"))).otherwise(F.lpad((k % 24).cast("string"), 2, "0"))
    clock = F.when(k % 11 == 0, F.concat((k % 13).cast("string"), F.lit(":05"), F.when(k % 2 == 0, "\xa0").otherwise("\u202f"), F.lit("pm"))).otherwise(clock)
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(k.alias("row_id"), date.alias("d"), clock.alias("t"))
    return rows.select("row_id", X.parse_datetime(F.col("d"), F.col("t")).alias("at"), X.lenient_clock(F.col("t")).cast("long").alias("lenient"))


def text_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each text; every third name and every other number with white space beyond ASCII."""
    t = F.col("text")
    name = F.replace(t, F.lit("\n"), F.lit(" "))
    name = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("\t\u3000"), F.replace(name, F.lit(" "), F.lit("\xa0")))).otherwise(name)
    number = F.concat(F.when(F.col("doc_id") % 2 == 0, "\u202f \xa0").otherwise(""), (F.col("doc_id") % 90).cast("string"), t)
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", X.truncate(t).alias("teaser"), X.initials(name).alias("initials"), X.file_stem(t).alias("stem"), F.size(X.tags(t)).cast("long").alias("n_tags"), F.md5(X.calendar_text(t).cast("binary")).alias("plain_md5"), X.int_prefix(number).cast("long").alias("number"))


def date_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = order_events(spark, sf_dir)
    tile = X.date_tile(F.col("start"))
    return e.select("row_id", X.long_date(F.col("start")).alias("long_date"), X.short_date(F.col("start")).alias("short_date"), X.time_range(F.col("start"), F.col("end")).alias("times"), tile["tile_month"].alias("tile_month"), X.calendar_stamp(F.col("start"), "UTC").alias("stamp"))


def route_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages' URLs; every third one's path with a plus and codes, and a query with codes, pluses and a repeated key."""
    host = F.regexp_extract("url", "^[a-z]+://[^/]+", 0)
    odd = F.concat(host, F.lit("/p/x+y%20"), F.col("page_id").cast("string"), F.lit("?a%20b=1+2&x=%C3%A9&x=2&=z&flag&+="))
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.when(F.col("page_id") % 3 == 0, odd).otherwise(F.col("url")).alias("url"))
    routed = routing.route_urls(pages, "url", ROUTES)
    asked = F.array_join(F.array_sort(F.transform(F.map_entries("query"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), "&")
    return routed.select("page_id", "path", F.coalesce("route", F.lit("not-found")).alias("route"), F.coalesce(F.col("params")["id"], F.lit("")).alias("param_id"), F.size("query").cast("long").alias("n_query"), asked.alias("asked"))


def _csv_files(rows: DataFrame, order: str, folder: str) -> None:
    """rows without order as CSV in five folders of different sizes, whose files are in that order by name."""
    low, high = rows.agg(F.min(order), F.max(order)).first()
    cuts = [low, *(low + (high - low) * share // 100 for share in (1, 5, 30, 90)), (high or 0) + 1] if high is not None else []
    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        part = rows.where((F.col(order) >= a) & (F.col(order) < b)).orderBy(order).drop(order)
        part.write.csv(f"{folder}/{k}", header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def _csv_read(spark: SparkSession, rows: DataFrame, name: str, then: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What then makes of rows written as CSV in the order of row_id and read back by their name."""
    with Workspace(spark, "csv") as tables:
        tables.paths["feed"] = path = f"{shared_folder(spark)}/csv-feed-{uuid.uuid4().hex}"
        _csv_files(rows, "row_id", path)
        return materialise(then(FeedCatalog({name: f"{path}/*/"}).read(spark, name)), "csv-rows")


def csv_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The meetings feed written as CSV files of different sizes and read back by its name (S1, S2), with row_id over all files."""
    kept = ("row_id", "name", "day", "time", "address", "city", "district")
    return _csv_read(spark, feed(spark, sf_dir, "meetings"), "meetings", lambda raw: normalise.meetings(raw).select(*kept, F.array_join("types", "|").alias("types"), "notes"))


def csv_feed_messy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers with capitals, inner and outer spaces, one of them twice; values with quotes, separators, line ends and no-break spaces; blank rows."""
    key = F.col("p_partkey")
    blank = key % 17 == 0
    cell = lambda c: F.when(blank, F.lit("  ")).otherwise(c)
    text = F.concat(F.lit('a "quoted" '), F.col("p_name"), F.lit(',\n"'), F.col("p_brand"), F.lit('"\n\n; end'))
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select(key.alias("row_id"), cell(F.concat(F.lit("\xa0 "), F.col("p_name"), F.lit("\t\u202f"))).alias(" Part  Name "), cell(F.when(key % 5 == 0, F.col("p_type")).otherwise(text)).alias("DESCRIPTION"), cell(key.cast("string")).alias("Part\xa0Key"), cell(F.when(key % 3 == 0, '""').otherwise("x,y")).alias("description "))
    return _csv_read(spark, rows, "parts", lambda raw: raw.select("row_id", "part_name", "description", F.col("part_key").cast("long").alias("part_key"), "description_1"))


def feed_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feeds of a catalogue with files and without, and how many rows and columns each is read with (S3)."""
    catalog = FeedCatalog({"meetings": f"{sf_dir}/part.parquet", "events": f"{sf_dir}/no-such-feed.csv", "resources": f"{sf_dir}/no-such-feed.parquet"}, on_missing="empty")
    states = [(name, catalog.read(spark, name)) for name in sorted(catalog.paths)]
    counted = [df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("feed"), "n_rows", F.lit(len(df.columns)).cast("long").alias("n_columns")) for name, df in states]
    return counted[0].unionByName(counted[1]).unionByName(counted[2])


def no_match_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings with a query that finds something and with one that finds nothing."""
    e, m, r = (getattr(normalise, n)(feed(spark, sf_dir, n)) for n in ("events", "meetings", "resources"))
    found = {"events": listings.event_listing(e, AS_OF, CATEGORIES, "hall"), "meetings": listings.meeting_finder(m, q="oak"), "resources": listings.resource_browser(r, q="page")}
    none = {"events_none": listings.event_listing(e, AS_OF, CATEGORIES, "no such hall"), "events_no_category": listings.event_listing(e, AS_OF, []), "meetings_none": listings.meeting_finder(m, city="Nowhere"), "resources_none": listings.resource_browser(r, "Cat 99")}
    return listings.no_match(**found, **none)


def dismissed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The top announcement unless its id is among the dismissed ones: those of urgent orders that are fulfilled."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderpriority = '1-URGENT' and o_orderstatus = 'F'")
    found = normalise.announcements(feed(spark, sf_dir, "announcements"))
    return listings.active_announcement(found, ORDERS_AS_OF, orders.select(F.concat(F.lit("an-"), F.col("o_orderkey").cast("string")).alias("id")))


def dismissals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows the banner shows, and which: with nothing dismissed, with all but the top one dismissed, with the top one dismissed."""
    found = normalise.announcements(feed(spark, sf_dir, "announcements"))
    top = listings.active_announcement(found, ORDERS_AS_OF).select("id")
    cases = {"nothing": found.select("id").limit(0), "others": found.select("id").join(top, "id", "left_anti"), "top": top}
    shown = [listings.active_announcement(found, ORDERS_AS_OF, ids).agg(F.count("*").alias("n"), F.max("id").alias("id")).select(F.lit(case).alias("dismissed"), "n", "id") for case, ids in cases.items()]
    return shown[0].unionByName(shown[1]).unionByName(shown[2])


def export_calendar_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as events of a zone with daylight saving."""
    events = order_events(spark, sf_dir).withColumns({c: F.lit("") for c in ("location", "address", "description")})
    return calendar_export.export_calendar(events, "1997-09-01", "America/New_York")


def _of(name: str, then: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: then(getattr(normalise, name)(feed(spark, sf_dir, name)))


QUERIES: dict[str, Query] = {
    "event_listing": lambda s, d: listings.event_listing(events(s, d), AS_OF, CATEGORIES, pairs=LABELS),
    "event_listing_search": lambda s, d: listings.event_listing(events(s, d), AS_OF, [*CATEGORIES, "other"], " hall 1", pairs=LABELS),
    "home_summary": lambda s, d: listings.home_summary(events(s, d), normalise.committees(feed(s, d, "committees")), normalise.districts(feed(s, d, "districts")), AS_OF),
    "calendar_items": lambda s, d: listings.calendar_items(order_events(s, d), ["urgent", "high"]),
    "calendar_days": lambda s, d: listings.calendar_days(listings.calendar_items(order_events(s, d), ["urgent", "high"]), "1995-01-01", "1996-12-31"),
    "event_detail": lambda s, d: listings.event_detail(events(s, d), "ev-100", pairs=LABELS),
    "export_calendar": lambda s, d: calendar_export.export_calendar(events(s, d), AS_OF),
    "event_documents": lambda s, d: calendar_export.single_calendars(events(s, d)),
    "meeting_finder_city": _of("meetings", lambda m: listings.meeting_finder(m, city="Brand#13")),
    "resource_browser_filtered": _of("resources", lambda r: listings.resource_browser(r, "Cat 3", "EX")),
    "announcement_dismissed": dismissed,
    "announcement_dismissals": dismissals,
    "csv_feed": csv_feed,
    "csv_feed_messy": csv_feed_messy,
    "feed_states": feed_states,
    "no_match_states": no_match_states,
    "export_calendar_zone": export_calendar_zone,
    "facet_options": _of("resources", lambda r: listings.facet_options(r, "category")),
    "meeting_finder": _of("meetings", listings.meeting_finder),
    "meeting_finder_filtered": _of("meetings", lambda m: listings.meeting_finder(m, "Tuesday", "", " OAK ave")),
    "facet_values": _of("meetings", lambda m: listings.facet_values(m, "city")),
    "resource_browser": _of("resources", listings.resource_browser),
    "roster": _of("officers", listings.roster),
    "district_directory": _of("districts", listings.district_directory),
    "committee_directory": _of("committees", listings.committee_directory),
    "active_announcements": _of("announcements", lambda a: listings.active_announcements(a, ORDERS_AS_OF).select("row_id", "id", "starts", "ends", F.col("priority").cast("long").alias("priority"))),
    "active_announcement_top": _of("announcements", lambda a: listings.active_announcement(a, ORDERS_AS_OF)),
    "search_index": search_index,
    "search_batch": search_batch,
    "search_parts": search_parts,
    "search_appended": search_appended,
    "search_documents": search_documents,
    "parse_datetime": parse_datetime,
    "text_scalars": text_scalars,
    "date_formats": date_formats,
    "route_urls": route_urls,
}
