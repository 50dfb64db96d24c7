import datetime as dt
import re
import time
from pathlib import Path

import duckdb
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

import __spark_entry__
from gazette.functions import scalars as X
from gazette.operators import calendar_export, listings, normalise, routing, search
from gazette.plans.oracle import ORACLE_SQL
from gazette.plans.queries import QUERIES
from gazette.sources import tables
from gazette.sources.feeds import FeedCatalog, read_csv
from gazette.streaming.listings import follow

SF = "/root/testdata/sf0.001"


def values(spark, inputs, expression):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r[0] for r in rows.orderBy("i").select(expression(F.col("x"))).collect()]


def test_dates_roll_over_and_junk_is_null(spark):
    got = values(spark, ["2026-06-07", "2026-02-30", "2026-13-01", "26-06-07", "2026-06-07 09:00", "2026-06", "2026-00-10", "TBA", "", None], X.parse_date)
    assert got == [dt.date(2026, 6, 7), dt.date(2026, 3, 2), dt.date(2027, 1, 1), dt.date(1926, 6, 7), None, None, None, None, None, None]


def test_dates_end_with_the_last_day(spark):
    got = values(spark, ["2026-1201-1", "2026-1-40000", "275760-09-13", "275760-09-14", "99999999-1-1", "2026-99999999-1"], lambda c: X.parse_date(c).cast("string"))
    assert got == ["2126-01-01", "2135-07-08", "+275760-09-13", None, None, None]


def test_both_clocks(spark):
    assert values(spark, ["9:00 AM", "12:30 am", "12 PM", "09:00", "7pm", "7:00 p.m.", "noon", "7:00 PM PST", ""], X.parse_clock) == [540, 30, 720, 540, 1140, 1140, 0, 0, 0]
    assert values(spark, ["8:00 AM", "12:00 AM", "12:00 PM", "1930", "7:30 p.m.", "tba", ""], X.lenient_clock) == [480, 0, 720, 1170, 450, 9999, 9999]


def test_scalars(spark):
    assert values(spark, ["YES", "y", "1", "True", "no", "yep", "", None], X.flag) == [True] * 4 + [False] * 4
    assert values(spark, ["Open| Speaker,,X ", None], X.tags) == [["Open", "Speaker", "X"], []]
    assert values(spark, ["10a", " 7", "x"], X.int_prefix) == [10, 7, None]
    assert values(spark, ["Ann B. Cole", "cher", ""], X.initials) == ["AB", "C", "??"]
    assert values(spark, ["a b/c~*!()"], X.percent_encode) == ["a%20b%2Fc~*!()"]
    assert values(spark, ["A.PDF", "a.pdf?x=1", "b.docx", ""], X.url_kind) == ["pdf", "link", "word", "link"]
    assert values(spark, ["x" * 161], X.truncate) == ["x" * 159 + "…"]
    assert values(spark, ["2026-06-07 09:00:00"], lambda c: X.calendar_stamp(c.cast("timestamp_ntz"), "America/Phoenix")) == ["20260607T160000Z"]


def test_messy_csv(spark, tmp_path):
    path = tmp_path / "events.csv"
    path.write_text('id, Start Date ,title\n1,2026-06-07," a, ""b""\nc "\n\n,  ,\n2\n3,x,y,z\n')
    rows = read_csv(spark, str(path)).orderBy("row_id").collect()
    assert rows[0].asDict() | {"row_id": 0} == {"id": "1", "start_date": "2026-06-07", "title": 'a, "b"\nc', "row_id": 0}
    assert [r.id for r in rows] == ["1", "2", "3"]
    catalog = FeedCatalog({"events": str(path), "meetings": str(tmp_path / "none.csv")}, on_missing="empty")
    assert catalog.read(spark, "meetings").isEmpty()
    with pytest.raises(ValueError):
        catalog.read(spark, "other")


def test_search_is_substring_and(spark):
    index = spark.createDataFrame([("t", "a", "", "xaby cdz 50% off", 0, 1), ("t", "b", "", "the 500 off", 0, 2)], "type string, title string, url string, search_text string, type_pos long, item_pos long")
    queries = spark.createDataFrame([(1, "ab cd"), (2, "the THE"), (3, ""), (4, "50%"), (5, "off"), (6, "q"), (7, None)], "query_id long, q string")
    for how in (search.search, search.scan_search):
        assert sorted((r.query_id, r.title) for r in how(index, queries).collect()) == [(1, "a"), (2, "b"), (4, "a"), (5, "a"), (5, "b")]


def test_short_tokens_without_a_scan(spark):
    texts = ["k 12 a", "ka k1", "1k 2", "", "😀k 12", "k  b", *[f"row {i} k{i}" for i in range(50)]]
    index = spark.createDataFrame([("t", str(i), "", t, i % 3, i) for i, t in enumerate(texts)], "type string, title string, url string, search_text string, type_pos long, item_pos long")
    asked = ["k 12", "12 k k", "K", "2 k", "😀", "zz k", "z", "a 1", "row 1", "ro w", "1"]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, q string")
    found, scanned = (how(index, queries) for how in (search.search, search.scan_search))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, scanned.collect()))


def test_window_and_dismissal(spark):
    raw = spark.createDataFrame([(1, "a", "2026-01-05", "soon", "2"), (2, "b", "", "2026-01-05", "1"), (3, "c", "2026-01-06", "", "0")], "row_id long, id string, starts string, ends string, priority string")
    found = normalise.announcements(raw)
    assert [r.id for r in listings.active_announcement(found, "2026-01-05").collect()] == ["b"]
    assert listings.active_announcement(found, "2026-01-05", spark.createDataFrame([("b",)], "id string")).isEmpty()


def test_calendar_document(spark, tmp_path):
    rows = [(2, "b", dt.datetime(2026, 2, 1, 9), None, "Later; on", "", "", ""), (1, "a", dt.datetime(2026, 1, 1, 9), dt.datetime(2026, 1, 1, 10), "First", "Hall", "1 Main St", "x")]
    events = spark.createDataFrame(rows, "row_id long, id string, start timestamp_ntz, end timestamp_ntz, title string, location string, address string, description string")
    calendar_export.write_calendar(calendar_export.export_calendar(events, "2026-01-01"), str(tmp_path / "out"), name="All")
    text = "".join(p.read_bytes().decode() for p in sorted((tmp_path / "out").glob("part-*")))
    assert text.split("\r\n") == [
        "BEGIN:VCALENDAR", "VERSION:2.0", "PRODID:-//gazette//EN", "X-WR-CALNAME:All",
        "BEGIN:VEVENT", "UID:a@example.org", "DTSTAMP:20240101T000000Z", "DTSTART:20260101T090000Z", "DTEND:20260101T100000Z", "SUMMARY:First", "LOCATION:Hall  1 Main St", "DESCRIPTION:x", "END:VEVENT",
        "BEGIN:VEVENT", "UID:b@example.org", "DTSTAMP:20240101T000000Z", "DTSTART:20260201T090000Z", "DTEND:20260201T100000Z", "SUMMARY:Later  on", "END:VEVENT", "END:VCALENDAR", "",
    ]


def test_facets(spark):
    rows = spark.createDataFrame([(i, c, "t", "u", "d", "") for i, c in enumerate(["A", "B", "A"])], "row_id long, category string, title string, url string, description string, updated string")
    assert {r.row_id for r in listings.resource_browser(rows, "A").collect()} == {0, 2} and listings.resource_browser(rows).count() == 3
    assert listings.calendar_items(spark.createDataFrame([], "row_id long, id string, title string, start timestamp_ntz, end timestamp_ntz, category string"), []).isEmpty()


def test_counted_joins(spark):
    rows = spark.createDataFrame([(k, i) for i, k in enumerate(["hot"] * 500 + [f"k{j % 40}" for j in range(200)] + [None])], "key string, i int")
    table = rows.where("key <> 'k3'").groupBy("key").agg(F.count("*").alias("n"), F.max("i").alias("most")).where("key is not null")
    for how in ("inner", "left", "left_semi"):
        for keys in (4096, 2):
            tables.HOT_KEYS, kept = keys, tables.HOT_KEYS
            got = tables.join_counted(rows, table, ["key"], "n", how)
            want = rows.join(table.drop("n"), ["key"], how)
            assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
            tables.HOT_KEYS = kept
    assert tables.join_counted(rows, table.limit(0), ["key"], "n", "left").count() == 701


def test_workspaces_leave_nothing(spark):
    with tables.Workspace(spark, "left") as w:
        first = w.write(spark.range(3), "a")
        assert w.write(first.where("id > 0"), "a").count() == 2
        path = w.paths["a"]
    with pytest.raises(AnalysisException):
        spark.read.parquet(path)
    assert tables.fresh(first, "id", "ID", "x") == ["id_", "ID__", "x"]


def test_follow_a_folder(spark, tmp_path):
    schema = "row_id long, name string, purpose string"
    rows = spark.createDataFrame([(1, "a", None), (2, "", "p")], schema)
    for k in range(2):
        rows.write.mode("append").parquet(str(tmp_path / "in"))
        follow(spark, str(tmp_path / "in"), schema, normalise.committees, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
        assert sorted((r.row_id, r.name, r.purpose) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == sorted([(1, "a", ""), (2, "", "p")] * (k + 1))


def test_routes(spark):
    rows = spark.createDataFrame([("/events/a%20b?x=1&x=2",), ("/events/",), ("/nope/x/y",)], "u string")
    got = routing.route_urls(rows, "u", ["/events", "/events/:id"]).collect()
    assert [(r.route, r.params) for r in got] == [("/events/:id", {"id": "a b"}), ("/events", {}), (None, {})]
    assert got[0].query == {"x": "1"}


def test_pluses_keys_and_patterns_without_a_shape(spark):
    urls = ["/events/a+b", "http://h.org/wiki/?a%20b=1+2&=z&flag&%zz=1", "/wiki", "/wiki/a/b", "/p-5.html/q+", "//x", "/events//", None, "/a.b", "/axb", "/events/%zz"]
    routes = ["/", "/events", "/events/:id", "/wiki/*", "/p-:n.html/:m", "/a.b", "/x*y", "/:a/:a"]
    got = routing.route_urls(spark.createDataFrame([(u,) for u in urls], "path string"), "path", routes).collect()
    assert [r.route for r in got] == ["/events/:id", "/wiki/*", None, "/wiki/*", "/p-:n.html/:m", None, None, "/", "/a.b", None, "/events/:id"]
    assert [r.params for r in got] == [{"id": "a+b"}, {}, {}, {}, {"n": "5", "m": "q+"}, {}, {}, {}, {}, {}, {"id": None}]
    assert got[1].query == {"a b": "1 2", "": "z", "flag": ""}
    assert routing.route_urls(spark.createDataFrame([("/u/v",)], "u string"), "u", routes).first().params == {"a": "v"}
    assert routing.route_urls(spark.createDataFrame([("/u",)], "u string"), "u", []).first().route is None


def test_many_routes_as_one_by_one(spark):
    routes = [f"/s{i % 167}/:id" if i % 3 == 0 else f"/s{i % 167}/t{i}/:a/:b" if i % 3 == 1 else f"/s{i % 167}" for i in range(500)] + ["/:any", "/s3/*"]
    compiled = routing.compiled(routes)
    assert len(compiled.shapes) == 5 and not compiled.regexes
    paths = [f"/s{i % 200}" + ["", "/", "/x", f"/t{i}/u/v/"][i % 4] for i in range(400)] + ["/s3/", "/s3/a/b/c/d", "/", ""]
    rows = spark.createDataFrame([(p,) for p in paths], "p string")
    began = time.time()
    routed = routing.route_urls(rows, "p", routes)
    routed._jdf.queryExecution().executedPlan()
    assert time.time() - began < 5  # with room for a busy machine
    first = lambda p: next((r for r in routes if re.search(routing.regex(r)[0], p or "/")), None)
    assert [r.route for r in routed.collect()] == [first(p) for p in paths]


def test_initials_are_one_character_each(spark):
    """Upper case of several characters (ß, ligatures, Greek with iota) as DuckDB's upper() has it in the SQL of text_scalars."""
    assert values(spark, ["eva ßb", "ßa", "ﬁn ŉa", "ᾳb ᾲc", "ärger ǆx", None], X.initials) == ["Eẞ", "ẞ", "ﬁŉ", "ᾼᾲ", "ÄǄ", "??"]
    several = X.ONE_UPPER[0]
    assert len(several) == 102 and values(spark, list(several), X.initials) == [duckdb.execute("SELECT upper(?)", [c]).fetchone()[0] for c in several]


def test_white_space_beyond_ascii(spark):
    nbsp, narrow = "\xa0", "\u202f"
    assert values(spark, [f"7:30{nbsp}pm", f"7:30{narrow}pm", "7:30\u3000pm", "7:30\x85pm"], X.lenient_clock) == [1170, 1170, 1170, 450]
    assert values(spark, [f"Ann{nbsp}Cole", f"Ann{narrow}Cole", "\tAnn Cole", "\ufeff Ann\u2003Cole"], X.initials) == ["AC"] * 4
    assert values(spark, [f"{nbsp}7", f" {narrow}-7x"], X.int_prefix) == [7, -7]
    assert values(spark, [f"hall{nbsp}one{narrow} two"], search.tokens) == [["hall", "one", "two"]]
    assert X.headers([" A  b", "a\xa0B", "A_B_1", "a b"]) == ["a_b", "a_b_1", "a_b_1_1", "a_b_2"]


def test_long_items_are_two_rows(spark):
    rows = [(1, "1950-01-01", "2050-01-01"), (2, "1999-12-31", "1999-12-31"), (3, "2000-02-28", "2000-03-02"), (4, "2000-03-01", None), (5, "2300-01-01", "2300-01-02"), (6, "1900-01-01", "1950-01-02")]
    items = spark.createDataFrame(rows, "i int, start string, end string").select("i", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"))
    got = {str(r.day): r.n_items for r in listings.calendar_days(items, "1949-12-30", "2050-12-31").collect()}
    want = {}
    for _, low, high in rows:
        day, last = dt.date.fromisoformat(low), dt.date.fromisoformat(high or low)
        while day == dt.date.fromisoformat(low) or day < last:
            if "1949-12-30" <= str(day) <= "2050-12-31":
                want[str(day)] = want.get(str(day), 0) + 1
            day += dt.timedelta(days=1)
    assert got == want
    plan = listings.calendar_days(items, "1949-12-30", "2050-12-31")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("sequence(") < plan.index("inline(")  # days are made of the sums, not of the items
    assert listings.calendar_days(items.limit(0), "1949-12-30", "2050-12-31").isEmpty()


def test_facet_options_and_empty_states(spark):
    rows = spark.createDataFrame([(i, c, "t", "u", "d", "") for i, c in enumerate(["B", "A", "B", ""])], "row_id long, category string, title string, url string, description string, updated string")
    assert [tuple(r) for r in listings.facet_options(rows, "category").orderBy("pos", "value").collect()] == [(0, "All"), (1, "A"), (1, "B")]
    states = listings.no_match(some=listings.resource_browser(rows, "A"), none=listings.resource_browser(rows, "Z")).collect()
    assert {r.listing: r.empty for r in states} == {"some": False, "none": True}


def test_a_hot_category_stays_spread(spark):
    rows = spark.range(20000, numPartitions=8).select(F.col("id").alias("row_id"), F.when(F.col("id") % 10 == 0, F.concat(F.lit("c"), (F.col("id") % 70).cast("string"))).otherwise("hot").alias("category"), F.lit("t").alias("title"), F.lit("u").alias("url"), F.lit("").alias("description"), F.lit("").alias("updated"))
    out = listings.resource_browser(rows)
    sizes = [r["count"] for r in out.where("category = 'hot'").groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 18000 and max(sizes) <= 3000
    assert {r.category: r.section_order for r in out.select("category", "section_order").distinct().collect()} == {"hot": 1, **{f"c{k}": k for k in range(0, 70, 10)}}


def test_dates_in_steps_are_those_of_the_expressions(spark):
    dates = ["2026-06-07", "2026-02-30", "26-06-07", "2026-06-07 09:00", "TBA", "", None, "275760-09-14", "99999999-1-1", "2026-1-1-1", "1-1-1"]
    clocks = ["9:00 AM", "12:30 am", "25:75", "noon", "", None, "7:00 p.m.", "7pm PST", "1,2", "99"]
    rows = spark.createDataFrame([(d, c) for d in dates for c in clocks], "d string, c string")
    got = X.with_datetimes(rows, a=(F.col("d"), F.col("c")), b=(F.col("d"), None)).withColumns({"x": X.parse_datetime(F.col("d"), F.col("c")), "y": X.parse_date(F.col("d")).cast("timestamp_ntz")})
    assert got.columns == ["d", "c", "a", "b", "x", "y"]
    assert got.where("not (a <=> x and b <=> y)").isEmpty() and got.where("a is not null").count() > 30


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_against_duckdb(spark, name):
    assert name in __spark_entry__.queries()
    found = QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    db = duckdb.connect()
    for table in "region nation supplier part orders events documents pages benchmark".split():
        db.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    expected = db.execute("select " + ", ".join(f'"{c}"' for c in columns) + f" from ({ORACLE_SQL[name]})").fetchall()
    assert sorted(map(str, (tuple(r) for r in found.select(columns).collect()))) == sorted(map(str, expected))


def test_writing_tables_leaves_the_settings_alone(spark):
    before = spark.conf.get(tables.FREES_SHUFFLES, "false")
    assert tables.materialise(spark.range(100).repartition(3, "id"), "freed").count() == 100
    assert spark.conf.get(tables.FREES_SHUFFLES) == before
    with pytest.raises(Exception), tables.Workspace(spark, "freed") as w:
        w.write(spark.range(3).select(F.when(F.col("id") > 0, F.raise_error(F.lit("no"))).otherwise(1)), "never")
    assert not list(Path(tables.shared_folder(spark).removeprefix("file:")).glob("freed-never-*"))
    assert spark.conf.get(tables.FREES_SHUFFLES) == before
