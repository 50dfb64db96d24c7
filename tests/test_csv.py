import csv
import io
import random

import pytest
from pyspark.errors import AnalysisException

from gazette.sources import csv_ranges
from gazette.sources.feeds import FeedCatalog, read_csv

HEADER = ["id", " Start Date ", "title", "Title", "notes"]
NAMES = ["id", "start_date", "title", "title_1", "notes"]


def table(rows, line="\n"):
    out = io.StringIO()
    writer = csv.writer(out, lineterminator=line)
    writer.writerow(HEADER)
    writer.writerows(rows)
    return out.getvalue().encode()


def cells(rng, i):
    text = lambda: "".join(rng.choice(["a", "é", '"', '""', ",", "\n", "\n\n", " ", "x" * 30, ""]) for _ in range(rng.randrange(12)))
    return [f"r{i}", text(), text(), "plain", text()]


@pytest.fixture
def small_ranges(spark):
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for k in before:
        spark.conf.set(k, "700")
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("line", ["\n", "\r\n"])
def test_quotes_across_ranges_and_row_ids_over_files(spark, tmp_path, small_ranges, line):
    rng = random.Random(1)
    written, n = [], 0
    for k, size in enumerate([3, 200, 0, 1, 90]):
        rows = [cells(rng, n + i) for i in range(size)]
        if k == 4:
            rows[5][2] = 'long "" \n' * 400  # over several ranges
        n += size
        written += rows
        (tmp_path / f"part-{k}.csv").write_bytes((b"\xef\xbb\xbf" if k == 0 else b"") + table(rows, line))
    got = read_csv(spark, str(tmp_path / "*.csv"))
    assert got.columns == [*NAMES, "row_id"]
    spaces = "\t\n\v\f\r \xa0\ufeff"
    rows = got.orderBy("row_id").collect()
    same = lambda x: (x or "").replace("\r\n", "\n")
    assert [(r.row_id, *[same(r[c]) for c in NAMES]) for r in rows] == [(i, *[same(c.strip(spaces)) for c in w]) for i, w in enumerate(written)]
    assert csv_ranges._lines(spark, str(tmp_path / "*.csv")).rdd.getNumPartitions() > 10
    once = spark.read.csv(str(tmp_path / "part-4.csv"), header=True, multiLine=True, escape='"')
    assert once.rdd.getNumPartitions() == 1 and once.count() == 90


def test_plain_files_and_what_no_record_closes(spark, tmp_path, small_ranges):
    (tmp_path / "a.csv").write_text("id,v\n" + "".join(f"{i},{i}\n" for i in range(500)) + '500,"open\nto the\nend')
    (tmp_path / "b.csv").write_text("id,v\n")
    (tmp_path / "c.csv").write_text("")
    (tmp_path / "d.csv").write_text('id,v\n1,5" pipe\n,\n\n2,"q" junk, x')
    rows = read_csv(spark, str(tmp_path / "*.csv")).orderBy("row_id").collect()
    assert [r.row_id for r in rows] == [*range(501), 501, 504]
    assert [r.v for r in rows[:3]] == ["0", "1", "2"] and rows[500].v == "open\nto the\nend" and rows[501].v == '5" pipe'
    with pytest.raises(AnalysisException):
        read_csv(spark, str(tmp_path / "none.csv"))
    assert read_csv(spark, str(tmp_path / "c.csv")).isEmpty()


def test_missing_feeds_and_headers(spark, tmp_path):
    tmp_path = tmp_path / "a folder, 50%"
    tmp_path.mkdir()
    (tmp_path / "meetings.csv").write_text('NAME , Day\xa0Of  Week,name\n a ,Monday,"b ""c"""\n,,\n')
    catalog = FeedCatalog({"meetings": str(tmp_path / "meetings.csv"), "events": str(tmp_path / "gone.csv")}, on_missing="empty")
    (row,) = catalog.read(spark, "meetings").collect()
    assert row.asDict() == {"name": "a", "day_of_week": "Monday", "name_1": 'b "c"', "row_id": 0}
    events = catalog.read(spark, "events")
    assert events.isEmpty() and "start_date" in events.columns and "row_id" in events.columns


def test_ranges_that_change_are_an_error(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id\n" + "1\n" * 400)
    rows = read_csv(spark, str(tmp_path / "a.csv"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
    try:
        with pytest.raises(Exception, match="have changed"):
            rows.select("id").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
