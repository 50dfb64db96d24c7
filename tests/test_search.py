import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gazette.operators import grams, search
from gazette.sources.tables import Workspace

SCHEMA = "type string, title string, url string, search_text string, type_pos long, item_pos long"


def rows(spark, texts, at=0):
    return spark.createDataFrame([("t", str(i), "", t, i % 3, at + i) for i, t in enumerate(texts)], SCHEMA)


def asked(spark, *qs):
    return spark.createDataFrame(list(enumerate(qs)), "query_id long, q string")


def both(index, table, queries, k=30):
    found = sorted(map(tuple, index.search(queries, k).collect()))
    assert found == sorted(map(tuple, search.scan_search(table, queries, k).collect()))
    return found


@pytest.fixture
def looked_at(monkeypatch):
    """How many texts the rounds have looked at."""
    seen = []
    write = Workspace.write

    def counted(self, df, name):
        out = write(self, df, name)
        if name.startswith("candidates-"):
            seen.append(out.count())
        return out

    monkeypatch.setattr(Workspace, "write", counted)
    return seen


def test_a_word_of_every_row_looks_at_a_few_times_k_texts(spark, tmp_path, looked_at):
    table = rows(spark, [f"brand row {i}" for i in range(3000)])
    index = search.SearchIndex.build(table, str(tmp_path))
    assert len(both(index, table, asked(spark, "brand"))) == 30 and looked_at == [120]
    looked_at.clear()
    # The rarest gram of the tokens is in all rows, but few rows have them all: further rounds, each four times as large.
    table = rows(spark, [f"abcd bcde {'' if i == 2500 else 'x'} {i}" for i in range(3000)] + ["abcde"] * 2, 10)
    index = search.SearchIndex.build(table, str(tmp_path / "rounds"))
    assert len(both(index, table, asked(spark, "abcde bcd"))) == 2
    assert len(looked_at) > 2 and sum(looked_at) <= 3002


def test_appended_rows_are_found_and_the_index_is_read_once(spark, tmp_path):
    first, more = rows(spark, [f"hall {i} k" for i in range(60)]), rows(spark, ["hall x", "k", "", "hall 5 late"], -10)
    index = search.SearchIndex.build(first, str(tmp_path))
    queries = asked(spark, "hall", "k", "hall 5", "late", "nowhere", "", None, "hall k 7 7")
    both(index, first, queries)
    before = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "postings" / "segment=0").glob("part-*")}
    index.append(more)
    found = both(index, first.unionByName(more), queries, 12)
    assert {r[3] for r in found if r[0] == 3} == {"3"} and index.segments() in ([0, 1], [1, 0])
    assert before == {p.name: p.stat().st_mtime_ns for p in (tmp_path / "postings" / "segment=0").glob("part-*")}
    again = search.SearchIndex(spark, str(tmp_path))
    assert sorted(map(tuple, again.search(queries, 12).collect())) == found


def test_what_a_failed_append_leaves_is_not_read(spark, tmp_path):
    table = rows(spark, ["one", "two"])
    index = search.SearchIndex.build(table, str(tmp_path))
    bad = table.withColumn("search_text", F.when(F.col("item_pos") == 1, F.raise_error(F.lit("no"))).otherwise("one"))
    with pytest.raises(Exception, match="no"):
        index.append(bad)
    table.withColumn("at", F.lit(7).cast("long")).write.mode("overwrite").parquet(f"{tmp_path}/rows/segment=1")
    assert len(both(index, table, asked(spark, "one"))) == 1
    index.append(rows(spark, ["one more"], 50))
    assert len(index.search(asked(spark, "one")).collect()) == 2


def test_hot_grams_lie_in_pieces(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(search, "BLOCK_BITS", 3)
    table = rows(spark, [f"hot {'warm' if i % 7 == 0 else 'cold'} {i}" for i in range(200)])
    index = search.SearchIndex.build(table, str(tmp_path))
    pieces = index.table("postings").where("gram = 'hot'")
    assert pieces.count() > 20 and pieces.agg(F.max("n")).first()[0] <= 8
    both(index, table, asked(spark, "hot warm", "hot", "warm 1", "cold 199", "o"), 5)


def test_an_empty_index_and_no_queries(spark, tmp_path):
    index = search.SearchIndex.build(rows(spark, []), str(tmp_path))
    assert index.search(asked(spark, "a", "abc")).isEmpty()
    assert search.search(rows(spark, ["abc"]), asked(spark, "", None)).isEmpty()


ODD = ["hall 1 k", None, "", "b😀c hall", "ſtraße K\u0301", "a" * 400 + " k", "k", "hall k hall", "日本語 hall", "k\x00\ud7ffk", "\U0010ffff\u0001k"]
ASKED = ("hall", "k", "hall k", "😀c", "b😀c hall", "日本", "ß", "hal hall", "\x00\ud7ff", "\U0010ffff", "aaaa", "aaaab", "nowhere", "", None, "hall k")


@pytest.mark.parametrize("scanned", [0, 1 << 14])
def test_a_batch_against_every_row(spark, monkeypatch, scanned):
    """Rows in falling order, equal types, odd characters; up to SCANNED sets of tokens no index is built, beyond it one is."""
    built = []
    monkeypatch.setattr(search, "SCANNED", scanned)
    build = search.SearchIndex.build.__func__
    monkeypatch.setattr(search.SearchIndex, "build", classmethod(lambda cls, *a: built.append(1) or build(cls, *a)))
    table = rows(spark, ODD * 12).orderBy(F.desc("item_pos"))
    found = sorted(map(tuple, search.search(table, asked(spark, *ASKED), 7).collect()))
    assert found == sorted(map(tuple, search.scan_search(table, asked(spark, *ASKED), 7).collect())) and len(found) > 60
    assert built == ([] if scanned else [1])


def test_many_answers_are_dealt_to_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(search, "DEALT", 300)
    table = rows(spark, [f"hall {i}" for i in range(40)])
    found = search.search(table, asked(spark, *["hall", "hall 1"] * 60).coalesce(1))
    assert found.count() == 60 * 30 + 60 * 13 and len(found.select(F.input_file_name()).distinct().collect()) > 3


def test_pieces_of_an_alphabet_of_all_characters():
    """More characters than a gram and its row have room for in one number: halves, with the same rows."""
    texts = ["".join(map(chr, range(a, a + 9000))) for a in range(0x4E00, 0x4E00 + 9000, 3000)] + ["".join(map(chr, range(0x10000, 0x10000 + 300_000))), "ab", "b"]
    batch = pa.RecordBatch.from_pydict({"at": pa.array(range(70, 70 + len(texts)), pa.int64()), "search_text": texts})
    got = {}
    for part in grams.postings(4096, (1, 2, 3))([batch]):
        for r in part.to_pylist():
            assert r["n"] == len(r["rows"]) and r["rows"] == sorted(set(r["rows"]))
            got.setdefault(r["gram"], []).extend(r["block"] + i for i in r["rows"])
    want = {}
    for i, t in enumerate(texts):
        for g in {t[j : j + n] for n in (1, 2, 3) for j in range(len(t) - n + 1)}:
            want.setdefault(g, []).append(70 + i)
    assert got == want
