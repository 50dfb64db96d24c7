import textwrap

import pytest
from pyspark.sql import functions as F

from gazette.llm import license_scan

TALK = "the river runs past the old mill and the boats lie in the rain under a grey sky for days"


def notice(family, *starts):
    """Templates of a family as one text: fixed wording of public notices."""
    return " ".join(next(t for f, t in license_scan.TEMPLATES if f == family and t.startswith(x) and len(t) > 60) for x in starts)


NOTICES = {
    "mit": notice("mit", "Permission is", "The above", "THE SOFTWARE"),
    "bsd-3-clause": notice("bsd-3-clause", "Redistribution and", "Redistributions of", "Redistributions in", "Neither"),
    "apache-2.0": notice("apache-2.0", "Licensed under", "You may", "Unless"),
    "gpl-3.0": notice("gpl-3.0", "This program is free", "This program is distributed", "You should"),
}


def table(spark, rows):
    filler = [(1000 + i, f"{TALK} {i} {TALK[i:]}\n{i} more of {TALK[::-1]}") for i in range(40)]
    return spark.createDataFrame([*rows, *filler], "doc_id long, text string").repartition(3)


@pytest.fixture(scope="module")
def model(spark):
    return license_scan.train(table(spark, []))


def test_wrapped_notices_are_found_once(spark, model):
    rows, want = [], {}
    for width in (60, 72, 80):
        for mark in ("", "# ", "// ", " * "):
            for family, text in NOTICES.items():
                i = len(rows)
                body = "\n".join(mark + x for x in textwrap.wrap(text, width))
                rows.append((i, f"{TALK}\n{mark}Copyright 2020 Jo Doe\n{mark.rstrip()}\n{body}\n\nint main(void)\n{TALK}"))
                want[i] = [family]
    found = license_scan.scan(table(spark, rows), model, 0.9).where("doc_id < 1000").groupBy("doc_id").agg(F.collect_list("family").alias("families"), F.max("n_lines").alias("n")).collect()
    assert {r.doc_id: r.families for r in found} == want
    assert all(r.n > 3 for r in found)


def test_notices_far_apart_are_two(spark, model):
    text = NOTICES["mit"]
    (a, b) = license_scan.scan(table(spark, [(1, f"{text}\n{TALK}\n{TALK}\n{TALK}\n{text}")]), model, 0.9).where("doc_id = 1").orderBy("paragraph").collect()
    assert (a.paragraph, b.paragraph, a.n_lines, b.n_lines) == (0, 4, 1, 1)


def test_null_and_repeated_ids_keep_their_own(spark, tmp_path):
    mit, gpl = f"{TALK}\nReleased under the MIT License.", f"This work is licensed under the GNU General Public License, version 3.\n{TALK}"
    rows = [(None, mit), (None, TALK), (None, None), (7, mit), (7, gpl), (7, gpl), (8, ""), (9, "...\n \n-")]
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = [(r.doc_id, r.n_paragraphs, r.n_licensed, r.families) for r in license_scan.query(spark, str(tmp_path)).where("doc_id is null or doc_id < 1000").collect()]
    assert sorted(got, key=str) == sorted([(None, 2, 1, "mit"), (None, 1, 0, ""), (None, 0, 0, ""), (7, 2, 1, "mit"), (7, 2, 1, "gpl-3.0"), (7, 2, 1, "gpl-3.0"), (8, 0, 0, ""), (9, 0, 0, "")], key=str)
