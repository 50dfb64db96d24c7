import hashlib
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from gazette.llm import collocations, substring_dedup
from gazette.llm.queries import ORACLE_SQL, QUERIES
from gazette.sources.tables import Workspace

SF = "/root/testdata/sf0.001"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, lang string, slice string, block int")


def without_repeats(rows, n=13):
    """Kept words of each row, window by window."""
    split = [re.findall(r"[^\x20\x09-\x0d]+", t or "") for _, t, _ in rows]
    ids = [float("inf") if i is None else i for i, _, _ in rows]
    first = {}
    for i, words in zip(ids, split, strict=True):
        for k in range(len(words) - n + 1):
            w = tuple(words[k : k + n])
            first[w] = min(i, first.get(w, i))
    out = []
    for i, words in zip(ids, split, strict=True):
        gone = {k + j for k in range(len(words) - n + 1) if first[tuple(words[k : k + n])] < i for j in range(n)}
        out.append(" ".join(w for k, w in enumerate(words) if k not in gone))
    return out


@pytest.mark.parametrize("parts", [1, 7])
def test_repeats_go_window_by_window(spark, parts):
    rng = random.Random(3)
    passages = [" ".join(rng.choice("abcdefghij") + str(rng.randrange(40)) for _ in range(rng.randrange(10, 60))) for _ in range(12)]
    rows = [(i * 3 - 20, rng.choice(["", " ", "X\t"]).join([" ".join(rng.sample(passages, 3)), f" own{i} " * 4, rng.choice(passages)[rng.randrange(30) :]]), "en") for i in range(60)]
    rows += [(i, None, "en") for i in (900, 901)] + [(None, passages[0], "en"), (None, passages[0] + " tail", None), (1000, "", None), (7, rows[4][1], "en"), (7, rows[4][1], "en"), (10**15, passages[1].upper(), "en"), (-(2**63), passages[2], "en")]
    docs = table(spark, rows).repartition(parts)
    shown = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    got = substring_dedup.parse(docs).collect()
    assert sorted((str(r.doc_id), r.kept) for r in got) == sorted((str(i), k) for (i, _, _), k in zip(shown, without_repeats(shown), strict=True))
    texts = {}
    for i, t, _ in shown:
        texts.setdefault(i, []).append((t or "").split())
    assert any(r.factors for r in got)
    for r in got:
        for f in r.factors:
            assert f.length >= 13 and (r.doc_id is None or f.source_id < r.doc_id)
            span = lambda words, at, n=f.length: words[at : at + n]
            own = {tuple(span(w, f.start)) for w in texts[r.doc_id]}
            assert own & {tuple(span(w, f.source_start)) for w in texts[f.source_id]}


def test_factors_end_where_their_source_does():
    source = np.array([-1, 4, 4, 4, 6, 6, -1, 6])
    place = np.array([0, 7, 8, 20, 1, 2, 0, 4])
    assert substring_dedup.factors(source, place, 3) == [(1, 4, 4, 7), (3, 3, 4, 20), (4, 4, 6, 1), (7, 3, 6, 4)]
    assert substring_dedup.factors(np.full(3, -1), np.zeros(3, int)) == []


def scored(rows, least, top):
    """The contract, phrase by phrase."""
    f, n = {}, Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in (1, 2, 3):
                for i in range(len(words) - k + 1):
                    f.setdefault(lang, Counter())[tuple(words[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in found.items():
            if any(len(q) > len(p) and p in (q[:2], q[1:]) and 100 * b >= 50 * a for q, b in found.items()):
                continue
            score, _, l, r = min((1000000 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("parts", [1, 6])
def test_collocations_against_plain_counts(spark, parts):
    rng = random.Random(5)
    vocab = ["a", "of", "New", "york", "é", "\x01", "x\x85y", "日本", "B-c"]
    rows = [(i, "".join(rng.choice(vocab) + rng.choice([" ", " ", "  ", "\t", ", ", ".\n"]) for _ in range(rng.randrange(120))), rng.choice(["en", "fr", None, "und", ""])) for i in range(150)]
    rows += [(900, None, "en"), (901, "", None), (902, " .,; ", "de")]
    want = scored(rows, 10, 25)
    got = collocations.collocations(table(spark, rows).repartition(parts), top=25)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 40


def test_counts_past_64_bits(spark):
    counts = [("en", "", "", "", 10**15), ("en", "a", "", "", 9 * 10**14), ("en", "b", "", "", 8 * 10**14), ("en", "a", "b", "", 7 * 10**14)]
    with Workspace(spark, "large") as tables:
        (row,) = collocations.candidates(spark.createDataFrame(counts, collocations.COUNTS), tables).collect()
    assert (row.a, row.l, row.r, row.score) == (7 * 10**14, 9 * 10**14, 8 * 10**14, 1000000 * 49 // 72)


@pytest.mark.parametrize("name", ["op12_substring_dedup", "op13_collocations"])
def test_against_sql(spark, name):
    found = QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    expected = db.execute("select " + ", ".join(f'"{c}"' for c in columns) + f" from ({ORACLE_SQL[name]})").fetchall()
    assert sorted(map(str, (tuple(r) for r in found.select(columns).collect()))) == sorted(map(str, expected)) and expected


def test_kept_digest(spark, tmp_path):
    table(spark, [(1, "a  b\n c", "en")]).write.parquet(f"{tmp_path}/documents.parquet")
    (row,) = substring_dedup.query(spark, str(tmp_path)).collect()
    assert row.kept_sha256 == hashlib.sha256(b"a b c").hexdigest() and (row.n_words, row.n_removed) == (3, 0)


def test_streams_may_be_cut_anywhere(spark):
    """Parts that begin within the phrases of a word or a pair get the counts that stand in earlier parts."""
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice(["of", "of", "a", "b", "c", "d"]) for _ in range(60)), rng.choice(["en", "en", "fr"])) for i in range(60)]
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        got = sorted(map(tuple, collocations.collocations(table(spark, rows)).collect()))
        with Workspace(spark, "cut") as tables:
            counts = collocations.phrase_counts(table(spark, rows), tables)
            stream = collocations._streamed(counts.where("w1 <> ''"), ["w1", "w2", "w3"], tables, "prefix")
            parts = spark.read.parquet(tables.paths["prefix"])
            assert parts.where("f is not null and one is null").select("part").distinct().count() > 5
            assert parts.where("w3 <> '' and two is null").select("part").distinct().count() > 5
            assert stream.where("f is not null and (one is null or w3 <> '' and two is null)").isEmpty()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == scored(rows, 10, 2000) and len(got) > 60
