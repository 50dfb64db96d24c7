import base64
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from gazette.llm import byte_bpe, license_scan, line_dedup, lm_scoring, mpeg_audio, near_dedup, packing, sharding, spot_sigs, toxicity
from gazette.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, word string, part int"
WORDS = "the quick brown fox jumps over the lazy dog and then it runs to the old mill by the river in the rain"


def docs(spark, texts):
    rows = [(i, t, "en", f"s{i % 10}", None if t is None else len(t), "x", None, 7) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


TEXTS = [None, "", " \n\t ", "one", "the the the", WORDS, WORDS, WORDS.upper(), WORDS + " today", "日本語 😀 é <|endoftext|> İΣ", "a  b\n c\t d\x1cx", (WORDS + ".\n") * 3000, "Released under the MIT License.\n" + WORDS[::-1]]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The edge texts, with repeated rows, as the tables that queries read."""
    path = tmp_path_factory.mktemp("edge")
    table = docs(spark, TEXTS)
    extra = table.where("doc_id in (5, 7)").unionByName(spark.createDataFrame([(None, WORDS, None, None, None, None, None, None)], SCHEMA))
    table.unionByName(extra).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(5, 1, 0), (5, 1, 0), (8, 0, 1), (10, None, None), (11, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("empty")
    docs(spark, []).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_edges_and_empty_tables(spark, folder, empty, name):
    assert QUERIES[name](spark, empty).count() == 0
    rows = QUERIES[name](spark, folder).collect()
    if name.startswith("op13_"):  # phrases, not documents
        assert {r.lang for r in rows} == {"en"} and len(rows) > 5
        return
    ids = Counter(r.doc_id for r in rows)
    if name.startswith("op1_"):
        assert set(ids) == {None, *range(len(TEXTS))}
    else:
        assert ids == Counter({**{i: 1 for i in range(len(TEXTS))}, 5: 2, 7: 2, None: 1})


def test_pipeline_edges(spark, folder, empty):
    assert corpus_pipeline.run(spark, empty).count() == 0
    rows = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, rows, folder)
        assert out.columns == rows.columns, name
        rows = out
    ids = {r.doc_id for r in rows.collect()}
    assert {0, 1, 2, 3, 5} <= ids and not {6, 7} & ids
    assert corpus_pipeline.run(spark, folder).count() > 0


def test_pipeline_takes_near_copies_from_four_fifths(spark):
    """Similarities of 0.80 to 0.85 between texts 2 i and 2 i + 1."""
    texts = []
    for i in range(40):
        words = [f"w{i}x{k}" for k in range(100 + i)]
        texts += [" ".join(words), " ".join([*words, *(f"end{i}x{k}" for k in range(20 + i // 8))])]
    sets = [shingles(t) for t in texts]
    assert all(80 * len(a | b) <= 100 * len(a & b) < 85 * len(a | b) for a, b in zip(sets[::2], sets[1::2], strict=True))
    kept = corpus_pipeline.one_of_each_group_stays(spark, docs(spark, texts), "")
    assert sorted(r.doc_id for r in kept.collect()) == list(range(0, 80, 2))


def test_packing_against_the_library(spark):
    library = Tokenizer.from_file(packing.TOKENIZER)
    pieces = packing.pack(docs(spark, TEXTS), with_ids=True).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
        assert p.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in p.ids))
    for i, text in enumerate(TEXTS):
        own = sorted(by_doc[i], key=lambda p: p.start)
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        assert [x for p in own for x in p.ids] == ids and {p.doc_tokens for p in own} == {len(ids)}
    for own in by_sequence.values():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == [sum(q.length for q in own[:k]) for k in range(len(own))]
        size = sum(p.length for p in own)
        assert size == 2048 or size & (size - 1) == 0


def test_assign_takes_the_lowest_cost():
    pieces, rests = packing.assign([5, 4, 3, 3], [8, 8], 1.0, 1.0)
    assert pieces == [(0, 0, 5, 0), (1, 0, 4, 1), (2, 0, 3, 1), (3, 0, 3, 0)] and rests == []  # costs 30, 20, then 30, 32
    assert packing.assign([5, 4], [4, 4], 1.0, 1.0) == ([(0, 0, 4, 0), (0, 4, 1, 1), (1, 0, 3, 1)], [(1, 3)])


def test_byte_bpe_against_the_library(spark):
    with open(byte_bpe.TOKENIZER, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [*TEXTS, "aaaaaaaaa", "x" * 700, "I'll we've '' 12345", "\n\n  \n x"]
    encoded = byte_bpe.encode(docs(spark, texts))
    assert {r.doc_id: r.ids for r in encoded.collect()} == {i: library.encode_ordinary(t or "") for i, t in enumerate(texts)}
    assert {r.doc_id: r.text for r in byte_bpe.decode(encoded).collect()} == {i: t or "" for i, t in enumerate(texts)}


def shingles(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def test_near_duplicates_against_all_pairs(spark):
    base = [" ".join(f"w{(i * 37 + k * k) % 997}" for k in range(60 + i)) for i in range(12)]
    texts = [*TEXTS[:11], *base, *[b.replace("w", "v", 2) for b in base], *[b + " end" for b in base], *[f"{b} end stop" for b in base], *base]
    sets, least = [shingles(t) for t in texts], list(range(len(texts)))
    for _ in texts:
        for a in range(len(texts)):
            for b in range(a):
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    least[a] = least[b] = min(least[a], least[b])
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs(spark, texts)).collect()}
    assert got == {i: (len(sets[i]), least[i], least[i] == i) for i in range(len(texts))}


@pytest.mark.parametrize(("large", "tile", "slots"), [(64, 7, 1 << 20), (8, 5, 1 << 20), (8, 256, 2)])
def test_no_link_of_mixed_buckets_is_lost(spark, monkeypatch, large, tile, slots):
    """Bands of one bin: most texts share buckets with texts unlike them, so buckets are compared in tiles or by rare shingles."""
    for name, value in (("LARGE", large), ("TILE", tile), ("SLOTS", slots)):
        monkeypatch.setattr(near_dedup, name, value)
    shared = [f"shared{i}" for i in range(70)]
    texts = [" ".join(shared + [f"own{i // 2}x{j}" for j in range(30)] + ["tail"] * (i % 2)) for i in range(60)]
    sets = near_dedup.shingle_sets([t.encode() for t in texts])
    keys = near_dedup.signatures(sets, 4, 1)
    assert Counter(keys.ravel().tolist()).most_common(1)[0][1] > 20
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs(spark, texts), bands=4, per_band=1).collect()}
    linked = 0
    for i in range(len(texts)):
        assert got[i] in (i, i - 1)
        for j in range(i):
            a, b = set(sets[i].tolist()), set(sets[j].tolist())
            if set(keys[i].tolist()) & set(keys[j].tolist()) and 100 * len(a & b) >= 85 * len(a | b):
                linked += 1
                assert got[i] == got[j]
    assert linked > 10


def test_a_hot_bucket_of_unlike_texts(spark, monkeypatch):
    """Over 2,048 texts that share a passage and little else, near copies among them: every link is found, and few pairs are compared."""
    compared = spark.sparkContext.accumulator(0)
    links = near_dedup._tile_links

    def counting(tile, percent):
        asked = sum(x[2] for x in tile)
        compared.add(asked * (len(tile) - asked))
        return links(tile, percent)

    monkeypatch.setattr(near_dedup, "_tile_links", counting)
    passage = [f"shared{i}" for i in range(100)]
    texts = [" ".join([*passage, *(f"own{i}x{j}" for j in range(40))]) for i in range(2400)]
    texts += [t + " end" for t in texts[::60]]
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs(spark, texts)).collect()}
    assert got == {**{i: i for i in range(2400)}, **{2400 + k: 60 * k for k in range(40)}}
    assert compared.value < 20 * len(texts)


def test_rows_that_repeat_an_id_are_one_document(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    rows = spark.createDataFrame([(1, a), (5, a), (5, b), (9, b), (12, b + " c"), (20, "alone"), (20, "alone")], "doc_id long, text string")
    got = near_dedup.near_duplicates(rows).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [(1, 1, True), (5, 1, False), (5, 1, False), (9, 1, False), (12, 1, False), (20, 20, True), (20, 20, True)]
    assert sorted(map(tuple, corpus_pipeline.one_of_each_group_stays(spark, rows, "").collect())) == [(1, a), (20, "alone")]


def test_overlaps_by_columns():
    rng = np.random.default_rng(3)
    left, right = ([np.unique(rng.integers(0, 90, n).astype(np.uint64)) for n in sizes] for sizes in ((0, 5, 40), (30, 0, 60, 1)))
    assert near_dedup.overlaps(left, right, columns=7).tolist() == [[len(set(a.tolist()) & set(b.tolist())) for b in right] for a in left]
    assert near_dedup.overlaps([], right).shape == (0, 4)


@pytest.mark.parametrize("at_least", [0.5, 0.8])
def test_spot_pairs_against_all_pairs(spark, at_least):
    base = [" ".join(f"the c{(i * 13 + k * 7) % 211} d{(k * k + i) % 97} of" for k in range(4 + 3 * (i % 9))) for i in range(30)]
    texts = [*TEXTS[:11], None, *base, *[b.replace("c", "e", 1) for b in base], *[b + " the last words" for b in base], *base[:5]]
    table = docs(spark, texts)
    members = {r.doc_id: r for r in spot_sigs.class_members(table).collect()}
    sets = {m.class_id: set(m.signatures) for m in members.values()}
    assert all(m.class_id == min(d for d, x in members.items() if set(x.signatures) == set(m.signatures)) for m in members.values())
    likeness = {(a, b): len(x & y) / len(x | y) for a, x in sets.items() for b, y in sets.items() if a < b}
    got = spot_sigs.near_pairs(table, at_least).collect()
    assert len(got) > 20
    assert {(min(r.a, r.b), max(r.a, r.b)): r.likeness for r in got} == {k: v for k, v in likeness.items() if v >= at_least}
    assert len(got) == len({(r.a, r.b) for r in got})
    assert spot_sigs.near_pairs(table.limit(0)).count() == 0
    linked = {r.doc_id: (r.class_id, r.n_links) for r in spot_sigs.links(table, at_least).collect()}
    count = Counter(x for k, v in likeness.items() if v >= at_least for x in k)
    assert linked == {d: (m.class_id, count[m.class_id]) for d, m in members.items()}


@pytest.mark.parametrize(("few", "block", "tiled"), [(2, 3, 512), (2, 1000, 20), (10, 7, 40)])
def test_spot_crowds_meet_in_tiles(spark, monkeypatch, few, block, tiled):
    """Near copies of one text, more than meet pair by pair: every link once, whichever way each signature's sets meet."""
    for name, value in (("FEW", few), ("BLOCK", block), ("TILED", tiled), ("TASK_PAIRS", 50)):
        monkeypatch.setattr(spot_sigs, name, value)
    edited = lambda n, i: " ".join(f"the c{k}{'x' if (k * 31 + i * i * 7) % 97 < i % 12 else ''} d{k} of" for k in range(n))
    texts = [*(edited(40, i) for i in range(60)), *(edited(46, i) for i in range(20)), *(edited(9, i) for i in range(12)), edited(40, 5), WORDS, None]
    table = docs(spark, texts)
    sets = {r.class_id: set(r.signatures) for r in spot_sigs.class_members(table).collect()}
    likeness = {(a, b): len(x & y) / len(x | y) for a, x in sets.items() for b, y in sets.items() if a < b}
    near = {k: v for k, v in likeness.items() if v >= 0.8}
    got = spot_sigs.near_pairs(table).collect()
    assert len(got) > 300 and Counter((min(r.a, r.b), max(r.a, r.b)) for r in got) == Counter(list(near))
    assert all(r.likeness == near[min(r.a, r.b), max(r.a, r.b)] and (len(sets[r.a]), r.a_fingerprint) < (len(sets[r.b]), r.b_fingerprint) for r in got)
    count = Counter(x for k in near for x in k)
    assert all(r.n_links == count[r.class_id] for r in spot_sigs.links(table).collect())


def test_spot_links_reads_texts_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def read(i):
        seen.add(1)
        return f"{WORDS} {i % 40}"

    table = spark.range(100).select(F.col("id").alias("doc_id"), F.udf(read)("id").alias("text")).repartition(2)
    assert spot_sigs.links(table).count() == 100
    assert seen.value == 100


def test_least_hashes_are_those_of_a_full_sort(spark):
    rows = spark.range(20000).select(F.xxhash64("id").alias("at"), F.col("id").cast("string").alias("line"))
    low = rows.orderBy("at").limit(1).crossJoin(spark.range(9000)).drop("id")  # copies of the line that comes first
    for table in (rows, rows.unionByName(low)):
        assert license_scan._least(table, 50).collect() == rows.orderBy("at").limit(50).collect()
    assert license_scan._least(rows.limit(9), 50).count() == 9
    assert license_scan._least(rows.limit(0), 50).count() == 0


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 90)], "a long, b long")
    assert {r.node: r.label for r in near_dedup.components(links).collect()} == {**dict.fromkeys(range(41), 0), 90: 90, 100: 90}


def test_toxicity_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    rows = toxicity.query(spark, sf).where("held_out").join(labels, "doc_id").collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    toxic = [r.predicted for r in rows if r.toxic == 1]
    clean = [r.predicted for r in rows if r.toxic == 0]
    assert sum(toxic) / len(toxic) > 0.85 and sum(clean) / len(clean) < 0.02


def test_lookup_table_by_turns():
    names, size = [f"n{i}" for i in range(5)], 31
    table, free = [None] * size, set(range(size))
    orders = []
    for n in names:
        d = hashlib.md5(n.encode()).digest()
        offset, skip = int.from_bytes(d[:8], "big") % size, int.from_bytes(d[8:], "big") % (size - 1) + 1
        orders.append([(offset + k * skip) % size for k in range(size)])
    turn = 0
    while free:
        slot = next(s for s in orders[turn % 5] if s in free)
        table[slot] = turn % 5
        free.remove(slot)
        turn += 1
    assert sharding.lookup_table(names, size) == table
    full, less = sharding.lookup_table(names, 1009), sharding.lookup_table(names[:-1], 1009)
    assert sum(a != b for a, b in zip(full, less, strict=True)) < 1009 * 0.4


def test_placement_of_rows(spark, tmp_path):
    names = [f"n{i}" for i in range(5)]
    rows = spark.createDataFrame([(f"k{i}" if i else None, "old", -1, i) for i in range(300)], "shard string, slot string, at int, file int")
    table = sharding.lookup_table(names, 1009)
    slot = lambda k: int(hashlib.md5((k or "").encode()).hexdigest()[:15], 16) % 1009
    keys = {i: f"k{i}" if i else None for i in range(300)}
    got = sharding.place(rows, "shard", names, 1009)
    assert sorted(got.columns) == ["at", "file", "shard", "slot"]
    assert {r.file: (r.slot, r.shard, r["at"]) for r in got.collect()} == {i: (slot(k), table[slot(k)], -1) for i, k in keys.items()}
    sharding.write_sharded(rows, "shard", names, str(tmp_path / "out"), 2, 1009)
    assert {r.file: r.shard for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {i: table[slot(k)] for i, k in keys.items()}
    with pytest.raises(ValueError):
        sharding.lookup_table(names, 1009, [0] * 5)
    weighted = Counter(sharding.lookup_table(names, 1009, [3, 1, 1, 1, 0]))
    assert weighted[4] == 0 and abs(weighted[0] - 3 * weighted[1]) <= 3


def test_sharding_query_against_the_table(spark, folder):
    names = [f"shard-{i:04d}" for i in range(sharding.SHARDS)]
    table, less = sharding.lookup_table(names), sharding.lookup_table(names[:-1])
    for r in sharding.query(spark, folder).collect():
        slot = int(hashlib.md5(("" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest()[:15], 16) % sharding.TABLE_SIZE
        assert (r.slot, r.shard, r.shard_without_last, r.moved) == (slot, table[slot], less[slot], table[slot] != less[slot])


def test_kneser_ney_against_plain_counts(spark):
    """The ratio of every word by the definition: shared continuation counts below, class counts on top."""
    order, shared, d, top = toxicity.ORDER, toxicity.SHARED_ORDER, toxicity.DISCOUNT, toxicity.TOP_DISCOUNT
    texts = [("rotten apples and rotten lies", 1)] * 4 + [("apples are fine and the river is fine", 0)] * 5 + [("lies", 1), ("été 日本 ſtrasse", 0)]
    table = spark.createDataFrame(texts, "text string, toxic int")
    model = toxicity.KneserNey(toxicity._counts(table, order, shared, top))
    grams = (Counter(), Counter())
    marked = lambda w: chr(2) * (order - 1) + w + chr(3)
    for text, toxic in texts:
        for w in toxicity._words(text.lower()):
            grams[toxic].update(marked(w)[i : i + order] for i in range(len(w) + 1))
    kinds = [Counter(g[order - shared :] for g in set(grams[0]) | set(grams[1]))]
    while len(next(iter(kinds[-1]))) > 1:
        kinds.append(Counter(g[1:] for g in kinds[-1]))

    def lower(g):
        n = len(g)
        own = kinds[shared - n]
        if n == 1:
            return (max(own[g] - d, 0) + d * len(own) / 65536) / sum(own.values())
        under = {k: v for k, v in own.items() if k[:-1] == g[:-1]}
        return (max(own[g] - d, 0) + d * len(under) * lower(g[1:])) / sum(under.values()) if under else lower(g[1:])

    def full(g, own):
        under = {k: v for k, v in own.items() if k[:-1] == g[:-1]}
        p = lower(g[order - shared :])
        return (max(own[g] - top, 0) + sum(min(v, top) for v in under.values()) * p) / sum(under.values()) if under else p

    words = ["rotten", "apples", "lies", "fine", "river", "new", "rot", "日本", "x"]
    want = [sum(math.log(full(marked(w)[i : i + order], grams[1])) - math.log(full(marked(w)[i : i + order], grams[0])) for i in range(len(w) + 1)) for w in words]
    assert np.allclose(model.ratios(words), want)
    assert want[0] > 0.5 and want[3] < 0


def test_toxicity_with_labels_of_one_kind(spark, tmp_path):
    """Nothing to learn: one smoothed share for all, and the pipeline's stage keeps every document."""
    table = docs(spark, TEXTS)
    spark.createDataFrame([(i, 1) for i in range(9)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    model = toxicity.fit(table, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    assert model.language is None and model.prior > toxicity.THRESHOLD
    assert {r.score for r in toxicity.score(table, model).collect()} == {model.prior}
    assert corpus_pipeline.toxic_documents_go(spark, table, str(tmp_path)).count() == len(TEXTS)


def test_toxicity_keeps_columns_and_bounds_its_text(spark):
    texts = [f"rotten lies {i} rotten" for i in range(40)] + [f"the fine river {i}" for i in range(40)] + [None, ""]
    table, labels = docs(spark, texts), spark.createDataFrame([(i, int(i < 40)) for i in range(80)], "doc_id long, toxic int")
    model = toxicity.fit(table, labels)
    out = toxicity.score(table, model)
    assert sorted(out.columns) == sorted(table.columns) and all(0 <= r.score <= 1 for r in out.collect())
    few = toxicity.fit(table, labels, max_chars=250)
    assert 0 < few.prior < 1 and few.language is not None
    assert few.language.top.values.sum() < model.language.top.values.sum()


def test_audio_round_trip_and_resynchronisation():
    payload = mpeg_audio.padded(bytes(range(256)) * 20)
    media = mpeg_audio.mux(payload)
    info = mpeg_audio.probe(media)
    assert info.payload() == payload and info.table["frames"] == len(info.offsets) and info.broken == 0
    assert info.samples == {44100: 1152 * len(info.offsets)}
    noisy = media[: info.offsets[2]] + b"\xff\x00junk\xff" + media[info.offsets[2] :]
    again = mpeg_audio.probe(noisy)
    assert again.payload() == payload and again.skipped == 7
    broken = bytearray(media)
    broken[info.offsets[1] + 8] ^= 1
    assert mpeg_audio.probe(bytes(broken)).broken == 1
    with pytest.raises(ValueError):
        mpeg_audio.probe(bytes(broken)).payload()
    assert mpeg_audio.probe(b"").offsets == []
    # The letters of a closing tag as content, and as a tag.
    ends = mpeg_audio.mux(payload[:64])
    letters = bytearray(mpeg_audio.padded(b"x" * 81 * 4))
    for at in range(len(letters) - 2):
        inside = bytes(letters[:at]) + b"TAG" + bytes(letters[at + 3 :])
        assert mpeg_audio.probe(mpeg_audio.mux(inside)).payload() == inside
    tagged = mpeg_audio.probe(ends + b"TAG" + b"name".ljust(125, b"\0"))
    assert tagged.tags["id3v1_title"] == "name" and tagged.payload() == payload[:64]


def bits_crc(bits):
    """The checksum by long division, bit by bit."""
    crc = 0xFFFF
    for b in bits:
        top = crc >> 15
        crc = crc << 1 & 0xFFFF
        if top != int(b):
            crc ^= 0x8005
    return crc


@pytest.mark.parametrize(("version", "layer", "mode", "extension", "covered"), [
    (3, 3, 3, 0, 17 * 8), (3, 3, 0, 0, 32 * 8), (3, 3, 1, 2, 32 * 8), (2, 3, 3, 0, 9 * 8), (2, 3, 0, 0, 17 * 8), (0, 3, 1, 0, 17 * 8),
    (3, 1, 3, 0, 128), (3, 1, 0, 0, 256), (3, 1, 1, 1, 4 * (8 * 2 + 24)), (3, 2, 3, 0, None), (3, 2, 0, 0, None), (3, 2, 1, 0, None), (2, 2, 0, 0, None),
])
def test_checksums_of_all_layers_and_modes(version, layer, mode, extension, covered):
    rng = np.random.default_rng(version * 100 + layer * 10 + mode)
    media = b""
    for rate in (0, 1, 2):
        head = bytes((0xFF, 0xE0 | version << 3 | (4 - layer) << 1, 9 << 4 | rate << 2, mode << 6 | extension << 4))
        header = mpeg_audio.parse_header(head)
        body = rng.integers(0, 256, header.size - 6, dtype=np.uint8).tobytes()
        stream = "".join(f"{b:08b}" for b in body)
        n = covered
        if n is None:  # Layer II, read as a player would: allocations, then two bits for every one that isn't 0
            channels, mpeg1 = 1 if mode == 3 else 2, version == 3
            each = header.kbps // channels
            widths = [4] * 4 + [3] * 7 + [2] * 19 if not mpeg1 else [4] * 11 + [3] * 12 + [2] * (4 if each < 96 or rate == 1 else 7)
            assert not mpeg1 or each >= 56
            n = used = 0
            for band, w in enumerate(widths):
                for _ in range(1 if mode == 1 and band >= 4 * (extension + 1) else channels):
                    used += (int(stream[n : n + w], 2) > 0) * (channels if mode == 1 and band >= 4 * (extension + 1) else 1)
                    n += w
            n += 2 * used
        crc = bits_crc("".join(f"{b:08b}" for b in head[2:]) + stream[:n])
        media += head + crc.to_bytes(2, "big") + body
        if rate == 1:
            media += head + (crc ^ 1).to_bytes(2, "big") + body
    info = mpeg_audio.probe(media)
    assert (info.checked, info.broken, len(info.offsets), info.skipped) == (4, 1, 4, 0)
    per = 384 if layer == 1 else 576 if layer == 3 and version != 3 else 1152
    rates = [x >> {3: 0, 2: 1, 0: 2}[version] for x in (44100, 48000, 32000)]
    assert info.samples == {rates[0]: per, rates[1]: 2 * per, rates[2]: per}
    assert math.isclose(info.seconds, per / rates[0] + 2 * per / rates[1] + per / rates[2])


def test_audio_query_against_plain_python(spark, folder):
    table = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect() if r.doc_id is not None}
    for r in mpeg_audio.query(spark, folder).collect():
        text = table.get(r.doc_id, WORDS).encode()
        payload = text + bytes(-len(text) % 64 if text else 64)
        media = mpeg_audio.mux(payload)
        assert (r.n_bytes, r.payload_bytes, r.media_bytes) == (len(text), len(payload), len(media))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-64:]) and r.media_sha256 == hashlib.sha256(media).hexdigest()
        assert r.n_frames == len(r.seek_offsets) == -(-len(payload) // max(mpeg_audio.ROOM)) and math.isclose(r.seconds, r.n_frames * 1152 / 44100)
        assert all(media[at : at + 2] == b"\xff\xfa" for at in r.seek_offsets)
        assert f";sum={sum(payload)};power={sum(b * b for b in payload)}" in r.feature and f"samples={r.n_frames * 1152}/44100;" in r.feature


def test_spot_signatures(spark):
    rows = {r.doc_id: r for r in spot_sigs.query(spark, "/root/testdata/sf0.001").collect()}
    table = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    order = sorted(table)

    def spots(text):
        words = [w for w in re.split(r"[\W_]+", text.lower()) if w]
        out = set()
        for i, w in enumerate(words):
            if w in spot_sigs.ANCHORS:
                chain = [x for x in words[i + 1 : i + 1 + spot_sigs.REACH] if x not in spot_sigs.ANCHORS][: spot_sigs.CHAIN]
                if len(chain) == spot_sigs.CHAIN:
                    out.add((w, *chain))
        return out or {tuple(words)}

    for i, doc in enumerate(order):
        text, after = table[doc], table[order[(i + 1) % len(order)]]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r, a, b, c = rows[doc], spots(text), spots(edited), spots(after)
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert math.isclose(r.near_edited, len(a & b) / len(a | b)) and math.isclose(r.near_next, len(a & c) / len(a | c))


@pytest.mark.parametrize("ids", ["dense", "sparse", "one", "none", "mixed"])
def test_next_documents(spark, monkeypatch, ids):
    """Whatever the ids, each row's next text follows in one circle, ids ascend along it, and no range is large."""
    monkeypatch.setattr(spot_sigs, "WIDTH", 4)
    of = {"dense": lambda i: i, "sparse": lambda i: 2**61 + i * 4096 if i % 2 else i * 2**40 - 2**60, "one": lambda i: 7, "none": lambda i: None, "mixed": lambda i: [None, 5, i, 2**62 + i * 8192, -i][i % 5]}[ids]
    rows = [(of(i), f"text {i}") for i in range(200)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.text: (r.doc_id, r._next_text) for r in spot_sigs.with_next(table, {}).collect()}
    assert {t: i for t, (i, _) in got.items()} == {t: i for i, t in rows} and {x for _, x in got.values()} == set(got)
    key = lambda t: spot_sigs.NULL_ID if got[t][0] is None else got[t][0]
    assert sum(key(t) > key(x) for t, (_, x) in got.items()) == (len({key(t) for t in got}) > 1)
    at = rows[0][1]
    for _ in range(200):
        at = got[at][1]
    assert at == rows[0][1]
    assert max(r["count"] for r in spot_sigs._ranges(table).groupBy("_range").count().collect()) <= 16
    same = spark.createDataFrame([(1, "a")] * 3 + [(2, "b")], "doc_id long, text string")
    assert sorted((r.text, r._next_text) for r in spot_sigs.with_next(same, {}).collect()) == [("a", "a"), ("a", "a"), ("a", "b"), ("b", "a")]
    assert spot_sigs.with_next(same.where("doc_id = 2"), {}).first()._next_text == "b" and spot_sigs.with_next(same.limit(0), {}).count() == 0


def test_license_families(spark):
    texts = [f"{WORDS}\n{t}\n{WORDS[::-1]}" for _, t in license_scan.TEMPLATES] + [WORDS] * 5 + ["License to the old mill is granted by the river"]
    table = docs(spark, texts)
    found = {r.doc_id: r.family for r in license_scan.scan(table, license_scan.train(table)).collect()}
    assert found == {i: f for i, (f, _) in enumerate(license_scan.TEMPLATES)}


NOTICES = [
    ("mit", "The code is released under the MIT License."),
    ("apache-2.0", "Our tools are licensed under the Apache License, Version 2.0, like the rest."),
    ("gpl-3.0", "Note: this work is licensed under the GNU General Public License, version 3 only."),
    ("cc-by-4.0", "Photos: this work is licensed under a Creative Commons Attribution 4.0 International License, by Jo."),
    ("bsd-3-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that these conditions are met."),
]
TALK = ["We had a long meeting about which license to choose.", "The driver's license office is closed today.", "Under the river runs a version of the old road.", "Ask for permission before you copy the key.", "The source of the river is open to all.", "Apache pilots flew over the General.", "Public notice: the library is open."]


def test_licenses_against_brute_force(spark):
    """Near wordings are found and talk about licences isn't; windows, threshold and confirmation again in plain Python."""
    texts = [f"{WORDS}\n{t}" for _, t in NOTICES] + [f"{t}\n{WORDS} {i}" for i, t in enumerate(TALK)] + [f"{WORDS} {i}" for i in range(60)] + [None, "", ". . ."]
    table = docs(spark, texts)
    model = license_scan.train(table)
    found = {(r.doc_id, r.paragraph): (r.family, r.probability, r.likeness) for r in license_scan.scan(table, model).collect()}
    assert {d: f for (d, _), (f, _, _) in found.items()} == {i: f for i, (f, _) in enumerate(NOTICES)}
    split = lambda t: [w for w in re.split(r"[\W_]+", t.lower()) if w]
    pairs = lambda ws: set(zip(ws, ws[1:], strict=False))
    runs = {r for _, t in license_scan.TEMPLATES for r in zip(split(t), split(t)[1:], split(t)[2:], strict=False)}
    windows = []
    for d, text in enumerate(texts):
        for p, line in enumerate((text or "").split("\n")):
            ws = split(line)
            windows += [(d, p, ws[i : i + 16]) for i in range(0, max(len(ws) - 8, 1), 8) if ws]
    rows = spark.createDataFrame([(i, [*ws, *(" ".join(x) for x in zip(ws, ws[1:], strict=False))]) for i, (_, _, ws) in enumerate(windows)], "i int, terms array<string>")
    given = {r.i: r.probability.toArray() for r in model.transform(rows).collect()}
    names = license_scan.families()
    best = [(max(range(1, len(names)), key=lambda k: given[i][k]), i) for i in range(len(windows))]
    clean = defaultdict(float)
    for k, i in best:
        d, p, ws = windows[i]
        if given[i][k] >= license_scan.FLOOR and not runs & set(zip(ws, ws[1:], ws[2:], strict=False)):
            clean[d, p] = max(clean[d, p], given[i][k])
    allowed = len({(d, p) for d, p, _ in windows}) // license_scan.FALSE_SHARE
    cut = sorted(clean.values(), reverse=True)[allowed] if len(clean) > allowed else 0
    gathered = defaultdict(lambda: [0.0, set()])
    for k, i in best:
        d, p, ws = windows[i]
        if given[i][k] > cut and given[i][k] >= license_scan.FLOOR or given[i][k] > 0.99:
            own = gathered[d, p, names[k]]
            own[0], own[1] = max(own[0], given[i][k]), own[1] | pairs(ws)
    want = {}
    for (d, p, family), (probability, own) in gathered.items():
        likeness = max(len(x & own) / len(x) for f, t in license_scan.TEMPLATES if f == family and (x := pairs(split(t))))
        if likeness >= license_scan.CONFIRM and (probability, likeness, family) > want.get((d, p), ("", 0, 0))[1:] + ("",):
            want[d, p] = (family, probability, likeness)
    assert found.keys() == want.keys()
    assert all(found[k][0] == want[k][0] and math.isclose(found[k][1], want[k][1]) and math.isclose(found[k][2], want[k][2]) for k in want)


def test_license_notices_within_longer_texts(spark):
    of = lambda family, *starts: " ".join(next(t for f, t in license_scan.TEMPLATES if f == family and t.startswith(x) and len(t) > 80) for x in starts)
    mit = of("mit", "Permission is", "The above", "THE SOFTWARE")
    notices = [
        ("proprietary", "Copyright 2024 Acme Inc. All rights reserved."),
        ("mit", "This package is released under the MIT License, see the accompanying readme for details and credits."),
        ("mit", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
        ("mit", f"MIT License Copyright (c) 2021 Jo Doe {mit}"),
        ("apache-2.0", f"Copyright 2020 The Authors. {of('apache-2.0', 'Licensed', 'You may', 'Unless')}"),
        ("gpl-3.0", f"{WORDS} {of('gpl-3.0', 'This program is free')} {WORDS}"),
        ("cc-by-4.0", f"{WORDS} {WORDS} This work is licensed under a Creative Commons Attribution 4.0 International License. {WORDS} {WORDS}"),
        ("bsd-3-clause", f"Copyright 1999 Ann Roe {of('bsd-3-clause', 'Redistribution and', 'Redistributions of', 'Redistributions in', 'Neither')}"),
    ]
    table = docs(spark, [t for _, t in notices] + [f"{WORDS} {i} {w}" for i, w in enumerate(WORDS.split())])
    found = {r.doc_id: r.family for r in license_scan.scan(table, license_scan.train(table)).collect()}
    assert found == {i: f for i, (f, _) in enumerate(notices)}


def test_boilerplate_goes_and_copies_stay(spark):
    line = "Subscribe to our letter"
    texts = [f"{line}\n{WORDS} number {i} with words of its own\nend {i}" for i in range(9)] + ["copied line one\ncopied line two"] * 10
    out = {r.doc_id: r for r in line_dedup.remove_boilerplate(docs(spark, texts)).collect()}
    assert all(line not in out[i]._clean and out[i]._removed == 1 for i in range(9))
    assert all(out[i]._clean == texts[i] for i in range(9, 19))


def test_pipeline_removes_boilerplate_whatever_its_share(spark):
    line, body = "Subscribe to our letter, it comes on every first day of the month", [f"body line {k}" for k in range(6)]
    mostly = [f"{line}\nown {i}" for i in range(10)]
    near = ["\n".join([*body, f"edit {i}"]) for i in range(10)]
    texts = [*mostly, *["copied line one\ncopied line two"] * 10, *near, line, None, f"{line}\n \n{line}", *["twice\n" + line] * 2]
    stage = {r.doc_id: r for r in corpus_pipeline.boilerplate_lines_go(spark, docs(spark, texts), "").collect()}
    left = {i: r.text for i, r in stage.items()}
    assert [left[i] for i in range(10)] == [f"own {i}" for i in range(10)] and stage[3].n_chars == 5
    assert [left[i] for i in range(10, 21)] == texts[10:21]  # copies, and the first of the near ones
    assert [left[i] for i in range(21, 30)] == [f"edit {i}" for i in range(1, 10)]
    assert [left[i] for i in range(30, len(texts))] == texts[30:]


def test_lm_scores_against_plain_counts(spark):
    texts = [*TEXTS, *[f"{WORDS} {i} {i * i} the fox" for i in range(60)]]
    rows = {r.doc_id: r for r in lm_scoring.score(docs(spark, texts)).collect()}
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    tokens = []
    for t in texts:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        tokens.append([*re.findall(r"[^\x20\x09-\x0D]+", low), None])
    count = Counter(x for i, own in enumerate(tokens) if not held(i) for x in own)
    n, v = sum(count.values()), len(count)
    for i, own in enumerate(tokens):
        r = rows[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i), len(own), sum(count[x] > 0 for x in own), n)
        assert math.isclose(r.base_score, sum(math.log10((count[x] + 1) / (n + v + 1)) for x in own), rel_tol=1e-9)
        assert r.score < 0
    # The model again, with plain dictionaries, one likelihood per token and textbook EM.
    role = lambda i: zlib.crc32(str(i).encode()) % 7
    pairs = [list(zip(["<s>", *own[:-1]], own, strict=True)) for own in tokens]
    tune = [i for i in range(len(texts)) if role(i) == lm_scoring.TUNING]
    rest = [i for i in range(len(texts)) if not held(i) and role(i) != lm_scoring.TUNING]
    of = lambda ids: (Counter(x for i in ids for x in tokens[i]), Counter(p for i in ids for p in pairs[i]), Counter(h for i in ids for h, _ in pairs[i]))
    bucket = lambda c: min(c.bit_length(), lm_scoring.BUCKETS - 1)

    def likelihoods(h, w, words, two, before):
        return np.array([1 / (v + 1), words[w] / sum(words.values()), two[h, w] / before[h] if before[h] else 0.0])

    def learn(x, lean, strength):
        a = np.full(3, 1 / 3)
        for _ in range(lm_scoring.ROUNDS):
            part = a * x
            part /= part.sum(1, keepdims=True)
            a = part.sum(0) + lean * strength
            a /= a.sum()
        return a

    counts = of(rest)
    step = lambda q: 2.0 ** (-round(-math.log2(q) * lm_scoring.STEP) / lm_scoring.STEP) if q > 0 else 0.0  # noqa: E731  as grouped for the EM
    seen = defaultdict(list)
    for i in tune:
        for h, w in pairs[i]:
            x = likelihoods(h, w, *counts)
            seen[bucket(counts[2][h])].append([x[0], step(x[1]), step(x[2])])
    mean = learn(np.array([x for own in seen.values() for x in own]), np.full(3, 1 / 3), 1.0)
    weights = {b: learn(np.array(own), mean, 20.0) for b, own in seen.items()}
    final = of([*rest, *tune])
    for i, own in enumerate(pairs):
        want = 0.0
        for h, w in own:
            a = weights.get(bucket(final[2][h]), mean).copy()
            if not final[2][h]:
                a[2] = 0
                a /= a.sum()
            want += math.log10(a @ likelihoods(h, w, *final))
        assert math.isclose(rows[i].score, want, rel_tol=1e-6), (i, rows[i].score, want)
    test = [i for i in rows if held(i)]
    assert sum(rows[i].score for i in test) > sum(rows[i].base_score for i in test)


def test_lm_groups_of_blocks_ask_for_them(spark, folder, monkeypatch):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    plain = {r.doc_id: r for r in lm_scoring.score(docs).collect()}
    monkeypatch.setattr(lm_scoring, "FANOUT", 2)
    monkeypatch.setattr(lm_scoring, "BLOCK_BYTES", 1 << 10)
    slices, fine, groups, _ = lm_scoring._sizes(docs)
    assert slices > 1 and fine > 1 and groups > 1
    grouped = {r.doc_id: r for r in lm_scoring.score(docs).collect()}
    assert grouped == plain


def test_lm_numbers_packed_in_the_least_width():
    rng = np.random.default_rng(1)
    ones = np.ones(1000, np.uint64)
    for x in (ones[:0], ones - ones, np.array([255, 254, 0, 256, 2**64 - 1], np.uint64), rng.integers(0, 2**63, 500).astype(np.uint64), np.concatenate((ones, [255, 300, 2**40])).astype(np.uint64)):
        raw = lm_scoring._packed(x)
        assert (lm_scoring._unpacked(raw, len(x)) == x).all() and len(raw) <= 1 + 8 * len(x)
    assert len(lm_scoring._packed(np.concatenate((ones, [300])).astype(np.uint64))) == 1 + 1001 + 8
    keys = np.unique(rng.integers(0, 2**63, 5000).astype(np.uint64))
    raw = lm_scoring._squeezed(keys)
    assert (lm_scoring._unsqueezed(raw, len(keys)) == keys).all() and len(raw) < 7.01 * len(keys)
