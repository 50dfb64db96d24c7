"""Operator 12: passages that repeat, by relative Lempel-Ziv parsing.

The reference is the collection itself. Blocks of documents are indexed by their windows of WORDS
words: of each distinct window the block gives the least doc_id that has it and its place there. Slices
of the window space hold that part of every block's index, and tell every block which of its windows
start in a lesser document, in the least one, and where. A block's documents are then factored greedily from
left to right: a factor begins at the next window that has a source and goes on while the
following windows have theirs at the following places of the same document; it ends WORDS - 1 words after its
last window. At a factor's boundary the windows that lie across it are looked at by themselves, so that a passage
that begins in one source and ends in another is covered as well: the factor of such a window
overlaps the one before. Windows whose first document is the document itself are literals. Every factor has at least
WORDS words and is a duplicate span; what lies in none is kept.

Windows are judged on the input, not on what is left. They are compared by 64-bit hashes: two of n different
windows are taken for one with odds of n^2 / 2^65, three in ten thousand for 10^8 of them; of
10^13 about one in two million is taken for another one.

Defined results: null and empty texts have no words and keep an empty text; fewer than WORDS words
are no window; documents with equal ids aren't sources of each other; a null id is taken as
larger than every other, so such rows are no sources; repeated rows have equal results; words are
compared with their case, whatever white space stands between them. A kept text is its words joined by single
spaces. Long texts are taken whole, one in a block of its own. Other columns aren't looked at. An
empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazette.llm import exchange
from gazette.llm.common import documents
from gazette.sources.tables import Workspace, materialise

WORDS = 13
NO_ID = 2**63 - 1
#: Bytes of text of a block, and of a slice's share: a window is one key a word, a third of what phrases are.
BLOCK_BYTES, SLICE_BYTES = 8 << 20, 16 << 20
RESULT = "doc_id long, n_words long, n_removed long, kept string, factors array<struct<start:long,length:long,source_id:long,source_start:long>>"


def windows(row: dict, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a block: its documents' order by id, their ids in it, words per document, the window hash at each word, and whether it is one document's."""
    ids = np.array([NO_ID if x is None else x for x in row["tags"]], np.int64)
    order = np.argsort(ids, kind="stable")
    values, codes, per, found = exchange.texts(row), exchange.Codes(), np.zeros(len(order), np.int64), []
    for k, i in enumerate(order.tolist()):
        words = values[i].split()
        per[k] = len(words)
        found.append(np.fromiter(map(codes.__getitem__, words), np.int32, len(words)))
    word = codes.hashes()[np.concatenate(found)] if len(codes) else np.zeros(0, np.uint64)
    window = np.zeros(len(word), np.uint64)
    if len(word) >= n:
        window[: len(word) - n + 1] = exchange.run_hashes(word, n)
    inside = np.arange(len(word)) + n <= np.repeat(np.cumsum(per), per)
    return order, ids[order], per, window, inside


def _indexed(row: dict, n: int):
    """A block's index: sorted distinct windows, the least document's id and place for each; and the window at each place."""
    order, ids, per, window, inside = windows(row, n)
    doc = np.repeat(np.arange(len(per)), per)
    place = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
    keys, first, at = np.unique(window[inside], return_index=True, return_inverse=True)
    where = np.flatnonzero(inside)[first]  # documents go by id, so the first place is in the least one
    return order, ids, per, doc, place, inside, keys, ids[doc[where]], place[where], at


def _requested(stored: DataFrame, n: int, n_slices: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                _, ids, *_, keys, source, start, _ = _indexed(row, n)
                if len(keys):
                    base = int(ids[0])
                    yield from exchange.requests(row, keys, n_slices, base, (source.view(np.uint64) - np.uint64(base % 2**64)), start)

    return stored.mapInArrow(run, exchange.REQUESTS)


def _sources(rows: list[dict]) -> list[tuple]:
    """Of a slice's requests the answers: keys that a lesser document has, its id and the place there."""
    keys, at = exchange.united(rows)
    sizes = [r["n"] for r in rows]
    base = np.repeat(np.array([r["base"] for r in rows], np.int64), sizes)
    ids, places = exchange.numbers(rows, "first") + base, exchange.numbers(rows, "second")
    order = np.lexsort((places, ids, at))
    least = order[np.flatnonzero(np.diff(at[order], prepend=-1))]
    lesser = ids[least][at] < ids
    out, begin = [], 0
    for r in rows:
        own = slice(begin, begin + r["n"])
        begin += r["n"]
        flagged = lesser[own]
        if flagged.any():
            source = least[at[own][flagged]]
            low = int(ids[source].min())
            out.append((r["slice"], r["block"], r["n"], low, np.packbits(flagged).tobytes(), exchange.packed((ids[source] - low).view(np.uint64)), exchange.packed(places[source])))
        else:
            out.append((r["slice"], r["block"], r["n"], 0, np.packbits(flagged).tobytes(), b"", b""))
    return out


def factors(source: np.ndarray, place: np.ndarray, n: int = WORDS) -> list[tuple[int, int, int, int]]:
    """(start, length, source, place there) of one document's greedy factors, from each window's source (-1 without one) and place there."""
    at = np.flatnonzero(source >= 0)
    if not len(at):
        return []
    goes_on = (np.diff(at) == 1) & (np.diff(source[at]) == 0) & (np.diff(place[at]) == 1)
    begin = np.concatenate(([0], np.flatnonzero(~goes_on) + 1))
    end = np.concatenate((begin[1:], [len(at)])) - 1
    return list(zip(at[begin].tolist(), (at[end] - at[begin] + n).tolist(), source[at[begin]].tolist(), place[at[begin]].tolist(), strict=True))


def _parsed(row: dict, answers: list[dict], n: int):
    order, ids, per, doc, _, inside, keys, own_source, own_start, at = _indexed(row, n)
    source, start = own_source.copy(), own_start.copy()
    if len(keys):
        found = exchange.flags(answers)
        if len(found) != len(keys):
            raise ValueError(f"{len(found)} answers for {len(keys)} windows")
        hits = [(int(np.unpackbits(np.frombuffer(r["flags"], np.uint8), count=r["n"]).sum()), r) for r in answers]
        source[found] = np.concatenate([exchange.unpacked(r["first"], m).astype(np.int64) + r["base"] for m, r in hits])
        start[found] = np.concatenate([exchange.unpacked(r["second"], m).astype(np.int64) for m, r in hits])
    # Sources by number: ids can be any longs, -1 says there is none.
    known, number = np.unique(source, return_inverse=True)
    by_place = np.full(len(doc), -1, np.int64)
    starts = np.zeros(len(doc), np.int64)
    places = np.flatnonzero(inside)
    lesser = source[at] < ids[doc[places]]
    by_place[places[lesser]] = number[at[lesser]]
    starts[places[lesser]] = start[at[lesser]]
    texts, ends, out = exchange.texts(row), np.cumsum(per), []
    for k, (i, to) in enumerate(zip(order.tolist(), ends.tolist(), strict=True)):
        own = slice(to - int(per[k]), to)
        spans = factors(by_place[own], starts[own], n)
        words = texts[i].split()
        gone = np.zeros(len(words) + 1, np.int64)
        for begin, length, *_ in spans:
            gone[begin] += 1
            gone[begin + length] -= 1
        keep = np.cumsum(gone[:-1]) == 0
        kept = [w for w, k in zip(words, keep.tolist(), strict=True) if k] if spans else words
        out.append((row["tags"][i], len(words), len(words) - len(kept), b" ".join(kept).decode("utf-8", "replace"), [{"start": a, "length": b, "source_id": int(known[c]), "source_start": d} for a, b, c, d in spans]))
    span = pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "length", "source_id", "source_start")]))
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), span)
    yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], kind) for c, kind in enumerate(kinds)], ["doc_id", "n_words", "n_removed", "kept", "factors"])


def parse(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """RESULT for each row of docs (doc_id, text): its number of words, of those in duplicate spans, the text of the others, and the factors."""
    with Workspace(docs.sparkSession, "substring") as tables:
        stored = exchange.written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id", tables, BLOCK_BYTES)
        n_slices = exchange.slices(docs, SLICE_BYTES)
        answers = tables.write(exchange.answered(_requested(stored, words, n_slices), _sources), "answers")
        return materialise(exchange.met(stored, answers, lambda row, own: _parsed(row, own, words), RESULT), "substring-parsed")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), p AS (
  SELECT doc_id, i, array_to_string(ws[i : i + 12], ' ') AS win FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 12)) AS i FROM w)
), f AS (
  SELECT win, min(doc_id) AS first FROM p GROUP BY win
), d AS (
  SELECT doc_id, i FROM p JOIN f USING (win) WHERE first < doc_id
), g AS (
  SELECT DISTINCT doc_id, unnest(generate_series(i, i + 12)) AS pos FROM d
), k AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS kept
  FROM (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM w) ANTI JOIN g USING (doc_id, pos) GROUP BY doc_id
), n AS (
  SELECT doc_id, count(*) AS n_removed FROM g GROUP BY doc_id
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id) LEFT JOIN n USING (doc_id)
"""
