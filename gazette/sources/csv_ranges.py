"""S1 for large files: CSV whose quoted values may hold line breaks, read in many tasks, with row_id in file order.

Spark splits text files into ranges of bytes and gives each whole lines. Whether a line begins within a
quoted value depends on all lines before it, so a first pass tells for each range where it would end (inside
or outside of quotes) and how many records would begin in it, for either way it could begin. Prefix sums over the ranges in
the order of files by name and of places say how each one does begin and what its first record's
number is. A second pass joins lines to records and numbers them; a record that runs over ranges is put together
from its pieces. Records are taken apart by Spark's own CSV parser.

The driver holds four numbers a range (some 100 bytes per 128 MB of input) and sends the tasks as much; lines stay in the tasks. Both
passes must see the same ranges: a session whose number of cores changes between them gets an error, not
wrong rows (spark.sql.files.minPartitionNum pins the ranges).

Defined results: lines end with LF or CRLF; a value is quoted if a quote is its first character; what stands
after its closing quote goes up to the next separator; a last value without a closing quote goes on to the end of its file. Each
file begins with a header, whose names are those of the first file; a byte order mark is dropped. row_id counts records from 0
over all files, empty ones too. No file is PATH_NOT_FOUND, files without a line have no rows.
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazette.functions.scalars import headers

_CLOSED = re.compile(r'(?:[^"]|"")*"(?!")')
RANGE = "file string, start long, lines long, ends_out boolean, records_out long, ends_in boolean, records_in long"
BOM = "﻿"


def ends_inside(line: str, inside: bool) -> bool:
    """Whether the state after the line's end is within a quoted value, given the state before it."""
    at = 0
    while True:
        if inside:
            closed = _CLOSED.match(line, at)
            if not closed:
                return True
            at = closed.end()
        elif line[at : at + 1] == '"':
            at, inside = at + 1, True
            continue
        comma = line.find(",", at)
        if comma < 0:
            return False
        at, inside = comma + 1, False


def _lines(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.text(path, lineSep="\n")
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").alias("line"))


def _segments(batch: pa.RecordBatch) -> Iterator[tuple[str, int, pa.Array]]:
    """The runs of lines of one range in a batch."""
    files, starts = batch.column(0).dictionary_encode(), batch.column(1).to_numpy()
    codes = files.indices.to_numpy()
    cuts = np.flatnonzero((np.diff(codes) != 0) | (np.diff(starts) != 0)) + 1
    for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
        if high > low:
            yield files.dictionary[int(codes[low])].as_py(), int(starts[low]), batch.column(2).slice(low, high - low)


def _quoted(lines: pa.Array) -> np.ndarray:
    return np.flatnonzero(pc.match_substring(lines, '"').to_numpy(zero_copy_only=False))


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """RANGE: for each range and either state before it the state after it and the records that begin in it."""
    at, lines_so_far, states, records = None, 0, [False, True], [0, 0]

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"file": at[0], "start": at[1], "lines": lines_so_far, "ends_out": states[0], "records_out": records[0], "ends_in": states[1], "records_in": records[1]}])

    for batch in batches:
        for file, start, lines in _segments(batch):
            if (file, start) != at:
                if at:
                    yield row()
                at, lines_so_far, states, records = (file, start), 0, [False, True], [0, 0]
            before, done = list(states), 0
            for i in _quoted(lines).tolist():
                line = _text(lines[i].as_py(), lines_so_far + i == 0 and start == 0)
                for k in (0, 1):
                    records[k] += 0 if before[k] else i - done
                    records[k] += not before[k]
                    before[k] = ends_inside(line, before[k])
                done = i + 1
            for k in (0, 1):
                records[k] += 0 if before[k] else len(lines) - done
            states, lines_so_far = before, lines_so_far + len(lines)
    if at:
        yield row()


def _text(line: str, first: bool) -> str:
    return line.removeprefix(BOM) if first else line


class _Begin:
    """How a range begins: its number, whether inside of quotes, the number of its first record, and the records before its file's."""

    __slots__ = ("number", "inside", "record", "base")

    def __init__(self, number: int, inside: bool, record: int, base: int):
        self.number, self.inside, self.record, self.base = number, inside, record, base


def _combined(ranges: list) -> tuple[dict[tuple[str, int], _Begin], bool]:
    """Each range's beginning, from the summaries in the order of files and places; whether any begins inside."""
    out, file, inside, record, base, any_inside = {}, None, False, 0, 0, False
    for number, r in enumerate(sorted(ranges, key=lambda r: (r.file.encode(), r.start))):
        if r.file != file:
            base += max(0, record - 1)
            file, inside, record = r.file, False, 0
        out[r.file, r.start] = _Begin(number, inside, record, base)
        any_inside |= inside
        record += r.records_in if inside else r.records_out
        inside = r.ends_in if inside else r.ends_out
    return out, any_inside


def _records(batches: Iterator[pa.RecordBatch], begins: dict[tuple[str, int], _Begin], last: dict[str, int], pieces: bool) -> Iterator[pa.RecordBatch]:
    """row_id, number and record: the records that lie in one range, or the pieces of the others with the number of their range.

    A file's header is its record 0. A record that a file's end leaves open is whole if it began in the file's last range.
    """
    at, begin, inside, record, pending, head = None, None, False, 0, [], False

    def opened(range_at, number: int) -> list[tuple]:
        """What is left open at a range's end."""
        if not pending:
            return []
        whole = not head and last[range_at[0]] == number
        row = (begin.base + record - 1 if record else -1, number, "\n".join(pending))
        return [row] if pieces != whole and record else []

    def batch_of(ids, numbers, texts) -> pa.RecordBatch:
        text = pc.replace_substring_regex(texts, "\r$", "") if not pieces else texts
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(numbers, pa.int32()), text], ["row_id", "number", "record"])

    def rows(out: list[tuple]) -> Iterator[pa.RecordBatch]:
        if out:
            yield batch_of([x[0] for x in out], [x[1] for x in out], pa.array([x[2] for x in out], pa.string()))

    for batch in batches:
        for file, start, lines in _segments(batch):
            fresh = (file, start) != at
            if fresh:
                if at:
                    yield from rows(opened(at, begin.number))
                at, begin = (file, start), begins.get((file, start))
                if begin is None:
                    raise ValueError(f"the ranges of {file} have changed since they were counted; pin them by spark.sql.files.minPartitionNum")
                inside, record, pending, head = begin.inside, begin.record - begin.inside, [], begin.inside
            quoted, out, done = _quoted(lines), [], 0

            def plain(low: int, high: int) -> Iterator[pa.RecordBatch]:
                """Lines without a quote: records each, or all part of the open one."""
                nonlocal record
                if high <= low:
                    return
                if inside:
                    pending.extend(lines.slice(low, high - low).to_pylist())
                    return
                if not pieces:
                    skip = 1 if record == 0 else 0
                    n = high - low - skip
                    if n:
                        yield batch_of(begin.base + record + skip - 1 + np.arange(n), np.full(n, begin.number), lines.slice(low + skip, n))
                record += high - low

            for i in quoted.tolist():
                yield from plain(done, i)
                line = _text(lines[i].as_py(), fresh and i == 0 and start == 0)
                pending.append(line)
                inside = ends_inside(line, inside)
                if not inside:
                    if record and pieces == head:
                        out.append((begin.base + record - 1, begin.number, "\n".join(pending)))
                    record, head = record + 1, False
                    pending.clear()
                done = i + 1
            yield from rows(out)
            yield from plain(done, len(lines))
    if at:
        yield from rows(opened(at, begin.number))


def _header(lines: DataFrame, file: str) -> list[str]:
    """The cells of a file's first record, of a thousand lines at most."""
    inside, record = False, []
    for i, row in enumerate(lines.where((F.col("file") == file) & (F.col("start") == 0)).select("line").limit(1000).collect()):
        line = _text(row.line, i == 0)
        record.append(line)
        inside = ends_inside(line, inside)
        if not inside:
            break
    return next(csv.reader(io.StringIO("\n".join(record).removesuffix("\r"), newline="")), [])


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records below path as string columns, named by the normalised header, with row_id."""
    lines = _lines(spark, path)
    ranges = lines.mapInArrow(_summaries, RANGE).collect()  # a row per range
    if not ranges:
        return spark.createDataFrame([], "row_id long")
    begins, any_inside = _combined(ranges)
    last = {}
    for (file, _), begin in begins.items():
        last[file] = max(last.get(file, 0), begin.number)
    names = _header(lines, min(last, key=str.encode))
    if not names:
        return spark.createDataFrame([], "row_id long")
    schema = "row_id long, number int, record string"
    records = lines.mapInArrow(lambda batches: _records(batches, begins, last, False), schema).select("row_id", "record")
    if any_inside:
        piece = lines.mapInArrow(lambda batches: _records(batches, begins, last, True), schema)
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", "record"))), lambda x: x["record"]), "\n")
        records = records.unionByName(piece.groupBy("row_id").agg(F.regexp_replace(joined, "\r$", "").alias("record")))
    fields = ", ".join(f"c{i} string" for i in range(len(names)))
    parsed = records.select("row_id", F.from_csv("record", fields, {"escape": '"', "mode": "PERMISSIVE"}).alias("r"))
    return parsed.select(*[F.col(f"r.c{i}").alias(f"c{i}") for i in range(len(names))], "row_id").toDF(*headers(names, ("row_id",)), "row_id")

