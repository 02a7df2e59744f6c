"""CSV files of any size as sections, read in splits.

A split does not tell whether it begins inside a quoted field. But at the start of a line only two states are possible, in a
quoted field or between records; so each piece of a file says in which state it ends for either, and following these in
order, without the texts, gives the state in which each piece begins. Then every piece parses the records that begin in it,
wherever it is, and records that reach over pieces are put together by themselves. The rows are those of
files.csv_blocks, which parses one file in one task.
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import clean_text
from ..ranges import row_numbers
from ..storage import materialize
from .files import NA_WORDS, ROWS_PER_SECTION

#: Bytes of a piece; a split is dealt into pieces of about that size.
PIECE = 1 << 20
_END = re.compile(rb"[,\r]")


def ends_quoted(line: bytes, quoted: bool) -> bool:
    """Whether the end of a line, its line feed included, lies in a quoted field, if its start does or does not. Quotes count
    at the start of a field only; a carriage return outside quotes ends a record."""
    i = 0
    while True:
        if quoted:
            i = line.find(b'"', i)
            if i < 0:
                return True
            if line[i + 1 : i + 2] == b'"':
                i += 2
                continue
            quoted = False
        elif line[i : i + 1] == b'"':
            quoted = True
            i += 1
            continue
        end = _END.search(line, i)
        if end is None:
            return False
        i = end.end()


def _pieces(batches, size: int):
    """(path, block, piece, text, from_record, from_quoted, valid) of runs of whole lines."""
    names = ["path", "block", "piece", "text", "from_record", "from_quoted", "valid"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.bool_(), pa.bool_(), pa.bool_()]
    at, n, held, length, states = None, 0, [], 0, [False, True]

    def out():
        text = b"".join(held)
        try:
            text.decode()
            valid = True
        except UnicodeDecodeError:
            valid = False
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((*at, n, text, *states, valid), kinds)], names=names)

    for b in batches:
        for path, block, line in zip(*[b.column(i).to_pylist() for i in range(3)]):
            if at is not None and (at != (path, block) or length >= size):
                yield out()
                n, held, length, states = (n + 1 if at == (path, block) else 0), [], 0, [False, True]
            at = (path, block)
            held.append(line + b"\n")
            length += len(line) + 1
            states = [ends_quoted(line, s) if b'"' in line else s for s in states]
    if at is not None:
        yield out()


def _states(pieces: DataFrame) -> DataFrame:
    """(path, block, piece, quoted): whether a piece begins in a quoted field. A piece either sets the state whatever it was,
    or keeps it, or turns it over; the last that set it and the turns since then tell."""
    order = W.partitionBy("path").orderBy("block", "piece")
    sets = F.when(F.col("from_record") == F.col("from_quoted"), F.col("from_record"))
    turns = (F.col("from_record") & ~F.col("from_quoted")).cast("int")
    told = pieces.select("path", "block", "piece", sets.alias("sets"), turns.alias("turn"))
    told = told.withColumn("turns", F.sum("turn").over(order.rowsBetween(W.unboundedPreceding, 0)))
    last = F.last(F.when(F.col("sets").isNotNull(), F.struct("sets", "turns")), ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1))
    seen = F.coalesce(F.lag("turns").over(order), F.lit(0))
    told = told.withColumn("last", last).withColumn("seen", seen)
    turned = (F.col("seen") - F.coalesce("last.turns", F.lit(0))) % 2 == 1
    return told.select("path", "block", "piece", (F.coalesce("last.sets", F.lit(False)) != turned).alias("quoted"))


def _cut(text: bytes, quoted: bool) -> tuple[bytes, bytes, bytes]:
    """A piece in what belongs to a record begun before it, the records that begin and end in it, and one that goes on."""
    if b'"' not in text:
        return (text, b"", b"") if quoted else (b"", text, b"")
    at, first, last, state = 0, None, 0, quoted
    while at < len(text):
        end = text.find(b"\n", at) + 1
        if not state:
            first, last = at if first is None else first, at
        line = text[at : end - 1]
        state = ends_quoted(line, state) if b'"' in line else state
        at = end
    if first is None:
        return text, b"", b""
    return text[:first], text[first : last if state else len(text)], text[last:] if state else b""


def _records(text: bytes, utf8: bool) -> Iterator[list[str]]:
    return csv.reader(io.StringIO(text.decode("utf-8" if utf8 else "latin-1"), newline=""))


_MISSING = frozenset(NA_WORDS)


def _cells(row: list[str]) -> list[str | None]:
    """Cells without outer blanks, null for what stands for nothing."""
    return [None if (v := x.strip()) in _MISSING else v for x in row]


_ROW = [("path", pa.string()), ("block", pa.int64()), ("piece", pa.int64()), ("row", pa.int64()), ("part", pa.int64()), ("cells", pa.list_(pa.string())), ("names", pa.list_(pa.string())), ("fragment", pa.binary())]
_ROW_TYPE = "path string, block long, piece long, row long, part long, cells array<string>, names array<string>, fragment binary"


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    while part := list(islice(rows, 5000)):
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*part), _ROW)], names=[n for n, _ in _ROW])


def _parsed(batches):
    """A row for each record of a piece, and one with a fragment for each record over several pieces that begins (row is not
    null) or goes on in it. names are the cells as they are written, of first records, which may be headers."""

    def rows():
        for b in batches:
            for path, block, piece, text, quoted, utf8 in zip(*[b.column(i).to_pylist() for i in range(6)]):
                head, body, tail = _cut(text, quoted)
                n = 0
                if head:
                    yield path, block, piece, None, 0, None, None, head
                for n, row in enumerate(_records(body, utf8), 1):
                    yield path, block, piece, n, 0, _cells(row), row if n == 1 else None, None
                if tail:
                    yield path, block, piece, n + 1, 0, None, None, tail

    yield from _batches(rows())


def _joined(batches):
    """Records over several pieces; a carriage return can end more than one in their last line."""

    def rows():
        for b in batches:
            for path, block, piece, row, text, utf8 in zip(*[b.column(i).to_pylist() for i in range(6)]):
                for n, record in enumerate(_records(text, utf8)):
                    yield path, block, piece, row, n, _cells(record), record if n == 0 else None, None

    yield from _batches(rows())


def sections(spark: SparkSession, path: str | list[str], size: int = ROWS_PER_SECTION, piece: int = PIECE) -> DataFrame:
    """(file_path, section_index, text, source_type, columns, row_range) of CSV files: blocks of `size` rows that are not empty,
    as files.csv_sections gives them for files that a task can hold. Files whose lines end with carriage returns alone are one
    piece. A record is one row of one task, however long it is."""
    lines = spark.read.option("lineSep", "\n").text(path).select("_metadata.file_path", "_metadata.file_block_start", F.col("value").cast("binary"))
    schema = "path string, block long, piece long, text binary, from_record boolean, from_quoted boolean, valid boolean"
    pieces = materialize(lines.mapInArrow(lambda x: _pieces(x, piece), schema), "pieces")
    valid = pieces.groupBy("path").agg(F.bool_and("valid").alias("utf8"))
    told = pieces.select("path", "block", "piece", "text").join(materialize(_states(pieces), "states"), ["path", "block", "piece"]).join(valid, "path")
    parsed = materialize(told.select("path", "block", "piece", "text", "quoted", "utf8").mapInArrow(_parsed, _ROW_TYPE), "records")
    # a fragment goes to the piece in which its record begins: the last one up to it with a record that goes on
    order = W.partitionBy("path").orderBy("block", "piece", F.col("row").isNotNull())
    begun = F.last(F.when(F.col("row").isNotNull(), F.struct("block", "piece", "row")), ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0))
    parts = parsed.filter("fragment is not null").withColumn("of", begun)
    whole = parts.groupBy("path", "of").agg(F.array_sort(F.collect_list(F.struct("block", "piece", "fragment"))).alias("x")).join(valid, "path")
    text = F.aggregate("x", F.lit(b""), lambda held, x: F.concat(held, x["fragment"]))
    long_ones = whole.select("path", "of.block", "of.piece", "of.row", text.alias("text"), "utf8").mapInArrow(_joined, _ROW_TYPE)
    records = parsed.filter("fragment is null").unionByName(long_ones).drop("fragment")
    place = F.struct("block", "piece", "row", "part")
    header = materialize(records.filter("names is not null").groupBy("path").agg(F.min_by("names", place).alias("header"), F.min(place).alias("first")), "headers")
    rows = records.join(header, "path").filter((place != F.col("first")) & (F.size("cells") <= F.size("header")))
    named = F.zip_with("header", "cells", lambda name, value: F.when(value.isNotNull(), F.concat(name, F.lit(": "), value)))
    rows = rows.select("path", "block", "piece", "row", "part", F.array_join(named, "\n").alias("line"), F.array_join("header", ", ").alias("columns"))
    numbered = row_numbers(rows.filter("line <> ''"), "path", ["block", "piece", "row", "part"], "rn").withColumn("section_index", F.floor((F.col("rn") - 1) / size).cast("int"))
    blocks = numbered.groupBy("path", "section_index", "columns").agg(F.array_sort(F.collect_list(F.struct("rn", "line"))).alias("x"))
    span = F.concat_ws("-", F.array_min("x.rn").cast("string"), F.array_max("x.rn").cast("string"))
    body = clean_text(F.array_join("x.line", "\n\n"))
    return blocks.select(F.col("path").alias("file_path"), "section_index", body.alias("text"), F.lit("csv").alias("source_type"), "columns", span.alias("row_range")).filter("text <> ''")
