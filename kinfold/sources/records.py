"""CSV records found in parallel, also where quoted cells hold line breaks.

The file is read in byte blocks, as plain lines, so a large file gives as many tasks as its bytes ask for. Whether a line begins inside a
quoted cell depends on all lines before it, but only through one bit: every block is first read as a map of that bit (what it is at the end
of the block if it was 0 or 1 at the start), the maps of a file are applied one after the other, and then each block knows how it begins.
A record that goes over a border of blocks is put together from its pieces; all others never leave their task."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OPENING = re.compile(',"')
_ROWS = 1 << 14


def _closing(line: str, at: int) -> int:
    """The place behind the quote that closes a cell, or -1. Doubled quotes belong to the cell."""
    while (quote := line.find('"', at)) >= 0:
        if line[quote + 1 : quote + 2] != '"':
            return quote + 1
        at = quote + 2
    return -1


def open_after(line: str, inside: bool) -> bool:
    """Whether a quoted cell is open at the end of a line that begins inside or outside of one. A quote opens a cell only as
    its first character."""
    if '"' not in line:
        return inside
    at = 0
    if inside or line[0] == '"':
        at = _closing(line, 0 if inside else 1)
    while at >= 0:
        opening = _OPENING.search(line, at)
        if not opening:
            return False
        at = _closing(line, opening.end())
    return True


def _lines(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], pa.Array]]:
    """The lines of a task, block by block, some at a time."""
    for batch in batches:
        if not len(batch):
            continue
        file, start = batch.column("file"), batch.column("start")
        # A task may hold blocks of several files one after the other, and these may begin at the same byte.
        ends = {end for column in (file, start) for end in pc.run_end_encode(column).run_ends.to_pylist()}
        begin = 0
        for end in sorted(ends):
            yield (file[begin].as_py(), start[begin].as_py()), batch.column("value").slice(begin, end - begin)
            begin = end


def _quoted(lines: pa.Array) -> bool:
    return bool(pc.any(pc.match_substring(lines, '"')).as_py())


def _block_maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per block: the state at its end if it begins outside or inside of a cell, and whether a record begins in it in the latter case."""
    key, state = None, (False, True, False)

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([dict(zip(("file", "start", "outside", "inside", "begins"), (*key, *state), strict=True))])

    for block, lines in _runs(batches):
        if block != key:
            if key is not None:
                yield row()
            key, state = block, (False, True, False)
        outside, inside, begins = state
        if _quoted(lines):
            for line in lines.to_pylist():
                begins |= not inside
                outside, inside = open_after(line, outside), open_after(line, inside)
        else:
            begins |= not inside
        state = (outside, inside, begins)
    if key is not None:
        yield row()


def _open_blocks(table: pa.Table) -> pa.Table:
    """Of a file's blocks: those that begin inside a cell, and the block in which that record begins."""
    inside, owner, found = False, 0, []
    for block in sorted(table.to_pylist(), key=lambda b: b["start"]):
        if inside:
            found.append({"file": block["file"], "start": block["start"], "owner": owner})
        if not inside or block["begins"]:
            owner = block["start"]
        inside = block["inside"] if inside else block["outside"]
    return pa.Table.from_pylist(found, schema=pa.schema([("file", pa.string()), ("start", pa.int64()), ("owner", pa.int64())]))


_PIECE = pa.schema([("file", pa.string()), ("owner", pa.int64()), ("part", pa.int64()), ("whole", pa.bool_()), ("first", pa.bool_()), ("text", pa.string())])


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """``first, text``: the records of CSV files, with ``first`` for the one a file begins with. Empty lines are no records; line
    breaks inside of cells are single line feeds."""
    lines = _lines(spark, path)
    maps = lines.mapInArrow(_block_maps, "file string, start long, outside boolean, inside boolean, begins boolean")
    opened = maps.groupBy("file").applyInArrow(_open_blocks, "file string, start long, owner long").collect()  # fewer than blocks of bytes
    owners = spark.sparkContext.broadcast({(r["file"], r["start"]): r["owner"] for r in opened})

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = owners.value
        block, held, owner, inside, first = None, [], 0, False, False

        def batch(texts: list[str] | pa.Array, whole: bool, is_first: bool = False) -> pa.RecordBatch:
            n = len(texts)
            columns = ([block[0]] * n, [owner] * n, [block[1]] * n, [whole] * n, [is_first] * n, texts)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _PIECE.types, strict=True)], schema=_PIECE)

        for key, lines in _runs(batches):
            if key != block:
                if held:
                    yield batch(["\n".join(held)], False, first)
                block, held = key, []
                inside = key in known
                owner = known.get(key, key[1])
                first = key[1] == 0
                leading = inside  # the lines at hand belong to a record of an earlier block
            if not inside and not first and not _quoted(lines):
                yield batch(lines, True)
                continue
            done = []
            for line in lines.to_pylist():
                held.append(line)
                inside = open_after(line, inside)
                if inside:
                    continue
                text = "\n".join(held)
                held = []
                if leading:
                    yield batch([text], False)
                    leading, owner = False, key[1]
                elif first:
                    if text.rstrip("\r"):
                        yield batch([text], True, True)
                        first = False
                else:
                    done.append(text)
                    if len(done) >= _ROWS:
                        yield batch(done, True)
                        done = []
            if done:
                yield batch(done, True)
        if held:
            yield batch(["\n".join(held)], False, first)

    pieces = lines.mapInArrow(cut, "file string, owner long, part long, whole boolean, first boolean, text string")
    whole = pieces.where("whole").select("first", "text")
    parts = pieces.where("NOT whole").groupBy("file", "owner").agg(
        F.max("first").alias("first"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "text"))), lambda p: p["text"]), "\n").alias("text")
    ).select("first", "text")
    joined = whole.unionByName(parts) if opened else whole.unionByName(pieces.where("NOT whole").select("first", "text"))
    plain = F.regexp_replace(F.regexp_replace("text", "\r$", ""), "\r\n", "\n")
    return joined.select("first", F.when(F.contains("text", F.lit("\r")), plain).otherwise(F.col("text")).alias("text")).where("text <> ''")
