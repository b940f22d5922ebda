"""Benchmark decontamination: Wu-Manber multi-pattern search over words.

Patterns are the windows of ``width`` consecutive words of every benchmark item (an item of fewer words is one window).
For each pattern length a shift table over hashed pairs of words says how far a scan may jump; only where it says 0, the last and the
first pair of the window are looked up together in a table of prefixes and suffixes. Windows that pass are candidates: they meet the patterns by a join on
all their words, which is the word-by-word comparison.

The tables are filled by Spark and have a size of their own: ``SHIFT_BITS`` a length, and 16 bits for each window, up to ``PREFIX_BITS`` in all.
A larger benchmark only makes the scan jump less and look up more, so neither the driver nor a task ever holds the benchmark.
Candidates travel once for each text, and a text's hits come back by its digest.

Nulls: a null text has no words; a benchmark row without words gives no pattern; a null item id still hits words but
names no item. Repeated items count once. Empty tables give no rows, or rows without hits."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.pii import Words
from kinfold.llm.text import letter_words, mixed, packed_row, pieces
from kinfold.sources.shared import settle

WIDTH = 13
#: Slots of a shift table (a byte each), and bits of the table of prefixes and suffixes at most, as powers of two.
SHIFT_BITS = 20
PREFIX_BITS = 30
_CHUNK = 16
_STEP, _FAR = np.uint64(0x9FB21C651E98DF25), np.uint64(0xA24BAED4963EE407)


class SearchTables:
    """``shift[m]``: by slot of the last block of words, how far a window of m words may move. ``seen``: bits of (prefix, suffix)."""

    def __init__(self, shift: dict[int, np.ndarray], shift_bits: int, seen: np.ndarray, bits: int):
        self.shift, self.shift_bits, self.seen, self.bits = shift, shift_bits, seen, bits

    def candidates(self, hashes: np.ndarray, m: int) -> list[int]:
        """Last words of the windows of m words that may be patterns. The scan jumps by the shift table."""
        if len(hashes) < m:
            return []
        blocks = word_blocks(hashes, m)
        shift = self.shift[m][blocks >> np.uint64(64 - self.shift_bits)]
        if shift.min(initial=255):
            return []
        jump = shift.tolist()
        found, n = [], len(jump)
        width = min(2, m)
        i = m - width  # blocks are numbered by their first word
        while i < n:
            step = jump[i]
            if step:
                i += step
                continue
            found.append(i)
            i += 1
        last = np.array(found, np.int64)
        slot = prefix_slot(blocks[last - (m - width)], blocks[last], m, self.bits)
        passed = (self.seen[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 > 0
        return (last[passed] + width - 1).tolist()


def word_blocks(hashes: np.ndarray, m: int) -> np.ndarray:
    """Keys of all pairs of neighbouring words; of single words for windows of one word."""
    return mixed(hashes + np.uint64(m)) if m == 1 else mixed((hashes[:-1] * _STEP) ^ mixed(hashes[1:]))


def prefix_slot(first: np.ndarray, last: np.ndarray, m: int, bits: int) -> np.ndarray:
    return mixed((first * _FAR) ^ (last + np.uint64(m))) >> np.uint64(64 - bits)


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of covered words."""
    runs: list[list[int]] = []
    for first, last in sorted(spans):
        if runs and first <= runs[-1][1] + 1:
            runs[-1][1] = max(runs[-1][1], last)
        else:
            runs.append([first, last])
    return [tuple(r) for r in runs]


def pattern_table(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row per distinct window: its words joined by blanks, and the ids of its items."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out_window, out_item = [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = letter_words(text)
                for at in range(max(1, len(words) - width + 1) if words else 0):
                    out_window.append(b" ".join(words[at : at + width]).decode("utf-8", "surrogatepass"))
                    out_item.append(item)
            yield pa.RecordBatch.from_arrays([pa.array(out_window, pa.string()), pa.array(out_item, pa.string())], ["window", "item"])

    rows = benchmark.select(F.col("item_id").cast("string"), "text").mapInArrow(cut, "window string, item string")
    return rows.groupBy("window").agg(F.collect_set("item").alias("items"))


def search_tables(patterns: DataFrame, shift_bits: int = SHIFT_BITS, prefix_bits: int = PREFIX_BITS) -> SearchTables:
    """The tables of all patterns, put together from the slots that tasks fill: their size is bounded whatever the benchmark's."""
    n = patterns.count()
    bits = min(prefix_bits, max(_CHUNK + 3, (16 * n).bit_length()))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, raw, offsets in pieces(batch.column(0)):
                words = Words(raw, offsets)
                kinds, slots, values = [], [], []
                for a, b in zip(words.first[:-1], words.first[1:], strict=True):
                    m = int(b - a)
                    blocks = word_blocks(words.hash[a:b], m)
                    kinds += [m] * len(blocks) + [0]
                    slots += [*(blocks >> np.uint64(64 - shift_bits)).tolist(), int(prefix_slot(blocks[:1], blocks[-1:], m, bits)[0])]
                    values += [*range(len(blocks) - 1, -1, -1), 0]
                yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(slots, pa.int64()), pa.array(values, pa.int32())], ["m", "slot", "value"])

    def folded(table: pa.Table) -> pa.Table:
        m, slot = table["m"][0].as_py(), table["slot"].to_numpy() & ((1 << _CHUNK) - 1)
        if m:  # shifts, the default where no pattern has the block
            part = np.full(1 << _CHUNK, min(255, max(1, m - min(2, m) + 1)), np.uint8)
            np.minimum.at(part, slot, np.minimum(table["value"].to_numpy(), 255).astype(np.uint8))
        else:
            part = np.packbits(np.bincount(slot, minlength=1 << _CHUNK) > 0, bitorder="little")
        return pa.table({"m": pa.array([m], pa.int32()), "chunk": table["chunk"][:1], "data": pa.array([part.tobytes()], pa.binary())})

    filled = patterns.select("window").mapInArrow(fill, "m int, slot long, value int").groupBy("m", "slot").agg(F.min("value").alias("value"))
    chunks = filled.withColumn("chunk", F.shiftright("slot", _CHUNK).cast("int")).groupBy("m", "chunk").applyInArrow(folded, "m int, chunk int, data binary")
    shift: dict[int, np.ndarray] = {}
    seen = np.zeros(1 << (bits - 3), np.uint8)
    for r in chunks.toLocalIterator():  # as many bytes as the tables have
        part = np.frombuffer(bytes(r["data"]), np.uint8)
        if r["m"]:
            whole = shift.setdefault(r["m"], np.full(1 << shift_bits, min(255, max(1, r["m"] - min(2, r["m"]) + 1)), np.uint8))
            whole[r["chunk"] << _CHUNK : (r["chunk"] + 1) << _CHUNK] = part
        else:
            seen[r["chunk"] << (_CHUNK - 3) : (r["chunk"] + 1) << (_CHUNK - 3)] = part
    return SearchTables(shift, shift_bits, seen, bits)


def _count_words(texts: pa.Array) -> pa.Array:
    counts = [np.diff(Words(raw, offsets).first) for _, _, raw, offsets in pieces(texts)]
    return pa.array(np.concatenate([np.zeros(0, np.int64), *counts]), pa.int64())


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, keep: Sequence[str] = ("doc_id",), shift_bits: int = SHIFT_BITS, prefix_bits: int = PREFIX_BITS
) -> DataFrame:
    """Per row of ``docs``: ``row`` (the columns in ``keep``), ``n_words``, ``hits`` (maximal hit runs of words, from 0)
    and ``items`` (sorted ids of the items with windows in the text)."""
    patterns = settle(pattern_table(benchmark, width))
    shared = docs.sparkSession.sparkContext.broadcast(search_tables(patterns, shift_bits, prefix_bits))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, met = shared.value, set()
        for batch in batches:
            texts, digests = batch.column(0), batch.column(1).to_pylist()
            for first, last, raw, offsets in pieces(texts):
                words = Words(raw, offsets)
                out: tuple[list, ...] = ([], [], [], [])
                for i in range(last - first):
                    digest = digests[first + i]
                    a, b = words.first[i], words.first[i + 1]
                    if a == b or digest in met:
                        continue
                    spoken = None
                    for m in tables.shift:
                        for end in tables.candidates(words.hash[a:b], m):
                            spoken = spoken or letter_words(texts[first + i].as_py())
                            window = b" ".join(spoken[end - m + 1 : end + 1]).decode("utf-8", "surrogatepass")
                            for column, value in zip(out, (digest, end - m + 1, end, window), strict=True):
                                column.append(value)
                    if spoken:  # copies of it need not be searched again in this task
                        met.add(digest)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.string())],
                    ["digest", "first", "last", "window"],
                )

    candidates = docs.select("text", F.md5("text").alias("digest")).mapInArrow(scan, "digest string, first long, last long, window string")
    found = candidates.join(patterns, "window")
    span = F.struct("first", "last")
    texts = found.groupBy("digest").agg(F.array_sort(F.collect_set(span)).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    texts = settle(texts.select("digest", F.arrow_udf(_merged_spans, "array<struct<first:long,last:long>>")("spans").alias("hits"), "items"))
    rows = docs.select(packed_row(keep), F.arrow_udf(_count_words, "long")("text").alias("n_words"), F.md5("text").alias("_digest"))
    joined = rows.join(texts, rows["_digest"] == texts["digest"], "left")
    none = F.array().cast("array<struct<first:long,last:long>>")
    return joined.select("row", "n_words", F.coalesce("hits", none).alias("hits"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def _merged_spans(column: pa.Array) -> pa.Array:
    out = [[{"first": a, "last": b} for a, b in merged((s["first"], s["last"]) for s in spans)] for spans in column.to_pylist()]
    return pa.array(out, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])))


def judged(found: DataFrame) -> DataFrame:
    """Adds ``n_hit`` and ``contaminated``: at least a twentieth of the words, and at least one, is hit."""
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda total, s: total + s["last"] - s["first"] + 1)
    found = found.withColumn("n_hit", n_hit)
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
