"""Whole-text helpers for tasks: words, hashes and bounded pieces of Arrow batches.

Texts are handled as UTF-8 bytes. Null texts count as empty. Only ASCII letters are lower-cased, so lower-casing never
changes the length of a text."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of text that a task works on at once; a longer document is a piece of its own.
PIECE_BYTES = 1 << 20

_A, _Z = ord("A"), ord("Z")
_LOWER = bytes(b + 32 if _A <= b <= _Z else b for b in range(256))
_BLANK = frozenset([0x20, *range(0x09, 0x0E)])
#: Bytes outside ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` become blanks, letters become lower case.
_WORD = bytes(
    b + 32 if _A <= b <= _Z else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)
)
_IS_BLANK = np.array([b in _BLANK for b in range(256)])
_LOWER_CODE = np.frombuffer(_LOWER, np.uint8)


def letter_words(text: str | None) -> list[bytes]:
    """Lower-cased runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` of a text."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORD).split()


def packed_row(keep: Sequence[str]) -> Column:
    """The columns in ``keep`` as the struct ``row`` beside an operator's own columns, so that no name can clash."""
    return F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row")


def dealt(df: DataFrame, n_groups: int, group: str) -> DataFrame:
    """Rows by group, in no more partitions than the session asks for: a partition works off many groups one after the other, so that map
    and reduce partitions, and what stands between them, do not grow with the data."""
    spark = df.sparkSession
    most = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(min(n_groups, most), group)


def with_results(docs: DataFrame, keep: Sequence[str], kernel: Callable, returns: str, *inputs: Column) -> DataFrame:
    """``row`` and the fields that ``kernel`` gives for the inputs. Only the inputs go to Python, only results come back."""
    found = docs.select(packed_row(keep), F.arrow_udf(kernel, returns)(*inputs).alias("found"))
    return found.select("row", "found.*")


def pieces(column: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cuts a batch's texts into row ranges of at most ``limit`` bytes: (first, last + 1, bytes, offsets from 0)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64, len(column) + 1, 8 * column.offset)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, last, raw[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_CODES = np.random.default_rng(20240517).integers(1, 1 << 63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER_CODES = _CODES[_LOWER_CODE]
_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n - 1); kept for pieces of the usual size."""
    have = _powers.get(str(base))
    if have is None or len(have) < n:
        have = np.full(max(n, PIECE_BYTES + 1), base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if n <= PIECE_BYTES + 1:
            _powers[str(base)] = have
    return have[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit numbers so that all bits depend on all bits."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def prefix_sums(raw: np.ndarray, codes: np.ndarray = _CODES) -> np.ndarray:
    """P with P[j] - P[i] = the polynomial of bytes i .. j-1, times base**i (mod 2**64)."""
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(codes[raw] * _power(_BASE, len(raw)), out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, equal for equal bytes wherever they stand."""
    return mixed((sums[end] - sums[start]) * _power(_INVERSE, len(sums))[start] + (end - start).astype(np.uint64))


def blank_words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words ``[^\\x20\\x09-\\x0D]+`` of a piece, and where each document's words begin (rows + 1 numbers)."""
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    blank = _IS_BLANK[raw]
    edge = np.zeros(len(raw) + 1, bool)  # words end with their document
    edge[offsets] = True
    begins, ends = edge[:-1].copy(), edge[1:].copy()
    begins[1:] |= blank[:-1]
    ends[:-1] |= blank[1:]
    start = np.flatnonzero(begins & ~blank)
    end = np.flatnonzero(ends & ~blank) + 1
    hashes = span_hash(prefix_sums(raw, _LOWER_CODES), start, end)
    return hashes, np.searchsorted(start, offsets)
