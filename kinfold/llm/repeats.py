"""Suffix-array dedup: every byte covered by a string of ``length`` bytes that also starts elsewhere.

Strings are found through anchors: the k-mer of smallest hash in each window of ``length`` bytes depends on the window's bytes only, so
equal windows share their anchor and its place in them. Consecutive windows with one anchor form a run, its bytes a region.

1. Distinct texts are dealt by hash into blocks of bounded bytes. Each block sends (k-mer, region hash) of its runs to buckets of the k-mer range.
   A k-mer with one occurrence ends there; a region that occurs again is repeated as a whole.
2. Where a k-mer stands in different regions, one copy of each region goes to the k-mer's bucket, which holds a logarithmic index family: each
   batch of regions gets the suffix array of its windows (suffixes cut at ``length``), is merge-scanned against the existing levels for matches of the whole
   length, and becomes a level; levels of like size are merged. So an array is merged a logarithmic number of times.
3. A k-mer with more than ``hot`` regions (a passage in very many documents) would make one bucket large. Its windows are compared by 64-bit
   hashes over all buckets instead.
4. Blocks learn which of their windows are repeated, and mark the bytes.

Copies of whole texts are counted beforehand; a text that stands more than once (and has ``length`` bytes) is repeated altogether.

Null and empty texts have no bytes. Texts shorter than ``length`` lose nothing. Repeated rows are copies. Empty tables give no rows."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.language_model import packed, unpacked
from kinfold.llm.ngram_join import _cut, _new_in_task
from kinfold.llm.text import PIECE_BYTES, dealt, packed_row, prefix_sums, span_hash

LENGTH = 200
KMER = 64
BLOCK_BYTES = 4 << 20
#: Bytes of text whose anchors meet in one bucket, on average.
BUCKET_BYTES = 512 << 10
HOT_REGIONS = 4096
#: Windows that the smallest level of an index family holds, at least.
BATCH_WINDOWS = 4096
#: Windows that a family holds, about: a bucket with more is worked off in passes over classes of windows (equal ones are of one class).
FAMILY_WINDOWS = 65536


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[:n] = values
    square = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(square, axis=1).ravel()
    behind = np.ascontiguousarray(np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1]).ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


class Runs:
    """The runs of a block's distinct texts: windows first .. last (starts, in the joined bytes) with one anchor."""

    def __init__(self, texts: pa.Array, length: int, kmer: int):
        self.length = length
        self.texts = sorted({(t.as_py() or "").encode("utf-8", "surrogatepass") for t in texts})
        self.raw = np.frombuffer(b"".join(self.texts), np.uint8)
        self.offsets = np.cumsum([0, *map(len, self.texts)])
        found = [self._runs_of(a, z, kmer) for a, z in self._pieces()]
        none = [np.zeros(0, np.int64)] * 2 + [np.zeros(0, np.uint64)] * 2
        self.first, self.last, self.kmer, self.region = (np.concatenate(c) for c in zip(none, *found, strict=True))
        # Entries: distinct (k-mer, region), sorted.
        order = np.lexsort((self.region, self.kmer))
        k, r = self.kmer[order], self.region[order]
        fresh = np.ones(len(order), bool)
        fresh[1:] = (k[1:] != k[:-1]) | (r[1:] != r[:-1])
        self.entry_of = np.empty(len(order), np.int64)
        self.entry_of[order] = np.cumsum(fresh) - 1
        self.entry_kmer, self.entry_region = k[fresh], r[fresh]
        self.entry_run = order[fresh]  # one of its runs
        self.entry_count = np.bincount(self.entry_of, minlength=int(fresh.sum())) if len(order) else none

    def _pieces(self) -> list[tuple[int, int]]:
        """Byte ranges of whole texts, of about PIECE_BYTES: arrays over bytes are built for one range at a time."""
        cuts, first = [], 0
        while first < len(self.texts):
            last = max(first + 1, int(np.searchsorted(self.offsets, self.offsets[first] + PIECE_BYTES, "right")) - 1)
            cuts.append((int(self.offsets[first]), int(self.offsets[last])))
            first = last
        return cuts

    def _runs_of(self, begin: int, stop: int, kmer: int) -> tuple[np.ndarray, ...]:
        """first, last, k-mer hash and region hash of the runs of a range of whole texts."""
        raw, length = self.raw[begin:stop], self.length
        if len(raw) < length:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        low = np.uint64((1 << 32) - 1)  # of equal hashes the leftmost counts
        sums = prefix_sums(raw)
        at = np.arange(len(raw) - kmer + 1)
        marked = span_hash(sums, at, at + kmer)
        marked &= ~low
        marked |= at.astype(np.uint64)
        anchor = (_sliding_min(marked, length - kmer + 1) & low).astype(np.int64)
        del marked, at
        begins = np.zeros(len(anchor), bool)  # a new run begins
        begins[0] = True
        begins[1:] = anchor[1:] != anchor[:-1]
        offsets = self.offsets[(self.offsets >= begin) & (self.offsets <= stop)] - begin
        begins[offsets[offsets < len(begins)]] = True
        first = np.flatnonzero(begins)
        last = np.append(first[1:], len(begins)) - 1
        # Windows that reach into the next text are none.
        last = np.minimum(last, offsets[np.searchsorted(offsets, first, "right")] - length)
        inside = last >= first
        first, last = first[inside], last[inside]
        spot = anchor[first]
        return first + begin, last + begin, span_hash(sums, spot, spot + kmer), span_hash(sums, first, last + length)

    def windows(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of all windows of the given runs, and how many each run has."""
        sizes = self.last[runs] - self.first[runs] + 1
        return np.repeat(self.first[runs] - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum())), sizes

    def window_hashes(self, starts: np.ndarray) -> np.ndarray:
        out = np.zeros(len(starts), np.uint64)
        for begin, stop in self._pieces():
            mine = np.flatnonzero((starts >= begin) & (starts < stop))
            if len(mine):
                own = starts[mine] - begin
                out[mine] = span_hash(prefix_sums(self.raw[begin:stop]), own, own + self.length)
        return out


class IndexFamily:
    """Sorted suffix arrays of geometrically growing sizes over windows of ``length`` bytes."""

    def __init__(self, length: int):
        self.kind = np.dtype(f"V{length}")
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # suffixes without repeats, number of each

    def add(self, suffixes: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        """Takes a batch; returns the numbers of windows, new and old, now known to be repeated."""
        if not len(suffixes):
            return numbers
        order = np.argsort(suffixes, kind="stable")
        suffixes, numbers = suffixes[order], numbers[order]
        same = np.append(False, suffixes[1:] == suffixes[:-1])
        hits = [numbers[same], numbers[:-1][same[1:]]]
        suffixes, numbers = suffixes[~same], numbers[~same]
        for level, own in self.levels:
            spot = np.minimum(np.searchsorted(level, suffixes), len(level) - 1)
            found = level[spot] == suffixes
            hits += [numbers[found], own[spot[found]]]
        self.levels.append((suffixes, numbers))
        while len(self.levels) > 1 and 2 * len(self.levels[-1][0]) > len(self.levels[-2][0]):
            (a, na), (b, nb) = self.levels[-2:]
            spot = np.searchsorted(a, b)
            new = a[np.minimum(spot, len(a) - 1)] != b
            self.levels[-2:] = [(np.insert(a, spot[new], b[new]), np.insert(na, spot[new], nb[new]))]
        return np.concatenate(hits)


def _bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags.astype(bool)).tobytes()


def _flags(data: bytes, count: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=count).astype(bool)


#: Codes of an entry.
_WHOLE, _SEND, _HOT = 1, 2, 4
#: Kinds of messages to a block.
_CODES, _REGIONS, _HASHES = 0, 1, 2


def _known(runs: Runs, messages: pa.Table, bits: int) -> np.ndarray:
    """The code of every entry of the block."""
    by_bucket = {b: d for k, b, d in zip(*(messages[c].to_pylist() for c in ("kind", "bucket", "data")), strict=True) if k == _CODES}
    return np.concatenate([np.zeros(0, np.uint8), *[np.frombuffer(by_bucket[b], np.uint8) for b in _cut(runs.entry_kmer, bits)[0]]])


def _hot_windows(runs: Runs, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of the windows in hot entries, and how often each stands in the block."""
    starts, _ = runs.windows(runs.entry_run[(codes & _HOT) > 0])
    return np.unique(runs.window_hashes(starts), return_counts=True) if len(starts) else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _judge(table: pa.Table, hot: int) -> pa.Table:
    """Codes of all entries of a bucket."""
    table = table.sort_by("sender")
    kmers = [np.cumsum(unpacked(x.as_py())) for x in table["kmers"]]
    at = np.cumsum([0, *map(len, kmers)])
    kmer = np.concatenate(kmers)
    region = np.concatenate([unpacked(x.as_py()) for x in table["regions"]])
    several = np.concatenate([_flags(x.as_py(), len(k)) for x, k in zip(table["several"], kmers, strict=True)])
    order = np.lexsort((region, kmer))
    k, r = kmer[order], region[order]
    new_kmer = np.append(True, k[1:] != k[:-1])
    new_region = new_kmer | np.append(True, r[1:] != r[:-1])
    group, family = np.cumsum(new_region) - 1, np.cumsum(new_kmer) - 1
    whole = np.bincount(group, weights=1 + several[order]) > 1
    n_regions = np.bincount(family, weights=new_region)
    n_single = np.bincount(family, weights=new_region & ~whole[group])
    open_family = (n_regions > 1) & (n_single > 0)
    code = whole[group] * np.uint8(_WHOLE)
    code |= np.where(new_region & open_family[family], np.where(n_regions[family] > hot, np.uint8(_HOT), np.uint8(_SEND)), np.uint8(0))
    out = np.empty(len(code), np.uint8)
    out[order] = code
    return pa.table({
        "block": table["sender"], "kind": pa.array([_CODES] * len(table), pa.int32()), "bucket": table["bucket"],
        "data": pa.array([out[i:j].tobytes() for i, j in zip(at[:-1], at[1:], strict=True)], pa.binary()),
    })


def _match(table: pa.Table, length: int) -> pa.Table:
    """Which windows of the regions, or which hashes, of a bucket are repeated: one bit each, in the order sent."""
    kinds, senders = table["kind"].to_pylist(), table["sender"].to_pylist()
    replies: list[tuple[int, int, bytes]] = []
    hashed = [i for i, k in enumerate(kinds) if k == _HASHES]
    if hashed:
        keys = [np.cumsum(unpacked(table["data"][i].as_py())) for i in hashed]
        several = np.concatenate([_flags(table["more"][i].as_py(), len(k)) for i, k in zip(hashed, keys, strict=True)])
        _, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        again = (np.bincount(inverse, weights=1 + several) > 1)[inverse]
        at = np.cumsum([0, *map(len, keys)])
        replies += [(senders[i], _HASHES, _bits(again[a:b])) for i, a, b in zip(hashed, at[:-1], at[1:], strict=True)]
    rows = [i for i, k in enumerate(kinds) if k == _REGIONS]
    sizes = {i: np.frombuffer(table["more"][i].as_py(), np.int32).astype(np.int64) for i in rows}
    counts = np.array([int((sizes[i] - length + 1).sum()) for i in rows], np.int64)
    firsts = np.cumsum(counts) - counts
    again = np.zeros(int(counts.sum()), bool)
    passes = max(1, -(-len(again) // FAMILY_WINDOWS))
    for turn in range(passes):
        family = IndexFamily(length)
        batch, batch_numbers = [], []
        for i, at, n_windows in zip(rows, firsts.tolist(), counts.tolist(), strict=True):
            raw = np.frombuffer(table["data"][i].as_py(), np.uint8)
            n = sizes[i] - length + 1
            starts = np.repeat(np.cumsum(sizes[i]) - sizes[i] - np.cumsum(n) + n, n) + np.arange(n_windows)
            numbers = np.arange(at, at + n_windows)
            if passes > 1:
                tag = sum(raw[starts + place].astype(np.int64) << shift for place, shift in ((0, 0), (1, 5), (length // 2, 10), (length - 1, 15)))
                mine = tag * 2654435761 % 4294967291 % passes == turn
                starts, numbers = starts[mine], numbers[mine]
            windows = np.lib.stride_tricks.sliding_window_view(raw, length)[starts]
            batch.append(np.ascontiguousarray(windows).view(family.kind).ravel())
            batch_numbers.append(numbers)
            if i == rows[-1] or sum(map(len, batch)) >= BATCH_WINDOWS:
                again[family.add(np.concatenate(batch), np.concatenate(batch_numbers))] = True
                batch, batch_numbers = [], []
    replies += [(senders[i], _REGIONS, _bits(again[a : a + n])) for i, a, n in zip(rows, firsts.tolist(), counts.tolist(), strict=True)]
    bucket = table["bucket"][0].as_py()
    return pa.table({
        "block": pa.array([r[0] for r in replies], pa.int32()), "kind": pa.array([r[1] for r in replies], pa.int32()),
        "bucket": pa.array([bucket] * len(replies), pa.int32()), "data": pa.array([r[2] for r in replies], pa.binary()),
    })


def _repeats_of_texts(texts: DataFrame, n_blocks: int, bits: int, length: int, kmer: int, hot: int) -> DataFrame:
    """(h, size, spans, kept_sha256) of every distinct text, from texts dealt into blocks."""

    def send(table: pa.Table) -> pa.Table:
        runs = Runs(table["text"], length, kmer)
        names, at = _cut(runs.entry_kmer, bits) if len(runs.entry_kmer) else ([], [0])
        spans = list(zip(at[:-1], at[1:], strict=True))
        return pa.table({
            "bucket": pa.array(names, pa.int32()), "sender": pa.array([table["block"][0].as_py()] * len(names), pa.int32()),
            "kmers": pa.array([packed(np.diff(runs.entry_kmer[i:j], prepend=np.uint64(0))) for i, j in spans], pa.binary()),
            "regions": pa.array([packed(runs.entry_region[i:j]) for i, j in spans], pa.binary()),
            "several": pa.array([_bits(runs.entry_count[i:j] > 1) for i, j in spans], pa.binary()),
        })

    def ship(table: pa.Table, codes: pa.Table) -> pa.Table:
        runs = Runs(table["text"], length, kmer)
        code = _known(runs, codes, bits)
        rows: list[tuple[int, int, bytes, bytes]] = []
        names, at = _cut(runs.entry_kmer, bits) if len(code) else ([], [0])
        for b, i, j in zip(names, at[:-1], at[1:], strict=True):
            chosen = runs.entry_run[i:j][(code[i:j] & _SEND) > 0]
            if len(chosen):
                ends = runs.last[chosen] + length
                data = b"".join(runs.raw[a:z].tobytes() for a, z in zip(runs.first[chosen], ends, strict=True))
                rows.append((b, _REGIONS, data, (ends - runs.first[chosen]).astype(np.int32).tobytes()))
        hashes, counts = _hot_windows(runs, code)
        names, at = _cut(hashes, bits) if len(hashes) else ([], [0])
        for b, i, j in zip(names, at[:-1], at[1:], strict=True):
            rows.append((b, _HASHES, packed(np.diff(hashes[i:j], prepend=np.uint64(0))), _bits(counts[i:j] > 1)))
        return pa.table({
            "bucket": pa.array([r[0] for r in rows], pa.int32()), "sender": pa.array([table["block"][0].as_py() if len(table) else 0] * len(rows), pa.int32()),
            "kind": pa.array([r[1] for r in rows], pa.int32()), "data": pa.array([r[2] for r in rows], pa.binary()), "more": pa.array([r[3] for r in rows], pa.binary()),
        })

    def finish(table: pa.Table, messages: pa.Table) -> pa.Table:
        runs = Runs(table["text"], length, kmer)
        code = _known(runs, messages, bits)
        told = {(k, b): d for k, b, d in zip(*(messages[c].to_pylist() for c in ("kind", "bucket", "data")), strict=True)}
        edge = np.zeros(len(runs.raw) + 1, np.int64)
        whole = (code[runs.entry_of] & _WHOLE) > 0 if len(code) else np.zeros(0, bool)
        np.add.at(edge, runs.first[whole], 1)
        np.subtract.at(edge, runs.last[whole] + length, 1)
        marked = [np.zeros(0, np.int64)]  # starts of single repeated windows
        names, at = _cut(runs.entry_kmer, bits) if len(code) else ([], [0])
        for b, i, j in zip(names, at[:-1], at[1:], strict=True):
            starts, _ = runs.windows(runs.entry_run[i:j][(code[i:j] & _SEND) > 0])
            if len(starts):
                marked.append(starts[_flags(told[_REGIONS, b], len(starts))])
        hashes, _ = _hot_windows(runs, code)
        if len(hashes):
            names, at = _cut(hashes, bits)
            again = np.concatenate([_flags(told[_HASHES, b], j - i) for b, i, j in zip(names, at[:-1], at[1:], strict=True)])
            starts, _ = runs.windows(runs.entry_run[(code & _HOT) > 0])
            marked.append(starts[again[np.searchsorted(hashes, runs.window_hashes(starts))]])
        starts = np.concatenate(marked)
        np.add.at(edge, starts, 1)
        np.subtract.at(edge, starts + length, 1)
        gone = np.cumsum(edge[:-1]) > 0
        out: list[list] = [[], [], []]
        for text, a, z in zip(runs.texts, runs.offsets[:-1], runs.offsets[1:], strict=True):
            own = gone[a:z]
            if not own.any():
                continue  # what loses nothing needs no answer
            turns = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]])))
            kept = hashlib.sha256(runs.raw[a:z][~own].tobytes()).hexdigest()
            spans = [{"start": s, "end": e} for s, e in turns.reshape(-1, 2).tolist()]
            for column, value in zip(out, (hashlib.md5(text).hexdigest(), spans, kept), strict=True):
                column.append(value)
        span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        return pa.table({
            "key": pa.array(out[0], pa.string()), "spans": pa.array(out[1], pa.list_(span)),
            "kept_sha256": pa.array(out[2], pa.string()),
        })

    def judge(table: pa.Table) -> pa.Table:
        return _judge(table, hot)

    def match(table: pa.Table) -> pa.Table:
        return _match(table, length)

    sent = texts.groupBy("block").applyInArrow(send, "bucket int, sender int, kmers binary, regions binary, several binary")
    message = "block int, kind int, bucket int, data binary"
    codes = dealt(sent, 1 << bits, "bucket").groupBy("bucket").applyInArrow(judge, message)
    shipped = texts.groupBy("block").cogroup(codes.groupBy("block")).applyInArrow(ship, "bucket int, sender int, kind int, data binary, more binary")
    matched = dealt(shipped, 1 << bits, "bucket").groupBy("bucket").applyInArrow(match, message)
    answers = codes.unionByName(matched)
    return texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(finish, "key string, spans array<struct<start:long,end:long>>, kept_sha256 string")


def find_repeats(
    docs: DataFrame, length: int = LENGTH, kmer: int = KMER, keep: Sequence[str] = ("doc_id",), block_bytes: int = BLOCK_BYTES,
    bucket_bytes: int = BUCKET_BYTES, hot: int = HOT_REGIONS,
) -> DataFrame:
    """Per row of ``docs``: ``row`` (the columns in ``keep``), ``n_bytes``, ``spans`` (maximal runs of repeated bytes, [start, end)) and ``kept_sha256``
    (of the other bytes)."""
    text = F.coalesce("text", F.lit(""))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, -(-total // block_bytes))
    bits = max(0, (max(1, total // bucket_bytes) - 1).bit_length())
    long_texts = docs.where(F.octet_length("text") >= length).select("text", F.md5("text").alias("digest"))
    fresh = long_texts.where(F.arrow_udf(_new_in_task, "boolean")("digest"))
    blocks = dealt(fresh.select("text", F.pmod(F.xxhash64("text"), F.lit(n_blocks)).cast("int").alias("block")), n_blocks, "block")
    found = _repeats_of_texts(blocks, n_blocks, bits, length, kmer, hot).withColumnRenamed("key", "_key")

    rows = docs.select(packed_row(keep), F.octet_length(text).cast("long").alias("n_bytes"), F.md5(text).alias("key"), F.sha2(text, 256).alias("sha"))
    copies = rows.where(F.col("n_bytes") >= length).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("key").alias("_key"))
    # One row per text: copies are repeated altogether, the others as found.
    every = F.lit(None).cast("array<struct<start:long,end:long>>")
    nothing = hashlib.sha256(b"").hexdigest()
    answers = copies.select("_key", every.alias("spans"), F.lit(nothing).alias("kept_sha256"), F.lit(True).alias("copied"))
    answers = answers.unionByName(found.join(copies, "_key", "left_anti").withColumn("copied", F.lit(False)))
    joined = rows.join(answers, rows["key"] == answers["_key"], "left")
    all_bytes = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
    none = F.filter(all_bytes, lambda s: F.lit(False))
    spans = F.when(F.col("copied"), all_bytes).otherwise(F.coalesce("spans", none))
    return joined.select("row", "n_bytes", spans.alias("spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"))
