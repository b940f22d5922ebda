"""N-gram Jaccard join: size-banded tiles with hashed bitmap signatures.

1. A document's set is its distinct shingles of ``width`` words (64-bit hashes); equal sets form a class.
2. Shingles that no other class has are found over the whole corpus: blocks of texts send the keys of their shingles to buckets of
   the key range and learn which are theirs alone. A class can have a partner only if a ``similarity`` share of its shingles is not its
   own; the others are done. Exact, and no frequent line or passage makes candidates by itself.
3. What remains is joined on the prefix of each set (its own shingles first, then rare before frequent ones, then by hash): two sets that are
   similar enough share one. Sets that share a prefix shingle and have fitting sizes are put into one family, by a spanning tree per bucket
   and connected components.
4. A family is worked off in tiles: pairs of blocks of at most ``tile_sets`` sets. In a tile the sets lie in order of size; each meets only the
   band of sizes it can be similar to. The xor of hashed bitmaps (a few bits per shingle) bounds the overlap from above; pairs that pass are
   verified by intersecting the sorted arrays. Pairs already connected in the tile are skipped, so a tile yields at most one link per set.
5. Links form components; documents take the smallest id in theirs.

Texts without words link with nothing. Null ids count as documents, but never name a component unless all ids of it are null. Repeated rows
are documents of their own. Empty tables give no rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.graph import components
from kinfold.llm.language_model import packed, unpacked
from kinfold.llm.text import blank_words, dealt, mixed, pieces, with_results
from kinfold.sources.shared import settle

WIDTH = 4
#: Smallest similarity in hundredths.
PERCENT = 85
BLOCK_BYTES = 4 << 20
#: Bytes of text whose shingles meet in one bucket, on average.
BUCKET_BYTES = 2 << 20
TILE_SETS = 1024

_FACTORS = np.random.default_rng(77).integers(1, 1 << 62, 64, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of every text."""
    for first, last, raw, offsets in pieces(texts):
        words, starts = blank_words(raw, offsets)
        whole = np.zeros(max(0, len(words) - width + 1), np.uint64)
        for j in range(width):
            whole += words[j : j + len(whole)] * _FACTORS[j]
        whole = mixed(whole)
        for i in range(last - first):
            a, b = starts[i], starts[i + 1]
            if b - a >= width:
                yield np.unique(whole[a : b - width + 1])
            elif b > a:
                own = words[a:b] * _FACTORS[: b - a]
                yield mixed(own.sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a))
            else:
                yield np.zeros(0, np.uint64)


def _name(shingles: np.ndarray) -> int:
    """The class of a set, as a signed 64-bit number."""
    if not len(shingles):
        return 0
    folded = mixed(np.array([shingles.sum(dtype=np.uint64), np.bitwise_xor.reduce(mixed(shingles)), len(shingles)], np.uint64))
    return int(mixed(folded * _FACTORS[:3]).sum(dtype=np.uint64).view(np.int64))


def _least_shared(n, percent: int):
    """Fewest common shingles of a set of size n with any similar set."""
    return -(-n * percent // 100)


def _with_classes(docs: DataFrame, width: int, keep: Sequence[str]) -> DataFrame:
    """``row``, ``n`` (size of the set) and ``cls`` of every document."""

    def run(texts: pa.Array) -> pa.Array:
        found = [(len(s), _name(s)) for s in shingle_sets(texts, width)]
        return pa.StructArray.from_arrays([pa.array([n for n, _ in found], pa.int64()), pa.array([c for _, c in found], pa.int64())], ["n", "cls"])

    return with_results(docs, keep, run, "struct<n:long,cls:long>", F.col("text"))


def _new_in_task(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Whether a task meets a text, by its 128-bit digest, for the first time: copies that one task sees travel once, so a text with very
    many copies stays small."""
    seen: set[str] = set()
    for digests in batches:
        fresh = []
        for d in digests.to_pylist():
            fresh.append(d not in seen)
            seen.add(d)
        yield pa.array(fresh, pa.bool_())


def _distinct_sets(texts: pa.Array, width: int) -> list[tuple[int, np.ndarray]]:
    return sorted({_name(s): s for s in shingle_sets(texts, width) if len(s)}.items())


def _cut(keys: np.ndarray, bits: int) -> tuple[list[int], list[int]]:
    """Buckets present in sorted keys, and where each begins (and the last ends)."""
    buckets = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    names, first = np.unique(buckets, return_index=True)
    return names.tolist(), [*first.tolist(), len(keys)]


def _shared_part(docs: DataFrame, width: int, percent: int, block_bytes: int, bucket_bytes: int) -> DataFrame:
    """Classes that may have a partner: cls, n and the shingles that other classes have, too (``shared``, sorted),
    and those of the prefix among them."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, -(-total // block_bytes))
    bits = max(0, (max(1, total // bucket_bytes) - 1).bit_length())
    texts = docs.where("text IS NOT NULL").select("text", F.md5("text").alias("digest"))
    texts = texts.where(F.arrow_udf(_new_in_task, "boolean")("digest"))
    texts = dealt(texts.select("text", F.pmod(F.xxhash64("text"), F.lit(n_blocks)).cast("int").alias("block")), n_blocks, "block")

    def send(table: pa.Table) -> pa.Table:
        sets = _distinct_sets(table["text"], width)
        keys, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *[s for _, s in sets]]), return_counts=True)
        names, at = _cut(keys, bits)
        spans = list(zip(at[:-1], at[1:], strict=True))
        return pa.table({
            "bucket": pa.array(names, pa.int32()), "sender": pa.array([table["block"][0].as_py()] * len(names), pa.int32()),
            "keys": pa.array([packed(np.diff(keys[i:j], prepend=np.uint64(0))) for i, j in spans], pa.binary()),
            "several": pa.array([np.packbits(counts[i:j] > 1).tobytes() for i, j in spans], pa.binary()),
        })

    def compare(table: pa.Table) -> pa.Table:
        keys = [np.cumsum(unpacked(k.as_py())) for k in table["keys"]]
        several = np.concatenate([np.unpackbits(np.frombuffer(s.as_py(), np.uint8), count=len(k)) for s, k in zip(table["several"], keys, strict=True)])
        at = np.cumsum([0, *map(len, keys)])
        _, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        # 0: one class only; else the binary logarithm of how often the shingle was sent.
        level = np.log2(np.bincount(inverse, weights=1 + several)).astype(np.uint8)[inverse]
        return pa.table({
            "block": table["sender"], "bucket": table["bucket"],
            "levels": pa.array([level[i:j].tobytes() for i, j in zip(at[:-1], at[1:], strict=True)], pa.binary()),
        })

    def reduce(texts: pa.Table, flags: pa.Table) -> pa.Table:
        sets = _distinct_sets(texts["text"], width)
        keys = np.unique(np.concatenate([np.zeros(0, np.uint64), *[s for _, s in sets]]))
        names, at = _cut(keys, bits)
        told = dict(zip(flags["bucket"].to_pylist(), flags["levels"].to_pylist(), strict=True))
        levels = np.concatenate([np.zeros(0, np.uint8), *[np.frombuffer(told[b], np.uint8) for b in names]])
        out = []
        for cls, s in sets:
            level = levels[np.searchsorted(keys, s)]
            common = s[level > 0]
            if len(common) >= _least_shared(len(s), percent):
                length = _least_shared(len(s), percent)
                length = len(common) - length + 1  # of the prefix, without the set's own shingles, which come first
                prefix = common[np.lexsort((common, level[level > 0]))[:length]]
                out.append((cls, len(s), packed(np.diff(common, prepend=np.uint64(0))), prefix.tobytes()))
        return pa.table({
            "cls": pa.array([o[0] for o in out], pa.int64()), "n": pa.array([o[1] for o in out], pa.int64()),
            "shared": pa.array([o[2] for o in out], pa.binary()), "prefix": pa.array([o[3] for o in out], pa.binary()),
        })

    sent = texts.groupBy("block").applyInArrow(send, "bucket int, sender int, keys binary, several binary")
    flags = dealt(sent, 1 << bits, "bucket").groupBy("bucket").applyInArrow(compare, "block int, bucket int, levels binary")
    kept = texts.groupBy("block").cogroup(flags.groupBy("block")).applyInArrow(reduce, "cls long, n long, shared binary, prefix binary")
    return settle(kept.where("cls IS NOT NULL").dropDuplicates(["cls"]))


def _families(sets: DataFrame, percent: int, bucket_bytes: int) -> DataFrame:
    """Edges (a, b) between classes that share a prefix shingle and have fitting sizes: enough to connect all such classes."""
    prefix_bytes = sets.agg(F.sum(F.octet_length("prefix"))).first()[0] or 0
    n_buckets = max(1, -(-prefix_bytes // bucket_bytes))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, names, sizes = [], [], []
            for cls, n, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                prefix = np.frombuffer(raw.as_py(), np.uint64)
                keys.append(prefix)
                names.append(np.full(len(prefix), cls, np.int64))
                sizes.append(np.full(len(prefix), n, np.int64))
            if not keys:
                continue
            key, cls, n = np.concatenate(keys), np.concatenate(names), np.concatenate(sizes)
            bucket = (mixed(key) % np.uint64(n_buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            at = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
            for b in range(n_buckets):
                mine = order[at[b] : at[b + 1]]
                if len(mine):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([b], pa.int32()), *[pa.array([v[mine].tobytes()], pa.binary()) for v in (key, cls, n)]], ["bucket", "key", "cls", "n"]
                    )

    def link(table: pa.Table) -> pa.Table:
        key, cls, n = (np.concatenate([np.frombuffer(x.as_py(), t) for x in table[c]]) for c, t in (("key", np.uint64), ("cls", np.int64), ("n", np.int64)))
        order = np.lexsort((n, key))
        key, cls, n = key[order], cls[order], n[order]
        # In order of size, a set that fits any smaller one of its shingle fits the one just before it.
        near = (key[1:] == key[:-1]) & (100 * n[:-1] >= percent * n[1:]) & (cls[1:] != cls[:-1])
        edges = np.unique(np.stack([np.minimum(cls[:-1], cls[1:])[near], np.maximum(cls[:-1], cls[1:])[near]], axis=1), axis=0)
        forest = _Forest()
        kept = [(a, b) for a, b in edges.tolist() if forest.join(a, b)]
        return pa.table({"a": pa.array([a for a, _ in kept], pa.int64()), "b": pa.array([b for _, b in kept], pa.int64())})

    return sets.select("cls", "n", "prefix").mapInArrow(deal, "bucket int, key binary, cls binary, n binary").groupBy("bucket").applyInArrow(link, "a long, b long")


class _Forest:
    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (p := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(p, p)
            x = p
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def tile_links(names: list[int], sizes: np.ndarray, sets: list[np.ndarray], side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links of a tile between sets of different sides (or of one side, if there is but one): enough to connect all that are similar.
    ``sets`` hold the shingles that others share; the rest of ``sizes`` is common to no two sets."""
    order = np.argsort(sizes, kind="stable")
    names, sizes, sets, side = [names[i] for i in order], sizes[order], [sets[i] for i in order], side[order]
    two = len(np.unique(side)) > 1
    width = 1 << max(6, int(2 * np.median(sizes)).bit_length())
    bits = np.zeros((len(sets), width), bool)
    for i, s in enumerate(sets):
        bits[i, (s & np.uint64(width - 1)).astype(np.int64)] = True
    maps = np.packbits(bits, axis=1).view(np.uint64)
    own = sizes - np.array([len(s) for s in sets])
    forest, links = _Forest(), []
    for i in range(len(sets)):
        last = int(np.searchsorted(sizes, 100 * sizes[i] // percent, "right"))
        band = np.arange(i + 1, last)
        if two:
            band = band[side[band] != side[i]]
        if not len(band):
            continue
        differ = np.bitwise_count(maps[band] ^ maps[i]).sum(axis=1, dtype=np.int64) + own[band] + own[i]
        both = sizes[band] + sizes[i]
        most = (both - differ) // 2
        for j in band[100 * most >= percent * (both - most)].tolist():
            if forest.root(i) != forest.root(j):
                common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 100 * common >= percent * (sizes[i] + sizes[j] - common):
                    forest.join(i, j)
                    links.append((names[i], names[j]))
    return links


def _links(sets: DataFrame, families: DataFrame, percent: int, tile_sets: int) -> DataFrame:
    members = sets.drop("prefix").join(families, sets["cls"] == families["node"]).drop("node")
    counts = families.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / tile_sets).cast("int").alias("blocks"))
    members = members.join(counts, "root")
    members = members.withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    # A set takes part in the tile of its block with itself and with each other block of its family.
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    members = members.withColumn("other", other)
    low, high = F.least("block", "other"), F.greatest("block", "other")
    tiles = members.select("root", low.alias("low"), high.alias("high"), "block", "cls", "n", "shared")

    def run(table: pa.Table) -> pa.Table:
        sets = [np.cumsum(unpacked(x.as_py())) for x in table["shared"]]
        found = tile_links(table["cls"].to_pylist(), table["n"].to_numpy(), sets, table["block"].to_numpy(), percent)
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return tiles.groupBy("root", "low", "high").applyInArrow(run, "a long, b long")


def similar_groups(
    docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, keep: Sequence[str] = ("doc_id",), block_bytes: int = BLOCK_BYTES,
    bucket_bytes: int = BUCKET_BYTES, tile_sets: int = TILE_SETS,
) -> DataFrame:
    """Per row of ``docs`` (with doc_id and text): ``row`` (the columns in ``keep``), ``n_shingles``, ``component`` (a key of its component, null
    for a document without links) and ``component_id``, the smallest doc_id of all documents that links reach."""
    rows = _with_classes(docs, width, [*keep, *({"doc_id"} - set(keep))])
    ids = settle(rows.select("row.doc_id", "n", "cls"))
    sets = _shared_part(docs, width, percent, block_bytes, bucket_bytes)
    families = components(_families(sets, percent, bucket_bytes))
    groups = components(_links(sets, families, percent, tile_sets))
    firsts = ids.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("rows"))
    firsts = settle(firsts.join(groups, firsts["cls"] == groups["node"], "left").withColumn("root", F.coalesce("root", "cls")).select("cls", "root", "first", "rows"))
    named = firsts.groupBy("root").agg(F.min("first").alias("component_id"), F.sum("rows").alias("rows")).where("rows > 1")
    named = firsts.select("cls", F.col("root").alias("_root")).join(named, F.col("_root") == named["root"]).select(F.col("cls").alias("_cls"), F.col("_root").alias("component"), "component_id")
    if tuple(keep) == ("doc_id",):
        rows = ids.select(F.struct("doc_id").alias("row"), "n", "cls")
    matched = rows.join(named, (F.col("cls") == F.col("_cls")) & (F.col("n") > 0), "left")
    return matched.select("row", F.col("n").alias("n_shingles"), "component", F.coalesce("component_id", "row.doc_id").alias("component_id"))


def one_of_each(grouped: DataFrame) -> DataFrame:
    """The carried columns of one document of each component, the one of smallest id, and of all documents without links."""
    alone = grouped.where("component IS NULL").select("row.*")
    order = F.struct(F.col("row.doc_id").isNull(), "row.doc_id", F.xxhash64("row"))
    chosen = grouped.where("component IS NOT NULL").groupBy("component").agg(F.min_by("row", order).alias("row"))
    return alone.unionByName(chosen.select("row.*"))
