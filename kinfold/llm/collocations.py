"""Phrase collocations by set-oriented relational mining (SETM).

The relation R1 holds every word occurrence, sorted by piece and position. R(k+1) is the merge join of Rk with itself on the piece and
the adjacent position: two frequent phrases of k words that overlap in all but their outer words make one of k + 1. Every level is
counted over the whole corpus, and only occurrences of frequent groups (a semi-join) take part in the next join.

The relations are written as sorted, packed blocks: texts of some MB, one row each, with one number per occurrence for piece and position
(pieces are a gap apart, so adjacent means one more) and one for the phrase. A block sends a row per distinct phrase with its count, so a
frequent phrase is summed up before it is shuffled; it is named by the first of these rows, and each block is told the names and
totals of its own frequent phrases. Words are compared as strings and phrases as pairs of names: no hashes. The number of
partitions is the session's, at every size.

A null language counts as ``und``, a null text as empty. Repeated rows count as often as they stand. Other columns are not read. Without any
phrase of two words that is frequent enough, or without rows, the result is empty."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinfold.llm.text import _LOWER_CODE, pieces
from kinfold.sources.shared import settle

#: Words of the longest phrase, occurrences that make a phrase frequent, percent of a phrase's occurrences inside a longer one that drop it.
LONGEST = 3
SUPPORT = 10
INSIDE_PERCENT = 50
KEPT = 2000
UNKNOWN_LANG = "und"
BLOCK_BYTES = 8 << 20
#: Bits of a name: the phrase in its block, and the block in its task. 20 more are left for tasks.
ITEM_BITS, BLOCK_BITS = 28, 15
_ROWS = 1 << 16

_IS_STOP = np.isin(np.arange(256), [*b".,;:!?", *range(0x0A, 0x0E)])
_IS_GAP = _IS_STOP | np.isin(np.arange(256), [0x20, 0x09])


def slim(numbers: np.ndarray) -> bytes:
    """Non-negative numbers in as many byte planes as the largest needs."""
    width = max(1, (int(numbers.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + b"".join((numbers >> 8 * plane).astype(np.uint8).tobytes() for plane in range(width))


def unslim(data: bytes) -> np.ndarray:
    width = data[0]
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(width, -1)
    raw = np.zeros((planes.shape[1], 8), np.uint8)
    raw[:, :width] = planes.T
    return raw.view("<i8").reshape(-1)


def word_places(raw: np.ndarray, offsets: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray]:
    """The lower-cased words of some texts, the step from the word before to each (1 within a piece, 2 to the next) and its document."""
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    inside = ~_IS_GAP[raw]
    begins, ends = edge[:-1].copy(), edge[1:].copy()
    begins[1:] |= ~inside[:-1]
    ends[:-1] |= ~inside[1:]
    start, end = np.flatnonzero(begins & inside), np.flatnonzero(ends & inside) + 1
    doc = np.searchsorted(offsets, start, "right") - 1
    stops = np.zeros(len(raw) + 1, np.int32)
    np.cumsum(_IS_STOP[raw], out=stops[1:])
    apart = (stops[start[1:]] > stops[end[:-1]]) | (doc[1:] != doc[:-1])
    step = np.full(len(start), 2, np.uint8)
    step[1:] -= ~apart
    at = np.zeros(len(start) + 1, np.int64)
    np.cumsum(end - start, out=at[1:])
    letters = _LOWER_CODE[raw[inside]]
    words = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(at), pa.py_buffer(letters))
    return words.dictionary_encode(), step, doc


def block_words(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray]:
    """``word_places`` of a block, a small piece at a time: only what a word needs stands for the whole block."""
    found = [(words, step, (doc + first).astype(np.int32)) for first, _, raw, offsets in pieces(texts) for words, step, doc in [word_places(raw, offsets)]]
    words, step, doc = zip(*found, strict=True)
    return pa.chunked_array(words).unify_dictionaries().combine_chunks(), np.concatenate(step), np.concatenate(doc)


def by_frequency(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, the most frequent first, their counts, and the number of each given key among them."""
    rank = np.argsort(keys)
    in_order = keys[rank]
    first = np.ones(len(keys), bool)
    first[1:] = in_order[1:] != in_order[:-1]
    distinct, counts = in_order[first], np.diff(np.flatnonzero(first), append=len(keys))
    del in_order
    order = np.argsort(-counts, kind="stable")
    number = np.empty(len(order), np.int32)
    number[order] = np.arange(len(order), dtype=np.int32)
    of_key = np.empty(len(keys), np.int32)
    of_key[rank] = np.repeat(number, counts)
    return distinct[order], counts[order], of_key


def _one_list(strings: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(strings)], pa.int32()), strings.cast(pa.string()))


def _word_relation(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """R1, a row per block: its number, places and words of its occurrences, and the distinct words with language and count."""
    block = TaskContext.get().partitionId() << BLOCK_BITS
    end = min(block + (1 << BLOCK_BITS), 1 << (63 - ITEM_BITS))
    for batch in batches:
        langs = batch.column(0)
        for first, last, _, _ in pieces(batch.column(1), BLOCK_BYTES):
            words, step, doc = block_words(batch.column(1).slice(first, last - first))
            if not len(step):
                continue
            spoken = langs.slice(first, last - first).dictionary_encode()
            spoken_code = spoken.indices.to_numpy()[doc]
            if block >= end:
                raise OverflowError("more tasks or blocks than names of 63 bits: read the texts in larger partitions")
            distinct, counts, item = by_frequency(spoken_code * np.int64(len(words.dictionary)) + words.indices.to_numpy())
            lang_of, word_of = np.divmod(distinct, len(words.dictionary))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([block]), pa.array([slim(step)], pa.binary()), pa.array([slim(item)], pa.binary()),
                    _one_list(spoken.dictionary.take(pa.array(lang_of))), _one_list(words.dictionary.take(pa.array(word_of))),
                    pa.array([slim(counts)], pa.binary()),
                ],
                ["block", "at", "item", "langs", "words", "n"],
            )
            block += 1


def _own_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per block and distinct word."""
    for batch in batches:
        for i, block in enumerate(batch.column("block").to_pylist()):
            n = unslim(batch.column("n")[i].as_py())
            rows = pa.RecordBatch.from_arrays(
                [pa.array((block << ITEM_BITS) + np.arange(len(n))), batch.column("langs")[i].values, batch.column("words")[i].values, pa.array(n)],
                ["own", "lang", "word", "n"],
            )
            for a in range(0, len(rows), _ROWS):
                yield rows.slice(a, _ROWS)


def _own_phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per block and distinct phrase: the names of the two overlapping phrases one word shorter."""
    for batch in batches:
        for i, block in enumerate(batch.column("block").to_pylist()):
            names, left, right, n = (unslim(batch.column(c)[i].as_py()) for c in ("names", "left", "right", "n"))
            rows = pa.RecordBatch.from_arrays(
                [pa.array((block << ITEM_BITS) + np.arange(len(n))), pa.array(names[left]), pa.array(names[right]), pa.array(n)], ["own", "left", "right", "n"]
            )
            for a in range(0, len(rows), _ROWS):
                yield rows.slice(a, _ROWS)


def join_adjacent(at: np.ndarray, item: np.ndarray, named: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The merge join of a block's relation with itself on adjacent places, after the semi-join with the named (frequent) phrases:
    places and numbers of the pairs, and left, right and count of each distinct pair."""
    kept = named[item]
    at, item = at[kept], item[kept]
    spots = np.flatnonzero(at[1:] - at[:-1] == 1)
    distinct, counts, number = by_frequency(item[spots] * np.int64(len(named)) + item[spots + 1])
    left, right = np.divmod(distinct, max(1, len(named)))
    return at[spots], number, left, right, counts


def _extended(relation: DataFrame, told: DataFrame, last: bool) -> DataFrame:
    """R(k+1) from Rk and the names of each block's frequent phrases. The last level needs no places."""

    def extend(blocks: pa.Table, names: pa.Table) -> pa.Table:
        out = []
        for i in range(len(blocks)):
            item = unslim(blocks["item"][i].as_py())
            name = np.full(int(item.max(initial=0)) + 1, -1, np.int64)
            name[names["item"].to_numpy()] = names["name"].to_numpy()
            at, number, left, right, counts = join_adjacent(np.cumsum(unslim(blocks["at"][i].as_py())), item, name >= 0)
            used = np.zeros(len(name), bool)
            used[left] = used[right] = True
            where = np.cumsum(used, dtype=np.int32) - 1
            places = (b"", b"") if last else (slim(np.diff(at, prepend=0)), slim(number))
            out.append((blocks["block"][i].as_py(), *places, slim(name[used]), slim(where[left]), slim(where[right]), slim(counts)))
        return pa.table(dict(zip(_PHRASES.names, zip(*out, strict=True) if out else [[]] * len(_PHRASES), strict=True)), schema=_PHRASES)

    own = told.select((F.shiftright("own", ITEM_BITS)).alias("block"), F.col("own").bitwiseAND(F.lit((1 << ITEM_BITS) - 1)).alias("item"), "name")
    pairs = relation.select("block", "at", "item").groupBy("block").cogroup(own.groupBy("block"))
    return pairs.applyInArrow(extend, "block long, at binary, item binary, names binary, left binary, right binary, n binary")


_PHRASES = pa.schema([("block", pa.int64()), *[(c, pa.binary()) for c in ("at", "item", "names", "left", "right", "n")]])


def _frequent(own: DataFrame, key: list[str], support: int) -> DataFrame:
    """The groups that are frequent over all blocks: every block's ``own`` row with the group's ``name``; the row that gives the
    name also has the key and the ``total``."""
    group = W.partitionBy(*key)
    counted = own.select("own", *key, F.sum("n").over(group).alias("total"), F.min("own").over(group).alias("name")).where(F.col("total") >= support)
    first = F.col("own") == F.col("name")
    return settle(counted.select("own", "name", *[F.when(first, F.col(c)).alias(c) for c in [*key, "total"]]))


def frequent_phrases(docs: DataFrame, longest: int = LONGEST, support: int = SUPPORT) -> tuple[DataFrame, DataFrame]:
    """``lang, phrase, size, n`` of all phrases of 1 to ``longest`` words with n >= support occurrences, and ``lang, n`` with all word occurrences."""
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN_LANG)).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    relation = settle(texts.mapInArrow(_word_relation, "block long, at binary, item binary, langs array<string>, words array<string>, n binary"))
    own = relation.select("block", "langs", "words", "n").mapInArrow(_own_words, "own long, lang string, word string, n long")
    sizes = own.groupBy("lang").agg(F.sum("n").alias("n"))
    told = _frequent(own, ["lang", "word"], support)
    levels = [told.where("total IS NOT NULL").select("name", "lang", F.col("word").alias("phrase"), F.col("total").alias("n"))]
    for size in range(2, longest + 1):
        relation = settle(_extended(relation, told, size == longest))
        own = relation.select("block", "names", "left", "right", "n").mapInArrow(_own_phrases, "own long, left long, right long, n long")
        told = _frequent(own, ["left", "right"], support)
        before = levels[-1]
        left = before.select(F.col("name").alias("left"), "lang", F.col("phrase").alias("begin"))
        right = before.select(F.col("name").alias("right"), F.substring_index("phrase", " ", -1).alias("end"))
        grown = told.where("total IS NOT NULL").select("name", "left", "right", F.col("total").alias("n")).join(left, "left").join(right, "right")
        levels.append(settle(grown.select("name", "lang", F.concat_ws(" ", "begin", "end").alias("phrase"), "n")))
    found = levels[0].select("lang", "phrase", F.lit(1).alias("size"), "n")
    for size, level in enumerate(levels[1:], 2):
        found = found.unionByName(level.select("lang", "phrase", F.lit(size).alias("size"), "n"))
    return settle(found), sizes


def _share(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (left right)), exact: products take up to 37 digits."""
    a, left, right = (c.cast("decimal(15,0)") for c in (a, left, right))
    over = F.lit(1_000_000).cast("decimal(7,0)") * a * a
    under = left * right
    return F.floor((over - F.call_function("mod", over, under)) / under).cast("long")


def collocations(docs: DataFrame, longest: int = LONGEST, support: int = SUPPORT, inside_percent: int = INSIDE_PERCENT, kept: int = KEPT) -> DataFrame:
    """The first ``kept`` collocations of every language by score: ``lang, rank, phrase, a, l, r, n, score``.

    Parts of a frequent phrase are frequent, so the mined phrases hold all numbers that the cuts need."""
    phrases, sizes = frequent_phrases(docs, longest, support)
    known = phrases.select("lang", "phrase", "n")
    candidates = phrases.where("size > 1").select("lang", "phrase", "size", F.col("n").alias("a"))
    cuts = candidates.select("*", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("cut"))
    cuts = cuts.withColumn("head", F.expr("substring_index(phrase, ' ', cut)")).withColumn("tail", F.expr("substring_index(phrase, ' ', cut - size)"))
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("head"), F.col("n").alias("l")), ["lang", "head"])
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("tail"), F.col("n").alias("r")), ["lang", "tail"])
    lowest = F.min(F.struct(_share(F.col("a"), F.col("l"), F.col("r")).alias("score"), "cut", "l", "r")).alias("c")
    scored = cuts.groupBy("lang", "phrase", "a").agg(lowest).select("lang", "phrase", "a", "c.l", "c.r", "c.score")
    words = F.split("phrase", " ")
    spans = F.expr(
        "flatten(transform(sequence(2, size - 1), m -> transform(sequence(1, size - m + 1), i -> array_join(slice(words, i, m), ' '))))"
    )
    longer = candidates.where("size > 2").withColumn("words", words).select("lang", F.explode(spans).alias("phrase"), "a")
    longer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    left = scored.join(longer, ["lang", "phrase"], "left").where(~(F.coalesce("longer", F.lit(0)) * 100 >= F.col("a") * inside_percent))
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = left.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= kept)
    # A handful of rows per language.
    return ranked.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
