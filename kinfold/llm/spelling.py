"""Spelling variant grouping with blocked Gram matrices.

Words that differ by one inserted, deleted or replaced letter have letter counts whose squared distance is 1 (lengths differ by one) or 2
(equal lengths). Blocks of words give matrices X of letter counts, one row per word; X Y' and the row norms yield all squared distances of a
block at once. Pairs at 1 or 2 are kept and verified letter by letter.

A block holds words of one length m and of m + 1 that agree on a half: the first m // 2 letters, or the letters behind the cut. One edit leaves
one of the halves alone, so no pair is lost and most pairs never meet; a pair that agrees on both halves counts in the first block
only. A block of more than ``tile_words`` words is cut into tiles, pairs of parts of that size, so a half that very many words share is spread over
tasks. Tiles report, per word, how many near words it met and the best of them, never the pairs.

Letters are ``A-Z a-z`` and the code points C0 to FF; only A-Z are lower-cased. Null and empty texts have no words, a null id counts as empty,
repeated rows count as often as they stand, other columns are not read. Words of any length are compared in full. Empty tables give no rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.sources.shared import settle

LETTERS = "[A-Za-z\u00C0-\u00FF]+"
#: One run in so many (by crc32) loses a letter.
DAMAGE = 199
LEAST_LETTERS = 6
LEAST_COUNT = 5
#: A form occurs so many times as often as its variant, at least.
FORM_RATIO = 5
TILE_WORDS = 1024
#: Words that meet in one task call, on average.
BUCKET_WORDS = 1 << 15
#: Letters of pairs that are verified at once.
_CELLS = 1 << 22

_ACCENTS = 0xC0
_WIDTH = 26 + 64  # a-z, and the code points C0 to FF


def damaged_words(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT) -> DataFrame:
    """``word, n``: the lower-cased runs of letters of all texts, some with a letter removed as their hash says, that are long and frequent enough."""
    texts = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    runs = texts.select("id", F.explode(F.regexp_extract_all("text", F.lit(LETTERS), F.lit(0))).alias("run"))
    runs = runs.where(F.length("run") >= least_letters)  # a run never grows
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    lowered = runs.select("id", F.translate("run", upper, lower).alias("run"))
    hashed = lowered.select("run", F.crc32(F.encode(F.concat("id", F.lit(":"), "run"), "UTF-8")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.length("run")))
    words = hashed.select(F.when(F.col("h") % DAMAGE == 0, cut).otherwise(F.col("run")).alias("word")).where(F.length("word") >= least_letters)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def letter_counts(codes: np.ndarray) -> np.ndarray:
    """One row of letter counts per row of code points. Counts and their products are whole numbers, exact in doubles."""
    column = np.where(codes >= _ACCENTS, codes - _ACCENTS + 26, codes - ord("a"))
    flat = np.arange(len(codes))[:, None] * _WIDTH + column
    return np.bincount(flat.ravel(), minlength=len(codes) * _WIDTH).reshape(len(codes), _WIDTH).astype(np.float64)


def _codes(words: list[str]) -> np.ndarray:
    """The code points of words of one length, a row each."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1).astype(np.int32)


def _pairs_at(x: np.ndarray, y: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs whose letter counts have this squared distance, from one Gram product."""
    squared = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * (x @ y.T)
    return np.nonzero(squared == distance)


def one_replaced(x: np.ndarray, i: np.ndarray, y: np.ndarray, j: np.ndarray) -> np.ndarray:
    return (x[i] != y[j]).sum(axis=1) == 1


def one_inserted(short: np.ndarray, i: np.ndarray, long: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether one letter of the longer word, left out, gives the shorter one."""
    a, b = short[i], long[j]
    ahead = np.cumprod(a == b[:, :-1], axis=1).sum(axis=1)
    behind = np.cumprod((a == b[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return ahead + behind >= a.shape[1]


def _verified(check, x: np.ndarray, i: np.ndarray, y: np.ndarray, j: np.ndarray) -> np.ndarray:
    step = max(1, _CELLS // max(1, y.shape[1]))
    return np.concatenate([np.zeros(0, bool), *[check(x, i[a : a + step], y, j[a : a + step]) for a in range(0, len(i), step)]])


def block_pairs(words: list[str], parts: np.ndarray, m: int, first_half: bool, one_part: bool) -> tuple[np.ndarray, np.ndarray]:
    """Near pairs of a tile, each once: of two words of length m, or of one of length m and one of m + 1. Words of a tile of two parts
    pair across the parts only."""
    length = np.array([len(w) for w in words])
    short, long = np.flatnonzero(length == m), np.flatnonzero(length == m + 1)
    found = []
    a = _codes([words[k] for k in short]) if len(short) else np.zeros((0, m), np.int32)
    x = letter_counts(a)
    if len(short) > 1:
        i, j = _pairs_at(x, x, 2)
        keep = (i < j) & (one_part | (parts[short[i]] != parts[short[j]]))
        i, j = i[keep], j[keep]
        keep = _verified(one_replaced, a, i, a, j)
        found.append((short[i[keep]], short[j[keep]]))
    if len(short) and len(long):
        b = _codes([words[k] for k in long])
        i, j = _pairs_at(x, letter_counts(b), 1)
        keep = one_part | (parts[short[i]] != parts[long[j]])
        if not first_half:  # pairs that agree on the first half, too, count there
            keep &= (a[i, : m // 2] != b[j, : m // 2]).any(axis=1)
        i, j = i[keep], j[keep]
        keep = _verified(one_inserted, a, i, b, j)
        found.append((short[i[keep]], long[j[keep]]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([i for i, _ in found]), np.concatenate([j for _, j in found])


def _near_in_bucket(table: pa.Table) -> pa.Table:
    """The tiles of a bucket, one after the other: per word, its near words in the tile and the best of them."""
    words, n = table["word"].to_pylist(), table["n"].to_numpy()
    m, side, part, low, high = (table[c].to_numpy() for c in ("m", "side", "part", "low", "high"))
    halves = table["half"].combine_chunks().dictionary_encode().indices.to_numpy()
    order = np.lexsort((high, low, side, m, halves))
    change = np.zeros(len(order) + 1, bool)
    change[[0, -1]] = True
    for key in (halves, m, side, low, high):
        change[1:-1] |= key[order][1:] != key[order][:-1]
    bounds = np.flatnonzero(change)
    out = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a < 2:
            continue
        rows = order[a:b]
        tile = [words[k] for k in rows]
        i, j = block_pairs(tile, part[rows], int(m[rows[0]]), bool(side[rows[0]] == 0), bool(low[rows[0]] == high[rows[0]]))
        if not len(i):
            continue
        word, other = np.concatenate([i, j]), np.concatenate([j, i])
        rank = np.empty(len(tile), np.int64)  # the best near word: most frequent, then first in order of code points
        rank[sorted(range(len(tile)), key=lambda k: (-n[rows[k]], tile[k]))] = np.arange(len(tile))
        by_word = np.lexsort((rank[other], word))
        own, first, count = np.unique(word[by_word], return_index=True, return_counts=True)
        best = other[by_word][first]
        out.extend((tile[w], c, tile[o], n[rows[o]]) for w, c, o in zip(own.tolist(), count.tolist(), best.tolist(), strict=True))
    schema = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best", pa.string()), ("best_n", pa.int64())])
    return pa.table(dict(zip(schema.names, zip(*out, strict=True) if out else [[]] * 4, strict=True)), schema=schema)


def near_words(words: DataFrame, tile_words: int = TILE_WORDS, bucket_words: int = BUCKET_WORDS) -> DataFrame:
    """``word, n_near, best, best_n`` of every word of ``words`` (word, n; distinct) that has near words."""
    roles = F.array(F.struct(F.lit(0).alias("longer")), F.struct(F.lit(1).alias("longer")))
    placed = words.select("word", "n", F.explode(roles).alias("r")).withColumn("m", F.length("word") - F.col("r.longer"))
    cut = F.floor(F.col("m") / 2).cast("int")
    head = F.col("word").substr(F.lit(1), cut)
    tail = F.when(F.col("r.longer") == 0, F.col("word").substr(cut + 1, F.length("word"))).otherwise(F.col("word").substr(cut + 2, F.length("word")))
    sides = F.array(F.struct(F.lit(0).alias("side"), head.alias("half")), F.struct(F.lit(1).alias("side"), tail.alias("half")))
    placed = placed.select("word", "n", "m", F.explode(sides).alias("s")).select("word", "n", "m", "s.side", "s.half")
    key = ["m", "side", "half"]
    sizes = placed.groupBy(*key).agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    sizes = sizes.select(*key, F.ceil(F.col("size") / tile_words).cast("int").alias("parts"))
    dealt = placed.join(sizes, key).withColumn("part", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"))
    tiles = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    tiles = tiles.select("word", "n", *key, "part", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"))
    n_buckets = max(1, -(-4 * words.count() // bucket_words))
    tiles = tiles.withColumn("bucket", F.pmod(F.xxhash64(*key, "low", "high"), F.lit(n_buckets)).cast("int"))
    found = tiles.groupBy("bucket").applyInArrow(_near_in_bucket, "word string, n_near long, best string, best_n long")
    best = F.min(F.struct((-F.col("best_n")).alias("down"), "best")).alias("b")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", "b.best", (-F.col("b.down")).alias("best_n"))


def with_roots(forms: DataFrame) -> DataFrame:
    """Adds ``root``: where the forms (word, form) lead in the end. A form is more frequent than its variant, so there are no cycles;
    the ways double in every round, so rounds grow with the logarithm of the longest way."""
    up = settle(forms.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    while True:
        above = up.select(F.col("word").alias("root"), F.col("root").alias("next"))
        jumped = settle(up.join(above, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        up = jumped.select("word", "root")
        if jumped.where("moved").isEmpty():
            break
    return forms.join(up, "word", "left").withColumn("root", F.coalesce("root", "word"))


def variant_groups(words: DataFrame, form_ratio: int = FORM_RATIO, tile_words: int = TILE_WORDS, bucket_words: int = BUCKET_WORDS) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of distinct words (word, n): the form is the most frequent near word (ties: first in code
    point order), if it is ``form_ratio`` times as frequent; the root is where the forms end."""
    words = settle(words.select("word", "n"))
    near = near_words(words, tile_words, bucket_words)
    passes = F.col("best_n") >= form_ratio * F.col("n")
    forms = settle(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(passes, F.col("best")).alias("form"), F.when(passes, F.col("best_n")).alias("form_n")
    ))
    return with_roots(forms).select("word", "form", "root", "n", "n_near", "form_n")
