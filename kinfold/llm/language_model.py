"""LM scoring with a weighted backoff automaton.

Counts of all n-grams of the training documents define the model: the states are n-grams seen in training, a state's arcs are
the words seen after it with weight (c(hw) + m P(w | h')) / (c(h) + m), where h' is h without its first word, and its failure arc
leads to h' with weight m / (c(h) + m). The lowest state holds (c(w) + 0.5) / (N + 0.5 (V + 1)) for every word. So each state's
weights sum to one. A text is read once from left to right; where the state has no arc for the word, the failure arcs are followed.

No task ever holds the whole model. Documents are dealt by hash into blocks of bounded bytes. Each block sends the keys of
its distinct n-grams, with their counts in its training documents, to buckets of the key range; buckets add up the
counts over all blocks and send every block the totals of its own keys. From these the block builds the part of the automaton that its texts can
reach and reads them. Keys are hashes, of 64 bits for words and 48 bits for longer n-grams.

Null and empty texts are one end token. A null id belongs to the training part by the same rule (its text is empty). Repeated
rows count as often as they stand. Without training documents the score is the base score. Empty tables give no rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.llm.text import blank_words, dealt, mixed, pieces

ORDER = 3
#: Weight m of the shorter context, in occurrences.
STRENGTH = 100.0
BLOCK_BYTES = 8 << 20
#: Different words that a task gathers before it sends them.
HELD_WORDS = 1 << 20
#: Bits of an n-gram's key beyond a single word; the rest of the 64 are zero and shrink to nothing where keys are stored.
GRAM_BITS = 48
#: Bytes of text whose n-grams meet in one bucket, on average.
BUCKET_BYTES = 2 << 20

_BEGIN, _END = np.uint64(0x51ED270B0A1C2D4F), np.uint64(0x2545F4914F6CDD1D)
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)
_GRAM_MASK = np.uint64(((1 << 64) - 1) ^ ((1 << (64 - GRAM_BITS)) - 1))


def in_training(doc_id: Column) -> Column:
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % 5 != 1


def packed(numbers: np.ndarray) -> bytes:
    """Bytes of the numbers, plane by plane: zero planes shrink to nothing in shuffle files."""
    raw = np.ascontiguousarray(numbers, np.uint64).view(np.uint8).reshape(-1, 8)
    return np.ascontiguousarray(raw.T).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(8, -1)
    return np.ascontiguousarray(raw.T).view(np.uint64).reshape(-1)


def small(numbers: np.ndarray) -> bytes:
    """Mostly small counts: a byte each, and the large ones behind."""
    rest = numbers[numbers >= 255]
    return np.int64(len(numbers)).tobytes() + np.minimum(numbers, 255).astype(np.uint8).tobytes() + rest.astype(np.int64).tobytes()


def unsmall(data: bytes) -> np.ndarray:
    n = int(np.frombuffer(data, np.int64, 1)[0])
    out = np.frombuffer(data, np.uint8, n, 8).astype(np.int64)
    out[out == 255] = np.frombuffer(data, np.int64, -1, 8 + n)
    return out


def shrunk(texts: pa.Array) -> pa.Array:
    """Texts as they travel: compressed one by one, nulls as they are."""
    press = zstandard.ZstdCompressor(level=1)
    return pa.array([press.compress(t.as_py().encode("utf-8", "surrogatepass")) if t.is_valid else None for t in texts], pa.binary())


def grown(texts: pa.ChunkedArray) -> pa.Array:
    loose = zstandard.ZstdDecompressor()
    return pa.array([None if t is None else loose.decompress(t) for t in texts.to_pylist()], pa.large_binary()).cast(pa.large_string(), safe=False)


def _bucket_of(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)


def _packets(keys: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    """(bucket, first, last + 1) of sorted keys."""
    if not len(keys):
        return []
    buckets = _bucket_of(keys, bits)
    names, first = np.unique(buckets, return_index=True)
    return list(zip(names.tolist(), first.tolist(), [*first[1:].tolist(), len(keys)], strict=True))


class Grams:
    """The token sequence of a block, begin . words . end for every document, and its distinct n-grams by order."""

    def __init__(self, texts: pa.Array, order: int):
        words, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for _, _, raw, offsets in pieces(texts):
            hashes, starts = blank_words(raw, offsets)
            words.append(hashes)
            counts.append(np.diff(starts))
        self.n_words = np.concatenate(counts)
        size = self.n_words + 2
        self.ends = np.cumsum(size)
        self.begins = self.ends - size
        n = int(size.sum())
        self.is_begin = np.zeros(n, bool)
        self.is_begin[self.begins] = True
        inner = ~self.is_begin
        inner[self.ends - 1] = False
        token = np.empty(n, np.uint64)
        token[self.begins], token[self.ends - 1], token[inner] = _BEGIN, _END, np.concatenate(words)
        self.token = token
        #: By order: the gram that ends at each position (-1 where it would leave the document), keys, a position of each.
        self.at, self.keys, self.place = [], [], []
        ending = token
        valid = np.ones(n, bool)
        for k in range(1, order + 1):
            if k > 1:
                # Grams of order k: the one of order k - 1 that ends a position earlier, then the token.
                ending, before = np.zeros(n, np.uint64), ending
                ending[1:] = mixed(before[:-1] * _STEP + token[1:] + np.uint64(k))
                valid = np.concatenate([[False], valid[:-1]]) & ~self.is_begin if n else valid
            spots = np.flatnonzero(valid)
            own = ending[spots] if k == 1 else ending[spots] & _GRAM_MASK
            keys, first, inverse = np.unique(own, return_index=True, return_inverse=True)
            at = np.full(n, -1, np.int64)
            at[spots] = inverse
            self.at.append(at)
            self.keys.append(keys)
            self.place.append(spots[first])
        every = np.concatenate(self.keys)
        self.order_of_keys = np.argsort(every, kind="stable")
        self.all_keys = every[self.order_of_keys]

    def counts(self, training: np.ndarray) -> np.ndarray:
        """Occurrences in the training documents, in the order of all_keys."""
        used = np.repeat(training, self.ends - self.begins)
        own = [np.bincount(at[used & (at >= 0)], minlength=len(keys)) for at, keys in zip(self.at, self.keys, strict=True)]
        return np.concatenate(own)[self.order_of_keys]


class BackoffAutomaton:
    """The states and arcs that a block's texts can reach. States and arcs are numbered like the grams of their order."""

    def __init__(self, grams: Grams, totals: np.ndarray, n_tokens: int, n_types: int, strength: float):
        flat = np.empty(len(totals), np.int64)
        flat[grams.order_of_keys] = totals
        bounds = np.cumsum([0, *[len(k) for k in grams.keys]])
        self.count = [flat[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        lowest = (self.count[0] + 0.5) / (n_tokens + 0.5 * (n_types + 1))
        self.arc = [lowest]  # probability of the arc that completes the gram
        self.fail = [strength / (c + strength) for c in self.count]  # weight of the state's failure arc
        for k in range(1, len(self.count)):
            end = grams.place[k]
            context, shorter = grams.at[k - 1][end - 1], grams.at[k - 1][end]
            self.arc.append((self.count[k] + strength * self.arc[k - 1][shorter]) / (self.count[k - 1][context] + strength))

    def read(self, grams: Grams) -> np.ndarray:
        """log10 weight of every token. All documents of the block are read side by side: at each position the state is the longest seen
        context, and failure arcs lead to shorter ones until there is an arc."""
        weight = np.zeros(len(grams.token))
        waiting = ~grams.is_begin
        for k in range(len(self.count) - 1, 0, -1):
            spots = np.flatnonzero(waiting & (grams.at[k] >= 0))
            state, arc = grams.at[k - 1][spots - 1], grams.at[k][spots]
            here = self.count[k - 1][state] > 0
            passed = here & (self.count[k][arc] > 0)
            weight[spots[passed]] += np.log10(self.arc[k][arc[passed]])
            failed = here & ~passed
            weight[spots[failed]] += np.log10(self.fail[k - 1][state[failed]])
            waiting[spots[passed]] = False
        spots = np.flatnonzero(waiting)
        weight[spots] += np.log10(self.arc[0][grams.at[0][spots]])
        return weight


def _vocabulary(rows: DataFrame, bits: int) -> tuple[int, int]:
    """Training tokens and distinct ones, ends included."""

    def sent(own: np.ndarray, tokens: int) -> pa.RecordBatch:
        cut = _packets(own, bits)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([b for b, *_ in cut] + [0], pa.int32()),
                pa.array([packed(np.diff(own[i:j], prepend=np.uint64(0))) for _, i, j in cut] + [b""], pa.binary()),
                pa.array([0] * len(cut) + [tokens], pa.int64()),
            ],
            ["bucket", "keys", "tokens"],
        )

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The words of a task, each once for as many texts as fit in memory."""
        held, tokens = np.zeros(0, np.uint64), 0
        for batch in batches:
            training = batch.column("training").to_numpy(zero_copy_only=False)
            for first, last, raw, offsets in pieces(batch.column("text")):
                hashes, starts = blank_words(raw, offsets)
                used = training[first:last]
                held = np.union1d(held, hashes[np.repeat(used, np.diff(starts))])
                tokens += int(np.diff(starts)[used].sum() + used.sum())
                if len(held) > HELD_WORDS:
                    yield sent(held, tokens)
                    held, tokens = held[:0], 0
        yield sent(held, tokens)

    def distinct(table: pa.Table) -> pa.Table:
        keys = [np.cumsum(unpacked(k.as_py())) for k in table["keys"]]
        types = len(np.unique(np.concatenate(keys)))
        return pa.table({"tokens": [sum(table["tokens"].to_pylist())], "types": [types]})

    words = rows.select("text", "training").mapInArrow(local, "bucket int, keys binary, tokens long")
    done = words.groupBy("bucket").applyInArrow(distinct, "tokens long, types long").agg(F.sum("tokens"), F.sum("types")).first()
    return done[0] or 0, (done[1] or 0) + (1 if done[0] else 0)  # and the end token


def score_texts(
    docs: DataFrame, training: Column, order: int = ORDER, strength: float = STRENGTH, keep: Sequence[str] = ("doc_id",),
    block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """Learns from the rows where ``training`` holds and scores all: ``row`` (the columns in ``keep``), ``training``, ``n_tokens``,
    ``n_known``, ``train_tokens``, ``base_score`` and ``score`` (log10 probabilities of the whole text)."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, -(-total // block_bytes))
    bits = max(0, (max(1, total // bucket_bytes) - 1).bit_length())
    block = F.pmod(F.xxhash64("text", *[F.col(f"`{c}`") for c in keep if c == "doc_id"]), F.lit(n_blocks)).cast("int")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col("text"), training.alias("training"), block.alias("block"))
    n_tokens, n_types = _vocabulary(rows, bits)
    rows = dealt(rows.withColumn("text", F.arrow_udf(shrunk, "binary")("text")), n_blocks, "block")

    def count(table: pa.Table) -> pa.Table:
        grams = Grams(grown(table["text"]), order)
        counts = grams.counts(table["training"].to_numpy())
        cut = _packets(grams.all_keys, bits)
        number = table["block"][0].as_py()
        return pa.table({
            "bucket": pa.array([b for b, *_ in cut], pa.int32()), "sender": pa.array([number] * len(cut), pa.int32()),
            "keys": pa.array([packed(np.diff(grams.all_keys[i:j], prepend=np.uint64(0))) for _, i, j in cut], pa.binary()),
            "counts": pa.array([small(counts[i:j]) for _, i, j in cut], pa.binary()),
        })

    def add(table: pa.Table) -> pa.Table:
        keys = [np.cumsum(unpacked(k.as_py())) for k in table["keys"]]
        sizes = np.cumsum([0, *map(len, keys)])
        _, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        counts = np.concatenate([unsmall(c.as_py()) for c in table["counts"]])
        totals = np.bincount(inverse, weights=counts).astype(np.int64)[inverse]
        return pa.table({
            "block": table["sender"], "bucket": table["bucket"],
            "totals": pa.array([small(totals[i:j]) for i, j in zip(sizes[:-1], sizes[1:], strict=True)], pa.binary()),
        })

    def read(texts: pa.Table, sums: pa.Table) -> pa.Table:
        grams = Grams(grown(texts["text"]), order)
        received = sorted(zip(sums["bucket"].to_pylist(), sums["totals"], strict=True), key=lambda p: p[0])
        totals = np.concatenate([np.zeros(0, np.int64), *[unsmall(t.as_py()) for _, t in received]])
        automaton = BackoffAutomaton(grams, totals, n_tokens, n_types, strength)
        spoken = ~grams.is_begin
        c = automaton.count[0][grams.at[0]]
        per_text = lambda values: np.add.reduceat(np.where(spoken, values, 0), grams.begins) if len(values) else values
        return pa.table({
            "row": texts["row"], "training": texts["training"], "n_tokens": pa.array(grams.n_words + 1, pa.int64()),
            "n_known": pa.array(per_text((c > 0).astype(np.int64)), pa.int64()), "train_tokens": pa.array(np.full(len(texts), n_tokens), pa.int64()),
            "base_score": pa.array(per_text(np.log10(automaton.arc[0][grams.at[0]])), pa.float64()), "score": pa.array(per_text(automaton.read(grams)), pa.float64()),
        })

    sent = rows.groupBy("block").applyInArrow(count, "bucket int, sender int, keys binary, counts binary")
    sums = dealt(sent, 1 << bits, "bucket").groupBy("bucket").applyInArrow(add, "block int, bucket int, totals binary")
    schema = rows.select(
        "row", "training", F.lit(0).cast("long").alias("n_tokens"), F.lit(0).cast("long").alias("n_known"),
        F.lit(0).cast("long").alias("train_tokens"), F.lit(0.0).alias("base_score"), F.lit(0.0).alias("score"),
    ).schema
    return rows.groupBy("block").cogroup(sums.groupBy("block")).applyInArrow(read, schema)
