"""Personal data by bootstrapped contextual extraction.

Base rules find email addresses, IP numbers, card numbers and phone numbers by form; they are the seeds. The words around an instance make
lexical patterns ("call _", "_ for help"). Instances and patterns form a graph with one edge per kind, pattern and instance. Spark scores it in
rounds: a pattern's confidence is the belief in what it surrounds over all that it surrounds in the corpus, ordinary words included (a
candidate that is not believed weighs ``unknown`` of a word, as it may be what the pattern is to discover); the belief in an instance is the
noisy-or of its confident patterns, and 1 for seeds. Patterns that only became confident through instances
found before count in the next round. Identifiers in other forms than the base rules know (a phone number without its plus sign, an address with a
number out of range, a card number with a wrong digit) are added where the belief is high enough; so are other spellings of a seed.

Candidates have a loose form of their kind, so that ordinary words and short numbers are never added:

    email   letters and digits around ``@``, or around `` at `` with `` dot `` behind it
    ip      four numbers parted by points, or five or more hexadecimal groups parted by colons
    card    12 to 19 digits with blanks, points or hyphens between them
    phone   7 to 15 digits with blanks, points, hyphens, slashes and brackets between them

A pattern needs ``least_instances`` different instances. Patterns whose confidence could not reach the threshold if all their candidates were
believed are dropped before the rounds: their corpus counts are found in one pass over the texts, in which a bit map of fixed size tells
which word positions may matter. So neither the graph nor its scores ever stand on the driver or in one task.

Spans are in code points, end exclusive. Null and empty texts have none; a null id is an id like any other; repeated rows are rows of their own,
and copies of a text do not make an instance more believable, as different instances are counted. Empty tables give no rows."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.llm.text import _LOWER_CODES, mixed, packed_row, pieces, prefix_sums, span_hash
from kinfold.sources.shared import settle

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)

LEAST_INSTANCES = 3
CONFIDENCE = 0.7
BELIEF = 0.7
UNKNOWN = 0.25
ROUNDS = 3
#: Bits of the map that preselects word positions; patterns beyond it only make the preselection coarser.
MAP_BITS = 1 << 23

# --- base rules ----------------------------------------------------------------
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_NO_DIGIT = re.compile(r"[^0-9]")

# --- loose forms of candidates ---------------------------------------------------
_SIGN = r"(?:@| at | ?[\[(](?:at|@)[\])] ?)"
_POINT = r"(?:\.| dot | ?[\[(](?:dot|\.)[\])] ?)"
_AT_WORDS = re.compile(rf"(?<![\w.%+-])[a-z0-9][a-z0-9._%+-]{{0,63}}{_SIGN}[a-z0-9-]{{1,63}}(?:{_POINT}[a-z0-9-]{{1,63}})+(?![\w-])", re.I | re.A)
_AT_HOST = re.compile(r"(?<![\w.%+-])[a-z0-9][a-z0-9._%+-]{0,63}@[a-z0-9-]{1,63}(?![\w.-])", re.I | re.A)
_IP_LIKE = re.compile(r"(?<![\w.:])(?=[0-9a-f:]*[0-9])(?:[0-9]{1,5}(?:\.[0-9]{1,5}){3}|[0-9a-f]{0,4}(?::[0-9a-f]{0,4}){4,7})(?![\w:]|\.[0-9])", re.I | re.A)
_NUMBER = re.compile(r"(?<![\w+.(/-])\(?[0-9][0-9().\x20/-]{5,30}[0-9](?![\w/-]|\.[0-9])", re.A)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        value = int(d) * (1 + i % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by the base rules, by kind, then start. Every rule reads the text once: no pattern goes back over a long run."""
    found = []
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            found.append((EMAIL, start, domain.end()))
            done = domain.end()
        else:
            done = at + 1  # what stands before this sign can only belong to it
        at = text.find("@", max(at + 1, done))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            found.append((IP, m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = _NO_DIGIT.sub("", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append((CARD, m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_NO_DIGIT.sub("", m[0])) <= 15:
            found.append((PHONE, m.start(), m.end()))
    return found


def candidate_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(kind, start, end) of what has a loose form and touches no base span. A number may be a candidate of two kinds."""
    found = []
    if "@" in text or " at " in text.lower():
        found += [(EMAIL, m.start(), m.end()) for rule in (_AT_WORDS, _AT_HOST) for m in rule.finditer(text)]
    found += [(IP, m.start(), m.end()) for m in _IP_LIKE.finditer(text)]
    for m in _NUMBER.finditer(text):
        n = len(_NO_DIGIT.sub("", m[0]))
        start = m.start() + (m[0][0] == "(" and ")" not in m[0])
        if 12 <= n <= 19 and not set(m[0]) & set("()/"):
            found.append((CARD, start, m.end()))
        if 7 <= n <= 15:
            found.append((PHONE, start, m.end()))
    if not found or not base:
        return found
    order = sorted((s, e) for _, s, e in base)
    starts = np.array([s for s, _ in order])
    reach = np.maximum.accumulate(np.array([e for _, e in order]))
    out = []
    for kind, s, e in found:
        before = int(np.searchsorted(starts, e)) - 1  # the last base span that begins before the candidate ends
        if before < 0 or reach[before] <= s:
            out.append((kind, s, e))
    return out


def instance(kind: int, text: str) -> str:
    """Equal for spellings of one identifier."""
    if kind in (CARD, PHONE):
        return _NO_DIGIT.sub("", text)
    return text.lower() if kind == IP else re.sub(_POINT, ".", re.sub(_SIGN, "@", text.lower()))


# --- words and contexts ------------------------------------------------------------
_IS_WORD = np.array([b >= 0x80 or 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A for b in range(256)])
_IS_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_IS_SIGN = np.arange(256) == ord("@")
_IS_LETTER = _IS_WORD & ~np.isin(np.arange(256), [*b"0123456789"])
_EDGE = np.uint64(0x2D358DCCAA6C78A5)
_SHAPES = np.array([0x8BB84B93962EACC9, 0x4B33A62ED433D4A3, 0x4D5A2DA51DE1AA47, 0xA0761D6478BD642F], np.uint64)
_STEP = np.uint64(0xE7037ED1A0B428DB)


class Words:
    """The words of a piece, runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]``, with their lower-cased hashes and documents."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        edge = np.zeros(len(raw) + 1, bool)
        edge[offsets] = True
        inside = _IS_WORD[raw]
        begins, ends = edge[:-1].copy(), edge[1:].copy()
        begins[1:] |= ~inside[:-1]
        ends[:-1] |= ~inside[1:]
        self.start, self.end = np.flatnonzero(begins & inside), np.flatnonzero(ends & inside) + 1
        self.first = np.searchsorted(self.start, offsets)  # of each document, and the end
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        self.hash = span_hash(prefix_sums(raw, _LOWER_CODES), self.start, self.end) if len(raw) else np.zeros(0, np.uint64)

    def near(self, index: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Hashes of the words at these places; an edge beyond their document."""
        inside = (index >= self.first[doc]) & (index < self.first[doc + 1])
        out = np.full(len(index), _EDGE)
        out[inside] = self.hash[index[inside]]
        return out

    def contexts(self, before: np.ndarray, after: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Four keys a row, from the word at ``before`` and the one before it, and the word at ``after`` and the one behind it:
        ``l _``, ``l l _``, ``l _ r``, ``_ r r``."""
        l1, l2, r1, r2 = (self.near(i, doc) for i in (before, before - 1, after, after + 1))
        pairs = ((l1, np.full(len(l1), _EDGE)), (l1, l2), (l1, r1), (r1, r2))
        return np.stack([mixed((mixed(a + shape) * _STEP) ^ mixed(b + shape)) for shape, (a, b) in zip(_SHAPES, pairs, strict=True)], axis=1)


def _plain(raw: np.ndarray, words: Words, offsets: np.ndarray) -> np.ndarray:
    """Words with a letter in a blank-delimited token without ``@``: what a pattern surrounds besides identifiers and numbers."""
    signs, letters = np.zeros(len(raw) + 1, np.int32), np.zeros(len(raw) + 1, np.int32)
    np.cumsum(_IS_SIGN[raw], out=signs[1:])
    np.cumsum(_IS_LETTER[raw], out=letters[1:])
    cut = np.union1d(np.flatnonzero(_IS_SPACE[raw]), offsets)
    token = np.searchsorted(cut, words.start, "right")
    low = np.concatenate([[0], cut])[token]
    high = np.concatenate([cut, [len(raw)]])[token]
    return (signs[high] == signs[low]) & (letters[words.end] > letters[words.start])


_OCCURRENCE = "struct<kind:int,instance:string,seed:boolean,start:int,end:int,contexts:array<long>>"


def _find(texts: pa.Array) -> pa.Array:
    """Base spans and candidates of every text, with their contexts."""
    out = []
    for first, last, raw, offsets in pieces(texts):
        words = Words(raw, offsets)
        spans, owner, at = [], [], []
        for i in range(last - first):
            own = raw[offsets[i] : offsets[i + 1]]
            text = own.tobytes().decode("utf-8", "replace")
            base = base_spans(text)
            mine = [(k, s, e, True) for k, s, e in base] + [(k, s, e, False) for k, s, e in candidate_spans(text, base)]
            spans.append([(k, instance(k, text[s:e]), seed, s, e) for k, s, e, seed in mine])
            if mine:
                points = np.array([(s, e) for _, s, e, _ in mine])
                if len(text) < len(own):  # code points to bytes
                    byte = np.append(np.flatnonzero((own & 0xC0) != 0x80), len(own))
                    points = byte[np.minimum(points, len(byte) - 1)]
                at.append(points + offsets[i])
                owner.append(np.full(len(mine), i))
        if at:
            place, doc = np.concatenate(at), np.concatenate(owner)
            before = np.searchsorted(words.end, place[:, 0], "right") - 1
            after = np.searchsorted(words.start, place[:, 1])
            keys = words.contexts(before, after, doc).view(np.int64).tolist()
        k = 0
        for own in spans:
            out.append([(*s, keys[k + j]) for j, s in enumerate(own)])
            k += len(own)
    fields = ("kind", "instance", "seed", "start", "end", "contexts")
    types = (pa.int32(), pa.string(), pa.bool_(), pa.int32(), pa.int32(), pa.list_(pa.int64()))
    flat = [o for own in out for o in own]
    items = pa.StructArray.from_arrays([pa.array([o[c] for o in flat], t) for c, t in enumerate(types)], list(fields))
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, out)]), pa.int32()), items)


def find_instances(docs: DataFrame, keep: Sequence[str]) -> DataFrame:
    """``id``, ``row`` and ``found`` (base spans and candidates with their contexts) of every row; written once."""
    found = F.arrow_udf(_find, f"array<{_OCCURRENCE}>")(F.col("text")).alias("found")
    return settle(docs.select(F.monotonically_increasing_id().alias("id"), packed_row(keep), found))


def _edges(rows: DataFrame, least: int) -> DataFrame:
    """``kind, pattern, instance, seed, n`` of the patterns around enough different instances. Repeats are summed on the map side."""
    flat = rows.select(F.explode("found").alias("o")).select("o.kind", "o.instance", "o.seed", F.explode("o.contexts").alias("pattern"))
    edges = settle(flat.groupBy("kind", "pattern", "instance").agg(F.max("seed").alias("seed"), F.count(F.lit(1)).alias("n")))
    enough = edges.groupBy("kind", "pattern").agg(F.count(F.lit(1)).alias("instances")).where(F.col("instances") >= least)
    return settle(edges.join(enough.select("kind", "pattern"), ["kind", "pattern"]))


def _surrounded(docs: DataFrame, patterns: DataFrame, map_bits: int) -> DataFrame:
    """``pattern, plain``: how many plain words of the corpus each pattern surrounds. The map has ``map_bits`` bits, whatever the data."""
    slot = F.pmod("pattern", F.lit(map_bits))
    numbered = patterns.select((slot / 32).cast("int").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (slot % 32).cast("int")).alias("bit"))
    bits = np.zeros(map_bits // 32, np.uint32)
    for word, value in numbered.groupBy("word").agg(F.bit_or("bit")).collect():  # at most map_bits / 32 rows
        bits[word] = value
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            for _, _, raw, offsets in pieces(batch.column(0)):
                words = Words(raw, offsets)
                spots = np.flatnonzero(_plain(raw, words, offsets))
                keys = words.contexts(spots - 1, spots + 1, words.doc[spots]).ravel().view(np.int64)
                slot = np.mod(keys, map_bits)
                keys = keys[(table[slot // 32] >> (slot % 32).astype(np.uint32)) & 1 > 0]
                distinct, n = np.unique(keys, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(distinct), pa.array(n.astype(np.int64))], ["pattern", "n"])

    counted = docs.select("text").mapInArrow(count, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("plain"))
    return counted.join(patterns.select("pattern").distinct(), "pattern")


def score_graph(
    edges: DataFrame, plain: DataFrame, least_instances: int = LEAST_INSTANCES, confidence: float = CONFIDENCE, rounds: int = ROUNDS,
    unknown: float = UNKNOWN,
) -> tuple[DataFrame, DataFrame]:
    """Patterns (``kind, pattern, confidence``) and instances (``kind, instance, belief``) after the rounds."""
    per_pattern = edges.groupBy("kind", "pattern").agg(F.sum("n").alias("n")).join(plain, "pattern", "left")
    others = F.coalesce("plain", F.lit(0)) + 1
    hopeful = per_pattern.where(F.col("n") >= confidence * (F.col("n") + others))  # if all candidates were believed
    live = settle(edges.join(hopeful.select("kind", "pattern", others.alias("others")), ["kind", "pattern"]))
    believed = F.when(F.col("seed"), F.lit(1.0))
    beliefs = live.select("*", F.coalesce(believed, F.lit(0.0)).alias("belief"))
    for _ in range(rounds):
        per = beliefs.groupBy("kind", "pattern").agg(
            F.sum(F.col("n") * F.col("belief")).alias("mass"), F.sum("belief").alias("instances"), F.sum("n").alias("n"), F.max("others").alias("others")
        )
        rest = F.col("others") + unknown * (F.col("n") - F.col("mass"))
        patterns = per.select("kind", "pattern", (F.col("mass") / (F.col("mass") + rest)).alias("confidence"), "instances")
        patterns = settle(patterns.where((F.col("confidence") >= confidence) & (F.col("instances") >= least_instances)).drop("instances"))
        # 1 - product of (1 - confidence); a confidence is below 1, as others are at least 1.
        doubt = F.exp(F.sum(F.log1p(-F.col("confidence"))))
        instances = live.join(patterns, ["kind", "pattern"]).groupBy("kind", "instance").agg((1 - doubt).alias("belief"))
        instances = settle(instances)
        found = instances.select("kind", "instance", F.col("belief").alias("found"))
        beliefs = settle(live.join(found, ["kind", "instance"], "left").select(*live.columns, F.coalesce(believed, F.col("found"), F.lit(0.0)).alias("belief")))
    return patterns, instances


def _added(rows: DataFrame, instances: DataFrame, belief: float) -> DataFrame:
    """``id, added``: the candidates whose instance is believed, or is a seed elsewhere, one kind for each place."""
    flat = rows.select("id", F.explode("found").alias("o")).select("id", "o.*")
    # A candidate that is a seed elsewhere in another spelling needs no context.
    wanted = flat.where("NOT seed").select("kind", "instance").distinct()
    known = flat.where("seed").select("kind", "instance").distinct().join(wanted, ["kind", "instance"]).select("kind", "instance", F.lit(1.0).alias("belief"))
    accepted = instances.where(F.col("belief") >= belief).select("kind", "instance", "belief").unionByName(known)
    accepted = settle(accepted.groupBy("kind", "instance").agg(F.max("belief").alias("belief")))
    places = flat.where("NOT seed").select("id", "kind", "instance", "start", "end").join(accepted, ["kind", "instance"])
    spans = places.groupBy("id").agg(F.collect_list(F.struct((-F.col("belief")).alias("down"), "kind", "start", "end")).alias("spans"))
    return spans.select("id", F.arrow_udf(_without_overlaps, "array<struct<kind:int,start:int,end:int>>")("spans").alias("added"))


def _without_overlaps(column: pa.Array) -> pa.Array:
    out = []
    for spans in column.to_pylist():
        taken: list[dict] = []
        by_start = sorted(spans, key=lambda s: (s["start"], -s["end"], s["down"], s["kind"]))
        for s in by_start:
            if not taken or s["start"] >= taken[-1]["end"]:
                taken.append(s)
            elif (s["down"], s["kind"]) < (taken[-1]["down"], taken[-1]["kind"]) and (len(taken) < 2 or s["start"] >= taken[-2]["end"]):
                taken[-1] = s
        out.append([{k: s[k] for k in ("kind", "start", "end")} for s in taken])
    return pa.array(out, pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])))


def find_personal_data(
    docs: DataFrame, keep: Sequence[str] = ("doc_id",), least_instances: int = LEAST_INSTANCES, confidence: float = CONFIDENCE, belief: float = BELIEF,
    rounds: int = ROUNDS, unknown: float = UNKNOWN, map_bits: int = MAP_BITS,
) -> DataFrame:
    """Per row of ``docs`` (with ``text``): ``row`` (the columns in ``keep``), ``base`` and ``added``, arrays of (kind, start, end) by kind and
    start. Kinds are numbers in the order of ``KINDS``."""
    rows = find_instances(docs, keep)
    edges = _edges(rows, least_instances)
    plain = settle(_surrounded(docs, edges.select("pattern").distinct(), map_bits))
    _, instances = score_graph(edges, plain, least_instances, confidence, rounds, unknown)
    added = _added(rows, instances, belief)
    span = lambda o: F.struct(o["kind"].alias("kind"), o["start"].alias("start"), o["end"].alias("end"))
    base = F.array_sort(F.transform(F.filter("found", lambda o: o["seed"]), span))
    none = F.array().cast("array<struct<kind:int,start:int,end:int>>")
    return rows.select("id", "row", base.alias("base")).join(added, "id", "left").select("row", "base", F.array_sort(F.coalesce("added", none)).alias("added"))


def count_of(spans: str, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def listed(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")
