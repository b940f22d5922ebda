"""Toxicity by weak supervision.

Lexicon voters are words, pattern voters are word beginnings and ways of writing; both are proposed by their counts in labelled documents. A
generative label model then finds voters that vote together beyond what the label explains, lets each such cluster speak as one,
and estimates by expectation-maximisation how often each, and the annotation, speaks in toxic and in clean documents. A linear
classifier learns the posterior labels from counts of the voters' words, and scores every document.

Labels are read only from rows whose crc32(doc_id as text) mod 5 is not 0, at most ``max_rows`` of them (those of smallest hash). That
bounds everything that comes to the driver: candidate terms, votes and the model. Every document is scored on its whole text.

Label rows without an id or a label are ignored; a document with several label rows is an example for each. If the examples hold
one label only (or none), every score is that label (or 0). A null or empty text has no votes and gets the model's base score. Empty tables
give no rows."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.llm.text import letter_words, packed_row
from kinfold.sources.shared import settle

MAX_ROWS = 30_000
#: Bytes of a word's beginning that may be a pattern.
BEGINNINGS = (4, 5, 6, 7)
PRECISION = 0.75
#: Voters whose votes correlate more than this, given the label, speak as one.
TOGETHER = 0.4
ROUNDS = 300
_PART_ROWS = 4096


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % 5 == 0


def terms_of(text: str | None) -> Counter:
    """Words and word beginnings (marked ``*``) of a text with their counts."""
    words = Counter(letter_words(text))
    terms = Counter(words)
    for w, n in words.items():
        for size in BEGINNINGS:
            if len(w) > size and w[size] & 0xC0 != 0x80:  # not inside a character
                terms[w[:size] + b"*"] += n
    return terms


def _style(text: str | None) -> tuple[float, float]:
    """Votes on ways of writing: mostly capitals; many exclamation marks."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    capitals = int(((raw >= 65) & (raw <= 90)).sum())
    small = int(((raw >= 97) & (raw <= 122)).sum())
    return float(capitals > 20 and capitals > small), float(int((raw == 33).sum()) * 200 > len(raw) > 0)


STYLES = 2


@dataclass
class ToxicityModel:
    voters: list[bytes]
    weights: np.ndarray  # voters' log counts, styles, log of all hits, hits by length
    bias: float

    def features(self, text: str | None, at: dict[bytes, int]) -> np.ndarray:
        words = Counter(letter_words(text))
        x = np.zeros(len(self.voters) + STYLES + 2)
        hits = 0
        for w, n in words.items():
            if (i := at.get(w)) is not None:
                x[i] += n
                hits += n
            for size in BEGINNINGS:
                if len(w) > size and (i := at.get(w[:size] + b"*")) is not None and w[size] & 0xC0 != 0x80:
                    x[i] += n
                    hits += n
        x[: len(self.voters)] = np.log1p(x[: len(self.voters)])
        x[len(self.voters) :] = (*_style(text), math.log1p(hits), 10 * hits / max(1, sum(words.values())))
        return x


def examples(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """Text and label (0 or 1) of the labelled documents that may be learnt from."""
    usable = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out(F.col("doc_id")))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").select(F.col("doc_id").alias("_id"), (F.col("toxic") != 0).cast("int").alias("y"))
    chosen = settle(chosen.limit(max_rows))
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    found = settle(texts.select("text", "y"))
    if found.count() <= max_rows:
        return found
    # Some ids stand in several documents: the same bound holds for the rows, by hash of the text.
    return settle(found.orderBy(F.xxhash64("text"), "text", "y").limit(max_rows).repartition("text"))


def _counted(rows: DataFrame, only: set[bytes] | None) -> DataFrame:
    """Documents with each term, in all and toxic ones; of the terms in ``only``, if given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every, toxic = Counter(), Counter()
        for batch in batches:
            for text, y in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                found = terms_of(text.as_py()).keys()
                found = found if only is None else found & only
                every.update(found)
                if y:
                    toxic.update(found)
        keys = list(every)
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.binary()), pa.array([every[k] for k in keys], pa.int64()), pa.array([toxic[k] for k in keys], pa.int64())], ["term", "n", "t"]
        )

    return rows.mapInArrow(run, "term binary, n long, t long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))


def propose_voters(rows: DataFrame, n_all: int, n_toxic: int) -> list[bytes]:
    """Terms that stand in toxic documents far more often than chance, strongest first. A beginning replaces its continuations."""
    rate = n_toxic / n_all
    toxic_rows = rows.where("y = 1")
    seen = _counted(toxic_rows, None)
    common = {bytes(r["term"]) for r in seen.where(F.col("t") >= 3).select("term").collect()}
    support = (math.log(max(2, len(common))) + 2) / -math.log(rate)
    counts = [(bytes(r["term"]), r["n"], r["t"]) for r in _counted(rows, common).collect()] if common else []
    ranked = sorted(
        (
            (-(math.log((t + 0.1) / n_toxic) - math.log((n - t + 0.1) / (n_all - n_toxic))) * math.sqrt(t), term)
            for term, n, t in counts
            if t >= support and t / n >= PRECISION
        )
    )
    chosen: list[bytes] = []
    begun: set[bytes] = set()
    for _, term in ranked:
        body = term.rstrip(b"*")
        if not any(body[:size] in begun for size in BEGINNINGS if len(body) >= size):
            chosen.append(term)
            if term.endswith(b"*"):
                begun.add(body)
    return chosen


def _parts(*arrays: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Some rows at a time, as doubles: the whole tables stay small numbers."""
    for start in range(0, len(arrays[0]), _PART_ROWS):
        yield tuple(a[start : start + _PART_ROWS].astype(float) for a in arrays)


def label_model(votes: np.ndarray, annotation: np.ndarray) -> np.ndarray:
    """Posterior probability of the label from votes (documents x voters, 0 or 1) and the annotation, itself a voter of unknown accuracy."""
    clusters = np.arange(votes.shape[1])
    start = np.where(annotation > 0, 0.95, 0.02)
    for given in (start, 1 - start):  # what the label leaves unexplained
        total = max(given.sum(), 1e-9)
        both, mean = np.zeros((votes.shape[1], votes.shape[1])), np.zeros(votes.shape[1])
        for v, g in _parts(votes, given):
            both += (v * g[:, None]).T @ v
            mean += g @ v
        mean /= total
        spread = both / total - np.outer(mean, mean)
        scale = np.sqrt(np.maximum(np.diag(spread), 1e-4))
        for i, j in zip(*np.nonzero(np.triu(spread / np.outer(scale, scale) > TOGETHER, 1)), strict=True):
            clusters[clusters == clusters[j]] = clusters[i]
    joint = [votes[:, clusters == c].max(axis=1) for c in np.unique(clusters)]
    return _estimate(np.stack([*joint, annotation], axis=1).astype(np.uint8), start)


def _estimate(votes: np.ndarray, posterior: np.ndarray) -> np.ndarray:
    """Expectation-maximisation for voters that are independent given the label."""
    every = sum(v.sum(axis=0) for (v,) in _parts(votes))
    for _ in range(ROUNDS):
        share = np.clip(posterior.mean(), 1e-3, 0.5)
        spoken = sum(p @ v for v, p in _parts(votes, posterior))
        toxic = (spoken + 0.5) / (posterior.sum() + 1)
        clean = (every - spoken + 0.01) / ((1 - posterior).sum() + 1)
        clean = np.minimum(clean, toxic)  # a voter is never taken for evidence of the opposite
        silent = np.log((1 - toxic) / (1 - clean))
        weight = np.log(toxic / clean) - silent
        odds = math.log(share / (1 - share)) + silent.sum() + np.concatenate([v @ weight for (v,) in _parts(votes)])
        before, posterior = posterior, 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        if np.abs(posterior - before).max() < 1e-6:
            break
    return posterior


def _linear(x: np.ndarray, y: np.ndarray, decay: float = 1.0) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by Newton steps."""
    w = np.zeros(x.shape[1] + 1)
    ridge = np.full(len(w), decay)
    ridge[-1] = 1e-6
    for _ in range(30):
        curve, slope = np.diag(ridge), -ridge * w
        for part, target in _parts(x, y):
            part = np.hstack([part, np.ones((len(part), 1))])
            p = 1 / (1 + np.exp(-np.clip(part @ w, -30, 30)))
            curve = curve + (part * (p * (1 - p) + 1e-9)[:, None]).T @ part
            slope = slope + part.T @ (target - p)
        step = np.linalg.solve(curve, slope)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> ToxicityModel:
    rows = examples(docs, labels, max_rows)
    n_all, n_toxic = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    if n_toxic in (0, n_all):
        return ToxicityModel([], np.zeros(STYLES + 2), math.inf if n_toxic else -math.inf)
    voters = propose_voters(rows, n_all, n_toxic)
    blank = ToxicityModel(voters, np.zeros(0), 0.0)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = {v: i for i, v in enumerate(voters)}
        for batch in batches:
            found = [blank.features(t.as_py(), at).astype(np.float32).tobytes() for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), batch.column(1)], ["x", "y"])

    # At most max_rows short rows, in an order of their own so that reruns agree.
    found = sorted((r["y"], bytes(r["x"])) for r in rows.select("text", "y").mapInArrow(vote, "x binary, y int").toLocalIterator())
    annotation = np.array([y for y, _ in found], np.uint8)
    x = np.frombuffer(b"".join(raw for _, raw in found), np.float32).reshape(len(found), -1)
    del found
    posterior = label_model((x[:, : len(voters) + STYLES] > 0).astype(np.uint8), annotation)
    return ToxicityModel(voters, *_linear(x, posterior))


def score(docs: DataFrame, model: ToxicityModel, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Per row of ``docs``: ``row`` (the columns in ``keep``) and ``score`` (0 to 1)."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        at = {v: i for i, v in enumerate(model.voters)}
        for texts in batches:
            odds = np.array([model.features(t.as_py(), at) @ model.weights + model.bias for t in texts], float)
            yield pa.array(np.where(np.isinf(odds), odds > 0, 1 / (1 + np.exp(-np.clip(odds, -500, 500)))), pa.float64())

    return docs.select(packed_row(keep), F.arrow_udf(run, "double")("text").alias("score"))
