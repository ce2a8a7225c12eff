"""Reading level of each document (problem 10).

A rating-scale Rasch model links documents and words on one latent scale: the odds that a document
in which word w occurs is of level k + 1 rather than k are exp(b_w - t_k), with the word's
difficulty b_w and steps t_k shared by all words. Every document has a latent level of its own,
continuous on the scale of the labels; labelled documents anchor it. Estimation alternates until the
difficulties settle: word difficulties from the levels of the documents they occur in (partial sums
by Arrow batches, a shuffle by word, a Newton step per word, all distributed), then each document's
latent level from the difficulties of its words; a document between two levels counts in both.

Words are Latin words and pairs of neighbouring Han characters, hashed into 2^18 places, so the
model's size is fixed and it may be broadcast. Texts are turned into places once, in one Arrow pass
into a checkpoint; all rounds run over integers. A document's score is the interquartile mean over
its words of the expected level; cut points from the labelled documents carry it to the levels.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .support import checkpointed, is_blank, sampled

PLACES = 1 << 18
LEVELS = 5
#: The alternation ends when the words' difficulties, weighted by occurrence, move less than SETTLED on average, or after ROUNDS.
ROUNDS = 8
SETTLED = 0.02
#: How much a document counts by the source of its level: reliable rater, another rater, estimate.
SURE, OTHER, ESTIMATE = 1.0, 0.5, 0.2
#: Labelled documents taken for the cut points, by hash of their ids.
FITTED = 20_000
_WORD = re.compile(r"[a-z]+(?:-[a-z]+)*")
_HASHES: dict[str, int] = {}


def words(text: str) -> np.ndarray:
    """Distinct places of the words of a text."""
    c = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)
    han = (c >= 0x4E00) & (c <= 0x9FFF)
    at = np.flatnonzero(han[:-1] & han[1:]) if len(c) > 1 else np.zeros(0, dtype=np.int64)
    pairs = ((c[at].astype(np.uint64) * np.uint64(0x9E3779B1) + c[at + 1].astype(np.uint64) * np.uint64(0x85EBCA77)) >> np.uint64(7)) & np.uint64(PLACES - 1)
    if len(_HASHES) > 200_000:
        _HASHES.clear()
    latin = []
    for w in set(_WORD.findall(text.lower())):
        if w not in _HASHES:
            _HASHES[w] = zlib.crc32(w.encode()) & (PLACES - 1)
        latin.append(_HASHES[w])
    return np.unique(np.concatenate([pairs.astype(np.int64), np.array(latin, dtype=np.int64)]))


def is_table(text: Column) -> Column:
    """A bare table: most lines are rows of cells, or letters are few and no sentence ends."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    rows = F.filter(lines, lambda x: x.rlike(r"^(?:[^|\t]*[|\t]){2,}"))
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]+", ""))
    return (F.size(lines) > 0) & ((F.size(rows) * 2 > F.size(lines)) | ((letters * 2 < F.length(F.regexp_replace(text, r"\s+", ""))) & ~text.rlike(r"[。！？!?]|\.\s")))


def readable(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    return docs.filter(~is_blank(F.col(text))).filter(~is_table(F.col(text))).select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))


def _expected(b: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Probabilities of the levels for words of difficulty b: words x levels."""
    z = b[:, None] * np.arange(LEVELS) - np.concatenate([[0.0], np.cumsum(steps)])
    z -= z.max(1, keepdims=True)
    p = np.exp(z)
    return p / p.sum(1, keepdims=True)


def difficulties(counts: np.ndarray, steps: np.ndarray, rounds: int = 25) -> np.ndarray:
    """Maximum a posteriori difficulty of each word from its counts by level (normal prior around 0)."""
    level = np.arange(LEVELS)
    b = np.zeros(len(counts))
    total, seen = counts.sum(1), counts @ level
    for _ in range(rounds):
        p = _expected(b, steps)
        mean = p @ level
        spread = p @ level**2 - mean**2
        b += np.clip((seen - total * mean - 0.05 * b) / (total * spread + 0.05), -1, 1)
    return np.clip(b, -12, 12)


def steps_of(prior: np.ndarray) -> np.ndarray:
    """Steps at which a word of difficulty 0 has the levels' shares."""
    share = (prior + 1) / (prior + 1).sum()
    return np.log(share[:-1] / share[1:])


BINS = 256


class Model:
    """Difficulties of all places and what they say of a document's level."""

    def __init__(self, b: np.ndarray, known: np.ndarray, steps: np.ndarray):
        self.b, self.known = b, known
        p = _expected(b, steps)
        mean = p @ np.arange(1, LEVELS + 1)
        self.bin = np.round((mean - 1) / (LEVELS - 1) * (BINS - 1)).astype(np.int64)
        # a word that says little about the level weighs little
        self.weight = np.where(known, 1.0 / (0.1 + p @ np.arange(1, LEVELS + 1) ** 2 - mean**2), 0.0)

    def scores(self, places: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The score of each document, 0 for one without known words. places: those of all documents, one after the other."""
        n = len(sizes)
        row = np.repeat(np.arange(n), sizes)
        share = np.cumsum(np.bincount(row * BINS + self.bin[places], self.weight[places], n * BINS).reshape(n, BINS), axis=1)
        total = share[:, -1:]
        # the mean of the middle half: sentences of another level, which most texts have some of, don't move it
        inner = np.clip(share / np.maximum(total, 1e-12), 0.25, 0.75)
        levels = 1 + np.arange(BINS) * (LEVELS - 1) / (BINS - 1)
        return np.where(total[:, 0] > 0, np.diff(inner, axis=1, prepend=0.25) @ levels * 2, 0.0)


def latent(scores: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Continuous levels from 1 to 5: a cut point is half-way between its levels."""
    x = cuts + 1e-6 * np.arange(LEVELS - 1)
    edge = max(float(np.median(np.diff(x))) / 2, 1e-3)
    return np.interp(scores, [x[0] - edge, *x, x[-1] + edge], [1.0, *(np.arange(1, LEVELS) + 0.5), float(LEVELS)])


STEP = 0xFFFF


def packed(places: np.ndarray) -> bytes:
    """Sorted places as 16-bit gaps, compressed; a gap of STEP or more is written as STEPs and a rest."""
    gaps = np.diff(places, prepend=0)
    if len(gaps) and gaps.max() >= STEP:
        whole, rest = np.divmod(gaps, STEP)
        out = np.full(len(gaps) + int(whole.sum()), STEP, dtype=np.uint16)
        out[np.cumsum(whole + 1) - 1] = rest
        gaps = out
    return zstandard.compress(gaps.astype(np.uint16).tobytes(), 1)


def unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(places of all documents one after the other, their numbers) of a column of packed places."""
    parts = [np.frombuffer(zstandard.decompress(x), dtype=np.uint16) for x in column.to_pylist()]
    gaps = np.concatenate([*parts, np.zeros(0, dtype=np.uint16)]).astype(np.int64)
    row = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    total = np.cumsum(gaps)
    first = np.searchsorted(row, np.arange(len(parts)))
    base = np.concatenate([[0], total])[first]
    real = gaps != STEP
    return (total - base[row])[real], np.bincount(row[real], minlength=len(parts))


def tokenised(docs: DataFrame) -> DataFrame:
    """(doc_id, places, level, weight): docs (doc_id, text, level, weight), texts as the packed places of their words; checkpointed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            places = pa.array([packed(words(t)) for t in b.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), places, b.column("level"), b.column("weight")], ["doc_id", "places", "level", "weight"])

    return checkpointed(docs.select("doc_id", "text", "level", "weight").mapInArrow(run, "doc_id long, places binary, level int, weight double"))


def _word_counts(docs: DataFrame, cuts: np.ndarray | None, model) -> DataFrame:
    """(place, n1..n5): weight of the documents of each level that a word occurs in; without a model only those with a label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(PLACES * LEVELS)
        for b in batches:
            places, sizes = unpacked(b.column("places"))
            level = b.column("level").to_numpy(zero_copy_only=False).astype(float)
            weight = np.where(np.isnan(level), ESTIMATE, np.nan_to_num(b.column("weight").to_numpy(zero_copy_only=False).astype(float)))
            if model is None:
                weight[np.isnan(level)], level = 0.0, np.nan_to_num(level, nan=1.0)
            else:
                scores = model.value.scores(places, sizes)
                weight[np.isnan(level) & (scores == 0)] = 0.0
                level = np.where(np.isnan(level), latent(scores, cuts), level)
            low = np.minimum(np.floor(level), LEVELS - 1).astype(np.int64)
            above = np.repeat(weight * (level - low), sizes)
            at = places.astype(np.int64) * LEVELS + np.repeat(low, sizes) - 1
            counts += np.bincount(at, np.repeat(weight, sizes) - above, len(counts))
            counts += np.bincount(at + 1, above, len(counts))
        table = counts.reshape(PLACES, LEVELS)
        at = np.flatnonzero(table.sum(1))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), *(pa.array(table[at, k]) for k in range(LEVELS))], ["place", *fields])

    fields = [f"n{k + 1}" for k in range(LEVELS)]
    rows = docs.select("places", "level", "weight").mapInArrow(run, "place long, " + ", ".join(f"{n} double" for n in fields))
    return rows.groupBy("place").agg(*(F.sum(n).alias(n) for n in fields))


def _fit_words(counts: DataFrame, steps: np.ndarray) -> tuple[Model, np.ndarray]:
    """Difficulties of all words, at most 2^18 numbers, gathered into a model; and how often each occurs."""
    fields = [f"n{k + 1}" for k in range(LEVELS)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n = b[fields].to_numpy()
            yield pd.DataFrame({"place": b["place"], "b": difficulties(n, steps), "n": n.sum(1)})

    rows = counts.mapInPandas(run, "place long, b double, n double").toPandas()
    b, often = np.zeros(PLACES), np.zeros(PLACES)
    at = rows["place"].to_numpy(dtype=np.int64)
    b[at], often[at] = rows["b"], rows["n"]
    return Model(b, often > 0, steps), often


def cut_points(scores: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The four scores that part the labelled documents' levels with the fewest errors."""
    cuts, low = [], -np.inf
    for k in range(1, LEVELS):
        order = np.argsort(scores, kind="stable")
        s, above = scores[order], (levels[order] > k).astype(float)
        # errors with the cut before position i: those above it that are lower, those below that are higher
        errors = np.concatenate([[0.0], np.cumsum(above)]) + np.concatenate([np.cumsum((1 - above)[::-1])[::-1], [0.0]])
        best = np.flatnonzero(errors == errors.min())
        i = int(best[len(best) // 2])
        cut = s[0] - 1e-6 if i == 0 else s[-1] + 1e-6 if i == len(s) else (s[i - 1] + s[i]) / 2
        low = max(low, float(cut))
        cuts.append(low)
    return np.array(cuts)


def levels(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", rater: str = "r1") -> DataFrame:
    """(doc_id, score, level) of all documents with running text; level 1 (plain) to 5 (most demanding).

    labels: (doc_id, reading_level, rater). The reliable rater's level is a document's, the lowest
    if there are two; where only others gave one it counts as OTHER in the words' difficulties and
    not for the cut points. Null, empty and blank texts and bare tables have no level. Without
    labels of the reliable rater all documents get level 3. Copies have the same level.
    """
    spark = docs.sparkSession
    mine = F.col("rater") == rater
    known = labels.filter("reading_level between 1 and 5").groupBy("doc_id").agg(F.min(F.when(mine, F.col("reading_level"))).alias("sure"), F.min(F.when(mine, None).otherwise(F.col("reading_level"))).alias("other"))
    known = known.select("doc_id", F.coalesce("sure", "other").cast("int").alias("level"), F.when(F.col("sure").isNull(), OTHER).otherwise(SURE).alias("weight"))
    texts = tokenised(readable(docs, id_col, text).join(known, "doc_id", "left"))
    labelled = texts.filter(F.col("weight") == SURE)
    prior = np.zeros(LEVELS)
    for r in labelled.groupBy("level").count().collect():
        prior[r["level"] - 1] = r["count"]
    if not prior.sum():
        return texts.select("doc_id", F.lit(0.0).alias("score"), F.lit(3).alias("level"))
    steps = steps_of(prior)
    sample = checkpointed(sampled(labelled, FITTED, "doc_id").select("places", "level"))

    def cut(model) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array(model.value.scores(*unpacked(b.column("places")))), b.column("level")], ["score", "level"])

        rows = sample.mapInArrow(run, "score double, level int").toPandas()
        return cut_points(rows["score"].to_numpy(), rows["level"].to_numpy())

    now, _ = _fit_words(_word_counts(texts.filter("level is not null"), None, None), steps)
    model = spark.sparkContext.broadcast(now)
    cuts = cut(model)
    for _ in range(ROUNDS):
        before = now
        now, often = _fit_words(_word_counts(texts, cuts, model), steps)
        model = spark.sparkContext.broadcast(now)
        cuts = cut(model)
        both = before.known & now.known
        if not both.any() or np.average(np.abs(now.b - before.b)[both], weights=often[both]) < SETTLED:
            break

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = model.value.scores(*unpacked(b.column("places")))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(scores), pa.array(np.searchsorted(cuts, scores).astype(np.int32) + 1)], ["doc_id", "score", "level"])

    return texts.select("doc_id", "places").mapInArrow(run, "doc_id long, score double, level int")


def demanding(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id) of the documents of level 4 or 5."""
    return levels(docs, labels).filter("level >= 4").select("doc_id")
