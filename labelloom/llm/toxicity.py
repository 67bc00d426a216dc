"""Toxic passages as maximum-scoring segments.

Words and their first letters get log-odds between toxic and clean texts under an
informative Dirichlet prior; those that are surely toxic score their log-odds, all others
a constant below zero. A linear scan finds all maximal segments of a text. With the
decay rate of clean scores, a segment's score turns into an extreme-value statistic, and a
logistic curve over these turns them into a probability.

Weights and curve are fitted on all labelled texts, one half for the weights and the other
for the curve. What the driver gets is bounded by the number of weights, or a few sums a block.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.llm.common import LETTERS, id_and_text, release, slices, stored

MAX_WEIGHTS = 100_000
PREFIXES = (4, 5)
# Prior counts of a word: this share of its counts in all texts, and a part of one besides.
PRIOR_SHARE = 0.01
PRIOR_LEAST = 0.5
MIN_Z = 4.0
MIN_COUNT = 8
DRIFT = -0.25
MAX_WORDS = 500_000
BLOCK_ROWS = 100_000
_LOWER = str.maketrans(*LETTERS)


def words_of(text: str) -> list[str]:
    """Runs without white space, A-Z lowered."""
    return text.translate(_LOWER).split() if not text.isascii() else text.lower().split()


def features(word: str) -> list[str]:
    bare = word.strip(".,;:!?()\"'")
    return [bare, *[f"{bare[:n]}*" for n in PREFIXES if len(bare) > n]]


def segments(places: list[int], scores: list[float], drift: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first place, last place, score), in linear time.

    ``places`` are the tokens of positive score; every token between two of them scores ``drift``.
    """
    found: list[list] = []  # first, last, total before, total after
    total, last = 0.0, -1
    for at, score in zip(places, scores, strict=True):
        total += drift * (at - last - 1)
        new = [at, at, total, total + score]
        total, last = total + score, at
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= new[2]:
                j -= 1
            if j < 0 or found[j][3] >= new[3]:
                found.append(new)
                break
            new = [found[j][0], new[1], found[j][2], new[3]]
            del found[j:]
    return [(a, b, right - left) for a, b, left, right in found]


@dataclass
class Model:
    weights: dict[str, float]
    rate: float = 1.0
    curve: tuple[float, ...] = (0.0, 0.0, 0.0)
    drift: float = DRIFT

    def weight(self, word: str) -> float:
        known = [self.weights[f] for f in features(word) if f in self.weights]
        return max(known, default=0.0)

    def statistics(self, words: list[str], known: dict[str, float]) -> tuple[float, float]:
        """Extreme-value statistic of the best segment, and the sum over all significant ones."""
        try:
            scores = [known[w] for w in words]
        except KeyError:
            if len(known) > MAX_WORDS:
                known.clear()
            known.update((w, self.weight(w)) for w in set(words).difference(known))
            scores = [known[w] for w in words]
        places = [i for i, s in enumerate(scores) if s]
        size = math.log1p(len(words))
        found = segments(places, [scores[i] for i in places], self.drift)
        beyond = [self.rate * s - size for _, _, s in found]
        return max(beyond, default=-size), sum(x for x in beyond if x > 0)

    def passages(self, text: str) -> list[tuple[int, int, float]]:
        """Segments whose statistic is above zero: first word, last word, score."""
        words = words_of(text)
        places = [(i, w) for i, w in enumerate(map(self.weight, words)) if w]
        found = segments([p[0] for p in places], [p[1] for p in places], self.drift)
        return [x for x in found if self.rate * x[2] > math.log1p(len(words))]

    def probability(self, best: float, total: float) -> float:
        a, b, c = self.curve
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * best + c * math.log1p(total)))))


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        counts = (Counter(), Counter())
        for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
            counts[bool(toxic)].update(set(f for w in set(words_of(text)) for f in features(w)))
        every = list(counts[0].keys() | counts[1].keys())
        yield pa.RecordBatch.from_pydict(
            {"feature": pa.array(every, pa.string()), "toxic": pa.array([counts[1][w] for w in every], pa.int64()),
             "clean": pa.array([counts[0][w] for w in every], pa.int64())}
        )


def log_odds(counts: DataFrame) -> DataFrame:
    """feature, odds and z under a Dirichlet prior in proportion to all counts."""
    sums = counts.groupBy("feature").agg(F.sum("toxic").alias("y"), F.sum("clean").alias("x"))
    total = sums.agg(F.sum("y").alias("n1"), F.sum("x").alias("n0")).first()
    n1, n0 = float(total["n1"] or 0), float(total["n0"] or 0)
    prior = (F.col("y") + F.col("x")) * F.lit(PRIOR_SHARE) + F.lit(PRIOR_LEAST)
    every = (n1 + n0) * PRIOR_SHARE + PRIOR_LEAST
    side = lambda y, n: F.log((y + prior) / (F.lit(n + every) - y))
    odds = side(F.col("y"), n1) - side(F.col("x"), n0)
    spread = F.sqrt(1 / (F.col("y") + prior) + 1 / (F.col("x") + prior))
    return sums.select("feature", "y", odds.alias("odds"), (odds / spread).alias("z"))


def decay_rate(scores: np.ndarray, times: np.ndarray, others: int, drift: float) -> float:
    """The positive solution of mean(exp(rate * score)) = 1 over the words of clean texts.

    ``scores`` are the positive ones, each found so many ``times``; the ``others`` score ``drift``.
    """
    n = times.sum() + others
    if not len(scores) or (scores * times).sum() + drift * others >= 0:
        return 1.0
    mean = lambda rate: ((np.exp(rate * scores) * times).sum() + others * math.exp(rate * drift)) / n
    low, high = 0.0, 1.0
    while mean(high) < 1 and high < 50:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if mean(mid) < 1 else (low, mid)
    return min(max(low, 0.2), 2.0)


def labelled_texts(docs: DataFrame, labels: DataFrame, half: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """text and toxic of each distinct labelled text of one half; a text is toxic if any of its rows is.

    Labels meet the texts by digests, so that a text is sent once; the text alone says which half it is in.
    """
    rows = id_and_text(docs, id_col, text_col).withColumn("half", F.pmod(F.xxhash64(F.xxhash64("text"), F.lit("half")), F.lit(2)))
    rows = rows.filter(F.col("half") == half).select("doc_id", "text", F.sha2(F.col("text"), 256).alias("digest"))
    known = labels.select(F.col(id_col).alias("doc_id"), "toxic").filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marks = rows.select("doc_id", "digest").join(known, "doc_id").groupBy("digest").agg(F.max("toxic").alias("toxic"))
    # copies become one row in each task before they are sent
    texts = rows.groupBy("digest").agg(F.first("text").alias("text"))
    return texts.join(marks, "digest").select("text", "toxic")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Model from all labelled documents; labels hold the id and ``toxic``. Null ids or labels are left out.

    Without texts of both labels every text gets the share of toxic ones. Labels of one id, or
    of equal texts, that differ count as toxic. Of the sure words the ``MAX_WEIGHTS`` surest get
    a weight, so that the model stays small. The decay rate is held between 0.2 and 2, beyond
    which few scores say nothing about it.
    """
    counts = labelled_texts(docs, labels, 0, id_col, text_col).mapInArrow(_word_counts, "feature string, toxic long, clean long")
    counts = stored(counts.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")), "toxicity-words")
    release(docs.sparkSession)
    sure = log_odds(counts).filter((F.col("z") >= MIN_Z) & (F.col("y") >= MIN_COUNT))
    best = sure.orderBy(F.desc("z"), "feature").limit(MAX_WEIGHTS).collect()
    model = Model({r["feature"]: float(r["odds"]) for r in best})
    seen = stored(labelled_texts(docs, labels, 1, id_col, text_col).mapInArrow(_statistics(model), STATISTICS), "toxicity-seen")
    release(docs.sparkSession)
    clean = F.col("toxic") == 0
    sums = seen.agg(
        F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("toxic"), F.countDistinct("toxic").alias("labels"),
        F.sum(F.when(clean, F.col("n_words"))).alias("words"),
    ).first()
    if sums["labels"] < 2:
        share = sums["toxic"] / sums["n"] if sums["n"] else 0.0
        share = min(max(share, 1e-3), 1 - 1e-3)
        model.curve = (math.log(share / (1 - share)), 0.0, 0.0)
        return model
    # a positive score is a word's weight: at most MAX_WEIGHTS distinct ones
    found = seen.filter(clean).select(F.explode("positive").alias("score")).groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    values = sorted((r["score"], r["n"]) for r in found.collect())
    scores, times = np.array([v for v, _ in values]), np.array([n for _, n in values], float)
    model.rate = decay_rate(scores, times, max(0, int(sums["words"] or 0) - int(times.sum())), model.drift)
    model.curve = logistic(stored(blocks(seen, model, 1 + sums["n"] // BLOCK_ROWS), "toxicity-blocks"))
    return model


STATISTICS = "toxic int, n_words long, places array<int>, positive array<double>"


def _statistics(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            places, positive, sizes = [], [], []
            for text in b.column("text").to_pylist():
                words = words_of(text)
                hits = [(i, w) for i, w in enumerate(map(model.weight, words)) if w]
                places.append([h[0] for h in hits])
                positive.append([h[1] for h in hits])
                sizes.append(len(words))
            yield pa.RecordBatch.from_arrays(
                [b.column("toxic").cast(pa.int32()), pa.array(sizes, pa.int64()), pa.array(places, pa.list_(pa.int32())),
                 pa.array(positive, pa.list_(pa.float64()))], ["toxic", "n_words", "places", "positive"],
            )

    return run


def _beyond(places: list[int], scores: list[float], n_words: int, model: Model) -> tuple[float, float]:
    size = math.log1p(n_words)
    beyond = [model.rate * s - size for _, _, s in segments(places, scores, model.drift)]
    return max(beyond, default=-size), sum(x for x in beyond if x > 0)


def blocks(seen: DataFrame, model: Model, n: int) -> DataFrame:
    """``n`` rows of best statistic, total, label and number of texts, in an order that the values alone fix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = [b.column(c).to_pylist() for c in ("places", "positive", "n_words")]
            both = np.array([_beyond(*x, model) for x in zip(*columns, strict=True)]).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(np.log1p(both[:, 1])), b.column("toxic")], ["best", "total", "toxic"])

    def pack(t: pa.Table) -> pa.Table:
        rows = np.stack([t.column(c).to_numpy().astype(float) for c in ("best", "total", "toxic", "n")], axis=1)
        rows = rows[np.lexsort(rows.T[:3])]
        return pa.table({"block": t.column("block").slice(0, 1), "rows": pa.array([rows.tobytes()], pa.binary())})

    cells = seen.mapInArrow(run, "best double, total double, toxic int").groupBy("best", "total", "toxic").agg(F.count(F.lit(1)).alias("n"))
    placed = cells.withColumn("block", F.pmod(F.xxhash64("best", "total", "toxic"), F.lit(n)))
    return placed.groupBy("block").applyInArrow(pack, "block long, rows binary")


def logistic(data: DataFrame, ridge: float = 1.0) -> tuple[float, ...]:
    """Intercept and slopes by Newton's method over the ``blocks``; a step is one pass that sends 12 sums a block."""
    w = np.zeros(3)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = []
            for rows in b.column("rows").to_pylist():
                best, total, y, n = np.frombuffer(rows).reshape(-1, 4).T
                x = np.column_stack([np.ones(len(y)), best, total])
                p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
                parts.append(np.vstack([x.T @ (n * (p - y)), (x * (n * p * (1 - p))[:, None]).T @ x]).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("block"), pa.array(parts, pa.binary())], ["block", "sums"])

    for _ in range(40):
        found = sorted((r["block"], r["sums"]) for r in data.mapInArrow(run, "block long, sums binary").collect())
        sums = sum(np.frombuffer(s).reshape(4, 3) for _, s in found)
        pull = np.array([1e-6, ridge, ridge])
        step = np.linalg.solve(sums[1:] + np.diag(pull), sums[0] + pull * w)
        w = w - step
        if np.abs(step).max() < 1e-12:
            break
    return tuple(float(v) for v in w)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score and predicted for every row; null texts are empty and get the score of no evidence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        for b in slices(batches):
            values = [
                model.probability(*model.statistics(words_of(text), known)) for text in b.column("text").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(values, pa.float64()), pa.array([int(v >= 0.5) for v in values], pa.int32())],
                ["doc_id", "score", "predicted"],
            )

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double, predicted int")


def fold(id_col: Column, n: int) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % n


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows that the model, fitted on the labelled ones, doesn't reject; columns of the input.

    Null texts are empty and get the score of no evidence, so they stay; rows that repeat an id
    are judged each by its own text; an empty table gives an empty one.
    """
    model = fit(docs, labels, id_col, text_col)
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        for b in slices(batches, text_col):
            keep = [
                model.probability(*model.statistics(words_of(text or ""), known)) < 0.5
                for text in b.column(text_col).to_pylist()
            ]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, schema)
