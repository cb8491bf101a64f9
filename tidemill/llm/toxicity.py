"""Toxicity by maximum-scoring segments.

Tokens are the words of decontaminate.words_of and their beginnings of 5 to 8
bytes (marked by a * at the end). A token's log-odds between the distinct words
of toxic and of clean documents has an informative Dirichlet prior in proportion
to the token's share of all. Tokens count with the lower end of their log-odds
(LOWER standard errors below it) where that is at least MIN_ODDS; a word scores
the most that it or a beginning of it counts, all other words -GAP. A
linear scan (Ruzzo and Tompa) finds all maximal segments; a segment is a toxic
passage when its expected number of chance occurrences is at most MAX_E. That
number is K n exp(-lambda S), the extreme-value law of such scores, with lambda
from the background of clean documents (sum of p exp(lambda s) = 1) and K from
the clean calibration documents. A logistic curve over the evidence, fitted to
calibration documents that gave no counts, makes the score from 0 to 1.

Labels are learned from at most MAX_LABELLED rows, those of the smallest hash of
their id; texts that share one of two min-hashes over their long words count
once, so that copies don't make a word of theirs look telling. Nothing else is sampled: every whole text is
scanned where it lies.

Defined results: null and empty texts have no passage and the score of no
evidence; rows of labels that are null or without a document are left out; with
no usable labels of one of the classes every score is the share of toxic rows
(0.0 without any); of several labels of one document the smaller counts; repeated
rows get one result each. The model holds at most MAX_TOKENS words and beginnings,
those of the highest log-odds; a text has no bound.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .decontaminate import original_spans, words_of

MAX_LABELLED, MIN_DOCS, MIN_ODDS, LOWER, MAX_TOKENS, PRIOR, GAP, MAX_E = 12_000, 5, 1.0, 1.64, 50_000, 10_000.0, 0.1, 0.05
PRIOR_SHARE = 0.02  # of all words, where that is less than PRIOR
STEMS = (5, 6, 7, 8)


def tokens_of(word: bytes) -> list[bytes]:
    return [word, *(word[:k] + b"*" for k in STEMS if len(word) > k)]


def segments(scores: list[tuple[int, float]], gap: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end exclusive, score), in linear time. scores: the places with a positive score; every other place scores -gap.

    Each segment holds the place, in the list, of the nearest earlier one with a lower
    total before it, so that the search for it doesn't go through those in between.
    """
    found: list[tuple[int, int, float, float, int]] = []  # start, end, total before, total after, link
    total, last = 0.0, 0
    for at, s in scores:
        total -= gap * (at - last)
        start, end, before, after = at, at + 1, total, total + s
        total, last = after, at + 1
        j = len(found) - 1
        while True:
            while j >= 0 and found[j][2] >= before:
                j = found[j][4]
            if j < 0 or found[j][3] >= after:
                found.append((start, end, before, after, j))
                break
            start, _, before, _, link = found[j]
            del found[j:]
            j = link
    return [(a, b, after - before) for a, b, before, after, _ in found]


class _Scores(dict):
    """Scores of words, 0 for those that score -GAP; kept as they come up."""

    def __init__(self, weights: dict[bytes, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: bytes) -> float:
        self[word] = s = max(self.weights.get(x, 0.0) for x in tokens_of(word))
        return s


@dataclass
class Model:
    weights: dict[bytes, float] = field(default_factory=dict)
    lam: float = 1.0
    log_k: float = 0.0
    bias: float = 0.0
    slopes: tuple[float, float] = (0.0, 0.0)
    gap: float = GAP
    max_e: float = MAX_E
    _of: _Scores | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_of": None}

    def passages(self, words: list[bytes]) -> list[tuple[int, int, float, float]]:
        """Every segment: (first word, end, score, log of its expected number by chance)."""
        if not self.weights:
            return []
        if self._of is None or len(self._of) > 400_000:
            self._of = _Scores(self.weights)
        hits = [(i, s) for i, s in enumerate(map(self._of.__getitem__, words)) if s]
        base = self.log_k + math.log(max(1, len(words)))
        return [(a, b, s, base - self.lam * s) for a, b, s in segments(hits, self.gap)] if hits else []

    def evidence(self, words: list[bytes], found: list[tuple[int, int, float, float]]) -> tuple[float, float]:
        """-log E of the best segment (nothing below 0 counts), and the log of all significant segments' total."""
        best = max((-e for *_, e in found), default=0.0)
        return max(0.0, min(best, 100.0)), math.log1p(sum(self.lam * s for _, _, s, e in found if e <= math.log(self.max_e)))

    def score(self, evidence: tuple[float, float]) -> float:
        z = self.bias + sum(a * b for a, b in zip(self.slopes, evidence))
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Weights and, last, the bias, by Newton's method with step halving."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    loss = lambda v: np.logaddexp(0, -(2 * y - 1) * (x @ v)).sum() + 0.5 * (penalty * v * v).sum()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        g = x.T @ (p - y) + penalty * w
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        d, t, before = np.linalg.solve(h, g), 1.0, loss(w)
        while loss(w - t * d) > before and t > 1e-6:
            t /= 2
        w = w - t * d
        if np.abs(t * d).max() < 1e-9:
            break
    return w


def sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, id_col: str, text_col: str, most: int) -> DataFrame:
    """doc_id, text, label, part: the labelled training rows of the smallest hashes; part 0 to 3 splits them. At most `most` of label rows are broadcast."""
    rows = labels.select(F.col("doc_id").alias("doc_id"), F.col(label).cast("int").alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & (common.fold("doc_id", folds) != 0))
    rows = rows.groupBy("doc_id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return common.texts(docs, id_col, text_col).join(F.broadcast(rows), "doc_id").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(4)))


def _apart(rows: DataFrame) -> DataFrame:
    """The labelled rows without near copies of one another: one row for each value of either sketch."""

    def make():
        def one(i, text, label, part):
            long = {w for w in words_of(text) if len(w) > 5} or {(text or "").encode("utf-8", "surrogatepass")}
            return i, text, label, part, min(zlib.crc32(w) for w in long), min(zlib.crc32(w, 1) for w in long)

        return one

    kind = rows.schema["doc_id"].dataType.simpleString()
    rows = common.map_rows(rows.select("doc_id", "text", "label", "part"), make, f"doc_id {kind}, text string, label int, part long, a long, b long")
    first = lambda k: F.row_number().over(Window.partitionBy(k).orderBy("doc_id"))
    for k in ("a", "b"):
        rows = rows.withColumn("n", first(k)).where("n = 1")
    return rows.select("doc_id", "text", "label", "part")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, most: int = MAX_LABELLED) -> Model:
    spark = docs.sparkSession
    rows, place = common.keep(_apart(sample(docs, labels, "toxic", folds, id_col, text_col, most)), "labelled")
    sizes = {(r.label, r.fit): r.n for r in rows.groupBy("label", (F.col("part") > 0).alias("fit")).agg(F.count("*").alias("n")).collect()}
    n1, n0 = sizes.get((1, True), 0), sizes.get((0, True), 0)
    share = sum(v for (k, _), v in sizes.items() if k) / max(1, sum(sizes.values()))
    if not n1 or not n0:
        common.drop_folder(spark, place)
        return Model(bias=math.log(share / (1 - share)) if 0 < share < 1 else (40.0 if share else -800.0))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[bytes, int], int] = {}
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                distinct = set(words_of(text))
                counts[b"", label] = counts.get((b"", label), 0) + len(distinct)  # the total, as no word is empty
                for word in distinct:
                    for w in tokens_of(word):
                        counts[w, label] = counts.get((w, label), 0) + 1
            if len(counts) > 200_000:
                yield _tallied(counts)
                counts = {}
        yield _tallied(counts)

    t, tally_place = common.keep(common.map_batches(rows.where("part > 0").select("text", "label"), tally, "word binary, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c")).where(F.col("t") + F.col("c") >= MIN_DOCS), "tally")
    all_words = t.where(F.length("word") == 0).first()
    w1, w0 = (float(all_words.t), float(all_words.c)) if all_words else (1.0, 1.0)
    prior = min(PRIOR, PRIOR_SHARE * (w1 + w0))
    t = t.where(F.length("word") > 0).withColumn("a", (F.col("t") + F.col("c")) / (w1 + w0) * prior)
    odds = lambda x, n: F.log((F.col(x) + F.col("a")) / (F.lit(n + prior) - F.col(x) - F.col("a")))
    t = t.withColumn("d", odds("t", w1) - odds("c", w0) - LOWER * F.sqrt(1 / (F.col("t") + F.col("a")) + 1 / (F.col("c") + F.col("a"))))
    kept = t.where(F.col("d") >= MIN_ODDS).orderBy(F.desc("d"), "word").limit(MAX_TOKENS).select("word", "d", "a", "c").collect()
    common.drop_folder(spark, tally_place)
    model = Model({bytes(r.word): float(r.d) for r in kept})
    held = rows.where("part = 0").select("text", "label")
    # background of clean documents: how many segments there are, and the best of each document
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [words_of(t) for t in batch.column(0).to_pylist()]
            found = [[s for _, _, s, _ in model.passages(w)] for w in words]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(list(map(len, words)), pa.int64()), pa.array(list(map(len, found)), pa.int64()), pa.array([max(f, default=0.0) for f in found], pa.float64())], names=["label", "n", "found", "best"])

    clean = common.map_batches(held.where("label = 0"), scan, "label int, n long, found long, best double").collect()
    total = sum(r.n for r in clean) + 1.0
    weights = np.array([r.d for r in kept] or [1.0])
    p = np.array([(r.c + r.a) for r in kept] or [1.0])
    p = p / p.sum() * min(0.5, (sum(r.found for r in clean) + 1.0) / total)
    model.lam = _lambda(weights, p)
    # K by moments: E has mean -log(K n) + Euler's constant over clean documents with a segment
    at = [math.log(max(1, r.n)) - model.lam * r.best for r in clean if r.found]
    model.log_k = -(float(np.mean(at)) + 0.5772) if at else 0.0
    # evidence as it is when scoring, from whole texts
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [words_of(t) for t in batch.column(0).to_pylist()]
            got = [model.evidence(w, model.passages(w)) for w in words]
            yield pa.RecordBatch.from_arrays([batch.column(1), *(pa.array([g[k] for g in got], pa.float64()) for k in (0, 1))], names=["label", "best", "all"])

    seen = common.map_batches(held, weigh, "label int, best double, all double").collect()
    common.drop_folder(spark, place)
    if len({r.label for r in seen}) == 2:
        w = logistic(np.array([(r.best, r["all"]) for r in seen]), np.array([float(r.label) for r in seen]), ridge=0.1)
        model.slopes, model.bias = (max(0.0, float(w[0])), max(0.0, float(w[1]))), float(w[2])
    else:
        model.slopes, model.bias = (1.0, 1.0), -6.0
    return model


def _tallied(counts: dict[tuple[bytes, int], int]) -> pa.RecordBatch:
    rows = list(counts.items())
    return pa.RecordBatch.from_pydict({"word": pa.array([w for (w, _), _ in rows], pa.binary()), "toxic": pa.array([n * k for (_, k), n in rows], pa.int64()), "clean": pa.array([n * (1 - k) for (_, k), n in rows], pa.int64())})


def _lambda(weights: np.ndarray, p: np.ndarray) -> float:
    """The positive root of sum p exp(lambda s) = 1, with -GAP at all other words; 1 where the mean isn't negative."""
    f = lambda x: (p * np.exp(np.minimum(x * weights, 700))).sum() + (1 - p.sum()) * math.exp(-x * GAP) - 1
    if (p * weights).sum() - (1 - p.sum()) * GAP >= 0:
        return 1.0 / max(1e-9, float(weights.max()))
    lo, hi = 1e-9, 1e-3
    while f(hi) < 0 and hi < 1e3:
        lo, hi = hi, hi * 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return hi


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, score, passages array<struct<start,end,score,log_e>> with offsets in code points of the text."""
    kind = docs.schema[id_col].dataType.simpleString()

    def make():
        def one(i, text):
            words = words_of(text)
            found = model.passages(words)
            sure = [x for x in found if x[3] <= math.log(model.max_e)]
            spans = original_spans(text, [(a, b) for a, b, _, _ in sure]) if sure else []
            return i, model.score(model.evidence(words, found)), [{"start": a, "end": b, "score": s, "log_e": e} for (a, b), (_, _, s, e) in zip(spans, sure)]

        return one

    return common.map_rows(common.texts(docs, id_col, text_col), make, f"doc_id {kind}, score double, passages array<struct<start:int,end:int,score:double,log_e:double>>")


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """docs, with all its columns, without documents that score the threshold or more."""
    at, kinds = docs.columns.index(text_col), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for text in batch.column(at).to_pylist():
                words = words_of(text)
                keep.append(model.score(model.evidence(words, model.passages(words))) < threshold)
            yield batch.filter(pa.array(keep, pa.bool_()))

    common.bounded_batches(docs.sparkSession)
    return docs.mapInArrow(run, kinds)
