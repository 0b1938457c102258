"""Toxic passages by maximum-scoring segments.

Learning: from labelled training rows (at most SAMPLE, those with the least hashes) each word gives the features
"whole word" and "prefix of 4 to 8 letters", counted by documents in either class. A feature's share of all
such counts of a class is compared between the classes: it gets log-odds with an informative Dirichlet prior (in proportion to its
overall frequency), if the likelihood ratio of its counts is beyond what the best of all tested features reaches by chance
(2 ln of their number). So long documents, many labels and large vocabularies don't bring in words by chance. A word scores
as its longest such feature less DRIFT, any other word scores -DRIFT.

Search: all maximal scoring segments of the token scores are found in one linear scan (Ruzzo and Tompa's).
Calibration: in a text of n tokens, E = K n exp(-L S) segments of score S or better are expected by chance. The rate L of that
extreme-value law is the root of sum p(s) exp(L s) = 1 over the token scores s of non-toxic training texts, K the
density of their segments; toxic texts that are labelled 0 change both little. A text's evidence is the sum of ln(1 + 1/E) over its
segments, without a cut, and a logistic curve through the training rows makes that a score; in this curve a toxic row counts
as sqrt(non-toxic rows / toxic rows) rows, between equal rows and equal classes. L, K and the curve are fitted to scores of rows that the
features were not learned from (FOLDS parts, by the hash of the text, so copies share a part). Segments with E below MAX_E
are reported as passages.

Only texts are inputs of a score. Defined results: null and empty texts have no segment and the score of no
evidence; unlabelled rows and null doc_ids are never learned from; a doc_id with several labels is toxic if one says so; without
training rows of both classes every score is near the share of toxic rows, or near 0.0 without rows; repeated rows each get a score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

SAMPLE = 30_000  # labelled rows that the model is learned from, at most
FOLDS = 4
PREFIXES = (8, 7, 6, 5, 4)
PRIOR = 0.02  # the prior's weight, as a share of a feature's own count
MIN_ROWS = 5
DRIFT = 0.25
CAP = 6.0
MAX_E = 0.05
BIN = 0.25  # width of the token scores' histogram
_WORD = re.compile(r"[^\W_]+")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def features(word: str) -> list[str]:
    """Whole word first, then prefixes from long to short."""
    return [word + "$", *(word[:k] for k in PREFIXES if len(word) >= k)]


class _Features(dict):
    """Features of words, made when first asked for."""

    def __missing__(self, word: str) -> list[str]:
        made = self[word] = features(word)
        return made


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    rate: float = 1.0  # L
    density: float = 1.0  # K
    intercept: float = -30.0
    slope: float = 0.0

    def word(self, word: str) -> float:
        get = self.weights.get
        w = get(word + "$")
        if w is None:
            for k in PREFIXES:
                w = get(word[:k]) if len(word) >= k else None
                if w is not None:
                    break
        return (w or 0.0) - DRIFT


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments [start, end) with their scores, in order, in linear time."""
    found: list[list[float]] = []  # start, end, total before, total after
    total, before = np.cumsum(scores), 0.0
    for i in np.flatnonzero(scores > 0):
        before = float(total[i] - scores[i])
        new = [int(i), int(i) + 1, before, float(total[i])]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= new[2]:
                j -= 1
            if j < 0 or found[j][3] >= new[3]:
                found.append(new)
                break
            new = [found[j][0], new[1], found[j][2], new[3]]
            del found[j:]
    return [(a, b, r - q) for a, b, q, r in found]


def evidence(found: list[tuple[int, int, float, float]]) -> float:
    """Sum of ln(1 + 1/E) over segments."""
    return float(sum(np.log1p(1 / max(e, 1e-300)) for *_, e in found))


class _Scores(dict):
    """Word scores of a model, made when first asked for."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> float:
        score = self[word] = self.model.word(word)
        return score


class Scorer:
    """Words and segments of texts under one model. Words that begin like no feature are never looked up; scores of the others are kept in a bounded dict."""

    def __init__(self, model: Model, limit: int = 500_000):
        self.model, self.limit, self.known = model, limit, _Scores(model)
        self.heads = {f.removesuffix("$")[:4] for f in model.weights}

    def tokens(self, text: str | None) -> list[float]:
        if len(self.known) > self.limit:
            self.known.clear()
        known, heads = self.known, self.heads
        return [known[w] if w[:4] in heads else -DRIFT for w in _WORD.findall(text.lower())] if text else []

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int, float]]]:
        scores = self.tokens(text)
        if not scores or max(scores) <= 0:
            return len(scores), []
        return len(scores), segments(np.array(scores))

    def expected(self, n: int, found: list[tuple[int, int, float]]) -> list[tuple[int, int, float, float]]:
        """Segments with their E values."""
        m = self.model
        return [(a, b, s, float(m.density * max(n, 1) * np.exp(-m.rate * s))) for a, b, s in found]

    def score(self, found: list[tuple[int, int, float, float]]) -> float:
        """Between 0 and 1, from the evidence of all segments."""
        x = self.model.intercept + self.model.slope * np.log1p(evidence(found))
        return float(1 / (1 + np.exp(-np.clip(x, -30, 30))))


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """text, toxic and fold of at most `sample` labelled rows that are not held out; these are few enough to broadcast."""
    rows = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    rows = rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    fold = F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int").alias("fold")
    return docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id").select("text", (F.col("toxic") > 0).cast("int").alias("toxic"), fold)


def log_odds(y1: np.ndarray, y0: np.ndarray, all1: float, all0: float) -> np.ndarray:
    """Log-odds of features that were seen y1 times among all1 and y0 times among all0, with a Dirichlet prior."""
    a1 = a0 = 0.5 + PRIOR * (y1 + y0)
    rest = PRIOR * (all1 + all0)
    return np.clip(np.log((y1 + a1) / (all1 + rest - y1 - a1)) - np.log((y0 + a0) / (all0 + rest - y0 - a0)), -CAP, CAP)


def _ratio(y1: Column, y0: Column, all1: float, all0: float) -> Column:
    """Likelihood ratio (twice its logarithm) of counts y1 and y0 against equal shares in both classes."""
    n, share = y1 + y0, all1 / (all1 + all0)
    part = lambda y, p: F.when(y > 0, y * F.ln(y / (n * p))).otherwise(0.0)
    return 2 * (part(y1, share) + part(y0, 1 - share))


def count_features(rows: DataFrame) -> DataFrame:
    """feature ('' for documents), and of each fold the documents of either class that hold it: t0.., c0.."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = [Counter() for _ in range(2 * FOLDS)]  # by fold and class
        known = _Features()

        def flush():
            for i, cell in enumerate(cells):
                if cell:
                    yield pa.RecordBatch.from_arrays([pa.array(cell.keys(), pa.string()), pa.array([i] * len(cell), pa.int32()), pa.array(cell.values(), pa.int64())], names=["feature", "cell", "n"])
                cell.clear()

        for batch in batches:
            for text, toxic, fold in zip(*(batch.column(c).to_pylist() for c in ("text", "toxic", "fold")), strict=True):
                words = set(_WORD.findall((text or "").lower()))
                cells[2 * fold + toxic].update({""}.union(*map(known.__getitem__, words)))
                if len(known) > 200_000:
                    known.clear()
                if sum(map(len, cells)) > 400_000:
                    yield from flush()
        yield from flush()

    cell = lambda fold, toxic: F.sum(F.when(F.col("cell") == 2 * fold + toxic, F.col("n")).otherwise(0))
    cols = [cell(k, toxic).alias(f"{name}{k}") for name, toxic in (("t", 1), ("c", 0)) for k in range(FOLDS)]
    return rows.mapInArrow(count, "feature string, cell int, n long").groupBy("feature").agg(*cols)


def chance_rate(scores: np.ndarray, counts: np.ndarray) -> float:
    """The positive root L of sum p(s) exp(L s) = 1; small if scores rise on average."""
    p = counts / counts.sum()
    low, high = 0.02, 50 / max(scores.max(), 1e-9)
    if p @ scores >= 0 or p @ np.exp(low * scores) >= 1:
        return low
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if p @ np.exp(mid * scores) < 1 else (low, mid)
    return low


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    rows = written(training_rows(docs, labels, sample), "toxicity-rows")
    counted = written(count_features(rows), "toxicity-features")
    names = [f"{c}{k}" for c in "tc" for k in range(FOLDS)]
    size = counted.where("feature = ''").select(*names).first()
    model = Model()
    toxic, clean = (0, 0) if size is None else (sum(size[:FOLDS]), sum(size[FOLDS:]))
    if not toxic or not clean:
        model.intercept = 30.0 if toxic else -30.0
        return model
    frequent = F.col("feature") != "", F.expr(" + ".join(names)) >= MIN_ROWS
    total = counted.where(frequent[0]).agg(*(F.sum(c).alias(c) for c in names), F.count(F.when(frequent[1], 1)).alias("tested")).first()
    # the model of all rows, and one without each fold
    keep = [list(range(FOLDS)), *([k for k in range(FOLDS) if k != j] for j in range(FOLDS))]
    all1 = [max(sum(total[f"t{k}"] or 0 for k in use), 0.5) for use in keep]
    all0 = [max(sum(total[f"c{k}"] or 0 for k in use), 0.5) for use in keep]
    least = 2 * np.log(max(total.tested, 2))
    part = lambda c, use: F.expr(" + ".join(f"{c}{k}" for k in use))
    ratios = [F.when(part("t", use) + part("c", use) >= MIN_ROWS, _ratio(part("t", use), part("c", use), all1[i], all0[i])).otherwise(0.0).alias(f"r{i}") for i, use in enumerate(keep)]
    # features of a bounded sample that no chance explains
    told = counted.where(frequent[0] & frequent[1]).select("feature", *names, *ratios).where(F.greatest(*(F.col(f"r{i}") for i in range(len(keep)))) >= float(least)).toArrow()
    feature, number = told.column("feature").to_pylist(), {c: told.column(c).to_numpy().astype(float) for c in names}
    models = []
    for i, use in enumerate(keep):
        odds = log_odds(sum(number[f"t{k}"] for k in use), sum(number[f"c{k}"] for k in use), all1[i], all0[i])
        models.append(Model({feature[j]: float(odds[j]) for j in np.flatnonzero(told.column(f"r{i}").to_numpy() >= least)}))
    model.weights = models[0].weights
    edges = np.arange(-CAP - 2 * DRIFT, CAP + 2 * BIN, BIN)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorers = [Scorer(m) for m in models[1:]]
        for batch in batches:
            n, best, bins = [], [], np.zeros(len(edges) - 1)
            for text, y, fold in zip(*(batch.column(c).to_pylist() for c in ("text", "toxic", "fold")), strict=True):
                scores = np.array(scorers[fold].tokens(text))
                n.append(len(scores))
                best.append([s for *_, s in segments(scores)] if len(scores) and scores.max() > 0 else [])
                if not y:
                    bins += np.histogram(scores, edges)[0]
            toxic = batch.column("toxic").cast(pa.int64()).to_pylist()
            # the last row holds the histogram of the non-toxic rows' token scores
            yield pa.RecordBatch.from_arrays([pa.array([*n, 0], pa.int64()), pa.array([*best, bins.tolist()], pa.list_(pa.float64())), pa.array([*toxic, -1], pa.int64())], names=["n", "best", "toxic"])

    # numbers of at most `sample` rows
    table = rows.mapInArrow(scan, "n long, best array<double>, toxic long").toArrow()
    n, best, y = table.column("n").to_numpy(), table.column("best").to_pylist(), table.column("toxic").to_numpy()
    bins = sum((np.array(b) for b, t in zip(best, y, strict=True) if t < 0), np.zeros(len(edges) - 1))
    bins[np.searchsorted(edges, CAP / 2) - 1] += 1  # one unseen word, so that the rate stays finite
    bins[np.searchsorted(edges, -DRIFT, "right") - 1] += 1
    model.rate = chance_rate((edges[:-1] + edges[1:]) / 2 - BIN / 2, bins)
    chance = np.array([s for b, t in zip(best, y, strict=True) if t == 0 for s in b])
    low = float(np.median(chance)) if len(chance) else 0.0
    model.density = float((np.sum(chance >= low) + 1.0) / max(int(n[y == 0].sum()), 1) * np.exp(model.rate * low))
    scorer = Scorer(model)
    x = np.array([np.log1p(evidence(scorer.expected(int(k), [(0, 0, s) for s in b]))) for k, b, t in zip(n, best, y, strict=True) if t >= 0])
    model.intercept, model.slope = _logistic(x, y[y >= 0].astype(float))
    return model


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Intercept and slope (not below 0) by Newton's method with a weak ridge; rows of class 1 weigh sqrt(rows of class 0 / rows of class 1)."""
    a = np.stack([np.ones_like(x), x], 1)
    weight = np.where(y > 0, np.sqrt((y == 0).sum() / max((y > 0).sum(), 1)), 1.0)
    w = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (weight * (y - p)) - 1e-2 * w
        h = (a * (weight * p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(2)
        step = np.clip(np.linalg.solve(h, g), -1, 1)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    if w[1] < 0:
        share = (weight * y).sum() / weight.sum()
        return float(np.log(share / (1 - share))), 0.0
    return float(w[0]), float(w[1])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and passages (code-point offsets in the text, score, E) of each row; other columns are dropped."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    passage = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("e", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                scores, passages = [], []
                for text in part.column("text").to_pylist():
                    found = scorer.expected(*scorer.scan(text))
                    scores.append(scorer.score(found))
                    good = [x for x in found if x[3] < MAX_E]
                    places = [m.span() for m in _WORD.finditer(text.lower())] if good else []
                    passages.append([{"start": places[a][0], "end": places[b - 1][1], "score": s, "e": e} for a, b, s, e in good])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scores, pa.float64()), pa.array(passages, pa.list_(passage))], names=["doc_id", "score", "passages"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, passages array<struct<start: int, end: int, score: double, e: double>>")


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, whose score is below the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(shared.value)
        for texts in batches:
            yield texts.map(lambda t: scorer.score(scorer.expected(*scorer.scan(t))) < threshold).astype(bool)

    return docs.where(clean(F.coalesce("text", F.lit(""))))


def predictions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels)).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    )
