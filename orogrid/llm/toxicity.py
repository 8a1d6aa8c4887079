"""Toxicity by maximum-scoring segments of token log-odds.

Training counts, for every word and every prefix of it (4, 6, 7 and 8 bytes), the labelled documents that hold it and the
toxic ones among them, in a hashed table of fixed size. A token's toxic rate takes its shorter prefix's rate as
Dirichlet prior, so that unseen words borrow from their stems; its score is the log-odds against the base rate less
a constant drift. In a text a linear scan finds all maximal-scoring segments. Under the extreme-value law the
chance of a segment of score S in m words is 1 - exp(-K m exp(-lambda S)); lambda solves sum p(s) exp(lambda s) = 1
over the scores of clean training texts, and K is their maximum-likelihood value. The significant segments of a text
add up to its evidence, which a logistic curve fitted on training documents (each scored without its own
counts) turns into a probability.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, lean, saved
from .words import _INVERSE, _RANDOM, U64, Words, _BASE, mix, powers, text_slices

TABLE_BITS = 21
PREFIXES = (4, 6, 7, 8)
PRIOR = 2.0
DRIFT = 1.0
BINS = 512
#: Labelled documents that the model is fitted on at most.
TRAIN_ROWS = 100_000


def token_features(words: Words, bits: int = TABLE_BITS) -> np.ndarray:
    """(n_words, levels) cells of every word's prefixes and of the word itself."""
    out = np.empty((len(words.hash), len(PREFIXES) + 1), np.int64)
    if not len(words.hash):
        return out
    total = np.cumsum(_RANDOM[words.lower] * powers(int(_BASE), len(words.lower)))
    before = np.where(words.start > 0, total[words.start - 1], U64(0))
    shift = powers(int(_INVERSE), len(words.lower))[words.start]
    for level, k in enumerate(PREFIXES):
        end = np.minimum(words.end, words.start + k)
        out[:, level] = (mix((total[end - 1] - before) * shift + U64(level + 1)) >> U64(64 - bits)).astype(np.int64)
    out[:, -1] = (mix(words.hash + U64(99)) >> U64(64 - bits)).astype(np.int64)
    return out


def token_scores(features: np.ndarray, toxic: np.ndarray, seen: np.ndarray, base: float, minus: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Log-odds of every token; ``minus`` (toxic, seen) by token is taken off the counts (a document's own)."""
    rate = np.full(len(features), base)
    for level in range(features.shape[1]):
        a, n = toxic[features[:, level]].astype(float), seen[features[:, level]].astype(float)
        if minus is not None:
            a, n = np.maximum(a - minus[0], 0), np.maximum(n - minus[1], 0)
        rate = (a + PRIOR * rate) / (n + PRIOR)
    return np.log(rate / (1 - rate)) - np.log(base / (1 - base)) - DRIFT


def maximal_segments(score: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, score) of one sequence, in linear time.

    Positive runs are kept as candidates with the cumulative score before and after them; a new candidate joins back
    to the last one that starts lower, as long as that ends lower too.
    """
    positive = score > 0
    edge = np.flatnonzero(np.diff(np.concatenate(([0], positive.view(np.int8), [0]))))
    total = np.concatenate(([0.0], np.cumsum(score)))
    stack: list[list] = []  # [start, end, before, after, candidate below that starts lower]
    for i in range(0, len(edge), 2):
        start, end = int(edge[i]), int(edge[i + 1])
        before, after = float(total[start]), float(total[end])
        while True:
            below = len(stack) - 1
            while below >= 0 and stack[below][2] >= before:
                below = stack[below][4]
            if below < 0 or stack[below][3] >= after:
                stack.append([start, end, before, after, below])
                break
            start, before = stack[below][0], stack[below][2]
            del stack[below:]
    return [(s, e, y - x) for s, e, x, y, _ in stack]


@dataclass
class Model:
    """Counts by cell, the extreme-value constants and the logistic curve; its size is fixed by ``TABLE_BITS``."""

    toxic: np.ndarray
    seen: np.ndarray
    base: float
    rate: float = 1.0  # lambda
    k: float = 0.1
    slope: float = 1.0
    shift: float = 0.0

    def evidence(self, score: np.ndarray, level: float = 0.05) -> tuple[float, list[tuple[int, int, float, float]]]:
        """(evidence, significant segments with their p-values): sums of normalised scores less their expectation."""
        found, total = [], 0.0
        m = max(1, len(score))
        for start, end, s in maximal_segments(score):
            p = -np.expm1(-self.k * m * np.exp(-self.rate * s))
            if p <= level:
                found.append((start, end, s, float(p)))
                total += self.rate * s - np.log(self.k * m)
        if not found and len(score):
            best = max((s for _, _, s in maximal_segments(score)), default=0.0)
            total = self.rate * best - np.log(self.k * m) if best > 0 else -np.log(1 + self.k * m)
        return total, found

    def probability(self, evidence: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * np.log1p(np.exp(min(evidence, 500.0))) + self.shift, -30, 30))))


def _documents(batch, column: int):
    """(row, words of the text, first word, end word) of every text of a batch."""
    for lo, hi, data, offsets in text_slices(batch.column(column)):
        words = Words(data, offsets)
        features = token_features(words)
        for i in range(hi - lo):
            yield lo + i, features[words.first[i] : words.first[i + 1]]


def count_table(labelled: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    """(toxic, seen, base rate) over (text, toxic) rows; partitions add up their own cells before they are summed."""
    cells = 1 << TABLE_BITS

    @lean
    def count(batches):
        seen, toxic, n = np.zeros(cells, np.int64), np.zeros(cells, np.int64), np.zeros(2, np.int64)
        for batch in batches:
            label = batch.column(1).to_numpy(zero_copy_only=False)
            for row, features in _documents(batch, 0):
                own = np.unique(features)
                seen[own] += 1
                n[0] += 1
                if label[row] == 1:
                    toxic[own] += 1
                    n[1] += 1
        at = np.flatnonzero(seen)
        for part in np.array_split(at, max(1, len(at) >> 16)):
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(seen[part]), pa.array(toxic[part])], ["cell", "seen", "toxic"])
        yield pa.RecordBatch.from_arrays([pa.array([-1]), pa.array(n[:1]), pa.array(n[1:])], ["cell", "seen", "toxic"])

    sums = labelled.select("text", "toxic").mapInArrow(count, "cell long, seen long, toxic long").groupBy("cell").agg(F.sum("seen").alias("seen"), F.sum("toxic").alias("toxic"))
    got = sums.toArrow()  # all cells: at most one narrow row each, whatever the number of documents
    cell, s, t = (got.column(c).to_numpy() for c in ("cell", "seen", "toxic"))
    seen, toxic = np.zeros(cells, np.int32), np.zeros(cells, np.int32)
    docs = cell >= 0
    seen[cell[docs]], toxic[cell[docs]] = s[docs], t[docs]
    n, bad = int(s[~docs].sum()), int(t[~docs].sum())
    return toxic, seen, (bad + 0.5) / (n + 1)


def fit(labelled: DataFrame) -> Model:
    """The model of (text, toxic) rows; without toxic or without clean rows it scores every text alike."""
    labelled = saved(labelled.select("text", F.col("toxic").cast("int").alias("toxic")).where("toxic is not null"), "labelled")
    model = Model(*count_table(labelled))
    spark = labelled.sparkSession
    shared = spark.sparkContext.broadcast(model)

    @lean
    def gauge(batches):
        scores, rows = np.zeros(BINS * 2, np.int64), []
        m = shared.value
        for batch in batches:
            label = batch.column(1).to_numpy(zero_copy_only=False)
            for row, features in _documents(batch, 0):
                s = token_scores(features, m.toxic, m.seen, m.base, (float(label[row] == 1), 1.0))
                if label[row] != 1:
                    scores += np.bincount(np.clip(np.round(s * 32).astype(np.int64) + BINS, 0, 2 * BINS - 1), minlength=2 * BINS)
        at = np.flatnonzero(scores)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(scores[at])], ["bin", "n"])

    hist = {r[0]: r[1] for r in labelled.mapInArrow(gauge, "bin long, n long").groupBy("bin").agg(F.sum("n")).collect()}
    if not hist:
        return model
    s = (np.array(sorted(hist)) - BINS) / 32
    p = np.array([hist[b] for b in sorted(hist)], float)
    p /= p.sum()
    lo, hi = 1e-3, 8.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if (p * np.exp(mid * s)).sum() < 1 else (lo, mid)
    model.rate = lo
    shared2 = spark.sparkContext.broadcast(model)

    @lean
    def tops(batches):
        m = shared2.value
        total, n = 0.0, 0
        for batch in batches:
            label = batch.column(1).to_numpy(zero_copy_only=False)
            for row, features in _documents(batch, 0):
                if label[row] != 1 and len(features):
                    best = max((x for _, _, x in maximal_segments(token_scores(features, m.toxic, m.seen, m.base, (0.0, 1.0)))), default=0.0)
                    total += len(features) * np.exp(-m.rate * best)
                    n += 1
        yield pa.RecordBatch.from_arrays([pa.array([total]), pa.array([n])], ["total", "n"])

    got = labelled.mapInArrow(tops, "total double, n long").agg(F.sum("total"), F.sum("n")).head()
    model.k = got[1] / got[0] if got[0] else 0.1
    shared3 = spark.sparkContext.broadcast(model)

    @lean
    def curve(batches):
        m = shared3.value
        bins = np.zeros((BINS, 2), np.int64)
        for batch in batches:
            label = batch.column(1).to_numpy(zero_copy_only=False)
            for row, features in _documents(batch, 0):
                y = int(label[row] == 1)
                x = m.evidence(token_scores(features, m.toxic, m.seen, m.base, (float(y), 1.0)))[0]
                bins[min(BINS - 1, int(np.log1p(np.exp(min(x, 500.0))) * 8)), y] += 1
        at = np.flatnonzero(bins)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(bins.ravel()[at])], ["bin", "n"])

    bins = np.zeros(BINS * 2)
    for r in labelled.mapInArrow(curve, "bin long, n long").groupBy("bin").agg(F.sum("n")).collect():
        bins[r[0]] = r[1]
    bins = bins.reshape(BINS, 2)
    x, (clean, bad) = (np.arange(BINS) + 0.5) / 8, bins.T
    w = np.array([-1.0, 0.1])

    def loss(w):  # the logistic likelihood with a weak prior
        z = np.clip(w[0] + w[1] * x, -30, 30)
        return (clean * np.logaddexp(0, z) + bad * np.logaddexp(0, -z)).sum() + 5e-4 * (w @ w)

    for _ in range(50):  # Newton steps, halved until they help
        q = 1 / (1 + np.exp(-np.clip(w[0] + w[1] * x, -30, 30)))
        v = (clean + bad) * q * (1 - q)
        g = np.array([(bad - (clean + bad) * q).sum() - 1e-3 * w[0], ((bad - (clean + bad) * q) * x).sum() - 1e-3 * w[1]])
        h = np.array([[v.sum() + 1e-3, (v * x).sum()], [(v * x).sum(), (v * x * x).sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        while loss(w + step) > loss(w) and np.abs(step).max() > 1e-9:
            step = step / 2
        w = w + step
    model.shift, model.slope = float(w[0]), float(max(w[1], 0.0))
    return model


def scored(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score, n_words and the significant segments (word positions, score, p-value) of every row.

    A null or empty text has no segments and the score of no evidence; rows may repeat; null ids stay null.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    segment = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("p_value", pa.float64())]))

    @lean
    def score(batches):
        m = shared.value
        for batch in batches:
            probability, n, segments = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64), []
            for row, features in _documents(batch, 1):
                x, found = m.evidence(token_scores(features, m.toxic, m.seen, m.base))
                probability[row], n[row] = m.probability(x), len(features)
                segments.append([{"start": a, "end": b, "score": s, "p_value": p} for a, b, s, p in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(probability), pa.array(n), pa.array(segments, segment)], ["doc_id", "score", "n_words", "segments"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(score, "doc_id long, score double, n_words long, segments array<struct<start:int,end:int,score:double,p_value:double>>")


def without_toxic(docs: DataFrame, model: Model, limit: float = 0.7, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below ``limit``, all columns and repeated rows kept.

    Null and empty texts have the score of no evidence, ids are not read, an empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    column = docs.columns.index(text)

    @lean
    def keep(batches):
        m = shared.value
        for batch in batches:
            fine = [m.probability(m.evidence(token_scores(features, m.toxic, m.seen, m.base))[0]) < limit for _, features in _documents(batch, column)]
            yield batch.filter(pa.array(fine, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def held_out(doc_id) -> F.Column:
    """Whether a row is kept from training: crc32 of its doc_id as text is 1 modulo 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, bound: int = TRAIN_ROWS) -> DataFrame:
    """(text, toxic) of the labelled documents that training may see; a doc_id labelled twice counts as toxic if once.

    Beyond about ``bound`` labelled documents a hash of the doc_id picks that many, so the side that the join
    broadcasts has a fixed size and no text is shuffled.
    """
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(~held_out(F.col("doc_id"))).where("toxic is not null and doc_id is not null")
    labels = saved(labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "labels")
    n = labels.count()
    if n > bound:
        labels = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.lit(int((1 << 30) * bound / n)))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(labels), "doc_id").select("text", "toxic")
