"""A quality classifier from positive and unlabelled texts.

The model is a logistic one over byte statistics of whole texts. It minimises
the non-negative unbiased risk of positive-unlabelled learning,

    prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)),

with trusted positives (label 1), unlabelled text (any documents, whatever
their labels) and a class prior estimated from the share of label 1 among the
labels that may be learned from. Held-out rows (crc32 of the id as text,
modulo 5, is 0) take no part in any of it.

All positives and all unlabelled texts take part in the risk. A pilot model is
fitted on a bounded sample (``POSITIVES`` and ``UNLABELLED`` rows, those with the
smallest hashes of their ids). One pass over all rows then sums the losses of
the whole risk and their gradients at the pilot, and the sample's risk is
minimised again with its own ones there replaced by the whole ones (a
communication-efficient surrogate), so the sample only lends its curvature. Scoring reads all of every text.

Defined cases: null and empty texts are scored as empty ones; a text of any
length is read as a whole; repeated rows are scored each; rows without an id are
scored, but not learned from; without any positive label every score is 0.5; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, shingles

#: Rows of the sample that lends the curvature, at most; a text contributes HASHED + 256 + 10 numbers of two bytes.
POSITIVES, UNLABELLED = 6000, 12000
#: Ids of positives (8 bytes each) that are broadcast at most; beyond, it's a shuffled join.
BROADCAST_IDS = 2_000_000
#: Tasks that sum the gradients of the scanning tasks, before the driver sums theirs.
SUMMING = 64
#: Rows of features that a worker holds at once.
ROWS = 512
HASHED = 768
FEATURES = HASHED + 256 + 10
THRESHOLD = 0.3
STEPS, RATE, DECAY = 400, 0.03, 5e-5


def features(texts: Sequence[bytes]) -> np.ndarray:
    """One row per text: roots of the shares of bytes and of hashed byte pairs, and a few counts as shares."""
    out = np.zeros((len(texts), FEATURES), dtype=np.float32)
    hashes, begins = shingles.word_hashes(texts) if texts else (np.zeros(0, np.uint64), np.zeros(1, np.int64))
    for i, text in enumerate(texts):
        b = np.frombuffer(text, dtype=np.uint8)
        n = max(1, len(b))
        single = np.bincount(b, minlength=256)
        pairs = np.bincount((b[:-1].astype(np.int32) * 131 + b[1:] * 7) % HASHED, minlength=HASHED) if len(b) > 1 else np.zeros(HASHED)
        words = hashes[begins[i] : begins[i + 1]]
        w = max(1, len(words))
        upper, lower, digit = single[65:91].sum(), single[97:123].sum(), single[48:58].sum()
        high = single[128:].sum()
        out[i, :HASHED] = np.sqrt(pairs / n)
        out[i, HASHED : HASHED + 256] = np.sqrt(single / n)
        out[i, -10:] = (
            np.log1p(len(b)) / 10,
            (words[1:] == words[:-1]).sum() / w,
            len(np.unique(words)) / w,
            upper / max(1, upper + lower),
            digit / n,
            (n - upper - lower - digit - high - single[32] - single[10]) / n,
            np.log1p(n / w),
            single[10] / w,
            len(np.unique(words)) / np.sqrt(w) / 10,
            high / n,
        )
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = ((x - self.mean) / self.scale).astype(np.float64) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Sums:
    """Sums over positives and over unlabelled texts: losses as negatives, and gradients (bias last)."""

    n_p: float
    n_u: float
    loss_p: float
    loss_u: float
    p_plus: np.ndarray
    p_minus: np.ndarray
    u_minus: np.ndarray

    def means(self) -> Sums:
        return Sums(1.0, 1.0, self.loss_p / self.n_p, self.loss_u / self.n_u, self.p_plus / self.n_p, self.p_minus / self.n_p, self.u_minus / self.n_u)

    def gradient(self, prior: float) -> np.ndarray:
        """Of the non-negative risk: where the risk of the negatives is below 0, a step back from it."""
        one = self.means()
        minus = one.u_minus - prior * one.p_minus
        return prior * one.p_plus + minus if one.loss_u >= prior * one.loss_p else -minus

    def corrected(self, by: Sums, moved: np.ndarray) -> Sums:
        """These means with the differences ``by`` added, the losses' ones along the way ``moved`` since they were taken."""
        one = self.means()
        return Sums(1.0, 1.0, one.loss_p + by.loss_p + by.p_minus @ moved, one.loss_u + by.loss_u + by.u_minus @ moved, one.p_plus + by.p_plus, one.p_minus + by.p_minus, one.u_minus + by.u_minus)

    def packed(self) -> np.ndarray:
        return np.concatenate([[self.n_p, self.n_u, self.loss_p, self.loss_u], self.p_plus, self.p_minus, self.u_minus])

    @staticmethod
    def unpacked(v: np.ndarray) -> Sums:
        return Sums(*v[:4].tolist(), *np.split(v[4:], 3))


def sums(p: np.ndarray, u: np.ndarray, w: np.ndarray, b: float) -> Sums:
    """p, u: scaled rows. Logistic losses: as positive log(1 + e^-z), as negative log(1 + e^z)."""
    zp, zu = p @ w + b, u @ w + b
    up = lambda x, d: np.append((d.astype(np.float32) @ x).astype(np.float64), d.sum(dtype=np.float64))
    return Sums(len(p), len(u), np.logaddexp(0, zp).sum(dtype=np.float64), np.logaddexp(0, zu).sum(dtype=np.float64), up(p, -_sigmoid(-zp)), up(p, _sigmoid(zp)), up(u, _sigmoid(zu)))


def descend(p: np.ndarray, u: np.ndarray, prior: float, w: np.ndarray, b: float, steps: int, rate: float, by: Sums | None = None) -> tuple[np.ndarray, float]:
    """Full-batch Adam on the non-negative risk of scaled rows; ``by``: corrections of its means at the start."""
    m, v, w0, b0 = np.zeros(FEATURES + 1), np.zeros(FEATURES + 1), w, b
    for step in range(1, steps + 1):
        here = sums(p, u, w, b)
        grad = (here.corrected(by, np.append(w - w0, b - b0)) if by else here).gradient(prior)
        grad[:-1] += DECAY * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1].astype(np.float32), float(b - move[-1])
    return w, b


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, whole: Callable[[Model], Sums] | None = None) -> Model:
    """The model of these rows, which are scaled in place; ``whole`` gives the sums over all rows at a model."""
    mean, scale = unlabelled.mean(axis=0), unlabelled.std(axis=0) + 0.02
    p, u = positive, unlabelled
    for part in (p, u):
        part -= mean
        part /= scale
    w, b = descend(p, u, prior, np.zeros(FEATURES, dtype=np.float32), float(np.log(prior / (1 - prior))), STEPS, RATE)
    if whole is not None:
        every = whole(Model(mean, scale, w.astype(np.float64), b, prior))
        if every.n_p and every.n_u:
            one, own = every.means(), sums(p, u, w, b).means()
            by = Sums.unpacked(one.packed() - own.packed())
            w, b = descend(p, u, prior, w, b, STEPS // 2, RATE, by)
    return Model(mean, scale, w.astype(np.float64), b, prior)


def held_out(id_column: Column) -> Column:
    return F.coalesce(F.crc32(id_column.cast("long").cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model | None:
    """None without a positive label to learn from."""
    docs = common.id_and_text(docs, id_col, text_col).filter("doc_id is not null")
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).filter("doc_id is not null and y is not null").filter(~held_out(F.col("doc_id")))
    prior = known.agg(F.avg((F.col("y") == 1).cast("double"))).first()[0]
    if not prior:
        return None
    prior = min(0.99, max(0.01, prior))
    order = lambda salt: (F.xxhash64("doc_id", F.lit(salt)), F.col("doc_id"))
    positives = known.filter("y = 1").select("doc_id").distinct()
    learned = docs.filter(~held_out(F.col("doc_id")))
    positive = positives.orderBy(*order(1)).limit(POSITIVES).withColumn("positive", F.lit(True))
    unlabelled = learned.select("doc_id").orderBy(*order(2)).limit(UNLABELLED).withColumn("positive", F.lit(False))
    picked = positive.unionByName(unlabelled).groupBy("doc_id").agg(F.max("positive").alias("p"), F.min("positive").alias("not_u"))
    made = F.pandas_udf(lambda s: pd.Series(_each(s, lambda x: [row.tobytes() for row in x.astype(np.float16)]), dtype=object), "binary")
    sample = docs.join(F.broadcast(picked), "doc_id").select("doc_id", "p", "not_u", made("text").alias("x"))
    rows = sample.groupBy("doc_id", "p", "not_u").agg(F.min("x").alias("x")).orderBy("doc_id").collect()  # one row an id
    p, u = (np.empty((sum(ok(r) for r in rows), FEATURES), dtype=np.float32) for ok in (lambda r: r["p"], lambda r: not r["not_u"]))
    if not len(p) or not len(u):
        return None
    at_p = at_u = 0
    for r in rows:
        x = np.frombuffer(r["x"], dtype=np.float16)
        if r["p"]:
            p[at_p], at_p = x, at_p + 1
        if not r["not_u"]:
            u[at_u], at_u = x, at_u + 1
    del rows
    few = positives.count() <= BROADCAST_IDS
    flags = positives.withColumn("p", F.lit(True))
    return fit(p, u, prior, lambda model: whole_sums(learned.join(F.broadcast(flags) if few else flags, "doc_id", "left").select(F.col("p").isNotNull().alias("p"), "text"), model))


def whole_sums(rows: DataFrame, model: Model) -> Sums:
    """The sums over all rows (p: whether positive, text), by one row from each task, summed on executors again."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, w = np.zeros(4 + 3 * (FEATURES + 1)), model.weights.astype(np.float32)
        mean, scale = model.mean.astype(np.float32), model.scale.astype(np.float32)
        for batch in common.sliced(batches, 1):
            p, raw = batch.column(0).to_numpy(zero_copy_only=False), common.raw_texts(batch.column(1))
            for lo, hi in _parts(raw):
                x = (features(raw[lo:hi]) - mean) / scale
                total += sums(x[p[lo:hi]], x, w, model.bias).packed()
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["part", "v"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(4 + 3 * (FEATURES + 1))
        for batch in batches:
            for v in batch.column(1).to_pylist():
                total += np.frombuffer(v)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["part", "v"])

    schema = "part long, v binary"
    summed = rows.mapInArrow(scan, schema).repartition(SUMMING, F.pmod("part", F.lit(SUMMING))).sortWithinPartitions("part").mapInArrow(add, schema)
    return Sums.unpacked(sum((np.frombuffer(r["v"]) for r in summed.orderBy("part").collect()), np.zeros(4 + 3 * (FEATURES + 1))))


def _parts(raw: Sequence[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts whose features are held together: of bounded bytes and rows."""
    for lo, hi in shingles.buffers(raw):
        yield from ((at, min(at + ROWS, hi)) for at in range(lo, hi, ROWS))


def _each(texts: pd.Series, result: Callable[[np.ndarray], Iterable]) -> list:
    """The results for the features of each text, so that only results are held for all texts of a batch."""
    found: list = []
    for at in range(0, len(texts), ROWS):
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts.iloc[at : at + ROWS]]
        for lo, hi in _parts(raw):
            found.extend(result(features(raw[lo:hi])))
    return found


def score(text: Column, model: Model | None) -> Column:
    """The model's probability that a text has label 1."""
    if model is None:
        return F.lit(0.5)
    return F.pandas_udf(lambda s: pd.Series(_each(s, model.scores), dtype="float64"), "double")(text)


def score_documents(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", model: Model | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    model = model or train(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col)
    docs = common.id_and_text(docs, id_col, text_col)
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """The rows of docs, all columns, that the classifier doesn't reject."""
    model = train(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col)
    if model is None:
        return docs
    return docs.filter(score(F.coalesce(F.col(text_col), F.lit("")), model) >= THRESHOLD)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(common.spread(common.table(spark, sf_dir, "documents")), common.table(spark, sf_dir, "labels"))
