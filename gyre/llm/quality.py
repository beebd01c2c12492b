"""A quality classifier: regularised quadratic discriminant analysis over document statistics.

Each text gives 16 transformed statistics (log lengths; shares of characters and
words, as log-odds or square roots).  Each class has a mean and a covariance,
shrunk towards the pooled one and towards its scaled identity; both come from sums
that every task makes for its own labelled rows, so all labelled rows count and no
sample is taken.  A document's score is the log-density difference of the classes,
by Mahalanobis distances through Cholesky factors that are made once, put through
a logistic curve whose two numbers are fitted to a histogram of the training rows'
differences.

Defined cases: a null text is an empty one; every row gets a score, with a null or
repeated doc_id too (held_out is then null or the same); labels that are null or
not 0 or 1, or whose doc_id has no document, teach nothing; without both classes
every score is 0.5; an empty table gives no rows; of other columns nothing is read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, fold, written
from .tokens import words

NAMES = ("log_words", "log_chars", "word_len", "long_words", "upper", "digits", "marks", "marked_words", "newlines", "distinct", "top_word", "twice", "lines_distinct", "stops", "entropy", "bytes_over")
THRESHOLD = 0.7
#: Very common short words of the four languages (fixed values).
STOPS = frozenset("the of and to a in is that it for la de que el en y los le les et des du un une der die und das ist ein von zu be by on with".split())
FEATURES = pa.schema([("x", pa.list_(pa.float64()))])


def share(part: float, whole: float) -> float:
    """Log-odds of a share with half a count added on either side."""
    return float(np.log((part + 0.5) / (max(whole - part, 0) + 0.5)))


def statistics(text: str | None) -> list[float]:
    text = text or ""
    raw = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
    ws = words(text)
    n, n_bytes = len(ws), int(raw.sum())
    counts: dict[str, int] = {}
    for w in ws:
        counts[w] = counts.get(w, 0) + 1
    repeats = np.fromiter(counts.values(), np.int64, len(counts))
    lines = text.split("\n")
    letters_up, letters_low = int(raw[65:91].sum()), int(raw[97:123].sum())
    marks = int(raw[33:48].sum() + raw[58:65].sum() + raw[91:97].sum() + raw[123:127].sum())
    plain = int(raw[44] + raw[46])  # commas and full stops
    visible = n_bytes - int(raw[[9, 10, 11, 12, 13, 32]].sum())
    p = raw[raw > 0] / max(n_bytes, 1)
    doubled = sum(a == b for a, b in zip(ws, ws[1:]))
    return [
        float(np.log1p(n)),
        float(np.log1p(n_bytes)),
        visible / (n + 1),
        share(sum(c for w, c in counts.items() if len(w) > 12), n),
        share(letters_up, letters_up + letters_low),
        share(int(raw[48:58].sum()), visible),
        share(marks - plain, visible),
        share(sum(c for w, c in counts.items() if not w[-1:].isalnum() and w[-1:] not in ",."), n),
        share(int(raw[10]), n_bytes),
        share(len(counts), n),
        share(int(repeats.max(initial=0)), n),
        share(doubled, n),
        share(len(set(lines)), len(lines)),
        share(sum(counts.get(w, 0) for w in STOPS), n),
        float(-(p * np.log(p)).sum()),
        share(int(raw[128:].sum()), n_bytes),
    ]


def featured(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of docs, and x, the statistics of each text."""
    schema = docs.select(*[F.col(f"`{c}`") for c in keep]).schema

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                x = pa.array([statistics(t) for t in part.column(0).to_pylist()], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*part.columns[1:], x], names=[*keep, "x"])

    return docs.select(F.col("text"), *[F.col(f"`{c}`") for c in keep]).mapInArrow(run, T.StructType([*schema.fields, T.StructField("x", T.ArrayType(T.DoubleType()))]))


@dataclass
class Model:
    """Per class: mean, Cholesky factor of the shrunk covariance, log determinant; the logistic curve's slope and offset."""

    mean: np.ndarray
    factor: np.ndarray
    logdet: np.ndarray
    slope: float = 1.0
    offset: float = 0.0
    known: bool = True

    def difference(self, x: np.ndarray) -> np.ndarray:
        """log density of class 1 less that of class 0."""
        parts = []
        for k in (0, 1):
            z = np.linalg.solve(self.factor[k], (x - self.mean[k]).T)
            parts.append(-0.5 * ((z**2).sum(axis=0) + self.logdet[k]))
        return parts[1] - parts[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.known or not len(x):
            return np.full(len(x), 0.5)
        return 1 / (1 + np.exp(-np.clip(self.slope * squashed(self.difference(x)) + self.offset, -60, 60)))


def squashed(d: np.ndarray) -> np.ndarray:
    """Differences grow with the square of a distance; their signed roots are nearer to log-odds."""
    return np.sign(d) * np.sqrt(np.abs(d))


def moments(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts, sums and sums of products by class, of (quality, x) rows; each task sends one row for each class."""
    d = len(NAMES)

    def run(batches):
        n, s, ss = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
        for b in batches:
            x, y = np.stack(b.x.to_numpy()) if len(b) else np.zeros((0, d)), b.quality.to_numpy()
            for k in (0, 1):
                own = x[y == k]
                n[k] += len(own)
                s[k] += own.sum(axis=0)
                ss[k] += own.T @ own
        yield pd.DataFrame([(k, j, v) for k in (0, 1) for j, v in enumerate([n[k], *s[k], *ss[k].ravel()])], columns=["k", "j", "v"])

    sums = rows.mapInPandas(run, "k int, j int, v double").groupBy("k", "j").agg(F.sum("v").alias("v")).collect()
    flat = np.zeros((2, 1 + d + d * d))
    for k, j, v in sums:
        flat[k, j] = v
    return flat[:, 0], flat[:, 1 : 1 + d], flat[:, 1 + d :].reshape(2, d, d)


def fit(n: np.ndarray, s: np.ndarray, ss: np.ndarray, to_pooled: float = 0.3, to_identity: float = 0.05) -> Model:
    d = s.shape[1]
    if (n < 2).any():
        return Model(np.zeros((2, d)), np.stack([np.eye(d)] * 2), np.zeros(2), known=False)
    mean = s / n[:, None]
    spread = ss - n[:, None, None] * mean[:, :, None] * mean[:, None, :]
    pooled = spread.sum(axis=0) / n.sum()
    # Small classes lean more on the pooled covariance.
    weight = [min(1.0, to_pooled + d / c) for c in n]
    cov = [(1 - w) * spread[k] / n[k] + w * pooled for k, w in zip((0, 1), weight)]
    scale = np.maximum(np.diag(pooled), 1e-6)
    cov = [(1 - to_identity) * c + to_identity * np.diag(scale) + 1e-9 * np.eye(d) for c in cov]
    factor = np.stack([np.linalg.cholesky(c) for c in cov])
    return Model(mean, factor, 2 * np.log(np.diagonal(factor, axis1=1, axis2=2)).sum(axis=1))


def calibrated(model: Model, rows: DataFrame, width: float = 0.25, reach: float = 60.0) -> Model:
    """Fits the logistic curve to counts of training rows by class and squashed difference (bins of ``width``)."""
    if not model.known:
        return model

    def run(batches):
        for b in batches:
            if len(b):
                z = np.clip(np.round(squashed(model.difference(np.stack(b.x.to_numpy()))) / width), -reach / width, reach / width)
                yield pd.DataFrame({"k": b.quality.to_numpy(), "z": z.astype(int)}).value_counts(["k", "z"]).rename("n").reset_index()

    bins = rows.mapInPandas(run, "k int, z int, n long").groupBy("k", "z").agg(F.sum("n").alias("n")).collect()
    y, z, n = (np.array(v, float) for v in zip(*bins))
    z, total = z * width, np.array([n[y == k].sum() for k in (0, 1)])
    t = np.where(y == 1, (total[1] + 1) / (total[1] + 2), 1 / (total[0] + 2))  # targets short of 0 and 1, as classes may be parted wholly
    a, b = 1.0, 0.0
    for _ in range(100):  # Newton's method with a little ridge
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -60, 60)))
        g = np.array([(n * (p - t) * z).sum() + 1e-3 * (a - 1), (n * (p - t)).sum() + 1e-3 * b])
        v = n * p * (1 - p) + 1e-9
        h = np.array([[(v * z * z).sum() + 1e-3, (v * z).sum()], [(v * z).sum(), v.sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    model.slope, model.offset = float(max(a, 1e-3)), float(b)
    return model


def trained(rows: DataFrame, labels: DataFrame, use: Column) -> Model:
    """rows: (doc_id, x).  Learns from labels' rows under the condition ``use`` on doc_id."""
    own = labels.where(F.col("quality").isin(0, 1) & use).select("doc_id", F.col("quality").cast("int").alias("quality"))
    train = written(rows.join(own, "doc_id").select("quality", "x"), "quality-train")
    return calibrated(fit(*moments(train)), train)


def scored(rows: DataFrame, model: Model) -> DataFrame:
    """rows with x replaced by score."""
    spark, keep = rows.sparkSession, [c for c in rows.columns if c != "x"]
    held = spark.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            x = batch.column(batch.num_columns - 1)
            flat = x.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(held.value.score(flat))], names=[*keep, "score"])

    schema = rows.select(*[F.col(f"`{c}`") for c in keep]).schema
    return rows.select(*[F.col(f"`{c}`") for c in keep], "x").mapInArrow(run, T.StructType([*schema.fields, T.StructField("score", T.DoubleType())]))


def held_out(doc_id: Column) -> Column:
    return fold(doc_id, 4) == 2


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = written(featured(documents(spark, sf_dir), ["doc_id"]), "quality-features")
    model = trained(rows, labels, ~held_out(F.col("doc_id")))
    return scored(rows, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that the classifier accepts, with their columns; it learns from the labels whose documents are there.

    Of rows that repeat a doc_id the one of the least statistics is learnt from.
    Without both classes (under two rows of either) nothing was learnt, so nothing is refused: docs stay as they are.
    """
    rows = written(featured(docs, ["doc_id"]), "quality-features")
    model = trained(rows.groupBy("doc_id").agg(F.min("x").alias("x")), labels, ~held_out(F.col("doc_id")))
    if not model.known:
        return docs
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                x = np.array([statistics(t) for t in part.column(at).to_pylist()]).reshape(-1, len(NAMES))
                yield part.filter(pa.array(held.value.score(x) >= threshold))

    return docs.mapInArrow(run, docs.schema)
