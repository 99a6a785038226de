"""Whitening of embeddings by an exact integer scatter matrix.

Entries become whole numbers x. A shift is subtracted, and sums and products of the rest are added up without rounding:
each number is split into signed digits of 20 bits, so that a matrix product of the digits of up to 2^14 rows is exact
in doubles; the products are added as Python integers of any length, sent as digits of 40 bits, and added over tasks by
Spark. The driver gets one number for each pair of dimensions, however many rows there are, forms n·XᵀX - SSᵀ exactly,
and only then divides and decomposes by eigh.

The fit list is each different vector once: a distinct that combines before its shuffle, so that a vector which a third
of the rows have costs a row for each task. At most PARTIALS tasks add up, each in one matrix.

Defined cases: a null vector, or one with a null or a number that is not finite, is left out; shorter vectors are filled
with zeros up to the longest; x beyond a long's range is the nearest long; equal rows give a result each, and a null id
stays null; components without variance, to double precision, have a null whitened value and do not count in
identity_error; a deviation of more than 38 digits is null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import small_batches, written

SCALE = 64
SHIFT = 1_000_000
COMPONENTS = 16
LONGEST = (1 << 63) - 1
#: Tasks that add up products; also the most partial covariances of whitened vectors that the driver gets.
PARTIALS = 1024
DIGIT = 20
BATCH = 1 << 14
SENT_DIGIT = 40
DECIMAL_LIMIT = 10**38


@dataclass
class Whitening:
    """mean is total / n + SHIFT in each dimension; columns of vectors are unit eigenvectors by falling value."""

    n: int
    total: list[int]
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray

    def scaled(self) -> np.ndarray:
        """vectors over the roots of their values; not a number where there is no variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.values > 0, self.vectors / np.sqrt(self.values), np.nan)


def whole_numbers(vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Stored rows (vec_id, y): the entries as whole numbers less SHIFT, for the vectors that can be used."""
    c = F.col(embedding)
    finite = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    most = F.lit(LONGEST - SHIFT)
    y = F.transform(c, lambda v: F.least(F.floor(F.lit(float(SCALE)) * v.cast("double")), most))
    rows = written(vectors.where(c.isNotNull() & finite).select(F.col(vec_id).alias("vec_id"), y.alias("y")), "vectors")
    least, longest = rows.agg(F.min(F.size("y")), F.max(F.size("y"))).first()
    if least != longest:
        zeros = F.array_repeat(F.lit(0).cast("long"), F.lit(longest) - F.size("y"))
        rows = rows.withColumn("y", F.concat("y", zeros))
    return rows


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    lists = batch.column("y")
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _digits(y: np.ndarray) -> list[np.ndarray]:
    """Doubles whose sum, each times 2^DIGIT to the power of its place, is y."""
    out, half = [], 1 << DIGIT - 1
    while y.any() or not out:
        low = ((y + half) & ((1 << DIGIT) - 1)) - half
        out.append(low.astype(np.float64))
        y = (y - low) >> DIGIT
    return out


def products(y: np.ndarray) -> np.ndarray:
    """yᵀy of an int64 matrix as Python integers, exact."""
    total = np.zeros((y.shape[1], y.shape[1]), dtype=object)
    for at in range(0, len(y), BATCH):
        digits = _digits(y[at : at + BATCH])
        for i, a in enumerate(digits):
            for j, b in enumerate(digits):
                total = total + ((a.T @ b).astype(np.int64).astype(object) << DIGIT * (i + j))
    return total


def _partial_products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, held, rows = None, [], 0
    for batch in batches:
        if batch.num_rows:
            y = _matrix(batch)
            held.append(np.hstack([np.ones((len(y), 1), dtype=np.int64), y]))
            rows += len(y)
        if rows >= BATCH:
            total, held, rows = products(np.vstack(held)) + (0 if total is None else total), [], 0
    if rows:
        total = products(np.vstack(held)) + (0 if total is None else total)
    if total is None:
        return
    out = []
    for i in range(len(total)):
        for j in range(i, len(total)):
            left, sign, k = abs(total[i, j]), -1 if total[i, j] < 0 else 1, 0
            while left or not k:
                out.append((i, j, k, sign * (left & ((1 << SENT_DIGIT) - 1))))
                left, k = left >> SENT_DIGIT, k + 1
    for at in range(0, len(out), 100_000):
        columns = zip(*out[at : at + 100_000], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["i", "j", "k", "v"])


def _few(df: DataFrame) -> DataFrame:
    return df.coalesce(PARTIALS)


def scatter(fit: DataFrame) -> list[list[int]]:
    """Exact sums of products over the rows of fit, as the upper half of a matrix: of ones in row 0 (n, then the sums),
    of dimension d in row d + 1. Empty without rows."""
    partial = _few(fit).mapInArrow(_partial_products, "i long, j long, k long, v long")
    # a number for each pair of dimensions and digit
    found = partial.groupBy("i", "j", "k").agg(F.sum("v").alias("v")).collect()
    size = max((r["j"] for r in found), default=-1) + 1
    out = [[0] * size for _ in range(size)]
    for r in found:
        out[r["i"]][r["j"]] += r["v"] << SENT_DIGIT * r["k"]
    return out


def decompose(sums: list[list[int]], components: int = COMPONENTS) -> Whitening:
    """The whitening of the sums that scatter() gives: n·YᵀY - SSᵀ as integers, then divided and decomposed."""
    n, total = sums[0][0], sums[0][1:]
    d = len(total)
    exact = np.empty((d, d), dtype=object)
    for i in range(d):
        for j in range(i, d):
            exact[i, j] = exact[j, i] = n * sums[i + 1][j + 1] - total[i] * total[j]
    square, trace = n * n, sum(exact[i, i] for i in range(d))
    cov = np.array([[exact[i, j] / square for j in range(d)] for i in range(d)], dtype=np.float64).reshape(d, d)
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    least = max(values[0], 0) * d * np.finfo(float).eps if len(values) else 0
    values = np.where(values > least, values, 0.0)
    return Whitening(n, total, values, vectors, values / (trace / square) if trace else np.zeros_like(values))


def _centred(y: np.ndarray, model: Whitening) -> np.ndarray:
    """n·y - total: int64 if their squares' sum surely is one, else Python integers."""
    most = model.n * max(abs(int(y.max())), abs(int(y.min()))) + max(map(abs, model.total)) if y.size else 0
    if most * most * max(1, y.shape[1]) <= LONGEST:
        return y * model.n - np.array(model.total, dtype=np.int64)
    return y.astype(object) * model.n - np.array(model.total, dtype=object)


def whitened(y: np.ndarray, model: Whitening) -> tuple[np.ndarray, np.ndarray]:
    """(the exact sums of squares of n·y - total, the whitened rows)."""
    centred = _centred(y, model)
    return (centred * centred).sum(axis=1), (centred / model.n).astype(np.float64) @ model.scaled()


def transform(rows: DataFrame, model: Whitening) -> DataFrame:
    """Rows (vec_id, deviation decimal, whitened array): every row of whole_numbers() through the whitening."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.decimal128(38, 0)
        for batch in batches:
            if not batch.num_rows:
                continue
            deviation, white = whitened(_matrix(batch), model)
            if deviation.dtype == object:
                sums = pa.array([Decimal(v) if v < DECIMAL_LIMIT else None for v in deviation], kind)
            else:
                sums = pa.array(deviation, pa.int64()).cast(kind)
            flat = pa.array(white.ravel(), mask=np.isnan(white.ravel()))
            ends = pa.array(np.arange(len(white) + 1, dtype=np.int32) * white.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), sums, pa.ListArray.from_arrays(ends, flat)], names=["vec_id", "deviation", "whitened"])

    id_type = rows.schema["vec_id"].dataType.simpleString()
    return rows.mapInArrow(each, f"vec_id {id_type}, deviation decimal(38,0), whitened array<double>")


def identity_error(fit: DataFrame, model: Whitening) -> float:
    """The largest entry of the whitened fit list's covariance minus the identity; 0 without a component of variance.

    Tasks give the count, mean and centred products of their rows, which are combined by the means' own scatter.
    """
    used = model.values > 0
    k = int(used.sum())

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, m2 = 0, np.zeros(k), np.zeros((k, k))
        for batch in batches:
            if batch.num_rows:
                white = whitened(_matrix(batch), model)[1][:, used]
                here = white.mean(axis=0)
                apart, both = here - mean, n + len(white)
                m2 += (white - here).T @ (white - here) + np.outer(apart, apart) * n * len(white) / both
                mean, n = mean + apart * len(white) / both, both
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([mean.tolist()]), pa.array([m2.ravel().tolist()])], names=["n", "mean", "m2"])

    if not k:
        return 0.0
    # at most PARTIALS rows of k + k * k numbers
    parts = _few(fit).mapInArrow(each, "n long, mean array<double>, m2 array<double>").collect()
    n = sum(p["n"] for p in parts)
    means = np.array([p["mean"] for p in parts])
    weights = np.array([p["n"] for p in parts], dtype=np.float64)
    apart = means - (weights @ means) / n
    cov = (sum(np.array(p["m2"]).reshape(k, k) for p in parts) + (apart * weights[:, None]).T @ apart) / n
    return float(np.abs(cov - np.eye(k)).max())


def whiten(vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", components: int = COMPONENTS) -> tuple[DataFrame, Whitening | None, float]:
    """(rows (vec_id, deviation, whitened) of every vector that can be used, the whitening, its identity error)."""
    rows = whole_numbers(vectors, vec_id=vec_id, embedding=embedding)
    fit = written(rows.select("y").distinct(), "fit")
    with small_batches(vectors.sparkSession):
        sums = scatter(fit)
        if not sums:
            empty = rows.select("vec_id", F.lit(None).cast("decimal(38,0)").alias("deviation"), F.array().cast("array<double>").alias("whitened"))
            return empty.limit(0), None, 0.0
        model = decompose(sums, components)
        error = identity_error(fit, model)
        return written(transform(rows, model), "whitened"), model, error


def op12_whitening(vectors: DataFrame) -> DataFrame:
    rows, model, error = whiten(vectors)
    explained = F.array(*[F.lit(float(v)) for v in model.explained]) if model and len(model.explained) else F.array().cast("array<double>")
    rows = rows.select("vec_id", "deviation", F.posexplode_outer("whitened").alias("at", "whitened")).where("at is not null")
    return rows.select(
        "vec_id",
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(model.n if model else 0).cast("long").alias("n"),
        F.col("deviation").try_cast("long").alias("deviation"),
        "whitened",
        F.get(explained, F.col("at")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
