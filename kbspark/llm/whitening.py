"""Whitening of embeddings: projections on the leading directions of their covariance, scaled to unit variance.

Entries are read as whole numbers, so sums are exact and equal vectors are found by comparing them; the fit counts each
different vector once. Every task reduces its centred rows block by block to a triangle R by QR; triangles are stacked
and reduced again, ``FAN`` at a time, until one is left. It has the size of the dimensions. ``bidiagonal`` finds its
singular values and the directions in a task; the driver reads the few directions that are asked for, and the sums.
Vectors are shuffled once, to find equal ones; copies are merged in every task before that.
"""

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from kbspark.llm.bidiagonal import EPS, leading
from kbspark.llm.common import free_name, stored

# Triangles that a task stacks at a time, and the bytes that these may take.
FAN = 16
FAN_BYTES = 256 << 20

# Bytes of the numbers that a task centres at a time.
BLOCK_BYTES = 8 << 20

# Up to this size whole numbers and their differences are exact as doubles.
_EXACT = 1 << 52


class Whitening(NamedTuple):
    """Of the different vectors: how many, sums per dimension and largest size of an entry; eigenvalues of the
    covariance, largest first, their unit vectors as rows, and the sum of all eigenvalues."""

    n: int
    sums: list[int]
    largest: int
    values: np.ndarray
    directions: np.ndarray
    trace: float

    def centred(self, rows: np.ndarray) -> np.ndarray:
        """Rows of whole numbers less the mean; the whole part of the mean is taken off exactly."""
        if self.largest >= _EXACT:
            return rows.astype(float) - np.array([total / self.n for total in self.sums])
        whole = [total // self.n for total in self.sums]
        part = np.array([(total - self.n * floor) / self.n for total, floor in zip(self.sums, whole, strict=True)])
        return (rows - np.array(whole, dtype=np.int64)).astype(float) - part

    def usable(self) -> np.ndarray:
        """Whether an eigenvalue is more than what rounding makes of zero."""
        least = (4 * max(1, len(self.sums)) * EPS) ** 2
        return self.values > (least * self.values[0] if len(self.values) else 0.0)

    def projected(self, rows: np.ndarray) -> np.ndarray:
        """Rows on every direction, with unit variance; nan where there is no variance."""
        scale = np.where(self.usable(), 1 / np.sqrt(np.where(self.usable(), self.values, 1.0)), np.nan)
        return self.centred(rows) @ self.directions.T * scale

    def deviations(self, rows: np.ndarray) -> list[int | None]:
        """Sums of ``(n * x - sum) ** 2`` over the dimensions, exact; none where that is no long."""
        most = self.n * self.largest + max([0, *map(abs, self.sums)])
        if len(self.sums) * most ** 2 < 1 << 63:
            return ((self.n * rows - np.array(self.sums, dtype=np.int64)) ** 2).sum(axis=1).tolist()
        exact = (((self.n * rows.astype(object)) - np.array(self.sums, dtype=object)) ** 2).sum(axis=1)
        return [value if value < 1 << 63 else None for value in map(int, exact)]


def whole_numbers(vector: Column, scale: int, width: int) -> Column:
    """Entries times ``scale`` rounded down; null unless all entries are finite. Short vectors are filled with zeros."""
    entries = F.transform(vector, lambda c: c.cast("double"))
    bad = F.exists(entries, lambda c: F.isnull(c) | F.isnan(c) | (F.abs(c) == float("inf")))
    filled = F.concat(F.transform(entries, lambda c: F.floor(c * scale).cast("long")),
                      F.array_repeat(F.lit(0).cast("long"), F.greatest(F.lit(0), F.lit(width) - F.size(vector))))
    return F.when(vector.isNotNull() & ~bad, filled)


def _rows_of(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _moments(fit: DataFrame, width: int) -> tuple[int, list[int], int]:
    """Rows, sums per dimension and the largest size of an entry, exact."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low, n, largest = np.zeros(width, np.int64), np.zeros(width, np.int64), 0, 0
        for batch in batches:
            rows = _rows_of(batch.column(0), width)
            high += (rows >> 32).sum(axis=0)
            low += (rows & 0xFFFFFFFF).sum(axis=0)
            n += len(rows)
            if rows.size:
                largest = max(largest, int(rows.max()), -int(rows.min()))
        if n:
            yield pa.record_batch(
                [pa.array(range(-1, width)), pa.array([n, *high.tolist()]), pa.array([min(largest, (1 << 63) - 1), *low.tolist()])],
                names=["place", "high", "low"])

    parts = fit.mapInArrow(add, "place long, high long, low long")
    sums = {row["place"]: row for row in parts.groupBy("place").agg(
        F.sum(F.col("high").cast("decimal(38,0)")).alias("high"), F.sum(F.col("low").cast("decimal(38,0)")).alias("low"),
        F.max("low").alias("largest")).collect()}
    if not sums:
        return 0, [0] * width, 0
    return int(sums[-1]["high"]), [(int(sums[n]["high"]) << 32) + int(sums[n]["low"]) for n in range(width)], sums[-1]["largest"]


def _packed(triangle: np.ndarray, width: int) -> bytes:
    square = np.zeros((width, width))
    square[:len(triangle)] = triangle
    return square[np.triu_indices(width)].tobytes()


def _unpacked(data: bytes, width: int) -> np.ndarray:
    square = np.zeros((width, width))
    square[np.triu_indices(width)] = np.frombuffer(data)
    return square


def _stacked(parts: Iterator[np.ndarray], width: int) -> np.ndarray:
    """The triangle of all parts one above the other."""
    triangle = np.zeros((0, width))
    for part in parts:
        triangle = np.linalg.qr(np.vstack([triangle, part]), mode="r")
    return triangle


def _triangles(fit: DataFrame, model: Whitening, width: int) -> DataFrame:
    """``(node, triangle)``: one row per task that has rows."""
    at_a_time = max(2 * width, BLOCK_BYTES // (8 * width))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            rows = _rows_of(batch.column(0), width)
            for start in range(0, len(rows), at_a_time):
                yield model.centred(rows[start:start + at_a_time])

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        triangle = _stacked(blocks(batches), width)
        if len(triangle):
            yield pa.record_batch([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([_packed(triangle, width)])],
                                  names=["node", "triangle"])

    return stored(fit.mapInArrow(reduce, "node long, triangle binary"), "triangles")


def _solved(triangles: DataFrame, width: int, n: int, count: int) -> DataFrame:
    """``(component, value, direction, trace)`` of the covariance."""
    fan = max(2, min(FAN, FAN_BYTES // (8 * width * width)))

    def together(rows: pa.Table) -> np.ndarray:
        order = np.argsort(rows.column("node").to_numpy())
        data = rows.column("triangle").to_pylist()
        return _stacked((_unpacked(data[k], width) for k in order), width)

    def merge(key: tuple, rows: pa.Table) -> pa.Table:
        return pa.table({"node": pa.array([key[0].as_py()], pa.int64()),
                         "triangle": pa.array([_packed(together(rows), width)], pa.binary())})

    def solve(key: tuple, rows: pa.Table) -> pa.Table:
        square = together(rows)
        whole = np.zeros((width, width))
        whole[:len(square)] = square
        values, directions = leading(whole, count)
        return pa.table({"component": pa.array(range(1, len(values) + 1), pa.int32()), "value": pa.array(values / n),
                         "direction": pa.array(directions.tolist(), pa.list_(pa.float64())),
                         "trace": pa.array([float((whole ** 2).sum() / n)] * len(values))})

    nodes = (triangles.agg(F.max("node")).first()[0] or 0) + 1
    while nodes > fan:
        triangles = stored(triangles.groupBy(F.floor(F.col("node") / fan).alias("group")).applyInArrow(
            merge, "node long, triangle binary"), "triangles")
        nodes = -(-nodes // fan)
    return triangles.groupBy(F.lit(0).alias("group")).applyInArrow(
        solve, "component int, value double, direction array<double>, trace double")


def fitted(vectors: DataFrame, vector: str = "embedding", scale: int = 256, components: int = 4) -> tuple[Whitening, DataFrame]:
    """The whitening of ``vectors`` and its stored fit list ``(x)``, every different vector of whole numbers once.

    Vectors that are null or hold null, not-a-number or infinite entries do not count. A vector shorter than the
    longest is filled with zeros. There are as many components as asked for, or as there are dimensions; where equal
    eigenvalues leave a choice any orthogonal directions are taken. An empty table has none.
    """
    kept = vectors.select(vectors[vector].alias("v"))
    width = kept.agg(F.max(F.when(whole_numbers(F.col("v"), scale, 0).isNotNull(), F.size("v")))).first()[0] or 0
    fit = stored(kept.select(whole_numbers(F.col("v"), scale, width).alias("x")).filter("x IS NOT NULL").distinct(), "fit-list")
    if not width:
        return Whitening(fit.count(), [], 0, np.zeros(0), np.zeros((0, 0)), 0.0), fit
    model = Whitening(*_moments(fit, width), np.zeros(0), np.zeros((0, width)), 0.0)
    found = sorted(_solved(_triangles(fit, model, width), width, model.n, min(components, width)).collect())
    return model._replace(values=np.array([row["value"] for row in found]),
                          directions=np.array([row["direction"] for row in found]), trace=found[0]["trace"]), fit


_FOUND = StructType([StructField("deviation", LongType()), StructField("whitened", ArrayType(DoubleType()))])


def whitened(rows: DataFrame, model: Whitening, into: str, vector: str = "embedding", scale: int = 256) -> DataFrame:
    """``rows`` with a struct column ``into`` of ``deviation`` and ``whitened``, a number per component.

    ``into`` is null for vectors that do not count. Entries beyond the dimensions of the fit are left out. A component
    without variance has null. All columns and rows stay; ``into`` must be a new name.
    """
    width, known = len(model.sums), free_name(rows, "whole_numbers")

    @F.arrow_udf(_FOUND)
    def project(x: pa.Array) -> pa.Array:
        good = np.asarray(x.is_valid())
        numbers = _rows_of(x.drop_null(), width) if width else np.zeros((int(good.sum()), 0), np.int64)
        place = np.cumsum(good) - 1
        deviations, values = model.deviations(numbers), model.projected(numbers)
        out = [{"deviation": deviations[k], "whitened": [None if v != v else v for v in values[k].tolist()]} if ok else None
               for k, ok in zip(place, good, strict=True)]
        return pa.array(out, pa.struct([("deviation", pa.int64()), ("whitened", pa.list_(pa.float64()))]))

    x = F.slice(whole_numbers(rows[vector], scale, width), F.lit(1), F.lit(max(1, width)))
    return rows.withColumn(known, x).withColumn(into, project(F.col(known))).select(*rows.columns, into)


def identity_error(fit: DataFrame, model: Whitening) -> float:
    """How far the covariance of the whitened fit list is from the identity, in its worst entry."""
    usable, width = model.usable(), len(model.sums)
    size = int(usable.sum())
    if not size:
        return 0.0

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, products, n = np.zeros(size), np.zeros((size, size)), 0
        for batch in batches:
            rows = model.projected(_rows_of(batch.column(0), width))[:, usable]
            total, products, n = total + rows.sum(axis=0), products + rows.T @ rows, n + len(rows)
        if n:
            values = [*total.tolist(), *products.ravel().tolist()]
            yield pa.record_batch([pa.array(range(len(values))), pa.array(values)], names=["place", "value"])

    sums = fit.mapInArrow(add, "place long, value double").groupBy("place").agg(F.sum("value").alias("value")).collect()
    values = np.array([row["value"] for row in sorted(sums)]) / model.n
    # The rows were centred before; what rounding left of their mean is of no weight beside a variance of one.
    mean, products = values[:size], values[size:].reshape(size, size)
    return float(np.abs(products - np.outer(mean, mean) - np.eye(size)).max())
