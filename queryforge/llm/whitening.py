"""Whitening of embeddings along the leading components of their covariance, by spectrum slicing.

1. Vectors become integers, so the distinct ones, their sums and their second moments about an integer
   centre are exact whatever the order in which tasks add them up; the covariance is rounded once.
2. The symmetric matrix (its side is the vectors' length, not their number) is factored on the driver as
   L D Lt of V - shift * I.  The signs in D count the eigenvalues above the shift; bisection on these counts
   isolates one leading eigenvalue after the other, Rayleigh quotient iteration converges to it within its
   bracket, and two more counts certify its number.
3. Tasks project whole Arrow batches on the few components; one pass over the distinct vectors measures the
   covariance of the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

_PIVOT = (1 + 17 ** 0.5) / 8
_LONG = 2 ** 63
_SPLIT = 10 ** 18


def inertia(matrix: np.ndarray, shift: float) -> tuple[int, int]:
    """(eigenvalues above, below ``shift``) by L D Lt with Bunch-Kaufman pivots of one or two rows; the rest are at the shift."""
    a = matrix - shift * np.eye(len(matrix))
    above = below = 0
    while len(a):
        col = np.abs(a[1:, 0])
        big = col.max(initial=0.0)
        k, two = 0, False
        if abs(a[0, 0]) < _PIVOT * big:
            r = 1 + int(col.argmax())
            other = np.abs(np.delete(a[:, r], r)).max()
            if abs(a[0, 0]) * other < _PIVOT * big * big:
                k, two = r, abs(a[r, r]) < _PIVOT * other
        if two:
            order = [0, k, *(i for i in range(len(a)) if i not in (0, k))]
            a = a[np.ix_(order, order)]
            block, c = a[:2, :2], a[2:, :2]
            det = block[0, 0] * block[1, 1] - block[0, 1] ** 2  # negative by the choice of this pivot
            above, below = above + 1, below + 1
            a = a[2:, 2:] - c @ (np.array([[block[1, 1], -block[0, 1]], [-block[0, 1], block[0, 0]]]) / det) @ c.T
        else:
            order = [k, *(i for i in range(len(a)) if i != k)]
            a = a[np.ix_(order, order)]
            d, c = a[0, 0], a[1:, 0]
            above, below = above + (d > 0), below + (d < 0)
            a = a[1:, 1:] - (np.outer(c, c) / d if d else 0)
    return int(above), int(below)


def leading(matrix: np.ndarray, most: int) -> list[tuple[float, np.ndarray]]:
    """Up to ``most`` (eigenvalue, unit eigenvector) of a symmetric matrix with eigenvalues of 0 or more, by falling eigenvalue.

    Eigenvalues within rounding of 0 are left out.  Equal eigenvalues get any orthonormal vectors of their space.
    """
    side = len(matrix)
    size = float(np.abs(matrix).sum(axis=1).max(initial=0.0))
    least = size * side * np.finfo(float).eps * 4
    out: list[tuple[float, np.ndarray]] = []
    if not size:
        return out
    rng = np.random.default_rng(0)
    tops: list[tuple[float, int]] = [(size * (1 + 1e-9), 0), (least, inertia(matrix, least)[0])]  # (shift, eigenvalues above it)

    def count(shift: float) -> int:
        tops.append((shift, inertia(matrix, shift)[0]))
        return tops[-1][1]

    while len(out) < min(most, tops[1][1]):
        number = len(out) + 1
        found = np.array([v for _, v in out]).reshape(-1, side)
        low, high = max(s for s, n in tops if n >= number), min(s for s, n in tops if n < number)
        lone = lambda: [n for s, n in tops if s == low][-1] == number
        vector = rng.standard_normal(side)
        while True:
            # one eigenvalue in the bracket, and that narrower than a tenth of its distance from 0, or no room left to cut
            while (not lone() or high - low > 0.1 * high) and high - low > least:
                middle = (low + high) / 2
                if count(middle) >= number:
                    low = middle
                else:
                    high = middle
            value, vector, rest = _rayleigh(matrix, found, vector, (low + high) / 2, least)
            near = max(2 * rest, least)
            if low - near <= value <= high + near and rest <= least and count(value - near) >= number > count(value + near):
                break
            if high - low <= least:  # a cluster that double precision cannot part
                break
            middle = (low + high) / 2
            low, high = (middle, high) if count(middle) >= number else (low, middle)
            vector = rng.standard_normal(side)
        out.append((value, vector))
    return out


def _rayleigh(matrix: np.ndarray, found: np.ndarray, vector: np.ndarray, shift: float, least: float) -> tuple[float, np.ndarray, float]:
    """Rayleigh quotient iteration in the space across ``found``: (eigenvalue, eigenvector, length of the residual)."""
    eye = np.eye(len(matrix))
    best = (shift, vector, np.inf)
    for step in range(12):
        try:
            vector = np.linalg.solve(matrix - shift * eye, vector)
        except np.linalg.LinAlgError:  # the shift is an eigenvalue to the last bit
            vector = np.linalg.solve(matrix - (shift + least) * eye, vector)
        for _ in range(2):
            vector = vector - found.T @ (found @ vector)
            vector = vector / np.linalg.norm(vector)
        value = float(vector @ matrix @ vector)
        rest = float(np.linalg.norm(matrix @ vector - value * vector))
        if rest >= best[2] and step > 2:
            break
        if rest < best[2]:
            best = (value, vector, rest)
        if step:  # the first solve keeps to the bracket's shift
            shift = value
    return best


@dataclass
class Whitening:
    """Components (unit rows) and eigenvalues, with the exact sums of the distinct vectors they come from."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n, rounded once for each integer part and fraction."""
        centre = [round(Fraction(s, self.n)) for s in self.sums]
        rest = np.array([float(Fraction(s, self.n) - c) for s, c in zip(self.sums, centre)])
        if _largest(x) + max(map(abs, centre)) >= _LONG:
            return x.astype(float) - np.array([float(Fraction(s, self.n)) for s in self.sums])
        return (x - np.array(centre, np.int64)).astype(float) - rest

    def project(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.components.T / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums of (n*x - S)^2, exact; null where that is no long."""
        if x.shape[1] * (self.n * _largest(x) + max(map(abs, self.sums))) ** 2 < _LONG:
            return ((self.n * x - np.array(self.sums, np.int64)) ** 2).sum(axis=1).tolist()
        exact = ((self.n * x.astype(object) - np.array(self.sums, object)) ** 2).sum(axis=1)
        return [v if v < _LONG else None for v in exact.tolist()]


def integers(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id, x): floor(scale * c) of each entry as long, at the ends of the long range where it is beyond them.

    Rows whose vector is null or empty, or holds a null or non-finite entry, go.
    """
    entries = F.col(vector_col).cast("array<double>")
    fine = F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    scaled = F.transform(entries, lambda c: F.floor(c * float(scale)))
    return rows.where(fine & (F.size(entries) > 0)).select(F.col(id_col).cast("bigint").alias("vec_id"), scaled.alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _largest(x: np.ndarray) -> int:
    return max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))


def _moments(centre: list[int]):
    """Per task: (i, j, sum of products of entries i <= j about ``centre``), exact, as decimal texts high * 10^18 + low."""
    middle, far = np.array(centre, np.int64), max(map(abs, centre))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(middle), len(middle)), object)
        for batch in batches:
            x = _matrix(batch.column("x"))
            for part in (x[i:i + 4096] for i in range(0, len(x), 4096)):
                big = _largest(part) + far
                if big * big * len(part) < 2 ** 53:  # products and their sums are whole in doubles
                    y = (part - middle).astype(float)
                    total += (y.T @ y).astype(np.int64).astype(object)
                else:
                    y = part.astype(object) - middle.astype(object)
                    total += y.T @ y
        i, j = np.triu_indices(len(middle))
        high, low = zip(*(divmod(int(v), _SPLIT) for v in total[i, j]))
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(map(str, high)), pa.array(map(str, low))],
                                         ["i", "j", "high", "low"])
    return run


def _product_sums(model: Whitening):
    """Per task: (i, j, sum of products) of the whitened distinct vectors, and at j = -1 the sums alone."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(model.values), len(model.values) + 1))
        for batch in batches:
            w = model.project(_matrix(batch.column("x")))
            total += np.column_stack([w.sum(axis=0), w.T @ w])
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel() - 1, pa.int32()), pa.array(total.ravel())], ["i", "j", "s"])
    return run


def fit(vectors: DataFrame, components: int = 4) -> tuple[Whitening | None, int]:
    """(model, length) of the distinct vectors of ``integers``; no model where there is no vector or only one.

    The commonest length counts (of several, the largest); vectors of other lengths have no part in the model.  The driver
    holds the sums, the square matrix and the components: their size is that of the length, whatever the number of rows.
    """
    lengths = vectors.groupBy(F.size("x").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    if lengths is None:
        return None, 0
    length = lengths["length"]
    distinct = materialize(vectors.where(F.size("x") == length).select("x").distinct(), "distinct-vectors")
    sums = distinct.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s"), F.count("*").alias("n"))
    rows = {r["i"]: r for r in sums.collect()}
    n, totals = rows[0]["n"], [int(rows[i]["s"]) for i in range(length)]
    centre = [round(Fraction(s, n)) for s in totals]
    moments = (distinct.mapInArrow(_moments(centre), "i int, j int, high string, low string").groupBy("i", "j")
               .agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")]).collect())
    rest = [s - n * c for s, c in zip(totals, centre)]
    covariance = np.zeros((length, length))
    for r in moments:
        i, j = r["i"], r["j"]
        covariance[i, j] = covariance[j, i] = (n * (int(r["high"]) * _SPLIT + int(r["low"])) - rest[i] * rest[j]) / n ** 2
    trace = float(np.trace(covariance))
    found = leading(covariance, components)
    if not found:
        return None, length
    model = Whitening(n, totals, np.array([v for _, v in found]), np.array([e for e, _ in found]), trace)
    parts = distinct.mapInArrow(_product_sums(model), "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    k = len(found)
    table = np.zeros((k, k + 1))
    for r in parts:
        table[r["i"], r["j"] + 1] = r["s"] / n
    model.identity_error = float(np.abs(table[:, 1:] - np.outer(table[:, 0], table[:, 0]) - np.eye(k)).max())
    return model, length


_OUT = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def whiten(rows: DataFrame, components: int = 4, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """One row for each remaining vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Rows go whose vector is null, empty, of another length than the commonest one, or holds a null or non-finite entry.
    Repeated rows and null ids pass through; equal vectors count once in the model.  Components with an eigenvalue of 0 have no
    rows, so an empty table, a single vector and copies of one vector give none.  ``deviation`` is null where it is no long.
    """
    vectors = integers(rows, id_col, vector_col, scale)
    model, length = fit(vectors, components)
    if model is None:
        return rows.sparkSession.createDataFrame([], _OUT)
    k = len(model.values)
    shares = model.values / model.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("x"))
                m = len(x)
                apart = pa.array(model.deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(m), k)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id").take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()),
                     pa.array(np.full(m * k, model.n), pa.int64()), apart, pa.array(model.project(x).ravel()), pa.array(np.tile(shares, m)),
                     pa.array(np.full(m * k, model.identity_error))],
                    [c.split()[0] for c in _OUT.split(", ")])

    return vectors.where(F.size("x") == length).mapInArrow(run, _OUT)
