"""Whitening of vectors: principal components by contour integration (FEAST), checked by inertia.

A first pass adds up the integer vectors, a second one the products of the vectors centred at the
nearest integers, exactly as long as sums stay below 2^53, then corrected by what is left of the mean. The covariance is d x d
numbers, whatever the number of rows. From it the components are found so: inertia counts (signs of
pivots of a shifted matrix) tell how many eigenvalues exceed a shift, and halving finds one that has
just the wanted number above it. A quadrature of complex shifted solves around that interval projects
random vectors onto its eigenvectors; Rayleigh and Ritz's method extracts them; this is repeated
until residuals are those of rounding and as many are found as the inertia says. A third pass
projects all rows. The error of the whitened covariance is measured on the rows as they come out.

Rows whose vector is null or holds null or non-finite entries are dropped, also entries of 2^42 or
more in size, whose integers a double does not hold. A vector shorter than the longest counts as ending in zeros.
Rows without vec_id and repeated rows are rows like others. A component whose eigenvalue is no more
than rounding has no row (all of them if the vectors are equal, as with a single one). A deviation
beyond 2^63 is null. An empty table gives an empty result. Other columns are ignored.
"""

from collections.abc import Iterator
from decimal import Decimal
from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeledger.llm.shared import prepare, stored

_SCALE, _SHIFT = 1024, 100_000
# Solves on the upper half of the contour.
_NODES = 8
_ROUNDS = 30


def eigenvalues_above(matrix: np.ndarray, shift: float) -> int:
    """The inertia of matrix - shift: positive pivots of its symmetric factorisation, largest pivot first."""
    rest, positive = matrix - shift * np.eye(len(matrix)), 0
    while len(rest):
        diagonal = np.abs(np.diagonal(rest))
        k = int(np.argmax(diagonal))
        apart = np.abs(rest)
        np.fill_diagonal(apart, 0)
        i, j = np.unravel_index(np.argmax(apart), apart.shape)
        if diagonal[k] >= 0.64 * apart[i, j]:
            if not diagonal[k]:
                break
            positive += int(rest[k, k] > 0)
            taken = [k]
        else:
            # A pivot of two rows whose determinant is negative: one eigenvalue of each sign.
            positive += 1
            taken = [i, j]
        others = np.setdiff1d(np.arange(len(rest)), taken)
        side = rest[np.ix_(others, taken)]
        rest = rest[np.ix_(others, others)] - side @ np.linalg.solve(rest[np.ix_(taken, taken)], side.T)
        rest = (rest + rest.T) / 2
    return positive


def cut_below(matrix: np.ndarray, wanted: int, top: float) -> tuple[float, int]:
    """A shift with ``wanted`` eigenvalues above it, in the middle of the gap; more, if they are not told apart."""
    low, high = -1e-9 * top, top
    while high - low > 1e-14 * top:
        shift = (low + high) / 2
        count = eigenvalues_above(matrix, shift)
        if count == wanted:
            ends = []
            for end in (low, high):
                inside = shift
                for _ in range(6):
                    middle = (inside + end) / 2
                    if eigenvalues_above(matrix, middle) == wanted:
                        inside = middle
                    else:
                        end = middle
                ends.append(inside)
            return sum(ends) / 2, wanted
        low, high = (shift, high) if count > wanted else (low, shift)
    return low, eigenvalues_above(matrix, low)


def feast(matrix: np.ndarray, low: float, high: float, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The eigenvalues between low and high, falling, and their eigenvectors as columns; ``count`` of them."""
    size, centre, radius = len(matrix), (low + high) / 2, (high - low) / 2
    nodes, weights = np.polynomial.legendre.leggauss(_NODES)
    turns = np.exp(0.5j * np.pi * (1 + nodes))
    width, scale = min(size, count + max(4, count // 2)), np.abs(matrix).sum(1).max()
    while True:
        subspace, best = np.random.default_rng(13).standard_normal((size, width)), np.inf
        for _ in range(_ROUNDS):
            projected = np.zeros_like(subspace)
            for turn, weight in zip(turns, weights):
                shifted = (centre + radius * turn) * np.eye(size) - matrix
                projected += weight * radius / 2 * (turn * np.linalg.solve(shifted, subspace.astype(complex))).real
            basis, _ = np.linalg.qr(projected)
            values, turned = np.linalg.eigh(basis.T @ matrix @ basis)
            subspace = basis @ turned
            inside = values > low
            found = subspace[:, inside]
            worst = np.abs(matrix @ found - found * values[inside]).max(initial=0)
            # Done when rounding is all that is left: it is small and gets no smaller.
            if inside.sum() == count and worst <= 1e-12 * scale and worst >= best / 2:
                order = np.argsort(-values[inside])
                return values[inside][order], found[:, order]
            best = min(best, worst) if inside.sum() == count else np.inf
        if width == size:
            raise ArithmeticError(f"{count} eigenvalues lie above {low}, but {int(inside.sum())} were found")
        width = min(size, 2 * width)


def leading_components(covariance: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """At most ``most`` eigenvalues, falling, and unit eigenvectors as columns, each with its largest entry positive."""
    trace = float(np.trace(covariance))
    if not trace > 0:
        return np.empty(0), np.empty((len(covariance), 0))
    scaled = covariance / trace
    top = 1.001 * float(min(1, np.abs(scaled).sum(1).max()))
    wanted = min(most, eigenvalues_above(scaled, 4 * len(scaled) * np.finfo(float).eps))
    low, count = cut_below(scaled, wanted, top)
    values, vectors = feast(scaled, low, top, count)
    values, vectors = values[:wanted], vectors[:, :wanted]
    signs = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(wanted)])
    return values * trace, vectors * signs


class Fit(NamedTuple):
    n: int
    sums: list[int]
    covariance: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @property
    def centre(self) -> np.ndarray:
        """The integers nearest to the mean."""
        return np.array([round(Fraction(s, self.n)) for s in self.sums], np.int64)

    @property
    def left(self) -> np.ndarray:
        """What the mean is beyond them."""
        return np.array([float(Fraction(s, self.n) - int(c)) for s, c in zip(self.sums, self.centre)])


def integer_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id and x, the usable vectors as integers."""
    bad = "exists(embedding, c -> c IS NULL OR isnan(c) OR NOT abs(c) < 4398046511104)"
    x = f"transform(embedding, c -> CAST(floor({_SCALE}D * CAST(c AS DOUBLE)) AS LONG) + {_SHIFT}L)"
    return vectors.where(f"embedding IS NOT NULL AND NOT {bad}").selectExpr("CAST(vec_id AS LONG) AS vec_id", f"{x} AS x")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    lengths = column.value_lengths().to_numpy()
    found = np.full((len(column), width), _SHIFT, np.int64)
    found[np.arange(width) < lengths[:, None]] = column.flatten().to_numpy()
    return found


def fit(rows: DataFrame, most: int = 8) -> Fit | None:
    """Sums, covariance and components of integer vectors; None if there are no vectors with entries."""
    prepare(rows.sparkSession)
    width, n = rows.selectExpr("max(size(x))", "count(1)").first()
    if not width:
        return None

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [0] * width
        for batch in batches:
            sums = [a + b for a, b in zip(sums, _matrix(batch.column(0), width).sum(0).tolist())]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(width), pa.int32()), pa.array(map(Decimal, sums), pa.decimal128(38, 0))], ["i", "s"]
        )

    added = rows.select("x").mapInArrow(add, "i int, s decimal(38, 0)").groupBy("i").agg(F.expr("sum(s) AS s"))
    sums = [int(row.s) for row in sorted(added.collect())]
    known = Fit(n, sums, np.empty(0), np.empty(0), np.empty(0))
    centre, left = known.centre, known.left
    upper = np.triu_indices(width)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products = np.zeros((width, width))
        for batch in batches:
            y = (_matrix(batch.column(0), width) - centre).astype(float)
            products += y.T @ y
        columns = [pa.array(upper[0], pa.int32()), pa.array(upper[1], pa.int32()), pa.array(products[upper])]
        yield pa.RecordBatch.from_arrays(columns, ["i", "j", "p"])

    multiplied = rows.select("x").mapInArrow(multiply, "i int, j int, p double").groupBy("i", "j").agg(F.expr("sum(p) AS p"))
    covariance = np.zeros((width, width))
    for i, j, p in multiplied.collect():
        covariance[i, j] = covariance[j, i] = p / n - left[i] * left[j]
    return Fit(n, sums, covariance, *leading_components(covariance, most))


def project(rows: DataFrame, fitted: Fit) -> DataFrame:
    """vec_id, deviation and whitened (one number per component) of integer vectors."""
    n, width, centre, left = fitted.n, len(fitted.sums), fitted.centre, fitted.left
    wrapped = np.array([s % (1 << 64) for s in fitted.sums], np.uint64)
    axes = fitted.vectors / np.sqrt(fitted.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), width)
            centred = (x - centre) - left
            # Sums modulo 2^64 are exact where the size of the result is known to be below 2^63.
            off = x.astype(np.uint64) * np.uint64(n) - wrapped
            about = ((centred * n) ** 2).sum(1)
            exact = (off * off).sum(1).astype(np.int64)
            kept = (about < 9.2e18) & (exact >= 0)
            columns = [batch.column(0), pa.array(exact, mask=~kept), pa.array(list(centred @ axes), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "deviation", "whitened"])

    return rows.mapInArrow(run, "vec_id long, deviation long, whitened array<double>")


def identity_error(projected: DataFrame, n: int, components: int) -> float:
    """The largest absolute entry of the covariance of whitened rows minus the identity."""
    pairs = [(i, j) for i in range(components) for j in range(i, components)]
    means = projected.selectExpr(*[f"sum(whitened[{i}])" for i in range(components)]).first()
    found = projected.selectExpr(
        *[f"sum((whitened[{i}] - {means[i] / n!r}D) * (whitened[{j}] - {means[j] / n!r}D))" for i, j in pairs]
    ).first()
    return max(abs(s / n - (i == j)) for s, (i, j) in zip(found, pairs))


def whiten(vectors: DataFrame, most: int = 8) -> DataFrame:
    """One row per usable vector and component."""
    rows = integer_vectors(vectors)
    fields = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    fitted = fit(rows, most)
    if fitted is None or not len(fitted.values):
        return vectors.sparkSession.createDataFrame([], T.StructType.fromDDL(fields))
    projected = stored(project(rows, fitted), "whitened")
    shares = (fitted.values / np.trace(fitted.covariance)).tolist()
    error = identity_error(projected, fitted.n, len(shares))
    listed = "array(" + ", ".join(f"{share!r}D" for share in shares) + ")"
    return projected.selectExpr("vec_id", "deviation", "posexplode(whitened) AS (at, whitened)").selectExpr(
        "vec_id",
        "CAST(at + 1 AS INT) AS component",
        f"{fitted.n}L AS n",
        "deviation",
        "whitened",
        f"{listed}[at] AS explained",
        f"{error!r}D AS identity_error",
    )
