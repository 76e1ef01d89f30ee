"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation of the centred rows.

The rows X (n vectors less their mean) are never moved: each step is one pass over the written list that
forms y = X q and X'y together and brings back one vector a task. The left vectors are linear images
of the rows, U = X M, so that a row's part of them is computed where the row is and nothing of length n is
stored; their inner products with y are M'(X'y). Both sides are orthogonalised against all earlier vectors
in every step. The singular values of the small bidiagonal matrix give deviations, its right vectors the
components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hindcast.llm.common import stage

COMPONENTS = 16
#: Entries are made whole numbers: floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Largest absolute entry for which those numbers, and doubles of them, are exact.
MOST_ENTRY = float(1 << 40)
SEED = 20240911
#: Relative size under which a vector counts as lost to rounding.
LOST = 1e-12


def whole_vectors(rows: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """``key`` and ``x``, the vector as whole numbers, without rows whose vector is null or holds null or
    non-finite entries.

    Vectors of another length than the commonest one (ties: the longest) are left out, too: they have no place
    among the dimensions. An entry beyond 2**40 raises, since its whole number would not be exact.
    """
    entries = F.col(f"`{vector}`").cast("array<double>")
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    good = rows.select(F.col(f"`{key}`").cast("long").alias(key), entries.alias("v")).where(F.col("v").isNotNull() & ~F.coalesce(bad, F.lit(True)))
    fits = lambda c: F.when(F.abs(c) > MOST_ENTRY, F.raise_error(F.lit("an entry beyond 2**40"))).otherwise(c)
    x = F.transform("v", lambda c: F.floor(fits(c) * SCALE).cast("long") + SHIFT)
    sizes = good.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return good.where(F.size("v") == (sizes.d if sizes else 0)).select(key, x.alias("x"))


def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), dimensions)


class CentredRows:
    """The distinct vectors of a written list, and passes over them."""

    def __init__(self, fit: DataFrame):
        self.fit = fit
        first = fit.first()
        self.dimensions = len(first.x) if first else 0
        total = self.sums(lambda x, _: np.concatenate([[len(x)], x.sum(axis=0)]), "long")
        self.n = int(total[0]) if total is not None else 0
        self.total = total[1:] if total is not None else np.zeros(0, np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n with S/n split into its whole part, subtracted exactly, and the rest."""
        whole = self.total // max(self.n, 1)
        return (x - whole).astype(np.float64) - (self.total - whole * self.n) / max(self.n, 1)

    def sums(self, of: Callable[[np.ndarray, CentredRows], np.ndarray], kind: str = "double") -> np.ndarray | None:
        """The sum over all rows of what ``of`` makes of blocks of them; one row a task is gathered, in order."""
        d, rows = self.dimensions, self
        bare = object.__new__(CentredRows)  # what tasks need, without the DataFrame
        bare.__dict__.update({k: v for k, v in rows.__dict__.items() if k != "fit"})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            held = None
            for batch in batches:
                if batch.num_rows:
                    part = of(_matrix(batch.column(0), d), bare)
                    held = part if held is None else held + part
            if held is not None:
                yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([held.ravel().tolist()], pa.list_(pa.int64() if kind == "long" else pa.float64()))], ["part", "sums"])

        found = sorted((r.part, r.sums) for r in self.fit.select("x").mapInArrow(run, f"part int, sums array<{kind}>").collect())
        return np.sum([np.array(s) for _, s in found], axis=0) if found else None

    def product(self, q: np.ndarray) -> tuple[np.ndarray, float]:
        """X'(X q) and the square of |X q|."""

        def of(x: np.ndarray, rows: CentredRows) -> np.ndarray:
            c = rows.centred(x)
            y = c @ q
            return np.append(c.T @ y, y @ y)

        found = self.sums(of)
        return found[:-1], float(found[-1])


def bidiagonalise(rows: CentredRows) -> tuple[np.ndarray, np.ndarray]:
    """Right vectors V (a column each) and the bidiagonal B with X V = U B, to the full number of dimensions.

    Reorthogonalisation puts what rounding left above the second diagonal into B. Where a vector is lost, a
    fresh one orthogonal to all before goes on, so that equal deviations are all found.
    """
    d, rng = rows.dimensions, np.random.default_rng(SEED)
    v, m, w = np.zeros((d, 0)), np.zeros((d, 0)), np.zeros((d, 0))  # V; U = X M; W = X'U
    b = np.zeros((0, 0))
    scale = 0.0

    def fresh() -> np.ndarray:
        new = rng.standard_normal(d)
        for _ in range(3):
            new = new - v @ (v.T @ new)
            new /= np.linalg.norm(new)
        return new

    following = fresh()
    for step in range(d):
        v = np.column_stack([v, following])
        # X v less its parts along earlier left vectors: the last one is foreseen, the others are measured.
        along = w.T @ following
        z, square = rows.product(following - m @ along)
        for _ in range(3):
            rest = m.T @ z
            along, z0 = along + rest, square
            if rest @ rest <= 1e-4 * square:
                z, square = z - w @ rest, square - rest @ rest
                break
            z, square = rows.product(following - m @ along)
        alpha = np.sqrt(max(square, 0.0))
        scale = max(scale, alpha, np.abs(along).max(initial=0.0))
        b = np.pad(b, ((0, 0), (0, 1)))
        b[:, -1] = along
        if alpha > LOST * scale and scale > 0:
            b = np.pad(b, ((0, 1), (0, 0)))
            b[-1, -1] = alpha
            m = np.column_stack([m, (following - m @ along) / alpha])
            w = np.column_stack([w, z / alpha])
            following = w[:, -1].copy()
            for _ in range(3):
                following -= v @ (v.T @ following)
            size = np.linalg.norm(following)
            following = following / size if size > LOST * scale else None
        else:
            following = None
        if following is None and step + 1 < d:
            following = fresh()
    return v, b


class Whitening:
    """Components, deviations and what was measured of them."""

    def __init__(self, rows: CentredRows, components: int = COMPONENTS):
        self.rows = rows
        d, n = rows.dimensions, rows.n
        self.axes, self.values, self.trace, self.identity_error = np.zeros((d, 0)), np.zeros(0), 0.0, 0.0
        if not d or not n:
            return
        self.trace = float(rows.sums(lambda x, r: (r.centred(x) ** 2).sum(axis=0)).sum()) / n
        if not self.trace > 0:
            return
        v, b = bidiagonalise(rows)
        _, deviations, right = np.linalg.svd(b)
        found = deviations > 1e-9 * deviations[0]
        axes = (v @ right[: len(deviations)][found].T)[:, :components]
        axes /= np.linalg.norm(axes, axis=0)
        largest = np.abs(axes).argmax(axis=0)
        self.axes = axes * np.where(axes[largest, np.arange(axes.shape[1])] < 0, -1.0, 1.0)
        self.values = deviations[found][:components] ** 2 / n
        self.identity_error = self.measured()

    def project(self, x: np.ndarray) -> np.ndarray:
        return self.rows.centred(x) @ self.axes / np.sqrt(self.values)

    def bare(self) -> Whitening:
        """What tasks need."""
        out, rows = object.__new__(Whitening), object.__new__(CentredRows)
        rows.__dict__.update({k: v for k, v in self.rows.__dict__.items() if k != "fit"})
        out.__dict__.update(self.__dict__, rows=rows)
        return out

    def measured(self) -> float:
        """Largest entry of the covariance of the whitened fit list less the identity, centred in a pass before."""
        here, n, k = self.bare(), self.rows.n, len(self.values)
        mean = self.rows.sums(lambda x, _: here.project(x).sum(axis=0)) / n

        def of(x: np.ndarray, _: CentredRows) -> np.ndarray:
            c = here.project(x) - mean
            return (c.T @ c).ravel()

        return float(np.abs(self.rows.sums(of).reshape(k, k) / n - np.eye(k)).max())


def fit_whitening(vectors: DataFrame, components: int = COMPONENTS) -> Whitening:
    """Fit on the distinct values of ``x``, once each; copies are counted away before the shuffle."""
    return Whitening(CentredRows(stage(vectors.select("x").distinct())), components)


def deviations(x: np.ndarray, rows: CentredRows) -> np.ndarray:
    """The exact sum over dimensions of (n * x - S) ** 2; raises where a long cannot hold it."""
    rough = ((rows.n * x.astype(np.float64) - rows.total) ** 2).sum(axis=1)
    if (rough > 9.2e18).any() or rows.n * float(np.abs(x).max(initial=0)) > 9.2e18:
        raise OverflowError("a deviation beyond 64 bits")
    return ((rows.n * x - rows.total) ** 2).sum(axis=1)


def whitened(rows: DataFrame, components: int = COMPONENTS, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """Each vector on each component: key, component, n, deviation, whitened, explained, identity_error.

    Rows whose vector is null, holds null or non-finite entries or has another length than the commonest
    one give no rows; repeated rows and null keys give theirs each. Components without variance are left out: an
    empty table, a single distinct vector or an empty one has none. Equal variances share a plane, of which any
    orthonormal basis is right. A component's entry of largest size is positive.
    """
    vectors = stage(whole_vectors(rows, vector, key))
    model = fit_whitening(vectors, components)
    here, k = model.bare(), len(model.values)
    schema = pa.schema([(key, pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count = batch.num_rows
            if not count or not k:
                continue
            x = _matrix(batch.column(1), here.rows.dimensions)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(np.repeat(np.arange(count), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), count)),
                    pa.array(np.full(count * k, here.rows.n)),
                    pa.array(np.repeat(deviations(x, here.rows), k)),
                    pa.array(here.project(x).ravel()),
                    pa.array(np.tile(here.values / here.trace, count)) if k else pa.array([], pa.float64()),
                    pa.array(np.full(count * k, here.identity_error)),
                ],
                schema=schema,
            )

    return vectors.select(key, "x").mapInArrow(run, f"{key} long, component int, n long, deviation long, whitened double, explained double, identity_error double")
