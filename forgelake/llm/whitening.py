"""Whitening of embeddings over their distinct vectors (operator 11).

1. Each entry c becomes the whole number ``x = floor(64 * c) + 1000000``. Rows with the same x vector are one
   vector with a count; its sha-256 is the key by which rows find it again, so that vectors travel once.
2. One pass over the distinct vectors sums the weights and, exactly, the entries. A vector weighs one or, with
   ``weights="counts"``, as often as it occurs.
3. A second pass takes the mean off each vector, then multiplies: every task gives one matrix of weighted
   cross-products, row by row, and rows of all tasks are added. Upper halves only.
4. Eigenvectors of the covariance (one matrix per length of vector, whatever the number of rows) are found in
   the driver. A third pass projects each distinct vector once, and a fourth measures how far the covariance
   of what came out is from the identity.
5. Rows are joined with their vector's result by the key. A vector that a third of all rows share is one
   row on the other side of that join, so the skew join can split it.

Defined results: rows whose vector is NULL, or holds a NULL, NaN or infinite entry, are left out. Entries
beyond 2^56 are set to it. Repeated rows, also with one id, stay. Vectors of different lengths are fitted apart;
empty ones have no components. Components whose eigenvalue is below ``LEAST`` times the largest have no
direction of their own and are left out, so one vector alone has none. ``deviation`` is NULL beyond 64 bits. An
empty table gives no rows. Other columns pass through, and names drawn here avoid theirs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from forgelake.llm.common import free_name, map_batches, prepare
from forgelake.session import materialize

COMPONENTS = 16
# Eigenvalues below this share of the largest are noise of double arithmetic.
LEAST = 1e-10
# The grid of the entries.
SCALE, SHIFT = 64, 1_000_000
_FURTHEST = float(1 << 56)
_HALF = 31
_LONGEST = (1 << 63) - 1


@dataclass
class Fit:
    """Mean and leading components of all vectors of one length."""

    n: int
    sums: list[int]
    # Rows are unit eigenvectors, in order of falling eigenvalue.
    axes: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float = float("nan")

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x less the mean: whole parts are taken off as whole numbers, so that no digit is lost."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([s % self.n / self.n for s in self.sums])
        return (x - whole).astype(np.float64) - rest

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n * x - S)^2 over all entries, exactly."""
        whole, rest = [s // self.n for s in self.sums], [s % self.n for s in self.sums]
        from_whole = x - np.array(whole, np.int64)
        largest = self.n * int(np.abs(from_whole).max(initial=0)) + self.n
        exact = x.shape[1] * largest * largest <= _LONGEST
        kind = np.int64 if exact else object
        apart = from_whole.astype(kind) * self.n - np.array(rest, kind)
        found = (apart * apart).sum(1).tolist()
        return found if exact else [v if v <= _LONGEST else None for v in found]


def grid(vector: Column) -> Column:
    """The whole numbers of a vector."""
    inside = lambda c: F.greatest(F.least(c.cast("double") * SCALE, F.lit(_FURTHEST)), F.lit(-_FURTHEST))
    return F.transform(vector, lambda c: F.floor(inside(c)) + F.lit(SHIFT).cast("bigint"))


def is_whole(vector: Column) -> Column:
    """Whether a vector is there and all its entries are finite numbers."""
    finite = lambda c: F.coalesce(~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")), F.lit(False))
    return vector.isNotNull() & F.forall(vector, finite)


def _by_length(vectors: pa.ListArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each length of vector, the places of those vectors and their entries as rows of a matrix."""
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
    entries = vectors.flatten().to_numpy(zero_copy_only=False)
    first = np.cumsum(lengths) - lengths
    for d in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == d)
        yield d, at, entries[first[at][:, None] + np.arange(d)]


def _products(rows: DataFrame, vector: str, weight: str, centre: dict[int, Callable]) -> dict[int, np.ndarray]:
    """Weighted cross-products of centred vectors by length, added up over all tasks.

    ``centre`` has a function that centres a matrix for each length.
    """
    context = rows.sparkSession.sparkContext
    shared = context.broadcast(centre)

    def multiply(batches) -> Iterator[dict[str, list]]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            weights = batch.column(1).to_numpy(zero_copy_only=False)
            for d, at, x in _by_length(batch.column(0)):
                if d not in shared.value:
                    continue
                y = shared.value[d](x)
                part = (y * weights[at][:, None]).T @ y
                total[d] = part if d not in total else total[d] + part
        for d, m in total.items():
            for i in range(d):
                yield {"d": [d], "i": [i], "row": [m[i, i:].tolist()]}

    parts = map_batches(rows.select(vector, weight), multiply, "d long, i long, row array<double>")
    cells = parts.select("d", "i", F.posexplode("row").alias("j", "value")).groupBy("d", "i", "j").agg(F.sum("value").alias("value"))
    # As many cells as half a matrix has, whatever the number of rows.
    found = cells.toArrow()
    d, i, j, value = (found[c].to_numpy() for c in ("d", "i", "j", "value"))
    out = {}
    for length in np.unique(d).tolist():
        mine = d == length
        m = np.zeros((length, length))
        m[i[mine], i[mine] + j[mine]] = value[mine]
        out[length] = m + np.triu(m, 1).T
    return out


def distinct(rows: DataFrame, x: str, key: str) -> DataFrame:
    """One row per x vector: key, x and how many rows have it. Written once, as several passes read it."""
    return materialize(rows.groupBy(key, x).agg(F.count(F.lit(1)).alias("copies")).select(
        F.col(key).alias("key"), F.col(x).alias("x"), "copies"), "vectors")


def _sums(vectors: DataFrame) -> list[tuple[int, int, list[int]]]:
    """Length, weight and exact sums of the entries, per length. ``vectors`` has x and weight."""

    def add(batches) -> Iterator[dict[str, list]]:
        total: dict[int, tuple[int, list[int]]] = {}
        for batch in batches:
            weights = batch.column(1).to_numpy(zero_copy_only=False)
            for d, at, x in _by_length(batch.column(0)):
                w = weights[at].astype(np.int64)
                # In Python's whole numbers where 64 bits could be too few.
                fits = x.size == 0 or int(np.abs(x).max()) * int(w.sum()) <= _LONGEST
                part = w @ x if fits else w.astype(object) @ x.astype(object)
                n, sums = total.get(d, (0, [0] * d))
                total[d] = n + int(w.sum()), [a + int(b) for a, b in zip(sums, part.tolist(), strict=True)]
        for d, (n, sums) in total.items():
            high = [s >> _HALF for s in sums]
            yield {"d": [d], "n": [n], "high": [high], "low": [[s - (h << _HALF) for s, h in zip(sums, high, strict=True)]]}

    parts = map_batches(vectors.select("x", "weight"), add, "d long, n long, high array<long>, low array<long>")
    cells = parts.select("d", "n", F.posexplode(F.arrays_zip("high", "low")).alias("i", "s")).groupBy("d", "i")
    wide = "decimal(38,0)"
    found = cells.agg(
        F.sum("n").alias("n"), F.sum(F.col("s.high").cast(wide)).alias("high"), F.sum(F.col("s.low").cast(wide)).alias("low")
    )
    out: dict[int, tuple[int, list[int]]] = {}
    # One row per entry of a vector, whatever the number of rows.
    for r in found.orderBy("d", "i").collect():
        out.setdefault(r["d"], (r["n"], []))[1].append((int(r["high"]) << _HALF) + int(r["low"]))
    return [(d, n, sums) for d, (n, sums) in out.items()]


def fit(vectors: DataFrame, components: int = COMPONENTS) -> dict[int, Fit]:
    """Mean and components per length of vector. ``vectors`` has x and weight."""
    fits = {d: Fit(n, sums, np.zeros((0, d)), np.zeros(0), 0.0) for d, n, sums in _sums(vectors)}
    products = _products(vectors, "x", "weight", {d: f.centred for d, f in fits.items()})
    for d, f in fits.items():
        covariance = products.get(d, np.zeros((d, d))) / f.n
        values, axes = np.linalg.eigh(covariance)
        order = np.argsort(-values, kind="stable")[:components]
        order = order[values[order] > LEAST * values.max(initial=0.0)]
        f.axes, f.eigenvalues, f.trace = axes.T[order], values[order], float(np.trace(covariance))
    return fits


def _project(vectors: DataFrame, fits: dict[int, Fit]) -> DataFrame:
    """key, weight, whitened and deviation of each distinct vector."""
    shared = vectors.sparkSession.sparkContext.broadcast(fits)

    def run(batches) -> Iterator[dict[str, list]]:
        for batch in batches:
            whitened, deviation = [None] * batch.num_rows, [None] * batch.num_rows
            for d, at, x in _by_length(batch.column(2)):
                f = shared.value.get(d)
                if f is None:
                    continue
                y = f.centred(x) @ f.axes.T / np.sqrt(f.eigenvalues)
                for place, row, apart in zip(at.tolist(), y.tolist(), f.deviations(x), strict=True):
                    whitened[place], deviation[place] = row, apart
            yield {"key": batch.column(0), "weight": batch.column(1), "d": batch.column(2).value_lengths().cast(pa.int64()),
                   "whitened": whitened, "deviation": deviation}

    schema = "key binary, weight long, d long, whitened array<double>, deviation long"
    return map_batches(vectors.select("key", "weight", "x"), run, schema)


class _Less:
    """Takes a mean off the rows of a matrix."""

    def __init__(self, mean: np.ndarray):
        self.mean = mean

    def __call__(self, rows: np.ndarray) -> np.ndarray:
        return rows - self.mean


def _identity_errors(projected: DataFrame, fits: dict[int, Fit]) -> None:
    """Enter how far the covariance of the whitened vectors is from the identity, measured over all of them."""
    for d, f in fits.items():
        k = len(f.eigenvalues)
        if not k:
            continue
        mine = projected.filter(F.col("d") == d)
        means = mine.select([F.sum(F.col("whitened")[c] * F.col("weight")).alias(f"m{c}") for c in range(k)]).first()
        found = _products(mine, "whitened", "weight", {k: _Less(np.array(list(means)) / f.n)})
        f.identity_error = float(np.abs(found[k] / f.n - np.eye(k)).max())


def whiten(
    rows: DataFrame, *, vector_col: str = "embedding", components: int = COMPONENTS, weights: str = "one"
) -> tuple[DataFrame, str, dict[int, Fit]]:
    """``rows`` with a struct of n, deviation, whitened, explained and identity_error, the struct's name, and the fits.

    ``weights`` is "one" (each distinct vector counts once) or "counts" (as often as it occurs). ``whitened`` and
    ``explained`` have an entry per component.
    """
    if weights not in ("one", "counts"):
        raise ValueError(f"weights: {weights}")
    spark: SparkSession = prepare(rows.sparkSession)
    x, key, out = (free_name(n, rows.columns) for n in ("_x", "_key", "_whitening"))
    given = [F.col(f"`{c}`") for c in rows.columns]
    vector = F.col(f"`{vector_col}`")
    # The filter stands in a step of its own: entries are only rounded where all are finite.
    usable = rows.filter(is_whole(vector)).withColumn(x, grid(vector))
    keyed = usable.withColumn(key, F.unhex(F.sha2(F.array_join(F.col(x), ","), 256)))
    weight = F.lit(1).cast("bigint") if weights == "one" else F.col("copies")
    vectors = distinct(keyed, x, key).withColumn("weight", weight)
    fits = fit(vectors, components)
    projected = materialize(_project(vectors, fits), "whitened")
    _identity_errors(projected, fits)
    # One row per length of vector.
    facts = spark.createDataFrame(
        [(d, f.n, (f.eigenvalues / f.trace).tolist(), f.identity_error) for d, f in fits.items() if len(f.eigenvalues)],
        "d long, n long, explained array<double>, identity_error double",
    )
    results = projected.join(F.broadcast(facts), "d").select(
        F.col("key").alias(key), F.struct("n", "deviation", "whitened", "explained", "identity_error").alias(out)
    )
    joined = keyed.select(*given, key).join(results, key, "left").select(*given, out)
    return joined, out, fits


def by_component(whitened: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """A row for each row and component, numbered from 1."""
    w = F.col(column)
    pairs = F.posexplode(F.arrays_zip(w["whitened"].alias("whitened"), w["explained"].alias("explained"))).alias("at", "c")
    rows = whitened.filter(w.isNotNull()).select(*keep, w["n"].alias("n"), w["deviation"].alias("deviation"),
                                                 w["identity_error"].alias("identity_error"), pairs)
    return rows.select(*keep, (F.col("at") + 1).alias("component"), "n", "deviation", F.col("c.whitened").alias("whitened"),
                       F.col("c.explained").alias("explained"), "identity_error")
