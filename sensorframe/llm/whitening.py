"""Whitening of embeddings on principal components found by contour integration.

Every entry c of a vector becomes the whole number x = floor(64 c) + 1000000.
Count, sums and the covariance's products are whole numbers as well: each task
adds up its rows and Spark adds the tasks, so the covariance V is the exact one,
rounded once, whatever the partitioning.

The components come from FEAST. Inertia counts (signs of an L D L' factorisation
of V - s I) cut the upper end of the spectrum into intervals of a few
eigenvalues each. For an interval, the integral of (z I - V)^-1 Q around it
projects the random block Q onto the interval's eigenvectors; it is a sum over a
few quadrature points z, and each (interval, point) solve is a Spark row of its
own. Rayleigh-Ritz on the projected block gives the eigenpairs. The round is
repeated until residuals stand still, and an interval is done only when it
yields as many eigenpairs as its inertia counts tell; otherwise its block grows.

Nothing but tables of the size of V (dimension times dimension) reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from sensorframe.llm.common import stored

SCALE, SHIFT = 64, 1_000_000
#: Eigenvalues and factor an interval may reach over before it is cut, and quadrature points on the half circle.
SPAN, REACH, POINTS = 8, 1.25, 8
#: Eigenvalues below this share of the largest one count as zero: there is nothing to divide by.
ZERO = 1e-12
#: Eigenvalues nearer than this share of their size are one cluster, which no interval cuts.
EQUAL = 1e-10
_LIMB = 40


# --------------------------------------------------------- rows as whole numbers
def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """Rows whose vector is not null and holds only finite numbers; ``_v`` is the vector as doubles."""
    v = F.col(column).cast("array<double>")
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))
    return vectors.where(F.col(column).isNotNull() & finite).withColumn("_v", v)


def whole_numbers(values: np.ndarray) -> np.ndarray:
    """floor(64 c) + 1000000 as int64; beyond +-2^62 the floor is held at that bound."""
    bound = float(1 << 62)
    return np.clip(np.floor(values * SCALE), -bound, bound).astype(np.int64) + SHIFT


def _matrix(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    flat = np.asarray(batch.column("_v").flatten().to_numpy(zero_copy_only=False), float)
    return whole_numbers(flat).reshape(batch.num_rows, dim)


def _limbs(values) -> list[pa.Array]:
    """Whole numbers of any size as three columns, each small enough to be summed as a long."""
    mask = (1 << _LIMB) - 1
    if isinstance(values, np.ndarray) and values.dtype == np.int64:
        parts = [values & mask, (values >> _LIMB), np.zeros_like(values)]
    else:
        whole = [int(v) for v in values]
        parts = [[v & mask for v in whole], [(v >> _LIMB) & mask for v in whole], [v >> 2 * _LIMB for v in whole]]
    return [pa.array(p, pa.int64()) for p in parts]


def _products(y: np.ndarray, pairs: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Sums of y_i y_j over rows: in floating point where every partial sum is exact, else in Python's integers."""
    top = max(int(y.max()), -int(y.min())) if y.size else 0
    if top * top * len(y) < 1 << 53:
        f = y.astype(float)
        return (f.T @ f)[pairs].astype(np.int64)
    big = y.astype(object)
    return np.array([int(big[:, i] @ big[:, j]) for i, j in zip(*pairs)], object)


def _added(rows: DataFrame, dim: int, cells: int, fn) -> list[int]:
    """Sum over all rows of the ``cells`` whole numbers that ``fn`` gives for a matrix of rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, total = ["cell", "lo", "mid", "hi"], None

        def flush(values):
            return pa.RecordBatch.from_arrays([pa.array(np.arange(cells), pa.int64()), *_limbs(values)], names)

        for b in batches:
            if not b.num_rows:
                continue
            new = fn(_matrix(b, dim))
            if total is None:
                total = new
            elif new.dtype == total.dtype == np.int64 and max(np.abs(total).max(), np.abs(new).max()) < 1 << 61:
                total = total + new
            else:
                total = total.astype(object) + new.astype(object)
        if total is not None:
            yield flush(total)

    limbs = rows.select("_v").mapInArrow(run, "cell bigint, lo bigint, mid bigint, hi bigint")
    out = [0] * cells
    for r in limbs.groupBy("cell").agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("lo", "mid", "hi")]).collect():
        out[r.cell] = int(r.lo) + (int(r.mid) << _LIMB) + (int(r.hi) << 2 * _LIMB)
    return out


class Centre:
    """Count, sums and nearest whole mean of the fit list, all exact."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums
        self.mean = [(2 * s + n) // (2 * n) for s in sums]
        self.left = [s - n * m for s, m in zip(sums, self.mean)]

    def near(self, x: np.ndarray) -> np.ndarray:
        """x less the whole mean: small whole numbers."""
        return x - np.array(self.mean, np.int64)

    def scaled(self, x: np.ndarray) -> np.ndarray:
        """n x - S, as int64 if that is sure to fit, else as Python integers."""
        y, left = self.near(x), np.array(self.left, object)
        top = max(int(y.max()), -int(y.min())) if y.size else 0
        if self.n * (top + 1) < 1 << 62:
            return self.n * y - left.astype(np.int64)
        return self.n * y.astype(object) - left

    def deviations(self, scaled: np.ndarray) -> pa.Array:
        """Sum of squares per row; null where it passes 64 bits."""
        top = max(abs(int(scaled.max())), abs(int(scaled.min()))) if scaled.size else 0
        if top * top * max(1, scaled.shape[1]) < 1 << 63:
            return pa.array((scaled.astype(np.int64) ** 2).sum(1), pa.int64())
        sums = [sum(int(v) ** 2 for v in row) for row in scaled]
        return pa.array([s if s < 1 << 63 else None for s in sums], pa.int64())


def centre_of(rows: DataFrame, n: int, dim: int) -> Centre:
    def sums(x: np.ndarray) -> np.ndarray:
        top = max(int(x.max()), -int(x.min()))
        return x.sum(0) if top * len(x) < 1 << 62 else np.array([int(c) for c in x.astype(object).sum(0)], object)
    return Centre(n, _added(rows, dim, dim, sums))


def covariance(rows: DataFrame, centre: Centre) -> np.ndarray:
    """Covariance with divisor n, each entry the exact one rounded once."""
    n, dim = centre.n, len(centre.sums)
    pairs = np.triu_indices(dim)
    sums = _added(rows, dim, len(pairs[0]), lambda x: _products(centre.near(x), pairs))
    v = np.zeros((dim, dim))
    for i, j, s in zip(*pairs, sums):
        v[i, j] = v[j, i] = (n * s - centre.left[i] * centre.left[j]) / (n * n)
    return v


# ------------------------------------------------------------ spectrum of V
def count_above(v: np.ndarray, s: float) -> int:
    """Number of eigenvalues greater than ``s``: positive pivots of V - s I = L D L'.

    Pivots are 1 x 1 on the largest diagonal entry, or 2 x 2 on the largest entry
    where the diagonal is small; a 2 x 2 pivot of that kind has one sign of each.
    """
    a, above = v - s * np.eye(len(v)), 0
    while len(a):
        size = np.abs(a)
        on = int(np.argmax(np.diag(size)))
        i, j = divmod(int(np.argmax(size)), len(a))
        if size[i, j] == 0:
            break
        if size[on, on] >= 0.64 * size[i, j]:
            above += a[on, on] > 0
            rest = np.arange(len(a)) != on
            a = a[np.ix_(rest, rest)] - np.outer(a[rest, on], a[rest, on] / a[on, on])
        else:
            above += 1
            rest = ~np.isin(np.arange(len(a)), (i, j))
            side = a[np.ix_(rest, [i, j])]
            a = a[np.ix_(rest, rest)] - side @ np.linalg.solve(a[np.ix_([i, j], [i, j])], side.T)
    return int(above)


class _Counts:
    """Inertia counts of V at many shifts, each computed once."""

    def __init__(self, v: np.ndarray):
        self.v, self.known = v, {}

    def above(self, s: float) -> int:
        if s not in self.known:
            self.known[s] = count_above(self.v, s)
        return self.known[s]

    def gap(self, s: float, low: float, high: float) -> tuple[float, float]:
        """The gap between eigenvalues that ``s`` lies in, looked at inside (low, high)."""
        k, edges = self.above(s), []
        for far in (low, high):
            near = s
            for _ in range(6):
                middle = (near + far) / 2
                near, far = (middle, far) if self.above(middle) == k else (near, middle)
            edges.append(near)
        return edges[0], edges[1]

    def cut(self, low: float, high: float, k: int) -> float | None:
        """A point amid a gap of (low, high) with exactly ``k`` eigenvalues above; None if (nearly) equal ones leave none."""
        a, b = low, high
        least = EQUAL * max(abs(low), abs(high))
        for _ in range(60):
            s = (a + b) / 2
            if b - a < least:
                return None
            c = self.above(s)
            if c == k:
                a, b = self.gap(s, a, b)
                return (a + b) / 2 if b - a >= least else None
            a, b = (s, b) if c > k else (a, s)
        return None


def intervals(v: np.ndarray, wanted: int) -> list[tuple[float, float, int]]:
    """(low, high, eigenvalues inside), from the top down, together holding at least the ``wanted`` largest positive ones.

    An interval reaches over at most a factor of ``REACH``, so that its contour is
    not wide beside the gaps between eigenvalues, and holds at most ``SPAN`` of
    them (more only where they are equal).
    """
    counts = _Counts(v)
    top = float(np.abs(v).sum(1).max()) * 1.05  # no eigenvalue is larger than a row's sum
    if not top > 0:
        return []
    largest = top  # the largest eigenvalue, to a tenth: zero is told by it
    while counts.above(largest * 0.9) == 0:
        largest *= 0.9
    floor = largest * ZERO
    positive = counts.above(floor)
    wanted = min(wanted, positive)
    if not wanted:
        return []
    low = floor
    for k in range(wanted, positive):  # the nearest gap below, should some be equal
        found = counts.cut(floor, top, k)
        if found is not None:
            low = found
            break
    out, open_ = [], [(low, top)]
    while open_:
        a, b = open_.pop()
        most, least = counts.above(a), counts.above(b)
        if most == least:
            continue
        if b > REACH * a:
            s = sum(counts.gap(float(np.sqrt(a * b)), a, b)) / 2
            k = counts.above(s)
            open_ += [(s, b)] if k == most else [(a, s)] if k == least else [(a, s), (s, b)]
            continue
        cut = None
        if most - least > SPAN:
            for k in sorted(range(least + 1, most), key=lambda k: abs(2 * k - most - least)):
                cut = counts.cut(a, b, k)
                if cut is not None:
                    break
        if cut is None:
            out.append((a, b, most - least))
        else:
            open_ += [(a, cut), (cut, b)]
    return sorted(out, reverse=True)


def _projected(spark: SparkSession, v: np.ndarray, spans: list[tuple[float, float]], blocks: list[np.ndarray]) -> list[np.ndarray]:
    """The contour integral of (z I - V)^-1 Q for every interval; each quadrature point is solved in a task."""
    x, w = np.polynomial.legendre.leggauss(POINTS)
    jobs = [(i, p) for i in range(len(spans)) for p in range(POINTS)]
    dim = len(v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, p in zip(b.column("i").to_pylist(), b.column("p").to_pylist()):
                low, high = spans[i]
                turn = np.exp(0.5j * np.pi * (x[p] + 1))
                z = (low + high) / 2 + (high - low) / 2 * turn
                part = np.linalg.solve(z * np.eye(dim) - v, blocks[i].astype(complex))
                part = (w[p] / 2 * (high - low) / 2 * turn * part).real
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([p]), pa.array([part.ravel()], pa.list_(pa.float64()))],
                                                 ["i", "p", "part"])

    solves = spark.createDataFrame(jobs, "i bigint, p bigint").repartition(min(len(jobs), 64), "i", "p")
    out = [np.zeros_like(b) for b in blocks]
    for r in sorted(solves.mapInArrow(run, "i bigint, p bigint, part array<double>").collect()):
        out[r.i] += np.reshape(r.part, out[r.i].shape)
    return out


def principal(spark: SparkSession, v: np.ndarray, wanted: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues (falling) and their unit eigenvectors (columns).

    Fewer come back if fewer are above zero. A vector's largest entry is positive.
    """
    spans = intervals(v, wanted)
    if not spans:
        return np.zeros(0), np.zeros((len(v), 0))
    g, dim = np.random.default_rng(seed), len(v)
    size = [min(dim, 2 * c + 8) for *_, c in spans]
    blocks = [np.linalg.qr(g.normal(size=(dim, m)))[0] for m in size]
    last, done = [np.inf] * len(spans), [None] * len(spans)
    scale = np.abs(v).sum(1).max()
    for turn in range(60):
        left = [i for i, d in enumerate(done) if d is None]
        if not left:
            break
        made = _projected(spark, v, [spans[i][:2] for i in left], [blocks[i] for i in left])
        for i, y in zip(left, made):
            low, high, count = spans[i]
            q = np.linalg.qr(y)[0]
            q = np.linalg.qr(q)[0]
            theta, u = np.linalg.eigh(q.T @ v @ q)
            vectors = q @ u
            inside = (theta > low) & (theta <= high)
            error = np.linalg.norm(v @ vectors - vectors * theta, axis=0)[inside]
            worst = error.max() / scale if inside.sum() == count else np.inf
            if worst < 1e-12 and worst >= last[i] / 2:
                done[i] = vectors[:, inside]
            last[i], blocks[i] = worst, vectors
            if turn % 10 == 9 and worst == np.inf and size[i] < dim:  # the counts tell that some are missed
                size[i] = min(dim, 2 * size[i])
                blocks[i] = np.linalg.qr(g.normal(size=(dim, size[i])))[0]
    if any(d is None for d in done):
        raise RuntimeError("eigenvalue intervals did not yield as many components as their inertia counts tell")
    q = np.linalg.qr(np.concatenate(done, 1))[0]
    theta, u = np.linalg.eigh(q.T @ v @ q)
    best = np.argsort(-theta, kind="stable")[:wanted]
    vectors = q @ u[:, best]
    lead = vectors[np.abs(vectors).argmax(0), np.arange(len(best))]
    return theta[best], vectors * np.where(lead < 0, -1.0, 1.0)


# ------------------------------------------------------------------ operator
def whiten(vectors: DataFrame, components: int = 32, column: str = "embedding", keep=("vec_id",)) -> DataFrame:
    """``keep``, ``component``, ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error`` by row and component.

    Rows with a null vector, or null or non-finite entries, take no part; nor do
    rows whose vector has another length than most (of equally common lengths the
    longest counts). Null and repeated keys stay, as do repeated rows. Components
    whose eigenvalue is zero, to 1e-12 of the largest, are left out; without rows,
    with one row or with equal rows the result is empty.
    """
    spark, keep = vectors.sparkSession, list(keep)
    rows = usable(vectors.select(*keep, column), column).select(*keep, "_v")
    most = (rows.groupBy(F.size("_v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).limit(1).collect())
    fields = "component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    empty = spark.createDataFrame([], StructType([vectors.schema[k] for k in keep] + list(StructType.fromDDL(fields).fields)))
    if not most or most[0].dim == 0:
        return empty
    dim, n = most[0].dim, most[0]["count"]
    rows = rows.where(F.size("_v") == dim)
    centre = centre_of(rows, n, dim)
    v = covariance(rows, centre)
    e, axes = principal(spark, v, components)
    if not len(e):
        return empty
    trace, onto = float(np.trace(v)), axes / np.sqrt(e)
    white = stored(_whitened(rows, keep, dim, centre, onto), "whitened")
    error = identity_error(white, n, len(e))
    share = F.array(*[F.lit(float(x / trace)) for x in e])
    return (white.select(*keep, "deviation", F.posexplode("white").alias("at", "whitened"))
            .select(*keep, (F.col("at") + 1).alias("component"), F.lit(n).cast("bigint").alias("n"), "deviation", "whitened",
                    F.get(share, F.col("at")).alias("explained"), F.lit(error).alias("identity_error")))


def _whitened(rows: DataFrame, keep: list[str], dim: int, centre: Centre, onto: np.ndarray) -> DataFrame:
    """``deviation`` and ``white`` (array, one entry per component) of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scaled = centre.scaled(_matrix(b, dim))
            centred = scaled.astype(float) / centre.n if scaled.dtype == np.int64 else \
                np.array([[int(c) / centre.n for c in row] for row in scaled], float).reshape(scaled.shape)
            white = centred @ onto
            lists = pa.ListArray.from_arrays(np.arange(len(white) + 1, dtype=np.int32) * onto.shape[1], white.ravel())
            yield pa.RecordBatch.from_arrays([b.column(k) for k in keep] + [centre.deviations(scaled), lists],
                                             [*keep, "deviation", "white"])
    fields = [rows.schema[k] for k in keep] + list(StructType.fromDDL("deviation bigint, white array<double>").fields)
    return rows.mapInArrow(run, StructType(fields))


def identity_error(white: DataFrame, n: int, size: int) -> float:
    """Largest entry of |covariance of ``white`` - identity|, measured on the written rows."""
    pairs = np.triu_indices(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = np.zeros(size), np.zeros(len(pairs[0]))
        for b in batches:
            w = np.asarray(b.column("white").flatten().to_numpy(zero_copy_only=False), float).reshape(b.num_rows, size)
            first, second = first + w.sum(0), second + (w.T @ w)[pairs]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size + len(second)), pa.int64()), pa.array(np.append(first, second))],
                                         ["cell", "s"])

    total = np.zeros(size + len(pairs[0]))
    for r in white.select("white").mapInArrow(run, "cell bigint, s double").groupBy("cell").agg(F.sum("s").alias("s")).collect():
        total[r.cell] = r.s
    mean = total[:size] / n
    entry = total[size:] / n - mean[pairs[0]] * mean[pairs[1]] - (pairs[0] == pairs[1])
    return float(np.abs(entry).max())
