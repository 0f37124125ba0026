"""Whitening of embeddings by QDWH spectral divide-and-conquer (operator 11).

Entries become integers ``x = floor(64 * c) + 1000000``.  The fit list holds every distinct integer vector once.

1. The fit list is a grouped table: copies meet in partial aggregates, whatever their number.
2. Sums are exact (task sums in integers, totals as decimals).  The covariance adds centred products per task; only the
   upper triangle of a matrix leaves a task, and the tasks' matrices are added by a shuffle on their cells.
3. The covariance (dimension squared: bounded by ``MAX_DIM``) is split on the driver.  ``polar`` is the QDWH iteration:
   dynamically weighted Halley steps, by QR while badly conditioned and by Cholesky afterwards.  The polar factor U of V - s I gives
   the spectral projector (U + I) / 2 onto the eigenvalues above the shift s.  Orthonormal bases of its range and of the
   rest split V into two smaller matrices, which are split again, down to single components.
4. A matrix of dimension x ``COMPONENTS`` travels to the tasks, which whiten every row.  The whitened fit list's own
   covariance is measured in another pass.

Defined cases: rows whose vector is null or holds a null, NaN or infinite entry are dropped (as the contract has it), so
are empty vectors; of several lengths the most common in the fit list is kept (the longest of ties), as others cannot
be compared with it; ``64 * c`` saturates at +-2^40, a deviation beyond a long at its largest value; a component whose
variance is zero up to rounding has a null ``whitened`` and takes no part in ``identity_error``; ``explained`` is 0 where there
is no variance at all; repeated rows, repeated and null ids return a row each; an empty table returns no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import saved, small_batches

SCALE = 64
SHIFT = 1_000_000
COMPONENTS = 16
#: Largest dimension: the covariance is held by the driver and by every task.
MAX_DIM = 1024
LIMIT = 2 ** 40
LONG_MAX = 2 ** 63 - 1
EPS = float(np.finfo(np.float64).eps)
RESULT = ("vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")


def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix by the QDWH iteration (singular values from eps up in six steps)."""
    size = np.linalg.norm(a)
    x, eye, low = a / size, np.eye(len(a)), EPS
    for _ in range(30):
        d = np.cbrt(4 * (1 - low ** 2) / low ** 4) if low < 1 else 0.0
        root = np.sqrt(1 + d)
        wa = root + 0.5 * np.sqrt(max(0.0, 8 - 4 * d + 8 * (2 - low ** 2) / (low ** 2 * root)))
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        if wc > 100:
            q, _ = np.linalg.qr(np.concatenate([np.sqrt(wc) * x, eye]))
            new = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * (q[:len(a)] @ q[len(a):].T)
        else:
            lower = np.linalg.cholesky(eye + wc * (x.T @ x))
            new = wb / wc * x + (wa - wb / wc) * np.linalg.solve(lower.T, np.linalg.solve(lower, x.T)).T
        new = (new + new.T) / 2
        moved, x = np.linalg.norm(new - x), new
        low = min(1.0, low * (wa + wb * low ** 2) / (1 + wc * low ** 2))
        if abs(1 - low) < 10 * EPS and moved < 1e-9:
            break
    return x


def _halves(a: np.ndarray, scale: float, draw: np.random.Generator) -> tuple[np.ndarray, int] | None:
    """An orthonormal basis whose first columns span the eigenvalues above a shift, and their number; None: all are equal."""
    m, eye = len(a), np.eye(len(a))
    mean = float(np.trace(a)) / m
    spread = float(np.linalg.norm(a - mean * eye))
    if spread <= 4 * EPS * m * scale:
        return None
    best = None
    # eigenvalues lie on both sides of their mean; a shift that meets one of them is moved
    for shift in (float(np.median(np.diag(a))), mean, *(mean + f * spread / m for f in (0.21, -0.23, 0.05, -0.07, 0.011, -0.013))):
        p = (polar(a - shift * eye) + eye) / 2
        k = int(round(float(np.trace(p))))
        if not 0 < k < m:
            continue
        start = draw.standard_normal((m, m))
        for _ in range(3):
            q, _ = np.linalg.qr(np.concatenate([p @ start[:, :k], start[:, k:] - p @ start[:, k:]], 1))
            start = q
        rest = float(np.linalg.norm(q[:, k:].T @ a @ q[:, :k]))
        if best is None or rest < best[0]:
            best = (rest, q, k)
        if rest <= 8 * EPS * m * scale:
            break
    return None if best is None else best[1:]


def spectral(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors of a symmetric matrix by spectral divide-and-conquer."""
    a = (a + a.T) / 2
    scale, draw = float(np.linalg.norm(a)), np.random.default_rng(7)
    values, vectors = [], []
    open_parts = [(a, np.eye(len(a)))]
    while open_parts:
        part, basis = open_parts.pop()
        split = _halves(part, scale, draw) if len(part) > 1 and scale else None
        if split is None:
            values.append(np.diag(part))
            vectors.append(basis)
            continue
        q, k = split
        for own in (q[:, :k], q[:, k:]):
            smaller = own.T @ part @ own
            open_parts.append(((smaller + smaller.T) / 2, basis @ own))
    v = np.concatenate(vectors, 1)
    for _ in range(2):  # what is left between components, to first order (gaps above rounding), then to length one again
        inner, gram = v.T @ a @ v, v.T @ v
        e = np.diag(inner) / np.diag(gram)
        gap = e[None, :] - e[:, None]
        far = np.abs(gap) > 1e3 * EPS * len(a) * scale
        fix = np.where(far, (inner - gram * e[None, :]) / np.where(far, gap, 1), -gram / 2)
        np.fill_diagonal(fix, (1 - np.diag(gram)) / 2)
        v = v + v @ fix
        for _ in range(2):
            v = v @ (1.5 * np.eye(len(a)) - 0.5 * (v.T @ v))
    e = np.einsum("ij,ij->j", v, a @ v)
    order = np.argsort(-e, kind="stable")
    return e[order], v[:, order]


@dataclass
class Whitener:
    """n and exact sums S of the fit list, the components with their variances, what they explain, and the measured error."""

    n: int
    sums: list[int]
    vectors: np.ndarray  # dimension x components
    variances: np.ndarray
    explained: np.ndarray
    error: float = 0.0

    def __post_init__(self):
        near = [(2 * s + self.n) // (2 * self.n) for s in self.sums]
        self.near = np.array(near, np.int64)  # whole part and rest of the mean: no digits are lost by centring
        self.rest = np.array([(s - self.n * m) / self.n for s, m in zip(self.sums, near, strict=True)])
        self.lost = [s - self.n * m for s, m in zip(self.sums, near, strict=True)]

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.near).astype(np.float64) - self.rest

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """Sum of (n x - S)^2, exact; beyond a long its largest value."""
        off = x - self.near
        far = self.n * float(np.abs(off).max(initial=0)) + max(map(abs, self.lost), default=0)
        if far * far * x.shape[1] < 2 ** 62:
            return ((self.n * off - np.array(self.lost, np.int64)) ** 2).sum(1)
        return np.array([min(LONG_MAX, sum((self.n * o - r) ** 2 for o, r in zip(row, self.lost, strict=True)))
                         for row in off.tolist()], np.int64)

    def whiten(self, x: np.ndarray) -> np.ndarray:
        """Rows x components; NaN for components without variance."""
        scale = np.where(self.variances > 0, np.sqrt(np.where(self.variances > 0, self.variances, 1)), np.nan)
        return self.centred(x) @ (self.vectors / scale)


def integers(column: str = "embedding") -> Column:
    entry = lambda c: F.floor(F.least(F.greatest(c.cast("double") * SCALE, F.lit(-float(LIMIT))), F.lit(float(LIMIT)))) + SHIFT
    return F.transform(F.col(column), entry)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and x of the rows that take part."""
    fit = F.forall("embedding", lambda c: c.isNotNull() & (F.abs(c.cast("double")) < float("inf")))
    return small_batches(vectors).filter(F.col("embedding").isNotNull() & (F.size("embedding") > 0)).filter(fit).select(
        F.col("vec_id").cast("long").alias("vec_id"), integers().alias("x"))


def _matrix(b: pa.RecordBatch, d: int) -> np.ndarray:
    return b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _added(fit: DataFrame, d: int, part: Callable[[np.ndarray], np.ndarray], width: int) -> np.ndarray:
    """Sum over the fit list of ``part`` (a flat array of ``width`` for a block of rows): added per task, then by cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                own = part(_matrix(b, d))
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(total)], names=["cell", "value"])

    cells = fit.mapInArrow(run, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(width)  # width is bounded by the dimension alone
    for c in cells:
        out[c["cell"]] = c["value"]
    return out


def _sums(fit: DataFrame, d: int) -> list[int]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * d
        for b in batches:
            total = [a + c for a, c in zip(total, _matrix(b, d).sum(0).tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d)), pa.array([Decimal(t) for t in total], pa.decimal128(38, 0))],
                                         names=["cell", "value"])

    cells = fit.mapInArrow(run, "cell long, value decimal(38,0)").groupBy("cell").agg(F.sum("value").alias("value")).collect()
    return [int(c["value"]) for c in sorted(cells, key=lambda c: c["cell"])]


def fit_whitener(x_rows: DataFrame, components: int = COMPONENTS) -> Whitener | None:
    """Fit on the distinct x vectors of the most common length; None without any."""
    distinct = saved(x_rows.select("x").distinct(), "fit-list")
    lengths = distinct.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if lengths is None:
        return None
    d, n = int(lengths["d"]), int(lengths["n"])
    if d > MAX_DIM:
        raise ValueError(f"vectors of {d} entries; the covariance is bounded to {MAX_DIM}")
    fit = distinct.filter(F.size("x") == d)
    k = min(components, d)
    model = Whitener(n, _sums(fit, d), np.zeros((d, k)), np.zeros(k), np.zeros(k))
    upper = np.triu_indices(d)
    centred = model.centred
    flat = _added(fit, d, lambda x: (lambda c: (c.T @ c)[upper])(centred(x)), len(upper[0])) / n
    covariance = np.zeros((d, d))
    covariance[upper] = flat
    covariance = covariance + covariance.T - np.diag(np.diag(covariance))
    e, v = spectral(covariance)
    trace = float(np.trace(covariance))
    real = e[:k] > d * EPS * max(e[0], 0.0) * 8
    model.vectors, model.variances = v[:, :k], np.where(real, e[:k], 0.0)
    model.explained = np.where(real, e[:k], 0.0) / trace if trace > 0 else np.zeros(k)
    kept = np.flatnonzero(real)
    if len(kept):
        w = len(kept)
        moments = _added(fit, d, lambda x: (lambda y: np.r_[y.sum(0), (y.T @ y).ravel()])(model.whiten(x)[:, kept]), w + w * w) / n
        own = moments[w:].reshape(w, w) - np.outer(moments[:w], moments[:w])
        model.error = float(np.abs(own - np.eye(w)).max())
    return model


def whiten_vectors(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of every remaining row and component."""
    rows = usable(vectors)
    model = fit_whitener(rows, components)
    if model is None:
        return vectors.sparkSession.createDataFrame([], RESULT)
    d, k = model.vectors.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b, d)
            white, m = model.whiten(x).ravel(), len(x)
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id").take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                 pa.array(np.full(m * k, model.n)), pa.array(np.repeat(model.deviations(x), k)),
                 pa.array(white, mask=np.isnan(white)), pa.array(np.tile(model.explained, m)), pa.array(np.full(m * k, model.error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.filter(F.size("x") == d).mapInArrow(run, RESULT)
