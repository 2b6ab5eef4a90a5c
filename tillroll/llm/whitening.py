"""Embedding whitening by incremental eigendecomposition.

Every task keeps the eigenvalues and eigenvectors of the scatter matrix of the
vectors it has seen and takes in one vector after the other: a centred vector
is a rank-one update, whose eigenvalues are the roots of a secular equation
(Golub 1973); entries of almost no weight and equal eigenvalues are deflated,
and the eigenvectors follow from the roots by the formula of Gu and Eisenstat
(1994). Two spectra are combined in the same way, one eigenpair of the other
after the other, then the difference of the means. Combining goes in rounds of
``FAN_IN`` spectra a group, each round a table in the shared folder, so that no
task and not the driver ever holds more than that many d x d matrices.

The last spectrum is refined by Rayleigh-Ritz: the covariance in its basis is
summed over all vectors again, centred on the exact mean, and its eigenvectors
rotate the basis. The covariance of the whitened vectors is then measured in a
further pass; while it is off the identity by more than ``IDENTITY`` the
refinement is repeated. d x d sums are what the driver gets.

Entries are whole numbers floor(SCALE * c) + SHIFT, and their sums are exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from .shared import in_arrow, named, parallelism, stored, without

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
FAN_IN = 8
IDENTITY = 1e-9  # largest error of the identity after which refinement stops
ROUNDS = 4  # refinements at most
TASK_ROWS = 1000, 100_000  # vectors a task takes in: no more tasks than the session has below the first, always more above the second
RANK = 1e-12  # eigenvalues under this share of the trace count as zero
OUTPUT = ("n", "deviation", "whitened", "explained", "identity_error")
_EPS = np.finfo(float).eps
STATE = "part long, n long, sums array<long>, vals array<double>, vecs array<double>"


# ---------------------------------------------------------- rank-one updates
def secular_roots(d: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + sum z_j^2 / (d_j - x), one above each pole d_j (rising, apart,
    z without zeros). Returns (gaps, roots): gaps[i, j] = d_j - root_i, exact to
    rounding also where a root is close to a pole."""
    m, z2 = len(d), z * z
    upper = np.append(d[1:], d[-1] + z2.sum())
    gap = upper - d
    # the nearer pole is the origin of each root: its sign at the middle tells
    middle = 1 + (z2 / (d[None, :] - (d + gap / 2)[:, None])).sum(1)
    right = middle < 0
    right[-1] = False
    origin = np.where(right, upper, d)
    delta = d[None, :] - origin[:, None]
    rows = np.arange(m)
    lo = np.where(right, -gap / 2, 0.0)
    hi = np.where(right, 0.0, gap / 2)
    if middle[-1] < 0:
        lo[-1] = gap[-1] / 2
    if m and middle[-1] < 0:
        hi[-1] = gap[-1]
    x = (lo + hi) / 2
    below = np.tril(np.ones((m, m), dtype=bool))
    edge = upper - origin  # the pole above, seen from the origin
    todo = np.ones(m, dtype=bool)
    for _ in range(80):
        g = delta - x[:, None]
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            t = z2 / g
            f = 1 + t.sum(1)
            todo &= np.abs(f) > _EPS * 4 * m * (1 + np.abs(t).sum(1))
            if not todo.any():
                break
            lo, hi = np.where(f < 0, x, lo), np.where(f < 0, hi, x)
            t /= g
            psi = np.where(below, t, 0).sum(1)
            df = t.sum(1)
            a1, a2 = g[rows, rows], edge - x
            a = (a1 + a2) * f - a1 * a2 * df
            b = a1 * a2 * f
            c = f - a1 * psi - a2 * (df - psi)
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            new = x + step
        wrong = ~((new > lo) & (new < hi))
        new = np.where(wrong, (lo + hi) / 2, new)
        done = new == x
        x = np.where(todo, new, x)
        todo &= ~done
    return delta - x[:, None], origin + x


def rank_one(d: np.ndarray, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (rising) and eigenvectors of u diag(d) u' + v v'."""
    z = u.T @ v
    size = float(z @ z)
    if not size > 0:
        return d, u
    scale = max(abs(float(d[-1])), size)
    keep = np.flatnonzero(np.abs(z) * np.sqrt(size) > 8 * _EPS * scale)
    if not len(keep):
        return d, u
    u = u.copy()
    close = 8 * _EPS * scale
    if np.any(np.diff(d[keep]) <= close):  # equal eigenvalues: turn z into one of them
        stay, p = [], keep[0]
        for j in keep[1:]:
            if d[j] - d[p] <= close:
                r = np.hypot(z[p], z[j])
                c, s = z[j] / r, z[p] / r
                u[:, p], u[:, j] = c * u[:, p] - s * u[:, j], s * u[:, p] + c * u[:, j]
                z[j], z[p] = r, 0.0
            else:
                stay.append(p)
            p = j
        keep = np.array([*stay, p])
    dk, zk = d[keep], z[keep]
    m = len(keep)
    gaps, roots = secular_roots(dk, zk)
    # weights for which the computed roots are exact, so that vectors are orthogonal
    i, j = np.indices((m, m))
    below = np.where(i < j, dk[:, None], np.append(dk[1:], 0)[:, None]) - dk[None, :]
    below[-1] = 1.0
    weight = np.sqrt(np.abs(np.prod(gaps / below, axis=0)))
    q = (np.copysign(weight, zk)[None, :] / gaps).T
    q /= np.sqrt((q * q).sum(0))
    u[:, keep] = u[:, keep] @ q
    d = d.copy()
    d[keep] = roots
    order = np.argsort(d, kind="stable")
    return d[order], u[:, order]


class Spectrum:
    """Count, exact sums and scatter eigenpairs of whole-number vectors."""

    def __init__(self, width: int):
        self.n, self.sums = 0, [0] * width
        self.vals, self.vecs = np.zeros(width), np.eye(width)

    def mean(self) -> np.ndarray:
        """The mean less SHIFT, from the exact sums."""
        return np.array([(s - SHIFT * self.n) / self.n for s in self.sums])

    def add(self, rows: np.ndarray) -> None:
        """Takes in rows (int64) one after the other."""
        shifted = (rows - SHIFT).astype(float)
        mean = self.mean() if self.n else np.zeros(rows.shape[1])
        for x in shifted:
            off = x - mean
            if self.n:
                self.vals, self.vecs = rank_one(self.vals, self.vecs, off * np.sqrt(self.n / (self.n + 1)))
            self.n += 1
            mean = mean + off / self.n
        self.sums = [a + int(b) for a, b in zip(self.sums, rows.sum(0), strict=True)]

    def combine(self, other: Spectrum) -> None:
        if not other.n:
            return
        if self.n:
            off = (other.mean() - self.mean()) * np.sqrt(self.n / (self.n + other.n) * other.n)
            for k in range(len(other.vals)):
                if other.vals[k] > 0:
                    self.vals, self.vecs = rank_one(self.vals, self.vecs, other.vecs[:, k] * np.sqrt(other.vals[k]))
            self.vals, self.vecs = rank_one(self.vals, self.vecs, off)
        else:
            self.vals, self.vecs = other.vals, other.vecs
        self.n += other.n
        self.sums = [a + b for a, b in zip(self.sums, other.sums, strict=True)]

    def row(self, part: int) -> dict:
        return {"part": part, "n": self.n, "sums": self.sums, "vals": self.vals.tolist(), "vecs": self.vecs.ravel().tolist()}

    @classmethod
    def of(cls, row: dict) -> Spectrum:
        s = cls(len(row["sums"]))
        s.n, s.sums, s.vals = row["n"], list(row["sums"]), np.array(row["vals"])
        s.vecs = np.array(row["vecs"]).reshape(len(s.vals), -1)
        return s


# ------------------------------------------------------------- Spark stages
def _matrix(column) -> np.ndarray:
    """An Arrow list<int64> column of equal lengths as rows of a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0), dtype=np.int64)


_STATE_ARROW = pa.schema([("part", pa.int64()), ("n", pa.int64()), ("sums", pa.list_(pa.int64())), ("vals", pa.list_(pa.float64())), ("vecs", pa.list_(pa.float64()))])


def _take_in(width: int):
    def run(batches):
        from pyspark import TaskContext
        state = Spectrum(width)
        for b in batches:
            if b.num_rows:
                state.add(_matrix(b.column(0)))
        if state.n:
            yield pa.RecordBatch.from_pylist([state.row(TaskContext.get().partitionId())], schema=_STATE_ARROW)
    return run


def _combined(_key, table):
    """Combines a group's spectra, in the order of their parts."""
    rows = sorted(table.to_pylist(), key=lambda r: r["part"])
    state = Spectrum.of(rows[0])
    for r in rows[1:]:
        state.combine(Spectrum.of(r))
    return pa.Table.from_pylist([state.row(rows[0]["part"] // FAN_IN)], schema=_STATE_ARROW)


def spectrum(fit: DataFrame, width: int) -> Spectrum:
    """The spectrum of a table with one column of whole-number vectors.

    A vector costs far more time than its bytes tell, so tasks are cut by rows:
    the vectors, which are distinct, are dealt by hash."""
    rows, (least, most) = fit.count(), TASK_ROWS
    tasks = max(1, -(-rows // most), min(parallelism(fit.sparkSession), -(-rows // least)))
    dealt = fit.repartition(tasks, *fit.columns)
    states = stored(dealt.mapInArrow(_take_in(width), STATE), "whitening-spectra")
    while True:
        last = states.agg(F.max("part")).first()[0]
        if last is None:
            return Spectrum(width)
        if last == 0:
            return Spectrum.of(states.first().asDict())
        grouped = states.groupBy(F.floor(F.col("part") / FAN_IN).alias("grp"))
        states = stored(grouped.applyInArrow(_combined, STATE), "whitening-spectra")


def projected_covariance(fit: DataFrame, n: int, mean: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Covariance (divisor n) of the vectors' projections on the basis' columns,
    summed by task and then by Spark."""
    m = basis.shape[1]

    def run(batches):
        total = np.zeros((m, m))
        for b in batches:
            if b.num_rows:
                p = ((_matrix(b.column(0)) - SHIFT).astype(float) - mean) @ basis
                total += p.T @ p
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(m * m)), pa.array(total.ravel())], names=["k", "x"])

    sums = fit.mapInArrow(run, "k long, x double").groupBy("k").agg(F.sum("x").alias("x")).collect()
    out = np.zeros(m * m)
    for r in sums:
        out[r["k"]] = r["x"]
    return out.reshape(m, m) / n


def refined(fit: DataFrame, state: Spectrum, components: int):
    """(basis, eigenvalues, trace, identity error) after Rayleigh-Ritz rounds.
    Eigenvalues fall; those under RANK of the trace are left out."""
    n, mean = state.n, state.mean()
    basis = state.vecs[:, ::-1]
    for _ in range(ROUNDS):
        basis, _r = np.linalg.qr(basis)
        inner = projected_covariance(fit, n, mean, basis)
        vals, turn = np.linalg.eigh((inner + inner.T) / 2)
        vals, basis = vals[::-1], basis @ turn[:, ::-1]
        trace = float(vals.sum())
        k = min(components, int((vals > RANK * trace).sum())) if trace > 0 else 0
        if not k:
            return basis[:, :0], vals[:0], trace, 0.0
        whitened = projected_covariance(fit, n, mean, basis[:, :k] / np.sqrt(vals[:k]))
        error = float(np.abs(whitened - np.eye(k)).max())
        if error <= IDENTITY:
            break
    return basis[:, :k], vals[:k], trace, error


def whole_numbers(vector: Column) -> Column:
    """floor(SCALE * c) + SHIFT of each entry; a value beyond a long is an error."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE).cast("long") + F.lit(SHIFT).cast("long"))


def usable(vector: Column) -> Column:
    """True for vectors without null, infinite or undefined entries."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad


def whiten(embeddings: DataFrame, vector: str = "embedding", columns: list[str] | None = None, components: int = COMPONENTS) -> DataFrame:
    """The rows of ``embeddings`` with their vectors whitened.

    Rows are returned as often as they occur, with the columns ``columns`` (all,
    if not given; those called like the results are replaced) and: n, the number
    of distinct whole-number vectors, over which mean and covariance are taken;
    deviation, the exact sum over dimensions of (n * x - sum)^2; whitened, the
    coordinates x - mean on each component over the root of its eigenvalue, by
    falling eigenvalue; explained, eigenvalues over their total; identity_error,
    the largest difference of whitened's measured covariance from the identity.

    Rows go whose vector is null or empty, or holds a null, infinite or undefined
    entry. The dimension is the commonest length (of several the largest); rows
    of other lengths go. Components of no variance are left out, so ``whitened``
    is shorter where the vectors span fewer dimensions, and empty where they are
    all equal. An empty table gives an empty result. A deviation beyond a long
    is an error. Equal vectors count once, combined before they are shuffled.
    """
    spark = embeddings.sparkSession
    kept = [c for c in without(embeddings, list(OUTPUT)).columns if columns is None or c in columns]
    v = named(vector)
    rows = embeddings.filter(usable(v)).select(*map(named, kept), v.alias("_vector")).toDF(*[f"k{i}" for i in range(len(kept))], "v")
    widths = rows.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).limit(1).collect()
    width = widths[0]["width"] if widths else 0
    rows = rows.filter(F.size("v") == width).withColumn("v", whole_numbers(F.col("v")))
    fit = stored(rows.select("v").distinct(), "whitening-fit")
    state = spectrum(fit, width)
    extra = [T.StructField("n", T.LongType()), T.StructField("deviation", T.LongType()), T.StructField("whitened", T.ArrayType(T.DoubleType())),
             T.StructField("explained", T.ArrayType(T.DoubleType())), T.StructField("identity_error", T.DoubleType())]
    given = [T.StructField(c, rows.schema[i].dataType) for i, c in enumerate(kept)]
    if not state.n:
        return spark.createDataFrame([], T.StructType(given + extra))
    basis, vals, trace, error = refined(fit, state, components)
    n, sums, mean = state.n, np.array(state.sums, dtype=np.int64), state.mean()
    scaled, share = basis / np.sqrt(vals), (vals / trace).tolist() if trace > 0 else []

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column(b.num_columns - 1))
            off = n * x - sums
            if ((off.astype(float) ** 2).sum(1) > 9.2e18).any():
                raise OverflowError("a deviation is beyond a long")
            w = ((x - SHIFT).astype(float) - mean) @ scaled
            k = w.shape[1]
            lists = lambda flat: pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * k), pa.array(flat))
            out = [pa.array(np.full(b.num_rows, n)), pa.array((off * off).sum(1)), lists(w.ravel()), lists(np.tile(np.array(share, dtype=float), b.num_rows)),
                   pa.array(np.full(b.num_rows, error))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *out], names=[f"o{i}" for i in range(b.num_columns + 4)])

    schema = T.StructType([T.StructField(f"o{i}", f.dataType) for i, f in enumerate(given + extra)])
    return in_arrow(rows, run, schema).toDF(*kept, *OUTPUT)
