"""Embedding whitening: principal components by FEAST contour integration, on exact integer statistics.

Vectors are quantised to whole numbers, so counts, sums and products are exact whatever the order of tasks. The
covariance, whose size depends on the dimension alone, is then searched by intervals: inertia counts of shifted
covariances say how many eigenvalues an interval holds, the quadrature of complex shifted solves along a circle around
it projects a start block onto their space, Rayleigh-Ritz extracts the pairs, and the counts verify that none is missed.
"""

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from steadyline.sources.staging import staged

LIMB = 10**30  # products are summed as two whole numbers, so a sum has room far beyond 38 digits
EXACT = 1 << 53  # up to here sums of doubles that are whole numbers are exact
LEAST, MOST = -(1 << 63), (1 << 63) - 1
ENTRIES = 1 << 20


class Settings(NamedTuple):
    scale: float = 256.0
    components: int = 4
    points: int = 8  # quadrature points on the upper half of a circle; the lower half is its mirror image
    crowd: int = 6  # an interval of more eigenvalues than this is cut, unless it is too narrow
    tolerance: float = 1e-14  # of the residual of a pair, against the norm of the covariance
    rounds: int = 40


# ---- whole-number vectors ---------------------------------------------------------------------------

WIDTHS = (np.int8, np.int16, np.int32, np.int64)


def _column(table: DataFrame, embedding: str):
    """The embedding as an array of floats or doubles."""
    plain = table.schema[embedding].dataType.simpleString() in ("array<float>", "array<double>")
    return F.col(f"`{embedding}`") if plain else F.col(f"`{embedding}`").cast("array<double>")


def _parts(batch: pa.RecordBatch, entries: int):
    """Runs of rows that make up about ``ENTRIES`` matrix entries of ``entries`` each."""
    step = max(1, ENTRIES // max(1, entries))
    for i in range(0, batch.num_rows, step):
        yield batch.slice(i, step)


def whole(lists: pa.Array, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """(rows that stay, their floor(scale * entry) as a bigint matrix padded with zeros); values saturate at bigint's ends."""
    counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(lists)), counts)
    value = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    stays = lists.is_valid().to_numpy(zero_copy_only=False).copy()
    stays[row[~np.isfinite(value)]] = False
    with np.errstate(over="ignore"):
        scaled = np.floor(value * scale)
    # the largest double below 2**63 is no bigint's end, so both ends are set by comparison
    inside = np.where(np.abs(scaled) < 2.0**63, scaled, 0).astype(np.int64)
    inside[scaled >= 2.0**63], inside[scaled <= -(2.0**63)] = MOST, LEAST
    out = np.zeros((len(lists), int(counts.max(initial=0))), np.int64)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)] = np.where(stays[row], inside, 0)
    at = np.flatnonzero(stays)
    return at, out[at]


def packed(x: np.ndarray) -> list[bytes]:
    """One value for each vector: the bytes of an entry, then the entries without the zeros at the end."""
    if not x.shape[1]:
        return [b"\x00"] * len(x)
    used = (x != 0)[:, ::-1]
    length = np.where(used.any(1), x.shape[1] - used.argmax(1), 0)
    low, high = x.min(1), x.max(1)
    width = sum(((low < np.iinfo(t).min) | (high > np.iinfo(t).max)).astype(int) for t in WIDTHS[:3])
    out = [b""] * len(x)
    for w, kind in enumerate(WIDTHS):
        at = np.flatnonzero(width == w)
        data, size = x[at].astype(kind).tobytes(), x.shape[1] << w
        for k, (i, n) in enumerate(zip(at.tolist(), length[at].tolist())):
            out[i] = bytes([w]) + data[k * size : k * size + (n << w)]
    return out


def unpacked(keys: pa.Array, size: int) -> np.ndarray:
    out = np.zeros((len(keys), size), np.int64)
    for i, key in enumerate(keys.to_pylist()):
        value = np.frombuffer(key, WIDTHS[key[0]], offset=1)
        out[i, : len(value)] = value
    return out


def _gram(c: np.ndarray) -> np.ndarray:
    """Exact c^T c: by doubles while all sums stay below 2**53, else by Python's whole numbers."""
    most = max(abs(int(c.min(initial=0))), abs(int(c.max(initial=0)))) if c.dtype != object else 1 << 63
    if most < 1 << 26:
        most = max(1, most)
        step = max(1, EXACT // (most * most))
        out = np.zeros((c.shape[1], c.shape[1]), object)
        for i in range(0, len(c), step):
            part = c[i : i + step].astype(np.float64)
            out = out + (part.T @ part).astype(np.int64)
        return out
    big = c.astype(object)
    return big.T @ big


class Statistics(NamedTuple):
    n: int  # distinct vectors
    sums: list[int]  # of each dimension, exact
    covariance: np.ndarray  # rounded once, from exact whole numbers


def fit_list(table: DataFrame, embedding: str, scale: float) -> DataFrame:
    """(x): each distinct vector that stays, packed, once; as a table. Copies meet before the shuffle."""

    def run(batches):
        for batch in batches:
            for part in _parts(batch, 64):
                yield pa.RecordBatch.from_arrays([pa.array(packed(whole(part.column(0), scale)[1]), pa.binary())], names=["x"])

    return staged(table.select(_column(table, embedding).alias("e")).mapInArrow(run, "x binary").distinct(), "fit_list")


def statistics(fit: DataFrame) -> Statistics:
    """Count, sums and covariance of a fit list, from two passes: sums first, then products of what is left after centring.

    A task sends one row for each entry, so what is shuffled depends on dimension and tasks, not on vectors.
    """
    entries = (F.length("x") - 1) / F.pow(F.lit(2), F.conv(F.hex(F.substring("x", 1, 1)), 16, 10).cast("int"))
    first = fit.agg(F.count("*").alias("n"), F.max(entries.cast("int")).alias("size")).first()
    n, size = first["n"], first["size"] or 0
    if not n or not size:
        return Statistics(n, [], np.zeros((0, 0)))

    def summed(compute):
        def run(batches):
            total = 0
            for batch in batches:
                for part in _parts(batch, size):
                    total = total + compute(unpacked(part.column(0), size))
            if not isinstance(total, int):
                limbs = [divmod(int(v), LIMB) for v in total.ravel()]
                at = np.indices(total.shape).reshape(total.ndim, -1)
                high, low = (pa.array([limb[k] for limb in limbs], pa.decimal128(38, 0)) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(at[0], pa.int32()), pa.array(at[-1], pa.int32()), high, low], names=["i", "j", "high", "low"])

        parts = fit.mapInArrow(run, "i int, j int, high decimal(38,0), low decimal(38,0)")
        # size or size * size rows
        rows = parts.groupBy("i", "j").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect()
        return [(r["i"], r["j"], int(r["high"]) * LIMB + int(r["low"])) for r in rows]

    sums = [0] * size
    for i, _, value in summed(lambda x: (x if _reach(x) * len(x) < MOST else x.astype(object)).sum(0).astype(object)):
        sums[i] = value
    near = [s // n for s in sums]  # centred by the whole part of the mean; what is left, below one, is taken off exactly
    rest = [s - n * q for s, q in zip(sums, near)]
    covariance = np.zeros((size, size))
    for i, j, value in summed(lambda x: _gram(_centred(x, near))):
        covariance[i, j] = (n * value - rest[i] * rest[j]) / (n * n)  # whole numbers: the division rounds once
    return Statistics(n, sums, covariance)


def _reach(x: np.ndarray) -> float:
    return float(np.abs(x.astype(np.float64)).max(initial=0))


def _centred(x: np.ndarray, near: list[int]) -> np.ndarray:
    """x - near, in bigint where that holds it, else in Python's whole numbers."""
    if _reach(x) + max(map(abs, near), default=0) < MOST / 2:
        return x - np.array(near, np.int64)
    return x.astype(object) - np.array(near, object)


# ---- eigenpairs by contour integration ----------------------------------------------------------------


def below(v: np.ndarray, shift: float) -> int:
    """How many eigenvalues of ``v`` lie below ``shift``: negative pivots of v - shift, with full diagonal pivoting.

    One-by-one pivots where the largest diagonal entry is large enough, else two-by-two ones (one of each sign).
    """
    a = v - shift * np.eye(len(v))
    negative, alpha = 0, (1 + 17**0.5) / 8
    while len(a):
        d = np.abs(np.diag(a))
        k = int(d.argmax())
        off = np.abs(a - np.diag(np.diag(a)))
        largest = off.max(initial=0)
        if d[k] >= alpha * largest:
            if d[k] == 0:
                break  # nothing left: these eigenvalues equal the shift
            pivot, keep = a[k, k], np.delete(np.arange(len(a)), k)
            negative += pivot < 0
            a = a[np.ix_(keep, keep)] - np.outer(a[keep, k], a[k, keep]) / pivot
        else:
            p, q = np.unravel_index(off.argmax(), off.shape)
            keep = np.delete(np.arange(len(a)), [p, q])
            block, side = a[np.ix_([p, q], [p, q])], a[np.ix_(keep, [p, q])]
            negative += 1
            a = a[np.ix_(keep, keep)] - side @ np.linalg.solve(block, side.T)
        a = (a + a.T) / 2
    return int(negative)


class Interval(NamedTuple):
    low: float
    high: float
    count: int  # eigenvalues in [low, high)


def top_intervals(v: np.ndarray, wanted: int, s: Settings) -> list[Interval]:
    """Intervals from the top down that together hold the ``wanted`` largest eigenvalues, each a small number of them."""
    high = float(np.abs(v).sum(1).max()) * (1 + 1e-6)
    low = -high * 1e-3
    todo, found, have = [Interval(low, high, below(v, high) - below(v, low))], [], 0
    while todo and have < wanted:
        at = todo.pop()
        if at.count == 0:
            continue
        if at.count <= s.crowd or at.high - at.low <= 1e-10 * high:
            found.append(at)
            have += at.count
            continue
        middle = (at.low + at.high) / 2
        under, left = below(v, middle), below(v, at.low)
        todo += [Interval(at.low, middle, under - left), Interval(middle, at.high, at.count - under + left)]
    return found


def pairs_of(v: np.ndarray, at: Interval, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues in the interval and their unit eigenvectors, as many as the inertia count says."""
    size = len(v)
    norm = float(np.abs(v).sum(1).max())
    # the circle reaches a little beyond the interval, so that values on its ends are caught as well as inner ones
    centre, radius = (at.low + at.high) / 2, max((at.high - at.low) / 2 * 1.05, 1e-9 * norm)
    node, weight = np.polynomial.legendre.leggauss(s.points)
    angle = np.pi / 2 * (1 - node)
    block = min(size, max(2 * at.count, at.count + 4))
    start = np.random.default_rng(size).standard_normal((size, block))
    best = None
    for _ in range(s.rounds):
        projected = np.zeros((size, block))
        for t, w in zip(angle, weight):
            turn = radius * np.exp(1j * t)
            projected += w / 2 * np.real(turn * np.linalg.solve((centre + turn) * np.eye(size) - v, start.astype(complex)))
        basis, _ = np.linalg.qr(projected)
        e, u = np.linalg.eigh(basis.T @ v @ basis)
        x = basis @ u
        inside = (e >= at.low) & (e < at.high)
        # of more or fewer than counted, those nearest to the interval's middle
        nearest = np.sort(np.argsort(np.abs(e - centre), kind="stable")[: at.count])
        residual = np.abs(v @ x[:, nearest] - x[:, nearest] * e[nearest]).max(initial=0) / max(norm, np.finfo(float).tiny)
        if best is None or residual < best[0]:
            best = residual, e[nearest], x[:, nearest], int(inside.sum())
        elif residual > best[0] / 2 and best[0] <= 100 * size * s.tolerance:
            break  # rounding: no more to gain
        if residual <= s.tolerance:
            break
        start = x
    residual, e, x, inside = best
    if residual > 1e-9 or (inside != at.count and at.high - at.low > 1e-8 * norm):
        raise ArithmeticError(f"{inside} eigenpairs found where inertia counts {at.count}, residual {residual:.1e}")
    return e, x


def components(spark: SparkSession, v: np.ndarray, s: Settings = Settings()) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and their eigenvectors as columns: ``s.components`` of them at most.

    Directions without variance (up to rounding) are no components. Intervals are searched side by side as Spark
    tasks; the covariance is broadcast, its size depends on the dimension alone.
    """
    if not len(v) or not np.trace(v) > 0:
        return np.zeros(0), np.zeros((len(v), 0))
    unit = v / float(np.abs(v).max())
    wanted = min(s.components, len(v))
    intervals = top_intervals(unit, wanted, s)
    held = spark.sparkContext.broadcast(unit)

    def search(batches):
        for batch in batches:
            for r in batch.to_pylist():
                e, x = pairs_of(held.value, Interval(**r), s)
                yield pa.RecordBatch.from_arrays([pa.array(e), pa.array([c.tobytes() for c in x.T.astype(float)], pa.binary())], names=["e", "vector"])

    rows = spark.createDataFrame([(float(a), float(b), c) for a, b, c in intervals], "low double, high double, count int").repartition(len(intervals))
    found = rows.mapInArrow(search, "e double, vector binary").orderBy(F.desc("e")).collect()  # a few rows of the dimension's size
    held.unpersist()
    basis, _ = np.linalg.qr(np.stack([np.frombuffer(r["vector"]) for r in found], axis=1))
    e, u = np.linalg.eigh(basis.T @ unit @ basis)  # one more extraction over all intervals, so that they are orthogonal together
    order = np.argsort(-e, kind="stable")[:wanted]
    order = order[e[order] > len(v) * np.finfo(float).eps * max(e.max(), 0)]
    return e[order] * np.abs(v).max(), basis @ u[:, order]


# ---- whitening ------------------------------------------------------------------------------------------


def whitened(table: DataFrame, s: Settings = Settings(), embedding: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error: for each row and component.

    Rows whose vector is null or holds null or non-finite entries are left out. Entries become floor(scale * c),
    saturated at the ends of bigint. Vectors of unequal length count as padded with zeros; an empty one is zero.
    Repeated rows and rows with a null id come out as often as they stand there; equal vectors count once in the fit.
    Components without variance don't exist: fewer come out, and none (no rows) of an empty table or of equal vectors.
    Equal eigenvalues leave their components' basis open. Where the exact deviation is beyond bigint, ``deviation`` is null; ``deviation_exact``
    holds it as text. Other columns are not looked at.
    """
    spark = table.sparkSession
    fit = fit_list(table, embedding, s.scale)
    n, sums, covariance = found = statistics(fit)
    e, p = components(spark, covariance, s)
    size, k = len(sums), len(e)
    near, rest = [t // n for t in sums], np.array([(t % n) / n for t in sums])
    # its size depends on dimension and components only
    held = spark.sparkContext.broadcast((p / np.sqrt(e), found))

    def projected(x):
        return (_centred(x, near).astype(np.float64) - rest) @ held.value[0]

    def moments(batches):
        total, products = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            for part in _parts(batch, size):
                w = projected(unpacked(part.column(0), size))
                total, products = total + w.sum(0), products + w.T @ w
        at = [(i, j, products[i, j]) for i in range(k) for j in range(k)] + [(i, -1, total[i]) for i in range(k)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*at), (pa.int32(), pa.int32(), pa.float64()))], names=["i", "j", "v"])

    error = 0.0
    if k:
        rows = fit.mapInArrow(moments, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()  # k * (k + 1) rows
        got = {(r["i"], r["j"]): r["v"] / n for r in rows}
        error = max(abs(got[i, j] - got[i, -1] * got[j, -1] - (i == j)) for i in range(k) for j in range(k))
    explained = e / np.trace(covariance)

    def deviations(x):
        sums = held.value[1].sums
        most = int(_reach(x)) * n + max(map(abs, sums), default=0) + 1
        exact = size * most * most < MOST
        d = n * x - np.array(sums, np.int64) if exact else n * x.astype(object) - np.array(sums, object)
        return (d * d).sum(1).tolist()

    def run(batches):
        for batch in batches:
            for part in _parts(batch, max(size, 64)):
                at, x = whole(part.column(1), s.scale)
                if not k or not len(at):
                    continue
                x = np.pad(x[:, :size], ((0, 0), (0, max(0, size - x.shape[1]))))
                away = [d for d in deviations(x) for _ in range(k)]
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(pa.array(np.repeat(at, k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(x) * k, n)), pa.array([d if d <= MOST else None for d in away], pa.int64()),
                    pa.array(projected(x).ravel()), pa.array(np.tile(explained, len(x))), pa.array(np.full(len(x) * k, error)),
                    pa.array([str(d) for d in away]),
                ], names=list(made))

    made = {
        "vec_id": table.schema[vec_id].dataType.simpleString(), "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double",
        "explained": "double", "identity_error": "double", "deviation_exact": "string",
    }
    given = table.select(F.col(f"`{vec_id}`").alias("vec_id"), _column(table, embedding).alias("e"))
    return given.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in made.items()))
