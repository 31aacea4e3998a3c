"""Embedding whitening by the exact characteristic polynomial of the integer scatter matrix.

1. Entries become integers x = floor(SCALE * c) + SHIFT. Tasks sum x - SHIFT and its products exactly, partial sums meet
   in Spark, and the driver gets one number for each pair of dimensions: n, S and the scatter n * sum(x x') - S S', which is
   n * n times the covariance.
2. The scatter is brought to Hessenberg form modulo many primes, blocks of primes in tasks; the characteristic
   polynomials modulo the primes make the integer one by Chinese remainders. Maclaurin's inequality bounds
   its coefficients, so the number of primes is known beforehand.
3. All roots are real. By Descartes' rule the number of roots above a point is then exactly the number of sign changes
   of the polynomial shifted there; bisection with integers isolates the largest roots to 2 ** -BITS of the largest
   one, and roots that stay together are one root of that multiplicity.
4. Inverse iteration with wide integers in place of floats gives the null space of scatter - root, one
   orthonormal vector for each multiplicity; the entry of largest size is positive.
5. One pass over the vectors projects them; the covariance of what comes out is held against the identity.

Defined results: rows whose vector is null, empty or has null or non-finite entries go, and so do vectors of another
length than most have (of several such lengths, the longest); x is held within 64 bits; all other rows count and come
back, repeated ones too; components of eigenvalue 0 do not exist, so a table of one vector, equal ones or none gives no
rows; ``deviation`` is null where it does not fit 64 bits; other columns are not read. The work of steps 2 to 4 depends
on the number of dimensions alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import comb, isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plazalens.llm.common import written

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Roots are told to this many bits below the largest.
BITS = 160
#: Primes of a task, all under 2 ** 31, so that products of two residues fit 64 bits.
BLOCK = 16
#: Sums are kept in digits of this base.
DIGIT = 10**18
_TOP = (1 << 63) - 1


def integers(vectors: pa.Array, size: int) -> np.ndarray:
    """x - SHIFT of every vector, one row each: 64-bit numbers, or Python's where those do not fit."""
    values = np.array(vectors.flatten(), np.float64).reshape(len(vectors), size)
    scaled = np.floor(values * SCALE)
    if np.all(np.abs(scaled) < 1 << 52):
        return scaled.astype(np.int64)
    floor = lambda v: min(max(int(v) + SHIFT, -_TOP - 1), _TOP) - SHIFT if np.isfinite(v) else (_TOP if v > 0 else -_TOP - 1) - SHIFT
    return np.array([[floor(v) for v in row] for row in scaled.tolist()], object).reshape(len(vectors), size)


def sums(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The exact sums of x_i and of x_i * x_j over the rows."""
    most = int(np.abs(x).max()) if x.size else 0
    if most * most * max(1, len(x)) < 1 << 52:
        whole = x.astype(np.float64)
        return x.sum(0).astype(object), (whole.T @ whole).astype(np.int64).astype(object)
    return x.astype(object).sum(0), x.astype(object).T @ x.astype(object)


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id and vector (doubles) of the rows that count."""
    entries = F.col(column).cast("array<double>").alias("vector")
    rows = vectors.select("vec_id", entries).where(F.size("vector") > 0)
    sound = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return rows.where(F.coalesce(sound, F.lit(False)))


def dimension(rows: DataFrame) -> int:
    lengths = rows.groupBy(F.size("vector").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    most = lengths.agg(F.max(F.struct("n", "d")).alias("m")).first().m
    return most.d if most else 0


@dataclass
class Scatter:
    """The number of vectors, their sums of x - SHIFT, and n * sum(x x') - S S', exact."""

    n: int
    sums: list[int]
    matrix: list[list[int]]

    @property
    def size(self) -> int:
        return len(self.sums)

    @property
    def trace(self) -> int:
        return sum(self.matrix[i][i] for i in range(self.size))


def scatter(rows: DataFrame, size: int) -> Scatter:
    """Exact sums: tasks add in wide integers and give digits, which Spark adds as decimals."""
    places = [(-1, -1)] + [(i, -1) for i in range(size)] + [(i, j) for i in range(size) for j in range(i + 1)]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, one, both = 0, np.zeros(size, object), np.zeros((size, size), object)
        for batch in batches:
            x = integers(batch.column("vector"), size)
            single, double = sums(x)
            n, one, both = n + len(x), one + single, both + double
        values = [n, *one.tolist(), *[both[i][j] for i in range(size) for j in range(i + 1)]]
        digits = []
        for v in values:
            sign, v = (-1, -v) if v < 0 else (1, v)
            digits.append([sign * (v % DIGIT), sign * (v // DIGIT % DIGIT), sign * (v // DIGIT**2)])
        yield pa.RecordBatch.from_arrays([pa.array(range(len(values)), pa.int32()), *[pa.array([d[k] for d in digits], pa.int64()) for k in range(3)]], ["place", "d0", "d1", "d2"])

    parts = rows.select("vector").mapInArrow(partial, "place int, d0 bigint, d1 bigint, d2 bigint")
    added = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("d0", "d1", "d2")]
    found = [0] * len(places)
    for r in parts.groupBy("place").agg(*added).collect():  # one row for each pair of dimensions
        found[r.place] = int(r.d0) + int(r.d1) * DIGIT + int(r.d2) * DIGIT**2
    n, one = found[0], found[1 : size + 1]
    matrix = [[0] * size for _ in range(size)]
    for (i, j), v in zip(places[size + 1 :], found[size + 1 :]):
        matrix[i][j] = matrix[j][i] = n * v - one[i] * one[j]
    return Scatter(n, one, matrix)


def primes(count: int) -> list[int]:
    """The largest primes under 2 ** 31, told by Miller and Rabin's test, which is exact there."""
    out, p = [], (1 << 31) - 1
    while len(out) < count:
        odd, twos = p - 1, 0
        while odd % 2 == 0:
            odd, twos = odd // 2, twos + 1
        for base in (2, 3, 5, 7):
            x = pow(base, odd, p)
            if x not in (1, p - 1) and all((x := x * x % p) != p - 1 for _ in range(twos - 1)):
                break
        else:
            out.append(p)
        p -= 2
    return out


def residues(matrix: list[list[int]], moduli: list[int]) -> np.ndarray:
    """The coefficients of det(t - matrix) modulo each prime, the constant one first: one row a prime."""
    d, p = len(matrix), np.array(moduli, np.int64)
    h = np.array([[[v % m for v in row] for row in matrix] for m in moduli], np.int64).reshape(len(p), d, d)
    mod = p[:, None]
    each = np.arange(len(p))
    for k in range(d - 2):
        pivot = k + 1 + np.argmax(h[:, k + 1 :, k] != 0, axis=1)
        for a in (h, h.transpose(0, 2, 1)):  # rows, then columns
            kept = a[each, k + 1].copy()
            a[each, k + 1] = a[each, pivot]
            a[each, pivot] = kept
        inverse = np.array([pow(int(v), -1, m) if v else 0 for v, m in zip(h[:, k + 1, k].tolist(), moduli)], np.int64)
        factor = h[:, k + 2 :, k] * inverse[:, None] % mod
        h[:, k + 2 :] = (h[:, k + 2 :] - factor[:, :, None] * h[:, k + 1][:, None, :] % p[:, None, None]) % p[:, None, None]
        for i in range(k + 2, d):
            h[:, :, k + 1] = (h[:, :, k + 1] + factor[:, i - k - 2][:, None] * h[:, :, i]) % mod
    polys = [np.zeros((len(p), d + 1), np.int64)]
    polys[0][:, 0] = 1
    for k in range(d):
        new = np.roll(polys[k], 1, axis=1)
        new = (new - h[:, k, k][:, None] * polys[k]) % mod
        below = np.ones(len(p), np.int64)
        for i in range(k - 1, -1, -1):
            below = below * h[:, i + 1, i] % p
            new = (new - (below * h[:, i, k] % p)[:, None] * polys[i]) % mod
        polys.append(new)
    return polys[d]


def characteristic(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """The integer coefficients of det(t - matrix) of a positive semi-definite matrix, the constant one first."""
    d = len(matrix)
    trace = sum(matrix[i][i] for i in range(d))
    # Maclaurin: the k-th symmetric sum of the eigenvalues is at most comb(d, k) * (trace / d) ** k.
    most = max(comb(d, k) * (trace // d + 1) ** k for k in range(d + 1))
    moduli = primes(2 * most.bit_length() // 60 + 2)
    blocks = [moduli[k : k + BLOCK] for k in range(0, len(moduli), BLOCK)]

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.column("block").to_pylist():
                found = residues(matrix, blocks[block]).tolist()
                yield pa.RecordBatch.from_arrays([pa.array(blocks[block], pa.int64()), pa.array(found, pa.list_(pa.int64()))], ["prime", "values"])

    found = {r.prime: r["values"] for r in spark.range(0, len(blocks), 1, len(blocks)).withColumnRenamed("id", "block").mapInArrow(solve, "prime bigint, values array<bigint>").collect()}
    whole = 1
    for p in moduli:
        whole *= p
    parts = [(p, (q := whole // p) * pow(q, -1, p)) for p in moduli]
    out = [sum(found[p][k] * part for p, part in parts) % whole for k in range(d + 1)]
    return [v - whole if v > whole // 2 else v for v in out]


def above(poly: list[int], point: int, scale: int) -> int:
    """How many roots of a real-rooted polynomial are larger than point / 2 ** scale: sign changes after the shift."""
    d = len(poly) - 1
    c = [v << scale * (d - k) for k, v in enumerate(poly)]
    for i in range(d):
        for k in range(d - 1, i - 1, -1):
            c[k] += point * c[k + 1]
    signs = [v > 0 for v in c if v]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def largest_roots(poly: list[int], wanted: int) -> tuple[list[int], int]:
    """The largest positive roots, falling, repeated by multiplicity, as multiples of 2 ** -scale, and scale."""
    zero = next(k for k, v in enumerate(poly) if v)
    poly = poly[zero:]
    wanted = min(wanted, len(poly) - 1)
    if wanted == 0:
        return [], 0
    bound = -poly[-2] + 1  # the sum of the roots and one
    scale = max(0, BITS - bound.bit_length())
    seen: dict[tuple[int, int], int] = {}

    def count(point: int, bits: int) -> int:
        """Roots above point / 2 ** bits; trailing zero bits of the point are dropped to keep numbers short."""
        while bits and point % 2 == 0:
            point, bits = point // 2, bits - 1
        if (point, bits) not in seen:
            seen[point, bits] = above(poly, point, bits)
        return seen[point, bits]

    roots = []
    while len(roots) < wanted:
        k = len(roots) + 1  # low has at least k roots above it, high fewer
        low, high = 0, bound << scale
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if count(middle, scale) >= k else (low, middle)
        roots += [low] * (count(low, scale) - count(high, scale))
    return roots[:wanted], scale


def null_space(matrix: list[list[int]], root: int, scale: int, many: int) -> list[list[float]]:
    """``many`` orthonormal vectors of the null space of matrix - root / 2 ** scale, by inverse iteration.

    All numbers are integers that stand for themselves over 2 ** wide, so that no digit of the root is lost.
    """
    d, wide = len(matrix), 2 * BITS + 64
    one = 1 << wide
    a = np.array([[v << wide for v in row] for row in matrix], object)
    for i in range(d):
        a[i, i] -= (2 * root + 1) << wide - scale - 1  # the middle of the root's interval, off the root itself
    order = list(range(d))
    for k in range(d):
        best = max(range(k, d), key=lambda i: abs(a[i, k]))
        a[[k, best]] = a[[best, k]]
        order[k], order[best] = order[best], order[k]
        if a[k, k] == 0:
            a[k, k] = 1
        for i in range(k + 1, d):
            factor = (a[i, k] << wide) // a[k, k]
            a[i, k] = factor
            a[i, k + 1 :] -= factor * a[k, k + 1 :] >> wide
    found: list[np.ndarray] = []

    def unit(v: np.ndarray) -> np.ndarray:
        for u in found * 2:  # twice, so that what is left is at right angles to the last bit
            v = v - ((u * v).sum() >> wide) * u // one
        return (v << wide) // max(1, isqrt(int((v * v).sum())))

    for m in range(many):
        v = np.array([((i * 7919 + m * 104_729 + 1) % 1009 + 1) << wide - 10 for i in range(d)], object)
        v = unit(v)
        for _ in range(3):
            x = v[order].copy()
            for i in range(1, d):
                x[i] -= (a[i, :i] * x[:i]).sum() >> wide
            for i in range(d - 1, -1, -1):
                x[i] = ((x[i] - ((a[i, i + 1 :] * x[i + 1 :]).sum() >> wide)) << wide) // a[i, i]
            shift = max(0, max(abs(t) for t in x).bit_length() - wide)
            v = unit(x >> shift)
        found.append(v)
    out = []
    for v in found:
        values = [int(t) / one for t in v]
        top = max(values, key=abs)
        out.append([t if top > 0 else -t for t in values])
    return out


@dataclass
class Whitening:
    """What projects a vector: unit vectors as columns and the roots, eigenvalues times n * n."""

    fit: Scatter
    vectors: list[list[float]]
    roots: list[float]

    def explained(self) -> list[float]:
        trace = float(self.fit.trace)
        return [r / trace for r in self.roots]


def whitening(rows: DataFrame, components: int = COMPONENTS) -> Whitening:
    """Fit on all rows of ``usable``, which are vectors of one length."""
    size = dimension(rows)
    fit = scatter(rows.where(F.size("vector") == size), size) if size else Scatter(0, [], [])
    if size == 0 or fit.trace == 0:
        return Whitening(fit, [], [])
    poly = characteristic(rows.sparkSession, fit.matrix)
    roots, scale = largest_roots(poly, components)
    vectors: list[list[float]] = []
    for root in dict.fromkeys(roots):
        vectors += null_space(fit.matrix, root, scale, roots.count(root))
    return Whitening(fit, vectors, [(2 * r + 1) / (1 << scale + 1) for r in roots])


def projected(rows: DataFrame, model: Whitening) -> DataFrame:
    """vec_id, deviation and the whitened components of every row that has the fitted length."""
    size, n, total = model.fit.size, model.fit.n, model.fit.sums
    basis = np.array(model.vectors).reshape(-1, size).T / np.sqrt(np.array(model.roots))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = integers(batch.column("vector"), size)
            most = int(np.abs(x).max()) if x.size else 0
            small = (n * most + max(map(abs, total))) ** 2 * size < 1 << 62
            away = (x if small else x.astype(object)) * n - np.array(total, np.int64 if small else object)
            deviation = (away * away).sum(1).tolist()
            values = (away.astype(np.float64) @ basis).tolist()
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array([v if v <= _TOP else None for v in deviation], pa.int64()), pa.array(values, pa.list_(pa.float64()))],
                ["vec_id", "deviation", "whitened"],
            )

    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.where(F.size("vector") == size).mapInArrow(project, f"vec_id {kind}, deviation bigint, whitened array<double>")


def identity_error(white: DataFrame, many: int) -> float:
    """The largest entry of the covariance of the whitened rows minus the identity, over all rows, centred first."""
    wide = white.select(*[F.col("whitened")[i].alias(f"w{i}") for i in range(many)])
    cells = [(i, j) for i in range(many) for j in range(i + 1)]
    found = wide.agg(*[F.covar_pop(f"w{i}", f"w{j}").alias(f"c{i}_{j}") for i, j in cells]).first()
    return max(abs(found[f"c{i}_{j}"] - (i == j)) for i, j in cells)


def report(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """One row per vector and component, largest eigenvalue first."""
    rows = usable(vectors)
    model = whitening(rows, components)
    many = len(model.roots)
    empty = "array<struct<component: int, whitened: double, explained: double>>"
    if many == 0:
        white = rows.where("false").select("vec_id", F.lit(None).cast("bigint").alias("deviation"), F.lit(None).cast(empty).alias("each"))
        error = None
    else:
        white = written(projected(rows, model), "whitened")
        error = identity_error(white, many)
        each = [F.struct(F.lit(k + 1).alias("component"), F.col("whitened")[k].alias("whitened"), F.lit(share).alias("explained")) for k, share in enumerate(model.explained())]
        white = white.select("vec_id", "deviation", F.array(*each).alias("each"))
    return white.select("vec_id", "deviation", F.explode("each").alias("c")).select(
        "vec_id",
        "c.component",
        F.lit(model.fit.n).cast("long").alias("n"),
        "deviation",
        "c.whitened",
        "c.explained",
        F.lit(error).cast("double").alias("identity_error"),
    )
