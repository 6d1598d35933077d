"""Whitening of embeddings with principal components from an exact characteristic polynomial.

Entries become integers, so n and the sums of entries and of products of entries
are exact, and so is the integer scatter M = n * sum(x x') - S S' (n^2 times the
covariance).  Its characteristic polynomial has integer coefficients: M is
brought to Hessenberg form modulo many primes, whose residues give the
coefficients by the Chinese remainder theorem.  All roots are real, so the signs
of the polynomial shifted to a (Descartes' rule) count the roots above a exactly;
halving isolates the largest roots and refines them far beyond double precision.
Inverse iteration on M - root, in fixed-point integers, gives the components;
equal roots get an orthonormal basis of their null space.

Only sums of d x d numbers leave the tasks, whatever the number of rows.  Primes
and roots are dealt out to tasks of their own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgrid.llm.common import kept, ready

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Entries are cut to +-2^62 after scaling; products are summed in limbs of so many bits, exact in doubles for ROWS rows.
LIMB, ROWS = 21, 1 << 12
#: Rows whose sums fit 64 bits in every case; a task sends its sums at least that often.
SEND_ROWS = 1 << 21
#: Bits of a wanted root after scaling, and primes that a task reduces side by side.
ROOT_BITS, SIDE_BY_SIDE = 160, 24
SUMS = "i int, j int, shift int, value long"


# --- exact sums -----------------------------------------------------------------------------

def finite(vec_col: str):
    """Neither the vector nor an entry of it is null, and every entry is finite."""
    v = F.col(vec_col).cast("array<double>")
    return v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))


def integers(column: pa.Array) -> np.ndarray:
    """floor(1024 c) of a batch of vectors, one row each; the shorter ones end in 0."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    with np.errstate(over="ignore"):
        flat = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
    flat = np.clip(flat, -(2.0 ** 62), 2.0 ** 62).astype(np.int64)
    width = int(sizes.max(initial=0))
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width)[None] < sizes[:, None]] = flat
    return out


def limbs(y: np.ndarray) -> list[np.ndarray]:
    """y = sum of limb k * 2^(21 k), each limb within +-2^20 (the third takes what is left), as doubles."""
    out, half = [], 1 << (LIMB - 1)
    for _ in range(2):
        low = ((y + half) & ((1 << LIMB) - 1)) - half
        out.append(low.astype(np.float64))
        y = (y - low) >> LIMB
    out.append(y.astype(np.float64))
    while len(out) > 1 and not out[-1].any():
        out.pop()
    return out


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (i, j, shift, value): products i <= j, sums of entries at i = -1, the number of rows at i = -2."""
    held: dict[int, np.ndarray] = {}
    entries: dict[int, np.ndarray] = {}
    rows = 0

    def grown(into: dict, shift: int, what: np.ndarray) -> None:
        old = into.get(shift)
        if old is None:
            into[shift] = what
        elif old.shape[0] >= what.shape[0]:
            old[tuple(slice(0, n) for n in what.shape)] += what
        else:
            what[tuple(slice(0, n) for n in old.shape)] += old
            into[shift] = what

    def told() -> pa.RecordBatch:
        parts = [(np.array([-2]), np.array([0]), np.array([0]), np.array([rows]))]
        for shift, s in entries.items():
            parts.append((np.full(len(s), -1), np.arange(len(s)), np.full(len(s), shift), s))
        for shift, m in held.items():
            i, j = np.triu_indices(len(m))
            parts.append((i, j, np.full(len(i), shift), m[i, j]))
        cols = [np.concatenate(x) for x in zip(*parts, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64 if k == 3 else np.int32)) for k, c in enumerate(cols)],
                                          names=["i", "j", "shift", "value"])

    for batch in batches:
        y = integers(batch.column(0))
        for at in range(0, len(y), ROWS):
            parts = limbs(y[at:at + ROWS])
            rows += len(parts[0])
            for p, a in enumerate(parts):
                grown(entries, p, a.sum(0).astype(np.int64))
                for q, b in enumerate(parts):
                    grown(held, p + q, (a.T @ b).astype(np.int64))
        if rows >= SEND_ROWS:
            yield told()
            held, entries, rows = {}, {}, 0
    if rows:
        yield told()


def exact_sums(vectors: DataFrame) -> tuple[int, list[int], list[list[int]]]:
    """n, S and sum(y y') of the only column of ``vectors``, y being x without its shift."""
    total = (vectors.mapInArrow(_sums, SUMS).groupBy("i", "j", "shift")
             .agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect())  # a few numbers for each pair of dimensions
    n = sum(int(r.value) for r in total if r.i == -2)
    d = 1 + max((r.j for r in total if r.i == -1), default=-1)
    s, g = [0] * d, [[0] * d for _ in range(d)]
    for r in total:
        value = int(r.value) << (LIMB * r.shift)
        if r.i == -1:
            s[r.j] += value
        elif r.i >= 0:
            g[r.i][r.j] += value
            if r.i != r.j:
                g[r.j][r.i] += value
    return n, s, g


# --- the characteristic polynomial ----------------------------------------------------------

def is_prime(n: int) -> bool:
    """Exact for n below 3,215,031,751 (Miller-Rabin with these bases)."""
    if n < 11:
        return n in (2, 3, 5, 7)
    if any(n % p == 0 for p in (2, 3, 5, 7)):
        return False
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7):
        x = pow(base, odd, n)
        if x not in (1, n - 1) and all((x := x * x % n) != n - 1 for _ in range(twos - 1)):
            return False
    return True


def primes_beyond(bound: int) -> list[int]:
    """The largest primes below 2^31 whose product is above ``bound``."""
    out, product, n = [], 1, 1 << 31
    while product <= bound:
        n -= 1
        if is_prime(n):
            out.append(n)
            product *= n
    return out


def _inverse(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    """x^(p - 2) mod p; 0 stays 0."""
    out, power, left = np.ones_like(x), x % p, p - 2
    while left.any():
        out = np.where(left & 1 == 1, out * power % p, out)
        power = power * power % p
        left = left >> 1
    return out


def characteristic_residues(m: list[list[int]], primes: list[int]) -> np.ndarray:
    """Coefficients (of x^0, x^1, ...) of det(x - m) modulo each prime, one row each, by reduction to Hessenberg form."""
    d, p = len(m), np.array(primes, np.int64)
    h = np.array([[[v % q for v in row] for row in m] for q in primes], np.int64).reshape(len(p), d, d)
    each, p2, p3 = np.arange(len(p)), p[:, None], p[:, None, None]
    for k in range(1, d - 1):
        # the first row from k on with an entry in column k - 1 comes up, and its column with it
        up = k + np.argmax(h[:, k:, k - 1] != 0, 1)
        rows = h[each, up].copy()
        h[each, up], h[:, k] = h[:, k].copy(), rows
        columns = h[each, :, up].copy()
        h[each, :, up], h[:, :, k] = h[:, :, k].copy(), columns
        f = h[:, k + 1:, k - 1] * _inverse(h[:, k, k - 1], p)[:, None] % p2
        h[:, k + 1:] = (h[:, k + 1:] - f[:, :, None] * h[:, k, None, :] % p3) % p3
        h[:, :, k] = (h[:, :, k] + (h[:, :, k + 1:] * f[:, None, :] % p3).sum(2)) % p2
    poly = np.zeros((d + 1, len(p), d + 1), np.int64)
    poly[0, :, 0] = 1
    for k in range(1, d + 1):
        poly[k, :, 1:] = poly[k - 1, :, :-1]
        poly[k] -= h[:, k - 1, k - 1, None] * poly[k - 1] % p2
        below = np.ones(len(p), np.int64)
        for i in range(k - 1, 0, -1):
            below = below * h[:, i, i - 1] % p
            poly[k] -= (h[:, i - 1, k - 1] * below % p)[:, None] * poly[i - 1] % p2
        poly[k] %= p2
    return poly[d]


def characteristic_polynomial(spark: SparkSession, m: list[list[int]]) -> list[int]:
    """Integer coefficients, of x^0 first, of det(x - m) for a symmetric m without negative eigenvalues."""
    d = len(m)
    # |coefficient| <= sum of all = product of (1 + root) <= (1 + mean root)^d; twice that tells signs apart
    bound = 2 * (2 + sum(m[i][i] for i in range(d)) // d) ** d
    primes = primes_beyond(bound)
    groups = [primes[k:k + SIDE_BY_SIDE] for k in range(0, len(primes), SIDE_BY_SIDE)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for own in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(characteristic_residues(m, own).tolist(), pa.list_(pa.int64()))],
                                                 names=["p", "residues"])

    dealt = spark.createDataFrame([(g,) for g in groups], "primes array<long>").repartition(len(groups))
    got = dealt.mapInArrow(run, "p long, residues array<long>").collect()   # d + 1 numbers for each prime
    product = math.prod(r.p for r in got)
    out = [0] * (d + 1)
    for r in got:
        rest = product // r.p
        rest *= pow(rest, -1, r.p)
        for k, x in enumerate(r.residues):
            out[k] += x * rest
    out = [x % product for x in out]
    return [x - product if x > product // 2 else x for x in out]


# --- roots ----------------------------------------------------------------------------------

def roots_above(poly: list[int], a: int) -> int:
    """How many roots (with multiplicity) of a polynomial with real roots only are larger than ``a``."""
    c = list(poly)
    d = len(c) - 1
    for low in range(d):                                   # Taylor shift by a
        for k in range(d - 1, low - 1, -1):
            c[k] += a * c[k + 1]
    signs = [x > 0 for x in c if x]
    return sum(x != y for x, y in zip(signs, signs[1:]))


def value_at(poly: list[int], a: int) -> int:
    out = 0
    for c in reversed(poly):
        out = out * a + c
    return out


def largest_roots(poly: list[int], want: int) -> list[tuple[Fraction, int]]:
    """The ``want`` largest positive roots, from the largest: (root, multiplicity), each off by less than 2^-(ROOT_BITS - 1) of itself."""
    zeros = next(k for k, c in enumerate(poly) if c)
    poly = poly[zeros:]
    d = len(poly) - 1
    want = min(want, d)
    scale = 0
    while want:
        scaled = [c << (scale * (d - k)) for k, c in enumerate(poly)]     # roots times 2^scale
        top = 1 + (abs(poly[d - 1]) << scale)                            # no root is above their sum
        found, n = [], 0
        spans = [(0, top, d)]                              # roots in (low, high], the highest span last
        while spans and n < want:
            low, high, inside = spans.pop()
            if inside == 1:                                # the sign tells on which side of mid the only root lies
                beyond = value_at(scaled, high)
                low = low if beyond else high - 1
                while high - low > 1:
                    mid = (low + high) >> 1
                    v = value_at(scaled, mid)
                    if v and (v > 0) != (beyond > 0):
                        low = mid
                    else:
                        low, high = low if v else mid - 1, mid
            if high - low == 1:
                found.append((high, inside))
                n += inside
                continue
            mid = (low + high) >> 1
            upper = roots_above(scaled, mid) - roots_above(scaled, high)
            spans += [(a, b, k) for a, b, k in ((low, mid, inside - upper), (mid, high, upper)) if k]
        short = ROOT_BITS - min(r.bit_length() for r, _ in found)
        if short <= 0:
            return [(Fraction(r, 1 << scale), k) for r, k in found]
        scale += short
    return []


# --- components -----------------------------------------------------------------------------

def null_space(m: list[list[int]], root: Fraction, k: int, rounds: int = 3) -> np.ndarray:
    """``k`` orthonormal vectors (rows) that m - root maps to almost 0, by inverse iteration in fixed-point integers."""
    d = len(m)
    bits = 2 * ROOT_BITS + max(v.bit_length() for row in m for v in row)
    one = 1 << bits
    a = np.array([[v << bits for v in row] for row in m], object).reshape(d, d)
    for i in range(d):
        a[i, i] -= (root.numerator << bits) // root.denominator
    swaps, factors = [], []
    for c in range(d):
        best = c + max(range(d - c), key=lambda i: abs(a[c + i, c]))
        if best != c:
            a[[c, best]] = a[[best, c]]
        if a[c, c] == 0:
            a[c, c] = 1
        f = np.array([(x << bits) // a[c, c] for x in a[c + 1:, c]], object)
        if len(f):
            a[c + 1:, c:] = a[c + 1:, c:] - ((f[:, None] * a[None, c, c:]) >> bits)
        swaps.append(best)
        factors.append(f)

    def solved(b: np.ndarray) -> np.ndarray:
        b = b.copy()
        for c in range(d):
            b[[c, swaps[c]]] = b[[swaps[c], c]]
            b[c + 1:] = b[c + 1:] - ((factors[c] * b[c]) >> bits)
        for c in range(d - 1, -1, -1):
            b[c] = ((b[c] - (sum(a[c, c + 1:] * b[c + 1:]) >> bits)) << bits) // a[c, c]
        return b

    def unit(b: np.ndarray) -> np.ndarray:
        size = math.isqrt(sum(x * x for x in b))
        return np.array([(x << bits) // size for x in b], object) if size else b

    out: list[np.ndarray] = []
    for v in range(k):
        # a fixed start without a pattern that an eigenvector could be at right angles to
        b = unit(np.array([one + (one * ((i + 1) * (v + 1) * 7919 % 1009)) // 1009 for i in range(d)], object))
        for _ in range(rounds):
            b = unit(solved(b))
            for _ in range(2):
                for u in out:
                    b = b - ((u * (sum(u * b) >> bits)) >> bits)
                b = unit(b)
        out.append(b)
    vectors = np.array([[float(Fraction(int(x), one)) for x in b] for b in out]).reshape(k, d)
    sign = np.sign(vectors[np.arange(k), np.abs(vectors).argmax(1)])
    return vectors * np.where(sign == 0, 1, sign)[:, None]


def components(spark: SparkSession, n: int, m: list[list[int]], want: int = COMPONENTS) -> tuple[list[Fraction], np.ndarray]:
    """Positive eigenvalues of m / n^2, falling, at most ``want`` of them, and their unit eigenvectors as rows."""
    d = len(m)
    if not any(m[i][i] for i in range(d)):
        return [], np.zeros((0, d))
    found = largest_roots(characteristic_polynomial(spark, m), want)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, top, low, k in zip(*(c.to_pylist() for c in b.columns), strict=True):
                space = null_space(m, Fraction(int(top), int(low)), k)
                yield pa.RecordBatch.from_arrays([pa.array([at] * k, pa.int32()), pa.array(range(k), pa.int32()), pa.array(space.tolist(), pa.list_(pa.float64()))],
                                                 names=["root", "k", "vector"])

    rows = [(at, str(r.numerator), str(r.denominator), k) for at, (r, k) in enumerate(found)]
    dealt = spark.createDataFrame(rows, "root int, top string, low string, k int").repartition(len(rows), "root")
    got = sorted(dealt.mapInArrow(run, "root int, k int, vector array<double>").collect())   # at most d vectors
    return [found[r.root][0] / (n * n) for r in got][:want], np.array([r.vector for r in got])[:want]


# --- whitening ------------------------------------------------------------------------------

def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", want: int = COMPONENTS) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) for every row with a finite vector.

    Rows whose vector is null or has a null or non-finite entry are dropped; the
    others are the fit list, repeated rows as often as they stand there.  Shorter
    vectors count as ending in zeros; scaled entries are cut to +-2^62.  Only
    components with a positive eigenvalue are returned: an empty table, empty
    vectors, and vectors that are all equal give no rows.  ``deviation`` is null
    where it needs more than 64 bits.  Equal eigenvalues share an orthonormal
    basis of their space.  Other columns of ``vectors`` are not read.
    """
    spark = vectors.sparkSession
    ready(spark)
    rows = vectors.where(finite(vec_col)).select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    n, s, g = exact_sums(rows.select("v"))
    d = len(s)
    m = [[n * g[i][j] - s[i] * s[j] for j in range(d)] for i in range(d)]
    values, axes = components(spark, n, m, want) if d else ([], np.zeros((0, 0)))
    id_type = rows.schema["id"].dataType.simpleString()
    if not values:
        return spark.createDataFrame([], f"{id_col} {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    onto = axes.T / np.sqrt(np.array([float(e) for e in values]))
    trace = Fraction(sum(m[i][i] for i in range(d)), n * n)
    most_s = max(abs(x) for x in s)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = integers(batch.column(1))
            y = np.pad(y, ((0, 0), (0, d - y.shape[1])))
            most = n * max(abs(int(y.max(initial=0))), abs(int(y.min(initial=0)))) + most_s
            narrow = most * most * d < 1 << 63
            z = n * y - np.array(s, np.int64) if narrow else y.astype(object) * n - np.array(s, object)
            off = (z * z).sum(1).tolist()
            x = (z / n).astype(np.float64)                 # Python integers divide with one rounding
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v if v < 1 << 63 else None for v in off], pa.int64()), pa.array((x @ onto).tolist(), pa.list_(pa.float64()))],
                                             names=["id", "deviation", "w"])

    done = kept(rows.mapInArrow(run, f"id {id_type}, deviation long, w array<double>"), "whitened")
    k = range(len(values))
    # of the whitened rows themselves, centred before multiplying
    mean = done.agg(*[F.avg(F.get("w", F.lit(i))).alias(f"m{i}") for i in k]).first()
    pairs = [(i, j) for i in k for j in k if i <= j]
    spread = done.agg(*[F.avg((F.get("w", F.lit(i)) - mean[i]) * (F.get("w", F.lit(j)) - mean[j])).alias(f"c{i}_{j}") for i, j in pairs]).first()
    error = max(abs(spread[at] - (i == j)) for at, (i, j) in enumerate(pairs))
    explained = F.array(*[F.lit(float(e / trace)) for e in values])
    return (done.select("id", "deviation", F.posexplode("w").alias("at", "whitened"))
            .select(F.col("id").alias(id_col), (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
                    F.get(explained, F.col("at")).alias("explained"), F.lit(error).alias("identity_error")))
