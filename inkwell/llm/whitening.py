"""Operator 13: whitening of embeddings by an exact scatter matrix in residues.

Each entry c becomes the integer x = floor(64 c) + 1000000. The fit list holds each distinct
x vector once. Residue-number scatter: a partition of the fit list centres its vectors as n x - S,
reduces them modulo several primes and multiplies the residues by floating-point matrix products that
are exact (no partial sum reaches 2**53); sums of residues are reduced in Spark, and Chinese
remaindering gives the scatter matrix of n x - S as exact integers. There are as many primes as the
proven bound of its entries asks for. A double eigh of it gives the components.

Only what depends on the number of dimensions reaches the driver: sums, the scatter matrix, vectors.

Null vectors and those with a null or non-finite entry are left out; an empty vector has no
component and so no row. Vectors of each length are a table of their own: n, sums, components and
identity_error are of that length's vectors. Repeated vectors count once in the fit and each has its
rows; a null vec_id stays null. Equal eigenvalues: any basis of their space, the same for all rows. A
component whose eigenvalue is nought within rounding (a constant dimension, or fewer vectors than
dimensions) has null whitened values and takes no part in identity_error. Entries that would pass
2**62 are held there. A deviation that passes a long is null in the query; whiten() gives all in
full. An empty table gives none. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

SCALE = 64
SHIFT = 1_000_000
COMPONENTS = 16
LARGEST = 1 << 62
#: Residues are below 2**PRIME_BITS, so ROWS products of two of them are below 2**53.
PRIME_BITS = 22
ROWS = 1 << (53 - 2 * PRIME_BITS)


def integers(values: np.ndarray) -> np.ndarray:
    """x of each entry."""
    scaled = np.clip(np.floor(SCALE * values.astype(np.float64)), -float(LARGEST), float(LARGEST))
    return scaled.astype(np.int64) + SHIFT


def vectors(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and x vectors of the usable rows, by length."""
    if not len(column):
        return
    lengths = np.asarray(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    at = np.concatenate(([0], np.cumsum(lengths)))
    bad = np.concatenate(([0], np.cumsum(~np.isfinite(flat))))
    usable = column.is_valid().to_numpy(zero_copy_only=False) & (bad[at[1:]] == bad[at[:-1]]) & (lengths > 0)
    with np.errstate(over="ignore"):
        for length in np.unique(lengths[usable]):
            rows = np.flatnonzero(usable & (lengths == length))
            yield rows, integers(flat[at[rows][:, None] + np.arange(length)])


def packed(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """(dim, x): the x vectors as bytes, four an entry if they all fit, else eight."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, x in vectors(batch.column(0)):
                short = (np.abs(x) < 1 << 31).all(1)
                for rows, kind in ((x[short], "<i4"), (x[~short], "<i8")):
                    if len(rows):
                        bytes_ = rows.astype(kind).tobytes()
                        width = len(bytes_) // len(rows)
                        offsets = pa.py_buffer(np.arange(0, len(bytes_) + 1, width, np.int32).tobytes())
                        column = pa.Array.from_buffers(pa.binary(), len(rows), [None, offsets, pa.py_buffer(bytes_)])
                        yield pa.RecordBatch.from_arrays([pa.array([x.shape[1]] * len(rows), pa.int32()), column], names=["dim", "x"])

    return df.select(F.col(vector)).mapInArrow(run, "dim int, x binary")


def unpacked(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """x vectors of a batch of (dim, x), by length and width."""
    dims = batch.column("dim").to_numpy()
    data, at = common.buffers(batch.column("x"))
    widths = np.diff(at) // np.maximum(dims, 1)
    for dim in np.unique(dims):
        for width, kind in ((4, "<i4"), (8, "<i8")):
            rows = np.flatnonzero((dims == dim) & (widths == width))
            if len(rows):
                bytes_ = data[at[rows][:, None] + np.arange(dim * width)]
                yield np.ascontiguousarray(bytes_).view(kind).reshape(len(rows), dim).astype(np.int64)


def blocks(x: np.ndarray, rows: int = ROWS) -> Iterator[np.ndarray]:
    for k in range(0, len(x), rows):
        yield x[k : k + rows]


@dataclass
class Fit:
    """What is known of the vectors of one length."""

    n: int
    sums: list[int]
    lo: int
    hi: int
    primes: list[int] = field(default_factory=list)
    components: np.ndarray | None = None
    explained: np.ndarray | None = None
    scale: np.ndarray | None = None
    identity_error: float = 0.0

    def centre(self) -> tuple[np.ndarray, np.ndarray]:
        """Whole parts of the means, and what is left of the sums: S = n * whole + left."""
        whole = [s // self.n for s in self.sums]
        return np.array(whole, np.int64), np.array([s - self.n * w for s, w in zip(self.sums, whole, strict=True)], np.int64)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        whole, left = self.centre()
        return ((x - whole) - left / self.n) @ self.components * self.scale

    def deviations(self, x: np.ndarray) -> list[int]:
        """Exact sums of (n x - S) ** 2."""
        whole, left = self.centre()
        dim, widest = x.shape[1], max(abs(self.lo - int(whole.max())), abs(self.hi - int(whole.min())), 1)
        if widest * widest * dim < 1 << 62 and widest * self.n * dim < 1 << 62:
            a = x - whole
            squares, crossed = (a * a).sum(1).tolist(), (a * left).sum(1).tolist()
            rest = sum(int(v) ** 2 for v in left)
            return [self.n * (self.n * s - 2 * c) + rest for s, c in zip(squares, crossed, strict=True)]
        return [sum((self.n * v - s) ** 2 for v, s in zip(row, self.sums, strict=True)) for row in x.tolist()]


def primes_beyond(bound: int) -> list[int]:
    """Largest primes below 2**PRIME_BITS whose product is above 2 * bound."""
    found, product, p = [], 1, (1 << PRIME_BITS) - 1
    small = [q for q in range(3, 1 << (PRIME_BITS // 2 + 1), 2) if all(q % r for r in range(3, int(q**0.5) + 1, 2))]
    while product <= 2 * bound:
        if all(p % q for q in small if q < p):
            found.append(p)
            product *= p
        p -= 2
    return found


def sums_of(fitted: DataFrame) -> dict[int, Fit]:
    """n, sums and extremes of the fit list, by length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[int, list] = {}
        for batch in batches:
            for x in unpacked(batch):
                n, s, lo, hi = met.get(x.shape[1], (0, np.zeros(x.shape[1], object), LARGEST * 2, -LARGEST * 2))
                small = np.abs(x).max() < 1 << 40
                s = s + (x.sum(0) if small else x.astype(object).sum(0)).astype(object)
                met[x.shape[1]] = n + len(x), s, min(lo, int(x.min())), max(hi, int(x.max()))
        rows = [{"dim": dim, "j": j, "n": n, "s": str(v), "lo": lo, "hi": hi} for dim, (n, s, lo, hi) in met.items() for j, v in enumerate(s)]
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("dim", pa.int32()), ("j", pa.int32()), ("n", pa.int64()), ("s", pa.string()), ("lo", pa.int64()), ("hi", pa.int64())]))

    parts = fitted.mapInArrow(run, "dim int, j int, n long, s string, lo long, hi long")
    totals = parts.groupBy("dim", "j").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    found: dict[int, Fit] = {}
    for row in sorted(totals.collect()):  # one row for each dimension
        fit = found.setdefault(row.dim, Fit(row.n, [], row.lo, row.hi))
        fit.sums.append(int(row.s))
    return found


def scatter(fitted: DataFrame, fits: dict[int, Fit]) -> dict[int, np.ndarray]:
    """Exact sums of (n x - S)(n x - S)' over the fit list, as Python integers, by length."""
    for fit in fits.values():
        fit.primes = primes_beyond(fit.n * (fit.n * max(fit.hi - fit.lo, 1)) ** 2)
    plans = {dim: (fit.n, fit.sums, fit.primes) for dim, fit in fits.items()}
    schema = "dim int, prime long, i int, residues array<long>"
    kind = pa.schema([("dim", pa.int32()), ("prime", pa.int64()), ("i", pa.int32()), ("residues", pa.list_(pa.int64()))])

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for whole in unpacked(batch):
                dim = whole.shape[1]
                n, sums, primes = plans[dim]
                for x in blocks(whole):
                    for p in primes:
                        residues = (((x % p) * (n % p) - np.array([s % p for s in sums], np.int64)) % p).astype(np.float64)
                        product = (residues.T @ residues).astype(np.int64)
                        met[dim, p] = (met.get((dim, p), 0) + product) % p
        for (dim, p), total in met.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([dim] * dim, pa.int32()), pa.array([p] * dim, pa.int64()), pa.array(range(dim), pa.int32()), pa.array(total.tolist(), pa.list_(pa.int64()))], schema=kind
            )

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[tuple[int, int, int], np.ndarray] = {}
        for batch in batches:
            rows = batch.column("residues")
            for k, key in enumerate(zip(*(batch.column(c).to_pylist() for c in ("dim", "prime", "i")), strict=True)):
                met[key] = (met.get(key, 0) + rows[k].values.to_numpy()) % key[1]
        for (dim, p, i), total in met.items():
            yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([p], pa.int64()), pa.array([i], pa.int32()), pa.array([total.tolist()], pa.list_(pa.int64()))], schema=kind)

    rows = fitted.mapInArrow(products, schema).repartition("dim", "prime", "i").mapInArrow(reduced, schema)
    found: dict[int, dict[int, np.ndarray]] = {dim: {p: np.zeros((dim, dim), object) for p in fit.primes} for dim, fit in fits.items()}
    for row in rows.toLocalIterator():  # dimensions x primes rows
        found[row.dim][row.prime][row.i] = [int(v) for v in row.residues]
    return {dim: remaindered(by_prime) for dim, by_prime in found.items()}


def remaindered(residues: dict[int, np.ndarray]) -> np.ndarray:
    """The integers between -M/2 and M/2 with these residues, M the product of the primes."""
    product = 1
    for p in residues:
        product *= p
    total = sum(r * (product // p * pow(product // p, -1, p)) for p, r in residues.items()) % product
    return np.where(total > product // 2, total - product, total)


def decompose(fit: Fit, exact: np.ndarray, components: int = COMPONENTS) -> None:
    """Eigenvectors, shares of the variance and 1/sqrt(e) of the leading components."""
    cube = fit.n**3
    covariance = np.array([[v / cube for v in row] for row in exact.tolist()])
    values, columns = np.linalg.eigh(covariance)
    values, columns = values[::-1][:components], columns[:, ::-1][:, :components]
    trace = sum(exact.diagonal().tolist()) / cube
    some = values > max(values[0], 0) * len(exact) * np.finfo(float).eps
    fit.components = columns
    fit.explained = np.where(some, values, 0) / trace if trace else np.zeros(len(values))
    fit.scale = np.where(some, 1 / np.sqrt(np.where(some, values, 1)), np.nan)


def measure(fitted: DataFrame, fits: dict[int, Fit]) -> None:
    """identity_error: what the covariance of the whitened fit list, as it comes out, departs from the identity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[int, np.ndarray] = {}
        for batch in batches:
            for whole in unpacked(batch):
                for x in blocks(whole, 4096):
                    z = np.column_stack([np.ones(len(x)), np.nan_to_num(fits[x.shape[1]].whitened(x))])
                    met[x.shape[1]] = met.get(x.shape[1], 0) + z.T @ z
        for dim, total in met.items():
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(total.size, dim, np.int32)), pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)), pa.array(total.ravel())], names=["dim", "i", "j", "v"])

    sums = {dim: np.zeros((len(fit.scale) + 1,) * 2) for dim, fit in fits.items()}
    for row in fitted.mapInArrow(run, "dim int, i int, j int, v double").groupBy("dim", "i", "j").agg(F.sum("v").alias("v")).collect():
        sums[row.dim][row.i, row.j] = row.v
    for dim, fit in fits.items():
        some = np.isfinite(fit.scale)
        mean = sums[dim][0, 1:] / fit.n
        error = np.abs(sums[dim][1:, 1:] / fit.n - np.outer(mean, mean) - np.eye(len(some)))[np.ix_(some, some)]
        fit.identity_error = float(error.max()) if error.size else 0.0


def fit_whitening(df: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> dict[int, Fit]:
    """The whitening of each length of vector."""
    fitted = common.cut(packed(df, vector).distinct(), "fit-list")
    fits = sums_of(fitted)
    for dim, exact in scatter(fitted, fits).items() if fits else ():
        decompose(fits[dim], exact, components)
    if fits:
        measure(fitted, fits)
    common.discard(fitted)
    return fits


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Per usable row and component: key, component, n, deviation (decimal), whitened, explained, identity_error."""
    fits = fit_whitening(df, vector, components)
    of_key = df.schema[key]
    made = [
        T.StructField("component", T.IntegerType()),
        T.StructField("n", T.LongType()),
        T.StructField("deviation", T.StringType()),
        T.StructField("whitened", T.DoubleType()),
        T.StructField("explained", T.DoubleType()),
        T.StructField("identity_error", T.DoubleType()),
    ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for all_rows, all_x in vectors(batch.column(1)):
                fit = fits[all_x.shape[1]]
                m = len(fit.scale)
                for rows, x in zip(blocks(all_rows, 4096), blocks(all_x, 4096), strict=True):
                    many = len(rows) * m
                    columns = [
                        batch.column(0).take(pa.array(np.repeat(rows, m))),
                        pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), len(rows))),
                        pa.array(np.full(many, fit.n, np.int64)),
                        pa.array([str(d) for d in fit.deviations(x)]).take(pa.array(np.repeat(np.arange(len(rows)), m))),
                        pa.array(fit.whitened(x).ravel(), from_pandas=True),
                        pa.array(np.tile(fit.explained, len(rows))),
                        pa.array(np.full(many, fit.identity_error)),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=[of_key.name, *(f.name for f in made)])

    out = df.select(key, vector).mapInArrow(run, T.StructType([of_key, *made]))
    return out.withColumn("deviation", F.col("deviation").try_cast("decimal(38,0)"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whiten(common.table(spark, sf_dir, "embeddings"))
    return found.withColumn("deviation", F.col("deviation").try_cast("long"))
