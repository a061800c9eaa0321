"""Embedding whitening from an exact scatter matrix, counted in bit planes.

Each entry c becomes the whole number x = floor(scale * c) + offset. A task takes its
rows in blocks; in a block every dimension is shifted by its least value, and bit b of
all rows is packed into words, one plane for each dimension and bit. The cross-product of
two dimensions is then the sum over pairs of planes of 2**(a + b) times the bits set in
both, found by AND and popcount; adding the shifts back gives the sums of x and of x * x,
exactly. Spark adds the tasks' sums up. Centring, n * sum(x * y) - sum(x) * sum(y), is done
in whole numbers too, and only the quotient by n * n goes to double precision and ``eigh``.

What reaches the driver is one number for each pair of dimensions, whatever the number of
rows; the model sent to the tasks holds a line of weights for each component asked for.

Edge cases: rows whose vector is NULL or holds a NULL, a value that is not finite, or one
whose x lies beyond 2**62, take no part; vectors of different lengths are filled with
zeros (x = offset); an empty vector counts as zeros; rows with a NULL or repeated key, and
equal rows, count each; components without variance (fewer rows than dimensions, or equal
rows) have whitened and explained as NULL and 0, and no part in identity_error;
``deviation`` is NULL beyond the range of long, and ``deviation_decimal`` beyond 38 digits; an empty
table gives an empty table; further columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thingroups.llm.common import map_batches, stored

SCALE, OFFSET, COMPONENTS = 1_024, 100_000, 8
LARGEST = 2.0**62
#: Partial sums go to Spark as two decimals, high * 2**60 + low, so that none overflows.
LOW_BITS = 60


@dataclass(frozen=True)
class Whitening:
    """n and the sums of x over the fit list, components by falling eigenvalue, trace of the covariance."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float

    @property
    def usable(self) -> np.ndarray:
        """Components whose variance is more than rounding."""
        least = len(self.sums) * np.finfo(float).eps * max(self.eigenvalues.max(initial=0.0), 0.0)
        return self.eigenvalues > least


def usable(vector: Column, scale: int = SCALE) -> Column:
    """Whether a vector takes part."""
    far = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double") * float(scale)) >= LARGEST)
    return vector.isNotNull() & ~F.exists(vector, far)


def whole_rows(lists: pa.ListArray, scale: int, offset: int, width: int = 0) -> np.ndarray:
    """A row of x for each list, filled up to the longest list or ``width``."""
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    values = np.floor(lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale).astype(np.int64) + offset
    width = max(width, int(lengths.max(initial=0)))
    if (lengths == width).all():
        return values.reshape(len(lengths), width)
    out = np.full((len(lengths), width), offset, np.int64)
    out[np.arange(width) < lengths[:, None]] = values
    return out


def bit_planes(shifted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Planes as words over the rows, with the dimension and the bit of each; by dimension, then bit."""
    rows = len(shifted)
    widths = [int(x).bit_length() for x in shifted.max(axis=0, initial=0)]
    dims = np.repeat(np.arange(len(widths)), widths)
    bits = np.concatenate([np.arange(w) for w in widths] or [np.zeros(0)]).astype(np.int64)
    planes = np.zeros((len(dims), -(-rows // 64) * 8), np.uint8)
    for bit in np.unique(bits):
        at = bits == bit
        packed = np.packbits((shifted[:, dims[at]] >> bit & 1).astype(np.uint8), axis=0)
        planes[at, : len(packed)] = packed.T
    return planes.view(np.uint64), dims, bits


def cross_products(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of x and of the products of all pairs of dimensions, exact (Python's integers)."""
    rows, width = x.shape
    low = x.min(axis=0)
    shifted = x - low
    planes, dims, bits = bit_planes(shifted)
    both = np.zeros((len(dims), len(dims)), np.int64)
    for p, plane in enumerate(planes):
        both[p, p:] = np.bitwise_count(planes[p:] & plane).sum(axis=1, dtype=np.int64)
    both |= np.triu(both, 1).T
    small = 2 * int(bits.max(initial=0)) + 2 + rows.bit_length() < 62
    both = both if small else both.astype(object)
    weights = np.int64(1) << bits if small else np.array([1 << int(b) for b in bits], object)
    both = both * weights[:, None] * weights
    present, starts = np.unique(dims, return_index=True)
    scatter = np.zeros((width, width), object)
    if len(present):
        summed = np.add.reduceat(np.add.reduceat(both, starts, axis=0), starts, axis=1)
        scatter[np.ix_(present, present)] = summed.astype(object)
    inside = np.array([sum(map(int, c)) for c in shifted.T] if not small else shifted.sum(axis=0), object)
    low = low.astype(object)
    scatter = scatter + np.outer(low, inside) + np.outer(inside, low) + rows * np.outer(low, low)
    return inside + rows * low, scatter


def _grown(old: np.ndarray, width: int) -> np.ndarray:
    out = np.array(np.zeros([width] * old.ndim, np.int64), object)
    out[tuple([slice(len(old))] * old.ndim)] = old
    return out


def scatter_sums(vectors: DataFrame, vector: str = "embedding", scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """i, j, high, low: sums of (x - offset), of its products, and of rows.

    (i, j) with i <= j are the products, (i, -1) the sums and (-1, -1) the rows; in
    x - offset a filled entry is 0, so that rows of any length add up."""

    def work(batches: Iterator[list]) -> Iterator[dict]:
        rows, sums, products = 0, np.zeros(0, object), np.zeros((0, 0), object)
        for (lists,) in batches:
            x = whole_rows(lists, scale, 0)
            rows += len(x)
            if x.size:
                s, p = cross_products(x)
                width = max(len(sums), len(s))
                sums = _grown(sums, width) + _grown(s, width)
                products = _grown(products, width) + _grown(p, width)
        if rows:
            i, j = np.triu_indices(len(sums))
            values = [rows, *sums, *products[i, j]]
            yield {
                "i": [-1, *range(len(sums)), *i.tolist()],
                "j": [-1, *[-1] * len(sums), *j.tolist()],
                "high": [Decimal(int(v) >> LOW_BITS) for v in values],
                "low": [Decimal(int(v) & (1 << LOW_BITS) - 1) for v in values],
            }

    kept = vectors.where(usable(F.col(vector), scale)).select(F.col(vector).cast("array<double>").alias("vector"))
    parts = map_batches(kept, ["vector"], work, "i int, j int, high decimal(38,0), low decimal(38,0)", arrow_in=True)
    return parts.groupBy("i", "j").agg(F.sum("high").alias("high"), F.sum("low").alias("low"))


def fit(
    vectors: DataFrame, components: int = COMPONENTS, vector: str = "embedding", scale: int = SCALE, offset: int = OFFSET
) -> Whitening:
    """Exact covariance of all vectors and its first components, to double precision."""
    found = scatter_sums(vectors, vector, scale, offset).toArrow().to_pydict()
    value = {
        (i, j): (int(high) << LOW_BITS) + int(low)
        for i, j, high, low in zip(found["i"], found["j"], found["high"], found["low"], strict=True)
    }
    n = value.get((-1, -1), 0)
    width = 1 + max((i for i, _ in value), default=-1)
    sums = [value[i, -1] for i in range(width)]
    covariance = np.zeros((width, width))
    for i in range(width):
        for j in range(i, width):
            # centred as whole numbers; the quotient of two integers is rounded once
            covariance[i, j] = covariance[j, i] = (n * value[i, j] - sums[i] * sums[j]) / (n * n)
    eigenvalues, columns = np.linalg.eigh(covariance) if width else (np.zeros(0), np.zeros((0, 0)))
    chosen = np.argsort(-eigenvalues, kind="stable")[:components]
    directions = columns[:, chosen].T
    heaviest = np.abs(directions).argmax(axis=1) if width else []
    signs = np.array([-1.0 if d[h] < 0 else 1.0 for d, h in zip(directions, heaviest, strict=True)])
    trace = sum(n * value[i, i] - sums[i] ** 2 for i in range(width)) / (n * n) if n else 0.0
    return Whitening(
        n, tuple(s + n * offset for s in sums), directions * signs.reshape(-1, 1), eigenvalues[chosen], trace
    )


def deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int]:
    """Sum over the dimensions of (n * x - S)**2 for each row, exact."""
    base = np.array([s // n for s in sums], np.int64)
    rest = [s - n * int(b) for s, b in zip(sums, base, strict=True)]
    inside = x - base
    far = n * (int(np.abs(inside).max(initial=0)) + 1)
    kind = np.int64 if far * far * max(1, x.shape[1]) < 2**62 else object
    away = inside.astype(kind) * (np.int64(n) if kind is np.int64 else n) - np.array(rest, kind)
    return [int(d) for d in (away * away).sum(axis=1)]


def whiten(
    vectors: DataFrame,
    model: Whitening,
    keys: tuple[str, ...] = ("vec_id",),
    vector: str = "embedding",
    scale: int = SCALE,
    offset: int = OFFSET,
) -> DataFrame:
    """The keys, ``whitened`` (an array, one entry a component), ``deviation`` and ``deviation_decimal``."""
    keys = list(keys)
    n, sums, good = model.n, model.sums, model.usable
    with np.errstate(divide="ignore", invalid="ignore"):
        weights = model.components / np.sqrt(model.eigenvalues)[:, None]
    weights = np.where(good[:, None], weights, 0.0)

    def work(batches: Iterator[list]) -> Iterator[dict]:
        base = np.array([s // n for s in sums], np.int64) if n else np.zeros(len(sums), np.int64)
        rest = np.array([(s - n * int(b)) / n for s, b in zip(sums, base, strict=True)])
        for *key_columns, lists in batches:
            x = whole_rows(lists, scale, offset, len(sums))
            projected = ((x - base).astype(np.float64) - rest) @ weights.T
            away = deviations(x, n, sums)
            yield dict(zip(keys, key_columns, strict=True)) | {
                "whitened": [[w if g else None for w, g in zip(row, good.tolist(), strict=True)] for row in projected.tolist()],
                "deviation": [d if d < 2**63 else None for d in away],
                "deviation_decimal": [Decimal(d) if d < 10**38 else None for d in away],
            }

    kinds = dict(vectors.dtypes)
    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], "whitened array<double>", "deviation long", "deviation_decimal decimal(38,0)"])
    rows = vectors.where(usable(F.col(vector), scale)).select(*keys, F.col(vector).cast("array<double>").alias("vector"))
    return map_batches(rows, [*keys, "vector"], work, schema, arrow_in=True)


def identity_error(whitened: DataFrame, model: Whitening) -> float | None:
    """Largest absolute entry of the covariance of the whitened rows minus the identity, measured on them."""
    good = np.flatnonzero(model.usable).tolist()
    pairs = [(a, b) for a in good for b in good if a <= b]
    if not pairs:
        return None
    entry = F.col("whitened")
    line = whitened.agg(*[F.covar_pop(entry[a], entry[b]).alias(f"c{a}_{b}") for a, b in pairs]).first()
    return max((abs(line[f"c{a}_{b}"] - (a == b)) for a, b in pairs if line[f"c{a}_{b}"] is not None), default=None)


def report(vectors: DataFrame, components: int = COMPONENTS, vector: str = "embedding") -> DataFrame:
    """One row for each vector that takes part and component, with the quality of the fit."""
    model = fit(vectors, components, vector)
    rows = stored(whiten(vectors, model, ("vec_id",), vector), "whitened")
    error = identity_error(rows, model)
    shares = F.array(*[F.lit(float(e / model.trace) if g else 0.0) for e, g in zip(model.eigenvalues, model.usable, strict=True)])
    return rows.select(
        "vec_id", "deviation", "deviation_decimal", F.posexplode("whitened").alias("at", "whitened")
    ).select(
        "vec_id",
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(shares.cast("array<double>"), F.col("at")).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
        "deviation_decimal",
    )
