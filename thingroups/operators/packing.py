"""Containers of the bitmap index, packed bucket by bucket.

Rows come with consecutive row ids, so a task sees a bucket of 32,768 rows at a time
and puts all its containers together before anything is shuffled. A bucket that two
tasks share gives two containers of a value; whoever reads the index adds them up.

A numeric column has, besides one container a bin, cumulative slices in two levels:
``fine`` ones hold the rows of a block of bins up to a bin, ``coarse`` ones all blocks
before a block. The rows up to any bin are then one fine and one coarse slice, whatever the number
of bins. Only slices that differ are stored: each one says for which range of bins (or
blocks), ``first`` to ``last``, it holds.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from thingroups.functions import binning
from thingroups.functions.arrow import apply_arrow, map_arrow
from thingroups.functions.numbers import as_number
from thingroups.operators.bitmaps import DENSE_FROM
from thingroups.spec import TableSpec

BUCKET_ROWS = 32_768
VALUES, SLICES = "values", "slices"
#: Levels of slices; containers of single values have 0.
FINE, COARSE = 1, 2
CONTAINERS = (
    "layer string, column string, value string, number long, real double, level int, first int, last int,"
    " bucket long, n int, bitmap binary, positions array<smallint>"
)
#: What says that a row of a joined fact has a dimension row at all.
PRESENT = ""


def bucket_of(rids):
    """Ids 1 to 32,768 are in bucket 1, as Spark's bitmap functions have it."""
    return (rids - 1) // BUCKET_ROWS + 1


def row_ids(bucket: int, positions: np.ndarray) -> np.ndarray:
    return (bucket - 1) * BUCKET_ROWS + positions + 1


def block_size(bins: int) -> int:
    """Bins of a block: with their square root both levels are short."""
    return max(1, round(bins**0.5))


def as_bitmap(positions: np.ndarray) -> bytes:
    bits = np.zeros(BUCKET_ROWS, np.uint8)
    bits[positions] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def _batch(layer: str, column: str, bucket: int, counts: np.ndarray, sets, values=None, numbers=None, reals=None, level=0, first=None, last=None) -> list:
    """Output columns for containers of one column; ``sets`` are bitmaps, or (offsets, positions)."""
    n = len(counts)
    fill = lambda x, kind: pa.nulls(n, kind) if x is None else x if isinstance(x, pa.Array) else pa.array(x, kind)
    if isinstance(sets, list):
        bitmaps, positions = pa.array(sets, pa.binary()), pa.nulls(n, pa.list_(pa.int16()))
    else:
        offsets, flat = sets
        bitmaps = pa.nulls(n, pa.binary())
        positions = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat.astype(np.int16)))
    return [
        pa.array([layer] * n, pa.string()), pa.array([column] * n, pa.string()), fill(values, pa.string()),
        fill(numbers, pa.int64()), fill(reals, pa.float64()), pa.array([level] * n, pa.int32()), fill(first, pa.int32()),
        fill(last, pa.int32()), pa.array([bucket] * n, pa.int64()), pa.array(counts, pa.int32()), bitmaps, positions,
    ]


def value_containers(column: str, bucket: int, codes: np.ndarray, positions: np.ndarray, values: pa.Array, numbers=None, reals=None) -> Iterator[list]:
    """A container for each code (-1 is none); crowded ones as bitmaps."""
    there = codes >= 0
    codes, positions = codes[there], positions[there]
    order = np.argsort(codes, kind="stable")
    codes, positions = codes[order], positions[order]
    counts = np.bincount(codes, minlength=len(values))
    ends = np.cumsum(counts)
    pick = lambda which: {
        name: x if x is None else x.take(pa.array(which)) for name, x in (("values", values), ("numbers", numbers), ("reals", reals))
    }
    thin = np.flatnonzero((counts > 0) & (counts < DENSE_FROM))
    if len(thin):
        flat = positions[(counts < DENSE_FROM)[codes]]
        offsets = np.concatenate([[0], np.cumsum(counts[thin])])
        yield _batch(VALUES, column, bucket, counts[thin], (offsets, flat), **pick(thin))
    crowded = np.flatnonzero(counts >= DENSE_FROM)
    if len(crowded):
        maps = [as_bitmap(positions[ends[c] - counts[c] : ends[c]]) for c in crowded]
        yield _batch(VALUES, column, bucket, counts[crowded], maps, **pick(crowded))


def slice_containers(column: str, bucket: int, bins_of: np.ndarray, positions: np.ndarray, bins: int) -> Iterator[list]:
    """Cumulative slices of a column whose bins are given (-1 is none)."""
    block = block_size(bins)
    there = bins_of >= 0
    order = np.argsort(bins_of[there], kind="stable")
    found, positions = bins_of[there][order], positions[there][order]
    if not len(found):
        return
    present, begins = np.unique(found, return_index=True)
    ends = np.append(begins[1:], len(found))
    blocks, first_of = np.unique(present // block, return_index=True)
    lines = []
    for i, b in enumerate(present.tolist()):
        follows = present[i + 1] if i + 1 < len(present) and present[i + 1] // block == b // block else (b // block + 1) * block
        begin = begins[first_of[np.searchsorted(blocks, b // block)]]
        lines.append((FINE, b, int(follows) - 1, positions[begin : ends[i]]))
    for i, b in enumerate(blocks.tolist()):
        end = begins[first_of[i + 1]] if i + 1 < len(blocks) else len(found)
        last = int(blocks[i + 1]) if i + 1 < len(blocks) else -(-bins // block)
        lines.append((COARSE, b + 1, last, positions[:end]))
    for level in (FINE, COARSE):
        for crowded in (False, True):
            some = [s for s in lines if s[0] == level and (len(s[3]) >= DENSE_FROM) == crowded]
            if some:
                counts = np.array([len(s[3]) for s in some])
                sets = [as_bitmap(s[3]) for s in some] if crowded else (
                    np.concatenate([[0], np.cumsum(counts)]), np.concatenate([np.sort(s[3]) for s in some])
                )
                yield _batch(SLICES, column, bucket, counts, sets, level=level, first=[s[1] for s in some], last=[s[2] for s in some])


def _coded(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    coded = values.dictionary_encode()
    return coded.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def column_containers(column: str, kind: str, bucket: int, values: pa.Array, positions: np.ndarray, bins: int | None) -> Iterator[list]:
    """All containers of one column in one bucket. Numeric columns come as bins (with ``bins``), or as
    they are, and then have a container for each value."""
    codes, distinct = _coded(values)
    numbers = distinct.cast(pa.int64()) if pa.types.is_integer(distinct.type) else None
    reals = distinct if pa.types.is_floating(distinct.type) else None
    yield from value_containers(column, bucket, codes, positions, distinct.cast(pa.string()), numbers, reals)
    if kind == "num" and bins is not None:
        own = values.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        yield from slice_containers(column, bucket, own, positions, bins)


def _plain(df: DataFrame, name: str):
    """A categorical column as whole numbers where it has them, else as text."""
    whole = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    return F.col(name).cast("bigint" if isinstance(df.schema[name].dataType, whole) else "string")


def pack_rows(rows: DataFrame, spec: TableSpec, bounds: Mapping[str, tuple[float, float]], bins: int, columns: Sequence[str] | None = None) -> DataFrame:
    """Containers of all indexed columns, and slices of the numeric ones, in one pass over numbered rows."""
    names, cells = [], []
    for name in columns or spec.columns:
        if spec.kinds[name] != "num":
            names.append(name)
            cells.append(_plain(rows, name).alias(name))
        elif name in bounds:  # an all-NULL column has no bins
            names.append(name)
            x = as_number(F.col(name), rows.schema[name].dataType)
            cells.append(binning.bin_of(x, *bounds[name], bins).cast("bigint").alias(name))
    kinds = [spec.kinds[name] for name in names]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        held, bucket = [], None

        def flush() -> Iterator[list]:
            table = pa.Table.from_batches(held).combine_chunks()
            positions = (table.column(0).to_numpy() - 1) % BUCKET_ROWS
            for i, (name, kind) in enumerate(zip(names, kinds, strict=True), 1):
                yield from column_containers(name, kind, bucket, whole_column(table, i), positions, bins)

        for batch in batches:
            buckets = bucket_of(batch.column(0).to_numpy())
            edges = [0, *(np.flatnonzero(np.diff(buckets)) + 1).tolist(), len(buckets)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a < b:
                    if held and buckets[a] != bucket:
                        yield from flush()
                        held = []
                    bucket = int(buckets[a])
                    held.append(batch.slice(a, b - a))
        if held:
            yield from flush()

    return map_arrow(rows.select(F.col("rid").cast("bigint"), *cells), work, CONTAINERS)


def pack_dimension(containers: DataFrame, dimension: DataFrame, key: str, kinds: Mapping[str, str]) -> DataFrame:
    """Containers of a dimension's values over fact rows, out of those of the foreign key: no
    fact row is read. Numeric values are kept as they are. Keys of the dimension must be unique."""
    names = list(kinds)
    cells = [(F.col(c).cast("double") if kinds[c] == "num" else _plain(dimension, c)).alias(f"cell_{i}") for i, c in enumerate(names)]
    looked_up = dimension.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("value"), *cells)
    joined = containers.select("value", "bucket", "bitmap", "positions").join(looked_up, "value").drop("value")

    def work(table: pa.Table) -> list:
        bucket = table.column("bucket")[0].as_py()
        positions, owner = unpacked(table)
        out = list(value_containers(PRESENT, bucket, np.zeros(len(positions), np.int64), positions, pa.array(["present"])))
        for i, name in enumerate(names):
            column = whole_column(table, f"cell_{i}")
            out += column_containers(name, kinds[name], bucket, column.take(pa.array(owner)), positions, None)
        return [pa.concat_arrays(parts) for parts in zip(*out, strict=True)]

    return apply_arrow(joined, "bucket", work, CONTAINERS)


def whole_column(table: pa.Table, name: str | int) -> pa.Array:
    column = table.column(name).combine_chunks()
    return column.chunk(0) if isinstance(column, pa.ChunkedArray) else column


def unpacked(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """All positions of a table's containers, and the row of the table that each belongs to."""
    lists = whole_column(table, "positions")
    lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    positions, owner = [lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)], [np.repeat(np.arange(len(lists)), lengths)]
    for i, bitmap in enumerate(table.column("bitmap").to_pylist()):
        if bitmap is not None:
            mine = np.flatnonzero(np.unpackbits(np.frombuffer(bitmap, np.uint8), bitorder="little"))
            positions.append(mine)
            owner.append(np.full(len(mine), i))
    return np.concatenate(positions), np.concatenate(owner)
