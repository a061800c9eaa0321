"""Stored artefacts: bitmap index, row ids, exact answers, fitted models, metric files."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections import defaultdict
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from thingroups.functions import binning
from thingroups.functions.draws import keep, salted
from thingroups.functions.numbers import as_number
from thingroups.operators import bitmaps, packing
from thingroups.sources.catalog import Catalog, key_parts, scan_bernoulli, scan_stored
from thingroups.spec import JoinSpec, TableSpec


_local_folders: dict[str, str] = {}


def scratch_folder(spark: SparkSession) -> str:
    """Shared folder named by the cluster; a local one only for a local session."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    application = spark.sparkContext.applicationId
    if application not in _local_folders:
        _local_folders[application] = tempfile.mkdtemp(prefix="thingroups-")
    return _local_folders[application]


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint a result that is much smaller than what it was computed from and
    is used more than once: later steps read it and do not repeat its scans."""
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.sparkContext.setCheckpointDir(scratch_folder(spark))
    return df.checkpoint()


_path_locks: defaultdict[str, threading.Lock] = defaultdict(threading.Lock)
_locks_guard = threading.Lock()


def _lock(path: str) -> threading.Lock:
    with _locks_guard:
        return _path_locks[path]


def _read_if_there(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    """A folder's rows, or None if there is no such folder; any other error is raised."""
    try:
        reader = spark.read if schema is None else spark.read.schema(schema)
        return reader.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def published_folder(spark: SparkSession, path: str, schema: str | None = None) -> tuple[str, DataFrame] | None:
    """The folder a manifest names and its rows, or None if there is none or not all rows are there.

    Data go to a fresh folder first; the manifest, one line with that folder and its
    row count, is written last. What an aborted or a lost write left is never read.
    """
    lines = _read_if_there(spark, f"{path}/manifest", "folder string, n_rows long")
    line = None if lines is None else lines.first()
    if line is None:
        return None
    data = _read_if_there(spark, f"{path}/{line['folder']}", schema)
    return (f"{path}/{line['folder']}", data) if data is not None and data.count() == line["n_rows"] else None


def published(spark: SparkSession, path: str) -> DataFrame | None:
    there = published_folder(spark, path)
    return None if there is None else there[1]


def is_written(spark: SparkSession, path: str) -> bool:
    return published(spark, path) is not None


def write_once(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write unless already written, and read back; one thread at a time per path."""
    spark = df.sparkSession
    with _lock(path):
        there = published(spark, path)
        if there is not None:
            return there
        folder = f"data-{uuid.uuid4().hex}"
        df.write.partitionBy(*partition_by).parquet(f"{path}/{folder}")
        data = spark.read.schema(df.schema).parquet(f"{path}/{folder}")
        line = spark.createDataFrame([(folder, data.count())], "folder string, n_rows long")
        line.coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")
        return data


# --- index -----------------------------------------------------------------


#: More files than this are not named one by one in a filter.
MOST_NAMED_FILES = 10_000


class BitmapIndex:
    """Row ids and bitmap containers of one fact table at its index rate.

    A table of Parquet files needs no copy for its row ids: files are put in order once, and
    a row's id is its place in its file behind all files before. The ids of a file begin at a new bucket, so a
    bucket lies in one file, and rows are fetched by id from the files that hold them. For any
    other table, ids are given out once, when the row table is written.

    Half-open adaptive indexes are packed bucket by bucket and have slices; closed or
    dense ones are aggregated. The path names what the content depends on.
    """

    def __init__(
        self,
        catalog: Catalog,
        table: str,
        folder: str,
        bins: int = 100,
        closed: bool = False,
        layout: str = "adaptive",
        seed: int = 42,
        rows_per_file: int = 64_000_000,
    ):
        self.catalog, self.table, self.bins, self.closed, self.layout = catalog, table, bins, closed, layout
        self.spec = catalog.spec(table)
        self.seed, self.rows_per_file = seed, rows_per_file
        self.packed = not closed and layout == "adaptive"
        base = f"{folder}/index/{catalog.name}/{table}_{self.spec.index_rate}_{seed}"
        self.rows_path, self.files_path = f"{base}/rows", f"{base}/files"
        form = "packed" if self.packed else f"{'closed' if closed else 'open'}_{layout}"
        self.bitmaps_path = f"{base}/bitmaps_{bins}_{form}"
        self._opened: dict[str, DataFrame] = {}
        self._extremes: dict[str, dict[int, tuple[float, float]]] | None = None

    def _open(self, path: str) -> DataFrame:
        """A stored table; its files are listed once, not at every use."""
        if path not in self._opened:
            there = published(self.catalog.spark, path)
            if there is None:
                raise FileNotFoundError(f"no finished index at {path}")
            self._opened[path] = there
        return self._opened[path]

    # --- rows ---

    def files(self) -> DataFrame:
        """file, rows and first: the id of each file's first row."""
        if self.files_path not in self._opened:
            places = self.catalog.frame(self.table).select(
                F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at")
            )
            sizes = places.groupBy("file").agg((F.max("at") + 1).alias("rows"))
            taken = F.ceil(F.col("rows") / packing.BUCKET_ROWS) * packing.BUCKET_ROWS
            # one line a file, so the window over all of them is short
            first = F.sum(taken).over(Window.orderBy("file")) - taken + 1
            numbered = sizes.select("file", "rows", first.cast("bigint").alias("first"))
            self._opened[self.files_path] = write_once(numbered, self.files_path)
        return self._opened[self.files_path]

    def _numbered(self, frame: DataFrame) -> DataFrame:
        """Rows of the table's files with their ids, at the index rate; a plan, not a copy."""
        stored = self.spec.stored_columns
        rows = frame.select(*stored, F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
        rows = rows.where(keep(self.spec.index_rate, salted("index", self.seed), *key_parts(rows, self.spec)))
        return rows.join(self.files().select("file", "first"), "file").select(*stored, (F.col("first") + F.col("at")).alias("rid"))

    def write_rows(self) -> DataFrame:
        if self.table in self.catalog.in_files:
            return self._numbered(self.catalog.frame(self.table))
        if self.rows_path not in self._opened:
            rows = scan_bernoulli(self.catalog, self.table, seed=self.seed)
            numbered = rows.withColumn("rid", F.monotonically_increasing_id())
            self._opened[self.rows_path] = write_once(numbered, self.rows_path)
        return self._opened[self.rows_path]

    def rows(self) -> DataFrame:
        return self.write_rows() if self.table in self.catalog.in_files else self._open(self.rows_path)

    def fetch(self, wanted: DataFrame) -> DataFrame:
        """Rows of the given ids (column ``rid``), out of the files that hold some of them."""
        ids = wanted.select("rid").distinct()
        if self.table not in self.catalog.in_files:
            return self.rows().join(ids, "rid", "left_semi")
        bucket = lambda rid: F.bitmap_bucket_number(rid)
        span = F.sequence(bucket(F.col("first")), bucket(F.col("first") + F.col("rows") - 1))
        buckets = self.files().select("file", F.explode(span).alias("bucket"))
        held = buckets.join(ids.select(bucket(F.col("rid")).alias("bucket")).distinct(), "bucket").select("file").distinct()
        named = [r["file"] for r in held.limit(MOST_NAMED_FILES + 1).collect()]
        frame = self.catalog.frame(self.table)
        if len(named) <= MOST_NAMED_FILES:
            frame = frame.where(F.col("_metadata.file_path").isin(*named))
        return self._numbered(frame).join(ids, "rid", "left_semi")

    # --- containers ---

    def containers(self) -> DataFrame:
        """The index as a plan over the row table, not yet written."""
        lines = bitmaps.entries(
            self.write_rows(), self.spec, self.catalog.bounds(self.table), self.bins, self.closed
        )
        return bitmaps.build(lines, self.layout)

    def _row_count(self) -> int:
        if self.table in self.catalog.in_files:
            return int((self.files().agg(F.sum("rows")).first()[0] or 0) * self.spec.index_rate)
        return self.write_rows().count()

    def _spread(self):
        files = max(1, -(-self._row_count() // self.rows_per_file))
        return F.pmod(F.xxhash64("bucket"), F.lit(files))

    def _layers(self, path: str) -> bool:
        """Open what is written below a path, layer by layer; False if there is nothing."""
        there = published_folder(self.catalog.spark, path, packing.CONTAINERS)
        if there is None:
            return False
        folder, data = there
        kept = [f"{f.name} {f.dataType.simpleString()}" for f in data.schema if f.name != "layer"]
        for layer in (packing.VALUES, packing.SLICES):
            found = _read_if_there(self.catalog.spark, f"{folder}/layer={layer}", ", ".join(kept))
            self._opened[f"{path}/{layer}"] = data.where("false").drop("layer") if found is None else found
        return True

    def _write_layers(self, containers: DataFrame, path: str) -> None:
        arranged = containers.repartition("layer", "column", self._spread()).sortWithinPartitions(
            "layer", "column", "value", "level", "first", "bucket"
        )
        write_once(arranged, path, ["layer", "column"])
        self._layers(path)

    def write(self) -> DataFrame:
        """One folder per column, with as many files as the row count asks for.

        Within a file containers are sorted by value, so that a value lookup
        skips row groups; files are filled by bucket, so that a hot value is
        spread over all of them."""
        if self.packed:
            if f"{self.bitmaps_path}/{packing.VALUES}" not in self._opened and not self._layers(self.bitmaps_path):
                made = packing.pack_rows(self.write_rows(), self.spec, self.catalog.bounds(self.table), self.bins)
                self._write_layers(made, self.bitmaps_path)
            return self.read()
        if self.bitmaps_path in self._opened:
            return self.read()
        there = published(self.catalog.spark, self.bitmaps_path)
        if there is not None:
            self._opened[self.bitmaps_path] = there
            return there
        arranged = (
            self.containers()
            .repartition("column", self._spread())
            .sortWithinPartitions("column", "value", "bucket")
        )
        self._opened[self.bitmaps_path] = write_once(arranged, self.bitmaps_path, ["column"])
        return self.read()

    def save_bucketed(self, name: str, buckets: int) -> DataFrame:
        """The same index as a catalog table bucketed by row-id bucket, so that
        set operations on the bucket need no shuffle at all."""
        (
            self.containers()
            .write.mode("ignore")
            .partitionBy("column")
            .bucketBy(buckets, "bucket")
            .sortBy("value")
            .option("path", f"{self.bitmaps_path}_bucketed")
            .saveAsTable(name)
        )
        return self.catalog.spark.table(name)

    def _layer(self, path: str, layer: str) -> DataFrame:
        if f"{path}/{layer}" not in self._opened and not self._layers(path):
            raise FileNotFoundError(f"no finished index at {path}")
        return self._opened[f"{path}/{layer}"]

    def read(self, column: str | None = None, values: Sequence[str] | None = None) -> DataFrame:
        """Containers of one column (a folder) and of given values (a pushed filter)."""
        index = self._layer(self.bitmaps_path, packing.VALUES) if self.packed else self._open(self.bitmaps_path)
        if column is not None:
            index = index.where(F.col("column") == column)
        if values is not None:
            index = index.where(F.col("value").isin(*values))
        return index

    def slices(self, column: str) -> DataFrame:
        """Cumulative slices of a numeric column."""
        return self._layer(self.bitmaps_path, packing.SLICES).where(F.col("column") == column)

    def bin_extremes(self, column: str) -> dict[int, tuple[float, float]]:
        """The least and the largest value of each bin of a numeric column, found once for all of them:
        two numbers a bin."""
        if self._extremes is None:
            bounds, rows = self.catalog.bounds(self.table), self.rows()
            cells = []
            for c in self.spec.numeric:
                if c in bounds:
                    x = as_number(F.col(c), rows.schema[c].dataType)
                    cells.append(F.struct(F.lit(c).alias("column"), binning.bin_of(x, *bounds[c], self.bins).alias("bin"), x.alias("x")))
            each = rows.select(F.inline(F.array(*cells))).where("x IS NOT NULL")
            found = each.groupBy("column", "bin").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
            extremes: dict[str, dict[int, tuple[float, float]]] = {}
            for r in write_once(found, self._extra_path("extremes")).collect():
                extremes.setdefault(r["column"], {})[r["bin"]] = (r["lo"], r["hi"])
            self._extremes = extremes
        return self._extremes.get(column, {})

    # --- marks and joins ---

    def _extra_path(self, name: str) -> str:
        return f"{self.bitmaps_path}_{name}"

    def write_join(self, join: JoinSpec) -> None:
        """Containers of a dimension's values over this table's rows, built once, out of those of the
        foreign key. Keys that occur twice in the dimension are an error: a row would have two values."""
        path = self._extra_path(f"join_{join.dimension}_{join.fact_key}")
        if f"{path}/{packing.VALUES}" in self._opened or self._layers(path):
            return
        dim, spec = scan_stored(self.catalog, join.dimension), self.catalog.spec(join.dimension)
        n, keys = dim.where(F.col(join.dim_key).isNotNull()).agg(F.count(join.dim_key), F.count_distinct(join.dim_key)).first()
        if n != keys:
            raise ValueError(f"'{join.dim_key}' is no unique key of '{join.dimension}'")
        self._write_layers(packing.pack_dimension(self.read(join.fact_key), dim, join.dim_key, spec.kinds), path)

    def joined(self, join: JoinSpec, column: str = packing.PRESENT) -> DataFrame | None:
        """Containers of a dimension column over this table's rows, or None if they were not built."""
        path = self._extra_path(f"join_{join.dimension}_{join.fact_key}")
        if f"{path}/{packing.VALUES}" not in self._opened and not (self.packed and self._layers(path)):
            return None
        mine = F.col("column").isNull() if column == packing.PRESENT else F.col("column") == column
        return self._opened[f"{path}/{packing.VALUES}"].where(mine)

    def write_mark(self, name: str, holds) -> None:
        """Containers of the rows for which a condition holds, for example those of a sample."""
        path = self._extra_path(f"mark_{name}")
        if f"{path}/{packing.VALUES}" in self._opened or self._layers(path):
            return
        rows = self.rows()
        marked = rows.where(holds(rows) if callable(holds) else holds).select("rid", F.lit(1).cast("bigint").alias("mark"))
        kinds = TableSpec(name, {"mark": "int"})
        self._write_layers(packing.pack_rows(marked, kinds, {}, self.bins), path)

    def mark(self, name: str) -> DataFrame:
        return self._layer(self._extra_path(f"mark_{name}"), packing.VALUES)


# --- exact answers ---------------------------------------------------------


def write_truth(answer: DataFrame, folder: str, dataset: str, workload: str, idx: int) -> None:
    """Keep one exact answer under its workload and position."""
    keyed = answer.select(F.col("grp").cast("string").alias("grp"), "value")
    keyed.write.mode("overwrite").parquet(f"{folder}/truth/dataset={dataset}/workload={workload}/idx={idx}")


def read_truth(spark: SparkSession, folder: str, dataset: str, workload: str, idx: int, grp_type: str) -> DataFrame:
    """Replay an exact answer; only the folder of that query is listed and read."""
    path = f"{folder}/truth/dataset={dataset}/workload={workload}/idx={idx}"
    return spark.read.parquet(path).select(F.col("grp").cast(grp_type).alias("grp"), "value")


# --- metrics ---------------------------------------------------------------


def formatted(metrics: DataFrame, header: Sequence[str]) -> DataFrame:
    """Columns of the header only, floats with four decimals, missing ones empty."""
    kinds = dict(metrics.dtypes)

    def cell(name: str):
        if name not in kinds:
            return F.lit(None).cast("string").alias(name)
        if kinds[name] in ("double", "float"):
            text = F.format_string("%.4f", F.col(name))
            return F.when(F.col(name).isNotNull(), text).alias(name)
        return F.col(name).cast("string").alias(name)

    return metrics.select(*[cell(name) for name in header])


def write_metrics_csv(metrics: DataFrame, path: str, header: Sequence[str]) -> None:
    """One CSV with header per workload (a line per statement, so one file)."""
    ordered = metrics.orderBy("idx") if "idx" in metrics.columns else metrics
    formatted(ordered, header).coalesce(1).write.mode("overwrite").option("header", True).csv(path)
