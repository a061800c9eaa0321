"""Catalog: declared tables, their DataFrames and their learned bounds."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from thingroups.functions.draws import keep, salted
from thingroups.operators import stats
from thingroups.spec import AggQuery, TableSpec


class Catalog:
    """Facts and dimensions under their names.

    Bounds are learned once per table by one aggregation and kept on the driver:
    two numbers per declared column, whatever the size of the table.
    """

    def __init__(
        self,
        spark: SparkSession,
        specs: Mapping[str, TableSpec],
        frames: Mapping[str, DataFrame],
        name: str = "default",
    ):
        self.spark = spark
        self.name = name  # stored artefacts are kept apart by it
        self.specs = dict(specs)
        self.frames = dict(frames)
        self._bounds: dict[str, dict[str, tuple[float, float]]] = {}
        #: Tables read from Parquet files, whose rows can be named by file and place.
        self.in_files: frozenset[str] = frozenset()
        #: Stored statistics of tables (``domain.StoredDomains``), used in place of a scan.
        self.domains: dict = {}

    @classmethod
    def from_files(
        cls,
        spark: SparkSession,
        specs: Mapping[str, TableSpec],
        folder: str,
        fmt: str = "parquet",
        suffix: str | None = None,
        name: str = "default",
        **options,
    ) -> "Catalog":
        """Read every declared table with Spark's own reader for ``fmt``."""
        suffix = f".{fmt}" if suffix is None else suffix
        frames = {
            table: spark.read.format(fmt).options(**options).load(f"{folder}/{table}{suffix}") for table in specs
        }
        catalog = cls(spark, specs, frames, name)
        catalog.in_files = frozenset(specs if fmt == "parquet" else ())
        return catalog

    @classmethod
    def from_jdbc(
        cls,
        spark: SparkSession,
        specs: Mapping[str, TableSpec],
        url: str,
        partition_on: Mapping[str, tuple[str, int, int, int]] | None = None,
        name: str = "default",
        **options,
    ) -> "Catalog":
        """Read every declared table through Spark's JDBC source.

        ``partition_on[table] = (column, lower, upper, partitions)`` splits the
        read over tasks; without it Spark reads a JDBC table in one task.
        """
        frames = {}
        for table in specs:
            reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
            if partition_on and table in partition_on:
                column, lower, upper, parts = partition_on[table]
                reader = reader.options(
                    partitionColumn=column, lowerBound=lower, upperBound=upper, numPartitions=parts
                )
            frames[table] = reader.load()
        return cls(spark, specs, frames, name)

    @property
    def facts(self) -> list[str]:
        return [name for name, spec in self.specs.items() if spec.is_fact]

    def spec(self, table: str) -> TableSpec:
        return self.specs[table]

    def frame(self, table: str) -> DataFrame:
        return self.frames[table]

    def tables_of(self, query: AggQuery) -> list[str]:
        return [query.table] if query.join is None else [query.table, query.join.dimension]

    def scale(self, column: str, table: str) -> int | None:
        return self.specs[table].scales.get(column)

    def bounds(self, table: str) -> dict[str, tuple[float, float]]:
        """Min and max of every orderable column (numeric and integer categorical)."""
        if table not in self._bounds:
            if table in self.domains:
                self._bounds[table] = self.domains[table].bounds()
                return self._bounds[table]
            spec, df = self.spec(table), self.frame(table)
            columns = [c for c, kind in spec.kinds.items() if kind != "str"]
            rows = stats.numeric_bounds(df, columns).collect() if columns else []
            self._bounds[table] = {r["column"]: (r["lo"], r["hi"]) for r in rows if r["lo"] is not None}
        return self._bounds[table]


def key_parts(df: DataFrame, spec: TableSpec) -> list[Column]:
    """The row key as text columns, different for different keys.

    NULL has a mark of its own and the separator is escaped. A double with declared
    decimals is printed with these, so that it reads alike everywhere; one that has
    more, or is not declared, is printed in full.
    """
    parts = []
    for name in spec.row_key:
        column, dtype = F.col(name), df.schema[name].dataType
        text = column.cast("string")
        if isinstance(dtype, (T.DoubleType, T.FloatType)) and name in spec.scales:
            short = column.try_cast(f"decimal(18,{spec.scales[name]})")
            text = F.when(short.cast("double") == column.cast("double"), short.cast("string")).otherwise(text)
        elif isinstance(dtype, T.StringType):
            text = F.replace(F.replace(column, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))
        parts.append(F.coalesce(text, F.lit("\\N")))
    return parts


# --- scans -----------------------------------------------------------------


def scan(catalog: Catalog, table: str) -> DataFrame:
    """Declared columns only; the rest never leaves the file."""
    return catalog.frame(table).select(*catalog.spec(table).columns)


def scan_stored(catalog: Catalog, table: str) -> DataFrame:
    """Declared columns plus the row key."""
    return catalog.frame(table).select(*catalog.spec(table).stored_columns)


def scan_bernoulli(
    catalog: Catalog,
    table: str,
    rate: float | None = None,
    seed: int = 42,
    salt: str = "index",
    native: bool = False,
) -> DataFrame:
    """Bernoulli sample of the rows, by default at the table's index rate.

    ``native`` takes Spark's own sampler: cheaper, but tied to the file splits.
    """
    spec = catalog.spec(table)
    rate = spec.index_rate if rate is None else rate
    df = scan_stored(catalog, table)
    if rate >= 1:
        return df
    if native:
        return df.sample(False, rate, seed)
    return df.where(keep(rate, salted(salt, seed), *key_parts(df, spec)))


def scan_with_locator(catalog: Catalog, table: str, physical: bool = False) -> DataFrame:
    """All columns plus a row locator.

    The locator is the text of the row key, or with ``physical`` the file and
    the row number within it.
    """
    df = catalog.frame(table)
    if physical:
        place = F.concat_ws("#", F.col("_metadata.file_path"), F.col("_metadata.row_index").cast("string"))
        return df.select("*", place.alias("locator"))
    return df.select("*", F.concat_ws("|", *key_parts(df, catalog.spec(table))).alias("locator"))


def fetch_by_locator(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows whose locator is in ``wanted``; Spark broadcasts the list while it is small."""
    return rows.join(wanted.select("locator"), "locator", "left_semi")
