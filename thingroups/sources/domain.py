"""Stored statistics of a table's columns, kept for each file and merged when they are opened.

A file is read once, when it is new: rows and NULLs, exact extremes, mean and squared
deviations, a HyperLogLog sketch of its distinct values and, for ordered columns, a KLL sketch of
its quantiles. Later opens read these lines only; files that are gone drop out.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thingroups.functions.numbers import as_number
from thingroups.sources.catalog import Catalog
from thingroups.sources.storage import published, write_once

#: More files than this are not named one by one in a filter.
MOST_NAMED_FILES = 10_000
HLL_BITS, KLL_SIZE = 14, 400


def local_form(file: str) -> str:
    """A file's name as rows have it: Spark writes local ones with one slash there and three elsewhere."""
    return re.sub(r"^file:/+", "file:/", file)


def plain_name(file: str) -> str:
    return unquote(local_form(file))


class StoredDomains:
    """Statistics of all declared columns of one table of Parquet files."""

    def __init__(self, catalog: Catalog, table: str, folder: str):
        if table not in catalog.in_files:
            raise ValueError(f"'{table}' is not read from Parquet files")
        self.catalog, self.table, self.spec = catalog, table, catalog.spec(table)
        self.path = f"{folder}/domains/{catalog.name}/{table}"

    def _batches(self) -> list[DataFrame]:
        found = []
        while (batch := published(self.catalog.spark, f"{self.path}/batch-{len(found)}")) is not None:
            found.append(batch)
        return found

    def _lines(self, rows: DataFrame) -> DataFrame:
        """A line for each file and column."""
        sums, cells = [], []
        for i, (c, kind) in enumerate(self.spec.kinds.items()):
            dtype = rows.schema[c].dataType
            ordered = kind != "str"
            x = as_number(F.col(c), dtype) if ordered else F.lit(None).cast("double")
            sums += [
                F.count(c).alias(f"n_{i}"), F.min(x).alias(f"lo_{i}"), F.max(x).alias(f"hi_{i}"), F.avg(x).alias(f"mean_{i}"),
                F.var_pop(x).alias(f"var_{i}"), F.hll_sketch_agg(F.col(c).cast("string"), HLL_BITS).alias(f"hll_{i}"),
            ]
            if ordered:
                sums.append(F.kll_sketch_agg_double(x, KLL_SIZE).alias(f"kll_{i}"))
            cells.append(
                F.struct(
                    F.lit(c).alias("column"),
                    F.col(f"n_{i}").alias("n"),
                    (F.col("n_rows") - F.col(f"n_{i}")).alias("n_null"),
                    *[F.col(f"{s}_{i}").alias(s) for s in ("lo", "hi", "mean", "var", "hll")],
                    (F.col(f"kll_{i}") if ordered else F.lit(None).cast("binary")).alias("kll"),
                )
            )
        by_file = rows.groupBy("file").agg(F.count(F.lit(1)).alias("n_rows"), *sums)
        return by_file.select("file", F.inline(F.array(*cells)))

    def _known(self) -> dict[str, str]:
        """Stored file names by their plain form."""
        return {plain_name(r["file"]): r["file"] for b in self._batches() for r in b.select("file").distinct().toLocalIterator()}

    def refresh(self) -> int:
        """Read the files that are not known yet; how many there were."""
        frame, known = self.catalog.frame(self.table), self._known()
        new = [f for f in sorted(frame.inputFiles()) if plain_name(f) not in known]
        if new:
            forms = sorted({form for f in new for form in (f, local_form(f), plain_name(f))})
            rows = frame.select(*self.spec.columns, F.col("_metadata.file_path").alias("file"))
            if len(new) <= MOST_NAMED_FILES:
                rows = rows.where(F.col("file").isin(forms))
            else:
                files = self.catalog.spark.createDataFrame([(f,) for f in forms], "file string")
                rows = rows.join(files, "file", "left_semi")
            write_once(self._lines(rows), f"{self.path}/batch-{len(self._batches())}")
        return len(new)

    def lines(self) -> DataFrame:
        """The lines of all files that the table has now. Files without rows have none."""
        if not self._batches():
            self.refresh()
        known = self._known()
        here = [(known[f],) for f in map(plain_name, self.catalog.frame(self.table).inputFiles()) if f in known]
        batches = self._batches()
        lines = batches[0]
        for batch in batches[1:]:
            lines = lines.unionByName(batch)
        return lines.join(self.catalog.spark.createDataFrame(here, "file string"), "file", "left_semi")

    def merged(self) -> DataFrame:
        """(column, n, n_null, lo, hi, mean, std, n_values, kll) over all files."""
        lines = self.lines()
        middle = lines.groupBy("column").agg((F.sum(F.col("mean") * F.col("n")) / F.nullif(F.sum("n"), F.lit(0))).alias("middle"))
        apart = F.col("var") * F.col("n") + F.col("n") * F.pow(F.col("mean") - F.col("middle"), 2)
        return (
            lines.join(middle, "column")
            .groupBy("column")
            .agg(
                F.sum("n").alias("n"),
                F.sum("n_null").alias("n_null"),
                F.min("lo").alias("lo"),
                F.max("hi").alias("hi"),
                F.first("middle").alias("mean"),
                F.sqrt(F.sum(apart) / F.nullif(F.sum("n") - 1, F.lit(0))).alias("std"),
                F.hll_sketch_estimate(F.hll_union_agg("hll")).alias("n_values"),
                F.kll_merge_agg_double("kll").alias("kll"),
            )
        )

    def bounds(self) -> dict[str, tuple[float, float]]:
        """Exact extremes of the ordered columns: two numbers a column."""
        rows = self.lines().groupBy("column").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect()
        return {r["column"]: (r["lo"], r["hi"]) for r in rows if r["lo"] is not None}

    def quantiles(self, column: str, ranks: Sequence[float]) -> list[float]:
        """Approximate quantiles of an ordered column."""
        asked: Column = F.array(*[F.lit(float(r)) for r in ranks])
        line = self.merged().where(F.col("column") == column).select(F.kll_sketch_get_quantile_double("kll", asked).alias("q")).first()
        return list(line["q"])
