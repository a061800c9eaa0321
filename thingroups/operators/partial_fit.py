"""Fitted statistics that merge: stored sums and value counts of parts of a table.

A part, for example the rows of a day, is read once. What is kept of it are sums and
counts for each group and column, and counts for each value; parts are merged by
adding these up, so that the fit of all parts is the fit of all rows. The levels that
generation reads are written once for each set of parts. A query's equalities are
fitted on the answer sample; groups that it lacks back off to the level of the group.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from hashlib import sha1

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thingroups.operators.filters import where_all
from thingroups.operators.generate import Fit, _level, complete_rows, model_path
from thingroups.operators.stats import long_form
from thingroups.sources.storage import write_once
from thingroups.spec import Predicate, TableSpec

#: The line that counts the rows of a group.
ROWS = ""


def _exact_type(spec: TableSpec) -> str:
    return f"decimal(38,{max([0, *spec.scales.values()])})"


def partial_fit(rows: DataFrame, spec: TableSpec, group: str, columns: Sequence[str] | None = None) -> DataFrame:
    """(grp, column, value, n, exact, total) of one part: for a numeric column its values and their sum
    (``exact`` where decimals are declared), for any other the rows of each value. Rows with a NULL
    in ``columns`` do not count."""
    columns = list(columns or spec.columns)
    data = complete_rows(rows, columns).select(*columns).withColumn("grp", F.col(group))
    exact = _exact_type(spec)
    cells, sums = [], [F.count(F.lit(1)).alias("n_rows")]
    none = F.lit(None)

    def line(column: str, n: Column, in_decimals: Column, total: Column) -> Column:
        return F.struct(
            F.lit(column).alias("column"), none.cast("string").alias("value"), n.alias("n"), in_decimals.cast(exact).alias("exact"), total.cast("double").alias("total")
        )

    cells.append(line(ROWS, F.col("n_rows"), none, none))
    for i, c in enumerate(c for c in columns if spec.kinds[c] == "num" and c != group):
        scale = spec.scales.get(c)
        x = F.col(c).cast("double") if scale is None else F.col(c).cast(f"decimal(18,{scale})")
        sums += [F.count(x).alias(f"n_{i}"), F.sum(x).alias(f"s_{i}")]
        cells.append(line(c, F.col(f"n_{i}"), none if scale is None else F.col(f"s_{i}"), F.col(f"s_{i}") if scale is None else none))
    moments = data.groupBy("grp").agg(*sums).select("grp", F.inline(F.array(*cells)))
    categorical = [c for c in columns if spec.kinds[c] != "num" and c != group]
    if not categorical:
        return moments
    counts = long_form(data, categorical, ["grp"]).groupBy("grp", "column", "value").agg(F.count(F.lit(1)).alias("n"))
    return moments.unionByName(counts.select("grp", "column", "value", "n", none.cast(exact).alias("exact"), none.cast("double").alias("total")))


def merged(parts: Sequence[DataFrame], by: Sequence[str] = ("grp",)) -> DataFrame:
    """Parts added up, for each group or (``by`` empty) over all of them."""
    lines = reduce(DataFrame.unionByName, parts)
    return lines.groupBy(*by, "column", "value").agg(*[F.sum(c).alias(c) for c in ("n", "exact", "total")])


def _fitted(lines: DataFrame, spec: TableSpec, group: str, columns: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Means and most frequent values out of merged lines, in the shape of a fitted level."""
    mine = lambda c, x: F.max(F.when(F.col("column") == c, x))
    total = F.coalesce(F.col("exact").cast("double"), F.col("total"))
    rank = F.struct((-F.col("n")).alias("n"), F.col("value").alias("value"))
    made = [mine(ROWS, F.col("n")).alias("fit_rows")]
    made += [mine(c, F.try_divide(total, F.col("n"))).alias(c) for c in columns if spec.kinds[c] == "num" and c != group]
    made += [F.min_by("value", F.when(F.col("column") == c, rank)).alias(c) for c in columns if spec.kinds[c] != "num" and c != group]
    return lines.groupBy(*by).agg(*made)


class StoredModel:
    """Parts of one table's model, and the levels of all that were added."""

    def __init__(self, spark: SparkSession, spec: TableSpec, group: str, folder: str, dataset: str = "", columns: Sequence[str] | None = None):
        self.spark, self.spec, self.group = spark, spec, group
        self.columns = list(columns or spec.columns)
        self.path = f"{model_path(folder, dataset, spec, group, self.columns)}/parts"
        self._parts: dict[str, DataFrame] = {}
        self._levels: dict[str, tuple[DataFrame, DataFrame]] = {}

    def add(self, name: str, rows: DataFrame) -> None:
        """Read a part and keep its sums; a part of that name that is there already is not read again."""
        self._parts[name] = write_once(partial_fit(rows, self.spec, self.group, self.columns), f"{self.path}/{name}")

    def levels(self) -> tuple[DataFrame, DataFrame]:
        """By group, and overall, of the parts added so far; written or looked up once for each set of parts."""
        if not self._parts:
            raise ValueError("no part was added")
        parts = [self._parts[name] for name in sorted(self._parts)]
        place = f"{self.path}-{sha1(repr(sorted(self._parts)).encode()).hexdigest()[:16]}"
        if place in self._levels:
            return self._levels[place]
        # groups with few rows have many lines in all: add up first, then look at values
        by_group = merged(parts)
        shape = lambda lines, by: _fitted(lines, self.spec, self.group, self.columns, by)
        self._levels[place] = (
            write_once(shape(by_group, ["grp"]), f"{place}/by_group"),
            write_once(shape(merged(parts, ()), []), f"{place}/overall"),
        )
        return self._levels[place]

    def fit(self, predicates: Sequence[Predicate] = (), sample: DataFrame | None = None) -> Fit:
        """The fit of a query; its equalities are learned from ``sample``, if there is one."""
        by_group, overall = self.levels()
        equal = [p for p in predicates if not p.is_range and p.column in self.columns and p.column != self.group]
        by_equal = None
        if equal and sample is not None:
            data = where_all(complete_rows(sample, self.columns).select(*self.columns), equal, self.spec)
            by_equal = _level(data, self.spec, self.columns, self.group)
        return Fit(self.spec, self.group, self.columns, by_equal, by_group, overall)
