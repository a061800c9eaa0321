"""Conditional row generation by sets.

Fitting is aggregation: averages and most frequent values of every column, per
group under the query's equalities, per group, and overall. Generating is a
join: requested rows are laid out with their known cells, and each open cell
takes the value of the most specific level that has one.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import cached_property, reduce
from hashlib import sha1

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from thingroups.functions import sums
from thingroups.functions.draws import digest, fine_unit, salted, unit
from thingroups.functions.numbers import from_number, number_of
from thingroups.operators.filters import literal, where_all
from thingroups.operators.sampling import at_most, rank_cuts
from thingroups.operators.stats import long_form, norm_stats, value_counts
from thingroups.sources.catalog import key_parts
from thingroups.sources.storage import cut, write_once
from thingroups.spec import Between, Predicate, TableSpec


# --- ranks without a single task --------------------------------------------


def distributed_rank(
    df: DataFrame, by: Sequence[str], order: Column, ties: Sequence[str], name: str = "rank", digits: int = 3
) -> DataFrame:
    """Rank from 1 within ``by`` in the order of a digest, even for one huge group.

    Rows are ranked within cells of equal leading digits; the rows of the cells
    before it shift each cell. A group is spread over 16^digits tasks' worth of
    cells, and the shifts are at most that many lines per group.
    """
    cells = df.withColumn("rank_digest", order).withColumn("rank_cell", F.substring("rank_digest", 1, digits))
    lead = Window.partitionBy(*by).orderBy("rank_cell").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        cells.groupBy(*by, "rank_cell")
        .agg(F.count(F.lit(1)).alias("cell_rows"))
        .withColumn("shift", F.coalesce(F.sum("cell_rows").over(lead), F.lit(0)))
        .drop("cell_rows")
    )
    inner = Window.partitionBy(*by, "rank_cell").orderBy("rank_digest", *ties)
    ranked = cells.withColumn("within", F.row_number().over(inner)).join(shifts, [*by, "rank_cell"])
    return ranked.select(*df.columns, (F.col("shift") + F.col("within")).alias(name))


# --- encoding ---------------------------------------------------------------


def category_dictionary(df: DataFrame, columns: Sequence[str], seed: int = 42) -> DataFrame:
    """``(column, value, code)`` with dense codes from 0 per column.

    Which value gets which code is immaterial; hash order lets a large domain
    be numbered in parallel. The dictionary is checkpointed: encoding and
    decoding read it once per column.
    """
    values = long_form(df, columns).where(F.col("value").isNotNull()).distinct()
    ranked = distributed_rank(values, ["column"], digest(salted("code", seed), "column", "value"), ["value"], "code")
    return cut(ranked.withColumn("code", F.col("code") - 1))


def category_encode(df: DataFrame, dictionary: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Replace values by codes; an unknown value becomes NULL."""
    for c in columns:
        codes = dictionary.where(F.col("column") == c).select(F.col("value").alias("dict_value"), "code")
        df = df.join(codes, F.col(c).cast("string") == F.col("dict_value"), "left")
        df = df.withColumn(c, F.col("code")).drop("code", "dict_value")
    return df


def category_decode(df: DataFrame, dictionary: DataFrame, types: Mapping[str, T.DataType]) -> DataFrame:
    """Inverse of :func:`category_encode`."""
    for c, dtype in types.items():
        codes = dictionary.where(F.col("column") == c).select(F.col("value").alias("dict_value"), "code")
        df = df.join(codes, F.col(c) == F.col("code"), "left")
        df = df.withColumn(c, F.col("dict_value").cast(dtype)).drop("code", "dict_value")
    return df


def _norms(df: DataFrame, spec: TableSpec) -> dict[str, tuple[float, float]]:
    """Two numbers per declared column, on the driver."""
    return {r["column"]: (r["mean"], r["std"]) for r in norm_stats(df, spec).collect()}


def standardize(df: DataFrame, spec: TableSpec, norms: Mapping[str, tuple[float, float]] | None = None) -> DataFrame:
    norms = norms or _norms(df, spec)
    scaled = {c: F.try_divide(F.col(c) - F.lit(norms[c][0]), F.lit(norms[c][1])) for c in spec.numeric}
    return df.withColumns(scaled)


def unstandardize(df: DataFrame, spec: TableSpec, norms: Mapping[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: F.col(c) * F.lit(norms[c][1]) + F.lit(norms[c][0]) for c in spec.numeric})


# --- condition rows -----------------------------------------------------------


def condition_rows(
    requests: DataFrame,
    predicates: Sequence[Predicate | Between],
    group: str,
    spec: TableSpec,
    types: Mapping[str, T.DataType],
    bounds: Mapping[str, tuple[float, float]],
    n: int,
    seed: int = 42,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """``n`` rows per requested group with the conditioned cells filled, others NULL.

    Equality gives the constant, a range a uniform draw between the literal and
    the end of the domain. Of several conditions on one column the last holds,
    and the group's own value comes last of all. Output: ``grp, i`` and columns.
    """
    columns = list(columns or spec.columns)
    rows = requests.select("grp", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("i"))
    last = {p.column: p for p in predicates if p.column in spec.kinds}
    cells = []
    for c in columns:
        p, dtype = last.get(c), types[c]
        if c == group:
            cell = F.col("grp")
        elif p is None:
            cell = F.lit(None)
        elif isinstance(p, Between) or (p.is_range and spec.kinds[c] == "num"):
            if isinstance(p, Between):
                lo, hi = p.lo, p.hi
            else:
                v = number_of(p.value, dtype)
                lo, hi = (v, bounds[c][1]) if p.op in (">", ">=") else (bounds[c][0], v)
            u = unit(salted("condition", seed), F.lit(c), F.col("grp"), F.col("i"))
            cell = from_number(F.lit(float(lo)) + u * F.lit(float(hi) - float(lo)), dtype)
        else:
            cell = literal(p.value, spec.kinds[c], dtype)
        cells.append(cell.cast(dtype).alias(c))
    return rows.select("grp", "i", *cells)


# --- fitting ------------------------------------------------------------------


def _level(rows: DataFrame, spec: TableSpec, columns: Sequence[str], group: str | None) -> DataFrame:
    """Mean (numeric) and most frequent value (categorical) of every column.

    Values are counted before the most frequent one is chosen, so no task sees
    all rows of a group; ties go to the smaller text.
    """
    by = [] if group is None else [F.col(group).alias("grp")]
    numeric = [c for c in columns if spec.kinds[c] == "num" and c != group]
    categorical = [c for c in columns if spec.kinds[c] != "num" and c != group]
    fitted = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("fit_rows"), *[sums.mean(F.col(c), spec.scales.get(c)).alias(c) for c in numeric]
    )
    if not categorical:
        return fitted
    keyed = rows if group is None else rows.withColumn("grp", F.col(group))
    keep = [] if group is None else ["grp"]
    counts = long_form(keyed, categorical, keep).groupBy(*keep, "column", "value").agg(F.count(F.lit(1)).alias("n"))
    rank = F.struct((-F.col("n")).alias("n"), F.col("value").alias("value"))
    modes = counts.groupBy(*keep).agg(
        *[F.min_by("value", F.when(F.col("column") == c, rank)).alias(c) for c in categorical]
    )
    if group is None:
        # One row of means and one of modes: each column has a value in one of them.
        both = fitted.unionByName(modes, allowMissingColumns=True)
        return both.agg(*[F.max(c).alias(c) for c in both.columns])
    # Left, so that the whole counting side is dropped when no mode is asked for.
    return fitted.join(modes, "grp", "left")


@dataclass
class Fit:
    """Fitted levels, the most specific first; the overall level is one row."""

    spec: TableSpec
    group: str
    columns: list[str]
    by_equal: DataFrame | None
    by_group: DataFrame
    overall: DataFrame

    @cached_property
    def overall_values(self) -> dict:
        """One value per column, fetched once however often rows are filled."""
        return self.overall.first().asDict()

    def for_groups(self, names: Sequence) -> "Fit":
        """The same fit for a short list of groups; the list reaches the scan."""
        only = F.col("grp").isin(list(names))
        by_equal = None if self.by_equal is None else self.by_equal.where(only)
        short = Fit(self.spec, self.group, self.columns, by_equal, self.by_group.where(only), self.overall)
        short.__dict__["overall_values"] = self.overall_values
        return short


def complete_rows(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    return rows.na.drop(subset=list(columns))


def fit(
    rows: DataFrame,
    spec: TableSpec,
    group: str,
    predicates: Sequence[Predicate] = (),
    columns: Sequence[str] | None = None,
    fill: Sequence[str] | None = None,
) -> Fit:
    """Learn the conditional statistics from rows without NULLs in ``columns``.

    ``fill`` names the columns that will have open cells, by default all.
    """
    columns = list(columns or spec.columns)
    fill = columns if fill is None else list(fill)
    data = complete_rows(rows, columns).select(*columns)
    equal = [p for p in predicates if not p.is_range and p.column in columns and p.column != group]
    by_equal = _level(where_all(data, equal, spec), spec, fill, group) if equal else None
    return Fit(spec, group, columns, by_equal, _level(data, spec, fill, group), _level(data, spec, fill, None))


def model_path(folder: str, dataset: str, spec: TableSpec, group: str, columns: Sequence[str]) -> str:
    """What the levels depend on: the dataset, the table and its kinds, the group, the columns."""
    content = repr((dataset, sorted(spec.kinds.items()), sorted(spec.scales.items()), list(columns)))
    return f"{folder}/model/{spec.name}/{group}/{sha1(content.encode()).hexdigest()[:16]}"


def save_fit(fitted: Fit, folder: str, dataset: str = "") -> Fit:
    """Write the query-independent levels once; a later call reads them.

    ``dataset`` tells apart catalogs that keep their models in one folder.
    """
    base = model_path(folder, dataset, fitted.spec, fitted.group, fitted.columns)
    by_group = write_once(fitted.by_group, f"{base}/by_group")
    overall = write_once(fitted.overall, f"{base}/overall")
    return Fit(fitted.spec, fitted.group, fitted.columns, fitted.by_equal, by_group, overall)


def load_or_fit(
    rows: DataFrame,
    spec: TableSpec,
    group: str,
    folder: str,
    predicates: Sequence[Predicate] = (),
    columns: Sequence[str] | None = None,
    dataset: str = "",
) -> Fit:
    """Saved levels if there are any, else fit and save; equalities are fitted per query."""
    return save_fit(fit(rows, spec, group, predicates, columns), folder, dataset)  # a plan until it is written


# --- imputing -----------------------------------------------------------------

SALTS = 16


def impute(rows: DataFrame, fitted: Fit) -> DataFrame:
    """Fill NULL cells with the mean / most frequent value; known cells stay.

    ``rows`` must hold the fitted columns; other columns pass through.
    """
    group, columns = fitted.group, fitted.columns
    types = {f.name: f.dataType for f in rows.schema.fields}
    overall = fitted.overall_values
    levels = [(f, p) for f, p in ((fitted.by_equal, "eq_"), (fitted.by_group, "grp_")) if f is not None]

    def filled(rows: DataFrame, levels: list) -> DataFrame:
        cells = {}
        for c in columns:
            options = [F.col(prefix + c) for frame, prefix in levels if c in frame.columns]
            if c in overall:
                options.append(F.lit(overall[c]))
            cells[c] = F.coalesce(F.col(c), *[o.cast(types[c]) for o in options]) if options else F.col(c)
        return rows.select(*[cells[c].alias(c) if c in cells else F.col(c) for c in types])

    # Rows without a group match no level: they need no join, only the overall values.
    grouped, without = rows.where(F.col(group).isNotNull()), rows.where(F.col(group).isNull())
    # A level has one line for each group; each line comes once per salt, so that the
    # rows of a hot group meet it in as many tasks.
    salt = F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int")
    grouped = grouped.withColumn("salt", salt)
    for frame, prefix in levels:
        shown = frame.select(
            *[F.col(c).alias(prefix + c) for c in frame.columns],
            F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias(f"{prefix}salt"),
        )
        on = (F.col(group) == F.col(f"{prefix}grp")) & (F.col("salt") == F.col(f"{prefix}salt"))
        grouped = grouped.join(shown, on, "left")
    return filled(grouped, levels).unionByName(filled(without, []))


def impute_sampled(
    rows: DataFrame,
    donors: DataFrame,
    spec: TableSpec,
    group: str,
    request_key: Sequence[str],
    predicates: Sequence[Predicate] = (),
    imputations: int = 1,
    seed: int = 42,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Fill NULL cells from a fairly drawn real row, ``imputations`` times per row.

    Each request draws a position among the complete rows of its pool (group and
    equalities, else group, else all rows) and takes the open cells of the donor
    at that position. Every donor can be drawn. Donors are read three times per
    level; requests, which are few, are checkpointed in between.
    """
    columns = list(columns or spec.columns)
    key = key_parts(donors, spec)
    whole = complete_rows(donors, columns).select(*columns, F.concat_ws("|", *key).alias("donor_key"))
    whole = whole.withColumn("donor_digest", digest(salted("donor_rank", seed), "donor_key"))
    requests = rows.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(imputations))))
    requests = requests.withColumn("u", fine_unit(salted("donor", seed), *request_key, F.col("k")))
    asked = rows.select(group).distinct()

    equal = [p for p in predicates if not p.is_range and p.column in columns and p.column != group]
    pools = []
    if equal:
        pools.append(where_all(whole, equal, spec).join(asked, group, "left_semi"))
    pools.append(whole.join(asked, group, "left_semi"))

    open_requests, filled = requests, []
    for pool in pools:
        pool = pool.withColumn("pool", F.col(group))
        sized = _sized(open_requests.withColumn("pool", F.col(group)), pool)
        open_requests = sized.where(F.col("pool_rows").isNull()).drop("pool", "pool_rows", "parts")
        filled.append(_from_donors(sized.where(F.col("pool_rows").isNotNull()), pool, columns))
    if not open_requests.isEmpty():
        everything = whole.withColumn("pool", F.lit(0))
        filled.append(_from_donors(_sized(open_requests.withColumn("pool", F.lit(0)), everything), everything, columns))
    return reduce(DataFrame.unionByName, filled).select(*rows.columns, "k")


# A pool falls into cells by the leading digits of its digests, as many digits as keep
# a cell of the largest pool near this many rows; the requests to a pool are handled in
# parts of about that many.
CELL_ROWS = 65_536
REQUESTS_PER_PART = 100_000


def _cell_digits(pool_rows: int) -> int:
    digits = 4
    while pool_rows > CELL_ROWS * 16**digits:
        digits += 1
    return digits


def _sized(requests: DataFrame, pool: DataFrame) -> DataFrame:
    """Requests with the rows of their pool and the number of parts they are handled in."""
    donors = pool.groupBy("pool").agg(F.count(F.lit(1)).alias("pool_rows"))
    asks = requests.groupBy("pool").agg(F.ceil(F.count(F.lit(1)) / F.lit(REQUESTS_PER_PART)).alias("parts"))
    return cut(requests.join(donors.join(asks, "pool"), "pool", "left"))


def _from_donors(requests: DataFrame, pool: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Give each request the donor at position ``floor(u * pool_rows) + 1`` of its pool.

    Positions follow the donor digests. Donors are only counted per cell at
    first; a request is matched to the cell its position falls into, and none
    but these cells are ranked row by row.
    """
    largest = requests.agg(F.coalesce(F.max("pool_rows"), F.lit(0))).first()[0]
    pool = pool.withColumn("cell", F.substring("donor_digest", 1, _cell_digits(largest)))
    counts = pool.groupBy("pool", "cell").agg(F.count(F.lit(1)).alias("cell_rows"))
    before = Window.partitionBy("pool").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        counts.select("pool", "cell", F.coalesce(F.sum("cell_rows").over(before), F.lit(0)).alias("start"))
        .join(requests.select("pool", "parts").distinct(), "pool")
        .withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
    )

    # As-of match of positions to cell starts: sort both together, carry the cell on.
    position = (F.floor(F.col("u") * F.col("pool_rows")) + 1).cast("bigint")
    carried = [c for c in requests.columns if c not in ("pool", "pool_rows", "parts", "u")]
    asks = requests.select(
        "pool",
        F.pmod(F.xxhash64("u", *carried), F.col("parts")).alias("part"),
        position.alias("place"),
        F.lit(None).cast("string").alias("cell"),
        F.lit(None).cast("bigint").alias("start"),
        F.struct(*carried).alias("request"),
    )
    marks = starts.select(
        "pool", "part", (F.col("start") + 1).alias("place"), "cell", "start",
        F.lit(None).cast(asks.schema["request"].dataType).alias("request"),
    )
    along = Window.partitionBy("pool", "part").orderBy("place", F.col("request").isNotNull()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    placed = (
        marks.unionByName(asks)
        .withColumn("in_cell", F.last("cell", ignorenulls=True).over(along))
        .withColumn("from_start", F.last("start", ignorenulls=True).over(along))
        .where(F.col("request").isNotNull())
        .select("pool", F.col("in_cell").alias("cell"), (F.col("place") - F.col("from_start")).alias("within"), "request.*")
    )
    placed = cut(placed)
    inner = Window.partitionBy("pool", "cell").orderBy("donor_digest", "donor_key")
    ranked = (
        pool.join(placed.select("pool", "cell").distinct(), ["pool", "cell"], "left_semi")
        .withColumn("within", F.row_number().over(inner))
        .select("pool", "cell", "within", *[F.col(c).alias(f"from_{c}") for c in columns])
    )
    joined = placed.join(ranked, ["pool", "cell", "within"])
    return joined.select(
        *[F.coalesce(F.col(c), F.col(f"from_{c}")).alias(c) if c in columns else F.col(c) for c in carried]
    )


def accept_by_density(
    generated: DataFrame, data: DataFrame, column: str, key: Sequence[str], seed: int = 42
) -> DataFrame:
    """Keep a generated row with probability ``min(1, p_data(cell) / p_generated(cell))``."""
    n_data = data.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("cell")).agg(F.count(F.lit(1)).alias("n_data"))
    n_made = generated.groupBy(F.col(column).alias("cell")).agg(F.count(F.lit(1)).alias("n_made"))
    n_data, n_made = cut(n_data), cut(n_made)
    all_data = n_data.agg(F.coalesce(F.sum("n_data"), F.lit(0))).first()[0]
    all_made = n_made.agg(F.coalesce(F.sum("n_made"), F.lit(0))).first()[0]
    ratio = F.try_divide(F.coalesce("n_data", F.lit(0)) * F.lit(all_made), F.col("n_made") * F.lit(all_data))
    ratios = n_made.join(n_data, "cell", "left").select("cell", F.least(F.lit(1.0), ratio).alias("p_accept"))
    judged = generated.join(ratios, F.col(column) == F.col("cell"), "left").drop("cell")
    return judged.where(unit(salted("accept", seed), *key) <= F.col("p_accept")).drop("p_accept")


# --- masks ----------------------------------------------------------------------


def mask_random(df: DataFrame, spec: TableSpec, p: float, seed: int = 42, columns: Sequence[str] | None = None) -> DataFrame:
    """Hide each cell independently with probability ``p``; NULL cells stay hidden."""
    key = key_parts(df, spec)
    hidden = {
        c: F.when(unit(salted(f"mask_{c}", seed), *key) >= p, F.col(c)) for c in columns or spec.columns
    }
    return df.withColumns(hidden)


def mask_stratified(
    df: DataFrame, spec: TableSpec, r: float, seed: int = 42, pick_numeric: bool = False
) -> DataFrame:
    """Hide categorical cells in proportion to how frequent their value is.

    Per categorical column exactly ``floor(r * rows)`` rows are picked, and a
    picked cell is hidden with probability rows(value) / rows. Numeric cells are
    all hidden, or with ``pick_numeric`` those of ``floor(r * rows)`` picked rows.
    """
    key = key_parts(df, spec)
    names = spec.columns if pick_numeric else spec.categorical
    picks = {c: digest(salted(f"pick_{c}", seed), *key) for c in names}
    cuts = rank_cuts(df, picks, lambda total: F.floor(total * F.lit(r)))
    counts = cut(value_counts(df, spec.categorical))
    totals = {r_["column"]: r_["n"] for r_ in counts.groupBy("column").agg(F.sum("n").alias("n")).collect()}
    draws = {c: unit(salted(f"mask_{c}", seed), *key) for c in spec.categorical}
    hide = {}
    for c in spec.columns:
        if spec.kinds[c] == "num":
            hide[c] = at_most(picks[c], cuts[c]) if pick_numeric else F.lit(True)
        else:
            hide[c] = at_most(picks[c], cuts[c]) & (draws[c] < F.col(f"freq_{c}") / F.lit(totals.get(c, 1)))
    out = df
    for c in spec.categorical:
        mine = counts.where(F.col("column") == c).select(
            F.col("value").alias(f"value_{c}"), F.col("n").alias(f"freq_{c}")
        )
        out = out.join(mine, F.col(c).cast("string") == F.col(f"value_{c}"), "left")
    return out.select(*[F.when(~hide[c], F.col(c)).alias(c) if c in hide else F.col(c) for c in df.columns])


# --- validation ------------------------------------------------------------------


def imputation_score(
    train: DataFrame, validation: DataFrame, spec: TableSpec, group: str, p: float = 0.5, seed: int = 42
) -> DataFrame:
    """Quality of the fill on a masked hold-out, one line per column.

    Numeric columns: RMSE over the column's stddev; categorical: share of hidden
    cells filled right.
    """
    fitted = fit(train, spec, group)
    shown = [F.col(c).alias(f"true_{c}") for c in spec.columns]
    masked = mask_random(validation.select("*", *shown), spec, p, seed)
    marked = masked.withColumns({f"open_{c}": F.col(c).isNull() & F.col(f"true_{c}").isNotNull() for c in spec.columns})
    filled = impute(marked, fitted)
    lines = []
    for c in spec.columns:
        is_open = F.col(f"open_{c}")
        if spec.kinds[c] == "num":
            true = F.col(f"true_{c}").cast("double")
            gap = F.col(c).cast("double") - true
            spread = F.stddev_samp(F.when(is_open, true))
            value = F.try_divide(F.sqrt(F.avg(F.when(is_open, gap * gap))), spread)
            metric = "nrmse"
        else:
            right = (F.col(c) == F.col(f"true_{c}")).cast("double")
            value, metric = F.avg(F.when(is_open, right)), "accuracy"
        lines.append(
            F.struct(F.lit(c).alias("column"), F.lit(metric).alias("metric"), value.alias("score"),
                     F.count(F.when(is_open, 1)).alias("n_hidden"))
        )
    return filled.agg(F.array(*lines).alias("lines")).select(F.inline("lines"))
