"""Uniform samples, rare-group top-up and weighted choices."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thingroups.functions.draws import digest, keep, salted, unit_open
from thingroups.operators.relational import filtered_frames
from thingroups.sources.catalog import Catalog, key_parts, scan_stored
from thingroups.sources.storage import write_once
from thingroups.spec import AggQuery, TableSpec

SAMPLE_SALT = "u1"
TOPUP_SALT = "topup"

# Above this many rows the cell that holds a cut is split once more by its next
# hex digits before single digests are counted.
CELL_ROWS = 65_536


# --- uniform samples -------------------------------------------------------


def in_sample(df: DataFrame, spec: TableSpec, rate: float, seed: int, algo: str = "md5") -> Column:
    """Whether a row belongs to the answer sample; a pure function of its key."""
    return keep(rate, salted(SAMPLE_SALT, seed), *key_parts(df, spec), algo=algo)


def uniform_sample(
    df: DataFrame, spec: TableSpec, rate: float, seed: int = 42, native: bool = False, algo: str = "md5"
) -> DataFrame:
    """Bernoulli sample without a shuffle; ``native`` uses Spark's own sampler."""
    if native:
        return df.sample(False, rate, seed)
    return df.where(in_sample(df, spec, rate, seed, algo))


def rank_cuts(
    df: DataFrame,
    digests: Mapping[str, Column],
    size_of: Callable[[Column], Column],
    ties: dict[str, tuple[int, int]] | None = None,
) -> dict[str, str | None]:
    """Per name, the digest of the last row among the ``size_of(rows)`` lowest.

    Rows with equal keys share a digest. If only some of those at the cut are among
    the lowest, ``ties`` is given how many, and of how many.

    No global sort: rows are counted per leading hex digits (partial
    aggregation, at most 65,536 cells a name), the cell in which the running
    count crosses the target is found, and only that cell is looked into
    further. One row per name comes back to the driver.
    """
    lines = df.select(
        F.explode(F.array(*[F.struct(F.lit(n).alias("name"), d.alias("digest")) for n, d in digests.items()]))
    ).select("col.name", "col.digest")
    by_name = Window.partitionBy("name")
    running = by_name.orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)

    cuts: dict[str, str | None] = {name: None for name in digests}
    pending: dict[str, tuple[str, int | None]] = {name: ("", None) for name in digests}
    digits = 4
    while pending:
        inside, target = F.lit(False), F.lit(None).cast("bigint")
        for name, (prefix, left) in pending.items():
            mine = F.col("name") == name
            inside = inside | (mine & F.col("digest").startswith(prefix))
            wanted = size_of(F.col("total")).cast("bigint") if left is None else F.lit(left)
            target = F.when(mine, wanted).otherwise(target)
        cells = (
            lines.where(inside)
            .groupBy("name", F.substring("digest", 1, digits).alias("cell"))
            .agg(F.count(F.lit(1)).alias("n"), F.max("digest").alias("top"))
            .withColumn("total", F.sum("n").over(by_name))
            .withColumn("upto", F.sum("n").over(running))
            .withColumn("target", target)
        )
        # The crossing cell; a target at or above the total takes the last one.
        wanted = F.least("target", "total")
        crossing = cells.where((F.col("upto") >= wanted) & (F.col("upto") - F.col("n") < wanted)).collect()
        still: dict[str, tuple[str, int | None]] = {}
        for row in crossing:
            left = min(row["target"], row["total"]) - (row["upto"] - row["n"])
            if left == row["n"] or digits >= 32:
                cuts[row["name"]] = row["top"]
                if left < row["n"] and ties is not None:
                    ties[row["name"]] = (left, row["n"])
            else:
                still[row["name"]] = (row["cell"], left)
        deeper = any(r["n"] > CELL_ROWS for r in crossing if r["name"] in still)
        digits = digits + 4 if deeper else 32
        pending = still
    return cuts


def at_most(hexdigest: Column, cut: str | None) -> Column:
    return F.lit(False) if cut is None else hexdigest <= F.lit(cut)


def exact_sample(
    df: DataFrame, spec: TableSpec, rate: float, seed: int = 42, salt: str = SAMPLE_SALT
) -> DataFrame:
    """Simple random sample of exactly ``round(rate * rows)`` rows, without replacement."""
    order = digest(salted(salt, seed), *key_parts(df, spec))
    return lowest(df, order, lambda total: F.bround(total * F.lit(rate), 0))[0]


def lowest(
    df: DataFrame, order: Column, size_of: Callable[[Column], Column], same: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Exactly ``size_of(rows)`` rows of lowest digest, and the others.

    Rows of one key at the cut are told apart by all their columns; rows that are
    the ``same`` in all of them are interchangeable.
    """
    ties: dict[str, tuple[int, int]] = {}
    cut = rank_cuts(df, {"all": order}, size_of, ties)["all"]
    if not ties:
        return df.where(at_most(order, cut)), df.where(~at_most(order, cut))
    shared, (wanted, there) = df.where(order == cut), ties["all"]
    if same:
        chosen, rest = shared.limit(wanted), shared.limit(there - wanted)
    else:
        cells = [F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in df.columns]
        chosen, rest = lowest(shared, digest("tie", *cells), lambda total: F.lit(wanted), same=True)
    return df.where(order < cut).unionByName(chosen), df.where(order > cut).unionByName(rest)


def sample_frames(
    catalog: Catalog, tables: list[str], rate: float, seed: int = 42, algo: str = "md5"
) -> dict[str, DataFrame]:
    """Facts sampled, dimensions whole."""
    frames = {}
    for table in tables:
        df, spec = scan_stored(catalog, table), catalog.spec(table)
        frames[table] = uniform_sample(df, spec, rate, seed, algo=algo) if spec.is_fact else df
    return frames


def cached_sample(
    catalog: Catalog, rate: float, seed: int = 42, folder: str | None = None
) -> dict[str, DataFrame]:
    """Sample once for a whole workload.

    With ``folder`` (shared storage) the fact samples are written once and read
    back; otherwise they are persisted, and a lost part is drawn again alike.
    """
    frames = sample_frames(catalog, list(catalog.specs), rate, seed)
    for table in catalog.facts:
        if folder is None:
            frames[table] = frames[table].persist()
        else:
            path = f"{folder}/sample/{catalog.name}/{table}_{rate}_{seed}"
            frames[table] = write_once(frames[table], path)
    return frames


def filtered_sample(catalog: Catalog, query: AggQuery, frames: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """The query's predicates applied to the cached sample, table by table."""
    return filtered_frames(catalog, query, frames)


def train_validation_split(
    df: DataFrame, spec: TableSpec, ratio: float = 0.15, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """Exact hold-out of ``ceil(ratio * rows)`` rows; returns (train, validation)."""
    order = digest(salted("holdout", seed), *key_parts(df, spec))
    held, rest = lowest(df, order, lambda total: F.ceil(total * F.lit(ratio)))
    return rest, held


# --- rare groups -----------------------------------------------------------


def rare_groups(predicted: DataFrame, sizes: DataFrame, wanted: int) -> DataFrame:
    """Predicted groups with fewer than ``wanted`` sample rows: ``(grp, n, need)``."""
    seen = sizes.select("grp", F.col("n").alias("seen"))
    n = F.coalesce("seen", F.lit(0))
    return (
        predicted.select("grp")
        .join(seen, "grp", "left")
        .where(n < wanted)
        .select("grp", n.alias("n"), (F.lit(wanted) - n).alias("need"))
    )


def topup_rows(
    candidates: DataFrame,
    group: str,
    rare: DataFrame,
    wanted: int,
    key: list[Column],
    seed: int = 42,
) -> DataFrame:
    """Up to ``need`` random candidate rows for every rare group, all groups in one job.

    Only rows of rare groups are ranked; Spark sends these groups' names around while they are
    few. A need never exceeds ``wanted``, so each task drops all but ``wanted`` rows of a
    group before the shuffle, and a group with a third of all rows costs no more than any other.
    """
    order = Window.partitionBy(group).orderBy("draw", "draw_key")
    needs = rare.select(F.col("grp").alias(group), "need")
    ranked = (
        candidates.join(needs, group).withColumn("draw", digest(salted(TOPUP_SALT, seed), *key))
        .withColumn("draw_key", F.concat_ws("|", *key))
        .withColumn("draw_rank", F.row_number().over(order))
        .where((F.col("draw_rank") <= wanted) & (F.col("draw_rank") <= F.col("need")))
    )
    return ranked.select(*candidates.columns)


def union_rows(sample: DataFrame, extra: DataFrame) -> DataFrame:
    """Append rows, in the column types of the sample; absent columns become NULL."""
    types = {f.name: f.dataType for f in sample.schema.fields}
    shaped = [
        (F.col(c).cast(t) if c in extra.columns else F.lit(None).cast(t)).alias(c) for c, t in types.items()
    ]
    return sample.unionByName(extra.select(*shaped))


# --- weighted choice -------------------------------------------------------


def supply_weight(n: Column) -> Column:
    """Exploration weight of a group with ``n`` rows."""
    return F.lit(1.0) / (F.lit(1.0) + n / F.lit(100.0))


def choice_score(group: Column, weight: Column, draw: Column | int, seed: int = 42) -> Column:
    """Exponential race: the lowest score wins with probability weight / total weight."""
    draw = draw if isinstance(draw, Column) else F.lit(draw)
    return -F.log(unit_open(salted("choice", seed), draw, group)) / weight


def weighted_choice(groups: DataFrame, draw: int = 1, seed: int = 42) -> DataFrame:
    """One group out of ``(grp, n)``; a top-1, merged from one row per task."""
    weight = supply_weight(F.col("n"))
    scored = groups.select("grp", weight.alias("weight"), choice_score(F.col("grp"), weight, draw, seed).alias("score"))
    return scored.orderBy("score", "grp").limit(1)
