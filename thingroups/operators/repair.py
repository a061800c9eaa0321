"""Repairing thin groups with generated rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from hashlib import md5
from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from thingroups.functions.draws import SPAN, salted, unit_open
from thingroups.functions.sums import spread_ratio
from thingroups.operators.generate import Fit, condition_rows, impute
from thingroups.operators.relational import group_sizes, left_groups
from thingroups.operators.sampling import choice_score, supply_weight
from thingroups.spec import Predicate, TableSpec

__all__ = [
    "BatchPlan", "accept_by_cv", "allocation", "batch_rows", "best_reward", "dynamic_supply", "generate_for",
    "sample_moments", "supply_missing_groups", "supply_weight",
]


def generate_for(
    groups: DataFrame,
    predicates: Sequence[Predicate],
    fitted: Fit,
    types: Mapping[str, T.DataType],
    bounds: Mapping[str, tuple[float, float]],
    n: int,
    seed: int = 42,
) -> DataFrame:
    """``n`` full rows for each group, all groups in one job: ``grp, i`` and columns."""
    laid = condition_rows(
        groups, predicates, fitted.group, fitted.spec, types, bounds, n, seed, fitted.columns
    )
    return impute(laid, fitted)


def supply_missing_groups(
    predicted: DataFrame,
    sample_groups: DataFrame,
    predicates: Sequence[Predicate],
    fitted: Fit,
    types: Mapping[str, T.DataType],
    bounds: Mapping[str, tuple[float, float]],
    n: int = 10,
    seed: int = 42,
) -> DataFrame:
    """Generated rows for every predicted group the sample lacks; none missing, no rows."""
    return generate_for(left_groups(predicted, sample_groups), predicates, fitted, types, bounds, n, seed)


# --- acceptance by coefficient of variation ---------------------------------------


def sample_moments(sample: DataFrame, measure: str) -> tuple[int, float, float]:
    """Rows, mean and centred sum of squares of the measure: three numbers."""
    x = F.col(measure).cast("double")
    row = sample.agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.var_pop(x).alias("var")).first()
    n = row["n"]
    return n, (row["mean"] or 0.0) if n else 0.0, (row["var"] or 0.0) * n if n else 0.0


def batch_rows(generated: DataFrame, size: int) -> DataFrame:
    """Number the rows of a group into batches of ``size``, from 1."""
    return generated.withColumn("batch", F.ceil(F.col("i") / F.lit(size)).cast("int"))


def accept_by_cv(batches: DataFrame, measure: str, moments: tuple[int, float, float]) -> DataFrame:
    """Judge each batch against the sample plus the same group's earlier batches.

    A batch is accepted if it lowers stddev / mean, and only while all earlier
    ones were. One line per ``(grp, batch)`` with both ratios, the reward and
    whether it stands. Rows are reduced to moments before anything is compared;
    a group has as many lines as batches.
    """
    n0, center, ss0 = moments
    z = F.col(measure).cast("double") - F.lit(center)
    per_batch = batches.groupBy("grp", "batch").agg(
        F.count(z).alias("n"), F.sum(z).alias("s1"), F.sum(z * z).alias("s2")
    )
    upto = Window.partitionBy("grp").orderBy("batch").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    n, s1, s2 = F.sum("n").over(upto), F.sum("s1").over(upto), F.sum("s2").over(upto)
    after = spread_ratio(F.lit(n0) + n, s1, F.lit(ss0) + s2, F.lit(center))
    before = spread_ratio(
        F.lit(n0) + n - F.col("n"), s1 - F.col("s1"), F.lit(ss0) + s2 - F.col("s2"), F.lit(center)
    )
    judged = per_batch.select("grp", "batch", "n", before.alias("cv_before"), after.alias("cv_after"))
    lowers = F.coalesce(F.col("cv_after") < F.col("cv_before"), F.lit(False))
    return judged.withColumn("reward", F.col("cv_before") - F.col("cv_after")).withColumn(
        "accepted", F.min(lowers.cast("int")).over(upto) == 1
    )


def best_reward(judged: DataFrame) -> DataFrame:
    """Per group the reward of its last accepted batch; the best group first to exploit."""
    last = judged.where("accepted").groupBy("grp").agg(
        F.max_by("reward", "batch").alias("reward"), F.max("batch").alias("accepted_batches")
    )
    return last.orderBy(F.desc("reward"), "grp").limit(1)


# --- allocation ---------------------------------------------------------------------


@dataclass
class BatchPlan:
    """How many batches each group got: ``accepted[grp]``, and all picks in order."""

    accepted: dict
    picks: list


def _unit(salt: str, *parts) -> float:
    """The draw of :func:`thingroups.functions.draws.unit_open` for plain values."""
    text = "|".join([salt, *[str(p) for p in parts]])
    return (int(md5(text.encode()).hexdigest()[:8], 16) + 0.5) / SPAN


def _race(sizes: DataFrame, rounds: int, seed: int) -> DataFrame:
    """Per round the ``rounds + 1`` groups with the lowest scores.

    At most one weight changes per round, so later choices are found among
    these. The rank limit is applied in each task before the shuffle.
    """
    per_round = sizes.select("grp", "n", F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("round"))
    scored = per_round.withColumn("score", choice_score(F.col("grp"), supply_weight(F.col("n")), F.col("round"), seed))
    order = Window.partitionBy("round").orderBy("score", "grp")
    return scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= rounds + 1)


def allocate(race: list, judged: Mapping[tuple, tuple[bool, float]], rounds: int, size: int, epsilon: float, seed: int) -> BatchPlan:
    """Epsilon-greedy choice of a group per round, over bounded tables.

    Exploring takes the winner of the round's weighted race, a group with more
    rows being less likely; exploiting the group whose last batch lowered the
    ratio most. A group whose next batch does not lower it is retired.
    """
    start = {row["grp"]: row["n"] for row in race}
    by_round: dict[int, list] = {}
    for row in sorted(race, key=lambda r: (r["round"], r["place"])):
        by_round.setdefault(row["round"], []).append(row)
    accepted, rewards, retired, picks = {}, {}, set(), []
    for t in range(1, rounds + 1):
        if _unit(salted("explore", seed), t) < epsilon or not rewards:
            options = [(r["score"], r["grp"]) for r in by_round.get(t, []) if r["grp"] not in accepted and r["grp"] not in retired]
            for grp, done in accepted.items():
                if grp not in retired:
                    weight = 1.0 / (1.0 + (start[grp] + done * size) / 100.0)
                    options.append((-log(_unit(salted("choice", seed), t, grp)) / weight, grp))
            if not options:
                break
            group = min(options)[1]
        else:
            group = max(rewards, key=rewards.get)
        picks.append(group)
        batch = accepted.get(group, 0) + 1
        lowers, reward = judged.get((group, batch), (False, None))
        if lowers:
            accepted[group], rewards[group] = batch, reward
        else:
            retired.add(group)
            rewards.pop(group, None)
    return BatchPlan(accepted, picks)


def allocation(
    race: DataFrame, judged: DataFrame, rounds: int, size: int, epsilon: float, seed: int, group_type: T.DataType
) -> DataFrame:
    """``(grp, upto)``: the batches that each group gets, as one expression over all rounds.

    The same choices as :func:`allocate`, as a fold: its state has a line for each group picked so far, and
    every round picks one more by the race or by the rewards. Both tables are bounded by the number
    of rounds squared; they meet in one row, and nothing comes to the driver."""
    kind = group_type.simpleString()
    entry = f"struct<grp: {kind}, n: bigint, done: int, reward: double, retired: boolean>"
    state_type = f"struct<known: array<{entry}>, stopped: boolean>"
    option = F.struct("round", "score", "grp", F.col("n").cast("bigint").alias("n"))
    batch = F.struct("grp", F.col("batch").cast("int").alias("batch"), "reward")
    lines = race.select(option.alias("option")).unionByName(judged.where("accepted").select(batch.alias("batch")), allowMissingColumns=True)
    world = lines.agg(F.collect_list("option").alias("options"), F.collect_list("batch").alias("batches"))

    def step(state: Column, t: Column) -> Column:
        known = state["known"]
        live = F.filter(known, lambda k: ~k["retired"] & (k["done"] > 0))
        new = F.filter("options", lambda o: (o["round"] == t) & ~F.exists(known, lambda k: k["grp"] == o["grp"]))
        again = lambda k: choice_score(k["grp"], supply_weight(k["n"] + k["done"] * size), t, seed)
        raced = F.array_min(
            F.concat(
                F.transform(new, lambda o: F.struct(o["score"].alias("score"), o["grp"].alias("grp"), o["n"].alias("n"))),
                F.transform(live, lambda k: F.struct(again(k).alias("score"), k["grp"].alias("grp"), k["n"].alias("n"))),
            )
        )
        rewarded = F.array_max(
            F.transform(live, lambda k, i: F.struct(k["reward"].alias("reward"), (-i).alias("place"), k["grp"].alias("grp"), k["n"].alias("n")))
        )
        explores = (unit_open(salted("explore", seed), t) < epsilon) | (F.size(live) == 0)
        pick = F.when(explores, F.struct(raced["grp"].alias("grp"), raced["n"].alias("n"))).otherwise(
            F.struct(rewarded["grp"].alias("grp"), rewarded["n"].alias("n"))
        )
        return F.get(F.transform(F.array(pick), lambda p: after(state, p)), F.lit(0))

    def after(state: Column, pick: Column) -> Column:
        known = state["known"]
        done = F.coalesce(F.get(F.filter(known, lambda k: k["grp"] == pick["grp"]), F.lit(0))["done"], F.lit(0))
        found = F.get(F.filter("batches", lambda b: (b["grp"] == pick["grp"]) & (b["batch"] == done + 1)), F.lit(0))
        line = F.struct(
            pick["grp"].alias("grp"),
            pick["n"].alias("n"),
            (done + found["batch"].isNotNull().cast("int")).alias("done"),
            found["reward"].alias("reward"),
            found["batch"].isNull().alias("retired"),
        ).cast(entry)
        there = F.exists(known, lambda k: k["grp"] == pick["grp"])
        changed = F.when(there, F.transform(known, lambda k: F.when(k["grp"] == pick["grp"], line).otherwise(k))).otherwise(
            F.concat(known, F.array(line))
        )
        stops = state["stopped"] | pick["grp"].isNull()
        return F.struct(F.when(stops, known).otherwise(changed).alias("known"), stops.alias("stopped")).cast(state_type)

    begin = F.struct(F.array().cast(f"array<{entry}>").alias("known"), F.lit(False).alias("stopped")).cast(state_type)
    ended = world.select(F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), begin, step)["known"].alias("known"))
    return ended.select(F.inline("known")).where("done > 0").select("grp", F.col("done").alias("upto"))


def dynamic_supply(
    sample: DataFrame,
    group: str,
    measure: str,
    predicates: Sequence[Predicate],
    fitted: Fit,
    types: Mapping[str, T.DataType],
    bounds: Mapping[str, tuple[float, float]],
    max_batches: int = 10,
    size: int = 10,
    epsilon: float = 0.5,
    seed: int = 42,
) -> tuple[DataFrame, DataFrame]:
    """Add generated batches to groups while they lower the coefficient of variation.

    Acceptance in one group does not depend on the others, so the batches of all
    groups that can come up are judged in one job, and one fold allocates them: the rows, and
    ``(grp, upto)`` of the groups that got some. The lines of the race, ``max_batches`` + 1
    for each of its rounds, come to the driver, and the names in them go to the scan of the fitted levels.
    """
    spec: TableSpec = fitted.spec
    sizes = group_sizes(sample, group).where(F.col("grp").isNotNull())
    spark = sample.sparkSession
    raced = _race(sizes, max_batches, seed)
    candidates = raced.collect()
    race = spark.createDataFrame(candidates, raced.schema)
    names = sorted({r["grp"] for r in candidates})
    listed = spark.createDataFrame([(g,) for g in names], T.StructType([T.StructField("grp", types[group])]))
    made = batch_rows(
        generate_for(listed, predicates, fitted.for_groups(names), types, bounds, max_batches * size, seed), size
    )
    judged = accept_by_cv(made, measure, sample_moments(sample, measure))
    limits = allocation(race, judged, max_batches, size, epsilon, seed, types[group])
    rows = made.join(limits, "grp").where(F.col("batch") <= F.col("upto"))
    return rows.select(*[c for c in fitted.columns if c in spec.kinds]), limits
