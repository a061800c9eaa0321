"""Workload jobs: every statement of a workload, and reports over the results."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from copy import copy
from functools import partial, reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thingroups.operators.filters import conjunction, route
from thingroups.operators.relational import join_fact_dim
from thingroups.operators.sampling import cached_sample
from thingroups.plans.staged import METRIC_TYPES, StagedRun, metric_frame
from thingroups.sources.catalog import Catalog, scan_stored
from thingroups.sources.storage import read_truth, write_metrics_csv, write_truth
from thingroups.sources.workload import profile, to_query
from thingroups.spec import AggQuery

EXTRA = {"workload": "string", "sql": "string", "n_predicates": "int", "error": "string"}


def queries_of(run: StagedRun, statements: DataFrame) -> list[tuple[dict, AggQuery | Exception]]:
    """Profiled statements in file order, each with its query or why it has none.

    A workload is text written by people: it is small beside any table.
    """
    specs = run.catalog.specs
    out = []
    for row in profile(statements).orderBy("workload", "line").collect():
        try:
            query = to_query(row, lambda t: specs[t].kinds if t in specs else ())
        except ValueError as problem:
            query = problem
        out.append((row.asDict(), query))
    return out


def shared_truths(catalog: Catalog, items: list[tuple[str, int, AggQuery]]) -> DataFrame:
    """(workload, idx, grp, value): exact answers of many statements, ``grp`` as text.

    Statements of one source, a table or a join, share one scan: each row gives a line for every
    statement whose predicates it satisfies, with that statement's group and measure, and
    one aggregation adds all of them up, partially before the shuffle."""
    by_source: dict[tuple, list[tuple[str, int, AggQuery]]] = {}
    for item in items:
        by_source.setdefault((item[2].table, item[2].join), []).append(item)
    return reduce(DataFrame.unionByName, [_truths_of_source(catalog, some) for some in by_source.values()])


def _truths_of_source(catalog: Catalog, items: list[tuple[str, int, AggQuery]]) -> DataFrame:
    first = items[0][2]
    tables = catalog.tables_of(first)
    rows = scan_stored(catalog, first.table)
    if first.join is not None:
        rows = join_fact_dim(first, rows, scan_stored(catalog, first.join.dimension))
    decimals = max([0, *(s for t in tables for s in catalog.spec(t).scales.values())])
    exact_type = f"decimal({18 + decimals},{decimals})"
    lines, scales = [], []
    for n, (_, _, query) in enumerate(items):
        routed = route(query.predicates, catalog.specs, tables)
        holds = reduce(and_, [conjunction(rows, routed[t], catalog.spec(t)) for t in tables])
        owner = next((t for t in tables if query.measure in catalog.spec(t).kinds), query.table)
        scale, x = catalog.scale(query.measure, owner), F.col(query.measure)
        none = F.lit(None)
        line = F.struct(
            F.lit(n).alias("n"),
            F.col(query.group).cast("string").alias("grp"),
            (none if scale is None else x.cast(f"decimal(18,{scale})")).cast(exact_type).alias("exact"),
            (x.cast("double") if scale is None else none.cast("double")).alias("x"),
            x.isNotNull().alias("there"),
        )
        lines.append(F.when(holds, line))
        scales.append(scale)
    each = rows.select(F.inline(F.array_compact(F.array(*lines))))
    added = each.groupBy("n", "grp").agg(F.sum("exact").alias("exact"), F.sum("x").alias("x"), F.count_if("there").alias("rows"))
    statements = rows.sparkSession.createDataFrame(
        [(n, w, i, q.func, s is not None) for n, ((w, i, q), s) in enumerate(zip(items, scales, strict=True))],
        "n int, workload string, idx int, func string, in_decimals boolean",
    )
    total = F.when(F.col("in_decimals"), F.col("exact").cast("double")).otherwise(F.col("x"))
    value = (
        F.when(F.col("func") == "COUNT", F.col("rows").cast("double"))
        .when(F.col("func") == "SUM", total)
        .otherwise(F.try_divide(total, F.col("rows")))
    )
    return added.join(statements, "n").select("workload", "idx", "grp", value.alias("value"))


def write_truths(truths: DataFrame, folder: str, dataset: str) -> None:
    """Keep many answers in the layout of single ones, to be replayed one by one."""
    parts = truths.repartition("workload", "idx").write.partitionBy("workload", "idx").mode("overwrite")
    parts.option("partitionOverwriteMode", "dynamic").parquet(f"{folder}/truth/dataset={dataset}")


def run_workload(
    run: StagedRun,
    statements: DataFrame,
    truth_folder: str | None = None,
    dataset: str = "",
    synthetic_only: bool = False,
    parallel: int = 1,
    replay: bool = False,
    metrics_path: str | None = None,
    shared_scan: bool = False,
) -> DataFrame:
    """One metric row per statement; a failing statement is recorded and skipped over.

    The answer sample is drawn once for all statements. Exact answers go to
    ``truth_folder``, or with ``replay`` come from there instead of being computed
    again; with ``shared_scan`` one scan for each source answers all statements first, and
    every statement replays its own. ``metrics_path`` is given the metric rows as one CSV.

    With ``parallel`` several statements are submitted at a time: their jobs are
    small, and Spark runs those of different threads side by side. Measured
    seconds then include waiting for the others.
    """

    run, held = copy(run), []
    if run.samples is None and not synthetic_only:
        run.samples = cached_sample(run.catalog, run.config.sample_rate, run.config.seed)
        held = [run.samples[t] for t in run.catalog.facts]

    def one(item) -> dict:
        idx, line, query = item
        record = {k: line[k] for k in ("workload", "sql", "n_predicates")}
        record["idx"] = idx
        try:
            if isinstance(query, Exception):
                raise query
            keep = truth = None
            if replay or (line["workload"], idx) in shared:
                grp_type = run.catalog.frame(query.table).schema[query.group].dataType.simpleString()
                truth = read_truth(run.catalog.spark, truth_folder, dataset, line["workload"], idx, grp_type)
            elif truth_folder is not None:
                keep = partial(write_truth, folder=truth_folder, dataset=dataset, workload=line["workload"], idx=idx)
            record.update(run.run(query, synthetic_only, truth, keep))
        except Exception as problem:  # noqa: BLE001 - the workload goes on
            record["error"] = f"{type(problem).__name__}: {problem}".splitlines()[0]
        return record

    items = numbered(queries_of(run, statements))
    if shared_scan and not replay:
        if truth_folder is None:
            raise ValueError("a shared scan writes its answers to truth_folder")
        able = [(line["workload"], idx, q) for idx, line, q in items if _is_answerable(run.catalog, q)]
        if able:
            write_truths(shared_truths(run.catalog, able), truth_folder, dataset)
        shared = {(w, i) for w, i, _ in able}
    else:
        shared = set()
    if parallel > 1:
        with ThreadPoolExecutor(parallel) as pool:
            rows = list(pool.map(one, items))
    else:
        rows = [one(item) for item in items]
    for df in held:
        df.unpersist()
    metrics = metric_frame(run.catalog.spark, rows, EXTRA)
    if metrics_path is not None:
        write_metrics_csv(metrics, metrics_path, [*EXTRA, *METRIC_TYPES])
    return metrics


def _is_answerable(catalog: Catalog, query: AggQuery | Exception) -> bool:
    """Whether all columns are there; what is not answered together fails on its own."""
    if isinstance(query, Exception) or query.table not in catalog.specs:
        return False
    tables = catalog.tables_of(query)
    known = {c for t in tables if t in catalog.specs for c in catalog.spec(t).stored_columns}
    return all(t in catalog.specs for t in tables) and {query.group, query.measure, *(p.column for p in query.predicates)} <= known


def numbered(lines: list[tuple[dict, AggQuery | Exception]]) -> list[tuple[int, dict, AggQuery | Exception]]:
    """Position of each statement within its workload, from 0."""
    counters: dict[str, int] = {}
    out = []
    for line, query in lines:
        idx = counters.get(line["workload"], 0)
        counters[line["workload"]] = idx + 1
        out.append((idx, line, query))
    return out


def final_error() -> Column:
    """The error of the last stage a query went through."""
    return F.coalesce("re_after_dynamic_supply", "re_after_supply_missing_groups", "re")


def by_predicate_count(metrics: DataFrame) -> DataFrame:
    """Mean final error of the statements with each number of predicates."""
    return (
        metrics.where(F.col("error").isNull())
        .groupBy("n_predicates")
        .agg(F.count(F.lit(1)).alias("n_statements"), F.avg(final_error()).alias("mean_error"))
    )


def selectivities(run: StagedRun, statements: DataFrame) -> DataFrame:
    """Share of fact rows each statement selects: ``(workload, idx, selectivity)``."""
    catalog, rows = run.catalog, []
    by_source: dict[tuple, list] = {}
    for idx, line, query in numbered(queries_of(run, statements)):
        if not isinstance(query, Exception):
            by_source.setdefault((query.table, query.join), []).append((line["workload"], idx, query))
    totals = {table: catalog.frame(table).count() for table, _ in by_source}
    for (table, join), asked in by_source.items():
        # One scan for all statements over the same tables: a conditional count for each.
        frames = {t: scan_stored(catalog, t) for t in catalog.tables_of(asked[0][2])}
        source = frames[table] if join is None else join_fact_dim(asked[0][2], frames[table], frames[join.dimension])
        counts = []
        for i, (_, _, query) in enumerate(asked):
            routed = route(query.predicates, catalog.specs, frames)
            wanted = [conjunction(frames[t], found, catalog.spec(t)) for t, found in routed.items()]
            counts.append(F.count_if(reduce(and_, wanted)).alias(f"n{i}"))
        for i in range(0, len(counts), 100):
            line = source.agg(*counts[i : i + 100]).first()
            rows += [(*asked[i + k][:2], n / max(totals[table], 1)) for k, n in enumerate(line)]
    return run.catalog.spark.createDataFrame(rows, "workload string, idx int, selectivity double")


def by_selectivity(metrics: DataFrame, measured: DataFrame, classes: int = 4) -> DataFrame:
    """Mean final error per selectivity class, class 1 being the widest statements."""
    ordered = Window.orderBy(F.desc("selectivity"), "workload", "idx")  # statements, not rows
    classed = measured.withColumn("selectivity_class", F.ntile(classes).over(ordered))
    return (
        metrics.where(F.col("error").isNull())
        .join(classed, ["workload", "idx"])
        .groupBy("selectivity_class")
        .agg(
            F.count(F.lit(1)).alias("n_statements"),
            F.avg("selectivity").alias("mean_selectivity"),
            F.avg(final_error()).alias("mean_error"),
        )
    )
