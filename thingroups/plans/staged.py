"""Staged runs of one query: truth, sample, prediction, repair, supply, scores.

A run returns named scalars, one per stage and score. Everything that grows
with the data stays in DataFrames; the driver holds the scalars only.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping
from copy import copy

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thingroups.operators.estimate import approx_avg, approx_count, approx_sum
from thingroups.operators.generate import Fit, fit, load_or_fit
from thingroups.operators.groups import (
    bitmap_group_counts, bitmap_op_count, candidate_rows, group_counts, index_rows, topup_from_index,
)
from thingroups.operators.partial_fit import StoredModel
from thingroups.operators.relational import exact, filtered_frames, group_sizes
from thingroups.operators.repair import dynamic_supply, generate_for, supply_missing_groups
from thingroups.operators.sampling import (
    in_sample, rare_groups, sample_frames, topup_rows, union_rows,
)
from thingroups.operators.score import score
from thingroups.sources.catalog import Catalog, key_parts, scan_stored
from thingroups.sources.storage import BitmapIndex
from thingroups.spec import AggQuery, RunConfig

# The columns of a metric row, in stage order.
METRIC_TYPES = {
    "idx": "int",
    "ground_truth_latency": "double",
    "samples_latency": "double",
    "re_with_samples": "double",
    "predict_groups_latency": "double",
    "num_of_bitmap_ops": "bigint",
    "supply_missing_groups_latency": "double",
    "num_of_missing_groups": "bigint",
    "re_after_supply_missing_groups": "double",
    "sampling_rare_groups_latency": "double",
    "num_of_rare_groups": "bigint",
    "re_after_sampling_rare_groups": "double",
    "dynamic_supply_latency": "double",
    "re_after_dynamic_supply": "double",
    "re": "double",
    "precision": "double",
    "recall": "double",
    "missing_rate": "double",
    "out_rate": "double",
    "process_latency": "double",
}


class StagedRun:
    """Runs one query through its stages.

    ``samples`` are the cached frames of the workload; with a packed ``index`` group
    counts are interpolated from it and no fact row is read for them, with a closed one
    the ``reference`` counts are; it also gives operation counts and, if asked for, the rows of the
    top-up. ``models`` has stored models by table and group, which need no fact row;
    ``model_folder`` keeps fitted statistics between runs; ``truth`` replays a saved answer.
    """

    def __init__(
        self,
        catalog: Catalog,
        config: RunConfig = RunConfig(),
        samples: dict[str, DataFrame] | None = None,
        index: BitmapIndex | None = None,
        model_folder: str | None = None,
        models: Mapping[tuple[str, str], StoredModel] | None = None,
    ):
        self.catalog, self.config, self.samples = catalog, config, samples
        self.index, self.model_folder, self.models = index, model_folder, dict(models or {})

    # A stage whose rows later stages need ends in an action on a persisted result, so that
    # its seconds are its own and it is not repeated.

    def _timed(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        started = time.perf_counter()
        df = make().persist()
        self._held.append(df)
        df.count()
        self.metrics[name] = time.perf_counter() - started
        return df

    def _score(self, name: str, estimate: Callable[[], DataFrame]) -> None:
        """Answer and score in one action: the answer is a step of the plan of its scores."""
        started = time.perf_counter()
        row = score(self._truth, estimate()).first()
        self.metrics["process_latency"] = time.perf_counter() - started
        self.metrics[name] = row["relative_error"]
        self.metrics.update({k: row[k] for k in ("precision", "recall", "missing_rate", "out_rate")})

    def _fit(self, query: AggQuery) -> Fit:
        spec = self.catalog.spec(query.table)
        stored = self.models.get((query.table, query.group))
        if stored is not None:
            sample = self.samples[query.table] if self.samples is not None else None
            return stored.fit(query.predicates, sample)
        rows = scan_stored(self.catalog, query.table)
        if self.model_folder is not None:
            return load_or_fit(rows, spec, query.group, self.model_folder, query.predicates, dataset=self.catalog.name)
        used = {query.group, query.measure, *(p.column for p in query.predicates)}
        if query.join is not None:
            used.add(query.join.fact_key)
        columns = [c for c in spec.columns if c in used]
        # A conditioned cell is known in every generated row and needs no fit.
        known = {query.group, *(p.column for p in query.predicates)}
        return fit(rows, spec, query.group, query.predicates, columns, [c for c in columns if c not in known])

    def _types(self, query: AggQuery):
        return {f.name: f.dataType for f in self.catalog.frame(query.table).schema.fields}

    def run(
        self,
        query: AggQuery,
        synthetic_only: bool = False,
        truth: DataFrame | None = None,
        keep_truth: Callable[[DataFrame], None] | None = None,
    ) -> dict:
        """Metrics of one query; runs of several threads do not share state.

        ``truth`` is an answer to replay; ``keep_truth`` is given the computed one.
        """
        return copy(self)._run(query, synthetic_only, truth, keep_truth)

    def _run(self, query, synthetic_only, truth, keep_truth) -> dict:
        self.metrics: dict = {}
        self._held: list[DataFrame] = []
        try:
            if truth is None:
                self._truth = self._timed("ground_truth_latency", lambda: exact(self.catalog, query))
                if keep_truth is not None:
                    keep_truth(self._truth)
            else:
                self._truth = truth
            if synthetic_only:
                self._run_synthetic(query)
            elif query.func == "COUNT":
                self._run_count(query)
            else:
                self._run_repaired(query)
            return dict(self.metrics)
        finally:
            for df in self._held:
                df.unpersist()

    def _counts(self, query: AggQuery) -> DataFrame:
        cfg = self.config
        index = self.index
        closed = index is not None and index.closed and cfg.count_mode == "reference"
        tight = cfg.count_mode == "tight"
        if tight and (index is None or not index.packed):
            raise ValueError("tight counts need a packed index")
        if closed or tight or index is not None and index.packed and index.bins == cfg.bins and cfg.count_mode == "interpolate":
            counts = self._timed(
                "predict_groups_latency", lambda: bitmap_group_counts(self.catalog, query, self.index, tight)
            )
        else:
            rows = index_rows(self.catalog, query, self.index, cfg.seed)
            counts = self._timed(
                "predict_groups_latency",
                lambda: group_counts(self.catalog, query, cfg.count_mode, cfg.bins, rows),
            )
        if self.index is not None:
            self.metrics["num_of_bitmap_ops"] = bitmap_op_count(self.catalog, query, self.index).first()[0]
        return counts

    def _frames(self, query: AggQuery) -> dict[str, DataFrame]:
        tables = self.catalog.tables_of(query)
        frames = self.samples or sample_frames(self.catalog, tables, self.config.sample_rate, self.config.seed)
        frames = filtered_frames(self.catalog, query, {t: frames[t] for t in tables})
        frames[query.table] = self._timed("samples_latency", lambda: frames[query.table])
        return frames

    def _run_count(self, query: AggQuery) -> None:
        counts = self._counts(query)
        self._score("re", lambda: approx_count(counts))

    def _estimate(self, query, frames, counts, generated=None) -> DataFrame:
        if query.func == "AVG":
            return approx_avg(self.catalog, query, frames, generated)
        cfg = self.config
        return approx_sum(self.catalog, query, frames, counts, cfg.sample_rate, generated, cfg.null_share)

    def _topup(self, query: AggQuery, frames: dict[str, DataFrame], counts: DataFrame) -> DataFrame:
        cfg, spec = self.config, self.catalog.spec(query.table)
        rare = rare_groups(counts, group_sizes(frames[query.table], query.group), cfg.topup_rows)
        rare = rare.persist()
        self._held.append(rare)
        self.metrics["num_of_rare_groups"] = rare.count()
        if cfg.topup_source == "index" and self.index is not None and not cfg.allow_duplicates:
            drawn = topup_from_index(self.catalog, query, self.index, rare, cfg.sample_rate, cfg.seed)
            return union_rows(frames[query.table], drawn)
        candidates = candidate_rows(self.catalog, query, index_rows(self.catalog, query, self.index, cfg.seed))
        key = key_parts(candidates, spec)
        if not cfg.allow_duplicates:
            # Membership of the sample is a function of the key: no anti-join.
            candidates = candidates.where(~in_sample(candidates, spec, cfg.sample_rate, cfg.seed))
        drawn = topup_rows(candidates, query.group, rare, cfg.topup_rows, key, cfg.seed)
        return union_rows(frames[query.table], drawn)

    def _run_repaired(self, query: AggQuery) -> None:
        cfg, catalog = self.config, self.catalog
        frames = self._frames(query)
        if query.func == "AVG":
            self._score("re_with_samples", lambda: approx_avg(catalog, query, frames))
        counts = self._counts(query)
        fitted, types, bounds = self._fit(query), self._types(query), catalog.bounds(query.table)
        generated = None
        if cfg.repair == "generate":
            sizes = group_sizes(frames[query.table], query.group)
            generated = self._timed(
                "supply_missing_groups_latency",
                lambda: supply_missing_groups(
                    counts, sizes, query.predicates, fitted, types, bounds, cfg.batch_rows, cfg.seed
                ),
            )
            self.metrics["num_of_missing_groups"] = generated.select("grp").distinct().count()
            self._score(
                "re_after_supply_missing_groups", lambda: self._estimate(query, frames, counts, generated)
            )
        else:
            whole = self._timed("sampling_rare_groups_latency", lambda: self._topup(query, frames, counts))
            frames = {**frames, query.table: whole}
            self._score("re_after_sampling_rare_groups", lambda: self._estimate(query, frames, counts))

        def supply() -> DataFrame:
            more, _ = dynamic_supply(
                frames[query.table], query.group, query.measure, query.predicates, fitted, types, bounds,
                cfg.max_batches, cfg.batch_rows, cfg.epsilon, cfg.seed,
            )
            return more if generated is None else generated.select(*more.columns).unionByName(more)

        supplied = self._timed("dynamic_supply_latency", supply)
        self._score("re_after_dynamic_supply", lambda: self._estimate(query, frames, counts, supplied))

    def _run_synthetic(self, query: AggQuery) -> None:
        """Answer from generated rows only: the sample is empty, so all groups are missing ones
        and get a fixed number of rows. Nothing is accepted or allocated."""
        cfg, catalog = self.config, self.catalog
        base = scan_stored(catalog, query.table)
        domain = base.select(F.col(query.group).alias("grp")).where(F.col("grp").isNotNull()).distinct()
        fitted, types, bounds = self._fit(query), self._types(query), catalog.bounds(query.table)
        made = self._timed(
            "supply_missing_groups_latency",
            lambda: generate_for(domain, query.predicates, fitted, types, bounds, cfg.batch_rows, cfg.seed),
        )
        frames = {t: scan_stored(catalog, t) for t in catalog.tables_of(query)}
        frames[query.table] = base.limit(0)
        self._score(
            "re_after_supply_missing_groups",
            lambda: approx_avg(catalog, query, frames, made.select(*fitted.columns)),
        )


def metric_frame(spark: SparkSession, rows: list[dict], extra: dict[str, str] | None = None) -> DataFrame:
    """Metric rows (one per query) under the fixed column order."""
    types = {**(extra or {}), **METRIC_TYPES}
    schema = ", ".join(f"`{name}` {kind}" for name, kind in types.items())
    return spark.createDataFrame([tuple(r.get(name) for name in types) for r in rows], schema)
