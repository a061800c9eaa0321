"""Bitmap index and group prediction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.common import (
    FLAG_COUNTS, FLAG_WHERE, FLAGSHIP, IN_SAMPLE, ITEM_COUNTS, ITEM_IN_SAMPLE, ITEM_WHERE, ITEMS, RATE, STAR,
    STAR_COUNT, at, bin_of, bounds, catalog, check, index_of, predicted_and_sizes, share,
)
from thingroups.functions import binning
from thingroups.operators import bitmaps, factors, groups, sampling
from thingroups.operators.filters import where_all
from thingroups.operators.relational import exact
from thingroups.sources.catalog import scan_stored
from thingroups.spec import AggQuery, Predicate


def per_value(index: DataFrame) -> DataFrame:
    """Rows per indexed value, counted from the containers themselves."""
    held = F.coalesce(F.bitmap_count("bitmap"), F.size("positions"))
    return index.groupBy(F.col("column").alias("col"), "value").agg(F.sum(held.cast("bigint")).alias("n"))


def categorical_sql(table, columns):
    return " UNION ALL ".join(
        f"SELECT '{c}' AS col, CAST({c} AS VARCHAR) AS value, COUNT(*) AS n FROM {table} GROUP BY 2" for c in columns
    )


def bins_sql(table, columns):
    return " UNION ALL ".join(
        f"SELECT * FROM (WITH {bounds(table, c)} SELECT '{c}' AS col, CAST({bin_of(c)} AS VARCHAR) AS value,"
        f" COUNT(*) AS n FROM {table}, b GROUP BY 2)"
        for c in columns
    )


EVENT_INDEX = categorical_sql("events", ["user_id", "event_type"]) + " UNION ALL " + bins_sql("events", ["value"])


@check("bitmap_index_write", EVENT_INDEX)
def bitmap_index_write(spark, sf):
    return per_value(index_of(spark, sf, "events").write())


@check("bitmap_index_read", "SELECT event_type AS value, COUNT(*) AS n FROM events WHERE event_type IN ('error', 'view') GROUP BY 1")
def bitmap_index_read(spark, sf):
    index = index_of(spark, sf, "events")
    return per_value(index.read("event_type", ["error", "view"])).select("value", "n")


def built(spark, sf, table, columns, closed=False, layout="adaptive"):
    cat, index = catalog(spark, sf), index_of(spark, sf, table)
    lines = bitmaps.entries(index.rows(), index.spec, cat.bounds(table), closed=closed, columns=columns)
    return bitmaps.build(lines, layout)


@check(
    "bitmap_build_categorical",
    categorical_sql("orders", ["o_custkey", "o_orderstatus", "o_orderpriority"]),
)
def build_categorical(spark, sf):
    return per_value(built(spark, sf, "orders", ["o_custkey", "o_orderstatus", "o_orderpriority"]))


@check("bitmap_build_categorical_dense", categorical_sql("orders", ["o_orderstatus", "o_orderpriority"]))
def build_dense(spark, sf):
    return per_value(built(spark, sf, "orders", ["o_orderstatus", "o_orderpriority"], layout="dense"))


@check("bitmap_build_numeric_bins", bins_sql("lineitem", ["l_quantity", "l_extendedprice"]))
def build_bins(spark, sf):
    return per_value(built(spark, sf, "lineitem", ["l_quantity", "l_extendedprice"]))


@check(
    "bitmap_build_numeric_bins_closed",
    f"""WITH {bounds('lineitem', 'l_quantity')}, edges AS (SELECT i, lo + i * w AS lft,
      CASE WHEN i = 99 THEN hi ELSE lo + (i + 1) * w END AS rgt FROM b, range(100) r(i))
    SELECT 'l_quantity' AS col, CAST(i AS VARCHAR) AS value, COUNT(*) AS n FROM lineitem
      JOIN edges ON l_quantity >= lft AND l_quantity <= rgt GROUP BY 2""",
)
def build_closed(spark, sf):
    return per_value(built(spark, sf, "lineitem", ["l_quantity"], closed=True))


LITERALS = [(">", 20.0), (">=", 150.0), ("<", 20.0), ("<=", 150.0), (">", 1e6), ("<", -5.0), (">", -5.0), ("<", 1e6)]


def _full(op, v):
    return (f"{at(v)} + 1", "99") if op in (">", ">=") else ("0", f"{at(v)} - 1")


@check(
    "bin_locate",
    f"WITH {bounds('events', 'value')} "
    + " UNION ALL ".join(
        f"SELECT '{op}' AS op, {v}::DOUBLE AS literal, {at(v)} AS boundary_bin, {_full(op, v)[0]} AS first_full,"
        f" {_full(op, v)[1]} AS last_full, round({share(op, v)}, 9) AS fraction FROM b"
        for op, v in LITERALS
    ),
)
def bin_locate(spark, sf):
    domain = scan_stored(catalog(spark, sf), "events").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    lo, hi = F.col("lo"), F.col("hi")
    lines = []
    for op, v in LITERALS:
        first, last = binning.full_bins(op, v, lo, hi, 100)
        lines.append(
            F.struct(
                F.lit(op).alias("op"),
                F.lit(v).alias("literal"),
                binning.boundary_bin(v, lo, hi, 100).alias("boundary_bin"),
                first.alias("first_full"),
                last.alias("last_full"),
                F.round(binning.boundary_fraction(op, v, lo, hi, 100), 9).alias("fraction"),
            )
        )
    return domain.select(F.inline(F.array(*lines)))


def sized(sets):
    parts = [bitmaps.set_size(rows).select(F.lit(name).alias("set_name"), "n") for name, rows in sets]
    return reduce(DataFrame.unionByName, parts)


@check(
    "bitmap_eq",
    "SELECT event_type AS set_name, COUNT(*) AS n FROM events WHERE event_type IN ('error', 'click') GROUP BY 1"
    " UNION ALL SELECT 'user 7', COUNT(*) FROM events WHERE user_id = 7 UNION ALL SELECT 'absent', 0",
)
def bitmap_eq(spark, sf):
    index, b = index_of(spark, sf, "events"), catalog(spark, sf).bounds("events")
    asked = [
        ("error", Predicate("event_type", "=", "error")),
        ("click", Predicate("event_type", "=", "click")),
        ("user 7", Predicate("user_id", "=", 7)),
        ("absent", Predicate("event_type", "=", "no such type")),
    ]
    return sized([(name, bitmaps.equal_set(index.read(), p, index.spec, b)) for name, p in asked])


@check(
    "bitmap_range_or",
    f"WITH {bounds('events', 'value')}"
    + " UNION ALL ".join(
        f" SELECT '{op}' AS set_name, COUNT(*) AS n FROM events, b WHERE {bin_of('value')} {side} {at(20.0)}"
        for op, side in ((">", ">"), ("<=", "<"))
    )
    + " UNION ALL SELECT 'user', COUNT(*) FROM events WHERE user_id >= 7",
)
def bitmap_range_or(spark, sf):
    index, b = index_of(spark, sf, "events"), catalog(spark, sf).bounds("events")
    asked = [
        (">", Predicate("value", ">", 20)),
        ("<=", Predicate("value", "<=", 20)),
        ("user", Predicate("user_id", ">=", 7)),
    ]
    return sized([(name, bitmaps.range_set(index.read(), p, index.spec, b)) for name, p in asked])


@check(
    "bitmap_conjunction",
    f"WITH {bounds('lineitem', 'l_quantity')} SELECT COUNT(*) AS n FROM lineitem, b"
    f" WHERE l_returnflag = 'R' AND {bin_of('l_quantity')} > {at(40.0)} AND l_linenumber = 3",
)
def bitmap_conjunction(spark, sf):
    index, b = index_of(spark, sf, "lineitem"), catalog(spark, sf).bounds("lineitem")
    predicates = [*ITEMS.predicates, Predicate("l_linenumber", "=", 3)]
    return bitmaps.set_size(bitmaps.conjunction_set(index.read(), predicates, index.spec, b))


@check(
    "bitmap_join_reduce",
    f"WITH {bounds('lineitem', 'l_discount')} SELECT COUNT(*) AS n FROM lineitem, b"
    f" WHERE {bin_of('l_discount')} > {at(0.05)} AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_nationkey = 3)",
)
def bitmap_join_reduce(spark, sf):
    return bitmaps.set_size(groups.query_set(catalog(spark, sf), STAR, index_of(spark, sf, "lineitem")))


FULL_BINS = f"event_type = 'error' AND {bin_of('value')} > {at(20.0)}"


@check(
    "predict_groups",
    f"WITH {bounds('events', 'value')} SELECT user_id AS grp, COUNT(*) AS n FROM events, b WHERE {FULL_BINS} GROUP BY 1",
)
def predict(spark, sf):
    return groups.predict_groups(catalog(spark, sf), FLAGSHIP, index_of(spark, sf, "events"))


@check(
    "predict_groups_many",
    f"WITH {bounds('lineitem', 'l_quantity')} SELECT l_partkey AS grp, COUNT(*) AS n FROM lineitem, b"
    f" WHERE l_returnflag = 'R' AND {bin_of('l_quantity')} > {at(40.0)} GROUP BY 1",
)
def predict_many(spark, sf):
    return groups.predict_groups(catalog(spark, sf), ITEMS, index_of(spark, sf, "lineitem"))


def rounded(counts):
    return counts.select("grp", F.round("est_count", 6).alias("est_count"))


@check("group_count_estimate", f"WITH {FLAG_COUNTS} SELECT grp, round(est_count, 6) AS est_count FROM counts")
def count_interpolate(spark, sf):
    return rounded(groups.group_counts(catalog(spark, sf), FLAGSHIP))


@check("group_count_estimate_many", f"WITH {ITEM_COUNTS} SELECT grp, round(est_count, 6) AS est_count FROM counts")
def count_interpolate_many(spark, sf):
    return rounded(groups.group_counts(catalog(spark, sf), ITEMS))


def reference_sql(column, op, v):
    side = f"{at(v)} + 1" if op in (">", ">=") else at(v)
    shared = f"(CASE WHEN {side} = 100 THEN b.hi ELSE b.lo + ({side}) * b.w END)"
    inside = f"{column} {'>=' if op in ('>', '>=') else '<='} {shared}"
    return shared, inside, f"SUM(1.0::DOUBLE + CASE WHEN {column} = {shared} THEN {share(op, v)} ELSE 0.0::DOUBLE END)"


_, _INSIDE, _SUM = reference_sql("value", ">", 20.0)
REFERENCE = (
    f"WITH {bounds('events', 'value')} SELECT user_id AS grp, round({_SUM}, 6) AS est_count FROM events, b"
    f" WHERE event_type = 'error' AND {_INSIDE} GROUP BY 1"
)


@check("group_count_estimate_reference", REFERENCE)
def count_reference(spark, sf):
    return rounded(groups.group_counts(catalog(spark, sf), FLAGSHIP, "reference"))


@check("group_count_estimate_bitmap", REFERENCE)
def count_bitmap(spark, sf):
    return rounded(groups.bitmap_group_counts(catalog(spark, sf), FLAGSHIP, index_of(spark, sf, "events", closed=True)))


@check(
    "group_count_estimate_exact",
    f"SELECT user_id AS grp, COUNT(*)::DOUBLE AS est_count FROM events WHERE {FLAG_WHERE} GROUP BY 1",
)
def count_exact(spark, sf):
    return groups.group_counts(catalog(spark, sf), FLAGSHIP, "exact")


@check(
    "group_count_estimate_join",
    f"WITH {bounds('lineitem', 'l_extendedprice')} SELECT l_suppkey AS grp, round(SUM(CASE"
    f" WHEN {bin_of('l_extendedprice')} < {at(20000.0)} THEN 1.0::DOUBLE WHEN {bin_of('l_extendedprice')} = {at(20000.0)}"
    f" THEN {share('<', 20000.0)} ELSE 0.0::DOUBLE END), 6) AS est_count FROM lineitem, b"
    " WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)"
    f" AND {bin_of('l_extendedprice')} <= {at(20000.0)} GROUP BY 1",
)
def count_join(spark, sf):
    return rounded(groups.group_counts(catalog(spark, sf), STAR_COUNT))


def _at_end(column, op, v, group="l_suppkey"):
    return AggQuery("COUNT", column, "lineitem", group, (Predicate(column, op, v),))


def raw_counts(query, name="est_count", kind="::DOUBLE"):
    """Rows of each group by the raw predicate."""
    (p,) = query.predicates
    return (
        f"SELECT {query.group} AS grp, COUNT(*){kind} AS {name} FROM lineitem WHERE {p.column} {p.op} {p.value} GROUP BY 1"
    )


AT_MAX, AT_MIN, DISCOUNT_MAX = (
    _at_end("l_quantity", ">=", 50), _at_end("l_tax", "<=", 0), _at_end("l_discount", ">=", 0.1),
)


@check("group_count_estimate_at_max", raw_counts(AT_MAX))
def count_at_max(spark, sf):
    return rounded(groups.group_counts(catalog(spark, sf), AT_MAX))


@check("group_count_estimate_at_min", raw_counts(AT_MIN))
def count_at_min(spark, sf):
    return rounded(groups.group_counts(catalog(spark, sf), AT_MIN))


@check("predict_groups_at_max", raw_counts(DISCOUNT_MAX, "n", ""))
def predict_at_max(spark, sf):
    return groups.predict_groups(catalog(spark, sf), DISCOUNT_MAX, index_of(spark, sf, "lineitem"))


@check("predict_groups_at_min", raw_counts(AT_MIN, "n", ""))
def predict_at_min(spark, sf):
    return groups.predict_groups(catalog(spark, sf), AT_MIN, index_of(spark, sf, "lineitem"))


@check("group_row_ids", f"SELECT user_id AS grp, event_id AS rid FROM events WHERE {FLAG_WHERE}")
def row_ids(spark, sf):
    cat = catalog(spark, sf)
    rows = scan_stored(cat, "events").withColumn("rid", F.col("event_id"))
    return groups.group_row_ids(cat, FLAGSHIP, rows)


@check(
    "bitmap_op_count",
    f"""WITH {bounds('lineitem', 'l_extendedprice')}, kept AS (SELECT l_suppkey FROM lineitem, b
      WHERE {bin_of('l_extendedprice')} < {at(20000.0)}
      AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0))
    SELECT 1 + (SELECT {at(20000.0)} FROM b) + (SELECT COUNT(DISTINCT l_suppkey) FROM lineitem)
     + (SELECT COUNT(DISTINCT l_suppkey) FROM kept)
     + (SELECT COUNT(*) FROM supplier WHERE s_acctbal > 0 AND s_suppkey IN (SELECT l_suppkey FROM lineitem)) AS bitmap_ops""",
)
def op_count(spark, sf):
    return groups.bitmap_op_count(catalog(spark, sf), STAR_COUNT, index_of(spark, sf, "lineitem"))


@check(
    "index_storage_stats",
    "SELECT 'user_id' AS col, COUNT(DISTINCT user_id) AS n_values, COUNT(*) AS entries, COUNT(*) * 2 AS list_bytes FROM events"
    " UNION ALL SELECT 'event_type', COUNT(DISTINCT event_type), COUNT(*), COUNT(*) * 2 FROM events"
    f" UNION ALL SELECT * FROM (WITH {bounds('events', 'value')}"
    f" SELECT 'value', COUNT(DISTINCT {bin_of('value')}), COUNT(*), COUNT(*) * 2 FROM events, b)",
)
def storage(spark, sf):
    # containers and the bytes they take depend on how tasks number the rows
    report = bitmaps.storage_stats(index_of(spark, sf, "events").read())
    return report.select(F.col("column").alias("col"), "n_values", "entries", "list_bytes")


@check("index_storage_layouts")
def layouts(spark, sf):
    return bitmaps.storage_stats(index_of(spark, sf, "lineitem").read())


@check("predict_groups_exact_set", f"SELECT l_partkey AS grp FROM lineitem WHERE {ITEM_WHERE} GROUP BY 1")
def exact_set(spark, sf):
    return groups.group_counts(catalog(spark, sf), ITEMS, "exact").select("grp")


@check(
    "filtered_index_rows",
    "SELECT user_id, COUNT(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1",
)
def filtered_index_rows(spark, sf):
    index = index_of(spark, sf, "events")
    rows = where_all(groups.index_rows(catalog(spark, sf), FLAGSHIP, index), FLAGSHIP.predicates[:1], index.spec)
    return rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@check("exact_count_no_predicate", "SELECT event_type AS grp, COUNT(value)::DOUBLE AS value FROM events GROUP BY 1")
def no_predicate(spark, sf):
    return exact(catalog(spark, sf), AggQuery("COUNT", "value", "events", "event_type"))


# --- packed index: slices, one pass, join index, rows by id ---------------------------


SPANS = [[(">", 20.0)], [("<=", 20.0)], [(">=", 5.0), ("<", 90.0)], [(">", 33.3), ("<=", 33.4)], [(">", 1e6)]]


def span_sql(span):
    sides = " AND ".join(f"{bin_of('value')} {'>' if op in ('>', '>=') else '<'} {at(v)}" for op, v in span)
    return f" SELECT '{span_name(span)}' AS set_name, COUNT(*) AS n FROM events, b WHERE {sides}"


def span_name(span):
    return " ".join(f"{op} {v}" for op, v in span)


@check("bitmap_range_slices", f"WITH {bounds('events', 'value')}" + " UNION ALL".join(map(span_sql, SPANS)))
def range_slices(spark, sf):
    index, domain = index_of(spark, sf, "events"), catalog(spark, sf).bounds("events")["value"]
    sets = []
    for span in SPANS:
        predicates = [Predicate("value", op, v) for op, v in span]
        weights = factors.bin_weights(predicates, *domain, index.bins, factors.FULL)
        sets.append((span_name(span), factors.row_set([factors.steps_factor(index.slices("value"), weights)])))
    return sized(sets)


@check("group_count_estimate_bitmap_interpolate", f"WITH {FLAG_COUNTS} SELECT grp, round(est_count, 6) AS est_count FROM counts")
def bitmap_interpolate(spark, sf):
    return rounded(groups.bitmap_group_counts(catalog(spark, sf), FLAGSHIP, index_of(spark, sf, "events")))


TWO_RANGES = AggQuery(
    "COUNT", "l_quantity", "lineitem", "l_partkey",
    (Predicate("l_returnflag", "=", "R"), Predicate("l_extendedprice", ">", 20000), Predicate("l_extendedprice", "<", 50000),
     Predicate("l_discount", ">", 0.035)),
)


def bin_weight(column, op, v, b):
    side = ">" if op in (">", ">=") else "<"
    return (
        f"(CASE WHEN {bin_of(column, b)} {side} {at(v, b)} THEN 1.0::DOUBLE WHEN {bin_of(column, b)} = {at(v, b)}"
        f" THEN {share(op, v, b)} ELSE 0.0::DOUBLE END)"
    )


@check(
    "group_count_estimate_bitmap_interpolate_many",
    f"WITH {bounds('lineitem', 'l_extendedprice')}, {bounds('lineitem', 'l_discount', 'd')}"
    " SELECT grp, round(est_count, 6) AS est_count FROM (SELECT l_partkey AS grp,"
    f" SUM({bin_weight('l_extendedprice', '>', 20000.0, 'b')} * {bin_weight('l_extendedprice', '<', 50000.0, 'b')}"
    f" * {bin_weight('l_discount', '>', 0.035, 'd')}) AS est_count"
    " FROM lineitem, b, d WHERE l_returnflag = 'R' GROUP BY 1) WHERE est_count > 0",
)
def bitmap_interpolate_many(spark, sf):
    return rounded(groups.bitmap_group_counts(catalog(spark, sf), TWO_RANGES, index_of(spark, sf, "lineitem")))


def tight_weight(column, op, v):
    """A bin counts by where the literal lies between its least and its largest value."""
    none = {">": "hi <= {v}", ">=": "hi < {v}", "<": "lo >= {v}", "<=": "lo > {v}"}[op].format(v=v)
    whole = {">": "lo > {v}", ">=": "lo >= {v}", "<": "hi < {v}", "<=": "hi <= {v}"}[op].format(v=v)
    way = f"hi - {v}" if op in (">", ">=") else f"{v} - lo"
    return f"(CASE WHEN {none} THEN 0.0::DOUBLE WHEN {whole} THEN 1.0::DOUBLE ELSE greatest(({way}) / (hi - lo), 0.01::DOUBLE) END)"


TIGHT = AggQuery(
    "COUNT", "l_quantity", "lineitem", "l_partkey",
    (Predicate("l_returnflag", "=", "R"), Predicate("l_quantity", ">=", 40), Predicate("l_extendedprice", "<", 30000)),
)


@check(
    "group_count_estimate_bitmap_tight",
    f"WITH {bounds('lineitem', 'l_quantity', 'q')}, {bounds('lineitem', 'l_extendedprice', 'p')},"
    f" binned AS (SELECT *, {bin_of('l_quantity', 'q')} AS qb, {bin_of('l_extendedprice', 'p')} AS pb FROM lineitem, q, p),"
    f" qw AS (SELECT qb, {tight_weight('l_quantity', '>=', '40.0::DOUBLE')} AS w FROM"
    " (SELECT qb, min(l_quantity)::DOUBLE AS lo, max(l_quantity)::DOUBLE AS hi FROM binned GROUP BY 1)),"
    f" pw AS (SELECT pb, {tight_weight('l_extendedprice', '<', '30000.0::DOUBLE')} AS w FROM"
    " (SELECT pb, min(l_extendedprice)::DOUBLE AS lo, max(l_extendedprice)::DOUBLE AS hi FROM binned GROUP BY 1))"
    " SELECT grp, round(est_count, 6) AS est_count FROM (SELECT l_partkey AS grp, SUM(qw.w * pw.w) AS est_count FROM binned"
    " JOIN qw ON binned.qb = qw.qb JOIN pw ON binned.pb = pw.pb WHERE l_returnflag = 'R' GROUP BY 1) WHERE est_count > 0",
)
def bitmap_tight(spark, sf):
    return rounded(groups.bitmap_group_counts(catalog(spark, sf), TIGHT, index_of(spark, sf, "lineitem"), tight=True))


@check("group_count_estimate_bitmap_tight_exact", f"SELECT l_partkey AS grp, COUNT(*)::DOUBLE AS est_count FROM lineitem WHERE {ITEM_WHERE} GROUP BY 1")
def bitmap_tight_exact(spark, sf):
    """Bins of a column of whole numbers hold one value each: the estimate is the count."""
    return rounded(groups.bitmap_group_counts(catalog(spark, sf), ITEMS, index_of(spark, sf, "lineitem"), tight=True))


@check(
    "predict_groups_join_index",
    f"WITH {bounds('lineitem', 'l_extendedprice')} SELECT l_suppkey AS grp, COUNT(*) AS n FROM lineitem, b"
    f" WHERE {bin_of('l_extendedprice')} < {at(20000.0)}"
    " AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) GROUP BY 1",
)
def predict_join_index(spark, sf):
    index = index_of(spark, sf, "lineitem")
    index.write_join(STAR_COUNT.join)
    return groups.predict_groups(catalog(spark, sf), STAR_COUNT, index)


@check(
    "bitmap_join_index",
    "SELECT 's_nationkey' AS col, CAST(s_nationkey AS VARCHAR) AS value, COUNT(*) AS n FROM lineitem"
    " JOIN supplier ON l_suppkey = s_suppkey GROUP BY 2"
    " UNION ALL SELECT 'any', 'present', COUNT(*) FROM lineitem JOIN supplier ON l_suppkey = s_suppkey",
)
def join_index(spark, sf):
    index = index_of(spark, sf, "lineitem")
    index.write_join(STAR.join)
    parts = [
        index.joined(STAR.join, column).groupBy("value").agg(F.sum("n").alias("n")).select(F.lit(name).alias("col"), "value", "n")
        for name, column in (("s_nationkey", "s_nationkey"), ("any", ""))
    ]
    return parts[0].unionByName(parts[1])


@check("group_row_ids_index", f"SELECT user_id AS grp, event_id FROM events WHERE {FLAG_WHERE}")
def row_ids_index(spark, sf):
    cat, index = catalog(spark, sf), index_of(spark, sf, "events")
    ids = groups.index_row_ids(cat, FLAGSHIP, index)
    return ids.join(index.fetch(ids).select("rid", "event_id"), "rid").select("grp", "event_id")


def topped_up(spark, sf, query, wanted):
    cat, index = catalog(spark, sf), index_of(spark, sf, query.table)
    rare = sampling.rare_groups(*predicted_and_sizes(cat, query), wanted)
    drawn = groups.topup_from_index(cat, query, index, rare, RATE)
    return where_all(drawn, query.predicates, index.spec).where(~sampling.in_sample(drawn, index.spec, RATE, 42))


def topup_sql(counts, query, where, in_sample, wanted, distinct):
    return (
        f"WITH {counts}, sizes AS (SELECT {query.group} AS grp, COUNT(*) AS n FROM {query.table} WHERE {where} AND {in_sample} GROUP BY 1),"
        f" rare AS (SELECT c.grp, {wanted} - coalesce(s.n, 0) AS need FROM counts c LEFT JOIN sizes s ON c.grp = s.grp"
        f" WHERE coalesce(s.n, 0) < {wanted})"
        f" SELECT grp, least(need, COUNT(*)) AS n, least(need, COUNT({distinct})) AS n_distinct FROM {query.table} JOIN rare"
        f" ON {query.group} = grp WHERE {where} AND NOT {in_sample} GROUP BY grp, need"
    )


@check("rare_group_topup_index", topup_sql(FLAG_COUNTS, FLAGSHIP, FLAG_WHERE, IN_SAMPLE, 3, "DISTINCT event_id"))
def topup_index(spark, sf):
    rows = topped_up(spark, sf, FLAGSHIP, 3)
    return rows.groupBy(F.col("user_id").alias("grp")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("n_distinct")
    )


@check("rare_group_topup_index_many", topup_sql(ITEM_COUNTS, ITEMS, ITEM_WHERE, ITEM_IN_SAMPLE, 5, "*"))
def topup_index_many(spark, sf):
    rows = topped_up(spark, sf, ITEMS, 5)
    return rows.groupBy(F.col("l_partkey").alias("grp")).agg(
        F.count(F.lit(1)).alias("n"), F.count(F.lit(1)).alias("n_distinct")
    )
