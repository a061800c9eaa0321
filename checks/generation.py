"""Conditional row generation, masks and their validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.common import (
    ITEM_COUNTS, ITEM_IN_SAMPLE, ITEM_WHERE, ITEMS, catalog, check, folder, h, mean, predicted_and_sizes, u, u_fine,
)
from thingroups.operators import generate
from thingroups.operators.groups import missing_groups
from thingroups.operators.partial_fit import StoredModel
from thingroups.operators.sampling import train_validation_split
from thingroups.sources.catalog import scan_stored
from thingroups.spec import Between, Predicate

COLUMNS = ["l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice", "l_discount"]
EVENT_COLUMNS = ["user_id", "event_type", "value"]


def types_of(cat, table):
    return {f.name: f.dataType for f in cat.frame(table).schema.fields}


CODES = " UNION ALL ".join(
    f"SELECT '{c}' AS col, value, row_number() OVER (ORDER BY {h('code|42', chr(39) + c + chr(39) + ', value')}, value) - 1"
    f" AS code FROM (SELECT DISTINCT CAST({c} AS VARCHAR) AS value FROM events)"
    for c in ("user_id", "event_type")
)


@check("category_dictionary", CODES)
def category_dictionary(spark, sf):
    rows = scan_stored(catalog(spark, sf), "events")
    codes = generate.category_dictionary(rows, ["user_id", "event_type"])
    return codes.select(F.col("column").alias("col"), "value", "code")


@check(
    "category_encode",
    f"WITH codes AS ({CODES}) SELECT event_id, a.code AS user_id, t.code AS event_type, e.value FROM events e"
    " JOIN codes a ON a.col = 'user_id' AND a.value = CAST(e.user_id AS VARCHAR)"
    " JOIN codes t ON t.col = 'event_type' AND t.value = e.event_type",
)
def category_encode(spark, sf):
    rows = scan_stored(catalog(spark, sf), "events")
    names = ["user_id", "event_type"]
    return generate.category_encode(rows, generate.category_dictionary(rows, names), names)


@check("category_decode", "SELECT event_id, user_id, event_type, value FROM events")
def category_decode(spark, sf):
    cat = catalog(spark, sf)
    rows, names = scan_stored(cat, "events"), ["user_id", "event_type"]
    codes = generate.category_dictionary(rows, names)
    types = {c: t for c, t in types_of(cat, "events").items() if c in names}
    return generate.category_decode(generate.category_encode(rows, codes, names), codes, types)


@check(
    "condition_rows",
    f"""SELECT grp, i, grp AS o_custkey, CAST(NULL AS VARCHAR) AS o_orderstatus, '1-URGENT' AS o_orderpriority,
      150000.0::DOUBLE + {u('condition|42', "'o_totalprice', grp, i")} * (hi - 150000.0::DOUBLE) AS o_totalprice
    FROM (SELECT DISTINCT o_custkey AS grp FROM orders), range(1, 4) r(i), (SELECT max(o_totalprice) AS hi FROM orders)""",
)
def condition_rows(spark, sf):
    cat = catalog(spark, sf)
    wanted = cat.frame("orders").select(F.col("o_custkey").alias("grp")).distinct()
    # Two conditions on one column: the last one holds.
    predicates = [
        Predicate("o_totalprice", "<", 1000),
        Predicate("o_orderpriority", "=", "1-URGENT"),
        Predicate("o_totalprice", ">", 150000),
    ]
    return generate.condition_rows(
        wanted, predicates, "o_custkey", cat.spec("orders"), types_of(cat, "orders"), cat.bounds("orders"), 3
    )


@check(
    "condition_rows_between",
    f"SELECT grp, i, grp AS user_id, CAST(NULL AS VARCHAR) AS event_type,"
    f" 10.0::DOUBLE + {u('condition|42', chr(39) + 'value' + chr(39) + ', grp, i')} * 5.0::DOUBLE AS value"
    " FROM (SELECT DISTINCT user_id AS grp FROM events), range(1, 3) r(i)",
)
def between(spark, sf):
    cat = catalog(spark, sf)
    wanted = cat.frame("events").select(F.col("user_id").alias("grp")).distinct()
    return generate.condition_rows(
        wanted, [Between("value", 10, 15)], "user_id", cat.spec("events"), types_of(cat, "events"),
        cat.bounds("events"), 2,
    )


@check(
    "standardize",
    "SELECT event_id, user_id, event_type, round((value - m) / s, 6) AS value FROM events,"
    " (SELECT avg(value) AS m, stddev_samp(value) AS s FROM events)",
)
def standardize(spark, sf):
    cat = catalog(spark, sf)
    scaled = generate.standardize(scan_stored(cat, "events"), cat.spec("events"))
    return scaled.withColumn("value", F.round("value", 6))


@check("unstandardize", "SELECT event_id, user_id, event_type, round(value, 6) AS value FROM events")
def unstandardize(spark, sf):
    cat = catalog(spark, sf)
    rows, spec = scan_stored(cat, "events"), cat.spec("events")
    norms = generate._norms(rows, spec)
    back = generate.unstandardize(generate.standardize(rows, spec, norms), spec, norms)
    return back.withColumn("value", F.round("value", 6))


def level_sql(source, group, numeric, categorical):
    """Means and most frequent values per group (or of everything)."""
    key = f"{group} AS grp" if group else "0 AS grp"
    means = ", ".join(f"{mean(c)} AS {c}" for c in numeric)
    sql = f"SELECT {key}, COUNT(*) AS fit_rows, {means} FROM {source} GROUP BY 1"
    for c in categorical:
        modes = (
            f"SELECT grp, v AS {c} FROM (SELECT grp, v, row_number() OVER (PARTITION BY grp"
            f" ORDER BY n DESC, CAST(v AS VARCHAR)) AS rn FROM (SELECT {key}, {c} AS v, COUNT(*) AS n FROM {source} GROUP BY 1, 2))"
            " WHERE rn = 1"
        )
        sql = f"SELECT * FROM ({sql}) JOIN ({modes}) USING (grp)"
    return sql


ITEM_NUMERIC = ["l_quantity", "l_extendedprice", "l_discount"]
ITEM_CATEGORICAL = ["l_suppkey", "l_returnflag", "l_linestatus"]
RETURNED = "(SELECT * FROM lineitem WHERE l_returnflag = 'R')"
LEVELS = (
    f"eq AS ({level_sql(RETURNED, 'l_partkey', ITEM_NUMERIC, ITEM_CATEGORICAL)}),"
    f" gr AS ({level_sql('lineitem', 'l_partkey', ITEM_NUMERIC, ITEM_CATEGORICAL)}),"
    f" al AS ({level_sql('lineitem', None, ITEM_NUMERIC, ITEM_CATEGORICAL)})"
)
FIT_COLUMNS = ["grp", "fit_rows", *ITEM_NUMERIC, *ITEM_CATEGORICAL]


@check(
    "generator_fit",
    f"WITH {LEVELS} "
    + " UNION ALL ".join(
        f"SELECT '{name}' AS level, {', '.join(FIT_COLUMNS)} FROM {name}" for name in ("eq", "gr", "al")
    ),
)
def generator_fit(spark, sf):
    cat = catalog(spark, sf)
    fitted = item_fit(cat)
    overall = fitted.overall.withColumn("grp", F.lit(0).cast("bigint"))
    out = None
    for name, frame in (("eq", fitted.by_equal), ("gr", fitted.by_group), ("al", overall)):
        line = frame.select(F.lit(name).alias("level"), *FIT_COLUMNS)
        line = line.withColumn("l_suppkey", F.col("l_suppkey").cast("bigint"))
        out = line if out is None else out.unionByName(line)
    return out


@check(
    "generator_fit_merged",
    f"WITH {LEVELS} "
    + " UNION ALL ".join(f"SELECT '{name}' AS level, {', '.join(FIT_COLUMNS)} FROM {name}" for name in ("gr", "al")),
)
def generator_fit_merged(spark, sf):
    cat = catalog(spark, sf)
    model = StoredModel(spark, cat.spec("lineitem"), "l_partkey", folder(spark, sf, "model_parts"), cat.name, COLUMNS)
    rows = scan_stored(cat, "lineitem")
    for part in range(3):
        model.add(f"line-{part}", rows.where(F.col("l_linenumber") % 3 == part))
    by_group, overall = model.levels()
    lines = [
        frame.select(F.lit(name).alias("level"), *FIT_COLUMNS).withColumn("l_suppkey", F.col("l_suppkey").cast("bigint"))
        for name, frame in (("gr", by_group), ("al", overall.withColumn("grp", F.lit(0).cast("bigint"))))
    ]
    return lines[0].unionByName(lines[1])


def item_fit(cat):
    return generate.fit(scan_stored(cat, "lineitem"), cat.spec("lineitem"), "l_partkey", ITEMS.predicates, COLUMNS)


def item_requests(cat, n):
    predicted, sizes = predicted_and_sizes(cat, ITEMS)
    wanted = missing_groups(predicted, sizes)
    return generate.condition_rows(
        wanted, ITEMS.predicates, "l_partkey", cat.spec("lineitem"), types_of(cat, "lineitem"),
        cat.bounds("lineitem"), n, columns=COLUMNS,
    )


MISSING_ITEMS = (
    f"{ITEM_COUNTS}, missing AS (SELECT grp FROM counts WHERE grp NOT IN"
    f" (SELECT l_partkey FROM lineitem WHERE {ITEM_WHERE} AND {ITEM_IN_SAMPLE}))"
)
QTY_DRAW = f"40.0::DOUBLE + {u('condition|42', chr(39) + 'l_quantity' + chr(39) + ', m.grp, i')} * (b.hi - 40.0::DOUBLE)"


def impute_sql(n):
    def cell(c):
        return f"coalesce(eq.{c}, gr.{c}, al.{c}) AS {c}"

    return (
        f"WITH {MISSING_ITEMS}, {LEVELS} SELECT m.grp, i, m.grp AS l_partkey, {cell('l_suppkey')}, 'R' AS l_returnflag,"
        f" {cell('l_linestatus')}, {QTY_DRAW} AS l_quantity, {cell('l_extendedprice')}, {cell('l_discount')}"
        f" FROM missing m CROSS JOIN range(1, {n + 1}) r(i) CROSS JOIN al CROSS JOIN b LEFT JOIN eq ON eq.grp = m.grp"
        " LEFT JOIN gr ON gr.grp = m.grp"
    )


@check("impute_most_probable", impute_sql(2))
def most_probable(spark, sf):
    cat = catalog(spark, sf)
    return generate.impute(item_requests(cat, 2), item_fit(cat))


DONOR_SQL = f"""
WITH asked AS (SELECT DISTINCT user_id FROM events),
pool AS (SELECT e.*, row_number() OVER (PARTITION BY user_id ORDER BY {h('donor_rank|42', 'event_id')}, event_id) AS r,
  COUNT(*) OVER (PARTITION BY user_id) AS n FROM events e WHERE event_type = 'error' AND user_id IN (SELECT * FROM asked)),
rest AS (SELECT e.*, row_number() OVER (PARTITION BY user_id ORDER BY {h('donor_rank|42', 'event_id')}, event_id) AS r,
  COUNT(*) OVER (PARTITION BY user_id) AS n FROM events e WHERE user_id IN (SELECT * FROM asked)),
req AS (SELECT user_id, k, {u_fine('donor|42', 'user_id, k')} AS u FROM asked, range(1, 4) q(k))
SELECT req.user_id, 'error' AS event_type, CASE WHEN p.n IS NOT NULL THEN p.value ELSE g.value END AS value, k
FROM req LEFT JOIN pool p ON p.user_id = req.user_id AND p.r = floor(u * p.n) + 1
 LEFT JOIN rest g ON g.user_id = req.user_id AND g.r = floor(u * g.n) + 1
"""


@check("impute_sampled", DONOR_SQL)
def sampled_fill(spark, sf):
    cat = catalog(spark, sf)
    asked = cat.frame("events").select("user_id").distinct()
    rows = asked.select("user_id", F.lit("error").alias("event_type"), F.lit(None).cast("double").alias("value"))
    return generate.impute_sampled(
        rows, scan_stored(cat, "events"), cat.spec("events"), "user_id", ["user_id"],
        [Predicate("event_type", "=", "error")], 3,
    )


@check(
    "accept_reject_rows",
    f"""WITH made AS (SELECT event_id, user_id, event_type FROM events
      UNION ALL SELECT -1 - event_id, user_id, event_type FROM events WHERE event_type = 'view'),
    d AS (SELECT event_type, COUNT(*) AS n, SUM(COUNT(*)) OVER () AS t FROM events GROUP BY 1),
    m AS (SELECT event_type, COUNT(*) AS n, SUM(COUNT(*)) OVER () AS t FROM made GROUP BY 1)
    SELECT made.* FROM made JOIN m USING (event_type) JOIN d USING (event_type)
    WHERE {u('accept|42', 'event_id')} <= least(1.0::DOUBLE, CAST(d.n * m.t AS DOUBLE) / CAST(m.n * d.t AS DOUBLE))""",
)
def accept(spark, sf):
    cat = catalog(spark, sf)
    data = cat.frame("events").select("event_id", "user_id", "event_type")
    # Everything once and the views a second time: too many views were made.
    again = data.where("event_type = 'view'").withColumn("event_id", F.lit(-1) - F.col("event_id"))
    made = data.unionByName(again)
    return generate.accept_by_density(made, data, "event_type", ["event_id"])


@check(
    "mask_mcar",
    "SELECT event_id, "
    + ", ".join(
        f"CASE WHEN {u(f'mask_{c}|42', 'event_id')} >= 0.3::DOUBLE THEN {c} END AS {c}" for c in EVENT_COLUMNS
    )
    + " FROM events",
)
def mask_mcar(spark, sf):
    cat = catalog(spark, sf)
    return generate.mask_random(scan_stored(cat, "events"), cat.spec("events"), 0.3)


def stratified_sql(pick_numeric):
    ranks = ", ".join(
        f"row_number() OVER (ORDER BY {h(f'pick_{c}|42', 'o_orderkey')}) AS pick_{c}, COUNT(*) OVER (PARTITION BY {c}) AS f_{c}"
        for c in ("o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    )
    cells = [
        f"CASE WHEN NOT (pick_{c} <= floor(0.4 * n) AND {u(f'mask_{c}|42', 'o_orderkey')} < f_{c}::DOUBLE / n) THEN {c} END AS {c}"
        for c in ("o_custkey", "o_orderstatus", "o_orderpriority")
    ]
    price = "CASE WHEN pick_o_totalprice > floor(0.4 * n) THEN o_totalprice END" if pick_numeric else "CAST(NULL AS DOUBLE)"
    return (
        f"SELECT o_orderkey, {', '.join(cells)}, {price} AS o_totalprice FROM"
        f" (SELECT *, COUNT(*) OVER () AS n, {ranks} FROM orders)"
    )


@check("mask_stratified", stratified_sql(False))
def mask_stratified(spark, sf):
    cat = catalog(spark, sf)
    return generate.mask_stratified(scan_stored(cat, "orders"), cat.spec("orders"), 0.4)


@check("mask_random_stratified", stratified_sql(True))
def mask_random_stratified(spark, sf):
    cat = catalog(spark, sf)
    return generate.mask_stratified(scan_stored(cat, "orders"), cat.spec("orders"), 0.4, pick_numeric=True)


SCORE_SQL = f"""
WITH ranked AS (SELECT *, row_number() OVER (ORDER BY {h('holdout|42', 'event_id')}) AS rn, COUNT(*) OVER () AS n FROM events),
train AS (SELECT * FROM ranked WHERE rn > ceil(0.15 * n)),
held AS (SELECT *, {u('mask_user_id|42', 'event_id')} < 0.5::DOUBLE AS o_user, {u('mask_event_type|42', 'event_id')} < 0.5::DOUBLE AS o_type,
  {u('mask_value|42', 'event_id')} < 0.5::DOUBLE AS o_value FROM ranked WHERE rn <= ceil(0.15 * n)),
gr AS ({level_sql('train', 'user_id', ['value'], ['event_type'])}),
al AS ({level_sql('train', None, ['value'], ['event_type'])}),
filled AS (SELECT h.*, coalesce(gr.value, al.value) AS f_value, coalesce(gr.event_type, al.event_type) AS f_type
 FROM held h CROSS JOIN al LEFT JOIN gr ON NOT h.o_user AND gr.grp = h.user_id)
SELECT 'value' AS col, 'nrmse' AS metric, round(sqrt(avg(CASE WHEN o_value THEN (f_value - value) * (f_value - value) END))
  / stddev_samp(CASE WHEN o_value THEN value END), 6) AS score, COUNT(CASE WHEN o_value THEN 1 END) AS n_hidden FROM filled
UNION ALL SELECT 'event_type', 'accuracy', round(avg(CASE WHEN o_type THEN CASE WHEN f_type = event_type THEN 1.0 ELSE 0.0 END END), 6),
  COUNT(CASE WHEN o_type THEN 1 END) FROM filled
UNION ALL SELECT 'user_id', 'accuracy', round(avg(CASE WHEN o_user THEN CASE WHEN user_id = (SELECT user_id FROM train
  GROUP BY 1 ORDER BY COUNT(*) DESC, CAST(user_id AS VARCHAR) LIMIT 1) THEN 1.0 ELSE 0.0 END END), 6),
  COUNT(CASE WHEN o_user THEN 1 END) FROM filled
"""


@check("imputation_score", SCORE_SQL)
def imputation_score(spark, sf):
    cat = catalog(spark, sf)
    spec = cat.spec("events")
    train, held = train_validation_split(scan_stored(cat, "events"), spec)
    scored = generate.imputation_score(train, held, spec, "user_id")
    return scored.select(F.col("column").alias("col"), "metric", F.round("score", 6).alias("score"), "n_hidden")

