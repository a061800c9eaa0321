"""Uniform samples, rare groups, weighted choice."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.common import (
    FLAG_COUNTS, FLAG_WHERE, FLAGSHIP, IN_SAMPLE, ITEM_COUNTS, ITEM_IN_SAMPLE, ITEM_KEY, ITEM_WHERE, ITEMS, RATE,
    catalog, check, folder, h, keep, predicted_and_sizes, sampled, u_open,
)
from thingroups.operators import sampling
from thingroups.operators.groups import candidate_rows
from thingroups.sources.catalog import key_parts, scan_stored


@check(
    "uniform_sample",
    "SELECT o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (ORDER BY "
    + h("u1|42", "o_orderkey")
    + ") AS rn, COUNT(*) OVER () AS n FROM orders) WHERE rn <= round(0.1 * n)",
)
def uniform(spark, sf):
    cat = catalog(spark, sf)
    picked = sampling.exact_sample(scan_stored(cat, "orders"), cat.spec("orders"), 0.1)
    return picked.select("o_orderkey", "o_totalprice")


@check(
    "uniform_sample_bernoulli",
    f"SELECT o_orderkey, o_totalprice FROM orders WHERE {keep(RATE, 'u1|42', 'o_orderkey')}",
)
def bernoulli(spark, sf):
    cat = catalog(spark, sf)
    return sampling.uniform_sample(scan_stored(cat, "orders"), cat.spec("orders"), RATE).select(
        "o_orderkey", "o_totalprice"
    )


@check("uniform_sample_dims_whole", "SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier")
def dims_whole(spark, sf):
    return sampling.sample_frames(catalog(spark, sf), ["lineitem", "supplier"], RATE)["supplier"]


@check(
    "cached_sample",
    "SELECT 'events' AS tbl, COUNT(*) AS n FROM events WHERE "
    + keep(RATE, "u1|42", "event_id")
    + " UNION ALL SELECT 'orders', COUNT(*) FROM orders WHERE "
    + keep(RATE, "u1|42", "o_orderkey")
    + f" UNION ALL SELECT 'lineitem', COUNT(*) FROM lineitem WHERE {ITEM_IN_SAMPLE}",
)
def cached(spark, sf):
    cat = catalog(spark, sf)
    frames = sampling.cached_sample(cat, RATE, folder=folder(spark, sf, "cached_sample"))
    counts = [frames[t].agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("tbl"), "n") for t in cat.facts]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@check(
    "sample_filter",
    f"SELECT event_id, user_id, event_type, value FROM events WHERE {FLAG_WHERE} AND {IN_SAMPLE}",
)
def sample_filter(spark, sf):
    cat = catalog(spark, sf)
    frames = sampling.sample_frames(cat, ["events"], RATE)
    return sampling.filtered_sample(cat, FLAGSHIP, frames)["events"]


SIZES = f"SELECT user_id AS grp, COUNT(*) AS n FROM events WHERE {FLAG_WHERE} AND {IN_SAMPLE} GROUP BY 1"
RARE = (
    "rare AS (SELECT c.grp, coalesce(s.n, 0) AS n, 3 - coalesce(s.n, 0) AS need"
    f" FROM counts c LEFT JOIN ({SIZES}) s ON c.grp = s.grp WHERE coalesce(s.n, 0) < 3)"
)


@check("rare_groups", f"WITH {FLAG_COUNTS}, {RARE} SELECT grp, n, need FROM rare")
def rare_groups(spark, sf):
    return sampling.rare_groups(*predicted_and_sizes(catalog(spark, sf)), 3)


TOPUP = f"""topup AS (
 SELECT event_id, user_id, event_type, value FROM (
  SELECT e.*, rare.need, row_number() OVER (PARTITION BY user_id ORDER BY {h('topup|42', 'event_id')}, event_id) AS rn
  FROM events e JOIN rare ON e.user_id = rare.grp WHERE {FLAG_WHERE} AND NOT {IN_SAMPLE})
 WHERE rn <= need)"""


def topup(cat, query, wanted):
    spec = cat.spec(query.table)
    rare = sampling.rare_groups(*predicted_and_sizes(cat, query), wanted)
    rows = candidate_rows(cat, query, scan_stored(cat, query.table))
    rows = rows.where(~sampling.in_sample(rows, spec, RATE, 42))
    return sampling.topup_rows(rows, query.group, rare, wanted, key_parts(rows, spec))


@check("rare_group_topup", f"WITH {FLAG_COUNTS}, {RARE}, {TOPUP} SELECT * FROM topup")
def rare_group_topup(spark, sf):
    return topup(catalog(spark, sf), FLAGSHIP, 3)


@check(
    "rare_group_topup_many",
    f"""WITH {ITEM_COUNTS}, sizes AS (SELECT l_partkey AS grp, COUNT(*) AS n FROM lineitem
      WHERE {ITEM_WHERE} AND {ITEM_IN_SAMPLE} GROUP BY 1),
    rare AS (SELECT c.grp, 5 - coalesce(s.n, 0) AS need FROM counts c LEFT JOIN sizes s ON c.grp = s.grp
      WHERE coalesce(s.n, 0) < 5)
    SELECT l_partkey, COUNT(*) AS n, SUM(CAST(l_extendedprice AS DECIMAL(18,2)))::DOUBLE AS price FROM (
      SELECT l.*, need, row_number() OVER (PARTITION BY l_partkey ORDER BY {h('topup|42', ITEM_KEY)}, {ITEM_KEY}) AS rn
      FROM lineitem l JOIN rare ON l_partkey = grp WHERE {ITEM_WHERE} AND NOT {ITEM_IN_SAMPLE})
    WHERE rn <= need GROUP BY 1""",
)
def topup_many(spark, sf):
    rows = topup(catalog(spark, sf), ITEMS, 5)
    price = F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double")
    return rows.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"), price.alias("price"))


@check(
    "sample_union_topup",
    f"WITH {FLAG_COUNTS}, {RARE}, {TOPUP} SELECT event_id, user_id, event_type, value FROM events"
    f" WHERE {FLAG_WHERE} AND {IN_SAMPLE} UNION ALL SELECT * FROM topup",
)
def union_topup(spark, sf):
    cat = catalog(spark, sf)
    # Top-up rows arrive in other types and are brought into the sample's.
    extra = topup(cat, FLAGSHIP, 3).withColumn("user_id", F.col("user_id").cast("string"))
    return sampling.union_rows(sampled(cat, FLAGSHIP)["events"], extra)


@check(
    "weighted_group_choice",
    f"SELECT grp, round(w, 6) AS weight, round(score, 6) AS score FROM (SELECT grp, w,"
    f" -ln({u_open('choice|42', '1, grp')}) / w AS score FROM (SELECT grp, 1.0::DOUBLE / (1.0::DOUBLE + n / 100.0::DOUBLE)"
    f" AS w FROM ({SIZES}))) ORDER BY score, grp LIMIT 1",
)
def weighted(spark, sf):
    _, sizes = predicted_and_sizes(catalog(spark, sf))
    return sampling.weighted_choice(sizes).select("grp", F.round("weight", 6).alias("weight"), F.round("score", 6).alias("score"))


@check(
    "train_validation_split",
    "SELECT o_orderkey, rn <= ceil(0.15 * n) AS held_out FROM (SELECT *, row_number() OVER (ORDER BY "
    + h("holdout|42", "o_orderkey")
    + ") AS rn, COUNT(*) OVER () AS n FROM orders)",
)
def split(spark, sf):
    cat = catalog(spark, sf)
    train, held = sampling.train_validation_split(scan_stored(cat, "orders"), cat.spec("orders"))
    parts = [df.select("o_orderkey", F.lit(flag).alias("held_out")) for df, flag in ((train, False), (held, True))]
    return parts[0].unionByName(parts[1])
