"""Group repair with generated rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.common import (
    FLAG_WHERE, FLAGSHIP, IN_SAMPLE, ITEMS, RATE, catalog, check, h, mean, predicted_and_sizes, sampled, u,
)
from checks.generation import COLUMNS, impute_sql, item_fit, types_of
from thingroups.operators import repair
from thingroups.operators.generate import fit
from thingroups.sources.catalog import scan_stored
from thingroups.spec import AggQuery, Predicate

BATCHES, SIZE = 4, 10


@check("supply_missing_groups", impute_sql(10))
def supply_missing(spark, sf):
    cat = catalog(spark, sf)
    predicted, sizes = predicted_and_sizes(cat, ITEMS)
    return repair.supply_missing_groups(
        predicted, sizes, ITEMS.predicates, item_fit(cat), types_of(cat, "lineitem"), cat.bounds("lineitem"), 10
    ).select("grp", "i", *COLUMNS)


@check(
    "supply_weights",
    "SELECT grp, n, 1.0::DOUBLE / (1.0::DOUBLE + n / 100.0::DOUBLE) AS weight FROM (SELECT user_id AS grp, COUNT(*) AS n"
    f" FROM events WHERE {FLAG_WHERE} AND {IN_SAMPLE} GROUP BY 1)",
)
def supply_weights(spark, sf):
    _, sizes = predicted_and_sizes(catalog(spark, sf))
    return sizes.select("grp", "n", repair.supply_weight(F.col("n")).alias("weight"))


# The measure is free here: it is filled in from the group's errors.
SUPPLY = AggQuery("AVG", "value", "events", "user_id", (Predicate("event_type", "=", "error"),))


def supply_fit(cat):
    return fit(scan_stored(cat, "events"), cat.spec("events"), "user_id", SUPPLY.predicates)


def judged(cat, query=SUPPLY):
    sample = sampled(cat, query)["events"]
    _, sizes = predicted_and_sizes(cat, query)
    made = repair.generate_for(
        sizes.select("grp"), query.predicates, supply_fit(cat), types_of(cat, "events"), cat.bounds("events"),
        BATCHES * SIZE,
    )
    return repair.accept_by_cv(repair.batch_rows(made, SIZE), "value", repair.sample_moments(sample, "value"))


def judged_sql(where, value, batches=BATCHES, sample=None):
    """Batches of the sample's groups and their ratios; ``value`` is the generated measure."""
    return f"""
WITH s AS ({sample or f"SELECT user_id, value FROM events WHERE {where} AND {IN_SAMPLE}"}),
base AS (SELECT COUNT(*) AS n0, avg(value) AS m, var_pop(value) * COUNT(*) AS ss0 FROM s),
fitted AS (SELECT user_id AS grp, {mean('value')} AS v FROM events WHERE event_type = 'error' GROUP BY 1),
made AS (SELECT grp, CAST(ceil(i / {SIZE}.0) AS INTEGER) AS batch, {value} AS value
  FROM (SELECT DISTINCT user_id AS grp FROM s) JOIN fitted USING (grp), range(1, {batches * SIZE + 1}) r(i),
   (SELECT max(value) AS hi FROM events)),
sums AS (SELECT grp, batch, COUNT(*) AS n, SUM(value - m) AS s1, SUM((value - m) * (value - m)) AS s2 FROM made, base GROUP BY 1, 2),
upto AS (SELECT grp, batch, n, s1, s2, SUM(n) OVER w AS cn, SUM(s1) OVER w AS c1, SUM(s2) OVER w AS c2 FROM sums
  WINDOW w AS (PARTITION BY grp ORDER BY batch)),
cv AS (SELECT grp, batch, n,
  sqrt((ss0 + c2 - s2 - (c1 - s1) * (c1 - s1) / (n0 + cn - n)) / (n0 + cn - n - 1)) / (m + (c1 - s1) / (n0 + cn - n)) AS cv_before,
  sqrt((ss0 + c2 - c1 * c1 / (n0 + cn)) / (n0 + cn - 1)) / (m + c1 / (n0 + cn)) AS cv_after FROM upto, base),
judged AS (SELECT *, cv_before - cv_after AS reward,
  MIN(CASE WHEN cv_after < cv_before THEN 1 ELSE 0 END) OVER (PARTITION BY grp ORDER BY batch) = 1 AS accepted FROM cv)
"""


JUDGED = judged_sql("event_type = 'error'", "v")
DRAWN = judged_sql(FLAG_WHERE, f"20.0::DOUBLE + {u('condition|42', chr(39) + 'value' + chr(39) + ', grp, i')} * (hi - 20.0::DOUBLE)")
SHOWN = (
    " SELECT grp, batch, n, round(cv_before, 6) AS cv_before, round(cv_after, 6) AS cv_after,"
    " round(reward, 6) AS reward, accepted FROM judged"
)


def shown(lines):
    return lines.withColumns({c: F.round(c, 6) for c in ("cv_before", "cv_after", "reward")})


@check("supply_accept_by_cv", JUDGED + SHOWN)
def accept_by_cv(spark, sf):
    return shown(judged(catalog(spark, sf)))


@check("supply_accept_by_cv_drawn", DRAWN + SHOWN)
def accept_drawn(spark, sf):
    return shown(judged(catalog(spark, sf), FLAGSHIP))


@check(
    "supply_rewards",
    JUDGED + "SELECT grp, round(reward, 6) AS reward, batch AS accepted_batches FROM (SELECT *, row_number() OVER"
    " (PARTITION BY grp ORDER BY batch DESC) AS rn FROM judged WHERE accepted) WHERE rn = 1"
    " ORDER BY reward DESC, grp LIMIT 1",
)
def rewards(spark, sf):
    best = repair.best_reward(judged(catalog(spark, sf)))
    return best.select("grp", F.round("reward", 6).alias("reward"), "accepted_batches")


EXPLORES = f"((('0x' || substr({h('explore|42', 't + 1')}, 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE < 0.5)"
PICKED = f"""(('0x' || substr({h('choice|42', 't + 1, g.grp')}, 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE"""
ENTRY = "STRUCT(grp BIGINT, done INT, reward DOUBLE, retired BOOLEAN)"
def supplied_ctes(sample=None):
    """CTEs up to ``supplied``: the rows that the bandit adds to a sample in ten rounds of ten rows."""
    judged_ctes = judged_sql("event_type = 'error'", "v", 10, sample).replace("WITH ", "", 1).strip()
    return f"""{judged_ctes},
world AS (
  SELECT list(struct_pack(grp := z.grp, n := z.n, rewards := coalesce(a.rewards, []::DOUBLE[]))) AS groups
  FROM (SELECT user_id AS grp, COUNT(*) AS n FROM s GROUP BY 1) z
  LEFT JOIN (SELECT grp, list(reward ORDER BY batch) AS rewards FROM judged WHERE accepted GROUP BY 1) a ON z.grp = a.grp
), run AS (
  SELECT 0 AS t, []::{ENTRY}[] AS known
  UNION ALL
  SELECT t + 1, CASE WHEN pick IS NULL THEN known
    ELSE list_concat(list_filter(known, lambda k: k.grp <> pick.grp), [
      {{'grp': pick.grp, 'done': pick.done + (len(pick.rewards) > pick.done)::INT, 'reward': pick.rewards[pick.done + 1],
        'retired': len(pick.rewards) <= pick.done}}]) END
  FROM (
    SELECT t, known, CASE WHEN {EXPLORES} OR len(live) = 0 THEN list_sort(raced)[1] ELSE list_reverse_sort(rewarded)[1] END AS pick
    FROM (
      SELECT t, known, list_filter(known, lambda k: NOT k.retired AND k.done > 0) AS live,
        list_transform(list_filter(standing, lambda g: NOT g.retired), lambda g: {{
          'score': -ln({PICKED}) * (1.0::DOUBLE + (g.n + g.done * 10) / 100.0::DOUBLE), 'grp': g.grp, 'done': g.done, 'rewards': g.rewards}}) AS raced,
        list_transform(list_filter(standing, lambda g: NOT g.retired AND g.done > 0), lambda g: {{
          'score': g.reward, 'grp': g.grp, 'done': g.done, 'rewards': g.rewards}}) AS rewarded
      FROM (
        SELECT t, known, list_transform(groups, lambda g: {{'grp': g.grp, 'n': g.n, 'rewards': g.rewards,
          'done': coalesce(list_filter(known, lambda k: k.grp = g.grp)[1].done, 0),
          'reward': list_filter(known, lambda k: k.grp = g.grp)[1].reward,
          'retired': coalesce(list_filter(known, lambda k: k.grp = g.grp)[1].retired, FALSE)}}) AS standing
        FROM run, world WHERE t < 10)))
)
, supplied AS (SELECT user_id, event_type, value FROM (
  SELECT k.grp AS user_id, 'error' AS event_type, v AS value, unnest(range(k.done * 10)) AS i
  FROM (SELECT unnest(known) AS k FROM run WHERE t = 10) JOIN fitted ON k.grp = fitted.grp))"""


@check("dynamic_supply", f"WITH RECURSIVE {supplied_ctes()} SELECT user_id, event_type, value FROM supplied")
def dynamic_supply(spark, sf):
    cat = catalog(spark, sf)
    sample = sampled(cat, SUPPLY, RATE)["events"]
    rows, _ = repair.dynamic_supply(
        sample, "user_id", "value", SUPPLY.predicates, supply_fit(cat), types_of(cat, "events"), cat.bounds("events")
    )
    return rows
