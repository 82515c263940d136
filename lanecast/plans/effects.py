"""Studies of effects: overround and its floor, events with controls, same-day comparisons, aptitude, the top racer's margin."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanecast.functions import pricing
from lanecast.operators import effects, metrics, ranks
from lanecast.plans.contest import candidates, full_fields, runners, table
from lanecast.plans.registry import Registry
from lanecast.sources import ledgers

R = Registry()
QUERIES, SQL = R.QUERIES, R.SQL
r9 = lambda c: F.round(c, 9)
SHARES = {"p05": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95}


@R.query(", o AS (SELECT race_id, sum(1 / odds) AS o FROM fields GROUP BY race_id) SELECT count(*) AS n, round(min(o), 9) AS lowest, round(max(o), 9) AS highest, round(avg(o), 9) AS mean, round(avg(1 - 1 / o), 9) AS takeout, " + ", ".join(f"round(quantile_cont(o, {q}), 9) AS {name}" for name, q in SHARES.items()) + " FROM o")
def overround_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over all races, with exact quantiles from a sketch's brackets."""
    o = ledgers.stored(full_fields(spark, sf_dir).groupBy("race_id").agg(F.sum(pricing.implied(F.col("odds"))).alias("o")).select("o"), "overround")
    at = ranks.values_at(o, [], "o", {k: v for name, q in SHARES.items() for k, v in ranks.quantile(name, q).items()})
    sums = o.agg(F.min("o").alias("lowest"), F.max("o").alias("highest"), F.avg("o").alias("mean"), F.avg(1 - 1 / F.col("o")).alias("takeout"))
    return sums.crossJoin(F.broadcast(at)).select("n", *[r9(c).alias(c) for c in ("lowest", "highest", "mean", "takeout")], *[r9(ranks.interpolated(name, q)).alias(name) for name, q in SHARES.items()])  # one row each


FLOOR, WIDE = 1.5, 1.9
_FLOORED = f", x AS (SELECT race_id, hit, ret, greatest(odds, {FLOOR}) AS odds, odds <= {FLOOR} AS low FROM candidates WHERE complete)"


@R.query(_FLOORED + f""", r AS (SELECT race_id, sum(1 / odds) AS o, min(odds) AS shortest, max(odds) AS longest, count(*) AS n, count(*) FILTER (low) AS nf, coalesce(sum(ret) FILTER (low), 0) AS sf, sum(ret) AS s, count(*) FILTER (low AND hit) AS hf, count(*) FILTER (hit) AS h FROM x GROUP BY race_id)
SELECT o < {WIDE} AS low, nf > 0 AS at_floor, count(*) AS races, round(avg(1 - 1 / o), 9) AS takeout, round(avg(shortest), 9) AS shortest, round(avg(longest), 9) AS longest, sum(nf)::BIGINT AS floor_bets, round(sum(hf) / nullif(sum(nf), 0), 9) AS floor_hit_rate, round(sum(sf) / nullif(sum(nf), 0), 9) AS floor_return,
  (sum(n) - sum(nf))::BIGINT AS other_bets, round((sum(h) - sum(hf)) / nullif(sum(n) - sum(nf), 0), 9) AS other_hit_rate, round((sum(s) - sum(sf)) / nullif(sum(n) - sum(nf), 0), 9) AS other_return FROM r GROUP BY ALL""")
def floor_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Races by overround and whether a boat stands at the lowest quote; backing that boat against all others."""
    c = candidates(spark, sf_dir).where("complete").withColumn("odds", F.greatest(F.col("odds"), F.lit(FLOOR)))
    d = metrics.floor_effect(c, FLOOR, WIDE)
    return d.withColumns({x: r9(x) for x in ("takeout", "shortest", "longest", "floor_hit_rate", "floor_return", "other_hit_rate", "other_return")})


DAYS = 5


@R.query(f"""WITH p AS (SELECT user_id, ts::DATE AS day, sum(value) AS s, count(value) AS n FROM events GROUP BY ALL), t AS (SELECT user_id, min(ts)::DATE AS since FROM events WHERE event_type = 'purchase' AND value >= 150 GROUP BY user_id),
c AS (SELECT DISTINCT since AS cohort FROM t),
d AS (SELECT cohort, user_id, coalesce(since = cohort, false) AS own, sum(s) FILTER (day >= cohort) / sum(n) FILTER (day >= cohort) - sum(s) FILTER (day < cohort) / sum(n) FILTER (day < cohort) AS d
  FROM p LEFT JOIN t USING (user_id) JOIN c ON day BETWEEN cohort - {DAYS} AND cohort + {DAYS - 1} WHERE since IS NULL OR since = cohort OR since >= cohort + {DAYS} GROUP BY ALL HAVING d IS NOT NULL),
g AS (SELECT cohort, count(*) FILTER (own) AS n, avg(d) FILTER (own) AS e, count(*) FILTER (NOT own) AS m, avg(d) FILTER (NOT own) AS k FROM d GROUP BY cohort HAVING n > 0 AND m > 0),
a AS (SELECT sum(n) AS total, sum(n * e) / sum(n) AS e, sum(n * k) / sum(n) AS k FROM g),
s AS (SELECT user_id, sum(CASE WHEN own THEN (d - g.e) / total ELSE -(d - g.k) * n / (m * total) END) AS score, max(own::INT) AS own, max((NOT own)::INT) AS other FROM d JOIN g USING (cohort), a GROUP BY user_id)
SELECT sum(own)::BIGINT AS subjects, sum(other)::BIGINT AS controls, round(any_value(a.e), 9) AS effect, round(any_value(a.k), 9) AS control, round(any_value(a.e - a.k), 9) AS difference, round(sqrt(sum(score * score)), 9) AS se FROM s, a""", base=False)
def event_differences_with_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spending around a subject's first large purchase, beside subjects who haven't made theirs yet."""
    e = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    treated = e.where("event_type = 'purchase' AND value >= 150").groupBy("user_id").agg(F.min("day").alias("since"))
    d = effects.difference_in_differences(e.select("user_id", "day", "value"), treated, "user_id", "day", "value", DAYS)
    return d.select("subjects", "controls", *[r9(c).alias(c) for c in ("effect", "control", "difference", "se")])


@R.query(""", f AS (SELECT racer, date_trunc('quarter', race_date) AS q, min(race_date) AS since FROM runners WHERE finished AND quantity <= 2 GROUP BY ALL),
x AS (SELECT c.lane, c.race_date, c.ret, coalesce(c.race_date > f.since, false) AS flag FROM candidates c LEFT JOIN f ON f.racer = c.racer AND f.q = date_trunc('quarter', c.race_date)),
d AS (SELECT lane, race_date, count(*) FILTER (flag) AS a, avg(ret) FILTER (flag) AS ma, count(*) FILTER (NOT flag) AS b, avg(ret) FILTER (NOT flag) AS mb FROM x GROUP BY ALL)
SELECT lane, count(*) AS days, sum(a)::BIGINT AS flagged, sum(b)::BIGINT AS others, round(sum(a * ma) / sum(a), 9) AS flagged_mean, round(sum(a * mb) / sum(a), 9) AS others_mean, round(sum(a * ma) / sum(a) - sum(a * mb) / sum(a), 9) AS difference FROM d WHERE a > 0 AND b > 0 GROUP BY lane""")
def same_day_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Return of racers who hold a mark of their quarter (from the day after it) against that of the others of the same lane and day:
    what a bettor can choose between, not the racer against an earlier self."""
    q = F.trunc("race_date", "quarter")
    marks = runners(spark, sf_dir).where("finished AND quantity <= 2").groupBy("racer", q.alias("quarter")).agg(F.min("race_date").alias("since"))
    d = candidates(spark, sf_dir).withColumn("quarter", q).join(marks, ["racer", "quarter"], "left").withColumn("flag", F.coalesce(F.col("race_date") > F.col("since"), F.lit(False)))
    d = effects.same_day_comparison(d, ["lane"], "race_date", "flag", "ret")
    return d.withColumns({c: r9(c) for c in ("flagged_mean", "others_mean", "difference")})


SWEEPS = 3


def _two_way_sql() -> str:
    out = ", y0 AS (SELECT (race_date >= DATE '1998-01-01')::INT AS half, racer, venue, lane, count(*) AS n, sum((7 - finish) / 6.0)::DOUBLE AS total, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b FROM runners WHERE finished GROUP BY ALL)"
    for k in range(SWEEPS):
        out += f", u{k} AS (SELECT * REPLACE (sum(total - n * b) OVER w / sum(n) OVER w AS a) FROM y{k} WINDOW w AS (PARTITION BY half, venue, lane)), y{k + 1} AS (SELECT * REPLACE (sum(total - n * a) OVER w / sum(n) OVER w AS b) FROM u{k} WINDOW w AS (PARTITION BY half, racer))"
    return out + f""", i AS (SELECT half, racer, lane, sum(n)::DOUBLE AS n, sum(total - n * (a + b)) / sum(n) AS v FROM y{SWEEPS} GROUP BY ALL), m AS (SELECT half, racer, sum(n)::DOUBLE AS n, sum(n * b) / sum(n) AS v FROM y{SWEEPS} GROUP BY ALL),
j AS (SELECT 'all lanes' AS scope, e.v AS x, l.v AS y, e.n * l.n / (e.n + l.n) AS w FROM i e JOIN i l ON e.half = 0 AND l.half = 1 AND e.racer = l.racer AND e.lane = l.lane
UNION ALL SELECT 'lane ' || e.lane, e.v, l.v, e.n * l.n / (e.n + l.n) FROM i e JOIN i l ON e.half = 0 AND l.half = 1 AND e.racer = l.racer AND e.lane = l.lane
UNION ALL SELECT 'racer (control)', e.v, l.v, e.n * l.n / (e.n + l.n) FROM m e JOIN m l ON e.half = 0 AND l.half = 1 AND e.racer = l.racer),
c AS (SELECT scope, count(*) AS pairs, sum(w * x * y) / sum(w) - sum(w * x) / sum(w) * sum(w * y) / sum(w) AS xy, sum(w * x * x) / sum(w) - (sum(w * x) / sum(w)) ** 2 AS xx, sum(w * y * y) / sum(w) - (sum(w * y) / sum(w)) ** 2 AS yy FROM j GROUP BY scope)
SELECT scope, pairs, round(CASE WHEN xx > 1e-15 AND yy > 1e-15 THEN xy / sqrt(xx * yy) END, 6) AS persistence FROM c"""


@R.query(_two_way_sql())
def lane_aptitude_persistence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Early against late: what a racer does on a lane beyond the venue's lane and the racer's own level, by lane and over all, and the
    racer's own level as the control."""
    d = runners(spark, sf_dir).where("finished").withColumn("half", (F.col("race_date") >= F.lit("1998-01-01").cast("date")).cast("int")).withColumn("score", pricing.finish_score(F.col("finish"), F.lit(True)))
    fit = ledgers.stored(effects.two_way(d, ["half"], ["racer"], ["venue", "lane"], "score", SWEEPS), "two-way")
    level = F.sum(F.col("n") * F.col("b")) / F.sum("n")
    parts = [
        effects.persistence(fit, "half", ["racer", "lane"], effects.interaction()).withColumn("scope", F.lit("all lanes")),
        effects.persistence(fit, "half", ["racer", "lane"], effects.interaction(), ["lane"]).withColumn("scope", F.concat(F.lit("lane "), F.col("lane"))).drop("lane"),
        effects.persistence(fit, "half", ["racer"], level).withColumn("scope", F.lit("racer (control)")),
    ]
    return reduce(DataFrame.unionByName, parts).select("scope", "pairs", F.round("persistence", 6).alias("persistence"))


_TOP = """, t AS (SELECT race_id, arg_max(lane, (rate, -lane)) AS lane, (6 * max(quantity) - sum(quantity)) / 25 AS gap, count(*) FILTER (racer % 50 > 0 AND racer % 4 = 0) AS a1 FROM fields GROUP BY race_id),
b AS (SELECT t.*, c.hit, c.ret FROM t JOIN candidates c USING (race_id, lane))"""


def top_racers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per settled race the racer of highest rate, with the margin over the mean of the other five (from whole quantities, so that ties are ties) and the field's count of class A1."""
    best = F.struct("rate", -F.col("lane"))
    a1 = F.count_if((F.col("racer") % 50 > 0) & (F.col("racer") % 4 == 0))
    one = F.max_by(F.struct("lane", "hit", "ret"), best)
    d = candidates(spark, sf_dir).groupBy("race_id").agg(one.alias("top"), ((6 * F.max("quantity") - F.sum("quantity")) / 25).alias("gap"), a1.alias("a1"))
    return d.select("race_id", "top.*", "gap", "a1")


@R.query(_TOP + """, n AS (SELECT *, row_number() OVER (ORDER BY gap) AS r, count(*) OVER () AS n FROM b), k AS (SELECT max(gap) FILTER (r = (n + 2) // 3) AS c1, max(gap) FILTER (r = (2 * n + 2) // 3) AS c2 FROM n)
SELECT lane, CASE WHEN gap <= c1 THEN 1 WHEN gap <= c2 THEN 2 ELSE 3 END::BIGINT AS third, count(*) AS races, round(avg(hit::INT), 9) AS win_rate, round(avg(ret), 9) AS roi FROM b, k GROUP BY ALL""")
def top_racer_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Backing the top racer, by lane and by third of the margin over all races."""
    d = ledgers.stored(top_racers(spark, sf_dir), "top-racers")
    cut = ranks.thirds(d, [], "gap").drop("n")
    d = d.crossJoin(F.broadcast(cut)).withColumn("third", ranks.third(F.col("gap")))  # one row
    return d.groupBy("lane", "third").agg(F.count(F.lit(1)).alias("races"), r9(F.avg(F.col("hit").cast("int"))).alias("win_rate"), r9(F.avg("ret")).alias("roi"))


@R.query(_TOP + " SELECT a1, count(*) AS races, round(avg(hit::INT), 9) AS win_rate, round(avg(ret), 9) AS roi, round(avg(ret) FILTER (lane = 1), 9) AS lane1_roi FROM b GROUP BY a1")
def top_racer_by_a1_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = top_racers(spark, sf_dir).groupBy("a1")
    return d.agg(F.count(F.lit(1)).alias("races"), r9(F.avg(F.col("hit").cast("int"))).alias("win_rate"), r9(F.avg("ret")).alias("roi"), r9(F.avg(F.when(F.col("lane") == 1, F.col("ret")))).alias("lane1_roi"))
