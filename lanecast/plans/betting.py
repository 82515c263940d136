"""Joint probabilities, rules, settlement, attribution."""

from __future__ import annotations

from itertools import accumulate, product
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanecast.functions import pricing
from lanecast.operators import folds, joint, metrics, rules, windows
from lanecast.plans.contest import BAND, BASE, candidates, draw_sql, full_fields, races, table
from lanecast.plans.registry import Registry
from lanecast.sources import ledgers

R = Registry()
QUERIES, SQL = R.QUERIES, R.SQL
r9 = lambda c: F.round(c, 9)
THRESHOLDS = {"confidence": (0.2, 0.3), "ev_best": (0.5, 1.0, 1.5), "ev_all": (0.5, 1.0, 1.5)}
GRID = " UNION ALL ".join(f"SELECT '{r}' AS rule, {t}::DOUBLE AS threshold" for r, ts in THRESHOLDS.items() for t in ts)
BETS = f"""ranked AS (SELECT *, p * odds AS ev, row_number() OVER (PARTITION BY race_id ORDER BY p DESC, lane) AS by_p, row_number() OVER (PARTITION BY race_id ORDER BY p * odds DESC NULLS LAST, lane) AS by_ev FROM candidates),
grid AS ({GRID}),
bets AS (SELECT * FROM ranked CROSS JOIN grid WHERE (rule = 'confidence' AND by_p = 1 AND p >= threshold) OR (complete AND ev >= threshold AND (rule = 'ev_all' OR (rule = 'ev_best' AND by_ev = 1))))"""
BOOK = """count(*) AS bets, count(DISTINCT race_id) AS races, sum(hit::BIGINT)::BIGINT AS hits, count(*) FILTER (NOT hit AND ret > 0) AS refunds, round(sum(ret), 9) AS returned, round(sum(ret) / count(*), 9) AS roi, round(sum(hit::BIGINT) / count(*), 9) AS hit_rate,
  round(CASE WHEN count(*) > 10 THEN sum(CASE WHEN hit AND best <= 10 THEN 0 ELSE ret END) / (count(*) - count(*) FILTER (hit AND best <= 10)) END, 9) AS trimmed_roi"""
BEST = "row_number() OVER (PARTITION BY {by} ORDER BY hit DESC, ret DESC, race_id) AS best"


def selected(c: DataFrame) -> DataFrame:
    return rules.select_bets(c, THRESHOLDS, ["race_id"], "lane")


def bets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selected(candidates(spark, sf_dir))


CANDIDATE = ("race_id", "race_date", "lane", "p", "odds", "complete", "ret", "hit")


def kept_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored, for queries that read them more than once."""
    return kept(candidates(spark, sf_dir))


def kept(c: DataFrame) -> DataFrame:
    return ledgers.stored(c.select(*CANDIDATE), "candidates")


def book(d: DataFrame, by: list[str]) -> DataFrame:
    return metrics.rule_book(d, by).withColumns({c: r9(c) for c in ("returned", "roi", "hit_rate", "trimmed_roi")})


def bands(c: DataFrame) -> DataFrame:
    d = rules.priced_cells(c.where("complete").withColumn("band", pricing.price_band(F.col("odds"))), ["band"], 0.5)
    return d.withColumns({x: r9(x) for x in ("hit_rate", "implied", "blind_roi", "ev_roi")})


def counterfactuals(c: DataFrame, b: DataFrame) -> DataFrame:
    """Per rule, threshold and controls: the price band, or the band with the combination (the lane)."""
    band, parts = pricing.price_band(F.col("odds")).alias("band"), []
    for controls, cell in (("band", ["band"]), ("band+combination", ["band", "lane"])):
        cells = rules.band_reference(c.where("complete").select("*", band), cell)
        d = rules.counterfactual(b.select("rule", "threshold", "ret", "lane", band), cells, cell, ["rule", "threshold"])
        parts.append(d.select("rule", "threshold", F.lit(controls).alias("controls"), r9("blind").alias("blind"), r9("covered").alias("covered"), r9("rule_return").alias("rule_roi"), r9("lift").alias("lift")))
    return parts[0].unionByName(parts[1])


def tails(b: DataFrame) -> DataFrame:
    return metrics.tail_concentration(b, ["rule", "threshold"]).withColumns({c: r9(c) for c in ("top_percent_share", "top_ten_share")})


def months(b: DataFrame) -> DataFrame:
    d = b.groupBy("rule", "threshold", F.date_format("race_date", "yyyy-MM").alias("month"))
    return d.agg(F.count(F.lit(1)).alias("bets"), r9(F.avg(F.col("hit").cast("int"))).alias("hit_rate"), r9(F.avg("ret")).alias("roi"))


def realisation(b: DataFrame) -> DataFrame:
    d = metrics.quote_realisation(b.where("hit AND odds IS NOT NULL"), ["rule", "threshold"])
    return d.select("rule", "threshold", "hits", *[r9(old).alias(new) for old, new in (("mean_x", "mean_realisation"), ("median_x", "median_realisation"), ("median_odds", "median_odds"))])


@R.query(f""", cells AS (SELECT {BAND} AS band, count(*) AS n, avg(hit::INT) AS hit_rate, avg(ret) AS blind_roi, avg(1 / odds) AS implied FROM candidates WHERE complete GROUP BY ALL),
{BETS}, e AS (SELECT {BAND} AS band, count(*) AS ev_bets, avg(ret) AS ev_roi FROM bets WHERE rule = 'ev_all' AND threshold = 0.5 GROUP BY ALL)
SELECT band, n, round(hit_rate, 9) AS hit_rate, round(implied, 9) AS implied, round(blind_roi, 9) AS blind_roi, coalesce(ev_bets, 0) AS ev_bets, round(ev_roi, 9) AS ev_roi FROM cells LEFT JOIN e USING (band)""")
def price_band_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per price band: hit rate, implied rate and blind return of all candidates, and what an EV rule gets there."""
    return bands(candidates(spark, sf_dir))


@R.query(f", {BETS}, b AS (SELECT *, {BEST.format(by='rule, threshold')} FROM bets) SELECT rule, threshold, {BOOK} FROM b GROUP BY rule, threshold")
def rule_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    return book(bets(spark, sf_dir), ["rule", "threshold"])


@R.query(f", {BETS} SELECT rule, threshold, race_id, lane, round(ev, 9) AS ev, round(ret, 9) AS ret, hit FROM bets")
def selected_bets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bets(spark, sf_dir).select("rule", "threshold", "race_id", "lane", r9("ev").alias("ev"), r9("ret").alias("ret"), "hit")


@R.query(f""", {BETS}, cells AS (SELECT {BAND} AS band, lane, grouping(lane) AS g, avg(ret) AS blind_roi FROM candidates WHERE complete GROUP BY GROUPING SETS ((band), (band, lane))),
x AS (SELECT b.rule, b.threshold, k.controls, b.ret, c.blind_roi FROM (SELECT *, {BAND} AS band FROM bets) b CROSS JOIN (VALUES ('band', 1), ('band+combination', 0)) k(controls, g) LEFT JOIN cells c ON c.g = k.g AND c.band = b.band AND (k.g = 1 OR c.lane = b.lane))
SELECT rule, threshold, controls, round(avg(blind_roi), 9) AS blind, round(avg((blind_roi IS NOT NULL)::INT), 9) AS covered, round(avg(ret) FILTER (blind_roi IS NOT NULL), 9) AS rule_roi, round(avg(ret) FILTER (blind_roi IS NOT NULL) / nullif(avg(blind_roi), 0), 9) AS lift FROM x GROUP BY rule, threshold, controls""")
def blind_counterfactual(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = kept_candidates(spark, sf_dir)
    return counterfactuals(c, selected(c))


@R.query(f""", {BETS}, x AS (SELECT *, count(*) OVER w AS n, row_number() OVER (PARTITION BY rule, threshold ORDER BY ret DESC, race_id) AS r FROM bets WINDOW w AS (PARTITION BY rule, threshold))
SELECT rule, threshold, max(n) AS n, round(CASE WHEN max(n) >= 2 AND sum(ret) > 0 THEN coalesce(sum(ret) FILTER (r <= greatest(1, n // 100)), 0) / sum(ret) ELSE 0 END, 9) AS top_percent_share,
  round(CASE WHEN max(n) >= 2 AND sum(ret) > 0 THEN sum(ret) FILTER (r <= 10) / sum(ret) ELSE 0 END, 9) AS top_ten_share FROM x GROUP BY rule, threshold""")
def tail_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tails(ledgers.stored(bets(spark, sf_dir).select("rule", "threshold", "ret"), "bets"))


@R.query(f", {BETS} SELECT rule, threshold, strftime(race_date, '%Y-%m') AS month, count(*) AS bets, round(avg(hit::INT), 9) AS hit_rate, round(avg(ret), 9) AS roi FROM bets GROUP BY ALL")
def monthly_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return months(bets(spark, sf_dir))


@R.query(f""", {BETS}, b AS (SELECT *, {BEST.format(by="threshold, cap, lanes_kept, strftime(race_date, '%Y-%m')")} FROM bets, (VALUES (3.0), (6.0), (20.0)) c(cap), (VALUES ('all', 1, 6), ('inner', 1, 3), ('outer', 4, 6)) l(lanes_kept, lo, hi) WHERE rule = 'ev_all' AND odds <= cap AND lane BETWEEN lo AND hi)
SELECT threshold, cap::DOUBLE AS cap, lanes_kept, strftime(race_date, '%Y-%m') AS month, count(*) AS bets, round(avg(ret), 9) AS roi FROM b GROUP BY ALL""")
def rule_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds x price caps x lane groups, by month: what a rule-choosing walk-forward chooses from."""
    caps = spark.createDataFrame([(3.0,), (6.0,), (20.0,)], "cap double")
    lanes = spark.createDataFrame([("all", 1, 6), ("inner", 1, 3), ("outer", 4, 6)], "lanes_kept string, lo int, hi int")
    grid = F.broadcast(caps.crossJoin(lanes))
    d = bets(spark, sf_dir).where("rule = 'ev_all'").crossJoin(grid).where("odds <= cap AND lane BETWEEN lo AND hi")
    return d.groupBy("threshold", "cap", "lanes_kept", F.date_format("race_date", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("bets"), r9(F.avg("ret")).alias("roi"))


@R.query(f""", {BETS}, m AS (SELECT DISTINCT date_trunc('month', race_date)::DATE AS month FROM candidates), f AS (SELECT month, row_number() OVER (ORDER BY month) AS nth FROM m),
x AS (SELECT f.month, b.threshold, b.race_date < f.month AS train, b.ret, b.hit, b.race_id, b.lane FROM bets b JOIN f ON b.race_date < f.month + INTERVAL 1 MONTH WHERE b.rule = 'ev_all' AND f.nth > 12),
y AS (SELECT *, row_number() OVER (PARTITION BY month, threshold ORDER BY hit DESC, ret DESC, race_id, lane) AS best FROM x WHERE train),
z AS (SELECT month, threshold, count(*) AS n, CASE WHEN count(*) > 10 THEN sum(CASE WHEN hit AND best <= 10 THEN 0 ELSE ret END) / (count(*) - count(*) FILTER (hit AND best <= 10)) END AS t FROM y GROUP BY ALL),
c AS (SELECT * FROM z WHERE n >= 300 QUALIFY row_number() OVER (PARTITION BY month ORDER BY t DESC NULLS LAST, threshold) = 1)
SELECT c.month, c.threshold, c.n AS train_bets, round(c.t, 9) AS train_roi, count(x.ret) AS bets, round(avg(x.ret), 9) AS roi FROM c LEFT JOIN x ON x.month = c.month AND x.threshold = c.threshold AND NOT x.train GROUP BY ALL""")
def rule_choosing_walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each month's rule is the best on all months before, by trimmed return with 300 bets or more, and is applied once."""
    c = kept_candidates(spark, sf_dir)
    monthly = metrics.partial_book(rules.select_bets(c, {"ev_all": THRESHOLDS["ev_all"]}, ["race_id"], "lane").withColumn("bet_month", F.trunc("race_date", "month")), ["threshold", "bet_month"])
    d = chosen_by_month(c, monthly, ["threshold"], F.col("threshold"))
    return d.select("month", "threshold", "train_bets", "train_roi", "bets", "roi")


def chosen_by_month(c: DataFrame, monthly: DataFrame, rule: list[str], order: Column, least: int = 300, months: int = 12) -> DataFrame:
    """monthly: partial books by rule and bet_month. Per month after the first `months` the rule that was best before it, and what it returns in it:
    folds add up months, so no bet is copied into the folds after it."""
    f = F.broadcast(folds.monthly_folds(c, "race_date", months).select(F.col("test_start").alias("month")))  # a row a month
    train = metrics.combined_book(monthly.join(f, F.col("bet_month") < F.col("month")), ["month", *rule])
    train = train.select("month", *rule, "bets", r9(metrics.trimmed()).alias("trimmed_roi")).withColumn("grid", order)
    chosen = rules.best_rule(train, ["month"], least).select("month", *rule, F.col("bets").alias("train_bets"), F.col("trimmed_roi").alias("train_roi"))
    test = monthly.select(F.col("bet_month").alias("month"), *rule, "bets", r9(F.col("returned") / F.col("bets")).alias("roi"))
    return chosen.join(test, ["month", *rule], "left").withColumn("bets", F.coalesce("bets", F.lit(0)))


# fixed values: the published grid of rules, in its order
EV_GRID, CAP_GRID = (1.00, 1.05, 1.10, 1.20, 1.35, 1.50), (None, 30.0, 50.0)
LANE_GRID = (("all", 1, 6), ("lane1", 1, 1), ("outside", 2, 6))
RULES = [(n, t, cap, *lanes) for n, (t, cap, lanes) in enumerate(product(EV_GRID, CAP_GRID, LANE_GRID))]
RULES_SQL = ", ".join(f"({n}, {t}::DOUBLE, {cap or 'NULL'}::DOUBLE, '{name}', {lo}, {hi})" for n, t, cap, name, lo, hi in RULES)


@R.query(f""", g(grid, threshold, cap, lanes_kept, lo, hi) AS (VALUES {RULES_SQL}), m AS (SELECT DISTINCT date_trunc('month', race_date)::DATE AS month FROM candidates), f AS (SELECT month, row_number() OVER (ORDER BY month) AS nth FROM m),
b AS (SELECT g.grid, race_date, ret, hit FROM candidates, g WHERE complete AND p * odds >= threshold AND (cap IS NULL OR odds <= cap) AND lane BETWEEN lo AND hi),
x AS (SELECT f.month, b.* FROM b JOIN f ON b.race_date < f.month WHERE f.nth > 12), y AS (SELECT *, row_number() OVER (PARTITION BY month, grid ORDER BY hit DESC, ret DESC) AS best FROM x),
z AS (SELECT month, grid, count(*) AS n, sum(CASE WHEN hit AND best <= 10 THEN 0 ELSE ret END) / (count(*) - count(*) FILTER (hit AND best <= 10)) AS t FROM y GROUP BY ALL HAVING count(*) >= 300),
c AS (SELECT * FROM z QUALIFY row_number() OVER (PARTITION BY month ORDER BY round(t, 9) DESC, grid) = 1)
SELECT c.month, g.threshold, g.cap, g.lanes_kept, c.n AS train_bets, round(c.t, 9) AS train_roi, count(b.ret) AS bets, round(avg(b.ret), 9) AS roi
FROM c JOIN g USING (grid) LEFT JOIN b ON b.grid = c.grid AND date_trunc('month', b.race_date)::DATE = c.month GROUP BY ALL""")
def grid_walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As rule_choosing_walk_forward over the published grid. Bets are summed once a month and rule, with the month's ten
    best hits; folds add up months, so no bet is copied into the folds after it."""
    return grid_choices(kept_candidates(spark, sf_dir))


def grid_choices(c: DataFrame, months: int = 12, least: int = 300) -> DataFrame:
    """Of candidates with their p: the published grid's choices by month."""
    grid = c.sparkSession.createDataFrame(RULES, "grid int, threshold double, cap double, lanes_kept string, lo int, hi int")
    on = (F.col("p") * F.col("odds") >= F.col("threshold")) & (F.col("cap").isNull() | (F.col("odds") <= F.col("cap"))) & F.col("lane").between(F.col("lo"), F.col("hi"))
    b = c.where(F.col("complete") & (F.col("p") * F.col("odds") >= min(EV_GRID))).join(F.broadcast(grid), on)
    monthly = metrics.partial_book(b.withColumn("bet_month", F.trunc("race_date", "month")), ["grid", "bet_month"])
    d = chosen_by_month(c, monthly, ["grid"], F.col("grid"), least, months).join(F.broadcast(grid), "grid")
    return d.select("month", "threshold", "cap", "lanes_kept", "train_bets", "train_roi", "bets", "roi")


@R.query(f""", e AS (SELECT a.race_id, a.lane AS i, b.lane AS j, a.p * b.p / nullif(sum(b.p) OVER (PARTITION BY a.race_id, a.lane), 0) AS p FROM fields a JOIN fields b ON a.race_id = b.race_id AND a.lane <> b.lane)
SELECT race_id, i, j, round(p, 9) AS p FROM e""")
def exacta_joint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joint.exacta(full_fields(spark, sf_dir).select("race_id", "lane", "p")).select("race_id", "i", "j", r9("p").alias("p"))


@R.query(""", e AS (SELECT a.race_id, a.lane AS i, b.lane AS j, a.p AS pi, b.p AS pj, a.p * b.p / nullif(sum(b.p) OVER (PARTITION BY a.race_id, a.lane), 0) AS p FROM fields a JOIN fields b ON a.race_id = b.race_id AND a.lane <> b.lane),
t AS (SELECT e.race_id, i, j, c.lane AS k, e.p * c.p / nullif(sum(c.p) OVER (PARTITION BY e.race_id, i, j), 0) AS p FROM e JOIN fields c ON c.race_id = e.race_id AND c.lane <> i AND c.lane <> j),
c AS (SELECT race_id, 'win' AS pool, p FROM fields UNION ALL SELECT race_id, 'exacta', p FROM e UNION ALL SELECT race_id, 'trifecta', p FROM t
UNION ALL SELECT race_id, 'place', sum(p) FROM (SELECT race_id, p, unnest([i, j]) AS l FROM e) GROUP BY race_id, l
UNION ALL SELECT race_id, 'quinella', sum(p) FROM e GROUP BY race_id, least(i, j), greatest(i, j)
UNION ALL SELECT race_id, 'trio', sum(p) FROM t GROUP BY race_id, list_sort([i, j, k])
UNION ALL SELECT race_id, 'wide', sum(p) FROM (SELECT race_id, p, unnest([[least(i, j), greatest(i, j)], [least(i, k), greatest(i, k)], [least(j, k), greatest(j, k)]]) AS l FROM t) GROUP BY race_id, l)
SELECT race_id, pool, count(*) AS candidates, round(sum(p), 9) AS total, round(max(p), 9) AS highest FROM c GROUP BY ALL""")
def seven_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of all seven pools; sums are 1, but 2 for place and 3 for wide."""
    c = joint.pools(full_fields(spark, sf_dir).select("race_id", "lane", "p"))
    return c.groupBy("race_id", "pool").agg(F.count(F.lit(1)).alias("candidates"), r9(F.sum("p")).alias("total"), r9(F.max("p")).alias("highest"))


@R.query("SELECT race_id, round(sum(1 / odds), 9) AS overround, round(max(1 / odds / s), 9) AS top_market_p, round(-sum(p * log2(p)), 9) AS entropy FROM (SELECT *, sum(1 / odds) OVER (PARTITION BY race_id) AS s FROM fields WHERE p > 0) GROUP BY race_id")
def market_overround(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = full_fields(spark, sf_dir).where("p > 0").withColumn("q", pricing.implied(F.col("odds")))
    d = d.withColumn("m", folds.normalised(d, ["race_id"], "q"))
    return d.groupBy("race_id").agg(r9(F.sum("q")).alias("overround"), r9(F.max("m")).alias("top_market_p"), r9(-F.sum(F.col("p") * F.log2("p"))).alias("entropy"))


@R.query(f""", d AS (SELECT range AS draw FROM range(10)),
r AS (SELECT race_id, list(p ORDER BY lane) AS probs FROM candidates WHERE complete GROUP BY race_id),
w AS (SELECT draw, race_id, row_number() OVER (PARTITION BY draw ORDER BY {draw_sql("0", "draw", "race_id")}, race_id) AS n FROM r CROSS JOIN d),
t AS (SELECT race_id, row_number() OVER (ORDER BY {draw_sql("0", "'to'", "race_id")}, race_id) AS n FROM r),
x AS (SELECT w.draw, t.race_id, o.probs AS other FROM t JOIN w USING (n) JOIN r o ON o.race_id = w.race_id),
y AS (SELECT x.draw, x.race_id, c.ret, other[c.lane] * c.odds AS ev, c.lane FROM x JOIN candidates c USING (race_id) QUALIFY row_number() OVER (PARTITION BY x.draw, x.race_id ORDER BY other[c.lane] * c.odds DESC, c.lane) = 1)
SELECT draw::INT AS draw, count(*) AS bets, round(avg(ret), 9) AS roi FROM y WHERE ev >= 1.0 GROUP BY draw""")
def permutation_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = kept_candidates(spark, sf_dir).where("complete").withColumn("lane", F.col("lane").cast("int"))  # ids, vectors and fields are read apart
    vectors = c.groupBy("race_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("lane", "p"))), lambda s: s["p"]).alias("probs"))
    return rules.permutation_null(vectors, c.select("race_id", "lane", "odds", "ret"), 1.0, 10).withColumn("roi", r9("roi"))


@R.query(f""", d AS (SELECT range AS draw FROM range(10)),
x AS (SELECT draw, race_id, lane, ret, p * odds * exp(0.1 * sqrt(-2 * ln(greatest({draw_sql("0", "draw", "race_id", "lane", "'u'")}, 1e-12))) * cos(2 * 3.141592653589793 * {draw_sql("0", "draw", "race_id", "lane", "'v'")})) AS ev FROM candidates CROSS JOIN d WHERE complete),
y AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY draw, race_id ORDER BY ev DESC, lane) = 1)
SELECT draw::INT AS draw, count(*) AS bets, round(avg(ret), 9) AS roi FROM y WHERE ev >= 1.0 GROUP BY draw""")
def price_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.noise_sensitivity(candidates(spark, sf_dir).where("complete").select("race_id", "lane", "p", "odds", "ret"), 1.0, 0.1, 10).withColumn("roi", r9("roi"))


_POISSON = "CASE " + " ".join(f"WHEN u < {c!r} THEN {k}" for k, c in enumerate(accumulate(0.36787944117144233 / factorial(k) for k in range(8)))) + " ELSE 8 END"


@R.query(f""", {BETS}, x AS (SELECT rule, threshold, ret, draw, {draw_sql("0", "draw", "race_id", "lane")} AS u FROM bets CROSS JOIN (SELECT range AS draw FROM range(50)) WHERE rule = 'ev_best'),
y AS (SELECT rule, threshold, draw, sum(({_POISSON}) * ret) / nullif(sum({_POISSON}), 0) AS roi FROM x GROUP BY ALL)
SELECT rule, threshold, round(quantile_cont(roi, 0.025), 9) AS low, round(quantile_cont(roi, 0.975), 9) AS high, round(avg((roi > 1)::INT), 9) AS p_above_one FROM y GROUP BY ALL""")
def bootstrap_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = metrics.bootstrap(bets(spark, sf_dir).where("rule = 'ev_best'"), ["rule", "threshold"], ["race_id", "lane"], 50)
    return d.withColumns({c: r9(c) for c in ("low", "high", "p_above_one")})


# The reference's numbers of draws over all rows; the queries above are the same operators with fewer draws, held against SQL.
RESAMPLES, PERMUTATIONS, NOISES, SIGMA = 2000, 40, 20, 0.6
REAL = f"(SELECT round(avg(ret), 9) FROM (WITH {BASE}, {BETS} SELECT ret FROM bets WHERE rule = 'ev_best' AND threshold = 1.0))"


def against(null: DataFrame, c: DataFrame, names: dict[str, str]) -> DataFrame:
    """The null's summary beside what ev_best really returns at threshold 1; names: those of the columns wanted."""
    real = rules.select_bets(c, {"ev_best": (1.0,)}, ["race_id"], "lane").agg(r9(F.avg("ret"))).first()[0]
    d = rules.against_null(null.withColumn("roi", r9("roi")), F.lit(real).cast("double")).withColumn("real", F.lit(real).cast("double"))
    return d.select(*[F.round(old, 6).alias(new) for old, new in names.items()])


@R.query(f"SELECT round(avg(roi), 6) AS null_mean, round(max(roi), 6) AS null_max, round(stddev_pop(roi), 6) AS null_sd, round({REAL}, 6) AS real, round(({REAL} - avg(roi)) / nullif(stddev_pop(roi), 0), 6) AS z FROM ({SQL['permutation_null'].replace('range(10)', f'range({PERMUTATIONS})')})", base=False)
def permutation_against_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, greatest and population sd of 40 permutations, the real return and its z."""
    c = kept_candidates(spark, sf_dir)
    d = c.where("complete").withColumn("lane", F.col("lane").cast("int"))
    vectors = d.groupBy("race_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("lane", "p"))), lambda s: s["p"]).alias("probs"))
    null = rules.permutation_null(vectors, d.select("race_id", "lane", "odds", "ret"), 1.0, PERMUTATIONS)
    return against(null, c, {x: x for x in ("null_mean", "null_max", "null_sd", "real", "z")})


@R.query(f"SELECT round(avg(roi), 6) AS noise_mean, round(stddev_pop(roi), 6) AS noise_sd, round({REAL}, 6) AS real FROM ({SQL['price_noise'].replace('range(10)', f'range({NOISES})').replace('0.1 * sqrt', f'{SIGMA} * sqrt')})", base=False)
def price_noise_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and population sd of the return under 20 draws of noise of sigma 0.6, beside the return without."""
    c = candidates(spark, sf_dir)
    null = rules.noise_sensitivity(c.where("complete").select("race_id", "lane", "p", "odds", "ret"), 1.0, SIGMA, NOISES)
    return against(null, c, {"null_mean": "noise_mean", "null_sd": "noise_sd", "real": "real"})


@R.query()
def bootstrap_returns_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As bootstrap_returns, over 2000 resamples. No SQL: every bet once a resample is too slow there."""
    d = metrics.bootstrap(bets(spark, sf_dir).where("rule = 'ev_best'"), ["rule", "threshold"], ["race_id", "lane"], RESAMPLES)
    return d.withColumns({c: r9(c) for c in ("low", "high", "p_above_one")})


@R.query(f""", {BETS}, x AS (SELECT venue, race_date, race_id, ret - 1 AS net, hit, sum(ret - 1) OVER (PARTITION BY venue ORDER BY race_date, race_id ROWS UNBOUNDED PRECEDING) AS cum FROM bets WHERE rule = 'ev_best' AND threshold = 0.5),
y AS (SELECT *, greatest(0, max(cum) OVER (PARTITION BY venue ORDER BY race_date, race_id ROWS UNBOUNDED PRECEDING)) - cum AS dd, row_number() OVER (PARTITION BY venue ORDER BY race_date, race_id) - row_number() OVER (PARTITION BY venue, hit ORDER BY race_date, race_id) AS isl FROM x),
z AS (SELECT venue, hit, isl, count(*) AS run FROM y GROUP BY ALL), s AS (SELECT venue, coalesce(max(run) FILTER (hit), 0) AS longest_win, coalesce(max(run) FILTER (NOT hit), 0) AS longest_loss FROM z GROUP BY venue)
SELECT venue, count(*) AS bets, round(sum(net), 9) AS net, round(max(dd), 9) AS max_drawdown, any_value(longest_win) AS longest_win, any_value(longest_loss) AS longest_loss FROM y JOIN s USING (venue) GROUP BY venue""")
def ledger_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per venue: bets, net, greatest drawdown from a peak of 0 at least, longest streaks."""
    d = bets(spark, sf_dir).where("rule = 'ev_best' AND threshold = 0.5").withColumn("net", F.col("ret") - 1)
    order = [F.col("race_date"), F.col("race_id")]
    g = windows.drawdown(d, ["venue"], order, "net").groupBy("venue").agg(F.count(F.lit(1)).alias("bets"), r9(F.sum("net")).alias("net"), r9(F.max("drawdown")).alias("max_drawdown"))
    return g.join(windows.streaks(d, ["venue"], order, "hit"), "venue")


@R.query(f""", {BETS}, x AS (SELECT race_id, race_date, lane, row_number() OVER (PARTITION BY race_id ORDER BY lane) AS nth, row_number() OVER (PARTITION BY race_date ORDER BY race_id, lane) AS od FROM bets WHERE rule = 'ev_all' AND threshold = 0.5)
SELECT CASE WHEN nth > 1 THEN 'one_bet_per_race' WHEN od * 100 > 1000 THEN 'daily_cap' ELSE 'ok' END AS violation, count(*) AS n FROM x GROUP BY ALL""")
def ledger_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = bets(spark, sf_dir).where("rule = 'ev_all' AND threshold = 0.5").withColumn("bet_id", F.col("lane"))
    return rules.ledger_flags(d, 100, 1000).groupBy(F.coalesce("violation", F.lit("ok")).alias("violation")).agg(F.count(F.lit(1)).alias("n"))


@R.query(""", x AS (SELECT race_id, lane, CASE WHEN rate > 2 THEN rate * 10 END AS q, odds, abs(p - 1 / odds) AS dis, greatest(0, p - (0.01 + 0.5 / sqrt(lanes))) * odds AS ev FROM fields)
SELECT race_id, lane, round(ev, 9) AS ev, nullif(concat_ws(',', CASE WHEN q IS NULL THEN 'DQ_MISSING_REQUIRED_DATA' WHEN q < 50 THEN 'DQ_LOW_DATA_QUALITY' END, CASE WHEN odds IS NULL THEN 'OD_ODDS_MISSING' END,
  CASE WHEN dis IS NULL AND q IS NOT NULL THEN 'DQ_MISSING_REQUIRED_DATA' WHEN dis > 0.3 THEN 'MD_MODEL_DISAGREEMENT' END, CASE WHEN ev IS NULL AND q IS NOT NULL AND dis IS NOT NULL THEN 'DQ_MISSING_REQUIRED_DATA' WHEN ev < 0.05 THEN 'EV_CONSERVATIVE_BELOW_THRESHOLD' END), '') AS skip_reason FROM x""")
def abstentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = full_fields(spark, sf_dir)
    ev = pricing.conservative_value(F.col("p"), pricing.margin(F.lit(0.01), F.col("lanes"), F.lit(0.0), 0.5, 0.0), F.col("odds"))
    d = d.withColumn("ev", ev).withColumn("q", F.when(F.col("rate") > 2, F.col("rate") * 10)).withColumn("dis", F.abs(F.col("p") - pricing.implied(F.col("odds"))))
    return d.select("race_id", "lane", r9("ev").alias("ev"), rules.skip_reason(rules.abstention(F.col("q"), F.col("odds"), F.col("dis"), F.col("ev"), 50, 0.3, 0.05)).alias("skip_reason"))


@R.query("SELECT lane, count(*) AS races, round(sum(ret) / count(*), 9) AS flat_return, round(avg(hit::INT), 9) AS hit_rate FROM candidates GROUP BY lane")
def flat_lane_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates(spark, sf_dir).groupBy("lane").agg(F.count(F.lit(1)).alias("races"), r9(F.sum("ret") / F.count(F.lit(1))).alias("flat_return"), r9(F.avg(F.col("hit").cast("int"))).alias("hit_rate"))


@R.query(", x AS (SELECT *, row_number() OVER (PARTITION BY race_id ORDER BY odds, lane) AS popularity FROM fields) SELECT popularity, count(*) AS n, round(avg(won::INT), 9) AS win_rate, round(avg(CASE WHEN won THEN odds * 0.9 ELSE 0 END), 9) AS roi FROM x GROUP BY popularity")
def popularity_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = windows.top_n(full_fields(spark, sf_dir), ["race_id"], [F.col("odds"), F.col("lane")], 6, "popularity")
    return d.groupBy(F.col("popularity").cast("long").alias("popularity")).agg(F.count(F.lit(1)).alias("n"), r9(F.avg(F.col("won").cast("int"))).alias("win_rate"), r9(F.avg(F.when(F.col("won"), F.col("odds") * 0.9).otherwise(0.0))).alias("roi"))


@R.query(f"SELECT {BAND} AS band, lane, count(*) AS n, round(avg(won::INT), 9) AS win_rate, round(avg(1 / odds), 9) AS implied FROM fields GROUP BY ALL")
def band_by_lane(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = full_fields(spark, sf_dir).groupBy(pricing.price_band(F.col("odds")).alias("band"), "lane")
    return d.agg(F.count(F.lit(1)).alias("n"), r9(F.avg(F.col("won").cast("int"))).alias("win_rate"), r9(F.avg(1 / F.col("odds"))).alias("implied"))


@R.query("SELECT race_class, count(*) AS n, round(avg(r), 9) AS mean, round(avg(r) - CASE WHEN count(*) > 1 THEN 1.96 * sqrt(var_samp(r) / count(*)) ELSE 0 END, 9) AS ci_low, round(avg(r) + CASE WHEN count(*) > 1 THEN 1.96 * sqrt(var_samp(r) / count(*)) ELSE 0 END, 9) AS ci_high, round(count(*) / sum(count(*)) OVER (), 9) AS share, count(*) / sum(count(*)) OVER () > 0.3 AS concentrated FROM (SELECT race_class, ret AS r FROM candidates) GROUP BY race_class")
def subgroup_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = metrics.stability(candidates(spark, sf_dir), "race_class", "ret", 0.95, 0.3)
    return d.withColumns({c: r9(c) for c in ("mean", "ci_low", "ci_high", "share")})


@R.query(f""", {BETS} SELECT rule, threshold, count(*) AS hits, round(avg(ret / odds), 9) AS mean_realisation, round(quantile_cont(ret / odds, 0.5), 9) AS median_realisation, round(quantile_cont(odds, 0.5), 9) AS median_odds FROM bets WHERE hit AND odds IS NOT NULL GROUP BY ALL""")
def quote_realisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return realisation(ledgers.stored(bets(spark, sf_dir).where("hit AND odds IS NOT NULL").select("rule", "threshold", "hit", "odds", "ret"), "bets"))


ROUND_SQL = "(VALUES ('t-2', 0.0, 5.0), ('t-10', 5.0, 20.0), ('t-60', 20.0, 90.0)) w(round, lo, hi)"


@R.query(f"""WITH q AS (SELECT user_id, event_type, ts, value + 1 AS odds, date_trunc('day', ts) + INTERVAL 1 DAY AS deadline FROM events),
l AS (SELECT *, epoch(deadline - ts) / 60.0 AS lead FROM q)
SELECT user_id, event_type, deadline, round, round(arg_max(odds, (ts, -odds)), 9) AS odds FROM l JOIN {ROUND_SQL} ON lead BETWEEN lo AND hi GROUP BY ALL""", base=False)
def market_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest quote of each candidate in each round before the day's end; leads of 5 and 20 are in two rounds."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", F.col("ts").alias("available_at"), (F.col("value") + 1).alias("odds"), F.expr("date_trunc('day', ts) + INTERVAL 1 DAY").alias("deadline"))
    e = e.withColumn("race_id", F.struct("user_id", "deadline"))
    schedule = e.select("race_id", "deadline").distinct()
    d = rules.market_by_round(e.drop("deadline"), schedule, ["race_id", "event_type"], pricing.rounds(spark))
    return d.select("race_id.user_id", "event_type", "race_id.deadline", "round", r9("odds").alias("odds"))


@R.query("SELECT race_date, count(*) AS n FROM races GROUP BY race_date HAVING count(*) > 1")
def busy_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return races(spark, sf_dir).groupBy("race_date").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
