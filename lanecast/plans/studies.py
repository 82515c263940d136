"""Fold summaries, second places, entry courses, deviations and studies over the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lanecast.functions import pricing
from lanecast.operators import folds, metrics, rules
from lanecast.plans import intake, timeline
from lanecast.plans.betting import ROUND_SQL, market_rounds
from lanecast.plans.contest import BAND, candidates, entries, full_fields, runners
from lanecast.plans.registry import Registry

R = Registry()
QUERIES, SQL = R.QUERIES, R.SQL
r9 = lambda c: F.round(c, 9)
loss = lambda c: F.avg(-F.log(F.greatest(F.col(c), F.lit(1e-12))))


@R.query("SELECT count(*) AS folds, round(avg(lane_prior), 6) AS mean_prior, round(avg(model), 6) AS mean_model, round(avg(lane_prior) - avg(model), 6) AS gain, count(*) FILTER (won_fold) AS folds_won FROM (" + timeline.SQL["fold_comparison"] + ")", base=False)
def fold_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unweighted means of the folds' losses, the gain over the prior, folds won."""
    d = timeline.fold_comparison(spark, sf_dir)
    return d.agg(F.count(F.lit(1)).alias("folds"), F.round(F.avg("lane_prior"), 6).alias("mean_prior"), F.round(F.avg("model"), 6).alias("mean_model"), F.round(F.avg("lane_prior") - F.avg("model"), 6).alias("gain"), F.count_if("won_fold").alias("folds_won"))


@R.query(""", s AS (SELECT race_id, any_value(race_date) AS d, min(lane) FILTER (finish = 1) AS a, min(lane) FILTER (finish = 2) AS b, max(p) FILTER (finish = 1) AS pa, max(p) FILTER (finish = 2) AS pb FROM fields GROUP BY race_id), m AS (SELECT DISTINCT date_trunc('month', d)::DATE AS m FROM s), f AS (SELECT m AS month FROM (SELECT m, row_number() OVER (ORDER BY m) AS nth FROM m) WHERE nth > 12),
n AS (SELECT month, a, b, count(*) AS n FROM s JOIN f ON d < month GROUP BY ALL), t AS (SELECT month, a, sum(n) AS t FROM n GROUP BY ALL),
x AS (SELECT f.month, s.*, (coalesce(n.n, 0) + 1) / (coalesce(t.t, 0) + 5) AS q FROM s JOIN f ON date_trunc('month', d)::DATE = f.month LEFT JOIN n ON n.month = f.month AND n.a = s.a AND n.b = s.b LEFT JOIN t ON t.month = f.month AND t.a = s.a)
SELECT month, count(*) AS races, round(avg(-ln(greatest(q, 1e-12))), 9) AS lane_counts, round(avg(-ln(greatest(pb / (1 - pa), 1e-12))), 9) AS plackett_luce FROM x GROUP BY month""")
def second_place_by_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out loss of the second place given the first: smoothed counts of all months before, and Plackett-Luce.

    Counts are summed once a month; folds add up months."""
    at = lambda n, c: F.max(F.when(F.col("finish") == n, F.col(c)))
    s = full_fields(spark, sf_dir).groupBy("race_id", F.trunc("race_date", "month").alias("month")).agg(at(1, "lane").alias("a"), at(2, "lane").alias("b"), at(1, "p").alias("pa"), at(2, "p").alias("pb"))
    monthly = s.groupBy(F.col("month").alias("of"), "a", "b").agg(F.count(F.lit(1)).alias("n"))  # 30 rows a month at most
    f = folds.monthly_folds(s, "month", 12).select(F.col("test_start").alias("month"))
    n = monthly.join(F.broadcast(f), F.col("of") < F.col("month")).groupBy("month", "a", "b").agg(F.sum("n").alias("n"))
    t = n.groupBy("month", "a").agg(F.sum("n").alias("t"))
    x = s.join(F.broadcast(f), "month").join(n, ["month", "a", "b"], "left").join(t, ["month", "a"], "left")
    x = x.withColumn("q", (F.coalesce("n", F.lit(0)) + 1) / (F.coalesce("t", F.lit(0)) + 5)).withColumn("pl", F.col("pb") / F.nullif(1 - F.col("pa"), F.lit(0.0)))
    return x.groupBy("month").agg(F.count(F.lit(1)).alias("races"), r9(loss("q")).alias("lane_counts"), r9(loss("pl")).alias("plackett_luce"))


_FIXED = (0.55, 0.15, 0.12, 0.1, 0.05, 0.03)


@R.query(f", d(lane, q) AS (VALUES {', '.join(f'({n}, {q}::DOUBLE)' for n, q in enumerate(_FIXED, 1))}), x AS (SELECT race_id, -ln(max(q) FILTER (won)) AS l, sum((q - won::INT) ** 2) AS b, arg_max(won, q) AS t FROM fields JOIN d USING (lane) GROUP BY race_id) SELECT count(*) AS n, round(avg(l), 9) AS log_loss, round(avg(b), 9) AS brier, round(avg(t::INT), 9) AS accuracy FROM x")
def fixed_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One distribution over the lanes, evaluated on every race."""
    q = F.broadcast(spark.createDataFrame(list(enumerate(_FIXED, 1)), "lane long, q double"))
    d = metrics.race_losses(full_fields(spark, sf_dir).join(q, "lane"), ["race_id"], "q", "won")
    return metrics.summary(d, []).select("n", r9("log_loss").alias("log_loss"), r9("brier").alias("brier"), r9("accuracy").alias("accuracy"))


@R.query(""", n AS (SELECT venue, lane, finish AS course, count(*) AS n FROM fields GROUP BY ALL), q AS (SELECT *, n / sum(n) OVER (PARTITION BY venue, lane) AS q FROM n),
e AS (SELECT venue, lane, arg_max(course, (n, -course)) AS expected_course, -sum(q * log2(q)) AS entropy FROM q GROUP BY ALL)
SELECT venue, lane, expected_course, expected_course <> lane AS changed, round(entropy, 9) AS entropy, CASE WHEN entropy > 2.0 THEN 'RC_ENTRY_CHANGE' END AS reason FROM e""")
def entry_courses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each lane's distribution over courses: the likeliest, whether it differs, its entropy, and the reason if above 2 bits."""
    n = full_fields(spark, sf_dir).groupBy("venue", "lane", F.col("finish").alias("course")).agg(F.count(F.lit(1)).alias("n"))
    n = n.withColumn("q", folds.normalised(n, ["venue", "lane"], "n"))
    top = n.groupBy("venue", "lane").agg(F.max_by("course", F.struct("n", -F.col("course"))).alias("expected_course"))
    d = top.join(metrics.entropy_bits(n, ["venue", "lane"], "q"), ["venue", "lane"])
    return d.select("venue", "lane", "expected_course", (F.col("expected_course") != F.col("lane")).alias("changed"), r9("entropy").alias("entropy"), F.when(F.col("entropy") > 2.0, "RC_ENTRY_CHANGE").alias("reason"))


@R.query("SELECT CASE WHEN max_log IS NULL THEN 'DQ_MISSING_REQUIRED_DATA' WHEN max_log > 0.8 THEN 'OD_ODDS_UNEXPECTED_VS_MODEL' ELSE 'ok' END AS reason, count(*) AS n, count(*) FILTER (missing_lanes <> '') AS with_missing FROM (" + intake.SQL["race_deviations"] + ") GROUP BY 1", base=False)
def deviation_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Races by what the greatest deviation of their field says about betting on them."""
    d = intake.race_deviations(spark, sf_dir)
    reason = F.coalesce(rules.deviation_reason(F.col("max_log"), 0.8), F.lit("ok"))
    return d.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("missing_lanes") != "").alias("with_missing"))


_CUT = "count(*) AS n, round(avg(hit::INT), 9) AS win_rate, round(avg(ret), 9) AS roi, round(CASE WHEN count(*) > 1 THEN 1.96 * sqrt(var_samp(ret) / count(*)) ELSE 0 END, 9) AS half_width"


@R.query(f", x AS (SELECT race_id, arg_max(hit, (p, -lane)) AS hit, arg_max(ret, (p, -lane)) AS ret, any_value(venue)::VARCHAR AS v, any_value(race_class) AS c, month(any_value(race_date))::VARCHAR AS m FROM candidates GROUP BY race_id), y AS (SELECT hit, ret, unnest([struct_pack(cut := 'venue', value := v), struct_pack(cut := 'class', value := c), struct_pack(cut := 'month', value := m)]) AS k FROM x) SELECT k.cut AS cut, k.value AS value, {_CUT} FROM y GROUP BY ALL")
def favourite_by_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The favourite's win rate and return by venue, class and month, with the half width of its interval."""
    order = F.struct("p", -F.col("lane"))
    x = candidates(spark, sf_dir).groupBy("race_id", "venue", "race_class", "race_date").agg(F.max_by("hit", order).alias("hit"), F.max_by("ret", order).alias("ret"))
    cut = lambda name, c: F.struct(F.lit(name).alias("cut"), c.cast("string").alias("value"))
    y = x.select("hit", "ret", F.inline(F.array(cut("venue", F.col("venue")), cut("class", F.col("race_class")), cut("month", F.month("race_date")))))
    half = F.when(F.count(F.lit(1)) > 1, 1.96 * F.sqrt(F.var_samp("ret") / F.count(F.lit(1)))).otherwise(0.0)
    return y.groupBy("cut", "value").agg(F.count(F.lit(1)).alias("n"), r9(F.avg(F.col("hit").cast("int"))).alias("win_rate"), r9(F.avg("ret")).alias("roi"), r9(half).alias("half_width"))


@R.query(", s AS (SELECT racer, lane, count(*) AS n, avg(won::INT) AS r, sum(won::INT) AS w FROM fields GROUP BY ALL), m AS (SELECT lane, count(*) AS racers, sum(w) / sum(n) AS m, var_samp(r) AS v, avg(1 / n) AS i FROM s GROUP BY lane) SELECT lane, racers, round(m, 9) AS base, round(CASE WHEN v > m * (1 - m) * i THEN (m * (1 - m) - v) / (v - m * (1 - m) * i) END, 4) AS k FROM m")
def shrinkage_constants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per course the beta-binomial's mean and weight by the method of moments; null where racers don't differ beyond chance."""
    s = full_fields(spark, sf_dir).groupBy("racer", "lane").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("won").cast("int")).alias("r"), F.count_if("won").alias("w"))
    g = s.groupBy("lane").agg(F.count(F.lit(1)).alias("racers"), (F.sum("w") / F.sum("n")).alias("m"), F.var_samp("r").alias("v"), F.avg(1 / F.col("n")).alias("i"))
    spread = F.col("m") * (1 - F.col("m"))
    return g.select("lane", "racers", r9("m").alias("base"), F.round(F.when(F.col("v") > spread * F.col("i"), (spread - F.col("v")) / F.nullif(F.col("v") - spread * F.col("i"), F.lit(0.0))), 4).alias("k"))


_ROUNDS = f"""WITH q AS (SELECT user_id, event_type, ts, value + 1 AS odds, date_trunc('day', ts) + INTERVAL 1 DAY AS deadline FROM events), l AS (SELECT *, epoch(deadline - ts) / 60.0 AS lead FROM q),
m AS (SELECT user_id, event_type, deadline, round, round(arg_max(odds, (ts, -odds)), 9) AS odds FROM l JOIN {ROUND_SQL} ON lead BETWEEN lo AND hi GROUP BY ALL),
x AS (SELECT user_id, event_type, deadline, max(odds) FILTER (round = 't-60') AS early, max(odds) FILTER (round <> 't-60') AS late FROM m GROUP BY ALL)"""


@R.query(_ROUNDS + " SELECT " + BAND.replace("odds", "early") + " AS band, event_type = 'purchase' AS won, count(*) AS n, round(avg(late / early), 6) AS drift FROM x WHERE early IS NOT NULL AND late IS NOT NULL GROUP BY ALL", base=False)
def quote_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Late over early quote of winners and losers by band of the early quote; purchases stand for winners."""
    early = F.col("round") == "t-60"
    x = market_rounds(spark, sf_dir).groupBy("user_id", "event_type", "deadline").agg(F.max(F.when(early, F.col("odds"))).alias("early"), F.max(F.when(~early, F.col("odds"))).alias("late")).where("early IS NOT NULL AND late IS NOT NULL")
    return x.groupBy(pricing.price_band(F.col("early")).alias("band"), (F.col("event_type") == "purchase").alias("won")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("late") / F.col("early")), 6).alias("drift"))


@R.query(", a AS (SELECT race_id, lane, odds, quantity FROM entries WHERE race_id % 3 <> 0), b AS (SELECT race_id, lane, CASE WHEN lane = 3 THEN odds + 1 ELSE odds END AS odds, CASE WHEN lane <> 5 THEN quantity END AS quantity FROM entries WHERE race_id % 2 = 0), x AS (SELECT a.race_id AS ra, b.race_id AS rb, a.odds AS oa, b.odds AS ob, a.quantity AS qa, b.quantity AS qb FROM a FULL JOIN b ON a.race_id = b.race_id AND a.lane = b.lane) SELECT count(*) FILTER (ra IS NULL) AS only_second, count(*) FILTER (rb IS NULL) AS only_first, count(*) FILTER (oa = ob) AS same_odds, count(*) FILTER (ra IS NOT NULL AND rb IS NOT NULL AND oa IS DISTINCT FROM ob) AS other_odds, count(*) FILTER (qa = qb) AS same_quantity, count(*) FILTER (ra IS NOT NULL AND rb IS NOT NULL AND qa IS DISTINCT FROM qb) AS other_quantity FROM x")
def feed_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two feeds of the same rows, field by field."""
    e = entries(spark, sf_dir)
    a = e.where("race_id % 3 <> 0").select("race_id", "lane", F.struct("odds", "quantity").alias("a"))
    b = e.where("race_id % 2 = 0").select("race_id", "lane", F.struct(F.when(F.col("lane") == 3, F.col("odds") + 1).otherwise(F.col("odds")).alias("odds"), F.when(F.col("lane") != 5, F.col("quantity")).alias("quantity")).alias("b"))
    x = a.join(b, ["race_id", "lane"], "full_outer")
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    out = [F.count_if(F.col("a").isNull()).alias("only_second"), F.count_if(F.col("b").isNull()).alias("only_first")]
    for c in ("odds", "quantity"):
        same = F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
        out += [F.count_if(both & same).alias(f"same_{c}"), F.count_if(both & ~same).alias(f"other_{c}")]
    return x.agg(*out)


@R.query(", h AS (SELECT DISTINCT racer FROM runners WHERE finished AND won), x AS (SELECT race_id, bool_and(racer IN (SELECT racer FROM h)) AS all_known, bool_or(racer IN (SELECT racer FROM h)) AS any_known FROM runners GROUP BY race_id) SELECT all_known, any_known, count(*) AS races FROM x GROUP BY ALL")
def races_with_known_racers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether all racers of a race, or any, have won a finished race."""
    d = runners(spark, sf_dir)
    h = d.where("finished AND won").select("racer").distinct().withColumn("known", F.lit(True))
    k = F.coalesce("known", F.lit(False))
    x = d.join(h, "racer", "left").groupBy("race_id").agg(F.bool_and(k).alias("all_known"), F.bool_or(k).alias("any_known"))
    return x.groupBy("all_known", "any_known").agg(F.count(F.lit(1)).alias("races"))


@R.query(""", f AS (SELECT race_id, racer, p, finish, race_date, venue FROM fields), x AS (SELECT a.racer AS a, b.racer AS b, a.venue, a.race_date < DATE '1998-01-01' AS early, (a.finish < b.finish)::INT - a.p / (a.p + b.p) AS r FROM f a JOIN f b ON a.race_id = b.race_id AND a.racer < b.racer),
y AS (SELECT a, b, venue, avg(r) FILTER (early) AS u, avg(r) FILTER (NOT early) AS v FROM x GROUP BY ALL) SELECT count(*) AS pairs, round(corr(u, v), 6) AS persistence FROM y WHERE u IS NOT NULL AND v IS NOT NULL""")
def head_to_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a pair's results against each other, beyond their probabilities, persist at a venue from one half to the other.
    A race has fifteen pairs at most, so they are made within its row."""
    f = full_fields(spark, sf_dir).groupBy("race_id", "venue", "race_date").agg(F.collect_list(F.struct("racer", "p", "finish")).alias("f"))
    x = f.withColumn("a", F.explode("f")).withColumn("b", F.explode("f")).where("a.racer < b.racer")
    r = (F.col("a.finish") < F.col("b.finish")).cast("int") - F.col("a.p") / (F.col("a.p") + F.col("b.p"))
    early = F.col("race_date") < F.lit("1998-01-01").cast("date")
    y = x.groupBy(F.col("a.racer").alias("one"), F.col("b.racer").alias("other"), "venue").agg(F.avg(F.when(early, r)).alias("u"), F.avg(F.when(~early, r)).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    return y.agg(F.count(F.lit(1)).alias("pairs"), F.round(F.corr("u", "v"), 6).alias("persistence"))


@R.query(", d AS (SELECT racer, date_trunc('quarter', race_date)::DATE AS q, avg((7 - finish) / 6.0) AS s, avg(p) AS skill FROM fields GROUP BY ALL), g AS (SELECT regr_slope(s, skill) AS k, regr_intercept(s, skill) AS c FROM d), r AS (SELECT racer, q, s - (c + k * skill) AS e FROM d, g), l AS (SELECT e, lead(e) OVER (PARTITION BY racer ORDER BY q) AS n FROM r) SELECT count(*) AS n, round((SELECT k FROM g), 6) AS slope, round(corr(e, n), 6) AS persistence FROM l WHERE n IS NOT NULL")
def residual_persistence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a racer's quarter has beyond its overall skill, against the next quarter's."""
    d = full_fields(spark, sf_dir).groupBy("racer", F.trunc("race_date", "quarter").alias("q")).agg(F.avg((7 - F.col("finish")) / 6.0).alias("s"), F.avg("p").alias("skill"))
    g = d.agg(F.regr_slope("s", "skill").alias("k"), F.regr_intercept("s", "skill").alias("c"))
    r = d.crossJoin(F.broadcast(g)).withColumn("e", F.col("s") - (F.col("c") + F.col("k") * F.col("skill")))  # one row
    l = r.withColumn("n", F.lead("e").over(Window.partitionBy("racer").orderBy("q"))).where("n IS NOT NULL")
    return l.agg(F.count(F.lit(1)).alias("n"), F.round(F.max("k"), 6).alias("slope"), F.round(F.corr("e", "n"), 6).alias("persistence"))
