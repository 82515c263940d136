"""Point in time, windows, features, folds, calibration, quality over the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lanecast.functions import keys, pricing, text
from lanecast.operators import features, folds, metrics, quality, ranks, temporal, windows
from lanecast.plans.contest import entries, full_fields, races, runners, table
from lanecast.plans.registry import Registry
from lanecast.sources import ledgers

R = Registry()
QUERIES, SQL = R.QUERIES, R.SQL
r9 = lambda c: F.round(c, 9)


@R.query(", v AS (SELECT racer, available_at, avg(rate) AS rate FROM entries GROUP BY ALL), w AS (SELECT *, lead(available_at) OVER (PARTITION BY racer ORDER BY available_at) AS until FROM v) SELECT r.race_id, r.lane, round(w.rate, 9) AS known_rate FROM runners r LEFT JOIN w ON w.racer = r.racer AND w.available_at <= r.deadline AND (w.until IS NULL OR r.deadline < w.until)")
def point_in_time_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Version of the racer's rate that was in force at the deadline, by one sort of versions and deadlines together."""
    v = entries(spark, sf_dir).groupBy("racer", "available_at").agg(F.avg("rate").alias("known"))
    d = temporal.asof_join(runners(spark, sf_dir).select("race_id", "lane", "racer", "deadline"), v, ["racer"], "deadline", "available_at", ["known"])
    return d.select("race_id", "lane", r9("known").alias("known_rate"))


@R.query(""", q AS (SELECT user_id, ts, max(event_id) AS event_id FROM events GROUP BY ALL), e AS (SELECT user_id, ts, min(event_id) AS first_id, arg_min(value, event_id) AS value FROM events GROUP BY ALL)
SELECT q.user_id, q.ts, round(e.value, 9) AS value, e.value IS NOT NULL AS found FROM q ASOF LEFT JOIN e ON q.user_id = e.user_id AND q.ts - INTERVAL 1 DAY >= e.ts""")
def asof_latest_quote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest event of the user known a day before each of its times, and whether there is one."""
    e = table(spark, sf_dir, "events")
    q = e.select("user_id", "ts").distinct().withColumn("at", F.expr("ts - INTERVAL 1 DAY"))
    d = temporal.asof_join(q, e.select("user_id", F.col("ts").alias("known_at"), "value", "event_id"), ["user_id"], "at", "known_at", ["value"], "event_id")
    return d.select("user_id", "ts", r9("value").alias("value"), "found")


@R.query(", v AS (SELECT *, row_number() OVER (PARTITION BY racer ORDER BY available_at DESC, race_id, lane, price) AS n FROM entries WHERE available_at <= TIMESTAMP '1998-06-01') SELECT racer, race_id, lane, round(rate, 9) AS rate FROM v WHERE n = 1")
def latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = entries(spark, sf_dir).withColumn("valid_from", F.col("available_at")).withColumn("valid_to", F.lit(None).cast("timestamp")).withColumn("o", F.struct("race_id", "lane", "price"))
    return temporal.latest_version(d, ["racer"], F.lit("1998-06-01").cast("timestamp"), "o").select("racer", "race_id", "lane", r9("rate").alias("rate"))


@R.query(", g AS (SELECT race_id, lane, count(*) AS n, min(odds) AS odds FROM entries WHERE odds < 9 GROUP BY ALL) SELECT e.race_id, e.lane, CASE WHEN n = 1 THEN round(g.odds, 9) END AS odds, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'ambiguous' END AS reason FROM entries e LEFT JOIN g USING (race_id, lane)")
def exactly_one_quote(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = entries(spark, sf_dir)
    one = temporal.exactly_one(e.where("odds < 9"), ["race_id", "lane"], "odds").withColumn("seen", F.lit(True))
    d = e.select("race_id", "lane").join(one, ["race_id", "lane"], "left")
    return d.select("race_id", "lane", r9("odds").alias("odds"), F.when(F.col("seen").isNull(), "missing").otherwise(F.col("reason")).alias("reason"))


@R.query(", f AS (SELECT racer, lane AS base_lane, row_number() OVER (PARTITION BY racer ORDER BY available_at, race_id, lane, price) AS n FROM entries) SELECT racer, base_lane FROM f WHERE n = 1")
def first_per_racer(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = temporal.first_per_key(entries(spark, sf_dir), ["racer"], [F.col(c) for c in ("available_at", "race_id", "lane", "price")])
    return d.select("racer", F.col("lane").alias("base_lane"))


@R.query(", l AS (SELECT race_id, lane, odds, 'live' AS kind FROM entries WHERE race_id % 3 <> 0), a AS (SELECT race_id, lane, odds, 'archive' AS kind FROM entries WHERE race_id % 2 = 0) SELECT kind, count(*) AS n, round(sum(odds), 6) AS total FROM (SELECT * FROM a UNION ALL SELECT * FROM l WHERE race_id NOT IN (SELECT race_id FROM a)) GROUP BY kind")
def archive_over_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archived results replace live ones per whole race."""
    e = entries(spark, sf_dir).select("race_id", "lane", "odds")
    live, archive = e.where("race_id % 3 <> 0").withColumn("kind", F.lit("live")), e.where("race_id % 2 = 0").withColumn("kind", F.lit("archive"))
    return temporal.merge_by_priority(archive, live, ["race_id"]).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("odds"), 6).alias("total"))


@R.query("SELECT race_id, lane, CASE WHEN available_at > deadline THEN 'rate: not available' END AS violation FROM runners WHERE available_at > deadline")
def late_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.availability_violations(runners(spark, sf_dir), "deadline", {"rate": "available_at"}).select("race_id", "lane", "violation")


_FORM = """, s AS (SELECT *, (7 - finish) / 6.0 AS score FROM runners WHERE finished),
f AS (SELECT race_id, lane, racer, rate, count(score) OVER w AS prior_n, avg(score) OVER w AS prior_avg FROM s WINDOW w AS (PARTITION BY racer ORDER BY race_date GROUPS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


@R.query(_FORM + " SELECT race_id, lane, prior_n, round(CASE WHEN prior_n = 0 THEN rate / 10 ELSE (prior_avg * prior_n + rate / 10 * 3) / (prior_n + 3) END, 9) AS form FROM f")
def form_before_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shrunk form over strictly earlier days of the racer."""
    d = runners(spark, sf_dir).where("finished").withColumn("score", pricing.finish_score(F.col("finish"), F.lit(True)))
    d = windows.form_before(d, ["racer"], "race_date", "score")
    return d.select("race_id", "lane", "prior_n", r9(pricing.shrunk_form(F.col("prior_avg"), F.col("prior_n"), F.col("rate"))).alias("form"))


@R.query("SELECT race_id, lane, round(CASE WHEN count(rate) OVER w >= 2 AND stddev_pop(quantity) OVER w > 0 THEN (quantity - avg(quantity) OVER w) / stddev_pop(quantity) OVER w ELSE 0 END, 6) AS rate_z, round(stddev_samp(quantity) OVER w, 6) AS field_sd, count(*) FILTER (rate >= 8) OVER w AS n_top FROM runners WINDOW w AS (PARTITION BY race_id)")
def race_z_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("race_id")
    d = windows.group_z(runners(spark, sf_dir), ["race_id"], "quantity", "z")
    return d.select("race_id", "lane", F.round("z", 6).alias("rate_z"), F.round(F.stddev_samp("quantity").over(w), 6).alias("field_sd"), F.count_if(F.col("rate") >= 8).over(w).alias("n_top"))


_DAYS = """, d AS (SELECT venue, race_date AS day, CASE WHEN count(*) % 7 = 0 THEN NULL ELSE count(*) % 4 + 1 END AS counter, min(race_id) AS old_id FROM races GROUP BY ALL),
g AS (SELECT *, lag(day) OVER (PARTITION BY venue ORDER BY day) AS last FROM d WHERE counter IS NOT NULL),
s AS (SELECT *, sum((counter = 1 OR last IS NULL OR NOT (day - last BETWEEN 1 AND 3))::INT) OVER (PARTITION BY venue ORDER BY day ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM g)"""


def _days(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = races(spark, sf_dir).groupBy("venue", F.col("race_date").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.min("race_id").alias("old_id"))
    return g.select("venue", "day", F.when(F.col("n") % 7 != 0, F.col("n") % 4 + 1).alias("counter"), "old_id")


@R.query(_DAYS + " SELECT venue, day, session FROM s")
def series_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.series_sessions(_days(spark, sf_dir), "venue", "day", "counter").select("venue", "day", "session")


@R.query(_DAYS + " SELECT venue, session, min(day) AS start, max(day) AS \"end\", count(*) AS days, arg_min(old_id, day) AS survivor, count(DISTINCT old_id) AS merged FROM s GROUP BY ALL")
def series_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.series_plan(windows.series_sessions(_days(spark, sf_dir), "venue", "day", "counter"), "venue", "day", "old_id")


@R.query(_DAYS + """, e AS (SELECT venue, session, min(day) - (arg_min(counter, day)::INT - 1) AS est FROM s GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY venue ORDER BY est, session) AS r FROM e)
SELECT venue, session, est AS estimate, (DATE '1970-01-01' + (max(est - DATE '1970-01-01' - r) OVER (PARTITION BY venue ORDER BY r ROWS UNBOUNDED PRECEDING) + r)::INT) AS start_free FROM n""")
def free_series_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimated starts, moved past the starts that their venue has given away."""
    s = windows.series_sessions(_days(spark, sf_dir), "venue", "day", "counter").groupBy("venue", "session").agg(F.min("day").alias("d"), F.min_by("counter", "day").alias("c"))
    e = s.select("venue", "session", keys.series_start(F.col("d"), F.col("c").cast("int")).alias("estimate"))
    return windows.free_starts(e, "venue", "estimate", "session").select("venue", "session", "estimate", "start_free")


@R.query("WITH x AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, value) AS n FROM events) SELECT user_id, round(arg_min(value, (ts, value)), 9) AS first_value, round(arg_max(value, (ts, value)), 9) AS last_value, count(*) AS readings FROM x WHERE n <= 5 GROUP BY user_id", base=False)
def last_five_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = windows.last_readings(table(spark, sf_dir, "events"), ["user_id"], "ts", "value")
    return d.select("user_id", r9("first").alias("first_value"), r9("last").alias("last_value"), F.size("readings").cast("long").alias("readings"))


@R.query(", d AS (SELECT racer, race_date, avg(finish) AS m FROM runners GROUP BY ALL), w AS (SELECT *, avg(m) OVER (PARTITION BY racer ORDER BY race_date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS last5, avg(m) OVER (PARTITION BY racer ORDER BY race_date ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS last10, avg(m) OVER (PARTITION BY racer ORDER BY race_date RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING) AS days30 FROM d) SELECT racer, race_date, round(last5, 9) AS last5, round(last10, 9) AS last10, round(days30, 6) AS days30 FROM w")
def racer_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = features.history(runners(spark, sf_dir), ["racer"], "race_date", "finish")
    return d.select("racer", "race_date", r9("last5").alias("last5"), r9("last10").alias("last10"), F.round("days30", 6).alias("days30"))


@R.query(", d AS (SELECT racer, race_date, avg(finish) AS x FROM runners GROUP BY ALL), l AS (SELECT x, lag(x, 1) OVER w AS x1, lag(x, 2) OVER w AS x2, lag(x, 3) OVER w AS x3 FROM d WINDOW w AS (PARTITION BY racer ORDER BY race_date)) SELECT round(corr(x, x1), 6) AS lag1, round(corr(x, x2), 6) AS lag2, round(corr(x, x3), 6) AS lag3 FROM l")
def day_lag_persistence(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = windows.lag_persistence(runners(spark, sf_dir), ["racer"], "race_date", "finish")
    return d.select(*[F.round(c, 6).alias(c) for c in ("lag1", "lag2", "lag3")])


_EXCLUDED = """, x AS (SELECT *, available_at > deadline AS late, rate > 0.4 AS has FROM runners),
r AS (SELECT race_id, CASE WHEN count(*) <> 6 THEN 'six_lanes' WHEN bool_or(late) THEN 'late_feature' WHEN count(*) FILTER (won) <> 1 THEN 'one_winner' WHEN NOT bool_and(has) THEN 'missing_feature' END AS reason FROM x GROUP BY race_id)"""


def _with_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = runners(spark, sf_dir).withColumn("late", F.col("available_at") > F.col("deadline")).withColumn("rate", F.when(F.col("rate") > 0.4, F.col("rate")))
    return features.exclusion(d, ["rate"], True)


@R.query(_EXCLUDED + " SELECT coalesce(reason, 'kept') AS reason, count(*) AS races FROM r GROUP BY ALL")
def exclusion_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _with_reasons(spark, sf_dir).select("race_id", "reason").distinct()
    return d.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("races"))


_WIDE = ", ".join(f"round(max(quantity) FILTER (lane = {n}), 9) AS lane{n}_quantity, round(max(odds) FILTER (lane = {n}), 9) AS lane{n}_odds" for n in range(1, 7))


@R.query(_EXCLUDED + f" SELECT race_id, {_WIDE}, min(lane) FILTER (won) AS winner FROM runners JOIN r USING (race_id) WHERE reason IS NULL GROUP BY race_id")
def training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One wide row per usable race, and its winner."""
    d = _with_reasons(spark, sf_dir).where("reason IS NULL").withColumn("odds", r9("odds"))
    return features.wide(d, ["quantity", "odds"]).join(d.where("won").select("race_id", F.col("lane").alias("winner")), "race_id")


@R.query(", m AS (SELECT DISTINCT date_trunc('month', race_date)::DATE AS m FROM races), f AS (SELECT row_number() OVER (ORDER BY m) - 12 AS fold, min(m) OVER () AS train_start, m AS test_start, (m + INTERVAL 1 MONTH)::DATE AS test_end FROM m) SELECT fold, test_start, count(*) FILTER (race_date < test_start) AS train, count(*) FILTER (race_date >= test_start) AS test FROM races JOIN f ON race_date >= train_start AND race_date < test_end WHERE fold > 0 GROUP BY ALL")
def walk_forward_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = races(spark, sf_dir)
    m = folds.members(d, "race_date", folds.monthly_folds(d, "race_date", 12))
    return m.groupBy(F.col("fold").cast("long").alias("fold"), "test_start").agg(F.count_if(F.col("part") == "train").alias("train"), F.count_if(F.col("part") == "test").alias("test"))


_FOLDS = ", m AS (SELECT DISTINCT date_trunc('month', race_date)::DATE AS m FROM fields), f AS (SELECT row_number() OVER (ORDER BY m) - 12 AS fold, m AS test_start, (m + INTERVAL 1 MONTH)::DATE AS test_end FROM m), k AS (SELECT * FROM f WHERE fold > 0), x AS (SELECT k.fold, race_date < test_start AS train, fields.* FROM fields JOIN k ON race_date < test_end)"


@R.query(_FOLDS + """, c AS (SELECT fold, lane, count(*) FILTER (won AND train) AS w FROM x GROUP BY ALL), q AS (SELECT fold, lane, (w + 1) / (sum(w) OVER (PARTITION BY fold) + 6) AS prior FROM c),
t AS (SELECT x.fold, -ln(greatest(prior, 1e-12)) AS a, -ln(greatest(p, 1e-12)) AS b FROM x JOIN q ON x.fold = q.fold AND x.lane = q.lane WHERE NOT train AND won)
SELECT fold, count(*) AS races, round(ln(6), 9) AS uniform, round(avg(a), 9) AS lane_prior, round(avg(b), 9) AS model, avg(b) < avg(a) AS won_fold FROM t GROUP BY fold""")
def fold_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uniform, lane prior fitted before each month, and the given probabilities, on the same folds."""
    d = full_fields(spark, sf_dir)
    f = F.broadcast(folds.monthly_folds(d, "race_date", 12).select("fold", "test_start"))  # a row a month
    won = d.where("won").withColumn("month", F.trunc("race_date", "month")).withColumn("lane", F.col("lane").cast("int"))
    wins = won.groupBy("month", "lane").agg(F.count(F.lit(1)).alias("wins"))  # folds add up months; no race is copied
    wins = wins.join(f, F.col("month") < F.col("test_start")).groupBy("fold", "lane").agg(F.sum("wins").alias("wins"))
    prior = metrics.lane_prior_of(wins, ["fold"], 1.0).withColumnRenamed("p", "prior")
    t = won.join(f, F.col("month") == F.col("test_start")).join(F.broadcast(prior), ["fold", "lane"])  # six rows a fold
    loss = lambda c: F.avg(-F.log(F.greatest(F.col(c), F.lit(1e-12))))
    g = t.groupBy(F.col("fold").cast("long").alias("fold")).agg(F.count(F.lit(1)).alias("races"), loss("prior").alias("a"), loss("p").alias("b"))
    return g.select("fold", "races", r9(F.log(F.lit(6.0))).alias("uniform"), r9("a").alias("lane_prior"), r9("b").alias("model"), (F.col("b") < F.col("a")).alias("won_fold"))


@R.query(", l AS (SELECT race_id, race_class, -ln(max(greatest(p, 1e-12)) FILTER (won)) AS ll, sum((p - won::INT) ** 2) AS brier, arg_max(won, (p, -lane)) AS top1 FROM fields GROUP BY ALL) SELECT race_class, count(*) AS n, round(avg(ll), 9) AS log_loss, round(avg(brier), 9) AS brier, round(avg(top1::INT), 9) AS accuracy FROM l GROUP BY race_class")
def losses_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = metrics.summary(metrics.race_losses(full_fields(spark, sf_dir), ["race_id", "race_class"], "p", "won"), ["race_class"])
    return d.withColumns({c: r9(c) for c in ("log_loss", "brier", "accuracy")})


@R.query(", t AS (SELECT race_id, max(p) AS c, arg_max(won, (p, -lane)) AS hit FROM fields GROUP BY race_id), b AS (SELECT least(floor(c * 10), 9) AS bin, count(*) AS n, avg(c) AS m, avg(hit::INT) AS a FROM t GROUP BY ALL) SELECT round(sum(n * abs(m - a)) / sum(n), 9) AS ece, sum(n)::BIGINT AS races FROM b")
def calibration_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = full_fields(spark, sf_dir).groupBy("race_id").agg(F.max("p").alias("c"), F.max_by("won", F.struct("p", -F.col("lane"))).alias("hit"))
    n = t.agg(F.count(F.lit(1)).alias("races"))
    return metrics.expected_calibration_error(t, "c", "hit", 10).crossJoin(F.broadcast(n)).select(r9("ece").alias("ece"), "races")


@R.query(""", t AS (SELECT race_id, max(p) AS c, arg_max(won, (p, -lane)) AS hit, any_value(race_date) AS d FROM fields GROUP BY race_id), b AS (SELECT least(floor(c * 10), 9)::INT AS bin, avg(hit::INT) AS a FROM t WHERE d < DATE '1998-01-01' GROUP BY ALL),
v AS (SELECT range::INT AS bin, coalesce(a, (range + 0.5) / 10) AS value FROM range(10) LEFT JOIN b ON bin = range),
x AS (SELECT race_id, lane, p, row_number() OVER (PARTITION BY race_id ORDER BY p DESC, lane) AS n, max(p) OVER w AS top, count(*) OVER w AS k FROM fields WHERE race_date >= DATE '1998-01-01' WINDOW w AS (PARTITION BY race_id)),
y AS (SELECT *, sum(CASE WHEN n > 1 THEN p ELSE 0 END) OVER (PARTITION BY race_id) AS rest FROM x)
SELECT race_id, lane, round(CASE WHEN n = 1 THEN value WHEN rest > 0 THEN p / rest * (1 - value) ELSE (1 - value) / (k - 1) END, 6) AS p_calibrated FROM y JOIN v ON v.bin = least(floor(top * 10), 9)""")
def recalibrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binned calibrator of the favourites before 1998, applied to the races from then on."""
    d = full_fields(spark, sf_dir)
    old = d.where("race_date < DATE '1998-01-01'").groupBy("race_id").agg(F.max("p").alias("c"), F.max_by("won", F.struct("p", -F.col("lane"))).alias("hit"))
    new = metrics.recalibrate(d.where("race_date >= DATE '1998-01-01'"), ["race_id"], "p", metrics.calibrator(old, "c", "hit", 10), 10)
    return new.select("race_id", "lane", F.round("p_calibrated", 6).alias("p_calibrated"))


@R.query(", s AS (SELECT race_id, min(lane) FILTER (finish = 1) AS a, min(lane) FILTER (finish = 2) AS b FROM fields GROUP BY race_id), n AS (SELECT a, b, count(*) AS n FROM s GROUP BY ALL), e AS (SELECT i.range::INT AS i, j.range::INT AS j, coalesce(n, 0) AS n FROM range(1, 7) i CROSS JOIN range(1, 7) j LEFT JOIN n ON a = i.range AND b = j.range) SELECT i, j, round(CASE WHEN i = j THEN 0 ELSE (n + 1) / (sum(n) OVER (PARTITION BY i) + 5) END, 9) AS p FROM e")
def second_given_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = full_fields(spark, sf_dir).groupBy("race_id").agg(F.min(F.when(F.col("finish") == 1, F.col("lane"))).alias("a"), F.min(F.when(F.col("finish") == 2, F.col("lane"))).alias("b"))
    return metrics.second_given_first(d, [], "a", "b", 1.0).withColumn("p", r9("p"))


@R.query("WITH x AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity, l_discount, l_tax) AS n, first(l_partkey) OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity, l_discount, l_tax) AS f FROM lineitem) SELECT CASE WHEN n = 1 THEN 'kept' WHEN l_partkey = f THEN 'exact' ELSE 'key' END AS duplicate, count(*) AS n FROM x GROUP BY ALL", base=False)
def duplicate_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = ["l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount", "l_tax"]
    d = quality.split_duplicates(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], order, ["l_partkey"])
    return d.groupBy(F.coalesce("duplicate", F.lit("kept")).alias("duplicate")).agg(F.count(F.lit(1)).alias("n"))


@R.query("SELECT code, count(*) AS n FROM (SELECT CASE WHEN l_linenumber IS NULL THEN 'E003' WHEN l_linenumber < 1 OR l_linenumber > 6 THEN 'E005' END AS code FROM lineitem UNION ALL SELECT CASE WHEN l_suppkey IS NULL THEN 'E003' WHEN l_suppkey < 1 THEN 'E006' END FROM lineitem) WHERE code IS NOT NULL GROUP BY code", base=False)
def validation_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").cast("string").alias("lane_number"), F.col("l_suppkey").cast("string").alias("registration_number"))
    return quality.reason_tally(quality.validate(d, quality.LANE_FIELDS))


@R.query("SELECT 'missing' AS side, o_custkey AS key FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)) UNION ALL SELECT 'extra', c_custkey FROM customer WHERE c_acctbal > 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders)", base=False)
def reference_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"))
    b = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("key"))
    return quality.symmetric_difference(a, b, ["key"])


@R.query("SELECT strftime(race_date, '%Y-%m-%d') || '-' || lpad(venue::VARCHAR, 2, '0') || '-' || lpad((race_id % 14)::VARCHAR, 2, '0') AS race_key, coalesce(venue BETWEEN 1 AND 24 AND race_id % 14 BETWEEN 1 AND 12, false) AS valid FROM races")
def race_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("race_id") % 14
    return races(spark, sf_dir).select(keys.race_key(F.col("race_date"), F.col("venue"), n).alias("race_key"), keys.valid_key(F.col("venue"), n).alias("valid"))


@R.query("SELECT o_orderpriority AS label, CASE WHEN o_orderpriority LIKE '1%' THEN 'final' WHEN o_orderpriority LIKE '2%' THEN 'trial' WHEN o_orderpriority LIKE '3%' THEN 'general' WHEN o_orderpriority LIKE '4%' THEN 'semifinal' ELSE 'unknown' END AS phase, count(*) AS n FROM orders GROUP BY ALL", base=False)
def race_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("o_orderpriority")
    title = F.when(p.startswith("1"), "優　勝戦").when(p.startswith("2"), "予 選").when(p.startswith("3"), "一般 進入固定").when(p.startswith("4"), "準優勝戦").otherwise("特別")
    return table(spark, sf_dir, "orders").groupBy(p.alias("label"), text.race_phase(title).alias("phase")).agg(F.count(F.lit(1)).alias("n"))


@R.query("WITH w AS (SELECT user_id, min(ts) AS t0 FROM events WHERE event_type = (SELECT min(event_type) FROM events) GROUP BY user_id), x AS (SELECT user_id, avg(value) FILTER (ts < t0) AS b, avg(value) FILTER (ts >= t0) AS a FROM events JOIN w USING (user_id) GROUP BY user_id) SELECT count(*) AS subjects, round(avg(a - b), 9) AS effect, round(stddev_samp(a - b) / sqrt(count(*)), 9) AS se FROM x WHERE a IS NOT NULL AND b IS NOT NULL", base=False)
def own_event_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Before and after each subject's own first event of a kind."""
    e = table(spark, sf_dir, "events")
    kind = e.agg(F.min("event_type").alias("kind"))
    first = e.join(F.broadcast(kind), F.col("event_type") == F.col("kind")).groupBy("user_id").agg(F.min("ts").alias("t0"))
    x = e.join(first, "user_id").groupBy("user_id").agg(F.avg(F.when(F.col("ts") < F.col("t0"), F.col("value"))).alias("b"), F.avg(F.when(F.col("ts") >= F.col("t0"), F.col("value"))).alias("a"))
    return x.where("a IS NOT NULL AND b IS NOT NULL").withColumn("d", F.col("a") - F.col("b")).agg(F.count(F.lit(1)).alias("subjects"), r9(F.avg("d")).alias("effect"), r9(F.stddev_samp("d") / F.sqrt(F.count(F.lit(1)))).alias("se"))


@R.query(", h AS (SELECT racer, avg(finish) FILTER (race_date < DATE '1998-01-01') AS a, avg(finish) FILTER (race_date >= DATE '1998-01-01') AS b FROM runners GROUP BY racer) SELECT count(*) AS racers, round(corr(a, b), 6) AS persistence FROM h WHERE a IS NOT NULL AND b IS NOT NULL")
def split_half_persistence(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = F.col("race_date") < F.lit("1998-01-01").cast("date")
    h = runners(spark, sf_dir).groupBy("racer").agg(F.avg(F.when(cut, F.col("finish"))).alias("a"), F.avg(F.when(~cut, F.col("finish"))).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    return h.agg(F.count(F.lit(1)).alias("racers"), F.round(F.corr("a", "b"), 6).alias("persistence"))


@R.query(", t AS (SELECT lane, won, ntile(3) OVER (PARTITION BY lane ORDER BY quantity, race_id) AS third FROM fields) SELECT lane, third::BIGINT AS third, count(*) AS n, round(avg(won::INT), 9) AS win_rate FROM t GROUP BY ALL")
def factor_thirds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Win rate by third of the rate within each lane; equal rates are told apart by their race, so that thirds are of equal size."""
    f = ledgers.stored(full_fields(spark, sf_dir).select("lane", "quantity", "race_id", "won"), "factor")
    d = ranks.in_thirds(f, ["lane"], "quantity", "race_id")
    return d.groupBy("lane", "third").agg(F.count(F.lit(1)).alias("n"), r9(F.avg(F.col("won").cast("int"))).alias("win_rate"))


@R.query("SELECT venue, race_date, count(*) AS races, count(*) FILTER (finished) AS decided, round(count(*) FILTER (finished) / count(*), 4) AS rate FROM races GROUP BY GROUPING SETS ((venue, race_date), ())")
def daily_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    races(spark, sf_dir).createOrReplaceTempView("lanecast_races")
    return spark.sql("SELECT venue, race_date, count(*) AS races, count_if(finished) AS decided, round(count_if(finished) / count(*), 4) AS rate FROM lanecast_races GROUP BY GROUPING SETS ((venue, race_date), ())")
