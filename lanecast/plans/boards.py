"""Scheduling, predictions beside results, coverage and stakes over the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanecast.functions import keys, pricing
from lanecast.operators import boards, metrics, rules
from lanecast.plans.contest import candidates, entries, full_fields, races, runners, table
from lanecast.plans.registry import Registry

R = Registry()
QUERIES, SQL = R.QUERIES, R.SQL
r9 = lambda c: F.round(c, 9)
NOW = "1998-05-31 23:45:00"


def now(text: str = NOW):
    return F.lit(text).cast("timestamp_ntz")


@R.query(f"SELECT race_id, venue FROM races WHERE race_id % 5 <> 0 AND race_id % 2 = 0 AND epoch(deadline - TIMESTAMP '{NOW}') / 60 BETWEEN 5 AND 30")
def due_for_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = races(spark, sf_dir).withColumn("cancelled", F.col("race_id") % 5 == 0)
    return boards.due_for_preview(r, r.where("race_id % 2 = 1"), now()).select("race_id", "venue")


@R.query(f"SELECT race_id, venue FROM races WHERE deadline + INTERVAL 8 MINUTE <= TIMESTAMP '{NOW}' AND race_id NOT IN (SELECT race_id FROM entries WHERE odds < 9)")
def due_for_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boards.due_for_result(races(spark, sf_dir), entries(spark, sf_dir).where("odds < 9"), now()).select("race_id", "venue")


@R.query(f"SELECT CASE WHEN deadline <= TIMESTAMP '{NOW}' THEN 'past' WHEN deadline > TIMESTAMP '{NOW}' + INTERVAL 30 DAY THEN 'early' WHEN race_id % 3 = 0 THEN 'already' ELSE 'ready' END AS outcome, count(*) AS n FROM races GROUP BY ALL")
def predictable_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = races(spark, sf_dir)
    d = boards.predictable(r, r.where("race_id % 3 = 0"), now(), 30 * 24 * 60)
    return d.groupBy(F.coalesce("skip", F.lit("ready")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


_TWO = """WITH k AS (SELECT DISTINCT user_id, event_type FROM events), a AS (SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS p FROM events WHERE event_id % 3 = 0 GROUP BY ALL), b AS (SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS p FROM events WHERE event_id % 3 = 1 GROUP BY ALL)"""


@R.query(_TWO + " SELECT user_id, event_type, round(a.p, 9) AS p_card, round(b.p, 9) AS p_preview FROM k LEFT JOIN a USING (user_id, event_type) LEFT JOIN b USING (user_id, event_type)", base=False)
def predictions_side_by_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each candidate's last prediction of two versions."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", F.col("value").alias("p"), F.col("ts").alias("predicted_at"), "event_id", F.element_at(F.array(F.lit("card"), F.lit("preview"), F.lit("other")), (F.col("event_id") % 3 + 1).cast("int")).alias("version"))
    key = ["user_id", "event_type"]
    sides = {v: boards.latest_prediction(e, key, v, "event_id") for v in ("card", "preview")}
    return boards.side_by_side(e.select(*key).distinct(), sides, key).select(*key, r9("p_card").alias("p_card"), r9("p_preview").alias("p_preview"))


_RESULTS = """, b AS (SELECT race_id, any_value(race_date) AS race_date, CASE WHEN any_value(race_id % 19 = 0) THEN 'cancelled' WHEN NOT any_value(finished) THEN CASE WHEN any_value(deadline) <= TIMESTAMP '1998-05-31 23:45:00' THEN 'pending' ELSE 'upcoming' END ELSE 'finished' END AS state,
  arg_max(lane, (p, -lane)) AS card, arg_max(lane, (p * odds, -lane)) AS preview, min(lane) FILTER (won) AS winner FROM fields GROUP BY race_id)"""


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = full_fields(spark, sf_dir).groupBy("race_id", "race_date", "finished", "deadline").agg(F.max_by("lane", F.struct("p", -F.col("lane"))).alias("card"), F.max_by("lane", F.struct(F.col("p") * F.col("odds"), -F.col("lane"))).alias("preview"), F.min(F.when(F.col("won"), F.col("lane"))).alias("winner"))
    return g.withColumn("state", pricing.race_state(F.col("race_id") % 19 == 0, F.col("finished"), F.col("winner").isNotNull(), F.col("deadline") <= now()))


@R.query(_RESULTS + " SELECT race_id, race_date, state, card, preview, CASE WHEN state = 'finished' THEN winner END AS winner, CASE WHEN state = 'finished' THEN card = winner END AS card_hit, CASE WHEN state = 'finished' THEN preview = winner END AS preview_hit FROM b")
def results_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two models' picks beside what happened."""
    done = F.col("state") == "finished"
    hit = lambda c: F.when(done, F.col(c) == F.col("winner")).alias(f"{c}_hit")
    return _results(spark, sf_dir).select("race_id", "race_date", "state", "card", "preview", F.when(done, F.col("winner")).alias("winner"), hit("card"), hit("preview"))


@R.query(_RESULTS + """ SELECT race_date, count(*) AS races, count(*) FILTER (state = 'finished') AS decided, count(*) FILTER (state = 'pending') AS pending, count(*) FILTER (state = 'upcoming') AS upcoming, count(*) FILTER (state = 'cancelled') AS cancelled,
count(*) FILTER (state = 'finished' AND card = winner) AS hits, round(count(*) FILTER (state = 'finished' AND card = winner) / nullif(count(*) FILTER (state = 'finished'), 0), 4) AS rate FROM b GROUP BY GROUPING SETS ((race_date), ())""")
def results_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _results(spark, sf_dir)
    state = lambda s: F.count_if(F.col("state") == s).alias(s)
    decided, hits = F.count_if(F.col("state") == "finished"), F.count_if((F.col("state") == "finished") & (F.col("card") == F.col("winner")))
    return d.groupingSets([["race_date"], []], "race_date").agg(F.count(F.lit(1)).alias("races"), decided.alias("decided"), state("pending"), state("upcoming"), state("cancelled"), hits.alias("hits"), F.round(hits / F.nullif(decided, F.lit(0)), 4).alias("rate"))


@R.query("WITH p AS (SELECT event_type AS source, event_id % 2 AS feed, count(*) AS n, count(DISTINCT user_id) AS races, min(ts) AS since, max(ts) AS through FROM events GROUP BY ALL) SELECT source, sum(n)::BIGINT AS n, max(races) AS races, min(since) AS since, max(through) AS through FROM p GROUP BY source", base=False)
def merged_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("source"), (F.col("event_id") % 2).alias("feed"))
    return boards.merged_counts(e.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("races"), F.min("ts").alias("since"), F.max("ts").alias("through")), "source")


_JOBS = "(VALUES ('click', 'clicks', 5), ('view', 'views', 1), ('purchase', 'purchases', 10), ('result', 'results', 30))"


@R.query(f"SELECT j.job, j.title, j.every, coalesce(count(event_id), 0) AS n, max(ts) AS last FROM {_JOBS} j(job, title, every) LEFT JOIN events ON event_type = job GROUP BY ALL", base=False)
def collector_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every job of a static table with what it has collected, those without anything too."""
    jobs = spark.createDataFrame([("click", "clicks", 5), ("view", "views", 1), ("purchase", "purchases", 10), ("result", "results", 30)], "job string, title string, every int")
    n = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("job")).agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last"))
    return jobs.join(n, "job", "left").select("job", "title", "every", F.coalesce("n", F.lit(0)).alias("n"), "last")


@R.query(", o AS (SELECT *, CASE WHEN quantity > 2 THEN 6.5 + disc END AS t, CASE WHEN quantity > 5 THEN price END AS st, (lane + quantity::BIGINT % 4) % 6 + 1 AS course FROM runners) SELECT race_id, count(t) AS times, count(st) AS starts, coalesce(string_agg(lane::VARCHAR, ',' ORDER BY lane) FILTER (course <> lane), '') AS changed, bool_or(disc > 0.05) AS parts_seen FROM o GROUP BY race_id")
def pre_race_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("quantity")
    course = (F.col("lane") + q.cast("long") % 4) % 6 + 1
    changed = F.array_sort(F.collect_list(F.when(course != F.col("lane"), F.col("lane"))))  # six at most
    return runners(spark, sf_dir).groupBy("race_id").agg(F.count_if(q > 2).alias("times"), F.count_if(q > 5).alias("starts"), F.array_join(changed.cast("array<string>"), ",").alias("changed"), F.bool_or(F.col("disc") > 0.05).alias("parts_seen"))


@R.query(", c AS (SELECT venue, race_date, count(CASE WHEN rate > 6 THEN 1 END) AS a, count(CASE WHEN odds < 6 THEN 1 END) AS b, count(CASE WHEN disc > 0.02 THEN 1 END) AS d FROM runners GROUP BY ALL) SELECT venue, race_date, (a > 0)::BIGINT + (b > 0)::BIGINT + (d > 0)::BIGINT AS obtained, 3::BIGINT AS total, concat_ws(',', CASE WHEN a = 0 THEN 'rate' END, CASE WHEN b = 0 THEN 'odds' END, CASE WHEN d = 0 THEN 'motor' END) AS missing, a = 0 OR b = 0 AS critical_missing FROM c")
def data_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = runners(spark, sf_dir).select("venue", "race_date", F.when(F.col("rate") > 6, F.col("rate")).alias("rate"), F.when(F.col("odds") < 6, F.col("odds")).alias("odds"), F.when(F.col("disc") > 0.02, F.col("disc")).alias("motor"))
    return boards.coverage(d, {"rate": True, "odds": True, "motor": False}, ["venue", "race_date"])


@R.query(f", f AS (SELECT venue, race_id, any_value(deadline) AS deadline, bool_or(disc > 0.09) AS critical, max(round(p * odds * 100, 6)) AS best FROM fields GROUP BY ALL), d AS (SELECT *, CASE WHEN critical THEN 'waiting' WHEN best >= 100 THEN 'candidate' ELSE 'skip' END AS decision FROM f WHERE deadline > TIMESTAMP '{NOW}') SELECT venue, count(*) AS remaining, count(*) FILTER (decision = 'candidate') AS candidates, count(*) FILTER (decision = 'waiting') AS waiting, arg_min(race_id, (deadline, race_id)) AS next_race, min(deadline) AS next_deadline FROM d GROUP BY venue")
def venue_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per venue of the races still to come: how many, candidates, those that wait for critical data, and the next one."""
    f = full_fields(spark, sf_dir).where(F.col("deadline") > now()).groupBy("venue", "race_id", "deadline").agg(F.bool_or(F.col("disc") > 0.09).alias("critical"), F.max(F.round(F.col("p") * F.col("odds") * 100, 6)).alias("best"))
    f = f.withColumn("decision", pricing.decision(F.col("critical"), F.col("best")))
    return f.groupBy("venue").agg(F.count(F.lit(1)).alias("remaining"), F.count_if(F.col("decision") == "candidate").alias("candidates"), F.count_if(F.col("decision") == "waiting").alias("waiting"), F.min_by("race_id", F.struct("deadline", "race_id")).alias("next_race"), F.min("deadline").alias("next_deadline"))


@R.query("SELECT race_id, lane, 'share_v1' AS version, deadline - INTERVAL 1 HOUR AS predicted_at, max(available_at) OVER (PARTITION BY race_id) AS features_available_at, round(rate / sum(rate) OVER (PARTITION BY race_id), 9) AS p FROM fields")
def prediction_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as they are written: normalised to 1 in the race, with version, time and the latest time of any feature."""
    from pyspark.sql import Window

    w = Window.partitionBy("race_id")
    p = F.col("rate") / F.sum("rate").over(w)
    return full_fields(spark, sf_dir).select("race_id", "lane", F.lit("share_v1").alias("version"), F.expr("deadline - INTERVAL 1 HOUR").alias("predicted_at"), F.max("available_at").over(w).alias("features_available_at"), r9(p).alias("p"))


@R.query("SELECT strftime(race_date, '%Y-%m-%d') || '-' || lpad(venue::VARCHAR, 2, '0') || '-' || lpad((race_id % 12 + 1)::VARCHAR, 2, '0') AS race_key, count(*) AS n, min(race_id) AS kept FROM races WHERE venue BETWEEN 1 AND 24 GROUP BY 1 HAVING count(*) > 1")
def race_key_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Race keys that more than one race claims, and the race that keeps it."""
    n = F.col("race_id") % 12 + 1
    d = races(spark, sf_dir).where(keys.valid_key(F.col("venue"), n)).groupBy(keys.race_key(F.col("race_date"), F.col("venue"), n).alias("race_key"))
    return d.agg(F.count(F.lit(1)).alias("n"), F.min("race_id").alias("kept")).where("n > 1")


@R.query(", s AS (SELECT race_id, race_date, lane, CASE WHEN lane % 4 = 0 THEN 150 ELSE lane * 100 END AS stake, odds IS NOT NULL AS offered FROM candidates WHERE p * odds > 1.2), t AS (SELECT *, sum(stake) OVER (PARTITION BY race_id) AS r, sum(stake) OVER (PARTITION BY race_date ORDER BY race_id, lane ROWS UNBOUNDED PRECEDING) AS d FROM s) SELECT race_id, lane, stake::BIGINT AS stake, CASE WHEN stake <= 0 OR stake % 100 <> 0 THEN 'unit' WHEN r > 700 THEN 'race_limit' WHEN d > 2000 THEN 'day_limit' WHEN NOT offered THEN 'not_offered' END AS violation FROM t")
def stake_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = candidates(spark, sf_dir).where(F.col("p") * F.col("odds") > 1.2)
    s = c.select("race_id", "race_date", "lane", F.when(F.col("lane") % 4 == 0, 150).otherwise(F.col("lane") * 100).cast("long").alias("stake"), F.col("odds").isNotNull().alias("offered"))
    return boards.stake_violations(s, 100, 700, 2000).select("race_id", "lane", "stake", "violation")


@R.query(""", x AS (SELECT race_id, venue, race_date, finished, min(lane) FILTER (finish = 1) AS i, min(lane) FILTER (finish = 2) AS j FROM fields GROUP BY ALL),
c AS (SELECT a.race_id, a.lane AS i, b.lane AS j, a.p * b.p / nullif(sum(b.p) OVER (PARTITION BY a.race_id, a.lane), 0) AS p, a.odds * b.odds AS odds, a.rate * 10 AS q FROM fields a JOIN fields b ON a.race_id = b.race_id AND a.lane <> b.lane),
e AS (SELECT *, greatest(0, p - (0.001 + 0.01 / sqrt(36))) * odds AS ev FROM c), h AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY race_id ORDER BY round(ev, 9) DESC, i, j) = 1),
r AS (SELECT h.*, x.venue, x.finished, x.i AS wi, x.j AS wj, abs(p - 1 / odds) AS dis, nullif(concat_ws(',', CASE WHEN q < 50 THEN 'DQ_LOW_DATA_QUALITY' END, CASE WHEN abs(p - 1 / odds) > 0.3 THEN 'MD_MODEL_DISAGREEMENT' END, CASE WHEN ev < 0.5 THEN 'EV_CONSERVATIVE_BELOW_THRESHOLD' END), '') AS reason FROM h JOIN x USING (race_id))
SELECT race_id, venue, (i * 10 + j)::BIGINT AS combination, round(ev, 9) AS ev, reason, CASE WHEN reason IS NOT NULL THEN 'skipped' WHEN NOT finished THEN 'void' WHEN i = wi AND j = wj THEN 'win' ELSE 'loss' END AS result, CASE WHEN reason IS NULL AND finished AND i = wi AND j = wj THEN round(odds * 100, 6) ELSE 0 END AS payout FROM r""")
def exacta_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per race the pair of greatest conservative value, abstained from or bet at 100, settled on the first two."""
    return _decisions(spark, sf_dir).select("race_id", "venue", "combination", "ev", "reason", "result", "payout")


def _decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = full_fields(spark, sf_dir)
    field = d.groupBy("race_id", "venue", "finished").agg(F.collect_list(F.struct("lane", "p", "odds", "rate", "finish")).alias("f"))  # six
    of = lambda n: F.array_min(F.transform(F.filter("f", lambda s: s["finish"] == n), lambda s: s["lane"]))
    c = field.select("race_id", "venue", "finished", of(1).alias("wi"), of(2).alias("wj"), F.explode("f").alias("a"), "f").select("*", F.explode("f").alias("b")).where("a.lane <> b.lane")
    others = F.aggregate(F.filter("f", lambda s: s["lane"] != F.col("a.lane")), F.lit(0.0), lambda x, s: x + s["p"])
    c = c.withColumn("p", F.col("a.p") * F.col("b.p") / F.nullif(others, F.lit(0.0))).withColumn("odds", F.col("a.odds") * F.col("b.odds"))
    c = c.withColumn("ev", pricing.conservative_value(F.col("p"), pricing.margin(F.lit(0.001), F.lit(36), F.lit(0.0), 0.01, 0.0), F.col("odds")))
    pick = F.struct(r9("ev"), -F.col("a.lane"), -F.col("b.lane"))
    best = c.groupBy("race_id", "venue", "finished", "wi", "wj").agg(F.max_by(F.struct("p", "odds", "ev", F.col("a.rate").alias("rate"), F.col("a.lane").alias("i"), F.col("b.lane").alias("j")), pick).alias("x")).select("*", "x.*")
    reason = rules.skip_reason(rules.abstention(F.col("rate") * 10, F.col("odds"), F.abs(F.col("p") - pricing.implied(F.col("odds"))), F.col("ev"), 50, 0.3, 0.5))
    best = best.withColumn("reason", reason).withColumn("ev", r9("ev")).withColumn("combination", keys.code(F.col("i"), F.col("j")))
    result = F.when(F.col("reason").isNotNull(), "skipped").when(~F.col("finished"), "void").when((F.col("i") == F.col("wi")) & (F.col("j") == F.col("wj")), "win").otherwise("loss")
    return best.withColumn("result", result).withColumn("payout", F.when(F.col("result") == "win", F.round(F.col("odds") * 100, 6)).otherwise(0.0))


@R.query("WITH d AS (" + SQL["exacta_decisions"] + """), g AS (SELECT venue, count(*) FILTER (result <> 'skipped') AS bets, count(*) FILTER (result = 'skipped') AS skipped, count(*) FILTER (result = 'void') AS void, 100 * count(*) FILTER (result IN ('win', 'loss')) AS stake, sum(payout) AS payout FROM d GROUP BY venue)
SELECT venue, bets, skipped, void, stake, round(payout, 4) AS payout, round(payout - stake, 4) AS net FROM g""", base=False)
def exacta_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per venue: bets, skipped, void, stake, payout, net; a void bet's stake comes back."""
    n = lambda *s: F.count_if(F.col("result").isin(*s))
    g = _decisions(spark, sf_dir).groupBy("venue").agg(n("win", "loss", "void").alias("bets"), n("skipped").alias("skipped"), n("void").alias("void"), (100 * n("win", "loss")).alias("stake"), F.sum("payout").alias("paid"))
    return g.select("venue", "bets", "skipped", "void", "stake", F.round("paid", 4).alias("payout"), F.round(F.col("paid") - F.col("stake"), 4).alias("net"))


@R.query("WITH d AS (" + SQL["exacta_decisions"] + """), x AS (SELECT venue, payout - CASE WHEN result = 'void' THEN 0 ELSE 100 END AS r FROM d WHERE result <> 'skipped')
SELECT venue, count(*) AS n, round(avg(r), 4) AS mean, round(count(*) / sum(count(*)) OVER (), 9) AS share, count(*) / sum(count(*)) OVER () > 0.5 AS concentrated FROM x GROUP BY venue""", base=False)
def exacta_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Net per placed bet by venue, and whether one of them concentrates the bets."""
    d = _decisions(spark, sf_dir).where("result <> 'skipped'").withColumn("net", F.col("payout") - F.when(F.col("result") == "void", 0.0).otherwise(100.0))
    return metrics.stability(d, "venue", "net").select("venue", "n", F.round("mean", 4).alias("mean"), r9("share").alias("share"), "concentrated")
