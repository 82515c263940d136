"""Loads, quarantine, activation and streams of observations over the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanecast.functions import pricing
from lanecast.operators import folds, quality
from lanecast.plans.betting import ROUND_SQL
from lanecast.plans.contest import table
from lanecast.plans.registry import Registry
from lanecast.plans.timeline import _DAYS, _days
from lanecast.sources import ledgers
from lanecast.streaming import streams

R = Registry()
QUERIES, SQL = R.QUERIES, R.SQL


def streamed(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A supplied table as a file stream."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


@R.query("""WITH t AS (SELECT c_custkey AS id, CASE WHEN c_nationkey % 5 <> 0 THEN c_acctbal END AS balance FROM customer),
v AS (SELECT s_suppkey * 2 AS id, CASE WHEN s_nationkey % 3 <> 0 THEN s_acctbal END AS balance FROM supplier)
SELECT CASE WHEN t.id IS NULL THEN 'not_found' WHEN v.balance IS NULL THEN 'no_value' WHEN t.balance IS NOT NULL THEN 'already_set' ELSE 'matched' END AS outcome, count(*) AS n
FROM v LEFT JOIN t USING (id) GROUP BY outcome""", base=False)
def back_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What happens to each value that is filled in afterwards."""
    t = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_nationkey") % 5 != 0, F.col("c_acctbal")).alias("balance"))
    v = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 2).alias("id"), F.when(F.col("s_nationkey") % 3 != 0, F.col("s_acctbal")).alias("balance"))
    return ledgers.back_fill(t, v, ["id"], "balance")[1]


@R.query("""SELECT n_nationkey AS code, n_name AS name FROM nation WHERE n_regionkey < 3 UNION ALL
SELECT c_nationkey, min(c_name) FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3) GROUP BY c_nationkey""", base=False)
def dimension_completed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dimension with the keys that incoming rows need and it lacked, under the first name."""
    known = table(spark, sf_dir, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("code"), F.col("n_name").alias("name"))
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("code"), F.col("c_name").alias("name"))
    return ledgers.get_or_create(known, rows, "code", "name")


@R.query("""WITH o AS (SELECT CAST(o_orderdate AS DATE) AS day, CASE WHEN o_custkey % 2 = 0 THEN 'K' ELSE 'B' END AS kind, o_orderkey AS id FROM orders),
f AS (SELECT day, kind, min(id) AS id, min(id) % 5 > 0 AS ok FROM o GROUP BY ALL),
p AS (SELECT * FROM (SELECT DISTINCT day FROM o), (VALUES ('K'), ('B')) k(kind))
SELECT kind, CASE WHEN id IS NULL THEN 'missing' WHEN id % 3 = 0 THEN 'skipped' WHEN ok THEN 'loaded' ELSE 'failed' END AS outcome, count(*) AS n FROM p LEFT JOIN f USING (day, kind) GROUP BY ALL""", base=False)
def load_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two kinds of file a day against what is there and what the ledger has."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("day"), F.when(F.col("o_custkey") % 2 == 0, "K").otherwise("B").alias("kind"), F.col("o_orderkey").alias("id"))
    f = o.groupBy("day", "kind").agg(F.min("id").alias("id")).withColumn("ok", F.col("id") % 5 > 0).withColumn("sha256", F.sha2(F.col("id").cast("string"), 256))
    plan = ledgers.load_plan(o.select("day").distinct(), f.drop("id"), f.where("id % 3 = 0").select("kind", "sha256"))
    return plan.groupBy("kind", "outcome").agg(F.count(F.lit(1)).alias("n"))


@R.query("""WITH r AS (SELECT DISTINCT l_linenumber + 2 AS lane, l_suppkey AS racer FROM lineitem),
bad AS (SELECT CASE WHEN lane NOT BETWEEN 1 AND 6 THEN 'E005' ELSE 'E006' END AS code, racer FROM r WHERE lane NOT BETWEEN 1 AND 6 OR racer < 1)
SELECT code, CASE WHEN racer % 2 = 0 AND racer >= 1 THEN 'replayed' ELSE 'pending' END AS state, count(*) AS n FROM bad GROUP BY ALL""", base=False)
def quarantine_replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records out of range are kept once each; corrections that are valid replay them."""
    d = table(spark, sf_dir, "lineitem").select((F.col("l_linenumber") + 2).cast("string").alias("lane_number"), F.col("l_suppkey").cast("string").alias("registration_number"))
    bad = quality.validate(d, quality.LANE_FIELDS).where("NOT valid").withColumn("code", F.col("failures")[0]["code"])
    store = quality.quarantine(None, bad, ["lane_number", "registration_number"])
    even = F.col("registration_number").cast("long") % 2 == 0
    fix = store.select("quarantine_id", F.when(even, "6").otherwise("9").alias("lane_number"), "registration_number")
    return quality.replay(store, fix, quality.LANE_FIELDS).groupBy("code", "state").agg(F.count(F.lit(1)).alias("n"))


@R.query("""WITH l AS (SELECT o_orderpriority AS role, o_orderkey AS version, o_orderdate AS since, lag(o_orderkey) OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) AS previous FROM orders)
SELECT role, version AS active, previous AS rollback_to FROM l QUALIFY row_number() OVER (PARTITION BY role ORDER BY since DESC, version DESC) = 1""", base=False)
def active_by_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last activation of each role and the version before it."""
    log = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("role"), F.struct(F.col("o_orderdate").alias("activated_at"), F.col("o_orderkey").alias("entry_id")).alias("entry"))
    last = log.groupBy("role").agg(F.max("entry").alias("last"))
    before = log.join(F.broadcast(last), "role").where("entry < last").groupBy("role").agg(F.max("entry").alias("before"))  # five roles
    log = last.join(before, "role", "left").select("role", "last.activated_at", "last.entry_id", F.col("last.entry_id").alias("version"), F.col("before.entry_id").alias("previous"))
    return folds.active_versions(log)


@R.query(_DAYS + " SELECT venue, day, session FROM s")
def streamed_series_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The racing days as a stream of files, split into series with a row of state a venue."""
    days, out = ledgers.shared_folder(spark, "days"), ledgers.shared_folder(spark, "sessions")
    _days(spark, sf_dir).select("venue", "day", "counter").write.parquet(days)
    stream = spark.readStream.schema("venue long, day date, counter long").parquet(days)
    streams.drained(streams.series_sessions(stream), streams.append_batches(out))
    return spark.read.parquet(out).select("venue", "day", "session")


@R.query("SELECT l_orderkey AS race_id, 'v1' AS model_version FROM lineitem WHERE l_linenumber <= 6 GROUP BY l_orderkey HAVING count(DISTINCT l_linenumber) = 6", base=False)
def emitted_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of lanes: races whose six lanes are there are emitted, once a version."""
    path = ledgers.shared_folder(spark, "emitted")
    s = streamed(spark, sf_dir, "lineitem").where("l_linenumber <= 6").select(F.col("l_orderkey").alias("race_id"), F.col("l_linenumber").cast("string").alias("combination"))
    streams.drained(s, streams.emit_once(path, "v1"))
    return streams.predicted(spark, path)


@R.query("SELECT l_returnflag AS state, count(*) AS n, count(DISTINCT l_orderkey) AS races FROM lineitem ANTI JOIN (SELECT * FROM orders WHERE o_orderstatus = 'F') ON l_orderkey = o_orderkey GROUP BY l_returnflag", base=False)
def reconciled_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of live results, kept for the races that the archive hasn't."""
    archive, out = ledgers.shared_folder(spark, "archive"), ledgers.shared_folder(spark, "live")
    streams.archive(table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("race_id")), archive)
    live = streamed(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("race_id"), F.col("l_returnflag").alias("state"))
    streams.drained(live, streams.reconcile(archive, out))
    return spark.read.parquet(out).groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("race_id").alias("races"))


@R.query(f"""WITH q AS (SELECT user_id, event_type, ts, value + 1 AS odds, date_trunc('day', ts) + INTERVAL 1 DAY AS deadline FROM events),
l AS (SELECT *, epoch(deadline - ts) / 60.0 AS lead FROM q)
SELECT user_id, CAST(deadline AS DATE) AS day, event_type, round, round(arg_max(odds, (ts, -odds)), 9) AS odds FROM l JOIN {ROUND_SQL} ON lead BETWEEN lo AND hi GROUP BY ALL""", base=False)
def streamed_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of quotes joined with the day's schedule: the latest of each candidate and round, in update mode."""
    path, day = ledgers.shared_folder(spark, "rounds"), F.date_add(F.col("ts").cast("date"), 1)
    race = F.col("user_id") * 1_000_000 + F.unix_date(day)
    schedule = table(spark, sf_dir, "events").select(race.alias("race_id"), day.cast("timestamp").alias("deadline")).distinct()
    s = streamed(spark, sf_dir, "events").select(race.alias("race_id"), F.col("event_type").alias("bet_type"), F.lit("1").alias("combination"), (F.col("value") + 1).alias("odds"), F.col("ts").cast("timestamp").alias("observed_at"))
    s = streams.latest(streams.in_rounds(s.withWatermark("observed_at", "1 day"), schedule, pricing.rounds(spark)))
    streams.drained(s, streams.append_batches(path), "update")
    d = streams.latest_of(spark.read.parquet(path), ["race_id", "bet_type", "combination", "round"])
    return d.select(F.floor(F.col("race_id") / 1_000_000).alias("user_id"), F.date_from_unix_date((F.col("race_id") % 1_000_000).cast("int")).alias("day"), F.col("bet_type").alias("event_type"), "round", F.round("odds", 9).alias("odds"))
