"""Sources, boards and streams over the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lanecast.functions import pricing
from lanecast.operators import metrics, windows
from lanecast.plans.contest import full_fields, races, runners, table
from lanecast.plans.registry import Registry
from lanecast.sources import ledgers, lines, pages
from lanecast.streaming import streams

R = Registry()
QUERIES, SQL = R.QUERIES, R.SQL


@R.query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM documents),
f AS (SELECT doc_id, line_no, last_value(nullif(regexp_extract(line, '^([A-Z][a-z]+) ', 1), '') IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS label FROM l)
SELECT label, count(*) AS n FROM f GROUP BY label""", base=False)
def filled_line_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all texts with the last heading word at or above them."""
    d = lines.numbered_lines(table(spark, sf_dir, "documents"), "text", "doc_id")
    d = lines.fill_down(d, "doc_id", {"label": lines.matched(F.col("line"), "^([A-Z][a-z]+) ")})
    return d.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@R.query("WITH e AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<p\\b[^>]*>(.*?)</p>', 1)) AS body FROM pages) SELECT page_id, count(*) AS n, sum(length(trim(regexp_replace(body, '(?s)<[^>]*>', '', 'g'))))::BIGINT AS chars FROM e GROUP BY page_id", base=False)
def page_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = pages.elements(table(spark, sf_dir, "pages"), "page_id", "html", "p")
    return d.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("body")).alias("chars"))


@R.query("SELECT event_type, CAST(props->>'$.k' AS BIGINT) % 5 AS k, count(*) AS n FROM events GROUP BY ALL", base=False)
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.from_json("props", "k bigint")["k"]
    return table(spark, sf_dir, "events").groupBy("event_type", (k % 5).alias("k")).agg(F.count(F.lit(1)).alias("n"))


@R.query("WITH n AS (SELECT user_id, event_type, ts FROM events), e AS (SELECT * FROM events WHERE event_id % 2 = 0) SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN n.value < 1 THEN 'empty' WHEN EXISTS (SELECT 1 FROM e WHERE e.user_id = n.user_id AND e.event_type = n.event_type AND e.ts = n.ts) THEN 'existing' ELSE 'added' END AS outcome FROM events n) GROUP BY outcome", base=False)
def append_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("value", F.when(F.col("value") >= 1, F.col("value")))
    return ledgers.append_absent(e.where("event_id % 2 = 0"), e, ["user_id", "event_type", "ts"], "value")[1]


@R.query("SELECT count(*) AS n, round(sum(value), 4) AS total FROM (SELECT user_id, value FROM events WHERE event_type <> 'click' OR user_id % 2 = 0 UNION ALL SELECT user_id, value * 2 FROM events WHERE event_type = 'click' AND user_id % 2 = 1) ", base=False)
def replaced_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "value")
    new = e.where("event_type = 'click' AND user_id % 2 = 1").withColumn("value", F.col("value") * 2)
    return ledgers.replace_scope(e, new, ["user_id", "event_type"]).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@R.query("SELECT venue, race_date AS day, state, count(*) AS n FROM (SELECT *, CASE WHEN bool_and(NOT finished) OVER (PARTITION BY venue, race_date) THEN 'cancelled' WHEN NOT finished THEN 'defect' ELSE 'ok' END AS state FROM races) GROUP BY ALL")
def cancelled_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = races(spark, sf_dir).select("venue", F.col("race_date").alias("day"), (~F.col("finished")).alias("empty"))
    return ledgers.cancelled_days(d).groupBy("venue", "day", "state").agg(F.count(F.lit(1)).alias("n"))


@R.query("SELECT event_type AS source, count(*) AS n, count(DISTINCT user_id) AS races, min(ts) AS since, max(ts) AS through FROM events GROUP BY event_type", base=False)
def collection_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("source")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("races"), F.min("ts").alias("since"), F.max("ts").alias("through"))


@R.query(", f AS (SELECT venue, race_date, race_id, max(round(p * odds * 100, 6)) AS best, arg_max(lane, (p * odds, -lane)) AS pick FROM fields GROUP BY ALL) SELECT venue, race_date, count(*) AS races, count(*) FILTER (best >= 100) AS candidates, sum(pick)::BIGINT AS picks, to_json(list(struct_pack(race_id := race_id, pick := pick) ORDER BY race_id)) AS board FROM f GROUP BY venue, race_date")
def venue_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per venue and day the nested board of its races with their best candidate and decision."""
    d = full_fields(spark, sf_dir).withColumn("ev", F.col("p") * F.col("odds"))
    f = d.groupBy("venue", "race_date", "race_id").agg(F.max(F.round(F.col("ev") * 100, 6)).alias("best"), F.max_by("lane", F.struct("ev", -F.col("lane"))).alias("pick"))
    f = f.withColumn("decision", pricing.decision(F.lit(False), F.col("best")))
    return f.groupBy("venue", "race_date").agg(F.count(F.lit(1)).alias("races"), F.count_if(F.col("decision") == "candidate").alias("candidates"), F.sum("pick").alias("picks"), F.to_json(F.array_sort(F.collect_list(F.struct("race_id", "pick")))).alias("board"))


@R.query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type AS bet_type, count(*) AS n, max(ts) AS last FROM (SELECT DISTINCT user_id, event_type, ts FROM events WHERE value IS NOT NULL) GROUP BY ALL", base=False)
def streamed_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as a file stream: idempotent append, then daily counts by source, run to the end of what is there."""
    source = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    s = source.select(F.col("user_id").alias("race_id"), F.col("event_type").alias("bet_type"), F.lit("1").alias("combination"), F.col("value").alias("odds"), F.col("ts").cast("timestamp").alias("observed_at")).withWatermark("observed_at", "40 days")
    path = ledgers.shared_folder(spark, "freshness")
    streams.drained(streams.freshness(streams.idempotent(s), "1 day"), streams.append_batches(path), "update")
    d = streams.last_updates(spark.read.parquet(path), ["start", "bet_type"])
    return d.select(F.col("start").cast("timestamp_ntz").alias("start"), "bet_type", "n", F.col("last").cast("timestamp_ntz").alias("last"))


@R.query(", s AS (SELECT venue, race_id, race_date, odds, lag(odds) OVER (PARTITION BY venue, lane ORDER BY race_date, race_id) AS before FROM runners WHERE lane = 1) SELECT venue, count(before) AS n, round(avg(ln(odds / before)), 6) AS mean_log FROM s GROUP BY venue")
def log_deviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = runners(spark, sf_dir).where("lane = 1").withColumn("before", F.lag("odds").over(Window.partitionBy("venue", "lane").orderBy("race_date", "race_id")))
    return s.groupBy("venue").agg(F.count("before").alias("n"), F.round(F.avg(pricing.log_deviation(F.col("odds"), F.col("before"))), 6).alias("mean_log"))


@R.query(""", o AS (SELECT race_id, lane, odds FROM runners WHERE lane BETWEEN 1 AND 6), r AS (SELECT race_id, venue, lag(race_id) OVER (PARTITION BY venue ORDER BY race_date, race_id) AS previous FROM (SELECT DISTINCT race_id, venue, race_date FROM runners WHERE lane BETWEEN 1 AND 6)),
q AS (SELECT r.race_id, o.lane, o.odds AS predicted FROM r JOIN o ON o.race_id = r.previous),
a AS (SELECT r.race_id, o.lane, o.odds AS actual FROM r JOIN o ON o.race_id = r.race_id WHERE r.previous IS NOT NULL),
x AS (SELECT race_id, lane, CASE WHEN predicted IS NOT NULL AND actual IS NOT NULL THEN abs(ln(actual / predicted)) END AS ratio FROM q FULL JOIN a USING (race_id, lane))
SELECT race_id, count(*) AS lanes, round(max(ratio), 6) AS max_log, round(avg(ratio), 6) AS mean_log, coalesce(string_agg(lane::VARCHAR, ',' ORDER BY lane) FILTER (ratio IS NULL), '') AS missing_lanes FROM x GROUP BY race_id""")
def race_deviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every lane's price against that of the race before at its venue: lanes that only one of them has are missing."""
    d = runners(spark, sf_dir).where("lane BETWEEN 1 AND 6")
    r = d.select("race_id", "venue", "race_date").distinct().withColumn("previous", F.lag("race_id").over(Window.partitionBy("venue").orderBy("race_date", "race_id"))).where("previous IS NOT NULL")
    predicted = r.select(F.col("race_id").alias("of"), F.col("previous").alias("race_id")).join(d.select("race_id", "lane", "odds"), "race_id").select(F.col("of").alias("race_id"), "lane", F.col("odds").alias("predicted"))
    actual = d.join(r.select("race_id"), "race_id").select("race_id", "lane", F.col("odds").alias("actual"))
    x = metrics.race_deviations(predicted, actual)
    return x.withColumns({c: F.round(c, 6) for c in ("max_log", "mean_log")})


@R.query(", x AS (SELECT race_id, race_date, venue, row_number() OVER (PARTITION BY venue ORDER BY race_date DESC, race_id DESC) AS rank FROM races) SELECT venue, rank, race_id FROM x WHERE rank <= 3")
def latest_races(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = windows.top_n(races(spark, sf_dir), ["venue"], [F.col("race_date").desc(), F.col("race_id").desc()], 3)
    return d.select("venue", F.col("rank").cast("long").alias("rank"), "race_id")
