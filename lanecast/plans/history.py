"""Regimes and static tables, markets by name, pools against chance, rebuilt series, captures, checks of times and references."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanecast.functions import keys, pricing, text
from lanecast.operators import boards, quality, rules, temporal, windows
from lanecast.plans import pooled
from lanecast.plans.contest import candidates, draw_sql, full_fields, races, runners, table
from lanecast.plans.registry import Registry
from lanecast.plans.series import observations
from lanecast.plans.timeline import _DAYS, _days
from lanecast.sources import dimensions, ledgers, pages

R = Registry()
QUERIES, SQL = R.QUERIES, R.SQL
r9 = lambda c: F.round(c, 9)
r6 = lambda c: F.round(c, 6)

_KNOWN = ", ".join([f"({v}, 'fuel', DATE '{d}', 'E30', '{c}')" for v, d, c in dimensions.FUEL] + [f"({v}, 'motor_generation', DATE '{d}', '{g}', '{c}')" for v, d, g, c in dimensions.MOTORS])


@R.query(f""", k(venue, regime_type, since, value, certainty) AS (VALUES {_KNOWN}), d AS (SELECT race_id, venue, (race_date + INTERVAL 28 YEAR)::DATE AS day, unnest(['fuel', 'motor_generation']) AS regime_type FROM races)
SELECT d.venue, d.regime_type, k.value, k.certainty, count(*) AS races, max(day) AS last_day FROM d ASOF LEFT JOIN k ON k.venue = d.venue AND k.regime_type = d.regime_type AND d.day >= k.since GROUP BY ALL""")
def races_by_regime(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Races by the fuel and the motor generation in force at their venue; days are moved by 28 years, to when regimes are known."""
    d = races(spark, sf_dir).select("race_id", "venue", F.add_months("race_date", 28 * 12).alias("day"))
    return dimensions.regimes_at(d, "day").groupBy("venue", "regime_type", "value", "certainty").agg(F.count(F.lit(1)).alias("races"), F.max("day").alias("last_day"))


_WATER = f"CASE WHEN venue IN {dimensions.FRESH} THEN 'fresh' WHEN venue IN {dimensions.BRACKISH} THEN 'brackish' ELSE 'sea' END"


@R.query(f" SELECT {_WATER} AS water, count(*) AS bets, round(avg(ret), 9) AS roi, round(avg(ret) - {dimensions.LANE_ONE[0]}, 9) AS over_published FROM candidates WHERE lane = 1 AND venue BETWEEN 1 AND 24 GROUP BY ALL")
def lane_one_by_water(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The return of lane 1 by the venue's water, beside the published one."""
    d = candidates(spark, sf_dir).where("lane = 1").join(F.broadcast(dimensions.waters(spark)), "venue")
    return d.groupBy("water").agg(F.count(F.lit(1)).alias("bets"), r9(F.avg("ret")).alias("roi"), r9(F.avg("ret") - dimensions.LANE_ONE[0]).alias("over_published"))


_QUOTES = "q AS (SELECT user_id, event_type, ts, value + 1 AS odds, date_trunc('day', ts) + INTERVAL 1 DAY AS deadline, event_id % 3 = 0 AND hour(ts) >= 18 AS closing FROM events)"


@R.query(f"""WITH {_QUOTES}, l AS (SELECT *, epoch(deadline - ts) / 60.0 AS lead FROM q WHERE odds > 0)
SELECT user_id, event_type, deadline, round, round(arg_max(odds, (ts, -odds)), 9) AS odds FROM l JOIN (VALUES ('t-2', 0.0, 5.0), ('t-10', 5.0, 20.0), ('t-60', 20.0, 90.0)) w(round, lo, hi) ON lead BETWEEN lo AND hi WHERE NOT closing GROUP BY ALL
UNION ALL SELECT user_id, event_type, deadline, 'closing', round(arg_max(odds, (ts, -odds)), 9) FROM l WHERE closing GROUP BY ALL""", base=False)
def markets_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The closing market and the three live rounds of the days' quotes."""
    e = table(spark, sf_dir, "events").withColumn("deadline", F.expr("date_trunc('day', ts) + INTERVAL 1 DAY"))
    q = e.select(F.struct("user_id", "deadline").alias("race_id"), "event_type", F.col("ts").alias("available_at"), (F.col("value") + 1).alias("odds"), ((F.col("event_id") % 3 == 0) & (F.hour("ts") >= 18)).alias("closing"))
    schedule = e.select(F.struct("user_id", "deadline").alias("race_id"), "deadline").distinct()
    each = [rules.market(q, schedule, ["race_id", "event_type"], pricing.rounds(spark), name) for name in ("closing", *[r for r, *_ in pricing.ROUNDS])]
    d = reduce(DataFrame.unionByName, each)
    return d.select("race_id.user_id", "event_type", "race_id.deadline", "round", r9("odds").alias("odds"))


PERMUTATIONS, NOISES, SIGMA, LEAST = 4, 4, 0.6, 1.5
_OTHERS = pooled._POOL.split("\ng AS")[0].strip().strip(",").strip().replace("fields", "others")
_PAIRED = f""", ids AS (SELECT DISTINCT race_id FROM fields), dr AS (SELECT range AS draw FROM range({PERMUTATIONS})),
src AS (SELECT draw, race_id, row_number() OVER (PARTITION BY draw ORDER BY {draw_sql("0", "draw", "race_id")}, race_id) AS n FROM ids CROSS JOIN dr),
dst AS (SELECT race_id, row_number() OVER (ORDER BY {draw_sql("0", "'to'", "race_id")}, race_id) AS n FROM ids),
others AS (SELECT dst.race_id * {PERMUTATIONS} + draw AS race_id, lane, p FROM dst JOIN src USING (n) JOIN fields f ON f.race_id = src.race_id),
ou AS (WITH {_OTHERS} SELECT race_id // {PERMUTATIONS} AS race_id, race_id % {PERMUTATIONS} AS draw, pool, array_to_string(l, '-') AS combination, round(p, 9) AS p FROM u),
nu AS (SELECT draw, ou.pool, pc.ret, ou.p * odds AS ev FROM ou JOIN pc USING (race_id, pool, combination) WHERE complete QUALIFY row_number() OVER (PARTITION BY draw, pool, race_id ORDER BY ou.p * odds DESC, combination) = 1),
ru AS (SELECT pool, avg(ret) AS real FROM (SELECT pool, ret, p * odds AS ev FROM pc WHERE complete QUALIFY row_number() OVER (PARTITION BY pool, race_id ORDER BY p * odds DESC, combination) = 1) WHERE ev >= {LEAST} GROUP BY pool)"""


@R.query(pooled._POOL + _PAIRED + f" SELECT pool, round(avg(roi), 6) AS null_mean, round(max(roi), 6) AS null_max, round(stddev_pop(roi), 6) AS null_sd, round(any_value(real), 6) AS real, round((any_value(real) - avg(roi)) / nullif(stddev_pop(roi), 0), 4) AS z FROM (SELECT draw, pool, avg(ret) AS roi FROM nu WHERE ev >= {LEAST} GROUP BY ALL) LEFT JOIN ru USING (pool) GROUP BY pool")
def pools_against_chance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every priced pool's return of its best candidates, beside that with other races' chances at the same prices."""
    rows = ledgers.stored(pooled.race_rows(spark, sf_dir), "pool-races")  # read by the draws and by the real bets
    real = pooled.pool_bets(pooled.best_candidates(rows), {"ev_best": (LEAST,)}).groupBy("pool").agg(F.avg("ret").alias("roi"))
    d = rules.pools_against_null(pooled.pool_null(rows, LEAST, PERMUTATIONS), real)
    return d.select("pool", *[r6(x).alias(x) for x in ("null_mean", "null_max", "null_sd", "real")], F.round("z", 4).alias("z"))


_NORMAL = f"sqrt(-2 * ln(greatest({draw_sql('0', 'draw', 'race_id', 'pool', 'combination', chr(39) + 'u' + chr(39))}, 1e-12))) * cos(2 * 3.141592653589793 * {draw_sql('0', 'draw', 'race_id', 'pool', 'combination', chr(39) + 'v' + chr(39))})"


@R.query(pooled._POOL + f""", x AS (SELECT draw, race_id, pool, combination, ret, p * odds * exp({SIGMA} * {_NORMAL}) AS ev FROM pc CROSS JOIN (SELECT range AS draw FROM range({NOISES})) WHERE complete),
y AS (SELECT draw, pool, count(*) AS bets, avg(ret) AS roi FROM (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY draw, pool, race_id ORDER BY ev DESC, combination) = 1) WHERE ev >= {LEAST} GROUP BY ALL)
SELECT pool, round(avg(roi), 6) AS noisy_roi_mean, round(stddev_pop(roi), 6) AS noisy_roi_sd, round(avg(bets), 6) AS noisy_bets_mean FROM y GROUP BY pool""")
def pool_price_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every priced pool's best candidates chosen at noisy prices."""
    d = pooled.pool_noise(pooled.race_rows(spark, sf_dir), LEAST, SIGMA, NOISES)
    return d.groupBy("pool").agg(r6(F.avg("roi")).alias("noisy_roi_mean"), r6(F.stddev_pop("roi")).alias("noisy_roi_sd"), r6(F.avg("bets")).alias("noisy_bets_mean"))


_OLD = "CASE WHEN race_id % 4 < 3 THEN concat(r.venue, '-', (race_date - DATE '1970-01-01') // 2, '-', race_id % 2) END"


@R.query(_DAYS + f""", o AS (SELECT r.venue, s.session, r.race_date AS day, race_id, {_OLD} AS old_id, (r.race_date - DATE '1970-01-01') // 2 % 3 = 0 AS titled FROM races r JOIN s ON s.venue = r.venue AND s.day = r.race_date),
v AS (SELECT venue, session, arg_min(old_id, (day, old_id)) FILTER (old_id IS NOT NULL) AS survivor, count(DISTINCT old_id) AS merged, min(old_id) FILTER (titled) AS other, bool_or(titled) FILTER (old_id IS NOT NULL) AS any_title FROM o GROUP BY ALL),
w AS (SELECT o.venue, o.session, o.day, count(*) AS n, coalesce(bool_or(old_id <> survivor), false) AS moved FROM o JOIN v USING (venue, session) GROUP BY ALL)
SELECT venue, session, survivor, CASE WHEN split_part(survivor, '-', 2)::BIGINT % 3 = 0 THEN 'T' || survivor ELSE 'T' || other END AS title, merged, merged > 1 AS split_before, (SELECT coalesce(sum(n) FILTER (moved), 0)::BIGINT FROM w WHERE w.venue = v.venue AND w.session = v.session) AS repointed FROM v WHERE survivor IS NOT NULL""")
def series_rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Races put on one series a session: which id survives under which title, how many races move."""
    s = windows.series_sessions(_days(spark, sf_dir), "venue", "day", "counter").select("venue", "day", "session")
    half, rid = F.floor(F.unix_date("race_date") / 2), F.col("race_id")
    o = races(spark, sf_dir).select("venue", F.col("race_date").alias("day"), "race_id", half.alias("half"), F.when(rid % 4 < 3, F.concat_ws("-", "venue", half.cast("string"), (rid % 2).cast("string"))).alias("old_id"))
    titles = o.where("old_id IS NOT NULL").select("old_id", F.when(F.col("half") % 3 == 0, F.concat(F.lit("T"), "old_id")).alias("title")).distinct()
    return windows.series_rebuild(o.join(s, ["venue", "day"]).drop("half"), titles)


@R.query(", d AS (SELECT racer, race_date, avg(finish - m) AS x FROM (SELECT *, avg(finish) OVER (PARTITION BY lane) AS m FROM runners) GROUP BY ALL), l AS (SELECT x, lag(x, 1) OVER w AS x1, lag(x, 2) OVER w AS x2, lag(x, 3) OVER w AS x3 FROM d WINDOW w AS (PARTITION BY racer ORDER BY race_date)) SELECT round(corr(x, x1), 6) AS lag1, round(corr(x, x2), 6) AS lag2, round(corr(x, x3), 6) AS lag3 FROM l")
def lane_adjusted_persistence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How a day's finish, less its lane's mean, goes with those of the days before."""
    d = windows.lag_persistence(runners(spark, sf_dir), ["racer"], "race_date", "finish", adjust="lane")
    return d.select(*[r6(c).alias(c) for c in ("lag1", "lag2", "lag3")])


@R.query(""", s AS (SELECT race_id, deadline, deadline - to_minutes((race_id * 7 % 75)::INT) AS now, CASE WHEN race_id % 3 = 0 THEN deadline - to_minutes((race_id % 90)::INT) END AS seen FROM races)
SELECT race_id, max(lead) AS lead FROM s, (VALUES (60), (10), (2)) l(lead) WHERE abs(epoch(deadline - now) / 60 - lead) <= 2 AND NOT coalesce(seen <= now AND seen >= deadline - to_minutes(lead + 2), false) GROUP BY race_id""")
def due_for_odds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Races whose quotes are to be taken now and weren't since the lead's window opened; each race is looked at some minutes before its deadline."""
    rid, before = F.col("race_id"), lambda n: F.col("deadline") - F.make_dt_interval(mins=n.cast("int"))
    s = races(spark, sf_dir).select("race_id", "deadline", before(F.col("race_id") * 7 % 75).alias("now"))
    done = s.where(rid % 3 == 0).select("race_id", "now", before(rid % 90).alias("observed_at")).where("observed_at <= now")
    leads = spark.createDataFrame([(60,), (10,), (2,)], "lead int")
    return temporal.due(s, leads, done, F.col("now"), 2)


@R.query(""", d AS (SELECT racer, race_date, avg(quantity) AS m FROM runners GROUP BY ALL), w AS (SELECT *, round(avg(m) OVER (PARTITION BY racer ORDER BY race_date ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), 9) AS recent FROM d),
x AS (SELECT race_id, lane, recent FROM runners JOIN w USING (racer, race_date))
SELECT race_id, lane, recent, round(CASE WHEN recent IS NOT NULL AND count(recent) OVER k >= 2 AND stddev_pop(recent) OVER k > 0 THEN (recent - avg(recent) OVER k) / stddev_pop(recent) OVER k ELSE 0 END, 6) AS z FROM x WINDOW k AS (PARTITION BY race_id)""")
def recent_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of the racer's last ten racing days before the race's, and its z-score in the race."""
    d = windows.recent_average(runners(spark, sf_dir), ["racer"], "race_date", "quantity").select("race_id", "lane", r9("recent").alias("recent"))
    return windows.group_z(d, ["race_id"], "recent", "z").withColumn("z", r6("z"))


_TIMES = """t AS (SELECT l_orderkey, o_orderdate AS event_time, o_orderdate + to_days(l_linenumber % 3) AS published_at, l_shipdate AS collected_at, l_shipdate + to_days(((l_linenumber * 7 + l_partkey) % 5 - 1)::INT) AS available_at, l_shipdate AS valid_from, CASE WHEN l_partkey % 4 <> 0 THEN l_shipdate + to_days((l_partkey % 9 - 1)::INT) END AS valid_to FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"""


@R.query(f"WITH {_TIMES}, v AS (SELECT CASE WHEN event_time > published_at THEN 'event_time > published_at' WHEN published_at > collected_at THEN 'published_at > collected_at' WHEN collected_at > available_at THEN 'collected_at > available_at' WHEN valid_from > valid_to THEN 'valid_from > valid_to' END AS violation FROM t) SELECT violation, count(*) AS n FROM v WHERE violation IS NOT NULL GROUP BY ALL", base=False)
def times_out_of_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records by the first pair of their times that isn't in order."""
    d = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    days = lambda n: F.make_dt_interval(days=n.cast("int"))
    part = F.col("l_partkey")
    t = d.select(F.col("o_orderdate").alias("event_time"), (F.col("o_orderdate") + days(F.col("l_linenumber") % 3)).alias("published_at"), F.col("l_shipdate").alias("collected_at"), (F.col("l_shipdate") + days((F.col("l_linenumber") * 7 + part) % 5 - 1)).alias("available_at"), F.col("l_shipdate").alias("valid_from"), F.when(part % 4 != 0, F.col("l_shipdate") + days(part % 9 - 1)).alias("valid_to"))
    return temporal.temporal_violations(t).groupBy("violation").agg(F.count(F.lit(1)).alias("n"))


@R.query("SELECT CASE WHEN p_partkey IS NULL THEN 'E004' ELSE 'resolved' END AS code, count(*) AS n, count(DISTINCT l_partkey) AS keys FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size < 40) ON p_partkey = l_partkey GROUP BY ALL", base=False)
def references_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines whose part is known, and those that go to quarantine."""
    d = table(spark, sf_dir, "lineitem").select("l_partkey")
    good, bad = quality.split_references(d, table(spark, sf_dir, "part").where("p_size < 40").select(F.col("p_partkey").alias("l_partkey")), ["l_partkey"])
    return good.withColumn("code", F.lit("resolved")).unionByName(bad).groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("l_partkey").alias("keys"))


@R.query(""", b AS (SELECT race_id, lane, CASE WHEN quantity > 2 AND race_id % 3 <> 0 THEN 6.5 + disc END AS t, part % 7 = 0 AS parts FROM runners WHERE race_id % 5 <> 0),
c AS (SELECT * FROM b WHERE race_id IN (SELECT race_id FROM b WHERE t IS NOT NULL)), k(known) AS (VALUES (true), (false))
SELECT race_id, lane, t AS exhibition_time, CASE WHEN lane % 2 = 1 THEN lane / 100 END AS start_timing, CASE WHEN known THEN parts END AS parts_changed FROM c, k WHERE known = (race_id % 2 = 0)""")
def first_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of pages taken before a race, of races that have none yet; every second page doesn't tell of parts."""
    d, rid = runners(spark, sf_dir), F.col("race_id")
    boats = d.select("race_id", "lane", F.when((F.col("quantity") > 2) & (rid % 3 != 0), 6.5 + F.col("disc")).alias("exhibition_time"), (F.col("part") % 7 == 0).alias("parts_changed"))
    starts = d.where("lane % 2 = 1").select("race_id", "lane", (F.col("lane") / 100).alias("start_timing"))
    existing = d.where("race_id % 5 = 0").select("race_id")
    each = [ledgers.first_capture(existing, boats.where((rid % 2 == 0) == known), starts, known) for known in (True, False)]
    return each[0].unionByName(each[1])


@R.query(""", x AS (SELECT race_id, lane, CASE WHEN race_id % 10 = 2 THEN p * 1.1 WHEN race_id % 10 = 3 AND lane = 1 THEN -p WHEN race_id % 10 = 4 AND lane = 6 THEN 0 ELSE p END AS p FROM fields WHERE NOT (race_id % 10 = 1 AND lane = 6)),
g AS (SELECT race_id, CASE WHEN count(*) <> 6 THEN 'keys' WHEN min(p) < 0 OR max(p) > 1 THEN 'range' WHEN bool_or(race_id % 10 > 6 AND lane = 6 AND p <> 0) THEN 'zero' WHEN abs(sum(p) - 1) > 1e-9 THEN 'sum' END AS violation FROM x GROUP BY race_id)
SELECT violation, count(*) AS n FROM g WHERE violation IS NOT NULL GROUP BY ALL""")
def distributions_invalid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Races whose chances aren't a distribution, by reason; some lack a lane, some must give lane 6 nothing."""
    kind, lane, p = F.col("race_id") % 10, F.col("lane"), F.col("p")
    d = full_fields(spark, sf_dir).where((kind != 1) | (lane != 6)).select("race_id", "lane", F.when(kind == 2, p * 1.1).when((kind == 3) & (lane == 1), -p).when((kind == 4) & (lane == 6), 0.0).otherwise(p).alias("p"))
    return quality.distribution_violations(d, ["race_id"], "p", 6, zero_at=(kind > 6) & (lane == 6)).groupBy("violation").agg(F.count(F.lit(1)).alias("n"))


@R.query(f" SELECT race_id, lane, round(p * odds, 9) AS raw, round(greatest(0, p - m) * odds, 9) AS conservative, round(m, 9) AS margin, '{pricing.FORMULA_VERSION}' AS version FROM (SELECT *, 0.01 + 0.1 / sqrt(quantity) + disc / 10 AS m FROM candidates WHERE odds > 0)")
def expected_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw and conservative value of every priced candidate."""
    v = pricing.value_report(F.col("p"), F.col("odds"), F.lit(0.01), F.col("quantity"), F.col("disc"), 0.1, 0.1)
    return candidates(spark, sf_dir).withColumn("v", v).where("v IS NOT NULL").select("race_id", "lane", r9("v.raw").alias("raw"), r9("v.conservative").alias("conservative"), r9("v.margin").alias("margin"), "v.version")


@R.query(" SELECT race_date, race_id, lane, finish FROM fields WHERE finished ORDER BY race_date DESC, race_id, lane")
def results_newest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finishes, newest day first, then by race and lane."""
    return full_fields(spark, sf_dir).where("finished").select("race_date", "race_id", "lane", "finish").orderBy(F.col("race_date").desc(), "race_id", "lane")


_WINDS = ("北", "東", "南", "西")
_SUM = "(n * 37 + ids % 1000)"


def _weather_sql(name: str, short: int, long: int | None) -> str:
    at = f"CASE WHEN office THEN {'NULL' if long is None else long} ELSE {short} END"
    value = f"{list(_WINDS)}[(s + k) % 4 + 1]" if name.endswith("_direction") else "((s + k * 7) % 400)::DOUBLE / 10"
    return f"(SELECT CASE WHEN k IS NULL OR s % 50 = 7 OR (s + k) % 9 = 0 OR (s + k) % 10 = 0 THEN NULL ELSE {value} END FROM (SELECT ({at})::BIGINT AS k)) AS {name}"


@R.query(f""", w AS (SELECT venue, race_date, venue % 4 = 0 AS office, {_SUM} AS s FROM (SELECT venue, race_date, count(*) AS n, sum(race_id)::BIGINT AS ids FROM races GROUP BY ALL))
SELECT venue, race_date, s % 50 = 7 AS rejected, {', '.join(_weather_sql(n, a, b) for n, (a, b) in pages.DAILY_WEATHER.items())} FROM w""")
def weather_page_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of daily weather a venue and month, rendered and parsed back: two layouts, marks of missing values, rows of other lengths."""
    w = races(spark, sf_dir).groupBy("venue", "race_date").agg(F.count(F.lit(1)).alias("n"), F.sum("race_id").alias("ids"))
    w = w.select("venue", "race_date", (F.col("n") * 37 + F.col("ids") % 1000).alias("s"))
    office, s = F.col("venue") % 4 == 0, F.col("s")
    width = F.when(s % 50 == 7, 18).when(office, 20).otherwise(17)
    wind = lambda k: F.when(office, k.isin(*[b for n, (_, b) in pages.DAILY_WEATHER.items() if n.endswith("_direction") and b])).otherwise(k.isin(*[a for n, (a, _) in pages.DAILY_WEATHER.items() if n.endswith("_direction")]))
    number = lambda k: F.concat(F.format_string("%.1f", (s + k * 7) % 400 / 10), F.when((s + k) % 4 == 0, " )").otherwise(""))
    cell = lambda k: F.when((s + k) % 9 == 0, "///").when((s + k) % 10 == 0, "--").when(wind(k), F.element_at(F.array(*map(F.lit, _WINDS)), ((s + k) % 4 + 1).cast("int"))).otherwise(number(k))
    cells = F.transform(F.sequence(F.lit(0), width - 1), lambda k: F.concat(F.lit("<td>"), cell(k), F.lit("</td>")))
    row = F.concat(F.lit("<tr><td><a>"), F.dayofmonth("race_date").cast("string"), F.lit("</a></td>"), F.array_join(cells, ""), F.lit("</tr>"))
    page = F.struct("venue", F.trunc("race_date", "month").alias("month"))
    html = w.groupBy(page.alias("page")).agg(F.concat(F.lit("<table><tr><th>day</th></tr>"), F.array_join(F.collect_list(row), ""), F.lit("</table>")).alias("html"))  # a month's days
    d = pages.daily_weather(pages.table_cells(html, "page", "html"))
    return d.select("page.venue", F.date_add("page.month", F.col("day") - 1).alias("race_date"), "rejected", *pages.DAILY_WEATHER)


@R.query(""" SELECT race_date, strftime(race_date::TIMESTAMP - INTERVAL 9 HOUR, '%Y-%m-%d %H:%M') AS card, strftime(race_date::TIMESTAMP + INTERVAL 15 HOUR, '%Y-%m-%d %H:%M') AS results, strftime(make_date(year(race_date), CASE WHEN month(race_date) < 7 THEN 1 ELSE 7 END, 1)::TIMESTAMP - INTERVAL 9 HOUR, '%Y-%m-%d %H:%M') AS period,
  strftime(race_date, '%Y-%m-%d 00:00') AS shown, strftime(race_date, '%Y-%m') AS month, format('{:,}', sum(race_id)::BIGINT) || '円' AS amount, printf('%.1f', avg(finished::INT) * 100) || '%' AS finished, count(*) FILTER (race_id % 3 = 0) AS fixed FROM races GROUP BY race_date""")
def race_day_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per day: when its card, results and period figures become available (in UTC), and its figures as they are shown."""
    title = F.when(F.col("race_id") % 3 == 0, "予選　進入 固定").otherwise("一般")
    d = races(spark, sf_dir).groupBy("race_date").agg(F.sum("race_id").alias("amount"), F.avg(F.col("finished").cast("int")).alias("share"), F.count_if(text.fixed_entry(title)).alias("fixed"))
    shown, day = lambda ts: F.date_format(ts, "yyyy-MM-dd HH:mm"), F.col("race_date")
    card = keys.card_available(day)
    period = keys.period_available(F.year(day), F.when(F.month(day) < 7, 1).otherwise(2))
    return d.select("race_date", shown(card).alias("card"), shown(keys.next_day_available(day)).alias("results"), shown(period).alias("period"), shown(keys.for_display(card)).alias("shown"), keys.month_label(day).alias("month"), text.yen(F.col("amount")).alias("amount"), text.percentage(F.col("share")).alias("finished"), "fixed")


@R.query(""" SELECT 'quotes ' || event_type AS label, count(*) AS n, count(DISTINCT user_id) AS races, min(ts) AS since, max(ts) AS through FROM events WHERE event_type IN ('click', 'purchase') GROUP BY ALL
UNION ALL SELECT 'prediction (v' || race_id % 3 || ')', count(*), count(DISTINCT race_id), min(deadline), max(deadline) FROM runners GROUP BY ALL
UNION ALL SELECT 'observations', count(*), count(DISTINCT race_id), min(observed_at), max(observed_at) FROM (SELECT race_id, available_at + to_days((quantity % 4)::INT) AS observed_at FROM runners UNION ALL SELECT race_id, available_at + INTERVAL 7 DAY FROM runners WHERE quantity % 2 = 1)""")
def collected_by_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What has been collected: quotes of two kinds, observations, and predictions by model version."""
    e = table(spark, sf_dir, "events").select("event_type", F.col("user_id").alias("race_id"), F.col("ts").alias("at"))
    sources = {f"quotes {kind}": e.where(F.col("event_type") == kind).drop("event_type") for kind in ("click", "purchase")}
    sources["prediction"] = runners(spark, sf_dir).select("race_id", F.col("deadline").alias("at"), F.concat(F.lit("v"), F.col("race_id") % 3).alias("model_version"))
    sources["observations"] = observations(spark, sf_dir).select("race_id", F.col("observed_at").alias("at"))
    return boards.collected(sources)
