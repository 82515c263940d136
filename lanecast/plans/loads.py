"""Page and result loads, counters, board checks, calibration over months and field thirds over the supplied tables.

The pages are made of the races by Spark, one a race, and parsed again: `pages` itself has no tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lanecast.operators import folds, metrics, quality
from lanecast.plans.contest import entries, full_fields, payouts, races, runners
from lanecast.plans.registry import Registry
from lanecast.sources import ledgers, pages

R = Registry()
QUERIES, SQL = R.QUERIES, R.SQL
r9 = lambda c: F.round(c, 9)


def _in_order(row, *order: str):
    """A race's rows of markup joined in order; six at most."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, row.alias("row")))), lambda s: s["row"]), "")


def _cells(*values):
    return F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), v.cast("string"), F.lit("</td>")) for v in values], F.lit("</tr>"))


def result_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page, html: finish in full-width digits (the last an 'F' in every fifth race), racer, quote as time, starts with the
    technique behind the winner's, payouts whose label stands once."""
    d = full_fields(spark, sf_dir)
    place = F.when((F.col("finish") == 6) & (F.col("race_id") % 5 == 0), "Ｆ").otherwise(F.translate(F.col("finish").cast("string"), "123456", "１２３４５６"))
    timing = F.concat(F.when(F.col("disc") >= 0.08, "F").otherwise(""), F.lit("."), F.lpad((F.col("disc") * 100).cast("int").cast("string"), 2, "0"))
    lanes = _cells(place, F.col("lane"), F.concat_ws(" ", F.col("racer").cast("string"), F.lit("名")), F.col("quantity").cast("int"))
    starts = F.concat(F.lit("<tr><td><span>"), F.col("lane").cast("string"), F.lit("</span> <span>"), timing, F.when(F.col("won"), "   逃げ").otherwise(""), F.lit("</span></td></tr>"))
    label = F.when(F.col("finish") == 1, "複勝").otherwise("")
    paid = F.when(F.col("finish") <= 2, _cells(label, F.col("lane"), F.concat(F.lit("¥"), F.format_number(F.col("quantity").cast("int") * 100, 0)), F.col("finish"))).otherwise("")
    table = lambda heading, body: F.concat(F.lit(f"<table><tr><th>{heading}</th></tr>"), body, F.lit("</table>"))
    g = d.groupBy(F.col("race_id").alias("page"), "race_class").agg(_in_order(lanes, "finish").alias("lanes"), _in_order(starts, "lane").alias("starts"), _in_order(paid, "finish").alias("paid"))
    return g.select("page", F.concat(table("着", F.col("lanes")), table("スタート情報", F.col("starts")), table("勝式", F.col("paid")), table("決まり手", _cells(F.col("race_class")))).alias("html"))


@R.query(""" SELECT race_id AS page, lane::INT AS lane, CASE WHEN NOT (finish = 6 AND race_id % 5 = 0) THEN finish::INT END AS position, CASE WHEN finish = 6 AND race_id % 5 = 0 THEN 'Ｆ' END AS status, racer::INT AS registration,
quantity::INT::VARCHAR AS race_time, floor(disc * 100 + 1e-9) / 100 * CASE WHEN disc >= 0.08 THEN -1 ELSE 1 END AS start_timing, true AS has_result FROM fields""")
def result_page_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = pages.table_cells(result_pages(spark, sf_dir), "page", "html")
    return pages.result_lanes(cells)


@R.query(" SELECT f.race_id AS page, '複勝' AS bet_type, lane::VARCHAR AS combination, quantity::INT * 100 AS amount, finish::INT AS popularity, race_class AS technique FROM fields f WHERE finish <= 2")
def result_page_payouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = pages.table_cells(result_pages(spark, sf_dir), "page", "html")
    return pages.result_payouts(cells).join(pages.result_technique(cells), "page")


def pre_race_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page, html: a body a boat, the start exhibition in order of finish, readings of the surface."""
    d = full_fields(spark, sf_dir)
    head = [F.col("lane"), F.concat(F.lit('<a href="?toban='), F.col("racer").cast("string"), F.lit('">x</a>')), F.lit("名"), F.concat(F.col("quantity").cast("int").cast("string"), F.lit("kg")), F.col("disc"), F.lit("-0.5"), F.when(F.col("won"), "新").otherwise(""), F.when(F.col("finish") == 2, "<ul><li>a</li><li>b</li></ul>").otherwise("")]
    body = F.concat(F.lit("<tbody>"), _cells(*head), F.lit("<tr><td>進入</td></tr>"), _cells(F.lit("1.5"), F.lit("展示")), F.lit("</tbody>"))
    start = F.concat(F.lit('<tr><td><span class="table1_boatImage1Number is-type">'), F.col("lane").cast("string"), F.lit('</span><span class="table1_boatImage1Time">'), F.when(F.col("won"), "F.10").otherwise(".10"), F.lit("</span></td></tr>"))
    g = d.groupBy(F.col("race_id").alias("page"), "venue").agg(_in_order(body, "lane").alias("boats"), _in_order(start, "finish").alias("starts"))
    unit = lambda name, v: F.concat(F.lit(f'<div class="unit {name}"><span class="LabelData">'), v, F.lit("</span></div>"))
    wind = F.concat(F.col("venue").cast("string"), F.lit("m"))
    picture = lambda name, code: F.concat(F.lit('<p class="weather1_bodyUnitImage '), F.lit(name), code.cast("string"), F.lit('"></p>'))
    number = (F.col("page") % 12 + 1).cast("string")
    title = F.concat(F.lit('<p class="weather1_title">水面気象情報　'), F.when(F.col("page") % 5 == 0, "締切時").otherwise(F.concat(number, F.lit("R時点"))), F.lit("</p>"))
    weather = F.concat(F.lit('<div class="unit is-weather">'), picture("is-weather", F.col("page") % 4), F.lit('<span class="LabelTitle">'), F.when(F.col("page") % 4 == 0, "晴").otherwise("曇り"), F.lit("</span></div>"))
    direction = F.concat(F.lit('<div class="unit is-windDirection">'), F.when(F.col("page") % 3 > 0, picture("is-wind", F.col("venue") % 17)).otherwise(""), F.lit("</div>"))
    body = F.concat(title, F.lit('<div class="weather1_body">'), unit("is-direction", F.lit("20.5℃")), weather, unit("is-wind", wind), direction, unit("is-wave", F.lit("3cm")), F.lit("</div>"))
    return g.select("page", F.concat(F.lit("<table>"), "boats", F.lit("</table><table><tr><th>コース</th></tr>"), "starts", F.lit("</table>"), body).alias("html"))


@R.query(" SELECT race_id AS page, lane::INT AS lane, racer::INT AS registration, quantity AS weight, 1.5::DOUBLE AS ballast, disc AS exhibition_time, won AS propeller_changed, CASE WHEN finish = 2 THEN 'a,b' ELSE '' END AS parts, finish::INT AS course, 0.1::DOUBLE AS start_timing, won AS flying, '名' AS name, -0.5::DOUBLE AS tilt, 20.5::DOUBLE AS air_temperature, venue::DOUBLE AS wind_speed, 3.0::DOUBLE AS wave_height, NULL::DOUBLE AS water_temperature, CASE WHEN race_id % 3 > 0 THEN (venue % 17)::INT END AS wind_direction, (race_id % 4)::INT AS weather_code, CASE WHEN race_id % 4 = 0 THEN '晴' ELSE '曇り' END AS weather, CASE WHEN race_id % 5 = 0 THEN '締切時' ELSE (race_id % 12 + 1) || 'R時点' END AS label, CASE WHEN race_id % 5 > 0 THEN (race_id % 12 + 1)::INT END AS reference_race FROM fields")
def pre_race_page_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = ledgers.stored(pre_race_pages(spark, sf_dir), "pre-race-pages")  # made once, read by three parsers
    boats = pages.pre_race_boats(d, "page", "html").withColumn("parts", F.array_join("parts", ","))
    return boats.join(pages.start_exhibition(d, "page", "html"), ["page", "lane"]).join(pages.surface(d, "page", "html"), "page")


@R.query(" SELECT race_id, lane, finish, CASE WHEN finish = 1 THEN payout END AS payout, CASE WHEN finish = 1 THEN race_class END AS technique FROM fields LEFT JOIN (SELECT race_id, payout FROM payouts) USING (race_id)")
def live_result_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = full_fields(spark, sf_dir)
    paid = payouts(spark, sf_dir).join(races(spark, sf_dir).select("race_id", F.col("race_class").alias("technique")), "race_id").select("race_id", "payout", "technique")
    return ledgers.live_results(d.select("race_id", "lane", "finish"), paid)


@R.query(" SELECT lane, race_id % 5 <> 0 AND lane <> 4 AS has_card, count(*) AS n, sum(CASE WHEN race_id % 5 <> 0 AND lane <> 4 THEN quantity END) AS quantity FROM runners GROUP BY ALL")
def card_result_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of all races against cards that lack races and a lane."""
    cards = entries(spark, sf_dir).where("race_id % 5 <> 0 AND lane <> 4").select("race_id", "lane", "quantity")
    d = ledgers.relinked(cards, runners(spark, sf_dir).select("race_id", "lane", "finish"))
    return d.groupBy("lane", "has_card").agg(F.count(F.lit(1)).alias("n"), F.sum("quantity").alias("quantity"))


@R.query(""", s AS (SELECT *, row_number() OVER (PARTITION BY venue, race_date ORDER BY race_id) AS number FROM races), x AS (SELECT s.race_id, CASE WHEN s.race_id % 7 = 0 THEN 'unmatched' WHEN race_class LIKE '5%' THEN 'no_deadline' WHEN s.race_id % 11 = 0 THEN 'existing' WHEN NOT bool_or(quantity > 10) THEN 'untimed' ELSE 'added' END AS outcome, count(*) AS lanes FROM s JOIN entries USING (race_id) GROUP BY s.race_id, race_class)
SELECT outcome, count(*) AS races, CASE WHEN outcome = 'added' THEN sum(lanes) ELSE 0 END::BIGINT AS rows_added FROM x GROUP BY outcome""")
def mirror_back_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mirror of all races: every seventh race has a number that the schedule lacks, one class has no deadline."""
    w = Window.partitionBy("venue", "race_date").orderBy("race_id")
    s = races(spark, sf_dir).withColumn("number", F.row_number().over(w)).withColumnRenamed("race_date", "day")
    number = F.when(F.col("race_id") % 7 == 0, F.col("number") + 1000000).otherwise(F.col("number"))
    feed = entries(spark, sf_dir).join(s, "race_id").select("venue", "day", number.alias("number"), "lane", F.when(F.col("quantity") > 10, F.col("quantity")).alias("exhibition_time"))
    schedule = s.withColumn("deadline", F.when(~F.col("race_class").startswith("5"), F.col("deadline")))
    added, counts = ledgers.mirror_fill(feed, schedule, s.where("race_id % 11 = 0"))
    n = added.where("observed_at = available_at AND parts_changed IS NULL").agg(F.count(F.lit(1)).alias("n"))
    return counts.crossJoin(F.broadcast(n)).select("outcome", "races", F.when(F.col("outcome") == "added", F.col("n")).otherwise(F.lit(0)).alias("rows_added"))  # n: one row


@R.query(", x AS (SELECT race_id, finished, count(*) AS entries, count(*) FILTER (available_at > deadline) AS late, count(*) FILTER (won) AS winners, count(*) FILTER (rate > 9) AS top_rates, count(*) FILTER (lane = 6) AS sixth FROM runners GROUP BY ALL), u AS (SELECT 'races' AS name, count(*) AS n FROM x UNION ALL SELECT 'races_finished', count(*) FILTER (finished) FROM x UNION ALL SELECT 'entries', sum(entries) FROM x UNION ALL SELECT 'entries_late', sum(late) FROM x UNION ALL SELECT 'winners', sum(winners) FROM x UNION ALL SELECT 'top_rates', sum(top_rates) FROM x UNION ALL SELECT 'sixth_lanes', sum(sixth) FROM x) SELECT name, n::BIGINT AS n FROM u")
def load_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of each day's file, merged; files are venue days."""
    count = lambda c: F.count_if(c)
    named = {"races": F.count_distinct("race_id"), "races_finished": F.count_distinct(F.when(F.col("finished"), F.col("race_id"))), "entries": F.count(F.lit(1)), "entries_late": count(F.col("available_at") > F.col("deadline")), "winners": count(F.col("won")), "top_rates": count(F.col("rate") > 9), "sixth_lanes": count(F.col("lane") == 6)}
    pairs = [x for name, c in named.items() for x in (F.lit(name), c)]
    return ledgers.merged_counters(runners(spark, sf_dir).groupBy("venue", "race_date").agg(F.create_map(*pairs).alias("counters")))


@R.query(", b AS (SELECT race_id, venue, CASE WHEN race_id % 13 <> 0 THEN deadline END AS deadline, nullif(race_class, '5-LOW') AS label FROM races UNION ALL SELECT race_id, venue, deadline, race_class FROM races WHERE race_id % 50 = 0), c AS (SELECT count(*) - count(DISTINCT race_id) AS d, count(*) FILTER (deadline IS NULL) AS t, count(*) FILTER (label IS NULL) AS l FROM b) SELECT 'duplicate' AS defect, 'race_id' AS field, d AS n FROM c UNION ALL SELECT 'missing', 'deadline', t FROM c UNION ALL SELECT 'missing', 'label', l FROM c UNION ALL SELECT 'missing', 'race_id', 0 FROM c UNION ALL SELECT 'missing', 'venue', 0 FROM c")
def board_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A board with repeated races and missing keys against its required keys."""
    d = races(spark, sf_dir)
    b = d.select("race_id", "venue", F.when(F.col("race_id") % 13 != 0, F.col("deadline")).alias("deadline"), F.when(F.col("race_class") != "5-LOW", F.col("race_class")).alias("label"))
    b = b.unionByName(d.where("race_id % 50 = 0").select("race_id", "venue", "deadline", F.col("race_class").alias("label")))
    return quality.board_defects(b, ["race_id", "venue", "deadline", "label"], "race_id")


_THIRDS = ("field_sum", "spread", "inside_edge")


@R.query(", v AS (SELECT race_id, sum(quantity)::BIGINT AS field_sum, (max(quantity) - min(quantity))::BIGINT AS spread, (6 * max(quantity) FILTER (lane = 1) - sum(quantity))::BIGINT AS inside_edge, (count(*) FILTER (quantity > 40))::BIGINT AS top_count, bool_or(won AND lane = 1) AS hit FROM fields GROUP BY race_id), u AS (" + " UNION ALL ".join(f"SELECT '{n}' AS factor, {n} AS value, hit FROM v" for n in (*_THIRDS, "top_count")) + """), h AS (SELECT factor, value, count(*) AS n, count(*) FILTER (hit) AS hits FROM u GROUP BY ALL),
p AS (SELECT *, CASE WHEN factor = 'top_count' THEN value ELSE 1 + (3 * (sum(n) OVER (PARTITION BY factor ORDER BY value) - n)) // sum(n) OVER (PARTITION BY factor) END::BIGINT AS part FROM h)
SELECT factor, part, sum(n)::BIGINT AS races, round(sum(hits) / sum(n), 9) AS inside_wins FROM p GROUP BY ALL""")
def field_thirds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often lane 1 wins by third of the field's sum, spread and inside edge, and by the number of top racers.

    Values are whole and few, so thirds are cut on counts by value: equal values share a third, and no window has all races."""
    x = full_fields(spark, sf_dir).withColumn("quantity", F.col("quantity").cast("long"))
    total = F.sum("quantity")
    v = x.groupBy("race_id").agg(total.alias("field_sum"), (F.max("quantity") - F.min("quantity")).alias("spread"), (6 * F.max(F.when(F.col("lane") == 1, F.col("quantity"))) - total).alias("inside_edge"), F.count_if(F.col("quantity") > 40).alias("top_count"), F.bool_or(F.col("won") & (F.col("lane") == 1)).alias("hit"))
    pairs = [F.struct(F.lit(n).alias("factor"), F.col(n).alias("value")) for n in (*_THIRDS, "top_count")]
    h = v.select("hit", F.inline(F.array(*pairs))).groupBy("factor", "value").agg(F.count(F.lit(1)).alias("n"), F.count_if("hit").alias("hits"))
    w = Window.partitionBy("factor")
    below = F.sum("n").over(w.orderBy("value")) - F.col("n")
    part = F.when(F.col("factor") == "top_count", F.col("value")).otherwise(1 + F.floor(3 * below / F.sum("n").over(w)))
    return h.withColumn("part", part).groupBy("factor", "part").agg(F.sum("n").alias("races"), r9(F.sum("hits") / F.sum("n")).alias("inside_wins"))


@R.query(""", s AS (SELECT race_id, venue, lane, won, date_trunc('month', race_date)::DATE AS m FROM fields), k AS (SELECT m AS fold, (m - INTERVAL 1 MONTH)::DATE AS calib FROM (SELECT m, row_number() OVER (ORDER BY m) AS nth FROM (SELECT DISTINCT m FROM s)) WHERE nth > 13),
w AS (SELECT fold, venue, lane, count(*) FILTER (won) AS w FROM s JOIN k ON m < calib GROUP BY ALL), t AS (SELECT fold, venue, sum(w) AS t FROM w GROUP BY ALL),
a AS (SELECT k.fold, m = k.fold AS test, race_id, s.lane, won, (coalesce(w, 0) + 1) / (coalesce(t, 0) + 6) AS p FROM s JOIN k ON m = k.fold OR m = k.calib LEFT JOIN w ON w.fold = k.fold AND w.venue = s.venue AND w.lane = s.lane LEFT JOIN t ON t.fold = k.fold AND t.venue = s.venue),
x AS (SELECT *, row_number() OVER (PARTITION BY fold, race_id ORDER BY p DESC, lane) AS n, max(p) OVER (PARTITION BY fold, race_id) AS top FROM a),
c AS (SELECT fold, least(floor(p * 10), 9)::INT AS bin, avg(won::INT) AS v FROM x WHERE NOT test AND n = 1 GROUP BY ALL),
y AS (SELECT x.*, coalesce(v, (least(floor(top * 10), 9) + 0.5) / 10) AS v, sum(CASE WHEN n > 1 THEN p ELSE 0 END) OVER (PARTITION BY x.fold, race_id) AS rest FROM x LEFT JOIN c ON c.fold = x.fold AND c.bin = least(floor(top * 10), 9)::INT WHERE test)
SELECT fold AS month, count(*) AS races, round(avg(-ln(greatest(p, 1e-12))), 6) AS raw, round(avg(-ln(greatest(CASE WHEN n = 1 THEN v ELSE p / rest * (1 - v) END, 1e-12))), 6) AS calibrated FROM y WHERE won GROUP BY fold""")
def calibration_walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By test month: loss of lane rates by venue learned before the month before it, raw and calibrated on that month.

    Wins are summed once a month; a race belongs to two folds at most."""
    s = full_fields(spark, sf_dir).select("race_id", "venue", "lane", "won", F.trunc("race_date", "month").alias("m"))
    k = folds.monthly_folds(s, "m", 13).select(F.col("test_start").alias("fold"), F.add_months("test_start", -1).alias("calib"))  # a row a month
    wins = s.where("won").groupBy("venue", "lane", "m").agg(F.count(F.lit(1)).alias("n"))
    w = wins.join(F.broadcast(k), F.col("m") < F.col("calib")).groupBy("fold", "venue", "lane").agg(F.sum("n").alias("w"))
    t = w.groupBy("fold", "venue").agg(F.sum("w").alias("t"))
    use = k.select("fold", F.inline(F.array(F.struct(F.col("fold").alias("m"), F.lit(True).alias("test")), F.struct(F.col("calib").alias("m"), F.lit(False).alias("test")))))
    x = s.join(F.broadcast(use), "m").join(w, ["fold", "venue", "lane"], "left").join(t, ["fold", "venue"], "left")
    x = x.withColumn("p", (F.coalesce("w", F.lit(0)) + 1) / (F.coalesce("t", F.lit(0)) + 6)).select("fold", "test", "race_id", "lane", "won", "p")
    best = x.where("NOT test").groupBy("fold", "race_id").agg(F.max("p").alias("c"), F.max_by("won", F.struct("p", -F.col("lane"))).alias("hit"))
    y = metrics.recalibrate(x.where("test"), ["fold", "race_id"], "p", metrics.calibrator(best, "c", "hit", 10, ["fold"]), 10, ["fold"])
    loss = lambda c: F.round(F.avg(-F.log(F.greatest(F.col(c), F.lit(1e-12)))), 6)
    return y.where("won").groupBy(F.col("fold").alias("month")).agg(F.count(F.lit(1)).alias("races"), loss("p").alias("raw"), loss("p_calibrated").alias("calibrated"))


_RATES = ", r AS (SELECT venue AS page, lane::INT AS number, finish, floor(1000 * count(*) / sum(count(*)) OVER (PARTITION BY venue, lane)) / 10 AS rate FROM fields GROUP BY venue, lane, finish), x AS (SELECT page, number, unnest([1, 2, 3, 4, 5, 6]) AS k FROM (SELECT DISTINCT page, number FROM r)), z AS (SELECT x.page, x.number, k, coalesce(rate, 0) AS rate FROM x LEFT JOIN r ON r.page = x.page AND r.number = x.number AND finish = k)"


@R.query(_RATES + " SELECT page, 'course' AS section, number, k::VARCHAR AS measure, rate, false AS rejected FROM z UNION ALL SELECT page, 'course', number, (['" + "', '".join(pages.TECHNIQUES) + "'])[k], k * 10.5, false FROM z UNION ALL SELECT page, 'lane', number, k::VARCHAR, rate, false FROM z UNION ALL SELECT page, 'spring', number, k::VARCHAR, rate, false FROM z WHERE page % 2 = 0 UNION ALL SELECT DISTINCT page, 'autumn', 1, NULL, NULL::DOUBLE, true FROM z")
def venue_page_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page a venue with its rates by lane; spring for some, an autumn table with a row of too few cells."""
    n = full_fields(spark, sf_dir).groupBy("venue", "lane").agg(F.count(F.lit(1)).alias("t"), *[F.count_if(F.col("finish") == k).alias(f"n{k}") for k in range(1, 7)])
    td = lambda v: F.concat(F.lit("<td>"), v.cast("string"), F.lit("</td>"))
    rates = [td(F.floor(1000 * F.col(f"n{k}") / F.col("t")) / 10) for k in range(1, 7)]
    row = lambda *more: F.concat(F.lit('<tr class="x is-p10-0">'), td(F.col("lane")), *rates, *more, F.lit("</tr>"))
    g = n.groupBy(F.col("venue").alias("page")).agg(_in_order(row(*[td(F.lit(k * 10.5)) for k in range(1, 7)]), "lane").alias("course"), _in_order(row(), "lane").alias("rates"))
    part = lambda heading, body: F.concat(F.lit(f"<span>{heading}</span><p>x</p><table><tr><th>1</th></tr>"), body, F.lit("</table>"))
    heading = {section: h for section, h, _ in pages.VENUE_TABLES}
    html = F.concat(part(heading["course"], F.col("course")), part(heading["lane"], F.col("rates")), F.when(F.col("page") % 2 == 0, part(heading["spring"], F.col("rates"))).otherwise(""), part(heading["autumn"], F.lit('<tr class="is-p10-0"><td>1</td><td>2</td></tr>')))
    return pages.venue_rates(g.select("page", html.alias("html")), "page", "html")


@R.query(" SELECT venue AS page, 'V' || venue AS name, CASE WHEN venue % 2 = 0 THEN n || ' 番' END AS address, 'M' || venue % 3 AS motor, CASE WHEN venue % 2 = 0 THEN '淡水' END AS water_quality, NULL::VARCHAR AS tidal_range, NULL::VARCHAR AS record, strftime(first, '%Y/%m/%d') || '～' AS course_period, CASE WHEN venue % 5 > 0 THEN '～' || strftime(last, '%Y/%m/%d') END AS lane_period FROM (SELECT venue, count(*) AS n, min(race_date) AS first, max(race_date) AS last FROM races GROUP BY venue)")
def venue_page_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page a venue with its name, a memo with an unknown entry, and the periods of its tables; parsed back."""
    g = races(spark, sf_dir).groupBy(F.col("venue").alias("page")).agg(F.count(F.lit(1)).alias("n"), F.min("race_date").alias("first"), F.max("race_date").alias("last"))
    pair = lambda k, v: F.concat(F.lit(f"<dt>{k}</dt><dd>"), v, F.lit("</dd>"))
    even, text = F.col("page") % 2 == 0, lambda c: F.date_format(c, "yyyy/MM/dd")
    memo = F.concat(F.lit('<dl class="list1 is-x">'), F.when(even, pair("所在地", F.concat(F.col("n").cast("string"), F.lit(" <b>番</b>")))).otherwise(""), pair("電話", F.lit("0")), pair("モーター", F.concat(F.lit("M"), (F.col("page") % 3).cast("string"))), F.when(even, pair("水質", F.lit("淡水"))).otherwise(""), F.lit("</dl>"))
    heading = {section: h for section, h, _ in pages.VENUE_TABLES}
    part = lambda section, note: F.concat(F.lit(f"<span>{heading[section]}</span><table><tr><td>1</td></tr></table>"), note)
    note = lambda v: F.concat(F.lit('<p class="h-alignR">'), v, F.lit("</p>"))
    html = F.concat(F.lit('<span class="heading1_mainLabel"> V'), F.col("page").cast("string"), F.lit("</span>"), memo, part("course", note(F.concat(text("first"), F.lit("～")))), part("lane", F.when(F.col("page") % 5 > 0, note(F.concat(F.lit("～"), text("last")))).otherwise("")))
    return pages.venue_profiles(g.select("page", html.alias("html")), "page", "html")
