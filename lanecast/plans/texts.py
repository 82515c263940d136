"""Text files: lines that Spark writes from the supplied tables, parsed back to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lanecast.plans.contest import full_fields, table
from lanecast.plans.registry import Registry
from lanecast.sources import ledgers, lines

R = Registry()
QUERIES, SQL = R.QUERIES, R.SQL

_NUMBERED = """, n AS (SELECT race_id, row_number() OVER (PARTITION BY venue, race_date ORDER BY race_id) AS number FROM (SELECT DISTINCT race_id, venue, race_date FROM fields)),
x AS (SELECT f.*, n.number, lpad((venue + 1)::VARCHAR, 2, '0') AS section, race_date::VARCHAR AS path, (venue + day(race_date)) % 11 = 0 AS pending, (venue + day(race_date)) % 11 <> 0 AND (venue + day(race_date)) % 13 = 0 AS off FROM fields f JOIN n USING (race_id))"""


def _wide(c: Column) -> Column:
    return F.translate(c.cast("string"), "0123456789", "０１２３４５６７８９")


def _cell(c: Column, n: int) -> Column:
    return F.lpad(c.cast("string"), n, " ")


def _joined(rows: Column, *order: str) -> Column:
    """A race's, a section's or a day's lines in order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, rows.alias("rows")))), lambda s: s["rows"]), "\n")


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = full_fields(spark, sf_dir)
    n = d.select("race_id", "venue", "race_date").distinct().withColumn("number", F.row_number().over(Window.partitionBy("venue", "race_date").orderBy("race_id")))
    k = F.col("venue") + F.dayofmonth("race_date")
    return d.join(n.select("race_id", "number"), "race_id").withColumn("section", F.lpad((F.col("venue") + 1).cast("string"), 2, "0")).withColumn("pending", k % 11 == 0).withColumn("off", (k % 11 != 0) & (k % 13 == 0))


def _files(races: DataFrame, kind: str, head: Column, body: Column) -> DataFrame:
    """path, part, line_no, line of a file a day, in a part a section, so that no task holds a whole day. races: race_date, section, pending, off, number, rows."""
    s = races.groupBy("race_date", "section", "pending", "off").agg(_joined(F.col("rows"), "number").alias("races"))
    text = F.concat_ws("\n", F.concat("section", F.lit(f"{kind}BGN")), head, body, F.concat("section", F.lit(f"{kind}END")))
    f = s.select(F.col("race_date").cast("string").alias("path"), F.col("section").alias("part"), text.alias("value"))
    return lines.numbered_lines(f, "value", "path", "part")


def card_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth section or so is pending or called off; the entry with the greatest quantity has no weight, so is none."""
    d = _numbered(spark, sf_dir)
    two = lambda c, n: F.lpad(F.format_string("%.2f", c.cast("double")), n, " ")
    label = F.element_at(F.array(*map(F.lit, ("A1", "A2", "B1", "B2"))), (F.col("racer") % 4 + 1).cast("int"))
    weight = F.when(F.col("quantity") < 50, (45 + F.col("part") % 15).cast("string")).otherwise("??")
    entry = F.concat(
        _cell(F.col("lane"), 1), F.lit(" "), F.lpad((F.col("racer") % 10000).cast("string"), 4, "0"), F.lit("名前　　"), _cell(18 + F.col("racer") % 40, 2), F.lit("東京"), weight, label, F.lit(" "), two(F.col("rate"), 4), F.lit(" "), two(F.col("disc") * 500, 5), F.lit(" "),
        two(F.col("tax") * 100, 4), F.lit(" "), two(F.col("lane") * 7.5, 5), F.lit(" "), _cell(F.col("race_id") % 90 + 10, 2), F.lit(" "), two(F.col("lane") * 10.25, 5), F.lit(" "), _cell(F.col("race_id") % 80 + 10, 2), F.lit(" "), two(F.lit(33.5), 5), F.lit(" F1 L0        1"),
    )
    head = F.concat(_wide(F.col("number")), F.lit("Ｒ　"), "race_class", F.lit("　　　Ｈ１８００ｍ　電話投票締切予定"), _wide(8 + F.col("number") % 12), F.lit("：０５"))
    races = d.groupBy("race_date", "section", "pending", "off", "number", head.alias("head")).agg(_joined(entry, "lane").alias("entries")).withColumn("rows", F.concat_ws("\n", "head", "entries"))
    day = lambda f: F.date_format("race_date", f)
    banner = F.concat(F.lit("第"), _wide(F.dayofmonth("race_date") % 7 + 1), F.lit("日　"), _wide(day("yyyy")), F.lit("年　"), _wide(day("M")), F.lit("月 "), _wide(day("d")), F.lit("日　　ボートレース"))
    programme = F.concat(F.lit("ボートレース\n　　＊＊＊　番組表　＊＊＊\n\n  杯 "), "section", F.lit("  \n\n"), banner)
    return _files(races, "B", F.when(~F.col("pending"), programme), F.when(F.col("pending"), f"この場のデータ更新は、いま{lines.PENDING}。").when(F.col("off"), f"{lines.CALLED_OFF}。").otherwise(F.col("races")))


@R.query(_NUMBERED + """ SELECT path, section, number AS race_number, race_class, 1800 AS distance, lpad((8 + number % 12)::VARCHAR, 2, '0') || ':05' AS clock, lane, racer % 10000 AS registration, '名前' AS name, 18 + racer % 40 AS age, '東京' AS branch, 45 + part % 15 AS weight, ['A1', 'A2', 'B1', 'B2'][racer % 4 + 1] AS class,
  round(rate, 2) AS national_win, round(disc * 500, 2) AS national_second, round(tax * 100, 2) AS local_win, lane * 7.5::DOUBLE AS local_second, race_id % 90 + 10 AS motor, lane * 10.25::DOUBLE AS motor_second, race_id % 80 + 10 AS boat, 33.5::DOUBLE AS boat_second, 'F1 L0        1' AS trailing FROM x WHERE NOT pending AND NOT off AND quantity < 50""")
def card_text_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.card_rows(card_lines(spark, sf_dir))


@R.query(_NUMBERED + " SELECT path, section, CASE WHEN NOT pending THEN day(race_date) % 7 + 1 END::INT AS series_day, CASE WHEN NOT pending THEN race_date END AS race_date, CASE WHEN NOT pending THEN '杯 ' || section END AS title, CASE WHEN pending OR off THEN 0 ELSE count(DISTINCT number) END AS races, pending AS data_pending, off AS is_cancelled, true AS explained FROM x GROUP BY path, section, race_date, pending, off")
def card_text_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections with their banner and title, and why some have no race."""
    return lines.card_days(card_lines(spark, sf_dir))


TECHNIQUES = {"1-URGENT": "逃げ", "2-HIGH": "差し", "3-MEDIUM": "まくり"}


def result_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventeenth race is cancelled; boats of little quantity don't finish."""
    d = _numbered(spark, sf_dir).withColumn("cancelled", F.col("race_id") % 17 == 0)
    place = F.when(F.col("quantity") > 2, F.lpad(F.col("finish").cast("string"), 2, "0")).when(F.col("quantity") > 1, "K0").otherwise("F")
    start = F.when(F.col("quantity") > 1, F.format_string("%.2f", F.col("disc"))).otherwise(F.concat(F.lit("F"), F.format_string("%.2f", F.col("disc"))))
    entry = F.concat_ws("  ", F.lit(""), place, "lane", F.lpad((F.col("racer") % 10000).cast("string"), 4, "0"), F.lit("名　前"), F.col("race_id") % 90, F.col("race_id") % 80, F.lit("6.75"), 7 - F.col("lane"), start, F.when(F.col("quantity") > 2, "1.50.1").otherwise(".  ."))
    of = lambda k, c="lane": F.max(F.when(F.col("finish") == k, F.col(c)))
    races = d.groupBy("race_date", "section", "pending", "off", "number", "race_class", "race_id", "cancelled").agg(_joined(entry, "finish").alias("entries"), of(1).alias("a"), of(2).alias("b"), of(3).alias("c"), of(1, "price").cast("long").alias("amount"))
    technique = F.create_map(*[F.lit(x) for kv in TECHNIQUES.items() for x in kv])[F.col("race_class")]
    head = F.concat(_cell(F.col("number"), 4), F.lit("R  "), "race_class", F.when(F.col("cancelled"), F.lit("  中　止")).otherwise(""))
    columns = F.concat(F.lit("  着 艇 登番 　選　手　名　　ﾓｰﾀｰ ﾎﾞｰﾄ 展示 進入 ｽﾀｰﾄﾀｲﾐﾝｸ ﾚｰｽﾀｲﾑ "), F.coalesce(technique, F.lit("")))
    paid = F.concat(
        F.lit("        単勝     "), "a", F.lit("          "), "amount", F.lit("\n        複勝     "), "a", F.lit("   100  "), "b", F.lit("   特払い\n        ２連単   "), "a", F.lit("-"), "b", F.lit("     "), F.col("amount") * 2, F.lit("  人気     "), F.col("race_id") % 30 + 1,
        F.lit(" \n        拡連複   "), "a", F.lit("-"), "b", F.lit("  150  人気  1\n                 "), "a", F.lit("-"), "c", F.lit("  250  人気 "),
    )
    races = races.withColumn("rows", F.when(F.col("cancelled"), head).otherwise(F.concat_ws("\n", head, F.lit("  --------"), columns, "entries", F.lit(""), paid)))
    return _files(races, "K", F.lit("ボートレース"), F.col("races"))


@R.query(_NUMBERED + """ SELECT path, section, number AS race_number, CASE WHEN quantity > 2 THEN finish END AS finish, CASE WHEN quantity > 2 THEN '0' || finish WHEN quantity > 1 THEN 'K0' ELSE 'F' END AS status, lane, racer % 10000 AS registration, '名　前' AS name, race_id % 90 AS motor, race_id % 80 AS boat, 6.75::DOUBLE AS exhibition_time, 7 - lane AS course,
  CASE WHEN quantity > 1 THEN round(disc, 2) END AS start_timing, CASE WHEN quantity > 2 THEN '1.50.1' ELSE '.' END AS race_time FROM x WHERE race_id % 17 <> 0""")
def result_text_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.result_rows(result_lines(spark, sf_dir))


@R.query(_NUMBERED + f" SELECT DISTINCT path, section, number AS race_number, race_id % 17 = 0 AS is_cancelled, CASE WHEN race_id % 17 <> 0 THEN CASE race_class {' '.join(f'''WHEN '{k}' THEN '{v}' ''' for k, v in TECHNIQUES.items())} END END AS technique FROM x")
def result_text_races(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.result_races(result_lines(spark, sf_dir))


@R.query(_NUMBERED + """, w AS (SELECT path, section, number AS race_number, race_id, max(lane) FILTER (finish = 1) AS a, max(lane) FILTER (finish = 2) AS b, max(lane) FILTER (finish = 3) AS c, trunc(max(price) FILTER (finish = 1))::BIGINT AS amount FROM x WHERE race_id % 17 <> 0 GROUP BY ALL)
SELECT path, section, race_number, p.bet_type AS bet_type, p.combination AS combination, p.amount AS amount, p.popularity AS popularity FROM (SELECT path, section, race_number, unnest([{'bet_type': '単勝', 'combination': a::VARCHAR, 'amount': amount, 'popularity': NULL::BIGINT}, {'bet_type': '複勝', 'combination': a::VARCHAR, 'amount': 100, 'popularity': NULL}, {'bet_type': '複勝', 'combination': b::VARCHAR, 'amount': NULL, 'popularity': NULL},
  {'bet_type': '２連単', 'combination': a || '-' || b, 'amount': amount * 2, 'popularity': race_id % 30 + 1}, {'bet_type': '拡連複', 'combination': a || '-' || b, 'amount': 150, 'popularity': 1}, {'bet_type': '拡連複', 'combination': a || '-' || c, 'amount': 250, 'popularity': NULL}]) AS p FROM w)""")
def payout_text_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels hold over the lines below them; a refund has no amount."""
    return lines.payout_rows(result_lines(spark, sf_dir))


def period_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record a supplier, of its counts by line number; some are short, some have an age that is no number."""
    li = table(spark, sf_dir, "lineitem").where("l_linenumber <= 6")
    counts = li.groupBy("l_suppkey").agg(*[F.count_if(F.col("l_linenumber") == k).alias(f"n{k}") for k in range(1, 7)])
    d = table(spark, sf_dir, "supplier").join(counts, F.col("s_suppkey") == F.col("l_suppkey"), "left")
    s = F.col("s_suppkey")
    given = {"registration": s % 10000, "era": F.when(s % 2 == 0, "S").otherwise("H"), "birth": F.concat(F.lpad((s % 60 + 1).cast("string"), 2, "0"), F.when(s % 9 == 0, "0000").otherwise("0228")), "age": F.when(s % 43 == 0, "x9").otherwise("33"), "win_rate": F.when(s % 7 != 0, s % 1000), "since": F.lit("20260101")}
    given |= {f"course{k}_entries": F.coalesce(f"n{k}", F.lit(0)) % 1000 for k in range(1, 7)} | {f"course{k}_place_rate": F.when(F.col(f"n{k}") > 0, s % 1000 + k) for k in range(1, 7)}
    cells = [F.lpad(F.coalesce(given[n].cast("string") if n in given else F.lit("0" if kind == "int" else ""), F.lit("")), w, " ") for n, _, w, kind in lines.period_layout()]
    text = F.concat(*cells)
    d = d.select(s.alias("key"), text.alias("line"))
    return ledgers.stored(d.withColumn("line", F.when(F.col("key") % 41 == 0, F.substring("line", 1, lines.PERIOD_WIDTH - 1)).otherwise(F.col("line"))), "period-lines")


_PERIODS = "WITH c AS (SELECT l_suppkey AS s, l_linenumber AS k, count(*) AS n FROM lineitem WHERE l_linenumber <= 6 GROUP BY ALL), g AS (SELECT s_suppkey AS s, k.range AS k, coalesce(n, 0) AS n FROM supplier CROSS JOIN range(1, 7) k LEFT JOIN c ON c.s = s_suppkey AND c.k = k.range)"


@R.query(_PERIODS + """ SELECT s AS key, s % 10000 AS registration, CASE WHEN s % 9 <> 0 THEN make_date(CASE WHEN s % 2 = 0 THEN 1925 ELSE 1988 END + s % 60 + 1, 2, 28) END AS birth_date, CASE WHEN s % 7 <> 0 THEN s % 1000 / 100 END AS win_rate, DATE '2026-01-01' AS since, k AS course, n % 1000 AS entries, CASE WHEN n > 0 THEN (s % 1000 + k) / 10 END AS place_rate, 0 AS finish1
FROM g WHERE s % 41 <> 0 AND s % 43 <> 0""", base=False)
def period_text_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of 403 characters to a row a course."""
    rows = lines.period_rows(period_lines(spark, sf_dir))[0]
    keep = ["key", "registration", "birth_date", "win_rate", "since"]
    return lines.period_courses(rows, keep).select(*keep, "course", "entries", "place_rate", "finish1")


@R.query("SELECT s_suppkey AS key, CASE WHEN s_suppkey % 41 = 0 THEN 402 ELSE 403 END AS width FROM supplier WHERE s_suppkey % 41 = 0 OR s_suppkey % 43 = 0", base=False)
def period_text_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.period_rows(period_lines(spark, sf_dir))[1].select("key", F.length("line").alias("width"))
