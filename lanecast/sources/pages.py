"""HTML elements and JSON feeds to rows."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from lanecast.functions import text
from lanecast.sources import grids as of_grids


def table_cells(pages: DataFrame, key: str, html: str, heading: str | None = None) -> DataFrame:
    """key, table_no, row_no, col_no, cell of flat tables, tags stripped; only after a heading if one is given."""
    h = F.col(html) if heading is None else F.element_at(F.split(html, heading, 2), -1)
    t = pages.select(key, F.posexplode(F.regexp_extract_all(h, F.lit(r"(?is)<table\b.*?</table>"), F.lit(0))).alias("table_no", "t"))
    r = t.select(key, "table_no", F.posexplode(F.regexp_extract_all("t", F.lit(r"(?is)<tr\b.*?</tr>"), F.lit(0))).alias("row_no", "r"))
    c = r.select(key, "table_no", "row_no", F.posexplode(F.regexp_extract_all("r", F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>"), F.lit(1))).alias("col_no", "c"))
    return c.select(key, "table_no", "row_no", "col_no", F.trim(F.regexp_replace("c", r"(?s)<[^>]*>", "")).alias("cell"))


def elements(pages: DataFrame, key: str, html: str, tag: str) -> DataFrame:
    """key, nth, body of every element of a tag without nesting of its own kind."""
    rx = F.lit(rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>")
    return pages.select(key, F.posexplode(F.regexp_extract_all(html, rx, F.lit(1))).alias("nth", "body")).withColumn("body", F.trim(F.regexp_replace("body", r"(?s)<[^>]*>", "")))


def grids(cells: DataFrame) -> DataFrame:
    """Cells (page, row_no, col_no, cell) to a row a page: page, grid, the page's rows in order as struct<row_no, v>, v by column."""
    one = cells.groupBy("page", "row_no", "col_no").agg(F.max("cell").alias("cell"))
    of = F.map_from_entries(F.collect_list(F.struct("col_no", "cell")))
    v = F.transform(F.sequence(F.lit(0), F.max("col_no").cast("int")), lambda k: F.try_element_at(of, k))
    rows = one.withColumn("col_no", F.col("col_no").cast("int")).groupBy("page", F.col("row_no").cast("int").alias("row_no")).agg(v.alias("v"))
    return rows.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("row_no", "v"))).alias("grid"))  # a page's rows


def _entries(cells: DataFrame, odds, ordered: bool) -> DataFrame:
    """page, combination, odds of the pages' grids; odds: a function of the module grids."""
    d = grids(cells)

    def read(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, of_grids.PAGES):
                some = batch.slice(lo, of_grids.PAGES)
                page, lanes, found = odds(some.column("grid"), ordered)
                yield pa.RecordBatch.from_arrays([some.column("page").take(pa.array(page)), of_grids.combinations(lanes), pa.array(found)], names=["page", "combination", "odds"])

    return d.mapInArrow(read, StructType([d.schema["page"], StructField("combination", StringType()), StructField("odds", DoubleType())]))


def pair_grid(cells: DataFrame, ordered: bool) -> DataFrame:
    """page, combination, odds by grids.pair_odds. cells: page, row_no, col_no, cell; row 0 is the header."""
    return _entries(cells, of_grids.pair_odds, ordered)


def triple_grid(cells: DataFrame, ordered: bool) -> DataFrame:
    """page, combination, odds by grids.triple_odds."""
    return _entries(cells, of_grids.triple_odds, ordered)


# fixed values: a reading's data column in rows of 17 and of 20 data columns
DAILY_WEATHER = {
    "precipitation_total_mm": (0, 2), "precipitation_max_1h_mm": (1, 3), "precipitation_max_10min_mm": (2, 4),
    "temperature_avg_c": (3, 5), "temperature_max_c": (4, 6), "temperature_min_c": (5, 7),
    "humidity_avg_pct": (6, 8), "humidity_min_pct": (7, 9),
    "wind_avg_ms": (8, 10), "wind_max_ms": (9, 11), "wind_max_direction": (10, 12), "wind_max_instant_ms": (11, 13), "wind_max_instant_direction": (12, 14), "wind_prevailing_direction": (13, None),
    "sunshine_hours": (14, 15),
}


def daily_weather(cells: DataFrame) -> DataFrame:
    """page, day, rejected and the readings of rows whose first cell is a day; their data cells number 17 or 20, other counts reject and
    have none. Marks of missing values are null, a trailing ")" goes from numbers."""
    of_row = F.array_sort(F.collect_list(F.struct("col_no", F.trim("cell").alias("v"))))  # a row's few cells
    d = cells.groupBy("page", "row_no").agg(F.transform(of_row, lambda s: s["v"]).alias("v")).where(F.get("v", F.lit(0)).rlike("^[0-9]+$"))
    n = F.size("v") - 1

    def reading(name: str) -> Column:
        short, long = DAILY_WEATHER[name]
        at = lambda k: F.lit(None) if k is None else F.get("v", F.lit(k + 1))
        cell = F.when(n == 17, at(short)).when(n == 20, at(long))
        if name.endswith("_direction"):
            return F.when(~cell.isin("///", "--", ""), cell)
        return F.trim(F.regexp_replace(cell, r"\)+$", "")).try_cast("double")

    return d.select("page", F.get("v", F.lit(0)).try_cast("int").alias("day"), (~n.isin(17, 20)).alias("rejected"), *[reading(name).alias(name) for name in DAILY_WEATHER])


def previews(feed: DataFrame, column: str = "value") -> DataFrame:
    """A JSON feed whose boats are a list or an object keyed by lane, to one row a boat."""
    boat = "struct<racer_boat_number:int,racer_course_number:int,racer_start_timing:double,racer_exhibition_time:double,racer_tilt_adjustment:double>"
    shape = lambda boats: f"struct<previews:array<struct<date:string,stadium_number:int,number:int,boats:{boats}>>>"

    def rows(boats: str, as_list):
        p = feed.select(F.explode(F.from_json(column, shape(boats))["previews"]).alias("p"))
        return p.select("p.date", "p.stadium_number", "p.number", F.explode(as_list(F.col("p.boats"))).alias("b"))

    listed = rows(f"array<{boat}>", lambda b: b)
    keyed = rows(f"map<string,{boat}>", F.map_values)
    d = listed.unionByName(keyed).where("stadium_number BETWEEN 1 AND 24")
    lane, start = F.col("b.racer_boat_number"), F.col("b.racer_start_timing")
    return d.select("date", F.col("stadium_number").alias("venue"), "number", lane.alias("lane"), F.coalesce("b.racer_course_number", lane).alias("course"), F.abs(start).alias("start_timing"), (start < 0).alias("flying"), F.col("b.racer_exhibition_time").alias("exhibition_time"), F.col("b.racer_tilt_adjustment").alias("tilt"), F.lit("openapi:unlabelled").alias("label"))


def _inner(html, tag: str):
    """Bodies of a tag's elements, in order."""
    return F.regexp_extract_all(html, F.lit(rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>"), F.lit(1))


def _plain(html):
    return F.trim(F.regexp_replace(F.regexp_replace(html, r"(?s)<[^>]*>", " "), r"[\s ]+", " "))


def _number(value):
    return F.regexp_replace(_plain(value), r"(kg|℃|cm|m)$", "").try_cast("double")


def start_timing(value):
    """".05" is 0.05, "F.05" a flying start of -0.05; else null."""
    t = F.trim(value)
    seconds = F.ltrim(F.regexp_replace(t, "^F+", "")).try_cast("double")
    return F.when(t.startswith("F"), -seconds).otherwise(seconds)


def headed_rows(cells: DataFrame, heading: str) -> DataFrame:
    """page, row_no, v (a row's cells) of the tables that have a cell equal to the heading. cells: as table_cells gives them."""
    d = cells.groupBy("page", "table_no", "row_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("col_no", "cell"))), lambda s: s["cell"]).alias("v"))
    named = F.max(F.array_contains("v", heading)).over(Window.partitionBy("page", "table_no"))
    return d.withColumn("named", named).where("named").select("page", "row_no", "v")


def result_lanes(cells: DataFrame) -> DataFrame:
    """A result page's lanes: page, lane, position, status (of boats without one), registration, race_time, start_timing, and
    has_result: whether any lane of the page has a position. A page without a result has no such row or has_result false."""
    at = lambda n: F.get("v", F.lit(n))
    parts = F.split(F.concat_ws(" ", "v"), r"\s+")  # the winner's technique may follow its timing
    starts = headed_rows(cells, "スタート情報").select("page", F.get(parts, F.lit(0)).try_cast("int").alias("lane"), start_timing(F.get(parts, F.lit(1))).alias("start_timing")).where("lane IS NOT NULL")
    position = F.translate(F.trim(at(0)), "１２３４５６", "123456").try_cast("int")
    d = headed_rows(cells, "着").select("page", at(1).try_cast("int").alias("lane"), position.alias("position"), F.when(position.isNull(), F.nullif(F.trim(at(0)), F.lit(""))).alias("status"), F.get(F.split(F.trim(at(2)), r"\s+"), F.lit(0)).try_cast("int").alias("registration"), F.trim(at(3)).alias("race_time"))
    d = d.where("lane BETWEEN 1 AND 6").join(starts, ["page", "lane"], "left")
    return d.withColumn("has_result", F.max(F.col("position").isNotNull()).over(Window.partitionBy("page")))


def result_payouts(cells: DataFrame) -> DataFrame:
    """page, bet_type (a label holds until the next), combination, amount, popularity; rows without an amount are left out."""
    at = lambda n: F.get("v", F.lit(n))
    d = headed_rows(cells, "勝式").where(F.size("v") >= 3).where(at(0) != "勝式")
    label = F.last(F.nullif(F.trim(at(0)), F.lit("")), ignorenulls=True).over(Window.partitionBy("page").orderBy("row_no"))
    d = d.select("page", label.alias("bet_type"), F.regexp_replace(at(1), " ", "").alias("combination"), F.regexp_replace(at(2), r"[¥￥,\s]", "").try_cast("int").alias("amount"), at(3).try_cast("int").alias("popularity"))
    return d.where("bet_type IS NOT NULL AND combination <> '' AND amount IS NOT NULL")


def result_technique(cells: DataFrame) -> DataFrame:
    """page, technique: the first other cell of the table under its heading."""
    heading = "決まり手"
    d = headed_rows(cells, heading).select("page", "row_no", F.posexplode("v").alias("col_no", "cell")).where((F.col("cell") != "") & (F.col("cell") != heading))
    return d.groupBy("page").agg(F.min_by("cell", F.struct("row_no", "col_no")).alias("technique"))


def pre_race_boats(pages: DataFrame, key: str, html: str) -> DataFrame:
    """A pre-race page's boats, one a table body of at least three rows and eight cells in the first; the first cell of
    the third row is the ballast. Bodies without a lane number are left out."""
    bodies = pages.select(key, F.explode(_inner(F.col(html), "tbody")).alias("b")).select(key, _inner(F.col("b"), "tr").alias("r"))
    d = bodies.where("size(r) >= 3").select(key, _inner(F.get("r", F.lit(0)), "td").alias("h"), _inner(F.get("r", F.lit(2)), "td").alias("third")).where("size(h) >= 8")
    at = lambda n: F.get("h", F.lit(n))
    items = F.filter(F.transform(_inner(at(7), "li"), _plain), lambda x: x != "")
    whole = _plain(at(7))
    parts = F.when(F.size(items) > 0, items).when(whole != "", F.array(whole)).otherwise(F.array().cast("array<string>"))
    return d.select(key, _plain(at(0)).try_cast("int").alias("lane"), F.regexp_extract(F.concat(at(1), at(2)), r"toban=(\d+)", 1).try_cast("int").alias("registration"), _plain(at(2)).alias("name"), _number(at(3)).alias("weight"), _number(F.get("third", F.lit(0))).alias("ballast"), _number(at(4)).alias("exhibition_time"), _number(at(5)).alias("tilt"), (_plain(at(6)) != "").alias("propeller_changed"), parts.alias("parts")).where("lane IS NOT NULL")


def start_exhibition(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, course, lane, start_timing: the n-th row that names a boat is course n; header rows don't count."""
    number, time = (rf'(?is)<span\b[^>]*table1_boatImage1{x}\b[^>]*>\s*([^<]*?)\s*</span>' for x in ("Number", "Time"))
    rows = F.filter(_inner(F.col(html), "tr"), lambda r: F.regexp_extract(r, number, 1).rlike("^[0-9]+$"))
    d = pages.select(key, F.posexplode(rows).alias("nth", "r"))
    timing = text.start_timing(F.regexp_extract("r", time, 1))  # a magnitude and a flag; only result pages have a sign
    return d.select(key, (F.col("nth") + 1).alias("course"), F.regexp_extract("r", number, 1).cast("int").alias("lane"), timing["seconds"].alias("start_timing"), timing["flying"].alias("flying"))


SURFACE_TITLE = "水面気象情報"  # fixed value: what stands before the label


def surface(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, the readings of the weather units, the codes of the wind's and the weather's pictures, the weather's name, the title's label and the
    earlier race it names; what a page lacks is null. Pages without a weather block have no row."""
    d = pages.where(F.coalesce(F.col(html), F.lit("")).rlike(r"(?i)<div\b[^>]*\bweather1_body\b"))
    inside = lambda unit, rx: F.nullif(F.regexp_extract(html, rf'(?is)<div\b[^>]*\b{unit}\b(?![-\w])[^>]*>(?:(?!</div>).)*?{rx}', 1), F.lit(""))
    of = lambda unit: inside(unit, r'LabelData\b[^>]*>\s*([^<]*?)\s*<')
    picture = lambda unit, name: inside(unit, rf'<p\b[^>]*\bweather1_bodyUnitImage\b[^>]*\b{name}(\d+)\b').try_cast("int")
    units = {"air_temperature": "is-direction", "water_temperature": "is-waterTemperature", "wind_speed": "is-wind", "wave_height": "is-wave"}
    title = F.regexp_replace(_plain(F.regexp_extract(html, r'(?is)<p\b[^>]*\bweather1_title\b[^>]*>(.*?)</p>', 1)), SURFACE_TITLE, "")
    label = F.trim(F.translate(title, "　", " "))
    race = F.regexp_extract(label, r"^(\d{1,2})R時点$", 1).try_cast("int")
    return d.select(key, *[_number(of(unit)).alias(name) for name, unit in units.items()], picture("is-windDirection", "is-wind").alias("wind_direction"), picture("is-weather", "is-weather").alias("weather_code"), inside("is-weather", r'LabelTitle\b[^>]*>\s*([^<]*?)\s*<').alias("weather"), label.alias("label"), race.alias("reference_race"))


# fixed values: techniques in the order of their columns, headings of a venue page's tables
TECHNIQUES = ("nige", "makuri", "sashi", "makuri_sashi", "nuki", "megumare")
VENUE_TABLES = (("course", "コース別入着率＆決まり手", 13), ("lane", "枠番別コース取得率", 7), ("spring", "春季", 7), ("summer", "夏季", 7), ("autumn", "秋季", 7), ("winter", "冬季", 7))


def venue_rates(pages: DataFrame, key: str, html: str) -> DataFrame:
    """A venue page's rates in long form: key, section, number (course, or lane in section lane), measure, rate, rejected.
    Measures are places or courses 1 to 6, and techniques. A row of another number of cells has rejected true and no measure; a
    table that the page lacks gives no row."""
    tables = []
    for section, heading, cells in VENUE_TABLES:
        after = F.regexp_extract(html, rf"(?is)<span\b[^>]*>\s*{heading}\s*</span>.*?(<table\b.*?</table>)", 1)
        rows = F.regexp_extract_all(after, F.lit(r'(?is)<tr\b[^>]*\bis-p10-0\b[^>]*>(.*?)</tr>'), F.lit(1))
        tables.append(F.struct(F.lit(section).alias("section"), F.lit(cells).alias("cells"), rows.alias("rows")))
    d = pages.select(key, F.inline(F.array(*tables))).select(key, "section", "cells", F.explode("rows").alias("r"))
    d = d.withColumn("v", F.transform(_inner(F.col("r"), "td"), lambda c: _number(c))).withColumn("rejected", F.size("v") != F.col("cells"))
    names = F.array(*[F.lit(str(n)) for n in range(1, 7)], *[F.lit(t) for t in TECHNIQUES])
    pairs = F.when(~F.col("rejected"), F.arrays_zip(F.slice(names, F.lit(1), F.col("cells") - 1).alias("measure"), F.slice("v", F.lit(2), F.col("cells") - 1).alias("rate")))
    return d.select(key, "section", F.get("v", F.lit(0)).cast("int").alias("number"), "rejected", F.inline_outer(pairs))


# fixed values: the memo's headings
VENUE_MEMO = {"address": "所在地", "motor": "モーター", "water_quality": "水質", "tidal_range": "干満差", "record": "レコード"}


def venue_profiles(pages: DataFrame, key: str, html: str) -> DataFrame:
    """A venue page's name, the memo's entries, and the periods noted after the course and the lane table; what a page lacks is null, a page
    without a name has no row."""
    name = _plain(F.regexp_extract(html, r'(?is)<span\b[^>]*\bheading1_mainLabel\b[^>]*>(.*?)</span>', 1))
    memo = F.regexp_extract(html, r'(?is)<dl\b[^>]*\blist1\b[^>]*>(.*?)</dl>', 1)
    pairs = F.arrays_zip(F.transform(_inner(memo, "dt"), _plain).alias("k"), F.transform(_inner(memo, "dd"), _plain).alias("v"))
    entry = lambda heading: F.get(F.filter(pairs, lambda x: x["k"] == heading), F.lit(0))["v"]
    note = lambda heading: F.nullif(_plain(F.regexp_extract(html, rf'(?is)<span\b[^>]*>\s*{heading}\s*</span>.*?</table>.*?<p\b[^>]*\bh-alignR\b[^>]*>(.*?)</p>', 1)), F.lit(""))
    headings = {section: h for section, h, _ in VENUE_TABLES}
    d = pages.select(key, name.alias("name"), *[entry(h).alias(n) for n, h in VENUE_MEMO.items()], note(headings["course"]).alias("course_period"), note(headings["lane"]).alias("lane_period"))
    return d.where("name <> ''")
