"""Awkward pages, links, mirror rows and board rows."""

from pyspark.sql import functions as F

from lanecast.operators import quality
from lanecast.sources import ledgers, pages


def test_result_page(spark):
    page = """<table><tr><th>着</th><th>枠</th></tr><tr><td>１</td><td>2</td><td>4001 名</td><td>1'50</td></tr><tr><td>Ｆ</td><td>1</td><td>4002 名</td><td></td></tr><tr><td>２</td><td>7</td><td>x</td></tr></table>
<table><tr><th>スタート情報</th></tr><tr><td>2 .05   逃げ</td></tr><tr><td>1 F.01</td></tr></table>
<table><tr><th>勝式</th></tr><tr><td>単勝</td><td>2</td><td>¥1,230</td><td>4</td></tr><tr><td></td><td>2 - 1</td><td>￥90</td><td></td></tr><tr><td>複勝</td><td></td><td>¥10</td></tr></table>
<table><tr><td>決まり手</td></tr><tr><td></td><td>差し</td></tr></table>"""
    d = spark.createDataFrame([(1, page), (2, "<p>no race</p>"), (3, None)], "page int, html string")
    cells = pages.table_cells(d, "page", "html")
    lanes = {r["lane"]: r for r in pages.result_lanes(cells).collect()}
    assert sorted(lanes) == [1, 2]
    assert (lanes[2]["position"], lanes[2]["status"], lanes[2]["registration"], lanes[2]["start_timing"], lanes[2]["has_result"]) == (1, None, 4001, 0.05, True)
    assert (lanes[1]["position"], lanes[1]["status"], lanes[1]["start_timing"]) == (None, "Ｆ", -0.01)
    paid = {(r["bet_type"], r["combination"]): (r["amount"], r["popularity"]) for r in pages.result_payouts(cells).collect()}
    assert paid == {("単勝", "2"): (1230, 4), ("単勝", "2-1"): (90, None)}
    assert [tuple(r) for r in pages.result_technique(cells).collect()] == [(1, "差し")]


def test_start_exhibition_counts_boats_only(spark):
    row = '<tr><td><span class="table1_boatImage1Number is-x">{}</span><span class="table1_boatImage1Time">{}</span></td></tr>'
    d = spark.createDataFrame([(1, "<tr><th>a</th></tr><tr><th>b</th></tr>" + row.format(3, ".12") + row.format(1, "F.02") + row.format("", ".1")), (2, "")], "page int, html string")
    got = sorted(tuple(r) for r in pages.start_exhibition(d, "page", "html").collect())
    assert got == [(1, 1, 3, 0.12, False), (1, 2, 1, 0.02, True)]


def test_mirror_fill_counts_races(spark):
    schedule = spark.sql("SELECT * FROM VALUES (1, 5, DATE '2024-01-01', 1, TIMESTAMP '2024-01-01 10:00:00'), (2, 5, DATE '2024-01-01', 2, NULL), (3, 5, DATE '2024-01-01', 3, TIMESTAMP '2024-01-01 11:00:00') AS t(race_id, venue, day, number, deadline)")
    feed = spark.sql("SELECT 5 AS venue, DATE '2024-01-01' AS day, number, lane, IF(lane = 1, NULL, 6.8) AS exhibition_time FROM (SELECT explode(array(1, 2, 3, 9)) AS number) CROSS JOIN (SELECT explode(array(1, 2)) AS lane)")
    added, counts = ledgers.mirror_fill(feed, schedule, schedule.where("race_id = 3"))
    assert {r["outcome"]: r["races"] for r in counts.collect()} == {"added": 1, "no_deadline": 1, "existing": 1, "unmatched": 1}
    assert added.count() == 2 and added.where(F.col("observed_at").isNull() | F.col("parts_changed").isNotNull()).count() == 0


def test_board_defects(spark):
    board = spark.createDataFrame([(1, "a"), (1, None), (None, "b")], "race_id int, label string")
    got = {(r["defect"], r["field"]): r["n"] for r in quality.board_defects(board, ["race_id", "label"], "race_id").collect()}
    assert got == {("missing", "race_id"): 1, ("missing", "label"): 1, ("duplicate", "race_id"): 1}


def test_venue_rows_of_another_width_are_rejected(spark):
    row = lambda *v: '<tr class="is-p10-0">' + "".join(f"<td>{x}</td>" for x in v) + "</tr>"
    html = "<span>春季</span><table>" + row(1, 10, 20, 30, 20, 10, 10) + row(2, 1) + "</table>"
    d = pages.venue_rates(spark.createDataFrame([(1, html), (2, "")], "page int, html string"), "page", "html")
    rows = [(r["section"], r["number"], r["rejected"], r["measure"], r["rate"]) for r in d.collect()]
    assert sorted(r[3:] for r in rows if not r[2]) == [("1", 10.0), ("2", 20.0), ("3", 30.0), ("4", 20.0), ("5", 10.0), ("6", 10.0)]
    assert [r for r in rows if r[2]] == [("spring", 2, True, None, None)]


def test_surface_and_profiles(spark):
    unit = '<div class="weather1_bodyUnit {}"><p class="weather1_bodyUnitImage {}"></p><div class="weather1_bodyUnitLabel"><span class="weather1_bodyUnitLabelTitle">{}</span><span class="weather1_bodyUnitLabelData">{}</span></div></div>'
    page = '<p class="weather1_title">水面気象情報　 5R時点</p><div class="weather1_body">' + unit.format("is-direction", "is-direction3", "気温", "21.0℃") + unit.format("is-weather", "is-weather2", "曇り", "") + unit.format("is-wind", "", "風速", "4m") + unit.format("is-windDirection", "is-wind11", "", "") + unit.format("is-wave", "", "波高", "-") + "</div>"
    d = spark.createDataFrame([(1, page), (2, '<div class="weather1_body"></div>'), (3, "<p>no race</p>"), (4, None)], "page int, html string")
    got = {r["page"]: r for r in pages.surface(d, "page", "html").collect()}
    assert sorted(got) == [1, 2] and got[2]["label"] == "" and got[2]["weather"] is None and got[2]["wind_direction"] is None
    assert tuple(got[1]) == (1, 21.0, None, 4.0, None, 11, 2, "曇り", "5R時点", 5)
    venue = '<span class="heading1_mainLabel">戸田</span><dl class="list1"><dt>所在地</dt><dd>埼玉</dd><dt>干満差</dt><dd>なし</dd></dl><span>コース別入着率＆決まり手</span><table></table><p class="h-alignR">集計期間</p>'
    d = spark.createDataFrame([(1, venue), (2, ""), (3, None)], "page int, html string")
    assert [tuple(r) for r in pages.venue_profiles(d, "page", "html").collect()] == [(1, "戸田", "埼玉", None, None, "なし", None, "集計期間", None)]
