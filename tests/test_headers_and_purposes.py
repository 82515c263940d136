"""Race-card headers keep their whole class; purposes fail closed."""

import pytest
from pyspark.sql import functions as F

from lanecast.operators import quality
from lanecast.sources import lines


def test_class_is_all_up_to_the_distance(spark):
    entry = "1 4444名　前　33東京52A1 6.50 45.00 5.50 40.00 12 30.00 34 31.25 trailing"
    heads = ["1R 準優 勝戦 H1800m 電話投票締切予定10:30", "2R 予選 進入固定 H1800m 締切11:00", "3R予選 H1200m 締切11:30"]
    rows = [("f", k, x) for k, x in enumerate(y for h in heads for y in (h, entry))]
    rows = [("f", -1, "01BBGN"), *rows]
    got = lines.card_rows(spark.createDataFrame(rows, "path string, line_no long, line string")).orderBy("race_number").collect()
    assert [(r["race_number"], r["race_class"], r["distance"], r["clock"]) for r in got] == [(1, "準優 勝戦", 1800, "10:30"), (2, "予選 進入固定", 1800, "11:00"), (3, "予選", 1200, "11:30")]
    one = got[0]
    assert (one["registration"], one["name"], one["age"], one["branch"], one["weight"], one["class"], one["national_win"], one["local_second"], one["motor"], one["boat_second"], one["trailing"]) == (4444, "名 前", 33, "東京", 52, "A1", 6.5, 40.0, 12, 31.25, "trailing")


def table(spark, lines_):
    return spark.createDataFrame([("f", k, x) for k, x in enumerate(lines_)], "path string, line_no long, line string")


def test_card_sections_say_why_they_have_no_race(spark):
    text = ["preamble", "01BBGN", "ボートレース", "＊＊＊　番組表　＊＊＊", "", "  春　の　杯  ", "", "第 ３日  ２０２６年 ６月 １日   ボートレース大 村", "not a title", "１Ｒ　予選　　Ｈ１８００ｍ　電話投票締切予定　９：０５", "bad line", "01BEND"]
    text += ["02BBGN", "この場のデータ更新は、いましばらくお待ちください。", "02BEND", "03BBGN", "番組表", "title only", "開催は中止となりました。", "03BEND", "04BBGN", "04BEND"]
    got = {r["section"]: r for r in lines.card_days(table(spark, text)).collect()}
    assert (got["01"]["series_day"], str(got["01"]["race_date"]), got["01"]["title"], got["01"]["races"], got["01"]["explained"]) == (3, "2026-06-01", "春 の 杯", 1, True)
    assert got["02"]["data_pending"] and not got["02"]["is_cancelled"] and got["02"]["explained"]
    assert got["03"]["is_cancelled"] and got["03"]["title"] == "title only" and got["03"]["series_day"] is None
    assert not got["04"]["explained"]


def test_result_lines(spark):
    text = ["01KBGN", "   1R  予選  H1800m", "  着 艇 登番 選手名 ﾓｰﾀｰ ﾎﾞｰﾄ 展示 進入 ｽﾀｰﾄﾀｲﾐﾝｸ ﾚｰｽﾀｲﾑ まくり差し", "  01  3 4001 名　前 12  34  6.75   3    0.12     1.50.1", "  F   1 4002 某 x  34  6.80   1    F0.01", "  S0  2 4003 short"]
    text += ["        単勝     3          120", "        複勝     3          100  5   特払い", "        拡連複   3-5   230  人気     2", "                 1-3   340  人気", "   2R  一般  中　止"]
    d = table(spark, text)
    rows = {r["lane"]: r for r in lines.result_rows(d).collect()}
    assert set(rows) == {1, 3}
    assert (rows[3]["finish"], rows[3]["motor"], rows[3]["course"], rows[3]["start_timing"], rows[3]["race_time"], rows[3]["name"]) == (1, 12, 3, 0.12, "1.50.1", "名　前")
    assert (rows[1]["finish"], rows[1]["status"], rows[1]["motor"], rows[1]["start_timing"], rows[1]["race_time"]) == (None, "F", None, None, None)
    assert {r["race_number"]: (r["is_cancelled"], r["technique"]) for r in lines.result_races(d).collect()} == {1: (False, "まくり差し"), 2: (True, None)}
    paid = [(r["bet_type"], r["combination"], r["amount"], r["popularity"]) for r in lines.payout_rows(d).collect()]
    assert sorted(paid, key=str) == sorted([("単勝", "3", 120, None), ("複勝", "3", 100, None), ("複勝", "5", None, None), ("拡連複", "3-5", 230, 2), ("拡連複", "1-3", 340, None)], key=str)


def test_period_records(spark):
    layout = lines.period_layout()
    assert sum(n for _, _, n, _ in layout) == lines.PERIOD_WIDTH == layout[-1][1] + layout[-1][2] - 1

    def record(**given):
        default = {"era": "S", "birth": "480115", "since": "20260101", "until": "", "registration": "4001", "win_rate": "0654", "place_rate": "0452", "course2_finish1_count": "007"}
        cell = lambda n, w, kind: str((default | given).get(n, "" if kind != "int" else "0")).rjust(w)
        return "".join(cell(n, w, kind) for n, _, w, kind in layout)

    text = [record(), record(course2_finish1="12", win_rate=""), record()[:-1], record(age="x1"), record(era="Q"), record(birth="481301"), record(birth="480000"), record(since="2026010"), record(until="20260230")]
    rows, rejects = lines.period_rows(table(spark, text))
    got = {r["line_no"]: r for r in rows.collect()}
    assert set(got) == {0, 1, 6} and sorted(r["line_no"] for r in rejects.collect()) == [2, 3, 4, 5, 7, 8]
    assert (str(got[0]["birth_date"]), got[0]["win_rate"], got[0]["place_rate"], str(got[0]["since"]), got[0]["until"]) == ("1973-01-15", 6.54, 45.2, "2026-01-01", None)
    assert got[1]["win_rate"] is None and got[6]["birth_date"] is None
    courses = {r["course"]: r for r in lines.period_courses(rows.where("line_no = 1"), ["registration"]).collect()}
    assert len(courses) == 6 and courses[2]["finish1"] == 12 and courses[1]["finish1"] == 0 and courses[3]["place_rate"] is None


def test_unknown_purpose_is_an_error():
    with pytest.raises(ValueError):
        quality.usable_for(F.col("verdict"), "anything")
