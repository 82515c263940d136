"""Text files in parts: no task holds a day's lines, sections number anew in each part."""

from __future__ import annotations

import pytest

from lanecast.plans import texts
from lanecast.sources import lines

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("made", [texts.card_lines, texts.result_lines])
def test_a_text_holds_one_section(spark, made):
    d = made(spark, SF)
    marks = d.where(d["line"].rlike("^[0-9][0-9][BK]BGN$")).groupBy(*lines.of_file(d)).count()
    assert marks.where("count > 1").count() == 0  # before: all sections of a day in one text
    assert marks.groupBy("path").count().where("count > 1").count() > 0


def test_parts_are_parsed_apart(spark):
    text = lambda n: [f"{n}BBGN", "ボートレース", f"この場のデータ更新は、いま{lines.PENDING}。", f"{n}BEND"]
    rows = [("a", n, k, x) for n in ("01", "02") for k, x in enumerate(text(n))]
    d = lines.card_days(spark.createDataFrame(rows, "path string, part string, line_no int, line string"))
    assert sorted((r["path"], r["section"], r["data_pending"]) for r in d.collect()) == [("a", "01", True), ("a", "02", True)] and "part" not in d.columns
