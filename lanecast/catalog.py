"""All registered queries and their SQL."""

from __future__ import annotations

from lanecast.plans import attribution, audit, betting, boards, captures, decisions, effects, history, intake, loads, models, pooled, series, studies, texts, timeline, upkeep
from lanecast.plans.registry import Query

FLAGSHIP = "price_band_report"
MODULES = (betting, timeline, series, boards, pooled, studies, intake, loads, attribution, upkeep, audit, effects, models, texts, decisions, captures, history)


def queries() -> dict[str, Query]:
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for m in MODULES for name, text in m.SQL.items()}
