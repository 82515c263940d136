"""All attributions of the returns in one report, in long form."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanecast.plans import betting, pooled
from lanecast.plans.contest import candidates_of, full_fields
from lanecast.plans.registry import Registry
from lanecast.sources import ledgers

R = Registry()
QUERIES, SQL = R.QUERIES, R.SQL
# section, its SQL, what names an item, metrics
SECTIONS = (
    ("rules", betting.SQL["rule_book"], ("rule", "threshold"), ("bets", "roi", "hit_rate", "trimmed_roi")),
    ("pools", pooled.SQL["pool_rule_book"], ("pool", "rule", "threshold"), ("bets", "roi", "trimmed_roi")),
    ("bands", betting.SQL["price_band_report"], ("band",), ("n", "blind_roi", "ev_roi")),
    ("counterfactual", betting.SQL["blind_counterfactual"], ("rule", "threshold", "controls"), ("blind", "covered", "lift")),
    ("tail", betting.SQL["tail_concentration"], ("rule", "threshold"), ("top_percent_share", "top_ten_share")),
    ("months", betting.SQL["monthly_returns"], ("rule", "threshold", "month"), ("bets", "roi")),
    ("realisation", betting.SQL["quote_realisation"], ("rule", "threshold"), ("mean_realisation", "median_realisation")),
)


def _long(section: str, sql: str, item: tuple, metrics: tuple) -> str:
    values = ", ".join(f"struct_pack(metric := '{m}', value := {m}::DOUBLE)" for m in metrics)
    name = ", ".join(f"{c}::VARCHAR" for c in item)
    return f"SELECT section, item, m.metric AS metric, m.value AS value FROM (SELECT '{section}' AS section, concat_ws('|', {name}) AS item, unnest([{values}]) AS m FROM ({sql}))"


@R.query(" UNION ALL ".join(_long(*x) for x in SECTIONS), base=False)
def attribution_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """section, item, metric, value of rules, pools, price bands, blind counterfactuals, tails, months and realised quotes. The full
    fields, which candidates and pools come from, the candidates and the bets are stored once for all sections; the draws against chance are
    permutation_against_null and price_noise_summary."""
    fields = ledgers.stored(full_fields(spark, sf_dir).select("race_id", "race_date", "lane", "p", "odds", "finish", "won"), "fields")
    c = betting.kept(candidates_of(fields))
    b = ledgers.stored(betting.selected(c), "bets")
    found = {"rules": betting.book(b, ["rule", "threshold"]), "pools": pooled.rule_book_of(pooled.race_rows_of(fields)), "bands": betting.bands(c), "counterfactual": betting.counterfactuals(c, b), "tail": betting.tails(b), "months": betting.months(b), "realisation": betting.realisation(b)}
    parts = []
    for section, _, item, metrics in SECTIONS:
        values = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics]
        parts.append(found[section].select(F.lit(section).alias("section"), F.concat_ws("|", *[F.col(c).cast("string") for c in item]).alias("item"), F.inline(F.array(*values))))
    return reduce(DataFrame.unionByName, parts)
