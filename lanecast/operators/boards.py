"""What is due, what was predicted, and what is shown of both."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanecast.functions import pricing


def due_for_preview(schedule: DataFrame, captured: DataFrame, now: Column, least: int = 5, most: int = 30) -> DataFrame:
    """Races `least` to `most` minutes ahead, neither cancelled nor captured. schedule: race_id, deadline, cancelled."""
    lead = pricing.minutes_before(F.col("deadline"), now)
    return schedule.where(~F.col("cancelled") & lead.between(least, most)).join(captured.select("race_id").distinct(), "race_id", "left_anti")


def due_for_result(schedule: DataFrame, results: DataFrame, now: Column, after: int = 8) -> DataFrame:
    """Races whose deadline passed `after` minutes ago or earlier and that have no result."""
    past = pricing.minutes_before(now, F.col("deadline")) >= after
    return schedule.where(past).join(results.select("race_id").distinct(), "race_id", "left_anti")


def predictable(schedule: DataFrame, predicted: DataFrame, now: Column, lead_minutes: int) -> DataFrame:
    """Adds skip: why a race isn't predicted now (past, early, already by this version); null where it is."""
    lead = pricing.minutes_before(F.col("deadline"), now)
    done = predicted.select("race_id").distinct().withColumn("__done", F.lit(True))
    d = schedule.join(done, "race_id", "left")
    return d.withColumn("skip", F.when(lead <= 0, "past").when(lead > lead_minutes, "early").when(F.col("__done"), "already")).drop("__done")


def latest_prediction(predictions: DataFrame, keys: list[str], version: str, tie: str) -> DataFrame:
    """Per key the last prediction of a version."""
    d = predictions.where(F.col("version") == version)
    return d.groupBy(*keys).agg(F.max_by("p", F.struct("predicted_at", tie)).alias("p"), F.max("predicted_at").alias("predicted_at"))


def side_by_side(lanes: DataFrame, sides: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Every lane with each side's p as p_{name}; null where a side has none."""
    for name, d in sides.items():
        lanes = lanes.join(d.select(*keys, F.col("p").alias(f"p_{name}")), keys, "left")
    return lanes


def merged_counts(parts: DataFrame, by: str) -> DataFrame:
    """Sources merged: counts add up, distinct races are the greatest of them, the span is the widest."""
    return parts.groupBy(by).agg(F.sum("n").alias("n"), F.max("races").alias("races"), F.min("since").alias("since"), F.max("through").alias("through"))


def coverage(df: DataFrame, items: dict[str, bool], by: list[str]) -> DataFrame:
    """Per group: available items, items in all, the missing ones by name, and whether a critical one is; items: column -> critical."""
    g = df.groupBy(*by).agg(*[F.count(c).alias(c) for c in items])
    absent = F.array_compact(F.array(*[F.when(F.col(c) == 0, c) for c in items]))
    critical = F.lit(False)
    for c, must in items.items():
        critical = critical | (F.col(c) == 0) if must else critical
    return g.select(*by, (len(items) - F.size(absent)).cast("long").alias("obtained"), F.lit(len(items)).cast("long").alias("total"), F.array_join(absent, ",").alias("missing"), critical.alias("critical_missing"))


def stake_violations(stakes: DataFrame, unit: int, race_most: int, day_most: int) -> DataFrame:
    """Adds violation: not a multiple of the unit, above the race's or (running, in order of id) the day's limit, not offered."""
    day = F.sum("stake").over(Window.partitionBy("race_date").orderBy("race_id", "lane").rowsBetween(Window.unboundedPreceding, 0))
    race = F.sum("stake").over(Window.partitionBy("race_id"))
    bad = F.when((F.col("stake") <= 0) | (F.col("stake") % unit != 0), "unit").when(race > race_most, "race_limit").when(day > day_most, "day_limit").when(~F.col("offered"), "not_offered")
    return stakes.withColumn("violation", bad)


# fixed values: the board's sources and whether a decision needs them
CATALOGUE = {
    "race_card": True, "scheduled_deadline": True, "racer_period_stats": True, "course_stats": False, "motor_boat_stats": True, "prediction_card": True, "before_info": True, "exhibition_time": True, "exhibition_course": True,
    "surface_conditions": False, "parts_change": False, "current_odds": True, "prediction_preview": False,
}
READINGS = 5  # of the odds history


def recent_readings(quotes: DataFrame, n: int = READINGS) -> DataFrame:
    """Quotes (race_id, lane, odds, observed_at) of each race's last n readings, with nth: 1 is the latest."""
    w = Window.partitionBy("race_id").orderBy(F.col("observed_at").desc())
    return quotes.withColumn("nth", F.dense_rank().over(w)).where(F.col("nth") <= n)


def race_board(schedule: DataFrame, lanes: DataFrame, quotes: DataFrame, horizon_minutes: int) -> DataFrame:
    """A row a race that is not cancelled and whose deadline is ahead of its `now` by horizon_minutes at most.

    schedule: race_id, venue, race_number, deadline, now, cancelled, surface (whether its conditions are known). lanes: race_id, lane, has_period,
    has_course, motor_rate, boat_rate, exhibition_time, tilt, course, parts_seen (null: not captured), p_card, p_preview.
    Gives decision, best_lane, probability, source, odds, expected_return, availability (map of CATALOGUE), missing (critical), reasons,
    odds_history (lane 1, oldest first) and lanes: lane, probability, the last readings. Where lanes and quotes come from the same rows, board_of spares joining them.
    """
    rows = lanes.groupBy("race_id").agg(F.collect_list(F.struct(*[c for c in lanes.columns if c != "race_id"])).alias("entries"))
    said = quotes.groupBy("race_id").agg(F.collect_list(F.struct("observed_at", "lane", "odds")).alias("quotes"))
    return board_of(schedule, rows.join(said, "race_id", "left"), horizon_minutes)


def with_readings(rows: DataFrame, n: int = READINGS) -> DataFrame:
    """rows: entries (structs with lane) and quotes (structs of observed_at, lane, odds) of a race. Adds to each entry history, its odds in the
    race's last n readings, oldest first (null: none), and quote, its odds in the latest."""
    times = F.sort_array(F.array_distinct(F.transform("quotes", lambda q: q["observed_at"])), asc=False)
    d = rows.withColumn("__times", F.coalesce(times, F.array()))
    recent = F.filter("quotes", lambda q: (F.size("__times") <= n) | (q["observed_at"] >= F.get("__times", F.lit(n - 1))))
    d = d.withColumn("__recent", F.coalesce(F.array_sort(recent), F.array()))
    own = F.transform("entries", lambda e: F.struct(e.alias("e"), F.filter("__recent", lambda q: q["lane"] == e["lane"]).alias("own")))
    fields = rows.schema["entries"].dataType.elementType.names
    last = lambda x: F.get(x["own"], F.size(x["own"]) - 1)
    history = lambda x: F.when(F.size(x["own"]) > 0, F.transform(x["own"], lambda q: q["odds"]))
    quote = lambda x: F.when(last(x)["observed_at"].eqNullSafe(F.get("__times", F.lit(0))), last(x)["odds"])
    d = d.withColumn("__own", own).withColumn("entries", F.transform("__own", lambda x: F.struct(*[x["e"][f].alias(f) for f in fields], history(x).alias("history"), quote(x).alias("quote"))))
    return d.drop("__times", "__recent", "__own", "quotes")


def board_of(schedule: DataFrame, rows: DataFrame, horizon_minutes: int) -> DataFrame:
    """race_board of a row a race: race_id, entries (structs of the columns of `lanes`), quotes (structs of observed_at, lane, odds); no lane or
    quote is joined or grouped here."""
    ahead = F.unix_timestamp("deadline") - F.unix_timestamp("now")
    open_ = schedule.where(~F.col("cancelled") & (ahead > 0) & (ahead <= horizon_minutes * 60))
    b = with_readings(open_.join(rows, "race_id", "left"))
    known = lambda c: F.transform("entries", lambda e: e[c].isNotNull())
    some = lambda c: F.coalesce(F.exists("entries", lambda e: e[c].isNotNull()), F.lit(False))
    whole = lambda c: F.size(F.filter(known(c), lambda x: x)) == 6
    of = lambda c: F.transform("entries", lambda e: e[c])
    numbers = F.array_distinct(F.filter(of("lane"), lambda x: x.between(1, 6)))
    pick = lambda p: F.array_max(F.transform("entries", lambda e: F.struct(e[p].alias("p"), (-e["lane"]).alias("n"), e["lane"].alias("lane"), e["quote"].alias("quote"))))  # noqa: E731  the greatest p, on ties the lower lane
    b = b.withColumns({
        "six": (F.size("entries") == 6) & (F.size(numbers) == 6), "period": F.array_min(of("has_period")), "courses": F.array_max(of("has_course")), "rates": F.forall("entries", lambda e: e["motor_rate"].isNotNull() & e["boat_rate"].isNotNull()),
        "times": whole("exhibition_time"), "tilts": whole("tilt"), "all_courses": whole("course"), "parts": some("parts_seen"), "card": some("p_card"), "preview": some("p_preview"), "priced": some("quote"),
        "changed": F.array_sort(F.transform(F.filter("entries", lambda e: e["course"] != e["lane"]), lambda e: e["lane"])), "odds_history": F.array_max(F.transform(F.filter("entries", lambda e: e["lane"] == 1), lambda e: e["history"])), "by_card": pick("p_card"), "by_preview": pick("p_preview"),
        "lanes": F.array_sort(F.transform("entries", lambda e: F.struct(e["lane"].alias("lane"), F.coalesce(e["p_preview"], e["p_card"]).alias("probability"), e["history"].alias("history")))),
    })
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    has = {
        "race_card": yes("six"), "scheduled_deadline": F.col("deadline").isNotNull(), "racer_period_stats": yes("period"), "course_stats": yes("courses"), "motor_boat_stats": yes("six") & yes("rates"), "prediction_card": yes("card"), "before_info": yes("times") & yes("tilts"), "exhibition_time": yes("times"),
        "exhibition_course": yes("all_courses"), "surface_conditions": yes("surface") & (F.col("race_number") > 1), "parts_change": yes("parts"), "current_odds": yes("priced"), "prediction_preview": yes("preview"),
    }
    best = F.when(yes("preview"), F.col("by_preview")).when(yes("card"), F.col("by_card"))
    b = b.withColumn("availability", F.create_map(*[x for name in CATALOGUE for x in (F.lit(name), has[name])])).withColumn("best", F.when(yes("priced"), best))
    b = b.withColumn("expected_return", pricing.expected_return(F.col("best.p"), F.col("best.quote")))
    missing = F.array_compact(F.array(*[F.when(~has[name], F.lit(name)) for name, needed in CATALOGUE.items() if needed]))
    history = F.coalesce("odds_history", F.array().cast("array<double>"))
    first, last = F.get(history, F.lit(0)), F.get(history, F.size(history) - 1)
    reasons = F.array_compact(F.array(
        F.when(F.size("changed") > 0, F.when(F.array_contains("changed", F.col("best.lane")), "course_change_of_pick").otherwise("course_change")), F.when((F.size(history) >= 2) & (last > first), "lane1_price_up"),
        F.when(F.size(missing) > 0, "critical_data_missing").when(F.col("expected_return") < 100, "return_below_stake"),
    ))
    return b.select(
        "race_id", "venue", "race_number", "deadline", pricing.decision(F.size(missing) > 0, F.coalesce("expected_return", F.lit(0.0))).alias("decision"), F.col("best.lane").alias("best_lane"), F.col("best.p").alias("probability"), F.when(yes("preview"), "preview").otherwise("card").alias("source"),
        F.col("best.quote").alias("odds"), "expected_return", "availability", missing.alias("missing"), reasons.alias("reasons"), history.alias("odds_history"), "lanes",
    )


def venue_summary(board: DataFrame) -> DataFrame:
    """Per venue: races that remain, candidates, races that wait, the next race."""
    g = board.groupBy("venue").agg(F.count(F.lit(1)).alias("remaining"), F.count_if(F.col("decision") == "candidate").alias("candidates"), F.count_if(F.col("decision") == "waiting").alias("waiting"), F.min_by("race_id", F.struct("deadline", "race_id")).alias("next_race"))
    return g


def collected(sources: dict[str, DataFrame], version: str = "model_version") -> DataFrame:
    """label, n, races, since, through of each source (race_id, at), a row a version of those that have the column; an empty source without
    versions has n 0."""
    rows = []
    for label, d in sources.items():
        sums = [F.count(F.lit(1)).alias("n"), F.count_distinct("race_id").alias("races"), F.min("at").alias("since"), F.max("at").alias("through")]
        if version in d.columns:
            rows.append(d.groupBy(version).agg(*sums).select(F.concat(F.lit(f"{label} ("), F.col(version), F.lit(")")).alias("label"), "n", "races", "since", "through"))
        else:
            rows.append(d.agg(*sums).select(F.lit(label).alias("label"), "n", "races", "since", "through"))
    return reduce(DataFrame.unionByName, rows)
