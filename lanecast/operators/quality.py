"""Validation, integrity, quarantine, quality scores."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values
AXIS_WEIGHTS = {"completeness": 25, "uniqueness": 15, "validity": 20, "consistency": 15, "point_in_time": 25}
VERDICTS = ((95, "train_or_predict"), (90, "predict_with_warning"), (80, "research_only"), (0, "blocked"))


@dataclass(frozen=True)
class Field:
    """One field's rules; codes by failure, and the default code for those not named."""

    name: str
    kind: str = "string"
    required: bool = True
    allowed: tuple = ()
    least: float | None = None
    most: float | None = None
    missing_code: str = "E001"
    code: str = "E002"


LANE_FIELDS = (Field("lane_number", "int", least=1, most=6, missing_code="E003", code="E005"), Field("registration_number", "bigint", least=1, missing_code="E003", code="E006"))


def failures(fields: tuple[Field, ...]) -> Column:
    """array<struct<field, code, message>>: of each field the first check that fails; an absent optional field passes."""
    found = []
    for f in fields:
        c, v = F.col(f.name), F.col(f.name).try_cast(f.kind)
        fail = lambda code, text, f=f: F.struct(F.lit(f.name).alias("field"), F.lit(code).alias("code"), F.lit(text).alias("message"))
        checks = [(c.isNull() & F.lit(f.required), fail(f.missing_code, "required")), (c.isNotNull() & v.isNull(), fail(f.code, "type"))]
        if f.allowed:
            checks.append((~v.isin(*f.allowed), fail(f.code, "enum")))
        if f.least is not None:
            checks.append((v < f.least, fail(f.code, "min")))
        if f.most is not None:
            checks.append((v > f.most, fail(f.code, "max")))
        found.append(reduce(lambda when, x: when.when(*x), checks[1:], F.when(*checks[0])))
    return F.array_compact(F.array(*found))


def validate(df: DataFrame, fields: tuple[Field, ...]) -> DataFrame:
    return df.withColumn("failures", failures(fields)).withColumn("valid", F.size("failures") == 0)


def reason_tally(df: DataFrame) -> DataFrame:
    return df.select(F.explode("failures").alias("f")).groupBy(F.col("f.code").alias("code")).agg(F.count(F.lit(1)).alias("n"))


def split_duplicates(df: DataFrame, key: list[str], order: list[str], compare: list[str] | None = None) -> DataFrame:
    """Adds duplicate: null for the kept row (first of its key), 'exact' if it repeats the kept row in the columns of `compare`
    (by default all but the ordering ones), else 'key'."""
    w = Window.partitionBy(*key).orderBy(*order)
    content = F.struct(*(compare or [c for c in df.columns if c not in order]))
    d = df.withColumn("__h", content).withColumn("__nth", F.row_number().over(w)).withColumn("__first", F.first("__h").over(w))
    return d.withColumn("duplicate", F.when(F.col("__nth") > 1, F.when(F.col("__h").eqNullSafe(F.col("__first")), "exact").otherwise("key"))).drop("__h", "__nth", "__first")


def split_references(df: DataFrame, other: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows whose reference resolves, and those whose reference doesn't (E004)."""
    keys = other.select(*on).distinct()
    return df.join(keys, on, "left_semi"), df.join(keys, on, "left_anti").withColumn("code", F.lit("E004"))


def quarantine_id(record: list[str], code: Column) -> Column:
    """sha256 of the record, fields by name, and the code."""
    return F.sha2(F.concat(F.to_json(F.struct(*[F.col(c) for c in sorted(record)])), F.lit("|"), code), 256)


def quarantine(store: DataFrame | None, rejected: DataFrame, record: list[str]) -> DataFrame:
    """The store with the rejected records that it lacks; one that is there already is left as it is."""
    new = rejected.withColumn("quarantine_id", quarantine_id(record, F.col("code"))).dropDuplicates(["quarantine_id"])
    new = new.select("quarantine_id", *record, "code", F.lit("pending").alias("state"))
    return new if store is None else store.unionByName(new.join(store.select("quarantine_id"), "quarantine_id", "left_anti"), allowMissingColumns=True)


def replay(store: DataFrame, corrections: DataFrame, fields: tuple[Field, ...]) -> DataFrame:
    """Corrections by quarantine_id are validated again; the original record stays, the outcome is added once.
    Of several valid corrections of a record, the first as JSON text."""
    fixed = validate(corrections, fields).where("valid").select("quarantine_id", F.to_json(F.struct(*[f.name for f in fields])).alias("__fixed"))
    fixed = fixed.groupBy("quarantine_id").agg(F.min("__fixed").alias("__fixed"))
    had = F.col("corrected") if "corrected" in store.columns else F.lit(None).cast("string")
    again = (F.col("state") == "pending") & F.col("__fixed").isNotNull()
    d = store.withColumn("corrected", had).join(fixed, "quarantine_id", "left")
    return d.withColumn("corrected", F.when(again, F.col("__fixed")).otherwise(F.col("corrected"))).withColumn("state", F.when(again, "replayed").otherwise(F.col("state"))).drop("__fixed")


def symmetric_difference(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    missing = a.select(*on).distinct().join(b, on, "left_anti").withColumn("side", F.lit("missing"))
    return missing.unionByName(b.select(*on).distinct().join(a, on, "left_anti").withColumn("side", F.lit("extra")))


def _checks(d: DataFrame, *rows: tuple[str, str, Column, Column]) -> DataFrame:
    """axis, name, examined, defects, from one aggregate of d."""
    flat = [F.struct(F.lit(axis).alias("axis"), F.lit(name).alias("name"), F.coalesce(n, F.lit(0)).cast("long").alias("examined"), F.coalesce(bad, F.lit(0)).cast("long").alias("defects")) for axis, name, n, bad in rows]
    return d.agg(F.array(*flat).alias("c")).select(F.inline("c"))


def audit(races: DataFrame, entries: DataFrame, results: DataFrame, placings: DataFrame, meetings: DataFrame, odds: DataFrame, weather: DataFrame) -> DataFrame:
    """The 19 checks: axis, name, examined, defects.

    races: race_id, race_date, venue, status, deadline, meeting_id. entries: race_id, lane, win_rate, available_at. results: result_id,
    race_id, available_at. placings: result_id, lane, finish, state. meetings: meeting_id, venue. odds: odds, observed_at, available_at.
    weather: weather_date, available_at.

    Entries meet their race once and are summed up per race; results and placings likewise, and a race's lanes (its card, so
    a handful) go with it to its placings. Every further check is an aggregate of one table.
    """
    n, all_, count = F.count(F.lit(1)), F.sum, F.count_if
    repeats = lambda c: n - F.count_distinct(c) - F.max(F.col(c).isNull().cast("int"))
    e = entries.join(races.select("race_id", "deadline", F.lit(True).alias("known")), "race_id", "left")
    per_card = e.groupBy("race_id").agg(
        n.alias("boats"), F.collect_set("lane").alias("lanes"), repeats("lane").alias("repeated"), count(F.col("win_rate").isNull()).alias("no_rate"), count(~F.col("win_rate").between(0, 10)).alias("rate_off"),
        count(~F.col("lane").between(1, 6)).alias("lane_off"), count(F.col("deadline").isNotNull()).alias("timed"), count(F.col("available_at") > F.col("deadline")).alias("late"),
    )
    r = results.join(races.select("race_id", "deadline", "status", F.lit(True).alias("known")), "race_id", "left")
    p = placings.groupBy("result_id").agg(n.alias("places"), repeats("lane").alias("twice"), F.collect_list("lane").alias("placed_lanes"), F.count("finish").alias("numbered"), count(F.col("finish") == 1).alias("firsts"), count((~F.col("finish").between(1, 6)) | (F.col("finish").isNull() & F.col("state").isNull())).alias("finish_off"))
    per_result = r.join(p, "result_id", "full_outer").join(per_card.select("race_id", "lanes"), "race_id", "left")
    carded = F.col("lanes").isNotNull() & F.col("result_id").isNotNull() & F.col("race_id").isNotNull()
    ran = (F.col("status") == "finished") & (F.col("numbered") > 0)
    strange = F.size(F.filter("placed_lanes", lambda x: ~F.array_contains(F.col("lanes"), x)))
    known = races.join(per_card.select("race_id", "boats"), "race_id", "left").join(results.groupBy("race_id").agg(n.alias("outcomes")), "race_id", "left")
    due = F.col("status") != "cancelled"
    held = races.join(meetings.select("meeting_id", F.col("venue").alias("host")), "meeting_id").groupBy("meeting_id").agg(F.count_distinct("race_date").alias("days"))
    hosts = races.where("meeting_id IS NOT NULL").join(meetings.select("meeting_id", F.col("venue").alias("host")), "meeting_id", "left")
    parts = [
        _checks(known, ("completeness", "races_have_six_entries", count(due), count(due & (F.coalesce("boats", F.lit(0)) != 6))), ("completeness", "finished_races_have_a_result", count(F.col("status") == "finished"), count((F.col("status") == "finished") & F.col("outcomes").isNull())), ("completeness", "races_have_a_deadline", count(due), count(due & F.col("deadline").isNull()))),
        _checks(
            per_card, ("completeness", "entries_have_a_national_win_rate", all_("boats"), all_("no_rate")), ("uniqueness", "one_entry_per_lane", all_("boats"), all_("repeated")), ("validity", "lane_numbers_in_range", all_("boats"), all_("lane_off")),
            ("validity", "win_rates_in_range", all_(F.col("boats") - F.col("no_rate")), all_("rate_off")), ("point_in_time", "card_features_precede_the_deadline", all_("timed"), all_("late")),
        ),
        _checks(results.groupBy("race_id").agg(n.alias("n")), ("uniqueness", "one_result_per_race", all_("n"), all_(F.col("n") - 1))),
        _checks(
            per_result, ("uniqueness", "one_result_entry_per_lane", all_("places"), all_("twice")), ("validity", "finish_positions_in_range", all_("places"), all_("finish_off")),
            ("consistency", "a_race_that_produced_placings_has_a_first", count(ran), count(ran & (F.col("firsts") == 0))), ("consistency", "result_lanes_match_the_card", all_(F.when(carded, F.col("places"))), all_(F.when(carded, strange))),
            ("point_in_time", "results_do_not_precede_their_race", count("known"), count(F.col("available_at") <= F.col("deadline"))),
        ),
        _checks(hosts, ("consistency", "races_belong_to_their_venue_meeting", n, count(F.col("host") != F.col("venue")))),
        _checks(meetings.select("meeting_id").join(held, "meeting_id", "left"), ("consistency", "meetings_span_a_plausible_series", n, count(F.col("days") > 9))),
        _checks(odds, ("validity", "odds_are_quotable", n, count(F.col("odds") < 1.0)), ("point_in_time", "odds_available_at_matches_observed_at", n, count(F.col("available_at") != F.col("observed_at")))),
        _checks(weather, ("point_in_time", "weather_is_not_available_before_its_day", n, count(F.col("available_at") < F.col("weather_date")))),
    ]
    return reduce(DataFrame.unionByName, parts)


def axis_scores(checks: DataFrame) -> DataFrame:
    """checks: axis, name, examined, defects. Weight times the plain mean of pass rates; nothing examined isn't counted; none: full marks."""
    spark = checks.sparkSession
    weights = spark.createDataFrame(list(AXIS_WEIGHTS.items()), "axis string, weight int")
    rate = checks.where("examined > 0").groupBy("axis").agg(F.avg(1 - F.col("defects") / F.col("examined")).alias("rate"))
    return weights.join(rate, "axis", "left").select("axis", (F.col("weight") * F.coalesce("rate", F.lit(1.0))).alias("score"))


def verdict(score: Column) -> Column:
    out = None
    for least, name in VERDICTS:
        out = F.when(score >= least, name) if out is None else out.when(score >= least, name)
    return out


def usable_for(verdict_: Column, purpose: str) -> Column:
    if purpose == "train":
        return verdict_ == "train_or_predict"
    if purpose == "predict":
        return verdict_.isin("train_or_predict", "predict_with_warning")
    if purpose == "research":
        return verdict_ != "blocked"
    raise ValueError(f"unknown purpose: {purpose}")


def distribution_violations(df: DataFrame, group: list[str], p: str, size: int, tolerance: float = 1e-9, zero_at: Column | None = None) -> DataFrame:
    """Groups that aren't a distribution over `size` keys, or where a row that zero_at names isn't exactly 0; the first reason."""
    g = df.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.min(p).alias("lo"), F.max(p).alias("hi"), F.sum(p).alias("total"), F.coalesce(F.bool_or((zero_at if zero_at is not None else F.lit(False)) & (F.col(p) != 0)), F.lit(False)).alias("not_zero"))
    reason = F.when(F.col("n") != size, "keys").when((F.col("lo") < 0) | (F.col("hi") > 1), "range").when(F.col("not_zero"), "zero").when(F.abs(F.col("total") - 1) > tolerance, "sum")
    return g.withColumn("violation", reason).where("violation IS NOT NULL")


def board_defects(board: DataFrame, required: list[str], key: str) -> DataFrame:
    """defect, field, n of a board: rows that lack a required key, and rows beyond the first of their id."""
    out = [F.struct(F.lit("missing").alias("defect"), F.lit(c).alias("field"), F.count_if(F.col(c).isNull()).alias("n")) for c in required]
    repeated = F.count(key) - F.count_distinct(key)
    return board.agg(F.array(*out, F.struct(F.lit("duplicate").alias("defect"), F.lit(key).alias("field"), repeated.alias("n"))).alias("c")).select(F.inline("c"))
