"""File inventory, ingest ledgers, idempotent loads, materialised feature tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SUFFIXES = (".lzh", ".txt", ".csv", ".zip", ".json")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder that driver and executors share: below spark.checkpoint.dir; a local one where that is unset and Spark is
    local (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read back, for what several passes read; nothing depends on an executor's disk."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def inventory(spark: SparkSession, root: str, source: str, previous: DataFrame | None = None, now: Column | None = None) -> DataFrame:
    """source, path, size, sha256, collected_at. A known checksum keeps its time, a new or changed file gets now, entries
    gone from disk stay."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    base = root.rstrip("/").removeprefix("file://")
    found = files.where(suffix.isin(*SUFFIXES)).select(F.lit(source).alias("source"), F.regexp_replace("path", "^.*?" + base.replace(".", r"\.") + "/", "").alias("path"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))
    at = now if now is not None else F.current_timestamp()
    if previous is None:
        return found.withColumn("collected_at", at)
    old = previous.select("source", "path", F.col("size").alias("old_size"), F.col("sha256").alias("old_sha256"), F.col("collected_at").alias("old_at"))
    d = found.join(old, ["source", "path"], "full_outer")
    same = F.col("sha256").isNull() | (F.col("sha256") == F.col("old_sha256"))
    return d.select("source", "path", F.coalesce("size", "old_size").alias("size"), F.coalesce("sha256", "old_sha256").alias("sha256"), F.when(F.coalesce(same, F.lit(False)), F.col("old_at")).otherwise(at).alias("collected_at"))


def ingest(files: DataFrame, ledger: DataFrame | None, parser_version: str) -> DataFrame:
    """New ledger rows of files (path, sha256, size): keyed by (sha256, parser_version); a repeat adds nothing, an empty file fails."""
    new = files.withColumn("parser_version", F.lit(parser_version)).dropDuplicates(["sha256"])
    if ledger is not None:
        new = new.join(ledger.select("sha256", "parser_version"), ["sha256", "parser_version"], "left_anti")
    return new.select("path", "sha256", "parser_version", F.when(F.col("size") == 0, "failed").otherwise("ok").alias("state"))


def load_new_files(spark: SparkSession, root: str, folder: str, source: str, parse, parser_version: str) -> DataFrame:
    """One load of the files below root into the tables below folder: files, rows; of files whose content the ledger lacks for this parser.

    Below folder stand manifests by load, the ledger and the rows, each load's under the key of its recipe and data, so a load that is run again
    after a failure replaces its own rows. parse: the files' (path, sha256, content) to rows."""
    read = lambda name, schema: spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{folder}/{name}")
    ledger_schema = "path string, sha256 string, parser_version string, state string"
    spark.createDataFrame([], ledger_schema).write.mode("append").parquet(f"{folder}/ledger")  # so that there is one
    new = stored(ingest(inventory(spark, root, source), read("ledger", ledger_schema), parser_version), "new-files")
    n, mark = new.agg(F.count(F.lit(1)), F.hex(F.bit_xor(F.xxhash64("sha256")))).first()
    if not n:
        return spark.createDataFrame([(0, 0)], "files long, rows long")
    key = fingerprint(spark, {"parser": parser_version, "source": source, "files": n, "data": mark}, {}, "")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", F.sha2("content", 256).alias("sha256"), "content")
    rows = parse(files.join(new.where("state = 'ok'").select("sha256"), "sha256", "left_semi").dropDuplicates(["sha256"]))
    rows.write.mode("overwrite").parquet(f"{folder}/rows/load={key}")
    new.write.mode("append").parquet(f"{folder}/ledger")
    return spark.read.parquet(f"{folder}/rows/load={key}").agg(F.lit(n).alias("files"), F.count(F.lit(1)).alias("rows"))


def load_plan(days: DataFrame, files: DataFrame, ledger: DataFrame) -> DataFrame:
    """days x kinds K, B (K first) against files (day, kind, sha256, ok) and the ledger (kind, sha256): what happens to each."""
    kinds = F.array(*[F.struct(F.lit(kind).alias("kind"), F.lit(nth).alias("nth")) for nth, kind in enumerate("KB")])
    planned = days.withColumn("__kind", F.explode(kinds)).select(*days.columns, "__kind.*")
    known = ledger.select("kind", "sha256").distinct().withColumn("seen", F.lit(True))
    d = planned.join(files, ["day", "kind"], "left").join(known, ["kind", "sha256"], "left")
    outcome = F.when(F.col("sha256").isNull(), "missing").when(F.col("seen"), "skipped").when(F.col("ok"), "loaded").otherwise("failed")
    return d.select("day", "kind", "nth", "sha256", outcome.alias("outcome"))


def replace_scope(existing: DataFrame, new: DataFrame, scope: list[str]) -> DataFrame:
    """All rows of the scopes that `new` has are replaced by it."""
    return existing.join(new.select(*scope).distinct(), scope, "left_anti").unionByName(new)


def append_absent(existing: DataFrame, new: DataFrame, key: list[str], value: str) -> tuple[DataFrame, DataFrame]:
    """Rows to append (key not there, value present, the first per key), and counts of added, existing, empty."""
    known = existing.select(*key).distinct().withColumn("__seen", F.lit(True))
    d = new.join(known, key, "left").withColumn("outcome", F.when(F.col(value).isNull(), "empty").when(F.col("__seen"), "existing").otherwise("added"))
    added = d.where("outcome = 'added'").drop("__seen", "outcome").dropDuplicates(key)
    return added, d.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def first_capture(existing: DataFrame, boats: DataFrame, starts: DataFrame, parts_known: bool) -> DataFrame:
    """Pre-race rows to add: no row of a race that has any, none of a page without an exhibition time; the start
    exhibition by lane; unknown parts are null, not false."""
    timed = F.bool_or(F.col("exhibition_time").isNotNull()).over(Window.partitionBy("race_id"))
    d = boats.join(existing.select("race_id").distinct(), "race_id", "left_anti").withColumn("__timed", timed).where("__timed").drop("__timed")
    d = d.join(starts, ["race_id", "lane"], "left")
    return d if parts_known else d.withColumn("parts_changed", F.lit(None).cast("boolean"))


def cancelled_days(results: DataFrame) -> DataFrame:
    """Adds state: every race of a (venue, day) empty means the day was cancelled, a single empty one is a defect."""
    all_empty = F.bool_and("empty").over(Window.partitionBy("venue", "day"))
    return results.withColumn("state", F.when(all_empty, "cancelled").when(F.col("empty"), "defect").otherwise("ok"))


def back_fill(table: DataFrame, values: DataFrame, key: list[str], column: str) -> tuple[DataFrame, DataFrame]:
    """The table with nulls of a column filled by key, and counts: matched, already_set, not_found, no_value."""
    v = values.select(*key, F.col(column).alias("__new"), F.lit(True).alias("__in"))
    d = table.withColumn("__here", F.lit(True)).join(v, key, "full_outer")
    outcome = F.when(F.col("__here").isNull(), "not_found").when(F.col("__in").isNull(), None).when(F.col("__new").isNull(), "no_value").when(F.col(column).isNotNull(), "already_set").otherwise("matched")
    counts = d.select(outcome.alias("outcome")).where("outcome IS NOT NULL").groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))
    filled = d.where("__here").withColumn(column, F.coalesce(F.col(column), F.col("__new"))).select(*table.columns)
    return filled, counts


def get_or_create(dimension: DataFrame, rows: DataFrame, key: str, order: str) -> DataFrame:
    """The dimension with the keys it lacked; of several names for a key the first by `order`."""
    first = rows.groupBy(key).agg(F.min_by(F.struct(*[c for c in dimension.columns if c != key]), order).alias("__first")).select(key, "__first.*").select(*dimension.columns)
    return dimension.unionByName(first.join(dimension.select(key), key, "left_anti"))


def fingerprint(spark: SparkSession, recipe: dict, tables: dict[str, DataFrame], updated: str) -> str:
    """Key of a derived table: its recipe, and count and latest update of each source; one aggregate a table."""
    parts = [F.lit(str(sorted(recipe.items())))]
    values = [f"{name}:{d.agg(F.count(F.lit(1)), F.max(updated)).first()!s}" for name, d in sorted(tables.items())]
    return spark.range(1).select(F.sha2(F.concat_ws("|", *parts, *map(F.lit, values)), 256)).first()[0]


def materialised(spark: SparkSession, folder: str, key: str, build) -> DataFrame:
    """Reads the table of this key, or builds and writes it."""
    from pyspark.errors import AnalysisException

    path = f"{folder.rstrip('/')}/{key}"
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        build().write.mode("errorifexists").parquet(path)
        return spark.read.parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def live_results(lanes: DataFrame, races: DataFrame) -> DataFrame:
    """Lanes (race_id, lane, finish) with the race's win payout and technique on the row of the first place only; races: race_id,
    payout, technique."""
    first = F.col("finish") == 1
    d = lanes.join(races, "race_id", "left")
    return d.select(*lanes.columns, F.when(first, F.col("payout")).alias("payout"), F.when(first, F.col("technique")).alias("technique"))


def relinked(cards: DataFrame, results: DataFrame, key: tuple[str, ...] = ("race_id", "lane")) -> DataFrame:
    """Result rows with their card's columns, linked when they are read, so that the order of loading doesn't matter."""
    return results.join(cards.withColumn("has_card", F.lit(True)), list(key), "left").withColumn("has_card", F.coalesce("has_card", F.lit(False)))


def mirror_fill(feed: DataFrame, schedule: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pre-race rows of a mirror (venue, day, number, lane, exhibition_time) for the races of the schedule (race_id, venue, day,
    number, deadline), as observed and available at the deadline, parts unknown; and counts of races by outcome: unmatched,
    no_deadline, existing, untimed, added."""
    s = schedule.select("race_id", "venue", "day", "number", "deadline")
    d = feed.join(s, ["venue", "day", "number"], "left").join(existing.select("race_id").distinct().withColumn("__seen", F.lit(True)), "race_id", "left")
    timed = F.max(F.col("exhibition_time").isNotNull()).over(Window.partitionBy("venue", "day", "number"))
    outcome = F.when(F.col("race_id").isNull(), "unmatched").when(F.col("deadline").isNull(), "no_deadline").when(F.col("__seen"), "existing").when(~F.col("__timed"), "untimed").otherwise("added")
    d = d.withColumn("__timed", timed).withColumn("outcome", outcome)
    counts = d.select("venue", "day", "number", "outcome").distinct().groupBy("outcome").agg(F.count(F.lit(1)).alias("races"))
    added = d.where("outcome = 'added'").select("race_id", "lane", "exhibition_time", F.col("deadline").alias("observed_at"), F.col("deadline").alias("available_at"), F.lit(None).cast("boolean").alias("parts_changed"))
    return added, counts


def merged_counters(files: DataFrame, counters: str = "counters") -> DataFrame:
    """name, n: the counters (a map of name to count) of all files added up."""
    return files.select(F.explode(counters).alias("name", "n")).groupBy("name").agg(F.sum("n").alias("n"))
