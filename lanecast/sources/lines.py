"""Text files to typed rows: numbered lines, context filled down by windows, fields by position or pattern."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanecast.functions.text import narrow

# fixed values: era letters and the years before their first
ERAS = {"M": 1867, "T": 1911, "S": 1925, "H": 1988, "R": 2018}


def numbered_lines(files: DataFrame, text: str = "value", *key: str) -> DataFrame:
    """key (path, unless named), line_no, line."""
    return files.select(*(key or ("path",)), F.posexplode(F.split(text, r"\r?\n")).alias("line_no", "line"))


def of_file(lines: DataFrame) -> list[str]:
    """What names a file: its path, and its part where files come in parts that begin and end with whole sections."""
    return [c for c in ("path", "part") if c in lines.columns]


def fill_down(lines: DataFrame, key: str | list[str], columns: dict[str, Column], reset: str | None = None) -> DataFrame:
    """Adds each column with its last non-null value so far in the file (or in the section, if `reset` numbers them)."""
    w = Window.partitionBy(*[*([key] if isinstance(key, str) else key), *([reset] if reset else [])]).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumns({n: F.last(c, ignorenulls=True).over(w) for n, c in columns.items()})


def matched(line: Column, pattern: str, group: int = 1) -> Column:
    found = F.regexp_extract(line, pattern, group)
    return F.when(found != "", found)


# fixed values: marks and patterns of the files
PENDING, CALLED_OFF, CANCELLED = "しばらくお待ちください", "開催は中止となりました", "中止"
PROGRAMME, BANNER = "番組表", r"^第\s*(\d+)日\s+(\d{4})年\s*(\d{1,2})月\s*(\d{1,2})日\s+.+$"
CARD_HEADER = r"^(\d+)R\s*(\S.*?)\s*H?(\d{4})m\s+.*?(\d{1,2}:\d{2})"  # the class is all up to the distance
RESULT_HEADER, COLUMNS, LAST_COLUMN = r"^\s*(\d{1,2})R\s", r"^\s*着\s*艇\s*登番", "ﾚｰｽﾀｲﾑ"
POOLS = ("単勝", "複勝", "２連単", "２連複", "拡連複", "３連単", "３連複")
# fixed values: an entry's fields, from their first character (0 is the line's first) up to the second
ENTRY = {"lane": (0, 1), "registration": (2, 6), "name": (6, 10), "age": (10, 12), "branch": (12, 14), "weight": (14, 16), "class": (16, 18), "national_win": (19, 23), "national_second": (24, 29), "local_win": (30, 34), "local_second": (35, 40), "motor": (41, 43), "motor_second": (44, 49), "boat": (50, 52), "boat_second": (53, 58), "trailing": (59, 73)}
ENTRY_TEXT = ("name", "branch", "class", "trailing")
ENTRY_RATES = ("national_win", "national_second", "local_win", "local_second", "motor_second", "boat_second")


def in_sections(lines: DataFrame, kind: str) -> DataFrame:
    """lines (path, line_no, line) from the first section mark NN<kind>BGN on, with section (NN), section_no and text, the
    narrowed line without outer white space."""
    text = F.trim(narrow(F.col("line")))
    mark = matched(F.trim("line"), rf"^(\d\d){kind}BGN\s*$")
    w = Window.partitionBy(*of_file(lines)).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    d = lines.withColumn("text", text).withColumn("mark", mark)
    return d.withColumn("section_no", F.count("mark").over(w)).withColumn("section", F.last("mark", ignorenulls=True).over(w)).where("section_no > 0").drop("mark")


def card_days(lines: DataFrame) -> DataFrame:
    """A row a section of race-card files: path, section, series_day, race_date, title (the last line before the banner, or before the section's end where it has none), races,
    data_pending, is_cancelled, explained (it has races or says why not)."""
    here = Window.partitionBy(*of_file(lines), "section_no")
    said = F.contains(F.col("line"), F.lit(PENDING)) | F.contains(F.col("line"), F.lit(CALLED_OFF))
    d = in_sections(lines, "B").withColumn("first_race", F.min(F.when(F.col("text").rlike(CARD_HEADER), F.col("line_no"))).over(here))
    before = (F.col("first_race").isNull() | (F.col("line_no") < F.col("first_race"))) & ~said
    d = d.withColumn("programme", F.min(F.when(before & F.contains(F.col("text"), F.lit(PROGRAMME)), F.col("line_no"))).over(here))
    inside = before & (F.col("line_no") > F.col("programme"))
    d = d.withColumn("banner", F.min(F.when(inside & F.col("text").rlike(BANNER), F.col("line_no"))).over(here))
    title = inside & (F.col("text") != "") & (F.col("banner").isNull() | (F.col("line_no") < F.col("banner"))) & ~F.col("text").rlike(r"^\d\dBEND$")
    day = lambda k: F.max(F.when(F.col("line_no") == F.col("banner"), F.regexp_extract("text", BANNER, k)))
    g = d.groupBy(*of_file(lines), "section_no", "section").agg(
        day(1).cast("int").alias("series_day"), F.try_to_timestamp(F.concat_ws("-", day(2), day(3), day(4)), F.lit("y-M-d")).cast("date").alias("race_date"), F.max_by(F.when(title, F.col("text")), F.when(title, F.col("line_no"))).alias("title"),
        F.count_distinct(F.when(F.col("text").rlike(CARD_HEADER), F.regexp_extract("text", CARD_HEADER, 1))).alias("races"), F.bool_or(F.contains(F.col("line"), F.lit(PENDING))).alias("data_pending"), F.bool_or(F.contains(F.col("line"), F.lit(CALLED_OFF))).alias("is_cancelled"),
    )
    return g.withColumn("explained", (F.col("races") > 0) | F.col("data_pending") | F.col("is_cancelled")).drop("section_no", "part")


def card_rows(lines: DataFrame) -> DataFrame:
    """Entries of race-card files: path, section, race_number, race_class, distance, clock from headers, the fields of ENTRY
    from their columns; a line with a field that should be a number and isn't is no entry."""
    d, t = in_sections(lines, "B"), F.col("text")
    d = fill_down(d, of_file(d), {"head": F.when(t.rlike(CARD_HEADER), t)}, "section_no")
    part = lambda k: F.regexp_extract("head", CARD_HEADER, k)
    line = F.rpad("line", 73, " ")
    fields = {}
    for name, (start, end) in ENTRY.items():
        raw = F.trim(F.translate(F.substring(line, start + 1, end - start), "　", " "))
        fields[name] = raw if name in ENTRY_TEXT else raw.try_cast("double" if name in ENTRY_RATES else "int")
    entry = d.where(F.col("line").rlike(r"^[1-6] \d{4}") & F.col("head").isNotNull())
    e = entry.select("path", "section", part(1).cast("int").alias("race_number"), part(2).alias("race_class"), part(3).cast("int").alias("distance"), F.lpad(part(4), 5, "0").alias("clock"), *[c.alias(n) for n, c in fields.items()])
    return e.dropna(subset=[n for n in ENTRY if n not in ENTRY_TEXT])


def _results(lines: DataFrame) -> DataFrame:
    """Lines of result files within their race, with tokens, and whether each is a header, a column line or an entry."""
    d = in_sections(lines, "K")
    d = fill_down(d, of_file(d), {"head": F.when(F.col("line").rlike(RESULT_HEADER), F.col("line")), "head_no": F.when(F.col("line").rlike(RESULT_HEADER), F.col("line_no"))}, "section_no").where("head IS NOT NULL")
    tokens = F.filter(F.split("line", " "), lambda t: t != "")
    at = lambda k: F.get("tokens", F.lit(k))
    d = d.withColumn("race_number", F.regexp_extract("head", RESULT_HEADER, 1).cast("int")).withColumn("tokens", tokens)
    entry = (F.size("tokens") >= 8) & at(1).rlike("^[1-6]$") & at(2).rlike(r"^\d{4}$")
    return d.withColumn("is_head", F.col("line_no") == F.col("head_no")).withColumn("is_columns", F.col("line").rlike(COLUMNS)).withColumn("is_entry", F.coalesce(entry, F.lit(False)))


def result_races(lines: DataFrame) -> DataFrame:
    """A row a race of result files: path, section, race_number, is_cancelled (the header says so), technique (what follows the last
    column's name)."""
    d = _results(lines)
    said = F.col("is_head") & F.contains(F.regexp_replace("line", "　", ""), F.lit(CANCELLED))
    technique = F.nullif(F.trim(F.regexp_extract("line", LAST_COLUMN + r"(.*)$", 1)), F.lit(""))
    return d.groupBy("path", "section", "race_number").agg(F.bool_or(said).alias("is_cancelled"), F.max_by(F.when(F.col("is_columns"), technique), F.when(F.col("is_columns"), F.col("line_no"))).alias("technique"))


def result_rows(lines: DataFrame) -> DataFrame:
    """Entries of result files: finish (1 to 6, else null) and the raw status, lane, registration, name, motor, boat, exhibition_time,
    course, start_timing, race_time."""
    at = lambda k: F.get("tokens", F.lit(k))
    finish = at(0).try_cast("int")
    return _results(lines).where("is_entry").select(
        "path", "section", "race_number", F.when(finish.between(1, 6), finish).alias("finish"), at(0).alias("status"), at(1).cast("int").alias("lane"), at(2).cast("int").alias("registration"), F.regexp_replace(at(3), "^　+|　+$", "").alias("name"),
        at(4).try_cast("int").alias("motor"), at(5).try_cast("int").alias("boat"), at(6).try_cast("double").alias("exhibition_time"), at(7).try_cast("int").alias("course"), at(8).try_cast("double").alias("start_timing"), at(9).alias("race_time"),
    )


def payout_rows(lines: DataFrame) -> DataFrame:
    """Payouts of result files: path, section, race_number, bet_type (a label holds until the next, within its race), combination,
    amount (null unless digits), popularity, from repeated groups of combination, amount and, behind 人気, the rank."""
    d = _results(lines).where("NOT is_head AND NOT is_columns AND NOT is_entry AND size(tokens) > 0")
    first = F.get("tokens", F.lit(0))
    own = first.isin(*POOLS)
    label = F.last(F.when(own, first), ignorenulls=True).over(Window.partitionBy(*of_file(d), "section_no", "head_no").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))
    rest = F.array_join(F.when(own, F.slice("tokens", 2, F.size("tokens"))).otherwise(F.col("tokens")), " ")
    group = r"(\S+) (\S+)(?: 人気(?: (\d+))?)?"
    found = [F.regexp_extract_all("rest", F.lit(group), F.lit(k)).alias(n) for k, n in ((1, "combination"), (2, "amount"), (3, "rank"))]
    d = d.withColumn("bet_type", label).withColumn("rest", rest).where("bet_type IS NOT NULL")
    d = d.select("path", "section", "race_number", "bet_type", F.inline(F.arrays_zip(*found)))
    return d.select("path", "section", "race_number", "bet_type", "combination", F.when(F.col("amount").rlike(r"^\d+$"), F.col("amount").try_cast("long")).alias("amount"), F.col("rank").try_cast("int").alias("popularity"))


def fixed_width(lines: DataFrame, layout: list[tuple[str, int, int, str]], width: int, text: str = "line", keep: bool = False) -> tuple[DataFrame, DataFrame]:
    """layout: name, start (1-based), length, kind of int, rate10, rate100, string. Rows (with the text too where `keep`), and
    rejects of a wrong width or with an int that isn't one; a blank rate, or one that isn't digits, is null."""
    fields, wrong = [], F.length(text) != width
    for name, start, n, kind in layout:
        raw = F.trim(F.substring(text, start, n))
        if kind == "string":
            fields.append(raw.alias(name))
            continue
        value = F.when(raw.rlike(r"^-*\d+$"), raw.try_cast("int"))
        if kind == "int":
            wrong = wrong | value.isNull()
        fields.append({"int": value, "rate10": value / 10.0, "rate100": value / 100.0}[kind].alias(name))
    return lines.where(~wrong).select(*[c for c in lines.columns if keep or c != text], *fields), lines.where(wrong)


def courses(df: DataFrame, names: dict[str, list[str]], keep: list[str]) -> DataFrame:
    """Wide per-course columns to one row a course; names: output -> its six columns."""
    n = len(next(iter(names.values())))
    rows = [F.struct(F.lit(k + 1).alias("course"), *[F.col(c[k]).alias(o) for o, c in names.items()]) for k in range(n)]
    return df.select(*keep, F.inline(F.array(*rows)))


def era_date(text: Column) -> Column:
    """An era letter and YYMMDD."""
    base = None
    for letter, year in ERAS.items():
        base = F.when(F.substring(text, 1, 1) == letter, year) if base is None else base.when(F.substring(text, 1, 1) == letter, year)
    part = lambda i: F.substring(text, i, 2).try_cast("int")
    return F.try_to_timestamp(F.concat_ws("-", (base + part(2)).cast("string"), part(4).cast("string"), part(6).cast("string")), F.lit("y-M-d")).cast("date")


# fixed values: a racer period's record, in order: field, characters, kind (lines of 403 characters)
PERIOD_BASE = (
    ("registration", 4, "int"), ("name", 8, "string"), ("kana", 15, "string"), ("branch", 2, "string"), ("class", 2, "string"), ("era", 1, "string"), ("birth", 6, "string"), ("sex", 1, "int"), ("age", 2, "int"), ("height", 3, "int"), ("weight", 2, "int"), ("blood", 2, "string"),
    ("win_rate", 4, "rate100"), ("place_rate", 4, "rate10"), ("firsts", 3, "int"), ("seconds", 3, "int"), ("starts", 3, "int"), ("finals", 2, "int"), ("titles", 2, "int"), ("start_timing", 3, "rate100"),
)
PERIOD_COURSE = (("entries", 3, "int"), ("place_rate", 4, "rate10"), ("start_timing", 3, "rate100"), ("start_rank", 3, "rate100"))
PERIOD_RANKS = (("class_1", 2, "string"), ("class_2", 2, "string"), ("class_3", 2, "string"), ("index_before", 4, "rate100"), ("index", 4, "rate100"), ("year", 4, "int"), ("half", 1, "int"), ("since", 8, "string"), ("until", 8, "string"), ("training", 3, "int"))
PERIOD_STATES = ("f", "l0", "l1", "k0", "k1", "s0", "s1", "s2")
PERIOD_TAIL = (("none_l0", 2, "int"), ("none_l1", 2, "int"), ("none_k0", 2, "int"), ("none_k1", 2, "int"), ("hometown", 3, "string"))
PERIOD_WIDTH = 403


def period_layout() -> list[tuple[str, int, int, str]]:
    """name, start (1-based), length, kind of every field."""
    fields = [*PERIOD_BASE, *[(f"course{k}_{n}", w, kind) for k in range(1, 7) for n, w, kind in PERIOD_COURSE], *PERIOD_RANKS]
    for k in range(1, 7):
        fields += [(f"course{k}_finish{p}", 3, "int") for p in range(1, 7)] + [(f"course{k}_{x}", 2, "int") for x in PERIOD_STATES]
    out, at = [], 1
    for name, width, kind in [*fields, *PERIOD_TAIL]:
        out.append((name, at, width, kind))
        at += width
    return out


def period_rows(lines: DataFrame, text: str = "line") -> tuple[DataFrame, DataFrame]:
    """Rows with birth_date, since and until as dates, and rejects (the lines): another width, a field that isn't its kind, an unknown era, a date that
    is none (a birth month or day of 00 is a null date, not a reject)."""
    good, bad = fixed_width(lines, period_layout(), PERIOD_WIDTH, text, keep=True)
    open_birth = (F.substring("birth", 3, 2) == "00") | (F.substring("birth", 5, 2) == "00")
    born = era_date(F.concat("era", "birth"))
    tried = lambda c: F.try_to_timestamp(F.when(F.col(c) != "", F.col(c)), F.lit("yyyyMMdd"))
    wrong = ~F.col("era").isin(*ERAS) | ~F.col("birth").rlike(r"^\d{6}$") | (~open_birth & born.isNull())
    for c in ("since", "until"):
        wrong = wrong | ((F.col(c) != "") & (~F.col(c).rlike(r"^\d{8}$") | tried(c).isNull()))
    rows = good.where(~wrong).withColumn("birth_date", F.when(~open_birth, born)).withColumn("since", tried("since").cast("date")).withColumn("until", tried("until").cast("date")).drop("birth", text)
    return rows, bad.unionByName(good.where(wrong).select(*bad.columns))


def period_courses(rows: DataFrame, keep: list[str]) -> DataFrame:
    """Six rows a record: course, the summary fields, places and states."""
    names = [n for n, _, _ in PERIOD_COURSE] + [f"finish{p}" for p in range(1, 7)] + list(PERIOD_STATES)
    return courses(rows, {n: [f"course{k}_{n}" for k in range(1, 7)] for n in names}, keep)
