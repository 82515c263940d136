"""Cell and label parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The full-width block that the formats use.
WIDE = "".join(chr(0xFF01 + k) for k in range(94)) + "　"
NARROW = "".join(chr(0x21 + k) for k in range(94)) + " "


def narrow(text: Column) -> Column:
    """Full-width ASCII and the ideographic space to their ASCII forms."""
    return F.translate(text, WIDE, NARROW)


def class_label(text: Column) -> Column:
    """Without white space (U+3000 too) and without the fixed-entry note."""
    return F.regexp_replace(F.regexp_replace(text, r"[\s　]+", ""), "進入固定", "")


def fixed_entry(text: Column) -> Column:
    return F.contains(F.regexp_replace(text, r"[\s　]+", ""), F.lit("進入固定"))


def race_phase(label: Column) -> Column:
    """Ordered rules over a title; the first that holds names the phase."""
    t = class_label(label)

    def any_of(*words: str) -> Column:
        out = F.lit(False)
        for w in words:
            out = out | F.contains(t, F.lit(w))
        return out

    final = any_of("優勝", "決勝") | F.endswith(t, F.lit("ファイナル")) | F.endswith(t, F.lit("優"))
    return (
        F.when(any_of("進出", "準々"), "qualifier")
        .when(any_of("準優", "準決勝"), "semifinal")
        .when(final, "final")
        .when(any_of("決定") & ~any_of("順位", "代表"), "final")
        .when(any_of("予選"), "trial")
        .when(any_of("選抜", "特選", "特賞"), "selection")
        .when(any_of("一般"), "general")
        .otherwise("unknown")
    )


def standing_seeded(phase: Column) -> Column:
    return phase.isin("semifinal", "final")


def class_rank(label: Column) -> Column:
    # fixed values
    ranks = {"A1": 4.0, "A2": 3.0, "B1": 2.0, "B2": 1.0}
    out = None
    for name, rank in ranks.items():
        out = F.when(F.trim(label) == name, rank) if out is None else out.when(F.trim(label) == name, rank)
    return out


def odds_cell(text: Column) -> Column:
    """struct<low, high>: "5.6" has a low only, "2.0-2.8" both; not a number or under 1.0 is null."""
    parts = F.split(F.trim(text), "-")
    quote = lambda i: F.when(F.get(parts, F.lit(i)).try_cast("double") >= 1.0, F.get(parts, F.lit(i)).try_cast("double"))
    return F.struct(quote(0).alias("low"), quote(1).alias("high"))


def start_timing(text: Column) -> Column:
    """struct<seconds, flying>: ".11" is 0.11, "F.01" is 0.01 and flying; blank is null and not flying."""
    t = F.upper(F.trim(text))
    number = F.regexp_extract(t, r"^[FL]?(\d*\.\d+)$", 1)
    return F.struct(F.when(number != "", F.concat(F.lit("0"), number).try_cast("double")).alias("seconds"), F.coalesce(F.startswith(t, F.lit("F")), F.lit(False)).alias("flying"))


def with_unit(text: Column) -> Column:
    """A number followed by kg, ℃, cm or m."""
    return F.regexp_replace(F.trim(text), r"\s*(kg|℃|cm|m)$", "").try_cast("double")


def reading_is_safe(label: Column, race_number: Column) -> Column:
    """A surface reading "N R時点" of an earlier race."""
    n = F.regexp_extract(narrow(label), r"^\s*(\d+)\s*R時点", 1).try_cast("int")
    return F.coalesce(n < race_number, F.lit(False))


def yen(amount: Column) -> Column:
    return F.concat(F.format_number(amount, 0), F.lit("円"))


def percentage(share: Column) -> Column:
    return F.concat(F.format_number(share * 100, 1), F.lit("%"))
