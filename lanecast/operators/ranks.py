"""Exact order statistics of large groups: a mergeable quantile sketch, then one exact look at a narrow bracket."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GRID = 1000  # quantiles taken from a group's sketch
SKETCH_K = 4096  # of the KLL sketch: rank errors well below 1 / GRID
SLACK = 1  # steps of the grid on each side of the one that a rank falls in


def quantile_grid(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, n, splits: the sketch's quantiles 0, 1/GRID, ..., 1 of each group's values (doubles; nulls don't count)."""
    s = df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(SKETCH_K)).alias("s"), F.count(F.lit(1)).alias("n"))
    return s.select(*by, "n", F.kll_sketch_get_quantile_double("s", F.array(*[F.lit(k / GRID) for k in range(GRID + 1)])).alias("splits"))


def values_at(df: DataFrame, by: list[str], value: str, ranks: dict[str, Column]) -> DataFrame:
    """by, n and of each name the group's value at that rank: from 1, ascending, a Column of n.

    Three passes, none of which gathers a group: the sketches of partial groups merge to a grid; the grid brackets each
    rank; exact counts below and inside say whether the bracket holds it, else it is the whole range. Only what the brackets hold (some
    three thousandths of a group, equal values as one) is ordered. df is read three times: give one that is stored. No null in `by`."""
    x = F.col("__x")
    d = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("__x"))
    grid, (low, high) = quantile_grid(d, by, "__x"), (F.lit(float("-inf")), F.lit(float("inf")))
    on = lambda a, b: a.join(b, by) if by else a.crossJoin(F.broadcast(b))  # noqa: E731  (without groups b is one row)
    columns = [*by, "n"]
    for name, rank in ranks.items():
        step = F.floor((rank - 1) * GRID / F.col("n")).cast("int")
        lo = F.when(step - SLACK >= 0, F.get("splits", step - SLACK)).otherwise(low)
        hi = F.when(step + 1 + SLACK <= GRID, F.get("splits", step + 1 + SLACK)).otherwise(high)
        columns += [rank.cast("long").alias(f"rank_{name}"), lo.alias(f"lo_{name}"), hi.alias(f"hi_{name}")]
    bounds = grid.select(*columns)
    inside = lambda name: x.between(F.col(f"lo_{name}"), F.col(f"hi_{name}"))
    counts = on(d, bounds).groupBy(*columns[: len(by)], "n", *[f"{p}_{name}" for name in ranks for p in ("rank", "lo", "hi")])
    counts = counts.agg(*[c for name in ranks for c in (F.count_if(x < F.col(f"lo_{name}")).alias(f"below_{name}"), F.count_if(inside(name)).alias(f"in_{name}"))])
    each = []
    for name in ranks:
        rank, below = F.col(f"rank_{name}"), F.col(f"below_{name}")
        holds = (below < rank) & (rank <= below + F.col(f"in_{name}"))
        each.append(F.struct(F.lit(name).alias("name"), rank.alias("rank"), F.when(holds, F.col(f"lo_{name}")).otherwise(low).alias("lo"), F.when(holds, F.col(f"hi_{name}")).otherwise(high).alias("hi"), F.when(holds, below).otherwise(0).alias("below")))
    brackets = counts.select(*by, F.array(*each).alias("brackets"))
    held = F.filter("brackets", lambda b: x.between(b["lo"], b["hi"]))
    rows = on(d, brackets).select(*by, "__x", F.inline(held)).groupBy(*by, "name", "rank", "below", "__x").agg(F.count(F.lit(1)).alias("c"))
    upto = F.col("below") + F.sum("c").over(Window.partitionBy(*by, "name").orderBy("__x"))
    rows = rows.withColumn("upto", upto).where("upto >= rank AND upto - c < rank")
    picked = rows.groupBy(*by).agg(*[F.max(F.when(F.col("name") == name, x)).alias(name) for name in ranks])
    return on(grid.select(*by, "n"), picked)


def quantile(name: str, share: float) -> dict[str, Column]:
    """The two ranks around a continuous quantile; see interpolated."""
    at = (F.col("n") - 1) * share
    return {f"{name}_a": F.floor(at) + 1, f"{name}_b": F.ceil(at) + 1}


def interpolated(name: str, share: float) -> Column:
    at = (F.col("n") - 1) * share
    return F.col(f"{name}_a") + (F.col(f"{name}_b") - F.col(f"{name}_a")) * (at - F.floor(at))


def in_thirds(df: DataFrame, by: list[str], value: str, tie: str) -> DataFrame:
    """df with third: ntile(3) of each group in order of value and tie (a whole number below 2^53), with no window over a group.

    The cuts are the values at ranks n/3 and 2n/3, rounded up; among the rows equal to a cut, the tie at the rank that is left. df is read
    several times: give one that is stored. Rows without a value are left out. For few groups: two rows of each are broadcast."""
    d = df.where(F.col(value).isNotNull())
    cuts = thirds(d, by, value).select(*by, F.explode(F.create_map(*[x for k in (1, 2) for x in (F.lit(k), F.struct(F.ceil(k * F.col("n") / 3).alias("__rank"), F.col(f"cut_{k}").alias("__cut")))])).alias("__k", "__c"))
    cuts = cuts.select(*by, "__k", "__c.*")
    below = d.join(F.broadcast(cuts), by).groupBy(*by, "__k", "__rank", "__cut").agg(F.count_if(F.col(value) < F.col("__cut")).alias("__below"))
    at = d.join(F.broadcast(cuts), by).where(F.col(value) == F.col("__cut")).select(*by, "__k", F.col(tie).alias("__tie"))
    left = below.select(*by, "__k", "__cut", (F.col("__rank") - F.col("__below")).alias("__left"))
    last = values_at(at.join(F.broadcast(left), [*by, "__k"]), [*by, "__k", "__cut", "__left"], "__tie", {"__last": F.col("__left")})
    pivot = last.groupBy(*by).agg(*[F.max(F.when(F.col("__k") == k, F.struct(F.col("__cut").alias("v"), F.col("__last").alias("t")))).alias(f"__cut_{k}") for k in (1, 2)])
    upto = lambda k: (F.col(value) < F.col(f"__cut_{k}.v")) | ((F.col(value) == F.col(f"__cut_{k}.v")) & (F.col(tie) <= F.col(f"__cut_{k}.t")))
    d = d.join(F.broadcast(pivot), by).withColumn("third", F.when(upto(1), 1).when(upto(2), 2).otherwise(3).cast("long"))
    return d.drop("__cut_1", "__cut_2")


def third(value: Column) -> Column:
    """1, 2, 3 by the cuts of `thirds`; equal values share one."""
    return F.when(value <= F.col("cut_1"), 1).when(value <= F.col("cut_2"), 2).otherwise(3).cast("long")


def thirds(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, n, cut_1, cut_2: the values at ranks n/3 and 2n/3, rounded up."""
    return values_at(df, by, value, {"cut_1": F.ceil(F.col("n") / 3), "cut_2": F.ceil(2 * F.col("n") / 3)})
