"""Operator 9: mixing sources to target weights by Sainte-Laguë apportionment (DataFrame functions only).

Sources in code-point order (null last) weigh 3, 1, 2, repeating, and share `share` times all sizes; a target
stops at `most` times its source's size and the excess goes to the others by weight. Targets become blocks of
`block` words: sources, then the shards of each source, get whole blocks by highest quotients size / (2k - 1).
In a shard the documents, in seeded order, are one stream of words cut into equal blocks; of m blocks, a quota q
takes block j ((j + 1) q + s) div m - (j q + s) div m times, s seeded: q takes in all, evenly spread, none more
than `most` times. A document's words taken follow from its place in the stream in closed form, so the cost
doesn't depend on the block.

Null or empty text: size 0, nothing taken. Repeated rows: each has its own place in the stream. A source without
words has target 0. Empty table: no rows. Other columns are ignored. Very long texts: their words are
counted whole. Ties of place in the seeded order: by id (null last), then size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanecast.llm.common import WORD, documents, fresh

WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2
BLOCK = 16
SHARD_WORDS = 1_000_000
SEED = "mix-1"


def seeded(*parts: Column) -> Column:
    """32 bits that depend on the seed and the parts alone."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(SEED), *[F.coalesce(p.cast("string"), F.lit("~null")) for p in parts])), 1, 8), 16, 10).cast("long")


def targets(sizes: DataFrame, share: float = SHARE, most: int = MOST, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """sizes: source, source_size. Adds target: min(level * weight, most * size), at the level that shares everything out.

    In order of cap / weight, sources are full as long as the level that the rest would get exceeds theirs.
    """
    whole = Window.partitionBy()
    nth = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (nth % len(weights) + 1).cast("int"))
    d = sizes.withColumn("weight", weight).withColumn("cap", (F.lit(most) * F.col("source_size")).cast("double"))
    by_fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = by_fill.rowsBetween(Window.unboundedPreceding, -1), by_fill.rowsBetween(0, Window.unboundedFollowing)
    level = (F.lit(share) * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    d = d.withColumn("level", level).withColumn("fill", F.row_number().over(by_fill))
    first = F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("fill"))
    d = d.withColumn("level", F.min_by("level", first).over(whole))
    return d.select("source", "source_size", F.least(F.coalesce(F.col("level") * F.col("weight"), F.col("cap")), F.col("cap")).alias("target"))


def sainte_lague(parties: DataFrame, group: list[str], order: list[str], votes: str, seats: str) -> DataFrame:
    """Adds `quota`: the group's seats, given one by one to the highest quotient votes / (2k - 1).

    With n parties, the divisor votes / (seats - n/2) gives no party more than its final quota and
    votes / (seats + n/2) none less, so only quotients between those two bounds, about n of them, are ranked.
    """
    g = Window.partitionBy(*group)
    d = parties.withColumn("__all", F.sum(votes).over(g)).withColumn("__n", F.count(F.lit(1)).over(g))
    at = lambda s: F.greatest(F.lit(0), F.floor(F.col(votes) * s / F.col("__all") + 0.5)).cast("long")
    low, high = F.col(seats) - F.col("__n") / 2, F.col(seats) + F.col("__n") / 2
    d = d.withColumn("__low", F.when((F.col("__all") > 0) & (low > 0), F.greatest(at(low) - 1, F.lit(0))).otherwise(F.lit(0)).cast("long"))
    d = d.withColumn("__high", F.when(F.col("__all") > 0, at(high) + 1).otherwise(F.lit(0)).cast("long"))
    open_seats = F.sum("__low").over(g)
    d = d.withColumn("__open", F.col(seats) - open_seats)
    keys = [*group, *order]
    q = d.where(F.col("__high") > F.col("__low")).select(*keys, "__open", votes, F.explode(F.sequence(F.col("__low") + 1, F.col("__high"))).alias("__k"))
    rank = F.row_number().over(g.orderBy((F.col(votes) / (2 * F.col("__k") - 1)).desc(), *[F.col(c).asc_nulls_last() for c in order], "__k"))
    won = q.withColumn("__rank", rank).where(F.col("__rank") <= F.col("__open")).groupBy(*keys).agg(F.count(F.lit(1)).alias("__won"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in keys]
    joined = d.alias("a").join(won.alias("b"), same, "left")
    return joined.select(*[f"a.{c}" for c in parties.columns], (F.col("__low") + F.coalesce(F.col("__won"), F.lit(0))).alias("quota"))


def taken_before(x: Column, q: Column, m: Column, s: Column, block: int) -> Column:
    """Words taken of the stream's first x words."""
    j = F.floor(x / block)
    copies = lambda k: F.floor((k * q + s) / m)
    return (copies(j) - F.floor(s / m)) * block + (x - j * block) * (copies(j + 1) - copies(j))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = SHARE, most: int = MOST, block: int = BLOCK, shard_words: int = SHARD_WORDS) -> DataFrame:
    """doc_id, source, size, source_size, target, taken; one row per row of df."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size"))
    per_source = targets(docs.groupBy("source").agg(F.sum("size").alias("source_size")), share, most)
    blocks = per_source.withColumn("__one", F.lit(1)).withColumn("blocks", F.round(F.sum("target").over(Window.partitionBy("__one")) / block).cast("long"))
    blocks = sainte_lague(blocks, ["__one"], ["source"], "target", "blocks")
    per_source = blocks.select("source", "source_size", "target", F.col("quota").alias("source_blocks"), F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)).cast("long").alias("shards"))
    d = docs.alias("d").join(per_source.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
    d = d.select("doc_id", "d.source", "size", "source_size", "target", "source_blocks", seeded(F.lit("order"), F.col("doc_id")).alias("place"), (seeded(F.lit("shard"), F.col("doc_id")) % F.col("shards")).alias("shard"))
    per_shard = d.groupBy("source", "shard", "source_blocks").agg(F.sum("size").alias("words"))
    per_shard = sainte_lague(per_shard, ["source"], ["shard"], "words", "source_blocks")
    m = F.ceil(F.col("words") / block)
    per_shard = per_shard.select("source", "shard", m.alias("m"), F.least(F.col("quota"), most * m).alias("q"), F.when(m > 0, seeded(F.lit("start"), F.col("source"), F.col("shard")) % m).otherwise(F.lit(0)).alias("s"))
    end = F.sum("size").over(Window.partitionBy("source", "shard").orderBy("place", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, 0))
    d = d.withColumn("end", end).alias("d").join(per_shard.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d.shard") == F.col("p.shard")))
    w = lambda x: taken_before(x, F.col("q"), F.col("m"), F.col("s"), block)
    taken = F.when((F.col("m") > 0) & (F.col("size") > 0), w(F.col("end")) - w(F.col("end") - F.col("size"))).otherwise(F.lit(0)).cast("long")
    return d.select("doc_id", F.col("d.source").alias("source"), "size", "source_size", "target", taken.alias("taken"))


def take(df: DataFrame) -> DataFrame:
    """The rows of df as often as the mix takes them, with all their columns: taken / size times, whole documents;
    what is beyond whole times is decided by a seeded draw on the id. Documents without words aren't taken."""
    doc, copies, nth = fresh(df, "doc", "copies", "nth")
    taken = mix(df).groupBy("doc_id").agg((F.sum("taken") / F.nullif(F.sum("size"), F.lit(0))).alias("times"))
    draw = seeded(F.lit("draw"), F.col("doc_id")) / F.lit(float(1 << 32))
    whole = F.floor("times")
    taken = taken.select(F.col("doc_id").alias(doc), (whole + (draw < F.col("times") - whole).cast("int")).cast("int").alias(copies)).where(F.col(copies) > 0)
    rows = df.join(taken, F.col("doc_id").eqNullSafe(F.col(doc))).withColumn(nth, F.explode(F.sequence(F.lit(1), F.col(copies))))
    return rows.select(*[f"`{c}`" for c in df.columns])


def op9_mix_sources(spark, sf_dir):
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


QUERIES = {"op9_mix_sources": op9_mix_sources}
_SEEDED = "CAST('0x' || substr(md5(concat_ws(':', '" + SEED + "', {0})), 1, 8) AS BIGINT)"
_LAGUE = """{name}0 AS (SELECT *, sum({votes}) OVER g AS va, count(*) OVER g AS n FROM {source} WINDOW g AS (PARTITION BY {group})),
{name}1 AS (SELECT *, CASE WHEN va > 0 THEN CAST(floor({votes} * (seats + n / 2) / va) + 2 AS BIGINT) ELSE 0 END AS hi FROM {name}0),
{name}2 AS (SELECT * FROM (SELECT {group}, {key}, seats, {votes}, unnest(range(1, hi + 1)) AS k FROM {name}1)
  QUALIFY row_number() OVER (PARTITION BY {group} ORDER BY {votes} / (2 * k - 1) DESC, {key} NULLS LAST, k) <= seats),
{name} AS (SELECT a.*, coalesce(b.quota, 0) AS quota FROM {source} a LEFT JOIN (SELECT {group}, {key}, count(*) AS quota FROM {name}2 GROUP BY ALL) b
  ON a.{group} IS NOT DISTINCT FROM b.{group} AND a.{key} IS NOT DISTINCT FROM b.{key})"""
SQL = {
    "op9_mix_sources": f"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size FROM documents),
z AS (SELECT source, sum(size)::BIGINT AS source_size, 1 AS one FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0 ELSE 2.0 END AS weight, {MOST} * source_size::DOUBLE AS cap FROM z),
l AS (SELECT *, ({SHARE}::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
  row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS fill FROM w),
t AS (SELECT source, one, source_size, least(coalesce(arg_min(level, CASE WHEN level <= cap / weight THEN fill END) OVER () * weight, cap), cap) AS target FROM l),
b AS (SELECT *, CAST(round(sum(target) OVER () / {BLOCK}) AS BIGINT) AS seats FROM t),
{_LAGUE.format(name="qs", source="b", group="one", key="source", votes="target")},
x AS (SELECT d.doc_id, d.source, d.size, q.source_size, q.target, q.quota AS seats, {_SEEDED.format("'order', coalesce(d.doc_id::VARCHAR, '~null')")} AS place,
  {_SEEDED.format("'shard', coalesce(d.doc_id::VARCHAR, '~null')")} % greatest(1, CAST(ceil(q.source_size / {SHARD_WORDS}) AS BIGINT)) AS shard FROM d JOIN qs q ON d.source IS NOT DISTINCT FROM q.source),
h AS (SELECT source, shard, seats, sum(size)::BIGINT AS words FROM x GROUP BY ALL),
{_LAGUE.format(name="qh", source="h", group="source", key="shard", votes="words")},
p AS (SELECT source, shard, CAST(ceil(words / {BLOCK}) AS BIGINT) AS m, quota FROM qh),
r AS (SELECT source, shard, m, least(quota, {MOST} * m) AS q, CASE WHEN m > 0 THEN {_SEEDED.format("'start', coalesce(source, '~null'), shard::VARCHAR")} % m ELSE 0 END AS s FROM p),
e AS (SELECT *, sum(size) OVER (PARTITION BY source, shard ORDER BY place, doc_id NULLS LAST, size ROWS UNBOUNDED PRECEDING)::BIGINT AS hi FROM x),
y AS (SELECT e.*, r.m, r.q, r.s, unnest([hi, hi - size]) AS pos, unnest([1, -1]) AS sign FROM e JOIN r ON e.source IS NOT DISTINCT FROM r.source AND e.shard = r.shard WHERE m > 0),
v AS (SELECT *, ((pos // {BLOCK} * q + s) // m) * {BLOCK} + (pos % {BLOCK}) * (((pos // {BLOCK} + 1) * q + s) // m - (pos // {BLOCK} * q + s) // m) AS words FROM y)
SELECT doc_id, size, source_size, round(target, 6) AS target, CAST(sum(sign * words) AS BIGINT) AS taken FROM v GROUP BY doc_id, size, source_size, target"""
}
