"""The domain's tables, derived from the supplied ones, for Spark and, as common table expressions, for DuckDB.

A race is an order, its entries the order's lines numbered by a total order (lanes 1..6), the racer a supplier, the
rate l_quantity / 5, the quote 1 + price / 10000, the finish a rank by (discount, price, lane); a line shipped after
the deadline, 30 days past the order, is a late feature. Payouts: the winner at its quote, with a refund row for some.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def races(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    d = o.join(c, o["o_custkey"] == c["c_custkey"])
    return d.select(F.col("o_orderkey").alias("race_id"), F.col("o_orderdate").cast("date").alias("race_date"), F.expr("o_orderdate + INTERVAL 30 DAYS").alias("deadline"), F.col("c_nationkey").cast("long").alias("venue"), F.col("o_orderpriority").alias("race_class"), (F.col("o_orderstatus") == "F").alias("finished"))


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount", "l_tax")
    d = table(spark, sf_dir, "lineitem").withColumn("lane", F.row_number().over(w).cast("long")).where("lane <= 6")
    return d.select(F.col("l_orderkey").alias("race_id"), "lane", F.col("l_suppkey").alias("racer"), F.col("l_quantity").alias("quantity"), (F.col("l_quantity") / 5).alias("rate"), (1 + F.col("l_extendedprice") / 10000).alias("odds"), F.col("l_discount").alias("disc"), F.col("l_extendedprice").alias("price"), F.col("l_shipdate").alias("available_at"), F.col("l_partkey").alias("part"), F.col("l_tax").alias("tax"))


def runners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries with their race, finish, field size and p: the rate's share of the race, by whole quantities."""
    d = entries(spark, sf_dir).join(races(spark, sf_dir), "race_id")
    w = Window.partitionBy("race_id")
    d = d.withColumn("finish", F.row_number().over(w.orderBy("disc", "price", "lane")).cast("long")).withColumn("lanes", F.count(F.lit(1)).over(w))
    return d.withColumn("p", F.col("quantity") / F.sum("quantity").over(w)).withColumn("won", F.col("finish") == 1)


def full_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runners(spark, sf_dir).where("lanes = 6")


def full_races(spark: SparkSession, sf_dir: str, parts: int) -> DataFrame:
    """race_id of the races of full_fields, each once, dealt to parts: counted, so that of lineitem only the key is read and no line is ordered."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("race_id"), F.lit(True).alias("line"))
    d = lines.unionByName(races(spark, sf_dir).select("race_id", F.lit(False).alias("line"))).where("race_id IS NOT NULL")
    # dealt before they are counted: keys repeat too little for counts ahead of the shuffle, which spill
    d = d.repartition(parts, "race_id").groupBy("race_id").agg(F.count_if("line").alias("lines"), F.count_if(~F.col("line")).alias("times"))
    return d.where(F.least("lines", F.lit(6)) * F.col("times") == 6).select("race_id")  # an order that stands more than once has its lanes as often


def payouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """race_id, combination, payout per 100: the winner's, or for every 17th race of a venue's number a refund of 70."""
    return payouts_of(full_fields(spark, sf_dir))


def payouts_of(fields: DataFrame) -> DataFrame:
    d = fields.where("won")
    refund = F.col("race_id") % 17 == 0
    return d.select("race_id", F.when(refund, "特払い").otherwise(F.col("lane").cast("string")).alias("combination"), F.when(refund, 70.0).otherwise(F.round(F.col("odds") * 90, 0)).alias("payout"))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Win candidates with price, return and hit; a quote under 1.2 counts as not priced."""
    return candidates_of(full_fields(spark, sf_dir))


def candidates_of(fields: DataFrame) -> DataFrame:
    from lanecast.operators import rules

    d = fields.withColumn("combination", F.col("lane").cast("string")).withColumn("odds", F.when(F.col("odds") >= 1.2, F.col("odds")))
    d = rules.settle(d, payouts_of(fields), ["race_id"])
    return rules.complete_grids(d, ["race_id"], F.col("odds").isNotNull(), 6)


BASE = """races AS (SELECT o_orderkey AS race_id, CAST(o_orderdate AS DATE) AS race_date, o_orderdate + INTERVAL 30 DAY AS deadline, c_nationkey::BIGINT AS venue,
  o_orderpriority AS race_class, o_orderstatus = 'F' AS finished FROM orders JOIN customer ON o_custkey = c_custkey),
entries AS (SELECT l_orderkey AS race_id, lane, l_suppkey AS racer, l_quantity AS quantity, l_quantity / 5 AS rate, 1 + l_extendedprice / 10000 AS odds, l_discount AS disc, l_extendedprice AS price, l_shipdate AS available_at, l_partkey AS part, l_tax AS tax
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity, l_discount, l_tax) AS lane FROM lineitem) WHERE lane <= 6),
runners AS (SELECT *, quantity / sum(quantity) OVER (PARTITION BY race_id) AS p, finish = 1 AS won FROM (
  SELECT *, row_number() OVER (PARTITION BY race_id ORDER BY disc, price, lane) AS finish, count(*) OVER (PARTITION BY race_id) AS lanes FROM entries JOIN races USING (race_id))),
fields AS (SELECT * FROM runners WHERE lanes = 6),
payouts AS (SELECT race_id, CASE WHEN race_id % 17 = 0 THEN '特払い' ELSE lane::VARCHAR END AS combination, CASE WHEN race_id % 17 = 0 THEN 70.0 ELSE round(odds * 90, 0) END AS payout FROM fields WHERE won),
candidates AS (SELECT *, count(odds) OVER (PARTITION BY race_id) >= 6 AS complete FROM (
  SELECT f.* REPLACE (CASE WHEN f.odds >= 1.2 THEN f.odds END AS odds), f.lane::VARCHAR AS combination, coalesce(a.payout, b.payout, 0) / 100.0 AS ret, a.payout IS NOT NULL AS hit
  FROM fields f LEFT JOIN payouts a ON a.race_id = f.race_id AND a.combination = f.lane::VARCHAR LEFT JOIN payouts b ON b.race_id = f.race_id AND b.combination = '特払い'))"""
BAND = "CASE " + " ".join(f"WHEN odds >= {a} AND odds < {b} THEN '[{a:g}, {b:g})'" for a, b in zip((1.0, 1.5, 2.0, 3.0, 4.0, 6.0, 10.0, 20.0), (1.5, 2.0, 3.0, 4.0, 6.0, 10.0, 20.0, 50.0), strict=True)) + " WHEN odds >= 50.0 THEN '[50, )' END"


def draw_sql(*parts: str) -> str:
    """The uniform of pricing.uniform."""
    return f"(('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8))::BIGINT / 4294967296.0)"
