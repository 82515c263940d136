"""Monthly walk-forward folds and models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def monthly_folds(df: DataFrame, day: str, least_months: int) -> DataFrame:
    """fold, train_start, test_start, test_end (exclusive): one per month after the first `least_months` of the data."""
    months = df.select(F.trunc(day, "month").alias("m")).distinct()
    w = Window.orderBy("m")
    d = months.withColumn("fold", F.row_number().over(w)).withColumn("train_start", F.min("m").over(w))
    return d.where(F.col("fold") > least_months).select((F.col("fold") - least_months).alias("fold"), "train_start", F.col("m").alias("test_start"), F.add_months("m", 1).cast("date").alias("test_end"))


def members(df: DataFrame, day: str, folds: DataFrame) -> DataFrame:
    """Rows with their folds and part, train or test, in one range join; folds: a row a month, broadcast."""
    inside = (F.col(day) >= F.col("train_start")) & (F.col(day) < F.col("test_end"))
    d = df.join(F.broadcast(folds), inside)
    return d.withColumn("part", F.when(F.col(day) < F.col("test_start"), "train").otherwise("test"))


def check_no_overlap(train_end, test_start) -> None:
    if train_end >= test_start:
        raise ValueError("training must end before the test begins")


def fit_logistic(train: DataFrame, features: list[str], label: str, c: float = 1.0):
    """Standardised multinomial logistic regression with L2; labels 0..k-1. The penalty is 1 / (c n)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    n = train.count()
    if not n:
        raise ValueError("no training rows")
    stages = [VectorAssembler(inputCols=features, outputCol="raw_features"), StandardScaler(inputCol="raw_features", outputCol="features", withMean=True), LogisticRegression(labelCol=label, family="multinomial", regParam=1.0 / (c * n), standardization=False, maxIter=100)]
    return Pipeline(stages=stages).fit(train)


def aligned(scored: DataFrame, keys: list[str], classes: int = 6) -> DataFrame:
    """keys, lane, p for lanes 1..classes; a class the model never saw has 0."""
    from pyspark.ml.functions import vector_to_array

    p = vector_to_array("probability")
    d = scored.select(*keys, F.posexplode(F.transform(F.sequence(F.lit(1), F.lit(classes)), lambda i: F.coalesce(F.get(p, i - 1), F.lit(0.0)))))
    return d.select(*keys, (F.col("pos") + 1).alias("lane"), F.col("col").alias("p"))


def active_versions(log: DataFrame, role: str = "role") -> DataFrame:
    """Per role the latest activation and the version that a rollback goes to: the one recorded on that entry."""
    last = log.groupBy(role).agg(F.max_by(F.struct("version", "previous"), F.struct("activated_at", "entry_id")).alias("l"))
    return last.select(role, F.col("l.version").alias("active"), F.col("l.previous").alias("rollback_to"))


def normalised(df: DataFrame, group: list[str], p: str) -> Column:
    return F.col(p) / F.sum(p).over(Window.partitionBy(*group))
