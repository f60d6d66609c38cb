"""Evaluation and run statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def prf(found: DataFrame, keys: list[str], by: list[str] | None = None) -> DataFrame:
    """found: keys, in_gold and in_pred booleans. tp, fp, fn, precision, recall, f1; 0 where a denominator is empty."""
    both, gold, pred = F.col("in_gold") & F.col("in_pred"), F.col("in_gold"), F.col("in_pred")
    sums = found.groupBy(*(by or [])).agg(F.count_if(both).alias("tp"), F.count_if(pred & ~gold).alias("fp"), F.count_if(gold & ~pred).alias("fn"))
    sums = sums.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return sums.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def compare(gold: DataFrame, pred: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer comparison of two key sets."""
    g, p = gold.select(*keys).distinct().withColumn("g", F.lit(True)), pred.select(*keys).distinct().withColumn("p", F.lit(True))
    return g.join(p, keys, "full_outer").select(*keys, F.coalesce("g", F.lit(False)).alias("in_gold"), F.coalesce("p", F.lit(False)).alias("in_pred"))


def color_histogram(facts: DataFrame, by: list[str]) -> DataFrame:
    color = F.coalesce("color", F.lit("green"))
    return facts.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), *[F.count_if(color == c).alias(c) for c in ("green", "yellow", "red")])
