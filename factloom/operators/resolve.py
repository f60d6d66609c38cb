"""Entity resolution against registry tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def cascade(candidates: DataFrame) -> DataFrame:
    """Candidates of each term's first stage that has any: one pass over (term, stage), no window over the candidates."""
    first = candidates.groupBy("term").agg(F.min("stage").alias("stage"))
    return candidates.join(first, ["term", "stage"])


def rank(candidates: DataFrame, general: str = "GENERAL", issued: str = "ISSUED") -> DataFrame:
    """GENERAL before others, ISSUED before others, then the registry's own order."""
    by = Window.partitionBy("term").orderBy(F.when(F.col("category") == general, 0).otherwise(1), F.when(F.col("status") == issued, 0).otherwise(1), "rank")
    return candidates.withColumn("place", F.row_number().over(by))


def prefilter(candidates: DataFrame) -> DataFrame:
    """term, verdict, key: none of several candidates is chosen unless one bears the term's very name."""
    exact = F.lower("name") == F.lower("term")
    sums = candidates.groupBy("term").agg(F.count("key").alias("n"), F.min("key").alias("only"), F.min(F.when(exact, F.col("key"))).alias("same"))
    verdict = F.when(F.col("n") == 0, "none").when(F.col("n") == 1, "single").when(F.col("same").isNotNull(), "exact").otherwise("ambiguous")
    return sums.select("term", "n", verdict.alias("verdict"), F.when(F.col("n") == 1, F.col("only")).otherwise(F.col("same")).alias("key"))


def unresolved(terms: DataFrame, resolved: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct terms without a resolution."""
    return terms.select(*keys).distinct().join(resolved.select(*keys), keys, "left_anti")
