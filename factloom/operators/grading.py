"""Grading: verdicts of several validators merged into a colour."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import color_rank, rank_color


def verdict_merge(graded: DataFrame) -> DataFrame:
    """Columns from_grade, to_grade (null without a grade), from_anchor, to_anchor, floor (colours or null), violated.

    With a grade, a side is the better of grade and anchor, the whole the worse of the sides and
    the floor, red if violated. Without one, the floor, or red if violated, or null.
    """

    def side(grade: str, anchor: str) -> Column:
        return F.when(F.col(anchor).isNotNull(), F.least(color_rank(F.col(grade)), color_rank(F.col(anchor)))).otherwise(color_rank(F.col(grade)))

    floor = F.when(F.col("floor").isNotNull(), color_rank(F.col("floor")))
    sides = F.greatest(side("from_grade", "from_anchor"), side("to_grade", "to_anchor"), floor)
    has = F.col("from_grade").isNotNull()
    color = F.when(F.col("violated"), F.lit("red")).when(has, rank_color(sides)).when(floor.isNotNull(), rank_color(floor))
    return graded.withColumn("color", color).withColumn("reviewed", has)


def worst(colors: Column) -> Column:
    """Of an array: red if any, else yellow, else green."""
    return rank_color(F.coalesce(F.array_max(F.transform(colors, color_rank)), F.lit(0)))


def best(colors: Column) -> Column:
    """Of an array, nulls ignored; red if there is none."""
    known = F.filter(colors, lambda c: c.isNotNull())
    return rank_color(F.coalesce(F.array_min(F.transform(known, color_rank)), F.lit(2)))


def nonconforming(facts: DataFrame, allowed: DataFrame, keys: list[str]) -> DataFrame:
    """Facts whose kinds the ontology doesn't declare."""
    return facts.join(allowed.select(*keys).distinct(), keys, "left_anti")


def subject_labels(mentions: DataFrame) -> DataFrame:
    """mentions: doc, label, entity. Labels with one entity mentioned twice or more in a document."""
    counted = mentions.groupBy("doc", "label", "entity").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("doc", "label").agg(F.count(F.lit(1)).alias("entities"), F.sum("n").alias("mentions"), F.min("entity").alias("entity")).where("entities = 1 AND mentions >= 2").drop("entities")
