"""Facts to a property graph: nodes merge by key (first write wins), edges belong to their document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def first_write(rows: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """For each key the columns of its earliest row: a partial aggregate, so a frequent key doesn't gather."""
    best = F.min_by(F.struct(*columns), F.struct(*order))
    return rows.groupBy(*keys).agg(best.alias("w")).select(*keys, *[F.col(f"w.{c}").alias(c) for c in columns])


def last_write(rows: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    best = F.max_by(F.struct(*columns), F.struct(*order))
    return rows.groupBy(*keys).agg(best.alias("w")).select(*keys, *[F.col(f"w.{c}").alias(c) for c in columns])


def upsert_nodes(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Stored nodes stay as they are; new keys are added."""
    return stored.unionByName(new.join(stored.select(*keys), keys, "left_anti"))


def replace_edges(stored: DataFrame, new: DataFrame, identity: list[str]) -> DataFrame:
    """New edges take the place of stored ones of the same identity."""
    return stored.join(new.select(*identity), identity, "left_anti").unionByName(new)


def delete_edges(stored: DataFrame, gone: DataFrame, identity: list[str]) -> DataFrame:
    return stored.join(gone.select(*identity).distinct(), identity, "left_anti")


def merge_edges(facts: DataFrame, keys: list[str], order: list[str], first: list[str], listed: list[str], last: list[str]) -> DataFrame:
    """One edge per key: first columns of the earliest item, lists concatenated in order, last non-null of the others."""
    by = F.struct(*order)
    out = [F.min_by(c, by).alias(c) for c in first]
    out += [F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct(*order, F.col(c).alias("item"))))), lambda s: s["item"]).alias(c) for c in listed]
    out += [F.max_by(c, F.when(F.col(c).isNotNull(), by)).alias(c) for c in last]
    return facts.groupBy(*keys).agg(*out)


def match_edges(edges: DataFrame, sources: DataFrame, targets: DataFrame, on_from: Column, on_to: Column) -> DataFrame:
    """One-hop pattern: two equi-joins, endpoints that are missing drop the edge."""
    return edges.join(sources, on_from).join(targets, on_to)


def paths(edges: DataFrame, start: DataFrame, most: int) -> DataFrame:
    """(start, node, hops): nodes reached in up to most hops, by their least number of hops. edges: a, b; start: node."""
    front = start.select(F.col("node").alias("start"), "node", F.lit(0).alias("hops"))
    seen = front
    for hop in range(1, most + 1):
        front = front.join(edges, front["node"] == edges["a"]).select("start", F.col("b").alias("node"), F.lit(hop).alias("hops")).distinct()
        front = front.join(seen.select("start", "node"), ["start", "node"], "left_anti")  # nodes reached before aren't walked on again
        seen = seen.unionByName(front)
    return seen


def duplicates(facts: DataFrame, keys: list[str], order: list[str], id_col: str) -> DataFrame:
    """Second and later facts of a key, with the id of the first."""
    by = Window.partitionBy(*keys).orderBy(*order)
    return facts.withColumn("first_id", F.first(id_col).over(by)).withColumn("nth", F.row_number().over(by)).where("nth > 1")


def materialize(facts: DataFrame, events: DataFrame, identity: list[str], fields: dict[str, str]) -> DataFrame:
    """Apply a review log: REJECT drops, OVERRIDE replaces the fields that the event has, ADD appends; others keep.

    fields: fact column -> event column; a field is present if the event's has_<column> is true.
    """
    change = events.where("action <> 'ADD'").select(*identity, "action", *fields.values(), *[f"has_{e}" for e in fields.values()])
    joined = facts.join(change, identity, "left").where("action IS NULL OR action <> 'REJECT'")
    over = {f: F.when((F.col("action") == "OVERRIDE") & F.col(f"has_{e}"), F.col(e)).otherwise(F.col(f)) for f, e in fields.items()}
    kept = joined.withColumns(over).select(*facts.columns)
    added = events.where("action = 'ADD'").select(*identity, *[F.col(e).alias(f) for f, e in fields.items()])
    return kept.unionByName(added, allowMissingColumns=True)
