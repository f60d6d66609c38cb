"""A lookup cache as an append-only table: service, cache_key, value, created_at. The latest row of a key counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["service", "cache_key"]
#: Days until a value expires.
TTL_DAYS = 30


def key(*parts: Column) -> Column:
    """Parts of a key as a JSON list."""
    return F.to_json(F.array(*[p.cast("string") for p in parts]))


def fresh(cache: DataFrame, now: Column, ttl_days: float = TTL_DAYS) -> DataFrame:
    """One row for each key whose latest value hasn't expired; a time to live of 0 keeps all."""
    latest = cache.groupBy(*KEY).agg(F.max_by(F.struct("value", "created_at"), F.struct("created_at", "value")).alias("w"))
    rows = latest.select(*KEY, "w.value", "w.created_at")
    age = now.cast("timestamp").cast("double") - F.col("created_at").cast("timestamp").cast("double")
    return rows.where(age <= ttl_days * 86400) if ttl_days else rows


def lookup(requests: DataFrame, cache: DataFrame, now: Column, ttl_days: float = TTL_DAYS) -> DataFrame:
    """Each distinct request (service, cache_key) with its value, and whether it was a hit; a stored null is a hit."""
    kept = fresh(cache, now, ttl_days).select(*KEY, "value", F.lit(True).alias("hit"))
    return requests.select(*KEY).distinct().join(kept, KEY, "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def read_through(requests: DataFrame, cache: DataFrame, registry: DataFrame, now: Column, ttl_days: float = TTL_DAYS) -> tuple[DataFrame, DataFrame]:
    """(values of all requests, rows to append to the cache): misses are taken from the registry (service, cache_key, value)."""
    found = lookup(requests, cache, now, ttl_days)
    new = found.where("NOT hit").select(*KEY).join(registry.select(*KEY, "value"), KEY, "left")
    return found.where("hit").select(*KEY, "value").unionByName(new), new.withColumn("created_at", now.cast("timestamp"))
