"""Sharding by Karmarkar-Karp differencing, balanced by bytes, in two or more levels.

A group (equal texts) is indivisible. Groups are dealt by hash into buckets of a
bounded number; in each bucket differencing combines the partial partitions of
largest spread, oppositely ordered, until one partial partition is left. That is
itself an element of the next level, where differencing goes on over buckets.
Groups over a set share of all bytes (there can be few of them) skip the first
level. A group's shard is its place in the bucket, moved by the bucket's order.

Defined results: a null text is a group of its own size (no bytes) with the empty
text; ids may be null or repeated; an empty table gives an empty result; ties are
broken by the group's key, so reruns agree; further columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.llm.common import cut

SHARDS = 40
OVERHEAD = 16
#: Elements that one differencing run takes: groups on the first level, partial partitions above.
FIRST, FAN_IN = 4096, 32768
#: A group over 1 / (SHARDS * LARGE) of all bytes goes to the last level; there are at most SHARDS * LARGE of them.
LARGE = 512
#: Pieces in which a shard's rows are numbered.
CHUNKS = 1024


def difference(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Karmarkar-Karp over elements that are partial partitions themselves.

    sums: (elements, shards). Returns the totals of the shards and, for each element, the
    shard that each of its places goes to. An element's places are combined largest with
    smallest; ties keep the earlier element first.
    """
    n, k = sums.shape
    order = np.argsort(-sums, axis=1, kind="stable")
    now = np.take_along_axis(sums, order, axis=1)
    # members[i]: (element, place of its sorted columns in node i); a tree, resolved at the end.
    parents: list[tuple[int, int, np.ndarray] | None] = [None] * n
    rows = list(now)
    heap = [(-float(r[0] - r[-1]), i) for i, r in enumerate(rows)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        total = rows[a] + rows[b][::-1]
        by = np.argsort(-total, kind="stable")
        rows[a], rows[b] = None, None  # type: ignore[call-overload]
        rows.append(total[by])
        parents.append((a, b, by))
        heapq.heappush(heap, (-float(total[by[0]] - total[by[-1]]), len(rows) - 1))
    top = len(rows) - 1
    places: dict[int, np.ndarray] = {top: np.arange(k)}
    moved = np.zeros((n, k), dtype=np.int64)
    for node in range(top, -1, -1):
        at = places.pop(node)
        if parents[node] is None:
            moved[node][order[node]] = at
            continue
        a, b, by = parents[node]
        back = np.empty(k, dtype=np.int64)
        back[by] = at  # column j of the unsorted total goes to back[j]
        places[a], places[b] = back, back[::-1]
    return rows[top], moved


def _level(df: DataFrame, shards: int) -> DataFrame:
    """(bucket, item, sums array) -> for each item its moves, and its bucket's sums."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("item", kind="stable")
        total, moved = difference(np.stack([np.asarray(s, dtype=np.float64) for s in pdf["sums"]]))
        return pd.DataFrame({"bucket": pdf["bucket"], "item": pdf["item"], "moves": list(moved), "total": [total] * len(pdf)})

    return df.groupBy("bucket").applyInPandas(run, "bucket string, item string, moves array<long>, total array<double>")


def _first_level(groups: DataFrame, shards: int) -> DataFrame:
    """(bucket, item, bytes) -> item, place; and one row for the bucket with its sums (place null)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("item", kind="stable")
        sums = np.zeros((len(pdf), shards))
        sums[:, 0] = pdf["bytes"].to_numpy()
        total, moved = difference(sums)
        bucket = pdf["bucket"].iloc[0]
        own = pd.DataFrame({"bucket": bucket, "item": pdf["item"], "place": moved[:, 0], "sums": None})
        return pd.concat([own, pd.DataFrame({"bucket": [bucket], "item": [None], "place": [-1], "sums": [total]})])

    return groups.groupBy("bucket").applyInPandas(run, "bucket string, item string, place int, sums array<double>")


def assign_groups(groups: DataFrame, shards: int = SHARDS, fan_in: int = FAN_IN) -> DataFrame:
    """groups: (item string, bytes long), one row each. Returns (item, shard)."""
    facts = groups.agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes")).first()
    n, total = facts["n"], facts["bytes"] or 0
    large = max(1, total // (shards * LARGE))
    buckets = max(1, -(-n // (FIRST // 2)))
    bucket = F.when(F.col("bytes") >= large, F.concat(F.lit("g"), F.col("item"))).otherwise(
        F.concat(F.lit("b"), F.pmod(F.xxhash64(F.col("item")), F.lit(buckets)).cast("string"))
    )
    first = cut(_first_level(groups.withColumn("bucket", bucket), shards))
    tops = first.where("place = -1").select(F.col("bucket").alias("item"), "sums")
    count = tops.count()
    moves = None  # (item of the first level: bucket, map array)
    while count:
        width = -(-count // fan_in)
        level = _level(tops.withColumn("bucket", F.pmod(F.xxhash64(F.lit(width), F.col("item")), F.lit(width)).cast("string")), shards)
        level = cut(level)
        if moves is None:
            moves = level.select(F.col("item").alias("first_bucket"), "moves", "bucket")
        else:
            up = level.select(F.col("item").alias("bucket"), F.col("moves").alias("next"), F.col("bucket").alias("above"))
            step = F.transform("moves", lambda i: F.element_at("next", (i + 1).cast("int")))
            moves = moves.join(up, "bucket").select("first_bucket", step.alias("moves"), F.col("above").alias("bucket"))
        if width == 1:
            break
        tops = level.groupBy("bucket").agg(F.first("total").alias("sums")).select(F.col("bucket").alias("item"), "sums")
        count = width
    placed = first.where("place >= 0").select("item", F.col("bucket").alias("first_bucket"), "place")
    if moves is None:
        return placed.select("item", F.lit(0).alias("shard"))
    shard = F.element_at("moves", F.col("place") + 1).cast("int")
    return placed.join(moves, "first_bucket").select("item", shard.alias("shard"))


def shard_documents(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, shard, slot (gapless from 0 in a shard)."""
    raw = F.encode(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), "UTF-8")
    rows = cut(
        docs.select(
            F.col(f"`{id_col}`").cast("long").alias("doc_id"),
            (F.octet_length(raw) + OVERHEAD).cast("long").alias("size"),
            F.crc32(raw).alias("text_crc32"),
            F.sha2(raw, 256).alias("item"),
        )
    )
    groups = cut(rows.groupBy("item").agg(F.sum("size").alias("bytes")))
    placed = rows.join(assign_groups(groups, shards), "item")
    chunk = F.pmod(F.xxhash64("item", "doc_id"), F.lit(CHUNKS))
    chunk = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("item"), F.lit(CHUNKS))).otherwise(chunk)
    placed = cut(placed.withColumn("chunk", chunk))
    before = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("shard", "chunk").agg(F.count(F.lit(1)).alias("n"))
    starts = starts.select("shard", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("shard", "chunk").orderBy("doc_id", "item")
    return (
        placed.withColumn("at", F.row_number().over(within) - 1)
        .join(starts, ["shard", "chunk"])
        .select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("at")).cast("long").alias("slot"))
    )


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = shard_documents(docs).withColumn("law", F.lit("bytes")).withColumn("grown_shard", F.lit(None).cast("int"))
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
