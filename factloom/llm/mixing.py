"""Mixing sources to target weights by hash-random keys and distributed prefix sums.

Each document gets a random key from a hash of its id. Within a source, rows are
ranged by that key: leading digits name the range, ranges are summed, and running
sums over ranges give every row the number of words before it without bringing a
source together. A source's budget is cut exactly, at a word, after as many full
epochs as it needs.

Targets fill by weight up to a limit of ``most`` times the source's size, the
excess going to the other sources by weight: with limits sorted by limit / weight,
the filled sources are a prefix, so one running sum gives the level.

Defined results: a null text has no words; a null source is a source of its own,
last in order; rows that agree in id and size are interchangeable; an empty table
gives an empty result; a source without words has target 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.llm.common import cut, fresh, n_words

WEIGHTS = (3, 1, 2)
#: The mix has SHARE_NUM / SHARE_DEN times all words.
SHARE_NUM, SHARE_DEN = 3, 2
MOST = 2
#: Hex digits of the key that name a range: 16 ** 3 ranges a source.
RANGE_DIGITS = 3


def random_key(id_col: Column, seed: str = "mix") -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, num: int = SHARE_NUM, den: int = SHARE_DEN, most: int = MOST) -> DataFrame:
    """sizes: (source, source_size), one row each. Adds weight and target.

    The windows here run over one row per source.
    """
    every = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("rank", F.row_number().over(every) - 1)
    pick = F.element_at(F.array(*[F.lit(int(w)).cast("long") for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", pick).withColumn("cap", F.col("source_size") * most)
    # Sorted by cap / weight; ties by rank. The level holds at the first source that isn't filled.
    order = Window.orderBy((F.col("cap") / F.col("weight")), "rank")
    whole = Window.partitionBy()
    run = order.rowsBetween(Window.unboundedPreceding, -1)
    filled = ranked.select(
        "*",
        F.coalesce(F.sum("cap").over(run), F.lit(0)).alias("caps"),
        (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(run), F.lit(0))).alias("open"),
        (F.sum("source_size").over(whole) * num).alias("budget"),
        F.row_number().over(order).alias("place"),
    )
    rest = F.col("budget") - F.col("caps") * den
    fits = F.col("cap") * F.col("open") * den <= F.col("weight") * rest
    firsts = filled.withColumn("short", F.when(~fits, F.struct("place", rest.alias("rest"), "open")))
    level = F.min("short").over(whole)
    short = firsts.withColumn("level", level)
    share = (F.col("weight") * F.col("level.rest")).cast("double") / (F.col("level.open") * den).cast("double")
    target = F.when(F.col("level").isNull() | (F.col("place") < F.col("level.place")), F.col("cap").cast("double")).otherwise(share)
    return short.select("source", "source_size", "weight", target.alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, taken."""
    rows = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        n_words(F.col(f"`{text_col}`")).alias("size"),
        F.col(f"`{source_col}`").cast("string").alias("source"),
    )
    return take(cut(rows), **how)


def take(rows: DataFrame, **how) -> DataFrame:
    """rows: (doc_id, size, source), further columns are kept."""
    rows = rows.withColumn("key", random_key(F.col("doc_id"))).withColumn("range", F.substring("key", 1, RANGE_DIGITS))
    # Null-safe equal keys without a null: a join on them needs no exchange beyond the window's.
    rows = rows.withColumn("named", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")))
    ranges = rows.groupBy("named", "range").agg(F.first("source").alias("source"), F.sum("size").alias("words"))
    ranges = cut(ranges)
    sizes = ranges.groupBy("named").agg(F.first("source").alias("source"), F.sum("words").alias("source_size"))
    wanted = targets(sizes, **how).withColumn("named", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")))
    before = Window.partitionBy("named").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.select("named", "range", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("start"))
    starts = starts.join(wanted.drop("source"), "named")
    within = Window.partitionBy("named", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    ended = rows.withColumn("end", F.sum("size").over(within))
    placed = ended.join(starts, ["named", "range"])
    goal = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(F.lit(0))
    left = goal - epochs * F.col("source_size")
    more = F.least(F.greatest(left - (F.col("start") + F.col("end") - F.col("size")), F.lit(0)), F.col("size"))
    out = placed.withColumn("taken", (epochs * F.col("size") + more).cast("long"))
    return out.drop("key", "range", "named", "start", "end", "weight", "source")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The mix as documents: each as often as it is taken, all columns unchanged.

    A document that the cut divides is given whole if at least half of its words are in;
    one without words has one copy, so that no budget drops it.
    """
    spare = {c: fresh(docs, f"mix_{c}") for c in ("id", "copies")}
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document"),
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        n_words(F.col(f"`{text_col}`")).alias("size"),
        F.col(f"`{source_col}`").cast("string").alias("source"),
    )
    # The whole text stays out of the prefix sums: copies are found for the ids, then joined.
    found = take(cut(rows.drop("document")), **how)
    copies = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.floor(F.col("taken") / F.col("size") + 0.5))
    found = found.groupBy("doc_id", "size").agg(F.max(copies).cast("int").alias(spare["copies"]))
    found = found.where(F.col(spare["copies"]) > 0).withColumnRenamed("doc_id", spare["id"])
    same = rows["doc_id"].eqNullSafe(found[spare["id"]]) & (rows["size"] == found["size"])
    repeated = rows.join(found, same).select("document", F.explode(F.sequence(F.lit(1), F.col(spare["copies"]))))
    return repeated.select("document.*")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


OP6_SQL = r"""
WITH rows AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS key
  FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM rows GROUP BY source),
ranked AS (
  SELECT *, 2 * source_size AS cap,
         [3, 1, 2][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS weight,
         row_number() OVER (ORDER BY source ASC NULLS LAST) AS rank
  FROM sizes),
filled AS (
  SELECT *, coalesce(sum(cap) OVER w, 0)::BIGINT AS caps,
         (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0))::BIGINT AS open,
         (3 * sum(source_size) OVER ())::BIGINT AS budget,
         row_number() OVER (ORDER BY cap / weight, rank) AS place
  FROM ranked WINDOW w AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (
  SELECT place, budget - 2 * caps AS rest, open FROM filled
  WHERE cap * open * 2 > weight * (budget - 2 * caps) ORDER BY place LIMIT 1),
wanted AS (
  SELECT f.source, f.source_size,
         CASE WHEN l.place IS NULL OR f.place < l.place THEN f.cap::DOUBLE
              ELSE (f.weight * l.rest)::DOUBLE / (l.open * 2)::DOUBLE END AS target
  FROM filled f LEFT JOIN level l ON true),
placed AS (
  SELECT r.doc_id, r.size, w.source_size, w.target, round(w.target)::BIGINT AS goal,
         sum(r.size) OVER (PARTITION BY r.source ORDER BY r.key, r.doc_id, r.size
                           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT - r.size AS start
  FROM rows r JOIN wanted w ON r.source IS NOT DISTINCT FROM w.source)
SELECT doc_id, size, source_size, target,
       (CASE WHEN source_size > 0 THEN goal // source_size ELSE 0 END * size
        + least(greatest(goal - (CASE WHEN source_size > 0 THEN goal // source_size ELSE 0 END) * source_size - start, 0), size))::BIGINT AS taken
FROM placed
"""
