"""Exact dedup by a persistent digest index, bucketed and sorted by digest.

A batch is reduced to one row per digest, anti-joined (sort-merge) with the index, and
what is new is appended. The index side of that join needs no exchange, as it is stored
in buckets of the join key; its buckets' files are sorted, but Spark merges several files
of a bucket by sorting them again, so a batch costs a sort of the index, bucket by bucket.
``compact`` brings a bucket back to one file. Everything here is DataFrame and SQL operations.

The bucket count is kept under the index's path; whoever opens it again goes on with that
count. A batch has an id; one that was added before (a retry after a crash) gets its first
answer again, and what a crash left out is appended then.

Defined results: a null text equals the empty text; a null id loses to every
other id; of rows that agree in id and text one stays; an empty batch gives an
empty result and leaves the index as it was; further columns are ignored by
``add`` and kept by ``keep``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import cut, fresh, scratch

BUCKETS = 64
#: A digest is hot with over 1 / HOT of the rows; it is spread over SPREAD slots.
HOT, SPREAD = 200, 64


def digest(text: Column) -> Column:
    """SHA-256 of the UTF-8 text as 32 bytes."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


class DigestIndex:
    """Table (digest, keep_id, batch) under ``path``; opened again, it goes on with the bucket count that it was made with."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path = spark, path
        known = f"{path.rstrip('/')}/_buckets"  # hidden from readers of the table
        jvm = spark._jvm.org.apache.hadoop.fs
        files = jvm.Path(known).getFileSystem(spark._jsc.hadoopConfiguration())
        if files.exists(jvm.Path(known, "_SUCCESS")):
            buckets = spark.read.schema("n int").json(known).first()["n"]
        else:
            spark.range(1).selectExpr(f"{int(buckets)} AS n").coalesce(1).write.mode("overwrite").json(known)
        self.buckets = buckets
        self.name = self._named(path)

    def _named(self, path: str) -> str:
        name = f"digest_index_{uuid.uuid4().hex}"
        self.spark.sql(
            f"CREATE TABLE {name} (digest BINARY, keep_id BIGINT, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{path}'"
        )
        return name

    def close(self) -> None:
        """Take the table's name out of the catalog; the index stays under its path."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def compact(self, path: str) -> "DigestIndex":
        """The same index under another path, with one sorted file a bucket."""
        other = DigestIndex(self.spark, path, self.buckets)
        other.append(self.rows())
        return other

    def rows(self) -> DataFrame:
        return self.spark.table(self.name).hint("merge")

    def append(self, new: DataFrame) -> None:
        """Rows (digest, keep_id, batch), one for each digest."""
        (
            new.repartition(self.buckets, "digest")
            .write.mode("append").format("parquet")
            .bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.name)
        )

    def add(self, batch: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch_id: str | None = None) -> DataFrame:
        """Judge a batch against the index and itself, and append what is new.

        One row per row of the batch: doc_id, keep_id, group_size (in the batch), kept, digest. Equal texts meet only as
        counts. A digest with over 1 / HOT of the rows (there are fewer than HOT of them, and these are broadcast) is spread
        over tasks when its verdict is joined back.
        """
        tag = batch_id or uuid.uuid4().hex
        rows = (
            batch.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), digest(F.col(f"`{text_col}`")).alias("digest"))
            .groupBy("digest", "doc_id").agg(F.count(F.lit(1)).alias("copies"))
        )
        groups = cut(rows.groupBy("digest").agg(F.max("doc_id").alias("newest"), F.sum("copies").alias("group_size"), F.count(F.lit(1)).alias("n")))
        new = groups.join(self.rows().select("digest"), "digest", "left_anti")
        self.append(new.select("digest", F.col("newest").alias("keep_id"), F.lit(tag).alias("batch")))
        total = groups.agg(F.sum("n")).first()[0] or 0
        hot = groups.where(F.col("n") * HOT > total).select("digest", F.lit(SPREAD).alias("spread"))
        judged = groups.join(self.rows(), "digest").join(F.broadcast(hot), "digest", "left")
        judged = judged.select("digest", "keep_id", "group_size", "batch", F.explode(F.sequence(F.lit(0), F.coalesce("spread", F.lit(1)) - 1)).alias("slot"))
        stays = (F.col("batch") == tag) & F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
        slot = F.when(F.col("spread").isNull(), 0).otherwise(F.pmod(F.xxhash64("doc_id"), F.lit(SPREAD))).cast("int")
        return (
            rows.join(F.broadcast(hot), "digest", "left").withColumn("slot", slot)
            .join(judged, ["digest", "slot"])
            .select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
            .select("doc_id", "keep_id", "group_size", stays.alias("kept"), "digest")
        )


def keep(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, all their columns unchanged."""
    key = fresh(docs, "text_digest")
    kept = index.add(docs, id_col, text_col).where("kept").select(F.col("digest").alias(key), F.col("doc_id").alias(fresh(docs, "kept_id")))
    marked = docs.withColumn(key, digest(F.col(f"`{text_col}`")))
    same = (marked[key] == kept[key]) & F.col(f"`{id_col}`").cast("long").eqNullSafe(kept[kept.columns[1]])
    return marked.join(kept.hint("merge"), same, "left_semi").dropDuplicates([key]).drop(key)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """``keep`` against the index under path, or an empty one."""
    spark = docs.sparkSession
    return keep(docs, DigestIndex(spark, path or scratch(spark, "digest-index")), id_col, text_col)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    index = DigestIndex(spark, scratch(spark, "digest-index"))
    return index.add(docs).withColumn("text_sha256", F.lower(F.hex("digest"))).drop("digest")


OP1_SQL = """
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM (
  SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256,
         max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
         count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size
  FROM documents)
"""
