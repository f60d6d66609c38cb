"""Review: what a reviewer submits, turned into events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators import build

#: Characters of a quote that a warning shows.
SHOWN = 120


def _map(c: str) -> Column:
    return F.coalesce(F.col(c), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))


def review_events(submitted: DataFrame, added: DataFrame, raw: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Events, warnings (doc, triple_id, quote) and stale documents (doc).

    submitted: doc, raw_hash, triple_id, action, from_props, to_props, rel_props, triple_color, supporting_quote; added: doc, raw_hash,
    triple_id, rel_type, from_label, from_pk, from_props, to_label, to_pk, to_props, rel_props; raw: doc, triple_id,
    supporting_quote; docs: doc, text, raw_hash.

    Nothing of a document is stored if any row of it was made from another raw file (by hash, where one is given). Accepted
    facts need no event. A changed quote of an override is stored, in the text's own words, only if the text has
    it; else it is a warning. Additions without a relation or a side's properties are skipped; an added fact
    is green on all sides, and without an id gets one from its content.
    """
    now = docs.select("doc", F.col("raw_hash").alias("now"))
    hashes = submitted.select("doc", "raw_hash").unionByName(added.select("doc", "raw_hash"))
    stale = hashes.where("raw_hash <> ''").join(now, "doc").where("raw_hash <> now").select("doc").distinct()
    fresh, more = submitted.join(stale, "doc", "left_anti"), added.join(stale, "doc", "left_anti")
    before = raw.select("doc", "triple_id", F.trim(F.coalesce("supporting_quote", F.lit(""))).alias("before"))
    changed = fresh.where("action = 'OVERRIDE'").join(before, ["doc", "triple_id"], "left").withColumn("asked", F.trim(F.coalesce("supporting_quote", F.lit(""))))
    differs = (F.col("asked") != "") & (F.col("asked") != F.coalesce("before", F.lit("")))
    spans = changed.withColumn("differs", differs).join(docs.select("doc", "text"), "doc", "left")
    spans = spans.withColumn("spans", F.when(F.col("differs"), build.evidence(F.array("asked"), F.coalesce("text", F.lit("")))))
    located = F.coalesce(F.try_element_at("spans", F.lit(1))["start"].isNotNull(), F.lit(False))
    spans = spans.withColumn("evidence", F.when(located, F.col("spans")))
    none = lambda kind: F.lit(None).cast(kind)
    texts = ["rel_type", "from_label", "from_pk", "to_label", "to_pk", "from_color", "to_color"]
    override = spans.select(
        "doc", "triple_id", "action", *[_map(c).alias(c) for c in ("from_props", "to_props", "rel_props")], F.nullif("triple_color", F.lit("")).alias("triple_color"),
        F.array_join(F.col("evidence.text"), " / ").alias("supporting_quote"), "evidence", *[none("string").alias(c) for c in texts],
    )
    maps = "map<string,string>"
    reject = fresh.where("action = 'REJECT'").select(
        "doc", "triple_id", "action", *[none(maps).alias(c) for c in ("from_props", "to_props", "rel_props")], none("string").alias("triple_color"), none("string").alias("supporting_quote"),
        none("array<struct<start:int,end:int,text:string>>").alias("evidence"), *[none("string").alias(c) for c in texts],
    )
    whole = more.where("rel_type <> '' AND size(from_props) > 0 AND size(to_props) > 0")
    content = F.to_json(F.struct("doc", "rel_type", "from_label", "to_label", *[F.array_sort(F.map_entries(c)).alias(c) for c in ("from_props", "to_props")]))
    green = F.lit("green")
    add = whole.select(
        "doc", F.coalesce(F.nullif("triple_id", F.lit("")), F.concat(F.lit("add_"), F.substring(F.sha2(content, 256), 1, 8))).alias("triple_id"), F.lit("ADD").alias("action"), "from_props", "to_props",
        F.map_concat(F.map_filter(_map("rel_props"), lambda k, _: k != "manually_added"), F.create_map(F.lit("manually_added"), F.lit("true"))).alias("rel_props"), green.alias("triple_color"),
        none("string").alias("supporting_quote"), none("array<struct<start:int,end:int,text:string>>").alias("evidence"),
        *[F.coalesce(c, F.lit("")).alias(c) for c in texts[:5]], green.alias("from_color"), green.alias("to_color"),
    )
    warned = spans.where(F.col("differs") & F.col("evidence").isNull()).select("doc", "triple_id", F.substring("asked", 1, SHOWN).alias("quote"))
    return reject.unionByName(override).unionByName(add), warned, stale
