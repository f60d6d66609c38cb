"""Queries over review: what runs and their reviews give as examples."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators.harvest import harvest, signals
from factloom.plans.graph_queries import FACTS, facts
from factloom.plans.registry import query

#: Facts as raw files of three runs; what the review did to each follows from its document and place.
RUNS = f"""{FACTS}, raw AS (SELECT 'r' || doc % 3 AS run, doc, ord, CASE WHEN qty >= 25 THEN 'SUPPLIES' ELSE 'SENDS' END AS rel,
  CASE WHEN from_key % 7 = 0 THEN from_key::VARCHAR ELSE 's' || from_key % 50 END AS f, 'p' || to_key % 40 AS t, 'p' || (to_key + 1) % 40 AS t2, color, discount, (doc + ord) % 11 AS did FROM facts)"""


def _runs(spark, d):
    raw = facts(spark, d)
    text = lambda c: F.col(c).cast("string")
    named = lambda step: F.create_map(F.lit("name"), F.concat(F.lit("p"), ((F.col("to_key") + step) % 40).cast("string")))
    raw = raw.select(
        F.concat(F.lit("r"), (F.col("doc") % 3).cast("string")).alias("run"), "doc", "ord", F.concat(F.lit("t"), text("ord")).alias("triple_id"), F.when(F.col("qty") >= 25, "SUPPLIES").otherwise("SENDS").alias("rel_type"),
        F.create_map(F.lit("name"), F.when(F.col("from_key") % 7 == 0, "").otherwise(F.concat(F.lit("s"), (F.col("from_key") % 50).cast("string"))), F.lit("id"), text("from_key")).alias("from_props"), F.lit("id").alias("from_pk"),
        named(0).alias("to_props"), F.lit("id").alias("to_pk"), F.col("color").alias("triple_color"), F.when(F.col("discount") == 0.05, "agent_retry").alias("extraction_source"),
        ((F.col("doc") + F.col("ord")) % 11).alias("did"), named(1).alias("other"),
    )
    did = F.col("did")
    added = did == 3
    own = {c: F.when(added, F.col(c)) for c in ("rel_type", "from_props", "from_pk", "to_pk")}
    events = raw.where("did <= 4").select(
        "run", "doc", F.when(added, F.concat(F.lit("a"), text("ord"))).otherwise(F.col("triple_id")).alias("triple_id"), F.col("ord").alias("place"), F.when(did == 0, "REJECT").when(added, "ADD").otherwise("OVERRIDE").alias("action"),
        *[x.alias(c) for c, x in own.items()], F.when(did.isin(1, 3), F.col("other")).alias("to_props"), F.when(did.isin(1, 4), "green").when(did == 2, "red").alias("triple_color"),
    )
    return raw, events


@query(f"""WITH {RUNS}, signals AS (
    SELECT run, doc, 0 AS phase, ord AS place, 0 AS part, rel, f, t, 'suppress' AS kind, 'rejected' AS source FROM raw WHERE did = 0
    UNION ALL SELECT run, doc, 1, ord, 0, rel, f, t2, 'restore', 'add' FROM raw WHERE did = 3
    UNION ALL SELECT run, doc, 2, ord, 0, rel, f, t, 'suppress', NULL FROM raw WHERE did IN (1, 2)
    UNION ALL SELECT run, doc, 2, ord, 1, rel, f, CASE did WHEN 1 THEN t2 ELSE t END, 'none', 'override' FROM raw WHERE did IN (1, 4)
    UNION ALL SELECT run, doc, 3, ord, 0, rel, f, t, 'none', CASE WHEN discount = 0.05 THEN 'agent_retry' ELSE 'batch' END FROM raw WHERE color = 'green' AND did NOT IN (0, 1, 2, 4)),
  ids AS (SELECT *, CASE source WHEN 'add' THEN 1 WHEN 'override' THEN 2 WHEN 'agent_retry' THEN 3 WHEN 'batch' THEN 4 WHEN 'rejected' THEN 99 END AS priority, 'h' || substr(sha256(concat_ws('|', rel, f, t, source)), 1, 12) AS entry_id FROM signals),
  gone AS (SELECT rel, f, t FROM (SELECT * FROM ids WHERE kind <> 'none' QUALIFY row_number() OVER (PARTITION BY rel, f, t ORDER BY run DESC, doc DESC, phase DESC, place DESC, part DESC) = 1) WHERE kind = 'suppress'),
  entries AS (SELECT * FROM ids WHERE priority IS NOT NULL QUALIFY row_number() OVER (PARTITION BY rel, entry_id ORDER BY priority, run, doc, phase, place, part) = 1),
  pos AS (SELECT * FROM entries ANTI JOIN gone USING (rel, f, t) WHERE priority < 99 QUALIFY row_number() OVER (PARTITION BY rel ORDER BY priority, run, doc, phase, place, part) <= 20),
  neg AS (SELECT * FROM entries WHERE priority = 99 QUALIFY row_number() OVER (PARTITION BY rel ORDER BY run DESC, doc DESC, phase DESC, place DESC, part DESC) <= 3)
  SELECT rel, f AS from_display, t AS to_display, entry_id, priority FROM (FROM pos UNION ALL BY NAME FROM neg)""")
def harvest_runs(spark, d):
    """Examples from all runs' raw facts and reviews."""
    found = harvest(signals(*_runs(spark, d)))
    return found.select("rel", "key.from_display", "key.to_display", "entry_id", "priority")
