"""Harvest of examples from review signals: last signal decides suppression, best priority decides the entry."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.functions import text as tx

#: The sources of positive examples by priority, and the priority of negative ones.
PRIORITY = {"add": 1, "override": 2, "agent_retry": 3, "batch": 4}
NEGATIVE = 99


def harvest(signals: DataFrame, positives: int = 20, negatives: int = 3) -> DataFrame:
    """signals: seq, rel, key, kind (suppress, restore or none), entry_id, priority (99: negative; null: no entry), ts.

    Suppression of a key is its last suppress or restore signal. An entry keeps its lowest priority,
    the earliest on ties. Positives of suppressed keys go; of each rel the first of each sort stay.
    """
    marks = signals.where("kind <> 'none'").groupBy("rel", "key").agg(F.max_by("kind", "seq").alias("kind"))
    gone = marks.where("kind = 'suppress'").select("rel", "key")
    entries = signals.where("priority IS NOT NULL").groupBy("rel", "entry_id").agg(F.min_by(F.struct("key", "priority", "ts", "seq"), F.struct("priority", "seq")).alias("e"))
    entries = entries.select("rel", "entry_id", "e.*")
    pos = entries.where("priority < 99").join(gone, ["rel", "key"], "left_anti")
    neg = entries.where("priority = 99")
    top = Window.partitionBy("rel").orderBy("priority", "ts", "entry_id")
    new = Window.partitionBy("rel").orderBy(F.col("ts").desc(), "entry_id")
    return pos.withColumn("place", F.row_number().over(top)).where(F.col("place") <= positives).unionByName(neg.withColumn("place", F.row_number().over(new)).where(F.col("place") <= negatives))


def signals(raw: DataFrame, events: DataFrame) -> DataFrame:
    """What harvest() folds, from the runs' raw facts and their review events; key is struct<from_display, to_display>, ts is seq.

    raw: run, doc, ord, triple_id, rel_type, from_props, from_pk, to_props, to_pk, triple_color, extraction_source.
    events, one a fact: run, doc, triple_id, place, action, and rel_type, from_props, from_pk, to_props, to_pk, triple_color:
    of an addition its own fact, of an override what it sets (null: as it was).

    In the order of runs and documents, and in each: a rejection suppresses its key and is a negative example; an addition
    restores its key; an override suppresses the key as it was if a side's name changed or it isn't green, and is an
    example as it is now if green; then green raw facts without such an event. Facts without a relation or a side's properties are no examples.
    """
    at = ["run", "doc", "triple_id"]
    fields = ["rel_type", "from_props", "from_pk", "to_props", "to_pk", "triple_color"]
    last = raw.where("triple_id <> ''").groupBy(*at).agg(F.max_by(F.struct(*fields), "ord").alias("was"))

    def shown(s: str) -> Column:
        props = F.col(f"{s}_props")
        return tx.display_name(F.try_element_at(props, F.lit("name")), F.try_element_at(props, F.col(f"{s}_pk")))

    def signal(rows: DataFrame, phase: int, part: int, place: str, kind: str, source: Column | None, always: bool = False) -> DataFrame:
        whole = (F.coalesce("rel_type", F.lit("")) != "") & (F.coalesce(F.size("from_props"), F.lit(0)) > 0) & (F.coalesce(F.size("to_props"), F.lit(0)) > 0)
        named = rows.withColumn("whole", whole).withColumn("from_display", shown("from")).withColumn("to_display", shown("to"))
        named = named if always else named.where("whole")
        example = F.lit(None).cast("string") if source is None else F.when(F.col("whole"), source)
        priority = F.coalesce(*[F.when(example == s, p) for s, p in PRIORITY.items()], F.when(example.isNotNull(), NEGATIVE))
        seq = F.struct("run", "doc", F.lit(phase).alias("phase"), F.col(place).cast("long").alias("place"), F.lit(part).alias("part"))
        out = named.select(
            seq.alias("seq"), F.coalesce("rel_type", F.lit("")).alias("rel"), F.struct("from_display", "to_display").alias("key"), F.lit(kind).alias("kind"),
            F.when(example.isNotNull(), tx.harvest_id(F.col("rel_type"), F.col("from_display"), F.col("to_display"), example)).alias("entry_id"), priority.alias("priority"), example.alias("source"),
        )
        return out.withColumn("ts", F.col("seq"))

    known = events.select(*at, "place", "action", *[F.col(c).alias(f"new_{c}") for c in fields]).join(last, at)
    before = known.select("run", "doc", "place", "action", "was.*", *[f"new_{c}" for c in fields])
    rejected = signal(before.where("action = 'REJECT'"), 0, 0, "place", "suppress", F.lit("rejected"), always=True)
    added = signal(events.where("action = 'ADD'"), 1, 0, "place", "restore", F.lit("add"))
    old = before.where("action = 'OVERRIDE'").withColumn("color", F.coalesce("new_triple_color", "triple_color", F.lit("green")))
    old = old.withColumn("old", F.struct(shown("from"), shown("to"))).withColumns({f"was_{s}_props": F.col(f"{s}_props") for s in ("from", "to")})
    new = old.withColumns({c: F.coalesce(f"new_{c}", c) for c in ("from_props", "to_props")})
    changed = new.withColumn("changed", F.col("old") != F.struct(shown("from"), shown("to")))
    gone = changed.where(F.col("changed") | F.col("color").isin("red", "yellow")).withColumns({f"{s}_props": F.col(f"was_{s}_props") for s in ("from", "to")})
    suppressed = signal(gone, 2, 0, "place", "suppress", None, always=True)
    corrected = signal(changed.where("color = 'green'"), 2, 1, "place", "none", F.lit("override"))
    decided = events.where(F.col("action").isin("REJECT", "ADD", "OVERRIDE")).select(*at)
    plain = raw.where("triple_color = 'green'").join(decided, at, "left_anti")
    retried = F.when(F.col("extraction_source") == "agent_retry", "agent_retry").otherwise("batch")
    every = [rejected, added, suppressed, corrected, signal(plain, 3, 0, "ord", "none", retried)]
    return reduce(DataFrame.unionByName, every)
