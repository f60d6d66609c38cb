"""Deterministic validators of facts, each a DataFrame operator with its rules as parameters, and the merge of their verdicts.

A validator gives rows (triple_id, validator, floor, violated, from_anchor, to_anchor, note): at most one per fact, only for
facts it has something to say about. ``merge_verdicts`` combines any number of them with a table of grades.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import text as tx
from factloom.operators import grading, grounding

VERDICT = ("floor", "violated", "from_anchor", "to_anchor", "note")
# Fixed values that results depend on: relations that should point at a condition, and marks of a diagnostic procedure.
TREAT_LIKE = ("MAY_TREAT", "TREATS", "INDICATED_FOR", "PREVENTS", "MAY_PREVENT", "USED_FOR", "HAS_INDICATION", "APPROVED_FOR")
PROCEDURES = (
    "detection of", "detection and identification", "detection", "measurement of", "measurement and", "measurement", "assay", "assay for",
    "screening for", "screening of", "screening", "monitoring of", "monitoring", "assessment of", "assessment", "analysis of", "analysis",
    "testing for", "testing", "diagnosis of", "diagnosis", "diagnostic test", "multiplex amplified", "probe technique", "imaging",
)
#: Sources that say nothing about a vocabulary.
NEUTRAL_SOURCES = ("MTH", "SRC", "")


def verdict(found: DataFrame, validator: str, floor: Column | None = None, violated: Column | None = None, note: Column | None = None, anchors: tuple[Column, Column] | None = None) -> DataFrame:
    empty = F.lit(None).cast("string")
    a, b = anchors or (empty, empty)
    return found.select(
        "triple_id", F.lit(validator).alias("validator"), (empty if floor is None else floor).alias("floor"), (F.lit(False) if violated is None else violated).alias("violated"),
        a.alias("from_anchor"), b.alias("to_anchor"), (empty if note is None else note).alias("note"),
    )


def accepted_names(resolved: Column, raw: Column, source: Column, synonyms: Column) -> Column:
    """Names that prove an entity: the resolved one, vetted synonyms, and the document's own term unless a registry may have given another company for it."""
    own = F.when((raw != "") & (F.lower(raw) != F.lower(resolved)) & ((source != "gleif") | ~tx.suspicious_name(raw, resolved)), raw)
    return F.array_distinct(F.filter(F.concat(F.array(resolved, own), F.coalesce(synonyms, F.array().cast("array<string>"))), lambda n: F.coalesce(n != "", F.lit(False))))


def named_in(names: Column, quote: Column) -> Column:
    """Whether some name is located in some segment of a quote."""
    lines = F.transform(tx.grader_quotes(quote), lambda s: grounding.joined(s))
    return F.coalesce(tx.let(names, lambda own: F.exists(lines, lambda line: F.exists(own, lambda n: grounding.way(n, line).isNotNull()))), F.lit(False))


def entity_presence(facts: DataFrame) -> DataFrame:
    """facts: triple_id, supporting_quote, and for each side <side>_name, _term, _source, _synonyms. Green anchors of the sides that are named."""
    green = lambda side: F.when(named_in(accepted_names(*[F.col(f"{side}_{x}") for x in ("name", "term", "source", "synonyms")]), F.col("supporting_quote")), F.lit("green"))
    found = facts.select("triple_id", green("from").alias("a"), green("to").alias("b")).where("a IS NOT NULL OR b IS NOT NULL")
    return verdict(found, "entity_presence", anchors=(F.col("a"), F.col("b")))


def relation_hints(facts: DataFrame, negation: str) -> DataFrame:
    """A note where a segment names both sides, another where such a segment has a cue of negation."""
    both = F.filter(tx.grader_quotes(F.col("supporting_quote")), lambda s: grounding.way(F.col("from_name"), grounding.joined(s)).isNotNull() & grounding.way(F.col("to_name"), grounding.joined(s)).isNotNull())
    found = facts.select("triple_id", both.alias("both")).where(F.size("both") > 0)
    note = F.concat(F.lit("[both named in one segment]"), F.when(F.exists("both", lambda s: F.lower(s).rlike(negation)), F.lit(" [possible negation]")).otherwise(F.lit("")))
    return verdict(found, "relation_hints", note=note)


def structural(facts: DataFrame, keys: list[str]) -> DataFrame:
    """An empty key (name, else key, of either side) floors red; second and later facts of equal keys get a note."""
    empty = (F.coalesce(F.trim("from_name"), F.lit("")) == "") | (F.coalesce(F.trim("to_name"), F.lit("")) == "")
    # The first fact of a key is a partial aggregate, so that a frequent key isn't gathered in a window.
    firsts = facts.groupBy(*[F.col(k).alias(f"first_{k}") for k in keys]).agg(F.min("triple_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    own = facts.select("triple_id", *{"from_name", "to_name", *keys})
    same = [own[k].eqNullSafe(firsts[f"first_{k}"]) for k in keys]
    joined = own.join(firsts, same, "left")
    note = F.when(F.col("first_id") < F.col("triple_id"), F.concat(F.lit("[duplicate of "), F.col("first_id").cast("string"), F.lit("]")))
    found = joined.select("triple_id", F.when(empty, F.lit("red")).alias("f"), note.alias("d")).where("f IS NOT NULL OR d IS NOT NULL")
    return verdict(found, "structural", floor=F.col("f"), note=F.col("d"))


def schema_conformance(facts: DataFrame, allowed: DataFrame, keys: list[str]) -> DataFrame:
    """Undeclared kinds of edges are red and violate; without declarations there is nothing to say."""
    found = grading.nonconforming(facts, allowed, keys)
    found = found.join(F.broadcast(allowed.limit(1).select(F.lit(1).alias("declared"))))  # one row, or none
    return verdict(found, "schema_conformance", F.lit("red"), F.lit(True), F.lit("[not in the ontology]"))


def plausibility(facts: DataFrame, relations: tuple[str, ...] = TREAT_LIKE, markers: tuple[str, ...] = PROCEDURES) -> DataFrame:
    """A note where a relation of treating points at a procedure: the first marker in its name."""
    marker = F.try_element_at(F.filter(F.array(*map(F.lit, markers)), lambda m: F.lower("to_name").contains(m)), F.lit(1))
    found = facts.where(F.col("rel_type").isin(*relations)).select("triple_id", marker.alias("m")).where("m IS NOT NULL")
    return verdict(found, "plausibility", note=F.concat(F.lit("[procedure: "), F.col("m"), F.lit("]")))


def semantic_types(facts: DataFrame, expected: DataFrame) -> DataFrame:
    """facts: from_label, from_types, from_vocab (and to_); expected: (label, types, vocabs). Types known and disjoint are red and violate; another vocabulary is a note."""
    out = facts.select("triple_id", *[f"{s}_{x}" for s in ("from", "to") for x in ("label", "types", "vocab")])
    bad, other = [], []
    for s in ("from", "to"):
        own = expected.select(F.col("label").alias(f"{s}_label"), F.col("types").alias(f"{s}_want"), F.col("vocabs").alias(f"{s}_allowed"))
        out = out.join(own, f"{s}_label", "left")
        bad.append(F.coalesce((F.size(f"{s}_want") > 0) & (F.size(f"{s}_types") > 0) & ~F.arrays_overlap(f"{s}_want", f"{s}_types"), F.lit(False)))
        other.append(F.coalesce((F.size(f"{s}_allowed") > 0) & ~F.col(f"{s}_vocab").isin(*NEUTRAL_SOURCES) & ~F.array_contains(f"{s}_allowed", F.col(f"{s}_vocab")), F.lit(False)))
    parts = [F.when(b, F.lit(f"{s} type")) for s, b in zip(("from", "to"), bad, strict=True)] + [F.when(o, F.lit(f"{s} vocabulary")) for s, o in zip(("from", "to"), other, strict=True)]
    found = out.select("triple_id", (bad[0] | bad[1]).alias("v"), F.array_join(F.array_compact(F.array(*parts)), "; ").alias("n")).where("n <> ''")
    return verdict(found, "semantic_types", F.when(F.col("v"), F.lit("red")), F.col("v"), F.col("n"))


def fabricated_quote(facts: DataFrame, source: str = "agent_retry") -> DataFrame:
    """Facts of that extraction source with a quote none of whose spans is located: red, no violation."""
    lost = (F.col("extraction_source") == source) & (F.trim("supporting_quote") != "") & (F.size("evidence") > 0) & F.forall("evidence", lambda e: e["start"].isNull())
    return verdict(facts.where(lost), "fabricated_quote", F.lit("red"), note=F.lit("[quote not found in the document]"))


def harvest_rejection(facts: DataFrame, rejected: DataFrame, keys: tuple[str, ...] = ("rel_type", "from_name", "to_name")) -> DataFrame:
    """Facts that reviewers rejected before, by relation and both names."""
    found = facts.join(rejected.select(*keys).distinct(), list(keys), "left_semi")
    return verdict(found, "harvest_rejection", F.lit("red"), F.lit(True), F.lit("[rejected before]"))


def merge_verdicts(facts: DataFrame, verdicts: DataFrame, grades: DataFrame) -> DataFrame:
    """facts: triple_id; grades: triple_id, from_grade, to_grade, grade_violated, opinion. One row per fact: color, violated, opinion, reviewed.

    All of a fact's verdicts count: the worst floor, any violation, a green anchor from any, notes in the validators' order.
    """
    floor = F.max(F.when(F.col("floor").isNotNull(), tx.color_rank(F.col("floor"))))
    notes = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("note").isNotNull(), F.struct("validator", "note")))), lambda n: n["note"]), " ")
    summed = verdicts.groupBy("triple_id").agg(floor.alias("f"), F.bool_or("violated").alias("v"), F.max("from_anchor").alias("from_anchor"), F.max("to_anchor").alias("to_anchor"), notes.alias("notes"))
    joined = facts.select("triple_id").join(summed, "triple_id", "left").join(grades, "triple_id", "left")
    joined = joined.withColumn("floor", F.when(F.col("f").isNotNull(), tx.rank_color(F.col("f")))).withColumn("violated", F.coalesce("v", F.lit(False)) | F.coalesce("grade_violated", F.lit(False)))
    graded = grading.verdict_merge(joined)
    opinion = F.trim(F.concat_ws(" ", F.when(F.col("reviewed"), F.col("opinion")), F.when(F.col("notes") != "", F.col("notes"))))
    return graded.select("triple_id", "color", "violated", opinion.alias("opinion"), "reviewed")
