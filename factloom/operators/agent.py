"""What a reviewing agent calls: line search, evidence highlighting, and the merge of its facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from factloom.functions import text as tx
from factloom.operators import grounding

LINE_END = r"\r\n|[\n\x0B\x0C\r\x1C-\x1E\x{85}\x{2028}\x{2029}]"
#: Kinds of highlight; the first that covers a place shows.
KINDS = ("subject", "object", "quote")
#: Fields in which an agent's blank leaves the earlier value.
KEPT = ("supporting_quote", "from_term", "to_term", "from_meta", "to_meta")


def stripped_lines(text: Column) -> Column:
    lines = F.transform(F.split(text, LINE_END, -1), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.filter(lines, lambda x: x != "")


def _spaced(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_replace(text, r"^\s+|\s+$", "")), r"\s+", " ")


def line_hits(text: Column, wanted: Column, most: int = 5) -> Column:
    """The first distinct lines, stripped, that hold wanted, whatever the case and spacing; none for a blank one."""
    has = lambda x: _spaced(x).contains(_spaced(wanted))
    found = F.slice(F.array_distinct(F.filter(stripped_lines(text), has)), 1, most)
    return F.when(_spaced(wanted) != "", found).otherwise(F.array().cast("array<string>"))


def line_search(rows: DataFrame, most: int = 5) -> DataFrame:
    """rows: text, wanted. Adds lines: line_hits; without any, the line around the place where wanted is located as a quote."""
    hits = rows.withColumn("lines", line_hits(F.col("text"), F.col("wanted"), most))
    # In steps: as one expression each use of the span would work it out anew.
    lined = hits.withColumn("line", F.when((F.size("lines") == 0) & (_spaced(F.col("wanted")) != ""), grounding.joined(F.col("text"))))
    found = lined.withColumn("way", grounding.way(F.col("wanted"), F.col("line")))
    found = found.withColumn("span", F.when(F.col("way").isNotNull(), grounding.span_of(F.col("text"), F.col("line"), F.col("way"))))
    before = F.substring_index(F.substring(F.col("text"), F.lit(1), F.col("span.start")), "\n", -1)
    inside = grounding.reanchor(F.col("text"), F.col("span"))
    after = F.substring_index(F.substring(F.col("text"), F.col("span.end") + 1, F.length("text")), "\n", 1)
    around = found.withColumn("around", F.regexp_replace(F.concat(before, inside, after), r"^\s+|\s+$", ""))
    lines = F.when(F.col("around") != "", F.array("around")).otherwise(F.col("lines"))
    return around.select(*rows.columns, lines.alias("lines"))


def occurrences(docs: DataFrame, term: str, kind: str) -> DataFrame:
    """(doc_id, start, end, kind) of each occurrence of the column term in text, whatever the case, left to right without overlaps.

    Terms of fewer than two characters have none.
    """
    bare = F.lower(F.regexp_replace(F.col(term), r"^\s+|\s+$", ""))
    pattern = F.concat(F.lit(r"\Q"), F.replace("bare", F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    rows = docs.select("doc_id", F.lower("text").alias("low"), bare.alias("bare"))
    parts = F.when(F.length("bare") >= 2, F.transform(F.split("low", pattern, -1), F.length))
    # Outer, as for an inner explode the optimiser tests the array's size first, which would work it out twice.
    found = rows.select("doc_id", F.length("bare").alias("n"), F.explode_outer(_starts(parts, F.length("bare"))).alias("start")).where("start IS NOT NULL")
    return found.select("doc_id", "start", (F.col("start") + F.col("n")).alias("end"), F.lit(kind).alias("kind"))


def _starts(lengths: Column, n: Column) -> Column:
    """Where the separators of n characters begin between parts of these lengths. Kept in blocks, so that an array that grows isn't copied for each."""
    none = F.array().cast("array<int>")
    zero = F.struct(F.lit(0).alias("at"), none.alias("block"), F.array().cast("array<array<int>>").alias("done"))

    def add(acc: Column, start: Column) -> Column:
        room = F.size(acc["block"]) < 128
        block = F.when(room, F.array_append(acc["block"], start)).otherwise(F.array(start))
        return F.struct((start + n).alias("at"), block.alias("block"), F.when(room, acc["done"]).otherwise(F.array_append(acc["done"], acc["block"])).alias("done"))

    step = lambda acc, length: tx.let(acc["at"] + length, lambda start: add(acc, start))
    return tx.let(lengths, lambda own: F.slice(F.aggregate(own, zero, step, lambda acc: F.flatten(F.array_append(acc["done"], acc["block"]))), F.lit(1), F.size(own) - 1))


def trusted(spans: DataFrame, docs: DataFrame) -> DataFrame:
    """Spans (doc_id, start, end, text) that still hold their text; others are located anew, or go."""
    both = spans.withColumnRenamed("text", "said").join(docs.select("doc_id", "text"), "doc_id")
    holds = (F.col("start") >= 0) & (F.col("start") < F.col("end")) & (F.col("end") <= F.length("text")) & (F.substring(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start")) == F.col("said"))
    given = F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"))
    return both.select("doc_id", F.when(holds, given).otherwise(grounding.locate(F.col("said"), F.col("text"))).alias("s")).where("s IS NOT NULL").select("doc_id", "s.start", "s.end")


def highlight(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, start, end, kind or null): each text cut at every edge of its spans (doc_id, start, end, kind).

    A sweep: edges of one place are summed, running sums tell what covers the piece up to the next edge.
    """
    edge = lambda at, step: spans.select("doc_id", F.col(at).alias("start"), *[F.when(F.col("kind") == k, step).otherwise(0).alias(k) for k in KINDS])
    ends = docs.select("doc_id", F.explode(F.array(F.lit(0), F.length("text"))).alias("start"), *[F.lit(0).alias(k) for k in KINDS])
    # Dealt by document once, for the sums as for the windows.
    cuts = ends.unionByName(edge("start", 1)).unionByName(edge("end", -1)).repartition("doc_id").groupBy("doc_id", "start").agg(*[F.sum(k).alias(k) for k in KINDS])
    by = Window.partitionBy("doc_id").orderBy("start")
    swept = cuts.select("doc_id", "start", F.lead("start").over(by).alias("end"), *[F.sum(k).over(by).alias(k) for k in KINDS]).where(F.col("end").isNotNull())
    return swept.select("doc_id", "start", "end", F.coalesce(*[F.when(F.col(k) > 0, F.lit(k)) for k in KINDS]).alias("kind"))


def merge(earlier: DataFrame, agent: DataFrame, id_col: str = "_id") -> DataFrame:
    """Facts of an agent take the place of earlier ones of the same id, or are added.

    Blank KEPT fields leave the earlier value; rel_props are united, the agent's first; extraction_source
    becomes agent_retry. Ids are unique in both; rows without one stay or are added. Columns are those of earlier.
    """
    theirs = agent.select(*[F.col(c).alias(f"agent_{c}") for c in agent.columns], F.lit(True).alias("is_agent"))
    both = earlier.join(theirs, F.col(id_col) == F.col(f"agent_{id_col}"), "full_outer")
    out = []
    for f in earlier.schema.fields:
        c = f.name
        old, new = F.col(c), F.col(f"agent_{c}") if c in agent.columns else F.lit(None).cast(f.dataType)
        if c == "extraction_source":
            new = F.lit("agent_retry")
        elif c in KEPT:
            blank = F.size(new) == 0 if isinstance(f.dataType, (T.MapType, T.ArrayType)) else new == "" if isinstance(f.dataType, T.StringType) else F.lit(False)
            new = F.coalesce(F.when(~blank, new), old)
        elif c == "rel_props":
            some = lambda m: F.coalesce(m, F.create_map().cast(f.dataType))  # noqa: B023, E731
            theirs_too = some(new)
            new = F.map_concat(F.map_filter(some(old), lambda k, v: ~F.map_contains_key(theirs_too, k)), theirs_too)  # noqa: B023
        out.append(F.when(F.col("is_agent"), new).otherwise(old).alias(c))
    return both.select(*out)


def add_triples(asked: DataFrame, docs: DataFrame, relations: list[str], labels: dict[str, list[str]], known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Facts an agent adds: (those accepted, one a key of their document), (doc, seq, error of those refused).

    asked: doc, seq (its order), rel_type, from_label, from_pk, from_props, from_term, to_label, to_pk, to_props, to_term,
    rel_props (map of strings), rel_lists (map of lists), supporting_quote; docs: doc, text; labels: each kind of node with
    the vocabularies it allows (none: any); known: cui, sabs.

    Refused, by the first that holds: an unknown relation or kind; a code known only in vocabularies not allowed; a side
    without its key; a quote not in the text beside a term not in it. A quote is kept in the text's own words. Later
    facts of a key give it their quotes: one that is in the text replaces one that isn't, or is added if not held
    already; one that isn't is kept, and flagged, only where there is none. Properties of a later fact win, lists are united.
    A property is a string in all facts of a key or a list in all. Facts of one key of one document meet in one
    row: as many as an agent's session adds.
    """
    empty = lambda kind: F.create_map().cast(kind)
    strings, lists = "map<string,string>", "map<string,array<string>>"
    rows = asked.withColumn("rel_props", F.coalesce("rel_props", empty(strings))).withColumn("rel_lists", F.coalesce("rel_lists", empty(lists)))
    own = F.nullif(F.coalesce("supporting_quote", F.lit("")), F.lit(""))
    rows = rows.withColumn("quote", F.coalesce(own, F.try_element_at("rel_props", F.lit("supporting_quote")), F.lit("")))
    rows = rows.withColumn("rel_props", F.when(own.isNull(), F.map_filter("rel_props", lambda k, _: k != "supporting_quote")).otherwise(F.col("rel_props")))
    allowed = F.create_map(*[F.lit(x) for label, vocabularies in labels.items() for x in (label, vocabularies)]).cast(lists)
    for s in ("from", "to"):
        sabs = known.select(F.col("cui").alias(f"{s}_cui"), F.col("sabs").alias(f"{s}_sabs"))
        rows = rows.withColumn(f"{s}_cui", F.nullif(F.try_element_at(f"{s}_props", F.lit("cui")), F.lit(""))).join(sabs, f"{s}_cui", "left")
    rows = rows.join(docs.select("doc", "text"), "doc", "left").withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.withColumn("anchored", F.when(F.col("quote") != "", grounding.reanchor(F.col("text"), grounding.locate(F.col("quote"), F.col("text")))))
    rows = rows.withColumn("unlocated", (F.col("quote") != "") & F.col("anchored").isNull()).withColumn("quote", F.coalesce("anchored", "quote"))

    def kind(s: str) -> Column:
        return F.when(~F.coalesce(F.col(f"{s}_label").isin(*labels), F.lit(False)), F.concat(F.lit("unknown kind "), F.coalesce(f"{s}_label", F.lit(""))))

    def vocabulary(s: str) -> Column:
        may = F.coalesce(F.try_element_at(allowed, F.col(f"{s}_label")), F.array().cast("array<string>"))
        sabs = F.coalesce(f"{s}_sabs", F.array().cast("array<string>"))
        return F.when((F.size(may) > 0) & (F.size(sabs) > 0) & ~F.arrays_overlap(sabs, may), F.concat(F.lit("vocabulary of "), f"{s}_label"))

    def key(s: str) -> Column:
        return F.when(~F.coalesce(F.map_contains_key(F.col(f"{s}_props"), F.col(f"{s}_pk")), F.lit(False)), F.lit(f"{s} side without key"))

    def grounded(s: str) -> Column:
        term = F.trim(F.coalesce(f"{s}_term", F.lit("")))
        return F.when(F.col("unlocated") & (term != "") & ~grounding.entity_in_text(term, F.col("text")), F.lit(f"{s} term not in the text"))

    relation = F.when(~F.coalesce(F.col("rel_type").isin(*relations), F.lit(False)), F.concat(F.lit("unknown relation "), F.coalesce("rel_type", F.lit(""))))
    rows = rows.withColumn("error", F.coalesce(relation, *[check(s) for check in (kind, vocabulary, key, grounded) for s in ("from", "to")]))
    refused = rows.where("error IS NOT NULL").select("doc", "seq", "error")
    rows = rows.where("error IS NULL")
    rows = rows.withColumns({f"{s}_key": F.element_at(f"{s}_props", F.col(f"{s}_pk")) for s in ("from", "to")})

    def quoted(acc: Column, x: Column) -> Column:
        bare = F.regexp_replace(x["quote"], r"[. ]+$", "")
        put = lambda quote, unlocated: F.struct(quote.alias("quote"), unlocated.alias("unlocated"))
        joined = F.when(acc["quote"] == "", x["quote"]).otherwise(F.regexp_replace(F.concat(acc["quote"], F.lit(" / "), x["quote"]), r"^[ /]+|[ /]+$", ""))
        replace = ~x["unlocated"] & acc["unlocated"]
        more = ~x["unlocated"] & (bare != "") & ~acc["quote"].contains(bare)
        first = x["unlocated"] & (F.trim(acc["quote"]) == "")
        return F.when((x["quote"] != "") & (replace | first), put(x["quote"], x["unlocated"])).when((x["quote"] != "") & more, put(joined, F.lit(False))).otherwise(acc)

    def united(acc: Column, x: Column) -> Column:
        both = lambda _, a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(F.concat(a, F.filter(b, lambda v: ~F.array_contains(a, v))))
        return F.map_zip_with(acc, x["rel_lists"], both)

    by = ["doc", "rel_type", "from_key", "to_key"]
    firsts = ["from_label", "from_pk", "from_props", "from_term", "to_label", "to_pk", "to_props", "to_term"]
    met = rows.groupBy(*by).agg(
        F.array_sort(F.collect_list(F.struct("seq", "quote", "unlocated")), lambda a, b: F.when(a["seq"] < b["seq"], -1).when(a["seq"] > b["seq"], 1).otherwise(0)).alias("quotes"),
        F.array_sort(F.collect_list(F.struct("seq", "rel_props", "rel_lists")), lambda a, b: F.when(a["seq"] < b["seq"], -1).when(a["seq"] > b["seq"], 1).otherwise(0)).alias("props"),
        F.min_by(F.struct("seq", *firsts), "seq").alias("first"),
    )
    said = F.aggregate("quotes", F.struct(F.lit("").alias("quote"), F.lit(False).alias("unlocated")), quoted)
    props = F.aggregate("props", empty(strings), lambda acc, x: F.map_zip_with(acc, x["rel_props"], lambda _, a, b: F.coalesce(b, a)))
    added = met.select(*by, "first.seq", *[f"first.{c}" for c in firsts], props.alias("rel_props"), F.aggregate("props", empty(lists), united).alias("rel_lists"), said.alias("said"))
    terms = {f"{s}_term": F.nullif(F.trim(f"{s}_term"), F.lit("")) for s in ("from", "to")}
    return added.withColumn("supporting_quote", F.nullif("said.quote", F.lit(""))).withColumn("quote_unlocatable", F.col("said.unlocated")).drop("said").withColumns(terms), refused
