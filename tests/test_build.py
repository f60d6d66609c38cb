"""The build step, validators and text rules on small cases."""

import pytest
from pyspark.sql import functions as F

from factloom.functions import text as tx
from factloom.operators import build, graph, grounding, validators
from factloom.sources import files


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("entity", "text", "want"),
    [
        ("Smith-Jones Inc", "as jones said", True), ("Zeta Group", "the group said", True), ("caf bar", "a café here", False), ("Acme Corp", "we saw ACME there", True),
        ("R&D Lab", "the r&d team", True), ("", "anything", False), ("Xy", "foxy", True), ("Qz Inc", "included", False),
    ],
)
def test_entity_in_text(spark, entity, text, want):
    assert one(spark, grounding.entity_in_text(F.col("e"), F.col("t")), e=entity, t=text) is want


def test_text_rules(spark):
    ids = spark.createDataFrame([("R", None, "a"), ("R", "a", None), ("R", "a", "")], "r string, a string, b string")
    assert ids.select(tx.fact_id(F.col("r"), F.col("a"), F.col("b")).alias("x")).distinct().count() == 3
    span = one(spark, grounding.locate(F.col("q"), F.col("t")), q="the café is", t="so the café is open")
    assert (span["start"], span["end"]) == (3, 15)
    assert one(spark, tx.composed(F.col("t")), t="ế ñ x") == "ế ñ x"
    assert one(spark, tx.multi_quotes(F.col("q")), q="a b / 1 c • d - e-f / ") == ["a b", "1 c", "d", "e-f"]
    assert one(spark, tx.evidence_level(F.lit("strong"), F.lit("short"))) == "moderate"
    assert one(spark, tx.evidence_level(F.lit("moderate"), F.lit(" "))) == "weak"
    for term, name, want in [("Quanta", "QUANTA LYON", True), ("TDK", "TDK CORPORATION", False), ("TSMC", "TSMC Partners", False), ("Novo", "Novo A/S", False), ("Quanta", "Other Quanta", False)]:
        assert one(spark, tx.suspicious_name(F.col("t"), F.col("n")), t=term, n=name) is want
    assert one(spark, tx.extra_words(F.col("t"), F.col("n")), t="TSMC", n="TSMC Partners, Ltd.") and not one(spark, tx.extra_words(F.col("t"), F.col("n")), t="TDK", n="TDK Corporation")
    assert one(spark, tx.occurrences(F.col("t"), "aa"), t="aaab aa") == [1, 2, 6]


def test_items_and_evidence(spark):
    text = "First line here.\nThe drug treats fever well.\nAlso used for pain.\n"
    rows = [(1, "drug treats fever"), (2, "First line / used for pain"), (3, "not there"), (4, ""), (5, "First line / not there")]
    items = spark.createDataFrame(rows, "id int, quote string").withColumn("text", F.lit(text))
    strict = {r.id: (r.anchored, r.kept) for r in build.verify_items(items, "strict").collect()}
    assert strict[1] == ("drug treats fever", True) and strict[2] == ("First line / used for pain", True)
    assert not any(strict[i][1] for i in (3, 4, 5))
    assert {r.id for r in build.verify_items(items, "moderate").where("warned").collect()} == {3, 5}
    spans = one(spark, build.evidence(F.array(F.lit("used for"), F.lit(" "), F.lit("used for"), F.lit("nowhere")), F.col("t")), t=text)
    assert [(s["start"], s["text"]) for s in spans] == [(text.index("used for"), "used for"), (None, "nowhere")]
    assert one(spark, build.rescued(F.array(F.lit("First line")), F.lit("fever"), F.col("t")), t=text) == "The drug treats fever well."
    assert one(spark, build.rescued(F.array(F.lit("treats fever")), F.lit("fever"), F.col("t")), t=text) is None
    quoted = spark.createDataFrame([("e", 1, "b"), ("e", 2, "a"), ("e", 3, "b"), ("e", 4, " "), ("f", 1, None)], "k string, o int, quote string")
    assert {r.k: r.quotes for r in build.merge_items(quoted, ["k"], ["o"]).collect()} == {"e": ["b", "a"], "f": []}


def test_presence_and_merge(spark):
    schema = "triple_id int, supporting_quote string, from_name string, from_term string, from_source string, from_synonyms array<string>, to_name string, to_term string, to_source string, to_synonyms array<string>"
    rows = [
        (1, "x / the kidney stone hurts", "Drug", "Drug", "llm", None, "Nephrolithiasis", "kidney stone", "umls", None),
        (2, "Quanta makes it", "QUANTA LYON", "Quanta", "gleif", [], "It", "It", "llm", []),
        (3, "Big Blue sells", "IBM", "IBM", "gleif", ["Big Blue"], "None", "", "llm", []),
    ]
    found = {r.triple_id: (r.from_anchor, r.to_anchor) for r in validators.entity_presence(spark.createDataFrame(rows, schema)).collect()}
    assert found == {1: (None, "green"), 2: (None, "green"), 3: ("green", None)}
    v = spark.createDataFrame([(1, "a", "red", False, None, None, "n1"), (1, "b", None, False, "green", None, "n2"), (2, "a", None, True, None, None, None), (3, "a", None, False, None, None, "note")], "triple_id int, validator string, floor string, violated boolean, from_anchor string, to_anchor string, note string")
    grades = spark.createDataFrame([(1, "red", "green", False, "text")], "triple_id int, from_grade string, to_grade string, grade_violated boolean, opinion string")
    got = {r.triple_id: (r.color, r.opinion, r.reviewed) for r in validators.merge_verdicts(spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "triple_id int"), v, grades).collect()}
    assert got == {1: ("red", "text n1 n2", True), 2: ("red", "", False), 3: (None, "note", False), 4: (None, "", False)}


def test_service_rules(spark):
    assert build.read_only(spark, "WITH t AS (SELECT 1 AS a) SELECT a FROM t WHERE 'DROP' <> 'x' ORDER BY a LIMIT 3").count() == 1
    for sql in ("DROP TABLE IF EXISTS nothing", "CREATE TABLE zz AS SELECT 1", "INSERT INTO t VALUES (1)", "SET a = b", "WITH t AS (SELECT 1) INSERT INTO zz SELECT * FROM t"):
        with pytest.raises(PermissionError):
            build.read_only(spark, sql)
    assert build.identifier("a_1") == "a_1"
    with pytest.raises(ValueError):
        build.identifier("1a; x")
    assert {(r.truncated) for r in build.capped(spark.range(5), 3).collect()} == {True} and build.capped(spark.range(3), 3).count() == 3
    raw = spark.createDataFrame([(1, '{"a": 1, "triple_color": "red"}'), (2, '{"b": 1, "x": 2, "triple_color": "blue"}'), (3, "no")], "row int, value string")
    errors = {(r.row, r.error) for r in build.contract_errors(raw, {"a": "int", "b": "int?", "triple_color": "string?"}).collect()}
    assert errors == {(2, "extra x"), (2, "missing a"), (2, "bad triple_color"), (3, "no object")}
    bad = spark.createDataFrame([(1, "R", "A", "id", {"id": "1"}, "B", "id", {"no": "2"})], "triple_id int, rel_type string, from_label string, from_pk string, from_props map<string,string>, to_label string, to_pk string, to_props map<string,string>")
    with pytest.raises(ValueError, match="to key"):
        build.require_fields(bad)
    assert build.drift(["id", "zz"], spark.range(1)) == ["zz"] and build.known_columns(spark.range(1), ["x"])[1] == ["id"]


def test_groups_and_paths(spark):
    groups = spark.createDataFrame([("PHYS", "Physiology", "T1", "a"), ("XX", "PHYS", "T2", "b"), ("DISO", "Disorders", "T3", "c")], "abbr string, name string, tui string, type_name string")
    assert {r.tui for r in files.group_types(groups, "PHYS").collect()} == {"T2"}
    assert {r.tui for r in files.group_types(groups, "diso").collect()} == {"T3"}
    assert {(r.tui, r.type_name) for r in files.type_codes(["T1", "c", "zz"], groups, "PHYS").collect()} == {("T1", "a"), ("T3", "c"), (None, "zz")}
    edges = spark.createDataFrame([(1, 2), (2, 1), (2, 3)], "a int, b int")
    assert {(r.node, r.hops) for r in graph.paths(edges, spark.createDataFrame([(1,)], "node int"), 5).collect()} == {(1, 0), (2, 1), (3, 2)}


@pytest.mark.parametrize("chars", [5, 6, 7, 8, 10])
def test_estimate_rounds_as_its_sql(spark, tmp_path, chars):
    import duckdb

    from factloom.plans import registry

    spark.createDataFrame([(1, "x" * chars), (2, "skipped")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(2,)], "doc_id long").write.parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    assert tuple(registry.queries()["build_estimate"](spark, str(tmp_path)).first()) == con.execute(registry.oracle_sql()["build_estimate"]).fetchone()


def test_documents_stay_where_they_are(spark):
    """Few quotes meet documents without a shuffle; many by a join on words, with the same spans, one a pair and document row."""
    texts = ["The “Red” fox\n-- ran over *the* hill. Then it slept.", "nothing here", "a: one two, three -- red fox", "", None, "a: one two, three -- red fox"]
    docs = spark.createDataFrame([(i % 5, t) for i, t in enumerate(texts)], "doc_id int, text string")
    quotes = spark.createDataFrame([(1, "red fox ran … it slept"), (2, "one *two* three: red fox"), (3, "absent"), (4, ""), (5, "fox -- ran")], "quote_id int, quote string")
    few, many = grounding.located(quotes, docs), grounding.located(quotes, docs, few=0)
    assert "hashpartitioning" not in few._jdf.queryExecution().executedPlan().toString()
    spans = sorted((r.quote_id, r.doc_id, r.evidence) for r in few.collect())
    assert spans == [(1, 0, "Red” fox\n-- ran over *the* hill. Then it slept"), (2, 0, "one two, three -- red fox"), (2, 2, "one two, three -- red fox"), (5, 0, "fox\n-- ran")]
    assert sorted(few.collect()) == sorted(many.collect())


def test_occurrences_without_shuffle(spark):
    """Places of a term are worked out in the document's own row, also where they fill several blocks."""
    from factloom.operators import agent

    docs = spark.createDataFrame([(1, "ab.. " * 300 + "x", "AB"), (2, "abab", "ab"), (3, "aaa", "a"), (4, None, "ab"), (5, r"q\E q\E", r" q\E "), (6, "none", "ab")], "doc_id int, text string, term string")
    found = agent.occurrences(docs, "term", "subject")
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    places = {}
    for r in found.collect():
        places.setdefault(r.doc_id, []).append((r.start, r.end))
    assert {k: sorted(v) for k, v in places.items()} == {1: [(5 * i, 5 * i + 2) for i in range(300)], 2: [(0, 2), (2, 4)], 5: [(0, 3), (4, 7)]}


def test_review_quality_without_expanding(spark):
    facts = spark.createDataFrame([(1, 1, "green"), (1, 2, "red"), (2, 1, None)], "doc long, ord int, color string")
    events = spark.createDataFrame([(1, 2, "REJECT"), (2, 1, "ADD")], "doc long, ord int, action string")
    active = facts.join(events.where("action = 'REJECT'"), ["doc", "ord"], "left_anti")
    found = build.review_quality(facts, active, events)
    assert "Expand" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.collect()), key=str) == [(1, 2, 1, 0, 0, 1, 0, 1), (2, 1, 1, 0, 0, 0, 1, 2), (None, 3, 2, 0, 0, 1, 1, 3)]
