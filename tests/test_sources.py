"""Sources, sinks, the graph store, streams, the cache, the ontology and what agents call."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from factloom.operators import agent, cache
from factloom.sources import files, graph_store, ontology
from factloom.streaming import ingest

NODE = {"properties": [{"name": "id", "type": "STRING", "source": "umls", "primary_key": True}]}
REL = {"rel_type": "R", "from_node": "A", "from_field": "a", "to_node": "A", "to_field": "b"}


def test_ontology(spark, tmp_path):
    (tmp_path / "o.yaml").write_text(json.dumps({"nodes": {"A": NODE}, "relationships": [REL]}))
    found = ontology.read_ontology(spark, str(tmp_path / "o.yaml")).tables(spark)
    assert [r.rel_type for r in found["relations"].collect()] == ["R"] and found["properties"].count() == 1


@pytest.mark.parametrize(
    "wrong",
    [
        None,
        {"nodes": {}, "relationships": [REL]},
        {"nodes": {"A": NODE}, "relationships": [], "more": 1},
        {"nodes": {"A": {"properties": []}}, "relationships": []},
        {"nodes": {"A": {"properties": [{**NODE["properties"][0], "type": "STRING[]"}]}}, "relationships": []},
        {"nodes": {"A": {"properties": [{**NODE["properties"][0], "source": "pipeline"}]}}, "relationships": []},
        {"nodes": {"A": {"properties": [{**NODE["properties"][0], "type": "TEXT"}]}}, "relationships": []},
        {"nodes": {"A": NODE}, "relationships": [{"rel_type": "R"}]},
    ],
)
def test_ontology_rejects(wrong):
    with pytest.raises(ontology.OntologyError):
        ontology.ontology(wrong)


def test_files(spark, tmp_path):
    (tmp_path / "a b.md").write_text("one\ntwo")
    (tmp_path / "a b.pdf").write_bytes(b"x")
    (tmp_path / "c.pdf").write_bytes(b"yy")
    texts, pdfs = files.markdown(spark, str(tmp_path)), files.binaries(spark, str(tmp_path))
    assert [(r.doc_name, r.text) for r in texts.collect()] == [("a b", "one\ntwo")]
    old = texts.withColumn("modified", F.col("modified") + F.expr("INTERVAL 1 HOUR"))
    assert [r.doc_name for r in files.stale(pdfs, old).collect()] == ["c"]
    assert files.stale(pdfs, old, force=True).count() == 2
    assert {r.text for r in files.convert(pdfs, lambda b, pages: b.decode() * 2).collect()} == {"xx", "yyyy"}


def test_raw_and_review(spark, tmp_path):
    (tmp_path / "d_raw.json").write_text(json.dumps({"document": "d", "triples": [{"_id": "f1", "rel_type": "R", "rel_props": {"k": "v"}}]}))
    (tmp_path / "d_review.json").write_text(json.dumps({"raw_hash": "h", "events": {"f1": {"action": "REJECT"}}}))
    (tmp_path / "e_review.json").write_text("{broken")
    assert [(r.doc_name, r._id, r.rel_props) for r in files.raw_facts(spark, str(tmp_path)).collect()] == [("d", "f1", {"k": "v"})]
    assert [(r.doc_name, r.fact_id, r.event.action) for r in files.review_events(spark, str(tmp_path)).collect()] == [("d", "f1", "REJECT")]


def test_sinks(spark, tmp_path):
    facts = spark.createDataFrame([("r", "x" * 12, 1), ("q", "y", 2)], "rel_type string, text string, n int")
    files.raw_sink(facts, f"{tmp_path}/raw", "text", 10)
    assert {r.text for r in spark.read.schema("text string").json(f"{tmp_path}/raw").collect()} == {None, "y"}
    files.examples_sink(facts, f"{tmp_path}/ex")
    files.examples_sink(facts.where("n = 1"), f"{tmp_path}/ex")
    assert [r.rel_type for r in files.examples(spark, f"{tmp_path}/ex", "n int, rel_type string").collect()] == ["r"]


def test_tables_of_text(spark, tmp_path):
    (tmp_path / "g.tsv").write_text("rel_type\tfrom_display\tto_display\tdoc_name\nR\tA\tB\t\nR\t\tB\td\nR\tC\tD\td\n")
    assert {tuple(r) for r in files.gold(spark, f"{tmp_path}/g.tsv").collect()} == {("R", "a", "b", None), ("R", "c", "d", "d")}
    (tmp_path / "s.txt").write_text("DRUG|Drugs|T1|Antibiotic\nbad|line\n")
    assert [tuple(r) for r in files.group_types(files.sem_groups(spark, f"{tmp_path}/s.txt"), "DRUG").collect()] == [("T1", "Antibiotic")]


def test_graph_store(spark, tmp_path):
    store = graph_store.open_store("tables", spark, str(tmp_path))
    rows = lambda *r: spark.createDataFrame(r, "id string, name string, seq int")
    assert store.read("nodes/A") is None
    store.merge_nodes("A", rows(("1", "one", 2), ("1", "uno", 1)), ["id"], ["seq"])
    store.merge_nodes("A", rows(("1", "later", 0), ("2", "two", 0)), ["id"], ["seq"])
    assert {(r.id, r.name) for r in store.read("nodes/A").collect()} == {("1", "uno"), ("2", "two")}
    store.merge_edges("R", rows(("1", "one", 2)), ["id"], ["seq"])
    store.merge_edges("R", rows(("1", "new", 0)), ["id"], ["seq"])
    assert [r.name for r in store.read("edges/R").collect()] == ["new"]
    store.delete_edges("R", rows(("1", "x", 0)), ["id"])
    assert store.read("edges/R").count() == 0
    with pytest.raises(ValueError):
        graph_store.open_store("other", spark, "x")


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.md").write_text("abcdef")
    for _ in range(2):  # the second start has nothing new
        stream = ingest.chunked(ingest.documents(spark, f"{tmp_path}/in"), 4, 1)
        query = ingest.write_nodes(stream, f"{tmp_path}/out", ["doc_name", "chunk_no"], ["start"], f"{tmp_path}/check")
        query.awaitTermination()
    found = ingest.read_nodes(spark, f"{tmp_path}/out", ["doc_name", "chunk_no"])
    assert {(r.doc_name, r.chunk_no, r.text) for r in found.collect()} == {("a", 0, "abcd"), ("a", 1, "def")}


def test_cache(spark):
    day = lambda n: dt.datetime(2024, 1, n)
    stored = spark.createDataFrame([("s", "a", "old", day(1)), ("s", "a", "new", day(20)), ("s", "b", "gone", day(1))], "service string, cache_key string, value string, created_at timestamp")
    asked = spark.createDataFrame([("s", "a"), ("s", "b"), ("s", "c")], "service string, cache_key string")
    registry = spark.createDataFrame([("s", "b", "again")], "service string, cache_key string, value string")
    values, new = cache.read_through(asked, stored, registry, F.lit("2024-01-25 00:00:00"), 10)
    assert {(r.cache_key, r.value) for r in values.collect()} == {("a", "new"), ("b", "again"), ("c", None)}
    assert {r.cache_key for r in new.collect()} == {"b", "c"}
    assert cache.fresh(stored, F.lit("2034-01-01"), 0).count() == 2


def test_agent_merge(spark):
    schema = "_id string, extraction_source string, supporting_quote string, status string, rel_props map<string,string>"
    earlier = spark.createDataFrame([("1", "batch", "q", "s", {"a": "1", "b": "1"}), ("2", "batch", "q2", "s2", None), (None, "batch", "q3", "s3", None)], schema)
    theirs = spark.createDataFrame([("1", "x", "", None, {"b": "2"}), ("9", "x", "n", None, None)], schema)
    found = {r._id: (r.extraction_source, r.supporting_quote, r.status, r.rel_props) for r in agent.merge(earlier, theirs).collect() if r._id or r.supporting_quote == "q3"}
    assert found["1"] == ("agent_retry", "q", None, {"a": "1", "b": "2"})
    assert found["2"] == ("batch", "q2", "s2", None) and found[None][1] == "q3"


def test_line_search(spark):
    text = "A  Cat sat\nno\n a  cat sat \nA  Cat sat\r\nthe *dog* ran off\n"
    asked = spark.createDataFrame([(text, q) for q in ("a cat", "dog ran", " ", "absent words")], "text string, wanted string")
    found = {r.wanted: r.lines for r in agent.line_search(asked).collect()}
    assert found == {"a cat": ["A  Cat sat", "a  cat sat"], "dog ran": ["the *dog* ran off"], " ": [], "absent words": []}


def test_highlight(spark):
    docs = spark.createDataFrame([(1, "ab CD ab\\E cd", "Ab", "cd")], "doc_id int, text string, s string, o string")
    spans = agent.occurrences(docs, "s", "subject").unionByName(agent.occurrences(docs, "o", "object"))
    spans = spans.unionByName(spark.createDataFrame([(1, 1, 4, "quote")], "doc_id int, start int, end int, kind string"))
    pieces = sorted((r.start, r.end, r.kind) for r in agent.highlight(docs, spans).collect())
    assert pieces == [(0, 1, "subject"), (1, 2, "subject"), (2, 3, "quote"), (3, 4, "object"), (4, 5, "object"), (5, 6, None), (6, 8, "subject"), (8, 11, None), (11, 13, "object")]
    given = spark.createDataFrame([(1, 0, 2, "ab"), (1, 5, 9, "CD")], "doc_id int, start int, end int, text string")
    assert sorted(tuple(r) for r in agent.trusted(given, docs).collect()) == [(1, 0, 2), (1, 3, 5)]
