"""What reviewers and agents submit: events, added facts, and examples harvested from them."""

from pyspark.sql import functions as F

from factloom.operators import agent, harvest, review
from factloom.sources import files

M = "map<string,string>"
FACT = f"rel_type string, from_props {M}, from_pk string, to_props {M}, to_pk string, triple_color string"


def test_harvest_signals(spark):
    def fact(rel, a, b, color="green"):
        return (rel, {"name": a}, "id", {"name": "", "id": b}, "id", color)

    raw = spark.createDataFrame(
        [
            ("r1", "d", 0, "t0", *fact("R", "a", "b"), None), ("r1", "d", 1, "t1", *fact("R", "a", "c"), "agent_retry"), ("r1", "d", 2, "t2", *fact("R", "a", "e", "red"), None),
            ("r1", "d", 3, "t3", *fact("R", "a", "f"), None), ("r1", "d", 4, "", *fact("R", "a", "g"), None), ("r1", "d", 5, "t5", *fact("", "a", "h"), None),
            ("r2", "d", 0, "t0", *fact("R", "a", "b"), None), ("r2", "d", 1, "t1", *fact("R", "a", "k"), None), ("r2", "d", 2, "t2", *fact("R", "a", "e"), None),
        ],
        f"run string, doc string, ord int, triple_id string, {FACT}, extraction_source string",
    )
    none = (None, None, None, None, None, None)
    events = spark.createDataFrame(
        [
            ("r1", "d", "t0", 0, "REJECT", *none), ("r1", "d", "t3", 1, "OVERRIDE", None, None, None, {"name": "z"}, None, None),
            ("r2", "d", "t0", 0, "REJECT", *none), ("r2", "d", "new", 1, "ADD", *fact("R", "a", "b")), ("r2", "d", "t1", 2, "OVERRIDE", None, None, None, None, None, "yellow"),
            ("r2", "d", "lost", 3, "REJECT", *none), ("r2", "d", "bad", 4, "ADD", "R", {}, "id", {"name": "b"}, "id", "green"),
        ],
        f"run string, doc string, triple_id string, place int, action string, {FACT}",
    )
    found = harvest.signals(raw, events)
    got = sorted((tuple(r.seq), tuple(r.key), r.kind, r.source) for r in found.collect())
    assert [(s[0], s[2], *x) for s, *x in got] == [
        ("r1", 0, ("a", "b"), "suppress", "rejected"), ("r1", 2, ("a", "f"), "suppress", None), ("r1", 2, ("a", "z"), "none", "override"),
        ("r1", 3, ("a", "c"), "none", "agent_retry"), ("r1", 3, ("a", "g"), "none", "batch"),
        ("r2", 0, ("a", "b"), "suppress", "rejected"), ("r2", 1, ("a", "b"), "restore", "add"), ("r2", 2, ("a", "k"), "suppress", None), ("r2", 3, ("a", "e"), "none", "batch"),
    ]
    kept = {(r.key.to_display, r.priority) for r in harvest.harvest(found).collect()}
    assert kept == {("b", 1), ("b", 99), ("z", 2), ("c", 3), ("g", 4), ("e", 4)}
    assert harvest.signals(raw.limit(0), events.limit(0)).count() == 0


def test_review_events(spark):
    docs = spark.createDataFrame([("d", "The drug  helps. Much more.", "h1"), ("e", "x", "h2")], "doc string, text string, raw_hash string")
    raw = spark.createDataFrame([("d", "t1", "drug"), ("d", "t2", None), ("d", "t3", "same")], "doc string, triple_id string, supporting_quote string")
    own = {"name": "a"}
    submitted = spark.createDataFrame(
        [
            ("d", "h1", "t0", "REJECT", None, None, None, None, None), ("d", "", "t1", "OVERRIDE", own, own, None, "red", "the drug helps"), ("d", "h1", "t2", "OVERRIDE", own, own, own, "", "it heals"),
            ("d", "h1", "t3", "OVERRIDE", own, own, None, None, " same "), ("d", "h1", "t4", "ACCEPT", None, None, None, None, None), ("e", "old", "t9", "REJECT", None, None, None, None, None),
        ],
        f"doc string, raw_hash string, triple_id string, action string, from_props {M}, to_props {M}, rel_props {M}, triple_color string, supporting_quote string",
    )
    added = spark.createDataFrame(
        [("d", "h1", "", "R", "A", "id", own, "B", "id", own, {"manually_added": "no", "k": "v"}), ("d", "h1", "x", "", "A", "id", own, "B", "id", own, None), ("e", "h2", "y", "R", "A", "id", own, "B", "id", own, None)],
        f"doc string, raw_hash string, triple_id string, rel_type string, from_label string, from_pk string, from_props {M}, to_label string, to_pk string, to_props {M}, rel_props {M}",
    )
    events, warned, stale = review.review_events(submitted, added, raw, docs)
    rows = {r.triple_id: r for r in events.collect()}
    assert set(rows) - {i for i in rows if i.startswith("add_")} == {"t0", "t1", "t2", "t3"} and len(rows) == 5
    assert rows["t1"].supporting_quote == "The drug  helps" and rows["t1"].evidence[0].start == 0 and rows["t1"].triple_color == "red"
    assert rows["t2"].evidence is None and rows["t2"].triple_color is None and rows["t3"].supporting_quote is None
    new = next(r for i, r in rows.items() if i.startswith("add_"))
    assert (new.action, new.triple_color, new.from_color, new.rel_props) == ("ADD", "green", "green", {"manually_added": "true", "k": "v"})
    assert [tuple(r) for r in warned.collect()] == [("d", "t2", "it heals")]
    assert [r.doc for r in stale.collect()] == ["e"]


def test_add_triples(spark):
    text = "Aspirin helps headache. RSV. Much later, fever went."
    docs = spark.createDataFrame([("d", text)], "doc string, text string")
    known = spark.createDataFrame([("C1", ["X"]), ("C2", ["M"])], "cui string, sabs array<string>")

    def ask(seq, quote, rel="TREATS", a=None, b=None, term="aspirin", lists=None, label="Drug", props=None):
        return ("d", seq, rel, label, "id", a or {"id": "1"}, term, "Finding", "id", b or {"id": "2"}, " ", props, lists, quote)

    asked = spark.createDataFrame(
        [
            ask(1, "aspirin cures all", lists={"l": ["a"]}, props={"p": "1", "q": "1"}), ask(2, "aspirin helps  headache"), ask(3, "RSV"), ask(4, "rsv.", lists={"l": ["a", "b"]}), ask(5, "made up", props={"p": "2"}),
            ask(6, "RSV", rel="NO"), ask(7, "RSV", label="No"), ask(8, "RSV", a={"id": "1", "cui": "C1"}), ask(9, "RSV", a={"id": "3", "cui": "C2"}), ask(10, "RSV", a={"name": "1"}),
            ask(11, "made up", term="ibuprofen"), ask(12, "", term="ibuprofen", b={"id": "9"}), ask(13, None, b={"id": "7"}, props={"supporting_quote": "fever"}),
        ],
        f"doc string, seq int, rel_type string, from_label string, from_pk string, from_props {M}, from_term string, to_label string, to_pk string, to_props {M}, to_term string, rel_props {M}, rel_lists map<string,array<string>>, supporting_quote string",
    )
    added, refused = agent.add_triples(asked, docs, ["TREATS"], {"Drug": ["M"], "Finding": []}, known)
    assert {r.seq: r.error for r in refused.collect()} == {6: "unknown relation NO", 7: "unknown kind No", 8: "vocabulary of Drug", 10: "from side without key", 11: "from term not in the text"}
    rows = {(r.from_key, r.to_key): r for r in added.collect()}
    first = rows["1", "2"]
    assert (first.seq, first.supporting_quote, first.quote_unlocatable) == (1, "Aspirin helps headache / RSV", False)
    assert first.rel_props == {"p": "2", "q": "1"} and first.rel_lists == {"l": ["a", "b"]} and first.from_term == "aspirin" and first.to_term is None
    assert rows["1", "9"].supporting_quote is None and rows["1", "7"].supporting_quote == "fever" and rows["1", "7"].rel_props == {}
    assert set(rows) == {("1", "2"), ("3", "2"), ("1", "9"), ("1", "7")}


def test_error_sink(spark, tmp_path):
    failed = spark.createDataFrame([("x", "Drug", "timeout")], "entity string, label string, error string")
    for _ in range(2):
        files.error_sink(failed, str(tmp_path / "errors"))
    got = spark.read.json(str(tmp_path / "errors"))
    assert got.count() == 2 and sorted(got.columns) == ["entity", "error", "label", "ts"] and got.where(F.col("ts").isNull()).count() == 0
