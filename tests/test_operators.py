"""Exact cases of text functions, grounding, graph writes, grading and harvest."""

from pyspark.sql import functions as F

from factloom.functions import text as tx
from factloom.operators import graph, grading, grounding, harvest, metrics


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first().x


def located(spark, quote, text):
    span = one(spark, grounding.locate(F.col("q"), F.col("t")), q=quote, t=text)
    return None if span is None else text[span.start : span.end]


def test_locate(spark):
    assert located(spark, "sold to TSMC", "It was **sold** to TSMC, then") == "sold** to TSMC"
    assert located(spark, "on the other hand", "to TSMC.On the other hand.") == "On the other hand"
    assert located(spark, "U.S.A rules", "the U.S.A rules") == "U.S.A rules"
    assert located(spark, "a claim here", "a claim ([[3]] x.com) here") == "a claim ([[3]] x.com) here"
    assert located(spark, "Dyspepsia 4.3", "|Dyspepsia|4.3|4.7|") == "Dyspepsia|4.3"
    assert located(spark, "one two ... five", "one two three four five six") == "one two three four five"
    assert located(spark, "list: _Head:_ last", "list: _Head:_ first, second, last") == "list: _Head:_ first, second, last"
    assert located(spark, "five ... one", "one two five") is None
    assert located(spark, "  ", "one") is None and located(spark, "..", "one") is None
    assert located(spark, "x < 5 y", "x < 5 y > 3") == "x < 5 y"
    assert located(spark, "“Big” CO", 'the "big" co.') == 'big" co'


def test_ground_finds_quotes_that_only_a_split_matches(spark):
    docs = spark.createDataFrame([(1, "an alpha beta in front of gamma delta here"), (2, "the Label is a value"), (3, "nothing")], "doc_id long, text string")
    quotes = [(1, "alpha beta…gamma delta"), (2, "Label:value"), (3, "Label**value"), (4, "beta...gamma"), (5, "…"), (6, "alpha:none")]
    found = grounding.ground(spark.createDataFrame(quotes, "quote_id long, quote string"), docs).collect()
    assert sorted((r.quote_id, r.doc_id, r.evidence) for r in found) == [
        (1, 1, "alpha beta in front of gamma delta"), (2, 2, "Label is a value"), (3, 2, "Label is a value"), (4, 1, "beta in front of gamma"),
    ]


def test_chunks(spark):
    got = one(spark, tx.char_chunks(F.col("t"), 10, 2), t="a" * 25)
    assert [(c.start, len(c.text)) for c in got] == [(0, 10), (8, 10), (16, 9)]
    assert one(spark, tx.section_chunks(F.col("t"), 10, 2), t="") == [""]
    assert one(spark, tx.section_chunks(F.col("t"), 12, 2), t="# a\nbb\n# c\nd\n") == ["# a\nbb\n", "# c\nd\n"]
    assert one(spark, tx.section_chunks(F.col("t"), 20, 2), t="# a\nbb\n# c\nd\n") == ["# a\nbb\n# c\nd\n"]


def test_pages(spark):
    assert one(spark, tx.page_ranges(F.col("t")), t="3,1-2,9-4,x,2") == [1, 2, 3]
    none = F.array().cast("array<int>")
    assert one(spark, tx.page_filter(none, F.sequence(F.lit(1), F.lit(3)), F.col("n")), n=3) is None
    assert one(spark, tx.page_filter(F.array(F.lit(2), F.lit(9)), none, F.col("n")), n=3) == [2]


def test_colors(spark):
    df = spark.createDataFrame([(["green", "red"],), ([],), (["yellow", None],)], "c array<string>")
    assert [(r.w, r.b) for r in df.select(grading.worst(F.col("c")).alias("w"), grading.best(F.col("c")).alias("b")).collect()] == [("red", "green"), ("green", "red"), ("yellow", "yellow")]


def test_graph_is_idempotent_and_scoped(spark):
    old = spark.createDataFrame([("d1", "t1", "a"), ("d2", "t1", "b")], ["doc", "id", "v"])
    new = spark.createDataFrame([("d1", "t1", "c")], ["doc", "id", "v"])
    once = graph.replace_edges(old, new, ["doc", "id"])
    twice = graph.replace_edges(once, new, ["doc", "id"])
    assert sorted(map(tuple, twice.collect())) == [("d1", "t1", "c"), ("d2", "t1", "b")]
    assert graph.delete_edges(twice, new, ["doc", "id"]).count() == 1


def test_materialize_presence(spark):
    facts = spark.createDataFrame([("d", 1, "x"), ("d", 2, "y"), ("d", 3, "z")], ["doc", "ord", "v"])
    log = spark.createDataFrame([("d", 1, "REJECT", None, False), ("d", 2, "OVERRIDE", None, True), ("d", 3, "OVERRIDE", "no", False), ("d", 9, "ADD", "new", True)], "doc string, ord long, action string, value string, has_value boolean")
    got = graph.materialize(facts, log, ["doc", "ord"], {"v": "value"}).collect()
    assert sorted((r.ord, r.v) for r in got) == [(2, None), (3, "z"), (9, "new")]


def test_harvest_follows_the_last_signal(spark):
    schema = "seq long, rel string, key string, kind string, entry_id string, priority int, ts long"
    reject, add = ("suppress", "e1", 99), ("restore", "e2", 1)

    def kept(*signals):
        rows = [(i, "r", "k", kind, entry, p, i) for i, (kind, entry, p) in enumerate(signals)]
        return sorted(r.entry_id for r in harvest.harvest(spark.createDataFrame(rows, schema)).collect())

    assert kept(reject, add) == ["e1", "e2"]
    assert kept(add, reject) == ["e1"]


def test_prf_of_empty_sets(spark):
    none = spark.createDataFrame([], "doc_id long")
    r = metrics.prf(metrics.compare(none, none, ["doc_id"]), ["doc_id"]).first()
    assert (r.tp, r.precision, r.recall, r.f1) == (0, 0.0, 0.0, 0.0)
