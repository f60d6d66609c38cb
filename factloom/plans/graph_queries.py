"""Queries over the graph of facts: supplier supplies part, one document per order."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.functions import text as tx
from factloom.operators import graph
from factloom.plans.registry import query
from factloom.session import table

FACTS = """facts AS (SELECT l_orderkey AS doc, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey))::INT AS ord,
  l_suppkey AS from_key, l_partkey AS to_key, l_quantity AS qty, l_discount AS discount,
  CASE l_returnflag WHEN 'R' THEN 'red' WHEN 'N' THEN 'yellow' WHEN 'A' THEN 'green' END AS color FROM lineitem)"""
EVENTS = """events2 AS (SELECT event_id AS doc, 1 AS ord, CASE event_type WHEN 'error' THEN 'REJECT' WHEN 'purchase' THEN 'OVERRIDE' WHEN 'signup' THEN 'ADD' ELSE 'ACCEPT' END AS action, value FROM events)"""


def facts(spark, d):
    """doc, ord, from_key, to_key, qty, discount, color."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    color = F.when(F.col("l_returnflag") == "R", "red").when(F.col("l_returnflag") == "N", "yellow").when(F.col("l_returnflag") == "A", "green")
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("doc"), F.row_number().over(order).alias("ord"), F.col("l_suppkey").alias("from_key"), F.col("l_partkey").alias("to_key"),
        F.col("l_quantity").alias("qty"), F.col("l_discount").alias("discount"), color.alias("color"),
    )


def events(spark, d):
    """Review log: one event for the first fact of a document."""
    action = F.when(F.col("event_type") == "error", "REJECT").when(F.col("event_type") == "purchase", "OVERRIDE").when(F.col("event_type") == "signup", "ADD").otherwise("ACCEPT")
    return table(spark, d, "events").select(F.col("event_id").alias("doc"), F.lit(1).alias("ord"), action.alias("action"), "value")


@query(f"WITH {FACTS} SELECT level, doc, ord, color FROM facts, (VALUES ('loose', 2), ('moderate', 1), ('strict', 0)) v(level, most) WHERE CASE color WHEN 'red' THEN 2 WHEN 'yellow' THEN 1 ELSE 0 END <= most")
def color_filter(spark, d):
    levels = F.array(*[F.when(tx.color_kept(F.col("color"), x), F.lit(x)) for x in ("loose", "moderate", "strict")])
    return facts(spark, d).select(F.explode(F.array_compact(levels)).alias("level"), "doc", "ord", "color")


@query(f"""WITH {FACTS} SELECT doc, count(*) AS total, count(*) FILTER (coalesce(color, 'green') = 'green') AS green, count(*) FILTER (color = 'yellow') AS yellow, count(*) FILTER (color = 'red') AS red,
  CASE WHEN count(*) FILTER (color = 'red') > 0 THEN 'red' WHEN count(*) FILTER (color = 'yellow') > 0 THEN 'yellow' ELSE 'green' END AS worst FROM facts GROUP BY doc""")
def color_histogram(spark, d):
    from factloom.operators.metrics import color_histogram as histogram

    return histogram(facts(spark, d), ["doc"]).withColumn("worst", F.when(F.col("red") > 0, "red").when(F.col("yellow") > 0, "yellow").otherwise("green"))


@query(f"""WITH {FACTS} SELECT doc, from_key, arg_min(to_key, ord) AS first_part, list(qty ORDER BY ord) AS quantities, arg_max(discount, ord) AS discount FROM facts GROUP BY doc, from_key""")
def edge_merge(spark, d):
    merged = graph.merge_edges(facts(spark, d).withColumn("quantities", F.col("qty")).withColumn("first_part", F.col("to_key")), ["doc", "from_key"], ["ord"], ["first_part"], ["quantities"], ["discount"])
    return merged.select("doc", "from_key", "first_part", "quantities", "discount")


@query(f"""WITH {FACTS}, sides AS (SELECT 'Supplier' AS label, from_key AS key, doc, ord, 0 AS side FROM facts UNION ALL SELECT 'Part', to_key, doc, ord, 1 FROM facts)
  SELECT label, key, doc AS first_doc, ord AS first_ord FROM sides QUALIFY row_number() OVER (PARTITION BY label, key ORDER BY doc, ord, side) = 1""")
def nodes_first_write(spark, d):
    f = facts(spark, d)
    sides = f.select(F.lit("Supplier").alias("label"), F.col("from_key").alias("key"), "doc", "ord", F.lit(0).alias("side")).unionByName(f.select(F.lit("Part").alias("label"), F.col("to_key").alias("key"), "doc", "ord", F.lit(1).alias("side")))
    return graph.first_write(sides.withColumn("first_doc", F.col("doc")).withColumn("first_ord", F.col("ord")), ["label", "key"], ["doc", "ord", "side"], ["first_doc", "first_ord"])


@query(f"""WITH {FACTS} SELECT doc, from_key, arg_max(to_key, ord) AS to_key, arg_max(qty, ord) AS qty FROM facts GROUP BY doc, from_key""")
def edges_last_write(spark, d):
    return graph.last_write(facts(spark, d), ["doc", "from_key"], ["ord"], ["to_key", "qty"])


@query(f"""WITH {FACTS}, old AS (SELECT doc, ord, from_key, to_key, 'old' AS run FROM facts), new AS (SELECT doc, ord, from_key, to_key, 'new' AS run FROM facts WHERE color <> 'red')
  SELECT * FROM old WHERE (doc, ord) NOT IN (SELECT doc, ord FROM new) UNION ALL SELECT * FROM new""")
def reapply_idempotent(spark, d):
    """A second run, without the red facts, applied twice: its edges replace the first run's."""
    f = facts(spark, d).select("doc", "ord", "from_key", "to_key", "color")
    new = f.where("color <> 'red'").drop("color").withColumn("run", F.lit("new"))
    once = graph.replace_edges(f.drop("color").withColumn("run", F.lit("old")), new, ["doc", "ord"])
    return graph.replace_edges(once, new, ["doc", "ord"])


@query("""WITH a AS (SELECT o_custkey AS key, min(o_orderkey) AS first_order, 'first' AS run FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1), b AS (SELECT o_custkey AS key, min(o_orderkey) AS first_order, 'second' AS run FROM orders GROUP BY 1)
  SELECT * FROM a UNION ALL SELECT * FROM b WHERE key NOT IN (SELECT key FROM a)""")
def node_upsert(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("key"), "o_orderkey")
    run = lambda df, name: df.groupBy("key").agg(F.min("o_orderkey").alias("first_order")).withColumn("run", F.lit(name))
    return graph.upsert_nodes(run(orders.where("o_orderkey % 2 = 0"), "first"), run(orders, "second"), ["key"])


@query(f"""WITH {FACTS}, {EVENTS}, gone AS (SELECT doc, ord FROM facts WHERE color = 'red' UNION SELECT doc, ord FROM events2 WHERE action = 'REJECT')
  SELECT doc, ord, from_key, to_key FROM facts ANTI JOIN gone USING (doc, ord)""")
def excluded_delete(spark, d):
    f = facts(spark, d)
    gone = f.where(~tx.color_kept(F.col("color"), "moderate")).select("doc", "ord").unionByName(events(spark, d).where("action = 'REJECT'").select("doc", "ord"))
    return graph.delete_edges(f.select("doc", "ord", "from_key", "to_key"), gone, ["doc", "ord"])


@query(f"""WITH {FACTS}, {EVENTS} SELECT doc, ord, from_key, to_key, CASE WHEN action = 'OVERRIDE' AND value > 10 THEN value ELSE qty END AS qty
  FROM facts LEFT JOIN (SELECT * FROM events2 WHERE action <> 'ADD') USING (doc, ord) WHERE action IS DISTINCT FROM 'REJECT'
  UNION ALL SELECT doc, ord, -1, -1, value FROM events2 WHERE action = 'ADD'""")
def materialize(spark, d):
    """An override replaces the quantity only if the event holds one (here: over 10)."""
    log = events(spark, d).withColumn("has_value", F.col("value") > 10)
    done = graph.materialize(facts(spark, d).select("doc", "ord", "from_key", "to_key", "qty"), log, ["doc", "ord"], {"qty": "value"})
    return done.fillna(-1, ["from_key", "to_key"])


@query(f"""WITH {FACTS}, {EVENTS} SELECT doc, ord, coalesce(action, 'ACCEPT') AS status, CASE WHEN action = 'OVERRIDE' THEN 'green' ELSE color END AS color
  FROM facts LEFT JOIN (SELECT * FROM events2 WHERE action <> 'ADD') USING (doc, ord)""")
def review_view(spark, d):
    """As materialize, but rejected facts stay, marked."""
    log = events(spark, d).where("action <> 'ADD'").select("doc", "ord", "action")
    joined = facts(spark, d).join(log, ["doc", "ord"], "left")
    return joined.select("doc", "ord", F.coalesce("action", F.lit("ACCEPT")).alias("status"), F.when(F.col("action") == "OVERRIDE", "green").otherwise(F.col("color")).alias("color"))


@query(f"""WITH {FACTS}, {EVENTS}, over AS (SELECT doc, ord, value FROM events2 WHERE action = 'OVERRIDE')
  SELECT doc, o.ord, CASE WHEN f.doc IS NULL THEN 'missing' ELSE 'changed' END AS conflict FROM over o LEFT JOIN facts f USING (doc, ord) WHERE f.doc IS NULL OR f.qty <> 25""")
def conflicts(spark, d):
    """Overrides whose fact is gone, or no longer as it was when reviewed (quantity 25)."""
    over = events(spark, d).where("action = 'OVERRIDE'").select("doc", "ord")
    now = facts(spark, d).select("doc", "ord", "qty").withColumn("there", F.lit(True))
    joined = over.join(now, ["doc", "ord"], "left").where("there IS NULL OR qty <> 25")
    return joined.select("doc", "ord", F.when(F.col("there").isNull(), "missing").otherwise("changed").alias("conflict"))


@query(f"""WITH {FACTS}, {EVENTS} SELECT doc, ord, from_key, to_key FROM facts SEMI JOIN (SELECT * FROM events2 WHERE action = 'REJECT') USING (doc, ord)""")
def rejected_semi(spark, d):
    rejected = events(spark, d).where("action = 'REJECT'").select("doc", "ord")
    return facts(spark, d).join(rejected, ["doc", "ord"], "left_semi").select("doc", "ord", "from_key", "to_key")


@query(f"""WITH {FACTS} SELECT doc, s_name AS from_name, p_name AS to_name, qty FROM facts JOIN supplier ON s_suppkey = from_key JOIN part ON p_partkey = to_key WHERE color = 'green'""")
def edge_match(spark, d):
    s, p = table(spark, d, "supplier").select("s_suppkey", F.col("s_name").alias("from_name")), table(spark, d, "part").select("p_partkey", F.col("p_name").alias("to_name"))
    green = facts(spark, d).where(F.col("color") == "green")
    return graph.match_edges(green, s, p, F.col("from_key") == F.col("s_suppkey"), F.col("to_key") == F.col("p_partkey")).select("doc", "from_name", "to_name", "qty")


@query("""SELECT r_name, p_brand, count(*) AS facts FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey JOIN part ON p_partkey = l_partkey GROUP BY ALL""")
def two_hop(spark, d):
    """region <- nation <- supplier -> part: facts are summed by their two keys before any name is joined."""
    lines = table(spark, d, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count(F.lit(1)).alias("n"))
    placed = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("s_suppkey", "r_name")
    joined = lines.join(placed, F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return joined.groupBy("r_name", "p_brand").agg(F.sum("n").alias("facts"))


_HOPS = """edges AS (SELECT 's' || s_suppkey AS a, 'n' || s_nationkey AS b FROM supplier UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION SELECT 'r' || n_regionkey, 'n' || n_nationkey FROM nation)"""


@query(f"""WITH RECURSIVE {_HOPS}, walk AS (SELECT 's' || s_suppkey AS start, 's' || s_suppkey AS node, 0 AS hops FROM supplier UNION SELECT start, b, hops + 1 FROM walk JOIN edges ON node = a WHERE hops < 3)
  SELECT start, node, min(hops)::INT AS hops FROM walk GROUP BY start, node""")
def path_recursive(spark, d):
    s, n = table(spark, d, "supplier"), table(spark, d, "nation")
    name = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    up = n.select(name("n", "n_nationkey").alias("a"), name("r", "n_regionkey").alias("b"))
    edges = s.select(name("s", "s_suppkey").alias("a"), name("n", "s_nationkey").alias("b")).unionByName(up).unionByName(up.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    return graph.paths(edges, s.select(name("s", "s_suppkey").alias("node")), 3)


@query("""SELECT 'Supplier' AS kind, count(*) AS n FROM supplier UNION ALL SELECT 'Part', count(*) FROM part UNION ALL SELECT 'Nation', count(*) FROM nation UNION ALL SELECT 'SUPPLIES ' || l_returnflag, count(*) FROM lineitem GROUP BY l_returnflag""")
def counts_by_label(spark, d):
    of = lambda name, t: table(spark, d, t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("kind"), "n")
    edges = table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n")).select(F.concat(F.lit("SUPPLIES "), "l_returnflag").alias("kind"), "n")
    return of("Supplier", "supplier").unionByName(of("Part", "part")).unionByName(of("Nation", "nation")).unionByName(edges)


@query(f"""WITH {FACTS} SELECT * FROM (SELECT doc, from_key, ord, first_value(ord) OVER w AS first_id, (row_number() OVER w)::INT AS nth FROM facts WINDOW w AS (PARTITION BY doc, from_key ORDER BY ord)) WHERE nth > 1""")
def duplicates_note(spark, d):
    return graph.duplicates(facts(spark, d).select("doc", "from_key", "ord"), ["doc", "from_key"], ["ord"], "ord")


@query("""WITH f AS (SELECT p_brand AS from_label, p_type AS to_label, p_partkey FROM part) SELECT p_partkey, from_label, to_label FROM f ANTI JOIN (SELECT DISTINCT p_brand AS from_label, p_type AS to_label FROM part WHERE p_size > 40) USING (from_label, to_label)""")
def schema_conformance(spark, d):
    from factloom.operators.grading import nonconforming

    f = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("from_label"), F.col("p_type").alias("to_label"), "p_size")
    return nonconforming(f.drop("p_size"), f.where("p_size > 40"), ["from_label", "to_label"]).select("p_partkey", "from_label", "to_label")


@query(f"""WITH {FACTS} SELECT doc, from_key FROM (SELECT doc, from_key, row_number() OVER (PARTITION BY doc ORDER BY ord) AS n FROM facts) WHERE n <= 2""")
def sample_per_rel(spark, d):
    """First rows of each group; Spark limits groups before the exchange."""
    by = Window.partitionBy("doc").orderBy("ord")
    return facts(spark, d).withColumn("n", F.row_number().over(by)).where("n <= 2").select("doc", "from_key")
