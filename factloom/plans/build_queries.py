"""Queries over the build step, the validators and the store: items, evidence, verdicts, review and upkeep."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import text as tx
from factloom.operators import build, grounding, validators
from factloom.plans.graph_queries import EVENTS, FACTS, events, facts
from factloom.plans.registry import query
from factloom.session import table

FORM_SQL = "[" + ", ".join(f"'{w}'" for w in tx.FORM_WORDS) + "]"
STOP_SQL = "[" + ", ".join(f"'{w}'" for w in tx.SHORT_STOP) + "]"
#: Verdicts of the graph's facts as tables: supplier and part names stand for both sides.
NAMED = """named AS (SELECT l_orderkey * 1000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS triple_id, l_orderkey AS doc,
  CASE WHEN l_linenumber = 1 THEN 'TREATS' ELSE 'SUPPLIES' END AS rel_type, CASE WHEN s_suppkey % 50 = 7 THEN '' ELSE s_name END AS from_name,
  CASE WHEN p_size % 10 = 3 THEN 'Assay of ' || p_name ELSE p_name END AS to_name, l_returnflag, l_linestatus, p_type, p_brand, p_size
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey)"""


def named(spark, d):
    from pyspark.sql.window import Window

    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    lines = table(spark, d, "lineitem").withColumn("ord", F.row_number().over(order))
    joined = lines.join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return joined.select(
        (F.col("l_orderkey") * 1000 + F.col("ord")).alias("triple_id"), F.col("l_orderkey").alias("doc"), F.when(F.col("l_linenumber") == 1, "TREATS").otherwise("SUPPLIES").alias("rel_type"),
        F.when(F.col("s_suppkey") % 50 == 7, "").otherwise(F.col("s_name")).alias("from_name"),
        F.when(F.col("p_size") % 10 == 3, F.concat(F.lit("Assay of "), "p_name")).otherwise(F.col("p_name")).alias("to_name"), "l_returnflag", "l_linestatus", "p_type", "p_brand", "p_size",
    )


@query(r"""SELECT doc_id, len(list_filter(list_transform(regexp_split_to_array(replace(text, '. ', ' - '), '\s+/\s+|\s+[*•·]\s+|\s+-\s+'), lambda s: trim(s)), lambda s: s <> ''))::INT AS parts,
  len(list_filter(list_transform(string_split(replace(text, '. ', ' / '), ' / '), lambda s: trim(s)), lambda s: s <> ''))::INT AS grader_parts FROM documents""")
def quote_parts(spark, d):
    """Segments of a whole text, at separators of quotes and at the grader's only."""
    return table(spark, d, "documents").select("doc_id", F.size(tx.multi_quotes(F.replace("text", F.lit(". "), F.lit(" - ")))).alias("parts"), F.size(tx.grader_quotes(F.replace("text", F.lit(". "), F.lit(" / ")))).alias("grader_parts"))


@query("""SELECT c_custkey, coalesce(nullif(CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END, ''), nullif(CASE WHEN c_custkey % 2 = 0 THEN '' ELSE c_custkey::VARCHAR END, ''), '?') AS shown FROM customer""")
def display_names(spark, d):
    name, key = F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_name")), F.when(F.col("c_custkey") % 2 == 0, "").otherwise(F.col("c_custkey").cast("string"))
    return table(spark, d, "customer").select("c_custkey", tx.display_name(name, key).alias("shown"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'h' || substr(sha256('SUPPLIES|' || l_suppkey || '|' || l_partkey || '|' || l_returnflag), 1, 12) AS harvest_id,
  replace('order ' || l_orderkey, ' ', '_') || '_' || substr(sha256('runs/order ' || l_orderkey || '.pdf'), 1, 8) AS dataset, sha256(l_returnflag || chr(0) || l_linestatus || chr(0)) AS cache_key FROM lineitem""")
def derived_ids(spark, d):
    path = F.concat(F.lit("runs/order "), F.col("l_orderkey").cast("string"), F.lit(".pdf"))
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", tx.harvest_id(F.lit("SUPPLIES"), F.col("l_suppkey"), F.col("l_partkey"), F.col("l_returnflag")).alias("harvest_id"),
        tx.dataset_name(path).alias("dataset"), tx.cache_key(F.col("l_returnflag"), F.col("l_linestatus"), F.lit(None)).alias("cache_key"),
    )


@query(f"""WITH n AS (SELECT p_partkey, p_size, p_name AS term, CASE p_size % 4 WHEN 0 THEN upper(p_name) || ' A/S' WHEN 1 THEN p_name || ' Partners, Ltd.' WHEN 2 THEN p_name || ' Group' ELSE 'The ' || p_name END AS resolved FROM part),
  w AS (SELECT *, list_filter(string_split(regexp_replace(lower(replace(term, '/', '')), '[^\\pL\\pN_]', ' ', 'g'), ' '), lambda x: x <> '') AS a,
    list_filter(string_split(regexp_replace(lower(replace(resolved, '/', '')), '[^\\pL\\pN_]', ' ', 'g'), ' '), lambda x: x <> '') AS b FROM n)
  SELECT p_partkey, len(b) > len(a) AND b[1:len(a)] = a AND len(list_filter(b[len(a) + 1:], lambda x: NOT list_contains({FORM_SQL}, x))) > 0 AS suspicious,
    starts_with(lower(resolved), lower(term)) AND len(list_filter(list_filter(string_split_regex(trim(substr(resolved, length(term) + 1), ' ,.'), '\\s+'), lambda x: x <> ''), lambda x: NOT list_contains({STOP_SQL}, lower(trim(x, '.,'))))) > 0 AS extra FROM w""")
def subsidiary_names(spark, d):
    """Resolved names that may be another company's: by words of legal form, and by stop words."""
    n = F.col("p_name")
    resolved = F.when(F.col("p_size") % 4 == 0, F.concat(F.upper(n), F.lit(" A/S"))).when(F.col("p_size") % 4 == 1, F.concat(n, F.lit(" Partners, Ltd."))).when(F.col("p_size") % 4 == 2, F.concat(n, F.lit(" Group"))).otherwise(F.concat(F.lit("The "), n))
    return table(spark, d, "part").select("p_partkey", tx.suspicious_name(n, resolved).alias("suspicious"), tx.extra_words(n, resolved).alias("extra"))


_ITEMS = "items AS (SELECT l_orderkey AS doc, l_linenumber AS ord, l_partkey, l_suppkey, l_returnflag AS rel, s_name AS from_term, p_name AS to_term FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey)"
_RESOLVED = "resolved AS (SELECT s_name AS term, 'Supplier' AS label, 's' || s_suppkey AS key FROM supplier WHERE s_suppkey % 7 <> 0 UNION ALL SELECT p_name, 'Part', 'p' || min(p_partkey) FROM part GROUP BY p_name HAVING min(p_partkey) % 5 <> 0)"


def _items(spark, d):
    lines = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return lines.select(
        F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("ord"), "l_partkey", "l_suppkey", F.col("l_returnflag").alias("rel"), F.col("s_name").alias("from_term"), F.lit("Supplier").alias("from_label"),
        F.col("p_name").alias("to_term"), F.lit("Part").alias("to_label"),
    )


def _resolved(spark, d):
    s = table(spark, d, "supplier").where("s_suppkey % 7 <> 0").select(F.col("s_name").alias("term"), F.lit("Supplier").alias("label"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("key"))
    p = table(spark, d, "part").groupBy("p_name").agg(F.min("p_partkey").alias("k")).where("k % 5 <> 0")
    return s.unionByName(p.select(F.col("p_name").alias("term"), F.lit("Part").alias("label"), F.concat(F.lit("p"), F.col("k").cast("string")).alias("key")))


@query(f"""WITH {_ITEMS}, {_RESOLVED} SELECT i.doc, i.ord, i.l_partkey, i.l_suppkey, a.key AS from_key, b.key AS to_key FROM items i
  JOIN resolved a ON a.term = from_term AND a.label = 'Supplier' JOIN resolved b ON b.term = to_term AND b.label = 'Part'""")
def resolved_items(spark, d):
    return build.resolve_items(_items(spark, d), _resolved(spark, d))[0].select("doc", "ord", "l_partkey", "l_suppkey", "from_key", "to_key")


@query(f"""WITH {_ITEMS}, {_RESOLVED}, j AS (SELECT i.*, a.key AS fk, b.key AS tk FROM items i LEFT JOIN resolved a ON a.term = from_term AND a.label = 'Supplier' LEFT JOIN resolved b ON b.term = to_term AND b.label = 'Part')
  SELECT node, term, count(*) AS n FROM (SELECT CASE WHEN fk IS NULL THEN 'Supplier' ELSE 'Part' END AS node, CASE WHEN fk IS NULL THEN from_term ELSE to_term END AS term FROM j WHERE fk IS NULL OR tk IS NULL) GROUP BY node, term""")
def skipped_items(spark, d):
    return build.resolve_items(_items(spark, d), _resolved(spark, d))[1].groupBy("node", "term").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_ITEMS} SELECT term, label FROM (SELECT trim(from_term) AS term, 'Supplier' AS label FROM items UNION SELECT trim(to_term), 'Part' FROM items) WHERE term <> ''""")
def entities_to_resolve(spark, d):
    return build.entities_to_resolve(_items(spark, d))


@query("""WITH q AS (SELECT doc_id, text, text[1:60] AS a, string_split(text, ' ')[1] AS b FROM documents),
  asked AS (SELECT doc_id, text, unnest(['  ', 'zq zq zq', 'zq zq zq']) AS quote FROM q)
  SELECT doc_id, count(DISTINCT quote)::INT AS spans, 0 AS located FROM asked WHERE trim(quote) <> '' GROUP BY doc_id""")
def evidence_of_lost_quotes(spark, d):
    """Blank and repeated quotes make no span; what isn't found keeps null offsets."""
    spans = build.evidence(F.array(F.lit("  "), F.lit("zq zq zq"), F.lit("zq zq zq")), F.col("text"))
    return table(spark, d, "documents").select("doc_id", spans.alias("e")).select("doc_id", F.size("e").alias("spans"), F.size(F.filter("e", lambda x: x["start"].isNotNull())).alias("located"))


@query(f"""WITH {NAMED}, first AS (SELECT doc, from_name, to_name, min(triple_id) AS first_id FROM named GROUP BY ALL),
  v AS (SELECT triple_id, 'red' AS floor, false AS violated, NULL AS note FROM named WHERE trim(from_name) = '' OR trim(to_name) = ''
    UNION ALL SELECT n.triple_id, NULL, false, '[duplicate of ' || first_id || ']' FROM named n JOIN first f USING (doc, from_name, to_name) WHERE first_id < n.triple_id
    UNION ALL SELECT triple_id, NULL, false, '[procedure: assay]' FROM named WHERE rel_type = 'TREATS' AND contains(lower(to_name), 'assay')
    UNION ALL SELECT triple_id, 'red', true, '[rejected before]' FROM named WHERE (rel_type, from_name, to_name) IN (SELECT rel_type, from_name, to_name FROM named WHERE l_returnflag = 'R' AND p_size = 10)),
  s AS (SELECT triple_id, max(floor) AS floor, bool_or(violated) AS violated FROM v GROUP BY triple_id)
  SELECT n.triple_id, CASE WHEN coalesce(s.violated, false) THEN 'red' WHEN l_linestatus = 'O' THEN CASE WHEN s.floor IS NOT NULL THEN 'red' ELSE CASE l_returnflag WHEN 'R' THEN 'red' WHEN 'A' THEN 'green' ELSE 'yellow' END END WHEN s.floor IS NOT NULL THEN 'red' END AS color,
    coalesce(s.violated, false) AS violated, l_linestatus = 'O' AS reviewed FROM named n LEFT JOIN s USING (triple_id)""")
def merged_verdicts(spark, d):
    """Four validators and the grades of some facts, merged."""
    f = named(spark, d)
    rejected = f.where("l_returnflag = 'R' AND p_size = 10")
    found = validators.structural(f, ["doc", "from_name", "to_name"]).unionByName(validators.plausibility(f)).unionByName(validators.harvest_rejection(f, rejected))
    color = F.when(F.col("l_returnflag") == "R", "red").when(F.col("l_returnflag") == "A", "green").otherwise("yellow")
    grades = f.where("l_linestatus = 'O'").select("triple_id", color.alias("from_grade"), F.lit("green").alias("to_grade"), F.lit(False).alias("grade_violated"), F.lit("graded").alias("opinion"))
    return validators.merge_verdicts(f, found, grades).select("triple_id", "color", "violated", "reviewed")


@query(f"""WITH {NAMED} SELECT triple_id, p_type <> 'ECONOMY' AS violated FROM named WHERE p_type <> 'ECONOMY' OR p_brand <> 'Brand#1'""")
def semantic_type_verdicts(spark, d):
    f = named(spark, d).select("triple_id", F.lit("S").alias("from_label"), F.array().cast("array<string>").alias("from_types"), F.lit("").alias("from_vocab"), F.lit("P").alias("to_label"), F.array("p_type").alias("to_types"), F.col("p_brand").alias("to_vocab"))
    expected = spark.createDataFrame([("P", ["ECONOMY"], ["Brand#1"]), ("S", ["x"], [])], "label string, types array<string>, vocabs array<string>")
    return validators.semantic_types(f, expected).select("triple_id", "violated")


@query("""SELECT doc_id FROM documents WHERE doc_id % 2 = 0""")
def fabricated_quotes(spark, d):
    """Every document is judged: a quote of its own in odd ones, of nowhere in even ones."""
    own = F.when(F.col("doc_id") % 2 == 0, F.lit("zq zq zq")).otherwise(F.lit("a"))
    span = F.array(F.struct(F.when(F.col("doc_id") % 2 == 1, F.lit(0)).alias("start"), own.alias("text")))
    f = table(spark, d, "documents").select(F.col("doc_id").alias("triple_id"), F.lit("agent_retry").alias("extraction_source"), own.alias("supporting_quote"), span.alias("evidence"))
    return validators.fabricated_quote(f).select(F.col("triple_id").alias("doc_id"))


_POOL = """pool AS (SELECT p_name AS term, (p_size % 3)::INT AS stage, p_partkey AS rank, p_partkey % 40 AS key, ['exact', 'names', 'fuzzy'][p_size % 3 + 1] AS match_type, p_brand = 'Brand#2' AS short FROM part)"""


@query(f"""WITH {_POOL}, open AS (SELECT * FROM pool p WHERE NOT short OR term NOT IN (SELECT term FROM pool WHERE NOT short))
  SELECT term, key, stage, match_type FROM open QUALIFY row_number() OVER (PARTITION BY term, key ORDER BY stage, rank) = 1""")
def candidate_pool(spark, d):
    kinds = F.array(F.lit("exact"), F.lit("names"), F.lit("fuzzy"))
    pool = table(spark, d, "part").select(
        F.col("p_name").alias("term"), (F.col("p_size") % 3).alias("stage"), F.col("p_partkey").alias("rank"), F.lit(0).alias("step"), (F.col("p_partkey") % 40).alias("key"),
        F.element_at(kinds, F.col("p_size") % 3 + 1).alias("match_type"), (F.col("p_brand") == "Brand#2").alias("short"),
    )
    return build.candidate_pool(pool)


_ENTRIES = """entries AS (SELECT event_type AS rel, event_id AS entry_id, 'u' || (user_id % 50) AS to_display, CASE WHEN event_id % 4 = 0 THEN 99 ELSE (event_id % 4)::INT END AS priority, ts FROM events)"""


@query(f"""WITH {_ENTRIES}, firsts AS (SELECT * FROM entries WHERE priority < 99 QUALIFY row_number() OVER (PARTITION BY rel, to_display ORDER BY priority, ts, entry_id) = 1)
  SELECT rel, entry_id, (row_number() OVER (PARTITION BY rel ORDER BY priority, ts, entry_id))::INT AS place, 'positive' AS sort FROM firsts QUALIFY place <= 5
  UNION ALL SELECT rel, entry_id, (row_number() OVER (PARTITION BY rel ORDER BY ts DESC, entry_id))::INT AS place, 'negative' FROM entries WHERE priority = 99 QUALIFY place <= 3""")
def harvest_examples(spark, d):
    """Examples for a prompt: five positives of different targets, three negatives of each relation."""
    e = table(spark, d, "events").select(
        F.col("event_type").alias("rel"), F.col("event_id").alias("entry_id"), F.concat(F.lit("u"), (F.col("user_id") % 50).cast("string")).alias("to_display"),
        F.when(F.col("event_id") % 4 == 0, 99).otherwise((F.col("event_id") % 4).cast("int")).alias("priority"), "ts",
    )
    return build.diversified(e).select("rel", "entry_id", "place", F.when(F.col("priority") < 99, "positive").otherwise("negative").alias("sort"))


@query(f"""WITH {FACTS}, {EVENTS}, r AS (SELECT doc, ord FROM events2 WHERE action = 'REJECT'), by_doc AS (
  SELECT f.doc, count(*) AS total, count(*) FILTER (r.doc IS NULL AND color = 'green') AS green, count(*) FILTER (r.doc IS NULL AND color = 'yellow') AS yellow, count(*) FILTER (r.doc IS NULL AND color = 'red') AS red,
    count(r.doc) AS rejected FROM facts f LEFT JOIN r USING (doc, ord) GROUP BY f.doc),
  a AS (SELECT doc, count(*) AS added FROM events2 WHERE action = 'ADD' GROUP BY doc)
  SELECT doc, sum(total)::BIGINT AS total, sum(green)::BIGINT AS green, sum(yellow)::BIGINT AS yellow, sum(red)::BIGINT AS red, sum(rejected)::BIGINT AS rejected, sum(coalesce(added, 0))::BIGINT AS added,
    sum(total - rejected + coalesce(added, 0))::BIGINT AS active FROM by_doc LEFT JOIN a USING (doc) GROUP BY ROLLUP (doc)""")
def review_quality(spark, d):
    f, e = facts(spark, d), events(spark, d)
    active = f.join(e.where("action = 'REJECT'").select("doc", "ord"), ["doc", "ord"], "left_anti")
    return build.review_quality(f, active, e)


@query(f"""WITH {EVENTS} SELECT doc, count(*) FILTER (action = 'REJECT') AS reject, count(*) FILTER (action = 'OVERRIDE') AS override, count(*) FILTER (action = 'ADD') AS "add" FROM events2 GROUP BY doc""")
def event_summary(spark, d):
    return build.event_summary(events(spark, d))


@query("""SELECT l_orderkey * 1000 + l_linenumber AS triple_id, l_partkey, l_suppkey, CASE WHEN l_linenumber = 2 THEN 'to key' ELSE 'rel_type' END AS problem FROM lineitem WHERE l_linenumber IN (2, 3)""")
def missing_fields(spark, d):
    lines = table(spark, d, "lineitem")
    s = lambda c: F.col(c).cast("string")
    t = lines.select(
        F.struct((F.col("l_orderkey") * 1000 + F.col("l_linenumber")).alias("id"), "l_partkey", "l_suppkey").alias("triple_id"), F.when(F.col("l_linenumber") != 3, F.lit("SUPPLIES")).alias("rel_type"),
        F.lit("Supplier").alias("from_label"), F.lit("id").alias("from_pk"), F.create_map(F.lit("id"), s("l_suppkey")).alias("from_props"),
        F.lit("Part").alias("to_label"), F.lit("id").alias("to_pk"), F.create_map(F.when(F.col("l_linenumber") == 2, F.lit("nr")).otherwise(F.lit("id")), s("l_partkey")).alias("to_props"),
    )
    return build.missing_fields(t).select(F.col("triple_id.id").alias("triple_id"), "triple_id.l_partkey", "triple_id.l_suppkey", "problem")


@query("""SELECT source_doc, count(*) AS edges, count(DISTINCT from_key) AS suppliers, count(*) FILTER (triple_color = 'green') AS green FROM (
  SELECT l_orderkey AS source_doc, l_suppkey AS from_key, CASE WHEN l_returnflag = 'R' THEN 'red' ELSE 'green' END AS triple_color FROM lineitem
  WHERE l_suppkey % 10 <> 3) GROUP BY source_doc""")
def applied_edges(spark, d):
    """Edges with system columns, after nodes were deleted with the edges at them, with both ends in the store."""
    s = lambda c: F.col(c).cast("string")
    t = table(spark, d, "lineitem").select(
        F.lit("SUPPLIES").alias("rel_type"), F.lit("Supplier").alias("from_label"), F.lit("id").alias("from_pk"), F.create_map(F.lit("id"), s("l_suppkey")).alias("from_props"),
        F.lit("Part").alias("to_label"), F.lit("id").alias("to_pk"), F.create_map(F.lit("id"), s("l_partkey")).alias("to_props"), F.lit(None).cast("boolean").alias("manually_added"),
        F.col("l_orderkey").alias("doc"), s("l_linenumber").alias("triple_id"), F.when(F.col("l_returnflag") == "R", "red").alias("triple_color"), F.lit(" ").alias("supporting_quote"),
    )
    edges, nodes = build.applied(t, F.col("doc"), "r1")
    gone = table(spark, d, "supplier").where("s_suppkey % 10 = 3").select(F.lit("Supplier").alias("label"), s("s_suppkey").alias("key"))
    left, edges = build.delete_node(nodes, edges, gone)
    kept = build.with_endpoints(edges, left)
    return kept.groupBy("source_doc").agg(F.count(F.lit(1)).alias("edges"), F.countDistinct("from_key").alias("suppliers"), F.count_if(F.col("triple_color") == "green").alias("green"))


@query("""SELECT count(*) AS documents, count(*) FILTER (l.doc_id IS NOT NULL) AS skipped, coalesce(sum(n) FILTER (l.doc_id IS NULL), 0)::BIGINT AS chunks,
  ((coalesce(sum(c) FILTER (l.doc_id IS NULL), 0) + coalesce(sum(n) FILTER (l.doc_id IS NULL), 0) * 3000) // 4)::BIGINT AS tokens
  FROM (SELECT doc_id, CASE WHEN length(text) <= 20000 THEN 1 ELSE ceil((length(text) - 20000) / 18000.0) + 1 END AS n,
    CASE WHEN length(text) <= 20000 THEN length(text) ELSE length(text) + 2000 * ceil((length(text) - 20000) / 18000.0) END AS c FROM documents) d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)""")
def build_estimate(spark, d):
    """Documents, what is built already, chunks and tokens; no text of these tables has sections."""
    return build.estimate(table(spark, d, "documents"), table(spark, d, "labels").select("doc_id").distinct(), 3000)


@query("""SELECT key, service FROM (SELECT DISTINCT user_id::VARCHAR || ':' || event_type AS key, event_type AS service FROM events) WHERE NOT (contains(lower(key), 'cli') AND service = 'click')""")
def cache_evict(spark, d):
    cache = table(spark, d, "events").select(F.concat(F.col("user_id").cast("string"), F.lit(":"), "event_type").alias("cache_key"), F.col("event_type").alias("service")).distinct()
    return build.evicted(cache, "CLI", "click").select(F.col("cache_key").alias("key"), "service")


@query("""SELECT p_partkey, len(list_intersect([p_type], ['ECONOMY', 'SMALL'])) > 0 AS type_ok, p_size % 3 = 0 OR p_brand = 'Brand#1' AS vocabulary_ok FROM part""")
def build_gates(spark, d):
    known = F.when(F.col("p_size") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array("p_brand"))
    return table(spark, d, "part").select("p_partkey", build.type_allowed(F.array("p_type"), F.array(F.lit("ECONOMY"), F.lit("SMALL"))).alias("type_ok"), build.vocabulary_ok(known, F.array(F.lit("Brand#1"))).alias("vocabulary_ok"))


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'green' WHEN p_size % 3 = 0 THEN 'yellow' ELSE 'red' END AS class FROM part""")
def entity_classes(spark, d):
    p = table(spark, d, "part")
    text = F.when((F.col("p_size") % 2 == 0) | (F.col("p_size") % 3 == 0), F.concat(F.lit("about "), F.upper("p_name"), F.lit("."))).otherwise(F.lit("nothing, qq"))
    quote = F.when(F.col("p_size") % 2 == 0, F.concat("p_name", F.lit(" is here"))).otherwise(F.lit(" "))
    return p.select("p_partkey", grounding.entity_class(F.col("p_name"), text, quote).alias("class"))


@query("""SELECT term, label, max_by(key, i) AS key FROM (SELECT p_name AS term, 'Part' AS label, min(p_partkey) AS key, 0 AS i FROM part GROUP BY 1 UNION ALL SELECT p_name, 'Part', max(p_partkey), 1 FROM part WHERE p_size > 25 GROUP BY 1) GROUP BY term, label""")
def unified_resolvers(spark, d):
    p = table(spark, d, "part")
    of = lambda rows, agg: rows.groupBy(F.col("p_name").alias("term")).agg(agg("p_partkey").alias("key")).withColumn("label", F.lit("Part"))
    return build.later_resolver([of(p, F.min), of(p.where("p_size > 25"), F.max)])
