"""Queries over what agents and services call: line search, highlighting, merge, cache, streamed windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import agent, cache
from factloom.operators import grounding as gr
from factloom.plans.registry import query
from factloom.plans.text_queries import GROUND_SQL, _quotes
from factloom.session import table
from factloom.streaming import ingest

STRIP_SQL = r"regexp_replace({x}, '^[\s\x0B]+|[\s\x0B]+$', '', 'g')"
LINES_SQL = r"list_filter(list_transform(string_split_regex(text, '\r\n|[\n\x0B\x0C\r\x1C-\x1E\x{85}\x{2028}\x{2029}]'), lambda x: " + STRIP_SQL.replace("{x}", "x") + "), lambda x: x <> '')"
SPACED_SQL = r"regexp_replace(lower({x}), '[\s\x0B]+', ' ', 'g')"
WANTED = "  The   "


@query(
    f"""WITH lines AS (SELECT doc_id, {LINES_SQL} AS lines FROM documents),
    hits AS (SELECT doc_id, n, line FROM (SELECT doc_id, unnest(range(1, len(lines) + 1)) AS n, unnest(lines) AS line FROM lines) WHERE contains({SPACED_SQL.replace("{x}", "line")}, 'the')),
    firsts AS (SELECT doc_id, line, min(n) AS n FROM hits GROUP BY doc_id, line),
    placed AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS place FROM firsts)
    SELECT doc_id, place, line FROM placed WHERE place <= 5"""
)
def line_search(spark, d):
    """The first five distinct lines of each document that hold a phrase; five is the feature's own limit."""
    docs = table(spark, d, "documents").select("doc_id", F.posexplode(agent.line_hits(F.col("text"), F.lit(WANTED))).alias("n", "line"))
    return docs.select("doc_id", (F.col("n") + 1).cast("long").alias("place"), "line")


TERM_SQL = """(SELECT doc_id, kind, n, i, len(cut) AS parts,
  (sum(length(cut[i])) OVER (PARTITION BY doc_id, kind ORDER BY i) + (i - 1) * n)::BIGINT AS start
  FROM (SELECT doc_id, kind, cut, n, unnest(range(1, len(cut) + 1)) AS i
    FROM (SELECT doc_id, kind, length(term) AS n, string_split(lower(text), term) AS cut FROM terms WHERE length(term) >= 2)))"""


@query(
    f"""WITH {GROUND_SQL}, terms AS (
      SELECT doc_id, text, 'subject' AS kind, lower(regexp_extract(text, '[A-Za-z]+')) AS term FROM documents
      UNION ALL SELECT doc_id, text, 'object', lower(regexp_extract(text, '[A-Za-z]+[^A-Za-z]+([A-Za-z]+)', 1)) FROM documents),
    marked AS (SELECT doc_id, kind, start, start + n AS stop FROM {TERM_SQL} WHERE i < parts UNION ALL SELECT doc_id, 'quote', start, "end" FROM spans),
    cuts AS (SELECT doc_id, start AS p FROM marked UNION SELECT doc_id, stop FROM marked UNION SELECT doc_id, 0 FROM documents WHERE text IS NOT NULL UNION SELECT doc_id, length(text) FROM documents WHERE text IS NOT NULL),
    pieces AS (SELECT doc_id, p AS start, lead(p) OVER (PARTITION BY doc_id ORDER BY p) AS stop FROM cuts),
    shown AS (SELECT p.doc_id, p.start, p.stop, min(CASE m.kind WHEN 'subject' THEN 0 WHEN 'object' THEN 1 WHEN 'quote' THEN 2 END) AS rank
      FROM pieces p LEFT JOIN marked m ON m.doc_id = p.doc_id AND m.start <= p.start AND p.start < m.stop WHERE p.stop IS NOT NULL GROUP BY ALL)
    SELECT doc_id, kind, count(*) AS pieces, sum(stop - start)::BIGINT AS chars, sum((start + 1) * stop)::BIGINT AS places
    FROM (SELECT *, CASE rank WHEN 0 THEN 'subject' WHEN 1 THEN 'object' WHEN 2 THEN 'quote' ELSE 'plain' END AS kind FROM shown) GROUP BY doc_id, kind"""
)
def highlight_pieces(spark, d):
    """Pieces of each document by what is highlighted: its first word as subject, its second as object, benchmark quotes as evidence."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    terms = docs.select("*", F.regexp_extract("text", "[A-Za-z]+", 0).alias("first"), F.regexp_extract("text", "[A-Za-z]+[^A-Za-z]+([A-Za-z]+)", 1).alias("second"))
    spans = gr.ground(_quotes(spark, d), docs).select("doc_id", "start", "end", F.lit("quote").alias("kind"))
    spans = spans.unionByName(agent.occurrences(terms, "first", "subject")).unionByName(agent.occurrences(terms, "second", "object"))
    pieces = agent.highlight(docs, spans)
    return pieces.groupBy("doc_id", F.coalesce("kind", F.lit("plain")).alias("kind")).agg(
        F.count(F.lit(1)).alias("pieces"), F.sum(F.col("end") - F.col("start")).alias("chars"), F.sum((F.col("start") + 1).cast("long") * F.col("end")).alias("places")
    )


@query(
    """WITH prev AS (SELECT o_orderkey AS id, o_orderpriority AS term, o_totalprice::VARCHAR AS quote, o_custkey AS cust, o_orderstatus AS status FROM orders WHERE o_orderstatus <> 'O'),
    agent AS (SELECT o_orderkey AS id, CASE WHEN o_orderpriority = '1-URGENT' THEN '' ELSE 'agent ' || o_orderpriority END AS term, o_custkey AS cust FROM orders WHERE o_totalprice > 200000)
    SELECT coalesce(a.id, p.id)::VARCHAR AS _id,
      CASE WHEN a.id IS NULL THEN 'batch' ELSE 'agent_retry' END AS extraction_source,
      CASE WHEN a.id IS NULL THEN p.term ELSE coalesce(nullif(a.term, ''), p.term) END AS from_term,
      CASE WHEN a.id IS NULL THEN p.status WHEN p.id IS NULL THEN NULL ELSE p.status END AS status,
      coalesce(a.cust, p.cust)::VARCHAR AS cust
    FROM prev p FULL OUTER JOIN agent a ON a.id = p.id"""
)
def agent_merge(spark, d):
    """An agent's facts (dear orders) merged into those of a batch (orders that aren't open)."""
    orders = table(spark, d, "orders")
    ident, cust = F.col("o_orderkey").cast("string").alias("_id"), F.col("o_custkey").cast("string")
    batch = orders.where("o_orderstatus <> 'O'").select(ident, F.lit("batch").alias("extraction_source"), F.col("o_orderpriority").alias("from_term"), F.create_map(F.lit("cust"), cust, F.lit("status"), F.col("o_orderstatus")).alias("rel_props"))
    term = F.when(F.col("o_orderpriority") == "1-URGENT", "").otherwise(F.concat(F.lit("agent "), "o_orderpriority"))
    retry = orders.where("o_totalprice > 200000").select(ident, term.alias("from_term"), F.create_map(F.lit("cust"), cust).alias("rel_props"))
    merged = agent.merge(batch, retry)
    return merged.select("_id", "extraction_source", "from_term", F.try_element_at("rel_props", F.lit("status")).alias("status"), F.try_element_at("rel_props", F.lit("cust")).alias("cust"))


@query(
    """WITH latest AS (SELECT o_orderpriority AS service, o_custkey AS k, max_by(o_orderkey::VARCHAR, (o_orderdate, o_orderkey::VARCHAR)) AS value, max(o_orderdate) AS at FROM orders GROUP BY ALL),
    asked AS (SELECT DISTINCT o_orderpriority AS service, c_custkey AS k FROM customer, (SELECT DISTINCT o_orderpriority FROM orders))
    SELECT asked.service, '["' || asked.k || '"]' AS cache_key, latest.value, latest.value IS NOT NULL AS hit
    FROM asked LEFT JOIN latest ON latest.service = asked.service AND latest.k = asked.k AND latest.at >= TIMESTAMP '1999-01-01' - INTERVAL 1000 DAY"""
)
def cache_lookup(spark, d):
    """Each customer's latest order of a priority as a cached value that expires after 1000 days."""
    orders, customers = table(spark, d, "orders"), table(spark, d, "customer")
    stored = orders.select(F.col("o_orderpriority").alias("service"), cache.key(F.col("o_custkey")).alias("cache_key"), F.col("o_orderkey").cast("string").alias("value"), F.col("o_orderdate").alias("created_at"))
    services = F.array_sort(F.collect_set("o_orderpriority"))
    # As many services as there are priorities: a row for each customer and service.
    asked = customers.join(F.broadcast(orders.agg(services.alias("s"))), F.lit(True)).select(cache.key(F.col("c_custkey")).alias("cache_key"), F.explode("s").alias("service"))
    return cache.lookup(asked, stored, F.lit("1999-01-01 00:00:00"), 1000)


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def event_windows(spark, d):
    return ingest.window_counts(table(spark, d, "events"), "ts", ["event_type"], "1 hour")
