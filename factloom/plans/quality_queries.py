"""Queries for grading, resolution, harvest, evaluation and caches."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import grading, metrics, resolve
from factloom.operators.harvest import harvest
from factloom.plans.graph_queries import FACTS, facts
from factloom.plans.registry import query
from factloom.session import table


@query("""SELECT p_partkey, list_intersect(actual, expected) = [] AND actual <> [] AS violated FROM (
  SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN []::VARCHAR[] ELSE [p_type] END AS actual, ['ECONOMY', CASE WHEN p_size > 25 THEN 'SMALL' ELSE 'LARGE' END] AS expected FROM part)""")
def type_mismatch(spark, d):
    """Types known and disjoint from the expected ones."""
    actual = F.when(F.col("p_size") % 7 == 0, F.array().cast("array<string>")).otherwise(F.array("p_type"))
    expected = F.array(F.lit("ECONOMY"), F.when(F.col("p_size") > 25, "SMALL").otherwise("LARGE"))
    return table(spark, d, "part").select("p_partkey", (~F.arrays_overlap(actual, expected) & (F.size(actual) > 0)).alias("violated"))


@query("""SELECT doc_id, trim(coalesce(text, '')) = '' OR length(text) < 40 AS red_floor, source = 'src1' AND strpos(text, '|') > 0 AS fabricated FROM documents""")
def structural(spark, d):
    return table(spark, d, "documents").select("doc_id", ((F.trim(F.coalesce("text", F.lit(""))) == "") | (F.length("text") < 40)).alias("red_floor"), ((F.col("source") == "src1") & F.col("text").contains("|")).alias("fabricated"))


@query(f"""WITH {FACTS}, g AS (SELECT doc, ord, CASE WHEN doc % 4 = 0 THEN NULL ELSE color END AS grade, CASE WHEN ord = 1 THEN 'green' END AS anchor, CASE WHEN qty > 45 THEN 'red' WHEN qty > 40 THEN 'yellow' END AS floor, qty = 7 AS violated FROM facts),
  r AS (SELECT *, CASE grade WHEN 'red' THEN 2 WHEN 'yellow' THEN 1 ELSE 0 END AS gr, CASE floor WHEN 'red' THEN 2 WHEN 'yellow' THEN 1 END AS fl FROM g)
  SELECT doc, ord, grade IS NOT NULL AS reviewed, CASE WHEN violated THEN 'red' WHEN grade IS NOT NULL THEN ['green', 'yellow', 'red'][greatest(CASE WHEN anchor IS NOT NULL THEN 0 ELSE gr END, gr, coalesce(fl, 0)) + 1] ELSE floor END AS color FROM r""")
def verdict_merge(spark, d):
    f = facts(spark, d)
    grade = F.when(F.col("doc") % 4 == 0, F.lit(None).cast("string")).otherwise(F.col("color"))
    floor = F.when(F.col("qty") > 45, "red").when(F.col("qty") > 40, "yellow")
    graded = f.select("doc", "ord", grade.alias("from_grade"), grade.alias("to_grade"), F.when(F.col("ord") == 1, "green").alias("from_anchor"), F.lit(None).cast("string").alias("to_anchor"), floor.alias("floor"), (F.col("qty") == 7).alias("violated"))
    return grading.verdict_merge(graded).select("doc", "ord", "reviewed", "color")


@query(f"""WITH {FACTS}, m AS (SELECT doc, 'Supplier' AS label, from_key AS entity FROM facts UNION ALL SELECT doc, 'Part', to_key FROM facts)
  SELECT doc, label, count(*) AS mentions, min(entity) AS entity FROM m GROUP BY doc, label HAVING count(DISTINCT entity) = 1 AND count(*) >= 2""")
def subject_label(spark, d):
    sides = F.array(F.struct(F.lit("Supplier").alias("label"), F.col("from_key").alias("entity")), F.struct(F.lit("Part").alias("label"), F.col("to_key").alias("entity")))
    return grading.subject_labels(facts(spark, d).select("doc", F.explode(sides).alias("m")).select("doc", "m.*"))


@query("""SELECT p_partkey, list_filter(['ring', 'bolt', 'widget'], lambda m: contains(p_name, m))[1] AS marker FROM part""")
def plausibility_note(spark, d):
    """The first marker of a list that a name has; a note only."""
    markers = F.array(*[F.lit(m) for m in ("ring", "bolt", "widget")])
    return table(spark, d, "part").select("p_partkey", F.try_element_at(F.filter(markers, lambda m: F.col("p_name").contains(m)), F.lit(1)).alias("marker"))


@query("""SELECT p_partkey, starts_with(resolved, term || ' ') AND len(list_filter(string_split(substr(resolved, length(term) + 2), ' '), lambda w: NOT list_contains(['holdings', 'ltd'], w))) > 0 AS suspicious
  FROM (SELECT p_partkey, p_name AS term, p_name || CASE p_size % 3 WHEN 0 THEN ' holdings' WHEN 1 THEN ' partners ltd' ELSE '' END AS resolved FROM part)""")
def name_suspicious(spark, d):
    """A resolved name that goes on after the term with words that aren't of a legal form."""
    term = F.col("p_name")
    resolved = F.concat(term, F.when(F.col("p_size") % 3 == 0, " holdings").when(F.col("p_size") % 3 == 1, " partners ltd").otherwise(""))
    a, b = F.split(term, " "), F.split(resolved, " ")
    extra = F.exists(F.slice(b, F.size(a) + 1, F.greatest(F.size(b) - F.size(a), F.lit(0))), lambda w: ~w.isin("holdings", "ltd"))
    return table(spark, d, "part").select("p_partkey", ((F.slice(b, 1, F.size(a)) == a) & (F.size(b) > F.size(a)) & extra).alias("suspicious"))


_CANDIDATES = """cand AS (SELECT p_name AS term, (p_size % 3)::INT AS stage, p_partkey AS rank, p_partkey AS key, CASE WHEN p_partkey % 5 = 0 THEN p_name ELSE p_name || ' x' END AS name,
  CASE WHEN p_type = 'ECONOMY' THEN 'GENERAL' ELSE 'OTHER' END AS category, CASE WHEN p_size % 2 = 0 THEN 'ISSUED' ELSE 'LAPSED' END AS status FROM part)"""


def _candidates(spark, d):
    return table(spark, d, "part").select(
        F.col("p_name").alias("term"), (F.col("p_size") % 3).alias("stage"), F.col("p_partkey").alias("rank"), F.col("p_partkey").alias("key"),
        F.when(F.col("p_partkey") % 5 == 0, F.col("p_name")).otherwise(F.concat("p_name", F.lit(" x"))).alias("name"),
        F.when(F.col("p_type") == "ECONOMY", "GENERAL").otherwise("OTHER").alias("category"), F.when(F.col("p_size") % 2 == 0, "ISSUED").otherwise("LAPSED").alias("status"),
    )


@query(f"WITH {_CANDIDATES} SELECT term, stage, key FROM cand QUALIFY stage = min(stage) OVER (PARTITION BY term)")
def resolve_cascade(spark, d):
    return resolve.cascade(_candidates(spark, d)).select("term", "stage", "key")


@query(f"WITH {_CANDIDATES} SELECT term, key, (row_number() OVER (PARTITION BY term ORDER BY category <> 'GENERAL', status <> 'ISSUED', rank))::INT AS place FROM cand")
def candidate_rank(spark, d):
    return resolve.rank(_candidates(spark, d)).select("term", "key", "place")


@query(f"""WITH {_CANDIDATES} SELECT term, count(*) AS n, CASE WHEN count(*) = 1 THEN 'single' WHEN min(CASE WHEN lower(name) = lower(term) THEN key END) IS NOT NULL THEN 'exact' ELSE 'ambiguous' END AS verdict,
  CASE WHEN count(*) = 1 THEN min(key) ELSE min(CASE WHEN lower(name) = lower(term) THEN key END) END AS key FROM cand GROUP BY term""")
def resolve_prefilter(spark, d):
    return resolve.prefilter(_candidates(spark, d))


@query("SELECT n_nationkey, n_name, r_name AS parent FROM nation LEFT JOIN region ON r_regionkey = n_regionkey AND r_regionkey <> 2")
def parent_lookup(spark, d):
    parents = table(spark, d, "region").where("r_regionkey <> 2").select("r_regionkey", F.col("r_name").alias("parent"))
    return table(spark, d, "nation").join(parents, F.col("n_regionkey") == F.col("r_regionkey"), "left").select("n_nationkey", "n_name", "parent")


@query("SELECT DISTINCT trim(p_name) AS term, p_type AS label FROM part WHERE p_name NOT IN (SELECT p_name FROM part WHERE p_size = 50)")
def unresolved_terms(spark, d):
    terms = table(spark, d, "part").select(F.trim("p_name").alias("term"), F.col("p_type").alias("label"), "p_size")
    return resolve.unresolved(terms, terms.where("p_size = 50").select("term", F.col("label").alias("other")).select("term"), ["term"]).join(terms.select("term", "label").distinct(), "term")


_SIGNALS = """signals AS (SELECT event_id AS seq, 'rel' || (user_id % 5) AS rel, (user_id % 40)::VARCHAR AS key, event_type AS type, ts,
  CASE event_type WHEN 'error' THEN 'suppress' WHEN 'signup' THEN 'restore' ELSE 'none' END AS kind,
  CASE event_type WHEN 'error' THEN 99 WHEN 'signup' THEN 1 WHEN 'purchase' THEN 2 WHEN 'click' THEN 4 END AS priority,
  user_id % 40 || '/' || event_type AS entry_id FROM events)"""


def _signals(spark, d):
    kind = F.when(F.col("event_type") == "error", "suppress").when(F.col("event_type") == "signup", "restore").otherwise("none")
    priority = F.when(F.col("event_type") == "error", 99).when(F.col("event_type") == "signup", 1).when(F.col("event_type") == "purchase", 2).when(F.col("event_type") == "click", 4)
    key = (F.col("user_id") % 40).cast("string")
    return table(spark, d, "events").select(F.col("event_id").alias("seq"), F.concat(F.lit("rel"), (F.col("user_id") % 5).cast("string")).alias("rel"), key.alias("key"), "ts", kind.alias("kind"), priority.alias("priority"), F.concat(key, F.lit("/"), "event_type").alias("entry_id"))


@query(f"""WITH {_SIGNALS}, gone AS (SELECT rel, key FROM signals WHERE kind <> 'none' GROUP BY rel, key HAVING arg_max(kind, seq) = 'suppress'),
  entries AS (SELECT * FROM signals WHERE priority IS NOT NULL QUALIFY row_number() OVER (PARTITION BY rel, entry_id ORDER BY priority, seq) = 1),
  pos AS (SELECT * FROM entries ANTI JOIN gone USING (rel, key) WHERE priority < 99 QUALIFY row_number() OVER (PARTITION BY rel ORDER BY priority, ts, entry_id) <= 20),
  neg AS (SELECT * FROM entries WHERE priority = 99 QUALIFY row_number() OVER (PARTITION BY rel ORDER BY ts DESC, entry_id) <= 3)
  SELECT rel, entry_id, priority FROM pos UNION ALL SELECT rel, entry_id, priority FROM neg""")
def harvest_store(spark, d):
    return harvest(_signals(spark, d)).select("rel", "entry_id", "priority")


def _gold(spark, d):
    return table(spark, d, "labels").where("quality = 1").select("doc_id")


def _predicted(spark, d):
    return table(spark, d, "documents").where("length(text) >= 500").select("doc_id")


_FOUND = """found AS (SELECT coalesce(g.doc_id, p.doc_id) AS doc_id, g.doc_id IS NOT NULL AS in_gold, p.doc_id IS NOT NULL AS in_pred
  FROM (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) g FULL JOIN (SELECT DISTINCT doc_id FROM documents WHERE length(text) >= 500) p ON g.doc_id = p.doc_id)"""
_PRF = "tp, fp, fn, p AS precision, r AS recall, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END AS f1"
_PR = "*, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS r"
_COUNTS = "count(*) FILTER (in_gold AND in_pred) AS tp, count(*) FILTER (in_pred AND NOT in_gold) AS fp, count(*) FILTER (in_gold AND NOT in_pred) AS fn"


@query(f"WITH {_FOUND} SELECT doc_id, in_gold, in_pred FROM found")
def gold_full_join(spark, d):
    return metrics.compare(_gold(spark, d), _predicted(spark, d), ["doc_id"])


@query(f"WITH {_FOUND} SELECT {_PRF} FROM (SELECT {_PR} FROM (SELECT {_COUNTS} FROM found))")
def gold_metrics(spark, d):
    return metrics.prf(metrics.compare(_gold(spark, d), _predicted(spark, d), ["doc_id"]), ["doc_id"])


@query(f"WITH {_FOUND} SELECT source, {_PRF} FROM (SELECT {_PR} FROM (SELECT source, {_COUNTS} FROM found JOIN documents USING (doc_id) GROUP BY source))")
def metrics_by_group(spark, d):
    found = metrics.compare(_gold(spark, d), _predicted(spark, d), ["doc_id"]).join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return metrics.prf(found, ["doc_id"], ["source"])


@query("SELECT doc_id FROM labels WHERE quality = 1 UNION SELECT doc_id FROM documents WHERE length(text) >= 500")
def extracted_union(spark, d):
    return _gold(spark, d).unionByName(_predicted(spark, d)).distinct()


@query(f"""WITH {FACTS} SELECT coalesce(doc::VARCHAR, 'total') AS file, count(*) AS total, count(*) FILTER (color = 'green') AS green, count(DISTINCT from_key) AS suppliers, round(count(*) FILTER (color = 'green') / count(*), 3) AS green_share FROM facts GROUP BY ROLLUP (doc)""")
def run_stats(spark, d):
    """Per document and in total."""
    rolled = facts(spark, d).rollup("doc").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("color") == "green").alias("green"), F.countDistinct("from_key").alias("suppliers"))
    return rolled.select(F.coalesce(F.col("doc").cast("string"), F.lit("total")).alias("file"), "total", "green", "suppliers", F.round(F.col("green") / F.col("total"), 3).alias("green_share"))


@query("""SELECT event_type AS service, count(*) AS n, min(event_id) AS oldest, max(event_id) AS newest FROM (SELECT * FROM events WHERE ts >= (SELECT max(ts) - INTERVAL 10 DAY FROM events) AND NOT contains(lower(props), '"k": 3')) GROUP BY event_type""")
def cache_stats(spark, d):
    """A cache table after expiry by time and eviction by pattern, by service."""
    rows = table(spark, d, "events").select("event_id", "ts", "event_type", "props")
    newest = rows.agg(F.max("ts").alias("m"))  # one row
    live = rows.crossJoin(F.broadcast(newest)).where((F.col("ts") >= F.col("m") - F.expr("INTERVAL 10 DAYS")) & ~F.lower("props").contains('"k": 3'))
    return live.groupBy(F.col("event_type").alias("service")).agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("oldest"), F.max("event_id").alias("newest"))


@query("""SELECT conv_id, count(*) AS turns, sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS said, CASE WHEN max(turn) >= 3 THEN 'write' WHEN max(turn) >= 1 THEN 'extract' ELSE 'new' END AS status FROM conversations GROUP BY conv_id""")
def run_listing(spark, d):
    """Runs with what was done in them, from their log."""
    status = F.when(F.max("turn") >= 3, "write").when(F.max("turn") >= 1, "extract").otherwise("new")
    said = F.sum(F.when(F.col("role") == "assistant", F.length("text")).otherwise(0))
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), said.alias("said"), status.alias("status"))


@query(f"""WITH {FACTS} SELECT doc, CASE WHEN list_contains(c, 'red') THEN 'red' WHEN list_contains(c, 'yellow') THEN 'yellow' ELSE 'green' END AS worst, CASE WHEN list_contains(c, 'green') THEN 'green' WHEN list_contains(c, 'yellow') THEN 'yellow' ELSE 'red' END AS best
  FROM (SELECT doc, list(DISTINCT color) AS c FROM facts GROUP BY doc)""")
def worst_best_color(spark, d):
    colors = facts(spark, d).groupBy("doc").agg(F.collect_set("color").alias("c"))
    return colors.select("doc", grading.worst(F.col("c")).alias("worst"), grading.best(F.col("c")).alias("best"))


@query("SELECT doc_id, CASE WHEN n_chars < 200 AND level = 'strong' THEN 'moderate' WHEN level = 'moderate' AND n_chars < 600 THEN 'weak' ELSE level END AS level FROM (SELECT doc_id, n_chars, CASE WHEN doc_id % 2 = 0 THEN 'strong' ELSE 'moderate' END AS level FROM documents)")
def evidence_level(spark, d):
    """One step down at most."""
    level = F.when(F.col("doc_id") % 2 == 0, "strong").otherwise("moderate")
    down = F.when((F.col("n_chars") < 200) & (level == "strong"), "moderate").when((level == "moderate") & (F.col("n_chars") < 600), "weak").otherwise(level)
    return table(spark, d, "documents").select("doc_id", down.alias("level"))


@query(f"WITH {FACTS} SELECT doc, ord, ((row_number() OVER (PARTITION BY doc ORDER BY ord) - 1) // 3)::INT AS batch FROM facts")
def batching(spark, d):
    return facts(spark, d).select("doc", "ord", F.floor((F.col("ord") - 1) / 3).cast("int").alias("batch"))


@query("""SELECT substr(sha256(string_agg(p_name || '=' || p_partkey, ',' ORDER BY p_name, p_partkey)), 1, 16) AS signature, p_brand FROM part GROUP BY p_brand""")
def group_signature(spark, d):
    """Hash of a group's sorted entries."""
    listed = F.array_sort(F.collect_list(F.struct("p_name", "p_partkey")))
    joined = F.array_join(F.transform(listed, lambda s: F.concat(s["p_name"], F.lit("="), s["p_partkey"].cast("string"))), ",")
    return table(spark, d, "part").groupBy("p_brand").agg(F.substring(F.sha2(joined, 256), 1, 16).alias("signature"))


