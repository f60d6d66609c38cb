"""Queries over texts: chunking, grounding, normalisation, reading."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import text as tx
from factloom.operators import grounding as gr
from factloom.plans.registry import query
from factloom.session import table

EDGE_SQL = tx.EDGE.replace("'", "''")
#: Words of a text in SQL: cores of its runs of non-space, empty ones dropped.
FOLD_SQL = "translate(lower({x}), '“”‘’', '\"\"''''')"
CLEAN_SQL = r"regexp_replace(translate({x}, '|', ' '), '([A-Za-z])\.([A-Z][a-z])', '\1 \2', 'g')"
WORDS_SQL = "list_filter(list_transform(regexp_extract_all({x}, '\\S+'), lambda w: translate(trim(" + FOLD_SQL.replace("{x}", "w") + ", '" + EDGE_SQL + "'), '\"', '''')), lambda w: w <> '')"
SUFFIX_SQL = "[" + ", ".join(f"'{w}'" for w in tx.LEGAL_SUFFIXES) + "]"
STOP_SQL = "[" + ", ".join(f"'{w}'" for w in tx.SHORT_STOP) + "]"
#: Documents against quotes of one fragment: the joined words hold the quote's; offsets from the words before.
GROUND_SQL = f"""
docs AS (SELECT doc_id, text, {CLEAN_SQL.replace("{x}", "text")} AS cleaned FROM documents),
quotes AS (SELECT item_id AS quote_id, text AS quote, ' ' || array_to_string({WORDS_SQL.replace("{x}", CLEAN_SQL.replace("{x}", "text"))}, ' ') || ' ' AS q FROM benchmark),
cored AS (SELECT doc_id, text, regexp_extract_all(cleaned, '\\s*\\S+') AS runs FROM docs),
toks AS (SELECT doc_id, text, runs, list_transform(runs, lambda r: translate(trim({FOLD_SQL.replace("{x}", "ltrim(r, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")}, '{EDGE_SQL}'), '"', '''')) AS cores FROM cored),
hits AS (
  SELECT quote_id, doc_id, text, runs, cores, q, ' ' || array_to_string(list_filter(cores, lambda c: c <> ''), ' ') || ' ' AS joined
  FROM toks, quotes WHERE trim(q) <> '' AND contains(' ' || array_to_string(list_filter(cores, lambda c: c <> ''), ' ') || ' ', q)),
placed AS (
  SELECT quote_id, doc_id, text, runs, cores,
         list_filter(range(1, len(cores) + 1), lambda i: cores[i] <> '') AS idx,
         len(regexp_extract_all(substr(joined, 1, strpos(joined, q) - 1), ' ')) + 1 AS first,
         len(regexp_extract_all(trim(q), ' ')) + 1 AS n
  FROM hits),
ends AS (SELECT *, idx[first] AS a, idx[first + n - 1] AS b FROM placed),
offs AS (
  SELECT *, coalesce(list_sum(list_transform(runs[1:a - 1], lambda r: length(r))), 0) + length(runs[a]) - length(ltrim(runs[a], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || '{EDGE_SQL}')) AS s,
         list_sum(list_transform(runs[1:b], lambda r: length(r))) - (length(runs[b]) - length(rtrim(runs[b], '{EDGE_SQL}'))) AS e
  FROM ends),
spans AS (SELECT quote_id, doc_id, text, s::INT AS start, e::INT AS "end", substr(text, s::INT + 1, (e - s)::INT) AS evidence FROM offs)
"""


def _quotes(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote"))


@query(f"WITH {GROUND_SQL} SELECT quote_id, doc_id, start, \"end\", evidence, 'f' || substr(sha256('QUOTED' || chr(0) || quote_id || chr(0) || doc_id), 1, 12) AS fact_id FROM spans")
def ground_quotes(spark, d):
    found = gr.ground(_quotes(spark, d), table(spark, d, "documents"))
    return found.withColumn("fact_id", tx.fact_id(F.lit("QUOTED"), F.col("quote_id").cast("string"), F.col("doc_id").cast("string")))


@query(f"WITH {GROUND_SQL} SELECT doc_id, count(*) AS spans, min(start) AS first_start, max(\"end\") AS last_end FROM spans GROUP BY doc_id")
def evidence_spans(spark, d):
    found = gr.ground(_quotes(spark, d), table(spark, d, "documents"))
    return found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("spans"), F.min("start").alias("first_start"), F.max("end").alias("last_end"))


@query(
    f"""WITH {GROUND_SQL}, near AS (SELECT *, substr(text, greatest(start - 80, 0) + 1, least(start, 80)) AS b, substr(text, "end" + 1, 80) AS a FROM spans)
    SELECT quote_id, doc_id, string_split(b, chr(10) || chr(10))[-1] || substr(text, start + 1, "end" - start) || string_split(a, chr(10) || chr(10))[1] AS context FROM near"""
)
def context_window(spark, d):
    found = gr.located(_quotes(spark, d), table(spark, d, "documents"))
    return found.select("quote_id", "doc_id", gr.context(F.col("text"), F.col("start"), F.col("end"), 80).alias("context"))


@query(f"""WITH parts AS (SELECT item_id, unnest(string_split(replace(text, '. ', '…'), '…')) AS part FROM benchmark),
  cored AS (SELECT item_id, {WORDS_SQL.replace("{x}", CLEAN_SQL.replace("{x}", "part"))} AS ws FROM parts)
  SELECT item_id, count(*)::INT AS fragments, sum(len(ws))::INT AS words FROM cored WHERE len(ws) > 0 GROUP BY item_id""")
def quote_fragments(spark, d):
    """Fragments of whole passages, with ellipses where sentences end."""
    parts = tx.fragments(tx.clean(F.replace("text", F.lit(". "), F.lit("…"))))
    found = table(spark, d, "benchmark").select("item_id", parts.alias("p")).where(F.size("p") > 0)
    return found.select("item_id", F.size("p").alias("fragments"), F.size(F.flatten("p")).alias("words"))


_LEVELS = ("loose", "moderate", "strict")


@query(
    f"""WITH {GROUND_SQL}, found AS (SELECT DISTINCT quote_id FROM spans), levels(level) AS (VALUES ('loose'), ('moderate'), ('strict'))
    SELECT item_id AS quote_id, level, CASE WHEN level <> 'strict' THEN true ELSE f.quote_id IS NOT NULL AND trim(text) <> '' END AS kept, f.quote_id IS NULL AS warned
    FROM benchmark LEFT JOIN found f ON f.quote_id = item_id, levels"""
)
def verify_by_level(spark, d):
    quotes = _quotes(spark, d)
    found = gr.ground(quotes, table(spark, d, "documents")).select("quote_id").distinct().withColumn("located", F.lit(True))
    judged = quotes.join(found, "quote_id", "left").withColumn("located", F.coalesce("located", F.lit(False)))
    levels = F.array(*[F.struct(F.lit(x).alias("level"), gr.verify(F.col("located"), F.col("quote"), x).alias("kept")) for x in _LEVELS])
    return judged.select("quote_id", F.explode(levels).alias("x"), (~F.col("located")).alias("warned")).select("quote_id", "x.level", "x.kept", "warned")


_NAMES = "SELECT unnest(['The Inc', 'ting Group', 'idiot Holdings', 'MIT License', 'ndonan Ltd']) AS entity"


@query(
    f"""WITH names AS ({_NAMES}), n AS (SELECT entity, array_to_string(list_filter(string_split_regex(lower(entity), '[\\s,.]+'), lambda w: w <> '' AND NOT list_contains({SUFFIX_SQL}, w)), ' ') AS body,
      list_filter(string_split_regex(entity, '[\\s,.\\-]+'), lambda w: length(w) >= 2) AS ws FROM names)
    SELECT entity, count(*) AS docs FROM documents, n
    WHERE contains(lower(text), lower(trim(entity))) OR (length(body) >= 3 AND contains(lower(text), body))
       OR len(list_filter(ws, lambda w: regexp_matches(text, '(?i)(^|[^\\pL\\pM\\pN_])' || regexp_escape(w) || '($|[^\\pL\\pM\\pN_])'))) > 0
    GROUP BY entity"""
)
def entity_in_text(spark, d):
    names = F.array(*[F.lit(x) for x in ("The Inc", "ting Group", "idiot Holdings", "MIT License", "ndonan Ltd")])
    pairs = table(spark, d, "documents").select("text", F.explode(names).alias("entity"))
    return pairs.where(gr.entity_in_text(F.col("entity"), F.col("text"))).groupBy("entity").agg(F.count(F.lit(1)).alias("docs"))


@query("""SELECT doc_id, trim(list_filter(string_split(text, chr(10)), lambda x: contains(lower(x), 'idiot'))[1]) AS line FROM documents WHERE contains(lower(text), 'idiot')""")
def rescue_line(spark, d):
    docs = table(spark, d, "documents").where(F.lower("text").contains("idiot"))
    return docs.select("doc_id", gr.rescue_line(F.col("text"), F.lit("idiot")).alias("line"))


@query(
    f"""WITH {GROUND_SQL} SELECT quote_id, doc_id, substr('> ' || text, start + 1, "end" - start) = evidence AS same_place, start + 2 AS new_start FROM spans"""
)
def reanchor_drift(spark, d):
    """Stored offsets are trusted only where an edited text still has the same words there; else the quote is located again."""
    found = gr.located(_quotes(spark, d), table(spark, d, "documents")).withColumn("edited", F.concat(F.lit("> "), F.col("text")))
    same = F.substring("edited", F.col("start") + 1, F.col("end") - F.col("start")) == F.col("evidence")
    again = gr.locate(F.col("evidence"), F.col("edited"))["start"]
    return found.select("quote_id", "doc_id", same.alias("same_place"), F.when(same, F.col("start")).otherwise(again).alias("new_start"))


@query(
    f"""WITH {GROUND_SQL}, terms AS (SELECT quote_id, string_split(trim(q), ' ')[1] AS a, string_split(trim(q), ' ')[-1] AS b FROM quotes)
    SELECT s.quote_id, doc_id, 'green' AS anchor, regexp_matches(lower(evidence), '\\b(not|no|without|never|absence of|ruled out|denied|in animals|not in humans|no evidence|did not|does not|were not|was not)\\b') AS possible_negation,
           contains(lower(evidence), a) AND contains(lower(evidence), b) AS colocated
    FROM spans s JOIN terms t USING (quote_id)"""
)
def relation_hints(spark, d):
    cue = r"\b(not|no|without|never|absence of|ruled out|denied|in animals|not in humans|no evidence|did not|does not|were not|was not)\b"
    quotes = _quotes(spark, d)
    found = gr.ground(quotes, table(spark, d, "documents")).join(quotes, "quote_id")
    ws = tx.words(tx.clean(F.col("quote")))
    low = F.lower("evidence")
    both = low.contains(F.element_at(ws, 1)) & low.contains(F.element_at(ws, -1))
    return found.select("quote_id", "doc_id", F.lit("green").alias("anchor"), low.rlike(cue).alias("possible_negation"), both.alias("colocated"))


@query(
    """SELECT doc_id, k AS chunk_no, (k * 1800)::INT AS start, substr(text, k * 1800 + 1, 2000) AS chunk
    FROM (SELECT doc_id, text, unnest(range(0, greatest(ceil((length(text) - 2000) / 1800.0), 0)::INT + 1)) AS k FROM documents)"""
)
def doc_chunks(spark, d):
    chunks = table(spark, d, "documents").select("doc_id", F.posexplode(tx.char_chunks(F.col("text"), 2000, 200)).alias("chunk_no", "c"))
    return chunks.select("doc_id", "chunk_no", F.col("c.start").cast("int").alias("start"), F.col("c.text").alias("chunk"))


@query(
    """WITH RECURSIVE md AS (SELECT doc_id, regexp_replace(text, '(^|\n)([A-Z])', '\\1## \\2', 'g') AS t FROM documents),
    parts AS (SELECT doc_id, list_filter(string_split(regexp_replace(t, '(^|\n)(#{1,3}\\s)', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda s: s <> '') AS p FROM md),
    pack AS (
      SELECT doc_id, p, 1 AS i, ''::VARCHAR AS held, []::VARCHAR[] AS done FROM parts
      UNION ALL
      SELECT doc_id, p, i + 1,
        CASE WHEN length(p[i]) > 1000 THEN '' WHEN length(held) + length(p[i]) <= 1000 THEN held || p[i] ELSE p[i] END,
        CASE WHEN length(p[i]) > 1000 THEN list_concat(CASE WHEN held <> '' THEN list_append(done, held) ELSE done END,
                  list_transform(range(0, ceil((length(p[i]) - 1000) / 900.0)::INT + 1), lambda k: substr(p[i], (k * 900 + 1)::INT, 1000)))
             WHEN length(held) + length(p[i]) <= 1000 THEN done WHEN held <> '' THEN list_append(done, held) ELSE done END
      FROM pack WHERE i <= len(p)),
    ended AS (SELECT doc_id, CASE WHEN held <> '' THEN list_append(done, held) ELSE done END AS c FROM pack WHERE i = len(p) + 1)
    SELECT doc_id, len(c)::INT AS chunks, list_max(list_transform(c, lambda x: length(x)))::INT AS longest, md5(array_to_string(c, chr(1))) AS digest FROM ended WHERE len(c) > 0"""
)
def section_chunks(spark, d):
    marked = F.regexp_replace("text", r"(^|\n)([A-Z])", "$1## $2")
    cut = table(spark, d, "documents").where("length(text) > 0").select("doc_id", tx.section_chunks(marked, 1000, 100).alias("c"))
    longest = F.array_max(F.transform("c", F.length))
    return cut.select("doc_id", F.size("c").alias("chunks"), longest.alias("longest"), F.md5(F.array_join("c", "\x01")).alias("digest"))


@query(
    """SELECT abbr, min(name) AS name, count(*) AS uses FROM (
      SELECT trim(regexp_extract(t, '([A-Za-z][\\w\\- ]*?)\\s*\\(([A-Z][A-Z0-9\\-]{1,8})\\)', 1)) AS name, regexp_extract(t, '([A-Za-z][\\w\\- ]*?)\\s*\\(([A-Z][A-Z0-9\\-]{1,8})\\)', 2) AS abbr
      FROM (SELECT p_name || ' (' || upper(substr(p_name, 1, 3)) || ')' AS t FROM part)) WHERE abbr <> '' AND len(string_split(name, ' ')) <= 5 GROUP BY abbr"""
)
def abbreviations(spark, d):
    """'Full Name (ABBR)' pairs; names of at most five words."""
    text = F.concat("p_name", F.lit(" ("), F.upper(F.substring("p_name", 1, 3)), F.lit(")"))
    pattern = r"([A-Za-z][\w\- ]*?)\s*\(([A-Z][A-Z0-9\-]{1,8})\)"
    found = table(spark, d, "part").select(F.trim(F.regexp_extract(text, pattern, 1)).alias("name"), F.regexp_extract(text, pattern, 2).alias("abbr"))
    return found.where((F.col("abbr") != "") & (F.size(F.split("name", " ")) <= 5)).groupBy("abbr").agg(F.min("name").alias("name"), F.count(F.lit(1)).alias("uses"))


@query(
    r"""SELECT page_id, length(html) AS n, md5(regexp_replace(translate(array_to_string(list_transform(range(1, 2), lambda i: html2), ''), '|', ' '), '([A-Za-z])\.([A-Z][a-z])', '\1 \2', 'g')) AS digest
    FROM (SELECT page_id, html, (SELECT string_agg(CASE WHEN k % 2 = 0 THEN seg ELSE repeat(' ', length(seg)) END, '' ORDER BY k)
          FROM (SELECT unnest(list_concat([split_all[1]], flatten(list_transform(range(1, len(split_all)), lambda j: [tags[j], split_all[j + 1]])))) AS seg,
                       unnest(range(0, 2 * len(split_all) - 1)) AS k
                FROM (SELECT string_split_regex(html, '</?[a-zA-Z][^>]*>') AS split_all, regexp_extract_all(html, '</?[a-zA-Z][^>]*>') AS tags))) AS html2 FROM pages)"""
)
def clean_text(spark, d):
    """Tags, pipes and run-on periods blanked; the length is unchanged."""
    return table(spark, d, "pages").select("page_id", F.length("html").cast("long").alias("n"), F.md5(tx.clean(F.col("html"))).alias("digest"))


@query("SELECT doc_id, substr(text, 101, 400) AS page, length(text) AS total, 100 + 400 < length(text) AS has_more FROM documents")
def read_page(spark, d):
    return table(spark, d, "documents").select("doc_id", F.substring("text", 101, 400).alias("page"), F.length("text").cast("long").alias("total"), (F.length("text") > 500).alias("has_more"))


@query(
    """SELECT doc_id, n::INT AS n, p::INT AS at, substr(text, greatest(p - 50, 1)::INT, 100) AS passage FROM (
      SELECT doc_id, text, p, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS n FROM (
        SELECT doc_id, text, unnest(list_filter(range(1, length(text) + 1), lambda i: substr(lower(text), i, 5) = 'idiot')) AS p FROM documents WHERE contains(lower(text), 'idiot'))) WHERE n <= 10"""
)
def search_passages(spark, d):
    """Overlapping, case-insensitive occurrences, the first ten of each document with their surroundings."""
    docs = table(spark, d, "documents").where(F.lower("text").contains("idiot"))
    places = tx.occurrences(F.lower("text"), "idiot")
    hits = docs.select("doc_id", "text", F.posexplode(F.slice(places, 1, 10)).alias("p", "at"))
    return hits.select("doc_id", (F.col("p") + 1).alias("n"), "at", F.substring("text", F.greatest(F.col("at") - 50, F.lit(1)), F.lit(100)).alias("passage"))


@query(
    """SELECT s_suppkey, [p FOR p IN list_sort(list_distinct(list_concat(range(1, (s_suppkey % 5 + 2)::INT), [(s_suppkey % 9 + 1)::INT]))) IF p <> 3] AS pages,
    len([p FOR p IN range(1, 11) IF NOT list_contains([2, 3], p) AND p <= s_suppkey % 10 + 1])::INT AS kept FROM supplier"""
)
def page_ranges(spark, d):
    text = F.concat(F.lit("1-"), (F.col("s_suppkey") % 5 + 1).cast("string"), F.lit(",9-4,x,"), (F.col("s_suppkey") % 9 + 1).cast("string"))
    pages = F.filter(tx.page_ranges(text), lambda p: p != 3)
    kept = tx.page_filter(F.sequence(F.lit(1), (F.col("s_suppkey") % 10 + 1).cast("int")), F.array(F.lit(2), F.lit(3)), F.lit(10))
    return table(spark, d, "supplier").select("s_suppkey", pages.cast("array<long>").alias("pages"), F.coalesce(F.size(kept), F.lit(0)).alias("kept"))


@query(
    """SELECT l_orderkey, string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a || '-' || b END, ',' ORDER BY a) AS ranges FROM (
      SELECT l_orderkey, min(l) AS a, max(l) AS b FROM (SELECT l_orderkey, l, l - row_number() OVER (PARTITION BY l_orderkey ORDER BY l) AS g FROM (SELECT DISTINCT l_orderkey, l_linenumber AS l FROM lineitem)) GROUP BY l_orderkey, g) GROUP BY l_orderkey"""
)
def range_compress(spark, d):
    """Runs of consecutive numbers as 'a-b'."""
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_set("l_linenumber")).alias("p"))
    zero = F.array().cast("array<struct<a:int,b:int>>")

    def add(acc, x):
        last = F.try_element_at(acc, F.lit(-1))
        on = F.coalesce(last["b"] + 1 == x, F.lit(False))
        longer = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(last["a"].alias("a"), x.alias("b"))))
        return F.when(on, longer).otherwise(F.concat(acc, F.array(F.struct(x.alias("a"), x.alias("b")))))

    runs = F.aggregate("p", zero, add)
    shown = F.transform(runs, lambda r: F.when(r["a"] == r["b"], r["a"].cast("string")).otherwise(F.concat(r["a"].cast("string"), F.lit("-"), r["b"].cast("string"))))
    return lines.select("l_orderkey", F.array_join(shown, ",").alias("ranges"))


_PARTS = "SELECT p_partkey, 'The ' || p_name || ', Holdings (old) Ltd.' AS name FROM part"


@query(
    f"""SELECT p_partkey, array_to_string(list_filter(string_split_regex(lower(name), '[\\s,.]+'), lambda w: w <> '' AND NOT list_contains({SUFFIX_SQL}, w)), ' ') AS normal,
    array_to_string(list_filter(string_split_regex(lower(name), '[\\s,.]+'), lambda w: w <> '' AND NOT list_contains({STOP_SQL}, w))[1:3], ' ') AS short,
    trim(regexp_replace(name, '\\s*\\([^)]*\\)', '', 'g')) AS bare FROM ({_PARTS})"""
)
def name_normalize(spark, d):
    named = table(spark, d, "part").select("p_partkey", F.concat(F.lit("The "), "p_name", F.lit(", Holdings (old) Ltd.")).alias("name"))
    return named.select("p_partkey", tx.normalize_entity(F.col("name")).alias("normal"), tx.short_form(F.col("name")).alias("short"), tx.strip_parenthetical(F.col("name")).alias("bare"))


@query("SELECT l_orderkey, l_suppkey, l_partkey, 'f' || substr(sha256('SUPPLIES' || chr(0) || l_suppkey || chr(0) || l_partkey), 1, 12) AS triple_id FROM lineitem")
def triple_ids(spark, d):
    key = tx.fact_id(F.lit("SUPPLIES"), F.col("l_suppkey").cast("string"), F.col("l_partkey").cast("string"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey", key.alias("triple_id"))
