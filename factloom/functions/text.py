"""Text functions as column expressions; none needs Python on the executors."""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that results depend on.
EDGE = "*_#>~`-.,;:!?\"'()[]{}“”‘’…®™©•◦‣·"
CITATION = r"\(\[\[\d+\]\]\s+\S+\)"
TAG = r"</?[a-zA-Z][^>]*>"
RUN_ON = r"\.(?<=[A-Za-z]\.)(?=[A-Z][a-z])"
LEGAL_SUFFIXES = ["inc", "incorporated", "corp", "corporation", "ltd", "limited", "llc", "plc", "co", "company", "group", "holdings", "ag", "sa", "gmbh", "nv", "bv", "pty", "pte"]
SHORT_STOP = ["the", "of", "and", "a", "an", "company", "limited", "incorporated", "corporation", "co", "ltd", "inc", "corp", "group", "holdings", "plc", "llc", "ag", "sa", "gmbh", "nv", "bv", "pty", "pte"]
CHUNK, OVERLAP = 20_000, 2_000


# Words of legal form or trade that a company's name may go on with; cues of negation; separators of quotes in parts.
FORM_WORDS = [
    "corporation", "corp", "incorporated", "inc", "limited", "ltd", "co", "company", "group", "holdings", "llc", "plc", "gmbh", "ag", "sa",
    "bv", "nv", "srl", "oy", "ab", "as", "asa", "kk", "pte", "pvt", "llp", "lp", "lllp", "and", "the",
    "industries", "international", "global", "solutions", "services", "technologies", "technology", "systems", "system", "computer",
    "computers", "semiconductor", "semiconductors", "manufacturing", "precision", "electronics", "electronic", "electric", "electrical",
    "industrial", "industry", "enterprises", "enterprise",
]
SEGMENTS = r"\s+/\s+|\s+[*•·]\s+|\s+-\s+"


@functools.cache
def _compositions() -> str:
    """Base, mark and composed character of every canonical composition of two, bases that are composed themselves later; by commas."""

    def parts(c: str) -> str:
        found = unicodedata.decomposition(c)
        return "" if "<" in found else "".join(chr(int(x, 16)) for x in found.split())

    def depth(c: str) -> int:
        own = parts(c)
        return 1 + depth(own[0]) if len(own) == 2 else 0

    every = [c for c in map(chr, range(0xC0, 0x3000)) if len(parts(c)) == 2 and unicodedata.normalize("NFC", c) == c]
    return ",".join(parts(c) + c for c in sorted(every, key=lambda c: (depth(c), c)))


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of value, which stands in the plan, and is worked out, once however often f uses it."""
    return F.transform(F.array(value), lambda x: f(x)).getItem(0)


def composed(text: Column) -> Column:
    """Marks joined to the characters before them (NFC, but for the order of several marks); only texts that hold marks are worked on."""
    known = "," + _compositions()

    def once(t: Column) -> Column:
        # Only what the text holds is looked up: characters with the mark behind them, each once.
        held = F.array_distinct(F.regexp_extract_all(t, F.lit(r"(?s)\P{M}\p{M}"), F.lit(0)))
        at = lambda pair: F.call_function("locate", F.concat(F.lit(","), pair), F.lit(known))
        return F.aggregate(held, t, lambda acc, pair: let(at(pair), lambda n: F.when(n > 0, F.replace(acc, pair, F.substring(F.lit(known), n + 3, F.lit(1)))).otherwise(acc)))

    # As many rounds as marks that one letter can take in turn.
    return let(text, lambda t: F.when(t.rlike(r"\p{M}"), let(let(once(t), once), once)).otherwise(t))


def char_chunks(text: Column, size: int = CHUNK, overlap: int = OVERLAP) -> Column:
    """array<struct<start, text>>: windows of size characters, each overlapping the last, until one reaches the end."""
    if overlap >= size:
        raise ValueError("overlap must be under size")
    step = size - overlap
    last = F.greatest(F.ceil((F.length(text) - size) / step), F.lit(0)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.struct((i * step).alias("start"), F.substring(text, i * step + 1, F.lit(size)).alias("text")))


def section_chunks(text: Column, size: int = CHUNK, overlap: int = OVERLAP) -> Column:
    """array<string>: sections (before lines of one to three #) packed up to size; larger ones are cut by characters."""
    sections = F.split(text, r"(?m)(?=^#{1,3}\s)")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("held"))

    def add(acc: Column, part: Column) -> Column:
        flushed = F.when(acc["held"] != "", F.concat(acc["done"], F.array(acc["held"]))).otherwise(acc["done"])
        cut = F.transform(char_chunks(part, size, overlap), lambda c: c["text"])
        fits = F.length(acc["held"]) + F.length(part) <= size
        return (
            F.when(F.length(part) > size, F.struct(F.concat(flushed, cut).alias("done"), F.lit("").alias("held")))
            .when(fits, F.struct(acc["done"].alias("done"), F.concat(acc["held"], part).alias("held")))
            .otherwise(F.struct(flushed.alias("done"), part.alias("held")))
        )

    def finish(acc: Column) -> Column:
        done = F.when(acc["held"] != "", F.concat(acc["done"], F.array(acc["held"]))).otherwise(acc["done"])
        return F.when(F.size(done) == 0, F.array(F.lit(""))).otherwise(done)

    return F.aggregate(sections, start, add, finish)


def fold(word: Column) -> Column:
    """Lower case, curly quotes as ASCII ones."""
    return F.translate(F.lower(word), "“”‘’", "\"\"''")


def core(word: Column) -> Column:
    """A folded word without markup and punctuation at its ends, other quotes unified."""
    return F.translate(F.trim(fold(word), F.lit(EDGE)), '"', "'")


def _blank(text: Column, pattern: str) -> Column:
    """Matches of pattern as spaces of equal length."""
    between = F.split(text, pattern, -1)
    blanks = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.repeat(F.lit(" "), F.length(m)))
    return F.array_join(F.zip_with(between, blanks, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def clean(text: Column) -> Column:
    """Citations, tags, table pipes and run-on periods as spaces; the length stays."""
    for pattern, begin in ((CITATION, "([["), (TAG, "<")):
        # A plain search tells most texts apart before the pattern is tried.
        text = let(text, lambda t, p=pattern, b=begin: F.when(t.contains(b) & t.rlike(p), _blank(t, p)).otherwise(t))
    return F.regexp_replace(F.replace(text, F.lit("|"), F.lit(" ")), RUN_ON, " ")


def words(text: Column) -> Column:
    """Cores of the words of a cleaned text; words of punctuation only are dropped."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0)), core), lambda w: w != "")


def spaced_words(text: Column) -> Column:
    """The words() of a cleaned text between single spaces, one more at either end: by patterns over the whole text, not word by word."""
    edge = "[" + re.escape(EDGE) + "]"
    # Beside a space: all the marks there; the looks back keep a long run of marks inside a word from being tried at each of its places.
    ends = rf"{edge}(?:(?<=\s.){edge}*+|(?<!{edge}.){edge}*+(?=\s))"
    bare = F.regexp_replace(F.concat(F.lit(" "), F.lower(text), F.lit(" ")), ends, "")
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.regexp_replace(bare, "[\"“”‘’]", "'"), r"\s+", " ")), F.lit(" "))


def fragments(quote: Column, pattern: str = r"\.\.\.|…") -> Column:
    """array<array<string>>: words of the parts between ellipses."""
    return F.filter(F.transform(F.split(quote, pattern), words), lambda f: F.size(f) > 0)


def struct_fragments(quote: Column) -> Column:
    """As fragments, also between emphasis marks and colons."""
    return fragments(quote, r"\.\.\.|…|[_*]{1,2}|:")


def fact_id(rel: Column, a: Column, b: Column) -> Column:
    """A null part counts as the control character 1, so that it keeps its place."""
    rel, a, b = (F.coalesce(x.cast("string"), F.lit("\1")) for x in (rel, a, b))
    return F.concat(F.lit("f"), F.substring(F.sha2(F.concat_ws("\0", rel, a, b), 256), 1, 12))


def harvest_id(rel: Column, a: Column, b: Column, source: Column) -> Column:
    parts = [F.coalesce(x.cast("string"), F.lit("")) for x in (rel, a, b, source)]
    return F.concat(F.lit("h"), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 12))


def dataset_name(path: Column) -> Column:
    """The file's stem, blanks as underscores, and eight digits of the path's hash."""
    stem = F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")
    return F.concat(F.replace(stem, F.lit(" "), F.lit("_")), F.lit("_"), F.substring(F.sha2(path, 256), 1, 8))


def cache_key(*parts: Column) -> Column:
    """Hash of all that a result depends on; a null part counts as empty."""
    return F.sha2(F.concat_ws("\0", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def display_name(name: Column, key: Column, none: str = "?") -> Column:
    """The name, else the key, else a stand-in; empty counts as missing."""
    return F.coalesce(F.nullif(name, F.lit("")), F.nullif(key.cast("string"), F.lit("")), F.lit(none))


def _parts(quote: Column, pattern: str) -> Column:
    return F.filter(F.transform(F.split(quote, pattern), lambda s: F.trim(s)), lambda s: s != "")


def multi_quotes(quote: Column) -> Column:
    """Segments of a quote in parts: at slashes, bullets and dashes that stand alone."""
    return _parts(quote, SEGMENTS)


def grader_quotes(quote: Column) -> Column:
    """Segments at ' / ' only."""
    return _parts(quote, " / ")


def evidence_quote(evidence: Column) -> Column:
    """The texts of evidence spans as one quote."""
    return F.array_join(F.filter(F.transform(evidence, lambda e: e["text"]), lambda t: t != ""), " / ")


def evidence_level(level: Column, quote: Column) -> Column:
    """strong with under ten characters reads moderate, else moderate without a quote weak: one step only."""
    n = F.length(F.trim(F.coalesce(quote, F.lit(""))))
    return F.when((level == "strong") & (n < 10), "moderate").when((level == "moderate") & (n == 0), "weak").otherwise(level)


def _name_words(name: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(F.replace(name, F.lit("/"), F.lit(""))), r"(?U)[^\w]", " "), " "), lambda w: w != "")


def suspicious_name(term: Column, resolved: Column, words: list[str] = FORM_WORDS) -> Column:
    """Whether a resolved name goes on after the term with words that are no legal form or trade; short all-caps terms never are."""
    a, b = _name_words(term), _name_words(resolved)
    caps = (F.upper(term) == term) & (F.lower(term) != term) & (F.length(term) <= 6)
    extra = F.slice(b, F.size(a) + 1, F.greatest(F.size(b) - F.size(a), F.lit(0)))
    more = (F.size(b) > F.size(a)) & (F.slice(b, F.lit(1), F.size(a)) == a) & F.exists(extra, lambda w: ~w.isin(words))
    return F.coalesce((term != "") & (resolved != "") & ~caps & more, F.lit(False))


def extra_words(term: Column, name: Column, stop: list[str] = SHORT_STOP) -> Column:
    """Whether a name begins with the term and goes on with a word that is no stop word."""
    rest = F.substring(name, F.length(term) + 1, F.length(name))
    own = F.filter(F.split(F.trim(rest, F.lit(" ,.")), r"\s+"), lambda w: w != "")
    return F.startswith(F.lower(name), F.lower(term)) & F.exists(own, lambda w: ~F.lower(F.trim(w, F.lit(".,"))).isin(stop))


def normalize_entity(name: Column) -> Column:
    """Lower case, without legal suffixes."""
    return F.array_join(F.filter(F.split(F.lower(name), r"[\s,.]+"), lambda w: (w != "") & ~w.isin(LEGAL_SUFFIXES)), " ")


def short_form(name: Column) -> Column:
    """First three words that aren't stop words."""
    return F.array_join(F.slice(F.filter(F.split(F.lower(name), r"[\s,.]+"), lambda w: (w != "") & ~w.isin(SHORT_STOP)), 1, 3), " ")


def strip_parenthetical(name: Column) -> Column:
    bare = F.trim(F.regexp_replace(name, r"\s*\([^)]*\)", ""))
    return F.when(bare == "", name).otherwise(bare)


def page_ranges(items: Column) -> Column:
    """Sorted distinct pages of 'a' and 'a-b' items; reversed or malformed ones are skipped."""
    def expand(x: Column) -> Column:
        x = F.trim(x)
        a, b = F.try_element_at(F.split(x, "-"), F.lit(1)).try_cast("int"), F.try_element_at(F.split(x, "-"), F.lit(2)).try_cast("int")
        one, two = x.rlike(r"^\d+$"), x.rlike(r"^\d+\s*-\s*\d+$")
        return F.when(one, F.array(x.try_cast("int"))).when(two & (a <= b), F.sequence(a, b)).otherwise(F.array().cast("array<int>"))

    return F.sort_array(F.array_distinct(F.flatten(F.transform(F.split(items, ","), expand))))


def page_filter(include: Column, exclude: Column, n: Column) -> Column:
    """Pages kept of 1..n; null if that leaves none or nothing is asked."""
    every = F.sequence(F.lit(1), n)
    some = F.when(F.size(include) > 0, F.array_intersect(every, include)).otherwise(every)
    kept = F.array_except(some, exclude)
    return F.when((F.size(kept) > 0) & ((F.size(include) > 0) | (F.size(exclude) > 0)), kept)


def color_rank(color: Column) -> Column:
    """0 green (also null), 1 yellow, 2 red."""
    return F.when(color == "red", 2).when(color == "yellow", 1).otherwise(0)


def rank_color(rank: Column) -> Column:
    return F.element_at(F.array(F.lit("green"), F.lit("yellow"), F.lit("red")), rank + 1)


def color_kept(color: Column, level: str) -> Column:
    """loose keeps all, moderate green and yellow, strict green; an unknown level keeps all; null reads green."""
    most = {"strict": 0, "moderate": 1}.get(level, 2)
    return color_rank(color) <= most


def occurrences(text: Column, word: str) -> Column:
    """Places, from 1, of a word in a text, overlapping ones too: matches of a lookahead split it, so the text is read once."""
    between, begins = F.split(text, f"(?={re.escape(word)})"), F.startswith(text, F.lit(word))
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<int>").alias("found"))

    def add(acc: Column, part: Column) -> Column:
        found = F.when((acc["at"] > 1) | begins, F.array_append(acc["found"], acc["at"])).otherwise(acc["found"])
        return F.struct((acc["at"] + F.length(part)).alias("at"), found.alias("found"))

    # Every part but the first begins with the word.
    return F.aggregate(between, start, add, lambda acc: acc["found"])
