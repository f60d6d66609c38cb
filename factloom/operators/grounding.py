"""Grounding: locating quotes in documents with exact character offsets.

Quotes find candidate documents by their fragments' longest word (an equi-join on document
words, kept once per document; few quotes are broadcast, so that documents stay where they are).
Each candidate pair is then matched fragment by fragment, earliest first, without backtracking.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import text as tx


def joined(text: Column) -> Column:
    """A text's words between single spaces, one more at either end: phrases of words are found in it as strings."""
    return tx.composed(tx.spaced_words(tx.clean(text)))


def _phrases(parts: Column) -> Column:
    """Fragments as they stand in joined()."""
    return F.transform(parts, lambda part: F.concat(F.lit(" "), F.array_join(part, " "), F.lit(" ")))


def _way(line: Column, phrases: Column) -> Column:
    """struct<first, last>: where in joined() the phrases begin and end, matched in order, each at its earliest place."""
    zero = F.struct(F.lit(1).alias("cursor"), F.lit(0).alias("first"), F.lit(0).alias("last"), F.lit(True).alias("ok"))

    def step(acc: Column, phrase: Column) -> Column:
        # Searched once a phrase, and not after one that isn't there.
        at = F.when(acc["ok"], F.call_function("locate", phrase, line, acc["cursor"])).otherwise(0)
        return tx.let(at, lambda own: stepped(acc, own, (own + F.length(phrase) - 1).cast("int")))

    def stepped(acc: Column, at: Column, end: Column) -> Column:
        ok = at > 0
        return F.struct(F.when(ok, end).otherwise(acc["cursor"]).alias("cursor"), F.when(acc["first"] == 0, at).otherwise(acc["first"]).alias("first"), end.alias("last"), ok.alias("ok"))

    done = tx.let(F.aggregate(phrases, zero, step), lambda own: F.when(own["ok"], F.struct(own["first"].alias("first"), own["last"].alias("last"))))
    return F.when(F.size(phrases) > 0, done)


def asked(quote: Column) -> Column:
    """struct<plain, finer>: a quote's phrases; finer, between emphasis marks and colons too, only if those are more."""

    def both(plain: Column, finer: Column) -> Column:
        return F.struct(_phrases(plain).alias("plain"), F.when(F.size(finer) > F.size(plain), _phrases(finer)).alias("finer"))

    return tx.let(tx.composed(tx.clean(quote)), lambda cleaned: tx.let(tx.fragments(cleaned), lambda plain: tx.let(tx.struct_fragments(cleaned), lambda finer: both(plain, finer))))


def asked_way(sought: Column, line: Column) -> Column:
    """The way of asked() phrases through joined(): the plain ones', else the finer ones'."""
    return F.coalesce(_way(line, sought["plain"]), F.when(sought["finer"].isNotNull(), _way(line, sought["finer"])))


def way(quote: Column, line: Column) -> Column:
    """The fragments' way through joined(); between emphasis marks and colons too if that gives more fragments."""
    return tx.let(asked(quote), lambda sought: tx.let(line, lambda own: asked_way(sought, own)))


def span_of(text: Column, line: Column, found: Column) -> Column:
    """struct<start, end> in the text, from 0, end exclusive, of a way through joined()."""
    nth = lambda upto: F.regexp_count(F.substring(line, F.lit(1), upto), F.lit(" ")).cast("int")
    edge = lambda r: F.ltrim(F.regexp_replace(r, r"^\s+", ""), F.lit(tx.EDGE))

    def between(runs: Column, a: Column, b: Column) -> Column:
        total = lambda upto: F.length(F.array_join(F.slice(runs, 1, upto), ""))
        start = total(a) - F.length(edge(F.element_at(runs, a)))
        last = F.element_at(runs, b)
        end = total(b) - (F.length(last) - F.length(F.rtrim(last, F.lit(tx.EDGE))))
        return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"))

    def placed(runs: Column) -> Column:
        # Numbers of the runs that hold a word: more than marks.
        real = F.array_compact(F.transform(runs, lambda r, i: F.when(r.rlike(rf"[^\s{re.escape(tx.EDGE)}]"), i + 1)))
        return tx.let(real, lambda own: tx.let(F.element_at(own, nth(found["first"])), lambda a: tx.let(F.element_at(own, (nth(found["last"]) - 1).cast("int")), lambda b: between(runs, a, b))))

    return tx.let(F.regexp_extract_all(tx.clean(text), F.lit(r"\s*\S+"), F.lit(0)), placed)


def locate(quote: Column, text: Column) -> Column:
    """struct<start, end> of a quote in a text; null if it isn't there or is blank."""
    own = lambda line: tx.let(way(quote, line), lambda found: F.when(found.isNotNull(), span_of(text, line, found)))
    return tx.let(joined(text), own)


def reanchor(text: Column, span: Column) -> Column:
    """The text's own words at a span."""
    return tx.let(span, lambda s: F.substring(text, s["start"] + 1, s["end"] - s["start"]))


def _longest(parts: Column) -> Column:
    return F.array_max(F.transform(F.flatten(parts), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]


def _anchors(quotes: DataFrame) -> DataFrame:
    """quotes: quote_id, quote. (quote_id, sought, word, other): the longest word of the quote's fragments, of either split; other is the first split's word beside the second's."""
    cleaned = tx.composed(tx.clean(F.col("quote")))
    longest = quotes.select("quote_id", asked(F.col("quote")).alias("sought"), _longest(tx.fragments(cleaned)).alias("a"), _longest(tx.struct_fragments(cleaned)).alias("b"))
    none = F.lit(None).cast("string")
    either = F.array(F.struct(F.col("a").alias("word"), none.alias("other")), F.when(~F.col("a").eqNullSafe(F.col("b")), F.struct(F.col("b").alias("word"), F.col("a").alias("other"))))
    return longest.select("quote_id", "sought", F.explode(either).alias("x")).where("x.word IS NOT NULL").select("quote_id", "sought", "x.word", "x.other")


def located(quotes: DataFrame, docs: DataFrame, few: int = 10_000, most: int = 16_000_000) -> DataFrame:
    """quote_id, doc_id, text, start, end, evidence of every quote located in any document. quotes: quote_id, quote; docs: doc_id, text.

    Up to few words sought, of quotes of up to most characters, go to where the documents are: each is read and its words are joined once, and none is shuffled.
    """
    anchors = _anchors(quotes)
    lines = docs.select("doc_id", "text", joined(F.col("text")).alias("line"))
    # Outer, as for an inner explode the optimiser tests the array's size first, which would work out the words twice.
    words = F.explode_outer(F.array_distinct(F.split(F.trim("line"), " "))).alias("word")
    n = anchors.select("word").limit(few + 1).count()
    if n <= few and (quotes.agg(F.sum(F.length("quote"))).first()[0] or 0) <= most:
        pairs = lines.select("doc_id", "text", "line", words).join(F.broadcast(anchors), "word")
        # By the second split's word only where the first's is missing, so that a pair comes once.
        pairs = pairs.where(F.col("other").isNull() | ~F.contains("line", F.concat(F.lit(" "), "other", F.lit(" "))))
    else:
        found = lines.select("doc_id", words).join(anchors.select("quote_id", "word"), "word").select("quote_id", "doc_id").distinct()
        pairs = found.join(lines, "doc_id").join(quotes.select("quote_id", asked(F.col("quote")).alias("sought")), "quote_id")
    # Exploded, so that the test isn't drawn into the join, which would be worked row by row then.
    ways = pairs.select("quote_id", "doc_id", "text", "line", F.explode_outer(F.array(asked_way(F.col("sought"), F.col("line")))).alias("way")).where("way IS NOT NULL")
    found = ways.withColumn("span", span_of(F.col("text"), F.col("line"), F.col("way")))
    return found.select("quote_id", "doc_id", "text", F.col("span.start").alias("start"), F.col("span.end").alias("end"), reanchor(F.col("text"), F.col("span")).alias("evidence"))


def ground(quotes: DataFrame, docs: DataFrame) -> DataFrame:
    """quote_id, doc_id, start, end, evidence of every quote located in any document."""
    return located(quotes, docs).drop("text")


def context(text: Column, start: Column, end: Column, width: int) -> Column:
    """Up to width characters around a span, not over a blank line on either side."""
    before = F.substring(text, F.greatest(start - width, F.lit(0)) + 1, F.least(start, F.lit(width)))
    after = F.substring(text, end + 1, F.lit(width))
    return F.concat(F.substring_index(before, "\n\n", -1), F.substring(text, start + 1, end - start), F.substring_index(after, "\n\n", 1))


def entity_in_text(entity: Column, text: Column) -> Column:
    """Whole, without its legal suffix (three characters at least), or any word of two characters at least, by itself; words end at blanks, commas, periods and hyphens."""

    def found(name: Column, text: Column, low: Column) -> Column:
        body = tx.normalize_entity(name)
        parts = F.filter(F.split(name, r"[\s,.\-]+"), lambda w: F.length(w) >= 2)
        # Most words aren't in the text at all, which a plain search tells sooner than a pattern.
        bounded = F.exists(parts, lambda w: low.contains(F.lower(w)) & F.regexp_like(text, F.concat(F.lit(r"(?iuU)\b\Q"), w, F.lit(r"\E\b"))))
        return (name != "") & (low.contains(F.lower(name)) | ((F.length(body) >= 3) & low.contains(body)) | bounded)

    own = lambda name, t: tx.let(F.lower(t), lambda low: found(name, t, low))
    return F.coalesce(tx.let(F.trim(tx.composed(entity)), lambda name: tx.let(tx.composed(text), lambda t: own(name, t))), F.lit(False))


def entity_class(entity: Column, text: Column, quote: Column) -> Column:
    """green in text and quote, yellow in the text only, red in neither."""
    inside = entity_in_text(entity, text)
    return F.when(inside & entity_in_text(entity, F.coalesce(quote, F.lit(""))), "green").when(inside, "yellow").otherwise("red")


def verify(located: Column, quote: Column, level: str) -> Column:
    """Whether an item stays: loose keeps; a blank quote goes only in strict; one not located goes in strict."""
    blank = F.trim(F.coalesce(quote, F.lit(""))) == ""
    return F.lit(True) if level != "strict" else ~blank & located


def rescue_line(text: Column, target: Column) -> Column:
    """The stripped line of the first occurrence of target; null without one."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.lower(x).contains(F.lower(target)))
    return F.trim(F.try_element_at(lines, F.lit(1)))
