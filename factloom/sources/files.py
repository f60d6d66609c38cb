"""File sources and sinks; all paths go through Spark's readers and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Longer texts are left out of the raw sink.
TEXT_MOST = 500_000
RAW = "_id string, rel_type string, from_label string, to_label string, from_pk string, to_pk string, from_term string, to_term string, supporting_quote string, extraction_source string, rel_props map<string,string>"
EVENTS = "raw_hash string, saved_at string, events map<string, struct<action:string, note:string, fields:map<string,string>>>"


def _stem(path: str = "_metadata.file_path"):
    """The file's name without folder and last suffix."""
    return F.regexp_replace(F.url_decode(F.regexp_extract(F.col(path), r"([^/]*)$", 1)), r"\.[^.]*$", "")


def markdown(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_name, text, modified) of the folder's Markdown files, one row each."""
    files = spark.read.text(folder, wholetext=True, pathGlobFilter="*.md")
    return files.select(_stem().alias("doc_name"), F.col("value").alias("text"), F.col("_metadata.file_modification_time").alias("modified"))


def binaries(spark: SparkSession, folder: str, suffix: str = "pdf") -> DataFrame:
    """(doc_name, path, modified) of files to convert; their content is read only where it is asked for."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{suffix}").load(folder)
    return files.select(_stem("path").alias("doc_name"), "path", F.col("modificationTime").alias("modified"), "content")


def stale(inputs: DataFrame, targets: DataFrame, force: bool = False) -> DataFrame:
    """Inputs without a target that is at least as new; all of them if forced. Both: doc_name, modified."""
    if force:
        return inputs
    done = targets.select("doc_name", F.col("modified").alias("made"))
    return inputs.join(done, (inputs["doc_name"] == done["doc_name"]) & (F.col("made") >= F.col("modified")), "left_anti")


def convert(inputs: DataFrame, converter, pages: list[int] | None = None) -> DataFrame:
    """(doc_name, text) by converter(bytes, pages), a function that works on the executors, a file at a time."""

    def run(batches):
        for batch in batches:
            yield batch.assign(text=[converter(bytes(b), pages) for b in batch["content"]])[["doc_name", "text"]]

    return inputs.select("doc_name", "content").mapInPandas(run, "doc_name string, text string")


def raw_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Facts of every *_raw.json, with doc_name; of *_review.json where the folder has no raw file."""
    for suffix in ("_raw", "_review"):
        files = spark.read.json(folder, schema=f"document string, triples array<struct<{_fields(RAW)}>>", multiLine=True, pathGlobFilter=f"*{suffix}.json")
        if suffix == "_review" or not files.isEmpty():
            break
    return files.select(F.regexp_replace(_stem(), f"{suffix}$", "").alias("doc_name"), F.inline("triples"))


def _fields(schema: str) -> str:
    return ", ".join(":".join(part.split(" ", 1)) for part in schema.split(", "))


def review_events(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_name, raw_hash, saved_at, fact_id, event); a file that can't be parsed has none."""
    files = spark.read.json(folder, schema=EVENTS, multiLine=True, mode="PERMISSIVE", pathGlobFilter="*_review.json")
    return files.select(F.regexp_replace(_stem(), "_review$", "").alias("doc_name"), "raw_hash", "saved_at", F.explode("events").alias("fact_id", "event"))


def with_review_stamp(events: DataFrame, raw: DataFrame) -> DataFrame:
    """events (doc_name, …) with the SHA-256 of the raw bytes (raw: doc_name, content) and the time of saving."""
    hashes = raw.select("doc_name", F.sha2("content", 256).alias("raw_hash"))
    return events.join(hashes, "doc_name", "left").withColumn("saved_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX"))


def raw_sink(facts: DataFrame, path: str, text_col: str | None = None, most: int = TEXT_MOST) -> None:
    """Facts as JSON lines, a folder for each run_id if there is one; texts over most characters are left out."""
    if text_col:
        facts = facts.withColumn(text_col, F.when(F.length(text_col) <= most, F.col(text_col)))
    writer = facts.write.mode("append")
    (writer.partitionBy("run_id") if "run_id" in facts.columns else writer).json(path)


def examples_sink(entries: DataFrame, path: str) -> None:
    """One folder of JSON lines for each rel_type; all earlier ones go."""
    entries.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("rel_type").json(path)


def examples(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def gold(spark: SparkSession, path: str) -> DataFrame:
    """(rel_type, from_display, to_display, doc_name or null) of a tab-separated gold file; rows without a key column's value are skipped."""
    rows = spark.read.csv(path, sep="\t", header=True, inferSchema=False)
    clean = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) if c in rows.columns else F.lit("")
    found = rows.select(clean("rel_type").alias("rel_type"), F.lower(clean("from_display")).alias("from_display"), F.lower(clean("to_display")).alias("to_display"), F.nullif(clean("doc_name"), F.lit("")).alias("doc_name"))
    return found.where("rel_type <> '' AND from_display <> '' AND to_display <> ''").distinct()


def sem_groups(spark: SparkSession, path: str) -> DataFrame:
    """(abbr, name, tui, type_name) of a pipe-separated file; lines of fewer than four fields are skipped."""
    part = F.split(F.trim("value"), r"\|")
    names = ("abbr", "name", "tui", "type_name")
    return spark.read.text(path).where(F.size(part) >= 4).select(*[part[i].alias(n) for i, n in enumerate(names)])


def group_types(groups: DataFrame, group: str) -> DataFrame:
    """(tui, type_name) of a group by its name, or if no group has that name by its abbreviation, in capitals."""
    named = groups.where(F.col("name") == group).select("tui", "type_name").distinct()
    short = groups.where(F.col("abbr") == group.upper()).select("tui", "type_name").distinct()
    return named.unionByName(short.join(named.limit(1).select(F.lit(1).alias("any")), F.lit(True), "left_anti"))  # against one row or none


def type_codes(types: list[str], groups: DataFrame, group: str = "") -> DataFrame:
    """(tui, type_name) to filter by: explicit names or codes win over the group; a name without a code keeps a null code."""
    if not types:
        return group_types(groups, group)
    asked = groups.sparkSession.createDataFrame([(t, bool(len(t) > 1 and t[0] == "T" and t[1:].isdigit())) for t in types], "t string, is_code boolean")
    known = groups.select("tui", "type_name").distinct()
    coded = asked.where("is_code").join(known, F.col("t") == F.col("tui"), "left").select(F.col("t").alias("tui"), "type_name")
    return coded.unionByName(asked.where("NOT is_code").join(known, F.col("t") == F.col("type_name"), "left").select("tui", F.col("t").alias("type_name")))


def log_sink(rows: DataFrame, path: str, columns: list[str]) -> None:
    """The listed columns as JSON lines, appended; nulls are left out."""
    rows.select(*[c for c in columns if c in rows.columns]).write.mode("append").json(path)


def error_sink(failed: DataFrame, path: str) -> None:
    """Entities that couldn't be resolved (entity, label, error) as JSON lines with the time, appended."""
    failed.select("entity", "label", "error", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("ts")).write.mode("append").json(path)
