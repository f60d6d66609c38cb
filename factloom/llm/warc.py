"""WARC archives by way of a chunked record table, streamed both ways.

Writing: payloads become rows (record, chunk number, bytes) in the plan, so that Python
never holds more of a payload than a chunk, and each row becomes one WARC record: the
first chunk a response, the others continuation records with their segment number. The
SHA-1 of the payload is carried from row to row. Payloads seen before become revisit
records, which hold no payload and refer to the response's record. Record ids follow
from page and payload, so a rerun gives the same records.

Each record is a gzip member of its own. Spark's text writer puts them into files, so
they are committed as any output is: a member of under 16 MB ends in a zero byte, which
is left to the writer as its line separator. The files are then named ``.warc.gz``.

Reading: archives are unpacked as a stream of lines by Spark's text reader, one task a
file, and put together again to rows (record, chunk number, bytes); digests are folded
over these, and a revisit gets length and digest of the response that it refers to.

Defined results: a null payload is empty; of rows with the largest page_id of a
payload all are responses; a null page_id is never referred to (if all rows of a
payload have none, all are responses); a null url is written as none; line ends in a
url are dropped; an empty table gives no archive records and an empty result.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import cut, scratch

#: Payloads under this many bytes are always written.
REVISIT_BYTES = 1000
#: Bytes of payload in a chunk.
SEGMENT = 64 * 1024
#: Rows of the tables of repeated payloads and of records referred to that may be broadcast (under 10 MB).
BROADCAST_ROWS = 100_000
DATE = "2024-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNK = "record_id string, chunk int, kind string, page_id long, told string, refers_to string, bytes binary"


def record_id(page_id: Column, digest: Column) -> Column:
    """A uuid that follows from page and payload."""
    h = F.md5(F.concat_ws(":", F.coalesce(page_id.cast("string"), F.lit("none")), F.hex(digest)))
    return F.concat_ws("-", *[F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def chunk_rows(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", segment: int = SEGMENT) -> DataFrame:
    """(record_id, chunk, chunks, page_id, url, size, refers_to, refers_id, bytes), the chunks of a record one after another; a revisit has one, without bytes."""
    rows = pages.select(
        F.col(f"`{id_col}`").cast("long").alias("page_id"),
        F.translate(F.col(f"`{url_col}`").cast("string"), "\r\n", "").alias("url"),
        F.encode(F.coalesce(F.col(f"`{html_col}`"), F.lit("")), "UTF-8").alias("payload"),
    )
    rows = rows.withColumn("digest", F.unhex(F.sha1("payload"))).withColumn("size", F.octet_length("payload").cast("long"))
    seen = rows.where(F.col("size") >= REVISIT_BYTES).groupBy("digest")
    repeated = cut(seen.agg(F.max("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    # Without the payloads' exchange while the repeated ones are few; else Spark sorts, and splits large groups.
    few = repeated.count() <= BROADCAST_ROWS
    joined = rows.join(F.broadcast(repeated) if few else repeated.hint("merge"), "digest", "left")
    refers = F.when((F.col("size") >= REVISIT_BYTES) & ~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id"))
    joined = joined.withColumn("refers_to", refers)
    chunks = F.when(F.col("refers_to").isNotNull(), 1).otherwise(F.greatest(F.ceil(F.col("size") / segment), F.lit(1))).cast("int")
    told = F.when(F.col("refers_to").isNotNull(), F.lower(F.hex("digest")))
    dealt = joined.select(
        record_id(F.col("page_id"), F.col("digest")).alias("record_id"), "page_id", "url", "size", "refers_to",
        F.when(F.col("refers_to").isNotNull(), record_id(F.col("refers_to"), F.col("digest"))).alias("refers_id"), told.alias("told"), chunks.alias("chunks"), "payload",
    )
    dealt = dealt.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    part = F.when(F.col("refers_to").isNull(), F.substring("payload", F.col("chunk") * segment + 1, F.lit(segment)))
    return dealt.select("record_id", "chunk", "chunks", "page_id", "url", "size", "refers_to", "refers_id", "told", part.alias("bytes"))


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "\r\n".join(["WARC/1.1", *(f"{k}: {v}" for k, v in fields if v is not None), f"Content-Length: {len(block)}"])
    return head.encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def records(rows: Iterator[dict]) -> Iterator[bytes]:
    """A WARC record for each of chunk_rows()' rows."""
    whole, sent = hashlib.sha1(), 0
    for r in rows:
        urn = lambda n, own=r["record_id"]: f"<urn:uuid:{own[:-4]}{(int(own[-4:], 16) + n) % 65536:04x}>"
        own, origin, number = urn(r["chunk"]), urn(0), r["chunk"] + 1
        common = [("WARC-Date", DATE), ("WARC-Target-URI", r["url"]), ("X-Page-ID", r["page_id"])]
        if r["refers_to"] is not None:
            revisit = [("WARC-Profile", PROFILE), ("WARC-Payload-Digest", f"sha1:{r['told']}"), ("WARC-Refers-To", f"<urn:uuid:{r['refers_id']}>")]
            yield _record([("WARC-Type", "revisit"), ("WARC-Record-ID", own), *common, *revisit], HTTP)
            continue
        if number == 1:
            whole, sent = hashlib.sha1(), 0
        part = r["bytes"]
        whole.update(part)
        sent += len(part)
        last = number == r["chunks"]
        fields: list[tuple[str, object]] = [("WARC-Type", "response" if number == 1 else "continuation"), ("WARC-Record-ID", own), *common]
        if r["chunks"] > 1:
            fields += [("WARC-Segment-Number", number)]
        if number > 1:
            fields += [("WARC-Segment-Origin-ID", origin)]
        if number > 1 and last:
            fields += [("WARC-Segment-Total-Length", sent + len(HTTP))]
        if last:
            fields += [("WARC-Payload-Digest", f"sha1:{whole.hexdigest()}")]
        yield _record(fields, (HTTP if number == 1 else b"") + part)


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", segment: int = SEGMENT) -> None:
    """Write one or more WARC records per row of pages below path, as .warc.gz files."""
    if segment > 8 << 20:
        raise ValueError("a record must stay under 16 MB")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # One row at a time, over all batches: a record's chunks may be in several.
        rows = ({c: batch.column(c)[i].as_py() for c in batch.schema.names} for batch in batches for i in range(batch.num_rows))
        out: list[bytes] = []
        held = 0
        for record in records(rows):
            out.append(gzip.compress(record, 6, mtime=0)[:-1])
            held += len(out[-1])
            if held > 4_000_000:
                yield pa.record_batch([pa.array(out, pa.binary())], ["value"])
                out, held = [], 0
        yield pa.record_batch([pa.array(out, pa.binary())], ["value"])

    members = chunk_rows(pages, id_col, url_col, html_col, segment).mapInArrow(run, "value binary")
    members.select(F.col("value").cast("string")).write.option("lineSep", "\0").text(path)
    spark = pages.sparkSession
    jvm = spark._jvm.org.apache.hadoop.fs
    files = jvm.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for found in files.listStatus(jvm.Path(path)):
        name = found.getPath().getName()
        if name.endswith(".txt"):
            files.rename(found.getPath(), jvm.Path(path, name.removesuffix(".txt") + ".warc.gz"))


def parse(lines: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record, from lines between CR LF."""
    for line in lines:
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        fields: dict[str, str] = {}
        for line in lines:
            if not line:
                break
            name, _, value = line.decode().partition(":")
            fields[name.lower()] = value.strip()
        left, block, blank = int(fields["content-length"]), [], 2
        while left:
            line = next(lines, None)
            if line is None or left < len(line) or left == len(line) + 1:
                raise ValueError("a WARC record is cut short")
            if left == len(line):
                block.append(line)
                left, blank = 0, 1
            else:
                block += [line, b"\r\n"]
                left -= len(line) + 2
        if any(next(lines, None) != b"" for _ in range(blank)):
            raise ValueError("a WARC record is cut short")
        yield fields, b"".join(block)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The chunk table of the archives below path, a record's chunks one after another."""
    lines = spark.read.option("lineSep", "\r\n").option("pathGlobFilter", "*.gz").text(path).select(F.col("value").cast("binary").alias("value"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]
        names = ["record_id", "chunk", "kind", "page_id", "told", "refers_to", "bytes"]
        rows: list[tuple] = []
        held = 0

        def out() -> pa.RecordBatch:
            done = pa.record_batch([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
            rows.clear()
            return done

        for fields, block in parse(x.as_py() for batch in batches for x in batch.column(0)):
            kind, page = fields["warc-type"], fields.get("x-page-id")
            body = block if kind == "continuation" else block.partition(b"\r\n\r\n")[2]
            own, number = fields.get("warc-segment-origin-id", fields["warc-record-id"]), int(fields.get("warc-segment-number", 1)) - 1
            rows.append((own, number, kind, None if page is None else int(page), fields.get("warc-payload-digest"), fields.get("warc-refers-to"), body))
            held += len(body)
            if held > 4_000_000 or len(rows) >= 4096:
                yield out()
                held = 0
        if rows:
            yield out()

    return lines.mapInArrow(run, CHUNK)


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per record: digests are carried over its chunks and checked."""
    types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    whole, size, before = None, 0, (None, -1)
    for batch in batches:
        done: list[tuple] = []
        for r in (dict(zip(batch.schema.names, x, strict=True)) for x in zip(*(c.to_pylist() for c in batch.columns), strict=True)):
            if r["kind"] == "revisit":
                done.append((r["record_id"], "revisit", r["page_id"], None, r["told"], r["refers_to"]))
                continue
            if r["kind"] == "response":
                whole, size = hashlib.sha1(), 0
            elif before != (r["record_id"], r["chunk"] - 1):
                raise ValueError("a continuation doesn't follow its record")
            before = (r["record_id"], r["chunk"])
            whole.update(r["bytes"])
            size += len(r["bytes"])
            if r["told"] is not None:  # the last chunk has the digest
                if r["told"] != f"sha1:{whole.hexdigest()}":
                    raise ValueError("a payload doesn't have its digest")
                done.append((r["record_id"], "response", r["page_id"], size, r["told"], None))
        if done:
            yield pa.record_batch([pa.array(list(c), t) for c, t in zip(zip(*done, strict=True), types, strict=True)], ["record_id", "kind", "page_id", "size", "told", "refers_to"])


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per page of the archives below path; digests are of the bytes read, and checked against the headers."""
    found = cut(read_chunks(spark, path).mapInArrow(_fold, "record_id string, kind string, page_id long, size long, told string, refers_to string"))
    revisits = found.where("kind = 'revisit'")
    wanted = revisits.select(F.col("refers_to").alias("record_id")).distinct()
    origin = found.where("kind = 'response'").join(wanted, "record_id", "left_semi").dropDuplicates(["record_id"])
    origin = cut(origin.select(F.col("record_id").alias("refers_to"), F.col("page_id").alias("first_id"), F.col("size").alias("payload_bytes"), F.col("told").alias("first_told")))
    few = origin.count() <= BROADCAST_ROWS
    lost = F.col("first_told").isNull() | (F.col("first_told") != F.col("told"))
    told = F.when(lost, F.raise_error(F.lit("a revisit's response isn't there"))).otherwise(F.col("told"))
    again = revisits.drop("size").join(F.broadcast(origin) if few else origin.hint("merge"), "refers_to", "left")
    own = found.where("kind = 'response'").select("page_id", F.col("size").alias("payload_bytes"), "told", "kind", F.lit(None).cast("long").alias("refers_to"))
    every = own.unionByName(again.select("page_id", "payload_bytes", told.alias("told"), "kind", F.col("first_id").alias("refers_to")))
    return every.select("page_id", "payload_bytes", F.substring("told", 6, 40).alias("payload_digest"), F.col("kind").alias("record_type"), "refers_to")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_warc(spark, path)


OP9_SQL = """
SELECT page_id, payload_bytes, payload_digest, CASE WHEN refers IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers AS refers_to
FROM (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest,
         CASE WHEN octet_length(encode(coalesce(html, ''))) >= 1000 AND max(page_id) OVER w IS DISTINCT FROM page_id
              THEN max(page_id) OVER w END AS refers
  FROM pages WINDOW w AS (PARTITION BY coalesce(html, '')))
"""
