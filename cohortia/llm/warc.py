"""WARC archives: write, read back, and tell records from bytes that look like them.

Archives are plain WARC 1.1 written by Spark's text sink, whose line separator is the four
bytes that end a record; an archive has at most ``per_file`` records and about ``per_bytes``
bytes, or one record. Only pages whose payload stands elsewhere, too, are shuffled to learn
their record type. Reading, a task scans an archive for every ``WARC/1.`` at the start of a line and emits each as a candidate with the
offset where its record would end. Which candidates are records is a matter of the chain from
the file's start: pointer jumping (each round doubles the distance) keeps what the chain
reaches, so a record header inside a payload is rejected. An archive whose chain doesn't
reach its end is an error.

Cases: a null html is an empty payload; a null url is left out of the header, line ends in it
are escaped; a null page_id is larger than any other, and comes back null; rows that repeat a
page_id and payload are of one type; of equal payloads the smallest page_id is the response;
very long payloads get archives of their own; an empty table gives no rows; further columns
aren't read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bloom import parted
from .common import forget, fresh_path, table, written

CRLF = "\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MAGIC = re.compile(rb"(?:\A|(?<=\n))WARC/1\.[01]\r\n")


def base32(sha1: Column) -> Column:
    """Upper-case base32 of a hexadecimal SHA-1: 160 bits are four times eight letters, no padding."""
    parts = [F.lpad(F.conv(F.substring(sha1, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def classify(pages: DataFrame, least: int = 0, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page_id, digest, refers_to: of equal payloads of at least ``least`` bytes, all but the
    smallest page_id refer to it. Only digests are shuffled, pre-aggregated by task."""
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("page_id"), F.sha1(payload).alias("digest"), F.octet_length(payload).alias("n")).where(F.col("n") >= least)
    groups = rows.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("m")).where("m > 1 and first is not null")
    return (
        rows.join(groups, "digest")
        .where(~F.col("page_id").eqNullSafe(F.col("first")))
        .select("page_id", "digest", F.col("first").alias("refers_to"))
        .distinct()
    )


def write_archives(
    pages: DataFrame,
    path: str,
    least: int = 0,
    per_file: int = 1000,
    date: str = "2020-01-01T00:00:00Z",
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    per_bytes: int = 64 << 20,
) -> None:
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(
        F.col(id_col).alias("page_id"),
        F.regexp_replace(F.regexp_replace(F.col(url_col), "\r", "%0D"), "\n", "%0A").alias("url"),
        html.alias("html"),
        F.sha1(html.cast("binary")).alias("digest"),
    )
    again = written(classify(pages, least, id_col, html_col).withColumnsRenamed({"page_id": "again_id", "digest": "again_digest"}), "revisits")
    # payloads that stand nowhere else are written from where they are read
    maybe, alone = parted(rows, F.col("digest"), again, "again_digest", again.count())
    same = F.col("page_id").eqNullSafe(F.col("again_id")) & (F.col("digest") == F.col("again_digest"))
    alone = alone.withColumn("refers_to", F.lit(None).cast(pages.schema[id_col].dataType))
    rows = maybe.join(again, same, "left").select(*alone.columns).unionByName(alone)
    revisit = F.col("refers_to").isNotNull()
    name = lambda c: F.concat(F.lit("<urn:x-page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    line = lambda key, value: F.concat(F.lit(f"{key}: "), value, F.lit(CRLF))
    block = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
        F.octet_length("html").cast("string"),
        F.lit(CRLF + CRLF),
        F.when(revisit, F.lit("")).otherwise(F.col("html")),
    )
    record = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", name(F.col("page_id"))),
        F.coalesce(line("WARC-Target-URI", F.col("url")), F.lit("")),
        line("WARC-Date", F.lit(date)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("digest")))),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", name(F.col("refers_to"))))).otherwise(F.lit("")),
        F.lit(f"Content-Type: application/http;msgtype=response{CRLF}"),
        line("Content-Length", F.octet_length("block").cast("string")),
        F.lit(CRLF),
        F.col("block"),
    )
    # the sink bounds an archive by records only: each size of payloads gets its own bound
    size_of = lambda c: F.greatest(F.ceil(F.log2((F.octet_length(c) + 1) * per_file / per_bytes)), F.lit(0)).cast("int")
    sizes = sorted(r["size"] for r in pages.select(size_of(html).alias("size")).distinct().collect()) or [0]  # 31 at most
    for k in sizes:
        some = rows.where(size_of(F.col("html")) == k) if len(sizes) > 1 else rows
        # the sink ends each row with the separator: exactly what ends a record
        out = some.withColumn("block", block).select(record.alias("value")).write.mode("append").option("lineSep", CRLF + CRLF)
        out.option("maxRecordsPerFile", max(1, per_file >> k)).text(path)
    forget(pages.sparkSession, again)


def _fields(head: bytes) -> dict[str, str]:
    out = {}
    for line in head.split(b"\r\n")[1:]:
        key, colon, value = line.partition(b":")
        if not colon:
            return {}
        out[key.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    return out


def _candidate(data: bytes, at: int) -> tuple | None:
    """(successor, type, id, refers, payload bytes, payload digest), or None if no record can start here."""
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        return None
    f = _fields(data[at:end])
    size = f.get("content-length", "")
    if not size.isdecimal():
        return None
    body = end + 4
    stop = body + int(size)
    after = stop + 4
    if after > len(data) or data[stop:after] != b"\r\n\r\n" or after < len(data) and not _MAGIC.match(data, after):
        return None
    split = data.find(b"\r\n\r\n", body, stop)
    http = _fields(data[body:split]) if split >= 0 else {}
    if f.get("warc-type") == "revisit":
        length = http.get("content-length", "")
        n = int(length) if length.isdecimal() else None
        digest = f.get("warc-payload-digest", "").removeprefix("sha1:") or None
    else:
        payload = data[split + 4 : stop] if split >= 0 else data[body:stop]
        n, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
    return after, f.get("warc-type"), f.get("warc-record-id"), f.get("warc-refers-to"), n, digest


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """path, size, off, succ and what the record says, for every candidate of every archive."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, data in zip(batch["path"], batch["content"]):
                found = [(m.start(), c) for m in _MAGIC.finditer(data) if (c := _candidate(data, m.start()))]
                # a sentinel stands for the archive itself, so that one without any chain is seen
                rows = [(path, len(data), -1, 0, None, None, None, None, None)] + [(path, len(data), off, *c) for off, c in found]
                yield pd.DataFrame(rows, columns=["path", "size", "off", "succ", "type", "id", "refers", "n", "digest"]).astype({"n": "Int64"})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, size bigint, off bigint, succ bigint, type string, id string, refers string, n bigint, digest string")


def reachable(steps: DataFrame, rounds: int = 48) -> DataFrame:
    """(path, off) of what the chain from offset 0 reaches, by pointer jumping over (path, off, succ)."""
    first = jump = written(steps.select("path", "off", "succ"), "jump")
    starts = jump.select("path", F.col("off").alias("succ"))
    reached = written(jump.where("off = 0").select("path", "off"), "reached")
    for _ in range(rounds):
        ahead = reached.join(jump, ["path", "off"]).join(starts, ["path", "succ"], "left_semi")
        grown = written(reached.union(ahead.select("path", F.col("succ").alias("off"))).distinct(), "reached")
        far = jump.select("path", F.col("off").alias("succ"), F.col("succ").alias("far"))
        jumped = written(jump.join(far, ["path", "succ"]).select("path", "off", F.col("far").alias("succ")), "jump")
        forget(steps.sparkSession, reached, *([jump] if jump is not first else []))
        reached, jump = grown, jumped
        if jump.isEmpty():
            forget(steps.sparkSession, first, jump)
            return reached
    raise RuntimeError("an archive has more records than rounds can reach")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archives: page_id (text), payload_bytes, payload_digest, record_type, refers_to (text)."""
    found = written(candidates(spark, path), "candidates")
    reached = reachable(found.where("off >= 0"))
    records = written(found.where("off >= 0").join(reached, ["path", "off"], "left_semi"), "records")
    ends = records.groupBy("path").agg(F.max("succ").alias("end"))
    broken = found.where("off < 0").join(ends, "path", "left").where("size > 0 and not (size <=> end)")
    if first := broken.select("path").first():
        raise ValueError(f"the chain of records breaks off in {first['path']}")
    forget(spark, found, reached)
    page = lambda c: F.regexp_extract(c, "^<urn:x-page:(.*)>$", 1)
    return records.select(
        page(F.col("id")).alias("page_id"),
        F.col("n").alias("payload_bytes"),
        F.col("digest").alias("payload_digest"),
        F.col("type").alias("record_type"),
        page(F.col("refers")).alias("refers_to"),
    )


def round_trip(pages: DataFrame, least: int = 0, per_file: int = 1000, id_col: str = "page_id", **columns: str) -> DataFrame:
    """Write the pages as archives in the shared folder and return what reading them back gives."""
    spark = pages.sparkSession
    path = fresh_path(spark, "archives")
    write_archives(pages, path, least, per_file, id_col=id_col, **columns)
    kind = pages.schema[id_col].dataType.simpleString()
    read = read_archives(spark, path)
    return read.withColumns({c: F.expr(f"try_cast(nullif({c}, '') as {kind})") for c in ("page_id", "refers_to")})


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages"))
