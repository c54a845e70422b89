r"""WARC archives without repeated payloads: records are written, told apart by payload digest, and read back.

A record is a response with its whole payload, or a revisit that refers to the response with the
same payload. Headers alone (key, digest, length) are grouped by digest; the first record of a group
is its response, all others become revisits with headers of their own. Groups of one need no
decision, so what records meet is the table of repeated digests: broadcast where it is counted to be
small, else joined, the rows of very common digests where they are and the others by a shuffle.

Archives are text files of Spark's own writer, so that its commit protocol covers lost tasks: one
record a row, ended by an empty line, gzip over each file. Readers split them at ``\nWARC/1.``. That
line break and mark stand nowhere else in an archive written here: header fields keep no line
breaks, and a payload that would hold the mark goes out in chunks (HTTP's own transfer coding, which
a payload and its digest are without) that part it. Archives of others are read the same way, and a
record whose length isn't the one it states is marked as broken.

Defined results: null payloads are empty ones; records of less than ``least`` bytes are always
responses; the first of a group is that with the smallest page id (null last), then date, then key;
repeated rows are repeated records; a null page id or URL has no header or a fixed URN; revisits
without a response anywhere stay revisits, without length; extra columns are ignored, whatever their
names; an empty table gives an archive without records.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewake.llm.common import LEAST_HOT, MOST_HOT, Tables, with_key

MARK = "WARC/1."
#: End of a line, of a header and of a record; the profile of revisits; what stands for no address.
LINE, BLANK = "\r\n", "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NO_URI = "urn:no-address"
#: Payloads below this are never revisits.
LEAST_BYTES = 100
#: Repeated digests, and responses with revisits, that are broadcast at most.
BROADCAST_GROUPS = 200_000
CAPTURED = "2024-01-01T00:00:00Z"


def enchunk(payload: bytes) -> bytes:
    """The payload in HTTP chunks, none of which holds the mark."""
    return b"".join(b"%x\r\n%s\r\n" % (len(x), x) for x in re.split(rb"(?<=WARC)(?=/1\.)", payload) if x) + b"0\r\n\r\n"


def dechunk(body: bytes) -> bytes:
    """What HTTP chunks hold, as far as they go; size lines may have extensions."""
    out, at = [], 0
    while size := re.compile(rb"([0-9A-Fa-f]+)[^\n]*\n").match(body, at):
        n = int(size[1], 16)
        out.append(body[size.end() : size.end() + n])
        at = size.end() + n + 2
        if not n:
            break
    return b"".join(out)


def _each(f: Callable[[bytes], bytes], values: Column) -> Column:
    """f of the values that aren't null: few are, so few leave the JVM."""

    def mapped(some: pd.Series) -> pd.Series:
        return some.map(lambda v: None if v is None else f(v))

    return F.pandas_udf(mapped, T.BinaryType())(values)


def page_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", captured: str = CAPTURED) -> DataFrame:
    """key, page_id, uri, date, head, payload, digest, n_bytes: a record for each row of pages."""
    rows, key = with_key(pages, id_col, "warc-rows")
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    return _measured(rows.select(
        F.col(key).cast("string").alias("key"), F.col(id_col).alias("page_id"), F.coalesce(F.col(url_col), F.lit(NO_URI)).alias("uri"), F.lit(captured).alias("date"),
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8").alias("head"), payload.alias("payload"),
    ))


def _measured(records: DataFrame) -> DataFrame:
    return records.withColumns({"digest": F.sha2("payload", 256), "n_bytes": F.octet_length("payload").cast("long")})


def _join_few(rows: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """Left join of rows with the group of their key, of any share of the rows; ``groups`` is written and has its sizes in ``rows``."""
    if groups.count() <= BROADCAST_GROUPS:
        return rows.join(F.broadcast(groups), key, "left")
    most = max((groups.agg(F.sum("rows")).first()[0] or 0) // MOST_HOT, LEAST_HOT)
    hot, cold = F.broadcast(groups.filter(F.col("rows") > most)), groups.filter(F.col("rows") <= most)
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(cold, key, "left"))


def with_originals(records: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """Records with ``original``: key, page_id, uri and date of the response that they repeat; null for responses.

    Records without payload (revisits of other archives) take part with the digest that they state.
    """
    tables = Tables(records.sparkSession, "warc-groups")
    own = F.struct("page_id", "uri", "date", "key")
    order = F.struct(F.col("page_id").isNull().alias("none"), F.col("page_id").alias("page_id"), F.col("date").alias("date"), F.col("key").alias("key"), F.col("uri").alias("uri"))
    groups = records.filter(F.coalesce(F.col("n_bytes"), F.lit(least)) >= least).groupBy("digest").agg(F.count(F.lit(1)).alias("rows"), F.min(F.when(F.col("payload").isNotNull(), order)).alias("first"))
    groups = tables.write(groups.filter("rows > 1 AND first IS NOT NULL").select("digest", "rows", F.struct("first.page_id", "first.uri", "first.date", "first.key").alias("first")))
    found = _join_few(records, groups, "digest")
    return found.withColumn("original", F.when(F.coalesce(F.col("n_bytes"), F.lit(least)) >= least, F.when(~F.col("first").eqNullSafe(own), F.col("first")))).drop("rows", "first")


def record_id(key: Column, digest: Column) -> Column:
    """A URN that a record keeps in every run."""
    h = F.md5(F.concat_ws("\n", key, digest).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), *(x for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in (F.lit("-" if a > 1 else ""), F.substring(h, a, n))), F.lit(">"))


def _field(name: str, value: Column) -> Column:
    """A header line, left out where the value is null; line breaks in it are percent-encoded."""
    flat = F.replace(F.replace(value.cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), flat, F.lit(LINE)), F.lit(""))


def record_text(records: DataFrame) -> DataFrame:
    """value: what stands in the archive for records with ``original``."""
    is_revisit = F.col("original").isNotNull() | F.col("payload").isNull()
    marked = ~is_revisit & F.contains(F.concat(F.lit("\n"), F.col("payload").cast("string")), F.lit(f"\n{MARK}"))
    body = records.withColumns({"is_revisit": is_revisit, "marked": marked})
    body = body.withColumn("chunks", _each(enchunk, F.when(F.col("marked"), F.col("payload"))))
    coding = F.when(F.col("marked"), F.lit("Transfer-Encoding: chunked")).otherwise(F.concat(F.lit("Content-Length: "), F.coalesce("n_bytes", F.lit(0)).cast("string")))
    block = F.concat(F.concat_ws(LINE, F.replace(F.col("head"), F.lit(f"\n{MARK}"), F.lit(f"\nX-{MARK}")), coding), F.lit(BLANK)).cast("binary")
    block = F.when(F.col("is_revisit"), block).otherwise(F.concat(block, F.coalesce("chunks", "payload")))
    body = body.withColumn("block", block)
    first = F.col("original")
    header = F.concat(
        F.lit(f"{MARK}1{LINE}"), _field("WARC-Type", F.when(F.col("is_revisit"), "revisit").otherwise("response")), _field("WARC-Record-ID", record_id(F.col("key"), F.col("digest"))), _field("WARC-Date", F.col("date")), _field("WARC-Target-URI", F.col("uri")),
        _field("WARC-Page-ID", F.col("page_id")), _field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")), _field("WARC-Profile", F.when(F.col("is_revisit"), PROFILE)),
        _field("WARC-Refers-To", F.when(first.isNotNull(), record_id(first["key"], F.col("digest")))), _field("WARC-Refers-To-Target-URI", first["uri"]), _field("WARC-Refers-To-Date", first["date"]),
        _field("Content-Type", F.lit("application/http;msgtype=response")), _field("Content-Length", F.octet_length("block")), F.lit(LINE),
    )
    return body.select(F.concat(header.cast("binary"), F.col("block")).cast("string").alias("value"))


def write_archive(records: DataFrame, path: str, compression: str = "gzip") -> str:
    """Records with ``original`` as archive files under ``path``, one for each partition."""
    record_text(records).write.text(path, compression=compression, lineSep=BLANK)
    return path


def _header(name: str, of: Column) -> Column:
    found = F.regexp_extract(of, rf"(?idm)^{name}:[ \t]*([^\r\n]*)", 1)
    return F.when(found != "", F.rtrim(found))


def read_archive(spark: SparkSession, *paths: str) -> DataFrame:
    """record_id, type, page_id, uri, date, digest, ref_id, head, payload, broken: the records of archive files.

    ``digest`` is that of the payload, and for revisits the one that they state; ``page_id`` is text.
    """
    lines = spark.read.text(list(paths), lineSep=f"\n{MARK}").filter("value <> ''")
    header = F.substring_index("value", BLANK, 1)
    rows = lines.select("value", header.alias("header"))
    named = lambda x: _header(x, F.col("header"))
    length = F.coalesce(F.expr("try_cast(length AS INT)"), F.lit(0))
    begins = F.octet_length("header") + 5
    rows = rows.withColumns({"length": named("Content-Length"), "is_http": F.coalesce(named("Content-Type").startswith("application/http"), F.lit(False))})
    rows = rows.withColumns({"block": F.substring(F.col("value").cast("binary"), begins, length), "rest": F.octet_length("value") - (begins - 1) - length})
    inner = F.when(F.col("is_http"), F.substring_index(F.col("block").cast("string"), BLANK, 1))
    rows = rows.withColumn("head", inner)
    body = F.when(F.col("is_http"), F.substring(F.col("block"), F.octet_length("head") + 5, F.octet_length("block"))).otherwise(F.col("block"))
    rows = rows.withColumn("body", body).withColumn("parts", _each(dechunk, F.when(F.col("head").rlike(r"(?idm)^Transfer-Encoding:[ \t]*chunked"), F.col("body"))))
    kind = named("WARC-Type")
    payload = F.when(kind != "revisit", F.coalesce("parts", "body"))
    stated = F.regexp_extract(F.coalesce(named("WARC-Payload-Digest"), F.lit("")), r"(?i)^sha256:(\S+)", 1)
    uri = named("WARC-Target-URI")
    rows = rows.select(
        named("WARC-Record-ID").alias("record_id"), kind.alias("type"), named("WARC-Page-ID").alias("page_id"), F.when(uri != NO_URI, uri).alias("uri"), named("WARC-Date").alias("date"), F.lower(stated).alias("stated"),
        named("WARC-Refers-To").alias("ref_id"), "head", payload.alias("payload"), (F.col("length").isNull() | ~F.col("rest").between(0, 4)).alias("broken"),
    )
    return rows.withColumn("digest", F.coalesce(F.sha2("payload", 256), "stated")).drop("stated")


def resolved(records: DataFrame) -> DataFrame:
    """record_id, page_id, type, digest, n_bytes, refers_to of read records; revisits have length and page id from the response that they refer to."""
    tables = Tables(records.sparkSession, "warc-heads")
    heads = tables.write(records.filter("type IN ('response', 'revisit')").select("record_id", "page_id", "type", "digest", "ref_id", F.octet_length("payload").cast("long").alias("n_bytes")))
    asked = heads.filter("type = 'revisit' AND ref_id IS NOT NULL").groupBy("ref_id").agg(F.count(F.lit(1)).alias("rows"))
    first = heads.filter("type = 'response'").select(F.col("record_id").alias("ref_id"), F.col("page_id").alias("refers_to"), F.col("n_bytes").alias("its_bytes"))
    groups = tables.write(asked.join(first, "ref_id"))
    whole = heads.filter("type = 'response'").select("record_id", "page_id", "type", "digest", "n_bytes", F.lit(None).cast("string").alias("refers_to"))
    again = _join_few(heads.filter("type = 'revisit'"), groups, "ref_id").select("record_id", "page_id", "type", "digest", F.col("its_bytes").alias("n_bytes"), "refers_to")
    return whole.unionByName(again)


def archive_pages(pages: DataFrame, path: str | None = None, least: int = LEAST_BYTES, **columns: str) -> str:
    """Pages as an archive without repeated payloads; its path, in the shared folder where none is given."""
    spark = pages.sparkSession
    path = path or f"{Tables(spark, 'warc').base}/archive"
    return write_archive(with_originals(page_records(pages, **columns), least), path)


def deduplicate_archives(spark: SparkSession, sources: list[str], path: str, least: int = LEAST_BYTES) -> str:
    """Responses and revisits of archives, written anew: each payload once, all records with fresh headers. Broken records raise no error and aren't copied."""
    read = read_archive(spark, *sources).filter("type IN ('response', 'revisit') AND NOT broken")
    head = F.regexp_replace(F.coalesce("head", F.lit("HTTP/1.1 200 OK")), r"(?im)^(Content-Length|Transfer-Encoding):[^\r\n]*(\r\n)?", "")
    records = read.select(F.col("record_id").alias("key"), "page_id", F.coalesce("uri", F.lit(NO_URI)).alias("uri"), "date", F.rtrim(head, F.lit("\r\n")).alias("head"), "payload", "digest", F.octet_length("payload").cast("long").alias("n_bytes"))
    written = Tables(spark, "warc-read").write(records)
    return write_archive(with_originals(written, least), path)

