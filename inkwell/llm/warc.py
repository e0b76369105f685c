"""WARC archives: writing captures as records, reading archives, and assembling transactions.

A capture is written as a request, a response (or a revisit of an earlier response with the
same payload) and a metadata record. Request and metadata name the response or revisit in
``WARC-Concurrent-To``. ``assemble`` joins the records of an archive by these identifiers and
emits one nested row per capture, with all of its concurrent records and their contents. It
follows the identifiers both ways and over other records: a request may name its response or be
named by it, a header may be repeated, and metadata of a request belong to the request's capture.

Archives are parts written by Spark's own committer into a shared folder, so retried tasks
leave no halves behind. A part is a valid WARC/1.1 file: records with CRLF header lines and an
exact Content-Length, each followed by two CRLFs. The reader goes by Content-Length alone, so
a payload may hold anything, even what looks like a record; it reads gzip archives, with one
member or one per record, as well as plain ones. A part holds about ``PART_BYTES``, before it is
compressed.

Defined cases: a null or empty payload is a response of 0 bytes; payloads under ``MINIMUM`` bytes
are never revisited; rows that share the largest id of their payload are all responses; a null
id ranks below all others and is kept; a null URL is written as an empty one; repeated rows are
captures of their own; an empty table gives an empty result; other columns are ignored whatever
their names. A revisit has no payload of its own; its digest and size are in its headers. A very
long payload is one record in one cell, and an archive is below 2 GiB, as Spark reads it whole.

Of archives written elsewhere: a record without identifier or type is damaged, and so is what
follows a broken header, a missing or wrong length or a broken gzip stream; it gives a row with
``damage`` alone, which ``assemble`` leaves out, and the rest of that archive after the last three
isn't read. Records that name a record the archives don't have, and records that neither name
another nor are named, are orphans: a row of kind ``orphan`` for what they name, or for themselves.
A record that names several captures is nested in each. Records that name each other in a circle
without a capture are orphans each.
"""

from __future__ import annotations

import gzip
import io
import zlib
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm.shared import materialize, new_folder, table

MINIMUM = 1000
PART_BYTES = 16 << 20
#: What a capture's three records have beside its payload and URL, about.
RECORD_BYTES = 1400
#: Every capture has the same date: the tables have none.
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "record_id string, record_type string, concurrent_to array<string>, target_uri string, date string, refers_to string, payload_digest string, fields map<string,string>, http binary, payload binary, block binary, damage string"
#: Records that are a capture; all others are beside one.
CAPTURES = ("response", "revisit", "resource")
#: What a concurrent record has in a capture's row.
NESTED = ("record_id", "record_type", "fields", "http", "block")


def plan_captures(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", payload_column: str = "html", minimum: int = MINIMUM) -> DataFrame:
    """(id, url, payload, size, digest, first_id): first_id is the response that a revisit refers to, else null.

    Payloads are grouped by SHA-256, in rows without them; only hashes that several pages
    share are joined back.
    """
    payload = F.coalesce(F.col(payload_column).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_column).alias("id"), F.coalesce(F.col(url_column).cast("string"), F.lit("")).alias("url"), payload.alias("payload"), F.octet_length(payload).cast("long").alias("size"), F.sha1(payload.cast("binary")).alias("digest"), F.sha2(payload.cast("binary"), 256).alias("same"))
    light = rows.where(F.col("size") >= minimum).groupBy("same").agg(F.max("id").alias("last_id"), F.count(F.lit(1)).alias("n"))
    shared = materialize(light.where("n > 1").select("same", "last_id"), "shared")
    joined = rows.join(shared, "same", "left")
    return joined.select("id", "url", "payload", "size", "digest", F.when(~F.col("id").eqNullSafe(F.col("last_id")), F.col("last_id")).alias("first_id"))


def _crlf(*lines) -> Column:
    parts = [x if isinstance(x, F.Column) else F.lit(x) for x in lines]
    return F.concat(*[y for x in parts for y in (x, F.lit("\r\n"))])


def _record(kind: str, uid: Column, headers: list[tuple[str, Column]], block: Column) -> Column:
    head = _crlf("WARC/1.1", f"WARC-Type: {kind}", F.concat(F.lit("WARC-Record-ID: <urn:inkwell:"), uid, F.lit(">")), f"WARC-Date: {DATE}", *[F.concat(F.lit(f"{k}: "), v) for k, v in headers], F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    return F.concat(head, F.lit("\r\n"), block)


def records(captures: DataFrame) -> DataFrame:
    """(value): the three records of each capture, without the two CRLFs that end a record."""
    uid = F.col("uid")
    link = F.concat(F.lit("<urn:inkwell:"), uid, F.lit(":response>"))
    url = F.regexp_replace(F.col("url"), "[\\r\\n]", "")
    common = [("WARC-Target-URI", url)]
    http = F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n")
    digest = F.concat(F.lit("sha1:"), F.col("digest"))
    response = _record("response", F.concat(uid, F.lit(":response")), [*common, ("WARC-Payload-Digest", digest), ("Content-Type", F.lit("application/http; msgtype=response"))], F.concat(http, F.col("payload")))
    refers = F.col("first_id").cast("string")
    revisit = _record("revisit", F.concat(uid, F.lit(":response")), [*common, ("WARC-Payload-Digest", digest), ("WARC-Refers-To", F.concat(F.lit("<urn:inkwell:page:"), refers, F.lit(">"))), ("WARC-Profile", F.lit(PROFILE)), ("Content-Type", F.lit("application/http; msgtype=response"))], http)
    request = _record("request", F.concat(uid, F.lit(":request")), [*common, ("WARC-Concurrent-To", link), ("Content-Type", F.lit("application/http; msgtype=request"))], F.concat(F.lit("GET "), url, F.lit(" HTTP/1.1\r\n\r\n")))
    about = _crlf(F.concat(F.lit("page-id: "), F.coalesce(F.col("id").cast("string"), F.lit(""))), F.concat(F.lit("payload-bytes: "), F.col("size").cast("string")))
    metadata = _record("metadata", F.concat(uid, F.lit(":metadata")), [*common, ("WARC-Concurrent-To", link), ("Content-Type", F.lit("application/warc-fields"))], about)
    return captures.select(F.explode(F.array(request, F.when(F.col("first_id").isNull(), response).otherwise(revisit), metadata)).alias("value"))


def write(captures: DataFrame, path: str, part_bytes: int = PART_BYTES, compressed: bool = True, mean_bytes: float | None = None) -> None:
    """Write captures (see plan_captures) as WARC parts into a folder, in the partitions that they are in.

    mean_bytes: of a capture's three records, where it is known without working out the captures.

    A row's number tells its capture from others with the same id. All records of a capture
    come from one evaluation of its row, so they agree on it whichever attempt of a task is
    committed.
    """
    if mean_bytes is None:
        mean_bytes = captures.agg(F.avg(F.col("size") + F.octet_length("url") * 4 + RECORD_BYTES)).first()[0] or RECORD_BYTES
    per_part = max(1, int(3 * part_bytes / mean_bytes))
    uid = F.concat_ws(":", F.coalesce(F.col("id").cast("string"), F.lit("null")), F.monotonically_increasing_id().cast("string"))
    rows = records(captures.withColumn("uid", uid))
    rows.write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", per_part).option("compression", "gzip" if compressed else "none").text(path)


Header = tuple[str, str]
#: Digits of a record's length, at most: archives are cells, of less than 2 GiB.
LENGTH_DIGITS = 10


def parse(data: bytes):
    """The records of an archive in turn: (headers in order, names in lower case; block). Raises ValueError where it is damaged."""
    stream = gzip.GzipFile(fileobj=io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
    try:
        while line := stream.readline():
            if not line.strip():
                continue
            if not line.startswith(b"WARC/"):
                raise ValueError(f"a record was expected, not {line[:40]!r}")
            headers: list[Header] = []
            while (line := stream.readline()).strip():
                name, colon, value = line.decode("utf-8", "replace").partition(":")
                if line[:1] in b" \t" and headers:  # a header goes on
                    headers[-1] = (headers[-1][0], f"{headers[-1][1]} {line.decode('utf-8', 'replace').strip()}")
                elif colon:
                    headers.append((name.strip().lower(), value.strip()))
                else:
                    raise ValueError(f"a header was expected, not {line[:40]!r}")
            size = header(headers, "content-length")
            if size is None or not size.isdecimal():
                raise ValueError(f"a record has the length {size!r}")
            if len(size.lstrip("0")) > LENGTH_DIGITS:
                raise ValueError(f"a record of {size[:40]} bytes is longer than an archive can be")
            block = stream.read(int(size))
            if len(block) != int(size):
                raise ValueError("the archive ends inside a record")
            yield headers, block
    except (EOFError, gzip.BadGzipFile, zlib.error) as broken:
        raise ValueError(f"broken gzip stream: {broken}") from broken


def header(headers: list[Header], name: str) -> str | None:
    """The first header of a name."""
    return next((value for key, value in headers if key == name), None)


def _row(headers: list[Header], block: bytes) -> tuple:
    of = partial(header, headers)
    if not of("warc-record-id") or not of("warc-type"):
        return (*[None] * 11, "a record has no identifier or type")
    kind, fields, http = of("warc-type"), None, None
    if (of("content-type") or "").startswith("application/http"):
        http, _, block = block.partition(b"\r\n\r\n")
    elif (of("content-type") or "").startswith("application/warc-fields"):
        fields = [tuple(x.strip() for x in line.split(":", 1)) for line in block.decode("utf-8", "replace").splitlines() if ":" in line]
    beside = [value for key, value in headers if key == "warc-concurrent-to"]
    content = (block, None) if kind in ("response", "resource") else (None, block)
    return (of("warc-record-id"), kind, beside, of("warc-target-uri"), of("warc-date"), of("warc-refers-to"), of("warc-payload-digest"), fields, http, *content, None)


def _read(batches):
    text, blob = pa.string(), pa.binary()
    types = [text, text, pa.list_(text), text, text, text, text, pa.map_(text, text), blob, blob, blob, text]
    schema = pa.schema([(column.split()[0], kind) for column, kind in zip(RECORD.split(", "), types)])

    def out(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), types)], schema=schema)

    for batch in batches:
        for content in batch.column(0):
            rows, held, records = [], 0, parse(content.as_py())
            while True:
                try:
                    rows.append(_row(*next(records)))
                except StopIteration:
                    break
                except ValueError as damage:
                    rows.append((*[None] * 11, str(damage)))
                    break
                held += sum(len(x) for x in rows[-1][8:11] if x)
                if held > 4 << 20:
                    yield out(rows)
                    rows, held = [], 0
            if rows:
                yield out(rows)


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives in a folder; of a damaged one, what stands before the damage, and a row with it.

    http: the request or status line and the headers of an HTTP message, without the empty line
    that ends them. What follows, or the whole block of any other record, is the payload of a
    response or resource and the block of all others.
    """
    files = spark.read.format("binaryFile").load(path).where("length > 0").select("content")
    return files.mapInArrow(_read, RECORD)


def transactions(found: DataFrame) -> DataFrame:
    """(record_id, capture) of the records beside captures, from a stored table of records.

    capture is a capture's identifier, or one that is named but that no record has. Nearly all
    records name their capture, or are named by it; only where some are linked through others
    does a round follow for each further step.
    """
    light = found.where("record_id is not null").select("record_id", F.col("record_type").isin(*CAPTURES).alias("main"), "concurrent_to")
    links = light.select("record_id", "main", F.explode("concurrent_to").alias("to"))
    kinds = light.groupBy(F.col("record_id").alias("to")).agg(F.max("main").alias("to_main"))
    linked = links.join(kinds, "to", "left")
    named = linked.where(~F.col("main") & F.coalesce("to_main", F.lit(True))).select("record_id", F.col("to").alias("capture"))
    naming = linked.where(F.col("main") & ~F.col("to_main")).select(F.col("to").alias("record_id"), F.col("record_id").alias("capture"))
    direct = named.unionByName(naming).distinct()
    steps = linked.where(~F.col("main") & ~F.col("to_main")).select(F.col("record_id").alias("a"), F.col("to").alias("b"))
    if steps.isEmpty():
        return direct
    known = newest = materialize(direct, "known")
    steps = materialize(steps.unionByName(steps.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "steps")
    while not newest.isEmpty():
        reached = steps.join(newest, steps["b"] == newest["record_id"]).select(F.col("a").alias("record_id"), "capture").distinct()
        newest = materialize(reached.join(known.select("record_id"), "record_id", "left_anti"), "newest")
        known = materialize(known.unionByName(newest), "known")
    return known


def assemble(found: DataFrame, carried: Column | None = None) -> DataFrame:
    """One row per capture: record_id, target_uri, date, kind, refers_to, payload_digest, http, payload, concurrent, request and metadata.

    concurrent has every other record of the capture's transaction, in order of record_id, with its
    contents; request and metadata are the first of each kind. Each transaction is one capture,
    so no key is common. Records are written once before they are joined, so archives are
    read once. carried: what goes along as payload, an expression over the record; by default
    its bytes.
    """
    payload = F.col("payload") if carried is None else carried
    found = materialize(found.where("damage is null").withColumn("payload", payload).drop("damage"), "records")
    is_main = F.col("record_type").isin(*CAPTURES)
    main = found.where(is_main).select("record_id", "target_uri", "date", F.col("record_type").alias("kind"), "refers_to", "payload_digest", "http", "payload")
    known = transactions(found)
    beside = found.where(~is_main).select(*NESTED).join(known, "record_id", "left").withColumn("capture", F.coalesce("capture", "record_id"))
    nested = F.struct(*NESTED)
    order = lambda of: F.struct(F.coalesce(of("record_id"), F.lit("")), of("record_type"), F.to_json(F.struct(of("fields"))), of("http"), of("block"))
    first = lambda kind: F.min_by(nested, F.when(F.col("record_type") == kind, order(F.col)))
    after = lambda x, y: F.when(order(x.getField) < order(y.getField), -1).when(order(x.getField) > order(y.getField), 1).otherwise(0)
    beside = beside.groupBy(F.col("capture").alias("record_id")).agg(F.collect_list(nested).alias("concurrent"), first("request").alias("request"), first("metadata").alias("metadata"))
    joined = main.join(beside, "record_id", "full").withColumn("kind", F.coalesce("kind", F.lit("orphan")))
    return joined.withColumn("concurrent", F.coalesce(F.array_sort("concurrent", after), F.array()))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pages = new_folder(spark, "archives"), table(spark, sf_dir, "pages")
    sizes = F.coalesce(F.octet_length("html"), F.lit(0)) + F.coalesce(F.octet_length("url"), F.lit(0)) * 4 + RECORD_BYTES
    write(plan_captures(pages), path, mean_bytes=pages.agg(F.avg(sizes)).first()[0] or RECORD_BYTES)
    payload = F.coalesce(F.col("payload"), F.lit("").cast("binary"))
    captures = assemble(read(spark, path), F.struct(F.octet_length(payload).cast("long").alias("size"), F.sha1(payload).alias("sha1")))
    about = F.col("metadata.fields")
    own = F.col("kind") == "response"
    return captures.select(
        F.element_at(about, "page-id").try_cast("long").alias("page_id"),
        F.when(own, F.col("payload.size")).otherwise(F.element_at(about, "payload-bytes").cast("long")).alias("payload_bytes"),
        F.when(own, F.col("payload.sha1")).otherwise(F.regexp_replace("payload_digest", "^sha1:", "")).alias("payload_digest"),
        F.col("kind").alias("record_type"),
        F.regexp_extract("refers_to", "page:(-?\\d+)>", 1).try_cast("long").alias("refers_to"),
    )


OP6_SQL = """
WITH p AS (
  SELECT page_id, COALESCE(html, '') AS html, CAST(strlen(COALESCE(html, '')) AS BIGINT) AS n FROM pages
), f AS (
  SELECT *, MAX(page_id) OVER (PARTITION BY html) AS last_id FROM p
)
SELECT page_id, n AS payload_bytes, sha1(html) AS payload_digest,
  CASE WHEN n >= 1000 AND page_id IS DISTINCT FROM last_id AND last_id IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id IS DISTINCT FROM last_id THEN last_id END AS refers_to
FROM f
"""
