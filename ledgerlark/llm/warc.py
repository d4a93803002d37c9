"""Web pages as WARC archives, and back: payloads that repeat are revisits, large ones are segmented.

A page is an HTTP response of chunked transfer framing. A block over SEGMENT bytes is a
first record and continuations, which name the first one's identifier as their origin. The
reader groups continuations by it, puts them in order by segment number, verifies the
total length and takes off the framing. Archives are gzipped files in the shared folder,
or any others: Spark reads them a record at a time, by the marker that begins each.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import bounded_text_batches, shared_folder, stored

#: Bytes of a payload from which equal ones are revisits, of a record's block, and of a chunk of the transfer framing.
LEAST, SEGMENT, CHUNK = 100, 32_768, 8_192
#: What begins a record. Chunks end inside it, so no payload that is written here holds it.
MARK, VERSION, DATE = b"WARC/1.", b"1", "1970-01-01T00:00:00Z"
_LINE, _GAP = b"\r\n", b"\r\n\r\n"


# --- writing


def _headers(lines: dict[str, object]) -> bytes:
    return b"".join(f"{k}: {v}\r\n".encode("utf-8", "surrogatepass") for k, v in lines.items() if v is not None)


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """payload in chunked transfer framing; a chunk ends early where MARK would stand in one piece."""
    out, at = [], 0
    while at < len(payload):
        end = min(at + size, len(payload))
        found = payload.find(MARK, at, end + len(MARK) - 1)
        if found >= 0:
            end = found + 4
        out += [b"%x" % (end - at), _LINE, payload[at:end], _LINE]
        at = end
    return b"".join([*out, b"0", _GAP])


def _identifier(*parts: object) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(repr(parts).encode('utf-8', 'surrogatepass')).digest()[:16])}>"


def _quoted(page_id: str | None) -> str | None:
    return None if page_id is None else quote(page_id, safe="")


def record(lines: dict[str, object], block: bytes) -> bytes:
    """A record without the two empty lines behind it."""
    return MARK + VERSION + _LINE + _headers(lines | {"Content-Length": len(block)}) + _LINE + block


def page_records(row: int, page_id: object, url: str | None, payload: bytes, digest: str, original: int, original_id: object, segment: int = SEGMENT) -> Iterator[bytes]:
    """The records of a page: a revisit where another row is its original, else a response and its continuations."""
    target = "".join((url or "").split()).replace(MARK.decode(), quote(MARK, safe="")) or None
    lines = {
        "WARC-Type": "response" if original == row else "revisit", "WARC-Record-ID": _identifier("page", row), "WARC-Date": DATE, "WARC-Target-URI": target,
        "WARC-Payload-Digest": f"sha256:{digest}", "WARC-Page-ID": _quoted(page_id), "Content-Type": "application/http; msgtype=response",
    }
    head = b"HTTP/1.1 200 OK" + _LINE + b"Content-Type: text/html; charset=utf-8" + _LINE
    if original != row:
        refers = {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": _identifier("page", original), "WARC-Refers-To-Page-ID": _quoted(original_id)}
        yield record(lines | refers, head + _LINE)
        return
    block = memoryview(head + b"Transfer-Encoding: chunked" + _GAP + chunked(payload))
    cuts = _cuts(block, segment)
    if len(cuts) == 2:
        yield record(lines, bytes(block))
        return
    for n, (start, end) in enumerate(zip(cuts, cuts[1:], strict=False), 1):
        if n > 1:
            lines = {"WARC-Type": "continuation", "WARC-Record-ID": _identifier("page", row, n), "WARC-Date": DATE, "WARC-Target-URI": target, "WARC-Segment-Origin-ID": _identifier("page", row)}
        total = {"WARC-Segment-Total-Length": len(block)} if end == len(block) else {}
        yield record(lines | {"WARC-Segment-Number": n} | total, bytes(block[start:end]))


def _cuts(block: memoryview, segment: int) -> list[int]:
    return [*range(0, len(block), segment), len(block)]


def originals(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """pages (_row, page_id, payload, digest) with original and original_id of the row that is the response for the payload.

    Of rows with equal payloads of `least` bytes or more that is the one with the smallest
    page_id, then the first row; null ids come last. Only digests that rows share are
    joined back, with identifiers alone.
    """
    first = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "_row")).alias("first")
    shared = pages.where(F.length("payload") >= least).groupBy("digest").agg(first, F.count(F.lit(1)).alias("rows")).where("rows > 1")
    shared = stored(shared.select("digest", F.col("first._row").alias("original"), F.col("first.page_id").alias("original_id")))
    found = pages.join(shared, "digest", "left")
    return found.withColumn("original", F.coalesce("original", "_row"))


def write(pages: DataFrame, path: str, least: int = LEAST, segment: int = SEGMENT) -> None:
    """Archives of pages (page_id, url, html) in the folder `path`, a gzipped file a task.

    Null html is an empty payload, a null page_id or url is left out of the record. Repeated
    rows have records of their own. A text source writes the records: what it puts behind a
    line is what a record ends with.
    """
    bounded_text_batches(pages.sparkSession)
    ids = F.col("page_id").cast("string").alias("page_id")
    rows = pages.select(F.monotonically_increasing_id().alias("_row"), "page_id", F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"))
    rows = originals(stored(rows.withColumn("digest", F.sha2("payload", 256))), least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for values in zip(*(batch.column(c) for c in columns), strict=True):
                found = list(page_records(*(v.as_py() for v in values), segment))
                for i in range(0, len(found), 64):
                    yield pa.RecordBatch.from_arrays([pa.array(found[i : i + 64], pa.binary())], ["record"])

    columns = ["_row", "page_id", "url", "payload", "digest", "original", "original_id"]
    records = rows.select("_row", ids, "url", "payload", "digest", "original", F.col("original_id").cast("string")).mapInArrow(run, "record binary")
    records.select(F.col("record").cast("string")).write.option("lineSep", _GAP.decode()).option("compression", "gzip").text(path)


# --- reading


def split_headers(text: bytes) -> tuple[dict[str, str], int]:
    """The header fields (names in lower case) up to the first empty line, and where what follows begins."""
    fields, at = {}, 0
    while True:
        end = text.find(b"\n", at)
        line = (text[at:] if end < 0 else text[at:end]).rstrip(b"\r")
        at = len(text) if end < 0 else end + 1
        if not line:
            return fields, at
        if (colon := line.find(b":")) > 0:
            fields[line[:colon].strip().decode("latin-1").lower()] = line[colon + 1 :].strip().decode("utf-8", "replace")
        if end < 0:
            return fields, at


def dechunked(body: bytes) -> bytes | None:
    """body without its transfer framing; None where the framing is broken."""
    out, at = [], 0
    while True:
        end = body.find(_LINE, at)
        try:
            size = int(body[at:end].split(b";")[0].strip(), 16) if end >= 0 else -1
        except ValueError:
            size = -1
        if size < 0 or end + 2 + size > len(body):
            return None
        if not size:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + size])
        at = end + 2 + size
        if body[at : at + 2] != _LINE:
            return None
        at += 2


#: Fields of records that the reader looks at, by column.
FIELDS = {
    "record_id": "warc-record-id", "kind": "warc-type", "page_id": "warc-page-id", "url": "warc-target-uri", "declared": "warc-payload-digest", "refers": "warc-refers-to",
    "origin": "warc-segment-origin-id", "segment": "warc-segment-number", "total": "warc-segment-total-length",
}
_RECORD = ", ".join(f"{c} string" for c in FIELDS) + ", block binary, fault string"


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records from pieces between markers, in the order of their file. A block that holds the marker is put together from its pieces."""
    name, piece, need = None, b"", 0

    def parse(text: bytes) -> dict:
        fields, at = split_headers(text[text.find(b"\n") + 1 :])
        at += text.find(b"\n") + 1
        size = fields.get("content-length", "")
        if not text[:at].endswith((b"\n\n", b"\r\n\r\n")):  # the marker is in a header field
            return {"need": 1 << 62, "at": at, "size": None} | fields
        if not size.isdecimal():
            return {"need": 0, "at": at, "size": None} | fields
        return {"need": at + int(size), "at": at, "size": int(size)} | fields

    def out(text: bytes) -> dict:
        found = parse(text)
        size = found["size"]
        fault = "no length" if size is None else "cut" if len(text) < found["need"] else None
        page_id = unquote(found["warc-page-id"]) if "warc-page-id" in found else None
        return {c: found.get(f) for c, f in FIELDS.items()} | {"page_id": page_id, "block": None if fault else text[found["at"] : found["need"]], "fault": fault}

    for batch in batches:
        rows = []
        for file, value in zip(batch.column("file"), batch.column("value"), strict=True):
            file, value = file.as_py(), value.as_py()
            if piece and file == name and len(piece) < need and not (need == 1 << 62 and value[1:2] in (b"\r", b"\n")):
                piece += MARK + value
                need = parse(piece)["need"]
                continue
            if piece:
                rows.append(out(piece))
            name, piece = file, value if value[1:2] in (b"\r", b"\n") else b""  # before a file's first record there is nothing
            need = parse(piece)["need"] if piece else 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _SCHEMA)
    if piece:
        yield pa.RecordBatch.from_pylist([out(piece)], _SCHEMA)


_SCHEMA = pa.schema([(c, pa.string()) for c in FIELDS] + [("block", pa.binary()), ("fault", pa.string())])


def records(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archives at `path`: header fields, block, and a fault: `no length`, or `cut` where the block is shorter than declared.

    Gzipped archives are read a file a task, others in splits; a record is all that a task
    holds. A block with the marker inside is put together, unless a split ends in it: then
    the record is `cut`.
    """
    bounded_text_batches(spark)
    lines = spark.read.option("lineSep", MARK.decode()).text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("value")).mapInArrow(_parsed, _RECORD)


def reassembled(found: DataFrame) -> DataFrame:
    """A row for each record that is no continuation, with its whole block; fault says why a segmented one has none.

    Continuations are grouped by their origin, put in order by number, and must be numbered
    from 1 without gaps or repeats up to one that declares the total length, which must hold.
    """
    number, total = F.expr("try_cast(segment AS int)"), F.expr("try_cast(total AS bigint)")
    parts = found.where("segment IS NOT NULL OR kind = 'continuation'").withColumn("_first", F.expr("coalesce(origin, record_id)"))
    part = F.struct(F.coalesce(number, F.lit(-1)).alias("n"), "block", "fault", total.alias("total"))
    head = F.max(F.when(F.col("origin").isNull(), F.struct("kind", "page_id", "url", "declared", "refers"))).alias("head")
    lists = parts.groupBy("_first").agg(F.sort_array(F.collect_list(part)).alias("parts"), head)
    numbers, blocks = F.transform("parts", lambda p: p["n"]), F.transform("parts", lambda p: p["block"])
    length = F.aggregate(blocks, F.lit(0).cast("long"), lambda a, b: a + F.coalesce(F.length(b), F.lit(0)))
    fault = (
        F.when(F.col("head").isNull(), "no first segment").when(numbers != F.sequence(F.lit(1), F.size("parts")), "segments missing or repeated")
        .when(F.exists("parts", lambda p: p["fault"].isNotNull()), "cut").when(F.coalesce(F.element_at("parts", -1)["total"], F.lit(-1)) != length, "length differs")
    )
    joined = F.array_join(F.transform(blocks, lambda b: b.cast("string")), "").cast("binary")
    columns = ["record_id", "kind", "page_id", "url", "declared", "refers", "block", "fault"]
    names = [F.col(f"head.{c}").alias(c) for c in columns[1:6]]
    whole = lists.withColumn("fault", fault).select(F.col("_first").alias("record_id"), *names, F.when(F.col("fault").isNull(), joined).alias("block"), "fault")
    return found.where("segment IS NULL AND coalesce(kind, '') <> 'continuation'").select(*columns).union(whole)


def _payloads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for block, fault in zip(batch.column("block"), batch.column("fault"), strict=True):
            block, fault, payload = block.as_py(), fault.as_py(), None
            if block is not None:
                fields, at = split_headers(block)
                payload = block[at:]
                if "chunked" in fields.get("transfer-encoding", "").lower():
                    payload = dechunked(payload)
                    fault = fault or ("framing broken" if payload is None else None)
            out.append((payload, fault))
        arrays = [batch.column(c) for c in ("record_id", "kind", "page_id", "url", "declared", "refers")]
        yield pa.RecordBatch.from_arrays([*arrays, pa.array([p for p, _ in out], pa.binary()), pa.array([f for _, f in out], pa.string())], _PAYLOAD)


_PAYLOAD = ["record_id", "kind", "page_id", "url", "declared", "refers", "payload", "fault"]


def payloads(whole: DataFrame) -> DataFrame:
    """Whole records with the HTTP payload of each, its transfer framing taken off; a revisit's own is empty."""
    return whole.select(*(c if c != "payload" else "block" for c in _PAYLOAD)).mapInArrow(_payloads, ", ".join(f"{c} {'binary' if c == 'payload' else 'string'}" for c in _PAYLOAD))


def read(spark: SparkSession, path: str) -> DataFrame:
    """record_id, record_type, page_id, url, payload_bytes, payload_digest, refers_id, refers_to and fault of the responses and revisits at `path`.

    A revisit has the size and digest of the response that it refers to, found by its
    identifier; refers_to is that one's page_id. Faults also name a digest other than the
    one declared, and revisits of nothing. Sizes and digests of records with faults are null.
    """
    found = payloads(reassembled(records(spark, path))).where("kind IN ('response', 'revisit') OR fault IS NOT NULL")
    own = F.sha2("payload", 256)
    declared = F.regexp_replace(F.lower("declared"), "^sha256:", "")
    table = stored(found.select("record_id", F.col("kind").alias("record_type"), "page_id", "url", declared.alias("declared"), "refers", F.length("payload").cast("long").alias("payload_bytes"), own.alias("payload_digest"), "fault"))
    first = table.where("record_type = 'response'").select(F.col("record_id").alias("refers"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("_bytes"), F.col("payload_digest").alias("_digest"))
    again = table.where("record_type = 'revisit'").drop("payload_bytes", "payload_digest").join(first, "refers", "left").withColumnsRenamed({"_bytes": "payload_bytes", "_digest": "payload_digest"})
    again = again.withColumn("fault", F.coalesce("fault", F.when(F.col("payload_digest").isNull(), "original missing")))
    columns = ["record_id", "record_type", "page_id", "url", "payload_bytes", "payload_digest", "declared", F.col("refers").alias("refers_id"), "refers_to", "fault"]
    rest = table.where("record_type IS DISTINCT FROM 'revisit'").withColumn("refers_to", F.lit(None).cast("string"))
    both = rest.select(*columns).union(again.select(*columns))
    both = both.withColumn("fault", F.coalesce("fault", F.when(F.col("declared") != F.col("payload_digest"), "digest differs")))
    right = F.col("fault").isNull()
    return both.select(*("record_id", "record_type", "page_id", "url"), *(F.when(right, F.col(c)).alias(c) for c in ("payload_bytes", "payload_digest")), "refers_id", "refers_to", "fault")


def round_trip(pages: DataFrame) -> DataFrame:
    """The pages as they are read back from archives that are written to the shared folder.

    Rows with null html have an empty payload; null and repeated ids and repeated rows keep a
    row each; an empty table has none; texts of any length are whole, in one task each;
    further columns are not written.
    """
    path = f"{shared_folder(pages.sparkSession)}/{uuid.uuid4().hex}.warc"
    write(pages, path)
    found = read(pages.sparkSession, path)
    id_type = pages.schema["page_id"].dataType
    return found.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})


def op12(pages: DataFrame) -> DataFrame:
    return round_trip(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') html, sha256(coalesce(html, '')) payload_digest, strlen(coalesce(html, '')) payload_bytes FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= {LEAST} AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {LEAST} AND first <> page_id THEN first END AS refers_to FROM f
"""
