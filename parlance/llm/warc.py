"""Operator 6: WARC archives written and read by Spark, and assembly of capture transactions."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, quoted, scratch_root, spread_join, table, text_or_empty

CRLF = "\r\n"
END = CRLF + CRLF
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_SCHEMA = (
    "record_id string, record_type string, concurrent_to string, refers_to string, target_uri string, warc_date string, "
    "payload_digest string, head string, payload binary, fields string, damage string"
)
#: Compressed bytes after which an archive file is closed.
FILE_BYTES = 16 << 20


# ---------------------------------------------------------------- writing


def plan_revisits(pages: DataFrame, least_bytes: int, id_col: str, body_col: str) -> DataFrame:
    """(page_id, digest, refers_to) of pages whose payload another page with a smaller id has. Payloads of very
    many pages are dealt to several tasks."""
    body = text_or_empty(F.col(quoted(body_col)).cast("string"))
    narrow = pages.select(F.col(quoted(id_col)).alias("page_id"), F.sha2(body, 256).alias("digest"), F.octet_length(body).alias("bytes"))
    narrow = narrow.where(F.col("bytes") >= least_bytes).select("page_id", "digest")
    first = narrow.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 AND refers_to IS NOT NULL")
    later = spread_join(narrow, materialise(first, "payloads"), ["digest"], ["page_id"])
    return later.where("page_id IS NULL OR page_id > refers_to").distinct()


def _urn(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("?")) for p in parts]))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def _record(kind: str | Column, record_id: Column, date: str, fields: list[tuple[str, Column]], block: Column) -> Column:
    """Head and block of one record. Fields whose value is null are left out."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    lines = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), record_id), F.lit(f"WARC-Date: {date}")]
    lines += [F.concat(F.lit(f"{name}: "), value) for name, value in fields]
    lines += [F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(END), block)


def _member(record: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(record) + z.flush()


def _packer(file_bytes: int):
    """Compresses each record as a gzip member of its own and packs members into files of about so many bytes.

    A file is one row. The text writer ends it with its separator, a zero byte, so the last byte of the empty
    member that closes it, which is zero too, is left to the writer.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([b"".join([*held, _member(b"")[:-1]])], pa.binary())], names=["value"])

        for batch in batches:
            for i in range(batch.num_rows):
                for column in batch.columns:
                    held.append(_member(column[i].as_py().encode() + END.encode()))
                    size += len(held[-1])
                if size >= file_bytes:
                    yield close()
                    held, size = [], 0
        if held:
            yield close()

    return run


def write_archives(
    pages: DataFrame,
    path: str,
    least_bytes: int = 100,
    file_bytes: int = FILE_BYTES,
    date: str = "1970-01-01T00:00:00Z",
    id_col: str = "page_id",
    url_col: str = "url",
    body_col: str = "html",
) -> None:
    """Write a request, a response or revisit, and a metadata record for each page, each a gzip member of its own.

    Spark's text writer writes the archives, files of about ``file_bytes`` each, so any file system that it knows
    will do. Line feeds in addresses are percent-encoded; a null address has no target field and a null body is
    an empty payload. Pages that repeat give captures of their own; of pages that share the smallest id and the
    payload all are responses. No pages give no archive.
    """
    revisits = plan_revisits(pages, least_bytes, id_col, body_col)
    body = text_or_empty(F.col(quoted(body_col)).cast("string"))
    base = pages.select(F.col(quoted(id_col)).alias("page_id"), F.col(quoted(url_col)).cast("string").alias("url"), body.alias("body"))
    # a plain key for null ids, so that the join and the window share one shuffle of the bodies
    key = F.coalesce(F.col("page_id").cast("long"), F.lit(-(2**63))).alias("key")
    base = base.withColumn("digest", F.sha2("body", 256)).select("*", key)
    base = base.join(revisits.select(key, "digest", F.col("refers_to").alias("rto")), ["key", "digest"], "left")
    # equal rows get ids of their own
    base = base.withColumn("again", F.row_number().over(Window.partitionBy("key", "digest").orderBy(F.lit(1))))
    uri = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    me = _urn(F.lit("capture"), F.col("page_id"), F.col("digest"), F.col("again"))
    target, is_revisit = ("WARC-Target-URI", uri), F.col("rto").isNotNull()
    size = F.octet_length("body").cast("string")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), size, F.lit(END))
    parts = F.regexp_extract(uri, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    ask = F.concat(F.lit("GET "), F.coalesce(F.nullif(F.regexp_extract(uri, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1), F.lit("")), F.lit("/")), F.lit(f" HTTP/1.1{CRLF}Host: "), F.coalesce(parts, F.lit("")), F.lit(END))
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest")))
    main = _record(
        F.when(is_revisit, F.lit("revisit")).otherwise(F.lit("response")),
        me,
        date,
        [
            target,
            ("WARC-Refers-To", F.when(is_revisit, _urn(F.lit("capture"), F.col("rto"), F.col("digest"), F.lit(1)))),
            ("WARC-Profile", F.when(is_revisit, F.lit(REVISIT_PROFILE))),
            digest,
            ("Content-Type", F.lit("application/http; msgtype=response")),
        ],
        F.when(is_revisit, http).otherwise(F.concat(http, F.col("body"))),
    )
    request = _record("request", _urn(F.lit("request"), F.col("page_id"), F.col("digest"), F.col("again")), date, [target, ("WARC-Concurrent-To", me), ("Content-Type", F.lit("application/http; msgtype=request"))], ask)
    about = F.concat_ws(CRLF, F.concat(F.lit("page_id: "), F.col("page_id").cast("string")), F.concat(F.lit("payload_bytes: "), size))
    metadata = _record("metadata", _urn(F.lit("metadata"), F.col("page_id"), F.col("digest"), F.col("again")), date, [target, ("WARC-Concurrent-To", me), ("Content-Type", F.lit("application/warc-fields"))], about)
    out = base.select(request.alias("request"), main.alias("main"), metadata.alias("metadata")).mapInArrow(_packer(file_bytes), "value binary")
    out.select(F.col("value").cast("string")).write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)


# ---------------------------------------------------------------- reading


class _Source:
    """The bytes of an archive in order, decompressed as they are asked for, with what went wrong at its end."""

    def __init__(self, content: bytes, step: int = 1 << 14) -> None:
        self.content, self.step, self.at, self.damage = memoryview(content), step, 0, None
        self.z = None
        self.zipped = content[:2] == b"\x1f\x8b"

    def more(self) -> bytes:
        """The next bytes, none at the end."""
        while self.at < len(self.content):
            part = self.content[self.at : self.at + (self.step if self.zipped else 1 << 20)]
            if not self.zipped:
                self.at += len(part)
                return bytes(part)
            if self.z is None:
                self.z, self.grown = zlib.decompressobj(31), self.step
            part = self.content[self.at : self.at + self.grown]
            try:
                out = self.z.decompress(part)
            except zlib.error:
                # bytes that are no member, as after the last one
                self.at, self.damage = len(self.content), "bytes"
                return b""
            self.at += len(part) - len(self.z.unused_data)
            # members are small as a rule; a large one is read in larger steps
            self.z, self.grown = (None, self.step) if self.z.eof else (self.z, min(self.grown * 2, 1 << 20))
            if out:
                return out
        if self.z is not None:
            self.z, self.damage = None, self.damage or "cut"
        return b""


def _head(lines: bytes) -> dict[str, str] | None:
    """Fields of a head by lower-case name, lines that continue joined; None if it is none."""
    first, *rest = lines.decode("utf-8", "replace").split(CRLF)
    if not first.startswith("WARC/"):
        return None
    head: dict[str, str] = {}
    last = None
    for line in rest:
        if line[:1] in " \t" and last is not None:
            head[last] = f"{head[last]} {line.strip()}".strip()
            continue
        name, colon, value = line.partition(":")
        if not colon:
            return None
        last = name.strip().lower()
        head[last] = value.strip()
    return head if head.get("content-length", "").isdecimal() else None


def _records(content: bytes) -> Iterator[tuple[dict[str, str], bytes, str | None]]:
    """(head, block, damage) of the records of one archive, by their stated lengths.

    After a malformed head (damage "head") reading goes on at the next line that opens a record; a record that the
    archive does not hold to its end is "cut"; what cannot be decompressed is "bytes".
    """
    source = _Source(content)
    held = bytearray()
    ended = False

    def need(n: int) -> bool:
        nonlocal ended
        while len(held) < n and not ended:
            got = source.more()
            held.extend(got)
            ended = not got
        return len(held) >= n

    while need(1):
        stop, seen = -1, 0
        while stop < 0:
            stop = held.find(b"\r\n\r\n", max(seen - 3, 0))
            seen = len(held)
            if stop < 0 and not need(seen + 1):
                break
        if stop < 0:
            if bytes(held).strip():
                yield {}, b"", source.damage or "cut"
            break
        head = _head(bytes(held[:stop]))
        if head is None:
            yield {}, b"", "head"
            while True:
                again = held.find(b"\nWARC/", 1)
                if again >= 0:
                    del held[: again + 1]
                    break
                del held[: max(len(held) - 6, 0)]
                if not need(len(held) + 1):
                    held.clear()
                    break
            continue
        size = int(head["content-length"])
        whole = need(stop + 4 + size)
        yield head, bytes(held[stop + 4 : stop + 4 + size]), None if whole else source.damage or "cut"
        need(stop + 8 + size)
        tail = 4 if held[stop + 4 + size : stop + 8 + size] == b"\r\n\r\n" else 0
        del held[: stop + 4 + size + tail]
        if not whole:
            return
    if source.damage == "bytes":
        yield {}, b"", "bytes"


def _row(head: dict[str, str], block: bytes, damage: str | None) -> tuple:
    kind = head.get("warc-type", "")
    http, payload, fields = None, None, None
    if kind in ("response", "revisit", "request"):
        top, _, body = block.partition(b"\r\n\r\n")
        http, payload = top.decode("utf-8", "replace"), body if kind == "response" else None
    elif kind == "metadata":
        fields = block.decode("utf-8", "replace")
    names = ("warc-concurrent-to", "warc-refers-to", "warc-target-uri", "warc-date", "warc-payload-digest")
    return (head.get("warc-record-id"), kind or None, *[head.get(n) for n in names], http, payload, fields, damage)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    text = ("record_id", "record_type", "concurrent_to", "refers_to", "target_uri", "warc_date", "payload_digest", "head")
    schema = pa.schema([*[(n, pa.string()) for n in text], ("payload", pa.binary()), ("fields", pa.string()), ("damage", pa.string())])
    rows: list[tuple] = []
    held = 0
    for batch in batches:
        for content in batch.column(0):
            for head, block, damage in _records(content.as_py()):
                rows.append(_row(head, block, damage))
                held += len(block)
                if held > 8 << 20 or len(rows) >= 5000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                    rows, held = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives under a path, one row each (RECORD_SCHEMA), compressed as a whole, by record or
    not at all. A task reads one file after the other and decompresses it record by record.

    ``damage`` is null for a sound record. A malformed head gives a row without an identifier ("head") and is
    skipped up to the next record; a truncated record is kept with what there is of it ("cut"); bytes that are
    no archive are "bytes". So damage can be counted, and never ends the job.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.where("length > 0").select("content").mapInArrow(_parse, RECORD_SCHEMA)


# ---------------------------------------------------------------- assembly


def assemble(records: DataFrame, keep_payload: bool = True) -> DataFrame:
    """One nested row per capture: (capture_id, capture_type, refers_to, response, requests, metadata).

    Request and metadata records meet their response or revisit in one shuffle on the identifier they are
    concurrent to; ``requests`` and ``metadata`` are arrays in order of record id. A record that points nowhere
    known gives a row without a response, so nothing is lost; of several responses of one identifier (copies of an
    archive) the least is kept. Records without any identifier, as damaged heads are, are left out.
    ``response`` has payload_bytes and payload_sha256 of the payload as read, and the payload itself where asked.
    """
    main = F.col("record_type").isin("response", "revisit")
    key = F.when(main, F.col("record_id")).otherwise(F.coalesce("concurrent_to", "record_id"))
    seen = F.when(F.col("payload").isNotNull(), F.octet_length("payload").cast("long")).alias("payload_bytes")
    fields = ["record_id", "record_type", "target_uri", "warc_date", "refers_to", "payload_digest", "head", "payload_bytes", "payload_sha256", "damage"]
    r = records.withColumn("payload_bytes", seen).withColumn("payload_sha256", F.sha2("payload", 256))
    response = F.struct(*fields, *(["payload"] if keep_payload else []))
    other = F.struct("record_id", "target_uri", "warc_date", "head", "fields", "damage")
    r = r.select(
        key.alias("capture_id"),
        F.when(main, response).alias("response"),
        F.when(F.col("record_type") == "request", other).alias("request"),
        F.when(F.col("record_type") == "metadata", other).alias("metadata"),
    ).where("capture_id IS NOT NULL")
    many = lambda c, name: F.array_sort(F.collect_set(c)).alias(name)
    g = r.groupBy("capture_id").agg(F.min("response").alias("response"), many("request", "requests"), many("metadata", "metadata"))
    return g.select("capture_id", F.col("response.record_type").alias("capture_type"), F.col("response.refers_to").alias("refers_to"), "response", "requests", "metadata")


def round_trip(pages: DataFrame, path: str | None = None, **kw) -> DataFrame:
    """Write the pages as archives, read these back and resolve revisits through the records they refer to.

    One row per page: (page_id, payload_bytes, payload_digest, record_type, refers_to). Equal rows each give one;
    pages that share an id are captures of their own, and those that share the smallest id and the payload are
    all responses. Null bodies are empty payloads, very long ones are one record, columns play no other part. A
    null id comes after all others. No pages, no rows.
    """
    spark = pages.sparkSession
    path = path or f"{scratch_root(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path, **kw)
    captures = assemble(read_archives(spark, path), keep_payload=False)
    page_id = F.regexp_extract(F.expr("metadata[0].fields"), r"(?m)^page_id: (-?\d+)\r?$", 1)
    c = captures.select(
        "capture_id",
        "capture_type",
        "refers_to",
        F.when(page_id != "", page_id.cast("long")).alias("page_id"),
        F.col("response.payload_bytes").alias("bytes"),
        F.col("response.payload_sha256").alias("sha"),
    )
    c = materialise(c, "captures")
    own, back = c.where("capture_type = 'response'"), c.where("capture_type = 'revisit'")
    asked = back.groupBy("refers_to").agg(F.count("*").alias("n"))
    origin = own.select(F.col("capture_id").alias("refers_to"), F.col("page_id").alias("opage"), F.col("bytes").alias("obytes"), F.col("sha").alias("osha"))
    origin = materialise(origin.join(asked, "refers_to"), "origins")
    back = spread_join(back, origin, ["refers_to"], ["capture_id"], "left")
    back = back.select("page_id", F.col("obytes").alias("payload_bytes"), F.col("osha").alias("payload_digest"), F.col("capture_type").alias("record_type"), F.col("opage").alias("refers_to"))
    own = own.select("page_id", F.col("bytes").alias("payload_bytes"), F.col("sha").alias("payload_digest"), F.col("capture_type").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    return own.unionByName(back)


def op6_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages"))


OP6_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
q AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN first_id END AS refers_to
FROM q
"""

QUERIES = {"op6_warc_round_trip": op6_warc_round_trip}
ORACLE_SQL = {"op6_warc_round_trip": OP6_SQL}
