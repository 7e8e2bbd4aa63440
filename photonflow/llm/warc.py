"""WARC archives as a Spark data source: registered as "warc", for reading with header-first scans and for writing."""

from __future__ import annotations

import gzip
import io
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage

from photonflow.llm.common import only, shared_path

COLUMNS = ("record_id", "type", "target_uri", "refers_to", "payload_digest", "payload_bytes", "payload")
SCHEMA = "record_id string, type string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"
HEADERS = {b"warc-record-id": "record_id", b"warc-type": "type", b"warc-target-uri": "target_uri", b"warc-refers-to": "refers_to", b"warc-payload-digest": "payload_digest"}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
#: Files are gathered into read partitions of about so many bytes, and decompressed so many at a time.
SPLIT = 64 << 20
BLOCK = 1 << 18


def _clean(value: str) -> str:
    """A header's value; line ends would end the header."""
    return " ".join(value.split("\r")).replace("\n", " ")


def record(row: dict) -> bytes:
    """One WARC/1.1 record. Responses hold an HTTP envelope and the payload; revisits hold the envelope alone."""
    payload = row["payload"] or b""
    size = row["payload_bytes"] if row["payload_bytes"] is not None else len(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if row["type"] == "revisit" else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {row['type']}", f"WARC-Record-ID: <{_clean(row['record_id'])}>", f"WARC-Date: {DATE}"]
    if row["target_uri"] is not None:
        lines.append(f"WARC-Target-URI: {_clean(row['target_uri'])}")
    if row["payload_digest"] is not None:
        lines.append(f"WARC-Payload-Digest: sha256:{row['payload_digest']}")
    if row["refers_to"] is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{_clean(row['refers_to'])}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


@dataclass
class Written(WriterCommitMessage):
    part: str
    name: str


class WarcWriter(DataSourceArrowWriter):
    """A file a task, compressed record by record; files get their names only when the whole job commits."""

    def __init__(self, path: str, compress: bool):
        self.path, self.compress = path, compress

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = pafs.FileSystem.from_uri(self.path)
        name = f"{uuid.uuid4().hex}.warc" + ".gz" * self.compress
        fs.create_dir(f"{root}/_pending", recursive=True)
        with fs.open_output_stream(f"{root}/_pending/{name}", compression=None) as out:
            for batch in iterator:
                for i in range(0, len(batch), 64):
                    for row in batch.slice(i, 64).to_pylist():
                        data = record(row)
                        out.write(gzip.compress(data, 1, mtime=0) if self.compress else data)
        return Written(f"{root}/_pending/{name}", f"{root}/{name}")

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = pafs.FileSystem.from_uri(self.path)
        for m in filter(None, messages):
            fs.move(m.part, m.name)
        if fs.get_file_info(f"{root}/_pending").type == pafs.FileType.Directory:
            fs.delete_dir(f"{root}/_pending")  # what is left there comes from failed attempts

    def abort(self, messages: list[Written | None]) -> None:
        fs, _ = pafs.FileSystem.from_uri(self.path)
        for m in filter(None, messages):
            fs.delete_file(m.part)


class Source:
    """Bytes of a file, inflated if they are gzip members, by line or by length; skipped bytes are never joined up."""

    def __init__(self, raw):
        self.raw, self.rest, self.done = raw, b"", False
        head = raw.read(2)
        self.zip = head == b"\x1f\x8b"
        self.pending = head
        self.inflate = zlib.decompressobj(31)

    def _more(self) -> bytes:
        while True:
            data = self.pending or self.raw.read(BLOCK)
            self.pending = b""
            if not data:
                self.done = True
                return b""
            if not self.zip:
                return data
            out = self.inflate.decompress(data, 4 * BLOCK)
            if self.inflate.eof:
                self.pending = self.inflate.unused_data
                self.inflate = zlib.decompressobj(31)
            else:
                self.pending = self.inflate.unconsumed_tail
            if out:
                return out

    def head(self) -> bytes | None:
        """The next record's header block; None at the end."""
        while True:
            self.rest = self.rest.lstrip(b"\r\n")
            at = self.rest.find(b"\r\n\r\n")
            if at >= 0:
                out, self.rest = self.rest[:at], self.rest[at + 4 :]
                return out
            more = self._more()
            if not more:
                return None
            self.rest += more

    def take(self, n: int) -> bytes:
        parts, size = [self.rest], len(self.rest)
        while size < n and (more := self._more()):
            parts.append(more)
            size += len(more)
        data = b"".join(parts)
        self.rest = data[n:]
        return data[:n]

    def skip(self, n: int) -> None:
        while len(self.rest) < n:
            n -= len(self.rest)
            self.rest = b""
            if not self.zip and not self.pending and n > BLOCK and self.raw.seekable():
                self.raw.seek(n, io.SEEK_CUR)
                return
            self.rest = self._more()
            if not self.rest:
                return
        self.rest = self.rest[n:]


def headers(block: bytes) -> tuple[dict[str, str], int]:
    """The columns that a header block gives, and the length of what follows it."""
    lines = block.split(b"\r\n")
    if not lines[0].startswith(b"WARC/"):
        raise ValueError(f"no WARC record: {lines[0][:60]!r}")
    found: dict[str, str] = {}
    size = 0
    for line in lines[1:]:
        key, _, value = line.partition(b":")
        key, value = key.strip().lower(), value.strip()
        if key == b"content-length":
            size = int(value)
        elif name := HEADERS.get(key):
            text = value.decode("utf-8", "replace")
            found[name] = text[1:-1] if name in ("record_id", "refers_to") and text[:1] == "<" else text.removeprefix("sha256:") if name == "payload_digest" else text
    return found, size


def read_records(raw, wanted, payload: bool) -> Iterator[tuple]:
    source = Source(raw)
    while (block := source.head()) is not None:
        found, size = headers(block)
        if not wanted(found):
            source.skip(size)
            continue
        if not payload:
            start = source.take(min(size, 4096))
            source.skip(size - len(start))
        else:
            start = source.take(size)
        envelope, sep, body = start.partition(b"\r\n\r\n") if start.startswith(b"HTTP/") else (b"", b"", start)
        length = next((int(x.partition(b":")[2]) for x in envelope.lower().split(b"\r\n") if x.startswith(b"content-length:")), size - len(envelope) - len(sep))
        yield (*(found.get(c) for c in COLUMNS[:5]), length, body if payload and found.get("type") != "revisit" else None)


@dataclass
class Files(InputPartition):
    paths: tuple[str, ...]


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: bool, split: int):
        self.path, self.payload, self.split = path, payload, split
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters):
        """Equality, IN, prefix and presence of any header column; null never equals, so these may decide alone."""
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column not in COLUMNS[:5]:
                yield f
            elif isinstance(f, (EqualTo, EqualNullSafe)) and f.value is not None:
                self.tests.append((column, "in", (f.value,)))
            elif isinstance(f, In):
                self.tests.append((column, "in", tuple(v for v in f.value if v is not None)))
            elif isinstance(f, StringStartsWith):
                self.tests.append((column, "prefix", f.value))
            elif isinstance(f, IsNotNull):
                self.tests.append((column, "any", None))
            else:
                yield f

    def wanted(self, found: dict[str, str]) -> bool:
        for column, how, value in self.tests:
            got = found.get(column)
            if got is None or (how == "in" and got not in value) or (how == "prefix" and not got.startswith(value)):
                return False
        return True

    def partitions(self) -> list[Files]:
        fs, root = pafs.FileSystem.from_uri(self.path)
        info = fs.get_file_info(root)
        found = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(root, recursive=False))
        found = [x for x in found if x.type == pafs.FileType.File and x.path.endswith((".warc", ".warc.gz"))]
        out: list[list[str]] = []
        room = 0
        for x in sorted(found, key=lambda x: x.path):
            if not out or x.size > room:
                out.append([])
                room = self.split
            out[-1].append(x.path)
            room -= x.size
        return [Files(tuple(p)) for p in out]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(self.path)
        rows: list[tuple] = []
        size = 0
        for path in partition.paths:
            with fs.open_input_file(path) as raw:
                for row in read_records(raw, self.wanted, self.payload):
                    rows.append(row)
                    size += 200 + len(row[6] or b"")
                    if size > 8 << 20:
                        yield self._batch(rows)
                        rows, size = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string()] * 5 + [pa.int64(), pa.binary()]
        return pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=list(COLUMNS))


class WarcDataSource(DataSource):
    """Options: path (file or folder), payload ("false": headers alone), splitBytes, compression ("gzip" or "none").

    Archives need a store that pyarrow.fs opens by its URI on every node (a mounted folder, hdfs, s3, gs).
    """

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], self.options.get("payload", "true").lower() == "true", int(self.options.get("splitBytes", SPLIT)))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], self.options.get("compression", "gzip") == "gzip")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def write_archives(records: DataFrame, path: str, compression: str = "gzip") -> None:
    """Write records (the columns of SCHEMA, by name) to a new folder of archives."""
    register(records.sparkSession)
    only(records, *COLUMNS).write.format("warc").option("compression", compression).mode("append").save(path)


def read_archives(spark: SparkSession, path: str, payload: bool = True, split: int = SPLIT) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).option("splitBytes", split).load(path)


def page_records(pages: DataFrame, least: int = 100) -> DataFrame:
    """Records of pages (page_id, url, html), one for each row; null html counts as empty.

    Of rows with equal payloads of at least `least` bytes, those with the smallest page_id are responses and the others
    revisit it. A row with a null page_id (or one that is no whole number) is a response and is never referred to. Payloads are dealt by page, so that
    a group of many copies meets nowhere; what is grouped by digest are digests.
    """
    spread = pages.select(F.col("page_id").try_cast("long").alias("page_id"), F.col("url").cast("string").alias("target_uri"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"))
    spread = spread.withColumns({"payload_digest": F.sha2("payload", 256), "payload_bytes": F.octet_length("payload").cast("long")})
    marks = spread.where(F.col("payload_bytes") >= least).select("page_id", "payload_digest")
    first = marks.groupBy("payload_digest").agg(F.min("page_id").alias("first"))
    again = marks.join(first, "payload_digest").where("page_id > first").distinct()
    out = spread.join(again, ["page_id", "payload_digest"], "left")
    revisit = F.col("first").isNotNull()
    urn = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")))
    return out.select(
        urn("page_id").alias("record_id"), F.when(revisit, "revisit").otherwise("response").alias("type"), "target_uri",
        F.when(revisit, urn("first")).alias("refers_to"), "payload_digest", "payload_bytes", F.when(~revisit, F.col("payload")).alias("payload"),
    )


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages' archives to the shared folder, read them back, and tell of each page what they hold.

    page_id, payload_bytes, payload_digest, record_type, refers_to. Of responses, size and digest are those of the
    payload that was read; of revisits, those in the headers. An empty table gives no rows.
    """
    spark = pages.sparkSession
    path = shared_path(spark, "warc")
    write_archives(page_records(pages), path)
    number = lambda c: F.expr(f"try_cast(substring({c}, 10) as bigint)")
    back = read_archives(spark, path, split=8 << 20)
    whole = F.col("payload").isNotNull()
    return back.select(
        number("record_id").alias("page_id"), F.when(whole, F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(whole, F.sha2("payload", 256)).otherwise(F.col("payload_digest")).alias("payload_digest"), F.col("type").alias("record_type"), number("refers_to").alias("refers_to"),
    )


SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to
FROM f
"""
