"""Operator 7: WARC archives as a Python data source.

``df.write.format("warc")`` writes files of WARC/1.1 records; ``spark.read.format("warc")`` reads them, and any others: ``*.warc``, one stretch a file, and ``*.warc.gz``, whose members are inflated one by one. A written record's block is an HTTP
response whose body is deflated; a revisit has no body and names the record that it refers to. The writer closes a file at ``fileBytes`` and keeps places
every ``splitBytes``; its commit puts the list of them beside the files. Where a folder has such lists, files with the writer's names that none of them names are of failed attempts and aren't read. The
reader plans one partition for each stretch of a file. Comparisons of warc_type, page_id, target_uri, refers_to, payload_digest and
payload_length with constants are pushed into the reader: it parses a record's head first and, if the record isn't wanted, steps over the block
by its length. With option ``payload`` = ``false`` no block is read but of records whose heads lack digest or length.

Records as rows. payload is the body of an HTTP response (transfer and content codings undone: chunked, gzip, deflate), the whole block of other records, null for revisits and in ``payload`` = ``false``. page_id and refers_to are those of
this writer, else null; payload_digest is bare lower-case hex of SHA-1 (base32 in heads is converted; other kinds of digests are given as they are), payload_length the payload's bytes; both are computed if the head lacks them and, for revisits, null.
Heads without WARC-Type give a null type. A record cut off at a file's end is left out. A very long payload is held whole by its task.

Results of ``archive``: null html counts as empty. Payloads are equal by SHA-256 and length. Rows that repeat the largest page_id of their group
are all responses; a null page_id is the smallest. Other columns are not read; an empty table writes no file.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import re
import uuid
import zlib
from dataclasses import dataclass
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, WriterCommitMessage

from .files import listed, open_input, open_output, read_bytes, write_bytes
from .shared import shared_folder, written

SCHEMA = "warc_type string, page_id long, target_uri string, refers_to long, payload_digest string, payload_length long, payload binary"
INPUT = "page_id long, url string, payload binary, payload_digest string, record_type string, refers_to long"
_ARROW = pa.schema([("warc_type", pa.string()), ("page_id", pa.int64()), ("target_uri", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_length", pa.int64()), ("payload", pa.binary())])
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Encoding: deflate\r\n\r\n"
_URN = "urn:page:"
#: Rows in a batch that the reader hands to Spark, and bytes of payload after which it hands one over sooner.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


def _line(value: str) -> str:
    """A head's value keeps to one line; what can't be in one is percent-encoded."""
    return "".join(c if " " < c < "\x7f" and c != "%" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in value)


def _unline(value: str) -> str:
    from urllib.parse import unquote

    return unquote(value)


def _record_id(page_id, digest: str) -> str:
    """The same for all that refer to a page's response."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{_URN}{page_id}:{digest}')}>"


def record(page_id, url, payload: bytes, digest: str, kind: str, refers_to, date: str) -> bytes:
    block = b"" if kind == "revisit" else _HTTP + zlib.compress(payload, 1)
    own = f"<urn:uuid:{uuid.uuid4()}>" if kind == "revisit" or page_id is None else _record_id(page_id, digest)
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {own}", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if page_id is not None:
        head.append(f"X-Page-ID: {_URN}{page_id}")
    if url is not None:
        head.append(f"WARC-Target-URI: {_line(url)}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: {_record_id(refers_to, digest)}", f"X-Refers-To-Page: {_URN}{refers_to}"]
    if kind == "revisit":
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


@dataclass
class Stretch(InputPartition):
    path: str
    start: int
    end: int

    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


@dataclass
class Files(WriterCommitMessage):
    files: list


class WarcWriter(DataSourceWriter):
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.file_bytes, self.split_bytes = int(options.get("fileBytes", 256 << 20)), int(options.get("splitBytes", 16 << 20))
        self.date = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def write(self, rows) -> Files:
        files, out, path, at, places = [], None, "", 0, []

        def close():
            if out is not None:
                out.close()
                files.append([path, [*places, at]])

        for r in rows:
            if out is None or at >= self.file_bytes:
                close()
                path, at, places = f"{self.folder}/part-{uuid.uuid4().hex}.warc", 0, [0]
                out = open_output(path)
            data = record(r.page_id, r.url, bytes(r.payload or b""), r.payload_digest, r.record_type, r.refers_to, self.date)
            if at - places[-1] >= self.split_bytes:
                places.append(at)
            out.write(data)
            at += len(data)
        close()
        return Files(files)

    def commit(self, messages) -> None:
        found = [f for m in messages if m is not None for f in m.files]
        write_bytes(f"{self.folder}/list-{uuid.uuid4().hex}.json", [json.dumps(found).encode()])

    def abort(self, messages) -> None:
        pass  # what isn't listed isn't read


_COMPARE = {EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, In: lambda a, b: a in b}
_COMPARE_NAMES = {k.__name__: f for k, f in _COMPARE.items()}


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.payload = options.get("payload", "true").lower() == "true"
        self.wanted: list[tuple[str, str, object]] = []

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if len(f.attribute) == 1 else None
            if column in _ARROW.names[:-1] and type(f) in _COMPARE:
                self.wanted.append((type(f).__name__, column, f.value))
            elif column in _ARROW.names[:-1] and isinstance(f, IsNotNull | IsNull):
                self.wanted.append((type(f).__name__, column, None))
            else:
                yield f

    def _keeps(self, row: dict, unknown: tuple = ()) -> bool:
        for kind, column, value in self.wanted:
            if column in unknown:
                continue
            own = row[column]
            if kind in ("IsNull", "IsNotNull"):
                if (own is None) != (kind == "IsNull"):
                    return False
            elif own is None or not _COMPARE_NAMES[kind](own, value):
                return False
        return True

    def partitions(self):
        names = listed(self.folder)
        lists = [n for n in names if _OWN_LIST.search(n)]
        out = [Stretch(path, a, b) for n in lists for path, places in json.loads(read_bytes(n)) for a, b in zip(places, places[1:])]
        out += [Stretch(n, 0, -1) for n in names if n.endswith((".warc", ".warc.gz")) and not (lists and _OWN_FILE.search(n))]
        return out or [Stretch("", 0, 0)]

    def read(self, partition):
        if not partition.path:
            return
        rows, held = [], 0
        with open_input(partition.path) as raw:
            gz = partition.path.endswith(".gz")
            if not gz:
                raw.seek(partition.start)
            data = io.BufferedReader(_Members(raw) if gz else _Raw(raw), 1 << 20)
            for row in self._records(data, partition.start, partition.end, gz):
                rows.append(row)
                held += len(row["payload"] or b"")
                if len(rows) >= BATCH_ROWS or held >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, _ARROW)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _ARROW)

    def _records(self, data, at: int, end: int, gz: bool):
        """The wanted records from a record's start on, up to ``end`` (-1: the file's)."""
        while end < 0 or at < end:
            line = data.readline()
            while line in (b"\r\n", b"\n"):  # between records
                at += len(line)
                line = data.readline()
            if not line.startswith(b"WARC/"):
                return
            head, size = {}, len(line)
            while (line := data.readline()) not in (b"\r\n", b"\n", b""):
                size += len(line)
                k, _, v = line.partition(b":")
                head[k.strip().lower()] = v.strip().decode("utf-8", "replace")
            length = int(head.get(b"content-length", 0))
            at += size + len(line) + length
            row, whole = self._row(head), None
            unknown = () if row["warc_type"] == "revisit" else tuple(c for c in ("payload_digest", "payload_length") if row[c] is None)
            keep = self._keeps(row, unknown)  # by the head alone
            if keep and (unknown or self.payload and row["warc_type"] != "revisit"):
                if len(whole := data.read(length)) < length:
                    return
                payload = _payload(whole, head)
                if unknown:
                    row["payload_digest"], row["payload_length"] = row["payload_digest"] or hashlib.sha1(payload).hexdigest(), len(payload)
                    keep = self._keeps(row)
                row["payload"] = payload if self.payload else None
            elif gz:
                passed = sum(len(data.read(min(1 << 20, length - i))) for i in range(0, length, 1 << 20))
                keep = keep and passed == length
            else:
                keep = keep and (end >= 0 or self._holds(data, length))
                data.seek(length, io.SEEK_CUR)
            if keep:
                yield row

    @staticmethod
    def _holds(data, length: int) -> bool:
        """Whether a file has so many bytes more; the place stays."""
        at = data.tell()
        whole = data.seek(0, io.SEEK_END) >= at + length
        data.seek(at)
        return whole

    @staticmethod
    def _row(head: dict) -> dict:
        page, to, uri, size = head.get(b"x-page-id"), head.get(b"x-refers-to-page"), head.get(b"warc-target-uri"), head.get(b"x-payload-length")
        own = size is not None
        return {
            "warc_type": head.get(b"warc-type"), "page_id": int(page[len(_URN) :]) if page else None, "target_uri": None if uri is None else _unline(uri) if own else uri.strip("<>"), "refers_to": int(to[len(_URN) :]) if to else None,
            "payload_digest": _digest(head.get(b"warc-payload-digest")), "payload_length": int(size) if own else None, "payload": None,
        }


_OWN_LIST, _OWN_FILE = re.compile(r"(^|/)list-[0-9a-f]{32}\.json$"), re.compile(r"(^|/)part-[0-9a-f]{32}\.warc(\.part)?$")


def _digest(value: str | None) -> str | None:
    """A head's digest: SHA-1 as bare hex."""
    kind, _, rest = (value or "").partition(":")
    if kind.lower() != "sha1":
        return value or None
    return base64.b32decode(rest.upper()).hex() if len(rest) == 32 else rest.lower()


def _payload(block: bytes, head: dict) -> bytes:
    """The body of an HTTP response, codings undone; the block of anything else."""
    if "http" not in head.get(b"content-type", "") or not block.startswith(b"HTTP/") or head.get(b"warc-type") not in ("response", "revisit"):
        return block
    fields, gap, body = block.partition(b"\r\n\r\n")
    named = {k.strip().lower(): v.strip().lower() for k, _, v in (x.partition(b":") for x in fields.split(b"\r\n")[1:])}
    if b"chunked" in named.get(b"transfer-encoding", b""):
        body = _unchunked(body)
    coding = named.get(b"content-encoding", b"")
    try:
        if coding in (b"gzip", b"x-gzip"):
            return zlib.decompress(body, 31)
        if coding == b"deflate":
            return zlib.decompress(body, 15 if body[:1] and body[0] & 15 == 8 else -15)
    except zlib.error:
        pass  # a body whose coding is not as said is given as it is
    return body


def _unchunked(body: bytes) -> bytes:
    out, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0:
        try:
            size = int(body[at:end].split(b";")[0], 16)
        except ValueError:
            return body if not out else b"".join(out)
        if not size:
            break
        out.append(body[end + 2 : end + 2 + size])
        at = end + 4 + size
    return b"".join(out)


class _Members(io.RawIOBase):
    """The members of a gzip file one after the other, inflated as they are read."""

    def __init__(self, file):
        self.file, self.inflater, self.rest = file, None, b""

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        while True:
            self.rest = self.rest or self.file.read(1 << 20)
            if not self.rest and (self.inflater is None or not self.inflater.unconsumed_tail):
                return 0
            if self.inflater is None:
                self.rest = self.rest.lstrip(b"\0")
                if not self.rest:
                    continue
                self.inflater = zlib.decompressobj(31)
            data = self.inflater.decompress(self.rest, len(buffer))
            if self.inflater.eof:
                self.rest, self.inflater = self.inflater.unused_data, None
            else:
                self.rest = self.inflater.unconsumed_tail
            if data:
                buffer[: len(data)] = data
                return len(data)


class _Raw(io.RawIOBase):
    """A pyarrow file as a raw stream, so that reading ahead is buffered and a skipped block is sought past."""

    def __init__(self, file):
        self.file = file

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def seek(self, offset: int, whence: int = 0) -> int:
        return self.file.seek(offset, whence)

    def tell(self) -> int:
        return self.file.tell()

    def readinto(self, buffer) -> int:
        data = self.file.read(len(buffer))
        buffer[: len(data)] = data
        return len(data)


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


#: Groups of equal payloads up to which their table is broadcast (about 60 bytes each); beyond it, the join shuffles.
BROADCAST_GROUPS = 100_000


def with_record_types(pages: DataFrame, least: int = 1000, broadcast_groups: int = BROADCAST_GROUPS) -> DataFrame:
    """page_id, url, payload, payload_digest, record_type, refers_to: the records to write."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    src = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), payload.alias("payload"))
    key = F.concat(F.sha2("payload", 256), F.lit(":"), F.octet_length("payload"))
    groups = src.where(F.octet_length("payload") >= least).groupBy(key.alias("_key")).agg(F.max("page_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1").select("_key", "_first")
    groups = written(groups, "payload_groups")
    if groups.count() <= broadcast_groups:
        groups = F.broadcast(groups)
    out = src.withColumn("_key", F.when(F.octet_length("payload") >= least, key)).join(groups, "_key", "left")
    revisit = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return out.select("page_id", "url", "payload", F.sha1("payload").alias("payload_digest"), F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("_first")).alias("refers_to"))


def write_archive(records: DataFrame, folder: str, **options) -> None:
    register(records.sparkSession)
    records.write.format("warc").options(**options).mode("append").save(folder)


def read_archive(spark: SparkSession, folder: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(folder)


def archive(pages: DataFrame, least: int = 1000) -> DataFrame:
    """Write all pages to archives and read them back: responses with their payloads, revisits by their heads alone."""
    spark = pages.sparkSession
    folder = f"{shared_folder(spark)}/warc"
    write_archive(with_record_types(pages, least), folder)
    full = read_archive(spark, folder).where("warc_type = 'response'")
    heads = read_archive(spark, folder, payload=False).where("warc_type = 'revisit'")
    body = F.coalesce(F.col("payload"), F.lit(b""))
    out = full.select("page_id", F.octet_length(body).cast("long").alias("payload_bytes"), F.sha1(body).alias("payload_digest"), F.col("warc_type").alias("record_type"), "refers_to")
    return out.unionByName(heads.select("page_id", F.col("payload_length").alias("payload_bytes"), "payload_digest", F.col("warc_type").alias("record_type"), "refers_to"))
