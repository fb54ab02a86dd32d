"""WARC archives of pages: written once, indexed by record, and read back by byte ranges.

Method: index first. Each record has one row of index: archive, offset, length, URL and digest, and what kind of record it is. What is to
be read is chosen on the index alone; the chosen records of an archive are sorted by offset, neighbours are joined into one range where
little lies between them, and each range is one read. Records are gzip members of their own, so that a range can start at any of them.

Archives are written by tasks straight into the shared folder under names of their own, and only the index, written as a table, says
which of them count: what a lost or repeated task has left behind is in no index and is never read.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator, Sequence
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilspark.llm.common import durable, mapped, shared_folder

VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "archive string, offset long, length long, url string, digest string, record_type string, key string"
RECORD = "archive string, offset long, url string, record_type string, key string, refers_to string, payload_bytes long, digest string, payload binary"
#: Payloads of fewer bytes are always stored.
LEAST_BYTES = 100
ARCHIVE_BYTES = 256 << 20
GAP_BYTES, RANGE_BYTES, TASK_BYTES = 64 << 10, 8 << 20, 32 << 20
PIECE = 1 << 20
#: Names of the fields that WARC itself does not have: the page's key, and that of the page that a revisit points to.
KEY, REFERS_TO = "X-Record-Key", "X-Refers-To-Record-Key"


def _opened(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _uri(url: str) -> str:
    """Without bytes that would end a header line or part it."""
    return "".join(c if 0x20 < ord(c) != 0x7F else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def _record(fields: Sequence[tuple[str, str | None]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in (*fields, ("Content-Length", str(len(block)))) if v is not None)
    return b"".join((VERSION, b"\r\n", head.encode(), b"\r\n", block, b"\r\n\r\n"))


def _member(record: bytes) -> bytes:
    """One gzip member; the same bytes for the same record, whenever it is written."""
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress(record) + squeeze.flush()


class _Archives:
    """The archives of one task: a new one is begun when one is full."""

    def __init__(self, folder: str, most: int, date: str) -> None:
        self.folder, self.most, self.date, self.out, self.at = folder, most, date, None, 0

    def put(self, member: bytes) -> tuple[str, int]:
        """Archive and offset of what is written."""
        if self.out is not None and self.at + len(member) > self.most:
            self.close()
        if self.out is None:
            self.path = f"{self.folder}/{uuid.uuid4().hex}.warc.gz"
            system, place = _opened(self.path)
            system.create_dir(place.rpartition("/")[0], recursive=True)
            self.out, self.at = system.open_output_stream(place, compression=None), 0
            info = _record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", self.date), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
            self._write(_member(info))
        at = self.at
        self._write(member)
        return self.path, at

    def _write(self, member: bytes) -> None:
        self.out.write(member)
        self.at += len(member)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


def record_id(digest: str, archive: str) -> str:
    """The name of the response that holds a payload; of any other record, one of its own."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive}sha256:{digest}')}>"


def first_of_equals(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """pages(key, url, payload) with digest, bytes, and for pages with the payload of another one `first`, the smallest of their keys.

    Digests are counted before they are shuffled, and only those of several pages are kept; the table of these is written, so that a
    payload that a third of all pages share is a hot key of a join that Spark splits, not a group of one task.
    """
    marked = pages.withColumn("digest", F.sha2("payload", 256)).withColumn("bytes", F.length("payload").cast("long"))
    counted = marked.where(F.col("bytes") >= least).groupBy("digest").agg(F.min("key").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    return marked.join(durable(counted, "warc-first"), "digest", "left")


def write(pages: DataFrame, *, key: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST_BYTES, archive_bytes: int = ARCHIVE_BYTES, folder: str | None = None, date: datetime | None = None) -> DataFrame:
    """Writes one record per row of pages and returns the index, itself a table in the shared folder.

    The payload is the html in UTF-8 (null: empty), behind a plain HTTP header. Of pages with equal payloads of at least `least` bytes the
    one with the smallest key is the response and holds the payload; others are revisits that name it and hold the header alone. Rows that
    repeat the first page, key and payload, are responses each, as nothing tells them apart; a page without a key is a revisit if
    any page with one has its payload. Keys are compared by their own order and written as text. A URL's blanks and control characters
    are percent-encoded; a page without a URL has a record without one. Other columns, of whatever name, are not looked at.
    """
    spark = pages.sparkSession
    if folder is None:
        # A path without a scheme lies where Spark's own files do, not on each task's machine; Spark deletes it when the session ends.
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}")
        system = place.getFileSystem(spark._jsc.hadoopConfiguration())
        system.deleteOnExit(place)
        folder = re.sub("^file:/+", "file:///", system.makeQualified(place).toString())
    slim = pages.select(F.col(f"`{key}`").alias("key"), F.col(f"`{url}`").cast("string").alias("url"), F.coalesce(F.col(f"`{html}`").cast("string"), F.lit("")).cast("binary").alias("payload"))
    again = F.col("first").isNotNull() & ~F.col("key").eqNullSafe(F.col("first"))
    typed = first_of_equals(slim, least).select(F.col("key").cast("string").alias("key"), "url", "digest", "bytes", F.when(again, F.col("first").cast("string")).alias("refers_to"), again.alias("again"), F.when(~again, F.col("payload")).alias("payload"))
    stamp = (date or datetime.now(UTC)).strftime("%Y-%m-%dT%H:%M:%SZ")

    def run(batches):
        archives = _Archives(folder, archive_bytes, stamp)
        try:
            for batch in batches:
                rows = []
                for r in batch.to_pylist():
                    kind = "revisit" if r["again"] else "response"
                    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {r['bytes']}\r\n\r\n".encode() + (r["payload"] or b"")
                    target = None if r["url"] is None else _uri(r["url"])
                    shared = record_id(r["digest"], "")
                    fields = [
                        ("WARC-Type", kind), ("WARC-Record-ID", shared if not r["again"] and r["bytes"] >= least else f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", stamp), ("WARC-Target-URI", target),
                        ("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", f"sha256:{r['digest']}"), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
                        ("WARC-Profile", PROFILE if r["again"] else None), ("WARC-Refers-To", shared if r["again"] else None), (KEY, r["key"]), (REFERS_TO, r["refers_to"]),
                    ]
                    member = _member(_record(fields, block))
                    archive, at = archives.put(member)
                    rows.append((archive, at, len(member), target, r["digest"], kind, r["key"]))
                yield _batch(rows, INDEX)
        finally:
            archives.close()

    return durable(mapped(typed, run, INDEX), "warc-index")


_ARROW = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*[f.split() for f in schema.split(", ")], strict=True)
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[k]) for c, k in zip(columns, kinds, strict=True)], names=list(names))


def _parsed(record: bytes, where: str) -> tuple[dict[str, str], bytes]:
    """Named fields (names in small letters) and block of a record."""
    head, found, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    size = int(fields.get("content-length", -1))
    if not found or not lines[0].startswith("WARC/") or not 0 <= size <= len(rest):
        raise ValueError(f"no whole WARC record at {where}")
    return fields, rest[:size]


def _digest(fields: dict[str, str]) -> str | None:
    kind, _, value = fields.get("warc-payload-digest", "").partition(":")
    return value.lower() if kind.lower() == "sha256" else None


def _content(fields: dict[str, str], block: bytes) -> tuple[bytes, str]:
    """Payload of a block, and the HTTP header before it."""
    if fields.get("content-type", "").replace(" ", "").lower().startswith("application/http"):
        head, _, payload = block.partition(b"\r\n\r\n")
        return payload, head.decode("latin-1")
    return block, ""


def members(source, size: int, where: str) -> Iterator[tuple[int, int, bytes]]:
    """Offset, length and content of each gzip member of an archive that is read from its start, a piece at a time."""
    at = taken = 0
    rest = b""
    while at < size:
        expand, parts = zlib.decompressobj(31), []
        while not expand.eof:
            piece = rest or source.read(min(PIECE, size - taken))
            if not rest:
                taken += len(piece)
            if not piece:
                raise ValueError(f"archive {where} ends within the record at {at}")
            parts.append(expand.decompress(piece))
            rest = expand.unused_data
        yield at, taken - len(rest) - at, b"".join(parts)
        at = taken - len(rest)


def index(archives: DataFrame) -> DataFrame:
    """The index of archives(archive) that others have written, one gzip member per record; each archive is read once, by one task, record by record.

    Records other than responses and revisits (such as what an archive says of itself) are left out. The digest is the one that the record
    states if it is of SHA-256, else worked out from a payload that is there. An archive that is cut off or damaged is an error that names the
    place. No archives give no rows; an archive named twice is indexed twice.
    """

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, place = _opened(path)
                size, rows = system.get_file_info(place).size, []
                with system.open_input_stream(place, compression=None) as source:
                    for at, length, record in members(source, size, path):
                        fields, block = _parsed(record, f"{path}, {at}")
                        kind = fields.get("warc-type")
                        if kind not in ("response", "revisit"):
                            continue
                        digest = _digest(fields) or (hashlib.sha256(_content(fields, block)[0]).hexdigest() if kind == "response" else None)
                        rows.append((path, at, length, fields.get("warc-target-uri"), digest, kind, fields.get(KEY.lower())))
                        if len(rows) == 1000:
                            yield _batch(rows, INDEX)
                            rows = []
                yield _batch(rows, INDEX)

    return mapped(archives.select("archive").where("archive is not null"), run, INDEX)


def ranges(chosen: DataFrame, gap: int = GAP_BYTES, most: int = RANGE_BYTES) -> DataFrame:
    """Reads (archive, start, end, records) that fetch the chosen rows of an index: records(offset, length) sorted by offset.

    Records with at most `gap` bytes between them share a read, and a read ends with the record that begins before a multiple of `most`,
    so it has `most` bytes and one record at most. Archives are of bounded size, and so is what a window over one of them holds. A record
    that is chosen twice is read once and given out twice.
    """
    by = Window.partitionBy("archive").orderBy("offset", "length")
    before = F.max(F.col("offset") + F.col("length")).over(by.rowsBetween(Window.unboundedPreceding, -1))
    last = F.lag("offset").over(by)
    fresh = before.isNull() | (F.col("offset") - before > gap) | (F.floor(F.col("offset") / most) != F.floor(last / most))
    numbered = chosen.select("archive", "offset", "length").withColumn("_fresh", fresh).withColumn("_range", F.sum(F.col("_fresh").cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("archive", "_range").agg(F.min("offset").alias("start"), F.max(F.col("offset") + F.col("length")).alias("end"), F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("records")).drop("_range")


def read(chosen: DataFrame, *, gap: int = GAP_BYTES, range_bytes: int = RANGE_BYTES, payloads: bool = True) -> DataFrame:
    """The records of the chosen rows of an index, as RECORD says.

    Payloads are there for responses, if `payloads` asks for them; their bytes and digest are worked out from what was read and must equal
    what the record states, else the record's place is an error. For revisits both are what the record states of the page it
    points to. No rows chosen, no reads.
    """

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                system, place = _opened(r["archive"])
                with system.open_input_file(place) as source:
                    data = source.read_at(r["end"] - r["start"], r["start"])
                rows, held = [], 0
                for x in r["records"]:
                    where = f"{r['archive']}, {x['offset']}"
                    begin = x["offset"] - r["start"]
                    fields, block = _parsed(zlib.decompress(data[begin : begin + x["length"]], 31), where)
                    payload, head = _content(fields, block)
                    stated, revisit = _digest(fields), fields.get("warc-type") == "revisit"
                    if revisit:
                        sizes = [v for k, _, v in (line.partition(":") for line in head.split("\r\n")) if k.lower() == "content-length"]
                        size, digest = (int(sizes[0]) if sizes else None), stated
                    else:
                        size, digest = len(payload), hashlib.sha256(payload).hexdigest()
                        if stated not in (None, digest):
                            raise ValueError(f"the payload at {where} is not the one that was stored")
                    rows.append((r["archive"], x["offset"], fields.get("warc-target-uri"), fields.get("warc-type"), fields.get(KEY.lower()), fields.get(REFERS_TO.lower()), size, digest, payload if payloads and not revisit else None))
                    held += len(payload)
                    if held > PIECE:
                        yield _batch(rows, RECORD)
                        rows, held = [], 0
                yield _batch(rows, RECORD)

    # Rows of an index are few bytes that stand for many: reads are dealt out by the bytes that they fetch.
    spark = chosen.sparkSession
    fetched = chosen.agg(F.sum("length")).first()[0] or 0
    n = max(spark.sparkContext.defaultParallelism, -(-fetched // TASK_BYTES))
    return mapped(ranges(chosen, gap, range_bytes).repartition(n, "archive", "start"), run, RECORD)


def payloads(found: DataFrame, whole: DataFrame, **how) -> DataFrame:
    """Digest and payload once for each record of an index `found`, revisits too: the responses that hold them are looked up in the whole index by digest and read."""
    wanted = found.select("digest").where("digest is not null").distinct()
    holders = whole.where("record_type = 'response'").groupBy("digest").agg(F.min(F.struct("archive", "offset", "length")).alias("at")).join(wanted, "digest", "left_semi")
    return read(holders.select("at.*"), **how).select("digest", "payload")
