"""WARC archives as a PySpark data source (operator 2).

``spark.read.format("warc").load(folder)`` and ``df.write.format("warc")``:

* planning lists the folder's files - those that the manifests of this source name, or
  every ``*.warc.gz`` and ``*.warc`` where there is none (a folder without any is an error),
  or the one file that the path names - and packs them into partitions of ``partitionBytes`` (files are written no larger than
  ``fileBytes``, so a partition's size does not grow with the archive);
* equality, ``IN`` and null tests on ``record_type``, ``record_id``,
  ``refers_to``, ``payload_digest`` and ``target_uri`` are pushed into the
  reader, which parses a record's headers first and skips the payload of records that
  fail them: a member of this source tells its length, so the reader seeks past it;
* option ``payload=false`` leaves every payload unread as well (the column is
  null), for jobs that need headers only.

Files are gzip with one member a record.  Paths go through ``pyarrow.fs``
(local, HDFS, S3, GCS).  A write task streams into files of its own attempt;
commit renames nothing: the names of the files that count are written to
``_manifest`` files, one for a commit, so files of failed or doubled attempts
are never read.

:func:`archive_records` turns pages into records: of equal payloads of at
least ``min_bytes`` the one with the largest page id is a ``response``, the
others are ``revisit`` records without payload that refer to it.

Edge cases: a null payload is empty; a null page id counts as the smallest and
is written as an empty id; repeated rows with the largest id of their payload
are all responses; ids and URIs lose line breaks; an empty table makes an
archive without records.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In,
                                    InputPartition, IsNotNull, IsNull, WriterCommitMessage)

from cohortlab.llm._tables import stage

SCHEMA = ("record_id string, record_type string, target_uri string, warc_date string, content_type string, "
          "payload_digest string, payload_bytes long, refers_to string, payload binary")
#: WARC header of each column; the payload's length is an extension field,
#: since a revisit has no payload of its own to measure.
HEADERS = {"record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI",
           "warc_date": "WARC-Date", "content_type": "Content-Type", "payload_digest": "WARC-Payload-Digest",
           "payload_bytes": "WARC-Payload-Length", "refers_to": "WARC-Refers-To"}
PUSHED = ("record_type", "record_id", "refers_to", "payload_digest", "target_uri")
ENDING = ".warc.gz"
ENDINGS = (ENDING, ".warc")
#: Fixed value: the profile that the format names for revisits of equal payloads.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNK = 1 << 18
BATCH_BYTES = 8 << 20


def _fs(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


# -- bytes of a record ---------------------------------------------------------------------

def record_bytes(row: dict) -> bytes:
    """One WARC record: version line, headers, blank line, block, two line breaks."""
    payload = row.get("payload") or b""
    lines = ["WARC/1.1"]
    for column, name in HEADERS.items():
        value = row.get(column)
        if value is not None:
            lines.append(f"{name}: " + str(value).replace("\r", " ").replace("\n", " "))
    if row.get("record_type") == "revisit":
        lines.append(f"WARC-Profile: {REVISIT_PROFILE}")
    lines.append(f"Content-Length: {len(payload)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse_headers(block: bytes) -> dict[str, str]:
    out = {}
    text = re.sub(r"\r\n[\x20\t]+", " ", block.decode("utf-8", "replace"))       # continuation lines
    for line in text.split("\r\n")[1:]:
        name, sep, value = line.partition(":")
        if sep:
            out[name.strip().lower()] = value.strip()
    return out


def member(data: bytes, head: int, level: int) -> bytes:
    """``data`` as one gzip member whose extra field holds the member's length; the first
    ``head`` bytes (a record's headers) are flushed apart, so that they inflate alone."""
    pack = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = pack.compress(data[:head]) + pack.flush(zlib.Z_SYNC_FLUSH) + pack.compress(data[head:]) + pack.flush()
    extra = MARK + (8).to_bytes(2, "little") + (12 + 12 + len(body) + 8).to_bytes(8, "little")
    start = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + len(extra).to_bytes(2, "little") + extra
    return start + body + zlib.crc32(data).to_bytes(4, "little") + (len(data) & 0xFFFFFFFF).to_bytes(4, "little")


MARK = b"WL"                  # extra field of a member that tells its length (8 bytes)
INFLATED = 1 << 16            # bytes that are inflated at a time


class RecordStream:
    """Records of one file, headers first; plain or gzip.

    Reads ``CHUNK`` bytes and inflates ``INFLATED`` bytes at a time.  A block that is not
    wanted is left where its member ends, if the member tells its length; members that do not
    are inflated to their end.  ``inflated`` counts the bytes.
    """

    def __init__(self, stream):
        self.stream, self.rest, self.data, self.inflated = stream, b"", bytearray(), 0
        self.at = 0                                # place of ``rest`` in the file
        self.plain = self._peek(2) != b"\x1f\x8b"
        self.inflate, self.end = None, None        # the open member and its end, if known

    def _peek(self, n: int) -> bytes:
        while len(self.rest) < n and (raw := self.stream.read(CHUNK)):
            self.rest += raw
        return self.rest[:n]

    def _take(self, n: int) -> bytes:
        taken, self.rest = self.rest[:n], self.rest[n:]
        self.at += len(taken)
        return taken

    def _more(self) -> bool:
        if self.plain:
            self._peek(1)
            got = self._take(INFLATED)
            self.data += got
            return bool(got)
        while True:
            if self.inflate is None:
                head = self._peek(24)
                if not head:
                    return False
                known = head[:4] == b"\x1f\x8b\x08\x04" and head[12:16] == MARK + b"\x08\0"
                self.end = self.at + int.from_bytes(head[16:24], "little") if known else None
                self.inflate = zlib.decompressobj(31)
            if not self._peek(1):
                return False
            raw = self._take(len(self.rest))
            got = self.inflate.decompress(raw, INFLATED)
            left = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
            self.rest = left + self.rest
            self.at -= len(left)
            if self.inflate.eof:
                self.inflate = None
            if got:
                self.data += got
                self.inflated += len(got)
                return True

    def headers(self) -> dict[str, str] | None:
        """The next record's headers, or None at the end."""
        while (end := self.data.find(b"\r\n\r\n")) < 0:
            if not self._more():
                if self.data.strip():
                    raise ValueError("WARC file ends within a record's headers")
                return None
        found = parse_headers(bytes(self.data[:end]))
        del self.data[:end + 4]
        self.left = int(found.get("content-length", 0)) + 4
        return found

    def payload(self) -> bytes:
        """The block that follows, whole."""
        while len(self.data) < self.left:
            if not self._more():
                raise ValueError("WARC file ends within a record's block")
        block = bytes(self.data[:self.left - 4])
        del self.data[:self.left]
        return block

    def skip(self) -> None:
        """Pass over the block without keeping it; without inflating it if its member tells its end."""
        if self.inflate is not None and self.end is not None:
            self.data.clear()
            if self.end > self.at + len(self.rest):
                self.stream.seek(self.end)
                self.rest = b""
            else:
                self.rest = self.rest[self.end - self.at:]
            self.at, self.inflate = self.end, None
            return
        while len(self.data) < self.left:
            self.left -= len(self.data)
            self.data.clear()
            if not self._more():
                raise ValueError("WARC file ends within a record's block")
        del self.data[:self.left]


# -- reading -------------------------------------------------------------------------------

@dataclass
class FilePack(InputPartition):
    files: list[str] = field(default_factory=list)


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.with_payload = options.get("payload", "true").lower() != "false"
        self.partition_bytes = int(options.get("partitionbytes", options.get("partitionBytes", 32 << 20)))
        self.tests: list[tuple[str, tuple | None, bool]] = []     # column, allowed values, may it be null

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            name = f.attribute[0] if len(f.attribute) == 1 else None
            if name not in PUSHED:
                yield f
            elif isinstance(f, EqualTo):
                self.tests.append((name, (f.value,), False))
            elif isinstance(f, In):
                self.tests.append((name, tuple(f.value), False))
            elif isinstance(f, IsNotNull):
                self.tests.append((name, None, False))
            elif isinstance(f, IsNull):
                self.tests.append((name, (), True))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        fs, top = _fs(self.path)
        own = fs.get_file_info(top)
        if own.type == pafs.FileType.File:
            return [FilePack([own.path])]
        found = fs.get_file_info(pafs.FileSelector(top, allow_not_found=False))
        manifests = [x for x in found if x.base_name.startswith("_manifest")]
        counted: set[str] = set()
        for x in manifests:
            with fs.open_input_stream(x.path) as s:
                counted.update(s.read().decode().split())
        if not manifests:                  # not written by this source: every archive counts
            counted = {x.base_name for x in found if x.base_name.endswith(ENDINGS)}
            if not counted:
                raise FileNotFoundError(f"no WARC files in {self.path}")
        packs, size = [FilePack()], 0
        for x in sorted(found, key=lambda x: x.base_name):
            if x.base_name in counted:
                if packs[-1].files and size + x.size > self.partition_bytes:
                    packs.append(FilePack())
                    size = 0
                packs[-1].files.append(x.path)
                size += x.size
        return packs

    def wanted(self, row: dict) -> bool:
        for name, allowed, null in self.tests:
            value = row[name]
            if value is None:
                if not null:
                    return False
            elif allowed is not None and value not in allowed:
                return False
        return True

    def read(self, partition: FilePack) -> Iterator[pa.RecordBatch]:
        fs, _ = _fs(self.path)
        schema = pa.schema([(c, pa.int64() if c == "payload_bytes" else pa.string()) for c in HEADERS]
                           + [("payload", pa.binary())])
        rows, held = [], 0
        for name in partition.files:
            with fs.open_input_file(name) as stream:
                records = RecordStream(stream)
                while (found := records.headers()) is not None:
                    row = {c: found.get(h.lower()) for c, h in HEADERS.items()}
                    row["payload_bytes"] = int(row["payload_bytes"]) if row["payload_bytes"] else None
                    if not self.wanted(row):
                        records.skip()
                        continue
                    if self.with_payload:
                        row["payload"] = records.payload()
                        held += len(row["payload"])
                    else:
                        row["payload"] = None
                        records.skip()
                    rows.append(row)
                    held += 500
                    if held > BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


# -- writing -------------------------------------------------------------------------------

@dataclass
class Written(WriterCommitMessage):
    files: list[str] = field(default_factory=list)


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.file_bytes = int(options.get("filebytes", options.get("fileBytes", 32 << 20)))
        self.level = int(options.get("level", 3))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, top = _fs(self.path)
        fs.create_dir(top, recursive=True)
        done, out, size = Written(), None, 0
        for batch in iterator:
            for row in batch.to_pylist():
                data = record_bytes(row)
                if out is None or size > self.file_bytes:
                    if out is not None:
                        out.close()
                    done.files.append(f"records-{uuid.uuid4().hex}{ENDING}")
                    out, size = fs.open_output_stream(f"{top}/{done.files[-1]}", compression=None), 0
                data = member(data, data.index(b"\r\n\r\n") + 4, self.level)
                out.write(data)
                size += len(data)
        if out is not None:
            out.close()
        return done

    def commit(self, messages: list) -> None:
        fs, top = _fs(self.path)
        fs.create_dir(top, recursive=True)
        with fs.open_output_stream(f"{top}/_manifest-{uuid.uuid4().hex}") as s:
            s.write("\n".join(f for m in messages if m for f in m.files).encode())

    def abort(self, messages: list) -> None:
        """Files of an aborted write are in no manifest and so never read."""


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
    """Make the format known and let Spark hand filters to Python sources."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


# -- pages to records ----------------------------------------------------------------------

def archive_records(pages: DataFrame, min_bytes: int = 1000, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Records of ``pages`` (page_id, url, html) in the columns of the source."""
    line = r"[\r\n]+"
    rows = (pages.select(F.col("page_id").cast("string").alias("pid"), "page_id",
                         F.regexp_replace(F.col("url"), line, " ").alias("target_uri"),
                         F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8").alias("payload"))
            .withColumn("payload_digest", F.sha1("payload"))
            .withColumn("payload_bytes", F.octet_length("payload").cast("long")))
    # only payloads that occur twice need the look-up; written first, so that the join's
    # strategy follows the number of them
    twice = (rows.filter(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest", "payload_bytes")
             .agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n")).filter("n > 1")
             .select("payload_digest", "payload_bytes", "last", F.lit(True).alias("shared")))
    rows = rows.join(stage(twice, "warc-shared"), ["payload_digest", "payload_bytes"], "left")
    revisit = F.coalesce(F.col("shared"), F.lit(False)) & ~F.col("page_id").eqNullSafe(F.col("last"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    return rows.select(
        urn(F.col("page_id")).alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        "target_uri", F.lit(date).alias("warc_date"), F.lit("text/html; charset=utf-8").alias("content_type"),
        F.concat(F.lit("sha1:"), F.col("payload_digest")).alias("payload_digest"), "payload_bytes",
        F.when(revisit, urn(F.col("last"))).alias("refers_to"),
        F.when(~revisit, F.col("payload")).alias("payload"))


def page_of(column: str) -> Column:
    """Page id in a record id; an empty one is null."""
    return F.expr(f"try_cast(regexp_extract({column}, '^<urn:page:(-?[0-9]*)>$', 1) AS long)")


def write_archive(pages: DataFrame, path: str, min_bytes: int = 1000) -> None:
    register(pages.sparkSession)
    archive_records(pages, min_bytes).write.format("warc").mode("append").save(path)


def read_archive(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def archived_pages(pages: DataFrame, path: str, min_bytes: int = 1000) -> DataFrame:
    """Write ``pages`` to ``path`` and report each page as the archive has it.

    Responses are read whole and measured anew; revisits are read by their
    headers alone.
    """
    spark = pages.sparkSession
    write_archive(pages, path, min_bytes)
    whole = (read_archive(spark, path).filter(F.col("record_type") == "response")
             .select("record_id", F.octet_length("payload").cast("long").alias("payload_bytes"),
                     F.sha1("payload").alias("payload_digest"), "record_type", "refers_to"))
    heads = (read_archive(spark, path, payload=False).filter(F.col("record_type") == "revisit")
             .select("record_id", "payload_bytes",
                     F.regexp_replace("payload_digest", "^sha1:", "").alias("payload_digest"), "record_type", "refers_to"))
    both = whole.unionByName(heads)
    return both.select(page_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                       page_of("refers_to").alias("refers_to"))
