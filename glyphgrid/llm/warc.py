"""WARC archives with a two-level capture index.

Every task writes its own archive files, one gzip member a record, and returns
where each record lies. The captures are sorted by reversed-host key, dealt to
ranges, and each range written as compressed blocks of ``BLOCK_LINES`` lines; a
sparse directory keeps the first key and the place of each block. A lookup finds
a key's ranges (at most ``RANGES``, all that is sent to the workers) by binary
search, meets the range's part of the directory in a task, binary-searches it and
then the blocks that can hold the key, and range-reads the records. A key that
very many captures share lies in many ranges.

Files have a new name for every attempt of a task, and only those that the
committed capture table names are ever read, so a lost or repeated task leaves
nothing but an unread file.

Defined results: a null payload counts as empty; null urls have the empty key;
equal payloads of at least ``REVISIT_BYTES`` bytes are stored once, with the
largest page id (all rows that repeat this id are responses), and the others
revisit it; smaller payloads are always stored. Null page ids are smaller than
all others and read back as null. An empty table gives an archive without
records. Only page_id, url and html are read.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphgrid.session import materialize, new_path, slices, small_batches

REVISIT_BYTES, BLOCK_LINES, FILE_BYTES = 1000, 2000, 1 << 30
#: Ranges of the sorted index at most, and captures that a range should have while there are fewer.
RANGES, RANGE_LINES = 4096, 4000
#: Records, and their bytes in the archive, read in one go, in the order of the files.
READ_AHEAD, READ_BYTES = 256, 8 << 20
SALTS = 32
DATE = "2024-01-01T00:00:00Z"
CAPTURE = "key string, page_id long, url string, type string, file string, offset long, length long"
DIRECTORY = "part long, first_key string, last_key string, file string, offset long, length long, n long"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload string"


@dataclass(frozen=True)
class Archive:
    captures: DataFrame
    directory: DataFrame


def url_key(url: str | None) -> str:
    """Host reversed, port and user dropped, then path and query: ``com,example)/a?b``."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host = (parts.hostname or "").lower()
    except ValueError:
        return url.strip().lower()
    path = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return ",".join(reversed(host.split("."))) + ")" + path if host else url.strip().lower()


def store(folder: str):
    """(file system, path) of a folder: a local path or the URI of any store Arrow opens, under Hadoop's names for it too."""
    from pyarrow import fs

    for hadoop, name in (("s3a://", "s3://"), ("s3n://", "s3://")):
        if folder.startswith(hadoop):
            folder = name + folder.removeprefix(hadoop)
    system, path = fs.FileSystem.from_uri(folder)
    return system, path


class Writer:
    """Appends members to files of one task, beginning a new file at ``FILE_BYTES``."""

    def __init__(self, folder: str, suffix: str):
        self.system, self.path = store(folder)
        self.suffix, self.out, self.at, self.name = suffix, None, 0, ""
        self.system.create_dir(self.path, recursive=True)

    def add(self, data: bytes) -> tuple[str, int, int]:
        if self.out is None or self.at >= FILE_BYTES:
            self.close()
            context = TaskContext.get()
            self.name = f"{context.partitionId() if context else 0:06d}-{uuid.uuid4().hex}{self.suffix}"
            self.out, self.at = self.system.open_output_stream(f"{self.path}/{self.name}", compression=None), 0
        place = (self.name, self.at, len(data))
        self.out.write(data)
        self.at += len(data)
        return place

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


class Reader:
    """Range reads from the files of a folder; a few stay open."""

    def __init__(self, folder: str, most: int = 64):
        self.system, self.path = store(folder)
        self.open, self.most = {}, most

    def read(self, name: str, offset: int, length: int) -> bytes:
        f = self.open.pop(name, None) or self.system.open_input_file(f"{self.path}/{name}")
        self.open[name] = f
        if len(self.open) > self.most:
            self.open.pop(next(iter(self.open))).close()
        return f.read_at(length, offset)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, refers_url: str | None, revisit: bool) -> bytes:
    """One record as a gzip member."""
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {json.dumps(url or '')[1:-1]}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To-Target-URI: {json.dumps(refers_url or '')[1:-1]}", f"X-Refers-To-Page-ID: {refers_to}"]
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + (b"" if revisit else payload)
    head.append(f"Content-Length: {len(block)}")
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", mtime=0)


def parse(member: bytes) -> tuple:
    """A row of ``RECORD``; size and digest of a response are those of what was read."""
    head, _, rest = gzip.decompress(member).partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")[2]
    number = lambda name: int(fields[name]) if name in fields else None
    url, kind = json.loads(f'"{fields["WARC-Target-URI"]}"'), fields["WARC-Type"]
    if kind == "revisit":
        return number("X-Page-ID"), url, kind, number("X-Refers-To-Page-ID"), number("X-Payload-Length"), fields["WARC-Payload-Digest"].removeprefix("sha1:"), None
    return number("X-Page-ID"), url, kind, None, len(payload), hashlib.sha1(payload).hexdigest(), payload.decode()


def table(rows: Iterable[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)


def arrow(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64()}
    return pa.schema([(n, kinds[t]) for n, t in (x.split() for x in ddl.split(", "))])


def with_revisits(pages: DataFrame) -> DataFrame:
    """Pages with the id and url of the response they repeat (null: they are responses).

    A payload may be shared by a third of all rows: the largest id is found with
    partial sums, and the answer is spread over ``SALTS`` keys for the way back.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html")).withColumn("sha", F.unhex(F.sha2("html", 256)))
    large = base.filter(F.octet_length("html") >= REVISIT_BYTES)
    groups = large.groupBy("sha").agg(F.max(F.struct("page_id", "url")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    spread = groups.select("sha", F.col("first.page_id").alias("keep_id"), F.col("first.url").alias("keep_url"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = base.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    joined = salted.join(spread, ["sha", "salt"], "left")
    revisit = F.col("keep_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keep_id"))
    return joined.select("page_id", "url", "html", F.when(revisit, F.col("keep_id")).alias("refers_to"), F.when(revisit, F.col("keep_url")).alias("refers_url"))


def write(pages: DataFrame, folder: str | None = None, block_lines: int = BLOCK_LINES) -> tuple[str, Archive]:
    """Write the archives and their index below ``folder`` (a new shared one if not given)."""
    spark = pages.sparkSession
    small_batches(spark)
    folder = folder or new_path(spark, "warc")
    captured, listed = arrow(CAPTURE), arrow(DIRECTORY)

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Writer(f"{folder}/archive", ".warc.gz")
        for batch in slices(batches):
            rows = []
            for page_id, url, html, refers_to, refers_url in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                payload = html.encode()
                member = record(page_id, url, payload, hashlib.sha1(payload).hexdigest(), refers_to, refers_url, refers_to is not None)
                rows.append((url_key(url), page_id, url, "response" if refers_to is None else "revisit", *out.add(member)))
            yield table(rows, captured)
        out.close()

    captures = materialize(with_revisits(pages).mapInArrow(records, CAPTURE), "captures")
    parts = max(1, min(RANGES, -(-captures.count() // RANGE_LINES)))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held, part = Writer(f"{folder}/index", ".cdx.gz"), [], TaskContext.get().partitionId()

        def flush() -> pa.RecordBatch:
            place = out.add(gzip.compress("".join(json.dumps(x) + "\n" for x in held).encode(), mtime=0))
            row = (part, held[0][0], held[-1][0], *place, len(held))
            held.clear()
            return table([row], listed)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(row)
                if len(held) == block_lines:
                    yield flush()
        if held:
            yield flush()
        out.close()

    order = ["key", "page_id", "file", "offset"]
    ranged = captures.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return folder, Archive(captures, materialize(ranged.mapInArrow(blocks, DIRECTORY), "directory"))


def wanted_keys(urls: DataFrame, archive: Archive) -> tuple[DataFrame, int]:
    """(part, key): the ranges that can hold each different key of ``urls``, and the number of ranges."""
    tops = sorted(map(tuple, archive.directory.groupBy("part").agg(F.min("first_key").alias("first"), F.max("last_key").alias("last")).select("first", "last", "part").collect()))
    first, last, part = ([t[k] for t in tops] for k in range(3))
    found = arrow("part long, key string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = {url_key(u) for u in batch.column(0).to_pylist()}
            yield table([(part[i], key) for key in keys for i in range(bisect_left(last, key), bisect_right(first, key))], found)

    return urls.select(F.col("url").cast("string")).mapInArrow(run, "part long, key string").distinct(), max(len(tops), 1)


def lookup(folder: str, archive: Archive, urls: DataFrame) -> DataFrame:
    """The records (``RECORD``) of every different url of ``urls`` (column ``url``), by binary search; urls of one key are one."""
    read = arrow(RECORD)
    wanted, parts = wanted_keys(urls, archive)
    none = lambda kind, *names: [F.lit(None).cast(kind).alias(n) for n in names]
    blocks = archive.directory.select("part", F.lit(0).alias("kind"), F.col("first_key").alias("key"), "last_key", "file", "offset", "length")
    both = blocks.unionByName(wanted.select("part", F.lit(1).alias("kind"), "key", *none("string", "last_key", "file"), *none("long", "offset", "length")))
    # a range's blocks come before the keys, both in order; the number of tasks is given, so that few rows are not one task
    dealt = both.repartition(parts, "part").sortWithinPartitions("part", "kind", "key", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, data = Reader(f"{folder}/index"), Reader(f"{folder}/archive")
        now, directory, held = None, [], []
        lines: list[list] = []
        opened, waiting = None, 0

        def records() -> pa.RecordBatch:
            found = [parse(data.read(*x[4:7])) for x in sorted(held, key=lambda x: x[4:6])]
            held.clear()
            return table(found, read)

        for batch in batches:
            for part, kind, key, last, file, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != now:
                    now, directory = part, []
                if kind == 0:
                    directory.append((key, last, file, offset, length))
                    continue
                # the blocks of a range are in order, so the first and the last keys are too
                for block in directory[bisect_left(directory, key, key=lambda b: b[1]) : bisect_right(directory, key, key=lambda b: b[0])]:
                    if block != opened:
                        opened, lines = block, [json.loads(x) for x in gzip.decompress(index.read(*block[2:])).splitlines()]
                    for line in lines[bisect_left(lines, key, key=lambda x: x[0]) : bisect_right(lines, key, key=lambda x: x[0])]:
                        held.append(line)
                        waiting += line[6]
                        if len(held) == READ_AHEAD or waiting >= READ_BYTES:
                            yield records()
                            waiting = 0
        yield records()

    return dealt.mapInArrow(run, RECORD)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages, look all their urls up in the archives and describe every record."""
    folder, archive = write(pages)
    return lookup(folder, archive, pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
