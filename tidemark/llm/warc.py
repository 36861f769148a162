"""WARC archives and their Merkle fixity audit.

Pages become WARC/1.1 resource records, dealt to files of bounded size by a hash of the record and its place in the
input, so repeated pages spread. A file is written record by record, each a gzip member of its own, in order of page;
the manifest tells each record's place, byte offset, stored length and the SHA-256 of its stored bytes.

A record's leaf is the SHA-256 of its offset, length and digest; FANOUT neighbours, that is an ordered range of offsets,
make a node whose digest is that of theirs in order, up to one root a file. Levels are written once, each from the one
below. An audit compares the roots of two replicas and descends only below nodes that differ: of a sound replica no
level but the roots is compared, of a damaged one the children of unequal nodes. Record bytes are hashed where they are
read, by the offsets of the manifest, so damage to one record doesn't hide the next; only digests are shuffled.

Files are written, and hashed by offset, through pyarrow's file systems (local, HDFS, S3, GCS; Spark's names of S3 are
taken as well, whose settings then come from the environment of the workers); read_warc goes through Spark, file by file,
so its files may have 2 GB at most.

Edge cases: null urls and pages give empty fields, null ids sort first; repeated rows are records of
their own; records missing from or added to one replica count as damage where positions differ; files in
one replica only are damaged throughout; what a file holds beyond its manifest is a range more and counts as damage;
a file that can't be opened has no bytes; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcastable, discard, remove, settle, shared_dir, slices, table

FANOUT = 16
CRLF = b"\r\n\r\n"


def record_of(page_id: Column, url: Column, body: Column) -> Column:
    """The bytes of a WARC/1.1 resource record; the record id is made from the page's."""
    body = F.coalesce(body, F.lit(b""))
    name = F.regexp_replace(F.md5(F.coalesce(page_id.cast("string"), F.lit("")).cast("binary")), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:"), name, F.lit(">\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nWARC-Target-URI: "),
        F.regexp_replace(F.coalesce(url, F.lit("")), r"[\r\n]", ""), F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head.cast("binary"), body, F.lit(b"\r\n\r\n"))


def archive(pages: DataFrame, file_bytes: int = 64 << 20, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """page_id, file int, record binary. The number of files follows the bytes."""
    page_id, url, body = F.col(f"`{id_col}`"), F.col(f"`{url_col}`"), F.col(f"`{body_col}`").cast("binary")
    total = pages.agg(F.sum(F.coalesce(F.octet_length(body), F.lit(0)) + 400)).first()[0] or 0
    file = F.pmod(F.xxhash64(F.lit(3), page_id, url, F.monotonically_increasing_id()), F.lit(max(1, math.ceil(total / file_bytes)))).cast("int")
    return pages.select(page_id.alias("page_id"), file.alias("file"), record_of(page_id, url, body).alias("record"))


#: Names by which Hadoop's connectors call stores that pyarrow knows by another.
SCHEMES = {"s3a": "s3", "s3n": "s3"}


def file_store(uri: str):
    """pyarrow's file system of a URI, and the path in it."""
    from pyarrow import fs

    scheme, sep, rest = uri.partition("://")
    return fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}://{rest}" if sep else uri)


class Output:
    """Files written one after the other, each under a name of its own until it is whole: a task that is lost leaves none half written."""

    def __init__(self, uri: str):
        self.store, self.base = file_store(uri)
        self.store.create_dir(self.base, recursive=True)
        self.name = self.stream = None

    def to(self, name: str) -> None:
        if name != self.name:
            self.close()
            self.name, self.place = name, f"{self.base}/_{uuid.uuid4().hex}"
            self.stream, self.at = self.store.open_output_stream(self.place), 0

    def write(self, data: bytes) -> int:
        """Where data begins."""
        self.stream.write(data)
        self.at += len(data)
        return self.at - len(data)

    def close(self) -> None:
        if self.stream:
            self.stream.close()
            self.store.move(self.place, f"{self.base}/{self.name}")
            self.stream = None


MANIFEST = pa.schema([("page_id", pa.int64()), ("file", pa.string()), ("pos", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("sha256", pa.string()), ("record_bytes", pa.int64()), ("record_sha256", pa.string())])
LISTED = "page_id long, file string, pos long, start long, length long, sha256 string, record_bytes long, record_sha256 string"


def write_warc(records: DataFrame, uri: str) -> DataFrame:
    """Write each file of an archive (page_id, file, record) as <file>.warc.gz below uri; returns the manifest, settled: LISTED, in the order of each file."""

    def write(batches):
        out, pos = Output(uri), 0
        for batch in slices(batches, 32):
            rows = []
            for page_id, file, record, sha in zip(*(c.to_pylist() for c in batch.columns)):
                if f"{file:06d}.warc.gz" != out.name:
                    out.to(f"{file:06d}.warc.gz")
                    pos = 0
                member = zlib.compressobj(4, zlib.DEFLATED, 31)
                stored = member.compress(record) + member.flush()
                rows.append((page_id, out.name, pos, out.write(stored), len(stored), hashlib.sha256(stored).hexdigest(), len(record), sha))
                pos += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), MANIFEST)], schema=MANIFEST)
        out.close()

    dealt = records.select(F.col("page_id").cast("long").alias("page_id"), "file", "record", F.sha2("record", 256).alias("sha")).repartition("file").sortWithinPartitions("file", "page_id", "sha")
    return settle(dealt.mapInArrow(write, LISTED), "warc-manifest", "snappy")


def hashed_ranges(listed: DataFrame, uri: str) -> DataFrame:
    """file, pos, start, length, sha256 of the stored bytes that a replica below uri has at the places of a manifest; a last range for bytes beyond."""

    def read(batches):
        store, base = file_store(uri)
        name = source = None
        after = (0, 0)

        def beyond():
            pos, stop = after
            size = source.size() if source else stop
            return [(name, pos, stop, size - stop, "")] if size > stop else []

        for batch in slices(batches, 4096):
            rows = []
            for file, pos, start, length in zip(*(c.to_pylist() for c in batch.columns)):
                if file != name:
                    rows += beyond() if name is not None else []
                    name = file
                    try:
                        source = store.open_input_file(f"{base}/{file}")
                    except OSError:
                        source = None
                data = b""
                if source and start < source.size():
                    source.seek(start)
                    data = source.read(length)
                rows.append((file, pos, start, len(data), hashlib.sha256(data).hexdigest()))
                after = (pos + 1, start + length)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()))], ["file", "pos", "start", "length", "sha256"])
        if name is not None and (rows := beyond()):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()))], ["file", "pos", "start", "length", "sha256"])

    ordered = listed.select("file", "pos", "start", "length").repartition("file").sortWithinPartitions("file", "pos")
    return ordered.mapInArrow(read, "file string, pos long, start long, length long, sha256 string")


def merkle_tree(listed: DataFrame, depth: int) -> list[DataFrame]:
    """Levels from the leaves to the roots, each settled: file, at, digest, start and stop of the offset range."""
    leaf = F.sha2(F.concat_ws("|", "start", "length", "sha256").cast("binary"), 256)
    levels = [settle(listed.select("file", F.col("pos").cast("long").alias("at"), leaf.alias("digest"), "start", (F.col("start") + F.col("length")).alias("stop")), "fixity-0", "snappy")]
    for k in range(depth):
        children = F.transform(F.array_sort(F.collect_list(F.struct("at", "digest"))), lambda x: x["digest"])
        up = levels[-1].groupBy("file", F.expr(f"at div {FANOUT}").alias("up")).agg(F.sha2(F.array_join(children, "").cast("binary"), 256).alias("digest"), F.min("start").alias("start"), F.max("stop").alias("stop"))
        levels.append(settle(up.select("file", F.col("up").alias("at"), "digest", "start", "stop"), f"fixity-{k + 1}", "snappy"))
    return levels


def depth_of(*listed: DataFrame) -> int:
    """Levels above the leaves that bring the fullest file to one root."""
    most = max(x.agg(F.max("pos")).first()[0] or 0 for x in listed) + 1
    return max(1, math.ceil(math.log(most, FANOUT) - 1e-9))


def audit(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """file, pos, start, stop of the damaged records of two manifests (file, pos, start, length, sha256), found by descending from unequal roots."""
    depth = depth_of(ours, theirs)
    a, b = merkle_tree(ours, depth), merkle_tree(theirs, depth)
    wrong = None
    for level in range(depth, -1, -1):
        x, y = a[level], b[level].select("file", "at", F.col("digest").alias("other"), F.col("start").alias("start_2"), F.col("stop").alias("stop_2"))
        if wrong is not None:
            below = wrong.select("file", F.explode(F.sequence(F.col("at") * FANOUT, F.col("at") * FANOUT + FANOUT - 1)).alias("at"))
            below = settle(below, "fixity-below")
            x, y = (side.join(broadcastable(below), ["file", "at"]) for side in (x, y))
        met = x.join(y, ["file", "at"], "full").where(~F.col("digest").eqNullSafe(F.col("other")))
        found = settle(met.select("file", "at", F.coalesce("start", "start_2").alias("start"), F.coalesce("stop", "stop_2").alias("stop")), "fixity-unequal")
        if wrong is not None:
            discard(wrong, below)
        wrong = found
        if wrong.isEmpty():
            break
    discard(*a, *b)
    out = wrong.select("file", F.col("at").alias("pos"), "start", "stop")
    out.settled_path = wrong.settled_path
    return out


READ = pa.schema([("file", pa.string()), ("pos", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("sha256", pa.string()), ("type", pa.string()), ("uri", pa.string()), ("body", pa.binary()), ("problem", pa.string())])
READ_COLUMNS = "file string, pos long, start long, length long, sha256 string, type string, uri string, body binary, problem string"


def next_record(data: bytes, at: int) -> tuple[int, bytes | None, str | None]:
    """Where the record at a place stops, its bytes (inflated), and what is wrong with it: gzip, header, truncated."""
    if data[at : at + 2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        try:
            record = member.decompress(data[at:])
        except zlib.error:
            following = data.find(b"\x1f\x8b\x08", at + 2)
            return (following if following > 0 else len(data)), None, "gzip"
        return len(data) - len(member.unused_data), record, None if member.eof else "truncated"
    cut = data.find(CRLF, at)
    fields = [x.split(b":", 1) for x in data[at : max(cut, 0)].split(b"\r\n")[1:]]
    size = next((x[1].strip() for x in fields if len(x) == 2 and x[0].strip().lower() == b"content-length"), b"")
    if cut < 0 or data[at : at + 5] != b"WARC/" or not size.isdigit():
        following = data.find(CRLF + b"WARC/", at)
        return (following + 4 if following >= 0 else len(data)), None, "header"
    stop = cut + 4 + int(size) + 4
    return min(stop, len(data)), data[at : min(stop, len(data))], None if stop <= len(data) else "truncated"


def parsed(name: str, data: bytes):
    """Rows of READ of a file's bytes. Bytes that are no record are one row with a problem, up to where the next record seems to begin."""
    at, pos = 0, 0
    while at < len(data):
        stop, record, problem = next_record(data, at)
        kind = uri = body = None
        if record is not None:
            cut = record.find(CRLF)
            if cut < 0 or record[:5] != b"WARC/":
                problem = problem or "header"
            else:
                told = {k.strip().lower(): v.strip().decode("utf-8", "replace") for k, _, v in (x.partition(b":") for x in record[:cut].split(b"\r\n")[1:])}
                kind, uri, size = told.get(b"warc-type"), told.get(b"warc-target-uri"), told.get(b"content-length", "")
                if size.isdigit():
                    body = record[cut + 4 : cut + 4 + int(size)]
                    problem = problem or (None if len(body) == int(size) else "truncated")
                else:
                    problem = problem or "header"
        yield name, pos, at, stop - at, hashlib.sha256(data[at:stop]).hexdigest(), kind, uri, body, problem
        at, pos = stop, pos + 1


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Every record of plain or gzip-by-record WARC files below path, of any type: READ_COLUMNS. file is the name below path; damage is told in problem, never raised."""

    def parse(batches):
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows, size = [], 0
                for row in parsed(name, data):
                    rows.append(row)
                    size += len(row[7] or b"")
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), READ)], schema=READ)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), READ)], schema=READ)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").option("recursiveFileLookup", "true").load(path)
    inside = path.split("://")[-1].split(":/")[-1].strip("/") + "/"
    return files.select(F.substring_index("path", inside, -1).alias("name"), "content").mapInArrow(parse, READ_COLUMNS)


def rot(page_id: Column, one_in: int) -> Column:
    """Whether a page's record is damaged in the stand-in for a second store."""
    return F.coalesce(F.conv(F.substring(F.md5(page_id.cast("string").cast("binary")), 1, 8), 16, 10).cast("long") % one_in == 0, F.lit(False))


def copy_with_rot(listed: DataFrame, uri: str, to: str, one_in: int) -> int:
    """A second replica of the files of a manifest, in which one record of one_in has a bit flipped (a stand-in for a second store); its bytes."""

    def copy(batches):
        store, base = file_store(uri)
        out, source = Output(to), None
        for batch in slices(batches, 1024):
            copied = 0
            for file, start, length, hit in zip(*(c.to_pylist() for c in batch.columns)):
                if file != out.name:
                    out.to(file)
                    source = store.open_input_file(f"{base}/{file}")
                source.seek(start)
                data = bytearray(source.read(length))
                if hit:
                    data[len(data) // 2] ^= 1
                out.write(bytes(data))
                copied += len(data)
            yield pa.RecordBatch.from_arrays([pa.array([copied], pa.int64())], ["bytes"])
        out.close()

    ordered = listed.select("file", "start", "length", rot(F.col("page_id"), one_in).alias("hit"), "pos").repartition("file").sortWithinPartitions("file", "pos").drop("pos")
    return ordered.mapInArrow(copy, "bytes long").agg(F.sum("bytes")).first()[0] or 0


def op4_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record of the archive of all pages, and whether the audit found it intact in a replica with bit rot in one record of 50. Both replicas are WARC files in the shared folder while the query runs."""
    place = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    written = write_warc(archive(table(spark, sf_dir, "pages"), file_bytes=16 << 20), f"{place}/ours")
    copy_with_rot(written, f"{place}/ours", f"{place}/theirs", 50)
    ours, theirs = (settle(hashed_ranges(written, f"{place}/{side}"), f"fixity-{side}", "snappy") for side in ("ours", "theirs"))
    damaged = audit(ours, theirs)
    hit = damaged.select("file", "pos", F.lit(True).alias("damaged"))
    out = written.join(hit, ["file", "pos"], "left").select("page_id", "record_bytes", "record_sha256", F.col("damaged").isNull().alias("intact"))
    out = settle(out, "fixity", "snappy")
    discard(written, ours, theirs, damaged)
    remove(spark, place)
    return out


_ID = "coalesce(CAST(page_id AS VARCHAR), '')"
_HTML = "coalesce(html, '')"
OP4_SQL = f"""
WITH m AS (SELECT *, md5({_ID}) AS d, chr(13) || chr(10) AS nl FROM pages),
r AS (SELECT page_id, 'WARC/1.1' || nl || 'WARC-Type: resource' || nl || 'WARC-Record-ID: <urn:uuid:' || d[1:8] || '-' || d[9:12] || '-' || d[13:16] || '-' || d[17:20] || '-' || d[21:32] || '>' || nl
  || 'WARC-Date: 2024-01-01T00:00:00Z' || nl || 'WARC-Target-URI: ' || regexp_replace(coalesce(url, ''), '[\\r\\n]', '', 'g') || nl || 'Content-Type: text/html' || nl || 'Content-Length: ' || strlen({_HTML}) || nl || nl || {_HTML} || nl || nl AS record FROM m)
SELECT page_id, strlen(record) AS record_bytes, sha256(record) AS record_sha256, coalesce(CAST('0x' || md5(CAST(page_id AS VARCHAR))[1:8] AS BIGINT) % 50 <> 0, true) AS intact FROM r
"""
