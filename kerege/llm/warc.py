"""WARC archives with their index first: records are found by index rows, and read as few byte ranges.

Writing: pages are gathered by their payload's hash, the page with the largest id of each payload becomes a response record and the others revisit it. The payloads
themselves are not shuffled unless there are too many repeated ones to broadcast (their hashes alone are gathered). Every task writes archives of its own, one gzip
member a record, and returns a row for each: archive, offset, length, URL, digest. These rows are the index, written as a table: it names the
archives of the tasks that came to their end, so what a lost or repeated task has left is never read.

Reading: any selection of index rows is sorted by archive and offset, neighbouring ranges become one read (gaps of up to GAP bytes are read along, a read
has up to RANGE bytes, or one record), and each record is cut out, unpacked and held against its digest.
Archives of other origin are indexed by `indexed`.

Archives lie in the shared folder and are read and written by Arrow's file systems (local or mounted, HDFS, S3, Google, Azure).
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerege.llm._common import joined_by_group, own_folder, written
from kerege.shipping import ship_package

#: Bytes of an archive after which a task begins another.
ARCHIVE = 1 << 30
#: Bytes between two selected records that are read along, and bytes of one read.
GAP = 64 << 10
RANGE = 8 << 20
#: Bytes of archives a reading task takes.
SHARE = 64 << 20
#: Bytes of hashes and URLs of repeated payloads that are broadcast at most; more meet by shuffle.
BROADCAST_BYTES = 32 << 20

#: Fixed values of the format.
VERSION = b"WARC/1.1"
RESPONSE, REVISIT = "response", "revisit"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = "page_id long, url string, record_type string, payload_digest string, archive string, offset long, length long"
RECORD = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI and the path on it."""
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", path))


def digest(payload: bytes) -> str:
    """SHA-1 in upper-case base32."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page_id: int | None, payload_digest: str) -> str:
    """An id that a record's revisits know without looking it up."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {payload_digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, payload_digest: str, refers_to: int | None, refers_url: str | None, date: str) -> bytes:
    """One record as a gzip member; with refers_to a revisit without payload."""
    place = lambda u: quote(u, safe="".join(map(chr, range(0x21, 0x7F)))) if u else "about:blank"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http if refers_to is not None else http + payload
    own = _record_id(page_id, payload_digest) if refers_to is None else f"<urn:uuid:{uuid.uuid4()}>"
    head = [("WARC-Type", RESPONSE if refers_to is None else REVISIT), ("WARC-Record-ID", own), ("WARC-Date", date), ("WARC-Target-URI", place(url))]
    head += [("WARC-Payload-Digest", f"sha1:{payload_digest}"), ("Content-Type", "application/http;msgtype=response")]
    if page_id is not None:
        head.append(("Page-Id", page_id))
    if refers_to is not None:
        head += [("WARC-Profile", SAME_PAYLOAD), ("WARC-Refers-To", _record_id(refers_to, payload_digest)), ("WARC-Refers-To-Target-URI", place(refers_url)), ("Refers-To-Page-Id", refers_to)]
    head.append(("Content-Length", len(body)))
    lines = "".join(f"{k}: {v}\r\n" for k, v in head).encode()
    return gzip.compress(VERSION + b"\r\n" + lines + b"\r\n" + body + b"\r\n\r\n", 6, mtime=0)


def parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (names in lower case) and block of an unpacked record; ValueError where it isn't one."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.split(b"\r\n")
    fields = dict((k.strip().lower(), v.strip()) for k, _, v in (x.decode("utf-8", "replace").partition(":") for x in lines))
    size = int(fields.get("content-length", -1))
    if not first.startswith(b"WARC/") or size < 0 or len(rest) < size:
        raise ValueError("not a whole WARC record")
    return fields, rest[:size]


def payload_of(block: bytes) -> tuple[bytes, int | None]:
    """The payload of an HTTP response in a record's block, and the length its header names."""
    head, _, payload = block.partition(b"\r\n\r\n")
    named = re.search(rb"(?im)^content-length:\s*(\d+)", head)
    return payload, int(named[1]) if named else None


def _writing(folder: str, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = store(folder)
        date = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
        out, name, at = None, "", 0
        for batch in batches:
            rows = []
            for page_id, url, payload, payload_digest, refers_to, refers_url in zip(*(batch.column(k) for k in range(6)), strict=True):
                one = [page_id.as_py(), url.as_py(), payload.as_py(), payload_digest.as_py(), refers_to.as_py(), refers_url.as_py()]
                if out is None:
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = system.open_output_stream(f"{root}/{name}", compression=None)
                made = record(*one, date)
                out.write(made)
                rows.append((one[0], one[1], RESPONSE if one[4] is None else REVISIT, one[3], f"{folder}/{name}", at, len(made)))
                at += len(made)
                if at >= size:
                    out.close()
                    out = None
            yield _batch(rows, INDEX)
        if out is not None:
            out.close()

    return run


_ARROW = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[kind]) for c, (_, kind) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _base32(digest_hex: str) -> str:
    """SQL: 40 hex digits as 32 base32 digits, five bits at a time."""
    five = f"cast(conv(substr({digest_hex}, 5 * g + 1, 5), 16, 10) as bigint)"
    return f"concat_ws('', transform(sequence(0, 7), g -> concat_ws('', transform(sequence(0, 3), k -> substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast(shiftright({five}, 15 - 5 * k) & 31 as int) + 1, 1)))))"


def planned(pages: DataFrame, least: int = 0, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """page_id, url, payload, payload_digest, refers_to, refers_url: the records of pages (page_id, url, html).

    Payloads of at least `least` bytes that are equal have one response, that of the largest page_id; rows that repeat it are responses too. Pages without page_id
    revisit where another page has the payload.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("payload_digest", F.expr(_base32("sha1(payload)"))).withColumn("__key", F.sha2("payload", 256))
    seen = rows.where(F.length("payload") >= least).groupBy("__key").agg(F.max("page_id").alias("__last"), F.coalesce(F.max_by("url", "page_id"), F.lit("")).alias("__url"), F.count("*").alias("n"))
    groups = written(seen.where("n > 1 and __last is not null"), "payloads")
    if (groups.agg(F.sum(F.length("__url") * 4 + 120)).first()[0] or 0) <= broadcast_bytes:
        found = rows.join(F.broadcast(groups.drop("n")), "__key", "left")
    else:
        everyone = written(seen, "payloads")
        found = joined_by_group(rows.where(F.length("payload") >= least), everyone, "__key")
        found = found.unionByName(rows.where(F.length("payload") < least), allowMissingColumns=True)
    other = F.when(~F.col("page_id").eqNullSafe(F.col("__last")), F.col("__last"))
    return found.select("page_id", "url", "payload", "payload_digest", other.alias("refers_to"), F.when(other.isNotNull(), F.col("__url")).alias("refers_url"))


def archived(pages: DataFrame, folder: str, least: int = 0, size: int = ARCHIVE) -> DataFrame:
    """Writes the pages to archives below folder (a URI) and returns the index, a written table.

    One record for each row of pages (page_id, url, html): a null html is an empty payload, a null URL about:blank, a null page_id has no field. Rows that repeat a page_id are
    records of their own. An empty table writes no archive. Other columns are ignored.
    """
    ship_package(pages.sparkSession)
    system, root = store(folder)
    system.create_dir(root, recursive=True)
    return written(planned(pages, least).mapInArrow(_writing(folder, size), INDEX), "index")


def _ranges(rows: Iterator[tuple], gap: int, most: int) -> Iterator[list[tuple]]:
    """Rows (archive, offset, length, ...) in order, in lists that one read each will cover."""
    held, end = [], 0
    for row in rows:
        archive, offset, length = row[:3]
        if held and (archive != held[0][0] or offset - end > gap or offset + length - held[0][1] > most):
            yield held
            held = []
        end = max(end, offset + length) if held else offset + length
        held.append(row)
    if held:
        yield held


def _unpacked(raw: bytes, page_id: int | None, url: str | None) -> tuple:
    """A row of RECORD; ValueError where the payload doesn't have its digest."""
    fields, block = parsed(gzip.decompress(raw))
    payload, named = payload_of(block)
    said = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if fields["warc-type"] == REVISIT:
        other = fields.get("refers-to-page-id")
        return page_id, url, REVISIT, named, said, int(other) if other else None, None
    if said and digest(payload) != said:
        raise ValueError(f"the payload of {url} does not have its digest")
    return page_id, url, fields["warc-type"], len(payload), said or digest(payload), None, payload


def _reading(gap: int, most: int, payloads: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        opened, source = None, None
        for held in _ranges(rows, gap, most):
            archive, begin = held[0][:2]
            if archive != opened:
                system, path = store(archive)
                if source is not None:
                    source.close()
                opened, source = archive, system.open_input_file(path)
            block = source.read_at(max(o + n for _, o, n, *_ in held) - begin, begin)
            found = [_unpacked(block[o - begin : o - begin + n], page_id, url) for _, o, n, page_id, url in held]
            yield _batch(found if payloads else [(*x[:-1], None) for x in found], RECORD)
        if source is not None:
            source.close()

    return run


def fetched(index: DataFrame, gap: int = GAP, most: int = RANGE, share: int = SHARE, payloads: bool = True) -> DataFrame:
    """The records of index rows (any selection of them), with payloads if wanted; revisits have none, their bytes and digest are those of the full payload.

    A payload without its digest, or a range that holds no record, raises ValueError. A page_id or URL of the index goes with its record. An empty selection reads nothing.
    """
    ship_package(index.sparkSession)
    total = index.agg(F.sum("length")).first()[0] or 0
    dealt = index.select("archive", "offset", "length", "page_id", "url").repartitionByRange(int(total // share) + 1, "archive", "offset").sortWithinPartitions("archive", "offset")
    return dealt.mapInArrow(_reading(gap, most, payloads), RECORD)


def members(chunks: Iterator[bytes]) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of each gzip member of a stream; a broken tail is left out."""
    begin, at, inflate, made, rest = 0, 0, zlib.decompressobj(31), [], b""
    for chunk in chunks:
        rest = chunk
        while rest:
            made.append(inflate.decompress(rest))
            used = len(rest) - len(inflate.unused_data)
            at += used
            rest = inflate.unused_data
            if not inflate.eof:
                break
            yield begin, at - begin, b"".join(made)
            begin, inflate, made = at, zlib.decompressobj(31), []


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column(0).to_pylist():
            system, name = store(re.sub(r"^file:/(?!/)", "file:///", path))
            rows = []
            with system.open_input_stream(name, compression=None) as stream:
                for offset, length, raw in members(iter(lambda: stream.read(1 << 20), b"")):
                    fields, block = parsed(raw)
                    if fields.get("warc-type") in (RESPONSE, REVISIT):
                        said = fields.get("warc-payload-digest", "").removeprefix("sha1:") or digest(payload_of(block)[0])
                        page = fields.get("page-id")
                        rows.append((int(page) if page else None, fields.get("warc-target-uri"), fields["warc-type"], said, path, offset, length))
                    if len(rows) >= 10_000:
                        yield _batch(rows, INDEX)
                        rows = []
            yield _batch(rows, INDEX)


def indexed(spark: SparkSession, folder: str, pattern: str = "*.warc.gz") -> DataFrame:
    """The index of all archives in a folder: one row for each response and revisit record; a task takes whole archives, record by record. A record cut off at an archive's end is left out."""
    ship_package(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder).select("path")
    return files.mapInArrow(_scanned, INDEX)


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each page, as the archives give them back. See `archived` for nulls and repeated rows."""
    index = archived(pages, f"{own_folder(pages.sparkSession)}/archives-{uuid.uuid4().hex}", least)
    return fetched(index, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op12_warc_index(spark, sf_dir: str) -> DataFrame:
    """The whole pages table, written and read back."""
    return round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


_BITS = "array_to_string(list_transform(range(1, 41), lambda i: format('{:04b}', instr('0123456789abcdef', substr(h, i, 1)) - 1)), '')"
_DIGIT = "list_sum(list_transform(range(0, 5), lambda j: case when substr(bits, 5 * k + j + 1, 1) = '1' then 16 >> j else 0 end))"
OP12_SQL = f"""
with p as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, html, sha1(html) as h, octet_length(encode(html)) as n, max(page_id) over (partition by html) as last from p),
b as (select *, {_BITS} as bits from d)
select page_id, cast(n as bigint) as payload_bytes, array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast({_DIGIT} as bigint) + 1, 1)), '') as payload_digest,
  case when page_id = last then 'response' else 'revisit' end as record_type, case when page_id <> last then last end as refers_to
from b
"""
