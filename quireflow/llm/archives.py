"""Web archives packed in ZIP files (WACZ), read by range.

A reader finds the end-of-directory record in the last bytes of a file, follows the ZIP64 locator where one is needed,
and parses the central directory with its ZIP64 fields. Members ``archive/*.warc`` and ``*.warc.gz`` that are stored
(not deflated) can be read in place: the lines of ``indexes/*.cdx``, ``*.cdxj`` and their ``.gz`` name the records' places.
Neighbouring records are read together, at most ``RANGE`` bytes at a time (a longer record by itself), and those ranges,
not the archives, are what is spread over the executors. A member without lines in an index is read from its start, record
by record. Nothing is extracted to a disk.

What can't be read gives a row with ``error`` and no content: a file that isn't a ZIP, a deflated archive, a record that
is damaged, a line of an index that can't be read or points outside of its archive. What the lines leave out of a member is
read in order, so no record is lost. Paths may be of any file system that Arrow knows; null ones are left out, one that is
given twice is read twice. An empty list of paths gives no rows; other columns are ignored.
"""

from __future__ import annotations

import gzip
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireflow.llm import shared

RANGE, TAIL = 8 << 20, 22 + 65535 + 20
DATE = "2024-01-01T00:00:00Z"


class Member(NamedTuple):
    name: str
    method: int
    packed: int
    size: int
    header: int  #: where its local header is


class Damaged(ValueError):
    pass


def opened(path: str):
    system, inner = pafs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def _at(file, start: int, size: int) -> bytes:
    if start < 0 or size < 0:
        raise Damaged(f"{size} bytes at {start}")
    file.seek(start)
    data = file.read(size)
    if len(data) < size:
        raise Damaged(f"{size} bytes at {start} end after {len(data)}")
    return data


def directory(file) -> list[Member]:
    """The members of a ZIP file, from its central directory."""
    file.seek(0, 2)
    end = file.tell()
    tail = _at(file, max(0, end - TAIL), min(end, TAIL))
    at = tail.rfind(b"PK\5\6", 0, len(tail) - 18)
    # the mark may also stand in the comment: the true one has a comment that ends with the file
    while at >= 0 and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail):
        at = tail.rfind(b"PK\5\6", 0, at)
    if at < 0:
        raise Damaged("no end of a central directory")
    count, size, start = struct.unpack_from("<HII", tail, at + 10)
    if 0xFFFF == count or 0xFFFFFFFF in (size, start):
        if at < 20 or tail[at - 20 : at - 16] != b"PK\6\7":
            raise Damaged("no ZIP64 locator")
        record = _at(file, struct.unpack_from("<Q", tail, at - 12)[0], 56)
        if record[:4] != b"PK\6\6":
            raise Damaged("no ZIP64 end of a central directory")
        count, size, start = struct.unpack_from("<QQQ", record, 32)
    data, members, p = _at(file, start, size), [], 0
    for _ in range(count):
        if data[p : p + 4] != b"PK\1\2":
            raise Damaged("no entry of a central directory")
        flags, method = struct.unpack_from("<HH", data, p + 8)
        packed, full, name_size, extra_size, comment = struct.unpack_from("<IIHHH", data, p + 20)
        (header,) = struct.unpack_from("<I", data, p + 42)
        name = data[p + 46 : p + 46 + name_size].decode("utf-8" if flags & 0x800 else "cp437")
        extra, q = data[p + 46 + name_size : p + 46 + name_size + extra_size], 0
        while q + 4 <= len(extra):
            kind, length = struct.unpack_from("<HH", extra, q)
            if kind == 1:  # the fields that don't fit, in this order
                wide = iter(struct.unpack_from(f"<{length // 8}Q", extra, q + 4))
                full = next(wide) if full == 0xFFFFFFFF else full
                packed = next(wide) if packed == 0xFFFFFFFF else packed
                header = next(wide) if header == 0xFFFFFFFF else header
            q += 4 + length
        members.append(Member(name, method, packed, full, header))
        p += 46 + name_size + extra_size + comment
    return members


def data_start(file, member: Member) -> int:
    """Where the bytes of a member begin: behind its local header, whose fields may be longer than in the directory."""
    head = _at(file, member.header, 30)
    if head[:4] != b"PK\3\4":
        raise Damaged(f"no local header of {member.name}")
    return member.header + 30 + sum(struct.unpack_from("<HH", head, 26))


def _content(file, member: Member) -> bytes:
    data = _at(file, data_start(file, member), member.packed)
    data = zlib.decompress(data, -15) if member.method == 8 else data
    return gzip.decompress(data) if member.name.endswith(".gz") else data


def _plan(path: str) -> Iterator[dict]:
    """Ranges of the archive to read, each with the places of the records in it, or one from which all records are read."""
    with opened(path) as file:
        members = directory(file)
        lines: dict[str, set[tuple[int, int]]] = {}
        for m in members:
            if re.fullmatch(r"indexes/.*\.cdxj?(\.gz)?", m.name):
                for line in _content(file, m).decode("utf-8", "replace").splitlines():
                    at = line.find("{")
                    if at >= 0:
                        try:
                            entry = json.loads(line[at:])
                            place = int(entry["offset"]), int(entry["length"])
                            lines.setdefault(str(entry["filename"]).removeprefix("archive/"), set()).add(place)
                        except (ValueError, KeyError, TypeError) as e:
                            yield dict(path=path, member=m.name, start=0, size=0, base=0, offsets=[], lengths=[], error=f"an index line can't be read: {e}")
        for m in members:
            if not re.fullmatch(r"archive/.*\.warc(\.gz)?", m.name):
                continue
            if m.method:
                yield dict(path=path, member=m.name, start=0, size=0, base=0, offsets=[], lengths=[], error="the archive is deflated")
                continue
            base, places = data_start(file, m), sorted(lines.get(m.name.removeprefix("archive/"), ()))
            places = [p for p in places if p[1] > 0 and 0 <= p[0] < m.packed] if m.packed else places
            for offset, length in sorted(lines.get(m.name.removeprefix("archive/"), set()) - set(places)):
                yield dict(path=path, member=m.name, start=base, size=0, base=base, offsets=[offset], lengths=[length], error=None)
            if not places:
                yield dict(path=path, member=m.name, start=base, size=m.packed, base=base, offsets=None, lengths=None, error=None)
            else:
                # what the index leaves out is read in order; a gap that holds no record gives an error row
                for a, b in _gaps(places, m.packed):
                    yield dict(path=path, member=m.name, start=base + a, size=b - a, base=base, offsets=None, lengths=None, error=None)
            group: list[tuple[int, int]] = []
            for offset, length in [*places, (-1, 0)]:
                if group and (offset < 0 or offset + length - group[0][0] > RANGE):
                    last = max(o + n for o, n in group)
                    yield dict(path=path, member=m.name, start=base + max(0, group[0][0]), size=min(last, m.packed) - max(0, group[0][0]), base=base, offsets=[o for o, _ in group], lengths=[n for _, n in group], error=None)
                    group = []
                if offset >= 0:
                    group.append((offset, length))


def _parsed(raw: bytes) -> dict:
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *fields = head.decode("utf-8", "replace").split("\r\n")
    if not first.startswith("WARC/"):
        raise Damaged("no record begins here")
    headers = {k.strip().lower(): v.strip() for k, _, v in (f.partition(":") for f in fields)}
    given = headers.get("content-length", str(len(rest)))
    if not re.fullmatch("[0-9]+", given):
        raise Damaged(f"a length of {given}")
    size = int(given)
    if len(rest) < size:
        raise Damaged("the record is cut off")
    block, status = rest[:size], None
    if headers.get("content-type", "").startswith("application/http"):
        top, _, block = block.partition(b"\r\n\r\n")
        found = re.match(rb"HTTP/\S+ (\d+)", top)
        status = int(found[1]) if found else None
    return dict(kind=headers.get("warc-type"), uri=headers.get("warc-target-uri"), date=headers.get("warc-date"), record_id=headers.get("warc-record-id"), status=status, content=block)


def _sequence(file, start: int, size: int, packed: bool) -> Iterator[tuple[int, int, bytes]]:
    """Offset, length and bytes of all records of a member, read in pieces."""
    file.seek(start)
    held, offset, left = b"", 0, size
    while left or held:
        if packed:
            unpack, out, used = zlib.decompressobj(31), [], 0
            while not unpack.eof:
                piece = held or file.read(min(left, 1 << 20))
                if not held:
                    left -= len(piece)
                if not piece:
                    raise Damaged("the record is cut off")
                out.append(unpack.decompress(piece))
                used += len(piece) - len(unpack.unused_data)
                held = unpack.unused_data
            yield offset, used, b"".join(out)
        else:
            while b"\r\n\r\n" not in held and left:
                held += (piece := file.read(min(left, 1 << 20)))
                left -= len(piece)
            head = held.find(b"\r\n\r\n")
            size_field = re.search(rb"(?im)^content-length:\s*(\d+)", held[: max(head, 0)])
            if head < 0 or not size_field:
                raise Damaged("no record begins here")
            used = head + 4 + int(size_field[1]) + 4
            while len(held) < used and left:
                held += (piece := file.read(min(left, 1 << 20)))
                left -= len(piece)
            yield offset, used, held[:used]
            held = held[used:]
        offset += used


_PLAN = "path string, member string, start bigint, size bigint, base bigint, offsets array<bigint>, lengths array<bigint>, error string"
_ROW = "path string, member string, offset bigint, length bigint, kind string, uri string, date string, record_id string, status int, content binary, error string"
_ROW_TYPE = pa.schema([("path", pa.string()), ("member", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("kind", pa.string()), ("uri", pa.string()), ("date", pa.string()), ("record_id", pa.string()), ("status", pa.int32()), ("content", pa.binary()), ("error", pa.string())])
_PLAN_TYPE = pa.schema([("path", pa.string()), ("member", pa.string()), ("start", pa.int64()), ("size", pa.int64()), ("base", pa.int64()), ("offsets", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("error", pa.string())])


def _records(plan: dict) -> Iterator[dict]:
    where = dict(path=plan["path"], member=plan["member"])
    if plan["error"]:
        yield where | dict(error=plan["error"])
        return
    packed = plan["member"].endswith(".gz")
    with opened(plan["path"]) as file:
        if plan["offsets"] is None:
            before = at = plan["start"] - plan["base"]
            try:
                for at, length, raw in _sequence(file, plan["start"], plan["size"], packed):
                    at += before
                    yield where | dict(offset=at, length=length) | _parsed(raw)
            except (ValueError, zlib.error) as e:
                yield where | dict(offset=at, error=str(e))
            return
        data = _at(file, plan["start"], max(0, plan["size"]))
        for offset, length in zip(plan["offsets"], plan["lengths"]):
            a = plan["base"] + offset - plan["start"]
            try:
                raw = data[a : a + length]
                if offset < 0 or len(raw) < length or length <= 0:
                    raise Damaged("its index line points outside of the archive")
                yield where | dict(offset=offset, length=length) | _parsed(zlib.decompress(raw, 31) if packed else raw)
            except (ValueError, zlib.error) as e:
                yield where | dict(offset=offset, length=length, error=str(e))


def _safely(plan: dict) -> Iterator[dict]:
    try:
        yield from _records(plan)
    except (OSError, ValueError, zlib.error) as e:  # the archive, not a record
        yield dict(path=plan["path"], member=plan["member"], offset=plan["start"] - (plan["base"] or 0), error=f"{type(e).__name__}: {e}")


def _gaps(places: list[tuple[int, int]], size: int) -> list[tuple[int, int]]:
    """The parts of a member that no index line names, as start and end."""
    gaps, at = [], 0
    for offset, length in places:
        if offset > at:
            gaps.append((at, offset))
        at = max(at, offset + length)
    return [*gaps, (at, size)] if size > at else gaps


def read(spark: SparkSession, paths: DataFrame) -> DataFrame:
    """The records of the archives named in the column path: path, member, offset, length, kind, uri, date, record_id,
    status, content and error."""

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows: list[dict] = []
                try:
                    for row in _plan(path) if path is not None else ():
                        rows.append(row)
                except (Damaged, OSError, ValueError, KeyError, struct.error, zlib.error) as e:
                    rows.append(dict(path=path, error=f"{type(e).__name__}: {e}"))
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _PLAN_TYPE)

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                held: list[dict] = []
                size = 0
                for record in _safely(row):
                    held.append(record)
                    size += len(record.get("content") or b"")
                    if size > RANGE:
                        yield pa.RecordBatch.from_pylist(held, _ROW_TYPE)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, _ROW_TYPE)

    planned = shared.cut(paths.select("path").repartition("path").mapInArrow(plan, _PLAN))
    # ranges, not archives, are what tasks get: as many tasks as there are ranges of full size, which stay apart although
    # the rows of the plan are small
    size = planned.agg(F.sum("size")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // RANGE)
    return planned.repartition(parts, "path", "start").mapInArrow(fetch, _ROW)


def pack(pages: DataFrame, folder: str) -> list[str]:
    """Writes pages (page_id, url, html) as archives, one for each partition, and gives their paths. Pages without a url
    or html are left out. A task that is run again writes another file; only those of tasks that succeeded are named."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, inner = pafs.FileSystem.from_uri(folder)
        system.create_dir(inner, recursive=True)
        name = f"{TaskContext.get().partitionId()}-{uuid.uuid4().hex}.wacz"
        lines, offset, any_ = [], 0, False
        with system.open_output_stream(f"{inner}/{name}") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
            with z.open("archive/data.warc.gz", "w", force_zip64=True) as member:
                for batch in batches:
                    for page, url, html in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html"))):
                        if url is None or html is None:
                            continue
                        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + html.encode()
                        head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: {url}\r\nWARC-Date: {DATE}\r\nWARC-Record-ID: <urn:page:{'' if page is None else page}>\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: {len(block)}\r\n\r\n"
                        record = gzip.compress(head.encode() + block + b"\r\n\r\n", 3, mtime=0)
                        member.write(record)
                        lines.append(f"{url} 20240101000000 " + json.dumps(dict(url=url, filename="data.warc.gz", offset=offset, length=len(record))))
                        offset += len(record)
                        any_ = True
            z.writestr("indexes/index.cdx.gz", gzip.compress("\n".join(sorted(lines)).encode(), mtime=0))
            z.writestr("datapackage.json", json.dumps(dict(profile="data-package", wacz_version="1.1.1")))
        if any_:
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"]})

    return [r.path for r in pages.select("page_id", "url", "html").mapInArrow(run, "path string").collect()]


def op4_wacz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages, packed as archives in the shared folder and read back: page_id, url, html and status."""
    paths = pack(spark.read.parquet(f"{sf_dir}/pages.parquet"), shared.fresh(spark, "wacz"))
    records = read(spark, spark.createDataFrame([(p,) for p in paths], "path string"))
    return records.where("kind = 'response' OR error IS NOT NULL").select(F.regexp_extract("record_id", "<urn:page:(-?[0-9]+)>", 1).try_cast("bigint").alias("page_id"), F.col("uri").alias("url"), F.decode("content", "UTF-8").alias("html"), "status")


SQL = "SELECT page_id, url, html, 200::INTEGER AS status FROM pages WHERE url IS NOT NULL AND html IS NOT NULL"
