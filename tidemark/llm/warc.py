"""Web archives in ZIP packages: written as Parquet is, one or more per task, and read by ranges without extraction.

A package holds stored members: archive/data.warc.gz (each record a gzip member of its own) and indexes/index.cdxj (a line per record:
URL key, time, JSON with member, offset and length).
Writing: payloads that occur more than once are counted by hash first; the one with the largest page_id is a response, the others
are revisits that refer to it. The small table of these is written before the join, so that a small one can be broadcast by its size.
Reading, each step dealt out anew: (1) a task per package reads its end records, ZIP64 ones too, and its central directory in steps; (2) a
task per PIECE bytes of an index finds the places of its lines' records; (3) records go by CHUNK bytes of their package to tasks
that read neighbouring records with one request. A package of any size is spread over all tasks.
Writers use names of their own and the manifest lists those of finished tasks, so lost or repeated tasks leave no double records.

Defined results: a null html is an empty payload; a null page_id counts as the least, and of repeated rows with the largest page_id all
are responses; a null url gives a record without target; no rows give no packages and no records; long payloads are written whole;
other columns are not read. A package without a stored index, or whose index names a compressed or missing member, is an error.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialise, new_folder

ARCHIVE, INDEX, MIN_BYTES, SALTS = "archive/data.warc.gz", "indexes/index.cdxj", 0, 16
#: Bytes of records after which a task begins another package; of an index, and of records, that one step reads.
PACKAGE, PIECE, CHUNK = 256 << 20, 4 << 20, 4 << 20
#: Bytes of records that one task reads, about.
SHARE = 32 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = "path string, offset bigint, length bigint, record_id string, record_type string, url string, digest string, refers_to string, payload_bytes bigint, intact boolean"


def open_range(path: str):
    store, name = arrow_fs.FileSystem.from_uri(path)
    return store.open_input_file(name)


# -- packages ---------------------------------------------------------------------------------------------------------------------

#: Fixed values of the ZIP format: signatures and layouts of its records.
END, END64, LOCATOR64, ENTRY, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
_END, _END64, _ENTRY, _LOCAL = struct.Struct("<4s4H2LH"), struct.Struct("<4sQ2H2L4Q"), struct.Struct("<4s6H3L5H2L"), struct.Struct("<4s5H3L2H")


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    packed: int
    header: int

    def start(self, f) -> int:
        """Offset of the member's bytes; its local header has its own lengths."""
        raw = _LOCAL.unpack(f.read_at(_LOCAL.size, self.header))
        if raw[0] != LOCAL:
            raise ValueError(f"no local header of {self.name}")
        return self.header + _LOCAL.size + raw[9] + raw[10]


def directory(f) -> tuple[int, int, int]:
    """Offset and size of the central directory, and the bytes that stand before the archive."""
    size = f.size()
    base = max(0, size - _END.size - 0xFFFF)
    tail = f.read_at(size - base, base)
    at = tail.rfind(END)
    while at >= 0 and (len(tail) < at + _END.size or at + _END.size + _END.unpack_from(tail, at)[7] != len(tail)):
        at = tail.rfind(END, 0, at)  # the comment may hold the signature
    if at < 0:
        raise ValueError("not a ZIP package")
    *_, length, offset, _ = _END.unpack_from(tail, at)
    stop = base + at
    locator = f.read_at(20, stop - 20) if stop >= 20 else b""
    if locator[:4] == LOCATOR64:
        (where,) = struct.unpack_from("<Q", locator, 8)
        raw = f.read_at(_END64.size, where)
        if raw[:4] != END64:  # bytes before the archive: the record ends where the locator begins
            where = stop - 20 - _END64.size
            raw = f.read_at(_END64.size, where)
        found = _END64.unpack(raw)
        if found[0] != END64:
            raise ValueError("no ZIP64 end record")
        length, offset, stop = found[8], found[9], where
    return stop - length, length, stop - length - offset


def members(f, step: int = 1 << 20) -> Iterator[Member]:
    """Entries of the central directory, read in steps."""
    at, length, shift = directory(f)
    stop, raw = at + length, b""
    while at < stop or raw:
        while len(raw) < _ENTRY.size or len(raw) < _ENTRY.size + sum(struct.unpack_from("<3H", raw, 28)):
            if at >= stop:
                raise ValueError("the central directory is cut")
            more = f.read_at(min(step, stop - at), at)
            at, raw = at + len(more), raw + more
        while len(raw) >= _ENTRY.size:
            e = _ENTRY.unpack_from(raw)
            if e[0] != ENTRY:
                raise ValueError("no central directory entry")
            end = _ENTRY.size + e[10] + e[11] + e[12]
            if len(raw) < end:
                break
            name, extra = raw[_ENTRY.size : _ENTRY.size + e[10]], raw[_ENTRY.size + e[10] : _ENTRY.size + e[10] + e[11]]
            packed, size, header = e[8], e[9], e[16]
            while len(extra) >= 4:
                kind, n = struct.unpack_from("<2H", extra)
                if kind == 1:  # 64-bit values, in this order, of the fields that are full
                    wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, 4))
                    size, packed, header = (next(wide) if v == 0xFFFFFFFF else v for v in (size, packed, header))
                extra = extra[4 + n :]
            yield Member(name.decode("utf-8" if e[3] & 0x800 else "cp437"), e[4], size, packed, header + shift)
            raw = raw[end:]


# -- records ----------------------------------------------------------------------------------------------------------------------


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def url_key(url: str) -> str:
    """Host labels from the last to the first, then the path: the order of an index."""
    try:
        u = urlsplit(url)
        host = ",".join(reversed((u.hostname or "").split(".")))
    except ValueError:
        return quote(url, safe="/:?=&%")
    return quote(f"{host}){u.path}" + (f"?{u.query}" if u.query else ""), safe=",)/:?=&%")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> tuple[bytes, str]:
    """A record before compression and its payload's digest; a revisit has the response's headers but not its payload."""
    digest = base32_sha1(payload)
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=_VISIBLE)}")
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    if refers_to is None:
        block += payload
    else:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", digest


_VISIBLE = "".join(chr(c) for c in range(33, 127))


def headers(raw: bytes) -> tuple[str, dict[str, str], int]:
    """First line, fields by lower-case name, and where what follows the empty line begins."""
    end = raw.index(b"\r\n\r\n")
    first, *lines = raw[:end].decode("utf-8", "replace").split("\r\n")
    return first, {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}, end + 4


def parse(raw: bytes) -> tuple:
    """The fields of RECORDS from record_id on, then the payload (None for a revisit), of a record's bytes, compressed or not."""
    if raw[:2] == b"\x1f\x8b":
        raw = zlib.decompressobj(31).decompress(raw)
    _, head, at = headers(raw)
    block = raw[at : at + int(head["content-length"])]
    payload, size = None, None
    _, http, body = headers(block)
    if head["warc-type"] == "response":
        payload = block[body:]
        size = len(payload)
    elif "content-length" in http:
        size = int(http["content-length"])
    digest = head.get("warc-payload-digest", "").removeprefix("sha1:")
    intact = None if payload is None else base32_sha1(payload) == digest
    return head["warc-record-id"].strip("<>"), head["warc-type"], head.get("warc-target-uri"), digest, head.get("warc-refers-to", "").strip("<>") or None, size, intact, payload


# -- writing ----------------------------------------------------------------------------------------------------------------------


class PackageWriter:
    """One package at a time in a folder; records stream into its archive, the index follows."""

    def __init__(self, folder: str, limit: int):
        self.store, root = arrow_fs.FileSystem.from_uri(folder)
        self.name, self.limit, self.member = f"{root}/package-{uuid.uuid4().hex}.wacz", limit, None
        self.path, self.lines, self.at = f"{folder}/{self.name.rsplit('/', 1)[1]}", [], 0
        self.stream = self.store.open_output_stream(self.name)
        self.zip = zipfile.ZipFile(self.stream, "w", zipfile.ZIP_STORED)
        self.member = self.zip.open(zipfile.ZipInfo(ARCHIVE), "w", force_zip64=True)
        info = b"software: tidemark\r\nformat: WARC File Format 1.1\r\n"
        self.put(b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:" + str(uuid.uuid4()).encode() + f">\r\nWARC-Date: {DATE}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n".encode() + info + b"\r\n\r\n")

    def put(self, raw: bytes) -> int:
        packed = gzip.compress(raw, 6, mtime=0)
        self.member.write(packed)
        self.at += len(packed)
        return len(packed)

    def add(self, page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bool:
        """True once the package is full."""
        raw, digest = record(page_id, url, payload, refers_to)
        at = self.at
        length = self.put(raw)
        fields = {"url": url or "", "digest": f"sha1:{digest}", "filename": ARCHIVE, "offset": str(at), "length": str(length)}
        self.lines.append(f"{url_key(url or '')} {''.join(c for c in DATE if c.isdigit())} {json.dumps(fields)}\n")
        return self.at >= self.limit

    def close(self) -> tuple[str, int, int]:
        self.member.close()
        with self.zip.open(zipfile.ZipInfo(INDEX), "w", force_zip64=True) as f:
            for line in sorted(self.lines):
                f.write(line.encode())
        self.zip.close()
        self.stream.close()
        return self.path, len(self.lines), self.at


def referred(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """page_id, url, payload and refers_to: null, or the largest page_id of the rows with the same payload, if that is not the row's own."""
    d = pages.select("page_id", "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    key = [F.sha2("payload", 256).alias("key"), F.octet_length("payload").alias("size")]
    copies = d.where(F.octet_length("payload") >= min_bytes).select("page_id", *key).groupBy("key", "size").agg(F.max("page_id").alias("first"), F.count("*").alias("copies"))
    # Read back, the table's size is known: a small one is broadcast. A payload of very many pages is dealt out to SALTS tasks.
    copies = materialise(copies.where("copies > 1").select("key", "size", "first"), "warc-copies").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")
    d = d.select("*", *key, salt.alias("salt")).join(copies, ["key", "size", "salt"], "left")
    again = F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < F.col("first")))
    return d.select("page_id", "url", "payload", F.when(again, F.col("first")).alias("refers_to"))


def write_packages(pages: DataFrame, folder: str | None = None, min_bytes: int = MIN_BYTES, limit: int = PACKAGE) -> DataFrame:
    """path, records, bytes of each package: a record per row of pages (page_id, url, html)."""
    folder = folder or new_folder(pages.sparkSession, "packages")
    store, root = arrow_fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, done = None, []
        for batch in batches:
            for page_id, url, payload, refers_to in zip(*(batch.column(i) for i in range(4)), strict=True):
                out = out or PackageWriter(folder, limit)
                if out.add(page_id.as_py(), url.as_py(), payload.as_py(), refers_to.as_py()):
                    done.append(out.close())
                    out = None
        if out:
            done.append(out.close())
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["path", "records", "bytes"])

    return materialise(referred(pages, min_bytes).mapInArrow(write, "path string, records bigint, bytes bigint"), "manifest", f"{folder}/manifest")


# -- reading ----------------------------------------------------------------------------------------------------------------------


def index_pieces(packages: DataFrame, piece: int = PIECE) -> DataFrame:
    """path, start and stop of an index, and from: the offset of each `piece` bytes of it."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path in batch.column(0).to_pylist():
                with open_range(path) as f:
                    found = [m for m in members(f) if m.name.startswith("indexes/") and m.name.endswith((".cdxj", ".cdx"))]
                    if not found or any(m.method for m in found):
                        raise ValueError(f"{path} has no stored index")
                    rows += [(path, m.start(f), m.start(f) + m.size) for m in found]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["path", "start", "stop"])

    # The rows of all three steps are short and stand for much work: tasks are numbered by the work, not by the rows' bytes.
    d = packages.select("path").repartition(max(1, packages.count()), "path").mapInArrow(scan, "path string, start bigint, stop bigint")
    return d.where("stop > start").select("*", F.explode(F.sequence(F.col("start"), F.col("stop") - 1, F.lit(piece).cast("bigint"))).alias("from"))


def index_lines(f, start: int, stop: int, at: int, piece: int) -> Iterator[bytes]:
    """Lines of an index (start to stop) that begin in the `piece` bytes from at."""
    end, first = min(stop, at + piece), at
    raw = f.read_at(end - at, at)
    if at > start and f.read_at(1, at - 1) != b"\n":
        cut = raw.find(b"\n")
        if cut < 0:
            return
        raw, first = raw[cut + 1 :], at + cut + 1
    while end < stop and first < at + piece and not raw.endswith(b"\n"):
        more = f.read_at(min(1 << 16, stop - end), end)
        cut = more.find(b"\n")
        end += len(more)
        raw += more if cut < 0 else more[: cut + 1]
    yield from filter(None, raw.split(b"\n"))


def record_places(pieces: DataFrame, piece: int = PIECE) -> DataFrame:
    """path, offset (in the package) and length of every record that an index lists."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, f, stored = None, None, {}
        for batch in batches:
            for name, start, stop, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if name != path:
                    if f:
                        f.close()
                    path, f = name, open_range(name)
                    stored = {m.name: (m.start(f), m.size) for m in members(f) if not m.method}
                offsets, lengths = [], []
                for line in index_lines(f, start, stop, at, piece):
                    x = json.loads(line[line.index(b"{") :])
                    if (m := x["filename"] if x["filename"] in stored else f"archive/{x['filename']}") not in stored:
                        raise ValueError(f"{path} does not store {x['filename']}")
                    base, size = stored[m]
                    if int(x["offset"]) + int(x["length"]) > size:
                        raise ValueError(f"{path}: a record reaches over the end of {m}")
                    offsets.append(base + int(x["offset"]))
                    lengths.append(int(x["length"]))
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(offsets), pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())], ["path", "offset", "length"])
        if f:
            f.close()

    return pieces.repartition(max(1, pieces.count()), "path", "from").mapInArrow(find, "path string, offset bigint, length bigint")


def read_records(places: DataFrame, payloads: bool = False, chunk: int = CHUNK, share: int = SHARE) -> DataFrame:
    """RECORDS, and the payload on demand, of the records at places (path, offset, length); about `share` bytes a task."""

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string()), ("url", pa.string()), ("digest", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("intact", pa.bool_())] + [("payload", pa.binary())] * payloads)
        path, f, held, base = None, None, b"", 0
        for batch in batches:
            rows, size = [], 0
            names, offsets, lengths = (batch.column(i).to_pylist() for i in range(3))
            for i, (name, at, length) in enumerate(zip(names, offsets, lengths, strict=True)):
                if name != path:
                    if f:
                        f.close()
                    path, f, held, base = name, open_range(name), b"", 0
                if not base <= at <= at + length <= base + len(held):
                    stop, j = at + length, i + 1
                    # Records that follow without a gap come with the same request.
                    while j < len(names) and names[j] == name and offsets[j] <= stop <= offsets[j] + lengths[j] <= at + chunk:
                        stop, j = offsets[j] + lengths[j], j + 1
                    held, base = f.read_at(stop - at, at), at
                rows.append((path, at, length, *parse(held[at - base : at - base + length])[: None if payloads else -1]))
                size += payloads * (rows[-1][8] or 0)
                if size >= chunk:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        if f:
            f.close()

    total = places.agg(F.sum("length")).first()[0] or 0
    part = F.floor(F.col("offset") / chunk)
    return places.repartition(max(1, -(-total // share)), F.col("path"), part).sortWithinPartitions("path", "offset").mapInArrow(fetch, RECORDS + (", payload binary" if payloads else ""))


def read_packages(packages: DataFrame, payloads: bool = False) -> DataFrame:
    """RECORDS of all packages (path)."""
    pieces = materialise(index_pieces(packages), "warc-pieces")
    return read_records(materialise(record_places(pieces), "warc-places"), payloads)


def archived(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, as its archive has them after writing; a damaged record is an error."""
    d = read_packages(write_packages(pages, min_bytes=min_bytes))
    number = lambda c: F.expr(f"try_cast(substr({c}, length('urn:page:') + 1) as bigint)")
    kind = F.when(F.coalesce("intact", F.lit(True)), F.col("record_type")).otherwise(F.raise_error(F.concat(F.lit("damaged record in "), "path")))
    return d.select(number("record_id").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), kind.alias("record_type"), number("refers_to").alias("refers_to"))


_CHARS = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((x >> {s}) & 31)::int + 1, 1)" for s in (15, 10, 5, 0))
ORACLE = f"""with p as (select page_id, coalesce(html, '') as payload from pages),
m as (select *, strlen(payload) as payload_bytes, max(page_id) over (partition by payload) as first, sha1(payload) as digest from p)
select page_id, payload_bytes, array_to_string(list_transform(range(8), lambda g: list_transform([('0x' || substr(digest, (5 * g + 1)::int, 5))::bigint], lambda x: {_CHARS})[1]), '') as payload_digest,
  case when payload_bytes >= {MIN_BYTES} and first is not null and (page_id is null or page_id < first) then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= {MIN_BYTES} and first is not null and (page_id is null or page_id < first) then first end as refers_to from m"""
