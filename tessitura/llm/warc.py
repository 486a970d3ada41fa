"""Web archives as ZIP packages: write WARC records as stored members with an index, read them back by range.

An archive holds ``archive/data.warc.gz`` (WARC/1.1 records, each a gzip member of its own and the file stored, so a
record can be read by its byte range) and ``indexes/index.tsv`` (a line a record: encoded id, offset, length). A reader needs the end of the file to find the
central directory (ZIP64 records included), the index member to find records, and then only the ranges it wants;
nothing is unpacked. Each task writes archives of its own under the shared folder through pyarrow's file systems,
under names that no other attempt uses, and only a finished task's archives enter the manifest.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote_to_bytes

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.llm._shared import HOT_SHARE, arrow_limits, col, materialize, partitions, run_dir

DATA, INDEX = "archive/data.warc.gz", "indexes/index.tsv"
LEVEL = 3  # of gzip
ARCHIVE_BYTES = 256 << 20
RANGE_BYTES = 4 << 20  # records are read in runs of about this size
REVISIT_FROM = 1000
_BIG = 0xFFFFFFFF


def _open(url: str) -> tuple[fs.FileSystem, str]:
    if url.startswith("file:/") and not url.startswith("file://"):  # as Hadoop writes local URIs
        url = "file://" + url[5:]
    return fs.FileSystem.from_uri(url)


class ZipWriter:
    """A streamed ZIP of stored members; sizes follow each member in a ZIP64 data descriptor."""

    def __init__(self, sink):
        self.sink, self.at, self.members = sink, 0, []

    def _put(self, data: bytes) -> None:
        self.sink.write(data)
        self.at += len(data)

    def begin(self, name: str) -> None:
        self.members.append([name.encode(), self.at, 0, 0])
        n = self.members[-1][0]
        extra = struct.pack("<HHQQ", 1, 16, 0, 0)
        self._put(struct.pack("<4s5H3L2H", b"PK\3\4", 45, 8, 0, 0, 33, 0, _BIG, _BIG, len(n), len(extra)) + n + extra)

    def write(self, data: bytes) -> int:
        """Returns the data's offset in the member."""
        member = self.members[-1]
        offset = member[2]
        member[2], member[3] = offset + len(data), zlib.crc32(data, member[3])
        self._put(data)
        return offset

    def end(self) -> None:
        _, _, size, crc = self.members[-1]
        self._put(struct.pack("<4sLQQ", b"PK\7\10", crc, size, size))

    def close(self) -> None:
        start = self.at
        for name, offset, size, crc in self.members:
            extra = struct.pack("<HHQQQ", 1, 24, size, size, offset)
            self._put(struct.pack("<4s6H3L5H2L", b"PK\1\2", 45, 45, 8, 0, 0, 33, crc, _BIG, _BIG, len(name), len(extra), 0, 0, 0, 0, _BIG) + name + extra)
        size, n, end = self.at - start, len(self.members), self.at
        self._put(struct.pack("<4sQ2H2L4Q", b"PK\6\6", 44, 45, 45, 0, 0, n, n, size, start))
        self._put(struct.pack("<4sLQL", b"PK\6\7", 0, end, 1))
        self._put(struct.pack("<4s4H2LH", b"PK\5\6", 0, 0, min(n, 0xFFFF), min(n, 0xFFFF), _BIG, _BIG, 0))


class ZipReader:
    """Member places of a ZIP, from its end and central directory alone; ``source`` has size() and read_at(n, offset)."""

    def __init__(self, source):
        self.source, size = source, source.size()
        for reach in (22 + 20 + 56, 22 + 65535 + 20 + 56):  # without, then with, the longest comment
            base = max(0, size - reach)
            tail = source.read_at(size - base, base)
            end = tail.rfind(b"PK\5\6")
            if end >= 0:
                break
        else:
            raise ValueError("not a ZIP archive: no end of central directory")
        count, length, start = struct.unpack_from("<H2L", tail, end + 10)
        if end >= 20 and tail[end - 20 : end - 16] == b"PK\6\7":
            (at,) = struct.unpack_from("<Q", tail, end - 12)
            count, length, start = struct.unpack_from("<3Q", source.read_at(56, at), 32)
        listing = source.read_at(length, start)
        self.members: dict[str, tuple[int, int, int]] = {}  # name: local header, size, method
        at = 0
        for _ in range(count):
            if listing[at : at + 4] != b"PK\1\2":
                raise ValueError("damaged central directory")
            method, = struct.unpack_from("<H", listing, at + 10)
            packed, plain, n, m, k = struct.unpack_from("<2L3H", listing, at + 20)
            offset, = struct.unpack_from("<L", listing, at + 42)
            name, extra = listing[at + 46 : at + 46 + n].decode(), listing[at + 46 + n : at + 46 + n + m]
            while len(extra) >= 4:
                kind, size_of = struct.unpack_from("<2H", extra)
                if kind == 1:  # ZIP64: the values that are full above, in this order
                    values = iter(struct.unpack_from(f"<{size_of // 8}Q", extra, 4))
                    plain = next(values) if plain == _BIG else plain
                    packed = next(values) if packed == _BIG else packed
                    offset = next(values) if offset == _BIG else offset
                extra = extra[4 + size_of :]
            self.members[name] = (offset, packed, method)
            at += 46 + n + m + k

    def place(self, name: str) -> tuple[int, int]:
        """Offset and size of a stored member's bytes in the file."""
        header, size, method = self.members[name]
        if method:
            raise ValueError(f"{name} is compressed; only stored members can be read by range")
        n, m = struct.unpack("<2H", self.source.read_at(4, header + 26))
        return header + 30 + n + m, size

    def read(self, name: str) -> bytes:
        at, size = self.place(name)
        return self.source.read_at(size, at)


def record(key: str, uri: str, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One WARC record. A revisit carries no payload, but its length and digest."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{key}>",
        "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def pack(data: bytes) -> bytes:
    """One gzip member, without a time stamp."""
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    warc = dict(x.split(": ", 1) for x in lines[1:])
    http, _, payload = rest[: int(warc["Content-Length"])].partition(b"\r\n\r\n")
    return warc, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload


def _clean(uri: bytes | None) -> str:
    """A URI for a header: what is not visible ASCII is percent-encoded."""
    return "".join(chr(b) if 33 <= b <= 126 else f"%{b:02X}" for b in uri or b"unknown:")


#: The key of a null id; no encoded id has an asterisk.
NO_ID = "*"


def encode_id(value: bytes | None) -> str:
    """An id for headers and index: letters, digits and -._~ stay, all else is percent-encoded."""
    return NO_ID if value is None else quote(value, safe="")


def decode_id(key: str) -> bytes | None:
    return None if key == NO_ID else unquote_to_bytes(key)


def write_archives(pages: DataFrame, folder: str, *, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", revisit_from: int = REVISIT_FROM, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record a row into ZIP archives under folder; return the manifest ``path, n_records``.

    Of rows with equal payloads of at least revisit_from bytes, that of the largest id is written whole (all rows of
    that id, if it repeats), the others as revisits of it. A null payload is empty; a null id is kept as such and is
    smaller than any other; a null or empty URI is 'unknown:'. Ids are percent-encoded, so any text may be one.
    """
    spark = pages.sparkSession
    arrow_limits(spark)
    payload = F.coalesce(col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(col(id_col).alias("__id"), col(uri_col).cast("string").cast("binary").alias("__uri"), payload.alias("__payload"))
    rows = rows.withColumn("__digest", F.sha1("__payload")).withColumn("__n", F.octet_length("__payload"))
    # one row for each payload that is shared: a narrow aggregation, combined before its shuffle
    shared = (
        rows.where(F.col("__n") >= revisit_from).groupBy("__digest", "__n").agg(F.max("__id").alias("__best"), F.count(F.lit(1)).alias("__times"))
        .where("__times > 1")
    )
    shared = materialize(shared, "warc-shared")
    # payloads that a large share of the rows have are known by a broadcast of fewer than HOT_SHARE rows; their rows,
    # and those too small to be revisited, meet nothing in the shuffle and are spread by a number of their own
    total = shared.agg(F.coalesce(F.sum("__times"), F.lit(0))).first()[0]
    hot = F.col("__times") * HOT_SHARE > total
    often = shared.where(hot).select("__digest", "__n", F.col("__best").alias("__hot_best"))
    seldom = shared.where(~hot).select(F.col("__digest").alias("__meet"), "__n", "__best")
    rows = rows.join(F.broadcast(often.withColumn("__hot", F.lit(True))), ["__digest", "__n"], "left")
    alone = F.col("__hot").isNotNull() | (F.col("__n") < revisit_from)
    rows = rows.withColumn("__meet", F.when(alone, F.concat(F.lit("-"), F.monotonically_increasing_id().cast("string"))).otherwise(F.col("__digest")))
    best = F.coalesce("__best", "__hot_best")
    planned = rows.join(seldom, ["__meet", "__n"], "left").select(
        F.col("__id").cast("string").cast("binary").alias("id"), "__uri", "__payload", "__digest", F.when(best.isNotNull() & ~best.eqNullSafe(F.col("__id")), best.cast("string").cast("binary")).alias("refers"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, current = [], None

        def start():
            target, base = _open(folder)
            target.create_dir(base, recursive=True)
            path = f"{base}/{uuid.uuid4().hex}.zip"
            sink = target.open_output_stream(path)
            zipped = ZipWriter(sink)
            zipped.begin(DATA)
            return [f"{folder}/{path.rsplit('/', 1)[1]}", sink, zipped, []]

        def finish(x):
            x[2].end()
            x[2].begin(INDEX)
            for line in x[3]:
                x[2].write(line)
            x[2].end()
            x[2].close()
            x[1].close()
            made.append((x[0], len(x[3])))

        for batch in batches:
            for one, uri, body, digest, refers in zip(*(c.to_pylist() for c in batch.columns)):
                if current is None:
                    current = start()
                key = encode_id(one)
                data = pack(record(key, _clean(uri), body, digest, None if refers is None else encode_id(refers)))
                offset = current[2].write(data)
                current[3].append(f"{key}\t{offset}\t{len(data)}\n".encode())
                if offset + len(data) >= archive_bytes:
                    finish(current)
                    current = None
        if current is not None:
            finish(current)
        yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64())], names=["path", "n_records"])

    return materialize(planned.mapInArrow(run, "path string, n_records long"), "warc-manifest")


class _File:
    def __init__(self, url: str):
        system, path = _open(url)
        self.file = system.open_input_file(path)

    def size(self) -> int:
        return self.file.size()

    def read_at(self, n: int, offset: int) -> bytes:
        return self.file.read_at(n, offset)


def records_of(url: str, range_bytes: int = RANGE_BYTES) -> Iterator[tuple[str, bytes]]:
    """(index key, record bytes) of an archive, read by ranges that follow its index and unpacked one by one."""
    source = _File(url)
    with source.file:
        zipped = ZipReader(source)
        base, size = zipped.place(DATA)
        places = [x.split("\t") for x in zipped.read(INDEX).decode().split("\n") if x]
        places = [(key, int(offset), int(length)) for key, offset, length in places]
        i = 0
        while i < len(places):
            j, first = i + 1, places[i][1]
            while j < len(places) and places[j][1] + places[j][2] - first <= range_bytes and places[j][1] == places[j - 1][1] + places[j - 1][2]:
                j += 1
            last = places[j - 1][1] + places[j - 1][2]
            if last > size:
                raise ValueError(f"index of {url} points past its member")
            run = source.read_at(last - first, base + first)
            for key, offset, length in places[i:j]:
                yield key, zlib.decompress(run[offset - first : offset - first + length], 31)
            i = j


def read_archives(manifest: DataFrame, *, payloads: bool = False) -> DataFrame:
    """Return a row a record: ``id, uri, record_type, payload_digest, payload_bytes, refers_to`` (and ``payload``); ids as text.

    Digest and length are of the full payload; a response's are verified against the bytes read, and a mismatch
    raises. refers_to and a revisit's payload: null where there is none.
    """
    spark = manifest.sparkSession
    fields = [("id", pa.binary()), ("uri", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.binary())] + [("payload", pa.binary())] * payloads

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows)) if rows else [()] * len(fields)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields)], names=[n for n, _ in fields])

        for batch in batches:
            for url in batch.column(0).to_pylist():
                rows, held = [], 0
                for key, data in records_of(url):
                    warc, http, payload = parse(data)
                    digest, n = warc["WARC-Payload-Digest"].removeprefix("sha1:"), int(http["Content-Length"])
                    if warc["WARC-Record-ID"] != f"<urn:page:{key}>":
                        raise ValueError(f"index of {url} and record {key} disagree")
                    kind = warc["WARC-Type"]
                    if kind == "response" and (len(payload) != n or hashlib.sha1(payload).hexdigest() != digest):
                        raise ValueError(f"record {key} of {url} is damaged")
                    refers = warc.get("WARC-Refers-To")
                    rows.append((decode_id(key), warc["WARC-Target-URI"], kind, digest, n, refers and decode_id(refers[10:-1]), *([payload if kind == "response" else None] * payloads)))
                    held += len(payload) * payloads
                    if len(rows) >= 5000 or held >= RANGE_BYTES:
                        yield out(rows)
                        rows, held = [], 0
                yield out(rows)

    schema = "id binary, uri string, record_type string, payload_digest string, payload_bytes long, refers_to binary" + ", payload binary" * payloads
    found = manifest.select("path").repartition(partitions(spark)).mapInArrow(run, schema)
    return found.withColumn("id", F.col("id").cast("string")).withColumn("refers_to", F.col("refers_to").cast("string"))


def archive_folder(spark: SparkSession) -> str:
    """A new folder under the shared one, as a URI with its scheme: outside Spark a bare path would mean a local disk."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{run_dir(spark)}/warc-{uuid.uuid4().hex}")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
