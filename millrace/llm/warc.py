"""WARC archives with a two-level capture index.

``write_archives`` writes one record per page into gzip-membered archive files
in the shared folder: a *response* with the payload, or a *revisit* that
refers to the response with equal payload. Only digests and ids are shuffled
to find equal payloads; a page whose payload nobody repeats is written where
it is read, and so is one of the ``HOT`` payloads that most pages share. Just
the others of repeated payload travel, joined by digest.

``build_index`` sorts the captures by reversed-host URL key into compressed
blocks, each index file ending with its sparse directory: the first key and
the place of every block. The table it returns has a row per index file.
``CaptureIndex.lookup`` binary-searches files and directory, range-reads one
block, binary-searches its lines and range-reads the record. ``lookup_all``
does the same for a table of URLs: the keys are dealt to the blocks that may
hold them, every block is read once, and records that lie close together are
read by one range. ``read_archives`` streams every archive back instead.

Null html is an empty payload; a null url has no target header and sorts
first in the index; a null page_id is kept (written as ``-``). Of rows with
equal payloads those with the largest page_id are responses (all of them if
rows repeat), others revisit it. An empty table gives no archive and no rows.
Files are named by attempt, and only files that a committed table names are
read, so lost executors leave at worst an unused file.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bit_filter, bits_set, cut, discard, scratch, ship, small_batches, until_exit

#: Bytes after which an archive file is closed and the next one begun.
ARCHIVE_BYTES = 1 << 30
#: Captures in one compressed index block.
BLOCK_ROWS = 3000
#: Payloads that more than one page in HOT has; there are at most HOT of them, so every task gets them all.
HOT = 1000
#: Bits of the filter over repeated payloads (16 MB in all).
FILTER_BITS = 1 << 27
#: Records no further apart than GAP are read by one range of at most RANGE bytes.
GAP, RANGE = 1 << 16, 1 << 23
_LEVEL = 4
_NO_BLANKS = re.compile(r"[\x00-\x20\x7f]")


def surt(url: str | None) -> str:
    """Reversed-host key: ``https://a.b.org/x?y`` gives ``org,b,a)/x?y``."""
    if not url:
        return ""
    try:
        u = urlsplit(url.strip())
        host = (u.hostname or "").removeprefix("www.")
    except ValueError:
        return _NO_BLANKS.sub("%20", url.lower())
    rest = (u.path or "/") + (f"?{u.query}" if u.query else "")
    return _NO_BLANKS.sub("%20", ",".join(reversed(host.split("."))) + ")" + rest).lower()


def _open(path: str, write: bool = False):
    fs, at = pafs.FileSystem.from_uri(path)
    return fs.open_output_stream(at, compression=None) if write else fs.open_input_file(at)


def _make_dir(path: str) -> None:
    fs, at = pafs.FileSystem.from_uri(path)
    fs.create_dir(at, recursive=True)


def _member(data: bytes) -> bytes:
    c = zlib.compressobj(_LEVEL, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to, revisit: bool) -> bytes:
    """One WARC record as a gzip member."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    own = "-" if page_id is None else page_id
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:capture:{own}>", "WARC-Date: 2024-01-01T00:00:00Z"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20]", lambda m: f"%{ord(m[0]):02X}", url))
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        lines += [f"WARC-Refers-To: <urn:capture:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return _member("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Headers of a record, headers of its HTTP block, and the payload."""
    at = data.index(b"\r\n\r\n")
    head = dict(x.split(": ", 1) for x in data[:at].decode().split("\r\n")[1:])
    n = int(head["Content-Length"])
    block = data[at + 4 : at + 4 + n]
    if len(block) != n or data[at + 4 + n :] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    at = block.index(b"\r\n\r\n")
    http = dict(x.split(": ", 1) for x in block[:at].decode().split("\r\n")[1:])
    return head, http, block[at + 4 :]


def _id(header: str):
    own = header[len("<urn:capture:") : -1]
    return None if own == "-" else int(own)


_CAPTURE = pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
_CAPTURE_DDL = "key string, page_id long, file string, offset long, length long"
_WAITING = pa.schema([*_CAPTURE, ("url", pa.string()), ("html", pa.string()), ("sha", pa.binary())])


def _batch(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


class _Archive:
    """The archive files that one task writes."""

    def __init__(self, folder: str):
        self.folder, self.out, self.name, self.at = folder, None, "", 0

    def add(self, data: bytes) -> tuple[str, int, int]:
        if self.out is None or self.at >= ARCHIVE_BYTES:
            self.close()
            self.name, self.at = f"{self.folder}/{uuid.uuid4().hex}.warc.gz", 0
            _make_dir(self.folder)
            self.out = _open(self.name, write=True)
        self.out.write(data)
        self.at += len(data)
        return self.name, self.at - len(data), len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


def write_archives(pages: DataFrame, root: str) -> DataFrame:
    """Write archives under ``root``; one committed row per capture, with its place."""
    spark = pages.sparkSession
    small_batches(spark)
    ship(spark)
    p = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), F.coalesce(pages["html"].cast("string"), F.lit("")).alias("html"))
    p = p.withColumn("sha", F.unhex(F.sha1("html"))).withColumn("at", F.pmod(F.xxhash64("sha"), F.lit(FILTER_BITS)))
    # partly counted before the shuffle, so a payload that many pages share is a row a task
    repeated = cut(p.groupBy("sha").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1"), "repeated")
    total = p.count()
    hot = {bytes(r["sha"]): r["keeper"] for r in repeated.where(F.col("n") * HOT > total).select("sha", "keeper").collect()}  # fewer than HOT
    shared = spark.sparkContext.broadcast((bit_filter(F.xxhash64("sha"), repeated, FILTER_BITS), hot))
    folder = f"{root}/archives"

    def one(archive: _Archive, page_id, url: str | None, html: str, sha: bytes, keeper) -> tuple:
        data = record(page_id, url, html.encode("utf-8", "surrogatepass"), base64.b32encode(sha).decode(), keeper, page_id != keeper)
        return surt(url), page_id, *archive.add(data)

    def direct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, (bits, hot) = _Archive(folder), shared.value
        try:
            for batch in batches:
                if batch.num_rows:
                    maybe, rows = bits_set(bits, batch["at"].to_numpy()).tolist(), []
                    for (page_id, url, html, sha), wait in zip(zip(*(c.to_pylist() for c in batch.columns[:4]), strict=True), maybe, strict=True):
                        if wait and sha not in hot:
                            rows.append((None, page_id, None, None, None, url, html, sha))
                        else:
                            rows.append((*one(archive, page_id, url, html, sha, hot[sha] if wait else page_id), None, None, None))
                    yield _batch(rows, _WAITING)
        finally:
            archive.close()

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = _Archive(folder)
        try:
            for batch in batches:
                rows = [one(archive, page_id, url, html, sha, keeper if many else page_id) for page_id, url, html, sha, keeper, many in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
                if rows:
                    yield _batch(rows, _CAPTURE)
        finally:
            archive.close()

    first = cut(p.mapInArrow(direct, f"{_CAPTURE_DDL}, url string, html string, sha binary"), "written")
    written = first.where("file is not null").select(*_CAPTURE.names)
    waiting = first.where("file is null").select("page_id", "url", "html", "sha")
    if waiting.isEmpty():
        discard(repeated)
        return written
    # each payload here has at most one page in HOT
    late = waiting.join(repeated.select("sha", "keeper", F.lit(True).alias("many")), "sha", "left").select("page_id", "url", "html", "sha", "keeper", F.coalesce("many", F.lit(False)).alias("many"))
    rest = cut(late.mapInArrow(joined, _CAPTURE_DDL), "captures")
    discard(repeated)
    return written.unionByName(rest)


_BACK = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def _read_back(data: bytes) -> tuple:
    """A row of the read-back: the payload hashed anew and held against the record's digest.

    A revisit's size and digest are those that its headers state.
    """
    head, http, payload = parse(data)
    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
    if head["WARC-Type"] == "revisit":
        return _id(head["WARC-Record-ID"]), int(http["Content-Length"]), digest, "revisit", _id(head["WARC-Refers-To"])
    if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
        raise ValueError("a payload's digest is wrong")
    return _id(head["WARC-Record-ID"]), len(payload), digest, head["WARC-Type"], None


def members(stream) -> Iterator[bytes]:
    """The gzip members of an open file, one after another, in bounded memory."""
    left = b""
    while True:
        d, parts = zlib.decompressobj(31), []
        while not d.eof:
            left = left or stream.read(1 << 20)
            if not left:
                if parts:
                    raise ValueError("an archive ends within a record")
                return
            parts.append(d.decompress(left))
            left = d.unused_data
        yield b"".join(parts)


_BACK_DDL = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_archives(captures: DataFrame) -> DataFrame:
    """Stream all archives that ``captures`` names; one row per record read."""
    ship(captures.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch[0].to_pylist():
                rows = []
                with _open(name) as f:
                    for data in members(f):
                        rows.append(_read_back(data))
                        if len(rows) == 10_000:
                            yield _batch(rows, _BACK)
                            rows = []
                if rows:
                    yield _batch(rows, _BACK)

    return captures.select("file").distinct().mapInArrow(run, _BACK_DDL)


_FILES = pa.schema([("first_key", pa.string()), ("last_key", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("blocks", pa.int64()), ("captures", pa.int64())])
_FILES_DDL = "first_key string, last_key string, file string, offset long, length long, blocks long, captures long"


def build_index(captures: DataFrame, root: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Sorted, compressed index blocks under ``root``; returns a row per index file with the place of its directory."""
    ship(captures.sparkSession)
    folder = f"{root}/index"
    parts = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # page_id follows the key, so that one key of many captures still splits
    ranged = captures.select("key", "page_id", "file", "offset", "length").repartitionByRange(parts, "key", "page_id").sortWithinPartitions("key", "page_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, name, at, lines, blocks, total, last = None, "", 0, [], [], 0, ""

        def flush():
            nonlocal out, name, at
            if out is None:
                _make_dir(folder)
                name = f"{folder}/{uuid.uuid4().hex}.cdx.gz"
                out = _open(name, write=True)
            data = _member("".join(lines).encode("utf-8", "surrogatepass"))
            out.write(data)
            blocks.append((lines[0].split(" ", 1)[0], at, len(data)))
            at += len(data)
            lines.clear()

        for batch in batches:
            for key, page_id, file, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                # a key has no blank, so the line splits at the first one
                lines.append(f"{key} {json.dumps([page_id, file.rsplit('/', 1)[1], offset, length])}\n")
                total, last = total + 1, key
                if len(lines) == block_rows:
                    flush()
        if lines:
            flush()
        if out is not None:
            directory = _member(json.dumps(blocks).encode())
            out.write(directory)
            out.close()
            yield _batch([(blocks[0][0], last, name, at, len(directory), len(blocks), total)], _FILES)

    return cut(ranged.mapInArrow(run, _FILES_DDL), "index")


def _files(index: DataFrame) -> list[tuple]:
    """The index files by key: (first key, last key, file, place of the directory). One for each sorted partition."""
    return sorted(map(tuple, index.select("first_key", "last_key", "file", "offset", "length").collect()))


def _directory(name: str, offset: int, length: int) -> list[tuple[str, int, int]]:
    with _open(name) as f:
        return [tuple(x) for x in json.loads(zlib.decompress(f.read_at(length, offset), 31))]


def _block(name: str, offset: int, length: int) -> list[str]:
    with _open(name) as f:
        return zlib.decompress(f.read_at(length, offset), 31).decode("utf-8", "surrogatepass").split("\n")[:-1]


def _blocks_of(key: str, files: list[tuple], ends: list[str], directory) -> Iterator[tuple[str, int, int]]:
    """The blocks (file, offset, length) that may hold ``key``."""
    at = bisect.bisect_left(ends, key)
    while at < len(files) and files[at][0] <= key:
        blocks = directory(*files[at][2:])
        i = max(0, bisect.bisect_left(blocks, (key,)) - 1)
        while i < len(blocks) and blocks[i][0] <= key:
            yield files[at][2], blocks[i][1], blocks[i][2]
            i += 1
        at += 1


def _captures_of(key: str, lines: list[str], archives: str) -> Iterator[tuple[str, int, int]]:
    """The places (archive, offset, length) of a key's captures in a block."""
    i = bisect.bisect_left(lines, key + " ")
    while i < len(lines) and lines[i].split(" ", 1)[0] == key:
        _, file, offset, length = json.loads(lines[i].split(" ", 1)[1])
        yield f"{archives}/{file}", offset, length
        i += 1


def _fetch(places: list[tuple[str, int, int]]) -> Iterator[bytes]:
    """Records by range reads, those close together by one; in no order."""
    places, i = sorted(places), 0
    while i < len(places):
        file = places[i][0]
        with _open(file) as f:
            while i < len(places) and places[i][0] == file:
                lo, j = places[i][1], i + 1
                hi = lo + places[i][2]
                while j < len(places) and places[j][0] == file and places[j][1] <= hi + GAP and places[j][1] + places[j][2] - lo <= RANGE:
                    hi = max(hi, places[j][1] + places[j][2])
                    j += 1
                data = f.read_at(hi - lo, lo)
                for _, offset, length in places[i:j]:
                    yield zlib.decompress(data[offset - lo : offset - lo + length], 31)
                i = j


class CaptureIndex:
    """Lookups by URL; holds the list of index files, and reads the rest as it is asked for."""

    def __init__(self, index: DataFrame):
        self.files = _files(index)
        self.keys, self.ends = [f[0] for f in self.files], [f[1] for f in self.files]

    def lookup(self, url: str | None) -> list[tuple[dict, dict, bytes]]:
        """All captures of a URL, as parsed records."""
        key, out = surt(url), []
        for name, offset, length in _blocks_of(key, self.files, self.ends, _directory):
            archives = name.rsplit("/", 2)[0] + "/archives"
            out += map(parse, _fetch(list(_captures_of(key, _block(name, offset, length), archives))))
        return out


_ASK = pa.schema([("key", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
_ASK_DDL = "key string, file string, offset long, length long"


def lookup_all(urls: DataFrame, index: DataFrame) -> DataFrame:
    """Every capture of the different keys of ``urls`` (url), each read back through the index."""
    spark = urls.sparkSession
    ship(spark)
    files = spark.sparkContext.broadcast(_files(index))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([surt(u) for u in b[0].to_pylist()], pa.string())], names=["key"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends, now = [f[1] for f in files.value], [None, None]

        def directory(*place):  # keys come in order, so one directory is held at a time
            if now[0] != place:
                now[:] = place, _directory(*place)
            return now[1]

        for b in batches:
            rows = [(key, *place) for key in b[0].to_pylist() for place in _blocks_of(key, files.value, ends, directory)]
            for lo in range(0, len(rows), 10_000):
                yield _batch(rows[lo : lo + 10_000], _ASK)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, lines, places = None, [], []
        for b in batches:
            rows = []
            for key, *at in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if at != place:
                    rows += map(_read_back, _fetch(places))
                    place, lines, places = at, _block(*at), []
                places += _captures_of(key, lines, at[0].rsplit("/", 2)[0] + "/archives")
            rows += map(_read_back, _fetch(places))
            places = []
            if rows:
                yield _batch(rows, _BACK)

    asked = urls.select(F.col("url").cast("string")).mapInArrow(keys, "key string").distinct()
    # in key order a task needs few directories; a key of very many captures goes to as many blocks, each read once
    dealt = asked.repartitionByRange(parts, "key").sortWithinPartitions("key").mapInArrow(blocks, _ASK_DDL)
    # a number of parts is given: a row stands for a whole block, so parts of few bytes mustn't be merged
    return dealt.repartition(parts, "file", "offset").sortWithinPartitions("file", "offset", "key").mapInArrow(read, _BACK_DDL)


def archive_round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write archives and index of ``pages``, then read every record back by its URL."""
    root = scratch(spark, "warc")
    until_exit(spark, root)
    return lookup_all(pages.select("url"), build_index(write_archives(pages, root), root))
