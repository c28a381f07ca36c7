"""WARC archives: writing, reading back, and an index by external merge.

Pages are dealt into archives; each archive holds its captures sorted by URL key and time, so it is a
locally sorted run.  Each record is a gzip member of its own, so that it can be fetched by its place.  Archives go
through Spark's own text writer and its commit protocol, to any file system it knows: a row is a member's bytes, and what the
writer puts between rows is an empty gzip member, which unpacks to nothing.
Reading parses records by their lengths and checks digests.  The index entries of all runs are dealt
out by key range, as many ranges as the number of entries asks for, and within a range a loser tree merges the
runs into ordered capture histories.
"""

from __future__ import annotations

import base64
import hashlib
import io
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ._common import Scratch, lean, utf8

CRLF = "\r\n"
#: Payload bytes of an archive, about; a longer page has an archive's room for itself.
ARCHIVE_BYTES = 16 << 20
ENTRY = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, url_key string, captured string, archive string, record_offset long, record_bytes long"
#: Index entries that one task merges, about.
RANGE_ROWS = 200_000
#: An empty gzip member (header, empty block, checksum and size of nothing).
GAP = bytes([0x1F, 0x8B, 8, 0, 0, 0, 0, 0, 0, 0xFF, 3, 0, 0, 0, 0, 0, 0, 0, 0, 0])
#: Bytes unpacked at a time.
STEP = 1 << 16


def url_key(url: Column) -> Column:
    """Sort-friendly form: host labels reversed and joined by commas, then ``)`` and the rest, in lower case."""
    bare = F.lower(F.regexp_replace(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(www\.)?", ""))
    host = F.regexp_extract(bare, r"^([^/:?#]*)", 1)
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.substring(bare, F.length(host) + 1, F.length(bare)))


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", captured: Column | None = None) -> None:
    """Writes one record per row.

    Of rows with equal payloads the one with the largest id is a ``response``; those with smaller ids are
    ``revisit`` records that refer to it and carry no payload.  Null payload: empty.  Null ids: always a response.
    ``captured``: UTC time text; by default an hour count from 2024 by id.
    """
    spark = pages.sparkSession
    when = F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.coalesce(F.col(id_col).cast("long"), F.lit(0)) * 3600 % 1_000_000_000), "yyyy-MM-dd'T'HH:mm:ss'Z'") if captured is None else captured
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(body_col, F.lit("")).alias("body"), when.alias("captured"))
    rows = rows.withColumn("digest", F.sha1(F.col("body").cast("binary")))
    total, n = rows.agg(F.coalesce(F.sum(F.octet_length("body")), F.lit(0)), F.count("*")).first()
    scratch = Scratch(spark, "warc-links")
    known = rows.where("page_id is not null").select("page_id", "digest")
    groups = scratch.save(known.groupBy("digest").agg(F.max("page_id").alias("original"), F.min("page_id").alias("low")).where("low < original").drop("low"), "groups")
    revisits = scratch.save(known.join(groups, "digest").where("page_id < original").distinct(), "revisits")
    dealt = rows.join(revisits, ["page_id", "digest"], "left")
    size = F.octet_length("body")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), size.cast("string"), F.lit(CRLF * 2))
    first = F.col("original").isNull()
    name = lambda c: F.concat(F.lit("<urn:capture:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: "), F.when(first, "response").otherwise("revisit"),
        F.coalesce(F.concat(F.lit(f"{CRLF}WARC-Target-URI: "), F.replace(F.replace(F.replace(F.col("url"), F.lit("%0D"), F.lit("%0d")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))), F.lit("")),
        F.lit(f"{CRLF}WARC-Date: "), F.col("captured"), F.lit(f"{CRLF}WARC-Record-ID: "), name(F.col("page_id")), F.lit(f"{CRLF}WARC-Payload-Digest: sha1:"),
    )
    rest = F.concat(
        F.when(first, F.lit("")).otherwise(F.concat(F.lit(f"{CRLF}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{CRLF}WARC-Refers-To: "), name(F.col("original")))),
        F.lit(f"{CRLF}Content-Type: application/http; msgtype=response{CRLF}Content-Length: "), (F.octet_length(http) + F.when(first, size).otherwise(0)).cast("string"), F.lit(CRLF * 2), http,
    )
    records = dealt.select(url_key(F.col("url")).alias("k"), "captured", "page_id", head.alias("head"), "digest", rest.alias("rest"), F.when(first, F.col("body")).otherwise(F.lit("")).alias("body"))
    members = records.sortWithinPartitions("k", "captured", "page_id").select("head", "digest", "rest", "body").mapInArrow(lean(_members), "value binary")
    # the separator's bytes are given as the characters that this encoding makes of them; members are written as they are
    text = members.select(F.col("value").cast("string")).write.option("lineSep", GAP.decode("iso-8859-1")).option("encoding", "ISO-8859-1")
    text.option("maxRecordsPerFile", max(1, ARCHIVE_BYTES * n // max(total, 1))).text(path)
    scratch.drop("groups", "revisits")


def _members(batches):
    """Records as gzip members; the digest is written in base32."""
    for b in batches:
        out = []
        for head, digest, rest, body in zip(*(utf8(c) for c in b.columns)):
            z = zlib.compressobj(6, zlib.DEFLATED, 31)
            out.append(b"".join([z.compress(head + base64.b32encode(bytes.fromhex(digest.decode())) + rest), z.compress(body), z.compress(b"\r\n\r\n"), z.flush()]))
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])


def unpack(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """Offset, length and content of each gzip member that isn't empty."""
    view, at = memoryview(data), 0
    while at < len(view):
        z, out, start = zlib.decompressobj(31), [], at
        while not z.eof:
            part = view[at : at + STEP]
            if not part:
                raise ValueError(f"the member at {start} is cut off")
            out.append(z.decompress(part))
            at += len(part) - len(z.unused_data)
        if content := b"".join(out):
            yield start, at - start, content


def fetch(spark, path: str, archive: str, offset: int, size: int) -> tuple[dict[str, str], bytes]:
    """Header fields and block of the one record at a place that the index names; nothing else is read."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(f"{path}/{archive}")
    stream = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(p)
    try:
        stream.seek(offset)
        packed = bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, size))
    finally:
        stream.close()
    (_, fields, block), *_ = (r for _, _, x in unpack(packed) for r in parse(io.BytesIO(x)))
    return fields, block


def parse(stream) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Offset, header fields and block of each record of an unpacked archive."""
    offset = 0
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record at {offset}")
        size, fields = len(line), {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            size += len(line)
            k, _, v = line.decode("utf-8").partition(":")
            fields[k.strip().lower()] = v.strip()
        n = int(fields["content-length"])
        block = stream.read(n)
        if len(block) != n or stream.read(4) != b"\r\n\r\n":
            raise ValueError(f"broken record at {offset}")
        yield offset, fields, block
        offset += size + 2 + n + 4


def _capture(name: str | None) -> int | None:
    number = name[len("<urn:capture:") : -1] if name else "none"
    return None if number == "none" else int(number)


def read_archives(spark, path: str) -> DataFrame:
    """Index entries (``ENTRY``) of all records, in each archive's order; payload digests are checked."""

    def run(batches):
        for b in batches:
            for archive, content in zip(b.column(0).to_pylist(), b.column(1)):
                rows = []
                for offset, length, member in unpack(content.as_py()):
                    _, f, block = next(parse(io.BytesIO(member)))
                    head, _, payload = block.partition(b"\r\n\r\n")
                    size = int(head.lower().split(b"content-length:")[1].split(b"\r\n")[0])
                    digest = f["warc-payload-digest"].removeprefix("sha1:")
                    if f["warc-type"] == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                        raise ValueError(f"{archive}: the payload at {offset} isn't what its record says")
                    rows.append((_capture(f["warc-record-id"]), size, digest, f["warc-type"], _capture(f.get("warc-refers-to")), f.get("warc-target-uri"), None, f["warc-date"], archive.rpartition("/")[2], offset, length))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
    names = [x.split()[0] for x in ENTRY.split(", ")]
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInArrow(lean(run), ENTRY).withColumn("url_key", url_key(F.col("url")))


class LoserTree:
    """k-way merge: each inner node remembers the loser of its match, so a step replays one path of log2 k matches."""

    def __init__(self, runs: list[Iterable]):
        self.runs = [iter(r) for r in runs]
        self.k = len(self.runs)
        self.head = [next(r, None) for r in self.runs]
        self.loser = [-1] * self.k
        for i in range(self.k):
            self._replay(i)

    def _less(self, a: int, b: int) -> bool:
        x, y = self.head[a], self.head[b]
        return x is not None and (y is None or (x, a) < (y, b))

    def _replay(self, winner: int) -> None:
        node = (winner + self.k) // 2
        while node > 0:
            if self.loser[node] == -1:  # first round: wait here for the other side
                self.loser[node] = winner
                return
            if self._less(self.loser[node], winner):
                self.loser[node], winner = winner, self.loser[node]
            node //= 2
        self.loser[0] = winner

    def __iter__(self):
        if not self.k:
            return
        while (x := self.head[w := self.loser[0]]) is not None:
            yield x
            self.head[w] = next(self.runs[w], None)
            self._replay(w)


def merge_index(entries: DataFrame) -> DataFrame:
    """The entries in global order of URL key, time and id: capture histories across all archives.

    Key ranges (which split even one URL's history, and equal keys by their place) go to tasks; a task's share of each run stays
    in the run's order, and the loser tree merges the shares.
    """
    spark = entries.sparkSession
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-entries.count() // RANGE_ROWS))

    def run(batches):
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        table = pa.Table.from_batches(parts)
        order = ["archive", "record_offset"]
        table = table.sort_by([(c, "ascending") for c in order])  # each run as its archive holds it
        archive = table["archive"].to_pylist()
        keys = list(zip(table["url_key"].to_pylist(), table["captured"].to_pylist(), [(x is not None, x or 0) for x in table["page_id"].to_pylist()], range(len(archive))))
        starts = [i for i in range(len(archive)) if not i or archive[i] != archive[i - 1]]
        merged = LoserTree([keys[a:b] for a, b in zip(starts, [*starts[1:], len(keys)])])
        yield from table.take(pa.array([k[-1] for k in merged], pa.int64())).combine_chunks().to_batches()

    return entries.repartitionByRange(ranges, "url_key", "captured", "page_id", "archive", "record_offset").mapInArrow(lean(run), entries.schema)


def capture_history(pages: DataFrame, path: str | None = None, **columns) -> DataFrame:
    """Writes ``pages`` as archives under ``path`` (default: the shared folder), reads them back and returns the merged index.

    An empty table gives no rows; rows that repeat an id are records of their own.
    """
    scratch = Scratch(pages.sparkSession, "warc")
    path = path or scratch.path("archives")
    write_archives(pages, path, **columns)
    return merge_index(scratch.save(read_archives(pages.sparkSession, path), "entries"))
