"""WARC archives through Spark's own readers and writers, so that any file system Spark knows will do.

Each record is a gzip member of its own. Reading splits files into byte ranges: a task cuts its range at the
gzip magic and owns the records that start inside it. Three bytes prove little, so each candidate member is
inflated and its WARC header decoded; where a magic turns out to lie inside another member, the pieces are
put together again, across ranges too.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_folder

MAGIC = b"\x1f\x8b\x08"
#: Bytes that a member inflates to at once.
INFLATED = 1 << 22
#: Payloads below this many bytes are never revisits.
LEAST_REVISIT = 100
#: A gzip member of nothing; its last byte is zero, as every row's has to be.
NOTHING = zlib.compressobj(9, zlib.DEFLATED, 31)
NOTHING = NOTHING.compress(b"") + NOTHING.flush()
DATE = "2024-01-01T00:00:00Z"
SAME = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def member(record: bytes) -> bytes:
    """A record as a gzip member. The length that ends it is below 2 ** 24, or an empty member follows."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    out = packer.compress(record) + packer.flush()
    return out if out.endswith(b"\0") else out + NOTHING


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None) -> bytes:
    """A response, or a revisit of the page ``first``: HTTP headers only, with the full payload's length."""
    revisit = first is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", "", url or ""))
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if revisit:
        head += [f"WARC-Profile: {SAME}", f"WARC-Refers-To: <urn:page:{first}>"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_warc(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """A WARC record per row, in gzip members, to the folder ``path``; a file for each task.

    Of rows with equal payloads of 100 bytes or more, the one with the smallest id is a response and the
    others revisit it; smaller payloads and rows without an id are responses. Of repeated rows with the
    smallest id, all are responses. A null html is empty, a null url too.
    """
    rows = pages.select(F.col(id_col).cast("bigint").alias("id"), F.col(url_col).cast("string").alias("url"), F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    large = rows.where(F.octet_length("payload") >= LEAST_REVISIT)
    # Only digests that occur twice come back; a hot one is counted before the shuffle and its join can be split.
    firsts = large.groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("digest").alias("same"), "first")
    refers = rows.join(firsts, F.col("digest") == F.col("same"), "left")
    refers = refers.withColumn("first", F.when(F.col("id") != F.col("first"), F.col("first"))).select("id", "url", "payload", "digest", "first")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for id_, url, payload, digest, first in zip(*batch.columns):
                out.append(member(record(id_.as_py(), url.as_py(), payload.as_py(), digest.as_py(), first.as_py()))[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["member"])

    # The text writer ends each row with its separator: here the zero byte that every member ends with.
    refers.mapInArrow(work, "member binary").select(F.col("member").cast("string").alias("value")).write.option("lineSep", "\0").text(path)


def parse(data: bytes) -> tuple[dict[str, str], bytes] | None:
    """Headers (names in lower case) and block of a WARC record, or None where it is not a whole one."""
    if not data.startswith(b"WARC/"):
        return None
    head, found, rest = data.partition(b"\r\n\r\n")
    pairs = [line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:]]
    headers = {k.strip().lower(): v.strip() for k, _, v in pairs}
    size = headers.get("content-length", "")
    return (headers, rest[: int(size)]) if found and size.isdigit() and len(rest) >= int(size) else None


class Member:
    """A gzip member that is read piece by piece. ``state``: open, whole, or bad.

    What inflates to its end is a member, of a WARC or of anything else; of the latter only the length is kept.
    """

    def __init__(self) -> None:
        self.inflate, self.out, self.size, self.raw, self.state = zlib.decompressobj(31), [], 0, [], "open"

    def add(self, piece: bytes) -> None:
        self.raw.append(piece)
        try:
            while piece and not self.inflate.eof:
                self.take(self.inflate.decompress(piece, INFLATED))
                piece = self.inflate.unconsumed_tail
            while self.inflate.eof is False and (rest := self.inflate.decompress(b"", INFLATED)):
                self.take(rest)
        except zlib.error:
            self.state = "bad"
            return
        if self.inflate.eof:
            self.state = "whole"

    def take(self, data: bytes) -> None:
        if self.size < 5 or self.out:
            self.out.append(data)
        self.size += len(data)
        if self.size >= 5 and self.out and not b"".join(self.out[:5])[:5] == b"WARC/":
            self.out = []

    @property
    def data(self) -> bytes:
        return b"".join(self.out)


def members(pieces: Iterator[bytes]) -> Iterator[tuple[str, bytes]]:
    """What pieces that each start at a magic hold, in order: ("record", inflated bytes) of each member,
    ("head", piece) of pieces before the first member, which belong to an earlier range, and ("tail", pieces)
    of a member that they do not end."""
    todo: deque[bytes] = deque()
    pieces, now, leading = iter(pieces), None, True
    while True:
        piece = todo.popleft() if todo else next(pieces, None)
        if piece is None:
            break
        now = now or Member()
        now.add(piece)
        if now.state == "whole":
            yield "record", now.data
            now, leading = None, False
        elif now.state == "bad":  # its first magic begins no member; each later one is a candidate again
            if leading:
                yield "head", now.raw[0]
            todo.extendleft(reversed(now.raw[1:]))
            now = None
    if now is not None:
        yield "tail", b"".join(now.raw)


RECORD = "record_type string, record_id string, target_uri string, date string, refers_to string, payload_digest string, http_length bigint, payload binary"


def fields(data: bytes) -> tuple | None:
    """The columns of RECORD; the payload is what follows the HTTP headers of a response, null for others."""
    if (found := parse(data)) is None:
        return None
    headers, block = found
    head, _, body = block.partition(b"\r\n\r\n")
    kind = headers.get("warc-type")
    http = re.search(rb"(?im)^content-length:\s*(\d+)", head)
    length = int(http[1]) if http and kind in ("response", "revisit") else None
    names = ("warc-record-id", "warc-target-uri", "warc-date", "warc-refers-to", "warc-payload-digest")
    return (kind, *(headers.get(n) for n in names), length, body if kind == "response" else None)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """A row per record of the archives at ``path``, with the columns of RECORD.

    Files may be split anywhere. Spark's readers inflate files whose names end in .gz as one stream, from the start,
    before this one sees them: such files are read whole, a task each (``read_streams``). Members that a false magic
    at the edge of a range tore apart are put together by a second read that keeps only such pieces. Members that are
    no WARC record, and bytes between members, are left out. No archive, no rows.
    """
    return _read_ranges(spark, path, {"pathGlobFilter": "{*[!z],*[!g]z,*[!.]gz}"}).unionByName(read_streams(spark, path))


def read_streams(spark: SparkSession, path: str) -> DataFrame:
    """The records of files that Spark inflates by their names (.gz): cut where a record may begin, and put together
    again to the length that its header gives. A record is held in memory, not the file."""
    begin = b"WARC/1."
    cuts = spark.read.option("encoding", "ISO-8859-1").option("lineSep", begin.decode()).option("pathGlobFilter", "*.gz").text(path)
    pieces = cuts.select(F.encode("value", "ISO-8859-1").alias("piece"), F.col("_metadata.file_path").alias("file"))

    def records(rows: Iterator[tuple[str, bytes]]) -> Iterator[tuple | None]:
        for _, group in itertools.groupby(rows, key=lambda r: r[0]):
            next(group)  # what a file has before its first record
            held: list[bytes] = []
            for _, piece in group:
                held.append(begin + piece)
                data = b"".join(held)
                if (found := fields(data)) is not None:
                    yield found
                    held = []
                elif (size := declared(data)) is None or len(data) > size:
                    held = []

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(records((file, piece.as_py()) for batch in batches for piece, file in zip(batch.column(0), batch.column(1).to_pylist())))

    return pieces.mapInArrow(work, RECORD)


def declared(data: bytes) -> int | None:
    """Bytes that a record that begins here has by its header; as many as there are where the header goes on."""
    head, found, _ = data.partition(b"\r\n\r\n")
    if not found:
        return len(data) if len(data) < 1 << 20 else None
    size = re.search(rb"(?im)^content-length:\s*(\d+)", head)
    return len(head) + 4 + int(size[1]) if size else None


def _read_ranges(spark: SparkSession, path: str, options: dict[str, str]) -> DataFrame:
    cuts = spark.read.options(**options).option("encoding", "ISO-8859-1").option("lineSep", MAGIC.decode("latin-1")).text(path)
    pieces = cuts.select(F.col("value").cast("binary").alias("piece"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, Iterator[bytes]]]:
        def rows():
            for batch in batches:
                for piece, file, start in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                    yield file, start, piece.as_py()

        for (file, start), group in itertools.groupby(rows(), key=lambda r: r[:2]):
            if start == 0:
                next(group)  # what a file has before its first magic
            yield file, start, (MAGIC + r[2] for r in group)

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, group in ranges(batches):
            yield from _batches(fields(data) for kind, data in members(group) if kind == "record")

    def torn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, start, group in ranges(batches):
            found, fresh = [], False
            for kind, data in members(group):
                if kind == "record":
                    fresh = True
                else:
                    found.append((file, start, len(found), fresh, data))
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
            columns = zip(*found) if found else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["file", "start", "nth", "fresh", "raw"])

    def mended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0):
                # Cut at every magic again: a tail may have swallowed the start of a later member.
                again = (MAGIC + x for x in raw.as_py().split(MAGIC)[1:])
                yield from _batches(fields(data) for kind, data in members(again) if kind == "record")

    parts = pieces.mapInArrow(torn, "file string, start bigint, nth bigint, fresh boolean, raw binary")
    # What a range could not place goes on from the range before, unless whole records came first.
    order = Window.partitionBy("file").orderBy("start", "nth")
    runs = parts.withColumn("run", F.sum(F.col("fresh").cast("bigint")).over(order))
    joined = runs.groupBy("file", "run").agg(F.array_sort(F.collect_list(F.struct("start", "nth", "raw"))).alias("xs"))
    raw = joined.select(F.expr("aggregate(xs, cast('' as binary), (b, x) -> concat(b, x.raw))").alias("raw"))
    return pieces.mapInArrow(records, RECORD).union(raw.mapInArrow(mended, RECORD))


#: Rows of a batch that readers hand on.
BATCH = 512


def _batches(rows: Iterator[tuple | None]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(c.split()[0], {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}[c.split()[1]]) for c in RECORD.split(", ")])
    rows = (r for r in rows if r is not None)
    while some := list(itertools.islice(rows, BATCH)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), schema.types)], schema.names)


def archive_report(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record read back."""
    spark = pages.sparkSession
    path = new_folder(spark, "warc")
    write_warc(pages, path)
    page = F.expr("try_cast(nullif(regexp_extract({}, '^<urn:page:(-?[0-9]+)>$', 1), '') as bigint)".format("record_id"))
    first = F.expr("try_cast(nullif(regexp_extract(refers_to, '^<urn:page:(-?[0-9]+)>$', 1), '') as bigint)")
    whole = F.col("record_type") == "response"
    return read_warc(spark, path).select(
        page.alias("page_id"),
        F.when(whole, F.octet_length("payload").cast("bigint")).otherwise(F.col("http_length")).alias("payload_bytes"),
        F.when(whole, F.sha2("payload", 256)).otherwise(F.substring_index("payload_digest", ":", -1)).alias("payload_digest"),
        "record_type",
        first.alias("refers_to"),
    )


REPORT_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""
