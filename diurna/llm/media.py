"""Media columns: types from signatures rather than declarations, and media carved out of other bytes.

Aho-Corasick finds every magic number in one pass. A validator per format then reads the structure from
there and gives the length; what it does not confirm is not reported.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


#: Bytes that a check of a compressed medium inflates at once.
INFLATED = 1 << 20


class Found(NamedTuple):
    offset: int
    length: int
    kind: str


def _u32le(b: bytes, at: int) -> int:
    return int.from_bytes(b[at : at + 4], "little")


def _u32be(b: bytes, at: int) -> int:
    return int.from_bytes(b[at : at + 4], "big")


def png(b: bytes, at: int) -> tuple[int, str] | None:
    """Chunks with right checksums from IHDR to IEND."""
    here, first = at + 8, True
    while here + 12 <= len(b):
        size, kind = _u32be(b, here), b[here + 4 : here + 8]
        end = here + 12 + size
        if end > len(b) or first != (kind == b"IHDR") or zlib.crc32(b[here + 4 : end - 4]) != _u32be(b, end - 4):
            return None
        if kind == b"IEND":
            return end - at, "image/png"
        here, first = end, False
    return None


def gif(b: bytes, at: int) -> tuple[int, str] | None:
    """Blocks from the screen descriptor to the trailer."""
    if b[at : at + 6] not in (b"GIF87a", b"GIF89a") or at + 13 > len(b):
        return None
    here = at + 13 + (3 << (b[at + 10] & 7) + 1 if b[at + 10] & 0x80 else 0)
    while here < len(b):
        if b[here] == 0x3B:
            return here + 1 - at, "image/gif"
        if b[here] == 0x21:
            here += 2
        elif b[here] == 0x2C and here + 10 <= len(b):
            flags = b[here + 9]
            here += 11 + (3 << (flags & 7) + 1 if flags & 0x80 else 0)
        else:
            return None
        while here < len(b) and b[here]:
            here += b[here] + 1
        here += 1
    return None


def jpeg(b: bytes, at: int) -> tuple[int, str] | None:
    """Segments from SOI to EOI; entropy-coded data is passed over up to the next marker."""
    here, frame = at + 2, False
    while here + 2 <= len(b) and b[here] == 0xFF:
        marker = b[here + 1]
        if marker == 0xD9:
            return (here + 2 - at, "image/jpeg") if frame else None
        if marker == 0x01 or 0xD0 <= marker <= 0xD7:
            here += 2
            continue
        size = int.from_bytes(b[here + 2 : here + 4], "big")
        if size < 2 or here + 2 + size > len(b):
            return None
        frame |= 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC)
        here += 2 + size
        if marker == 0xDA:
            while True:
                here = b.find(b"\xff", here)
                if here < 0 or here + 1 >= len(b):
                    return None
                if b[here + 1] != 0 and not 0xD0 <= b[here + 1] <= 0xD7:
                    break
                here += 2
    return None


RIFF_FORMS = {b"WAVE": ("audio/wav", b"fmt "), b"WEBP": ("image/webp", b"VP8"), b"AVI ": ("video/x-msvideo", b"LIST")}


def riff(b: bytes, at: int) -> tuple[int, str] | None:
    """Chunks that fill the outer length exactly, the first of the form's own kind."""
    end = at + 8 + _u32le(b, at + 4)
    kind, first = RIFF_FORMS.get(b[at + 8 : at + 12], (None, None))
    if kind is None or end > len(b) or not b.startswith(first, at + 12):
        return None
    here = at + 12
    while here + 8 <= end:
        size = _u32le(b, here + 4)
        here += 8 + size + size % 2
    return (end - at, kind) if here == end else None


def bmp(b: bytes, at: int) -> tuple[int, str] | None:
    """A header that agrees with the size of the pixels."""
    size, pixels, header = _u32le(b, at + 2), _u32le(b, at + 10), _u32le(b, at + 14)
    if at + 30 > len(b) or header not in (40, 52, 56, 108, 124) or not 14 + header <= pixels <= size or at + size > len(b) or b[at + 6 : at + 10] != bytes(4):
        return None
    width, height, planes, depth, packed = struct.unpack_from("<iiHHI", b, at + 18)
    row = (abs(width) * depth + 31) // 32 * 4
    return (size, "image/bmp") if planes == 1 and (packed or pixels + row * abs(height) <= size) else None


def gzip(b: bytes, at: int) -> tuple[int, str] | None:
    """A member that inflates to its end, where zlib compares checksum and length."""
    if at + 18 > len(b) or b[at + 3] & 0xE0:
        return None
    inflate, here, piece = zlib.decompressobj(31), at, b""
    try:
        while not inflate.eof and (piece or here < len(b)):
            if not piece:
                piece = b[here : here + 65536]
                here += len(piece)
            inflate.decompress(piece, INFLATED)  # what comes out is only checked, a bounded part at a time
            piece = inflate.unconsumed_tail
        while not inflate.eof and inflate.decompress(b"", INFLATED):
            pass
    except zlib.error:
        return None
    return (here - len(inflate.unused_data) - at, "application/gzip") if inflate.eof else None


@functools.lru_cache(maxsize=8)
def places(b: bytes, mark: bytes) -> list[int]:
    """Where ``mark`` stands; looked up once for all magic numbers of a text."""
    out, at = [], b.find(mark)
    while at >= 0:
        out.append(at)
        at = b.find(mark, at + 1)
    return out


def zipped(b: bytes, at: int) -> tuple[int, str] | None:
    """A central directory whose place and size lead back to this first entry."""
    for here in directories(b).get(at, ()):
        note = int.from_bytes(b[here + 20 : here + 22], "little")
        if here + 22 + note <= len(b) and b.startswith(b"PK\x01\x02", at + _u32le(b, here + 16)):
            return here + 22 + note - at, "application/zip"
    return None


@functools.lru_cache(maxsize=2)
def directories(b: bytes) -> dict[int, list[int]]:
    """First entry that each end of a central directory leads back to -> those ends, in order."""
    out: dict[int, list[int]] = {}
    for here in places(b, b"PK\x05\x06"):
        if here + 22 <= len(b):
            out.setdefault(here - _u32le(b, here + 12) - _u32le(b, here + 16), []).append(here)
    return out


def pdf(b: bytes, at: int) -> tuple[int, str] | None:
    """A version, and a cross-reference pointer before the first end marker."""
    if not b[at + 5 : at + 6].isdigit():
        return None
    ends, marks = places(b, b"%%EOF"), places(b, b"startxref")
    end, mark = bisect.bisect_left(ends, at), bisect.bisect_left(marks, at)
    ok = end < len(ends) and mark < len(marks) and marks[mark] + 9 <= ends[end]
    return (ends[end] + 5 - at, "application/pdf") if ok else None


@functools.cache
def _page_table() -> list[int]:
    """Of the checksum with the polynomial 0x04c11db7, high bits first."""
    out = []
    for k in range(256):
        x = k << 24
        for _ in range(8):
            x = (x << 1) ^ (0x04C11DB7 if x & 0x80000000 else 0)
        out.append(x & 0xFFFFFFFF)
    return out


def _page_sum(page: bytes) -> int:
    table, x = _page_table(), 0
    for c in page:
        x = (x << 8 & 0xFFFFFFFF) ^ table[x >> 24 ^ c]
    return x


def ogg(b: bytes, at: int) -> tuple[int, str] | None:
    """Pages of one stream from its first to its last, in sequence, each with its checksum. A later page starts no file."""
    if at + 27 > len(b) or not b[at + 5] & 2:
        return None
    here, serial, number = at, b[at + 14 : at + 18], _u32le(b, at + 18)
    while b.startswith(b"OggS\0", here) and here + 27 <= len(b):
        count = b[here + 26]
        end = here + 27 + count + sum(b[here + 27 : here + 27 + count])
        if end > len(b) or b[here + 14 : here + 18] != serial or _u32le(b, here + 18) != number:
            return None
        if _page_sum(b[here : here + 22] + bytes(4) + b[here + 26 : end]) != _u32le(b, here + 22):
            return None
        if b[here + 5] & 4:
            return end - at, "application/ogg"
        here, number = end, number + 1 & 0xFFFFFFFF
    return None


def mp4(b: bytes, at: int) -> tuple[int, str] | None:
    """Boxes from ftyp on; a moov box must be among them. The magic stands four bytes into the file."""
    here, moov = at - 4, False
    while 0 <= here and here + 8 <= len(b) and b[here + 4 : here + 8].isalnum():
        size = _u32be(b, here)
        if size < 8 or here + size > len(b):
            break
        moov |= b[here + 4 : here + 8] == b"moov"
        here += size
    return (here - (at - 4), "video/mp4") if moov else None


#: Magic bytes -> (validator, bytes before the magic).
SIGNATURES = {
    b"\x89PNG\r\n\x1a\n": (png, 0),
    b"GIF8": (gif, 0),
    b"\xff\xd8\xff": (jpeg, 0),
    b"RIFF": (riff, 0),
    b"BM": (bmp, 0),
    b"\x1f\x8b\x08": (gzip, 0),
    b"PK\x03\x04": (zipped, 0),
    b"%PDF-": (pdf, 0),
    b"OggS": (ogg, 0),
    b"ftyp": (mp4, 4),
}


@functools.cache
def _matcher() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for magic in SIGNATURES:
        out.add_word(magic.decode("latin-1"), magic)
    out.make_automaton()
    return out


def carve(content: bytes) -> list[Found]:
    """Every medium that its validator confirms, by offset; what lies inside another one included."""
    out = []
    for end, magic in _matcher().iter(content.decode("latin-1")):
        validate, before = SIGNATURES[magic]
        at = end + 1 - len(magic)
        if at >= before and (found := validate(content, at)):
            out.append(Found(at - before, *found))
    return sorted(out)


def sniff(rows: DataFrame, *, content: str = "media", declared: str = "declared", keep: list[str] | None = None) -> DataFrame:
    """``rows`` with ``kind, corrected, length, embedded`` added, and only the columns ``keep`` (all where None).

    ``kind`` is the type of the medium at offset 0, or ``application/octet-stream``; ``corrected`` says that
    it differs from the declared type; ``length`` is its own length (that of the bytes where no type is
    confirmed); ``embedded`` lists other media as (offset, length, kind). Null content has nulls and an
    empty list. New columns replace ones of the same name.
    """
    new = ["kind", "corrected", "length", "embedded"]
    base = rows.select(*[c for c in (keep if keep is not None else rows.columns) if c not in new])
    inner = F.struct(F.col(content).alias("content"), F.col(declared).alias("declared"))
    packed = rows.select(F.struct(*base.columns).alias("row"), inner.alias("found"))
    schema = f"row {packed.schema['row'].dataType.simpleString()}, kind string, corrected boolean, length bigint, embedded array<struct<offset:bigint,length:bigint,kind:string>>"
    item = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("kind", pa.string())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            contents, said = batch.column(1).flatten()
            out: list[list] = [[], [], [], []]
            for value, declared_kind in zip(contents, said.to_pylist()):
                value = value.as_py()
                if value is None:
                    values = (None, None, None, [])
                else:
                    media = carve(value)
                    own = next((m for m in media if m.offset == 0), Found(0, len(value), "application/octet-stream"))
                    rest = [m._asdict() for m in media if m is not own]
                    values = (own.kind, own.kind != declared_kind, own.length, rest)
                for column, x in zip(out, values):
                    column.append(x)
            kinds = (pa.string(), pa.bool_(), pa.int64(), item)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(out, kinds)]], ["row", *new])

    return packed.mapInArrow(work, schema).select("row.*", *new)


UNIT, RATE = 64, 8000


def as_wave(payload: bytes) -> bytes:
    """8-bit mono samples, one a byte, in a RIFF container."""
    head = struct.pack("<4sIHHIIHH4sI", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload))
    body = b"WAVE" + head + payload + bytes(len(payload) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def samples(media: bytes) -> bytes:
    """The data chunk of a wave file that ``riff`` confirms."""
    here = 12
    while media[here : here + 4] != b"data":
        here += 8 + _u32le(media, here + 4) + _u32le(media, here + 4) % 2
    return media[here + 8 : here + 8 + _u32le(media, here + 4)]


def store_texts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc, n_bytes, declared, media``: each text as samples, padded with zeros to a positive multiple of 64.

    The declared type is the general one for bytes, for ``sniff`` to correct. A null text is an empty one.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("payload"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, media = [], []
            for value in batch.column(1):
                value = value.as_py()
                sizes.append(len(value))
                media.append(as_wave(value.ljust(max(UNIT, -(-len(value) // UNIT) * UNIT), b"\0")))
            declared = pa.array(["application/octet-stream"] * len(media), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), declared, pa.array(media, pa.binary())], ["doc", "n_bytes", "declared", "media"])

    return written(rows.mapInArrow(work, "doc bigint, n_bytes bigint, declared string, media binary"), "media")


def feature(data: bytes) -> str:
    """Mean, spread and sign changes of the samples around their middle, as whole numbers."""
    x = np.frombuffer(data, np.uint8)
    counts = np.bincount(x, minlength=256)
    total, squares = int(counts @ np.arange(256)), int(counts @ np.arange(256) ** 2)
    high = x >= 128
    return f"mean={total * 1000 // len(x)},power={squares // len(x)},crossings={int(np.count_nonzero(high[1:] != high[:-1]))},peak={int(np.flatnonzero(counts)[-1])}"


def media_report(docs: DataFrame) -> DataFrame:
    """What was stored for each document, read back through its sniffed type.

    ``n_bytes`` of the text, ``payload_bytes``, ``payload_sha256`` and ``tail_crc32`` of the samples read back,
    ``media_bytes`` and ``media_sha256`` of the stored file, and ``feature``: type, statistics of the samples and the
    number of media found inside. A null text is an empty one; rows that share an id each have their own.
    """
    stored = sniff(store_texts(docs))
    schema = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    names = ["doc", "n_bytes", "kind", "length", "media", "embedded"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs_, sizes, kinds, lengths, contents, inside = batch.columns
            out: list[list] = [[], [], [], [], [], []]
            for kind, length, value, found in zip(kinds.to_pylist(), lengths.to_pylist(), contents, inside.to_pylist()):
                value = value.as_py()
                if kind != "audio/wav":
                    raise ValueError(f"a stored text was read back as {kind}")
                data = samples(value[:length])
                text = f"{kind};{feature(data)};embedded={len(found)}"
                values = (len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-UNIT:]), len(value), hashlib.sha256(value).hexdigest(), text)
                for column, x in zip(out, values):
                    column.append(x)
            kinds_ = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([docs_, sizes, *[pa.array(c, k) for c, k in zip(out, kinds_)]], [f.split()[0] for f in schema.split(", ")])

    return stored.select(*names).mapInArrow(work, schema)
