"""Media columns: store bytes as media values, sniff what a value really is, read it back.

An Aho-Corasick automaton over the magic strings passes once over a value and gives every place where a
format could start. A validator per format then walks the structure from there (chunks, blocks, segments,
lengths) and returns where the media ends, or nothing. What is valid at offset 0 decides the value's type,
whatever was declared; what is valid further on, outside of what was found before, is carved.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.llm._shared import byte_parts, utf8_rows

BLOCK = 64
#: Media of about this size make an Arrow batch.
SLICE_BYTES = 8 << 20
RATE = 8000
UNKNOWN = "application/octet-stream"
# Magic strings, how far they stand from their media's start, and the type.
MAGIC = (
    (b"WAVEfmt ", 8, "audio/wav"),
    (b"\x89PNG\r\n\x1a\n", 0, "image/png"),
    (b"GIF87a", 0, "image/gif"),
    (b"GIF89a", 0, "image/gif"),
    (b"\xff\xd8\xff", 0, "image/jpeg"),
    (b"PK\x03\x04", 0, "application/zip"),
    (b"%PDF-", 0, "application/pdf"),
)


def wav(samples: bytes, rate: int = RATE) -> bytes:
    """Unsigned 8-bit mono PCM; a byte is a sample. An odd count gets the format's pad byte, outside of the data length."""
    pad = b"\0" * (len(samples) % 2)
    return b"RIFF" + struct.pack("<I", 36 + len(samples) + len(pad)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", len(samples)) + samples + pad


def wav_end(b: bytes, at: int) -> tuple[int, tuple[int, int]] | None:
    """End of the file, and the place of its samples."""
    if b[at : at + 4] != b"RIFF" or b[at + 8 : at + 12] != b"WAVE":
        return None
    end = at + 8 + int.from_bytes(b[at + 4 : at + 8], "little")
    if end > len(b):
        return None
    pos, fmt, data = at + 12, None, None
    while pos + 8 <= end:
        size = int.from_bytes(b[pos + 4 : pos + 8], "little")
        if pos + 8 + size > end:
            return None
        if b[pos : pos + 4] == b"fmt " and size >= 16:
            fmt = struct.unpack_from("<HHIIHH", b, pos + 8)
        elif b[pos : pos + 4] == b"data":
            data = (pos + 8, pos + 8 + size)
        pos += 8 + size + size % 2
    if fmt is None or data is None or fmt[0] != 1 or fmt[4] != fmt[1] * fmt[5] // 8 or fmt[3] != fmt[2] * fmt[4]:
        return None
    return end, data


def png_end(b: bytes, at: int) -> tuple[int, tuple[int, int]] | None:
    pos, first = at + 8, True
    while pos + 12 <= len(b):
        size, kind = int.from_bytes(b[pos : pos + 4], "big"), b[pos + 4 : pos + 8]
        stop = pos + 12 + size
        if stop > len(b) or first != (kind == b"IHDR") or zlib.crc32(b[pos + 4 : stop - 4]) != int.from_bytes(b[stop - 4 : stop], "big"):
            return None
        if kind == b"IEND":
            return stop, (at, stop)
        pos, first = stop, False
    return None


def gif_end(b: bytes, at: int) -> tuple[int, tuple[int, int]] | None:
    if at + 13 > len(b):
        return None
    pos = at + 13 + (3 << (b[at + 10] & 7) + 1 if b[at + 10] & 128 else 0)
    images = 0
    while pos < len(b):
        if b[pos] == 0x3B:
            return (pos + 1, (at, pos + 1)) if images else None
        if b[pos] == 0x21:
            pos += 2
        elif b[pos] == 0x2C and pos + 10 < len(b):
            pos += 11 + (3 << (b[pos + 9] & 7) + 1 if b[pos + 9] & 128 else 0)
            images += 1
        else:
            return None
        while pos < len(b) and b[pos]:
            pos += 1 + b[pos]
        pos += 1
    return None


def jpeg_end(b: bytes, at: int) -> tuple[int, tuple[int, int]] | None:
    pos = at + 2
    while pos + 4 <= len(b) and b[pos] == 0xFF:
        kind = b[pos + 1]
        size = int.from_bytes(b[pos + 2 : pos + 4], "big")
        if kind == 0xD9:
            return pos + 2, (at, pos + 2)
        if size < 2 or kind < 0xC0:
            return None
        pos += 2 + size
        if kind == 0xDA:  # coded data up to the next marker that is not stuffing or a restart
            while True:
                pos = b.find(b"\xff", pos)
                if pos < 0 or pos + 1 >= len(b):
                    return None
                if b[pos + 1] == 0xD9:
                    return pos + 2, (at, pos + 2)
                if b[pos + 1] and not 0xD0 <= b[pos + 1] <= 0xD7:
                    break
                pos += 2
    return None


def zip_end(b: bytes, at: int) -> tuple[int, tuple[int, int]] | None:
    """The end record whose directory size and offset agree with this start."""
    pos = b.find(b"PK\x05\x06", at)
    while pos >= 0 and pos + 22 <= len(b):
        size, start, note = struct.unpack_from("<IIH", b, pos + 12)
        if at + start + size == pos and b[at + start : at + start + 4] in (b"PK\x01\x02", b"PK\x05\x06") and pos + 22 + note <= len(b):
            return pos + 22 + note, (at, pos + 22 + note)
        pos = b.find(b"PK\x05\x06", pos + 1)
    return None


def pdf_end(b: bytes, at: int) -> tuple[int, tuple[int, int]] | None:
    """Up to the end mark after the first startxref that points at a table of this file."""
    pos = b.find(b"startxref", at)
    while pos >= 0:
        number = b[pos + 9 : pos + 32].split()
        mark = b.find(b"%%EOF", pos)
        if mark < 0:
            return None
        if number and number[0].isdigit() and (b[at + int(number[0]) :][:4] == b"xref" or b" obj" in b[at + int(number[0]) :][:20]):
            return mark + 5, (at, mark + 5)
        pos = b.find(b"startxref", pos + 1)
    return None


VALIDATORS = {"audio/wav": wav_end, "image/png": png_end, "image/gif": gif_end, "image/jpeg": jpeg_end, "application/zip": zip_end, "application/pdf": pdf_end}


@lru_cache(maxsize=1)
def _magic_automaton() -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for magic, back, kind in MAGIC:
        automaton.add_word(magic.decode("latin-1"), (len(magic) - 1 + back, kind))
    automaton.make_automaton()
    return automaton


def carve(value: bytes) -> list[tuple[int, int, str, tuple[int, int]]]:
    """(start, end, type, place of the payload) of the valid media of a value, outermost first, none inside another."""
    starts = sorted((end - back, kind) for end, (back, kind) in _magic_automaton().iter(value.decode("latin-1")))
    found, covered = [], 0
    for start, kind in starts:
        if start >= covered and (valid := VALIDATORS[kind](value, start)):
            found.append((start, valid[0], kind, valid[1]))
            covered = valid[0]
    return found


def sample_features(samples: bytes) -> str:
    """Count, sum, sum of squares, crossings of the middle level and a 16-bin histogram: integers, so equal for equal samples."""
    x = np.frombuffer(samples, np.uint8)
    high = x >= 128
    histogram = np.bincount(x >> 4, minlength=16)
    squares = int((np.bincount(x, minlength=256) * np.arange(256, dtype=np.int64) ** 2).sum())
    return f"n={len(x)};sum={int(x.sum(dtype=np.int64))};sq={squares};cross={int(np.count_nonzero(high[1:] != high[:-1]))};hist={'/'.join(map(str, histogram.tolist()))}"


def store_texts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Replace text_col by n_bytes, declared_type and media: the UTF-8 bytes, zero-filled to a positive multiple of 64, as WAV.

    The declared type is UNKNOWN on purpose: reading has to sniff. Null text counts as empty. Other columns and
    repeated rows stay; columns named like the three new ones are replaced.
    """
    kept = [c for c in docs.columns if c not in (text_col, "n_bytes", "declared_type", "media")]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField("n_bytes", T.LongType()), T.StructField("declared_type", T.StringType()), T.StructField("media", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in byte_parts(whole, len(kept), SLICE_BYTES):
                texts = utf8_rows(batch.column(len(kept)))
                media = [wav(t + bytes(-len(t) % BLOCK if t else BLOCK)) for t in texts]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(map(len, texts), pa.int64()), pa.array([UNKNOWN] * len(texts), pa.string()), pa.array(media, pa.binary())], names=schema.names)

    return docs.select(*(F.col(f"`{c}`") for c in [*kept, text_col])).mapInArrow(run, schema)


FOUND = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("type", T.StringType())]))
READ = [
    T.StructField("media_type", T.StringType()),
    T.StructField("media_bytes", T.LongType()),
    T.StructField("media_sha256", T.StringType()),
    T.StructField("payload_bytes", T.LongType()),
    T.StructField("payload_sha256", T.StringType()),
    T.StructField("tail_crc32", T.LongType()),
    T.StructField("feature", T.StringType()),
    T.StructField("carved", FOUND),
]


def read_media(table: DataFrame, media_col: str = "media") -> DataFrame:
    """Sniff media_col and replace it by media_type (corrected), sizes and digests of the stored form and of the
    payload read back (WAV: its samples; other types: the media itself), features and the carved media.

    Values without valid media at their start have media_type UNKNOWN and are their own payload. Null counts as
    empty. Other columns and repeated rows stay; columns named like the new ones are replaced.
    """
    new = [f.name for f in READ]
    kept = [c for c in table.columns if c not in (media_col, *new)]
    schema = T.StructType([table.schema[c] for c in kept] + READ)
    carved_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("type", pa.string())]))
    types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), carved_type]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for cell in batch.column(len(kept)):
                value = cell.as_py() or b""
                found = carve(value)
                kind, payload = UNKNOWN, value
                if found and found[0][0] == 0:
                    kind, payload = found[0][2], value[found[0][3][0] : found[0][3][1]]
                carved = [{"start": s, "end": e, "type": k} for s, e, k, _ in found]
                rows.append((kind, len(value), hashlib.sha256(value).hexdigest(), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), sample_features(payload), carved))
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in types]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=schema.names)

    return table.select(*(F.col(f"`{c}`") for c in [*kept, media_col])).mapInArrow(run, schema)
