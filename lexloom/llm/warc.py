"""WARC archives: write web pages as records, read archives back by boundary-chain verification.

Writing: the record of the smallest page_id among equal payloads is a `response`, others are `revisit`
records that name it and hold no payload. Spark's text writer puts the records into archive files in the shared folder.

Reading: archives are text files whose line separator is the record magic, so Spark splits them into byte ranges and
a task reads a range of any archive, whatever its size. What lies between two magic strings is a piece; its offset is
the sum of the pieces before it, in its range and in the ranges before. Each piece is a candidate record: a task emits its
offset and that of its successor (header end + Content-Length + the closing blank lines). Magic inside payloads
makes candidates too. Pointer jumping keeps just the candidates on the chain from the file's first byte: a range
follows its own candidates to where each one's chain leaves the range, jumps between ranges double each round, and
what is reachable in a range follows from where the chain enters it. A payload that holds the magic lies in
several pieces: they are joined once the chain is known.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.llm._shared import durable, shared_dir

#: What separates pieces; a minor version's digit and a line end follow in a record.
MAGIC = b"WARC/1."
END = "\r\n\r\n"
#: Repeated payloads up to this many rows are broadcast; more of them are joined by a shuffle.
BROADCAST_ROWS = 20_000

RECORD = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("at", T.LongType()),
        T.StructField("next", T.LongType()),
        T.StructField("size", T.LongType()),
        T.StructField("page_id", T.LongType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("refers_to", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("intact", T.BooleanType()),
    ]
)


def base32_sha1(payload: Column) -> Column:
    """SHA-1 as upper-case base32 without padding: five hex digits are four base32 digits."""
    digest = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def with_types(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Add payload_bytes, payload_digest, record_type and refers_to.

    Null html is an empty payload. Payloads smaller than least_bytes are all responses. Rows that share the
    smallest page_id of a payload (repeated rows) are all responses; a null page_id counts as the smallest.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.withColumns({"payload_bytes": F.octet_length(payload).cast("long"), "payload_digest": base32_sha1(payload.cast("binary"))})
    known = rows.where(F.col("payload_bytes") >= least_bytes).select("page_id", "payload_digest")
    # counts and minima are combined in the map tasks: a large group of copies makes one row for each of them
    repeated = known.groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"), F.max(F.col("page_id").isNull()).alias("nameless")).where("n > 1 AND NOT nameless")
    repeated = durable(repeated.select("payload_digest", "first"), "repeated-payloads")
    if repeated.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        revisit = F.when((F.col("payload_bytes") >= least_bytes) & (F.col("page_id") != F.col("first")), F.col("first"))
        typed = rows.join(F.broadcast(repeated), "payload_digest", "left").withColumn("refers_to", revisit).drop("first")
    else:  # by ids, so that payloads are not shuffled
        copies = known.join(repeated, "payload_digest").where("page_id <> first").select("page_id", "payload_digest", F.col("first").alias("refers_to")).distinct()
        typed = rows.join(copies, ["page_id", "payload_digest"], "left")
    return typed.withColumn("record_type", F.when(F.col("refers_to").isNull(), "response").otherwise("revisit"))


def record_text(page_id: Column, url: Column, html: Column, record_type: Column, refers_to: Column, size: Column, digest: Column) -> Column:
    """A record without its closing blank lines."""
    safe = F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("")), "%", "%25"), r"\r", "%0D")
    safe = F.regexp_replace(F.regexp_replace(safe, r"\n", "%0A"), "WARC/", "WARC%2F")
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    payload = F.when(record_type == "response", F.coalesce(html, F.lit(""))).otherwise("")
    head = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.0"),
        F.concat(F.lit("WARC-Type: "), record_type),
        F.concat(F.lit("WARC-Record-ID: "), urn(page_id)),
        F.concat(F.lit("WARC-Target-URI: "), safe),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), digest),
        F.concat(F.lit("X-Payload-Length: "), size.cast("string")),
        F.when(record_type == "revisit", F.concat(F.lit("WARC-Refers-To: "), urn(refers_to))),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.octet_length(payload).cast("string")),
    )
    return F.concat(head, F.lit(END), payload)


def write(pages: DataFrame, folder: str | None = None, least_bytes: int = 0, records_per_file: int = 4000) -> str:
    """Write pages(page_id, url, html) as archive files; returns their folder (a new one where none is given)."""
    folder = folder or f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    typed = with_types(pages.select("page_id", "url", "html"), least_bytes)
    text = record_text(*(F.col(c) for c in ("page_id", "url", "html", "record_type", "refers_to", "payload_bytes", "payload_digest")))
    typed.select(text.alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", records_per_file).text(folder)
    return folder


_FIELD = re.compile(rb"([A-Za-z-]+):[ \t]*([^\r\n]*)\r\n")


def _number(value: bytes | None) -> int | None:
    digits = (value or b"").removeprefix(b"<urn:page:").removesuffix(b">")
    return int(digits) if re.fullmatch(rb"-?\d+", digits) else None


def parse(piece: bytes) -> tuple[dict[bytes, bytes], int, int] | None:
    """Header fields, where the payload begins and its length, of a piece behind the magic; None if it is no record's start."""
    if not re.match(rb"\d\r\n", piece):
        return None
    body = piece.find(b"\r\n\r\n")
    fields = {k.lower(): v for k, v in _FIELD.findall(piece, 3, body + 2)} if body >= 0 else {}
    length = _number(fields.get(b"content-length"))
    return None if length is None or length < 0 else (fields, body + 4, length)


def _jumps(at: np.ndarray, successor: np.ndarray) -> np.ndarray:
    """The place of each one's successor among the sorted offsets `at`; len(at) if it is not there."""
    n = len(at)
    place = np.searchsorted(at, successor)
    return np.where((place < n) & (at[np.minimum(place, n - 1)] == successor) & (successor > at), place, n) if n else place


def reachable(at: np.ndarray, successor: np.ndarray, start: int = 0) -> np.ndarray:
    """Which of the sorted offsets are on the chain from offset `start`: pointer jumping in log2(records) rounds."""
    n = len(at)
    jump = np.append(_jumps(at, successor), n)  # n: beyond the last record
    on = np.zeros(n + 1, bool)
    on[:n] = at == start
    for _ in range(max(1, n).bit_length() + 1):
        on[jump[on.nonzero()[0]]] = True
        jump = jump[jump]
    return on[:n]


def exits(at: np.ndarray, successor: np.ndarray) -> np.ndarray:
    """Where the chain from each of the sorted offsets leaves them, by pointer jumping."""
    n = len(at)
    jump, out = np.append(_jumps(at, successor), n), successor.copy()
    last = np.where(jump[:n] == n, np.arange(n), jump[:n])  # the last candidate known on the way
    for _ in range(max(1, n).bit_length()):
        last = last[last]
    return out[last] if n else out


CANDIDATE = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("block", T.LongType()),  # first byte of the range
        T.StructField("bytes", T.LongType()),  # of the piece and its magic
        T.StructField("at", T.LongType()),  # offset of the magic, from the range's first piece on, and so are next and leaves
        T.StructField("next", T.LongType()),
        T.StructField("leaves", T.LongType()),
        T.StructField("body", T.LongType()),  # offset of the payload
        T.StructField("page_id", T.LongType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("refers_to", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("intact", T.BooleanType()),
        T.StructField("split", T.BooleanType()),  # the record goes on in the next pieces
    ]
)
_KINDS = {T.StringType(): pa.string(), T.LongType(): pa.int64(), T.BooleanType(): pa.bool_()}
_ARROW = pa.schema([(f.name, _KINDS[f.dataType]) for f in CANDIDATE])


def _record(piece: bytes, found: tuple[dict[bytes, bytes], int, int]) -> tuple:
    """The fields of a candidate that its first piece tells: page_id to split."""
    fields, body, length = found
    kind = fields.get(b"warc-type", b"").decode("utf-8", "replace")
    digest = fields.get(b"warc-payload-digest", b"").decode("utf-8", "replace").removeprefix("sha1:")
    size = _number(fields.get(b"x-payload-length"))
    whole = len(piece) >= body + length + len(END)
    intact = whole and piece[body + length : body + length + len(END)] == END.encode()
    if kind == "response" and whole:
        size, digest, intact = _stored(piece[body : body + length], size, digest, intact)
    url = re.sub("%(25|0D|0A|2F)", lambda m: chr(int(m[1], 16)), fields.get(b"warc-target-uri", b"").decode("utf-8", "replace"))
    return _number(fields.get(b"warc-record-id")), kind, _number(fields.get(b"warc-refers-to")), url, size, digest, intact, not whole


def _stored(payload: bytes, size: int | None, named: str, closed: bool) -> tuple[int, str, bool]:
    """Length and digest of a stored payload, and whether they are what its header names (where it does)."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    return len(payload), digest, closed and named in ("", digest) and size in (None, len(payload))


def _pieces(spark: SparkSession, folder: str) -> DataFrame:
    lines = spark.read.option("lineSep", MAGIC.decode()).text(folder)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("piece"))


def _offsets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, bytes]]:
    """(file, block, offset of its magic in the range, piece) of every piece, range after range."""
    known, place = None, 0
    for batch in batches:
        for file, block, piece in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (file, block) != known:
                known, place = (file, block), 0
            yield file, block, place - len(MAGIC), piece
            place += len(piece) + len(MAGIC)


def candidates(spark: SparkSession, folder: str) -> DataFrame:
    """A row for every piece of the archives; those that are no record's start have themselves as successor."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in groupby(_offsets(batches), key=lambda x: x[:2]):
            # of a range only what its headers tell is held
            held = []
            for file, block, at, piece in rows:
                found = parse(piece) if at >= 0 or block else None
                size = len(piece) + len(MAGIC)
                if found is None:
                    held.append((file, block, size, at, at, at, *[None] * 8, False))
                else:
                    body = at + len(MAGIC) + found[1]
                    held.append((file, block, size, at, body + found[2] + len(END), 0, body, *_record(piece, found)))
            columns = [list(c) for c in zip(*held, strict=True)]
            columns[5] = exits(np.array(columns[3], np.int64), np.array(columns[4], np.int64)).tolist()
            yield from pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW).to_batches(max_chunksize=10_000)

    return _pieces(spark, folder).mapInArrow(find, CANDIDATE)


def _entries(found: DataFrame) -> DataFrame:
    """file, entry: the offsets at which the chain from each file's first byte enters a range."""
    reached = found.where("at = 0 AND next > at").select("file", F.col("at").alias("entry"))
    most = found.groupBy("file").agg(F.count_distinct("block").alias("n")).agg(F.max("n")).first()[0] or 0
    if most < 2:
        return reached
    jumps = found.where("next > at").select("file", F.col("at").alias("entry"), F.col("leaves").alias("to"))
    asked = reached.unionByName(jumps.select("file", F.col("to").alias("entry"))).distinct()
    jumps = durable(jumps.join(asked, ["file", "entry"], "left_semi"), "jumps")
    reached = durable(reached, "entries")
    for _ in range(most.bit_length()):
        onward = jumps.select("file", F.col("entry").alias("to"), F.col("to").alias("far"))
        arrived = reached.join(jumps, ["file", "entry"]).select("file", F.col("to").alias("entry")).join(asked, ["file", "entry"], "left_semi")
        reached = durable(reached.unionByName(arrived).distinct(), "entries")
        jumps = durable(jumps.join(onward, ["file", "to"], "left").select("file", "entry", F.coalesce("far", "to").alias("to")), "jumps")
    return reached


def read(spark: SparkSession, folder: str, strict: bool = True) -> DataFrame:
    """One row per record of the archives: file, at, next, size (of the archive, decompressed), page_id, record_type, refers_to,
    url, payload_bytes, payload_digest (of the stored payload for responses, as named for revisits) and intact (the record closes
    with blank lines and the stored payload has the digest and length that its header names).

    Records are of versions 1.0 to 1.9. Archives may be compressed (.gz), which a task then reads whole. A wrong length ends a
    file's chain: with `strict`, bytes behind the chain's end raise an error; else `unreached` tells of them.
    """
    records = _chained(spark, folder)
    if strict:
        lost = unreached(records).where("lost_bytes > 0").orderBy(F.desc("lost_bytes"), "file").limit(3).collect()
        if lost:
            raise ValueError("bytes that no chain reaches: " + ", ".join(f"{r['file']}: {r['lost_bytes']}" for r in lost))
    return records.where("record_type IS NOT NULL").select(*RECORD.names)


def unreached(records: DataFrame) -> DataFrame:
    """file, size, lost_bytes: how many bytes of each archive lie behind the end of its chain."""
    return records.groupBy("file").agg(F.max("size").alias("size"), (F.max("size") - F.coalesce(F.max(F.when(F.col("record_type").isNotNull(), F.col("next"))), F.lit(0))).alias("lost_bytes"))


def _chained(spark: SparkSession, folder: str) -> DataFrame:
    """The records on the chains, and for each archive a row without record_type."""
    rows = durable(candidates(spark, folder), "candidates")
    ranges = rows.groupBy("file", "block").agg(F.sum("bytes").alias("bytes"))
    by_file = Window.partitionBy("file")
    base = F.coalesce(F.sum("bytes").over(by_file.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # the last piece has no magic behind it
    placed = ranges.select("file", "block", base.alias("base"), (F.sum("bytes").over(by_file) - len(MAGIC)).alias("size"))
    placed = durable(placed, "ranges")
    found = rows.join(F.broadcast(placed) if placed.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else placed, ["file", "block"])
    found = found.withColumns({c: F.col(c) + F.col("base") for c in ("at", "next", "leaves", "body")}).drop("bytes", "base")
    found = durable(found, "placed")
    entered = _entries(found).withColumnRenamed("entry", "at").withColumn("entered", F.lit(True))
    marked = found.join(entered, ["file", "at"], "left").select(*found.columns, "entered")

    def chain(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("at", kind="stable")
        at, after = group["at"].to_numpy(), group["next"].to_numpy()
        entry = at[group["entered"].notna().to_numpy()]
        on = np.logical_or.reduce([reachable(at, after, e) for e in entry]) if len(entry) else np.zeros(len(at), bool)
        group["on_chain"] = on & (after > at)
        return group.drop(columns="entered")

    schema = T.StructType([*found.schema.fields, T.StructField("on_chain", T.BooleanType())])
    known = durable(marked.groupBy("file", "block").applyInPandas(chain, schema), "chained")
    records = known.where("on_chain")
    if not records.where("split").isEmpty():
        records = records.where("NOT split").unionByName(_joined(spark, folder, known, placed))
    whole = placed.select("file", F.lit(0).cast("long").alias("at"), "size").distinct()
    return records.select(*RECORD.names).unionByName(whole, allowMissingColumns=True)


def _joined(spark: SparkSession, folder: str, known: DataFrame, placed: DataFrame) -> DataFrame:
    """The records on the chain that lie in several pieces, with length, digest and intactness from all of them."""
    owner = F.last(F.when(F.col("on_chain"), F.col("at")), ignorenulls=True).over(Window.partitionBy("file").orderBy("at"))
    owned = known.select("file", "at", owner.alias("owner"))
    split = known.where("on_chain AND split")
    wanted = owned.join(split.select("file", F.col("at").alias("owner")), ["file", "owner"])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, block, at, piece in _offsets(batches):
            yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([block]), pa.array([at]), pa.array([piece], pa.binary())], names=["file", "block", "at", "piece"])

    pieces = _pieces(spark, folder).mapInArrow(number, "file string, block long, at long, piece binary").join(placed, ["file", "block"])
    pieces = pieces.select("file", (F.col("at") + F.col("base")).alias("at"), "piece").join(wanted, ["file", "at"])
    parts = pieces.groupBy("file", "owner").agg(F.array_sort(F.collect_list(F.struct("at", "piece"))).alias("parts"))

    schema = T.StructType([f for f in known.schema.fields])

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for i in rows.index:
                value = MAGIC.join(p["piece"] for p in rows.at[i, "parts"])
                body, length = int(rows.at[i, "body"] - rows.at[i, "at"]) - len(MAGIC), int(rows.at[i, "next"] - rows.at[i, "body"]) - len(END)
                closed = value[body + length : body + length + len(END)] == END.encode()
                size = rows.at[i, "payload_bytes"]
                if rows.at[i, "record_type"] == "response":
                    found = _stored(value[body : body + length], None if pd.isna(size) else int(size), rows.at[i, "payload_digest"], closed)
                    rows.at[i, "payload_bytes"], rows.at[i, "payload_digest"], rows.at[i, "intact"] = found
                else:
                    rows.at[i, "intact"] = closed
            yield rows.drop(columns="parts")

    return split.join(parts.withColumnRenamed("owner", "at"), ["file", "at"]).select(*known.columns, "parts").mapInPandas(join, schema)
