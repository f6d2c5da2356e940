"""Sharding by extendible hashing.

The directory is indexed by the leading bits of a row's hash: 32 bits of its key's hash, then 32 bits of its
content's hash, so that one key with too many bytes can still be split. A bucket is split on one more bit
only while it is larger than the byte limit; so a shard is the shortest prefix whose rows fit.

The bits are taken LEVEL at a time: one aggregate gives the bytes of each cell of a level (2^LEVEL at most for
each bucket that is still open), sums over the shorter prefixes of the cells give the first that fits, and
only buckets that no prefix of this level makes small enough go on to the next level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm._shared import durable

LEVEL = 16
BITS = 64
#: Directory entries that may be broadcast; a larger directory is joined by a shuffle.
BROADCAST_ENTRIES = 1 << 16


def _hash32(c: Column) -> Column:
    return F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("long")


def hash_bits(df: DataFrame, key_col: str, content_col: str) -> Column:
    """The row's 64 bits as a string of 0 and 1. Null key or content count as texts of their own."""
    binary = lambda c: F.lpad(F.bin(_hash32(c)), 32, "0")
    key = F.coalesce(F.col(f"`{key_col}`").cast("string"), F.lit("\0null"))
    content = F.coalesce(F.col(f"`{content_col}`").cast("string"), F.lit("\0null"))
    return F.concat(binary(key), binary(content))


def directory(rows: DataFrame, limit: int) -> tuple[DataFrame, list[int]] | None:
    """The directory of rows(bits, n_bytes): (cell, entry, level) per cell, and the levels it has; None if all rows fit one shard.

    One aggregate for each LEVEL bits: the bytes of the cells of buckets that are still open, and sums over the shorter
    prefixes of the cells; the first that fits is the cell's entry.
    """
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    if total <= limit:
        return None
    found_all, open_rows, base = None, rows.select("bits", "n_bytes"), 0
    while True:
        top = base + LEVEL
        cells = open_rows.groupBy(F.substring("bits", 1, top).alias("cell")).agg(F.sum("n_bytes").alias("n_bytes"), F.count("*").alias("n"))
        cells = durable(cells, "sharding-cells")
        prefixes = cells.select("cell", "n_bytes", F.explode(F.sequence(F.lit(base + 1), F.lit(top))).alias("depth")).withColumn("prefix", F.expr("substring(cell, 1, depth)"))
        fits = prefixes.groupBy("prefix", "depth").agg(F.sum("n_bytes").alias("total")).where(F.col("total") <= limit)
        if top >= BITS:
            fits = fits.select("prefix", "depth").unionByName(cells.select(F.col("cell").alias("prefix"), F.lit(BITS).alias("depth")))
        shortest = prefixes.join(fits.select("prefix", "depth"), ["prefix", "depth"]).groupBy("cell").agg(F.min("depth").alias("depth"))
        found = durable(shortest, f"sharding-depths-{top}")
        entries = found.select(F.expr("substring(cell, 1, depth)").alias("entry"), F.lit(top).alias("level"), "cell")
        found_all = entries if found_all is None else found_all.unionByName(entries)
        if top >= BITS:
            break
        still = durable(cells.join(found, "cell", "left_anti").select("cell"), "sharding-open")
        n_open = still.limit(BROADCAST_ENTRIES + 1).count()
        if not n_open:
            break
        hint = F.broadcast(still) if n_open <= BROADCAST_ENTRIES else still
        open_rows = open_rows.join(hint, F.substring("bits", 1, top) == F.col("cell"), "left_semi")
        base = top
    return found_all, list(range(LEVEL, base + LEVEL + 1, LEVEL))


def _placed(rows: DataFrame, found: tuple[DataFrame, list[int]] | None) -> DataFrame:
    """rows(bits, ...) with the directory entry that begins their bits, as column `shard`; the directory comes to the rows while it is small."""
    if found is None:
        return rows.withColumn("shard", F.lit(""))
    entries, levels = found
    names = rows.columns
    for top in levels:
        part = entries.where(F.col("level") == top).select(F.col("cell").alias(f"cell_{top}"), F.col("entry").alias(f"entry_{top}"))
        part = F.broadcast(part) if part.limit(BROADCAST_ENTRIES + 1).count() <= BROADCAST_ENTRIES else part
        rows = rows.join(part, F.substring("bits", 1, top) == F.col(f"cell_{top}"), "left")
    return rows.select(*names, F.coalesce(*(F.col(f"entry_{t}") for t in levels)).alias("shard"))


def _measured(df: DataFrame, key_col: str, content_col: str, kept: Column) -> DataFrame:
    size = F.coalesce(F.octet_length(F.col(f"`{content_col}`").cast("string")), F.lit(0)).cast("long")
    return df.select(kept, size.alias("n_bytes"), hash_bits(df, key_col, content_col).alias("bits"))


def assign(df: DataFrame, limit: int, key_col: str = "doc_id", content_col: str = "text", bits_col: str = "shard_bits") -> DataFrame:
    """Return key_col, content bytes (n_bytes) and the shard of every row as shard_bits, a string of 0 and 1.

    Every shard holds at most `limit` bytes, but for a single row, or rows equal in key and content, that are
    larger: these share all 64 bits and make one shard of the full depth. With everything within the limit,
    or no rows, the directory has the one entry "". Null content has 0 bytes. Repeated rows stay.
    """
    rows = durable(_measured(df, key_col, content_col, F.col(f"`{key_col}`").alias("key")), "sharding")
    placed = _placed(rows, directory(rows, limit))
    return placed.select(F.col("key").alias(key_col), "n_bytes", F.col("shard").alias(bits_col))


def write(df: DataFrame, folder: str, limit: int, key_col: str = "doc_id", content_col: str = "text") -> None:
    """Write df, one folder shard=bits per shard, its rows in column `row`. A shard's rows meet in one task, which the limit bounds.

    A row's own bits choose its shard: contents of one key may lie in several.
    """
    sizes = durable(_measured(df, key_col, content_col, F.col(f"`{key_col}`").alias("key")).select("bits", "n_bytes"), "sharding")
    rows = _measured(df, key_col, content_col, F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row")).drop("n_bytes")
    placed = _placed(rows, directory(sizes, limit)).drop("bits")
    # a folder's name has a letter first, so that readers do not take the bits for a number
    placed.withColumn("shard", F.concat(F.lit("b"), "shard")).repartition("shard").write.partitionBy("shard").parquet(folder)
