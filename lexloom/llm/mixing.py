"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Sizes are words. Sources have target words by weight (water filling, at most MOST times a source's size).
Each source is cut into blocks by a hash of its documents, about PER_SHARD to a shard's words and FEWEST_BLOCKS at
least; a pass over a source uses each block once. A source whose target is r times its size takes floor(r) whole
passes and, of one more pass, the blocks that come first in a seeded permutation, up to the target: of its last
block the documents with the smallest hashes. These are exact block quotas. With `whole`, the last document is
taken whole or not at all, whichever ends nearer the target; without, as many of its words as are still due.

The splitting tree deals the quotas to output shards: the root holds the quota vector of all sources; a node with
more than shard_words draws how many blocks of each source go to its left half from the multivariate
hypergeometric distribution, and the rest goes right. A node's counts say how many blocks it draws from each source's
permuted block list, after those of the nodes before it; so shards are disjoint. A leaf is a shard: it has at most
shard_words, or is one block that is larger. In a shard, documents are in the order of a seeded hash.

The driver holds one row per source (that is what weights are given for; more than MAX_SOURCES raise an error) and
one per block: about PER_SHARD times all words over shard_words, 2.8 million at 100 TB and the usual shard_words. No document reaches it.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.llm._shared import WORD_PATTERN, durable

MOST = 3
#: Blocks of a source: so many to a shard's words (a power of two in all), and at least.
PER_SHARD, FEWEST_BLOCKS = 8, 64
FINE = 1 << 12
MAX_SOURCES = 100_000
SHARD_WORDS = 50_000_000
#: Ranges of a shard's order that are shuffled to a task each.
RANGES = 32
#: Plans up to this many rows are broadcast.
BROADCAST_ROWS = 1 << 16
WEIGHTS = (5, 2, 1)
SEED = 20


def n_words(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+`; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def fill_targets(sizes: list[int], weights: list[int], most: int = MOST) -> list[Fraction]:
    """Share sum(sizes) by weight; what is above most * size is shared anew by weight among the others, until none is above."""
    targets: list[Fraction] = [Fraction(0)] * len(sizes)
    left, active = Fraction(sum(sizes)), [i for i in range(len(sizes))]
    while active:
        total = sum(weights[i] for i in active)
        share = {i: left * weights[i] / total if total else Fraction(0) for i in active}
        over = [i for i in active if share[i] > most * sizes[i]]
        for i in over or active:
            targets[i] = Fraction(most * sizes[i]) if over else share[i]
            left -= targets[i]
        active = [i for i in active if i not in set(over)] if over else []
    return targets


def deal(words: list[np.ndarray], shard_words: int, seed: int = SEED) -> list[np.ndarray]:
    """The shard of every unit: per source, units in order with their words. Shards are the leaves of the splitting tree, from left to right."""
    sizes = np.array([len(w) for w in words], np.int64)
    base = np.cumsum(sizes) - sizes
    before = np.concatenate([np.zeros(1, np.int64), *words]).cumsum()  # words before each unit, of all sources in turn
    out = np.zeros(int(sizes.sum()), np.int64)
    some = np.flatnonzero(sizes)
    todo, shard = [(1, base[some], base[some] + sizes[some])] if len(some) else [], 0
    while todo:
        node, low, high = todo.pop()
        count = high - low
        if count.sum() == 1 or int((before[high] - before[low]).sum()) <= shard_words:
            for a, b in zip(low.tolist(), high.tolist(), strict=True):
                out[a:b] = shard
            shard += 1
            continue
        left = np.random.default_rng([seed, node]).multivariate_hypergeometric(count, int(count.sum()) // 2, method="marginals")
        middle = low + left
        todo.append((2 * node + 1, middle[middle < high], high[middle < high]))
        todo.append((2 * node, low[low < middle], middle[low < middle]))
    return np.split(out, np.cumsum(sizes)[:-1]) if len(sizes) else []


PLAN = pa.schema(
    [
        ("plan_source", pa.string()),
        ("plan_block", pa.int32()),
        ("plan_size", pa.int64()),
        ("plan_target", pa.float64()),
        ("plan_passes", pa.int32()),  # how often the whole block is taken
        ("plan_shards", pa.list_(pa.int32())),  # shard of each of these, and of the cut use
    ]
)


def _measure(docs: DataFrame, *kept: Column) -> DataFrame:
    """doc_id, source, size, the hashes of a document's places (block, cell of the block, place in the cell) and what is kept.

    The places are hashes of doc_id and size, without an id of the text too.
    """
    unnamed = F.when(F.col("doc_id").isNull(), F.xxhash64("text"))  # null for the others: adds nothing to their hash
    sized = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), unnamed.alias("unnamed"), *kept)
    hashed = lambda salt: F.xxhash64(F.lit(salt), F.lit(SEED), "doc_id", "size", "unnamed")
    return sized.withColumns({"block_hash": hashed("block"), "fine": F.pmod(hashed("fine"), F.lit(FINE)).cast("int"), "place": hashed("place")}).drop("unnamed")


def _in_blocks(measured: DataFrame, sources: DataFrame) -> DataFrame:
    """Add the block; sources(blocks_source, blocks) has a row per source."""
    joined = measured.join(F.broadcast(sources), measured["source"].eqNullSafe(sources["blocks_source"]))
    return joined.withColumn("block", F.pmod("block_hash", F.col("blocks")).cast("int")).drop("blocks_source", "blocks", "block_hash")


def _permuted(n: int, source: int, epoch: int) -> np.ndarray:
    return np.random.default_rng([SEED, source, epoch]).permutation(n)


def plan(docs: DataFrame, shard_words: int = SHARD_WORDS, whole: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(measured, sources, table): the documents' doc_id and places, the blocks of a source, and the PLAN rows with where their part pass ends."""
    spark = docs.sparkSession
    measured = durable(_measure(docs.select("doc_id", "source", "text")), "mixing")
    totals = measured.groupBy("source").agg(F.sum("size").alias("words")).limit(MAX_SOURCES + 1).collect()
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"weights are meant for at most {MAX_SOURCES} sources")
    by_source = sorted(((r["source"], r["words"]) for r in totals), key=lambda x: (x[0] is None, x[0] or ""))
    names, sizes = [s for s, _ in by_source], [w for _, w in by_source]
    n_blocks = [max(FEWEST_BLOCKS, 1 << max(0, -(-PER_SHARD * w // shard_words) - 1).bit_length()) for w in sizes]
    sources = spark.createDataFrame(list(zip(names, n_blocks)), "blocks_source string, blocks int")
    measured = _in_blocks(measured, sources)
    # map tasks combine: a row for each block and task is shuffled, and one for each block reaches the driver
    summed = measured.groupBy("source", "block").agg(F.sum("size").alias("words")).toArrow()
    number = {s: i for i, s in enumerate(names)}
    block_source = np.array([number[s] for s in summed.column(0).to_pylist()], np.int64)
    order = np.lexsort((summed.column(1).to_numpy(), block_source))
    block, words = summed.column(1).to_numpy()[order], summed.column(2).to_numpy()[order]
    edges = np.searchsorted(block_source[order], np.arange(len(names) + 1))
    targets = fill_targets(sizes, [WEIGHTS[i % len(WEIGHTS)] for i in range(len(names))])
    units: list[np.ndarray] = []  # per source: places in its block list, in permuted order, pass after pass
    unit_words: list[np.ndarray] = []
    cuts: list[tuple[str | None, int, int] | None] = []  # per source: the block that the part pass cuts, and the words due of it
    for i, source in enumerate(names):
        held = words[edges[i] : edges[i + 1]]
        due = round(targets[i])
        full = min(MOST, due // sizes[i]) if sizes[i] else 0
        rest = due - full * sizes[i]
        passes = [_permuted(len(held), i, p) for p in range(full)]
        cut = None
        if rest > 0:
            last = _permuted(len(held), i, full)
            reached = held[last].cumsum()
            n = min(int(np.searchsorted(reached, rest)) + 1, len(last))
            passes.append(last[:n])
            if reached[n - 1] > rest:
                cut = (source, int(block[edges[i] + last[n - 1]]), int(rest - (reached[n - 1] - held[last[n - 1]])))
        units.append(np.concatenate(passes) if passes else np.zeros(0, np.int64))
        unit_words.append(held[units[-1]].copy())
        if cut:
            unit_words[-1][-1] = cut[2]
        cuts.append(cut)
    columns: list[list] = [[] for _ in PLAN]
    for i, shards in enumerate(deal(unit_words, shard_words)):
        n = int(edges[i + 1] - edges[i])
        turn = np.argsort(units[i], kind="stable")  # a block's uses, in order of their passes
        uses = np.bincount(units[i], minlength=n)
        own = np.split(shards[turn].astype(np.int32), np.cumsum(uses)[:-1]) if n else []
        blocks = block[edges[i] : edges[i + 1]].tolist()
        cut_block = cuts[i][1] if cuts[i] else None
        columns[0] += [names[i]] * n
        columns[1] += blocks
        columns[2] += [sizes[i]] * n
        columns[3] += [float(targets[i])] * n
        columns[4] += [int(u) - (b == cut_block) for u, b in zip(uses.tolist(), blocks, strict=True)]
        columns[5] += own
    rows = pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, PLAN, strict=True)], schema=PLAN)
    table = spark.createDataFrame(rows)
    at = _cut_places(measured, [c for c in cuts if c], whole)
    table = table.join(F.broadcast(at), table["plan_source"].eqNullSafe(at["cut_source"]) & (table["plan_block"] == at["cut_block"]), "left").drop("cut_source", "cut_block")
    return measured, sources, F.broadcast(table) if rows.num_rows <= BROADCAST_ROWS else table


def _cut_places(measured: DataFrame, cuts: list[tuple[str | None, int, int]], whole: bool) -> DataFrame:
    """Where each source's part pass ends (one row a source at most): cell and place, and the words due of a document there.

    With `whole`, these are all words or none.

    First by sums over the FINE cells of the cut block, then by the documents of one cell.
    """
    given = F.broadcast(measured.sparkSession.createDataFrame(cuts, "cut_source string, cut_block int, due long"))
    same = F.col("source").eqNullSafe(F.col("cut_source")) & (F.col("block") == F.col("cut_block"))
    cells = measured.join(given, same).groupBy("cut_source", "cut_block", "due", "fine").agg(F.sum("size").alias("words"))
    cell = F.broadcast(_crossing(cells, "fine").select("cut_source", "cut_block", F.col("fine").alias("cut_fine"), F.col("still").alias("due")))
    inside = measured.join(cell, same & (F.col("fine") == F.col("cut_fine")))
    places = inside.groupBy("cut_source", "cut_block", "cut_fine", "due", "place").agg(F.sum("size").alias("words"), F.count("*").alias("n"))
    due = F.when(F.col("still") * 2 > F.col("words"), F.col("words")).otherwise(0) if whole else F.floor(F.col("still") / F.col("n"))
    return _crossing(places, "place").select("cut_source", "cut_block", "cut_fine", F.col("place").alias("cut_place"), due.cast("long").alias("cut_words"))


def _crossing(table: DataFrame, order: str) -> DataFrame:
    """The row of each source at which the running sum of words reaches `due`, with what is `still` due there."""
    running = F.sum("words").over(Window.partitionBy("cut_source", "cut_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    before = table.withColumn("before", running - F.col("words"))
    return before.where((F.col("before") < F.col("due")) & (F.col("before") + F.col("words") >= F.col("due"))).withColumn("still", F.col("due") - F.col("before"))


def _decide(measured: DataFrame, table: DataFrame) -> DataFrame:
    """Add the plan's columns and part, the words of the part pass that falls on a cut block (0 elsewhere)."""
    decided = measured.join(table, F.col("source").eqNullSafe(F.col("plan_source")) & (F.col("block") == F.col("plan_block")))
    at, end = F.struct("fine", "place"), F.struct(F.col("cut_fine").alias("fine"), F.col("cut_place").alias("place"))
    part = F.when(F.col("cut_fine").isNull(), 0).when(at < end, F.col("size")).when(at == end, F.least("size", "cut_words")).otherwise(0)
    return decided.withColumn("part", part.cast("long")).withColumn("uses", F.col("plan_passes") + F.when(F.col("part") > 0, 1).otherwise(0))


def taken(docs: DataFrame, shard_words: int = SHARD_WORDS, whole: bool = False) -> DataFrame:
    """doc_id, size, source_size, target, taken and shards (one per use of the document) of every document.

    Null text has size 0 and is taken with its block, adding no words. Repeated rows are taken each for itself,
    but where the cut falls on them they share its words evenly (with `whole`: all of them are taken, or none).
    With `whole`, taken is a multiple of size. No rows: no rows.
    """
    measured, _, table = plan(docs, shard_words, whole)
    return _decide(measured, table).select(
        "doc_id",
        "size",
        F.col("plan_size").alias("source_size"),
        F.col("plan_target").alias("target"),
        (F.col("plan_passes") * F.col("size") + F.col("part")).alias("taken"),
        F.slice("plan_shards", F.lit(1), F.col("uses")).alias("shards"),
    )


def mix(docs: DataFrame, shard_words: int = SHARD_WORDS, whole: bool = False) -> DataFrame:
    """The mix: row (a struct of the columns of docs, whatever their names), shard and rank (a seeded hash, the order within a shard).

    A document has one row per use; the use that a cut falls on keeps the first words due (n_chars, where there
    is one, follows). With `whole`, no text is cut. The documents are not shuffled: the plan comes to them.
    """
    _, sources, table = plan(docs, shard_words, whole)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    decided = _decide(_in_blocks(_measure(docs, F.struct(*columns).alias("row")), sources), table)
    each = decided.select("*", F.posexplode(F.slice("plan_shards", F.lit(1), F.col("uses"))).alias("use", "shard"))
    rank = F.xxhash64(F.lit(SEED), F.col("use"), F.col("place")).alias("rank")
    if whole:
        return each.select("row", "shard", rank)
    cut = (F.col("use") >= F.col("plan_passes")) & (F.col("part") < F.col("size"))
    first = F.array_join(F.slice(F.regexp_extract_all(F.col("row.text"), F.lit(rf"([\x20\x09-\x0D]*{WORD_PATTERN})"), 1), F.lit(1), F.col("part").cast("int")), "")
    row = F.col("row").withField("text", first)
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.char_length(first).cast(docs.schema["n_chars"].dataType))
    return each.select(F.when(cut, row).otherwise(F.col("row")).alias("row"), "shard", rank)


def shuffled(docs: DataFrame, shard_words: int = SHARD_WORDS, whole: bool = False) -> DataFrame:
    """The mix (row, shard, rank) dealt by shards and shuffled inside them: a range of a shard's order meets in one task, sorted."""
    dealt = mix(docs, shard_words, whole).withColumn("range", F.shiftright("rank", 64 - RANGES.bit_length() + 1))
    return dealt.repartition("shard", "range").sortWithinPartitions("shard", "rank").drop("range")


def write(docs: DataFrame, folder: str, shard_words: int = SHARD_WORDS, whole: bool = False) -> None:
    """Write the mix, a folder shard=N per shard. Its files hold ranges of its order, sorted by `rank`; rows are in column `row`."""
    shuffled(docs, shard_words, whole).write.partitionBy("shard").parquet(folder)
