r"""How far sources of one language are apart: word profiles compared by systolic rotation.

Every (lang, source) group has a profile over its language's kept terms (those in at least `least_docs` of its documents).
Profiles are cut into shards of bounded numbers of terms and groups are dealt to blocks of bounded numbers of groups. A block stays
in the partition it was dealt to, and compressed copies of the other blocks go round: in each round of a
round-robin tournament every block meets one other, and the partition where two meet evaluates both directions. A task
holds the dense counts of two blocks over one shard, whatever the number of groups, terms and documents.

Counting combines in the map tasks: a task gives out each (lang, source, term) once for every FLUSH_TERMS different ones.

Nulls in text, lang and source count as empty; repeated rows are documents of their own. Ranks have no ties (equal values go by
item). Where a language keeps no term, its sources differ by 0. Columns other than the three are not looked at.
"""

from __future__ import annotations

import heapq
import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.llm._shared import byte_parts, durable, give_back, shared_dir, utf8_rows

#: A term is in the profiles if it is in so many documents of its language.
LEAST_DOCS = 30
#: Ranks of the part `term`.
TOP_TERMS = 50
#: What a count is raised by; the scale of a share is 1000 ** SCALE_STEPS.
ADDED, SCALE_STEPS = 5, 3
#: Terms in a shard of a language, and groups in a block, on average.
SHARD_TERMS, BLOCK_GROUPS = 1 << 13, 16
#: Different (lang, source, term) that a counting task holds before it gives them out.
FLUSH_TERMS = 1 << 17
#: Terms of UTF-8 texts in lower-cased bytes: letters a to z and all beyond ASCII.
_TERM = re.compile(rb"[a-z\x80-\xff]+")
#: Bytes of a text that are cut into terms at once.
_PIECE = 1 << 22


def _terms(text: bytes) -> Iterator[list[bytes]]:
    """The text's terms, in lists of bounded size; pieces end where a term does (a single longer term stays whole)."""
    text, at = text.lower(), 0
    while at < len(text):
        stop = min(at + _PIECE, len(text))
        if stop < len(text) and (inside := _TERM.match(text, stop)) and _TERM.match(text, stop - 1):
            stop = inside.end()
        yield _TERM.findall(text, at, stop)
        at = stop


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, n_docs) of the task's documents; a group's rows begin with one without term."""
    counts: dict[tuple[bytes, bytes], tuple[Counter, Counter]] = {}
    held = 0

    def given_out() -> Iterator[pa.RecordBatch]:
        for (lang, source), (total, docs) in counts.items():
            terms = [None, *total]
            for at in range(0, len(terms), 1 << 15):
                part = terms[at : at + (1 << 15)]
                columns = [[lang] * len(part), [source] * len(part), part]
                numbers = [[counter[t] for t in part] for counter in (total, docs)]
                arrays = [pa.array(c, pa.binary()).cast(pa.string()) for c in columns] + [pa.array(c, pa.int64()) for c in numbers]
                yield pa.RecordBatch.from_arrays(arrays, names=["lang", "source", "term", "n", "n_docs"])

    for whole in batches:
        for batch in byte_parts(whole, 2):
            for lang, source, text in zip(*map(utf8_rows, batch.columns), strict=True):
                total, docs = counts.setdefault((lang, source), (Counter(), Counter()))
                before, own = len(total), set()
                for words in _terms(text):
                    total.update(words)
                    own.update(words)
                docs.update(own)
                held += len(total) - before
            if held >= FLUSH_TERMS:
                yield from given_out()
                counts, held = {}, 0
    yield from given_out()
    give_back()


def term_counts(documents: DataFrame) -> DataFrame:
    """lang, source, term, n, n_docs over all documents, dealt by language and term; each group has one row with a null term."""
    columns = documents.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    parts = columns.mapInArrow(_count_terms, "lang string, source string, term string, n long, n_docs long")
    return parts.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))


def _shares(counts: np.ndarray, total: int) -> np.ndarray:
    """1 + floor(10^9 * (counts + ADDED) / total), exact by long division, three digits at a time."""
    rest, quotient = counts.astype(np.int64) + ADDED, np.zeros(len(counts), np.int64)
    for _ in range(SCALE_STEPS):
        rest *= 1000
        quotient = quotient * 1000 + rest // total
        rest %= total
    return quotient + 1


_PROFILE = "lang string, shard long, block long, source string, n_blocks long, n_terms long, least long, places binary, shares binary, top array<struct<item:string,value:long>>"


def _profile(group: pd.DataFrame, terms: pd.DataFrame) -> pd.DataFrame:
    """One group's share of each of its terms of a shard, compressed, and the heap of its terms that stand out.

    `group` is its one row; `least` is the share of a term that it does not have.
    """
    if group.empty:
        return pd.DataFrame(columns=[c.split()[0] for c in re.sub("<.*>", "", _PROFILE).split(", ")])
    g = group.iloc[0]
    total, lang_total = (int(g[c]) + ADDED * int(g["n_terms"]) for c in ("total", "lang_total"))
    least = int(_shares(np.zeros(1, np.int64), total)[0]) if g["n_terms"] else 0
    places = terms["place"].to_numpy(np.int32)
    order = np.argsort(places)
    own = _shares(terms["n"].to_numpy(np.int64), total) if len(terms) else np.zeros(0, np.int64)
    ahead = own - _shares(terms["lang_n"].to_numpy(np.int64), lang_total) if len(terms) else own
    heap = heapq.nsmallest(TOP_TERMS, ((-int(ahead[i]), terms["term"].iloc[i].encode()) for i in np.flatnonzero(ahead > 0)))
    row = {c: g[c] for c in ("lang", "shard", "block", "source", "n_blocks", "n_terms")} | {
        "least": least,
        "places": zlib.compress(np.diff(places[order], prepend=np.int32(0)).astype(np.int32).tobytes(), 1),
        "shares": zlib.compress(own[order].tobytes(), 1),
        "top": [{"item": term.decode(), "value": -value} for value, term in heap],
    }
    return pd.DataFrame([row])


def profiles(documents: DataFrame, least_docs: int = LEAST_DOCS, shard_terms: int = SHARD_TERMS, block_groups: int = BLOCK_GROUPS) -> DataFrame:
    """A row for every group and shard of its language, with the group's compressed shares and leading terms of the shard."""
    per_term = Window.partitionBy("lang", "term")
    counted = term_counts(documents).select("*", F.sum("n_docs").over(per_term).alias("lang_docs"), F.sum("n").over(per_term).alias("lang_n"))
    counted = durable(counted.where(F.col("term").isNull() | (F.col("lang_docs") >= least_docs)).select("lang", "source", "term", "n", "lang_n"), "counts")
    kept = counted.where("term is not null")
    # Sums over whole languages; the first source of a term stands for the term. Groups grow with the corpus, so they are joined and never collected.
    first = kept.groupBy("lang", "term").agg(F.first("lang_n").alias("lang_n"))
    langs = first.groupBy("lang").agg(F.count("*").alias("n_terms"), F.sum("lang_n").alias("lang_total"))
    groups = counted.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sizes = groups.groupBy("lang").agg(F.count("*").alias("n_groups")).join(langs, "lang", "left").na.fill(0)
    part = lambda count, size: F.greatest(F.lit(1), F.ceil(F.col(count) / size)).cast("long")
    sizes = durable(sizes.select("lang", "n_terms", "lang_total", part("n_groups", block_groups).alias("n_blocks"), part("n_terms", shard_terms).alias("n_shards")), "sizes")
    anew = lambda rows: rows.select(*(F.col(c).alias(c) for c in rows.columns))  # noqa: E731  (so that a cogroup can tell its sides apart)
    each = groups.join(sizes, "lang").select(
        "lang", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_shards") - 1)).alias("shard"), "source",
        F.pmod(F.xxhash64("source"), "n_blocks").alias("block"), "n_blocks", "n_terms", "lang_total", "total",
    )
    shard = F.pmod(F.xxhash64("term"), "n_shards").alias("shard")
    sharded = kept.join(sizes.select("lang", "n_shards"), "lang").select("lang", shard, "source", "term", "n", "lang_n")
    placed = sharded.withColumn("place", F.dense_rank().over(Window.partitionBy("lang", "shard").orderBy("term")) - 1)
    by = ("lang", "shard", "source")
    return durable(anew(each).groupBy(*by).cogroup(anew(placed).groupBy(*by)).applyInPandas(_profile, _PROFILE), "profiles")


def _partner(block: Column, n_blocks: Column, number: int) -> Column:
    """Whom a block meets in this round of the tournament; null where it rests.

    The circle method: of an even number of places the last stands still, the others sum to the round's number. An odd
    number of blocks has one place more, which nobody takes.
    """
    last = n_blocks + F.pmod(n_blocks, F.lit(2)) - 1
    turned = F.pmod(F.lit(number) - block, last)
    # The one whose partner would be itself meets the last, which finds it as half of the number (modulo an odd count).
    half = F.pmod(F.lit(number) * F.floor((last + 1) / 2), last)
    partner = F.when(block == last, half).when(turned == block, last).otherwise(turned)
    return F.when((F.lit(number) < last) & (partner < n_blocks), partner)


def _unpacked(rows: pd.DataFrame, width: int) -> np.ndarray:
    """Dense shares of a block's groups over the first `width` places."""
    out = np.repeat(rows["least"].to_numpy(np.int64)[:, None], width, axis=1)
    for i, (places, shares) in enumerate(zip(rows["places"], rows["shares"], strict=True)):
        out[i, np.cumsum(np.frombuffer(zlib.decompress(places), np.int32))] = np.frombuffer(zlib.decompress(shares), np.int64)
    return out


def _width(rows: pd.DataFrame) -> int:
    return max((int(np.frombuffer(zlib.decompress(p), np.int32).sum()) + 1 for p in rows["places"]), default=0)


_DISTANCE = "lang string, source string, item string, value long"


def _meeting(residents: pd.DataFrame, visitors: pd.DataFrame) -> pd.DataFrame:
    """Distances of all residents and visitors over one shard, in both directions.

    A term that neither of two groups has, in the shard or not, adds the difference of their least shares: that is
    taken once for all of the language's terms, in its first shard.
    """
    columns = ["lang", "source", "item", "value"]
    if residents.empty or visitors.empty:
        return pd.DataFrame(columns=columns)
    same = residents["block"].iloc[0] == visitors["own_block"].iloc[0]
    width = max(_width(residents), _width(visitors))
    here, there = _unpacked(residents, width), _unpacked(visitors, width)
    first, n_terms = residents["shard"].iloc[0] == 0, int(residents["n_terms"].iloc[0])
    names, least = residents["source"].tolist(), residents["least"].to_numpy(np.int64)
    lang, out = residents["lang"].iloc[0], []
    for j, source in enumerate(visitors["source"]):
        apart = np.abs(least - int(visitors["least"].iloc[j]))
        values = np.abs(here - there[j]).sum(axis=1) + apart * ((n_terms if first else 0) - width)
        for name, value in zip(names, values.tolist(), strict=True):
            if name != source:
                out.append((lang, name, source, value))
                if not same:
                    out.append((lang, source, name, value))
    return pd.DataFrame(out, columns=columns)


def distances(known: DataFrame) -> DataFrame:
    """lang, source, item, value for every two sources of a language, by a tournament of the blocks of `known` (see profiles)."""
    spark = known.sparkSession
    key = ("lang", "shard", "block")
    slim = known.select(*key, "source", "n_blocks", "n_terms", "least", "places", "shares")
    most = slim.agg(F.max("n_blocks")).first()[0] or 0
    name, path = f"lexloom_residents_{uuid.uuid4().hex}", f"{shared_dir(spark)}/distances-{uuid.uuid4().hex}"
    # Residents are dealt once, into the buckets of a table in the shared folder: no round moves them again.
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    slim.repartition(buckets, *key).write.bucketBy(buckets, *key).sortBy(*key).option("path", f"{path}-residents").saveAsTable(name)
    for number in range(-1, most + most % 2 - 1):
        met = F.col("block") if number < 0 else _partner(F.col("block"), F.col("n_blocks"), number)
        own = [F.col(c).alias(c) for c in ("lang", "shard")]
        visitors = slim.select(*own, met.alias("block"), F.col("block").alias("own_block"), "source", "least", "places", "shares").where("block <= own_block")
        meetings = spark.table(name).groupBy(*key).cogroup(visitors.groupBy(*key)).applyInPandas(_meeting, _DISTANCE)
        meetings.write.mode("append").parquet(path)
    spark.sql(f"DROP TABLE {name}")
    parts = spark.read.schema(_DISTANCE).parquet(path) if most else spark.createDataFrame([], _DISTANCE)
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit(documents: DataFrame, least_docs: int = LEAST_DOCS, shard_terms: int = SHARD_TERMS, block_groups: int = BLOCK_GROUPS) -> DataFrame:
    """lang, source, part, item, value, rank.

    Part `pair`: every other source of the language, by the summed differences of their terms' shares; all ranks. Part `term`:
    the TOP_TERMS terms whose share in the group is furthest above that in the language. Ranks go by value, then item.
    """
    known = profiles(documents, least_docs, shard_terms, block_groups)
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    ranked = lambda rows, part: rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", place)
    terms = known.select("lang", "source", F.inline("top"))
    return ranked(distances(known), "pair").unionByName(ranked(terms, "term").where(F.col("rank") <= TOP_TERMS))
