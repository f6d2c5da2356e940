"""Near-duplicate groups by HyperMinHash, exact on full shingle sets.

1. A task hashes the words and shingles of whole texts in numpy. The first bits of a shingle's one hash choose a
   register, and of the smallest rest in a register only the count of leading zeros and the next MANTISSA bits are
   stored. A register that no shingle falls into copies another one, the first filled one in its own fixed random
   order, so short texts fill all registers and equal registers still tell of the Jaccard similarity.
2. Texts with equal word sequences are one node from here on.
3. Bands of ROWS registers put nodes into buckets. In a bucket, pairs whose collision-corrected
   Jaccard estimate is at least the wanted similarity less SLACK (over five standard errors) are joined; a bucket of more than
   HOT members is joined as a whole, which only makes more work for step 5. Each bucket gives at most one
   link per member, never its pairs.
4. Components of these links are clusters: a pair that is similar enough is in one cluster.
5. Inside clusters all pairs are decided on the full sets. A large cluster is cut into blocks, and each pair of
   blocks is one task's group; it returns a spanning forest of its true links.
6. Components of the true links are the groups.

A pair at similarity s shares no bucket with probability (1 - s^ROWS)^BANDS: 5e-8 at 0.8.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.llm._shared import durable, fresh, give_back, slices, utf8_rows
from lexloom.llm.components import components

BANDS, ROWS, MANTISSA = 32, 4, 10
#: Registers of a signature, a power of two; the bands use the first BANDS * ROWS, the estimate all.
REGISTERS = 256
SLACK = 0.13
HOT = 512
BLOCK_DOCS, BLOCK_SHINGLES = 256, 1 << 21
#: Tables of ids up to this many rows may be broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 100_000

_U = np.uint64
_RNG = np.random.default_rng(2024)
#: Register r, left empty, copies the first filled one of _DONORS[r].
_DONORS = _RNG.permuted(np.tile(np.arange(REGISTERS), (REGISTERS, 1)), axis=1)
_REST = 64 - REGISTERS.bit_length() + 1
_FIRSTS = np.arange(REGISTERS, dtype=np.uint64) << np.uint64(_REST)
_BASE, _CHAIN, _SEQ1, _SEQ2 = (int(x) | 1 for x in _RNG.integers(1 << 60, 1 << 63, 4))
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_BLANK = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])


def _mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words with good avalanche."""
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> _U(33))
    h = h * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n + 1, base, _U)
    p[0] = 1
    return np.cumprod(p, dtype=_U)


def _range_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """sum of values[i] * base^(i - start) modulo 2^64 over each range."""
    sums = np.concatenate([np.zeros(1, _U), np.cumsum(values * _powers(base, len(values))[:-1], dtype=_U)])
    back = _powers(pow(base, -1, 1 << 64), len(values))
    return (sums[ends] - sums[starts]) * back[starts]


def _pieces(text: bytes, most: int = 1 << 19) -> Iterator[bytes]:
    """The text cut at blanks into pieces of about `most` bytes; a longer word stays whole."""
    at = 0
    while len(text) - at > most:
        cut = at + most
        while cut < len(text) and not _BLANK[text[cut]]:
            cut += 1
        yield text[at:cut]
        at = cut
    yield text[at:]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of all texts, and where each text's words start (one more entry at the end)."""
    hashes, counts = [], np.zeros(len(texts), np.int64)
    pieces = [(i, p) for i, t in enumerate(texts) for p in _pieces(t)]
    for start, stop in slices([len(p) + 1 for _, p in pieces], 1 << 19):
        some = pieces[start:stop]
        data = _LOWER[np.frombuffer(b" ".join(p for _, p in some) + b" ", np.uint8)]
        inside = ~_BLANK[data]
        edges = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
        first, last = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        hashes.append(_mix(_range_hash(data.astype(_U) + _U(1), first, last, _BASE) + (last - first).astype(_U)))
        begins = np.cumsum([0] + [len(p) + 1 for _, p in some[:-1]])
        owner = np.array([i for i, _ in some])[np.searchsorted(begins, first, "right") - 1]
        counts += np.bincount(owner, minlength=len(texts))
    return np.concatenate(hashes) if hashes else np.zeros(0, _U), np.concatenate([[0], np.cumsum(counts)])


def shingle_sets(words: np.ndarray, at: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's k-word shingles; of shorter texts the whole sequence is the one shingle."""
    n = len(words)
    long = np.zeros(0, _U)
    if n >= k:
        long = words[: n - k + 1].copy()
        for j in range(1, k):
            long = long * _U(_CHAIN) + words[j : n - k + 1 + j]
        long = _mix(long)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(long[a : b - k + 1]))
        elif b > a:
            h = _U(b - a)
            with np.errstate(over="ignore"):
                for w in words[a:b]:
                    h = h * _U(_SEQ1) + w
            out.append(_mix(np.array([h], _U)))
        else:
            out.append(np.zeros(0, _U))
    return out


def sequence_hashes(words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each text's whole word sequence."""
    n = np.diff(at).astype(_U)
    return tuple(_mix(_range_hash(words, at[:-1], at[1:], base) + n).view(np.int64) for base in (_SEQ1, _SEQ2))


def registers(shingles: np.ndarray) -> np.ndarray:
    """The HyperMinHash registers of a set (sorted hashes): leading zeros of each register's minimum, then its next MANTISSA bits."""
    if not len(shingles):
        return np.zeros(REGISTERS, np.uint16)
    at = np.searchsorted(shingles, _FIRSTS)  # a register's minimum is the first hash at or after its first value
    low = shingles[np.minimum(at, len(shingles) - 1)]
    filled = (at < len(shingles)) & (low >> _U(_REST) == np.arange(REGISTERS, dtype=_U))
    rest = np.flatnonzero(~filled)
    for start in range(0, REGISTERS, 16):
        if not len(rest):
            break
        donors = _DONORS[rest, start : start + 16]
        given = filled[donors]
        some = given.any(axis=1)
        low[rest[some]] = low[donors[some, given[some].argmax(axis=1)]]
        rest = rest[~some]
    # 53 of the remaining bits are exact in a float
    fraction, exponent = np.frexp(((low & _U((1 << _REST) - 1)) >> _U(_REST - 53)).astype(np.float64))
    mantissa = np.where(exponent > 0, (fraction - 0.5) * (2 << MANTISSA), 0).astype(np.uint16)
    return ((53 - exponent).astype(np.uint16) << MANTISSA) | mantissa


def jaccard_estimate(equal: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Share of equal registers, corrected for registers of different minima that are equal by chance.

    The published approximation of that chance: 0.1699 * 2^-MANTISSA * 4nm / (n + m)^2.
    """
    chance = 0.169919487 * 2.0**-MANTISSA * 4 * n * m / np.square(n + m, dtype=np.float64)
    return (equal - chance) / (1 - chance)


SIGNATURE = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("seq1", T.LongType()), T.StructField("seq2", T.LongType()), T.StructField("registers", T.BinaryType())])
#: Text of about this size is hashed at a time.
SLICE_BYTES = 1 << 20


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, the word sequence's 128 bits (seq1, seq2) and the registers of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8_rows(batch.column(1))
            for start, stop in slices([len(t) + 64 for t in texts], SLICE_BYTES):
                words, at = word_hashes(texts[start:stop])
                sets = shingle_sets(words, at, k)
                seq1, seq2 = sequence_hashes(words, at)
                sketch = [registers(s).tobytes() for s in sets]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, stop - start), pa.array([len(s) for s in sets], pa.int64()), pa.array(seq1), pa.array(seq2), pa.array(sketch, pa.binary())], names=SIGNATURE.names)
        give_back()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SIGNATURE)


def _forest(linked: np.ndarray) -> np.ndarray:
    """Index of the first member of each one's component in a symmetric boolean matrix."""
    label = np.arange(len(linked))
    linked = linked | np.eye(len(linked), dtype=bool)
    while True:
        new = np.where(linked, label[None], len(label)).min(axis=1)
        new = new[new]
        if (new == label).all():
            return label
        label = new


LINK = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def _links(pairs: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    a, b = ([x for p in pairs for x in p[i].tolist()] for i in (0, 1))
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=LINK.names)


def candidate_links(reps: DataFrame, percent: int) -> DataFrame:
    """Spanning links of the buckets' likely pairs (a, b), from reps(node, n_shingles, registers)."""
    keys = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substr("registers", i * (2 * ROWS) + 1, F.lit(2 * ROWS))))
    rows = reps.select("node", F.explode(keys).alias("band"))
    shared = rows.groupBy("band").agg(F.count("*").alias("n"), F.min("node").alias("first")).where("n > 1")
    members = durable(rows.join(shared, "band"), "members")
    hot = members.where((F.col("n") > HOT) & (F.col("node") != F.col("first"))).select(F.col("first").alias("a"), F.col("node").alias("b"))
    buckets = members.where(F.col("n") <= HOT).groupBy("band").agg(F.array_sort(F.collect_list("node")).alias("nodes")).select("nodes").distinct()
    numbered = buckets.select(F.xxhash64("nodes").alias("bucket"), F.explode("nodes").alias("node")).distinct()
    filled = numbered.join(reps, "node").groupBy("bucket").agg(F.collect_list(F.struct("node", "n_shingles", "registers")).alias("members"))
    least = percent / 100 - SLACK

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for cell in batch.column(0):
                m = cell.values
                ids, n = m.field(0).to_numpy(zero_copy_only=False), m.field(1).to_numpy(zero_copy_only=False)
                sketch = np.stack([np.frombuffer(x, np.uint16) for x in m.field(2).to_pylist()])
                equal = np.stack([(sketch == s).mean(axis=1) for s in sketch])
                linked = (jaccard_estimate(equal, n[:, None], n[None]) >= least) & (100 * np.minimum(n[:, None], n) >= percent * np.maximum(n[:, None], n))
                label = _forest(linked)
                tail = np.flatnonzero(label != np.arange(len(label)))
                if len(tail):
                    found.append((ids[label[tail]], ids[tail]))
            if found:
                yield _links(found)

    return hot.unionByName(filled.select("members").mapInArrow(likely, LINK))


def exact_linked(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Which pairs of sets have 100 * intersection >= percent * union."""
    n = np.array([len(s) for s in sets])
    if len(sets) == 2:
        common = len(np.intersect1d(*sets, assume_unique=True))
        both = np.array([[n[0], common], [common, n[1]]])
    else:
        codes, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(sets)), n)
        wanted = count[inverse] > 1  # what only one set holds is in no intersection
        number = np.cumsum(count > 1) - 1
        column, owner = number[inverse[wanted]], owner[wanted]
        order = np.argsort(column, kind="stable")
        column, owner = column[order], owner[order]
        both = np.zeros((len(sets), len(sets)))
        width = 4096
        for left in range(0, int((count > 1).sum()), width):
            lo, hi = np.searchsorted(column, [left, left + width])
            part = np.zeros((len(sets), width), np.float32)
            part[owner[lo:hi], column[lo:hi] - left] = 1
            both += part @ part.T
    union = n[:, None] + n[None] - both
    return (100 * both >= percent * union) & (union > 0)


def _groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[list[tuple]]:
    """Runs of rows with equal first n_keys columns, over batch ends."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and held[0][:n_keys] != row[:n_keys]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def true_links(docs: DataFrame, clusters: DataFrame, k: int, percent: int, repeated: bool) -> DataFrame:
    """Spanning forests of the links inside clusters(node, cluster, rep, seq1, seq2, n_shingles), decided on full shingle sets.

    A node's text is that of document rep with the word sequence seq1, seq2. `repeated` tells that rows may repeat a doc_id.
    """
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("docs"), F.sum("n_shingles").alias("shingles"))
    blocks = F.greatest(F.ceil(F.col("docs") / BLOCK_DOCS), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    wanted = clusters.join(sizes, "cluster").select("node", "cluster", blocks.alias("blocks"), F.pmod(F.xxhash64("node"), blocks).cast("int").alias("block"), "seq1", "seq2", "rep")
    wanted = durable(wanted, "clusters")
    joined = F.broadcast(wanted) if wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else wanted
    own = docs.select(F.col("doc_id").cast("long").alias("rep"), "text")
    texts = (own.dropDuplicates() if repeated else own).join(joined, "rep")
    schema = T.StructType([T.StructField("cluster", T.LongType()), T.StructField("blocks", T.IntegerType()), T.StructField("block", T.IntegerType()), T.StructField("node", T.LongType()), T.StructField("shingles", T.BinaryType())])

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = utf8_rows(batch.column(6))
            for start, stop in slices([len(t) + 64 for t in data], SLICE_BYTES):
                part = batch.slice(start, stop - start)
                words, at = word_hashes(data[start:stop])
                seq1, seq2 = sequence_hashes(words, at)
                own = pa.array((seq1 == part.column(4).to_numpy()) & (seq2 == part.column(5).to_numpy()))
                sets = pa.array([s.tobytes() for s in shingle_sets(words, at, k)], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[:4], sets], names=schema.names).filter(own)

    sets = texts.select("cluster", "blocks", "block", "node", "seq1", "seq2", "text").mapInArrow(to_sets, schema)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    paired = sets.withColumn("other", other).select("cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "shingles")
    keys = ["cluster", "i", "j"]

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n = [], 0
        for group in _groups(batches, 3):
            if len(group) < 2:
                continue
            ids = np.array([r[3] for r in group])
            label = _forest(exact_linked([np.frombuffer(r[4], _U) for r in group], percent))
            tail = np.flatnonzero(label != np.arange(len(label)))
            if len(tail):
                found.append((ids[label[tail]], ids[tail]))
                n += len(tail)
            if n > 10_000:
                yield _links(found)
                found, n = [], 0
        if found:
            yield _links(found)
        give_back()

    return paired.repartition(*keys).sortWithinPartitions(*keys, "node").mapInArrow(decide, LINK)


def _some(ids: DataFrame) -> DataFrame:
    """ids, to be broadcast where they are few."""
    return F.broadcast(ids) if ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else ids


def _text_groups(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """(signatures, repeated, groups) of docs(doc_id, text).

    repeated(doc_id, differ) names the ids that several rows have, and whether their word sequences differ; None if
    there are none. groups(seq1, seq2, first_doc, is_first) has a row per word sequence: the smallest doc_id of the
    texts that links reach from it, and whether it is the group's first text (by smallest doc_id, then sequence).
    """
    sig = durable(signatures(docs, k), "signatures")
    named = sig.where(F.col("doc_id").isNotNull())
    sequence = F.struct("seq1", "seq2")
    repeated = durable(named.groupBy("doc_id").agg(F.count("*").alias("n"), (F.min(sequence) != F.max(sequence)).alias("differ")).where("n > 1").drop("n"), "repeated")
    any_repeated = not repeated.isEmpty()
    found = named.where("n_shingles > 0").groupBy("seq1", "seq2").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("registers").alias("registers"))
    reps = durable(found.withColumn("node", F.monotonically_increasing_id()), "representatives")
    clusters = components(candidate_links(reps.select("node", "n_shingles", "registers"), percent)).withColumnRenamed("component", "cluster")
    keys = reps.select("node", "rep", "seq1", "seq2")
    sized = clusters.join(reps.drop("registers"), "node")
    members = components(true_links(docs, sized, k, percent, any_repeated)).join(keys, "node")
    first = members.groupBy("component").agg(F.min(F.struct("rep", "seq1", "seq2")).alias("first"))
    grouped = members.join(first, "component").select("seq1", "seq2", F.col("first.rep").alias("first_doc"), (F.struct("rep", "seq1", "seq2") == F.col("first")).alias("is_first"))
    groups = keys.join(grouped, ["seq1", "seq2"], "left").select("seq1", "seq2", F.coalesce("first_doc", "rep").alias("first_doc"), F.coalesce("is_first", F.lit(True)).alias("is_first"))
    return sig, repeated if any_repeated else None, groups


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of docs(doc_id, text).

    Words are `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z. Two documents are linked if their sets of distinct
    k-word shingles have 100 * intersection >= percent * union; component_id is the smallest doc_id that links
    reach, and kept tells of doc_id = component_id. A text of fewer than k words has itself as its one shingle;
    null texts and texts without words have none and are linked with nothing. Rows that repeat a doc_id are
    one document with all their texts: it is linked with what any of them is linked with, and its rows have one
    component_id. A null doc_id is linked with nothing: component_id null, kept.
    """
    sig, repeated, groups = _text_groups(docs, k, percent)
    rows = sig.select("doc_id", "n_shingles", "seq1", "seq2").join(groups, ["seq1", "seq2"], "left")
    key = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("first_doc")).otherwise(F.col("doc_id"))
    rows = rows.select("doc_id", "n_shingles", key.alias("component_id"))
    if repeated is not None:
        several = _some(repeated.where("differ").select("doc_id"))
        joins = components(rows.join(several, "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("component_id").alias("b")))
        joins = _some(joins.select(F.col("node").alias("component_id"), "component"))
        rows = rows.join(joins, "component_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "component_id").alias("component_id"))
    return rows.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)).alias("kept"))


def _sequences(docs: DataFrame, names: tuple[str, str]) -> DataFrame:
    """docs, all columns, with the 128 bits of the text's word sequence under these names."""
    at_text = docs.columns.index("text")
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, T.LongType()) for n in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = utf8_rows(batch.column(at_text))
            for start, stop in slices([len(t) + 64 for t in data], SLICE_BYTES):
                yield pa.RecordBatch.from_arrays([*batch.slice(start, stop - start).columns, *map(pa.array, sequence_hashes(*word_hashes(data[start:stop])))], names=schema.names)

    return docs.mapInArrow(run, schema)


def keep_first(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each group of near-duplicate texts: that of the smallest doc_id. All columns stay.

    Rows are dropped, not ids: of a doc_id with several texts each text is judged for itself, so no group of texts
    is lost. Rows equal in doc_id and word sequence are one (the first by their JSON form stays). Rows without a doc_id
    all stay; rows without words stay, one for each doc_id.
    """
    sig, repeated, groups = _text_groups(docs, k, percent)
    rows = sig.where("n_shingles > 0 AND doc_id IS NOT NULL").select("doc_id", "seq1", "seq2").join(groups, ["seq1", "seq2"])
    later = durable(rows.where(~F.col("is_first") | (F.col("doc_id") != F.col("first_doc"))).select("doc_id", "seq1", "seq2").distinct(), "later")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    once = later if repeated is None else later.join(_some(repeated.select("doc_id")), "doc_id", "left_anti")
    key, seq1, seq2 = (fresh(docs.columns, name) for name in ("id", "own_seq1", "own_seq2"))
    dropped = _some(once.select(F.col("doc_id").alias(key)))
    rest = docs.join(dropped, docs["doc_id"].cast("long") == F.col(key), "left_anti")
    if repeated is None:
        return rest.select(*columns)
    several = _some(repeated.select(F.col("doc_id").alias(key)))
    own = _sequences(docs.join(several, docs["doc_id"].cast("long") == F.col(key), "left_semi").select(*columns), (seq1, seq2))
    own = own.select(F.col("doc_id").cast("long").alias("own_doc"), F.col(seq1).alias("own_seq1"), F.col(seq2).alias("own_seq2"), F.struct(*columns).alias("row"))
    gone = later.join(_some(repeated.select("doc_id")), "doc_id", "left_semi").select(F.col("doc_id").alias("own_doc"), F.col("seq1").alias("own_seq1"), F.col("seq2").alias("own_seq2"))
    kept = own.join(gone, ["own_doc", "own_seq1", "own_seq2"], "left_anti")
    single = kept.groupBy("own_doc", "own_seq1", "own_seq2").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row.*")
    rest = rest.join(several, rest["doc_id"].cast("long") == F.col(key), "left_anti")
    return rest.select(*columns).unionByName(single)
