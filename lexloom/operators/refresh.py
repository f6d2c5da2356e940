"""What a refresh of candidates changed, what a curation kept, and what kinds of units a file has."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from lexloom.sources.tables import shared_dir

c = F.col
# Fewer candidates than these are too few, for a category and for a document; the name of what expects no document.
LEAST_OF_CATEGORY, LEAST_OF_DOCUMENT, NO_DOCUMENT = 15, 18, "negative/none"
KINDS = ("category", "document", "language", "all")


def stored(candidates: DataFrame, categories: list[str]) -> tuple[DataFrame, DataFrame]:
    """candidates as a written table, and its counts (kind, name, n) in all and by these categories, taken while it is written.

    Categories without candidates count 0. The counts are a row of a number for each stated category; no pass is made for them.
    """
    seen = Observation()
    path = f"{shared_dir(candidates.sparkSession)}/candidates-{uuid.uuid4().hex}"
    counts = [F.count_if(c("category") == x).alias(f"c{i}") for i, x in enumerate(categories)]
    candidates.observe(seen, F.count("*").alias("n"), *counts).write.parquet(path)
    found = seen.get
    rows = [("all", "all", found["n"]), *(("category", x, found[f"c{i}"]) for i, x in enumerate(categories))]
    spark = candidates.sparkSession
    return spark.read.schema(candidates.schema).parquet(path), spark.createDataFrame(rows, "kind string, name string, n long")


def counted(candidates: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """kind, name, n: candidates by category, document, language and in all. Questions without a document count as NO_DOCUMENT."""
    names = {"category": c("category"), "document": F.coalesce("expected_doc", F.lit(NO_DOCUMENT)), "language": c("language"), "all": F.lit("all")}
    each = F.array(*(F.struct(F.lit(k).alias("kind"), names[k].alias("name")) for k in kinds))
    return candidates.select(F.explode(each).alias("k")).groupBy("k.kind", "k.name").agg(F.count("*").alias("n"))


def compared(before: DataFrame, after: DataFrame) -> DataFrame:
    """kind, name, before, after, delta, newly (there only now) and low (too few now) of two tables of counts (kind, name, n).

    What is in one of them only counts 0 in the other.
    """
    met = after.withColumnRenamed("n", "after").join(before.withColumnRenamed("n", "before"), ["kind", "name"], "full").na.fill(0, ["before", "after"])
    low = ((c("kind") == "category") & (c("after") < LEAST_OF_CATEGORY)) | ((c("kind") == "document") & (c("name") != NO_DOCUMENT) & (c("after") < LEAST_OF_DOCUMENT))
    return met.select("kind", "name", "before", "after", (c("after") - c("before")).alias("delta"), ((c("before") == 0) & (c("after") > 0)).alias("newly"), (low & (c("after") > 0)).alias("low"))


def curation(final: DataFrame, generated: DataFrame) -> DataFrame:
    """kind, name, n of a final set: its counts, and of kind `origin` how many of its questions were generated, supplemented, and generated ones removed.

    Questions are the same if their trimmed texts are; repeated generated texts count once.
    """
    key = F.trim("query")
    known = generated.select(key.alias("_key")).distinct()
    marked = final.withColumn("_key", key).join(known.withColumn("_known", F.lit(True)), "_key", "left")
    origin = F.when(c("_known"), "generated").otherwise("supplemented")
    own = marked.groupBy(origin.alias("name")).agg(F.count("*").alias("n")).select(F.lit("origin").alias("kind"), "name", "n")
    removed = known.join(final.select(key.alias("_key")).distinct(), "_key", "left_anti").agg(F.count("*").alias("n")).select(F.lit("origin").alias("kind"), F.lit("removed").alias("name"), "n")
    return counted(final).unionByName(own).unionByName(removed)


def dominant_types(rows: DataFrame, file: str = "source_file", kind: str = "unit_type") -> DataFrame:
    """file, chunks, dominant, share, mixed, counts: the kind that most rows of a file have (the first by name at a tie), and whether it has several.

    Null files and kinds count as empty. counts lists all kinds as `kind:rows` by name.
    """
    named = rows.select(F.coalesce(F.col(file), F.lit("")).alias("file"), F.coalesce(F.col(kind), F.lit("")).alias("kind")).groupBy("file", "kind").agg(F.count("*").alias("n"))
    every = F.array_sort(F.collect_list(F.concat_ws(":", "kind", "n")))
    whole = named.groupBy("file").agg(F.sum("n").alias("chunks"), F.min_by(F.struct("kind", "n"), F.struct(-c("n"), "kind")).alias("top"), (F.count("*") > 1).alias("mixed"), F.array_join(every, ",").alias("counts"))
    return whole.select("file", "chunks", c("top.kind").alias("dominant"), F.round(c("top.n") / c("chunks"), 6).alias("share"), "mixed", "counts")
