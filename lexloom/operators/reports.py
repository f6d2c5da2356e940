"""Reports over result and corpus tables: grouping, balancing, comparing, summing up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions.text import preview

c = F.col


def ratio(part: Column, whole: Column) -> Column:
    """0 where there is nothing to divide by."""
    return F.when(whole == 0, 0.0).otherwise(part / whole)


def group_sources(results: DataFrame, k: int) -> DataFrame:
    """Ranked results(query_id, rank, score, document, unit_type, unit_id, heading, text) as sections in order of first appearance.

    A section has its best score (4 places), its number of chunks, its first two distinct headings and previews.
    """
    row = F.struct("rank", "heading", preview(c("text")).alias("preview"))
    grouped = results.groupBy("query_id", "document", "unit_type", "unit_id").agg(F.min("rank").alias("first"), F.max("score").alias("score"), F.count("*").alias("chunk_count"), F.array_sort(F.collect_list(row)).alias("rows"))
    distinct = lambda name: F.slice(F.array_distinct(F.filter(F.transform("rows", lambda r: r[name]), lambda x: x != "")), 1, 2)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("first"))
    return grouped.withColumn("place", place).where(c("place") <= k).select("query_id", "place", "document", "unit_type", "unit_id", F.array_join(distinct("heading"), " / ").alias("heading"), F.bround("score", 4).alias("score"), "chunk_count", F.trim(F.array_join(distinct("preview"), " ")).alias("preview"))


def keep_best(rows: DataFrame, key: Column, value: str, order: str) -> DataFrame:
    """One row per key: that with the largest value, the first by order among equals. Keys are compared by digest, combined in the map tasks."""
    best = F.min_by(F.struct(*rows.columns), F.struct(-c(value), c(order)))
    return rows.groupBy(F.sha2(key, 256).alias("_key")).agg(best.alias("row"), F.count("*").alias("merged")).select("row.*", "merged")


def balance(rows: DataFrame, document: str, category: str, value: str, name: str, per_category: int = 6, per_document: int = 24) -> DataFrame:
    """Round-robin selection: of each document the best per_category of every category, taken in turns up to per_document."""
    nth = F.row_number().over(Window.partitionBy(document, category).orderBy(c(value).desc(), name))
    turns = rows.withColumn("turn", nth).where(c("turn") <= per_category)
    place = F.row_number().over(Window.partitionBy(document).orderBy("turn", category))
    return turns.withColumn("place", place).where(c("place") <= per_document)


def hit_rates(cases: DataFrame, *groups: str) -> DataFrame:
    """cases(positive, hit_at_1, hit_at_3, answered and groups): counts and rates by each group and over all, by grouping sets.

    Rates of hits are over positive cases, no_answer over the others; rates over no cases are 0.
    """
    positive = c("positive")
    count = lambda rule: F.count_if(rule)
    sets = [[c(g)] for g in groups] + [[]]
    out = cases.groupingSets(sets, *map(c, groups)).agg(
        F.grouping_id(*map(c, groups)).alias("gid"),
        F.count("*").alias("cases"),
        count(positive).alias("positives"),
        count(positive & c("hit_at_1")).alias("hits_1"),
        count(positive & c("hit_at_3")).alias("hits_3"),
        count(~positive & ~c("answered")).alias("silent"),
    )
    return out.select(*groups, "gid", "cases", "positives", F.round(ratio(c("hits_1"), c("positives")), 6).alias("hit_at_1"), F.round(ratio(c("hits_3"), c("positives")), 6).alias("hit_at_3"), F.round(ratio(c("silent"), c("cases") - c("positives")), 6).alias("no_answer"))


def compare_snapshots(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Full outer comparison by file_name of (file_name, chunk_count, unit_types): added, removed, changed or same, and the difference."""
    p, n = previous.withColumnsRenamed({"chunk_count": "old_count", "unit_types": "old_types"}), current.withColumnsRenamed({"chunk_count": "new_count", "unit_types": "new_types"})
    both = p.join(n, "file_name", "full_outer")
    changed = (c("old_count") != c("new_count")) | (c("old_types") != c("new_types"))
    status = F.when(c("old_count").isNull(), "added").when(c("new_count").isNull(), "removed").when(changed, "changed").otherwise("same")
    return both.select("file_name", status.alias("status"), F.coalesce("old_count", F.lit(0)).alias("old_count"), F.coalesce("new_count", F.lit(0)).alias("new_count"), (F.coalesce("new_count", F.lit(0)) - F.coalesce("old_count", F.lit(0))).alias("delta"))


def corpus_snapshot(chunks: DataFrame, file: str, unit_type: str) -> DataFrame:
    """file_name, chunk_count, unit_types (sorted; blank ones are `unknown`) and whether a file mixes types."""
    kind = F.coalesce(F.nullif(c(unit_type), F.lit("")), F.lit("unknown"))
    out = chunks.groupBy(c(file).alias("file_name")).agg(F.count("*").alias("chunk_count"), F.array_sort(F.collect_set(kind)).alias("unit_types"))
    return out.withColumn("mixed", F.size("unit_types") > 1)
