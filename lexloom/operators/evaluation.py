"""Judging ranked results against gold questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions.text import unit_key
from lexloom.operators.names import names_in
from lexloom.sources.tables import in_order

c = F.col
MISSES = ("none", "right_section_wrong_subsection", "wrong_section", "wrong_act")


def matches(gold: DataFrame, results: DataFrame) -> DataFrame:
    """Ranked results(query_id, rank, act_title, section_id, unit_id, subsection_id) of gold questions, with what of each fits.

    gold: query_id, expected_act_title, expected_section_id, expected_subsection_id (null: any).
    """
    joined = gold.join(results, "query_id", "left")
    act = c("act_title") == c("expected_act_title")
    section = act & (F.upper(unit_key(c("unit_id"), c("section_id"))) == F.upper("expected_section_id"))
    part = section & (c("expected_subsection_id").isNull() | (c("expected_subsection_id") == c("subsection_id")))
    no = F.lit(False)
    return joined.withColumns({"act_fits": F.coalesce(act, no), "section_fits": F.coalesce(section, no), "all_fits": F.coalesce(part, no)})


def cases(gold: DataFrame, results: DataFrame) -> DataFrame:
    """One row per gold question: hit_at_1, hit_at_3 and the kind of miss (by all its results; hits have none)."""
    m = matches(gold, results)
    within = lambda k, name: F.coalesce(F.max(F.when(c("rank") <= k, c(name))), F.lit(False))
    out = m.groupBy("query_id").agg(within(1, "all_fits").alias("hit_at_1"), within(3, "all_fits").alias("hit_at_3"), F.max("section_fits").alias("section"), F.max("act_fits").alias("act"), F.max(c("rank").isNotNull()).alias("answered"))
    kind = F.when(c("hit_at_3") | ~c("answered"), "none").when(c("section"), "right_section_wrong_subsection").when(c("act"), "wrong_section").otherwise("wrong_act")
    return out.select("query_id", "hit_at_1", "hit_at_3", "answered", kind.alias("miss"))


def summary(judged: DataFrame) -> DataFrame:
    """cases, hit_at_1, hit_at_3 and a count of each kind of miss (0 where there is none); one row, also for no cases."""
    rate = lambda name: F.coalesce(F.avg(c(name).cast("int")), F.lit(0.0))
    return judged.agg(F.count("*").alias("cases"), rate("hit_at_1").alias("hit_at_1"), rate("hit_at_3").alias("hit_at_3"), *(F.count_if(c("miss") == m).alias(f"miss_{m}") for m in MISSES))


def failure_bucket(category: Column, hit: Column, top_document: Column, expected: Column) -> Column:
    """Where a failed question fails, null for hits: by its category, then no result, another document, another unit."""
    special = F.when(category.isin("hierarchy", "amendment"), F.concat(category, F.lit("_failure"))).when(category == "gazette_order", "gazette_failure")
    return F.when(hit, None).otherwise(F.coalesce(special, F.when(top_document.isNull(), "no_answer_failure").when(top_document != expected, "wrong_document").otherwise("wrong_unit_in_right_document")))


def alias_lookup(units: DataFrame) -> DataFrame:
    """alias (lower case) and act_title of units(act_title, document_aliases), each pair once."""
    names = F.concat(F.array("act_title"), F.coalesce("document_aliases", F.array().cast("array<string>")))
    return units.select(F.explode(F.transform(names, F.lower)).alias("alias"), "act_title").where("alias <> ''").distinct()


def named_documents(questions: DataFrame, aliases: DataFrame) -> DataFrame:
    """query_id, referenced: the act with the longest alias in a question (the first alias, then title, at a tie)."""
    met = names_in(questions, aliases)
    return met.groupBy("query_id").agg(F.min_by("act_title", F.struct(-F.char_length("alias"), c("alias"), c("act_title"))).alias("referenced"))


def judged(benchmark: DataFrame, results: DataFrame, aliases: DataFrame, k: int = 3) -> DataFrame:
    """Every benchmark question of every mode in results(mode, query_id, rank, act_title, unit): hits, negative success, bucket.

    benchmark: query_id, query, category, expected_doc, expected_unit. Questions without an expected document or unit, or of
    the category negative, succeed if no result is of the act that they name, or without one if there is no result.
    """
    modes = results.select("mode").distinct()
    fits = (c("act_title") == c("expected_doc")) & (c("unit") == c("expected_unit"))
    rows = benchmark.crossJoin(modes).join(results.where(c("rank") <= k), ["mode", "query_id"], "left").join(named_documents(benchmark, aliases), "query_id", "left")
    hit = lambda n: F.coalesce(F.max(fits & (c("rank") <= n)), F.lit(False))
    keys = ["mode", "query_id", "category", "expected_doc", "expected_unit", "referenced"]
    out = rows.groupBy(*keys).agg(hit(1).alias("hit_at_1"), hit(3).alias("hit_at_3"), F.max(F.when(c("rank") == 1, c("act_title"))).alias("top_document"), F.count("rank").alias("n"), F.coalesce(F.max(c("act_title") == c("referenced")), F.lit(False)).alias("names_it"))
    negative = c("expected_doc").isNull() | c("expected_unit").isNull() | (c("category") == "negative")
    quiet = F.when(c("referenced").isNull(), c("n") == 0).otherwise(~c("names_it"))
    bucket = F.when(negative, F.when(quiet, None).otherwise("no_answer_failure")).otherwise(failure_bucket(c("category"), c("hit_at_1"), c("top_document"), c("expected_doc")))
    return out.withColumns({"negative": negative, "quiet": negative & quiet, "bucket": bucket, "wrong_document": ~negative & (c("n") > 0) & (c("top_document") != c("expected_doc"))})


def mode_summary(cases: DataFrame) -> DataFrame:
    """Per mode, and per category of it (gid 0), counts and rates of judged cases."""
    sets = cases.groupingSets([[c("mode"), c("category")], [c("mode")]], "mode", "category")
    share = lambda rule, of: F.round(F.coalesce(F.try_divide(F.count_if(rule), F.count_if(of)), F.lit(0.0)), 6)
    positive = ~c("negative")
    buckets = ("hierarchy_failure", "amendment_failure", "gazette_failure", "no_answer_failure", "wrong_document", "wrong_unit_in_right_document")
    return sets.agg(
        F.grouping_id().alias("gid"),
        F.count("*").alias("questions"),
        share(positive & c("hit_at_1"), positive).alias("hit_at_1"),
        share(positive & c("hit_at_3"), positive).alias("hit_at_3"),
        share(c("wrong_document"), positive).alias("wrong_document_rate"),
        share(c("quiet"), c("negative")).alias("no_answer"),
        *(F.count_if(c("bucket") == b).alias(f"n_{b}") for b in buckets),
    )


#: Fixed value: categories that reranking is judged on.
RERANKED = ["heading_lookup", "bilingual", "amendment"]


def rerank_diagnostics(benchmark: DataFrame, results: DataFrame, triggered: DataFrame) -> DataFrame:
    """One row of counts over RERANKED questions: what is there before reranking, and what each way of reranking puts first.

    results(mode, query_id, rank, act_title, unit) of the modes hybrid, hybrid_rerank and hybrid_filtered_rerank;
    triggered(query_id, apply_rerank).
    """
    fits = (c("act_title") == c("expected_doc")) & (c("unit") == c("expected_unit"))
    asked = benchmark.where(c("category").isin(RERANKED) & c("expected_doc").isNotNull() & c("expected_unit").isNotNull())
    place = lambda mode: F.min(F.when(fits & (c("mode") == mode), c("rank")))
    ranks = asked.join(results, "query_id", "left").groupBy("query_id").agg(place("hybrid").alias("hybrid"), place("hybrid_rerank").alias("reranked"), place("hybrid_filtered_rerank").alias("filtered"))
    rows = ranks.join(triggered, "query_id")
    first = {n: F.coalesce(c(n) == 1, F.lit(False)) for n in ("hybrid", "reranked", "filtered")}
    return rows.agg(
        F.count("*").alias("focus_queries"),
        F.count_if("apply_rerank").alias("triggered_queries"),
        F.count_if(c("hybrid").isNotNull()).alias("correct_present_before_rerank"),
        F.count_if(first["hybrid"]).alias("hybrid_top1_correct"),
        F.count_if(first["reranked"]).alias("rerank_top1_correct"),
        F.count_if(first["filtered"]).alias("filtered_rerank_top1_correct"),
        F.count_if(first["hybrid"] & ~first["reranked"]).alias("hybrid_only_wins"),
        F.count_if(first["reranked"] & ~first["hybrid"]).alias("rerank_only_wins"),
        F.count_if(first["filtered"] & ~first["hybrid"]).alias("filtered_rerank_only_wins"),
    )


def best_mode(rates: DataFrame) -> DataFrame:
    """The mode with the highest (hit_at_1, hit_at_3); the first in mode_order at a tie. rates: mode, mode_order, hit_at_1, hit_at_3."""
    return rates.agg(F.min_by("mode", F.struct(-c("hit_at_1"), -c("hit_at_3"), "mode_order")).alias("mode"))


def next_ones(rows: DataFrame, name: str, other: str) -> DataFrame:
    """The distinct values of column `name`, each with the next one in order as `other`; after the last comes the first."""
    placed = in_order(rows.select(name).distinct(), c(name))
    n = placed.agg(F.max("place").alias("last"))
    wanted = placed.crossJoin(F.broadcast(n)).select(name, (c("place") % c("last") + 1).alias("place"))  # n is one row
    return wanted.join(placed.withColumnRenamed(name, other), "place").select(name, other)


def next_documents(units: DataFrame) -> DataFrame:
    """For questions that must have no answer: the second unit of each document, asked of the next one (after the last comes the first).

    units: document_id, unit_id, unit_ord. Documents with one unit give none.
    """
    nth = F.row_number().over(Window.partitionBy("document_id").orderBy("unit_ord"))
    second = units.withColumn("nth", nth).where("nth = 2").select("document_id", "unit_id")
    return second.join(next_ones(units, "document_id", "other"), "document_id").where(c("other") != c("document_id"))
