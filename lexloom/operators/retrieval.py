"""Search, filtering and reranking of chunks for batches of questions.

Every stage is a DataFrame of (question, chunk) rows with a score. Questions are a stated set: they are broadcast
while they are few, and the chunks are scanned in place; only ranked rows are shuffled, by question. Prepared
chunks, and the ranked rows between stages, are written tables. What is sorted and ranked are narrow rows (keys, scores, flags); the few
that win get their chunks' columns back.
Rankings are by score, then chunk_index, chunk_id and input order.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions import fixed_values as V
from lexloom.functions.text import cosine, first_of, norm, numeric_unit, points, words_in
from lexloom.plans import features as R
from lexloom.plans.query_context import contexts
from lexloom.sources.tables import along, compiled_in_parts, written

c = F.col
MODES = ("lexical", "embedding", "hybrid", "hybrid_rerank", "hybrid_filtered_rerank")
#: More questions than this are not broadcast.
BROADCAST_QUERIES = 2_000
#: Texts keep all their words if questions have more different ones than this.
ASKED_WORDS = 2_000
#: Columns of a narrow row: the question, the prepared chunk, and what orders equal scores.
KEYS = ["query_id", "row_key", "chunk_index", "chunk_id", "entry_ord"]
RESULT = ["query_id", "rank", "score", "chunk_id", "document_id", "section_heading", "section_id", "chunk_index"]


def few(queries: DataFrame) -> DataFrame:
    """A written table of questions, broadcast if it is small."""
    return F.broadcast(queries) if queries.limit(BROADCAST_QUERIES + 1).count() <= BROADCAST_QUERIES else queries


def general_order() -> list[Column]:
    return [c("first_key"), c("second_key"), c("score").desc(), c("chunk_index"), c("chunk_id"), c("entry_ord")]


def in_order(*first: Column) -> Window:
    return Window.partitionBy("query_id").orderBy(*first, c("score").desc(), "chunk_index", "chunk_id", "entry_ord")


def top(rows: DataFrame, k: int, *first: Column) -> DataFrame:
    """The k best rows of each question, with their rank."""
    return rows.withColumn("rank", F.row_number().over(in_order(*first))).where(c("rank") <= k)


def referenced_documents(prepared: DataFrame, ctx: DataFrame) -> DataFrame:
    """query_id, ref_document, ref_path, ref_names (its telling names): the document that a question names best, if it names one whole.

    A document is judged by its first chunk; the earlier document wins a tie.
    """
    document = ["document_id", "source_path"]
    first = prepared.groupBy(*document).agg(F.min("entry_ord").alias("entry_ord"))
    heads = prepared.select(*document, "entry_ord", "act_title", "names", "name_words").join(first, [*document, "entry_ord"])
    scored = heads.join(ctx).withColumn("score", R.document() + R.tie_break()).where(c("score") >= 1.0)
    best = F.min_by(F.struct(c("document_id").alias("ref_document"), c("source_path").alias("ref_path"), R.telling_names(c("names")).alias("ref_names")), F.struct(-c("score"), "entry_ord"))
    return scored.groupBy("query_id").agg(best.alias("best")).select("query_id", "best.*")


def impossible_units(prepared: DataFrame, ctx: DataFrame, referenced: DataFrame) -> DataFrame:
    """query_id of questions for a unit whose number is above all of that type in the document they name."""
    asked = ctx.where("has_unit").join(referenced, "query_id").select("query_id", "unit_type", numeric_unit(c("unit_id")).alias("asked"), "ref_document", "ref_path")
    units = prepared.select("document_id", "source_path", F.lower("chunk_unit_type").alias("unit_type"), "number").where("number IS NOT NULL")
    highest = units.groupBy("document_id", "source_path", "unit_type").agg(F.max("number").alias("highest"))
    met = asked.join(highest, (asked["ref_document"] == highest["document_id"]) & (asked["ref_path"] == highest["source_path"]) & (asked["unit_type"] == highest["unit_type"]))
    return met.where(c("asked") > c("highest")).select("query_id")


def boosts() -> dict[str, Column]:
    return {
        "lexical": R.lexical(),
        "document": R.document(),
        "subsection": R.subsection(),
        "definition": R.definition(),
        "recall": R.recall(),
        "hierarchy": R.hierarchy(),
        "obligation_text": R.obligation_text(),
        "obligation_heading": R.obligation_heading(),
        "obligation_internal": R.obligation_internal(),
        "obligation_definition": R.obligation_definition(),
        "agreement": R.agreement(),
    }


def with_vectors(prepared: DataFrame, vectors: DataFrame | None) -> DataFrame:
    """Prepared chunks, which hold no texts, with their vectors. Vectors are hashed, so chunks need no sort; the way is the same for any number of them."""
    return prepared if vectors is None else prepared.join(vectors.hint("shuffle_hash"), "vec_id", "left")


def with_semantics(prepared: DataFrame, ctx: DataFrame, vectors: DataFrame) -> DataFrame:
    """Prepared chunks with `semantics`: the cosine of their vector with that of each question, by query_id. It is found once a vector, however many chunks share it."""
    theirs = ctx.agg(F.collect_list(F.struct("query_id", "query_vector", norm(c("query_vector")).alias("query_norm"))).alias("asked"))
    near = lambda q: F.struct(q["query_id"], cosine(q["query_vector"], c("embedding"), (q["query_norm"], c("embedding_norm"))))
    found = vectors.withColumn("embedding_norm", norm(c("embedding"))).join(F.broadcast(theirs)).select("vec_id", F.map_from_entries(F.transform("asked", near)).alias("semantics"))
    return prepared.join(found.hint("shuffle_hash"), "vec_id", "left")


def _few_ids(ctx: DataFrame) -> bool:
    """Are these few questions, each with an id of its own?"""
    n, ids = ctx.agg(F.count("*"), F.count_distinct("query_id")).first()
    return n == ids and n <= BROADCAST_QUERIES


def general_pairs(prepared: DataFrame, ctx: DataFrame, referenced: DataFrame, modes: tuple[str, ...], vectors: DataFrame | None = None) -> DataFrame:
    """Every chunk with every question, narrow: KEYS, score_<mode> of the general scan, and what ranking asks of the pair.

    Semantic similarity below 0 counts as none. `moved` is what the refinement by document adds.
    vectors: vec_id, embedding, if chunks have vec_id instead of embedding.
    """
    used = {name for mode in modes for name, weight in V.MODE_WEIGHTS[mode].items() if weight}
    semantic = {}
    if "semantic" in used and vectors is not None and _few_ids(ctx):
        semantic = {"semantic": F.greatest(F.lit(0.0), F.element_at("semantics", c("query_id")))}
        prepared = with_semantics(prepared, ctx, vectors)
        ctx = ctx.drop("query_vector")
    elif "semantic" in used:
        semantic = {"semantic": F.greatest(F.lit(0.0), cosine(c("query_vector"), c("embedding"), (c("query_norm"), c("embedding_norm"))))}
        ctx = ctx.withColumn("query_norm", norm(c("query_vector")))
        prepared = with_vectors(prepared, vectors).withColumn("embedding_norm", norm(c("embedding")))
    wanted = boosts() | semantic
    parts = {f"part_{name}": value for name, value in wanted.items() if name in used | {"document", "obligation_internal", "hierarchy", "obligation_text", "obligation_definition", "recall"}}
    part = lambda name: c(f"part_{name}")
    scores = {f"score_{mode}": sum((part(name) * V.MODE_WEIGHTS[mode][name] for name in wanted if V.MODE_WEIGHTS[mode][name]), F.lit(0.0)) for mode in modes}
    rows = prepared.join(ctx).join(referenced, "query_id", "left").withColumns(parts).withColumns(scores).withColumns(calls(part))
    scored = F.greatest(*(c(x) for x in scores), F.lit(0.0)) > 0
    return rows.select(*KEYS, *scores, part("document").alias("named"), part("obligation_internal").alias("internal"), *calls(part), "obligation", inside().alias("inside"), F.when(scored, moves()).alias("moved"))


def exact_units(prepared: DataFrame, ctx: DataFrame) -> DataFrame:
    """Chunks of the very unit that a question names."""
    met = prepared.join(ctx.where("exact_lookup"), (F.lower("chunk_unit_type") == c("unit_type")) & (F.upper("unit") == c("unit_id")))
    b = boosts()
    score = 10.0 + b["document"] * 2.0 - b["obligation_definition"]
    for name in ("subsection", "definition", "recall", "hierarchy", "obligation_text", "obligation_heading", "obligation_internal", "lexical"):
        score = score + b[name]
    return met.withColumn("score", score)


def neighbours(chunks: DataFrame) -> DataFrame:
    """row_key, place, open_marker, next_run of every chunk: where it stands in its document, the place of the last chunk with a
    marker before it, and that of the next chunk which begins another unit."""
    own = ["chunk_index", "chunk_id", "entry_ord"]
    slim = chunks.select("row_key", "document_id", "source_path", *own, "unit", F.struct(*own).alias("place"), (F.size("markers") > 0).alias("marked"))
    group = ["document_id", "source_path"]
    known = along(slim, group, own, last={"open_marker": F.when(c("marked"), c("place")), "before": F.struct("unit")})
    begins = ~c("unit").eqNullSafe(c("before.unit"))
    return along(known, group, own, following={"next_run": F.when(begins, c("place"))}).select("row_key", "place", "open_marker", "next_run")


def hierarchy_units(prepared: DataFrame, ctx: DataFrame, referenced: DataFrame) -> DataFrame:
    """Chunks with the asked marker in the named document, the definition units in its scope, and what begins it: KEYS and score.

    A chunk that is found in several ways has its best score. What stands in a scope, and what comes after a chunk, is looked up
    from the chunk's own neighbours, so a document's chunks meet once, as narrow rows.
    """
    asked = written(ctx.where("hierarchy").join(referenced.drop("ref_names"), "query_id"), "asked")
    named_documents = asked.select(c("ref_document").alias("document_id"), c("ref_path").alias("source_path")).distinct()
    chunks = prepared.join(few(named_documents), ["document_id", "source_path"], "left_semi")
    met = chunks.join(few(asked), (c("document_id") == c("ref_document")) & (c("source_path") == c("ref_path")))
    inner = F.lower("chunk_unit_type").isin("article", "perkara")
    opening = points((F.lit(True), 1.5), (c("starts_with_heading"), -2.0), (c("compact_tail"), -1.0), (F.lower("chunk_unit_type") == "section", 1.0), (inner, -1.5))
    reliability = c("position_bonus") - c("xref_penalty") * 2.0 + points((c("marked_tail"), 0.75))
    lead = first_of((c("starts_with_heading") & c("compact_tail"), 0.5), (c("starts_with_heading"), 1.25), (c("compact_tail"), 3.0), (F.lit(True), 0.75)) + points((inner, 1.5)) - c("xref_penalty") * 1.5
    defines = c("definition") & (F.size("markers") == 0)
    slim = met.select(
        *KEYS,
        (R.document() * 3.0 + R.lexical()).alias("named"),
        (reliability).alias("reliability"),
        F.when(c("begin"), opening).otherwise(0.0).alias("opening_score"),
        lead.alias("lead"),
        "position_bonus",
        R.has_marker().alias("anchor"),
        defines.alias("defines"),
        F.when(defines, R.scope_definition()).alias("scope_score"),
        "begin",
        F.coalesce(F.nullif("unit", F.lit("")), c("chunk_id")).alias("own_unit"),
    )
    rows = written(slim.join(neighbours(chunks), "row_key"), "asked-parts")
    anchors = rows.where("anchor")
    found = anchors.withColumn("score", 7.0 + c("named") + c("reliability") + c("opening_score"))
    at = anchors.select(c("query_id").alias("a_query"), c("place").alias("a_place"), c("next_run").alias("a_run"), c("lead").alias("a_lead"))
    within = rows.where("defines").join(at.select("a_query", "a_place"), (c("query_id") == c("a_query")) & (c("open_marker") == c("a_place")))
    within = within.withColumn("nth", F.row_number().over(Window.partitionBy("query_id", "a_place", "own_unit").orderBy("place"))).where("nth = 1")
    scoped = within.where("scope_score > 0").withColumn("score", 8.5 + c("named") + c("scope_score"))
    others = rows.where(c("begin")).join(at.select("a_query", "a_run", "a_lead"), (c("query_id") == c("a_query")) & (c("place") == c("a_run")))
    next_units = others.withColumn("score", 6.0 + c("named") + c("position_bonus") + c("a_lead"))
    every = reduce(DataFrame.unionByName, (x.select(*KEYS, "place", "score") for x in (found, scoped, next_units)))
    best = F.row_number().over(Window.partitionBy("query_id", "chunk_id").orderBy(c("score").desc(), "place"))
    return every.withColumn("nth", best).where("nth = 1").select(*KEYS, "score")


def inside() -> Column:
    """Is a chunk of the document that the question names? Null: it names none."""
    return (c("document_id") == c("ref_document")) & (c("source_path") == c("ref_path"))


def moves() -> Column:
    """What a chunk's score gains by being of the document that the question names, or loses by being of another."""
    gain = 0.75 + R.gazette_document() + R.amendment_document() + R.heading_intent()
    return F.when(inside(), gain).when(~inside(), -R.outside_penalty(c("ref_names"))).otherwise(0.0)


def calls(part: Callable[[str], Column]) -> dict[str, Column]:
    """What may be brought into the first k rows, by the kind of question; part(name) is a boost."""
    return {
        "call_1": c("hierarchy") & (part("hierarchy") > 0),
        "call_2": c("obligation") & (part("obligation_text") > 0) & (part("obligation_definition") <= 0),
        "call_3": part("recall") > 0,
    }


def rank_general(pairs: DataFrame, mode: str, k: int) -> DataFrame:
    """Rows of a general scan of which some are among the first k, or are choices for inject_recall: `list` 0, or the call that they fit, and `nth` in it.

    Questions of duty that name a document have its chunks first, if there are any. One pass sums up the questions;
    the next ranks each row for itself and for every call that it fits, and k + 3 rows of each leave a task.
    Adds n_ranked and any_named, over all rows of the question.
    """
    first = c(f"score_{mode}")
    rows = pairs.where(first > 0).withColumn("score", first + c("moved"))
    named = c("named") >= 1.0
    sums = rows.groupBy("query_id").agg(F.count("*").alias("n_ranked"), F.max(named).alias("any_named"), F.max(F.coalesce("inside", F.lit(False))).alias("any_inside"))
    rows = rows.join(few(written(sums, "sums")), "query_id")
    preferred = c("obligation") & c("inside").isNotNull()
    weight = c("score") + c("internal") * 1.5 + c("named") * 2.0
    fits = F.array(F.lit(0), *(F.when(named & c(f"call_{i}"), i) for i in (1, 2, 3)))
    rows = rows.withColumns({"first_key": F.when(preferred & c("inside"), 0).otherwise(1), "second_key": F.when(preferred & c("any_inside"), -weight).otherwise(-c("score"))})
    listed = rows.select(*KEYS, "score", "first_key", "second_key", "named", "call_1", "call_2", "call_3", "n_ranked", "any_named", F.explode(F.array_compact(fits)).alias("list"))
    return listed.withColumn("nth", F.row_number().over(Window.partitionBy("query_id", "list").orderBy(*general_order()))).where(c("nth") <= k + 3)


def general_rows(listed: DataFrame, k: int) -> DataFrame:
    """Rows of rank_general for this k or a greater one, each once and with its rank: no more than the first k, and the choices for inject_recall, need."""
    once = F.row_number().over(Window.partitionBy("query_id", "chunk_id", "entry_ord").orderBy("list"))
    kept = listed.where(c("nth") <= k + 3).withColumn("nth", once).where("nth = 1").drop("nth", "list")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*general_order())))


def inject_recall(rows: DataFrame, k: int) -> DataFrame:
    """The k first rows of each question; up to three times the last one gives way to the best row outside that the question's kind calls for.

    After a change the rows are in score order. Only questions that name a document whole, and have more than k rows, change.
    """
    per_query = Window.partitionBy("query_id")
    rows = rows.withColumn("slot", F.when(c("rank") <= k, c("rank")))
    for call in ("call_1", "call_2", "call_3"):
        fits = (c("n_ranked") > k) & c("any_named") & c("slot").isNull() & (c("named") >= 1.0) & c(call)
        rows = rows.withColumn("chosen", F.min(F.when(fits, c("rank"))).over(per_query))
        stays = c("slot").isNotNull() & (c("chosen").isNull() | (c("slot") < k))
        rows = rows.withColumn("member", stays | F.coalesce(c("rank") == c("chosen"), F.lit(False)))
        anew = F.row_number().over(in_order(F.when(c("member"), 0).otherwise(1)))
        rows = rows.withColumn("anew", anew).withColumn("slot", F.when(c("member"), F.when(c("chosen").isNull(), c("slot")).otherwise(c("anew")))).drop("chosen", "member", "anew")
    return rows.where("slot IS NOT NULL").withColumn("rank", c("slot"))


def candidate_features(rows: DataFrame) -> DataFrame:
    out = rows.withColumns({"f_lexical": R.lexical(), "f_heading": R.heading_match(), "f_document": R.rerank_document(), "f_definition": R.definition(), "f_exact": R.exact_unit()})
    out = out.withColumn("f_weak", (c("f_lexical") < 0.2) & (c("f_heading") <= 0))
    score = (
        c("score") * 0.45
        + c("f_lexical") * 2.4
        + c("f_heading") * 2.8
        + c("f_document") * 3.0
        + c("f_definition") * 1.5
        + c("f_exact") * 1.5
        - c("xref_penalty") * 1.5
        + R.agreement() * 2.0
        + points((c("definition") & (c("f_definition") <= 0), -1.0), (c("f_weak"), -0.5))
    )
    return out.withColumn("pre_rank", score)


def filter_candidates(rows: DataFrame, k: int = V.RERANK_POOL) -> DataFrame:
    """Drop candidates that the question's other candidates outclass, keep the k best by pre-rank score; all stay if all would go."""
    q = Window.partitionBy("query_id")
    rows = candidate_features(rows)
    rows = rows.withColumns(
        {
            "n_named": F.sum(F.when(c("f_document") >= 1.0, 1).otherwise(0)).over(q),
            "any_heading": F.max(c("f_heading") > 0).over(q),
            "any_definition": F.max(c("f_definition") > 0).over(q),
        }
    )
    elsewhere = (c("n_named") >= 2) & (c("f_document") == 0) & (c("f_heading") <= 0) & (c("f_exact") <= 0)
    undefined = c("definition") & c("any_definition") & (c("f_definition") <= 0) & (c("f_heading") <= 0) & (c("f_document") <= 0)
    weak = c("any_heading") & (c("f_heading") <= 0) & (c("f_lexical") < 0.2) & (c("f_document") <= 0) & (c("f_exact") <= 0)
    by_pre_rank = Window.partitionBy("query_id").orderBy(c("pre_rank").desc(), "chunk_index", "chunk_id", "entry_ord")
    rows = rows.withColumns({"kept": ~elsewhere & ~undefined, "weak": weak})
    nth_weak = F.sum(F.when(c("kept") & c("weak"), 1).otherwise(0)).over(by_pre_rank.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("kept", c("kept") & (~c("weak") | (nth_weak <= V.WEAK_KEPT)))
    rows = rows.withColumn("any_kept", F.max("kept").over(q)).where(c("kept") | ~c("any_kept")).withColumn("score", F.when(c("any_kept"), c("pre_rank")).otherwise(c("score")))
    helpers = ["f_lexical", "f_heading", "f_document", "f_definition", "f_exact", "f_weak", "pre_rank", "n_named", "any_heading", "any_definition", "kept", "weak", "any_kept"]
    return top(rows.drop("rank"), k).drop(*helpers)


def refine_headings(rows: DataFrame) -> DataFrame:
    """Among the rows of the top row's document, give their places anew by how well headings fit; other rows keep theirs."""
    q = Window.partitionBy("query_id")
    first = F.first(F.struct("document_id", "source_path")).over(q.orderBy("rank"))
    rows = rows.withColumn("focus", c("refine_headings") & (F.struct("document_id", "source_path") == first)).withColumn("fit", R.alignment())
    rows = rows.withColumn("focus", c("focus") & (F.max(F.when(c("focus"), F.abs("fit"))).over(q) > 0))
    weight = c("score") * 0.35 + c("fit") * 2.5 + R.specificity() * 1.5
    group = Window.partitionBy("query_id", "focus")
    rows = rows.withColumns({"place": F.row_number().over(group.orderBy("rank")), "new_place": F.row_number().over(group.orderBy(weight.desc(), "chunk_index", "chunk_id", "entry_ord"))})
    places = F.array_sort(F.collect_list(F.struct("place", "rank")).over(group))
    rows = rows.withColumn("rank", F.when(c("focus"), F.element_at(places, c("new_place").cast("int"))["rank"]).otherwise(c("rank")))
    return rows.drop("focus", "fit", "place", "new_place")


def rerank(rows: DataFrame, k: int, signals: DataFrame | None = None) -> DataFrame:
    """Score ranked candidates anew by legal signals; signals(query_id, chunk_id, strength, position, reason) are of the graph."""
    if signals is not None:
        rows = rows.join(signals, ["query_id", "chunk_id"], "left")
        graph = R.graph_boost(c("strength"), c("position"), c("reason"))
    else:
        graph = F.lit(0.0)
    known = c("heading_lookup") | c("amendment")
    rows = rows.withColumn("any_definition", F.max(R.definition() > 0).over(Window.partitionBy("query_id")))
    score = (
        c("score") * F.when(known, 0.5).otherwise(0.35)
        + R.heading_match() * F.when(c("heading_lookup"), 2.2).otherwise(1.4)
        + R.definition() * 1.6
        + R.position() * F.when(known, 0.25).otherwise(0.9)
        + R.exact_unit() * 1.6
        + R.rerank_document() * 2.0
        + R.amendment_rerank()
        + graph
        - c("xref_penalty") * F.when(c("amendment"), 0.45).otherwise(1.1)
        - R.definition_mismatch() * 2.0
        - (c("rank") - 1) * 0.01
        + F.when(c("any_definition") & c("definition"), F.when(R.definition() > 0, 2.0).otherwise(-0.75)).otherwise(0.0)
    )
    rows = rows.withColumn("score", score).drop("any_definition", "rank", "strength", "position", "reason")
    rows = rows.withColumn("rank", F.row_number().over(in_order()))
    return refine_headings(rows).where(c("rank") <= k)


def leaves_order(rows: DataFrame) -> DataFrame:
    """Add `settled`: questions whose ranked candidates are not to be reranked."""
    q = Window.partitionBy("query_id")
    first = F.first(F.struct("document_id", "source_path")).over(q.orderBy("rank"))
    rows = rows.withColumn("same", F.struct("document_id", "source_path") == first)
    gap = F.max(F.when(c("rank") == 1, c("score"))).over(q) - F.max(F.when(c("rank") == 2, c("score"))).over(q)
    clear = (c("heading_lookup") | c("amendment") | c("hierarchy") | c("obligation")) & ~(c("refine_headings") & (F.sum(c("same").cast("int")).over(q) >= 2)) & (gap >= V.CONFIDENT_MARGIN)
    undefined = c("definition") & ~F.max(R.definition() > 0).over(q)
    single = F.count("*").over(q) < 2
    return rows.withColumn("settled", F.coalesce(~c("apply_rerank") | undefined | single | clear, F.lit(False))).drop("same")


def narrowed(chunks: DataFrame, ctx: DataFrame) -> DataFrame:
    """Prepared chunks for these questions: of a text's words and phrases those that a question asks for."""
    words = ctx.select(F.explode("tokens").alias("word")).distinct().limit(ASKED_WORDS + 1).collect()
    if len(words) > ASKED_WORDS:  # all words are kept
        return R.prepare(chunks.join(F.broadcast(R.sought_phrases(ctx))), c("sought")).drop("sought", "text", "n_words")
    asked = F.broadcast(R.sought_phrases(ctx)).select("sought", R.forms_of(words_in([w["word"] for w in words])).alias("forms")).first()
    return R.prepare(chunks, phrases=asked["sought"], forms=asked["forms"]).drop("text", "n_words")


def prepared_chunks(chunks: DataFrame, ctx: DataFrame) -> DataFrame:
    """narrowed as a written table, with a row_key."""
    with compiled_in_parts(chunks.sparkSession):
        return written(narrowed(chunks, ctx).withColumn("row_key", F.monotonically_increasing_id()), "chunks")


class Scan(NamedTuple):
    """What scans of all chunks have found, as narrow written tables: KEYS and scores. It serves every k up to the one that it was made for."""

    prepared: DataFrame
    ctx: DataFrame
    #: The very unit that a question names: score and refined score.
    exact: DataFrame
    #: The part that it names.
    parts: DataFrame
    #: rank_general by mode.
    general: dict[str, DataFrame]


def scan(prepared: DataFrame, ctx: DataFrame, k: int, modes: tuple[str, ...], vectors: DataFrame | None = None) -> Scan:
    """Scans for questions; all modes are scored in one pass. prepared: of prepared_chunks; vectors: as in search."""
    hinted = few(ctx)
    referenced = few(written(referenced_documents(prepared, hinted), "referenced"))
    ctx = few(written(hinted.join(impossible_units(prepared, ctx, referenced), "query_id", "left_anti"), "questions"))
    score, move = c("score"), moves()
    special = ctx if set(modes) != {"embedding"} else ctx.where(F.lit(False))
    met = exact_units(prepared, special).join(referenced, "query_id", "left").select(*KEYS, score, (score + move).alias("refined"))
    exact = written(top(met, k), "exact")
    others = few(written(special.join(exact.select("query_id").distinct(), "query_id", "left_anti"), "questions"))
    parts = written(top(hierarchy_units(prepared, others, referenced), k), "parts")
    found = few(written(exact.select("query_id").union(parts.select("query_id")).distinct(), "found"))
    others = few(written(ctx.join(found, "query_id", "left_anti"), "questions"))
    with compiled_in_parts(prepared.sparkSession):
        pairs = written(general_pairs(prepared, ctx if "embedding" in modes else others, referenced, modes, vectors), "pairs")
    own = lambda mode: pairs if mode == "embedding" else pairs.join(found, "query_id", "left_anti")
    return Scan(prepared, ctx, exact, parts, {mode: written(rank_general(own(mode), mode, k), "ranked") for mode in modes})


def base_rows(found: Scan, k: int, mode: str) -> DataFrame:
    """lexical, embedding or hybrid: the exact unit if a question names one that is there, else the part it names, else the general scan. KEYS, score, rank."""
    general = general_rows(found.general[mode], k)
    general = (inject_recall(general, k) if mode == "hybrid" else general.where(c("rank") <= k)).select(*KEYS, "score", "rank")
    if mode == "embedding":
        return general
    exact = top(found.exact.where(c("rank") <= k).drop("rank").withColumn("score", c("refined")).drop("refined"), k)
    return exact.unionByName(found.parts.where(c("rank") <= k)).unionByName(general)


def whole(found: Scan, rows: DataFrame) -> DataFrame:
    """Ranked narrow rows with all columns of their chunks and questions."""
    slim = few(written(rows.select("query_id", "row_key", "score", "rank"), "ranked"))
    return found.prepared.join(slim, "row_key").join(found.ctx, "query_id")


def base_search(found: Scan, k: int, mode: str) -> DataFrame:
    return whole(found, base_rows(found, k, mode))


def finished(base: DataFrame, k: int, mode: str) -> DataFrame:
    """RESULT of a written hybrid pool, reranked, where that is called for."""
    plain = base.where(~c("apply_rerank") & (c("rank") <= k))
    pooled = base.where("apply_rerank")
    if mode == "hybrid_filtered_rerank":
        pooled = filter_candidates(pooled)
    pooled = written(leaves_order(pooled), "pool")
    done = rerank(pooled.where("NOT settled").drop("settled"), k)
    return plain.select(*RESULT).unionByName(pooled.where(c("settled") & (c("rank") <= k)).select(*RESULT)).unionByName(done.select(*RESULT))


def pool_size(mode: str, k: int) -> int:
    """How many rows of a question a mode's base search has."""
    return max(k, {"hybrid_rerank": V.RERANK_POOL, "hybrid_filtered_rerank": V.FILTER_POOL}.get(mode, k))


def search_modes(chunks: DataFrame, queries: DataFrame, k: int, modes: tuple[str, ...], vectors: DataFrame | None = None) -> dict[str, DataFrame]:
    """The results of `search` in several modes; chunks are prepared and scored once for all."""
    for mode in modes:
        if mode not in MODES:
            raise ValueError(f"mode is one of {', '.join(MODES)}")
    weights = {mode: mode if mode in V.MODE_WEIGHTS else "hybrid" for mode in modes}
    ctx = contexts(queries)
    if set(weights.values()) == {"lexical"}:
        chunks = chunks.drop("embedding")
    else:
        ctx = ctx.join(queries.select("query_id", "query_vector"), "query_id")
    ctx = written(ctx, "questions")
    found = scan(prepared_chunks(chunks, ctx), ctx, max(pool_size(mode, k) for mode in modes), tuple(dict.fromkeys(weights.values())), vectors)
    out = {}
    for mode in modes:
        base = base_search(found, pool_size(mode, k), weights[mode])
        out[mode] = base.select(*RESULT) if mode == weights[mode] else finished(written(base, "candidates"), k, mode)
    return out


def search(chunks: DataFrame, queries: DataFrame, k: int = 3, mode: str = "hybrid", vectors: DataFrame | None = None) -> DataFrame:
    """query_id, rank, score and the chunk of the k best chunks of each question.

    chunks: the chunk columns with embedding and entry_ord (input order); queries: query_id, query and, unless
    the mode is lexical, query_vector. Where vectors are a table of their own (vec_id, embedding), chunks have vec_id
    instead of embedding: the vectors then meet the prepared chunks, not their texts. Blank questions, and those for a unit that their document cannot have,
    have no rows.
    """
    return search_modes(chunks, queries, k, (mode,), vectors)[mode]
