"""What a question asks for: one row of hints per query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions import fixed_values as V
from lexloom.functions.text import has, normal_token, normalized, query_surface, tokens, words_in


def _any(words: Column, *wanted: str) -> Column:
    return F.arrays_overlap(words, words_in(list(wanted)))


def _all(words: Column, *wanted: str) -> Column:
    return F.size(F.array_except(words_in(list(wanted)), words)) == 0


def is_agreement(q: Column) -> Column:
    worded = q.contains("employment") & has(q, "agreement", "contract") & has(q, *V.AGREEMENT_WORDS)
    return (has(q, *V.AGREEMENT_CORE_CUES) & has(q, *V.AGREEMENT_ADVICE_CUES)) | worded


def is_obligation(q: Column) -> Column:
    return (has(q, *V.OBLIGATION_CUES) & has(q, *V.OBLIGATION_WORDS)) | has(q, *V.OBLIGATION_PADDED)


def is_definition(q: Column) -> Column:
    # the cues hold wherever one of the longer question forms would: "mean" and "define" are parts of those
    return has(q, *V.DEFINITION_CUES)


def is_legal_action(q: Column) -> Column:
    return has(q, *V.LEGAL_ACTION_CUES) & has(q, *V.LEGAL_ACTION_WORDS)


def expansion(words: Column, surface: Column) -> Column:
    """Words that related questions use, by rules over the query's own."""
    order = _any(words, "order", "pua") | _all(words, "minimum", "wage")
    apply_ = F.array_contains(words, "apply")
    rules: list[tuple[Column, list[str]]] = [
        (F.array_contains(words, "appeal"), ["appeal", "right"]),
        (apply_ | _all(words, "personal", "commercial"), ["apply", "scope"]),
        (_any(words, "define", "interpret"), ["define", "interpret"]),
        (F.array_contains(words, "require"), ["require"]),
        (_any(words, "obligation", "must"), ["shall", "must", "required", "duty", "duties", "obligation"]),
        ((F.array_contains(words, "commercial") & _any(words, "urus", "niaga")) | F.array_contains(words, "transactions"), ["commercial", "transactions", "transaction", "apply", "scope"]),
        (_all(words, "data", "pemindahan") | surface.contains("data portability"), ["data", "portability", "introduce", "new", "section", "right"]),
        (_any(words, "amendment", "principal"), ["amendment", "principal", "act"]),
        (F.array_contains(words, "commencement"), ["commencement", "operation"]),
        (order, ["order", "minimum", "wage"]),
        (order & F.array_contains(words, "exclude"), ["non", "application"]),
        (order & apply_ & _any(words, *V.MONTHS), ["effect", "rate", "wage", "minimum"]),
        (is_agreement(surface), V.AGREEMENT_EXPANSION),
    ]
    none = words_in([])
    return F.transform(F.concat(*(F.when(rule, words_in(more)).otherwise(none) for rule, more in rules)), normal_token)


def _found(text: Column, pattern: str, group: int) -> Column:
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def intents(c: dict[str, Column]) -> Column:
    q, words = c["lowered"], c["tokens"]
    rules = [
        (c["normalized"].contains("annual leave") | q.contains("cuti tahunan"), "annual leave"),
        (has(q, "revoc", "revok"), "revocation"),
        (has(q, "come into force", "comes into force", "comes into operation", "commencement", "dikuatkuasa"), "commencement"),
        (F.array_contains(words, "appeal"), "appeal"),
        (F.array_contains(words, "apply") & ~F.array_contains(words, "exclude"), "application"),
        (is_definition(q), "interpretation"),
        (q.contains("introduc") | c["normalized"].contains("data portability") | q.contains("pemindahan data"), "introduction"),
    ]
    return F.array_compact(F.array(*(F.when(rule, name) for rule, name in rules)))


def contexts(queries: DataFrame) -> DataFrame:
    """queries(query_id, query) with their hints; null and blank queries go (they have no results)."""
    base = queries.where(F.trim(F.regexp_replace("query", r"\s+", " ")) != "").select("query_id", F.col("query").alias("raw"))
    base = base.withColumns({"lowered": F.lower("raw"), "surface": query_surface(F.col("raw"))})
    base = base.withColumns({"normalized": normalized(F.col("surface")), "own_tokens": tokens(F.col("surface"))})
    q, s, own = F.col("lowered"), F.col("surface"), F.col("own_tokens")
    base = base.withColumns(
        {
            "compact": F.replace(F.col("normalized"), F.lit(" "), F.lit("")),
            "tokens": F.concat(own, F.array_except(expansion(own, s), own)),
            "unit_type": F.lower(_found(s, V.UNIT_QUERY, 1)),
            "unit_id": F.upper(_found(s, V.UNIT_QUERY, 2)),
            "subsection_id": F.upper(F.coalesce(F.nullif(_found(s, V.SUBSECTION_QUERY, 1), F.lit("")), _found(s, V.SUBSECTION_QUERY, 2))),
            "hierarchy_label": F.lower(_found(s, V.HIERARCHY_QUERY, 1)),
            "hierarchy_id": F.upper(_found(s, V.HIERARCHY_QUERY, 2)),
            "definition": is_definition(q),
            "strict_definition": has(q, *V.STRICT_DEFINITION_CUES),
            "obligation": is_obligation(q),
            "agreement": is_agreement(q),
            "capability": has(q, *V.CAPABILITY_CUES),
            "legal_action": is_legal_action(q),
            "heading_lookup": has(q, *V.HEADING_LOOKUP_CUES),
            "amendment": has(q, *V.AMENDMENT_CUES),
            "document_hint": has(F.concat(F.lit(" "), q, F.lit(" ")), *V.DOCUMENT_HINT_CUES),
            "begin": has(q, *V.BEGIN_CUES),
        }
    ).drop("own_tokens")
    words = F.col("tokens")
    base = base.withColumns(
        {
            "asked": F.array_distinct(words),
            "hierarchy": F.col("hierarchy_id").isNotNull(),
            "has_unit": F.col("unit_id").isNotNull(),
            "gazette": _any(words, "order", "pua") | q.contains("p.u.") | _all(words, "minimum", "wage"),
            "intents": intents({"lowered": q, "tokens": words, "normalized": F.col("normalized")}),
            "refine_headings": F.col("strict_definition") | F.col("amendment") | F.col("heading_lookup"),
        }
    )
    exact = F.col("has_unit") & ~(F.col("amendment") & has(q, *V.WHICH_UNIT_CUES))
    hint = F.col("document_hint")
    rerank = (
        F.when(F.col("has_unit"), False)
        .when(F.col("hierarchy") & ~F.col("strict_definition"), False)
        .otherwise(
            F.col("strict_definition")
            | F.col("amendment")
            | (F.col("heading_lookup") & (hint | F.col("gazette")))
            | has(q, *V.RERANK_CUES)
            | (F.col("obligation") & hint)
            | (F.col("capability") & (hint | F.col("legal_action")))
            | (F.col("legal_action") & hint)
        )
    )
    return base.withColumns({"exact_lookup": exact, "apply_rerank": rerank})


GRAPH_ROUTE = r"(?i)\b(amend|amends|amendment|pindaan|part|chapter|division|bahagian|bab|refers to|reference|rujuk)\b"  # fixed value


def route_mode(query: Column, requested: Column) -> Column:
    """hybrid and graph as asked; auto goes to the graph-assisted mode for words of structure, amendment and reference."""
    use = (requested == "graph") | ((requested != "hybrid") & query.rlike(GRAPH_ROUTE))
    return F.when(use, "hybrid_plus_graph_with_graph_rerank").otherwise("hybrid_filtered_rerank")
