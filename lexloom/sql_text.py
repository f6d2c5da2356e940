"""Pieces of SQL that the queries' checks share."""

from __future__ import annotations

from collections.abc import Iterable

from lexloom.functions import fixed_values as V


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def one_of(values: Iterable[str]) -> str:
    return "[" + ", ".join(map(quoted, values)) + "]"


def contains_any(name: str, cues: Iterable[str]) -> str:
    return "(" + " OR ".join(f"contains({name}, {quoted(x)})" for x in cues) + ")"


def points(*rules: tuple[str, float]) -> str:
    return "(" + " + ".join(f"CASE WHEN {rule} THEN {weight} ELSE 0 END" for rule, weight in rules) + ")"


def first_rule(*rules: tuple[str, float]) -> str:
    return "(CASE " + " ".join(f"WHEN {rule} THEN {weight}" for rule, weight in rules) + " ELSE 0 END)"


NORMAL = "CASE t " + " ".join(f"WHEN '{v}' THEN '{n}'" for v, n in V.NORMAL_FORMS.items()) + " ELSE t END"
ALL_TOKENS = "list_transform(regexp_extract_all(lower({0}), '[a-z0-9]+'), lambda t: " + NORMAL + ")"
TOKENS = "list_filter(" + ALL_TOKENS + ", lambda t: NOT list_contains(" + one_of(V.QUERY_STOPWORDS) + ", t))"
DOCUMENT_TOKENS = "list_filter(" + ALL_TOKENS + ", lambda t: NOT list_contains(" + one_of(V.DOCUMENT_STOPWORDS) + ", t))"
