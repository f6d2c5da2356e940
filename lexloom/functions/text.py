"""Text functions on columns: tokens, normal forms, previews, digests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexloom.functions import fixed_values as V


def words_in(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def has(text: Column, *terms: str) -> Column:
    """Does the text contain any of the terms?"""
    return reduce(lambda a, b: a | b, (text.contains(t) for t in terms))


def points(*rules: tuple[Column, float]) -> Column:
    """Sum of the weights of the rules that hold; a rule that is null does not."""
    return reduce(lambda a, b: a + b, (F.when(rule, F.lit(float(weight))).otherwise(0.0) for rule, weight in rules))


def first_of(*rules: tuple[Column, float]) -> Column:
    """Weight of the first rule that holds, else 0."""
    out = None
    for rule, weight in rules:
        out = F.when(rule, float(weight)) if out is None else out.when(rule, float(weight))
    return out.otherwise(0.0)


def normal_token(token: Column) -> Column:
    forms = F.create_map(*(F.lit(x) for pair in V.NORMAL_FORMS.items() for x in pair))
    # a set tells the few words that have another form; a map would be searched word by word
    return F.when(token.isin(list(V.NORMAL_FORMS)), F.element_at(forms, token)).otherwise(token)


def all_tokens(text: Column) -> Column:
    """Normal forms of the ASCII letter and digit runs of the lower-cased text, in order."""
    return F.transform(F.regexp_extract_all(F.lower(text), F.lit(V.TOKEN), 1), normal_token)


def tokens(text: Column, stopwords: list[str] = V.QUERY_STOPWORDS) -> Column:
    """all_tokens without stopwords (tested on the normal form)."""
    return F.filter(all_tokens(text), lambda t: ~t.isin(stopwords))


def normalized(text: Column) -> Column:
    return F.array_join(all_tokens(text), " ")


def query_surface(text: Column) -> Column:
    """Gazette abbreviations spelled out, lower case, then the fixed replacements in their order."""
    out = F.lower(F.regexp_replace(text, V.PUA, " pua order "))
    for source, target in V.SURFACE_REPLACEMENTS:
        out = F.replace(out, F.lit(source), F.lit(target))
    return out


def heading_core(heading: Column) -> Column:
    return F.trim(normalized(F.regexp_replace(F.trim(heading), V.HEADING_PREFIX, "")))


def numeric_unit(unit: Column) -> Column:
    """All digits of a unit id as one number; null without digits."""
    return F.regexp_replace(unit, "[^0-9]", "").try_cast("bigint")


def unit_key(unit_id: Column, section_id: Column) -> Column:
    return F.coalesce(F.nullif(unit_id, F.lit("")), section_id)


def title_case(text: Column) -> Column:
    """Each run of letters starts with a capital and goes on in lower case."""
    runs = F.regexp_extract_all(text, F.lit(r"(\p{L}+|[^\p{L}]+)"), 1)
    return F.array_join(F.transform(runs, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substr(x, F.lit(2))))), "")


def is_upper(text: Column) -> Column:
    """No lower-case letter, and at least one capital."""
    return (text == F.upper(text)) & (text != F.lower(text))


_BLANKS = " \t\n\r\f\v"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(_BLANKS))


def one_line(text: Column) -> Column:
    """Stripped non-empty lines, joined by blanks."""
    return F.array_join(F.filter(F.transform(F.split(text, r"\R"), strip), lambda x: x != ""), " ")


def cut_at_blank(text: Column, limit: int) -> Column:
    """A text longer than limit ends at its last blank within it, with `...`."""
    cut = strip(F.regexp_replace(F.substring(text, 1, limit), " [^ ]*$", ""))
    return F.when(F.char_length(text) <= limit, text).otherwise(F.concat(cut, F.lit("...")))


def preview(text: Column, limit: int = 260) -> Column:
    return cut_at_blank(one_line(text), limit)


def first_sentence(text: Column, limit: int = 280) -> Column:
    flat = one_line(text)
    sentence = strip(F.substring_index(flat, ". ", 1))
    return cut_at_blank(F.when(sentence != "", sentence).otherwise(flat), limit)


def dedupe_key(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(left: Column, right: Column, norms: tuple[Column, Column] | None = None) -> Column:
    """Cosine of the common prefix of two vectors' dimensions; 0 where a norm is 0. norms: where each vector's norm is known from before pairs were made."""
    n = F.least(F.size(left), F.size(right))
    dot = F.aggregate(F.zip_with(F.slice(left, F.lit(1), n), F.slice(right, F.lit(1), n), lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
    left_norm, right_norm = norms or (norm(left), norm(right))
    size = left_norm * right_norm
    return F.when(size == 0, 0.0).otherwise(dot / size)


def stem(path: Column) -> Column:
    """File name without its last suffix."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)/*$", 1), r"(?<=.)\.[^.]*$", "")


def hierarchy_lines(text: Column) -> Column:
    """(label, id) of the lines that are nothing but a hierarchy marker."""
    lines = F.filter(F.transform(F.split(text, r"\R"), lambda x: F.trim(x)), lambda x: x.rlike(V.HIERARCHY_LINE))
    return F.transform(lines, lambda x: F.struct(F.lower(F.regexp_extract(x, V.HIERARCHY_LINE, 1)).alias("label"), F.upper(F.regexp_extract(x, V.HIERARCHY_LINE, 2)).alias("id")))
