"""Statutes made of the driver's documents, as input whose right results follow from how it is made.

A document's lines (their runs of ASCII letters) become sections 1, 2, ... of a statute. By a section's number it
has an explicit heading, a number under a title line, or a number on a line of its own. Files have a title
page (of five kinds), a contents page, a note page and body pages with running heads and feet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions.text import strip

c = F.col
#: Sections on a page.
PER_PAGE = 8


def _lines() -> Column:
    """The lines of `text` with letters, by their runs of letters."""
    letters = lambda x: F.array_join(F.regexp_extract_all(x, F.lit("([A-Za-z]+)"), 1), " ")
    return F.filter(F.transform(F.split("text", r"\R"), lambda x: letters(strip(x))), lambda x: x != "")


def _names() -> list[Column]:
    kind = F.pmod("doc_id", F.lit(5)).cast("int")
    return [c("doc_id").cast("string").alias("document_id"), c("doc_id"), kind.alias("kind"), F.when(kind == 2, "Perkara").otherwise("Section").alias("label")]


def sections(documents: DataFrame) -> DataFrame:
    """document_id, kind (of the title page, 0 to 4), label, i (from 1), line, for every line with letters."""
    rows = documents.select(*_names(), F.posexplode(_lines()).alias("i", "line"))
    return rows.withColumn("i", c("i") + 1)


def section_lines(label: Column, i: Column, line: Column) -> Column:
    """The lines of a section: explicit (i mod 4 = 1), on a number of its own (3), under a title (0 and 2)."""
    number = i.cast("string")
    said = F.concat(F.lit("the "), line, F.lit("."))
    second = F.concat(F.lit("(2) the "), (F.regexp_count(line, F.lit(" ")) + 1).cast("string"), F.lit(" words."))
    explicit = F.array(F.concat(label, F.lit(" "), number, F.lit(" Rules of part "), number), F.concat(F.lit("(1) "), said), second)
    alone = F.array(F.concat(number, F.lit(".")), F.concat(F.lit("(1) "), said), second)
    titled = F.array(F.concat(F.lit("Title of "), number), F.concat(number, F.lit(". "), said), F.lit("(1) first part."), F.lit("(2) second part."))
    return F.when(i % 4 == 1, explicit).when(i % 4 == 3, alone).otherwise(titled)


def files(documents: DataFrame) -> DataFrame:
    """document_id, title, source_path: a file for every document."""
    number = c("doc_id").cast("string")
    kind = F.pmod("doc_id", F.lit(5))
    title = (
        F.when(kind == 0, F.concat(F.lit("Employment_Act_1955 "), number))
        .when(kind == 1, F.concat(F.lit("doc_"), number))
        .when(kind == 2, F.concat(F.lit("Perlembagaan "), number))
        .when(kind == 3, F.concat(F.lit("20240101 Gazette_"), number, F.lit(" english")))
        .otherwise(F.concat(F.lit("Report-"), number, F.lit(" (2)")))
    )
    return documents.select(number.alias("document_id"), title.alias("title"), F.concat(F.lit("corpus/doc_"), number, F.lit(".pdf")).alias("source_path"))


def pages(documents: DataFrame) -> DataFrame:
    """document_id, page_number, lines of the files. Documents without letters have front pages only.

    A document's pages are made where it lies: its lines are cut into pages, and each page is written out by itself.
    """
    rows = documents.select(*_names(), F.coalesce(_lines(), F.array().cast("array<string>")).alias("own"))
    of_body = lambda p: F.slice("own", (p - 4) * PER_PAGE + 1, F.lit(PER_PAGE))
    last = (F.ceil(F.size("own") / PER_PAGE) + 3).cast("int")
    word = F.when(F.size("own") > 0, F.regexp_extract(F.get("own", F.lit(0)), "^[A-Za-z]+", 0)).otherwise("nothing")
    parts = F.transform(F.sequence(F.lit(1), last), lambda p: F.struct(p.alias("page_number"), F.when(p >= 4, of_body(p)).alias("part"), F.when(p == 1, word).alias("word")))
    cut = rows.select("document_id", "doc_id", "kind", "label", F.inline_outer(parts))
    act = F.concat(F.lit("Act "), (F.lit(9000) + c("doc_id") % 900).cast("string"))
    head = (
        F.when(c("kind") == 0, F.array(F.lit("LAWS OF MALAYSIA"), F.concat(F.lit("Notes on "), c("word"))))
        .when(c("kind") == 1, F.array(F.lit("LAWS OF MALAYSIA"), F.lit("REPRINT"), act, F.concat(F.lit("RECORDS OF "), F.upper("word")), F.lit("SECOND SERIES / "), F.lit("1 January 1960"), F.lit("NEVER A TITLE")))
        .when(c("kind") == 2, F.array(F.lit("12"), F.concat(F.lit(" Rules concerning "), c("word"))))
        .when(c("kind") == 3, F.array(F.lit("ÉTAT GÉNÉRAL"), F.lit("7"), F.lit("ACT 1955"), F.lit("in force")))
        .otherwise(F.array(F.lit(""), F.lit("1 January 1960"), F.lit("12")))
    )
    contents = F.array(F.lit("ARRANGEMENT OF SECTIONS"), F.lit("1. (1) not the body"), F.lit("Section 2"))
    note = F.array(F.lit(" NOTE: "), F.lit("1. (1) not the body either"))
    number = c("page_number")
    noisy = lambda lines: F.transform(lines, lambda x: F.when(x.startswith("(2)"), F.concat(F.lit("ACT 55,  "), x)).otherwise(F.concat(F.lit("  "), x, F.lit("\t"))))
    body = F.flatten(F.transform("part", lambda x, j: noisy(section_lines(c("label"), (number - 4) * PER_PAGE + j + 1, x))))
    before = F.when(number == 4, F.array(*map(F.lit, ("An Act to keep records.", "[1 January 1960]", "PART I", "PRELIMINARY", "PRELIMINARY")))).otherwise(F.array().cast("array<string>"))
    after = F.array(number.cast("string"), F.concat(F.lit("Page "), number.cast("string"), F.lit(" of many")))
    lines = F.when(number == 1, head).when(number == 2, contents).when(number == 3, note).otherwise(F.concat(F.array(F.lit("LAWS OF MALAYSIA")), before, body, after))
    return cut.select("document_id", "page_number", lines.alias("lines"))
