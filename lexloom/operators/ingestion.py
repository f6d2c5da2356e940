"""Page lines of statutes to the text that segmentation reads.

Pages are dealt by their documents, once. Then everything is decided on a page's lines, or on a document's, where they lie: which pages are
notes or contents, which line the body starts with, and which lines just before it belong to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions.text import strip, words_in

c = F.col
# What lines and pages look like.
ACT_NUMBER = r"(?i)^Act\s+(\d+[A-Z]?|A\d+)$"
ORDER_NUMBER = r"(?i)^P\.U\.\s*\([A-Z]\)\s*\d+$"
NUMBER_BEGINS = r"(?i)^[ \t\n\r\f\x0B]*(Act|P\.U)"
NOISE_PREFIX = r"(?i)^(ACT\s+[A-Z0-9]+[,./\\-]*|P\.U\.\s*\([A-Z]\)\s*\d+[,./\\-]*)+"
NUMBER_ONLY = r"^\d+[A-Z]?\.$"
NUMBERED = r"^\d+[A-Z]?\.\s*\S"
NUMBERED_SUBSECTION = r"^\d+[A-Z]?\.\s*\(\d+[A-Z]?\)"
SUBSECTION = r"^\(\d+[A-Z]?\)"
UNIT_HEADING = r"(?i)^(Section|Article|Perkara)\s+\d+[A-Z]?\b"
STRUCTURE = r"^(Part|PART|Division|Chapter|CHAPTER|Schedule|SCHEDULE|Bahagian|BAHAGIAN|Bab|BAB|Jadual|JADUAL)\b"
UPPER = r"^[A-Z][A-Z \-&,()]+$"
CONTENTS = r"(?i)(arrangement of sections|arrangement of articles|contents)"
CONTENTS_ENTRY = r"(?i)^(Section\s+\d+[A-Z]?\b|\d+[A-Z]?\.\S?|(Chapter|Division|Part)\b|SECTION$)"
NOTES = ["NOTE:", "NOTES", "CATATAN"]
RUNNING = ["Laws of Malaysia", "LAWS OF MALAYSIA", "REPRINT"]
FRONT = ["Long Title", "LIST OF AMENDMENTS", "SECTION"]
ENACTED = "ENACTED by the Parliament of Malaysia as follows:"
BOILERPLATE = ("Unannotated Statutes of Malaysia", "Page ")


def squeezed(line: Column) -> Column:
    return strip(F.regexp_replace(line, "[ \t]+", " "))


def without_noise(line: Column) -> Column:
    """A squeezed line without header noise."""
    return F.ltrim(F.regexp_replace(line, NOISE_PREFIX, ""), F.lit(" ,./\\-"))


def is_boilerplate(line: Column) -> Column:
    return line.startswith(BOILERPLATE[0]) | line.startswith(BOILERPLATE[1])


def has_at_most(line: Column, words: int) -> Column:
    """Has the line so many words at most? Looks no further than one word more."""
    return ~line.rlike(rf"^\s*+(?:\S++\s++){{{words}}}\S")


def is_note_page(lines: Column) -> Column:
    return F.arrays_overlap(F.transform(F.slice(lines, 1, 8), strip), words_in(NOTES))


def is_contents_page(rows: Column) -> Column:
    """A contents heading in the first 12 squeezed, non-empty lines, or many short entry-like ones among the first 40."""
    first = F.slice(rows, 1, 40)
    entries, short = F.size(F.filter(first, lambda x: x.rlike(CONTENTS_ENTRY))), F.size(F.filter(first, lambda x: has_at_most(x, 8)))
    listed = F.array_contains(F.slice(rows, 1, 20), "SECTION") & (entries >= 4) & (short >= 6)
    return F.array_join(F.slice(rows, 1, 12), " ").rlike(CONTENTS) | listed | ((entries >= 12) & (short >= 16))


def continues_unit(line: Column) -> Column:
    """May the line follow a unit's heading?"""
    other = line.rlike(NUMBERED) | line.rlike(UNIT_HEADING) | line.isin(FRONT) | (line.rlike(UPPER) & has_at_most(line, 6))
    return (line != "") & (line.rlike(SUBSECTION) | ~other)


def starts_body(line: Column, following: Column) -> Column:
    after = F.coalesce(following, F.lit(""))
    followed = (after == "") | continues_unit(strip(after))
    return line.rlike(NUMBERED_SUBSECTION) | (line.rlike(NUMBERED) & followed) | (line.rlike(NUMBER_ONLY) & strip(after).rlike(SUBSECTION)) | (line.rlike(UNIT_HEADING) & followed) | line.startswith(ENACTED)


def is_context(line: Column) -> Column:
    """Does a line just before the body belong to it: structure, upper-case or short headings?"""
    front = line.rlike(CONTENTS_ENTRY) | line.isin(FRONT) | is_boilerplate(line) | line.startswith("[") | line.contains("]") | line.startswith("An Act ")
    heading = (line.rlike(UPPER) & has_at_most(line, 12)) | (~line.rlike("[.;:]$") & has_at_most(line, 16))
    return line.rlike(STRUCTURE) | (~front & heading)


def by_document(pages: DataFrame) -> DataFrame:
    """pages dealt by their documents. What works on a document's pages asks for this and so shares one shuffle; no line is moved again."""
    return pages.select("document_id", "page_number", "lines").repartition("document_id")


def first_pages(pages: DataFrame) -> DataFrame:
    """document_id, first_lines, act_number: the lines of the first page, and the first line of the first five pages that is nothing but an act's or order's number."""
    # few lines begin like a number, so few are squeezed
    near = F.transform(F.filter("lines", lambda x: x.rlike(NUMBER_BEGINS)), squeezed)
    line = F.get(F.filter(near, lambda x: x.rlike(ACT_NUMBER) | x.rlike(ORDER_NUMBER)), F.lit(0))
    found = by_document(pages).withColumn("number", line).groupBy("document_id").agg(
        F.min_by("lines", "page_number").alias("first_lines"), F.array_sort(F.collect_list(F.struct("page_number", "number"))).alias("numbers")
    )
    five = F.slice(F.array_distinct(F.transform("numbers", lambda x: x["page_number"])), 1, 5)
    early = F.filter("numbers", lambda x: x["number"].isNotNull() & F.exists(five, lambda p: p.eqNullSafe(x["page_number"])))
    return found.select("document_id", "first_lines", F.get(early, F.lit(0))["number"].alias("act_number"))


def act_numbers(pages: DataFrame) -> DataFrame:
    """document_id, act_number of the documents that have one (see first_pages)."""
    return first_pages(pages).where("act_number IS NOT NULL").select("document_id", "act_number")


def prepared_pages(pages: DataFrame) -> DataFrame:
    """document_id, page_number, note, contents, rows (prepared, following) of pages: a bare number and the bracketed line after it are one; `following` is the next in the page.

    Lines look at their neighbours by place, and an array that is worked out is asked for more than once in the next step: what is asked for
    once is written into the place where it is asked for, which may be inside a function of each line.
    """
    # judged before the lines are apart: beside posexplode a page would be judged once a line
    rows = pages.withColumn("lines", F.transform("lines", squeezed)).withColumn("filled", F.filter("lines", lambda x: x != ""))
    raw, beside = c("lines"), lambda i, by: F.get("lines", i + by)

    def joined(x: Column, i: Column) -> Column:
        head = x.rlike(NUMBER_ONLY) & F.coalesce(beside(i, 1).startswith("("), F.lit(False))
        gone = x.startswith("(") & F.coalesce(beside(i, -1).rlike(NUMBER_ONLY), F.lit(False))
        return F.struct(gone.alias("gone"), F.when(head, F.concat_ws(" ", x, beside(i, 1))).otherwise(x).alias("prepared"))

    kept = F.filter(F.transform(raw, joined), lambda x: ~x["gone"])
    judged = rows.select("document_id", "page_number", is_note_page(raw).alias("note"), is_contents_page(c("filled")).alias("contents"), kept.alias("kept"))
    followed = F.transform("kept", lambda x, i: F.struct(x["prepared"].alias("prepared"), F.get("kept", i + 1)["prepared"].alias("following")))
    return judged.select("document_id", "page_number", "note", "contents", followed.alias("rows"))


def page_lines(pages: DataFrame) -> DataFrame:
    """The lines of prepared_pages, one a row: document_id, page_number, note, contents, n, prepared, following."""
    return prepared_pages(pages).select("document_id", "page_number", "note", "contents", F.posexplode("rows").alias("n", "row")).select("document_id", "page_number", "note", "contents", "n", "row.*")


def document_lines(pages: DataFrame) -> DataFrame:
    """document_id, lines (page_number, contents, line, starts) of each document's pages in order, without note pages: cleaned lines, and whether the body could start there."""
    rows = prepared_pages(by_document(pages))
    # one function of a line after another: inside one, a line would be cleaned as often as it is asked for
    lines = F.transform("rows", lambda x: F.struct(without_noise(x["prepared"]).alias("line"), x["following"].alias("following")))
    filled = F.filter(lines, lambda x: (x["line"] != "") & ~is_boilerplate(x["line"]))
    judged = F.transform(filled, lambda x: F.struct(x["line"].alias("line"), starts_body(x["line"], x["following"]).alias("starts")))
    # null for a note page, and so not collected
    page = F.when(~c("note"), F.struct("page_number", "contents", judged.alias("rows")))
    whole = rows.groupBy("document_id").agg(F.array_sort(F.collect_list(page)).alias("pages"))
    flat = F.flatten(F.transform("pages", lambda p: F.transform(p["rows"], lambda x: F.struct(p["page_number"].alias("page_number"), p["contents"].alias("contents"), x["line"].alias("line"), x["starts"].alias("starts")))))
    return whole.select("document_id", flat.alias("lines"))


def normalized_text(pages: DataFrame, documents: DataFrame) -> DataFrame:
    """documents(document_id, act_title, act_number, ...) with text: the body's lines from its start, with up to four context lines before.

    Note pages go, contents pages go until the body has started, running heads and feet go everywhere; a blank line
    ends each page. Documents whose body does not start have an empty text.
    """
    rows = documents.join(document_lines(pages), "document_id", "left")

    def is_running(line: Column) -> Column:
        own = (line == F.coalesce("act_number", F.lit(""))) | (line == F.coalesce("act_title", F.lit("")))
        return line.rlike(r"^\d+$") | line.isin(RUNNING) | own

    # steps, each of which asks more than once for what is worked out before (see prepared_pages)
    rows = rows.withColumn("kept", F.filter("lines", lambda x: ~is_running(x["line"])))
    rows = rows.withColumn("start", F.array_position(F.transform("kept", lambda x: F.coalesce(~x["contents"] & x["starts"], F.lit(False))), True).cast("int"))
    begun = c("start") > 0
    above = F.transform(F.filter(F.slice("kept", F.lit(1), c("start") - 1), lambda x: ~x["contents"]), lambda x: x["line"])
    rows = rows.withColumns({"body": F.when(begun, F.slice("kept", c("start"), F.size("kept"))), "above": F.when(begun, above)})
    last = F.filter(F.slice("above", F.greatest(F.size("above") - 3, F.lit(1)), F.lit(4)), is_context)
    rows = rows.withColumn("last", last)
    once = F.filter("last", lambda x, i: (i == 0) | (x != F.get("last", i - 1)))
    ends = lambda x, i: ~F.coalesce(F.get("body", i + 1)["page_number"].eqNullSafe(x["page_number"]) & (i + 1 < F.size("body")), F.lit(False))
    lines = F.transform("body", lambda x, i: F.when(ends(x, i), F.concat(x["line"], F.lit("\n"))).otherwise(x["line"]))
    text = F.coalesce(strip(F.array_join(F.concat(once, lines), "\n")), F.lit(""))
    return rows.select(*documents.columns, text.alias("text"))
