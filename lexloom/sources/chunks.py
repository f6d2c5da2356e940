"""The chunk table: its schema, tolerant reading, and how plain documents become chunks."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.functions import fixed_values as V
from lexloom.sources.tables import in_order

_TEXT = ("chunk_id", "document_id", "section_heading", "section_id", "subsection_id", "paragraph_id", "text", "source_path", "act_title", "act_number", "source_file")
CHUNK = T.StructType(
    [T.StructField(n, T.StringType()) for n in _TEXT]
    + [
        T.StructField("chunk_index", T.IntegerType()),
        T.StructField("unit_type", T.StringType()),
        T.StructField("unit_id", T.StringType()),
        T.StructField("document_aliases", T.ArrayType(T.StringType())),
        T.StructField("embedding", T.ArrayType(T.DoubleType())),
        T.StructField("entry_ord", T.LongType()),
    ]
)
_REQUIRED = ("chunk_id", "document_id", "section_heading", "section_id", "text", "source_path")


def with_defaults(rows: DataFrame) -> DataFrame:
    """Rows of CHUNK with the reader's defaults; a row without a required value is an error."""
    for name in _REQUIRED:
        rows = rows.withColumn(name, F.when(F.col(name).isNull(), F.raise_error(F.lit(f"a chunk has no {name}"))).otherwise(F.col(name)))
    empty = {n: F.coalesce(n, F.lit("")) for n in ("act_title", "act_number", "source_file")}
    defaults = {"unit_type": F.coalesce("unit_type", F.lit("section")), "unit_id": F.coalesce("unit_id", "section_id"), "chunk_index": F.coalesce("chunk_index", F.lit(0)), "document_aliases": F.coalesce("document_aliases", F.array().cast("array<string>"))}
    return rows.withColumns(empty | defaults)


def read_chunks(spark: SparkSession, *paths: str) -> DataFrame:
    """Chunks (and vectors) from JSON lines; smoke files are left out, and entry_ord follows file and line order."""
    rows = spark.read.schema(CHUNK).json(list(paths)).select("*", F.col("_metadata.file_path").alias("_file"))
    rows = rows.where(~F.endswith("_file", F.lit(".smoke.jsonl"))).drop("_file")
    return with_defaults(rows.withColumn("entry_ord", F.coalesce("entry_ord", F.monotonically_increasing_id())))


def read_in_line_order(spark: SparkSession, *paths: str) -> DataFrame:
    """Chunks from JSON lines with entry_ord from 0 by file name, then line, whatever the files store; smoke files are left out.

    Files may be split or packed: a line's place is its split's place in the file, then its own in the split. Rows are ordered by ranges.
    """
    rows = spark.read.schema(CHUNK).json(list(paths)).select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_split"), F.monotonically_increasing_id().alias("_line"))
    placed = in_order(rows.where(~F.endswith("_file", F.lit(".smoke.jsonl"))), F.col("_file"), F.col("_split"), F.col("_line"))
    return with_defaults(placed.withColumn("entry_ord", F.col("place") - 1).drop("_file", "_split", "_line", "place"))


def read_stored(spark: SparkSession, path: str) -> DataFrame:
    """Stored chunks; a path where nothing has been written holds none."""
    try:
        return read_chunks(spark, path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CHUNK)


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Replace the table at path."""
    chunks.write.mode("overwrite").json(path)


def chunk_table(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Chunks from dictionaries, in the given order."""
    full = [{f.name: r.get(f.name) for f in CHUNK} | {"entry_ord": i} for i, r in enumerate(rows)]
    return with_defaults(spark.createDataFrame(full, CHUNK))


def window_chunks(documents: DataFrame, max_words: int = V.CHUNK_WORDS, overlap: int = V.OVERLAP_WORDS) -> DataFrame:
    """Overlapping word windows of whole texts: doc_id, chunk_index, n_words, text (words joined by blanks).

    Windows start every max_words - overlap words; the last ones may lie wholly in the overlap. Texts without
    words have none.
    """
    step = max(1, max_words - overlap)
    words = documents.select("doc_id", "source", F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"(\S+)"), 1).alias("words"))
    starts = F.sequence(F.lit(0), F.size("words") - 1, F.lit(step))
    cut = words.where(F.size("words") > 0).select("doc_id", "source", "words", F.posexplode(starts).alias("chunk_index", "start"))
    window = F.slice("words", F.col("start") + 1, F.lit(max_words))
    return cut.select("doc_id", "source", "chunk_index", F.size(window).alias("n_words"), F.array_join(window, " ").alias("text"))


def document_chunks(documents: DataFrame, max_words: int = V.CHUNK_WORDS, overlap: int = V.OVERLAP_WORDS) -> DataFrame:
    """Plain documents(doc_id, text, source) as a chunk table: the windows of a document are sections 1, 2, ... of its source's act."""
    w = window_chunks(documents, max_words, overlap)
    number = (F.col("chunk_index") + 1).cast("string")
    return w.select(
        F.concat_ws(":", "doc_id", number, "chunk_index").alias("chunk_id"),
        F.col("doc_id").cast("string").alias("document_id"),
        F.concat(F.lit("Section "), number, F.lit(" "), F.array_join(F.slice(F.split("text", " "), 1, 4), " ")).alias("section_heading"),
        number.alias("section_id"),
        F.lit(None).cast("string").alias("subsection_id"),
        F.lit(None).cast("string").alias("paragraph_id"),
        "text",
        F.concat(F.lit("corpus/"), "doc_id", F.lit(".txt")).alias("source_path"),
        F.concat(F.lit("Records of "), F.coalesce("source", F.lit("none"))).alias("act_title"),
        F.lit("").alias("act_number"),
        F.concat("doc_id", F.lit(".txt")).alias("source_file"),
        F.col("chunk_index").cast("int").alias("chunk_index"),
        F.lit("section").alias("unit_type"),
        number.alias("unit_id"),
        F.array().cast("array<string>").alias("document_aliases"),
        F.lit(None).cast("array<double>").alias("embedding"),
        (F.col("doc_id") * 100_000 + F.col("chunk_index")).alias("entry_ord"),
    )
