"""Columns of JSON texts whose fields are known only when they are read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

c = F.col


def field_sums(rows: DataFrame, by: str, json_col: str, path: str) -> DataFrame:
    """Per value of `by`: rows, valid (JSON texts), present, total, least and greatest of the whole number at path, and the schema that all valid texts have together.

    A text is parsed once, into a variant. Texts that are no JSON, nulls and fields of other types count as rows only.
    """
    parsed = rows.select(by, F.try_parse_json(json_col).alias("v"))
    number = F.try_variant_get("v", path, "bigint")
    return (
        parsed.withColumn("x", number)
        .groupBy(by)
        .agg(F.count("*").alias("rows"), F.count("v").alias("valid"), F.count("x").alias("present"), F.sum("x").alias("total"), F.min("x").alias("least"), F.max("x").alias("greatest"), F.schema_of_variant_agg("v").alias("schema"))
    )
