"""Driver tables, and intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a folder of our own where it is unset (on one machine, as in tests)."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        known = tempfile.mkdtemp(prefix="lexloom-")
        spark.sparkContext.setCheckpointDir(known)
    return known.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table on shared storage: computed once, with a short plan, safe from lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def compiled_in_parts(spark: SparkSession) -> Iterator[None]:
    """Rows of very many expressions run as several methods: the JVM interprets, and does not compile, a method of more than 8,000 bytes."""
    key = "spark.sql.codegen.hugeMethodLimit"
    known = spark.conf.get(key)
    spark.conf.set(key, "8000")
    try:
        yield
    finally:
        spark.conf.set(key, known)


def in_order(rows: DataFrame, *order: Column, place: str = "place") -> DataFrame:
    """rows with their place, from 1, in this order over all of them.

    Rows are dealt by ranges; a row's place is that in its range after the counts of the ranges before it. So no task
    holds all rows, and only one count a range is put in one order.
    """
    columns = [F.col(f"`{c}`") for c in rows.columns]
    keys = {f"key_{i}": key for i, key in enumerate(order)}
    keyed = rows.select(F.struct(*columns).alias("row"), *(key.alias(name) for name, key in keys.items()))
    dealt = written(keyed.repartitionByRange(*keys).withColumn("range", F.spark_partition_id()), "ordered")
    sizes = dealt.groupBy("range").agg(F.count("*").alias("n"))
    before = sizes.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy("range").orderBy(*keys))
    placed = dealt.join(F.broadcast(before), "range").withColumn("own", own)
    return placed.select("row.*", (F.col("before") + F.col("own")).alias(place))


def along(rows: DataFrame, group: list[str], order: list[str], last: dict[str, Column] | None = None, following: dict[str, Column] | None = None, number: str | None = None) -> DataFrame:
    """rows with what stands before and after them in their group's order.

    last[name] becomes the value of the nearest row before that has one (is not null), following[name] that of the nearest row
    after, `number` the row's place in its group from 1. Rows of equal order keep no order among each other.

    Rows are dealt by ranges of (group, order), so a group may lie in many tasks. A task looks inside its range; what it
    does not find there comes from a table of the ranges' own last and first values. Only groups that lie in several ranges need it, which are
    fewer than the ranges.
    """
    last, following = last or {}, following or {}
    lasts, nexts = {f"_last_{i}": n for i, n in enumerate(last)}, {f"_next_{i}": n for i, n in enumerate(following)}
    keyed = rows.withColumns({key: last[n] for key, n in lasts.items()} | {key: following[n] for key, n in nexts.items()})
    dealt = written(keyed.repartitionByRange(*group, *order).withColumn("_range", F.spark_partition_id()), "along")
    place = F.struct(*order)
    known = lambda key: F.when(F.col(key).isNotNull(), place)
    ends = dealt.groupBy("_range", *group).agg(
        F.count("*").alias("_n"),
        *(F.max_by(key, known(key)).alias(key) for key in lasts),
        *(F.min_by(key, known(key)).alias(key) for key in nexts),
    )
    of_group = Window.partitionBy(*group)
    before = of_group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    after = of_group.orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("_ranges", F.count("*").over(of_group)).where("_ranges > 1").select(
        F.col("_range").alias("_their_range"),
        *(F.col(g).alias(f"_their_{g}") for g in group),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        *(F.last(key, ignorenulls=True).over(before).alias(f"{key}_carried") for key in lasts),
        *(F.last(key, ignorenulls=True).over(after).alias(f"{key}_carried") for key in nexts),
    )
    inside = Window.partitionBy("_range", *group)
    up = inside.orderBy(*order)
    so_far = up.rowsBetween(Window.unboundedPreceding, -1)
    to_come = inside.orderBy(*(F.desc(o) for o in order)).rowsBetween(Window.unboundedPreceding, -1)
    own = {f"{key}_own": F.last(key, ignorenulls=True).over(so_far) for key in lasts} | {f"{key}_own": F.last(key, ignorenulls=True).over(to_come) for key in nexts}
    if number:
        own["_number"] = F.row_number().over(up).cast("long")
    met = F.col("_range") == F.col("_their_range")
    for g in group:
        met = met & F.col(g).eqNullSafe(F.col(f"_their_{g}"))
    joined = dealt.withColumns(own).join(F.broadcast(carried), met, "left")  # at most two rows a range
    found = [F.coalesce(f"{key}_own", f"{key}_carried").alias(n) for key, n in (lasts | nexts).items()]
    places = [(F.col("_number") + F.coalesce("_before", F.lit(0))).alias(number)] if number else []
    return joined.select(*(F.col(f"`{name}`") for name in rows.columns if name not in {*last, *following, number}), *found, *places)
