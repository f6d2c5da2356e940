"""Token streams as newline-delimited JSON: cutting, encoding, re-framing and decoding; request windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

c = F.col
PIECE = 48


def pieces(text: Column, size: int = PIECE) -> Column:
    """Consecutive pieces of size characters; none for an empty or null text."""
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.char_length(text)), F.lit(size))
    return F.when(F.char_length(text) > 0, F.transform(starts, lambda s: F.substr(text, s, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def event_lines(texts: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """keys, seq, type, line: of every text an event sequence of one meta, its pieces as tokens, and done."""
    tokens = F.transform(pieces(c(text_col)), lambda p: F.struct(F.lit("token").alias("type"), p.alias("payload")))
    ends = [F.array(F.struct(F.lit(kind).alias("type"), payload.alias("payload"))) for kind, payload in (("meta", F.concat_ws(":", *keys)), ("done", F.lit("")))]
    rows = texts.select(*keys, F.posexplode(F.concat(ends[0], tokens, ends[1])).alias("seq", "event"))
    return rows.select(*keys, "seq", c("event.type").alias("type"), F.to_json("event").alias("line"))


def message_line(content: Column) -> Column:
    return F.concat(F.to_json(F.struct(F.struct(content.alias("content")).alias("message"), F.lit(False).alias("done"))), F.lit("\n"))


def reframe(fragments: DataFrame, keys: list[str]) -> DataFrame:
    """fragments(keys, seq, raw) of byte streams, cut anywhere, as whole lines: keys, line_no, line. An unended last line counts."""
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "raw"))), lambda f: f["raw"]), "")
    return fragments.groupBy(*keys).agg(whole.alias("raw")).select(*keys, F.posexplode(F.split("raw", "\n")).alias("line_no", "line"))


def decode(lines: DataFrame) -> DataFrame:
    """Add content; blank lines and those that say done go, a malformed line is an error."""
    parsed = F.from_json("line", "message struct<content: string>, done boolean, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})
    rows = lines.where(F.trim("line") != "").withColumn("_p", parsed)
    rows = rows.where(F.when(c("_p._corrupt").isNotNull(), F.raise_error(F.lit("malformed stream line"))).otherwise(~F.coalesce(c("_p.done"), F.lit(False))))
    return rows.withColumn("content", c("_p.message.content")).drop("_p")


STATE = T.StructType([T.StructField("tail", T.StringType())])


def reframe_stream(fragments: DataFrame) -> DataFrame:
    """The same on a stream of (stream_id, raw): each key keeps the unended tail; an empty fragment ends the stream and gives it out."""
    out = T.StructType([T.StructField("stream_id", T.StringType()), T.StructField("line", T.StringType())])

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        tail = state.get[0] if state.exists else ""
        lines: list[str] = []
        for batch in batches:
            for raw in batch.sort_values("seq", kind="stable")["raw"]:
                *done, tail = (tail + raw).split("\n")
                lines += done
                if raw == "" and tail:
                    lines.append(tail)
                    tail = ""
        state.update((tail,))
        yield pd.DataFrame({"stream_id": [key[0]] * len(lines), "line": lines})

    return fragments.groupBy("stream_id").applyInPandasWithState(step, out, STATE, "append", "NoTimeout")


def request_windows(events: DataFrame, width: str = "1 hour", late: str = "30 minutes") -> DataFrame:
    """Requests per window and type, for batches and (with a watermark for late rows) streams alike."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    grouped = rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return grouped.select(c("w.start").alias("window_start"), "event_type", "n", "total")


def request_latency(starts: DataFrame, ends: DataFrame, within: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """user_id, start_id, end_id, start_ts, latency_us of every start with every end of its user that follows it within the interval.

    starts and ends have event_id, user_id, ts and are both batches or both streams. Streams keep rows until the watermarks (`late` behind the
    newest row) have passed the interval, so state is bounded by time; rows that are later than that may find no partner.
    Rows without user or time have no latency.
    """
    timed = lambda rows, side: rows.select(c("user_id").alias(f"{side}_user"), c("event_id").alias(f"{side}_id"), c("ts").alias(f"{side}_ts"), c("ts").cast("timestamp").alias(f"{side}_at"))
    first, last = timed(starts, "start"), timed(ends, "end")
    if first.isStreaming:
        first, last = first.withWatermark("start_at", late), last.withWatermark("end_at", late)
    near = (c("start_user") == c("end_user")) & (c("end_at") >= c("start_at")) & (c("end_at") <= c("start_at") + F.expr(f"INTERVAL {within}"))
    return first.join(last, near).select(c("start_user").alias("user_id"), "start_id", "end_id", "start_ts", (F.unix_micros("end_at") - F.unix_micros("start_at")).alias("latency_us"))


#: A quantile's rank is within a share of 1 / ACCURACY of the rows.
ACCURACY = 10_000


def latency_windows(pairs: DataFrame, width: str = "1 day") -> DataFrame:
    """window_start, n, total_us, least_us, greatest_us and the quantiles median_us, p95_us (see ACCURACY) of latencies by start."""
    q = lambda share, name: F.percentile_approx("latency_us", share, ACCURACY).alias(name)
    grouped = pairs.groupBy(F.window("start_ts", width).alias("w")).agg(F.count("*").alias("n"), F.sum("latency_us").alias("total_us"), F.min("latency_us").alias("least_us"), F.max("latency_us").alias("greatest_us"), q(0.5, "median_us"), q(0.95, "p95_us"))
    return grouped.select(c("w.start").alias("window_start"), "n", "total_us", "least_us", "greatest_us", "median_us", "p95_us")
