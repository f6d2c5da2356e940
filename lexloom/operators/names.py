"""Names inside questions: which of many names a question contains, found by equality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

c = F.col


def names_in(questions: DataFrame, names: DataFrame, name: str = "alias") -> DataFrame:
    """names joined with query_id of every question(query_id, query) whose text, in lower case, contains the name (lower case, not empty).

    A question's stretches that have the length of any name are looked up among the names, so the join is by equality and its work is the
    questions' characters times the different lengths of names. The lengths are one row, no longer than the longest name. Null questions have no names.
    """
    lengths = names.agg(F.coalesce(F.collect_set(F.char_length(name)), F.array().cast("array<int>")).alias("lengths"))
    asked = questions.select("query_id", F.lower("query").alias("q")).where("q IS NOT NULL").crossJoin(F.broadcast(lengths))
    fitting = F.filter("lengths", lambda n: n <= F.char_length("q"))
    stretches = F.transform(fitting, lambda n: F.transform(F.sequence(F.lit(1), F.char_length("q") - n + 1), lambda at: F.substr(c("q"), at, n)))
    spoken = asked.select("query_id", F.explode(F.array_distinct(F.flatten(stretches))).alias("_stretch"))
    return names.join(spoken, c(name) == c("_stretch")).drop("_stretch")
