"""Index builds, cleaned texts and failure parts on small tables."""

import math
import re
import unicodedata

from pyspark.sql import functions as F

from lexloom.operators import diagnosis, embedding


def test_clean_follows_unicode(spark):
    odd = ["café “q” ‘s’ – — … ß ł æ", "日本 ² Ⅷ ١ ﬁ Å", "a\tb\r\nc\x1c\x0b d", "....x ---- === ==== ~~~~~ __ ____", None, "", " \n ", "\U0001f600ok\u0000", "x" * 3000, "word " * 600, "αβ а"]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "i int, t string").select("i", embedding.clean(F.col("t")).alias("c")).orderBy("i").select("c").collect()]
    for text, out in zip(odd, got, strict=True):
        if text is None:
            assert out is None
            continue
        letters = []
        for x in unicodedata.normalize("NFKC", text):
            kind = unicodedata.category(x)
            latin = kind[0] == "L" and "LATIN" in unicodedata.name(x, "")
            letters.append(x if x < "\x80" or kind[0] == "N" else embedding.PUNCTUATION.get(x) or (unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode() if latin else "") or " ")
        want = re.sub(r"([=*~])\1{3,}", " ", re.sub(r"([.\-_])\1{3,}", " ... ", "".join(letters)))
        want = re.sub(r"\s+", " ", want).strip()
        want = want if len(want) <= 2400 else want[:2400].rsplit(" ", 1)[0] or want[:2400]
        assert out == want, text


def fussy(folder):
    """Refuses marked and blank texts; writes down what it takes."""

    def run(texts):
        import os
        import uuid

        if any(not t.strip() or "…" in t or "bad" in t for t in texts):
            raise ValueError("refused")
        for t in texts:
            with open(os.path.join(folder, uuid.uuid4().hex), "w") as f:
                f.write(t)
        return [[float(len(t)), float("inf") if "infinite" in t else 1.0] for t in texts]

    return run


def test_every_text_is_encoded_once(spark, tmp_path):
    texts = ["one", "two", "one", "", None, "three…", "bad", "infinite", *["same"] * 200]
    table = spark.createDataFrame([(i, t, "w") for i, t in enumerate(texts)], "id int, text string, way string").repartition(4)
    out = {r["id"]: r for r in embedding.build(table, fussy(str(tmp_path)), batch=3).collect()}
    assert len(out) == len(texts)
    assert out[0]["embedding"] == [3.0, 1.0] == out[2]["embedding"] and out[0]["way"] == "encoded" and out[150]["embedding"] == [4.0, 1.0]
    assert (out[5]["way"], out[5]["embedding"]) == ("cleaned", [8.0, 1.0])
    for i, error in ((3, "refused"), (4, "refused"), (6, "refused"), (7, "not finite")):
        assert (out[i]["way"], out[i]["embedding"], out[i]["error"]) == ("failed", None, error)
    asked = [p.read_text() for p in tmp_path.iterdir()]
    assert sorted(asked) == sorted({"one", "two", "three...", "infinite", "same"})
    assert embedding.build(table.where("false"), embedding.WordShapes()).collect() == []


def test_vector_faults(spark):
    rows = [([1.0, 2.0], None), ([], "empty"), (None, "empty"), ([1.0, None], "not a number"), ([math.nan], "not finite"), ([-math.inf], "not finite")]
    got = spark.createDataFrame(rows, "v array<double>, want string").select(embedding.vector_fault(F.col("v")).alias("got"), "want").collect()
    assert all(r["got"] == r["want"] for r in got)


def test_attribution_takes_what_moves_most(spark):
    parts = spark.createDataFrame([(1, "a", 0.5, 2.0, 9, 4), (1, "b", 0.5, 2.0, 9, 2), (1, "c", 0.0, 1.0, 9, 2), (2, "a", 1.0, 1.0, 3, 3)], "query_id long, part string, expected double, winning double, rank long, rank_without long")
    assert sorted(tuple(r) for r in diagnosis.attribution(parts).collect()) == [(1, "b", 9, 2, 1.5), (2, "a", 3, 3, 0.0)]
