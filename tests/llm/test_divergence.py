"""The source audit against a plain count, with several blocks and shards, and on odd tables."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from lexloom.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, term string, block string, n long"


def by_hand(rows, least_docs, top=50):
    groups, docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        groups[lang or "", source or ""].update(words)
        docs[lang or ""].update(set(words))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= least_docs]
        own = {s: c for (x, s), c in groups.items() if x == lang}
        own[None] = sum(own.values(), Counter())
        total = {s: sum(c[t] for t in kept) + 5 * len(kept) for s, c in own.items()}
        share = {s: {t: 1 + 10**9 * (c[t] + 5) // total[s] for t in kept} for s, c in own.items()}
        for s in own:
            if s is None:
                continue
            pair = [(-sum(abs(share[s][t] - share[o][t]) for t in kept), o.encode()) for o in own if o not in (s, None)]
            term = [(share[None][t] - share[s][t], t.encode()) for t in kept if own[s][t] and share[s][t] > share[None][t]]
            for part, found in (("pair", sorted(pair)), ("term", sorted(term)[:top])):
                out |= {(lang, s, part, item.decode(), -value, i) for i, (value, item) in enumerate(found, 1)}
    return out


def made(n, seed=3):
    draw, rows = random.Random(seed), []
    words = ["alpha", "BETA", "gamma's", "δέλτα", "Ärger", "ärger", "x1y", "über", "zeta", "eta"] + [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120)]
    for _ in range(n):
        text = " ".join(draw.choice(words[: draw.choice([10, 40, 130])]) for _ in range(draw.randint(0, 30)))
        rows.append((draw.choice([text, text, text, None, ""]), draw.choice(["en", "de", None]), draw.choice(["a", "b", "c", "d", "é", "e", "f", None])))
    return rows


@pytest.mark.parametrize(("blocks", "terms"), [(16, 1 << 13), (1, 7), (2, 50), (3, 20)])
def test_audit_equals_a_plain_count(spark, blocks, terms):
    rows = [*made(260), ("lonely words here", "xx", "only"), ("none kept", "yy", "p"), (None, "yy", "q")]
    table = spark.createDataFrame([(i, *r, "t", "b", 1) for i, r in enumerate(rows)], SCHEMA).repartition(3)
    out = divergence.audit(table, least_docs=5, shard_terms=terms, block_groups=blocks)
    got = [tuple(r) for r in out.select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(got) == len(set(got)) and set(got) == by_hand(rows, 5)
    assert ("yy", "p", "pair", "q", 0, 1) in set(got) and not any(r[0] == "xx" for r in got)


def test_every_two_blocks_meet_once(spark):
    from pyspark.sql import functions as F

    for n in range(1, 12):
        met = Counter()
        blocks = spark.range(n).select(F.col("id").alias("b"), F.lit(n).cast("long").alias("n"))
        for number in range(n + n % 2 - 1):
            partner = dict(blocks.select("b", divergence._partner(F.col("b"), F.col("n"), number)).collect())
            assert all(partner[p] == b for b, p in partner.items() if p is not None)
            met.update((b, p) for b, p in partner.items() if p is not None)
        assert met == Counter({(a, b): 1 for a in range(n) for b in range(n) if a != b})


def test_empty_tables_long_texts_and_large_counts(spark, monkeypatch):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).collect() == []
    monkeypatch.setattr(divergence, "_PIECE", 64)
    text = ("Größe und Maß, " * 40 + "z" * 500 + " Ende").encode()
    assert [w for part in divergence._terms(text) for w in part] == divergence._TERM.findall(text.lower())
    counts = np.array([0, 7, 10**12, 3 * 10**14])
    total = int(counts.sum()) + 20
    assert divergence._shares(counts, total).tolist() == [1 + 10**9 * (int(c) + 5) // total for c in counts]
