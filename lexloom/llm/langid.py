"""Language identification by a byte convolutional network, trained in numpy.

A text is cut, whole, into windows of WINDOW bytes (the last one padded). Filters of several widths run over
the embedded bytes at every second byte, each filter keeps its maximum over the window, and a softmax layer
turns the maxima into language probabilities. A document's probabilities are the means over its windows,
weighed by the bytes in them.

Training reads a bounded sample: at most `per_lang` documents of each language on average (by a hash of their
key, so every run draws the same) and `windows` windows of each. Prediction reads every byte of every document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.llm._shared import byte_parts, give_back, slices, utf8_rows

WINDOW = 256
STRIDE = 2
WIDTHS = (2, 3, 5)
FILTERS = 12
EMBEDDING = 6
PAD = 256
UNDETERMINED = "und"
_LETTER = regex.compile(r"\p{L}")


@dataclass
class ByteCnn:
    langs: list[str]
    embedding: np.ndarray  # 257 x EMBEDDING; the last row (padding) stays zero
    filters: list[np.ndarray]  # per width: width * EMBEDDING x FILTERS
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def _patches(self, codes: np.ndarray, width: int) -> np.ndarray:
        """windows x positions x (width * EMBEDDING)"""
        x = self.embedding[codes]
        at = np.arange(0, WINDOW - width + 1, STRIDE)
        return np.concatenate([x[:, at + j] for j in range(width)], axis=2)

    def pooled(self, codes: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Filter maxima after the rectifier, and for each width the positions where they were found."""
        best, where = [], []
        for w, f in zip(WIDTHS, self.filters, strict=True):
            p = self._patches(codes, w)
            a = (p.reshape(-1, p.shape[2]) @ f).reshape(p.shape[0], p.shape[1], -1)
            where.append(a.argmax(axis=1))
            best.append(np.take_along_axis(a, where[-1][:, None], 1)[:, 0])
        return np.maximum(np.concatenate(best, axis=1) + self.bias, 0), where

    def maxima(self, codes: np.ndarray) -> np.ndarray:
        """pooled() without positions: the form used for prediction."""
        x, best = self.embedding[codes], []
        for w, f in zip(WIDTHS, self.filters, strict=True):
            n = (WINDOW - w) // STRIDE + 1
            total = 0
            for j in range(w):
                part = np.ascontiguousarray(x[:, j : j + STRIDE * n : STRIDE][:, :n])
                total = total + part.reshape(-1, EMBEDDING) @ f[j * EMBEDDING : (j + 1) * EMBEDDING]
            best.append(total.reshape(len(codes), n, -1).max(axis=1))
        return np.maximum(np.concatenate(best, axis=1) + self.bias, 0)

    def probabilities(self, codes: np.ndarray) -> np.ndarray:
        z = self.maxima(codes) @ self.out + self.out_bias
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def predict(self, texts: list[bytes], batch: int = 512, surest: bool = False) -> tuple[list[int], list[float]]:
        """Language index and probability of each whole, non-empty text; with `surest`, the probability of its surest window."""
        counts = [max(1, -(-len(t) // WINDOW)) for t in texts]
        langs, scores = [], []
        for start, stop in slices(counts, batch):
            n = counts[start:stop]
            total = np.zeros((stop - start, len(self.langs)))
            codes = np.full((sum(n), WINDOW), PAD, np.int16)
            size = np.zeros(sum(n))
            at = 0
            for t, k in zip(texts[start:stop], n, strict=True):
                codes[at : at + k].reshape(-1)[: len(t)] = np.frombuffer(t, np.uint8)
                size[at : at + k] = WINDOW
                size[at + k - 1] = len(t) - WINDOW * (k - 1)
                at += k
            probs = np.concatenate([self.probabilities(codes[i : i + batch]) for i in range(0, len(codes), batch)])
            edges = np.concatenate([[0], np.cumsum(n)[:-1]])
            total = np.add.reduceat(probs * size[:, None], edges, axis=0) / np.add.reduceat(size, edges)[:, None]
            langs += total.argmax(axis=1).tolist()
            best = np.maximum.reduceat(probs.max(axis=1), edges) if surest else total.max(axis=1)
            scores += np.clip(best, 0, 1).tolist()
        return langs, scores


def window_codes(texts: list[bytes]) -> np.ndarray:
    codes = np.full((len(texts), WINDOW), PAD, np.int16)
    for row, t in zip(codes, texts, strict=True):
        row[: min(len(t), WINDOW)] = np.frombuffer(t[:WINDOW], np.uint8)
    return codes


def train(windows: list[bytes], labels: list[str], epochs: int = 6, seed: int = 7, rate: float = 0.004) -> ByteCnn:
    """Adam on the cross entropy of single windows; classes weigh the same whatever their share."""
    langs = sorted(set(labels))
    if not langs:
        raise ValueError("no labelled text to learn languages from")
    rng = np.random.default_rng(seed)
    codes, y = window_codes(windows), np.array([langs.index(x) for x in labels])
    weight = len(y) / (len(langs) * np.bincount(y, minlength=len(langs)))
    f32 = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
    net = ByteCnn(langs, f32(257, EMBEDDING, scale=0.5), [f32(w * EMBEDDING, FILTERS, scale=(w * EMBEDDING) ** -0.5) for w in WIDTHS], np.zeros(FILTERS * len(WIDTHS), np.float32), f32(FILTERS * len(WIDTHS), len(langs), scale=0.2), np.zeros(len(langs), np.float32))
    net.embedding[PAD] = 0
    params = [net.embedding, *net.filters, net.bias, net.out, net.out_bias]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for start in range(0, len(order), 64):
            rows = order[start : start + 64]
            h, where = net.pooled(codes[rows])
            z = h @ net.out + net.out_bias
            e = np.exp(z - z.max(axis=1, keepdims=True))
            grad = e / e.sum(axis=1, keepdims=True)
            grad[np.arange(len(rows)), y[rows]] -= 1
            grad *= (weight[y[rows]] / len(rows))[:, None]
            back = (grad @ net.out.T) * (h > 0)
            d_embedding, d_filters = np.zeros_like(net.embedding), []
            for k, w in enumerate(WIDTHS):
                g = back[:, k * FILTERS : (k + 1) * FILTERS]  # rows x FILTERS, each at one position
                at = STRIDE * where[k][:, :, None] + np.arange(w)  # rows x FILTERS x width
                bytes_at = codes[rows][np.arange(len(rows))[:, None, None], at]
                patch = net.embedding[bytes_at].reshape(len(rows), FILTERS, -1)
                d_filters.append(np.einsum("bf,bfp->pf", g, patch).astype(np.float32))
                np.add.at(d_embedding, bytes_at, np.einsum("bf,pf->bfp", g, net.filters[k]).reshape(len(rows), FILTERS, w, EMBEDDING))
            d_embedding[PAD] = 0
            step += 1
            for p, d, m, v in zip(params, [d_embedding, *d_filters, back.sum(axis=0), h.T @ grad, grad.sum(axis=0)], first, second, strict=True):
                m += 0.1 * (d - m)
                v += 0.001 * (d * d - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def held_out(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 4 is 2; a null doc_id is not held out (and not learned from either)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_windows(docs: DataFrame, per_lang: int = 500, windows: int = 4) -> tuple[list[bytes], list[str]]:
    """The bounded labelled sample: at most 2 * per_lang documents a language are kept, `windows` windows each.

    Only the 1000 most frequent languages are learned. Documents are drawn by a hash of doc_id below a threshold set from their language's count, so all
    documents have the same chance; a window starts at a hashed place of the whole text.
    """
    pool = docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = {r["lang"]: r["n"] for r in pool.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(1000).collect()}
    if not counts:
        return [], []
    share = F.create_map(*(x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, per_lang / n)))))
    place = F.pmod(F.xxhash64(F.lit("langid"), "doc_id"), F.lit(1_000_003))
    drawn = pool.where(place < F.element_at(share, F.col("lang")) * 1_000_003)
    starts = F.transform(F.sequence(F.lit(0), F.lit(windows - 1)), lambda i: 1 + F.pmod(F.xxhash64(F.col("doc_id"), i), F.greatest(F.lit(1), F.char_length("text") - WINDOW // 2)))
    texts = F.array_distinct(F.transform(starts, lambda s: F.substr(F.col("text"), s.cast("int"), F.lit(WINDOW))))
    sample = drawn.select("lang", "doc_id", texts.alias("windows"), place.alias("place")).orderBy("place", "doc_id").limit(2 * per_lang * len(counts)).collect()
    rows = sorted((r["place"], r["doc_id"], w, r["lang"]) for r in sample for w in r["windows"])
    return [r[2].encode()[:WINDOW] for r in rows], [r[3] for r in rows]


def fit(docs: DataFrame, per_lang: int = 500, windows: int = 4) -> ByteCnn | None:
    """None where there is nothing to learn from."""
    texts, labels = training_windows(docs, per_lang, windows)
    return train(texts, labels) if labels else None


def predict(docs: DataFrame, net: ByteCnn | None, text_col: str = "text", lang_col: str = "lang_pred", score_col: str = "score", surest: bool = False) -> DataFrame:
    """Add lang_col and score_col (0 to 1) from the whole text; with `surest`, the score is that of its surest window.

    Null text and text without a letter give `und` and score 0; so does every text when there is no model.
    Other columns and repeated rows stay; columns that already have these two names are replaced.
    """
    kept = [c for c in docs.columns if c not in (lang_col, score_col, text_col)]
    schema = T.StructType([docs.schema[c] for c in kept] + [docs.schema[text_col], T.StructField(lang_col, T.StringType()), T.StructField(score_col, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in byte_parts(whole, len(kept)):
                texts = batch.column(len(kept))
                lettered = [t is not None and net is not None and _LETTER.search(t) is not None for t in texts.to_pylist()]
                rows = [i for i, x in enumerate(lettered) if x]
                langs, scores = [UNDETERMINED] * len(lettered), [0.0] * len(lettered)
                if rows:
                    data = utf8_rows(texts)
                    for i, lang, score in zip(rows, *net.predict([data[i] for i in rows], surest=surest), strict=True):
                        langs[i], scores[i] = net.langs[lang], score
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*kept, text_col, lang_col, score_col])
        give_back()

    return docs.select(*(F.col(f"`{c}`") for c in [*kept, text_col])).mapInArrow(run, schema)
