"""Secret scans: base rules plus formats whose grammar is inferred from labelled credentials.

Grammar inference: the labelled credentials of one format make a prefix tree with counts; walking it level by level,
a state is merged into an earlier one where a Hoeffding bound cannot tell their symbol and end frequencies apart
(recursively over the subtrees). States of different depths are never merged, so the automaton keeps the format's
lengths. A second automaton is inferred the same way from ordinary strings (words, names, numbers, dates, paths),
without regard to depth: the background.

A candidate is every stretch of a text that an automaton can read from its start to an end: it begins where no letter or digit
stands before it, or anywhere if the format has fixed first places, and ends before what is no letter or digit. All candidates are
scored by the ratio of their likelihood under the format and under the background; what ordinary text does not explain better by more than
MARGIN bits is a secret of that format. Texts are read once, from left to right, all live starts and all formats at
a time; the depth of the automata bounds the work per character.

Symbols are characters where the labelled credentials of a format all agree, and classes of characters elsewhere.
The labelled credentials are drawn from FORMATS by a seeded generator, ordinary strings by another.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.llm._shared import byte_parts, fresh, give_back


# The base rules, in the order in which kinds are listed.
BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE), 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 18),
    ("hex", re.compile(r"[0-9a-f]{16,}"), 16),  # runs are maximal, so the length can stand in the pattern
)
# Published credential formats (prefix, alphabet, lengths of the rest).
_LOWER, _UPPER, _DIGIT = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
_WORD = _LOWER + _UPPER + _DIGIT
FORMATS = {
    "access_key": ("AKIA", _UPPER + _DIGIT, (16,)),
    "hex_digest": ("", "0123456789abcdef", (32, 40, 64)),
    "code_host": ("ghp_", _WORD, (36,)),
    "chat_bot": ("xoxb-", _DIGIT + "-" + _WORD, (40, 48)),
    "cloud_api": ("AIza", _WORD + "_-", (35,)),
    "payment": ("sk_live_", _WORD, (24,)),
    "web_token": ("eyJ", _WORD + "_-.", (90, 120)),
}
#: Bits by which ordinary text may explain a stretch better that fits a format from its start to its end.
MARGIN = 10.0
#: Weight of what was not seen, against one observation.
UNSEEN = 0.5
#: Characters by which a length may differ from the labelled ones, at the weight of what was not seen.
SLACK = 2
NEVER = -1e9


def labelled_credentials(per_format: int = 150, seed: int = 11) -> list[tuple[str, str]]:
    rng = random.Random(seed)
    return [(name, prefix + "".join(rng.choices(letters, k=rng.choice(sizes)))) for name, (prefix, letters, sizes) in FORMATS.items() for _ in range(per_format)]


def ordinary_strings(count: int = 1500, seed: int = 12) -> list[str]:
    """Strings of credential characters as ordinary texts have them."""
    rng = random.Random(seed)
    parts = ["an", "be", "con", "de", "er", "for", "gen", "hi", "ing", "ka", "le", "ment", "no", "or", "pre", "re", "st", "tion", "un", "ver", "wa", "zo"]
    word = lambda: "".join(rng.choices(parts, k=rng.choice((1, 2, 2, 3))))
    number = lambda: str(rng.randrange(10 ** rng.choice((1, 2, 4, 4, 8, 19))))
    some = lambda: [word() for _ in range(rng.randint(1, 4))]
    forms = [
        lambda: word(),
        lambda: word().capitalize(),
        lambda: word().upper(),
        lambda: number(),
        lambda: "_".join([*some(), *rng.choice(([], [number()]))]),
        lambda: "-".join([*some(), *rng.choice(([], [number()]))]),
        lambda: "".join(w.capitalize() for w in some()),
        lambda: "/".join([*some(), number(), word() + ".html"]),
        lambda: f"20{rng.randrange(10, 40)}-{rng.randrange(10, 13)}-{rng.randrange(10, 29)}T{rng.randrange(10, 24)}",
        lambda: f"{rng.randrange(20)}.{rng.randrange(20)}.{rng.randrange(300)}-{word()}{rng.randrange(10)}",
        lambda: "_".join(w.upper() for w in some()) + "=" + word(),
    ]
    return [rng.choice(forms)() for _ in range(count)]


#: Classes of characters: digits, a to f, other small letters, A to F, other capitals, each mark, and all else (the last, in no string).
_GROUPS = [_DIGIT, _LOWER[:6], _LOWER[6:], _UPPER[:6], _UPPER[6:], *"+/_.=-"]
ELSE = len(_GROUPS)
CLASS_OF = np.full(129, ELSE, np.int8)
for _i, _group in enumerate(_GROUPS):
    CLASS_OF[[ord(c) for c in _group]] = _i
#: Bits that tell a character from the others of its class.
_WITHIN = np.array([math.log2(len(group)) for group in _GROUPS] + [0.0])
_ALNUM = np.array([chr(i).isalnum() for i in range(128)] + [False])


class PrefixAutomaton:
    """A probabilistic automaton: the prefix tree of some strings of symbols, with compatible states merged.

    next, seen and ends hold a state's arcs, how often each was taken, and how often strings ended there. In a layered automaton
    only states of one depth are merged.
    """

    def __init__(self, values: list[list[int]], layered: bool, alpha: float = 0.05):
        self.next: list[dict[int, int]] = [{}]
        self.seen: list[dict[int, int]] = [{}]
        self.ends, self.depth = [0], [0]
        self.layered, self.bound = layered, math.sqrt(0.5 * math.log(2 / alpha))
        for value in values:
            state = 0
            for s in value:
                if s not in self.next[state]:
                    self.next[state][s] = len(self.next)
                    self.next.append({})
                    self.seen.append({})
                    self.ends.append(0)
                    self.depth.append(self.depth[state] + 1)
                self.seen[state][s] = self.seen[state].get(s, 0) + 1
                state = self.next[state][s]
            self.ends[state] += 1
        self._merge_compatible()
        self._keep_reachable()

    def total(self, q: int) -> int:
        return self.ends[q] + sum(self.seen[q].values())

    def _differ(self, a: int, na: int, b: int, nb: int) -> bool:
        return abs(a / na - b / nb) > self.bound * (na**-0.5 + nb**-0.5)

    def _compatible(self, p: int, q: int) -> bool:
        todo = [(p, q)]
        while todo:
            p, q = todo.pop()
            n_p, n_q = self.total(p), self.total(q)
            if not n_p or not n_q:
                continue
            if self._differ(self.ends[p], n_p, self.ends[q], n_q):
                return False
            for s in self.seen[p].keys() | self.seen[q].keys():
                if self._differ(self.seen[p].get(s, 0), n_p, self.seen[q].get(s, 0), n_q):
                    return False
                if s in self.next[p] and s in self.next[q] and self.next[p][s] != self.next[q][s]:
                    todo.append((self.next[p][s], self.next[q][s]))
        return True

    def _fold(self, red: int, blue: int) -> None:
        """Add blue's subtree to red."""
        todo = [(red, blue)]
        while todo:
            r, b = todo.pop()
            self.ends[r] += self.ends[b]
            for s, target in self.next[b].items():
                self.seen[r][s] = self.seen[r].get(s, 0) + self.seen[b][s]
                if s in self.next[r]:
                    todo.append((self.next[r][s], target))
                else:
                    self.next[r][s] = target

    def _merge_compatible(self) -> None:
        """Level by level; the arcs of a state that was merged go with it."""
        red, level = [0], [0]
        while level:
            following = []
            reds = [] if self.layered else red
            for parent in level:
                for s in sorted(self.next[parent]):
                    blue = self.next[parent][s]
                    if blue in reds:
                        continue
                    into = next((r for r in reds if self._compatible(r, blue)), None)
                    if into is None:
                        reds.append(blue)
                        following.append(blue)
                    else:
                        self.next[parent][s] = into
                        self._fold(into, blue)
            if not self.layered:
                # Arcs that a red state got from others lead to states that are looked at with the next level.
                following += [r for r in red if any(t not in red for t in self.next[r].values()) and r not in following]
            level = following

    def _keep_reachable(self) -> None:
        number, todo = {0: 0}, [0]
        for q in todo:
            for target in self.next[q].values():
                if target not in number:
                    number[target] = len(number)
                    todo.append(target)
        self.next = [{s: number[t] for s, t in self.next[q].items()} for q in todo]
        self.seen, self.ends, self.depth = ([rows[q] for q in todo] for rows in (self.seen, self.ends, self.depth))


class Formats:
    """The automata of all formats in one table, and the background's, ready to read texts."""

    def __init__(self, labelled: list[tuple[str, str]], ordinary: list[str]):
        values: dict[str, list[str]] = {}
        for name, value in labelled:
            values.setdefault(name, []).append(value)
        self.names = list(values)
        plain = PrefixAutomaton([CLASS_OF[list(v.encode())].tolist() for v in ordinary], layered=False)
        n = len(plain.next)
        self.plain_next = np.zeros((n, ELSE + 1), np.int32)
        self.plain_log = np.zeros((n, ELSE + 1), np.float32)
        self.plain_end = np.zeros(n, np.float32)
        for q in range(n):
            total = plain.total(q) + UNSEEN * (ELSE + 1)
            self.plain_end[q] = math.log2((plain.ends[q] + UNSEEN) / total)
            for s in range(ELSE):
                self.plain_next[q, s] = plain.next[q].get(s, q)
                self.plain_log[q, s] = math.log2((plain.seen[q].get(s, 0) + UNSEEN) / total)
        self.first, self.lengths, self.fixed_start, tables = [], [], [], []
        for name in self.names:
            tables.append(self._format_table(values[name], sum(len(t[0]) for t in tables)))
        self.next, self.log, self.end, self.fixed = (np.concatenate(columns) for columns in zip(*tables, strict=True))

    def _format_table(self, values: list[str], base: int) -> tuple[np.ndarray, ...]:
        """next, log, end and fixed (the one character of a state, or -1) of a format's states, numbered from base."""
        longest = max(map(len, values))
        agreed = [values[0][d] if all(len(v) > d and v[d] == values[0][d] for v in values) else None for d in range(longest)]
        automaton = PrefixAutomaton([[int(CLASS_OF[ord(c)]) for c in v] for v in values], layered=True)
        known = len(automaton.next)
        n = known + SLACK  # a longest string may go on for as many characters
        following, log = np.full((n, ELSE + 1), -1, np.int32), np.zeros((n, ELSE + 1), np.float32)
        end, fixed = np.full(n, NEVER, np.float32), np.full(n, -1, np.int16)
        letters = Counter(int(CLASS_OF[ord(c)]) for v in values for d, c in enumerate(v) if agreed[d] is None)
        labelled = {automaton.depth[q] for q in range(known) if automaton.ends[q]}
        lengths = sorted({size + more for size in labelled for more in range(-SLACK, SLACK + 1)})
        for q in range(n):
            arcs, seen, ends = (automaton.next[q], automaton.seen[q], automaton.ends[q]) if q < known else ({}, {}, 0)
            depth = automaton.depth[q] if q < known else longest + 1 + q - known
            total = ends + sum(seen.values()) + UNSEEN
            if depth in lengths:
                end[q] = math.log2((ends + UNSEEN) / (total + UNSEEN))
            if arcs and agreed[depth] is not None:
                fixed[q] = ord(agreed[depth])
                following[q, CLASS_OF[fixed[q]]] = base + next(iter(arcs.values()))
            elif q < n - 1:
                # A class that no labelled string has here, but elsewhere, goes where most strings go.
                most = arcs[max(seen, key=seen.get)] if arcs else max(q + 1, known)
                for s in letters:
                    following[q, s] = base + arcs.get(s, most)
                    share = letters[s] / letters.total()
                    log[q, s] = math.log2((seen.get(s, 0) + UNSEEN * share) / total)
        self.first.append(base)
        self.lengths.append(lengths)
        self.fixed_start.append(all(agreed[d] is not None for d in range(3)))
        return following, log, end, fixed

    def read(self, raw: np.ndarray) -> tuple[np.ndarray, ...]:
        """Starts, ends, formats and scores of all secrets in these characters (codes to 127, 128 for all others), before overlaps are settled."""
        longest = max(map(max, self.lengths))
        raw = np.concatenate([raw, np.full(longest + 1, 128, raw.dtype)])
        kinds, alnum = CLASS_OF[raw], _ALNUM[raw]
        n = len(raw) - longest - 1
        after = np.concatenate([[True], ~alnum[: n - 1]]) if n else np.zeros(0, bool)
        at, state, form = [], [], []
        for f, first in enumerate(self.first):
            begins = raw[:n] == self.fixed[first] if self.fixed[first] >= 0 else self.next[first][kinds[:n]] >= 0
            begins = np.flatnonzero(begins if self.fixed_start[f] else begins & after)
            # Only where a length of the format ends before no letter or digit can a candidate stand.
            can_end = np.zeros(len(begins), bool)
            for size in self.lengths[f]:
                can_end |= ~alnum[begins + size]
            begins = begins[can_end]
            at.append(begins)
            state.append(np.full(len(begins), first, np.int32))
            form.append(np.full(len(begins), f, np.int32))
        start = np.concatenate(at)
        state, form = np.concatenate(state), np.concatenate(form)
        plain, ratio, place = np.zeros(len(start), np.int32), np.zeros(len(start), np.float32), start.copy()
        found = []
        while len(start):
            kind, fixed = kinds[place], self.fixed[state]
            gain = self.log[state, kind] - self.plain_log[plain, kind]
            gain[fixed >= 0] += _WITHIN[kind[fixed >= 0]]
            following = self.next[state, kind]
            following[(fixed >= 0) & (fixed != raw[place])] = -1
            live = following >= 0
            start, form, state, place = start[live], form[live], following[live], place[live] + 1
            ratio = ratio[live] + gain[live]
            plain = self.plain_next[plain[live], kind[live]]
            done = (self.end[state] > NEVER) & ~alnum[place]
            score = ratio + self.end[state] - self.plain_end[plain]
            done &= score >= -MARGIN
            found.append((start[done], place[done], form[done], score[done]))
        if not found:
            return (np.zeros(0, np.int64),) * 4
        return tuple(np.concatenate(columns) for columns in zip(*found, strict=True))


@lru_cache(maxsize=4)
def learned_formats(per_format: int = 150, seed: int = 11) -> Formats:
    return Formats(labelled_credentials(per_format, seed), ordinary_strings())


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found = []
    for order, (kind, pattern, least) in enumerate(BASE):
        for m in pattern.finditer(text):
            if len(m[m.lastindex or 0]) >= least:
                found.append((m.start(), order, m.end(), kind))
    return [(start, end, kind) for start, _, end, kind in sorted(found)]


def _codes(text: str) -> np.ndarray:
    return np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 128).astype(np.int16)


def format_spans_of(texts: list[str], formats: Formats) -> list[list[tuple[int, int, str]]]:
    """The learned spans of each text. Texts are read together, with something between them that no string holds.

    Of a format's overlapping secrets the one that begins first counts, of these the likeliest.
    """
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    begins = np.cumsum(sizes) - sizes
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    start, end, form, score = formats.read(_codes("\0".join(texts)))
    last: dict[int, int] = {}
    for i in np.lexsort((-score, start)).tolist():
        s, e, f = int(start[i]), int(end[i]), int(form[i])
        if s >= last.get(f, 0):
            last[f] = e
            text = int(np.searchsorted(begins, s, "right")) - 1
            out[text].append((s - int(begins[text]), e - int(begins[text]), formats.names[f]))
    return out


def format_spans(text: str, formats: Formats) -> list[tuple[int, int, str]]:
    return format_spans_of([text], formats)[0]


_RANK = {name: i for i, name in enumerate([*(k for k, _, _ in BASE), *FORMATS])}


def find_spans_of(texts: list[str], formats: Formats) -> list[tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]]:
    """Of each text the base spans; and these with the learned ones beside them. By start, then kind as listed."""
    base = [base_spans(t) for t in texts]
    return [(b, sorted(b + more, key=lambda x: (x[0], _RANK[x[2]], x[1]))) for b, more in zip(base, format_spans_of(texts, formats), strict=True)]


def find_spans(text: str, formats: Formats) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    return find_spans_of([text], formats)[0]


SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add base_spans and secret_spans, arrays of (kind, start, end) in code points, ordered by start, then kind as listed.

    secret_spans holds base_spans and all spans that the learned formats find, those over base spans too. Null
    and empty texts have none. Other columns and repeated rows stay.
    """
    formats = learned_formats()
    kept = [c for c in docs.columns if c not in ("base_spans", "secret_spans", text_col)]
    schema = T.StructType([docs.schema[c] for c in kept] + [docs.schema[text_col], T.StructField("base_spans", T.ArrayType(SPAN)), T.StructField("secret_spans", T.ArrayType(SPAN))])
    kind_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in byte_parts(whole, len(kept))):
            base, every = [], []
            for found, all_spans in find_spans_of([t or "" for t in batch.column(len(kept)).to_pylist()], formats):
                base.append([{"kind": k, "start": s, "end": e} for s, e, k in found])
                every.append([{"kind": k, "start": s, "end": e} for s, e, k in all_spans])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(base, kind_type), pa.array(every, kind_type)], names=[*kept, text_col, "base_spans", "secret_spans"])
        give_back()

    return docs.select(*(F.col(f"`{c}`") for c in [*kept, text_col])).mapInArrow(run, schema)


def joined(spans: str):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def mask_spans(text: str, spans: list[tuple[int, int, str]], mask: str) -> str:
    """Each maximal run of overlapping spans becomes one mask."""
    parts, at = [], 0
    for start, end, _ in sorted(spans):
        if start >= at:
            parts += [text[at:start], mask]
        elif not parts:
            parts.append(mask)
        at = max(at, end)
    return "".join(parts) + text[at:]


def redact(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """Replace every secret span of text by mask; all documents and columns stay, n_chars follows the new text."""
    formats = learned_formats()
    names = docs.columns
    rest = [c for c in names if c not in ("text", "n_chars")]
    counted, flag = "n_chars" in names, fresh(names, "changed")
    schema = T.StructType([docs.schema[c] for c in rest] + [docs.schema["text"]] + [T.StructField(flag, T.BooleanType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in byte_parts(whole, len(rest))):
            texts, changed = [], []
            given = batch.column(len(rest)).to_pylist()
            for text, (_, spans) in zip(given, find_spans_of([t or "" for t in given], formats), strict=True):
                changed.append(bool(spans))
                texts.append(mask_spans(text, spans, mask) if spans else text)
            columns = [*batch.columns[: len(rest)], pa.array(texts, pa.string()), pa.array(changed, pa.bool_()), *batch.columns[len(rest) + 1 :]]
            yield pa.RecordBatch.from_arrays(columns, names=[*rest, "text", flag, *["n_chars"] * counted])
        give_back()

    if counted:
        schema = schema.add(docs.schema["n_chars"])
    out = docs.select(*(F.col(f"`{c}`") for c in [*rest, "text", *["n_chars"] * counted])).mapInArrow(run, schema)
    if counted:
        out = out.withColumn("n_chars", F.when(F.col(flag), F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*(F.col(f"`{c}`") for c in names))
