"""BPE encoding and decoding by a tokenization automaton.

The automaton reads a *token* string and accepts it exactly if byte-pair encoding produces it. It starts
as the byte automaton (one arc per byte from anywhere) and grows by one gadget per merge (u, v) -> w, in
merge order:

* w may be taken wherever u could be taken          (its incoming arcs are inherited from u),
* after w comes whatever could come after v         (its outgoing arcs are inherited from v),
* the arc u -> v disappears (it would have merged).

Whether an arc exists depends on the last token and the next one only, so the token is the state. Arcs are
kept in inherited form: a gadget stores its two parents and the arc it removed; `arc` unwinds gadgets from
the newest to the oldest and memoises the answer. A gadget whose arc u -> v is already gone is dead and adds nothing.

For reading bytes it is made deterministic: a byte state is the token that ends here and the set of arcs that are
half spelled, as (state they left, node of the label tree). Every byte string spells exactly one accepted path, so
at each byte exactly one arc ends. The table of (byte state, byte) to byte state is compiled as it is first used and
starts anew beyond MOST_STATES states. Words are encoded many at a time, by one table step per byte; then the tokens
that end are emitted from the last byte backwards. Decoding emits the arc labels (token bytes).
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.llm._shared import byte_parts, give_back, slices

#: Fixed value: the published byte-level pre-split pattern.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Pieces of text, and first pieces of lines (and odd words), after which a worker starts their cache anew.
CACHED_WORDS, CACHED_FIRST = 80_000, 30_000
#: Byte states and arc answers after which a worker compiles anew.
MOST_STATES, MOST_ARCS = 300_000, 200_000
#: Longer words (in bytes) are encoded one by one; the others in chunks of CHUNK.
LONG_WORD, CHUNK = 64, 1 << 14
#: Text of about this size is worked on at a time.
SLICE_BYTES = 1 << 20
_NEVER = 1 << 60
#: Bits of a label tree's node in a half-spelled arc.
_NODE_BITS = 24


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies print for the 256 bytes: printable ones as they are, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class _StepTable:
    """Byte state << 8 | byte -> byte state, as arrays with open addressing, so that many steps are looked up at once."""

    def __init__(self, bits: int = 16):
        self.bits, self.used = bits, 0
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)

    def _places(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The value of every key, or -1."""
        at = self._places(keys)
        seen = self.keys[at]
        out = np.where(seen == keys, self.values[at], -1).astype(np.int64)
        rows = np.flatnonzero((seen != keys) & (seen >= 0))
        while len(rows):
            at[rows] = (at[rows] + 1) & ((1 << self.bits) - 1)
            seen = self.keys[at[rows]]
            hit = seen == keys[rows]
            out[rows[hit]] = self.values[at[rows[hit]]]
            rows = rows[~hit & (seen >= 0)]
        return out

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Distinct new keys."""
        if 2 * (self.used + len(keys)) > 1 << self.bits:
            old, kept = self.keys[self.keys >= 0], self.values[self.keys >= 0]
            self.__init__(max(self.bits + 1, int(4 * (self.used + len(keys))).bit_length()))
            self.add(old, kept)
        self.used += len(keys)
        at = self._places(keys)
        while len(keys):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[free]  # of keys at one free place, one stays
            put = free & (self.keys[at] == keys)
            self.values[at[put]] = values[put]
            keys, values, at = keys[~put], values[~put], (at[~put] + 1) & ((1 << self.bits) - 1)


class TokenAutomaton:
    def __init__(self, definition: dict, most_states: int = MOST_STATES):
        self.most_states = most_states
        model = definition["model"]
        if model["type"] != "BPE" or definition["pre_tokenizer"].get("type") != "ByteLevel" or definition["pre_tokenizer"].get("add_prefix_space") or model.get("ignore_merges") or definition.get("normalizer"):
            raise ValueError("a byte-level BPE vocabulary without normalizer, prefix space or ignored merges is needed")
        letters, vocab = byte_letters(), model["vocab"]
        size = 1 + max([*vocab.values(), *(x["id"] for x in definition["added_tokens"])])
        self.labels: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.labels[i] = bytes(letters[c] for c in token)
        self.specials = {x["content"]: x["id"] for x in definition["added_tokens"]}
        for token, i in self.specials.items():
            self.labels[i] = token.encode()
        self.special_split = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.specials, key=len, reverse=True)) + ")") if self.specials else None
        self.born, self.left, self.right = [0] * size, [-1] * size, [-1] * size
        self.removed: dict[tuple[int, int], int] = {}
        self.known_arcs: dict[int, bool] = {}
        self.arcs = {self.labels[vocab[c]]: vocab[c] for c in letters if c in vocab}
        for rank, pair in enumerate(model["merges"], 1):
            self._add_gadget(rank, *(pair if isinstance(pair, list) else pair.split(" ")), vocab)
        self.label_sizes = np.array([len(x) for x in self.labels], np.int64)
        self._plant()
        self._restart()

    def _plant(self) -> None:
        """The tree of arc labels: child[node << 8 | byte], the token that a node spells (or -1), whether labels go on."""
        self.child: dict[int, int] = {}
        self.spells, self.goes_on = [-1], [True]
        for label, token in self.arcs.items():
            node = 0
            for byte in label:
                self.goes_on[node] = True
                following = self.child.get(node << 8 | byte)
                if following is None:
                    following = self.child[node << 8 | byte] = len(self.spells)
                    self.spells.append(-1)
                    self.goes_on.append(False)
                node = following
            self.spells[node] = token

    def _restart(self) -> None:
        """An empty byte table: state 0 is before the first byte, where every token may begin."""
        self.table = _StepTable()
        self.half: list[tuple[int, ...]] = [(0,)]  # (1 + state left) << _NODE_BITS | node of each half-spelled arc
        self.numbers: dict[tuple[int, ...], int] = {}
        self.ends = np.full(1 << 12, -1, np.int32)  # the token that ends at a byte state

    def _add_gadget(self, rank: int, u: str, v: str, vocab: dict[str, int]) -> None:
        a, b, w = vocab[u], vocab[v], vocab[u + v]
        known = self.labels[a] in self.arcs and self.labels[b] in self.arcs
        if not known or self.left[w] >= 0 or not self._unwind(a, b, rank):
            if self.left[w] >= 0:
                raise ValueError(f"two merges make the token {u + v!r}")
            return
        self.born[w], self.left[w], self.right[w] = rank, a, b
        self.removed[a, b] = rank
        self.arcs[self.labels[w]] = w

    def _unwind(self, x: int, y: int, before: int = _NEVER) -> bool:
        """Does the arc y leave state x, in the automaton of the gadgets older than `before`?"""
        born, removed = self.born, self.removed
        while True:
            if removed.get((x, y), _NEVER) < before:
                return False
            if born[x] > born[y]:
                before, x = born[x], self.right[x]
            elif born[y]:
                # the gadget of y merges from left to right, so it takes x -> left(y) first
                before, y = born[y] + 1, self.left[y]
            else:
                return True

    def arc(self, x: int, y: int) -> bool:
        key = x << 20 | y
        known = self.known_arcs.get(key)
        if known is None:
            if len(self.known_arcs) >= MOST_ARCS:
                self.known_arcs.clear()
            known = self.known_arcs[key] = self._unwind(x, y)
        return known

    def _compile(self, state: int, byte: int) -> int:
        """Add the table's entry for a byte state and a byte."""
        going, ended = [], -1
        for half in self.half[state]:
            node = self.child.get((half & (1 << _NODE_BITS) - 1) << 8 | byte)
            if node is None:
                continue
            left, token = half >> _NODE_BITS, self.spells[node]
            if ended < 0 and token >= 0 and (not left or self.arc(left - 1, token)):
                ended = token
            if self.goes_on[node]:
                going.append(left << _NODE_BITS | node)
        if ended < 0:
            raise ValueError("a byte of the text is not in the vocabulary")
        going.append(ended + 1 << _NODE_BITS)
        return self._number(tuple(going), ended)

    def _number(self, key: tuple[int, ...], ended: int) -> int:
        """The byte state of these half-spelled arcs; the last of them names the token that ends here."""
        number = self.numbers.get(key)
        if number is None:
            number = self.numbers[key] = len(self.half)
            self.half.append(key)
            if number >= len(self.ends):
                self.ends = np.concatenate([self.ends, np.full(len(self.ends), -1, np.int32)])
            self.ends[number] = ended
        return number

    def encode_words(self, words: list[bytes], kind: type = np.uint32) -> list[bytes]:
        """The ids of every word, packed as integers of this kind."""
        size = np.array([len(w) for w in words], np.int64)
        order = np.argsort(size, kind="stable")
        out = [b""] * len(words)
        short = int(np.searchsorted(size[order], LONG_WORD, "right"))
        for start in range(0, short, CHUNK):
            rows = order[start : min(start + CHUNK, short)]
            for row, ids in zip(rows.tolist(), self._encode_chunk([words[i] for i in rows], size[rows], kind), strict=True):
                out[row] = ids
        for row in order[short:].tolist():
            out[row] = self.encode_long(words[row]).astype(kind).tobytes()
        return out

    def _encode_chunk(self, words: list[bytes], size: np.ndarray, kind: type) -> list[bytes]:
        """Words in order of their size: all take their table step for one place at a time."""
        if len(self.half) > self.most_states:
            self._restart()
        n, longest = len(words), int(size[-1])
        data = np.frombuffer(b"".join(words), np.uint8)
        begins = np.cumsum(size) - size
        state, ending = np.zeros(n, np.int64), np.full((n, longest), -1, np.int32)
        for place in range(longest):
            first = int(np.searchsorted(size, place, "right"))
            steps = state[first:] << 8 | data[begins[first:] + place]
            following = self.table.find(steps)
            new = following < 0
            if new.any():
                wanted = np.unique(steps[new])
                self.table.add(wanted, np.array([self._compile(x >> 8, x & 255) for x in wanted.tolist()], np.int64))
                following[new] = self.table.find(steps[new])
            state[first:] = following
            ending[first:, place] = self.ends[following]
        rows, at, columns = np.flatnonzero(size > 0), size.copy(), []
        while len(rows):
            tokens = ending[rows, at[rows] - 1]
            column = np.full(n, -1, np.int32)
            column[rows] = tokens
            columns.append(column)
            at[rows] -= self.label_sizes[tokens]
            rows = rows[at[rows] > 0]
        if not columns:
            return [b""] * n
        path = np.stack(columns[::-1], axis=1)
        packed = path[path >= 0].astype(kind)
        ends = np.cumsum((path >= 0).sum(axis=1) * packed.itemsize).tolist()
        data = packed.tobytes()
        return [data[a:b] for a, b in zip([0, *ends], ends)]

    def encode_long(self, word: bytes) -> np.ndarray:
        """One word, by a table of its own; it goes on from its present state where the states start anew."""
        if len(self.half) > self.most_states:
            self._restart()
        table: dict[int, int] = {}
        state, ending = 0, array("i")
        for byte in word:
            step = state << 8 | byte
            following = table.get(step)
            if following is None:
                following = table[step] = self._compile(state, byte)
            state = following
            ending.append(int(self.ends[state]))
            if len(self.half) > self.most_states:
                key = self.half[state]
                self._restart()
                table, state = {}, self._number(key, ending[-1])
        path, at = [], len(word)
        while at > 0:
            path.append(ending[at - 1])
            at -= self.label_sizes[path[-1]]
        return np.array(path[::-1], np.int32)

    def decode(self, ids: list[int]) -> str:
        return decode_ids(self.labels, ids)


class Encoder:
    """Whole texts to ids. Pieces between single blanks and line ends never share a token with their
    neighbours, so they are split off and looked up; a text with any other white space at a piece's edge is
    split by the full pattern. What the pieces of some texts do not know yet is encoded together. Ids are packed
    as unsigned integers of two bytes (four for larger vocabularies)."""

    def __init__(self, automaton: TokenAutomaton):
        self.automaton = automaton
        self.kind = np.uint16 if len(automaton.labels) <= 1 << 16 else np.uint32
        # piece -> packed ids; None for a piece that starts or ends with white space, or is empty
        self.first: dict[str, bytes | None] = {}
        self.later: dict[str, bytes | None] = {}
        self.words: dict[str, bytes] = {}
        self.line_end = self._pack(["\n"])[0]

    def _pack(self, words: list[str]) -> list[bytes]:
        return self.automaton.encode_words([w.encode() for w in words], self.kind)

    def _learn(self, texts: list[str]) -> None:
        """Encode the pieces of these texts that are not known yet."""
        for known, most in ((self.first, CACHED_FIRST), (self.later, CACHED_WORDS), (self.words, CACHED_FIRST)):
            if len(known) > most:
                known.clear()
        first: set[str] = set()
        later: set[str] = set()
        for text in texts:
            for line in text.split("\n"):
                head, *rest = line.split(" ")
                first.add(head)
                later.update(rest)
        for known, prefix, pieces in ((self.first, "", first), (self.later, " ", later)):
            plain, mixed = [], []
            for piece in pieces:
                if piece in known:
                    continue
                if piece.isalpha():  # one word of the pattern: letters only
                    plain.append(piece)
                elif not piece or piece[0].isspace() or piece[-1].isspace():
                    known[piece] = None
                else:
                    mixed.append((piece, SPLIT.findall(prefix + piece)))
            known.update(zip(plain, self._pack([prefix + p for p in plain]), strict=True))
            parts = list({w for _, words in mixed for w in words})
            packed = dict(zip(parts, self._pack(parts), strict=True))
            known.update((piece, b"".join(packed[w] for w in words)) for piece, words in mixed)

    def _by_pattern(self, text: str) -> bytes:
        words = SPLIT.findall(text)
        new = list({w for w in words if w not in self.words})
        self.words.update(zip(new, self._pack(new), strict=True))
        return b"".join(map(self.words.__getitem__, words))

    def _plain(self, text: str) -> bytes:
        if not text:
            return b""
        first, later = self.first, self.later.__getitem__
        try:
            lines = []
            for line in text.split("\n"):
                head, *rest = line.split(" ")
                lines.append(first[head] + b"".join(map(later, rest)))
            return self.line_end.join(lines)
        except TypeError:  # a None among the pieces
            return self._by_pattern(text)

    def encode_texts(self, texts: list[str]) -> list[np.ndarray]:
        auto = self.automaton
        special = auto.special_split
        # plain text at even places, special tokens between
        parts = [special.split(t) if special and any(s in t for s in auto.specials) else [t] for t in texts]
        self._learn([p for each in parts for p in each[::2]])
        token = lambda p: self.kind(auto.specials[p]).tobytes()
        return [np.frombuffer(b"".join(token(p) if i % 2 else self._plain(p) for i, p in enumerate(each)), self.kind) for each in parts]

    def ids(self, text: str) -> np.ndarray:
        return self.encode_texts([text])[0]

    def encode(self, text: str) -> list[int]:
        return self.ids(text).tolist()

    def forget(self) -> None:
        """Drop the pieces that were looked up, so that a worker that goes on with other work holds the automaton only."""
        for known in (self.first, self.later, self.words):
            known.clear()
        give_back()


@lru_cache(maxsize=1)
def _encoder(definition: bytes, most_states: int = MOST_STATES) -> Encoder:
    return Encoder(TokenAutomaton(json.loads(definition), most_states))


@lru_cache(maxsize=1)
def _labels(definition: bytes) -> list[bytes]:
    """Arc labels by id: all that decoding needs."""
    known, letters = json.loads(definition), byte_letters()
    tokens = {i: bytes(letters[c] for c in t) for t, i in known["model"]["vocab"].items()} | {x["id"]: x["content"].encode() for x in known["added_tokens"]}
    return [tokens.get(i, b"") for i in range(max(tokens, default=-1) + 1)]


def decode_ids(labels: list[bytes], ids: list[int]) -> str:
    return b"".join(map(labels.__getitem__, ids)).decode("utf-8", "replace")


def _definition(df: DataFrame, tokenizer_path: str):
    with open(tokenizer_path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())  # 2 MB: a vocabulary file


def encode(df: DataFrame, tokenizer_path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """Replace text_col by ids_col array<int>, the ids of the whole text.

    Null text counts as empty: no ids. Strings of the vocabulary's special tokens become their ids. A
    column that is already named ids_col is replaced; all other columns, and repeated rows, stay.
    """
    model = _definition(df, tokenizer_path)
    kept = [c for c in df.columns if c not in (text_col, ids_col)]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(ids_col, T.ArrayType(T.IntegerType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(model.value)
        for batch in batches:
            for part in byte_parts(batch, len(kept), SLICE_BYTES):
                ids = encoder.encode_texts([t or "" for t in part.column(len(kept)).to_pylist()])
                offsets = np.cumsum([0] + [len(x) for x in ids])
                column = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(ids).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], column], names=[*kept, ids_col])
        encoder.forget()

    return df.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{text_col}`")).mapInArrow(run, schema)


def decode(df: DataFrame, tokenizer_path: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """Replace ids_col by text_col: the labels of the ids, read as UTF-8 with U+FFFD for broken sequences.

    Null ids give an empty text. Other columns and repeated rows stay.
    """
    model = _definition(df, tokenizer_path)
    kept = [c for c in df.columns if c not in (text_col, ids_col)]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(text_col, T.StringType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels = _labels(model.value)
        for batch in batches:
            for start, stop in slices(pc.fill_null(pc.list_value_length(batch.column(len(kept))), 0).to_pylist(), SLICE_BYTES // 4):
                part = batch.slice(start, stop - start)
                texts = [decode_ids(labels, x.values.tolist() if x.values is not None else []) for x in part.column(len(kept))]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string())], names=[*kept, text_col])

    return df.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{ids_col}`")).mapInArrow(run, schema)


ROUND_TRIP = T.StructType([T.StructField("n_tokens", T.LongType(), False), T.StructField("ids_sha256", T.StringType(), False), T.StructField("decoded_sha256", T.StringType(), False)])


def round_trip(docs: DataFrame, tokenizer_path: str, most_states: int = MOST_STATES, keep: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document, derived from the ids and the decoded text.

    One pass encodes a slice of texts and decodes its ids, so that ids and texts do not travel and a task holds one worker.
    A worker holds about 1 KB for each of most_states byte states; without `keep` it drops the automaton at a
    partition's end, which costs its compilation in each and leaves the room to other stages.
    """
    model = _definition(docs, tokenizer_path)
    schema = T.StructType([docs.schema["doc_id"], *ROUND_TRIP])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(model.value, most_states)
        labels = encoder.automaton.labels
        for batch in batches:
            for part in byte_parts(batch, 1, SLICE_BYTES):
                ids = [x.tolist() for x in encoder.encode_texts([t or "" for t in part.column(1).to_pylist()])]
                texts = (hashlib.sha256(decode_ids(labels, x).encode()).hexdigest() for x in ids)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(len, ids), pa.int64()), pa.array(map(digest, ids), pa.string()), pa.array(texts, pa.string())], names=schema.names)
        if not keep:
            _encoder.cache_clear()
        encoder.forget()

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def digest(ids: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
