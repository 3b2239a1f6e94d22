"""Byte-level BPE by a deterministic automaton over tokens.

The automaton accepts exactly the token sequences that BPE makes. It starts as one state with an arc for each byte and
takes a gadget for each merge (u, v) -> w in order of rank: w gets an arc from every state that has u, and leads where
v leads; the arc v leaves the state behind u. A state is thus "behind token a", and an arc b of it is present or not
once all gadgets are in. Token pairs are far too many to list, so the gadgets are compiled to tables: for each token its
birth (the rank that made it) and two parts, for each pair its death (the rank that takes the arc away), and the byte
transitions of the trie of labels. Whether an arc is present follows from births and deaths in a few look-ups.

Encoding runs the automaton over pre-split words by these tables, many words in step: byte by byte, all label paths that
are open in a word move on, and of the labels that end there the one whose arc leaves the state at its start is taken.
Each prefix has one accepting path, so the states' back-links spell the ids. Decoding emits the label (bytes) of each arc.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces, relieved, text_of

#: The byte-level pre-split pattern of this public vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters below U+0250 of the pattern's classes, on which all regex libraries agree; texts of no others are split by the faster library.
_LATIN = [chr(c) for c in range(0x250) if c not in range(0x1C, 0x20)]
_CLASS = {k: "".join(re.escape(c) for c in _LATIN if unicodedata.category(c)[0] == k) for k in "LN"}
_BLANK = r"\t-\r \x85\xa0"
LATIN = re.compile(r"[\x00-\x1b\x20-\u024f]*")
LATIN_WORDS = re.compile(rf" ?[{_CLASS['L']}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{_CLASS['N']}]+| ?[^{_BLANK}{_CLASS['L']}{_CLASS['N']}]+|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]+")
MEMO_BYTES = 48 << 20  # of remembered words, in each of two generations; they are forgotten when a task ends
ENTRY_BYTES = 300  # of an entry besides its characters
IN_STEP = 48  # bytes; longer words run alone
WORDS_IN_STEP = 4096


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies: visible Latin-1 stands for itself, the rest follows from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Table:
    """Numbers by 64-bit keys, looked up many at a time: open addressing in two arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.shift = np.uint64(64 - max(4, int(2 * len(keys)).bit_length()))
        self.mask = (1 << (64 - int(self.shift))) - 1
        self.keys = np.full(self.mask + 1, -1, np.int64)
        self.values = np.full(self.mask + 1, -1, np.int32)
        left, spot = np.arange(len(keys)), self._spot(keys)
        while len(left):
            free = self.keys[spot] < 0
            at, first = np.unique(spot[free], return_index=True)
            put = left[free][first]
            self.keys[at], self.values[at] = keys[put], values[put]
            stay = self.keys[spot] != keys[left]
            left, spot = left[stay], (spot[stay] + 1) & self.mask

    def _spot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, -1 for others."""
        spot = self._spot(keys)
        found = self.keys[spot]
        out = np.where(found == keys, self.values[spot], -1)
        more = np.flatnonzero((found != keys) & (found >= 0))
        spot = spot[more]
        while len(more):
            spot = (spot + 1) & self.mask
            found = self.keys[spot]
            out[more] = np.where(found == keys[more], self.values[spot], -1)
            on = (found != keys[more]) & (found >= 0)
            more, spot = more[on], spot[on]
        return out

    def one(self, key: int) -> int:
        spot = (key * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> int(self.shift)
        while (found := self.keys[spot]) != key:
            if found < 0:
                return -1
            spot = spot + 1 & self.mask
        return int(self.values[spot])


class Automaton:
    """Compiled merges. definition: the JSON text of a byte-level tokenizer file."""

    def __init__(self, definition: str):
        told = json.loads(definition)
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        vocab, merges = told["model"]["vocab"], told["model"]["merges"]
        self.special = {x["content"]: x["id"] for x in told.get("added_tokens", [])}
        labels = {i: raw(s) for s, i in vocab.items() if s not in self.special}
        n = max(max(labels), *self.special.values(), 0) + 1
        self.labels = [b""] * n
        for i, b in (labels | {i: s.encode() for s, i in self.special.items()}).items():
            self.labels[i] = b
        self.longest = max(map(len, labels.values()))
        self.birth = np.full(n, -1, np.int64)
        self.left, self.right = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        death: dict[int, int] = {}
        for rank, merge in enumerate(merges):
            u, v = merge.split(" ") if isinstance(merge, str) else merge
            self._gadget(death, rank, vocab[u], vocab[v], vocab[u + v])
        self.never = len(merges)
        self.death = Table(np.array(list(death), np.int64), np.array(list(death.values()), np.int32))
        self._trie(labels)
        self.met: dict[tuple[int, int], bool] = {}
        self.pattern = regex.compile(PATTERN)
        self.cut = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None

    def _gadget(self, death: dict[int, int], rank: int, u: int, v: int, w: int) -> None:
        death.setdefault(u << 32 | v, rank)
        if self.birth[w] < 0:
            self.birth[w], self.left[w], self.right[w] = rank, u, v

    def _trie(self, labels: dict[int, bytes]) -> None:
        """Byte transitions between prefixes of labels, and the token at each; prefix 0 is empty."""
        known = {b"": 0}
        for label in sorted(labels.values()):
            for k in range(1, len(label) + 1):
                known.setdefault(label[:k], len(known))
        self.token = np.full(len(known), -1, np.int64)
        for i, label in labels.items():
            self.token[known[label]] = i
        grown = [(known[p[:-1]] << 8 | p[-1], k) for p, k in known.items() if p]
        self.next = Table(np.array([x for x, _ in grown], np.int64), np.array([k for _, k in grown], np.int32))
        self.single = np.array([self.token[known[bytes([b])]] if bytes([b]) in known else -1 for b in range(256)], np.int64)

    def arcs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether b may follow a once all gadgets are in, for arrays of tokens."""
        out = np.zeros(len(a), bool)
        at, before = np.arange(len(a)), np.full(len(a), self.never)
        while len(at):
            gone = self.death.get(a << 32 | b)
            made_a, made_b = self.birth[a], self.birth[b]
            alive = (gone < 0) | (gone >= before)
            base = (made_a < 0) & (made_b < 0)
            out[at[alive & base]] = True
            from_a, from_b = made_a > made_b, made_b > made_a
            twice = from_b & (self.left[b] == self.right[b]) & (self.left[b] == a)  # of three equal tokens the first two merge
            on = np.flatnonzero(alive & ~base & ~twice)
            a, b, from_a, from_b, at = a[on], b[on], from_a[on], from_b[on], at[on]
            before = np.maximum(made_a[on], made_b[on])
            # a leads where its right part led when a was made; b left from every state that had its left part
            a, b = np.where(from_b, a, self.right[a]), np.where(from_a, b, self.left[b])
        return out

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Ids of pre-split words, by table-driven transitions of many words in step."""
        out: list[list[int]] = [[] for _ in words]
        order = sorted((k for k in range(len(words)) if 0 < len(words[k]) <= IN_STEP), key=lambda k: -len(words[k]))
        for k in range(0, len(order), WORDS_IN_STEP):
            some = order[k : k + WORDS_IN_STEP]
            for i, ids in zip(some, self._in_step([words[i] for i in some]), strict=True):
                out[i] = ids
        for k, word in enumerate(words):
            if len(word) > IN_STEP:
                out[k] = self.encode_word(word)
        return out

    def _in_step(self, words: list[bytes]) -> list[list[int]]:
        """words: from long to short."""
        sizes = np.array([len(w) for w in words])
        n, width = len(words), int(sizes[0])
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width).astype(np.int64)
        state, size = np.full((n, width + 1), -1, np.int64), np.zeros((n, width + 1), np.int64)
        path = np.zeros((n, width), np.int64)  # of each start: the label prefix from there on, -1 when none goes on
        for end in range(1, width + 1):
            live = int(np.searchsorted(-sizes, -end, "right"))  # words of end bytes or more
            rows, starts = np.nonzero(path[:live, :end] >= 0)
            to = self.next.get(path[rows, starts] << 8 | raw[rows, end - 1])
            path[rows, starts] = to
            ends = np.flatnonzero(np.where(to >= 0, self.token[to], -1) >= 0)
            rows, starts, tokens = rows[ends], starts[ends], self.token[to[ends]]
            first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))  # of each word the candidate that starts leftmost
            last = np.append(first[1:], len(rows)) if len(first) else first
            while len(first):
                row, start, token = rows[first], starts[first], tokens[first]
                ok = start == 0
                behind = np.flatnonzero(~ok)
                ok[behind] = self.arcs(state[row[behind], start[behind]], token[behind])
                state[row[ok], end], size[row[ok], end] = token[ok], end - start[ok]
                first, last = first[~ok] + 1, last[~ok]
                on = first < last
                first, last = first[on], last[on]
        out = []
        state, size = state.tolist(), size.tolist()
        for k, end in enumerate(sizes.tolist()):
            own, back = state[k], size[k]
            ids = []
            while end:
                ids.append(own[end])
                end -= back[end]
            out.append(ids[::-1])
        return out

    def encode_word(self, word: bytes) -> list[int]:
        """Ids of one pre-split word of any length by the same transitions."""
        n, token = len(word), self.token
        state, size = [-1] * (n + 1), [0] * (n + 1)
        paths: list[tuple[int, int]] = []  # (start, label prefix) that are open
        for end in range(1, n + 1):
            paths.append((end - 1, 0))
            paths = [(s, to) for s, at in paths if (to := self.next.one(at << 8 | word[end - 1])) >= 0]
            for start, at in paths:
                t = int(token[at])
                if t >= 0 and (start == 0 or self.arc(state[start], t)):
                    state[end], size[end] = t, end - start
                    break
        out = []
        while n:
            out.append(state[n])
            n -= size[n]
        return out[::-1]

    def arc(self, a: int, b: int) -> bool:
        key = (a, b)
        if key not in self.met:
            if len(self.met) > 20_000:
                self.met.clear()
            self.met[key] = bool(self.arcs(np.array([a]), np.array([b]))[0])
        return self.met[key]

    def split(self, text: str) -> list[str]:
        """Pre-split words of a text without special tokens; their concatenation is the text."""
        return LATIN_WORDS.findall(text) if LATIN.fullmatch(text) else self.pattern.findall(text)

    def words(self, text: str) -> list[str]:
        """Pre-split words and special tokens of a text."""
        if not self.cut:
            return self.split(text)
        return [w for part in self.cut.split(text) for w in ([part] if part in self.special else self.split(part))] if self.cut.search(text) else self.split(text)

    def encode(self, text: str) -> list[int]:
        words = self.words(text)
        ids = iter(self.encode_words([w.encode() for w in words if w not in self.special]))
        return [i for w in words for i in ([self.special[w]] if w in self.special else next(ids))]

    def decode(self, ids: list[int]) -> bytes:
        """Labels of the arcs, joined; bytes, for a cut through ids may split a character."""
        return b"".join([self.labels[i] for i in ids])


class Memo(dict):
    """Ids (as decimal text joined by commas) and decoded bytes of pre-split words and special tokens. Of two generations of MEMO_BYTES the older is forgotten."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton, self.size = automaton, 0
        self.old: dict[str, tuple[str, bytes]] = {}

    def meet(self, words: set[str]) -> None:
        """Encodes those of the words that aren't known, together."""
        if self.size > MEMO_BYTES:
            self.old, self.size = dict(self), 0
            self.clear()
        automaton, new = self.automaton, []
        for word in words.difference(self):
            got = self.old.get(word)
            if got is not None:
                self._keep(word, got)
            elif word in automaton.special:
                self._keep(word, (str(automaton.special[word]), word.encode()))
            else:
                new.append(word)
        for word, ids in zip(new, automaton.encode_words([w.encode() for w in new]), strict=True):
            self._keep(word, (",".join(map(str, ids)), automaton.decode(ids)))

    def _keep(self, word: str, got: tuple[str, bytes]) -> None:
        self.size += ENTRY_BYTES + len(got[0]) + 2 * len(got[1])
        self[word] = got


_READY: dict[int, Automaton] = {}


def _ready(definition: str) -> Automaton:
    """The compiled automaton of a worker, made once; its size is the vocabulary's."""
    key = hash(definition)
    if key not in _READY:
        _READY.clear()
        _READY[key] = Automaton(definition)
    return _READY[key]


def run_texts(texts: list[str], automaton: Automaton, memo: Memo) -> Iterator[list[tuple[str, bytes]]]:
    """For each text the (ids, decoded bytes) of the words that make it up."""
    split = [automaton.words(text) for text in texts]
    memo.meet(set().union(*split))
    for words in split:
        yield list(map(memo.__getitem__, words))


def definition_of(path: str) -> str:
    with open(path, encoding="utf-8") as file:
        return file.read()


def encode_documents(docs: DataFrame, path: str, ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of docs (doc_id, text); with ids also input_ids array<int> and decoded string.

    path: a byte-level BPE file that the driver can read; its text goes to the executors (a vocabulary's size).
    Null text is empty: no ids, digests of nothing. Equal rows get equal results, rows of any length are encoded whole,
    no rows give no rows, other columns are ignored.
    """
    told = docs.sparkSession.sparkContext.broadcast(definition_of(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _ready(told.value)
        memo = Memo(automaton)
        for batch in pieces(batches, "text"):
            count, first, second, all_ids, texts = [], [], [], [], []
            for parts in run_texts([text or "" for text in batch["text"].to_pylist()], automaton, memo):
                line = ",".join([p[0] for p in parts])
                back = b"".join([p[1] for p in parts])
                count.append(line.count(",") + 1 if line else 0)
                first.append(hashlib.sha256(line.encode()).hexdigest())
                second.append(hashlib.sha256(back).hexdigest())
                if ids:
                    all_ids.append([int(x) for x in line.split(",")] if line else [])
                    texts.append(back.decode("utf-8", "replace"))
            arrays = [batch["doc_id"], pa.array(count, pa.int64()), pa.array(first), pa.array(second)]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if ids:
                arrays += [pa.array(all_ids, pa.list_(pa.int32())), pa.array(texts, pa.string())]
                names += ["input_ids", "decoded"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", input_ids array<int>, decoded string" * ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(relieved(run), schema)


def op5_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
