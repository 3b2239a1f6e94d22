"""Removal of word sequences that occur elsewhere, by suffix automata of reference shards.

The automaton of a shard knows every word sequence of its texts and how often each occurs. A document streams through
it word by word for its matching statistics: at each word, the length of the longest sequence ending there that the
shard has (in all, `times` or more). Spans of that length or more are removed.

Against a given reference, shards of a bounded number of words are broadcast and all documents stream through each.
Within one corpus the reference is the corpus itself, which no broadcast may hold: there, shards are the groups of
segments around repeated anchors (repeats.py), and each is matched in the task that it is dealt to.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces, text_of
from .repeats import Shape, repeated

LENGTH = 35
SHARD_WORDS = 200_000
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string"


class SuffixAutomaton:
    """Suffix automaton of weighted word sequences."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.long = [0]
        self.count = [0]
        self.counted = True

    def add(self, words: Iterable, weight: int = 1) -> None:
        following, link, long, count = self.next, self.link, self.long, self.count
        last = 0
        for w in words:
            known = following[last].get(w)
            if known is not None and long[known] == long[last] + 1:
                last = known
            else:
                clone = known is not None
                if clone:
                    last = self._clone(last, w, known)
                else:
                    new = len(long)
                    following.append({})
                    link.append(0)
                    long.append(long[last] + 1)
                    count.append(0)
                    p = last
                    while p >= 0 and w not in following[p]:
                        following[p][w] = new
                        p = link[p]
                    if p >= 0:
                        q = following[p][w]
                        link[new] = q if long[q] == long[p] + 1 else self._clone(p, w, q)
                    last = new
            count[last] += weight
        self.counted = False

    def _clone(self, p: int, w, q: int) -> int:
        following, link, long = self.next, self.link, self.long
        new = len(long)
        following.append(dict(following[q]))
        link.append(link[q])
        long.append(long[p] + 1)
        self.count.append(0)
        link[q] = new
        while p >= 0 and following[p].get(w) == q:
            following[p][w] = new
            p = link[p]
        return new

    def occurrences(self) -> list[int]:
        """How often each state's sequences occur."""
        if not self.counted:
            for s in sorted(range(1, len(self.long)), key=self.long.__getitem__, reverse=True):
                self.count[self.link[s]] += self.count[s]
            self.counted = True
        return self.count

    def statistics(self, words: Iterable, times: int = 1) -> list[int]:
        """For each word, the length of the longest sequence ending with it that occurs times or more."""
        following, link, long, count = self.next, self.link, self.long, self.occurrences()
        state = size = 0
        out = []
        for w in words:
            while state and w not in following[state]:
                state = link[state]
                size = long[state]
            if w in following[state]:
                state = following[state][w]
                size += 1
            at, n = state, size
            while at and count[at] < times:
                at = link[at]
                n = long[at]
            out.append(n)
        return out


def match(segments: list[tuple[list[bytes], int]], length: int) -> list[np.ndarray]:
    """Windows of each weighted segment that occur twice or more in all of them."""
    automaton = SuffixAutomaton()
    for words, weight in segments:
        automaton.add(words, weight)
    return [(np.array(automaton.statistics(words, 2)[length - 1 :]) >= length).astype(np.int8) for words, _ in segments]


class Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        got = xxhash.xxh64_intdigest(word)
        if len(self) > 300_000:
            self.clear()
        self[word] = got
        return got


_HASHES = Hashes()


def _split(text: bytes) -> tuple[np.ndarray, list[bytes]]:
    words = text.split()  # bytes split at \x20 and \x09 to \x0D
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words)), words


def _count(text: bytes) -> int:
    return len(text.split())


def _join(words: list[bytes]) -> bytes:
    return b" ".join(words)


def shape_of(length: int = LENGTH) -> Shape:
    gram = 1 << max(0, (max(1, length // 4)).bit_length() - 1)
    return Shape(length=length, gram=min(8, gram), blocks=(4, 1), most=512, split=_split, count=_count, join=_join, cut=bytes.split)


def _result(doc_ids: list, raw: list[bytes], masks: list, texts: bool) -> pa.RecordBatch:
    rows = []
    for text, mask in zip(raw, masks):
        words = text.split()
        kept = words if mask is None else [w for w, gone in zip(words, mask.tolist()) if not gone]
        flat = b" ".join(kept)
        rows.append((len(words), len(words) - len(kept), hashlib.sha256(flat).hexdigest(), flat.decode()))
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())[: 3 + texts]
    arrays = [pa.array(doc_ids, pa.int64()), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))]
    return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"][: len(arrays)])


def dedup_words(docs: DataFrame, length: int = LENGTH, texts: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row of docs (doc_id, text); with texts also kept.

    Words are stretches without white space (bytes 20 and 09 to 0D), unchanged. A word is removed when a window of
    length words that covers it also starts anywhere else in the texts, in the same one included; windows never cross
    documents and are judged on the input. kept holds the other words joined by one space. Null text has no words;
    repeated rows are documents of their own, each other's copies; no rows give no rows; other columns are ignored.
    """
    return repeated(docs, shape_of(length), match, lambda ids, raw, masks: _result(ids, raw, masks, texts), SCHEMA + ", kept string" * texts)


def shards(reference: DataFrame, words: int = SHARD_WORDS) -> Iterator[list[bytes]]:
    """Texts of the reference in shards of about so many words, one partition at a time on the driver; null and empty texts are left out."""
    shard, size = [], 0
    for row in reference.select(text_of().alias("text")).toLocalIterator():
        text = row.text.encode()
        n = len(text.split())
        if n:
            if shard and size + n > words:
                yield shard
                shard, size = [], 0
            shard.append(text)
            size += n
    if shard:
        yield shard


def remove_reference(docs: DataFrame, reference: DataFrame, length: int = LENGTH, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The rows of docs with text freed of word sequences of length or more that the reference (text) has: doc_id, n_words, n_removed, kept_sha256, kept.

    Automata of the reference's shards are broadcast as their texts, which a worker compiles once; documents stream
    through all of them in one pass and are judged on the input. Meant for a reference of a bounded size, such as a list
    of license texts. Edge cases are as in dedup_words; an empty reference removes nothing.
    """
    spark = docs.sparkSession
    told = [spark.sparkContext.broadcast(shard) for shard in shards(reference, shard_words)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = []
        for shard in told:
            automaton = SuffixAutomaton()
            for text in shard.value:
                automaton.add(text.split())
            automata.append(automaton)
        for batch in pieces(batches, "text"):
            raw = [x.as_buffer().to_pybytes() for x in batch["text"]]
            masks = []
            for text in raw:
                words = text.split()
                steps = np.zeros(len(words) + 1, np.int64)
                for automaton in automata:
                    for end, n in enumerate(automaton.statistics(words)):
                        if n >= length:
                            steps[end + 1 - n] += 1
                            steps[end + 1] -= 1
                masks.append(np.cumsum(steps[:-1]) > 0)
            yield _result(batch["doc_id"].to_pylist(), raw, masks, True)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, SCHEMA + ", kept string")


def op8_automaton_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_words(spark.read.parquet(f"{sf_dir}/documents.parquet"))
