"""Benchmark decontamination by greedy string tiling.

A document and a benchmark item become a pair when they share a seed of SEED consecutive words; the index of the items'
seeds goes to the executors in blocks of a bounded size, one at a time, each of which meets all documents. A pair is then tiled: the
longest matches of unmarked words are found by running Karp-Rabin over lengths that halve from long to short, marked
longest first without overlap, and the search goes on with what is unmarked until no match of SEED words is left. The
share of the item's words under tiles is its coverage, so passages in another order or apart count in full.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces, text_of, written

SEED = 5
COVERAGE = 0.8
BLOCK_BYTES = 8 << 20  # of benchmark text sent to the executors at once
HITS = "doc_id long, item_id long, n_item_words long, n_covered long, n_tiles long, coverage double"


def words_of(text: str | bytes) -> list[bytes]:
    """Lower-case words between ASCII white space."""
    return (text if isinstance(text, bytes) else text.encode()).decode().lower().encode().split()


def tiles(doc: np.ndarray, item: np.ndarray, least: int = SEED) -> list[tuple[int, int, int]]:
    """(place in doc, place in item, length) of greedy string tiles; doc and item hold word ids, ids below 0 match nothing."""
    free_doc, free_item = doc >= 0, item >= 0
    found: list[tuple[int, int, int]] = []
    length = max(least, min(len(doc), len(item)))
    while length >= least and len(item) >= length:
        longest, matches = _matches(doc, item, free_doc, free_item, length)
        if longest > 2 * length:  # longer than looked for: start again from there
            length = longest
            continue
        for n in sorted(matches, reverse=True):
            for d, i in matches[n]:
                if free_doc[d : d + n].all() and free_item[i : i + n].all():
                    free_doc[d : d + n] = free_item[i : i + n] = False
                    found.append((d, i, n))
        if matches and _matches(doc, item, free_doc, free_item, length)[1]:
            continue  # what another tile has left of a match may be long enough still
        if length == least:
            break
        length = max(least, length // 2)
    return found


def _hashes(row: np.ndarray, free: np.ndarray, length: int) -> dict[int, list[int]]:
    """Places of each Karp-Rabin hash of length free words."""
    out: dict[int, list[int]] = defaultdict(list)
    if len(row) < length:
        return out
    mod, base = (1 << 61) - 1, 1_000_003
    power = pow(base, length - 1, mod)
    own, value, run = row.tolist(), 0, 0
    ok = free.tolist()
    for k, x in enumerate(own):
        if run >= length:
            value -= own[k - length] * power
        value = (value * base + x) % mod
        if not ok[k]:
            value = run = 0
            continue
        run += 1
        if run == 1:
            value = x % mod
        if run >= length:
            out[value].append(k - length + 1)
    return out


def _matches(doc: np.ndarray, item: np.ndarray, free_doc: np.ndarray, free_item: np.ndarray, length: int) -> tuple[int, dict[int, list[tuple[int, int]]]]:
    """The longest match, and maximal matches of length free words or more by their length."""
    known = _hashes(item, free_item, length)
    out: dict[int, list[tuple[int, int]]] = defaultdict(list)
    longest = 0
    if not known:
        return 0, out
    for value, places in _hashes(doc, free_doc, length).items():
        for i in known.get(value, ()):
            for d in places:
                if not np.array_equal(doc[d : d + length], item[i : i + length]):
                    continue
                if d and i and free_doc[d - 1] and free_item[i - 1] and doc[d - 1] == item[i - 1]:
                    continue  # part of a match that begins further left
                n = length
                while d + n < len(doc) and i + n < len(item) and free_doc[d + n] and free_item[i + n] and doc[d + n] == item[i + n]:
                    n += 1
                out[n].append((d, i))
                longest = max(longest, n)
    return longest, out


class Seeds:
    """A block of benchmark items with the index of their seeds."""

    def __init__(self, items: list[tuple[int | None, str]], seed: int = SEED):
        self.seed, self.ids = seed, {}
        self.items = [(item_id, np.array([self.ids.setdefault(w, len(self.ids)) for w in words_of(text)], np.int64)) for item_id, text in items]
        by: dict[int, set[int]] = defaultdict(set)
        for k, (_, row) in enumerate(self.items):
            for h in self._grams(row).tolist():
                by[h].add(k)
        self.known = np.array(sorted(by), np.uint64)
        self.by = {h: sorted(ks) for h, ks in by.items()}
        self.short = defaultdict(list)  # items shorter than a seed match as a whole
        for k, (_, row) in enumerate(self.items):
            if 0 < len(row) < seed:
                self.short[len(row)].append(k)

    def _grams(self, row: np.ndarray) -> np.ndarray:
        if len(row) < self.seed:
            return np.zeros(0, np.uint64)
        out = np.zeros(len(row) - self.seed + 1, np.uint64)
        for k in range(self.seed):
            out = (out ^ row[k : k + len(out)].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return out

    def pairs(self, row: np.ndarray) -> set[int]:
        """Items that share a seed (a short item: all its words, in one piece) with a document's word ids."""
        out: set[int] = set()
        if len(row) >= self.seed and len(self.known):
            inside = row >= 0
            full = np.ones(len(row) - self.seed + 1, bool)
            for k in range(self.seed):
                full &= inside[k : k + len(full)]
            if full.any():
                grams = self._grams(row)[full]
                spot = np.minimum(np.searchsorted(self.known, grams), len(self.known) - 1)
                for h in set(grams[self.known[spot] == grams].tolist()):
                    out.update(self.by[h])
        for n, ks in self.short.items():
            for k in ks:
                want = self.items[k][1]
                if len(row) >= n and any(np.array_equal(row[p : p + n], want) for p in np.flatnonzero(row[: len(row) - n + 1] == want[0])):
                    out.add(k)
        return out

    def hits(self, text: bytes, coverage: float) -> list[tuple]:
        """(item_id, words, covered, tiles, coverage) of items covered to the threshold or beyond."""
        get = self.ids.get
        row = np.array([get(w, -1) for w in words_of(text)], np.int64)
        out = []
        for k in sorted(self.pairs(row)):
            item_id, item = self.items[k]
            found = tiles(row, item, min(self.seed, len(item)))
            covered = sum(n for _, _, n in found)
            if covered >= coverage * len(item):
                out.append((item_id, len(item), covered, len(found), covered / len(item)))
        return out


def blocks(benchmark: DataFrame, limit: int = BLOCK_BYTES) -> Iterator[list[tuple[int | None, str]]]:
    """Items (item_id, text) in blocks of about limit bytes of text, one partition of the benchmark at a time on the driver. Items without words are left out, repeated rows are one item."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct().orderBy("item_id", "text")
    block, size = [], 0
    for row in rows.toLocalIterator():
        if row.text.split():
            if block and size + len(row.text) > limit:
                yield block
                block, size = [], 0
            block.append((row.item_id, row.text))
            size += len(row.text)
    if block:
        yield block


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, seed: int = SEED) -> DataFrame:
    """A row for each document (doc_id, text) and item (item_id, text) whose words are covered to the threshold: doc_id, item_id, n_item_words, n_covered, n_tiles, coverage.

    Words are compared in lower case. Null and empty texts hit nothing, an item of fewer than seed words must occur in
    one piece, repeated documents are reported each, an empty benchmark or no documents give no rows; other columns
    are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    out = rows.sparkSession.createDataFrame([], HITS)
    for block, last in _last_told(blocks(benchmark)):
        told = rows.sparkSession.sparkContext.broadcast(block)
        found = rows.mapInArrow(_search(told, coverage, seed), HITS)
        if not last:  # one block is with the executors at a time
            found = written(found, "hits")
            told.destroy()
        out = out.unionAll(found)
    return out


def _last_told(items: Iterable) -> Iterator[tuple]:
    """(item, whether it is the last)."""
    held: list = []
    for item in items:
        if held:
            yield held.pop(), False
        held.append(item)
    for item in held:
        yield item, True


def _search(told, coverage: float, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = Seeds(told.value, seed)
        for batch in pieces(batches, "text"):
            out = [(doc_id, *hit) for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"]) for hit in seeds.hits(text.as_buffer().to_pybytes(), coverage)]
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)], names=[x.split(" ")[0] for x in HITS.split(", ")])

    return run


def clean(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, seed: int = SEED) -> DataFrame:
    """The rows of docs, with all columns, that hit no item of the benchmark. Rows pass through in place, without a shuffle; between blocks of a large benchmark they are written. Null and empty texts stay; repeated rows are judged each; an empty benchmark removes nothing."""
    out = docs
    for block, last in _last_told(blocks(benchmark)):
        told = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], told=told) -> Iterator[pa.RecordBatch]:
            seeds = Seeds(told.value, seed)
            for batch in batches:
                yield batch.filter(pa.array([not (text.is_valid and seeds.hits(text.as_buffer().to_pybytes(), coverage)) for text in batch["text"]], pa.bool_()))

        out = out.mapInArrow(run, docs.schema)
        if not last:  # one block is with the executors at a time
            out = written(out, "clean")
            told.destroy()
    return out


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
