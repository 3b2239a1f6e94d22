"""Removal of byte strings that occur elsewhere, by a logarithmic family of suffix arrays.

Segments that may share long strings arrive in batches. A batch gets a suffix array; the array is merge-scanned against
every level of the family, which finds each suffix whose first `length` bytes are in both; then it joins the family
as a level of its own, and levels of about equal size merge into one of twice the size, as binary numbers carry.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .repeats import Shape, repeated

LENGTH = 400
BATCH = 16  # segments to a batch
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


class SuffixFamily:
    """Suffixes of at least `length` bytes of all segments added so far, in levels of sorted (segment, place)."""

    def __init__(self, length: int):
        self.length = length
        self.segments: list[bytes] = []
        self.flags: list[np.ndarray] = []
        self.levels: list[list[tuple[int, int]]] = []

    def _head(self, suffix: tuple[int, int]) -> bytes:
        return self.segments[suffix[0]][suffix[1] : suffix[1] + self.length]

    def _flag(self, *suffixes: tuple[int, int]) -> None:
        for k, at in suffixes:
            self.flags[k][at] = 1

    def add(self, batch: Iterable[tuple[bytes, int]]) -> None:
        """Adds segments with weights: a segment of weight 2 or more repeats by itself."""
        fresh: list[tuple[int, int]] = []
        for seg, weight in batch:
            windows = max(0, len(seg) - self.length + 1)
            self.segments.append(seg)
            self.flags.append(np.full(windows, int(weight > 1), np.int8))
            fresh += [(len(self.segments) - 1, at) for at in range(windows)]
        array = self._scan(sorted(fresh, key=self._head))
        for level in self.levels:
            self._merge_scan(array, level)
        self.levels.append(array)
        while len(self.levels) > 1 and len(self.levels[-2]) <= 2 * len(self.levels[-1]):
            top = self.levels.pop()
            self.levels[-1] = self._scan(sorted(self.levels[-1] + top, key=self._head))  # two sorted runs: a merge

    def _scan(self, array: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """Flags neighbours with equal heads and leaves one of each."""
        out: list[tuple[int, int]] = []
        last = None
        for suffix in array:
            head = self._head(suffix)
            if head == last:
                self._flag(out[-1], suffix)
            else:
                out.append(suffix)
                last = head
        return out

    def _merge_scan(self, new: list[tuple[int, int]], old: list[tuple[int, int]]) -> None:
        """Flags suffixes of two sorted arrays whose heads are equal."""
        if not new or not old:
            return
        j, other = 0, self._head(old[0])
        for suffix in new:
            head = self._head(suffix)
            while other < head:
                j += 1
                if j == len(old):
                    return
                other = self._head(old[j])
            if other == head:
                self._flag(suffix, old[j])


def match(segments: list[tuple[bytes, int]], length: int) -> list[np.ndarray]:
    family = SuffixFamily(length)
    for k in range(0, len(segments), BATCH):
        family.add(segments[k : k + BATCH])
    return family.flags


def _split(text: bytes) -> tuple[np.ndarray, bytes]:
    return np.frombuffer(text, np.uint8).astype(np.uint64), text


def _same(x: bytes) -> bytes:
    return x


def shape_of(length: int = LENGTH) -> Shape:
    gram = 1 << max(0, (max(1, length // 5)).bit_length() - 1)
    return Shape(length=length, gram=min(64, gram), blocks=(16, 1), most=512, split=_split, count=len, join=_same, cut=_same)


def dedup_bytes(docs: DataFrame, length: int = LENGTH, texts: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of docs (doc_id, text); with texts also kept binary and spans (first, behind-last byte).

    A byte is removed when a string of length bytes that covers it also starts anywhere else in the texts (UTF-8), in
    the same one included; strings never cross documents and are judged on the input. Null text is empty and has no
    spans; repeated rows are documents of their own, each other's copies; no rows give no rows; other columns are ignored.
    """

    def apply(doc_ids: list, raw: list[bytes], masks: list) -> pa.RecordBatch:
        rows = []
        for text, mask in zip(raw, masks):
            kept, edge = text, np.zeros(0, np.int64)
            if mask is not None:
                kept = np.frombuffer(text, np.uint8)[~mask].tobytes()
                edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
            rows.append((len(text), len(text) - len(kept), len(edge) // 2, hashlib.sha256(kept).hexdigest(), kept, edge.reshape(-1, 2).tolist()))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.list_(pa.int64())))[: 4 + 2 * texts]
        arrays = [pa.array(doc_ids, pa.int64()), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))]
        return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"][: len(arrays)])

    return repeated(docs, shape_of(length), match, apply, SCHEMA + ", kept binary, spans array<array<long>>" * texts)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
