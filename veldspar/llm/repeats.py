"""Finds windows of consecutive symbols that occur more than once in a corpus, exactly and without a hot task.

Symbols are bytes or words. Of each window of `length` symbols the k-gram with the least hash is its anchor, so equal
windows have equal anchors at equal places. Anchors, a few per cent of all places, are counted over the corpus; only
around repeated ones are segments cut: the symbols of all neighbouring windows that share an anchor. Segments with the
same anchor form a group, equal segments are one with a weight, and a matcher (suffix arrays or suffix automata)
compares a group's segments symbol by symbol. A group with more than `most` different segments is dealt anew by the
longer core that windows at neighbouring offsets of the anchor share, and last by whole windows, so that a passage in a
third of all documents is never gathered in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, text_of, written

LOW = np.uint64(0xFFFFFFFF)
#: A unit is a segment of a group: its group's key, digest, offset of the first window before the anchor, symbols.
UNIT = "key long, dg binary, off int, seg binary"


@dataclass(frozen=True)
class Shape:
    """What counts as a repeat. split gives a text's symbols as (hashes, list or bytes of symbols), count how many they are; join packs a slice of them and cut takes a packed slice apart again."""

    length: int
    gram: int
    blocks: tuple[int, ...]
    most: int
    split: Callable[[bytes], tuple[np.ndarray, object]]
    count: Callable[[bytes], int]
    join: Callable[[object], bytes]
    cut: Callable[[bytes], object]

    @property
    def reach(self) -> int:
        return self.length - self.gram + 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def grams(symbols: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k-gram, k a power of two."""
    out, step = _mix(symbols), 1
    while step < k:
        out = _mix(out[:-step] * np.uint64(0x9E3779B97F4A7C15) + out[step:])
        step *= 2
    return out


def least_of(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each window of width values."""
    out, span = values, 1
    while span * 2 <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    rest = width - span
    return np.minimum(out[:-rest], out[rest:]) if rest else out


def anchors(symbols: np.ndarray, sizes: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place of the anchor, first window, last window, the anchor's hash) of each run of windows with one anchor, over documents of the given sizes laid end to end."""
    none = np.zeros(0, np.int64)
    if len(symbols) < shape.length:
        return none, none, none, none
    own = grams(symbols, shape.gram)
    least = least_of((own & ~LOW) | np.arange(len(own), dtype=np.uint64), shape.reach)
    ends = np.repeat(np.cumsum(sizes), sizes)[: len(least)]
    first = np.flatnonzero(np.arange(len(least)) + shape.length <= ends)
    if not len(first):
        return none, none, none, none
    at = (least[first] & LOW).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (first[1:] != first[:-1] + 1)]))
    last = np.append(new[1:], len(first)) - 1
    return at[new], first[new], first[last], own[at[new]].view(np.int64)


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id and text with a key (d, t) of the row; rows that share it are equal."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.select("doc_id", "text", F.coalesce("doc_id", F.lit(-(2**63))).alias("d"), F.xxhash64("text").alias("t"))


def _counted(rows: DataFrame, shape: Shape) -> DataFrame:
    """(d, t, h, n): the anchors of each row and how often it has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 600_000):
            symbols = [shape.split(x.as_buffer().to_pybytes())[0] for x in batch["text"]]
            sizes = np.array([len(s) for s in symbols], np.int64)
            at, _, _, h = anchors(np.concatenate(symbols), sizes, shape)
            if not len(at):
                continue
            doc = np.searchsorted(np.cumsum(sizes), at, "right")
            order = np.lexsort((h, doc))
            doc, h = doc[order], h[order]
            new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])]))
            take = pa.array(doc[new])
            n = np.diff(np.append(new, len(h))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch["d"].take(take), batch["t"].take(take), pa.array(h[new]), pa.array(n)], names=["d", "t", "h", "n"])

    return rows.select("d", "t", "text").mapInArrow(run, "d long, t long, h long, n int")


def _packed(rows: DataFrame) -> DataFrame:
    """Rows with their text compressed, for the shuffles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in pieces(batches, "text"):
            z = pa.array([press.compress(x.as_buffer()) for x in batch["text"]], pa.binary())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["d"], batch["t"], z], names=["doc_id", "d", "t", "z"])

    return rows.mapInArrow(run, "doc_id long, d long, t long, z binary")


def _digest(key: int, off: int, seg: bytes) -> bytes:
    return hashlib.blake2b(seg, digest_size=16, key=key.to_bytes(8, "little", signed=True) + off.to_bytes(4, "little")).digest()


def _occurrences(found: DataFrame, shape: Shape) -> DataFrame:
    """(d, t, a, key, dg, off, seg): the segments around repeated anchors hs of rows (d, t, z, hs). A task gives the symbols of a segment once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        unpress = zstandard.ZstdDecompressor()
        held, size = [], 0

        def out(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], t) for k, t in enumerate(kinds)], names=["d", "t", "a", "key", "dg", "off", "seg"])

        for batch in batches:
            for d, t, z, hs in zip(batch["d"].to_pylist(), batch["t"].to_pylist(), batch["z"], batch["hs"]):
                hashes, symbols = shape.split(unpress.decompress(z.as_buffer()))
                at, first, last, h = anchors(hashes, np.array([len(hashes)]), shape)
                wanted = np.isin(h, hs.values.to_numpy(zero_copy_only=False))
                for p, a, b, key in zip(at[wanted].tolist(), first[wanted].tolist(), last[wanted].tolist(), h[wanted].tolist()):
                    seg = shape.join(symbols[a : b + shape.length])
                    dg = _digest(key, p - a, seg)
                    if dg in seen:
                        seg = None
                    else:
                        if len(seen) > 400_000:
                            seen.clear()
                        seen.add(dg)
                        size += len(seg)
                    held.append((d, t, a, key, dg, p - a, seg))
                    if size > 2_000_000 or len(held) > 20_000:
                        yield out(held)
                        held, size = [], 0
        if held:
            yield out(held)

    return found.mapInArrow(run, "d long, t long, a int, key long, dg binary, off int, seg binary")


def _children(units: DataFrame, shape: Shape, block: int) -> DataFrame:
    """Units of at most block neighbouring offsets, keyed by the core that windows at those offsets share: (parent, at, key, dg, off, seg, n)."""
    length = shape.length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0

            def out() -> pa.RecordBatch:
                kinds = (pa.binary(), pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.int64())
                return pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], t) for k, t in enumerate(kinds)], names=["parent", "at", "key", "dg", "off", "seg", "n"])

            for key, dg, off, seg, n in zip(*(batch[c].to_pylist() for c in ("key", "dg", "off", "seg", "n"))):
                symbols = shape.cut(seg)
                windows = len(symbols) - length + 1
                start = 0
                while start < windows:  # window start + i has offset off - i
                    low = (off - start) // block * block
                    stop = min(windows, off - low + 1)
                    anchor = off
                    core = shape.join(symbols[anchor - low : anchor - (low + block - 1) + length])
                    own = shape.join(symbols[start : stop - 1 + length])
                    deeper = xxhash.xxh64_intdigest(core, (key + low) & 0xFFFFFFFFFFFFFFFF)
                    deeper -= (deeper >> 63) << 64
                    rows.append((dg, start, deeper, _digest(deeper, off - start, own), off - start, own, n))
                    size += len(own)
                    start = stop
                    if size > 2_000_000:
                        yield out()
                        rows, size = [], 0
            if rows:
                yield out()

    return units.mapInArrow(run, "parent binary, at int, key long, dg binary, off int, seg binary, n long")


def _matched(units: DataFrame, matcher: Callable, shape: Shape) -> DataFrame:
    """(dg, runs): for units (key, dg, off, seg, n) with repeated windows, pairs of int32 first and behind-last window in the segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(group: list[tuple]) -> list[tuple]:
            found = []
            if len(group) == 1:  # one segment only: all its windows occur as often as it does
                dg, seg, n = group[0]
                return [(dg, np.array([0, len(shape.cut(seg)) - shape.length + 1], np.int32).tobytes())] if n > 1 else []
            for (dg, _, _), flags in zip(group, matcher([(shape.cut(seg), n) for _, seg, n in group], shape.length)):
                edge = np.flatnonzero(np.diff(np.concatenate([[0], flags, [0]])))
                if len(edge):
                    found.append((dg, edge.astype(np.int32).tobytes()))
            return found

        last, group, done = None, [], []
        for batch in batches:
            for key, dg, seg, n in zip(*(batch[c].to_pylist() for c in ("key", "dg", "seg", "n"))):
                if key != last:
                    if group:
                        done += close(group)
                    last, group = key, []
                group.append((dg, seg, n))
            if len(done) > 5000:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.binary()), pa.array([x[1] for x in done], pa.binary())], names=["dg", "runs"])
                done = []
        if group:
            done += close(group)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.binary()), pa.array([x[1] for x in done], pa.binary())], names=["dg", "runs"])

    return units.select("key", "dg", "seg", "n").repartition("key").sortWithinPartitions("key", "dg").mapInArrow(run, "dg binary, runs binary")


def _resolved(units: DataFrame, matcher: Callable, shape: Shape, level: int = 0) -> DataFrame:
    """(dg, parts) of the units with repeated windows, a row for each: runs of windows, counted from at; hot groups by the units of the next level."""
    units = written(units, "units")
    whole = F.array(F.struct(F.lit(0).alias("at"), F.col("runs"))).alias("parts")
    if level == len(shape.blocks):
        return _matched(units, matcher, shape).select("dg", whole)
    hot = written(units.groupBy("key").count().where(F.col("count") > shape.most).select("key"), "hot")
    if hot.isEmpty():
        return _matched(units, matcher, shape).select("dg", whole)
    few = _matched(units.join(hot, "key", "left_anti"), matcher, shape).select("dg", whole)
    many = written(_children(units.join(hot, "key", "left_semi"), shape, shape.blocks[level]), "children")
    below = _resolved(_united(many, F.sum("n")), matcher, shape, level + 1)
    up = many.select("parent", F.col("at").alias("from"), "dg").join(below, "dg")
    moved = up.select("parent", F.transform("parts", lambda x: F.struct((x["at"] + F.col("from")).alias("at"), x["runs"].alias("runs"))).alias("parts"))
    return few.union(moved.groupBy(F.col("parent").alias("dg")).agg(F.flatten(F.collect_list("parts")).alias("parts")))


def _united(rows: DataFrame, count) -> DataFrame:
    return rows.groupBy("key", "dg", "off").agg(F.first("seg", ignorenulls=True).alias("seg"), count.alias("n"))


def repeated(docs: DataFrame, shape: Shape, matcher: Callable, apply: Callable, schema: str) -> DataFrame:
    """apply's result for every row of docs (doc_id, text).

    apply(doc_ids, texts, masks) takes lists: ids, UTF-8 texts, and for each text None or a numpy mask of the symbols
    that a repeated window covers; it returns a record batch of schema. matcher(segments with weights, length) gives
    for each segment a 0/1 array of its windows that occur twice or more in all.
    """
    rows = _keyed(docs)
    marks = _counted(rows, shape)
    often = marks.groupBy("h").agg(F.sum("n").alias("total")).where("total > 1").select("h")
    found = marks.join(often.hint("merge"), "h").groupBy("d", "t").agg(F.collect_set("h").alias("hs"))
    packed = _packed(rows)
    spots = written(_occurrences(packed.select("d", "t", "z").join(found.hint("merge"), ["d", "t"]), shape), "occurrences")
    runs = _resolved(_united(spots, F.count("*")), matcher, shape)
    spans = spots.select("d", "t", "a", "dg").join(written(runs, "runs").hint("merge"), "dg")
    spans = spans.groupBy("d", "t").agg(F.collect_list(F.struct("a", "parts")).alias("spans"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor()
        for batch in pieces(batches, "z", 400_000):
            texts = [unpress.decompress(z.as_buffer()) for z in batch["z"]]
            masks: list[np.ndarray | None] = []
            for text, spans in zip(texts, batch["spans"].to_pylist()):
                if spans is None:
                    masks.append(None)
                    continue
                steps = np.zeros(shape.count(text) + 1, np.int32)
                for span in spans:
                    for part in span["parts"]:
                        edge = np.frombuffer(part["runs"], np.int32).astype(np.int64) + (span["a"] + part["at"])
                        np.add.at(steps, edge[::2], 1)
                        np.add.at(steps, edge[1::2] + shape.length - 1, -1)
                masks.append(np.cumsum(steps[:-1]) > 0)
            yield apply(batch["doc_id"].to_pylist(), texts, masks)

    return packed.join(spans.hint("merge"), ["d", "t"], "left").select("doc_id", "z", "spans").mapInArrow(finish, schema)
