"""SimHash near-duplicates by tiled exact comparison: of fingerprints within a radius, and of texts by word shingles.

Fingerprints are compared exactly: distinct fingerprints go to tiles by the population counts of their four 16-bit
quarters. Two fingerprints within the radius differ by no more than the radius in the sum of those counts'
differences, so only tile pairs within that distance are compared (numpy exclusive-or and bit counts); all others are
skipped. A fingerprint is sent to a fixed number of tiles, whatever the size of the input. A pair of tiles yields a
spanning forest of its links, never all pairs.

similar_rows finds texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more: fingerprints of 256
bits are compared in tiles at a wide radius, sizes too far apart are skipped, and each pair found is verified on the
whole sets in the task that compares the tile, which passes on a forest of links, never all pairs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, pieces, relieved, text_of, written

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SEED = 42
QUARTERS = 4
TILE = 4096  # fingerprints to a tile; a fuller cell makes several tiles
SHINGLE = 5
SHARE = (4, 5)  # the least similarity as a fraction, so that it is compared in whole numbers
WORDS = 4  # 64-bit words of a wide fingerprint
#: Differing bits of the first half and of all bits; sets at 0.8 differ in 15 % of the bits (a deviation of 4.1 of 128, of 5.7 of 256), unrelated ones in half. Sets of fewer than SMALL shingles differ more unevenly and are verified by the first half alone.
REACH, FULL, SMALL = 40, 62, 16
TILE_ROWS, TILE_BYTES = 16_384, 32 << 20  # of sketches, and of sets, that a task holds


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """XXH64 of each word shingle, repeats included; a shorter text is one shingle, one without words none."""
    words = WORD.findall(text.lower())  # bytes.lower() touches A-Z alone
    if not words:
        return np.zeros(0, "<u8")
    flat, ends, at = b" ".join(words), [], 0
    for w in words:
        at += len(w)
        ends.append(at)
        at += 1
    starts = [0, *[e + 1 for e in ends[:-1]]]
    digest = xxhash.xxh64_intdigest
    last = ends[shingle - 1 :] or ends[-1:]
    return np.array([digest(flat[s:e], SEED) for s, e in zip(starts, last)], dtype="<u8")


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """Majority bits of the XXH64 of each word shingle, repeats included; no words: 0."""
    hashes = shingle_hashes(text, shingle)
    if not len(hashes):
        return 0
    return _majority(hashes)


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, fp) of each row; fp is the fingerprint as a signed 64-bit number. Null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            fps = np.array([fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", shingle) for t in batch["text"]], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(relieved(run), "doc_id long, fp long")


def _cell(counts: np.ndarray) -> np.ndarray:
    cell = counts[:, 0].astype(np.int64)
    for k in range(1, QUARTERS):
        cell = cell * 32 + counts[:, k]
    return cell


def _near_cells(radius: int) -> list[int]:
    """Offsets between cells that aren't skipped, one of each pair of opposite ones; quarters' counts go from 0 to 16."""
    out = []
    for step in product(range(-radius, radius + 1), repeat=QUARTERS):
        if sum(map(abs, step)) <= radius and step >= (0,) * QUARTERS:
            shift = 0
            for x in step:
                shift = shift * 32 + x
            out.append(shift)
    return out


def forest(a: np.ndarray, b: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of the fingerprints of tiles a and b that differ in radius bits at most."""
    links: list[tuple[int, int]] = []
    top: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := top.get(root, root)) != root:
            root = up
        while x != root:
            top[x], x = root, top.get(x, x)
        return root

    step = max(1, (1 << 20) // max(1, len(b)))
    for k in range(0, len(a), step):
        rows, cols = np.nonzero(np.bitwise_count(a[k : k + step, None] ^ b[None, :]) <= radius)
        for x, y in zip(a[k : k + step][rows].tolist(), b[cols].tolist()):
            if x != y and (p := find(x)) != (q := find(y)):
                top[p] = q
                links.append((x, y))
    return links


def near_links(fps: DataFrame, radius: int = 4) -> DataFrame:
    """Links (a, b) between distinct fingerprints fp that keep all that are connected within radius connected."""
    offsets = _near_cells(radius)

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[int]] = {}

        def out(cell: int) -> pa.RecordBatch:
            blob = np.array(held.pop(cell), dtype=np.int64).tobytes()
            return pa.RecordBatch.from_arrays([pa.array([cell], pa.int64()), pa.array([blob], pa.binary())], names=["cell", "blob"])

        for batch in batches:
            fp = np.asarray(batch["fp"], dtype=np.int64)
            counts = np.bitwise_count(fp.view(np.uint16).reshape(-1, 4)) if len(fp) else np.zeros((0, 4), np.uint8)
            for cell, x in zip(_cell(counts).tolist(), fp.tolist()):
                own = held.setdefault(cell, [])
                own.append(x)
                if len(own) >= TILE:
                    yield out(cell)
        yield from [out(cell) for cell in list(held)]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links = []
            for x, y in zip(batch["blob"], batch["other"]):
                links += forest(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), radius)
            if links:
                ends = np.array(links, dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0].copy()), pa.array(ends[:, 1].copy())], names=["a", "b"])

    distinct = fps.select("fp").where("fp is not null").distinct()
    quarter = lambda k: F.bit_count(F.shiftrightunsigned("fp", 16 * k).bitwiseAND(0xFFFF)).cast("long")
    cell = ((quarter(0) * 32 + quarter(1)) * 32 + quarter(2)) * 32 + quarter(3)
    spread = distinct.repartition(cell).mapInArrow(tiles, "cell long, blob binary")
    tiled = written(spread, "tiles")
    near = tiled.select(F.explode(F.array(*[F.col("cell") + x for x in offsets])).alias("cell"), "blob")
    pairs = near.join(tiled.select("cell", F.col("blob").alias("other")).hint("shuffle_hash"), "cell").select("blob", "other")
    return pairs.mapInArrow(compare, "a long, b long")


def shingle_set(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """The set of a text's shingles, sorted; texts without words have one shingle of no words."""
    own = np.unique(shingle_hashes(text, shingle))
    return own if len(own) else np.zeros(1, "<u8")


def _majority(hashes: np.ndarray) -> int:
    bits = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        bits += np.unpackbits(hashes[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(bits * 2 > len(hashes), bitorder="little").view("<u8")[0])


def wide_fingerprint(own: np.ndarray) -> np.ndarray:
    """WORDS times 64 majority bits of a set of shingle hashes, each of another mix of them."""
    out = []
    for k in range(WORDS):
        x = own * np.uint64(0x9E3779B97F4A7C15 + 2 * k)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        out.append(_majority(x ^ (x >> np.uint64(32))))
    return np.array(out, np.uint64)


def _by_set(rows: DataFrame, function, schema: str) -> DataFrame:
    """function's columns after row, from a piece's list of shingle sets."""
    names = [x.split(" ")[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch["row"], *function([shingle_set(t.as_buffer().to_pybytes()) for t in batch["text"]])], names=names)

    return rows.mapInArrow(relieved(run), schema)


def _sketched(sets: list[np.ndarray]) -> list[pa.Array]:
    return [pa.array([len(x) for x in sets], pa.int64()), pa.array([wide_fingerprint(x).tobytes() for x in sets], pa.binary())]


def _sketches(rows: DataFrame) -> DataFrame:
    """(row, n, sketch): the size of each row's set and its fingerprint."""
    return _by_set(rows, _sketched, "row long, n long, sketch binary")


def _with_sets(rows: DataFrame) -> DataFrame:
    """(row, n, sketch, own): also the set."""
    return _by_set(rows, lambda sets: [*_sketched(sets), pa.array([x.tobytes() for x in sets], pa.binary())], "row long, n long, sketch binary, own binary")


def _met(rows: DataFrame, weight, most: int) -> DataFrame:
    """rows (n and more) dealt to tiles: c, t, side and the row's columns. Of a tile's task, rows of side 0 are its own, rows of side 1 are all others that they must meet.

    Sizes fall in classes of a ratio of SHARE, so that similar sets are in one class or two neighbouring ones. A class is
    dealt to tiles of about most weight; a tile meets the later tiles of its class and all of the next.
    """
    ratio = float(np.log(SHARE[1] / SHARE[0]))
    columns = rows.columns
    classed = rows.withColumn("_c", F.floor(F.log("n") / ratio + 1e-9).cast("int"))
    sizes = {r["_c"]: max(1, -(-int(r.w) // most)) for r in classed.groupBy("_c").agg(F.sum(weight).alias("w")).collect()}  # a hundred classes at most
    told = F.create_map(*[F.lit(x) for pair in (sizes or {0: 1}).items() for x in pair])
    tiles = lambda c: F.coalesce(F.try_element_at(told, c), F.lit(0))
    place = classed.withColumn("_t", F.pmod(F.xxhash64("row"), tiles(F.col("_c"))).cast("int"))
    spot = lambda c, t, side: F.struct(c.alias("c"), t.cast("int").alias("t"), F.lit(side).alias("side"))
    every = lambda c, n: F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda k: spot(c, k, 1))).otherwise(F.array().cast("array<struct<c:int,t:int,side:int>>"))
    goes = F.concat(F.array(spot(F.col("_c"), F.col("_t"), 0)), every(F.col("_c"), F.col("_t")), every(F.col("_c") - 1, tiles(F.col("_c") - 1)))
    spread = place.select(F.explode(goes).alias("_p"), *columns).select("_p.c", "_p.t", "_p.side", *columns)
    return spread.repartition("c", "t").sortWithinPartitions("c", "t", "side", "row")


class Sketches:
    """Rows of a tile as arrays."""

    def __init__(self, row: np.ndarray, n: np.ndarray, bits: np.ndarray, own: list[np.ndarray] | None):
        self.row, self.n, self.bits, self.own = row, n, bits, own

    @classmethod
    def of(cls, batch: pa.RecordBatch) -> Sketches:
        bits = np.frombuffer(b"".join(batch["sketch"].to_pylist()), np.uint64).reshape(-1, WORDS)
        own = [np.frombuffer(x.as_buffer(), np.uint64) for x in batch["own"]] if "own" in batch.schema.names else None
        return cls(np.asarray(batch["row"], np.int64), np.asarray(batch["n"], np.int64), bits, own)

    @classmethod
    def joined(cls, parts: list[Sketches]) -> Sketches:
        own = None if parts[0].own is None else [x for p in parts for x in p.own]
        return cls(*(np.concatenate([getattr(p, k) for p in parts]) for k in ("row", "n", "bits")), own)

    def near(self, other: Sketches, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places in self and in other of pairs within reach whose sizes fit; each pair once."""
        step = max(1, (1 << 19) // max(1, len(other.row)))
        half = WORDS // 2
        for k in range(0, len(self.row), step):
            mine = self.bits[k : k + step]
            off = sum(np.bitwise_count(mine[:, w, None] ^ other.bits[:, w]) for w in range(half))
            a, b = np.nonzero(off <= REACH)
            a += k
            if same:
                a, b = a[a < b], b[a < b]
            if not len(a):
                continue
            least, most = np.minimum(self.n[a], other.n[b]), np.maximum(self.n[a], other.n[b])
            fits = least * SHARE[1] >= most * SHARE[0]
            a, b, least = a[fits], b[fits], least[fits]
            full = np.bitwise_count(self.bits[a] ^ other.bits[b]).sum(axis=1)
            close = (full <= FULL) | (least < SMALL)
            yield a[close], b[close]


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int, int], Sketches]]:
    """((c, t, side), rows) in the order in which they come."""
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([np.asarray(batch[k], np.int64) for k in ("c", "t", "side")], axis=1)
        cut = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
        for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(key)]):
            yield tuple(key[a].tolist()), Sketches.of(batch.slice(a, b - a))


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Sketches, Sketches, bool]]:
    """(tile, rows that it meets, whether these are the tile itself)."""
    last, held, tile = None, [], None
    for (c, t, side), rows in _streamed(batches):
        if side == 0:
            if (c, t) != last:
                if held:
                    tile = Sketches.joined(held)
                    yield tile, tile, True
                last, held = (c, t), []
            held.append(rows)
            continue
        if (c, t) != last:  # a tile without rows of its own meets nothing
            if held:
                tile = Sketches.joined(held)
                yield tile, tile, True
            last, held, tile = (c, t), [], None
        if held:
            tile, held = Sketches.joined(held), []
            yield tile, tile, True
        if tile is not None:
            yield tile, rows, False
    if held:
        tile = Sketches.joined(held)
        yield tile, tile, True


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted sets have a Jaccard similarity of SHARE or more."""
    both = np.concatenate([x, y])
    both.sort()
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return shared * SHARE[1] >= (len(both) - shared) * SHARE[0]


def similar_rows(rows: DataFrame) -> DataFrame:
    """Components of rows (row, text): (node, component) of each row that verified pairs link to another.

    row is a key of rows without nulls, component the least of those linked. Null and empty texts and those of white
    space have one shingle of no words and are each other's copies; texts of fewer than SHINGLE words are one shingle.
    No rows give no rows.
    """
    rows = rows.select("row", text_of().alias("text"))

    def involved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows with any partner within reach."""
        for tile, other, same in _tiles(batches):
            mine, theirs = np.zeros(len(tile.row), bool), np.zeros(len(other.row), bool)
            for a, b in tile.near(other, same):
                mine[a] = theirs[b] = True
            found = np.concatenate([tile.row[mine], other.row[theirs]])
            if len(found):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(found))], names=["row"])

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A forest of verified pairs of each tile with what it meets."""
        top: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := top.get(x, x)) != x:
                top[x] = top.get(up, up)
                x = up
            return x

        last = None
        for tile, other, same in _tiles(batches):
            if tile is not last:
                top.clear()
                last = tile
            links = []
            for at_a, at_b in tile.near(other, same):
                for i, j in zip(at_a.tolist(), at_b.tolist()):
                    a, b = int(tile.row[i]), int(other.row[j])
                    if (x := find(a)) != (y := find(b)) and similar(tile.own[i], other.own[j]):
                        top[x] = y
                        links.append((a, b))
            if links:
                ends = np.array(links, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0].copy()), pa.array(ends[:, 1].copy())], names=["a", "b"])

    sketches = _sketches(rows)
    some = written(_met(written(sketches, "sketches"), F.lit(1), TILE_ROWS).mapInArrow(relieved(involved), "row long").distinct(), "involved")
    sets = written(_with_sets(rows.join(some, "row", "left_semi")), "sets")
    return components(written(_met(sets, 8 * F.col("n") + 100, TILE_BYTES).mapInArrow(relieved(linked), "a long, b long"), "near"))


def simhash_groups(docs: DataFrame, radius: int = 4, shingle: int = 4) -> DataFrame:
    """doc_id, fingerprint, component_id of every row of docs (doc_id, text).

    component_id is the least doc_id that links of radius bits or less reach. Null and empty texts have fingerprint 0
    and link like any other. Equal rows get equal results; a null doc_id is never a component's id, unless all are
    null. No rows give no rows; other columns are ignored.
    """
    each = written(fingerprints(docs, shingle), "fingerprints")
    node = written(each.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    part = components(written(near_links(node, radius), "near"))
    named = node.join(part, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    found = each.join(written(named.join(least, "component").select("fp", "component_id"), "components"), "fp")
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
