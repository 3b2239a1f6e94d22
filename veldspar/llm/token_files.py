"""Token-id files compressed by Re-Pair grammars.

Documents are range-sorted by doc_id and encoded; each range writes files of about FILE_IDS ids. A file's ids are
compressed together: frequent adjacent pairs are replaced by nonterminals over and over, never across the end of a
document. The file holds the rules with the length each one expands to, so that any document, and any id in it, is
found and decoded without the rest.

Layout, little-endian: magic; u32 documents, u32 width of an id in bytes, u32 first nonterminal, u32 rules,
u64 length of the sequence; i64 doc_id, u8 whether it is null, u32 ids and u64 place in the sequence of each document;
left, right (width) and u32 expansion length of each rule; the sequence (width); u32 crc32 of all that.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bpe_automaton import byte_letters
from .common import pieces, text_of, work_path
from .files import Pending, whole

MAGIC = b"VSREPAIR"
FILE_IDS = 2_000_000
LEAST = 4  # occurrences of a pair that is worth a rule
MEMO_BYTES = 72 << 20  # of remembered pieces and of stretches; they are forgotten with the stage
MANIFEST = "file string, part int, roll int, documents long, ids long"
TABLE = "doc_id long, n_tokens long, ids_crc32 long"


def repair(ids: np.ndarray, ends: np.ndarray, base: int, top: int, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sequence, places of the documents' ends in it, rules as rows left, right).

    ids below base; nonterminals from base to top. ends: for each document the place behind its last id. A round counts
    all pairs of the sequence, takes those at least a sixteenth as frequent as the most frequent as rules and replaces them
    from left to right. Rounds go on until no pair occurs least times or the numbers of an id's width are used up.
    """
    seq = ids.astype(np.uint32)
    inner = np.ones(len(seq), bool)  # whether a pair may start here
    inner[ends[ends > 0] - 1] = False
    rules: list[np.ndarray] = []
    room, shift = top - base - 1, np.uint64(32) if top > 1 << 16 else np.uint32(16)
    while room > 0 and len(seq) > 1:
        pair = (seq[:-1].astype(np.uint64) if shift == 32 else seq[:-1]) << shift | seq[1:]
        pair[~inner[:-1]] = none = np.iinfo(pair.dtype).max  # no pair: ids stay below the last
        kinds = np.sort(pair)
        kinds = kinds[: np.searchsorted(kinds, none)]
        if not len(kinds):
            break
        first = np.flatnonzero(np.concatenate([[True], kinds[1:] != kinds[:-1]]))
        counts = np.diff(np.append(first, len(kinds)))
        often = np.flatnonzero(counts >= max(least, counts.max() // 16))
        if len(often) > room:
            often = often[np.argsort(-counts[often], kind="stable")[:room]]
        if not len(often):
            break
        chosen = kinds[first[often]]
        # a table by hash; of pairs that fall together the first stays, the others are counted again next round
        spot = _spot(chosen)
        _, own = np.unique(spot, return_index=True)
        own = np.sort(own)
        chosen, spot = chosen[own], spot[own]
        table = np.full(1 << 18, -1, np.int32)
        table[spot] = np.arange(len(chosen), dtype=np.int32)
        rule = table[_spot(pair)]
        hit = np.flatnonzero(rule >= 0)
        hit = hit[chosen[rule[hit]] == pair[hit]]
        run = np.concatenate([[True], hit[1:] != hit[:-1] + 1])
        start = hit[np.flatnonzero(run)][np.cumsum(run) - 1]
        hit = hit[(hit - start) % 2 == 0]  # of overlapping pairs every other one, from the left
        used = np.bincount(rule[hit], minlength=len(chosen)) > 0  # a pair may lie in the shade of others each time
        number = np.cumsum(used) - 1
        rules.append(np.stack([chosen >> shift, chosen & ((1 << int(shift)) - 1)], axis=1).astype(np.uint32)[used])
        seq[hit] = base + number[rule[hit]]
        stay = np.ones(len(seq), bool)
        stay[hit + 1] = False
        inner[hit] = inner[hit + 1]
        seq, inner = seq[stay], inner[stay]
        base, room = base + int(used.sum()), room - int(used.sum())
    places = np.flatnonzero(~inner) + 1
    return seq, places, np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)


def _spot(pair: np.ndarray) -> np.ndarray:
    if pair.dtype == np.uint32:
        return (pair * np.uint32(2654435761)) >> np.uint32(14)
    return ((pair * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(46)).astype(np.uint32)


def lengths(rules: np.ndarray, base: int) -> np.ndarray:
    """The length each rule expands to; a rule's sides are ids or earlier rules."""
    out = np.ones(len(rules), np.int64)
    for k, (x, y) in enumerate(rules.tolist()):
        out[k] = (out[x - base] if x >= base else 1) + (out[y - base] if y >= base else 1)
    return out


def expand(seq: np.ndarray, rules: np.ndarray, base: int) -> np.ndarray:
    """Ids of a stretch of the sequence."""
    flat, sizes = expansions(rules, base)
    return _expand(seq, flat, sizes, base)


def expansions(rules: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids that each rule stands for, end to end, and how many each has."""
    each: list[list[int]] = []
    for x, y in rules.tolist():
        each.append((each[x - base] if x >= base else [x]) + (each[y - base] if y >= base else [y]))
    sizes = np.array([len(e) for e in each], np.int64)
    return np.array([i for e in each for i in e], np.int32), sizes


def _expand(seq: np.ndarray, flat: np.ndarray, sizes: np.ndarray, base: int) -> np.ndarray:
    seq = seq.astype(np.int64)
    rule = np.flatnonzero(seq >= base)
    if not len(rule):
        return seq
    own = seq[rule] - base
    grown = np.ones(len(seq), np.int64)
    grown[rule] = sizes[own]
    ends = np.cumsum(grown)
    out = np.repeat(seq, grown)
    long = sizes[own]
    first = np.cumsum(long) - long
    within = np.arange(int(long.sum())) - np.repeat(first, long)
    out[np.repeat(ends[rule] - long, long) + within] = flat[np.repeat((np.cumsum(sizes) - sizes)[own], long) + within]
    return out


def pack(doc_ids: list, parts: list[bytes], width: int, base: int) -> tuple[bytes, int]:
    """A file of the documents whose ids parts holds, and the number of ids. Each document has one id at least."""
    kind = np.dtype("<u2" if width == 2 else "<u4")
    ids = np.frombuffer(b"".join(parts), kind)
    counts = np.array([len(p) // width for p in parts], np.int64)
    seq, places, rules = repair(ids, np.cumsum(counts), base, 1 << 16 if width == 2 else 1 << 31)
    starts = np.concatenate([[0], places[:-1]]).astype("<u8")
    data = b"".join([
        MAGIC, struct.pack("<IIIIQ", len(parts), width, base, len(rules), len(seq)),
        np.array([x or 0 for x in doc_ids], "<i8").tobytes(), bytes(x is None for x in doc_ids), counts.astype("<u4").tobytes(), starts.tobytes(),
        rules[:, 0].astype(kind).tobytes(), rules[:, 1].astype(kind).tobytes(), lengths(rules, base).astype("<u4").tobytes(), seq.astype(kind).tobytes(),
    ])
    return data + struct.pack("<I", zlib.crc32(data)), len(ids)


class TokenFile:
    """Random access to a file's bytes."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC or zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError("not a token file, or a damaged one")
        n, width, self.base, rules, size = struct.unpack_from("<IIIIQ", data, 8)
        kind, at = "<u2" if width == 2 else "<u4", 8 + struct.calcsize("<IIIIQ")

        def take(dtype: str, count: int) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(data, dtype, count, at)
            at += got.nbytes
            return got

        ids, null = take("<i8", n), take("u1", n)
        self.doc_ids = [None if z else i for i, z in zip(ids.tolist(), null.tolist())]
        self.counts, self.starts = take("<u4", n), take("<u8", n)
        self.rules = np.stack([take(kind, rules), take(kind, rules)], axis=1).astype(np.int64)
        self.sizes, self.seq = take("<u4", rules).astype(np.int64), take(kind, size)
        self.flat, _ = expansions(self.rules, self.base)

    def ids(self, k: int) -> np.ndarray:
        """All ids of the k-th document."""
        end = int(self.starts[k + 1]) if k + 1 < len(self.starts) else len(self.seq)
        return _expand(self.seq[int(self.starts[k]) : end], self.flat, self.sizes, self.base)

    def id_at(self, k: int, j: int) -> int:
        """The j-th id of the k-th document, by the rules' lengths."""
        at = int(self.starts[k])
        size = lambda s: int(self.sizes[s - self.base]) if s >= self.base else 1
        while j >= (n := size(s := int(self.seq[at]))):
            j, at = j - n, at + 1
        while s >= self.base:
            left, right = self.rules[s - self.base].tolist()
            s, j = (left, j) if j < size(left) else (right, j - size(left))
        return s

    def all_ids(self) -> Iterator[np.ndarray]:
        """The ids of each document, expanded together."""
        flat = _expand(self.seq, self.flat, self.sizes, self.base)
        ends = np.cumsum(self.counts.astype(np.int64))
        for start, end in zip((ends - self.counts).tolist(), ends.tolist()):
            yield flat[start:end]


#: Fixed value: the pre-split pattern of this public vocabulary.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Characters below U+0250 that its normalizer only puts in lower case, one by one, and their classes in the pattern.
_LATIN = [chr(c) for c in [*range(0x21, 0x7F), *range(0xA1, 0x250)] if c != 0x130]
_CLASS = {k: "".join(re.escape(c) for c in _LATIN if unicodedata.category(c)[0] == k) for k in "LN"}
LATIN = re.compile(r"[\t-\r -~\xa1-\u012f\u0131-\u024f]*")
PIECES = re.compile(rf"[{_CLASS['L']}]+|'s|'t|'re|'ve|'m|'ll|'d|[{_CLASS['N']}]|[^\t-\r {_CLASS['L']}{_CLASS['N']}]+")


class Memo(dict):
    """Packed ids of what make encodes; beyond MEMO_BYTES all are forgotten."""

    def __init__(self, make: Callable[[str], bytes]):
        super().__init__()
        self.make, self.size = make, 0

    def __missing__(self, what: str) -> bytes:
        got = self.make(what)
        self.size += 200 + 2 * len(what) + len(got)
        if self.size > MEMO_BYTES:
            self.clear()
            self.size = 200
        self[what] = got
        return got


class Encoder:
    """Packed ids of texts by the tokenizers library.

    Texts of Latin characters are cut here as the library cuts them, so that its model sees a piece once, whatever
    stands around it; other texts go to the library stretch by stretch between white space.
    """

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(definition)
        self.library.no_padding()
        self.library.no_truncation()
        self.size = self.library.get_vocab_size(with_added_tokens=True)
        self.width = 2 if self.size < 1 << 16 else 4
        told = json.loads(definition)
        split = (told.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0].get("pattern", {}).get("Regex", "")
        self.plain = split == SPLIT
        self.marks = [x["content"] for x in told.get("added_tokens", [])]
        self.model = self.library.model
        self.letters = {b: c for c, b in byte_letters().items()}
        self.forget(None)

    def forget(self, stage: int | None) -> None:
        self.stage, self.pieces, self.stretches = stage, Memo(self._piece), Memo(self._stretch)

    def pack(self, ids: list[int]) -> bytes:
        return array("H" if self.width == 2 else "I", ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        shown = piece if piece.isascii() else "".join([self.letters[b] for b in piece.encode()])
        return self.pack([t.id for t in self.model.tokenize(shown)])

    def _stretch(self, stretch: bytes) -> bytes:
        return self.pack(self.library.encode(stretch.decode(), add_special_tokens=False).ids)

    def encode(self, text: str) -> bytes:
        if self.plain and LATIN.fullmatch(text) and not any(m in text for m in self.marks):
            return b"".join(map(self.pieces.__getitem__, PIECES.findall(text.lower())))
        return b"".join(map(self.stretches.__getitem__, text.encode().split()))


_READY: dict[int, Encoder] = {}


def _encoder(definition: str) -> Encoder:
    """A worker's encoder; what it remembers goes when another stage begins."""
    key, stage = hash(definition), TaskContext.get().stageId()
    if key not in _READY:
        _READY.clear()
        _READY[key] = Encoder(definition)
    if _READY[key].stage != stage:
        _READY[key].forget(stage)
    return _READY[key]


def write_tokens(docs: DataFrame, path: str, folder: str, end_id: int = 1, file_ids: int = FILE_IDS) -> DataFrame:
    """Writes the ids of docs (doc_id, text), each document ended by end_id, to folder and returns the manifest.

    path: a tokenizer file of the tokenizers library that drops white space and splits at it, so that stretches
    between white space can be encoded apart. Null text is empty and leaves the end id alone; a null doc_id comes
    first; rows of one doc_id are written each, in the order in which they are read. No rows give no files; other columns are ignored.
    """
    spark = docs.sparkSession
    with open(path, encoding="utf-8") as file:
        told = spark.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(told.value)
        end = encoder.pack([end_id])
        part, done = TaskContext.get().partitionId(), []
        doc_ids: list = []
        parts: list[bytes] = []
        held = 0

        def close() -> None:
            nonlocal held
            file = Pending(folder, f"part-{part:05d}-{len(done):04d}.ids")
            data, count = pack(doc_ids, parts, encoder.width, encoder.size)
            file.write(data)
            file.commit()
            done.append((file.name, part, len(done), len(parts), count))
            doc_ids.clear()
            parts.clear()
            held = 0

        for batch in pieces(batches, "text"):
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                parts.append(encoder.encode(text) + end)
                doc_ids.append(doc_id)
                held += len(parts[-1])
                if held >= file_ids * encoder.width:
                    close()
        if parts:
            close()
        if done:
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], t) for k, t in enumerate(kinds)], names=[x.split(" ")[0] for x in MANIFEST.split(", ")])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    dealt = rows.withColumn("at", F.monotonically_increasing_id()).repartitionByRange("doc_id", "at").sortWithinPartitions("doc_id", "at").drop("at")  # rows of one id are dealt, too, and no text is read to find the ranges
    dealt.mapInArrow(run, MANIFEST).write.parquet(f"{folder}/manifest")
    return read_manifest(spark, folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_tokens(spark: SparkSession, folder: str, ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document in the files of the manifest; with ids also input_ids.

    A file's start is the ids of the tasks before (a running sum over tasks) and of the task's files before it.
    """
    manifest = read_manifest(spark, folder)
    past = lambda w: F.coalesce(F.sum("ids").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    tasks = manifest.groupBy("part").agg(F.sum("ids").alias("ids")).select("part", past(W.orderBy("part")).alias("before"))
    own = manifest.select("part", "file", past(W.partitionBy("part").orderBy("roll")).alias("within"))
    files = own.join(tasks, "part").select("file", (F.col("before") + F.col("within")).alias("first"))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", input_ids array<int>" * ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, first in zip(batch["file"].to_pylist(), batch["first"].to_pylist()):
                file = TokenFile(whole(folder, name))
                counts = file.counts.astype(np.int64)
                crcs, each = [], []
                for own in file.all_ids():
                    crcs.append(zlib.crc32(own.astype("<u4").tobytes()))
                    if ids:
                        each.append(own.astype(np.int32))
                arrays = [pa.array(file.doc_ids, pa.int64()), pa.array(first + np.cumsum(counts) - counts), pa.array(counts), pa.array(crcs, pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if ids:
                    arrays.append(pa.array(each, pa.list_(pa.int32())))
                    names.append("input_ids")
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    number = int(spark.conf.get("spark.sql.shuffle.partitions"))  # keeps the few small rows of names in as many tasks
    return files.repartition(number, "file").mapInArrow(run, schema)


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = work_path(spark, "tokens")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"), folder)
    return read_tokens(spark, folder)
