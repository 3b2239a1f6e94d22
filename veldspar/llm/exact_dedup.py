"""Exact deduplication with a sharded cuckoo-filter index.

The index keeps live digests in shards by digest. A shard is a cuckoo filter: buckets of four slots, each slot a
16-bit fingerprint next to the stored key it stands for. A probe looks at the two buckets of a key; a fingerprint
that agrees is verified against the stored digest, so no answer rests on the filter alone. Keys can be inserted and
deleted; an insertion that finds no free slot after a bounded number of kicks doubles the shard's buckets and
places all stored keys again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, text_of, written

SLOTS = 4
KICKS = 200
INDEX = "shard int, n_buckets int, bucket int, slot int, digest binary, keep_id long, live long"


class CuckooShard:
    """One shard of the index: digest -> [least doc_id, number of live rows]."""

    def __init__(self, n_buckets: int = 64):
        self.n = n_buckets
        self.prints: list[list[int]] = [[] for _ in range(n_buckets)]
        self.stored: list[list[list]] = [[] for _ in range(n_buckets)]
        self.turn = 0

    @staticmethod
    def _print(digest: bytes) -> int:
        return int.from_bytes(digest[8:10], "little") or 1

    def _homes(self, digest: bytes) -> tuple[int, int, int]:
        mark = self._print(digest)
        first = int.from_bytes(digest[:8], "little") & (self.n - 1)
        return mark, first, self._other(first, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return (bucket ^ (mark * 0x5BD1E995)) & (self.n - 1)

    def find(self, digest: bytes) -> list | None:
        mark, first, second = self._homes(digest)
        for bucket in (first, second):
            if mark in self.prints[bucket]:
                for key in self.stored[bucket]:
                    if key[0] == digest:
                        return key
        return None

    def insert(self, digest: bytes, doc_id: int | None, count: int = 1) -> None:
        key = self.find(digest)
        if key is None:
            self._place([digest, doc_id, count])
            return
        key[2] += count
        if doc_id is not None and (key[1] is None or doc_id < key[1]):
            key[1] = doc_id

    def delete(self, digest: bytes, doc_id: int | None = None, count: int = 1) -> bool:
        """Takes back count live rows, doc_id the least of them; the key leaves with its last one, and one whose least doc_id leaves has none until it is told again. False for a digest that isn't live."""
        key = self.find(digest)
        if key is None:
            return False
        key[2] -= count
        if key[1] == doc_id:
            key[1] = None
        if key[2] <= 0:
            for bucket in set(self._homes(digest)[1:]):
                for at, own in enumerate(self.stored[bucket]):
                    if own is key:
                        del self.stored[bucket][at], self.prints[bucket][at]
                        return True
        return True

    def _place(self, key: list) -> None:
        mark, first, second = self._homes(key[0])
        for bucket in (first, second):
            if len(self.prints[bucket]) < SLOTS:
                self.prints[bucket].append(mark)
                self.stored[bucket].append(key)
                return
        bucket = second
        for _ in range(KICKS):
            self.turn = (self.turn + 1) % SLOTS
            marks, keys = self.prints[bucket], self.stored[bucket]
            marks[self.turn], mark = mark, marks[self.turn]
            keys[self.turn], key = key, keys[self.turn]
            bucket = self._other(bucket, mark)
            if len(self.prints[bucket]) < SLOTS:
                self.prints[bucket].append(mark)
                self.stored[bucket].append(key)
                return
        self._resize(key)

    def _resize(self, homeless: list) -> None:
        keys = [key for bucket in self.stored for key in bucket] + [homeless]
        self.n *= 2
        self.prints = [[] for _ in range(self.n)]
        self.stored = [[] for _ in range(self.n)]
        for key in keys:
            self._place(key)

    @classmethod
    def load(cls, n_buckets: int, buckets, digests, keeps, lives) -> CuckooShard:
        shard = cls(n_buckets)
        for bucket, digest, keep, live in zip(buckets, digests, keeps, lives, strict=True):
            shard.prints[bucket].append(cls._print(digest))
            shard.stored[bucket].append([digest, None if pd.isna(keep) else int(keep), int(live)])
        return shard

    def rows(self) -> Iterator[tuple]:
        for bucket, keys in enumerate(self.stored):
            for slot, (digest, keep, live) in enumerate(keys):
                yield self.n, bucket, slot, digest, keep, live


def digests(docs: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, digest) of each row: SHA-256 of the text after each run of white space became one space; null is empty. also: columns to carry along."""
    return docs.select(*also, F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(F.regexp_replace(text_of(), SPACE, " "), 256)).alias("digest"))


def _combined(keys: DataFrame) -> DataFrame:
    """One row for each digest of a partition, so that a hot text reaches its shard as a row a partition at most."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, list] = {}
        for batch in batches:
            for doc_id, digest, count in zip(batch["doc_id"].to_pylist(), batch["digest"].to_pylist(), batch["count"].to_pylist(), strict=True):
                got = seen.setdefault(digest, [doc_id, 0])
                got[1] += count
                if doc_id is not None and (got[0] is None or doc_id < got[0]):
                    got[0] = doc_id
        if seen:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(seen), pa.binary()), pa.array([x[0] for x in seen.values()], pa.int64()), pa.array([x[1] for x in seen.values()], pa.int64())],
                names=["digest", "doc_id", "count"],
            )

    return keys.mapInArrow(local, "digest binary, doc_id long, count long")


def update(index: DataFrame | None, keys: DataFrame, shards: int, delete: bool = False, rest: DataFrame | None = None) -> DataFrame:
    """The index after inserting (or deleting) keys (doc_id, digest): one row for each live digest, at its bucket and slot.

    Deleting takes the digest's rows off its live count. rest: the keys that stay live after a deletion; of digests whose
    least doc_id was deleted it gives the new one, aggregated before it moves. A deletion needs it.
    """
    if delete and rest is None:
        raise ValueError("a deletion needs the keys that stay live")
    spark = keys.sparkSession
    shard = F.pmod(F.conv(F.hex(F.substring("digest", 11, 4)), 16, 10).cast("long"), F.lit(shards)).cast("int")
    change = _combined(keys.select("doc_id", "digest", F.lit(1).cast("long").alias("count"))).withColumn("shard", shard)
    index = spark.createDataFrame([], INDEX) if index is None else index.select("shard", "n_buckets", "bucket", "slot", "digest", "keep_id", "live")

    def apply(own: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["bucket", "slot"])
        filled = CuckooShard.load(int(own.n_buckets.iloc[0]), own.bucket, own.digest, own.keep_id, own.live) if len(own) else CuckooShard()
        number = int((own if len(own) else new).shard.iloc[0])
        for digest, doc_id, count in sorted(zip(new.digest, new.doc_id, new["count"], strict=True), key=lambda x: x[0]):
            if delete:
                filled.delete(digest, None if pd.isna(doc_id) else int(doc_id), int(count))
            else:
                filled.insert(digest, None if pd.isna(doc_id) else int(doc_id), int(count))
        out = pd.DataFrame([(number, *row) for row in filled.rows()], columns=["shard", "n_buckets", "bucket", "slot", "digest", "keep_id", "live"])
        return out.astype({"keep_id": "Int64"})

    out = index.groupBy("shard").cogroup(change.groupBy("shard")).applyInPandas(apply, INDEX)
    if not delete:
        return out
    out = written(out, "index")
    stale = out.where("keep_id is null").select("digest")
    told = rest.join(stale, "digest", "left_semi").groupBy("digest").agg(F.min("doc_id").alias("_keep"))
    return out.join(told, "digest", "left").select("shard", "n_buckets", "bucket", "slot", "digest", F.coalesce("keep_id", "_keep").alias("keep_id"), "live")


def exact_groups(docs: DataFrame, shards: int | None = None, also: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row of docs (doc_id, text).

    Null text is empty text. Rows that share doc_id and text are one document and share its decision. A null doc_id
    gives way to any other and stays only in a group that has no other. No rows give no rows; other columns than those in also, which come first, are ignored.
    """
    keys = written(digests(docs, also), "digests")
    shards = shards or 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    index = update(None, keys, shards)
    found = keys.join(index.select("digest", "keep_id", F.col("live").alias("group_size")), "digest")
    return found.select(*also, "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP10_SQL = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents),
g AS (SELECT h, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY h)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, t.h AS text_sha256 FROM t JOIN g USING (h)
"""
