"""Helpers the corpus operators share: shared folders, small written tables, Arrow batches, links."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
_OWN: dict[str, str] = {}
_PATHS: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; on a local master, where all is one process, one of our own if it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="veldspar-")
        spark.sparkContext.setCheckpointDir(_OWN[app])
    return _OWN[app]


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/veldspar/{name}-{uuid.uuid4().hex}"
    if not _PATHS:
        atexit.register(_clean)
    _PATHS.append((spark, path))
    return path


def remove_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _clean() -> None:
    for spark, path in _PATHS:
        with contextlib.suppress(Exception):  # the session may have ended before us
            remove_path(spark, path)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df from a table written in the shared folder: they outlive lost executors and aren't computed twice."""
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Removes tables of written() that nothing will read any more."""
    for table in tables:
        remove_path(table.sparkSession, table.path)


def text_of(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def pieces(batches: Iterable[pa.RecordBatch], column: str, limit: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of batches whose column holds about limit bytes at most (one longer value makes a slice of its own)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch[column]), 0).to_pylist()
        start = total = 0
        for i, n in enumerate(sizes):
            if total and total + n > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        yield batch.slice(start)


def relieved(function: Callable) -> Callable:
    """function over Arrow batches, after which a worker gives memory that it has freed back to the system; workers live on from task to task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
                ctypes.CDLL(None).malloc_trim(0)

    return run


def in_arrow(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    return df.mapInArrow(function, schema)


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of links (a, b): rows (node, component), component the least node of each.

    Alternating large-star and small-star rounds. A node's neighbours are only ever aggregated by min, so that a
    node with many links is combined map-side and never gathered. Each round's links are written to the shared folder, in
    place of those of the round before. A chain of n nodes takes about log2(n) rounds, so most_rounds is beyond any table.
    """
    spark = links.sparkSession
    now = written(
        links.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        "links",
    )
    for _ in range(most_rounds):
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: every larger neighbour hangs on the least node of the neighbourhood
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: a node's smaller neighbours hang on the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        after = written(small, "links")
        sums = [df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head() for df in (now, after)]
        dropped(now)
        if sums[0] == sums[1]:  # both are sets of links: equal counts and sums of hashes
            break
        now = after
    else:
        raise RuntimeError(f"links did not settle in {most_rounds} rounds")
    roots = after.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return after.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
