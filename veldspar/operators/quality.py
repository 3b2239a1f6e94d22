"""Checks of input tables: domains, splits, signal levels, content-addressed caches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def domain_violations(rows: DataFrame, key: str, domains: dict[str, tuple]) -> DataFrame:
    """key, field, value of values outside their domain; null is outside unless the domain has None."""
    bad = lambda c, d: F.when(F.col(c).isNull(), F.lit(None not in d)).otherwise(~F.col(c).isin(*[x for x in d if x is not None]))
    each = F.array(*[F.when(bad(c, d), F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value"))) for c, d in domains.items()])
    return rows.select(key, F.explode(F.filter(each, lambda x: x.isNotNull())).alias("v")).select(key, "v.*")


def split_problems(members: DataFrame, keys: DataFrame) -> DataFrame:
    """key, problem: keys in two splits and keys in none."""
    twice = members.groupBy("key").agg(F.countDistinct("split").alias("n")).where("n > 1").select("key", F.lit("in several splits").alias("problem"))
    none = keys.select("key").distinct().join(members, "key", "left_anti").select("key", F.lit("in no split").alias("problem"))
    return twice.unionAll(none)


def signal_stats(samples: Column) -> Column:
    """Struct of rms, peak and label (silent below 0.002 rms, clipped from 0.999 peak) of an array of samples."""
    n = F.size(samples)
    square = F.aggregate(samples, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    rms = F.when(n > 0, F.sqrt(square / n)).otherwise(0.0)
    peak = F.coalesce(F.array_max(F.transform(samples, lambda x: F.abs(x.cast("double")))), F.lit(0.0))
    return F.struct(rms.alias("rms"), peak.alias("peak"), F.when(rms < 0.002, "silent").when(peak >= 0.999, "clipped").otherwise("ok").alias("label"))


def scaled(samples: Column, peak: float = 0.9) -> Column:
    """Samples scaled to a peak; silence stays."""
    top = F.array_max(F.transform(samples, lambda x: F.abs(x.cast("double"))))
    return F.when(top > 0, F.transform(samples, lambda x: x.cast("double") * peak / top)).otherwise(samples.cast("array<double>"))


def cache_key(content: Column, language: Column, context: Column) -> Column:
    """SHA-1 of content's SHA-1, language and context, parted by zero bytes."""
    nul = F.lit("\x00")
    return F.sha1(F.concat(F.sha1(content), nul, F.coalesce(language, F.lit("")), nul, F.coalesce(context, F.lit(""))))


def cached(requests: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(requests with their cached transcript, requests without one), by key."""
    return requests.join(cache, "key"), requests.join(cache, "key", "left_anti")


def require_cached(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """requests with their cached transcript; one without is an error, as when only the cache may be read."""
    hits, misses = cached(requests, cache)
    first = misses.select("key").head()
    if first is not None:
        raise LookupError(f"not in the cache: {first.key}")
    return hits


def scored_rows(rows: DataFrame) -> DataFrame:
    """Rows of good quality, with whether they are scored: a confirmed or draft label, and a gold value or nothing to find."""
    has = F.col("gold").isNotNull() | ~F.coalesce("has_address", F.lit(True))
    return rows.where("quality = 'ok'").withColumn("scored", F.coalesce(F.col("label_status").isin("confirmed", "draft") & has, F.lit(False)))


def union_sources(parts: dict[str, DataFrame]) -> DataFrame:
    """Rows of all parts with their source; columns that a part lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn("source", F.lit(name)) for name, df in parts.items()])
