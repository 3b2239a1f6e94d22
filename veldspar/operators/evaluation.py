"""Evaluation analytics: slices, grids, calibration, paired comparison, attribution, regression checks."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ranking import PARAMS, quadrant


def cer(hyp: Column, ref: Column) -> Column:
    """Character error rate; of an empty reference 0 or 1."""
    return F.when(F.length(ref) == 0, F.when(F.length(hyp) == 0, 0.0).otherwise(1.0)).otherwise(F.levenshtein(hyp, ref) / F.length(ref))


def sliced(rows: DataFrame, axes: dict[str, Column], metrics: dict[str, Column], extra: list[Column] | None = None) -> DataFrame:
    """axis, value, n and for each boolean metric k and n (rows where it isn't null), over all rows and each value of each axis; extra: more aggregates, over columns of rows.

    An axis is a column of strings (null: "null") or of arrays (a row counts in each element). One pass: the axes are
    unpivoted before one aggregation, whose partial sums are as few as there are values.
    """
    kinds = dict(rows.select(*[c.alias(a) for a, c in axes.items()]).dtypes) if axes else {}
    value = lambda a, c: F.coalesce(c, F.array()) if kinds[a].startswith("array") else F.array(F.coalesce(c.cast("string"), F.lit("null")))
    cell = lambda a: lambda v: F.struct(F.lit(a).alias("axis"), v.cast("string").alias("value"))
    each = [F.transform(value(a, c), cell(a)) for a, c in axes.items()]
    cells = F.concat(F.array(F.struct(F.lit("all").alias("axis"), F.lit("all").alias("value"))), *each)
    flat = rows.select("*", F.explode(cells).alias("_c")) if extra else rows.select(F.explode(cells).alias("_c"), *[m.alias(k) for k, m in metrics.items()])
    if extra:
        flat = flat.withColumns(metrics)
    aggs = [x for k in metrics for x in (F.count_if(F.col(k)).alias(f"{k}_k"), F.count(k).alias(f"{k}_n"))]
    return flat.groupBy("_c.axis", "_c.value").agg(F.count("*").alias("n"), *aggs, *(extra or []))


def quadrants(rows: DataFrame, keys: list[str], q: Column) -> DataFrame:
    """Counts of the four quadrants with coverage, risk and over_reject."""
    tp, fa, fr, tr = (F.count_if(q == x) for x in ("TP", "FA", "FR", "TR"))
    share = lambda a, b: F.when(b > 0, a / b)
    return rows.groupBy(*keys).agg(tp.alias("tp"), fa.alias("fa"), fr.alias("fr"), tr.alias("tr"), share(tp + fa, F.count("*")).alias("coverage"), share(fa, tp + fa).alias("risk"), share(fr, tp + fr).alias("over_reject"))


def grid_scan(rows: DataFrame, grid: DataFrame, current: tuple[float, float] | None = None) -> DataFrame:
    """Quadrants at each grid point (margin_min, sim_min) of rows (sim, coverage, single_dist, deep, margin, has_second, admin_differs, ok), and at a current point off the grid.

    A row passes the gates up to some threshold of each kind, so rows are counted once by the thresholds that they pass;
    what meets the grid, a stated set of points, is that small histogram.
    """
    points = [(float(r.margin_min), float(r.sim_min)) for r in grid.select("margin_min", "sim_min").collect()]
    if current is not None and not any(abs(m - current[0]) < 1e-9 and abs(s - current[1]) < 1e-9 for m, s in points):
        points.append(current)
    margins, sims = sorted({m for m, _ in points}), sorted({s for _, s in points})
    passed = lambda c, steps: F.size(F.filter(F.array(*map(F.lit, steps)), lambda x: c >= x)) if steps else F.lit(0)
    lone = F.col("single_dist").isNotNull() & (F.col("single_dist") > 1e-9) & (F.col("coverage") < PARAMS["SINGLE_HIT_MIN_COV"])
    held = F.coalesce(F.col("has_second") & F.col("admin_differs"), F.lit(False)) & F.col("margin").isNotNull()
    cells = rows.groupBy(
        (~F.coalesce(lone, F.lit(False)) & F.coalesce("deep", F.lit(True))).alias("_open"),
        F.when(F.col("sim").isNull(), len(sims)).otherwise(passed(F.col("sim"), sims)).alias("_s"),
        F.when(held, passed(F.col("margin"), margins)).otherwise(len(margins)).alias("_m"),
        F.col("ok"),
    ).agg(F.count("*").alias("_n"))
    told = rows.sparkSession.createDataFrame([(m, s, margins.index(m), sims.index(s)) for m, s in points], "margin_min double, sim_min double, _mi int, _si int")
    each = cells.crossJoin(F.broadcast(told)).withColumn("_q", quadrant(F.when(F.col("_open") & (F.col("_s") > F.col("_si")) & (F.col("_m") > F.col("_mi")), "confident").otherwise("held"), F.col("ok")))
    total = lambda q: F.coalesce(F.sum(F.when(F.col("_q") == q, F.col("_n"))), F.lit(0))
    out = each.groupBy("margin_min", "sim_min").agg(*[total(q).alias(q.lower()) for q in ("TP", "FA", "FR", "TR")])
    share = lambda a, b: F.when(b > 0, a / b)
    tp, fa, fr, tr = (F.col(k) for k in ("tp", "fa", "fr", "tr"))
    return out.withColumns({"coverage": share(tp + fa, tp + fa + fr + tr), "risk": share(fa, tp + fa), "over_reject": share(fr, tp + fr)})


def rises(points: DataFrame, along: str, within: str, value: str = "coverage") -> DataFrame:
    """Points at which value grows along an axis that must not let it grow."""
    w = W.partitionBy(within).orderBy(along)
    return points.withColumn("next", F.lead(value).over(w)).where(F.col("next") > F.col(value) + 1e-9)


def coverage_at_risk(points: DataFrame, targets: DataFrame) -> DataFrame:
    """For each target risk the point of greatest coverage, then least risk, within it."""
    within = targets.join(points, F.col("risk") <= F.col("target"), "left")
    return within.groupBy("target").agg(F.max_by(F.struct("coverage", "risk", "margin_min", "sim_min"), F.struct("coverage", -F.col("risk"), -F.col("margin_min"), -F.col("sim_min"))).alias("b")).select("target", "b.*")


def ece(rows: DataFrame, confidence: Column, correct: Column, bins: int = 10) -> DataFrame:
    """bin, n, acc, conf, part: fixed-width bins, the last closed; part sums to the expected calibration error. Values outside 0 to 1 fall in no bin."""
    inside = rows.select(confidence.alias("c"), correct.cast("int").alias("y")).where("c >= 0 and c <= 1")
    binned = inside.groupBy(F.least(F.floor(F.col("c") * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.avg("y").alias("acc"), F.avg("c").alias("conf"))
    return binned.select("bin", "n", "acc", "conf", (F.col("n") / F.sum("n").over(W.partitionBy()) * F.abs(F.col("acc") - F.col("conf"))).alias("part"))


def isotonic(rows: DataFrame, x: Column, y: Column, keys: list[str]) -> DataFrame:
    """keys, x_start, p: steps of the isotonic (pool adjacent violators) fit of each key.

    Ties in x are merged by a distributed aggregation first; what one task sees of a key is its distinct x.
    """
    merged = rows.select(*keys, x.cast("double").alias("x"), y.cast("double").alias("y")).where("x is not null and y is not null").groupBy(*keys, "x").agg(F.sum("y").alias("s"), F.count("*").alias("w"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        starts, sums, counts = [], [], []
        for a, s, n in pdf.sort_values("x")[["x", "s", "w"]].itertuples(index=False):
            while starts and sums[-1] * n >= s * counts[-1]:
                a, s, n = starts.pop(), s + sums.pop(), n + counts.pop()
            starts.append(a)
            sums.append(s)
            counts.append(n)
        out = pd.DataFrame({"x_start": starts, "p": [s / n for s, n in zip(sums, counts)]})
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out[[*keys, "x_start", "p"]]

    kinds = dict(merged.dtypes)
    return merged.groupBy(*keys).applyInPandas(fit, ", ".join([*(f"{k} {kinds[k]}" for k in keys), "x_start double", "p double"]))


def step_lookup(rows: DataFrame, score: Column, steps: DataFrame) -> DataFrame:
    """rows with p: the value of the greatest step start not above the score, the first step's below all. Steps (x_start, p) are folded into one sorted array, a row's lookup is a scan of it."""
    table = steps.agg(F.array_sort(F.collect_list(F.struct("x_start", "p"))).alias("_steps"))
    p = F.aggregate("_steps", F.element_at("_steps", 1)["p"], lambda a, s: F.when(score >= s["x_start"], s["p"]).otherwise(a))
    return rows.crossJoin(F.broadcast(table)).withColumn("p", p).drop("_steps")


def paired(rows: DataFrame, before: Column, after: Column, keys: list[str] | None = None) -> DataFrame:
    """Counts of pairs kept right, mended, broken and missed, and the net gain."""
    c = lambda x: F.count_if(x)
    return rows.groupBy(*(keys or [])).agg(c(before & after).alias("kept"), c(~before & after).alias("mended"), c(before & ~after).alias("broken"), c(~before & ~after).alias("missed"), (c(~before & after) - c(before & ~after)).alias("net"))


def bootstrap(rows: DataFrame, diff: Column, rounds: int = 1000, seed: int = 0) -> DataFrame:
    """diff, lo, hi, n: mean of the paired differences, any numbers, with the 95 % interval of `rounds` resamples; nulls don't count.

    A resample of n rows depends on them only through the counts of the distinct values, so each is one multinomial draw
    of those counts by a generator seeded with its number: exact and the same on every run. What one task holds is the
    distinct values.
    """
    counts = rows.select(diff.cast("double").alias("v")).where("v is not null").groupBy("v").agg(F.count("*").alias("k"))
    all_counts = counts.agg(F.array_sort(F.collect_list(F.struct("v", "k"))).alias("c"), F.sum("k").alias("n")).where("n > 0")

    @F.pandas_udf("double")
    def draw(ids: pd.Series, values: pd.Series, sizes: pd.Series) -> pd.Series:
        def one(i: int, value: np.ndarray, size: np.ndarray) -> float:
            value, size = np.asarray(value, float), np.asarray(size, float)
            n = int(size.sum())
            return float(np.random.default_rng((seed, i)).multinomial(n, size / n) @ value) / n

        return pd.Series([one(*x) for x in zip(ids, values, sizes)], dtype="float64")

    pick = lambda k: F.transform("c", lambda x: x[k])
    flat = all_counts.select("n", pick("v").alias("v"), pick("k").alias("k"), (F.aggregate("c", F.lit(0.0), lambda a, x: a + x["v"] * x["k"]) / F.col("n")).alias("diff"))
    sampled = flat.crossJoin(F.broadcast(rows.sparkSession.range(rounds))).withColumn("m", draw("id", "v", "k"))
    at = lambda q: F.element_at(F.array_sort(F.collect_list("m")), min(rounds, int(q * rounds) + 1))
    return sampled.groupBy("n", "diff").agg(at(0.025).alias("lo"), at(0.975).alias("hi"))


def golden_diff(golden: DataFrame, now: DataFrame) -> DataFrame:
    """axis, value, metric, k_before, k_now, status: slices that fell, are missing or are new."""
    both = golden.withColumnRenamed("k", "k_before").join(now.withColumnRenamed("k", "k_now"), ["axis", "value", "metric"], "full_outer")
    status = F.when(F.col("k_now").isNull(), "missing").when(F.col("k_before").isNull(), "new").when(F.col("k_now") < F.col("k_before"), "fell").otherwise("ok")
    return both.withColumn("status", status).where("status <> 'ok'")


def changed(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """Rows of both runs whose value differs."""
    b = before.select(key, F.col(value).alias("before")).join(after.select(key, F.col(value).alias("after")), key)
    return b.where(~F.col("before").eqNullSafe(F.col("after")))


def merge_protected(old: DataFrame, new: DataFrame, key: str, protected: Column, derived: list[str]) -> DataFrame:
    """Upsert: a protected old row keeps all but its derived columns; other rows are the new ones; rows of one side stay."""
    cols = [c for c in old.columns if c != key]
    o = old.select(key, F.struct(*cols).alias("_o"), protected.alias("_p"))
    both = o.join(new.select(key, F.struct(*cols).alias("_n")), key, "full_outer")
    keep = F.coalesce("_p", F.lit(False))
    pick = lambda c: F.when(F.col("_n").isNull() | (keep & F.lit(c not in derived)), F.col("_o")[c]).otherwise(F.col("_n")[c]).alias(c)
    return both.select(key, *[pick(c) for c in cols])


def only_in_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """key, side of keys that one side lacks."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").select(key, F.lit("left").alias("side")).unionAll(b.join(a, key, "left_anti").select(key, F.lit("right").alias("side")))


def leaked(out: Column, gold: Column) -> Column:
    """Characters of out that gold lacks, repeats included, in order."""
    return F.array_join(F.filter(F.split(out, ""), lambda c: (c != "") & ~gold.contains(c)), "")


def effective_counts(rows: DataFrame, source: str, group: str, draft: Column, tags: str) -> tuple[DataFrame, DataFrame]:
    """(n, drafts, groups) and tag counts in which a group counts once, by its first row in order of ord."""
    total = rows.agg(F.count("*").alias("n"), F.count_if(draft).alias("drafts"), F.countDistinct(F.concat_ws(":", source, group)).alias("groups"))
    first = rows.groupBy(source, group).agg(F.min_by(tags, "ord").alias("_t"))
    return total, first.select(F.explode("_t").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def gate_status(rows: DataFrame, split: str, source: str, group: str, tags: str, need: dict[str, int] | None = None, per_tag: int = 30) -> DataFrame:
    """split, effective, need, weak_tags, ok of each split that has a need: whether its effective rows (a group counts once) and, for train, the rows of each tag suffice. rows: with ord."""
    need = {"train": 500, "calib": 300} if need is None else need
    first = rows.groupBy(split, source, group).agg(F.min_by(tags, "ord").alias("_t"))
    size = first.groupBy(F.col(split).alias("split")).agg(F.count("*").alias("effective"))
    weak = first.where(F.col(split) == "train").select(F.col(split).alias("split"), F.explode("_t").alias("tag")).groupBy("split", "tag").count().where(F.col("count") < per_tag)
    lists = weak.groupBy("split").agg(F.array_sort(F.collect_list("tag")).alias("weak_tags"))
    told = rows.sparkSession.createDataFrame([(k, v) for k, v in need.items()], "split string, need long")
    out = told.join(size, "split", "left").join(lists, "split", "left").withColumns({"effective": F.coalesce("effective", F.lit(0)), "weak_tags": F.coalesce("weak_tags", F.array().cast("array<string>"))})
    return out.withColumn("ok", (F.col("effective") >= F.col("need")) & (F.size("weak_tags") == 0))


def tagged(rows: DataFrame, drops: DataFrame, key: str, source_key: str | None = None, tag: str = "oov_db", column: str = "negative_type") -> DataFrame:
    """rows with the tag where a drop affects them (drops: affects array), by their key or their source's; others keep what they had."""
    hit = drops.select(F.explode("affects").alias("_k")).distinct()
    own = rows.join(F.broadcast(hit), F.col(key) == F.col("_k") if source_key is None else (F.col(key) == F.col("_k")) | (F.col(source_key) == F.col("_k")), "left_semi").select(F.col(key).alias("_k")).distinct()
    marked = rows.join(own.withColumn("_hit", F.lit(True)), F.col(key) == F.col("_k"), "left")
    before = F.col(column) if column in rows.columns else F.lit(None).cast("string")
    return marked.withColumn(column, F.when(F.col("_hit"), tag).otherwise(before)).drop("_k", "_hit")


def symmetric_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of one side that the other lacks, with the side; repeats count."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionAll(right.exceptAll(left).withColumn("side", F.lit("right")))


def gaps(rows: DataFrame, axes: list[str], least: int = 20) -> DataFrame:
    """Cells of the axes with n and how many rows they lack."""
    return rows.groupBy(*axes).agg(F.count("*").alias("n")).withColumn("need", F.greatest(F.lit(0), least - F.col("n")))


def objective(rows: DataFrame, keys: list[str], q: Column, cost: dict[str, float]) -> DataFrame:
    """Mean cost of the quadrants."""
    each = reduce(lambda a, k: a.when(q == k, cost[k]), cost, F.when(F.lit(False), 0.0)).otherwise(0.0)
    return rows.groupBy(*keys).agg(F.avg(each).alias("cost"))


def flat_share(points: DataFrame, key: str, at: str, value: str, current: Column, pinned: float = 0.2) -> DataFrame:
    """For each parameter the share of its grid in the unbroken run of equal values around the current point, and whether that pins it down."""
    w = W.partitionBy(key).orderBy(at)
    run = points.withColumn("_new", F.coalesce((F.col(value) != F.lag(value).over(w)).cast("int"), F.lit(0))).withColumn("_run", F.sum("_new").over(w))
    runs = run.groupBy(key, "_run").agg(F.count("*").alias("n"), F.min(at).alias("lo"), F.max(at).alias("hi"), F.max(current.cast("int")).alias("_here"))
    out = runs.withColumn("flat_share", F.col("n") / F.sum("n").over(W.partitionBy(key))).where("_here = 1")
    return out.select(key, "lo", "hi", "flat_share", (F.col("flat_share") < pinned).alias("pinned"))


def attribute(r: dict[str, Column]) -> Column:
    """Where a failed row failed: the first label whose condition holds, null for a right row.

    Missing flags count as passed, but a row that a gate judged (e_present, or a quadrant_geo) without telling its
    quadrant did not pass it.
    """
    yes = lambda k: F.coalesce(r[k], F.lit(True))
    no = lambda k: F.coalesce(r[k], F.lit(False))
    q = r["quadrant_geo"]
    judged = F.coalesce(r["e_present"], F.lit(False)) if "e_present" in r else q.isNotNull()
    later = (~no("c_evaluable") | yes("c_ok")) & (~no("d_evaluable") | yes("d_ok")) & (~judged | F.coalesce(q.isin("TP", "TR"), F.lit(False)))
    return (
        F.when(r["quality"] != "ok", "skip")
        .when(no("exact"), F.when(r["quadrant"] == "FR", "gate_over_reject"))
        .when(no("name_lost") | (~yes("gold_in_db") & ~no("name_missing")) | (no("name_missing") & r["decision"].isin("reject", "partial", "empty") & ~yes("admin_all")), "db_missing")
        .when(r["phon_dist"] > 0.4, "asr_unrecoverable")
        .when(~yes("b_ok") & later, "normalize_error")
        .when(no("c_evaluable") & ~no("recall_all"), "recall_miss")
        .when(no("d_evaluable") & ~no("top1"), "rank_error")
        .when(q == "FA", "gate_over_accept")
        .when(q == "FR", "gate_over_reject")
        .when(no("f_evaluable") & ~no("backfill"), "completion_error")
        .otherwise("assembly_error")
    )


def attribution_detail(label: Column, r: dict[str, Column]) -> Column:
    """What a label rests on, for people: r has address, missing, decision, gate, backfilled, leaked."""
    said = lambda c: F.coalesce(c.cast("string"), F.lit("-"))
    names = lambda c: F.concat_ws(", ", c)
    return (
        F.when(label == "db_missing", F.concat(F.lit("not in the gazetteer: "), names(r["missing"]), F.lit("; address "), said(r["address"])))
        .when(label.startswith("gate_"), F.concat(F.lit("gate="), said(r["gate"]), F.lit(" decision="), said(r["decision"])))
        .when(label == "completion_error", F.concat(F.lit("levels put in: "), names(r["backfilled"])))
        .when(label == "normalize_error", F.concat(F.lit("leaked: "), said(r["leaked"])))
        .when(label.isNotNull(), F.concat(F.lit("address "), said(r["address"])))
        .otherwise("")
    )


def severity(admin_all: Column, geo_recall: Column, geo_ok: Column, tail_all: Column) -> Column:
    return F.when(~admin_all, "admin").when((geo_recall < 1) | ~geo_ok, "place").when(~tail_all, "tail").otherwise("right")


def rule_coverage(rules: DataFrame, rows: DataFrame, rule: str = "rule") -> DataFrame:
    """Every rule with the number of rows that it made, 0 included."""
    made = rows.groupBy(rule).agg(F.count("*").alias("_n"))
    return rules.join(made, rule, "left").select(rule, F.coalesce("_n", F.lit(0)).alias("n"))
