"""Chains of hits: attachment, scores, order and the gates that decide."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .gazetteer import WEIGHTS
from .similarity import overlaps

#: The hand-set parameters.
PARAMS = {
    "W_SIM": 0.5, "W_COV": 0.2, "W_PRIOR": 0.15, "W_DEPTH": 0.15, "W_CONFLICT": 0.25, "MARGIN_MIN": 0.06, "SIM_MIN": 0.62,
    "SINGLE_HIT_MIN_COV": 0.25, "STRONG_HIT": 0.15, "LONGER_NAME_TOL": 0.08, "UNIQUE_SHORT_MAX": 0.05, "MAX_DIST": 0.4,
}


def param(name: str) -> Column:
    """A parameter as a column of the row's own params map where it has one, so that a grid is a join, not a loop."""
    return F.coalesce(F.col("params")[name], F.lit(PARAMS[name]))


def weight(level: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv]), level)


def best_per_code(hits: DataFrame, group: str = "doc_id") -> DataFrame:
    """The nearest hit of each entry, the first of equals by ord."""
    rest = [c for c in hits.columns if c not in (group, "adcode")]
    return hits.groupBy(group, "adcode").agg(F.min_by(F.struct(*rest), F.struct("dist", "ord")).alias("_b")).select(group, "adcode", "_b.*")


def attach(own: Column, more: Column) -> Column:
    """own hit and, in their order, those of more that overlap none taken before."""
    return F.aggregate(more, F.array(own), lambda taken, h: F.when(F.exists(taken, lambda t: overlaps(t, h)), taken).otherwise(F.concat(taken, F.array(h))))


def ancestor_chains(hits: DataFrame, closure: DataFrame, group: str = "doc_id") -> DataFrame:
    """doc_id, adcode, evidence: each hit with the hits on its ancestors, nearest ancestor first, that overlap none taken before."""
    h = F.struct("adcode", "level", "dist", "s", "e", "prior")
    up = hits.select(group, "adcode", h.alias("own")).join(closure.where("hop > 0"), "adcode")
    above = hits.select(F.col(group).alias("_g"), F.col("adcode").alias("_a"), h.alias("hit"))
    found = up.join(above, (F.col(group) == F.col("_g")) & (F.col("ancestor") == F.col("_a"))).groupBy(group, "adcode").agg(F.array_sort(F.collect_list(F.struct("hop", "hit"))).alias("more"))
    own = hits.select(group, "adcode", h.alias("own")).join(found, [group, "adcode"], "left")
    return own.select(group, "adcode", attach(F.col("own"), F.coalesce(F.transform("more", lambda x: x["hit"]), F.array().cast(hits.select(F.array(h).alias("x")).schema["x"].dataType))).alias("evidence"))


def absorb(hits: DataFrame, group: str = "doc_id") -> DataFrame:
    """doc_id, adcode, evidence: each hit below the districts with hits of the same parent, nearest first, that overlap none taken before; the leftmost leads."""
    low = hits.where(F.col("level").isin("street", "road", "poi"))
    h = F.struct("dist", "ord", "adcode", "level", "s", "e")
    other = low.select(F.col(group).alias("_g"), F.col("parent").alias("_p"), F.col("adcode").alias("_a"), h.alias("hit"))
    pairs = low.select(group, "adcode", "parent", h.alias("own")).join(other, (F.col(group) == F.col("_g")) & F.col("parent").eqNullSafe(F.col("_p")) & (F.col("adcode") != F.col("_a")), "left")
    each = pairs.groupBy(group, "adcode").agg(F.first("own").alias("own"), F.array_sort(F.collect_list("hit")).alias("more"))
    taken = attach(F.col("own"), F.col("more"))
    return each.select(group, "adcode", F.array_sort(taken, lambda a, b: a["s"].cast("int") - b["s"].cast("int")).alias("evidence"))


def viable(evidence: Column) -> Column:
    """Whether hits (level_ord, weak, alias, dist) make a chain: not all weak, not all aliases at the deepest level weak, and without an administrative hit one strong hit at least."""
    deepest = F.array_max(F.transform(evidence, lambda h: h["level_ord"]))
    last = F.filter(evidence, lambda h: h["level_ord"] == deepest)
    return (
        F.exists(evidence, lambda h: ~h["weak"])
        & F.exists(last, lambda h: ~(h["weak"] & h["alias"]))
        & (F.exists(evidence, lambda h: h["level_ord"] <= 2) | F.exists(evidence, lambda h: h["dist"] <= PARAMS["STRONG_HIT"]))
    )


def weighted_mean(items: Column, value: str) -> Column:
    """Mean of a field over structs with a level, weighted by level; 0 for none."""
    top = F.aggregate(items, F.lit(0.0), lambda a, h: a + weight(h["level"]) * h[value])
    return F.when(F.size(items) > 0, top / F.aggregate(items, F.lit(0.0), lambda a, h: a + weight(h["level"]))).otherwise(0.0)


def covered(items: Column, n: Column) -> Column:
    """Share of n places that spans s, e cover together."""
    places = F.flatten(F.transform(F.filter(items, lambda h: h["e"] > h["s"]), lambda h: F.sequence(h["s"], h["e"] - 1)))
    return F.when(n > 0, F.size(F.array_distinct(places)) / n).otherwise(0.0)


def conflict(evidence: Column, own_codes: Column, others: Column) -> Column:
    """Penalty of strong administrative hits off the chain: the greatest weighted similarity of those at a level of the chain that overlap no evidence and come before its roads, unless they are higher and come behind its deepest administrative hit."""
    roads = F.array_max(F.transform(F.filter(evidence, lambda h: h["level_ord"] >= 3), lambda h: h["e"]))
    admin = F.filter(evidence, lambda h: h["level_ord"] <= 2)
    end, deep = F.array_max(F.transform(admin, lambda h: h["e"])), F.array_max(F.transform(admin, lambda h: h["level_ord"]))
    strong = F.filter(
        others,
        lambda h: ~F.array_contains(own_codes, h["adcode"])
        & (h["dist"] <= PARAMS["STRONG_HIT"]) & ~h["weak"] & (h["level_ord"] <= 2) & h["on_chain"]
        & (roads.isNull() | (h["s"] < roads))
        & (end.isNull() | (h["s"] < end) | (h["level_ord"] >= deep))
        & ~F.exists(evidence, lambda x: overlaps(x, h)),
    )
    return F.coalesce(F.array_max(F.transform(strong, lambda h: (1 - h["dist"]) * weight(h["level"]) / 1.2)), F.lit(0.0))


def total(sim: Column, cov: Column, prior: Column, depth: Column, penalty: Column) -> Column:
    return param("W_SIM") * sim + param("W_COV") * cov + param("W_PRIOR") * prior + param("W_DEPTH") * depth - param("W_CONFLICT") * penalty


def dedupe(chains: DataFrame, keys: list[str], size: str = "n_evidence", order: str = "ord") -> DataFrame:
    """One chain per key: the one with most evidence, the first of equals; it takes the place (ord) of the key's first."""
    rest = [c for c in chains.columns if c not in keys and c != order]
    return chains.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(-F.col(size), order)).alias("_b"), F.min(order).alias(order)).select(*keys, "_b.*", order)


def ranked(chains: DataFrame, group: str = "doc_id") -> DataFrame:
    """chains with rank, margin to the next (1 for the only one) and whether the next lies in another administrative area."""
    w = W.partitionBy(group).orderBy(F.desc("total"), "ord")
    nxt = F.lead("total").over(w)
    return chains.select("*", F.row_number().over(w).alias("rank"), F.when(nxt.isNull(), 1.0).otherwise(F.col("total") - nxt).alias("margin"), nxt.isNotNull().alias("has_second"), F.coalesce(F.lead("admin").over(w) != F.col("admin"), F.lit(False)).alias("admin_differs"))


def decide(sim: Column, coverage: Column, single_dist: Column, deep: Column, margin: Column, has_second: Column, differs: Column, p=param) -> Column:
    """The gates in order: similarity, a lone inexact hit, depth, margin to another area. single_dist: distance of the only evidence, null if there is more."""
    lone = single_dist.isNotNull() & (single_dist > 1e-9) & (coverage < p("SINGLE_HIT_MIN_COV"))
    return F.when(sim < p("SIM_MIN"), "reject").when(lone, "reject").when(~deep, "partial").when(has_second & (margin < p("MARGIN_MIN")) & differs, "ambiguous").otherwise("confident")


def quadrant(decision: Column, ok: Column) -> Column:
    return F.when(decision == "confident", F.when(ok, "TP").otherwise("FA")).otherwise(F.when(ok, "FR").otherwise("TR"))


def gold_rank(ranking: DataFrame, group: str = "doc_id", ok: str = "ok", at: tuple[int, ...] = (1, 3)) -> DataFrame:
    """For each group the rank of its first right chain, its reciprocal (0 if none) and recall at each cut."""
    first = F.min(F.when(F.col(ok), F.col("rank")))
    return ranking.groupBy(group).agg(first.alias("gold_rank")).select(group, "gold_rank", F.coalesce(1.0 / F.col("gold_rank"), F.lit(0.0)).alias("mrr"), *[F.coalesce(F.col("gold_rank") <= k, F.lit(False)).alias(f"recall_{k}") for k in at], F.col("gold_rank").isNotNull().alias("recall_all"))


TERMS = {"sim": "W_SIM", "cov": "W_COV", "prior": "W_PRIOR", "depth": "W_DEPTH", "conflict": "W_CONFLICT"}


def dominant_term(gold: dict[str, Column], top: dict[str, Column]) -> Column:
    """The score term in which the right chain loses most to the chosen one; if in none, the one that differs most. Ties go to the first term."""
    order = list(TERMS)
    delta = {k: (-1 if k == "conflict" else 1) * PARAMS[TERMS[k]] * (gold[k] - top[k]) for k in order}
    each = F.array(*[F.struct(F.round(delta[k], 4).alias("d"), F.lit(i).alias("i"), F.lit(k).alias("k")) for i, k in enumerate(order)])
    lost = F.array_sort(F.filter(each, lambda x: x["d"] < 0))
    most = F.array_sort(F.transform(each, lambda x: F.struct((-F.abs(x["d"])).alias("d"), x["i"].alias("i"), x["k"].alias("k"))))
    return F.when(F.size(lost) > 0, F.try_element_at(lost, F.lit(1))["k"]).otherwise(F.element_at(most, 1)["k"])
