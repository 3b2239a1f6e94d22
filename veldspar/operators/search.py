"""Replay of stored features under any parameters, and parameter search over the replay."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import stages
from .evaluation import quadrants
from .ranking import PARAMS, TERMS, decide, quadrant

SIMPLEX = ("W_SIM", "W_COV", "W_PRIOR", "W_DEPTH")
REPLAYABLE = (*SIMPLEX, "W_CONFLICT", "MARGIN_MIN", "SIM_MIN", "SINGLE_HIT_MIN_COV")


def replay(features: DataFrame, candidates: DataFrame) -> DataFrame:
    """candidate, id, decision, ok, total, margin of each candidate's top chain.

    features: id, chain, sim, cov, prior, depth, conflict, ok, admin, deep, single_dist, one row for each stored chain.
    candidates: candidate, params (map), a stated set. Chains are ranked once for each different set of weights;
    candidates that differ in thresholds alone share a ranking and meet one row for each id.
    """
    p = lambda n: F.coalesce(F.col("params")[n], F.lit(PARAMS[n]))
    keyed = candidates.withColumn("_w", F.struct(*[p(w).alias(w) for w in TERMS.values()]))
    each = features.crossJoin(F.broadcast(keyed.select("_w").distinct()))
    total = sum((F.col(f"_w.{w}") * F.col(t) * (-1 if t == "conflict" else 1) for t, w in TERMS.items()), F.lit(0.0))
    w = W.partitionBy("_w", "id").orderBy(F.desc("total"), "chain")
    ranked = each.withColumn("total", total).withColumns({"rank": F.row_number().over(w), "next": F.lead("total").over(w), "next_admin": F.lead("admin").over(w)}).where("rank = 1")
    top = ranked.join(F.broadcast(keyed), "_w")
    margin = F.when(F.col("next").isNull(), 1.0).otherwise(F.col("total") - F.col("next"))
    differs = F.coalesce(F.col("next_admin") != F.col("admin"), F.lit(False))
    decision = decide(F.col("sim"), F.col("cov"), F.col("single_dist"), F.col("deep"), margin, F.col("next").isNotNull(), differs, p)
    return top.select("candidate", "id", decision.alias("decision"), "ok", "total", margin.alias("margin"))


def featurized(rows: DataFrame) -> DataFrame:
    """Stored features of outcomes (plans.evaluate.outcomes): id, chain, name, sim, cov, prior, depth, conflict, ok, admin, deep, n_ev, single_dist, total_live, decision_live; one row for each ranked chain.

    ok tolerates gold places that the gazetteer lacks (stages.chain_ok). All chains are kept, so any weights can be
    replayed without resolving again.
    """
    each = rows.select("id", F.col("decision").alias("decision_live"), "fields", "g", *([c] if (c := "has_address") in rows.columns else []), F.explode("nbest").alias("c"))
    gold = {a: F.col(f"g.{a}_code") for a in stages.ADMIN}
    names = F.array(*[F.coalesce(F.col(f"fields.{k}"), F.lit("")) for k in stages.GEO])
    has = F.col("has_address") if "has_address" in rows.columns else F.lit(True)
    low = F.transform(F.filter("c.evidence", lambda h: ~h["main"]), lambda h: F.struct(h["level"].alias("level"), h["adcode"].alias("code"), h["name"].alias("name")))
    entries = F.concat(F.transform("c.entries", lambda e: F.struct(e["level"].alias("level"), e["code"].alias("code"), e["name"].alias("name"))), low)
    ok = stages.chain_ok(F.col("c.all_codes"), entries, gold, F.col("g.deepest_code"), F.coalesce("g.road_codes", F.array().cast("array<string>")), names, has)
    r = lambda c: F.round(F.col(c), 6)
    return each.select(
        "id", F.col("c.rank").alias("chain"), F.col("c.name").alias("name"), r("c.sim").alias("sim"), r("c.coverage").alias("cov"), r("c.prior").alias("prior"), r("c.depth").alias("depth"), r("c.conflict").alias("conflict"),
        ok.alias("ok"), F.col("c.admin").alias("admin"), F.col("c.deep").alias("deep"), F.col("c.n_evidence").alias("n_ev"), r("c.single_dist").alias("single_dist"), r("c.total").alias("total_live"), "decision_live",
    )


def selected(features: DataFrame, items: DataFrame, **where: object) -> DataFrame:
    """Features of the items (id and axes) whose axes have the given values; None asks for null."""
    kept = items
    for k, v in where.items():
        kept = kept.where(F.col(k).isNull() if v is None else F.col(k) == v)
    return features.join(kept.select("id"), "id", "left_semi")


def drafts_out(items: DataFrame, strict: bool) -> DataFrame:
    """items without those whose label is a draft, if strict."""
    return items.where(F.coalesce(F.col("label_status") != "draft", F.lit(True))) if strict else items


#: What a false accept, a false reject, a right rejection and a miss cost.
COSTS = {"fa": 10.0, "fr": 1.0, "tr": 1.0, "miss": 0.0}


def metrics(features: DataFrame, candidates: DataFrame, costs: dict[str, float] | None = None, ridge: float = 0.0, items: DataFrame | None = None, hand: dict[str, float] | None = None) -> DataFrame:
    """candidate with its quadrants, em_proxy (the share whose top chain is right, delivered or not), cost and J: mean cost plus ridge times the parameters' distance from the hand-set ones.

    Items without any chain count as rejected, right if they are in items; with items (id, negative_type, has_address)
    also oov_fa and neg_fa, the false accepts among those with missing places and among those without an address.
    """
    costs = COSTS | (costs or {})
    told = replay(features, candidates).withColumn("q", quadrant(F.col("decision"), F.col("ok")))
    extra = []
    if items is not None:
        known = items.select("id", *[F.col(c) if c in items.columns else F.lit(None).alias(c) for c in ("negative_type", "has_address")])
        told = known.crossJoin(F.broadcast(candidates.select("candidate"))).join(told, ["candidate", "id"], "left").withColumn("q", F.coalesce("q", F.lit("TR")))
        extra = [F.count_if((F.col("q") == "FA") & (F.col("negative_type") == "oov_db")).alias("oov_fa"), F.count_if((F.col("q") == "FA") & ~F.coalesce(F.col("has_address").cast("boolean"), F.lit(True))).alias("neg_fa")]
    q = quadrants(told, ["candidate"], F.col("q"))
    if extra:
        q = q.join(told.groupBy("candidate").agg(*extra), "candidate")
    n = F.col("tp") + F.col("fa") + F.col("fr") + F.col("tr")
    cost = (costs["fa"] * F.col("fa") + costs["fr"] * F.col("fr") + (costs["tr"] + costs["miss"]) * F.col("tr")) / n
    near = PARAMS if hand is None else {**PARAMS, **hand}
    far = sum((F.abs(F.coalesce(F.col("params")[k], F.lit(PARAMS[k])) - near[k]) for k in REPLAYABLE), F.lit(0.0))
    return q.join(F.broadcast(candidates), "candidate").withColumns({"n": n, "em_proxy": (F.col("tp") + F.col("fr")) / n, "cost": cost, "J": cost + ridge * far})


def as_candidates(spark: SparkSession, points: list[dict[str, float]]) -> DataFrame:
    return spark.createDataFrame([(k, {n: float(v) for n, v in p.items()}) for k, p in enumerate(points)], "candidate int, params map<string,double>")


def moved(point: dict[str, float], name: str, value: float) -> dict[str, float]:
    """point with one parameter moved; the four weights keep their sum of 1."""
    out = {**PARAMS, **point, name: value}
    if name in SIMPLEX:
        rest = sum(out[n] for n in SIMPLEX if n != name)
        for n in SIMPLEX:
            if n != name:
                out[n] = (1 - value) * (out[n] / rest if rest else 1 / 3)
    return out


def steps(lo: float, hi: float, step: float) -> list[float]:
    """lo to hi by step, both ends included."""
    return [round(lo + k * step, 6) for k in range(round((hi - lo) / step) + 1)]


def search_grid(bounds: dict[str, tuple[float, float]], weight_points: int = 21, threshold_step: float = 0.02) -> dict[str, list[float]]:
    """The values of each parameter that a search tries, within its bounds."""
    shares = [k / (weight_points - 1) for k in range(weight_points)]
    return {k: [v for v in shares if lo - 1e-9 <= v <= hi + 1e-9] if k in SIMPLEX else steps(lo, hi, threshold_step) for k, (lo, hi) in bounds.items()}


def starts(hand: dict[str, float], bounds: dict[str, tuple[float, float]], restarts: int = 20, seed: int = 0) -> list[dict[str, float]]:
    """Where a search begins: the hand-set point, then seeded ones: weights drawn from the simplex, thresholds from their bounds."""
    draw = np.random.default_rng(seed)
    out = [dict(hand)]
    for _ in range(restarts - 1):
        weights = dict(zip(SIMPLEX, draw.dirichlet(np.ones(len(SIMPLEX))).tolist()))
        out.append({**hand, **weights, **{k: float(draw.uniform(*bounds[k])) for k in REPLAYABLE if k not in SIMPLEX and k in bounds}})
    return out


def descend(features: DataFrame, grid: dict[str, list[float]], begin: list[dict[str, float]], sweeps: int = 5, ridge: float = 0.0, costs: dict[str, float] | None = None, hand: dict[str, float] | None = None) -> list[tuple[dict[str, float], float, int]]:
    """For each start the point that sweeps over the grid's parameters end in, its J and the sweeps it took.

    All starts move together: for a parameter, all values of all starts are one job over the features, and only a row for
    each comes back. A start moves only to a lower J; of equal ones the value nearest to its own. One that a sweep
    doesn't move is done.
    """
    spark = features.sparkSession

    def values(points: list[dict[str, float]]) -> list[float]:
        found = {r.candidate: r.J for r in metrics(features, as_candidates(spark, points), costs, ridge, hand=hand).select("candidate", "J").collect()}
        return [found.get(k, 0.0) for k in range(len(points))]

    here = [{**PARAMS, **p} for p in begin]
    best, taken, live = values(here), [0] * len(here), list(range(len(here)))
    for _ in range(sweeps):
        if not live:
            break
        still = set()
        for k in live:
            taken[k] += 1
        for name, options in grid.items():
            tried = [(k, v, moved(here[k], name, v)) for k in live for v in options]
            told = values([p for _, _, p in tried])
            for k in live:
                own = [(round(j, 12), abs(v - here[k][name]), i) for i, ((o, v, _), j) in enumerate(zip(tried, told)) if o == k]
                j, _, i = min(own)
                if told[i] < best[k] - 1e-12:
                    here[k], best[k] = tried[i][2], told[i]
                    still.add(k)
        live = [k for k in live if k in still]
    return list(zip(here, best, taken))


def coordinate_descent(features: DataFrame, grid: dict[str, list[float]], start: dict[str, float] | None = None, sweeps: int = 5, ridge: float = 0.0, costs: dict[str, float] | None = None) -> tuple[dict[str, float], float]:
    """The point that one start ends in, and its J."""
    (point, j, _), *_ = descend(features, grid, [dict(start or PARAMS)], sweeps, ridge, costs)
    return point, j


def search(features: DataFrame, hand: dict[str, float], bounds: dict[str, tuple[float, float]], grid: dict[str, list[float]] | None = None, restarts: int = 20, seed: int = 0, sweeps: int = 5, ridge: float = 0.0, costs: dict[str, float] | None = None, top: int = 5) -> dict:
    """best, best_J and the top distinct optima (J, start, sweeps, params) of a search from several starts. Ties go to the earlier start."""
    found = descend(features, search_grid(bounds) if grid is None else grid, starts(hand, bounds, restarts, seed), sweeps, ridge, costs, hand)
    order = sorted(range(len(found)), key=lambda k: (round(found[k][1], 12), k))
    short = lambda p: {k: round(p[k], 4) for k in REPLAYABLE}
    optima: list[dict] = []
    for k in order:
        point, j, took = found[k]
        if len(optima) < top and short(point) not in [o["params"] for o in optima]:
            optima.append({"J": round(j, 6), "start": k, "sweeps": took, "params": short(point)})
    return {"best": found[order[0]][0], "best_J": found[order[0]][1], "top_optima": optima, "n_starts": len(found)}


def flatness(features: DataFrame, point: dict[str, float], grid: dict[str, list[float]], costs: dict[str, float] | None = None) -> DataFrame:
    """key, at, value, here: the cost along each parameter's grid through a point, for evaluation.flat_share; here marks the value nearest to the point's."""
    spark = features.sparkSession
    rows = [(k, v, moved(point, k, v), abs(v - point[k]) == min(abs(x - point[k]) for x in options)) for k, options in grid.items() for v in options]
    told = metrics(features, as_candidates(spark, [p for _, _, p, _ in rows]), costs).select("candidate", F.round("cost", 12).alias("value"))
    keys = spark.createDataFrame([(i, k, float(v), here) for i, (k, v, _, here) in enumerate(rows)], "candidate int, key string, at double, here boolean")
    return keys.join(told, "candidate").drop("candidate")


def slice_deltas(features: DataFrame, items: DataFrame, before: dict[str, float], after: dict[str, float], axes: tuple[str, ...]) -> DataFrame:
    """axis, value, n, tp and fa under both points, delta_tp, delta_fa of each slice of items (id and axes); values that are null make no slice."""
    both = as_candidates(features.sparkSession, [before, after])
    told = items.crossJoin(F.broadcast(both.select("candidate"))).join(replay(features, both), ["candidate", "id"], "left")
    q = quadrant(F.coalesce("decision", F.lit("reject")), F.coalesce("ok", F.lit(False)))
    cells = F.filter(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).cast("string").alias("value")) for a in axes]), lambda x: x["value"].isNotNull())
    each = told.select("candidate", q.alias("q"), F.explode(cells).alias("c"))
    n = lambda k, x: F.count_if((F.col("candidate") == k) & (F.col("q") == x))
    out = each.groupBy("c.axis", "c.value").agg(F.count_if(F.col("candidate") == 0).alias("n"), *[n(k, x).alias(f"{x.lower()}_{w}") for k, w in ((0, "before"), (1, "after")) for x in ("TP", "FA")])
    return out.withColumns({"delta_tp": F.col("tp_after") - F.col("tp_before"), "delta_fa": F.col("fa_after") - F.col("fa_before")})


def constraints(before: dict, after: dict, deltas: DataFrame, enough: bool, least: int = 20) -> dict[str, bool]:
    """The six conditions that a proposal must meet on held-out rows. before, after: rows of metrics() with items."""
    worse = deltas.where((F.col("n") >= least) & (F.col("delta_tp") < 0)).limit(1).count()
    or_zero = lambda r, k: r[k] or 0
    return {
        "eval_em_not_lower": or_zero(after, "em_proxy") >= or_zero(before, "em_proxy"), "eval_risk_not_higher": or_zero(after, "risk") <= or_zero(before, "risk"), "oov_fa_not_higher": after["oov_fa"] <= before["oov_fa"],
        "no_address_fa_not_higher": after["neg_fa"] <= before["neg_fa"], "no_slice_loses_tp": worse == 0, "sample_gate": enough,
    }


def verdict(met: dict[str, bool], confirmed: bool | None = None, regression_ok: bool | None = None) -> str:
    """REJECTED if a hard condition fails or a confirming run regressed; APPLICABLE only if samples suffice and a confirming run passed; else REPORT_ONLY."""
    if not all(ok for k, ok in met.items() if k != "sample_gate") or regression_ok is False:
        return "REJECTED"
    return "APPLICABLE" if met["sample_gate"] and confirmed and regression_ok else "REPORT_ONLY"


def propose(features: DataFrame, items: DataFrame, hand: dict[str, float], bounds: dict[str, tuple[float, float]], axes: tuple[str, ...], enough: bool, grid: dict[str, list[float]] | None = None, **options) -> dict:
    """A proposal: what a search over the train split finds, held against the hand-set point on the eval split. items: id, split and axes.

    best, J before and after, changed parameters, metrics of both points on both splits, slice deltas, constraints and verdict.
    """
    part = lambda split: (selected(features, items, split=split), items.where(F.col("split") == split))
    (train, train_items), (held, held_items) = part("train"), part("eval")
    grid = search_grid(bounds) if grid is None else grid
    found = search(train, hand, bounds, grid, **options)
    point = {**hand, **found["best"]}
    both = as_candidates(features.sparkSession, [hand, point])
    told = {name: {r.candidate: r.asDict() for r in metrics(f, both, options.get("costs"), items=i, hand=hand).drop("params").collect()} for name, f, i in (("train", train, train_items), ("eval", held, held_items))}
    deltas = slice_deltas(held, held_items, hand, point, axes)
    met = constraints(told["eval"][0], told["eval"][1], deltas, enough) if told["eval"] else {"sample_gate": False}
    return {**found, "params": point, "J": {"hand": told["train"].get(0, {}).get("J"), "proposed": found["best_J"]}, "changed": {k: (hand[k], point[k]) for k in REPLAYABLE if abs(hand[k] - point[k]) > 1e-9}, "metrics": told, "deltas": [r.asDict() for r in deltas.orderBy("axis", "value").collect()], "constraints": met, "verdict": verdict(met)}


def proposal_text(p: dict) -> str:
    """A proposal for people, as Markdown."""
    lines = ["# Proposal", "", f"Verdict: {p['verdict']}; J {p['J']['hand']} to {p['J']['proposed']}", "", "| parameter | hand | proposed |", "|---|---|---|"]
    lines += [f"| {k} | {a:.4f} | {b:.4f} |" for k, (a, b) in p["changed"].items()] + ["", "| constraint | met |", "|---|---|"]
    lines += [f"| {k} | {'yes' if ok else 'no'} |" for k, ok in p["constraints"].items()] + ["", "| slice | n | delta TP | delta FA |", "|---|---|---|---|"]
    return "\n".join([*lines, *[f"| {d['axis']}={d['value']} | {d['n']} | {d['delta_tp']} | {d['delta_fa']} |" for d in p["deltas"]]]) + "\n"


def divergence(real: DataFrame, replayed: DataFrame) -> DataFrame:
    """source, n, diverged: items whose quadrant in a real run (source, id, q) differs from the replayed one (id 'source:id', q)."""
    keyed = real.select("source", F.concat_ws(":", "source", F.col("id").cast("string")).alias("id"), F.col("q").alias("_real"))
    return keyed.join(replayed.select("id", "q"), "id").groupBy("source").agg(F.count("*").alias("n"), F.count_if(~F.col("_real").eqNullSafe(F.col("q"))).alias("diverged"))


def perturbations(names: DataFrame, readings: DataFrame, costs: DataFrame, per_name: int = 3, seed: int = 0) -> DataFrame:
    """Misheard variants of names (id, name): id, variant, pos, was, became, rule; per_name of each, chosen by a seeded hash.

    A character is replaced by one that reads the same (rule 'homophone') or whose initial or final a confusion rule
    exchanges. Characters (ch, ini, fin) and rules are dimension tables; positions are joined with what may replace them.
    """
    at = names.select("id", "name", F.posexplode(F.filter(F.split("name", ""), lambda c: c != "")).alias("pos", "was"))
    old = at.join(readings.select(F.col("ch").alias("was"), F.col("ini").alias("i"), F.col("fin").alias("f")), "was")
    new = readings.select(F.col("ch").alias("became"), F.col("ini").alias("i2"), F.col("fin").alias("f2"))
    same = old.join(new, (F.col("i") == F.col("i2")) & (F.col("f") == F.col("f2")) & (F.col("was") != F.col("became"))).withColumn("rule", F.lit("homophone"))
    pair = lambda kind: costs.where(F.col("kind") == kind).select(F.col("a"), F.col("b"))
    first = old.join(pair("initial"), F.col("i") == F.col("a")).join(new, (F.col("b") == F.col("i2")) & (F.col("f") == F.col("f2"))).withColumn("rule", F.concat_ws("-", F.lit("initial"), "a", "b")).drop("a", "b")
    last = old.join(pair("final"), F.col("f") == F.col("a")).join(new, (F.col("b") == F.col("f2")) & (F.col("i") == F.col("i2"))).withColumn("rule", F.concat_ws("-", F.lit("final"), "a", "b")).drop("a", "b")
    every = same.unionByName(first).unionByName(last)
    variant = F.concat(F.substring("name", F.lit(1), F.col("pos")), F.col("became"), F.substring("name", F.col("pos") + 2, F.length("name")))
    w = W.partitionBy("id").orderBy(F.xxhash64(F.lit(seed), "id", "variant"), "variant", "rule")
    return every.withColumn("variant", variant).dropDuplicates(["id", "variant"]).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= per_name).select("id", "variant", "pos", "was", "became", "rule")


def replayable(variants: DataFrame, names: DataFrame) -> DataFrame:
    """Variants that don't follow from their name by putting back the one replaced character."""
    back = F.concat(F.substring("variant", F.lit(1), F.col("pos")), F.col("was"), F.substring("variant", F.col("pos") + 2, F.length("variant")))
    return variants.join(names, "id").where(back != F.col("name"))
