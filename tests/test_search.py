import random

from pyspark.sql import functions as F

from veldspar.functions import phonetics
from veldspar.operators import search
from veldspar.operators.ranking import PARAMS

FEATURES = "id int, chain int, sim double, cov double, prior double, depth double, conflict double, ok boolean, admin string, deep boolean, single_dist double"


def features(spark):
    r = random.Random(2)
    rows = []
    for i in range(80):
        good = r.randrange(2)
        for c in range(2):
            ok = c == good
            rows.append((i, c, 0.9, 0.9 if ok else 0.2, 0.1 if ok else 0.9, 1.0, 0.0, ok, str(c), True, None))
    return spark.createDataFrame(rows, FEATURES)


def decide(p, top, second):
    total = lambda x: p["W_SIM"] * x[2] + p["W_COV"] * x[3] + p["W_PRIOR"] * x[4] + p["W_DEPTH"] * x[5] - p["W_CONFLICT"] * x[6]
    if top[2] < p["SIM_MIN"]:
        return "reject"
    return "ambiguous" if total(top) - total(second) < p["MARGIN_MIN"] else "confident"


def test_replay_agrees_with_plain_code(spark):
    df = features(spark)
    points = [{}, {"MARGIN_MIN": 0.3}, {"SIM_MIN": 0.95}, {"W_PRIOR": 0.6, "W_COV": 0.0}]
    got = {(r.candidate, r.id): r for r in search.replay(df, search.as_candidates(spark, points)).collect()}
    by = {}
    for r in df.collect():
        by.setdefault(r.id, []).append(r)
    for k, point in enumerate(points):
        p = {**PARAMS, **point}
        total = lambda x: p["W_SIM"] * x.sim + p["W_COV"] * x["cov"] + p["W_PRIOR"] * x.prior + p["W_DEPTH"] * x.depth  # noqa: E731, B023
        for i, chains in by.items():
            top, second = sorted(chains, key=lambda x: (-total(x), x.chain))
            assert got[k, i].decision == decide(p, top, second) and got[k, i].ok == top.ok


def test_search_finds_the_telling_weight(spark):
    df = features(spark)
    start = {**PARAMS, "W_SIM": 0.1, "W_COV": 0.1, "W_PRIOR": 0.7, "W_DEPTH": 0.1}
    point, j = search.coordinate_descent(df, {"W_PRIOR": [0.0, 0.2, 0.7], "W_COV": [0.1, 0.5]}, start, sweeps=3)
    assert j == 0 and abs(sum(point[n] for n in search.SIMPLEX) - 1) < 1e-9
    flat, _ = search.coordinate_descent(df, {"W_CONFLICT": [0.0, 0.5]}, PARAMS, sweeps=1)
    assert flat["W_CONFLICT"] == PARAMS["W_CONFLICT"]
    good = dict.fromkeys(("eval_em_not_lower", "eval_risk_not_higher", "oov_fa_not_higher", "no_address_fa_not_higher", "no_slice_loses_tp", "sample_gate"), True)
    assert search.verdict(good) == "REPORT_ONLY" and search.verdict(good, True, True) == "APPLICABLE" and search.verdict(good, True, False) == "REJECTED"
    assert search.verdict(good | {"sample_gate": False}, True, True) == "REPORT_ONLY" and search.verdict(good | {"oov_fa_not_higher": False}, True, True) == "REJECTED"


def test_search_from_many_starts(spark):
    df = features(spark)
    bounds = {"W_SIM": (0.0, 1.0), "W_COV": (0.0, 1.0), "W_PRIOR": (0.0, 1.0), "W_DEPTH": (0.0, 1.0), "MARGIN_MIN": (0.0, 0.1), "SIM_MIN": (0.5, 0.7)}
    begin = search.starts(PARAMS, bounds, 4, 1)
    assert begin == search.starts(PARAMS, bounds, 4, 1) and all(abs(sum(p[n] for n in search.SIMPLEX) - 1) < 1e-9 for p in begin)
    hand = {**PARAMS, "W_SIM": 0.1, "W_COV": 0.1, "W_PRIOR": 0.7, "W_DEPTH": 0.1}
    got = search.search(df, hand, bounds, search.search_grid(bounds, 3, 0.1), restarts=4, seed=1, sweeps=2)
    assert got["best_J"] == 0 and got["n_starts"] == 4 and 1 <= len(got["top_optima"]) <= 4
    assert len({tuple(o["params"].items()) for o in got["top_optima"]}) == len(got["top_optima"])
    flat = {r.key: r for r in search.flatness(df, got["best"], {"W_CONFLICT": [0.0, 0.25, 0.5]}).groupBy("key").agg(F.countDistinct("value").alias("n"), F.count_if("here").alias("here")).collect()}
    assert flat["W_CONFLICT"].n == 1 and flat["W_CONFLICT"].here == 1


def test_slices_and_constraints(spark):
    df = features(spark)
    items = df.select("id").distinct().select("id", F.when(F.col("id") % 2 == 0, "even").otherwise("odd").alias("side"), F.lit(None).cast("string").alias("rule"), F.when(F.col("id") < 5, "oov_db").alias("negative_type"), (F.col("id") != 7).alias("has_address"))
    bad = {**PARAMS, "W_COV": 0.0, "W_PRIOR": 0.6}
    rows = {(r.axis, r.value): r for r in search.slice_deltas(df, items, PARAMS, bad, ("side", "rule")).collect()}
    assert set(rows) == {("side", "even"), ("side", "odd")} and all(r.n == 40 and r.delta_tp == r.tp_after - r.tp_before <= 0 for r in rows.values())
    both = {r.candidate: r.asDict() for r in search.metrics(df, search.as_candidates(spark, [PARAMS, bad]), items=items).collect()}
    assert both[0]["n"] == 80 and both[1]["oov_fa"] >= both[0]["oov_fa"] and both[0]["em_proxy"] == 1.0
    met = search.constraints(both[0], both[1], search.slice_deltas(df, items, PARAMS, bad, ("side",)), True)
    assert not met["eval_em_not_lower"] and met["sample_gate"] and len(met) == 6
    assert search.selected(df, items, side="even", rule=None).select("id").distinct().count() == 40


def test_perturbations_are_replayable_and_steady(spark):
    letters = spark.createDataFrame([("南", "nan"), ("兰", "lan"), ("蓝", "lan"), ("山", "shan"), ("三", "san"), ("路", "lu")], "ch string, raw string")
    readings = letters.select("ch", phonetics.split_syllable(F.col("raw")).alias("s")).select("ch", "s.ini", "s.fin")
    costs = phonetics.confusion_costs(phonetics.confusion_rules(spark).where("space = 'mandarin'"))
    names = spark.createDataFrame([(1, "南山路"), (2, "路")], "id int, name string")
    got = search.perturbations(names, readings, costs, 10).collect()
    assert {(r.variant, r.rule) for r in got} == {("兰山路", "initial-n-l"), ("蓝山路", "initial-n-l"), ("南三路", "initial-sh-s")}
    assert sorted(got) == sorted(search.perturbations(names, readings, costs, 10).collect())
    assert search.replayable(spark.createDataFrame(got), names).count() == 0


def test_a_proposal_is_judged_on_held_out_items(spark):
    df = features(spark)
    items = df.select("id").distinct().select("id", F.when(F.col("id") % 2 == 0, "train").otherwise("eval").alias("split"), F.lit("x").alias("side"), F.lit(None).cast("string").alias("negative_type"), F.lit(True).alias("has_address"))
    hand = {**PARAMS, "W_SIM": 0.1, "W_COV": 0.1, "W_PRIOR": 0.7, "W_DEPTH": 0.1}
    bounds = {"W_COV": (0.0, 1.0), "W_PRIOR": (0.0, 1.0)}
    got = search.propose(df, items, hand, bounds, ("side",), True, {"W_PRIOR": [0.0, 0.7], "W_COV": [0.1, 0.5]}, restarts=2, sweeps=2)
    assert got["best_J"] == 0 < got["J"]["hand"] and got["verdict"] == "REPORT_ONLY" and all(got["constraints"].values()) and got["deltas"][0]["n"] == 40
    assert "Verdict: REPORT_ONLY" in search.proposal_text(got) and "| side=x | 40 |" in search.proposal_text(got)


def test_only_the_cache_may_be_read(spark):
    import pytest

    from veldspar.operators import quality

    cache = spark.createDataFrame([("a", "text")], "key string, transcript string")
    assert quality.require_cached(spark.createDataFrame([("a",)], "key string"), cache).count() == 1
    with pytest.raises(LookupError):
        quality.require_cached(spark.createDataFrame([("a",), ("b",)], "key string"), cache)
