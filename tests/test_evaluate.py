import pytest
from pyspark.sql import functions as F

from veldspar.functions import phonetics
from veldspar.operators import evaluation as ev
from veldspar.operators import ranking as rk
from veldspar.operators import search
from veldspar.plans import evaluate, resolve

from test_assemble import PLACES

FIELDS = ("province", "city", "district", "street", "road", "community", "house_no", "building", "unit", "room")
#: id, text, address, gold fields, axes
ITEMS = [
    ("a", "我屋头在成都市武侯区二环路南四段三十号", "四川省成都市武侯区二环路南四段30号", {"province": "四川省", "city": "成都市", "district": "武侯区", "road": "二环路南四段", "house_no": "30号"}, "xinan", ["long"], True),
    ("b", "重庆渝中区民权路八号", "重庆市渝中区民权路8号", {"province": "重庆市", "city": "重庆市", "district": "渝中区", "road": "民权路", "house_no": "8号"}, "xinan", [], True),
    ("c", "成都锦江区碧园街十号", "四川省成都市锦江区碧园街10号", {"province": "四川省", "city": "成都市", "district": "锦江区", "road": "碧园街", "house_no": "10号"}, "wu", ["long", "oov"], True),
    ("d", "今天天气不错", "", {}, "wu", [], False),
    ("e", "武侯区二环路南四段一百二号", "四川省成都市武侯区二环路南四段120号", {"province": "四川省", "city": "成都市", "district": "武侯区", "road": "二环路南四段", "house_no": "120号"}, None, [], True),
    ("f", "成都锦江区春熙路五号", "四川省成都市锦江区春熙路6号", {"province": "四川省", "city": "成都市", "district": "锦江区", "road": "春熙路", "house_no": "6号"}, "wu", [], True),
]


@pytest.fixture(scope="module")
def run(spark):
    places = spark.createDataFrame([(c, n, lv, p, a, q, k) for k, (c, n, lv, p, a, q) in enumerate(PLACES)], "adcode string, name string, level string, parent string, aliases array<string>, prior double, ord int")
    kind = ", ".join(f"{f} string" for f in FIELDS)
    rows = [(i, t, a, tuple(g.get(f, "") for f in FIELDS), d, x, h, "oov_db" if i == "c" else None) for i, t, a, g, d, x, h in ITEMS]
    items = spark.createDataFrame(rows, f"id string, spoken string, ground_truth string, fields struct<{kind}>, dialect_group string, difficulty array<string>, has_address boolean, negative_type string")
    letters = {c for p in PLACES for c in p[1] + "".join(p[4])} | {c for x in ITEMS for c in x[1] if "一" <= c <= "鿿"}
    readings = phonetics.char_readings(spark, letters, {"都": "du", "重": "chong"})
    costs = phonetics.confusion_costs(phonetics.confusion_rules(spark).where("space = 'mandarin'"))
    return items, places, readings, costs


@pytest.fixture(scope="module")
def rows(run):
    return evaluate.evaluated(evaluate.outcomes(*run)).cache()


def test_stages_and_attribution(rows):
    got = {r.id: r for r in rows.collect()}
    for k in "abe":
        r = got[k]
        assert (r.e2e.exact, r.quadrant, r.recall_1, r.top1, r.mrr, r.b.ok, r.attribution) == (True, "TP", True, True, 1.0, True, None), r
    assert got["e"].f.backfill and set(got["e"].f.backfilled) == {"province", "city"} and got["a"].f is None
    c = got["c"]
    assert c.g.missing == ["碧园街"] and not c.g.evaluable and not c.g.in_db and c.oov_preserved and c.recall_all is None
    d = got["d"]
    assert (d.decision, d.quadrant, d.attribution) == ("reject", "TR", None)
    f = got["f"]
    assert (f.e2e.exact, f.e2e.tail_all, f.quadrant, f.quadrant_geo, f.gate_blame, f.b.tail_fields, f.attribution) == (False, False, "FA", "TP", "tail", ["building", "unit", "room"], "normalize_error")
    assert f.e2e.severity == "tail" and f.attribution_detail


def test_summary_and_report(spark, rows):
    summary = evaluate.summarized(rows)
    got = {(r.axis, r.value): r for r in summary.collect()}
    every = got["all", "all"]
    assert every.n == 6 and every.exact_n == 6 and every.tp + every.fa + every.fr + every.tr == 6 and every.tp == 4 and every.fa == 1
    assert got["dialect_group", "wu"].n == 3 and got["dialect_group", "null"].n == 1 and got["difficulty", "long"].n == 2
    assert every.recall_all_k == every.recall_all_n == 4 and got["negative_type", "oov_db"].preserved == 1
    text = evaluate.render(summary, evaluate.histograms(rows), "Run", {"rows": "6"}, changes=spark.createDataFrame([], "axis string"))
    assert text.startswith("# Run") and "| dialect_group | wu | 3 |" in text and "normalize_error" in text and "No slice changed." in text


def test_oracles_do_no_worse(run, tmp_path):
    configs = {k: evaluate.CONFIGS[k] for k in ("baseline", "current", "oracle gate")}
    table, rows = evaluate.oracle_table(*run, str(tmp_path), configs)
    got = {r.config: r for r in table.collect()}
    assert set(got) == set(configs) and got["baseline"].exact_k == 0 and got["baseline"].coverage == 1.0
    assert got["current"].exact_k <= got["oracle gate"].exact_k and got["oracle gate"].risk <= got["current"].risk
    assert evaluate.oracle_violations(table).count() == 0
    assert rows.count() == len(configs) * len(ITEMS)


def test_gold_places_are_put_in_once(run):
    items, places, *_ = run
    more = evaluate.places_with_gold(places, items).join(places, "adcode", "left_anti").collect()
    assert [(r.name, r.parent, r.level) for r in more] == [("碧园街", "jj", "road")]


def test_replayed_features_agree_with_the_run(spark, rows):
    features = search.featurized(rows)
    live = {r.id: r.decision for r in rows.where("size(nbest) > 0").collect()}
    got = {r.id: r for r in search.replay(features, search.as_candidates(spark, [{}])).collect()}
    assert {k: r.decision for k, r in got.items()} == live
    assert got["a"].ok and got["e"].ok and not got["d"].ok if "d" in got else got["a"].ok
    points = ev.grid_scan(evaluate.replay_columns(rows), spark.createDataFrame(evaluate.GRID, "margin_min double, sim_min double"), (rk.PARAMS["MARGIN_MIN"], 0.615))
    assert points.count() == len(evaluate.GRID) + 1
    here = points.where("abs(sim_min - 0.615) < 1e-9").head()
    assert here.tp + here.fa == sum(d == "confident" for k, d in live.items() if k != "d") and here.tp + here.fa + here.fr + here.tr == 5
    assert ev.rises(points, "margin_min", "sim_min").count() == 0


def test_a_hook_sees_the_ranking_before_the_gates(run):
    items, places, readings, costs = run
    docs = items.select(F.col("id").alias("doc_id"), F.col("spoken").alias("text"))
    strict = resolve.resolve_chains(docs, places, readings, costs, hook=lambda ranked: ranked.withColumn("sim", F.lit(0.0)))
    assert strict.where("decision = 'confident'").count() == 0
    shown = {r.doc_id: r.lines for r in evaluate.explained(resolve.resolve_chains(docs, places, readings, costs)).collect()}
    assert shown["a"].startswith("confident\n四川省成都市武侯区二环路南四段") and shown["d"] == "reject"


def test_json(rows):
    import json

    got = {r.id: json.loads(r.json) for r in evaluate.result_json(rows).collect()}
    assert got["a"]["address"] == ITEMS[0][2] and got["a"]["nbest"][0]["hits"] and got["a"]["fields"]["road"] == "二环路南四段"


def test_sound_metrics(run):
    items, places, readings, costs = run
    from veldspar.operators import stages as st

    gold = st.gold_chain(items.select("id", *[F.coalesce(F.col(f"fields.{k}"), F.lit("")).alias(k) for k in ("province", "city", "district", "street", "road", "community")]), places)
    got = {r.id: r for r in evaluate.sound_metrics(items.withColumn("transcript_gold", F.col("spoken")), gold, places, readings, costs).collect()}
    assert set(got) == {x[0] for x in ITEMS} and got["a"].cer_name_char == got["a"].name_phon_dist_max == 0 and got["a"].recoverable_share is None
    assert got["d"].name_phon_dist_max is None and got["c"].cer_name_char == 0 and got["a"].cer_phon == got["a"].cer_char == 0


def test_every_sabotage_is_blamed(spark, rows, run, tmp_path):
    evaluate.outcomes(*run).write.parquet(str(tmp_path / "o"))
    table = spark.read.parquet(str(tmp_path / "o"))
    for name, case in evaluate.sabotage().items():
        r = evaluate.selfcheck(table, {name: case}).head()
        assert r.raised, r


def test_steps_stop_at_the_first_failure():
    ran = []
    got = evaluate.run_steps([("a", lambda: ran.append(1)), ("b", lambda: 1 / 0), ("c", lambda: ran.append(2))])
    assert [(n, ok) for n, ok, _ in got] == [("a", True), ("b", False)] and "ZeroDivisionError" in got[1][2] and ran == [1]
