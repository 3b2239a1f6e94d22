import pytest
from pyspark.sql import functions as F

from veldspar.functions import phonetics
from veldspar.operators import generate as g

LETTERS = {"南": "nan", "男": "nan", "兰": "lan", "蓝": "lan", "山": "shan", "删": "shan", "三": "san", "伞": "san", "路": "lu", "鹿": "lu", "成": "cheng", "程": "cheng", "陈": "chen", "都": "du", "市": "shi", "是": "shi", "四": "si"}
FIELDS = ("district", "street", "road", "community", "city", "province")


@pytest.fixture(scope="module")
def parts(spark):
    readings = spark.createDataFrame(list(LETTERS.items()), "ch string, raw string").select("ch", "raw", phonetics.split_syllable(F.col("raw")).alias("s")).select("ch", "raw", "s.ini", "s.fin")
    rules = g.named_rules(phonetics.confusion_rules(spark).where("space = 'mandarin'"))
    counts = g.char_counts(spark.createDataFrame([("南山路三号成都市",), ("男女都是成人",)], "p string"), "p")
    rows = [("i1", "我家在成都市南山路三号", {"city": "成都市", "road": "南山路"}), ("i2", "南山", {"road": "南山路"}), ("i3", "没有地名", {"road": "x"}), ("i4", "", {})]
    items = spark.createDataFrame([(i, t, tuple(f.get(k, "") for k in FIELDS)) for i, t, f in rows], f"id string, spoken string, fields struct<{', '.join(f'{k} string' for k in FIELDS)}>")
    return items, readings, rules, counts


def test_places_that_may_change(parts):
    items, readings, _, _ = parts
    got = {(r.id, r.pos, r.was) for r in g.positions(items, readings).collect()}
    assert got == {("i1", 3, "成"), ("i1", 4, "都"), ("i1", 6, "南"), ("i1", 7, "山"), ("i2", 0, "南"), ("i2", 1, "山")}
    spans = {(r.id, r.s, r.e, r.surface) for r in g.name_spans(items).collect()}
    assert spans == {("i1", 3, 6, "成都市"), ("i1", 6, 9, "南山路"), ("i2", 0, 2, "南山")}


def test_counts_and_lists(spark, parts):
    _, readings, _, counts = parts
    told = {r.ch: r.n for r in counts.collect()}
    assert told["成"] == told["都"] == 2 and told["男"] == 1
    by_raw, by_parts = g.char_lists(readings, counts)
    assert {r.raw: r.chars for r in by_raw.collect()}["nan"] == sorted("南男") and ("l", "an") in {(r.ini, r.fin) for r in by_parts.collect()}
    assert {r.ch for r in g.common_chars(counts, 2).collect()} == {"成", "都"}
    assert g.char_pool(counts, readings).count() == len({*LETTERS, "号", "女", "人"})


def test_variants_are_replayable_unique_and_steady(parts):
    items, readings, rules, counts = parts
    made = g.generate(items, readings, rules, counts, 12)
    got = made.collect()
    assert {r.source_id for r in got} == {"i1", "i2"} and 8 < len(got) <= 24
    assert len({r.spoken for r in got}) == len(got) and not {r.spoken for r in got} & {"我家在成都市南山路三号", "南山"}
    first = [r for r in got if r.source_id == "i1"]
    assert sum(r.rule == g.HOMOPHONE for r in first) >= 3 and sum(r.rule == g.COMPOUND for r in first) == 1
    assert all(r.n_subs == len(r.applied) == (2 if r.rule == g.COMPOUND else 1) for r in got)
    assert g.problems(made, items, readings, rules).count() == 0
    assert sorted(map(str, got)) == sorted(map(str, g.generate(items.repartition(3), readings, rules, counts, 12).collect()))
    spoiled = made.withColumn("spoken", F.concat("spoken", F.lit("x")))
    assert g.problems(spoiled, items, readings, rules).where("problem = 'not replayable'").count() == len(got)


def test_missing_columns_are_filled(spark):
    df = spark.createDataFrame([("a", None), ("b", "full")], "id string, depth string")
    got = {r.id: (r.depth, r.noise) for r in g.enriched(df, {"depth": F.lit("none"), "noise": F.lit("clean")}).collect()}
    assert got == {"a": ("none", "clean"), "b": ("full", "clean")}
