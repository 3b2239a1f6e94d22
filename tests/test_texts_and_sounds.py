from pyspark.sql import functions as F

from veldspar.functions import phonetics, text
from veldspar.operators import stages
from veldspar.plans import resolve


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column.alias("y")).head().y


def test_short_names(spark):
    for name, want in (("宁夏回族自治区", ["宁夏", "宁夏回族自治"]), ("玉树藏族自治州", ["玉树"]), ("恩施土家族苗族自治州", ["恩施"]), ("浦东新区", ["浦东"]), ("东区", []), ("香港特别行政区", ["香港"])):
        assert one(spark, name, text.aliases(F.col("x"))) == want
    assert one(spark, "春熙路步行街", text.road_aliases(F.col("x"), F.array(F.lit("春熙")))) == ["春熙", "春熙路"]
    assert one(spark, "中山路", text.road_aliases(F.col("x"), F.array().cast("array<string>"))) == []


def test_substitutions_follow_the_rewriting(spark):
    said = "屋头在巷巷头巷巷"
    log = one(spark, said, text.substitutions(F.col("x")))
    out = said
    for s in log:
        assert out.index(s.src) == s.pos and out.count(s.src) == s.n
        out = out.replace(s.src, s.dst)
    assert out == one(spark, said, text.rewrite(F.col("x"))) and "巷巷头→巷子里" in one(spark, said, text.substitutions_text(text.substitutions(F.col("x"))))
    assert one(spark, "", text.substitutions(F.col("x"))) == one(spark, None, text.substitutions(F.col("x"))) == []


def test_other_romanizations(spark):
    split = lambda space: F.transform(phonetics.toneless(F.col("x")), lambda s: phonetics.syllable_in(s, space)["ini"])
    assert one(spark, "gwong2 zau1 ng4", split("jyutping")) == ["gw", "z", "n"]
    assert one(spark, "tâi-uân tshiú", split("tailo")) == ["t", "", "tsh"]


def test_distance_in_a_space_of_its_own(spark):
    d = phonetics.weighted_distance(phonetics.confusion_costs(phonetics.confusion_rules(spark).where("space = 'mandarin'")))
    syl = lambda c: F.transform(F.filter(F.split(F.col(c), " "), lambda x: x != ""), phonetics.split_syllable)
    rows = spark.createDataFrame([("niu", "liu", "a", "b"), ("", "", "niu", "liu"), ("", "", "", "x")], "a string, b string, c string, d string")
    got = [round(r.y, 6) for r in rows.select(phonetics.space_distance((syl("a"), syl("b")), (syl("c"), syl("d")), d, d).alias("y")).collect()]
    assert got == [0.045, 0.045, 1.0]
    names, spaces = phonetics.routes(spark)
    assert sum(r.dialects for r in phonetics.spaces_status(spaces).collect()) == 22


def test_readings_of_a_character(spark):
    rows = spark.createDataFrame([("都", "du", 1), ("都", "dou", 0), ("成", "cheng", 0)], "ch string, raw string, ord int")
    got = {r.ch: [x.raw for x in r.readings] for r in phonetics.all_readings(rows).collect()}
    assert got == {"都": ["dou", "du"], "成": ["cheng"]}
    read = phonetics.read_aloud(spark.createDataFrame([("成都x",), (None,)], "t string"), rows, "t", "s").collect()
    assert [x.raw for x in read[0].s] == ["cheng", "dou", "x"] and read[1].s == []


def test_stage_b(spark):
    row = spark.createDataFrame([("我屋头在八百一百八号三楼嘛", "八百一百八号3楼", "")], "raw string, address string, unverified string")
    fields = {k: F.lit("") for k in stages.TAIL}
    b = row.select(stages.stage_b(F.col("raw"), F.lit(1), F.col("address"), F.col("unverified"), fields, {**fields, "room": F.lit("1室")}, F.col("raw"), F.lit("八百一百八号3楼")).alias("b")).head().b
    assert (b.lexicon_present, b.lexicon_hit, b.number_ok, b.tail_exact, b.illegal, b.illegal_number_caught, b.leaked, b.ok) == (True, True, True, False, ["八百一百八号"], True, "", False)


def test_a_landmark_under_a_street_is_one_chain(spark):
    # The street of both landmarks is said once; chains from either landmark have the same roads, however the street was attached.
    places = [("c", "川城市", "city", None), ("s", "安福街道", "street", "c"), ("p", "北峨广场", "poi", "s"), ("q", "东海大厦", "poi", "s")]
    df = spark.createDataFrame([(*x, [], 0.5, k) for k, x in enumerate(places)], "adcode string, name string, level string, parent string, aliases array<string>, prior double, ord int")
    docs = spark.createDataFrame([(1, "川城市安福街道北峨广场东海大厦")], "doc_id int, text string")
    readings = phonetics.char_readings(spark, set("川城市安福街道北峨广场东海大厦"))
    costs = phonetics.confusion_costs(phonetics.confusion_rules(spark).where("space = 'mandarin'"))
    plain = resolve.normalized(docs)
    chains = resolve.build_chains(resolve.find_hits(plain, df, readings, costs), df).collect()
    low = [c for c in chains if c.lead == "p"]
    assert len(low) == 1 and low[0].roads == "p/q" and low[0].also == ["q"] and {h.adcode for h in low[0].evidence} == {"c", "s", "p", "q"}
