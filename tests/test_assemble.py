import pytest
from pyspark.sql import functions as F

from veldspar.functions import phonetics
from veldspar.plans import assemble, resolve

PLACES = [
    ("sichuan", "四川省", "province", None, ["四川"], 0.7), ("cd", "成都市", "city", "sichuan", ["成都"], 0.9), ("wh", "武侯区", "district", "cd", ["武侯"], 0.7),
    ("jj", "锦江区", "district", "cd", ["锦江"], 0.7), ("hpl", "红牌楼街道", "street", "wh", ["红牌楼"], 0.6), ("eh", "二环路南四段", "road", "wh", [], 0.5),
    ("cx", "春熙路", "road", "jj", ["春熙路步行街"], 0.8), ("cq", "重庆市", "city", "cqp", ["重庆"], 0.9), ("cqp", "重庆市", "province", None, [], 0.9),
    ("yz", "渝中区", "district", "cq", ["渝中"], 0.8), ("spb", "沙坪坝区", "district", "cq", ["沙坪坝"], 0.8), ("sx", "三峡广场", "poi", "spb", [], 0.7), ("cqk", "磁器口古镇", "poi", "spb", ["磁器口"], 0.7),
    ("mq", "民权路", "road", "yz", [], 0.6), ("zj", "中街", "road", "jj", [], 0.5),
]
#: text, address, what of its fields, kinds of its segments
SAID = [
    ("我屋头在成都市武侯区二环路南四段三十号", "四川省成都市武侯区二环路南四段30号", {"province": "四川省", "road": "二环路南四段", "house_no": "30号", "unverified": ""}, ["filler", "inserted", "hit", "hit", "hit", "tail"]),
    ("成都锦江区春熙路步行街", "四川省成都市锦江区春熙路步行街", {"district": "锦江区", "road": "春熙路步行街"}, None),
    ("重庆渝中区民权路八号巴适得很", "重庆市渝中区民权路8号", {"province": "重庆市", "city": "重庆市"}, ["hit", "hit", "hit", "tail", "filler"]),
    ("重庆沙坪坝三峡广场那个磁器口古镇", "重庆市沙坪坝区磁器口古镇", {"landmark": "三峡广场"}, ["hit", "hit", "ref", "hit"]),
    ("成都武侯区碧园公寓三栋", "四川省成都市武侯区碧园公寓3栋", {"unverified": "碧园公寓", "building": "3栋"}, None),
    ("四川嘛那个成都武侯区", "四川省成都市武侯区", {}, None),
    ("今天天气不错", "今天天气不错", {"unverified": "今天天气不错", "province": ""}, ["unverified"]),
    ("", "", {"road": ""}, []),
    (None, "", {}, []),
]


@pytest.fixture(scope="module")
def outcome(spark):
    places = spark.createDataFrame([(c, n, lv, p, a, q, k) for k, (c, n, lv, p, a, q) in enumerate(PLACES)], "adcode string, name string, level string, parent string, aliases array<string>, prior double, ord int")
    docs = spark.createDataFrame([(k, t) for k, (t, *_) in enumerate(SAID)], "doc_id int, text string")
    letters = {c for p in PLACES for c in p[1] + "".join(p[4])} | {c for t, *_ in SAID for c in t or "" if "一" <= c <= "鿿"}
    readings = phonetics.char_readings(spark, letters, {"都": "du", "重": "chong"})
    costs = phonetics.confusion_costs(phonetics.confusion_rules(spark).where("space = 'mandarin'"))
    chains = resolve.resolve_chains(docs, places, readings, costs)
    out = assemble.assembled(chains, phonetics.all_readings(readings.withColumn("ord", F.lit(0))), costs)
    return {r.doc_id: r for r in out.collect()}


def test_addresses_and_fields(outcome):
    for k, (said, address, fields, kinds) in enumerate(SAID):
        got = outcome[k]
        assert got.address == address, (said, got)
        assert {f: got.fields[f] for f in fields} == fields, (said, got.fields)
        if kinds is not None:
            assert [s.kind for s in got.segments] == kinds, (said, got.segments)


def test_segments_cover_the_text(outcome):
    for k, (said, *_) in enumerate(SAID):
        assert "".join(s.text for s in outcome[k].segments if s.kind in ("hit", "tail", "unverified", "inserted")) == outcome[k].address


def sounds():
    return assemble.Sounds({"称": ["cheng"], "都": ["dou", "du"], "成": ["cheng"], "双": ["shuang"], "流": ["liu"], "曾": ["zeng"]}, [])


def test_a_misheard_start_of_a_name():
    s = sounds()
    assert s.misheard("称都", "成都双流", True)  # 都 in its likest reading
    assert not s.misheard("称都", "成都", True)  # the name must be longer
    assert not s.misheard("曾都", "成双流都", True) and not s.misheard("啊", "成都双流", True) and not s.misheard("", "成都", True)


def test_remnants():
    assert assemble.remnants("我家住在那个花园，旁边的碧园", True, False, False) == ["花园", "碧园"]
    assert assemble.remnants("步行街", False, True, False) == [] and assemble.remnants("步行街", False, False, False) == ["步行街"]
    assert assemble.remnants("老火锅馆，巴适的板", False, False, True) == ["老火锅馆"]
    assert assemble.remnants("的上头", False, False, False) == []


def test_tail_wins_over_marks_and_rest_stays():
    marks = [(0, 2, "hit", "AB省", "province"), (3, 5, "dropped", "", "rejected")]
    got = assemble.laid_out("ab1cd2号", [(5, 7)], marks)
    assert [(p.kind, p.text) for p in got] == [("hit", "AB省"), ("free", "1"), ("dropped", ""), ("tail", "2号")]


def test_the_better_pass(spark):
    first = spark.createDataFrame([(1, "ambiguous", 0.8, "a"), (2, "confident", 0.5, "a"), (3, "confident", 0.5, "a"), (4, "reject", None, "a")], "doc_id int, decision string, total double, address string")
    second = spark.createDataFrame([(1, "confident", 0.7, "b"), (2, "confident", 0.5 + 1e-7, "b"), (3, "confident", 0.6, "b")], first.schema)
    got = {r.doc_id: (r.address, r.chosen) for r in assemble.chosen_pass(first, second).collect()}
    assert got == {1: ("b", "pass2"), 2: ("a", "pass1"), 3: ("b", "pass2"), 4: ("a", "pass1")}
