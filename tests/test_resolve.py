import json

import pytest
from pyspark.sql import functions as F

from veldspar.functions import phonetics, text
from veldspar.plans import resolve
from veldspar.sources import tables
from veldspar.streaming import live

PLACES = [
    ("sichuan", "四川省", "province", None, ["四川"], 0.7), ("cd", "成都市", "city", "sichuan", ["成都"], 0.9), ("wh", "武侯区", "district", "cd", ["武侯"], 0.7),
    ("jj", "锦江区", "district", "cd", ["锦江"], 0.7), ("hpl", "红牌楼街道", "street", "wh", ["红牌楼"], 0.6), ("eh", "二环路南四段", "road", "wh", [], 0.5),
    ("cx", "春熙路", "road", "jj", [], 0.8), ("cq", "重庆市", "city", "cqp", ["重庆"], 0.9), ("cqp", "重庆市", "province", None, [], 0.9), ("yz", "渝中区", "district", "cq", ["渝中"], 0.8),
    ("jfb", "解放碑", "poi", "yz", [], 0.9), ("mq", "民权路", "road", "yz", [], 0.6), ("zhb", "中华北路", "road", "yz", [], 0.6),
]


@pytest.fixture(scope="module")
def parts(spark):
    places = spark.createDataFrame([(c, n, lv, p, a, q, k) for k, (c, n, lv, p, a, q) in enumerate(PLACES)], "adcode string, name string, level string, parent string, aliases array<string>, prior double, ord int")
    said = {1: "我屋头在成都市武侯区红牌楼街道二环路南四段三十号", 2: "重庆渝中区解放碑民权路八号", 3: "成都锦江区村熙路", 4: "今天天气不错", 5: "abc", 6: None, 7: "四川成都", 8: "重庆渝中区中华中路"}
    docs = spark.createDataFrame(list(said.items()), "doc_id int, text string")
    letters = set("".join(n + "".join(a) for _, n, _, _, a, _ in PLACES) + "".join(t or "" for t in said.values()))
    readings = phonetics.char_readings(spark, [c for c in letters if "一" <= c <= "鿿"], {"都": "du", "重": "chong", "长": "chang"})
    return places, docs, readings, phonetics.confusion_costs(phonetics.confusion_rules(spark).where("space = 'mandarin'"))


def test_resolve_small_gazetteer(spark, parts):
    places, docs, readings, costs = parts
    got = {r.doc_id: r for r in resolve.resolve(docs, places, readings, costs).collect()}
    assert set(got) == set(range(1, 9))
    assert got[1].decision == "confident" and got[1].codes == ["sichuan", "cd", "wh", "hpl"] or got[1].codes == ["sichuan", "cd", "wh", "eh"]
    assert got[1].tail.house_no == "30号"
    assert got[2].decision == "confident" and got[2].codes[:3] == ["cqp", "cq", "yz"] and got[2].tail.house_no == "8号"
    assert got[3].decision == "confident" and got[3].codes == ["sichuan", "cd", "jj", "cx"]
    assert got[4].decision == "reject" and got[5].decision == got[6].decision == "empty"
    assert got[7].decision == "partial"
    assert "zhb" not in (got[8].codes or [])  # a sibling road isn't mended to another one


def test_gates_follow_params(spark, parts):
    places, docs, readings, costs = parts
    plain = resolve.normalized(docs)
    chains = resolve.build_chains(resolve.find_hits(plain, places, readings, costs), places)
    strict = resolve.scored(tables.with_params(chains, {"W_SIM": 0.0, "W_COV": 1.0, "W_PRIOR": 0.0, "W_DEPTH": 0.0, "W_CONFLICT": 0.0}), plain)
    assert strict.where(F.abs(F.col("total") - F.col("coverage")) > 1e-9).count() == 0
    with pytest.raises(KeyError):
        tables.with_params(chains, {"NO_SUCH": 1.0})


def test_readers(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps({"_meta": {}, "entries": [{"name": "成都市", "level": "city", "adcode": "510100", "parent": None}, {"name": "x", "level": "road", "adcode": "1", "parent": "510100", "aliases": ["y"], "prior": 0.9}]}))
    g = tables.read_gazetteer(spark, str(tmp_path / "g.json")).orderBy("ord").collect()
    assert (g[0].aliases, g[0].prior, g[1].aliases, g[1].prior) == ([], 0.5, ["y"], 0.9)
    from veldspar.operators.ranking import PARAMS

    told = {"version": 1, "params": dict(PARAMS)}
    (tmp_path / "p.json").write_text(json.dumps(told))
    assert tables.read_params(spark, str(tmp_path / "p.json")) == PARAMS
    (tmp_path / "q.json").write_text(json.dumps({"params": {"W_SIM": 1}}))
    with pytest.raises(ValueError):
        tables.read_params(spark, str(tmp_path / "q.json"))
    after = tables.next_version(told, {"SIM_MIN": 0.7}, "test")
    assert after["version"] == 2 and after["params"]["SIM_MIN"] == 0.7 and after["history"][0]["version"] == 1
    (tmp_path / "s.json").write_text(json.dumps({"train": ["a", "b"], "eval": ["c"], "n": 3}))
    assert sorted(map(tuple, tables.read_splits(spark, str(tmp_path / "s.json")).collect())) == [("a", "train"), ("b", "train"), ("c", "eval")]
    tables.register_places(spark)
    lines = "\n".join([*(json.dumps({"name": f"plaza {k}", "region": "r" if k % 2 else "s"}) for k in range(80)), "no json"])
    read = lambda **o: spark.read.format("places").options(**o).load().count()
    assert read(lines=lines, keyword="plaza", limit=99) == 25
    assert read(lines=lines, keyword="plaza", region="r", limit=4) == 4
    assert read(keyword="plaza") == 0


def test_stream_equals_batch(spark, tmp_path):
    docs = spark.createDataFrame([(1, "屋头三号"), (2, None)], "doc_id int, text string")
    docs.write.parquet(str(tmp_path / "in"))
    stream = live.normalized_stream(spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("normalized").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    assert q.awaitTermination(120)
    assert sorted(spark.table("normalized").collect(), key=repr) == sorted(resolve.normalized(docs).collect(), key=repr)


def test_text_edge_cases(spark):
    df = spark.createDataFrame([(None,), ("",), ("三" * 3000 + "号",)], "t string")
    got = df.select(text.normalize_numbers(F.col("t")).alias("n"), text.extract_tail(F.col("t")).alias("x")).collect()
    assert got[0].n is None and got[1].n == "" and got[2].n is not None
