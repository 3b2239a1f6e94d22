import json

import pytest

from veldspar.operators import evaluation as ev
from veldspar.operators.ranking import PARAMS
from veldspar.sources import tables


def test_items_with_their_split(spark, tmp_path):
    rows = [{"id": "1", "spoken": "a", "fields": {"road": "x"}}, {"id": "2", "spoken": "b"}]
    (tmp_path / "i.json").write_text(json.dumps({"_meta": {}, "items": rows}))
    (tmp_path / "i.jsonl").write_text("\n".join(json.dumps(r) for r in rows))
    (tmp_path / "s.json").write_text(json.dumps({"train": ["1"], "thresholds": {"train": 5}}))
    schema, splits = "id:string,spoken:string,fields:struct<road:string>", tables.read_splits(spark, str(tmp_path / "s.json"))
    for name in ("i.json", "i.jsonl"):
        got = {r.id: (r.spoken, r.fields and r.fields.road, r.split) for r in tables.read_items(spark, str(tmp_path / name), schema, splits).collect()}
        assert got == {"1": ("a", "x", "train"), "2": ("b", None, "eval")}
        assert tables.read_items(spark, str(tmp_path / name), schema).columns == ["id", "spoken", "fields"]
    assert tables.read_config(spark, str(tmp_path / "s.json"))["thresholds"]["train"] == 5


def test_manifest_rows_become_items(spark, tmp_path):
    rows = [
        {"file": "x/a.wav", "quality": "ok", "label_status": "draft", "address_gold": "A", "transcript_asr": "t", "has_address": True},
        {"file": "x/b.wav", "quality": "ok", "label_status": "pending", "address_gold": "A"},
        {"file": "x/c.wav", "quality": "ok", "label_status": "confirmed", "has_address": False, "transcript_gold": "g"},
        {"file": "x/d.wav", "quality": "silent", "label_status": "confirmed", "address_gold": "A"},
        {"file": "x/e.wav", "quality": "ok", "label_status": "confirmed", "address_gold": ""},
    ]
    (tmp_path / "m.jsonl").write_text("\n".join(json.dumps(r) for r in rows))
    got = {r.id: (r.spoken, r.scored, r.has_address) for r in tables.manifest_items(tables.read_manifest(spark, str(tmp_path / "m.jsonl"))).collect()}
    assert got == {"a": ("t", True, True), "b": ("", False, True), "c": ("g", True, False), "e": ("", False, True)}


def test_paths_from_the_environment(spark, tmp_path, monkeypatch):
    (tmp_path / "p.json").write_text(json.dumps({"version": 3, "params": PARAMS}))
    with pytest.raises(FileNotFoundError):
        tables.read_params(spark)
    monkeypatch.setenv("VELDSPAR_PARAMS", str(tmp_path / "p.json"))
    assert tables.read_params(spark) == PARAMS


def test_online_answers(spark, tmp_path):
    a = {"status": "1", "pois": [{"name": f"p{k}", "adcode": "1", "cityname": "c", "location": "1.5,2.5"} for k in range(40)]}
    b = {"status": 0, "results": [{"name": f"q{k}", "uid": "u", "city": "c", "location": {"lng": 1.5, "lat": 2.5}} for k in range(40)]}
    told = lambda *x: spark.createDataFrame([(y if isinstance(y, str) else json.dumps(y),) for y in x], "answer string")
    got = tables.found_places(told(a), "a", 99).collect()
    assert len(got) == 25 and tuple(got[0]) == ("p0", "1", "c", 1.5, 2.5)
    got = tables.found_places(told(b), "b", 99).collect()
    assert len(got) == 20 and tuple(got[0]) == ("q0", "u", "c", 1.5, 2.5)
    assert tables.found_places(told(a, a), "a", 3).count() == 6
    assert tables.found_places(told({**a, "status": "0"}, "not json", {"status": "1"}), "a").count() == 0
    assert tables.provider_for({"b": "key"}) == "b" and tables.provider_for({}) is None
    (tmp_path / "one.json").write_text(json.dumps(b))
    assert tables.search_places(spark, f"{tmp_path}/*.json", {"b": "key"}, 5).count() == 5
    assert tables.search_places(spark, f"{tmp_path}/*.json", {}).count() == tables.search_places(spark, f"{tmp_path}/none*", {"a": "k"}).count() == 0


def test_written_files(spark, tmp_path):
    first = tables.write_params(spark, str(tmp_path / "p.json"), {"version": 1, "params": dict(PARAMS)}, {"SIM_MIN": 0.7}, "search")
    assert first["version"] == 2 and json.loads((tmp_path / "p.json").read_text())["params"]["SIM_MIN"] == 0.7
    assert json.loads((tmp_path / "p.json.v1").read_text())["version"] == 1
    base = tables.write_report(spark, str(tmp_path), "text", "# x\n", {"n": 1})
    assert open(f"{base}.md").read() == "# x\n" and tables.latest(spark, f"{tmp_path}/*_text.md").endswith("_text.md") and tables.latest(spark, f"{tmp_path}/nothing*") is None
    places = spark.createDataFrame([("b", "城", "city", None, ["x"], 0.5, 1), ("a", "省", "province", None, [], 0.9, 0)], "adcode string, name string, level string, parent string, aliases array<string>, prior double, ord int")
    tables.write_places(places, str(tmp_path / "g.json"), "n", "1")
    back = tables.read_gazetteer(spark, str(tmp_path / "g.json")).orderBy("ord").collect()
    assert [(r.adcode, r.aliases, r.prior, r.ord) for r in back] == [("a", [], 0.9, 0), ("b", ["x"], 0.5, 1)]
    tables.write_features(places.select("adcode"), str(tmp_path / "f"), {"g": str(tmp_path / "g.json")}, {"v": 2})
    meta = json.loads((tmp_path / "f.meta.json").read_text())
    assert meta["inputs"]["g"] == tables.fingerprint(spark, str(tmp_path / "g.json")) and len(meta["inputs"]["g"]) == 12
    tables.write_lines(places, str(tmp_path / "lines"), {"seed": 1})
    assert spark.read.json(str(tmp_path / "lines")).count() == 2 and json.loads((tmp_path / "lines.config.json").read_text()) == {"seed": 1}


def test_bootstrap_takes_any_differences(spark):
    from pyspark.sql import functions as F

    got = ev.bootstrap(spark.createDataFrame([(2.5,), (0.5,), (-1.0,), (None,)], "d double"), F.col("d")).head()
    assert abs(got["diff"] - 2 / 3) < 1e-9 and got.n == 3 and -1 <= got.lo < got["diff"] < got.hi <= 2.5
