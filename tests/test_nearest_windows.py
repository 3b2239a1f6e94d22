"""The search for names leaves out what suppression would, and nothing else."""

from pyspark.sql import functions as F

from veldspar.functions import phonetics, text
from veldspar.operators import gazetteer as gz
from veldspar.operators import similarity as sm
from veldspar.plans.stage_queries import spoken_sized

GAP, LIMIT = 0.15, 0.4


def _inputs(spark):
    places, docs, readings, costs = spoken_sized(spark, 80, 30)
    odd = spark.createDataFrame([(-1, ""), (-2, "路"), (-3, "安安安川路江北省"), (-4, "家住平安北市安安安川川路安安安川路"), (-5, "安安安福海路" * 40), (-6, "我我我")], "doc_id long, text string")
    docs = docs.unionAll(odd).withColumn("han", text.han_only(F.col("text"))).coalesce(2)
    named = phonetics.read_aloud(gz.names(places, "level"), readings, "name", "syl").withColumn("name_id", F.xxhash64("adcode", "name_ord"))
    named = named.withColumn("firm", F.pmod("name_id", F.lit(3)).cast("int"))
    return phonetics.read_aloud(docs.select("doc_id", "han"), readings, "han", "syls"), named, costs


def test_search_leaves_out_what_suppression_does(spark):
    heard, named, costs = _inputs(spark)
    found = lambda **more: sorted(map(tuple, sm.nearest_windows(heard, "syls", named, "syl", costs, **more).collect()))
    level, firm = {r.adcode: r.level for r in named.collect()}, {r.adcode: r.firm for r in named.collect()}
    every = [x for x in found() if x[3] <= LIMIT * min(1.0, x[6] / 3.0)]  # without a limit all names are compared with all windows
    assert found(limit=LIMIT) == every
    by: dict = {}
    for x in every:
        by.setdefault(x[0], []).append(x)
    sure = lambda k: k[3] <= GAP and (firm[k[1]] == 2 or firm[k[1]] == 1 and k[3] <= 1e-9)
    over = lambda k, x: level[k[1]] == level[x[1]] and k[4] < x[5] and x[4] < k[5] and x[3] - k[3] > GAP
    want = [x for x in every if not any(sure(k) and over(k, x) for k in by[x[0]])]
    assert len(want) < len(every) / 2
    assert found(limit=LIMIT, gap=GAP) == want
    assert found(limit=LIMIT, gap=GAP, block_names=40) == want


def test_a_search_in_small_parts_is_the_same(spark, monkeypatch):
    heard, named, costs = _inputs(spark)
    rows = [r.asDict(recursive=True) for r in named.collect()]
    doc = next(r for r in heard.collect() if r.doc_id == -5)
    block, told = sm.NameBlock(rows), phonetics.Costs(costs.collect())
    seen: dict = {}
    ids = [seen.setdefault((x.ini, x.fin, x.raw), len(seen)) for x in doc.syls]
    table = told.swap(list(seen), list(block.known))
    whole = sorted(block.windows(sm.np.array(ids), table, 0.08, LIMIT, GAP))
    monkeypatch.setattr(sm, "CELLS", 500)
    assert whole and sorted(block.windows(sm.np.array(ids), table, 0.08, LIMIT, GAP)) == whole
