"""Registered queries of the stage metrics, calibration, replay, text and assembly operators, over inputs that are generated from whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import phonetics, text
from ..operators import calibration, search, stages
from ..operators import evaluation as ev
from ..operators import gazetteer as gz
from ..operators import similarity as sm
from . import assemble, resolve
from .queries import QUERIES, SQL, query, table, tree

__all__ = ["QUERIES", "SQL"]

# Addresses of customers, made from their region, nation, name and a house number, and outcomes that go wrong in one part or other.
MADE_SQL = """made AS (SELECT c_custkey AS id, r_name AS province, n_name AS city, c_name AS road, (c_custkey % 50 + 1) || '号' AS house_no,
  CASE WHEN c_custkey % 7 = 0 THEN 'X' ELSE r_name END AS province2, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE n_name END AS city2, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name || '路' END AS road2, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE (c_custkey % 50 + 1) || '号' END AS house2
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
told AS (SELECT *, province2 || city2 || road2 || house2 AS address, province || city || road || '路' || house_no AS truth FROM made)"""


def _made(spark, sf):
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    k, house = F.col("c_custkey"), F.concat((F.col("c_custkey") % 50 + 1).cast("string"), F.lit("号"))
    out = c.select(
        k.alias("id"), F.col("r_name").alias("province"), F.col("n_name").alias("city"), F.col("c_name").alias("road"), house.alias("house_no"), F.when(k % 7 == 0, "X").otherwise(F.col("r_name")).alias("province2"),
        F.when(k % 5 == 0, "").otherwise(F.col("n_name")).alias("city2"), F.when(k % 3 == 0, "").otherwise(F.concat("c_name", F.lit("路"))).alias("road2"), F.when(k % 4 == 0, "").otherwise(house).alias("house2"),
    )
    return out.withColumns({"address": F.concat("province2", "city2", "road2", "house2"), "truth": F.concat("province", "city", "road", F.lit("路"), "house_no")})


def _fields(**given) -> dict:
    return {k: given.get(k, F.lit("")) for k in ("province", "city", "district", "street", "road", "community", "house_no", "building", "unit", "room")}


@query(f"""WITH {MADE_SQL}, s AS (SELECT *, province2 = province AND city2 = city AS admin_all, CASE WHEN contains(address, road) THEN 1.0 ELSE 0.0 END AS geo_recall, house2 = house_no AS tail_all, address = truth AS exact,
  regexp_replace(address, '[0-9]+号', '') = regexp_replace(truth, '[0-9]+号', '') AS geo_ok, translate(address, '路号', 'lh') AS a, translate(truth, '路号', 'lh') AS t FROM told)
SELECT id, admin_all, geo_recall::DOUBLE AS geo_recall, tail_all, exact, geo_ok, round(levenshtein(a, t) / length(t), 4) AS cer, CASE WHEN NOT admin_all THEN 'admin' WHEN geo_recall < 1 OR NOT geo_ok THEN 'place' WHEN NOT tail_all THEN 'tail' ELSE 'right' END AS severity FROM s""")
def e2e_scores(spark, sf):
    got = _fields(province=F.col("province2"), city=F.col("city2"), house_no=F.col("house2"))
    gold = _fields(province=F.col("province"), city=F.col("city"), road=F.col("road"), house_no=F.col("house_no"))
    s = _made(spark, sf).select("id", stages.score_e2e(got, F.col("address"), gold, F.col("truth")).alias("s"))
    return s.select("id", *[F.col(f"s.{k}") for k in ("admin_all", "geo_recall", "tail_all", "exact", "geo_ok", "cer", "severity")])


@query(f"""WITH {MADE_SQL} SELECT id, CASE WHEN contains(address, province) OR contains(address, city) THEN 'full' ELSE 'street_only' END AS depth FROM told""")
def address_depths(spark, sf):
    return _made(spark, sf).select("id", stages.address_depth(F.col("address"), _fields(province=F.col("province"), city=F.col("city"))).alias("depth"))


@query(f"""WITH {MADE_SQL}, u AS (SELECT *, NOT contains(address, province) AS p, NOT contains(address, city) AS c FROM told)
SELECT id, array_to_string(list_filter([CASE WHEN p THEN 'province' END, CASE WHEN c THEN 'city' END], lambda x: x IS NOT NULL), ',') AS backfilled, (NOT p OR province2 = province) AND (NOT c OR city2 = city) AS backfill, NOT (province2 = province AND city2 = city) AND road2 = '' AS wrong_city, NOT p AS told FROM u WHERE id % 2 = 0 OR id % 2 = 1""")
def backfill_stage(spark, sf):
    got, gold = _fields(province=F.col("province2"), city=F.col("city2")), _fields(province=F.col("province"), city=F.col("city"))
    same = (F.col("province2") == F.col("province")) & (F.col("city2") == F.col("city"))
    f = stages.stage_f(gold, got, F.col("address"), F.array(F.lit("city")), F.lit("district"), same, F.when(F.col("road2") == "", 0.0).otherwise(1.0))
    return _made(spark, sf).select("id", f.alias("f")).select("id", F.array_join("f.backfilled", ",").alias("backfilled"), "f.backfill", "f.wrong_city", "f.told")


@query("""WITH r AS (SELECT o_custkey AS id, o_orderkey % 7 = 0 AS ok, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders), g AS (SELECT id, min(rank) AS r FROM r WHERE ok GROUP BY id)
SELECT c_custkey AS id, CASE WHEN e THEN coalesce(r <= 1, false) END AS recall_1, CASE WHEN e THEN coalesce(r <= 3, false) END AS recall_3, CASE WHEN e THEN r IS NOT NULL END AS recall_all, CASE WHEN e THEN r END AS gold_rank, CASE WHEN e AND r IS NOT NULL THEN r = 1 END AS top1, CASE WHEN e AND r IS NOT NULL THEN round(1.0 / r, 3) END AS mrr
FROM (SELECT c_custkey, c_custkey % 3 > 0 AS e FROM customer) LEFT JOIN g ON g.id = c_custkey""")
def recall_stages(spark, sf):
    from pyspark.sql import Window as W

    w = W.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    ranking = table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), F.row_number().over(w).alias("rank"), (F.col("o_orderkey") % 7 == 0).alias("ok"))
    items = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 3 > 0).alias("evaluable"), F.lit("x").alias("deepest_code"))
    return stages.stage_d(stages.stage_c(items, ranking)).select("id", "recall_1", "recall_3", "recall_all", "gold_rank", "top1", "mrr")


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 'weak_filtered' WHEN l_linestatus = 'O' AND l_linenumber = 1 THEN 'window_miss' WHEN l_discount * 8 > 0.4 THEN 'dist_over_max' WHEN l_discount * 8 > 0.4 * least(1.0, l_linenumber / 3) THEN 'weak_filtered' ELSE 'window_miss' END AS reason FROM lineitem""")
def miss_reasons(spark, sf):
    weak = F.when(F.col("l_returnflag") == "R", F.col("l_linestatus") == "O")
    dist = F.when((F.col("l_linestatus") != "O") | (F.col("l_linenumber") != 1), F.col("l_discount") * 8)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", stages.miss_reason(weak, dist, F.col("l_linenumber")).alias("reason"))


@query("""WITH f AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN 'FA' WHEN 1 THEN 'FR' WHEN 2 THEN 'TR' ELSE 'TP' END AS q, CASE WHEN l_linenumber % 5 = 0 THEN 'FR' ELSE 'TP' END AS qg, CASE l_returnflag WHEN 'R' THEN 'reject' WHEN 'A' THEN 'ambiguous' ELSE 'partial' END AS d,
  l_partkey % 3 = 0 AS geo, l_partkey % 2 = 0 AS tail, l_suppkey % 5 > 0 AS chain, l_tax AS margin, 0.5 + l_discount * 4 AS sim, l_quantity > 10 AS second, l_linestatus = 'O' AS differs FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN q = 'FA' THEN CASE WHEN geo AND NOT tail THEN 'tail' WHEN geo THEN 'assembly' WHEN NOT chain THEN 'sim' WHEN second AND margin < 0.06 AND NOT differs THEN 'margin(same_admin_exempt)' WHEN CASE WHEN second THEN (margin - 0.06) / 0.06 ELSE 9.0 END < (sim - 0.62) / 0.62 THEN 'margin' ELSE 'sim' END
 WHEN q = 'FR' OR qg = 'FR' THEN CASE d WHEN 'reject' THEN 'sim' WHEN 'ambiguous' THEN 'margin' ELSE d END END AS gate FROM f""")
def gates_blamed(spark, sf):
    n = F.col("l_linenumber") % 4
    q = F.when(n == 0, "FA").when(n == 1, "FR").when(n == 2, "TR").otherwise("TP")
    d = F.when(F.col("l_returnflag") == "R", "reject").when(F.col("l_returnflag") == "A", "ambiguous").otherwise("partial")
    blame = stages.gate_blame(q, F.when(F.col("l_linenumber") % 5 == 0, "FR").otherwise("TP"), d, F.col("l_partkey") % 3 == 0, F.col("l_partkey") % 2 == 0, F.col("l_suppkey") % 5 > 0, F.col("l_tax"), 0.5 + F.col("l_discount") * 4, F.col("l_quantity") > 10, F.col("l_linestatus") == "O")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", blame.alias("gate"))




def _names(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), (F.col("l_linenumber") % 3).alias("field"), F.repeat(F.lit("x"), F.col("l_linenumber").cast("int")).alias("name"), F.col("l_discount").alias("cer_char"), F.col("l_tax").alias("cer_phon"), (F.col("l_discount") / 2).alias("dist_phon_w"))


@query("""WITH n AS (SELECT l_orderkey AS id, l_linenumber AS w, l_discount AS c, l_tax AS p, l_discount / 2 AS d FROM lineitem), s AS (SELECT id, sum(c * w) / sum(w) AS c, sum(p * w) / sum(w) AS p, sum(d * w) / sum(w) AS d, max(d) AS m FROM n GROUP BY id)
SELECT id, round(c, 9) AS cer_name_char, round(p, 9) AS cer_name_phon, round(d, 9) AS cer_name_phon_w, m AS name_phon_dist_max, CASE WHEN c > 0 THEN round((c - p) / c, 9) END AS recoverable_share, CASE WHEN c > 0 THEN round((c - d) / c, 9) END AS recoverable_share_w FROM s""")
def name_metrics(spark, sf):
    a = stages.stage_a(_names(spark, sf))
    return a.withColumns({c: F.round(c, 9) for c in ("cer_name_char", "cer_name_phon", "cer_name_phon_w", "recoverable_share", "recoverable_share_w")})


@query("""SELECT id, field, dist_phon_w, cer_char, name FROM (SELECT l_orderkey AS id, l_linenumber % 3 AS field, repeat('x', l_linenumber::INT) AS name, l_discount AS cer_char, l_discount / 2 AS dist_phon_w, row_number() OVER (PARTITION BY l_orderkey, l_linenumber % 3 ORDER BY l_discount / 2, l_discount, repeat('x', l_linenumber::INT)) AS r FROM lineitem) WHERE r = 1""")
def likest_spellings(spark, sf):
    return stages.likest(_names(spark, sf)).select("id", "field", "dist_phon_w", "cer_char", "name")


@query("""WITH x AS (SELECT n_nationkey, r_regionkey, n_name AS h, r_name AS r FROM nation, region), w AS (SELECT x.*, length(r) + k AS w FROM x, range(-1, 2) t(k) WHERE length(r) + k BETWEEN 1 AND length(h)),
c AS (SELECT w.*, s FROM w, unnest(range(0, length(h) - w + 1)) AS u(s)), d AS (SELECT *, substr(h, s::INT + 1, w::INT) AS part, levenshtein(substr(h, s::INT + 1, w::INT), r) / length(r) AS cer FROM c), b AS (SELECT *, row_number() OVER (PARTITION BY n_nationkey, r_regionkey ORDER BY cer, w, s) AS k FROM d)
SELECT x.n_nationkey, x.r_regionkey, round(coalesce(cer, 1.0), 6) AS cer, coalesce(part, '') AS part FROM x LEFT JOIN b ON b.n_nationkey = x.n_nationkey AND b.r_regionkey = x.r_regionkey AND k = 1""")
def closest_parts(spark, sf):
    pairs = table(spark, sf, "nation").select("n_nationkey", "n_name").join(F.broadcast(table(spark, sf, "region").select("r_regionkey", "r_name")))
    return pairs.select("n_nationkey", "r_regionkey", stages.closest_part(F.col("n_name"), F.col("r_name")).alias("x")).select("n_nationkey", "r_regionkey", F.round("x.cer", 6).alias("cer"), "x.part")


@query("SELECT n_nationkey, r_regionkey, round(levenshtein(n_name, r_name) / length(r_name), 6) AS rate FROM nation, region")
def token_error_rates(spark, sf):
    letters = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    pairs = table(spark, sf, "nation").join(F.broadcast(table(spark, sf, "region").select("r_regionkey", "r_name")))
    return pairs.select("n_nationkey", "r_regionkey", F.round(stages.token_rate(letters("n_name"), letters("r_name")), 6).alias("rate"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN '' ELSE '八百一百' || translate((p_size % 9 + 1)::VARCHAR, '123456789', '一二三四五六七八九') || '号' END AS illegal FROM part")
def illegal_numerals(spark, sf):
    digit = F.translate((F.col("p_size") % 9 + 1).cast("string"), "123456789", "一二三四五六七八九")
    said = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("中山"), digit, F.lit("百号"))).otherwise(F.concat(F.lit("中山八百一百"), digit, F.lit("号三楼")))
    return table(spark, sf, "part").select("p_partkey", F.array_join(stages.illegal_numbers(said), ",").alias("illegal"))


@query("""SELECT c_custkey, contains(c_name || n_name || '街', n_name) AND (c_custkey % 2 = 0 OR contains(c_name || n_name || '街', r_name)) AS preserved FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def stems_preserved(spark, sf):
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    missing = F.when(F.col("c_custkey") % 2 == 0, F.array(F.concat("n_name", F.lit("街道")))).otherwise(F.array(F.concat("n_name", F.lit("路")), F.concat("r_name", F.lit("小区"))))
    return c.select("c_custkey", stages.preserved(missing, F.concat("c_name", "n_name", F.lit("街"))).alias("preserved"))


@query("SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL AND (toxic = 1 OR quality = 0) THEN 'oov_db' ELSE lang END AS negative_type FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def affected_items(spark, sf):
    drops = table(spark, sf, "labels").where("toxic = 1 or quality = 0").select(F.array("doc_id").alias("affects"))
    return ev.tagged(table(spark, sf, "documents").select("doc_id", F.col("lang").alias("negative_type")), drops, "doc_id").select("doc_id", "negative_type")


@query("""WITH f AS (SELECT *, row_number() OVER (PARTITION BY split, source, n_chars % 50 ORDER BY doc_id) AS r FROM (SELECT *, CASE WHEN doc_id % 3 = 0 THEN 'calib' ELSE 'train' END AS split FROM documents)), e AS (SELECT split, count(*) AS effective FROM f WHERE r = 1 GROUP BY split),
w AS (SELECT lang, count(*) AS n FROM f WHERE r = 1 AND split = 'train' GROUP BY lang HAVING count(*) < 60)
SELECT t.split, need::BIGINT AS need, effective, CASE WHEN t.split = 'train' THEN coalesce((SELECT string_agg(lang, ',' ORDER BY lang) FROM w), '') ELSE '' END AS weak, effective >= need AND (t.split <> 'train' OR (SELECT count(*) FROM w) = 0) AS ok FROM (VALUES ('train', 500), ('calib', 300)) AS t(split, need) JOIN e ON e.split = t.split""")
def split_gates(spark, sf):
    d = table(spark, sf, "documents").select(F.when(F.col("doc_id") % 3 == 0, "calib").otherwise("train").alias("split"), "source", (F.col("n_chars") % 50).alias("g"), F.array("lang").alias("tags"), F.col("doc_id").alias("ord"))
    out = ev.gate_status(d, "split", "source", "g", "tags", per_tag=60)
    return out.select("split", "need", "effective", F.array_join("weak_tags", ",").alias("weak"), "ok")


@query("""WITH a AS (SELECT p_brand, p_size FROM part WHERE p_partkey % 2 = 0), b AS (SELECT p_brand, p_size FROM part WHERE p_partkey % 2 = 1) (SELECT *, 'left' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)) UNION ALL (SELECT *, 'right' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a))""")
def lists_differ(spark, sf):
    p = table(spark, sf, "part")
    return ev.symmetric_difference(p.where("p_partkey % 2 = 0").select("p_brand", "p_size"), p.where("p_partkey % 2 = 1").select("p_brand", "p_size"))


STEPS_SQL = "st(x, p) AS (VALUES (0.0, 0.1), (0.2, 0.5), (0.6, 0.9)), j AS (SELECT least(1.0, n_chars / 5000) AS s, quality = 1 AS y FROM documents JOIN labels USING (doc_id)), k AS (SELECT y, coalesce((SELECT p FROM st WHERE x <= s ORDER BY x DESC LIMIT 1), 0.1) AS p FROM j)"


@query(f"WITH {STEPS_SQL} SELECT count(*) FILTER (p >= 0.5 AND y) AS tp, count(*) FILTER (p >= 0.5 AND NOT y) AS fa, count(*) FILTER (p < 0.5 AND y) AS fr, count(*) FILTER (p < 0.5 AND NOT y) AS tr, round(count(*) FILTER (p >= 0.5) / count(*), 6) AS coverage, round(count(*) FILTER (p >= 0.5 AND NOT y) / count(*) FILTER (p >= 0.5), 6) AS risk FROM k")
def gate_at_steps(spark, sf):
    j = table(spark, sf, "documents").select("doc_id", "n_chars").join(table(spark, sf, "labels"), "doc_id")
    steps = spark.createDataFrame([(0.0, 0.1), (0.2, 0.5), (0.6, 0.9)], "x_start double, p double")
    q = calibration.gate_at(j, F.least(F.lit(1.0), F.col("n_chars") / 5000), F.col("quality") == 1, steps, 0.5)
    return q.select("tp", "fa", "fr", "tr", F.round("coverage", 6).alias("coverage"), F.round("risk", 6).alias("risk"))


@query("SELECT count(*) FILTER (o_orderstatus = 'F') AS confident, count(*) FILTER (o_orderstatus <> 'F') AS non_confident FROM orders")
def decision_classes(spark, sf):
    return calibration.class_counts(table(spark, sf, "orders"), F.when(F.col("o_orderstatus") == "F", "confident").otherwise(F.col("o_orderstatus")))


@query()
def calibration_gain(spark, sf):
    j = table(spark, sf, "documents").select("doc_id", "n_chars").join(table(spark, sf, "labels"), "doc_id")
    return calibration.calibration_gain(j, F.col("n_chars") / 20000, F.col("quality") == 1)


REPLAY_SQL = """f AS (SELECT l_orderkey AS id, l_linenumber::BIGINT AS chain, 0.55::DOUBLE + l_discount * 3 + l_linenumber * 0.00137::DOUBLE + l_partkey * 1e-7::DOUBLE AS sim, l_tax * 5 AS cov, l_quantity / 50 AS prior, l_linenumber / 7 AS depth, l_tax * 2 AS conflict, l_returnflag AS admin, l_linestatus = 'O' AS deep, l_partkey % 3 > 0 AS ok FROM lineitem),
c(candidate, mm) AS (VALUES (0, 0.0613177), (1, 0.2017313)),
t AS (SELECT *, 0.5 * sim + 0.2 * cov + 0.15 * prior + 0.15 * depth - 0.25 * conflict AS total FROM f),
r AS (SELECT *, row_number() OVER w AS rank, lead(total) OVER w AS nxt, lead(admin) OVER w AS nadmin FROM t WINDOW w AS (PARTITION BY id ORDER BY total DESC, chain)),
d AS (SELECT candidate, id, ok, CASE WHEN sim < 0.62 THEN 'reject' WHEN NOT deep THEN 'partial' WHEN nxt IS NOT NULL AND total - nxt < mm AND nadmin <> admin THEN 'ambiguous' ELSE 'confident' END AS dec FROM r, c WHERE rank = 1),
q AS (SELECT candidate, id, CASE WHEN dec = 'confident' THEN CASE WHEN ok THEN 'TP' ELSE 'FA' END WHEN ok THEN 'FR' ELSE 'TR' END AS q, o_orderpriority AS prio, o_orderstatus AS status, o_custkey % 9 = 0 AS oov, o_custkey % 11 = 0 AS without FROM d JOIN orders ON o_orderkey = id)"""


def _replay(spark, sf):
    li = table(spark, sf, "lineitem")
    f = li.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").cast("long").alias("chain"), (0.55 + F.col("l_discount") * 3 + F.col("l_linenumber") * 0.00137 + F.col("l_partkey") * 1e-7).alias("sim"), (F.col("l_tax") * 5).alias("cov"), (F.col("l_quantity") / 50).alias("prior"), (F.col("l_linenumber") / 7).alias("depth"), (F.col("l_tax") * 2).alias("conflict"), F.col("l_returnflag").alias("admin"), (F.col("l_linestatus") == "O").alias("deep"), (F.col("l_partkey") % 3 > 0).alias("ok"), F.lit(None).cast("double").alias("single_dist"))
    o = table(spark, sf, "orders")
    items = f.select("id").distinct().join(o, F.col("id") == F.col("o_orderkey")).select("id", F.col("o_orderpriority").alias("prio"), F.col("o_orderstatus").alias("status"), F.when(F.col("o_custkey") % 9 == 0, "oov_db").alias("negative_type"), (F.col("o_custkey") % 11 != 0).alias("has_address"))
    return f, items, [{"MARGIN_MIN": 0.0613177}, {"MARGIN_MIN": 0.2017313}]


@query(f"""WITH {REPLAY_SQL}, n AS (SELECT candidate, count(*) AS n, count(*) FILTER (q = 'TP') AS tp, count(*) FILTER (q = 'FA') AS fa, count(*) FILTER (q = 'FR') AS fr, count(*) FILTER (q = 'TR') AS tr, count(*) FILTER (q = 'FA' AND oov) AS oov_fa, count(*) FILTER (q = 'FA' AND without) AS neg_fa FROM q GROUP BY candidate)
SELECT candidate, n, tp, fa, fr, tr, oov_fa, neg_fa, round((tp + fr) / n, 6) AS em_proxy, round((10 * fa + fr + tr) / n, 6) AS cost FROM n""")
def replay_metrics(spark, sf):
    f, items, points = _replay(spark, sf)
    m = search.metrics(f, search.as_candidates(spark, points), items=items)
    return m.select("candidate", "n", "tp", "fa", "fr", "tr", "oov_fa", "neg_fa", F.round("em_proxy", 6).alias("em_proxy"), F.round("cost", 6).alias("cost"))


@query(f"""WITH {REPLAY_SQL}, x AS (SELECT 'prio' AS axis, prio AS value, * FROM q UNION ALL SELECT 'status', status, * FROM q), n AS (SELECT axis, value, count(*) FILTER (candidate = 0) AS n, count(*) FILTER (candidate = 0 AND q = 'TP') AS tb, count(*) FILTER (candidate = 1 AND q = 'TP') AS ta, count(*) FILTER (candidate = 0 AND q = 'FA') AS fb, count(*) FILTER (candidate = 1 AND q = 'FA') AS fa FROM x GROUP BY axis, value)
SELECT axis, value, n, ta - tb AS delta_tp, fa - fb AS delta_fa FROM n""")
def slice_deltas(spark, sf):
    f, items, points = _replay(spark, sf)
    return search.slice_deltas(f, items, points[0], points[1], ("prio", "status")).select("axis", "value", "n", "delta_tp", "delta_fa")


@query(f"""WITH {REPLAY_SQL} SELECT a.status AS source, count(*) AS n, count(*) FILTER (a.q <> b.q) AS diverged FROM q a JOIN q b ON a.id = b.id AND a.candidate = 0 AND b.candidate = 1 GROUP BY a.status""")
def replay_divergence(spark, sf):
    from ..operators.ranking import quadrant

    f, items, points = _replay(spark, sf)
    both = search.replay(f, search.as_candidates(spark, points)).withColumn("q", quadrant(F.col("decision"), F.col("ok"))).join(items.select("id", F.col("status").alias("source")), "id")
    return search.divergence(both.where("candidate = 0"), both.where("candidate = 1").select(F.concat_ws(":", "source", F.col("id").cast("string")).alias("id"), "q"))


@query("""WITH t AS (SELECT doc_id, text AS a, replace(text, 'thing', 'matter') AS b FROM documents)
SELECT doc_id, 'thing' AS src, instr(a, 'thing') - 1 AS pos, (length(a) - length(replace(a, 'thing', ''))) // 5 AS n FROM t WHERE instr(a, 'thing') > 0 UNION ALL SELECT doc_id, 'the', instr(b, 'the') - 1, (length(b) - length(replace(b, 'the', ''))) // 3 FROM t WHERE instr(b, 'the') > 0""")
def substitutions_logged(spark, sf):
    rules = [("the", "a", ("x",), "r"), ("thing", "matter", ("x",), "r")]
    d = table(spark, sf, "documents").select("doc_id", F.explode(text.substitutions(F.col("text"), rules, {})).alias("x"))
    return d.select("doc_id", "x.src", F.col("x.pos").cast("long").alias("pos"), F.col("x.n").cast("long").alias("n"))


@query("""SELECT c_custkey, (c_custkey % 90 + 1) || '号' AS house_no, (c_custkey % 7 + 1) || '单元' AS unit, (c_custkey % 30 + 100) || '室' AS room, n_name || '路' AS geo_text, length(n_name) + 1 AS s, length(n_name) + 1 + length((c_custkey % 90 + 1) || '号') AS e FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def tails_found(spark, sf):
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("c_custkey")
    said = F.concat("n_name", F.lit("路"), (k % 90 + 1).cast("string"), F.lit("号"), (k % 7 + 1).cast("string"), F.lit("单元"), (k % 30 + 100).cast("string"), F.lit("室"))
    x = c.select("c_custkey", text.extract_tail(said).alias("t"))
    return x.select("c_custkey", "t.house_no", "t.unit", "t.room", "t.geo_text", F.col("t.spans")[0]["s"].cast("long").alias("s"), F.col("t.spans")[0]["e"].cast("long").alias("e"))


DIGITS = "translate({}::VARCHAR, '0123456789', '零一二三四五六七八九')"


@query(f"""SELECT p_partkey, p_size || '号' || CASE WHEN p_size > 9 THEN '3单元' || p_size || '室' ELSE '3单元' || {DIGITS.format('p_size')} END AS written FROM part""")
def numbers_written(spark, sf):
    spelled = F.translate(F.col("p_size").cast("string"), "0123456789", "零一二三四五六七八九")
    return table(spark, sf, "part").select("p_partkey", text.normalize_numbers(F.concat(spelled, F.lit("号三单元"), spelled)).alias("written"))


@query("""SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN n_name WHEN 1 THEN n_name WHEN 2 THEN n_name ELSE '' END AS aliases FROM nation""")
def short_names(spark, sf):
    k = F.col("n_nationkey") % 4
    name = F.when(k == 0, F.concat("n_name", F.lit("回族自治州"))).when(k == 1, F.concat("n_name", F.lit("新区"))).when(k == 2, F.concat("n_name", F.lit("市"))).otherwise(F.col("n_name"))
    return table(spark, sf, "nation").select("n_nationkey", F.array_join(text.aliases(name), ",").alias("aliases"))


@query("""SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'Cantonese (Guangdong accent)' WHEN 1 THEN 'Minnan language' WHEN 2 THEN 'Wu language' WHEN 3 THEN 'Sichuan' END AS label FROM customer""")
def dialect_labels(spark, sf):
    k = F.col("c_custkey") % 5
    said = F.when(k == 0, F.concat(F.lit("cantonese "), "c_name")).when(k == 1, F.concat("c_name", F.lit(" Hokkien"))).when(k == 2, F.concat(F.lit(" Wu "), "c_name")).when(k == 3, " Sichuan ").otherwise("Chinese")
    return table(spark, sf, "customer").select("c_custkey", phonetics.dialect_label(said).alias("label"))


@query("""SELECT count(*) AS n, count(*) FILTER (quality = 0 AND toxic = 0) AS new_flips, count(*) FILTER (quality = 0 AND toxic = 1) AS known_flips, count(*) FILTER (quality = 1 AND toxic = 1) AS fixed FROM labels""")
def injections(spark, sf):
    cases = table(spark, sf, "labels").select(F.lit("key").alias("expect_key"), F.when(F.col("quality") == 1, "has the key").otherwise("no").alias("output"), (F.col("toxic") == 1).alias("known_flip"))
    return stages.injection_outcome(cases)


@query("""WITH o AS (SELECT o_custkey AS id, min(o_orderkey) AS a, max(o_orderkey) AS b FROM orders GROUP BY 1), j AS (SELECT id, x.o_orderstatus AS s1, x.o_totalprice AS t1, y.o_orderstatus AS s2, y.o_totalprice AS t2, a <> b AS two FROM o JOIN orders x ON x.o_orderkey = a JOIN orders y ON y.o_orderkey = b),
r AS (SELECT *, CASE s1 WHEN 'F' THEN 4 WHEN 'O' THEN 3 ELSE 2 END AS r1, CASE s2 WHEN 'F' THEN 4 WHEN 'O' THEN 3 ELSE 2 END AS r2 FROM j)
SELECT id, CASE WHEN two AND (r2 > r1 OR (r2 = r1 AND t2 > t1 + 1e-6)) THEN t2 ELSE t1 END AS total, CASE WHEN two AND (r2 > r1 OR (r2 = r1 AND t2 > t1 + 1e-6)) THEN 'pass2' ELSE 'pass1' END AS chosen FROM r""")
def better_pass(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("doc_id"), F.when(F.col("o_orderstatus") == "F", "confident").when(F.col("o_orderstatus") == "O", "ambiguous").otherwise("partial").alias("decision"), F.col("o_totalprice").alias("total"), "o_orderkey")
    ends = o.groupBy("doc_id").agg(F.min("o_orderkey").alias("a"), F.max("o_orderkey").alias("b"))
    own = lambda k, more: o.join(ends.where(more).select(F.col(k).alias("o_orderkey")), "o_orderkey", "left_semi").drop("o_orderkey")
    return assemble.chosen_pass(own("a", "true"), own("b", "a <> b")).select(F.col("doc_id").alias("id"), "total", "chosen")


@query("WITH t AS (SELECT 'n' || n_nationkey AS adcode, n_name AS name FROM nation WHERE n_regionkey = 2) SELECT adcode, name FROM t UNION ALL SELECT 'c' || c_custkey, c_name FROM customer WHERE c_nationkey = 3")
def place_candidates(spark, sf):
    t = tree(spark, sf)
    return gz.candidates(t, "city", subtree="r2", hops=4).unionByName(gz.candidates(t, parent="n3")).select("adcode", "name")


@query("""WITH p AS (SELECT l_orderkey AS doc_id, min(l_discount) AS a, max(l_discount) AS b, count(*) AS n FROM lineitem GROUP BY 1) SELECT doc_id, CASE WHEN b - a > 0.05 + 1e-9 THEN 1 ELSE 2 END AS kept FROM p""")
def worse_hit_suppressed(spark, sf):
    p = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.min("l_discount").alias("a"), F.max("l_discount").alias("b"))
    hit = lambda c, o: F.struct(F.col(c).alias("dist"), F.lit(0.5).alias("prior"), F.lit("road").alias("level"), F.lit(0).alias("s"), F.lit(3).alias("e"), F.lit(o).alias("ord"))
    return p.select("doc_id", F.size(sm.suppress(F.array(hit("b", 2), hit("a", 1)), 0.05 + 1e-9)).alias("kept"))


# A gazetteer in Han characters from nations and suppliers, and what customers say of it.
HAN = "安北川东峨福广海吉昆"
SPELL = f"translate(lpad({{}}::VARCHAR, {{}}, '0'), '0123456789', '{HAN}')"


def _spell(c, n):
    return F.translate(F.lpad(c.cast("string"), n, "0"), "0123456789", HAN)


def spoken(spark, sf):
    """(places, documents, readings, costs): provinces of regions, cities of nations, roads of suppliers; each customer says a supplier's road in full."""
    return spoken_of(spark, *(table(spark, sf, t) for t in ("region", "nation", "supplier", "customer")))


def spoken_sized(spark, roads: int, texts: int):
    """The same with so many roads and texts, for benches."""
    r = spark.range(5).select(F.col("id").alias("r_regionkey"))
    n = spark.range(25).select(F.col("id").alias("n_nationkey"), (F.col("id") % 5).alias("n_regionkey"))
    s = spark.range(1, roads + 1).select(F.col("id").alias("s_suppkey"), (F.col("id") % 25).alias("s_nationkey"))
    return spoken_of(spark, r, n, s, spark.range(1, texts + 1).select(F.col("id").alias("c_custkey")).repartition(spark.sparkContext.defaultParallelism))


def spoken_of(spark, r, n, s, customers):
    place = lambda df, code, name, level, parent: df.select(code.alias("adcode"), name.alias("name"), F.lit(level).alias("level"), parent.alias("parent"))
    up = lambda k, c: F.concat(F.lit(k), c)
    places = (
        place(r, up("r", F.col("r_regionkey")), F.concat(F.lit("江"), _spell(F.col("r_regionkey"), 1), F.lit("省")), "province", F.lit(None).cast("string"))
        .unionAll(place(n, up("n", F.col("n_nationkey")), F.concat(F.lit("平"), _spell(F.col("n_nationkey"), 2), F.lit("市")), "city", up("r", F.col("n_regionkey"))))
        .unionAll(place(s, up("s", F.col("s_suppkey")), F.concat(_spell(F.col("s_suppkey"), 5), F.lit("路")), "road", up("n", F.col("s_nationkey"))))
        .withColumns({"aliases": F.array().cast("array<string>"), "prior": F.lit(0.5), "ord": F.xxhash64("adcode")})
    )
    said = customers.select("c_custkey").crossJoin(F.broadcast(s.agg(F.count("*").alias("n"), F.min("s_suppkey").alias("lo"))))
    said = said.withColumn("s_suppkey", F.col("lo") + F.col("c_custkey") % F.col("n")).join(s, "s_suppkey").join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    number = F.translate((F.col("c_custkey") % 9 + 1).cast("string"), "123456789", "一二三四五六七八九")
    docs = said.select(F.col("c_custkey").alias("doc_id"), F.concat(F.lit("我家住在江"), _spell(F.col("n_regionkey"), 1), F.lit("省平"), _spell(F.col("n_nationkey"), 2), F.lit("市"), _spell(F.col("s_suppkey"), 5), F.lit("路"), number, F.lit("号")).alias("text"))
    readings = phonetics.char_readings(spark, HAN + "江省平市路我家住在")
    costs = phonetics.confusion_costs(phonetics.confusion_rules(spark).where("space = 'mandarin'"))
    return places, docs, readings, costs


@query(f"""WITH b AS (SELECT count(*) AS n, min(s_suppkey) AS lo FROM supplier) SELECT c_custkey AS doc_id, '江' || {SPELL.format('n_regionkey', 1)} || '省平' || {SPELL.format('n_nationkey', 2)} || '市' || {SPELL.format('s_suppkey', 5)} || '路' || (c_custkey % 9 + 1) || '号' AS address, {SPELL.format('s_suppkey', 5)} || '路' AS road, '' AS unverified
FROM customer, b JOIN supplier ON s_suppkey = lo + c_custkey % n JOIN nation ON s_nationkey = n_nationkey""")
def texts_assembled(spark, sf):
    places, docs, readings, costs = spoken(spark, sf)
    chains = resolve.resolve_chains(docs, places, readings, costs)
    out = assemble.assembled(chains, phonetics.all_readings(readings), costs)
    return out.select("doc_id", "address", F.col("fields")["road"].alias("road"), F.col("fields")["unverified"].alias("unverified"))


@query("""WITH c AS (SELECT 110000 + 10000 * n_regionkey AS p, n_nationkey % 25 + 1 AS k FROM nation), rows AS (SELECT DISTINCT p AS code FROM c UNION SELECT p + 100 * k FROM c WHERE k % 3 > 0 UNION SELECT p + 100 * k + 7 FROM c)
SELECT code::VARCHAR AS adcode, CASE WHEN code % 10000 = 0 THEN 'province' WHEN code % 100 = 0 THEN 'city' ELSE 'district' END AS level, CASE WHEN code % 10000 = 0 THEN NULL WHEN code % 100 = 0 OR (code // 100 % 100) % 3 = 0 THEN (code // 10000 * 10000)::VARCHAR ELSE (code // 100 * 100)::VARCHAR END AS parent FROM rows""")
def national_levels(spark, sf):
    c = table(spark, sf, "nation").select((110000 + 10000 * F.col("n_regionkey")).alias("p"), (F.col("n_nationkey") % 25 + 1).alias("k"))
    codes = c.select("p").union(c.where("k % 3 > 0").selectExpr("p + 100 * k")).union(c.selectExpr("p + 100 * k + 7")).distinct()
    rows = codes.select(F.col("p").cast("string").alias("adcode"), F.concat(F.lit("x"), "p").alias("name"), F.lit(0.0).alias("longitude"), F.lit(0.0).alias("latitude"))
    generic = rows.limit(0).union(spark.createDataFrame([("990100", "市辖区", 0.0, 0.0)], rows.schema))
    return gz.national_codes(rows.union(generic)).select("adcode", "level", "parent")


@query("""SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN c_mktsegment WHEN 1 THEN c_name END AS language, CASE c_custkey % 3 WHEN 2 THEN c_name ELSE c_name || ' says ' || c_custkey END AS text FROM customer""")
def replies_parsed(spark, sf):
    k, said = F.col("c_custkey") % 3, F.concat("c_name", F.lit(" says "), F.col("c_custkey").cast("string"))
    raw = F.when(k == 0, F.concat(F.lit("language "), "c_mktsegment", F.lit("<asr_text>"), said)).when(k == 1, F.concat(F.lit("Language: "), "c_name", F.lit("\nText: "), said)).otherwise(F.concat(F.lit("  "), "c_name"))
    return table(spark, sf, "customer").select("c_custkey", text.parse_reply(raw).alias("x")).select("c_custkey", "x.language", "x.text")


@query("""WITH c AS (SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS a, count(*) FILTER (o_orderstatus = 'O') AS b FROM orders GROUP BY o_custkey), p AS (SELECT *, a + b AS m, least(a, b) AS k FROM c)
SELECT o_custkey, a AS b01, b AS b10, round(CASE WHEN m = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, k + 1), lambda i: factorial(m::INT)::DOUBLE / factorial(i::INT)::DOUBLE / factorial((m - i)::INT)::DOUBLE)) / pow(2.0, m)) END, 9) AS p FROM p""")
def mcnemar_counts(spark, sf):
    from ..functions import stats

    c = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "F").alias("b01"), F.count_if(F.col("o_orderstatus") == "O").alias("b10"))
    return c.select("o_custkey", "b01", "b10", F.round(stats.mcnemar(F.col("b01"), F.col("b10")), 9).alias("p"))


@query("""WITH f AS (SELECT l_orderkey, l_linenumber, l_partkey AS p, l_suppkey AS s, l_returnflag AS rf, l_linestatus AS ls FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN p % 41 = 0 THEN 'skip' WHEN p % 3 = 0 THEN CASE WHEN s % 4 = 0 THEN 'gate_over_reject' END WHEN p % 5 = 0 THEN 'db_missing' WHEN p % 7 = 0 THEN 'asr_unrecoverable'
 WHEN p % 11 = 0 AND (rf <> 'R' OR s % 3 > 0) AND (ls <> 'O' OR s % 5 > 0) AND s % 4 IN (1, 3) THEN 'normalize_error' WHEN rf = 'R' AND s % 3 = 0 THEN 'recall_miss' WHEN ls = 'O' AND s % 5 = 0 THEN 'rank_error' WHEN s % 4 = 2 THEN 'gate_over_accept' WHEN s % 4 = 0 THEN 'gate_over_reject' WHEN p % 13 = 0 THEN 'completion_error' ELSE 'assembly_error' END AS label FROM f""")
def failures_attributed(spark, sf):
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    q = F.when(s % 4 == 2, "FA").when(s % 4 == 0, "FR").when(s % 4 == 1, "TP").otherwise("TR")
    flags = {
        "quality": F.when(p % 41 == 0, "silent").otherwise("ok"), "exact": p % 3 == 0, "quadrant": q, "decision": F.lit("confident"), "name_lost": p % 5 == 0, "name_missing": p % 5 == 0, "gold_in_db": F.lit(True), "admin_all": F.lit(True),
        "phon_dist": F.when(p % 7 == 0, 0.5), "b_ok": p % 11 != 0, "c_evaluable": F.col("l_returnflag") == "R", "c_ok": s % 3 > 0, "recall_all": s % 3 > 0, "d_evaluable": F.col("l_linestatus") == "O", "d_ok": s % 5 > 0, "top1": s % 5 > 0,
        "quadrant_geo": q, "f_evaluable": F.lit(True), "backfill": p % 13 != 0,
    }
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", ev.attribute(flags).alias("label"))


@query("""WITH n AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '四川话' WHEN 1 THEN '香港' WHEN 2 THEN 'Hunan' ELSE c_name END AS said FROM customer) SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'mandarin_xinan' WHEN 1 THEN 'mandarin_yue' ELSE 'mandarin' END AS space, CASE c_custkey % 4 WHEN 0 THEN '官话系' WHEN 1 THEN '非官话·有库' WHEN 2 THEN '非官话·无库' ELSE '未知' END AS family FROM n""")
def dialects_routed(spark, sf):
    names, spaces = phonetics.routes(spark, available=("mandarin", "mandarin_xinan", "mandarin_yue"))
    k = F.col("c_custkey") % 4
    rows = table(spark, sf, "customer").select("c_custkey", F.when(k == 0, "四川话").when(k == 1, "香港").when(k == 2, "Hunan").otherwise(F.col("c_name")).alias("said"))
    return phonetics.route(rows, "said", names, spaces).select("c_custkey", "space", "family")


@query("""WITH h AS (SELECT l_orderkey AS doc_id, l_linenumber AS k, min(l_partkey) % 9 AS s, min(l_partkey) % 9 + 2 + min(l_suppkey) % 3 AS e FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1, 2),
t AS (SELECT a.doc_id, a.s AS s1, a.e AS e1, b.s AS s2, b.e AS e2, c.s AS s3, c.e AS e3 FROM h a LEFT JOIN h b ON b.doc_id = a.doc_id AND b.k = 2 LEFT JOIN h c ON c.doc_id = a.doc_id AND c.k = 3 WHERE a.k = 1),
u AS (SELECT *, s2 IS NOT NULL AND NOT (s2 < e1 AND s1 < e2) AS two FROM t)
SELECT doc_id, '1' || CASE WHEN two THEN ',2' ELSE '' END || CASE WHEN s3 IS NOT NULL AND NOT (s3 < e1 AND s1 < e3) AND NOT (two AND s3 < e2 AND s2 < e3) THEN ',3' ELSE '' END AS chain FROM u""")
def ancestors_attached(spark, sf):
    from ..operators import ranking as rk

    li = table(spark, sf, "lineitem").where("l_linenumber <= 3").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"), F.min("l_suppkey").alias("l_suppkey"))
    level = F.when(F.col("l_linenumber") == 1, "road").when(F.col("l_linenumber") == 2, "district").otherwise("province")
    h = li.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("string").alias("adcode"), level.alias("level"), (F.col("l_partkey") % 9).alias("s"), (F.col("l_partkey") % 9 + 2 + F.col("l_suppkey") % 3).alias("e"), F.lit(0.0).alias("dist"), F.lit(0.5).alias("prior"))
    nodes = spark.createDataFrame([("3", None), ("2", "3"), ("1", "2")], "adcode string, parent string")
    return rk.ancestor_chains(h, gz.closure(nodes, 4)).where("adcode = '1'").select("doc_id", F.array_join(F.transform("evidence", lambda x: x["adcode"]), ",").alias("chain"))


@query("SELECT n_nationkey, regexp_replace(lower(n_name), '[^a-z ]', '', 'g') AS syllables FROM nation")
def syllables_toneless(spark, sf):
    marked = F.concat_ws("3 ", F.split(F.translate(F.lower("n_name"), "aeiou", "āéǐòū"), " "))
    return table(spark, sf, "nation").select("n_nationkey", F.array_join(phonetics.toneless(marked), " ").alias("syllables"))


@query("""WITH c AS (SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS k, count(*) AS n FROM orders GROUP BY o_custkey) SELECT o_custkey, CASE WHEN n < 20 THEN k || '/' || n ELSE 'many' END AS rate, CASE WHEN n > 0 THEN round(3.0 / n, 9) END AS upper FROM c""")
def rates_told(spark, sf):
    from ..functions import stats

    c = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "F").alias("k"), F.count("*").alias("n"))
    told = stats.rate_text(F.col("k"), F.col("n"))
    return c.select("o_custkey", F.when(F.col("n") < 20, told).otherwise(F.when(told.rlike(r"^[0-9.]+% \[[0-9.]+%, [0-9.]+%\]$"), "many")).alias("rate"), F.round(stats.rule_of_three(F.col("n")), 9).alias("upper"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(CASE WHEN l_returnflag = 'R' THEN 0.9 ELSE 0.5 END * l_discount + CASE WHEN l_returnflag = 'A' THEN 0.0 ELSE 0.2 END * l_tax + 0.15 * l_quantity / 50 + 0.15 * l_linenumber / 7 - 0.25 * l_tax, 9) AS total FROM lineitem""")
def chain_totals(spark, sf):
    from ..operators import ranking as rk

    own = F.when(F.col("l_returnflag") == "R", F.create_map(F.lit("W_SIM"), F.lit(0.9))).when(F.col("l_returnflag") == "A", F.create_map(F.lit("W_COV"), F.lit(0.0))).otherwise(F.create_map().cast("map<string,double>"))
    li = table(spark, sf, "lineitem").withColumn("params", own)
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(rk.total(F.col("l_discount"), F.col("l_tax"), F.col("l_quantity") / 50, F.col("l_linenumber") / 7, F.col("l_tax")), 9).alias("total"))


@query("""WITH f AS (SELECT *, l_partkey % 12 AS s, l_partkey % 12 + 2 AS e, l_discount * 2 AS dist, l_returnflag = 'R' AS weak, l_suppkey % 3 AS lv FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(CASE WHEN dist <= 0.15 AND NOT weak AND l_linestatus = 'O' AND s < 10 AND (s < 5 OR lv >= 1) AND NOT (s < 5 AND 3 < e) AND NOT (s < 10 AND 8 < e) THEN (1 - dist) * CASE lv WHEN 0 THEN 0.6 WHEN 1 THEN 0.8 ELSE 1.0 END / 1.2 ELSE 0 END, 9) AS conflict FROM f""")
def conflict_terms(spark, sf):
    from ..operators import ranking as rk

    li = table(spark, sf, "lineitem")
    hit = lambda code, level, order, s, e: F.struct(F.lit(code).alias("adcode"), F.lit(level).alias("level"), F.lit(order).alias("level_ord"), F.lit(s).alias("s"), F.lit(e).alias("e"))
    lv = (F.col("l_suppkey") % 3).cast("int")
    other = F.struct(F.lit("x").alias("adcode"), (F.col("l_discount") * 2).alias("dist"), (F.col("l_returnflag") == "R").alias("weak"), F.element_at(F.array(*map(F.lit, gz.LEVELS)), lv + 1).alias("level"), lv.alias("level_ord"), (F.col("l_partkey") % 12).cast("int").alias("s"), (F.col("l_partkey") % 12 + 2).cast("int").alias("e"), (F.col("l_linestatus") == "O").alias("on_chain"))
    evidence = F.array(hit("c", "city", 1, 3, 5), hit("r", "road", 4, 8, 10))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(rk.conflict(evidence, F.array(F.lit("c"), F.lit("r")), F.array(other)), 9).alias("conflict"))


@query("""SELECT o_orderkey, coalesce(CASE o_orderpriority WHEN '1-URGENT' THEN true WHEN '2-HIGH' THEN true ELSE false END AND (o_custkey % 2 = 0 OR o_orderstatus = 'O'), false) AS scored FROM orders WHERE o_orderstatus <> 'P'""")
def scored_orders(spark, sf):
    from ..operators import quality as qu

    o = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "P", "ok").otherwise("silent").alias("quality"), F.when(F.col("o_orderpriority") == "1-URGENT", "draft").when(F.col("o_orderpriority") == "2-HIGH", "confirmed").otherwise("pending").alias("label_status"), F.when(F.col("o_custkey") % 2 == 0, "x").alias("gold"), (F.col("o_orderstatus") != "O").alias("has_address"))
    return qu.scored_rows(o).select("o_orderkey", "scored")


@query("""WITH t AS (SELECT c_custkey, c_custkey % 3 AS a, c_custkey % 2 AS b FROM customer) SELECT c_custkey, CASE WHEN a = 0 AND b = 0 THEN 0.0 WHEN a = 0 OR b = 0 THEN 1.0 WHEN a = 1 THEN 0.045 ELSE 0.5225 END AS distance FROM t""")
def reading_distances(spark, sf):
    d = phonetics.weighted_distance(phonetics.confusion_costs(phonetics.confusion_rules(spark).where("space = 'mandarin'")))
    syl = lambda c: F.transform(F.filter(F.split(c, " "), lambda x: x != ""), phonetics.split_syllable)
    k = F.col("c_custkey")
    rows = table(spark, sf, "customer").select("c_custkey", syl(F.when(k % 3 == 0, "").when(k % 3 == 1, "niu").otherwise("niu wo")).alias("a"), syl(F.when(k % 2 == 0, "").otherwise("liu")).alias("b"))
    return rows.select("c_custkey", F.round(phonetics.reading_distance(F.col("a"), F.col("b"), d), 9).alias("distance"))
