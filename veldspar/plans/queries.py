"""Registered queries of the library's operators, each with SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import phonetics, stats, text
from ..operators import evaluation as ev
from ..operators import gazetteer as gz
from ..operators import quality as qu
from ..operators import ranking as rk
from ..operators import search
from ..operators import similarity as sm
from ..operators import stages as st
from . import resolve

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# A forest from the star schema: regions over nations over customers.
TREE_SQL = """tree AS (
  SELECT 'r' || r_regionkey AS adcode, r_name AS name, 'province' AS level, NULL AS parent FROM region
  UNION ALL SELECT 'n' || n_nationkey, n_name, 'city', 'r' || n_regionkey FROM nation
  UNION ALL SELECT 'c' || c_custkey, c_name, 'road', 'n' || c_nationkey FROM customer)"""


def tree(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("adcode"), F.col("r_name").alias("name"), F.lit("province").alias("level"), F.lit(None).cast("string").alias("parent"))
    n = table(spark, sf, "nation").select(F.concat(F.lit("n"), "n_nationkey"), "n_name", F.lit("city"), F.concat(F.lit("r"), "n_regionkey"))
    c = table(spark, sf, "customer").select(F.concat(F.lit("c"), "c_custkey"), "c_name", F.lit("road"), F.concat(F.lit("n"), "c_nationkey"))
    return r.unionAll(n).unionAll(c)


@query(f"""WITH RECURSIVE {TREE_SQL}, up AS (
  SELECT adcode, adcode AS ancestor, 0 AS hop, parent FROM tree
  UNION ALL SELECT up.adcode, t.adcode, hop + 1, t.parent FROM up JOIN tree t ON up.parent = t.adcode)
SELECT adcode, ancestor, hop FROM up""")
def ancestor_closure(spark, sf):
    return gz.closure(tree(spark, sf), 4)


@query(f"WITH {TREE_SQL} SELECT t.adcode, t.name FROM tree t JOIN tree p ON t.parent = p.adcode WHERE t.level = 'road' AND p.parent = 'r1'")
def descendants(spark, sf):
    return gz.descendants(tree(spark, sf), "r1", "road", 4).select("adcode", "name")


@query(f"WITH {TREE_SQL} SELECT t.adcode, coalesce(g.name, '') || coalesce(p.name, '') || t.name AS full_name FROM tree t LEFT JOIN tree p ON t.parent = p.adcode LEFT JOIN tree g ON p.parent = g.adcode")
def full_names(spark, sf):
    return gz.full_names(tree(spark, sf), 4)


@query(f"WITH {TREE_SQL} SELECT level, count(*) AS n FROM tree GROUP BY level")
def level_stats(spark, sf):
    return gz.level_stats(tree(spark, sf))


@query("""WITH t AS (SELECT o_orderkey % 500 AS adcode, CASE WHEN o_custkey % 3 > 0 THEN o_custkey + 300 END AS parent FROM orders)
SELECT 'duplicate code' AS problem, adcode FROM t GROUP BY adcode HAVING count(*) > 1
UNION ALL SELECT 'missing parent', adcode FROM t WHERE parent IS NOT NULL AND parent NOT IN (SELECT adcode FROM t)""")
def gazetteer_integrity(spark, sf):
    o = table(spark, sf, "orders")
    return gz.integrity(o.select((F.col("o_orderkey") % 500).alias("adcode"), F.when(F.col("o_custkey") % 3 > 0, F.col("o_custkey") + 300).alias("parent")))


@query("""SELECT key, count(DISTINCT adcode) AS owners FROM (SELECT p_partkey AS adcode, lower(n) AS key FROM part, unnest([p_name, p_brand || ' ' || p_type]) AS u(n)) GROUP BY key""")
def name_collisions(spark, sf):
    places = table(spark, sf, "part").select(F.col("p_partkey").alias("adcode"), F.col("p_name").alias("name"), F.array(F.concat_ws(" ", "p_brand", "p_type")).alias("aliases"))
    return gz.collisions(gz.names(places), F.lower("name"))


@query("""SELECT n_nationkey, n_name AS name, (SELECT min(c_custkey) FROM customer WHERE c_mktsegment || c_nationkey = 'BUILDING' || n_nationkey) AS adcode FROM nation""")
def name_lookup(spark, sf):
    places = table(spark, sf, "customer").select(F.col("c_custkey").alias("adcode"), F.col("c_name").alias("name"), F.array(F.concat("c_mktsegment", "c_nationkey")).alias("aliases"), F.lit("road").alias("level"), F.col("c_custkey").alias("ord"))
    n = table(spark, sf, "nation")
    found = gz.lookup(n.select("n_nationkey", "n_name", F.concat(F.lit("BUILDING"), "n_nationkey").alias("name")), places, ("road",))
    return found.select("n_nationkey", F.col("n_name").alias("name"), "adcode")


@query(f"""WITH {TREE_SQL} SELECT adcode, name FROM tree t WHERE NOT (name = 'ASIA' OR (level = 'road' AND parent IN ('n3', 'n4')))""")
def places_without(spark, sf):
    t = tree(spark, sf)
    drops = t.where("level = 'road' and parent in ('n3', 'n4')").select("name", "parent").unionAll(spark.createDataFrame([("ASIA", None)], "name string, parent string"))
    return gz.without(t.withColumn("aliases", F.array().cast("array<string>")), drops)[0].select("adcode", "name")


@query(f"""WITH {TREE_SQL}, gold AS (SELECT DISTINCT 'x' || name AS name, parent FROM tree WHERE level = 'city' UNION SELECT name, parent FROM tree WHERE level = 'city')
SELECT name, parent FROM tree WHERE level <> 'road' UNION ALL SELECT name, parent FROM gold g WHERE NOT EXISTS (SELECT 1 FROM tree t WHERE t.name = g.name AND t.parent IS NOT DISTINCT FROM g.parent)""")
def places_with_missing(spark, sf):
    t = tree(spark, sf).where("level <> 'road'").select("name", "parent")
    city = t.where("parent is not null")
    return gz.with_missing(t, city.select(F.concat(F.lit("x"), "name").alias("name"), "parent").unionAll(city).unionAll(city))


@query("""SELECT adcode, name, level, parent FROM (VALUES ('110000','北京市','province',NULL),('130000','河北省','province',NULL),('130100','石家庄市','city','130000'),('130102','长安区','district','130100'),('139001','定州市','district','130000')) AS t(adcode, name, level, parent)""")
def national_codes(spark, sf):
    rows = [(110000, "北京市"), (110100, "市辖区"), (130000, "河北省"), (130100, "石家庄市"), (130102, "长安区"), (139001, "定州市")]
    df = spark.createDataFrame([(a, b, 0.0, 0.0) for a, b in rows], "adcode long, name string, longitude double, latitude double")
    return gz.national_codes(df).select("adcode", "name", "level", "parent")


# Gold fields from customers: their region, nation and, for a third, a nation of another region; a road that is there, is elsewhere or is missing.
GOLD_SQL = """gold AS (SELECT c_custkey AS id, r_name AS province, CASE c_custkey % 3 WHEN 0 THEN o.n_name ELSE n.n_name END AS city, '' AS district, '' AS street,
  CASE c_custkey % 4 WHEN 0 THEN 'Customer#' || lpad((c_custkey + 1)::VARCHAR, 9, '0') WHEN 1 THEN 'nowhere' WHEN 2 THEN '' ELSE c_name END AS road, CASE WHEN c_custkey % 5 = 0 THEN c_name ELSE '' END AS community
  FROM customer JOIN nation n ON c_nationkey = n.n_nationkey JOIN region ON n.n_regionkey = r_regionkey JOIN nation o ON o.n_nationkey = (n.n_nationkey + 7) % 25)"""


def _gold(spark, sf):
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    other = n.select(F.col("n_nationkey").alias("_k"), F.col("n_name").alias("_other"))
    c = table(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).join(other, (F.col("n_nationkey") + 7) % 25 == F.col("_k"))
    key = F.col("c_custkey")
    road = F.when(key % 4 == 0, F.concat(F.lit("Customer#"), F.lpad((key + 1).cast("string"), 9, "0"))).when(key % 4 == 1, "nowhere").when(key % 4 == 2, "").otherwise(F.col("c_name"))
    return c.select(key.alias("id"), F.col("r_name").alias("province"), F.when(key % 3 == 0, F.col("_other")).otherwise(F.col("n_name")).alias("city"), F.lit("").alias("district"), F.lit("").alias("street"), road.alias("road"), F.when(key % 5 == 0, F.col("c_name")).otherwise("").alias("community"))


GOLD_CHAIN_SQL = f"""{TREE_SQL}, {GOLD_SQL},
p AS (SELECT g.*, t.adcode AS province_code FROM gold g LEFT JOIN tree t ON t.level = 'province' AND t.name = g.province),
c AS (SELECT p.*, t.adcode AS city_code FROM p LEFT JOIN tree t ON t.level = 'city' AND t.name = p.city),
f AS (SELECT c.*, a.adcode AS community_code, b.adcode AS road_code FROM c LEFT JOIN tree a ON a.level = 'road' AND a.name = c.community AND (a.parent = city_code OR EXISTS (SELECT 1 FROM tree x WHERE x.adcode = a.parent AND x.parent = province_code))
  LEFT JOIN tree b ON b.level = 'road' AND b.name = c.road AND (b.parent = city_code OR EXISTS (SELECT 1 FROM tree x WHERE x.adcode = b.parent AND x.parent = province_code))),
chain AS (SELECT id, province_code, city_code, coalesce(community_code, road_code) AS deepest_code, CASE WHEN community_code IS NOT NULL THEN 'community' WHEN road_code IS NOT NULL THEN 'road' END AS deepest_field,
  list_filter([CASE WHEN community <> '' AND community_code IS NULL THEN community END, CASE WHEN road <> '' AND road_code IS NULL THEN road END], lambda x: x IS NOT NULL) AS missing, community, road FROM f)"""


def _tree_places(spark, sf):
    return tree(spark, sf).withColumns({"aliases": F.array().cast("array<string>"), "ord": F.col("adcode")})


@query(f"""WITH {GOLD_CHAIN_SQL} SELECT id, province_code, city_code, deepest_code, deepest_field, array_to_string(missing, '|') AS missing, deepest_code IS NOT NULL AS evaluable,
  CASE WHEN community <> '' THEN NOT list_contains(missing, community) WHEN road <> '' THEN NOT list_contains(missing, road) ELSE false END AS in_db FROM chain""")
def gold_chain(spark, sf):
    g = st.gold_chain(_gold(spark, sf), _tree_places(spark, sf), 4)
    return g.select("id", "province_code", "city_code", "deepest_code", "deepest_field", F.array_join("missing", "|").alias("missing"), "evaluable", "in_db")


@query(f"""WITH {GOLD_CHAIN_SQL}, chains AS (SELECT c_custkey AS id, 'c' || (c_custkey + k) AS road, 'n' || c_nationkey AS city, k FROM customer, range(2) t(k))
SELECT id, k, coalesce(s.road = deepest_code AND (city_code IS NULL OR city_code = s.city), false) AS matches FROM chains s JOIN chain USING (id)""")
def chain_matches(spark, sf):
    g = st.gold_chain(_gold(spark, sf), _tree_places(spark, sf), 4).select("id", *[f"{a}_code" for a in st.ADMIN], "deepest_code")
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("n"), "c_nationkey").alias("own"), F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("k"))
    rows = c.join(g, "id").withColumn("road", F.concat(F.lit("c"), F.col("id") + F.col("k")))
    entries = F.array(F.struct(F.lit("city").alias("level"), F.col("own").alias("code")), F.struct(F.lit("road").alias("level"), F.col("road").alias("code")))
    return rows.select("id", "k", st.chain_matches(F.array("road", "own"), entries, F.col("deepest_code"), {a: F.col(f"{a}_code") for a in st.ADMIN}).alias("matches"))


RULES = [("thing", "matter", ("a",), "x"), ("the", "a", ("a", "b"), "x"), ("and", "", ("b",), "x"), ("erin", "er", ("c",), "x"), ("other", "else", ("通用",), "x")]


@query(r"""SELECT doc_id, regexp_replace(replace(replace(replace(replace(replace(replace(text, 'thing', 'matter'), 'other', 'else'), 'erin', 'er'), 'the', 'a'), 'and', ''), 'q', 'kk'), '\s+', '', 'g') AS rewritten FROM documents""")
def lexicon_rewrite(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.rewrite(F.col("text"), RULES, {"q": "kk"}).alias("rewritten"))


@query("""SELECT doc_id, contains(text, 'thing') OR contains(text, 'the') OR contains(text, 'and') OR contains(text, 'erin') OR contains(text, 'other') AS marked,
 contains(text, 'thing')::INT + contains(text, 'the')::INT AS a, contains(text, 'the')::INT + contains(text, 'and')::INT AS b FROM documents""")
def lexicon_markers(spark, sf):
    hits = text.group_hits(F.col("text"), RULES)
    return table(spark, sf, "documents").select("doc_id", text.has_markers(F.col("text"), RULES).alias("marked"), F.coalesce(hits["a"], F.lit(0)).alias("a"), F.coalesce(hits["b"], F.lit(0)).alias("b"))


@query("""SELECT * FROM (VALUES ('屋头在巷巷头', '家在巷子里'), ('我屋里头喺成都 哈', '我家里在成都'), ('係度', '在度'), ('棟 三号嘛', '栋三号')) AS t(spoken, rewritten)""")
def lexicon_fixed(spark, sf):
    df = spark.createDataFrame([("屋头在巷巷头",), ("我屋里头喺成都 哈",), ("係度",), ("棟 三号嘛",)], "spoken string")
    return df.select("spoken", text.rewrite(F.col("spoken")).alias("rewritten"))


@query("SELECT p_partkey, p_size::BIGINT AS n FROM part")
def numeral_digits(spark, sf):
    spelled = F.translate(F.col("p_size").cast("string"), "0123456789", "零一二三四五六七八九")
    return table(spark, sf, "part").select("p_partkey", text.numeral(spelled).alias("n"))


@query("""SELECT s, n::BIGINT AS n FROM (VALUES ('八百八',880),('一百五',150),('两千六',2600),('一万五',15000),('八百零八',808),('十八',18),('二十',20),('三百二十一',321),('一千零一',1001),('一万零五十',10050),('二零一',201),('幺洞',NULL),('八百一百八',NULL),('二十百',NULL),('百八',NULL),('八八百',NULL),('一百零十',NULL),('三十二五',NULL),('八零百',NULL),('万',NULL),('一万二万',NULL),('零零七',7),('42',42),('',NULL)) AS t(s, n)""")
def numeral_places(spark, sf):
    given = "八百八 一百五 两千六 一万五 八百零八 十八 二十 三百二十一 一千零一 一万零五十 二零一 幺洞 八百一百八 二十百 百八 八八百 一百零十 三十二五 八零百 万 一万二万 零零七 42".split(" ")
    return spark.createDataFrame([(x,) for x in [*given, ""]], "s string").select("s", text.numeral(F.col("s")).alias("n"))


@query("""SELECT * FROM (VALUES ('红牌楼三十号附二号', '红牌楼30号附2号'), ('三单元二零一', '3单元201室'), ('二十楼二零零八', '20楼2008室'), ('三单元三十', '3单元三十'), ('二环路南四段', '二环路南四段'), ('八百一百八号', '八百一百八号'), ('一栋二单元五零三室', '1栋2单元503室'), ('五楼一', '5楼一')) AS t(spoken, written)""")
def numbers_normalized(spark, sf):
    given = ["红牌楼三十号附二号", "三单元二零一", "二十楼二零零八", "三单元三十", "二环路南四段", "八百一百八号", "一栋二单元五零三室", "五楼一"]
    return spark.createDataFrame([(x,) for x in given], "spoken string").select("spoken", text.normalize_numbers(F.col("spoken")).alias("written"))


@query("""SELECT * FROM (VALUES ('二环路南四段30号附2号', '30号附2号', '', '', '', '', '二环路南四段'), ('中山路5号楼3单元201室', '', '5号楼', '3单元', '201室', '', '中山路'), ('人民路12号A座20楼2008室', '12号', 'A座', '', '2008室', '20楼', '人民路'), ('8号9号', '8号', '', '', '', '', '9号'), ('', '', '', '', '', '', '')) AS t(t, house_no, building, unit, room, floor, geo_text)""")
def tail_fields(spark, sf):
    given = ["二环路南四段30号附2号", "中山路5号楼3单元201室", "人民路12号A座20楼2008室", "8号9号", ""]
    return spark.createDataFrame([(x,) for x in given], "t string").select("t", text.extract_tail(F.col("t")).alias("x")).select("t", "x.*").drop("spans")


@query("""SELECT * FROM (VALUES ('language Sichuan<asr_text>hello there', 'Sichuan', 'hello there'), ('Language: Wu language\nText: abc', 'Wu language', 'abc'), ('plain', NULL, 'plain')) AS t(raw, language, text)""".replace("\\n", "\n"))
def reply_parsed(spark, sf):
    given = ["language Sichuan<asr_text>hello there", "Language: Wu language\nText: abc", "plain"]
    return spark.createDataFrame([(x,) for x in given], "raw string").select("raw", text.parse_reply(F.col("raw")).alias("x")).select("raw", "x.*")


@query("""WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS i FROM documents), f AS (SELECT doc_id, w, min(i) AS i FROM w WHERE w <> '' GROUP BY doc_id, w),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM f), c AS (SELECT doc_id, string_agg(w, chr(10) ORDER BY i) AS context FROM r WHERE k <= 200 GROUP BY doc_id) SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(context, '') END AS context FROM documents d LEFT JOIN c ON d.doc_id = c.doc_id""")
def context_lines(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.context_lines(F.split("text", " ")).alias("context"))


@query("SELECT c_custkey, translate(c_custkey::VARCHAR, '0123456789', '零一二三四五六七八九') AS han FROM customer")
def han_projection(spark, sf):
    mixed = F.concat(F.lit("No. "), F.translate(F.col("c_custkey").cast("string"), "0123456789", "零一二三四五六七八九"), F.lit(" / "), "c_name")
    return table(spark, sf, "customer").select("c_custkey", text.han_only(mixed).alias("han"))


@query(r"""WITH t AS (SELECT item_id, text AS t FROM benchmark), x AS (SELECT a.item_id, b.item_id AS other, a.t AS a, b.t AS b, list_distinct(string_split(a.t || b.t, '')) AS cs FROM t a JOIN t b ON a.item_id < b.item_id),
m AS (SELECT item_id, other, length(b) AS n, array_to_string(list_transform(string_split(a, ''), lambda c: chr((33 + list_position(cs, c))::INT)), '') AS a, array_to_string(list_transform(string_split(b, ''), lambda c: chr((33 + list_position(cs, c))::INT)), '') AS b FROM x)
SELECT item_id, other, round(levenshtein(a, b) / n, 6) AS cer FROM m""")
def error_rate(spark, sf):
    b = table(spark, sf, "benchmark").select("item_id", F.col("text").alias("t"))
    pairs = b.alias("a").join(b.alias("b"), F.col("a.item_id") < F.col("b.item_id"))
    return pairs.select(F.col("a.item_id"), F.col("b.item_id").alias("other"), F.round(ev.cer(F.col("a.t"), F.col("b.t")), 6).alias("cer"))


@query("""WITH r(k, ps, cost) AS (VALUES ('i', ['n','l'], 0.1), ('i', ['r','y',''], 0.3), ('i', ['n','r'], 0.35), ('i', ['r','l'], 0.25), ('i', ['y','r'], 0.2))
SELECT k AS kind, a, b, min(cost)::DOUBLE AS cost FROM (SELECT k, cost, unnest(ps) AS a, ps FROM r) s, unnest(s.ps) AS u(b) WHERE a <> b GROUP BY k, a, b""")
def confusion_table(spark, sf):
    rows = [("i", ["n", "l"], 0.1), ("i", ["r", "y", ""], 0.3), ("i", ["n", "r"], 0.35), ("i", ["r", "l"], 0.25), ("i", ["y", "r"], 0.2)]
    rules = spark.createDataFrame([(*r, ["x"]) for r in rows], "kind string, phonemes array<string>, cost double, dialects array<string>")
    return phonetics.confusion_costs(rules, ("x",))


@query("""SELECT * FROM (VALUES ('niu', 'liu', 0.045), ('zhong guo', 'zong guo', 0.054), ('cheng du', 'chen du', 0.055), ('ren min lu', 'min quan lu', 2.0), ('jiao tong', 'gao tong', 0.2), ('a', 'a b', 1.0)) AS t(a, b, dist)""")
def weighted_distance(spark, sf):
    d = phonetics.weighted_distance(phonetics.confusion_costs(phonetics.confusion_rules(spark).where("space = 'mandarin'")))
    rows = [("niu", "liu"), ("zhong guo", "zong guo"), ("cheng du", "chen du"), ("ren min lu", "min quan lu"), ("jiao tong", "gao tong"), ("a", "a b")]
    syl = lambda c: F.transform(F.split(c, " "), phonetics.split_syllable)
    return spark.createDataFrame(rows, "a string, b string").select("a", "b", F.round(d(syl("a"), syl("b")), 6).alias("dist"))


@query("""SELECT * FROM (VALUES ('四川话', 'mandarin_xinan', '官话系'), ('香港', 'mandarin_yue', '非官话·有库'), ('Hunan', 'mandarin', '非官话·无库'), ('??', 'mandarin', '未知')) AS t(said, space, family)""")
def dialect_route(spark, sf):
    names, spaces = phonetics.routes(spark, available=("mandarin", "mandarin_xinan", "mandarin_yue"))
    return phonetics.route(spark.createDataFrame([("四川话",), ("香港",), ("Hunan",), ("??",)], "said string"), "said", names, spaces)


# Similarity joins: words of short documents against names of parts; the distance is a plain edit distance of token arrays.
WORDS_SQL = """d AS (SELECT item_id AS doc_id, string_split(lower(text), ' ') AS toks FROM benchmark),
nm AS (SELECT s_suppkey AS adcode, list_slice(string_split((SELECT lower(text) FROM benchmark WHERE item_id = s_suppkey % 20), ' '), 3, 3 + s_suppkey % 3) AS syl FROM supplier)"""


def _words(spark, sf):
    b = table(spark, sf, "benchmark")
    docs = b.select(F.col("item_id").alias("doc_id"), F.split(F.lower("text"), " ").alias("toks"))
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("adcode"))
    names = s.join(b, F.col("adcode") % 20 == F.col("item_id")).select("adcode", F.col("adcode").alias("name_id"), F.lit(0).alias("name_ord"), F.slice(F.split(F.lower("text"), " "), F.lit(3), F.col("adcode").cast("int") % 3 + 1).alias("syl"))
    return docs, names


def _hamming(a, b):
    """Places at which token arrays differ, the longer one's rest included."""
    return (F.size(F.filter(F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y)), lambda x: x))).cast("double")


@query(f"WITH {WORDS_SQL} SELECT DISTINCT doc_id, adcode AS name_id FROM d JOIN nm ON list_has_any(toks, syl)")
def shared_token_pairs(spark, sf):
    docs, names = _words(spark, sf)
    return sm.shared_token(docs, "toks", names, "syl")


@query(f"""WITH {WORDS_SQL}, p AS (SELECT doc_id, adcode, syl, toks, len(syl) AS L FROM d JOIN nm ON list_has_any(toks, syl)),
w AS (SELECT p.*, u.w FROM p, unnest(CASE WHEN L <= 1 THEN [L] ELSE [L - 1, L, L + 1] END) AS u(w) WHERE u.w <= len(toks)),
x AS (SELECT doc_id, adcode, L, w, s, list_slice(toks, s + 1, s + w) AS win, syl FROM w, unnest(range(0, len(toks) - w + 1)) AS v(s)),
y AS (SELECT doc_id, adcode, w, s, list_sum(list_transform(range(1, greatest(w, L) + 1), lambda i: (win[i] IS DISTINCT FROM syl[i])::INT)) / greatest(w, L) AS dist FROM x),
z AS (SELECT *, row_number() OVER (PARTITION BY doc_id, adcode ORDER BY round(dist, 9), w, s) AS r FROM y)
SELECT doc_id, adcode, round(dist, 6) AS dist, s, s + w AS e FROM z WHERE r = 1""")
def window_similarity(spark, sf):
    docs, names = _words(spark, sf)
    found = sm.best_windows(docs, "toks", names, "syl", _hamming)
    return found.select("doc_id", "adcode", F.round("dist", 6).alias("dist"), "s", "e")


@query("""WITH q AS (SELECT n_nationkey AS query_id, n_name FROM nation), c AS (SELECT c_custkey AS adcode, c_acctbal AS prior, c_mktsegment || c_nationkey AS nm FROM customer),
s AS (SELECT query_id, adcode, prior, levenshtein(n_name, nm) / greatest(length(n_name), length(nm)) AS dist FROM q, c WHERE abs(length(n_name) - length(nm)) <= 0.9 * greatest(length(n_name), length(nm)))
SELECT query_id, adcode, round(dist, 6) AS dist, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, prior DESC, adcode) AS rank FROM s WHERE dist <= 0.9) WHERE rank <= 5""")
def match_topk(spark, sf):
    letters = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    q = table(spark, sf, "nation").select(F.col("n_nationkey").alias("query_id"), letters("n_name").alias("syllables"))
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("adcode"), F.col("c_acctbal").alias("prior"), letters(F.concat("c_mktsegment", "c_nationkey")).alias("syllables"))
    d = lambda a, b: F.levenshtein(F.array_join(a, ""), F.array_join(b, "")).cast("double")
    return sm.match_names(q, c, d, 5, 0.9).withColumn("dist", F.round("dist", 6))


@query("""SELECT * FROM (VALUES (1, [1, 2, 4]), (2, [5, 7]), (3, [8, 9])) AS t(doc_id, kept)""")
def hit_suppression(spark, sf):
    rows = [(1, 1, "road", 0.0, 0, 4), (1, 2, "city", 0.3, 1, 3), (1, 3, "road", 0.2, 2, 5), (1, 4, "road", 0.3, 4, 6), (2, 5, "road", 0.0, 0, 3), (2, 6, "road", 0.2, 2, 5), (2, 7, "road", 0.36, 4, 7), (3, 8, "road", 0.1, 0, 2), (3, 9, "road", 0.2, 1, 3)]
    h = spark.createDataFrame([(a, b, c, d, e, f, 0.5) for a, b, c, d, e, f in rows], "doc_id int, ord int, level string, dist double, s int, e int, prior double")
    kept = sm.suppress(F.collect_list(F.struct("dist", "prior", "level", "s", "e", "ord")))
    return h.groupBy("doc_id").agg(F.array_sort(F.transform(kept, lambda x: x["ord"])).alias("kept"))


@query("""WITH s AS (SELECT o_custkey AS g, o_orderkey AS k, list(DISTINCT l_partkey % 20) AS codes FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2)
SELECT a.g, a.k FROM s a WHERE NOT EXISTS (SELECT 1 FROM s b WHERE a.g = b.g AND a.k <> b.k AND len(list_intersect(a.codes, b.codes)) = len(a.codes) AND len(a.codes) < len(b.codes))""")
def set_dominance(spark, sf):
    o = table(spark, sf, "orders").join(table(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    s = o.groupBy(F.col("o_custkey").alias("g"), F.col("o_orderkey").alias("k")).agg(F.collect_set(F.col("l_partkey") % 20).alias("codes")).withColumn("levels", F.array(F.lit("x")))
    return sm.undominated(s, "k", "g", "codes", "levels").select("g", "k")


@query("""SELECT doc_id, adcode, dist, ord FROM (SELECT l_orderkey AS doc_id, l_partkey % 3 AS adcode, l_discount AS dist, l_linenumber AS ord, row_number() OVER (PARTITION BY l_orderkey, l_partkey % 3 ORDER BY l_discount, l_linenumber) AS r FROM lineitem) WHERE r = 1""")
def best_hit_per_code(spark, sf):
    h = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_partkey") % 3).alias("adcode"), F.col("l_discount").alias("dist"), F.col("l_linenumber").alias("ord"))
    return rk.best_per_code(h)


@query("""SELECT * FROM (VALUES (1, 'r', ['r', 'd', 'p']), (1, 'd', ['d', 'p']), (1, 'p', ['p']), (2, 'r', ['r', 'p']), (2, 'd', ['d', 'p']), (2, 'p', ['p'])) AS t(doc_id, adcode, chain)""")
def chains_from_hits(spark, sf):
    nodes = spark.createDataFrame([("p", None), ("d", "p"), ("r", "d")], "adcode string, parent string")
    rows = [(1, "p", "province", 0, 2), (1, "d", "district", 2, 4), (1, "r", "road", 4, 7), (2, "p", "province", 0, 2), (2, "d", "district", 3, 6), (2, "r", "road", 4, 7)]
    h = spark.createDataFrame([(*r, 0.0, 0.5) for r in rows], "doc_id int, adcode string, level string, s int, e int, dist double, prior double")
    return rk.ancestor_chains(h, gz.closure(nodes, 4)).select("doc_id", "adcode", F.transform("evidence", lambda x: x["adcode"]).alias("chain"))


@query("""SELECT * FROM (VALUES (1, 'a', ['a', 'b']), (1, 'b', ['a', 'b']), (1, 'c', ['a', 'c']), (1, 'd', ['d'])) AS t(doc_id, adcode, chain)""")
def siblings_absorbed(spark, sf):
    rows = [("a", "P", 0, 3, 0.0, 1), ("b", "P", 4, 6, 0.1, 2), ("c", "P", 5, 8, 0.2, 3), ("d", "Q", 9, 11, 0.0, 4)]
    h = spark.createDataFrame([(1, c, p, "road", s, e, d, o) for c, p, s, e, d, o in rows], "doc_id int, adcode string, parent string, level string, s int, e int, dist double, ord int")
    return rk.absorb(h).select("doc_id", "adcode", F.transform("evidence", lambda x: x["adcode"]).alias("chain"))


LEVEL_SQL = "CASE l_linenumber % 6 WHEN 0 THEN 0.6 WHEN 1 THEN 0.8 WHEN 2 THEN 1.0 WHEN 3 THEN 1.1 ELSE 1.2 END"


@query(f"""WITH h AS (SELECT l_orderkey, {LEVEL_SQL} AS w, 1 - l_discount AS sim, l_linenumber AS s, l_linenumber + l_quantity::INT % 4 AS e FROM lineitem)
SELECT l_orderkey, round(sum(w * sim) / sum(w), 9) AS sim, round((SELECT count(DISTINCT p) FROM h g, unnest(range(g.s, g.e)) AS u(p) WHERE g.l_orderkey = h.l_orderkey) / 20, 9) AS coverage FROM h GROUP BY l_orderkey""")
def chain_scores(spark, sf):
    level = F.element_at(F.array(*map(F.lit, gz.LEVELS)), (F.col("l_linenumber") % 6 + 1).cast("int"))
    s = F.col("l_linenumber").cast("int")
    h = F.struct(level.alias("level"), (1 - F.col("l_discount")).cast("double").alias("sim"), s.alias("s"), (s + F.col("l_quantity").cast("int") % 4).alias("e"))
    g = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(h).alias("hits"))
    return g.select("l_orderkey", F.round(rk.weighted_mean(F.col("hits"), "sim"), 9).alias("sim"), F.round(rk.covered(F.col("hits"), F.lit(20)), 9).alias("coverage"))


@query("""SELECT o_custkey, o_orderstatus, o_orderkey, n, ord FROM (SELECT o_custkey, o_orderstatus, o_orderkey, o_orderkey % 5 AS n, min(o_orderkey) OVER (PARTITION BY o_custkey, o_orderstatus) AS ord, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey % 5 DESC, o_orderkey) AS r FROM orders) WHERE r = 1""")
def chain_dedupe(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderstatus", "o_orderkey", (F.col("o_orderkey") % 5).alias("n"), F.col("o_orderkey").alias("ord"))
    return rk.dedupe(o, ["o_custkey", "o_orderstatus"], "n")


RANKED_SQL = """r AS (SELECT o_custkey AS doc_id, o_orderkey AS ord, o_totalprice / 1e6 AS total, o_orderstatus AS admin, row_number() OVER w AS rank, lead(o_totalprice / 1e6) OVER w AS nxt, lead(o_orderstatus) OVER w AS nadmin FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice / 1e6 DESC, o_orderkey))"""


def _ranked(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("ord"), (F.col("o_totalprice") / 1e6).alias("total"), F.col("o_orderstatus").alias("admin"))
    return rk.ranked(o)


@query(f"WITH {RANKED_SQL} SELECT doc_id, ord, round(CASE WHEN nxt IS NULL THEN 1.0 ELSE total - nxt END, 6) AS margin, coalesce(nadmin <> admin, false) AS admin_differs FROM r WHERE rank = 1")
def top_two_margin(spark, sf):
    return _ranked(spark, sf).where("rank = 1").select("doc_id", "ord", F.round("margin", 6).alias("margin"), "admin_differs")


@query(f"""WITH {RANKED_SQL}, g AS (SELECT doc_id, min(rank) FILTER (ord % 7 = 0) AS gold_rank FROM r GROUP BY doc_id)
SELECT doc_id, gold_rank, round(coalesce(1.0 / gold_rank, 0), 6) AS mrr, coalesce(gold_rank <= 1, false) AS recall_1, coalesce(gold_rank <= 3, false) AS recall_3, gold_rank IS NOT NULL AS recall_all FROM g""")
def gold_rank(spark, sf):
    return rk.gold_rank(_ranked(spark, sf).withColumn("ok", F.col("ord") % 7 == 0)).withColumn("mrr", F.round("mrr", 6))


GATE_SQL = """f AS (SELECT l_orderkey, l_linenumber, 0.5 + l_discount * 4 AS sim, l_tax * 5 AS coverage, CASE WHEN l_linenumber = 1 THEN l_discount END AS single_dist, l_returnflag <> 'R' AS deep, l_tax AS margin, l_quantity > 10 AS has_second, l_linestatus = 'O' AS differs, l_partkey % 4 > 0 AS ok FROM lineitem)"""


def decision_sql(mm: str, sm_: str) -> str:
    return f"CASE WHEN sim < {sm_} THEN 'reject' WHEN single_dist IS NOT NULL AND single_dist > 1e-9 AND coverage < 0.25 THEN 'reject' WHEN NOT deep THEN 'partial' WHEN has_second AND margin < {mm} AND differs THEN 'ambiguous' ELSE 'confident' END"


def _gates(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber", (0.5 + F.col("l_discount") * 4).alias("sim"), (F.col("l_tax") * 5).alias("coverage"), F.when(F.col("l_linenumber") == 1, F.col("l_discount")).alias("single_dist"), (F.col("l_returnflag") != "R").alias("deep"), F.col("l_tax").alias("margin"), (F.col("l_quantity") > 10).alias("has_second"), (F.col("l_linestatus") == "O").alias("admin_differs"), (F.col("l_partkey") % 4 > 0).alias("ok"), F.create_map().cast("map<string,double>").alias("params"))


def _decided():
    return rk.decide(F.col("sim"), F.col("coverage"), F.col("single_dist"), F.col("deep"), F.col("margin"), F.col("has_second"), F.col("admin_differs"))


@query(f"WITH {GATE_SQL} SELECT l_orderkey, l_linenumber, {decision_sql('0.06', '0.62')} AS decision FROM f")
def gate_decision(spark, sf):
    return _gates(spark, sf).select("l_orderkey", "l_linenumber", _decided().alias("decision"))


QUAD_SQL = "count(*) FILTER (q = 'TP') AS tp, count(*) FILTER (q = 'FA') AS fa, count(*) FILTER (q = 'FR') AS fr, count(*) FILTER (q = 'TR') AS tr, round(count(*) FILTER (q IN ('TP', 'FA')) / count(*), 6) AS coverage, round(count(*) FILTER (q = 'FA') / nullif(count(*) FILTER (q IN ('TP', 'FA')), 0), 6) AS risk, round(count(*) FILTER (q = 'FR') / nullif(count(*) FILTER (q IN ('TP', 'FR')), 0), 6) AS over_reject"
Q_SQL = "CASE WHEN d = 'confident' THEN CASE WHEN ok THEN 'TP' ELSE 'FA' END WHEN ok THEN 'FR' ELSE 'TR' END"


def _rounded(df):
    return df.withColumns({c: F.round(c, 6) for c in ("coverage", "risk", "over_reject")})


@query(f"WITH {GATE_SQL}, g AS (SELECT l_orderkey % 3 AS k, {decision_sql('0.06', '0.62')} AS d, ok FROM f) SELECT k, {QUAD_SQL} FROM (SELECT k, {Q_SQL} AS q FROM g) GROUP BY k")
def quadrant_counts(spark, sf):
    g = _gates(spark, sf).withColumn("k", F.col("l_orderkey") % 3).withColumn("q", rk.quadrant(_decided(), F.col("ok")))
    return _rounded(ev.quadrants(g, ["k"], F.col("q")))


GRID = [(m / 50, 0.5 + s / 50) for m in range(5) for s in range(8)]
GRID_SQL = "grid AS (SELECT m / 50 AS margin_min, 0.5 + s / 50 AS sim_min FROM range(5) a(m), range(8) b(s))"
POINTS_SQL = f"{GATE_SQL}, {GRID_SQL}, g AS (SELECT margin_min, sim_min, {decision_sql('margin_min', 'sim_min')} AS d, ok FROM f, grid), points AS (SELECT margin_min, sim_min, {QUAD_SQL} FROM (SELECT margin_min, sim_min, {Q_SQL} AS q FROM g) GROUP BY ALL)"


def _points(spark, sf):
    return _rounded(ev.grid_scan(_gates(spark, sf), spark.createDataFrame(GRID, "margin_min double, sim_min double")))


@query(f"WITH {POINTS_SQL} SELECT * FROM points")
def grid_scan(spark, sf):
    return _points(spark, sf)


@query(f"WITH {POINTS_SQL}, n AS (SELECT margin_min, sim_min, risk, lead(risk) OVER (PARTITION BY sim_min ORDER BY margin_min) AS next FROM points) SELECT * FROM n WHERE next > risk + 1e-9")
def grid_rises(spark, sf):
    return ev.rises(_points(spark, sf), "margin_min", "sim_min", "risk").select("margin_min", "sim_min", "risk", "next")


@query(f"WITH {POINTS_SQL}, t(target) AS (VALUES (0.2), (0.25), (0.3)), x AS (SELECT target::DOUBLE AS target, coverage, risk, margin_min, sim_min, row_number() OVER (PARTITION BY target ORDER BY coverage DESC NULLS LAST, risk, margin_min, sim_min) AS r FROM t LEFT JOIN points ON risk <= target) SELECT target, coverage, risk, margin_min, sim_min FROM x WHERE r = 1")
def coverage_at_risk(spark, sf):
    return ev.coverage_at_risk(_points(spark, sf), spark.createDataFrame([(0.2,), (0.25,), (0.3,)], "target double"))


@query(f"WITH {POINTS_SQL}, f2 AS (SELECT sim_min AS key, margin_min AS pos, fa AS v FROM points), a AS (SELECT *, coalesce((v <> lag(v) OVER (PARTITION BY key ORDER BY pos))::INT, 0) AS chg FROM f2), b AS (SELECT *, sum(chg) OVER (PARTITION BY key ORDER BY pos) AS run FROM a), c AS (SELECT key, run, count(*) AS n, min(pos) AS lo, max(pos) AS hi, max((abs(pos - 0.06) < 1e-9)::INT) AS here FROM b GROUP BY key, run) SELECT key, lo, hi, round(n / 5, 6) AS flat_share, n / 5 < 0.2 AS pinned FROM c WHERE here = 1")
def identifiability(spark, sf):
    p = _points(spark, sf).select(F.col("sim_min").alias("key"), F.col("margin_min").alias("at"), F.col("fa").alias("v"))
    return ev.flat_share(p, "key", "at", "v", F.abs(F.col("at") - 0.06) < 1e-9).withColumn("flat_share", F.round("flat_share", 6))


@query(f"WITH {GATE_SQL}, g AS (SELECT {decision_sql('0.06', '0.62')} AS d, ok FROM f), h AS (SELECT {Q_SQL} AS q FROM g) SELECT 1 AS k, round(avg(CASE q WHEN 'FA' THEN 5.0 WHEN 'FR' THEN 1.0 WHEN 'TR' THEN 1.0 ELSE 0.0 END), 6) AS cost FROM h")
def objective_cost(spark, sf):
    g = _gates(spark, sf).select(F.lit(1).alias("k"), rk.quadrant(_decided(), F.col("ok")).alias("q"))
    return ev.objective(g, ["k"], F.col("q"), {"FA": 5.0, "FR": 1.0, "TR": 1.0}).withColumn("cost", F.round("cost", 6))


JOINED_SQL = "j AS (SELECT d.doc_id, lang, source, n_chars, quality, toxic, least(1.0, n_chars / 5000) AS score FROM documents d JOIN labels USING (doc_id))"


def _joined(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    return d.join(table(spark, sf, "labels"), "doc_id").withColumn("score", F.least(F.lit(1.0), F.col("n_chars") / 5000))


@query(f"""WITH {JOINED_SQL}, c AS (SELECT 'all' AS axis, 'all' AS value, * FROM j UNION ALL SELECT 'lang', lang, * FROM j UNION ALL SELECT 'source', source, * FROM j
UNION ALL SELECT 'tag', t, j.* FROM j, unnest(list_filter(['long', 'toxic'], lambda x: CASE x WHEN 'long' THEN n_chars > 2000 ELSE toxic = 1 END)) AS u(t))
SELECT axis, value, count(*) AS n, count(*) FILTER (quality = 1) AS good_k, count(quality) AS good_n FROM c GROUP BY axis, value""")
def slice_summary(spark, sf):
    tags = F.filter(F.array(F.when(F.col("n_chars") > 2000, "long"), F.when(F.col("toxic") == 1, "toxic")), lambda x: x.isNotNull())
    return ev.sliced(_joined(spark, sf), {"lang": F.col("lang"), "source": F.col("source"), "tag": tags}, {"good": F.col("quality") == 1})


@query(f"""WITH {JOINED_SQL}, b AS (SELECT least(floor(score * 10), 9)::INT AS bin, count(*) AS n, avg(quality) AS acc, avg(score) AS conf FROM j GROUP BY 1)
SELECT bin, n, round(acc, 6) AS acc, round(conf, 6) AS conf, round(n / (SELECT sum(n) FROM b) * abs(acc - conf), 6) AS part FROM b""")
def calibration_error(spark, sf):
    e = ev.ece(_joined(spark, sf), F.col("score"), F.col("quality") == 1)
    return e.withColumns({c: F.round(c, 6) for c in ("acc", "conf", "part")})


@query()
def isotonic_steps(spark, sf):
    return ev.isotonic(_joined(spark, sf), F.col("n_chars"), F.col("quality"), ["lang"])


@query(f"""WITH {JOINED_SQL}, s(x_start, p) AS (VALUES (300.0, 0.2), (1000.0, 0.5), (4000.0, 0.9)) SELECT doc_id, coalesce((SELECT p FROM s WHERE x_start <= n_chars ORDER BY x_start DESC LIMIT 1), 0.2)::DOUBLE AS p FROM j""")
def calibrated_step(spark, sf):
    steps = spark.createDataFrame([(1000.0, 0.5), (300.0, 0.2), (4000.0, 0.9)], "x_start double, p double")
    return ev.step_lookup(_joined(spark, sf), F.col("n_chars"), steps).select("doc_id", "p")


@query(f"""WITH {JOINED_SQL} SELECT lang, count(*) FILTER (quality = 1 AND toxic = 1) AS kept, count(*) FILTER (quality = 0 AND toxic = 1) AS mended, count(*) FILTER (quality = 1 AND toxic = 0) AS broken, count(*) FILTER (quality = 0 AND toxic = 0) AS missed,
count(*) FILTER (quality = 0 AND toxic = 1) - count(*) FILTER (quality = 1 AND toxic = 0) AS net FROM j GROUP BY lang""")
def paired_grid(spark, sf):
    return ev.paired(_joined(spark, sf), F.col("quality") == 1, F.col("toxic") == 1, ["lang"])


@query(f"""WITH {JOINED_SQL}, c AS (SELECT source, count(*) FILTER (quality = 1) AS k, count(*) AS n FROM j GROUP BY source), w AS (SELECT *, k / n AS p, 1.959964 * 1.959964 AS z2 FROM c)
SELECT source, k, n, round(greatest(0, ((p + z2 / (2 * n)) - 1.959964 * sqrt(p * (1 - p) / n + z2 / (4 * n * n))) / (1 + z2 / n)), 6) AS lo, round(least(1, ((p + z2 / (2 * n)) + 1.959964 * sqrt(p * (1 - p) / n + z2 / (4 * n * n))) / (1 + z2 / n)), 6) AS hi FROM w""")
def wilson_intervals(spark, sf):
    c = _joined(spark, sf).groupBy("source").agg(F.count_if(F.col("quality") == 1).alias("k"), F.count("*").alias("n")).withColumn("w", stats.wilson(F.col("k"), F.col("n")))
    return c.select("source", "k", "n", F.round("w.lo", 6).alias("lo"), F.round("w.hi", 6).alias("hi"))


@query("""SELECT * FROM (VALUES (0, 0, 1.0), (5, 1, 0.21875), (10, 0, 0.001953), (3, 3, 1.0), (30, 12, 0.007916)) AS t(b01, b10, p)""")
def mcnemar_test(spark, sf):
    rows = spark.createDataFrame([(0, 0), (5, 1), (10, 0), (3, 3), (30, 12)], "b01 int, b10 int")
    return rows.select("b01", "b10", F.round(stats.mcnemar(F.col("b01"), F.col("b10")), 6).alias("p"))


@query()
def bootstrap_interval(spark, sf):
    return ev.bootstrap(_joined(spark, sf), F.col("toxic") - F.col("quality"))


@query("""WITH a AS (SELECT c_mktsegment AS axis, c_nationkey::VARCHAR AS value, 'n' AS metric, count(*) AS k FROM customer WHERE c_custkey % 2 = 0 GROUP BY ALL), b AS (SELECT c_mktsegment AS axis, c_nationkey::VARCHAR AS value, 'n' AS metric, count(*) AS k FROM customer WHERE c_custkey % 2 = 1 AND c_nationkey <> 5 GROUP BY ALL)
SELECT axis, value, metric, a.k AS k_before, b.k AS k_now, CASE WHEN b.k IS NULL THEN 'missing' WHEN a.k IS NULL THEN 'new' ELSE 'fell' END AS status FROM a FULL JOIN b USING (axis, value, metric) WHERE a.k IS NULL OR b.k IS NULL OR b.k < a.k""")
def golden_diff(spark, sf):
    c = table(spark, sf, "customer")
    count = lambda x: x.groupBy(F.col("c_mktsegment").alias("axis"), F.col("c_nationkey").cast("string").alias("value"), F.lit("n").alias("metric")).agg(F.count("*").alias("k"))
    return ev.golden_diff(count(c.where("c_custkey % 2 = 0")), count(c.where("c_custkey % 2 = 1 and c_nationkey <> 5")))


@query("""SELECT coalesce(a.p_partkey, b.p_partkey) AS p_partkey, CASE WHEN b.p_partkey IS NULL THEN a.p_brand WHEN a.p_partkey IS NOT NULL AND a.p_size > 25 THEN a.p_brand ELSE 'new' || b.p_brand END AS p_brand, CASE WHEN b.p_partkey IS NULL THEN a.p_size ELSE b.p_size + 1 END AS p_size
FROM (SELECT * FROM part WHERE p_partkey % 3 <> 0) a FULL JOIN (SELECT * FROM part WHERE p_partkey % 3 <> 1) b ON a.p_partkey = b.p_partkey""")
def merge_protected(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_brand", "p_size")
    new = p.where("p_partkey % 3 <> 1").select("p_partkey", F.concat(F.lit("new"), "p_brand").alias("p_brand"), (F.col("p_size") + 1).alias("p_size"))
    return ev.merge_protected(p.where("p_partkey % 3 <> 0"), new, "p_partkey", F.col("p_size") > 25, ["p_size"])


@query("SELECT doc_id, 'left' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'right' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def file_diff(spark, sf):
    return ev.only_in_one(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id")


@query("SELECT a.o_custkey, a.m AS before, b.m AS after FROM (SELECT o_custkey, max(o_orderpriority) AS m FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1) a JOIN (SELECT o_custkey, max(o_orderpriority) AS m FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1) b USING (o_custkey) WHERE a.m IS DISTINCT FROM b.m")
def runs_compared(spark, sf):
    half = lambda k: table(spark, sf, "orders").where(f"o_orderkey % 2 = {k}").groupBy("o_custkey").agg(F.max("o_orderpriority").alias("m"))
    return ev.changed(half(0), half(1), "o_custkey", "m")


@query("SELECT 'documents' AS source, doc_id AS id, lang, NULL AS url FROM documents UNION ALL SELECT 'pages', page_id, NULL, url FROM pages UNION ALL SELECT 'benchmark', item_id, NULL, NULL FROM benchmark")
def sources_united(spark, sf):
    return qu.union_sources({"documents": table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang"), "pages": table(spark, sf, "pages").select(F.col("page_id").alias("id"), "url"), "benchmark": table(spark, sf, "benchmark").select(F.col("item_id").alias("id"))})


@query("SELECT n_nationkey, array_to_string(list_filter(string_split(n_name, ''), lambda c: NOT contains(r_name, c)), '') AS extra FROM nation JOIN region ON n_regionkey = r_regionkey")
def leaked_characters(spark, sf):
    j = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.select("n_nationkey", ev.leaked(F.col("n_name"), F.col("r_name")).alias("extra"))


@query("""WITH f AS (SELECT lang, source, CASE WHEN n_chars % 2 = 0 THEN ['even', lang] ELSE ['odd'] END AS t, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS r FROM documents) SELECT tag, count(*) AS n FROM f, unnest(t) AS u(tag) WHERE r = 1 GROUP BY tag""")
def effective_tags(spark, sf):
    d = table(spark, sf, "documents").select("lang", "source", "n_chars", F.col("doc_id").alias("ord"), F.when(F.col("n_chars") % 2 == 0, F.array(F.lit("even"), "lang")).otherwise(F.array(F.lit("odd"))).alias("t"))
    return ev.effective_counts(d, "lang", "source", F.col("n_chars") > 1000, "t")[1]


@query("SELECT count(*) AS n, count(*) FILTER (n_chars > 1000) AS drafts, count(DISTINCT lang || ':' || source) AS groups FROM documents")
def effective_total(spark, sf):
    d = table(spark, sf, "documents").withColumns({"ord": F.col("doc_id"), "t": F.array(F.lit("x"))})
    return ev.effective_counts(d, "lang", "source", F.col("n_chars") > 1000, "t")[0]


@query("SELECT p_brand, p_size, count(*) AS n, greatest(0, 20 - count(*)) AS need FROM part GROUP BY ALL")
def axis_gaps(spark, sf):
    return ev.gaps(table(spark, sf, "part"), ["p_brand", "p_size"])


@query("""SELECT k, CASE k WHEN 0 THEN 'skip' WHEN 1 THEN 'gate_over_reject' WHEN 2 THEN NULL WHEN 3 THEN 'db_missing' WHEN 4 THEN 'asr_unrecoverable' WHEN 5 THEN 'normalize_error' WHEN 6 THEN 'recall_miss' WHEN 7 THEN 'rank_error' WHEN 8 THEN 'gate_over_accept' WHEN 9 THEN 'gate_over_reject' WHEN 10 THEN 'completion_error' ELSE 'assembly_error' END AS label FROM range(12) t(k)""")
def attribution(spark, sf):
    k = F.col("id")
    t, f = F.lit(True), F.lit(False)
    flag = lambda at, hit, miss: F.when(k == at, hit).otherwise(miss)
    flags = {
        "quality": flag(0, F.lit("silent"), F.lit("ok")), "exact": k.isin(1, 2), "quadrant": flag(1, F.lit("FR"), F.lit("TP")), "decision": F.lit("confident"), "name_lost": flag(3, t, f), "name_missing": flag(3, t, f), "gold_in_db": t, "admin_all": t,
        "phon_dist": flag(4, F.lit(0.5), F.lit(0.1)), "b_ok": flag(5, f, t), "c_evaluable": t, "c_ok": t, "d_evaluable": t, "d_ok": t, "recall_all": flag(6, f, t), "top1": flag(7, f, t), "quadrant_geo": F.when(k == 8, "FA").when(k == 9, "FR").otherwise("TP"), "f_evaluable": t, "backfill": flag(10, f, t),
    }
    return spark.range(12).select(k.alias("k"), ev.attribute(flags).alias("label"))


@query("SELECT doc_id, CASE WHEN quality = 0 THEN 'admin' WHEN n_chars < 1000 THEN 'place' WHEN toxic = 1 THEN 'tail' ELSE 'right' END AS severity FROM documents JOIN labels USING (doc_id)")
def severity(spark, sf):
    return _joined(spark, sf).select("doc_id", ev.severity(F.col("quality") == 1, F.when(F.col("n_chars") < 1000, 0.5).otherwise(1.0), F.lit(True), F.col("toxic") == 0).alias("severity"))


@query("SELECT n_nationkey, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 5000) AS n FROM nation")
def rule_coverage(spark, sf):
    s = table(spark, sf, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("n_nationkey"))
    return ev.rule_coverage(table(spark, sf, "nation").select("n_nationkey"), s, "n_nationkey")


@query("""WITH t AS (SELECT l_orderkey, l_linenumber, round(0.5 * (l_discount - 0.05), 4) AS a, round(0.2 * (l_tax - 0.04), 4) AS b, round(0.15 * (l_quantity / 50 - 0.5), 4) AS c, round(0.15 * (l_linenumber / 7 - 0.5), 4) AS d, round(-0.25 * (l_tax - 0.02), 4) AS e FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN least(a, b, c, d, e) < 0 THEN CASE least(a, b, c, d, e) WHEN a THEN 'sim' WHEN b THEN 'cov' WHEN c THEN 'prior' WHEN d THEN 'depth' ELSE 'conflict' END
 ELSE CASE greatest(a, b, c, d, e) WHEN a THEN 'sim' WHEN b THEN 'cov' WHEN c THEN 'prior' WHEN d THEN 'depth' ELSE 'conflict' END END AS term FROM t""")
def dominant_term(spark, sf):
    gold = {"sim": F.col("l_discount"), "cov": F.col("l_tax"), "prior": F.col("l_quantity") / 50, "depth": F.col("l_linenumber") / 7, "conflict": F.col("l_tax")}
    top = {"sim": F.lit(0.05), "cov": F.lit(0.04), "prior": F.lit(0.5), "depth": F.lit(0.5), "conflict": F.lit(0.02)}
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", rk.dominant_term(gold, top).alias("term"))


@query("""SELECT o_orderkey, 'o_orderstatus' AS field, o_orderstatus AS value FROM orders WHERE o_orderstatus NOT IN ('F', 'O') UNION ALL SELECT o_orderkey, 'o_orderpriority', o_orderpriority FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM')""")
def domain_checks(spark, sf):
    return qu.domain_violations(table(spark, sf, "orders"), "o_orderkey", {"o_orderstatus": ("F", "O"), "o_orderpriority": ("1-URGENT", "2-HIGH", "3-MEDIUM")})


@query("""WITH m AS (SELECT o_custkey AS key, o_orderstatus AS split FROM orders) SELECT key, 'in several splits' AS problem FROM m GROUP BY key HAVING count(DISTINCT split) > 1 UNION ALL SELECT c_custkey, 'in no split' FROM customer WHERE c_custkey NOT IN (SELECT key FROM m)""")
def split_checks(spark, sf):
    m = table(spark, sf, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderstatus").alias("split"))
    return qu.split_problems(m, table(spark, sf, "customer").select(F.col("c_custkey").alias("key")))


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT vec_id, sqrt(list_sum(list_transform(v, lambda x: x * x)) / len(v)) AS rms, list_max(list_transform(v, lambda x: abs(x))) AS peak FROM e)
SELECT vec_id, round(rms, 5) AS rms, round(peak, 5) AS peak, CASE WHEN rms < 0.002 THEN 'silent' WHEN peak >= 0.999 THEN 'clipped' ELSE 'ok' END AS label FROM s""")
def signal_levels(spark, sf):
    s = table(spark, sf, "embeddings").select("vec_id", qu.signal_stats(F.col("embedding")).alias("x"))
    return s.select("vec_id", F.round("x.rms", 5).alias("rms"), F.round("x.peak", 5).alias("peak"), "x.label")


@query("SELECT page_id, sha1(sha1(html) || chr(0) || 'en' || chr(0) || url) AS key FROM pages WHERE page_id % 2 = 1")
def cache_misses(spark, sf):
    p = table(spark, sf, "pages").select("page_id", qu.cache_key(F.col("html"), F.lit("en"), F.col("url")).alias("key"))
    return qu.cached(p, p.where("page_id % 2 = 0").select("key"))[1].select("page_id", "key")


@query("""WITH f AS (SELECT l_orderkey AS id, l_linenumber::BIGINT * 10000000 + l_partkey AS chain, 0.55 + l_discount * 3 + l_linenumber * 0.00137 AS sim, l_tax * 5 AS cov, l_quantity / 50 AS prior, l_linenumber / 7 AS depth, l_tax * 2 AS conflict, l_returnflag AS admin, l_linestatus = 'O' AS deep, l_partkey % 3 > 0 AS ok FROM lineitem),
c(candidate, ws, mm) AS (VALUES (0, 0.5, 0.0613), (1, 0.8, 0.0613), (2, 0.5, 0.2017)),
t AS (SELECT *, ws * sim + 0.2 * cov + 0.15 * prior + 0.15 * depth - 0.25 * conflict AS total FROM f, c),
r AS (SELECT *, row_number() OVER w AS rank, lead(total) OVER w AS nxt, lead(admin) OVER w AS nadmin FROM t WINDOW w AS (PARTITION BY candidate, id ORDER BY total DESC, chain))
SELECT candidate, id, ok, round(total, 6) AS total, CASE WHEN sim < 0.62 THEN 'reject' WHEN NOT deep THEN 'partial' WHEN nxt IS NOT NULL AND total - nxt < mm AND nadmin <> admin THEN 'ambiguous' ELSE 'confident' END AS decision FROM r WHERE rank = 1""")
def features_replay(spark, sf):
    f = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), (F.col("l_linenumber").cast("long") * 10000000 + F.col("l_partkey")).alias("chain"), (0.55 + F.col("l_discount") * 3 + F.col("l_linenumber") * 0.00137).alias("sim"), (F.col("l_tax") * 5).alias("cov"), (F.col("l_quantity") / 50).alias("prior"), (F.col("l_linenumber") / 7).alias("depth"), (F.col("l_tax") * 2).alias("conflict"), F.col("l_returnflag").alias("admin"), (F.col("l_linestatus") == "O").alias("deep"), (F.col("l_partkey") % 3 > 0).alias("ok"), F.lit(None).cast("double").alias("single_dist"))
    points = search.as_candidates(spark, [{"MARGIN_MIN": 0.0613}, {"W_SIM": 0.8, "MARGIN_MIN": 0.0613}, {"MARGIN_MIN": 0.2017}])
    return search.replay(f, points).select("candidate", "id", "ok", F.round("total", 6).alias("total"), "decision")


@query("""SELECT * FROM (VALUES (1, '兰山路', 'initial-n-l'), (1, '蓝山路', 'initial-n-l'), (1, '南三路', 'initial-sh-s'), (2, '山', 'initial-s-sh')) AS t(id, variant, rule)""")
def perturbed_names(spark, sf):
    letters = spark.createDataFrame([("南", "nan"), ("兰", "lan"), ("蓝", "lan"), ("山", "shan"), ("三", "san"), ("路", "lu")], "ch string, raw string")
    readings = letters.select("ch", phonetics.split_syllable(F.col("raw")).alias("s")).select("ch", "s.ini", "s.fin")
    costs = phonetics.confusion_costs(phonetics.confusion_rules(spark).where("space = 'mandarin'"))
    return search.perturbations(spark.createDataFrame([(1, "南山路"), (2, "三")], "id int, name string"), readings, costs, 10).select("id", "variant", "rule")


FIXTURE = [
    ("sichuan", "四川省", "province", None, ["四川"], 0.7), ("cd", "成都市", "city", "sichuan", ["成都"], 0.9), ("wh", "武侯区", "district", "cd", ["武侯"], 0.7), ("jj", "锦江区", "district", "cd", ["锦江"], 0.7),
    ("eh", "二环路南四段", "road", "wh", [], 0.5), ("cx", "春熙路", "road", "jj", [], 0.8), ("cqp", "重庆市", "province", None, [], 0.9), ("cq", "重庆市", "city", "cqp", ["重庆"], 0.9), ("yz", "渝中区", "district", "cq", ["渝中"], 0.8), ("mq", "民权路", "road", "yz", [], 0.6),
]


@query("""SELECT * FROM (VALUES (1, 'confident', 'sichuan/cd/wh/eh', '30号'), (2, 'confident', 'cqp/cq/yz/mq', '8号'), (3, 'confident', 'sichuan/cd/jj/cx', ''), (4, 'reject', NULL, ''), (5, 'empty', NULL, '')) AS t(doc_id, decision, chain, house_no)""")
def texts_resolved(spark, sf):
    places = spark.createDataFrame([(*p[:4], p[4], p[5], k) for k, p in enumerate(FIXTURE)], "adcode string, name string, level string, parent string, aliases array<string>, prior double, ord int")
    said = [(1, "我屋头在成都市武侯区二环路南四段三十号"), (2, "重庆渝中区民权路八号"), (3, "成都锦江区村熙路"), (4, "今天天气不错"), (5, "abc")]
    letters = {c for p in FIXTURE for c in p[1] + "".join(p[4])} | {c for _, t in said for c in t if "一" <= c <= "鿿"}
    readings = phonetics.char_readings(spark, letters, {"都": "du", "重": "chong"})
    costs = phonetics.confusion_costs(phonetics.confusion_rules(spark).where("space = 'mandarin'"))
    out = resolve.resolve(spark.createDataFrame(said, "doc_id int, text string"), places, readings, costs)
    return out.select("doc_id", "decision", F.array_join("codes", "/").alias("chain"), F.col("tail.house_no").alias("house_no"))
