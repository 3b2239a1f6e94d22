"""Syllables, confusion costs and weighted edit distances."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Weights of a syllable's initial and final.
W_INITIAL, W_FINAL = 0.45, 0.55
#: Phonemes that are confused, cost, dialects; "-" is the missing initial.
_INITIALS = """
n l 0.10 西南官话,湘,赣,江淮官话
zh z 0.12 西南官话,江淮官话,闽,湘
ch c 0.12 西南官话,江淮官话,闽,湘
sh s 0.12 西南官话,江淮官话,闽,湘
h f 0.20 西南官话,湘,闽
r l 0.25 西南官话
r y - 0.30 吴,粤,闽
n r 0.35 西南官话
j z 0.30 吴,部分官话
q c 0.30 吴,部分官话
x s 0.30 吴,部分官话
b p 0.35 吴,老湘
d t 0.35 吴,老湘
g k 0.35 吴,老湘
zh j 0.40 闽,客
g j 0.20 西南官话,湘,赣,客
k q 0.20 西南官话,湘,赣,客
h x 0.20 西南官话,湘,赣,客
w - 0.30 粤,吴
m b 0.40 闽
"""
_FINALS = """
an ang 0.10 西南官话,吴,湘,赣,闽
en eng 0.10 西南官话,吴,湘,赣,闽
in ing 0.08 西南官话,吴,湘,赣,闽,江淮官话
ian iang 0.12 西南官话,湘,赣
uan uang 0.12 西南官话,湘,赣
un ong 0.25 西南官话,闽
uen ueng 0.15 西南官话
e o 0.25 西南官话,晋
o uo 0.15 西南官话,中原官话
e uo 0.25 西南官话
ui uei 0.05 通用
iu iou 0.05 通用
un uen 0.05 通用
ui ei 0.25 西南官话,闽
iu ou 0.25 西南官话,闽
iao ao 0.20 西南官话,湘,赣,客
ie ai 0.30 西南官话,湘,赣,客
ia a 0.25 西南官话,湘,赣,客
ai ei 0.30 晋,中原官话
ao ou 0.30 晋
ie ian 0.35 吴,闽
v u 0.20 西南官话,闽,粤
ve ue 0.05 通用
i er 0.40 北方官话
a ai 0.35 吴,粤
e ei 0.35 吴,粤
"""
#: The same for the Cantonese and Southern Min romanizations.
_JYUTPING_INITIALS = """
n l 0.10 粤
ng - 0.12 粤
gw g 0.20 粤
kw k 0.20 粤
z j 0.35 粤
"""
_JYUTPING_FINALS = """
ang an 0.15 粤
ong on 0.15 粤
eng en 0.15 粤
ing in 0.15 粤
ung un 0.15 粤
ak at 0.18 粤
ok ot 0.18 粤
ik it 0.18 粤
uk ut 0.18 粤
am an 0.25 粤
im in 0.25 粤
ap at 0.25 粤
eoi eoy 0.05 粤
yu jyu 0.10 粤
"""
_TAILO_INITIALS = """
t th 0.25 闽
k kh 0.25 闽
p ph 0.25 闽
n l 0.15 闽
b m 0.20 闽
g ng 0.20 闽
j l 0.25 闽
ts tsh 0.30 闽
"""
_TAILO_FINALS = """
ir i 0.15 闽
er e 0.15 闽
ue e 0.20 闽
ing in 0.15 闽
ang an 0.15 闽
ik it 0.20 闽
ak at 0.20 闽
"""
#: Initials of each romanization, the longest first.
INITIALS = {
    "mandarin": ("zh", "ch", "sh", "b", "p", "m", "f", "d", "t", "n", "l", "g", "k", "h", "j", "q", "x", "r", "z", "c", "s", "y", "w"),
    "jyutping": ("ng", "gw", "kw", "b", "p", "m", "f", "d", "t", "n", "l", "g", "k", "h", "z", "c", "s", "j", "w"),
    "tailo": ("tsh", "ts", "ng", "ph", "th", "kh", "b", "p", "m", "t", "n", "l", "k", "g", "h", "j", "s"),
}
#: The dialects whose rules a profile takes (none: all rules).
PROFILES = {"通用": None, "四川话": ("西南官话",), "吴语": ("吴",), "粤语": ("粤",), "闽语": ("闽",), "湘语": ("湘",), "江淮官话": ("江淮官话",), "中原官话": ("中原官话",)}
#: Dialect, space, space to fall back on, family.
_ROUTES = """
Sichuan|mandarin_xinan|mandarin|官话系
Guizhou|mandarin_xinan|mandarin|官话系
Yunnan|mandarin_xinan|mandarin|官话系
Hubei|mandarin_xinan|mandarin|官话系
Henan|mandarin_zhongyuan|mandarin|官话系
Shaanxi|mandarin_zhongyuan|mandarin|官话系
Gansu|mandarin_zhongyuan|mandarin|官话系
Ningxia|mandarin_zhongyuan|mandarin|官话系
Dongbei|mandarin|mandarin|官话系
Hebei|mandarin|mandarin|官话系
Tianjin|mandarin|mandarin|官话系
Shandong|mandarin|mandarin|官话系
Shanxi|mandarin_zhongyuan|mandarin|过渡区
Anhui|mandarin_jianghuai|mandarin|过渡区
Cantonese (Hong Kong accent)|jyutping|mandarin_yue|非官话·有库
Cantonese (Guangdong accent)|jyutping|mandarin_yue|非官话·有库
Minnan language|tailo|mandarin_min|非官话·有库
Fujian|tailo|mandarin_min|非官话·有库
Wu language|mandarin_wu|mandarin|非官话·无库
Zhejiang|mandarin_wu|mandarin|非官话·无库
Hunan|mandarin|mandarin|非官话·无库
Jiangxi|mandarin|mandarin|非官话·无库
"""
#: Other names of dialects.
DIALECT_NAMES = {
    "四川": "Sichuan", "四川话": "Sichuan", "成都": "Sichuan", "重庆": "Sichuan",
    "贵州": "Guizhou", "贵阳": "Guizhou",
    "云南": "Yunnan", "昆明": "Yunnan",
    "湖北": "Hubei", "武汉": "Hubei",
    "河南": "Henan", "郑州": "Henan",
    "陕西": "Shaanxi", "西安": "Shaanxi",
    "甘肃": "Gansu", "宁夏": "Ningxia", "东北": "Dongbei", "河北": "Hebei", "天津": "Tianjin", "山东": "Shandong",
    "山西": "Shanxi", "晋语": "Shanxi",
    "安徽": "Anhui",
    "粤语": "Cantonese (Guangdong accent)", "广东话": "Cantonese (Guangdong accent)", "广州话": "Cantonese (Guangdong accent)",
    "香港": "Cantonese (Hong Kong accent)",
    "闽南": "Minnan language", "闽南语": "Minnan language", "台语": "Minnan language",
    "福建": "Fujian", "福州": "Fujian",
    "吴语": "Wu language", "上海": "Wu language", "上海话": "Wu language", "苏州": "Wu language",
    "浙江": "Zhejiang", "杭州": "Zhejiang",
    "湖南": "Hunan", "长沙": "Hunan", "湘语": "Hunan",
    "江西": "Jiangxi", "赣语": "Jiangxi", "南昌": "Jiangxi",
}


def confusion_rules(spark: SparkSession) -> DataFrame:
    """space, kind, phonemes, cost, dialects."""
    rows = []
    for space, kind, told in (("mandarin", "initial", _INITIALS), ("mandarin", "final", _FINALS), ("jyutping", "initial", _JYUTPING_INITIALS), ("jyutping", "final", _JYUTPING_FINALS), ("tailo", "initial", _TAILO_INITIALS), ("tailo", "final", _TAILO_FINALS)):
        for line in told.strip().split("\n"):
            *phonemes, cost, dialects = line.split(" ")
            rows.append((space, kind, ["" if p == "-" else p for p in phonemes], float(cost), dialects.split(",")))
    return spark.createDataFrame(rows, "space string, kind string, phonemes array<string>, cost double, dialects array<string>")


def confusion_costs(rules: DataFrame, dialects: Iterable[str] | None = None) -> DataFrame:
    """kind, a, b, cost: each ordered pair of phonemes of a rule, at the least cost of any rule of the dialects."""
    if dialects is not None:
        rules = rules.where(F.arrays_overlap("dialects", F.array(*[F.lit(d) for d in {*dialects, "通用"}])))
    a = rules.select("kind", "cost", "phonemes", F.explode("phonemes").alias("a"))
    pairs = a.select("kind", "a", F.explode("phonemes").alias("b"), "cost").where("a <> b")
    return pairs.groupBy("kind", "a", "b").agg(F.min("cost").alias("cost"))


def routes(spark: SparkSession, available: Iterable[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(name, dialect) and (dialect, space, family): a space that isn't available gives way to the one to fall back on."""
    rows = [line.split("|") for line in _ROUTES.strip().split("\n")]
    have = None if available is None else set(available)
    told = [(d, s if have is None or s in have else f, y) for d, s, f, y in rows]
    return spark.createDataFrame(list(DIALECT_NAMES.items()), "name string, dialect string"), spark.createDataFrame(told, "dialect string, space string, family string")


def route(rows: DataFrame, column: str, names: DataFrame, spaces: DataFrame) -> DataFrame:
    """rows with space and family of the dialect in column; unknown ones get the general space. The two tables have a row for each dialect and are broadcast."""
    out = rows.join(F.broadcast(names.select(F.col("name").alias("_n"), F.col("dialect").alias("_d"))), F.col(column) == F.col("_n"), "left")
    out = out.withColumn("_k", F.coalesce("_d", F.col(column))).join(F.broadcast(spaces.select(F.col("dialect").alias("_e"), F.col("space"), F.col("family"))), F.col("_k") == F.col("_e"), "left")
    return out.withColumns({"space": F.coalesce("space", F.lit("mandarin")), "family": F.coalesce("family", F.lit("未知"))}).drop("_n", "_d", "_k", "_e")


def dialect_label(said: Column) -> Column:
    """A recogniser's language name as a dialect of routes(): known names as they are, broader ones by their family; null for others, Mandarin among them."""
    name, low = F.trim(said), F.lower(F.trim(said))
    known = [line.split("|")[0] for line in _ROUTES.strip().split("\n")]
    return (
        F.when(name.isin(known), name)
        .when(low.contains("cantonese") | low.isin("yue", "粤语"), "Cantonese (Guangdong accent)")
        .when(low.contains("minnan") | low.contains("hokkien"), "Minnan language")
        .when(low.startswith("wu"), "Wu language")
    )


def split_syllable(raw: Column) -> Column:
    """Struct ini, fin, raw of a toneless romanized syllable: the longest initial that leaves a final; of variant finals one spelling."""
    return syllable_in(raw, "mandarin")


def syllable_in(raw: Column, space: str) -> Column:
    """split_syllable() by the initials of a space."""
    cut = f"^({'|'.join(INITIALS[space])})?(.+)$"
    return F.struct(F.regexp_extract(raw, cut, 1).alias("ini"), F.translate(F.regexp_extract(raw, cut, 2), "üǖń", "vvn").alias("fin"), raw.alias("raw"))


def toneless(romanized: Column) -> Column:
    """Array of syllables of a romanized text without tone digits and marks: parts between white space and hyphens, letters alone."""
    plain = F.transform(F.split(F.lower(romanized), r"[\s\-]+"), lambda x: F.regexp_replace(_unmarked(x), r"[^\p{L}]", ""))
    return F.filter(plain, lambda x: x != "")


#: Letters with tone marks as romanizations write them, and their plain forms.
_MARKED = {"āáǎàâ": "a", "ēéěèê": "e", "īíǐìî": "i", "ōóǒòôő": "o", "ūúǔùûű": "u", "ǖǘǚǜ": "v", "ńňǹ": "n", "ḿ": "m"}


def _unmarked(text: Column) -> Column:
    bare = F.regexp_replace(text, r"\p{M}", "")
    return F.translate(bare, "".join(_MARKED), "".join(v * len(k) for k, v in _MARKED.items()))


def all_readings(readings: DataFrame) -> DataFrame:
    """ch, readings: every reading of a character as syllables, the first row's (by ord) first. readings: ch, raw and, for characters of several readings, ord."""
    ordered = readings if "ord" in readings.columns else readings.withColumn("ord", F.lit(0))
    each = ordered.groupBy("ch").agg(F.array_sort(F.collect_list(F.struct("ord", "raw"))).alias("r"))
    return each.select("ch", F.transform(F.array_distinct(F.transform("r", lambda x: x["raw"])), split_syllable).alias("readings"))


def char_readings(spark: SparkSession, characters: Iterable[str], known: dict[str, str] | None = None) -> DataFrame:
    """ch, raw of each character by the ICU library that Spark brings along; known overrides a reading."""
    icu = spark.sparkContext._jvm.com.ibm.icu.text.Transliterator.getInstance("Han-Latin; NFD; [:M:] Remove; Lower")
    rows = [(c, (known or {}).get(c) or icu.transliterate(c).replace("ü", "v").strip()) for c in sorted(set(characters))]
    return spark.createDataFrame(rows, "ch string, raw string")


def syllable_cost(costs: DataFrame):
    """A column function (x, y) of two syllables: their weighted confusion cost, 0 if they read alike. costs: confusion_costs, a few hundred pairs, as a map literal."""
    rows = costs.collect()
    table = F.create_map(*[F.lit(v) for r in rows for v in (f"{r.kind}:{r.a}:{r.b}", r.cost)]) if rows else F.create_map().cast("map<string,double>")
    part = lambda kind, a, b: F.when(a == b, 0.0).otherwise(F.coalesce(F.try_element_at(table, F.concat(F.lit(f"{kind}:"), a, F.lit(":"), b)), F.lit(1.0)))
    return lambda x, y: F.when(x["raw"] == y["raw"], 0.0).otherwise(W_INITIAL * part("initial", x["ini"], y["ini"]) + W_FINAL * part("final", x["fin"], y["fin"]))


def read_aloud(rows: DataFrame, readings: DataFrame, text: str, out: str) -> DataFrame:
    """rows with the syllables (ini, fin, raw) of each character of a text column. readings: ch, raw, a table bounded by a script, which goes to the executors; of several readings the first by ord; an unknown character reads as itself, null as nothing."""
    ordered = readings.orderBy("ord") if "ord" in readings.columns else readings
    told: dict[str, dict] = {}
    for r in ordered.select("ch", split_syllable(F.col("raw")).alias("s")).toLocalIterator():
        told.setdefault(r.ch, r.s.asDict())
    sent = rows.sparkSession.sparkContext.broadcast(told)
    kind = pa.list_(pa.struct([("ini", pa.string()), ("fin", pa.string()), ("raw", pa.string())]))

    def own(c: str) -> dict:
        first = next((i for i in INITIALS["mandarin"] if c.startswith(i) and len(c) > len(i)), "")
        return {"ini": first, "fin": c[len(first) :], "raw": c}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            made = [[known.get(c) or own(c) for c in x or ""] for x in batch[text].to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, kind)], names=[*batch.schema.names, out])

    return rows.mapInArrow(run, f"{', '.join(f'`{n}` {t}' for n, t in rows.dtypes)}, `{out}` array<struct<ini:string,fin:string,raw:string>>")


class Costs:
    """Weighted confusion costs of syllables as numpy tables: phonemes are numbered, unknown pairs cost 1."""

    def __init__(self, rows: list):
        self.at: dict[str, dict[str, int]] = {"initial": {}, "final": {}}
        for r in rows:
            for x in (r.a, r.b):
                self.at[r.kind].setdefault(x, len(self.at[r.kind]))
        self.table = {}
        for kind, at in self.at.items():
            table = 1 - np.eye(len(at) + 1)
            for r in rows:
                if r.kind == kind:
                    table[at[r.a], at[r.b]] = r.cost
            self.table[kind] = table

    def part(self, kind: str, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Costs of each phoneme of x against each of y."""
        at = self.at[kind]
        number = lambda a: np.array([at.get(v, len(at)) for v in a], np.int64)
        i, j = number(x)[:, None], number(y)[None, :]
        return np.where(x[:, None] == y[None, :], 0.0, np.where((i == len(at)) | (j == len(at)), 1.0, self.table[kind][i, j]))

    def swap(self, x: list[tuple], y: list[tuple]) -> np.ndarray:
        """Costs of each syllable (ini, fin, raw) of x against each of y."""
        col = lambda side, k: np.array([s[k] for s in side], object)
        cost = W_INITIAL * self.part("initial", col(x, 0), col(y, 0)) + W_FINAL * self.part("final", col(x, 1), col(y, 1))
        return np.where(col(x, 2)[:, None] == col(y, 2)[None, :], 0.0, cost)


def edit_distances(a: list[list[int]], b: list[list[int]], swap: np.ndarray, indel: float = 1.0) -> np.ndarray:
    """Weighted edit distances of pairs of sequences of symbol numbers, all pairs in step; swap[x, y]: the cost of y for x."""
    sizes_a, sizes_b = np.array([len(x) for x in a], np.int64), np.array([len(x) for x in b], np.int64)
    long_a, long_b = int(sizes_a.max(initial=0)), int(sizes_b.max(initial=0))
    pad = lambda rows, n: np.array([list(r) + [0] * (n - len(r)) for r in rows], np.int64).reshape(len(rows), n)
    left, right = pad(a, long_a), pad(b, long_b)
    row = np.tile(np.arange(long_b + 1) * indel, (len(a), 1))
    every = np.arange(len(a))
    out = row[every, sizes_b]
    for i in range(1, long_a + 1):
        new = np.empty_like(row)
        new[:, 0] = i * indel
        for j in range(1, long_b + 1):
            here = np.minimum(row[:, j], new[:, j - 1]) + indel
            new[:, j] = np.minimum(here, row[:, j - 1] + swap[left[:, i - 1], right[:, j - 1]])
        row = new
        done = sizes_a == i
        out[done] = row[every[done], sizes_b[done]]
    return out


def weighted_distance(costs: DataFrame):
    """A column function (a, b) of arrays of syllables (ini, fin, raw): edit distance with indels at 1 and substitutions at the weighted confusion cost; null for null. costs: confusion_costs, a few hundred pairs.

    An Arrow batch's distinct pairs are computed in step by numpy, so no Python loop runs over pairs' cells.
    """
    told = Costs(costs.collect())

    @F.pandas_udf("double")
    def distance(a: pd.Series, b: pd.Series) -> pd.Series:
        known: dict[tuple, int] = {}
        number = lambda side: None if side is None else tuple(known.setdefault((s["ini"], s["fin"], s["raw"]), len(known)) for s in side)
        pairs = [(number(x), number(y)) for x, y in zip(a, b)]
        wanted = {p: k for k, p in enumerate(dict.fromkeys(p for p in pairs if None not in p))}
        if not wanted:
            return pd.Series([None] * len(pairs), dtype="float64")
        symbols = list(known) or [("", "", "")]
        found = edit_distances([p[0] for p in wanted], [p[1] for p in wanted], told.swap(symbols, symbols))
        return pd.Series([found[wanted[p]] if p in wanted else None for p in pairs], dtype="float64")

    return distance


def reading_distance(a: Column, b: Column, distance) -> Column:
    """Distance of two arrays of syllables over the longer one's length: 0 of two empty ones, 1 of one."""
    longest = F.greatest(F.size(a), F.size(b))
    return F.when(longest == 0, 0.0).when(F.least(F.size(a), F.size(b)) == 0, 1.0).otherwise(distance(a, b) / longest)


def space_distance(own: tuple[Column, Column], general: tuple[Column, Column], own_distance, distance) -> Column:
    """Distance in a dialect's own space, (a, b) as its syllables; where it reads nothing of either, in the general space, and 1 where that reads nothing."""
    empty = lambda pair: F.least(F.size(pair[0]), F.size(pair[1])) == 0
    return F.when(~empty(own), reading_distance(*own, own_distance)).when(empty(general), 1.0).otherwise(reading_distance(*general, distance))


def spaces_status(spaces: DataFrame) -> DataFrame:
    """family, dialects, spaces: how many dialects go to which spaces, for a look before a run. spaces: of routes()."""
    return spaces.groupBy("family").agg(F.count("*").alias("dialects"), F.array_sort(F.collect_set("space")).alias("spaces"))
