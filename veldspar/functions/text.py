"""Text normalization as column expressions: lexicon rewriting, numerals, tail fields, reply parsing."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ALL = "通用"

#: Dialect word, standard word (- : deleted), groups, category.
_LEXICON = """
屋企 家 粤语 居所
屋歧 家 粤语 居所
阮兜 我家 闽南 居所
恁兜 你家 闽南 居所
伊兜 他家 闽南 居所
厝内 家里 闽南 居所
厝 房子 闽南 居所
屋头 家 西南官话 居所
屋里头 家里 西南官话,湘语 居所
屋里 家 湘语,吴语 居所
家儿 家 东北官话 居所
院坝 院子 西南官话 居所
院坝头 院子里 西南官话 居所
弄堂 弄 吴语 居所
屋邨 村 粤语 居所
邨 村 粤语 居所
喺度 在这里 粤语 方位
喺 在 粤语 方位
係 在 粤语 方位
呢度 这里 粤语 方位
嗰度 那里 粤语 方位
边度 哪里 粤语 方位
呢便 这边 粤语 方位
嗰便 那边 粤语 方位
佇遮 在这里 闽南 方位
佇遐 在那里 闽南 方位
佗位 哪里 闽南 方位
佇 在 闽南 方位
遮 这里 闽南 方位
遐 那里 闽南 方位
头前 前面 闽南,湘语 方位
后壁 后面 闽南 方位
彼间 那间 闽南 方位
这间 这间 通用 方位
这嘎达 这里 东北官话 方位
那嘎达 那里 东北官话 方位
旮旯 角落 东北官话,晋语,中原官话 方位
此地 这里 吴语 方位
迭个 这个 吴语 方位
搿搭 这里 吴语 方位
埃搭 那里 吴语 方位
搭界 相邻 吴语 方位
跟前 旁边 中原官话,晋语 方位
边边 旁边 西南官话 方位
边边上 旁边 西南官话 方位
对门 对面 西南官话,中原官话 方位
街沿 人行道 西南官话,吴语 方位
巷巷头 巷子里 西南官话 方位
巷巷 巷子 西南官话 方位
院子头 院子里 西南官话 方位
楼底下 楼下 西南官话,东北官话 方位
上头 上面 西南官话,湘语 方位
下头 下面 西南官话,湘语 方位
后头 后面 西南官话,湘语 方位
前头 前面 西南官话,湘语 方位
对过 对面 吴语,江淮官话 方位
大厦 大厦 粤语 建筑
商场 商场 通用 建筑
街市 菜市场 粤语 建筑
棟 栋 粤语 量词
嘅 - 粤语 助词
咗 - 粤语 助词
㗎 - 粤语 助词
喎 - 粤语 助词
嘞 - 粤语,吴语 助词
咯 - 粤语,西南官话 助词
噻 - 西南官话 助词
撒 - 西南官话 助词
嘛 - 西南官话,中原官话 助词
哈 - 西南官话,东北官话 助词
呗 - 东北官话 助词
嗯呐 - 东北官话 助词
啰 - 粤语,西南官话 助词
阿拉 我们 吴语 人称
侬 你 吴语 人称
俺 我 中原官话,晋语 人称
咱 我们 东北官话,中原官话 人称
我哋 我们 粤语 人称
你哋 你们 粤语 人称
"""
#: Variant characters and their standard forms, in the order of application.
VARIANTS = {"冇": "没", "唔": "不", "係": "是", "睇": "看", "喺": "在", "嘢": "东西", "咁": "这么", "啲": "些", "攞": "拿", "揾": "找"}
#: Digits of spoken numerals.
DIGITS = {"零": 0, "〇": 0, "○": 0, "一": 1, "幺": 1, "么": 1, "二": 2, "两": 2, "俩": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
PLACES = {"十": 10, "百": 100, "千": 1000}
#: Measure words before which numerals are converted.
UNITS = ("号", "栋", "幢", "座", "单元", "室", "楼", "层", "弄")
#: Tail fields in the order in which they claim text.
TAIL = (
    ("house_no", r"\d+号附\d+号"),
    ("house_no", r"\d+号(?!楼)"),
    ("building", r"(?:\d+|[A-Za-z])(?:栋|幢|座|号楼)"),
    ("unit", r"\d+单元"),
    ("room", r"\d+室"),
    ("floor", r"\d+(?:楼|层)"),
)
NUMERAL = "[" + "".join(DIGITS) + "十百千万]"
HAN = "[^一-鿿]"
GONE = "\x00"

Rule = tuple[str, str, tuple[str, ...], str]
LEXICON: list[Rule] = [(a, "" if b == "-" else b, tuple(g.split(",")), c) for a, b, g, c in (line.split(" ") for line in _LEXICON.split("\n") if line)]


def let(value: Column, use) -> Column:
    """use(value) with value written and evaluated once, however often use names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def rules_for(groups: Iterable[str] | None = None, rules: Iterable[Rule] = LEXICON) -> list[Rule]:
    """Rules of any of the groups or of all dialects; None: every rule."""
    wanted = None if groups is None else {*groups, ALL}
    return [r for r in rules if wanted is None or wanted & set(r[2])]


def han_only(text: Column) -> Column:
    return F.regexp_replace(text, HAN, "")


def rewrite(text: Column, rules: Iterable[Rule] = LEXICON, variants: dict[str, str] | None = None) -> Column:
    """Longest rules first, then single-character variants, then white space goes. Null stays null."""
    ordered = sorted(rules, key=lambda r: -len(r[0]))
    pairs = [(r[0], r[1]) for r in ordered] + list((VARIANTS if variants is None else variants).items())
    return F.regexp_replace(reduce(lambda out, p: F.replace(out, F.lit(p[0]), F.lit(p[1])), pairs, text), r"\s+", "")


def has_markers(text: Column, rules: Iterable[Rule] = LEXICON) -> Column:
    return reduce(lambda a, r: a | text.contains(r[0]), rules, F.lit(False))


def group_hits(text: Column, rules: Iterable[Rule] = LEXICON) -> Column:
    """Map from dialect group to the number of its rules whose word occurs, groups without any left out."""
    rules = list(rules)
    names = list(dict.fromkeys(g for r in rules for g in r[2] if g != ALL))
    counts = [reduce(lambda a, b: a + b, [F.when(text.contains(r[0]), 1).otherwise(0) for r in rules if g in r[2]]) for g in names]
    return F.map_filter(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*counts)), lambda _, n: n > 0)


def _digit(c: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in DIGITS.items() for x in kv]), c).cast("long")


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _place_step(s: Column, c: Column) -> Column:
    """One character of a positional numeral. s: ok, sum, held (digit without a place yet), gap (a zero came), last place, whether 万 came."""
    digit, place = _digit(c), F.when(c == "十", 10).when(c == "百", 100).when(c == "千", 1000).cast("long")

    def state(ok, total, held, gap, last, wan):
        return F.struct(ok.alias("ok"), total.cast("long").alias("total"), held.cast("long").alias("held"), gap.alias("gap"), last.cast("long").alias("last"), wan.alias("wan"))

    none, yes, no = F.lit(None).cast("long"), F.lit(True), F.lit(False)
    bad = state(no, s.total, s.held, s.gap, s.last, s.wan)
    ten = s.held.isNull() & (c == "十") & ~s.gap
    here = F.when(s.held.isNotNull(), s.held).when(ten, 1)
    return (
        F.when(~s.ok, s)
        .when(digit.isNotNull() & s.held.isNotNull(), bad)
        .when(digit == 0, state(yes, s.total, none, yes, s.last, s.wan))
        .when(digit.isNotNull(), state(yes, s.total, digit, s.gap, s.last, s.wan))
        .when((c == "万") & (s.wan | ((s.total == 0) & s.held.isNull())), bad)
        .when(c == "万", state(yes, (s.total + F.coalesce(s.held, F.lit(0))) * 10000, none, no, F.lit(10000), yes))
        .when(here.isNull() | ((s.last > 0) & (place >= s.last)), bad)
        .otherwise(state(yes, s.total + here * place, none, no, place, s.wan))
    )


def numeral(text: Column) -> Column:
    """Value of a spoken numeral: digit by digit, or by places where 十百千万 occur; null if it isn't a legal one.

    Places must fall; a digit right behind a place counts as the next place (八百八: 880) unless a zero came before.
    """
    first = F.struct(F.lit(True).alias("ok"), F.lit(0).cast("long").alias("total"), F.lit(None).cast("long").alias("held"), F.lit(False).alias("gap"), F.lit(0).cast("long").alias("last"), F.lit(False).alias("wan"))
    def placed(end: Column) -> Column:
        filled = end.total + F.when(end.gap | (end.last <= 10), end.held).otherwise((end.held * end.last / 10).cast("long"))
        return F.when(end.ok, F.when(end.held.isNull(), end.total).otherwise(filled))

    def value(t: Column) -> Column:
        flat = F.translate(t, "".join(DIGITS), "".join(map(str, DIGITS.values()))).try_cast("long")
        spoken = F.when(t.rlike("[十百千万]"), let(F.aggregate(_chars(t), first, _place_step), placed)).otherwise(flat)
        return F.when(t.rlike("^[0-9]+$"), t.try_cast("long")).when(t.rlike(f"^{NUMERAL}+$"), spoken)

    return let(text, value)


def _numerals(text: Column, convert) -> Column:
    """Runs of numeral characters and what is between them; convert(run, before, after) gives what stands for a run."""
    parts = F.regexp_extract_all(text, F.lit(f"{NUMERAL}+|(?:(?!{NUMERAL})[\\s\\S])+"), F.lit(0))

    def joined(parts: Column) -> Column:
        # try_element_at counts from 1, and 0 is an error
        near = lambda i: F.coalesce(F.try_element_at(parts, i), F.lit(""))
        before = lambda i: F.when(i > 0, near(F.greatest(i, F.lit(1)))).otherwise(F.lit(""))
        return F.array_join(F.transform(parts, lambda p, i: F.when(p.rlike(f"^{NUMERAL}"), convert(p, before(i), near(i + 2))).otherwise(p)), "")

    return let(parts, joined)


def normalize_numbers(text: Column) -> Column:
    """Numerals right before a measure word become digits; then bare digit-by-digit ones behind 单元 or 楼 become rooms."""
    unit = "^(" + "|".join(UNITS) + ")"
    once = _numerals(text, lambda p, _, after: F.when(after.rlike(unit), F.coalesce(numeral(p).cast("string"), p)).otherwise(p))
    bare = lambda p, before, after: before.rlike("(单元|楼)$") & ~after.rlike("^(" + "|".join([*UNITS, "附"]) + ")") & (F.length(p) >= 2) & ~p.rlike("[十百千万]")
    return _numerals(once, lambda p, before, after: F.when(bare(p, before, after), F.concat(numeral(p).cast("string"), F.lit("室"))).otherwise(p))


def extract_tail(text: Column) -> Column:
    """Struct of house_no, building, unit, room, floor, geo_text and spans (s, e, field): each field takes the first match that no earlier field has claimed; geo_text is what is left."""
    names = list(dict.fromkeys(n for n, _ in TAIL))

    def claim(state: Column, step: Column) -> Column:
        hit = F.when(F.element_at(state["found"], step["name"]) == "", F.call_function("regexp_extract", state["rest"], step["pattern"], F.lit(0))).otherwise(F.lit(""))

        def claimed(h: Column) -> Column:
            at = F.regexp_instr(state["rest"], step["pattern"])
            cut = F.concat(F.substring(state["rest"], F.lit(1), at - 1), F.repeat(F.lit(GONE), F.length(h)), F.substring(state["rest"], at + F.length(h), F.length(state["rest"])))
            found = F.transform_values(state["found"], lambda k, v: F.when(k == step["name"], h).otherwise(v))
            span = F.struct((at - 1).alias("s"), (at - 1 + F.length(h)).alias("e"), step["name"].alias("field"))
            return F.when(h == "", state).otherwise(F.struct(cut.alias("rest"), found.alias("found"), F.concat(state["spans"], F.array(span)).alias("spans")))

        return let(hit, claimed)

    steps = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(p).alias("pattern")) for n, p in TAIL])
    start = F.struct(text.alias("rest"), F.create_map(*[F.lit(x) for n in names for x in (n, "")]).alias("found"), F.array().cast("array<struct<s:int,e:int,field:string>>").alias("spans"))
    end = lambda e: F.struct(*[F.element_at(e["found"], n).alias(n) for n in names], F.replace(e["rest"], F.lit(GONE), F.lit("")).alias("geo_text"), F.array_sort(e["spans"]).alias("spans"))
    return let(F.aggregate(steps, start, claim), end)


def simplified(text: Column, pairs: dict[str, str]) -> Column:
    """Characters by a table of traditional to simplified ones."""
    return F.translate(text, "".join(pairs), "".join(pairs.values())) if pairs else text


def context_lines(names: Column, most: int = 200) -> Column:
    """Names in order without repeats, the first `most`, one to a line."""
    return F.array_join(F.slice(F.array_distinct(F.filter(names, lambda x: x.isNotNull() & (x != ""))), 1, most), "\n")


def parse_reply(raw: Column) -> Column:
    """Struct of language and text of a recogniser's reply: 'language X<asr_text>text', 'language: X text: text' or bare text."""
    tagged, spelled = r"(?s)^\s*language\s+(.*?)\s*<\|?asr_text\|?>(.*)$", r"(?is)^\s*language\s*[:：]\s*([^\n]*?)\s*\n\s*text\s*[:：]\s*(.*)$"
    pick = lambda k, bare: F.when(raw.rlike(tagged), F.regexp_extract(raw, tagged, k)).when(raw.rlike(spelled), F.regexp_extract(raw, spelled, k)).otherwise(bare)
    language = F.trim(pick(1, F.lit("")))
    return F.struct(F.when(language != "", language).alias("language"), F.trim(pick(2, raw)).alias("text"))


def substitutions(text: Column, rules: Iterable[Rule] = LEXICON, variants: dict[str, str] | None = None) -> Column:
    """The log of rewrite(): array of (src, dst, pos, category, n) in the order of application; pos is the first place in the text as rewritten so far, n how often the word stood there. Null text has none."""
    ordered = [(r[0], r[1], r[3]) for r in sorted(rules, key=lambda r: -len(r[0]))] + [(a, b, "variant") for a, b in (VARIANTS if variants is None else variants).items()]
    steps = F.array(*[F.struct(F.lit(a).alias("src"), F.lit(b).alias("dst"), F.lit(c).alias("category")) for a, b, c in ordered])

    def step(state: Column, rule: Column) -> Column:
        at = F.call_function("instr", state["rest"], rule["src"])
        n = ((F.length(state["rest"]) - F.length(F.replace(state["rest"], rule["src"], F.lit("")))) / F.length(rule["src"])).cast("int")
        entry = F.struct(rule["src"].alias("src"), rule["dst"].alias("dst"), (at - 1).alias("pos"), rule["category"].alias("category"), n.alias("n"))
        grown = F.struct(F.replace(state["rest"], rule["src"], rule["dst"]).alias("rest"), F.concat(state["log"], F.array(entry)).alias("log"))
        return F.when(at > 0, grown).otherwise(state)

    start = F.struct(text.alias("rest"), F.array().cast("array<struct<src:string,dst:string,pos:int,category:string,n:int>>").alias("log"))
    return F.aggregate(steps, start, step, lambda s: s["log"])


def substitutions_text(log: Column) -> Column:
    """A log of substitutions as one line for people."""
    return F.array_join(F.transform(log, lambda x: F.concat(x["src"], F.lit("→"), F.when(x["dst"] == "", "∅").otherwise(x["dst"]), F.lit(" ("), x["category"], F.lit(")"))), "; ")


def tail_text(tail: Column) -> Column:
    """The fields of extract_tail for people: 'field=value' for each that isn't empty, then the place part."""
    names = [*dict.fromkeys(n for n, _ in TAIL), "geo_text"]
    return F.array_join(F.filter(F.array(*[F.when(tail[n] != "", F.concat(F.lit(f"{n}="), tail[n])) for n in names]), lambda x: x.isNotNull()), " ")


#: Level suffixes that a short form of an administrative name drops, the first that fits.
LEVEL_SUFFIXES = ("特别行政区", "地区", "林区", "新区", "省", "市", "区", "县", "盟", "旗")
#: Suffixes that a short form of a road's or a landmark's name drops, the first that fits.
PLACE_SUFFIXES = ("街道", "步行街", "古镇", "国际机场", "广场", "大道", "路", "街")


def _shortened(name: Column, suffixes: tuple[str, ...], least: int) -> Column:
    """name without the first suffix in order that fits and leaves least characters; null if none does."""
    return reduce(lambda out, x: out.when(name.endswith(x) & (F.length(name) - len(x) >= least), F.substring(name, F.lit(1), F.length(name) - len(x))), suffixes, F.when(F.lit(False), F.lit("")))


def aliases(name: Column) -> Column:
    """Short forms of an administrative name, sorted: what stands before an ethnic name and 自治区, 自治州, 自治县 or 自治旗, and the name without its level suffix; two characters at least."""
    stem = F.regexp_extract(name, r"^(.{2,}?)(?:[一-鿿]{1,4}族)?(?:自治区|自治州|自治县|自治旗)$", 1)
    forms = F.array(F.when(stem != "", stem), _shortened(name, LEVEL_SUFFIXES, 2))
    return F.array_sort(F.array_distinct(F.filter(forms, lambda x: x.isNotNull() & (F.length(x) >= 2) & (x != name))))


def road_aliases(name: Column, told: Column) -> Column:
    """The told short forms of a road or landmark and its name without a suffix where three characters are left, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.concat(told, F.array(_shortened(name, PLACE_SUFFIXES, 3))), lambda x: x.isNotNull())))
