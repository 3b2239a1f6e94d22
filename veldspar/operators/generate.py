"""Synthetic misheard texts: where a text's names may be changed, what may stand there instead, and a fixed, spread choice of variants.

Choices follow the order of a seeded hash, so that they are the same on any cluster.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Characters of numerals and of tail fields, which aren't changed.
NUMBERS = "一二三四五六七八九十百千万亿零两幺〇○"
TAILS = "号栋幢座单元室楼层附"
#: Suffixes of place types, the longest first, and the fields that names come from, in order.
TYPES = ("街道", "小区", "花园", "广场", "大道", "区", "市", "省", "路", "街", "道", "巷", "段", "镇", "村")
NAME_FIELDS = ("district", "street", "road", "community", "city", "province")
#: Shares of an item's variants, candidates to a place and rule, and characters that count as common.
SHARE_HOMOPHONE, SHARE_COMPOUND, PER_RULE, COMMON = 0.35, 0.10, 6, 3500
HOMOPHONE, COMPOUND = "homophone", "compound"


def trailing_type(name: Column) -> Column:
    """The place type that a longer name ends in; '' for none."""
    return reduce(lambda out, t: out.when(name.endswith(t) & (F.length(name) > len(t)), F.lit(t)), TYPES, F.when(F.lit(False), F.lit(""))).otherwise("")


def surface_forms(name: Column) -> Column:
    """How a name may be said: in full, and without its type; none of an empty one."""
    bare = F.when(trailing_type(name) != "", F.substring(name, F.lit(1), F.length(name) - F.length(trailing_type(name))))
    return F.when(F.coalesce(name, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.filter(F.array(name, bare), lambda x: x.isNotNull()))


def char_counts(phrases: DataFrame, column: str) -> DataFrame:
    """ch, n: how often each Han character occurs in the phrases, an offline measure of how common it is."""
    return phrases.select(F.explode(F.regexp_extract_all(column, F.lit("[一-龥]"), F.lit(0))).alias("ch")).groupBy("ch").agg(F.count("*").alias("n"))


def char_pool(*sources: DataFrame) -> DataFrame:
    """ch: the characters of any of the sources (ch), each once."""
    return reduce(DataFrame.unionByName, [s.select("ch") for s in sources]).distinct()


def common_chars(counts: DataFrame, most: int = COMMON) -> DataFrame:
    """The most frequent characters of counts (ch, n)."""
    return counts.orderBy(F.desc("n"), "ch").limit(most)


def char_lists(readings: DataFrame, counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(raw, chars) and (ini, fin, chars): characters by reading and by parts of it, the common ones first."""
    told = readings.join(counts, "ch", "left").withColumn("_o", F.struct(-F.coalesce("n", F.lit(0)), "ch"))
    lists = lambda *keys: told.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list("_o")), lambda x: x["ch"]).alias("chars"))
    return lists("raw"), lists("ini", "fin")


def name_spans(items: DataFrame) -> DataFrame:
    """id, s, e, surface: where each gold name stands in the text; the full form where it occurs at all, else the one without its type. items: id, spoken, fields."""
    field = F.array(*[F.struct(F.lit(k).alias("o"), F.coalesce(F.col(f"fields.{f}"), F.lit("")).alias("v")) for k, f in enumerate(NAME_FIELDS)])
    each = items.select("id", "spoken", F.explode(field).alias("f"))
    form = F.try_element_at(F.filter(surface_forms(F.col("f.v")), lambda x: F.contains("spoken", x)), F.lit(1))
    said = each.select("id", "spoken", form.alias("surface")).where("surface is not null")
    starts = F.filter(F.sequence(F.lit(1), F.length("spoken")), lambda k: F.substring("spoken", k, F.length("surface")) == F.col("surface"))
    return said.select("id", "surface", F.explode(starts).alias("_s")).select("id", (F.col("_s") - 1).alias("s"), (F.col("_s") - 1 + F.length("surface")).alias("e"), "surface").distinct()


def positions(items: DataFrame, readings: DataFrame, context: DataFrame | None = None) -> DataFrame:
    """id, pos, was, ini, fin, raw: characters of names that may change: no numeral, no tail word, not the type at the end, and read in the text (context: id, pos, raw) as alone. readings: ch, ini, fin, raw."""
    span = name_spans(items).withColumn("e", F.col("e") - F.length(trailing_type(F.col("surface")))).where("e > s")
    place = span.select("id", F.explode(F.sequence(F.col("s"), F.col("e") - 1)).alias("pos")).distinct()
    at = place.join(items.select("id", "spoken"), "id").select("id", "pos", F.substring("spoken", F.col("pos") + 1, F.lit(1)).alias("was"))
    kept = at.where(F.col("was").rlike("[一-龥]") & ~F.col("was").isin(*NUMBERS, *TAILS)).join(readings.select(F.col("ch").alias("was"), "ini", "fin", "raw"), "was")
    return kept if context is None else kept.join(context.select("id", "pos", "raw"), ["id", "pos", "raw"], "left_semi")


def replacements(places: DataFrame, readings: DataFrame, rules: DataFrame, counts: DataFrame, per_rule: int = PER_RULE) -> DataFrame:
    """places with rule and became: characters that read the same, or as a rule (kind, name, a, b) would have it; the per_rule most common for each place and rule."""
    new = readings.select(F.col("ch").alias("became"), F.col("ini").alias("_i"), F.col("fin").alias("_f"), F.col("raw").alias("_r"))
    same = places.join(new, (F.col("raw") == F.col("_r")) & (F.col("was") != F.col("became"))).withColumn("rule", F.lit(HOMOPHONE))
    kind = lambda k: rules.where(F.col("kind") == k).select(F.col("name").alias("rule"), "a", "b")
    first = places.join(kind("initial"), F.col("ini") == F.col("a")).join(new, (F.col("b") == F.col("_i")) & (F.col("fin") == F.col("_f")))
    last = places.join(kind("final"), F.col("fin") == F.col("a")).join(new, (F.col("b") == F.col("_f")) & (F.col("ini") == F.col("_i")))
    every = reduce(DataFrame.unionByName, [x.select("id", "pos", "was", "became", "rule", F.col("raw").alias("raw_was"), F.col("_r").alias("raw_became")) for x in (same, first, last)]).where("was <> became").dropDuplicates(["id", "pos", "rule", "became"])
    w = W.partitionBy("id", "pos", "rule").orderBy(F.desc(F.coalesce("n", F.lit(0))), "became")
    return every.join(counts.select(F.col("ch").alias("became"), "n"), "became", "left").withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= per_rule).drop("_k", "n")


def _applied(spoken: Column, subs: Column) -> Column:
    """spoken with the substitutions (pos, became), which are of different places."""
    return F.aggregate(subs, spoken, lambda t, x: F.concat(F.substring(t, F.lit(1), x["pos"]), x["became"], F.substring(t, x["pos"] + 2, F.length(t))))


def generate(items: DataFrame, readings: DataFrame, rules: DataFrame, counts: DataFrame, per_item: int = 30, seed: int = 20260910, context: DataFrame | None = None) -> DataFrame:
    """id, source_id, rule, spoken, applied, n_subs: per_item variants of each item, none twice and none that is an item's own text.

    A share are homophones, a share compounds of two rules at two places; the rest goes round the other rules in turn, and
    homophones fill what is left. An item's candidates are few (names x rules x PER_RULE); choices are windows over them.
    """
    sub = F.struct("pos", F.col("was").alias("from"), F.col("became").alias("to"), "became", F.col("raw_was").alias("pinyin_from"), F.col("raw_became").alias("pinyin_to"))
    cand = replacements(positions(items, readings, context), readings, rules, counts).withColumn("_h", F.xxhash64(F.lit(seed), "id", "pos", "rule", "became"))
    nth = cand.withColumn("_n", F.row_number().over(W.partitionBy("id", "rule").orderBy("_h", "pos", "became")))
    homophones, compounds = round(per_item * SHARE_HOMOPHONE), round(per_item * SHARE_COMPOUND)
    single = nth.select("id", "rule", F.array(sub).alias("subs"), F.when((F.col("rule") == HOMOPHONE) & (F.col("_n") <= homophones), 0).when(F.col("rule") == HOMOPHONE, 3).otherwise(2).alias("_turn"), F.col("_n").alias("_o"), F.xxhash64(F.lit(seed), "id", "rule").alias("_p"))
    # compounds: each rule's first candidates meet the next rules', in the order of a hash
    few = nth.where(F.col("_n") <= compounds).select("id", "rule", "pos", sub.alias("sub"), "_h")
    other = few.select(F.col("id").alias("_id"), F.col("rule").alias("_rule"), F.col("pos").alias("_pos"), F.col("sub").alias("_sub"), F.col("_h").alias("_h2"))
    pairs = few.join(other, (F.col("id") == F.col("_id")) & (F.col("rule") < F.col("_rule")) & (F.col("pos") != F.col("_pos")))
    both = pairs.select("id", F.lit(COMPOUND).alias("rule"), F.array_sort(F.array("sub", "_sub")).alias("subs"), F.lit(1).alias("_turn"), F.row_number().over(W.partitionBy("id").orderBy(F.xxhash64("_h", "_h2"), "_h", "_h2")).alias("_o"), F.lit(0).cast("long").alias("_p")).where(F.col("_o") <= compounds)
    made = single.unionByName(both).join(items.select("id", "spoken"), "id").withColumn("variant", _applied(F.col("spoken"), F.col("subs")))
    fresh = made.join(items.select(F.col("spoken").alias("variant")).distinct(), "variant", "left_anti")
    once = fresh.withColumn("_k", F.row_number().over(W.partitionBy("variant").orderBy("id", "_turn", "_o", "_p"))).where("_k = 1")
    chosen = once.withColumn("_k", F.row_number().over(W.partitionBy("id").orderBy("_turn", "_o", "_p", "variant"))).where(F.col("_k") <= per_item)
    applied = F.transform("subs", lambda x: F.struct(x["pos"].alias("pos"), x["from"].alias("from"), x["to"].alias("to"), x["pinyin_from"].alias("pinyin_from"), x["pinyin_to"].alias("pinyin_to")))
    return chosen.select(F.concat_ws("-", F.col("id").cast("string"), F.lpad(F.col("_k").cast("string"), 3, "0")).alias("id"), F.col("id").alias("source_id"), "rule", F.col("variant").alias("spoken"), applied.alias("applied"), F.size("subs").alias("n_subs"))


def problems(variants: DataFrame, items: DataFrame, readings: DataFrame, rules: DataFrame) -> DataFrame:
    """id, problem of variants that don't follow from their item: a text that the substitutions don't give, a change outside the names, or one that its rule doesn't allow."""
    joined = variants.join(items.select(F.col("id").alias("source_id"), F.col("spoken").alias("_own")), "source_id")
    subs = F.transform("applied", lambda x: F.struct(x["pos"].alias("pos"), x["to"].alias("became")))
    wrong = joined.where(_applied(F.col("_own"), subs) != F.col("spoken")).select("id", F.lit("not replayable").alias("problem"))
    each = variants.select("id", "source_id", "rule", F.explode("applied").alias("x"))
    place = positions(items, readings).select(F.col("id").alias("source_id"), "pos")
    outside = each.withColumn("pos", F.col("x.pos")).join(place, ["source_id", "pos"], "left_anti").select("id", F.lit("outside the names").alias("problem"))
    r = lambda side, p: readings.select(F.col("ch").alias(f"_{p}"), F.col("ini").alias(f"_{p}i"), F.col("fin").alias(f"_{p}f"), F.col("raw").alias(f"_{p}r"))
    read = each.join(r("from", "a"), F.col("x.from") == F.col("_a")).join(r("to", "b"), F.col("x.to") == F.col("_b"))
    allowed = rules.select("name", "kind", F.col("a").alias("_x"), F.col("b").alias("_y"))
    by_rule = read.join(allowed, ((F.col("rule") == F.col("name")) | (F.col("rule") == COMPOUND)) & F.when(F.col("kind") == "initial", (F.col("_ai") == F.col("_x")) & (F.col("_bi") == F.col("_y")) & (F.col("_af") == F.col("_bf"))).otherwise((F.col("_af") == F.col("_x")) & (F.col("_bf") == F.col("_y")) & (F.col("_ai") == F.col("_bi"))), "left_anti")
    against = by_rule.where(~(F.col("rule").isin(HOMOPHONE, COMPOUND) & (F.col("_ar") == F.col("_br")))).select("id", F.lit("against its rule").alias("problem"))
    return wrong.unionAll(outside).unionAll(against).distinct()


def named_rules(rules: DataFrame) -> DataFrame:
    """kind, name, a, b: each ordered pair of phonemes of confusion rules (kind, phonemes), under a name made of them."""
    a = rules.select("kind", F.concat_ws(":", "kind", F.array_join("phonemes", "-")).alias("name"), F.explode("phonemes").alias("a"), "phonemes")
    return a.select("kind", "name", "a", F.explode("phonemes").alias("b")).where("a <> b").distinct()


def enriched(items: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """items with the columns that they lack or have as null from defaults."""
    return items.withColumns({k: F.coalesce(F.col(k), v) if k in items.columns else v for k, v in defaults.items()})
