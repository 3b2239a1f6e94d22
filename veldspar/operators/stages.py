"""Stage metrics A to F of one outcome against its gold, as column expressions and joins.

An outcome's row has what the plan made of a text (address, fields, segments, hits, ranked chains) and its gold (fields,
transcript, address). Flags are null where a stage can't judge a row, so rates count the rows that it could.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx
from . import gazetteer as gz
from .evaluation import cer
from .ranking import PARAMS, TERMS, quadrant
from .similarity import effective_limit

ADMIN = ("province", "city", "district")
GEO = ("street", "road", "community")
TAIL = ("house_no", "building", "unit", "room")
LOW = ("street", "road", "poi")


def same_area(name: Column) -> Column:
    """An administrative name as it is compared: 市辖区 counts as 市, null as empty."""
    return F.replace(F.coalesce(name, F.lit("")), F.lit("市辖区"), F.lit("市"))


def _said(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def every(items: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, items, F.lit(True))


# ---- gold chains


def gold_chain(items: DataFrame, places: DataFrame, hops: int = 8) -> DataFrame:
    """items (id and the gold fields by level) with the gold places: <level>_code of the administrative levels, road_codes, deepest_code, deepest_field, deepest_name, missing, in_db, evaluable, short_name.

    A level is looked up by name or alias, below the level above where a place of that name is there, else anywhere; a
    municipality may be its own city; a district counts as below any of its ancestors. Roads and communities have no
    such way out: one outside the areas found is missing. places: adcode, name, level, parent, aliases, ord.
    """
    up = gz.closure(places.select("adcode", "parent"), hops)
    above = up.where("hop > 0").groupBy("adcode").agg(F.collect_set("ancestor").alias("above"))
    pool = gz.names(places).join(places.select("adcode", "level", "parent", "ord", F.col("name").alias("official")), "adcode").join(above, "adcode", "left")
    pool = pool.select("adcode", "level", "parent", "ord", "official", "name", F.coalesce("above", F.array().cast("array<string>")).alias("above")).dropDuplicates(["adcode", "name"])

    def named(levels: tuple[str, ...]) -> DataFrame:
        """Per name its places in order of ord."""
        each = F.struct("ord", "adcode", "parent", "official", "above")
        return pool.where(F.col("level").isin(*levels)).groupBy(F.col("name").alias("_n")).agg(F.array_sort(F.collect_list(each)).alias("_c"))

    def first(candidates: Column, fits) -> Column:
        return F.try_element_at(F.filter(candidates, fits), F.lit(1))

    def looked_up(rows: DataFrame, field: str, levels: tuple[str, ...]) -> DataFrame:
        return rows.join(F.broadcast(named(levels)), (F.col(field) == F.col("_n")) & (F.col(field) != ""), "left").drop("_n")

    out = looked_up(items, "province", ("province",)).withColumn("province_code", F.try_element_at("_c", F.lit(1))["adcode"]).drop("_c")
    out = looked_up(out, "city", ("city",))
    own = first(F.col("_c"), lambda c: c["parent"] == F.col("province_code"))
    itself = F.when(F.col("_c").isNull() & (F.col("city") == F.col("province")), F.col("province_code"))
    out = out.withColumn("city_code", F.coalesce(own["adcode"], F.try_element_at("_c", F.lit(1))["adcode"], itself)).drop("_c")
    out = looked_up(out, "district", ("district",)).withColumn("_at", F.coalesce("city_code", "province_code"))
    own = first(F.col("_c"), lambda c: (c["parent"] == F.col("_at")) | F.array_contains(c["above"], F.col("_at")))
    out = out.withColumn("district_code", F.coalesce(own["adcode"], F.try_element_at("_c", F.lit(1))["adcode"])).drop("_c", "_at")
    areas = F.filter(F.array(*[f"{a}_code" for a in ADMIN]), lambda x: x.isNotNull())
    out = out.withColumn("_areas", areas)
    order = ("community", "road", "street")
    for level in order:
        out = looked_up(out, level, LOW)
        fits = first(F.col("_c"), lambda c: (F.size("_areas") == 0) | F.arrays_overlap(c["above"], F.col("_areas")))
        out = out.withColumn(f"_{level}", F.struct(fits["adcode"].alias("code"), fits["official"].alias("official"))).drop("_c")
    given = lambda x: _said(F.col(x)) != ""
    gone = F.filter(F.array(*[F.when(given(x) & F.col(f"_{x}.code").isNull(), F.col(x)) for x in order]), lambda x: x.isNotNull())
    deepest = F.coalesce(*[F.when(F.col(f"_{x}.code").isNotNull(), F.struct(F.col(f"_{x}.code").alias("code"), F.lit(x).alias("field"), F.col(f"_{x}.official").alias("official"))) for x in order])
    last = F.coalesce(*[F.when(given(x), F.col(x)) for x in order], F.lit(""))
    out = out.withColumns({"missing": gone, "_deep": deepest, "deepest_name": last, "road_codes": F.array_distinct(F.filter(F.array(*[f"_{x}.code" for x in order]), lambda x: x.isNotNull()))})
    measured = F.length(tx.han_only(F.coalesce("_deep.official", "deepest_name")))
    out = out.withColumns(
        {
            "deepest_code": F.col("_deep.code"), "deepest_field": F.col("_deep.field"), "evaluable": F.col("_deep").isNotNull(),
            "in_db": F.when(F.col("deepest_name") == "", F.col("district_code").isNotNull()).otherwise(~F.array_contains("missing", F.col("deepest_name"))),
            "short_name": (F.coalesce("_deep.official", "deepest_name") != "") & (measured <= 2),
        }
    )
    return out.drop("_areas", "_deep", *[f"_{x}" for x in order])


def chain_matches(codes: Column, entries: Column, deepest: Column, gold: dict[str, Column]) -> Column:
    """Whether a chain is the gold one: it has the deepest gold place, and no administrative entry (level, code) that differs from gold's. False without a deepest place."""
    against = F.create_map(*[x for level in ADMIN for x in (F.lit(level), gold[level])])
    clash = F.exists(entries, lambda e: e["level"].isin(*ADMIN) & F.try_element_at(against, e["level"]).isNotNull() & (F.try_element_at(against, e["level"]) != e["code"]))
    return F.coalesce(deepest.isNotNull() & F.array_contains(codes, deepest) & ~clash, F.lit(False))


def chain_ok(codes: Column, entries: Column, gold: dict[str, Column], deepest: Column, road_codes: Column, names: Column, has_address: Column) -> Column:
    """Whether a chain is right where gold's road may be missing: then its areas must be gold's and its roads gold's or parts of what was said. entries: level, code, name."""
    against = F.create_map(*[x for level in ADMIN for x in (F.lit(level), gold[level])])
    told = lambda e: F.try_element_at(against, e["level"])
    areas = F.exists(entries, lambda e: e["level"].isin(*ADMIN) & told(e).isNotNull())
    clash = F.exists(entries, lambda e: e["level"].isin(*ADMIN) & told(e).isNotNull() & (told(e) != e["code"]))
    known = lambda e: F.array_contains(road_codes, e["code"]) | F.exists(names, lambda g: (g != "") & (F.contains(g, e["name"]) | F.contains(e["name"], g)))
    roads = F.forall(entries, lambda e: e["level"].isin(*ADMIN) | known(e))
    return F.when(~F.coalesce(has_address, F.lit(True)), F.lit(False)).when(deepest.isNotNull(), chain_matches(codes, entries, deepest, gold)).otherwise(areas & ~clash & roads)


# ---- stage A


def token_rate(hyp: Column, ref: Column) -> Column:
    """Error rate of arrays of tokens: edits over the reference's length; of an empty reference 0 or 1."""
    row = F.sequence(F.lit(0), F.size(hyp))

    def step(state: Column, x: Column) -> Column:
        """state: the row of the distances so far; one reference token more."""
        cells = F.zip_with(hyp, F.sequence(F.lit(1), F.greatest(F.size(hyp), F.lit(1))), lambda h, j: F.struct(h.alias("h"), j.alias("j")))
        grown = lambda out, c: F.concat(out, F.array(F.least(F.element_at(state, c["j"] + 1) + 1, F.element_at(out, -1) + 1, F.element_at(state, c["j"]) + F.when(c["h"] == x, 0).otherwise(1))))
        return F.aggregate(F.filter(cells, lambda c: c["h"].isNotNull()), F.array(F.element_at(state, 1) + 1), grown)

    edits = F.element_at(F.aggregate(ref, row, step), -1)
    return F.when(F.size(ref) == 0, F.when(F.size(hyp) == 0, 0.0).otherwise(1.0)).otherwise(edits / F.size(ref))


def closest_part(hyp: Column, name: Column) -> Column:
    """Struct cer, part: the stretch of hyp of name's length, one less or one more, nearest to it by characters; the shortest and leftmost of equals. 1 and '' of a hyp that has none."""
    n = F.length(name)
    widths = F.filter(F.array(n - 1, n, n + 1), lambda w: (w >= 1) & (w <= F.length(hyp)))
    cuts = F.flatten(F.transform(widths, lambda w: F.transform(F.sequence(F.lit(0), F.length(hyp) - w), lambda s: F.struct(w.alias("w"), s.alias("s")))))
    scored = F.transform(cuts, lambda c: F.struct(cer(F.substring(hyp, c["s"] + 1, c["w"]), name).alias("cer"), c["w"].alias("w"), c["s"].alias("s"), F.substring(hyp, c["s"] + 1, c["w"]).alias("part")))
    best = F.array_min(scored)
    return F.struct(F.coalesce(best["cer"], F.lit(1.0)).alias("cer"), F.coalesce(best["part"], F.lit("")).alias("part"))


def name_variants(items: DataFrame, places: DataFrame, fields: tuple[str, ...] = GEO) -> DataFrame:
    """id, field, variants: for each gold name its spellings: all names of the gold place that bears it, else itself. items: id, road_codes and the fields."""
    each = items.select("id", "road_codes", F.explode(F.array(*[F.struct(F.lit(x).alias("field"), F.col(x).alias("name")) for x in fields])).alias("g")).select("id", "road_codes", "g.*").where("name <> ''")
    full = places.select("adcode", "ord", F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))).alias("all"))
    hits = each.withColumn("adcode", F.explode("road_codes")).join(full, "adcode").where(F.array_contains("all", F.col("name"))).groupBy("id", "field").agg(F.min_by("all", "ord").alias("all"))
    return each.join(hits, ["id", "field"], "left").select("id", "field", F.coalesce("all", F.array("name")).alias("variants"))


def stage_a(names: DataFrame) -> DataFrame:
    """id with the name metrics, weighted by the names' lengths: cer_name_char, cer_name_phon, cer_name_phon_w, name_phon_dist_max and the shares of the character errors that sound can mend (null without errors).

    names: id, name, cer_char, cer_phon, dist_phon_w: of each gold name its likest spelling.
    """
    w = F.length("name")
    mean = lambda c: F.sum(F.col(c) * w) / F.sum(w)
    out = names.groupBy("id").agg(mean("cer_char").alias("cer_name_char"), mean("cer_phon").alias("cer_name_phon"), mean("dist_phon_w").alias("cer_name_phon_w"), F.max("dist_phon_w").alias("name_phon_dist_max"))
    share = lambda c: F.when(F.col("cer_name_char") > 0, (F.col("cer_name_char") - F.col(c)) / F.col("cer_name_char"))
    return out.withColumns({"recoverable_share": share("cer_name_phon"), "recoverable_share_w": share("cer_name_phon_w")})


def likest(variants: DataFrame) -> DataFrame:
    """Of each (id, field) the spelling nearest by weighted sound, then by characters. variants: id, field, name, cer_char, cer_phon, dist_phon_w."""
    return variants.groupBy("id", "field").agg(F.min_by(F.struct("name", "cer_char", "cer_phon", "dist_phon_w"), F.struct("dist_phon_w", "cer_char", "name")).alias("b")).select("id", "field", "b.*")


# ---- stage B


def illegal_numbers(raw: Column) -> Column:
    """Numerals before a measure word that stand for no number, with that word, in order."""
    found = F.regexp_extract_all(raw, F.lit(f"({tx.NUMERAL}+)({'|'.join(tx.UNITS)})"), F.lit(0))
    return F.filter(found, lambda x: tx.numeral(F.regexp_extract(x, f"^{tx.NUMERAL}+", 0)).isNull())


def stage_b(raw: Column, n_substitutions: Column, address: Column, unverified: Column, fields: dict[str, Column], gold: dict[str, Column], transcript: Column, truth: Column, rules=tx.LEXICON) -> Column:
    """Struct of lexicon_hit, lexicon_leaked, number_ok, tail_fields (those that are right), tail_exact, illegal_number_caught, illegal, filler_leak, leaked and ok."""
    words = sorted({r[0] for r in rules if len(r[0]) >= 2}, key=lambda w: (-len(w), w))
    out = F.concat(_said(address), _said(unverified))
    leaks = F.filter(F.array(*[F.when(raw.contains(w) & out.contains(w), F.lit(w)) for w in words]), lambda x: x.isNotNull())
    present = reduce(lambda a, w: a | raw.contains(w), words, F.lit(False))
    digits = lambda c: F.regexp_extract_all(_said(c), F.lit(r"\d+"), F.lit(0))
    right = F.filter(F.array(*[F.when(_said(fields[k]) == _said(gold[k]), F.lit(k)) for k in TAIL]), lambda x: x.isNotNull())
    bad = illegal_numbers(raw)
    han = tx.han_only(out)
    stray = lambda c: F.contains(_said(transcript), c) & ~F.contains(_said(truth), c)
    leaked = F.array_join(F.filter(F.split(han, ""), lambda c: (c != "") & stray(c)), "")
    leak = F.length(leaked) / F.greatest(F.length(han), F.lit(1))
    caught = F.forall(bad, lambda x: F.contains(out, x))
    hit = F.when(present, (F.size(leaks) == 0) & (n_substitutions > 0)).otherwise(True)
    number, exact = digits(address) == digits(truth), F.size(right) == len(TAIL)
    return F.struct(
        present.alias("lexicon_present"), hit.alias("lexicon_hit"), leaks.alias("lexicon_leaked"), number.alias("number_ok"), right.alias("tail_fields"), exact.alias("tail_exact"),
        caught.alias("illegal_number_caught"), bad.alias("illegal"), leak.alias("filler_leak"), leaked.alias("leaked"), (hit & number & exact & caught & (leak == 0)).alias("ok"),
    )


# ---- stages C and D


def stage_c(rows: DataFrame, ranking: DataFrame) -> DataFrame:
    """rows (id, evaluable, deepest_code, hits) with recall_hit, recall_1, recall_3, recall_all and gold_rank; null where gold isn't evaluable. ranking: id, rank, ok: all ranked chains, so nothing need be ranked again."""
    first = ranking.where("ok").groupBy("id").agg(F.min("rank").alias("_r"))
    out = rows.join(first, "id", "left")
    judged = lambda c: F.when(F.col("evaluable"), c)
    return out.withColumns(
        {
            "recall_hit": judged(F.exists(F.coalesce("hits", F.expr("cast(array() as array<struct<adcode:string>>)")), lambda h: h["adcode"] == F.col("deepest_code")) if "hits" in rows.columns else F.lit(None).cast("boolean")),
            **{f"recall_{k}": judged(F.coalesce(F.col("_r") <= k, F.lit(False))) for k in (1, 3)},
            "recall_all": judged(F.col("_r").isNotNull()), "gold_rank": judged(F.col("_r")),
        }
    ).drop("_r")


def miss_reason(hit_weak: Column, dist: Column, syllables: Column, limit: float = PARAMS["MAX_DIST"]) -> Column:
    """Why a gold place isn't in any chain: its hit made none, its nearest window is too far, too far for so short a name, or something else struck it out. hit_weak: null without a hit; dist: of the nearest window, null without one."""
    return (
        F.when(hit_weak.isNotNull(), "weak_filtered")
        .when(dist.isNull(), "window_miss")
        .when(dist > limit, "dist_over_max")
        .when(dist > effective_limit(syllables, limit), "weak_filtered")
        .otherwise("window_miss")
    )


def miss_detail(reason: Column, part: Column, name: Column, dist: Column) -> Column:
    return F.concat(reason, F.lit(": "), F.coalesce(part, F.lit("-")), F.lit(" / "), F.coalesce(name, F.lit("-")), F.lit(" "), F.coalesce(F.format_number(dist, 3), F.lit("-")))


def term_deltas(gold: dict[str, Column], top: dict[str, Column]) -> Column:
    """Map from score term to what the gold chain gains (below 0: loses) against the chosen one, to four places."""
    sign = lambda k: -1 if k == "conflict" else 1
    return F.create_map(*[x for k, w in TERMS.items() for x in (F.lit(k), F.round(sign(k) * PARAMS[w] * (gold[k] - top[k]), 4))])


def stage_d(rows: DataFrame) -> DataFrame:
    """rows (recall_all, gold_rank) with top1 and mrr where the gold chain is anywhere in the ranking, else null."""
    judged = lambda c: F.when(F.coalesce("recall_all", F.lit(False)), c)
    return rows.withColumns({"d_evaluable": F.coalesce("recall_all", F.lit(False)), "top1": judged(F.col("gold_rank") == 1), "mrr": judged(F.round(1.0 / F.col("gold_rank"), 3))})


# ---- stages E and F, end to end


def gate_blame(quadrant_: Column, quadrant_geo: Column, decision: Column, geo_ok: Column, tail_ok: Column, has_chain: Column, margin: Column, sim: Column, has_second: Column, differs: Column, margin_min: float = PARAMS["MARGIN_MIN"], sim_min: float = PARAMS["SIM_MIN"]) -> Column:
    """Which gate answers for a wrong decision: of a false accept the one that came nearest to stopping it, of a false reject the one that did; null for right decisions."""
    mm, sm = max(margin_min, 1e-9), max(sim_min, 1e-9)
    exempt = has_second & (margin < mm) & ~differs
    nearer = F.when(has_second, (margin - mm) / mm).otherwise(9.0) < (sim - sm) / sm
    accepted = (
        F.when(geo_ok & ~tail_ok, "tail").when(geo_ok, "assembly").when(~has_chain, "sim")
        .when(exempt, "margin(same_admin_exempt)").when(nearer, "margin").otherwise("sim")
    )
    held = F.when(decision == "reject", "sim").when(decision == "ambiguous", "margin").otherwise(decision)
    return F.when(quadrant_ == "FA", accepted).when((quadrant_ == "FR") | (quadrant_geo == "FR"), held)


def stage_e(decision: Column, deliverable: Column, geo_ok: Column) -> dict[str, Column]:
    """quadrant (by what is delivered), quadrant_geo (by the chain) and e_ok."""
    q = quadrant(decision, deliverable)
    return {"quadrant": q, "quadrant_geo": quadrant(decision, geo_ok), "e_ok": q.isin("TP", "TR")}


def stem(name: Column) -> Column:
    """A name without its first suffix of a list that leaves two characters or more."""
    #: Suffixes in the order of trial.
    suffixes = ("街道", "步行街", "小区", "大道", "路", "街", "巷", "道", "镇", "村", "区", "县", "市")
    cut = reduce(lambda out, x: out.when(name.endswith(x) & (F.length(name) > len(x) + 1), F.substring(name, F.lit(1), F.length(name) - len(x))), suffixes, F.when(F.lit(False), name))
    return cut.otherwise(name)


def preserved(missing: Column, out: Column) -> Column:
    """Whether the stems of all missing names stand in the output; null where none is missing."""
    return F.when(F.size(missing) > 0, F.forall(missing, lambda m: F.contains(out, stem(m))))


def stage_f(gold: dict[str, Column], fields: dict[str, Column], spoken: Column, inserted: Column, depth: Column, admin_all: Column, geo_recall: Column) -> Column:
    """Struct of backfilled (levels that weren't said), backfill, wrong_city and told (all of them were put in); null where the speaker told all. inserted: levels that the assembly put in."""
    bare = lambda v: F.regexp_replace(v, "[省市区]+$", "")
    unsaid = lambda k: (_said(gold[k]) != "") & ~spoken.contains(same_area(gold[k])) & ~spoken.contains(bare(gold[k]))
    levels = F.filter(F.array(*[F.when(unsaid(k), F.lit(k)) for k in ADMIN]), lambda x: x.isNotNull())
    right = every([~unsaid(k) | (same_area(fields[k]) == same_area(gold[k])) for k in ADMIN])
    own = F.when(F.array_contains(inserted, "province") & (_said(gold["city"]) == _said(gold["province"])), F.concat(inserted, F.array(F.lit("city")))).otherwise(inserted)
    told = F.forall(levels, lambda x: F.array_contains(own, x))
    return F.when(depth.isin("district", "street_only"), F.struct(levels.alias("backfilled"), right.alias("backfill"), (~admin_all & (geo_recall < 1)).alias("wrong_city"), told.alias("told")))


def score_e2e(fields: dict[str, Column], address: Column, gold: dict[str, Column], truth: Column) -> Column:
    """Struct of each field's match, geo_recall, admin_all, tail_all, exact, deliverable, geo_ok, cer and severity."""
    area = {k: same_area(fields[k]) == same_area(gold[k]) for k in ADMIN}
    tail = {k: _said(fields[k]) == _said(gold[k]) for k in TAIL}
    names = F.filter(F.array(*[_said(gold[k]) for k in GEO]), lambda x: x != "")
    recall = F.when(F.size(names) > 0, F.size(F.filter(names, lambda g: F.contains(_said(address), g))) / F.size(names)).otherwise(1.0)
    admin_all, tail_all = every(list(area.values())), every(list(tail.values()))
    geo = tx.extract_tail(_said(address))["geo_text"] == tx.extract_tail(_said(truth))["geo_text"]
    severity = F.when(~admin_all, "admin").when((recall < 1) | ~geo, "place").when(~tail_all, "tail").otherwise("right")
    exact = _said(address) == _said(truth)
    return F.struct(*[c.alias(k) for k, c in (area | tail).items()], recall.alias("geo_recall"), admin_all.alias("admin_all"), tail_all.alias("tail_all"), exact.alias("exact"), exact.alias("deliverable"), geo.alias("geo_ok"), F.round(cer(_said(address), _said(truth)), 4).alias("cer"), severity.alias("severity"))


def address_depth(spoken: Column, gold: dict[str, Column]) -> Column:
    """How far down the speaker went: full (province or city said), district or street_only."""

    def said(k: str) -> Column:
        v = _said(gold[k])
        bare = F.regexp_replace(v, "[省市区县]+$", "")
        return (v != "") & (spoken.contains(v) | ((F.length(bare) >= 2) & spoken.contains(bare)))

    return F.when(said("province") | said("city"), "full").when(said("district"), "district").otherwise("street_only")


def injection_outcome(cases: DataFrame) -> DataFrame:
    """Counts of recorded injection cases (expect_key, output, known_flip): n, new_flips, known_flips, fixed. A case flips when the output lacks the key."""
    flipped = ~F.contains(_said(F.col("output")), F.col("expect_key"))
    known = F.coalesce("known_flip", F.lit(False))
    return cases.agg(F.count("*").alias("n"), F.count_if(flipped & ~known).alias("new_flips"), F.count_if(flipped & known).alias("known_flips"), F.count_if(~flipped & known).alias("fixed"))


def top_terms(ranking: DataFrame) -> DataFrame:
    """id with the five terms of the chosen and of the first right chain, for dominant_term and term_deltas. ranking: id, rank, ok and the terms."""
    terms = ["sim", "coverage", "prior", "depth", "conflict"]
    w = W.partitionBy("id").orderBy("rank")
    first = ranking.where("ok").withColumn("_k", F.row_number().over(w)).where("_k = 1").select("id", F.struct(*terms).alias("gold"))
    return ranking.where("rank = 1").select("id", F.struct(*terms).alias("top")).join(first, "id")
