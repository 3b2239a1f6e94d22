"""From spoken texts to ranked chains of places and a decision: the library's operators composed into one plan.

Texts are normalized by column expressions; documents then stream past the gazetteer's names, which are broadcast in
blocks, and no shuffle comes before the few hits of a document are put together. A document's hits are few, so its greedy steps are folds over arrays and no step gathers more than one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import phonetics, text
from ..operators import gazetteer as gz
from ..operators import ranking as rk
from ..operators import similarity as sm

#: Characters behind a short place name that make it a manner of speech or a person, not a place.
DEMONYMS = list("话腔人佬妹仔音调味菜")
#: Characters that tell sibling roads apart.
SIBLINGS = list("东西南北中上下内外前后左右新老大小一二三四五六七八九十")
SIBLING_COST = 0.9
#: Fixed value: how much nearer the better of two overlapping hits of a level is for the other to go.
GAP = 0.15


def _letters(c: Column) -> Column:
    return F.filter(F.split(c, ""), lambda x: x != "")


def _tasks(df: DataFrame) -> int:
    """Over how many tasks rows that take long are dealt: told to repartition, it isn't lessened for their few bytes."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def normalized(docs: DataFrame, rules=text.LEXICON, simple: dict[str, str] | None = None) -> DataFrame:
    """doc_id, text, written, tail fields and han, the place part's Han characters. Null text is empty; simple: traditional characters and their simplified ones, applied first."""
    written = text.normalize_numbers(text.rewrite(text.simplified(F.coalesce("text", F.lit("")), simple or {}), rules))
    out = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), written.alias("written"))
    out = out.withColumn("tail", text.extract_tail(F.col("written")))
    return out.withColumn("han", text.han_only(F.col("tail.geo_text")))


def find_hits(docs: DataFrame, places: DataFrame, readings: DataFrame, costs: DataFrame) -> DataFrame:
    """Hits of docs (doc_id, han): doc_id, adcode, level, level_ord, parent, prior, ord, dist, s, e, weak, alias.

    A name's window must be near enough for its length, mustn't differ from it in nothing but a word for a sibling road,
    and a short administrative alias mustn't stand before a demonym. Names of two syllables are weak, but for provinces
    and cities that no other entry sounds like. Within a document, clearly worse hits under better ones of their level go.
    Hits depend on the text alone, so equal texts are searched once; those are dealt to all tasks.
    """
    named = phonetics.read_aloud(gz.names(places, "level").withColumn("plain", text.han_only(F.col("name"))), readings, "plain", "syl").where("size(syl) > 0")
    named = named.select("adcode", "name_ord", "name", "level", _letters(F.col("plain")).alias("chars"), "syl")
    # hits of these stay whatever stands around them: not of aliases before demonyms, nor, unless equal, of names with a word for a sibling road
    spoken = F.coalesce(gz.level_order(F.col("level")) <= 2, F.lit(True)) & (F.col("name_ord") > 0)
    named = named.withColumn("firm", F.when(F.col("adcode").isNull() | F.col("level").isNull() | spoken, 0).when(F.arrays_overlap("chars", F.array(*map(F.lit, SIBLINGS))), 1).otherwise(2))
    named = named.withColumn("name_id", F.xxhash64("adcode", "name_ord"))
    texts = docs.select("han").where("han <> ''").repartition(_tasks(docs), "han").distinct()
    heard = phonetics.read_aloud(texts, readings, "han", "syls")
    best = sm.nearest_windows(heard.withColumn("doc_id", F.col("han")), "syls", named, "syl", costs, rk.PARAMS["LONGER_NAME_TOL"], rk.PARAMS["MAX_DIST"], gap=GAP).withColumnRenamed("doc_id", "han")
    sound = F.array_join(F.transform("syl", lambda x: x["raw"]), " ")
    owners = gz.collisions(named, sound)
    full = best.join(named.select("name_id", "name_ord", F.col("name").alias("matched"), "chars", "syl", sound.alias("key")), "name_id").join(owners, "key").join(places.drop("aliases").withColumnRenamed("name", "entry"), "adcode").join(heard, "han")
    full = full.withColumn("level_ord", gz.level_order(F.col("level"))).withColumn("alias", F.col("name_ord") > 0)
    spot = F.slice("syls", F.col("s") + 1, F.greatest(F.col("e") - F.col("s"), F.lit(0)))
    said = F.slice(_letters(F.col("han")), F.col("s") + 1, F.greatest(F.col("e") - F.col("s"), F.lit(0)))
    wide = F.arrays_zip(spot.alias("a"), F.col("syl").alias("b"), said.alias("c"), F.col("chars").alias("d"))
    cost = phonetics.syllable_cost(costs)
    apart = lambda x: cost(x["a"], x["b"]) >= SIBLING_COST
    sibling = (F.col("dist") > 1e-9) & (F.col("e") - F.col("s") == F.col("L")) & (F.col("L") >= 3) & F.exists(wide, lambda x: apart(x) & x["c"].isin(SIBLINGS) & x["d"].isin(SIBLINGS))
    admin = F.col("level_ord") <= 2
    demonym = admin & F.col("alias") & F.substring("han", F.col("e") + 1, F.lit(1)).isin(DEMONYMS)
    unique = (F.col("dist") <= rk.PARAMS["UNIQUE_SHORT_MAX"]) & (F.col("level_ord") <= 1) & (F.col("owners") <= 1)
    kept = full.where(F.col("dist") <= sm.effective_limit(F.col("L"), rk.PARAMS["MAX_DIST"])).where(~sibling & ~demonym).withColumn("weak", (F.col("L") <= 2) & ~unique)
    item = F.struct("dist", "prior", "level", "s", "e", "ord", "adcode", "level_ord", "parent", "weak", "alias", F.col("entry").alias("name"), "matched")
    hits = kept.groupBy("han").agg(sm.suppress(F.collect_list(item), GAP).alias("h"))
    return docs.select("doc_id", "han").join(hits, "han").select("doc_id", F.explode("h").alias("h")).select("doc_id", "h.*")


def build_chains(hits: DataFrame, places: DataFrame, hops: int = 8) -> DataFrame:
    """Scored chains of hits: doc_id, ord, codes, levels, admin, evidence and the five terms; dominated and repeated ones are gone."""
    up = gz.closure(places.select("adcode", "parent"), hops)
    item = F.struct("dist", "s", "e", "adcode", "level", "level_ord", "weak", "alias", "prior", "ord", "name", "matched")
    every = hits.groupBy("doc_id").agg(F.collect_list(F.struct("dist", "ord", item.alias("h"), "parent")).alias("all"))
    line = up.join(places.select(F.col("adcode").alias("ancestor"), "level", "prior", "name", gz.level_order(F.col("level")).alias("level_ord")), "ancestor")
    line = line.groupBy("adcode").agg(F.array_sort(F.collect_list(F.struct("hop", F.col("ancestor").alias("code"), "level", "level_ord", "prior", "name"))).alias("line"))
    rows = hits.select("doc_id", "adcode", "level_ord", "parent", item.alias("own")).join(line, "adcode").join(every, "doc_id")
    above = F.filter(F.transform(F.filter("line", lambda x: x["hop"] > 0), lambda x: F.try_element_at(F.filter("all", lambda y: y["h"]["adcode"] == x["code"]), F.lit(1))["h"]), lambda h: h.isNotNull())
    rows = rows.withColumn("upward", rk.attach(F.col("own"), above))
    same = F.filter("all", lambda y: (y["h"]["level_ord"] >= 3) & y["parent"].eqNullSafe(F.col("parent")) & (y["h"]["adcode"] != F.col("adcode")))
    near = F.transform(F.array_sort(same), lambda y: y["h"])
    low = F.col("level_ord") >= 3
    grown = F.aggregate(near, F.col("upward"), lambda taken, h: F.when(F.exists(taken, lambda t: sm.overlaps(t, h)), taken).otherwise(F.concat(taken, F.array(h))))
    rows = rows.withColumn("evidence", F.when(low, grown).otherwise(F.col("upward"))).where(rk.viable(F.col("evidence")))
    # the chain's own hit and those it absorbed; a hit on an ancestor street isn't one of them
    roads = F.when(low, F.concat(F.array("own"), F.slice("evidence", F.size("upward") + 1, F.greatest(F.size("evidence") - F.size("upward"), F.lit(0))))).otherwise(F.slice(F.array("own"), 1, 0))
    lead = F.array_sort(roads, lambda a, b: a["s"].cast("int") - b["s"].cast("int"))
    rest = F.filter("line", lambda x: x["hop"] > 0)
    entry = lambda h: F.struct(F.lit(0).alias("hop"), h["adcode"].alias("code"), h["level"].alias("level"), h["level_ord"].alias("level_ord"), h["prior"].alias("prior"), h["name"].alias("name"))
    own_line = F.when(low, F.concat(F.array(entry(F.element_at(lead, 1))), rest)).otherwise(F.col("line"))
    rows = rows.withColumn("entries", own_line).withColumns(
        {
            "codes": F.transform("entries", lambda x: x["code"]),
            "levels": F.array_distinct(F.transform("evidence", lambda h: h["level"])),
            "admin": F.array_join(F.transform(F.array_sort(F.filter("entries", lambda x: x["level_ord"] <= 2), lambda a, b: a["level_ord"] - b["level_ord"]), lambda x: x["code"]), "/"),
            "roads": F.array_join(F.array_sort(F.transform(roads, lambda h: h["adcode"].cast("string"))), "/"),
            "lead": F.when(low, F.element_at(lead, 1)["adcode"]).otherwise(F.col("adcode")),
            "also": F.transform(F.slice(lead, 2, F.greatest(F.size(lead) - 1, F.lit(0))), lambda h: h["adcode"]),
            "n_evidence": F.size("evidence"),
            "ord": F.col("own.ord"),
        }
    )
    single = rk.dedupe(rows.select("doc_id", "admin", "roads", "adcode", "codes", "levels", "evidence", "entries", "all", "lead", "also", "n_evidence", "ord"), ["doc_id", "admin", "roads"])
    return sm.undominated(single, "adcode", "doc_id", "codes", "levels")


def scored(chains: DataFrame, docs: DataFrame) -> DataFrame:
    """chains with sim, coverage, prior, depth, conflict, total, single_dist and deep."""
    rows = chains.join(docs.select("doc_id", F.length("han").alias("n")), "doc_id")
    sims = F.transform("evidence", lambda h: F.struct(h["level"].alias("level"), (1 - h["dist"]).alias("sim")))
    others = F.transform("all", lambda y: F.struct(y["h"]["adcode"].alias("adcode"), y["h"]["dist"].alias("dist"), y["h"]["weak"].alias("weak"), y["h"]["level"].alias("level"), y["h"]["level_ord"].alias("level_ord"), y["h"]["s"].alias("s"), y["h"]["e"].alias("e"), F.exists("entries", lambda x: x["level"] == y["h"]["level"]).alias("on_chain")))
    rows = rows.withColumns(
        {
            "sim": rk.weighted_mean(sims, "sim"), "coverage": rk.covered(F.col("evidence"), F.col("n")), "prior": rk.weighted_mean(F.col("entries"), "prior"),
            "depth": F.least(F.col("n_evidence"), F.lit(3)) / 3.0, "conflict": rk.conflict(F.col("evidence"), F.col("codes"), others),
            "single_dist": F.when(F.col("n_evidence") == 1, F.element_at("evidence", 1)["dist"]), "deep": F.exists("evidence", lambda h: h["level_ord"] >= 2),
        }
    )
    if "params" not in rows.columns:
        rows = rows.withColumn("params", F.create_map().cast("map<string,double>"))
    return rows.withColumn("total", rk.total(F.col("sim"), F.col("coverage"), F.col("prior"), F.col("depth"), F.col("conflict")))


def chain_name(entries: Column, evidence: Column) -> Column:
    """Names of a chain from the top down: what was matched where that is a longer form of the name; a name equal to the one above it once."""
    def shown(x: Column) -> Column:
        said = F.try_element_at(F.filter(evidence, lambda h: h["adcode"] == x["code"]), F.lit(1))
        longer = (F.length(said["matched"]) > F.length(x["name"])) & F.contains(said["matched"], x["name"])
        return F.when(longer, said["matched"]).otherwise(x["name"])

    parts = F.transform(F.array_sort(entries, lambda a, b: a["level_ord"] - b["level_ord"]), shown)
    kept = F.filter(parts, lambda x, i: (i == 0) | (x != F.try_element_at(parts, F.greatest(i, F.lit(1)))))
    return F.array_join(kept, "")


def resolve_chains(docs: DataFrame, places: DataFrame, readings: DataFrame, costs: DataFrame, topk: int = 5, simple: dict[str, str] | None = None, hook=None) -> DataFrame:
    """One row for each document: doc_id, text, written, tail, han, decision, all hits (every), the top chain's entries and evidence, its scores, and nbest: the topk chains with names, codes, scores and features.

    hook: a transform of the ranked chains before the gates decide, such as an oracle that puts the right one first.
    """
    plain = normalized(docs.select("doc_id", "text").repartition(_tasks(docs), "doc_id"), simple=simple)
    hits = find_hits(plain, places, readings, costs)
    ranked = rk.ranked(scored(build_chains(hits, places), plain))
    if hook is not None:
        ranked = hook(ranked)
    cut = ranked.where(F.col("rank") <= topk)
    decision = rk.decide(F.col("sim"), F.col("coverage"), F.col("single_dist"), F.col("deep"), F.col("margin"), F.col("has_second"), F.col("admin_differs"))
    main = F.transform("evidence", lambda h: h.withField("main", ~F.array_contains(F.col("also"), h["adcode"])))
    item = F.struct("rank", chain_name(F.col("entries"), F.col("evidence")).alias("name"), "codes", F.concat("codes", "also").alias("all_codes"), "admin", "sim", "coverage", "prior", "depth", "conflict", "total", "margin", "single_dist", "deep", "n_evidence", F.transform("entries", lambda x: F.struct(x["level"].alias("level"), x["code"].alias("code"), x["name"].alias("name"), x["level_ord"].alias("level_ord"))).alias("entries"), main.alias("evidence"), decision.alias("decision"))
    best = cut.groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias("nbest"))
    said = hits.groupBy("doc_id").agg(F.collect_list(F.struct("level", "adcode", "s", "e", "dist", "weak", "name", "matched")).alias("every"))
    out = plain.join(best, "doc_id", "left").join(said, "doc_id", "left")
    top = F.try_element_at("nbest", F.lit(1))
    fields = {n: top[n] for n in ("entries", "evidence", "codes", "sim", "coverage", "prior", "depth", "conflict", "total", "margin", "single_dist", "deep")}
    return out.withColumns({"decision": F.when(F.length("han") == 0, "empty").otherwise(F.coalesce(top["decision"], F.lit("reject"))), **fields})


def resolve(docs: DataFrame, places: DataFrame, readings: DataFrame, costs: DataFrame, topk: int = 5) -> DataFrame:
    """One row for each document (doc_id, text): decision, the top chain's codes and scores, the n-best totals, tail fields.

    A text without Han characters is 'empty', one without any viable chain 'reject'. docs' doc_id must be unique.
    """
    out = resolve_chains(docs, places, readings, costs, topk)
    return out.select("doc_id", "written", "tail", "decision", F.reverse("codes").alias("codes"), "sim", "coverage", "prior", "depth", "conflict", "total", "margin", F.transform("nbest", lambda x: x["total"]).alias("nbest"))
