"""Evaluation of whole runs: texts with gold through resolve and reassembly to stage metrics, attribution, summary and report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import phonetics, stats, text
from ..operators import evaluation as ev
from ..operators import gazetteer as gz
from ..operators import ranking as rk
from ..operators import stages as st
from . import assemble, resolve

FIELDS = (*st.ADMIN, *st.GEO, *st.TAIL)
AXES = ("dialect_group", "address_depth", "noise", "difficulty", "negative_type", "short_name", "rule", "split")
#: The grid over which the gates are replayed.
GRID = [(round(0.02 + 0.02 * m, 2), round(0.50 + 0.02 * s, 2)) for m in range(10) for s in range(16)]
RATES = ("exact", "deliverable", "admin_all", "tail_all", "lexicon_hit", "number_ok", "tail_exact", "illegal_number_caught", "recall_hit", "recall_1", "recall_3", "recall_all", "top1", "backfill", "wrong_city", "backfill_told")
MEANS = ("geo_recall", "filler_leak", "mrr", "cer")
#: The runs of an oracle table: what is taken from gold in each.
CONFIGS = {"baseline": None, "current": (), "oracle db": ("db",), "oracle rank": ("rank",), "oracle gate": ("gate",), "oracle db+rank+gate": ("db", "rank", "gate")}


def gold_columns(prefix: str = "gold") -> dict[str, Column]:
    return {k: F.col(f"{prefix}.{k}") for k in FIELDS}


def places_with_gold(places: DataFrame, items: DataFrame) -> DataFrame:
    """places and the gold roads and communities that they lack, each (name, area) once, under the deepest gold area that is known."""
    flat = items.select("id", *[F.col(f"fields.{k}").alias(k) for k in (*st.ADMIN, *st.GEO)])
    chain = st.gold_chain(flat, places).withColumn("parent", F.coalesce(*[f"{a}_code" for a in reversed(st.ADMIN)]))
    new = chain.where("parent is not null").select(F.explode("missing").alias("name"), "parent").distinct()
    cols = {"adcode": F.concat_ws("-", F.lit("oracle"), F.sha1(F.concat_ws("/", "parent", "name")).substr(1, 12)), "level": F.lit("road"), "aliases": F.array().cast("array<string>"), "prior": F.lit(0.6), "ord": F.lit(2**31 - 1)}
    rows = new.withColumns(cols)
    return gz.with_missing(places, rows.select(*[F.col(c).cast(t).alias(c) if c in rows.columns else F.lit(None).cast(t).alias(c) for c, t in places.dtypes]))


def outcomes(items: DataFrame, places: DataFrame, readings: DataFrame, costs: DataFrame, oracle: tuple[str, ...] = (), topk: int = 200) -> DataFrame:
    """One row for each item (id, spoken, ground_truth, fields, has_address and any axes) with what the engine made of it, its gold chain and its ranked chains' matches.

    oracle: 'db' puts gold's missing places in, 'rank' puts the right chain first, 'gate' decides by gold.
    """
    if "db" in oracle:
        places = places_with_gold(places, items)
    docs = items.select(F.col("id").alias("doc_id"), F.col("spoken").alias("text"))
    gold = st.gold_chain(items.select("id", *[F.coalesce(F.col(f"fields.{k}"), F.lit("")).alias(k) for k in (*st.ADMIN, *st.GEO)]), places)
    gold = gold.select("id", F.struct(*[c for c in gold.columns if c not in ("id", *st.ADMIN, *st.GEO)]).alias("g"))
    codes = {a: F.col(f"g.{a}_code") for a in st.ADMIN}

    def rank_first(ranked: DataFrame) -> DataFrame:
        """The right chain of a document first, the others in order; margins follow."""
        known = ranked.join(gold.withColumnRenamed("id", "doc_id"), "doc_id", "left")
        right = st.chain_matches(F.concat("codes", "also"), F.transform("entries", lambda e: F.struct(e["level"].alias("level"), e["code"].alias("code"))), F.col("g.deepest_code"), codes)
        base = known.withColumn("_right", right).drop("rank", "margin", "has_second", "admin_differs", "g")
        first = base.where("_right").groupBy("doc_id").agg(F.max("total").alias("_most"))
        lifted = base.join(first, "doc_id", "left").withColumn("_own", F.col("total"))
        again = rk.ranked(lifted.withColumn("total", F.when(F.col("_right") & (F.col("total") == F.col("_most")), F.col("total") + 10).otherwise(F.col("total"))))
        margin = F.when(F.col("has_second"), F.col("_own") - F.lead("_own").over(_by_rank())).otherwise(1.0)
        return again.withColumn("margin", margin).withColumn("total", F.col("_own")).drop("_own", "_right", "_most")

    chains = resolve.resolve_chains(docs, places, readings, costs, topk, hook=rank_first if "rank" in oracle else None)
    made = assemble.assembled(chains, phonetics.all_readings(readings), costs)
    rows = items.join(chains.withColumnRenamed("doc_id", "id").drop("text"), "id").join(made.withColumnRenamed("doc_id", "id").withColumnRenamed("fields", "made"), "id").join(gold, "id", "left")
    entries = lambda c: F.transform(c["entries"], lambda e: F.struct(e["level"].alias("level"), e["code"].alias("code")))
    right = F.transform("nbest", lambda c: st.chain_matches(c["all_codes"], entries(c), F.col("g.deepest_code"), codes))
    return rows.withColumn("right", F.coalesce(right, F.array().cast("array<boolean>"))).withColumn("oracle", F.lit("+".join(oracle)))


def _by_rank():
    from pyspark.sql import Window as W

    return W.partitionBy("doc_id").orderBy("rank")


def baseline(items: DataFrame, places: DataFrame) -> DataFrame:
    """Outcomes without any retrieval: the text with its numerals normalized is the address; it is always delivered."""
    written = text.normalize_numbers(F.coalesce("spoken", F.lit("")))
    gold = st.gold_chain(items.select("id", *[F.coalesce(F.col(f"fields.{k}"), F.lit("")).alias(k) for k in (*st.ADMIN, *st.GEO)]), places)
    gold = gold.select("id", F.struct(*[c for c in gold.columns if c not in ("id", *st.ADMIN, *st.GEO)]).alias("g"))
    tail = text.extract_tail(F.col("address"))
    out = items.withColumn("address", written).withColumn("tail", tail)
    made = F.create_map(*[x for k in ("house_no", "building", "unit", "room", "floor") for x in (F.lit(k), F.col(f"tail.{k}"))])
    return out.withColumns({"made": made, "decision": F.lit("baseline"), "right": F.array().cast("array<boolean>"), "segments": F.array().cast("array<struct<kind:string,text:string,orig:string,level:string>>"), "oracle": F.lit("baseline")}).join(gold, "id", "left")


def evaluated(rows: DataFrame) -> DataFrame:
    """rows of outcomes() or baseline() with all flags, quadrants and the attribution of failures.

    An item without an address is right unless it is delivered: a confident decision is a false accept, any other a right
    rejection.
    """
    have = set(rows.columns)
    if "has_address" not in have:
        rows = rows.withColumn("has_address", F.lit(True))
    rows = rows.withColumn("has_address", F.coalesce("has_address", F.lit(True)))
    made = {k: F.try_element_at("made", F.lit(k)) for k in (*FIELDS, "unverified")}
    gold = {k: F.col(f"fields.{k}") for k in FIELDS}
    transcript = F.coalesce(*[F.col(c) for c in ("transcript_gold", "spoken") if c in have], F.lit(""))
    spoken = F.coalesce("spoken", F.lit(""))
    has, ranked = F.col("has_address"), "nbest" in have
    rows = rows.withColumn("e2e", st.score_e2e(made, F.col("address"), gold, F.col("ground_truth")))
    log = F.size(text.substitutions(spoken))
    rows = rows.withColumn("b", st.stage_b(spoken, log, F.col("address"), made["unverified"], made, gold, transcript, F.col("ground_truth")))
    at = F.array_position("right", True)
    seen = F.coalesce("g.evaluable", F.lit(False)) & F.lit(ranked)
    recall = {"c_evaluable": seen, "recall_1": F.when(seen, at == 1), "recall_3": F.when(seen, (at > 0) & (at <= 3)), "recall_all": F.when(seen, at > 0), "gold_rank": F.when(seen & (at > 0), at)}
    recall["recall_hit"] = F.when(seen, F.exists(F.coalesce("every", F.array().cast(dict(rows.dtypes)["every"])), lambda h: h["adcode"] == F.col("g.deepest_code"))) if ranked else F.lit(None).cast("boolean")
    rows = rows.withColumns(recall)
    rows = rows.withColumns({"d_evaluable": F.coalesce("recall_all", F.lit(False)), "top1": F.when(F.col("recall_all"), F.col("gold_rank") == 1), "mrr": F.when(F.col("recall_all"), F.round(1.0 / F.col("gold_rank"), 3))})
    chain = F.when(F.col("d_evaluable"), F.col("top1")).otherwise(F.col("e2e.admin_all") & (F.col("e2e.geo_recall") == 1))
    rows = rows.withColumn("ok_chain", F.when(has, chain if ranked else F.col("e2e.geo_ok")).otherwise(F.col("decision") != "confident"))
    gated = F.when(F.col("oracle").contains("gate") & has, F.when(F.col("ok_chain"), "confident").otherwise("ambiguous")).otherwise(F.col("decision"))
    rows = rows.withColumn("decided", gated)
    auto = F.col("decided").isin("confident", "baseline")
    without = F.when(auto, "FA").otherwise("TR")
    quad = lambda ok: F.when(~has, without).when(auto, F.when(ok, "TP").otherwise("FA")).otherwise(F.when(ok, "FR").otherwise("TR"))
    depth = F.col("address_depth") if "address_depth" in have else st.address_depth(spoken, gold)
    inserted = F.transform(F.filter("segments", lambda s: s["kind"] == "inserted"), lambda s: s["level"])
    rows = rows.withColumns(
        {
            "quadrant": quad(F.col("e2e.deliverable")), "quadrant_geo": quad(F.col("ok_chain")),
            "f": st.stage_f(gold, made, transcript, inserted, depth, F.col("e2e.admin_all"), F.col("e2e.geo_recall")) if ranked else F.lit(None).cast("struct<backfilled:array<string>,backfill:boolean,wrong_city:boolean,told:boolean>"),
            "oov_preserved": st.preserved(F.col("g.missing"), F.concat(F.col("address"), F.coalesce(made["unverified"], F.lit("")))),
        }
    )
    second = F.size("nbest") > 1 if ranked else F.lit(False)
    other = F.coalesce(F.try_element_at("nbest", F.lit(2))["admin"] != F.try_element_at("nbest", F.lit(1))["admin"], F.lit(False)) if ranked else F.lit(False)
    blame = st.gate_blame(F.col("quadrant"), F.col("quadrant_geo"), F.col("decided"), F.col("ok_chain"), F.col("e2e.tail_all"), F.size("nbest") > 0 if ranked else F.lit(False), F.col("margin") if ranked else F.lit(1.0), F.col("sim") if ranked else F.lit(0.0), second, other)
    rows = rows.withColumn("gate_blame", blame).withColumn("over_correction", F.when(F.size("g.missing") > 0, (F.col("quadrant") == "FA") & ~F.col("oov_preserved")))
    lost = F.exists(F.coalesce("g.missing", F.array().cast("array<string>")), lambda m: ~F.contains(F.concat(F.col("address"), F.coalesce(made["unverified"], F.lit(""))), m))
    flags = {
        "quality": F.coalesce("quality", F.lit("ok")) if "quality" in have else F.lit("ok"), "exact": F.col("e2e.exact"), "quadrant": F.col("quadrant"), "decision": F.col("decision"), "name_lost": lost, "name_missing": F.size("g.missing") > 0,
        "gold_in_db": F.col("g.in_db"), "admin_all": F.col("e2e.admin_all"), "phon_dist": F.col("name_phon_dist_max") if "name_phon_dist_max" in have else F.lit(None).cast("double"), "b_ok": F.col("b.ok"), "c_evaluable": F.col("c_evaluable"), "c_ok": F.col("recall_all"),
        "d_evaluable": F.col("d_evaluable"), "d_ok": F.col("top1"), "recall_all": F.col("recall_all"), "top1": F.col("top1"), "quadrant_geo": F.col("quadrant_geo"), "f_evaluable": F.col("f").isNotNull(), "backfill": F.col("f.backfill"),
    }
    label = F.when(has, ev.attribute(flags)).when(F.col("quadrant") == "FA", "gate_over_accept")
    return rows.withColumn("attribution", label).withColumn("attribution_detail", ev.attribution_detail(F.col("attribution"), {"address": F.col("address"), "missing": F.coalesce("g.missing", F.array().cast("array<string>")), "decision": F.col("decision"), "gate": F.col("gate_blame"), "backfilled": F.col("f.backfilled"), "leaked": F.col("b.leaked")}))


def sound_metrics(items: DataFrame, gold: DataFrame, places: DataFrame, readings: DataFrame, costs: DataFrame) -> DataFrame:
    """Stage A of each item (id, spoken, fields): id with the name metrics of stages.stage_a, and cer_char and cer_phon of the whole text where there is a transcript_gold. gold: stages.gold_chain's rows, for the names' other spellings."""
    have = set(items.columns)
    variants = st.name_variants(gold.select("id", "road_codes", *st.GEO), places).select("id", "field", F.explode("variants").alias("name"))
    heard = phonetics.read_aloud(items.select("id", text.han_only(F.coalesce("spoken", F.lit(""))).alias("han")), readings, "han", "syls")
    told = phonetics.read_aloud(variants.select("name").distinct().withColumn("plain", text.han_only(F.col("name"))), readings, "plain", "nsyl").select("name", "nsyl")
    pairs = variants.join(told, "name").join(heard, "id")
    n, m = F.size("nsyl"), F.size("syls")
    widths = F.filter(F.array(n - 1, n, n + 1), lambda w: (w >= 1) & (w <= m))
    cut = F.flatten(F.transform(widths, lambda w: F.transform(F.sequence(F.lit(0), m - w), lambda s: F.struct(w.alias("w"), s.alias("s")))))
    each = pairs.select("id", "field", "name", "han", "nsyl", F.explode_outer(cut).alias("c"), "syls").withColumn("window", F.slice("syls", F.col("c.s") + 1, F.greatest(F.col("c.w"), F.lit(0))))
    dist = F.coalesce(phonetics.weighted_distance(costs)(F.col("window"), F.col("nsyl")) / F.greatest(F.col("c.w"), F.size("nsyl")), F.lit(1.0))
    near = each.withColumn("d", dist).groupBy("id", "field", "name").agg(F.min_by(F.struct("d", "window", "nsyl", "han"), F.struct(F.round("d", 9).alias("r"), F.col("c.w").alias("w"), F.col("c.s").alias("s"))).alias("b"))
    raw = lambda c: F.transform(c, lambda x: x["raw"])
    scored = near.select("id", "field", "name", F.round(st.closest_part(F.col("b.han"), F.col("name"))["cer"], 3).alias("cer_char"), F.round(F.when(F.col("b.window").isNull(), 1.0).otherwise(st.token_rate(raw(F.col("b.window")), raw(F.col("b.nsyl")))), 3).alias("cer_phon"), F.round("b.d", 3).alias("dist_phon_w"))
    out = items.select("id").join(st.stage_a(st.likest(scored)), "id", "left")
    if "transcript_gold" not in have:
        return out
    both = phonetics.read_aloud(phonetics.read_aloud(items.select("id", text.han_only(F.coalesce("spoken", F.lit(""))).alias("h"), text.han_only(F.col("transcript_gold")).alias("g")), readings, "h", "hs"), readings, "g", "gs")
    whole = both.where("length(g) > 0").select("id", ev.cer(F.col("h"), F.col("g")).alias("cer_char"), st.token_rate(raw(F.col("hs")), raw(F.col("gs"))).alias("cer_phon"))
    return out.join(whole, "id", "left")


def sabotage() -> dict[str, tuple[str, dict[str, Column]]]:
    """What spoils an outcome in one place, and the label that a wrong row must then get."""
    return {
        "every decision is a rejection": ("gate_over_reject", {"decision": F.lit("reject")}),
        "the right chain is second": ("rank_error", {"decision": F.lit("confident"), "right": F.array(F.lit(False), F.lit(True)), "address": F.concat("address", F.lit("x"))}),
        "the right chain is never found": ("recall_miss", {"right": F.array().cast("array<boolean>"), "address": F.concat("address", F.lit("x"))}),
        "the address gets a stray character": ("assembly_error", {"address": F.concat("address", F.lit("x"))}),
        "the levels put in are wrong": ("completion_error", {"address": F.concat("address", F.lit("x")), "made": F.map_concat(F.map_filter("made", lambda k, _: k != "province"), F.create_map(F.lit("province"), F.lit("x")))}),
        "the house number is lost": ("normalize_error", {"made": F.map_concat(F.map_filter("made", lambda k, _: k != "house_no"), F.create_map(F.lit("house_no"), F.lit(""))), "address": F.regexp_replace("address", "[0-9]+号", "")}),
        "a place is taken out of the gazetteer": ("db_missing", {"g": F.col("g").withField("missing", F.array(F.lit("碧落街"))).withField("in_db", F.lit(False)), "address": F.lit("x")}),
        "the recording is silent": ("skip", {"quality": F.lit("silent"), "address": F.lit("x")}),
        "the names are misheard beyond recovery": ("asr_unrecoverable", {"name_phon_dist_max": F.lit(0.9), "address": F.concat("address", F.lit("x"))}),
        "talk without an address is delivered": ("gate_over_accept", {"has_address": F.lit(False), "decision": F.lit("confident")}),
    }


def selfcheck(rows: DataFrame, scenarios: dict | None = None) -> DataFrame:
    """scenario, expected, before, after, raised: whether each sabotage of outcomes' rows brings up the label that it should. rows: a written table, as each scenario reads it anew."""
    told = sabotage() if scenarios is None else scenarios
    count = lambda df, label: evaluated(df).agg(F.count_if(F.coalesce(F.col("attribution") == label, F.lit(False))).alias("n"))
    found = []
    for name, (label, changes) in told.items():
        pair = count(rows, label).withColumnRenamed("n", "before").crossJoin(count(rows.withColumns(changes), label).withColumnRenamed("n", "after"))
        found.append(pair.select(F.lit(name).alias("scenario"), F.lit(label).alias("expected"), "before", "after", (F.col("after") > F.col("before")).alias("raised")))
    return reduce(DataFrame.unionAll, found)


def run_steps(steps: list[tuple[str, object]]) -> list[tuple[str, bool, str]]:
    """(name, done, error) of steps (name, function without arguments) up to the first that fails; the rest isn't run."""
    out: list[tuple[str, bool, str]] = []
    for name, step in steps:
        try:
            step()
        except Exception as error:  # the chain stops here and says why
            return [*out, (name, False, f"{type(error).__name__}: {error}")]
        out.append((name, True, ""))
    return out


def flat(rows: DataFrame) -> DataFrame:
    """Evaluated rows with the metrics of RATES and MEANS as columns."""
    own = {"exact": "e2e.exact", "deliverable": "e2e.deliverable", "admin_all": "e2e.admin_all", "tail_all": "e2e.tail_all", "lexicon_hit": "b.lexicon_hit", "number_ok": "b.number_ok", "tail_exact": "b.tail_exact", "illegal_number_caught": "b.illegal_number_caught", "backfill": "f.backfill", "wrong_city": "f.wrong_city", "backfill_told": "f.told", "geo_recall": "e2e.geo_recall", "filler_leak": "b.filler_leak", "cer": "e2e.cer"}
    return rows.withColumns({k: F.when(F.col("has_address") | F.lit(k in ("exact", "deliverable")), F.col(v)) for k, v in own.items()}).withColumns({k: F.when(F.col("has_address"), F.col(k)).otherwise(F.col("quadrant") == "TR") for k in ("exact", "deliverable")})


def axis_columns(rows: DataFrame, axes: tuple[str, ...] = AXES) -> dict[str, Column]:
    """Columns of the axes that rows have: arrays count a row in each value, a rule only where there is one, short names only where they are."""
    kinds = dict(rows.dtypes)
    out: dict[str, Column] = {}
    for a in axes:
        if a == "short_name" and "g" in kinds:
            out[a] = F.when(F.coalesce("g.short_name", F.lit(False)), F.array(F.lit("short"))).otherwise(F.array().cast("array<string>"))
        elif a in kinds and a == "rule":
            out[a] = F.when(F.col(a).isNotNull(), F.array(a)).otherwise(F.array().cast("array<string>"))
        elif a in kinds:
            out[a] = F.col(a)
    return out


def summarized(rows: DataFrame, axes: dict[str, Column] | None = None) -> DataFrame:
    """axis, value, n, k and n of each rate, mean and n of each mean, quadrants with coverage, risk and over_reject, recall of held rows, corrections: over all rows and each value of each axis. One aggregation."""
    table = flat(rows)
    axes = axis_columns(rows) if axes is None else axes
    held = F.col("quadrant").isin("FR", "TR") & F.col("c_evaluable")
    oov = F.col("negative_type") == "oov_db" if "negative_type" in rows.columns else F.lit(False)
    extra = [x for m in MEANS for x in (F.round(F.avg(m), 3).alias(f"{m}_mean"), F.count(m).alias(f"{m}_n"))]
    extra += [F.count_if(F.col("quadrant") == q).alias(q.lower()) for q in ("TP", "FA", "FR", "TR")]
    extra += [F.count_if(held & F.col("recall_3")).alias("nbest_recall_3_k"), F.count_if(held).alias("nbest_recall_3_n"), F.count_if(oov & F.col("over_correction")).alias("over_correction"), F.count_if(oov & F.col("oov_preserved")).alias("preserved")]
    out = ev.sliced(table, axes, {k: F.col(k) for k in RATES}, extra)
    share = lambda a, b: F.when(b > 0, a / b)
    tp, fa, fr = F.col("tp"), F.col("fa"), F.col("fr")
    return out.withColumns({"coverage": share(tp + fa, F.col("n")), "risk": share(fa, tp + fa), "over_reject": share(fr, tp + fr)})


def histograms(rows: DataFrame, columns: tuple[str, ...] = ("attribution", "decision", "gate_blame")) -> DataFrame:
    """what, value, n of each column's values that aren't null."""
    each = F.array(*[F.struct(F.lit(c).alias("what"), F.col(c).cast("string").alias("value")) for c in columns])
    return rows.select(F.explode(each).alias("x")).select("x.*").where("value is not null").groupBy("what", "value").agg(F.count("*").alias("n"))


KEPT = ["id", *RATES, *MEANS, "quadrant", "c_evaluable", "attribution", "attribution_detail", "has_address"]


def config_rows(items: DataFrame, places: DataFrame, readings: DataFrame, costs: DataFrame, oracle: tuple[str, ...] | None) -> DataFrame:
    """Evaluated rows of one run of an oracle table: KEPT columns."""
    made = baseline(items, places) if oracle is None else outcomes(items, places, readings, costs, oracle)
    return flat(evaluated(made)).select(*KEPT)


def oracle_table(items: DataFrame, places: DataFrame, readings: DataFrame, costs: DataFrame, folder: str, configs: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """(a summary row for each config over all items, evaluated rows of all configs): what the engine would reach if a part were perfect.

    Each run's rows are written below folder, a shared one, before the next is planned: six whole plans in one would be
    too large a tree for the optimizer.
    """
    spark = items.sparkSession
    runs = CONFIGS if configs is None else configs
    for k, (name, oracle) in enumerate(runs.items()):
        config_rows(items, places, readings, costs, oracle).withColumn("config", F.lit(name)).write.mode("overwrite").parquet(f"{folder}/{k}")
    rows = reduce(DataFrame.unionByName, [spark.read.parquet(f"{folder}/{k}") for k in range(len(runs))])
    share = lambda a, b: F.when(b > 0, a / b)
    q = lambda *names: F.count_if(F.col("quadrant").isin(*names))
    table = rows.groupBy("config").agg(F.count_if("exact").alias("exact_k"), F.count_if("deliverable").alias("deliverable_k"), F.count("*").alias("n"), share(q("TP", "FA"), F.count("*")).alias("coverage"), share(q("FA"), q("TP", "FA")).alias("risk"))
    return table, rows


def oracle_violations(table: DataFrame) -> DataFrame:
    """Oracle runs that do worse than the current one: config, metric, k, current."""
    cell = lambda df: df.select("config", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"{m}_k").alias("k")) for m in ("exact", "deliverable")])).alias("x")).select("config", "x.*")
    now = cell(table.where("config = 'current'")).select("metric", F.col("k").alias("current"))
    return cell(table.where("config like 'oracle%'")).join(now, "metric").where("k < current")


def replay_columns(rows: DataFrame) -> DataFrame:
    """What a scan of thresholds needs of evaluated rows: sim, coverage, single_dist, deep, margin, has_second, admin_differs, ok; rows without a chain can't pass any gate."""
    second = F.try_element_at("nbest", F.lit(2))
    top = F.try_element_at("nbest", F.lit(1))
    return rows.where("has_address").select("id", F.coalesce("sim", F.lit(-1.0)).alias("sim"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"), "single_dist", F.coalesce("deep", F.lit(False)).alias("deep"), F.coalesce("margin", F.lit(1.0)).alias("margin"), second.isNotNull().alias("has_second"), F.coalesce(second["admin"] != top["admin"], F.lit(False)).alias("admin_differs"), F.col("e2e.deliverable").alias("ok"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("total", F.lit(0.0)))).alias("confidence"))


def render(summary: DataFrame, counts: DataFrame, title: str, notes: dict[str, str] | None = None, table: DataFrame | None = None, changes: DataFrame | None = None) -> str:
    """The report as Markdown: notes, slices with rates and intervals, histograms, the oracle table and changes against a run before. Only aggregated rows reach the driver."""
    lines = [f"# {title}", "", *[f"- {k}: {v}" for k, v in (notes or {}).items()], ""]
    shown = [(c, stats.rate_text(F.col(f"{c}_k"), F.col(f"{c}_n"))) for c in ("exact", "recall_all", "top1", "tail_exact", "backfill")]
    rows = summary.orderBy(F.col("axis") != "all", "axis", F.desc("n"), "value").select("axis", "value", "n", *[c.alias(k) for k, c in shown], F.round("coverage", 3).alias("coverage"), F.round("risk", 3).alias("risk")).collect()
    lines += _markdown(["axis", "value", "n", *[k for k, _ in shown], "coverage", "risk"], rows)
    lines += ["", *_markdown(["what", "value", "n"], counts.orderBy("what", F.desc("n"), "value").collect())]
    if table is not None:
        lines += ["", *_markdown(["config", "exact_k", "deliverable_k", "n", "coverage", "risk"], table.orderBy("config").select("config", "exact_k", "deliverable_k", "n", F.round("coverage", 3).alias("coverage"), F.round("risk", 3).alias("risk")).collect())]
    if changes is not None:
        found = changes.orderBy(*changes.columns).collect()
        lines += ["", *(_markdown(changes.columns, found) if found else ["No slice changed."])]
    return "\n".join(lines) + "\n"


def _markdown(names: list[str], rows: list) -> list[str]:
    cell = lambda x: "-" if x is None else str(x).replace("|", "\\|")
    return ["| " + " | ".join(names) + " |", "|" + "---|" * len(names), *["| " + " | ".join(cell(r[n]) for n in names) + " |" for r in rows]]


def result_json(rows: DataFrame) -> DataFrame:
    """id and json: decision, address, fields, segments and the n-best chains of each outcome, for a service or a file."""
    chain = F.transform("nbest", lambda c: F.struct(c["name"].alias("name"), *[F.round(c[k], 4).alias(k) for k in ("total", "sim", "coverage", "prior", "depth", "conflict")], F.transform(c["evidence"], lambda h: F.struct(h["level"].alias("level"), h["name"].alias("name"), h["matched"].alias("matched"), F.round(h["dist"], 3).alias("dist"))).alias("hits")))
    key = "id" if "id" in rows.columns else "doc_id"
    fields = F.col("made") if "made" in rows.columns else F.col("fields")
    return rows.select(key, F.to_json(F.struct("decision", "address", fields.alias("fields"), "segments", chain.alias("nbest"))).alias("json"))


def explained(rows: DataFrame) -> DataFrame:
    """doc_id and lines for people: decision, then each of the n-best chains with its terms and hits. rows: of resolve_chains."""
    num = lambda c: F.format_number(c, 3)
    hit = lambda h: F.concat(h["level"], F.lit(":"), h["matched"], F.lit("→"), h["name"], F.lit("("), num(h["dist"]), F.lit(")"))
    line = lambda c: F.concat(c["name"], F.lit("  total="), num(c["total"]), F.lit(" sim="), num(c["sim"]), F.lit(" cov="), num(c["coverage"]), F.lit(" prior="), num(c["prior"]), F.lit(" depth="), num(c["depth"]), F.lit(" conflict="), num(c["conflict"]), F.lit("  "), F.array_join(F.transform(c["evidence"], hit), " "))
    return rows.select("doc_id", F.array_join(F.concat(F.array("decision"), F.coalesce(F.transform("nbest", line), F.array().cast("array<string>"))), "\n").alias("lines"))
