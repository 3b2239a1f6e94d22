"""Operators over a gazetteer: a forest of named places (adcode, name, level, parent, aliases, prior)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Levels from the top down and their weights as evidence.
LEVELS = ("province", "city", "district", "street", "road", "poi")
WEIGHTS = {"province": 0.6, "city": 0.8, "district": 1.0, "street": 1.1, "road": 1.2, "poi": 1.2}


def level_order(level: Column, levels: tuple[str, ...] = LEVELS) -> Column:
    return F.array_position(F.array(*map(F.lit, levels)), level).cast("int") - 1


def names(places: DataFrame, *also: str) -> DataFrame:
    """adcode, name_ord, name: the official name first, then the aliases in order; also: more columns of places."""
    every = F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))
    return places.select("adcode", *also, F.posexplode(every).alias("name_ord", "name")).where("name is not null")


def closure(nodes: DataFrame, hops: int = 8) -> DataFrame:
    """adcode, ancestor, hop for every node (adcode, parent) and each of its ancestors, itself at hop 0.

    Paths are doubled: a node's path up to k steps is joined with the path of the node at its end, so that `hops` steps
    take its logarithm in joins. A walk ends at a missing parent or after `hops`.
    """
    known = nodes.select(F.col("adcode").alias("_p"))
    paths = nodes.select("adcode", "parent").join(known, F.col("parent") == F.col("_p"), "left").select("adcode", F.when(F.col("_p").isNotNull(), F.array("_p")).otherwise(F.slice(F.array("adcode"), 1, 0)).alias("up"))
    k = 1
    while k < hops:
        end = F.when(F.size("up") == k, F.element_at("up", -1))
        more = paths.select(F.col("adcode").alias("_a"), F.col("up").alias("_more"))
        paths = paths.withColumn("_end", end).join(more, F.col("_end") == F.col("_a"), "left").select("adcode", F.concat("up", F.coalesce("_more", F.slice("up", 1, 0))).alias("up"))
        k *= 2
    return paths.select("adcode", F.posexplode(F.concat(F.array("adcode"), "up")).alias("hop", "ancestor")).where(F.col("hop") <= hops).select("adcode", "ancestor", "hop")


def candidates(places: DataFrame, level: str | None = None, parent: str | None = None, subtree: str | None = None, hops: int = 8) -> DataFrame:
    """Places of a level, right below a parent, or anywhere below the root of a subtree, in any combination."""
    out = places if level is None else places.where(F.col("level") == level)
    out = out if parent is None else out.where(F.col("parent") == parent)
    if subtree is None:
        return out
    below = closure(places, hops).where((F.col("ancestor") == subtree) & (F.col("hop") > 0)).select("adcode")
    return out.join(below, "adcode", "left_semi")


def descendants(nodes: DataFrame, root: str, level: str, hops: int = 8) -> DataFrame:
    """Nodes of a level below root, at any distance."""
    below = closure(nodes, hops).where((F.col("ancestor") == root) & (F.col("hop") > 0)).select("adcode")
    return nodes.where(F.col("level") == level).join(below, "adcode", "left_semi")


def full_names(nodes: DataFrame, hops: int = 8) -> DataFrame:
    """adcode, full_name: names from the root down; a name equal to the one above it is left out."""
    up = closure(nodes, hops).join(nodes.select(F.col("adcode").alias("ancestor"), "name"), "ancestor")
    path = up.groupBy("adcode").agg(F.array_sort(F.collect_list(F.struct((-F.col("hop")).alias("o"), "name"))).alias("p"))
    parts = F.transform("p", lambda x: x["name"])
    kept = F.filter(parts, lambda x, i: (i == 0) | (x != F.try_element_at(parts, F.greatest(i, F.lit(1)))))
    return path.select("adcode", F.array_join(kept, "").alias("full_name"))


def collisions(every_name: DataFrame, key: Column) -> DataFrame:
    """key, owners: how many different entries have a name that reads so."""
    return every_name.select(key.alias("key"), "adcode").where("key <> ''").groupBy("key").agg(F.countDistinct("adcode").alias("owners"))


def level_stats(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("level").agg(F.count("*").alias("n"))


def integrity(nodes: DataFrame) -> DataFrame:
    """problem, adcode: codes that occur twice and parents that don't exist."""
    twice = nodes.groupBy("adcode").count().where("count > 1").select(F.lit("duplicate code").alias("problem"), "adcode")
    codes = nodes.select(F.col("adcode").alias("_c"))
    orphan = nodes.where("parent is not null").join(codes, F.col("parent") == F.col("_c"), "left_anti")
    return twice.unionAll(orphan.select(F.lit("missing parent").alias("problem"), "adcode"))


def lookup(wanted: DataFrame, places: DataFrame, levels: tuple[str, ...] | None = None) -> DataFrame:
    """wanted with adcode of the place that has the name or alias; of several, the first by ord."""
    pool = places if levels is None else places.where(F.col("level").isin(*levels))
    found = names(pool).join(pool.select("adcode", "ord"), "adcode").groupBy(F.col("name").alias("_n")).agg(F.min_by("adcode", "ord").alias("adcode"))
    return wanted.join(found, F.col("name") == F.col("_n"), "left").drop("_n")


def without(places: DataFrame, drops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, removed): places whose name or alias is in drops (name, parent); a drop's parent, where given, must be the place's parent's code or name."""
    parents = places.select(F.col("adcode").alias("_p"), F.col("name").alias("_pn"))
    told = names(places).join(places.select("adcode", "parent"), "adcode").join(parents, F.col("parent") == F.col("_p"), "left")
    d = drops.select(F.col("name").alias("_dn"), F.col("parent").alias("_dp"))
    hit = told.join(d, (F.col("name") == F.col("_dn")) & (F.col("_dp").isNull() | (F.col("_dp") == F.col("parent")) | (F.col("_dp") == F.col("_pn")))).select("adcode").distinct()
    return places.join(hit, "adcode", "left_anti"), places.join(hit, "adcode", "left_semi")


def with_missing(places: DataFrame, gold: DataFrame) -> DataFrame:
    """places and those rows of gold whose (name, parent) they lack, each pair once."""
    have = places.select("name", "parent")
    same = [F.col("g.name") == F.col("h.name"), F.col("g.parent").eqNullSafe(F.col("h.parent"))]
    new = gold.dropDuplicates(["name", "parent"]).alias("g").join(have.alias("h"), same, "left_anti")
    return places.unionByName(new.select(*places.columns))


def national_codes(rows: DataFrame) -> DataFrame:
    """rows (adcode, name, longitude, latitude) of a national list with level and parent from the code's digits; a district whose city is missing hangs on its province. Generic city names are left out."""
    code = F.col("adcode").cast("string")
    level = F.when(code.endswith("0000"), "province").when(code.endswith("00"), "city").otherwise("district")
    leveled = rows.where(~F.col("name").isin("市辖区", "县", "省直辖县级行政区划", "自治区直辖县级行政区划")).select(code.alias("adcode"), "name", level.alias("level"), "longitude", "latitude")
    cities = leveled.where("level = 'city'").select(F.col("adcode").alias("_c"))
    province, city = F.concat(F.substring("adcode", 1, 2), F.lit("0000")), F.concat(F.substring("adcode", 1, 4), F.lit("00"))
    joined = leveled.join(cities, city == F.col("_c"), "left")
    parent = F.when(F.col("level") == "province", None).when(F.col("level") == "city", province).otherwise(F.coalesce("_c", province))
    return joined.select("adcode", "name", "level", parent.alias("parent"), "longitude", "latitude")


def top_per_key(rows: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    return rows.withColumn(rank, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)
