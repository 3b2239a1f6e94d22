"""Readers and writers of the engine's file formats."""

from __future__ import annotations

import hashlib
import json
import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.quality import scored_rows
from ..operators.ranking import PARAMS

PLACE = "struct<name:string,level:string,adcode:string,parent:string,aliases:array<string>,prior:double,lng:double,lat:double>"


def read_gazetteer(spark: SparkSession, path: str | None = None) -> DataFrame:
    """adcode, name, level, parent, aliases, prior, lng, lat, ord of a JSON file {entries: [...]}; no aliases and a prior of 0.5 where they are missing; ord is the entry's place in the file."""
    file = spark.read.schema(f"entries array<{PLACE}>").option("multiLine", True).json(setting("places", path))
    rows = file.select(F.posexplode("entries").alias("ord", "e")).select("e.*", "ord")
    return rows.withColumns({"aliases": F.coalesce("aliases", F.array().cast("array<string>")), "prior": F.coalesce("prior", F.lit(0.5))})


def read_items(spark: SparkSession, path: str, schema: str, splits: DataFrame | None = None, key: str = "id") -> DataFrame:
    """Items of an evaluation set, a .json file {items: [...]} or JSON lines, with the split of their key ('eval' for keys in none). schema: fields as 'name:type, ...'."""
    kind = spark.createDataFrame([], f"item struct<{schema}>").schema["item"].dataType
    if path.endswith(".json"):
        rows = spark.read.schema(f"items array<struct<{schema}>>").option("multiLine", True).json(path).select(F.explode("items").alias("i")).select("i.*")
    else:
        rows = spark.read.schema(kind).json(path)
    if splits is None:
        return rows
    return rows.join(F.broadcast(splits.select(F.col("key").alias("_k"), F.col("split"))), F.col(key).cast("string") == F.col("_k"), "left").drop("_k").withColumn("split", F.coalesce("split", F.lit("eval")))


FIELDS = ", ".join(f"{f}:string" for f in ("province", "city", "district", "street", "road", "house_no", "community", "building", "unit", "room", "floor"))
MANIFEST = (
    "file string, set string, item_id string, speaker_id string, dialect_group string, sub_dialect string, transcript_gold string, address_gold string, "
    f"fields_gold struct<{FIELDS}>, address_depth string, noise string, orthography_expected string, gold_in_db boolean, negative_type string, split string, "
    "quality string, label_status string, has_address boolean, duration double, transcript_asr string, asr_language string, notes string"
)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a recording manifest, JSON lines; fields that a row lacks are null."""
    return spark.read.schema(MANIFEST).json(path)


def manifest_items(rows: DataFrame) -> DataFrame:
    """Evaluation items of a manifest: rows of good quality, under the names of items, with whether they are scored."""
    told = scored_rows(rows.withColumn("gold", F.when(F.col("address_gold") != "", F.col("address_gold"))))
    stem = F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\.[^.]*$", "")
    return told.withColumns({"id": stem, "spoken": F.coalesce(F.when(F.col("transcript_gold") != "", F.col("transcript_gold")), F.col("transcript_asr"), F.lit("")), "ground_truth": F.coalesce("address_gold", F.lit("")), "fields": F.col("fields_gold"), "has_address": F.coalesce("has_address", F.lit(True))}).drop("gold", "fields_gold")


def read_config(spark: SparkSession, path: str) -> dict:
    """A JSON file as it is: splits, negatives, injection cases or a search's settings."""
    return json.loads(spark.read.option("wholetext", True).text(path).collect()[0][0])


def read_drops(spark: SparkSession, path: str) -> DataFrame:
    """name, parent, affects of a file of entries to leave out {drop: [...]}."""
    rows = [(d["name"], d.get("parent"), d.get("affects", [])) for d in read_config(spark, path)["drop"]]
    return spark.createDataFrame(rows, "name string, parent string, affects array<string>")


def setting(name: str, given: str | None = None) -> str:
    """A path that was given, or that the environment gives as VELDSPAR_<NAME>; neither is an error."""
    found = given or os.environ.get(f"VELDSPAR_{name.upper()}")
    if not found:
        raise FileNotFoundError(f"no path for {name}: give one or set VELDSPAR_{name.upper()}")
    return found


def read_codes(spark: SparkSession, path: str) -> DataFrame:
    """A national list of codes as CSV with a header."""
    return spark.read.schema("adcode string, name string, longitude double, latitude double").option("header", True).csv(path)


def read_params(spark: SparkSession, path: str | None = None) -> dict[str, float]:
    """Parameters of a JSON file; a missing file or a missing parameter is an error."""
    path = setting("params", path)
    lines = spark.read.option("wholetext", True).text(path).collect()
    told = json.loads(lines[0][0])["params"]
    missing = [k for k in PARAMS if k not in told]
    if missing:
        raise ValueError(f"{path} lacks the parameters {missing}")
    return {k: float(told[k]) for k in PARAMS}


def with_params(rows: DataFrame, changes: dict[str, float]) -> DataFrame:
    """rows with their own params map; an unknown name is an error."""
    unknown = [k for k in changes if k not in PARAMS]
    if unknown:
        raise KeyError(f"not parameters: {unknown}")
    return rows.withColumn("params", F.map_from_entries(F.array(*[F.struct(F.lit(k), F.lit(float(v))) for k, v in changes.items()])) if changes else F.create_map().cast("map<string,double>"))


def read_splits(spark: SparkSession, path: str) -> DataFrame:
    """key, split of a JSON file {split: [keys]}."""
    told = json.loads(spark.read.option("wholetext", True).text(path).collect()[0][0])
    return spark.createDataFrame([(k, name) for name, keys in told.items() if isinstance(keys, list) for k in keys], "key string, split string")


def write_snapshot(summary: DataFrame, path: str) -> None:
    """A golden snapshot: the slices' counts, no rows."""
    summary.coalesce(1).write.mode("overwrite").json(path)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("axis string, value string, metric string, k long, n long").json(path)


def fingerprint(spark: SparkSession, path: str) -> str:
    """The first twelve digits of the SHA-1 of a file's content."""
    return hashlib.sha1(bytes(spark.read.format("binaryFile").load(path).select("content").head()[0])).hexdigest()[:12]


def write_text(spark: SparkSession, path: str, content: str) -> None:
    """One file of text under its own name, on whatever file system the path is."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(content.encode()))
    finally:
        out.close()


def write_features(rows: DataFrame, path: str, inputs: dict[str, str] | None = None, params: dict | None = None) -> None:
    """Features as Parquet, with a file path.meta.json of when they were made, under which parameters, and of what inputs (names and paths), by fingerprint."""
    rows.write.mode("overwrite").parquet(path)
    spark = rows.sparkSession
    meta = {"created": time.strftime("%Y-%m-%dT%H:%M:%S"), "params": params or {}, "inputs": {k: fingerprint(spark, v) for k, v in (inputs or {}).items()}}
    write_text(spark, f"{path}.meta.json", json.dumps(meta, ensure_ascii=False, indent=1))


def write_report(spark: SparkSession, folder: str, name: str, markdown: str, content: dict) -> str:
    """A report as <time>_<name>.md and .json; the path without its ending."""
    base = f"{folder}/{time.strftime('%Y%m%d_%H%M%S')}_{name}"
    write_text(spark, f"{base}.md", markdown)
    write_text(spark, f"{base}.json", json.dumps(content, ensure_ascii=False, indent=1))
    return base


def latest(spark: SparkSession, pattern: str) -> str | None:
    """The last path by name of those that fit a pattern; None for none."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where)
    return max((str(f.getPath().toString()) for f in found or []), default=None)


def write_places(places: DataFrame, path: str, name: str, version: str, note: str = "") -> None:
    """A gazetteer file as read_gazetteer reads it, in order of ord. A gazetteer is a dimension of bounded size."""
    keep = ["name", "level", "adcode", "parent", "aliases", "prior", "lng", "lat"]
    rows = places.orderBy("ord").select(*[F.col(c) if c in places.columns else F.lit(None).alias(c) for c in keep]).toLocalIterator()
    told = {"_meta": {"name": name, "version": version, "note": note}, "entries": [r.asDict() for r in rows]}
    write_text(places.sparkSession, path, json.dumps(told, ensure_ascii=False))


def write_lines(rows: DataFrame, folder: str, config: dict | None = None) -> None:
    """Rows as JSON lines in a folder (variants, a manifest, quality labels), with the settings that made them as <folder>.config.json."""
    rows.write.mode("overwrite").json(folder)
    if config is not None:
        write_text(rows.sparkSession, f"{folder}.config.json", json.dumps(config, ensure_ascii=False, indent=1))


def write_params(spark: SparkSession, path: str, params: dict, changes: dict[str, float], source: str) -> dict:
    """Writes the next version of a parameter file, the version before beside it as <path>.v<n>, and returns it."""
    told = next_version(params, changes, source)
    write_text(spark, f"{path}.v{params.get('version', 0)}", json.dumps(params, ensure_ascii=False, indent=1))
    write_text(spark, path, json.dumps(told, ensure_ascii=False, indent=1))
    return told


def next_version(params: dict, changes: dict[str, float], source: str) -> dict:
    """A parameter file's content with changes, the version after and the old version in its history."""
    unknown = [k for k in changes if k not in PARAMS]
    if unknown:
        raise KeyError(f"not parameters: {unknown}")
    past = {"version": params.get("version", 0), "source": params.get("source"), "params": params["params"]}
    return {**params, "version": past["version"] + 1, "source": source, "params": {**params["params"], **changes}, "history": [*params.get("history", []), past]}


#: Fixed values of two online searches: rows that one asks for at most, the status of a good answer, where its rows are.
PROVIDERS = {"a": (25, "1", "pois"), "b": (20, "0", "results")}


def found_places(answers: DataFrame, provider: str, limit: int = 25) -> DataFrame:
    """name, adcode, region, lng, lat of a search's answers (answer: its JSON text), limit of each at most. A bad status or an answer that can't be read gives no rows."""
    most, good, rows = PROVIDERS[provider]
    if provider == "a":
        place = "array<struct<name:string,adcode:string,cityname:string,location:string>>"
        pick = lambda x: (x["name"], x["adcode"], x["cityname"], F.split(x["location"], ",")[0].try_cast("double"), F.try_element_at(F.split(x["location"], ","), F.lit(2)).try_cast("double"))
    else:
        place = "array<struct<name:string,uid:string,city:string,location:struct<lng:double,lat:double>>>"
        pick = lambda x: (x["name"], x["uid"], x["city"], x["location"]["lng"], x["location"]["lat"])
    told = answers.select(F.from_json("answer", f"status string, {rows} {place}").alias("r")).where(F.col("r.status") == good)
    each = told.select(F.explode(F.slice(f"r.{rows}", 1, max(1, min(limit, most)))).alias("x"))
    return each.select(*[c.alias(n) for c, n in zip(pick(F.col("x")), ("name", "adcode", "region", "lng", "lat"))])


def provider_for(keys: dict[str, str | None]) -> str | None:
    """The first provider that a key is set for."""
    return next((p for p in PROVIDERS if keys.get(p)), None)


def search_places(spark: SparkSession, path: str, keys: dict[str, str | None], limit: int = 25) -> DataFrame:
    """Places of recorded answers (one JSON document a file) by the provider that has a key; without a key, or without files, none."""
    provider = provider_for(keys)
    empty = spark.createDataFrame([], "name string, adcode string, region string, lng double, lat double")
    if provider is None or latest(spark, path) is None:
        return empty
    return found_places(spark.read.option("wholetext", True).text(path).toDF("answer"), provider, limit)


def register_places(spark: SparkSession) -> None:
    """Registers format 'places': a data source over JSON lines of points of interest, with options keyword, region, limit (25 at most) and lines, their text, which the driver read: executors open no path. Lines that can't be read give no rows."""
    from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

    class Places(DataSource):
        @classmethod
        def name(cls) -> str:
            return "places"

        def schema(self) -> str:
            return "name string, adcode string, region string, lng double, lat double"

        def reader(self, schema) -> DataSourceReader:
            return Reader(dict(self.options))

    class Reader(DataSourceReader):
        def __init__(self, options: dict):
            self.options = options

        def partitions(self) -> list:
            return [InputPartition(0)]

        def read(self, partition):
            import json as js

            o = self.options
            left = min(25, int(o.get("limit", 25)))
            for line in o.get("lines", "").splitlines():
                try:
                    row = js.loads(line)
                except ValueError:
                    continue
                if left and o.get("keyword", "") in row.get("name", "") and o.get("region", row.get("region")) == row.get("region"):
                    left -= 1
                    yield row["name"], row.get("adcode"), row.get("region"), row.get("lng"), row.get("lat")

    spark.dataSource.register(Places)
