"""Reassembly: a resolved text becomes one canonical address, its fields, and its segments with what became of each.

The written text stays the anchor. Hits are marked on it and replaced by official names, tail fields stay, what isn't
known stays and is told as unverified, small talk goes, and administrative levels that weren't said are put in. Steps are
functions over a document's pieces; a document is small, so one Arrow pass over documents does it all, without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.phonetics import INITIALS, Costs
from ..operators.gazetteer import LEVELS

ADMIN = LEVELS[:3]
HAN = re.compile(r"[一-鿿]")
#: Words behind a landmark that make it a point of reference, in the order of trial.
REFERENCE = ("那个", "那边的", "那边", "旁边的", "旁边", "附近的", "附近", "对面的", "对面")
#: Endings of road names, which such words don't make a landmark.
ROAD_ENDS = ("路", "街", "道", "段")
#: Openings of spoken addresses.
OPENINGS = ("我家住在", "我家在", "我家住", "我住在", "我家", "我在", "家在", "住在", "送到", "寄到", "送去", "寄去", "地址是", "地址在", "地址", "就是", "就在", "在", "那个", "那边", "那儿", "那里", "这个", "这边", "这里", "是", "的")
#: Fillers of several characters, which go wherever they stand, and of one, which go at the ends.
FILLERS = ("那边的", "旁边的", "附近的", "对面的", "那栋楼", "那幢楼", "那座楼", "那个", "那边", "那儿", "那里", "这个", "这边", "这里", "旁边", "附近", "对面", "楼上", "楼下", "院子里", "院子", "那栋", "那幢", "那座", "就是", "就在")
EDGES = "的里头上下在是"
PUNCTUATION = re.compile(r"[。，,、！!？?；;：:\s「」『』()（）“”‘’《》]+")
#: Nouns that say nothing alone.
GENERIC = {"巷子", "巷", "院子", "院坝", "楼", "房子", "房", "家", "家里", "屋", "屋里", "那栋", "那幢", "小区", "街", "路", "门口", "门", "对门", "隔壁"}
#: Types of places that may be left over behind a hit.
LEFT_OVER = {"街道", "步行街", "古镇", "广场", "大道", "路", "街", "巷", "小区", "花园", "大厦", "商场", "中心", "镇", "村", "新区", "区", "市", "省", "机场", "火车站", "站"}
#: Characters that a part of an address has, those and words that only talk has.
FEATURE = set("路街巷道村镇号栋幢座楼苑园区厦场城店馆院寓库站港口湾桥门铺摊坊堂庄墅所局厂校湖山塔寺庙")
TALK = set("的嘅呢吧嘛哈呀哦啦咯喽啰哟嘞吗么呗")
TALK_WORDS = ("地道", "味儿", "味道", "正宗", "好吃", "巴适", "安逸", "真的", "腔", "话", "唠", "明明白白")
#: Road types that are taken into the name before them, and endings of names that are complete.
ROAD_TYPES = "路街巷道"
COMPLETE = ("路", "巷", "道", "段")
STRONG, MISHEARD = 0.15, 0.30
RANK = {"confident": 4, "ambiguous": 3, "partial": 2, "reject": 1, "empty": 0}
_OPENING = re.compile("^(?:" + "|".join(OPENINGS) + ")+")
_FILLER = re.compile("|".join(FILLERS))


@dataclass
class Piece:
    """A stretch of the text. kind: hit, tail, free, or what took it out (ref, dropped); text is what it becomes, said what stood there."""

    kind: str
    text: str
    said: str
    level: str = ""


@dataclass
class Plan:
    """Marks on the written text as (start, end, kind, text, level), in order, and what they say about levels."""

    marks: list[tuple[int, int, str, str, str]] = field(default_factory=list)
    landmarks: list[str] = field(default_factory=list)
    moved: set[str] = field(default_factory=set)


class Sounds:
    """Costs of short stretches against ends of names. readings: character -> its readings; costs: rows of confusion_costs."""

    def __init__(self, readings: dict[str, list[str]], costs: list):
        self.readings, self.costs = readings, Costs(costs)

    @staticmethod
    def _split(raw: str) -> tuple[str, str, str]:
        first = next((i for i in INITIALS["mandarin"] if raw.startswith(i) and len(raw) > len(i)), "")
        return first, raw[len(first) :], raw

    def misheard(self, said: str, name: str, at_start: bool) -> bool:
        """Whether up to three characters sound like the start (or end) of a longer name, each in its likest reading."""
        heard, told = HAN.findall(said), HAN.findall(name)
        n = len(heard)
        if not 1 <= n <= 3 or n >= len(told):
            return False
        total = 0.0
        for x, y in zip(heard, told[:n] if at_start else told[-n:]):
            options, ref = self.readings.get(x), self.readings.get(y)
            if not options or not ref:
                return False
            total += float(self.costs.swap([self._split(r) for r in options], [self._split(ref[0])]).min())
        return total / n <= MISHEARD


def shown(hit: dict) -> str:
    """The official name, or what was matched if that is a longer form of it."""
    name, matched = hit["name"], hit["matched"]
    return matched if len(matched) > len(name) and name in matched else name


def references(hits: list[dict], han: str) -> list[dict]:
    """Landmarks among the hits below the districts that only tell where the next one is."""
    low = sorted((h for h in hits if h["level"] not in ADMIN), key=lambda h: h["s"])
    pointed = lambda h: han.startswith(REFERENCE, h["e"])
    return [h for k, h in enumerate(low) if pointed(h) and any(x["s"] >= h["e"] for x in low[k + 1 :]) and not h["matched"].endswith(ROAD_ENDS)]


def talks_on(text: str) -> bool:
    """Whether a stretch begins as talk, not as more of a name."""
    return bool(text) and (text[0] in EDGES or text[0] in TALK or text.startswith(FILLERS))


def plan(text: str, tails: list[tuple[int, int]], evidence: list[dict], codes: set[str], every: list[dict]) -> Plan:
    """Where the chain's hits stand in the text and what becomes of each; strong hits of other places at the chain's own levels are struck out."""
    out = Plan()
    inside = [any(s <= i < e for s, e in tails) for i in range(len(text))]
    place = [i for i, c in enumerate(text) if HAN.match(c) and not inside[i]]  # hits count these characters alone
    where = lambda h: (place[h["s"]], place[h["e"] - 1] + 1) if h["s"] < h["e"] <= len(place) else None
    asides = references(evidence, "".join(text[i] for i in place))
    first_road = min((h["s"] for h in evidence if h["level"] not in ADMIN), default=None)
    for h in evidence:
        if (at := where(h)) is None:
            continue
        start, end = at
        level, rest = h["level"], text[end:]
        if h in asides:
            word = next((w for w in REFERENCE if rest.startswith(w)), "")
            out.marks.append((start, end + len(word), "ref", "", "ref"))
            out.landmarks.append(h["matched"])
        elif level in ADMIN and first_road is not None and h["s"] > first_road:  # part of a name further on: told again in its own place
            out.marks.append((start, end, "dropped", "", "demoted"))
            out.moved.add(level)
        else:
            name, low = shown(h), level not in ADMIN
            if low and h["weak"] and h["matched"] != h["name"] and rest and HAN.match(rest[0]) and not talks_on(rest):
                name = text[start:end]  # a longer name was said than the short form that was met
            if low and rest and rest[0] in ROAD_TYPES and not name.endswith(COMPLETE) and name[-1] != rest[0]:
                name, end = name + rest[0], end + 1
            out.marks.append((start, end, "hit", name, level))
    said_levels = {h["level"] for h in evidence} & set(ADMIN)
    limit = min([s for s, _ in tails] + [len(text)])
    for h in every:
        rival = h["level"] in said_levels and h["adcode"] not in codes and h["dist"] <= STRONG and not h["weak"]
        at = where(h) if rival else None
        if at and at[0] < limit and all(at[1] <= m[0] or at[0] >= m[1] for m in out.marks):
            out.marks.append((*at, "dropped", "", "rejected"))
    out.marks.sort()
    return out


def laid_out(text: str, tails: list[tuple[int, int]], marks: list[tuple]) -> list[Piece]:
    """The text as pieces in order. Tail fields win over marks, a later mark over an earlier one from where it begins."""
    owner: list[int | None] = [None] * len(text)
    for k, (start, end, *_) in enumerate(marks):
        owner[start:end] = [k] * (min(end, len(text)) - start)
    for k, (start, end) in enumerate(tails):
        owner[start:end] = [-1 - k] * (end - start)
    out, at = [], 0
    while at < len(text):
        own = owner[at]
        if own is None:
            end = next((i for i in range(at, len(text)) if owner[i] is not None), len(text))
            out.append(Piece("free", text[at:end], text[at:end]))
        elif own < 0:
            start, end = tails[-1 - own]
            out.append(Piece("tail", text[start:end], text[start:end], "tail"))
        else:
            start, end, kind, name, level = marks[own]
            out.append(Piece(kind, name, text[start:end], level))
        at = max(end, at + 1)
    return out


def remnants(text: str, lead: bool, after_hit: bool, trailing: bool) -> list[str]:
    """What is left of free text without openings, fillers, nouns that say nothing and, behind the tail, talk."""
    out: list[str] = []
    for k, part in enumerate(p for p in PUNCTUATION.split(text) if p):
        for bit in _FILLER.split(_OPENING.sub("", part) if lead and k == 0 else part):
            bit = bit.strip(EDGES)
            talk = trailing and (not FEATURE & set(bit) or TALK & set(bit) or any(w in bit for w in TALK_WORDS))
            if bit and bit not in GENERIC and not talk and not (after_hit and not out and bit in LEFT_OVER):
                out.append(bit)
    return out


def reviewed(pieces: list[Piece], chained: bool, sounds: Sounds) -> tuple[list[Piece], list[dict]]:
    """(pieces that stay, segments): free text is kept as unverified or goes as filler. A kept piece has its segment's number as at."""
    told = [k for k, p in enumerate(pieces) if p.kind == "hit"]
    content = [k for k, p in enumerate(pieces) if p.kind in ("hit", "tail")]
    kept: list[Piece] = []
    segments: list[dict] = []
    for k, piece in enumerate(pieces):
        if piece.kind in ("ref", "dropped"):
            segments.append({"kind": piece.kind, "text": piece.said, "level": piece.level})
            continue
        if piece.kind != "free":
            segments.append({"kind": piece.kind, "text": piece.text, "orig": piece.said, "level": piece.level})
            kept.append(piece)
            continue
        before = kept[-1] if kept else Piece("", "", "")
        after = next((p for p in pieces[k + 1 :] if p.kind in ("hit", "tail")), None)
        between = before.kind == "hit" and before.level in ADMIN and after is not None and after.kind == "hit" and after.level in ADMIN
        bits: list[str] = []
        if not (told and k < told[0]) and not between:
            bits = remnants(piece.text, not kept, before.kind == "hit", chained and bool(content) and k > content[-1])
            if bits and after and after.kind == "hit" and sounds.misheard(bits[-1], after.text, True):
                bits.pop()
            if bits and before.kind == "hit" and sounds.misheard(bits[0], before.text, False):
                bits.pop(0)
        if bits:
            kept.append(Piece("free", "".join(bits), piece.said, "free"))
            segments.append({"kind": "unverified", "text": kept[-1].text, "orig": piece.said})
        else:
            segments.append({"kind": "filler", "text": piece.said})
    return kept, segments


def completed(kept: list[Piece], segments: list[dict], names: dict[str, str], present: set[str]) -> tuple[list[Piece], list[dict]]:
    """Both with the administrative levels of names that aren't present, each before the first hit of a lower level; a name that stands there already isn't repeated."""
    shown_as = {"hit", "tail", "unverified"}
    for level in ADMIN:
        name = names.get(level)
        if name is None or level in present or any(p.kind == "hit" and p.text == name for p in kept):
            continue
        lower = LEVELS[LEVELS.index(level) + 1 :]
        fits = [k for k, p in enumerate(kept) if p.kind == "hit" and p.level in lower] or [k for k, p in enumerate(kept) if p.kind in ("hit", "tail")] or [0]
        at = fits[0]
        slots = [k for k, s in enumerate(segments) if s["kind"] in shown_as or s["kind"] == "inserted"]
        kept.insert(at, Piece("hit", name, "", level))
        segments.insert(slots[at] if at < len(slots) else len(segments), {"kind": "inserted", "text": name, "level": level})
    return kept, segments


def fields_of(entries: list[dict], evidence: list[dict]) -> dict[str, str]:
    """Names by level of a chain's entries; a municipality is its own city."""
    met = {h["level"]: h for h in evidence if h["main"]}
    out = {level: "" for level in LEVELS[:5]}
    for e in entries:
        if e["level"] in out:
            h = met.get(e["level"])
            out[e["level"]] = shown(h) if h and h["adcode"] == e["code"] else e["name"]
    if out["province"].endswith("市") and not out["city"]:
        out["city"] = out["province"]
    return out


def assemble(doc: dict, sounds: Sounds) -> dict:
    """address, fields and segments of a document: written, tail (with spans), decision, entries, evidence, every."""
    text, tail = doc["written"] or "", doc["tail"]
    tails = sorted((x["s"], x["e"]) for x in tail["spans"])
    chained = doc["decision"] in ("confident", "ambiguous", "partial") and bool(doc["entries"])
    entries, evidence = (doc["entries"], doc["evidence"]) if chained else ([], [])
    made = plan(text, tails, evidence, {e["code"] for e in entries}, doc["every"] or []) if chained else Plan()
    kept, segments = reviewed(laid_out(text, tails, made.marks), chained, sounds)
    unverified = [p.text for p in kept if p.kind == "free"]
    fields = fields_of(entries, evidence)
    if chained:
        said = {h["level"] for h in evidence} & set(ADMIN)
        names = {e["level"]: fields[e["level"]] for e in entries if e["level"] in ADMIN}
        kept, segments = completed(kept, segments, names, said - made.moved)
    roads = [p.text for p in kept if p.kind == "hit" and p.level not in ADMIN]
    fields |= {"road": roads[0] if roads else "", "community": "".join(roads[1:]), "landmark": "、".join(made.landmarks), "unverified": "、".join(unverified)}
    fields |= {k: tail[k] for k in ("house_no", "building", "unit", "room", "floor")}
    return {"doc_id": doc["doc_id"], "address": "".join(p.text for p in kept), "fields": list(fields.items()), "segments": segments}


SEGMENT = pa.struct([("kind", pa.string()), ("text", pa.string()), ("orig", pa.string()), ("level", pa.string())])


def assembled(resolved: DataFrame, readings: DataFrame, costs: DataFrame) -> DataFrame:
    """doc_id, address, fields (map) and segments (kind, text, orig, level) of resolve_chains' rows.

    readings (ch, readings; phonetics.all_readings) and costs are dimension tables bounded by a script and its rules, and
    go to the executors. A text that was rejected keeps its words without a chain; null text gives an empty address.
    """
    spark = resolved.sparkSession
    told = spark.sparkContext.broadcast(({r.ch: [x.raw for x in r.readings] for r in readings.toLocalIterator()}, [(r.kind, r.a, r.b, r.cost) for r in costs.collect()]))
    kind = resolved.schema["doc_id"].dataType
    names = ["doc_id", "written", "tail", "decision", "entries", "evidence", "every"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql import Row

        read, rows = told.value
        sounds = Sounds(read, [Row(kind=k, a=a, b=b, cost=c) for k, a, b, c in rows])
        for batch in batches:
            done = [assemble(doc, sounds) for doc in batch.to_pylist()]
            types = {"doc_id": batch.schema.field("doc_id").type, "address": pa.string(), "fields": pa.map_(pa.string(), pa.string()), "segments": pa.list_(SEGMENT)}
            yield pa.RecordBatch.from_arrays([pa.array([d[n] for d in done], t) for n, t in types.items()], names=list(types))

    return resolved.select(*names).mapInArrow(run, f"doc_id {kind.simpleString()}, address string, fields map<string,string>, segments array<struct<kind:string,text:string,orig:string,level:string>>")


def better(first: tuple[Column, Column], second: tuple[Column, Column]) -> Column:
    """Whether the second pass (decision, total of the top chain) beats the first: a higher decision, or as high with a clearly higher total. Null totals count as 0."""
    order = F.create_map(*[F.lit(x) for pair in RANK.items() for x in pair])
    a, b = (F.coalesce(F.try_element_at(order, p[0]), F.lit(-1)) for p in (first, second))
    return F.when(a != b, b > a).otherwise(F.coalesce(second[1], F.lit(0.0)) > F.coalesce(first[1], F.lit(0.0)) + 1e-6)


def chosen_pass(first: DataFrame, second: DataFrame) -> DataFrame:
    """Rows of the first pass, or the second's for documents where that is better, with chosen (pass1, pass2). Both: doc_id, decision, total and the same further columns."""
    cols = [c for c in first.columns if c != "doc_id"]
    pair = first.select("doc_id", F.struct(*cols).alias("_a")).join(second.select("doc_id", F.struct(*cols).alias("_b")), "doc_id", "left")
    take = F.col("_b").isNotNull() & better((F.col("_a.decision"), F.col("_a.total")), (F.col("_b.decision"), F.col("_b.total")))
    return pair.select("doc_id", F.when(take, F.col("_b")).otherwise(F.col("_a")).alias("_c"), F.when(take, "pass2").otherwise("pass1").alias("chosen")).select("doc_id", "_c.*", "chosen")


def second_context(nbest: Column, extra: Column, topk: int = 8) -> Column:
    """Lines that prompt a second pass: full names of the first topk chains, then those of their further evidence."""
    return F.array_distinct(F.filter(F.concat(F.slice(nbest, 1, topk), F.flatten(F.slice(extra, 1, topk))), lambda x: x.isNotNull() & (x != "")))
