"""Similarity joins of token windows against names, and selection among overlapping hits."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import phonetics

BROADCAST_BYTES = 32 << 20


def sized(side: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """side with a broadcast hint if the optimizer knows it to be within limit, else as it is."""
    known = int(str(side._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(side) if known <= limit else side


def windows(docs: DataFrame, tokens: str, lengths: DataFrame) -> DataFrame:
    """doc_id, w, s, window, L: the windows of each document's tokens at the widths L - 1, L and L + 1 of each length L (of L = 1: 1 alone)."""
    widths = lengths.select(F.col("L"), F.explode(F.when(F.col("L") <= 1, F.array("L")).otherwise(F.array(F.col("L") - 1, F.col("L"), F.col("L") + 1))).alias("w")).where("w >= 1")
    each = docs.join(F.broadcast(widths), F.size(tokens) >= F.col("w"))  # one row for each distinct name length
    at = each.select("doc_id", "L", "w", tokens, F.explode(F.sequence(F.lit(0), F.size(tokens) - F.col("w"))).alias("s"))
    return at.select("doc_id", "L", "w", "s", F.slice(tokens, F.col("s") + 1, F.col("w")).alias("window"))


def shared_token(docs: DataFrame, tokens: str, names: DataFrame, syllables: str) -> DataFrame:
    """doc_id, name_id pairs that share a token: an equi join on exploded tokens, so neither side is compared with all of the other."""
    left = docs.select("doc_id", F.explode(F.array_distinct(tokens)).alias("token"))
    right = names.select("name_id", F.explode(F.array_distinct(syllables)).alias("token"))
    return left.join(right, "token").select("doc_id", "name_id").distinct()


def best_windows(docs: DataFrame, tokens: str, names: DataFrame, syllables: str, distance: Callable[[Column, Column], Column], tolerance: float = 0.08, prefilter: bool = True) -> DataFrame:
    """For each document and entry the window most like one of the entry's names: doc_id, adcode, name_id, dist, s, e.

    names: name_id, adcode, name_ord and syllables. A window's distance is over the longer of both; of equal ones (to
    nine places) the narrower, then the leftmost. Of an entry's names within tolerance of its nearest, the longest.
    """
    names = names.withColumn("L", F.size(syllables)).where("L > 0")
    pairs = shared_token(docs, tokens, names, syllables) if prefilter else docs.select("doc_id").join(sized(names.select("name_id")))
    cut = windows(docs, tokens, names.select("L").distinct())
    rows = pairs.join(names.select("name_id", "adcode", "name_ord", "L", F.col(syllables).alias("_syl")), "name_id").join(cut, ["doc_id", "L"])
    scored = rows.withColumn("dist", distance(F.col("window"), F.col("_syl")) / F.greatest("w", "L"))
    best = scored.groupBy("doc_id", "adcode", "name_id", "name_ord", "L").agg(F.min_by(F.struct("dist", "s", (F.col("s") + F.col("w")).alias("e")), F.struct(F.round("dist", 9).alias("d"), "w", "s")).alias("b"))
    flat = best.select("doc_id", "adcode", "name_id", "name_ord", "L", "b.*")
    near = flat.withColumn("_least", F.min("dist").over(W.partitionBy("doc_id", "adcode"))).where(F.col("dist") <= F.col("_least") + tolerance)
    chosen = near.groupBy("doc_id", "adcode").agg(F.min_by(F.struct("name_id", "dist", "s", "e", "L"), F.struct(-F.col("L"), "dist", "name_ord")).alias("b"))
    return chosen.select("doc_id", "adcode", "b.*")


#: Most cells of a table that a task holds while it compares a document with names.
CELLS = 1 << 21


class NameBlock:
    """Names of a gazetteer's block by level and length, as numbers of their syllables, each group as a tree of common beginnings."""

    def __init__(self, rows: list):
        self.known: dict[tuple, int] = {}
        number = lambda syl: [self.known.setdefault((x["ini"], x["fin"], x["raw"]), len(self.known)) for x in syl]
        level: dict = {}
        for r in rows:
            own = r.get("level")
            level[r["adcode"]] = own if level.get(r["adcode"], own) == own else None
        by: dict[tuple, list] = {}
        for r in rows:
            by.setdefault((level[r["adcode"]], len(r["syl"])), []).append((number(r["syl"]), (r["adcode"], r["name_id"], r["name_ord"], r.get("firm") or 0)))
        self.groups = [NameTree(lv, n, own) for (lv, n), own in sorted(by.items(), key=lambda x: (x[0][1], str(x[0][0])))]
        self.members: dict = {}
        for g, group in enumerate(self.groups):
            for k, key in enumerate(group.keys):
                self.members.setdefault(key[0], []).append((g, k))

    def windows(self, ids: np.ndarray, costs: np.ndarray, tolerance: float, limit: float | None, gap: float | None = None, sure: list = (), alone: bool = False) -> list[tuple]:
        """(adcode, name_id, dist, s, e, L) of each entry that shares a syllable with a document; ids: its syllables as rows of costs, whose columns are the names' syllables.

        With a gap, hits that suppress() takes out for certain are left out: those under a firm hit of their level within
        the gap of 0, which nothing can suppress. sure: such hits (level, dist, s, e) of other blocks; alone: return this
        block's, in that form, instead.
        """
        if not len(ids):
            return []
        shared = (costs[np.unique(ids)] == 0).any(axis=0)
        swap = costs[ids].T
        most = lambda group: np.inf if limit is None else limit * min(1.0, group.n / 3.0)
        found: dict = {}
        if gap is not None:
            self._measure(found, self._near(shared, swap, lambda group: np.full(len(ids) + 1, min(gap, most(group)))), shared, ids, costs, tolerance, limit)
            firm = [(lv, hit[2], hit[3], hit[4]) for lv, hit, held in found.values() if hit and lv is not None and hit[2] <= gap and (held == 2 or held == 1 and hit[2] <= 1e-9)]
            if alone:
                return firm
            over: dict = {}
            for lv, dist, s, e in [*firm, *sure]:
                over[lv, s, e] = min(dist, over.get((lv, s, e), np.inf))
        else:
            over = {}

        def reach(group: NameTree) -> np.ndarray:
            out = np.full(len(ids) + 1, most(group))
            for (lv, s, e), dist in over.items():
                if lv == group.level:  # ends of windows that can't but overlap the firm hit
                    out[s + 1 : e + max(1, group.n - 1)] = np.minimum(out[s + 1 : e + max(1, group.n - 1)], dist + gap)
            return out

        self._measure(found, self._near(shared, swap, reach), shared, ids, costs, tolerance, limit)
        beaten = lambda lv, hit: any(lv == k and s < hit[4] and hit[3] < e and hit[2] - dist > gap for (k, s, e), dist in over.items())
        return [hit for lv, hit, _ in found.values() if hit and not beaten(lv, hit)]

    def _near(self, shared: np.ndarray, swap: np.ndarray, reach: Callable[[NameTree], np.ndarray]) -> set:
        """Entries with a name that may be within reach (a distance for each end of a window)."""
        return {group.keys[k][0] for group in self.groups for k in group.near(swap, reach(group)).tolist() if shared[group.syl[k]].any()}

    def _measure(self, found: dict, entries: set, shared: np.ndarray, ids: np.ndarray, costs: np.ndarray, tolerance: float, limit: float | None) -> None:
        """Adds to found the level, best hit (or none within limit) and firmness of each of entries, by all its names that share a syllable."""
        some: dict[int, list] = {}
        for adcode in entries - found.keys():
            for g, k in self.members[adcode]:
                some.setdefault(g, []).append(k)
        own: dict = {}
        for g in sorted(some):
            group = self.groups[g]
            rows = np.array(sorted(some[g]), np.int64)
            rows = rows[shared[group.syl[rows]].any(axis=1)]
            size = max(1, CELLS // (16 * len(ids)))
            for part in (rows[k : k + size] for k in range(0, len(rows), size)):
                best, start, end = _best(ids, costs, group.syl[part], group.n)
                for k in np.flatnonzero(np.isfinite(best)).tolist():
                    adcode, name_id, name_ord, firm = group.keys[part[k]]
                    own.setdefault(adcode, []).append((float(best[k]), group.n, name_ord, name_id, int(start[k]), int(end[k]), firm, group.level))
        for adcode, names in own.items():
            least = min(x[0] for x in names)
            dist, n, _, name_id, s, e, firm, level = min((x for x in names if x[0] <= least + tolerance), key=lambda x: (-x[1], x[0], x[2]))
            kept = limit is None or dist <= limit * min(1.0, n / 3.0)
            found[adcode] = (level, (adcode, name_id, dist, s, e, n) if kept else None, firm)


class NameTree:
    """Names of one level and length n, sorted, as a tree: at each depth the nodes' syllables and where their children begin."""

    def __init__(self, level: str | None, n: int, names: list):
        self.level, self.n = level, n
        syl = np.array([x[0] for x in names], np.int64).reshape(len(names), n)
        order = np.lexsort(syl.T[::-1])
        self.syl, self.keys = syl[order], [names[k][1] for k in order.tolist()]
        starts = np.zeros(1, np.int64)
        self.depths = []
        new = np.zeros(len(names), bool)
        new[0] = True
        for d in range(n):
            new[1:] |= self.syl[1:, d] != self.syl[:-1, d]
            at = np.flatnonzero(new)
            self.depths.append((np.append(np.searchsorted(at, starts), len(at)), self.syl[at, d]))
            starts = at
        self.leaves = np.append(starts, len(names))

    def near(self, swap: np.ndarray, reach: np.ndarray) -> np.ndarray:
        """Names that may be within reach[j] of a window that ends at j: edit distances to the nearest stretch that ends there, whatever its start, bound theirs from below.

        swap: costs of the names' syllables (rows) for the document's. A beginning is left when no end within its reach is left.
        """
        places = np.arange(swap.shape[1] + 1)
        if not np.isfinite(reach).all():
            return np.arange(len(self.keys))
        most = reach * (self.n + 1) + 1e-6
        if most.max() >= self.n:
            return np.arange(len(self.keys))
        bounds = []
        for left in range(self.n - 1, -1, -1):
            bound = most - left
            for k in range(1, min(len(most), left + int(most.max()) + 2)):
                np.maximum(bound[:-k], most[k:] - abs(k - left), out=bound[:-k])
            bounds.append(bound)
        out = []
        stack = [(0, np.zeros(1, np.int64), np.zeros((1, len(places))))]
        size = max(1, CELLS // len(places))
        while stack:
            d, nodes, row = stack.pop()
            if d == self.n:
                out.append(_ranges(self.leaves, nodes)[0])
                continue
            first, token = self.depths[d]
            children, parent = _ranges(first, nodes)
            for k in range(0, len(children), size):
                kids = children[k : k + size]
                above = row[parent[k : k + size]]
                new = np.empty_like(above)
                new[:, 0] = d + 1
                np.minimum(above[:, :-1] + swap[token[kids]], above[:, 1:] + 1, out=new[:, 1:])
                new = np.minimum.accumulate(new - places, axis=1) + places
                alive = np.flatnonzero((new <= bounds[d]).any(axis=1))
                if len(alive):
                    stack.append((d + 1, kids[alive], new[alive]))
        return np.concatenate(out) if out else np.zeros(0, np.int64)


def _ranges(first: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers from first[k] to first[k + 1] of each k of nodes, and which of nodes each belongs to."""
    size = first[nodes + 1] - first[nodes]
    owner = np.repeat(np.arange(len(nodes)), size)
    return np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + first[nodes][owner], owner


def _best(ids: np.ndarray, costs: np.ndarray, names: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distance, start and end of the window most like each name of n syllables: of equal ones the narrower, then the leftmost."""
    best = np.full(len(names), np.inf)
    start, end = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
    for w in (1,) if n <= 1 else (n - 1, n, n + 1):
        if w > len(ids):
            continue
        dist = _distances(ids, costs, names, w) / max(w, n)
        at = np.round(dist, 9).argmin(axis=0)
        own = dist[at, np.arange(len(names))]
        better = own < best - 1e-9
        best[better], start[better], end[better] = own[better], at[better], at[better] + w
    return best, start, end


def _distances(ids: np.ndarray, costs: np.ndarray, names: np.ndarray, w: int) -> np.ndarray:
    """Edit distances (windows x names) of all windows of w syllables against names of one length, all in step."""
    starts = np.arange(len(ids) - w + 1)
    row = [np.full((len(starts), len(names)), float(j)) for j in range(names.shape[1] + 1)]
    for i in range(w):
        swap = costs[ids[starts + i]]
        new = [np.full_like(row[0], float(i + 1))]
        for j in range(names.shape[1]):
            new.append(np.minimum(np.minimum(row[j + 1], new[j]) + 1, row[j] + swap[:, names[:, j]]))
        row = new
    return row[-1]


def nearest_windows(docs: DataFrame, tokens: str, names: DataFrame, syllables: str, costs: DataFrame, tolerance: float = 0.08, limit: float | None = None, block_names: int = 50_000, gap: float | None = None) -> DataFrame:
    """What best_windows gives for syllables at weighted confusion costs, without a shuffle: doc_id, adcode, name_id, dist, s, e, L.

    Names go out in blocks of about block_names (an entry's names in one block), and documents stream through each: names
    are walked as a tree of common beginnings, and those that may be near enough are compared with all windows of the
    document at once. With a limit, entries beyond the distance that a name of its length may have (effective_limit) are
    left out where they are found. With a gap, so are those that suppress(hits, gap) takes out for certain: names then
    have their entry's level and firm, what it takes for their hits to stay (0: unknown, 1: equal, 2: nothing). Of
    several blocks, all are asked for firm hits first.
    """
    spark = docs.sparkSession
    told = phonetics.Costs(costs.collect())
    more = [c for c in ("level", "firm") if c in names.columns]
    pool = names.select("adcode", "name_id", "name_ord", F.col(syllables).alias("syl"), *more).where("size(syl) > 0")
    blocks = max(1, -(-pool.count() // block_names))
    kinds = dict(pool.dtypes) | {"doc_id": dict(docs.dtypes)["doc_id"]}
    schema = f"doc_id {kinds['doc_id']}, adcode {kinds['adcode']}, name_id {kinds['name_id']}, dist double, s int, e int, L int"

    def search(sent, alone: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block, costs_ = sent.value
            columns = list(block.known)
            for whole in batches:
                for batch in (whole.slice(k, 1000) for k in range(0, whole.num_rows, 1000)):
                    rows = batch.to_pylist()
                    seen: dict[tuple, int] = {}
                    read = [[seen.setdefault((x["ini"], x["fin"], x["raw"]), len(seen)) for x in r[tokens] or ()] for r in rows]
                    table = costs_.swap(list(seen), columns) if seen and columns else np.zeros((len(seen), len(columns)))
                    sure = [[(x["level"], x["dist"], x["s"], x["e"]) for x in r.get("_sure") or ()] for r in rows]
                    out = [(r["doc_id"], *hit) for r, ids, own in zip(rows, read, sure) for hit in block.windows(np.array(ids, np.int64), table, tolerance, limit, gap, own, alone)]
                    kind = batch.schema.field("doc_id").type
                    types = (kind, pa.string(), pa.float64(), pa.int32(), pa.int32()) if alone else (kind, None, None, pa.float64(), pa.int32(), pa.int32(), pa.int32())
                    heads = ["doc_id", "level", "dist", "s", "e"] if alone else ["doc_id", "adcode", "name_id", "dist", "s", "e", "L"]
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(types)], names=heads)

        return run

    sent = []
    for k in range(blocks):
        own = pool if blocks == 1 else pool.where(F.pmod(F.xxhash64("adcode"), F.lit(blocks)) == k)
        sent.append(spark.sparkContext.broadcast((NameBlock([r.asDict(recursive=True) for r in own.collect()]), told)))
    each = lambda df, alone, schema: reduce(DataFrame.unionAll, [df.mapInArrow(search(x, alone), schema) for x in sent])
    read = docs.select("doc_id", tokens)
    if gap is not None and blocks > 1:
        firm = each(read, True, f"doc_id {kinds['doc_id']}, level string, dist double, s int, e int")
        firm = firm.groupBy("doc_id", "level", "s", "e").agg(F.min("dist").alias("dist")).groupBy("doc_id").agg(F.collect_list(F.struct("level", "dist", "s", "e")).alias("_sure"))
        read = read.join(firm, "doc_id", "left")
    return each(read, False, schema)


def match_names(queries: DataFrame, names: DataFrame, distance: Callable[[Column, Column], Column], topk: int = 5, most: float = 0.55) -> DataFrame:
    """The topk entries for each query (query_id, syllables) by the distance to their nearest name: query_id, adcode, dist, rank. Ties go to the higher prior.

    The difference in length alone bounds the distance from below, so a query meets names of the lengths that can be near
    enough: an equi join on the length, whatever the size of either side. Entries with the same names are as far from any
    query, so queries meet the names once, with the topk of those entries by prior and code; both steps are dealt to all tasks.
    """
    tasks = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    q = queries.select("query_id", F.col("syllables").alias("_q")).where("size(_q) > 0")
    n = names.select("adcode", "prior", F.col("syllables").alias("_n")).where("size(_n) > 0")
    longest_name = n.agg(F.max(F.size("_n"))).head()[0] or 0
    # an entry whose names have different priors shares its place with those of the same names and priors alone
    own = n.repartition(tasks, "adcode").groupBy("adcode").agg(F.sort_array(F.collect_set(F.struct("_n", "prior"))).alias("_own"))
    even = F.size(F.array_distinct(F.transform("_own", lambda x: x["prior"]))) == 1
    own = own.select("adcode", F.when(even, F.col("_own")[0]["prior"]).alias("_lead"), F.when(even, F.transform("_own", lambda x: x.withField("prior", F.when(F.lit(False), x["prior"])))).otherwise(F.col("_own")).alias("_names"))
    first = own.withColumn("_r", F.row_number().over(W.partitionBy("_names").orderBy(F.desc("_lead"), "adcode"))).where(F.col("_r") <= topk)
    groups = first.groupBy("_names").agg(F.collect_list(F.struct("_lead", "adcode")).alias("_entries")).repartition(tasks, "_names")
    each_name = groups.select("_names", "_entries", F.explode("_names").alias("_x")).select("_names", "_entries", F.col("_x._n").alias("_n"), F.col("_x.prior").alias("_p"), F.size("_x._n").alias("_len"))
    least = F.greatest(F.lit(1), F.ceil(F.size("_q") * (1 - most) - 1e-9).cast("int"))
    largest = F.least(F.lit(longest_name), F.floor(F.size("_q") / max(1 - most, 1e-9) + 1e-9).cast("int")) if most < 1 else F.lit(longest_name)
    lengths = q.select("query_id", "_q", F.explode(F.when(largest >= least, F.sequence(least, largest)).otherwise(F.array().cast("array<int>"))).alias("_len"))
    pairs = each_name.join(sized(lengths), "_len")
    near = pairs.withColumn("dist", distance(F.col("_q"), F.col("_n")) / F.greatest(F.size("_q"), F.size("_n"))).where(F.col("dist") <= most)
    found = near.groupBy("query_id", "_names", "_entries").agg(F.min("dist").alias("dist"), F.max("_p").alias("_p"))
    each = found.select("query_id", F.explode("_entries").alias("_x"), "dist", "_p").select("query_id", F.col("_x.adcode").alias("adcode"), "dist", F.coalesce("_p", "_x._lead").alias("prior"))
    w = W.partitionBy("query_id").orderBy("dist", F.desc("prior"), "adcode")
    return each.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= topk).drop("prior")


def effective_limit(syllables: Column, most: float | Column = 0.4) -> Column:
    """The distance that a name of so many syllables may have: shorter names must be nearer."""
    return (F.lit(most) if isinstance(most, float) else most) * F.least(F.lit(1.0), syllables / 3.0)


def overlaps(a: Column, b: Column) -> Column:
    """Whether two spans s, e share a place."""
    return (a["s"] < b["e"]) & (b["s"] < a["e"])


def suppress(hits: Column, gap: float = 0.15) -> Column:
    """Non-maximum suppression of an array of hits (dist, prior, level, s, e, ord): in order of distance, a hit goes that overlaps a kept one of its level nearer by more than gap. A suppressed hit suppresses nothing."""
    ordered = F.array_sort(hits, lambda a, b: F.when(a["dist"] != b["dist"], F.when(a["dist"] < b["dist"], -1).otherwise(1)).when(a["prior"] != b["prior"], F.when(a["prior"] > b["prior"], -1).otherwise(1)).when(a["ord"] < b["ord"], -1).when(a["ord"] > b["ord"], 1).otherwise(0))
    beaten = lambda kept, h: F.exists(kept, lambda k: (k["level"] == h["level"]) & overlaps(k, h) & (h["dist"] - k["dist"] > gap))
    return F.aggregate(F.slice(ordered, 2, F.greatest(F.size(ordered) - 1, F.lit(0))), F.slice(ordered, 1, 1), lambda kept, h: F.when(beaten(kept, h), kept).otherwise(F.concat(kept, F.array(h))))


def undominated(sets: DataFrame, key: str, group: str, codes: str, levels: str) -> DataFrame:
    """Rows of a group whose codes aren't a proper subset of another's that also has all their levels."""
    other = sets.select(F.col(group).alias("_g"), F.col(key).alias("_k"), F.col(codes).alias("_c"), F.col(levels).alias("_l"))
    inside = (F.size(F.array_except(codes, "_c")) == 0) & (F.size(F.array_distinct(codes)) < F.size(F.array_distinct("_c"))) & (F.size(F.array_except(levels, "_l")) == 0)
    return sets.join(other, (F.col(group) == F.col("_g")) & (F.col(key) != F.col("_k")) & inside, "left_anti")
