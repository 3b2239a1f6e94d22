"""Quality classifier by co-training.

Two classifiers see a document from two sides: its text (words that occur, shares of kinds of characters) and its
page's metadata (source, language, size). Both are logistic regressions. They start from the labelled rows; in each
round, either one scores all unlabelled documents and labels those of which it is surest, in the classes' proportion,
for the other. Their scores are then calibrated on held-out labelled rows (Platt) and combined as log-odds over the
prior. All documents are scored with the combined model, in place and without a shuffle.

There are two heads of two views each: one for quality, one for the absence of toxicity. A document is good if its
quality label is 1 and it isn't labelled toxic; its score is the lesser of the heads' probabilities. The models are
fitted on the driver on bounded numbers of rows: SAMPLE labelled ones, least by a hash of doc_id, and PSEUDO surest
ones for each head, view and round. The documents' features are written once, reduced to the words that the models
know, so that a round reads little.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces, relieved, written

SAMPLE = 12_000
PSEUDO = 400  # documents that a view labels in a round at most
OVER = 8
ROUNDS = 3
SURE = 0.95
LEAST_DOCS = 5  # documents of the sample that a word must occur in
TELLING = 3.5  # standard errors by which a word's share of good documents must be off
THRESHOLD = 0.5
HEADS = ("quality", "clean")
STEMS = (3, 5)  # characters
SHARED = (2, 4, 8)  # words of a text that share a stem
EDGE = ".,;:!?\"'()[]"
SCORES = "doc_id long, p_text double, p_meta double, p double, kept boolean"
_UPPER, _LOWER, _DIGIT = bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58))
_SPACE, _USUAL = b" \t\n\r\x0b\x0c", b".,;:'\"()-"
_LETTERS = _UPPER + _LOWER + bytes(range(128, 256))


def _hashed(values: pa.Array, seed: int = 0) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(x, seed) for x in values.to_pylist()), np.uint64, len(values))


class Words:
    """Words of texts in lower case without punctuation at their ends: how many each text has, and (doc, code) of its distinct ones in values."""

    def __init__(self, texts: pa.Array):
        lists = pc.utf8_split_whitespace(texts)
        flat, parent = lists.flatten(), lists.value_parent_indices()
        full = pc.not_equal(flat, "")  # white space at the ends leaves empty ones
        flat, parent = flat.filter(full), np.asarray(parent.filter(full))
        coded = pc.utf8_lower(pc.utf8_trim(flat, characters=EDGE)).dictionary_encode()
        self.values = coded.dictionary
        n = max(1, len(self.values))
        pairs = np.unique(parent.astype(np.int64) * n + np.asarray(coded.indices, np.int64))
        self.doc, self.code = pairs // n, pairs % n
        self.count, self.distinct = np.bincount(parent, minlength=len(texts)), np.bincount(self.doc, minlength=len(texts))

    def features(self, known: np.ndarray | None = None) -> list[np.ndarray]:
        """Sorted hashes of each text's features: its words, and each stem that so many of them share; of known ones only, if given."""
        told = [(self.doc, _hashed(self.values)[self.code])]
        for length in STEMS:
            stems = pc.utf8_slice_codeunits(self.values, 0, length).dictionary_encode()
            n = max(1, len(stems.dictionary))
            own, counts = np.unique(self.doc * n + np.asarray(stems.indices, np.int64)[self.code], return_counts=True)
            hashes = _hashed(stems.dictionary, length)
            told += [(own[counts >= k] // n, hashes[own[counts >= k] % n] * np.uint64(2 * k + 1)) for k in SHARED]
        doc, key = (np.concatenate([x[k] for x in told]) for k in (0, 1))
        if known is not None:
            hit = np.isin(key, known)
            doc, key = doc[hit], key[hit]
        order = np.lexsort((key, doc))
        doc, key = doc[order], key[order]
        new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])])[: len(doc)]
        doc, key = doc[new], key[new]
        return np.split(key, np.searchsorted(doc, np.arange(1, len(self.count))))


def text_stats(text: str, words: int, distinct: int) -> list[float]:
    """Sizes and shares of kinds of characters and words."""
    raw = text.encode()
    size = max(1, len(raw))
    n = max(1, words)
    left = lambda drop: len(raw.translate(None, drop))
    upper, letters = size - left(_UPPER), size - left(_LETTERS)
    odd = left(_LETTERS + _DIGIT + _SPACE + _USUAL)
    return [
        np.log1p(words), np.log1p(len(raw) / n), upper / max(1, letters), odd / size, np.log1p(100 * odd / size), (size - left(_DIGIT)) / size,
        np.log1p(distinct) - np.log1p(words), raw.count(b"|") / n, raw.count(b"\n") / n, raw.count(b"!") / n, letters / size, float(not words),
    ]


def meta_keys(source: str | None, lang: str | None, n_chars: int | None) -> list[int]:
    known = n_chars is not None and n_chars >= 0
    return [xxhash.xxh64_intdigest(repr(x)) for x in (("source", source), ("lang", lang), ("size", int(np.log2(n_chars + 1)) if known else None), ("lang and size", lang, int(2 * np.log2(n_chars + 1)) if known else None))]


@dataclass
class Rows:
    """Rows of one view: distinct feature hashes of each row and dense numbers."""

    keys: list[np.ndarray]
    dense: np.ndarray

    def take(self, index: np.ndarray) -> Rows:
        return Rows([self.keys[i] for i in index], self.dense[index])


@dataclass
class View:
    """Logistic regression over the features that occur often enough, and standardised dense numbers."""

    known: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    mean: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: np.ndarray = field(default_factory=lambda: np.ones(0))
    dense: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = 0.0
    slope: float = 1.0
    shift: float = 0.0

    def prepare(self, rows: Rows, good: np.ndarray, least: int, telling: float) -> None:
        """Chooses features: those of least rows or more whose count among good rows is telling standard errors or more off what the classes' share makes likely."""
        every, at = np.unique(np.concatenate([*rows.keys, np.zeros(0, np.uint64)]), return_inverse=True)
        counts = np.bincount(at, minlength=len(every))
        ones = np.bincount(at, np.repeat(good, [len(k) for k in rows.keys]), len(every))
        share = good.mean() if len(good) else 0.5
        off = np.abs(ones - counts * share) / np.sqrt(counts * share * (1 - share) + 1e-9)
        self.known = every[(counts >= least) & (off >= telling)]
        self.weights = np.zeros(len(self.known))
        self.mean = rows.dense.mean(axis=0) if len(rows.dense) else np.zeros(rows.dense.shape[1])
        self.scale = rows.dense.std(axis=0) + 1e-6 if len(rows.dense) else np.ones(rows.dense.shape[1])
        self.dense = np.zeros(rows.dense.shape[1])

    def _sparse(self, rows: Rows) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.array([len(k) for k in rows.keys], np.int64)
        flat = np.concatenate([*rows.keys, np.zeros(0, np.uint64)])
        owner = np.repeat(np.arange(len(sizes)), sizes)
        if not len(self.known):
            return owner[:0], np.zeros(0, np.int64)
        spot = np.minimum(np.searchsorted(self.known, flat), len(self.known) - 1)
        hit = self.known[spot] == flat
        return owner[hit], spot[hit]

    def fit(self, rows: Rows, good: np.ndarray, steps: int = 80, rate: float = 0.1, ridge: float = 0.5) -> None:
        """Adam over all rows, starting from where the last fit ended."""
        owner, spot = self._sparse(rows)
        dense = (rows.dense - self.mean) / self.scale
        n, d = len(good), dense.shape[1]
        w = np.concatenate([self.weights, self.dense, [self.bias]])
        m, v = np.zeros_like(w), np.zeros_like(w)
        keep = np.full(len(w), ridge / max(1, n))
        keep[-1] = 0
        for t in range(1, steps + 1):
            z = np.bincount(owner, w[spot], n) + dense @ w[len(self.known) : -1] + w[-1]
            off = (_odds(z) - good) / max(1, n)
            slope = np.concatenate([np.bincount(spot, off[owner], len(self.known)), off @ dense, [off.sum()]]) + keep * w
            m = 0.9 * m + 0.1 * slope
            v = 0.999 * v + 0.001 * slope * slope
            w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        self.weights, self.dense, self.bias = w[: len(self.known)], w[len(self.known) : -1], float(w[-1])

    def margin(self, rows: Rows) -> np.ndarray:
        owner, spot = self._sparse(rows)
        return np.bincount(owner, self.weights[spot], len(rows.keys)) + ((rows.dense - self.mean) / self.scale) @ self.dense + self.bias

    def calibrate(self, z: np.ndarray, good: np.ndarray, steps: int = 200) -> None:
        """Platt's slope and shift by Newton's method, with his smoothed targets."""
        ones, zeros = good.sum(), len(good) - good.sum()
        aim = np.where(good > 0, (ones + 1) / (ones + 2), 1 / (zeros + 2))
        a, b = 1.0, 0.0
        for _ in range(steps):
            p = _odds(a * z + b)
            g = np.array([((p - aim) * z).sum(), (p - aim).sum()])
            s = p * (1 - p)
            h = np.array([[(s * z * z).sum() + 1e-3, (s * z).sum()], [(s * z).sum(), s.sum() + 1e-3]])
            step = np.linalg.solve(h, g)
            a, b = a - step[0], b - step[1]
            if np.abs(step).max() < 1e-9:
                break
        self.slope, self.shift = float(max(a, 0.0)), float(b)

    def log_odds(self, z: np.ndarray) -> np.ndarray:
        return self.slope * z + self.shift


def _odds(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class Head:
    """Both views and the prior log-odds of the wanted class. A head without views gives the prior."""

    text: View | None
    meta: View | None
    prior: float

    def scores(self, text: Rows, meta: Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(text.keys)
        if self.text is None or self.meta is None:
            p = np.full(n, float(_odds(np.array(self.prior))))
            return p, p, p
        a, b = self.text.log_odds(self.text.margin(text)), self.meta.log_odds(self.meta.margin(meta))
        return _odds(a), _odds(b), _odds(a + b - self.prior)


@dataclass
class Model:
    """A head for quality and one for the absence of toxicity."""

    heads: tuple[Head, ...]

    def scores(self, text: Rows, meta: Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        each = [head.scores(text, meta) for head in self.heads]
        return tuple(np.min([x[k] for x in each], axis=0) for k in range(3))

    def known(self) -> tuple[np.ndarray, np.ndarray]:
        """The features that either view of any head looks at."""
        views = [(h.text, h.meta) for h in self.heads if h.text is not None]
        none = np.zeros(0, np.uint64)
        return np.unique(np.concatenate([none, *(v[0].known for v in views)])), np.unique(np.concatenate([none, *(v[1].known for v in views)]))


class Training:
    """One head while it is fitted: labelled rows, every third of which is held out for calibration, and pseudo-labels."""

    def __init__(self, text: Rows, meta: Rows, good: np.ndarray):
        n = len(good)
        self.rows, self.good = (text, meta), good
        self.prior = float(np.log((good.sum() + 1) / (n - good.sum() + 1)))
        self.held = np.arange(n) % 3 == 2
        self.train = np.flatnonzero(~self.held)
        own = good[self.train]
        self.able = min(own.sum(), len(own) - own.sum()) >= 3 and len(set(good[self.held].tolist())) == 2
        self.views = (View(), View()) if self.able else (None, None)
        self.labelled = (text.take(self.train), meta.take(self.train))
        self.extra: list[dict[tuple, tuple[Rows, float]]] = [{}, {}]  # row -> its features and the label that the other view gave
        self.base = float(own.mean()) if len(own) else 0.5
        if self.able:
            for view, rows, least, telling in zip(self.views, self.labelled, (LEAST_DOCS, LEAST_DOCS), (TELLING, TELLING)):
                view.prepare(rows, own, least, telling)

    def fit(self, steps: int) -> None:
        for view, rows, extra in zip(self.views, self.labelled, self.extra):
            if view is not None:
                more = [extra[k] for k in sorted(extra, key=repr)]
                joined = Rows(rows.keys + [x.keys[0] for x, _ in more], np.concatenate([rows.dense, *(x.dense for x, _ in more)]))
                view.fit(joined, np.concatenate([self.good[self.train], [y for _, y in more]]), steps=steps)

    def trusted(self, k: int, label: float) -> bool:
        """Whether view k is right about the held-out rows of which it is that sure, as often as it claims; one that tells nothing must not teach the other."""
        p = _odds(self.views[k].margin(self.rows[k].take(np.flatnonzero(self.held))))
        own = self.good[self.held][p >= SURE if label else p <= 1 - SURE]
        return len(own) >= 5 and (own == label).mean() >= SURE

    def head(self) -> Head:
        for view, rows in zip(self.views, self.rows):
            if view is not None:
                view.calibrate(view.margin(rows.take(np.flatnonzero(self.held))), self.good[self.held])
        return Head(*self.views, self.prior)


def views_of(batch: pa.RecordBatch, known: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[Rows, Rows]:
    """Both views of a batch's rows; of the features only those in known, if given."""
    texts = pc.fill_null(batch["text"].cast(pa.large_string()), "")
    words = Words(texts)
    stats = [text_stats(t, n, d) for t, n, d in zip(texts.to_pylist(), words.count.tolist(), words.distinct.tolist())]
    sizes = batch["n_chars"].to_pylist()
    meta = [np.unique(np.array(meta_keys(*x), np.uint64)) for x in zip(batch["source"].to_pylist(), batch["lang"].to_pylist(), sizes)]
    if known:
        meta = [x[np.isin(x, known[1], assume_unique=True)] for x in meta] if len(known[1]) else [x[:0] for x in meta]
    size = np.array([np.log1p(max(x or 0, 0)) for x in sizes]).reshape(-1, 1)
    single = lambda x: x.astype(np.float32).astype(np.float64)  # as they are written
    return Rows(words.features(known[0] if known else None), single(np.array(stats).reshape(-1, 12))), Rows(meta, single(np.concatenate([size, size**2], axis=1)))


#: Features of a row, packed: h is a hash of the row, a to d are features and numbers of the text and of the metadata.
FEATURES = "doc_id long, h long, a binary, b binary, c binary, d binary"
_COLUMNS = [x.split(" ")[0] for x in FEATURES.split(", ")]


def _features(docs: DataFrame, known: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """FEATURES of each row: hashes of features, or with known the places of those that are in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            text, meta = views_of(batch, known)
            keys = (text.keys, meta.keys)
            if known:
                keys = tuple([np.searchsorted(k, x).astype(np.uint32) for x in y] for k, y in zip(known, keys))
            packed = [[x.tobytes() for x in y] for y in (keys[0], text.dense.astype(np.float32), keys[1], meta.dense.astype(np.float32))]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["h"], *(pa.array(x, pa.binary()) for x in packed)], names=_COLUMNS)

    return docs.withColumn("h", F.xxhash64("text", "source", "lang", "n_chars")).mapInArrow(relieved(run), FEATURES)


def _unpacked(columns: list[list], known: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[Rows, Rows]:
    """Both views of packed columns a, b, c, d."""
    dense = lambda k, n: np.frombuffer(b"".join(columns[k]), np.float32).reshape(-1, n).astype(np.float64)

    def keys(k: int) -> list[np.ndarray]:
        if known is None:
            return [np.frombuffer(x, np.uint64) for x in columns[k]]
        sizes = np.array([len(x) // 4 for x in columns[k]], np.int64)
        return np.split(known[k // 2][np.frombuffer(b"".join(columns[k]), np.uint32)], np.cumsum(sizes)[:-1]) if len(sizes) else []

    return Rows(keys(0), dense(1, 12)), Rows(keys(2), dense(3, 2))


def _seen(docs: DataFrame) -> DataFrame:
    """The columns that the classifier reads; those that docs lacks are null."""
    have = set(docs.columns)
    col = lambda n, kind: (F.col(n) if n in have else F.lit(None)).cast(kind).alias(n)
    return docs.select(col("doc_id", "long"), col("text", "string"), col("source", "string"), col("lang", "string"), col("n_chars", "long"))


def _exchange(table: DataFrame, marked: DataFrame, heads: dict[int, Training], known: tuple[np.ndarray, np.ndarray], pseudo: int) -> None:
    """Lets each view of each head label the unlabelled rows of which it is surest, for the head's other view. A task passes on its own surest alone (OVER times as many as are wanted, as labelled ones go), so what meets is bounded and few columns are joined."""
    spark = table.sparkSession
    slots = [(n, k, label, round(pseudo * (x.base if label else 1 - x.base))) for n, x in sorted(heads.items()) for k in (0, 1) for label in (1.0, 0.0) if x.trusted(k, label)]
    if not slots:
        return
    told = spark.sparkContext.broadcast(({n: x.views for n, x in heads.items()}, known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        views, own = told.value
        held = {s: np.zeros(0, RANKED) for s in range(len(slots))}
        for batch in batches:
            rows = _unpacked([batch[c].to_pylist() for c in "abcd"], own)
            margins: dict[tuple, np.ndarray] = {}
            for s, (n, k, label, most) in enumerate(slots):
                if (n, k) not in margins:
                    margins[n, k] = _odds(views[n][k].margin(rows[k]))
                off = 1 - margins[n, k] if label else margins[n, k]
                at = np.flatnonzero(off <= 1 - SURE)
                new = np.zeros(len(at), RANKED)
                new["off"], new["h"] = off[at], np.asarray(batch["h"])[at]
                new["null"], new["doc_id"] = np.asarray(batch["doc_id"].is_null())[at], np.asarray(pc.fill_null(batch["doc_id"], 0))[at]
                held[s] = np.unique(np.concatenate([held[s], new]))[: OVER * most]  # sorted by off, then by key
        for s, rows in held.items():
            if len(rows):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), s, np.int32)), pa.array(rows["off"].copy()), pa.array(rows["doc_id"].copy(), mask=rows["null"] > 0), pa.array(rows["h"].copy())], names=["slot", "off", "doc_id", "h"])

    sure = table.mapInArrow(relieved(run), "slot int, off double, doc_id long, h long")
    surest = written(sure.join(marked.select("doc_id"), "doc_id", "left_anti"), "surest")
    picked: dict[tuple, list[int]] = {}
    for s, (_, _, _, most) in enumerate(slots):
        for r in surest.where(F.col("slot") == s).orderBy("off", "doc_id", "h").limit(most).collect():
            picked.setdefault((r.doc_id, r.h), []).append(s)
    wanted = spark.createDataFrame([(i, h) for i, h in picked], "_i long, _h long")
    rows = table.join(F.broadcast(wanted), F.col("doc_id").eqNullSafe(F.col("_i")) & (F.col("h") == F.col("_h"))).dropDuplicates(["doc_id", "h"])
    for r in rows.select(*_COLUMNS).toLocalIterator():
        both = _unpacked([[r.a], [r.b], [r.c], [r.d]], known)
        for s in picked.get((r.doc_id, r.h), ()):
            n, k, label, _ = slots[s]
            heads[n].extra[1 - k][(r.doc_id is None, r.doc_id or 0, r.h)] = both[1 - k], label


RANKED = np.dtype([("off", "<f8"), ("null", "<i8"), ("doc_id", "<i8"), ("h", "<i8")])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, pseudo: int = PSEUDO, rounds: int = ROUNDS, features: list | None = None) -> Model:
    """Co-trains on sample labelled rows of docs at most, the least by a hash of doc_id, and on all unlabelled ones.

    labels: doc_id, quality, toxic. Rows without doc_id or quality are no labels, null toxic is 0; of several labels the
    worst counts. Of rows that share a labelled doc_id the least by a hash is the labelled one. Without enough of both
    classes a head is the share of its wanted class. A list given as features gets the written features of all rows.
    """
    seen = _seen(docs)
    marked = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    marked = marked.agg(F.min((F.col("quality") == 1).cast("double")).alias("quality"), F.min((F.coalesce("toxic", F.lit(0)) != 1).cast("double")).alias("clean"))
    order = F.xxhash64(F.lit("sample"), "doc_id")
    chosen = {r.doc_id: r for r in marked.orderBy(order, "doc_id").limit(sample).collect()}
    wanted = docs.sparkSession.createDataFrame([(i,) for i in chosen], "doc_id long")
    one = _features(seen.join(F.broadcast(wanted), "doc_id")).groupBy("doc_id").agg(F.min(F.struct("h", "a", "b", "c", "d")).alias("x"))
    rows = {r.doc_id: r.x for r in one.toLocalIterator()}
    own = [i for i in chosen if i in rows]
    text, meta = _unpacked([[rows[i][c] for i in own] for c in "abcd"])
    heads = [Training(text, meta, np.array([chosen[i][name] for i in own], float)) for name in HEADS]
    able = {n: x for n, x in enumerate(heads) if x.able}
    for x in able.values():
        x.fit(400)
    known = Model(tuple(Head(*x.views, x.prior) for x in heads)).known()
    if able or features is not None:
        table = written(_features(seen, known), "features")
        if features is not None:
            features.append((table, known))
        for _ in range(rounds if able else 0):
            _exchange(table, marked, able, known, pseudo)
            for x in able.values():
                x.fit(80)
    return Model(tuple(x.head() for x in heads))


def _judged(doc_id: pa.Array, rows: tuple[Rows, Rows], model: Model, threshold: float) -> pa.RecordBatch:
    a, b, p = model.scores(*rows)
    return pa.RecordBatch.from_arrays([doc_id, pa.array(a), pa.array(b), pa.array(p), pa.array(p >= threshold)], names=["doc_id", "p_text", "p_meta", "p", "kept"])


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, p_text, p_meta, p, kept of every row of docs. Null and empty texts are scored as such; no rows give no rows."""
    told = docs.sparkSession.sparkContext.broadcast((model, model.known()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            yield _judged(batch["doc_id"], views_of(batch, told.value[1]), told.value[0], threshold)

    return _seen(docs).mapInArrow(relieved(run), SCORES)


def score_features(features: DataFrame, known: tuple[np.ndarray, np.ndarray], model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """What score() returns, from the features that fit() wrote and the features they stand for."""
    told = features.sparkSession.sparkContext.broadcast((model, known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _judged(batch["doc_id"], _unpacked([batch[c].to_pylist() for c in "abcd"], told.value[1]), told.value[0], threshold)

    return features.mapInArrow(relieved(run), SCORES)


def accepted(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all columns, that the model accepts; columns that it reads may be missing or null."""
    told = docs.sparkSession.sparkContext.broadcast((model, model.known()))
    kinds = {"doc_id": pa.int64(), "text": pa.string(), "source": pa.string(), "lang": pa.string(), "n_chars": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            have = set(batch.schema.names)
            seen = {n: batch[n].cast(k) if n in have else pa.nulls(batch.num_rows, k) for n, k in kinds.items()}
            kept = told.value[0].scores(*views_of(pa.RecordBatch.from_pydict(seen), told.value[1]))[2] >= threshold
            yield batch.filter(pa.array(kept))

    return docs.mapInArrow(relieved(run), docs.schema)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, features = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), features=features)
    return score_features(*features[0], model)
