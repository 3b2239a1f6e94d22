import random
import re

import corpus_pipeline
from veldspar.llm import simhash

DOCS = "doc_id long, text string"


def plain_shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def brute_force(rows):
    """The rows left of (doc_id, text): the first by doc_id, nulls last, of each component of similar pairs."""
    sets = [plain_shingles(t) for _, t in rows]
    part = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if part[i] != part[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                old, new = part[i], part[j]
                part = [new if p == old else p for p in part]
    groups = {}
    for p, row in zip(part, rows):
        groups.setdefault(p, []).append(row)
    return sorted((min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()), key=repr)


def near_corpus():
    r = random.Random(12)
    words = [f"w{k}" for k in range(500)]
    out = []
    for k in range(60):
        own = [r.choice(words) for _ in range(r.randint(8, 200))]
        out.append((1000 + k, " ".join(own)))
        for c in range(3):  # one to a few changed words: similarities on both sides of 0.8
            w = list(own)
            for _ in range(1 + r.randrange(1 + len(own) // 40)):
                w[r.randrange(len(w))] = r.choice(words)
            out.append((10 * k + c, " ".join(w)))
    own = [r.choice(words) for _ in range(120)]  # one large group, whose copies differ from each other more than from the first
    for k in range(150):
        w = list(own)
        for _ in range(r.randint(1, 3)):
            w[r.randrange(120)] = r.choice(words)
        out.append((5000 - k, " ".join(w)))
    return out + [(7000, "one two three"), (7001, "One  two\nthree"), (7002, "one two"), (7003, None), (7004, ""), (7005, " \t")]


def test_near_stage_matches_brute_force(spark):
    rows = near_corpus()
    got = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, DOCS).repartition(3), "")
    assert got.columns == ["doc_id", "text"]
    want = brute_force(rows)
    assert sorted(map(tuple, got.collect()), key=repr) == want
    assert 60 < len(want) < len(rows) - 100


def test_chains_across_a_tile_are_found(spark, monkeypatch):
    # All rows within reach: rows that aren't similar to their first partner must still meet the others.
    monkeypatch.setattr(simhash, "REACH", 128)
    monkeypatch.setattr(simhash, "FULL", 256)
    rows = [x for x in near_corpus() if x[0] < 300 or x[0] > 4960]
    got = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, DOCS), "")
    assert sorted(map(tuple, got.collect()), key=repr) == brute_force(rows)


def test_several_tiles_to_a_class(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE_ROWS", 7)
    monkeypatch.setattr(simhash, "TILE_BYTES", 20_000)
    rows = near_corpus()
    got = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, DOCS).repartition(5), "")
    assert sorted(map(tuple, got.collect()), key=repr) == brute_force(rows)
