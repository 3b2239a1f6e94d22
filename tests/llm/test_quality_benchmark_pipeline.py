import hashlib
import random

import numpy as np
import pytest

import corpus_pipeline
from veldspar.llm import cotraining, decontaminate, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(n=900, seed=4):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(400)]
    docs, labels = [], []
    for k in range(n):
        kind = k % 6
        own = [r.choice(words) for _ in range(r.randint(30, 150))]
        if kind == 0:
            own = [w + r.choice(["%%%", "***"]) for w in own]
        if kind == 1:
            for _ in range(6):
                own[r.randrange(len(own))] = r.choice(["vile", "rotten"])
        text = " ".join(own)
        docs.append((k, text, r.choice(["en", "fr"]), f"src{k % 7}", len(text)))
        if k % 2 or kind < 2:
            labels.append((k, int(kind != 0), int(kind == 1)))
    return docs, labels


def test_cotraining_finds_held_out_classes(spark):
    docs, labels = corpus()
    hidden = [x for x in labels if x[0] % 5 == 0]
    df = spark.createDataFrame(docs, DOCS)
    told = spark.createDataFrame([x for x in labels if x[0] % 5], "doc_id long, quality int, toxic int")
    model = cotraining.fit(df, told)
    got = {r.doc_id: r for r in cotraining.score(df, model).collect()}
    assert len(got) == len(docs)
    for k, quality, toxic in hidden:
        assert got[k].kept == bool(quality and not toxic)
    kept = cotraining.accepted(df, model)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {k for k, r in got.items() if r.kept}


def test_cotraining_odd_rows(spark):
    docs, labels = corpus(200)
    model = cotraining.fit(spark.createDataFrame(docs, DOCS), spark.createDataFrame([*labels, (None, 1, 0), (3, None, 0), (10**9, 1, None)], "doc_id long, quality int, toxic int"))
    odd = spark.createDataFrame([(1, None, None, None, None), (None, "", "", "", -5), (1, "x " * 50000, "en", "s", 100000), (1, "x " * 50000, "en", "s", 100000)], DOCS)
    assert odd.count() == cotraining.score(odd, model).where("p between 0 and 1").count()
    assert cotraining.score(odd.limit(0), model).count() == 0
    none = cotraining.fit(odd, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert cotraining.score(odd, none).where("p = 0.5 and kept").count() == 4
    bare = spark.createDataFrame([(1, "hello")], "doc_id long, text string")
    assert cotraining.score(bare, model).count() == 1


def test_calibration_is_a_share():
    r = np.random.default_rng(1)
    z = r.normal(size=4000)
    good = (r.random(4000) < 1 / (1 + np.exp(-(2 * z - 1)))).astype(float)
    view = cotraining.View()
    view.calibrate(z, good)
    assert abs(view.slope - 2) < 0.2 and abs(view.shift + 1) < 0.2


def greedy(doc, item, least):
    """Greedy string tiling by the definition."""
    used_d, used_i, total = set(), set(), 0
    while True:
        best = []
        for d in range(len(doc)):
            for i in range(len(item)):
                n = 0
                while d + n < len(doc) and i + n < len(item) and doc[d + n] == item[i + n] and d + n not in used_d and i + n not in used_i:
                    n += 1
                best.append((n, d, i))
        top = max((b[0] for b in best), default=0)
        if top < least:
            return total
        for n, d, i in best:
            if n == top and not any(d + k in used_d or i + k in used_i for k in range(n)):
                used_d.update(range(d, d + n))
                used_i.update(range(i, i + n))
                total += n


def test_tiles_match_the_definition():
    r = random.Random(8)
    for _ in range(150):
        item = [r.randrange(12) for _ in range(r.randint(3, 25))]
        doc = [r.randrange(-1, 12) for _ in range(r.randint(0, 20))]
        for _ in range(r.randint(0, 3)):
            a = r.randrange(len(item))
            doc[r.randrange(len(doc) + 1) : 0] = item[a : a + r.randint(2, 9)]
        found = decontaminate.tiles(np.array(doc, np.int64), np.array(item, np.int64), 3)
        for d, i, n in found:
            assert n >= 3 and doc[d : d + n] == item[i : i + n]
        assert len({d + k for d, _, n in found for k in range(n)}) == len({i + k for _, i, n in found for k in range(n)}) == sum(n for *_, n in found)
        want = greedy([x if x >= 0 else -2 - k for k, x in enumerate(doc)], item, 3)
        assert sum(n for *_, n in found) == want


def test_contaminated_catches_copies_and_reordered_passages(spark, monkeypatch):
    r = random.Random(6)
    words = [f"w{k}" for k in range(300)]
    items = [" ".join(r.choice(words) for _ in range(30)) for _ in range(10)] + ["tiny item here"]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    docs = [(k, text(100)) for k in range(20)]
    docs.append((100, text(20) + " " + items[0].upper() + "\n" + text(50)))
    own = items[1].split()
    docs.append((101, " ".join([*own[15:], "x", *own[:15]])))
    docs.append((102, " ".join(items[2].split()[:20])))  # two thirds: not enough
    docs += [(103, "a tiny item\nhere"), (104, None), (105, ""), (None, items[3]), (106, "w1 " * 40000), (107, items[4]), (107, items[4])]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([*enumerate(items), (50, None), (51, " "), (4, items[4])], "item_id long, text string")
    got = decontaminate.contaminated(df, bench).collect()
    assert sorted(((r.doc_id, r.item_id) for r in got), key=repr) == sorted([(100, 0), (101, 1), (103, 10), (None, 3), (107, 4), (107, 4)], key=repr)
    kept = decontaminate.clean(df, bench)
    assert kept.columns == df.columns and kept.count() == len(docs) - 6
    assert decontaminate.contaminated(df, bench.limit(0)).count() == 0 and decontaminate.contaminated(df.limit(0), bench).count() == 0
    small = [b for b in decontaminate.blocks(bench, limit=200)]
    assert len(small) > 1 and sum(map(len, small)) == len(items)
    whole = sorted(map(tuple, decontaminate.contaminated(df, bench).collect()), key=repr)
    monkeypatch.setattr(decontaminate.blocks, "__defaults__", (200,))
    assert sorted(map(tuple, decontaminate.contaminated(df, bench).collect()), key=repr) == whole
    assert sorted(map(tuple, decontaminate.clean(df, bench).collect()), key=repr) == sorted(map(tuple, kept.collect()), key=repr)


def test_pipeline_matches_its_parts_by_brute_force(spark, tmp_path):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    docs, labels = corpus(300, seed=9)
    clean = [d for d in docs if d[0] % 6 > 1]
    a, b, c = clean[0], clean[1], clean[2]
    docs += [(1000, a[1].replace(" ", "  ", 3), *a[2:]), (1001, b[1], *b[2:]), (1002, c[1] + " " + c[1].split()[0], *c[2:])]
    bench = [(0, " ".join(clean[5][1].split()[:25])), (1, "never seen at all in any text")]
    spark.createDataFrame(docs, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = cotraining.fit(df, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    good = {r.doc_id for r in cotraining.score(df, model).where("kept").collect()}
    rows = sorted(d for d in docs if d[0] in good)
    seen, first = set(), []
    for d in rows:
        key = " ".join(d[1].split(" ")) if "  " not in d[1] else d[1].replace("  ", " ")
        if key not in seen:
            seen.add(key)
            first.append(d)
    fps = {d[0]: simhash.fingerprint(d[1].encode()) for d in first}
    part = {i: i for i in fps}
    for _ in range(5):
        for i in fps:
            for j in fps:
                if (fps[i] ^ fps[j]).bit_count() <= 4:
                    part[i] = part[j] = min(part[i], part[j])
    left = [d for d in first if part[d[0]] == d[0]]
    left = [d for d in left if bench[0][1] not in d[1]]
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = {d[0]: hashlib.sha256(",".join(map(str, library.encode(d[1], add_special_tokens=False).ids)).encode()).hexdigest() for d in left}
    got = {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == want
    assert 1001 not in got and 1000 not in got and clean[5][0] not in got and len(got) > 150
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, df, str(tmp_path)).columns == df.columns


def test_stages_take_empty_tables(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    df = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, df, str(tmp_path)).count() == 0
