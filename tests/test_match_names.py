"""The nearest entries of queries: by brute force on odd rows, and without a comparison for each entry of a name."""

import random

from pyspark.sql import functions as F

from veldspar.operators import similarity as sm


def _distance(a, b):
    return F.levenshtein(F.array_join(a, ""), F.array_join(b, "")).cast("double")


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def test_entries_of_several_names_and_priors(spark):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abc") for _ in range(rnd.choice([0, 1, 2, 3, 4, 5])))
    names = [(rnd.choice([None, *range(60)]), rnd.choice([None, 0.1, 0.5, 0.5, 0.5, 0.9]), list(word())) for _ in range(150)]
    names += [(k, 0.5, list(w)) for k in range(60, 90) for w in rnd.sample(["ab", "abc", "c"], rnd.choice([1, 2]))]
    names += [(200, 0.2, None), (201, None, list("abca")), (202, None, list("abca")), (203, 0.0, list("abca"))]
    queries = [(1, list("abc")), (2, list("cc")), (3, []), (4, list("abcabc")), (4, list("ba")), (5, None), (None, list("a")), (6, list("zzzz"))]
    got = sm.match_names(spark.createDataFrame(queries, "query_id int, syllables array<string>"), spark.createDataFrame(names, "adcode int, prior double, syllables array<string>"), _distance, 4, 0.55)
    assert got.columns == ["query_id", "adcode", "dist", "rank"]
    near: dict = {}
    for q, x in queries:
        for a, p, y in names:
            if x and y and (d := _edits(x, y) / max(len(x), len(y))) <= 0.55:
                near.setdefault(q, {}).setdefault(a, []).append((d, p))
    want = []
    for q, entries in near.items():
        best = [(min(d for d, _ in own), max((p for _, p in own if p is not None), default=None), a) for a, own in entries.items()]
        best.sort(key=lambda b: (b[0], b[1] is None, -(b[1] or 0.0), b[2] is not None, b[2] or 0))
        want += [(q, a, d, k + 1) for k, (d, _, a) in enumerate(best[:4])]
    order = lambda rows: sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[3]))
    assert order(map(tuple, got.collect())) == order(want)


def test_names_are_compared_once_not_once_an_entry(spark):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(a, b):
        calls.add(1)
        return float(sum(x != y for x, y in zip(a, b)))

    queries = spark.createDataFrame([(k, list(w)) for k, w in enumerate(["abc", "abd", "xyz"])], "query_id int, syllables array<string>")
    names = spark.range(3000).select(F.col("id").alias("adcode"), (F.col("id") % 7 / 7).alias("prior"), F.array(F.lit("a"), F.lit("b"), (F.col("id") % 10).cast("string")).alias("syllables"))
    got = sm.match_names(queries, names, counted, 3, 0.55).collect()
    assert {(r.query_id, r.adcode, r["rank"]) for r in got} == {(q, a, k + 1) for q in (0, 1) for k, a in enumerate((6, 13, 20))}
    assert 0 < calls.value <= 200  # three queries against ten names, by each place of the plan that names the distance; entries are 3000
