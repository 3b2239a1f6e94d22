import corpus_pipeline

DOCS = "doc_id long, text string, lang string"
LONG = " ".join(f"w{k}" for k in range(40))
NEAR = LONG + " more"


def left(stage, spark, rows):
    got = stage(spark, spark.createDataFrame(rows, DOCS).repartition(2), "")
    assert got.columns == ["doc_id", "text", "lang"]
    return sorted(map(tuple, got.collect()), key=repr)


def test_null_and_repeated_ids_are_decided_row_by_row(spark):
    for stage, copy in ((corpus_pipeline.exact_duplicates, LONG), (corpus_pipeline.near_duplicates, NEAR)):
        first, other, third = (1, LONG, "a"), (None, "quite another text of no one", "b"), (None, "a third text without any copy", None)
        keep = [first, other, third, (7, "its id is on a copy too", "c")]
        assert left(stage, spark, [*keep, (None, copy, "d"), (7, copy, "e")]) == sorted(keep, key=repr)


def test_equal_rows_and_null_ids_alone_leave_one_row(spark):
    for stage, copy in ((corpus_pipeline.exact_duplicates, LONG), (corpus_pipeline.near_duplicates, NEAR)):
        for key in (None, 3):
            rows = [(key, LONG, "a")] * 3 + [(key, copy, "a")] * 2 + [(key, "quite another text of no one", "b")]
            got = left(stage, spark, rows)
            assert len(got) == 2 and any(text in (LONG, copy) for _, text, _ in got)
            assert (key, "quite another text of no one", "b") in got


def test_columns_with_the_names_of_helpers(spark):
    names = ["doc_id", "text", "row_key", "ROW_KEY_", "row", "node", "component", "kept", "digest", "_gone"]
    rows = [(1, LONG, *range(8)), (2, LONG, *range(8)), (3, NEAR, *range(8)), (5, "only here", *range(8))]
    docs = spark.createDataFrame(rows, names)
    for stage, want in ((corpus_pipeline.exact_duplicates, [1, 3, 5]), (corpus_pipeline.near_duplicates, [1, 5])):
        got = stage(spark, docs, "")
        assert got.columns == names and sorted(r.doc_id for r in got.collect()) == want


def test_a_copy_with_the_id_of_a_unique_row(spark):
    rows = [(3, "y y y", "a"), (5, "y y y", "b"), (5, "only here and nowhere else", "c")]
    assert left(corpus_pipeline.exact_duplicates, spark, rows) == sorted([rows[0], rows[2]], key=repr)
