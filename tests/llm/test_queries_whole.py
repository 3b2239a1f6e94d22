"""The registered queries themselves, with their production parameters, on the smallest tables: against SQL, the libraries, or brute force."""

import hashlib
import os
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash

from veldspar.llm import entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
sha = lambda b: hashlib.sha256(b).hexdigest()


def documents():
    t = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"])
    return [(i, x or "") for i, x in zip(t["doc_id"].to_pylist(), t["text"].to_pylist())]


def run(spark, name):
    return entry.queries()[name](spark, SF)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    df = run(spark, name)
    cols = sorted(df.columns)
    want = con.execute(entry.oracle_sql()[name])
    at = {d[0]: k for k, d in enumerate(want.description)}
    assert sorted(at) == cols
    assert sorted(tuple(r[c] for c in cols) for r in df.collect()) == sorted(tuple(r[at[c]] for c in cols) for r in want.fetchall())


def kept_symbols(symbols, length, seen):
    gone = np.zeros(len(symbols), bool)
    for k in range(len(symbols) - length + 1):
        if seen[symbols[k : k + length]] > 1:
            gone[k : k + length] = True
    return gone


def test_op2_by_brute_force(spark):
    docs = [(i, t.encode()) for i, t in documents()]
    seen = Counter(b[k : k + 400] for _, b in docs for k in range(len(b) - 399))
    want = {}
    for i, b in docs:
        gone = kept_symbols(b, 400, seen)
        edges = np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(int)])) == 1)
        want[i] = (len(b), int(gone.sum()), edges, sha(np.frombuffer(b, np.uint8)[~gone].tobytes()))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in run(spark, "op2_suffix_dedup").collect()}
    assert got == want and sum(x[1] for x in want.values()) > 0


def test_op8_by_brute_force(spark):
    docs = [(i, tuple(re.findall(r"[^\x20\x09-\x0D]+", t))) for i, t in documents()]
    seen = Counter(w[k : k + 35] for _, w in docs for k in range(len(w) - 34))
    want = {}
    for i, words in docs:
        gone = kept_symbols(words, 35, seen)
        want[i] = (len(words), int(gone.sum()), sha(" ".join(w for w, g in zip(words, gone) if not g).encode()))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in run(spark, "op8_automaton_dedup").collect()}
    assert got == want and sum(x[1] for x in want.values()) > 0


def test_op5_and_op9_as_the_library(spark):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    five, nine = (Tokenizer.from_file(P.path(f)) for f in ("byte_bpe_50k.json", "word_bpe_49k.json"))
    got5 = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in run(spark, "op5_bpe_automaton").collect()}
    got9 = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in run(spark, "op9_token_files").collect()}
    want5, want9, start = {}, {}, 0
    for i, t in sorted(documents()):
        ids = five.encode(t, add_special_tokens=False).ids
        want5[i] = (len(ids), sha(",".join(map(str, ids)).encode()), sha(five.decode(ids, skip_special_tokens=False).encode()))
        ids = [*nine.encode(t, add_special_tokens=False).ids, 1]
        want9[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert got5 == want5 and got9 == want9


def test_op6_by_brute_force(spark):
    def fingerprint(text):
        words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode()))
        if not words:
            return 0
        shingles = [b" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
        h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    docs = [(i, fingerprint(t)) for i, t in documents()]
    part = {i: i for i, _ in docs}
    moved = True
    while moved:
        moved = False
        for i, x in docs:
            for j, y in docs:
                if (x ^ y).bit_count() <= 4 and part[i] != part[j]:
                    part[i] = part[j] = min(part[i], part[j])
                    moved = True
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in run(spark, "op6_simhash").collect()}
    assert got == {i: (f"{x:016x}", part[i]) for i, x in docs}


def test_op1_rejects_junk_and_toxic_rows_of_the_labels(spark):
    labels = pq.read_table(f"{SF}/labels.parquet").to_pylist()
    got = {r.doc_id: r.kept for r in run(spark, "op1_quality").collect()}
    assert len(got) == len(documents())
    clean = [got[x["doc_id"]] for x in labels if x["quality"] == 1 and not x["toxic"]]
    junk = [got[x["doc_id"]] for x in labels if x["quality"] == 0]
    assert np.mean(clean) > 0.95 and np.mean(junk) < 0.2  # so few rows that this checks the query, not the classifier


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no larger tables here")
def test_held_out_recall_on_the_labels(spark):
    from pyspark.sql import functions as F

    from veldspar.llm import cotraining

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = cotraining.fit(docs, labels.where("doc_id % 2 = 0"))
    told = cotraining.score(docs, model).join(labels.where("doc_id % 2 = 1"), "doc_id")
    got = {(r.quality, r.toxic): r.kept for r in told.groupBy("quality", "toxic").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert got[1, 0] >= 0.98 and got[0, 0] <= 0.1 and got[1, 1] <= 0.1
