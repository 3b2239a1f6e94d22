import hashlib
import random
from collections import Counter
from dataclasses import replace

import numpy as np
import pytest

from veldspar.llm import automaton_dedup, repeats, suffix_dedup

DOCS = "doc_id long, text string, key string, n int"


def corpus():
    r = random.Random(12)
    words = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 6))) for _ in range(60)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    docs = [(k, text(r.randint(0, 120))) for k in range(40)]
    passage, line = text(50), text(14)
    for k in range(60):  # a passage and a line that many documents share in other surroundings
        docs.append((100 + k, f"{text(r.randint(0, 25))} {passage} {text(r.randint(0, 25))}\n{line}\n{text(20)}"))
    for k in range(20):  # copies and near copies
        own = docs[5][1].split(" ")
        if k % 2:
            own[r.randrange(len(own))] = "changed"
        docs.append((200 + k, " ".join(own)))
    docs += [(300, "a" * 900), (301, "ab " * 400), (302, None), (303, ""), (304, " \n"), (305, text(60)), (305, text(3)), (None, docs[6][1]), (306, docs[7][1]), (306, docs[7][1]), (307, (text(45) + " ") * 3), (308, "x" * 99)]
    return [(*d, "z", 1) for d in docs]


def covered(symbols, counts, length):
    mask = [False] * len(symbols)
    for i in range(len(symbols) - length + 1):
        if counts[tuple(symbols[i : i + length])] > 1:
            mask[i : i + length] = [True] * length
    return mask


def windows(rows, length):
    counts = Counter()
    for symbols in rows:
        counts.update(tuple(symbols[i : i + length]) for i in range(len(symbols) - length + 1))
    return counts


def brute_words(rows, length):
    split = [(t or "").encode().split() for _, t, *_ in rows]
    counts, out = windows(split, length), []
    for (doc_id, *_), words in zip(rows, split):
        mask = covered(words, counts, length)
        kept = b" ".join(w for w, gone in zip(words, mask) if not gone)
        out.append((doc_id, len(words), sum(mask), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def brute_bytes(rows, length):
    split = [(t or "").encode() for _, t, *_ in rows]
    counts, out = windows(split, length), []
    for (doc_id, *_), text in zip(rows, split):
        mask = covered(text, counts, length)
        kept = bytes(b for b, gone in zip(text, mask) if not gone)
        out.append((doc_id, len(text), sum(mask), sum(a and not b for a, b in zip(mask, [False, *mask])), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def few(monkeypatch, module, most):
    shape = module.shape_of
    monkeypatch.setattr(module, "shape_of", lambda length: replace(shape(length), most=most))


@pytest.mark.parametrize(("length", "most"), [(35, 512), (12, 3)])
def test_word_windows_match_brute_force(spark, monkeypatch, length, most):
    few(monkeypatch, automaton_dedup, most)
    rows = corpus()
    got = automaton_dedup.dedup_words(spark.createDataFrame(rows, DOCS), length).collect()
    assert sorted(map(tuple, got), key=repr) == brute_words(rows, length)
    assert sum(r.n_removed for r in got) > 1000


@pytest.mark.parametrize(("length", "most"), [(100, 512), (60, 3)])
def test_byte_strings_match_brute_force(spark, monkeypatch, length, most):
    few(monkeypatch, suffix_dedup, most)
    rows = corpus()
    got = suffix_dedup.dedup_bytes(spark.createDataFrame(rows, DOCS), length).collect()
    assert sorted(map(tuple, got), key=repr) == brute_bytes(rows, length)
    assert sum(r.n_removed for r in got) > 1000


def test_no_rows_and_no_repeats(spark):
    for f in (automaton_dedup.dedup_words, suffix_dedup.dedup_bytes):
        assert f(spark.createDataFrame([], DOCS)).count() == 0
        assert f(spark.createDataFrame([(1, "one two", "", 1)], DOCS), texts=True).collect()[0].n_removed == 0


def test_suffix_family_matches_brute_force():
    r = random.Random(3)
    for _ in range(40):
        segments = [(bytes(r.choice(b"ab") for _ in range(r.randint(0, 30))), r.choice([1, 1, 1, 2])) for _ in range(r.randint(1, 40))]
        counts = Counter()
        for s, n in segments:
            for i in range(len(s) - 7):
                counts[s[i : i + 8]] += n
        for (s, _), flags in zip(segments, suffix_dedup.match(segments, 8)):
            assert flags.tolist() == [int(counts[s[i : i + 8]] > 1) for i in range(len(s) - 7)]


def test_suffix_levels_grow_geometrically():
    family = suffix_dedup.SuffixFamily(4)
    r = random.Random(1)
    for _ in range(64):
        family.add([(r.randbytes(40), 1)])
    sizes = [len(x) for x in family.levels]
    assert len(sizes) < 9 and all(a > 2 * b for a, b in zip(sizes, sizes[1:]))


def test_automaton_statistics_match_brute_force():
    r = random.Random(5)
    for _ in range(60):
        texts = [([r.choice("abc") for _ in range(r.randint(0, 14))], r.randint(1, 2)) for _ in range(r.randint(1, 6))]
        automaton = automaton_dedup.SuffixAutomaton()
        counts = Counter()
        for words, n in texts:
            automaton.add(words, n)
            for i in range(len(words)):
                for j in range(i + 1, len(words) + 1):
                    counts["".join(words[i:j])] += n
        doc = "".join(r.choice("abcd") for _ in range(20))
        for times in (1, 2, 3):
            want = [max((n for n in range(1, e + 1) if counts[doc[e - n : e]] >= times), default=0) for e in range(1, len(doc) + 1)]
            assert automaton.statistics(doc, times) == want


def test_remove_reference(spark):
    ref = spark.createDataFrame([("a b c d e f",), ("p q r s",), (None,)], "text string")
    docs = spark.createDataFrame([(1, "x a b c d y"), (2, "q r s t p q"), (3, None), (4, "d e f p q r")], "doc_id long, text string")
    got = {r.doc_id: r.kept for r in automaton_dedup.remove_reference(docs, ref, 3, shard_words=5).collect()}
    assert got == {1: "x y", 2: "t p q", 3: "", 4: ""}
    assert {r.n_removed for r in automaton_dedup.remove_reference(docs, ref.limit(0), 3).collect()} == {0}


def test_sliding_minimum():
    x = np.random.default_rng(0).integers(0, 1000, 200).astype(np.uint64)
    for w in (1, 2, 3, 7, 8, 20):
        assert repeats.least_of(x, w).tolist() == [min(x[i : i + w]) for i in range(200 - w + 1)]
