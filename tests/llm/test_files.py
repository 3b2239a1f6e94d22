import hashlib
import random
import zlib

import numpy as np
import pytest

from veldspar.llm import token_files, warc
from veldspar.llm.common import work_path
from veldspar.llm.files import store


def test_warc_round_trip(spark):
    big = "<p>é" * 60
    rows = [(5, "http://a/ b\r\nX: y", big, 1), (3, None, big, 1), (9, "u", big, 1), (3, None, big, 1), (1, "u", "short", 1), (2, "u", "short", 1), (4, "u", None, 1), (6, "u", "", 1), (None, "u", big, 1), (None, "u", "only" * 50, 1), (7, "u", "z" * 300_000, 1), (8, "u", "\r\n\r\n" * 40, 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, payload int")
    folder = work_path(spark, "warc")
    manifest = warc.write_warc(df, folder, roll_bytes=400).collect()
    got = warc.read_warc(spark, folder, payloads=True).collect()
    want = []
    for page, _, html, _ in rows:
        data = (html or "").encode()
        same = [p for p, _, h, _ in rows if (h or "").encode() == data and p is not None]
        first = min(same, default=None) if len(data) >= 100 else None
        revisit = first is not None and page != first
        want.append((page, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first if revisit else None, None if revisit else data))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in got), key=repr) == sorted(want, key=repr)
    assert len(manifest) > 4 and sum(m.records for m in manifest) == len(rows)
    own, root = store(folder)
    names = {f.base_name: f for f in own.get_file_info(__import__("pyarrow").fs.FileSelector(root)) if f.is_file}
    assert {m.file for m in manifest} == set(names)
    for m in manifest:
        with own.open_input_file(f"{root}/{m.file}") as f:
            data = f.read()
        assert len(data) == m.bytes and hashlib.sha256(data).hexdigest() == m.sha256
    again = work_path(spark, "warc")
    assert sorted((m.file, m.sha256) for m in warc.write_warc(df, again, roll_bytes=400).collect()) == sorted((m.file, m.sha256) for m in manifest)


def test_warc_empty(spark):
    folder = work_path(spark, "warc")
    assert warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), folder).count() == 0
    assert warc.read_warc(spark, folder).count() == 0


@pytest.mark.parametrize("width", [2, 4])
def test_repair_round_trip(width):
    r = random.Random(7)
    base = 50 if width == 2 else 70_000
    docs = [[r.randrange(5) for _ in range(r.randint(1, 400))] for _ in range(60)] + [[1], [1] * 1000, [base - 1]]
    kind = "<u2" if width == 2 else "<u4"
    data, n = token_files.pack([None, *range(1, len(docs))], [np.array(d, kind).tobytes() for d in docs], width, base)
    assert n == sum(map(len, docs)) and len(data) < n * width
    file = token_files.TokenFile(data)
    assert file.doc_ids[0] is None and file.doc_ids[5] == 5
    assert [x.tolist() for x in file.all_ids()] == docs
    for k in range(0, len(docs), 7):
        assert file.ids(k).tolist() == docs[k]
        for j in range(0, len(docs[k]), 13):
            assert file.id_at(k, j) == docs[k][j]
    with pytest.raises(ValueError):
        token_files.TokenFile(data[:-9] + b"x" + data[-8:])


def test_repair_goes_on_until_no_pair_is_frequent():
    r = np.random.default_rng(3)
    ids = np.concatenate([np.tile(r.integers(0, 9, 40), 60), r.integers(0, 9, 3000), np.zeros(500, int)])
    ends = np.sort(r.choice(np.arange(1, len(ids)), 70, replace=False))
    ends[-1] = len(ids)
    seq, places, rules = token_files.repair(ids, ends, 10, 1 << 16)
    assert token_files.expand(seq, rules, 10).tolist() == ids.tolist()
    counts: dict = {}
    for a, b in zip([0, *places[:-1].tolist()], places.tolist()):
        own, k = seq[a:b].tolist(), 0
        while k + 1 < len(own):
            pair = (own[k], own[k + 1])
            counts[pair] = counts.get(pair, 0) + 1
            k += 2 if k + 2 < len(own) and own[k] == own[k + 1] == own[k + 2] else 1
    assert max(counts.values()) < 2 * token_files.LEAST and sum(c >= token_files.LEAST for c in counts.values()) <= 1


def test_token_files(spark):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    r = random.Random(9)
    parts = ["The", "ΟΔΟΣ", "é", "É", "İ", "日本", "12", "'s", "can't", "!!", "<|endoftext|>", "\x1c", "\xa0", " ", "\t", "\n", "  ", " ", "ß", "x́", "😀", "\x85", "\x0b", " ́"]
    rows = [(k, "".join(r.choice(parts) for _ in range(r.randint(0, 30))), 1) for k in r.sample(range(1000), 300)]
    rows += [(5000, None, 1), (5001, "", 1), (5001, "", 1), (None, "null id", 1), (5002, "word " * 40000, 1)]
    folder = work_path(spark, "tokens")
    manifest = token_files.write_tokens(spark.createDataFrame(rows, "doc_id long, text string, start int"), path, folder, file_ids=700)
    assert manifest.count() > 3
    got = token_files.read_tokens(spark, folder, ids=True).orderBy("start").collect()
    start = 0
    for r_, (doc_id, text, _) in zip(got, sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")), strict=True):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        assert (r_.doc_id, r_.start, r_.n_tokens, r_.input_ids) == (doc_id, start, len(ids), ids), repr(text)
        assert r_.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    folder = work_path(spark, "tokens")
    assert token_files.write_tokens(spark.createDataFrame([], "doc_id long, text string"), path, folder).count() == 0
    assert token_files.read_tokens(spark, folder).count() == 0


def test_words_agree_with_the_library():
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    encoder = token_files.Encoder(open(path, encoding="utf-8").read())
    assert encoder.plain
    r = random.Random(4)
    letters = "aeiTHs't'llr'vE0129.,!$%-_<|>~ \n\x7f\x01éÉßŒſİĳ²½\xaa\xb5\xa0ΣǅǱ日"
    for _ in range(5000):
        word = "".join(r.choice(letters) for _ in range(r.randint(1, 12)))
        want = library.encode(word, add_special_tokens=False).ids
        assert np.frombuffer(encoder.encode(word), "<u2").tolist() == want, repr(word)
