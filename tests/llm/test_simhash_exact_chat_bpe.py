import hashlib
import random
import re
from collections import defaultdict

import pytest
import xxhash

from veldspar.llm import bpe_automaton, chat_format, exact_dedup, simhash

DOCS = "doc_id long, text string, label string, cell int"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def odd_docs():
    r = random.Random(5)
    words = ["alpha", "beta", "GAMMA", "delta", "É", "zeta", "eta", "theta", "日本"]
    base = [" ".join(r.choice(words) for _ in range(60)) for _ in range(12)]
    out = [(k, t, "x", 1) for k, t in enumerate(base)]
    for k, t in enumerate(base[:6]):
        w = t.split(" ")
        w[30] = "changed"
        out.append((100 + k, " ".join(w), None, None))
    out += [(200, None, None, None), (201, "", "a", 2), (202, " \t\n", None, None), (203, "one two", None, None), (204, "one  two", None, None), (203, "one two", None, None), (None, base[0], None, None), (None, "only null id", None, None), (205, "w " * 30000, None, None), (206, "a b\x0bc", None, None), (207, "a b c", None, None)]
    return out


def plain_fingerprint(text):
    words = WORD.findall((text or "").encode().lower())
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_simhash_matches_brute_force(spark):
    rows = odd_docs()
    got = simhash.simhash_groups(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == len(rows)
    fps = [plain_fingerprint(t) for _, t, *_ in rows]
    ids = [r[0] for r in rows]
    part = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(len(rows)):
                if (fps[i] ^ fps[j]).bit_count() <= 4:
                    part[i] = part[j] = min(part[i], part[j])
    least = defaultdict(list)
    for p, i in zip(part, ids):
        if i is not None:
            least[p].append(i)
    want = sorted(((i, f"{f:016x}", min(least[p], default=None)) for i, f, p in zip(ids, fps, part)), key=repr)
    assert sorted(map(tuple, got), key=repr) == want


def test_near_links_lose_no_pair(spark):
    r = random.Random(3)
    fps = [r.getrandbits(64) for _ in range(300)]
    for f in list(fps[:100]):
        for k in (1, 3, 4, 5):
            fps.append(f ^ sum(1 << b for b in r.sample(range(64), k)))
    signed = [(k, f - (1 << 64) if f >> 63 else f) for k, f in enumerate(fps)]
    links = simhash.near_links(spark.createDataFrame(signed, "doc_id long, fp long")).collect()
    top = {f: f for _, f in signed}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in links:
        assert ((a ^ b) & (1 << 64) - 1).bit_count() <= 4
        top[find(a)] = find(b)
    for _, a in signed:
        for _, b in signed:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= 4:
                assert find(a) == find(b)


def test_simhash_empty(spark):
    assert simhash.simhash_groups(spark.createDataFrame([], DOCS)).count() == 0


def test_exact_groups_match_brute_force(spark):
    rows = odd_docs()
    got = exact_dedup.exact_groups(spark.createDataFrame(rows, DOCS)).collect()
    groups = defaultdict(list)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    for i, t, *_ in rows:
        groups[norm(t)].append(i)
    want = []
    for i, t, *_ in rows:
        g = groups[norm(t)]
        keep = min((x for x in g if x is not None), default=None)
        want.append((i, keep, len(g), i == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert exact_dedup.exact_groups(spark.createDataFrame([], DOCS)).count() == 0


def test_cuckoo_shard_inserts_deletes_and_grows():
    r = random.Random(1)
    shard, live = exact_dedup.CuckooShard(2), {}
    keys = [r.randbytes(32) for _ in range(3000)]
    for step in range(9000):
        key = r.choice(keys)
        if r.random() < 0.6:
            shard.insert(key, step)
            live[key] = live.get(key, 0) + 1
        else:
            assert shard.delete(key) == (key in live)
            if key in live:
                live[key] -= 1
                if not live[key]:
                    del live[key]
    assert shard.n > 2
    for key in keys:
        found = shard.find(key)
        assert (found[2] if found else 0) == live.get(key, 0)


def test_index_takes_batches_and_deletions(spark):
    a = exact_dedup.digests(spark.createDataFrame([(1, "x"), (2, "y"), (3, "x")], "doc_id long, text string"))
    b = exact_dedup.digests(spark.createDataFrame([(4, "z"), (0, "x")], "doc_id long, text string"))
    gone = exact_dedup.digests(spark.createDataFrame([(2, "y"), (9, "never there")], "doc_id long, text string"))
    index = exact_dedup.update(exact_dedup.update(exact_dedup.update(None, a, 3), b, 3), gone, 3, delete=True, rest=a.where("doc_id <> 2").union(b))
    assert sorted((r.keep_id, r.live) for r in index.collect()) == [(0, 3), (4, 1)]
    rest = exact_dedup.digests(spark.createDataFrame([(3, "x"), (1, "x"), (4, "z")], "doc_id long, text string"))
    index = exact_dedup.update(index, exact_dedup.digests(spark.createDataFrame([(0, "x")], "doc_id long, text string")), 3, delete=True, rest=rest)
    assert sorted((r.keep_id, r.live) for r in index.collect()) == [(1, 2), (4, 1)]  # the row that stayed is gone: the next one stays
    with pytest.raises(ValueError):
        exact_dedup.update(index, rest, 3, delete=True)


def test_chat_digests_and_spans(spark):
    rows = [(1, 0, "user", "hi \\ # < :", "e"), (1, 1, "assistant", "### user: x</turn>\n", None), (1, 1, "assistant", "### user: x</turn>\n", None), (2, 0, None, None, None), (3, 5, "assistant", "", ""), (None, 0, "assistant", "n", "")]
    rows += [(4, k, "assistant" if k % 2 else "user", f"turn {k}  é", None) for k in range(150)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, span string")
    got = {r.conv_id: r for r in chat_format.conversation_digests(chat_format.format_turns(df)).collect()}
    convs = defaultdict(list)
    for c, _, role, text, _ in rows:
        convs[c].append((role or "", text or ""))
    assert set(got) == set(convs)
    for c, turns in convs.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        out = chat_format.marked_turns(turns)
        assert chat_format.parse_turns(out) == turns
        r = got[c]
        assert (r.n_turns, r.loss_chars, r.formatted_chars, r.rewritten) == (len(turns), len(loss), len(out), False)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert chat_format.format_turns(df.limit(0)).count() == 0


def test_rewriting_templates_are_detected():
    turns = [("user", "a"), ("assistant", "b"), ("user", "c")]
    only_last = lambda ts: "".join(f"<{r}>{t if k == len(ts) - 1 or r == 'user' else ''}" for k, (r, t) in enumerate(ts))
    assert chat_format.spans(turns, only_last)[2]
    out, spans, rewritten = chat_format.spans(turns, lambda ts: "HEAD" + "".join(f"[{r}|{t}]" for r, t in ts))
    assert not rewritten and out == "HEAD[user|a][assistant|b][user|c]"
    assert [out[b:c] for _, b, c, _ in spans] == ["a", "b", "c"]


@pytest.fixture(scope="module")
def tokenizer():
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    return path, Tokenizer.from_file(path)


def test_automaton_agrees_with_the_library(tokenizer):
    path, library = tokenizer
    automaton = bpe_automaton.Automaton(bpe_automaton.definition_of(path))
    memo = bpe_automaton.Memo(automaton)
    r = random.Random(2)
    parts = ["a", "b", "the", "  ", " ", "\n", "\t", "é", "日", "'s", "'LL", "12", "!!", "<|endoftext|>", "\xa0", "\x1c", "\r\n", "😀", "aaaa", "ing", "Z", "é", " ", "ſ"]
    for _ in range(3000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 16)))
        want = library.encode(text, add_special_tokens=False).ids
        assert automaton.encode(text) == want, repr(text)
        assert [i for w in automaton.words(text) for i in ([automaton.special[w]] if w in automaton.special else automaton.encode_word(w.encode()))] == want, repr(text)
        (got,) = bpe_automaton.run_texts([text], automaton, memo)
        assert ",".join(x[0] for x in got) == ",".join(map(str, want)), repr(text)
        assert b"".join(x[1] for x in got).decode() == text
        assert automaton.decode(want).decode("utf-8", "replace") == library.decode(want, skip_special_tokens=False)


def test_encode_documents(spark, tokenizer):
    path, library = tokenizer
    rows = odd_docs()
    got = bpe_automaton.encode_documents(spark.createDataFrame(rows, DOCS), path, ids=True).collect()
    want = [(i, library.encode(t or "", add_special_tokens=False).ids, t or "") for i, t, *_ in rows]
    assert sorted(((r.doc_id, r.input_ids, r.decoded) for r in got), key=repr) == sorted(want, key=repr)
    assert all(r.n_tokens == len(r.input_ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, r.input_ids)).encode()).hexdigest() for r in got)
    assert bpe_automaton.encode_documents(spark.createDataFrame([], DOCS), path).count() == 0


def numbered(ts):
    return "".join(f"{k}. {r}: {t}\n" for k, (r, t) in enumerate(ts, 1))


def windowed(ts):
    return "".join(f"{r}: {t}\n" for r, t in ts[-40:])


def blanking(ts):
    return "".join(f"{r}: {t if k >= len(ts) - 35 else ''}\n" for k, (r, t) in enumerate(ts))


@pytest.mark.parametrize("exact", [256, 8])
def test_templates_that_look_far_back(monkeypatch, exact):
    monkeypatch.setattr(chat_format, "EXACT", exact)
    turns = [("assistant" if k % 2 else "user", f"text {k} \ue000\ue001") for k in range(70)]
    for template, rewrites in ((numbered, False), (windowed, True), (blanking, True), (chat_format.marked_turns, False)):
        out, found, rewritten = chat_format.spans(turns, template)
        assert rewritten == rewrites and out == template(turns)
        if not rewrites:
            assert "".join(out[a:d] for a, _, _, d in found) == out
            assert [chat_format.unescape(out[b:c]) for _, b, c, _ in found] == [t for _, t in turns]


def test_later_turns_are_rendered_in_linear_time(monkeypatch):
    monkeypatch.setattr(chat_format, "EXACT", 8)
    seen = []

    def counting(ts):
        seen.append(len(ts))
        return chat_format.marked_turns(ts)

    turns = [("user", "x")] * 3000
    assert not chat_format.spans(turns, counting)[2] and sum(seen) < 12 * len(turns)


def test_a_role_with_the_mark(spark):
    out, found, _ = chat_format.spans([("\ue000\ue001", "text")])
    assert out[found[0][1] : found[0][2]] == "text"


def test_rewriting_shows_at_any_length(spark):
    blinking = lambda ts: ("(300 turns) " if len(ts) == 300 else "") + chat_format.marked_turns(ts)
    turns = [("assistant" if k % 2 else "user", f"text {k}") for k in range(600)]
    for n in (299, 300, 301, 400, 512, 600):
        out, _, rewritten = chat_format.spans(turns[:n], blinking)
        assert rewritten == (n >= 300) and out == blinking(turns[:n])
    rows = [(n, k, *turn) for n in (299, 400) for k, turn in enumerate(turns[:n])]
    got = chat_format.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), blinking).collect()
    assert sorted((r.conv_id, r.turn, r.rewritten) for r in got) == [(n, k, n == 400 and k >= 299) for n, k, *_ in rows]


def test_kept_output_of_the_default_template():
    r = random.Random(4)
    plain = lambda ts: "".join(f"### {chat_format.escape(a)}: {chat_format.escape(b)}</turn>\n" for a, b in ts)
    turns: list = []
    for _ in range(3000):
        turns = r.choice([turns, turns, turns[:-1], turns[1:], []]) + [(r.choice("ab#"), r.choice("xy:"))] * r.randint(0, 3)
        assert chat_format.marked_turns(turns) == plain(turns)
    turns = [["a", "x"], ["b", "y"], ["a", "z"]]
    assert chat_format.marked_turns(turns) == plain(turns)
    turns[0][1] = "changed"
    assert chat_format.marked_turns(turns) == plain(turns)
