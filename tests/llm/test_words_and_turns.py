"""Spelling variants, prefix tries and token counts against brute force; fingerprints and their neighbours at any size; one document of each group."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from quillspark.llm import arrays, chunking, jaccard, prefixes, spelling, tokens

UPPER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
CLASHING = "doc_id long, text string, word string, key string, n long, at long, tie long"


def clashing(rows):
    return [(*r, "w", "k", 1, 2, 3) for r in rows]


def spelled(rows):
    n = Counter()
    for d, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(UPPER)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            n[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 97 == 0 else w] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    near, same = defaultdict(set), defaultdict(set)
    for w in n:
        for i in range(len(w)):
            v = w[:i] + w[i + 1 :]
            same[i, v].add(w)
            if v in n:
                near[w].add(v)
                near[v].add(w)
    for group in same.values():
        for w in group:
            near[w] |= group - {w}
    form = {w: min(near[w], key=lambda x: (-n[x], x), default=None) for w in n}
    form = {w: f if f and n[f] >= 2 * n[w] else None for w, f in form.items()}
    out = Counter()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None] += 1
    return out


@pytest.mark.parametrize("crowd", [16, 2])
def test_spelling(spark, monkeypatch, crowd):
    r, rows = random.Random(2), []
    for d in range(120):
        letters = "abÀé" if d % 3 else "abC"
        rows.append((d if d % 7 else None, " ".join("".join(r.choices(letters, k=r.choice([4, 5, 5, 6, 7, 9]))) for _ in range(200)) + "÷x5abcdefg××"))
    long = ["a" * 3000, "a" * 3001, "a" * 1500 + "b" + "a" * 1500]
    rows += [(900 + k, " ".join(long)) for k in range(3)] + [(1, None), (2, ""), (3, "5 --")] + rows[:9]
    for f in (spelling.near_pairs, spelling.near):
        monkeypatch.setattr(f, "__defaults__", (crowd,))
    monkeypatch.setattr(spelling.variants, "__defaults__", (2, crowd))
    docs = spark.createDataFrame(clashing(rows), CLASHING).repartition(3)
    assert Counter(map(tuple, spelling.op11_spelling_variants(docs).collect())) == spelled(rows)
    assert spelling.op11_spelling_variants(docs.where("false")).count() == 0
    assert spelling.op11_spelling_variants(docs.where("text is null or text = '5 --'")).count() == 0


def test_checksums_and_runs():
    r = random.Random(4)
    texts = ["".join(r.choices(["a", "Z", "é", "×", "ā", "1", " ", "b" * 70], k=r.randint(0, 30))) for _ in range(500)]
    buf, off = arrays.buffer(pa.array(texts))
    s, e = spelling.runs(buf, off)
    assert [buf[a:b].tobytes().decode() for a, b in zip(s, e, strict=True)] == [m for t in texts for m in re.findall("[A-Za-zÀ-ÿ]+", t)]
    head = np.arange(len(s)).astype(np.uint32)
    assert spelling.checksums(buf, s, e, head).tolist() == [zlib.crc32(buf[a:b].tobytes(), n) for n, (a, b) in enumerate(zip(s, e, strict=True))]


def trie(rows):
    turns = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            turns[c].append((t, role or "", text or ""))

    def place(m):
        d = hashlib.sha256(f"{len(m[1])}:{m[1]}{m[2]}".encode()).digest()
        return m[0] is not None, m[0] or 0, *(int.from_bytes(d[i : i + 8], "big", signed=True) for i in (0, 8))

    own = {c: [m[1:] for m in sorted(x, key=place)] for c, x in turns.items()}
    nodes, ends, below = defaultdict(list), defaultdict(list), defaultdict(set)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        s = own.get(c - int(np.fmod(c, 20)), [])[:h] + own[c][h:]
        for d in range(len(s) + 1):
            nodes[tuple(s[:d])].append(c)
        ends[tuple(s)].append(c)
    for k in nodes:
        if k:
            below[k[:-1]].add(k)
    leaves, saved = {}, {}
    for k in sorted(nodes, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in below[k]) if below[k] else 1
        saved[k] = sum(saved[x] for x in below[k]) + ((len(nodes[k]) - 1) * len(k[-1][1].encode().split()) if k else 0)
    return Counter((min(m), len(k), min(nodes[k[:-1]]) if k else None, len(m), len(below[k]), leaves[k], saved[k], hashlib.sha256(",".join(map(str, sorted(ends.get(k, [])))).encode()).hexdigest()) for k, m in nodes.items())


def test_prefix_trie(spark):
    r, rows = random.Random(5), []
    for c in [*range(-45, 100), None]:
        rows += [(c, r.choice([t, t, None, 3]), r.choice(["user", "user", None]), r.choice(["a b", "a", "", None, "c d\x0be"])) for t in range(r.choice([1, 2, 2, 3, 5, 9]))]
    rows += rows[:9]
    for c, stop in ((500, 70), (501, 70), (502, 69), (503, 37), (504, 36), (519, 15)):
        rows += [(c, t, "user", f"t {t}") for t in range(stop)]
    rows += [(700 + 20 * k, 0, "u", "hot turn") for k in range(300)] + [(600, 0, "user", "x"), (613, 0, "user", "y")]
    of = lambda rows: spark.createDataFrame([(*x, 1, 2, "x") for x in rows], "conv_id long, turn long, role string, text string, depth long, x1 long, last string").repartition(3)
    for some in (rows, [(7, t, "u", f"x {t}") for t in range(900)] + [(8, t, "u", f"x {t}") for t in range(850)], [(3, 0, "u", "x y")], [(20, 0, "u", "x " * 2_500_000)], [(None, 0, "u", "x")], []):
        assert Counter(map(tuple, prefixes.op12_prefix_trie(of(some)).collect())) == trie(some)


def test_numbered_over_partitions(spark):
    """A key that fills several partitions is counted and combined on across them."""
    rows = [(n % 7 == 0, n * 7919 % 5003, n) for n in range(5003)]
    df = spark.createDataFrame([(1 if a else 2, b, c) for a, b, c in rows], "k long, o long, x long")
    out = prefixes.numbered(df, "k", ["o"], ("x",)).collect()
    expected = []
    for k in (1, 2):
        acc = 0
        for at, (o, x) in enumerate(sorted((b, c) for a, b, c in rows if (1 if a else 2) == k)):
            acc ^= x
            expected.append((k, o, acc, at))
    assert sorted(map(tuple, out)) == sorted(expected)


def test_tokens(spark, monkeypatch):
    vocabulary = tokens.vocabulary_of(tokens.default_vocabulary())
    count = lambda texts: [len(e.ids) for e in vocabulary.tokenizer.encode_batch(texts, add_special_tokens=False)]
    r = random.Random(1)
    parts = ["'", "s", "t", "re", "ve", "ll", " ", "  ", "\n", "\t", "a", "é", "1", "٣", "½", "!", "-", "<|endoftext|>", "<|endof", "\U0001f600", "́", "\x1c", "\x85", "xxxxx", "中", " ", "S", "Ⅷ", "_", "the"]
    texts = ["".join(r.choices(parts, k=r.randint(0, 40))) for _ in range(4000)] + ["a" * 5000, "".join(r.choices("etaoin", k=9000)), "", " ", " " * 3, " a" * 9 + "  "]
    for limit, long in ((1 << 20, 256), (50, 3), (300, 256)):
        monkeypatch.setattr(tokens, "LONG", long)
        vocabulary.forget()
        assert tokens.token_numbers(pa.array(texts), vocabulary, limit).tolist() == count(texts)
    monkeypatch.setattr(tokens, "KNOWN", 50)
    assert tokens.token_numbers(pa.array(texts[:300]), vocabulary, 500).tolist() == count(texts[:300])
    monkeypatch.undo()
    big = "".join(r.choices(["word ", "other, ", "z", "ü\n"], k=1_500_000))
    rows = [(n, t) for n, t in enumerate(texts[:200])] + [(None, "x"), (5, None), (6, big), (6, big), (7, "".join(r.choices("etaoin", k=200_000)))]
    docs = spark.createDataFrame(clashing(rows), CLASHING).repartition(3)
    expected = Counter((d, len((t or "").encode()), n, n > 1024) for (d, t), n in zip(rows, count([t or "" for _, t in rows]), strict=True))
    assert Counter(map(tuple, tokens.op13_token_counts(docs).collect())) == expected
    assert tokens.op13_token_counts(docs.where("false")).count() == 0


def test_tokens_refuses_other_vocabularies():
    import public_tokenizers

    with pytest.raises(ValueError, match="byte-level"):
        tokens.Vocabulary(public_tokenizers.path("word_bpe_49k.json"))


def cut_slowly(text: bytes):
    """Chunks of a text by the definition: the hash of the last 32 bytes, harder before the aimed length than after it."""
    gear, start, out = chunking.GEAR.tolist(), 0, []
    while start < len(text):
        end = min(len(text), start + chunking.MOST)
        for at in range(start + chunking.LEAST - 1, end):
            h = sum(gear[text[at - k]] << k for k in range(min(32, at + 1))) & 0xFFFFFFFF
            if h & int(chunking.HARD if at < start + chunking.AIM - 1 else chunking.EASY) == 0:
                end = at + 1
                break
        out.append(text[start:end])
        start = end
    return out


def likeness(a, b):
    if not a:
        return float(not b)
    return sum(map(len, set(a) & set(b))) / sum(map(len, set(a)))


def neighbours_slowly(spark, rows):
    hashed = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "coalesce(text, '') as text", "xxhash64(coalesce(text, '')) as h").collect()
    order = sorted(hashed, key=lambda r: (r.doc_id is None, r.doc_id or 0, r.h))
    out = []
    for at, r in enumerate(order):
        after = order[(at + 1) % len(order)].text
        k = len(r.text) // 4
        edited = (r.text[: len(r.text) - k] + after[:k]).encode()
        own, other, following = cut_slowly(r.text.encode()), cut_slowly(edited), cut_slowly(after.encode())
        out.append((r.doc_id, len(r.text), hashlib.sha256(edited).hexdigest(), len(set(own)), round(likeness(own, other), 9), round(likeness(own, following), 9)))
    return Counter(out)


@pytest.mark.parametrize("parts", [4, 64, 211])
def test_neighbours_of_any_number_of_rows(spark, parts):
    r = random.Random(parts)
    make = lambda: "".join(r.choices("abcd é", k=r.choice([0, 3, 40, 900])))
    tables = [[(d, make()) for d in range(n)] for n in (1, 2, 3, 5, 7, 10)]
    tables += [[(1, "same text of all rows " * 9)] * 40 + [(2, make()), (0, make()), (2, make())], [(None, make()) for _ in range(6)] + [(None, None)], [(4, make()) for _ in range(30)]]
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        for rows in tables if parts < 64 else tables[1::2]:
            out = chunking.op8_document_fingerprints(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
            assert Counter((x.doc_id, x.n_chars, x.edited_sha256, len(x.fingerprint) // 16, round(x.near_edited, 9), round(x.near_next, 9)) for x in out) == neighbours_slowly(spark, rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_one_of_each_tells_texts_of_one_id_apart(spark):
    words = [f"w{k}" for k in range(400)]
    a, b, c = " ".join(words[:60]), " ".join(words[100:160]), " ".join(words[200:260])
    near_a = " ".join([*words[:59], "other"])
    rows = [(1, a, "x"), (1, b, "x"), (2, near_a, "x"), (0, c, "x"), (3, c + " end", "x"), (1, b, "y"), (1, b, "x"), (None, a, "z"), (None, "", "q"), (None, "", "q"), (7, None, "n"), (7, "", "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tie string").repartition(3)
    kept = Counter(map(tuple, jaccard.one_of_each(docs).collect()))
    assert kept == Counter([(1, a, "x"), (1, b, "x"), (0, c, "x"), (None, "", "q"), (None, "", "q"), (7, None, "n") if (7, None, "n") in kept else (7, "", "n")])
    assert jaccard.one_of_each(docs.where("false")).count() == 0
