"""The operators against brute force, on tables with nulls, ties, repeated rows, hot groups and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import chunking, jaccard, language, mixing, packing, personal, quality, repeats, secrets, substrings, suffix_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket string, class string, rid string"


def corpus():
    r = random.Random(3)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 8))) for _ in range(300)]
    make = lambda n: " ".join(r.choices(vocabulary, k=n))
    common, texts = make(90), []
    for _ in range(60):
        texts.append(make(r.choice([1, 3, 5, 12, 40, 200])))
    base = make(150)
    for k in range(25):
        words = base.split()
        words[r.randrange(150)] = f"edit{k}"
        texts += [" ".join(words), f"{make(20)} {common} {make(20)}"]
    texts += [base] * 8 + [None, "", " \n", "x" * 900, "ab " * 500, make(3000), "Éa\tb\x0bc\x0cd " * 80, "a@b.co +12 345 678 90 4111 1111 1111 1111 1.2.3.4 token = abcdef9", 'API_KEY: "AKIA' + "B" * 20 + '" ' + "0a" * 20]
    rows = [(n, t, "xx" if n % 2 else "yy", f"s{n % 4}" if n % 5 else None, 0, "b", "c", "d") for n, t in enumerate(texts)]
    return rows + [rows[0], rows[70], (3, "other text of id three", None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def sha(x):
    return hashlib.sha256(x).hexdigest()


def split(t):
    return (t or "").encode().split()


def test_substrings(docs, rows, empty, monkeypatch):
    first = {}
    for d, t, *_ in sorted(rows, key=lambda r: r[0]):
        w = split(t)
        for i in range(len(w) - 12):
            first.setdefault(tuple(w[i : i + 13]), d)
    expected = Counter()
    for d, t, *_ in rows:
        w = split(t)
        gone = {p for i in range(len(w) - 12) if first[tuple(w[i : i + 13])] < d for p in range(i, i + 13)}
        expected[d, len(w), len(gone), sha(b" ".join(x for p, x in enumerate(w) if p not in gone))] += 1
    for hot, shard in ((2000, 1 << 20), (5, 300)):
        monkeypatch.setattr(repeats.filters, "__defaults__", (hot,))
        assert Counter(map(tuple, substrings.op6_substring_dedup(docs, shard_words=shard).collect())) == expected
    assert substrings.op6_substring_dedup(empty).count() == 0


def test_suffix_dedup(docs, rows, empty, monkeypatch):
    data = [(d, (t or "").encode()) for d, t, *_ in rows]
    seen = Counter(b[i : i + 400] for _, b in data for i in range(len(b) - 399))
    expected = Counter()
    for d, b in data:
        gone = np.zeros(len(b) + 2, bool)
        for i in range(len(b) - 399):
            if seen[b[i : i + 400]] > 1:
                gone[i + 1 : i + 401] = True
        kept = np.frombuffer(b, np.uint8)[~gone[1:-1]].tobytes()
        expected[d, len(b), len(b) - len(kept), int((gone[1:] & ~gone[:-1]).sum()), sha(kept)] += 1
    for hot, shard in ((2000, 1 << 21), (5, 2000)):
        monkeypatch.setattr(repeats.filters, "__defaults__", (hot,))
        assert Counter(map(tuple, suffix_dedup.op7_suffix_array_dedup(docs, shard_bytes=shard).collect())) == expected
    assert suffix_dedup.op7_suffix_array_dedup(empty).count() == 0


def test_suffix_dedup_of_any_doc_id(spark):
    text, least, most = "".join(random.Random(7).choices("abcdefgh ", k=900)), -(1 << 63), (1 << 63) - 1
    docs = spark.createDataFrame([(least, f"x{text}"), (most, f"{text}y"), (None, f"z {text}"), (0, text[:399])], "doc_id long, text string")
    out = {r.doc_id: r[1:4] for r in suffix_dedup.op7_suffix_array_dedup(docs).collect()}
    assert out == {least: (901, 900, 1), most: (901, 900, 1), None: (902, 900, 1), 0: (399, 0, 0)}


def shingles(t):
    w = [x.lower() for x in split(t)]
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def joined(rows):
    """doc_id, set size, component of each row, from all pairs; and the component ids."""
    sets = [(d, shingles(t)) for d, t, *_ in rows]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                parent[root(i)] = root(j)
    least = defaultdict(lambda: 1 << 60)
    for i, (d, _) in enumerate(sets):
        least[root(i)] = min(least[root(i)], d)
    return Counter((d, len(s), least[root(i)]) for i, (d, s) in enumerate(sets)), set(least.values())


def test_jaccard(docs, rows, empty):
    expected, least = joined(rows)
    assert Counter(map(tuple, jaccard.op10_ngram_jaccard(docs).collect())) == expected
    assert jaccard.op10_ngram_jaccard(empty).count() == 0
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == least


def families(seed):
    """Near copies by 0 to 7 edits of three kinds, some of which many copies share, so that whether two link is close; and texts around one passage."""
    r, texts = random.Random(seed), []
    make = lambda n: [f"w{r.randrange(4000)}" for _ in range(n)]
    base = make(r.choice([60, 110, 150]))
    often = [(r.choice("rdi"), r.randrange(len(base)), f"o{k}") for k in range(8)]
    for k in range(140):
        words, changes = base[:], r.sample(often, r.randint(0, 3)) + [(r.choice("rdi"), r.randrange(len(base)), f"e{k}x{i}") for i in range(r.randint(0, 4))]
        for kind, at, new in sorted(changes, key=lambda c: -c[1]):
            words[at : at + (kind != "i")] = [] if kind == "d" else [new]
        texts.append(" ".join(words))
    passage = make(40)
    texts += [" ".join(make(r.randint(0, 12)) + passage + make(r.randint(0, 12))) for _ in range(60)]
    r.shuffle(texts)
    return [(n, t, None, None, None, None, None, None) for n, t in enumerate(texts)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_jaccard_long_lists(spark, monkeypatch, seed):
    rows, calls, by_difference = families(seed), [], jaccard.by_difference
    monkeypatch.setattr(jaccard, "LONG_LIST", 6)
    monkeypatch.setattr(jaccard, "DRAWN", 9)
    monkeypatch.setattr(jaccard, "by_difference", lambda *a: calls.append(1) or by_difference(*a))
    expected, least = joined(rows)
    assert 10 < len(least) < 190
    assert Counter(map(tuple, jaccard.op10_ngram_jaccard(spark.createDataFrame(rows, SCHEMA)).collect())) == expected
    assert calls


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def test_personal(docs, empty):
    anchors, r = personal.automaton(), random.Random(5)
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    good = {"email": lambda m: True, "ip": lambda m: all(int(x) <= 255 for x in m[0].split(".")), "card": lambda m: 13 <= len(digits(m)) <= 19 and personal.luhn(digits(m)), "phone": lambda m: 9 <= len(digits(m)) <= 15}
    for _ in range(20000):
        t = "".join(r.choices(["a", "@", ".", "1", "23", "+4", "+", " ", "-", "(", "255", "0", "b-c", "é", "4111 1111 1111 1111"], k=r.randint(0, 20)))
        got = personal.scan(t, anchors)
        assert all(got[k] == [m.span() for m in re.finditer(p, t) if good[k](m)] for k, p in PATTERNS.items()), t
    assert personal.scan("iban DE89 3704 0044 0532 0130 00 ok", anchors)["iban"] == [(5, 32)]
    out = personal.masked(docs).where("text like '%<email>%'").collect()
    assert len(out) == 1 and out[0].text == "<email> <dial> <account> <ip> token = abcdef9" and out[0].n_chars == len(out[0].text)
    assert personal.op3_personal_data(docs).count() == docs.count() and personal.op3_personal_data(empty).count() == 0


def test_secrets(docs, rows, empty):
    kinds = [("assign", r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24)]
    expected = Counter()
    for d, t, *_ in rows:
        spans = sorted((m.start(), n, f"{k}:{m.start()}:{m.end()}") for n, (k, p, g, least) in enumerate(kinds) for m in re.finditer(p, t or "") if len(m[g]) >= least)
        expected[d, sha(",".join(s[2] for s in spans).encode())] += 1
    out = secrets.op5_secret_scan(docs).collect()
    assert Counter((r.doc_id, r.base_sha256) for r in out) == expected and sum(r.n_live for r in out) > 0
    assert secrets.op5_secret_scan(empty).count() == 0


def test_secret_owners(spark, monkeypatch):
    """What owners make of a value, by the shuffled join and by the broadcast one; null owners, repeated rows, a text of many matches."""
    key = lambda n: f"token={'k%04d' % n}zz"
    many = " ".join(f"\u00e9 {key(n)}" for n in range(3000))
    rows = [(n, key(1), f"s{n % 4}") for n in range(40)] + [(n, f"{key(2)} {key(n)}", "s1") for n in range(100, 115)] + [(200, key(3), None), (201, key(3), None), (202, many, "s0"), (202, many, "s0"), (None, key(4), "s2")]
    held = defaultdict(set)
    for d, t, s in rows:
        for m in re.finditer("token=([a-z0-9]+)", t):
            held[m[1]].add((s, d))
    copied = {v for v, h in held.items() if len({s for s, _ in h}) >= 3 or len(h) >= 20}
    expected = Counter()
    for d, t, _ in rows:
        found = set(re.findall("token=([a-z0-9]+)", t))
        spans = ",".join(f"assign:{m.start()}:{m.end()}" for m in re.finditer("token=[a-z0-9]+", t))
        expected[d, spans, len(found & copied), len(found - copied)] += 1
    assert copied and len(copied) < len(held)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    for most in (10_000, 3, 0):  # all values are frequent, one is, none is
        monkeypatch.setattr(secrets.judged, "__defaults__", (most,))
        assert Counter((r.doc_id, r.spans, r.n_copied, r.n_live) for r in secrets.op5_secret_scan(docs).collect()) == expected


def test_quality(spark, docs, rows, empty):
    labels = spark.createDataFrame([(n, n % 2, 0) for n in range(0, 60)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    out = quality.op1_quality_rules(docs, labels).collect()
    expected = Counter()
    for d, t, *_ in rows:
        b = (t or "").encode()
        w = b.split()
        seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        repeat = len({p for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for p in range(i, i + 5)})
        lines = [x for x in b.split(b"\n") if x.split()]
        expected[d, len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), repeat, len(w) < 10 or 100 * repeat > 20 * len(w)] += 1
    assert Counter(tuple(r)[:7] for r in out) == expected and not any(r.kept and r.base_failed for r in out)
    assert quality.op1_quality_rules(empty, labels).count() == 0
    assert quality.op1_quality_rules(docs, labels.where("false")).where("kept = base_failed").count() == 0


def test_quality_learns(spark):
    """Labels that follow the words: verdicts and probabilities of rows without a label follow them too."""
    r = random.Random(9)
    words = {1: [f"good{n}" for n in range(40)], 0: [f"junk{n}" for n in range(40)]}
    both = [f"any{n}" for n in range(40)]
    of = lambda n: " ".join(r.sample(words[n % 2], 14) + r.sample(both, 14))
    docs = spark.createDataFrame([(n, of(n)) for n in range(600)], "doc_id long, text string")
    labels = spark.createDataFrame([(n, n % 2, 0) for n in range(400)], "doc_id long, quality int, toxic int")
    out = [x.asDict() for x in quality.op1_quality_rules(docs, labels).collect()]
    unseen = [x for x in out if x["doc_id"] >= 400]
    assert len(unseen) == 200 and sum(x["kept"] == bool(x["doc_id"] % 2) for x in unseen) >= 196
    assert {x.doc_id for x in quality.filtered(docs, quality.fit(docs, labels)).collect()} == {x["doc_id"] for x in out if x["kept"]}


def test_language_of_many(spark):
    """Ten languages; repeated rows get one answer; no lang at all."""
    r = random.Random(4)
    tongues = {f"l{k}": ["".join(r.choices("abcdefghijklmnopqrstuvwxyz"[k * 2 : k * 2 + 7], k=r.randint(3, 7))) for _ in range(30)] for k in range(10)}
    rows = [(n, " ".join(r.choices(tongues[f"l{n % 10}"], k=25)), f"l{n % 10}") for n in range(900)]
    docs = spark.createDataFrame(rows + rows[:7], "doc_id long, text string, lang string")
    out = language.op4_language_id(docs).collect()
    held = [x for x in out if x.held_out]
    assert len(out) == 907 and all(0 <= x.score <= 1 for x in out) and sum(x.lang_pred == rows[x.doc_id][2] for x in held) >= 0.97 * len(held)
    assert len({(x.doc_id, x.lang_pred, x.score) for x in out}) == 900
    assert {x.lang_pred for x in language.op4_language_id(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_language(spark, empty):
    r = random.Random(1)
    tongues = {"aa": "kato mila sune rapo".split(), "bb": "grunz weich schtorf pfel".split(), "cc": "oui leau queue ceaux".split()}
    rows = [(n, " ".join(r.choices(tongues[k], k=30)), k) for n in range(300) for k in [sorted(tongues)[n % 3]]] + [(900, None, "aa"), (901, "12 --", None), (None, "kato mila", "aa")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = {x.doc_id: x for x in language.op4_language_id(docs).collect()}
    held = [x for x in out.values() if x.held_out and x.doc_id is not None and x.doc_id < 300]
    assert held and all(x.lang_pred == rows[x.doc_id][2] for x in held)
    assert out[900].lang_pred == out[901].lang_pred == "und" and all(x.held_out == (zlib.crc32(str(k).encode()) % 3 == 1) for k, x in out.items() if k is not None)
    assert language.op4_language_id(empty).count() == 0


def test_mixing(docs, rows, empty):
    out = mixing.mix(docs, chunk=40).collect()
    sizes = Counter()
    for _, t, _, s, *_ in rows:
        sizes[s] += len(split(t))
    names = [*sorted(x for x in sizes if x is not None), *([None] if None in sizes else [])]
    weight, left, target = {s: n % 3 + 1 for n, s in enumerate(names)}, set(names), {}
    while left:
        level = (sum(sizes.values()) - sum(target.values())) / sum(weight[s] for s in left)
        full = {s for s in left if level * weight[s] >= 3 * sizes[s]}
        target |= {s: float(3 * sizes[s]) for s in full} if full else {s: level * weight[s] for s in left}
        left = left - full if full else set()
    assert all(abs(r.target - target[r.source]) < 1e-6 and 0 <= r.taken <= 3 * r.size for r in out) and len(out) == len(rows)
    assert sorted(map(str, out)) == sorted(map(str, mixing.mix(docs.repartition(5), chunk=40).collect()))
    copies = mixing.mixed(docs, chunk=40)
    assert copies.columns == docs.columns and copies.count() == sum(r.times for r in out)
    assert mixing.op2_mix_sources(empty).count() == 0
    p, size = np.full(400, 0.3), np.random.default_rng(1).integers(1, 2000, 400)
    flown = mixing.flight(p.copy(), size, np.arange(400), least=2)
    assert ((flown > 0) & (flown < 1)).sum() <= 2 and abs(flown.sum() - 120) < 1e-6 and abs(flown @ size - p @ size) < 1e-3


def test_fingerprints(docs, rows, empty):
    place = lambda r: (r[0], r[1] or "")
    out = sorted(chunking.op8_document_fingerprints(docs).collect(), key=lambda r: r.doc_id)
    once = {d for d, n in Counter(r[0] for r in rows).items() if n == 1}
    ordered = sorted(rows, key=place)
    for at, (d, t, *_) in enumerate(ordered):
        after = ordered[(at + 1) % len(ordered)]
        if d in once and after[0] in once:
            t, k = t or "", len(t or "") // 4
            got = next(r for r in out if r.doc_id == d)
            assert got.edited_sha256 == sha((t[: len(t) - k] + (after[1] or "")[:k]).encode()) and got.n_chars == len(t)
            assert 0 <= got.near_next <= 1 and (got.fingerprint == got.edited_fingerprint) <= (got.near_edited == 1)
    assert len(out) == len(rows) and chunking.op8_document_fingerprints(empty).count() == 0
    assert chunking.op8_document_fingerprints(docs.limit(1)).count() == 1


def test_packing(docs, rows, empty):
    tokenizer = packing.encoder(packing.default_vocabulary()).tokenizer
    out = packing.pack(docs, chunk=50).collect()
    expected = Counter()
    for d, t, *_ in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        start, length, piece = 0, len(ids) % 2048 or 2048, 0
        while start < len(ids):
            expected[d, piece, start, length, zlib.crc32(ids[start : start + length].tobytes())] += 1
            start, length, piece = start + length, 2048, piece + 1
    assert Counter(tuple(r)[:5] for r in out) == expected
    places = defaultdict(list)
    for r in out:
        places[r.sequence_id].append((r.offset, r.length))
    for p in places.values():
        p.sort()
        assert [o for o, _ in p] == [sum(n for _, n in p[:i]) for i in range(len(p))] and sum(n for _, n in p) <= 2048
    assert len(places) <= 1.1 * sum(r.length for r in out) / 2048 + 4
    assert packing.op9_best_fit_packing(empty).count() == 0


def test_pipeline(spark, docs, tmp_path):
    import corpus_pipeline

    docs.where("doc_id is not null").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(n, n % 2, 0) for n in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).where("length < 1").count() == 0


def test_encoder_equals_the_tokenizer():
    """Words that are merged without the tokenizer, and all the ways in which a text falls apart, against whole texts."""
    encode = packing.Encoder(packing.default_vocabulary())
    assert packing.merging(encode.tokenizer) is not None
    pick = random.Random(5)
    parts = [*"ab1Zéüßñ²Ⅷ字́.,;:!?''\"-_ \n\t\r\x1c\x85s", "  ", "\n\n", " \n", "'s", "'ll", ".\n", "a.", "b,", " über", "Straße"]
    for _ in range(5000):
        text = "".join(pick.choice(parts) for _ in range(pick.randint(1, 14)))
        assert np.frombuffer(encode(text), "<u4").tolist() == encode.tokenizer.encode(text, add_special_tokens=False).ids, repr(text)
