"""The operators on texts against brute-force versions."""

import base64
import hashlib
import re
from collections import Counter

import pytest

from weftline.llm import bpe, licenses, mixing, pii, quality, queries, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def base_counts(text):
    words = WORD.findall(text or "")
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = {g for g, n in Counter(grams).items() if n > 1}
    covered = {k for i, g in enumerate(grams) if g in often for k in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


@pytest.mark.parametrize("which", ["odd_docs", "some_docs", "no_docs"])
def test_quality_counts(which, request):
    docs = request.getfixturevalue(which)
    got = rows(quality.judge(docs).select("doc_id", *quality.BASE, "base_failed"))
    assert got == sorted(((d.doc_id, *base_counts(d.text)) for d in docs.collect()), key=repr)


def test_quality_verdicts(spark, some_docs):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    judged = quality.judge(some_docs).join(labels, "doc_id").filter("not base_failed").collect()
    assert all(r.kept for r in judged if r.quality == 1)
    assert not any(r.kept for r in judged if r.quality == 0)


def test_quality_distance_matches_numpy(spark, some_docs):
    import numpy as np

    stats = quality.with_stats(quality.with_counts(some_docs))
    model = quality.fit(stats)
    got = quality.score(stats, model).filter("not base_failed").collect()
    whole = [r for r in model.collect() if r.level == 2][0]
    p = len(quality.STATS)
    low = np.array([[whole[f"l_{i}_{j}"] if j <= i else 0.0 for j in range(p)] for i in range(p)])
    centre = np.array([whole[f"m_{i}"] for i in range(p)])
    for r in got:
        if r.n_words and r["_key"].level == 2:
            x = np.array([r[s] for s in quality.STATS]) - centre
            assert r.d2 == pytest.approx(x @ np.linalg.inv(low @ low.T) @ x, rel=1e-6, abs=1e-9)


def test_keep_good_keeps_rows_and_columns(odd_docs):
    kept = quality.keep_good(odd_docs)
    assert kept.columns == odd_docs.columns
    good = {r.doc_id for r in quality.judge(odd_docs).filter("kept").collect()}
    assert {r.doc_id for r in kept.collect()} == good


def brute_print(text):
    from xxhash import xxh64_intdigest

    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("which", ["odd_docs", "some_docs", "no_docs"])
def test_simhash_groups(which, request):
    docs = request.getfixturevalue(which)
    data = [(d.doc_id, brute_print(d.text)) for d in docs.collect()]
    prints = sorted({f for _, f in data})
    root = {f: f for f in prints}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(prints):
        for b in prints[:i]:
            if bin(a ^ b).count("1") <= 2:
                root[find(a)] = find(b)
    least = {}
    for d, f in data:
        if d is not None:
            least[find(f)] = min(d, least.get(find(f), d))
    want = sorted(((d, f"{f:016x}", least.get(find(f))) for d, f in data), key=repr)
    groups = simhash.cluster(docs)
    assert rows(groups.select("doc_id", "fingerprint", "component_id")) == want
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({find(f) for _, f in data})


def test_near_pairs_finds_every_link(spark):
    import random

    r = random.Random(5)
    prints = {r.getrandbits(64) for _ in range(150)}
    for x in list(prints)[:80]:
        a, b = r.sample(range(64), 2)
        prints |= {x ^ 1 << a, x ^ 1 << a ^ 1 << b}
    prints |= {0, 1, 3, 1 << 63, (1 << 63) | (1 << 62), (1 << 64) - 1, (1 << 64) - 2}
    prints = sorted(prints)
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    want = sorted(((i, j) for i in range(len(prints)) for j in range(i + 1, len(prints)) if bin(prints[i] ^ prints[j]).count("1") <= 2), key=repr)
    nodes = spark.createDataFrame(list(enumerate(signed)), "node long, fp long")
    for bits in (2, 4, 8):
        assert rows(simhash.near_pairs(nodes, bits)) == want


def test_offers_are_not_broadcast(spark, tmp_path):
    """Each node makes up to 33 offers, which Spark sizes as the table of nodes, far below its threshold for broadcasts."""
    spark.range(2000).selectExpr("id as node", "xxhash64(id) as fp").write.parquet(f"{tmp_path}/nodes")
    found = simhash.near_pairs(spark.read.parquet(f"{tmp_path}/nodes"))
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


BASES = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def brute_spans(text):
    out = []
    for kind, pattern in BASES:
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(len(x.lstrip("0")) < 4 and int(x[-3:]) <= 255 for x in m[0].split(".")), "card": 16 <= len(d) <= 19 and pii.luhn(d), "phone": 8 <= len(d) <= 15}[kind]
            if ok:
                out.append((kind, *m.span()))
    return out


@pytest.fixture(scope="module")
def detector(spark):
    return pii.fit(spark, 1200)


@pytest.mark.parametrize("which", ["odd_docs", "some_docs", "no_docs"])
def test_pii_base(which, request, detector):
    docs = request.getfixturevalue(which)
    got = pii.find(docs, detector)
    assert set(docs.columns) < set(got.columns)
    for r in got.collect():
        want = brute_spans(r.text)
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert [r.pii.n_email, r.pii.n_ip, r.pii.n_card, r.pii.n_phone] == [sum(w[0] == k for w in want) for k in pii.BASE_KINDS]
        assert r.pii.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert set(filter(None, joined.split(","))) <= set(r.pii.spans.split(","))


def test_base_spans_on_odd_strings():
    import random

    r = random.Random(3)
    for _ in range(4000):
        t = "".join(r.choice("a.@-+1 2(5)é_%x\n4.") for _ in range(r.randint(0, 40)))
        assert pii.base_spans(t) == brute_spans(t), t


def test_pii_held_out(detector):
    hit = wrong = missed = 0
    import random

    r = random.Random(99)
    for _ in range(600):
        text, true = pii._sample_text(r)
        found = detector.spans(text)[1]
        near = [f for f in found for t in true if f[0] == t[0] and f[1] <= t[1] + 2 and f[2] >= t[2] - 2]
        hit, wrong, missed = hit + bool(near), wrong + bool(found and not true), missed + bool(true and not near)
    assert hit / (hit + missed) > 0.9
    assert hit / (hit + wrong) > 0.9


def test_redaction(detector, odd_docs):
    text = "mail a.b@c.de now, password=b7db7aa4a5fcc78305 and plain words"
    assert pii.redacted(text, detector) == "mail [EMAIL] now, password=[SECRET] and plain words"
    out = pii.redact(odd_docs, detector)
    assert out.columns == odd_docs.columns and out.count() == odd_docs.count()
    assert not any(brute_spans(r.text) for r in out.collect() if r.text and "@" in r.text and "mail me" in r.text)


def fill(sizes, total, most=3):
    """(source: size) to targets, round by round."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    full = set()
    while True:
        left = total - sum(most * sizes[s] for s in full)
        w = sum(weight[s] for s in names if s not in full)
        over = {s for s in names if s not in full and left * weight[s] / w > most * sizes[s]}
        if not over:
            return {s: float(most * sizes[s]) if s in full else left * weight[s] / w for s in names}
        full |= over


@pytest.mark.parametrize("which", ["odd_docs", "some_docs", "no_docs"])
def test_mixing(which, request):
    docs = request.getfixturevalue(which)
    config = mixing.Mix(rows_per_range=7, ranges_per_block=4)
    got = mixing.assign(docs, config).collect()
    sizes, per_doc = Counter(), {}
    for d in docs.collect():
        sizes[d.source] += len(WORD.findall(d.text or ""))
    want = fill(sizes, sum(sizes.values())) if sizes else {}
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert all(taken[s] == int(want[s] + 1e-6) for s in want)
    assert sorted((r.doc_id or -1, r.size) for r in got) == sorted((d.doc_id or -1, len(WORD.findall(d.text or ""))) for d in docs.collect())
    assert rows(mixing.assign(docs, config)) == sorted((tuple(r) for r in got), key=repr)
    del per_doc


def test_mix_rows(some_docs, odd_docs):
    for docs in (some_docs, odd_docs):
        mixed = mixing.mix(docs)
        assert mixed.columns == docs.columns
        words = Counter()
        for r in mixed.collect():
            words[r.doc_id, r.source] += len(WORD.findall(r.text or ""))
        for key, n in Counter({(r.doc_id, r.source): 0 for r in docs.collect()}).items():
            assert n <= words[key] or words[key] == 0
        want = Counter()
        for r in mixing.assign(docs).collect():
            want[r.doc_id, r.source] += r.taken
        assert {k: v for k, v in words.items() if v} == {k: v for k, v in want.items() if v}


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers as P
    import tiktoken

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("which", ["odd_docs", "some_docs", "no_docs"])
def test_bpe(which, request, tokenizer):
    docs = request.getfixturevalue(which)
    for chunk in (300, 4_000_000):
        got = bpe.decode(bpe.encode(docs, queries.vocabulary(), ["doc_id", "_row", "text"] if "_row" in docs.columns else ["doc_id", "text"], chunk_chars=chunk), queries.vocabulary())
        found = got.collect()
        assert len(found) == docs.count()
        for r in found:
            assert r.ids == tokenizer.encode_ordinary(r.text or "")
            assert bytes(r.bytes) == (r.text or "").encode()
    digest = {tuple(r) for r in bpe.digests(docs, queries.vocabulary(), ["doc_id"]).collect()}
    for d in docs.collect():
        ids = tokenizer.encode_ordinary(d.text or "")
        assert (d.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((d.text or "").encode()).hexdigest()) in digest


@pytest.mark.parametrize("which", ["odd_docs", "some_docs", "no_docs"])
def test_licenses(which, request):
    docs = request.getfixturevalue(which)
    want = []
    for d in docs.collect():
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in d.text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        at, labels = [], set()
        for phrase, label in licenses.PHRASES.items():
            p = phrase.split()
            own = [i for i in range(len(words)) if words[i : i + len(p)] == p]
            at += own
            labels |= {label} if own else set()
        want.append((d.doc_id, len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))))
    got = licenses.scan(docs).collect()
    assert sorted((tuple(r)[:6] for r in got), key=repr) == sorted(want, key=repr)
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in got)


def test_license_method(spark):
    texts = ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "Licensed under CC BY-NC 4.0.", "granted software person obtaining documentation", "nothing of the kind"]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got[0].labels == "mit" and got[0].base_labels == "" and got[0].score > 0.9
    assert got[1].labels == "cc-by,cc-by-nc"
    assert got[2].labels == got[3].labels == "" and got[3].score == 0


def test_bpe_copies_are_chunks_of_their_own(spark, tmp_path):
    """Null, empty and repeated long texts do not meet in one group."""
    rows = [(i, x) for i, x in enumerate([None, ""] * 500 + ["some long text " * 20] * 60)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "d"))
    docs, old = spark.read.parquet(str(tmp_path / "d")), spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        pattern = queries.vocabulary().pattern
        placed = docs.selectExpr("doc_id as _row", "text as _text").mapInArrow(lambda it: bpe._position_rows(it, pattern, 100), "chunk binary, _row long, codes binary")
        assert max(r["count"] for r in placed.groupBy("chunk").count().collect()) <= 100
        assert placed.filter("_row >= 1000").select("chunk").distinct().count() == 60
        got = bpe.encode(docs, queries.vocabulary(), ["doc_id"], chunk_chars=100).selectExpr("doc_id", "size(ids) as n", "hash(ids) as h").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert sorted(r.doc_id for r in got) == list(range(1060)) and {r.n for r in got if r.doc_id < 1000} == {0} and len({r.h for r in got if r.doc_id >= 1000}) == 1


class Likely:
    """A forest that says what it is told."""

    def __init__(self, *p):
        self.p = p

    def probability(self, rows):
        import numpy as np

        return np.array([self.p[i % len(self.p)] for i in range(len(rows))])


def test_pii_overlaps_and_letters(monkeypatch):
    detector = pii.Detector(Likely(0.9), dict.fromkeys(pii.KINDS, 0.5))
    assert ("secret", 10, 22) in detector.spans("password: CorrectHorse is it")[1]
    assert detector.spans("a token " + "abcdefghij" * 3 + " here")[1] == [("secret", 8, 38)]
    detector = pii.Detector(Likely(0.6, 0.7, 0.8), dict.fromkeys(pii.KINDS, 0.5))
    monkeypatch.setattr(pii, "candidates", lambda text: [("secret", 0, 10), ("secret", 8, 20), ("secret", 18, 30)])
    assert detector.spans("x" * 40)[1] == [("secret", 0, 10), ("secret", 18, 30)]


def test_pii_long_texts_take_linear_time(detector):
    import time

    assert pii.base_spans("0" * 5000 + ".1.1.1") == [("ip", 0, 5006)] == brute_spans("0" * 5000 + ".1.1.1")
    assert detector.spans("0" * 1_000_000)[0] == []
    mixed = "a.b@c.de 1.2.3.4 +1 988 555 2485 4111 1111 1111 1111 (201) 555-0123 password: b7db7aa4a5fcc78305 2001:db8:1:2:3:4:5:6 " + "abcdefghij" * 3 + " "
    took = []
    for n in (2_000, 20_000):  # some 0.3 and 3 MB
        begin = time.perf_counter()
        base, every = detector.spans(mixed * n)
        took.append(time.perf_counter() - begin)
        assert sum(s[0] == "email" for s in base) == n and len(every) >= len(base)
    assert took[1] < 25 * took[0]


def test_pii_chains_of_overlaps():
    import random

    r = random.Random(2)
    for _ in range(300):
        scored = [(r.random(), ("card", a := r.randrange(60), a + r.randrange(1, 12))) for _ in range(r.randrange(12))]
        want = []
        for _, c in sorted(scored, key=lambda x: (-x[0], x[1][1], x[1])):
            if all(c[2] <= w[1] or w[2] <= c[1] for w in want):
                want.append(c)
        assert sorted(pii._likeliest(scored)) == sorted(want)


def test_clashing_names(spark, tmp_path, detector):
    """Columns with the names that operators add or use inside are replaced or passed on, never ambiguous."""
    names = ["fingerprint", "component_id", "group", "text_hash", "fp", "node", "_row", "_id", "_hash", "_key", "_doc", "pii", "size", "taken", "target", "ids", "chunk", "_k0", "scale", "kept"]
    rows = [(i, "same words in all of these texts " * 3 + ("x" if i > 3 else ""), "en", "s", 1, *["own"] * len(names)) for i in range(6)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names)).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    got = simhash.cluster(docs)
    assert set(got.columns) == set(docs.columns) - {"text"} and {r["fp"] for r in got.collect()} == {"own"} and min(r["component_id"] for r in got.collect()) == 0
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns and {r["_key"] for r in kept.collect()} == {"own"}
    assert {r["size"] for r in pii.redact(docs, detector).collect()} == {"own"}
    assert pii.find(docs, detector).columns.count("pii") == 1
    assert {r["taken"] for r in mixing.mix(docs).collect()} == {"own"}
    assert quality.keep_good(docs).columns == docs.columns
    assert {r["chunk"] for r in bpe.encode(docs, queries.vocabulary(), ["doc_id", "chunk"]).collect()} == {"own"}


def test_pipeline(spark, tmp_path, odd_docs):
    """Every stage on what its predecessor kept, held against the same steps in plain Python where they are exact."""
    import corpus_pipeline

    folder = tmp_path / "sf"
    for name, docs in (("none", odd_docs.limit(0)), ("odd", odd_docs)):
        docs.write.parquet(str(folder / name / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(folder / "none")).collect() == []
    docs = spark.read.parquet(str(folder / "odd" / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        before, held = docs.collect(), docs.columns
        docs = queries_written(stage(spark, docs, ""), name)
        after = docs.collect()
        ids = [r.doc_id for r in before]
        assert all(r.doc_id in ids for r in after)
        if name != "bpe":
            assert docs.columns == held
        if name == "quality":
            assert sorted(map(repr, after)) == sorted(repr(r) for r in before if not base_counts(r.text)[-1])
        if name == "simhash":
            assert len(after) == len({r.text for r in after})
        if name == "pii":
            assert not any("a.b@c.de" in (r.text or "") for r in after)
        if name == "bpe":
            texts = {}
            for r in before:
                texts.setdefault(r.doc_id, []).append(hashlib.sha256((r.text or "").encode()).hexdigest())
            assert all(r.decoded_sha256 in texts[r.doc_id] and r.n_tokens == len(r.ids) for r in after) and len(after) == len(before)


def queries_written(df, name):
    from weftline.llm._shared import write_table

    return write_table(df, name)


def test_license_words_in_other_order(spark):
    """All words of a template in another order, rare ones and key phrases included, make no label of the method."""
    import random

    rows, labels = [], {}
    for i, (label, text, keys) in enumerate(licenses.TEMPLATES):
        if len(words := text.split()) >= 12:
            for seed in range(3):
                mixed = list(words)
                random.Random(31 * i + seed).shuffle(mixed)
                labels[3 * i + seed] = label
                rows.append((3 * i + seed, " ".join(mixed) + " ; " + " ; ".join(keys)))
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    wrong = {i: (x, got[i].labels, got[i].score) for i, x in labels.items() if got[i].labels != got[i].base_labels}
    assert len(labels) > 40 and not wrong


def test_license_whole_texts(spark):
    """Whole texts with names, years and an edit filled in are known; the phrases alone are not."""
    import time

    from weftline.llm.license_texts import TEXTS

    rows = []
    for i, (_, text, _) in enumerate(TEXTS):
        words = text.split()
        at = 4 * len(words) // 5
        rows.append((i, "Copyright 2020 Some One. " + " ".join([*words[:at], "or", "its", "kin", *words[at:]]) + " nothing else"))
    rows += [(100, "permission is hereby granted free of charge to all who read neither the name of nor more"), (101, "machine executable object code generated by a source language processor")]
    rows.append((200, "Licensed under the Apache License, Version 2.0, " * 100_000))
    begin = time.perf_counter()
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert time.perf_counter() - begin < 60
    for i, (label, _, _) in enumerate(TEXTS):
        assert label in got[i].labels.split(","), (label, got[i])
    assert got[100].labels == got[101].labels == ""
    assert got[200].n_base == 100_000 and got[200].labels == "apache"


def test_bpe_chunks_stay_the_same_size(spark, tmp_path):
    """A chunk's rows and bytes do not grow with the input; parts of shards give the same ids."""
    import random

    import pyarrow as pa

    r = random.Random(3)
    text = " ".join("".join(r.choices("abcdefghijklmnop", k=r.randint(2, 9))) for _ in range(100_000))
    pattern, got = queries.vocabulary().pattern, {}
    for times in (1, 10, 1000):
        shards, parts = bpe.Shards().counts(2 * 10**10 * times)
        [rows] = bpe._word_rows(iter([pa.RecordBatch.from_arrays([pa.array([text])], names=["_text"])]), pattern, 4_000_000, shards, parts)
        got[times] = len(rows), sum(len(x) for c in ("codes", "sizes", "words") for x in rows.column(c).to_pylist())
        assert len({x // shards for x in rows.column("shard").to_pylist()}) == 1
    assert got[1] == got[10] == got[1000] and got[1][0] <= 1024
    assert bpe.Shards().counts(0) == (64, 1) and bpe.Shards().counts(10**12) == (1024, 1) and bpe.Shards().counts(10**14) == (1024, 98)

    path = str(tmp_path / "t.parquet")
    spark.createDataFrame([(i, text[i : i + 999]) for i in range(0, 60_000, 999)], "doc_id long, text string").repartition(3).write.parquet(path)
    docs, vocabulary = spark.read.parquet(path), queries.vocabulary()
    few = bpe.encode(docs, vocabulary, ["doc_id"], chunk_chars=2_000, sharding=bpe.Shards(chars=10_000, least=2, most=4, part_chars=3_000))
    plain = bpe.encode(docs, vocabulary, ["doc_id"])
    assert {(x.doc_id, *x.ids) for x in few.collect()} == {(x.doc_id, *x.ids) for x in plain.collect()}


def test_round_trip_holds_one_chunk(spark, some_docs, odd_docs):
    """Ids are decoded in the task that puts them together, without a second Python worker; a task holds one chunk's texts, and long ones take no index of their size."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    import corpus_pipeline

    vocabulary = queries.vocabulary()
    for df in (corpus_pipeline.tokens(spark, some_docs, ""), queries.op9_bpe_roundtrip(spark, "/root/testdata/sf0.001")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "FlatMapCoGroupsInArrow" in plan and "ArrowEvalPython" not in plan
    for docs in (some_docs, odd_docs):
        plain = bpe.decode(bpe.encode(docs, vocabulary, ["doc_id"]), vocabulary).select("doc_id", "ids", "bytes")
        assert Counter(map(repr, bpe.round_trip(docs, vocabulary, ["doc_id"], chunk_chars=300).collect())) == Counter(map(repr, plain.collect()))

    batch = pa.RecordBatch.from_arrays([pa.array([(chr(97 + i % 26) * 9_999 + " ") * 100 for i in range(40)])], names=["_text"])
    flat, starts, sizes = np.zeros(64, np.uint8), np.zeros(9, np.int64), np.full(9, 4)
    bpe._coded(["one two"], (0, 0), vocabulary.pattern, True)
    for work, most in ((lambda: sum(1 for _ in bpe._word_rows(iter([batch]), vocabulary.pattern, 1_000_000, 64)), 20e6), (lambda: bpe._gather(flat, starts, sizes, np.ones(1_000_000, np.int32)), 30e6)):
        tracemalloc.start()
        work()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < most
