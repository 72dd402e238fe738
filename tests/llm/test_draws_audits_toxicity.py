"""Resampling, divergence and toxicity against brute force, and on odd and empty tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import divergence, resampling, toxicity

TEXTS = ["One two TWO", "straße É漢字 x-y", "", "a", "...", "a b " * 3000, "\x00\x1cq\x7fr\x85s"]


# --- op11 -----------------------------------------------------------------------------------------------------------


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


@pytest.mark.parametrize("chunk", [16, 1000, 2_000_000])
def test_payloads(chunk):
    got = list(resampling.payloads([t.encode() for t in TEXTS], chunk))
    assert len(got) == len(TEXTS)
    for text, words in zip(TEXTS, got, strict=True):
        assert [(int(w) & 0xFFFFFFFF, int(w) >> 32) for w in words] == [(zlib.crc32(w.encode()), len(w.encode())) for w in words_of(text)]


@pytest.mark.parametrize("runs", [1, 2, 3])
def test_runs_compose(runs):
    for text, words in zip(TEXTS, resampling.payloads([t.encode() for t in TEXTS]), strict=True):
        w = words_of(text)
        want = [" ".join(w[i : i + k]) for k in range(1, runs + 1) for i in range(len(w) - k + 1)]
        assert [int(x) for x in resampling.features(words, runs)] == [zlib.crc32(x.encode()) for x in want]


def resampled(docs, target, d):
    """docs: (doc_id, text)."""
    count = lambda text: Counter(zlib.crc32(" ".join(w[i : i + k]).encode()) % d.buckets for w in [words_of(text)] for k in range(1, d.runs + 1) for i in range(len(w) - k + 1))
    every = [(i, count(t), len(words_of(t))) for i, t in docs]
    s, t = sum((c for _, c, _ in every), Counter()), sum((count(x) for x in target), Counter())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + d.buckets) / ((s[b] + 1) * (t.total() + d.buckets))))
    out = []
    for i, c, n in every:
        h = int(hashlib.sha256(f"{d.seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(b) * k for b, k in c.items())
        out.append([i, n, c.total(), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((x for x in out if x[1] >= d.least_words), key=lambda x: (-x[4], x[0] is None, x[0] or 0))
    for k, x in enumerate(able[: len(able) * d.percent // 100]):
        x[5] = k + 1
    return sorted(map(tuple, out), key=repr)


@pytest.mark.parametrize("d", [resampling.Draw(), resampling.Draw(runs=2, buckets=50, percent=40, least_words=2)])
def test_resample(spark, odd_docs, some_docs, sf, d):
    target = spark.read.parquet(f"{sf}/benchmark.parquet")
    wanted = [r.text for r in target.collect()]
    for docs in (odd_docs, some_docs):
        got = resampling.resample(docs, target, d)
        assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
        assert sorted(map(tuple, got.collect()), key=repr) == resampled([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], wanted, d)


def test_resample_empty(spark, no_docs, some_docs):
    none = spark.createDataFrame([], "text string, extra int")
    assert resampling.resample(no_docs, none).collect() == []
    got = resampling.resample(some_docs.limit(30), none).filter("rank is not null")
    assert got.count() == 30 * 10 // 100 or got.count() <= 3
    all_docs = resampling.resample(some_docs, none)
    kept = resampling.drawn(some_docs, all_docs)
    assert kept.columns == some_docs.columns and kept.count() == all_docs.filter("rank is not null").count() > 0


def test_resample_without_global_tasks(spark, some_docs, sf):
    """Ranks come from ranges: no window holds the documents' rows in one partition."""
    plan = resampling.scored(resampling.weighed(resampling.counted(some_docs, resampling.Draw()), [0] * 10_000), resampling.Draw())
    assert "SinglePartition" not in plan._jdf.queryExecution().toString()


# --- op12 -----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("n", "rounds"), [(0, 40), (1, 40), (500, 40), (3000, 40), (500, 2)])
def test_perfect_hash(n, rounds):
    keys = [f"wörd{i}".encode() for i in range(n)]
    size, bits, stored = divergence.build(keys, rounds)
    assert sorted(stored) == sorted(keys) and int(bits.sum()) <= n and (rounds < 40 or int(bits.sum()) == n)
    row = type("Row", (), {"lang": "en", "shard": 0, "n_shards": 1, "sizes": size, "bits": np.packbits(bits).tobytes(), "keys": [k.decode() for k in stored]})
    held = divergence.Held.of([row], ) if n else divergence.Held.of([])
    assert [stored[i] for i in held.find("en", keys)] == keys
    assert (held.find("en", [b"other%d" % i for i in range(2000)]) == -1).all() and (held.find("de", keys) == -1).all()


def audited(docs, a):
    term = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))
    df, n = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in docs:
        df[lang or ""].update(set(term(text or "")))
        n[lang or "", source or ""].update(term(text or ""))
    out = []
    for lang, found in df.items():
        kept = [w for w, k in found.items() if k >= a.least]
        groups = {s: c for (x, s), c in n.items() if x == lang}
        p_of = lambda c: {w: 1 + a.scale * (c[w] + a.smoothing) // (sum(c[x] for x in kept) + a.smoothing * len(kept)) for w in kept}  # noqa: E731, B023
        p, q = {s: p_of(c) for s, c in groups.items()}, p_of(sum(groups.values(), Counter()))
        for s in groups:
            pair = sorted(((sum(abs(p[s][w] - p[o][w]) for w in kept), o) for o in groups if o != s), key=lambda x: (-x[0], x[1].encode()))
            more = sorted(((p[s][w] - q[w], w) for w in kept if groups[s][w] and p[s][w] > q[w]), key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, s, "pair", o, v, k + 1) for k, (v, o) in enumerate(pair)] + [(lang, s, "term", w, v, k + 1) for k, (v, w) in enumerate(more[: a.top])]
    return sorted(out)


@pytest.mark.parametrize("a", [divergence.Audit(), divergence.Audit(least=2, top=3, shard_keys=40, block=2, held_bytes=40_000, held_keys=600, slots=4)])
def test_audit(spark, odd_docs, some_docs, a):
    extra = some_docs.limit(25) if a.block == 2 else some_docs
    for docs in (odd_docs, extra):
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        got = sorted(map(tuple, divergence.report(docs, a).collect()))
        assert got == audited([(r.text, r.lang, r.source) for r in docs.collect()], a)


def test_audit_empty(spark, no_docs):
    assert divergence.report(no_docs).collect() == []
    one = spark.createDataFrame([("only", "en", "s")], "text string, lang string, source string")
    assert divergence.report(one).collect() == []


# --- op13 -----------------------------------------------------------------------------------------------------------


def test_fold(spark):
    rows = spark.createDataFrame([(i,) for i in [0, 1, 17, 123456, None]], "doc_id long").select("doc_id", toxicity.fold(F.col("doc_id")).alias("f")).collect()
    assert [r.f for r in rows] == [zlib.crc32((str(r.doc_id) if r.doc_id is not None else "").encode()) % 5 for r in rows]


def test_features():
    lex = toxicity.Lexicon({"moron": 3.0, "vequ": 2.0})
    at = lambda t: dict(zip(toxicity.NAMES, toxicity.features(t, lex), strict=True))
    assert set(at(None).values()) == {0.0} and set(at("").values()) == {0.0}
    x = at("You utter MORON! Vequaire, morons? you")
    assert (x["hits"], x["weight"], x["strongest"], x["distinct"]) == (3, 8.0, 3.0, 3)
    assert x["second_person"] == 3 and x["exclamations"] == 1 / 6 and x["capital_words"] == 1 / 6
    for veiled in ("m0ron", "m-o-r-o-n", "mooooron", "M*oron"):
        assert at(f"a {veiled} b")["hits"] == 1 and at(f"a {veiled} b")["obfuscated_hits"] == 1
    assert at("4-2 a.b x")["hits"] == 0 and at("maroon more on")["hits"] == 0


def corpus(n=1200):
    r = random.Random(5)
    plain, rude = [f"wo{a}{b}" for a in "abcdefgh" for b in "klmnopqr"], ["zunte", "gripho", "veltaka"]
    rows, labels = [], []
    for i in range(n):
        bad = i % 6 == 0
        words = [r.choice(plain) for _ in range(r.randint(20, 200))]
        for _ in range(r.randint(2, 5) if bad else 0):
            words.insert(r.randrange(len(words)), r.choice(rude) + r.choice(["", "s", "lo"]))
        rows.append((i, " ".join(words), "x", None))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_toxicity_held_out(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame([*rows, (None, None, None, None), (5000, "", "x", "s"), rows[6], rows[7]], "doc_id long, text string, lang string, score string")
    known = spark.createDataFrame([*labels, (None, 1, 1), (9999, 0, 1), (5000, None, None), labels[6]], "doc_id long, quality int, toxic int")
    judge = toxicity.fit(docs, known, toxicity.Fit(rows=800))
    assert {"zunte", "gripho", "veltaka"} <= {e[:7] for e in judge.lexicon} and all(e.startswith(("zun", "gri", "vel")) for e in judge.lexicon)
    got = toxicity.score(docs, judge).collect()
    assert len(got) == len(rows) + 4 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    out = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 1200]
    assert len(out) > 200 and all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in out)
    assert sum(r.predicted == int(r.doc_id % 6 == 0) for r in out) >= 0.97 * len(out)
    assert all(r.predicted == 0 for r in got if r.doc_id in (None, 5000))


def test_toxicity_ignores_ids_and_sources(spark):
    rows, labels = corpus(300)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    judge = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    a = {r.doc_id: r.score for r in toxicity.score(docs, judge).collect()}
    b = {r.doc_id - 7: r.score for r in toxicity.score(docs.selectExpr("doc_id + 7 as doc_id", "text", "'q' as lang", "'z' as source"), judge).collect()}
    assert a == b


def test_toxicity_without_labels(spark, no_docs, odd_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    judge = toxicity.fit(odd_docs, none)
    assert {r.score < 0.01 for r in toxicity.score(odd_docs, judge).collect()} == {True}
    assert toxicity.score(no_docs, toxicity.fit(no_docs, none)).collect() == []


def test_toxicity_on_the_corpus(spark):
    sf = "/root/testdata/sf0.1"
    docs, known = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = toxicity.score(docs, toxicity.fit(docs, known)).filter("held_out").join(known, "doc_id").groupBy("toxic", "predicted").count().collect()
    n = {(r.toxic, r.predicted): r["count"] for r in got}
    assert n[1, 1] >= 0.9 * (n[1, 1] + n.get((1, 0), 0)) and n[0, 0] >= 0.99 * (n[0, 0] + n.get((0, 1), 0))
