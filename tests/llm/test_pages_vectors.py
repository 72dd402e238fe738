"""The operators on pages and vectors against brute-force versions."""

import math
import re

import numpy as np
import pytest

from weftline.llm import embeddings, langid, queries, urls

PAGES = "page_id long, url string, html string, host string"


@pytest.fixture(scope="module")
def odd_pages(spark, tmp_path_factory):
    found = [
        None, "", "no scheme", "http://", "https://Example.COM/en/x?a=1&b=2#f", "http://www.example.com/en/", "http://a.www.example.com/en/1", "http://example.com", "http://b.net/fr/x", "http://net/es/", "http://NET?es/",
        "ftp://x.org/es/://y", "http://notexample.com/en/", "http://EXAMPLE.com/EN/", "http://exämple.NET/es/é", "http://h.net#/es/",
    ]
    rows = [(i, u, None if i % 5 == 0 else "<html lang='DE-at'><p>der die und das ist</p>", "clash") for i, u in enumerate(found)] + [(4, found[4], "", None), (4, found[4], "", None), (None, found[5], "x", "y")]
    path = str(tmp_path_factory.mktemp("odd") / "pages.parquet")
    spark.createDataFrame(rows, PAGES).write.parquet(path)
    return spark.read.parquet(path)


def brute_rule(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in urls.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.name), default=None)
    return host, path, best and best.name, best and ("allow" if best.allow else "block")


def test_url_rules(spark, sf, odd_pages):
    for pages in (odd_pages, spark.read.parquet(f"{sf}/pages.parquet"), odd_pages.limit(0)):
        want = sorted(((p.page_id, *brute_rule(p.url)) for p in pages.collect()), key=repr)
        got = urls.judge(pages).collect()
        assert sorted(((r.page_id, r.host, r.path, r.rule, r.verdict if r.rule else None) for r in got), key=repr) == want
        assert all(r.verdict in ("allow", "block") for r in got)


def test_url_features(odd_pages):
    for r in urls.with_features(odd_pages.drop("host")).collect():
        u = r.url or ""
        assert r.length == len(u) and r.depth == r.path.count("/")
        assert r.entropy == pytest.approx(-sum(u.count(c) / len(u) * math.log2(u.count(c) / len(u)) for c in set(u)) if u else 0)


def test_url_trees_learn(spark):
    """Held-out accuracy: trees fitted on every second url that a rule decides say the same of the others; the others' labels are not
    among the counts either."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    forest = urls.fit(urls.features(pages.filter("page_id % 2 = 0")))
    rest = urls.features(pages.filter("page_id % 2 = 1"), keep=["page_id"]).filter("rule is not null").withColumn("score", forest.column()).collect()
    assert len(rest) > 50
    assert sum((r.score > 0) == (r.verdict == "block") for r in rest) / len(rest) > 0.9


def test_url_labels_of_the_own_fold_are_left_out(spark):
    rows = [("http://a.net/es/x",), ("http://a.net/es/x",), ("http://b.co.uk/z",), ("http://b.co.uk/z",)]
    got = urls.features(spark.createDataFrame(rows, "url string"), urls.Filter(smoothing=1.0)).collect()
    assert {r.domain for r in got} == {"a.net", "b.co.uk"}
    assert all(r.domain_block == 1.0 for r in got)  # the rate alone: both labels of a.net are of one fold
    mixed = [(f"http://c{i % 3}.net/{'es' if i % 2 else 'x'}/{i}",) for i in range(300)]
    got = urls.features(spark.createDataFrame(mixed, "url string")).filter("rule is not null").collect()
    assert len({(r.domain, r.fold, r.domain_block) for r in got}) == len({(r.domain, r.fold) for r in got})


def brute_links(rows, cosine=0.9):
    def usable(e):
        return e is not None and len(e) and all(x is not None and math.isfinite(x) for x in e) and any(e)

    n = len(rows)
    unit = [np.array(e, np.float64) / np.linalg.norm(np.array(e, np.float64)) if usable(e) else None for _, e in rows]
    linked = [[j for j in range(n) if j != i and unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine] for i in range(n)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in linked[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        root = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((rows[i][0], len(linked[i]), root, root is not None and rows[i][0] == root))
    return sorted(out, key=repr)


def test_vector_links(spark, tmp_path):
    r = np.random.default_rng(4)
    centres = r.standard_normal((12, 16))
    rows = [(int(i), [float(x) for x in np.float32(centres[i % 12] + 0.08 * r.standard_normal(16))]) for i in range(150)]
    rows += [(200 + i, [float(x) for x in np.float32(r.standard_normal(16))]) for i in range(100)]
    rows += [(300, rows[0][1]), (301, rows[0][1]), (0, rows[0][1]), (None, rows[0][1]), (302, None), (303, [0.0] * 16), (304, [float("nan")] + [1.0] * 15), (305, [None] + [1.0] * 15), (306, [float("inf")] * 16), (307, []), (308, [1.0, 2.0]), (309, [2.0, 4.0]), (310, [0.0, 1.0]), (311, [-0.0, 1.0])]
    spark.createDataFrame([(a, b, "z") for a, b in rows], "vec_id long, embedding array<float>, links string").write.parquet(str(tmp_path / "v"))
    vectors = spark.read.parquet(str(tmp_path / "v"))
    for config in (embeddings.PStable(miss=1e-6), embeddings.PStable(miss=1e-6, block=16)):
        got = sorted(((x.vec_id, x.n_links, x.component_id, x.kept) for x in embeddings.link(vectors, config).collect()), key=repr)
        assert got == brute_links(rows)
    assert embeddings.link(vectors.limit(0)).collect() == []


def test_vector_recall(spark):
    """Links near the threshold itself are found as surely as the parameters say."""
    r = np.random.default_rng(8)
    a = r.standard_normal((400, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = r.standard_normal((400, 64))
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    c = 0.903 * a + math.sqrt(1 - 0.903**2) * b
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(np.concatenate([a, c]))]
    got = embeddings.link(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    want = sum(x[1] for x in brute_links(rows))
    assert got.agg({"n_links": "sum"}).first()[0] >= 0.95 * want


def test_languages(spark, sf, odd_pages):
    model = langid.fit_text(spark.read.parquet(f"{sf}/documents.parquet"))
    assert model.languages == ("de", "en", "es", "fr")
    got = langid.identify(odd_pages, model).collect()
    assert len(got) == odd_pages.count() and all(r.lang in model.languages and 0 < r.confidence <= 1 for r in got)
    assert all(r.lang == "de" for r in got if r.text_lang == "de")
    assert langid.identify(odd_pages.limit(0), model).collect() == []
    none = langid.fit_text(spark.read.parquet(f"{sf}/documents.parquet").limit(0))
    assert {r.lang for r in langid.identify(odd_pages, none).collect()} == {None}


def test_language_accuracy(spark):
    """Held out: pages' declared languages are the truth, and are hidden for every second page."""
    got = queries.op8_language_fusion(spark, "/root/testdata/sf0.01").collect()
    assert sum(r.lang == r.declared for r in got) / len(got) > 0.95
    model = langid.fit_text(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").selectExpr("page_id", "url", "case when page_id % 2 = 0 then replace(html, '<html lang=', '<html x=') else html end as html", "regexp_extract(html, 'lang=\"(..)', 1) as truth")
    hidden = langid.identify(pages, model).join(pages.select("page_id", "truth"), "page_id").filter("page_id % 2 = 0").collect()
    assert all(r.declared == "" for r in hidden)
    assert sum(r.lang == r.truth for r in hidden) / len(hidden) > 0.9


def brute_fusion(pages, model):
    """The sum of the four kinds of evidence, page by page."""
    import re as r

    config, langs = model.config, model.languages
    seen = []
    for p in pages:
        host = brute_rule(p.url)[0]
        m = r.search(r"""(?is)<html\b[^>]*?\blang\s*=\s*["']?([a-zA-Z]+)""", p.html or "")
        m2 = r.search(urls.DOMAIN, host)
        seen.append({"page_id": p.page_id, "host": host, "declared": m[1].lower() if m else "", "suffix": host.rsplit(".", 1)[-1], "domain": m2[1] if m2 else "", "t": p.t})
        t = p.t
        seen[-1]["v"] = t.index(max(t)) if max(t) > min(t) else None
    n = [sum(x["v"] == i for x in seen) for i in range(len(langs))]
    base = [(x + 1) / (sum(n) + len(langs)) for x in n]
    out, w = [], config.host_weight
    for x in seen:
        others = [y for y in seen if y is not x and y["v"] is not None]
        rate = lambda k, i, above: (sum(y[k] == x[k] and y["v"] == i for y in others) + w * above) / (sum(y[k] == x[k] for y in others) + w)  # noqa: E731, B023
        post = [x["t"][i] + math.log(rate("host", i, rate("domain", i, base[i]))) + math.log(rate("declared", i, base[i]) / base[i]) + math.log(rate("suffix", i, base[i]) / base[i]) for i in range(len(langs))]
        out.append((x["page_id"], langs[post.index(max(post))], 1 / sum(math.exp(y - max(post)) for y in post)))
    return out


def test_fusion_matches_brute_force(spark, sf, odd_pages):
    from pyspark.sql import functions as F

    from weftline.functions.html import raw_text

    model = langid.fit_text(spark.read.parquet(f"{sf}/documents.parquet"))
    for pages in (odd_pages, spark.read.parquet(f"{sf}/pages.parquet").limit(150)):
        texts = pages.select("page_id", "url", "html", raw_text(F.col("html")).alias("text")).collect()

        class Page:
            def __init__(self, x):
                self.page_id, self.url, self.html, self.t = x.page_id, x.url, x.html, model.scores(x.text)

        want = sorted(brute_fusion([Page(x) for x in texts], model), key=repr)
        got = sorted(((x.page_id, x.lang, x.confidence) for x in langid.identify(spark.createDataFrame([(x.page_id, x.url, x.html) for x in texts], "page_id long, url string, html string"), model).collect()), key=repr)
        assert [x[:2] for x in got] == [x[:2] for x in want]
        assert [x[2] for x in got] == pytest.approx([x[2] for x in want], rel=1e-9)


def test_vectors_with_clashing_names(spark):
    rows = [(1, [1.0, 0.0], "own"), (2, [1.0, 0.1], "own"), (3, None, "own")]
    for name in ("h", "e", "n", "t", "b", "id", "row", "links", "n_links"):
        got = embeddings.link(spark.createDataFrame(rows, f"vec_id long, embedding array<float>, {name} string"))
        assert [(x.vec_id, x.n_links, x.component_id, x.kept) for x in got.orderBy("vec_id").collect()] == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]


def test_rare_languages_have_tables(spark):
    rows = [(i, "common words of the many", "aa") for i in range(3000)] + [(3000 + i, "seltene Worte der wenigen", "bb") for i in range(2)] + [(4000, "mots uniques", "cc")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert langid.fit_text(docs, langid.Fusion(sample=20, each=10)).languages == ("aa", "bb", "cc")


def test_languages_with_junk_labels(spark):
    """Only the languages with most documents have a table, ties by name; pages never get another one."""
    names = ["aa"] * 5 + ["bb"] * 4 + ["cc"] * 4 + ["dd"] * 4 + [f"x{i}" for i in range(30)] + [None]
    docs = spark.createDataFrame([(i, x, f"{x} word {x}{x}") for i, x in enumerate(names)], "doc_id long, lang string, text string")
    model = langid.fit_text(docs, langid.Fusion(languages=3))
    assert model.languages == ("aa", "bb", "cc") and model.table.shape == (3, langid.Fusion().buckets)
    pages = spark.createDataFrame([(1, "https://h.aa/", "<p>dd word dddd"), (2, None, None)], "page_id long, url string, html string")
    assert {r.lang for r in langid.identify(pages, model).collect()} <= {"aa", "bb", "cc"}


def test_vectors_sent_where_sketches_are_near(spark):
    """Vectors with no other near them are sent nowhere; those of a group are, and no link is lost by sketches."""
    import numpy as np

    from weftline.llm import _shared

    config, rng = embeddings.PStable(miss=1e-6, block=64), np.random.default_rng(3)
    lone, centre = rng.standard_normal((600, 64)), rng.standard_normal(64)
    group = centre + 0.2 * rng.standard_normal((100, 64))
    rows = [(i, x.tolist()) for i, x in enumerate(np.vstack([lone, group]).astype(np.float32))]
    got = {r.vec_id: r.n_links for r in embeddings.link(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), config).collect()}
    near = spark.read.parquet([p for p in _shared._written if p.endswith("/near")][-1])
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert [got[i] for i in range(len(rows))] == ((x @ x.T >= 0.9).sum(axis=1) - 1).tolist()
    assert near.select("h").distinct().count() <= 110
    p = np.arccos(0.9) / np.pi
    draws = rng.binomial(256, p, 1_000_000)
    assert draws.max() <= config.differing() < 100
