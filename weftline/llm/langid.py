"""Language identification of pages by Bayesian evidence fusion.

Four kinds of evidence are added as logarithms: how likely each language makes the page's text (hashed character
trigrams), the declared markup language, the address suffix, and a prior of the page's host that is smoothed by its
domain's, and that by all pages'. The trigram tables are fitted on a bounded sample of labelled documents; everything
else is grouped counts over all pages, with the text's own verdict in the place of the unknown truth and a page's own
count taken out of its host's.

A column of labels may hold junk, so only the languages with most documents have a table (``languages``, ties to the lesser name), and
the others are no answers; tables take at most ``languages`` times ``buckets`` numbers, whatever the labels hold.

Defined results: a null or empty page has no text evidence and goes by the other three; no declaration and no host are
values of their own; without labelled documents nothing is known and the language is null; repeated rows are judged
alike; an empty table gives no rows; extra columns are ignored by ``identify``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.html import raw_text
from ._shared import write_table
from .urls import DOMAIN, parts


@dataclass(frozen=True)
class Fusion:
    sample: int = 4000  # labelled documents that fit the trigram tables, about; languages have their shares of them
    each: int = 200  # but so many of every language at least, or all it has
    languages: int = 200  # that have a table: those with most documents, as the tables are part of each task
    buckets: int = 16_384
    smoothing: float = 0.5  # added to each trigram bucket
    temper: float = 0.2  # of the text's log-likelihood: trigrams overlap and are no independent witnesses
    host_weight: float = 8.0  # pages at the domain's rates that each host is given; likewise domains at all pages' rates


def _trigrams(text: str, buckets: int):
    """Bucket numbers of the lower-cased text's trigrams; runs of anything but letters are one space."""
    import re

    import numpy as np

    s = " " + re.sub(r"[\W\d_]+", " ", text.lower()).strip() + " "
    c = np.frombuffer(s.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    if len(c) < 3:
        return np.empty(0, dtype=np.int64)
    h = c[:-2] * np.uint64(0x9E3779B1) ^ c[1:-1] * np.uint64(0x85EBCA77) ^ c[2:] * np.uint64(0xC2B2AE3D)
    return ((h ^ (h >> np.uint64(15))) % np.uint64(buckets)).astype(np.int64)


@dataclass(frozen=True)
class TextModel:
    languages: tuple[str, ...]
    table: object  # numpy, languages x buckets: log-probabilities
    config: Fusion

    def scores(self, text: str | None) -> list[float]:
        at = _trigrams(text or "", self.config.buckets)
        return (self.config.temper * self.table[:, at].sum(axis=1)).tolist()


def fit_text(docs: DataFrame, config: Fusion = Fusion(), text: str = "text", lang: str = "lang") -> TextModel:
    """Trigram tables from those labelled documents of each language that come first by a hash; the ``languages`` with most documents have a
    table. Rows beyond a bound that leaves half as many again go where they are read, so that only samples are ranked. Counts of a language's buckets come back: languages times buckets, whatever the sample holds."""
    import numpy as np

    buckets = config.buckets
    known = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    more = [F.col("doc_id")] if "doc_id" in docs.columns else []  # copies of a text are then told apart
    known = known.select(F.col(lang).alias("lang"), F.col(text).alias("text"), *more)
    held = {x["lang"]: x["count"] for x in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(config.languages).collect()}
    total = sum(held.values())
    wanted = {x: max(config.each, -(-config.sample * n // total)) for x, n in held.items()}
    below = {x: int(2**63 * min(1.0, 1.5 * wanted[x] / n)) - 1 if n > 2 * wanted[x] else 2**63 - 1 for x, n in held.items()}
    of = lambda values: F.create_map(*[F.lit(y) for x in values.items() for y in x])[F.col("lang")] if values else F.lit(0)
    known = known.filter(F.col("lang").isin(*held)) if held else known.limit(0)
    near = known.withColumn("h", F.shiftrightunsigned(F.xxhash64(*known.columns), 1)).filter(F.col("h") <= of(below))
    sample = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).filter(F.col("rank") <= of(wanted)).select("lang", "text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict = {}
        for batch in batches:
            for x, t in zip(batch.lang, batch.text, strict=True):
                sums[x] = sums.get(x, 0) + np.bincount(_trigrams(t, buckets), minlength=buckets)
        for x, n in sums.items():
            at = np.flatnonzero(n)
            yield pd.DataFrame({"lang": x, "bucket": at, "n": n[at]})

    counts = write_table(sample, "sample").mapInPandas(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = tuple(sorted(counts.lang.unique()))
    table = np.full((len(languages), buckets), config.smoothing)
    for i, x in enumerate(languages):
        own = counts[counts.lang == x]
        table[i, own.bucket.to_numpy()] += own.n.to_numpy()
    return TextModel(languages, np.log(table / table.sum(axis=1, keepdims=True)), config)


def declared(html: Column) -> Column:
    """The primary part of the html element's lang, lower-cased; an empty string without one."""
    return F.lower(F.coalesce(F.regexp_extract(html, r"""(?is)<html\b[^>]*?\blang\s*=\s*["']?([a-zA-Z]+)""", 1), F.lit("")))


def identify(pages: DataFrame, model: TextModel, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """A row for each page: ``key``, lang, confidence, and the evidence by itself: text_lang, declared, host."""
    config, langs = model.config, model.languages
    if not langs:
        none = F.lit(None).cast("string")
        return pages.select(key, none.alias("lang"), F.lit(0.0).alias("confidence"), none.alias("text_lang"), declared(F.col(html)).alias("declared"), parts(F.col(url))[0].alias("host"))

    @F.pandas_udf("array<double>")
    def text_scores(texts: pd.Series) -> pd.Series:
        return pd.Series([model.scores(x) for x in texts], dtype=object)

    host, _ = parts(F.col(url))
    scored = pages.select(key, host.alias("host"), declared(F.col(html)).alias("declared"), text_scores(raw_text(F.col(html))).alias("t"))
    best = F.array_position("t", F.array_max("t")).cast("int")
    some = F.array_max("t") > F.array_min("t") if len(langs) > 1 else F.lit(True)
    scored = scored.withColumns({"suffix": F.regexp_extract("host", r"([^.]*)$", 1), "domain": F.regexp_extract("host", DOMAIN, 1), "v": F.when(some, best).otherwise(F.lit(0))})
    scored = write_table(scored, "evidence")
    total = [F.count_if(F.col("v") == i + 1).cast("double").alias(f"n{i}") for i in range(len(langs))]
    counts = lambda k: write_table(scored.groupBy(F.col(k).alias(f"_{k}")).agg(F.array(*total).alias(f"c_{k}")), k)
    all_pages = scored.agg(*total).first()
    n_all = sum(all_pages) + len(langs)
    base = [(x + 1) / n_all for x in all_pages]
    df = scored
    for k in ("declared", "suffix", "domain", "host"):
        df = df.join(counts(k), F.col(k) == F.col(f"_{k}"))
    size = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    w = config.host_weight
    logs = []
    for i in range(len(langs)):
        own = F.when(F.col("v") == i + 1, F.lit(1.0)).otherwise(F.lit(0.0))
        held = F.when(F.col("v") > 0, F.lit(1.0)).otherwise(F.lit(0.0))
        rate = lambda k, above, i=i, own=own, held=held: (F.get(f"c_{k}", F.lit(i)) - own + w * above) / (size(F.col(f"c_{k}")) - held + w)
        prior = rate("host", rate("domain", F.lit(base[i])))
        # What a declaration or a suffix says beyond the share of the language among all pages.
        said = rate("declared", F.lit(base[i])) / base[i]
        ends = rate("suffix", F.lit(base[i])) / base[i]
        logs.append(F.get("t", F.lit(i)) + F.log(F.greatest(prior, F.lit(1e-12))) + F.log(F.greatest(said, F.lit(1e-12))) + F.log(F.greatest(ends, F.lit(1e-12))))
    df = df.select(key, "declared", "host", "v", F.array(*logs).alias("post"))
    top = F.array_max("post")
    name = lambda at: F.get(F.array(*map(F.lit, langs)), at - 1)
    return df.select(key, name(F.array_position("post", top).cast("int")).alias("lang"), (1 / F.aggregate("post", F.lit(0.0), lambda a, x: a + F.exp(x - top))).alias("confidence"), F.when(F.col("v") > 0, name(F.col("v"))).alias("text_lang"), "declared", "host")
