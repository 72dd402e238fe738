"""URL filters by gradient-boosted trees on lexical features.

Fixed rules decide the urls they fit. Those are also the labelled urls: trees are trained on a bounded sample of them
and decide the others. Features are length, depth, digit ratio, entropy, parameter counts, and statistics of address
suffixes, domains and their sections: their share of all urls, and how many of their labelled urls, but those of the url's own fold, are blocked. All of it is native: features and trees are expressions.

Defined results: a null url, or one without ``://``, has empty host and path, fits no rule, and is judged by its
features; repeated rows are judged alike; a table without labelled urls allows what no rule decides; an empty table
gives no rows; extra columns are passed on.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import ascii_lower, sample_rows, write_table
from .boosting import Forest, train


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    allow: bool

    @property
    def name(self) -> str:
        return self.host + self.path


# The rules.
RULES = (Rule("com", "/", True), Rule("example.com", "/en/", False), Rule("www.example.com", "/en/", True), Rule("net", "/es/", False), Rule("net", "/fr/", False))

#: The last two labels, or three where a country's second-level label stands before its code.
DOMAIN = r"([^.]+\.(?:(?:ac|co|com|edu|gov|net|org)\.[a-z]{2}|[^.]+))$"

FEATURES = ["length", "host_length", "path_length", "depth", "labels", "digits", "entropy", "params", "value_length", "hyphens", "fragment", "secure", "suffix_log", "suffix_block", "domain_log", "domain_block", "section_log", "section_block"]


@dataclass(frozen=True)
class Filter:
    rules: tuple[Rule, ...] = RULES
    sample: int = 20_000  # labelled urls that train the trees
    smoothing: float = 20.0  # rows at the overall rate that every suffix is given


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def decided(rules: tuple[Rule, ...]) -> Column:
    """The longest rule that fits, as a struct of its name and verdict; null if none does."""
    out = None
    for r in sorted(rules, key=lambda r: (-len(r.name), r.name)):
        fits = ((F.col("host") == r.host) | F.endswith("host", F.lit("." + r.host))) & F.startswith("path", F.lit(r.path))
        value = F.struct(F.lit(r.name).alias("rule"), F.lit("allow" if r.allow else "block").alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out


def _entropy(text: Column) -> Column:
    """Shannon entropy of the characters, in bits."""
    n = F.length(text)
    share = lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n
    return F.when(n > 0, F.aggregate(F.array_distinct(F.split(text, "")), F.lit(0.0), lambda a, c: a + F.when(F.length(c) > 0, -share(c) * F.log2(share(c))).otherwise(F.lit(0.0)))).otherwise(F.lit(0.0))


def with_features(pages: DataFrame, url: str = "url") -> DataFrame:
    """Adds host, path, suffix, domain and the features that a url has by itself."""
    host, path = parts(F.col(url))
    df = pages.withColumns({"host": host, "path": path, "_url": F.coalesce(F.col(url), F.lit(""))})
    count = lambda c, name: (F.length(name) - F.length(F.regexp_replace(name, c, ""))).cast("double")
    query = F.regexp_extract("_url", r"\?([^#]*)", 1)
    return df.withColumns({
        "suffix": F.regexp_extract("host", r"([^.]*)$", 1), "domain": F.regexp_extract("host", DOMAIN, 1), "section": F.concat(F.regexp_extract("host", DOMAIN, 1), F.regexp_extract("path", r"^(/[^/]*)", 1)),
        "length": F.length("_url").cast("double"), "host_length": F.length("host").cast("double"), "path_length": F.length("path").cast("double"), "depth": count("/", "path"), "labels": count(r"\.", "host"),
        "digits": count("[0-9]", "_url") / F.greatest(F.length("_url"), F.lit(1)), "entropy": _entropy(F.col("_url")), "params": F.when(F.length(query) > 0, F.size(F.split(query, "&")).cast("double")).otherwise(F.lit(0.0)),
        "value_length": F.length(query).cast("double"), "hyphens": count("[-_]", "_url"), "fragment": F.contains("_url", F.lit("#")).cast("double"), "secure": F.startswith("_url", F.lit("https")).cast("double"),
    }).drop("_url")


NAMES = ("suffix", "domain", "section")
FOLDS = 4


def _suffix_table(found: DataFrame, key: str) -> DataFrame:
    """For each value of ``key`` how many urls have it, and by fold how many of these are labelled and how many of those blocked."""
    inside = [F.col("fold") == k for k in range(FOLDS)]
    labelled = F.array(*[F.count_if(x & F.col("verdict").isNotNull()) for x in inside])
    blocked = F.array(*[F.count_if(x & (F.col("verdict") == "block")) for x in inside])
    return write_table(found.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_n"), labelled.alias("_l"), blocked.alias("_b")), key)


def with_suffixes(found: DataFrame, total: int, rate: float, smoothing: float) -> DataFrame:
    """Adds the statistics of suffix, domain, and section (the domain with the path's first part): the logarithm of their share of all urls, and how many of their labelled urls are blocked.

    Urls are dealt to folds by a hash, and a url is judged by the labels of the other folds only: neither its own label nor that of
    another row with the same url can be read from its features. A table of counts has a row for each suffix; Spark broadcasts it
    if its files are below the session's threshold and else joins by sorted keys, splitting what is skewed.
    """
    df = found
    elsewhere = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x) - F.get(c, F.col("fold"))
    for x in NAMES:
        df = df.join(_suffix_table(found, x), F.col(x) == F.col("_key"))
        share = (elsewhere(F.col("_b")) + rate * smoothing) / (elsewhere(F.col("_l")) + smoothing)
        df = df.withColumns({f"{x}_log": F.log(F.col("_n") / total), f"{x}_block": share}).drop("_key", "_n", "_l", "_b")
    return df


def features(pages: DataFrame, config: Filter = Filter(), url: str = "url", keep: list[str] | None = None) -> DataFrame:
    """A written table: the columns of ``keep`` as ``_kept``, host, path, the rule's name and verdict, and all features."""
    bare = pages.select(F.struct(*[F.col(f"`{c}`") for c in keep or []], F.lit(0).alias("_none")).alias("_kept"), F.col(f"`{url}`").alias("_address"))
    found = with_features(bare, "_address").withColumn("_d", decided(config.rules))
    fold = F.pmod(F.xxhash64("_address"), F.lit(FOLDS)).cast("int")
    found = found.select("_kept", "host", "path", fold.alias("fold"), *NAMES, *FEATURES[:12], F.col("_d.rule").alias("rule"), F.col("_d.verdict").alias("verdict"))
    found = write_table(found, "features")
    all_urls = found.agg(F.count("*").alias("n"), F.count("verdict").alias("l"), F.count_if(F.col("verdict") == "block").alias("b")).first()
    return with_suffixes(found, max(1, all_urls.n), all_urls.b / all_urls.l if all_urls.l else 0.0, config.smoothing)


def fit(found: DataFrame, config: Filter = Filter()) -> Forest:
    """Trees from a bounded sample of the labelled urls, those that a rule decides."""
    sample = found.filter("rule is not null").withColumn("label", (F.col("verdict") == "block").cast("double"))
    sample = sample_rows(sample.select("host", "path", "label", *FEATURES), config.sample).select("label", *FEATURES)
    return train(write_table(sample, "sample"), FEATURES)


def judge(pages: DataFrame, config: Filter = Filter(), url: str = "url", key: str = "page_id") -> DataFrame:
    """Adds host, path, rule, verdict, and ``score`` (of the trees; above zero blocks) in place of the other columns but ``key``."""
    found = features(pages, config, url, [key])
    score = fit(found, config).column()
    verdict = F.coalesce("verdict", F.when(score > 0, F.lit("block")).otherwise(F.lit("allow")))
    return found.select(F.col(f"_kept.`{key}`").alias(key), "host", "path", "rule", verdict.alias("verdict"), score.alias("score"))
