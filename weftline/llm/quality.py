"""Quality rules by robust multivariate outliers.

Every text gets a few counts; ratios of them are transformed to be roughly normal, and minimum-covariance-determinant
estimates of centre and scatter are made for each language and source, for each language, and for all. A document is
rejected when its Mahalanobis distance from the finest group with enough documents is beyond a cut-off, or when it
fails the two base rules. Everything is DataFrame expressions: the estimates are grouped sums, the concentration
steps are passes over a narrow table of statistics, and only one row per group is joined back.

Defined results: a null or empty text has no words and fails the base rules; null languages and sources are groups
of their own; repeated rows are judged alike and each kept; an empty table gives no rows; extra columns are ignored by
``judge`` and passed on by ``keep_good``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import let, words_of, write_table

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
STATS = ["z0", "z1", "z2", "z3", "z4", "z5"]
#: Least standard deviation of each transformed statistic: most texts have none of some of them at all.
FLOORS = [0.05, 0.05, 0.15, 0.15, 0.05, 0.05]
LEVELS = 3


@dataclass(frozen=True)
class RobustRules:
    min_words: int = 50
    most_repeated: int = 50  # per cent of the words that may lie in repeated windows
    core: float = 0.75  # share of a group that each concentration step keeps
    steps: int = 3
    min_rows: int = 200  # smaller groups are judged by their language, then by all documents
    fence: float = 3.0  # quartile ranges of the logarithm of a group's distances beyond its upper quartile
    least_spread: float = 0.82  # of these quartile ranges: that of chi-square
    few_groups: int = 10_000  # so many rows of estimates, some 4 MB, may be sent to every task
    salts: int = 64  # tasks to which a group's rows are dealt where there are more groups
    short_slack: float = 10.0  # the cut-off grows by this over the number of words: ratios of short texts scatter more


def _count(text: Column, char_class: str) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, char_class, ""))).cast("long")


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more: sorted window hashes show the repeats, their starts the cover."""
    n = F.size(words)
    windows = let(words, lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))))

    def cover(hashes: Column) -> Column:
        placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        repeated = let(placed, lambda s: F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"])))
        starts = F.array_sort(F.transform(repeated, lambda x: x["i"]))
        zero = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
        return F.aggregate(starts, zero, lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n")), lambda a: a["n"])

    found = let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(cover(h)))
    return F.when(n < 4, F.lit(0)).otherwise(found).cast("long")


def with_counts(docs: DataFrame, rules: RobustRules = RobustRules(), text: str = "text") -> DataFrame:
    """Adds the base counts, ``base_failed`` and ``_q``, a struct of what the transformed statistics need."""
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = docs.withColumn("_words", words_of(F.col(text))).withColumn("_lines", lines)
    df = df.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_symbols": _count(body, r"[#*$%&|<>]"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": _repeat_words(F.col("_words")),
        "_q": F.struct(F.size("_lines").alias("lines"), _count(body, "[A-Z]").alias("upper"), _count(body, r"[!-/:-@\[-`{-~]").alias("marks")),
    })
    failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.most_repeated * F.col("n_words"))
    return df.drop("_words", "_lines").withColumn("base_failed", failed)


def with_stats(counts: DataFrame) -> DataFrame:
    """The transformed statistics: log mean word length, and arcsine roots of the shares."""
    share = lambda a, b: F.asin(F.sqrt(F.least(F.lit(1.0), a / F.greatest(b, F.lit(1)))))
    chars, n = F.col("word_chars"), F.col("n_words")
    values = [F.log((chars + 5) / (n + 1)), share(F.col("n_symbols"), chars), share(F.col("n_dup_lines"), F.col("_q.lines")), share(F.col("n_repeat_words"), n), share(F.col("_q.upper"), chars), share(F.col("_q.marks"), chars)]
    return counts.withColumns(dict(zip(STATS, values, strict=True)))


def _levels(lang: str, source: str) -> list[Column]:
    """Keys from fine to coarse. JSON drops nulls, so that a null is not an empty name."""
    return [F.to_json(F.struct(F.col(lang).alias("lang"), F.col(source).alias("source"))), F.concat(F.lit("lang"), F.to_json(F.struct(F.col(lang).alias("lang")))), F.lit("all")]


def _chi2(p: int, z: float) -> float:
    """A quantile of chi-square by Wilson and Hilferty; z: the normal quantile."""
    return p * (1 - 2 / (9 * p) + z * (2 / (9 * p)) ** 0.5) ** 3


def _factor(df: DataFrame) -> DataFrame:
    """The Cholesky factor l_i_j of the covariance c_i_j, one column after the other."""
    for j in range(len(STATS)):
        rest = sum((F.col(f"l_{j}_{k}") * F.col(f"l_{j}_{k}") for k in range(j)), F.lit(0.0))
        df = df.withColumn(f"l_{j}_{j}", F.sqrt(F.greatest(F.col(f"c_{j}_{j}") - rest, F.lit(1e-9))))
        df = df.withColumns({f"l_{i}_{j}": (F.col(f"c_{i}_{j}") - sum((F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}") for k in range(j)), F.lit(0.0))) / F.col(f"l_{j}_{j}") for i in range(j + 1, len(STATS))})
    return df.drop(*[f"c_{i}_{j}" for i in range(len(STATS)) for j in range(i + 1)])


def _with_distance(df: DataFrame) -> DataFrame:
    """The squared Mahalanobis distance by forward substitution."""
    for i, x in enumerate(STATS):
        df = df.withColumn(f"_y{i}", (F.col(x) - F.col(f"m_{i}") - sum((F.col(f"l_{i}_{j}") * F.col(f"_y{j}") for j in range(i)), F.lit(0.0))) / F.col(f"l_{i}_{i}"))
    return df.withColumn("d2", sum((F.col(f"_y{i}") * F.col(f"_y{i}") for i in range(len(STATS))), F.lit(0.0))).drop(*[f"_y{i}" for i in range(len(STATS))])


BINS = 24  # of the logarithm of one plus the squared distance, to each unit


def _quantiles(distances: DataFrame, shares: list[float]) -> DataFrame:
    """(level, key, cut: array of bins): for each share the bin below whose end so much of the group lies.

    Counts by bin are written before they meet: a group then has as many rows as bins, whatever it holds.
    """
    counts = write_table(distances.groupBy("level", "key", F.floor(F.log1p("d2") * BINS).alias("bin")).agg(F.count("*").alias("n")), "bins")
    groups = counts.groupBy("level", "key").agg(F.array_sort(F.collect_list(F.struct("bin", "n"))).alias("bins"), F.sum("n").alias("all"))

    def cut(share: float) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("at"))

        def step(a: Column, x: Column) -> Column:
            n = a["n"] + x["n"]
            return F.struct(n.alias("n"), F.coalesce(a["at"], F.when(n >= share * F.col("all"), x["bin"])).alias("at"))

        return F.aggregate("bins", start, step, lambda a: a["at"])

    return groups.select("level", "key", F.array(*map(cut, shares)).alias("cut"))


def _meet(rows: DataFrame, groups: DataFrame, on: list[str], rules: RobustRules, how: str = "inner") -> DataFrame:
    """Rows of statistics beside their group's row, which is in a written table.

    So few groups as ``few_groups``, counted here, go to every task. More are met by key and salt, each group's row being repeated for
    every salt, so that the rows of one group, however many, are dealt to that many tasks.
    """
    if groups.count() <= rules.few_groups:
        return rows.join(F.broadcast(groups), on, how)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*STATS), F.lit(rules.salts)).cast("int"))
    repeated = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(rules.salts - 1))))
    return salted.join(repeated, [*on, "_salt"], how).drop("_salt")


def fit(stats: DataFrame, rules: RobustRules = RobustRules(), lang: str = "lang", source: str = "source") -> DataFrame:
    """Minimum-covariance-determinant estimates: a written table with a row for each group of each level.

    Starts from medians and quartile ranges; each step takes the moments of the ``core`` share nearest to the centre. ``scale`` brings
    the median distance to that of chi-square; ``most`` is the group's own fence (see RobustRules).
    """
    p = len(STATS)
    keys = F.explode(F.array(*[F.struct(F.lit(i).alias("level"), k.alias("key")) for i, k in enumerate(_levels(lang, source))]))
    rows = stats.filter(~F.col("base_failed")).select(keys.alias("g"), *STATS).select("g.*", *STATS)
    start = rows.groupBy("level", "key").agg(F.count("*").alias("n"), *[F.percentile_approx(x, [0.25, 0.5, 0.75], 2000).alias(f"q_{i}") for i, x in enumerate(STATS)])
    start = start.filter((F.col("n") >= rules.min_rows) | (F.col("level") == LEVELS - 1))
    spread = lambda i: F.col(f"q_{i}")[2] - F.col(f"q_{i}")[0]
    means = [f"m_{i}" for i in range(p)]
    model = start.select("level", "key", "n", *[F.col(f"q_{i}")[1].alias(f"m_{i}") for i in range(p)], *[F.pow(spread(i) / 1.349, 2).alias(f"v_{i}") for i in range(p)])
    model = model.select("level", "key", "n", *means, *[(F.col(f"v_{i}") + FLOORS[i] ** 2 if i == j else F.lit(0.0)).alias(f"c_{i}_{j}") for i in range(p) for j in range(i + 1)])
    model = write_table(_factor(model), "start")
    group = ["level", "key"]
    for step in range(rules.steps):
        cut = _quantiles(_with_distance(_meet(rows, model, group, rules)), [rules.core])
        bounded = write_table(model.join(cut, group), f"cut{step}")
        core = _with_distance(_meet(rows, bounded, group, rules)).filter(F.floor(F.log1p("d2") * BINS) <= F.col("cut")[0])
        moments = [F.avg(F.col(STATS[i]) * F.col(STATS[j])).alias(f"s_{i}_{j}") for i in range(p) for j in range(i + 1)]
        sums = core.groupBy(*group).agg(F.first("n").alias("n"), *[F.avg(x).alias(f"m_{i}") for i, x in enumerate(STATS)], *moments)
        cov = lambda i, j: F.col(f"s_{i}_{j}") - F.col(f"m_{i}") * F.col(f"m_{j}") + (FLOORS[i] ** 2 if i == j else 0.0)
        model = write_table(_factor(sums.select(*group, "n", *means, *[cov(i, j).alias(f"c_{i}_{j}") for i in range(p) for j in range(i + 1)])), f"model{step}")
    cuts = _quantiles(_with_distance(_meet(rows, model, group, rules)), [0.25, 0.5, 0.75])
    log = lambda k: (F.col("cut")[k] + 0.5) / BINS  # noqa: E731  of one plus the squared distance
    scale = F.greatest(F.expm1(log(1)) / _chi2(p, 0.0), F.lit(0.2))
    fence = F.expm1(log(2) + rules.fence * F.greatest(log(2) - log(0), F.lit(rules.least_spread)))
    return write_table(model.join(cuts, group).withColumn("scale", scale).withColumn("most", fence / scale).drop("cut"), "model")


def score(stats: DataFrame, model: DataFrame, rules: RobustRules = RobustRules(), lang: str = "lang", source: str = "source") -> DataFrame:
    """Adds ``distance`` (scaled and squared, null where base_failed or no model) and ``kept``."""
    fine, middle, coarse = _levels(lang, source)
    df = stats.withColumns({"_k0": fine, "_k1": middle})
    for level in (0, 1):
        known = model.filter(F.col("level") == level).select(F.col("key").alias(f"_k{level}"), F.lit(True).alias(f"_h{level}"))
        df = _meet(df, known, [f"_k{level}"], rules, "left")
    key = lambda level, k: F.struct(F.lit(level).alias("level"), k.alias("key"))
    df = df.withColumn("_key", F.when(F.col("_h0"), key(0, F.col("_k0"))).when(F.col("_h1"), key(1, F.col("_k1"))).otherwise(key(2, coarse)))
    p = len(STATS)
    model = model.select(F.struct("level", "key").alias("_key"), "scale", "most", *[f"m_{i}" for i in range(p)], *[f"l_{i}_{j}" for i in range(p) for j in range(i + 1)])
    df = _with_distance(_meet(df, model, ["_key"], rules, "left")).withColumn("distance", F.when(~F.col("base_failed"), F.col("d2") / F.col("scale")))
    limit = F.col("most") * (1 + rules.short_slack / F.greatest(F.col("n_words"), F.lit(1)))
    return df.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance") <= limit, F.lit(True)))


def judge(docs: DataFrame, rules: RobustRules = RobustRules()) -> DataFrame:
    """A row for each document: doc_id, the base counts, base_failed, kept, distance."""
    stats = write_table(with_stats(with_counts(docs.select("doc_id", "text", "lang", "source"), rules)).drop("text"), "statistics")
    return score(stats, fit(stats, rules), rules).select("doc_id", *BASE, "base_failed", "kept", "distance")


def keep_good(docs: DataFrame, rules: RobustRules = RobustRules()) -> DataFrame:
    """The documents that are kept, with their own columns. Rows are written once with their statistics, so that counts are made once and
    nothing is joined back by an id, which need not be unique."""
    bare = docs.select(F.struct(*docs.columns).alias("_doc"), F.col("text"), F.col("lang"), F.col("source"))
    stats = write_table(with_stats(with_counts(bare, rules)).drop("text"), "statistics")
    return score(stats, fit(stats, rules), rules).filter("kept").select("_doc.*")
