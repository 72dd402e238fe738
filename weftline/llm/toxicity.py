"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features are rates over the whole text: hits of a lexicon, their weights, how many stand near a word of the second person, capitals,
exclamation and question marks, and words with digits or signs among their letters. The lexicon is learned: of the beginnings of
words (three letters and more, a short word whole) those that stand in far more toxic than other texts, judged by a likelihood ratio
against the number of beginnings tried; one that a longer one explains is left out. Words are looked up as they stand and with
usual substitutions undone ("st0pid", "s-t-u-p-i-d" and "stuuupid" count as hits and as obfuscated).

Labels are learned from at most ``Fit.rows`` labelled documents of four folds of five, by the id's CRC; the fifth is held out.
Each half of the training folds gets the features of trees from a lexicon of the other half; trees are fitted on two folds and
calibrated on the other two. Ids, languages, sources and labels are never part of a score.

Defined results: a null or empty text has all features 0 and the score of such a text; repeated rows have the same score; a null id
is held out by the CRC of an empty text; without labels of both kinds every score is the share of toxic labels, or 0; an empty
table gives no rows; extra columns do not matter.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import sample_rows, write_table
from .boosting import Forest, train

if TYPE_CHECKING:
    import numpy as np
    import pyarrow as pa


@dataclass(frozen=True)
class Fit:
    rows: int = 12_000  # labelled documents that are learned from
    entries: int = 3_000  # of the lexicon, the strongest
    least: int = 4  # toxic texts that hold an entry
    weight: float = 1.5  # log of how much more often toxic texts hold an entry
    rounds: int = 20
    depth: int = 4


SHORT, LONG = 3, 12  # letters of a beginning
NAMES = ["hits", "hits_per_word", "weight", "weight_per_word", "strongest", "distinct", "second_person", "second_person_per_word", "capitals", "capital_words", "exclamations", "questions", "obfuscated", "obfuscated_hits"]
# Words of the second person in English, German, French and Spanish.
SECOND = frozenset("you your yours yourself u ur du dich dir dein deine deinen ihr euch euer sie tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split())
NEAR = 3  # words
# Signs that stand for letters.
SIGNS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l", "*": "", ".": "", "-": "", "_": "", "+": ""})

_WORD = re.compile(r"[^\W\d_]+")
_MIXED = re.compile(r"[^\W\d_]+(?:[0-9@$!|*._+-]{1,3}[^\W\d_]+)+")
_STRETCHED = re.compile(r"(.)\1{2,}")


def prefixes(word: str) -> list[str]:
    return [word[:k] for k in range(SHORT, min(len(word), LONG) + 1)]


class Lexicon:
    """Weights of beginnings of words; what words weigh is kept for some words."""

    def __init__(self, weights: dict[str, float]) -> None:
        self.weights = weights
        self.known: dict[str, float] = {}

    def weight(self, word: str) -> float:
        """Of the heaviest entry that begins the word; 0 if none does."""
        found = self.known.get(word)
        if found is None:
            found = max((self.weights.get(p, 0.0) for p in prefixes(word)), default=0.0)
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[word] = found
        return found

    def plain(self, word: str) -> float:
        """The weight of a disguised word, spelled out."""
        clean = word.translate(SIGNS)
        return max(self.weight(clean), self.weight(_STRETCHED.sub(r"\1", clean)), self.weight(_STRETCHED.sub(r"\1\1", clean)))


def features(text: str | None, lexicon: Lexicon) -> list[float]:
    """The values of NAMES."""
    text = text or ""
    low = text.lower()
    words = _WORD.findall(low)
    n = max(len(words), 1)
    counts = Counter(words)
    hit = {w: x for w in counts if (x := lexicon.weight(w)) > 0}
    hits, total = sum(counts[w] for w in hit), sum(counts[w] * x for w, x in hit.items())
    strongest, distinct, near, veiled = max(hit.values(), default=0.0), set(hit), 0, 0
    mixed = _MIXED.findall(low)
    stretched = [w for w in counts if w not in hit and _STRETCHED.search(w)]
    for w in [*mixed, *stretched]:
        x = lexicon.plain(w)
        if x > 0:
            times = counts[w] if w in counts else 1
            hits, total, veiled, strongest = hits + times, total + x * times, veiled + times, max(strongest, x)
            distinct.add(w)
    if hit and not SECOND.isdisjoint(counts):
        last_you, last_hits = -NEAR - 1, []
        for i, w in enumerate(words):
            if w in SECOND:
                near += sum(i - k <= NEAR for k in last_hits)
                last_hits, last_you = [], i
            elif w in hit:
                if i - last_you <= NEAR:
                    near += 1
                else:
                    last_hits = [*last_hits[-NEAR:], i]
    chars = max(len(text), 1)
    capitals = sum(map(str.isupper, text)) if not text.isascii() else len(text) - len(text.encode().translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    shouted = len(re.findall(r"\b[A-Z]{3,}\b", text))
    return [float(hits), hits / n, total, total / n, strongest, float(len(distinct)), float(near), near / n, capitals / chars, shouted / n, text.count("!") / n, text.count("?") / n, (len(mixed) + len(stretched)) / n, float(veiled)]


# --- learning -------------------------------------------------------------------------------------------------------


def fold(doc_id: Column) -> Column:
    """0 (held out) to 4, by the CRC of the id as text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def training(docs: DataFrame, labels: DataFrame, fit: Fit) -> DataFrame:
    """A written table (text, label, fold) of at most ``fit.rows`` labelled documents that are not held out; one row for an id."""
    chosen = labels.filter("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("label")).withColumn("fold", fold(F.col("doc_id"))).filter("fold <> 0")
    chosen = write_table(sample_rows(chosen, fit.rows), "chosen")
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")  # at most fit.rows narrow rows
    one = texts.groupBy("doc_id", "label", "fold").agg(F.min("text").alias("text"))
    return write_table(one.select("text", "label", "fold"), "training")


def lexicons(sample: DataFrame, fit: Fit) -> list[dict[str, float]]:
    """Of the first half of the folds, of the second, and of both."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            keys = list(held)
            cols = [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([k[2] for k in keys], pa.string()), pa.array([held[k] for k in keys], pa.int64())]
            held.clear()
            return pa.RecordBatch.from_arrays(cols, ["half", "label", "entry", "n"])

        for batch in batches:
            for text, label, k in zip(*(batch.column(c).to_pylist() for c in ("text", "label", "fold")), strict=True):
                half = 0 if k <= 2 else 1
                held.update((half, label, p) for p in {p for w in set(_WORD.findall(text.lower())) for p in prefixes(w)})
                held[half, label, ""] += 1  # the number of texts
                if len(held) > 400_000:
                    yield out()
        yield out()

    n = write_table(sample.mapInArrow(rows, "half int, label int, entry string, n long").groupBy("half", "label", "entry").agg(F.sum("n").alias("n")), "beginnings")
    found = []
    for halves in ([0], [1], [0, 1]):
        own = n.filter(F.col("half").isin(halves)).groupBy("entry").agg(F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("b"))
        size = own.filter("entry = ''").first()
        if size is None or not size.a or not size.b:
            found.append({})
            continue
        tried = own.filter(F.col("entry") != "").filter(F.col("a") >= fit.least)
        weight = F.log((F.col("a") + 0.5) / (size.a + 1)) - F.log((F.col("b") + 0.5) / (size.b + 1))
        share = size.a / (size.a + size.b)
        seen = F.col("a") + F.col("b")
        gain = lambda x, p: F.when(x > 0, x * F.log(x / (seen * p))).otherwise(0.0)
        ratio = 2 * (gain(F.col("a"), share) + gain(F.col("b"), 1 - share))
        scored = tried.withColumns({"weight": weight, "ratio": ratio}).filter((F.col("weight") >= fit.weight) & (F.col("ratio") >= 2 * math.log(max(tried.count(), 2)) + 4))
        top = scored.orderBy(F.desc("ratio"), "entry").limit(4 * fit.entries).collect()
        longer: dict[str, tuple[int, int]] = {}
        for r in top:
            longer[r.entry[:-1]] = max(longer.get(r.entry[:-1], (0, 0)), (r.a, r.b))

        def of_its_own(r) -> bool:
            """Whether it would still be an entry without the texts of the longer entry that most of its toxic texts hold."""
            a, b = r.a - longer.get(r.entry, (0, 0))[0], r.b - longer.get(r.entry, (0, 0))[1]
            return a >= max(fit.least, 0.1 * r.a) and math.log((a + 0.5) / (size.a + 1)) - math.log((b + 0.5) / (size.b + 1)) >= fit.weight

        found.append({r.entry: r.weight for r in [r for r in top if of_its_own(r)][: fit.entries]})
    return found


@dataclass
class Judge:
    lexicon: dict[str, float]
    forest: Forest
    margins: list[float]  # of the calibration, ascending
    shares: list[float]

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Calibrated shares; a thousandth is the trees' own probability, which orders what the calibration ties."""
        import numpy as np

        margin = self.forest.margin(x)
        return 0.999 * np.interp(margin, self.margins, self.shares) + 0.001 / (1 + np.exp(-self.forest.scale * margin))


def featured(texts: DataFrame, keep: list[str], by_fold: list[dict[str, float]]) -> DataFrame:
    """The columns of ``keep`` and those of NAMES. by_fold: a lexicon for each fold."""
    held = texts.sparkSession.sparkContext.broadcast(by_fold)  # at most Fit.entries each

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow as pa

        own = [Lexicon(w) for w in held.value]
        for batch in batches:
            x = np.array([features(t.as_py(), own[k]) for t, k in zip(batch.column("text"), batch.column("fold").to_pylist(), strict=True)]).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(c) for c in x.T)], [*keep, *NAMES])

    schema = ", ".join(f"{c} {t}" for c, t in texts.select(*keep).dtypes)
    return texts.mapInArrow(rows, f"{schema}, {', '.join(f'{n} double' for n in NAMES)}")


def fit(docs: DataFrame, labels: DataFrame, config: Fit = Fit()) -> Judge:
    from pyspark.ml.regression import IsotonicRegression

    sample = training(docs, labels, config)
    first, second, both = lexicons(sample, config)
    known = write_table(featured(sample, ["label", "fold"], [first, second, second, first, first]), "features")
    trees = train(known.filter("fold in (1, 3)"), NAMES, rounds=config.rounds, depth=config.depth)
    margins = known.filter("fold in (2, 4)").select(trees.column().alias("margin"), F.col("label").cast("double").alias("label"))
    n = margins.agg(F.count("*").alias("n"), F.avg("label").alias("share")).first()
    if not n.n or n.share in (0.0, 1.0):
        return Judge(both, trees, [0.0], [n.share or 0.0])
    model = IsotonicRegression(featuresCol="margin", labelCol="label").fit(margins)
    return Judge(both, trees, [float(v) for v in model.boundaries], [float(v) for v in model.predictions])


def score(docs: DataFrame, judge: Judge) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    held = docs.sparkSession.sparkContext.broadcast(judge)  # lexicon and trees of bounded size

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow as pa

        own, lexicon = held.value, Lexicon(held.value.lexicon)
        for batch in batches:
            x = np.array([features(t.as_py(), lexicon) for t in batch.column("text")]).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(own.scores(x))], ["doc_id", "held_out", "score"])

    out = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out")
    narrow = docs.select("doc_id", out, F.col("text").cast("string").alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(rows, f"doc_id {kind}, held_out boolean, score double").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
