"""Personal data by candidate gradient boosting.

Base spans follow fixed patterns and always stay. High-recall generators propose further, overlapping spans; boosted
trees score each by its format and what stands around it; a threshold for each kind, calibrated on held-out samples to
a wanted precision, selects; selected spans are taken from the likeliest down, and one that overlaps a taken one goes. The trees are trained on generated
texts with known spans (their number is a parameter), not on the corpus.

A text is searched whole and in linear time: every pattern starts at a character that cannot continue an earlier try.
Offsets are code points, ends exclusive. Defined results: a null text is an empty one and has no spans (and stays null
when redacted); repeated rows give the same rows; an empty table gives no rows; extra columns are passed on.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import random
import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .boosting import Forest, train

BASE_KINDS = ["email", "ip", "card", "phone"]
KINDS = [*BASE_KINDS, "secret"]
FEATURES = ["kind", "length", "digits", "letters", "uppers", "others", "entropy", "groups", "luhn", "hexes", "cue", "any_cue", "before", "after", "form", "spaces", "dots", "hyphens"]
SPANS = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"

_LOCAL = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_CUES = {
    "email": re.compile(r"e-?mail|mail|contact|write|reach", re.I), "ip": re.compile(r"\bip\b|address|host|server", re.I), "card": re.compile(r"card|visa|credit|payment|account|iban", re.I),
    "phone": re.compile(r"phone|tel|call|mobile|fax", re.I), "secret": re.compile(r"password|passwd|pwd|secret|token|key", re.I),
}
_MORE = [
    ("email", 0, re.compile(r"(?<![\w.%+-])[A-Za-z0-9._%+-]{1,64}\s?[\[(]\s?at\s?[\])]\s?[A-Za-z0-9-]{1,63}(?:(?:\.|\s?[\[(]\s?dot\s?[\])]\s?)[A-Za-z0-9-]{2,63})+", re.I), re.compile(r"[\[(]\s?at\s?[\])]", re.I)),
    ("ip", 0, re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"), re.compile(r":[0-9A-Fa-f]")),
    ("phone", 0, re.compile(r"(?<![\w+.-])(?:\([0-9]{3}\)\s?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![0-9])"), None),
    ("card", 0, re.compile(r"(?<![0-9])[0-9](?:[ ./-]?[0-9]){12,18}(?![0-9])"), None),
    ("card", 0, re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"), None),
    ("secret", 1, re.compile(r"(?i)(?<![A-Za-z])(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)\s{0,4}[:=]\s{0,4}[\"']?([^\s\"']{6,})"), re.compile(r"[:=]")),
    ("secret", 0, re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}"), None),
]


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return bool(digits) and total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """By kind as listed, then start."""
    found: list[tuple[str, int, int]] = []
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            found.append(("email", start, m.end()))
            last = m.end()
            at = text.find("@", last)
        else:
            at = text.find("@", at + 1)
    found += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(d := x.lstrip("0")) < 4 and int(d or "0") <= 255 for x in m[0].split("."))]
    found += [("card", *m.span()) for m in _CARD.finditer(text) if 16 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return found


def candidates(text: str) -> list[tuple[str, int, int]]:
    """What the generators propose, overlaps included."""
    found = []
    for kind, group, pattern, needs in _MORE:
        if needs is None or needs.search(text):
            found += [(kind, *m.span(group)) for m in pattern.finditer(text)]
    return sorted(set(found))


def features(text: str, span: tuple[str, int, int]) -> list[float]:
    kind, a, b = span
    s, before = text[a:b], text[max(0, a - 28) : a]
    n = len(s)
    digits, letters = len(_digits(s)), sum(c.isalpha() for c in s)
    counts = {c: s.count(c) for c in set(s)}
    entropy = -sum(v / n * math.log2(v / n) for v in counts.values())
    form = {"email": 2.0 * bool(re.search(r"\bdot\b", s, re.I)) + ("." in s), "ip": float(s.count(":") or s.count(".")), "phone": float(s.startswith("(")), "card": float(s[:2].isalpha() and s[:2].isupper()), "secret": float(digits > 0 and letters > 0)}[kind]
    edge = lambda c: 0.0 if not c or c.isspace() else 2.0 if c.isalnum() else 1.0
    return [
        float(KINDS.index(kind)), float(n), digits / n, letters / n, sum(c.isupper() for c in s) / n, (n - digits - letters) / n, entropy, float(len(re.findall(r"[A-Za-z0-9]+", s))), float(luhn(_digits(s))),
        sum(c in "0123456789abcdefABCDEF" for c in s) / n, float(bool(_CUES[kind].search(before))), float(any(c.search(before) for c in _CUES.values())), edge(text[a - 1 : a]), edge(text[b : b + 1]), form, float(s.count(" ")), float(s.count(".")), float(s.count("-")),
    ]


def _apart(spans: list[tuple[str, int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of what the spans cover, in order."""
    starts: list[int] = []
    ends: list[int] = []
    for a, b in sorted((a, b) for _, a, b in spans):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def _likeliest(scored: list[tuple[float, tuple[str, int, int]]]) -> list[tuple[str, int, int]]:
    """Spans from the likeliest down, without those that overlap a taken one; spans that no chain of overlaps joins are settled apart."""
    out: list[tuple[str, int, int]] = []
    group: list[tuple[float, tuple[str, int, int]]] = []
    end = -1

    def settle() -> None:
        taken: list[tuple[int, int, str]] = []  # by place
        for _, (kind, a, b) in sorted(group, key=lambda x: (-x[0], x[1][1], x[1])):
            at = bisect.bisect_left(taken, (b,))  # the first that begins at b or later
            if not at or taken[at - 1][1] <= a:
                taken.insert(at, (a, b, kind))
        out.extend((kind, a, b) for a, b, kind in taken)
        group.clear()

    for p, span in sorted(scored, key=lambda x: x[1][1:]):
        if span[1] >= end:
            settle()
        group.append((p, span))
        end = max(end, span[2])
    settle()
    return out


SCORED = 4096  # candidates that are scored at once


@dataclass
class Detector:
    forest: Forest
    thresholds: dict[str, float]

    def spans(self, text: str | None) -> tuple[list, list]:
        """The base spans, and all spans."""
        import numpy as np

        if not text:
            return [], []
        base = base_spans(text)
        starts, ends = _apart(base)

        def free(c: tuple[str, int, int]) -> bool:
            at = bisect.bisect_left(starts, c[2])  # those before begin before c ends
            return not at or ends[at - 1] <= c[1]

        more, scored = [c for c in candidates(text) if free(c)], []
        for i in range(0, len(more), SCORED):
            part = more[i : i + SCORED]
            p = self.forest.probability(np.array([features(text, c) for c in part]))
            scored += [(x, c) for c, x in zip(part, p.tolist(), strict=True) if x >= self.thresholds[c[0]]]
        return base, sorted(base + _likeliest(scored), key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


# --- training texts -------------------------------------------------------------------------------------------------


def _sample_text(r: random.Random) -> tuple[str, list[tuple[str, int, int]]]:
    """A text with one lookalike or one true span, and the true spans."""
    word = lambda: "".join(r.choice("abcdefghilmnoprstu") for _ in range(r.randint(2, 9)))
    num = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    hexes = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    alnum = lambda n: "".join(r.choice("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz0123456789") for _ in range(n))

    def card() -> str:
        d = num(15)
        d += next(c for c in "0123456789" if luhn(d + c))
        sep = r.choice([".", "/"])
        return sep.join(d[i : i + 4] for i in range(0, 16, 4))

    true = [
        ("email", lambda: f"{word()}{r.choice(['.', '_', ''])}{word()} {r.choice(['(at)', '[at]', '( at )'])} {word()}{r.choice(['.', ' (dot) ', ' [dot] '])}{r.choice(['com', 'org', 'net', 'de'])}"),
        ("ip", lambda: ":".join(hexes(r.randint(1, 4)) for _ in range(8))),
        ("phone", lambda: r.choice([f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"{num(3)}.{num(3)}.{num(4)}"])),
        ("card", card),
        ("card", lambda: f"{r.choice(['DE', 'FR', 'ES', 'GB', 'IT'])}{num(2)} " + " ".join(num(4) for _ in range(r.randint(3, 5)))),
        ("secret", lambda: r.choice([hexes(18), hexes(32), alnum(20), alnum(40), hexes(40), alnum(12) + r.choice("!$%") + num(2)])),
    ]
    false = [
        ("email", lambda: f"{word()} (at) {word()}.{word()}{word()}{word()}"),
        ("ip", lambda: ":".join(num(2) for _ in range(4))),
        ("phone", lambda: f"{num(3)} {num(3)} {num(4)}"),
        ("card", lambda: num(r.choice([13, 14, 17]))),
        ("card", lambda: "-".join(num(4) for _ in range(4))),
        ("secret", lambda: r.choice(["-".join(word() for _ in range(5)), word() + word() + word() + word() + word(), "-" * 30, "_" * 24, "/".join(word() for _ in range(5)), num(24)])),
    ]
    good = r.random() < 0.5
    kind, make = r.choice(true if good else false)
    cues = {"email": ["email", "contact", "write to"], "ip": ["ip", "host", "address"], "phone": ["phone", "tel", "call"], "card": ["card", "iban", "account"], "secret": ["password=", 'token = "', "secret: ", "api_key="]}[kind]
    left = " ".join(word() for _ in range(r.randint(2, 8))) + " "
    if kind == "secret" and (good or r.random() < 0.1):
        left += r.choice(cues)
    elif r.random() < (0.7 if good else 0.1):
        left += r.choice(cues) + r.choice([" ", ": "])
    value = make()
    text = left + value + r.choice([" ", '" ' if left.endswith('"') else ", ", ". "]) + " ".join(word() for _ in range(4))
    return text, [(kind, len(left), len(left) + len(value))] if good else []


def training_rows(n_texts: int, seed: int) -> list[tuple]:
    """(label, feature...) of every candidate in so many generated texts."""
    r, rows = random.Random(seed), []
    for _ in range(n_texts):
        text, true = _sample_text(r)
        for c in candidates(text):
            hit = any(k == c[0] and min(e, c[2]) - max(s, c[1]) >= 0.9 * max(e - s, c[2] - c[1]) for k, s, e in true)
            rows.append((int(hit), *features(text, c)))
    return rows


def fit(spark: SparkSession, n_texts: int = 2400, precision: float = 0.97, seed: int = 11) -> Detector:
    """Trees from so many generated texts; each kind's threshold is the least that has the precision on half as many others."""
    import numpy as np

    rows = training_rows(n_texts, seed)
    sample = spark.createDataFrame(pd.DataFrame(rows, columns=["label", *FEATURES])).coalesce(1)
    forest = train(sample, FEATURES)
    held = np.array(training_rows(n_texts // 2, seed + 1))
    y, p = held[:, 0], forest.probability(held[:, 1:])
    thresholds = {}
    for i, kind in enumerate(KINDS):
        own = held[:, 1] == i
        order = np.argsort(-p[own], kind="stable")
        score, hits = p[own][order], y[own][order]
        right = np.cumsum(hits) / (np.arange(len(hits)) + 1)
        last = np.append(score[1:] != score[:-1], True) if len(score) else np.array([], bool)  # equal scores stand or fall together
        good = np.flatnonzero(last & (right >= precision))
        thresholds[kind] = float(score[good[-1]]) if len(good) else 2.0
    return Detector(forest, thresholds)


# --- Spark ----------------------------------------------------------------------------------------------------------


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame, detector: Detector, text: str = "text") -> DataFrame:
    """Adds ``pii``, in place of a column of that name: a struct of counts by base kind, the base spans' digest, and all spans."""

    @F.pandas_udf(SPANS)
    def spans(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for x in texts:
            base, every = detector.spans(x)
            rows.append((*(sum(s[0] == k for s in base) for k in BASE_KINDS), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(every)))
        return pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return docs.withColumn("pii", spans(F.col(f"`{text}`")))


def redacted(text: str | None, detector: Detector) -> str | None:
    """Every span becomes its kind in brackets; overlapping spans become one, named by the first."""
    spans = sorted(detector.spans(text)[1], key=lambda s: (s[1], -s[2]))
    if not spans:
        return text
    parts, at, end = [], 0, -1
    for kind, a, b in spans:
        if a >= end:
            parts += [text[max(at, 0) : a], f"[{kind.upper()}]"]
        end = max(end, b)
        at = end
    return "".join([*parts, text[at:]])


def redact(docs: DataFrame, detector: Detector, text: str = "text") -> DataFrame:
    """The documents with personal data replaced; ``n_chars`` follows."""

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return pd.Series([redacted(x, detector) for x in texts], dtype=object)

    out = docs.withColumn(text, clean(F.col(text)))
    return out.withColumn("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
