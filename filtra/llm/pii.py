"""Personal data by candidate gradient boosting (operator 1).

Generators with high recall propose overlapping spans; boosted trees score
each from its format and its surroundings; a threshold per kind, calibrated on
held-out candidates, decides which proposals are taken in addition to the
fixed base rule. The trees learn from the corpus itself: a proposal that the
base rule confirms is a positive, any other a negative. They train on a bounded
sample, drawn evenly by kind and label from all documents; the thresholds come
from all other proposals of all documents. What they add are spans that look like
confirmed ones but that the base rule lost, such as a phone number run together
with a card number.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filtra.llm.common import ship_package, table
from filtra.llm.scan import released, strings
from filtra.llm.trees import Boosted

KINDS = ("email", "ip", "card", "phone")
SAMPLE_CANDIDATES = 20_000  # candidates that train the trees, at most
ODDS_STEPS = 32  # buckets of a unit of log odds, for the counts that give the thresholds
PRECISION = 0.9  # of held-out proposals above a kind's threshold
MIN_SUPPORT = 20  # held-out confirmed proposals a threshold must rest on
SEED = 11

_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _emails(text: str) -> list[Span]:
    """Leftmost matches, found from each '@' outward (linear in the text)."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > last and text[begin - 1] in _LOCAL:
            begin -= 1
        if begin < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((begin, m.end(), "email"))
            last = m.end()
        else:
            last = max(last, at + 1)
        at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[Span]:
    """The fixed rule: per kind, leftmost non-overlapping matches that pass their check."""
    out = _emails(text) if "@" in text else []
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append((m.start(), m.end(), "ip"))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append((m.start(), m.end(), "phone"))
    return out


# --- generators -----------------------------------------------------------

_ISLAND = re.compile(r"[0-9][0-9 ().\-/]*[0-9]")
_RUN = re.compile("[0-9]+")
_AT = re.compile(r"@|\(at\)|\[at\]", re.I)
_LOOSE_EMAIL = re.compile(
    r"[\w.%+-]{1,64} ?(?:@|\(at\)|\[at\]) ?[\w-]{1,63}(?: ?(?:\.|\(dot\)|\[dot\]) ?[\w-]{1,63}){1,4}", re.I)


def candidates(text: str) -> list[Span]:
    """Proposed spans, overlapping: e-mail shapes, runs of four dotted groups,
    13 to 19 digits and 7 to 15 digits over neighbouring groups."""
    out: set[Span] = set()
    if "@" in text or "at)" in text.lower() or "at]" in text.lower():
        for a in _AT.finditer(text):
            for m in _LOOSE_EMAIL.finditer(text, max(0, a.start() - 66), min(len(text), a.end() + 260)):
                if m.start() < a.start() < m.end():
                    out.add((m.start(), m.end(), "email"))
    if not _DIGIT.search(text):
        return sorted(out)
    for island in _ISLAND.finditer(text):
        if island.end() - island.start() < 7:
            continue
        runs = [m.span() for m in _RUN.finditer(text, island.start(), island.end())]
        for i, (begin, _) in enumerate(runs):
            n = 0
            for j in range(i, min(len(runs), i + 19)):
                if j > i and runs[j][0] - runs[j - 1][1] > 2:
                    break
                n += runs[j][1] - runs[j][0]
                if n > 19:
                    break
                end = runs[j][1]
                if j == i + 3 and all(text[runs[k][1]:runs[k + 1][0]] == "." for k in range(i, j)):
                    out.add((begin, end, "ip"))
                if n >= 13:
                    out.add((begin, end, "card"))
                if 7 <= n <= 15:
                    first = begin
                    while first > 0 and text[first - 1] in "+(" and first > begin - 2:
                        first -= 1
                    out.add((first, end, "phone"))
    return sorted(out)


_KEYWORDS = ("tel", "phone", "call", "mail", "card", "visa", "ip", "host", "token", "pass", "id", "no")


def features(text: str, span: Span) -> list[float]:
    """Format and surroundings of a proposal.

    Whether other digits stand a space away is left out on purpose: the base rule
    loses spans to just that, and the trees would learn to lose them too.
    """
    begin, end, kind = span
    s = text[begin:end]
    digits = "".join(c for c in s if c.isdigit())
    groups = [len(g) for g in re.findall("[0-9]+", s)] or [0]
    seps = re.sub("[0-9A-Za-z]", "", s)
    left, right = text[max(0, begin - 24):begin], text[end:end + 12]
    prev, nxt = left[-1:], right[:1]
    low = left.lower()
    return [
        float(KINDS.index(kind)), len(s), len(digits), len(groups), max(groups), min(groups), groups[0],
        groups[-1], len(seps), len(set(seps)), s.count(" "), s.count("."), s.count("-"), s.count("("),
        float(s.count("(") == s.count(")")), float(s.startswith("+")), float("@" in s),
        float(kind == "card" and luhn(digits)),
        float(max((int(g[:4]) for g in re.findall("[0-9]+", s)), default=0) <= 255),
        float(prev.isalpha()), float(nxt.isalpha()), float(prev.isdigit()), float(nxt.isdigit()),
        float(prev in "+(=\"'#") if prev else 0.0, float(nxt in "=\"'%@") if nxt else 0.0,
        float(prev == "." or prev == "-"), float(bool(re.match(r"[.\-][0-9]", right))),
        float(bool(re.search(r"[()\-.] ?\Z", left))), float(begin == 0 or prev == "\n"),
        float(any(k in low for k in _KEYWORDS)),
    ]


class Detector:
    """Trained trees and the log odds above which each kind is taken."""

    def __init__(self, trees: Boosted | None, limits: dict[str, float]):
        self.trees, self.limits = trees, limits

    def spans(self, text: str) -> tuple[list[Span], list[Span]]:
        """(base spans, added spans); added ones overlap nothing."""
        base = base_spans(text)
        if self.trees is None or not (base or "@" in text or _DIGIT.search(text)):
            return base, []
        taken = _Cover(base)
        props = [c for c in candidates(text) if self.limits.get(c[2], np.inf) < np.inf and not taken.meets(c)]
        if not props:
            return base, []
        odds = self.trees.predict(np.array([features(text, c) for c in props]))
        added: list[Span] = []
        for k in np.lexsort(([c[0] for c in props], -odds)):
            c = props[k]
            if odds[k] >= self.limits[c[2]] and not taken.meets(c):
                added.append(c)
                taken.add(c)
        return base, added


class _Cover:
    """Disjoint covered ranges in order."""

    def __init__(self, spans: list[Span]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for b, e, _ in sorted(spans):
            if self.ends and b < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], e)
            else:
                self.starts.append(b)
                self.ends.append(e)

    def meets(self, c: Span) -> bool:
        i = bisect_left(self.starts, c[1]) - 1
        return i >= 0 and self.ends[i] > c[0]

    def add(self, c: Span) -> None:
        i = bisect_left(self.starts, c[0])
        self.starts.insert(i, c[0])
        self.ends.insert(i, c[1])


def _labelled(text: str) -> list[tuple[Span, int]]:
    sure = set(base_spans(text))
    return [(c, int(c in sure)) for c in candidates(text)]


def train(docs: DataFrame, sample: int = SAMPLE_CANDIDATES) -> Detector:
    """Fit on at most ``sample`` candidates, calibrate on all others.

    The sample is chosen by a hash of text and place, from all documents, evenly by
    kind and label; two thirds of it train the trees. The rest and all candidates
    outside it are counted by kind and log odds, in one aggregate.
    """
    ship_package(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    source = docs.select(F.coalesce("text", F.lit("")).alias("text")).filter(F.col("text").rlike("[0-9@]"))
    keyed = source.select("text", F.xxhash64("text", F.lit(SEED)).alias("_k"))
    strata = len(KINDS) * 2

    def count(batches):
        held = np.zeros(strata, np.int64)
        for batch in batches:
            for t in strings(batch.column("text")):
                for c, label in _labelled(t):
                    held[KINDS.index(c[2]) * 2 + label] += 1
        yield pa.RecordBatch.from_arrays([pa.array(range(strata), pa.int32()), pa.array(held, pa.int64())],
                                         names=["s", "n"])

    sizes = {r["s"]: r["n"] for r in source.mapInArrow(released(count), "s int, n long")
             .groupBy("s").agg(F.sum("n").alias("n")).collect()}
    quota = sample // strata
    # a hash below its stratum's bound is drawn; a little over the quota, which cuts it below
    bounds = [min(1.0, 1.2 * quota / max(sizes.get(s, 0), 1)) for s in range(strata)]

    def draw(batches):
        for batch in batches:
            out = []
            for k, t in zip(batch.column("_k").to_pylist(), strings(batch.column("text"))):
                for i, (c, label) in enumerate(_labelled(t)):
                    s = KINDS.index(c[2]) * 2 + label
                    h = xxhash.xxh3_64_intdigest(f"{k}:{i}".encode(), SEED) >> 1
                    if h < bounds[s] * (1 << 63):
                        out.append((s, h, k, i, features(t, c)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[j] for r in out], kind) for j, kind in
                 enumerate((pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.float64())))],
                names=["s", "h", "k", "i", "x"])

    # repeated texts give the same candidates, which train once
    drawn = (keyed.mapInArrow(released(draw), "s int, h long, k long, i int, x array<double>")
             .dropDuplicates(["k", "i"]).collect())
    picked = []
    for s in range(strata):
        picked.extend(sorted((r for r in drawn if r["s"] == s), key=lambda r: (r["h"], r["k"], r["i"]))[:quota])
    picked = [r for n, r in enumerate(picked) if n % 3]
    if len(picked) < 2 * MIN_SUPPORT or len({r["s"] % 2 for r in picked}) < 2:
        return Detector(None, {})
    picked.sort(key=lambda r: (r["h"], r["k"], r["i"]))
    trees = Boosted().fit(np.array([r["x"] for r in picked], dtype=np.float64),
                          np.array([r["s"] % 2 for r in picked], dtype=np.float64))
    sent = sc.broadcast((trees, {(r["k"], r["i"]) for r in picked}))

    def score(batches):
        model, trained = sent.value
        held: Counter = Counter()
        for batch in batches:
            xs, labels, kinds = [], [], []
            for k, t in zip(batch.column("_k").to_pylist(), strings(batch.column("text"))):
                for i, (c, label) in enumerate(_labelled(t)):
                    if (k, i) not in trained:
                        xs.append(features(t, c))
                        labels.append(label)
                        kinds.append(KINDS.index(c[2]))
            if xs:
                steps = np.floor(model.predict(np.array(xs)) * ODDS_STEPS).astype(np.int64)
                held.update(zip(kinds, steps.tolist(), labels))
        rows = [(*key, n) for key, n in held.items()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[j] for r in rows], kind) for j, kind in
             enumerate((pa.int32(), pa.int64(), pa.int32(), pa.int64()))], names=["kind", "b", "label", "n"])

    counts = (keyed.mapInArrow(released(score), "kind int, b long, label int, n long").groupBy("kind", "b")
              .agg(F.sum(F.col("n") * F.col("label")).alias("hits"), F.sum("n").alias("n")).collect())
    return Detector(trees, {kind: _calibrate([(r["b"], r["hits"], r["n"]) for r in counts if r["kind"] == i])
                            for i, kind in enumerate(KINDS)})


def _calibrate(counts: list[tuple[int, int, int]]) -> float:
    """From (bucket, confirmed, all): the lowest log odds above which held-out proposals
    are confirmed with the wanted precision, at even odds or more; infinite without support."""
    limit, hits, n = float("inf"), 0, 0
    for b, h, m in sorted(counts, reverse=True):
        hits, n = hits + h, n + m
        if b >= 0 and hits >= MIN_SUPPORT and hits >= PRECISION * n:
            limit = b / ODDS_STEPS
    return limit


def join_spans(spans: list[Span]) -> str:
    order = sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))
    return ",".join(f"{k}:{b}:{e}" for b, e, k in order)


def find(docs: DataFrame, detector: Detector) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans for every row.

    Offsets count code points, ends are exclusive. Null and empty texts have no
    spans (the hash is that of the empty string). Rows are independent, so nulls,
    ties and repeated rows need no care; an empty table gives no rows.
    """
    ship_package(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(detector)

    @F.pandas_udf("n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
    def run(texts: pd.Series) -> pd.DataFrame:
        d = sent.value
        out = []
        for t in texts:
            base, added = d.spans(t)
            counts = [sum(s[2] == k for s in base) for k in KINDS]
            out.append((*counts, hashlib.sha256(join_spans(base).encode()).hexdigest(), join_spans(base + added)))
        return pd.DataFrame(out, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return (docs.select("doc_id", run(F.coalesce("text", F.lit(""))).alias("_r"))
            .select("doc_id", "_r.*"))


def redact_text(text: str, spans: list[Span]) -> str:
    """The text with every found span replaced by its kind in brackets."""
    out, at = [], 0
    for b, e, k in sorted(spans, key=lambda s: (s[0], -s[1])):
        if e <= at:
            continue
        out.append(text[at:max(b, at)])
        if b >= at:
            out.append(f"[{k.upper()}]")
        at = e
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, detector: Detector) -> DataFrame:
    """The rows of ``docs`` with personal data in ``text`` replaced (null stays null)."""
    ship_package(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(detector)

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        d = sent.value
        return texts.map(lambda t: t if t is None else redact_text(t, sum(d.spans(t), [])))

    return docs.withColumn("text", run("text"))


def op1(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return find(docs, train(docs))
