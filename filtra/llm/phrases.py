"""Phrases by merged count streams (operator 12).

Phrases of one to five words are counted exactly, per language. The counts form
two sorted streams: prefix order (words from left to right) and suffix order
(words from right to left). In prefix order a phrase's first words are a
prefix of its key, in suffix order its last words are, so both parts of every
cut, and the longest-lived extension to either side, come from merge joins of
sorted streams; no table of counts is held anywhere.

Before phrases are written out, counts of hashed phrases say, one length after
the other, which may reach the wanted count at all: a phrase is as rare as its
rarest part, so a length is counted only where its parts passed. Those sets are
bitmaps of a fixed size that only leave out what cannot reach the count. Hashes
travel as sorted byte planes, a block a bucket, and each bucket adds up its own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filtra.llm.bitmaps import bitmap, holds
from filtra.llm.common import cut, join_small, stored, table
from filtra.llm.scan import borders, byte_set, chunks, counted, gram_hashes, joined, mix, word_hashes

LONGEST = 5  # words of a phrase
LEAST = 100  # occurrences of a candidate
TOP = 2000  # phrases reported per language
LEVELS = ((1,), (2,), (3,), (4, 5))  # phrase lengths counted by hash first, and which of them together
BUCKET_BYTES = 8 << 20  # bytes of text per bucket of a hashed count
KEY_BITS = 48  # of a hash that travel
NO_LANG = "und"
# 1000 a n and l r may pass 64 bits; decimals of 38 digits hold them exactly
SCORE = "(cast(1000 as decimal(38, 0)) * a * n) div (cast(l as decimal(38, 0)) * r)"

_BREAKS = byte_set(".,;:!?\n\x0b\x0c\r")
_BLANKS = byte_set(" \t")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_U = np.uint64


class Pieces:
    """Lower-cased words of a chunk of texts and how far each one's piece goes."""

    def __init__(self, data: np.ndarray, off: np.ndarray, lang: np.ndarray):
        self.data = _LOWER[data]
        apart = _BREAKS[self.data]
        self.inside = ~(apart | _BLANKS[self.data])
        self.starts, self.ends, self.before = borders(self.inside, off)
        n = len(self.starts)
        self.lang = np.repeat(lang, np.diff(self.before))
        new = np.zeros(n + 1, dtype=bool)
        new[np.searchsorted(self.starts, np.nonzero(apart)[0])] = True
        new[self.before] = True
        self.piece_end = np.zeros(0, np.int64)
        if n:
            first = np.nonzero(new[:n])[0]
            self.piece_end = np.concatenate([first[1:], [n]])[np.cumsum(new[:n]) - 1]
        self.h = word_hashes(self.data, self.starts, self.ends)

    def keys(self, k: int) -> np.ndarray:
        """Hash of the k words from every word on, with its language."""
        g = gram_hashes(self.h, k)
        return mix(g ^ self.lang[:len(g)]) >> _U(64 - KEY_BITS)

    def within(self, k: int) -> np.ndarray:
        """Whether k words from here on lie in one piece."""
        m = max(0, len(self.h) - k + 1)
        return np.arange(m) + k <= self.piece_end[:m]

    def possible(self, k: int, sets: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(places, keys) of k-word phrases that may be frequent enough by the bitmaps of ``sets``
        (length -> bitmap): that of their own length, or else of their parts of the next shorter one."""
        ok = self.within(k)
        width = max((w for w in sets if w <= k), default=0)
        if width and len(ok):
            part = np.zeros(len(self.h) - width + 1, dtype=bool)
            inside = np.nonzero(self.within(width))[0]
            part[inside] = holds(sets[width], self.keys(width)[inside])
            for i in range(k - width + 1):
                ok &= part[i:i + len(ok)]
        at = np.nonzero(ok)[0]
        return at, self.keys(k)[at]

    def joined(self) -> tuple[bytes, np.ndarray]:
        return joined(self.data, self.inside, self.starts, self.ends)


def _source(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANG)).alias("lang"),
                       F.col("text").cast("string").alias("text")).filter("text is not null")


def _pieces(batch: pa.RecordBatch):
    """(languages, Pieces) of every chunk of a batch."""
    langs = batch.column("lang").to_pylist()
    name = {x: xxhash.xxh3_64_intdigest(x.encode()) for x in set(langs)}
    for lo, hi, data, off in chunks(batch.column("text")):
        yield langs[lo:hi], Pieces(data, off, np.array([name[x] for x in langs[lo:hi]], dtype=_U))


def _planes(keys: np.ndarray, n: np.ndarray, kind) -> bytes:
    """Sorted keys by byte planes, highest first, then their counts: equal leading bytes lie together."""
    raw = np.ascontiguousarray(keys.astype(">u8")).view(np.uint8).reshape(-1, 8)[:, 8 - KEY_BITS // 8:]
    return raw.T.tobytes() + np.minimum(n, np.iinfo(kind).max).astype(kind).tobytes()


def _unplaned(raw: bytes, kind) -> tuple[np.ndarray, np.ndarray]:
    width = KEY_BITS // 8
    n = len(raw) // (width + np.dtype(kind).itemsize)
    keys = np.zeros((n, 8), dtype=np.uint8)
    keys[:, 8 - width:] = np.frombuffer(raw, np.uint8, width * n).reshape(width, n).T
    return keys.view(">u8").ravel().astype(_U), np.frombuffer(raw, kind, n, width * n)


def _hashed(docs: DataFrame, lengths, sets: dict, least: int, buckets: int) -> dict[int, np.ndarray]:
    """Bitmaps of the phrases of ``lengths`` that may occur ``least`` times or more."""
    # a count that reaches the largest value of its type is enough in any case
    kind = next(t for t in (np.uint8, np.uint16, np.uint32) if np.iinfo(t).max >= least)

    def run(batches):
        known = {k: v.value for k, v in sets.items()}
        for batch in batches:
            for _, p in _pieces(batch):
                for k in lengths:
                    h, _, n = counted(p.possible(k, known)[1])
                    bucket = (h >> _U(KEY_BITS - 24)) * _U(buckets) >> _U(24)  # in the order of the keys
                    at = np.searchsorted(bucket, np.arange(buckets + 1, dtype=_U))
                    some = np.nonzero(at[1:] > at[:-1])[0]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(some), k, np.int32)), pa.array(some),
                         pa.array([_planes(h[at[b]:at[b + 1]], n[at[b]:at[b + 1]], kind) for b in some.tolist()], pa.binary())],
                        names=["k", "bucket", "keys"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [_unplaned(raw, kind) for raw in pdf["keys"]]
        h, _, n = counted(np.concatenate([x[0] for x in parts]), np.concatenate([x[1] for x in parts]).astype(np.int64))
        h = h[n >= least]
        return pd.DataFrame({"k": np.full(len(h), pdf["k"].iloc[0], np.int32), "h": h.astype(np.int64)})

    found = cut(_source(docs).mapInArrow(run, "k int, bucket long, keys binary")
                .groupBy("k", "bucket").applyInPandas(add, "k int, h long"))
    return {k: bitmap(found.filter(F.col("k") == k), "h") for k in lengths}


def counts(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, levels=LEVELS) -> DataFrame:
    """lang, k, phrase, f: exact counts of the phrases of 1 to ``longest`` words that occur
    ``least`` times or more, and per language one row with k = 0 for all words."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-int(size) // BUCKET_BYTES))
    sets = {}
    for lengths in levels:
        found = _hashed(docs, [k for k in lengths if k <= longest], sets, least, buckets)
        sets |= {k: spark.sparkContext.broadcast(bits) for k, bits in found.items()}

    def run(batches):
        known = {k: v.value for k, v in sets.items()}
        for batch in batches:
            for langs, p in _pieces(batch):
                line, at = p.joined()
                end = at + (p.ends - p.starts)
                names, own = np.unique(np.array(langs, dtype=object), return_inverse=True)
                words = np.bincount(own, weights=np.diff(p.before), minlength=len(names)).astype(np.int64)
                lang_of = np.repeat(own, np.diff(p.before))
                lang, bucket = [np.arange(len(names))], [np.full(len(names), -1)]
                texts, n = [b""] * len(names), [words]
                for k in range(1, longest + 1):
                    place, key = p.possible(k, known)
                    keys, pick, many = counted(key)
                    first = place[pick]
                    texts += [line[a:b] for a, b in zip(at[first].tolist(), end[first + k - 1].tolist(), strict=True)]
                    lang.append(lang_of[first])
                    bucket.append((keys >> _U(KEY_BITS - 24)).astype(np.int64) * buckets >> 24)
                    n.append(many)
                lang, bucket, n = np.concatenate(lang), np.concatenate(bucket), np.concatenate(n)
                order = np.lexsort((bucket, lang))
                lang, bucket, n = lang[order], bucket[order], n[order]
                cuts = np.concatenate([[0], np.nonzero((lang[1:] != lang[:-1]) | (bucket[1:] != bucket[:-1]))[0] + 1, [len(n)]])
                place = order.tolist()
                spans = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
                # a phrase holds no line break, so a block's phrases are lines
                yield pa.RecordBatch.from_arrays(
                    [pa.array([names[lang[i]] for i, _ in spans], pa.string()), pa.array(bucket[cuts[:-1]]),
                     pa.array([b"\n".join([texts[x] for x in place[i:j]]) for i, j in spans], pa.binary()),
                     pa.array([n[i:j].tobytes() for i, j in spans], pa.binary())],
                    names=["lang", "bucket", "phrases", "n"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        """Sums of one block's phrases by their text."""
        total: dict[bytes, int] = {}
        for phrases, n in zip(pdf["phrases"], pdf["n"], strict=True):
            for text, many in zip(phrases.split(b"\n"), np.frombuffer(n, np.int64).tolist(), strict=True):
                total[text] = total.get(text, 0) + many
        kept = [(t.count(b" ") + 1 if t else 0, t.decode(), f) for t, f in total.items() if f >= least or not t]
        out = pd.DataFrame(kept, columns=["k", "phrase", "f"])
        out["lang"] = pdf["lang"].iloc[0]
        return out.astype({"k": "int32", "f": "int64"})[["lang", "k", "phrase", "f"]]

    return (_source(docs).mapInArrow(run, "lang string, bucket long, phrases binary, n binary")
            .groupBy("lang", "bucket").applyInPandas(add, "lang string, k int, phrase string, f long"))


def collocations(docs: DataFrame, top: int = TOP, least: int = LEAST, longest: int = LONGEST,
                 levels=LEVELS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases.

    A null language counts as ``und``. Null, empty and blank texts have no words. Ties of the
    score go to the larger count, then to the phrase in byte order, so the rows are the same on
    every run. Repeated rows are texts of their own and count again. An empty table gives no
    rows. Only ``lang`` and ``text`` are read, so other columns cannot clash.
    """
    grams = stored(counts(docs, least, longest, levels), "phrase-counts")
    total = grams.filter("k = 0").select("lang", F.col("f").alias("n"))
    words = F.split("phrase", " ")
    # the two streams: a part at a phrase's start is a prefix of its key in the first, a part at its end in the second
    prefix = grams.filter("k > 0").select("lang", words.alias("key"), "k", "f")
    suffix = grams.filter("k > 0").select("lang", F.reverse(words).alias("key"), "k", "f")

    def longer(stream: DataFrame, out: str) -> DataFrame:
        """Largest count among a phrase's one-word extensions at the stream's end."""
        return (stream.filter("k > 1").select("lang", F.expr("slice(key, 1, k - 1)").alias("key"), "f")
                .groupBy("lang", "key").agg(F.max("f").alias(out)))

    # a phrase inside a longer one of the same count is inside a one-word longer one of that count
    kept = (prefix.filter("k > 1")
            .join(longer(prefix, "to_right").hint("merge"), ["lang", "key"], "left")
            .withColumn("key", F.reverse("key"))
            .join(longer(suffix, "to_left").hint("merge"), ["lang", "key"], "left")
            .filter("coalesce(to_right, 0) < f and coalesce(to_left, 0) < f")
            .select("lang", F.reverse("key").alias("words"), "k", F.col("f").alias("a")))
    cuts = (kept.withColumn("cut", F.explode(F.expr("sequence(1, k - 1)")))
            .withColumn("key", F.expr("slice(words, 1, cut)"))
            .join(prefix.select("lang", "key", F.col("f").alias("l")).hint("merge"), ["lang", "key"])
            .withColumn("key", F.expr("slice(reverse(words), 1, k - cut)"))
            .join(suffix.select("lang", "key", F.col("f").alias("r")).hint("merge"), ["lang", "key"]))
    best = (join_small(cuts, total, ["lang"]).withColumn("score", F.expr(SCORE))
            .groupBy("lang", "words", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("b"))
            .select("lang", F.concat_ws(" ", "words").alias("phrase"), "a", "b.l", "b.r", "n", "b.score"))
    place = F.expr("row_number() over (partition by lang order by score desc, a desc, phrase asc)")
    return (best.withColumn("rank", place).filter(F.col("rank") <= top)
            .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"))


def op12(spark, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[.,;:!?\x0A-\x0D]')) AS p FROM documents WHERE text IS NOT NULL),
worded AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM worded GROUP BY lang),
starts AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i
    FROM worded, (SELECT unnest(range(1, 6)) AS k) WHERE len(w) >= k),
grams AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f
    FROM starts GROUP BY ALL HAVING count(*) >= 100),
kept AS (SELECT * FROM grams c WHERE k > 1 AND NOT EXISTS (SELECT 1 FROM grams d WHERE d.lang = c.lang
    AND d.k > c.k AND 100 * d.f >= 100 * c.f AND contains(' ' || d.phrase || ' ', ' ' || c.phrase || ' '))),
cuts AS (SELECT lang, phrase, f AS a, string_split(phrase, ' ') AS w, k, unnest(range(1, k)) AS cut FROM kept),
scored AS (SELECT c.lang, c.phrase, c.a, c.cut, x.f AS l, y.f AS r, t.n,
    (CAST(1000 AS HUGEINT) * c.a * t.n) // (CAST(x.f AS HUGEINT) * y.f) AS score
    FROM cuts c JOIN grams x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.cut], ' ')
    JOIN grams y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.cut + 1:c.k], ' ')
    JOIN totals t ON t.lang = c.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l,
    CAST(r AS BIGINT) AS r, n, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 2000
"""
