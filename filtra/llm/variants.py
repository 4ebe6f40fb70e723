"""Spelling variants by a bit-sliced position index (operator 11).

The vocabulary is cut into blocks in which words with one difference meet: of a
pair whose shorter word has m letters, one half of the letters is untouched, so
both words share their first m // 2 letters or their last m - m // 2. A block
that is too large is cut again in the same way within its open part, until one
letter is open. Buckets of whole blocks then get an index: for every (position,
letter) the set of the bucket's words with that letter there, one bit a word.
A query word walks its letters once and keeps four sets of words: no error so
far, one letter replaced, one more (positions shifted right), one fewer
(positions shifted left); every step handles 64 words an operation.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filtra.llm.common import cut, stored, table
from filtra.llm.scan import borders, chunks, word_hashes

LETTERS = 6  # code points of a word at least
OCCURRENCES = 5  # of a word at least
FACTOR = 5  # a form is so many times as frequent as its variant
SLIP = 199  # runs whose hash is a multiple lose a letter
CROWD = 4096  # rows of a block beyond which it is cut again
BUCKET = 4096  # rows of a bucket, about
QUERIES = 1024  # words that walk at once
_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ASCII = np.zeros(256, dtype=bool)
_ASCII[97:123] = True
_LEAD = 0xC3  # UTF-8 lead byte of U+00C0 to U+00FF, whose second byte is 0x80 to 0xBF


def _letter_bytes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of letters, lead bytes) of lower-cased UTF-8."""
    lead = data == _LEAD
    inside = _ASCII[data] | lead
    inside[1:] |= lead[:-1]
    return inside, lead


def _continued(crc: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """What ``sizes`` more bytes make of a crc32 besides those bytes' own crc32."""
    out = np.empty(len(crc), dtype=np.int64)
    for i, (c, n) in enumerate(zip(crc.tolist(), sizes.tolist(), strict=True)):
        zeros = bytes(n)
        out[i] = zlib.crc32(zeros, c) ^ zlib.crc32(zeros)
    return out


def _slipped(word: bytes, h: int) -> str:
    text = word.decode()
    at = h % len(text)
    return text[:at] + text[at + 1:]


def occurrences(docs: DataFrame) -> DataFrame:
    """word, n: partial counts of the words of whole texts, letters lost where the rule says so."""
    def run(batches):
        for batch in batches:
            ids = ["" if i is None else str(i) for i in batch.column("doc_id").to_pylist()]
            for lo, hi, raw, off in chunks(batch.column("text")):
                data = _LOWER[raw]
                inside, lead = _letter_bytes(data)
                starts, ends, before = borders(inside, off)
                leads = np.concatenate([[0], np.cumsum(lead, dtype=np.int64)])
                letters = ends - starts - (leads[ends] - leads[starts])
                doc = np.repeat(np.arange(hi - lo), np.diff(before))
                some = letters >= LETTERS
                starts, ends, doc = starts[some], ends[some], doc[some]
                if not len(starts):
                    continue
                size = ends - starts
                line = data.tobytes()
                order = np.argsort(h := word_hashes(data, starts, ends), kind="stable")
                new = np.concatenate([[True], h[order][1:] != h[order][:-1]])
                kind = np.empty(len(h), dtype=np.int64)
                kind[order] = np.cumsum(new) - 1
                pick = order[new]
                words = [line[a:b] for a, b in zip(starts[pick].tolist(), ends[pick].tolist(), strict=True)]
                # crc32 of "<doc_id>:" continued by a word depends on the first's crc and the word's length and crc
                own = np.fromiter(map(zlib.crc32, words), dtype=np.int64, count=len(words))
                head = np.array([zlib.crc32(f"{i}:".encode()) for i in ids[lo:hi]], dtype=np.int64)
                case, back = np.unique(doc * (int(size.max()) + 1) + size, return_inverse=True)
                shift = _continued(head[case // (int(size.max()) + 1)], case % (int(size.max()) + 1))
                code = shift[back] ^ own[kind]
                slip = code % SLIP == 0
                n = np.bincount(kind[~slip], minlength=len(words))
                lost = [_slipped(words[k], c) for k, c in zip(kind[slip].tolist(), code[slip].tolist(), strict=True)]
                lost = [w for w in lost if len(w) >= LETTERS]
                out = [w for w, k in zip(words, n.tolist(), strict=True) if k]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out + [w.encode() for w in lost], pa.binary()).cast(pa.string()),
                     pa.array(np.concatenate([n[n > 0], np.ones(len(lost), np.int64)]))], names=["word", "n"])

    src = docs.select(F.col("doc_id").cast("string").alias("doc_id"),
                      F.col("text").cast("string").alias("text")).filter("text is not null")
    return src.mapInArrow(run, "word string, n long")


def vocabulary(docs: DataFrame, least: int = OCCURRENCES) -> DataFrame:
    """word, n of the words that occur ``least`` times or more."""
    return occurrences(docs).groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


# --- blocks ------------------------------------------------------------------

def _halves(m: str, lo: str, hi: str) -> str:
    """SQL for the two ways to fix half of the letters that are open between the first ``lo``
    and the last ``hi`` of ``m``: the difference lies behind or before them."""
    half = f"(({m} - {lo} - {hi}) div 2)"
    return (f"array(named_struct('lo', {lo} + {half}, 'hi', {hi}),"
            f" named_struct('lo', {lo}, 'hi', {m} - {lo} - {half}))")


def _key() -> F.Column:
    return F.expr("struct(m, lo, hi, substring(word, 1, cast(lo as int)) as head,"
                  " if(hi = 0, '', right(word, cast(hi as int))) as tail)")


def _cut_blocks(rows: DataFrame) -> DataFrame:
    return (rows.withColumn("p", F.explode(F.expr(_halves("m", "lo", "hi"))))
            .withColumns({"lo": F.col("p.lo").cast("long"), "hi": F.col("p.hi").cast("long")})
            .withColumn("key", _key()).select("word", "n", "m", "lo", "hi", "key"))


def blocks(words: DataFrame, crowd: int = CROWD) -> DataFrame:
    """word, n, key: every word in the blocks in which its near words are.

    A word of L letters is the shorter or an equal one of pairs with m = L and the longer one
    of pairs with m = L - 1.
    """
    start = words.withColumn("m", F.explode(F.expr(
        "filter(array(length(word) - 1L, length(word) + 0L), x -> x >= %d)" % LETTERS)))
    open_rows = _cut_blocks(start.withColumns({"lo": F.lit(0).cast("long"), "hi": F.lit(0).cast("long")}))
    done = None
    while True:
        open_rows = stored(open_rows, "blocks")
        large = (open_rows.filter("m - lo - hi > 1").groupBy("key").agg(F.count(F.lit(1)).alias("k"))
                 .filter(F.col("k") > crowd).select("key"))
        large = cut(large)
        last = large.isEmpty()
        now = (open_rows if last else open_rows.join(large, "key", "left_anti")).select("word", "n", "key")
        done = now if done is None else done.union(now)
        if last:
            return done
        open_rows = _cut_blocks(open_rows.join(large, "key", "left_semi").select("word", "n", "m", "lo", "hi"))


# --- the index -----------------------------------------------------------------

class BitIndex:
    """Bit sets of words by (position, letter) and by length."""

    def __init__(self, codes: np.ndarray, sizes: np.ndarray):
        """``codes`` has the code points of all words one after the other."""
        self.codes, self.sizes = codes.astype(np.int64), sizes
        self.off = np.concatenate([[0], np.cumsum(sizes)])
        n = len(sizes)
        self.width = (n + 63) // 64
        word = np.repeat(np.arange(n), sizes)
        at = np.arange(len(codes)) - self.off[word]
        self.cells, row = np.unique((at << 21) | self.codes, return_inverse=True)
        self.sets = np.zeros((len(self.cells) + 1, self.width), dtype=_U)  # the last row: no word
        np.bitwise_or.at(self.sets, (row, word >> 6), _U(1) << (word & 63).astype(_U))
        self.lengths = {}
        for size in np.unique(sizes).tolist():
            bits = np.zeros(self.width, dtype=_U)
            ids = np.nonzero(sizes == size)[0]
            np.bitwise_or.at(bits, ids >> 6, _U(1) << (ids & 63).astype(_U))
            self.lengths[size] = bits

    def _with(self, at: int, letters: np.ndarray) -> np.ndarray:
        """For every query, the words that have its letter at position ``at``."""
        key = (at << 21) | letters
        row = np.minimum(np.searchsorted(self.cells, key), len(self.cells) - 1)
        return self.sets[np.where(self.cells[row] == key, row, len(self.cells))]

    def near(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, word) pairs that differ by exactly one letter, for word numbers of one length."""
        m = int(self.sizes[queries[0]])
        none = np.zeros(self.width, dtype=_U)
        full = np.full((len(queries), self.width), ~_U(0))
        same, replaced, more, fewer = full, np.zeros_like(full), full, np.zeros_like(full)
        here, last = None, None
        for i in range(m):
            letters = self.codes[self.off[queries] + i]
            # sets of words with this letter at the same place, one place on, one place back
            last, here = here, self._with(i, letters)
            back = self._with(i - 1, letters) if i else np.zeros_like(full)
            ahead = self._with(i + 1, letters)
            fewer = (fewer & back) | same
            replaced = (replaced & here) | (same & ~here)
            same = same & here
            more = (more & ahead) | same
        hit = ((replaced & self.lengths.get(m, none)) | (more & self.lengths.get(m + 1, none))
               | (fewer & self.lengths.get(m - 1, none)))
        q, w = np.nonzero(hit)
        bits = np.unpackbits(np.ascontiguousarray(hit[q, w]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        i, b = np.nonzero(bits)
        return queries[q[i]], w[i] * 64 + b


def near_words(words: list[str], index_limit: int = QUERIES) -> tuple[np.ndarray, np.ndarray]:
    """All ordered pairs (numbers) of distinct ``words`` with exactly one difference."""
    if len(words) < 2:
        none = np.zeros(0, np.int64)
        return none, none
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    index = BitIndex(np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32), sizes)
    left, right = [], []
    order = np.argsort(sizes, kind="stable")
    for part in np.split(order, np.nonzero(np.diff(sizes[order]))[0] + 1):
        for lo in range(0, len(part), index_limit):
            a, b = index.near(part[lo:lo + index_limit])
            left.append(a)
            right.append(b)
    return np.concatenate(left), np.concatenate(right)


def near_pairs(words: DataFrame, crowd: int = CROWD, bucket: int = BUCKET) -> DataFrame:
    """word, near, near_n: both directions of every pair of words with exactly one difference."""
    rows = blocks(words, crowd)
    buckets = max(1, -(-rows.count() // bucket))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        mates = pdf[pdf["key"].duplicated(keep=False)].drop_duplicates("word")
        text, n = mates["word"].tolist(), mates["n"].to_numpy()
        a, b = near_words(text)
        return pd.DataFrame({"word": [text[i] for i in a.tolist()], "near": [text[i] for i in b.tolist()],
                             "near_n": n[b]})

    named = rows.select("word", "n", F.xxhash64("key").alias("key"))
    return (named.withColumn("bucket", F.pmod("key", F.lit(buckets))).groupBy("bucket")
            .applyInPandas(run, "word string, near string, near_n long").distinct())


# --- forms -----------------------------------------------------------------------

def _roots(forms: DataFrame) -> DataFrame:
    """word, root: forms followed to the last. A form is more frequent than its word, so there is
    no ring, and every round doubles the steps already made."""
    now = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        both = cut(now.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"),
                                                           F.col("further").isNotNull().alias("moved")))
        now = both.drop("moved")
        if both.filter("moved").isEmpty():
            return now


def variants(docs: DataFrame, crowd: int = CROWD, bucket: int = BUCKET) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of the vocabulary.

    Null and empty texts have no runs; a null doc_id counts as the empty text in a run's hash.
    Ties of a form go to the smallest word in code-point order, so the rows are the same on
    every run. Repeated rows count again. An empty table gives no rows. Only ``doc_id`` and
    ``text`` are read, so other columns cannot clash.
    """
    words = stored(vocabulary(docs), "vocabulary")
    best = (near_pairs(words, crowd, bucket).groupBy("word")
            .agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("b")))
    linked = stored(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.expr(f"if(-b.less >= {FACTOR} * n, b.near, null)").alias("form"),
        F.expr(f"if(-b.less >= {FACTOR} * n, -b.less, null)").alias("form_n")), "forms")
    roots = _roots(linked.filter("form is not null"))
    return (linked.join(roots, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))


def op11(spark, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))
