"""Repeated passages by super-k-mer partitioning (operator 13).

A window is PASSAGE consecutive words of a text. Its minimiser is the smallest
hash among its GRAM-word grams. Consecutive windows with the same minimiser
place travel as one packed string of words (a super-k-mer) to the bucket of
that minimiser's hash: equal windows have equal minimisers, so they meet in
one bucket, where the windows of all its strings are sorted and counted.
Equal strings are added up before they travel, so copies cost one string.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filtra.llm.bitmaps import bitmap, holds
from filtra.llm.common import join_small, shuffle_width, stored, table
from filtra.llm.scan import (SPACES, borders, chunks, counted, gram_hashes, joined, mix, slide_min,
                             word_hashes)

PASSAGE = 35  # words of a window
GRAM = 8  # words whose hash selects a place
CROWD = 8192  # strings of one minimiser beyond which its windows are counted one by one
BLOCK_BYTES = 16 << 20  # packed strings sorted at once within a bucket's task
_U = np.uint64
_HIGH = _U(0xFFFFFFFF00000000)


class Words:
    """Words of a chunk of texts: borders, hashes, and each word's text."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        self.inside = ~SPACES[data]
        self.data = data
        self.starts, self.ends, self.before = borders(self.inside, off)
        self.count = np.diff(self.before)

    def hashes(self) -> np.ndarray:
        return word_hashes(self.data, self.starts, self.ends)

    def joined(self) -> tuple[bytes, np.ndarray]:
        return joined(self.data, self.inside, self.starts, self.ends)


def cut_runs(h: np.ndarray, before: np.ndarray, passage: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, minimiser hash) of every super-k-mer.

    ``before`` has the number of words before each text and after the last. Of equal
    minima the leftmost counts, so equal windows select the same place within them.
    A place's hash is compared by its upper half; the lower half of the sort key is the place.
    """
    n = len(h)
    if n < passage:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, _U)
    g = gram_hashes(h, gram)
    low = slide_min((g & _HIGH) | np.arange(len(g), dtype=_U), passage - gram + 1)
    place = (low & ~_HIGH).astype(np.int64)
    size = np.diff(before)
    text_end = np.repeat(before[1:], size)
    ok = np.arange(n - passage + 1) + passage <= text_end[:n - passage + 1]
    turn = np.concatenate([[True], place[1:] != place[:-1]])  # the place belongs to one text alone
    first = ok & (turn | np.concatenate([[True], ~ok[:-1]]))
    last = ok & np.concatenate([turn[1:] | ~ok[1:], [True]])
    first, last = np.nonzero(first)[0], np.nonzero(last)[0]
    return first, last, g[place[first]]


def _texts(batch: pa.RecordBatch):
    yield from chunks(batch.column("text"))


def _source(docs: DataFrame, *cols) -> DataFrame:
    return docs.select(*cols, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def shared_minimisers(docs: DataFrame, passage: int, gram: int) -> DataFrame:
    """h: minimiser hashes selected at two or more places."""
    def run(batches):
        for batch in batches:
            for _, _, data, off in _texts(batch):
                w = Words(data, off)
                _, _, h = cut_runs(w.hashes(), w.before, passage, gram)
                h, _, n = counted(h)
                if len(h):
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])

    return (_source(docs).mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
            .filter("n > 1").select("h"))


def _runs(docs: DataFrame, bits, passage: int, gram: int, with_string: bool) -> DataFrame:
    """Super-k-mers whose minimiser may occur elsewhere: h, d (hash of the string) and either
    the string and its count in the chunk, or the text's digest and the first window's number."""
    def run(batches):
        held = bits.value
        for batch in batches:
            for _, _, data, off in _texts(batch):
                w = Words(data, off)
                first, last, h = cut_runs(w.hashes(), w.before, passage, gram)
                some = holds(held, h)
                first, last, h = first[some], last[some], h[some]
                if not len(first):
                    continue
                line, at = w.joined()
                end = at + (w.ends - w.starts)
                packed = [line[a:b] for a, b in zip(at[first].tolist(), end[last + passage - 1].tolist(), strict=True)]
                d = np.array([xxhash.xxh3_64_intdigest(p) for p in packed], dtype=_U)
                if with_string:
                    # a string's own name is its minimiser's hash and its own
                    _, pick, n = counted(mix(h) ^ d)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(h[pick].view(np.int64)), pa.array(d[pick].view(np.int64)),
                         pa.array([packed[i] for i in pick], pa.binary()), pa.array(n)], names=["h", "d", "packed", "n"])
                    continue
                text = np.searchsorted(w.before, first, side="right") - 1
                whole = data.tobytes()
                keys = {t: hashlib.md5(whole[off[t]:off[t + 1]]).digest() for t in np.unique(text).tolist()}
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), pa.array(d.view(np.int64)),
                     pa.array([keys[t] for t in text.tolist()], pa.binary()),
                     pa.array(first - w.before[text])], names=["h", "d", "text_key", "pos"])

    kind = "h long, d long, " + ("packed binary, n long" if with_string else "text_key binary, pos long")
    return _source(docs).mapInArrow(run, kind)


def _repeated(h: np.ndarray, packed: list[bytes], n: np.ndarray, passage: int) -> np.ndarray:
    """For every string of some whole buckets, the bits of its windows that occur twice or more.

    Windows are sorted by a 64-bit hash of their words; windows of one hash are then told
    apart by their words themselves.
    """
    line = b" ".join(packed) + b" "
    size = np.fromiter(map(len, packed), dtype=np.int64, count=len(packed)) + 1
    off = np.concatenate([[0], np.cumsum(size)])
    data = np.frombuffer(line, dtype=np.uint8)
    starts, ends, before = borders(data != 0x20, off)
    w = gram_hashes(word_hashes(data, starts, ends), passage)
    number = np.diff(before) - passage + 1  # windows of each string, one at least
    string = np.repeat(np.arange(len(packed)), number)
    inner = np.arange(len(string)) - np.repeat(np.cumsum(number) - number, number)
    at = before[:-1][string] + inner
    key = w[at]
    order = np.argsort(key, kind="stable")
    s = key[order]
    new = np.concatenate([[True], s[1:] != s[:-1]])
    # two windows of one hash are compared as bytes
    a, b = starts[at], ends[at + passage - 1]
    for i in np.nonzero(~new)[0].tolist():
        x, y = order[i - 1], order[i]
        if line[a[x]:b[x]] != line[a[y]:b[y]]:
            # one hash for different windows: sort that hash's windows by their words
            lo, hi = np.searchsorted(s, s[i]), np.searchsorted(s, s[i], side="right")
            part = sorted(order[lo:hi].tolist(), key=lambda k: line[a[k]:b[k]])
            order[lo:hi] = part
            for j in range(lo + 1, hi):
                x, y = order[j - 1], order[j]
                new[j] = line[a[x]:b[x]] != line[a[y]:b[y]]
    first = np.nonzero(new)[0]
    total = np.add.reduceat(n[string[order]], first)
    group = np.cumsum(new) - 1
    many = np.zeros(len(key), dtype=bool)
    many[order] = total[group] > 1
    out = np.zeros(len(packed), dtype=np.int64)
    np.bitwise_or.at(out, string[many], np.int64(1) << inner[many])
    return out


def _bucket_marks(strings: DataFrame, passage: int) -> DataFrame:
    """h, d, mask of strings with repeated windows; a task holds a few whole buckets at a time."""
    def flush(h, d, packed, n):
        mask = _repeated(h, packed, n, passage)
        some = mask != 0
        return pa.RecordBatch.from_arrays([pa.array(h[some]), pa.array(d[some]), pa.array(mask[some])],
                                          names=["h", "d", "mask"])

    def run(batches):
        held = []  # (h, d, packed, n) of batches not yet sorted
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append((batch.column("h").to_numpy(), batch.column("d").to_numpy(),
                         batch.column("packed").to_pylist(), batch.column("n").to_numpy()))
            size += batch.column("packed").nbytes
            if size < BLOCK_BYTES:
                continue
            h, d, n = (np.concatenate([x[i] for x in held]) for i in (0, 1, 3))
            packed = [p for x in held for p in x[2]]
            cut = int(np.searchsorted(h, h[-1]))  # the last bucket may go on in the next batch
            if cut:
                yield flush(h[:cut], d[:cut], packed[:cut], n[:cut])
            held = [(h[cut:], d[cut:], packed[cut:], n[cut:])]
            size = sum(map(len, held[0][2]))
        if held:
            h, d, n = (np.concatenate([x[i] for x in held]) for i in (0, 1, 3))
            yield flush(h, d, [p for x in held for p in x[2]], n)

    return (strings.repartition(shuffle_width(strings.sparkSession), "h").sortWithinPartitions("h")
            .mapInArrow(run, "h long, d long, mask long"))


def _crowd_marks(strings: DataFrame, passage: int) -> DataFrame:
    """The same for minimisers of very many strings: every window is a row of its own, named by
    128 bits of its words, and counted by an aggregate, so that no task holds the bucket."""
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            h, d, n = (batch.column(c).to_numpy() for c in ("h", "d", "n"))
            packed = batch.column("packed").to_pylist()
            for lo in range(0, len(packed), 4096):
                part = packed[lo:lo + 4096]
                size = np.fromiter(map(len, part), dtype=np.int64, count=len(part))
                off = np.concatenate([[0], np.cumsum(size + 1)])
                data = np.frombuffer(b" ".join(part) + b" ", dtype=np.uint8)
                starts, ends, before = borders(data != 0x20, off)
                word = word_hashes(data, starts, ends)
                number = np.diff(before) - passage + 1
                string = np.repeat(np.arange(len(part)), number)
                inner = np.arange(len(string)) - np.repeat(np.cumsum(number) - number, number)
                at = before[:-1][string] + inner
                yield pa.RecordBatch.from_arrays(
                    [pa.array(gram_hashes(word, passage)[at].view(np.int64)),
                     pa.array(gram_hashes(mix(word ^ _HIGH), passage)[at].view(np.int64)),
                     pa.array(h[lo:lo + 4096][string]), pa.array(d[lo:lo + 4096][string]),
                     pa.array(np.int64(1) << inner), pa.array(n[lo:lo + 4096][string])],
                    names=["w1", "w2", "h", "d", "bit", "n"])

    rows = strings.mapInArrow(run, "w1 long, w2 long, h long, d long, bit long, n long")
    many = rows.groupBy("w1", "w2").agg(F.sum("n").alias("total")).filter("total > 1").drop("total")
    return rows.join(many, ["w1", "w2"]).groupBy("h", "d").agg(F.bit_or("bit").alias("mask"))


def marks(docs: DataFrame, passage: int = PASSAGE, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """text_key, runs: for every text with repeated windows, (number of the first window, bits)
    of its super-k-mers that hold some. Equal texts share one row."""
    if not 1 <= gram <= passage or passage - gram + 1 > 62:
        raise ValueError("a super-k-mer's windows must fit into 62 bits")
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(shared_minimisers(docs, passage, gram), "h"))
    strings = stored(_runs(docs, bits, passage, gram, True).groupBy("h", "d", "packed")
                     .agg(F.sum("n").alias("n")), "superkmers")
    crowded = strings.groupBy("h").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") > crowd).select(
        "h", F.lit(True).alias("crowded"))
    tagged = join_small(strings, crowded, ["h"], "left")
    found = (_bucket_marks(tagged.filter("crowded is null").drop("crowded"), passage)
             .union(_crowd_marks(tagged.filter("crowded").drop("crowded"), passage)))
    places = _runs(docs, bits, passage, gram, False).distinct()
    return (places.join(found, ["h", "d"]).groupBy("text_key")
            .agg(F.collect_list(F.struct("pos", "mask")).alias("runs")))


def strip(docs: DataFrame, passage: int = PASSAGE, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """doc_id, n_words, n_removed, kept, kept_sha256 for every row of ``docs``.

    Every word that lies in a window found twice or more, anywhere, is removed; ``kept``
    holds the other words joined by one space. Null and empty texts have no words and
    keep the empty text. Texts shorter than a window keep all words. Repeated rows are
    copies of each other; each gets its own row. An empty table gives no rows. Only
    ``doc_id`` and ``text`` are read, so other columns cannot clash.
    """
    def run(batches):
        for batch in batches:
            runs = batch.column("runs")
            for lo, hi, data, off in _texts(batch):
                w = Words(data, off)
                edge = np.zeros(len(w.starts) + 1, dtype=np.int64)
                part = runs.slice(lo, hi - lo)
                size = pc.fill_null(pc.list_value_length(part), 0).to_numpy(zero_copy_only=False)
                flat = part.flatten()
                if len(flat):
                    pos = flat.field("pos").to_numpy(zero_copy_only=False) + np.repeat(w.before[:-1], size)
                    mask = flat.field("mask").to_numpy(zero_copy_only=False)
                    for b in range(passage - gram + 1):
                        at = pos[(mask >> b) & 1 == 1] + b
                        np.add.at(edge, at, 1)
                        np.add.at(edge, at + passage, -1)
                gone = np.cumsum(edge[:-1]) > 0
                total = np.concatenate([[0], np.cumsum(gone)])
                n_gone = total[w.before[1:]] - total[w.before[:-1]]
                line, at = w.joined()
                width = w.ends - w.starts + 1
                chars = np.frombuffer(line, dtype=np.uint8)[np.repeat(~gone, width)].tobytes()
                upto = np.concatenate([[0], np.cumsum(np.where(gone, 0, width))])[w.before]
                kept = [chars[a:max(a, b - 1)] for a, b in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, hi - lo), pa.array(w.count, pa.int64()),
                     pa.array(n_gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()),
                     pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())],
                    names=["doc_id", "n_words", "n_removed", "kept", "kept_sha256"])

    src = _source(docs, F.col("doc_id").cast("long").alias("doc_id"))
    src = src.withColumn("text_key", F.unhex(F.md5("text")))
    return (src.join(marks(docs, passage, gram, crowd), "text_key", "left").select("doc_id", "text", "runs")
            .mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string, kept_sha256 string"))


def op13(spark, sf_dir: str) -> DataFrame:
    return strip(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


ORACLE = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT r, i, array_to_string(w[i:i + 34], ' ') AS s
    FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM docs WHERE len(w) >= 35)),
many AS (SELECT s FROM windows GROUP BY s HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS j FROM windows SEMI JOIN many USING (s)),
words AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM docs),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY j) AS text FROM words ANTI JOIN gone USING (r, j) GROUP BY r),
removed AS (SELECT r, count(*) AS n FROM gone GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
    sha256(coalesce(kept.text, '')) AS kept_sha256
FROM docs LEFT JOIN removed USING (r) LEFT JOIN kept USING (r)
"""
