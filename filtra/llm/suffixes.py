"""Repeated passages by sparse suffix arrays (operator 5).

Only suffixes that start at content-selected positions are kept: the minimiser
of every PASSAGE-word window, which two equal windows select at the same place.
Suffixes whose first words occur in one text only are dropped. A suffix stands for
the windows whose minimiser it is; their words are its context, and equal
contexts travel once, however many texts hold them. The contexts of a gram are
sorted as they begin 0, 1, ... words before it, neighbours with equal PASSAGE
words are matches, and a context's matches join up into ranges that reach as far
to the left and right as another text goes along. Every window that another text
has is met at its own minimiser, so the ranges are complete.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filtra.llm.bitmaps import bitmap, holds
from filtra.llm.common import cut, join_small, ship_package, shuffle_width, stored, table
from filtra.llm.scan import SPACES, borders, chunks, gram_hashes, mix, slide_min, word_hashes
from filtra.llm.shingles import set_key

PASSAGE = 50  # words a repeated passage has at least
GRAM = 8  # words hashed to select positions
WINDOW = PASSAGE - GRAM + 1  # grams of a window; one of them is its minimiser
RIGHT = PASSAGE  # words carried from a position on
LEFT = WINDOW - 1
CROWD = 4096  # contexts of one gram beyond which its windows are counted one by one
BLOCK_ROWS = 16384  # contexts sorted at once in a task, whole grams
NONE = np.iinfo(np.int64).max  # no second text
_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Texts:
    """Word hashes of a chunk of texts, A-Z lower-cased, and the selected positions."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        data = _LOWER[data]
        starts, ends, self.before = borders(~SPACES[data], off)
        self.h = word_hashes(data, starts, ends)
        self.count = np.diff(self.before)

    def names(self) -> list[int]:
        """A 64-bit name of each text's word sequence."""
        return [set_key(self.h[a:b]) for a, b in zip(self.before[:-1].tolist(), self.before[1:].tolist(), strict=True)]

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """(positions, gram hashes) of the minimisers of all PASSAGE-word windows; equal
        minima of a window are all kept."""
        n = len(self.h)
        if n < PASSAGE:
            return np.zeros(0, np.int64), np.zeros(0, _U)
        g = gram_hashes(self.h, GRAM)
        end = np.repeat(self.before[1:], self.count)
        inside = np.arange(n - PASSAGE + 1) + PASSAGE <= end[:n - PASSAGE + 1]
        low = np.where(inside, slide_min(g, WINDOW), _U(0))
        # a gram is a minimum of some window around it when the largest such minimum equals it
        none = np.zeros(WINDOW - 1, _U)
        wide = ~slide_min(~np.concatenate([none, low, none]), WINDOW)
        pos = np.nonzero((wide == g) & (g > 0))[0]
        return pos, g[pos]

    def reach(self, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(words to the left, words onward) of the windows whose minimiser each position is: they
        begin after the last smaller gram before it and end before the next one's end."""
        none = np.zeros(LEFT, _U)
        near = np.lib.stride_tricks.sliding_window_view(
            np.concatenate([none, gram_hashes(self.h, GRAM), none]), 2 * LEFT + 1) if len(self.h) >= GRAM else none
        nl, nr = np.zeros(len(pos), np.int64), np.zeros(len(pos), np.int64)
        for at in range(0, len(pos), 4096):
            g = near[pos[at:at + 4096]]
            less = np.pad(g < g[:, LEFT:LEFT + 1], ((0, 0), (1, 1)), constant_values=True)
            nl[at:at + 4096] = less[:, LEFT::-1].argmax(axis=1)
            nr[at:at + 4096] = less[:, LEFT + 2:].argmax(axis=1) + GRAM
        return nl, nr


def _source(docs: DataFrame, *cols) -> DataFrame:
    return docs.select(*cols, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def text_rows(docs: DataFrame) -> DataFrame:
    """doc_id, n, c: words of every text and a 64-bit name of its word sequence."""
    def run(batches):
        for batch in batches:
            for lo, hi, data, off in chunks(batch.column("text")):
                t = Texts(data, off)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, hi - lo), pa.array(t.count, pa.int64()),
                     pa.array(t.names(), pa.int64())], names=["doc_id", "n", "c"])

    return _source(docs, F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(run, "doc_id long, n long, c long")


def shared_grams(docs: DataFrame) -> DataFrame:
    """h: selected grams that two or more different texts hold. Every task first
    reduces a gram to its smallest and largest text, so no gram is a hot key."""
    def run(batches):
        for batch in batches:
            for _, _, data, off in chunks(batch.column("text")):
                t = Texts(data, off)
                pos, g = t.anchors()
                if not len(pos):
                    continue
                c = np.array(t.names(), dtype=np.int64)[np.searchsorted(t.before, pos, side="right") - 1]
                order = np.lexsort((c, g))
                g, c = g[order], c[order]
                first = np.concatenate([[0], np.nonzero(g[1:] != g[:-1])[0] + 1])
                last = np.concatenate([first[1:], [len(g)]]) - 1
                yield pa.RecordBatch.from_arrays([pa.array(g[first].view(np.int64)), pa.array(c[first]), pa.array(c[last])],
                                                 names=["h", "lo", "hi"])

    return (_source(docs).mapInArrow(run, "h long, lo long, hi long")
            .groupBy("h").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter("lo != hi").select("h"))


def suffixes(docs: DataFrame, grams: DataFrame) -> DataFrame:
    """The shared positions: rows h, x, c, pos of every suffix, and rows h, x, r, l, low, second of
    every context, with ``c`` null.

    A context, named ``x`` within its gram, is the words of the windows whose minimiser the
    position is, as 32-bit word hashes: ``r`` onward, ``l`` backward. A task sends the contexts
    it has met last once, with the two smallest texts that hold them, and equal texts once.
    """
    sent = docs.sparkSession.sparkContext.broadcast(bitmap(grams, "h"))

    def run(batches):
        bits = sent.value
        seen: set[int] = set()
        held, size = [], 0
        for batch in batches:
            for _, _, data, off in chunks(batch.column("text")):
                t = Texts(data, off)
                pos, g = t.anchors()
                names = t.names()
                fresh = np.zeros(len(names), dtype=bool)
                for i, c in enumerate(names):
                    if c not in seen:
                        seen.add(c)
                        fresh[i] = True
                text = np.searchsorted(t.before, pos, side="right") - 1
                some = holds(bits, g) & fresh[text]
                pos, g, text = pos[some], g[some], text[some]
                c, begin, end = np.array(names, dtype=np.int64)[text], t.before[text], t.before[text + 1]
                nl, nr = t.reach(pos)
                nl, nr = np.minimum(nl, pos - begin), np.minimum(nr, end - pos)
                short = np.concatenate([np.zeros(LEFT, np.uint32), (t.h >> _U(32)).astype(np.uint32),
                                        np.zeros(RIGHT, np.uint32)])
                for at in range(0, len(pos), 4096):
                    part = slice(at, at + 4096)
                    p, own = pos[part], g[part].view(np.int64)
                    r = short[p[:, None] + LEFT + np.arange(RIGHT)] * (np.arange(RIGHT) < nr[part, None])
                    l = short[p[:, None] + LEFT - 1 - np.arange(LEFT)] * (np.arange(LEFT) < nl[part, None])  # noqa: E741
                    x = context_names(r, l, nr[part], nl[part])
                    yield _rows(own, x, c=c[part], pos=p - begin[part])
                    held.append([own, x, c[part], np.full(len(p), NONE), nr[part], nl[part], r, l])
                    size += len(p)
                    if size >= BLOCK_ROWS:
                        held = [collapse(*[np.concatenate(a) for a in zip(*held, strict=True)])]
                        size = len(held[0][0])
                        if size > BLOCK_ROWS // 2:
                            yield _contexts(*held[0])
                            held, size = [], 0
        if held:
            yield _contexts(*collapse(*[np.concatenate(a) for a in zip(*held, strict=True)]))

    return _source(docs).mapInArrow(run, "h long, x long, r binary, l binary, low long, second long, c long, pos long")


def _rows(h: np.ndarray, x: np.ndarray, **cols) -> pa.RecordBatch:
    """Rows of ``suffixes``; columns that are not given are null."""
    kinds = {"r": pa.binary(), "l": pa.binary(), "low": pa.int64(), "second": pa.int64(), "c": pa.int64(), "pos": pa.int64()}
    return pa.RecordBatch.from_arrays(
        [pa.array(h), pa.array(x)] + [pa.nulls(len(h), kind) if k not in cols else cols[k] if kind == pa.binary()
                                      else pa.array(cols[k]) for k, kind in kinds.items()],
        names=["h", "x", *kinds])


def _contexts(h, x, low, second, nr, nl, r, l) -> pa.RecordBatch:  # noqa: E741
    return _rows(h, x, r=_packed(r, nr), l=_packed(l, nl), low=low, second=second)


def context_names(r: np.ndarray, l: np.ndarray, nr: np.ndarray, nl: np.ndarray) -> np.ndarray:  # noqa: E741
    """A hash of every row's words (zeros beyond nr and nl)."""
    a, b = nr.astype(_U), nl.astype(_U)
    factor = _U(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for k in range(RIGHT):
            a = a * factor + r[:, k]
        for k in range(LEFT):
            b = b * factor + l[:, k]
        return mix(mix(a) * factor + mix(b)).view(np.int64)


def collapse(h, x, low, second, *rest) -> list[np.ndarray]:
    """One row per context: the two smallest of its texts, and one row's other columns."""
    if not len(h):
        return [h, x, low, second, *rest]
    order = np.lexsort((x, h))
    hs, xs, lo = h[order], x[order], low[order]
    first = np.concatenate([[0], np.nonzero((hs[1:] != hs[:-1]) | (xs[1:] != xs[:-1]))[0] + 1])
    least, two = _two_smallest(lo, second[order], first)
    return [hs[first], xs[first], least, two, *[a[order[first]] for a in rest]]


def _two_smallest(low: np.ndarray, second: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of groups of pairs that begin at ``first``: the smallest value and the smallest other one (NONE: none)."""
    least = np.minimum.reduceat(low, first)
    of = np.repeat(least, np.diff(np.concatenate([first, [len(low)]])))
    return least, np.minimum.reduceat(np.where(low == of, second, low), first)


def _packed(rows: np.ndarray, n: np.ndarray) -> pa.Array:
    """The first n values of every row of a matrix as byte strings."""
    off = np.concatenate([[0], np.cumsum(n * rows.itemsize)]).astype(np.int32)
    flat = np.ascontiguousarray(rows[np.arange(rows.shape[1]) < n[:, None]])
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(off), pa.py_buffer(flat)])


def _matrix(col: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of every row, matrix of them with zeros behind) of byte strings of 32-bit numbers."""
    n = pc.binary_length(col).to_numpy().astype(np.int64) // 4
    out = np.zeros((len(col), width), dtype=np.uint32)
    out[np.arange(width) < n[:, None]] = np.frombuffer(b"".join(col.to_pylist()), np.uint32)
    return n, out


def window_keys(h: np.ndarray, r: np.ndarray, l: np.ndarray, seed: int = 0) -> np.ndarray:  # noqa: E741
    """(n, LEFT + 1) hashes: column d names the PASSAGE words that begin d words before the position."""
    n = len(h)
    factor = _U(0x9E3779B97F4A7C15 + 2 * seed)
    with np.errstate(over="ignore"):
        right = np.empty((n, RIGHT + 1), dtype=_U)
        right[:, 0] = 1
        for k in range(RIGHT):
            right[:, k + 1] = right[:, k] * factor + r[:, k]
        left = np.empty((n, LEFT + 1), dtype=_U)
        left[:, 0] = 1
        for k in range(LEFT):
            left[:, k + 1] = left[:, k] * factor + l[:, k]
        d = np.arange(LEFT + 1)
        return mix(mix(right[:, PASSAGE - d]) + mix(left + d.astype(_U)) * factor + h.view(_U)[:, None])


def _whole(nr: np.ndarray, nl: np.ndarray) -> np.ndarray:
    """Which of a suffix's windows lie within its text."""
    d = np.arange(LEFT + 1)
    return (nl[:, None] >= d) & (nr[:, None] >= PASSAGE - d)


def matches(h, x, low, second, nr, nl, r, l) -> pa.RecordBatch:  # noqa: E741
    """h, x, d0, d1, low, second of the contexts of some whole grams: the windows, by their distance
    to the left, that other texts have, and the two smallest texts that hold one of them."""
    h, x, low, second, nr, nl, r, l = collapse(h, x, low, second, nr, nl, r, l)  # noqa: E741
    row, d = np.nonzero(_whole(nr, nl))
    lows, seconds = (np.full((len(h), LEFT + 1), NONE) for _ in range(2))
    if len(row):
        key = window_keys(h, r, l)[row, d]
        order = np.argsort(key, kind="stable")
        s, at = key[order], (row[order], d[order])
        first = np.concatenate([[0], np.nonzero(s[1:] != s[:-1])[0] + 1])
        size = np.diff(np.concatenate([first, [len(s)]]))
        lows[at], seconds[at] = (np.repeat(a, size) for a in _two_smallest(low[at[0]], second[at[0]], first))
    return _ranges(h, x, lows, seconds)


def _ranges(h: np.ndarray, x: np.ndarray, lows: np.ndarray, seconds: np.ndarray) -> pa.RecordBatch:
    """Runs of matched windows of every context."""
    hit = seconds != NONE
    edge = np.zeros((len(h), 1), dtype=bool)
    row, d0 = np.nonzero(hit & ~np.concatenate([edge, hit[:, :-1]], axis=1))
    _, d1 = np.nonzero(hit & ~np.concatenate([hit[:, 1:], edge], axis=1))
    least, two = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(row):
        size = d1 - d0 + 1
        first = np.cumsum(size) - size
        least, two = _two_smallest(lows[hit], seconds[hit], first)  # the cells of the runs, in order
    return pa.RecordBatch.from_arrays(
        [pa.array(h[row]), pa.array(x[row]), pa.array(d0), pa.array(d1), pa.array(least), pa.array(two)],
        names=["h", "x", "d0", "d1", "low", "second"])


def _arrays(batch: pa.RecordBatch) -> list[np.ndarray]:
    (nr, r), (nl, l) = _matrix(batch.column("r"), RIGHT), _matrix(batch.column("l"), LEFT)  # noqa: E741
    return [*[batch.column(k).to_numpy() for k in ("h", "x", "low", "second")], nr, nl, r, l]


RANGES = "h long, x long, d0 long, d1 long, low long, second long"


def _gram_matches(found: DataFrame) -> DataFrame:
    """Matches of all grams but the crowded ones; a task holds a few whole grams at a time."""
    def run(batches):
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(_arrays(batch))
            size += batch.num_rows
            if size < BLOCK_ROWS:
                continue
            all_ = [np.concatenate(x) for x in zip(*held, strict=True)]
            at = int(np.searchsorted(all_[0], all_[0][-1]))  # the last gram may go on in the next batch
            if at:
                yield matches(*[x[:at] for x in all_])
            held = [[x[at:] for x in all_]]
            size -= at
        if held:
            yield matches(*[np.concatenate(x) for x in zip(*held, strict=True)])

    return (found.repartition(shuffle_width(found.sparkSession), "h").sortWithinPartitions("h").mapInArrow(run, RANGES))


def _crowd_matches(found: DataFrame) -> DataFrame:
    """The same for grams of very many contexts: every window is a row of its own, named by 128
    bits, and an aggregate finds the texts that have it, so that no task holds the gram. Windows
    of one text are left out by a bitmap before windows and texts meet again."""
    def windows(bits=None):
        def run(batches):
            for batch in batches:
                for at in range(0, batch.num_rows, 4096):
                    h, x, low, second, nr, nl, r, l = _arrays(batch.slice(at, 4096))  # noqa: E741
                    row, d = np.nonzero(_whole(nr, nl))
                    w1 = window_keys(h, r, l)[row, d].view(np.int64)
                    if bits is not None:
                        some = holds(bits.value, w1)
                        row, d, w1 = row[some], d[some], w1[some]
                    w2 = window_keys(h, r, l, 1)[row, d].view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(w1), pa.array(w2), pa.array(h[row]), pa.array(x[row]),
                                                      pa.array(d), pa.array(low[row]), pa.array(second[row])],
                                                     names=["w1", "w2", "h", "x", "d", "low", "second"])
        return found.mapInArrow(run, "w1 long, w2 long, h long, x long, d long, low long, second long")

    most = F.when(F.col("second") != int(NONE), F.col("second")).otherwise(F.col("low"))
    shared = cut(windows().groupBy("w1", "w2").agg(F.min("low").alias("low"), F.max(most).alias("second"))
                 .filter("low != second"))
    sent = found.sparkSession.sparkContext.broadcast(bitmap(shared, "w1"))
    rows = windows(sent).drop("low", "second").join(shared, ["w1", "w2"])
    w = Window.partitionBy("h", "x")  # at most LEFT + 1 rows, one for each window
    runs = rows.withColumn("_k", F.col("d") - F.row_number().over(w.orderBy("d")))
    return (runs.withColumn("_low", F.min("low").over(Window.partitionBy("h", "x", "_k")))
            .groupBy("h", "x", "_k").agg(F.min("d").alias("d0"), F.max("d").alias("d1"), F.min("low").alias("low"),
                                         F.min(F.expr("if(low = _low, second, low)")).alias("second"))
            .drop("_k"))


def _crowded(contexts: DataFrame, crowd: int) -> DataFrame:
    """``contexts`` with ``crowded`` true for those of grams of more than ``crowd`` rows, else null."""
    counts = contexts.groupBy("h").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") > crowd)
    return join_small(contexts, cut(counts.select("h", F.lit(True).alias("crowded"))), ["h"], "left")


def _context_matches(contexts: DataFrame, crowd: int) -> DataFrame:
    """Matches of all contexts. Those of a gram that very many tasks' rows hold are first
    brought to one row each; only a gram that has still too many goes window by window."""
    tagged = _crowded(contexts, crowd)
    few, many = tagged.filter("crowded is null").drop("crowded"), tagged.filter("crowded").drop("crowded")
    most = F.max(F.when(F.col("second") != int(NONE), F.col("second")).otherwise(F.col("low")))
    once = stored(many.groupBy("h", "x").agg(
        F.first("r").alias("r"), F.first("l").alias("l"), F.min("low").alias("low"), most.alias("second"))
        .withColumn("second", F.expr(f"if(low = second, {NONE}L, second)")), "contexts")
    tagged = _crowded(once, crowd)
    return (_gram_matches(few.unionByName(tagged.filter("crowded is null").drop("crowded")))
            .unionByName(_crowd_matches(tagged.filter("crowded").drop("crowded"))))


def _merge(ranges: DataFrame) -> DataFrame:
    """Union of a text's overlapping or adjoining ranges, with the smallest text that shares a part.

    The window runs over one text's ranges, which its length bounds."""
    w = Window.partitionBy("c").orderBy("start", "stop")
    reach = F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = ranges.withColumn("_new", F.when(F.coalesce(F.col("start") > reach, F.lit(True)), 1).otherwise(0))
    return (new.withColumn("_k", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
            .groupBy("c", "_k").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.min("other").alias("other"))
            .drop("_k"))


def repeated_passages(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """doc_id, start, stop, n_words, other_doc: every maximal range of words of a document
    made of passages of PASSAGE words or more that another document has too.

    Positions count words, ``stop`` is exclusive; A-Z is lower-cased. ``other_doc`` is the
    smallest id of one text that shares a part. Rows with equal texts of PASSAGE words
    or more are repeated as a whole; equal rows are several documents. Null, empty
    and shorter texts have no passage; documents without one give no row, nor does an
    empty table. Words and texts are compared by hashes (32 bits a word beside a 64-bit
    gram). Only doc_id and text are read.
    """
    ship_package(docs.sparkSession)
    rows = stored(text_rows(docs), "texts").filter(F.col("n") >= PASSAGE)
    classes = cut(rows.groupBy("c").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("low"),
                                        F.max("n").alias("n")))
    found = stored(suffixes(docs, shared_grams(docs)), "suffixes")
    met = _context_matches(found.filter("c is null").drop("c", "pos"), crowd)
    ranges = found.filter("c is not null").select("h", "x", "c", "pos").join(met, ["h", "x"]).select(
        "c", (F.col("pos") - F.col("d1")).alias("start"), (F.col("pos") - F.col("d0") + PASSAGE).alias("stop"),
        F.when(F.col("c") == F.col("low"), F.col("second")).otherwise(F.col("low")).alias("other"))
    copies = classes.filter("copies > 1").select("c", F.lit(0).cast("long").alias("start"), F.col("n").alias("stop"),
                                                 F.col("c").alias("other"))
    merged = _merge(ranges.union(copies).distinct())
    low = classes.select(F.col("c").alias("_c"), "low")
    spans = merged.join(low, F.col("other") == F.col("_c")).drop("_c").select(
        F.col("c").alias("_c"), "start", "stop", F.col("low").alias("other_doc"))
    return (rows.join(spans, F.col("c") == F.col("_c"))
            .select("doc_id", "start", "stop", (F.col("stop") - F.col("start")).alias("n_words"), "other_doc"))


def op5(spark, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))
