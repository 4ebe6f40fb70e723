"""Language-model scoring with a hashed maximum-entropy model (operator 6).

A token's probability is that of its class times that of the token within its
class, two small softmax layers over hashed features of the history: the word
before, the pair before, and the words two and three places back (skips).
The tokens beyond the first CLASSES * WORDS - 1 are the leaves of a tree below
outcome 0, as deep as the vocabulary asks for, with a softmax layer at each level.
Tokens outside the broadcast vocabulary share one leaf, divided among them by
their smoothed counts. The weights start at the corpus's own frequencies
and are trained by distributed gradient updates: every task descends on its
documents and sends its changes, which are averaged after each round.
"""

from __future__ import annotations

from collections import Counter
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filtra.llm.common import fold, ship_package, stored, table

CLASSES = 24
WORDS = 24  # outcomes of a class; outcome 0 of class 0 stands for all other tokens, the leaves of a tree
KNOWN_TOKENS = 300_000  # most frequent tokens whose counts are broadcast; others are joined
CLASS_ROWS = 1 << 13  # hashed feature rows of the class layer
WORD_ROWS = 1 << 14  # of the word layer
TAIL_ROWS = 1 << 15  # of the tree's layers
ROUNDS = 2
BATCH = 4096
RUN = 8  # gradients of one row that are added up beside those of other rows
RATE = 0.15
TASK_TOKENS = 1_000_000  # a training task sends all its weights; one of fewer tokens is joined to its neighbours
BLOCKS = 16
SEED = 13
END = b""  # the end token; no word is empty
_U = np.uint64


def tokens(text: str) -> list[bytes]:
    words = text.encode().lower().split()
    words.append(END)
    return words


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


class Vocabulary:
    """The most frequent tokens in order, their counts, and the totals N and V."""

    def __init__(self, words: list[bytes], counts: list[int], n: int, v: int):
        self.index = {w: i for i, w in enumerate(words)}
        self.counts = np.array(counts, dtype=np.int64)
        self.n, self.v = n, v
        top = self.counts[:CLASSES * WORDS - 1]
        # mass of all tokens without an outcome of their own, and of one unseen token
        self.other = float(n - top.sum() + v - len(top) + 1)
        # leaves of the tree: 0 for the tokens outside this vocabulary, then one for each token beyond the top
        tail = self.counts[len(top):]
        self.rest = self.other - float(tail.sum() + len(tail))
        self.leaves = np.concatenate([[self.rest], tail + 1.0])
        self.depth = 0
        while WORDS ** self.depth < len(self.leaves):
            self.depth += 1
        self.logc = np.log10(self.counts + 1.0)

    def lookup(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.index.get, words, repeat(-1)), dtype=np.int64, count=len(words))


def count_tokens(docs: DataFrame) -> DataFrame:
    """token, c over all documents given; tasks add up what they have before it is shuffled."""
    def run(batches):
        schema = pa.schema([("token", pa.binary()), ("c", pa.int64())])
        held: Counter = Counter()
        for batch in batches:
            for t in batch.column("text").to_pylist():
                held.update(tokens(t))
            if len(held) > 1_000_000:
                yield from out(held, schema)
                held = Counter()
        yield from out(held, schema)

    def out(held, schema):
        words, counts = list(held), list(held.values())
        for at in range(0, len(words), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(words[at:at + 50_000], pa.binary()),
                                              pa.array(counts[at:at + 50_000], pa.int64())], schema=schema)

    return (docs.select("text").mapInArrow(run, "token binary, c long")
            .groupBy("token").agg(F.sum("c").alias("c")))


def frequent(counts: DataFrame, most: int) -> list:
    """The tokens above a count that at most ``most`` tokens reach, most frequent first.

    The count comes from a histogram of a fixed number of buckets (exact below 1024,
    a 256th of an octave above), so tasks send the driver no more than these rows.
    """
    bucket = F.when(F.col("c") < 1024, F.col("c")).otherwise(
        1024 + F.floor((F.log2(F.col("c").cast("double")) - 10) * 256)).cast("long")
    total, least = 0, None
    for r in sorted(counts.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: -r["b"]):
        total += r["n"]
        if total > most:
            break
        least = r["b"]
    if least is None:
        return []
    return sorted(counts.filter(bucket >= least).collect(), key=lambda r: (-r["c"], bytes(r["token"])))


class Model:
    """Weights of both layers; rows are hashed features, biases stand apart."""

    def __init__(self, vocabulary: Vocabulary):
        mass = np.full(CLASSES * WORDS, 1e-3)
        top = vocabulary.counts[:CLASSES * WORDS - 1]
        mass[1:len(top) + 1] = top + 1.0
        mass[0] = vocabulary.other
        mass = mass.reshape(CLASSES, WORDS)
        self.class_bias = np.log(mass.sum(axis=1) / mass.sum()).astype(np.float32)
        self.word_bias = np.log(mass / mass.sum(axis=1, keepdims=True)).astype(np.float32)
        self.class_w = np.zeros((CLASS_ROWS, CLASSES), dtype=np.float32)
        self.word_w = np.zeros((WORD_ROWS, WORDS), dtype=np.float32)
        self.depth = vocabulary.depth
        self.tail_w = np.zeros((TAIL_ROWS if self.depth else 0, WORDS), dtype=np.float32)
        # of every node the logarithms of its children's shares; children without a token have none
        mass = np.zeros(WORDS ** self.depth)
        mass[:len(vocabulary.leaves)] = vocabulary.leaves
        levels = []
        with np.errstate(divide="ignore", invalid="ignore"):
            for _ in range(self.depth):
                mass = mass.reshape(-1, WORDS)
                levels.append(np.log(mass / mass.sum(axis=1, keepdims=True)).astype(np.float32))
                mass = mass.sum(axis=1)
        self.tail_bias = np.concatenate(levels[::-1]) if levels else np.zeros((0, WORDS), dtype=np.float32)


def encode(texts: list[str], vocabulary: Vocabulary):
    """(docs, index, history, words): of all tokens of the texts in a row the number of
    the text, the vocabulary index (-1 none) and four feature hashes."""
    words, lens = [], []
    for t in texts:
        w = tokens(t)
        words.extend(w)
        lens.append(len(w))
    index = vocabulary.lookup(words)
    doc = np.repeat(np.arange(len(texts)), lens)
    with np.errstate(over="ignore"):
        h = _mix(index.astype(_U) + _U(1000))
        unknown = np.nonzero(index < 0)[0]
        if len(unknown):
            h[unknown] = np.fromiter(map(xxhash.xxh3_64_intdigest, map(words.__getitem__, unknown.tolist())), dtype=_U,
                                     count=len(unknown))
        begin = np.repeat(np.cumsum(lens) - lens, lens)
        place = np.arange(len(words)) - begin

        def back(k: int) -> np.ndarray:
            out = np.full(len(h), _U(77))
            out[k:] = h[:-k] if k < len(h) else out[k:]
            out[place < k] = _U(77)
            return out
        one, two, three = back(1), back(2), back(3)
        feats = np.stack([_mix(one + _U(1)), _mix(one * _U(0x9E3779B97F4A7C15) + two + _U(2)),
                          _mix(two + _U(3)), _mix(three + _U(4))], axis=1)
    return doc, index, feats, words


def outcomes(index: np.ndarray) -> np.ndarray:
    """Outcome of the class and word layers; which of the tokens of outcome 0 it is, is its leaf."""
    return np.where((index >= 0) & (index < CLASSES * WORDS - 1), index + 1, 0)


def leaves(index: np.ndarray) -> np.ndarray:
    """Leaf of tokens with outcome 0: their own, or 0 outside the vocabulary."""
    return np.where(index < 0, 0, index - (CLASSES * WORDS - 2))


def _tail(m: Model, feats: np.ndarray, leaf: np.ndarray):
    """(rows of the weights, node, child) at every level of the tree, level by level of a position."""
    size = WORDS ** np.arange(m.depth - 1, -1, -1)
    path = leaf[:, None] // size
    # nodes are numbered from the root, level by level
    node = path // WORDS + (WORDS ** np.arange(m.depth) - 1) // (WORDS - 1)
    with np.errstate(over="ignore"):
        rows = _mix(feats[:, None, :] + node.astype(_U)[:, :, None] * _U(0xA24BAED4963EE407)) & _U(TAIL_ROWS - 1)
    return rows.astype(np.int64).reshape(-1, feats.shape[1]), node.ravel(), (path % WORDS).ravel()


def _rows(feats: np.ndarray, cls: np.ndarray):
    with np.errstate(over="ignore"):
        a = (feats & _U(CLASS_ROWS - 1)).astype(np.int64)
        b = (_mix(feats + cls[:, None].astype(_U) * _U(0xD6E8FEB86659FD93)) & _U(WORD_ROWS - 1)).astype(np.int64)
    return a, b


def _softmax(z: np.ndarray) -> np.ndarray:
    # the maximum of a row, by halves as long as that goes: whole columns at a time
    top = z
    while top.shape[1] % 2 == 0:
        half = top.shape[1] // 2
        top = np.maximum(top[:, :half], top[:, half:])
    z -= top.max(axis=1, keepdims=True) if top.shape[1] > 3 else np.maximum.reduce(
        [top[:, j] for j in range(top.shape[1])])[:, None]
    np.exp(z, out=z)
    z /= z.sum(axis=1, keepdims=True)
    return z


def _gather(w: np.ndarray, rows: np.ndarray) -> np.ndarray:
    out = w.take(rows[:, 0], axis=0)
    one = np.empty_like(out)
    for j in range(1, rows.shape[1]):
        # row numbers are masked to the table's size; "clip" writes straight into ``one``
        out += w.take(rows[:, j], axis=0, out=one, mode="clip")
    return out


def log_probs(m: Model, feats: np.ndarray, out: np.ndarray) -> np.ndarray:
    """log10 probability of every outcome given its history."""
    result = np.empty(len(out))
    for at in range(0, len(out), BATCH):
        o = out[at:at + BATCH]
        cls, word = o // WORDS, o % WORDS
        a, b = _rows(feats[at:at + BATCH], cls)
        i = np.arange(len(o))
        p = _softmax(_gather(m.class_w, a) + m.class_bias)[i, cls]
        q = _softmax(_gather(m.word_w, b) + m.word_bias[cls])[i, word]
        result[at:at + BATCH] = np.log10(np.maximum(p.astype(np.float64) * q, 1e-30))
    return result


def leaf_log_probs(m: Model, feats: np.ndarray, leaf: np.ndarray) -> np.ndarray:
    """log10 probability of every leaf given its history and outcome 0."""
    result = np.zeros(len(leaf))
    step = max(1, BATCH // max(m.depth, 1))
    for at in range(0, len(leaf) if m.depth else 0, step):
        rows, node, child = _tail(m, feats[at:at + step], leaf[at:at + step])
        p = _softmax(_gather(m.tail_w, rows) + m.tail_bias.take(node, axis=0))[np.arange(len(child)), child]
        result[at:at + step] = np.log10(np.maximum(p.astype(np.float64), 1e-30)).reshape(-1, m.depth).sum(axis=1)
    return result


def _sums(grad: np.ndarray, at: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Sums of the gradients ``grad[at[f:f + n]]`` for all f, n of ``first`` and ``size`` (longest
    first), added up in the order of ``reduceat``: the first one plus the sum of the others."""
    out = grad.take(at[first], axis=0)
    longer = np.searchsorted(-size, -np.arange(RUN + 1), side="left")  # [k]: runs of more than k
    # runs of up to RUN: the second of all, the third, ... in turn
    start, stop = longer[RUN], longer[1]
    if start < stop:
        rest = grad.take(at[first[start:stop] + 1], axis=0)
        one = np.empty_like(rest)
        for k in range(2, RUN):
            n = longer[k] - start
            if n <= 0:
                break
            rest[:n] += grad.take(at[first[start:start + n] + k], axis=0, out=one[:n], mode="clip")
        out[start:stop] += rest
    # longer ones by length, each column in one piece
    ends = np.append(np.nonzero(np.diff(size[:start]))[0] + 1, start) if start else []
    begin = 0
    for end in ends:
        n, f = int(size[begin]), first[begin:end]
        x = grad.take(at[f[:, None] + np.arange(1, n)], axis=0).transpose(0, 2, 1)
        out[begin:end] += np.ascontiguousarray(x).sum(axis=2)
        begin = end
    return out


def _descend(w: np.ndarray, acc: np.ndarray, rows: np.ndarray, grad: np.ndarray) -> None:
    """Subtract the scaled sum of gradients from every touched row."""
    # row numbers fit in 16 bits, which numpy sorts by radix
    flat = rows.ravel().astype(np.uint16 if len(w) <= 1 << 16 else np.int64)
    order = np.argsort(flat, kind="stable")
    flat = flat[order]
    first = np.concatenate([[0], np.nonzero(flat[1:] != flat[:-1])[0] + 1])
    size = np.diff(np.append(first, len(flat)))
    longest = np.argsort((len(flat) - size).astype(np.uint16 if len(flat) <= 1 << 16 else np.int64), kind="stable")
    first, size = first[longest], size[longest]
    uniq = flat[first].astype(np.int64)
    g = _sums(grad, order // rows.shape[1], first, size)
    acc[uniq] += (g ** 2).mean(axis=1)
    scale = np.sqrt(acc[uniq] + 1.0)
    g *= RATE
    g /= scale[:, None]
    now = w.take(uniq, axis=0)
    now -= g
    w[uniq] = now


def descend(m: Model, acc_a: np.ndarray, acc_b: np.ndarray, feats: np.ndarray, out: np.ndarray) -> None:
    """Stochastic gradient steps over batches of positions, in place."""
    for at in range(0, len(out), BATCH):
        o = out[at:at + BATCH]
        cls, word = o // WORDS, o % WORDS
        a, b = _rows(feats[at:at + BATCH], cls)
        i = np.arange(len(o))
        p = _softmax(_gather(m.class_w, a) + m.class_bias)
        p[i, cls] -= 1
        _descend(m.class_w, acc_a, a, p)
        q = _softmax(_gather(m.word_w, b) + m.word_bias[cls])
        q[i, word] -= 1
        _descend(m.word_w, acc_b, b, q)


def descend_tail(m: Model, acc: np.ndarray, feats: np.ndarray, leaf: np.ndarray) -> None:
    """The same for the tree's layers, at the positions of outcome 0."""
    step = max(1, BATCH // max(m.depth, 1))
    for at in range(0, len(leaf) if m.depth else 0, step):
        rows, node, child = _tail(m, feats[at:at + step], leaf[at:at + step])
        p = _softmax(_gather(m.tail_w, rows) + m.tail_bias.take(node, axis=0))
        p[np.arange(len(child)), child] -= 1
        _descend(m.tail_w, acc, rows, p)


def _task_updates(vocab_sent, model_sent, round_no: int):
    """Per task: (part, block, delta, touched) of its changes to the weights."""
    def run(batches):
        vocabulary, m0 = vocab_sent.value, model_sent.value
        m = Model.__new__(Model)
        m.class_bias, m.word_bias = m0.class_bias, m0.word_bias
        m.depth, m.tail_bias = m0.depth, m0.tail_bias
        m.class_w, m.word_w, m.tail_w = m0.class_w.copy(), m0.word_w.copy(), m0.tail_w.copy()
        acc_a, acc_b, acc_t = (np.zeros(len(w), np.float32) for w in (m.class_w, m.word_w, m.tail_w))
        part = TaskContext.get().partitionId()
        held_f, held_i, held = [], [], 0

        def step():
            f, i = np.concatenate(held_f), np.concatenate(held_i)
            mixed = np.random.default_rng([SEED, round_no, len(i)]).permutation(len(i))
            f, i = f[mixed], i[mixed]
            o = outcomes(i)
            descend(m, acc_a, acc_b, f, o)
            if m.depth:
                descend_tail(m, acc_t, f[o == 0], leaves(i[o == 0]))

        for batch in batches:
            texts = batch.column("text").to_pylist()
            for at in range(0, len(texts), 256):
                _, index, feats, _ = encode(texts[at:at + 256], vocabulary)
                held_f.append(feats)
                held_i.append(index)
                held += len(index)
                if held > 1 << 18:
                    step()
                    held_f, held_i, held = [], [], 0
        if held:
            step()
        schema = pa.schema([("part", pa.int64()), ("block", pa.int32()), ("delta", pa.binary()), ("touched", pa.binary())])
        rows = []
        for name, acc, first in (("class_w", acc_a, 0), ("word_w", acc_b, BLOCKS), ("tail_w", acc_t, 2 * BLOCKS)):
            delta, hit = getattr(m, name) - getattr(m0, name), (acc > 0)
            size = len(delta) // BLOCKS
            for b in range(BLOCKS):
                part_hit = hit[b * size:(b + 1) * size]
                if part_hit.any():
                    rows.append((first + b, delta[b * size:(b + 1) * size].tobytes(), part_hit.astype(np.int32).tobytes()))
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int32()),
                 pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], schema=schema)
    return run


def _add_up(pdf: pd.DataFrame) -> pd.DataFrame:
    delta = sum((np.frombuffer(x, np.float32).astype(np.float64) for x in pdf["delta"]), 0.0)
    hit = sum((np.frombuffer(x, np.int32).astype(np.int64) for x in pdf["touched"]), 0)
    return pd.DataFrame({"block": [int(pdf["block"].iloc[0])], "delta": [delta.astype(np.float32).tobytes()],
                         "touched": [hit.astype(np.int32).tobytes()]})


def train(docs: DataFrame, vocabulary: Vocabulary, vocab_sent) -> Model:
    """Rounds of task-local descent over disjoint slices of all training documents.

    Changes are added up in two levels (64 partial sums a block), and a row's change
    is the mean over the tasks that touched it. The driver holds one set of weights.
    """
    model = Model(vocabulary)
    sc = docs.sparkSession.sparkContext
    tasks = max(sc.defaultParallelism, -(-vocabulary.n // (ROUNDS * TASK_TOKENS)))
    for r in range(ROUNDS):
        sent = sc.broadcast(model)
        part = docs.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(ROUNDS)) == r).select("text").coalesce(tasks)
        updates = part.mapInArrow(_task_updates(vocab_sent, sent, r), "part long, block int, delta binary, touched binary")
        some = (updates.groupBy("block", F.pmod("part", F.lit(64)).alias("_s"))
                .applyInPandas(_add_up, "block int, delta binary, touched binary"))
        for row in some.groupBy("block").applyInPandas(_add_up, "block int, delta binary, touched binary").collect():
            w = (model.class_w, model.word_w, model.tail_w)[row["block"] // BLOCKS]
            size = len(w) // BLOCKS
            b = (row["block"] % BLOCKS) * size
            delta = np.frombuffer(row["delta"], np.float32).reshape(size, -1)
            hit = np.frombuffer(row["touched"], np.int32)
            w[b:b + size] += delta / np.maximum(hit, 1)[:, None]
        sent.unpersist()
    return model


_SCORED = ("doc_id long, row long, n_tokens long, known long, base double, score double, "
           "rare array<struct<token:binary,n:int>>")


def score_pass(docs: DataFrame, vocab_sent, model_sent) -> DataFrame:
    """Per row what the broadcast vocabulary and model give; other tokens are listed in ``rare``."""
    item = pa.struct([("token", pa.binary()), ("n", pa.int32())])
    schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("n_tokens", pa.int64()), ("known", pa.int64()),
                        ("base", pa.float64()), ("score", pa.float64()), ("rare", pa.list_(item))])

    def run(batches):
        vocabulary, m = vocab_sent.value, model_sent.value
        rest = np.log10(vocabulary.rest)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            n, known, base, score = [], [], [], []
            rare, times, sizes = [], [], [0]
            for at in range(0, len(texts), 128):
                doc, index, feats, words = encode(texts[at:at + 128], vocabulary)
                k = len(texts[at:at + 128])
                out = outcomes(index)
                logc = np.where(index >= 0, vocabulary.logc[np.maximum(index, 0)], 0.0) if len(vocabulary.logc) \
                    else np.zeros(len(index))
                gain = log_probs(m, feats, out)
                below = np.nonzero(out == 0)[0]
                gain[below] += leaf_log_probs(m, feats[below], leaves(index[below]))
                gain -= np.where(index < 0, rest, 0.0)
                n.append(np.bincount(doc, minlength=k))
                known.append(np.bincount(doc, index >= 0, minlength=k).astype(np.int64))
                base.append(np.bincount(doc, logc, minlength=k))
                score.append(np.bincount(doc, gain, minlength=k))
                unknown = np.nonzero(index < 0)[0]
                unseen = list(map(words.__getitem__, unknown.tolist()))
                edges = np.searchsorted(doc[unknown], np.arange(k + 1)).tolist()
                for i, j in zip(edges[:-1], edges[1:], strict=True):
                    x = Counter(unseen[i:j])
                    rare.extend(x)
                    times.extend(x.values())
                    sizes.append(len(x))
            cat = lambda parts, t: pa.array(np.concatenate(parts) if parts else [], t)
            lists = pa.ListArray.from_arrays(
                pa.array(np.cumsum(sizes), pa.int32()),
                pa.StructArray.from_arrays([pa.array(rare, pa.binary()), pa.array(times, pa.int32())], fields=list(item)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row"), cat(n, pa.int64()), cat(known, pa.int64()),
                 cat(base, pa.float64()), cat(score, pa.float64()), lists.cast(pa.list_(item))], schema=schema)

    return docs.withColumn("row", F.monotonically_increasing_id()).select("doc_id", "row", "text").mapInArrow(run, _SCORED)


def lm_scores(docs: DataFrame, held_out: int = 2, folds: int = 7) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score per row.

    Counts cover every training document; those of the KNOWN_TOKENS most frequent
    tokens are broadcast, the others joined by a shuffle (none of them is frequent).
    Null and empty texts are one end token. Null ids fall in the fold of the empty
    text; repeated rows count and score as often as they occur. Without training
    documents every token is unseen and both scores are 0. An empty table gives
    no rows. Only doc_id and text are read.
    """
    ship_package(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    learn = src.filter(fold("doc_id", folds) != held_out)
    counts = stored(count_tokens(learn), "token-counts")
    totals = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    top = frequent(counts, KNOWN_TOKENS)
    vocabulary = Vocabulary([bytes(r["token"]) for r in top], [r["c"] for r in top], totals["n"] or 0, totals["v"])
    vocab_sent = sc.broadcast(vocabulary)
    model = train(learn, vocabulary, vocab_sent)
    passed = stored(score_pass(src, vocab_sent, sc.broadcast(model)), "lm-scores")
    rare = (passed.select("row", F.explode("rare").alias("x")).select("row", "x.token", "x.n")
            .join(counts, "token").groupBy("row")
            .agg(F.sum("n").alias("_known"), F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("_logc"))
            .withColumnRenamed("row", "_row"))
    full = passed.drop("rare").join(rare, F.col("row") == F.col("_row"), "left")
    extra = F.coalesce("_logc", F.lit(0.0))
    size = float(np.log10(vocabulary.n + vocabulary.v + 1.0))
    return full.select(
        "doc_id", (fold("doc_id", folds) == held_out).alias("held_out"), "n_tokens",
        (F.col("known") + F.coalesce("_known", F.lit(0))).alias("n_known"),
        F.lit(vocabulary.n).cast("long").alias("train_tokens"),
        (F.col("base") + extra - F.col("n_tokens") * size).alias("base_score"),
        (F.col("score") + extra).alias("score"))


def op6(spark, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))
