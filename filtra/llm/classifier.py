"""Quality classifier with supervised subword embeddings (operator 7).

Every word contributes its hashed word vector and its hashed character 3- to
5-gram vectors; a document is their average, and a softmax layer turns it into
class probabilities. Vectors and layer are trained together by numpy
stochastic gradient descent on a bounded sample of labelled rows, in a fixed
number of shards whose parameters are averaged after every round. As the model
is linear after the average, scoring needs one number per hashed feature.
"""

from __future__ import annotations

import operator
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filtra.llm.common import cut, fold, ship_package, table

SAMPLE_ROWS = 8192  # labelled rows used for training, at most
SHARDS = 8  # training shards
BLOCKS = 16  # pieces in which the shards' parameters are averaged
ROUNDS = 3  # parameter averages
EPOCHS = 3  # passes over a shard between two averages
BATCH = 32
DIM = 8
RATE = 0.25
WORD_BUCKETS = 1 << 16
GRAM_BUCKETS = 1 << 16
GRAMS = (3, 4, 5)
SEED = 7
MEMO_WORDS = 600_000
_AGAIN = b"\x00again"  # marks a word equal to the one before it
_LINE = b"\x00line"  # marks a line equal to an earlier one
_EMPTY = b"\x00empty"  # stands for a text without words


def _scramble(h: np.ndarray) -> np.ndarray:
    h = h.astype(np.uint64)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def word_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(indptr, ids): the hashed features of each word, word vector first."""
    n = len(words)
    if n == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.int64)
    raw = np.frombuffer(b"".join([b"<" + w + b">" for w in words]), dtype=np.uint8).astype(np.uint64)
    lens = np.array([len(w) + 2 for w in words], dtype=np.int64)
    ends = np.cumsum(lens)
    owner = np.repeat(np.arange(n), lens)
    stop = np.repeat(ends, lens)
    at = np.arange(len(raw))
    with np.errstate(over="ignore"):
        mult = np.uint64(0x100000001B3)
        # hashes of the windows [i, i + k) for growing k; the whole word by prefix sums
        own, ids = [np.arange(n)], []
        power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(int(lens.max()), mult)]))
        place = at - (stop - np.repeat(lens, lens))
        whole = np.add.reduceat((raw + np.uint64(1)) * power[place], ends - lens)
        ids.append((_scramble(whole) % np.uint64(WORD_BUCKETS)).astype(np.int64))
        for k in GRAMS:
            if len(raw) < k:
                continue
            h = np.full(len(raw) - k + 1, k, dtype=np.uint64)
            for j in range(k):
                h = (h * mult) ^ raw[j:len(raw) - k + 1 + j]
            ok = at[:len(h)] + k <= stop[:len(h)]
            own.append(owner[:len(h)][ok])
            ids.append((_scramble(h[ok]) % np.uint64(GRAM_BUCKETS)).astype(np.int64) + WORD_BUCKETS)
    own_all, id_all = np.concatenate(own), np.concatenate(ids)
    order = np.argsort(own_all, kind="stable")
    indptr = np.concatenate([[0], np.cumsum(np.bincount(own_all, minlength=n))])
    return indptr.astype(np.int64), id_all[order]


def doc_words(text: str) -> Counter:
    """Words of a whole text with counts, and the marks of repetition."""
    words = text.encode().split()
    if not words:
        return Counter((_EMPTY,))
    found = Counter(words)
    again = sum(map(operator.eq, words, words[1:]))
    lines = text.split("\n")
    repeated = len(lines) - len(set(lines)) if len(lines) > 1 else 0
    if again:
        found[_AGAIN] = again * 4
    if repeated:
        found[_LINE] = repeated * 4
    return found


class Model:
    """Embedding table and softmax layer."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.emb = (rng.random((WORD_BUCKETS + GRAM_BUCKETS, DIM), dtype=np.float32) - 0.5) / DIM
        self.out = (rng.random((DIM, 2), dtype=np.float32) - 0.5)
        self.bias = np.zeros(2, dtype=np.float32)

    def feature_scores(self) -> np.ndarray:
        """Log odds of class 1 per feature (before averaging)."""
        return (self.emb @ (self.out[:, 1] - self.out[:, 0])).astype(np.float64)


def train_shard(model: Model, texts: list[str], labels: np.ndarray, seed: int) -> Model:
    """Local stochastic gradient descent with per-feature step sizes."""
    vocab: dict[bytes, int] = {}
    docs = []
    for t in texts:
        c = doc_words(t)
        docs.append((np.array([vocab.setdefault(w, len(vocab)) for w in c], dtype=np.int64),
                     np.array(list(c.values()), dtype=np.float32)))
    indptr, ids = word_features(list(vocab))
    width = np.diff(indptr)
    emb, out, bias = model.emb.copy(), model.out.copy(), model.bias.copy()
    acc = np.full(len(emb), 1e-8, dtype=np.float32)
    acc_out = np.full(out.shape, 1e-3, dtype=np.float32)
    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        order = rng.permutation(len(docs))
        for at in range(0, len(order), BATCH):
            part = order[at:at + BATCH]
            feats, weights, sizes = [], [], []
            for d in part:
                w, c = docs[d]
                n = width[w]
                starts = np.repeat(indptr[w] - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
                feats.append(ids[starts + np.arange(n.sum())])
                weights.append(np.repeat(c, n) / float((c * n).sum()))
                sizes.append(len(feats[-1]))
            f, w = np.concatenate(feats), np.concatenate(weights).astype(np.float32)
            seg = np.repeat(np.arange(len(part)), sizes)
            begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            hidden = np.add.reduceat(emb[f] * w[:, None], begins)
            logits = hidden @ out + bias
            logits -= logits.max(axis=1, keepdims=True)
            p = np.exp(logits)
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(part)), labels[part]] -= 1  # now the gradient of the logits
            g_hidden = p @ out.T
            g_out = hidden.T @ p / len(part)
            by = np.argsort(f, kind="stable")
            uniq, first = np.unique(f[by], return_index=True)
            g_emb = np.add.reduceat(w[by, None] * g_hidden[seg[by]], first) / len(part)
            acc[uniq] += (g_emb ** 2).mean(axis=1)
            emb[uniq] -= RATE * g_emb / np.sqrt(acc[uniq])[:, None]
            acc_out += g_out ** 2
            out -= RATE * g_out / np.sqrt(acc_out)
            bias -= RATE * p.mean(axis=0)
    done = Model.__new__(Model)
    done.emb, done.out, done.bias = emb, out, bias
    return done


def training_rows(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """_shard, _label, _text of at most ``sample`` labelled documents outside the
    held-out fold, chosen by a hash of the id (one row per id)."""
    picked = (labels.filter("quality in (0, 1) and doc_id is not null").filter(fold("doc_id", 3) != 1)
              .groupBy("doc_id").agg(F.max("quality").alias("_label"))
              .orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(sample)
              .select(F.col("doc_id").alias("_id"), "_label"))
    # at most ``sample`` rows are broadcast
    rows = (docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text"))
            .join(F.broadcast(picked), F.col("doc_id") == F.col("_id")))
    one = rows.groupBy("_id").agg(F.max(F.struct(F.crc32(F.col("_text").cast("binary")), "_text")).alias("_t"),
                                  F.first("_label").alias("_label"))
    return one.select("_id", F.pmod(F.xxhash64("_id", F.lit(SEED + 1)), F.lit(SHARDS)).cast("int").alias("_shard"),
                      F.col("_label").cast("int").alias("_label"), F.col("_t._text").alias("_text"))


def _shard_trainer(round_no: int, sent):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m = Model.__new__(Model)
        m.emb, m.out, m.bias = sent.value
        pdf = pdf.sort_values("_id")
        shard = int(pdf["_shard"].iloc[0])
        done = train_shard(m, pdf["_text"].tolist(), pdf["_label"].to_numpy(), 1000 * round_no + shard)
        flat = np.concatenate([done.emb.ravel(), done.out.ravel(), done.bias.ravel()]).astype(np.float32)
        parts = np.array_split(flat, BLOCKS)
        return pd.DataFrame({"block": range(BLOCKS), "shard": shard, "n": len(pdf),
                             "part": [p.tobytes() for p in parts]})
    return run


def _average(pdf: pd.DataFrame) -> pd.DataFrame:
    """One block of the shards' parameters, averaged by their rows."""
    pdf = pdf.sort_values("shard")
    total = float(pdf["n"].sum())
    out = sum(np.float32(n / total) * np.frombuffer(p, np.float32) for n, p in zip(pdf["n"], pdf["part"]))
    return pd.DataFrame({"block": [int(pdf["block"].iloc[0])], "part": [out.astype(np.float32).tobytes()]})


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_ROWS) -> Model:
    """Rounds of local descent in SHARDS shards, each followed by an average.

    The shards' parameters are averaged block by block in tasks; the driver gets one set of a
    fixed size a round. Without labelled rows the model stays untrained with zero weights
    (every score is 0.5).
    """
    ship_package(docs.sparkSession)
    spark = docs.sparkSession
    rows = cut(training_rows(docs, labels, sample))
    model = Model()
    for r in range(ROUNDS):
        sent = spark.sparkContext.broadcast((model.emb, model.out, model.bias))
        parts = (rows.groupBy("_shard").applyInPandas(_shard_trainer(r, sent), "block int, shard int, n long, part binary")
                 .groupBy("block").applyInPandas(_average, "block int, part binary"))
        held = {p["block"]: np.frombuffer(p["part"], np.float32) for p in parts.toLocalIterator()}
        sent.unpersist()
        if not held:
            model.out[:] = 0
            return model
        flat = np.concatenate([held.pop(b) for b in range(BLOCKS)])
        at = np.cumsum([model.emb.size, model.out.size])
        emb, out, bias = np.split(flat, at)
        model.emb, model.out, model.bias = emb.reshape(model.emb.shape), out.reshape(model.out.shape), bias.copy()
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score: probability of class 1 for every whole text (null: empty)."""
    ship_package(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast((model.feature_scores(), float(model.bias[1] - model.bias[0])))
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches):
        per_feature, bias = sent.value
        memo: dict[bytes, tuple[float, int]] = {}
        for batch in batches:
            ids = batch.column("doc_id")
            texts = batch.column("text").to_pylist()
            out = np.empty(len(texts))
            for at in range(0, len(texts), 256):
                counts = [doc_words(t) for t in texts[at:at + 256]]
                missing = list({w for c in counts for w in c if w not in memo})
                fresh = {}
                for b in range(0, len(missing), 50_000):
                    part = missing[b:b + 50_000]
                    ptr, feats = word_features(part)
                    sums = np.add.reduceat(per_feature[feats], ptr[:-1])
                    fresh.update(zip(part, zip(sums.tolist(), np.diff(ptr).tolist())))
                if len(memo) + len(fresh) <= MEMO_WORDS:
                    memo.update(fresh)
                    fresh = {}
                for i, c in enumerate(counts, at):
                    top = bottom = 0.0
                    for w, k in c.items():
                        s, n = memo[w] if w in memo else fresh[w]
                        top += k * s
                        bottom += k * n
                    out[i] = 1.0 / (1.0 + np.exp(-np.clip(top / bottom + bias, -60, 60)))
            yield pa.RecordBatch.from_arrays([ids, pa.array(out)], schema=schema)

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return src.mapInArrow(run, "doc_id long, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``.

    Labels of documents in the held-out fold are never read; several labels of one
    id count as the highest, and one of its texts is used. Null and empty texts get
    a score of their own; repeated rows score alike; null ids are in the fold of the
    empty text. Only doc_id and text of ``docs``, doc_id and quality of ``labels``
    are read.
    """
    scored = score(docs, train(docs, labels, sample))
    return scored.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7(spark, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
