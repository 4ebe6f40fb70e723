"""Operators over documents against brute force, with odd rows and empty tables."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from filtra.llm import classifier, jaccard, maxent, mixing, packing, pii, rules, sharding, suffixes
from made_texts import prose

SF = "/root/testdata/sf0.001"
WS = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WS.findall(text or "")


def lower(text):
    return [w.encode().lower() for w in words(text)]


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module", params=["odd", "real"])
def docs(request, odd_docs, real):
    return odd_docs if request.param == "odd" else real


# --- 1 ---------------------------------------------------------------------

PATTERNS = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
            ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"),
            ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def brute_spans(text):
    out = []
    for kind, pattern in PATTERNS:
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card":
                total = sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(digits[::-1]))
                if not 14 <= len(digits) <= 19 or total % 10:
                    continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), m.end(), kind))
    return out


def test_pii_base_spans_random():
    import random
    rng = random.Random(4)
    for _ in range(20000):
        t = "".join(rng.choice("a@.1290+-( )é%") for _ in range(rng.randint(0, 40)))
        assert sorted(pii.base_spans(t)) == sorted(brute_spans(t))


def test_pii_long_runs_are_linear():
    for t in ("a" * 200_000 + "@", "1" * 200_000, "1 " * 100_000, "+1" + " " * 200_000, "1." * 100_000):
        pii.base_spans(t)
        pii.candidates(t)


def test_pii_query_columns(docs):
    got = pii.find(docs, pii.train(docs)).collect()
    want = sorted(hashlib.sha256(pii.join_spans(brute_spans(r.text or "")).encode()).hexdigest() for r in docs.collect())
    assert sorted(r.base_sha256 for r in got) == want
    for r in got:
        spans = [s.split(":") for s in r.spans.split(",") if s]
        assert len(spans) >= r.n_email + r.n_ip + r.n_card + r.n_phone


def test_pii_trees_add_lost_spans(spark):
    rows = []
    for i in range(400):
        phone, card = f"+1 (2{i % 90 + 10:02d}) 555-0{i % 900 + 100}", "4111111111111111"
        rows.append((i, f"word here {phone} and then {card} more a{i}@b.org text 10.1.{i % 200}.7 {i * 7919 % 99991:x}"))
    rows.append((1000, "word +1 (212) 555-0100 4111111111111111 more"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert brute_spans(rows[-1][1]) == []
    got = {r.doc_id: r.spans for r in pii.find(docs, pii.train(docs)).collect()}
    assert "phone:5:22" in got[1000] and "card:23:39" in got[1000]
    assert got[0].count(":") == 2 * 4


def test_pii_rare_kind_keeps_its_threshold(spark):
    """100 documents with a card among 3,000 rich in other numbers, and a small sample."""
    import random
    rng = random.Random(7)

    def card():
        d = "4" + "".join(rng.choice("0123456789") for _ in range(14))
        return next(d + x for x in "0123456789" if pii.luhn(d + x))
    rows = [(i, " ".join(f"{rng.randrange(10 ** 16):016d} x{i}" for _ in range(4)) + f" tel +1 (212) 555-0{i % 900 + 100} ok")
            for i in range(3000)]
    rows += [(5000 + i, f"paid by card {card()} today, order {i}") for i in range(100)]
    rows.append((9000, "word +1 (212) 555-0100 4111111111111111 more"))
    detector = pii.train(spark.createDataFrame(rows, "doc_id long, text string"), sample=800)
    assert detector.limits["phone"] < np.inf and detector.limits["card"] < np.inf


def test_pii_calibration_counts():
    assert pii._calibrate([(64, 18, 18), (32, 9, 10), (-5, 50, 50)]) == 1.0
    assert pii._calibrate([(64, 19, 19), (32, 0, 100)]) == float("inf")


def test_redact(docs):
    before = {(r.doc_id, r.text) for r in docs.collect()}
    out = pii.redact(docs, pii.train(docs))
    assert out.columns == docs.columns
    after = [r.text for r in out.collect()]
    assert len(after) == docs.count() and sum(t is None for t in after) == sum(t is None for _, t in before)
    assert not any(brute_spans(t) for t in after if t and "[" in t and "+1" not in t)


# --- 2 ---------------------------------------------------------------------

def test_mixing_meets_targets(spark):
    own = {"clean": "alpha beta gamma delta", "low": "junk noise blah mess", "toxic": "vile nasty rude mean"}
    rows, marks = [], []
    for i in range(900):
        d = ("clean", "clean", "clean", "low", "toxic")[i % 5]
        rows.append((i, " ".join([*own[d].split()[: 2 + i % 3], *[f"w{(i * j) % 53}" for j in range(20 + i % 40)]])))
        if i % 2:
            marks.append((i, d))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = mixing.mix(docs, spark.createDataFrame(marks, "doc_id long, domain string"))
    k = sorted(mixing.TARGETS)
    row = got.agg(F.sum("n_tokens").alias("n"), F.min("rate").alias("low_rate"),
                  *[F.sum(F.col("n_tokens") * F.col("rate") * F.col(f"p_{d}")).alias(d) for d in k]).first()
    assert row["n"] == sum(len(words(t)) for _, t in rows) and row["low_rate"] >= 0
    for d in k:
        assert row[d] == pytest.approx(mixing.TARGETS[d] * row["n"], rel=1e-3)
    assert got.filter(F.abs(sum(F.col(f"p_{d}") for d in k) - 1) > 1e-9).count() == 0
    sure = got.collect()
    assert sum(getattr(r, "p_" + ("clean", "clean", "clean", "low", "toxic")[r.doc_id % 5]) > 0.5 for r in sure) > 850


def test_mixing_out_of_reach(real, labels):
    """Too few labels to tell domains apart: targets are missed, totals stay sane."""
    got = mixing.mix(real, mixing.label_domains(labels))
    row = got.agg(F.sum("n_tokens").alias("n"), F.sum(F.col("n_tokens") * F.col("rate")).alias("m")).first()
    assert row["n"] == sum(len(words(r.text)) for r in real.collect())
    assert 0.5 * row["n"] < row["m"] < 2 * row["n"]


def test_mixing_slow_fit_is_finished(spark):
    """Bounds at zero slow this fit; it goes on until the gap is below 1e-7 of all tokens."""
    rng = np.random.default_rng(2)
    p, t = rng.dirichlet([0.3] * 3, 400), rng.integers(1, 400, 400)
    members = spark.createDataFrame([(int(a), *map(float, b)) for a, b in zip(t, p)],
                                    "_n_tokens long, _p_0 double, _p_1 double, _p_2 double")
    targets = np.array([0.9, 0.06, 0.04]) * t.sum()
    rate = np.ones(400)
    for step in mixing.fit_rates(members, targets).steps:
        rate = np.maximum(0, rate - p @ np.array(step))
    assert np.abs((t * rate) @ p - targets).max() / t.sum() < 1e-6


def test_mixing_odd_rows(odd_docs, labels, spark):
    got = mixing.mix(odd_docs, mixing.label_domains(labels)).collect()
    assert len(got) == odd_docs.count() and all(r.rate >= 0 for r in got)
    none = spark.createDataFrame([], "doc_id long, domain string")
    assert all(abs(r.p_clean - 1 / 3) < 1e-9 for r in mixing.mix(odd_docs, none).collect())


@pytest.mark.parametrize("most,wanted", [(None, (0.7, 0.2, 0.1)), (1.0, (1.15, 0.6, 0.4)), (1.0, (0.5, 0.5, 0.5)), (None, (0.98, 0.01, 0.01))])
def test_rates_reach_the_least_squares_optimum(spark, most, wanted):
    """Against plain projected gradient over a dense matrix, run to its end."""
    rng = np.random.default_rng(5)
    p = rng.dirichlet([0.4, 0.3, 0.2], 150)
    t = rng.integers(1, 400, 150).astype(float)
    have = (t[:, None] * p).sum(axis=0)
    targets = have * np.array(wanted) if most else t.sum() * np.array(wanted)
    df = spark.createDataFrame([(int(n), *map(float, row)) for n, row in zip(t, p, strict=True)],
                               "_n_tokens long, _p_0 double, _p_1 double, _p_2 double")
    fit = mixing.fit_rates(df, targets, most)
    assert len(fit.steps) < mixing.MAX_STEPS
    r = np.array([x["r"] for x in fit.add(df, "r").collect()])
    order = np.array([tuple(x)[0] for x in df.collect()])
    assert (order == t).all() and r.min() >= 0 and (most is None or r.max() <= most)
    a = t[:, None] * p
    gram = a.T @ p
    w = np.linalg.inv(gram + np.eye(3) * (mixing.RIDGE * np.trace(gram) / 3 + 1e-9))

    def loss(x):
        gap = a.T @ x - targets
        return gap @ w @ gap
    best = np.ones(150)
    size = 1 / np.linalg.eigvalsh(a @ w @ a.T).max()
    for _ in range(60000):
        best = np.clip(best - size * (a @ (w @ (a.T @ best - targets))), 0, most if most else np.inf)
    assert loss(r) <= loss(best) + 1e-3 * max(1.0, loss(np.ones(150)))
    assert np.allclose(fit.gaps, a.T @ r - targets, atol=1e-3 * t.sum())


# --- 6: the outcomes ---------------------------------------------------------

@pytest.mark.parametrize("spread", [1.05, 1.6])
def test_gradients_of_a_row_are_added_up_bit_for_bit_without_reduceat(spread, monkeypatch):
    """The weights are those of one ``reduceat`` over all sorted gradients, which is far slower."""
    rng = np.random.default_rng(4)
    rows = (rng.zipf(spread, (4096, 4)) - 1) % maxent.WORD_ROWS
    grad = rng.normal(size=(4096, maxent.WORDS)).astype(np.float32)
    w = rng.normal(size=(maxent.WORD_ROWS, maxent.WORDS)).astype(np.float32)
    acc = rng.random(maxent.WORD_ROWS).astype(np.float32)
    order = np.argsort(rows.ravel(), kind="stable")
    flat = rows.ravel()[order]
    uniq, first = np.unique(flat, return_index=True)
    assert np.diff(np.append(first, len(flat))).max() > 100
    g = np.add.reduceat(grad[order // 4], first)
    want, want_acc = w.copy(), acc.copy()
    want_acc[uniq] += (g ** 2).mean(axis=1)
    want[uniq] -= maxent.RATE * g / np.sqrt(want_acc[uniq] + 1.0)[:, None]

    class Slow:
        reduceat = None
    monkeypatch.setattr(maxent.np, "add", Slow)
    maxent._descend(w, acc, rows, grad)
    monkeypatch.undo()
    assert (w == want).all() and (acc == want_acc).all()


def test_every_token_has_its_exact_share_of_the_probability():
    """F2: tokens beyond the modelled outcomes are scored by shares of one outcome that add up to it,
    so the probabilities of all tokens, and of one unseen, sum to 1 after any history."""
    rng = np.random.default_rng(3)
    counts = sorted((int(x) for x in rng.integers(1, 500, 900)), reverse=True)
    words = [f"w{i}".encode() for i in range(len(counts))]
    assert len(words) > maxent.CLASSES * maxent.WORDS
    # 200 more tokens of one occurrence lie outside the broadcast vocabulary
    vocabulary = maxent.Vocabulary(words, counts, sum(counts) + 200, len(counts) + 200)
    model = maxent.Model(vocabulary)
    model.class_w += rng.normal(size=model.class_w.shape).astype(np.float32)
    model.word_w += rng.normal(size=model.word_w.shape).astype(np.float32)
    out = maxent.outcomes(np.arange(len(words)))
    _, _, feats, _ = maxent.encode(["w3 w700 unseen"], vocabulary)
    for history in feats:
        p = 10 ** maxent.log_probs(model, np.tile(history, (len(words), 1)), out)
        share = np.where(out == 0, (vocabulary.counts + 1) / vocabulary.other, 1.0)
        rest = 10 ** maxent.log_probs(model, history[None], np.zeros(1, np.int64))[0] * (200 * 2 + 1) / vocabulary.other
        assert abs((p * share).sum() + rest - 1) < 1e-4
    assert (out == 0).sum() == len(words) - (maxent.CLASSES * maxent.WORDS - 1)


def test_every_token_of_the_vocabulary_has_its_own_outcome():
    """beyond the first 575 a token's probability follows the history too, not its count alone; with
    those outside the vocabulary, and one unseen, all add up to 1."""
    rng = np.random.default_rng(4)
    counts = sorted((int(x) for x in rng.integers(1, 500, 1500)), reverse=True)
    words = [f"w{i}".encode() for i in range(len(counts))]
    vocabulary = maxent.Vocabulary(words, counts, sum(counts) + 200, len(counts) + 200)
    model = maxent.Model(vocabulary)
    assert model.depth == 3
    index = np.append(np.arange(len(words)), -1)
    out = maxent.outcomes(index)
    text = " ".join(["w700 w1400"] * 40)
    _, at, feats, _ = maxent.encode([text, "w3 w900 unseen"], vocabulary)

    def share(history):
        p = maxent.log_probs(model, np.tile(history, (len(index), 1)), out)
        below = out == 0
        p[below] += maxent.leaf_log_probs(model, np.tile(history, (int(below.sum()), 1)), maxent.leaves(index[below]))
        return 10 ** p
    # untrained: the smoothed counts
    want = np.append(vocabulary.counts + 1, vocabulary.rest) / (vocabulary.n + vocabulary.v + 1)
    assert np.allclose(share(feats[0]), want, rtol=2e-3, atol=1e-6)  # the first layers leave others 1e-3 each
    model.tail_w += rng.normal(size=model.tail_w.shape).astype(np.float32)
    for history in feats[-4:]:
        assert share(history).sum() == pytest.approx(1, abs=1e-4)
    model = maxent.Model(vocabulary)
    acc = np.zeros(len(model.tail_w), np.float32)
    below = maxent.outcomes(at) == 0
    for _ in range(20):
        maxent.descend_tail(model, acc, feats[below], maxent.leaves(at[below]))
    after_700, after_1400 = share(feats[1]), share(feats[2])
    assert after_700[1400] > 10 * after_1400[1400] and after_1400[700] > 10 * after_700[700]


# --- 3 ---------------------------------------------------------------------

def test_packing_round_trip(docs):
    from tokenizers import Tokenizer
    path = packing.default_tokenizer()
    tok = Tokenizer.from_file(path)
    got = packing.pack(docs, path, capacity=256, group_pieces=64).collect()
    want = collections.Counter()
    for r in docs.collect():
        ids = np.array([*tok.encode(r.text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        for p, s in enumerate(range(0, len(ids), 256)):
            part = ids[s:s + 256]
            want[(r.doc_id, p, s, len(part), zlib.crc32(part.tobytes()))] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    seqs = collections.defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256


def test_local_search_improves_best_fit():
    rng = np.random.default_rng(1)
    for _ in range(30):
        sizes = rng.integers(1, 101, rng.integers(1, 200))
        first = packing.best_fit(sizes, 100)
        bins = packing.pack_lengths(sizes, 100)
        assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
        assert all(sizes[b].sum() <= 100 for b in bins) and len(bins) <= len(first)
    # best fit decreasing needs three bins here; one exchange saves the third
    assert len(packing.pack_lengths(np.array([6, 5, 5, 4, 4, 3, 3]), 15)) == 2


def test_word_memo_equals_tokenizer():
    from tokenizers import Tokenizer
    path = packing.default_tokenizer()
    tok = Tokenizer.from_file(path)
    texts = ["à ̀b İstanbul ΑΣ \x1cfoo\x85bar <|endoftext|>y <|ENDOFTEXT|> it's I'LL 12 ½ ​日本語", "", " ", "A1b2... C''s"]
    for t, ids in zip(texts, packing.encode_texts(texts, path)):
        assert ids.tolist() == tok.encode(t, add_special_tokens=False).ids


# --- 5 ---------------------------------------------------------------------

def repeated(rows):
    """doc_id -> word positions in passages of 50 words that another row has too."""
    texts = [(d, lower(t)) for d, t in rows]
    where = collections.defaultdict(set)
    for row, (_, w) in enumerate(texts):
        for i in range(len(w) - 49):
            where[tuple(w[i:i + 50])].add(row)
    want = collections.defaultdict(set)
    for d, w in texts:
        for i in range(len(w) - 49):
            if len(where[tuple(w[i:i + 50])]) > 1:
                want[d].update(range(i, i + 50))
    return dict(want)


def found_passages(df, **how):
    got = collections.defaultdict(set)
    for r in suffixes.repeated_passages(df, **how).collect():
        got[r.doc_id].update(range(r.start, r.stop))
        assert r.n_words == r.stop - r.start >= 50
    return dict(got)


@pytest.mark.parametrize("crowd", [suffixes.CROWD, 0])
def test_repeated_passages(docs, crowd):
    """``crowd=0`` counts every window as a row of its own."""
    assert found_passages(docs, crowd=crowd) == repeated([(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize("times,crowd", [(50, suffixes.CROWD), (1000, suffixes.CROWD), (1000, 300)])
def test_passage_many_times_in_one_text(spark, times, crowd):
    """Sixty words ``times`` times in one text and once in another, either text first."""
    passage = prose(77, 60)
    often = " ".join(f"{prose(100 + i, 3)} {passage}" for i in range(times))
    once = f"{prose(5, 80)} {passage} {prose(6, 30)}"
    for rows in ([(0, often), (1, once)], [(0, once), (1, often)], [(0, often), (1, once), (2, once + " x"), (3, often + " y")]):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        got = found_passages(df, crowd=crowd)
        assert got == repeated(rows)
        assert min(map(len, got.values())) >= 60


def test_family_of_passages(spark):
    """Many texts with the same passage in different surroundings, shared to the left here, to the right there."""
    import random
    rng = random.Random(8)
    core, left, right = prose(1, 30), [prose(10 + i, 40) for i in range(4)], [prose(20 + i, 40) for i in range(4)]
    rows = [(i, f"{prose(1000 + i, rng.randint(0, 9))} {rng.choice(left)} {core} {rng.choice(right)} {prose(2000 + i, 5)}")
            for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = repeated(rows)
    assert len(want) == 120
    for crowd in (suffixes.CROWD, 20):
        assert found_passages(df, crowd=crowd) == want


def test_common_passage_travels_once_per_task(spark):
    """A passage of 130 words in 300 texts: its inner windows are of one context, however many texts hold
    it, so few rows are left to match."""
    passage = prose(31, 130)
    rows = [(i, f"{prose(3000 + i, 60)} {passage} {prose(4000 + i, 60)}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    found = suffixes.suffixes(df, suffixes.shared_grams(df)).cache()
    held, met = found.filter("c is not null").count(), found.filter("c is null")
    inner = met.filter("second != 9223372036854775807")
    assert held >= 300 and inner.count() <= 2 * inner.select("h", "x").distinct().count() <= 60
    assert all(len(r.r) // 4 + len(r.l) // 4 <= suffixes.LEFT + suffixes.PASSAGE for r in met.select("r", "l").collect())
    assert met.count() < held
    found.unpersist()
    want = repeated(rows)
    for crowd in (suffixes.CROWD, 5, 100):
        assert found_passages(df, crowd=crowd) == want


def test_minimisers_of_equal_windows():
    rng = np.random.default_rng(2)

    def anchors(words):
        line = " ".join(map(str, words)).encode()
        data = np.frombuffer(line, np.uint8)
        return suffixes.Texts(data, np.array([0, len(data)])).anchors()[0]
    w = rng.integers(0, 1 << 60, 400).tolist()
    pos = anchors(w)
    gaps = np.diff(np.concatenate([[-1], pos]))
    assert gaps.max() <= suffixes.WINDOW
    other = anchors(rng.integers(0, 1 << 60, 33).tolist() + w)
    inner = pos[(pos >= suffixes.WINDOW) & (pos < 300)]
    assert set(inner + 33) <= set(other.tolist())


# --- 6 ---------------------------------------------------------------------

def test_lm_scores(docs):
    import math
    got = maxent.lm_scores(docs).collect()
    rows = docs.collect()
    count = collections.Counter()

    def held(r):
        return zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 7 == 2
    for r in rows:
        if not held(r):
            count.update([*lower(r.text), b""])
    n, v = sum(count.values()), len(count)
    want = collections.Counter()
    for r in rows:
        t = [*lower(r.text), b""]
        base = sum(math.log10((count[w] + 1) / (n + v + 1)) for w in t)
        want[(r.doc_id, held(r), len(t), sum(count[w] > 0 for w in t), n, round(base, 5))] += 1
    assert collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5))
                               for r in got) == want
    assert all(r.score < 0 for r in got)


def test_lm_outcomes_sum_to_one():
    vocabulary = maxent.Vocabulary([b"a", b"b", b""], [5, 3, 2], 10, 3)
    m = maxent.Model(vocabulary)
    m.class_w += np.random.default_rng(0).normal(size=m.class_w.shape).astype(np.float32)
    _, _, feats, _ = maxent.encode(["a b c a"], vocabulary)
    every = np.arange(maxent.CLASSES * maxent.WORDS)
    total = 10.0 ** maxent.log_probs(m, np.repeat(feats[2:3], len(every), axis=0), every)
    assert total.sum() == pytest.approx(1, abs=1e-4)


def test_lm_every_position_trains(monkeypatch):
    """Over the rounds of a task each position given takes part in a gradient, once a round."""
    import types
    import pyarrow as pa
    texts = [f"w{i % 7} w{i % 5} w{i % 3} other" for i in range(600)]
    vocabulary = maxent.Vocabulary([b"w0", b"w1", b""], [5, 3, 2], 10, 3)
    seen = []
    monkeypatch.setattr(maxent, "TaskContext", types.SimpleNamespace(get=lambda: types.SimpleNamespace(partitionId=lambda: 0)))
    monkeypatch.setattr(maxent, "descend", lambda m, a, b, feats, out: seen.append((feats, out)))
    run = maxent._task_updates(types.SimpleNamespace(value=vocabulary),
                               types.SimpleNamespace(value=maxent.Model(vocabulary)), 0)
    list(run([pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])]))
    _, index, feats, _ = maxent.encode(texts, vocabulary)
    got = collections.Counter((*f, o) for fs, os in seen for f, o in zip(fs.tolist(), os.tolist()))
    assert got == collections.Counter((*f, o) for f, o in zip(feats.tolist(), maxent.outcomes(index).tolist()))


# --- 7 ---------------------------------------------------------------------

def test_classifier_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("doc_id < 4000")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = classifier.quality_scores(docs, labels)
    both = got.filter("held_out").join(labels, "doc_id").filter("quality is not null").collect()
    assert sum(r.predicted == r.quality for r in both) / len(both) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in both)
    own = F.when(classifier.fold("doc_id", 3) == 1, 1 - labels.quality).otherwise(labels.quality)
    flipped = labels.withColumn("quality", own)  # labels of the held-out fold are never read
    again = {r.doc_id: r.score for r in classifier.quality_scores(docs, flipped).collect()}
    assert all(again[r.doc_id] == r.score for r in both)


def test_classifier_odd_rows(odd_docs, labels, spark):
    got = classifier.quality_scores(odd_docs, labels).collect()
    assert len(got) == odd_docs.count()
    none = labels.filter("quality = 7")
    assert {r.score for r in classifier.quality_scores(odd_docs, none).collect()} == {0.5}


def test_word_features_vectorised():
    ptr, ids = classifier.word_features([b"ab", b"", b"word"])
    # "<ab>" has 2 + 1 grams, "<>" none, "<word>" 4 + 3 + 2; each has its word
    assert np.diff(ptr).tolist() == [4, 1, 10] and len(ids) == 15


# --- 8 ---------------------------------------------------------------------

def brute_counts(text):
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if words(x)]
    seen = collections.Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if seen[tuple(w[i:i + 8])] > 1 for j in range(i, i + 8)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def test_rules_counts(docs):
    got = rules.quality_rules(docs).collect()
    want = collections.Counter((r.doc_id, *brute_counts(r.text)) for r in docs.collect())
    assert collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
                               for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_rules_sketch_merges(docs):
    counted = rules.document_counts(docs.select("doc_id", "text", "lang", "source")).drop("text")
    whole = rules.sketches(counted)
    parts = rules.sketches(counted.filter("doc_id % 2 = 0")).union(
        rules.sketches(counted.filter("not (doc_id % 2 <=> 0)")))
    merged = parts.groupBy("lang", "source", "rate", "b").agg(F.sum("n").alias("n"))
    assert sorted(map(str, merged.collect())) == sorted(map(str, whole.collect()))


def test_rules_keep_good(docs):
    kept = rules.keep_good(docs)
    assert kept.columns == docs.columns
    want = collections.Counter(r.doc_id for r in rules.quality_rules(docs).filter("kept").collect())
    assert collections.Counter(r.doc_id for r in kept.collect()) == want


# --- 9 ---------------------------------------------------------------------

def brute_components(rows):
    sets = []
    for r in rows:
        w = lower(r.text)
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    groups = collections.defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(i)
    out = collections.Counter()
    for members in groups.values():
        ids = [rows[i].doc_id for i in members if rows[i].doc_id is not None]
        for i in members:
            out[(rows[i].doc_id, len(sets[i]), min(ids) if ids else None)] += 1
    return out, len(groups)


@pytest.mark.parametrize("small", [32, 2])
def test_jaccard_join(docs, small, monkeypatch):
    monkeypatch.setattr(jaccard, "SMALL", small)
    want, _ = brute_components(docs.collect())
    got = jaccard.jaccard_join(docs).collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want


def test_hashing_words_keeps_none_of_them():
    """A Python worker outlives its stage; what it keeps is memory of the next one."""
    import tracemalloc

    import pyarrow as pa
    import xxhash
    from filtra.llm.scan import strings
    from filtra.llm.shingles import word_hashes
    words = [b"w%d" % i for i in range(200_000)]
    tracemalloc.start()
    h = word_hashes(words)
    held, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert held < 2 * h.nbytes + 100_000
    assert h[:50].tolist() == [xxhash.xxh3_64_intdigest(w) for w in words[:50]]
    texts = pa.array(["a", None, "", "b"] * 200)
    assert list(strings(texts.slice(3, 700))) == texts.slice(3, 700).to_pylist() and list(strings(texts[:0])) == []


def test_jaccard_hot_shingles(odd_docs, monkeypatch):
    monkeypatch.setattr(jaccard, "HOT_CELL", 1)
    monkeypatch.setattr(jaccard, "SMALL", 2)
    want, _ = brute_components(odd_docs.collect())
    got = jaccard.jaccard_join(odd_docs).collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want


@pytest.mark.parametrize("local", [10**6, 3])
def test_jaccard_regions(docs, local, monkeypatch):
    """Regions a task can hold are settled without a round of splits; wider ones are split."""
    monkeypatch.setattr(jaccard, "SMALL", 2)
    monkeypatch.setattr(jaccard, "LOCAL", local)
    splits = []
    split = jaccard._split
    monkeypatch.setattr(jaccard, "_split", lambda *a: splits.append(1) or split(*a))
    want, _ = brute_components(docs.collect())
    got = jaccard.jaccard_join(docs).collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
    assert local == 3 or not splits


@pytest.mark.parametrize("seed", range(6))
def test_region_links_join_up_all_components(seed):
    rng = np.random.default_rng(seed)
    bases = [rng.choice(400, 60, replace=False) for _ in range(4)]
    sets = []
    for _ in range(60):
        keep = rng.random(60) < rng.choice([0.75, 0.88, 0.97])
        sets.append(np.unique(np.concatenate([bases[rng.integers(4)][keep], rng.choice(400, 4)])).astype(np.uint64))
    c, root = rng.permutation(60) + 100, np.arange(60)
    root[:6] = 0  # known to be connected

    def count(links):
        at = np.arange(60)
        for i, j in links:
            at[at == at[i]] = at[j]
        return at
    where = {int(x): i for i, x in enumerate(c)}
    known = [(0, i) for i in range(1, 6)]
    inter = np.array([[len(np.intersect1d(x, y)) for y in sets] for x in sets])
    size = np.array([len(x) for x in sets])
    linked = 100 * inter >= 75 * (size[:, None] + size - inter)
    want = count(known + [(i, j) for i, j in np.argwhere(linked)])
    found = [(where[a], where[b]) for a, b in jaccard.link_region(c, root, sets)]
    assert all(linked[i, j] for i, j in found) and len(found) < 60
    got = count(known + found)
    assert 1 < len(set(want)) < 55 and ((got[:, None] == got) == (want[:, None] == want)).all()


def test_one_per_group(docs):
    rows = docs.collect()
    _, groups = brute_components(rows)
    kept = jaccard.one_per_group(docs)
    assert kept.columns == docs.columns and kept.count() == groups


# --- 10 --------------------------------------------------------------------

def test_feistel_is_a_permutation():
    for n in (1, 2, 3, 5, 24, 1000, 4097):
        assert sorted(sharding.feistel(np.arange(n), n).tolist()) == list(range(n))


def test_sharding(docs):
    rows = docs.collect()
    got = sharding.shard_rows(docs, 7).collect()
    want = collections.Counter((r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in rows)
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    slots = collections.defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    counts = [len(slots[s]) for s in range(7)]
    assert max(counts) - min(counts) <= 1
    order = sorted(got, key=lambda r: r.row_number)
    assert [(r.doc_id is not None, r.doc_id or 0) for r in order] == sorted((r.doc_id is not None, r.doc_id or 0) for r in order)
    again = sharding.shard_rows(docs.repartition(3), 7).collect()
    assert collections.Counter((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in again) == collections.Counter(
        (r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in got)


# --- empty tables ----------------------------------------------------------

def test_empty_tables(no_docs, labels):
    none = labels.filter("doc_id is null")
    assert pii.find(no_docs, pii.train(no_docs)).count() == 0
    assert mixing.mix(no_docs, mixing.label_domains(none)).count() == 0
    assert packing.pack(no_docs, packing.default_tokenizer()).count() == 0
    assert suffixes.repeated_passages(no_docs).count() == 0
    assert maxent.lm_scores(no_docs).count() == 0
    assert classifier.quality_scores(no_docs, none).count() == 0
    assert rules.quality_rules(no_docs).count() == 0
    assert jaccard.jaccard_join(no_docs).count() == 0
    assert sharding.shard_rows(no_docs).count() == 0
