"""Collocations against brute force."""

import collections
import random
import re

import numpy as np
import pytest

from filtra.llm import phrases

SF = "/root/testdata/sf0.01"


def low(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text)


def brute(rows, least, longest, top):
    out = []
    by_lang = collections.defaultdict(list)
    for lang, text in rows:
        if text is not None:
            by_lang["und" if lang is None else lang].append(low(text))
    for lang, texts in by_lang.items():
        f, n = collections.Counter(), 0
        for text in texts:
            for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text):
                w = re.findall("[^ \t]+", piece)
                n += len(w)
                for k in range(1, longest + 1):
                    for i in range(len(w) - k + 1):
                        f[tuple(w[i:i + k])] += 1
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        gone = set()
        for p, a in found.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    q = p[i:i + k]
                    if 100 * a >= 100 * found[q]:
                        gone.add(q)
        scored = []
        for p, a in found.items():
            if p in gone:
                continue
            s, k = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-s, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n, -s))
    return sorted(out)


def ours(df, **how):
    got = phrases.collocations(df, **how)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in got.collect())


def pairs(df):
    return [(r["lang"], r["text"]) for r in df.select("lang", "text").collect()]


def test_given_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute(pairs(docs), 100, 5, 2000)
    assert len(want) > 50
    assert ours(docs) == want


@pytest.mark.parametrize("levels", [(), ((1,),), ((1, 2), (3,)), phrases.LEVELS, ((2,), (5,))])
def test_few_words(spark, levels):
    """Few words, so that long phrases are frequent, counts tie and parts are dropped."""
    rng = random.Random(len(levels))
    rows = [(rng.choice(["en", None, "und", "é"]),
             "".join(rng.choice(["a ", "B ", "c\t", "dé ", "d, ", "e\n", "\x00f ", "日 ", "x y z. ", "x y z "])
                     for _ in range(rng.randint(0, 80)))) for _ in range(120)]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    for least, top in ((3, 50), (20, 2000)):
        assert ours(df, least=least, top=top, levels=levels) == brute(rows, least, 5, top)


def test_phrase_inside_a_longer_one(spark):
    rows = [("en", "one two three four five six")] * 10 + [("en", "two three")]
    got = ours(spark.createDataFrame(rows, "lang string, text string"), least=5)
    # two three has one more occurrence than what holds it; the five-word phrases hold all others
    assert [r[2] for r in got] == sorted((r[2] for r in got), key=lambda p: [r for r in got if r[2] == p][0][1])
    assert {r[2] for r in got} == {"two three", "one two three four five", "two three four five six"}


def test_odd_rows(odd_docs, no_docs, spark):
    twice = odd_docs.union(odd_docs)
    assert ours(twice, least=2) == brute(pairs(twice), 2, 5, 2000)
    assert ours(no_docs) == []
    none = spark.createDataFrame([(None, None, 1, 1), ("en", " .,", 2, 2)], "lang string, text string, k int, f long")
    assert ours(none, least=1) == []


def test_products_pass_64_bits(spark):
    """The score of counts whose products do not fit into a long."""
    big = 4 * 10 ** 12
    df = spark.createDataFrame([(big, big + 7, big - 3, 3 * big)], "a long, l long, r long, n long")
    from pyspark.sql import functions as F
    got = df.select(F.expr(phrases.SCORE).alias("s")).first()["s"]
    assert got == 1000 * big * (3 * big) // ((big + 7) * (big - 3))


def test_key_planes():
    rng = np.random.default_rng(1)
    for kind in (np.uint8, np.uint16, np.uint32):
        keys = np.sort(rng.integers(0, 1 << phrases.KEY_BITS, 500).astype(np.uint64))
        n = rng.integers(1, 300, 500)
        got, counts = phrases._unplaned(phrases._planes(keys, n, kind), kind)
        assert (got == keys).all() and (counts == np.minimum(n, np.iinfo(kind).max)).all()
