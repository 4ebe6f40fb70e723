"""Spelling variants against brute force."""

import random
import re
import zlib

import pytest

from filtra.llm import variants

SF = "/root/testdata/sf0.001"
RUN = re.compile("[A-Za-zÀ-ÿ]+")


def low(word):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in word)


def brute_counts(rows):
    n = {}
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            w = low(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % 199 == 0:
                at = h % len(w)
                w = w[:at] + w[at + 1:]
            if len(w) >= 6:
                n[w] = n.get(w, 0) + 1
    return {w: k for w, k in n.items() if k >= 5}


def one_apart(a, b):
    """Exactly one inserted, deleted or replaced code point."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) == len(b)):] == b[i + 1:]


def brute(rows):
    n = brute_counts(rows)
    holes, near = {}, {w: set() for w in n}
    for w in n:
        for key in {w} | {w[:i] + w[i + 1:] for i in range(len(w))}:
            holes.setdefault(key, []).append(w)
    for group in holes.values():
        for a in group:
            near[a].update(b for b in group if one_apart(a, b))
    form = {}
    for w, k in n.items():
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 5 * k else None
    out = []
    for w, k in n.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, k, len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def ours(df, **how):
    got = variants.variants(df, **how).select("word", "form", "root", "n", "n_near", "form_n").collect()
    return sorted(tuple(r) for r in got)


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_given_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute(pairs(docs))
    assert len(want) > 500 and any(r[1] for r in want)
    assert ours(docs) == want


def typos(seed, alphabet="abcé"):
    """Words, many of them one or two slips away from more frequent ones, and long ones."""
    rng = random.Random(seed)
    base = ["".join(rng.choice(alphabet) for _ in range(rng.randint(6, 9))) for _ in range(60)] + ["ab" * 60, "c" * 300]
    rows, i = [], 0
    for w in base:
        for _ in range(rng.choice([1, 5, 30, 160])):
            rows.append((i, w))
            i += 1
        for _ in range(4):
            at = rng.randrange(len(w))
            v = rng.choice([w[:at] + w[at + 1:], w[:at] + rng.choice(alphabet) + w[at:],
                            w[:at] + rng.choice(alphabet) + w[at + 1:]])
            rows += [(i + k, f"{v.upper() if k % 2 and v.isascii() else v}, {v}x1{v}") for k in range(rng.choice([1, 3, 8]))]
            i += 10
    return rows


@pytest.mark.parametrize("how", [{}, {"crowd": 4, "bucket": 64}, {"crowd": 1, "bucket": 100000}])
def test_typos_with_small_blocks(spark, how):
    rows = typos(7)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert max(r[4] for r in want) > 3
    assert ours(df, **how) == want


def test_chain_of_forms_and_ties(spark):
    """abcdefg -> abcdef -> abcdex is followed to the last; equal counts take the smaller word."""
    words = {"abcdefgh": 5, "abcdefg": 25, "abcdef": 130, "xbcdef": 700, "qqqqqqa": 30, "qqqqqqb": 30, "qqqqqqc": 5}
    # ids for which the rule takes no letter away
    rows = []
    for w, k in words.items():
        ids = (i for i in range(10 ** 6) if zlib.crc32(f"{i}:{w}".encode()) % 199)
        rows += [(next(ids), w) for _ in range(k)]
    got = {r[0]: r for r in ours(spark.createDataFrame(rows, "doc_id long, text string"))}
    assert {w: r[2] for w, r in got.items()} == {
        "abcdefgh": "xbcdef", "abcdefg": "xbcdef", "abcdef": "xbcdef", "xbcdef": "xbcdef",
        "qqqqqqa": "qqqqqqa", "qqqqqqb": "qqqqqqb", "qqqqqqc": "qqqqqqa"}
    assert got["qqqqqqc"][1:] == ("qqqqqqa", "qqqqqqa", 5, 2, 30)


def test_odd_rows(spark, odd_docs, no_docs):
    twice = odd_docs.union(odd_docs).union(odd_docs)
    assert ours(twice) == brute(pairs(twice))
    assert ours(no_docs) == []
    none = spark.createDataFrame([(1, None, "word", 1), (None, "", "near", 2)], "doc_id long, text string, word string, n int")
    assert ours(none) == []


def test_index_against_every_pair():
    rng = random.Random(1)
    for _ in range(40):
        words = sorted({"".join(rng.choice("abéÿ") for _ in range(rng.randint(1, 7))) for _ in range(rng.randint(2, 200))})
        a, b = variants.near_words(words, 17)
        got = {(words[i], words[j]) for i, j in zip(a.tolist(), b.tolist(), strict=True)}
        assert len(got) == len(a)
        assert got == {(x, y) for x in words for y in words if one_apart(x, y)}


def test_lost_letters_follow_the_crc():
    """The combined crc32 equals that of the whole string."""
    import numpy as np
    rng = random.Random(2)
    for _ in range(200):
        head, word = f"{rng.randint(0, 10 ** 9)}:".encode(), rng.randbytes(rng.randint(0, 50))
        shift = variants._continued(np.array([zlib.crc32(head)]), np.array([len(word)]))[0]
        assert shift ^ zlib.crc32(word) == zlib.crc32(head + word)
