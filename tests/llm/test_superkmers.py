"""Repeated windows against brute force."""

import hashlib
import random

import numpy as np
import pytest

from filtra.llm import scan, superkmers
from made_texts import prose
from test_documents_ops import words

SF = "/root/testdata/sf0.001"


def brute(rows, passage):
    """(doc_id, n_words, n_removed, sha256 of the kept words) of every (doc_id, text)."""
    seen = {}
    for _, text in rows:
        w = words(text)
        for i in range(len(w) - passage + 1):
            key = tuple(w[i:i + passage])
            seen[key] = seen.get(key, 0) + 1
    out = []
    for doc_id, text in rows:
        w = words(text)
        gone = set()
        for i in range(len(w) - passage + 1):
            if seen[tuple(w[i:i + passage])] > 1:
                gone.update(range(i, i + passage))
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((doc_id, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def ours(df, **how):
    got = superkmers.strip(df, **how).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    return sorted((tuple(r) for r in got), key=repr)


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize("crowd", [superkmers.CROWD, 0])
def test_odd_rows(odd_docs, crowd):
    """``crowd=0`` counts every window as a row of its own; both ways give the same rows."""
    assert ours(odd_docs, crowd=crowd) == brute(pairs(odd_docs), 35)


def test_given_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert ours(docs) == brute(pairs(docs), 35)


def test_empty_table(no_docs):
    df = superkmers.strip(no_docs)
    assert df.columns == ["doc_id", "n_words", "n_removed", "kept", "kept_sha256"]
    assert df.collect() == []


def test_periodic_and_short_alphabet(spark):
    """Texts of very few words: nearly every window has tied minima."""
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 60)))) for i in range(60)]
    rows += [(100, "a " * 500), (101, "a b " * 40), (102, "\n".join(["x y z"] * 30)), (103, "a " * 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for crowd in (superkmers.CROWD, 3):
        assert ours(df, passage=12, gram=3, crowd=crowd) == brute(rows, 12)


def test_passage_inside_one_text_and_across(spark):
    """A passage a thousand times in one text and once in another, and a third of all rows copies."""
    shared = prose(1, 40)
    rows = [(0, " ".join(f"{prose(10 + i, 3)} {shared}" for i in range(300))), (1, prose(2, 30) + " " + shared)]
    rows += [(10 + i, prose(5, 120)) for i in range(150)]
    rows += [(1000 + i, prose(2000 + i, 90)) for i in range(300)]
    rows += [(5000 + i, f"{prose(7000 + i, 20)} {shared} {prose(8000 + i, 20)}") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, 35)
    assert ours(df) == want
    assert ours(df, crowd=50) == want


def test_kept_text_and_clashing_columns(spark):
    a = prose(1, 50)
    rows = [(1, f"first words {a} last", "x", 7, 1), (2, f"{a}\nother  end", "y", 8, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, packed string, h long, runs long")
    got = {r["doc_id"]: r["kept"] for r in superkmers.strip(df).collect()}
    assert got == {1: "first words last", 2: "other end"}


def test_words_and_grams_of_a_buffer():
    rng = random.Random(5)
    for _ in range(300):
        texts = ["".join(rng.choice("ab é\n\t日") for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(0, 6))]
        import pyarrow as pa
        for lo, hi, data, off in scan.chunks(pa.array(texts, pa.string()), 20):
            w = superkmers.Words(data, off)
            got = [data[a:b].tobytes().decode() for a, b in zip(w.starts, w.ends, strict=True)]
            assert got == [x for t in texts[lo:hi] for x in words(t)]
            assert w.count.tolist() == [len(words(t)) for t in texts[lo:hi]]
            h = w.hashes()
            assert len(set(h.tolist())) == len(set(got))
            for width in (1, 2, 3, 5, 7):
                grams = scan.gram_hashes(h, width).tolist()
                same = [tuple(got[i:i + width]) for i in range(len(got) - width + 1)]
                assert len(grams) == len(same) and len(set(grams)) == len(set(same))
                assert scan.slide_min(h, width).tolist() == [min(h[i:i + width].tolist()) for i in range(len(same))]


def test_equal_hashes_are_told_apart(monkeypatch):
    """All words hash alike: the sort by the words themselves decides."""
    monkeypatch.setattr(superkmers, "word_hashes", lambda data, s, e: np.zeros(len(s), dtype=np.uint64))
    mask = superkmers._repeated(np.zeros(3, np.int64), [b"a b c d", b"b c x y", b"q b c d"], np.ones(3, np.int64), 3)
    assert mask.tolist() == [2, 0, 2]
