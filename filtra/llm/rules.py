"""Quality rules with adaptive thresholds (operator 8; DataFrame functions only).

Each document gets counts of words, symbols, repeated lines and repeated
8-word windows. Per language and source a mergeable quantile sketch of every
rate is kept: a log-linear histogram (counts per bucket, five significant
bits) that merges by adding counts, so partial sketches of tasks, sources and
languages combine freely and always give the same thresholds. A group's fence
is found in its sketch alone, there is no fixed cutoff: where the buckets fall into
two well separated classes, it lies in the gap between them; else beyond the
quartiles by SPREAD times their distance; and where the quartiles are equal too,
nothing is beyond it. A document is rejected when a rate lies beyond its group's
fence, or by the fixed base rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filtra.llm.common import WORD, cut, join_small, settled, table

SPREAD = 3  # distances between the quartiles
SEPARATION = 0.8  # share of the buckets' variance that two classes must explain
# Events that a rate leaves out: one repeated line, one window that occurs twice. A single
# one is no rate, and in a short text it would be a large one.
EVENTS = {"symbol_rate": 0, "dup_line_rate": 1, "repeat_rate": 16, "upper_rate": 0}
# A group's sketch is merged with its language's, which weighs as many rows.
PRIOR_ROWS = 200
COUNTS = ["_n_words", "_word_chars", "_n_symbols", "_n_upper", "_n_lines", "_n_dup_lines", "_n_repeat_words"]
BITS = 6  # buckets keep this many leading binary digits


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def _drop(arr: Column, n: int) -> Column:
    """The array without its first n elements."""
    return F.slice(arr, n + 1, F.size(arr))


def _pair_hash(a: Column, b: Column) -> Column:
    return F.xxhash64(a, b)


def document_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add _n_words, _word_chars, _n_symbols, _n_dup_lines, _n_repeat_words,
    _n_lines and _n_upper to every row (null text: no words).

    Everything is computed inside the row. Windows of eight words are hashed by
    doubling (pairs, fours, eights); only texts with an equal window are sorted.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.withColumn("_w", _words(text))
    df = df.withColumn("_h1", F.transform("_w", lambda w: F.xxhash64(w)))
    n = F.size("_h1")
    df = df.withColumn("_h2", F.zip_with("_h1", _drop(F.col("_h1"), 1), _pair_hash))
    df = df.withColumn("_h4", F.zip_with("_h2", _drop(F.col("_h2"), 2), _pair_hash))
    df = df.withColumn("_h8", F.slice(F.zip_with("_h4", _drop(F.col("_h4"), 4), _pair_hash),
                                      F.lit(1), F.greatest(n - 7, F.lit(0))))
    # sorted (hash, position) of texts in which some window recurs, else null
    df = df.withColumn("_s", F.when(
        F.size(F.array_distinct("_h8")) < F.size("_h8"),
        F.sort_array(F.transform("_h8", lambda h, i: F.struct(h.alias("h"), i.alias("p"))))))
    m = F.size("_s")
    df = df.withColumn("_eq", F.when(F.col("_s").isNotNull(), F.zip_with(
        F.slice("_s", F.lit(1), m - 1), F.slice("_s", F.lit(2), m - 1),
        lambda a, b: a["h"] == b["h"])))
    before = F.concat(F.array(F.lit(False)), F.col("_eq"))
    after = F.concat(F.col("_eq"), F.array(F.lit(False)))
    twice = F.zip_with(before, after, lambda a, b: a | b)
    df = df.withColumn("_st", F.when(F.col("_eq").isNotNull(), F.sort_array(F.filter(
        F.zip_with("_s", twice, lambda s, f: F.when(f, s["p"])), lambda p: p.isNotNull()))))
    k = F.size("_st")
    covered = F.aggregate(
        F.zip_with(F.slice("_st", F.lit(1), k - 1), F.slice("_st", F.lit(2), k - 1),
                   lambda a, b: F.least(F.lit(8), b - a)),
        F.lit(0).cast("long"), lambda acc, x: acc + x) + 8
    df = df.withColumn("_lines", F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    return (df
            .withColumn("_n_words", F.size("_w").cast("long"))
            .withColumn("_word_chars", F.length(F.array_join("_w", "")).cast("long"))
            .withColumn("_n_symbols", (F.length(text) - F.length(
                F.regexp_replace(text, r"[#*$%&|<>]+", ""))).cast("long"))
            .withColumn("_n_upper", (F.length(text) - F.length(
                F.regexp_replace(text, r"\p{Lu}+", ""))).cast("long"))
            .withColumn("_n_lines", F.size("_lines").cast("long"))
            .withColumn("_n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
            .withColumn("_n_repeat_words", F.coalesce(F.when(F.col("_st").isNotNull(), covered),
                                                      F.lit(0)).cast("long"))
            .drop("_w", "_h1", "_h2", "_h4", "_h8", "_s", "_eq", "_st", "_lines"))


def rates() -> dict[str, Column]:
    """The sketched rates, whole thousandths."""
    parts = {"symbol_rate": ("_n_symbols", "_n_words"), "dup_line_rate": ("_n_dup_lines", "_n_lines"),
             "repeat_rate": ("_n_repeat_words", "_n_words"), "upper_rate": ("_n_upper", "_word_chars")}
    return {k: F.floor(F.greatest(F.col(n) - EVENTS[k], F.lit(0)) * 1000 / F.greatest(F.col(d), F.lit(1))).cast("long")
            for k, (n, d) in parts.items()}


def bucket(v: Column) -> Column:
    """Sketch bucket of a whole number >= 0: values below 2**BITS exactly, larger
    ones by their BITS leading binary digits (relative error below 2**(1 - BITS))."""
    shift = F.greatest(F.length(F.bin(v)) - BITS, F.lit(0))
    half = 1 << (BITS - 1)
    return shift.cast("long") * half + F.expr("_v div cast(power(2, greatest(length(bin(_v)) - "
                                              f"{BITS}, 0)) as bigint)")


def bucket_low(b: Column) -> Column:
    """Smallest value of a bucket."""
    half = 1 << (BITS - 1)
    shift = F.greatest(F.floor(b / half) - 1, F.lit(0))
    return ((b - shift * half) * F.pow(F.lit(2), shift)).cast("long")


def sketches(counted: DataFrame) -> DataFrame:
    """lang, source, rate, b, n: one sketch per group and rate."""
    long = counted.select("lang", "source", F.explode(F.array(*[
        F.struct(F.lit(name).alias("rate"), v.alias("v")) for name, v in rates().items()])).alias("_x"))
    return (long.select("lang", "source", F.col("_x.rate").alias("rate"), F.col("_x.v").alias("_v"))
            .withColumn("b", bucket(F.col("_v")))
            .groupBy("lang", "source", "rate", "b").agg(F.count(F.lit(1)).alias("n")))


def blended(sk: DataFrame) -> DataFrame:
    """lang, source, rate, b, n: every group's sketch with its language's merged in, which counts
    as PRIOR_ROWS rows (n in thousandths of a row)."""
    lang = sk.groupBy("lang", "rate", "b").agg(F.sum("n").alias("n"))
    total = lang.groupBy("lang", "rate").agg(F.sum("n").alias("t"))
    lang = join_small(lang, total, ["lang", "rate"]).select(
        "lang", "rate", "b", F.expr(f"(n * {PRIOR_ROWS * 1000}) div t").alias("n"))
    groups = sk.select("lang", "source", "rate").distinct()
    prior = join_small(lang, groups, ["lang", "rate"]).select("lang", "source", "rate", "b", "n")
    both = sk.select("lang", "source", "rate", "b", (F.col("n") * 1000).alias("n")).union(prior)
    return both.groupBy("lang", "source", "rate", "b").agg(F.sum("n").alias("n")).filter("n > 0")


def thresholds(sk: DataFrame) -> DataFrame:
    """lang, source and one fence per rate (null: none).

    The two classes of a sketch are the split with the largest variance between them (the
    higher of equal ones); the buckets are a near-logarithmic scale.
    """
    group = ["lang", "source", "rate"]
    w, upto = Window.partitionBy(*group), Window.partitionBy(*group).orderBy("b")
    cum = blended(sk).select(
        *group, "b", F.lead("b").over(upto).alias("up"),
        F.sum("n").over(upto).alias("n0"), F.sum(F.col("n") * F.col("b")).over(upto).alias("s0"),
        F.sum("n").over(w).alias("n"), F.sum(F.col("n") * F.col("b")).over(w).alias("s"),
        F.sum(F.col("n") * F.col("b") * F.col("b")).over(w).alias("q"))

    def num(c: str) -> Column:
        return F.expr(f"cast({c} as double)")

    apart = num("n0") * num("s - s0") - num("n - n0") * num("s0")
    between = F.when(F.col("up").isNotNull(), apart * apart / (num("n0") * num("n - n0")) / num("n"))
    spread = num("q") - num("s") * num("s") / num("n")
    quartile = {p: F.min(F.when(F.col("n0") * 100 >= F.col("n") * p, F.col("b"))) for p in (25, 75)}
    best = cum.withColumn("between", between).withColumn("spread", spread).groupBy(*group).agg(
        F.max(F.struct("between", "b", "up", "spread")).alias("x"),
        *[bucket_low(c).alias(f"q{p}") for p, c in quartile.items()])
    split = F.floor((bucket_low(F.col("x.b")) + bucket_low(F.col("x.up"))) / 2)
    fence = (F.when(F.col("x.between").isNotNull() & (F.col("x.between") >= F.lit(SEPARATION) * F.col("x.spread")), split)
             .when(F.col("q75") > F.col("q25"), F.col("q75") + SPREAD * (F.col("q75") - F.col("q25"))))
    return best.withColumn("f", fence).groupBy("lang", "source").agg(
        *[F.max(F.when(F.col("rate") == k, F.col("f"))).alias(f"_f_{k}") for k in EVENTS])


def judge(counted: DataFrame, fences: DataFrame) -> DataFrame:
    """Add _base_failed and _kept by the joined filter rule."""
    joined = join_small(counted, fences, ["lang", "source"], "left")
    base = (F.col("_n_words") < 20) | (100 * F.col("_n_repeat_words") > 30 * F.col("_n_words"))
    within = F.lit(True)
    for name, v in rates().items():
        within = within & F.coalesce(v <= F.col(f"_f_{name}"), F.lit(True))
    return (joined.withColumn("_base_failed", base).withColumn("_kept", ~base & within)
            .drop(*[f"_f_{k}" for k in EVENTS]))


def quality_rules(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the counts, base_failed and kept, one row per row of ``docs``.

    Null and empty texts have no words and fail the base rule. Null languages and
    sources form groups of their own; ties at a fence are kept; repeated rows count
    as often as they occur; an empty table gives no rows. Only doc_id, text, lang
    and source are read.
    """
    counted = cut(document_counts(docs.select("doc_id", "text", "lang", "source")).drop("text"))
    out = judge(counted, thresholds(sketches(counted)))
    return out.select("doc_id", "lang", "source", *[F.col(f"_{c}").alias(c) for c in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper",
        "base_failed", "kept")])


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns.

    Texts are scanned twice (for the sketches, then for the verdicts) rather than
    stored or shuffled."""
    cols = docs.columns
    packed = docs.select(F.struct(*cols).alias("_row"), "text", "lang", "source")
    fences = cut(thresholds(sketches(document_counts(packed.select("text", "lang", "source")).drop("text"))))
    counted = settled(document_counts(packed), COUNTS)
    return judge(counted, fences).filter("_kept").select("_row.*")


def op8(spark, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept")


_RATES_SQL = """
    SELECT 'symbol_rate' AS rate, n_symbols AS x, n_words AS y UNION ALL
    SELECT 'dup_line_rate', greatest(n_dup_lines - 1, 0), n_lines UNION ALL
    SELECT 'repeat_rate', greatest(n_repeat_words - 16, 0), n_words UNION ALL
    SELECT 'upper_rate', n_upper, word_chars
"""

def _low(b: str) -> str:
    shift = f"greatest({b} // 32 - 1, 0)"
    return f"(({b} - {shift} * 32) << {shift})"


ORACLE = f"""
WITH d AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)),
                     lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls
  FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
rep AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
cover AS (
  SELECT doc_id, sum(least(8, coalesce(nxt - i, 8))) AS n_repeat_words
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM rep) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, lang, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]+', '', 'g')) AS n_symbols,
         length(t) - length(regexp_replace(t, '\\p{{Lu}}+', '', 'g')) AS n_upper,
         len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM d LEFT JOIN cover USING (doc_id)),
r AS (
  SELECT doc_id, lang, source, rate, (x * 1000 // greatest(y, 1))::BIGINT AS v
  FROM m, LATERAL ({_RATES_SQL})),
sk AS (
  SELECT lang, source, rate, count(*) AS n,
         greatest(length(bin(v)) - 6, 0) * 32 + (v >> greatest(length(bin(v)) - 6, 0)) AS b
  FROM r GROUP BY lang, source, rate, b),
lb AS (SELECT lang, rate, b, sum(n) AS n FROM sk GROUP BY lang, rate, b),
lp AS (SELECT lang, rate, b, n * 200000 // sum(n) OVER (PARTITION BY lang, rate) AS n FROM lb),
bl AS (
  SELECT lang, source, rate, b, sum(n)::BIGINT AS n FROM (
    SELECT lang, source, rate, b, n * 1000 AS n FROM sk UNION ALL
    SELECT g.lang, g.source, g.rate, lp.b, lp.n FROM (SELECT DISTINCT lang, source, rate FROM sk) g
    JOIN lp ON g.lang IS NOT DISTINCT FROM lp.lang AND g.rate = lp.rate)
  GROUP BY lang, source, rate, b HAVING sum(n) > 0),
cum AS (
  SELECT *, lead(b) OVER o AS up, sum(n) OVER o AS n0, sum(n * b) OVER o AS s0,
         sum(n) OVER g AS nn, sum(n * b) OVER g AS s, sum(n * b * b) OVER g AS q
  FROM bl WINDOW g AS (PARTITION BY lang, source, rate), o AS (PARTITION BY lang, source, rate ORDER BY b)),
sc AS (
  SELECT *, CASE WHEN up IS NOT NULL THEN apart * apart / (n0::DOUBLE * (nn - n0)::DOUBLE) / nn::DOUBLE END AS between_,
         q::DOUBLE - s::DOUBLE * s::DOUBLE / nn::DOUBLE AS spread_
  FROM (SELECT *, n0::DOUBLE * (s - s0)::DOUBLE - (nn - n0)::DOUBLE * s0::DOUBLE AS apart FROM cum)),
best AS (
  SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY lang, source, rate
    ORDER BY between_ DESC NULLS LAST, b DESC) = 1),
qt AS (
  SELECT lang, source, rate, min(CASE WHEN n0 * 100 >= nn * 25 THEN b END) AS b25,
         min(CASE WHEN n0 * 100 >= nn * 75 THEN b END) AS b75 FROM cum GROUP BY lang, source, rate),
low AS (
  SELECT best.lang, best.source, best.rate, between_, spread_, {_low('best.b')} AS lo, {_low('up')} AS hi,
         {_low('b25')} AS q25, {_low('b75')} AS q75
  FROM best JOIN qt ON best.lang IS NOT DISTINCT FROM qt.lang AND best.source IS NOT DISTINCT FROM qt.source
    AND best.rate = qt.rate),
f AS (
  SELECT lang, source, rate, CASE WHEN between_ IS NOT NULL AND between_ >= 0.8::DOUBLE * spread_ THEN (lo + hi) // 2
    WHEN q75 > q25 THEN q75 + 3 * (q75 - q25) END AS fence FROM low),
bad AS (
  SELECT DISTINCT doc_id FROM r JOIN f ON r.lang IS NOT DISTINCT FROM f.lang
    AND r.source IS NOT DISTINCT FROM f.source AND r.rate = f.rate WHERE v > fence)
SELECT m.doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars,
       n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words,
       (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND bad.doc_id IS NULL AS kept
FROM m LEFT JOIN bad ON m.doc_id = bad.doc_id
"""
