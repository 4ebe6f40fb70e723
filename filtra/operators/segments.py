"""A text index maintained by appending segments.

A segment is what one batch of documents adds: its postings (token, id, tf, dl; stored as one
row per document and token bucket), its document frequencies and its totals. Segments are never rewritten; N, the
average length and a token's document frequency are sums over the segments, and
BM25 weights are derived from them when postings are read. An index of any
number of segments gives the weights of one built from all documents at once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filtra.config import BM25_B, BM25_K1
from filtra.operators.sparse import persist_index, tokens_expr

TOKEN_BUCKETS = 16  # folders of a segment; a task that appends writes at most a file to each
MAX_RECORDS_PER_FILE = 5_000_000
BROADCAST_TERMS = 200_000  # terms up to which they are broadcast: of queries, or the most frequent ones of the index


def _bound(df: DataFrame, name: str, value) -> DataFrame:
    """``df`` with the column ``name``, its value fixed by a generator of one row: an expression that
    is only named would be written out, and evaluated again, for every element that looks at it."""
    return df.select("*", F.explode(F.array(F.struct(value.alias("v")))).alias("_x")).withColumn(
        name, F.col("_x.v")).drop("_x")


def _runs(docs: DataFrame, text_col: str, keep: Sequence[str]) -> DataFrame:
    """*keep, dl, _runs: the (token, tf) pairs of each row that has tokens, counted inside the row.

    The sorted token array is cut where the token changes.
    """
    tokens = _bound(docs.select(*keep, F.col(text_col).alias("_text")), "_s",
                    F.sort_array(tokens_expr("_text"))).drop("_text")
    starts = _bound(tokens.filter(F.size("_s") > 0), "_at", F.expr(
        "filter(sequence(1, size(_s)), i -> i = 1 or _s[i - 1] <> _s[i - 2])"))
    return starts.select(*keep, F.size("_s").cast("long").alias("dl"), F.expr(
        "transform(_at, (i, j) -> struct(_s[i - 1] as token, cast(coalesce(get(_at, j + 1), size(_s) + 1) - i as long) as tf))")
        .alias("_runs"))


def token_counts(docs: DataFrame, text_col: str = "content", keep: Sequence[str] = ("id",)) -> DataFrame:
    """*keep, dl, token, tf: one row per distinct token of each row; no row leaves its task.

    Rows without a token give none.
    """
    return (_runs(docs, text_col, keep).select(*keep, "dl", F.explode("_runs").alias("_r"))
            .select(*keep, "dl", "_r.token", "_r.tf"))


def token_blocks(docs: DataFrame, text_col: str = "content", keep: Sequence[str] = ("id",)) -> DataFrame:
    """*keep, dl, tokens, tfs, tb: the rows of :func:`token_counts`, those of a row's token bucket as
    two arrays."""
    dealt = _bound(_runs(docs, text_col, keep), "_b", F.expr(
        f"transform(_runs, r -> struct(cast(pmod(xxhash64(r.token), {TOKEN_BUCKETS}) as int) as tb, r.token, r.tf))"))
    blocks = dealt.select(*keep, "dl", F.explode(F.expr(
        f"transform(sequence(0, {TOKEN_BUCKETS - 1}), b -> struct(b as tb, filter(_b, r -> r.tb = b) as posts))")).alias("_p"))
    return blocks.filter(F.size("_p.posts") > 0).select(
        *keep, "dl", F.col("_p.posts.token").alias("tokens"),
        F.col("_p.posts.tf").cast("array<int>").alias("tfs"), F.col("_p.tb").alias("tb"))


def _bucket(col: str = "token"):
    return F.pmod(F.xxhash64(col), F.lit(TOKEN_BUCKETS)).cast("int")


def _postings(blocks: DataFrame) -> DataFrame:
    """The stored blocks as one row per posting."""
    rest = [c for c in blocks.columns if c not in ("tokens", "tfs", "tb")]
    return (blocks.select(*rest, F.explode(F.arrays_zip("tokens", "tfs")).alias("_r"), "tb")
            .select(*rest, F.col("_r.tokens").alias("token"), F.col("_r.tfs").cast("long").alias("tf"), "tb"))


class TextIndex:
    """Segments under a folder of the shared storage."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def append(self, docs: DataFrame, segment: str, text_col: str = "content",
               keep: Sequence[str] = ()) -> None:
        """Add the documents (``id``, text and the columns ``keep``) as one segment.

        A segment that is written again replaces itself, so a batch that failed half-way can
        be repeated. Ids must not occur in other segments.
        """
        folder = f"{self.path}/{{}}/seg={segment}"
        blocks = token_blocks(docs, text_col, ["id", *keep])
        # every task writes its own documents' blocks, so no posting is shuffled and what is sorted
        # for the bucket folders is a row for each document and bucket
        (blocks.sortWithinPartitions("tb").write.mode("overwrite").option("maxRecordsPerFile", MAX_RECORDS_PER_FILE)
         .partitionBy("tb").parquet(folder.format("postings")))
        own = _postings(self.spark.read.schema(blocks.schema).parquet(folder.format("postings")))  # perhaps without a file
        (own.groupBy("tb", "token").agg(F.count(F.lit(1)).alias("df"))
         .hint("rebalance", "tb").sortWithinPartitions("tb", "token")
         .write.mode("overwrite").partitionBy("tb").parquet(folder.format("terms")))
        (own.agg(F.coalesce(F.sum("tf"), F.lit(0)).cast("long").alias("tokens"))
         .withColumn("docs", F.lit(docs.count())).coalesce(1)
         .write.mode("overwrite").parquet(folder.format("totals")))

    def _read(self, part: str) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.path}/{part}").parquet(f"{self.path}/{part}/seg=*")

    def totals(self) -> tuple[int, float]:
        """Number of documents and their mean length."""
        r = self._read("totals").agg(F.sum("docs").alias("n"), F.sum("tokens").alias("t")).first()
        n = int(r["n"] or 0)
        return n, (float(r["t"] or 0) / n if n else 0.0)

    def weigh(self, counts: DataFrame, k1: float = BM25_K1, b: float = BM25_B,
              df: DataFrame | None = None) -> DataFrame:
        """``counts`` (token, tf, dl, ...) with their BM25 ``weight``; tokens of no segment drop out.

        ``df``: token and document frequency of the tokens of ``counts``, where the caller has them.

        weight = idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl)),
        idf = ln(1 + (N - df + 0.5) / (df + 0.5)).
        """
        n, avgdl = self.totals()
        if df is None:
            df = self._read("terms").groupBy("token").agg(F.sum("df").alias("df"))
        idf = F.log(F.lit(1.0) + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        norm = F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * F.col("dl") / F.lit(avgdl if avgdl else 1.0))
        return (counts.join(df, "token")
                .withColumn("weight", idf * F.col("tf") * F.lit(k1 + 1.0) / (F.col("tf") + norm)).drop("df"))

    def postings(self) -> DataFrame:
        """id, kept columns, token, tf, dl, tb of all segments."""
        return _postings(self._read("postings").drop("seg"))

    def weights(self) -> DataFrame:
        """Id, token, tf, weight of every posting.

        The frequencies of the most frequent tokens, which most postings are of, are brought to
        them; only postings of the others move to meet theirs.
        """
        freqs = persist_index(self._read("terms").groupBy("token").agg(F.sum("df").alias("df")))
        step = F.floor(F.log2(F.col("df").cast("double")) * 16).cast("long")
        known, least = 0, None
        # some hundred steps, the tokens of the highest frequencies first
        for r in sorted(freqs.groupBy(step.alias("b")).count().collect(), key=lambda r: -r["b"]):
            known += r["count"]
            if known > BROADCAST_TERMS:
                break
            least = r["b"]
        often = freqs.filter(F.lit(False) if least is None else step >= least)
        rest = freqs.filter(F.lit(True) if least is None else step < least)
        posts = self.postings()
        found = self.weigh(posts, df=F.broadcast(often)).unionByName(
            self.weigh(posts.join(F.broadcast(often.select("token")), "token", "left_anti"), df=rest))
        return found.select("id", "token", "tf", "weight")

    def query_terms(self, docs: DataFrame, text_col: str = "content", keep: Sequence[str] = ("qid",)) -> DataFrame:
        """*keep, token, qweight: texts as queries, weighted like documents of the index."""
        return self.weigh(token_counts(docs, text_col, keep)).select(*keep, "token", F.col("weight").alias("qweight"))

    def scores(self, terms: DataFrame, same: Sequence[str] = (), scale: int = 6) -> DataFrame:
        """qid, id, score: inner products of the queries' terms with the documents' weights.

        ``same`` names kept columns that must be equal to the query's own (null: any value); they
        are applied inside the join. Only the token buckets of the queries are read.
        """
        terms = persist_index(terms.withColumn("tb", _bucket()))
        used = sorted(r["tb"] for r in terms.select("tb").distinct().collect())  # at most TOKEN_BUCKETS
        # few terms are brought to the postings; postings move only to meet many
        near = F.broadcast if terms.count() <= BROADCAST_TERMS else (lambda df: df)
        asked = near(terms.select("tb", "token").distinct())
        # document frequencies and weights of the asked tokens only
        posts, freqs = (df.filter(F.col("tb").isin(used)).join(asked, ["tb", "token"], "left_semi")
                        for df in (self.postings(), self._read("terms")))
        df = near(freqs.groupBy("token").agg(F.sum("df").alias("df")))
        found, terms = self.weigh(posts, df=df), near(terms)
        cond = (F.col("p.tb") == F.col("t.tb")) & (F.col("p.token") == F.col("t.token"))
        for c in same:
            cond = cond & (F.col(f"t.{c}").isNull() | (F.col(f"p.{c}") == F.col(f"t.{c}")))
        return (found.alias("p").join(terms.alias("t"), cond)
                .groupBy("t.qid", "p.id").agg(F.round(F.sum(F.col("weight") * F.col("qweight")), scale).alias("score")))
