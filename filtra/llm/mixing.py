"""Mixing sources to target weights by soft membership (operator 2; DataFrame functions only).

A naive Bayes classifier learned from a labelled table gives every document a
posterior over domains. Nonnegative sampling rates per document are then
fitted by distributed projected-gradient least squares, so that the expected
token total of every domain, sum of tokens * rate * posterior, meets its target.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filtra.llm.common import cut, settled, table

# Target shares of the registered query and of the labelled domains below.
TARGETS = {"clean": 0.80, "low": 0.15, "toxic": 0.05}
SAMPLE_ROWS = 12_000  # labelled rows that train the classifier, at most
BUCKETS = 1 << 14  # hashed word features
SMOOTH = 20.0  # documents' worth of the overall share mixed into a domain's
SURE = 4.0  # standard deviations from chance that a feature's share must lie
TEMPERATURES = (0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.5, 0.7, 1.0)
TOLERANCE = 1e-7  # largest gap to a target, as a share of all tokens
RIDGE = 1e-3  # of the mean cross product, added to keep near-equal domains apart
MAX_STEPS = 200
STILL = 1e-6  # movement of the rates, as a share of all tokens, below which the fit has ended
PATIENCE = 20  # steps without progress after which targets count as out of reach
FIRM = 1e6  # weight of the gaps against the pull towards rates of 1 in the dual fit
MAX_HALVINGS = 16  # of a step of the dual fit, each to a quarter
NEAR = 2e-4  # of the squares of the gaps at the start, above the best found: near enough
CUT_EVERY = 8  # steps folded into one expression before rates are stored
SEED = 3


def label_domains(labels: DataFrame) -> DataFrame:
    """doc_id, domain of the rows with both labels: toxic, else low quality, else clean."""
    return labels.filter("quality in (0, 1) and toxic in (0, 1) and doc_id is not null").select(
        "doc_id", F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low")
        .otherwise("clean").alias("domain"))


def _words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _hashed(words: Column) -> Column:
    return F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int"))


def with_features(df: DataFrame, text: str = "text") -> DataFrame:
    """Add _n_tokens and _f, the distinct hashed features of a text: its words, its runs of
    signs, whether it shouts, and how varied it is for its length."""
    df = df.withColumn("_words", _words(F.col(text)))
    df = df.withColumn("_n_tokens", F.size("_words").cast("long")).withColumn("_types", F.array_distinct("_words"))
    whole = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumn("_signs", F.array_distinct(F.concat(
        F.regexp_extract_all(whole, F.lit(r"[^\p{L}\s]{2,}"), F.lit(0)),
        F.when(whole.rlike(r"\p{Lu}{3}"), F.array(F.lit("\u0001"))).otherwise(F.array().cast("array<string>")))))
    variety = F.array(F.pmod(F.xxhash64(F.lit("variety"), F.floor(F.size("_types") * 10 / F.greatest(F.size("_words"), F.lit(1))),
                                        F.length(F.bin(F.size("_words")))), F.lit(BUCKETS)).cast("int"))
    return (df.withColumn("_f", F.array_distinct(F.concat(_hashed(F.col("_types")), _hashed(F.col("_signs")), variety)))
            .drop("_words", "_types", "_signs"))


def _constant(values) -> Column:
    """A literal array: one short string, folded once when the query is planned."""
    return F.split(F.lit(",".join(f"{float(v):.9g}" for v in values)), ",").cast("array<double>")


def _sum_of(feats: str, per_feature: Column) -> Column:
    return F.aggregate(feats, F.lit(0.0), lambda acc, b: acc + per_feature[b])


class Posterior:
    """Log weights per domain and feature, priors, and a temperature per domain."""

    def __init__(self, domains: list[str], weights: np.ndarray, prior: np.ndarray, temperature: list[float]):
        self.domains, self.weights, self.prior, self.temperature = domains, weights, prior, temperature

    def scores(self, feats: str) -> list[Column]:
        """Log likelihood ratio of every domain against the first."""
        out = [F.lit(0.0)]
        for w in (self.weights[1:] - self.weights[0]):
            out.append(_sum_of(feats, _constant(w)))
        return out

    def add(self, df: DataFrame, text: str = "text") -> DataFrame:
        """Add _n_tokens and _p_<i> per domain."""
        df = with_features(df, text)
        k = len(self.domains)
        df = df.withColumns({f"_s_{i}": s for i, s in enumerate(self.scores("_f"))}).drop("_f")
        return softmax(df, k, self.prior, self.temperature)


def softmax(df: DataFrame, k: int, prior: np.ndarray, temperature: list[float]) -> DataFrame:
    """_p_<i> from the likelihood scores _s_<i>."""
    z = [F.col(f"_s_{i}") * float(temperature[i]) + float(prior[i]) for i in range(k)]
    df = df.withColumns({f"_z_{i}": c for i, c in enumerate(z)})
    top = F.greatest(*[F.col(f"_z_{i}") for i in range(k)]) if k > 1 else F.col("_z_0")
    df = df.withColumns({f"_e_{i}": F.exp(F.col(f"_z_{i}") - top) for i in range(k)})
    total = sum((F.col(f"_e_{i}") for i in range(1, k)), F.col("_e_0"))
    return (df.withColumns({f"_p_{i}": F.col(f"_e_{i}") / total for i in range(k)})
            .drop(*[f"_{c}_{i}" for c in "sze" for i in range(k)]))


def learn(docs: DataFrame, labelled: DataFrame, domains: list[str], sample: int = SAMPLE_ROWS) -> Posterior:
    """Naive Bayes over distinct hashed words, from at most ``sample`` labelled rows.

    Three quarters give the word counts, one quarter the temperatures with the least
    log loss. Several labels of one id count as the last in order of name. Without
    labelled rows all posteriors are equal.
    """
    k = len(domains)
    picked = (labelled.filter(F.col("domain").isin(domains)).groupBy("doc_id").agg(F.max("domain").alias("_domain"))
              .orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(sample)
              .select(F.col("doc_id").alias("_id"), "_domain"))
    # at most ``sample`` rows are broadcast
    rows = (docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("_id"))
            .select("_id", "_domain", "text"))
    rows = with_features(rows).drop("text", "_n_tokens")
    rows = cut(rows.withColumn("_held", F.pmod(F.xxhash64("_id", F.lit(SEED + 1)), F.lit(4)) == 0))
    # at most domains * BUCKETS rows
    got = (rows.filter(~F.col("_held")).select("_domain", F.explode("_f").alias("b"))
           .groupBy("_domain", "b").agg(F.count(F.lit(1)).alias("n")).collect())
    sizes = {r["_domain"]: r["n"] for r in rows.filter(~F.col("_held")).groupBy("_domain")
             .agg(F.count(F.lit(1)).alias("n")).collect()}
    count = np.zeros((k, BUCKETS))
    for r in got:
        count[domains.index(r["_domain"]), r["b"]] = r["n"]
    if not sizes:
        return Posterior(domains, np.zeros((k, BUCKETS)), np.zeros(k), [1.0] * k)
    n = np.array([sizes.get(d, 0) for d in domains], dtype=float)
    # share of a domain's documents that hold the feature, drawn towards its share in all
    overall = (count.sum(axis=0) + 0.5) / (n.sum() + 1)
    weights = np.log((count + SMOOTH * overall) / (n[:, None] + SMOOTH))
    # features whose share in a domain could be chance say nothing about it
    z = (count - n[:, None] * overall) / np.sqrt(n[:, None] * overall * (1 - np.minimum(overall, 0.999)) + 1e-9)
    weights = np.where(np.abs(z) >= SURE, weights, np.log(overall))
    prior = np.log((n + 0.5) / (n.sum() + 0.5 * k))
    model = Posterior(domains, weights, prior, [0.3] * k)
    scored = cut(rows.filter("_held").withColumns({f"_s_{i}": s for i, s in enumerate(model.scores("_f"))}).drop("_f"))
    which = F.coalesce(*[F.when(F.col("_domain") == d, F.lit(i)) for i, d in enumerate(domains)])
    for _ in range(2):  # one domain's temperature after the other, twice
        for j in range(1, k):
            tried = [[*model.temperature[:j], t, *model.temperature[j + 1:]] for t in TEMPERATURES]
            found = scored.agg(*[_log_loss(which, prior, t).alias(f"l{i}") for i, t in enumerate(tried)]).first()
            if found["l0"] is not None:
                model.temperature = tried[min(range(len(tried)), key=lambda i: found[f"l{i}"])]
    return model


def _log_loss(which: Column, prior: np.ndarray, temperature: list[float]) -> Column:
    z = [F.col(f"_s_{i}") * float(t) + float(p) for i, (t, p) in enumerate(zip(temperature, prior))]
    top = F.greatest(*z) if len(z) > 1 else z[0]
    logsum = top + F.log(sum((F.exp(c - top) for c in z[1:]), F.exp(z[0] - top)))
    return F.avg(logsum - F.coalesce(*[F.when(which == i, c) for i, c in enumerate(z)]))


class Rates:
    """Fitted rates as a formula of the posteriors: r = 1, then after every step
    r - sum of step_k * p_k, held between 0 and ``most`` (no bound: None)."""

    def __init__(self, k: int, most: float | None = None):
        self.k, self.most, self.steps, self.gaps = k, most, [], [0.0] * k

    def column(self, begin: Column | None = None, since: int = 0) -> Column:
        """The rate after all steps. The steps are data of one fold over their numbers, so the
        expression is as long for one step as for many, and its compiled form is reused."""
        begin = F.lit(1.0) if begin is None else begin
        steps = self.steps[since:]
        if not steps:
            return begin
        numbers = _constant([x for step in steps for x in step])

        def move(r: Column, j: Column) -> Column:
            drop = sum((F.col(f"_p_{i}") * numbers[j * self.k + i] for i in range(1, self.k)),
                       F.col("_p_0") * numbers[j * self.k])
            now = F.greatest(F.lit(0.0), r - drop)
            return now if self.most is None else F.least(F.lit(float(self.most)), now)

        return F.aggregate(F.sequence(F.lit(0), F.lit(len(steps) - 1)), begin, move)

    def add(self, df: DataFrame, out: str) -> DataFrame:
        return df.withColumn(out, self.column())


def fit_rates(members: DataFrame, targets: np.ndarray, most: float | None = None) -> Rates:
    """Projected-gradient least squares over the documents' rates.

    ``members``: _n_tokens, _p_<i>; ``targets``: wanted token totals; ``most``: upper bound of a
    rate. A step needs the domain totals and cross products only, one aggregate of a few
    numbers. Gaps are weighted by the inverse of the token cross products of the documents
    whose rate is not held at a bound, which makes the problem perfectly conditioned: the
    first step solves it but for the bounds, and further ones repair what they cut off. A
    step that raises the weighted squares of the gaps is taken back and replaced by one in
    the metric of all documents, which cannot raise them. The fit ends when all targets
    are met, when a step moves the rates by less than STILL of all tokens (no step gets
    nearer), or after MAX_STEPS; ``gaps`` of the result has what is left per domain. Where
    steps left more than a trace of the gaps, or no rate is free to begin with (all are at ``most``), the dual
    problem is solved instead (:func:`_fit_dual`).
    """
    k = len(targets)
    t = F.col("_n_tokens").cast("double")
    if most is not None and most <= 1.0:
        return _fit_dual(members, targets, most)
    rates, met = Rates(k, most), False
    state, done = members.withColumn("_r", F.lit(1.0)), 0
    safe, weight, begin, scale, last, stuck, fast = None, None, None, 1.0, math.inf, 0, False
    before = np.zeros(k)
    for _ in range(MAX_STEPS):
        earlier = Rates(k, most)
        earlier.steps = rates.steps[:-1]
        now = (state.withColumn("_now", rates.column(F.col("_r"), done))
               .withColumn("_was", earlier.column(F.col("_r"), min(done, len(earlier.steps)))))
        free = F.col("_now") > 0
        if most is not None:
            free = free & (F.col("_now") < most)
        row = now.agg(
            F.sum(t * F.abs(F.col("_now") - F.col("_was"))).alias("moved"), F.sum(t).alias("tokens"),
            *[F.sum(t * F.col("_now") * F.col(f"_p_{i}")).alias(f"e{i}") for i in range(k)],
            *[F.sum(F.when(free, t * F.col(f"_p_{i}") * F.col(f"_p_{j}")).otherwise(0.0)).alias(f"g{i}_{j}")
              for i in range(k) for j in range(i, k)]).first()
        if row["e0"] is None:
            return rates
        gram = np.array([[row[f"g{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
        gap = np.array([row[f"e{i}"] for i in range(k)]) - targets
        if safe is None:
            scale = max(float(row["tokens"]), 1.0)
            safe = weight = np.linalg.inv(gram + np.eye(k) * (RIDGE * np.trace(gram) / k + 1e-9))
        loss = float(gap @ weight @ gap)
        begin = loss if begin is None else begin
        if loss > last and fast:  # a fast step overshot: take it back, go on in the safe metric
            rates.steps.pop()
            rates.steps.append((safe @ before).tolist())
            fast = False
            continue
        rates.gaps = gap.tolist()
        stuck = stuck + 1 if loss > last * 0.999 else 0
        still = bool(rates.steps) and row["moved"] < STILL * scale
        met = float(np.abs(gap).max()) / scale < TOLERANCE
        if met or still or stuck > PATIENCE:  # met, or not by these steps
            break
        last, before = min(last, loss), gap
        if len(rates.steps) - done >= CUT_EVERY:
            state = cut(state.withColumn("_r", rates.column(F.col("_r"), done)))
            done = len(rates.steps)
        fast = True
        quick = np.linalg.inv(gram + np.eye(k) * (1e-3 * RIDGE * np.trace(gram) / k + 1e-9))
        rates.steps.append((quick @ gap).tolist())
    left = float(np.array(rates.gaps) @ safe @ np.array(rates.gaps))
    if met or left <= NEAR * begin:
        return rates
    other = _fit_dual(members, targets, most)
    return rates if left <= float(np.array(other.gaps) @ safe @ np.array(other.gaps)) + NEAR * begin else other


def _fit_dual(members: DataFrame, targets: np.ndarray, most: float | None) -> Rates:
    """Least squares with a small pull towards rates of 1, by Newton steps on its dual.

    Minimising sum of t (r - 1)^2 / 2 + FIRM / 2 * (weighted squares of the gaps) within the
    bounds has r = 1 - l * p held at the bounds, l one number per domain. The dual is concave in
    these numbers and quadratic between the documents' bounds; a Newton step that does not
    raise it is halved. Each evaluation is one aggregate of a few numbers over all documents,
    and the fitted rate is a formula of one step.
    """
    k = len(targets)
    t = F.col("_n_tokens").cast("double")

    def measure(dual: np.ndarray):
        """Value of the dual but for its last term, gaps, and cross products of the free documents and of all."""
        rates = Rates(k, most)
        rates.steps = [dual.tolist()]
        now = members.withColumn("_now", rates.column())
        free = F.col("_now") > 0
        if most is not None:
            free = free & (F.col("_now") < most)
        pull = sum((F.col(f"_p_{i}") * float(x) for i, x in enumerate(dual)), F.lit(0.0))
        row = now.agg(
            F.sum(t * (0.5 * (F.col("_now") - 1.0) * (F.col("_now") - 1.0) + F.col("_now") * pull)).alias("v"),
            *[F.sum(t * F.col("_now") * F.col(f"_p_{i}")).alias(f"e{i}") for i in range(k)],
            *[F.sum(F.when(free, t * F.col(f"_p_{i}") * F.col(f"_p_{j}")).otherwise(0.0)).alias(f"g{i}_{j}")
              for i in range(k) for j in range(i, k)],
            *[F.sum(t * F.col(f"_p_{i}") * F.col(f"_p_{j}")).alias(f"a{i}_{j}")
              for i in range(k) for j in range(i, k)]).first()
        if row["e0"] is None:
            return None
        square = [np.array([[row[f"{c}{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]) for c in "ga"]
        gap = np.array([row[f"e{i}"] for i in range(k)]) - targets
        return row["v"] - float(dual @ targets), gap, square[0], square[1]

    dual = np.zeros(k)
    at = measure(dual)
    rates = Rates(k, most)
    if at is None:
        return rates
    full = at[3] + np.eye(k) * (RIDGE * np.trace(at[3]) / k + 1e-9)
    soft = full / FIRM
    value, size = at[0], 1.0
    scale = max(float(np.trace(at[3])), 1.0)
    for _ in range(MAX_STEPS):
        slope = at[1] - soft @ dual
        if float(np.abs(slope).max()) / scale < TOLERANCE:
            break
        step = np.linalg.solve(at[2] + soft, slope)
        for _ in range(MAX_HALVINGS):
            there = dual + size * step
            tried = measure(there)
            found = tried[0] - 0.5 * float(there @ soft @ there)
            if found > value:
                break
            size /= 4
        else:
            break
        dual, at, value, size = there, tried, found, min(1.0, 4 * size)
    rates.steps = [dual.tolist()]
    rates.gaps = at[1].tolist()
    return rates


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] | None = None,
        budget: float | None = None) -> DataFrame:
    """doc_id, n_tokens, p_<domain>, rate for every row of ``docs``.

    ``labelled``: doc_id, domain; ``targets``: domain -> share of ``budget`` (default: all
    tokens of the corpus, one per white-space separated word). Null and empty texts
    have no tokens and the prior as posterior; repeated rows are rated alike; an
    empty table gives no rows. A domain that no document belongs to cannot be met;
    the others are met as well as least squares allow.
    """
    targets = targets or TARGETS
    domains = sorted(targets)
    model = learn(docs, labelled, domains)
    members = cut(model.add(docs.select("doc_id", "text")).drop("text"))
    total = members.agg(F.sum("_n_tokens")).first()[0] or 0
    share = np.array([targets[d] for d in domains], dtype=float)
    rates = fit_rates(members, share / share.sum() * (total if budget is None else budget))
    return rates.add(members, "_rate").select(
        "doc_id", F.col("_n_tokens").alias("n_tokens"),
        *[F.col(f"_p_{i}").alias(f"p_{d}") for i, d in enumerate(domains)], F.col("_rate").alias("rate"))


def thin(docs: DataFrame, labelled: DataFrame, keep: dict[str, float]) -> DataFrame:
    """The rows of ``docs`` after sampling each with its fitted rate, which is 1 at most.

    ``keep``: domain -> share of its expected tokens that is wanted. The draw hashes
    id and text, so it is the same on every run; all columns are returned. Texts
    are scanned twice rather than stored or shuffled.
    """
    domains = sorted(keep)
    k = len(domains)
    cols = docs.columns
    model = learn(docs.select("doc_id", "text"), labelled, domains)
    members = cut(model.add(docs.select("text")).drop("text"))
    have = members.agg(*[F.sum(F.col("_n_tokens") * F.col(f"_p_{i}")).alias(f"e{i}") for i in range(k)]).first()
    rates = fit_rates(members, np.array([(have[f"e{i}"] or 0.0) * keep[d] for i, d in enumerate(domains)]),
                      most=1.0)
    packed = docs.select(F.struct(*cols).alias("_row"), "text", "doc_id")
    draw = F.pmod(F.xxhash64("doc_id", "text", F.lit(SEED)), F.lit(1 << 30)) / float(1 << 30)
    rated = settled(rates.add(model.add(packed), "_rate").select("_row", "doc_id", "text", "_rate"), ["_rate"])
    return rated.filter(draw < F.col("_rate")).select("_row.*")


def op2(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), label_domains(table(spark, sf_dir, "labels")))
