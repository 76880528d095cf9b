"""Mixing to target weights: soft domain membership and document rates that meet token totals."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table, whole_text
from .models import FEATURES, feature_matrix, labelled_sample, minimize, text_features

#: Exponent of a domain's share of tokens in its target weight: below 1 lifts scarce domains.
TEMPERATURE = 0.7
#: Rates lie between these: the targets alone say how often a document is repeated.
LEAST_RATE, MOST_RATE = 0.0, float("inf")
#: What nearness of rates to 1 counts beside nearness to the targets, and the gradient that ends the
#: rounds, as a share of all tokens.
NEARNESS, SETTLED = 1e-4, 1e-6
#: A text counts one token per word, or per so many characters where it has fewer words than that.
LONG_WORD = 16
RIDGE = 1e-4


@dataclass
class Domains:
    """Posterior of each domain: softmax of x W + b."""

    names: list[str]
    weights: np.ndarray
    bias: np.ndarray

    def posteriors(self, x: np.ndarray) -> np.ndarray:
        # row by row, so that a text's posteriors are the same in any batch
        z = np.stack([(x * w).sum(axis=1) for w in self.weights.T], axis=1) + self.bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def fit_domains(x: np.ndarray, domain: np.ndarray) -> Domains:
    """Multinomial regression; with no labelled row there is the one domain ``all``."""
    if not len(x):
        return Domains(["all"], np.zeros((FEATURES, 1)), np.zeros(1))
    names, y = np.unique(domain, return_inverse=True)
    n, k = len(x), len(names)
    scale = 1 / np.maximum(x.std(axis=0), 1e-2)
    x, one = x * scale, np.eye(k)[y]

    def f(p):
        w, b = p[:-k].reshape(FEATURES, k), p[-k:]
        z = x @ w + b
        z = z - z.max(axis=1, keepdims=True)
        log_p = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
        d = (np.exp(log_p) - one) / n
        return (-(log_p * one).sum() / n + RIDGE * (w * w).sum() / 2,
                np.concatenate([(x.T @ d + RIDGE * w).ravel(), d.sum(axis=0)]))

    p = minimize(f, np.concatenate([np.zeros(FEATURES * k), np.log(one.mean(axis=0))]), rounds=80)
    return Domains([str(v) for v in names], p[:-k].reshape(FEATURES, k) * scale[:, None], p[-k:])


def language_and_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The labelled table: (doc_id, domain) with the language and rated quality of labelled documents."""
    rated = labels.filter("quality is not null").select("doc_id", "quality")
    return docs.filter("lang is not null").select("doc_id", "lang").join(rated, "doc_id").select("doc_id", F.concat_ws(
        "-", "lang", F.when(F.col("quality") == 1, "good").otherwise("poor")).alias("domain"))


def memberships(docs: DataFrame, domains: Domains) -> DataFrame:
    """``docs`` with ``n_words``, the tokens a document counts for, and ``posterior``.

    Tokens are words; a text counts one per ``LONG_WORD`` characters at least (scripts without
    blanks), and one if it is empty or null.
    """
    sent = docs.sparkSession.sparkContext.broadcast(domains)

    @F.pandas_udf("n_words long, posterior array<float>")
    def member(texts: pd.Series) -> pd.DataFrame:
        words, rows = [], []
        for k in range(0, len(texts), 64):
            part = texts.iloc[k:k + 64].tolist()
            words += [max(len(t.split()), -(-len(t) // LONG_WORD), 1) for t in part]
            rows += [r.tolist() for r in sent.value.posteriors(text_features(part)).astype(np.float32)]
        return pd.DataFrame({"n_words": words, "posterior": rows})

    return docs.withColumn("_m", member(whole_text())).select(*docs.columns, "_m.n_words", "_m.posterior")


def _rates(p: np.ndarray, step: np.ndarray, least: float, most: float) -> np.ndarray:
    """Rates after a step from 1 down the gradient ``p @ step`` and back into the allowed range."""
    return np.clip(1 - p @ step, least, most)


def _tried(members: DataFrame, k: int, trials: list[np.ndarray], least: float,
           most: float) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """One pass: per trial step, token totals per domain, the Gram matrix of free documents, and the dual sum.

    Free are documents whose rate is not at a bound.  The dual sum is the convex function of the
    step whose gradient is minus the totals: half a square for a free document, linear at a bound.
    """
    size = k + k * k + 1

    def add(frames):
        total = np.zeros((len(trials), size))
        for frame in frames:
            if not len(frame):
                continue
            p, n = np.stack(frame["posterior"].to_numpy()).astype(float), frame["n_words"].to_numpy(float)
            for sums, step in zip(total, trials):
                z = p @ step
                r = np.clip(1 - z, least, most)
                free = r == 1 - z
                sums[:k] += (n * r) @ p
                sums[k:-1] += ((p[free] * n[free, None]).T @ p[free]).ravel()
                sums[-1] -= n @ np.where(free, z - z * z / 2, r * z + (1 - r) ** 2 / 2)
        yield pd.DataFrame({"i": np.arange(total.size), "v": total.ravel()})

    rows = members.select("n_words", "posterior").mapInPandas(add, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(len(trials) * size)
    for r in rows:
        out[r["i"]] = r["v"]
    return [(t[:k], t[k:-1].reshape(k, k), float(t[-1])) for t in out.reshape(len(trials), size)]


def fit_rates(members: DataFrame, names: list[str], weights: dict[str, float] | None = None, budget: float | None = None,
              least: float = LEAST_RATE, most: float = MOST_RATE) -> tuple[np.ndarray, pd.DataFrame]:
    """The step of projected gradient that leads from rate 1 to the fitted rates, and a report per domain.

    Least squares: find rates r in [least, most] with sum_d r_d n_d p_dk as close as can be to
    the target of every domain k, and, ``NEARNESS`` times as much, near 1.  ``weights`` gives
    target shares (by default the domain's own share to the power ``TEMPERATURE``), ``budget``
    the target total (by default the least total at which no domain has to shrink).  The residual
    is weighed by the inverse of the tokens' Gram matrix G of the domains.

    Such rates are a fixed point of projected gradient: r = clip(1 - p u) with u the weighed
    residual over ``NEARNESS``.  So a round is one pass that makes this step with a few trial
    vectors u, one number per domain each, and sends token totals and the Gram matrix of the
    documents off their bounds; they give Newton's next u.  A convex function of u with finitely
    many quadratic parts falls in every round, so the rounds end, mostly after ten.  Where the
    targets cannot be met within the bounds the rates are those of the least squares, and the
    report's ``mixed`` says how near they come.  No rate is written, and a lost executor costs
    only its tasks.
    """
    k = len(names)
    own, gram, _ = _tried(members, k, [np.zeros(k)], 1.0, 1.0)[0]
    if own.sum() == 0:
        return np.zeros(k), pd.DataFrame({"domain": names, "tokens": own, "target": own, "mixed": own})
    share = own / own.sum()
    want = np.array([weights.get(v, 0.0) for v in names]) if weights else share**TEMPERATURE
    want = want / want.sum()
    if budget is None:
        budget = max(o / w for o, w in zip(own, want) if w > 0)
    target = want * budget
    near = NEARNESS * (gram + 1e-6 * own.sum() * np.eye(k))

    def dual(step: np.ndarray, tried) -> tuple[float, np.ndarray]:
        """The function that falls, and its gradient."""
        return float(step @ near @ step / 2 + target @ step + tried[2]), near @ step + target - tried[0]

    step = np.zeros(k)
    tried = _tried(members, k, [step], least, most)[0]
    value, gradient = dual(step, tried)
    while np.abs(gradient).sum() >= SETTLED * max(budget, 1.0):
        newton = np.linalg.solve(near + tried[1], gradient)
        trials = [step - newton / 4**i for i in range(5)]
        found = _tried(members, k, trials, least, most)
        values = [dual(t, f) for t, f in zip(trials, found)]
        best = min(range(len(trials)), key=lambda i: values[i][0])
        if values[best][0] >= value:
            break  # as low as rounding lets it go
        step, tried, (value, gradient) = trials[best], found[best], values[best]
    return step, pd.DataFrame({"domain": names, "tokens": own, "target": target, "mixed": tried[0]})


def with_rates(members: DataFrame, step: np.ndarray, least: float = LEAST_RATE, most: float = MOST_RATE) -> DataFrame:
    """Adds ``rate``: how often a document is to be taken, on average."""
    sent = members.sparkSession.sparkContext.broadcast(step)

    @F.pandas_udf("double")
    def rate(posterior: pd.Series) -> pd.Series:
        if not len(posterior):
            return pd.Series([], dtype="float64")
        return pd.Series(_rates(np.stack(posterior.to_numpy()).astype(float), sent.value, least, most))

    return members.withColumn("rate", rate("posterior"))


def mixed_rates(docs: DataFrame, labelled: DataFrame, of: DataFrame | None = None, least: float = LEAST_RATE,
                most: float = MOST_RATE, weights: dict[str, float] | None = None, budget: float | None = None) -> DataFrame:
    """(doc_id, text hash, n_words, posterior, rate, domain, targets) of every row of ``docs``.

    ``targets`` holds, for each domain in the order of ``posterior``, its name, its target of
    tokens and the tokens it has at the fitted rates.

    ``labelled`` holds (doc_id, domain); the texts it labels are found in ``of`` (by default
    ``docs``).  A null text is empty and has a posterior like any other; null and repeated ids
    are rows of their own; other columns are not read.  Without documents there are no rows.
    """
    sample = labelled_sample(docs if of is None else of, labelled, ["domain"])
    domains = fit_domains(feature_matrix(sample), sample["domain"].to_numpy(str))
    narrow = docs.select("doc_id", whole_text().alias("text"))
    members = stored(memberships(narrow, domains).select("doc_id", F.xxhash64("text").alias("text_hash"), "n_words", "posterior"), "members")
    step, report = fit_rates(members, domains.names, weights, budget, least, most)
    names = F.array(*[F.lit(v) for v in domains.names])
    best = F.get(names, F.array_position("posterior", F.array_max("posterior")).cast("int") - 1)
    targets = F.array(*[F.struct(F.lit(r.domain).alias("domain"), F.lit(float(r.target)).alias("target"), F.lit(float(r.mixed)).alias("mixed"))
                        for r in report.itertuples()])
    return with_rates(members, step, least, most).withColumn("domain", best).withColumn("targets", targets)


def repeated(docs: DataFrame, rates: DataFrame, seed: int = 1) -> DataFrame:
    """``docs`` taken at their rates: the whole part always, one more with the rest as probability.

    The draw is a hash of the id and the text, so it is the same on every run and in every task,
    and rows that repeat in ``docs`` are each taken as often.  Null ids and texts are matched
    like any other.  The columns are those of ``docs``, whatever their names; no row, no result.
    """
    pick = rates.select("doc_id", "text_hash", "rate").dropDuplicates(["doc_id", "text_hash"])
    pick = pick.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_th"), F.col("rate").alias("_rate"))
    texts = docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64(whole_text()).alias("_h"))
    own = F.col("row.doc_id")
    joined = texts.join(pick, own.eqNullSafe(pick["_id"]) & (texts["_h"] == pick["_th"]))
    draw = F.pmod(F.xxhash64(own, F.col("_h"), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    times = F.floor("_rate") + F.when(draw < F.col("_rate") - F.floor("_rate"), 1).otherwise(0)
    return joined.select("row", F.explode(F.array_repeat(F.lit(0), times.cast("int")))).select("row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the target shares of tokens; every document is taken at least once.

    With rates of 1 at least, a domain that has its target's share already cannot grow by the
    soft share that documents of other domains have in it; the rates are then those of the least
    squares, and ``mixed`` in the targets differs from ``target`` by as much.
    """
    whole = table(spark, sf_dir, "documents")
    labelled = language_and_quality(whole, table(spark, sf_dir, "labels"))
    return repeated(docs, mixed_rates(docs, labelled, of=whole, least=1.0))


def op1_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rates = mixed_rates(docs, language_and_quality(docs, table(spark, sf_dir, "labels")))
    return rates.select("doc_id", "domain", "n_words", "posterior", "rate", "targets")
