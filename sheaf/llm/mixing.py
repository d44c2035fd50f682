"""Mixing documents to target weights of domains by soft membership.

A naive Bayes classifier trained on a labelled table gives each document a posterior over domains. Rates r >= 0, one for each document, are
then fitted by projected gradient descent: the expected tokens of domain d are the sum of r * n_tokens * posterior[d], and their
squared distance from the target, over the domain's share, is least, with a small pull of rates towards 1. The gradient of a document depends on the data
only by the residuals of the domains. So an iteration is one aggregation to as many numbers as there are domains, and a document's
rate is a fold over the residuals of the iterations so far: nothing but these numbers is kept between iterations.
"""

from __future__ import annotations

import warnings
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.llm.common import chance, fold, python_ready, sampled, table, unused
from sheaf.session import discard, written

BUCKETS = 1 << 14
PULL = 0.01
POSTERIOR = "struct<n_tokens:bigint,posterior:array<double>>"


@dataclass
class DomainModel:
    """Log probabilities of word buckets by domain.

    Every word of a text counts. As words aren't independent, the log likelihood of a text of more than `words` words is scaled to that of so many, which keeps the
    posteriors of long texts from being certain.
    """

    domains: list[str]
    prior: np.ndarray
    table: np.ndarray
    words: float = 64.0

    def posterior(self, text: str, buckets: _Buckets) -> tuple[int, np.ndarray]:
        w = words_of(text)
        if not w:
            return 0, np.exp(self.prior)
        at = np.fromiter(map(buckets.__getitem__, w), np.int64, len(w))
        n = np.bincount(at, minlength=BUCKETS)
        used = np.flatnonzero(n)
        x = self.prior + n[used] @ self.table[used] * min(1.0, self.words / len(w))
        x = np.exp(x - x.max())
        return len(w), x / x.sum()


class _Buckets(dict):
    """The bucket of each word, kept up to a bound."""

    def __missing__(self, w: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[w] = out = zlib.crc32(w) % BUCKETS
        return out


_KNOWN = _Buckets()


def words_of(text: str) -> list[bytes]:
    """The words of a text, in training and in prediction: runs of characters other than ASCII white space, A-Z in lower case."""
    return text.encode("utf-8", "replace").lower().split()


def _counted(batches):
    """(d, b, n): the words of each domain in each bucket, for batches of (d, t)."""
    for batch in batches:
        n: dict = {}
        for d, t in zip(batch["d"].to_pylist(), batch["t"].to_pylist(), strict=True):
            at = np.fromiter(map(_KNOWN.__getitem__, words_of(t)), np.int64)
            n[d] = n.get(d, 0) + np.bincount(at, minlength=BUCKETS)
        for d, of in n.items():
            some = np.flatnonzero(of)
            yield pa.RecordBatch.from_arrays([pa.array([d] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(of[some].astype(np.int64))], names=["d", "b", "n"])


def train(labelled: DataFrame, domain: str, text: str = "text", key: str = "doc_id", max_texts: int = 6000, words: float = 64.0) -> DomainModel:
    """A model from rows with a text and a domain.

    max_texts bounds the rows learnt from (about so many, drawn by the hash of key); their texts are counted whole. `words` is the model's. Rows without text or domain
    teach nothing; without any, there is one domain, `all`.
    """
    python_ready(labelled.sparkSession)
    rows = labelled.where(F.col(domain).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(domain).cast("string").alias("d"), F.col(text).alias("t"))
    some = sampled(rows, max_texts, "k").select("d", "t")
    got = some.mapInArrow(_counted, "d string, b int, n bigint").groupBy("d", "b").agg(F.sum("n").alias("n")).collect()
    domains = sorted({r["d"] for r in got})
    n = np.full((BUCKETS, max(1, len(domains))), 0.1)
    for r in got:
        n[r["b"], domains.index(r["d"])] += r["n"]
    total = n.sum(0)
    return DomainModel(domains or ["all"], np.log(np.full(n.shape[1], 1 / n.shape[1])), np.log(n / total), words)


def _posteriors(model):
    def run(texts: pa.Array) -> pa.Array:
        m = model.value
        got = [m.posterior(x.as_py() or "", _KNOWN) for x in texts]
        return pa.StructArray.from_arrays([pa.array([n for n, _ in got], pa.int64()), pa.array([p for _, p in got], pa.list_(pa.float64()))], ["n_tokens", "posterior"])

    return run


#: Steps of the fit after which rates are written, so that a pass folds over so many at most.
KEPT_STEPS = 8


def rate_of(posterior: Column, steps: list[list[float]], pull: float = PULL, before: Column | None = None) -> Column:
    """A document's rate after the projected steps, from 1 or what it was before: each entry of steps has the residual of every domain, over its share."""
    eta = 1 / (1 + pull)
    before = F.lit(1.0) if before is None else before
    if not steps:
        return before
    def step(r, g):
        dot = F.aggregate(F.zip_with(posterior, g, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
        return F.greatest(F.lit(0.0), r - F.lit(eta) * (dot + F.lit(pull) * (r - 1)))
    return F.aggregate(F.from_json(F.lit(repr(steps)), "array<array<double>>"), before, step)


def fit(members: DataFrame, targets: list[float], rounds: int = 100, close: float = 1e-4) -> list[list[float]]:
    """The residuals, over the shares, of each iteration for members (n_tokens, posterior) and the target share of each domain.

    It ends when the targets are met up to `close`, or when the residuals stand still (targets that no nonnegative rates meet: their distance is then
    least). A warning is given if neither came about in so many rounds.
    """
    k = len(targets)
    sums = lambda of, r: of.agg(F.sum("n_tokens").alias("n"), *[F.sum(r * F.col("n_tokens") * F.col("posterior")[d]).alias(f"d{d}") for d in range(k)]).first()
    first = sums(members, F.lit(1.0))
    if not first["n"]:
        return []
    shares = [max(first[f"d{d}"] / first["n"], 1e-6) for d in range(k)]
    steps, now, rated = [], shares, members.select("n_tokens", "posterior", F.lit(1.0).alias("rate"))
    for _ in range(rounds):
        gap = [a - b for a, b in zip(now, targets, strict=True)]
        if max(abs(g) / max(t, 1e-6) for g, t in zip(gap, targets, strict=True)) < close or (len(steps) > 1 and max(abs(g / s - o) for g, s, o in zip(gap, shares, steps[-1], strict=True)) < close / 10):
            break
        steps.append([g / s for g, s in zip(gap, shares, strict=True)])
        since = steps[(len(steps) - 1) // KEPT_STEPS * KEPT_STEPS :]
        got = sums(rated, rate_of(F.col("posterior"), since, before=F.col("rate")))
        if len(since) == KEPT_STEPS:
            last, rated = rated, written(rated.withColumn("rate", rate_of(F.col("posterior"), since, before=F.col("rate"))))
            discard(last)
        now = [got[f"d{d}"] / first["n"] for d in range(k)]
    else:
        warnings.warn(f"mixing: the shares {now} still move after {rounds} rounds; the targets are {targets}", stacklevel=2)
    discard(rated)
    return steps


def _shares(model: DomainModel, targets: dict[str, float] | None) -> list[float]:
    w = {d: 1.0 for d in model.domains} if targets is None else targets
    total = sum(w.get(d, 0.0) for d in model.domains) or 1.0
    return [w.get(d, 0.0) / total for d in model.domains]


def copies_of(rate: Column, *by: str | Column) -> Column:
    """rate rounded up or down by the chance of by, so that the mean over many rows is the rate: by must tell rows apart, those that repeat too."""
    return F.floor(rate) + (chance(*by, F.lit("mix")) < rate - F.floor(rate)).cast("bigint")


def rates(docs: DataFrame, model: DomainModel, targets: dict[str, float] | None = None, key: str = "doc_id", text: str = "text", rounds: int = 100) -> DataFrame:
    """(key, n_tokens, domain, posterior, rate, copies) for each row of docs.

    targets are weights of domains, equal ones by default; a domain left out has weight 0. The total of tokens stays as it is. n_tokens are
    runs of non-white characters. domain is the likeliest (the first by name where even). copies is the rate rounded at random by the hash of the key and of the row's place in
    the table, so that its mean is the rate, over rows that repeat or have no key too. A null or empty text has no tokens, even posteriors and so weighs nothing. Texts are read whole; repeated rows get equal
    rates; null keys are keys like others; other columns aren't read. An empty table gives no rows.
    """
    python_ready(docs.sparkSession)
    run = F.arrow_udf(_posteriors(docs.sparkSession.sparkContext.broadcast(model)), POSTERIOR)
    members = written(docs.select(F.col(key).alias("k"), F.monotonically_increasing_id().alias("place"), run(F.col(text)).alias("m")).select("k", "place", "m.n_tokens", "m.posterior"))
    steps = fit(members, _shares(model, targets), rounds)
    names = F.array(*[F.lit(d) for d in model.domains])
    x = members.withColumn("rate", F.round(rate_of(F.col("posterior"), steps), 9)).withColumn("domain", F.element_at(names, F.array_position("posterior", F.array_max("posterior")).cast("int")))
    return x.select(F.col("k").alias(key), "n_tokens", "domain", "posterior", "rate", copies_of(F.col("rate"), "k", "place").alias("copies"))


#: Target weights of the languages, which are the domains here.
TARGETS = {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}


def _model(spark: SparkSession, sf_dir: str) -> DomainModel:
    return train(table(spark, sf_dir, "documents").where(fold("doc_id", 5) != 0), "lang")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, domain, rate, copies of every document: the domains are languages, learnt from rows whose fold of five is not 0."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return rates(docs, _model(spark, sf_dir), TARGETS).drop("posterior")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with each row as many times as its copies: the mixing itself, with the rates of `rates` for docs.

    Posteriors are worked out once for the fit and once for the rows, so that nothing is joined: rows with a null or repeated id get the copies of their own
    text, rounded by their own place in the table. Null and empty texts, which weigh nothing, have even posteriors and the rate of these. Texts are read whole; the columns are those of docs, whatever their
    names; an empty table stays empty.
    """
    python_ready(spark)
    model = _model(spark, sf_dir)
    run = F.arrow_udf(_posteriors(spark.sparkContext.broadcast(model)), POSTERIOR)
    members = written(docs.select(run(F.col("text")).alias("m")).select("m.*"))
    steps = fit(members, _shares(model, TARGETS))
    discard(members)
    m, n, place = unused("_mixed", docs), unused("_copy", docs), unused("_place", docs)
    x = docs.withColumn(place, F.monotonically_increasing_id()).withColumn(m, run(F.col("text")))
    often = copies_of(F.round(rate_of(F.col(f"{m}.posterior"), steps), 9), "doc_id", place)
    return x.withColumn(n, F.explode(F.array_repeat(F.lit(0), often.cast("int")))).drop(m, n, place)
