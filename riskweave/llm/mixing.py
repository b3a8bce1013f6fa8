"""Mixing by soft membership: document rates whose expected domain token totals meet targets.

A softmax classifier over hashed words, fitted on a bounded sample of a labelled table,
gives every document posteriors over domains. Rates r >= 0 minimise the squared gaps between
sum(r * tokens * posterior) and the targets, weighed by the domains' totals at r = 1, by accelerated projected gradient from r = 1,
scaled by tokens, so that a rate depends on the posterior and on the few residuals so far
only. A step is one pass that sums numbers per domain; documents are never gathered. Steps go
on until every domain is within CLOSE of its target; a mix that can't get there is given out
with a warning that names the gap.

Tokens are words. Defined cases: a null text has no words, the prior as posterior, and a
rate like any other; rows with null ids get rates too. Labels with a null id or null marks
teach nothing; without any, all documents are of the first domain and keep rate 1. Domains that
nothing taught have posterior 0 and no target. Texts beyond TRAIN_CHARS teach by their first
TRAIN_CHARS characters. Repeated rows each count.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import chunks, extended, text_buffer, word_names, written

BITS = 12
#: Bounds of the fit: labelled rows, characters of one, passes over them.
TRAIN_ROWS, TRAIN_CHARS, EPOCHS = 3000, 20_000, 150
#: The steps end when every domain is within CLOSE of its own target, or none of PATIENCE steps brought the worst one closer.
CLOSE, PATIENCE = 5e-3, 40
BATCH = 64

#: Domains of the labelled table, and the shares of the mix.
DOMAINS = ("good", "low", "toxic")
SHARES = {"good": 0.88, "low": 0.08, "toxic": 0.04}


def domain_of() -> Column:
    return F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "good")


@dataclass
class Classifier:
    domains: tuple[str, ...] = DOMAINS
    weights: np.ndarray = field(default_factory=lambda: np.zeros((1 << BITS, len(DOMAINS)), np.float32))
    offset: np.ndarray = field(default_factory=lambda: np.array([50.0] + [0.0] * (len(DOMAINS) - 1)))

    def posteriors(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.weights + self.offset
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit rows of damped word counts by hash, and the number of words."""
    names, bounds = word_names(data, offsets, lower=True)
    bucket = (names[:, 0] >> np.uint64(64 - BITS)).astype(np.int64)
    n = np.diff(bounds)
    doc = np.repeat(np.arange(len(n)), n)
    x = np.log1p(np.bincount((doc << BITS) + bucket, minlength=len(n) << BITS).reshape(len(n), -1)).astype(np.float32)
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-9), n


def fit(x: np.ndarray, y: np.ndarray, domains: tuple[str, ...], ridge: float = 1e-4) -> Classifier:
    """Softmax regression by Adam on all rows at once."""
    k, n = len(domains), len(x)
    target = np.eye(k)[y]
    prior = np.where(target.any(0), np.log(target.mean(0) + 1e-3), -np.inf)  # what nothing taught isn't found
    w, m, v = (np.zeros((x.shape[1], k)) for _ in range(3))
    model = Classifier(domains, w.astype(np.float32), prior)
    for t in range(1, EPOCHS + 1):
        grad = x.T @ (model.posteriors(x) - target) / n + ridge * w
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        w -= 0.3 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
        model.weights = w.astype(np.float32)
    return model


def train(docs: DataFrame, labels: DataFrame) -> Classifier:
    """Fits on at most about TRAIN_ROWS labelled documents, drawn by a hash of their id."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), domain_of().alias("domain")).dropna().dropDuplicates(["doc_id"])
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(F.col("text").isNotNull())
    total = texts.select("doc_id").join(marks, "doc_id").count()  # labels of other documents aren't drawn from
    if not total:
        return Classifier()
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("mix")), F.lit(1_000_000)) < -(-TRAIN_ROWS * 1_000_000 // total)
    drawn = texts.filter(draw).withColumn("text", F.substring("text", 1, TRAIN_CHARS))
    rows = sorted((r["doc_id"], r["text"], r["domain"]) for r in drawn.join(marks.filter(draw), "doc_id").limit(2 * TRAIN_ROWS).collect())
    if not rows:
        return Classifier()
    data, offsets = text_buffer(pa.array([t for _, t, _ in rows], pa.string()))
    x = np.concatenate([features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])[0] for a, b in chunks(offsets)])
    return fit(x, np.array([DOMAINS.index(d) for _, _, d in rows]), DOMAINS)


def _told(text: pa.Array, model: Classifier) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and posteriors of each text."""
    data, offsets = text_buffer(text)
    n, p = np.zeros(len(text), np.int64), np.zeros((len(text), len(model.domains)))
    for a, b in chunks(offsets):
        for i in range(a, b, BATCH):
            j = min(b, i + BATCH)
            x, n[i:j] = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            p[i:j] = model.posteriors(x)
    return n, np.round(p, 9)


def _member(shared):
    """An Arrow function of text to n_tokens and posterior; other columns don't travel."""

    @F.arrow_udf("struct<n_tokens:bigint,posterior:array<double>>")
    def member(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for text in batches:
            n, p = _told(text, shared.value)
            yield pa.StructArray.from_arrays([pa.array(n), pa.array(list(p), pa.list_(pa.float64()))], names=["n_tokens", "posterior"])

    return member.asNondeterministic()


def _rate(shared, steps, rate_of):
    """An Arrow function of text to its rate."""

    @F.arrow_udf("double")
    def rate(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for text in batches:
            yield pa.array(np.round(rates(_told(text, shared.value)[1], steps, rate_of)[0], 6))

    return rate.asNondeterministic()


def _momentum(step: int) -> float:
    return step / (step + 3)


def rates(p: np.ndarray, residuals: list[np.ndarray], rate_of: float) -> tuple[np.ndarray, np.ndarray]:
    """Rates after the steps that the residuals led, and the look-ahead at which the next residual is due."""
    r, ahead = np.ones(len(p)), np.ones(len(p))
    for k, g in enumerate(residuals):
        new = np.maximum(0, ahead - rate_of * (p @ g))
        ahead, r = new + _momentum(k) * (new - r), new
    return r, ahead


def _sums(batches, residuals, rate_of, names):
    """mapInArrow: per batch and domain, tokens at the look-ahead and at the rates."""
    k = len(names)
    for batch in batches:
        n = np.asarray(batch.column(0), float)
        p = np.asarray(batch.column(1).flatten(), float).reshape(-1, k)
        r, ahead = rates(p, residuals, rate_of)
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(p.T @ (n * ahead)), pa.array(p.T @ (n * r))], names=["domain", "ahead", "now"])


def fit_rates(members: DataFrame, domains: tuple[str, ...], shares: dict[str, float], total: float | None = None) -> tuple[list[np.ndarray], float, np.ndarray]:
    """Residuals and step length that give every document its rate, and the targets.

    members: n_tokens, posterior. total: tokens of the mix; by default such that the domain of the
    largest share keeps its tokens, so a scarce domain is repeated and shrinks no other. Domains
    without tokens have no target, and the others share the mix.
    """
    share = np.array([shares[d] for d in domains])
    few = members.select("n_tokens", "posterior")

    def totals(residuals: list[np.ndarray], rate_of: float) -> tuple[np.ndarray, np.ndarray]:
        got = few.mapInArrow(lambda it: _sums(it, residuals, rate_of, list(domains)), "domain string, ahead double, now double").groupBy("domain").agg(F.sum("ahead"), F.sum("now")).collect()
        found = {r[0]: (r[1], r[2]) for r in got}
        return tuple(np.array([found.get(d, (0.0, 0.0))[i] for d in domains]) for i in (0, 1))

    start, _ = totals([], 0.0)
    every = start.sum()
    share = np.where(start > 0, share, 0)
    if not share.sum():
        return [], 0.0, share
    share /= share.sum()
    main = share.argmax()
    target = share * (total if total is not None else start[main] / share[main])
    steps: list[np.ndarray] = []
    ahead = start
    rate_of = 1.0  # with gaps weighed by the totals the largest curvature is 1, as posteriors sum to 1
    best, idle = np.inf, 0
    while True:
        steps.append((ahead - target) / np.maximum(start, 1e-12))
        ahead, now = totals(steps, rate_of)
        gap = float((np.abs(now - target)[target > 0] / target[target > 0]).max())
        if gap <= CLOSE:
            break
        best, idle = (gap, 0) if gap < best else (best, idle + 1)
        if idle >= PATIENCE:
            warnings.warn(f"the mix misses a domain's target by {gap:.1%} after {len(steps)} steps", stacklevel=2)
            break
    return steps, rate_of, target


def _rated(batches, steps, rate_of, at: int):
    for batch in batches:
        p = np.asarray(batch.column(at).flatten(), float).reshape(batch.num_rows, -1)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.round(rates(p, steps, rate_of)[0], 6))], names=[*batch.schema.names, "rate"])


def mixed(docs: DataFrame, labels: DataFrame, shares: dict[str, float] = SHARES, total: float | None = None) -> DataFrame:
    """docs without text, with n_tokens, posterior (in the order of DOMAINS) and rate."""
    model = train(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c not in ("text", "n_tokens", "posterior", "rate")]
    told = docs.select(*kept, _member(shared)(F.col("text").cast("string")).alias("__told"))
    members = written(told.select(*kept, "__told.n_tokens", "__told.posterior"))
    steps, rate_of, _ = fit_rates(members, model.domains, shares, total)
    at = members.columns.index("posterior")
    return members.mapInArrow(lambda it: _rated(it, steps, rate_of, at), extended(members, rate="double"))


def resampled(docs: DataFrame, labels: DataFrame, shares: dict[str, float] = SHARES, total: float | None = None) -> DataFrame:
    """docs, each row as often as its rate says: the whole part, and once more if a hash of the row falls under the rest."""
    model = train(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    told = docs.select(_member(shared)(F.col("text").cast("string")).alias("told"))
    members = written(told.select("told.n_tokens", "told.posterior"))
    steps, rate_of, _ = fit_rates(members, model.domains, shares, total)
    # names of our own can't clash with the rate's
    rated = docs.select(*[F.col(c).alias(f"__{c}_") for c in docs.columns]).withColumn("rate", _rate(shared, steps, rate_of)(F.col("__text_").cast("string")))
    luck = F.pmod(F.xxhash64("__doc_id_", "__text_", F.lit("mix")), F.lit(1 << 40)) / float(1 << 40)
    copies = F.floor(F.col("rate") + luck).cast("int")
    drawn = rated.withColumn("__copy", F.explode(F.when(copies > 0, F.sequence(F.lit(1), copies))))
    return drawn.select(*[F.col(f"__{c}_").alias(c) for c in docs.columns])
